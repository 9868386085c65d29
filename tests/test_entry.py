"""The entry loads whole, and without the text-corpus subpackage."""
import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SHOW = """
import __spark_entry__ as e
q, s = e.queries(), e.oracle_sql()
assert set(s) <= set(q)
print(len(q), any(n.startswith("op") and n[2].isdigit() for n in q), "pipeline" in q)
"""


def _loaded(folder):
    env = {**os.environ, "PYTHONPATH": str(folder), "PYTHONDONTWRITEBYTECODE": "1"}
    out = subprocess.run([sys.executable, "-c", SHOW], cwd=folder, env=env, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr
    return out.stdout.split()


def test_loads_without_the_corpus_subpackage(tmp_path):
    """With and without corpus_pipeline.py beside it."""
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    shutil.copytree(f"{ROOT}/cohortlens", tmp_path / "cohortlens", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    bare = _loaded(tmp_path)
    assert bare[1:] == ["False", "False"] and int(bare[0]) >= 99
    if os.path.exists(f"{ROOT}/corpus_pipeline.py"):
        shutil.copy(f"{ROOT}/corpus_pipeline.py", tmp_path)
        assert _loaded(tmp_path) == bare
