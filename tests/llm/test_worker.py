"""Python workers give back what a task took, and keep tables only for tasks of the same kind."""

import re
import subprocess
import sys
from pathlib import Path

import pyarrow as pa
import pytest
from pyspark import cloudpickle

from cohortlens.llm import worker
from cohortlens.llm.simple8b import TOKENS, default_tokenizer, tokenizer_of

BATCH = pa.record_batch([pa.array([1, 2])], names=["k"])


def test_tables_are_dropped_by_tasks_of_another_kind():
    own = tokenizer_of(default_tokenizer())
    assert list(worker.lean(lambda x: x, TOKENS)(iter([BATCH]))) == [BATCH]
    assert tokenizer_of(default_tokenizer()) is own
    assert list(worker.lean(lambda x: x)(iter([BATCH]))) == [BATCH]
    assert not worker.kept


@pytest.mark.parametrize("task", [worker.lean(lambda x: x), worker.lean_group(lambda x: x)])
def test_tables_are_dropped_by_tasks_that_came_as_bytes(task):
    """As Spark sends them: the worker's tables are meant, not a copy of the driver's."""
    worker.kept["tables"] = {"path": 1}
    arrived = cloudpickle.loads(cloudpickle.dumps(task))
    given = pa.Table.from_batches([BATCH])
    list(arrived(given.to_batches() if task.__name__ == "task" else given))
    assert not worker.kept


def test_tables_stay_for_tasks_of_their_kind_that_came_as_bytes():
    own = tokenizer_of(default_tokenizer())
    list(cloudpickle.loads(cloudpickle.dumps(worker.lean(lambda x: x, TOKENS)))(iter([BATCH])))
    assert tokenizer_of(default_tokenizer()) is own
    worker.kept.clear()


def test_a_task_gives_its_memory_back():
    """Small blocks under a last one that stays: the C library alone would keep them."""
    code = """
import re
from cohortlens.llm import worker
def mb():
    return int(re.search(r"Pss_Anon:\\s+(\\d+)", open("/proc/self/smaps_rollup").read())[1]) / 1024
stay = []
def run(batches):
    held = [bytes(2000) for _ in range(60_000)]
    stay.append(bytes(2000))
    yield from batches
before = mb()
list(GIVEN(iter([])))
print(mb() - before)
"""
    root = str(Path(__file__).resolve().parents[2])
    grown = [float(subprocess.run([sys.executable, "-c", code.replace("GIVEN", f)], cwd=root, capture_output=True,
                                  text=True, check=True).stdout) for f in ("run", "worker.lean(run)")]
    assert grown[0] > 90 and grown[1] < 20


def test_every_task_of_the_pipeline_is_lean():
    folder = Path(worker.__file__).parent
    for name in ("jaccard", "decontam", "simple8b"):
        calls = re.findall(r"\b(?:mapInArrow|applyInArrow)\((\w+)", (folder / f"{name}.py").read_text())
        assert calls and set(calls) <= {"lean", "lean_group"}
