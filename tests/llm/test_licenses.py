"""License scans: spellings that are equal, texts that are not."""

from pathlib import Path

import pytest

from cohortlens.llm import licenses as L


def scan(spark, rows, known=None):
    docs = spark.createDataFrame(rows, "doc_id long, text string, digest string")
    found = L.scan(docs, L.known_digests(spark, known)).collect()
    return sorted(((str(r.doc_id), r.kind, r.line, r.license_id) for r in found), key=str)


def test_equivalent_spellings(spark):
    body = L.MIT.replace("\n", " ").upper().replace("SUBLICENSE", "sub-license").replace(",", " , ").replace('"', "“")
    rows = [(1, "MIT License\n", None), (2, "Copyright (c) 2020 A. Person\nAll rights reserved.\n\n" + body, "x"),
            (3, "Some words.\n * released under THE mit licence!\nMore.", None), (4, body + " Extra clause.", None),
            (5, "Licensed under the Apache License v2.0", None), (6, "licensed under the  Apache Licence, Version 2.0.", None),
            (7, "Licensed under the Apache License, Version 3.0", None), (8, "© 2001 B. Writer", None)]
    whole = [(d, "text", None, "Apache-2.0") for d in ("5", "6")]
    line = [(d, "notice", 0, "Apache-2.0") for d in ("5", "6")]
    want = [("2", "text", None, "MIT"), ("2", "notice", 3, "MIT"), ("3", "notice", 1, "MIT"), *whole, *line]
    assert scan(spark, rows) == sorted(want, key=str)


def test_whole_texts_of_the_catalogue_match_themselves(spark):
    rows = [(k, t, None) for k, (_, t) in enumerate(L.TEXTS.items())]
    got = {r[0]: r[3] for r in scan(spark, rows) if r[1] == "text"}
    assert got == {str(k): name for k, name in enumerate(L.TEXTS)}


def test_messy_rows(spark, messy, nothing):
    known = L.known_digests(spark, [("own", "A, B. C d-e f/g (H)"), ("void", "..."), ("copy", "a b c d e f g h")])
    got = sorted((r.doc_id, r.kind, r.license_id) for r in L.scan(messy, known).collect())
    assert got == sorted((d, k, "copy") for d in (1, 1, 8, 10) for k in ("notice", "text"))
    assert L.scan(nothing, known).collect() == [] and L.scan(messy, known.limit(0)).collect() == []


def test_license_files_with_a_title_and_spdx_lines(spark):
    rows = [(1, "MIT License\n\nCopyright (c) 2020 A. Person\n\n" + L.MIT, None), (2, "The MIT License (MIT)\n" + L.MIT, None),
            (3, "BSD 3-Clause License\n\nCopyright (c) 2020, B\nAll rights reserved.\n\n" + L.TEXTS["BSD-3-Clause"], None),
            (4, "x\n// SPDX-License-Identifier: GPL-2.0-or-later\ny", None), (5, "SPDX-License-Identifier: GPL-4.0-only", None)]
    got = [r for r in scan(spark, rows) if r[1] == "text" or r[0] == "4"]
    assert got == [("1", "text", None, "MIT"), ("2", "text", None, "MIT"), ("3", "text", None, "BSD-3-Clause"),
                   ("4", "notice", 1, "GPL-2")]


def test_published_whole_texts(spark):
    names = ["GPL-2", "GPL-3", "LGPL-2", "LGPL-2.1", "LGPL-3", "MPL-2.0", "Apache-2.0", "CC0-1.0"]
    folder = Path("/usr/share/common-licenses")
    if not all((folder / n).exists() for n in names):
        pytest.skip("no common-licenses here")
    texts = [(folder / n).read_text() for n in names]
    untitled = [t.lstrip().split("\n", 3 if n == "Apache-2.0" else 2)[-1] for n, t in zip(names[:7], texts, strict=False)]
    rows = [(k, t, None) for k, t in enumerate([*texts, *untitled, texts[1] + "One more clause."])]
    got = {int(r[0]): r[3] for r in scan(spark, rows) if r[1] == "text"}
    assert got == dict(enumerate(names + names[:7]))
