"""License scans by canonical digests.

A text's canonical form has A-Z in lower case, equivalent spellings made equal,
every run of other characters than letters and digits as one space, and no
copyright lines.  The digests of whole texts, and of each of their lines (a
notice stands on a line), are looked up in the digests of known licenses by a
hash join.  Texts are canonicalised where they are read; only digests meet the
catalogue, which is broadcast if it is small and joined by shuffle if not.

Edge cases: null, empty and blank texts, and lines without letters or digits,
match nothing; null ids are carried; repeated rows match once each; an empty table or
catalogue gives no rows; other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.llm import common as C
from cohortlens.llm.license_digests import DIGESTS

SMALL_CATALOGUE = 100_000

# Equivalent spellings, in the order in which they are applied.
EQUIVALENT = (
    (r"licenc", "licens"),
    (r"isation", "ization"),
    (r"(author|organ|recogn|util|real|maxim|optim|initial|categor|capital)is", "$1iz"),
    (r"(fav|lab|hon|behavi)our", "$1or"),
    (r"https://", "http://"),
    (r"sub-license|sub license", "sublicense"),
    (r"non-commercial|non commercial", "noncommercial"),
    (r"copyright owner", "copyright holder"),
    (r"acknowledgement", "acknowledgment"),
    (r"\bwhilst\b", "while"),
    (r",? ?\bversion ([0-9])|,? ?\bv\.? ?([0-9])", " v$1$2"),
)
# A line can only match one of the patterns above if it holds one of these.
HINTS = ("licenc", "isation", "https://", "sub-license", "sub license", "non-commercial", "non commercial", "copyright owner",
         "acknowledgement", "whilst", "version ", *(f"{w}is" for w in "author organ recogn util real maxim optim initial categor "
         "capital".split()), *(f"{w}our" for w in "fav lab hon behavi".split()))
HINT_PATTERN = r"\bv\.? ?[0-9]"
# a line that names a holder or a year, not one that goes on about copyright holders
COPYRIGHT_LINE = r"^[^a-z0-9©]*(copyright\s*(\(c\)|©|[0-9]|by\b)|©|\(c\)\s*[0-9a-z]|all rights reserved)"

# Texts of known licenses, as published (copyright lines left out).
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN
ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF
THIS SOFTWARE."""
BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided
that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following
disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution."""
BSD_THIRD = """
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote
products derived from this software without specific prior written permission."""
BSD_TAIL = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,
SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY,
WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF
THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
APACHE_NOTICE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an
"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the
specific language governing permissions and limitations under the License."""
TEXTS = {"MIT": MIT, "ISC": ISC, "BSD-2-Clause": BSD_HEAD + BSD_TAIL, "BSD-3-Clause": BSD_HEAD + BSD_THIRD + BSD_TAIL,
         "Apache-2.0": APACHE_NOTICE}

# Names under which licenses are cited; every phrase below is combined with each.
NAMES = {
    "MIT": ("MIT License", "MIT"),
    "ISC": ("ISC License", "ISC"),
    "BSD-2-Clause": ("BSD 2-Clause License", "BSD-2-Clause", "Simplified BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "BSD-3-Clause", "New BSD License"),
    "Apache-2.0": ("Apache License, Version 2.0", "Apache License 2.0", "Apache-2.0"),
    "MPL-2.0": ("Mozilla Public License, Version 2.0", "Mozilla Public License 2.0", "MPL-2.0"),
    "CC0-1.0": ("CC0 1.0", "CC0 1.0 Universal", "CC0"),
} | {
    f"{short}-{v}": (f"{name}, version {v}", f"{name} {v}", f"GNU {name}, version {v}", f"GNU {name} {v}", f"{short}-{v}",
                     f"{short}v{v}")
    for short, name in (("GPL", "General Public License"), ("LGPL", "Lesser General Public License"),
                        ("AGPL", "Affero General Public License")) for v in ("2", "2.1", "3")
} | {
    f"CC-BY{k}-{v}": (f"CC BY{k} {v}", f"CC-BY{k}-{v}", f"Creative Commons Attribution{name} {v} International License",
                      f"Creative Commons Attribution{name} {v} License")
    for k, name in (("", ""), ("-SA", "-ShareAlike"), ("-NC", "-NonCommercial"), ("-ND", "-NoDerivatives"),
                    ("-NC-SA", "-NonCommercial-ShareAlike"), ("-NC-ND", "-NonCommercial-NoDerivatives"))
    for v in ("2.0", "3.0", "4.0")
}
PHRASES = ("Licensed under {}", "Licensed under the {}", "Released under {}", "Released under the {}",
           "Distributed under the {}", "This work is licensed under {}", "This work is licensed under the {}",
           "This work is licensed under a {}", "This software is released under the {}", "SPDX-License-Identifier: {}")


def catalogue() -> list[tuple[str, str]]:
    """(license_id, text) of the known whole texts and notices."""
    return [*TEXTS.items(), *((k, p.format(n)) for k, names in NAMES.items() for n in names for p in PHRASES)]


# SPDX identifiers beside those in NAMES.
SPDX = {
    f"{short}-{v}": tuple(f"{short}-{v if '.' in v else v + '.0'}{end}" for end in ("", "-only", "-or-later"))
    for short, versions in (("GPL", ("2", "3")), ("LGPL", ("2", "2.1", "3")), ("AGPL", ("3",))) for v in versions
} | {"BSD-2-Clause": ("BSD-2-Clause",), "CC0-1.0": ("CC0-1.0",)}


def more_texts() -> list[tuple[str, str]]:
    """(license_id, text) beside the catalogue: whole texts under a title line, and SPDX lines."""
    titled = [(k, f"{the}{n}{short}\n{TEXTS[k]}") for k in ("MIT", "ISC", "BSD-2-Clause", "BSD-3-Clause") for n in NAMES[k]
              for the in ("", "The ") for short in ("", f" ({k})")]
    return [*titled, *((k, f"SPDX-License-Identifier: {n}") for k, names in SPDX.items() for n in names)]


def _lines(text: Column) -> Column:
    lowered = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.split(lowered, r"\n", -1)


def _canonical(line: Column) -> Column:
    hinted = line.rlike(HINT_PATTERN)
    for hint in HINTS:
        hinted = line.contains(hint) | hinted
    spelt = line
    for pattern, to in EQUIVALENT:
        spelt = F.regexp_replace(spelt, pattern, to)
    return F.btrim(F.regexp_replace(F.when(hinted, spelt).otherwise(line), r"[^\p{L}\p{N}]+", " "))


def canonical_lines(text: Column) -> Column:
    """Canonical lines without copyright lines and empty ones."""
    def one(line: Column) -> Column:
        return F.when(line.rlike(COPYRIGHT_LINE), F.lit("")).otherwise(_canonical(line))
    return F.transform(_lines(text), one)


def digest(canonical: Column) -> Column:
    return F.sha2(F.encode(canonical, "UTF-8"), 256)


def _whole(lines: Column) -> Column:
    return F.array_join(F.filter(lines, lambda x: x != ""), " ")


def known_digests(spark, texts: list[tuple[str, str]] | None = None) -> DataFrame:
    """(digest, license_id) of ``texts``, or of all that is known; equal digests keep the first id."""
    rows = spark.createDataFrame([*catalogue(), *more_texts()] if texts is None else texts, "license_id string, text string")
    rows = rows.select("license_id", C.bind(canonical_lines(F.col("text")), _whole).alias("c")).filter("c <> ''")
    rows = rows.select(digest(F.col("c")).alias("digest"), "license_id")
    if texts is None:
        published = [(d, k) for k, ds in DIGESTS.items() for d in ds]
        rows = rows.unionByName(spark.createDataFrame(published, "digest string, license_id string"))
    return rows.groupBy("digest").agg(F.min("license_id").alias("license_id"))


def scan(docs: DataFrame, known: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per match: doc_id, kind (text or notice), line (from 0; null for a whole text), digest, license_id."""
    lines = F.col("lines")
    rows = docs.select(F.col(doc_id).alias("doc_id"), C.bind(canonical_lines(F.col(text)), lambda ls: F.concat(
        F.array(F.struct(F.lit(None).cast("int").alias("line"), digest(_whole(ls)).alias("digest"))),
        F.filter(F.transform(ls, lambda x, i: F.struct(i.alias("line"), F.when(x != "", digest(x)).alias("digest"))),
                 lambda x: x["digest"].isNotNull()))).alias("lines"))
    units = rows.select("doc_id", F.explode(lines).alias("u")).select("doc_id", "u.line", "u.digest")
    known = C.cut_lineage(known)
    known = F.broadcast(known) if known.count() <= SMALL_CATALOGUE else known
    return units.join(known, "digest").select(
        "doc_id", F.when(F.col("line").isNull(), "text").otherwise("notice").alias("kind"), "line", "digest", "license_id")


def op1_licenses(spark, sf_dir: str) -> DataFrame:
    """Every document's whole text and lines against the known licenses; one row per match."""
    return scan(C.read(spark, sf_dir, "documents"), known_digests(spark))


def _sql(text: str) -> str:
    line = "l"
    for pattern, to in EQUIVALENT:
        line = f"regexp_replace({line}, '{pattern}', '{to.replace('$', chr(92))}', 'g')"
    lowered = f"translate(coalesce({text}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return (rf"list_transform(string_split({lowered}, chr(10)), lambda l: CASE WHEN regexp_matches(l, '{COPYRIGHT_LINE}')"
            rf" THEN '' ELSE trim(regexp_replace({line}, '[^\p{{L}}\p{{N}}]+', ' ', 'g')) END)")


_VALUES = ",\n".join("('{}', '{}')".format(k, t.replace("'", "''")) for k, t in catalogue())
OP1_SQL = f"""
WITH k(license_id, text) AS (VALUES {_VALUES}),
kd AS (SELECT digest, min(license_id) AS license_id FROM (
    SELECT license_id, sha256(array_to_string(list_filter({_sql('text')}, lambda x: x <> ''), ' ')) AS digest FROM k)
    GROUP BY digest),
d AS (SELECT doc_id, {_sql('text')} AS ls FROM documents),
u AS (SELECT doc_id, NULL::INTEGER AS line, array_to_string(list_filter(ls, lambda x: x <> ''), ' ') AS c FROM d
      UNION ALL SELECT doc_id, i::INTEGER, ls[i + 1] FROM (SELECT doc_id, ls, unnest(range(len(ls))) AS i FROM d))
SELECT doc_id, CASE WHEN line IS NULL THEN 'text' ELSE 'notice' END AS kind, line, digest, license_id
FROM (SELECT doc_id, line, sha256(c) AS digest FROM u WHERE c <> '') JOIN kd USING (digest)
"""
