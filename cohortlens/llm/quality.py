"""Quality rules with adaptive thresholds.

Every text gets integer statistics (native array expressions, one pass, no
shuffle).  Each rule's rate is an integer per mille; its distribution per
(language, source) is a *log-linear sketch*: values below 64 are their own
bucket, larger ones keep their six leading bits, so a bucket's relative width
is at most 1/32.  A sketch is a table of bucket counts: it merges by adding
counts, which is a partially aggregated ``groupBy`` (a hot source is combined
before the shuffle) and is the same for every partitioning.  Fences are far
outliers of the group, ``q75 + spread * max(q75 - q25, slack)`` (and the lower
counterpart for word length), not a share of the rows: a group without
outliers loses nothing.  Groups with under ``min_group`` documents use the
sketch merged over their language, and those the one over everything.  A source
with much junk has wide quartiles: its fence is held to its language's (and that to
the one over everything), or, where the source's better quarter lies
beyond, to that quarter and the language's reach.

Edge cases: null, empty and blank texts have no words and fail the base rule;
null languages and sources are groups of their own; repeated rows are judged
one by one, alike; an empty table gives an empty result; other columns are
carried untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cohortlens.llm import common as C

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MIN_GROUP = 200
SPREAD = 4
SMALL_TABLE = 20_000    # groups up to which the fences are broadcast; more are joined by shuffle
#: rule -> least distance (in the rule's units) that counts as the middle half's width
SLACK = {"symbol_rate": 10, "upper_rate": 20, "mark_rate": 15, "dup_line_rate": 125, "repeat_rate": 80, "word_len": 60}
LOWER = ("word_len",)   # rules that also have a lower fence


def _repeat_words(ws: Column) -> Column:
    """Words inside 3-word windows that occur at least twice in the text."""
    windows = F.transform(F.sequence(F.lit(0), F.size(ws) - 3),
                          lambda i: F.struct(F.concat_ws(" ", ws[i], ws[i + 1], ws[i + 2]).alias("w"), i.alias("i")))
    starts = C.bind(F.sort_array(windows), lambda s: F.transform(
        F.filter(s, lambda x, k: ((k > 0) & (F.get(s, k - 1)["w"] == x["w"]))
                 | ((k < F.size(s) - 1) & (F.get(s, k + 1)["w"] == x["w"]))), lambda x: x["i"]))
    covered = F.aggregate(
        F.sort_array(starts), F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n")),
        lambda acc, i: F.struct(i.alias("last"), (acc["n"] + F.least(F.lit(3), i - acc["last"])).alias("n")))["n"]
    return F.when(F.size(ws) >= 3, covered).otherwise(F.lit(0))


def statistics(text: Column) -> Column:
    """One struct of integer statistics of a text."""
    t = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(t, "\n", -1), lambda x: F.btrim(x, F.lit(C.WHITE)) != "")

    def made(ws: Column) -> Column:
        return F.struct(
            F.size(ws).cast("long").alias("n_words"),
            F.length(F.translate(t, C.WHITE, "")).cast("long").alias("word_chars"),
            (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
            C.bind(lines, lambda ls: F.struct(
                F.size(ls).cast("long").alias("n"),
                (F.size(ls) - F.size(F.array_distinct(ls))).cast("long").alias("dup"))).alias("lines"),
            _repeat_words(ws).cast("long").alias("n_repeat_words"),
            (F.length(t) - F.length(F.translate(t, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))).cast("long").alias("n_upper"),
            (F.length(t) - F.length(F.translate(t, "!?=_~^+@\\/{}[]", ""))).cast("long").alias("n_marks"))

    return C.bind(C.words(text), made)


def rates(s: Column) -> dict[str, Column]:
    """The rules' integer rates from a statistics struct; null where there are no words."""
    def per(num: Column, den: Column, scale: int) -> Column:
        return F.when(den > 0, F.floor(num * scale / den).cast("long"))
    return {
        "symbol_rate": per(s["n_symbols"], s["word_chars"], 1000),
        "upper_rate": per(s["n_upper"], s["word_chars"], 1000),
        "mark_rate": per(s["n_marks"], s["word_chars"], 1000),
        "dup_line_rate": per(s["lines"]["dup"], s["lines"]["n"], 1000),
        "repeat_rate": per(s["n_repeat_words"], s["n_words"], 1000),
        "word_len": per(s["word_chars"], s["n_words"], 100),
    }


def base_failed(s: Column) -> Column:
    return (s["n_words"] < MIN_WORDS) | (100 * s["n_repeat_words"] > 50 * s["n_words"])


def sketch(judged: DataFrame, group: tuple[str, ...], rule_cols: dict[str, Column]) -> DataFrame:
    """Mergeable sketches: (group..., rule, edge, n) over rows that have the rule's value."""
    stacked = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), C.leading_bits(v).alias("edge"))
                                  for r, v in rule_cols.items()])).alias("e")
    return (judged.select(*group, stacked).select(*group, "e.rule", "e.edge").filter("edge IS NOT NULL")
            .groupBy(*group, "rule", "edge").agg(F.count("*").alias("n")))


def merged(sk: DataFrame, group: tuple[str, ...]) -> DataFrame:
    """Merge sketches down to fewer group columns."""
    return sk.groupBy(*group, "rule", "edge").agg(F.sum("n").alias("n"))


def quartiles(sk: DataFrame, group: tuple[str, ...]) -> DataFrame:
    """(group..., rule, total, q25, q75): the buckets in which the ranks ceil(n/4) and ceil(3n/4) fall.

    A window holds one sketch: at most a few thousand buckets whatever the data.
    """
    w = Window.partitionBy(*group, "rule")
    run = sk.withColumn("upto", F.sum("n").over(w.orderBy("edge"))).withColumn("total", F.sum("n").over(w))
    return run.groupBy(*group, "rule").agg(
        F.max("total").alias("total"),
        F.min(F.when(F.col("upto") * 4 >= F.col("total"), F.col("edge"))).alias("q25"),
        F.min(F.when(F.col("upto") * 4 >= F.col("total") * 3, F.col("edge"))).alias("q75"))


def fences(judged: DataFrame, rule_cols: dict[str, Column], group: tuple[str, str],
           min_group: int = MIN_GROUP, spread: int = SPREAD) -> DataFrame:
    """One row per (language, source): a fence per rule, from the rows whose value is not null."""
    lang, source = group
    fine = sketch(judged, group, rule_cols)
    by_lang = merged(fine, (lang,))
    overall = merged(by_lang, ())
    wide = (quartiles(by_lang, (lang,)).withColumnsRenamed({"total": "lt", "q25": "l25", "q75": "l75"}))
    world = (quartiles(overall.withColumn("one", F.lit(1)), ("one",)).drop("one")
             .withColumnsRenamed({"total": "wt", "q25": "w25", "q75": "w75"}))
    t = quartiles(fine, group).join(wide, [lang, "rule"], "left").join(world, "rule", "left")

    slack = F.element_at(F.create_map(*[F.lit(x) for kv in SLACK.items() for x in kv]), F.col("rule")).cast("long")

    def top(q: Column) -> Column:
        # a bucket stands for values up to 1/32 above its edge
        return q + F.call_function("shiftright", q, F.lit(5))

    def bounds(a: str, b: str, wider: tuple[str, str] | None) -> Column:
        q25, q75 = F.col(a), F.col(b)
        reach = spread * F.greatest(q75 - q25, slack)
        low, high = q25 - reach, top(q75) + reach
        if wider:
            total, name = wider
            w = F.col(name)
            low = F.greatest(low, F.least(w["low"], q75 - w["reach"]))
            high = F.least(high, F.greatest(w["high"], top(q25) + w["reach"]))
            reach = F.least(reach, w["reach"])
        own = F.struct(low.alias("low"), high.alias("high"), reach.alias("reach"))
        return F.when(F.col(total) >= min_group, own).otherwise(w) if wider else own
    t = t.withColumn("wf", bounds("w25", "w75", None)).withColumn("lf", bounds("l25", "l75", ("lt", "wf")))
    t = t.withColumn("f", bounds("q25", "q75", ("total", "lf"))).select(lang, source, "rule", "f.low", "f.high")
    cols = [F.max(F.when(F.col("rule") == r, F.struct("low", "high"))).alias(r) for r in rule_cols]
    return t.groupBy(lang, source).agg(*cols)


def verdict(rule_cols: dict[str, Column], fence) -> Column:
    """Whether every rule lies within its fence (a rule without a fence holds)."""
    ok = F.lit(True)
    for r, v in rule_cols.items():
        ok = ok & F.coalesce(v <= fence(r)["high"], F.lit(True))
        if r in LOWER:
            ok = ok & F.coalesce(v >= fence(r)["low"], F.lit(True))
    return ok


def judge(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source",
          min_group: int = MIN_GROUP, spread: int = SPREAD, keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` (default: all) plus a struct ``quality``: statistics, base_failed, kept.

    The statistics (and the columns kept) are written once to the shared checkpoint
    folder; both the sketches and the filter read them from there.
    """
    keep = docs.columns if keep is None else keep
    st, gl, gs = C.own("stats", docs.columns), C.own("lang_key", docs.columns), C.own("source_key", docs.columns)
    rows = docs.select(*[F.col(c) for c in keep], C.key(F.col(lang)).alias(gl), C.key(F.col(source)).alias(gs),
                       statistics(F.col(text)).alias(st))
    rows = C.stored(rows, "quality")
    rule_cols = rates(F.col(st))
    passing = {r: F.when(~base_failed(F.col(st)), v) for r, v in rule_cols.items()}
    fence = fences(rows, passing, (gl, gs), min_group, spread)
    fv = C.own("fences", docs.columns)
    fence = C.cut_lineage(fence.select(gl, gs, F.struct(*rule_cols).alias(fv)))
    # a hot source is not shuffled to one task, and texts are not shuffled at all, while the groups are few
    fence = F.broadcast(fence) if fence.count() <= SMALL_TABLE else fence
    out = rows.join(fence, [gl, gs], "left")
    failed = base_failed(F.col(st))
    q = C.own("quality", docs.columns)
    return out.select(*[F.col(c) for c in keep], F.struct(
        F.col(st).alias("stats"), failed.alias("base_failed"),
        (~failed & verdict(rule_cols, lambda r: F.col(fv)[r])).alias("kept")).alias(q))


def keep_good(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source",
              **options) -> DataFrame:
    """The documents that pass every rule, with their own columns only.

    Verdicts are made on narrow rows; a rejected row is known by 128 bits of its
    id, text, language and source.  While the rejected ones are few (counted), they
    are broadcast, and texts are neither stored nor shuffled.
    """
    marks = [C.own(k, docs.columns) for k in ("mark_one", "mark_two")]
    parts = [C.key(F.col(doc_id)), C.key(F.col(lang)), C.key(F.col(source)), C.key(F.col(text))]
    marked = docs.withColumns({m: F.xxhash64(F.lit(k), *parts) for k, m in enumerate(marks)})
    judged = judge(marked, text, lang, source, keep=marks, **options)
    q = F.col(judged.columns[-1])
    rejected = judged.filter(~q["kept"]).select(*marks).distinct()
    return marked.join(C.small_set(rejected), marks, "left_anti").select(*docs.columns)


def op9_quality(spark, sf_dir: str) -> DataFrame:
    """The contract's statistics and verdict of every document."""
    judged = judge(C.read(spark, sf_dir, "documents"), keep=["doc_id"])
    s = F.col("quality")["stats"]
    return judged.select("doc_id", s["n_words"].alias("n_words"), s["word_chars"].alias("word_chars"),
                         s["n_symbols"].alias("n_symbols"), s["lines"]["dup"].alias("n_dup_lines"),
                         s["n_repeat_words"].alias("n_repeat_words"),
                         F.col("quality")["base_failed"].alias("base_failed"), F.col("quality")["kept"].alias("kept"))
