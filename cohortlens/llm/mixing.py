"""Mixing sources to target weights.

Temperature mixing: a source with a share ``p`` of all tokens gets the weight
``p ** a / sum(p ** a)``.  The exponent is bisected to meet a target: the
largest one whose weights reach a wanted entropy (as a fraction of that of
equal weights), or the smallest one up to 1 whose most repeated source stays
within a limit of passes.  Weights become budgets of tokens, and budgets become block
permutations: a source whose budget is 2.3 times its tokens gives two whole
blocks, each all its documents once, and a third block cut to what is left, each
block in an order of its own (md5 of seed, block and doc_id).

A source is never sorted by one task: its documents fall into buckets by the
first bits of their order, as many as its share of the rows asks for, totals
per bucket place the buckets, and a window per bucket places the documents.

Edge cases: a null source is a source of its own; null and empty texts have no
tokens: they take no budget and lie in every whole block and where their order puts them
in a cut one; sources without any tokens have weight 0 and give no rows; a null
doc_id orders as an empty text; repeated rows are documents of their own; an
empty table gives no rows; other columns are carried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cohortlens.llm import common as C

SEED = "mix"
STEPS = 40      # bisection steps
WAYS = 5        # of them in one job
ENTROPY = 0.99
LIMIT = 4.0
TOP = 4.0       # largest exponent tried for an entropy
SMALL_PLAN = 20_000     # sources up to which their plan is broadcast; more are joined by shuffle


def _solve(shares: DataFrame, good, top: float, largest: bool) -> float:
    """Bisect the exponent in [0, top] by ``STEPS`` halvings, ``WAYS`` of them per job.

    ``shares``: (p); ``good(grid)``: from (a, p, w) rows per exponent a, a table (a, good).
    With ``largest`` the good exponents are the small ones, else the large ones.
    The result is on the good side if there is one.
    """
    lo, hi, parts = 0.0, top, 1 << WAYS
    for _ in range(STEPS // WAYS):
        width = (hi - lo) / parts
        grid = shares.select("p", F.explode(F.transform(F.sequence(F.lit(1), F.lit(parts - 1)),
                                                        lambda k: F.lit(lo) + k * F.lit(width))).alias("a"))
        marks = dict(good(grid).collect())      # one row per exponent tried
        ok = [marks.get(lo + k * width, False) for k in range(1, parts)]
        if largest:
            at = sum(ok)
        else:
            at = parts - 1 - sum(ok)
        lo, hi = lo + at * width, lo + (at + 1) * width
    return lo if largest else hi


def exponent(shares: DataFrame, passes: float, cover: bool, entropy: float | None, limit: float | None) -> float:
    """The exponent for shares (p): by entropy (fraction of log of the number of sources) or by a limit of passes.

    ``passes``: the budget in passes through all tokens; with ``cover`` it is that of one pass through the
    least favoured source.
    """
    if entropy is not None:
        n = shares.count()

        def good(grid: DataFrame) -> DataFrame:
            s = grid.groupBy("a").agg(F.sum(F.pow("p", "a")).alias("z"), F.sum(F.pow("p", "a") * F.log("p") * F.col("a")).alias("e"))
            return s.select("a", F.log("z") - F.col("e") / F.col("z") >= F.lit(entropy) * F.log(F.lit(float(n))))
        return _solve(shares, good, TOP, True)

    def good(grid: DataFrame) -> DataFrame:
        s = grid.groupBy("a").agg(F.sum(F.pow("p", "a")).alias("z"), F.max(F.pow("p", F.col("a") - 1)).alias("m"),
                                   F.min(F.pow("p", F.col("a") - 1)).alias("least"))
        most = F.col("m") / F.col("least") if cover else F.col("m") / F.col("z") * F.lit(passes)
        return s.select("a", most <= F.lit(limit))
    return _solve(shares, good, 1.0, False)


def weights(sized: DataFrame, source: Column, tokens: Column, budget: int | None = None, cover: bool = False,
            entropy: float | None = None, limit: float | None = None) -> DataFrame:
    """(source_key, tokens, rows, weight, budget) per source that has tokens.

    Without ``budget`` it is the number of all tokens; with ``cover`` it is then
    raised until no source falls short of one whole pass.
    """
    per = C.cut_lineage(sized.groupBy(C.key(source).alias("source_key"))
                        .agg(F.sum(tokens).alias("tokens"), F.count("*").alias("rows")).filter("tokens > 0"))
    total = per.agg(F.sum("tokens")).first()[0]
    if not total:
        return per.withColumns({"weight": F.lit(0.0), "budget": F.lit(0).cast("long")})
    shares = per.select((F.col("tokens") / F.lit(total)).alias("p"))
    a = exponent(shares, (budget or total) / total, cover, entropy, LIMIT if limit is None else limit)
    raw = F.pow(F.col("tokens") / F.lit(total), F.lit(a))
    z = per.agg(F.sum(raw)).first()[0]
    per = per.withColumn("weight", raw / F.lit(z))
    whole = budget or total
    if cover:
        # the budget at which the least favoured source is passed through once
        whole = per.agg(F.max(F.col("tokens") / F.col("weight"))).first()[0]
    return per.withColumn("budget", F.round(F.col("weight") * F.lit(float(whole))).cast("long"))


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: str = SEED,
        **target) -> DataFrame:
    """``docs`` plus a struct ``mixed`` (tokens, block, block_start), one row per use of a document."""
    names = docs.columns
    m = C.own("mixed", names)
    rows = docs.withColumn(m, F.struct(C.key(F.col(source)).alias("source_key"), C.n_words(F.col(text)).alias("tokens")))
    plan = weights(rows, F.col(source), F.col(m)["tokens"], **target)
    plan = C.cut_lineage(plan.select("source_key", "rows", F.expr("budget div tokens").alias("whole"),
                                     F.expr("budget % tokens").alias("rest")))
    n_rows, n_sources = plan.agg(F.coalesce(F.sum("rows"), F.lit(0)), F.count("*")).first()
    # about four buckets per shuffle partition over all sources, each a power of two for its order's first bits
    share = F.col("rows") * 4 * C.partitions(docs.sparkSession) / F.lit(max(n_rows, 1))
    plan = plan.withColumn("bits", F.least(F.ceil(F.log2(F.greatest(share, F.lit(1.0)))), F.lit(24)).cast("int"))
    pk = C.own("plan", names)
    plan = plan.select(F.col("source_key").alias(pk), F.struct("whole", "rest", "bits").alias(C.own("plan_of", names)))
    po = plan.columns[1]
    used = rows.join(F.broadcast(plan) if n_sources <= SMALL_PLAN else plan, F.col(m)["source_key"] == F.col(pk))
    b, o = C.own("block", names), C.own("order", names)
    used = used.withColumn(b, F.explode(F.sequence(F.lit(0).cast("long"), F.col(po)["whole"] - F.when(F.col(po)["rest"] > 0, 0).otherwise(1))))
    # a document longer than all that is left of a cut block has no place in its order
    used = used.filter((F.col(b) < F.col(po)["whole"]) | ((F.col(po)["rest"] > 0) & (F.col(m)["tokens"] <= F.col(po)["rest"])))
    ident = F.coalesce(F.col(doc_id).cast("string"), F.lit(""))
    used = used.withColumn(o, F.md5(F.encode(F.concat(F.lit(f"{seed}:"), F.col(b).cast("string"), F.lit(":"), ident), "UTF-8")))
    k = C.own("bucket", names)
    head = F.conv(F.substring(F.col(o), 1, 6), 16, 10).cast("long")
    used = used.withColumn(k, F.call_function("shiftright", head, 24 - F.col(po)["bits"]))
    per = used.groupBy(F.col(pk).alias("s"), F.col(b).alias("b"), F.col(k).alias("k")).agg(F.sum(F.col(m)["tokens"]).alias("t"))
    before = Window.partitionBy("s", "b").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select("s", "b", "k", F.coalesce(F.sum("t").over(before), F.lit(0)).alias("t0"))
    per = per.select(F.struct("s", "b", "k").alias(C.own("bucket_key", names)), F.col("t0").alias(C.own("bucket_start", names)))
    bk, t0 = per.columns
    inside = Window.partitionBy(pk, b, k).orderBy(o, F.col(m)["tokens"]).rowsBetween(Window.unboundedPreceding, -1)
    placed = used.withColumn(o, F.coalesce(F.sum(F.col(m)["tokens"]).over(inside), F.lit(0)))
    placed = placed.join(per, (F.col(bk)["s"] == F.col(pk)) & (F.col(bk)["b"] == F.col(b)) & (F.col(bk)["k"] == F.col(k)))
    start = F.col(t0) + F.col(o)
    fits = (F.col(b) < F.col(po)["whole"]) | (start + F.col(m)["tokens"] <= F.col(po)["rest"])
    return placed.filter(fits).select(*[F.col(c) for c in names], F.struct(
        F.col(m)["tokens"].alias("tokens"), F.col(b).alias("block"), start.cast("long").alias("block_start")).alias(m))


def mixed_rows(docs: DataFrame, **options) -> DataFrame:
    """The documents of the mixture, each as often as it is used, with their own columns only."""
    return mix(docs, **options).select(*docs.columns)


def op3_mixing(spark, sf_dir: str) -> DataFrame:
    """Every use of a document in the mixture whose weights have 0.99 of the largest entropy, over as many tokens."""
    docs = C.read(spark, sf_dir, "documents").select("doc_id", "source", "text")
    out = mix(docs, entropy=ENTROPY)
    return out.select("doc_id", "source", F.col("mixed.tokens").alias("n_tokens"), F.col("mixed.block").alias("block"),
                      F.col("mixed.block_start").alias("block_start"))


OP3_SQL = rf"""
WITH RECURSIVE d AS (SELECT doc_id, source, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'),
                            lambda x: x <> ''))::BIGINT AS n_tokens FROM documents),
s AS (SELECT source, sum(n_tokens)::BIGINT AS tokens FROM d GROUP BY source HAVING sum(n_tokens) > 0),
p AS (SELECT source, tokens, tokens / (SELECT sum(tokens) FROM s)::DOUBLE AS p FROM s),
bis(i, lo, hi) AS (
    SELECT 0, 0.0::DOUBLE, {TOP}::DOUBLE
    UNION ALL
    SELECT i + 1, CASE WHEN ok THEN mid ELSE lo END, CASE WHEN ok THEN hi ELSE mid END FROM (
        SELECT i, lo, hi, (lo + hi) / 2 AS mid,
               (SELECT ln(sum(pow(p, (b.lo + b.hi) / 2))) - sum(pow(p, (b.lo + b.hi) / 2) * ln(p) * ((b.lo + b.hi) / 2))
                       / sum(pow(p, (b.lo + b.hi) / 2)) >= {ENTROPY}::DOUBLE * ln(count(*)) FROM p) AS ok
        FROM bis b WHERE i < {STEPS})),
a AS (SELECT lo AS a FROM bis WHERE i = {STEPS}),
w AS (SELECT source, tokens, round(pow(p, a) / sum(pow(p, a)) OVER () * sum(tokens) OVER ())::BIGINT AS budget FROM p, a),
u AS (SELECT d.*, tokens, budget // tokens AS whole, budget % tokens AS rest,
             unnest(range(budget // tokens + CASE WHEN budget % tokens > 0 THEN 1 ELSE 0 END)) AS block
      FROM d JOIN w ON d.source IS NOT DISTINCT FROM w.source),
o AS (SELECT *, (coalesce(sum(n_tokens) OVER (PARTITION BY source, block
              ORDER BY md5('{SEED}:' || block || ':' || coalesce(doc_id::VARCHAR, '')), n_tokens
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS block_start
      FROM u WHERE block < whole OR n_tokens <= rest)
SELECT doc_id, source, n_tokens, block, block_start FROM o WHERE block < whole OR block_start + n_tokens <= rest
"""
