"""Column shaping, cleaning and row filters.

Data-dependent column decisions (numeric cast, boolean-like, dates,
constant / high-null / high-cardinality / duplicate columns) all come from
one profile aggregate; only per-column numbers (bounded by the column count)
reach the driver, then a single literal ``select`` applies them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlens.functions import exprs as X
from cohortlens.functions import tokens as TK


def _is_numeric(df: DataFrame, c: str) -> bool:
    return isinstance(df.schema[c].dataType, (T.NumericType, T.BooleanType))


def _is_string(df: DataFrame, c: str) -> bool:
    return isinstance(df.schema[c].dataType, T.StringType)


# ---------------------------------------------------------------- names ----

def snake_columns(df: DataFrame) -> DataFrame:
    """Snake-case every column name."""
    return df.toDF(*[X.snake(c) for c in df.columns])


def pick_first(df: DataFrame, candidates: Sequence[str]) -> Column:
    """The first candidate column that exists, else a NULL literal."""
    for c in candidates:
        if c in df.columns:
            return F.col(c)
    return F.lit(None)


def keep_columns(df: DataFrame, cols: Sequence[str], target: str | None = None) -> DataFrame:
    """Keep the listed columns that exist; the target goes last."""
    keep = [c for c in cols if c in df.columns and c != target]
    if target and target in df.columns:
        keep.append(target)
    return df.select(*keep)


def blind_features(df: DataFrame, features: Sequence[str], mode: str = "drop") -> DataFrame:
    """Drop the listed features, or mask them (typed NULL) with ``mode='mask'``."""
    feats = [X.snake(f) for f in features if str(f).strip()]
    present = [f for f in feats if f in df.columns]
    if mode == "mask":
        return df.withColumns({f: F.lit(None).cast(df.schema[f].dataType) for f in present})
    return df.drop(*present)


def enforce_schema(df: DataFrame, features: Sequence[str], drop: Sequence[str] = ("label", "domain"),
                   types: dict[str, str] | None = None) -> DataFrame:
    """Scoring schema — drop label/domain, add absent features as NULL, order as listed.
    Columns that are not features are kept after them (pass-through)."""
    types = types or {}
    base = df.drop(*[c for c in drop if c in df.columns])
    feats = [F.col(f) if f in base.columns else F.lit(None).cast(types.get(f, "string")).alias(f) for f in features]
    rest = [c for c in base.columns if c not in features]
    return base.select(*feats, *rest)


def normalize_inputs(df: DataFrame) -> DataFrame:
    """Gender -> sex, ethnicity / race synonyms, lower/trim, numeric features."""
    out = df
    if "sex" not in out.columns and "gender" in out.columns:
        out = out.withColumn("sex", F.col("gender"))
    if "ethnicity" in out.columns:
        s = X.norm_text("ethnicity")
        out = out.withColumn("ethnicity", F.when(s == "not hispanic", F.lit("not hispanic or latino"))
                             .when(s == "hispanic", F.lit("hispanic or latino")).otherwise(s))
    if "race" in out.columns:
        s = X.norm_text("race")
        out = out.withColumn("race", F.when(s == "black", F.lit("black or african american")).otherwise(s))
    if "sex" in out.columns:
        out = out.withColumn("sex", X.norm_text("sex"))
    for c in ("age_years", "height_last", "weight_last", "bmi_last"):
        if c in out.columns:
            out = out.withColumn(c, X.to_number(c))
    return out


def assume_non_smoker(df: DataFrame, col: str = "tobacco_smoking_status_any") -> DataFrame:
    """P25: missing smoker flag -> 0."""
    if col not in df.columns:
        return df
    return df.withColumn(col, F.coalesce(X.to_number(col), F.lit(0.0)))


# ------------------------------------------------------- value cleaning ----

def normalize_missing_tokens(df: DataFrame, target: str | None = None,
                             extra_tokens: Sequence[str] = ()) -> DataFrame:
    """Text columns — missing tokens (after lower/trim) -> NULL, other text unchanged."""
    toks = list(TK.MISSING_TOKENS) + [t.strip().lower() for t in extra_tokens if t.strip()]
    cols = {c: F.when(X.norm_text(c).isin(toks), F.lit(None).cast("string")).otherwise(F.col(c))
            for c in df.columns if c != target and _is_string(df, c)}
    return df.withColumns(cols) if cols else df


def clean_categories(df: DataFrame, cols: Sequence[str], tokens: Sequence[str] = TK.MISSING_TOKENS) -> DataFrame:
    """Trim + lower, tokens -> NULL."""
    return df.withColumns({c: X.token_to_null(c, tokens) for c in cols if c in df.columns})


def profile(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """One pass over the rows: per column n, n_null, distinct non-null count,
    numeric min / max, and the shares that drive the data-dependent steps
    (numeric parse, boolean-like map, timestamp parse).

    Distinct counts come from one stacked (column, value) aggregate, which
    Spark partially aggregates map-side; no per-column pass.
    """
    cols = list(cols or df.columns)
    aggs = [F.count(F.lit(1)).alias("_n")]
    for i, c in enumerate(cols):
        s = F.col(c).cast("string")
        aggs += [
            F.count(F.when(F.col(c).isNull(), 1)).alias(f"nul_{i}"),
            F.min(X.to_number(s)).alias(f"min_{i}"), F.max(X.to_number(s)).alias(f"max_{i}"),
            F.count(F.when(F.col(c).isNotNull() & X.to_number(s).isNull(), 1)).alias(f"bad_{i}"),
            F.count(X.bool_like(s)).alias(f"bool_{i}"),
            F.count(F.try_to_timestamp(s)).alias(f"ts_{i}"),
        ]
    wide = df.agg(*aggs)
    long = wide.select("_n", F.explode(F.array(*[F.struct(
        F.lit(c).alias("column"), F.lit(df.schema[c].dataType.simpleString()).alias("dtype"),
        F.col(f"nul_{i}").alias("n_null"), F.col(f"min_{i}").alias("min_value"),
        F.col(f"max_{i}").alias("max_value"), F.col(f"bad_{i}").alias("n_not_numeric"),
        F.col(f"bool_{i}").alias("n_bool_like"), F.col(f"ts_{i}").alias("n_timestamp"))
        for i, c in enumerate(cols)])).alias("p")).select("_n", "p.*")
    pairs = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("v"))
                                          for c in cols])).alias("e")).select("e.*").where(F.col("v").isNotNull())
    distinct = pairs.distinct().groupBy("column").agg(F.count(F.lit(1)).alias("n_distinct"))
    out = long.join(distinct, "column", "left")
    return out.select("column", "dtype", F.col("_n").cast("bigint").alias("n"), F.col("n_null").cast("bigint"),
                      (F.col("n_null") / F.col("_n")).alias("null_frac"),
                      F.coalesce("n_distinct", F.lit(0)).cast("bigint").alias("n_distinct"),
                      "min_value", "max_value", F.col("n_not_numeric").cast("bigint"),
                      (F.col("n_bool_like") / F.col("_n")).alias("bool_like_rate"),
                      (F.col("n_timestamp") / F.col("_n")).alias("timestamp_rate"))


def numeric_cast_columns(df: DataFrame, ignore: Sequence[str] = ()) -> DataFrame:
    """Cast a text column to double only if every non-NULL value parses."""
    cand = [c for c in df.columns if c not in ignore and _is_string(df, c)]
    if not cand:
        return df
    aggs = [F.count(F.when(F.col(c).isNotNull() & X.to_number(c).isNull(), 1)).alias(c) for c in cand]
    bad = df.agg(*aggs).first().asDict()
    return df.withColumns({c: X.to_number(c) for c in cand if bad[c] == 0})


def coerce_boolean_like(df: DataFrame, target: str | None = None, min_rate: float = 0.7) -> DataFrame:
    """Text columns where >= 70% of all rows map to a boolean token -> 1.0/0.0/NULL;
    boolean columns -> int."""
    out = df.withColumns({c: F.col(c).cast("int") for c in df.columns
                          if c != target and isinstance(df.schema[c].dataType, T.BooleanType)})
    cand = [c for c in out.columns if c != target and _is_string(out, c)]
    if not cand:
        return out
    rates = out.agg(*[F.avg(X.bool_like(c).isNotNull().cast("double")).alias(c) for c in cand]).first().asDict()
    return out.withColumns({c: X.bool_like(c) for c in cand if rates[c] is not None and rates[c] >= min_rate})


def days_since_epoch(df: DataFrame, target: str | None = None, explicit: Sequence[str] = (),
                     min_rate: float = 0.3) -> DataFrame:
    """Timestamp columns, explicit ones, and text columns named like
    date/time -> days since epoch (double) when at least 30% parse.
    Numeric columns are skipped (T6); unparseable values become NULL."""
    cand = []
    for c in list(explicit) + df.columns:
        if c == target or c in cand or c not in df.columns:
            continue
        dt = df.schema[c].dataType
        named = ("date" in c.lower()) or ("time" in c.lower())
        if isinstance(dt, (T.TimestampType, T.TimestampNTZType, T.DateType)) or \
                (isinstance(dt, T.StringType) and (named or c in explicit)):
            cand.append(c)
    if not cand:
        return df

    def ts(c):
        dt = df.schema[c].dataType
        return F.col(c).cast("timestamp") if not isinstance(dt, T.StringType) else F.try_to_timestamp(F.col(c))
    rates = df.agg(*[F.avg(ts(c).isNotNull().cast("double")).alias(c) for c in cand]).first().asDict()
    return df.withColumns({c: F.unix_micros(ts(c)) / F.lit(86400e6)
                           for c in cand if rates[c] is not None and rates[c] >= min_rate})


def ajcc_stage_ordinal(df: DataFrame, col: str = "last_ajcc_stage") -> DataFrame:
    """C11: AJCC stage -> ordinal ``<col>_ord``, source dropped."""
    if col not in df.columns:
        return df
    return df.withColumn(f"{col}_ord", X.ajcc_ordinal(col)).drop(col)


def add_age_from_days(df: DataFrame, source: str = "mean_age_at_dx", new: str | None = None,
                      negate: bool = False) -> DataFrame:
    """Days -> years (1 dp, half-even), source column replaced."""
    if source not in df.columns:
        return df
    new = new or f"{source}_years"
    return df.withColumn(new, X.days_to_years(source, negate=negate)).drop(source) if new != source else \
        df.withColumn(new, X.days_to_years(source, negate=negate))


# ------------------------------------------------------- column drops -----

def drop_id_like(df: DataFrame, target: str | None = None, explicit: Sequence[str] | None = None) -> DataFrame:
    """Drop *_id and named id columns (or an explicit list)."""
    if explicit is not None:
        return df.drop(*[c for c in explicit if c in df.columns and c != target])
    return df.drop(*[c for c in df.columns if c != target and (c.endswith("_id") or c in TK.ID_COLUMNS)])


def drop_leakage(df: DataFrame, target: str | None = None) -> DataFrame:
    """Drop the outcome-leakage columns."""
    return df.drop(*[c for c in TK.LEAKAGE_COLUMNS if c in df.columns and c != target])


def drop_target_related(df: DataFrame, target: str) -> DataFrame:
    """Drop features that trivially give a regression target
    (bmi <- weight/height, weight <- bmi, diagnosis age <- age)."""
    return df.drop(*[c for c in TK.TARGET_RELATED.get(target, ()) if c in df.columns])


def column_drop_report(df: DataFrame, target: str | None = None, null_threshold: float = 0.95,
                       max_unique: int = 500, protected: Sequence[str] = ()) -> DataFrame:
    """P18-P20 as a table: (column, reason) for constant, high-null and
    high-cardinality columns, from one profile pass."""
    prof = profile(df.drop(target) if target and target in df.columns else df)
    text = [c for c in df.columns if _is_string(df, c)]
    constant = (F.col("n_distinct") + F.when(F.col("n_null") > 0, 1).otherwise(0)) <= 1
    high_null = (F.col("null_frac") > F.lit(float(null_threshold))) & ~F.col("column").isin(list(protected) or [""])
    high_card = F.col("column").isin(text or [""]) & (F.col("n_distinct") > max_unique)
    return prof.select("column", F.explode(F.array(
        F.when(constant, F.lit("constant")), F.when(high_null, F.lit("high_null")),
        F.when(high_card, F.lit("high_cardinality")))).alias("reason")).where(F.col("reason").isNotNull())


def drop_constant(df: DataFrame, target: str | None = None) -> DataFrame:
    """Drop columns with at most one distinct value, NULL counted as a value."""
    rep = column_drop_report(df, target).where(F.col("reason") == "constant").collect()
    return df.drop(*[r["column"] for r in rep])


def drop_high_null(df: DataFrame, threshold: float = 0.95, protected: Sequence[str] = ()) -> DataFrame:
    """Drop columns whose NULL share is above the threshold."""
    fr = df.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in df.columns]).first().asDict()
    return df.drop(*[c for c, v in fr.items() if c not in protected and v is not None and v > threshold])


def drop_high_cardinality(df: DataFrame, target: str | None = None, max_unique: int = 500) -> DataFrame:
    """P20: drop text columns with more than ``max_unique`` distinct values, counted exactly: distinct
    (column, value) pairs are combined before the shuffle, and one count per column reaches the driver."""
    text = [c for c in df.columns if c != target and _is_string(df, c)]
    if not text:
        return df
    pairs = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).alias("v")) for c in text])).alias("e"))
    counts = pairs.select("e.*").where(F.col("v").isNotNull()).distinct().groupBy("c").count()
    return df.drop(*[r["c"] for r in counts.where(F.col("count") > max_unique).collect()])


def duplicate_columns(df: DataFrame, key: str | None = None) -> DataFrame:
    """(column, duplicate_of) for columns whose content and type equal an
    earlier column.  Candidates come from one aggregate of hash fingerprints
    (row-keyed when a key is given); candidates are then confirmed exactly,
    row by row, so a hash collision cannot drop a column."""
    cols = [c for c in df.columns if c != key]
    salt = [F.col(key)] if key else []
    fp = df.agg(*[F.sum(F.xxhash64(*salt, F.col(c)).cast("decimal(20,0)")).alias(c) for c in cols]).first().asDict()
    nn = df.agg(*[F.count(c).alias(c) for c in cols]).first().asDict()
    pairs = []
    for j, c in enumerate(cols):
        for p in cols[:j]:
            same_type = df.schema[c].dataType == df.schema[p].dataType
            if same_type and fp[c] == fp[p] and nn[c] == nn[p]:
                pairs.append((c, p))
    spark = df.sparkSession
    if not pairs:
        return spark.createDataFrame([], "column string, duplicate_of string")
    diff = df.agg(*[F.count(F.when(~F.col(c).eqNullSafe(F.col(p)), 1)).alias(f"{c}|{p}") for c, p in pairs]) \
        .first().asDict()
    seen, out = set(), []
    for c, p in pairs:
        if diff[f"{c}|{p}"] == 0 and c not in seen and p not in seen:
            out.append((c, p))
            seen.add(c)
    return spark.createDataFrame(out, "column string, duplicate_of string")


def drop_duplicate_columns(df: DataFrame, key: str | None = None) -> DataFrame:
    dups = [r["column"] for r in duplicate_columns(df, key).collect()]
    return df.drop(*dups)


def infer_columns(df: DataFrame, target: str | None = None, numeric_hint: Sequence[str] = (),
                  categorical_hint: Sequence[str] = ()) -> tuple[list[str], list[str]]:
    """Numeric / categorical split from the schema; hints win, leftovers are categorical."""
    num, cat = [], []
    for c in df.columns:
        if c == target:
            continue
        if c in numeric_hint:
            num.append(c)
        elif c in categorical_hint:
            cat.append(c)
        elif _is_numeric(df, c):
            num.append(c)
        else:
            cat.append(c)
    return num, cat


# --------------------------------------------------------------- filters ----

def filter_never(df: DataFrame, col: str) -> DataFrame:
    """keep "never diagnosed" rows (numeric 2 or text 2/no/never/'no (2)');
    no-op when the column is absent."""
    if col not in df.columns:
        return df
    return df.where((X.to_number(col) == 2) | X.norm_text(col).isin(list(TK.NEVER_TOKENS)))


def clean_binary_target(df: DataFrame, target: str) -> DataFrame:
    """target tokens -> 0/1 int, unmappable rows dropped."""
    return df.withColumn(target, X.binary_target(target)).where(F.col(target).isNotNull())


def clean_regression_target(df: DataFrame, target: str) -> DataFrame:
    """numeric target, unparseable rows dropped."""
    return df.withColumn(target, X.to_number(target)).where(F.col(target).isNotNull())


def regex_cohort(df: DataFrame, cols: Sequence[str], pattern: str = "colon|colorect") -> DataFrame:
    """keep rows where any listed text column matches (case-insensitive);
    unfiltered when no row matches (an existence probe that stops at the
    first matching row)."""
    cols = [c for c in cols if c in df.columns]
    if not cols:
        return df
    hit = None
    for c in cols:
        h = F.coalesce(F.lower(F.col(c).cast("string")).rlike(pattern), F.lit(False))
        hit = h if hit is None else (hit | h)
    any_hit = df.where(hit).limit(1).count() > 0     # stops at the first match
    return df.where(hit) if any_hit else df


def null_count(cols: Sequence[str]) -> Column:
    return sum((F.col(c).isNull().cast("int") for c in cols), F.lit(0))


def drop_rows_by_null_ratio(df: DataFrame, max_ratio: float, cols: Sequence[str] | None = None) -> DataFrame:
    """keep rows whose NULL share over the (remaining) columns is <= max_ratio."""
    cols = list(cols or df.columns)
    return df.where(null_count(cols) / F.lit(float(len(cols))) <= F.lit(float(max_ratio)))


def drop_rows_by_null_count(df: DataFrame, max_nulls: int, cols: Sequence[str] | None = None) -> DataFrame:
    """keep rows with at most ``max_nulls`` NULLs."""
    cols = list(cols or df.columns)
    return df.where(null_count(cols) <= max_nulls)


def complete_cases(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """rows with every protected column present."""
    return df.na.drop("any", subset=[c for c in cols if c in df.columns])


def clean_survey(df: DataFrame, *, col_null_threshold: float = 0.95, row_null_ratio: float | None = None,
                 row_null_max: int | None = None, drop_constants: bool = False, drop_ids: bool = True,
                 id_cols: Sequence[str] | None = None) -> DataFrame:
    """columns -> constants -> ids -> rows, in that order (the row rule
    counts over the columns that remain)."""
    out = drop_high_null(df, col_null_threshold)
    if drop_constants:
        out = drop_constant(out)
    if drop_ids:
        out = drop_id_like(out, explicit=id_cols)
    if row_null_ratio is not None:
        out = drop_rows_by_null_ratio(out, row_null_ratio)
    if row_null_max is not None:
        out = drop_rows_by_null_count(out, row_null_max)
    return out


def dedupe_rows(df: DataFrame, key: str | None = "case_key", target: str | None = None) -> DataFrame:
    """De-duplicate on (key, target) when the key exists, else on all
    columns.  With a subset the kept row is the smallest one per key (a
    deterministic choice, so a recomputed stage keeps the same row)."""
    if key and key in df.columns:
        subset = [key] + ([target] if target and target in df.columns else [])
        others = [c for c in df.columns if c not in subset]
        if not others:
            return df.dropDuplicates(subset)
        kept = df.groupBy(*subset).agg(F.min(F.struct(*others)).alias("_row"))
        return kept.select(*subset, "_row.*").select(*df.columns)
    return df.dropDuplicates()


def union_by_name(*dfs: DataFrame) -> DataFrame:
    """Union-all by name, missing columns -> NULL."""
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d, allowMissingColumns=True)
    return out


def cast_datetimes(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """P10: listed text columns -> timestamps (unparseable -> NULL)."""
    return df.withColumns({c: F.try_to_timestamp(F.col(c).cast("string")) for c in cols if c in df.columns})
