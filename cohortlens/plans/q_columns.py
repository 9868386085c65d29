"""Column-shaping, cleaning and filter queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortlens.functions import exprs as X
from cohortlens.functions import tokens as TK
from cohortlens.operators import canonical as C
from cohortlens.operators import clean as CL
from cohortlens.plans.catalog import register
from cohortlens.plans.standins import (CUSTOMER_SQL, ORDERS_SQL, SUPPLIER_SQL, customer_domain, orders_as_exposures,
                                       supplier_domain, table, with_sql)

_TOKENS_SQL = "(" + ", ".join(f"'{t}'" for t in TK.MISSING_TOKENS) + ")"
_TRUE_SQL = "(" + ", ".join(f"'{t}'" for t in TK.TRUE_TOKENS) + ")"
_FALSE_SQL = "(" + ", ".join(f"'{t}'" for t in TK.FALSE_TOKENS) + ")"


def _tok_null_sql(c: str) -> str:
    return f"CASE WHEN lower(trim({c})) IN {_TOKENS_SQL} THEN NULL ELSE lower(trim({c})) END"


@register("snake_columns", """
SELECT c_custkey AS cust_key, c_name AS name_full, c_acctbal AS acct_bal_, c_mktsegment AS market_segment
FROM customer""", doubles=["acct_bal_"])
def q_snake_columns(spark, sf):
    """Column names normalised to snake case."""
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("Cust Key"), F.col("c_name").alias("Name/Full"),
                                            F.col("c_acctbal").alias("Acct-Bal."),
                                            F.col("c_mktsegment").alias(" Market Segment "))
    return CL.snake_columns(c)


@register("numeric_coerce", """
SELECT event_id, CAST(regexp_extract(props, '(\\d+)', 1) AS DOUBLE) AS k_text,
       CASE WHEN event_type = 'error' THEN 'n/a' ELSE regexp_extract(props, '(\\d+)', 1) END AS value_text,
       TRY_CAST(CASE WHEN event_type = 'error' THEN 'n/a' ELSE regexp_extract(props, '(\\d+)', 1) END AS DOUBLE) AS value_num
FROM events""", doubles=["k_text", "value_num"])
def q_numeric_coerce(spark, sf):
    """P8 + P9: all-or-nothing column cast (k_text casts, value_text does not) and value-level cast."""
    ev = table(spark, sf, "events")
    k = F.regexp_extract("props", r"(\d+)", 1)
    frame = ev.select("event_id", k.alias("k_text"),
                      F.when(F.col("event_type") == "error", F.lit("n/a")).otherwise(k).alias("value_text"))
    out = CL.numeric_cast_columns(frame, ignore=["event_id"])
    return out.withColumn("value_num", X.to_number("value_text"))


@register("token_to_null", with_sql(CUSTOMER_SQL) + f"""
SELECT entity_id, {_tok_null_sql('segment')} AS segment FROM cu""")
def q_token_to_null(spark, sf):
    """Trim, lower, the 12 missing tokens -> NULL."""
    return CL.clean_categories(customer_domain(spark, sf).select("entity_id", "segment"), ["segment"])


def _flags(spark, sf):
    o = table(spark, sf, "orders")
    a = F.when(F.col("o_orderstatus") == "F", F.lit("Yes")).when(F.col("o_orderstatus") == "O", F.lit("no")) \
        .otherwise(F.lit("maybe"))
    b = F.when(F.col("o_orderpriority") == "1-URGENT", F.lit("TRUE")) \
        .when(F.col("o_orderpriority") == "2-HIGH", F.lit(" si")) \
        .when(F.col("o_orderpriority") == "3-MEDIUM", F.lit("N")) \
        .when(F.col("o_orderpriority") == "4-NOT SPECIFIED", F.lit("negative")).otherwise(F.lit("unclear"))
    return o.select("o_orderkey", a.alias("flag_a"), b.alias("flag_b"))


@register("boolean_like", f"""
SELECT o_orderkey,
       CASE WHEN o_orderstatus = 'F' THEN 'Yes' WHEN o_orderstatus = 'O' THEN 'no' ELSE 'maybe' END AS flag_a,
       CASE WHEN lower(trim(b)) IN {_TRUE_SQL} THEN 1.0 WHEN lower(trim(b)) IN {_FALSE_SQL} THEN 0.0 END AS flag_b
FROM (SELECT *, CASE o_orderpriority WHEN '1-URGENT' THEN 'TRUE' WHEN '2-HIGH' THEN ' si' WHEN '3-MEDIUM' THEN 'N'
                 WHEN '4-NOT SPECIFIED' THEN 'negative' ELSE 'unclear' END AS b FROM orders) o""", doubles=["flag_b"])
def q_boolean_like(spark, sf):
    """Text columns where >= 70% of rows are boolean tokens become 1/0 (flag_b); others stay (flag_a)."""
    return CL.coerce_boolean_like(_flags(spark, sf), target="o_orderkey")


@register("days_since_epoch", """
SELECT o_orderkey, epoch_us(o_orderdate) / 86400e6 AS o_orderdate,
       epoch_us(TRY_CAST(CASE WHEN o_orderpriority = '5-LOW' THEN 'not a date' ELSE CAST(o_orderdate AS VARCHAR) END
                AS TIMESTAMP)) / 86400e6 AS ship_time_text,
       o_totalprice AS time_total
FROM orders""", doubles=["o_orderdate", "ship_time_text", "time_total"])
def q_days_since_epoch(spark, sf):
    """Timestamp and date-named text columns -> days since epoch (>= 30% parse); numerics skipped."""
    o = table(spark, sf, "orders")
    txt = F.when(F.col("o_orderpriority") == "5-LOW", F.lit("not a date")).otherwise(F.col("o_orderdate").cast("string"))
    frame = o.select("o_orderkey", "o_orderdate", txt.alias("ship_time_text"), F.col("o_totalprice").alias("time_total"))
    return CL.days_since_epoch(frame, target="o_orderkey")


def _two_schemas(spark, sf):
    sup, cus = supplier_domain(spark, sf), customer_domain(spark, sf)
    types = {"entity_id": "bigint", "acctbal": "double", "nationkey": "double", "segment": "string"}
    a = C.canonicalize(sup, {"entity_id": F.col("entity_id"), "acctbal": F.col("acctbal"),
                             "nationkey": F.col("nationkey"), "segment": None}, types, F.lit(1), "supplier")
    b = C.canonicalize(cus, {"entity_id": F.col("entity_id"), "acctbal": F.col("acctbal"),
                             "nationkey": F.col("nationkey"), "segment": X.token_to_null("segment")},
                       types, F.lit(0), "customer")
    return a, b


_UNION_SQL = with_sql(SUPPLIER_SQL, CUSTOMER_SQL) + f"""
, canon AS (
  SELECT entity_id, acctbal, CAST(nationkey AS DOUBLE) AS nationkey, CAST(NULL AS VARCHAR) AS segment,
         1 AS label, 'supplier' AS domain FROM su
  UNION ALL
  SELECT entity_id, acctbal, CAST(nationkey AS DOUBLE), {_tok_null_sql('segment')}, 0, 'customer' FROM cu)
"""


@register("canonical_union", _UNION_SQL + "SELECT * FROM canon", doubles=["acctbal", "nationkey"])
def q_canonical_union(spark, sf):
    """Two differently shaped sources -> one canonical table (union by name)."""
    a, b = _two_schemas(spark, sf)
    return C.align_union(a, b)


@register("feature_blind_mask", _UNION_SQL + """
SELECT entity_id, CAST(NULL AS DOUBLE) AS acctbal, segment, label, domain FROM canon""", doubles=["acctbal"])
def q_feature_blind_mask(spark, sf):
    """Blind features in both domains — acctbal masked (NULL), nationkey dropped."""
    a, b = _two_schemas(spark, sf)
    masked = C.align_union(CL.blind_features(a, ["acctbal"], "mask"), CL.blind_features(b, ["acctbal"], "mask"))
    return CL.blind_features(masked, ["nationkey"], "drop")


_PROFILE_COLS = [("event_type", "string"), ("value", "double"), ("props", "string"), ("ts", "timestamp_ntz")]


def _profile_sql() -> str:
    parts = []
    for c, t in _PROFILE_COLS:
        s = f"CAST({c} AS VARCHAR)"
        num = f"TRY_CAST({s} AS DOUBLE)"
        boolean = f"(lower(trim({s})) IN {_TRUE_SQL} OR lower(trim({s})) IN {_FALSE_SQL})"
        parts.append(f"""SELECT '{c}' AS "column", '{t}' AS dtype, count(*) AS n,
  count(*) - count({c}) AS n_null, CAST(count(*) - count({c}) AS DOUBLE) / count(*) AS null_frac,
  count(DISTINCT {s}) AS n_distinct, min({num}) AS min_value, max({num}) AS max_value,
  count(CASE WHEN {c} IS NOT NULL AND {num} IS NULL THEN 1 END) AS n_not_numeric,
  CAST(count(CASE WHEN {boolean} THEN 1 END) AS DOUBLE) / count(*) AS bool_like_rate,
  CAST(count(TRY_CAST({s} AS TIMESTAMP)) AS DOUBLE) / count(*) AS timestamp_rate
FROM events""")
    return "\nUNION ALL\n".join(parts)


@register("profile_columns", _profile_sql(),
          doubles=["null_frac", "min_value", "max_value", "bool_like_rate", "timestamp_rate"])
def q_profile_columns(spark, sf):
    """One-pass profile feeding P8/P11/P12/P18-P20: nulls, distinct, numeric range, parse/map rates."""
    return CL.profile(table(spark, sf, "events"), [c for c, _ in _PROFILE_COLS])


_DUP_COLS = [("c_nationkey", "int"), ("nation_copy", "int"), ("c_acctbal", "double"), ("bal_copy", "double"),
             ("c_name", "string"), ("seg", "string"), ("seg_copy", "string")]


def _dup_frame_sql() -> str:
    return """dup AS (SELECT c_custkey, c_nationkey, c_nationkey AS nation_copy, c_acctbal, c_acctbal AS bal_copy,
                c_name, c_mktsegment AS seg, c_mktsegment AS seg_copy FROM customer)"""


def _dup_sql() -> str:
    parts = []
    for j, (c, t) in enumerate(_DUP_COLS):
        for p, tp in _DUP_COLS[:j]:
            if t == tp:
                parts.append(f"SELECT '{c}' AS \"column\", '{p}' AS duplicate_of, "
                             f"(SELECT count(*) FROM dup WHERE {c} IS DISTINCT FROM {p}) AS diff")
    return with_sql(_dup_frame_sql()) + ", pairs AS (" + " UNION ALL ".join(parts) + """)
SELECT "column", min(duplicate_of) AS duplicate_of FROM pairs WHERE diff = 0
  AND duplicate_of NOT IN (SELECT "column" FROM pairs WHERE diff = 0)
GROUP BY \"column\""""


@register("dedupe_columns_report", _dup_sql())
def q_dedupe_columns_report(spark, sf):
    """Columns equal in content and type to an earlier one (fingerprint screen, exact confirm)."""
    c = table(spark, sf, "customer")
    frame = c.select("c_custkey", "c_nationkey", F.col("c_nationkey").alias("nation_copy"), "c_acctbal",
                     F.col("c_acctbal").alias("bal_copy"), "c_name", F.col("c_mktsegment").alias("seg"),
                     F.col("c_mktsegment").alias("seg_copy"))
    return CL.duplicate_columns(frame, "c_custkey")


def _const_frame(spark, sf):
    o = table(spark, sf, "orders")
    return o.select(F.col("o_orderkey").cast("string").alias("order_text"), "o_orderstatus", "o_orderpriority",
                    F.lit("same").alias("const_col"), F.lit(None).cast("string").alias("null_col"),
                    F.when(F.col("o_orderpriority") == "1-URGENT", F.col("o_totalprice")).alias("sparse_price"))


@register("drop_constant_report", """
WITH f AS (SELECT CAST(o_orderkey AS VARCHAR) AS order_text, o_orderstatus, o_orderpriority, 'same' AS const_col,
                  CAST(NULL AS VARCHAR) AS null_col,
                  CASE WHEN o_orderpriority = '1-URGENT' THEN o_totalprice END AS sparse_price FROM orders),
s AS (
  SELECT 'order_text' AS "column", count(DISTINCT order_text) AS d, count(*) - count(order_text) AS nn, count(*) AS n, TRUE AS txt FROM f
  UNION ALL SELECT 'o_orderstatus', count(DISTINCT o_orderstatus), count(*) - count(o_orderstatus), count(*), TRUE FROM f
  UNION ALL SELECT 'o_orderpriority', count(DISTINCT o_orderpriority), count(*) - count(o_orderpriority), count(*), TRUE FROM f
  UNION ALL SELECT 'const_col', count(DISTINCT const_col), count(*) - count(const_col), count(*), TRUE FROM f
  UNION ALL SELECT 'null_col', count(DISTINCT null_col), count(*) - count(null_col), count(*), TRUE FROM f
  UNION ALL SELECT 'sparse_price', count(DISTINCT sparse_price), count(*) - count(sparse_price), count(*), FALSE FROM f)
SELECT "column", 'constant' AS reason FROM s WHERE d + CASE WHEN nn > 0 THEN 1 ELSE 0 END <= 1
UNION ALL SELECT "column", 'high_null' FROM s WHERE CAST(nn AS DOUBLE) / n > 0.75
UNION ALL SELECT "column", 'high_cardinality' FROM s WHERE txt AND d > 500""")
def q_drop_constant_report(spark, sf):
    """Constant, high-null (> .75) and high-cardinality (> 500) columns from one profile."""
    return CL.column_drop_report(_const_frame(spark, sf), null_threshold=0.75, max_unique=500)


# ---------------------------------------------------------------- filters --

def _flag_text():
    return (F.when(F.col("event_type") == "view", F.lit("2")).when(F.col("event_type") == "click", F.lit("No"))
            .when(F.col("event_type") == "error", F.lit(" never ")).when(F.col("event_type") == "signup", F.lit("yes"))
            .otherwise(F.lit("2.0")))


@register("never_flag_filter", """
SELECT event_id, flag FROM (
  SELECT event_id, CASE event_type WHEN 'view' THEN '2' WHEN 'click' THEN 'No' WHEN 'error' THEN ' never '
                   WHEN 'signup' THEN 'yes' ELSE '2.0' END AS flag FROM events) e
WHERE TRY_CAST(trim(flag) AS DOUBLE) = 2 OR lower(trim(flag)) IN ('2', 'no', 'never', 'no (2)')""")
def q_never_flag_filter(spark, sf):
    """keep 'never diagnosed' rows (numeric 2 or 2/no/never/'no (2)')."""
    ev = table(spark, sf, "events").select("event_id", _flag_text().alias("flag"))
    return CL.filter_never(ev, "flag")


@register("binary_target_clean", f"""
SELECT event_id, CAST(CASE WHEN lower(trim(t)) IN {_TRUE_SQL} THEN 1 WHEN lower(trim(t)) IN {_FALSE_SQL} THEN 0 END AS INTEGER) AS target
FROM (SELECT event_id, CASE event_type WHEN 'purchase' THEN 'Yes' WHEN 'view' THEN '0' WHEN 'click' THEN 'negativo'
                       WHEN 'error' THEN 'POS' ELSE 'false' END AS t FROM events) e
WHERE lower(trim(t)) IN {_TRUE_SQL} OR lower(trim(t)) IN {_FALSE_SQL}""")
def q_binary_target_clean(spark, sf):
    """EN/ES yes/no tokens -> 0/1, unmappable rows dropped."""
    t = (F.when(F.col("event_type") == "purchase", F.lit("Yes")).when(F.col("event_type") == "view", F.lit("0"))
         .when(F.col("event_type") == "click", F.lit("negativo")).when(F.col("event_type") == "error", F.lit("POS"))
         .otherwise(F.lit("false")))
    ev = table(spark, sf, "events").select("event_id", t.alias("target"))
    return CL.clean_binary_target(ev, "target")


@register("regex_cohort", """
SELECT p_partkey, p_name, p_type FROM part
WHERE regexp_matches(lower(p_name), 'ring|gear') OR regexp_matches(lower(p_type), 'ring|gear')""")
def q_regex_cohort(spark, sf):
    """regex cohort over two text columns (unfiltered if nothing matched)."""
    p = table(spark, sf, "part").select("p_partkey", "p_name", "p_type")
    return CL.regex_cohort(p, ["p_name", "p_type"], "ring|gear")


@register("row_null_ratio_filter", with_sql(ORDERS_SQL) + f"""
SELECT row_key, case_id, status, value, updated FROM (
  SELECT row_key, case_id, {_tok_null_sql('smoking_text')} AS status, value, updated FROM ox) t
WHERE ((CASE WHEN status IS NULL THEN 1 ELSE 0 END) + (CASE WHEN value IS NULL THEN 1 ELSE 0 END)
       + (CASE WHEN updated IS NULL THEN 1 ELSE 0 END)) / 3.0 <= 0.34""", doubles=["value"])
def q_row_null_ratio_filter(spark, sf):
    """drop rows whose NULL share over (status, value, updated) is above 0.34."""
    o = orders_as_exposures(spark, sf).select("row_key", "case_id", X.token_to_null("smoking_text").alias("status"),
                                               "value", "updated")
    return CL.drop_rows_by_null_ratio(o, 0.34, ["status", "value", "updated"])


@register("dedupe_rows", with_sql(ORDERS_SQL) + """
SELECT DISTINCT case_id AS case_key, smoking_text AS target FROM ox""")
def q_dedupe_rows(spark, sf):
    """De-duplicate on (case_key, target)."""
    o = orders_as_exposures(spark, sf).select(F.col("case_id").alias("case_key"),
                                               F.col("smoking_text").alias("target"), "row_key")
    return CL.dedupe_rows(o, "case_key", "target").select("case_key", "target")


@register("column_drops", """
SELECT o_totalprice, o_orderstatus, label FROM (
  SELECT o_totalprice, o_orderstatus, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS label FROM orders) t""",
          doubles=["o_totalprice"])
def q_column_drops(spark, sf):
    """P15 + P16: id-like columns (*_id, submitter ids, case key) and the outcome-leakage
    columns dropped; the target is never dropped."""
    o = table(spark, sf, "orders")
    st = F.col("o_orderstatus")
    frame = o.select(F.col("o_orderkey").alias("order_id"), F.col("o_custkey").cast("string").alias("submitter_id"),
                     F.col("o_orderkey").alias("case_key"), "o_totalprice", "o_orderstatus",
                     F.when(st == "F", F.lit("Dead")).otherwise(F.lit("Alive")).alias("dem_vital_status"),
                     (st == "P").cast("int").alias("any_progression"),
                     F.when(st == "F", F.lit(1)).otherwise(F.lit(0)).alias("label"))
    return CL.drop_leakage(CL.drop_id_like(frame, target="label"), target="label")
