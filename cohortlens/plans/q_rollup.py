"""Roll-up, join, nested-record and loss-report queries."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlens.functions import exprs as X
from cohortlens.functions import tokens as TK
from cohortlens.operators import canonical as C
from cohortlens.operators import joins as J
from cohortlens.operators import risk as K
from cohortlens.operators import rollup as RU
from cohortlens.plans.catalog import register
from cohortlens.plans.q_columns import _UNION_SQL, _tok_null_sql, _two_schemas
from cohortlens.plans.standins import (CUSTOMER_SQL, ORDERS_SQL, SUPPLIER_SQL, customer_domain,
                                       orders_as_exposures, supplier_domain, table, with_sql)

_TOKENS_SQL = "(" + ", ".join(f"'{t}'" for t in TK.MISSING_TOKENS) + ")"


def _smoking_sql(c: str) -> str:
    s = f"lower(trim({c}))"
    # literal rules, not the tested module's lists
    denied = f"regexp_matches({s}, '\\bnever\\b|\\bnon[- ]?smok|^no$|\\bno smok|\\bnot (a )?(current |former |ever )?smok')"
    pos = f"contains({s}, 'current') OR contains({s}, 'former') OR contains({s}, 'ever') OR contains({s}, 'smok')"
    neg = f"contains({s}, 'no')"
    return (f"CASE WHEN {c} IS NULL THEN NULL WHEN {s} IN {_TOKENS_SQL} THEN NULL "
            f"WHEN {denied} THEN 0.0 WHEN {pos} THEN 1.0 WHEN {neg} THEN 0.0 END")


_ROLLUP_SQL = with_sql(ORDERS_SQL) + f"""
, ex AS (SELECT case_id, max({_smoking_sql('smoking_text')}) AS tobacco_smoking_status_any,
                max(value) AS pack_years_smoked_max FROM ox WHERE case_id IS NOT NULL GROUP BY case_id),
lk AS (SELECT case_id, value AS value_last FROM (
         SELECT case_id, value, row_number() OVER (PARTITION BY case_id
                ORDER BY (updated IS NULL) DESC, updated DESC, row_key DESC) AS rn
         FROM ox WHERE value IS NOT NULL AND case_id IS NOT NULL) t WHERE rn = 1)
"""


@register("any_flag_rollup", _ROLLUP_SQL + "SELECT * FROM ex",
          doubles=["tobacco_smoking_status_any", "pack_years_smoked_max"])
def q_any_flag_rollup(spark, sf):
    """A1: per case, any-positive status from free text (negatives tested first, T1) and max value."""
    return RU.exposure_rollup(orders_as_exposures(spark, sf), "case_id", "smoking_text", "value")


@register("last_known_value", _ROLLUP_SQL + "SELECT c.case_id, lk.value_last FROM (SELECT DISTINCT case_id FROM ox) c "
          "LEFT JOIN lk ON c.case_id = lk.case_id", doubles=["value_last"])
def q_last_known_value(spark, sf):
    """A2: last non-NULL value per case by date; undated rows win; ties by larger row key."""
    return RU.last_known(orders_as_exposures(spark, sf), "case_id", ["value"], "updated", tiebreak="row_key")


@register("median_age_rollup", """
SELECT l_orderkey AS case_id, median(round_even(l_extendedprice / 365.25 * 10, 0) / 10) AS age_dx_years
FROM lineitem GROUP BY l_orderkey""", doubles=["age_dx_years"])
def q_median_age_rollup(spark, sf):
    """A3: median of days/365.25 (1 dp, half-even) per case — lineitems play diagnoses."""
    li = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("case_id"), "l_extendedprice")
    return RU.median_age_rollup(li, "case_id", "l_extendedprice")


_KEYWORDS = ("the", "and", "que", "und", "les")


@register("keyword_flags_rollup", "SELECT conv_id, count(*) AS n_turns, " + ", ".join(
    f"max(CASE WHEN contains(lower(text), '{w}') THEN 1 ELSE 0 END) AS has_{w}" for w in _KEYWORDS) +
    " FROM conversations GROUP BY conv_id")
def q_keyword_flags_rollup(spark, sf):
    """Per conversation, turn count and any-flags for five keywords over whole texts."""
    conv = table(spark, sf, "conversations")
    return RU.keyword_flags(conv, "conv_id", "text", _KEYWORDS, count_name="n_turns")


@register("rollup_left_join", _ROLLUP_SQL + """
SELECT c.c_custkey AS case_id, c.c_name, ex.tobacco_smoking_status_any, ex.pack_years_smoked_max, lk.value_last
FROM customer c LEFT JOIN ex ON c.c_custkey = ex.case_id LEFT JOIN lk ON c.c_custkey = lk.case_id""",
          doubles=["tobacco_smoking_status_any", "pack_years_smoked_max", "value_last"])
def q_rollup_left_join(spark, sf):
    """Customers left-joined to pre-aggregated roll-ups (no fan-out)."""
    ox = orders_as_exposures(spark, sf)
    base = table(spark, sf, "customer").select(F.col("c_custkey").alias("case_id"), "c_name")
    return RU.attach(base, "case_id", RU.exposure_rollup(ox, "case_id", "smoking_text", "value"),
                     RU.last_known(ox, "case_id", ["value"], "updated", tiebreak="row_key"))


@register("key_merge_outer", """
SELECT COALESCE(c.key, s.key, o.key) AS key, c.bal, c.name, s.bal AS bal__1, s.name AS name__1, o.n_orders
FROM (SELECT c_custkey AS key, c_acctbal AS bal, c_name AS name FROM customer) c
FULL OUTER JOIN (SELECT s_suppkey AS key, s_acctbal AS bal, s_name AS name FROM supplier) s ON c.key = s.key
FULL OUTER JOIN (SELECT o_custkey AS key, count(*) AS n_orders FROM orders GROUP BY o_custkey) o
  ON COALESCE(c.key, s.key) = o.key""", doubles=["bal", "bal__1"])
def q_key_merge_outer(spark, sf):
    """3-way outer merge on a key; clashing right columns get ``__<i>``."""
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("bal"),
                                            F.col("c_name").alias("name"))
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_acctbal").alias("bal"),
                                            F.col("s_name").alias("name"))
    o = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("key")).agg(F.count(F.lit(1)).alias("n_orders"))
    return J.merge_on_keys([c, s, o], ["key"], "outer")


_CB_EDGES = tuple(range(0, 650, 50))
_CB_LABELS = tuple(f"{lo}-{lo + 49}" for lo in _CB_EDGES[:-1])


@register("complete_bins", """
WITH b AS (SELECT CASE """ + " ".join(f"WHEN value >= {lo} AND value < {hi} THEN '{lab}'" for lo, hi, lab in
                                      zip(_CB_EDGES[:-1], _CB_EDGES[1:], _CB_LABELS)) + """ END AS bin,
                  CAST(event_type = 'purchase' AS INTEGER) AS label FROM events),
c AS (SELECT bin, count(*) AS n, sum(label) AS n_pos FROM b WHERE bin IS NOT NULL GROUP BY bin),
dim AS (SELECT * FROM (VALUES """ + ", ".join(f"({i}, '{lab}')" for i, lab in enumerate(_CB_LABELS)) + """) v(bin_order, bin))
SELECT dim.bin, dim.bin_order, CAST(COALESCE(c.n, 0) AS BIGINT) AS n, CAST(COALESCE(c.n_pos, 0) AS BIGINT) AS n_pos,
       CAST(c.n_pos AS DOUBLE) / c.n AS pos_rate
FROM dim LEFT JOIN c ON dim.bin = c.bin""", doubles=["pos_rate"])
def q_complete_bins(spark, sf):
    """Value bins 0..600 by 50 — all 12 reported, empty ones with n = 0 and NULL rate."""
    ev = table(spark, sf, "events")
    b = ev.select(X.bin_expr(F.col("value"), _CB_EDGES, _CB_LABELS).alias("bin"),
                  (F.col("event_type") == "purchase").cast("int").alias("label")).where(F.col("bin").isNotNull())
    counts = b.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("n_pos"))
    dim = spark.createDataFrame(list(enumerate(_CB_LABELS)), "bin_order int, bin string")
    out = J.complete_bins(counts, dim, ["bin"], ["n", "n_pos"])
    return out.select("bin", "bin_order", "n", "n_pos", F.when(F.col("n") > 0, F.col("n_pos") / F.col("n"))
                      .alias("pos_rate"))


@register("missing_by_domain", _UNION_SQL + """
SELECT domain, feature, missing_pct, n FROM (
  SELECT domain, count(*) AS n,
         avg(CASE WHEN acctbal IS NULL OR isnan(acctbal) THEN 1.0 ELSE 0.0 END) AS acctbal,
         avg(CASE WHEN nationkey IS NULL OR isnan(nationkey) THEN 1.0 ELSE 0.0 END) AS nationkey,
         avg(CASE WHEN segment IS NULL THEN 1.0 ELSE 0.0 END) AS segment
  FROM canon GROUP BY domain) w
UNPIVOT (missing_pct FOR feature IN (acctbal, nationkey, segment))""", doubles=["missing_pct"])
def q_missing_by_domain(spark, sf):
    """Missing share per domain x feature on the canonical union."""
    a, b = _two_schemas(spark, sf)
    return K.missing_by_domain(C.align_union(a, b), ["acctbal", "nationkey", "segment"])


def _loss_sql(ds: str, raw: str, aligned: str, prot: list[str], checks: list[tuple[str, str | None, bool]]) -> str:
    complete = " AND ".join(f"{c} IS NOT NULL" for c in prot) or "TRUE"
    rows = [
        f"SELECT '{ds}' AS dataset, 'raw_load' AS stage, '' AS \"column\", n AS rows_total, n AS rows_after, 0 AS rows_lost, "
        f"NULL AS missing_count, NULL AS missing_pct, 'load_csv' AS reason, '' AS source_column FROM s",
        f"SELECT '{ds}', 'after_align_filter', '', n, a, n - a, NULL, NULL, 'align_and_reindex', '' FROM s",
        f"SELECT '{ds}', 'after_normalize_categories', '', a, a, 0, NULL, NULL, 'normalize_categories', '' FROM s",
        f"SELECT '{ds}', 'after_dropna_protected', '{','.join(prot)}', a, c, a - c, NULL, NULL, 'dropna_any_protected', '' FROM s",
        f"SELECT '{ds}', 'merge_audit', '', n, n, 0, NULL, NULL, 'no_merge_in_align', '' FROM s",
    ]
    for name, src, numeric in checks:
        if src is None:
            rows.append(f"SELECT '{ds}', 'null_analysis', '{name}', n, NULL, NULL, NULL, NULL, 'column_missing_in_source', '' FROM s")
        else:
            rows.append(f"SELECT '{ds}', 'null_analysis', '{name}', n, n - m_{name}, NULL, m_{name}, "
                        f"CASE WHEN n > 0 THEN CAST(m_{name} AS DOUBLE) / n ELSE 0.0 END, 'missing_or_token', '{src}' FROM s")
    miss = ", ".join(
        f"(SELECT count(*) FROM {raw} WHERE {src} IS NULL" +
        (f" OR isnan({src}))" if numeric else f" OR lower(trim({src})) IN {_TOKENS_SQL})") + f" AS m_{name}"
        for name, src, numeric in checks if src is not None)
    return (f"SELECT * FROM (WITH s AS (SELECT (SELECT count(*) FROM {raw}) AS n, (SELECT count(*) FROM {aligned}) AS a, "
            f"(SELECT count(*) FROM {aligned} WHERE {complete}) AS c, {miss}) " + " UNION ALL ".join(rows) + ")")


_LOSS_CHECKS = {"segment": ["segment"], "balance": ["acctbal"], "nation": ["nationkey"], "region": ["c_region"]}


@register("loss_report", with_sql(SUPPLIER_SQL, CUSTOMER_SQL) + f"""
, cua AS (SELECT entity_id, acctbal, nationkey, {_tok_null_sql('segment')} AS segment FROM cu)
""" + _loss_sql("customer", "cu", "cua", ["acctbal", "segment"],
                [("segment", "segment", False), ("balance", "acctbal", True), ("nation", "nationkey", True),
                 ("region", None, False)]) + "\nUNION ALL\n" +
    _loss_sql("supplier", "su", "su", ["acctbal"],
              [("segment", None, False), ("balance", "acctbal", True), ("nation", "nationkey", True),
               ("region", None, False)]), doubles=["missing_pct"])
def q_loss_report(spark, sf):
    """Data-loss report (5 stages + null analysis) for both source schemas."""
    cus, sup = customer_domain(spark, sf), supplier_domain(spark, sf)
    cua = cus.withColumn("segment", X.token_to_null("segment"))
    r1 = C.loss_report(cus, cua, "customer", ["acctbal", "segment"], _LOSS_CHECKS)
    r2 = C.loss_report(sup, sup, "supplier", ["acctbal"], _LOSS_CHECKS)
    return r1.unionByName(r2)


_MSG_SCHEMA = T.StructType([
    T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()),
    T.StructField("meta", T.StructType([T.StructField("role", T.StringType())])),
    T.StructField("lines", T.ArrayType(T.StructType([T.StructField("line_no", T.IntegerType()),
                                                     T.StructField("line", T.StringType())]))),
])


@register("flatten_nested", """
SELECT conv_id, turn, role, CAST(generate_subscripts(arr, 1) - 1 AS INTEGER) AS line_no, unnest(arr) AS line
FROM (SELECT conv_id, turn, role, string_split(text, chr(10)) AS arr FROM conversations) c""")
def q_flatten_nested(spark, sf):
    """Nested JSON records (message -> meta struct, lines array) parsed and flattened, keys first."""
    from cohortlens.sources import nested as N
    conv = table(spark, sf, "conversations")
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.struct(i.alias("line_no"), x.alias("line")))
    js = conv.select(F.to_json(F.struct("conv_id", "turn", F.struct("role").alias("meta"),
                                        lines.alias("lines"))).alias("value"))
    recs = N.parse_json_column(js, "value", _MSG_SCHEMA)
    return N.flatten_array(recs, ["conv_id", "turn", F.col("meta.role").alias("role")], "lines")


_TURN_SCHEMA = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()),
                             T.StructField("meta", T.StructType([T.StructField("role", T.StringType())])),
                             T.StructField("text", T.StringType())])


@register("concatenated_records", """
SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, role,
       md5(text || '} {"\\"' || role) AS text_md5 FROM conversations""")
def q_concatenated_records(spark, sf):
    """A file of objects back to back, with braces and quotes in their strings, split over tasks and parsed."""
    import uuid

    from cohortlens.session import checkpoint_dir
    from cohortlens.sources import nested as N
    conv = table(spark, sf, "conversations")
    tricky = F.concat("text", F.lit('} {"\\"'), "role")
    js = conv.select(F.to_json(F.struct("conv_id", "turn", F.struct("role").alias("meta"), tricky.alias("text"))).alias("value"))
    path = f"{checkpoint_dir(spark).rstrip('/')}/concatenated-{uuid.uuid4().hex}"
    js.write.option("lineSep", " ").text(path)      # one line a file
    recs = N.read_nested_json(spark, path, _TURN_SCHEMA, "concatenated")
    return recs.select("conv_id", "turn", F.col("meta.role").alias("role"), F.md5("text").alias("text_md5"))


@register("coerce_yes_no", """
SELECT o_orderkey, CASE WHEN lower(trim(t)) IN ('yes', 'true') THEN '1' WHEN lower(trim(t)) IN ('no', 'false') THEN '0'
                        ELSE t END AS value
FROM (SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN ' Yes' WHEN o_orderstatus = 'P' THEN NULL
                              WHEN o_orderpriority = '5-LOW' THEN 'FALSE' ELSE o_orderpriority END AS t FROM orders) x""")
def q_coerce_yes_no(spark, sf):
    """Yes / true and no / false become 1 and 0, other text stays."""
    from cohortlens.sources import nested as N
    t = F.when(F.col("o_orderstatus") == "F", " Yes").when(F.col("o_orderstatus") != "P", F.when(
        F.col("o_orderpriority") == "5-LOW", "FALSE").otherwise(F.col("o_orderpriority")))
    return table(spark, sf, "orders").select("o_orderkey", N.coerce_yes_no(t).alias("value"))


_CASE_SCHEMA = """submitter_id string, case_id long, acctbal double,
  demographic struct<gender:string, segment:string>, project struct<project_id:string>,
  exposures array<struct<exposure_id:long, price:double>>,
  family_histories array<struct<relative:string>>,
  diagnoses array<struct<diagnosis_id:long, priority:string, treatments:array<struct<kind:string>>,
                         pathology_details:array<struct<flag:string>>>>,
  follow_ups array<struct<follow_up_id:long, status:string, molecular_tests:array<struct<quantity:double>>,
                          other_clinical_attributes:array<struct<day:string>>>>"""


@register("flatten_cases", """
WITH o AS (SELECT * FROM orders), l AS (SELECT l_orderkey, count(*) AS n, sum(l_quantity) AS q FROM lineitem GROUP BY l_orderkey)
SELECT 'cases' AS relation, count(*) AS n, count(DISTINCT c_custkey) AS n_cases, round(sum(c_acctbal), 2) AS total FROM customer
UNION ALL SELECT 'exposures', count(*), count(DISTINCT o_custkey), round(sum(o_totalprice), 2) FROM o
UNION ALL SELECT 'family_histories', count(*), count(*), NULL FROM customer
UNION ALL SELECT 'diagnoses', count(*), count(DISTINCT o_custkey), sum(o_orderkey) FROM o
UNION ALL SELECT 'treatments', sum(n), count(DISTINCT o_custkey), sum(o_orderkey * n) FROM o JOIN l ON l_orderkey = o_orderkey
UNION ALL SELECT 'pathology_details', count(*), count(DISTINCT o_custkey), sum(o_orderkey) FROM o
UNION ALL SELECT 'follow_ups', count(*), count(DISTINCT o_custkey), sum(o_orderkey) FROM o
UNION ALL SELECT 'molecular_tests', sum(n), count(DISTINCT o_custkey), sum(q) FROM o JOIN l ON l_orderkey = o_orderkey
UNION ALL SELECT 'other_clinical_attributes', count(*), count(DISTINCT o_custkey), sum(o_orderkey) FROM o""", doubles=["total"])
def q_flatten_cases(spark, sf):
    """Nested case records (customers, orders, line items) flattened into all nine relations: rows, cases and a sum of each."""
    import uuid
    from functools import reduce

    from cohortlens.session import checkpoint_dir
    from cohortlens.sources import nested as N
    li = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct("l_returnflag", "l_quantity")).alias("items"))
    o = table(spark, sf, "orders").join(li, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    per = o.groupBy("o_custkey").agg(F.collect_list(F.struct(
        "o_orderkey", "o_totalprice", "o_orderpriority", "o_orderstatus", "o_orderdate", "items")).alias("os"))
    c = table(spark, sf, "customer").join(per, F.col("o_custkey") == F.col("c_custkey"), "left")
    case = F.struct(
        F.col("c_name").alias("submitter_id"), F.col("c_custkey").alias("case_id"), F.col("c_acctbal").alias("acctbal"),
        F.struct(F.lit("x").alias("gender"), F.col("c_mktsegment").alias("segment")).alias("demographic"),
        F.struct(F.lit("p").alias("project_id")).alias("project"),
        F.transform("os", lambda x: F.struct(x["o_orderkey"].alias("exposure_id"), x["o_totalprice"].alias("price"))).alias("exposures"),
        F.array(F.struct(F.lit("parent").alias("relative"))).alias("family_histories"),
        F.transform("os", lambda x: F.struct(
            x["o_orderkey"].alias("diagnosis_id"), x["o_orderpriority"].alias("priority"),
            F.transform(x["items"], lambda i: F.struct(i["l_returnflag"].alias("kind"))).alias("treatments"),
            F.array(F.struct(x["o_orderstatus"].alias("flag"))).alias("pathology_details"))).alias("diagnoses"),
        F.transform("os", lambda x: F.struct(
            x["o_orderkey"].alias("follow_up_id"), x["o_orderstatus"].alias("status"),
            F.transform(x["items"], lambda i: F.struct(i["l_quantity"].alias("quantity"))).alias("molecular_tests"),
            F.array(F.struct(x["o_orderdate"].cast("string").alias("day"))).alias("other_clinical_attributes"))).alias("follow_ups"))
    records = N.parse_json_column(c.select(F.to_json(case).alias("value")), "value", T._parse_datatype_string(_CASE_SCHEMA))
    # nine relations read the records: joined, written and parsed once
    path = f"{checkpoint_dir(spark).rstrip('/')}/cases-{uuid.uuid4().hex}"
    records.write.parquet(path)
    relations = N.flatten_cases(spark.read.schema(records.schema).parquet(path))
    totals = {"cases": "acctbal", "exposures": "price", "family_histories": None, "diagnoses": "diagnosis_id",
              "treatments": "diagnosis_id", "pathology_details": "diagnosis_id", "follow_ups": "follow_up_id",
              "molecular_tests": "quantity", "other_clinical_attributes": "follow_up_id"}
    parts = [relations[name].agg(F.lit(name).alias("relation"), F.count(F.lit(1)).alias("n"), F.countDistinct("case_id").alias("n_cases"),
                                 (F.round(F.sum(F.col(t).cast("double")), 2) if t else F.lit(None).cast("double")).alias("total"))
             for name, t in totals.items()]
    return reduce(lambda a, b: a.unionByName(b), parts)


@register("append_rows", """
SELECT DISTINCT o_orderkey, o_custkey, o_totalprice, priority FROM (
  SELECT o_orderkey, o_custkey, o_totalprice, NULL AS priority FROM orders WHERE o_orderstatus = 'F'
  UNION ALL SELECT o_orderkey, o_custkey, o_totalprice, nullif(o_orderpriority, '5-LOW') FROM orders) x""",
          doubles=["o_totalprice"])
def q_append_rows(spark, sf):
    """Finished orders, then all orders with one more column, appended to a table; repeated rows are added once."""
    import uuid

    from cohortlens.session import checkpoint_dir
    from cohortlens.sources import rowstore as RS
    root = f"{checkpoint_dir(spark).rstrip('/')}/rows-{uuid.uuid4().hex}"
    o = table(spark, sf, "orders")
    cols = ["o_orderkey", "o_custkey", "o_totalprice"]
    RS.append_rows(spark, root, o.where("o_orderstatus = 'F'").select(*cols), parts=16)
    RS.append_rows(spark, root, o.select(*cols, F.nullif(F.col("o_orderpriority"), F.lit("5-LOW")).alias("priority")))
    RS.append_rows(spark, root, o.select(*reversed(cols)).where("o_orderstatus = 'F'"))
    return RS.read_rows(spark, root)


_TRIAGE_KEEP = ("c_acctbal", "O_TOTALPRICE", "l_quantity", "value", "quality", "n_chars", "age_years")
_ALL_TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
               "benchmark labels conversations").split()


def _triage_sql() -> str:
    parts = []
    keep = {c.lower() for c in _TRIAGE_KEEP}
    cols = _TABLE_COLUMNS
    for t in _ALL_TABLES:
        matched = sorted(c for c in cols[t] if c.lower() in keep)
        kept = "TRUE" if matched else "FALSE"
        reason = "has_useful_columns" if matched else "no_useful_columns"
        parts.append(f"SELECT 'testdata' AS dataset, '{t}' AS \"table\", count(*) AS \"rows\", "
                     f"count(*) > 0 AND {kept} AS kept, '{','.join(matched)}' AS matched_columns, "
                     f"CASE WHEN count(*) = 0 THEN 'empty_table' ELSE '{reason}' END AS reason FROM {t}")
    return "\nUNION ALL\n".join(parts)


# column lists of the benchmark tables (schema, not data)
_TABLE_COLUMNS = {
    "region": ["r_regionkey", "r_name"], "nation": ["n_nationkey", "n_name", "n_regionkey"],
    "customer": ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"],
    "supplier": ["s_suppkey", "s_name", "s_nationkey", "s_acctbal"],
    "part": ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"],
    "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"],
    "lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
                 "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"],
    "events": ["event_id", "ts", "user_id", "event_type", "value", "props"],
    "documents": ["doc_id", "text", "lang", "source", "n_chars"],
    "embeddings": ["vec_id", "embedding", "label"], "pages": ["page_id", "url", "html"],
    "benchmark": ["item_id", "text"], "labels": ["doc_id", "quality", "toxic"],
    "conversations": ["conv_id", "turn", "role", "text"],
}


@register("table_triage_report", _triage_sql())
def q_table_triage_report(spark, sf):
    """Which tables hold useful columns (case-insensitive), with row counts and reasons."""
    from cohortlens.sources import nested as N
    tables = {t: table(spark, sf, t) for t in _ALL_TABLES}
    return N.triage_report(tables, _TRIAGE_KEEP, dataset="testdata")
