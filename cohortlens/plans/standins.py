"""Cohorts re-expressed on the driver's tables (each with its SQL twin).

The operators are generic; these builders only map the benchmark tables onto
the shapes the operators expect:

* PU cohort: ``documents`` left join ``labels``; domain = labelled /
  unlabelled, label = quality else 0, features n_chars, lang, source, and a
  deterministic pseudo-score (integer arithmetic on an md5 draw, so every SQL
  engine reproduces it bit for bit).
* Entity roll-up: ``customer`` = case, ``orders`` = exposures / dated
  updates, ``lineitem`` = diagnoses / tests.
* Two schemas: ``supplier`` (label 1) and ``customer`` (label 0).
* Event cohort: ``events``; label = purchase, value numeric, props JSON.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.functions import exprs as X


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --------------------------------------------------------------- PU cohort --

def pu_cohort(spark: SparkSession, sf_dir: str, with_lines: bool = False) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    cols = ["doc_id", "n_chars", "lang", "source"] + (["text"] if with_lines else [])
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    j = docs.select(*cols).join(labels, "doc_id", "left")
    label = F.coalesce(F.col("quality"), F.lit(0)).cast("int")
    u = X.hash_u32(F.col("doc_id")) % 1000
    score = (u * 6 + label * 3000 + F.when(F.col("lang") == "en", 1000).otherwise(0)).cast("double") / 10000
    out = j.select("doc_id", F.col("n_chars").cast("double").alias("n_chars"), "lang", "source",
                   F.when(F.col("quality").isNotNull(), F.lit("labelled")).otherwise(F.lit("unlabelled"))
                   .alias("domain"), label.alias("label"), score.alias("score"),
                   *([(F.regexp_count(F.col("text"), F.lit("\n")) + 1).cast("double").alias("n_lines")]
                     if with_lines else []))
    return out


PU_SQL = """pu AS (
  SELECT d.doc_id, CAST(d.n_chars AS DOUBLE) AS n_chars, d.lang, d.source,
         CASE WHEN l.quality IS NOT NULL THEN 'labelled' ELSE 'unlabelled' END AS domain,
         CAST(COALESCE(l.quality, 0) AS INTEGER) AS label,
         CAST((('0x' || substr(md5(CAST(d.doc_id AS VARCHAR)), 1, 8))::BIGINT % 1000) * 6
              + COALESCE(l.quality, 0) * 3000
              + CASE WHEN d.lang = 'en' THEN 1000 ELSE 0 END AS DOUBLE) / 10000 AS score,
         CAST(len(string_split(d.text, chr(10))) AS DOUBLE) AS n_lines
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
)"""


# --------------------------------------------------------------- events ----

def event_cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("double")
    return ev.select("event_id", "ts", "user_id", "event_type", "value", "props",
                     (F.col("event_type") == "purchase").cast("int").alias("label"),
                     k.alias("k"))


EVENTS_SQL = """ev AS (
  SELECT event_id, ts, user_id, event_type, value, props,
         CAST(event_type = 'purchase' AS INTEGER) AS label,
         CAST(json_extract(props, '$.k') AS DOUBLE) AS k
  FROM events
)"""


# ------------------------------------------------------- entity roll-up ----

def orders_as_exposures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as dated case updates: status F -> 1, O -> 0, P -> unknown text;
    value NULL for 5-LOW priority; date NULL (undated) for 1-URGENT."""
    o = table(spark, sf_dir, "orders")
    status_text = F.when(F.col("o_orderstatus") == "F", F.lit("Current smoker")) \
        .when(F.col("o_orderstatus") == "O", F.lit("Lifelong non-smoker")).otherwise(F.lit("Not Reported"))
    return o.select(F.col("o_custkey").alias("case_id"), F.col("o_orderkey").alias("row_key"),
                    status_text.alias("smoking_text"),
                    F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_totalprice")).alias("value"),
                    F.when(F.col("o_orderpriority") != "1-URGENT", F.col("o_orderdate")).alias("updated"))


ORDERS_SQL = """ox AS (
  SELECT o_custkey AS case_id, o_orderkey AS row_key,
         CASE WHEN o_orderstatus = 'F' THEN 'Current smoker'
              WHEN o_orderstatus = 'O' THEN 'Lifelong non-smoker' ELSE 'Not Reported' END AS smoking_text,
         CASE WHEN o_orderpriority <> '5-LOW' THEN o_totalprice END AS value,
         CASE WHEN o_orderpriority <> '1-URGENT' THEN o_orderdate END AS updated
  FROM orders
)"""


# ------------------------------------------------------------ two schemas --

def supplier_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    return s.select(F.col("s_suppkey").alias("entity_id"), F.col("s_acctbal").alias("acctbal"),
                    F.col("s_nationkey").alias("nationkey"))


def customer_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customer with dirty segment text made by CASE (tokens, spacing, case)."""
    c = table(spark, sf_dir, "customer")
    seg = F.when(F.col("c_mktsegment") == "MACHINERY", F.lit(" Not Reported ")) \
        .when(F.col("c_mktsegment") == "HOUSEHOLD", F.lit("n/a")) \
        .otherwise(F.concat(F.lit(" "), F.col("c_mktsegment")))
    return c.select(F.col("c_custkey").alias("entity_id"), F.col("c_acctbal").alias("acctbal"),
                    F.col("c_nationkey").alias("nationkey"), seg.alias("segment"))


CUSTOMER_SQL = """cu AS (
  SELECT c_custkey AS entity_id, c_acctbal AS acctbal, c_nationkey AS nationkey,
         CASE WHEN c_mktsegment = 'MACHINERY' THEN ' Not Reported '
              WHEN c_mktsegment = 'HOUSEHOLD' THEN 'n/a' ELSE ' ' || c_mktsegment END AS segment
  FROM customer
)"""

SUPPLIER_SQL = """su AS (
  SELECT s_suppkey AS entity_id, s_acctbal AS acctbal, s_nationkey AS nationkey FROM supplier
)"""


def with_sql(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"
