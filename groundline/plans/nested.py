"""Queries with correlated subqueries, and nested records under seals."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from groundline.operators.canonical import SEAL, canonical_json, read_sealed, seal, write_sealed
from groundline.plans.registry import query
from groundline.sources.checkpoints import cut, ensure_checkpoint_dir
from groundline.sources.tables import table

MOST_BYTES, MOST_ORDERS = 1000, 200


@query("SELECT c_custkey, o_orderkey, o_totalprice, place::INT AS place FROM customer LEFT JOIN LATERAL (SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS place FROM orders WHERE o_custkey = c_custkey ORDER BY place LIMIT 3) ON true")
def lateral_top_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three dearest orders of each customer, numbered; customers without orders stay."""
    customers, orders = table(spark, sf_dir, "customer").select("c_custkey").alias("c"), table(spark, sf_dir, "orders").alias("o")
    top = orders.where(F.col("o.o_custkey") == F.col("c.c_custkey").outer()).orderBy(F.desc("o.o_totalprice"), F.col("o.o_orderkey")).limit(3).select("o_orderkey", "o_totalprice")
    # A customer has three of them at most now.
    place = F.row_number().over(Window.partitionBy("c_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey"))
    found = customers.lateralJoin(top, how="left")
    return found.select("c_custkey", "o_orderkey", "o_totalprice", F.when(F.col("o_orderkey").isNotNull(), place).alias("place"))


@query(
    """SELECT s_suppkey, n_lines, n_large, first_ship FROM supplier, LATERAL (SELECT count(*) AS n_lines, count(*) FILTER (l_quantity * 200 > s_acctbal) AS n_large, min(l_shipdate)::DATE AS first_ship FROM lineitem WHERE l_suppkey = s_suppkey)"""
)
def lateral_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each supplier, all lines and those above a bound that is the supplier's own; suppliers without lines count zero."""
    suppliers, lines = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "lineitem")
    # The subquery brings the bound itself: correlated by the key alone, it becomes one aggregation and one join.
    bounds = suppliers.select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_acctbal").alias("bound"))
    lines = lines.select("l_suppkey", "l_quantity", "l_shipdate").join(bounds, "l_suppkey").alias("l")
    own = lines.where(F.col("l.l_suppkey") == F.col("s.s_suppkey").outer())
    counts = own.select(F.count("*").alias("n_lines"), F.count_if(F.col("l_quantity") * 200 > F.col("bound")).alias("n_large"), F.min("l_shipdate").cast("date").alias("first_ship"))
    return suppliers.select("s_suppkey").alias("s").lateralJoin(counts, how="left").select("s_suppkey", "n_lines", "n_large", "first_ship")


_RECORDS = """n AS (SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey),
o AS (SELECT o_custkey AS c_custkey, list({'key': o_orderkey, 'priority': o_orderpriority, 'status': o_orderstatus} ORDER BY o_orderkey) AS orders FROM orders GROUP BY o_custkey),
bodies AS (SELECT c_custkey, to_json({'custkey': c_custkey, 'nation': {'name': n_name, 'region': r_name}, 'orders': coalesce(orders, []), 'segment': CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_mktsegment END})::VARCHAR AS body
  FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey JOIN n USING (c_custkey) LEFT JOIN o USING (c_custkey) WHERE n <= 200)"""


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with their nation and orders; only those of at most 200 orders are collected."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderpriority", "o_orderstatus")
    few = orders.groupBy("o_custkey").agg(F.count("*").alias("n")).filter(F.col("n") <= MOST_ORDERS).select("o_custkey")
    many = orders.groupBy("o_custkey").agg(F.count("*").alias("n")).filter(F.col("n") > MOST_ORDERS).select("o_custkey")
    item = F.struct(F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"))
    lists = orders.join(few, "o_custkey", "left_semi").groupBy("o_custkey").agg(F.array_sort(F.collect_list(item)).alias("orders"))
    places = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("r_regionkey") == F.col("n_regionkey"))
    nation = F.struct(F.col("r_name").alias("region"), F.col("n_name").alias("name")).alias("nation")
    customers = table(spark, sf_dir, "customer").join(many, F.col("c_custkey") == F.col("o_custkey"), "left_anti").join(places, F.col("n_nationkey") == F.col("c_nationkey"))
    segment = F.when(F.col("c_custkey") % 3 != 0, F.col("c_mktsegment")).alias("segment")
    rows = customers.select(segment, F.col("c_custkey").alias("custkey"), nation).join(lists, F.col("custkey") == F.col("o_custkey"), "left")
    return rows.select("segment", "custkey", "nation", F.coalesce("orders", F.array().cast(lists.schema["orders"].dataType)).alias("orders"))


@query(f"WITH {_RECORDS} SELECT c_custkey AS custkey, CASE WHEN strlen(body) <= {MOST_BYTES} THEN strlen(body)::INT END AS n_bytes, CASE WHEN strlen(body) <= {MOST_BYTES} THEN sha256(body) END AS seal FROM bodies")
def sealed_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The seal of each customer's nested record, null where its canonical JSON is over the bound."""
    rows = seal(_records(spark, sf_dir), most_bytes=MOST_BYTES)
    return rows.select("custkey", F.octet_length(canonical_json(rows, leave_out=(SEAL,), most_bytes=MOST_BYTES)).alias("n_bytes"), SEAL)


@query(f"WITH {_RECORDS} SELECT c_custkey AS custkey, NOT (c_custkey % 50 = 7 AND contains(body, '\"status\":\"F\"')) AS intact FROM bodies WHERE strlen(body) <= {MOST_BYTES}")
def sealed_record_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sealed records written, some changed by one byte (an order's state), read back and checked."""
    root = f"{ensure_checkpoint_dir(spark)}/sealed-{uuid.uuid4().hex}"
    rows = cut(_records(spark, sf_dir))
    write_sealed(rows, f"{root}/written", most_bytes=MOST_BYTES)
    lines = spark.read.text(f"{root}/written")
    key = F.get_json_object("value", "$.custkey").cast("long")
    changed = F.regexp_replace("value", '^(.*?)"status":"F"', '$1"status":"G"')
    lines.select(F.when(key % 50 == 7, changed).otherwise(F.col("value")).alias("value")).write.text(f"{root}/changed")
    return read_sealed(spark, f"{root}/changed", rows.schema, most_bytes=MOST_BYTES).select("custkey", "intact")
