"""Queries of the record engine, over tables as directories."""

from __future__ import annotations

from pyspark.sql import functions as F

from nephos.operators import ordering as order_ops
from nephos.operators import records as ops
from nephos.plans.base import read

ROW = ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"]


def search_wildcard(spark, d):
    found = ops.search(read(spark, d, "orders"), o_orderstatus="F", o_orderpriority=" ", o_custkey=-1)
    return found.where(F.col("o_orderpriority").startswith("1")).select(*ROW)


def search_mask_bits(spark, d):
    return read(spark, d, "orders").where(ops.masked(F.col("o_orderkey"), 5, 0b1110 << 4)).select(*ROW)


def search_label_mask(spark, d):
    return read(spark, d, "part").where(ops.label_like(F.col("p_brand"), "Brand#*3")).select("p_partkey", "p_brand")


def search_tolerant_level(spark, d):
    p = read(spark, d, "part").select("p_partkey", (F.lit(42043040) + F.col("p_size") - 10).alias("ip1"))
    return p.where(ops.level_alike(F.col("ip1"), F.lit(42043040))).select("p_partkey", F.col("ip1").cast("long").alias("ip1"))


def rules_ordered(spark, d):
    rules = [
        ops.Rule(False, (ops.one_of("l_returnflag", "R"), ops.between("l_quantity", 40, None))),
        ops.Rule(True, (ops.one_of("l_returnflag", "R", "A"),)),
        ops.Rule(True, (ops.between("l_linenumber", 1, 7, 3), ops.starts_with("l_linestatus", "O"))),
    ]
    li = read(spark, d, "lineitem").withColumn("rule", ops.decide(rules))
    return li.groupBy("rule").agg(F.count("*").alias("n"), F.sum("l_quantity").cast("long").alias("qty"))


def rules_range_step(spark, d):
    li = read(spark, d, "lineitem").withColumn("day", F.datediff("l_shipdate", F.lit("1992-01-01").cast("date")))
    return li.where(ops.between("day", 100, 1500, 7)).groupBy("day").agg(F.count("*").alias("n"))


def next_after_handle(spark, d):
    return ops.next_after(read(spark, d, "events"), "event_id", 500, ["user_id"]).select("user_id", "event_id", "event_type")


def list_limit_overflow(spark, d):
    found = ops.listing(read(spark, d, "orders"), "o_orderkey", 5, ["o_orderstatus", "o_orderpriority"])
    return found.select("o_orderstatus", "o_orderpriority", F.col("place").cast("long").alias("place"), "found", "o_orderkey")


def link_union(spark, d):
    c = read(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"))
    s = read(spark, d, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"))
    return ops.link(c, s)


def replace_record(spark, d):
    part = read(spark, d, "part").select("p_partkey", "p_brand", "p_size")
    new = part.where("p_partkey % 10 = 0").select((F.col("p_partkey") + 5).alias("p_partkey"), F.lit("new").alias("p_brand"), F.col("p_size"))
    return ops.rewrite(part, new, ["p_partkey"])


def tombstone_counts(spark, d):
    return ops.counts(ops.erase(read(spark, d, "orders"), F.col("o_orderkey") % 7 == 0), ["o_orderstatus"])


def edit_descriptors(spark, d):
    n = read(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey")
    return ops.edit(n, F.col("n_regionkey") == 1, n_name=F.concat(F.lit("X_"), F.col("n_name")), n_regionkey=9, n_nationkey=-1)


def sequential_skip(spark, d):
    return order_ops.skip(read(spark, d, "region").select("r_regionkey", "r_name"), "r_regionkey", 2)


def file_marks(spark, d):
    return order_ops.mark_level(read(spark, d, "events"), "event_id", F.col("event_type") == "purchase", ["user_id"]).groupBy("user_id").agg(
        F.max("files").cast("long").alias("files"), F.count("*").alias("n")
    )


def argsort(spark, d):
    return order_ops.argsort(read(spark, d, "part"), "p_retailprice", "p_partkey", ["p_brand"]).select("p_brand", "p_partkey", F.col("place").cast("long").alias("place"))


def topk(spark, d):
    return order_ops.top(read(spark, d, "part"), "p_retailprice", "p_partkey", 3, ["p_brand"]).select("p_brand", "p_partkey", F.round("p_retailprice", 4).alias("price"))


def quantile(spark, d):
    return order_ops.median_of(read(spark, d, "part"), "p_retailprice", ["p_brand"]).select("p_brand", F.round("median", 4).alias("median"))


QUERIES = {f.__name__: f for f in (search_wildcard, search_mask_bits, search_label_mask, search_tolerant_level, rules_ordered, rules_range_step, next_after_handle, list_limit_overflow, link_union, replace_record, tombstone_counts, edit_descriptors, sequential_skip, file_marks, argsort, topk, quantile)}
_ROW = "o_orderkey, o_custkey, o_orderstatus, o_orderpriority"
ORACLE_SQL = {
    "search_wildcard": f"SELECT {_ROW} FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority LIKE '1%'",
    "search_mask_bits": f"SELECT {_ROW} FROM orders WHERE (xor(o_orderkey, 5) & ~(14 << 4)::BIGINT) = 0",
    "search_label_mask": "SELECT p_partkey, p_brand FROM part WHERE p_brand LIKE 'Brand#_3%'",
    "search_tolerant_level": "SELECT p_partkey, (42043040 + p_size - 10)::BIGINT AS ip1 FROM part WHERE abs(p_size - 10) <= 1",
    "rules_ordered": """SELECT rule, count(*) AS n, sum(l_quantity)::BIGINT AS qty FROM (SELECT *, (CASE WHEN l_returnflag = 'R' AND l_quantity >= 40 THEN 0
        WHEN l_returnflag IN ('R', 'A') THEN 2 WHEN l_linenumber BETWEEN 1 AND 7 AND (l_linenumber - 1) % 3 = 0 AND l_linestatus LIKE 'O%' THEN 3 ELSE 0 END) AS rule FROM lineitem) GROUP BY rule""",
    "rules_range_step": "SELECT day, count(*) AS n FROM (SELECT date_diff('day', DATE '1992-01-01', l_shipdate::DATE) AS day FROM lineitem) WHERE day BETWEEN 100 AND 1500 AND (day - 100) % 7 = 0 GROUP BY day",
    "next_after_handle": "SELECT user_id, event_id, event_type FROM events WHERE event_id > 500 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) = 1",
    "list_limit_overflow": """SELECT o_orderstatus, o_orderpriority, place, CASE WHEN n > 5 THEN -n ELSE n END AS found, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_orderstatus, o_orderpriority ORDER BY o_orderkey) AS place,
        count(*) OVER (PARTITION BY o_orderstatus, o_orderpriority) AS n FROM orders) WHERE place <= 5""",
    "link_union": "SELECT c_custkey AS key, c_name AS name, 0 AS file_index FROM customer UNION ALL SELECT s_suppkey, s_name, 1 FROM supplier",
    "replace_record": """WITH new AS (SELECT p_partkey + 5 AS p_partkey, 'new' AS p_brand, p_size FROM part WHERE p_partkey % 10 = 0)
        SELECT p_partkey, p_brand, p_size FROM part WHERE NOT EXISTS (SELECT 1 FROM new WHERE new.p_partkey = part.p_partkey) UNION ALL SELECT * FROM new""",
    "tombstone_counts": "SELECT o_orderstatus, count(*) AS n_all, count(*) FILTER (o_orderkey % 7 <> 0) AS n_live FROM orders GROUP BY 1",
    "edit_descriptors": "SELECT n_nationkey, CASE WHEN n_regionkey = 1 THEN 'X_' || n_name ELSE n_name END AS n_name, CASE WHEN n_regionkey = 1 THEN 9 ELSE n_regionkey END AS n_regionkey FROM nation",
    "sequential_skip": "SELECT r_regionkey, r_name FROM region QUALIFY row_number() OVER (ORDER BY r_regionkey) > 2",
    "file_marks": """SELECT user_id, max(files)::BIGINT AS files, count(*) AS n FROM (SELECT user_id, sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS files FROM events) GROUP BY 1""",
    "argsort": "SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey) AS place FROM part",
    "topk": "SELECT p_brand, p_partkey, round(p_retailprice, 4) AS price FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) <= 3",
    "quantile": "SELECT p_brand, round(median(p_retailprice), 4) AS median FROM part GROUP BY 1",
}
