"""Joins, set operations and orderings over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lineloom.operators import relational as R
from lineloom.plans.base import Plans, table

plans = Plans()


@plans.add("join_left_last_wins", "SELECT c_custkey, last_order, last_price FROM customer LEFT JOIN (SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS last_order, arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS last_price FROM orders GROUP BY 1) ON c_custkey = o_custkey")
def join_left_last_wins(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderkey").alias("last_order"), F.col("o_totalprice").alias("last_price"), "o_orderdate")
    return R.join_left_last_wins(table(spark, sf_dir, "customer").select("c_custkey"), orders, ["c_custkey"], ["o_orderdate", "last_order"]).select("c_custkey", "last_order", "last_price")


@plans.add("join_inner_three", "SELECT l_orderkey, count(*) AS lines, any_value(o_custkey) AS custkey, any_value(c_name) AS name FROM lineitem JOIN orders ON l_orderkey = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey AND c_custkey % 3 = 0 GROUP BY 1")
def join_inner_three(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("key")).agg(F.count("*").alias("lines"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_custkey").alias("custkey"))
    names = table(spark, sf_dir, "customer").where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("custkey"), F.col("c_name").alias("name"))
    both = lines.join(orders, "key", "inner")
    return both.join(names, "custkey", "left").select(F.col("key").alias("l_orderkey"), "lines", "custkey", "name")


@plans.add("join_golden", "SELECT d.doc_id, l.quality FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY 1) l ON d.doc_id = l.doc_id")
def join_golden(spark, sf_dir):
    golden = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    return table(spark, sf_dir, "documents").select("doc_id").join(golden, "doc_id", "left")


@plans.add("join_semi_membership", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def join_semi_membership(spark, sf_dir):
    members = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(members, "o_custkey", "left_semi").select("o_orderkey", "o_custkey")


@plans.add("join_anti_exclude", "SELECT o_orderkey, k FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE o_custkey END AS k FROM orders) t WHERE k IS NULL OR k NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def join_anti_exclude(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 9 != 0, F.col("o_custkey")).alias("k"))
    return R.exclude(orders, table(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("k")), "k").select("o_orderkey", "k")


_SPANS = "SELECT user_id, event_id AS span_id, CAST(epoch(ts) AS BIGINT) AS low, CAST(epoch(ts) AS BIGINT) + CAST(value * 60 AS BIGINT) AS high FROM events WHERE event_type = 'signup'"


@plans.add("join_range", "SELECT p.event_id, s.span_id FROM (SELECT user_id, event_id, CAST(epoch_us(ts) // 1000000 AS BIGINT) AS at FROM events WHERE event_type = 'error') p JOIN (SELECT user_id, event_id AS span_id, CAST(epoch_us(ts) // 1000000 AS BIGINT) AS low, CAST(epoch_us(ts) // 1000000 AS BIGINT) + CAST(floor(value * 600) AS BIGINT) AS high FROM events WHERE event_type = 'signup') s ON p.user_id = s.user_id AND p.at >= s.low AND p.at < s.high")
def join_range(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("at", F.unix_seconds(F.col("ts").cast("timestamp")))
    points = events.where("event_type = 'error'").select("user_id", "event_id", "at")
    spans = events.where("event_type = 'signup'").select("user_id", F.col("event_id").alias("span_id"), F.col("at").alias("low"), (F.col("at") + F.floor(F.col("value") * 600)).alias("high"))
    return R.range_join(points, spans, "at", "low", "high", ["user_id"], width=4096).select("event_id", "span_id")


@plans.add("asof_backward", "SELECT p.event_id, p.user_id, m.event_id AS mark FROM (SELECT * FROM events WHERE event_type = 'click') p ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') m ON p.user_id = m.user_id AND p.ts >= m.ts")
def asof_backward(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    points = events.where("event_type = 'click'").select("event_id", "user_id", "ts")
    marks = events.where("event_type = 'view'").select("user_id", "ts", F.col("event_id").alias("mark"))
    return R.asof_backward(points, marks, ["user_id"], "ts", "mark").select("event_id", "user_id", "mark")


@plans.add("self_join_offset", 'SELECT a.l_orderkey, min(a.l_linenumber) AS "left", min(b.l_linenumber) AS "right" FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 GROUP BY 1')
def self_join_offset(spark, sf_dir):
    return R.self_join_next(table(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_linenumber")


@plans.add("union_dedup_first", "SELECT c_custkey, origin FROM (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY s) AS r FROM (SELECT c_custkey, 'first' AS origin, 0 AS s FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey, 'second', 1 FROM customer WHERE c_custkey % 3 = 0)) WHERE r = 1")
def union_dedup_first(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").select("c_custkey")
    return R.union_first(customers.where("c_custkey % 2 = 0").withColumn("origin", F.lit("first")), customers.where("c_custkey % 3 = 0").withColumn("origin", F.lit("second")), ["c_custkey"], ["origin"])


@plans.add("lookup_dual_marker", "SELECT c_custkey, min(o_orderkey) AS issue FROM (SELECT c_custkey, o_orderkey FROM customer JOIN orders ON o_custkey = c_custkey UNION ALL SELECT c_custkey, o_orderkey FROM customer JOIN orders ON o_custkey = c_custkey + 1) GROUP BY 1")
def lookup_dual_marker(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").select("c_custkey")
    markers = customers.select("c_custkey", F.explode(F.array("c_custkey", F.col("c_custkey") + 1)).alias("o_custkey"))
    issues = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min("o_orderkey").alias("issue"))
    return markers.join(issues, "o_custkey").groupBy("c_custkey").agg(F.min("issue").alias("issue"))


@plans.add("lookup_first_match", "SELECT c_custkey, coalesce(p, 'no-entry') AS o_orderpriority FROM customer LEFT JOIN (SELECT o_custkey, arg_min(o_orderpriority, o_orderkey) AS p FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) ON o_custkey = c_custkey")
def lookup_first_match(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "c_custkey")
    return R.lookup_first_match(table(spark, sf_dir, "customer").select("c_custkey"), orders, "c_custkey", "o_orderkey", "o_orderpriority", F.col("o_orderstatus") == "F", "no-entry")


@plans.add("join_marker_contains", "SELECT e.event_id, p.p_partkey FROM (SELECT event_id, CAST(regexp_extract(props, '\"k\": ([0-9]+)', 1) AS BIGINT) AS k FROM events) e JOIN part p ON p.p_partkey = e.k")
def join_marker_contains(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("token"), "p_partkey")
    return R.join_marker(table(spark, sf_dir, "events").select("event_id", "props"), "props", '"k": ([0-9]+)', parts, "token").select("event_id", "p_partkey")


@plans.add("distinct_ordered", "SELECT doc_id, string_agg(w, ' ' ORDER BY i) AS words FROM (SELECT doc_id, w, min(i) AS i FROM (SELECT doc_id, unnest(l) AS w, unnest(range(0, len(l))) AS i FROM (SELECT doc_id, string_split(text, ' ') AS l FROM documents)) GROUP BY ALL) GROUP BY 1")
def distinct_ordered(spark, sf_dir):
    return table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.array_join(F.array_distinct(F.split("text", " ")), " ").alias("words"))


@plans.add("circular_slice", "SELECT p_partkey FROM part, (SELECT count(*) AS n FROM part) WHERE ((p_partkey - (SELECT min(p_partkey) FROM part)) - (n - 7) + n) % n < 30")
def circular_slice(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select("p_partkey")
    low, n = parts.agg(F.min("p_partkey"), F.count("*")).first()
    return R.circular_slice(parts.withColumn("i", F.col("p_partkey") - low), "i", n - 7, 30).select("p_partkey")


# Names that a dictionary and bytes order in other ways; the first four are those of as many events.
_NAMES = ["zebra", "\u00e9clair", "Apple", "apple", "Zebra", "eclair", "\u00c4hre", "ahorn", "Ahorn", "eclat"]


@plans.add("topk_categories", f"SELECT category, n FROM (SELECT [{', '.join(repr(n) for n in _NAMES)}][(event_id % 10) + 1] AS category, count(*) AS n FROM events GROUP BY 1) JOIN (VALUES ('ahorn', 1), ('Ahorn', 2), ('\u00c4hre', 3), ('apple', 4), ('Apple', 5), ('eclair', 6), ('\u00e9clair', 7), ('eclat', 8), ('zebra', 9), ('Zebra', 10)) d(category, k) USING (category) ORDER BY n DESC, k LIMIT 7")
def topk_categories(spark, sf_dir):
    name = F.get(F.array(*map(F.lit, _NAMES)), (F.col("event_id") % 10).cast("int"))
    return R.top_k(table(spark, sf_dir, "events").select(name.alias("category")), "category", 7)


@plans.add("sort_newest", "SELECT event_id, CAST(row_number() OVER (ORDER BY coalesce(CASE WHEN event_id % 50 <> 0 THEN epoch_us(ts) END, 0) DESC, event_id) AS BIGINT) AS place FROM events")
def sort_newest(spark, sf_dir):
    at = F.coalesce(F.when(F.col("event_id") % 50 != 0, F.unix_micros(F.col("ts").cast("timestamp"))), F.lit(0))
    return R.placed(table(spark, sf_dir, "events").select("event_id", at.alias("at")), [F.desc("at"), F.asc("event_id")]).drop("at")


@plans.add("cap_ordered", "SELECT event_id, value > 20 AND sum(CAST(value > 20 AS INT)) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= 5 AS allowed FROM events")
def cap_ordered(spark, sf_dir):
    return R.cap_successes(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], F.col("value") > 20, 5).select("event_id", "allowed")


@plans.add("filter_reports", "SELECT event_id FROM events WHERE event_type = 'error' AND props LIKE '%7%' AND value >= 3 AND ts >= TIMESTAMP '2024-01-10'")
def filter_reports(spark, sf_dir):
    return table(spark, sf_dir, "events").where((F.col("event_type") == "error") & F.col("props").contains("7") & (F.col("value") >= 3) & (F.col("ts") >= F.lit("2024-01-10").cast("timestamp_ntz"))).select("event_id")


QUERIES, SQL = plans.QUERIES, plans.SQL
