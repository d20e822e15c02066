"""Ledger roll-ups, caps, digests and comparisons: events stand for ledger entries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lineloom.operators import rollup as U
from lineloom.plans.base import Plans, table

plans = Plans()
NOW = "2024-01-28 12:00:00"
_LEDGER = "SELECT event_id, ts, strftime(ts, '%Y-%m') AS month, strftime(ts, '%Y-%m-%d') AS day, CASE WHEN event_id % 7 <> 0 THEN event_type END AS phase, user_id AS issue, event_id % 40 AS pr, value / 100 AS cost_usd FROM events"


def ledger(spark, sf_dir):
    ts = F.col("ts")
    return table(spark, sf_dir, "events").select("event_id", "ts", F.date_format(ts, "yyyy-MM").alias("month"), F.date_format(ts, "yyyy-MM-dd").alias("day"), F.when(F.col("event_id") % 7 != 0, F.col("event_type")).alias("phase"), F.col("user_id").alias("issue"), (F.col("event_id") % 40).alias("pr"), (F.col("value") / 100).alias("cost_usd"))


def _totals(tag: str) -> None:
    @plans.add(f"ledger_{tag}_total", f"SELECT {tag}, count(*) AS invocations, round(sum(cost_usd), 6) AS total_usd FROM ({_LEDGER}) GROUP BY 1")
    def query(spark, sf_dir):
        return U.spend(ledger(spark, sf_dir), [tag])


for _tag in ("month", "day", "phase", "issue", "pr"):
    _totals(_tag)


@plans.add("ledger_by_transport", f"SELECT month, round(coalesce(sum(cost_usd) FILTER (t = 'sdk'), 0), 6) AS sdk, round(coalesce(sum(cost_usd) FILTER (t = 'subscription'), 0), 6) AS subscription, round(coalesce(sum(cost_usd) FILTER (t = 'unknown'), 0), 6) AS \"unknown\", round(sum(cost_usd), 6) AS combined FROM (SELECT *, CASE WHEN event_id % 5 = 0 THEN 'sdk' WHEN event_id % 5 = 1 THEN 'unknown' ELSE 'subscription' END AS t FROM ({_LEDGER})) GROUP BY 1")
def ledger_by_transport(spark, sf_dir):
    kind = U.transport(F.expr("CASE event_id % 5 WHEN 0 THEN 'sdk' WHEN 1 THEN 'carrier' WHEN 2 THEN 'subscription' END"))
    rows = ledger(spark, sf_dir).withColumn("t", kind)

    def part(t):
        return F.round(F.coalesce(F.sum(F.when(F.col("t") == t, U.finite(F.col("cost_usd")))), F.lit(0.0)), 6).alias(t)

    return rows.groupBy("month").agg(part("sdk"), part("subscription"), part("unknown"), F.round(F.sum(U.finite(F.col("cost_usd"))), 6).alias("combined"))


@plans.add("count_fix_attempts", "SELECT user_id, count(*) FILTER (event_type = 'error' AND props <> '') AS attempts FROM events GROUP BY 1")
def count_fix_attempts(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.count_if((F.col("event_type") == "error") & (F.col("props") != "")).alias("attempts"))


# What a tag's entries cost for its cap: none, some or all of it, by tag, so that totals fall on both sides of the limits.
_SHARES = {"month": "1", "phase": "(length(phase) % 3) * 0.005", "day": "(CAST(right(day, 2) AS INT) % 5) * 0.02", "issue": "(issue % 5) * 0.01", "pr": "(pr % 5) * 0.005"}


def _capped(rows, tag):
    return U.spend(rows.withColumn("cost_usd", F.col("cost_usd") * F.expr(_SHARES[tag]).cast("double")), [tag])


def _capped_sql(tag: str, source: str) -> str:
    return f"SELECT {tag}, round(coalesce(sum(cost_usd * CAST({_SHARES[tag]} AS DOUBLE)), 0), 6) AS total_usd FROM {source} GROUP BY 1"


def _caps(kind: str) -> None:
    warn, block = U.CAPS[kind]
    sql = f"WHEN total_usd >= {warn} THEN 'warn' " if warn is not None else ""

    @plans.add(f"cap_status_{kind}", f"SELECT {kind}, CASE WHEN total_usd >= {block} THEN 'block' {sql}ELSE 'ok' END AS status FROM ({_capped_sql(kind, f'({_LEDGER})')})")
    def query(spark, sf_dir):
        return _capped(ledger(spark, sf_dir), kind).select(kind, U.cap_status(kind, F.col("total_usd")).alias("status"))


for _kind in U.CAPS:
    _caps(_kind)


@plans.add("precheck_caps", f"WITH l AS ({_LEDGER}), d AS ({_capped_sql('day', 'l')}), i AS ({_capped_sql('issue', 'l')}), p AS ({_capped_sql('phase', 'l')}) SELECT event_id, CASE WHEN d.total_usd >= 10 THEN 0 WHEN i.total_usd >= 1 THEN 1 WHEN p.total_usd >= 10 THEN 2 END AS blocked_by FROM l LEFT JOIN d USING (day) LEFT JOIN i USING (issue) LEFT JOIN (SELECT * FROM p WHERE phase IS NOT NULL) p USING (phase)")
def precheck_caps(spark, sf_dir):
    rows = ledger(spark, sf_dir)
    for tag in ("day", "issue", "phase"):
        caps = _capped(ledger(spark, sf_dir).where(F.col(tag).isNotNull()), tag).select(tag, U.cap_status(tag, F.col("total_usd")).alias(f"{tag}_cap"))
        rows = rows.join(caps, tag, "left")
    return rows.select("event_id", U.precheck([F.col("day_cap"), F.col("issue_cap"), F.col("phase_cap")]).alias("blocked_by"))


@plans.add("ledger_append", f"SELECT month, count(*) AS invocations, round(sum(cost_usd), 6) AS total_usd, max(strftime(ts, '%Y-%m-%dT%H:%M:%S')) AS last_iso FROM ({_LEDGER}) GROUP BY 1")
def ledger_append(spark, sf_dir):
    rows = ledger(spark, sf_dir)
    old, new = rows.where("event_id % 3 <> 0"), rows.where("event_id % 3 = 0")
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    parts = old.unionByName(new)
    return parts.groupBy("month").agg(F.count("*").alias("invocations"), F.round(F.sum(U.finite(F.col("cost_usd"))), 6).alias("total_usd"), F.max(iso).alias("last_iso"))


@plans.add("ledger_dashboard", f"SELECT 'day' AS section, day AS name, count(*) AS n, round(sum(cost_usd), 6) AS usd FROM ({_LEDGER}) GROUP BY 2 UNION ALL SELECT 'month', month, count(*), round(sum(cost_usd), 6) FROM ({_LEDGER}) GROUP BY 2 UNION ALL SELECT 'phase', coalesce(phase, '(none)'), count(*), round(sum(cost_usd), 6) FROM ({_LEDGER}) GROUP BY 2")
def ledger_dashboard(spark, sf_dir):
    rows = ledger(spark, sf_dir)
    tags = F.explode(F.array(F.struct(F.lit("day").alias("section"), F.col("day").alias("name")), F.struct(F.lit("month").alias("section"), F.col("month").alias("name")), F.struct(F.lit("phase").alias("section"), F.coalesce("phase", F.lit("(none)")).alias("name"))))
    return rows.select(tags.alias("t"), "cost_usd").groupBy("t.section", "t.name").agg(F.count("*").alias("n"), F.round(F.sum(U.finite(F.col("cost_usd"))), 6).alias("usd"))


@plans.add("fallback_cost", "SELECT l_orderkey, l_linenumber, round((greatest(l_partkey * 100 - 5000, 0) * CASE WHEN l_linenumber % 3 = 0 THEN 3.0 WHEN l_linenumber % 3 = 1 THEN 0.8 ELSE 15.0 END + l_suppkey * 10 * CASE WHEN l_linenumber % 3 = 0 THEN 15.0 WHEN l_linenumber % 3 = 1 THEN 4.0 ELSE 75.0 END) / 1e6, 6) AS cost FROM lineitem")
def fallback_cost(spark, sf_dir):
    model = F.expr("CASE l_linenumber % 3 WHEN 0 THEN 'medium' WHEN 1 THEN 'small' ELSE 'other' END")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", U.fallback_cost(model, F.col("l_partkey") * 100 - 5000, F.col("l_suppkey") * 10).alias("cost"))


_CLASSES = ["click", "error", "purchase", "signup"]


@plans.add("llm_summary", "SELECT user_id, " + ", ".join(f"count(*) FILTER (event_type = '{c}') AS {c}" for c in _CLASSES) + ", round(sum(value / 100), 6) AS cost FROM events GROUP BY 1")
def llm_summary(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    counts = [F.count_if(F.col("event_type") == c).alias(c) for c in _CLASSES]
    return events.groupBy("user_id").agg(*counts, F.round(F.sum(U.finite(F.col("value") / 100)), 6).alias("cost"))


@plans.add("case_summary", "SELECT count(*) AS total, " + ", ".join(f"count(*) FILTER (event_type = '{c}') AS {c}" for c in _CLASSES) + " FROM events")
def case_summary(spark, sf_dir):
    return U.count_classes(table(spark, sf_dir, "events").withColumn("event_type", F.col("event_type")), "event_type", _CLASSES).join(F.broadcast(table(spark, sf_dir, "events").agg(F.count("*").alias("total"))))


@plans.add("triage_summary", "SELECT 'category' AS kind, event_type AS name, count(*) AS n FROM events GROUP BY 2 UNION ALL SELECT 'severity', CASE WHEN value >= 50 THEN 'high' WHEN value >= 10 THEN 'medium' ELSE 'low' END, count(*) FROM events GROUP BY 2")
def triage_summary(spark, sf_dir):
    severity = F.when(F.col("value") >= 50, "high").when(F.col("value") >= 10, "medium").otherwise("low")
    return U.tallies(table(spark, sf_dir, "events"), {"category": F.col("event_type"), "severity": severity})


_LABELS = "CASE user_id % 4 WHEN 0 THEN ['nightly', event_type] WHEN 1 THEN [event_type, 'error'] WHEN 2 THEN ['triage'] ELSE ['error', 'view', 'click'] END"
_LABELS_SPARK = "CASE user_id % 4 WHEN 0 THEN array('nightly', event_type) WHEN 1 THEN array(event_type, 'error') WHEN 2 THEN array('triage') ELSE array('error', 'view', 'click') END"
_KNOWN = ["click", "error", "purchase", "signup"]
_KNOWN_SQL = "['click', 'error', 'purchase', 'signup']"


@plans.add("weekly_digest", f"SELECT coalesce(list_filter(labels, lambda x: list_contains({_KNOWN_SQL}, x))[1], 'UNCLASSIFIED') AS category, count(*) AS n, count(*) FILTER (ts >= TIMESTAMP '{NOW}' - INTERVAL 7 DAY AND ts <= TIMESTAMP '{NOW}') AS growth FROM (SELECT *, {_LABELS} AS labels FROM events) GROUP BY 1")
def weekly_digest(spark, sf_dir):
    now = F.lit(NOW).cast("timestamp_ntz")
    recent = (F.col("ts") >= now - F.expr("INTERVAL 7 DAY")) & (F.col("ts") <= now)
    return table(spark, sf_dir, "events").withColumn("category", U.first_label(F.expr(_LABELS_SPARK), _KNOWN)).groupBy("category").agg(F.count("*").alias("n"), F.count_if(recent).alias("growth"))


@plans.add("digest_by_summary_key", f"SELECT k AS summary_key, count(*) AS n FROM (SELECT CASE list_filter(labels, lambda x: list_contains({_KNOWN_SQL}, x))[1] WHEN 'error' THEN 'harness_error' WHEN 'click' THEN 'wrong_citation' WHEN 'signup' THEN 'passed' END AS k FROM (SELECT *, {_LABELS} AS labels FROM events)) WHERE k IS NOT NULL GROUP BY 1")
def digest_by_summary_key(spark, sf_dir):
    keys = F.create_map(*[F.lit(x) for pair in (("error", "harness_error"), ("click", "wrong_citation"), ("signup", "passed")) for x in pair])
    category = U.first_label(F.expr(_LABELS_SPARK), _KNOWN)
    return table(spark, sf_dir, "events").select(F.element_at(keys, category).alias("summary_key")).where("summary_key IS NOT NULL").groupBy("summary_key").agg(F.count("*").alias("n"))


@plans.add("extract_error_class", f"SELECT event_id, CASE len(f) WHEN 0 THEN NULL WHEN 1 THEN f[1] ELSE 'AMBIGUOUS' END AS error_class FROM (SELECT event_id, list_filter(labels, lambda x: list_contains({_KNOWN_SQL}, x)) AS f FROM (SELECT *, {_LABELS} AS labels FROM events))")
def extract_error_class(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", U.extract_error_class(F.expr(_LABELS_SPARK), _KNOWN).alias("error_class"))


@plans.add("autofix_metrics", "WITH p AS (SELECT o_custkey, o_orderstatus, epoch(o_orderdate) // 60 - 27000000 AS minutes FROM orders), a AS (SELECT o_custkey, count(*) AS n FROM p GROUP BY 1) SELECT (SELECT count(*) FROM p WHERE o_orderstatus <> 'P') AS attempted, (SELECT count(*) FROM p WHERE o_orderstatus = 'F') AS merged, round((SELECT count(*) FROM p WHERE o_orderstatus = 'F') / (SELECT count(*) FROM p WHERE o_orderstatus <> 'P'), 9) AS success_rate, (SELECT CAST(median(minutes) AS DOUBLE) FROM p WHERE o_orderstatus = 'F' AND minutes >= -12000000) AS p50_minutes, (SELECT CAST(median(n) AS DOUBLE) FROM a) AS p50_attempts")
def autofix_metrics(spark, sf_dir):
    minutes = F.floor(F.unix_seconds(F.col("o_orderdate").cast("timestamp")) / 60) - 27000000
    prs = table(spark, sf_dir, "orders").select("o_custkey", "o_orderstatus", minutes.alias("minutes"))
    known = F.when(F.col("minutes") >= -12000000, F.col("minutes"))
    return U.autofix_metrics(prs, F.col("o_orderstatus") != "P", F.col("o_orderstatus") == "F", known, "o_custkey")


@plans.add("bug_report_metrics", f"SELECT count(*) FILTER (event_type <> 'view' AND ts >= TIMESTAMP '{NOW}' - INTERVAL 7 DAY AND ts <= TIMESTAMP '{NOW}') AS volume, count(*) FILTER (event_type = 'signup') AS open, count(*) FILTER (event_type = 'purchase') AS merged, count(*) FILTER (event_type = 'error') AS stuck, round(count(*) FILTER (event_type = 'purchase') * 100.0 / count(*) FILTER (event_type <> 'view' AND ts >= TIMESTAMP '{NOW}' - INTERVAL 7 DAY AND ts <= TIMESTAMP '{NOW}'), 1) AS promotion_rate FROM events")
def bug_report_metrics(spark, sf_dir):
    now, kind = F.lit(NOW).cast("timestamp_ntz"), F.col("event_type")
    return U.bug_report_metrics(table(spark, sf_dir, "events"), F.col("ts"), now, kind != "view", kind == "signup", kind == "purchase", kind == "error")


_ARMS = "SELECT event_type AS class, CASE WHEN event_id % 2 = 0 THEN 'A' ELSE 'B' END AS arm, CASE WHEN event_id % 3 = 0 THEN 'sdk' ELSE 'subscription' END AS transport, CASE WHEN event_id % 11 = 0 THEN NULL ELSE value > 10 + (event_id % 2) * user_id % 9 END AS outcome FROM events"


@plans.add("ab_per_class_arm", f"SELECT class, arm, transport, count(*) AS n, count(*) FILTER (outcome) AS pass FROM ({_ARMS}) GROUP BY 1, 2, 3")
def ab_per_class_arm(spark, sf_dir):
    table(spark, sf_dir, "events").createOrReplaceTempView("events")
    return U.ab_counts(spark.sql(_ARMS), ["class", "transport"], "arm", "outcome")


@plans.add("ab_winner", f"WITH r AS (SELECT class, transport, count(*) FILTER (arm = 'A') AS n_a, count(*) FILTER (arm = 'B') AS n_b, count(*) FILTER (arm = 'A' AND outcome) AS pass_a, count(*) FILTER (arm = 'B' AND outcome) AS pass_b FROM ({_ARMS}) GROUP BY 1, 2), g AS (SELECT min(least(n_a, n_b)) AS m FROM r) SELECT class, transport, n_a, n_b, pass_a, pass_b, round(pass_a / n_a - pass_b / n_b, 9) AS delta, CASE WHEN m < 20 THEN 'NO_WINNER_YET' WHEN abs(pass_a / n_a - pass_b / n_b) < 0.1 THEN 'TIE' WHEN pass_a / n_a > pass_b / n_b THEN 'A' ELSE 'B' END AS winner FROM r, g")
def ab_winner(spark, sf_dir):
    table(spark, sf_dir, "events").createOrReplaceTempView("events")
    return U.ab_winner(spark.sql(_ARMS), "arm", ["class", "transport"], "outcome")


@plans.add("ab_gate", f"SELECT bool_and(n_a >= 500 AND n_b >= 500) AS open FROM (SELECT class, transport, count(*) FILTER (arm = 'A') AS n_a, count(*) FILTER (arm = 'B') AS n_b FROM ({_ARMS}) GROUP BY 1, 2)")
def ab_gate(spark, sf_dir):
    table(spark, sf_dir, "events").createOrReplaceTempView("events")
    return U.ab_gate(spark.sql(_ARMS), ["class", "transport"], "arm", least=500)


@plans.add("bypass_audit", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN NULL WHEN o_orderpriority = '1-URGENT' THEN true ELSE epoch(o_orderdate) % 7 > 3 END AS bypass FROM orders")
def bypass_audit(spark, sf_dir):
    finished = F.unix_seconds(F.col("o_orderdate").cast("timestamp")) % 7
    verdict = U.bypass(F.col("o_orderstatus") != "P", F.col("o_orderpriority") == "1-URGENT", finished, F.lit(3))
    return table(spark, sf_dir, "orders").select("o_orderkey", verdict.alias("bypass"))


@plans.add("tally_line", "SELECT string_agg(event_type || ':' || n, ' ' ORDER BY n DESC, event_type) AS line FROM (SELECT event_type, count(*) AS n FROM events GROUP BY 1)")
def tally_line(spark, sf_dir):
    counts = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), F.col("event_type").alias("t"))))
    return counts.agg(F.array_join(F.transform(ordered, lambda s: F.concat(s["t"], F.lit(":"), (-s["m"]).cast("string"))), " ").alias("line"))


@plans.add("max_iso", "SELECT max(strftime(ts, '%Y-%m-%dT%H:%M:%S')) AS newest FROM events")
def max_iso(spark, sf_dir):
    return table(spark, sf_dir, "events").agg(F.max(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")).alias("newest"))


@plans.add("replay_verdict", "SELECT conv_id, CASE WHEN any_value(original) IS NULL THEN 'NOT_REPLAYABLE' WHEN count(*) FILTER (turn BETWEEN 1 AND 3 AND role = original) >= 2 THEN 'CONFIRMED' ELSE 'FLAKE' END AS verdict FROM conversations JOIN (SELECT conv_id, max(CASE WHEN turn = 0 AND conv_id % 5 <> 0 THEN role END) AS original FROM conversations GROUP BY 1) USING (conv_id) GROUP BY 1")
def replay_verdict(spark, sf_dir):
    runs = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.max(F.when((F.col("turn") == 0) & (F.col("conv_id") % 5 != 0), F.col("role"))).alias("original"), F.collect_list(F.when(F.col("turn").between(1, 3), F.col("role"))).alias("runs"))
    return runs.select("conv_id", U.replay_verdict(F.col("original"), F.col("runs")).alias("verdict"))


@plans.add("upper_median", "SELECT user_id, v[CAST(len(v) // 2 AS INT) + 1] AS median FROM (SELECT user_id, list_sort(list(value)) AS v FROM events GROUP BY 1)")
def upper_median(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_list("value").alias("v")).select("user_id", U.upper_median(F.col("v")).alias("median"))


# Accuracy reports: documents with labels stand for cases with an expected and an actual answer.
_CASES = "SELECT d.doc_id, d.lang AS category, l.quality AS expected, l.toxic AS actual, 1 - d.doc_id % 30 / 100 AS confidence FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY 1) l ON d.doc_id = l.doc_id"


def _cases(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("expected"), F.max("toxic").alias("actual"))
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("category"), (1 - F.col("doc_id") % 30 / 100).alias("confidence"))
    return docs.join(labels, "doc_id", "left")


@plans.add("accuracy_report", f"SELECT category, count(*) AS total, count(*) FILTER (expected = actual) AS exact, count(*) FILTER (expected IS NULL) AS missing, round(count(*) FILTER (expected = actual) / count(*), 9) AS rate FROM ({_CASES}) GROUP BY 1")
def accuracy_report(spark, sf_dir):
    return U.accuracy_report(_cases(spark, sf_dir))


@plans.add("confidence_calibration", f"SELECT CASE WHEN confidence >= 0.95 THEN 'high' ELSE 'middle' END AS band, count(*) AS n, round(count(*) FILTER (expected = actual) / count(*), 9) AS correct FROM ({_CASES}) WHERE confidence >= 0.80 AND expected IS NOT NULL GROUP BY 1")
def confidence_calibration(spark, sf_dir):
    return U.confidence_calibration(_cases(spark, sf_dir))


@plans.add("before_after", "SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN a.doc_id IS NULL THEN 'new' WHEN b.doc_id IS NULL THEN 'gone' WHEN b.q > a.t THEN 'improved' WHEN b.q < a.t THEN 'regressed' ELSE 'same' END AS change FROM (SELECT doc_id, max(toxic) AS t FROM labels WHERE doc_id % 5 <> 0 GROUP BY 1) a FULL JOIN (SELECT doc_id, max(quality) AS q FROM labels WHERE doc_id % 7 <> 0 GROUP BY 1) b ON a.doc_id = b.doc_id")
def before_after(spark, sf_dir):
    labels = table(spark, sf_dir, "labels")
    old = labels.where("doc_id % 5 <> 0").groupBy("doc_id").agg(F.max("toxic").alias("score"))
    new = labels.where("doc_id % 7 <> 0").groupBy("doc_id").agg(F.max("quality").alias("score"))
    return U.before_after(old, new, "doc_id", "score")


QUERIES, SQL = plans.QUERIES, plans.SQL
