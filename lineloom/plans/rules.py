"""Rule cascades over the driver tables: events stand for reports and iterations, conversations for replays."""

from __future__ import annotations

from pyspark.sql import functions as F

from lineloom.operators import rules as R
from lineloom.operators.rollup import extract_error_class
from lineloom.plans.base import Plans, table
from lineloom.sources import commits
from lineloom.sources.shared import shared_path

plans = Plans()
NOW = "2024-01-28 12:00:00"
_CAT = "CASE event_id % 5 WHEN 0 THEN 'inaccurate_citation' WHEN 1 THEN 'no_match' WHEN 2 THEN 'tool_not_working' ELSE 'other' END"
_TIER = "CASE user_id % 3 WHEN 0 THEN 'green' WHEN 1 THEN 'yellow' END"
_STATUS = "CASE event_id % 13 WHEN 0 THEN 'error' ELSE 'success' END"


@plans.add("classify_report", f"""WITH r AS (SELECT event_id, {_CAT} AS c, {_TIER} AS t, {_STATUS} AS s, event_id % 6 - 1 AS d, user_id % 10 = 0 AS q, event_id % 4 = 0 AS has FROM events),
k AS (SELECT event_id, CASE WHEN c = 'tool_not_working' THEN 'RULE_INFRASTRUCTURE' WHEN s = 'error' THEN 'RULE_PDF_ERROR' WHEN c = 'inaccurate_citation' AND t = 'green' THEN 'RULE_REAL_BUG_GREEN' WHEN d >= 3 THEN 'RULE_REAL_BUG_DUPS' WHEN q THEN 'RULE_QUARANTINE_HIT' WHEN d > 0 THEN 'RULE_DUPLICATE' WHEN c = 'no_match' AND NOT has THEN 'RULE_NO_MATCH_NOISE' ELSE 'RULE_AMBIGUOUS' END AS rule FROM r)
SELECT event_id, rule, CASE WHEN rule IN ('RULE_INFRASTRUCTURE', 'RULE_PDF_ERROR') THEN 'infrastructure' WHEN rule IN ('RULE_REAL_BUG_GREEN', 'RULE_REAL_BUG_DUPS', 'RULE_QUARANTINE_HIT') THEN 'real_bug' WHEN rule = 'RULE_DUPLICATE' THEN 'duplicate' WHEN rule = 'RULE_NO_MATCH_NOISE' THEN 'noise' ELSE 'ambiguous' END AS classification FROM k""")
def classify_report(spark, sf_dir):
    errors = F.when(F.col("event_id") % 4 == 0, F.array(F.lit("x")))
    dups = F.when(F.col("event_id") % 6 != 0, F.col("event_id") % 6 - 1).otherwise(F.lit(-1))
    verdict = R.classify_report(F.expr(_CAT), F.expr(_TIER), F.expr(_STATUS), errors, dups, F.col("user_id") % 10 == 0)
    return table(spark, sf_dir, "events").select("event_id", verdict.alias("v")).select("event_id", "v.rule", "v.classification")


_CLASS = "CASE event_id % 8 WHEN 0 THEN 'WRONG_CITATION' WHEN 1 THEN 'VERIFIER_DISAGREE' WHEN 2 THEN 'PASS' WHEN 3 THEN 'HARNESS_ERROR' WHEN 4 THEN 'GOOGLE_DOM_DRIFT' WHEN 5 THEN 'WORKER_FALLBACK_FAILED' WHEN 6 THEN 'EXTENSION_NOT_LOADED' ELSE 'UI_BROKEN' END"
_RERUN = "CASE user_id % 4 WHEN 0 THEN 'FLAKE' WHEN 1 THEN 'CONFIRMED' WHEN 2 THEN 'NOT_REPLAYABLE' END"
_BODY = "CASE WHEN event_id % 3 = 0 THEN '<!-- fp: 0123456789ab --> <main >' WHEN event_id % 3 = 1 THEN 'plain' END"
_FAULT = "CASE event_id % 9 WHEN 0 THEN true WHEN 1 THEN false END"
_TRIAGE = f"""SELECT event_id, cl, CASE WHEN rr = 'FLAKE' THEN 'low' WHEN rr = 'CONFIRMED' AND ti IN ('A', 'B') AND cl = 'WRONG_CITATION' THEN 'high' WHEN rr = 'CONFIRMED' AND ti IN ('A', 'B') AND cl = 'VERIFIER_DISAGREE' THEN 'medium'
WHEN (rr IS NULL OR rr = 'NOT_REPLAYABLE') AND cl = 'PASS' THEN 'info' WHEN (rr IS NULL OR rr = 'NOT_REPLAYABLE') AND cl = 'HARNESS_ERROR' THEN 'low'
WHEN cl = 'EXTENSION_NOT_LOADED' OR er THEN 'medium' WHEN cl = 'GOOGLE_DOM_DRIFT' AND bo LIKE '<!-- fp%' THEN 'medium' WHEN fa = false THEN NULL WHEN fa OR cl = 'WORKER_FALLBACK_FAILED' THEN 'medium' END AS severity,
CASE WHEN rr = 'FLAKE' THEN cl WHEN rr = 'CONFIRMED' AND ti IN ('A', 'B') AND cl IN ('WRONG_CITATION', 'VERIFIER_DISAGREE') THEN cl WHEN (rr IS NULL OR rr = 'NOT_REPLAYABLE') AND cl IN ('PASS', 'HARNESS_ERROR') THEN cl
WHEN cl = 'EXTENSION_NOT_LOADED' OR er THEN 'EXTENSION_NOT_LOADED' WHEN cl = 'GOOGLE_DOM_DRIFT' AND bo LIKE '<!-- fp%' THEN cl WHEN fa = false THEN cl WHEN fa OR cl = 'WORKER_FALLBACK_FAILED' THEN 'WORKER_FALLBACK_FAILED' ELSE cl END AS category
FROM (SELECT event_id, {_CLASS} AS cl, {_RERUN} AS rr, CASE event_id % 4 WHEN 0 THEN 'A' WHEN 1 THEN 'B' WHEN 2 THEN 'C' END AS ti, event_id % 17 = 0 AS er, {_BODY} AS bo, {_FAULT} AS fa FROM events)"""


def _triaged(spark, sf_dir):
    tier = F.expr("CASE event_id % 4 WHEN 0 THEN 'A' WHEN 1 THEN 'B' WHEN 2 THEN 'C' END")
    reason = F.when(F.col("event_id") % 17 == 0, "Extension was not loaded, extension not yet loaded")
    verdict = R.triage(F.expr(_CLASS), F.expr(_RERUN), tier, reason, F.expr(_BODY), F.expr(_FAULT))
    return table(spark, sf_dir, "events").select("event_id", verdict.alias("v")).select("event_id", "v.*")


@plans.add("triage_rules", f"SELECT event_id, severity, category FROM ({_TRIAGE})")
def triage_rules(spark, sf_dir):
    return _triaged(spark, sf_dir).select("event_id", "severity", "category")


@plans.add("triage_cluster", f"WITH t AS ({_TRIAGE}), n AS (SELECT category, count(*) AS n FROM t WHERE severity IS NULL GROUP BY 1) SELECT event_id, CASE WHEN severity IS NOT NULL THEN 'heuristic' WHEN n >= 200 THEN 'cluster' ELSE 'single' END AS path FROM t LEFT JOIN n USING (category)")
def triage_cluster(spark, sf_dir):
    return R.cluster_paths(_triaged(spark, sf_dir), "category", "path", least=200).select("event_id", "path")


@plans.add("flake_state", f"""WITH o AS (SELECT user_id, list(CASE WHEN event_type IN ('error', 'view') THEN 'fail' ELSE 'pass' END ORDER BY ts, event_id) AS o, list(ts ORDER BY ts) FILTER (event_type = 'signup') AS h FROM events GROUP BY 1),
w AS (SELECT user_id, o[-10:] AS w, len(list_filter(coalesce(h, []), lambda x: x > TIMESTAMP '{NOW}' - INTERVAL 14 DAY)) AS f FROM o), c AS (SELECT *, len(list_filter(w, lambda x: x = 'fail')) AS k FROM w)
SELECT user_id, CASE WHEN user_id % 11 = 0 THEN 'FLAKE_SUPPRESSED' WHEN len(w) >= 3 AND k = len(w) THEN 'CONFIRMED_BUG' WHEN k >= 7 THEN 'LIKELY_BUG' WHEN k >= 4 THEN 'INTERMITTENT' WHEN f + 1 >= 3 THEN 'FLAKE_ESCALATION' ELSE 'FLAKE' END AS state,
CASE WHEN user_id % 11 = 0 THEN 'skip' WHEN (len(w) >= 3 AND k = len(w)) OR k >= 7 THEN 'auto-fix' WHEN k < 4 AND f + 1 >= 3 THEN 'open-flake-investigation' ELSE 're-quarantine' END AS action FROM c""")
def flake_state(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    outcome = F.when(F.col("event_type").isin("error", "view"), "fail").otherwise("pass")
    rings = R.ring_append(events.withColumn("o", outcome), "user_id", ["ts", "event_id"], "o")
    history = events.where("event_type = 'signup'").groupBy("user_id").agg(F.collect_list("ts").alias("h"))
    now = F.lit(NOW).cast("timestamp")
    until = F.when(F.col("user_id") % 11 == 0, now + F.expr("INTERVAL 1 DAY"))
    return rings.join(history, "user_id", "left").select("user_id", R.flake_state(F.col("ring"), until, F.col("h"), now).alias("s")).select("user_id", "s.*")


@plans.add("ring_append", "SELECT user_id, array_to_string(list(event_type ORDER BY ts, event_id)[-10:], ',') AS ring FROM events GROUP BY 1")
def ring_append(spark, sf_dir):
    return R.ring_append(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "event_type").select("user_id", F.array_join("ring", ",").alias("ring"))


@plans.add("flake_dispatch", f"SELECT state, action, count(*) AS n FROM ({plans.SQL['flake_state']}) GROUP BY ALL")
def flake_dispatch(spark, sf_dir):
    return R.flake_dispatch(flake_state(spark, sf_dir))


@plans.add("promote_gates", "SELECT o_orderkey, CASE WHEN o_orderstatus <> 'F' THEN 'finished' WHEN o_totalprice < 1000 THEN 'price' WHEN o_custkey % 2 = 0 THEN 'customer' END AS failed FROM orders")
def promote_gates(spark, sf_dir):
    gates = [("finished", F.col("o_orderstatus") == "F"), ("price", F.col("o_totalprice") >= 1000), ("customer", F.col("o_custkey") % 2 == 1)]
    return table(spark, sf_dir, "orders").select("o_orderkey", R.promote_gates(gates).alias("failed"))


_DISPATCH = """CASE WHEN event_id % 37 = 0 THEN 'arguments' WHEN event_id % 31 = 0 THEN 'transport' WHEN event_id % 29 = 0 THEN 'fingerprint' WHEN user_id % 9 = 0 THEN 'left-to-people' WHEN event_type = 'view' AND user_id % 9 <> 1 THEN 'no-class' WHEN user_id % 9 = 1 AND event_type NOT IN ('error', 'view') THEN 'many-classes'
WHEN event_id % 5 >= 3 THEN 'attempts' WHEN event_id % 23 = 0 THEN 'branch-exists' WHEN event_id % 19 = 0 THEN 'skip-class' WHEN event_id % 17 = 0 THEN 'dry-run' WHEN event_id % 13 = 0 THEN 'ci-gate' WHEN event_id % 13 = 1 THEN 'cap-blocked' WHEN event_id % 13 = 2 THEN 'contract-error' WHEN event_id % 13 IN (3, 4) THEN CASE WHEN event_id % 2 = 0 THEN 'rounds' ELSE 'again' END WHEN event_id % 13 = 5 THEN 'call'
WHEN event_id % 11 = 0 THEN 'diff-guard' WHEN event_id % 7 = 0 THEN 'commit' ELSE 'done' END"""


@plans.add("dispatcher_gates", f"SELECT event_id, CAST(CASE WHEN gate IN ('attempts', 'cap-blocked') THEN 3 WHEN gate IN ('call', 'diff-guard', 'commit') THEN 1 WHEN gate IN ('arguments', 'transport', 'fingerprint', 'no-class', 'many-classes', 'ci-gate', 'contract-error') THEN 2 ELSE 0 END AS INT) AS code, gate FROM (SELECT event_id, {_DISPATCH} AS gate FROM events)")
def dispatcher_gates(spark, sf_dir):
    """Events as issues; their labels hold the class, some a second one or the mark of issues for people."""
    n = F.col("event_id")
    labels = F.expr("CASE user_id % 9 WHEN 0 THEN array(event_type, 'flake-investigation') WHEN 1 THEN array('error', event_type) ELSE array(event_type) END")
    klass = extract_error_class(F.array_distinct(labels), ["click", "error", "purchase", "signup"])
    answer = F.expr("CASE event_id % 13 WHEN 0 THEN 'ci-gate' WHEN 1 THEN 'cap-blocked' WHEN 2 THEN 'contract-error' WHEN 3 THEN 'malformed' WHEN 4 THEN 'not-applicable' WHEN 5 THEN 'lost' ELSE 'ok' END")
    issue = F.when(n % 37 != 0, n.cast("string"))
    gate = R.dispatcher_gates(issue, F.when(n % 31 == 0, "carrier").otherwise("sdk"), F.when(n % 29 != 0, "f"), labels, klass, n % 5, n % 23 == 0, n % 19 == 0, n % 17 == 0, answer, n % 2, n % 11 == 0, n % 7 != 0)
    return table(spark, sf_dir, "events").select("event_id", gate.alias("g")).select("event_id", "g.*")


@plans.add("quarantine_upsert", "SELECT coalesce(q.k, f.k) AS case_id, CAST(coalesce(runs, 0) + CASE WHEN f.k IS NULL THEN 0 ELSE 1 END AS INT) AS stable_runs, coalesce(runs, 0) + CASE WHEN f.k IS NULL THEN 0 ELSE 1 END >= 3 AS label FROM (SELECT c_custkey AS k, c_custkey % 4 AS runs FROM customer WHERE c_custkey % 2 = 0) q FULL JOIN (SELECT DISTINCT o_custkey AS k FROM orders) f ON q.k = f.k")
def quarantine_upsert(spark, sf_dir):
    held = table(spark, sf_dir, "customer").where("c_custkey % 2 = 0").selectExpr("c_custkey AS case_id", "c_custkey % 4 AS stable_runs")
    return R.quarantine_upsert(held, table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("case_id")), "case_id")


@plans.add("snk_upsert_case", "SELECT c_custkey, name FROM (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY s DESC, name DESC) AS r FROM (SELECT c_custkey, c_name AS name, 0 AS s FROM customer UNION ALL SELECT o_custkey, CAST(o_orderkey AS VARCHAR), 1 FROM orders)) WHERE r = 1")
def snk_upsert_case(spark, sf_dir):
    cases = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").alias("name"))
    news = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderkey").cast("string").alias("name"))
    both = cases.withColumn("n", F.col("name")), news.withColumn("n", F.col("name"))
    return R.upsert_last(*both, "c_custkey", "n").drop("n")


@plans.add("update_one_golden", "SELECT p_partkey, CASE WHEN p_partkey = 7 THEN '9:9' ELSE p_name END AS golden FROM part")
def update_one_golden(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", R.update_golden(F.col("p_partkey"), F.col("p_name"), 7, F.lit("9:9")).alias("golden"))


_PROMOTED = """WITH q AS (SELECT c_custkey AS case_id, c_name AS name FROM customer WHERE c_custkey % 3 <> 0), g AS (SELECT c_custkey AS case_id, c_name AS name FROM customer WHERE c_custkey % 5 = 0), a AS (SELECT DISTINCT o_custkey AS case_id FROM orders WHERE o_orderkey % 2 = 0),
m AS (SELECT q.* FROM q SEMI JOIN a USING (case_id) ANTI JOIN g USING (case_id))
SELECT 'golden' AS place, * FROM g UNION ALL SELECT 'golden', * FROM m UNION ALL SELECT 'quarantine', * FROM q ANTI JOIN m USING (case_id)"""


@plans.add("promote_move", _PROMOTED)
def promote_move(spark, sf_dir):
    """Customers with an even order move from a committed quarantine to a committed golden table."""
    root = shared_path(spark, "promotion")
    cases = table(spark, sf_dir, "customer").selectExpr("c_custkey AS case_id", "c_name AS name", "c_custkey % 4 AS stable_runs")
    commits.commit(spark, root, {"golden": cases.where("case_id % 5 = 0").drop("stable_runs"), "quarantine": cases.where("case_id % 3 <> 0")})
    R.promote_cases(spark, root, table(spark, sf_dir, "orders").where("o_orderkey % 2 = 0").selectExpr("o_custkey AS case_id"), "case_id")
    both = [commits.current(spark, root, place).select(F.lit(place).alias("place"), "case_id", "name") for place in ("golden", "quarantine")]
    return both[0].unionAll(both[1])


#: Patterns of paths that a change may not touch.
PROTECTED_PATHS = [r"^tests/test-cases\.js$", r"^tests/golden/baseline\.json$", r"^tests/e2e/test-cases-quarantine\.js$", r"^\.github/workflows/v40-[^/]*\.yml$", r"^tests/e2e/\.llm-spend-ledger\.json$", r"^\.github/CODEOWNERS$", r"^tests/e2e/\.rerun-ring-buffer\.json$", r"^tests/e2e/\.flake-suppression\.json$", r"^tests/e2e/lib/fix-prompt-builder\.js$", r"^tests/e2e/lib/llm-router\.js$"]
_PATHS = "CASE event_id % 4 WHEN 0 THEN ['src/a.js', 'tests/golden/baseline.json'] WHEN 1 THEN ['.github/workflows/v40-x.yml', '.github/CODEOWNERS'] WHEN 2 THEN ['tests/golden/baseline.json.bak'] ELSE ['.github/workflows/e2e.yml'] END"


@plans.add("diff_guard", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'tests/golden/baseline.json' WHEN 1 THEN '.github/workflows/v40-x.yml,.github/CODEOWNERS' ELSE '' END AS violations FROM events")
def diff_guard(spark, sf_dir):
    paths = F.expr(_PATHS.replace("[", "array(").replace("]", ")"))
    return table(spark, sf_dir, "events").select("event_id", F.array_join(R.diff_guard(paths, PROTECTED_PATHS), ",").alias("violations"))


@plans.add("fenced_diff", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'a' || event_id END AS diff FROM events")
def fenced_diff(spark, sf_dir):
    text = F.expr("CASE event_id % 3 WHEN 0 THEN concat('x <<<DIFF\\na', event_id, '\\nDIFF>>> y') WHEN 1 THEN '<<<DIFF a DIFF>>> <<<DIFF' ELSE 'DIFF>>> <<<DIFF' END")
    return table(spark, sf_dir, "events").select("event_id", R.fenced_diff(text).alias("diff"))


@plans.add("overfit_scan", "SELECT doc_id, count(*) AS hits FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE contains(line, 'the') GROUP BY 1")
def overfit_scan(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    headers = lines.select("doc_id").distinct().select("doc_id", F.lit(-1).alias("n"), F.lit("+++ b/src/main").alias("line"))
    diff = headers.unionByName(lines.withColumn("line", F.concat(F.lit("+"), "line"))).withColumn("token", F.lit("the"))
    return R.overfit_scan(diff, ["doc_id"], "n", "line", "token").groupBy("doc_id").agg(F.count("*").alias("hits"))


@plans.add("affected_cases", "SELECT event_id, 'US' || event_id || '-a,US' || user_id || '-b' AS cases FROM events")
def affected_cases(spark, sf_dir):
    body = F.expr("concat('text <!-- affected_cases: US', event_id, '-a, \\n US', user_id, '-b ,, --> more')")
    return table(spark, sf_dir, "events").select("event_id", F.array_join(R.affected_cases(body), ",").alias("cases"))


@plans.add("source_issue", "SELECT event_id, CASE event_id % 3 WHEN 0 THEN user_id WHEN 1 THEN event_id END AS issue FROM events")
def source_issue(spark, sf_dir):
    body = F.expr("CASE event_id % 3 WHEN 0 THEN concat('Fixes #5 <!-- source_issue: ', user_id, ' -->') WHEN 1 THEN concat('fix #', event_id) ELSE 'prefix #3' END")
    return table(spark, sf_dir, "events").select("event_id", R.source_issue(body).alias("issue"))


@plans.add("case_fingerprint", "SELECT event_id, substr(sha256(event_id || '|' || event_type || '|' || CASE WHEN event_id % 5 = 0 THEN '' ELSE substr(sha256(substr(props, 1, 200)), 1, 12) END), 1, 12) AS fp FROM events")
def case_fingerprint(spark, sf_dir):
    reason = R.reason_hash(F.when(F.col("event_id") % 5 != 0, F.col("props")))
    return table(spark, sf_dir, "events").select("event_id", R.case_fingerprint(F.col("event_id").cast("string"), F.col("event_type"), reason).alias("fp"))


@plans.add("reason_hash", "SELECT event_id, substr(sha256(substr(props, 1, 200)), 1, 12) AS h FROM events")
def reason_hash(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", R.reason_hash(F.col("props")).alias("h"))


@plans.add("recently_updated", f"SELECT event_id, ts >= TIMESTAMP '{NOW}' - INTERVAL 7 DAY AS recent, ts >= TIMESTAMP '{NOW}' - INTERVAL 30 DAY AS in_window, ts >= TIMESTAMP '2024-02-10 12:00:00' - INTERVAL 30 DAY AS in_later_window FROM events")
def recently_updated(spark, sf_dir):
    """Both windows end at the same time; the 30 days are asked once more at a later time, when they begin within the events."""
    at, (now, later) = F.col("ts"), (F.lit(t).cast("timestamp_ntz") for t in (NOW, "2024-02-10 12:00:00"))
    return table(spark, sf_dir, "events").select("event_id", R.within(at, now, 7).alias("recent"), R.within(at, now, 30).alias("in_window"), R.within(at, later, 30).alias("in_later_window"))


@plans.add("post_fix_suppressed", """WITH f AS (SELECT o_custkey AS c FROM orders WHERE o_orderstatus = 'F' AND o_orderdate >= DATE '1998-08-03' - INTERVAL 30 DAY AND o_orderdate <= DATE '1998-08-03' UNION SELECT o_custkey + 1 FROM orders WHERE o_orderstatus = 'O' AND o_orderdate >= DATE '1998-08-03' - INTERVAL 30 DAY AND o_orderdate <= DATE '1998-08-03' AND o_orderkey % 2 = 0 UNION SELECT o_custkey + 2 FROM orders WHERE o_orderstatus = 'P')
SELECT c_custkey, c_custkey IN (SELECT c FROM f) AS suppressed FROM customer""")
def post_fix_suppressed(spark, sf_dir):
    """Orders as merged pull requests (a fix's branch or another) that name customers, and as closed issues."""
    orders = table(spark, sf_dir, "orders")
    body = F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("fixes `"), "o_custkey", F.lit("`"))).otherwise(F.concat(F.lit("fixes `"), F.col("o_custkey") + 1, F.lit("`, not "), F.col("o_custkey") + 3))
    branch = F.when((F.col("o_orderstatus") == "F") | (F.col("o_orderkey") % 2 == 0), "auto-fix/x").otherwise("feature/x")
    pulls = orders.where("o_orderstatus IN ('F', 'O')").select(branch.alias("branch"), body.alias("body"), F.col("o_orderdate").cast("timestamp").alias("merged_at"))
    closed = orders.where("o_orderstatus = 'P'").select((F.col("o_custkey") + 2).cast("string").alias("case"))
    cases = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_custkey").cast("string").alias("case"))
    return R.post_fix_suppressed(cases, pulls, closed, "case", "auto-fix/", F.lit("1998-08-03").cast("timestamp")).select("c_custkey", "suppressed")


@plans.add("promotion_plan", "SELECT o_orderkey, CASE WHEN s THEN 'suppressed' WHEN c = 'real_bug' AND b >= 5 THEN 'cap' WHEN c = 'real_bug' AND k THEN 'dedup' WHEN c = 'real_bug' THEN 'auto' WHEN c = 'noise' THEN 'wontfix' ELSE 'skip' END AS plan FROM (SELECT *, coalesce(sum(CAST(NOT s AND c = 'real_bug' AND NOT k AS INT)) OVER (ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM (SELECT o_orderkey, o_custkey % 9 = 0 AS s, o_custkey % 4 = 0 AS k, CASE o_orderkey % 3 WHEN 0 THEN 'real_bug' WHEN 1 THEN 'noise' ELSE 'duplicate' END AS c FROM orders))")
def promotion_plan(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 9 == 0).alias("suppressed"), (F.col("o_custkey") % 4 == 0).alias("known"), F.expr("CASE o_orderkey % 3 WHEN 0 THEN 'real_bug' WHEN 1 THEN 'noise' ELSE 'duplicate' END").alias("classification"))
    return R.promotion_plan(rows, ["o_orderkey"]).select("o_orderkey", "plan")


@plans.add("partition_outdated", "SELECT p_partkey, CASE WHEN p_size > 40 THEN 'skipped' WHEN p_size < 5 THEN 'security' WHEN p_partkey % 3 = 0 THEN 'major' ELSE 'minor' END AS lane FROM part")
def partition_outdated(spark, sf_dir):
    parts = table(spark, sf_dir, "part")
    rows = parts.select("p_partkey", F.when(F.col("p_partkey") % 3 == 0, "major").otherwise("minor").alias("step"))
    return R.partition_outdated(rows, parts.where("p_size <= 40"), parts.where("p_size < 5"), "p_partkey").select("p_partkey", "lane")


@plans.add("case_to_patent", "SELECT p_partkey, CASE WHEN p_partkey % 3 <> 0 THEN 'US' || p_partkey || 'B2' END AS patent, p_partkey % 3 <> 0 AS valid FROM part")
def case_to_patent(spark, sf_dir):
    case = F.expr("CASE WHEN p_partkey % 3 <> 0 THEN concat('US', p_partkey, 'B2-claims-', p_size) ELSE concat('us', p_partkey, '-X') END")
    return table(spark, sf_dir, "part").select("p_partkey", R.case_to_patent(case).alias("patent"), R.case_id_valid(case).alias("valid"))


@plans.add("case_id_valid", "SELECT event_id, event_id % 6 IN (0, 1, 2) AS valid FROM events")
def case_id_valid(spark, sf_dir):
    case = F.expr("CASE event_id % 6 WHEN 0 THEN concat('US', event_id, 'B2-claims-', user_id) WHEN 1 THEN 'PRE-FLIGHT-DOM-DRIFT' WHEN 2 THEN concat('EP', event_id, '-x') WHEN 3 THEN 'PRE-FLIGHT' WHEN 4 THEN concat('US', event_id, '-claims;rm') END")
    return table(spark, sf_dir, "events").select("event_id", R.case_id_valid(case).alias("valid"))


@plans.add("validate_selection", "SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'not json' WHEN 1 THEN 'missing category' WHEN 2 THEN 'bad patentId' WHEN 3 THEN 'too short' END AS reason FROM events")
def validate_selection(spark, sf_dir):
    raw = F.expr("""CASE event_id % 5 WHEN 0 THEN '{oops' ELSE to_json(named_struct('caseId', 'c', 'patentId', if(event_id % 5 = 2, 'EP1', 'US1234567B2'), 'selectedText', repeat('abcde ', if(event_id % 5 = 3, 2, 20)), 'category', if(event_id % 5 = 1, '', 'x'), 'rationale', 'r')) END""")
    return table(spark, sf_dir, "events").select("event_id", R.validate_selection(raw).alias("reason"))


@plans.add("parse_llm_envelope", "SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'timeout' WHEN 1 THEN 'empty' WHEN 2 THEN 'json_error' WHEN 3 THEN 'api_error' ELSE 'ok' END AS outcome FROM events")
def parse_llm_envelope(spark, sf_dir):
    raw = F.expr("""CASE event_id % 5 WHEN 1 THEN ' ' WHEN 2 THEN '{"a"' WHEN 3 THEN '{"is_error": true}' ELSE '{"is_error": false, "result": "x"}' END""")
    return table(spark, sf_dir, "events").select("event_id", R.parse_envelope(raw, F.col("event_id") % 5 == 0).alias("outcome"))


@plans.add("parse_llm_single", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'HARNESS_ERROR' ELSE 'UI_BROKEN' END AS category, CASE event_id % 3 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' ELSE 'high' END AS severity FROM events")
def parse_llm_single(spark, sf_dir):
    raw = F.expr("""CASE event_id % 3 WHEN 0 THEN 'no json' WHEN 1 THEN '{"severity": "dire", "category": "UI_BROKEN"}' ELSE '{"severity": "high", "category": "UI_BROKEN"}' END""")
    return table(spark, sf_dir, "events").select("event_id", R.parse_single(raw).alias("v")).select("event_id", "v.*")


@plans.add("parse_llm_cluster", "SELECT event_id, CASE WHEN event_id % 3 = 0 AND user_id % 4 <> 0 THEN 'high' ELSE 'HARNESS_ERROR' END AS found FROM events")
def parse_llm_cluster(spark, sf_dir):
    """An answer for each day's events of a user; those of every fourth user are no JSON, and each names a stranger."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", F.concat_ws("|", "user_id", F.to_date("ts")).alias("cluster"))
    named = F.collect_list(F.when(F.col("event_id") % 3 == 0, F.struct("event_id", F.lit("high").alias("severity"))))
    stranger = F.array(F.struct((F.max("event_id") + 1_000_000_000).alias("event_id"), F.lit("low").alias("severity")))
    answers = events.groupBy("cluster", "user_id").agg(F.to_json(F.concat(named, stranger)).alias("raw"))
    answers = answers.withColumn("raw", F.when(F.col("user_id") % 4 == 0, F.substring("raw", 1, 5)).otherwise(F.col("raw"))).drop("user_id")
    return R.parse_cluster(events, answers, "event_id", "raw", "found", "cluster").select("event_id", "found")


@plans.add("classify_iteration", "SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'LLM_HALLUCINATED_SELECTION' WHEN event_id % 4 = 1 THEN 'HARNESS_ERROR' WHEN event_id % 4 = 2 THEN 'VERIFIER_DISAGREE' ELSE 'PASS' END AS classification FROM events")
def classify_iteration(spark, sf_dir):
    n = F.col("event_id") % 4
    return table(spark, sf_dir, "events").select("event_id", R.classify_iteration(n != 0, n != 1, n != 2).alias("classification"))


@plans.add("route_model", "SELECT event_id, CASE event_type WHEN 'error' THEN 'large' WHEN 'view' THEN 'small' ELSE 'medium' END AS route FROM events")
def route_model(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", R.route(F.col("event_type"), {"error": "large", "view": "small"}, F.lit("medium")).alias("route"))


@plans.add("escalation_map", "SELECT event_id, CASE event_type WHEN 'error' THEN 'build' WHEN 'view' THEN 'skip' ELSE 'unsupported-class:' || event_type END AS action FROM events")
def escalation_map(spark, sf_dir):
    unsupported = F.concat(F.lit("unsupported-class:"), "event_type")
    return table(spark, sf_dir, "events").select("event_id", R.route(F.col("event_type"), {"error": "build", "view": "skip"}, unsupported).alias("action"))


_STATE = "CASE event_id % 5 WHEN 0 THEN 'idle' WHEN 1 THEN 'fetching' WHEN 2 THEN 'parsing' WHEN 3 THEN 'no-text-layer' ELSE 'parsed' END"
_EVENT = "CASE user_id % 6 WHEN 0 THEN 'link_found' WHEN 1 THEN 'downloaded' WHEN 2 THEN 'parsed' WHEN 3 THEN 'failed' WHEN 4 THEN 'fallback' ELSE 'no_text' END"


@plans.add("parse_status_machine", f"SELECT event_id, CASE WHEN s = 'idle' AND e = 'link_found' THEN 'fetching' WHEN s = 'fetching' AND e = 'downloaded' THEN 'parsing' WHEN s = 'parsing' AND e = 'parsed' THEN 'parsed' WHEN s = 'parsing' AND e = 'no_text' THEN 'no-text-layer' WHEN s IN ('fetching', 'parsing') AND e = 'failed' THEN 'error' WHEN s = 'no-text-layer' AND e = 'fallback' THEN 'fetching' ELSE s END AS next FROM (SELECT event_id, {_STATE} AS s, {_EVENT} AS e FROM events)")
def parse_status_machine(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", R.parse_status_next(F.expr(_STATE), F.expr(_EVENT)).alias("next"))


@plans.add("pdf_parse_status", f"SELECT event_id, CASE WHEN user_id % 4 = 0 THEN 'skipped' WHEN s = 'parsed' AND user_id % 3 = 0 THEN 'cache-hit' WHEN s = 'parsed' THEN 'success' WHEN s = 'no-text-layer' THEN 'failed' END AS status FROM (SELECT *, {_STATE} AS s FROM events)")
def pdf_parse_status(spark, sf_dir):
    kind = F.when(F.col("user_id") % 4 == 0, "application").otherwise("grant")
    return table(spark, sf_dir, "events").select("event_id", R.pdf_parse_status(kind, F.expr(_STATE), F.when(F.col("user_id") % 3 != 0, "network")).alias("status"))


@plans.add("filing_filter_cases", "SELECT doc_id FROM labels WHERE quality = 0 AND toxic = 1")
def filing_filter_cases(spark, sf_dir):
    return R.filing_cases(table(spark, sf_dir, "labels"), F.col("quality") == 0, F.col("toxic") == 1).select("doc_id")


@plans.add("filing_filter_findings", "SELECT c.conv_id, c.turn FROM conversations c JOIN (SELECT conv_id FROM conversations GROUP BY 1 HAVING count(*) >= 4) r ON c.conv_id = r.conv_id WHERE c.role = 'user'")
def filing_filter_findings(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    return R.filing_findings(turns, "conv_id", F.col("role") == "user", 4).select("conv_id", "turn")


@plans.add("issue_payload", "SELECT event_id, '## ' || event_type || chr(10) || CASE WHEN length(props) > 8 THEN substr(props, 1, 5) || '...' ELSE props END || chr(10) || 'value ' || user_id AS body FROM events")
def issue_payload(spark, sf_dir):
    sections = [(F.concat(F.lit("## "), F.col("event_type")), None), (F.col("props"), 8), (F.concat(F.lit("value "), F.col("user_id").cast("string")), None)]
    return table(spark, sf_dir, "events").select("event_id", R.issue_payload(sections).alias("body"))


@plans.add("issue_body", "SELECT doc_id, '## Failure of D' || doc_id || chr(10) || chr(10) || '| Field | Value |' || chr(10) || '|-------|-------|' || chr(10) || '| Language | ' || coalesce(nullif(lang, ''), 'n/a') || ' |' || chr(10) || '| Citation | ' || CASE WHEN doc_id % 3 = 0 THEN 'n/a' ELSE '1:' || doc_id END || ' |' || chr(10) || chr(10) || '**Verifier reason:**' || chr(10) || chr(10) || '```' || chr(10) || substr(coalesce(text, ''), 1, 1000) || chr(10) || '```' || chr(10) || chr(10) || '<!-- fingerprint: ' || substr(sha256(CAST(doc_id AS VARCHAR)), 1, 12) || ' -->' AS body FROM documents")
def issue_body(spark, sf_dir):
    name = F.col("doc_id").cast("string")
    fields = [("Language", F.col("lang")), ("Citation", F.when(F.col("doc_id") % 3 != 0, F.concat(F.lit("1:"), name)))]
    body = R.issue_body(F.concat(F.lit("Failure of D"), name), fields, F.col("text"), F.substring(F.sha2(name, 256), 1, 12))
    return table(spark, sf_dir, "documents").select("doc_id", body.alias("body"))


@plans.add("submit_guard", "SELECT doc_id, length(trim(text)) AS n FROM documents WHERE trim(text) <> '' AND doc_id % 10 <> 0")
def submit_guard(spark, sf_dir):
    return R.submit_guard(table(spark, sf_dir, "documents"), "text", F.col("doc_id") % 10 == 0).select("doc_id", F.length("text").cast("long").alias("n"))


@plans.add("copy_all", "SELECT conv_id, string_agg(role, chr(10) ORDER BY turn) AS copied FROM conversations WHERE turn <> 1 GROUP BY 1")
def copy_all(spark, sf_dir):
    return R.copy_all(table(spark, sf_dir, "conversations").withColumn("role", F.when(F.col("turn") != 1, F.col("role"))), "conv_id", "turn", "role")


@plans.add("pick_newest_after", "SELECT user_id, arg_max(event_id, (ts, event_id)) AS run FROM events WHERE ts >= TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 1 SECOND GROUP BY 1")
def pick_newest_after(spark, sf_dir):
    return R.newest_after(table(spark, sf_dir, "events"), "user_id", "event_id", "ts", F.lit("2024-01-20 00:00:00").cast("timestamp_ntz"))


@plans.add("verify_n_runs", "SELECT conv_id, bool_and(role IN ('user', 'assistant')) AS passed FROM conversations GROUP BY 1")
def verify_n_runs(spark, sf_dir):
    return R.all_pass(table(spark, sf_dir, "conversations"), "conv_id", F.col("role").isin("user", "assistant"))


@plans.add("ledger_write_guard", "SELECT event_id, CASE WHEN user_id % 5 = 0 THEN 'unknown transport' WHEN event_id % 3 = 0 AND user_id % 5 <> 1 THEN 'outside ci' END AS refused FROM events")
def ledger_write_guard(spark, sf_dir):
    kind = F.expr("CASE user_id % 5 WHEN 0 THEN 'carrier' WHEN 1 THEN 'subscription' ELSE 'sdk' END")
    return table(spark, sf_dir, "events").select("event_id", R.ledger_write_guard(kind, F.col("event_id") % 3 != 0).alias("refused"))


@plans.add("report_fix_flow", "SELECT event_id, CASE WHEN user_id % 7 = 0 THEN 'pr-exists' WHEN value > 100 THEN 'cap' WHEN event_id % 4 = 0 THEN 'malformed' WHEN event_id % 4 = 1 THEN 'forbidden' ELSE 'built' END AS reason FROM events")
def report_fix_flow(spark, sf_dir):
    n = F.col("event_id") % 4
    return table(spark, sf_dir, "events").select("event_id", R.report_fix(F.col("user_id") % 7 == 0, F.col("value") > 100, n != 0, n != 1).alias("reason"))


@plans.add("manual_bump_note", "SELECT user_id, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY event_id) AS notes FROM events WHERE event_type = 'signup' GROUP BY 1")
def manual_bump_note(spark, sf_dir):
    news = table(spark, sf_dir, "events").where("event_type = 'signup'").select("user_id", "event_id", F.col("event_id").cast("string").alias("note"))
    held = news.select("user_id").distinct().withColumn("notes", F.lit(None).cast("array<string>"))
    return R.append_notes(held, news, "user_id", "event_id", "note").select("user_id", F.array_join("notes", ",").alias("notes"))


QUERIES, SQL = plans.QUERIES, plans.SQL
