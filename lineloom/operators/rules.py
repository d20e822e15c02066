"""Ordered rule cascades, gates and state machines; the first rule that fits decides."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Fixed values.
DUP_THRESHOLD = 3
CATEGORIES = ["inaccurate_citation", "no_match", "tool_not_working", "other"]
TRIAGE_CLUSTER = 5
RING = 10
SEVERITIES = ["critical", "high", "medium", "low", "info"]
FLAKE_DAYS, FLAKE_COUNT, SUPPRESS_DAYS = 14, 3, 30


def cascade(rules: Sequence[tuple[Column, Column]], default: Column) -> Column:
    """The value of the first rule whose condition holds; a null condition does not hold."""
    out = None
    for test, value in rules:
        out = F.when(test, value) if out is None else out.when(test, value)
    return out.otherwise(default)


def _verdict(classification: str, rule: str) -> Column:
    return F.struct(F.lit(classification).alias("classification"), F.lit(rule).alias("rule"))


def classify_report(category: Column, tier: Column, parse_status: Column, errors: Column, dups: Column, quarantined: Column, threshold: int = DUP_THRESHOLD) -> Column:
    dups = F.coalesce(dups, F.lit(0))
    return cascade(
        [
            (category == "tool_not_working", _verdict("infrastructure", "RULE_INFRASTRUCTURE")),
            (parse_status == "error", _verdict("infrastructure", "RULE_PDF_ERROR")),
            ((category == "inaccurate_citation") & (tier == "green"), _verdict("real_bug", "RULE_REAL_BUG_GREEN")),
            (dups >= threshold, _verdict("real_bug", "RULE_REAL_BUG_DUPS")),
            (quarantined, _verdict("real_bug", "RULE_QUARANTINE_HIT")),
            (dups > 0, _verdict("duplicate", "RULE_DUPLICATE")),
            ((category == "no_match") & (F.coalesce(F.size(errors), F.lit(0)) <= 0), _verdict("noise", "RULE_NO_MATCH_NOISE")),
        ],
        _verdict("ambiguous", "RULE_AMBIGUOUS"),
    )


def triage(classification: Column, rerun: Column, verifier_tier: Column, error_reason: Column, issue_body: Column, fault: Column) -> Column:
    """A struct of severity, category and path; path `ambiguous` leaves the row to the clusters.

    fault is true, false or null (not supplied); an explicit false outranks the class.
    """

    def out(severity: Column, category: Column | None = None) -> Column:
        return F.struct(severity.alias("severity"), (classification if category is None else category).alias("category"), F.lit("heuristic").alias("path"))

    strong = {"WRONG_CITATION": "high", "VERIFIER_DISAGREE": "medium"}
    settled = {"LLM_HALLUCINATED_SELECTION": "critical", "LLM_API_ERROR": "medium", "HARNESS_ERROR": "low", "PASS": "info"}

    def by(table: dict[str, str]) -> Column:
        return cascade([(classification == k, F.lit(v)) for k, v in table.items()], F.lit(None))

    mutated = issue_body.rlike("<!-- fp: [0-9a-f]{12} -->") & issue_body.rlike(r"""(?:patent-result|section\[itemprop="claims"\]|<main(?:\s|>)|<article(?:\s|>)|["']main["']|["']article["'])""")
    nothing = F.struct(F.lit(None).cast("string").alias("severity"), classification.alias("category"), F.lit("ambiguous").alias("path"))
    return cascade(
        [
            (rerun == "FLAKE", out(F.lit("low"))),
            ((rerun == "CONFIRMED") & verifier_tier.isin("A", "B") & classification.isin(*strong), out(by(strong))),
            ((rerun.isNull() | (rerun == "NOT_REPLAYABLE")) & classification.isin(*settled), out(by(settled))),
            ((classification == "EXTENSION_NOT_LOADED") | error_reason.rlike("(?i)extension (?:not.*loaded|failed.*attach)"), out(F.lit("medium"), F.lit("EXTENSION_NOT_LOADED"))),
            ((classification == "GOOGLE_DOM_DRIFT") & mutated, out(F.lit("medium"))),
            (fault == F.lit(False), nothing),
            (fault | (classification == "WORKER_FALLBACK_FAILED"), out(F.lit("medium"), F.lit("WORKER_FALLBACK_FAILED"))),
        ],
        nothing,
    )


def cluster_paths(df: DataFrame, category: str, path: str, least: int = TRIAGE_CLUSTER) -> DataFrame:
    """Ambiguous rows of a class with `least` of them go to one cluster call, others one by one. Class sizes come from
    a pre-aggregated count, so a large class is not gathered."""
    sizes = df.where(F.col(path) == "ambiguous").groupBy(category).agg(F.count("*").alias("__n"))
    met = df.join(sizes, category, "left")
    return met.withColumn(path, F.when(F.col(path) == "ambiguous", F.when(F.col("__n") >= least, "cluster").otherwise("single")).otherwise(F.col(path))).drop("__n")


def flake_state(outcomes: Column, until: Column, history: Column, now: Column) -> Column:
    """A struct of state and action from the outcomes ring, an active suppression's end and earlier flakes' times."""
    last = F.slice(outcomes, F.greatest(F.size(outcomes) - RING + 1, F.lit(1)), F.lit(RING))
    fails = F.size(F.filter(last, lambda o: o == "fail"))

    def out(state: str, action: str) -> Column:
        return F.struct(F.lit(state).alias("state"), F.lit(action).alias("action"))

    recent = F.size(F.filter(F.coalesce(history, F.array().cast("array<timestamp>")), lambda h: h > now - F.expr(f"INTERVAL {FLAKE_DAYS} DAY")))
    return cascade(
        [
            (until > now, out("FLAKE_SUPPRESSED", "skip")),
            ((F.size(last) >= 3) & (fails == F.size(last)), out("CONFIRMED_BUG", "auto-fix")),
            (fails >= 7, out("LIKELY_BUG", "auto-fix")),
            (fails >= 4, out("INTERMITTENT", "re-quarantine")),
            (recent + 1 >= FLAKE_COUNT, out("FLAKE_ESCALATION", "open-flake-investigation")),
        ],
        out("FLAKE", "re-quarantine"),
    )


def flake_dispatch(states: DataFrame) -> DataFrame:
    """states (state, action) -> state, action, n: one ledger row for each branch that is taken, with how often."""
    return states.groupBy("state", "action").agg(F.count("*").alias("n"))


def ring_append(df: DataFrame, key: str, order: Sequence[str], value: str, size: int = RING) -> DataFrame:
    """The last `size` values of each key in order. Each task keeps its own last ones first, so a hot key is small."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*[F.desc(o) for o in order]))
    last = df.select(key, *order, value).withColumn("__r", rank).where(F.col("__r") <= size)
    return last.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct(*order, F.col(value).alias("v")))), lambda s: s["v"]).alias("ring"))


def promote_gates(gates: Sequence[tuple[str, Column]]) -> Column:
    """The name of the first gate that does not hold, or null if all do."""
    return F.coalesce(*[F.when(~F.coalesce(test, F.lit(False)), F.lit(name)) for name, test in gates])


def quarantine_upsert(table: DataFrame, found: DataFrame, key: str, label_at: int = 3) -> DataFrame:
    """stable_runs + 1 for a known case, 1 for a new one, unchanged for one not found; `label` from label_at runs on."""
    seen = found.select(key).distinct().withColumn("__f", F.lit(1))
    runs = F.coalesce("stable_runs", F.lit(0)) + F.coalesce("__f", F.lit(0))
    return table.join(seen, key, "full").select(key, runs.cast("int").alias("stable_runs"), (runs >= label_at).alias("label"))


def upsert_last(table: DataFrame, news: DataFrame, key: str, order: str) -> DataFrame:
    """Rows replaced by key, the last news of a key counting."""
    from lineloom.operators.relational import keep_last

    both = table.withColumn("__s", F.lit(0)).unionByName(news.withColumn("__s", F.lit(1)))
    return keep_last(both, [key], ["__s", order]).drop("__s")


def diff_guard(paths: Column, patterns: Sequence[str]) -> Column:
    """The paths that a protected pattern fits, in their order."""
    return F.filter(paths, lambda p: F.exists(F.array(*map(F.lit, patterns)), lambda x: F.regexp_like(p, x)))


def fenced_diff(text: Column, start: str = "<<<DIFF", end: str = "DIFF>>>") -> Column:
    """What stands between the markers if there is just one of each, in order; else null."""
    once = (F.regexp_count(text, F.lit(start)) == 1) & (F.regexp_count(text, F.lit(end)) == 1)
    found = F.regexp_extract(text, f"(?s){start}\\n?(.*?)\\n?{end}", 1)
    return F.when(once & text.rlike(f"(?s){start}.*{end}"), found)


def affected_cases(body: Column) -> Column:
    inner = F.regexp_extract(body, r"(?s)<!--\s*affected_cases:\s*(.*?)\s*-->", 1)
    return F.filter(F.transform(F.split(inner, r"[,\n]"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")


def source_issue(body: Column) -> Column:
    comment = F.nullif(F.regexp_extract(body, r"<!--\s*source_issue:\s*(\d+)\s*-->", 1), F.lit(""))
    fixes = F.nullif(F.regexp_extract(body, r"(?i)\bfix(?:es)?\s+#(\d+)", 1), F.lit(""))
    return F.coalesce(comment, fixes).try_cast("long")


def case_fingerprint(case: Column, error_class: Column, reason_hash: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", case, error_class, F.coalesce(reason_hash, F.lit(""))), 256), 1, 12)


def reason_hash(reason: Column) -> Column:
    return F.when(reason != "", F.substring(F.sha2(F.substring(reason, 1, 200), 256), 1, 12))


def triage_hash(rationale: Column, verifier_status: Column, classification: Column) -> Column:
    """A hash of three fields as JSON, nulls written out: the rationale's first 30 characters, the verifier's status
    and the class."""
    row = F.struct(F.substring(F.coalesce(rationale, F.lit("")), 1, 30).alias("rationale_first_30_chars"), verifier_status.alias("verifier_status"), classification.alias("classification"))
    return F.substring(F.sha2(F.to_json(row, {"ignoreNullFields": "false"}), 256), 1, 12)


def within(at: Column, now: Column, days: int) -> Column:
    """Not older than `days`; a null time is older."""
    return F.coalesce(at >= now - F.expr(f"INTERVAL {days} DAY"), F.lit(False))


def case_to_patent(case: Column) -> Column:
    return F.nullif(F.regexp_extract(case, r"^([A-Z]{2}\d+[A-Z]?\d*)-", 1), F.lit(""))


def case_id_valid(case: Column) -> Column:
    """A document's number and a name, or the form of checks before a run; null is not one."""
    return F.coalesce(case.rlike(r"^(?:[A-Z]{2,}[0-9]+[A-Z]?[0-9]*-[a-z0-9-]+|PRE-FLIGHT-[A-Z-]+)\z"), F.lit(False))


def validate_selection(raw: Column) -> Column:
    """The first reason why a proposed selection is not usable, or null."""
    fields = ["caseId", "patentId", "selectedText", "category", "rationale"]
    row = F.from_json(raw, ", ".join(f"{f} string" for f in fields))
    text = F.length(row["selectedText"])
    missing = [(row[f].isNull() | (row[f] == ""), F.lit(f"missing {f}")) for f in fields]
    return cascade([(F.try_parse_json(raw).isNull(), F.lit("not json")), *missing, (~row["patentId"].rlike(r"^US\d{6,8}[A-Z]?\d?$"), F.lit("bad patentId")), (text < 50, F.lit("too short")), (text > 300, F.lit("too long"))], F.lit(None))


def parse_envelope(raw: Column, timed_out: Column) -> Column:
    """timeout, empty, json_error, api_error or ok."""
    row = F.from_json(raw, "is_error boolean, result string")
    return cascade([(timed_out, F.lit("timeout")), (raw.isNull() | (F.trim(raw) == ""), F.lit("empty")), (F.try_parse_json(raw).isNull(), F.lit("json_error")), (row["is_error"], F.lit("api_error"))], F.lit("ok"))


def parse_single(raw: Column) -> Column:
    """A struct of category and severity from an answer about one row; an answer that is no JSON is a harness error of
    low severity, a severity not known is medium."""
    row, good = F.from_json(raw, "severity string, category string"), F.try_parse_json(raw).isNotNull()
    severity = cascade([(~good, F.lit("low")), (row["severity"].isin(*SEVERITIES), row["severity"])], F.lit("medium"))
    return F.struct(F.when(good, row["category"]).otherwise("HARNESS_ERROR").alias("category"), severity.alias("severity"))


def parse_cluster(df: DataFrame, answers: DataFrame, key: str, raw: str, out: str, cluster: str | None = None) -> DataFrame:
    """df with the severity that an answer (a JSON array of key and severity) gives its row; rows that no answer names
    are harness errors. The last of several severities in the order of their names counts. With `cluster`, a column of both,
    an answer speaks for the rows of its own cluster alone; only what answers name is joined."""
    kind = df.schema[key].dataType.simpleString()
    own = [cluster] if cluster else []
    found = answers.select(*own, F.explode(F.from_json(raw, f"array<struct<{key}: {kind}, severity: string>>")).alias("r")).select(*own, F.col(f"r.{key}").alias(key), "r.severity")
    named = found.groupBy(*own, key).agg(F.max("severity").alias("__s"))
    return df.join(named, [*own, key], "left").withColumn(out, F.coalesce("__s", F.lit("HARNESS_ERROR"))).drop("__s")


def route(kind: Column, routes: dict[str, str], default: Column) -> Column:
    """The route of a kind, or the default (also of a null kind)."""
    return cascade([(kind == k, F.lit(v)) for k, v in routes.items()], default)


def update_golden(case: Column, golden: Column, changed: str | int, value: Column) -> Column:
    """The golden value with that of one case replaced; all others as they were."""
    return F.when(case == F.lit(changed), value).otherwise(golden)


def promote_move(stable_runs: Column, at: int = 3) -> Column:
    """Where a case stands: golden from `at` stable runs on, else quarantine (also with none counted)."""
    return F.when(stable_runs >= at, "golden").otherwise("quarantine")


def promoted(quarantine: DataFrame, golden: DataFrame, wanted: DataFrame, key: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(golden, quarantine, outcome): the wanted cases of the quarantine that are not golden yet move over, with golden's
    columns; outcome is promoted, not_in_quarantine or already_golden for each wanted key."""
    asked = wanted.select(key).distinct()
    there = quarantine.select(key).distinct().withColumn("__q", F.lit(True))
    known = golden.select(key).distinct().withColumn("__g", F.lit(True))
    outcome = F.when(F.col("__q").isNull(), "not_in_quarantine").when(F.col("__g"), "already_golden").otherwise("promoted")
    outcomes = asked.join(there, key, "left").join(known, key, "left").select(key, outcome.alias("outcome"))
    moving = outcomes.where("outcome = 'promoted'").select(key)
    new = golden.unionByName(quarantine.join(moving, key, "left_semi").select(*golden.columns))
    return new, quarantine.join(moving, key, "left_anti"), outcomes


def promote_cases(spark: SparkSession, root: str, wanted: DataFrame, key: str, golden: str = "golden", quarantine: str = "quarantine") -> DataFrame:
    """Move the wanted cases between two committed tables below root and return their outcomes. Both tables change in one
    commit; if either write fails, both stay as they were."""
    from lineloom.sources import commits
    from lineloom.sources.shared import shared_path

    new, left, outcomes = promoted(commits.current(spark, root, quarantine), commits.current(spark, root, golden), wanted, key)
    path = shared_path(spark, "outcomes")
    outcomes.write.parquet(path)  # they are of the tables before the move
    commits.commit(spark, root, {golden: new, quarantine: left})
    return spark.read.schema(outcomes.schema).parquet(path)


def access_status(preflight: Column, read: Column, origin: Column, token: Column, known: Column) -> Column:
    """Who may call what: preflights always, cache reads from allowed origins, all else with a token; paths that are not
    known are answered as such, without a token."""
    return cascade([(preflight, F.lit(204)), (read & origin, F.lit(200)), (~read & token, F.lit(200)), (~known, F.lit(404))], F.lit(401))


def partition_outdated(df: DataFrame, watched: DataFrame, vulnerable: DataFrame, name: str) -> DataFrame:
    """security before minor and major; packages off the watch list are skipped."""
    met = df.join(watched.select(name).distinct().withColumn("__w", F.lit(True)), name, "left").join(vulnerable.select(name).distinct().withColumn("__v", F.lit(True)), name, "left")
    lane = cascade([(F.col("__w").isNull(), F.lit("skipped")), (F.col("__v"), F.lit("security")), (F.col("step") == "major", F.lit("major"))], F.lit("minor"))
    return met.withColumn("lane", lane).drop("__w", "__v")


def promotion_plan(df: DataFrame, order: Sequence[str], cap: int = 5) -> DataFrame:
    """df (classification, suppressed, known) with `plan`. Only promotions that happen count toward the cap.

    The place of the last promotion below the cap is found first, by a top-`cap` job; all rows are compared with it.
    """
    wants = ~F.col("suppressed") & (F.col("classification") == "real_bug")
    firsts = df.where(wants & ~F.col("known")).orderBy(*order).limit(cap).select(*order).collect()
    kinds = dict(zip(order, (df.schema[c].dataType for c in order), strict=True))
    full = F.struct(*order) > F.struct(*[F.lit(firsts[-1][c]).cast(kinds[c]).alias(c) for c in order]) if len(firsts) == cap else F.lit(False)
    plan = cascade(
        [
            (F.col("suppressed"), F.lit("suppressed")),
            (wants & full, F.lit("cap")),
            (wants & F.col("known"), F.lit("dedup")),
            (wants, F.lit("auto")),
            (F.col("classification") == "noise", F.lit("wontfix")),
        ],
        F.lit("skip"),
    )
    return df.withColumn("plan", plan)


def overfit_scan(lines: DataFrame, keys: Sequence[str], order: str, text: str, token: str) -> DataFrame:
    """Added lines below a src/ header of a diff that mention the token."""
    header = F.when(F.col(text).startswith("+++ "), F.col(text))
    place = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    marked = lines.withColumn("__h", F.last(header, ignorenulls=True).over(place))
    return marked.where(F.col("__h").rlike(r"^\+\+\+ (?:b/)?src/") & F.col(text).startswith("+") & ~F.col(text).startswith("+++") & F.col(text).contains(F.col(token))).drop("__h")


def parse_status_next(state: Column, event: Column) -> Column:
    """The next state of a document's processing; an event that does not belong leaves it."""
    return cascade(
        [
            ((state == "idle") & (event == "link_found"), F.lit("fetching")),
            ((state == "fetching") & (event == "downloaded"), F.lit("parsing")),
            ((state == "fetching") & (event == "not_found"), F.lit("unavailable")),
            ((state == "parsing") & (event == "parsed"), F.lit("parsed")),
            ((state == "parsing") & (event == "no_text"), F.lit("no-text-layer")),
            (state.isin("fetching", "parsing") & (event == "failed"), F.lit("error")),
            (state.isin("no-text-layer", "unavailable") & (event == "fallback"), F.lit("fetching")),
        ],
        state,
    )


def pdf_parse_status(kind: Column, state: Column, source: Column) -> Column:
    return cascade(
        [
            (kind == "application", F.lit("skipped")),
            ((state == "parsed") & source.isNull(), F.lit("cache-hit")),
            (state == "parsed", F.lit("success")),
            (state.isin("error", "no-text-layer", "unavailable"), F.lit("failed")),
        ],
        F.lit(None),
    )


#: Attempts at a fix, and the label of issues that are left to people.
FIX_ATTEMPTS, HUMAN_LABEL = 3, "flake-investigation"


def dispatcher_gates(issue: Column, transport: Column, fingerprint: Column, labels: Column, error_class: Column, attempts: Column, branch: Column, skipped: Column, dry_run: Column, answer: Column, rounds_left: Column, guarded: Column, committed: Column) -> Column:
    """A struct of code and gate: where the dispatch of an issue ends, 0 done or left alone, 1 failed, 2 refused, 3 capped.

    error_class: as `extract_error_class` gives it. answer: ok, or how the call or the use of its diff failed (ci-gate,
    cap-blocked, contract-error, malformed, not-applicable, else an error). Gates are tried in the order of the work, so what
    comes later may be null for an issue that ends before.
    """

    def out(code: int, gate: str) -> Column:
        return F.struct(F.lit(code).alias("code"), F.lit(gate).alias("gate"))

    again = answer.isin("malformed", "not-applicable")
    return cascade(
        [
            (issue.isNull() | (issue == ""), out(2, "arguments")),
            (~F.coalesce(transport.isin("sdk", "subscription"), F.lit(False)), out(2, "transport")),
            (F.coalesce(fingerprint, F.lit("")) == "", out(2, "fingerprint")),
            (F.array_contains(labels, HUMAN_LABEL), out(0, "left-to-people")),
            (error_class.isNull(), out(2, "no-class")),
            (error_class == "AMBIGUOUS", out(2, "many-classes")),
            (attempts >= FIX_ATTEMPTS, out(3, "attempts")),
            (branch, out(0, "branch-exists")),
            (skipped, out(0, "skip-class")),
            (dry_run, out(0, "dry-run")),
            (answer == "ci-gate", out(2, "ci-gate")),
            (answer == "cap-blocked", out(3, "cap-blocked")),
            (answer == "contract-error", out(2, "contract-error")),
            (again & (F.coalesce(rounds_left, F.lit(0)) <= 0), out(0, "rounds")),
            (again, out(0, "again")),
            (F.coalesce(answer, F.lit("")) != "ok", out(1, "call")),
            (guarded, out(1, "diff-guard")),
            (~F.coalesce(committed, F.lit(False)), out(1, "commit")),
        ],
        out(0, "done"),
    )


def issue_payload(sections: Sequence[tuple[Column, int | None]]) -> Column:
    """Sections line by line, each cut to its budget; a null one is left out."""
    from lineloom.functions.text import truncate_budget

    return F.concat_ws("\n", *[text if budget is None else truncate_budget(text, budget, "...") for text, budget in sections])


def issue_body(heading: Column, fields: Sequence[tuple[str, Column]], reason: Column, fingerprint: Column, reason_title: str = "Verifier reason", budget: int = 1000) -> Column:
    """A failure's report as markdown: a heading, a table of fields (n/a where null or empty), the reason's first `budget`
    characters in a fence, where no markdown of its own counts, and the fingerprint as a comment that searches find."""
    table = [F.concat(F.lit(f"| {name} | "), F.coalesce(F.nullif(value, F.lit("")), F.lit("n/a")), F.lit(" |")) for name, value in fields]
    lines = [F.concat(F.lit("## "), heading), F.lit(""), F.lit("| Field | Value |"), F.lit("|-------|-------|"), *table, F.lit(""), F.lit(f"**{reason_title}:**"), F.lit(""), F.lit("```"), F.substring(F.coalesce(reason, F.lit("")), 1, budget), F.lit("```"), F.lit(""), F.concat(F.lit("<!-- fingerprint: "), fingerprint, F.lit(" -->"))]
    return F.concat_ws("\n", *lines)


def classify_iteration(selection_found: Column, ran: Column, verified: Column) -> Column:
    """What one try came to; what is not known did not happen."""
    no = lambda c: ~F.coalesce(c, F.lit(False))
    return cascade([(no(selection_found), F.lit("LLM_HALLUCINATED_SELECTION")), (no(ran), F.lit("HARNESS_ERROR")), (no(verified), F.lit("VERIFIER_DISAGREE"))], F.lit("PASS"))


def filing_cases(cases: DataFrame, failed: Column, wanted: Column) -> DataFrame:
    """Failures that are filed: failed and wanted; an unknown answer is no."""
    return cases.where(F.coalesce(failed & wanted, F.lit(False)))


def filing_findings(findings: DataFrame, key: str, wanted: Column, least: int) -> DataFrame:
    """Wanted findings of the keys that have `least` rows or more; the keys' counts come pre-aggregated."""
    often = findings.groupBy(key).agg(F.count("*").alias("__n")).where(F.col("__n") >= least).select(key)
    return findings.where(wanted).join(often, key, "left_semi")


def submit_guard(df: DataFrame, passage: str, published: Column) -> DataFrame:
    """Rows whose passage says something and whose document is not a mere publication, the passage trimmed."""
    return df.where((F.trim(passage) != "") & ~F.coalesce(published, F.lit(False))).withColumn(passage, F.trim(passage))


def copy_all(results: DataFrame, key: str, order: str, citation: str, sep: str = "\n") -> DataFrame:
    """key, copied: each key's citations that are not null, line by line in order."""
    found = F.array_sort(F.collect_list(F.struct(order, F.col(citation).alias("c"))))
    return results.where(F.col(citation).isNotNull()).groupBy(key).agg(F.array_join(F.transform(found, lambda s: s["c"]), sep).alias("copied"))


def newest_after(runs: DataFrame, key: str, ident: str, at: str, trigger: Column, slack: int = 1) -> DataFrame:
    """key, run: each key's newest run created no earlier than `slack` seconds before the trigger and named by digits."""
    late = runs.where((F.col(at) >= trigger - F.expr(f"INTERVAL {slack} SECOND")) & F.col(ident).cast("string").rlike("^[0-9]+$"))
    return late.groupBy(key).agg(F.max_by(ident, F.struct(at, ident)).alias("run"))


def all_pass(runs: DataFrame, key: str, passed: Column) -> DataFrame:
    """key, passed: whether every run of a key did; an unknown one did not."""
    return runs.groupBy(key).agg(F.bool_and(F.coalesce(passed, F.lit(False))).alias("passed"))


def ledger_write_guard(transport: Column, in_ci: Column, override: Column | None = None) -> Column:
    """Why a ledger entry is refused, or null: an unknown transport, or a write outside CI that is neither the subscription's
    nor allowed. A null transport is the default one."""
    kind = F.coalesce(transport, F.lit("sdk"))
    allowed = in_ci if override is None else in_ci | override
    return cascade([(~kind.isin("sdk", "subscription"), F.lit("unknown transport")), (~F.coalesce(allowed, F.lit(False)) & (kind != "subscription"), F.lit("outside ci"))], F.lit(None))


def report_fix(pr_exists: Column, capped: Column, well_formed: Column, permitted: Column) -> Column:
    """How a report's fix ends: pr-exists, cap, malformed, forbidden or built."""
    return cascade([(pr_exists, F.lit("pr-exists")), (capped, F.lit("cap")), (~F.coalesce(well_formed, F.lit(False)), F.lit("malformed")), (~F.coalesce(permitted, F.lit(False)), F.lit("forbidden"))], F.lit("built"))


def post_fix_suppressed(cases: DataFrame, pulls: DataFrame, closed: DataFrame, key: str, prefix: str, now: Column, days: int = SUPPRESS_DAYS) -> DataFrame:
    """cases with suppressed: whether a pull request (branch, body, merged_at) of the last `days` whose branch has the prefix
    names the case between backticks, or a closed issue is the case's. Only what is named is joined."""
    recent = pulls.where(F.col("branch").startswith(prefix) & within(F.col("merged_at"), now, days) & (F.col("merged_at") <= now))
    named = recent.select(F.explode(F.regexp_extract_all("body", F.lit("`([^`]+)`"), F.lit(1))).alias(key))
    hits = named.unionAll(closed.select(key)).distinct().withColumn("__s", F.lit(True))
    return cases.join(hits, key, "left").withColumn("suppressed", F.coalesce("__s", F.lit(False))).drop("__s")


def append_notes(held: DataFrame, news: DataFrame, key: str, order: str, note: str) -> DataFrame:
    """held (key, notes: an array, null for none) with the new notes of each key after its own, in order."""
    more = news.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, F.col(note).alias("n")))).alias("__n"))
    none = F.array().cast("array<string>")
    notes = F.concat(F.coalesce("notes", none), F.coalesce(F.transform("__n", lambda s: s["n"]), none))
    return held.join(more, key, "left").withColumn("notes", notes).drop("__n")
