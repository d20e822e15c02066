"""Ledger roll-ups, caps, digests and comparisons."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Spend limits in dollars (warn, block).
CAPS: Mapping[str, tuple[float | None, float]] = {"month": (80, 100), "phase": (8, 10), "day": (None, 10), "issue": (None, 1), "pr": (None, 2)}
#: Dollars per million tokens (in, out) by model, the last row for any other.
RATES = {"large": (15.0, 75.0), "medium": (3.0, 15.0), "small": (0.8, 4.0), "": (15.0, 75.0)}


def finite(cost: Column) -> Column:
    """The cost, or null if it is null, NaN or infinite."""
    return F.when(~F.isnan(cost) & (F.abs(cost) != float("inf")), cost)


def spend(entries: DataFrame, by: Sequence[str], cost: str = "cost_usd") -> DataFrame:
    """Calls and dollars (to 6 places) by tags; entries without a tag have a group of their own."""
    return entries.groupBy(*by).agg(F.count("*").alias("invocations"), F.round(F.coalesce(F.sum(finite(F.col(cost))), F.lit(0.0)), 6).alias("total_usd"))


def cap_status(kind: str, total: Column) -> Column:
    warn, block = CAPS[kind]
    out = F.when(total >= block, "block")
    return (out.when(total >= warn, "warn") if warn is not None else out).otherwise("ok")


def precheck(statuses: Sequence[Column]) -> Column:
    """The first cap of the order given that blocks, or null; a null status stands for an absent tag."""
    return F.coalesce(*[F.when(s == "block", F.lit(i)) for i, s in enumerate(statuses)])


def transport(value: Column) -> Column:
    return F.when(value.isNull() | (value == "subscription"), "subscription").when(value == "sdk", "sdk").otherwise("unknown")


def fallback_cost(model: Column, tokens_in: Column, tokens_out: Column) -> Column:
    """Dollars by token counts; negative and null counts are 0, an unknown model has the default rate."""

    def rate(i: int) -> Column:
        out = None
        for name, r in RATES.items():
            if name:
                out = F.when(model == name, r[i]) if out is None else out.when(model == name, r[i])
        return out.otherwise(RATES[""][i])

    def count(t: Column) -> Column:
        return F.greatest(F.coalesce(t, F.lit(0)), F.lit(0))

    return F.round((count(tokens_in) * rate(0) + count(tokens_out) * rate(1)) / 1e6, 6)


def count_classes(df: DataFrame, column: str, classes: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """A column for each class with its rows; other values are ignored."""
    return df.groupBy(*by).agg(*[F.count_if(F.coalesce(F.col(column) == c, F.lit(False))).alias(c) for c in classes])


def first_label(labels: Column, classes: Sequence[str], default: str = "UNCLASSIFIED") -> Column:
    return F.coalesce(F.try_element_at(F.filter(labels, lambda x: x.isin(*classes)), F.lit(1)), F.lit(default))


def extract_error_class(labels: Column, classes: Sequence[str]) -> Column:
    """The one class among the labels; null for none, AMBIGUOUS for more."""
    found = F.filter(labels, lambda x: x.isin(*classes))
    return F.when(F.size(found) > 1, "AMBIGUOUS").otherwise(F.try_element_at(found, F.lit(1)))


def upper_median(values: Column) -> Column:
    """The element at n div 2 of the sorted array."""
    ordered = F.array_sort(values)
    return F.when(F.size(values) > 0, F.get(ordered, F.floor(F.size(values) / 2).cast("int")))


def ab_winner(df: DataFrame, arm: str, group: Sequence[str], outcome: str, least: int = 20, margin: float = 0.10) -> DataFrame:
    """Rates of arms A and B by group, with a winner once every group has `least` rows in both arms.

    A null outcome counts as a row but not as a pass. A group that one arm lacks holds the gate shut too.
    """
    is_a, is_b = F.col(arm) == "A", F.col(arm) == "B"
    passed = F.coalesce(F.col(outcome), F.lit(False))
    rates = df.groupBy(*group).agg(F.count_if(is_a).alias("n_a"), F.count_if(is_b).alias("n_b"), F.count_if(is_a & passed).alias("pass_a"), F.count_if(is_b & passed).alias("pass_b"))
    gate = rates.agg(F.min(F.least("n_a", "n_b")).alias("__least"))  # one row
    out = rates.join(F.broadcast(gate))
    delta = F.try_divide("pass_a", "n_a") - F.try_divide("pass_b", "n_b")
    verdict = F.when(F.col("__least") < least, "NO_WINNER_YET").when(delta.isNull(), "ABSTAIN").when(F.abs(delta) < margin, "TIE").when(delta > 0, "A").otherwise("B")
    return out.select(*group, "n_a", "n_b", "pass_a", "pass_b", F.round(delta, 9).alias("delta"), verdict.alias("winner"))


def ab_counts(df: DataFrame, group: Sequence[str], arm: str, outcome: str) -> DataFrame:
    """Rows and passes by group and arm; a null outcome is a row, not a pass."""
    return df.groupBy(*group, arm).agg(F.count("*").alias("n"), F.count_if(F.coalesce(F.col(outcome), F.lit(False))).alias("pass"))


def ab_gate(df: DataFrame, group: Sequence[str], arm: str, least: int = 20) -> DataFrame:
    """One row, `open`: whether every group has `least` rows in arm A and in arm B; shut without groups."""
    sizes = df.groupBy(*group).agg(*[F.count_if(F.col(arm) == x).alias(f"n_{x}") for x in ("A", "B")])
    return sizes.agg(F.coalesce(F.bool_and((F.col("n_A") >= least) & (F.col("n_B") >= least)), F.lit(False)).alias("open"))


def tallies(df: DataFrame, kinds: Mapping[str, Column]) -> DataFrame:
    """kind, name, n: the rows of each value of several columns, counted in one pass."""
    pairs = F.array(*[F.struct(F.lit(kind).alias("kind"), value.alias("name")) for kind, value in kinds.items()])
    return df.select(F.explode(pairs).alias("p")).groupBy("p.kind", "p.name").agg(F.count("*").alias("n"))


def autofix_metrics(pulls: DataFrame, attempted: Column, merged: Column, minutes: Column, fingerprint: str) -> DataFrame:
    """One row: pull requests attempted and merged, their rate (null without attempts), the median minutes to merge (null and
    unknown ones aside), and the median number of attempts of a fingerprint."""
    rates = pulls.agg(F.count_if(attempted).alias("attempted"), F.count_if(merged).alias("merged"), F.round(F.try_divide(F.count_if(merged), F.count_if(attempted)), 9).alias("success_rate"), F.median(F.when(merged, minutes)).alias("p50_minutes"))
    attempts = pulls.groupBy(fingerprint).count().agg(F.median("count").alias("p50_attempts"))
    return rates.join(F.broadcast(attempts))  # one row


def bug_report_metrics(reports: DataFrame, at: Column, now: Column, counted: Column, opened: Column, merged: Column, stuck: Column, days: int = 7) -> DataFrame:
    """One row: reports counted in the `days` up to now, those open, merged and stuck, and merged ones per 100 counted (null
    if none are)."""
    volume = F.count_if(counted & (at >= now - F.expr(f"INTERVAL {days} DAY")) & (at <= now))
    rate = F.round(F.try_divide(F.count_if(merged) * 100.0, volume), 1)
    return reports.agg(volume.alias("volume"), F.count_if(opened).alias("open"), F.count_if(merged).alias("merged"), F.count_if(stuck).alias("stuck"), rate.alias("promotion_rate"))


def bypass(completed: Column, skipped: Column, finished: Column, merged: Column) -> Column:
    """Whether a merge went past its check: null until the check has completed, true if it was skipped, else whether it
    finished after the merge."""
    return F.when(completed, F.when(skipped, True).otherwise(finished > merged))


def replay_verdict(original: Column, runs: Column, least: int = 2) -> Column:
    """CONFIRMED if `least` replays end as the original did, else FLAKE; NOT_REPLAYABLE without an original."""
    same = F.size(F.filter(F.coalesce(runs, F.array().cast("array<string>")), lambda r: F.coalesce(r == original, F.lit(False))))
    return F.when(original.isNull(), "NOT_REPLAYABLE").when(same >= least, "CONFIRMED").otherwise("FLAKE")


def _right() -> Column:
    return F.coalesce(F.col("expected") == F.col("actual"), F.lit(False))


def accuracy_report(cases: DataFrame, by: str = "category") -> DataFrame:
    """cases (by, expected, actual) -> by, total, exact, missing (nothing expected), rate of exact ones."""
    return cases.groupBy(by).agg(F.count("*").alias("total"), F.count_if(_right()).alias("exact"), F.count_if(F.col("expected").isNull()).alias("missing"), F.round(F.count_if(_right()) / F.count("*"), 9).alias("rate"))


def confidence_calibration(cases: DataFrame, high: float = 0.95, low: float = 0.80) -> DataFrame:
    """cases (confidence, expected, actual) -> band (high, middle), n, correct: how often each band is right. Cases below the
    bands and those without an expected answer are left out."""
    rows = cases.where((F.col("confidence") >= low) & F.col("expected").isNotNull())
    return rows.groupBy(F.when(F.col("confidence") >= high, "high").otherwise("middle").alias("band")).agg(F.count("*").alias("n"), F.round(F.count_if(_right()) / F.count("*"), 9).alias("correct"))


def before_after(old: DataFrame, new: DataFrame, key: str, score: str) -> DataFrame:
    """key, change: improved, regressed or same by score, new or gone where one side lacks the key, which both hold once."""
    a, b = old.select(key, F.col(score).alias("__a"), F.lit(True).alias("__old")), new.select(key, F.col(score).alias("__b"), F.lit(True).alias("__new"))
    change = F.when(F.col("__old").isNull(), "new").when(F.col("__new").isNull(), "gone").when(F.col("__b") > F.col("__a"), "improved").when(F.col("__b") < F.col("__a"), "regressed").otherwise("same")
    return a.join(b, key, "full").select(key, change.alias("change"))
