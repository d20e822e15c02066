r"""Least-cost repair of the turns of conversations, by cost layers of reachable grammar states.

A conversation is right if the initials of its roles read `(s?(ua)+)?`. That grammar has four states: nothing yet, after
the system turn, after a user, after an assistant. Layer d holds for every turn, as a bitset, the states from which the end
is reached at cost d; a layer comes from the lower ones by a table look-up for each edit. Layers are made for increasing
cost until one holds the start at the first turn: its number is the cost. Following the bits from there, always by the
least letter that still ends at cost 0, gives the least audit.

Edits: Keep 0, Rerole 1, Delete 2, Insert 5; a turn that stays truncated adds 5; a blank or repeated turn must go.

Conversations are sorted within tasks and streamed. Of each, only BLOCK turns are held at once: at the end of a block the
cheapest way into each of the four states is carried on, with its audit and running digest, so one conversation may hold any
share of the rows. Cheapest audits between two states are never prefixes of each other (what follows the shorter would be
insertions alone, which cost), so least audits of blocks join to the least audit of the whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lineloom.llm.common import table

REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: Turns of a conversation that are held and searched at once.
BLOCK = 64
BLANKS = " \t\n\x0b\x0c\r"

_START, _SYSTEM, _USER, _ASSISTANT = range(4)
_ACCEPTED = 1 << _START | 1 << _ASSISTANT
#: By letter, the states from which it may come and the state after it.
_STEPS = {"s": ((_START,), _SYSTEM), "u": ((_START, _SYSTEM, _ASSISTANT), _USER), "a": ((_USER,), _ASSISTANT)}
#: By letter, the states before it for every set of states after it.
_BEFORE = {x: bytes(sum(1 << s for s in froms) if after >> to & 1 else 0 for after in range(16)) for x, (froms, to) in _STEPS.items()}
_BEFORE_ANY = bytes(u | a for u, a in zip(_BEFORE["u"], _BEFORE["a"], strict=True))
_NOTHING = bytes(16)
_LEGAL = {"su", "ua", "au"}


@dataclass
class Turn:
    role: str
    text: str
    fault: str | None  # blank, duplicate or truncated


def _next(state: int) -> tuple[str, int]:
    """The only role of user and assistant that may follow, and the state after it."""
    return ("assistant", _ASSISTANT) if state == _USER else ("user", _USER)


class Layers:
    """Cost layers of a block: which states before each turn reach one of `ends` after the last at a cost."""

    def __init__(self, turns: list[Turn], ends: int):
        self.turns, self.ends, self.layers = turns, ends, []
        self._forced = [t.fault in ("blank", "duplicate") for t in turns]
        self._extra = [TRUNCATED * (t.fault == "truncated") for t in turns]
        self._keep = [_NOTHING if forced else _BEFORE.get(t.role[:1], _NOTHING) for t, forced in zip(turns, self._forced, strict=True)]
        self._none = bytes(len(turns) + 1)

    def _layer(self, cost: int) -> bytes | bytearray:
        return self.layers[cost] if cost >= 0 else self._none

    def _add(self) -> bytearray:
        d, n = len(self.layers), len(self.turns)
        now = bytearray(n + 1)
        self.layers.append(now)
        deleted, inserted = self._layer(d - DELETE), self._layer(d - INSERT)
        kept_at = {extra: self._layer(d - extra) for extra in (0, TRUNCATED)}
        changed_at = {extra: self._layer(d - REROLE - extra) for extra in (0, TRUNCATED)}
        now[n] = (self.ends if d == 0 else 0) | _BEFORE_ANY[inserted[n]]
        for j in range(n - 1, -1, -1):
            found = deleted[j + 1] | _BEFORE_ANY[inserted[j]]
            if not self._forced[j]:
                extra = self._extra[j]
                found |= self._keep[j][kept_at[extra][j + 1]] | _BEFORE_ANY[changed_at[extra][j + 1]]
            now[j] = found
        return now

    def costs(self, starts: list[int]) -> dict[int, int]:
        """The least cost from each of these states, where there is one."""
        found: dict[int, int] = {}
        most = DELETE * len(self.turns) + 3 * INSERT  # to delete all turns and insert from there costs no more
        while len(found) < len(starts) and len(self.layers) <= most:
            now = self._add()[0]
            for s in starts:
                if s not in found and now >> s & 1:
                    found[s] = len(self.layers) - 1
        return found

    def trace(self, state: int, cost: int) -> tuple[str, list[str]]:
        """The least audit from a state at its cost, and the repaired turns."""
        audit, lines, j, n = [], [], 0, len(self.turns)
        while j < n or cost:
            turn = self.turns[j] if j < n else None
            role, after = _next(state)
            if turn and self._layer(cost - DELETE)[j + 1] >> state & 1:
                audit.append("D")
                cost, j = cost - DELETE, j + 1
                continue
            if self._layer(cost - INSERT)[j] >> after & 1:
                audit.append("I")
                lines.append(f"{role}:")
                cost, state = cost - INSERT, after
                continue
            extra = self._extra[j]
            froms, to = _STEPS.get(turn.role[:1], ((), 0))
            if state in froms and self._layer(cost - extra)[j + 1] >> to & 1:
                audit.append("K")
                lines.append(f"{turn.role}:{turn.text}")
                cost, state, j = cost - extra, to, j + 1
            else:
                audit.append("R")
                lines.append(f"{role}:{turn.text}")
                cost, state, j = cost - REROLE - extra, after, j + 1
        return "".join(audit), lines


@dataclass
class _Way:
    """The cheapest way into a state so far."""

    cost: int = 0
    audit: str = ""
    lines: int = 0
    digest: object = field(default_factory=hashlib.sha256)

    def longer(self, cost: int, audit: str, lines: list[str]) -> _Way:
        digest = self.digest.copy()
        if lines:
            digest.update(("\n" * bool(self.lines) + "\n".join(lines)).encode("utf-8", "surrogatepass"))
        return _Way(self.cost + cost, self.audit + audit, self.lines + len(lines), digest)


class Repair:
    """One conversation, given turn by turn in order."""

    def __init__(self) -> None:
        self.ways, self.held = {_START: _Way()}, []
        self.counts = {"blank": 0, "duplicate": 0, "truncated": 0}
        self.illegal = self.distinct = 0
        self.last: str | None = None
        self.turns: tuple[int, int] | None = None

    def add(self, turn: int | None, role: str, text: str, fault: str | None) -> None:
        if turn is not None and (self.turns is None or turn != self.turns[1]):
            self.turns = (turn if self.turns is None else self.turns[0], turn)
            self.distinct += 1
        if fault:
            self.counts[fault] += 1
        self.illegal += self.last is not None and self.last + role[:1] not in _LEGAL
        self.last = role[:1]
        if len(self.held) == BLOCK:
            found = {to: way for to in range(4) if (way := self._best(1 << to))}
            self.ways, self.held = found, []
        self.held.append(Turn(role, text, fault))

    def _best(self, ends: int) -> _Way | None:
        """The cheapest way through the held turns into one of these states, of equal ones that of the least audit."""
        layers = Layers(self.held, ends)
        found = {s: self.ways[s].cost + d for s, d in layers.costs(list(self.ways)).items()}
        if not found:
            return None
        least = min(found.values())
        options = [(s, *layers.trace(s, least - self.ways[s].cost)) for s, cost in found.items() if cost == least]
        s, audit, lines = min(options, key=lambda o: self.ways[o[0]].audit + o[1]) if len(options) > 1 else options[0]
        return self.ways[s].longer(least - self.ways[s].cost, audit, lines)

    def result(self) -> tuple:
        """gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256."""
        way = self._best(_ACCEPTED)
        gaps = self.turns[1] - self.turns[0] + 1 - self.distinct if self.turns else 0
        return gaps, *self.counts.values(), self.illegal, way.cost, way.audit, way.digest.hexdigest()


RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_NAMES = [part.split()[0] for part in RESULT.split(", ")]


def ordered(conversation: str, turn: str, role: str, text: str) -> list[Column]:
    """The order of a conversation's rows: by turn, nulls first, of equal turns by role and text."""
    return [F.asc_nulls_first(conversation), F.asc_nulls_first(turn), F.asc_nulls_first(role), F.asc_nulls_first(text)]


def repair(rows: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", present: Column | None = None) -> DataFrame:
    """A row for each conversation: its id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    present: rows where it is not true only name their conversation; one without other rows has zeros, an empty audit and
    the digest of an empty string. A null role or text counts as one space; null ids are one conversation. Of equal turns, the
    order is by role and text. A role that starts with no letter of the grammar can be reroled or deleted, not kept. Columns
    beyond the four play no part. An empty table gives an empty result.

    Rows move once, by conversation; the search for repeated turns and the stream sort the same partitions.
    """
    there = F.lit(True) if present is None else F.coalesce(present, F.lit(False))
    clean = rows.select(F.col(conversation).alias("conversation"), F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role), F.lit(" ")).alias("role"), F.coalesce(F.col(text), F.lit(" ")).alias("text"), there.alias("present"))
    moved = clean.repartition("conversation")
    seen = F.row_number().over(Window.partitionBy("conversation", "present", "role", "text").orderBy(F.asc_nulls_first("turn"))) > 1
    bare = F.rtrim("text", F.lit(BLANKS))
    fault = F.when(bare == "", "blank").when(seen, "duplicate").when(~F.substring(bare, -1, 1).isin(".", "!", "?"), "truncated")
    streamed = moved.withColumn("fault", fault).sortWithinPartitions(*ordered("conversation", "turn", "role", "text"))
    kind = clean.schema["conversation"]
    schema = T.StructType([T.StructField(conversation, kind.dataType, True), *T._parse_datatype_string(RESULT).fields])

    def repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, open_, found, ids = None, None, [], None

        def batch_of(found: list[tuple]) -> pa.RecordBatch:
            columns = [pa.array(c) for c in zip(*found, strict=True)]
            kinds = [ids.type, *[pa.int64()] * 6, pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays([c.cast(k) for c, k in zip(columns, kinds, strict=True)], names=[conversation, *_NAMES])

        for batch in batches:
            ids = batch.column("conversation")
            for its, turn, role, text, here, fault in zip(*(batch.column(c).to_pylist() for c in ("conversation", "turn", "role", "text", "present", "fault")), strict=True):
                if open_ is None or its != name:
                    if open_ is not None:
                        found.append((name, *open_.result()))
                    name, open_ = its, Repair()
                if here:
                    open_.add(turn, role, text, fault)
            if len(found) > 10_000:
                yield batch_of(found)
                found = []
        if open_ is not None:
            found.append((name, *open_.result()))
            yield batch_of(found)

    return streamed.mapInArrow(repaired, schema)


def edits(repairs: DataFrame, conversation: str = "conv_id") -> DataFrame:
    """A row for each letter of an audit: the conversation, place (from 1), edit, row (the number of the turn in order, null for
    an insertion) and emitted (how many turns stand so far)."""
    letters = repairs.select(conversation, F.posexplode(F.split("audit", "")).alias("place", "edit")).where(F.col("edit") != "")
    so_far = Window.partitionBy(conversation).orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    row = F.when(F.col("edit") != "I", F.count(F.when(F.col("edit") != "I", 1)).over(so_far))
    return letters.select(conversation, (F.col("place") + 1).alias("place"), "edit", row.alias("row"), F.count(F.when(F.col("edit") != "D", 1)).over(so_far).alias("emitted"))


def repaired_turns(rows: DataFrame, repairs: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The turns that repair() leaves: the conversation, place (the audit's), edit, turn (null for an insertion), role, text.

    rows: as given to repair(), the present ones; repairs: its result. A reroled or inserted turn is a user's or an assistant's by its parity after
    the system turn.
    """
    clean = rows.select(conversation, turn, F.coalesce(F.col(role), F.lit(" ")).alias("role"), F.coalesce(F.col(text), F.lit(" ")).alias("text"))
    order = ordered(conversation, turn, "role", "text")[1:]
    numbered = clean.withColumn("row", F.row_number().over(Window.partitionBy(conversation).orderBy(*order))).withColumnRenamed(conversation, "own")
    found = edits(repairs, conversation)
    joined = found.join(numbered, found[conversation].eqNullSafe(numbered["own"]) & (found["row"] == numbered["row"]), "left").where(F.col("edit") != "D")
    led = F.max(((F.col("edit") == "K") & F.col("role").startswith("s")).cast("int")).over(Window.partitionBy(conversation))
    made = F.when((F.col("emitted") - led) % 2 == 1, "user").otherwise("assistant")
    return joined.select(conversation, "place", "edit", turn, F.when(F.col("edit") == "K", F.col("role")).otherwise(made).alias("role"), F.coalesce("text", F.lit("")).alias("text"))


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, present of conversations with faults that a checksum of id and turn chooses: a row is dropped
    (present is false), emptied, loses its ends of sentences, stands twice, or becomes a user's. Nulls are one space."""
    space = F.lit(" ")
    named = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    fault = F.crc32(named.cast("binary")) % 20
    text = F.coalesce("text", space)
    bad = rows.select("conv_id", "turn", F.coalesce("role", space).alias("role"), text.alias("text"), fault.alias("bad"))
    text = F.when(F.col("bad") == 1, "").when(F.col("bad") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    bad = bad.select("conv_id", "turn", F.when(F.col("bad") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("bad") != 0).alias("present"), F.explode(F.array_repeat(F.lit(0), F.when(F.col("bad") == 3, 2).otherwise(1))).alias("copy"))
    return bad.drop("copy")


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, damaged by checksum and repaired."""
    return repair(damaged(table(spark, sf_dir, "conversations")), present=F.col("present"))


OP13_SQL = r"""
WITH RECURSIVE crc AS (
  SELECT list_transform(range(256), lambda n: list_reduce([n::UBIGINT] || range(8)::UBIGINT[], lambda c, i:
    CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END)) AS t),
keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(list_reduce([4294967295::UBIGINT] || list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''),
      lambda ch: ord(ch)::UBIGINT), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255)::BIGINT + 1])), 4294967295::UBIGINT) % 20 AS bad
  FROM conversations, crc),
damaged AS (
  SELECT conv_id, turn, CASE WHEN bad = 4 THEN 'user' ELSE role END AS role,
    CASE bad WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
    unnest(range(CASE WHEN bad = 3 THEN 2 ELSE 1 END)) AS copy
  FROM keyed WHERE bad <> 0),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS j,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS seen,
    rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare
  FROM damaged),
faulty AS (
  SELECT conv_id, turn, j, role, text, left(role, 1) AS letter,
    CASE WHEN bare = '' THEN 'blank' WHEN seen THEN 'duplicate' WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
    lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY j) AS before
  FROM numbered),
facts AS (
  SELECT conv_id, max(j) AS m, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (before IS NOT NULL AND before || letter NOT IN ('su', 'ua', 'au')) AS illegal
  FROM faulty GROUP BY conv_id),
ways AS (
  SELECT conv_id, 0::BIGINT AS j, 0 AS state, 0 AS cost, '' AS audit, []::VARCHAR[] AS lines FROM facts
  UNION ALL
  (WITH first AS (
    SELECT conv_id, j, state, cost, audit, lines FROM ways
    UNION ALL
    SELECT conv_id, j, CASE state WHEN 2 THEN 3 ELSE 2 END, cost + 5, audit || 'I', lines || [CASE state WHEN 2 THEN 'assistant:' ELSE 'user:' END] FROM ways),
  stepped AS (
    SELECT f.conv_id, f.j + 1 AS j, op, r.fault, letter,
      CASE op WHEN 'D' THEN state WHEN 'R' THEN CASE state WHEN 2 THEN 3 ELSE 2 END
        ELSE CASE WHEN letter = 's' AND state = 0 THEN 1 WHEN letter = 'u' AND state <> 2 THEN 2 WHEN letter = 'a' AND state = 2 THEN 3 END END AS state,
      cost + CASE op WHEN 'D' THEN 2 WHEN 'R' THEN 1 ELSE 0 END + CASE WHEN op <> 'D' AND r.fault = 'truncated' THEN 5 ELSE 0 END AS cost,
      audit || op AS audit,
      CASE op WHEN 'D' THEN lines WHEN 'K' THEN lines || [role || ':' || text] ELSE lines || [CASE state WHEN 2 THEN 'assistant:' ELSE 'user:' END || text] END AS lines
    FROM first f JOIN faulty r ON r.conv_id IS NOT DISTINCT FROM f.conv_id AND r.j = f.j + 1, (SELECT unnest(['D', 'K', 'R']) AS op) o
    WHERE op = 'D' OR r.fault NOT IN ('blank', 'duplicate'))
  SELECT conv_id, j, state, cost, audit, lines FROM stepped WHERE state IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY conv_id, state ORDER BY cost, audit) = 1)),
ended AS (
  SELECT w.conv_id, cost, audit, lines FROM ways w JOIN facts f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND w.j = m WHERE state IN (0, 3)
  UNION ALL
  SELECT w.conv_id, cost + 5, audit || 'I', lines || ['assistant:'] FROM ways w JOIN facts f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND w.j = m WHERE state = 2),
best AS (SELECT * FROM ended QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY cost, audit) = 1)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
  coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(cost, 0)::BIGINT AS cost,
  coalesce(audit, '') AS audit, sha256(coalesce(array_to_string(lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c
LEFT JOIN facts f ON f.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM c.conv_id
"""
