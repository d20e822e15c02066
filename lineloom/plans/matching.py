"""Passage matching: benchmark items stand for passages, documents for what is cited."""

from __future__ import annotations

from pyspark.sql import functions as F

from lineloom.functions import text as T
from lineloom.operators import anchoring as A
from lineloom.operators import matching as M
from lineloom.operators import relational as R
from lineloom.plans.base import Plans, table

plans = Plans()


def _ocr(x: str) -> str:
    for a, b in T.CONFUSIONS:
        x = f"replace({x}, '{a}', '{b}')"
    return x


_CLEAN = "trim(regexp_replace(text, '\\s+', ' ', 'g'))"
_LINES = f"SELECT doc_id, i, {_ocr('line')} AS line FROM (SELECT doc_id, unnest(range(0, len(l))) AS i, trim(regexp_replace(unnest(l), '\\s+', ' ', 'g')) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)) WHERE line <> ''"
_CITE = f"""WITH l AS (SELECT *, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first FROM ({_LINES})),
d AS (SELECT doc_id, string_agg(line, ' ' ORDER BY i) AS t FROM l GROUP BY 1),
p AS (SELECT item_id, {_CLEAN} AS c, {_ocr(_CLEAN)} AS n FROM benchmark),
h AS (SELECT item_id, doc_id, c <> n AS changed, length(t) - instr(reverse(t), reverse(n)) + 1 - length(n) AS a, length(t) - instr(reverse(t), reverse(n)) + 1 AS b FROM p, d WHERE contains(t, n)),
s AS (SELECT item_id, h.doc_id, changed, max(i) FILTER (first <= a) AS x, max(i) FILTER (first < b) AS y FROM h JOIN l ON l.doc_id = h.doc_id GROUP BY ALL)
SELECT item_id, doc_id, (1 + x // 67) || ':' || (1 + x % 67) || CASE WHEN x = y THEN '' WHEN x // 67 = y // 67 THEN '-' || (1 + y % 67) ELSE '-' || (1 + y // 67) || ':' || (1 + y % 67) END AS citation, CAST(CASE WHEN changed THEN 0.98 ELSE 1.0 END AS DOUBLE) AS confidence FROM s"""


@plans.add("cite_benchmark", _CITE)
def cite_benchmark(spark, sf_dir):
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("passage_id"), "text")
    return M.find_exact(table(spark, sf_dir, "documents"), items).withColumnRenamed("passage_id", "item_id")


def _doc_lines(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "text")).where(F.trim("text") != "")
    return lines.select("doc_id", F.col("n").alias("entry_idx"), (1 + F.floor(F.col("n") / 67)).cast("int").alias("column"), (1 + F.col("n") % 67).alias("line_number"), "text", F.lit(False).alias("wrap_hyphen"))


def _passages(spark, sf_dir, text, test="true"):
    """One passage a document, derived from its own text."""
    return table(spark, sf_dir, "documents").where(test).select("doc_id", F.col("doc_id").alias("passage_id"), text.alias("text"))


def _tier(name, text, test, answer=None):
    @plans.add(name, answer)
    def query(spark, sf_dir):
        found = M.cite(_passages(spark, sf_dir, text(), test), _doc_lines(spark, sf_dir))
        return found.select("doc_id", "citation", F.round("confidence", 6).alias("confidence"), "tier")


def _least(n):
    """The texts that are as long as the needle needs."""
    return f"length(text) >= {n}"


_tier("match_ws_stripped", lambda: F.regexp_replace(F.substring("text", 1, 200), r"\s", ""), _least(200))
_tier("match_bookend", lambda: F.concat(F.substring("text", 1, 150), F.lit(" inserted words here "), F.substring("text", 151, 150)), _least(300))
_tier("match_fuzzy", lambda: F.concat(F.substring("text", 1, 30), F.lit("q"), F.substring("text", 33, 30)), _least(62))
_tier("match_gutter", lambda: F.substring(F.regexp_replace("text", r"\s+", " "), 1, 200), _least(200))
_tier("match_and_cite", lambda: F.substring(F.regexp_replace("text", r"\s+", " "), 1, 300), _least(300))


def _asked_sql(offsets: str, size: int) -> str:
    """Tier 1 of the cascade for pieces of every document's clean text: the last place in its joined lines."""
    return f"""WITH l AS MATERIALIZED (SELECT *, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first FROM ({_LINES})),
d AS MATERIALIZED (SELECT doc_id, string_agg(line, ' ' ORDER BY i) AS t FROM l GROUP BY 1),
p AS MATERIALIZED (SELECT doc_id, k, regexp_replace(trim(substr(c, k, {size})), '- ([a-z])', '\\1', 'g') AS c FROM (SELECT doc_id, {_CLEAN} AS c FROM documents), (VALUES {offsets}) o(k) WHERE length(c) >= k + {size}),
h AS MATERIALIZED (SELECT doc_id, k, c <> n AS changed, length(t) - instr(reverse(t), reverse(n)) + 1 - length(n) AS a, length(t) - instr(reverse(t), reverse(n)) + 1 AS b FROM (SELECT *, {_ocr('c')} AS n FROM p) JOIN d USING (doc_id) WHERE contains(t, n)),
s AS (SELECT h.doc_id, k, changed, max(i) FILTER (first <= a) AS x, max(i) FILTER (first < b) AS y FROM h JOIN l ON l.doc_id = h.doc_id GROUP BY ALL)
SELECT doc_id, k AS passage, (1 + x // 67) || ':' || (1 + x % 67) || CASE WHEN x = y THEN '' WHEN x // 67 = y // 67 THEN '-' || (1 + y % 67) ELSE '-' || (1 + y // 67) || ':' || (1 + y % 67) END AS citation, CAST(CASE WHEN changed THEN 0.98 ELSE 1.0 END AS DOUBLE) AS confidence FROM s"""


def _asked(spark, sf_dir, offsets, size):
    clean = table(spark, sf_dir, "documents").select("doc_id", T.collapse(F.col("text")).alias("c"))
    pieces = clean.select("doc_id", "c", F.explode(F.array(*map(F.lit, offsets))).alias("k")).where(F.length("c") >= F.col("k") + size)
    asked = pieces.select("doc_id", F.struct("doc_id", "k").alias("passage_id"), F.substr("c", F.col("k"), F.lit(size)).alias("text"))
    found = M.cite(asked, _doc_lines(spark, sf_dir)).where("tier = 1")
    return found.select("doc_id", F.col("passage_id.k").alias("passage"), "citation", F.round("confidence", 6).alias("confidence"))


@plans.add("match_exact", _CITE)
def match_exact(spark, sf_dir):
    """Tier 1 of every benchmark passage in every document, whatever its length."""
    return cite_benchmark(spark, sf_dir)


@plans.add("cite_batch", _asked_sql("(1), (101), (201)", 60))
def cite_batch(spark, sf_dir):
    """What the first tier finds of three pieces of every document, asked at once."""
    return _asked(spark, sf_dir, [1, 101, 201], 60)


_JOINED = f"SELECT doc_id, string_agg(line, ' ' ORDER BY i) AS concat, count(*) AS lines FROM ({_LINES}) GROUP BY 1"


@plans.add("build_concat", _JOINED)
def build_concat(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    clean = lines.select("doc_id", "i", T.normalize_ocr(T.collapse(F.col("line"))).alias("line")).where("line <> ''")
    ordered = F.array_sort(F.collect_list(F.struct("i", "line")))
    return clean.groupBy("doc_id").agg(F.array_join(F.transform(ordered, lambda s: s["line"]), " ").alias("concat"), F.count("*").alias("lines"))


@plans.add("resolve_span", f"SELECT l.doc_id, min(i) FILTER (first + length(line) > 100) AS start_line, max(i) FILTER (first < 300) AS end_line FROM (SELECT *, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first, sum(length(line) + 1) OVER (PARTITION BY doc_id) AS total FROM ({_LINES})) l WHERE total > 400 GROUP BY 1 HAVING bool_or(first <= 100 AND first + length(line) > 100) AND bool_or(first < 300 AND first + length(line) >= 300)")
def resolve_span(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    clean = lines.select("doc_id", F.col("i").cast("long").alias("i"), T.normalize_ocr(T.collapse(F.col("line"))).alias("line")).where("line <> ''")
    running = R.Window.partitionBy("doc_id").orderBy("i")
    ends = clean.withColumn("high", F.sum(F.length("line") + 1).over(running.rowsBetween(R.Window.unboundedPreceding, 0)) - 1)
    spans = ends.select("doc_id", "i", (F.col("high") - F.length("line")).alias("low"), "high")
    docs = spans.groupBy("doc_id").agg((F.max("high") + 1).alias("total")).where("total > 400")
    points = docs.select("doc_id", F.explode(F.array(F.struct(F.lit(100).alias("at"), F.lit(0).alias("end")), F.struct(F.lit(299).alias("at"), F.lit(1).alias("end")))).alias("p")).select("doc_id", "p.*")
    hits = R.range_join(points, spans, "at", "low", "high", ["doc_id"])
    return hits.groupBy("doc_id").agg(F.max(F.when(F.col("end") == 0, F.col("i"))).alias("start_line"), F.max(F.when(F.col("end") == 1, F.col("i"))).alias("end_line")).where("start_line IS NOT NULL AND end_line IS NOT NULL")


@plans.add("find_all", "SELECT doc_id, len(list_filter(range(1, length(text) + 1), lambda i: substr(text, i, 4) = 'thth')) AS n FROM documents")
def find_all(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.regexp_count("text", F.lit("(?=thth)")).cast("long").alias("n"))


@plans.add("best_by_context")
def best_by_context(spark, sf_dir):
    text = F.regexp_replace("text", r"\s+", " ")
    asked = table(spark, sf_dir, "documents").where(_least(166)).select("doc_id", F.col("doc_id").alias("passage_id"), F.substring(text, 101, 6).alias("text"), F.substring(text, 41, 60).alias("before"), F.substring(text, 107, 60).alias("after"))
    return M.cite(asked, _doc_lines(spark, sf_dir)).select("doc_id", "citation", "confidence")


@plans.add("levenshtein", "SELECT o_orderkey, levenshtein(o_orderpriority, c_mktsegment) AS d FROM orders JOIN customer ON o_custkey = c_custkey")
def levenshtein(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    return table(spark, sf_dir, "orders").join(customers, "o_custkey").select("o_orderkey", F.levenshtein("o_orderpriority", "c_mktsegment").cast("long").alias("d"))


_TIGHT = "lower(regexp_replace(text, '[^a-zA-Z0-9]+', '', 'g'))"


@plans.add("selection_in_spec", f"SELECT doc_id, CASE WHEN a > 0 THEN 'ws' WHEN b > 0 THEN 'tight' END AS method, CASE WHEN a > 0 THEN a - 1 WHEN b > 0 THEN b - 1 END AS place FROM (SELECT doc_id, instr(lower({_CLEAN}), 'the th') AS a, instr({_TIGHT}, 'oferth') AS b FROM documents)")
def selection_in_spec(spark, sf_dir):
    a, b = F.instr(F.lower(T.collapse(F.col("text"))), F.lit("the th")), F.instr(T.tight_norm(F.col("text")), F.lit("oferth"))
    return table(spark, sf_dir, "documents").select("doc_id", F.when(a > 0, "ws").when(b > 0, "tight").alias("method"), F.when(a > 0, a - 1).when(b > 0, b - 1).cast("long").alias("place"))


@plans.add("spec_excerpt", "WITH l AS (SELECT doc_id, unnest(range(0, len(l))) AS i, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)), m AS (SELECT doc_id, min(i) AS m FROM l WHERE length(line) >= 300 GROUP BY 1) SELECT doc_id, string_agg(line, ' ' ORDER BY i) AS excerpt FROM l JOIN m USING (doc_id) WHERE i >= m AND i < 15 GROUP BY 1")
def spec_excerpt(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    return M.spec_excerpt(lines, "doc_id", "i", "line")


# For every place of a letter or digit in the body, that place.
_PLACES = "list_transform(list_filter(list_zip(string_split(body, ''), range(1, length(body) + 1)), lambda x: regexp_matches(x[1], '^[a-zA-Z0-9]$')), lambda x: x[2])"


def _letters(x: str) -> str:
    return f"lower(regexp_replace({x}, '[^a-zA-Z0-9]+', '', 'g'))"


_ASKED = """SELECT doc_id, CASE doc_id % 6 WHEN 5 THEN text || ' the CH1 domain of a fusion protein' ELSE text END AS body,
CASE doc_id % 6 WHEN 0 THEN s WHEN 1 THEN 'What is claimed is: ' || s WHEN 2 THEN 'I claim: 3. ' || s WHEN 3 THEN s || ' qq0zz1xx2jj3kk4' WHEN 4 THEN 'qq0zz1xx2 ' || s ELSE 'We claim : the CHI domain of a fusion protein' END AS passage
FROM (SELECT doc_id, text, substr(text, 101, 120) AS s FROM documents) WHERE length(text) >= 300"""
_OPENINGS = "passage"
for _words in ("What is claimed is", "What is claimed", "The invention claimed is", "I claim", "We claim"):
    _OPENINGS = f"regexp_replace({_OPENINGS}, '^(?i:{_words})\\s*:\\s*', '')"
_FORMS = f"""SELECT doc_id, body, passage, bare, regexp_replace(bare, '^[0-9]+\\.\\s+', '') AS plain FROM (SELECT doc_id, body, passage, {_OPENINGS} AS bare FROM ({_ASKED}))"""
_LOCATED = f"""WITH f AS ({_FORMS}),
a AS (SELECT doc_id, 0 AS i, 'raw' AS name, passage AS x FROM f UNION ALL SELECT doc_id, 1, 'strip-preamble', bare FROM f WHERE bare <> passage UNION ALL SELECT doc_id, 2, 'strip-preamble+claim-num', plain FROM f WHERE plain <> bare
UNION ALL SELECT doc_id, 3, 'ocr:CHI->CH1', replace(bare, 'CHI', 'CH1') FROM f WHERE contains(bare, 'CHI') UNION ALL SELECT doc_id, 5, 'ocr:CH1->CHI', replace(bare, 'CH1', 'CHI') FROM f WHERE contains(bare, 'CH1') UNION ALL SELECT doc_id, 7, 'ocr:lI->II', replace(bare, 'lI', 'II') FROM f WHERE contains(bare, 'lI')),
n AS (SELECT a.doc_id, i, name, {_letters("x")} AS n, {_letters("body")} AS t FROM a JOIN f USING (doc_id) WHERE length(x) >= 8),
c AS (SELECT doc_id, 0 AS late, i, 0 AS cut, 0 AS head, 'alpha/' || name AS form, n AS letters, t FROM n WHERE length(n) >= 16
UNION ALL SELECT doc_id, 1, i, cut, head, 'alpha-shrink-' || CASE head WHEN 1 THEN 'head-' ELSE 'tail-' END || cut || '/' || name, CASE head WHEN 1 THEN substr(n, cut + 1) ELSE left(n, length(n) - cut) END, t FROM (SELECT *, unnest(range(5, length(n), 5)) AS cut FROM n), (VALUES (0), (1)) h(head) WHERE length(n) >= 30 AND cut < length(n) * 0.6 AND length(n) - cut >= 30),
h AS (SELECT doc_id, form, letters, instr(t, letters) AS spot FROM c WHERE contains(t, letters) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY late, i, head, cut) = 1)
SELECT doc_id, form, CAST(p[spot] - 1 AS INT) AS "start", CAST(p[spot + length(letters) - 1] AS INT) AS stop, letters FROM h JOIN (SELECT doc_id, {_PLACES} AS p FROM f) USING (doc_id)"""


@plans.add("locate_in_body", _LOCATED)
def locate_in_body(spark, sf_dir):
    """A passage of every document, with openings, claim numbers, confused letters or strange heads and tails."""
    asked = table(spark, sf_dir, "documents").where("length(text) >= 300").selectExpr(
        "doc_id",
        "CASE doc_id % 6 WHEN 5 THEN text || ' the CH1 domain of a fusion protein' ELSE text END AS body",
        "CASE doc_id % 6 WHEN 0 THEN substr(text, 101, 120) WHEN 1 THEN 'What is claimed is: ' || substr(text, 101, 120) WHEN 2 THEN 'I claim: 3. ' || substr(text, 101, 120) WHEN 3 THEN substr(text, 101, 120) || ' qq0zz1xx2jj3kk4' WHEN 4 THEN 'qq0zz1xx2 ' || substr(text, 101, 120) ELSE 'We claim : the CHI domain of a fusion protein' END AS passage",
    )
    found = asked.select("doc_id", A.locate_in_body(F.col("passage"), F.col("body")).alias("found"))
    return found.where("found.form IS NOT NULL").select("doc_id", "found.*")


# Of the letters from 21 on, and of the last twelve: the first right step, else the first left one, at which nothing follows.
_STEPS = "SELECT doc_id, which, body, t, n, instr(t, n) AS a, instr(t, n) + length(n) AS b, length(t) + 1 AS e FROM (SELECT doc_id, body, t, which, CASE which WHEN 0 THEN substr(t, 21, 12) ELSE right(t, 12) END AS n FROM (SELECT doc_id, text AS body, {letters} AS t FROM documents), (VALUES (0), (1)) w(which) WHERE length(t) >= 60)".replace("{letters}", _letters("text"))
_UNIQUE = f"""WITH s AS (SELECT *, least(30, (e - b + 5) // 6) AS r FROM ({_STEPS})),
g AS (SELECT *, list_filter(range(0, r + 1), lambda k: NOT contains(substr(t, least(e, b + 6 * k)), substr(t, a, least(e, b + 6 * k) - a)))[1] AS k FROM s),
l AS (SELECT *, CASE WHEN k IS NULL THEN list_filter(range(1, least(60 - r, (a + 4) // 6) + 1), lambda j: NOT contains(substr(t, least(e, b + 6 * r)), substr(t, greatest(1, a - 6 * j), least(e, b + 6 * r) - greatest(1, a - 6 * j))))[1] END AS j, {_PLACES} AS p FROM g),
m AS (SELECT doc_id, which, body, k, j, CASE WHEN k = 0 OR k IS NULL AND j IS NULL THEN 0 ELSE 1 END AS grown, k IS NULL AND j IS NULL AS twice,
  p[CASE WHEN j IS NULL THEN a ELSE greatest(1, a - 6 * j) END] AS x, p[CASE WHEN k IS NULL AND j IS NULL THEN b ELSE least(e, b + 6 * coalesce(k, r)) END - 1] AS y FROM l)
SELECT doc_id, which, CAST(x - 1 - CASE grown WHEN 1 THEN length(regexp_extract(left(body, x - 1), '[a-zA-Z0-9]*$')) ELSE 0 END AS INT) AS "start",
CAST(y + CASE grown WHEN 1 THEN length(regexp_extract(substr(body, y + 1), '^[a-zA-Z0-9]*')) ELSE 0 END AS INT) AS stop, CASE WHEN twice THEN 2 ELSE 1 END AS occurrences, grown = 1 AS grown FROM m"""


@plans.add("ensure_unique", _UNIQUE)
def ensure_unique(spark, sf_dir):
    """The letters from 21 on, which grow to the right, and the last twelve, which can grow to the left alone."""
    t = T.tight_norm(F.col("text"))
    rows = table(spark, sf_dir, "documents").select("doc_id", "text", t.alias("t")).where(F.length("t") >= 60)
    pieces = F.array(F.struct(F.lit(0).alias("which"), F.substring("t", 21, 12).alias("n")), F.struct(F.lit(1).alias("which"), F.substring("t", -12, 12).alias("n")))
    asked = rows.select("doc_id", "text", F.explode(pieces).alias("p")).select("doc_id", "text", "p.*")
    return asked.select("doc_id", "which", A.ensure_unique(F.col("n"), F.col("text")).alias("u")).select("doc_id", "which", "u.*")


@plans.add("count_alpha_occurrences", f"SELECT doc_id, least(2, (length(t) - length(replace(t, 'thth', ''))) // 4) AS n FROM (SELECT doc_id, {_TIGHT} AS t FROM documents)")
def count_alpha_occurrences(spark, sf_dir):
    t = T.tight_norm(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.least(F.lit(2), F.floor((F.length(t) - F.length(F.replace(t, F.lit("thth"), F.lit("")))) / 4)).cast("long").alias("n"))


_MARKED = "SELECT doc_id, unnest(range(0, len(l))) AS n, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)"


def _marked(spark, sf_dir):
    """Lines with a paragraph marker before every fourth."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    return lines.withColumn("line", F.when(F.col("n") % 4 == 1, F.concat(F.lit("["), F.lpad(F.col("n").cast("string"), 4, "0"), F.lit("] "), "line")).otherwise(F.col("line")))


@plans.add("paragraph_markers", f"SELECT doc_id, count(*) AS n, max(lpad(CAST(n AS VARCHAR), 4, '0')) AS last FROM ({_MARKED}) WHERE n % 4 = 1 AND n < 10000 GROUP BY 1")
def paragraph_markers(spark, sf_dir):
    found = _marked(spark, sf_dir).select("doc_id", F.explode(F.regexp_extract_all("line", F.lit(r"\[([0-9]{4})\]"), F.lit(1))).alias("m"))
    return found.groupBy("doc_id").agg(F.count("*").alias("n"), F.max("m").alias("last"))


@plans.add("paragraph_of_node", f"SELECT doc_id, n, lpad(CAST(4 * ((n - 1) // 4) + 1 AS VARCHAR), 4, '0') AS para FROM ({_MARKED}) WHERE n >= 1")
def paragraph_of_node(spark, sf_dir):
    lines = _marked(spark, sf_dir)
    marks = lines.select("doc_id", "n", F.nullif(F.regexp_extract("line", r"\[([0-9]{4})\]", 1), F.lit("")).alias("para")).where("para IS NOT NULL")
    return R.asof_backward(lines.select("doc_id", "n"), marks, ["doc_id"], "n", "para").where("para IS NOT NULL").select("doc_id", F.col("n").cast("long").alias("n"), "para")


# Nodes of a page's text, its normal form, and for every character whether the normal form keeps it.
_NODES = "list_filter(regexp_split_to_array(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>', '', 'g'), '(?is)<style[^>]*>.*?</style>', '', 'g'), '<[^>]+>'), lambda x: x <> '')"
_NORMAL = "trim(regexp_replace(regexp_replace(regexp_replace({x}, '[\\s\\x{{00a0}}\\x0b]+', ' ', 'g'), ' *- *', '-', 'g'), ' +([,;:])', '\\1', 'g'), ' ')"
_SELECTED = f"""WITH t AS (SELECT page_id, nodes, array_to_string(nodes, '') AS flat FROM (SELECT page_id, {_NODES} AS nodes FROM pages)),
b AS (SELECT page_id, nodes, flat, {_NORMAL.format(x="flat")} AS basic FROM t),
q AS (SELECT *, CASE page_id % 4 WHEN 3 THEN 'no such words are here' ELSE substr(basic, 41, 80) END AS want, CASE page_id % 4 WHEN 1 THEN replace(substr(basic, 41, 80), ' ', '   ') WHEN 2 THEN replace(replace(substr(basic, 41, 80), ',', ' ,'), '-', ' - ') WHEN 3 THEN 'no such words are here' ELSE substr(basic, 41, 80) END AS passage FROM b WHERE length(basic) >= 160),
f AS MATERIALIZED (SELECT page_id, instr(basic, part) - 1 AS "start", instr(basic, part) - 1 + length(part) AS stop, flat, nodes FROM (SELECT *, {_NORMAL.format(x="passage")} AS part FROM q) WHERE contains(basic, part)),
c AS (SELECT page_id, unnest(string_split(flat, '')) AS c, unnest(range(1, length(flat) + 1)) AS i FROM f),
w AS (SELECT *, regexp_matches(c, '[\\s\\x{{00a0}}\\x0b]') AS ws FROM c),
x AS MATERIALIZED (SELECT *, lag(ws) OVER o AS before, sum(CASE WHEN ws THEN 0 ELSE 1 END) OVER o AS run FROM w WINDOW o AS (PARTITION BY page_id ORDER BY i)),
k AS MATERIALIZED (SELECT x.page_id, x.i, row_number() OVER (PARTITION BY x.page_id ORDER BY x.i) - 1 AS place FROM x LEFT JOIN x p ON p.page_id = x.page_id AND p.run = x.run AND NOT p.ws LEFT JOIN x n ON n.page_id = x.page_id AND n.run = x.run + 1 AND NOT n.ws
  WHERE NOT x.ws OR (NOT x.before AND p.c <> '-' AND coalesce(n.c NOT IN ('-', ',', ';', ':'), true))),
y AS (SELECT page_id, max(i) FILTER (place = "start") AS a, max(i) FILTER (place = stop) AS e FROM k JOIN (SELECT page_id, "start", stop FROM f) USING (page_id) GROUP BY 1),
z AS (SELECT page_id, substr(flat, a, e - a) AS text, a, e FROM y JOIN f USING (page_id)),
g AS (SELECT page_id, m, coalesce(sum(n) OVER (PARTITION BY page_id ORDER BY m ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begins FROM (SELECT page_id, unnest(range(0, len(nodes))) AS m, length(unnest(nodes)) AS n FROM f)),
d AS (SELECT z.page_id, any_value(text) AS text, max(m) FILTER (begins < a) AS n1, any_value(a) - 1 - max(begins) FILTER (begins < a) AS o1, max(m) FILTER (begins < e) AS n2, any_value(e) - 1 - max(begins) FILTER (begins < e) AS o2 FROM z JOIN g USING (page_id) GROUP BY 1)
SELECT q.page_id, text IS NOT NULL AS ok, CASE WHEN text IS NULL THEN 'NEEDLE_NOT_IN_CONTAINER' END AS error, false AS deep, CAST(n1 AS INT) AS first_node, CAST(o1 AS INT) AS first_offset, CAST(n2 AS INT) AS last_node, CAST(o2 AS INT) AS last_offset, text FROM q LEFT JOIN d USING (page_id)"""

@plans.add("simulate_select", _SELECTED)
def simulate_select(spark, sf_dir):
    """Eighty characters of every page's normal text, spaced in other ways or not there, as a selection over its text nodes."""
    bare = F.regexp_replace(F.regexp_replace("html", "(?is)<script[^>]*>.*?</script>", ""), "(?is)<style[^>]*>.*?</style>", "")
    pages = table(spark, sf_dir, "pages").select("page_id", F.filter(F.split(bare, "<[^>]+>"), lambda x: x != "").alias("nodes"))
    basic = pages.select("page_id", "nodes", T.normalize_selection(F.array_join("nodes", "")).alias("basic")).where(F.length("basic") >= 160)
    piece = F.substring("basic", 41, 80)
    kind = F.col("page_id") % 4
    passage = F.when(kind == 1, F.replace(piece, F.lit(" "), F.lit("   "))).when(kind == 2, F.replace(F.replace(piece, F.lit(","), F.lit(" ,")), F.lit("-"), F.lit(" - "))).when(kind == 3, "no such words are here").otherwise(piece)
    return basic.select("page_id", A.simulate_select(F.col("nodes"), passage).alias("s")).select("page_id", "s.*")


QUERIES, SQL = plans.QUERIES, plans.SQL
FLAGSHIP = cite_benchmark
