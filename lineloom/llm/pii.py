"""Personal data and secrets replaced by keyed surrogates of the same kind, in DataFrame functions only.

An entity's canonical form (lower-cased, or digits alone) is mapped by a keyed hash to a canonical surrogate: letters
to letters and digits to digits at each place, addresses to valid octets, card numbers with their issuer digit and a
valid check digit, names to names of the same gender and script. Each mention then gets the surrogate in its own format
(separators, brackets, case), so all mentions of one entity stay one entity.

A surname is an entity of its own, so that a person named in full and by surname stays one; a given name is drawn for the
person. Names are found after a title, or with a known given name, in Latin, Cyrillic and Greek script.

Distinctness is checked over all documents: a surrogate that is an original somewhere, or that two entities would
share, is drawn again under another attempt number until none is. The first draw needs no join; only entities that
were drawn again (few, and checked) are joined back to the texts that mention them.

The key is the caller's, or the session's setting KEY_SETTING, or else made at random for the session: whoever has it can
find out originals by trial. It stands in query plans, so event logs are to be kept like the texts.
"""

from __future__ import annotations

import secrets
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lineloom.llm.common import scratch, table, text_key, without

#: Rows of drawn-again mentions that may be broadcast (some 100 bytes a row); more are joined by shuffle.
BROADCAST_ROWS = 50_000
KEY_SETTING = "spark.lineloom.pii.secret"

#: Given names by script and gender, and syllables of other names by script.
GIVEN = {
    ("latin", "f"): "Ada Alice Berta Carla Clara Dora Edith Elena Emma Flora Greta Hanna Ida Irene Julia Klara Laura Lena Lucia Maria Marta Nina Nora Olga Paula Rita Rosa Sara Sofia Tina Vera Wilma".split(),
    ("latin", "m"): "Adam Albert Anton Arthur Bruno Carlos David Diego Emil Erik Felix Frank Georg Hugo Ivan Jakob Jean Karl Leon Louis Lukas Marco Martin Max Oskar Otto Paul Pedro Peter Robert Thomas Viktor".split(),
    ("cyrillic", "f"): "Анна Вера Дарья Елена Инна Ирина Лидия Мария Нина Ольга Софья Юлия".split(),
    ("cyrillic", "m"): "Антон Борис Виктор Глеб Денис Иван Игорь Лев Никита Олег Павел Юрий".split(),
    ("greek", "f"): "Άννα Βασιλική Ελένη Ειρήνη Ζωή Κατερίνα Μαρία Σοφία".split(),
    ("greek", "m"): "Ανδρέας Γιώργος Δημήτρης Κώστας Νίκος Παύλος Πέτρος Στέφανος".split(),
}
SYLLABLES = {
    "latin": "ba bel bor car dan del dor fal fer gar gor hal hol kan kel lan lin lor mar mel mon nar nel nor pal per ral ren ros sal sel son tal ter tor val ver vin wal win zan zel".split(),
    "cyrillic": "бар бел вал вер гор дан зор кор лан лев мар мир нор рад ров сав сел тар тол ум".split(),
    "greek": "βαλ γαρ δαν θαλ καλ κορ λαν μαν μελ νικ παλ ραν σαλ ταν φαν χαρ".split(),
}
#: Common given names that are recognised beside those above.
KNOWN = {
    "f": "Angela Anna Barbara Catherine Charlotte Elizabeth Eva Helen Isabel Jane Jennifer Katharina Linda Margaret Marie Mary Monika Patricia Sarah Susan Ursula".split(),
    "m": "Andreas Charles Daniel Edward François George Hans Heinrich Henry Jack James John Jorge José Juan Klaus Mark Matthew Michael Miguel Pierre Richard Stefan Steven William Wolfgang".split(),
}
TITLES = {"f": "Mrs Ms Miss Frau Madame Mme Señora Sra Госпожа Κυρία".split(), "m": "Mr Herr Monsieur Señor Sr Господин Κύριος".split(), "n": "Dr Prof Doctor Professor".split()}
_GIVEN_OF = {g: sorted({n.lower() for (_, sex), ns in GIVEN.items() if sex == g for n in ns} | {n.lower() for n in KNOWN[g]}) for g in "fm"}


def _either(words: list[str], cases: tuple[Callable[[str], str], ...]) -> str:
    """Any of the words, long ones first, grouped by their first letter."""
    rests: dict[str, set[str]] = {}
    for w in {f(w) for w in words for f in cases}:
        rests.setdefault(w[0], set()).add(w[1:])
    return "|".join(f"{c}(?:{'|'.join(sorted(r, key=lambda w: (-len(w), w)))})" for c, r in sorted(rests.items()))


#: Letters of the scripts that there are surrogates for; a word with a capital, or in capitals; words with hyphens.
_UP, _LOW = (rf"[\p{{IsLatin}}\p{{IsCyrillic}}\p{{IsGreek}}&&\p{{{c}}}]" for c in ("Lu", "Ll"))
_WORD = rf"{_UP}(?:['’]{_UP})?(?:{_LOW}+(?:{_UP}{_LOW}+)?|{_UP}+)"
_NAME = rf"{_WORD}(?:-{_WORD})*"
_SPACE = "[ \u00a0]"
_TITLE = rf"(?:{_either([t for ts in TITLES.values() for t in ts], (str, str.upper))})\.?{_SPACE}"
_SMALL_TITLE = rf"(?:mr|mrs|ms|dr|prof)\.?{_SPACE}"
_FIRST = _either([n for ns in [*GIVEN.values(), *KNOWN.values()] for n in ns], (str, str.upper))
_SMALL_FIRST = _either([n for ns in [*GIVEN.values(), *KNOWN.values()] for n in ns], (str.lower,))

#: Where a name can start: tells most places at their first letter.
_START = r"(?=[\p{Lu}mdp])(?<!\p{L})"

#: Kinds in the order in which a place is tried; each pattern's whole match is the entity.
PATTERNS = {
    "aws_key": r"\bAKIA[0-9A-Z]{16}\b",
    "secret": r"\b\w*(?i:token|secret|password|passwd|api_?key)[\"']?\s*[=:]\s*(?:\"[^\"\s]{6,}\"|'[^'\s]{6,}'|[^\s\"',;]{5,}[A-Za-z0-9])",
    "email": r"(?<![A-Za-z0-9])(?<![A-Za-z0-9][._%+\-]{1,8})[A-Za-z0-9][A-Za-z0-9._%+\-]*@[A-Za-z0-9](?:[A-Za-z0-9\-]*\.)+[A-Za-z]{2,}",
    "ip": r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?![\w]|\.\d)",
    "ssn": r"(?<![\w\-])\d{3}-\d{2}-\d{4}(?![\w\-])",
    "card": r"(?<![\w\-])\d(?:[ \-]?\d){12,18}(?![\w\-])",
    "phone": r"(?<![\w+])(?:\+\d{1,3}[ .\-]?(?:\(\d{1,4}\)[ .\-]?)?\d{2,4}(?:[ .\-]?\d{2,4}){1,4}|\(\d{3}\) ?\d{3}[ .\-]\d{4}|\d{3}[.\-]\d{3}[.\-]\d{4})(?!\w)",
    "iban": r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b",
    "name": rf"{_START}(?:(?:{_TITLE}){{1,2}}(?:{_NAME}{_SPACE})?{_NAME}|(?:{_FIRST}){_SPACE}{_NAME}|{_SMALL_TITLE}(?:{_SMALL_FIRST}){_SPACE}{_LOW}+(?:-{_LOW}+)*)(?!\p{{L}})",
}
#: A name's titles.
_TITLED = rf"^((?:{_TITLE}|{_SMALL_TITLE}){{0,2}})"
_ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: A text without any of these holds no entity; cheaper than the full pattern.
_MAYBE = rf"[0-9@]|AKIA|[=:]\s*\S{{6}}|{_START}(?:{_TITLE}|{_SMALL_TITLE}|(?:{_FIRST}){_SPACE}{_UP})"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def kind_of(mention: Column) -> Column:
    """The kind of a mention; a long number that fails the check of cards is `number`, and no entity."""
    found = None
    for kind, pattern in PATTERNS.items():
        test = mention.rlike(rf"^(?:{pattern})$")
        value = F.when(luhn_total(F.regexp_replace(mention, r"\D", "")) % 10 == 0, F.lit(kind)).otherwise(F.lit("number")) if kind == "card" else F.lit(kind)
        found = F.when(test, value) if found is None else found.when(test, value)
    return found


def words_of(mention: Column) -> Column:
    """A name's words without titles."""
    return F.split(F.regexp_replace(mention, _TITLED, ""), _SPACE)


def canonical(kind: Column, mention: Column) -> Column:
    """One form for all mentions of an entity. A name is its gender (f, m, or n if neither title nor given name tells), its
    given name (empty if there is none) and its surname, with bars between."""
    title = F.lower(F.regexp_extract(mention, r"^(\p{L}+)", 1))
    names = F.transform(words_of(mention), F.lower)
    given = F.when(F.size(names) > 1, F.element_at(names, 1)).otherwise(F.lit(""))
    gender = F.lit("n")
    for g in "fm":
        gender = F.when(given.isin(*_GIVEN_OF[g]), F.lit(g)).otherwise(gender)
    for g in "fm":
        gender = F.when(title.isin(*[t.lower() for t in TITLES[g]]), F.lit(g)).otherwise(gender)
    return (
        F.when(kind.isin("card", "phone", "ssn"), F.regexp_replace(mention, r"\D", ""))
        .when(kind == "iban", F.regexp_replace(mention, " ", ""))
        .when(kind == "email", F.lower(mention))
        .when(kind == "name", F.concat_ws("|", gender, given, F.element_at(names, -1)))
        .when(kind == "secret", F.regexp_extract(mention, r"[=:]\s*[\"']?([^\"'\s]+)", 1))
        .otherwise(mention)
    )


def parts_of(kind: Column, canon: Column) -> Column:
    """The entities of a mention, as (kind, canon): a name is its surname, and the person if there is a given name."""
    surname = F.struct(F.lit("surname").alias("kind"), F.substring_index(canon, "|", -1).alias("canon"))
    person = F.struct(F.when(~canon.rlike(r"^.\|\|"), F.lit("person")).alias("kind"), canon.alias("canon"))
    one = F.struct(F.when(kind != "number", kind).alias("kind"), canon.alias("canon"))
    return F.filter(F.when(kind == "name", F.array(surname, person)).otherwise(F.array(one)), lambda e: e["kind"].isNotNull())


def bare(kind: Column, canon: Column) -> Column:
    """What a surrogate of the kind is compared with: a person without gender, all else as it is."""
    return F.when(kind == "person", F.regexp_replace(canon, r"^.\|", "")).otherwise(canon)


def _stream(key: str, kind: Column, canon: Column, attempt: Column) -> Column:
    """256 hex digits drawn by key, kind, attempt and entity."""
    return F.concat(*[F.sha2(F.concat_ws("\u0001", F.lit(key), F.lit(str(n)), kind, attempt.cast("string"), canon), 512) for n in (0, 1)])


def _draw(stream: Column, at: Column | int) -> Column:
    """A number from 0 to 65535 for place `at`."""
    place = F.pmod(at if isinstance(at, Column) else F.lit(at), F.lit(64)) * 4 + 1
    return F.conv(stream.substr(place.cast("int"), F.lit(4)), 16, 10).cast("int")


def _chars(stream: Column, canon: Column, keep: int = 0) -> Column:
    """Each letter or digit after the first `keep` characters to one of its class; hexadecimal words stay so."""
    hexadecimal = canon.rlike(r"^[0-9a-f]+$") & canon.rlike(r"[a-f]")

    def moved(c: Column, i: Column) -> Column:
        n = _draw(stream, i)
        return (
            F.when(i < keep, c)
            .when(hexadecimal & c.rlike("^[a-f]$"), F.char((n % 6 + 97).cast("int")))
            .when(c.rlike("^[0-9]$"), F.char((n % 10 + 48).cast("int")))
            .when(c.rlike("^[a-z]$"), F.char((n % 26 + 97).cast("int")))
            .when(c.rlike("^[A-Z]$"), F.char((n % 26 + 65).cast("int")))
            .otherwise(c)
        )

    return F.array_join(F.transform(F.split(canon, ""), moved), "")


def luhn_total(digits: Column) -> Column:
    """The Luhn sum of a run of digits, the last one being the check digit."""
    of = F.transform(F.reverse(F.split(digits, "")), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(F.when(c.cast("int") > 4, 2 * c.cast("int") - 9).otherwise(2 * c.cast("int"))))
    return F.aggregate(of, F.lit(0), lambda a, x: a + x)


def _card(stream: Column, canon: Column) -> Column:

    def checked(body: Column) -> Column:
        front = body.substr(F.lit(1), F.length(body) - 1)
        return F.concat(front, ((10 - luhn_total(F.concat(front, F.lit("0"))) % 10) % 10).cast("string"))

    return let(_chars(stream, canon, 1), lambda body: F.when(luhn_total(canon) % 10 == 0, checked(body)).otherwise(body))


def _ip(stream: Column, canon: Column) -> Column:
    def octet(o: Column, i: Column) -> Column:
        n = _draw(stream, i)
        return F.when(F.length(o) == 1, n % 9 + 1).when(F.length(o) == 2, n % 90 + 10).otherwise(n % 155 + 100).cast("string")

    return F.array_join(F.transform(F.split(canon, r"\."), octet), ".")


def _phone(stream: Column, canon: Column) -> Column:
    """The first digit (of the country code) stays; the second place and the fourth last seven never become 0 or 1."""
    digits = _chars(stream, canon, 1)
    return F.array_join(F.transform(F.split(digits, ""), lambda c, i: F.when(((i == 1) | (i == F.length(canon) - 7)) & c.isin("0", "1"), F.char((_draw(stream, i + 31) % 8 + 50).cast("int"))).otherwise(c)), "")


def _email(stream: Column, canon: Column) -> Column:
    """The last label of the domain stays."""
    tail = F.regexp_extract(canon, r"\.[a-z]+$", 0)
    return F.concat(_chars(stream, canon.substr(F.lit(1), F.length(canon) - F.length(tail))), tail)


def _script(word: Column) -> Column:
    return F.when(word.rlike(r"\p{IsCyrillic}"), F.lit("cyrillic")).when(word.rlike(r"\p{IsGreek}"), F.lit("greek")).otherwise(F.lit("latin"))


def _pick(options: list[str], stream: Column, at: Column | int) -> Column:
    return F.element_at(F.array(*map(F.lit, options)), _draw(stream, at) % len(options) + 1)


def _made(stream: Column, script: Column, first: Column | int, count: Column) -> Column:
    """`count` syllables in lower case, drawn from place `first` on."""

    def syllable(k: Column) -> Column:
        at = k + first
        return F.when(script == "cyrillic", _pick(SYLLABLES["cyrillic"], stream, at)).when(script == "greek", _pick(SYLLABLES["greek"], stream, at)).otherwise(_pick(SYLLABLES["latin"], stream, at))

    return F.array_join(F.transform(F.sequence(F.lit(0), count - 1), syllable), "")


def _surname(stream: Column, canon: Column, attempt: Column) -> Column:
    """As many parts with hyphens as there were, of three syllables, and one more for every four attempts."""
    size = F.floor(attempt / 4).cast("int") + 3
    parts = F.transform(F.split(canon, "-"), lambda part, k: _made(stream, _script(part), k * 8, size))
    return F.array_join(parts, "-")


def _person(stream: Column, canon: Column, attempt: Column) -> Column:
    """A given name of the gender and script, and the surname as it was; after some attempts the given name is made up."""
    fields = F.split(canon, r"\|")
    gender, given, surname = (F.element_at(fields, k) for k in (1, 2, 3))
    female = (gender == "f") | (gender == "n") & (_draw(stream, 40) % 2 == 0)
    script = _script(given)

    def listed(script: str) -> Column:
        return F.when(female, F.lower(_pick(GIVEN[script, "f"], stream, 0))).otherwise(F.lower(_pick(GIVEN[script, "m"], stream, 0)))

    end = F.when(script == "cyrillic", F.when(female, F.lit("а")).otherwise(F.lit("ий"))).when(script == "greek", F.when(female, F.lit("α")).otherwise(F.lit("ος"))).otherwise(F.when(female, F.lit("a")).otherwise(F.lit("us")))
    made = F.concat(_made(stream, script, 1, F.floor(attempt / 6).cast("int") + 2), end)
    named = F.when(script == "cyrillic", listed("cyrillic")).when(script == "greek", listed("greek")).otherwise(listed("latin"))
    return F.concat_ws("|", F.when(attempt < 3, named).otherwise(made), surname)


def surrogate(key: str, kind: Column, canon: Column, attempt: Column) -> Column:
    """The canonical surrogate of a canonical entity."""

    def mapped(s: Column) -> Column:
        return (
            F.when(kind == "ip", _ip(s, canon))
            .when(kind == "card", _card(s, canon))
            .when(kind == "phone", _phone(s, canon))
            .when(kind == "email", _email(s, canon))
            .when(kind == "surname", _surname(s, canon, attempt))
            .when(kind == "person", _person(s, canon, attempt))
            .when(kind.isin("aws_key", "iban"), _chars(s, canon, 4))
            .otherwise(_chars(s, canon))
        )

    return let(_stream(key, kind, canon, attempt), mapped)


def rendered(kind: Column, mention: Column, canon: Column, new: Column) -> Column:
    """The surrogate in the mention's format: digits into the mention's places, cases as they were."""

    def place(state: Column, c: Column) -> Column:
        taken = (kind == "iban") & c.rlike("^[0-9A-Z]$") | c.rlike("^[0-9]$")
        return F.struct(F.when(taken, state["i"] + 1).otherwise(state["i"]).alias("i"), F.concat(state["s"], F.when(taken, new.substr(state["i"], F.lit(1))).otherwise(c)).alias("s"))

    grouped = F.aggregate(F.split(mention, ""), F.struct(F.lit(1).alias("i"), F.lit("").alias("s")), place, lambda s: s["s"])
    cased = F.array_join(F.zip_with(F.split(mention, ""), F.split(new, ""), lambda a, b: F.when(a.rlike("^[A-Z]$"), F.upper(b)).otherwise(b)), "")
    return F.when(kind.isin("card", "phone", "ssn", "iban"), grouped).when(kind == "email", cased).when(kind == "secret", F.replace(mention, canon, new)).otherwise(new)


def _like(word: Column, new: Column) -> Column:
    """A name in the case of the word it stands for."""
    capital = F.array_join(F.transform(F.split(new, "-"), F.initcap), "-")
    return F.when(word == F.lower(word), new).when((F.length(word) > 1) & (word == F.upper(word)), F.upper(new)).otherwise(capital)


def renamed(mention: Column, given: Column, surname: Column) -> Column:
    """A name with its titles and spaces as they were; `given` counts only if the mention has a given name."""
    names = words_of(mention)
    front = F.regexp_extract(mention, _TITLED, 1)
    last = _like(F.element_at(names, -1), surname)
    between = F.regexp_extract(F.regexp_replace(mention, _TITLED, ""), _SPACE, 0)
    return F.concat(front, F.when(F.size(names) > 1, F.concat(_like(F.element_at(names, 1), given), between, last)).otherwise(last))


def with_mentions(df: DataFrame, text_col: str) -> DataFrame:
    """df with __m: an array of (kind, mention, canon) in text order; empty if there are none."""
    text = F.col(text_col)
    found = F.when(text.rlike(_MAYBE), F.regexp_extract_all(text, F.lit(_ANY), F.lit(0)))
    rows = df.withColumn("__found", F.coalesce(found, F.array().cast("array<string>")))
    kinds = F.transform("__found", lambda m: F.struct(kind_of(m).alias("kind"), m.alias("mention")))
    full = F.transform("__kinds", lambda k: F.struct(k["kind"].alias("kind"), k["mention"].alias("mention"), canonical(k["kind"], k["mention"]).alias("canon")))
    return rows.withColumn("__kinds", kinds).withColumn("__m", full).drop("__found", "__kinds")


def redrawn(entities: DataFrame, key: str, most_attempts: int = 50) -> DataFrame:
    """(kind, canon, new) of the entities that need another draw than the first.

    entities: distinct (kind, canon). A draw clashes if it is an original of its kind, or another entity of the kind
    has it already or has it too and comes first (by canonical form).
    """
    now = scratch(entities.withColumn("new", surrogate(key, F.col("kind"), F.col("canon"), F.lit(0))), "drawn")
    own = bare(F.col("kind"), F.col("canon"))
    taken = now.select("kind", "new", "canon").unionAll(now.select("kind", own.alias("new"), F.lit(None).cast("string").alias("canon")).distinct())
    groups = taken.groupBy("kind", "new").agg(F.count("*").alias("n"), F.max(F.col("canon").isNull()).alias("original"), F.min("canon").alias("first"))
    clash = groups.where("n > 1").select("kind", "new", "original", "first")
    bad = scratch(now.join(clash, ["kind", "new"]).where("original OR canon <> first").select("kind", "canon"), "clashes")
    done = None
    for attempt in range(1, most_attempts + 1):
        if not bad.limit(1).count():
            break
        tried = bad.withColumn("new", surrogate(key, F.col("kind"), F.col("canon"), F.lit(attempt)))
        held = now.select("kind", "new").unionAll(now.select("kind", own.alias("new")))
        if done is not None:
            held = held.unionAll(done.select("kind", "new"))
        free = tried.join(held, ["kind", "new"], "left_anti").groupBy("kind", "new").agg(F.min("canon").alias("canon")).select("kind", "canon", "new")
        free = scratch(free, "free")
        done = free if done is None else scratch(done.unionAll(free), "redrawn")
        bad = scratch(bad.join(free, ["kind", "canon"], "left_anti"), "clashes")
    else:
        raise RuntimeError(f"surrogates still clash after {most_attempts} draws")
    return done if done is not None else now.limit(0)


def key_of(spark: SparkSession) -> str:
    """The session's key; without one, a random one is set, so that all calls of the session agree."""
    if not spark.conf.get(KEY_SETTING, None):
        spark.conf.set(KEY_SETTING, secrets.token_hex(32))
    return spark.conf.get(KEY_SETTING)


def pseudonymise(df: DataFrame, key: str | None = None, text_col: str = "text") -> DataFrame:
    """df with its text's entities replaced, and n_entities (mentions replaced).

    The same key (see key_of) and documents give the same surrogates on every run. Null and empty texts stay as they are
    with n_entities 0; a text without entities is not changed; repeated rows come out alike; an empty table gives an empty
    one. An input column named n_entities is replaced, all others carried. Texts are not shuffled unless a mention was
    drawn again, and then only if there are too many such mentions to broadcast.
    """
    spark = df.sparkSession
    key = key or key_of(spark)
    rows = with_mentions(without(df, ["n_entities"]), text_col)
    parts = F.explode(F.flatten(F.transform("__m", lambda m: parts_of(m["kind"], m["canon"])))).alias("m")
    entities = rows.where(F.size("__m") > 0).select(parts).select("m.kind", "m.canon").distinct()
    again = redrawn(entities, key)
    if again.limit(1).count():
        hit = rows.where(F.size("__m") > 0).select(text_key(text_col).alias("k"), parts).select("k", "m.kind", "m.canon").distinct()
        # One row a text: its redrawn entities as a map.
        maps = hit.join(again, ["kind", "canon"]).groupBy("k").agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws("\u0001", "kind", "canon"), "new"))).alias("__new"))
        maps = scratch(maps, "redrawn-by-text")
        few = maps.agg(F.sum(F.size("__new"))).first()[0] or 0
        maps = F.broadcast(maps) if few <= BROADCAST_ROWS else maps
        rows = rows.withColumn("__k", text_key(text_col)).join(maps, F.col("__k") == F.col("k"), "left").drop("k", "__k")
    else:
        rows = rows.withColumn("__new", F.lit(None).cast("map<string,string>"))

    def settled(kind: Column, canon: Column) -> Column:
        return F.coalesce(F.col("__new")[F.concat_ws("\u0001", kind, canon)], surrogate(key, kind, canon, F.lit(0)))

    def named(m: Column) -> Column:
        surname, person = (settled(F.lit(kind), canon) for kind, canon in (("surname", F.substring_index(m["canon"], "|", -1)), ("person", m["canon"])))
        return renamed(m["mention"], F.substring_index(person, "|", 1), surname)

    def renewed(m: Column) -> Column:
        other = let(settled(m["kind"], m["canon"]), lambda n: rendered(m["kind"], m["mention"], m["canon"], n))
        return F.when(m["kind"] == "number", m["mention"]).when(m["kind"] == "name", named(m)).otherwise(other)

    between = F.split(F.col(text_col), _ANY, -1)
    made = F.array_join(F.flatten(F.zip_with("__gaps", "__made", lambda gap, new: F.array(gap, F.coalesce(new, F.lit(""))))), "")
    count = F.size(F.filter("__m", lambda m: m["kind"] != "number"))
    some = count > 0
    out = rows.withColumn("__gaps", F.when(some, between)).withColumn("__made", F.when(some, F.transform("__m", renewed)))
    kept = [F.when(some, made).otherwise(F.col(text_col)).alias(text_col) if c == text_col else F.col(f"`{c}`") for c in df.columns if c.lower() != "n_entities"]
    return out.select(*kept, count.cast("long").alias("n_entities"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with surrogates."""
    return pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "text", "n_entities")
