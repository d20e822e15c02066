"""HTML pages to text, by expressions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from lineloom.functions.text import collapse, let

#: Named character references.
ENTITIES = {
    "nbsp": " ", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "mdash": "—", "ndash": "–", "hellip": "…", "rsquo": "’", "lsquo": "‘", "rdquo": "”", "ldquo": "“",
    "middot": "·", "deg": "°", "times": "×", "divide": "÷", "micro": "µ", "alpha": "α", "beta": "β", "gamma": "γ", "delta": "δ", "epsilon": "ε", "pi": "π", "Omega": "Ω", "amp": "&",
}


def _code_point(number: Column) -> Column:
    """The character of a code point, by way of its UTF-32 bytes; null beyond Unicode."""
    return F.when((number > 0) & (number < 0x110000) & ~number.between(0xD800, 0xDFFF), F.decode(F.unhex(F.lpad(F.hex(number.cast("long")), 8, "0")), "UTF-32"))


def decode_entities(text: Column) -> Column:
    """Numeric references, then named ones; what is unknown stays. Text without a reference is not cut up. Each step's text
    is computed once."""

    def replaced(pattern: str, made: Callable[[Column, Column], Column]) -> Callable[[Column], Column]:
        def step(text: Column) -> Column:
            gaps = F.split(text, pattern, -1)
            signs = F.zip_with(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), made)
            joined = F.array_join(F.flatten(F.zip_with(gaps, signs, lambda g, c: F.array(g, F.coalesce(c, F.lit(""))))), "")
            return F.when(text.rlike(pattern), joined).otherwise(text)

        return step

    def numeric(base: int) -> Callable[[Column, Column], Column]:
        return lambda d, mark: F.coalesce(_code_point(F.conv(d, base, 10).try_cast("long")), mark)

    table = F.create_map(*[F.lit(x) for pair in ENTITIES.items() for x in pair])
    decimal, hexadecimal = replaced(r"&#(\d{1,7});", numeric(10)), replaced(r"&#x([0-9a-fA-F]{1,6});", numeric(16))
    named = replaced("&([a-zA-Z]+);", lambda n, mark: F.coalesce(F.try_element_at(table, n), mark))
    return let(text, lambda t: let(decimal(t), lambda u: let(hexadecimal(u), named)))


def html_sections(page: Column) -> Column:
    """The description and claims sections, or the whole page if it has neither."""
    found = [F.regexp_extract(page, rf"(?is)<section[^>]*itemprop=[\"']{n}[\"'][^>]*>.*?</section>", 0) for n in ("description", "claims")]
    return F.when((found[0] == "") & (found[1] == ""), page).when(page.isNotNull(), F.concat_ws(" ", *found))


def html_to_body(page: Column) -> Column:
    bare = F.regexp_replace(page, r"(?is)<script[^>]*>.*?</script>", " ")
    bare = F.regexp_replace(F.regexp_replace(bare, r"(?is)<style[^>]*>.*?</style>", " "), r"<[^>]+>", " ")
    return collapse(decode_entities(bare))


def text_nodes(page: Column) -> Column:
    """What stands between tags, in order, without blanks."""
    return F.filter(F.split(page, r"<[^>]*>"), lambda t: F.trim(t) != "")


def find_pdf_link(page: Column, doc: Column) -> Column:
    """The link that ends in the document's own file, else the first link to a file."""
    links = F.regexp_extract_all(page, F.lit(r"(https?://[^\s\"'<>]+\.pdf)"), F.lit(1))
    own = F.try_element_at(F.filter(links, lambda x: x.endswith(F.concat(F.lit("/"), doc, F.lit(".pdf")))), F.lit(1))
    return F.coalesce(own, F.try_element_at(links, F.lit(1)))
