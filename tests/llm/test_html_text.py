"""Page extraction: the line-block step against its definition, and what markup may and may not leave out."""

import random
import time

import pytest

from lineloom.llm import html_text
from tests.llm.test_llm import SF

LONG = ("long text " * 30).strip()


def brute_kept(lengths, block, surge):
    """Lines whose every window is empty part the stretches."""
    n = len(lengths)
    sums = [sum(lengths[i : min(n, i + block)]) for i in range(n)]
    least = min(surge, max(sums, default=0) // 2 + 1)
    some = [i for i in range(n) if lengths[i]]
    near = [[j for j in some if all(any(lengths[k : k + block]) for k in range(min(i, j), max(i, j)))] for i in some]
    texts = [i for i, group in zip(some, near, strict=True) if any(sums[k] >= least for j in group for k in range(max(0, j - block + 1), j + 1) if all(any(lengths[x : x + block]) for x in range(k, j)))]
    return (texts[0], texts[-1] + 1) if texts else None


def test_block_step_by_definition():
    r = random.Random(1)
    for _ in range(3000):
        lengths = [r.choice([0, 0, 0, 0, 3, 20, 60]) for _ in range(r.randint(0, 25))]
        block, surge = r.choice([1, 2, 3, 4]), r.choice([10, 86])
        assert html_text.kept(lengths, block, surge) == brute_kept(lengths, block, surge)


LINKS = "<ul>" + "".join(f"<li><a href=x>Link number {i}</a></li>" for i in range(6)) + "</ul>"


@pytest.mark.parametrize("tag", ["article", "main", "div"])
def test_block_step_decides_with_and_without_an_article(monkeypatch, tag):
    page = f"<body><{tag}>{LINKS}<p>By us</p>{LINKS}<h1>T</h1><p>{LONG}</p>{LINKS}<p>{LONG}</p>{LINKS}<p>Tags</p></{tag}></body>"
    links = [f"Link number {i}" for i in range(6)]
    want = "\n\n".join(["T", LONG, *links, LONG])
    assert html_text.main_text(page) == want
    monkeypatch.setattr(html_text, "kept", lambda lengths: (0, len(lengths)))
    assert html_text.main_text(page) == "\n\n".join([*links, "By us", *links, "T", LONG, *links, LONG, *links, "Tags"])


@pytest.mark.parametrize(
    ("part", "text"),
    [
        ('<h2 id="search-algorithms">Search algorithms</h2>', "Search algorithms"),
        (f'<section id="related-work"><p>{LONG}</p></section>', LONG),
        ('<p class="notice-period">Three months.</p>', "Three months."), ('<p class="notice">Read this.</p>', "Read this."), ('<h3 id="login">Login</h3>', "Login"),
        ('<div class="notice-period">Three months.</div>', "Three months."), ('<div class="header-image caption">A view.</div>', "A view."),
        ("<p>Let <math><mi>x</mi></math> be given.</p>", "Let x be given."),
        ("<p><a href=x>Only a link.</a></p>", "Only a link."), ("<table><tr><td>1</td></tr></table>", "1"),
        ('<div class="cookie-banner">We use them.</div>', ""), ('<div class="ad">Buy.</div>', ""), ('<div class="social-share-buttons">Share</div>', ""), ('<div id="comments">First!</div>', ""), ('<div role="alert">Hey</div>', ""),
        ('<section class="comment-list"><p>Nice one.</p></section>', ""), ("<aside>Side</aside>", ""), ("<form><p>Name</p></form>", ""), ("<p hidden>None</p>", ""), ("<div class='sidebar left'>Side</div>", ""),
    ],
)
@pytest.mark.parametrize("tag", ["article", "div"])
def test_markup_leaves_out_boxes_not_text(part, text, tag):
    page = f"<body><nav>menu</nav><{tag}><h1>T</h1><p>{LONG}</p>{part}<p>{LONG}</p></{tag}><footer>f</footer></body>"
    assert html_text.main_text(page) == "\n\n".join(["T", LONG, *filter(None, [text]), LONG])


@pytest.mark.parametrize("part", ["<b>", "</i>", "<b></i>", "<div>", "<div>x", "<li>", "<p><b>x</i>", "<h1>x</p>", "<div class=ad><article>", "<nav><article>x", "<a x='>", "<td><b>", "&amp;", "<!--", "<script>"])
def test_hostile_pages_take_time_in_proportion(part):
    began = time.time()
    html_text.main_text(part * 50_000)
    assert time.time() - began < 8


def test_unmatched_tags_are_quick():
    began = time.time()
    assert html_text.main_text("<b>" * 25_000 + "</i>" * 25_000 + "x") == "x"
    assert time.time() - began < 1


def test_articles_of_the_sample_pages_are_whole(spark):
    """Brute force on plain pages: what stands between <article> and </article>, without tags."""
    import html
    import re

    rows = html_text.op5_html_text(spark, SF).collect()
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    assert sorted(r.page_id for r in rows) == sorted(pages)
    for r in rows:
        body = re.search(r"<article>(.*?)</article>", pages[r.page_id], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", re.sub(r"<br>", " ", b))).split()) for b in re.split(r"</?(?:h1|p|ul|li)>", body)]
        assert r.text == "\n\n".join(filter(None, blocks)) and r.n_chars == len(r.text)


def test_frames(spark):
    df = spark.createDataFrame([(1, None, 3), (1, None, 3), (2, "<p>" + "w " * 300_000, 4)], "page_id long, html string, N_chars int")
    got = html_text.extract(df)
    assert got.columns == ["page_id", "text", "n_chars"] and sorted((r.page_id, r.n_chars) for r in got.collect()) == [(1, 0), (1, 0), (2, 599_999)]
    assert html_text.extract(df.limit(0)).count() == 0
