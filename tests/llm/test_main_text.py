"""Extraction against the marked articles, and on pages that do not mark theirs."""

import html
import re
import time

import pytest

from palisade.llm import main_text, queries


@pytest.fixture(scope="module")
def weights(spark, small):
    return main_text.fit_weights(spark.read.parquet(f"{small}/pages.parquet"))


def marked(page):
    """The blocks of the one article, by its tags."""
    article = re.search(r"<article>(.*?)(?:</article>|$)", page, re.S)[1]
    blocks = (re.sub(r"</?b>", "", b.replace("<br>", " ")) for b in re.split(r"</?(?:p|h1)>", article))
    return "\n".join(b for b in (" ".join(html.unescape(b).split()) for b in blocks) if b)


def test_op3_extracts_the_marked_articles(spark, small):
    pages = {r["page_id"]: r for r in spark.read.parquet(f"{small}/pages.parquet").collect()}
    rows = queries.op3_best_region(spark, small).collect()
    assert len(rows) == len(pages)
    for r in rows:
        assert r["text"] == marked(pages[r["page_id"]]["html"])
        assert r["n_chars"] == len(r["text"]) and r["url"] == pages[r["page_id"]]["url"]


def test_the_scan_decides(spark, small, weights, monkeypatch):
    """With the whole page as best region, menus, adverts and footers are all in the text."""
    pages = [r["html"] for r in spark.read.parquet(f"{small}/pages.parquet").limit(40).collect()]
    monkeypatch.setattr(main_text, "best_region", lambda scores: (0, len(scores)))
    assert all(main_text.main_text(page, weights) != marked(page) for page in pages)


def test_weights_come_from_labelled_pages(spark):
    """A class that no list names is left out, if labelled pages have it outside their articles only."""
    box = "<div class='zzbox'><p>{}</p></div>"
    page = box + "<div class='zzmain'><article><p>{}</p></article></div>" + box
    rows = [(i, page.format(f"Buy thing {i} now", f"Story number {i} has a few words more", "More things here")) for i in range(30)]
    weights = main_text.fit_weights(spark.createDataFrame(rows, "page_id long, html string"))
    assert weights["in .zzbox"] == main_text.ASIDE_WEIGHT and weights["in .zzmain"] == 0
    told = "".join(f"<p>Paragraph {i} of the story</p>" for i in range(3))
    want = "\n".join(f"Paragraph {i} of the story" for i in range(3))
    inner = told.replace("<p>Paragraph 1", box.format("Buy " * 300) + "<p>Paragraph 1")
    assert main_text.main_text(f"{box.format('Cheap ' * 300)}<div class='zzmain'>{inner}</div>{box.format('More ' * 99)}", weights) == want


@pytest.mark.parametrize("page", ["<b>" * 100_000, "<i>" * 100_000 + "</b>" * 100_000, "<div class=ad>" * 100_000, "<p class='a'>x" * 100_000, "<a '" * 50_000, "<!-- " * 50_000])
def test_long_pages_take_linear_time(weights, page):
    begun = time.process_time()
    main_text.main_text(page, weights)
    assert time.process_time() - begun < 20


@pytest.mark.parametrize(
    "old, new",
    [
        ("article>", "div>"),
        ("<article>", '<div class="post"><div class="site-notice"><p>Some notice that is long enough to count as text here</p></div>'),
        ("</article>", '<aside><p>One side note</p></aside></article><section id="comments"><p>A comment of several words</p></section>'),
    ],
)
def test_unmarked_pages(spark, small, weights, old, new):
    for r in spark.read.parquet(f"{small}/pages.parquet").limit(40).collect():
        assert main_text.main_text(r["html"].replace(old, new), weights) == marked(r["html"])


def test_small_pages(weights):
    extract = lambda page: main_text.main_text(page, weights)
    assert extract(None) == extract("") == extract("<html><body></body></html>") == ""
    assert extract("<p>a &lt;b&gt;\n c&nbsp;d<script>var x = '</p>'</script> e") == "a <b> c d e"
    assert extract("<p>one <i>two</i>three<br>four</p><p>five<!-- six") == "one twothree four\nfive"
    assert extract("<nav><p>only a menu</p></nav>") == ""
    assert extract("<p>" + "word " * 50_000) == " ".join(["word"] * 50_000)


def test_best_region_is_the_largest_sum():
    scores = [1, -3, 4, -1, 2, -9, 5, 0.5, -0.2]
    sums = {(i, j): sum(scores[i:j]) for i in range(9) for j in range(i + 1, 10)}
    assert main_text.best_region(scores) == max(sums, key=sums.get)


def test_odd_rows(spark, weights):
    pages = spark.createDataFrame([(1, None, "x"), (1, "<p>a b</p>", "x"), (1, "<p>a b</p>", "x")], "page_id long, html string, text string")
    assert [r["text"] for r in main_text.extract(pages, weights).orderBy("html").collect()] == ["", "a b", "a b"]
    assert main_text.extract(pages.where("false")).count() == 0


STORY = "".join(f"<p>This is sentence number {i} of a story that is long enough to be one.</p>" for i in range(6))
TOLD = "\n".join(f"This is sentence number {i} of a story that is long enough to be one." for i in range(6))
MENU = '<div class="main-nav"><a href="/">Home</a> <a href="/b">News</a></div>'


@pytest.mark.parametrize(
    "page",
    [
        f"<html><head><title>x</title><body>{STORY}</body></html>",
        f"<head><title>x</title><meta name=a>{STORY}",
        f"<head><noscript><link rel=a></noscript>{STORY}",
        f"<body><form action=x id=aspnetForm>{MENU}<div>{STORY}</div></form></body>",
        f"<body>{MENU}<div class='content-with-sidebar'>{STORY}</div></body>",
        f"<body>{MENU}<div id='page' class='no-sidebar has-banner'>{STORY}</div></body>",
        f"<body><div class='search-result'>{STORY}</div></body>",
        f"<body><div class='header'>{MENU}<article>{STORY}</article></div></body>",
        *(f"<body>{MENU}<div class='{name}'>{STORY}</div></body>" for name in ("post social-issues", "entry tags-linux", "post-form")),
        f"<body>{MENU}<section id='banner-story'>{STORY}</section></body>",
        f"<body>{STORY}<section id='comments'><article><p>{'A comment. ' * 200}</p></article></section></body>",
        f"<body>{STORY}<div class='cookie-notice'><p>{'We use cookies. ' * 100}</p></div></body>",
        f"<body>{STORY}<form class='search-form'>Find it<input name=q></form><div class='related-posts'><p>Another story to read</p></div></body>",
    ],
)
def test_asides_do_not_hide_the_article(weights, page):
    assert main_text.main_text(page, weights) == TOLD


@pytest.fixture(scope="module")
def fitted(spark):
    return main_text.fit_weights(spark.read.parquet("/root/testdata/sf0.01/pages.parquet"))


SOME = " ".join(f"word{k} flows here" for k in range(20))
FIRST, LAST = "The opening line of the text.", "And so it ends."
ROWS40 = "".join(f"<tr><td>a{k}</td><td>{k}</td></tr>" for k in range(40))


@pytest.mark.parametrize(
    "page,text",
    [
        (f"<body><nav>Home About</nav><article><form>{SOME}</form></article>", SOME),
        (f"<body><main><form action='/x'><p>{SOME}</p><input></form></main>", SOME),
        (f"<body><main><fieldset>{SOME}</fieldset></main>", SOME),
        (f"<body><article><p>{FIRST} {SOME}</p><form><label>Your mail</label><input><button>Go</button></form><p>{LAST}</p></article>", f"{FIRST} {SOME}\n{LAST}"),
        (f"<body><article><p>{FIRST}</p><table>{ROWS40}</table><p>{LAST}</p></article>", "\n".join([FIRST, *[x for k in range(40) for x in (f"a{k}", str(k))], LAST])),
        (f"<body><article><p>{FIRST}</p><table>{ROWS40[: 20 * 27]}</table><p>five words end it here</p></article>", None),
        (f"<body><article><p>{FIRST}</p><pre>{'<span>x</span> <span>=</span> ' * 60}</pre><p>{LAST}</p></article>", f"{FIRST}\n{'x = ' * 60}".strip() + f"\n{LAST}"),
        (f"<body><article><p>{FIRST} {SOME}</p><ol>{''.join(f'<li><a href=/{k}>Ref {k}</a></li>' for k in range(12))}</ol></article>", "\n".join([f"{FIRST} {SOME}", *[f"Ref {k}" for k in range(12)]])),
        (f"<body><article><p>{FIRST} <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>x=2</annotation></math> holds.</p></article>", f"{FIRST} x=2 holds."),
        (f"<body><article><p>{FIRST}</p><xmp><b>a &amp; b</b></xmp><p>{LAST}</p></article>", f"{FIRST}\n<b>a &amp; b</b>\n{LAST}"),
        (f"<body><div><header><h1>A title</h1></header><p>{SOME}</p></div>", f"A title\n{SOME}"),
        (f"<body><div><header><h1>A site</h1></header><h1>A title</h1><p>{SOME}</p></div>", f"A title\n{SOME}"),
        (f"<body><header><h1>A site</h1></header><div><p>{SOME}</p></div>", SOME),
    ],
)
def test_articles_stay_whole(fitted, page, text):
    """Tables, code, formulas, reference lists and what follows them; forms that hold the article."""
    got = main_text.main_text(page, fitted)
    assert got == text if text is not None else got.endswith("five words end it here")
