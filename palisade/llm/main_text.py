"""Main text of HTML pages by the maximum-scoring subsequence.

A page is a sequence of words and tags. Words score above zero and tags below, by
weights from labelled pages (those that mark their one article). The weight of a tag
that stands for a menu, notice, advert, form, comment or the like also counts against
each word that the element holds, so that these words cost more than they bring: how
much, labelled pages say by element, class, id and role, and known names serve as the
prior. A linear scan over each such element finds what stays of it, which is nothing if
none of its words brings anything; the same scan over the page, in which what went counts
nothing, finds the contiguous region with the largest sum, widened to whole blocks. An
element that turns out to hold the page's article costs nothing.

Defined results: a null or empty page has empty text, and so has one without words
outside such parts; a page cut short ends where it ends; repeated rows are extracted
each on its own; other columns pass through; an empty table gives an empty result.
"""

from __future__ import annotations

import html
import math
import re
from dataclasses import dataclass
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palisade.llm.common import bounded_sample, text_of, without

#: Labelled pages that the weights are fitted on, at most.
LABELLED_PAGES = 2000
WORD_RANGE, TAG_RANGE = (0.3, 1.0), (-6.0, -0.1)
UNSEEN_TAG, UNSEEN_WORD, UNSEEN_LINK_WORD = -0.35, 0.5, 0.25
#: What the tag of an aside counts for against each word in it, at most and as a prior worth
#: so many words; what labelled pages give SURE_WEIGHT or below is an aside even where it holds most words.
ASIDE_WEIGHT, PRIOR_WORDS, SURE_WEIGHT = -2.0, 20, -1.75

BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody "
    "td tfoot th thead title tr ul".split()
)
#: Elements whose content is no text of the page; xmp's is text, but no markup.
RAW = frozenset("script style textarea title iframe noframes noembed template svg annotation annotation-xml".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that are no part of an article, and words in class, id or role that say so.
ASIDE = frozenset("head nav aside footer form button select menu dialog noscript object video audio canvas map fieldset".split())
CLEAR = frozenset("html body article main".split())
#: An aside by name only as long as it doesn't hold most of the words of its article (of the page, outside of one).
FORMS = frozenset("form fieldset".split())
#: Where tags are part of what is shown, and cost nothing.
SET = frozenset("table pre math code".split())
#: What may stand in a head; anything else ends one that has no end tag.
IN_HEAD = frozenset("html head title meta link base basefont bgsound script style noscript template".split())
_ASIDE_WORD = (
    r"(?:nav|navbar|navigation|menu|menubar|breadcrumbs?|header|masthead|footer|sidebar|widgets?|ads?|adverts?|advertisements?|advertising|"
    r"sponsor|sponsored|promo|promotion|banner|notice|notices|cookie|cookies|consent|gdpr|alert|newsletter|subscribe|signup|popup|modal|"
    r"overlay|comments?|commentlist|disqus|respond|reply|replies|share|sharing|social|related|recommended|recommendations|login|search|"
    r"form|toolbar|pagination|pager|tags|copyright|contentinfo|complementary|skip)"
)
#: Words that may stand beside one in a name that is an aside as a whole (site-notice, related-posts,
#: nav-links), unlike in content-with-sidebar, no-sidebar, has-banner or search-result.
_BESIDE = (
    r"(?:site|page|main|global|top|bottom|left|right|primary|secondary|sub|mobile|sticky|fixed|user|blog|post|posts|article|articles|"
    r"list|area|bar|box|links?|buttons?|icons?|items?|block|section|container|wrapper|wrap|inner|outer|slot|unit|panel|media|policy|[0-9]+)"
)
NAMED_ASIDE = re.compile(rf"^(?:{_BESIDE}[^a-z0-9]+)*{_ASIDE_WORD}(?:[^a-z0-9]+(?:{_ASIDE_WORD}|{_BESIDE}))*$")
#: Asides that may well have more words than a short article, or articles of their own (comments);
#: they turn out to be none only if they hold the page's main element. The others do so, too, if they
#: hold all its article and main elements, or most of its unlinked words outside firm asides.
FIRM = frozenset("nav aside footer button select menu object video audio canvas map".split())
FIRM_NAME = re.compile(r"(?:^|[^a-z0-9])(?:comments?|commentlist|disqus|respond|reply|replies|notices?|cookies?|consent|gdpr|popup|modal|nav|navigation|menu|footer|related|recommended)(?:$|[^a-z0-9])")
_ATTRIBUTE = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^'">])*)>?|[^<]+|<""",
    re.S,
)


@dataclass
class Element:
    """An element whose tag may count against its words: a span of tokens."""

    begin: int
    end: int
    marks: list[str]
    aside: bool
    firm: bool
    words: int
    articles: int
    mains: int
    titles: int
    links: int
    nested: bool


@dataclass
class Page:
    """Unlinked words outside firm asides, articles or mains, mains and first-level headings of a page; the
    spans of its articles and mains, with their words; and where tags are part of what is shown."""

    words: int
    articles: int
    mains: int
    titles: int
    marked: list[tuple[int, int, int, str]]
    set: list[tuple[int, int]]


def _marks(name: str, attributes: str, in_article: bool) -> tuple[list[str], bool, bool]:
    """What may tell an aside: its element, its names; whether one is known as such, and firmly."""
    marks, aside, firm = [], False, False
    if name in ASIDE or name == "header" and not in_article:
        marks, aside, firm = [name], True, name in FIRM
    if attributes and name not in CLEAR:
        for value in (a or b or c for a, b, c in _ATTRIBUTE.findall(attributes)):
            for word in value.lower().split():
                marks.append(f".{word}")
                if NAMED_ASIDE.match(word):
                    aside, firm = True, firm or bool(FIRM_NAME.search(word))
    return marks, aside, firm


def parse(page: str) -> tuple[list[tuple[str, str, str]], list[Element], Page]:
    """Tokens (feature, text, tag name or "") in page order, the elements with marks, and what the page has."""
    out, elements, open_tags, at = [], [], [], 0
    n_open: dict[str, int] = {}
    firm_open = articles = mains = words = titles = links = 0
    marked: list[tuple[int, int, int, str]] = []
    set_: list[tuple[int, int]] = []

    def close(place: int, end: int) -> None:
        """Ends the open elements from this one on, before token end."""
        nonlocal firm_open
        for name, _, begin, marks, aside, firm, nested, *before in open_tags[place:]:
            n_open[name] -= 1
            firm_open -= firm
            held = [n - b for n, b in zip((words, articles, mains, titles, links), before)]
            if marks:
                elements.append(Element(begin, end, marks, aside, firm, *held, nested))
            if name in ("article", "main"):
                marked.append((begin, end, held[0], name))
            elif name in SET:
                set_.append((begin, end))
        del open_tags[place:]

    def find(name: str) -> int:
        return next(i for i in reversed(range(len(open_tags))) if open_tags[i][0] == name)

    while at < len(page):
        match = _TOKEN.match(page, at)
        at = match.end()
        inner = open_tags[-1][1] if open_tags else ""
        if (name := match[2]) is None:
            if not match[0].startswith("<") or match[0] == "<":
                text = html.unescape(match[0])
                if open_tags and open_tags[-1][0] == "head" and text.strip():
                    close(len(open_tags) - 1, len(out))
                    inner = open_tags[-1][1] if open_tags else ""
                out.append((f"word in {inner}", text, ""))
                words += 0 if n_open.get("a") or firm_open else len(text.split())
            continue
        name = name.lower()
        if match[1]:
            out.append((f"/{name}", "", name))
            # What an end tag ends is found in as many steps as elements end with it.
            if n_open.get(name):
                close(find(name), len(out))
            continue
        if name == "body" and n_open.get("head"):
            close(find("head"), len(out))
        elif open_tags and (open_tags[-1][0] == "head" and name not in IN_HEAD or name == "p" == open_tags[-1][0]):
            close(len(open_tags) - 1, len(out))
        inner = open_tags[-1][1] if open_tags else ""
        marks, aside, firm = _marks(name, match[3], bool(n_open.get("article") or n_open.get("main")))
        out.append((name, "", name))
        if name in RAW or name == "xmp" or name in VOID or match[3].endswith("/"):
            if name in RAW or name == "xmp":
                end = re.compile(rf"</{re.escape(name)}\b[^>]*>?", re.I).search(page, at)
                if name == "xmp":
                    text = page[at : end.start() if end else len(page)]
                    out += [(f"word in {inner}", text, ""), ("/xmp", "", "xmp")]
                    words += 0 if firm_open else len(text.split())
                at = end.end() if end else len(page)
            continue
        nested = inner not in ("", "html", "body")
        open_tags.append((name, name if name in BLOCKS or name == "a" else inner, len(out) - 1, marks, aside, firm, nested, words, articles, mains, titles, links))
        n_open[name] = n_open.get(name, 0) + 1
        firm_open += firm
        mains += name == "main"
        articles += name in ("article", "main")
        titles += name == "h1"
        links += name == "a"
    close(0, len(out))
    elements.sort(key=lambda e: (e.begin, -e.end))
    return out, elements, Page(words, articles, mains, titles, sorted(marked), set_)


def element_weight(element: Element, page: Page, weights: dict[str, float]) -> float:
    """What the element's tag counts for against each of its words."""
    weight = min(weights.get(f"in {mark}", ASIDE_WEIGHT if mark[0] != "." or NAMED_ASIDE.match(mark[1:]) else 0.0) for mark in element.marks)
    if not weight or page.mains and element.mains == page.mains:
        return 0.0
    if element.marks[0] in FORMS:
        # The words of the innermost article around it, where there is one.
        around = [held for begin, end, held, _ in page.marked if begin < element.begin and element.end <= end]
        if 2 * element.words > (around[-1] if around else page.words):
            return 0.0
    if element.marks == ["header"] and element.nested and element.titles and element.titles == page.titles and not element.links:
        return 0.0  # the article's own, not the site's
    firm = element.firm or min(weights.get(f"in {mark}", 0.0) for mark in element.marks) <= SURE_WEIGHT
    article = page.articles and element.articles == page.articles
    most = not page.articles and 2 * element.words > page.words
    return 0.0 if (article and not element.firm) or (most and not firm) else weight


def score_page(page: str, weights: dict[str, float]) -> tuple[list[tuple[str, str, str]], list[float], list[tuple[int, int]]]:
    """Tokens, their scores, and the spans of the outermost elements that count against their words.

    In an article (in a page's only main, if it has no article) nothing but asides and what weighs against words is left out:
    tags cost nothing there, and no word counts for less than an unseen link's."""
    found, elements, held = parse(page)
    change, free, against = [0.0] * (len(found) + 1), [0] * (len(found) + 1), []
    for element in elements:
        if weight := element_weight(element, held, weights):
            change[element.begin] += weight
            change[element.end] -= weight
            if not against or element.begin >= against[-1][1]:
                against.append((element.begin, element.end))
    wanted = "article" if any(name == "article" for *_, name in held.marked) else "main"
    for begin, end in (*((b, e) for b, e, _, name in held.marked if name == wanted), *held.set):
        free[begin] += 1
        free[end] -= 1
    marked = [0] * (len(found) + 1)
    for begin, end, _, name in held.marked:
        marked[begin] += name == wanted
        marked[end] -= name == wanted
    scores = []
    for (feature, text, name), each, set_, inside in zip(found, accumulate(change), accumulate(free), accumulate(marked)):
        if name:
            cost = weights.get(feature, UNSEEN_TAG)
            scores.append(max(cost, 0.0) if set_ else cost)
        else:
            unseen = UNSEEN_LINK_WORD if feature == "word in a" else UNSEEN_WORD
            word = weights.get(feature, unseen)
            scores.append(((max(word, UNSEEN_LINK_WORD) if inside else word) + each) * len(text.split()))
    return found, scores, against


def best_region(scores: list[float]) -> tuple[int, int]:
    """[begin, end) of the contiguous run with the largest sum; empty if none is above zero."""
    best, region, total, begin = 0.0, (0, 0), 0.0, 0
    for i, x in enumerate(scores):
        if total <= 0:
            total, begin = 0.0, i
        total += x
        if total > best:
            best, region = total, (begin, i + 1)
    return region


def main_text(page: str | None, weights: dict[str, float]) -> str:
    found, scores, against = score_page(page or "", weights)
    left_out = [False] * len(found)
    for first, last in against:
        # What stays of such an element; the rest costs nothing, so that the region can reach across it.
        a, b = best_region(scores[first:last])
        for begin, end in ((first, first + a), (first + b, last)):
            left_out[begin:end], scores[begin:end] = [True] * (end - begin), [0.0] * (end - begin)
    begin, end = best_region(scores)
    if begin == end:
        return ""
    while begin > 0 and found[begin][2] not in BLOCKS:
        begin -= 1
    while end < len(found) and found[end][2] not in BLOCKS:
        end += 1
    blocks, block = [], []
    for (_, text, name), out in zip(found[begin:end], left_out[begin:end]):
        if name in BLOCKS:
            blocks.append("".join(block))
            block = []
        elif name == "br":
            block.append(" ")
        elif not out:
            block.append(text)
    blocks.append("".join(block))
    return "\n".join(b for b in (" ".join(b.split()) for b in blocks) if b)


COUNTS = "feature string, inside long, outside long"


def _counts(batches):
    """Words by mark of the elements that hold them, and outside known asides also words
    and tags by feature, inside and outside the article."""
    for batch in batches:
        inside, outside = {}, {}

        def count(side: dict[str, int], feature: str, n: int) -> None:
            side[feature] = side.get(feature, 0) + n

        for page in batch["html"]:
            found, elements, _ = parse(page)
            change, within, words_in, words_out = [0] * (len(found) + 1), False, [0], [0]
            for element in elements:
                change[element.begin] += element.aside
                change[element.end] -= element.aside
            for (feature, text, name), asides in zip(found, accumulate(change)):
                within = within or feature in ("article", "main")
                n = 0 if name else len(text.split())
                words_in.append(words_in[-1] + n * within)
                words_out.append(words_out[-1] + n * (not within))
                if not asides:
                    count(inside if within else outside, feature, 1 if name else n)
                within = within and feature not in ("/article", "/main")
            for element in elements:
                for mark in set(element.marks):
                    count(inside, f"in {mark}", words_in[element.end] - words_in[element.begin])
                    count(outside, f"in {mark}", words_out[element.end] - words_out[element.begin])
        rows = [(f, inside.get(f, 0), outside.get(f, 0)) for f in {*inside, *outside}]
        yield pd.DataFrame(rows, columns=["feature", "inside", "outside"])


def fit_weights(pages: DataFrame) -> dict[str, float]:
    """Log-odds of being inside an article against outside, of words and tags and of the
    words in an element by its marks, from at most LABELLED_PAGES pages."""
    lower = F.lower("html")
    marks = lambda pattern: F.regexp_count(lower, F.lit(pattern))
    labelled = (
        pages.select("html", F.xxhash64("html").alias("order"))
        .where((marks(r"<(article|main)[\s>]") == 1) & (marks(r"</(article|main)[\s>]") == 1))
    )
    labelled = bounded_sample(labelled, "order", LABELLED_PAGES).select("html")
    # As many features as the tags, classes, ids and roles of so many pages.
    rows = (
        labelled.mapInPandas(_counts, COUNTS)
        .groupBy("feature")
        .agg(F.sum("inside").alias("inside"), F.sum("outside").alias("outside"))
        .collect()
    )
    plain = [r for r in rows if not r["feature"].startswith("in ")]
    n_in, n_out = (sum(r[side] for r in plain) + len(plain) for side in ("inside", "outside"))
    weights = {}
    for r in plain:
        odds = math.log((r["inside"] + 1) / n_in) - math.log((r["outside"] + 1) / n_out)
        low, high = WORD_RANGE if r["feature"].startswith("word in") else TAG_RANGE
        weights[r["feature"]] = min(high, max(low, odds))
    for r in rows:
        if r["feature"].startswith("in "):
            mark = r["feature"][3:]
            aside = mark[0] != "." or NAMED_ASIDE.match(mark[1:])
            held_in, held_out = r["inside"] + (1 if aside else PRIOR_WORDS), r["outside"] + (PRIOR_WORDS if aside else 1)
            # Binary fractions, so that sums come out even where elements end.
            weights[r["feature"]] = round(64 * min(0.0, max(ASIDE_WEIGHT, math.log(held_in / held_out)))) / 64
    return weights


def extract(pages: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """pages with the main text of html as text."""
    rows = without(pages, "text")
    fitted = fit_weights(rows) if weights is None else weights

    @F.pandas_udf(T.StringType())
    def text(column: pd.Series) -> pd.Series:
        return pd.Series([main_text(page, fitted) for page in column], dtype=object)

    return rows.withColumn("text", text(text_of("html")))
