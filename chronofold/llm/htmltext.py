"""Main text of web pages by tag-path ratios.

Every piece of text hangs at the end of a path of elements. Per path, the length
of its text and its punctuation are summed over the page and set against its
number of pieces: articles repeat few paths with long, punctuated pieces, page
furniture has short ones. The ratios are smoothed along the page and fused into one
score, in which marks of furniture (names of elements, roles and classes) weigh
something but decide nothing alone. Paths below a share of the best score fall.

The text of the kept paths points out the element that holds the main text: from
the root, the walk goes down while one element has most of it. Everything in that
element belongs to the article, headings, lists, tables and short lines too,
except parts that are marked as furniture there and whose paths have fallen. So
a mark around the whole article takes nothing away, as all scores fall alike.

What is never shown (scripts, styles, hidden elements) is left out beforehand.
Work is linear in the page, whatever the depth of its elements.
"""

from __future__ import annotations

import html as htmllib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronofold.llm.common import ship_package, table

# Fixed values of HTML and of common page markup.
RAW = {"script", "style", "noscript", "template", "iframe", "svg", "math", "textarea", "select", "object", "canvas", "audio", "video", "head", "title", "xmp", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = {"address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"}
FURNITURE = {"nav", "footer", "aside", "header", "form", "menu", "dialog", "button", "label", "fieldset", "legend"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "alertdialog", "menu", "menubar", "form", "toolbar"}
HINTS = {
    "ad", "ads", "adbox", "adslot", "advert", "adverts", "advertisement", "advertising", "adsense", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "consent", "cookie", "cookies",
    "copyright", "disqus", "footer", "gdpr", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notification", "pager", "pagination", "popup", "promo", "promoted",
    "promotion", "recommended", "related", "replies", "respond", "share", "sharing", "sidebar", "signup", "skip", "social", "sponsor", "sponsored", "subscribe", "subscription", "toolbar", "topbar", "widget", "widgets",
}
INLINE_MARKS = {"button", "label"}
NEGATIONS = {"with", "without", "has", "no", "not", "non"}
HEADINGS = {"h1", "h2", "h3"}
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>[^>"']*+(?:"[^"]*+"[^>"']*+|'[^']*+'[^>"']*+)*+)>|<(?P<end2>/?)(?P<tag2>[a-zA-Z][^\s/>]*+)(?P<attrs2>[^>]*)>""", re.S)
UNCLOSED = re.compile("<!--|<(?=[a-zA-Z/!?])")
ATTR = re.compile(r"""([a-zA-Z-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
BARE = re.compile(r"(?:^|\s)hidden(?=[\s/]|$)")
SIGNS = re.compile(r"[.,;:!?…。，、！？；：¿¡]")
SPACE = re.compile(r"\s+")
WORDS = re.compile(r"[^A-Za-z0-9]+|(?<=[a-z])(?=[A-Z])")


def _marks(tag: str, given: dict[str, str]) -> float:
    """How much an element's own markup speaks for page furniture: 1, or a half where a name only has such a word in it.

    The last word of a name says what a thing is: ``user-comments`` are comments,
    ``share-prices`` are not a share button.
    """
    if tag in FURNITURE or given.get("role", "").lower() in ROLES:
        return 1.0
    if tag in ("html", "body", "article", "main"):
        return 0.0
    most = 0.0
    for name in f"{given.get('class', '')} {given.get('id', '')}".split():
        words = [w.lower() for w in WORDS.split(name) if w]
        hints = sum(w in HINTS for w in words)
        if hints:
            whole = hints > 1 or words[-1] in HINTS and words[0] not in NEGATIONS
            most = max(most, 1.0 if whole else 0.5)
    return most


def _hidden(attrs: str, given: dict[str, str]) -> bool:
    return bool(given.get("aria-hidden", "").lower() == "true" or BARE.search(attrs) or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", given.get("style", ""), re.I))


class Page:
    """The elements of a page that shape it, as lists by number (0 is the root), and its pieces of text.

    An element has its parent, tag, path (a number for the names from the root to
    it), the number of furniture marks at or above it, and whether it is in an
    ``article`` or ``main``. A piece is (element, block number, decoded text, in a link).
    """

    def __init__(self, page: str):
        self.parent, self.tag, self.path, self.marks, self.main, self.off = [0], [""], [0], [0.0], [False], [False]
        self.pieces: list[tuple[int, int, str, bool]] = []
        self._names: dict[tuple[int, str], int] = {}
        self._parse(page)

    def _open(self, stack: list[int], tag: str, attrs: str) -> None:
        top = stack[-1]
        given = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTR.finditer(attrs)} if attrs else {}
        mark = _marks(tag, given)
        name = f"{tag}.{given.get('class', '')}{'!' * int(2 * mark)}"
        stack.append(len(self.tag))
        self.parent.append(top)
        self.tag.append(tag)
        self.path.append(self._names.setdefault((self.path[top], name), len(self._names) + 1))
        self.marks.append(self.marks[top] + mark)
        self.main.append(self.main[top] or tag in ("article", "main"))
        self.off.append(self.off[top] or bool(attrs) and _hidden(attrs, given))

    def _parse(self, page: str) -> None:
        stack, shown = [0], {}  # shown: how many elements of a tag are open
        block = at = 0
        link = False
        n = len(page)

        def cut(to: int) -> None:
            for k in stack[to:]:
                shown[self.tag[k]] -= 1
            del stack[to:]

        last = page.rfind(">")
        while at < n:
            m = TOKEN.search(page, at) if at <= last else UNCLOSED.search(page, at)  # without a sign that ends them there are no tags
            end = m.start() if m else n
            if end > at and not self.off[stack[-1]]:
                text = htmllib.unescape(page[at:end])
                if text:
                    self.pieces.append((stack[-1], block, text, link))
            if not m:
                break
            at = m.end()
            if m.re is UNCLOSED:
                break
            tag = (m["tag"] or m["tag2"] or "").lower()
            if not tag:
                continue
            closing, attrs = bool(m["end"] or m["end2"]), m["attrs"] or m["attrs2"] or ""
            if tag in RAW and not closing:
                if not attrs.endswith("/"):
                    gone = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(page, at)
                    if gone:
                        at = gone.end()
                    elif tag == "head":  # its end tag may be left out
                        body = re.compile(r"<body(?=[\s/>])", re.I).search(page, at)
                        at = body.start() if body else at
                    else:
                        at = n
                continue
            if tag == "br":
                self.pieces.append((stack[-1], block, " ", link))
            if tag == "a":
                link = not closing
            if tag in BLOCK:
                block += 1
                link = link and tag not in ("p", "div", "article", "section", "main")
            elif tag not in INLINE_MARKS and not (attrs and not closing and tag not in VOID and _hidden(attrs, {k.lower(): a or b or c or "" for k, a, b, c in ATTR.findall(attrs)})):
                if not closing or not shown.get(tag):
                    continue  # inline elements that are shown don't shape a path
            if tag in VOID:
                continue
            if closing:
                if shown.get(tag):
                    to = len(stack) - 1
                    while self.tag[stack[to]] != tag:
                        to -= 1
                    cut(to)
                continue
            if attrs.endswith("/") and tag not in BLOCK:
                continue
            shut = CLOSES.get(tag, set())
            if self.tag[stack[-1]] == "p" and tag in BLOCK:
                cut(len(stack) - 1)
            for to in range(len(stack) - 1, max(0, len(stack) - 4), -1):  # a list item or a cell ends the one before it
                if self.tag[stack[to]] in shut:
                    cut(to)
                    break
                if self.tag[stack[to]] not in ("p", "td", "th"):
                    break
            self._open(stack, tag, attrs)
            shown[tag] = shown.get(tag, 0) + 1


def path_scores(page: Page, spread: float = 1.0, mark_weight: float = 0.01, main_weight: float = 4.0, ratios: bool = True) -> dict[int, float]:
    """The fused score of each path that has text: its ratios, smoothed along the page, and its marks.

    Without ``ratios``, marks alone (for tests of what the ratios do).
    """
    nodes = [(page.path[e], e, t.strip(), link) for e, _, t, link in page.pieces if t.strip()]
    length: dict[int, int] = {}
    signs: dict[int, int] = {}
    count: dict[int, int] = {}
    linked: dict[int, int] = {}
    prior: dict[int, float] = {}
    for p, e, t, link in nodes:
        length[p] = length.get(p, 0) + len(t)
        signs[p] = signs.get(p, 0) + len(SIGNS.findall(t))
        count[p] = count.get(p, 0) + 1
        linked[p] = linked.get(p, 0) + (len(t) if link else 0)
        prior[p] = mark_weight ** min(page.marks[e], 3) * (main_weight if page.main[e] else 1.0)
    if not ratios:
        return prior
    ratio = {p: (length[p] - linked[p]) / count[p] * (1 + signs[p] / count[p]) for p in count}
    reach = max(1, round(2 * spread))
    weight = [math.exp(-(d * d) / (2 * spread * spread)) for d in range(reach + 1)]
    smooth: dict[int, float] = {}
    for i, (p, *_) in enumerate(nodes):
        near = [(weight[abs(d)], ratio[nodes[i + d][0]]) for d in range(-reach, reach + 1) if 0 <= i + d < len(nodes)]
        smooth[p] = smooth.get(p, 0) + sum(w * r for w, r in near) / sum(w for w, _ in near)
    return {p: math.sqrt(ratio[p] * smooth[p] / count[p]) * math.log1p(length[p] - linked[p]) * prior[p] for p in count}


def container(page: Page, kept: set[int], most: float = 0.8) -> int:
    """The element that holds the text of the kept paths: from the root down while one child has most of the whole."""
    mass, kids = [0] * len(page.tag), [[] for _ in page.tag]
    for e, _, t, link in page.pieces:
        if page.path[e] in kept and not link:
            mass[e] += len(t.strip())
    for e in range(len(page.tag) - 1, 0, -1):
        mass[page.parent[e]] += mass[e]
        kids[page.parent[e]].append(e)
    at = 0
    while kids[at]:
        best = max(kids[at], key=mass.__getitem__)
        if mass[best] < most * mass[0] or not mass[best]:
            break
        if not kids[best] and page.tag[at] not in ("", "html", "body"):
            break  # a paragraph stays with what stands beside it
        at = best
    return at


def main_text(page: str | None, share: float = 0.15, ratios: bool = True) -> str:
    """The article of a page: its blocks, one a line; empty where there is none."""
    found = Page(page or "")
    score = path_scores(found, ratios=ratios)
    best = max(score.values(), default=0.0)
    if best <= 0:
        return ""
    kept = {p for p, s in score.items() if s >= share * best}
    top = container(found, kept)
    inside = [False] * len(found.tag)
    linked: dict[int, list[int]] = {}  # by path: characters in links and in all
    for e in range(len(found.tag)):
        inside[e] = e == top or e > 0 and inside[found.parent[e]]
    for e, _, t, link in found.pieces:
        got = linked.setdefault(found.path[e], [0, 0])
        got[0] += len(t) if link else 0
        got[1] += len(t)
    core = [i for i, (e, _, t, _) in enumerate(found.pieces) if inside[e] and found.path[e] in kept and t.strip()]
    loose = found.tag[top] in ("", "html", "body")  # no element of its own: what lies around the kept paths is not the article
    blocks: dict[int, list[str]] = {}
    title = None
    for i, (e, block, text, _) in enumerate(found.pieces):
        p = found.path[e]
        if not inside[e]:
            if i < core[0] and found.tag[e] in HEADINGS and found.marks[e] <= found.marks[top] and text.strip():
                title = i if title is None or found.pieces[title][1] != block else title
            continue
        if p not in kept and found.marks[e] > found.marks[top]:
            continue
        if loose and p not in kept and (not core[0] < i < core[-1] or 2 * linked[p][0] > linked[p][1]):
            if not (i < core[0] and found.tag[e] in HEADINGS):
                continue
        blocks.setdefault(block, []).append(text)
    lines = [SPACE.sub(" ", "".join(b)).strip() for b in blocks.values()]
    if title is not None and not any(inside[e] and found.tag[e] == "h1" for e, _, t, _ in found.pieces):
        e, block = found.pieces[title][:2]
        above, up = set(), top  # a heading just before the article, beside it or beside what it is in
        while up:
            up = found.parent[up]
            above.add(up)
        between = any(t.strip() and b != block and found.marks[x] <= found.marks[top] for x, b, t, _ in found.pieces[title : core[0]] if not inside[x])
        if found.parent[e] in above and not between:
            lines.insert(0, SPACE.sub(" ", "".join(t for _, b, t, _ in found.pieces if b == block)).strip())
    return "\n".join(x for x in lines if x)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text): the main text of each row of ``pages``.

    Defined results: null or empty html gives an empty text; null ids or urls are
    passed on; each row gives one row, repeated or not; an empty table gives an
    empty result; other columns are not read.
    """
    ship_package(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 256):
                part = b.slice(k, 256)
                text = [main_text(h) for h in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(text, pa.string())], names=["page_id", "url", "text"])

    own = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return own.mapInArrow(run, "page_id long, url string, text string")


def op5_tag_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.char_length("text").cast("long"))
