"""Main text of web pages by scoring their trees.

A page is read into a tree of its blocks. Every paragraph passes points for its
length and its commas to its ancestors, less with distance; a container's sum is
discounted by the share of its text that stands in links. The best container is
the article; its siblings come along where they score well beside it or read
like paragraphs. Menus, adverts, comments and the like are cut by element, role
and name before, and lists of links inside the article after.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

_START = re.compile(r"<(?:!--|[!?]|/?[A-Za-z])")
_NAME = re.compile(r"/?([^\s/>]+)")
_QUOTED_END = re.compile(r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+>""")
_ATTRIBUTE = re.compile(r"""([^\s=/>"']+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))|([^\s=/>"']+)""")

# Kinds of elements of HTML.
RAW = {"script", "style", "title", "textarea", "noscript", "iframe", "xmp", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var picture".split()
)
CUT = set("aside audio button canvas dialog footer head math menu nav object select svg template video form header".split())
CUT_ROLES = set("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: What a start tag closes, and the elements beyond which it does not.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
HOLDS = {"ul", "ol", "dl", "table", "select", "body"}
#: Never cut by their names.
UNNAMED = HEADINGS | {"html", "body", "main"}
IN_HEAD = {"meta", "link", "base", "template", *RAW}
#: Beyond these an open paragraph is not closed.
PARAGRAPH_SCOPE = {"table", "td", "th", "caption", "button", "object"}
#: Words that begin a class or id of what is no part of an article, after words of place.
_PLACES = r"(?:(?:site|page|main|global|top|left|right|bottom|primary|secondary|user|reader|post|article|blog|entry|content|inline|in)[_-])*"
_CUT_WORDS = (
    r"(?:ads?\d*|adv|adsense|ad(?:box|slot|unit|space|block)\w*|advert\w*|sponsor\w*|promo\w*|banner\w*|nav|navbar\w*|navigation|menu\w*|breadcrumbs?|sidebar\w*|widget\w*|footer\w*|"
    r"masthead|topbar|toolbar|comments?\w*|disqus\w*|respond|repl(?:y|ies)|cookies?\w*|consent\w*|gdpr\w*|notices?|alerts?|popup\w*|modal\w*|overlay|newsletter\w*|subscri\w*|"
    r"sign-?up|log-?in|share|sharing|social|related|recommend\w*|paginat\w*|pager|outbrain|taboola|copyright)"
)
_CUT_CLASS = re.compile(rf"(?:^|\s){_PLACES}{_CUT_WORDS}(?:[_-]\S*)?(?=$|\s)")
#: An id may be made of a heading's words, so nothing but such words counts.
_CUT_ID = re.compile(rf"{_PLACES}{_CUT_WORDS}(?:[_-]?(?:\d+|wrap\w*|list|section|container|area|box|form|block|panel|inner|outer|col\w*|bar|top|bottom|left|right))*$")
_HEADER_NAME = re.compile(r"(?:^|\s)(?:(?:site|page|main|global|top)[_-])?header(?:[_-]\S*)?(?=$|\s)")
_GOOD_NAME = re.compile(r"(?:^|[\s_-])(?:article\w*|body|content\w*|entry\w*|main|post\w*|text|blog|story)(?=$|[\s_-])")
_BAD_NAME = re.compile(r"(?:^|[\s_-])(?:contact|meta|media|scroll|shop\w*|tags?|tool\w*|hidden|legal|links?)(?=$|[\s_-])")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
#: Points of an element before its paragraphs.
BASE = {"article": 25, "main": 10, "div": 5, "pre": 3, "td": 3, "blockquote": 3, "ol": -3, "ul": -3, "dl": -3, "dd": -3, "dt": -3, "li": -3, "address": -3, "th": -5} | dict.fromkeys(HEADINGS, -5)
CONTAINERS = {"article", "main", "section", "div", "body", "html", "center", "td", "form"}
LINKED, SHORT = 0.5, 25


class Tree:
    """A page's blocks in page order; lists hold one value for each."""

    def __init__(self, page: str):
        self.tags, self.parents, self.names, self.cut = ["html"], [0], [""], [False]
        #: Pieces of text in page order: block, text, whether it stands in a link.
        self.pieces: list[tuple[int, str, bool]] = []
        self._stack: list[tuple[str, int]] = [("html", 0)]
        self._open: Counter = Counter(["html"])
        self._read(page)

    def _read(self, page: str) -> None:
        at, quoted = 0, True
        while True:
            m = _START.search(page, at)
            self._text(page[at : m.start() if m else len(page)])
            if not m:
                return
            start = m.start()
            if page.startswith("<!--", start):
                end = page.find("-->", start + 4)
                if end < 0:
                    return
                at = end + 3
                continue
            closed = _QUOTED_END.match(page, m.end()) if quoted else None
            end = closed.end() if closed else page.find(">", m.end()) + 1
            # One unclosed quote is enough to look for no more: reading stays linear.
            quoted = quoted and closed is not None
            if not end:
                return
            at = end
            name = _NAME.match(page, start + 1)
            if page[start + 1] in "!?" or not name:
                continue
            tag = name[1].lower()
            if page[start + 1] == "/":
                self._end(tag)
                continue
            self._start(tag, page[name.end() : end - 1])
            if tag in RAW:
                stop = re.compile("</" + tag + r"(?=[\s/>])", re.I).search(page, end)
                if not stop:
                    return
                at = page.find(">", stop.end() - 1) + 1 or len(page)

    def _text(self, text: str) -> None:
        if text:
            self.pieces.append((self._stack[-1][1], html.unescape(text), self._open["a"] > 0))

    def _break(self) -> None:
        self.pieces.append((self._stack[-1][1], " ", False))

    def _start(self, tag: str, attributes: str) -> None:
        if self._open["head"] and tag not in IN_HEAD:
            self._close({"head"}, ())
        if tag in RAW or tag in VOID:
            if tag in ("br", "hr"):
                self._break()
            return
        inline = tag in INLINE
        if not inline:
            self._break()
            if self._open["p"]:
                self._close({"p"}, PARAGRAPH_SCOPE)
            if tag in CLOSES:
                self._close(CLOSES[tag], HOLDS)
        elif tag == "a" and self._open["a"]:
            self._end("a")
        found = {(m[1] or m[5]).lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(attributes)} if attributes else {}
        classes, own_id = (_CAMEL.sub("-", found.get(k, "")).lower().strip() for k in ("class", "id"))
        cut = tag in CUT or "hidden" in found or found.get("aria-hidden", "").lower() == "true" or "display:none" in found.get("style", "").replace(" ", "").lower()
        cut = cut or found.get("role", "").lower() in CUT_ROLES
        header = tag == "header"
        if tag not in UNNAMED and (classes or own_id):
            cut = cut or bool(_CUT_CLASS.search(classes) or _CUT_ID.match(own_id))
            header = header or bool(_HEADER_NAME.search(classes) or _HEADER_NAME.match(own_id))
        node = self._stack[-1][1]
        # An inline element is part of its block, unless it is cut by itself.
        if not inline or cut:
            self.tags.append("header" if header and not inline else tag)
            self.parents.append(node)
            self.names.append(f"{classes} {own_id}")
            self.cut.append(cut or header)
            node = len(self.tags) - 1
        self._stack.append((tag, node))
        self._open[tag] += 1

    def _end(self, tag: str) -> None:
        if not self._open[tag] or tag == "html":
            return
        if tag not in INLINE:
            self._close({tag}, ())
            return
        for i in range(len(self._stack) - 1, 0, -1):
            if self._stack[i][0] == tag:
                del self._stack[i]
                self._open[tag] -= 1
                return
            if self._stack[i][0] not in INLINE and tag != "a":
                return

    def _close(self, tags: set[str], beyond) -> None:
        for i in range(len(self._stack) - 1, 0, -1):
            if self._stack[i][0] in tags:
                self._break()
                for gone, _ in self._stack[i:]:
                    self._open[gone] -= 1
                del self._stack[i:]
                self._break()
                return
            if self._stack[i][0] in beyond:
                return

    def settle(self) -> None:
        """Decide what is cut, and sum what is left by block.

        An element that holds an article is not cut by its name; a form that
        holds most of the page's text is a page in a form; of an article's header
        the headings stay.
        """
        n = len(self.tags)
        chars, links = [0] * n, [0] * n
        self.last, self.linked = [""] * n, [0] * n
        for node, text, linked in self.pieces:
            size = len("".join(text.split()))
            if size:
                chars[node] += size
                links[node] += size * linked
                self.last[node] = text
                self.linked[node] += linked
        holds, within = [t in ("article", "main", "body") and not c for t, c in zip(self.tags, self.cut)], [False] * n
        total = list(chars)
        for i in range(n - 1, 0, -1):
            total[self.parents[i]] += total[i]
            holds[self.parents[i]] |= holds[i]
        gone, header = [False] * n, [False] * n
        for i in range(1, n):
            up, tag = self.parents[i], self.tags[i]
            within[i] = within[up] or tag in ("article", "main")
            own = self.cut[i]
            if own and holds[i] and tag not in ("aside", "footer", "nav", "head"):
                own = False
            elif own and tag == "form" and 2 * total[i] > total[0]:
                own = False
            header[i] = header[up] or own and tag == "header" and within[i]
            gone[i] = gone[up] or own and not (tag == "header" and within[i])
        self.header = header
        self.gone = [g or h and t not in HEADINGS for g, h, t in zip(gone, header, self.tags)]
        self.chars = [0 if g else c for g, c in zip(self.gone, chars)]
        self.links = [0 if g else c for g, c in zip(self.gone, links)]
        self.all_chars, self.all_links = list(self.chars), list(self.links)
        self.leaf = [True] * n
        for i in range(n - 1, 0, -1):
            up = self.parents[i]
            self.all_chars[up] += self.all_chars[i]
            self.all_links[up] += self.all_links[i]
            self.linked[up] += 0 if self.gone[i] else self.linked[i]
            if self.tags[i] not in INLINE:
                self.leaf[up] = False

    def density(self, i: int) -> float:
        return self.all_links[i] / self.all_chars[i] if self.all_chars[i] else 0.0

    def scores(self) -> dict[int, float]:
        """Points by block; paragraphs pass them on, to ancestors at a distance less."""
        n = len(self.tags)
        commas = [0] * n
        for node, text, _ in self.pieces:
            commas[node] += sum(map(text.count, ",،、，"))
        out: dict[int, float] = {}
        for i in range(n):
            size = self.chars[i]
            if not size:
                continue
            points = 0.0 if self.tags[i] in HEADINGS else size / 100 if size < SHORT else 1 + commas[i] + min(size / 100, 3)
            up = self.parents[i] if self.leaf[i] or self.tags[i] not in CONTAINERS else i
            for level in range(4):
                if up not in out:
                    out[up] = BASE.get(self.tags[up], 0) + 25 * bool(_GOOD_NAME.search(self.names[up])) - 25 * bool(_BAD_NAME.search(self.names[up]))
                out[up] += points / (1, 2, 6, 9)[level]
                if up == 0:
                    break
                up = self.parents[up]
        return {i: s * (1 - self.density(i)) if s > 0 else s for i, s in out.items()}

    def main_text(self) -> str:
        self.settle()
        scores = self.scores()
        if not scores:
            return self._joined([True] * len(self.tags))
        best = max(scores, key=lambda i: (scores[i], -i))
        up = best
        while up and self.tags[up] not in ("article", "main"):
            up = self.parents[up]
        best = up or best
        n = len(self.tags)
        kept = [False] * n
        least = max(6.0, 0.2 * scores.get(best, 0.0))
        for i in range(best and 1, n):
            if i == best or best and self.parents[i] == self.parents[best] and self._beside(i, best, scores, least):
                kept[i] = True
            elif i and kept[self.parents[i]]:
                kept[i] = not self._menu(i)
        return self._joined(kept)

    def _beside(self, i: int, best: int, scores: dict[int, float], least: float) -> bool:
        """Whether a sibling of the best container belongs to the article."""
        if self.gone[i]:
            return False
        if self.tags[i] in HEADINGS:
            return i < best and not self.all_links[i]
        if scores.get(i, 0.0) >= least and self.density(i) < LINKED:
            return True
        return self.leaf[i] and (self.all_chars[i] > 80 and self.density(i) < 0.25 or not self.all_links[i] and self.last[i].rstrip().endswith((".", "!", "?", "。", "…")))

    def _menu(self, i: int) -> bool:
        """Whether a list or part inside the article consists of links, three of them at least."""
        return self.tags[i] in ("ul", "ol", "dl", "table", "div", "section") and self.density(i) > LINKED and self.linked[i] >= 3

    def _joined(self, kept: list[bool]) -> str:
        return " ".join("".join(text for node, text, _ in self.pieces if kept[node] and not self.gone[node]).split())


def main_text(page: str | None) -> str:
    """The article of a page: text alone, white space single, blocks in page order; empty if there is none."""
    return Tree(page).main_text() if page else ""


def extract(pages: DataFrame, *, html_col: str = "html") -> DataFrame:
    """The other columns of ``pages`` with ``text``, the main text, and ``n_chars``, its code points.

    Both replace columns of these names, if there are any. A null or empty page,
    and one without text outside of what is cut, has an empty text. Pages are read
    whole, one at a time, whatever their length or depth. Every row comes back,
    repeated ones and null ids as they are; an empty table gives none.
    """
    others = [c for c in pages.columns if c not in ("text", "n_chars", html_col)]
    own = pages.select(*others, F.col(html_col).cast("string").alias("_page"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_page"):
            texts = [main_text(page) for page in batch["_page"].to_pylist()]
            kept = [batch.column(i) for i in range(len(others))]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*others, "text", "n_chars"])

    return own.mapInArrow(each, pages.select(*others).schema.add("text", "string").add("n_chars", "long"))


def op12_scored_article_text(spark, sf_dir: str) -> DataFrame:
    """The main text of all pages; edge cases as in ``extract``."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return extract(pages).select("page_id", "url", "text", "n_chars")
