"""Operator 8, HTML extraction: a tree-structured graphical model over the DOM.

A page's block elements are the nodes of a tree. Each node is content or not. Its evidence (kind of tag, words in class
and id, link share, length of its own text) has a likelihood under either state, and parent-child potentials say how a
state passes down. Sum-product messages go up from the leaves and down from the root; their products are the marginals,
and a block is kept where content is likelier.

Potentials are counted on labelled pages: at most TRAIN different pages, chosen by a hash of the whole page, whose authors
mark the article or main element (everything in it is content but navigation, adverts, forms, comments); with pseudo
counts PRIOR, so pages of any kind have potentials. In training the marking tag is an evidence kind like any other, so
a page without it is judged by the rest. Scripts, styles and the like are no nodes.

Whole pages are parsed, in time linear in their length (but for lists and paragraphs nested in one another without end); no block is dropped or cut for its size. Null or empty html gives empty text; ids and urls may be
null or repeated; an empty table gives an empty result (and potentials of PRIOR alone).
"""

from __future__ import annotations

import collections
import html as entities
import re
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm.common import field, per_row

TRAIN = 512
#: Elements by what they do.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark meter output progress q ruby rp rt s samp small span strike strong sub sup time tt u var wbr br picture source track math mrow mi mo mn ms mtext msup msub msubsup mfrac msqrt mroot mover munder munderover mstyle mspace mpadded mphantom semantics annotation".split())
HIDDEN = frozenset("script style template noscript iframe object embed svg canvas head title select option textarea button".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
KINDS = {k: i for i, names in enumerate(("article main", "nav menu", "header", "footer", "aside", "form fieldset dialog", "p blockquote pre figcaption", "h1 h2 h3 h4 h5 h6", "ul ol dl", "li dt dd", "table thead tbody tfoot tr td th caption", "html body"), 1) for k in names.split()}
CLOSES_P = frozenset("address article aside blockquote center details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}
SCOPE = frozenset("ul ol dl table body html article section div td".split())
#: What may stand in a head without ending it; parts of a table, which end a select.
HEAD = frozenset("base basefont bgsound link meta title noscript noframes script style template head".split())
TABLE = frozenset("caption table tbody td tfoot th thead tr".split())
#: Words in class or id that speak against, or for, content.
AGAINST = re.compile(r"(?:^|[\s_-])(?:ads?|adverts?|advertisement|banner|sponsor(?:ed)?|promo|nav|navigation|navbar|menu|breadcrumbs?|header|footer|sidebar|aside|widget|related|recommended|share|sharing|social|cookies?|consent|notice|popup|modal|newsletter|subscribe|subscription|login|signup|search|form|comments?|replies|reply|discussion|respond|disqus|pagination|pager|copyright|toolbar|skip)(?:$|[\s_-])", re.I)
FOR = re.compile(r"(?:^|[\s_-])(?:article|post|story|entry|main|content|body|text)(?:$|[\s_-])", re.I)
N_KINDS, N_WORDS, N_LINKS, N_SIZES = len(set(KINDS.values())) + 1, 3, 4, 5
FEATURES = (N_KINDS, N_WORDS, N_LINKS, N_SIZES)

_NAME = re.compile(r"[a-zA-Z][^\s/<>]*+")
_STOP = re.compile(r">|=\s*+([\"'])")
_ATTR = re.compile(r"""(?<![^\s"'])(class|id|role)\s*+(?:=\s*+("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)


class Markup:
    """Tags of a page in order, in time linear in its length: no search is begun again where it once came to nothing."""

    def __init__(self, source: str):
        self.source, self.at = source, 0
        self.none: set[str] = set()
        self.quotes = True  # until a tag has no end: then a > in quotes counts too

    def find(self, what: str, at: int) -> int:
        """As str.find; what isn't found once isn't looked for again, as places only rise."""
        k = -1 if what in self.none else self.source.find(what, at)
        if k < 0:
            self.none.add(what)
        return k

    def end(self, at: int) -> int:
        """Place of the > that ends a tag, or -1. Quotes hide a > only after an equals sign."""
        start = at
        while self.quotes:
            m = _STOP.search(self.source, at)
            if not m:
                self.quotes = False
            elif not m[1]:
                return m.start()
            else:
                at = m.end()
                if (k := self.find(m[1], at)) >= 0:
                    at = k + 1
        return self.find(">", start)

    def next(self) -> tuple[int, str, bool, str] | None:
        """Where text ends, name ("" for comments and the like), whether it is an end tag, attributes; moves past it."""
        source, at = self.source, self.at
        while (at := source.find("<", at)) >= 0:
            if source.startswith("<!--", at):
                k = self.find("-->", at + 4)
                self.at = k + 3 if k >= 0 else len(source)
                return at, "", False, ""
            if source[at + 1 : at + 2] in ("!", "?") and at + 1 < len(source):
                k = self.find(">", at)
                self.at = k + 1 if k >= 0 else len(source)
                return at, "", False, ""
            closes = source.startswith("/", at + 1)
            m = _NAME.match(source, at + 1 + closes)
            if m and (k := self.end(m.end())) >= 0:
                self.at = k + 1
                return at, m.group().lower(), closes, source[m.end() : k]
            at += 1
        return None

    def skip(self, name: str) -> None:
        """Moves past the end tag of an element whose content is no markup, or to the end of the page."""
        m = re.compile(rf"</{re.escape(name)}(?![^\s/>])", re.I).search(self.source, self.at)
        k = self.find(">", m.end()) if m else -1
        self.at = k + 1 if k >= 0 else len(self.source)


class Page:
    """Block elements in page order: parents, evidence, and the text blocks with their elements."""

    def __init__(self, source: str):
        self.tags: list[str] = ["#"]
        self.parents: list[int] = [-1]
        self.words: list[int] = [0]
        self.own: list[int] = [0]
        self.linked: list[int] = [0]
        self.blocks: list[tuple[int, str]] = []
        stack, links = [0], 0
        # Numbers of open block and hidden elements by name, so that what isn't open isn't looked for.
        open_, hid = collections.Counter[str](), collections.Counter[str]()
        # Open hidden elements, and how many block elements were open at their start tags.
        hidden: list[tuple[str, int]] = []
        parts: list[str] = []
        link_chars = 0
        markup = Markup(source)

        def flush() -> None:
            nonlocal link_chars
            if parts:
                text = " ".join("".join(parts).split())
                parts.clear()
                if text:
                    k = stack[-1]
                    self.blocks.append((k, text))
                    self.own[k] += len(text)
                    self.linked[k] += min(link_chars, len(text))
            link_chars = 0

        def cut(k: int) -> None:
            open_.subtract(self.tags[e] for e in stack[k:])
            del stack[k:]

        def end_hidden(name: str) -> None:
            """Ends the innermost open hidden element of that name, and what is open inside it."""
            while hid[name]:
                ended, k = hidden.pop()
                hid[ended] -= 1
                if ended == name:
                    cut(k)
                    break

        def end_block(k: int) -> None:
            """Ends the block element at place k of the stack, and what is open inside it."""
            cut(k)
            while hidden and hidden[-1][1] > k:
                hid[hidden.pop()[0]] -= 1

        def text(s: str) -> None:
            nonlocal link_chars
            if hidden and hidden[-1][0] == "head" and s.strip():
                hid[hidden.pop()[0]] -= 1
            if s and not hidden:
                s = entities.unescape(s) if "&" in s else s
                parts.append(s)
                if links:
                    link_chars += len(s.strip())

        at = 0
        while tag := markup.next():
            end, name, closes, attributes = tag
            text(source[at:end])
            at = markup.at
            if not name:
                continue
            if closes:
                if name == "a":
                    links = max(0, links - 1)
                elif name == "br" or name in INLINE:
                    pass
                elif name in HIDDEN:
                    end_hidden(name)
                else:
                    for k in range(len(stack) - 1, 0, -1) if open_[name] > 0 else ():
                        if self.tags[stack[k]] == name:
                            flush()
                            end_block(k)
                            links = 0
                            break
                continue
            if name == "br":
                text(" ")
                continue
            closed = attributes.endswith("/") and name not in INLINE
            # End tags that HTML lets pages leave out.
            if hidden:
                if hidden[-1][0] == "head" and name not in HEAD:
                    end_hidden("head")
                elif hidden[-1][0] == "option" and name in ("option", "optgroup", "hr"):
                    end_hidden("option")
                if name in ("button", "select"):
                    end_hidden(name)
                elif name in TABLE:
                    end_hidden("select")
            if name in RAW:
                markup.skip(name)
                at = markup.at
                continue
            if name in HIDDEN:
                if name not in VOID and not closed:
                    hidden.append((name, len(stack)))
                    hid[name] += 1
                continue
            if name in INLINE:
                links += name == "a"
                continue
            if name in ("body", "article", "main"):
                hidden.clear()  # an unclosed hidden element ends here
                hid.clear()
            flush()
            if name in VOID:
                continue
            # In a hidden element a start tag ends only what was opened there.
            least = hidden[-1][1] if hidden else 0
            if name in CLOSES_P and open_["p"] > 0:
                for k in range(len(stack) - 1, least - 1, -1):
                    if self.tags[stack[k]] == "p":
                        end_block(k)
                        break
            for other in (x for x in SAME.get(name, ()) if open_[x] > 0):
                for k in range(len(stack) - 1, max(least, 1) - 1, -1):
                    if self.tags[stack[k]] == other:
                        end_block(k)
                        break
                    if self.tags[stack[k]] in SCOPE and self.tags[stack[k]] != other:
                        break
            links = 0
            about = " ".join((v or "").strip("\"'") for _, v in _ATTR.findall(attributes)) if attributes else ""
            self.tags.append(name)
            self.parents.append(stack[-1])
            self.words.append(1 if about and AGAINST.search(about) else 2 if about and FOR.search(about) else 0)
            self.own.append(0)
            self.linked.append(0)
            if not closed:
                stack.append(len(self.tags) - 1)
                open_[name] += 1
        text(source[at:])
        flush()

    def evidence(self) -> list[tuple[int, int, int, int]]:
        out = []
        for tag, words, own, linked in zip(self.tags, self.words, self.own, self.linked, strict=True):
            share = 0 if not own else 1 if linked * 4 <= own else 2 if linked * 4 <= 3 * own else 3
            size = 0 if not own else 1 if own < 25 else 2 if own < 100 else 3 if own < 400 else 4
            out.append((KINDS.get(tag, 0), words, share, size))
        return out

    def labels(self) -> list[int] | None:
        """Content or not by the page's own article or main element; None if it has none."""
        if not any(t in ("article", "main") for t in self.tags):
            return None
        out = [0]
        for tag, parent, words in zip(self.tags[1:], self.parents[1:], self.words[1:], strict=True):
            inside = out[parent] or tag in ("article", "main")
            out.append(int(inside and words != 1 and tag not in ("nav", "aside", "form", "footer", "menu", "dialog", "fieldset")))
        return out


class Model:
    """Log potentials from counts of labelled nodes."""

    #: Pseudo counts of states below states, and of evidence kinds in either state (kind of tag, words in class or id).
    PRIOR_PASS = ((2000.0, 1.0), (4.0, 60.0))
    #: The same into an article or main element.
    PRIOR_MARK = ((1.0, 20.0), (1.0, 60.0))
    PRIOR_KIND = {KINDS["article"]: (1, 60), KINDS["nav"]: (60, 1), KINDS["header"]: (20, 2), KINDS["footer"]: (300, 1), KINDS["aside"]: (40, 1), KINDS["form"]: (40, 1), KINDS["p"]: (10, 60), KINDS["h1"]: (10, 20), KINDS["ul"]: (10, 5), KINDS["li"]: (20, 10), KINDS["table"]: (10, 10), KINDS["html"]: (10, 1)}
    PRIOR_WORDS = ((60, 90), (2000, 0), (2, 20))
    PRIOR_LINKS = ((20, 20), (20, 60), (20, 10), (40, 2))
    PRIOR_SIZES = ((20, 20), (30, 8), (20, 20), (10, 30), (3, 30))

    MARKS, MILD = frozenset(KINDS[k] for k in ("article", "nav", "header", "footer", "aside", "form")), 1.2

    def __init__(self, pages: Iterable[Page] = ()):
        unary = [np.ones((n, 2)) for n in FEATURES]
        for k, x in self.PRIOR_KIND.items():
            unary[0][k] = x
        for table, prior in zip(unary[1:], (self.PRIOR_WORDS, self.PRIOR_LINKS, self.PRIOR_SIZES), strict=True):
            table += np.array(prior, float)
        passed, marked = np.array(self.PRIOR_PASS), np.array(self.PRIOR_MARK)
        for page in pages:
            labels = page.labels()
            if labels is None:
                continue
            for node, (parent, label, kinds) in enumerate(zip(page.parents, labels, page.evidence(), strict=True)):
                if node:
                    (marked if page.tags[node] in ("article", "main") else passed)[labels[parent], label] += 1
                for table, k in zip(unary, kinds, strict=True):
                    table[k, label] += 1
        logs = [np.log(t / t.sum(0)) for t in unary]
        # Evidence that isn't a mark of its own is weak, and counted for each node: it is held within MILD.
        odds = [x[:, 1] - x[:, 0] for x in logs]
        mild = [k for k in range(N_KINDS) if k not in self.MARKS]
        odds[0][mild] = np.clip(odds[0][mild], -self.MILD, self.MILD)
        odds[2:] = [np.clip(x, -self.MILD / 2, self.MILD / 2) for x in odds[2:]]
        self.odds = [x.tolist() for x in odds]
        self.passed, self.marked = ((x / x.sum(1, keepdims=True)).tolist() for x in (passed, marked))

    def marginals(self, page: Page) -> list[float]:
        """Probability of content of each node: messages up in reverse page order, then down in page order."""
        from math import exp

        n = len(page.tags)
        edge = [self.marked if t in ("article", "main") else self.passed for t in page.tags]
        up0, up1, to0, to1 = [1.0] * n, [1.0] * n, [1.0] * n, [1.0] * n
        for i, kinds in enumerate(page.evidence()):
            d = sum(t[k] for t, k in zip(self.odds, kinds, strict=True))
            up1[i] = 1 / (1 + exp(-d))
            up0[i] = 1 - up1[i]
        for i in range(n - 1, 0, -1):
            s = up0[i] + up1[i]
            b0, b1 = up0[i] / s, up1[i] / s
            (a00, a01), (a10, a11) = edge[i]
            up0[i], up1[i] = b0, b1
            m0, m1 = a00 * b0 + a01 * b1, a10 * b0 + a11 * b1
            to0[i], to1[i] = m0, m1
            p = page.parents[i]
            x, y = up0[p] * m0, up1[p] * m1
            up0[p], up1[p] = x / (x + y), y / (x + y)
        down0, down1 = [0.9999] * n, [0.0001] * n
        out = [0.0] * n
        for i in range(n):
            if i:
                p = page.parents[i]
                # The parent's belief without what this child sent up.
                q0, q1 = down0[p] * up0[p] / to0[i], down1[p] * up1[p] / to1[i]
                (a00, a01), (a10, a11) = edge[i]
                d0, d1 = q0 * a00 + q1 * a10, q0 * a01 + q1 * a11
                down0[i], down1[i] = d0 / (d0 + d1), d1 / (d0 + d1)
            x, y = down0[i] * up0[i], down1[i] * up1[i]
            out[i] = y / (x + y)
        return out

    def extract(self, source: str | None) -> str:
        if not source:
            return ""
        page = Page(source)
        if not page.blocks:
            return ""
        p = self.marginals(page)
        return "\n".join(t for k, t in page.blocks if p[k] > 0.5)


def train(pages: DataFrame) -> Model:
    share = max(1, pages.count() // TRAIN)
    mark = F.xxhash64("html")
    sample = pages.filter(F.col("html").isNotNull() & (F.pmod(mark, F.lit(share)) == 0)).select("html").distinct().orderBy(mark, "html").limit(TRAIN)
    return Model(Page(r["html"]) for r in sample.collect())


def extraction_table(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars."""
    model = pages.sparkSession.sparkContext.broadcast(train(pages))

    def of(b: pa.RecordBatch) -> list:
        texts = [model.value.extract(x) for x in b.column("html").to_pylist()]
        return [texts, [len(t) for t in texts]]

    return per_row(pages.select("page_id", "url", "html"), ["page_id", "url"], [field("text", "string"), field("n_chars", "long")], of)
