"""Main text of web pages by a tree-structured graphical model.

Each page is parsed into a tree of block elements whose leaves are runs of text. Every node has a
hidden label: ``mixed`` (holds both kinds), ``content`` or ``other``. Potentials of single nodes
come from tags, class names and the shape of the text; potentials of parent and child come from the
labels and the child's kind. Both are trained by counting on labelled pages (HTML whose elements
carry ``data-label``), and sum-product message passing, up and then down the trees, gives each
leaf's marginal. Leaves that are more likely content than not make up the text.

Trees of a batch go through the passes together, one depth at a time. Comments, scripts, styles and
the title never become nodes, nor do ``noscript``, ``template``, drawings and players with what they
hold; character references are decoded; white space in a block is one space; ``br`` is white space,
other tags within a block are nothing; blocks are joined by ``\\n`` in page order. A list of nothing
but links counts as a menu, also inside the article.

Defined cases: null or empty html gives an empty text; text without tags is one block; a head, body
or paragraph may lack its tags; broken markup is closed as browsers do, as far as that changes
blocks: a script, style, frame, title or comment that nothing closes takes the rest, any other
element doesn't; a block as likely content as not is content; a null page_id or url stays null;
repeated rows are extracted each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import html as H
import random
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import table

LABELS = ("mixed", "content", "other")
# Element kinds of HTML.
KIND_OF = {
    "html": "root", "body": "root", "div": "div", "center": "div", "section": "section", "main": "main", "article": "article", "header": "header", "hgroup": "heading",
    "footer": "footer", "nav": "nav", "menu": "nav", "aside": "aside", "form": "form", "fieldset": "form", "legend": "form", "label": "form", "button": "form", "select": "form",
    "option": "form", "optgroup": "form", "datalist": "form", "dialog": "dialog", "ul": "list", "ol": "list", "dl": "list", "li": "item", "dt": "item", "dd": "item", "p": "p",
    "h1": "heading", "h2": "heading", "h3": "heading", "h4": "heading", "h5": "heading", "h6": "heading", "table": "table", "thead": "table", "tbody": "table", "tfoot": "table",
    "caption": "table", "tr": "table", "td": "cell", "th": "cell", "blockquote": "quote", "pre": "p", "figure": "figure", "figcaption": "figure", "address": "address",
    "details": "div", "summary": "heading", "hr": "div", "search": "form",
}
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Words of class, id and role, in this order of weight.
WORDS = {
    "comment": "comment comments commentlist reply replies disqus respond discussion responses",
    "ad": "ad ads advert adverts advertisement advertising adsense adbox adslot sponsor sponsored sponsors promo promoted promotion promotional dfp adunit banner-ad",
    "notice": "notice notices cookie cookies consent gdpr alert popup modal overlay newsletter subscribe subscription paywall toast banner dialog warning announcement",
    "share": "share sharing social follow sharebar addthis",
    "nav": "nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager topnav tabs sitemap skip",
    "form": "form search searchbox login signin signup register contact",
    "footer": "footer foot copyright colophon legal bottom contentinfo",
    "side": "sidebar side aside widget widgets rail related recommended recommendations trending popular complementary teaser teasers more",
    "header": "header masthead topbar branding logo top site-title banner-top",
    "hidden": "hidden visuallyhidden sr",
    "content": "content article post entry main body story text prose articlebody maincontent page-content",
}
_WORD = {w: k for k, ws in WORDS.items() for w in ws.split()}
KINDS = sorted({*KIND_OF.values(), "custom", "leaf"})
HINTS = ["none", *WORDS, "content-header"]
_KIND, _HINT = {k: i for i, k in enumerate(KINDS)}, {k: i for i, k in enumerate(HINTS)}
_LEAF = _KIND["leaf"]
SIZES, LINKS, ENDS = 6, 3, 4  # values of the three features of a leaf; 0 for elements

_ATTRS = r"(?:[^>\"']|\"[^\"]*\"|'[^']*')*"
#: Comments, elements whose content is no markup (to the page's end where none closes them, as in browsers), declarations.
_DROP = re.compile(rf"<!--(?:-?>|.*?(?:--!?>|\Z))|<(script|style|iframe|title|textarea|noembed|noframes|xmp)\b{_ATTRS}>.*?(?:</\1\b[^>]*>|\Z)|<!\[CDATA\[|\]\]>|<[!?][^>]*>", re.S | re.I)
#: Elements that are left out whole where they are closed; where they aren't, only the tag is.
_SKIPPED = {k: re.compile(rf"</{k}\b[^>]*>", re.I) for k in ("noscript", "template", "svg", "math", "object", "canvas", "audio", "video")}
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
_CUT = re.compile(r"<[a-zA-Z/!?][^<>]*\Z")
_ATTR = re.compile(r"\b(class|id|role|style|data-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|\b(hidden)\b(?!\s*=)|aria-(hidden)\s*=\s*\"true\"", re.I)
_SPLIT = re.compile(r"[^A-Za-z]+|(?<=[a-z])(?=[A-Z])")
_CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}


@lru_cache(20_000)
def _hint(attrs: str) -> tuple[int, int]:
    """The hint that class, id, role, style and hidden give, and the label of a labelled page (-1: none)."""
    found, label, words = set(), -1, []
    for name, a, b, c, hidden, aria in _ATTR.findall(attrs):
        value, name = a or b or c, name.lower()
        if hidden or aria or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            found.add("hidden")
        elif name == "data-label":
            label = LABELS.index(value)
        elif name != "style":
            for part in value.split():
                words += [w.lower() for w in _SPLIT.split(part)] + [""]
    before = ""
    for w in words:
        if w in _WORD and before not in ("has", "with", "no", "without", "has-"):
            found.add(_WORD[w])
        before = w
    if "header" in found and "content" in found:
        return _HINT["content-header"], label
    return next((_HINT[k] for k in WORDS if k in found), 0), label


class Trees:
    """The trees of some pages, as parallel lists over all nodes."""

    def __init__(self) -> None:
        self.parent: list[int] = []
        self.depth: list[int] = []
        self.kind: list[int] = []
        self.hint: list[int] = []
        self.size: list[int] = []
        self.links: list[int] = []
        self.ends: list[int] = []
        self.label: list[int] = []
        self.text: list[str] = []
        self.page: list[int] = []

    def _add(self, page: int, parent: int, kind: int, hint: int = 0, size: int = 0, links: int = 0, ends: int = 0, label: int = -1, text: str = "") -> int:
        self.page.append(page)
        self.parent.append(parent)
        self.depth.append(self.depth[parent] + 1 if parent >= 0 else 0)
        self.kind.append(kind)
        self.hint.append(hint)
        self.size.append(size)
        self.links.append(links)
        self.ends.append(ends)
        self.label.append(label)
        self.text.append(text)
        return len(self.parent) - 1

    def parse(self, page: int, source: str) -> None:
        source = _CUT.sub("", _DROP.sub("", source))
        root = self._add(page, -1, _KIND["root"], label=0)
        stack: list[tuple[str, int]] = [("html", root)]
        run: list[str] = []
        linked, anchors, at = 0, 0, 0
        opened: Counter[str] = Counter()  # elements on the stack, by name
        unclosed: set[str] = set()

        def flush() -> None:
            nonlocal linked
            text = " ".join((H.unescape(t) if "&" in (t := "".join(run)) else t).split())
            run.clear()
            if text:
                n = text.count(" ") + 1
                size = 1 + (n > 2) + (n > 8) + (n > 20) + (n > 60)
                share = linked / max(1, len(text))
                self._add(page, stack[-1][1], _LEAF, 0, size, 1 if share < 0.1 else 2, 1 if text[-1] in ".!?…\"”»:;" else 2 if text[0] in "©®™" or "©" in text else 3, self.label[stack[-1][1]] or 1, text)
            linked = 0

        def close(k: int) -> None:
            for name, _ in stack[k:]:
                opened[name] -= 1
            del stack[k:]

        while m := _TAG.search(source, at):
            if m.start() > at:
                run.append(piece := source[at : m.start()])
                if anchors:
                    linked += len(piece)
            at = m.end()
            end, name, attrs = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
            name = name.lower()
            if name in _SKIPPED:
                if not end and name not in unclosed and not (name in ("svg", "math") and attrs.rstrip().endswith("/")):
                    if last := _SKIPPED[name].search(source, at):
                        at = last.end()
                    else:
                        unclosed.add(name)
                continue
            if name == "a":
                anchors = 0 if end else 1
                continue
            kind = KIND_OF.get(name)
            if kind is None:
                if "-" not in name:
                    if name == "br":
                        run.append(" ")
                    continue
                kind = "custom"
            if kind == "root":
                flush()
                continue
            flush()
            if end:
                if opened[name]:
                    close(max(k for k in range(1, len(stack)) if stack[k][0] == name) if stack[-1][0] != name else len(stack) - 1)
                continue
            if name in _CLOSES:
                same, stop = _CLOSES[name]
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] in same:
                        close(k)
                        break
                    if stack[k][0] in stop:
                        break
            elif stack[-1][0] == "p" or len(stack) > 1 and kind == "heading" and KIND_OF.get(stack[-1][0]) == "heading" and name != "hgroup":
                close(len(stack) - 1)
            if name not in VOID and not attrs.rstrip().endswith("/"):
                hint, label = _hint(attrs) if attrs else (0, -1)
                up = self.label[stack[-1][1]]
                stack.append((name, self._add(page, stack[-1][1], _KIND[kind], hint, label=label if label >= 0 else up)))
                opened[name] += 1
        if at < len(source):
            run.append(source[at:])
        flush()

    def arrays(self) -> dict[str, np.ndarray]:
        return {k: np.array(getattr(self, k), np.int64) for k in ("parent", "depth", "kind", "hint", "size", "links", "ends", "label")}


class Model:
    """Logarithms of the potentials, learned by counting."""

    def __init__(self, pages: list[str], smooth: float = 0.3) -> None:
        trees = Trees()
        for i, p in enumerate(pages):
            trees.parse(i, p)
        a = trees.arrays()
        y, inner = a["label"], a["parent"] >= 0
        up = a["parent"][inner]

        def table_of(shape: tuple, index: tuple) -> np.ndarray:
            c = np.full(shape, smooth)
            np.add.at(c, index, 1)
            return c

        self.hint = table_of((3, len(HINTS)), (y[a["kind"] != _LEAF], a["hint"][a["kind"] != _LEAF]))
        self.size = table_of((3, SIZES), (y, a["size"]))
        self.links = table_of((3, LINKS), (y, a["links"]))
        self.ends = table_of((3, ENDS), (y, a["ends"]))
        for k in ("hint", "size", "links", "ends"):
            x = getattr(self, k)
            setattr(self, k, np.log(x / x.sum(1, keepdims=True)).T)
        # parent and child: label of the child and its kind, given the parent's label
        pair = table_of((3, 3, len(KINDS)), (y[up], y[inner], a["kind"][inner]))
        pair += 0.05 * pair.sum(0, keepdims=True) / pair.sum() * pair.sum((1, 2), keepdims=True) / 3
        self.pair = np.log(pair / pair.sum((1, 2), keepdims=True)).transpose(2, 0, 1)

    def marginals(self, a: dict[str, np.ndarray]) -> np.ndarray:
        """P(label) of every node, by sum-product up and down the trees."""
        leaf = a["kind"] == _LEAF
        own = np.where(leaf[:, None], self.size[a["size"]] + self.links[a["links"]] + self.ends[a["ends"]], self.hint[a["hint"]])
        own[leaf, 0] -= 1e3  # a leaf isn't mixed
        own[a["parent"] < 0] = (0, -20, -20)
        order = np.argsort(a["depth"], kind="stable")
        levels = np.split(order, np.flatnonzero(np.diff(a["depth"][order])) + 1) if len(order) else []
        below = own.copy()  # own potential and the messages from all children
        sent = np.zeros_like(own)
        for at in levels[:0:-1]:
            m = self.pair[a["kind"][at]] + below[at][:, None, :]
            top = m.max(2)
            sent[at] = top + np.log(np.exp(m - top[:, :, None]).sum(2))
            np.add.at(below, a["parent"][at], sent[at])
        belief = below.copy()
        for at in levels[1:]:
            rest = belief[a["parent"][at]] - sent[at]
            m = self.pair[a["kind"][at]] + rest[:, :, None]
            top = m.max(1)
            belief[at] += top + np.log(np.exp(m - top[:, None, :]).sum(1))
        belief -= belief.max(1, keepdims=True)
        p = np.exp(belief)
        return p / p.sum(1, keepdims=True)

    def texts(self, pages: list[str | None]) -> list[str]:
        trees = Trees()
        for i, p in enumerate(pages):
            if p:
                trees.parse(i, p)
        out: list[list[str]] = [[] for _ in pages]
        p = self.marginals(trees.arrays())
        for k in np.flatnonzero((np.array(trees.kind) == _LEAF) & (p[:, 1] >= 0.5)).tolist():
            out[trees.page[k]].append(trees.text[k])
        return ["\n".join(x) for x in out]


def labelled_pages(n: int = 600, seed: int = 11) -> list[str]:
    """Made-up labelled pages of many layouts, as the tables hold no labels for pages."""
    r = random.Random(seed)
    parts = "an ber con der ein for gra hal ist jor kel lun mar nes ort pra qui ras ste tur und ver wol zan".split()

    def words(lo: int, hi: int) -> str:
        return " ".join("".join(r.choices(parts, k=r.randint(1, 3))) for _ in range(r.randint(lo, hi)))

    def sentence(lo: int = 6, hi: int = 40) -> str:
        return words(lo, hi).capitalize() + r.choice(".....!?")

    def prose(k: int) -> str:
        return " ".join(sentence() for _ in range(k))

    def tag(name: str, inner: str, cls: str = "", label: str = "") -> str:
        attr = (f' {r.choice(("class", "class", "id"))}="{cls}"' if cls else "") + (f' data-label="{label}"' if label else "")
        return f"<{name}{attr}>{inner}</{name}>"

    def links(k: int, wrap: str = "li") -> str:
        return "".join(f'<{wrap}><a href="/x">{words(1, 4)}</a></{wrap}>' for _ in range(k))

    def other(kind: str) -> str:
        """Something that isn't the article."""
        d = r.choice(("div", "div", "section"))
        if kind == "nav":
            inner = r.choice((lambda: "<ul>" + links(r.randint(3, 9)) + "</ul>", lambda: links(r.randint(3, 8), "span"), lambda: "<p>" + links(4, "b") + "</p>"))()
            return tag(*r.choice((("nav", inner, ""), ("nav", inner, "menu"), (d, inner, "main-menu"), (d, inner, "navbar"), ("ul", links(6), "menu"), (d, inner, "breadcrumbs"), (d, inner, "pagination"))), "other")
        if kind == "header":
            inner = r.choice((f"<h1>{words(1, 4)}</h1>", f"<a href='/'>{words(1, 3)}</a>", f"<p>{sentence()}</p>", f"<h2>{words(2, 4)}</h2><p>{words(3, 8)}</p>"))
            return tag(*r.choice((("header", inner, ""), ("header", inner, "site-header"), (d, inner, "header"), (d, inner, "masthead"), (d, inner, "topbar"))), "other")
        if kind == "footer":
            inner = r.choice((f"&copy; {words(2, 5)} &middot; {sentence(3, 12)}", f"<p>&copy; 2024 {words(1, 4)}</p>" + "<ul>" + links(4) + "</ul>", f"<p>{prose(2)}</p>", words(2, 6)))
            return tag(*r.choice((("footer", inner, ""), ("footer", inner, "site-footer"), (d, inner, "footer"), (d, inner, "copyright"))), "other")
        if kind == "side":
            inner = f"<h3>{words(1, 3)}</h3>" + r.choice(("<ul>" + links(5) + "</ul>", f"<p>{prose(2)}</p>", f"<p>{prose(1)}</p><p>{prose(2)}</p>"))
            return tag(*r.choice((("aside", inner, ""), ("aside", inner, "sidebar"), (d, inner, "sidebar"), (d, inner, "widget"), (d, inner, "related"), (d, inner, "right-rail"))), "other")
        if kind == "ad":
            inner = r.choice((sentence(), f"<p>{sentence()}</p>", f"<a href='/b'>{words(2, 8)}</a>", f"<p>{prose(2)}</p>"))
            return tag(*r.choice(((d, inner, "ad"), (d, inner, "advert"), (d, inner, "sponsored"), ("aside", inner, "promo"), (d, inner, "ad-slot"))), "other")
        if kind == "notice":
            inner = r.choice((f"<p>{prose(1)}</p><button>{words(1, 2)}</button>", sentence(), f"<p>{prose(2)}</p>"))
            return tag(*r.choice(((d, inner, "cookie-notice"), (d, inner, "notice"), (d, inner, "newsletter"), (d, inner, "popup"), ("dialog", inner, ""), (d, inner, "consent"), (d, inner, "alert"))), "other")
        if kind == "form":
            inner = f"<label>{words(1, 3)}</label><input name=q><button>{words(1, 2)}</button>" + r.choice(("", f"<p>{sentence()}</p>", f"<select><option>{words(1, 2)}</option></select>"))
            return tag(*r.choice((("form", inner, ""), ("form", inner, "search"), (d, "<form>" + inner + "</form>", "login"))), "other")
        if kind == "share":
            return tag(d, "<ul>" + links(3) + "</ul>" if r.random() < 0.5 else words(1, 3), r.choice(("share", "social")), "other")
        one = lambda: r.choice((f"<p>{prose(r.randint(1, 3))}</p>", f"<b>{words(1, 2)}</b><p>{sentence()}</p>"))
        inner = f"<h3>{words(1, 3)}</h3>" + "".join(r.choice((tag("div", one(), "comment"), tag("li", one()), tag("article", one(), "comment"), one())) for _ in range(r.randint(1, 5)))
        return tag(*r.choice((("section", inner, "comments"), ("div", inner, "comments"), ("ol", inner, "commentlist"), ("div", inner, "disqus"), ("section", inner, "responses"))), "other")

    def article(bare: bool) -> str:
        out = [r.choice((f"<h1>{words(2, 10)}</h1>", f"<h1>{prose(1)[:60]}</h1>", f"<header><h1>{words(3, 9)}</h1></header>", f'<div class="article-header"><h1>{words(3, 9)}</h1></div>', f"<h2>{words(2, 8)}</h2>", ""))]
        for _ in range(r.randint(1, 9)):
            out.append(r.choice((
                lambda: f"<p>{prose(r.randint(1, 5))}</p>", lambda: f"<p>{prose(r.randint(1, 5))}</p>", lambda: f"<p>{prose(r.randint(1, 4))}", lambda: f"<p>{words(1, 2)}.</p>", lambda: f"<p>{words(1, 12)}</p>",
                lambda: f"<p><b>{prose(2)}<br><p>{prose(1)}</p>", lambda: f"<p>{sentence()} <a href='/y'>{words(1, 4)}</a> {sentence()}</p>", lambda: f"<h2>{words(1, 6)}</h2>", lambda: f"<blockquote><p>{prose(1)}</p></blockquote>",
                lambda: "<ul>" + "".join(f"<li>{words(1, 15)}</li>" for _ in range(3)) + "</ul>", lambda: "<table><tr>" + "".join(f"<td>{words(1, 4)}</td>" for _ in range(4)) + "</tr></table>",
                lambda: f"<figure><img src=x><figcaption>{words(3, 12)}</figcaption></figure>", lambda: f"<div>{prose(2)}</div>", lambda: f"<section><h2>{words(1, 5)}</h2><p>{prose(2)}</p></section>", lambda: f"<pre>{words(3, 20)}</pre>",
            ))())
            if r.random() < 0.08:
                out.append(other(r.choice(("ad", "share", "side", "notice", "form"))))
        inner = "".join(out)
        if bare:
            head = r.choice(("", f'<h1 data-label="content">{words(1, 9)}</h1>', f'<h1 data-label="content">{words(1, 9)}</h1>'))
            return head + r.choice((words(1, 40), prose(2), *["".join(f'<p data-label="content">{r.choice((prose(r.randint(1, 4)), words(1, 9)))}</p>' for _ in range(r.randint(1, 6)))] * 3))
        return tag(*r.choice((("article", inner, ""), ("article", inner, ""), ("article", inner, "post"), ("main", inner, ""), ("div", inner, "content"), ("div", inner, "article-body"), ("div", inner, "entry"), ("section", inner, "story"), ("div", inner, ""))), "content")

    pages = []
    for _ in range(n):
        before = [other(k) for k in r.sample(("nav", "header", "ad", "notice", "form", "share"), r.randint(1, 4))]
        after = [other(k) for k in r.sample(("side", "comment", "ad", "share", "form", "notice", "nav"), r.randint(0, 4))] + ([other("footer")] if r.random() < 0.9 else [])
        middle = article(bare := r.random() < 0.12)
        if r.random() < 0.4:
            k = r.randint(0, len(after))
            middle = tag(r.choice(("div", "main", "section")), middle + "".join(after[:k]), r.choice(("", "wrapper", "container", "main", "content has-sidebar", "page")), "mixed")
            after = after[k:]
        body = "".join((*before, middle, *after)) if not bare or r.random() < 0.7 else middle
        if r.random() < 0.2:
            body = tag("div", body, r.choice(("", "page", "wrapper")), "mixed")
        pages.append(f"<!DOCTYPE html><html><head><title>{words(1, 5)}</title></head><body>{body}</body></html>")
    return pages


def extracted(pages: DataFrame, labelled: list[str] | None = None) -> DataFrame:
    """page_id, url, text, n_chars of every row of pages (page_id, url, html)."""
    model = pages.sparkSession.sparkContext.broadcast(Model(labelled or labelled_pages()))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lo = 0
            source = b.column(2).to_pylist()
            while lo < len(source):
                hi, size = lo, 0
                while hi < len(source) and (hi == lo or size < 1 << 19):
                    size += len(source[hi] or "")
                    hi += 1
                texts = model.value.texts(source[lo:hi])
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), b.column(1).slice(lo, hi - lo), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])
                lo = hi

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(rows, "page_id long, url string, text string, n_chars long")


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(table(spark, sf_dir, "pages"))


QUERIES = {"op1_html_text": op1_html_text}
ORACLES: dict[str, str] = {}
