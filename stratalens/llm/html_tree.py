"""Main text of web pages by a tree-structured graphical model over the DOM.

A page is parsed leniently into its block elements (inline ones melt into their block).
Each node is content or not; local evidence is a logistic regression on its tag, class and
id words, length, links and punctuation; a parent-child potential for each kind of child
says how the label passes down. Both are trained from labelled pages. Sum-product messages
run upward and downward once, in log odds, which is exact on a tree, and give each node's
marginal; the text of blocks above one half, in page order, is the result. Runs of text that
stand in the body or outside of any element are blocks of their own (``bare``).

Labelled pages: ``labelled_pages`` writes varied layouts whose blocks carry their label;
``fit`` takes any others in the same form (attribute ``data-y``). Training is a second on the
driver; the model is a few hundred numbers. Pages are read whole, in the tasks that hold
them, without a shuffle.

Null and empty html give an empty text. Broken markup never fails: unclosed elements end
where HTML would end them, a tag without ``>`` is text. Only the elements whose content is
raw text (``RAW``) reach their own end tag or the end of the page; what else is hidden
(``HIDDEN``) stands in the tree and ends with what it stands in (so do object, select and
template, which HTML would let run on). ``head`` bounds nothing, as HTML ends it at the first
content. Once a quoted value never ends, the rest of the page is read without quotes.
Parsing takes time in proportion to a page's length, however it is marked up; a very long
page takes memory of a few times its size, in its task alone. Repeated rows are no matter, extra
columns stay; one of the name of the result raises an error.
"""

from __future__ import annotations

import html as _html
import math
import random
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import map_batches

# Fixed values of HTML: elements by how they are laid out.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
RAW = frozenset("script style noscript iframe textarea title".split())
HIDDEN = frozenset("template object svg math canvas audio video select".split())
SCOPE = frozenset("template object select foreignobject desc annotation-xml".split())  # inner tags end nothing outside
FOREIGN = frozenset("svg math".split())
INTEGRATION = frozenset("foreignobject desc title annotation-xml mi mo mn ms mtext".split())  # HTML again within FOREIGN
BREAKOUT = frozenset("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split())
ENDS_SELECT = frozenset("input keygen textarea select caption table tbody tfoot thead tr td th".split())
CLOSES_P = frozenset("address article aside blockquote body details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"thead", "tr", "td", "th"}}
BARRIER = frozenset("article aside body div fieldset footer form header html main nav ol section table ul dl".split())

NAME = re.compile(r"<(?P<end>/?)(?P<tag>[a-z][^\s/>]*+)", re.I)
QUOTING, PLAIN = re.compile("((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"), re.compile("([^>]*+)>")
RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*+(?:>|\Z)", re.I) for t in RAW}
QUOTED, BARE_LAST = re.compile("\"[^\"]*+\"|'[^']*+'"), re.compile(r"=\s*[^\s\"]\S*\Z")
LONG_NUMBER = re.compile(r"&#0*+([0-9]{8,})")
ATTR = re.compile(r"(?<![-\w:.])([a-z_:][-\w:.]*+)(?:\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?+", re.I)

# Words in class, id and role that hint at a block's part; stated together, by part.
PARTS = {
    "body": "article content post entry story main text body",
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs pager pagination toc tabs skip",
    "head": "header masthead banner logo topbar branding",
    "foot": "footer copyright legal colophon bottom",
    "side": "sidebar aside rail widget widgets secondary",
    "advert": "ad ads advert adverts advertisement sponsor sponsored promo promotion adslot dfp",
    "notice": "cookie cookies consent gdpr notice alert popup modal overlay paywall warning",
    "talk": "comment comments reply replies discussion disqus respond thread",
    "share": "share sharing social follow",
    "more": "related recommended recommendations more popular trending readnext",
    "form": "form newsletter subscribe subscription signup login search",
}
PART_OF = {w: k for k, words in PARTS.items() for w in words.split()}
# in a longer word these count where it begins (commentlist, adsbygoogle) or ends (mainmenu) with them
BEGINS = re.compile("(?:" + "|".join(sorted((w for w, k in PART_OF.items() if k != "body" and (len(w) >= 5 or w == "ads")), key=len, reverse=True)) + ")(?!ary|able)")
ENDS = re.compile("(?:" + "|".join(sorted((w for w, k in PART_OF.items() if k in ("menu", "head", "foot", "side", "advert") and len(w) >= 4), key=len, reverse=True)) + r")\Z")
# what a paragraph's own class can say of it, and that of an inline element
OF_TEXT, OF_INLINE = frozenset(("advert", "notice", "talk", "form")), frozenset(("advert", "share"))
TEXT = frozenset("p pre blockquote figcaption li td th dt dd h1 h2 h3 h4 h5 h6".split())
KINDS = ["article", "bare", "block", "part", "text"]


@dataclass
class Node:
    tag: str
    parent: int
    words: frozenset = frozenset()
    text: list = field(default_factory=list)
    linked: int = 0
    y: int | None = None
    bare: int | None = None  # label of the runs of text that stand in it
    gone: bool = False  # hidden, or within something hidden


def _part(word: str) -> str | None:
    """What a word of a class, id or role says."""
    if word in PART_OF:
        return PART_OF[word]
    found = BEGINS.match(word) or ENDS.search(word)
    return PART_OF[found[0]] if found else None


def _marks(attrs: str) -> tuple[dict, frozenset, bool]:
    """The attributes, the parts that they name, whether they hide the element."""
    given = {}
    for k, a, b, c in ATTR.findall(attrs):
        given.setdefault(k.lower(), a or b or c)
    said = (w for k in ("class", "id", "role", "aria-label") if k in given for w in re.split(r"[^a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", given[k]).lower()))
    style = re.sub(r"\s", "", given.get("style", "").lower())
    hidden = "hidden" in given or given.get("aria-hidden", "").strip().lower() == "true" or "display:none" in style or "visibility:hidden" in style
    return given, frozenset(filter(None, map(_part, said))), hidden


def _self_closed(attrs: str) -> bool:
    """A slash at the end that is not part of a value without quotes."""
    return attrs.endswith("/") and not BARE_LAST.search(QUOTED.sub('""', attrs))


class Open:
    """The open elements, with the places of those that decide what a tag ends, so that no
    tag makes us walk the stack."""

    def __init__(self):
        self.stack: list[tuple[str, int, bool]] = [("document", 0, False)]  # tag, block, whether inner tags are foreign
        self.at: dict[str, list[int]] = {}
        self.barriers, self.scopes, self.lists, self.others = [], [], [], []
        self.links = self.hidden = 0

    def push(self, tag: str, block: int, foreign: bool) -> None:
        i = len(self.stack)
        self.stack.append((tag, block, foreign))
        for places in self._kinds(tag):
            places.append(i)
        self.links += tag == "a"
        self.hidden += tag in HIDDEN

    def _kinds(self, tag: str) -> list[list[int]]:
        kinds = [self.at.setdefault(tag, [])]
        if tag in BARRIER or tag in SCOPE:
            kinds.append(self.barriers)
        if tag in SCOPE or tag in ("ul", "ol", "dl", "table"):
            kinds.append(self.lists)
        if tag not in INLINE and tag not in ("option", "optgroup", "select"):
            kinds.append(self.others)
        return kinds

    def close(self, i: int) -> None:
        while len(self.stack) > i:
            tag, *_ = self.stack.pop()
            for places in self._kinds(tag):
                places.pop()
            self.links -= tag == "a"
            self.hidden -= tag in HIDDEN

    def last(self, tag: str) -> int:
        places = self.at.get(tag)
        return places[-1] if places else 0

    def end(self, tag: str) -> None:
        """An end tag; one of an inline element ends nothing outside its block."""
        i = self.last(tag)
        if i and not (tag in INLINE and self.barriers and self.barriers[-1] > i):
            self.close(i)

    def start(self, tag: str) -> None:
        """What the start of a block ends."""
        shut = CLOSED_BY.get(tag, set()) | ({"p"} if tag in CLOSES_P else set())
        i = max(map(self.last, shut), default=0)
        stops = self.lists if tag in ("li", "dt", "dd", "tr", "td", "th", "tbody") else self.barriers
        if i and not (stops and stops[-1] > i):
            self.close(i)

    def end_select(self) -> bool:
        i = self.last("select")
        if not i or (self.others and self.others[-1] > i):
            return False
        self.close(i)
        return True


def _decoded(piece: str) -> str:
    """Character references; a number beyond all characters is the replacement character."""
    return _html.unescape(LONG_NUMBER.sub("&#99999999", piece)) if "&" in piece else piece


def parse(page: str | None) -> list[Node]:
    """Block elements in page order, node 0 the document."""
    nodes, now, spans = [Node("document", -1)], Open(), 0
    page, last, quoting = page or "", 0, True

    def say(piece: str) -> None:
        nonlocal spans
        if not piece or now.hidden:
            return
        piece = _decoded(piece)
        at = now.stack[-1][1]
        if nodes[at].tag in ("document", "html", "body"):
            if not (nodes[-1].tag == "bare" and nodes[-1].parent == at):
                if piece.isspace():
                    return
                nodes.append(Node("bare", at, y=nodes[at].bare, gone=nodes[at].gone))
            at = len(nodes) - 1
        nodes[at].text.append((spans, piece))
        spans += 1
        if now.links:
            nodes[at].linked += len(piece.strip())

    end_of_tags = page.rfind(">")
    while (i := page.find("<", last)) >= 0:
        m = NAME.match(page, i) if i < end_of_tags else None
        if m is None:
            opening = page[i : i + 9]
            if opening.startswith("<!--"):
                end = page.find("-->", i + 4)
                after = end + 3 if end >= 0 else len(page)
            elif opening == "<![CDATA[":
                end = page.find("]]>", i)
                after = end + 3 if end >= 0 else len(page)
            elif opening[1:2] in ("!", "?", "/") and i < end_of_tags:
                after = page.find(">", i) + 1
            else:  # no tag: text
                say(page[last : i + 1])
                last = i + 1
                continue
            say(page[last:i])
            if opening == "<![CDATA[":
                say(page[i + 9 : end if end >= 0 else len(page)].replace("&", "&amp;"))
            last = after
            continue
        body = QUOTING.match(page, m.end()) if quoting else None
        if body is None:
            quoting, body = False, PLAIN.match(page, m.end())
        say(page[last:i])
        last, tag, attrs = body.end(), m["tag"].lower(), body[1]
        if now.stack[-1][2] and (tag in ("p", "br") if m["end"] else tag in BREAKOUT or (tag == "font" and re.search(r"(?<![^\s/])(?:color|face|size)\s*(?:=|\Z|\s)", attrs, re.I))):
            while now.stack[-1][2]:
                now.close(len(now.stack) - 1)
        if m["end"]:
            now.end(tag)
            continue
        if now.stack[-1][2]:
            if not _self_closed(attrs):
                now.push(tag, now.stack[-1][1], tag not in INTEGRATION)
            continue
        if now.hidden and tag in ENDS_SELECT and now.end_select() and tag == "select":
            continue
        if tag == "head":
            continue
        if tag in RAW:
            end = RAW_END[tag].search(page, last)
            last = end.end() if end else len(page)
            continue
        if tag in INLINE:
            if tag in VOID:
                say(" ")
                continue
            words, hidden = _marks(attrs)[1:] if "=" in attrs or "hidden" in attrs.lower() else (frozenset(), False)
            if now.hidden or not (hidden or words & OF_INLINE):
                now.push(tag, now.stack[-1][1], False)
            else:  # a block of its own in its block's midst
                up = now.stack[-1][1]
                nodes.append(Node(tag, up, words & OF_INLINE, gone=hidden or nodes[up].gone))
                now.push(tag, len(nodes) - 1, False)
            continue
        now.start(tag)
        if tag in VOID:
            say(" ")
            continue
        if now.hidden or tag in HIDDEN:
            if not (tag in FOREIGN and _self_closed(attrs)):
                now.push(tag, now.stack[-1][1], tag in FOREIGN)
            continue
        given, words, hidden = _marks(attrs) if attrs else ({}, frozenset(), False)
        label = lambda k: int(given[k]) if given.get(k) in ("0", "1") else None
        up = now.stack[-1][1]
        nodes.append(Node(tag, up, words & OF_TEXT if tag in TEXT else words, y=label("data-y"), bare=label("data-bare"), gone=hidden or nodes[up].gone))
        now.push(tag, len(nodes) - 1, False)
    say(page[last:])
    return nodes


def _tidy(node: Node) -> str:
    return " ".join("".join(t for _, t in node.text).split())


def evidence(node: Node, text: str) -> list[str]:
    """Names of the features that hold."""
    n, tag = len(text), node.tag
    out = [f"tag:{'h' if re.fullmatch('h[1-6]', tag) else tag}", f"size:{0 if not n else 1 if n < 25 else 2 if n < 80 else 3 if n < 250 else 4}"]
    out += [f"part:{w}" for w in node.words]
    if n:
        share = node.linked / max(1, n)
        out.append(f"links:{0 if not node.linked else 1 if share < 0.35 else 2 if share < 0.75 else 3}")
        if text[-1] in ".!?…:\"”»":
            out.append("ends")
        if "©" in text:
            out.append("mark")
    return out


def kind(node: Node) -> str:
    """Which parent-child potential: named parts, article elements, text, text without an element, other blocks."""
    if node.words - {"body"} or node.tag in ("nav", "header", "footer", "aside", "form", "button", "label", "fieldset", "dialog", "menu"):
        return "part"
    if node.tag in ("article", "main") or "body" in node.words:
        return "article"
    if node.tag == "bare":
        return "bare"
    return "text" if node.tag in TEXT else "block"


def _share(z: float) -> float:
    """Probability of log odds."""
    return 1 / (1 + math.exp(-z)) if z > -700 else 0.0


@dataclass
class Model:
    weights: dict[str, float] = field(default_factory=dict)
    bias: float = 0.0
    pair: dict[str, tuple[tuple[float, float], tuple[float, float]]] = field(default_factory=dict)  # kind -> [parent][child]

    def marginals(self, nodes: list[Node], texts: list[str]) -> list[float]:
        """P(content) of each node: one pass of messages up, one down."""
        up = [-1e9]  # log odds from below; the document itself is no content
        for node, text in zip(nodes[1:], texts[1:]):
            up.append(max(-30.0, min(30.0, self.bias + sum(self.weights.get(f, 0.0) for f in evidence(node, text)))))
        tables = [None, *(self.pair[kind(x)] for x in nodes[1:])]
        message = [0.0] * len(nodes)
        for i in range(len(nodes) - 1, 0, -1):
            t, p = tables[i], _share(up[i])
            message[i] = math.log((t[1][0] * (1 - p) + t[1][1] * p) / (t[0][0] * (1 - p) + t[0][1] * p))
            up[nodes[i].parent] += message[i]
        belief = [-1e9]
        for i in range(1, len(nodes)):
            t, p = tables[i], _share(belief[nodes[i].parent] - message[i])  # the parent without this child
            belief.append(up[i] + math.log(((1 - p) * t[0][1] + p * t[1][1]) / ((1 - p) * t[0][0] + p * t[1][0])))
        return [0.0, *map(_share, belief[1:])]

    def extract(self, page: str | None) -> str:
        nodes = parse(page)
        texts = ["" if x.gone else _tidy(x) for x in nodes]
        p = self.marginals(nodes, texts)
        pieces: list[tuple[int, str]] = []
        for i, node in enumerate(nodes):
            if texts[i] and p[i] > 0.5:
                # a block's text is cut where other blocks stand in its midst
                run: list[str] = []
                first = before = None
                for at, t in node.text:
                    if before is not None and at != before + 1:
                        pieces.append((first, "".join(run)))
                        run, first = [], None
                    first = at if first is None else first
                    run.append(t)
                    before = at
                pieces.append((first, "".join(run)))
        return " ".join(x for _, t in sorted(pieces) if (x := " ".join(t.split())))


def _sentences(r: random.Random, n: int) -> str:
    say = lambda: "".join(r.choice(["ta", "ri", "lo", "en", "sch", "é", "um", "th"]) for _ in range(r.randint(1, 4)))
    return " ".join(" ".join(say() for _ in range(r.randint(1, 14))).capitalize() + r.choice([".", ".", "?", "!"]) for _ in range(n))


def labelled_pages(n: int = 400, seed: int = 11) -> list[str]:
    """Pages of varied layout; ``data-y`` is 1 on blocks of the article, 0 on others."""
    r = random.Random(seed)
    words = lambda k: _sentences(r, 1).rstrip(".?!")[: 9 * k]

    def links(k):
        return "<ul data-y=0>" + "".join(f'<li data-y=0><a href="/{i}">{words(2)}</a></li>' for i in range(k)) + "</ul>"

    def part(name, tags, inner):
        tag = r.choice(tags)
        own = r.choice(PARTS[name].split())
        mark = f' {r.choice(["class", "id"])}="{r.choice(["", "site-", "page-", "x "])}{own}{r.choice(["", "-box", " wide", "_1"])}"' if tag == "div" or tag == "section" or r.random() < 0.5 else ""
        return f"<{tag}{mark} data-y=0>{inner}</{tag}>"

    def plain(k):
        return "".join(f"<p data-y=0>{_sentences(r, r.randint(1, 3))}</p>" for _ in range(k)) if r.random() < 0.7 else _sentences(r, r.randint(1, 3))

    def noise():
        return r.choice([
            lambda: part("advert", ["div", "aside", "section"], plain(1)),
            lambda: part("side", ["aside", "div"], f"<h3 data-y=0>{words(2)}</h3>" + r.choice([links(4), plain(2)])),
            lambda: part("notice", ["div", "section"], plain(1) + r.choice(["", "<button data-y=0>OK</button>"])),
            lambda: part("share", ["div"], r.choice([links(3), words(2)])),
            lambda: part("more", ["div", "section", "aside"], f"<h3 data-y=0>{words(2)}</h3>" + links(4)),
            lambda: part("form", ["form", "form", "div"], f"<label data-y=0>{words(2)}</label><p data-y=0>{_sentences(r, 1)}</p><input><button data-y=0>Go</button>"),
            lambda: part("talk", ["div", "section", "div"], f"<h2 data-y=0>{words(1)}</h2>" + "".join(r.choice(["<div class=comment data-y=0>{}</div>", "<li data-y=0>{}</li>", "<article class=comment data-y=0>{}</article>"]).format(plain(1)) for _ in range(r.randint(1, 5)))),
        ])()

    def block():
        t = _sentences(r, r.choice([1, 1, 1, 2, 4, 9]))
        if r.random() < 0.2:  # lines without a stop, and lists of words
            t = re.sub("[.?!]", "", t) if r.random() < 0.5 else " ".join([words(1).split(" ")[0]] * r.randint(3, 30))
        elif r.random() < 0.15:
            t = t[: r.randint(8, 24)].strip() + "."
        if r.random() < 0.3:
            t = t.replace(" ", f' <a href="/x">{words(1)}</a> ', 1)
        if r.random() < 0.2:
            t = f"<b>{t}" + r.choice(["</b>", "<br>"])
        return r.choice([f"<p data-y=1>{t}</p>"] * 8 + [f"<p data-y=1>{t}", f"<h2 data-y=1>{words(3)}</h2>", f"<blockquote data-y=1><p data-y=1>{t}</p></blockquote>", f"<ul data-y=1><li data-y=1>{t}</li><li data-y=1>{words(4)}</li></ul>", f"<pre data-y=1>{t}</pre>", f"<table data-y=1><tr data-y=1><td data-y=1>{words(2)}</td><td data-y=1>{words(2)}</td></tr></table>", f"<figure data-y=1><img src=x><figcaption data-y=1>{t}</figcaption></figure>", f"<div data-y=1>{t}</div>", f"<section data-y=1><h3 data-y=1>{words(3)}</h3><p data-y=1>{t}</p></section>"])

    pages = []
    for _ in range(n):
        inside = "".join(block() for _ in range(r.choice([r.randint(1, 14), r.randint(3, 40)])))
        if r.random() < 0.8:
            inside = f"<h1 data-y=1>{words(6)}</h1>" + inside
        if r.random() < 0.35:
            at = inside.find("<p data-y=1>", len(inside) // 2)
            inside = inside[:at] + noise() + inside[at:] if at > 0 else inside + noise()
        style = r.random()
        if style < 0.55:
            main = f"<article data-y=1>{inside}</article>"
        elif style < 0.7:
            main = f"<main data-y=1>{inside}</main>"
        elif style < 0.9:
            main = f'<div {r.choice(["class", "id"])}="{r.choice(PARTS["body"].split())}{r.choice(["", "-body", " wide"])}" data-y=1>{inside}</div>'
        elif style < 0.93:
            main = inside
        else:  # bare text
            main = "<br><br>".join(r.choice([_sentences(r, r.randint(1, 5)), words(r.randint(1, 5))]) for _ in range(r.choice([1, r.randint(1, 6)])))
        top = r.choice([lambda: part("head", ["header", "header", "div"], f"<p data-y=0>{words(3)}</p>" + r.choice(["", links(4)])), lambda: "", lambda: f"<div data-y=0>{links(5)}</div>"])()
        menu = r.choice([lambda: part("menu", ["nav", "nav", "div"], links(r.randint(2, 7))), lambda: ""])()
        foot = r.choice([lambda: part("foot", ["footer", "footer", "div"], r.choice(["&copy; ", ""]) + words(3) + " " + plain(1)), lambda: ""])()
        mid = [main] + [noise() for _ in range(r.choice([0, 1, 1, 2, 3]))]
        if r.random() < 0.7:
            r.shuffle(mid)
        if r.random() < 0.3:
            mid = ["<div class=wrapper data-y=0>", *mid, "</div>"]
        pages.append("<html><body data-y=0 data-bare=1>" + top + menu + "".join(mid) + foot + "</body></html>")
    return pages


def fit(pages: list[str]) -> Model:
    """Local weights by logistic regression, potentials by counting, from labelled pages."""
    rows, ys, count = [], [], {k: [[1.0, 1.0], [1.0, 1.0]] for k in KINDS}
    prior = {k: [1.0, 1.0] for k in KINDS}
    kinds = []
    for page in pages:
        nodes = parse(page)
        for x in nodes[1:]:
            if x.y is None:
                continue
            rows.append(evidence(x, _tidy(x)))
            ys.append(x.y)
            kinds.append(kind(x))
            count[kind(x)][nodes[x.parent].y or 0][x.y] += 1
            prior[kind(x)][x.y] += 1
    names = sorted({f for r in rows for f in r})
    at = {f: i for i, f in enumerate(names)}
    x = np.zeros((len(rows), len(names) + 1))
    for i, fs in enumerate(rows):
        x[i, [at[f] for f in fs]] = 1
    x[:, -1] = 1
    y, w = np.array(ys, float), np.zeros(len(names) + 1)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (y - p) - w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    # the potentials hold the prior of the kind; divide it out, as local evidence has it too
    pair = {}
    for k, c in count.items():
        t = [[c[a][b] / sum(c[a]) / prior[k][b] * sum(prior[k]) for b in (0, 1)] for a in (0, 1)]
        pair[k] = tuple(tuple(v) for v in t)
    return Model(dict(zip(names, w[:-1].tolist())), float(w[-1]), pair)


def main_text(pages: DataFrame, model: Model | None = None, html: str = "html", out: str = "main_text") -> DataFrame:
    """``pages`` with the text of the article, empty if there is none."""
    if out.lower() in {c.lower() for c in pages.columns}:
        raise ValueError(f"rename the column {out} first")
    shared = pages.sparkSession.sparkContext.broadcast(model or fit(labelled_pages()))
    df = pages.withColumn(out, F.lit("").cast("string"))
    names, at = df.columns, df.columns.index(html)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [shared.value.extract(t) for t in batch.column(at).to_pylist()]
        return pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], names)

    return map_batches(df, run, df.schema, html)
