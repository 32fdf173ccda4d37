"""Main-text extraction by a tree-structured graphical model over the DOM.

Block elements are the nodes of a tree; each has a binary state, content or not. A node's own evidence (tag; words of class,
id and role and their parts; length, sentences, link share, share of the page, place and neighbours of its text) gives its unary potential; a potential for each kind of child couples it with its parent.
Sum-product messages from the leaves to the root and back give exact content marginals; the text of nodes above one half is the
main text. The weights are fitted by maximum likelihood on labelled pages, with expectations from the same messages.

The labelled pages are a bounded set of TRAIN_PAGES page layouts composed by labelled_page(): the usual furniture of web pages
(menus, banners, notices, adverts, sidebars, forms, reader comments, footers) around articles in semantic or plain markup.

Nulls and odd input: a null page is empty and has an empty text; unclosed and stray tags are mended as browsers do for the
common cases; a page without markup is one block of text; repeated rows are pages of their own; other columns are ignored; an
empty table gives an empty result. Texts are neither cut nor capped. Work is linear in the page, whatever its markup: quotes that
never end are read as characters, and once the quotes of a tag swallow the rest of a page, tags end at the next > instead.
"""

from __future__ import annotations

import functools
import html as html_lib
import math
import random
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, tidy

TRAIN_PAGES = 900
EPOCHS = 16

# Fixed values of HTML: elements by their role in the tree.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark output q s samp small span strike strong sub sup time tt u var wbr nobr object".split()) | frozenset(
    "math mi mn mo ms mtext mspace mrow mfrac msqrt mroot mstyle merror mpadded mphantom msub msup msubsup munder mover munderover mmultiscripts mprescripts mtable mtr mtd maction semantics annotation annotation-xml".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template svg iframe title textarea select canvas audio video head".split())
TO_THE_END = frozenset("script style textarea title iframe".split())  # without an end tag they hold the rest of the page
TEXTUAL = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd blockquote pre td th figcaption caption summary address".split())
FURNITURE = frozenset("nav aside header footer form article main dialog menu button fieldset".split())
CLOSES = {
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "td", "th"]), "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"]),
    "option": frozenset(["option"]), "tbody": frozenset(["thead", "tr", "td", "th"]), "tfoot": frozenset(["tbody", "tr", "td", "th"]),
}
SCOPES = frozenset("ul ol dl table div article section main body aside nav header footer form".split())
NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
STOP = re.compile(r"[>\"']")
LONG_NUMBER = re.compile(r"&#(?:0*([0-9]{8,})|[xX]0*([0-9a-fA-F]{7,}));?")
LEADING_ZEROS = re.compile(r"&#([xX]?)0{6,}(?=[0-9a-fA-F])")
ATTRIBUTE = re.compile(r"(?<![\w:.-])(class|id|role|data-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
WORD = re.compile(r"[^\W\d_]+")
HUMP = re.compile(r"(?<=[a-z])(?=[A-Z])")
RIGHTS = re.compile(r"©|\(c\)\s*\d|copyright|all rights reserved|alle rechte|tous droits|todos los derechos|tüm hakları", re.I)
CONSENT = re.compile(r"\bcookies?\b|\bgdpr\b|\bconsent\b|çerez", re.I)
PART = 4

# Fixed values of the training pages: names that page authors give to the parts of a page.
MENUS = ["menu", "nav", "navigation", "navbar", "main-menu", "nav-primary", "topnav", "hauptmenue", "ust-menu", "menu-principal", "barre-navigation"]
HEADERS = ["header", "top", "masthead", "site-header", "page-head", "branding", "kopfzeile", "ust-bolum", "entete", "cabecera", "logo-bar"]
NOTICES = ["cookie", "notice", "consent", "alert", "cookie notice", "popup", "gdpr", "privacy-banner", "modal", "overlay", "hinweis", "cerez-uyari", "aviso"]
ADVERTS = ["ad", "ads", "advert", "advertisement", "sponsored", "banner", "promo", "ad-slot", "werbung", "reklam", "publicite", "anuncio"]
SIDES = ["sidebar", "widget", "related", "rail", "side-column", "most-read", "trending", "seitenleiste", "yan-sutun", "colonne-laterale", "barra-lateral"]
COMMENTS = ["comments", "discussion", "comment list", "commentlist", "replies", "disqus", "respond", "reader-comments", "kommentare", "yorumlar", "commentaires", "comentarios", "thread"]
FOOTERS = ["footer", "site-footer", "colophon", "page-foot", "bottom", "fusszeile", "alt-bilgi", "pied-de-page", "pie-de-pagina", "legal", "imprint"]
BOXES = ["ad", "advert", "promo", "share", "related", "newsletter", "social", "signup", "teaser"]
SHELLS = ["content", "post", "entry", "article body", "main content", "story", "post text", "primary", "inhalt", "icerik", "contenu", "contenido", "site-main"]
NAMED = re.compile(r' (?:class|id)="[^"]*"')


class Scanner:
    """Finds the tags of a page in time linear in its length: what was searched for in vain is not searched for again."""

    def __init__(self, page: str):
        self.page = page
        self._next: dict[str, int] = {}
        self._quoted = True  # until a tag's quotes turn out to swallow the rest of the page

    def find(self, what: str, at: int) -> int:
        """Where what is next found, -1 if no more. Calls for the same string mostly ask for ascending places."""
        known = self._next.get(what)
        if known is None or (known != -1 and known < at):
            known = self._next[what] = self.page.find(what, at)
        return known if known == -1 or known >= at else self.page.find(what, at)

    def tag_end(self, at: int) -> int:
        """The place of the > that ends the tag whose name ends here, outside of quoted values if they end; -1 without any."""
        i = at
        while self._quoted and (m := STOP.search(self.page, i)):
            if m[0] == ">":
                return m.start()
            closing = self.find(m[0], m.end())
            i = m.end() if closing == -1 else closing + 1
        self._quoted = False
        return self.find(">", at)

    def ends(self, name: str) -> dict[int, int]:
        """Where the elements of that name end, by their start; those without an end tag are left out."""
        out, open_at = {}, []
        for m in re.finditer(rf"<(/?){name}(?=[\s/>])", self.page, re.I):
            end = self.find(">", m.end())
            if end == -1:
                break
            if not m[1]:
                if self.page[end - 1] != "/":
                    open_at.append(m.start())
            elif open_at:
                out[open_at.pop()] = end + 1
        return out


class Tree:
    """Nodes in page order, parents before children; segments are (node, raw text) in page order."""

    def __init__(self) -> None:
        self.parent: list[int] = [-1]
        self.tag: list[str] = ["body"]
        self.attrs: list[str] = [""]
        self.segments: list[tuple[int, str]] = []
        self.links: list[int] = [0]
        self.sizes: list[int] = [0]


class Stack:
    """The open elements. Their places by tag, and those that bound a scope, are kept beside, so that finding the one to close
    takes no walk."""

    def __init__(self) -> None:
        self.nodes, self.tags = [0], ["body"]
        self._places: dict[str, list[int]] = {}
        self._scopes: list[int] = []

    def push(self, node: int, tag: str) -> None:
        self._places.setdefault(tag, []).append(len(self.nodes))
        if tag in SCOPES:
            self._scopes.append(len(self.nodes))
        self.nodes.append(node)
        self.tags.append(tag)

    def cut(self, length: int) -> None:
        while len(self.nodes) > length:
            self.nodes.pop()
            tag = self.tags.pop()
            self._places[tag].pop()
            if tag in SCOPES:
                self._scopes.pop()

    def innermost(self, tags: frozenset[str]) -> int | None:
        """The place of the innermost open element of these tags."""
        return max((p[-1] for t in tags if (p := self._places.get(t))), default=None)

    def in_scope(self, place: int) -> bool:
        """No element further in bounds a scope."""
        return not self._scopes or self._scopes[-1] <= place


def parse(page: str) -> Tree:
    tree, scan, stack = Tree(), Scanner(page), Stack()
    text: list[str] = []
    in_link = False
    at, n = 0, len(page)
    ended: dict[str, dict[int, int]] = {}
    absent: set[str] = set()  # of these no end tag follows

    def put(piece: str) -> None:
        if piece:
            text.append(piece)
            size = 0 if piece.isspace() else len(piece)
            tree.sizes[stack.nodes[-1]] += size
            if in_link:
                tree.links[stack.nodes[-1]] += size

    def close_block() -> None:
        if text:
            tree.segments.append((stack.nodes[-1], "".join(text)))
            text.clear()

    def after(name: str, at: int) -> int | None:
        """Behind the end tag of that name."""
        if name in absent:
            return None
        m = re.compile(rf"</{name}\b", re.I).search(page, at)
        end = scan.find(">", m.end()) if m else -1
        if end == -1:
            absent.add(name)
            return None
        return end + 1

    while at < n:
        start = page.find("<", at)
        if start == -1:
            put(page[at:])
            break
        put(page[at:start])
        if page.startswith("<!--", start):
            end = scan.find("-->", start + 4)
            at = n if end == -1 else end + 3
            continue
        m = NAME.match(page, start + 1)
        if m is None:
            end = scan.find(">", start) if page[start + 1 : start + 2] in ("!", "?") else -1
            at = start + 1 if end == -1 else end + 1
            if end == -1:
                put("<")
            continue
        end = scan.tag_end(m.end())
        if end == -1:  # no tag ends any more
            put(page[start:])
            break
        name, closing, attrs, at = m[2].lower(), bool(m[1]), page[m.end() : end], end + 1
        if name in RAW and not closing:
            if attrs.endswith("/"):
                continue
            if name not in TO_THE_END and name != "head":
                if name not in ended:
                    ended[name] = scan.ends(name)
                at = ended[name].get(start, at)
                continue
            past = after(name, at)
            if name == "head" and past is None and "<body" not in absent:
                found = re.compile(r"<body\b", re.I).search(page, at)
                if found:
                    past = found.start()
                else:
                    absent.add("<body")
            at = past if past is not None else at if name == "head" else n
        elif name in ("br", "hr"):
            put(" ")
        elif name == "a":
            in_link = not closing
        elif name in INLINE or name in VOID or name in RAW:
            continue
        elif name in ("html", "body"):
            if not closing and attrs and name == "body":
                tree.attrs[0] = attrs
        elif closing:
            place = stack.innermost(frozenset((name,)))
            if place is not None and (name in SCOPES or stack.in_scope(place)):
                close_block()
                stack.cut(place)
        else:
            close_block()
            if stack.tags[-1] == "p":
                stack.cut(len(stack.nodes) - 1)
            if name in CLOSES:
                place = stack.innermost(CLOSES[name])
                if place is not None and stack.in_scope(place):
                    stack.cut(place)
            tree.parent.append(stack.nodes[-1])
            tree.tag.append(name)
            tree.attrs.append(attrs)
            tree.links.append(0)
            tree.sizes.append(0)
            stack.push(len(tree.tag) - 1, name)
            in_link = False
    close_block()
    return tree


def unescaped(text: str) -> str:
    """Character references decoded; numbers beyond any character, of whatever length, are the replacement character."""
    if "&#" in text:
        text = LONG_NUMBER.sub("\ufffd", LEADING_ZEROS.sub(r"&#\1", text))
    return html_lib.unescape(text)


def kind(tag: str) -> int:
    return 0 if tag in TEXTUAL else 1 if tag in FURNITURE else 2


def marks(tag: str, attrs: str) -> tuple[str, ...]:
    """Feature names of an element itself."""
    return _short_marks(tag, attrs) if len(attrs) <= 300 else _marks(tag, attrs)


def _marks(tag: str, attrs: str) -> tuple[str, ...]:
    out = [f"tag={tag}"]
    for m in ATTRIBUTE.finditer(attrs):
        if m[1].lower() != "data-label":
            for w in WORD.findall(HUMP.sub(" ", m[2] or m[3] or m[4] or "").lower()):
                out.append(f"word={w}")
                out += [f"part={w[i : i + PART]}" for i in range(len(w) - PART + 1)]
    return tuple(dict.fromkeys(out))


_short_marks = functools.lru_cache(20_000)(_marks)


def _bin(x: float, *edges: float) -> int:
    return sum(x >= e for e in edges)


def measures(tree: Tree) -> list[list[str]]:
    """Features of each node from its text, its subtree and its place: link share, length, sentences, share of the page, neighbours of its
    tag, words of notices of rights and consent. Names play no part in them."""
    n = len(tree.tag)
    whole, linked, stops, start, says = tree.sizes[:], tree.links[:], [0] * n, [-1] * n, [""] * n
    done = 0
    for v, t in tree.segments:
        start[v] = done if start[v] < 0 else start[v]
        done += 0 if t.isspace() else len(t)
        stops[v] += t.count(".") + t.count("!") + t.count("?")
        if len(t) < 400:
            says[v] = "rights" if RIGHTS.search(t) else "consent" if CONSENT.search(t) else says[v]
    alike: dict[tuple[int, str], int] = {}
    for v in range(n - 1, 0, -1):
        p = tree.parent[v]
        whole[p] += whole[v]
        linked[p] += linked[v]
        if start[v] >= 0 and (start[p] < 0 or start[v] < start[p]):
            start[p] = start[v]
        if whole[v]:
            alike[p, tree.tag[v]] = alike.get((p, tree.tag[v]), 0) + 1
    total = max(1, done)
    out = []
    for v in range(n):
        size, tag = tree.sizes[v], tree.tag[v]
        own = [f"whole={_bin(whole[v] / total, 0.02, 0.1, 0.3, 0.6, 0.9)}", f"all links={_bin(linked[v] / max(1, whole[v]), 0.05, 0.3, 0.6, 0.9)}", f"at={_bin(max(0, start[v]) / total, 0.03, 0.15, 0.85, 0.97)}"]
        if not size:
            own.append("text=0")
        else:
            share = _bin(tree.links[v] / size, 0.05, 0.5)
            long = _bin(size, 20, 60, 150, 400)
            own += [f"links={share}", f"size={long}", f"stops={_bin(stops[v], 1, 3)}", f"{tag} size={long}", f"alike={_bin(alike.get((tree.parent[v], tag), 0), 2, 4)}"]
        if says[v]:
            own.append(f"says={says[v]}")
        out.append(own)
    return out


def features(tree: Tree) -> list[tuple[str, ...]]:
    return [(*marks(t, a), *m) for t, a, m in zip(tree.tag, tree.attrs, measures(tree), strict=True)]


def _log_add(a: float, b: float) -> float:
    return max(a, b) + math.log1p(math.exp(-abs(a - b)))


class Model:
    """weights: unary weight of each feature for the content state; edges: [kind][parent state][child state]."""

    def __init__(self) -> None:
        self.weights: dict[str, float] = {}
        self.edges = [[[0.0, 0.0], [0.0, 0.0]] for _ in range(3)]

    def unary(self, tree: Tree, of: list[tuple[str, ...]] | None = None) -> list[float]:
        get = self.weights.get
        return [sum(get(x, 0.0) for x in own) for own in of or features(tree)]

    def messages(self, tree: Tree, of: list[tuple[str, ...]] | None = None) -> tuple[list[float], list[float], list[float]]:
        """Log-odds of content of each node: from its subtree, from all the page, and of its parent without this node. of: features()."""
        up = self.unary(tree, of)
        kinds = [kind(t) for t in tree.tag]
        sent = [0.0] * len(up)
        for v in range(len(up) - 1, 0, -1):
            (e00, e01), (e10, e11) = self.edges[kinds[v]]
            sent[v] = _log_add(e10, e11 + up[v]) - _log_add(e00, e01 + up[v])
            up[tree.parent[v]] += sent[v]
        total, cavity = up[:], [0.0] * len(up)
        for v in range(1, len(up)):
            (e00, e01), (e10, e11) = self.edges[kinds[v]]
            c = cavity[v] = total[tree.parent[v]] - sent[v]
            total[v] = up[v] + _log_add(e01, e11 + c) - _log_add(e00, e10 + c)
        return up, total, cavity

    def marginals(self, tree: Tree) -> list[float]:
        return [1 / (1 + math.exp(-max(-50.0, min(50.0, t)))) for t in self.messages(tree)[1]]

    def extract(self, page: str | None) -> str:
        """Blocks of content nodes in page order, white space and references resolved, joined by one space."""
        if not page:
            return ""
        tree = parse(page)
        p = self.marginals(tree)
        blocks = (" ".join(unescaped(t).split()) for v, t in tree.segments if p[v] > 0.5)
        return " ".join(b for b in blocks if b)


def labelled_page(rng: random.Random) -> str:
    """A page whose content elements bear data-label="1". Two in five have no names at all."""
    nameless = rng.random() < 0.4

    def words(lo: int, hi: int) -> str:
        return " ".join("".join(rng.choice(["an", "re", "th", "on", "el", "ti", "mo", "ve"]) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(lo, hi)))

    links = lambda n, most=3: "".join(f'<li><a href="/{i}">{words(1 if most < 4 else 3, most)}</a></li>' for i in range(n))
    pick = rng.choice
    lab = ' data-label="1"'
    odd = lambda: pick(["", "", f' class="{words(1, 2)}"', f' id="{words(1, 1)}"'])  # noqa: E731  names that say nothing

    def para() -> str:
        body = words(1, pick([2, 4, 20, 60, 150])) + "."
        r = rng.random()
        if r < 0.07:
            return f'<div class="{pick(["", "article-", "story-"])}{pick(BOXES)}-{words(1, 2).replace(" ", "-")}"{lab}>{words(12, 60)}. {words(5, 20)}.</div>'  # a name that misleads
        if r < 0.1:
            body += pick([" Copyright ", " The cookies ", " Consent "]) + words(12, 40) + "."
        elif r < 0.16:
            body = f"<b>{words(3, 12)}</b> {body}"
        elif r < 0.25:
            body += f' <a href="/x">{words(1, 3)}</a> {words(2, 9)}.'
        return f"<p{lab}>{body}" + pick(["</p>", "</p>", ""])

    def article() -> str:
        head = pick(["h1", "h1", "h1", "h2", "p"])
        out = [f"<{head}{lab}>{words(1, 12)}</{head}>"]
        if rng.random() < 0.2:
            out.append(f"<div{odd()}{lab}>{words(2, 6)}</div>")
        if rng.random() < 0.25:
            out[0] = f"<header{lab}>{out[0]}</header>"
        for _ in range(rng.randint(1, 12) if (many := rng.random()) < 0.94 else rng.randint(40, 160) if many < 0.97 else rng.randint(200, 600)):
            r = rng.random()
            if r < 0.72:
                out.append(para())
            elif r < 0.8:
                part = pick(["h2", "h2", "h3", "h4"])
                out.append(f"<{part}{lab}>{words(1, 6)}</{part}>")
            elif r < 0.86:
                out.append(f"<ul{lab}>" + "".join(f"<li{lab}>{words(2, 20)}</li>" for _ in range(rng.randint(2, 5))) + "</ul>")
            elif r < 0.9:
                out.append(f"<blockquote{lab}><p{lab}>{words(5, 30)}</p></blockquote>")
            elif r < 0.93:
                out.append(f"<table{lab}><tr{lab}><td{lab}>{words(1, 4)}</td><td{lab}>{words(1, 4)}</td></tr></table>")
            elif r < 0.96 and not nameless:
                out.append(f'<div class="{pick(BOXES)}">{words(2, 12)}</div>')
            else:
                out.append(pick([f"<pre{lab}>{words(4, 12)}</pre>", f"<figure{lab}><img src=x><figcaption{lab}>{words(2, 9)}</figcaption></figure>"]))
        if rng.random() < 0.12:  # linked sources
            out.append(f"<h2{lab}>{words(1, 2)}</h2><ul{lab}>" + "".join(f'<li{lab}><a href="/s">{words(3, 12)}</a></li>' for _ in range(rng.randint(2, 6))) + "</ul>")
        if rng.random() < 0.1:  # a part of the article under a name that misleads
            out.append(f'<section class="{pick(BOXES)} {words(1, 1)}"{lab}><h2{lab}>{words(1, 4)}</h2><p{lab}>{words(12, 60)}.</p></section>')
        if rng.random() < 0.3:  # parts of an article stand in boxes of their own
            cuts = sorted(rng.sample(range(len(out) + 1), min(len(out) + 1, rng.randint(1, 3))))
            for a, b in zip([0, *cuts], [*cuts, len(out)], strict=True):
                if a < b and rng.random() < 0.8:
                    box = pick(["section", "div", "div"])
                    out[a], out[b - 1] = f"<{box}{odd()}{lab}>{out[a]}", f"{out[b - 1]}</{box}>"
        return "".join(out)

    shell = pick(["article", "article", "article", "main", "div", "section"])
    name = "" if shell in ("article", "main") and rng.random() < 0.7 else f' {pick(["class", "class", "id"])}="{pick(SHELLS)}"'
    core = f"<{shell}{name}{lab}>{article()}</{shell}>"
    if rng.random() < 0.3:
        core = f"<main{lab}>{core}</main>" if rng.random() < 0.5 else f'<div id="{pick(["content", "main", "page"])}"{lab}>{core}</div>'
    elif rng.random() < 0.25:
        core = f"<main{lab}><div{odd()}{lab}><div{odd()}{lab}>{article()}</div></div></main>"
    before, after, inside = [], [], []
    if rng.random() < 0.8:
        before.append(pick([f"<nav><ul>{links(rng.randint(3, 8))}</ul></nav>", f'<div class="{pick(MENUS)}"><ul>{links(5)}</ul></div>', f'<ul class="menu">{links(4)}</ul>', f'<div role="navigation">{links(4)}</div>']))
    if rng.random() < 0.5:
        before.insert(0, pick([f"<header><h2>{words(1, 3)}</h2><p>{words(2, 8)}</p></header>", f"<header><p>{words(1, 4)}</p></header>", f'<div {pick(["class", "id"])}="{pick(HEADERS)}"><p>{words(2, 6)}</p>{pick(["", f"<p>{words(2, 6)}</p>"])}</div>', f'<div class="{pick(HEADERS)}"><p>{words(2, 6)}</p></div>', f'<div role="banner">{words(2, 8)}</div>']))
    if rng.random() < 0.3:
        bar = " ".join(f'<a href="/{i}">{words(1, 2)}</a>' for i in range(rng.randint(2, 7)))
        pick([before, after]).insert(0, pick([f"<div{odd()}>{bar}</div>", f"<div{odd()}><ul>{links(4)}</ul></div>"]))
    if rng.random() < 0.6:
        before.append(f'<div class="{pick(ADVERTS)}">{words(3, 15)}.</div>')
    if rng.random() < 0.35:
        before.append(f'<div {pick(["class", "class", "id"])}="{pick(NOTICES)}{pick(["", "-bar", "-box"])}"><p>{pick(["", "We use cookies. ", "Your consent: "])}{words(5, 30)}.</p>{pick(["", "<button>OK</button>"])}</div>')
    if rng.random() < 0.3:
        before.append(f'<div class="breadcrumb">{words(2, 5)}</div>')
    if rng.random() < 0.45:
        side = f"<h3>{words(1, 3)}</h3>{pick([f"<p>{words(5, 40)}.</p>", ""])}<ul>{links(rng.randint(2, 6), pick([3, 8, 12]))}</ul>"
        (before if rng.random() < 0.4 else after).append(pick([f"<aside>{side}</aside>", f'<div class="{pick(SIDES)}">{side}</div>', f'<div role="complementary">{side}</div>']))
    if rng.random() < 0.4:
        own = pick(["comment", "reply", "depth", "", ""])
        reply = "".join(f'<{(box := pick(["div", "div", "li", "article" if own and not nameless else "li", "div"]))}{f' class="{own}"' if own else ""}><p>{words(1, 60)}.</p></{box}>' for _ in range(rng.randint(1, 4)))
        (inside if rng.random() < 0.3 and not nameless else after).append(f'<{(out := pick(["section", "div"]))} {pick(["class", "id"])}="{pick(COMMENTS)}">{pick([f"<h3>{words(1, 3)}</h3>", ""])}{pick(["<ol>", ""]) if own == "depth" else ""}{reply}</{out}>')
    if rng.random() < 0.4:
        after.append(f'<form class="{pick(["search", "subscribe", "contact", ""])}"><p>{words(2, 10)}</p><label>{words(1, 3)}</label><button>{words(1, 1)}</button></form>')
    if rng.random() < 0.85:
        rights = pick(["", "", "Copyright 2020 ", "© 2019 ", "All rights reserved. "])
        box = pick([f'{pick(["class", "id"])}="{pick(FOOTERS)}"', f'class="{words(1, 1)}"' if rights else 'class="footer"'])
        after.append(pick([f"<footer>{rights}{words(3, 20)}.</footer>", f"<footer><p>{rights}{words(3, 20)}</p><ul>{links(3)}</ul></footer>", f"<div {box}><p>{rights}{words(2, 20)}</p></div>", f'<div role="contentinfo">{words(3, 9)}</div>']))
    if inside and core.endswith("</main>"):
        core = core[:-7] + "".join(inside) + "</main>"
    else:
        after = inside + after
    body = f"<body>{''.join(before)}{core}{''.join(after)}</body>"
    return f"<html><head><title>{words(2, 6)}</title></head>{NAMED.sub('', body) if nameless else body}</html>"


@functools.lru_cache(1)
def train(pages: int = TRAIN_PAGES, epochs: int = EPOCHS, rate: float = 0.1, ridge: float = 5e-4, seed: int = 11) -> Model:
    """Maximum likelihood by gradient steps page by page: observed minus expected features and edges."""
    rng = random.Random(seed)
    trees = [parse(labelled_page(rng)) for _ in range(pages)]
    labels = [[int("data-label" in a or v == 0) for v, a in enumerate(t.attrs)] for t in trees]
    of = [features(t) for t in trees]
    model = Model()
    for epoch in range(epochs):
        step = rate / (1 + 0.3 * epoch)
        for i in rng.sample(range(pages), pages):
            tree, y = trees[i], labels[i]
            up, total, cavity = model.messages(tree, of[i])
            for v in range(len(y)):
                gap = y[v] - 1 / (1 + math.exp(-max(-50.0, min(50.0, total[v]))))
                if abs(gap) > 1e-3:
                    for x in of[i][v]:
                        old = model.weights.get(x, 0.0)
                        model.weights[x] = old + step * (gap - ridge * old)
                if v:
                    e = model.edges[kind(tree.tag[v])]
                    raw = [[e[a][b] + a * cavity[v] + b * up[v] for b in (0, 1)] for a in (0, 1)]
                    top = max(map(max, raw))
                    raw = [[math.exp(x - top) for x in row] for row in raw]
                    whole = sum(map(sum, raw))
                    for a in (0, 1):
                        for b in (0, 1):
                            seen = float(y[tree.parent[v]] == a and y[v] == b)
                            e[a][b] += 0.2 * step * (seen - raw[a][b] / whole - ridge * e[a][b])
    return model


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id_col, url_col, text string, n_chars long of every row."""
    model = pages.sparkSession.sparkContext.broadcast(train())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            texts = [m.extract(x) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [id_col, url_col, "text", "n_chars"])

    kind_of = pages.schema[id_col].dataType.simpleString()
    rows = pages.select(F.col(id_col), F.col(url_col).cast("string"), F.col(html_col).cast("string").alias("html"))
    return small_batches(rows).mapInArrow(tidy(run), f"`{id_col}` {kind_of}, `{url_col}` string, text string, n_chars long")
