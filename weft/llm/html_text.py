"""Main text of HTML pages: boosted trees over DOM-node features with hierarchical decoding."""

from __future__ import annotations

import html
import random
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm.common import LOT, lots
from weft.llm.trees import BoostedTrees

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*'|["'])*?)(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/>"']+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""")
_TOKENS = re.compile(r"[a-z]+")
#: Fixed values of HTML: elements without content, with content that is no text, and within a line.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NO_TEXT = frozenset("script style noscript template title textarea iframe".split())
RAW = frozenset("script style title textarea iframe noscript".split())
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var math svg object canvas".split())
#: Elements in which all others are within the line as well.
GRAPHIC = ("math", "svg")
#: An element that starts closes open ones of these names up to the nearest container.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "tbody": ("tr", "td", "th", "thead", "tbody")}
CONTAINER = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table",), "th": ("table",), "option": ("select",), "tbody": ("table",)}
#: Buckets that tokens of class, id, role and itemprop attributes, and names of elements, are hashed to.
BUCKETS = 1 << 12
TAGS = "article main section div p h1 h2 h3 ul ol li table tr td form nav header footer aside blockquote pre figure figcaption body button".split()
_TAG_OF = {t: k for k, t in enumerate(TAGS)}


class Node:
    __slots__ = ("attributes", "children", "depth", "link", "parent", "parts", "tag", "text")

    def __init__(self, tag: str, attributes: str, parent: Node | None):
        self.tag, self.attributes, self.parent = tag, attributes, parent
        self.depth = parent.depth + 1 if parent else 0
        self.children: list[Node] = []  # block elements
        self.parts: list[object] = []  # str, or a block element, in page order
        self.text = self.link = 0


def parse(page: str) -> Node:
    """The tree of block elements. Text in no block element, but in inline ones, belongs to the block around it."""
    root = Node("body", "", None)
    stack: list[tuple[str, Node]] = [("body", root)]  # open elements, each with the block that its text goes to
    places: dict[str, list[int]] = {}  # of each name, those of the stack, so that no step looks through it
    silent: str | None = None
    at = 0

    def put(text: str) -> None:
        if text and silent is None:
            block = stack[-1][1]
            block.parts.append(text)
            n = len(text.strip())
            block.text += n
            if places.get("a"):
                block.link += n

    def open_(name: str, block: Node) -> None:
        places.setdefault(name, []).append(len(stack))
        stack.append((name, block))

    def close(index: int) -> None:
        while len(stack) > index:
            places[stack.pop()[0]].pop()

    def last(names: tuple[str, ...]) -> int:
        return max((places[n][-1] for n in names if places.get(n)), default=0)

    while at < len(page):
        m = _TOKEN.search(page, at)
        if m is None:
            put(page[at:])
            break
        put(page[at : m.start()])
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if m[1]:
            if silent is not None:
                silent = None if name == silent else silent
            elif places.get(name):
                close(places[name][-1])
            continue
        if silent is not None:
            continue
        if name in NO_TEXT:
            if name in RAW:
                end = re.compile(rf"</{name}\s*>", re.I).search(page, at)
                at = end.end() if end else len(page)
            elif not m[3].rstrip().endswith("/"):
                silent = name
            continue
        if name in ("html", "head", "body"):  # whose tags may be left out; what may stand in a head has no text
            root.attributes += m[3] if name == "body" else ""
            continue
        if name in VOID:
            put(" ")
            continue
        if name in INLINE or any(places.get(g) for g in GRAPHIC):
            open_(name, stack[-1][1])
            continue
        for closed, stop in ((CLOSES.get(name, ()), CONTAINER.get(name, ())), (("p",), ("td", "th", "button", "body"))):
            if last(closed) > last(stop):
                close(last(closed))
        parent = stack[-1][1]
        node = Node(name, m[3], parent)
        parent.children.append(node)
        parent.parts.append(node)
        open_(name, node)
    return root


def _listed(root: Node) -> list[Node]:
    """All nodes, parents before children, in page order."""
    out, todo = [], [root]
    while todo:
        n = todo.pop()
        out.append(n)
        todo.extend(reversed(n.children))
    return out


_END = re.compile(r"[.!?…。](?:\s|$)")
#: What the tokens of a node, and those above it, say: their sum, the least and the greatest.
N_TOKENS = 6
N_FEATURES = len(TAGS) + N_TOKENS + 20


def tokens(node: Node) -> list[int]:
    """Buckets of the distinct tokens of a node's attributes, and of its name."""
    found = {f"<{node.tag}>"}
    for key, a, b, c in _ATTRIBUTE.findall(node.attributes) if node.attributes else ():
        if key.lower() in ("class", "id", "role", "itemprop"):
            found.update(_TOKENS.findall((a or b or c).lower()))
    return sorted({zlib.crc32(w.encode()) % BUCKETS for w in found})


def token_weights(pages: list[list[list[int]]], labels: list[np.ndarray], prior: float = 4.0) -> np.ndarray:
    """How much more likely a node of each bucket is to be kept, as log odds that rare tokens hardly move."""
    n = np.zeros((2, BUCKETS))
    for page, y in zip(pages, labels, strict=True):
        for buckets, keep in zip(page, y, strict=True):
            n[int(keep), buckets] += 1
    share = sum(float(y.sum()) for y in labels) / max(sum(map(len, labels)), 1)
    return np.log((n[1] + prior * share) / (n[0] + prior * (1 - share))) - np.log(max(share, 1e-6) / max(1 - share, 1e-6))


def features(nodes: list[Node], weights: np.ndarray) -> np.ndarray:
    """A row for each node of one page: name, what the tokens of itself and above say, subtree densities, depth, siblings."""
    index = {id(n): i for i, n in enumerate(nodes)}
    n = len(nodes)
    own = np.zeros((n, 7))  # characters, linked ones, sentence ends, capitals, digits, text runs, signs
    for i, x in enumerate(nodes):
        text = "".join(p for p in x.parts if isinstance(p, str))
        own[i] = (x.text, x.link, len(_END.findall(text)), sum(map(str.isupper, text)), sum(map(str.isdigit, text)), any(isinstance(p, str) and p.strip() for p in x.parts), ("©" in text) + ("&copy" in text) + text.count("|") + text.count("·"))
    sub = own.copy()
    tags, paragraphs, items, longest = np.ones(n), np.zeros(n), np.zeros(n), own[:, 0].copy()
    for i in range(n - 1, 0, -1):
        j = index[id(nodes[i].parent)]
        sub[j] += sub[i]
        tags[j] += tags[i]
        paragraphs[j] += paragraphs[i] + (nodes[i].tag == "p")
        items[j] += items[i] + (nodes[i].tag == "li")
        longest[j] = max(longest[j], longest[i])
    before = np.concatenate(([0], np.cumsum(own[:, 0])[:-1]))
    total = max(sub[0, 0], 1)
    out = np.zeros((n, N_FEATURES))
    said = np.zeros((n, N_TOKENS))
    for i, x in enumerate(nodes):
        if x.tag in _TAG_OF:
            out[i, _TAG_OF[x.tag]] = 1
        w = weights[tokens(x)]
        said[i, :3] = w.sum(), w.min(), w.max()
        if i:
            j = index[id(x.parent)]
            said[i, 3:] = said[j, 3] + said[j, 0], min(said[j, 4], said[j, 1]), max(said[j, 5], said[j, 2])
    k = len(TAGS)
    out[:, k : k + N_TOKENS] = said
    k += N_TOKENS
    size = np.maximum(sub[:, 0], 1)
    sibling = np.zeros((n, 4))
    for x in nodes:
        same: dict[str, int] = {}
        for c in x.children:
            same[c.tag] = same.get(c.tag, 0) + 1
        for place, c in enumerate(x.children):
            i = index[id(c)]
            sibling[i] = (len(x.children), place / len(x.children), same[c.tag] / len(x.children), sub[i, 0] / max(sub[index[id(x)], 0], 1))
    out[:, k : k + 20] = np.stack(
        [
            np.log1p(sub[:, 0]), np.log1p(own[:, 0]), sub[:, 1] / size, sub[:, 2] / size * 100, tags / size * 100, sub[:, 3] / size, sub[:, 4] / size, np.log1p(longest),
            sub[:, 0] / total, before / total, [x.depth for x in nodes], paragraphs, items, sub[:, 5], sub[:, 6], np.log1p(sub[:, 0] / np.maximum(sub[:, 5], 1)), *sibling.T,
        ],
        axis=1,
    )
    return out


def decode(nodes: list[Node], logits: np.ndarray) -> set[int]:
    """Ids of the nodes kept, the set of greatest sum of log odds in which a node is kept only with its parent."""
    index = {id(n): i for i, n in enumerate(nodes)}
    kept = logits.astype(float).copy()
    dropped = -logits.astype(float)
    for i in range(len(nodes) - 1, 0, -1):
        j = index[id(nodes[i].parent)]
        kept[j] += max(kept[i], dropped[i])
        dropped[j] += dropped[i]
    out: set[int] = set()
    for i, x in enumerate(nodes):
        if kept[i] > dropped[i] and (i == 0 or id(x.parent) in out):
            out.add(id(x))
    return out


def blocks(root: Node, kept: set[int]) -> list[str]:
    """Texts of kept blocks in page order: character references decoded, white space single, empty ones left out."""
    out: list[str] = []
    todo: list[object] = [root] if id(root) in kept else []
    run: list[str] = []

    def flush() -> None:
        if run and (text := " ".join(html.unescape("".join(run)).split())):
            out.append(text)
        run.clear()

    while todo:
        x = todo.pop()
        if isinstance(x, str):
            run.append(x)
        elif x is None:
            flush()
        else:
            flush()
            todo.append(None)
            todo.extend(p for p in reversed(x.parts) if isinstance(p, str) or id(p) in kept or todo.append(None))
    return out


# Training pages -----------------------------------------------------------------


#: Words that the invented pages have in their attributes, by what they stand at; one in twelve elements has those of something else.
WORDS = {
    "main": "article main content post entry story body text hentry prose page".split(),
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs pagination pager toolbar tabs toc skip".split(),
    "edge": "header footer masthead topbar bottom foot head copyright legal colophon".split(),
    "side": "aside sidebar side widget rail related recommended more trending popular also".split(),
    "advert": "ad ads advert advertisement sponsor sponsored promo banner adsense outbrain".split(),
    "notice": "cookie cookies consent gdpr notice alert modal popup overlay subscribe newsletter signup paywall".split(),
    "talk": "comment comments disqus reply replies discussion respond reviews thread".split(),
    "share": "share social sharing follow twitter facebook tags meta byline author".split(),
    "form": "form search login input contact".split(),
}


class _Writer:
    """Invented pages whose nodes are known to be main text or not."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)
        letters = "aeiou" * 4 + "bcdfghjklmnpqrstvwxyzäéñüß"
        self.words = ["".join(self.r.choice(letters) for _ in range(self.r.randint(1, 9))) for _ in range(400)]

    def sentence(self, low: int = 4, high: int = 22) -> str:
        r = self.r
        w = [r.choice(self.words) for _ in range(r.randint(low, high))]
        odd = r.random()
        if odd < 0.05:  # signs anywhere, as in lists, tables, code and shouting
            sign = r.choice("*#!%$=|/+~_:;&^")
            w = [x + sign * r.randint(1, 3) if r.random() < 0.8 else x for x in w]
        elif odd < 0.08:
            w = [x.upper() for x in w]
        elif odd < 0.12:
            return r.choice((" | ", " / ", " - ", ", ")).join(w) + r.choice(("", ".", " |"))
        elif odd < 0.14:
            return f'{w[0]} {r.choice(("=", ":", "<-"))} "{r.getrandbits(r.choice((40, 160))):x}"{r.choice(("", ";"))}'
        return " ".join(w).capitalize() + r.choice(".....!?")

    def heading(self) -> str:
        """A few words or a sentence; like the titles of many sites it may be cut off, without a full stop, or begin the text."""
        whole = self.sentence(1, self.r.choice((3, 9, 25)))
        return self.r.choice((whole, whole[:-1], whole[: self.r.randint(20, 80)]))

    def text(self, n: int) -> str:
        return " ".join(self.sentence() for _ in range(n))

    def attributes(self, *groups: str, chance: float = 0.8) -> str:
        if self.r.random() > chance or not groups:
            return f' class="{self.r.choice(self.words)}"' if self.r.random() < 0.3 else ""
        if self.r.random() < 1 / 12:
            groups = (self.r.choice(sorted(WORDS)),)
        w = "-".join(self.r.choice((*WORDS[g], *self.r.sample(self.words, 2))) if self.r.random() < 0.15 else self.r.choice(WORDS[g]) for g in groups[: self.r.randint(1, len(groups))])
        return f' {self.r.choice(("class", "class", "id"))}="{w}{self.r.choice(("", "", " " + self.r.choice(self.words), "-box"))}"'

    def links(self, low: int, high: int) -> str:
        items = [f'<a href="/{self.r.choice(self.words)}">{" ".join(self.r.choice(self.words) for _ in range(self.r.randint(1, 4)))}</a>' for _ in range(self.r.randint(low, high))]
        if self.r.random() < 0.6:
            return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>"
        return self.r.choice((" | ", " ", " &middot; ")).join(items)

    def noise(self) -> str:
        r = self.r
        kind = r.randrange(9)
        if kind == 0:
            return f"<nav{self.attributes('menu', chance=0.4)}>{self.links(2, 9)}</nav>"
        if kind == 1:
            return f"<div{self.attributes('menu')}>{self.links(3, 9)}</div>"
        if kind == 2:
            return f"<div{self.attributes('advert', chance=1)}>{self.text(r.randint(1, 3))}</div>"
        if kind == 3:
            inner = f"<h3>{self.heading()}</h3>" + r.choice((self.links(2, 7), f"<p>{self.text(r.randint(1, 3))}</p>"))
            return r.choice((f"<aside{self.attributes('side')}>{inner}</aside>", f"<div{self.attributes('side', chance=1)}>{inner}</div>"))
        if kind == 4:
            inner = r.choice(("<p>{}</p>", "{}")).format(self.text(r.randint(1, 3)))
            return f"<div{self.attributes('notice', chance=1)}>{inner}{r.choice(('', '<button>Ok</button>'))}</div>"
        if kind == 5:
            return f"<form{self.attributes('form', 'notice')}><label>{self.sentence(1, 4)}</label><input name='q'><p>{self.sentence(2, 8)}</p><button>{self.r.choice(self.words)}</button></form>"
        if kind == 6:
            talk = "".join(f"<{t}{self.attributes('talk', chance=0.6)}><p>{self.text(r.randint(1, 4))}</p></{t}>" for t in [r.choice(("div", "li"))] for _ in range(r.randint(1, 5)))
            t = r.choice(("div", "section", "ol"))
            return f"<{t}{self.attributes('talk', chance=1)}>{talk}</{t}>"
        if kind == 7:
            return f"<div{self.attributes('share', chance=1)}>{self.links(1, 4)}</div>"
        return f"<header{self.attributes('edge')}>{r.choice(('', f'<h1>{self.heading()}</h1>', f'<p>{self.sentence(2, 8)}</p>'))}{self.links(1, 6)}</header>"

    def article(self) -> str:
        r = self.r
        out = [f"<{t}>{self.heading()}</{t}>" for t in [r.choice(("h1", "h1", "h2"))] if r.random() < 0.85]
        for _ in range(r.choice((1, 1, 2, 3, 5, 8, 14))):
            kind = r.random()
            body = self.text(r.choice((1, 1, 2, 3, 6)))
            if kind < 0.6:
                out.append(f"<p>{body}</p>")
            elif kind < 0.75:
                out.append(f"<p><b>{body}<br>")
            elif kind < 0.8:
                out.append(f"<h2>{self.heading()}</h2><p>{body}</p>")
            elif kind < 0.85:
                out.append("<ul>" + "".join(f"<li>{self.sentence(2, 12)}</li>" for _ in range(r.randint(2, 5))) + "</ul>")
            elif kind < 0.89:
                out.append(f"<blockquote><p>{body}</p></blockquote>")
            elif kind < 0.92:
                out.append("<table>" + "".join(f"<tr><td>{self.sentence(1, 4)}</td><td>{self.sentence(1, 4)}</td></tr>" for _ in range(r.randint(2, 4))) + "</table>")
            elif kind < 0.96:
                out.append(f"<p>{r.choice(self.words)} <a href='/x'>{self.sentence(1, 3)}</a> {body}</p>")
            else:
                out.append(f"<pre>{body}</pre>")
        return "".join(out)

    def page(self) -> tuple[str, str]:
        """A page, and the mark that stands in the attributes of nodes that belong to the main text or are around it."""
        r, mark = self.r, "weft-kept"
        tagged = re.sub(r"<(h\d|p|ul|li|blockquote|table|tr|td|pre)>", rf"<\1 data-k='{mark}'>", self.article())
        if r.random() < 0.35:
            at = [m.start() for m in re.finditer(r"<(?:p|h2|ul|blockquote)\b", tagged)]
            at = at[r.randrange(len(at))] if at else 0
            open_list = tagged[:at].count("<ul") > tagged[:at].count("</ul") or tagged[:at].count("<blockquote") > tagged[:at].count("</blockquote")
            tagged = tagged if open_list else tagged[:at] + self.noise() + tagged[at:]
        if r.random() < 0.25:  # no container: blocks that stand by themselves, or each in an element of its own
            parts = re.split(r"(?=<(?:h1|h2|p|ul|blockquote|table|pre) data-k)", tagged) if "<ul" not in tagged and "<blockquote" not in tagged and "<table" not in tagged else [tagged]
            own = self.attributes("main", chance=0.2)
            inner = "".join(f"<div data-k='{mark}'{own}>{x}</div>" if r.random() < 0.95 else x for x in parts if x) if r.random() < 0.7 else tagged
        else:
            tag, attributes = r.choice((("article", ""), ("article", self.attributes("main")), ("main", self.attributes("main")), ("div", self.attributes("main", chance=1)), ("section", self.attributes("main"))))
            if r.random() < 0.3:  # one more element inside, of any name
                tagged = f"<div data-k='{mark}'{self.attributes(r.choice(sorted(WORDS)), r.choice(sorted(WORDS)), chance=0.8)}>{tagged}</div>"
            inner = f"<{tag} data-k='{mark}'{attributes}>{tagged}</{tag}>"
        for _ in range(r.choice((0, 0, 0, 1, 2))):
            inner = f"<div data-k='{mark}'{self.attributes('main', chance=0.2)}>{self.noise() if r.random() < 0.3 else ''}{inner}{self.noise() if r.random() < 0.4 else ''}</div>"
        top = "".join(self.noise() for _ in range(r.choice((0, 1, 2, 2, 3))))
        foot = r.choice((f"<footer{self.attributes('edge', chance=0.3)}>&copy; {r.choice(self.words)}.example &middot; {self.text(r.randint(1, 2))}</footer>", f"<div{self.attributes('edge', chance=1)}>{self.links(1, 4)} &copy; 20{r.randint(10, 24)}</div>", ""))
        low = "".join(self.noise() for _ in range(r.choice((0, 0, 1, 2))))
        page = f"<!DOCTYPE html><html><head><title>x</title><style>p{{}}</style></head><body>{top}<!-- a -->{inner}{low}{foot}</body></html>"
        return page[: -r.randint(1, 30)] if r.random() < 0.1 else page, mark


@dataclass(frozen=True)
class Extractor:
    """Boosted trees over node features, and the weights of hashed tokens that some of these are made of."""

    trees: BoostedTrees
    weights: np.ndarray

    def logits(self, listed: list[list[Node]]) -> np.ndarray:
        return self.trees.logits(np.concatenate([np.zeros((0, N_FEATURES)), *[features(n, self.weights) for n in listed]]))


@lru_cache(maxsize=2)
def fitted(pages: int = 900, seed: int = 5) -> Extractor:
    """Trees fitted on invented pages, whose nodes are known; deterministic, and the same on every machine.

    Tokens' weights are learned from the same pages; the trees see those that the other half of the pages gives, as they will
    have to do with tokens on pages that they were not fitted on.
    """
    writer, listed, labels = _Writer(seed), [], []
    for _ in range(pages):
        page, mark = writer.page()
        nodes = _listed(parse(page))
        listed.append(nodes)
        labels.append(np.array([float(i == 0 or mark in n.attributes) for i, n in enumerate(nodes)]))
    found = [[tokens(n) for n in nodes] for nodes in listed]
    half = [token_weights(found[k::2], labels[k::2]) for k in (1, 0)]
    rows = [features(nodes, half[i % 2]) for i, nodes in enumerate(listed)]
    return Extractor(BoostedTrees(n_trees=100).fit(np.concatenate(rows), np.concatenate(labels)), token_weights(found, labels))


def extract(pages: list[str | None], model: Extractor) -> list[str]:
    """Main text of each page; a null page is empty."""
    trees = [parse(p or "") for p in pages]
    listed = [_listed(t) for t in trees]
    logits = model.logits(listed)
    out, at = [], 0
    for root, nodes in zip(trees, listed, strict=True):
        mine = logits[at : at + len(nodes)].copy()
        at += len(nodes)
        mine[0] = max(mine[0], 0) + 1e-9  # the page itself holds the main text, if there is any
        out.append("\n".join(blocks(root, decode(nodes, mine))))
    return out


def main_text(pages: DataFrame, html_col: str = "html", model: Extractor | None = None) -> DataFrame:
    """``pages`` with ``text`` (string, empty if there is none) instead of ``html_col``; other columns stay, one called text is replaced.

    Narrow, over whole pages. A null page is empty. Broken and cut-off markup is
    read as browsers do: what is open at the end is closed there. Null keys and
    repeated rows are kept.
    """
    shared = pages.sparkSession.sparkContext.broadcast(model or fitted())
    kept = [c for c in pages.columns if c not in (html_col, "text")]
    rows = pages.select(*kept, F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in (x for i in range(0, b.num_rows, 256) for x in lots(b.slice(i, 256), b.num_columns - 1, LOT)):
                texts = extract(part.column(part.num_columns - 1).to_pylist(), shared.value)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(texts, pa.string())], names=[*kept, "text"])

    return rows.mapInArrow(run, rows.schema)
