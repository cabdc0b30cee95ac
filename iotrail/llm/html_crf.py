"""Main text of web pages: a linear-chain conditional random field over the leaf blocks of the DOM.

A page is read into leaf blocks, runs of text between block-level tags, each with the tags, classes and ids of its ancestors. A
two-label chain (article or not) scores every block by features of its ancestors and its text and every pair of neighbours by their
labels; Viterbi finds the best labelling, and the article blocks make the text.

The chain is trained on labelled pages: at most ``TRAINING_PAGES`` pages of the table (of up to ``TRAINING_BYTES`` bytes) whose own
markup says what is article (``article`` or ``main`` elements without the usual asides), and for each of them a page that lays out the
same blocks anew in other markup with known labels, so that the model doesn't depend on one template. Chosen pages are used whole.
"""

from __future__ import annotations

import html as entities
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from iotrail.llm.common import quoted

TRAINING_PAGES = 300
TRAINING_BYTES = 64_000
SEED = 6
#: Elements whose content is no text of the page.
RAW = frozenset(("script", "style", "template", "noscript", "title", "svg", "iframe", "textarea", "object", "canvas", "head", "annotation", "annotation-xml"))
#: Those that hold text up to their end tag, or the end of the page; the others are passed over only if they end.
RAW_TEXT = frozenset(("script", "style", "title", "iframe", "textarea"))
VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"))
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img input ins kbd label mark meter output q rp rt ruby s samp small span strike strong sub sup time tt u var wbr "
    "math mi mo mn ms mtext mspace mrow mfrac msqrt mroot mstyle merror mpadded mphantom mfenced msub msup msubsup munder mover munderover mmultiscripts mprescripts mtable mtr mtd maction menclose semantics".split()
)
#: What an opening tag closes if it is still open, up to the nearest of the second set.
ENDS = {
    "li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "option": (("option",), ("select",)),
    "tr": (("tr",), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")),
}
OPENING = re.compile(r"<(?=[!?]|/?[a-zA-Z])")
TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"'=]|=\s*+"[^"]*"|=\s*+'[^']*'|["'=])*+)>|<[!?][^>]*+>""", re.S)
#: The same with quotation marks that mean nothing.
BARE_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>|<[!?][^>]*+>""", re.S)
RAW_END = {name: re.compile(rf"</{name}\b[^>]*+>", re.I) for name in RAW}
#: Elements deeper than this are read, but aren't held as ancestors (browsers flatten such trees at the same depth).
DEEPEST = 512
ATTRIBUTE = re.compile(r"""\b(class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
LEADING_ZEROS = re.compile(r"&#0+(?=[0-9])")
NO_CHARACTER = re.compile(r"&#[1-9][0-9]{7,};?")
NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
SENTENCE_END = (".", "!", "?", "…", ":", "”", '"')
NOISE_TAGS = frozenset(("nav", "header", "footer", "aside", "form", "menu", "button", "select", "dialog"))
#: Name parts that templates give to what isn't the article (used to label training pages and to lay out new ones).
NOISE_NAMES = {
    "ad": "ad ads advert advertisement banner sponsor sponsored promo promoted", "nav": "nav menu navigation breadcrumb breadcrumbs navbar topbar pager pagination",
    "side": "sidebar side widget related recommended rail trending popular", "foot": "footer foot copyright legal colophon", "head": "header masthead head site logo top",
    "note": "notice cookie consent gdpr alert popup modal overlay newsletter subscribe", "comment": "comments comment replies reply disqus discussion respond", "form": "form search login signup",
}
NOISE_PARTS = frozenset(w for group in NOISE_NAMES.values() for w in group.split())
MAIN_PARTS = ("article", "content", "post", "entry", "story", "main", "body", "text")


class Place:
    """An open element under those around it, with what the features need to know of all of them; blocks at one place share it."""

    __slots__ = ("depth", "marks", "noisy", "open", "own", "parent", "plain", "quiet", "tag")

    def __init__(self, tag: str, parts: frozenset[str], parent: Place | None) -> None:
        self.tag, self.parent, self.depth = tag, parent, parent.depth + 1 if parent else 1
        holds = tag in ("article", "main")
        # What an article's own element is called says nothing against it.
        noisy = tag in NOISE_TAGS or (not holds and not parts.isdisjoint(NOISE_PARTS))
        outer = tag in ("html", "body")
        marks = {f"name={w}" for w in parts if w in MAIN_PARTS or (not holds and w in NOISE_PARTS)} | (set() if outer else {f"in={tag}"})
        around = parent.marks if parent else frozenset()
        self.marks: frozenset[str] = around if marks <= around else around | marks
        above = parent.open if parent else frozenset()
        self.open: frozenset[str] = above if tag in above else above | {tag}
        self.own: str = tag if not outer else parent.own if parent else "none"
        self.quiet: bool = not noisy
        self.noisy: bool = noisy or (parent is not None and parent.noisy)
        #: Whether an article or main element is around it, and nothing else from there on in.
        self.plain: bool = holds or (not noisy and parent is not None and parent.plain)

    def in_article(self) -> tuple[bool, bool]:
        """Whether an article or main element is around, and whether nothing from the outermost one on in is noise."""
        found, clean, quiet, at = False, True, True, self
        while at is not None:
            if at.tag in ("article", "main"):
                found, clean = True, quiet
            quiet = quiet and at.quiet
            at = at.parent
        return found, clean


@dataclass
class Block:
    """A leaf block: its text, the open element it stands in, and how much of it is link text."""

    text: str
    place: Place | None
    linked: int = 0


def decoded(piece: str) -> str:
    """Character references as characters; numbers of any length that stand for none are U+FFFD."""
    return entities.unescape(NO_CHARACTER.sub("\ufffd", LEADING_ZEROS.sub("&#", piece)))


def read_blocks(page: str | None) -> list[Block]:
    """The leaf blocks of a page in order; a null or empty page has none. Broken markup is read as far as it goes, in linear time.

    A tag that has no end outside of quotation marks ends at the next ``>``, and so do all behind it; ``<`` behind the last ``>`` is text.
    """
    page = page or ""
    blocks: list[Block] = []
    place: Place | None = None
    deeper: dict[str, int] = {}
    run: list[str] = []
    linked, in_link, at = 0, 0, 0
    pattern, last, endless = TAG, page.rfind(">"), set()

    def close() -> None:
        nonlocal linked
        text = " ".join("".join(run).split())
        if text:
            blocks.append(Block(text, place, linked))
        run.clear()
        linked = 0

    def add(piece: str) -> None:
        nonlocal linked
        piece = decoded(piece) if "&" in piece else piece
        run.append(piece)
        if in_link:
            linked += len(piece.strip())

    def pop(names: tuple[str, ...], until: tuple[str, ...] = ()) -> None:
        nonlocal place
        if place is None or place.open.isdisjoint(names):
            return
        inner = place
        while inner is not None and inner.tag not in until:
            if inner.tag in names:
                place = inner.parent
                return
            inner = inner.parent

    def next_tag() -> re.Match[str] | None:
        nonlocal pattern
        start = OPENING.search(page, at)
        if start is not None and start.start() > last:
            where = page.find("<!--", start.start())
            return TAG.match(page, where) if where >= 0 else None
        found = start and pattern.match(page, start.start())
        if start is not None and found is None:
            pattern = BARE_TAG
            found = pattern.match(page, start.start())
        return found

    while True:
        found = next_tag()
        if found is None:
            add(page[at:])
            break
        if found.start() > at:
            add(page[at : found.start()])
        at = found.end()
        name = (found[2] or "").lower()
        if not name:  # a comment or a declaration
            continue
        if found[1]:
            if name in INLINE:
                if name == "a":
                    in_link = 0
            else:
                close()
                in_link = 0
                if deeper.get(name):
                    deeper[name] -= 1
                else:
                    pop((name,))
                    if place is None or place.depth < DEEPEST:
                        deeper.clear()
            continue
        if name in RAW and name != "head":
            if name not in RAW_TEXT and found[3].rstrip().endswith("/"):
                continue
            end = None if name in endless else RAW_END[name].search(page, at, last + 1)
            if end is None:
                endless.add(name)
            at = end.end() if end else len(page) if name in RAW_TEXT else at
            continue
        if name == "br":
            run.append(" ")
            continue
        if name in VOID:
            if name == "hr":
                close()
            continue
        if name in INLINE:
            if name == "a":
                in_link = 1
            continue
        close()
        in_link = 0
        pop(("p",), ("table", "button", "td", "li"))
        if name in ENDS:
            pop(*ENDS[name])
        if found[3].rstrip().endswith("/"):
            continue
        if place is not None and place.depth >= DEEPEST:
            deeper[name] = deeper.get(name, 0) + 1
        else:
            parts = frozenset(w.lower() for a in ATTRIBUTE.finditer(found[3]) for w in NAME_PART.findall(a[2] or a[3] or a[4] or ""))
            place = Place(name, parts, place)
    close()
    return blocks


def step(x: float, steps: tuple[float, ...]) -> int:
    return sum(x >= s for s in steps)


def features(blocks: list[Block]) -> list[list[str]]:
    """The features that hold for every block: of its ancestors, of its text, and of its place on the page."""
    out = []
    last = len(blocks) - 1
    for k, b in enumerate(blocks):
        n, words = len(b.text), b.text.count(" ") + 1
        place = b.place
        own = place.own if place else "none"
        link = step(b.linked / n, (0.01, 0.3, 0.7))
        f = [f"own={own}", f"link={link}", f"words={step(words, (2, 4, 8, 15, 30, 60))}", f"end={b.text.endswith(SENTENCE_END)}", f"link={link} own={own}"]
        if place:
            f += place.marks
            if place.noisy:
                f.append("noise around")
            if place.plain:
                f.append("plain part of main")
        f.append(f"sign={'©' in b.text or '(c)' in b.text.lower()}")
        f.append(f"stops={step(sum(map(b.text.count, '.,;')) / words, (0.01, 0.05, 0.15))}")
        if k == 0:
            f.append("first")
        if k == last:
            f.append("last")
        out.append(f)
    return out


@dataclass
class Chain:
    """Weights of the chain for labels 0 (other) and 1 (article)."""

    weight: dict[str, tuple[float, float]] = field(default_factory=dict)
    move: tuple[tuple[float, float], tuple[float, float]] = ((0.0, 0.0), (0.0, 0.0))

    def decode(self, rows: list[list[str]]) -> list[int]:
        """The best labelling (Viterbi); of equally good ones that with article blocks."""
        if not rows:
            return []
        (m00, m01), (m10, m11) = self.move
        find, back, s0, s1 = self.weight.get, [], 0.0, 0.0
        for k, row in enumerate(rows):
            e0 = e1 = 0.0
            for f in row:
                w = find(f)
                if w is not None:
                    e0 += w[0]
                    e1 += w[1]
            if k:
                a, b = (s0 + m00, s1 + m10), (s0 + m01, s1 + m11)
                back.append((int(a[1] >= a[0]), int(b[1] >= b[0])))
                s0, s1 = max(a) + e0, max(b) + e1
            else:
                s0, s1 = e0, e1
        labels = [int(s1 >= s0)]
        for choice in reversed(back):
            labels.append(choice[labels[-1]])
        return labels[::-1]


def train(pages: list[tuple[list[list[str]], list[int]]], rounds: int = 100, l2: float = 1e-3, rate: float = 0.1) -> Chain:
    """Maximises the conditional likelihood of labelled pages (Adam; forward-backward over all pages at once)."""
    pages = [(f, y) for f, y in pages if f]
    if not pages:
        return Chain()
    names = {w: k for k, w in enumerate(sorted({w for f, _ in pages for row in f for w in row}))}
    length, count = max(len(y) for _, y in pages), len(pages)
    cell, feature = [], []
    label, real = np.zeros((count, length), np.int64), np.zeros((count, length), bool)
    for p, (rows, y) in enumerate(pages):
        label[p, : len(y)], real[p, : len(y)] = y, True
        for k, row in enumerate(rows):
            cell += [p * length + k] * len(row)
            feature += [names[w] for w in row]
    cell, feature = np.array(cell), np.array(feature)
    weight, move = np.zeros((len(names), 2)), np.zeros((2, 2))
    gold = np.eye(2)[label] * real[..., None]
    both = real[:, 1:] & real[:, :-1]
    gold_move = np.einsum("pki,pkj->ij", gold[:, :-1], gold[:, 1:] * both[..., None])
    memory = [[np.zeros_like(x), np.zeros_like(x)] for x in (weight, move)]
    total = real.sum()
    for t in range(1, rounds + 1):
        score = np.stack([np.bincount(cell, weight[feature, c], count * length) for c in (0, 1)], axis=1).reshape(count, length, 2)
        forward, backward = np.zeros_like(score), np.zeros_like(score)
        forward[:, 0] = score[:, 0]
        for k in range(1, length):
            forward[:, k] = score[:, k] + np.logaddexp.reduce(forward[:, k - 1, :, None] + move, axis=1)
            forward[:, k] = np.where(real[:, k, None], forward[:, k], forward[:, k - 1])
        whole = np.logaddexp.reduce(forward[:, -1], axis=1)
        for k in range(length - 2, -1, -1):
            after = np.logaddexp.reduce(move + (score[:, k + 1] + backward[:, k + 1])[:, None, :], axis=2)
            backward[:, k] = np.where(real[:, k + 1, None], after, 0)
        share = np.exp(forward + backward - whole[:, None, None]) * real[..., None]
        pair = np.exp(forward[:, :-1, :, None] + move + (score[:, 1:] + backward[:, 1:])[:, :, None, :] - whole[:, None, None, None]) * both[..., None, None]
        rest = (gold - share).reshape(-1, 2)[cell]
        slope = np.stack([np.bincount(feature, rest[:, c], len(names)) for c in (0, 1)], axis=1) / total - l2 * weight / 10
        for x, g, (m, v) in ((weight, slope, memory[0]), (move, (gold_move - pair.sum(axis=(0, 1))) / total - l2 * move / 10, memory[1])):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            x += rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return Chain({w: (float(weight[k, 0]), float(weight[k, 1])) for w, k in names.items()}, tuple(map(tuple, move.tolist())))


def own_labels(blocks: list[Block]) -> list[int] | None:
    """Labels that a page's own markup gives; None if it has no article or main element."""
    labels, seen = [], False
    for b in blocks:
        inside, clean = b.place.in_article() if b.place else (False, False)
        seen |= inside
        labels.append(int(inside and clean))
    return labels if seen else None


def laid_out(article: list[str], other: list[str], rng: random.Random) -> tuple[str, list[int]]:
    """A page with the given texts in other markup, and the labels of its blocks."""
    out: list[str] = ["<!DOCTYPE html><html><head><title>x</title></head><body>"]
    labels: list[int] = []
    text = lambda: entities.escape(rng.choice(other))
    short = lambda: entities.escape(" ".join(rng.choice(other).split()[: rng.randint(1, 4)]))

    def put(markup: str, n: int, label: int = 0) -> None:
        out.append(markup)
        labels.extend([label] * n)

    def named(kind: str) -> str:
        return f'{rng.choice(("class", "id"))}="{rng.choice(NOISE_NAMES[kind].split())}{rng.choice(("", "-box", " wide", "-1"))}"'

    def links(kind: str) -> None:
        n, tag = rng.randint(2, 7), rng.choice(("nav", "div", "ul"))
        items = "".join(f'<li><a href="/x">{short()}</a></li>' for _ in range(n))
        put(f"<{tag} {named(kind)}>{items if tag == 'ul' else f'<ul>{items}</ul>'}</{tag}>", n)

    def boxed(kind: str, tags: tuple[str, ...], most: int = 2) -> None:
        n, tag = rng.randint(1, most), rng.choice(tags)
        name = named(kind) if tag in ("div", "section", "p") or rng.random() < 0.5 else ""
        put(f"<{tag} {name}>{''.join(f'<p>{text()}</p>' for _ in range(n)) if tag != 'p' else text()}</{tag}>", n if tag != "p" else 1)

    def comments() -> None:
        n, tag = rng.randint(1, 4), rng.choice(("section", "div", "ol"))
        item = "li" if tag == "ol" else "div"
        body = "".join(f'<{item} class="{rng.choice(("comment", "reply", "comment-body"))}"><p>{text()}</p></{item}>' for _ in range(n))
        put(f"<{tag} {named('comment')}>{body}</{tag}>", n)

    def form() -> None:
        put(f"<form {named('form')}><label>{short()}</label> <input name=q><p>{text()}</p><button>{short()}</button></form>", 3)

    before = [lambda: boxed("head", ("header", "div")), lambda: links("nav"), lambda: boxed("note", ("div", "section")), lambda: boxed("ad", ("div", "p", "aside")), form]
    inside = [lambda: boxed("ad", ("div", "aside")), lambda: boxed("note", ("div", "aside")), lambda: links("side"), form]
    after = [comments, lambda: links("side"), lambda: boxed("side", ("aside", "div"), 3), form, lambda: boxed("foot", ("footer", "div")), lambda: boxed("ad", ("div",))]
    for make in before:
        if rng.random() < 0.6:
            make()
    if rng.random() < 0.25:
        rng.choice(after[1:3])()
    tag = rng.choice(("article", "main", "div", "div", "section"))
    name = "" if tag in ("article", "main") and rng.random() < 0.6 else f' class="{rng.choice(MAIN_PARTS)}{rng.choice(("", "-content", "-body"))}"' if rng.random() < 0.8 else ""
    if tag in ("article", "main") and rng.random() < 0.2:
        name = f' class="{rng.choice(MAIN_PARTS)} {rng.choice(sorted(NOISE_PARTS))}"'
    out.append(f"<{tag}{name}>")
    for k, piece in enumerate(article):
        kind = "h1" if k == 0 and rng.random() < 0.7 else rng.choice(("p", "p", "p", "p", "h2", "li", "blockquote", "div", "td", "pre"))
        shown = entities.escape(piece)
        if rng.random() < 0.3:
            words = shown.split(" ")
            at = rng.randrange(len(words))
            words[at] = rng.choice(('<a href="/y">{}</a>', "<b>{}</b>", "<i>{}</i>")).replace("{}", words[at])
            shown = " ".join(words)
        put({"li": f"<ul><li>{shown}</li></ul>", "td": f"<table><tr><td>{shown}</td></tr></table>"}.get(kind, f"<{kind}>{shown}</{kind}>"), 1, 1)
        if rng.random() < 0.12:
            rng.choice(inside)()
    if rng.random() < 0.15:
        comments()
    out.append(f"</{tag}>")
    for make in after:
        if rng.random() < 0.5:
            make()
    return "".join(out) + "</body></html>", labels


def training_set(pages: list[str], seed: int = SEED) -> list[tuple[list[list[str]], list[int]]]:
    """Features and labels of the given pages as far as they label themselves, and of pages laid out anew from all of them."""
    rng = random.Random(seed)
    out, article, other = [], [], []
    for page in pages:
        blocks = read_blocks(page)
        labels = own_labels(blocks)
        if labels is None:
            continue
        out.append((features(blocks), labels))
        article.append([b.text for b, y in zip(blocks, labels) if y])
        other += [b.text for b, y in zip(blocks, labels) if not y]
    words = " ".join(other + [t for texts in article for t in texts]).split() or "some words of no meaning stand here".split()
    filler = [" ".join(rng.choices(words, k=rng.randint(1, 25))) + rng.choice((".", "", "!")) for _ in range(200)]
    sources = [a for a in article if a] or [[" ".join(rng.choices(words, k=rng.randint(5, 60))) + "." for _ in range(rng.randint(1, 8))] for _ in range(200)]
    for texts in sources:
        # Other boxes hold sentences like the article's as well, so that text alone doesn't decide.
        page, labels = laid_out([t for t in texts if t.strip()], (other or filler) + filler + texts[:3], rng)
        blocks = read_blocks(page)
        if len(blocks) == len(labels):
            out.append((features(blocks), labels))
    return out


def fit(pages: DataFrame, page_id: str = "page_id", html: str = "html", most: int = TRAINING_PAGES, longest: int = TRAINING_BYTES) -> Chain:
    """A chain trained on at most ``most`` pages of ``pages``, those with the smallest hashes of their ids."""
    usable = pages.select(F.col(page_id).alias("id"), F.col(html).cast("string").alias("html")).where((F.octet_length("html") > 0) & (F.octet_length("html") <= longest))
    # Numbers first, so that tasks send no pages but those that are taken.
    mark = F.xxhash64("id").alias("mark")
    last = usable.select(mark).distinct().orderBy("mark").limit(most).agg(F.max("mark")).first()[0]
    chosen = usable.where(mark <= F.lit(last)).groupBy(mark).agg(F.min("html").alias("html")).orderBy("mark").limit(most).collect()
    return train(training_set([r["html"] for r in chosen]))


def extract(pages: DataFrame, chain: Chain, html: str = "html", text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """The carried columns (all by default) with the main text of every page.

    Character references are decoded, white space in a block becomes one blank, and the article blocks are joined by two line feeds. Null,
    empty and article-less pages have an empty text. Rows are neither dropped nor merged; a column called like the new one is replaced.
    """
    carry = [c for c in (pages.columns if carry is None else carry) if c.lower() != text.lower()]
    source = pages.select(*map(quoted, carry), quoted(html).cast("string").alias("input of the operator"))
    names = [*carry, text]

    def main_text(page: str | None) -> str:
        blocks = read_blocks(page)
        return "\n\n".join(b.text for b, y in zip(blocks, chain.decode(features(blocks))) if y)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                texts = [main_text(t.as_py()) for t in part.column(part.num_columns - 1)]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(texts, pa.string())], names=names)

    return source.mapInArrow(run, T.StructType([*source.schema.fields[:-1], T.StructField(text, T.StringType())]))
