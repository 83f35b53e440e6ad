"""Main text of web pages by a recurrent block labeller.

A page becomes the sequence of its leaf blocks: runs of text between block-level
tags.  A block is described by its tag path (tags and the words of their class
and id attributes), its words, both hashed into embeddings, and a few figures.
A bidirectional LSTM in numpy reads the whole sequence and labels each block
with all of the document as context.  html_train.py learns the weights on
generated pages; here they are only applied, page batches in parallel.
"""

from __future__ import annotations

import io
import pkgutil
import re
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import columns, ship

_BLOCK = set(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul caption".split()
)
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: What never holds text that is read.
_SKIP = set("script style noscript template head title svg math iframe object select option button textarea canvas audio video".split())
#: Tags that a new one of the key closes.
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: What may stand in a head; anything else ends it, as its end tag may be left out.
_HEAD = set("base basefont bgsound link meta noscript script style template title".split())
_SCOPE = set("ul ol dl table tbody thead div section article main body aside nav footer header form blockquote".split())
_NAME = re.compile(r"[a-z]+")

HASHES, PATH, WORD, HIDDEN, FIGURES = 4096, 16, 8, 16, 4


class Page(HTMLParser):
    """A page's leaf blocks, each with the node of its tag path: time and memory are linear in the page, however deep its tags are.

    ``nodes`` lists (parent, own names) of every tag in the order they open, the
    first being no tag at all; ``blocks`` lists (node, text, share in links).
    """

    def __init__(self, html: str | None) -> None:
        super().__init__(convert_charrefs=True)
        self.nodes: list[tuple[int, tuple[str, ...]]] = [(0, ())]
        self.blocks: list[tuple[int, str, float]] = []
        self.open: list[tuple[str, int]] = []  # tag, node
        self.places: dict[str, list[int]] = {"": [], "scope": [], "block": []}  # of each open tag, of those that end a search
        self.text: list[str] = []
        self.skip = self.linked = 0
        self.feed(html or "")
        self.close()
        self._end()

    def names(self, node: int) -> tuple[str, ...]:
        """All names on the path to a node, from the outermost on."""
        out: list[str] = []
        while node:
            node, own = self.nodes[node]
            out[:0] = own
        return tuple(out)

    def _end(self) -> None:
        words = "".join(self.text).split()
        if words:
            text = " ".join(words)
            self.blocks.append((self.open[-1][1] if self.open else 0, text, min(1.0, self.linked / len(text))))
        self.text, self.linked = [], 0

    def _last(self, *tags: str) -> int:
        """The innermost open place of any of these, -1 if there is none."""
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=-1)

    def _push(self, tag: str, own: tuple[str, ...]) -> None:
        self.nodes.append((self.open[-1][1] if self.open else 0, own))
        for kind, here in ((f"<{tag}", True), ("scope", tag in _SCOPE), ("block", tag in _BLOCK)):
            if here:
                self.places.setdefault(kind, []).append(len(self.open))
        self.open.append((tag, len(self.nodes) - 1))
        self.skip += tag in _SKIP

    def _pop(self, to: int) -> None:
        while len(self.open) > to:
            tag, _ = self.open.pop()
            for kind, here in ((f"<{tag}", True), ("scope", tag in _SCOPE), ("block", tag in _BLOCK)):
                if here:
                    self.places[kind].pop()
            self.skip -= tag in _SKIP

    def _end_head(self) -> None:
        for i, (tag, _) in enumerate(self.open[:3]):
            if tag == "head":
                self._pop(i)
                break

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag not in _HEAD:
            self._end_head()
        if tag in _VOID:
            if tag in _BLOCK:
                self._end()
            self.text.append(" ")
            return
        if tag in _BLOCK:
            self._end()
            at = self._last("<p", *(f"<{t}" for t in _CLOSES.get(tag, ())))  # an open paragraph ends where a block begins
            if at > self._last("scope"):
                self._pop(at)
        own = [f"<{tag}"]
        for key, value in attrs:
            if value and key in ("class", "id", "role"):
                own += [f".{x}" for x in _NAME.findall(value.lower())]
        self._push(tag, tuple(own))

    def handle_endtag(self, tag: str) -> None:
        if tag in _BLOCK:
            self._end()
        at = self._last(f"<{tag}")
        if at >= 0 and (tag in _BLOCK or at > self._last("block")):
            self._pop(at)

    def handle_data(self, data: str) -> None:
        if self.open and self.open[-1][0] == "head" and data.strip():
            self._end_head()
        if not self.skip:
            self.text.append(data)
            if self.places.get("<a"):
                self.linked += len(data)


def blocks(html: str | None) -> list[tuple[tuple[str, ...], str, float]]:
    """Leaf blocks in page order: names of the tag path, text with single blanks, share of it in links.  For training: paths are written out."""
    page = Page(html)
    return [(page.names(node), text, linked) for node, text, linked in page.blocks]


_SEEN: dict[str, int] = {}


def _hash(name: str) -> int:
    if (h := _SEEN.get(name)) is None:
        if len(_SEEN) > 200_000:
            _SEEN.clear()
        h = _SEEN[name] = zlib.crc32(name.encode()) % HASHES
    return h


class Bags:
    """Hashed names and words of a list of pages' blocks, ready for sums by block, and the figures.

    Pages are lists of blocks() with their paths written out, or Page objects,
    whose nodes are summed along the tree once.
    """

    def __init__(self, pages: list[Page] | list[list[tuple[tuple[str, ...], str, float]]]) -> None:
        path, word, self.n_path, self.n_word, figures = [], [], [], [], []
        self.parent: list[int] = []  # of nodes of all pages, one behind the other
        self.node: list[int] = []  # of blocks
        for page in pages:
            own, first = (page.blocks if isinstance(page, Page) else page), len(self.parent)
            if isinstance(page, Page):
                for up, names in page.nodes:
                    self.parent.append(first + up)
                    path += [_hash(n) for n in names]
                    self.n_path.append(len(names))
            for k, (where, text, linked) in enumerate(own):
                words = text.lower().split(" ")
                if isinstance(page, Page):
                    self.node.append(first + where)
                else:
                    path += [_hash(n) for n in where]
                    self.n_path.append(len(where))
                word += [_hash(w) for w in words]
                self.n_word.append(len(words))
                figures.append((np.log1p(len(text)) / 5, linked, k / len(own), min(len(words), 50) / 50))
        self.path, self.word = np.array(path, np.int64), np.array(word, np.int64)
        self.figures = np.array(figures, np.float32).reshape(-1, FIGURES)
        self.at_path, self.at_word = np.repeat(np.arange(len(self.n_path)), self.n_path), np.repeat(np.arange(len(self.n_word)), self.n_word)
        self.share = 1 / np.maximum(1, np.array(self.n_word, np.float32))
        self.lengths = [len(p.blocks) if isinstance(p, Page) else len(p) for p in pages]

    def vectors(self, net: dict[str, np.ndarray]) -> np.ndarray:
        p, w = np.zeros((len(self.n_path), PATH), np.float32), np.zeros((len(self.figures), WORD), np.float32)
        for out, table, ids, sizes in ((p, net["path"], self.path, self.n_path), (w, net["word"], self.word, self.n_word)):
            size = np.array(sizes, np.int64)
            some = np.flatnonzero(size)
            if len(some):
                out[some] = np.add.reduceat(table[ids], (np.cumsum(size) - size)[some])
        if self.parent:
            for k, up in enumerate(self.parent):  # parents come first
                if up != k:
                    p[k] += p[up]
            p = p[self.node]
        return np.concatenate([p, w * self.share[:, None], self.figures], 1)

    def padded(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pages side by side: steps x pages x features, and which steps there are."""
        steps = max(self.lengths, default=0)
        out, there = np.zeros((steps, len(self.lengths), x.shape[1]), np.float32), np.zeros((steps, len(self.lengths), 1), np.float32)
        at = 0
        for i, n in enumerate(self.lengths):
            out[:n, i], there[:n, i] = x[at : at + n], 1
            at += n
        return out, there


def _squash(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.minimum(np.maximum(x, -30), 30)))


def one_way(x: np.ndarray, there: np.ndarray, w: np.ndarray, u: np.ndarray, b: np.ndarray, keep: list | None = None) -> np.ndarray:
    """States of an LSTM over the steps; gates are input, forget, output, new.  Missing steps leave the state as it is."""
    steps, pages, _ = x.shape
    h = c = np.zeros((pages, HIDDEN), np.float32)
    fed, out = x @ w + b, np.empty((steps, pages, HIDDEN), np.float32)
    whole = bool(there.all())  # a page by itself has all of its steps
    for t in range(steps):
        z = fed[t] + h @ u
        s = _squash(z[:, : 3 * HIDDEN])
        i, f, o = s[:, :HIDDEN], s[:, HIDDEN : 2 * HIDDEN], s[:, 2 * HIDDEN :]
        g = np.tanh(z[:, 3 * HIDDEN :])
        c1 = f * c + i * g
        tc = np.tanh(c1)
        m = there[t]
        if keep is not None:
            keep.append((h, c, i, f, o, g, tc, m))
        if whole:
            h, c = o * tc, c1
        else:
            h, c = m * (o * tc) + (1 - m) * h, m * c1 + (1 - m) * c
        out[t] = h
    return out


def scores(bags: Bags, net: dict[str, np.ndarray]) -> np.ndarray:
    """Probability of each block to be main text, pages one after the other."""
    x, there = bags.padded(bags.vectors(net))
    if not x.size:
        return np.zeros(0, np.float32)
    ahead = one_way(x, there, net["wf"], net["uf"], net["bf"])
    back = one_way(x[::-1], there[::-1], net["wb"], net["ub"], net["bb"])[::-1]
    p = _squash(np.concatenate([ahead, back, x], 2) @ net["wo"] + net["bo"])[:, :, 0]
    return np.concatenate([p[:n, i] for i, n in enumerate(bags.lengths)])


def load() -> dict[str, np.ndarray]:
    """The weights that html_train.py has learned."""
    with np.load(io.BytesIO(pkgutil.get_data(__package__, "html_net.npz"))) as z:
        return {k: z[k].astype(np.float32) for k in z.files}


def extract(pages: list[str | None], net: dict[str, np.ndarray]) -> list[str]:
    """Main text of each page: its blocks that the labeller takes, joined by a line feed."""
    cut = [Page(p) for p in pages]
    out = [""] * len(pages)
    order = sorted(range(len(pages)), key=lambda i: len(cut[i].blocks))
    while order:  # pages of like length together, about 4096 steps at once
        n = 1
        while n < len(order) and n < 64 and (n + 1) * len(cut[order[n]].blocks) <= 4096:
            n += 1
        own, order = order[:n], order[n:]
        p, at = scores(Bags([cut[i] for i in own]), net), 0
        for i in own:
            out[i] = "\n".join(b[1] for b, y in zip(cut[i].blocks, p[at : at + len(cut[i].blocks)]) if y > 0.5)
            at += len(cut[i].blocks)
    return out


def html_text(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The columns in ``keep``, text and n_chars of every row; null html is empty, and so is a page without main text.

    Rows that repeat a page have one result each; an empty table gives an empty
    one.  A page of any length and any depth of tags is read as a whole, in one
    task, in time and memory linear in its length.  ``keep`` may not
    hold a column called text or n_chars; other columns are not read.
    """
    if {"text", "n_chars"} & set(keep):
        raise ValueError("keep has a column text or n_chars")
    ship(pages.sparkSession)
    rows = columns(pages, *keep, html_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = load()
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                text = extract(b.column(b.num_columns - 1).to_pylist(), net)
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], [*b.schema.names[:-1], "text", "n_chars"])

    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(run, f"{shape}, text string, n_chars long")


def op9_html_text(spark, sf_dir: str) -> DataFrame:
    return html_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
