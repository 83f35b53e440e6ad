"""BPE encoding and decoding by streaming transducers of constant memory.

Encoding: a buffer holds the next bytes of a pretoken.  Cutting a text off can
change tokens near the cut only: a token changes if its right neighbour does at
an earlier merge, so the change travels left along merges of falling rank.
``sufficient_lookahead`` finds the longest such chain in the merge list; a token
that ends at least so many bytes before the buffer's end is stable and goes
out, and the buffer moves on.  Words shorter than the buffer are the usual case
and their tokens are remembered in a bounded table.

Decoding: tokens' bytes go through an incremental UTF-8 state machine that holds
at most the few bytes of an unfinished character.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import columns, ship

#: The split of byte-level BPE vocabularies of this kind (a fixed value).
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters of a text that are split at once, and remembered words at most.
PART, WORDS = 1 << 16, 250_000
#: Bytes up to which a buffer's pairs are simply looked through for the next merge.
SHORT = 32


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in a vocabulary file: printable Latin-1 for itself, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


def sufficient_lookahead(merges: list[tuple[bytes, bytes]]) -> int:
    """Bytes after a token that decide whether it is final.

    ``reach[x]`` is how far beyond x the text can matter to a merge, of those
    seen so far, that consumes x from the left.  A token is open to the merges
    that start with it or with a token at the right edge of its derivation.
    """
    right: dict[bytes, bytes] = {}
    reach: dict[bytes, int] = {}

    def after(token: bytes) -> int:
        far = reach.get(token, 0)
        while token in right:
            token = right[token]
            far = max(far, reach.get(token, 0))
        return far

    for x, y in merges:  # by rank, so that only smaller ranks have been seen
        reach[x] = max(reach.get(x, 0), len(y) + after(y))
        right.setdefault(x + y, y)
    return max((after(t) for t in [*right, *reach]), default=0)


class Bpe:
    """A vocabulary file's merges over bytes, its special tokens and its decoder."""

    def __init__(self, text: str) -> None:
        told = json.loads(text)
        letters = byte_letters()
        as_bytes = lambda s: bytes(letters[c] for c in s)
        self.bytes_of = {i: as_bytes(t) for t, i in told["model"]["vocab"].items()}
        ids = {b: i for i, b in self.bytes_of.items()}
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in told["model"]["merges"]]
        merges = [(as_bytes(a), as_bytes(b)) for a, b in pairs]
        self.rank = {}
        for r, (a, b) in enumerate(merges):
            self.rank.setdefault((ids[a], ids[b]), (r, ids[a + b]))
        self.single = [ids[bytes([b])] for b in range(256)]
        self.special = {t["content"]: t["id"] for t in told["added_tokens"]}
        self.bytes_of |= {i: t.encode() for t, i in self.special.items()}
        self.lookahead = sufficient_lookahead(merges)
        longest = max(map(len, self.bytes_of.values()))
        self.buffer = 2 * self.lookahead + 2 * longest

    def merged(self, data: bytes) -> list[int]:
        """Tokens of one buffer: the merge of least rank first, the leftmost of equals."""
        ids = [self.single[b] for b in data]
        n, rank = len(ids), self.rank
        if n < 2:
            return ids
        if n <= SHORT:
            get = rank.get
            known = [get(p) for p in zip(ids, ids[1:])]
            while True:
                best = None
                for k, m in enumerate(known):
                    if m is not None and (best is None or m < best):
                        best, i = m, k
                if best is None:
                    return ids
                ids[i : i + 2] = [best[1]]
                del known[i]
                if i < len(known):
                    known[i] = get((ids[i], ids[i + 1]))
                if i:
                    known[i - 1] = get((ids[i - 1], ids[i]))
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(m[0], i, ids[i], ids[i + 1], m[1]) for i in range(n - 1) if (m := rank.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b, new = heapq.heappop(heap)
            j = right[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = new, -1
            right[i] = k = right[j]
            if k < n:
                left[k] = i
                if m := rank.get((new, ids[k])):
                    heapq.heappush(heap, (m[0], i, new, ids[k], m[1]))
            if (h := left[i]) >= 0 and (m := rank.get((ids[h], new))):
                heapq.heappush(heap, (m[0], h, ids[h], new, m[1]))
        return [x for x in ids if x >= 0]

    def stream(self, data: bytes) -> Iterator[int]:
        """Tokens of one pretoken of any length, each as soon as it is stable."""
        if len(data) <= self.buffer:
            yield from self.merged(data)
            return
        at = 0
        while at < len(data):
            tokens = self.merged(data[at : at + self.buffer])
            last = at + self.buffer >= len(data)
            stable, end = len(data) if last else at + self.buffer - self.lookahead, at
            for t in tokens:
                end += len(self.bytes_of[t])
                if end > stable:
                    break
                at = end
                yield t


class Coder:
    """Encodes and decodes texts; what it remembers of words is bounded by WORDS."""

    def __init__(self, bpe: Bpe) -> None:
        self.bpe, self.split = bpe, regex.compile(SPLIT)
        self.words: dict[str, str] = {}
        self.texts: dict[str, bytes] = {}
        self.old_words, self.old_texts = self.words, self.texts  # the generation before, whose words move on when they come again
        self.marks = regex.compile("|".join(map(regex.escape, sorted(bpe.special, key=len, reverse=True)))) if bpe.special else None

    def _word(self, word: str) -> str:
        if len(self.words) >= WORDS:
            self.old_words, self.words = self.words, {}
        ids = self.old_words.get(word) or ",".join(map(str, self.bpe.stream(word.encode())))
        if len(word) < 64:
            self.words[word] = ids
        return ids

    def _plain(self, text: str) -> Iterator[list[str]]:
        at = 0
        while at < len(text):
            end = at + PART
            # no pretoken has a blank after something else, so a part may end there
            while end < len(text) and not (text[end] == " " and not text[end - 1].isspace()):
                end += 1
            known, word = self.words.get, self._word
            yield [known(w) or word(w) for w in self.split.findall(text[at:end])]
            at = end

    def encode(self, text: str) -> Iterator[list[str]]:
        """Parts of the token stream, as lists of words' ids, each word's joined by commas."""
        at = 0
        if self.marks is not None and "<" in text or self.marks is not None and any(not m.startswith("<") for m in self.bpe.special):
            for m in self.marks.finditer(text):
                yield from self._plain(text[at : m.start()])
                yield [str(self.bpe.special[m[0]])]
                at = m.end()
        yield from self._plain(text[at:] if at else text)

    def _bytes(self, ids: str) -> bytes:
        if len(self.texts) >= WORDS:
            self.old_texts, self.texts = self.texts, {}
        own = self.bpe.bytes_of
        out = self.old_texts.get(ids) or b"".join([own[int(i)] for i in ids.split(",")])
        if len(ids) < 256:
            self.texts[ids] = out
        return out

    def decode(self, parts: Iterable[list[str]]) -> Iterator[str]:
        """Text of a token stream, as far as its bytes are whole characters; what is no UTF-8 becomes U+FFFD."""
        machine = codecs.getincrementaldecoder("utf-8")("replace")
        for part in parts:
            known, new = self.texts.get, self._bytes
            yield machine.decode(b"".join([known(x) or new(x) for x in part]))
        yield machine.decode(b"", True)

    def digest(self, text: str | None) -> tuple[int, str, str]:
        """Tokens, SHA-256 of the ids joined by commas, SHA-256 of what they decode to; part by part."""
        ids, back, n = hashlib.sha256(), hashlib.sha256(), 0

        def seen() -> Iterator[list[str]]:
            nonlocal n
            for part in self.encode(text or ""):
                if part:
                    joined = ",".join(part)
                    ids.update((("," if n else "") + joined).encode())
                    n += joined.count(",") + 1
                    yield part

        for x in self.decode(seen()):
            back.update(x.encode("utf-8", "surrogatepass"))
        return n, ids.hexdigest(), back.hexdigest()


_OWN: dict[str, Coder] = {}


def _coder(told: str) -> Coder:
    """One coder a worker process and vocabulary."""
    key = hashlib.sha256(told.encode()).hexdigest()
    if key not in _OWN:
        _OWN[key] = Coder(Bpe(told))
    return _OWN[key]


def _mapped(docs: DataFrame, vocabulary: str, id_col: str, text_col: str, kept: list[str], made, shape: str) -> DataFrame:
    spark = docs.sparkSession
    ship(spark)
    with open(vocabulary, encoding="utf-8") as f:
        told = spark.sparkContext.broadcast(f.read())  # the vocabulary file, whose size is fixed
    names = [x.split(" ")[0] for x in shape.split(", ")]
    if clash := {k.lower() for k in kept} & set(names):
        raise ValueError(f"a column to keep is called {sorted(clash)[0]}, as one that is made")
    rows = columns(docs, *kept, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(told.value)
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], *made(coder, b.column(b.num_columns - 1))], [*b.schema.names[:-1], *names])

    head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(run, f"{head}, {shape}")


def encode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """id_col, the columns in ``keep``, n_tokens and ids (array of int) of every whole text; null is an empty text, which has no ids.

    ValueError if ``keep`` names a column n_tokens or ids; other columns are not read.
    """

    def made(coder: Coder, texts: pa.Array) -> list[pa.Array]:
        got = [np.array([i for part in coder.encode(x.as_py() or "") for w in part for i in w.split(",")], np.int32) for x in texts]
        size = [len(g) for g in got]
        flat = pa.array(np.concatenate(got) if got else np.zeros(0, np.int32))
        return [pa.array(size, pa.int64()), pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(size)], pa.int32()), flat)]

    return _mapped(docs, vocabulary, id_col, text_col, [id_col, *keep], made, "n_tokens long, ids array<int>")


def decode(tokens: DataFrame, vocabulary: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id_col and text of arrays of ids; null gives an empty text, ids that the vocabulary lacks give nothing."""

    def made(coder: Coder, ids: pa.Array) -> list[pa.Array]:
        own = coder.bpe.bytes_of
        return [pa.array(["".join(coder.decode([[str(i) for i in x.as_py() or [] if i in own]])) for x in ids], pa.string())]

    return _mapped(tokens, vocabulary, id_col, ids_col, [id_col], made, "text string")


def encode_digests(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """id_col, the columns in ``keep``, n_tokens, ids_sha256, decoded_sha256 of every whole text.

    A null text counts as empty: no tokens, both digests of nothing.  A special
    token's string in a text is that token.  Repeated ids are rows like any other,
    and an empty table gives an empty result.  ValueError if ``keep`` names a
    column that is made.  A task holds a text and its ids; the transducer itself
    holds its lookahead, but a text without any blank is one piece to it.
    """

    def made(coder: Coder, texts: pa.Array) -> list[pa.Array]:
        got = [coder.digest(x.as_py()) for x in texts]
        return [pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.string()), pa.array([g[2] for g in got], pa.string())]

    return _mapped(docs, vocabulary, id_col, text_col, [id_col, *keep], made, "n_tokens long, ids_sha256 string, decoded_sha256 string")


def op7_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
