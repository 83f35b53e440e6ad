"""Substring dedup by prefix-partitioned suffix trees over words.

A passage of ``window`` words that two documents share is found from sparse
suffixes: of the word positions at which a window's ``ANCHOR``-grams begin, the
one of least hash is the window's anchor, the same wherever the window stands.

1. Anchors, 40 bits of their hash behind 8 bits of each of their first three
   words, are counted; those that one document alone has are leaves above the
   depth that matters and end there, without any text having moved.
2. Prefixes of the remaining suffixes are counted.  A prefix of one word that
   too many suffixes begin with is split by the second word, then by the third,
   then by the rest; prefixes of such variable length fill memory-sized groups.
3. Each bucket of documents sends a group its suffixes with the words that their
   windows span, once for all copies that it has, with the smallest and largest
   document.  So a passage that a third of all documents hold comes once from a
   bucket, not once from a document.
4. A group sorts its suffixes and takes whole common prefix lengths of
   neighbours: the suffix tree in its linear form.  Internal nodes at least
   ``window`` words deep are repeats, and the smallest document below is whose
   they are.  Of each suffix the deepest node of each such document counts, and
   of repeats that only go on to the left the longest.  These maximal repeats go
   back to the buckets, which mark words; a passage longer than the windows of
   one anchor is marked by several that overlap.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns, durable, pack, ship, unpack, width
from .words import U, Words, mix, pieces

#: Words of an anchor; text bytes of a bucket of documents, and whose anchors are counted in one task; suffixes of a group.
ANCHOR, BUCKET_BYTES, SLOT_BYTES, GROUP = 7, 4 << 20, 64 << 20, 10_000
_LAST = (1 << 63) - 1
#: Bits of a code that stand for its first one, two, three words, and for the finest split.
LEVELS = (8, 16, 24, 48)


class Suffixes:
    """Anchored runs of windows of a piece: windows first..last have the anchor at ``at``."""

    def __init__(self, w: Words, window: int) -> None:
        m, k = len(w.hash), ANCHOR
        g, _ = w.grams(k)
        _, fits = w.grams(window)
        span = window - k + 1
        p = np.flatnonzero(fits)
        self.first = self.last = self.at = np.zeros(0, np.int64)
        if len(p):
            least = np.argmin(np.lib.stride_tricks.sliding_window_view(g, span)[p], 1) + p
            cut = np.flatnonzero(np.r_[True, (np.diff(least) != 0) | (np.diff(p) != 1)])
            self.first, self.last, self.at = p[cut], p[np.r_[cut[1:], len(p)] - 1], least[cut]
        h, a = w.hash, self.at
        self.code = (h[a] >> U(56)) << U(56) | (h[a + 1] >> U(56)) << U(48) | (h[a + 2] >> U(56)) << U(40) | g[a] >> U(24) if len(a) else np.zeros(0, U)
        self.doc = np.searchsorted(w.first, self.at, "right") - 1
        sums = np.zeros(m + 1, U)
        if m:
            up, down = w.powers(m + 1)
            np.cumsum(h * up[:-1], out=sums[1:])
            end = self.last + window
            #: of all words of the windows, whose number tells runs of one word apart
            self.key = mix((sums[end] - sums[self.first]) * down[self.first] + (end - self.first).astype(U) * U(0x9E3779B97F4A7C15))
        else:
            self.key = np.zeros(0, U)


def group_of(code: np.ndarray, heavy: list[np.ndarray], groups: int) -> np.ndarray:
    """The group of each code: that of its shortest prefix that is not heavy; prefixes share ``groups`` groups."""
    out = np.full(len(code), -1, np.int64)
    for i, bits in enumerate(LEVELS):
        p = code >> U(64 - bits)
        settled = np.ones(len(code), bool) if i == len(LEVELS) - 1 else ~np.isin(p, heavy[i])
        new = settled & (out < 0)
        out[new] = (mix((p[new] << U(2)) | U(i)) % U(groups)).astype(np.int64)
    return out


def tree(words: Words, low: np.ndarray, high: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Repeats of ``window`` words at least: text, place in the text, words, and the smallest document below the node.

    Suffixes are ordered by doubling, and common prefixes of neighbours are read
    off the same ranks, to their full length.  Of the nodes above a suffix the
    deepest of each owner counts; ``low`` and ``high`` are the smallest and the
    largest document of a text, whose suffixes are nodes themselves where these
    differ.  A repeat that goes on to the left with the same owner is left out.
    """
    m = len(words.hash)
    _, fits = words.grams(window)
    p = np.flatnonzero(fits)
    if not len(p):
        return (np.zeros(0, np.int64),) * 4
    lengths = np.diff(words.first)
    end = np.repeat(words.first[1:], lengths)
    ranks, k = [np.unique(words.hash, return_inverse=True)[1].astype(np.int64) + 1], 1
    while k < lengths.max():
        then, has = np.zeros(m, np.int64), np.flatnonzero(np.arange(m) + k < end)
        then[has] = ranks[-1][has + k]
        ranks.append(np.unique(ranks[-1] * (m + 1) + then, return_inverse=True)[1].astype(np.int64) + 1)
        k *= 2
    order = p[np.argsort(ranks[-1][p], kind="stable")]
    depth = np.zeros(len(order) - 1, np.int64)
    for i in reversed(range(len(ranks))):
        x, y = order[:-1] + depth, order[1:] + depth
        whole = np.flatnonzero((x + (1 << i) <= end[order[:-1]]) & (y + (1 << i) <= end[order[1:]]))
        depth[whole[ranks[i][x[whole]] == ranks[i][y[whole]]]] += 1 << i
    text = np.searchsorted(words.first, order, "right") - 1
    own, alone = low[text], np.flatnonzero(low[text] < high[text])
    found = [(text[alone], order[alone], (end[order] - order)[alone], own[alone])]
    for d in np.unique(depth[depth >= window])[::-1]:
        node = np.r_[True, depth < d]
        least = np.minimum.reduceat(low[text], np.flatnonzero(node))[np.cumsum(node) - 1]
        new = np.flatnonzero(least < own)
        found.append((text[new], order[new], np.full(len(new), d), least[new]))
        own = least
    text, at, n, own = (np.concatenate(x) for x in zip(*found))
    o = np.lexsort((at, own, at + n, text))
    text, at, n, own = text[o], at[o], n[o], own[o]
    inner = (np.diff(text) == 0) & (np.diff(at + n) == 0) & (np.diff(own) == 0) & (np.diff(at) == 1)
    keep = ~np.r_[False, inner][: len(text)]
    return text[keep], (at - words.first[text])[keep], n[keep], own[keep]


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 13) -> DataFrame:
    """id_col, n_words, n_removed, kept_sha256, kept (the words that stay, joined by one blank), repeats for every row.

    ``repeats`` are the passages that go: number of the first word (from 0) and
    words.  A word goes if it is covered by ``window`` consecutive words of its document
    that also stand in a document of smaller id; windows are judged on the input
    alone.  A null text has no words.  Rows that repeat an id do not take from
    each other; a null id is larger than any other.  Whole texts of any length: a
    task holds a bucket of about 4 MB, or one text that is longer.  An empty table
    gives an empty result.  Other columns are not read, so no name can clash.
    """
    if window < ANCHOR:
        raise ValueError(f"window is {ANCHOR} words at least")
    spark = docs.sparkSession
    ship(spark)
    rows = columns(docs, id_col, text_col).toDF("id", "text").select(F.col("id").cast("long").alias("id"), "text")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets, slots = max(width(spark), -(-size // BUCKET_BYTES)), max(2 * width(spark), -(-size // SLOT_BYTES))
    placed = rows.select(F.pmod(F.xxhash64("id", "text"), F.lit(buckets)).cast("int").alias("bucket"), "id", "text")

    def anchors(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                b = whole.slice(at, 2048)
                bucket, code, doc = [], [], []
                own = b.column(0).to_numpy()
                for lo, _, w in pieces(b.column(1)):
                    s = Suffixes(w, window)
                    code.append(s.code)
                    doc.append(s.doc + lo)
                c, d = np.concatenate(code), np.concatenate(doc)
                o = np.lexsort((d, c))
                c, d = c[o], d[o]
                new = np.r_[True, (c[1:] != c[:-1]) | (d[1:] != d[:-1])][: len(c)]  # once a document
                c, bucket = c[new], own[d[new]]
                o = np.lexsort((bucket, c))
                c, bucket = c[o], bucket[o]
                first = np.flatnonzero(np.r_[True, (c[1:] != c[:-1]) | (bucket[1:] != bucket[:-1])][: len(c)])
                several = (np.diff(np.r_[first, len(c)]) > 1).astype(np.uint8)
                c, bucket = c[first], bucket[first].astype(np.int32)
                slot = (mix(c) % U(slots)).astype(np.int32)
                o = np.lexsort((c, bucket, slot))
                cut = np.flatnonzero(np.r_[True, np.diff(slot[o]) > 0, True]) if len(o) else np.zeros(1, int)
                yield pa.RecordBatch.from_arrays([pa.array(slot[o][cut[:-1]]), pa.array([pack(c[i], bucket[i], several[i]) for i in np.split(o, cut[1:-1])] if len(o) else [], pa.binary())], ["slot", "block"])

    def repeated(t: pa.Table) -> pa.Table:
        got = [unpack(x.as_py(), U, np.int32, np.uint8) for x in t.column("block")]
        c, b, s = (np.concatenate(x) for x in zip(*got))
        o = np.argsort(c, kind="stable")
        c, b, s = c[o], b[o], s[o]
        first = np.flatnonzero(np.r_[True, c[1:] != c[:-1]][: len(c)])
        n = np.diff(np.r_[first, len(c)])
        keep = np.repeat((n > 1) | (np.maximum.reduceat(s, first) > 0), n) if len(c) else np.zeros(0, bool)
        c, b = c[keep], b[keep]
        o = np.lexsort((c, b))
        c, b = c[o], b[o]
        cut = np.flatnonzero(np.r_[True, np.diff(b) > 0, True]) if len(b) else np.zeros(1, int)
        return pa.table({"bucket": pa.array(b[cut[:-1]], pa.int32()), "codes": pa.array([pack(np.unique(x)) for x in np.split(c, cut[1:-1])] if len(b) else [], pa.binary())})

    found = placed.select("bucket", "text").mapInArrow(anchors, "slot int, block binary").groupBy("slot").applyInArrow(repeated, "bucket int, codes binary")
    found = durable(found)

    def prefixes(batches):
        for b in batches:
            for x in b.column(0):
                (c,) = unpack(x.as_py(), U)
                for i, bits in enumerate(LEVELS[:-1]):
                    p, n = np.unique(c >> U(64 - bits), return_counts=True)
                    yield pa.RecordBatch.from_pydict({"level": np.full(len(p), i, np.int32), "prefix": p.astype(np.int64), "n": n})

    counts = found.select("codes").mapInArrow(prefixes, "level int, prefix long, n long").groupBy("level", "prefix").agg(F.sum("n").alias("n"))
    heavy: list[list[int]] = [[] for _ in LEVELS]
    total = 0
    for x in counts.where((F.col("n") > GROUP) | (F.col("level") == 0)).collect():  # of 8, 16 and 24 bits: a row a prefix at most, and those of GROUP suffixes only
        total += x["n"] * (x["level"] == 0)
        if x["n"] > GROUP:
            heavy[x["level"]].append(x["prefix"])
    told = spark.sparkContext.broadcast([np.array(x, U) for x in heavy])
    groups = max(1, -(-2 * total // GROUP))

    def send(own: pa.Table, codes: pa.Table) -> pa.Table:
        out: dict[str, list] = {"group": [], "bucket": [], "block": []}
        shape = pa.schema([("group", pa.int64()), ("bucket", pa.int32()), ("block", pa.binary())])
        if len(own) and len(codes):
            known = np.unique(np.concatenate([unpack(x.as_py(), U)[0] for x in codes.column("codes")]))
            ids = own.column("id").fill_null(_LAST).to_numpy()
            parts = []
            for lo, _, w in pieces(own.column("text")):
                s = Suffixes(w, window)
                at = np.minimum(np.searchsorted(known, s.code), len(known) - 1)
                hit = np.flatnonzero(known[at] == s.code)
                begin, end = w.start[s.first[hit]], w.end[s.last[hit] + window - 1]
                parts.append((s.code[hit], s.key[hit], ids[lo + s.doc[hit]], np.array([w.data[i:j].tobytes() for i, j in zip(begin.tolist(), end.tolist())], object)))
            code, key, doc, text = (np.concatenate(x) for x in zip(*parts))
            o = np.lexsort((doc, key))
            code, key, doc, text = code[o], key[o], doc[o], text[o]
            first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]][: len(key)])
            last = np.r_[first[1:], len(key)] - 1
            if len(first):
                group = group_of(code[first], told.value, groups)
                o = np.argsort(group, kind="stable")
                cut = np.flatnonzero(np.r_[True, np.diff(group[o]) > 0, True])
                for i in np.split(o, cut[1:-1]):
                    texts = text[first[i]].tolist()
                    out["group"].append(int(group[i[0]]))
                    out["bucket"].append(int(own.column("bucket")[0].as_py()))
                    out["block"].append(pack(key[first[i]], doc[first[i]], doc[last[i]], np.array([len(x) for x in texts], np.int32), np.frombuffer(b"".join(texts), np.uint8)))
        return pa.table({k: pa.array(v, shape.field(k).type) for k, v in out.items()})

    def subtree(t: pa.Table) -> pa.Table:
        got = [unpack(x.as_py(), U, np.int64, np.int64, np.int32, np.uint8) for x in t.column("block")]
        bucket = np.repeat(t.column("bucket").to_numpy(), [len(x[0]) for x in got])
        key, low, high, size, data = (np.concatenate(x) for x in zip(*got))
        words = Words(data, np.r_[0, np.cumsum(size, dtype=np.int64)], False)
        text, place, n, owner = tree(words, low, high, window)
        o = np.argsort(bucket[text], kind="stable")
        b = bucket[text][o]
        cut = np.flatnonzero(np.r_[True, np.diff(b) > 0, True]) if len(b) else np.zeros(1, int)
        blocks = [pack(key[text[i]], place[i].astype(np.int32), n[i].astype(np.int32), owner[i]) for i in np.split(o, cut[1:-1])] if len(b) else []
        return pa.table({"bucket": pa.array(b[cut[:-1]], pa.int32()), "marks": pa.array(blocks, pa.binary())})

    def cut_out(own: pa.Table, marks: pa.Table) -> pa.Table:
        ids, n_words, n_gone, kept = own.column("id").fill_null(_LAST).to_numpy(), [], [], []
        runs: list[list[dict]] = []
        key = np.zeros(0, U)
        if len(marks):
            got = [unpack(x.as_py(), U, np.int32, np.int32, np.int64) for x in marks.column("marks")]
            key, place, n, owner = (np.concatenate(x) for x in zip(*got))
            o = np.argsort(key, kind="stable")
            key, place, n, owner = key[o], place[o], n[o], owner[o]
        for lo, hi, w in pieces(own.column("text")) if len(own) else ():
            gone = np.zeros(len(w.hash), bool)
            if len(key):
                s = Suffixes(w, window)
                a, b = np.searchsorted(key, s.key, "left"), np.searchsorted(key, s.key, "right")
                which = np.repeat(np.arange(len(a)), b - a)
                mark = np.arange(len(which)) - np.repeat(np.cumsum(b - a) - (b - a), b - a) + np.repeat(a, b - a)
                late = owner[mark] < ids[lo + s.doc[which]]
                which, mark = which[late], mark[late]
                begin = s.first[which] + place[mark]
                edge = np.zeros(len(gone) + 1, np.int64)
                np.add.at(edge, begin, 1)
                np.add.at(edge, begin + n[mark], -1)
                gone = np.cumsum(edge[:-1]) > 0
            data = w.data.tobytes()
            for i in range(hi - lo):
                x, y = int(w.first[i]), int(w.first[i + 1])
                stay = np.flatnonzero(~gone[x:y]) + x
                n_words.append(y - x)
                n_gone.append(y - x - len(stay))
                turn = np.flatnonzero(np.diff(np.r_[False, gone[x:y], False])).reshape(-1, 2).tolist()
                runs.append([{"start": a, "words": b - a} for a, b in turn])
                kept.append(b" ".join([data[p:q] for p, q in zip(w.start[stay].tolist(), w.end[stay].tolist())]))
        return pa.table({"id": own.column("id"), "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_gone, pa.int64()), "kept_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string()), "kept": pa.array(kept, pa.binary()).cast(pa.string()), "repeats": pa.array(runs, pa.list_(pa.struct([("start", pa.int64()), ("words", pa.int64())])))})

    dealt = placed.groupBy("bucket")
    sent = dealt.cogroup(found.groupBy("bucket")).applyInArrow(send, "group long, bucket int, block binary")
    marks = sent.groupBy("group").applyInArrow(subtree, "bucket int, marks binary")
    out = dealt.cogroup(marks.groupBy("bucket")).applyInArrow(cut_out, "id long, n_words long, n_removed long, kept_sha256 string, kept string, repeats array<struct<start: long, words: long>>")
    return out.withColumnRenamed("id", id_col)


def op2_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return substring_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("kept", "repeats")
