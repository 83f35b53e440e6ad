"""Spelling variants, shards and the conversation trie against brute force, with nulls, ties, repeats, empty tables and clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from auditlake.llm import conversation_trie, sharding, spelling

LOWER = {c: c + 32 for c in range(65, 91)}


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def grouped(count):
    """The rows of variants() by brute force over all pairs."""
    found = {w: [v for v in count if near(w, v)] for w in count}
    form = {}
    for w, vs in found.items():
        if vs and count[best := min(vs, key=lambda v: (-count[v], v))] >= 10 * count[w]:
            form[w] = best

    def root(w):
        return root(form[w]) if w in form else w

    return sorted((w, form.get(w), root(w), n, len(found[w]), count.get(form.get(w))) for w, n in count.items())


def as_rows(df):
    return sorted(((r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()), key=str)


def test_variants_of_few_letters(spark):
    r = random.Random(3)
    count = {"".join(r.choice("abé") for _ in range(r.randint(7, 10))): r.choice([2, 3, 25, 30, 400, 5000, 60000]) for _ in range(900)}
    count |= {"x" * n: 2 ** (n % 9 + 1) for n in range(7, 14)}
    long = "".join(r.choice("abcdef") for _ in range(3000))
    count |= {long: 90, long[:1500] + "z" + long[1500:]: 5, long[:-1] + "z": 5, long[:700] + "y" + long[701:]: 900, "q" * 64: 7, "q" * 65: 80, "q" * 66: 900, "q" * 20 + "r" + "q" * 44: 2}
    got = as_rows(spelling.variants(spark.createDataFrame(list(count.items()), "word string, n long")))
    assert got == sorted(grouped(count), key=str)
    assert max(x[4] for x in got) > 5 and any(x[1] and x[1] != x[2] for x in got)


def test_signature_holds_for_every_edit():
    r = random.Random(5)
    words = ["".join(r.choice("ab") for _ in range(r.randint(7, 12))) for _ in range(300)] + ["a" * 30, "a" * 12 + "b" + "a" * 12]
    order = {g: (k, k + 1) for k, g in enumerate(r.sample([x + y for x in "abc" for y in "abc"], 9))}
    for w in words:
        last, index, chosen = spelling.signature(w, order)
        assert len(chosen) == 2 and chosen[1] - chosen[0] >= 2
        for i in range(len(w) + 1):
            for v in {w[:i] + "c" + w[i:], w[:i] + w[i + 1 :], w[:i] + "c" + w[i + 1 :]} - {w}:
                other_last, other_index, other = spelling.signature(v, order)
                (a, places), (b, held) = ((v, other_index), (w, chosen)) if other_last >= last else ((w, index), (v, other))
                assert any(a[p : p + 2] == b[q : q + 2] and abs(p - q) <= 1 for p in places for q in held)


def counted(rows):
    out = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            out[run if h % 31 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    return {w: n for w, n in out.items() if len(w) >= 7 and n >= 2}


def test_words_of_documents(spark):
    r = random.Random(9)
    stock = ["".join(r.choice("aeiouäçÉÖ×nrst") for _ in range(r.randint(5, 9))) for _ in range(60)]
    rows = [(k, " ".join(r.choice(stock).title() for _ in range(40)) + ",1") for k in range(60)] + [(None, " ".join(stock) * 3), (3, None), (4, ""), (5, "aĀbcdefgh abcdefghª"), (5, "aĀbcdefgh abcdefghª"), (6, "x" * 9000)]
    docs = spark.createDataFrame([(i, t, "k", 1) for i, t in rows], "doc_id long, text string, word string, n int")
    assert {(x["word"], x["n"]) for x in spelling.word_counts(docs).collect()} == set(counted(rows).items())
    assert as_rows(spelling.variants(spelling.word_counts(docs))) == sorted(grouped(counted(rows)), key=str)
    assert spelling.variants(spelling.word_counts(docs.limit(0))).count() == 0


def docs_of(spark, n=500):
    r = random.Random(1)
    rows = [(k, r.choice(["same text", "é" * r.randint(0, 40), None, "x" * r.randint(0, 900)]), "b", 7) for k in range(n)]
    rows += [(None, "nobody's", "b", 1)] * 40 + [(3, "again", "b", 1)] * 300
    return rows, spark.createDataFrame(rows, "doc_id long, text string, bucket string, at int")


def test_shards_by_each_law(spark, tmp_path):
    rows, docs = docs_of(spark)
    for law in sharding.LAWS:
        out = sharding.shard(docs, 24, law, bucket_bytes=2000).collect()
        assert Counter((x["doc_id"], x["text"], x["bucket"], x["at"]) for x in out) == Counter(rows)
        assert all(x["size"] == len((x["text"] or "").encode()) + 8 and x["law"] == law for x in out)
        by = defaultdict(list)
        for x in out:
            by[x["shard"]].append(x)
        assert set(by) <= set(range(24))
        assert all(sorted(x["slot"] for x in xs) == list(range(len(xs))) for xs in by.values())
        if law == "rows":
            assert len(by) == 24 and max(map(len, by.values())) - min(map(len, by.values())) <= 1
        if law == "bytes":
            sizes = [sum(x["size"] for x in by[k]) for k in range(24)]
            assert max(sizes) - min(sizes) <= 2 * max(x["size"] for x in out)
        if law == "key":
            assert all(len({x["shard"] for x in out if x["doc_id"] == i}) == 1 for i in (3, None))
            grown = {x["doc_id"]: x["shard"] for x in sharding.shard(docs, 25, law).collect()}
            assert all(x["grown_shard"] in (x["shard"], 24) and x["grown_shard"] == grown[x["doc_id"]] for x in out) and any(x["grown_shard"] == 24 for x in out)
        else:
            assert {x["grown_shard"] for x in out} == {None}


def test_shuffle_mixes_and_repeats(spark):
    docs = spark.range(2000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    once = [(x["doc_id"], x["shard"], x["slot"]) for x in sharding.shard(docs, 4).collect()]
    again = [(x["doc_id"], x["shard"], x["slot"]) for x in sharding.shard(docs, 4).collect()]
    other = [(x["doc_id"], x["shard"], x["slot"]) for x in sharding.shard(docs, 4, seed=2).collect()]
    assert sorted(once) == sorted(again) != sorted(other)
    order = [i for i, *_ in sorted(once, key=lambda x: x[1:])]
    assert 850 < sum(a < b for a, b in zip(order, order[1:])) < 1150  # half of neighbours ascend


def test_shards_of_odd_tables(spark, tmp_path):
    rows, docs = docs_of(spark, 30)
    assert sharding.shard(docs.limit(0)).count() == 0
    few = sharding.shard(docs.limit(3), 24).collect()
    assert len(few) == 3 and all(x["slot"] == 0 for x in few)
    with pytest.raises(ValueError):
        sharding.shard(docs.withColumn("Slot", F.lit(1)))
    with pytest.raises(ValueError):
        sharding.shard(docs, law="luck")
    sharding.write_shards(sharding.shard(docs, 5), str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == len(rows) and back.where("shard = 2").count() in (len(rows) // 5, len(rows) // 5 + 1)


def paths(rows, fork=True):
    """Rebuilt turns by conversation."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(xs, key=lambda x: x[:2])] for c, xs in own.items()}
    if not fork:
        return own
    h = {c: zlib.crc32(str(c).encode()) % 4 for c in own}
    return {c: own.get(c - c % 20, [])[: h[c]] + xs[h[c] :] for c, xs in own.items()}


def nodes(found):
    member = defaultdict(list)
    for c, xs in found.items():
        for d in range(len(xs) + 1):
            member[tuple(xs[:d])].append(c)
    kids = Counter(k[:-1] for k in member if k)
    leaves, saved = Counter(), Counter()
    for k, cs in member.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", k[-1][1])) if k else 0
        for d in range(len(k) + 1):
            leaves[k[:d]] += k not in kids
            saved[k[:d]] += (len(cs) - 1) * words
    ends = {k: ",".join(str(c) for c in sorted(c for c in cs if len(found[c]) == len(k))) for k, cs in member.items()}
    return sorted(((min(cs), len(k), min(member[k[:-1]]) if k else None, len(cs), kids[k], leaves[k], saved[k], hashlib.sha256(ends[k].encode()).hexdigest()) for k, cs in member.items()), key=str)


def trie_rows(df):
    return sorted((tuple(r[c] for c in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")) for r in df.collect()), key=str)


def talk(seed, n=160, deep=14):
    r = random.Random(seed)
    out = []
    for c in range(n):
        for t in range(r.randint(1, deep)):
            out.append((c, t, r.choice(["user", "user", None]), r.choice(["a b", "a b", "c", "", None]) if t % 3 else "hello you there"))
    out += [(400, t, "user", f"alone {t}") for t in range(60)] + [(401, t, "user", f"alone {t}") for t in range(60)] + [(402, t, "user", f"alone {t}") for t in range(33)]
    out += [(500, None, "user", "first"), (500, 3, "bot", "x"), (500, 4, "bot", "x"), (None, 1, "user", "nowhere"), (77777, 1, "user", "far from its base")]
    out += [(c, 1, "user", "one of many") for c in range(3000, 3000 + 2600)]
    return out


def convs(spark, rows):
    return spark.createDataFrame([(*x, 1, "z") for x in rows], "conv_id long, turn long, role string, text string, depth int, a string")


def test_trie(spark):
    rows = talk(1)
    d = convs(spark, rows).repartition(5)
    want = nodes(paths(rows))
    assert trie_rows(conversation_trie.trie(*conversation_trie.forked(conversation_trie.turns(d)))) == want
    assert any(not xs for xs in paths(rows).values())  # some conversation loses all of its turns
    plain = nodes(paths(rows, fork=False))
    for block in (1, 4, 50):
        assert trie_rows(conversation_trie.trie(conversation_trie.turns(d), block=block)) == plain


def test_trie_of_odd_tables(spark):
    none = convs(spark, [])
    assert conversation_trie.trie(*conversation_trie.forked(conversation_trie.turns(none))).count() == 0
    rows = [(7, 2, "user", "only"), (7, 2, "user", "only"), (7, 1, None, None)]
    assert trie_rows(conversation_trie.trie(conversation_trie.turns(convs(spark, rows)))) == nodes(paths(rows, fork=False))
    late = [(c, 1, "u", "t") for c in range(21, 40)]  # their base is absent, so most have no turns
    assert trie_rows(conversation_trie.trie(*conversation_trie.forked(conversation_trie.turns(convs(spark, late))))) == nodes(paths(late))
