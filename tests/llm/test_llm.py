"""The ten operators against brute force on small tables, with nulls, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import random
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from auditlake.llm import ann, bpe, exact_dedup, html_text, language_id, license_scan, line_dedup, mixing, ngram_join, substring_dedup

WORDS = [f"w{i}" for i in range(60)]


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def texts(seed=0, n=40):
    r = random.Random(seed)
    passage = " ".join(r.choice(WORDS) for _ in range(25))
    out = [None, "", "one two", "ONE two", "  \n\t "]
    for _ in range(n):
        words = [r.choice(WORDS) for _ in range(r.randint(1, 80))]
        if r.random() < 0.4:
            k = r.randint(0, len(words))
            words[k:k] = passage.split()
        out.append(" ".join(words))
    out += [out[8], out[9] + " extra", out[8].upper(), "é ü " + out[10], "x" * 5000 + " " + " ".join(WORDS * 20)]
    return list(enumerate(out))


def docs(spark, rows):
    # columns that could clash with ones that operators make
    return spark.createDataFrame([(i, t, "k", 1, "s") for i, t in rows], "doc_id long, text string, bucket string, size int, slot string")


def empty(spark):
    return docs(spark, []).limit(0)


def test_exact_dedup(spark):
    rows = texts()
    d = docs(spark, rows).repartition(7)
    for keep, best in (("largest", max), ("smallest", min)):
        groups = {}
        for i, t in rows:
            groups.setdefault((t or "").translate({c: c + 32 for c in range(65, 91)}), []).append(i)
        want = {i: (best(g), len(g), i == best(g), hashlib.sha256(k.encode()).hexdigest()) for k, g in groups.items() for i in g}
        got = {x["doc_id"]: (x["keep_id"], x["group_size"], x["kept"], x["text_sha256"]) for x in exact_dedup.exact_dedup(d, keep=keep, fan_in=2).collect()}
        assert got == want
    odd = exact_dedup.exact_dedup(docs(spark, [(None, "a"), (1, "a"), (None, "b"), (1, "a")])).collect()
    assert sorted((str(x["doc_id"]), str(x["keep_id"]), x["group_size"], x["kept"]) for x in odd) == [("1", "1", 3, True), ("1", "1", 3, True), ("None", "1", 3, False), ("None", "None", 1, False)]
    assert exact_dedup.exact_dedup(empty(spark)).count() == 0


def cut_by_words(rows):
    """(id, words, removed, kept, passages that go) by brute force; a null id is the largest."""
    low = {}
    last = 1 << 62
    for i, t in rows:
        w = split(t)
        for k in range(len(w) - 12):
            low[tuple(w[k : k + 13])] = min(low.get(tuple(w[k : k + 13]), last), last if i is None else i)
    want = []
    for i, t in rows:
        w = split(t)
        gone = [False] * len(w)
        for k in range(len(w) - 12):
            if low[tuple(w[k : k + 13])] < (last if i is None else i):
                gone[k : k + 13] = [True] * 13
        begin = [k for k, g in enumerate(gone) if g and not (k and gone[k - 1])]
        runs = [(k, next((j for j in range(k, len(w)) if not gone[j]), len(w)) - k) for k in begin]
        want.append((i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g), runs))
    return sorted(want, key=str)


def cut_by_spark(spark, rows):
    found = substring_dedup.substring_dedup(docs(spark, rows)).collect()
    return sorted(((x["doc_id"], x["n_words"], x["n_removed"], x["kept"], [tuple(r) for r in x["repeats"]]) for x in found), key=str)


def test_substring_dedup(spark):
    rows = texts(1)
    got = cut_by_spark(spark, rows)
    assert got == cut_by_words(rows) and sum(x[2] for x in got) > 100
    assert substring_dedup.substring_dedup(empty(spark)).count() == 0


def test_substring_dedup_of_few_words_and_odd_ids(spark):
    r = random.Random(11)
    rows = [(r.choice([None, *range(1, 25)]), " ".join(r.choice("ab") for _ in range(r.randint(0, 60)))) for _ in range(40)]
    a = " ".join(WORDS[:40])
    rows += [(30, "a " * 200), (31, "a " * 100), (3, a), (3, a), (None, a + " x"), (None, None), (2, " ".join(WORDS[5:20])), (40, " ".join(WORDS[3:37] * 2))]
    assert cut_by_spark(spark, rows) == cut_by_words(rows)


def test_tree_gives_maximal_repeats():
    lines = ["p q r s t u", "x q r s t y", "z r s t w", "q r s t y"]
    data = "".join(lines).encode()
    w = substring_dedup.Words(np.frombuffer(data, np.uint8), np.r_[0, np.cumsum([len(x) for x in lines])].astype(np.int64), False)
    got = set(zip(*(x.tolist() for x in substring_dedup.tree(w, np.array([4, 2, 1, 3]), np.array([4, 2, 1, 9]), 3))))
    # text 3 is repeated whole among its own documents; of the nodes above a suffix the deepest of each owner is told
    assert got == {(0, 1, 4, 2), (0, 2, 3, 1), (1, 2, 3, 1), (3, 0, 5, 3), (3, 0, 5, 2), (3, 1, 3, 1)}


def grams(t):
    w = split((t or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def linked(rows):
    """(id, size, component) of every row by brute force; rows, not ids, are linked."""
    sets = [grams(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and 100 * len(a & b) >= 75 * len(a | b):
                root[find(i)] = find(j)
    low = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            low[find(k)] = min(low.get(find(k), i), i)
    return sorted(((i, len(sets[k]), low.get(find(k))) for k, (i, _) in enumerate(rows)), key=str)


def test_ngram_join(spark):
    rows = texts(2) + [(100 + k, " ".join(WORDS[:40] + [f"z{k}"])) for k in range(6)]
    a, b = " ".join(f"q{k}" for k in range(50)), " ".join(f"q{k}" for k in range(50, 0, -1))
    rows += [(209, a), (205, a), (205, b), (207, a + " x"), (211, b + " y"), (205, "zz yy"), (None, a + " z"), (None, "of its own"), (None, None), (205, a)]
    got = sorted(((x["doc_id"], x["n_shingles"], x["component_id"]) for x in ngram_join.ngram_join(docs(spark, rows)).collect()), key=str)
    assert got == linked(rows) and (211, 47, 205) in got and (None, 47, 205) in got
    assert ngram_join.ngram_join(empty(spark)).count() == 0


def test_ngram_join_of_a_crowd_that_links_in_chains(spark):
    r = random.Random(6)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for k in range(150):  # two random variants of one text are about as near as the bound
        w = list(base)
        for _ in range(r.randint(0, 5)):
            w[r.randrange(120)] = f"e{r.randrange(400)}"
        rows.append((k, " ".join(w)))
    got = sorted(((x["doc_id"], x["n_shingles"], x["component_id"]) for x in ngram_join.ngram_join(docs(spark, rows)).collect()), key=str)
    assert got == linked(rows) and len({c for _, _, c in got}) > 1


def test_class_of_sets_that_share_a_key():
    shared = np.array([-4, 7])
    assert [ngram_join.class_of(k, 99, shared) for k in (-5, -4, 0, 7, 8)] == [-5, 99, 0, 99, 8]
    assert ngram_join.class_of(3, 99, np.zeros(0, np.int64)) == 3


def test_line_dedup(spark):
    rows = [(1, "a\nb\nc\nd"), (2, "x\nb\nc\nd\ny"), (3, "b\nc\nz"), (4, None), (5, ""), (6, "q\nq\nq\nq\nq"), (7, "b\n\nc\nd\n"), (8, "a\nb\nc\nd"), (8, "a\nb\nc\nd")]
    got = sorted(((x["doc_id"], x["text"], x["n_lines"], x["n_removed"]) for x in line_dedup.line_dedup(docs(spark, rows)).collect()), key=lambda x: x[0])
    assert got == [(1, "a\nb\nc\nd", 4, 0), (2, "x\ny", 5, 3), (3, "b\nc\nz", 3, 0), (4, None, 0, 0), (5, "", 1, 0), (6, "q", 5, 4), (7, "\n", 5, 3), (8, "", 4, 4), (8, "", 4, 4)]
    assert line_dedup.line_dedup(empty(spark)).count() == 0


def by_words(rows, run, words):
    """Texts and removed lines by brute force; rows of distinct ids in order."""
    kept, seen = [], set()
    for i, t in rows:
        lines = (t or "").split("\n")
        full, gone = [k for k, x in enumerate(lines) if split(x)], set()
        for at in range(len(full)):
            for n in range(1, run + 1):
                place = full[at : at + n]
                if len(place) == n and (n == run or sum(len(split(lines[k])) for k in place) >= words):
                    key = tuple(lines[k] for k in place)
                    gone |= set(place) if key in seen else set()
                    seen.add(key)
                    break
        kept.append((i, None if t is None else "\n".join(x for k, x in enumerate(lines) if k not in gone), len(gone)))
    return kept


def test_line_dedup_of_random_lines_and_clashing_columns(spark):
    r = random.Random(7)
    pool = [f"line {k}" for k in range(9)] + ["", " "]
    rows = [(i, "\n".join(r.choice(pool) for _ in range(r.randint(1, 25)))) for i in range(1, 60)]
    d = spark.createDataFrame([(i, t, 1, 2, 3) for i, t in rows], "doc_id long, text string, doc__ int, check__ int, gone__ int")
    got = sorted((x["doc_id"], x["text"], x["n_removed"]) for x in line_dedup.line_dedup(d).collect())
    assert got == by_words(rows, 3, 10**9) and sum(x[2] for x in got) > 100


def test_line_dedup_by_words(spark):
    long, r = "this one line of boilerplate has nine words inside", random.Random(5)
    rows = [(1, long), (2, f"a\n{long}\nb\n\n{long}\nc"), (3, "short\nline"), (4, "short\nline"), (5, "one two three four\nfive six seven eight"), (6, "x\none two three four\n\nfive six seven eight\ny"), (7, None), (8, ""), (9, long)]
    pool = [" ".join(r.choice(WORDS) for _ in range(r.randint(0, 10))) for _ in range(25)]
    rows += [(i, "\n".join(r.choice(pool) for _ in range(r.randint(1, 12)))) for i in range(10, 60)]
    got = sorted((x["doc_id"], x["text"], x["n_removed"]) for x in line_dedup.line_dedup(docs(spark, rows), words=8).collect() if x["doc_id"] != 7)
    assert got == [x for x in by_words(rows, 3, 8) if x[0] != 7]
    assert got[1] == (2, "a\nb\n\nc", 2) and got[3] == (4, "short\nline", 0) and got[5] == (6, "x\n\ny", 2)


def test_pipeline_drops_repeated_long_lines(spark):
    import corpus_pipeline

    long = "this one line of boilerplate has nine words inside"
    rows = [(1, f"first text\n{long}"), (2, f"{long}\nsecond text"), (3, long)]
    d = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert {(x["doc_id"], x["text"], x["n_chars"]) for x in corpus_pipeline.lines(spark, d, "").collect()} == {(1, rows[0][1], len(rows[0][1])), (2, "second text", 11)}


def test_pipeline_keeps_rows_without_an_id(spark, tmp_path):
    import corpus_pipeline

    a, b = " ".join(f"q{k}" for k in range(40)), " ".join(f"r{k}" for k in range(40))
    rows = [(None, b), (1, a), (1, a), (1, b + " x"), (2, a + " y"), (None, "of its own"), (None, None), (3, ""), (3, "")]
    d = spark.createDataFrame([(i, t, "en", "s", len(t or ""), 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, k__ int")
    got = sorted(((x["doc_id"], x["text"]) for x in corpus_pipeline.near_duplicates(spark, d, "").collect()), key=str)
    assert got == sorted([(1, a), (1, b + " x"), (None, "of its own"), (None, None), (3, "")], key=str)
    spark.createDataFrame([(1, 1, 0), (2, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    copies = mixing.mix(d, mixing.domains_of(spark.read.parquet(f"{tmp_path}/labels.parquet")), mixing.WEIGHTS).agg(F.sum("copies")).first()[0]
    assert corpus_pipeline.mixture(spark, d, str(tmp_path)).count() == copies
    for name in ("language", "lines", "near_duplicates"):
        out = dict(corpus_pipeline.STAGES)[name](spark, d.limit(0), "")
        assert out.columns == d.columns and out.count() == 0


def test_bpe(spark):
    tokenizers = pytest.importorskip("tokenizers")
    path = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")
    t = tokenizers.Tokenizer.from_file(path)
    r = random.Random(3)
    odd = ["<|endoftext|>", " ", "\n", "é", "中", "😀", "'s", "the", "ing", "==", "²", "\x00", "a"]
    rows = [(0, None), (1, ""), (2, "a" * 9000), (3, "=-" * 4000)] + [(k, "".join(r.choice(odd) for _ in range(60))) for k in range(4, 60)]
    d = docs(spark, rows)
    want = {i: t.encode(x or "", add_special_tokens=False).ids for i, x in rows}
    ids = bpe.encode(d, path)
    assert {x["doc_id"]: x["ids"] for x in ids.collect()} == want
    assert {x["doc_id"]: x["text"] for x in bpe.decode(ids, path).collect()} == {i: x or "" for i, x in rows}
    got = {x["doc_id"]: (x["n_tokens"], x["ids_sha256"], x["decoded_sha256"]) for x in bpe.encode_digests(d, path).collect()}
    assert got == {i: (len(v), hashlib.sha256(",".join(map(str, v)).encode()).hexdigest(), hashlib.sha256((dict(rows)[i] or "").encode()).hexdigest()) for i, v in want.items()}
    assert bpe.encode(empty(spark), path).count() == 0


def test_nearest(spark):
    r = np.random.default_rng(0)
    v = r.normal(size=(300, 16)).astype(np.float32)
    v[50:60] = v[50]
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(900, None), (901, [0.0] * 16), (902, [float("nan")] * 16), (903, [1.0, None] * 8), (904, [1.0, 2.0]), (5, v[5].tolist())]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {}
    for x in ann.nearest(d, d.where("vec_id % 20 = 0"), 7).collect():
        got.setdefault(x["query_id"], []).append((x["rank"], x["vec_id"], x["score"]))
    w = v.astype(np.float64)
    for q in range(0, 300, 20):
        s = w @ w[q]
        want = sorted(((-round(s[i], 9), i) for i in range(300) if i != q))[:7]
        assert [(k, i) for k, i, _ in sorted(got[q])] == [(k + 1, i) for k, (_, i) in enumerate(want)]
    assert not {900, 901, 902, 903} & set(got) and 904 not in got
    assert ann.nearest(d.limit(0), d.limit(0)).count() == 0


@pytest.mark.parametrize("n", [500, 5000, ann.BLOCK])
def test_nearest_recall_of_a_block(n):
    r = np.random.default_rng(n)
    for v in (r.normal(size=(n, 64)), r.normal(size=(40, 64))[r.integers(0, 40, n)] + r.normal(size=(n, 64))):
        v = (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32)
        ids = np.arange(n)
        q, got, _ = ann.Block(ids, v, 1.0).nearest(ids[:40], v[:40], 20)
        scores = v[:40].astype(np.float64) @ v.T.astype(np.float64)
        scores[ids[:40], ids[:40]] = -np.inf
        best = np.argsort(-scores, axis=1)[:, :20]
        assert np.mean([np.isin(best[i], got[q == i]).mean() for i in range(40)]) >= 0.95


def test_nearest_recall_of_several_blocks(spark):
    r = np.random.default_rng(8)
    v = r.normal(size=(2 * ann.BLOCK + 100, 64)).astype(np.float32)
    d = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(len(v)), "embedding": v.tolist()}), "vec_id long, embedding array<float>")
    asked = range(0, len(v), 500)
    got = {}
    for x in ann.nearest(d, d.where("vec_id % 500 = 0"), 20).collect():
        got.setdefault(x["query_id"], set()).add(x["vec_id"])
    hit = 0
    for q in asked:
        s = v.astype(np.float64) @ v[q]
        s[q] = -np.inf
        hit += len(got[q] & set(np.argsort(-s)[:20].tolist()))
    assert hit >= 0.95 * 20 * len(asked)


def test_language_id(spark):
    rows = [(k, "the cat and the dog were here " * 3, "en") for k in range(40)] + [(100 + k, "der hund und die katze waren hier " * 3, "de") for k in range(40)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(d)
    asked = spark.createDataFrame([(1, "the dogs and cats"), (2, "die hunde und katzen"), (3, None), (4, "123 !!"), (5, "")], "doc_id long, text string")
    got = {x["doc_id"]: (x["lang_pred"], x["score"]) for x in language_id.language_id(asked, model).collect()}
    assert [got[k][0] for k in range(1, 6)] == ["en", "de", "und", "und", "und"] and all(0 <= s <= 1 for _, s in got.values())
    assert language_id.language_id(asked.limit(0), model).count() == 0
    assert language_id.language_id(asked, language_id.fit(d.limit(0))).where("lang_pred = 'und'").count() == 5


def test_language_held_out(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language_id.language_id(d, language_id.fit(d), keep=("lang",)).where(language_id.held_out())
    assert got.where("lang = lang_pred").count() >= 0.97 * got.count()


def test_html(spark):
    page = '<body><nav><ul><li><a href="/">Home</a><li><a>News</a></ul></nav><div class="ad">Buy now</div><article><h1>A title of it</h1><p><b>First &amp; foremost<br>this text <p>second one of the words</article><footer>&copy; us</footer>'
    rows = [(1, page, "u"), (2, None, "u"), (3, "", None), (4, "<p>only words in here</p>", "u")]
    d = spark.createDataFrame(rows, "page_id long, html string, url string")
    got = {x["page_id"]: (x["text"], x["n_chars"]) for x in html_text.html_text(d).collect()}
    want = "A title of it\nFirst & foremost this text\nsecond one of the words"
    assert got[1] == (want, len(want)) and got[2] == ("", 0) and got[3] == ("", 0) and got[4][0] == "only words in here"


def test_html_with_tags_left_out(spark):
    words = "a sentence of the article with enough words in it to be read as text, and one more, too"
    pages = [
        f"<html><head><title>t</title><body><article><h1>Head of it all</h1><p>{words}</article></html>",
        f"<title>t</title><meta charset=utf-8><article><h1>Head of it all</h1><p>{words}</article>",
        f"<html><head><script>x()</script><article><h1>Head of it all</h1><p>{words}<form><select><option>a<option>b</select></form></article>",
        f"<article><h1>Head of it all</h1><ul><li>{words}<li>{words}</ul><table><tr><td>{words}<td>cell</table></article>",
    ]
    cut = [[b[1] for b in html_text.blocks(p)] for p in pages]
    assert cut[0] == cut[1] == cut[2] == ["Head of it all", words] and cut[3] == ["Head of it all", words, words, words, "cell"]
    d = spark.createDataFrame([(i, p, "u") for i, p in enumerate(pages + ["<p>" + "word " * 300_000 + "</p>"])], "page_id long, html string, url string")
    got = {x["page_id"]: (x["text"], x["n_chars"]) for x in html_text.html_text(d).collect()}
    assert all(got[i][0].startswith("Head of it all\n" + words) for i in range(3)) and got[4][1] in (0, 5 * 300_000 - 1)
    assert html_text.html_text(d.limit(0)).count() == 0
    with pytest.raises(ValueError):
        html_text.html_text(d.withColumnRenamed("url", "text"), keep=("page_id", "text"))


def test_license_scan(spark):
    rows = [("a/LICENSE", "Released under the MIT License."), ("a/b/x.txt", "words"), ("a/b/LICENSE", "Licensed under CC BY-NC 4.0."), ("a/b/c/y.txt", "long\nAll rights reserved.\nend"), ("a/b/c/z.txt", None), ("q.txt", ""), (None, "Released under the MIT License."), ("ab/x", "n")]
    d = spark.createDataFrame(rows, "path string, text string")
    got = {x["path"]: (x["license"], x["via"]) for x in license_scan.license_scan(d).collect()}
    assert got["a/b/x.txt"] == ("CC-BY-NC-4.0", "inherited") and got["a/b/c/z.txt"] == ("CC-BY-NC-4.0", "inherited")
    assert got["a/b/c/y.txt"] == ("proprietary", "header") and got["a/LICENSE"][0] == "MIT"
    assert got["q.txt"] == (None, None) and got[None] == (None, None) and got["ab/x"] == (None, None)
    assert license_scan.license_scan(d.limit(0)).count() == 0


def test_license_scan_of_real_notices_and_repeats(spark):
    texts = dict(license_scan.TEXTS)
    wrap = lambda t: "\n".join(" ".join(t.split()[k : k + 12]) for k in range(0, len(t.split()), 12))
    rows = [(i, p, t) for i, (p, t) in enumerate([
        ("m/LICENSE", "MIT License\n\nCopyright (c) 2020 Jane Doe\n\n" + wrap(texts["MIT"])), ("m/src/a.c", "int main() {}"), ("m/b/LICENSE.txt", "BSD 3-Clause License\n\nCopyright (c) 2019, Acme\n\n" + wrap(texts["BSD-3-Clause"])), ("m/b/x.c", ""),
        ("s/y.py", "# SPDX-License-Identifier: MIT\nimport os"), ("s/z.py", "// SPDX-License-Identifier: Apache-2.0"), ("g/COPYING", "GNU GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007\n\nEveryone is permitted to copy and distribute verbatim copies"), ("g/q.c", "x"),
        ("w/w.js", "/*\n * Licensed under the Apache License,\n * Version 2.0\n */"), ("s/y.py", "# SPDX-License-Identifier: MIT\nimport os"), (None, "# SPDX-License-Identifier: MIT"), (None, None), ("n/plain.txt", "we talk about a licence to kill and copyright as such in films"),
    ])] + [(100 + i, f"o/{i}.txt", "some words of the day and of the night") for i in range(60)]
    d = spark.createDataFrame([(i, p, t, "k") for i, p, t in rows], "doc_id long, path string, text string, keep_0 string")
    got = {x["doc_id"]: (x["license"], x["via"]) for x in license_scan.license_scan(d, keep=("doc_id",)).collect()}
    assert len(got) == len(rows)
    want = ["MIT", "MIT", "BSD-3-Clause", "BSD-3-Clause", "MIT", "Apache-2.0", "GPL-3.0", "GPL-3.0", "Apache-2.0", "MIT", None, None, None]
    assert [got[i][0] for i in range(13)] == want and got[1][1] == got[3][1] == got[7][1] == "inherited"


def test_license_scan_of_whole_licences(spark):
    known = dict(license_scan.WHOLE)
    rows = [(f"{x}/LICENSE", "Project of ours\n\n" + license_scan.whole_text(name)) for x, name in known.items()]
    rows += [(f"{x}/src/a.c", "int main() {}") for x in known] + [("prose/LICENSE.txt", "the cat and the dog of the house " * 400), ("half/COPYING", license_scan.whole_text("GPL-3")[:20000])]
    got = {x["path"]: (x["license"], x["via"], x["score"]) for x in license_scan.license_scan(spark.createDataFrame(rows, "path string, text string")).collect()}
    for x in known:
        assert got[f"{x}/LICENSE"][0] == got[f"{x}/src/a.c"][0] == x and got[f"{x}/src/a.c"][1] == "inherited"
    assert got["prose/LICENSE.txt"][0] is None and got["half/COPYING"][0] == "GPL-3.0"


def test_license_scan_counts_every_word(spark):
    rows = [("a/x.txt", "Released as is under the MIT License."), ("b/y.txt", "All rights reserved and with that.")] + [(f"c/{i}.txt", "as is and with that") for i in range(300)]
    d = spark.createDataFrame(rows, "path string, text string")
    got = {x["path"]: (x["license"], x["score"]) for x in license_scan.license_scan(d).where("license IS NOT NULL").collect()}
    df = {}
    for _, t in rows:
        for w in set(license_scan._simple(t)):
            df[w] = df.get(w, 0) + 1

    def weighed(t):
        words = license_scan._simple(t)
        x = {w: words.count(w) * (np.log((1 + len(rows)) / (1 + df.get(w, 0))) + 1) for w in words}
        norm = np.sqrt(sum(v * v for v in x.values()))
        return {w: v / norm for w, v in x.items()}

    for path, name, notice in (("a/x.txt", "MIT", "Released under the MIT License."), ("b/y.txt", "proprietary", "All rights reserved.")):
        a, b = weighed(dict(rows)[path]), weighed(notice)
        assert got[path][0] == name and abs(got[path][1] - sum(v * b.get(w, 0) for w, v in a.items())) < 2e-6
    assert set(got) == {"a/x.txt", "b/y.txt"}


def test_fit_rates_meets_targets(spark):
    r = np.random.default_rng(1)
    p = r.dirichlet([1, 1, 0.5], 200)
    n = r.integers(1, 500, 200)
    soft = spark.createDataFrame([(int(a), b.tolist()) for a, b in zip(n, p)], "tokens long, p array<double>")
    taken, reached, goal, met, settled = mixing.fit_rates(soft, [0.3, 0.6, 0.1])
    assert met and settled
    assert np.abs(reached - goal).max() / n.sum() < 1e-4
    rate = np.ones(200)
    for s in taken:
        rate = np.maximum(0, rate - p @ s)
    assert np.allclose((rate * n) @ p, reached) and (rate >= 0).all()


def test_fit_rates_of_targets_that_cannot_be_met(spark):
    r = np.random.default_rng(2)
    p = r.dirichlet([2, 2, 0.5], 60)
    n = r.integers(1, 200, 60)
    soft = spark.createDataFrame([(int(a), b.tolist()) for a, b in zip(n, p)], "tokens long, p array<double>").coalesce(1).cache()
    fit = mixing.fit_rates(soft, [0, 0, 1], steps=60)
    rate, goal = np.ones(60), np.array([0, 0, n.sum()], float)
    a = (n[:, None] * p).T
    for _ in range(20000):  # plain nonnegative least squares
        rate = np.maximum(0, rate - a.T @ (a @ rate - goal) / np.linalg.eigvalsh(a @ a.T)[-1])
    best, ours = (((x - goal) / n.sum()) ** 2 for x in (a @ rate, fit.reached))
    assert not fit.met and ours.sum() <= 1.1 * best.sum() + 1e-3


def test_mix_of_odd_ids(spark):
    rows = [("a", "one two three"), ("a", "four five"), (None, "six seven eight"), ("b", None), ("c", ""), ("b", "nine"), (None, "six seven eight")]
    d = spark.createDataFrame([(i, t, 1, "p") for i, t in rows], "doc_id string, text string, rate int, key string")
    labels = spark.createDataFrame([("a", "clean"), ("b", "toxic"), ("a", "clean"), (None, "low")], "id string, domain string")
    got = mixing.mix(d, labels, {"clean": 0.7, "toxic": 0.3}).collect()
    assert sorted((str(x["doc_id"]), x["n_tokens"]) for x in got) == sorted((str(i), len(split(t))) for i, t in rows) and len({x["rate"] for x in got if x["doc_id"] is None}) == 1


def test_mix(spark):
    rows = texts(4)
    d = docs(spark, rows)
    labels = spark.createDataFrame([(i, "clean" if i % 2 else "toxic") for i in range(30)], "id long, domain string")
    got = mixing.mix(d, labels, {"clean": 0.6, "low": 0.1, "toxic": 0.3}).collect()
    assert len(got) == len(rows) and all(x["rate"] >= 0 and abs(x["copies"] - x["rate"]) < 1 for x in got)
    assert mixing.mix(empty(spark), labels, {"clean": 1.0, "toxic": 1.0}).count() == 0


def test_pipeline(spark):
    pytest.importorskip("public_tokenizers")
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "lines", "near_duplicates", "mixture", "tokens"]
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert 0 < out.count() and out.where(F.size("ids") != F.col("n_tokens")).count() == 0
