"""Clashing names through operators and pipeline, pages of any depth, and language ID against a plain out-of-place distance."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from auditlake.llm import bpe, html_text, language_id, mixing


def test_kept_columns_may_not_be_called_as_made_ones(spark):
    d = spark.createDataFrame([(1, "hello there", 1, 2)], "doc_id long, text string, score int, n_tokens int")
    with pytest.raises(ValueError):
        language_id.language_id(d, language_id.Model({}), keep=("score",))
    path = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")
    with pytest.raises(ValueError):
        bpe.encode(d, path, keep=("n_tokens",))
    assert bpe.encode(d, path, keep=("score",)).columns == ["doc_id", "score", "n_tokens", "ids"]


def test_pipeline_with_clashing_columns(spark, tmp_path):
    pytest.importorskip("public_tokenizers")
    import corpus_pipeline

    r = random.Random(4)
    words = {"en": "the of and house water light nothing".split(), "de": "der und das wasser nicht haus licht".split()}
    rows = [(k, " ".join(r.choice(words[g]) for _ in range(60)) + "\n12 34", g, "s", 1, 2, 3, 4, 5, 6, 7) for k, g in enumerate(["en", "de"] * 30)]
    names = ["score", "lang_pred", "n_lines", "n_removed", "k__", "row", "copies"]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, " + ", ".join(f"{n} int" for n in names))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, k % 2, int(k % 5 == 0)) for k in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    found = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        found = stage(spark, found, str(tmp_path))
        assert found.columns == docs.columns
        path = f"{tmp_path}/{stage.__name__}"
        found.write.parquet(path)
        found = spark.read.parquet(path)
        assert found.select(*names).distinct().collect() == [(1, 2, 3, 4, 5, 6, 7)]
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == found.count() > 20


@pytest.mark.parametrize("part", ["<div>x y", "<h1>x", "<b>x ", "<li>a<b>", "</div>x", "<a href=1>t</p>"])
def test_pages_of_any_depth_take_time_in_proportion(part):
    net = html_text.load()

    def took(n):
        began = time.time()
        page = html_text.Page(part * n)
        assert len(page.nodes) <= 2 * n + 1 and sum(len(own) for _, own in page.nodes) <= 2 * n
        html_text.extract([part * n], net)
        return time.time() - began

    took(500)
    assert took(20_000) < 1 + 8 * took(5000)


def test_paths_of_a_page_are_those_written_out():
    html = "<html><body class='Main page'><div id=nav><ul><li>a<li>b</ul></div><p>one <b>two<p>three<table><tr><td>x<td>y</table></body>"
    page = html_text.Page(html)
    assert [(t, page.names(n)) for n, t, _ in page.blocks] == [(t, names) for names, t, _ in html_text.blocks(html)]
    assert page.names(page.blocks[0][0]) == ("<html", "<body", ".main", ".page", "<div", ".nav", "<ul", "<li")
    net = html_text.load()
    a, b = html_text.Bags([page]).vectors(net), html_text.Bags([html_text.blocks(html)]).vectors(net)
    assert np.allclose(a, b, atol=1e-5)


def plain_ranks(text, size):
    count = {}
    word = "".join(c.lower() if c.isalpha() else " " for c in text).split()
    line = " " + " ".join(word) + " "
    for n in (1, 2, 3):
        for k in range(len(line) - n + 1):
            g = line[k : k + n]
            if g.strip() and " " not in g[1:-1] and not (n == 1 and g == " "):
                count[g] = count.get(g, 0) + 1
    packed = lambda g: sum(ord(c) << (21 * (len(g) - 1 - i)) for i, c in enumerate(g))
    return [packed(g) for g in sorted(count, key=lambda g: (-count[g], packed(g)))][:size]


def test_language_by_a_plain_out_of_place_distance():
    r = random.Random(2)
    stock = {"a": "banana cabana abacab", "b": "üben über öl grün", "c": "the then other either"}
    profiles = {n: np.array(plain_ranks(t * 3, 40), np.uint64) for n, t in stock.items()}
    model = language_id.Model(profiles, 40)
    for _ in range(60):
        text = " ".join(r.choice(r.choice(list(stock.values())).split()) for _ in range(r.randint(1, 9))) + r.choice(["", " 12, X!", "\n\n"])
        own = plain_ranks(text, 40)
        place = {n: {int(k): i for i, k in enumerate(p)} for n, p in profiles.items()}
        away = {n: sum(abs(place[n][k] - i) if k in place[n] else 40 for i, k in enumerate(own)) for n in stock}
        best = min(away, key=lambda n: (away[n], n))
        assert model.predict(text) == (best, pytest.approx(1 - away[best] / (40 * len(own))))


def test_mix_brings_totals_to_their_targets(spark):
    r = random.Random(8)
    words = {"clean": "river stone light green", "low": "buy cheap now sale", "toxic": "hate awful nasty vile"}
    rows = [(k, " ".join(r.choice(words[d].split()) for _ in range(r.randint(5, 40)))) for k, d in enumerate(r.choices(list(words), [5, 3, 2], k=400))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    domain = {w: d for d, ws in words.items() for w in ws.split()}
    labels = spark.createDataFrame([(k, domain[t.split()[0]]) for k, t in rows[:200]], "id long, domain string")
    out = mixing.mix(docs, labels, mixing.WEIGHTS)
    names = sorted(mixing.WEIGHTS)
    got = out.agg(*(F.sum(F.col("rate") * F.col("n_tokens") * F.get("posteriors", F.lit(i))).alias(d) for i, d in enumerate(names)), F.sum("n_tokens").alias("n")).first()
    assert all(abs(got[d] - mixing.WEIGHTS[d] * got["n"]) < 0.01 * got["n"] for d in names)
    # with classes as plain as these, the rate of each is its wished total over its own
    own = {d: sum(len(t.split()) for _, t in rows if domain[t.split()[0]] == d) for d in names}
    for x in out.join(docs, "doc_id").collect():
        d = domain[x["text"].split()[0]]
        assert x["rate"] == pytest.approx(mixing.WEIGHTS[d] * got["n"] / own[d], rel=0.15)
