"""Very long texts, crowded spans, samples far below a millionth and repeated ids: results stay whole, time and memory follow the text."""

import random
import re
import time
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from cardmart.llm import line_dedup, packing, pii, quality, queries, runtime, toxicity

BPE = queries.vocabulary("byte_bpe_50k.json")


@pytest.mark.parametrize("text", [" " * 1_200_000, "\n" * 1_200_000, "x" * 1_000_000, "ab \n" * 300_000, "word" + "\t " * 600_000 + "end", " " * 10_000, " " * 10_001])
def test_encoder_takes_texts_of_any_runs(text):
    from tokenizers import Tokenizer

    want = Tokenizer.from_file(BPE).encode(text, add_special_tokens=False).ids
    assert np.frombuffer(packing.Encoder(BPE)(text), np.uint32).tolist() == want


def test_packing_of_blank_texts(spark):
    docs = spark.createDataFrame([(1, " " * 1_000_000), (2, "\n" * 1_000_000), (3, "a")], "doc_id long, text string")
    rows = packing.pack(docs, BPE).groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("length").alias("most")).collect()
    assert {r.doc_id for r in rows} == {1, 2, 3} and all(r.most <= 1024 for r in rows)


def naive_chosen(spans, w):
    taken = [(s["start"], s["end"]) for s in spans if s["base"]]
    out = [(s["kind"], s["start"], s["end"], True) for s in spans if s["base"]]
    rest = [s for s in spans if not s["base"]]
    good = pii.probability(w, [s["seen"] for s in rest]) > 0.5 if rest else []
    for s in sorted((s for s, g in zip(rest, good, strict=True) if g), key=lambda s: (s["start"], s["end"])):
        if all(s["end"] <= a or s["start"] >= b for a, b in taken):
            out.append((s["kind"], s["start"], s["end"], False))
            taken.append((s["start"], s["end"]))
    return sorted(out, key=lambda s: (pii.KINDS.index(s[0]), s[1]))


def some_spans(rnd, n, width):
    out = []
    for _ in range(n):
        a = rnd.randrange(width)
        out.append({"kind": rnd.choice(pii.KINDS), "start": a, "end": a + rnd.randrange(1, 12), "base": rnd.random() < 0.3, "seen": [rnd.randrange(pii.WIDTH)]})
    return out


def test_added_spans_never_overlap():
    rnd = random.Random(2)
    w = np.append(np.where(np.arange(pii.WIDTH) % 3, 1.0, -1.0), 0.0)
    for _ in range(300):
        spans = some_spans(rnd, rnd.randrange(30), 120)
        assert pii.chosen(spans, w) == naive_chosen(spans, w)
    times = []
    for n in (20_000, 40_000, 80_000):
        spans = some_spans(rnd, n, 20 * n)
        began = time.perf_counter()
        pii.chosen(spans, w)
        times.append(time.perf_counter() - began)
    assert times[2] < 9 * times[0] + 0.5


WHOLE_BLOCK = line_dedup.BLOCK.removesuffix(r"\z") + ">"


def naive_lines(html):
    for whole, _ in line_dedup.HIDDEN:
        html = re.sub(whole, "", html)
    html = re.sub(line_dedup.TAG, "", re.sub(WHOLE_BLOCK, "\n", html))
    return [x for x in (p.strip(" ") for p in html.split("\n")) if x]


def test_lines_of_broken_pages(spark):
    rnd = random.Random(3)
    bits = ["<p", "<p>", "</p>", "<div class='a>b'", " ", ">", "<", "text", "\n", "<script>", "<script ", "</script>", "</script >", "<style>", "</style>", "<!--", "-->", "<!-->", "<br/>", "<br / >", "<pre", "<prex>", "<b>", "/", "a<b", "<H1 x>", "</SCRIPT\n>"]
    pages = ["".join(rnd.choice(bits) for _ in range(rnd.randrange(14))) for _ in range(1500)]
    rows = spark.createDataFrame(list(enumerate(pages)), "k int, html string").select("k", line_dedup.html_lines(F.col("html")).alias("lines")).collect()
    for r in rows:
        assert r.lines == naive_lines(pages[r.k]), pages[r.k]


@pytest.mark.parametrize("piece", ["<p ", "<script ", "<!-- ", "<style>x", "</p "])
def test_unclosed_tags_cost_their_length(spark, piece):
    def seconds(n):
        df = spark.createDataFrame([(piece * n,)], "html string")
        began = time.perf_counter()
        df.select(F.size(line_dedup.html_lines(F.col("html"))).alias("n")).collect()
        return time.perf_counter() - began

    seconds(100)
    assert seconds(200_000) < 10  # 3 KB took a second when each opening was read to the end


def test_samples_far_below_a_millionth(spark):
    df = spark.range(400_000)
    place = runtime.share_of(F.xxhash64("id"))
    low, high, mean = df.agg(F.min(place), F.max(place), F.avg(place)).first()
    assert 0 <= low < 1e-4 and 1 - 1e-4 < high < 1 and abs(mean - 0.5) < 0.01
    few = df.where(runtime.share_of(F.xxhash64("id")) < 2e-5).count()
    assert 0 < few < 30  # a millionth's digits alone would give what 1e-6 steps give
    h = F.lit(5_000_000).cast("long")
    inside = spark.range(1).select(runtime.share_of(h).alias("s")).first().s
    assert 0 < inside < 1e-6  # below a millionth rows still differ


def test_a_labelled_id_with_many_copies(spark):
    docs = spark.createDataFrame([(k % 60, f"text number {k} with words {'good ' * (k % 7)}") for k in range(3000)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)] * 3, "doc_id long, quality int")
    seen = []
    real, quality.fit_trees = quality.fit_trees, lambda x, y: seen.append(len(x)) or real(x, y)
    try:
        quality.fit(docs, labels, max_rows=200)
    finally:
        quality.fit_trees = real
    assert seen and seen[0] <= 60


def machine():
    rnd = np.random.default_rng(1)
    return toxicity.Machine(rnd.normal(size=toxicity.LETTERS**3) * (rnd.random(toxicity.LETTERS**3) < 0.05), 0.1, 1.0, 0.0)


def test_long_texts_are_read_in_stretches(monkeypatch):
    rnd = random.Random(4)
    text = "".join(rnd.choice(["word ", "you fool. ", "a b! ", "x\n", "..  ", "idiot? no ", "\t"]) for _ in range(3000))
    m = machine()
    whole = m._best([text])
    monkeypatch.setattr(toxicity, "CHARS", 500)
    parts = toxicity.stretches(text)
    assert "".join(parts) == text and len(parts) > 10
    margin, found = m.best([text, "", "no end " * 500])
    assert margin[0] == pytest.approx(whole[0][0] + m.bias) and found[0] == whole[1][0]
    assert margin[1] == m.bias and found[1] is None


def test_memory_of_a_long_text_is_that_of_a_stretch():
    m = machine()
    peaks = []
    for n in (1, 4):
        text = "some words that say little. " * (n * 80_000)
        tracemalloc.start()
        m.best([text])
        peaks.append(tracemalloc.get_traced_memory()[1] - len(text) * 2)
        tracemalloc.stop()
    assert peaks[1] < 1.3 * peaks[0]


@pytest.mark.parametrize(("capacity", "limit"), [(64, 4), (1024, 16), (32, 1)])
def test_bins_against_a_naive_best_fit(capacity, limit):
    """Each piece goes to the fullest open bin that takes it; where all are open, the fullest closes."""
    rnd = random.Random(capacity)
    bins, naive, free = packing.OpenBins(capacity, limit), {}, {}
    for _ in range(4000):
        length = min(capacity, max(1, int(rnd.expovariate(4 / capacity))))
        number, offset = bins.place(length)
        fits = [f for f in naive.values() if f >= length]
        before = naive.pop(number, capacity)
        assert before == min(fits, default=capacity) and offset == capacity - before
        assert free.get(number, capacity) == before  # gapless
        rest = free[number] = before - length
        if rest:
            if len(naive) == limit:
                fullest = min(naive.values())
                if rest <= fullest:
                    continue
                open_bins = {b for frees in bins.by_free for b in frees}
                closed = [n for n, f in naive.items() if n not in open_bins]
                assert [naive[n] for n in closed] == [fullest]
                del naive[closed[0]]
            naive[number] = rest
    assert len(naive) <= limit


def plain_margin(model, row):
    """A row's margin by walking each tree node after node."""
    binned = [sum(e <= x for e in edges) for x, edges in zip(row, model.edges, strict=True)]
    total = model.base
    for feature, cut, leaf in zip(model.feature, model.bin, model.leaf, strict=True):
        node = 0
        while node < len(feature):
            node = 2 * node + 1 + int(binned[feature[node]] > cut[node])
        total += leaf[node - len(feature)]
    return total


def test_tree_margins_against_plain_walks():
    rnd = np.random.default_rng(8)
    x = rnd.normal(size=(600, 5)).round(1)
    model = quality.fit_trees(x, (x[:, 0] + x[:, 1] * x[:, 2] > 0.3).astype(float), trees=12)
    got = model.margin(x)
    assert np.allclose(got, [plain_margin(model, row) for row in x]) and len(set(got.round(6))) > 20
