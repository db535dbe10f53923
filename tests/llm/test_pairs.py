"""MinHash groups, token alignment and hard negatives against brute force."""

import collections
import hashlib
import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cardmart.llm import alignment, hard_negatives, minhash, queries

from ..oracle import compare, connect
from .test_ops import SCHEMA, TEXTS, WORDS, columns

SF = "/root/testdata/sf0.001"
BPE, PIECES = queries.vocabulary("byte_bpe_50k.json"), queries.vocabulary("piece_bpe_32k.model")


# MinHash


def shingles(text):
    lower = (text or "").translate({k: k + 32 for k in range(65, 91)})
    w = WORDS.findall(lower)
    return set(w) if len(w) < 2 else {f"{a} {b}" for a, b in zip(w, w[1:], strict=False)}


def brute_components(rows):
    """component by brute force, for rows of (doc_id, text); a null id names nothing."""
    sets = [shingles(t) for _, t in rows]
    label = list(range(len(rows)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= 80 * len(a | sets[j]):
                label[find(i)] = find(j)
    least = collections.defaultdict(list)
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)].append(i)
    return sorted(((i, len(s), min(least[find(k)], default=None)) for k, ((i, _), s) in enumerate(zip(rows, sets, strict=True))), key=str)


def groups(spark, rows, **options):
    docs = spark.createDataFrame(columns(rows), SCHEMA).repartition(3)
    got = minhash.near_groups(docs, **options).collect()
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str)


def near_copies(seed, families, members, length, edits):
    """Families of texts that differ from a common one in a few words, so that similarities lie on both sides of 0.8."""
    rnd = random.Random(seed)
    out = []
    for f in range(families):
        base = [f"w{rnd.randrange(5000)}" for _ in range(length)]
        for _ in range(members):
            w = list(base)
            for _ in range(rnd.randrange(edits + 1)):
                w[rnd.randrange(length)] = f"x{rnd.randrange(10**6)}"
            out.append((len(out) + 100 * f, " ".join(w)))
    rnd.shuffle(out)
    return out


def test_minhash_odd_rows(spark):
    assert groups(spark, TEXTS) == brute_components(TEXTS)
    empty = spark.createDataFrame([], SCHEMA)
    assert minhash.near_groups(empty).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_minhash_near_the_limit(spark, seed):
    rows = near_copies(seed, 12, 12, 60, 8)
    assert groups(spark, rows) == brute_components(rows)


def test_minhash_clusters_compare_shingles_as_unsigned():
    """Shingle hashes on both sides of 2^63: sets that share 53 of 65 shingles are linked, those that share 52 of 66 are not."""
    rnd = random.Random(4)
    common, own = ([rnd.randrange(1 << 64) for _ in range(59)] for _ in range(2))
    assert 10 < sum(x >= 1 << 63 for x in common) < 49
    for shared, links in ((53, [(1, 2)]), (52, [])):
        sets = [np.unique(np.array(x, np.uint64)) for x in (common, common[:shared] + own[shared:])]
        minima = [np.zeros(minhash.MINIMA, "<u4").tobytes()] * 2
        table = pa.table({"node": [1, 2], "comp": [1, 2], "block": [0, 0], "i": [0, 0], "j": [0, 0], "minima": pa.array(minima, pa.binary()), "shingles": pa.array([x.view(np.int64) for x in sets], pa.list_(pa.int64()))})
        assert [tuple(x.values()) for x in minhash.linking(77)(table).to_pylist()] == links


def test_minhash_crowded_buckets(spark):
    """Buckets above the bound are dealt anew by longer bands and in blocks; nothing is lost."""
    passage = " ".join(f"p{k}" for k in range(40))
    rows = near_copies(3, 4, 10, 60, 9)
    rows += [(10_000 + k, passage + " " + " ".join(f"q{k}-{j // 2}" for j in range(24))) for k in range(60)]  # share a passage, not more
    rows += [(20_000 + k, t + " tail") for k, (_, t) in enumerate(rows[-20:])]
    assert groups(spark, rows, crowd=3) == brute_components(rows)


def test_minhash_links_past_the_leader(spark):
    """A chain of texts, each like the next alone: whatever node leads, the ends meet."""
    w = [f"w{k}" for k in range(200)]
    rows = [(k, " ".join(w[4 * k : 4 * k + 60])) for k in range(30)]
    want = brute_components(rows)
    assert {c for *_, c in want} == {0}
    assert groups(spark, rows) == want


@pytest.mark.parametrize("shape", ["path", "star", "random"])
def test_stars(spark, shape):
    rnd = random.Random(4)
    n = 150
    if shape == "path":
        order = rnd.sample(range(n), n)
        edges = list(zip(order, order[1:], strict=False))
    elif shape == "star":
        edges = [(n, k) for k in range(n)] + [(k, k) for k in range(n)]
    else:
        edges = [(rnd.randrange(n), rnd.randrange(n)) for _ in range(90)] * 2
    label = {k: k for e in edges for k in e}
    for _ in range(n):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    got = {r.a: r.root for r in minhash.stars(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {a: r for a, r in label.items() if a != r}


def test_minima_estimate_similarity():
    rnd = np.random.default_rng(5)
    pool = rnd.integers(0, 1 << 63, 3000, np.uint64)
    a, b = pool[:2000], pool[500:2500]
    est = (minhash.signature(a) == minhash.signature(b)).mean()
    assert abs(est - 1500 / 2500) < 0.18
    assert (minhash.signature(pool) == np.minimum(minhash.signature(a), minhash.signature(pool[2000:]))).all()


# alignment


def naive_alignment(library, sp, spelled_a, spelled_b, text):
    """n_a, n_b, groups spelled out and the links of a text by plain loops."""
    if not text:
        return None
    whole = (" " + text).encode()
    a, b = library.encode(" " + text, add_special_tokens=False).ids, sp.encode(text)
    pa, pb = [spelled_a(i) for i in a], [spelled_b(i) for i in b]
    if b"".join(pa) != whole or b"".join(pb) != whole:
        return None
    ea, eb = np.cumsum([len(x) for x in pa]).tolist(), np.cumsum([len(x) for x in pb]).tolist()
    out, i, j = [], 0, 0
    for e in sorted(set(ea) & set(eb)):
        i2, j2 = next(k for k in range(i, len(ea)) if ea[k] == e) + 1, next(k for k in range(j, len(eb)) if eb[k] == e) + 1
        out.append(",".join(map(str, a[i:i2])) + "|" + ",".join(map(str, b[j:j2])))
        i, j = i2, j2
    sa, sb = [0, *ea], [0, *eb]
    links, first = [], 0
    for k, x in enumerate(a):
        while eb[first] <= sa[k]:
            first += 1
        m = first
        while m < len(b) and sb[m] < ea[k]:
            links.append((x, b[m]))
            m += 1
    return len(a), len(b), out, links


def naive_counts(texts):
    import sentencepiece
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(BPE)
    library.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    byte = alignment.byte_alphabet()
    spelled_a = lambda i: bytes(byte[c] for c in library.id_to_token(i))
    spelled_b = lambda i: bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode()
    found = [naive_alignment(library, sp, spelled_a, spelled_b, t) for t in texts]
    count = collections.Counter(pair for x in found if x for pair in set(x[3]))
    best = collections.defaultdict(int)
    for (a, _), n in count.items():
        best[a] = max(best[a], n)
    out = []
    for x in found:
        if x is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        n_a, n_b, spelled, links = x
        out.append((n_a, n_b, len(spelled), len(links), sum(count[p] == best[p[0]] for p in links), sum(count[p] for p in links), hashlib.sha256(";".join(spelled).encode()).hexdigest()))
    return out


NAMES = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
ALPHABET = ["the", "of", " ", "  ", "\n", "\t", "a", "Zebra", "é", "ß", "中文", "😀", "'s", "123", "<|endoftext|>", "</s>", "<unk>", "▁", ".", ",", "\x85", "\xa0", "　", "\x1c", "-", "don't", "\r\n", "\x00", "​", "é"]


@pytest.mark.parametrize("hot", [alignment.HOT, 4, 0])
def test_alignment_against_plain_loops(spark, hot):
    rnd = random.Random(6)
    texts = [(k, "".join(rnd.choice(ALPHABET) + (" " if rnd.random() < 0.6 else "") for _ in range(rnd.randint(1, 14)))) for k in range(250)]
    texts += [(i, t) for i, t in TEXTS if len(t or "") < 5000]
    docs = spark.createDataFrame(columns(texts), SCHEMA).repartition(3)
    got = alignment.aligned_counts(docs, BPE, PIECES, hot)
    assert got.columns == NAMES
    want = [(i, *x) for (i, _), x in zip(texts, naive_counts([t for _, t in texts]), strict=True)]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_alignment_of_long_and_empty(spark):
    long = [(1, "x" * 50_000), (2, "a b " * 20_000), (3, " " * 100_000), (4, "word\n" * 20_000), (5, "ab" * 30_000 + " end")]
    got = {r.doc_id: r for r in alignment.aligned_counts(spark.createDataFrame(columns(long), SCHEMA), BPE, PIECES).collect()}
    for i, t in long:
        aligner = alignment.Aligner(BPE, PIECES)
        n_a, n_b, *_ = aligner.run([t])[0]
        assert (got[i].n_a, got[i].n_b) == (n_a, n_b), i
        assert got[i].n_links == got[i].n_a + got[i].n_b - got[i].n_groups
    assert alignment.aligned_counts(spark.createDataFrame([], SCHEMA), BPE, PIECES).count() == 0


# hard negatives


def brute_negatives(rows):
    """rows: (vec_id, embedding, label)."""
    clean = []
    for i, x, label in rows:
        if i is None or x is None or label is None or any(c is None or not math.isfinite(c) for c in x):
            continue
        clean.append((i, [math.floor(256 * c) for c in x], (label + 1) % 10 if i % 7 == 0 else label))
    out = []
    for k, (i, x, label) in enumerate(clean):
        if i % 50:
            continue
        scored = [(-sum(a * b for a, b in zip(x, y, strict=False)), j, other) for m, (j, y, other) in enumerate(clean) if m != k]
        scored.sort()
        positives = [(-s, j) for s, j, other in scored if other == label][:5]
        for ps, p in positives:
            fits = [(-s, j) for s, j, other in scored if other != label and 50 * ps <= -100 * s <= 95 * ps][:3]
            out += [(i, p, r, j, ps, s) for r, (s, j) in enumerate(fits, 1)]
    return sorted(out)


VECTORS = "vec_id long, embedding array<float>, label int, score long, row long, tile int"


def mined(spark, rows, **options):
    df = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], VECTORS).repartition(3)
    out = hard_negatives.mine(df, **options)
    assert out.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(map(tuple, out.collect()))


def vectors(seed, n, dims, labels=3):
    rnd = np.random.default_rng(seed)
    centres = rnd.normal(size=(labels, dims))
    label = rnd.integers(0, labels, n)
    return [(k, (centres[label[k]] * 0.4 + rnd.normal(size=dims) * 0.2).astype(np.float32).tolist(), int(label[k])) for k in range(n)]


@pytest.mark.parametrize(("n", "dims", "size"), [(400, 8, 64), (300, 3, 8192), (500, 16, 32), (120, 1, 16)])
def test_negatives_against_brute_force(spark, n, dims, size):
    rows = vectors(n, n, dims)
    assert mined(spark, rows, size=size) == brute_negatives(rows)


def test_negatives_of_odd_rows(spark):
    rows = [(0, [1.0, 2.0], 1), (50, [1.0, 2.0], 1), (50, [1.0, 2.0], 1), (1, None, 1), (2, [1.0, None], 1), (3, [float("nan"), 1.0], 1), (4, [float("inf"), 1.0], 1), (5, [1.0, 1.0], None), (None, [1.0, 1.0], 2),
            (6, [], 2), (8, [1.0], 2), (9, [0.9, 1.5], 2), (10, [0.9, 1.5], 2), (11, [0.9, 1.5], 2), (12, [0.9, 1.5], 2), (100, [-1.0, -2.0], 4), (150, [0.0, 0.0], 5), (151, [0.0, 0.0], 5)]
    rows += [(1000 + k, [0.5, 1.25], k % 3) for k in range(200)]  # equal vectors fill one tile
    assert mined(spark, rows, size=16) == brute_negatives(rows)
    assert mined(spark, []) == []
    assert mined(spark, [(0, [1.0], 1)]) == []
    with pytest.raises(ValueError, match="2\\^53"):
        mined(spark, [(0, [3e8], 1), (1, [3e8], 1)])


def test_tree_prunes():
    rnd = np.random.default_rng(9)
    v = np.concatenate([rnd.normal(size=(1600, 6)) * 8 + c for c in rnd.normal(size=(12, 6)) * 400]).round()
    order = hard_negatives.str_order(v, [0, 1, 2, 3])
    assert sorted(order.tolist()) == list(range(len(v)))
    v = v[order]
    label = rnd.integers(0, 3, len(v))
    tree = hard_negatives.Tree(v, np.arange(len(v)), label, np.arange(len(v)))
    for k in range(0, len(v), 2401):
        scores = v @ v[k]
        best = sorted((-int(s), j) for j, s in enumerate(scores) if j != k and label[j] == label[k])[:5]
        far = np.array([2.0**53])
        got = tree.best(v[k], label[k], True, k, -far, far, -far, 5)[0]
        assert [(s, j) for s, j, *_ in got] == best
    assert tree.read < 0.3 * len(tree.levels[0][0]) * len(range(0, len(v), 2401))


@pytest.mark.parametrize("name", ["op11_minhash", "op13_hard_negatives"])
def test_pair_query_against_sql(spark, name):
    got, want = compare(spark, connect(SF), queries.QUERIES[name], queries.ORACLE_SQL[name], SF)
    assert got == want


def test_alignment_query(spark):
    docs = queries.table(spark, SF, "documents").collect()
    want = [(d.doc_id, *x) for d, x in zip(docs, naive_counts([d.text for d in docs]), strict=True)]
    assert sorted(map(tuple, queries.op12_token_alignment(spark, SF).collect())) == sorted(want)


def test_frequent_links(spark):
    counts = spark.createDataFrame([(k, n) for k, n in enumerate([1, 1, 1, 2, 3, 4, 9, 16])], "link long, n long")
    for most, least in ((8, 1), (7, 2), (5, 2), (4, 4), (3, 4), (2, 8), (1, 16), (0, 32)):
        assert alignment.frequent(counts, most) == least
        assert counts.where(F.col("n") >= least).count() <= most
