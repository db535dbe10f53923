"""Toxicity: a support vector machine on a gap-tolerant subsequence string kernel with Nyström landmarks.

The kernel compares two strings by their common subsequences of three letters; a subsequence that
spans s characters weighs decay^s, spans over SPAN count nothing, and characters that are no letters
are gaps. An insult with dots, dashes, digits or letters put in keeps most of its subsequences. White space counts as a letter
of its own, so that where words begin and end is part of what is compared, and as a gap it costs what others do.

A document is cut into sentences. A sentence is compared whole and in all runs of SIZES adjacent words (insults of
several words, or with a blank put in, are runs too), each scaled to length one by its subsequences; it counts as its most suspicious run, and a document
as its most suspicious sentence. Training learns from the sentences of labelled documents: words and beginnings of words that stand
in toxic ones more than chance explains are the first examples; the machine that they and the clean sentences give then picks,
round by round, the run of each toxic document that speaks most for it, and of each clean one that speaks most against the
machine. Landmarks are drawn from the first examples and from the commonest clean units. Since kernel and Nyström map are linear in the subsequences, the trained
machine is one table of weights by subsequence, and all runs of a text are scored by sums over it.

Training reads at most `max_docs` labelled documents and `max_units` units, drawn by hash. Scoring reads
every whole text, in time and memory linear in its length. Defined results: null and blank texts have no runs and get the score of a
harmless document; rows with a null doc_id are scored and never held out; repeated rows get equal scores; with labels
of one class, or none, the score is 0; an empty table gives no rows; other columns are never read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .quality import bounded_sample, fold
from .runtime import discard, stored

DECAY, SPAN = 0.6, 7
#: Letters: 0 is a gap, EDGE white space, from SHARED on all letters that have no number of their own.
LETTERS, EDGE, SHARED = 96, 59, 60
#: Words of a run; letters of a beginning of a word.
SIZES, STEM = (1, 2, 4), 5
THRESHOLD = 0.7
ROWS, CHARS = 512, 1 << 19
#: Odd multiplier of the hash of a word.
FACTOR = np.uint64(0x9E3779B97F4A7C15)


def _alphabet() -> np.ndarray:
    """Letter number by code point: the Latin letters of ASCII and Latin-1, then shared numbers."""
    table = np.zeros(0x250, np.int32)
    table[ord("a") : ord("z") + 1] = np.arange(1, 27)
    for k, c in enumerate(range(0xDF, 0x100)):
        table[c] = min(27 + k, EDGE - 1)
    table[0xF7] = 0
    table[0x100:] = SHARED + np.arange(0x150) % (LETTERS - SHARED)
    table[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 0x85, 0xA0]] = EDGE
    return table


ALPHABET = _alphabet()
#: White space beyond it.
WIDE = np.array([0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000], np.uint32)


class Runs:
    """Texts as one array of letters, with their words and sentences."""

    def __init__(self, texts: list[str]):
        low = [t.lower() for t in texts]
        self.joined = "\n" + "\n".join(low) + "\n"
        u = np.frombuffer(self.joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        c = ALPHABET[np.minimum(u, len(ALPHABET) - 1)]
        far = np.flatnonzero(u >= len(ALPHABET))
        c[far] = np.where(np.isin(u[far], WIDE), EDGE, SHARED + u[far] % (LETTERS - SHARED))
        space = c == EDGE
        before = np.append(np.uint32(10), u[:-1])
        ends = np.cumsum((u == 10) | (space & np.isin(before, [ord(x) for x in ".!?"])))
        at = np.flatnonzero(~(space & np.append(False, space[:-1])))  # a run of white space is one edge
        self.at, self.letters = at, c[at]
        #: Word k stands between the edges k and k + 1.
        self.edges = np.flatnonzero(self.letters == EDGE)
        first = at[self.edges[:-1] + 1] if len(self.edges) > 1 else np.zeros(0, np.int64)
        self.sentence = ends[first]
        self.doc = np.searchsorted(np.cumsum([1, *(len(t) + 1 for t in low)]), first, "right") - 1

    def repeats(self) -> np.ndarray:
        """For each word the last word up to it that has a later equal up to it, or -1."""
        a, b = self.edges[:-1], self.edges[1:]
        power = np.multiply.accumulate(np.full(int((b - a).max()) + 1, FACTOR, np.uint64))
        value = self.letters.astype(np.uint64) + np.uint64(1)
        inside = np.arange(len(value)) - np.repeat(np.append(a, len(value) - 1), np.append(b - a, 1))
        code = np.add.reduceat((value * power[inside])[: self.edges[-1]], a)
        order = np.lexsort((np.arange(len(code)), code))
        before = np.full(len(code), -1)
        same = code[order][1:] == code[order][:-1]
        before[order[1:][same]] = order[:-1][same]
        return np.maximum.accumulate(before)

    def spans(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """First word, and the word after the last, of all runs within a sentence; each time sorted. A run that repeats
        one of its words says no more than its parts do and is left out."""
        begins = np.flatnonzero(np.append(True, np.diff(self.sentence) != 0))
        ends = np.append(begins[1:], len(self.sentence))
        repeats = self.repeats()
        for size in (*SIZES, None):
            if size is None:  # whole sentences
                keep = ends - begins > SIZES[-1]
                i, j = begins[keep], ends[keep]
            else:
                i = np.arange(len(self.sentence) - size + 1)
                i = i[self.sentence[i] == self.sentence[i + size - 1]]
                j = i + size
            ok = repeats[j - 1] < i
            yield i[ok], j[ok]

    def text(self, i: int, j: int) -> str:
        return " ".join(self.joined[self.at[self.edges[i]] : self.at[self.edges[j]]].split())

    def codes(self) -> Iterator[tuple[int, float, np.ndarray]]:
        """Length and weight of a kind of subsequence of three letters, and by its first character the codes (0 with a gap in it)."""
        c = self.letters.astype(np.int32)
        for last in range(2, SPAN):
            x, z = c[:-last], c[last:]
            for middle in range(1, last):
                y = c[middle : middle - last]
                yield last, DECAY ** (last + 1), np.where((x > 0) & (y > 0) & (z > 0), (x * LETTERS + y) * LETTERS + z, 0)

    def sums(self, table: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """By length: running sums of the weights in a table (0 for gaps) and of the squares of the subsequences' own weights."""
        value = [np.zeros(len(self.letters) + 1) for _ in range(2, SPAN)]
        square = [np.zeros_like(v) for v in value]
        for last, weight, code in self.codes():
            value[last - 2][1 : len(code) + 1] += table[code] * weight
            square[last - 2][1 : len(code) + 1] += (code > 0) * weight**2
        return [np.cumsum(v) for v in value], [np.cumsum(v) for v in square]

    def margins(self, sums: tuple[list[np.ndarray], list[np.ndarray]], i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Sum over the subsequences inside each run, edges included, scaled by their length."""
        a, b = self.edges[i], self.edges[j] + 1
        total = [np.zeros(len(a)), np.zeros(len(a))]
        for last in range(2, SPAN):
            end = np.maximum(a, b - last)
            for out, part in zip(total, sums, strict=True):
                out += part[last - 2][end] - part[last - 2][a]
        return total[0] / np.sqrt(np.maximum(total[1], 1e-12))


class Landmarks:
    """Feature rows of a few strings over the codes that they hold."""

    def __init__(self, strings: list[str]):
        held = list(_features(strings))
        self.codes = np.unique(np.concatenate([code for _, code, _ in held])) if held else np.zeros(0, np.int32)
        self.place = np.full(LETTERS**3, len(self.codes), np.int32)
        self.place[self.codes] = np.arange(len(self.codes))
        self.table = np.zeros((len(self.codes), len(strings)))
        for owner, code, weight in held:
            np.add.at(self.table, (self.place[code], owner), weight)

    def kernel(self, strings: list[str]) -> np.ndarray:
        """Kernel values of strings with the landmarks."""
        out = np.zeros((len(strings), self.table.shape[1]))
        for owner, code, weight in _features(strings):
            known = np.flatnonzero(self.place[code] < len(self.codes))  # in the order of their owners
            for a in range(0, len(known), 1 << 14):
                k = known[a : a + (1 << 14)]
                cut = np.flatnonzero(np.append(True, np.diff(owner[k]) != 0))
                out[owner[k][cut]] += np.add.reduceat(weight[k, None] * self.table[self.place[code[k]]], cut, axis=0)
        return out

    def weights(self, w: np.ndarray) -> np.ndarray:
        """The weight of each code when landmark values are weighted by w."""
        out = np.zeros(LETTERS**3)
        out[self.codes] = self.table @ w
        return out


def _features(strings: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Number of the string, code and weight of the subsequences of one kind after the other; each string is one run, scaled to length one."""
    if not strings:
        return
    r = Runs(strings)
    if not len(r.edges) > 1:
        return
    i = np.flatnonzero(np.append(True, np.diff(r.doc) != 0))
    a, b = r.edges[i], r.edges[np.append(i[1:], len(r.doc))]
    length = np.zeros(len(strings))
    place = np.searchsorted(a, np.arange(len(r.letters)), "right") - 1
    kinds = []
    for last, weight, code in r.codes():
        own = place[: len(code)]
        ok = np.flatnonzero((code > 0) & (own >= 0) & (np.arange(len(code)) + last <= b[np.maximum(own, 0)]))
        kinds.append((r.doc[i[own[ok]]], code[ok], weight))
        length += np.bincount(kinds[-1][0], minlength=len(strings)) * weight**2
    scale = 1 / np.sqrt(np.maximum(length, 1e-12))
    for owner, code, weight in kinds:
        yield owner, code, weight * scale[owner]


@dataclass
class Machine:
    """Weights by subsequence, bias, and the logistic curve from a document's margin to its score."""

    table: np.ndarray
    bias: float
    slope: float
    centre: float

    def best(self, texts: list[str]) -> tuple[np.ndarray, list[str | None]]:
        """Margin of each text, that of its most suspicious run, and the run. Long texts are read in stretches, so memory follows these."""
        margin, found = np.full(len(texts), -np.inf), [None] * len(texts)
        parts = [(k, p) for k, t in enumerate(texts) for p in stretches(t)]
        at = 0
        while at < len(parts):
            to, n = at + 1, len(parts[at][1])
            while to < len(parts) and n + len(parts[to][1]) <= 2 * CHARS:
                n += len(parts[to][1])
                to += 1
            for (k, _), m, f in zip(parts[at:to], *self._best([p for _, p in parts[at:to]]), strict=True):
                if m > margin[k]:
                    margin[k], found[k] = m, f
            at = to
        return np.where(np.isfinite(margin), margin, 0) + self.bias, found

    def _best(self, texts: list[str]) -> tuple[np.ndarray, list[str | None]]:
        margin, where = np.full(len(texts), -np.inf), [None] * len(texts)
        r = Runs(texts)
        if len(r.edges) < 2:
            return margin, where
        sums = r.sums(self.table)
        for i, j in r.spans():
            if not len(i):
                continue
            m, doc = r.margins(sums, i, j), r.doc[i]
            cut = np.flatnonzero(np.append(True, np.diff(doc) != 0))
            top = np.maximum.reduceat(m, cut)
            for d, value, a, b in zip(doc[cut].tolist(), top.tolist(), cut.tolist(), [*cut[1:].tolist(), len(m)], strict=True):
                if value > margin[d]:
                    k = a + int(np.argmax(m[a:b]))
                    margin[d], where[d] = value, (int(i[k]), int(j[k]))
        return margin, [r.text(*w) if w else None for w in where]

    def score(self, margin: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * (margin - self.centre), -50, 50)))


_SENTENCE = re.compile("\n|[.!?](?=[ \n])").search


def stretches(text: str) -> list[str]:
    """A text in stretches of about CHARS characters that end with a sentence."""
    out, at = [], 0
    while len(text) - at > 2 * CHARS and (end := _SENTENCE(text, at + CHARS)):
        out.append(text[at : end.end()])
        at = end.end()
    return [*out, text[at:]]


def portions(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Rows of at most ROWS texts and about CHARS characters, or of one longer text."""
    for batch in batches:
        texts = [t or "" for t in batch.column("text").to_pylist()]
        at = 0
        while at < len(texts):
            to, n = at + 1, len(texts[at])
            while to < len(texts) and to - at < ROWS and n + len(texts[to]) <= CHARS:
                n += len(texts[to])
                to += 1
            yield batch.slice(at, to - at), texts[at:to]
            at = to


def fit_svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2, rounds: int = 30) -> tuple[np.ndarray, float]:
    """Linear machine with squared hinge loss by Newton steps; y is -1 or 1."""
    x = np.append(x, np.ones((len(x), 1)), axis=1)
    w = np.zeros(x.shape[1])
    weight = weight / weight.sum()
    for _ in range(rounds):
        slack = 1 - y * (x @ w)
        on = slack > 0
        xa, wa = x[on], weight[on]
        gradient = ridge * w - 2 * xa.T @ (wa * y[on] * slack[on])
        hessian = ridge * np.eye(len(w)) + 2 * (xa * wa[:, None]).T @ xa
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def fit_curve(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and centre of the logistic curve, by Newton steps with softened targets."""
    n1, n0 = y.sum(), len(y) - y.sum()
    target = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x = np.stack([margin, np.ones(len(margin))], axis=1)
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -50, 50)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + 1e-6 * np.eye(2), x.T @ (p - target) + 1e-6 * w)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(-w[1] / w[0]) if w[0] else 0.0


def unit_rows(rows: DataFrame) -> DataFrame:
    """unit, n_toxic, n_clean: after how many different words each word and beginning of a word stands in toxic and other documents.

    Copies of a document repeat a unit after the same word, so they count once. rows: text, toxic.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = set()
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                found = (text or "").lower().split()
                before, bad = ["", *found[:-1]], [toxic > 0] * len(found)
                seen.update(zip(found, before, bad, strict=True))
                seen.update((w[:STEM], b, t) for w, b, t in zip(found, before, bad, strict=True) if len(w) > STEM)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*seen, strict=True) if seen else [[]] * 3, (pa.string(), pa.string(), pa.bool_()), strict=True)], names=["unit", "before", "bad"])

    found = rows.select("text", "toxic").mapInArrow(run, "unit string, before string, bad boolean").distinct()
    return found.groupBy("unit").agg(F.count_if("bad").alias("n_toxic"), F.count_if(~F.col("bad")).alias("n_clean"))


def training_rows(docs: DataFrame, labels: DataFrame, folds: int, held_out: int, max_docs: int) -> DataFrame:
    """text and toxic of labelled documents outside the held-out fold; the sample is drawn from the labels, so the documents are not shuffled."""
    known = labels.where(F.col("toxic").isNotNull() & (fold(F.col("doc_id"), folds) != held_out)).select("doc_id", "toxic")
    sample = stored(bounded_sample(known, max_docs), "toxic-labels")
    spread = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return stored(docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("text", "toxic").repartition(spread), "toxic-sample")  # max_docs ids


def put_forward(rows: DataFrame, machine: Machine) -> DataFrame:
    """The most suspicious run of each labelled document: one that speaks for a toxic document, or against the machine."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in portions(batches):
            margin, best = machine.best(texts)
            bad = [t > 0 for t in batch.column("toxic").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(best, pa.string()), pa.array(margin, pa.float64()), pa.array(bad, pa.bool_())], names=["unit", "margin", "bad"])

    return rows.select("text", "toxic").mapInArrow(run, "unit string, margin double, bad boolean")


class Space:
    """The Nyström map of a set of landmarks."""

    def __init__(self, strings: list[str]):
        self.marks = Landmarks(strings)
        value, vector = np.linalg.eigh(self.marks.table.T @ self.marks.table)
        self.root = vector[:, value > 1e-3] / np.sqrt(value[value > 1e-3])

    def __call__(self, strings: list[str]) -> np.ndarray:
        return self.marks.kernel(strings) @ self.root

    def machine(self, strings: list[str], y: np.ndarray, weight: np.ndarray, ridge: float = 1e-4) -> Machine:
        w, bias = fit_svm(self(strings), y, weight, ridge)
        return Machine(self.marks.weights(self.root @ w), bias, 1.0, 0.0)


def fit(docs: DataFrame, labels: DataFrame, folds: int = 3, held_out: int = 1, landmarks: int = 160, max_docs: int = 12_000, max_units: int = 16_000, rounds: int = 6) -> Machine:
    rows = training_rows(docs, labels, folds, held_out, max_docs)
    nothing = Machine(np.zeros(LETTERS**3), -1.0, 1.0, 50.0)
    counted = stored(unit_rows(rows), "units")
    total = counted.agg(F.sum("n_toxic"), F.sum("n_clean")).first()
    if not total[0] or not total[1]:
        return nothing
    # surplus in toxic documents, in standard deviations of what the clean ones lead to expect
    expected = (F.col("n_clean") + 0.5) * (total[0] / total[1])
    counted = counted.withColumn("lift", (F.col("n_toxic") - expected) / F.sqrt(expected))
    suspect = counted.where((F.col("n_toxic") >= 3) & (F.col("lift") > 5) & (F.col("n_toxic") > 2 * expected)).orderBy(F.desc(F.col("lift") * F.sqrt("n_toxic")), "unit").limit(landmarks).toPandas()
    clean = counted.where("n_clean >= 1 and lift < 2").orderBy(F.desc("n_clean"), "unit").limit(max_units // 2).toPandas()
    rare = counted.where("n_clean = 1 and n_toxic = 0").orderBy(F.xxhash64("unit"), "unit").limit(max_units // 2).toPandas()
    discard(counted)
    if not len(suspect) or not len(clean):
        return nothing
    harmless = dict.fromkeys([*clean["unit"], *rare["unit"]], 1.0)
    witness = {u: float(n) for u, n in zip(suspect["unit"], suspect["n_toxic"], strict=True)}
    space = Space(list(dict.fromkeys([*suspect["unit"][: landmarks // 2], *clean["unit"][: landmarks // 2]])))
    machine = nothing
    for _ in range(rounds):
        if not witness:
            break
        strings = [*witness, *(u for u in harmless if u not in witness)]
        n = len(witness)
        weight = np.sqrt([*witness.values(), *(harmless[u] for u in strings[n:])])
        weight[:n] /= weight[:n].sum()
        weight[n:] /= weight[n:].sum()
        machine = space.machine(strings, np.where(np.arange(len(strings)) < n, 1.0, -1.0), weight)
        best = put_forward(rows, machine).toPandas()
        witness, against = {}, {}
        for u, margin, bad in zip(best["unit"], best["margin"], best["bad"], strict=True):
            if u is None:
                continue
            if not bad:
                against[u] = against.get(u, 0.0) + 1
            elif margin > 0:
                witness[u] = witness.get(u, 0.0) + 1
        witness = {u: n for u, n in witness.items() if against.get(u, 0) < n}
        harmless |= {u: 20.0 + n for u, n in against.items() if u not in witness}
    machine.slope, machine.centre = fit_curve(best["margin"].to_numpy(), best["bad"].to_numpy(float))
    discard(rows)
    return machine


def scored(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """doc_id, score and, of documents over the threshold, the most suspicious run of words."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, **options))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = model.value
        for batch, texts in portions(batches):
            margin, found = machine.best(texts)
            score = machine.score(margin)
            found = [f if s >= THRESHOLD else None for f, s in zip(found, score.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(score, pa.float64()), pa.array(found, pa.string())], names=["doc_id", "score", "found"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double, found string")
