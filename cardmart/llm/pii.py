"""Personal data by weak supervision.

Patterns find candidate spans. Labelers that look at different evidence vote for or against each of them, or not at all:
a checksum or range rule on its digits, gazetteers (top-level domains, calling codes, issuer numbers, reserved networks), its form
(grouping, lengths), the words on its left, the words on its right, and the characters that touch it. Whether a base pattern matched is no vote.
How often each pattern of votes occurs is counted over the whole corpus; expectation-maximisation estimates from those counts how
reliable each labeler is. Its posteriors are the targets of the span classifier, a logistic model that sees no votes
but the span and its surroundings: kind, character shapes, length, neighbouring words. It learns from at most `max_spans` candidates,
drawn by hash; only they and the table of vote patterns, bounded by the votes there can be, reach the driver.

Spans of the four base kinds that pass their checks always stay; the classifier adds others, where they
overlap no base span. Spans are in code points, the end exclusive. Matching is linear in the text's
length whatever the text, and no match is cut short for its length.

Defined results: null text counts as the empty text and has no spans; repeated rows get equal spans; rows
with a null doc_id are searched like others; a corpus without candidates gives empty results; an empty
table gives no rows; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .runtime import share_of, stored

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "secret", "ssn")
LABELERS = ("checksum", "gazetteer", "form", "left", "right", "edges")
#: Places of the classifier's hashed inputs.
WIDTH = 1024

# fixed values: the base patterns' parts, words and lists that the labelers know
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
NUMBERS = re.compile(r"[0-9]++(?:\.[0-9]++)++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
AT = re.compile(r"[\x20]?(?:\(at\)|\[at\]|\{at\})[\x20]?", re.I)
DOT_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:[\x20]?(?:\.|\(dot\)|\[dot\]|\{dot\})[\x20]?[A-Za-z0-9-]++)++", re.I)
LOCAL_PHONE = re.compile(r"(?<![0-9+])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])")
SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
SECRET = re.compile(r"\b(?:token|secret|passw(?:or)?d|api[_-]?key|access[_-]?key)\b[\x20]{0,3}[:=][\x20]{0,3}[\"']?([A-Za-z0-9+/_-]{16,}+)", re.I)
DOMAINS = frozenset("com org net edu gov info io de fr es uk eu ch at it nl be pl us ca au example".split())
CODES = ("1", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "51", "52", "54", "55", "61", "64", "65", "81", "82", "86", "90", "91", "351", "353", "358", "420")
ISSUERS = ("2", "34", "35", "36", "37", "38", "4", "5", "60", "62", "64", "65")
CUES = {
    "email": ("mail", "contact", "write"), "ip": ("ip", "host", "server", "address"), "card": ("card", "visa", "mastercard", "amex", "credit"),
    "phone": ("phone", "tel", "call", "fax", "mobile", "contact"), "secret": ("token", "secret", "key", "password"), "ssn": ("ssn", "social", "security"),
}
DENIALS = frozenset("version isbn issn order invoice serial part article ref".split())
UNITS = frozenset("pieces items units copies pages km kg eur usd percent times".split())
WORD = re.compile(r"[^\W\d_]+")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            end = found.end()
        at = text.find("@", max(at + 1, end))


def addresses(text: str) -> Iterator[tuple[int, int, bool]]:
    """Runs of four dotted numbers, and whether all are at most 255."""
    for chain in NUMBERS.finditer(text):
        parts, at = chain.group().split("."), chain.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            length = sum(map(len, four)) + 3
            yield at, at + length, all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in four)
            at += length + 1


def base_spans(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Spans of the base kinds, and matches of their patterns that fail the checks."""
    good: list[tuple[str, int, int]] = []
    bad: list[tuple[str, int, int]] = []
    good += (("email", a, b) for a, b in emails(text))
    for a, b, ok in addresses(text):
        (good if ok else bad).append(("ip", a, b))
    for m in CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19:
            (good if luhn(digits) else bad).append(("card", *m.span()))
    for m in PHONE.finditer(text) if "+" in text else ():
        n = sum("0" <= c <= "9" for c in m.group())
        if n <= 30:
            (good if 8 <= n <= 15 else bad).append(("phone", *m.span()))
    return good, bad


def loose_spans(text: str) -> list[tuple[str, int, int]]:
    """Candidates that the base patterns do not know."""
    out, end = [], 0
    for m in AT.finditer(text):
        start = m.start()
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        end = m.end()
        rest = DOT_DOMAIN.match(text, m.end())
        if start < m.start() and rest:
            out.append(("email", start, rest.end()))
    out += (("phone", *m.span()) for m in LOCAL_PHONE.finditer(text))
    out += (("ssn", *m.span()) for m in SSN.finditer(text))
    out += (("secret", *m.span(1)) for m in SECRET.finditer(text))
    return out


def checksum(kind: str, span: str, digits: str) -> str:
    """Whether the digits can be what the kind says, by rule."""
    if kind == "card":
        return "+" if 16 <= len(digits) <= 19 and luhn(digits) else "-"
    if kind == "ip":
        return "+" if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in span.split(".")) else "-"
    if kind == "phone":
        return "+" if 8 <= len(digits) <= 15 and len(set(digits)) > 2 else "-"
    if kind == "ssn":
        return "-" if digits[:3] in ("000", "666") or digits[0] == "9" or digits[3:5] == "00" or digits[5:] == "0000" else "+"
    if kind == "secret":
        return "+" if digits and len(set(span)) >= 8 else "-"
    return "0"


def gazetteer(kind: str, span: str, digits: str) -> str:
    """What lists know of the span."""
    if kind == "email":
        return "+" if re.split(r"[\x20.(){}\[\]]+", span.lower())[-1] in DOMAINS else "-"
    if kind == "phone":
        return ("+" if digits.startswith(CODES) else "-") if span[0] == "+" else "0"
    if kind == "card":
        return "+" if digits.startswith(ISSUERS) else "-"
    if kind == "ip":
        first = span.split(".")[0].lstrip("0")
        return "-" if first in ("", "127", "255") else "0"
    if kind == "secret":
        return "-" if WORD.fullmatch(span) else "0"
    return "0"


def form(kind: str, span: str, digits: str) -> str:
    """Whether the span is written as such things are."""
    groups = [len(g) for g in re.split(r"[^0-9]+", span) if g]
    if kind == "card":
        return "0" if len(groups) == 1 else "+" if groups[:-1] == [4] * (len(groups) - 1) or groups == [4, 6, 5] else "-"
    if kind == "ip":
        return "-" if any(len(p) > 1 and p[0] == "0" for p in span.split(".")) else "0"
    if kind == "phone":
        return "-" if max(groups) > 11 or "." in span and "(" in span else "+" if len(groups) > 2 and max(groups) <= 4 else "0"
    if kind == "email":
        return "-" if span[0] in ".%+-" or ".." in span else "0"
    if kind == "secret":
        return "+" if sum(any(f(c) for c in span) for f in (str.isdigit, str.islower, str.isupper)) >= 2 else "-"
    return "0"


def votes(text: str, kind: str, start: int, end: int) -> str:
    """Votes of LABELERS: + for, - against, 0 none."""
    span = text[start:end]
    digits = "".join(c for c in span if "0" <= c <= "9")
    left, right = (WORD.findall(part.lower()) for part in (text[max(0, start - 32) : start], text[end : end + 24]))
    before = "-" if DENIALS.intersection(left[-2:]) else "+" if any(c in w for w in left for c in CUES[kind]) else "0"
    after = "-" if UNITS.intersection(right[:1]) else "+" if any(c in w for w in right[:3] for c in CUES[kind]) else "0"
    beside = text[max(0, start - 1) : start] + text[end : end + 1]
    return checksum(kind, span, digits) + gazetteer(kind, span, digits) + form(kind, span, digits) + before + after + ("-" if any(c.isalnum() or c == "_" for c in beside) else "0")


SHAPES = [(re.compile("[0-9]"), "9"), (re.compile(r"[^\W\d_A-Z]"), "a"), (re.compile("[A-Z]"), "A")]


def seen(text: str, kind: str, start: int, end: int) -> list[int]:
    """The classifier's inputs: places of hashed features of the span and its surroundings."""
    shape = text[start:end][:64]
    for pattern, letter in SHAPES:
        shape = pattern.sub(letter, shape)
    runs = re.sub(r"(.)\1+", r"\1", shape)
    left, right = WORD.findall(text[max(0, start - 32) : start].lower())[-2:], WORD.findall(text[end : end + 24].lower())[:1]
    beside = text[max(0, start - 1) : start].strip(), text[end : end + 1].strip()
    names = ["kind", f"runs {runs[:16]}", f"size {min((end - start) // 4, 16)}", f"touches {[bool(b) and b.isalnum() for b in beside]}"]
    names += [f"shape {g}" for g in {runs[k : k + 3] for k in range(min(len(runs), 20) - 2)}]
    names += [f"left {w}" for w in left] + [f"right {w}" for w in right]
    return sorted({zlib.crc32(f"{kind} {n}".encode()) % WIDTH for n in names})


SPANS = "array<struct<kind:string,start:int,end:int,base:boolean,votes:string,seen:array<int>>>"
_SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_()), ("votes", pa.string()), ("seen", pa.list_(pa.int32()))]))


def _rows(text: str) -> list[dict]:
    good, bad = base_spans(text)
    out = [(*s, True) for s in good] + [(*s, False) for s in bad] + [(*s, False) for s in loose_spans(text)]
    return [{"kind": k, "start": a, "end": b, "base": base, "votes": votes(text, k, a, b), "seen": seen(text, k, a, b)} for k, a, b, base in out]


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id and its candidate spans with their votes and the classifier's inputs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_rows(t or "") for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(found, _SPAN)], names=["doc_id", "spans"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id long, spans {SPANS}")


def estimate(patterns: list[str], counts: np.ndarray, rounds: int = 50) -> np.ndarray:
    """Posterior of each vote pattern being personal data, by expectation-maximisation over the labelers' reliabilities."""
    sign = np.array([[{"+": 1, "-": -1, "0": 0}[c] for c in p] for p in patterns])
    p = 1 / (1 + np.exp(0.5 - sign.sum(axis=1)))
    for _ in range(rounds):
        w = np.stack([counts * (1 - p), counts * p])
        prior = np.log((w.sum(axis=1) + 1) / (counts.sum() + 2))
        odds = np.repeat(prior[:, None], len(patterns), axis=1)
        for column in sign.T:
            for v in (-1, 0, 1):
                here = column == v
                odds[:, here] += np.log((w[:, here].sum(axis=1) + 0.5) / (w.sum(axis=1) + 1.5))[:, None]
        new = 1 / (1 + np.exp(odds[0] - odds[1]))
        if np.abs(new - p).max() < 1e-6:
            break
        p = new
    # the classes have no names of their own: personal data is the one that the votes favour
    if (counts * p * sign.sum(axis=1)).sum() / max((counts * p).sum(), 1e-9) < (counts * (1 - p) * sign.sum(axis=1)).sum() / max((counts * (1 - p)).sum(), 1e-9):
        p = 1 - p
    return p


def probability(w: np.ndarray, inputs: list[list[int]]) -> np.ndarray:
    """The classifier's answer for spans with these inputs; the last weight is the bias."""
    size = [len(x) for x in inputs]
    flat = np.fromiter((i for x in inputs for i in x), np.int64, sum(size))
    total = np.bincount(np.repeat(np.arange(len(inputs)), size), w[flat], len(inputs)) + w[-1]
    return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def fit_classifier(inputs: list[list[int]], p: np.ndarray, ridge: float = 1e-3, rounds: int = 300, rate: float = 0.1) -> np.ndarray:
    """Logistic weights for soft targets p, by gradient steps scaled by their own past."""
    w, past = np.zeros(WIDTH + 1), np.full(WIDTH + 1, 1e-8)
    size = [len(x) for x in inputs]
    flat, row = np.fromiter((i for x in inputs for i in x), np.int64, sum(size)), np.repeat(np.arange(len(inputs)), size)
    for _ in range(rounds if len(inputs) else 0):
        off = (1 / (1 + np.exp(-np.clip(np.bincount(row, w[flat], len(inputs)) + w[-1], -30, 30))) - p) / len(inputs)
        gradient = np.append(np.bincount(flat, off[row], WIDTH), off.sum()) + ridge * w / WIDTH
        past += gradient**2
        w -= rate * gradient / np.sqrt(past)
    return w


def trained(found: DataFrame, max_spans: int = 20_000) -> np.ndarray:
    """Weights of the span classifier for the candidates of a corpus (column spans)."""
    each = found.select(F.explode("spans").alias("s")).select("s.kind", "s.votes", "s.seen")
    table = each.groupBy("votes").count().orderBy("votes").toPandas()
    if not len(table):
        return np.zeros(WIDTH + 1)
    table["p"] = estimate(table["votes"].tolist(), table["count"].to_numpy(float))
    # copies of a span and its surroundings count once
    distinct = each.distinct().withColumn("h", F.xxhash64("kind", "votes", "seen"))
    n = distinct.count()
    share = distinct if n <= max_spans else distinct.where(share_of(F.col("h")) < 0.97 * max_spans / n)
    sample = share.limit(max_spans).toPandas().sort_values("h").merge(table, on="votes")
    return fit_classifier([list(x) for x in sample["seen"]], sample["p"].to_numpy())


def chosen(spans: list[dict], w: np.ndarray) -> list[tuple[str, int, int, bool]]:
    """Base spans, and the candidates that the classifier adds: kind, start, end, base; by kind as listed, then start."""
    base = [(s["kind"], s["start"], s["end"], True) for s in spans if s["base"]]
    rest = [s for s in spans if not s["base"]]
    added: list[tuple[str, int, int, bool]] = []
    if rest:
        ok = probability(w, [s["seen"] for s in rest]) > 0.5
        taken = sorted((a, b) for _, a, b, _ in base)
        starts, ends = [a for a, _ in taken], list(accumulate((b for _, b in taken), max))  # ends: the furthest so far
        last = 0
        for s in sorted((s for s, good in zip(rest, ok, strict=True) if good), key=lambda s: (s["start"], s["end"])):
            before = bisect_left(starts, s["end"])  # base spans that start before this one ends
            if s["start"] >= last and (not before or ends[before - 1] <= s["start"]):
                added.append((s["kind"], s["start"], s["end"], False))
                last = s["end"]
    return sorted(base + added, key=lambda s: (KINDS.index(s[0]), s[1]))


def spans(docs: DataFrame) -> DataFrame:
    """doc_id and spans (kind, start, end, base) of each document."""
    found = stored(candidates(docs), "spans")
    weights = trained(found)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [[dict(zip(("kind", "start", "end", "base"), s, strict=True)) for s in chosen(x or [], weights)] for x in batch.column("spans").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, kind)], names=["doc_id", "spans"])

    return found.mapInArrow(run, "doc_id long, spans array<struct<kind:string,start:int,end:int,base:boolean>>")


def masked(text: str, found: list[tuple[str, int, int]]) -> str:
    """The text with each span replaced by its kind in angle brackets; spans that overlap are one, of the first one's kind."""
    out, last = [], 0
    for kind, a, b in sorted(found, key=lambda s: s[1]):
        if a >= last:
            out += [text[last:a], f"<{kind.upper()}>"]
        last = max(last, b)
    return "".join([*out, text[last:]])


def redact(docs: DataFrame) -> DataFrame:
    """The documents with their spans masked, until no base span is left; n_chars follows where there is such a column.

    The texts are searched once: they are written with their candidates beside them.
    """
    schema = docs.schema
    at, beside = docs.columns.index("text"), "__spans"

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = pa.array([_rows(t or "") for t in batch.column(at).to_pylist()], _SPAN)
            yield pa.RecordBatch.from_arrays([*batch.columns, spans], names=[*batch.schema.names, beside])

    full = stored(docs.mapInArrow(found, StructType([*schema.fields, *StructType.fromDDL(f"{beside} {SPANS}").fields])), "searched")
    weights = trained(full.select(F.col(beside).alias("spans")))

    def cleaned(text: str | None, spans: list[dict]) -> str | None:
        if not text:
            return text
        spans = [s[:3] for s in chosen(spans or [], weights)]
        while spans:
            text = masked(text, spans)
            spans = base_spans(text)[0]  # what only its neighbour kept from being one, as digits beside a masked address
        return text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [cleaned(t, s) for t, s in zip(batch.column(at).to_pylist(), batch.column(beside).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], pa.array(texts, batch.schema.field(at).type), *batch.columns[at + 1 : -1]], names=batch.schema.names[:-1])

    out = full.mapInArrow(run, schema)
    return out.withColumn("n_chars", F.length("text").cast(schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
