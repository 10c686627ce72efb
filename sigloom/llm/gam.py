"""Quality by a generalised additive model with pairwise interactions.

Features are measured on whole texts.  Learning boosts shallow trees in turn over the features, a small
step each, and adds every tree to its feature's lookup table over quantile bins; the pairs with the
largest remaining gain then get tables of two bins each in the same way.  A score is the logistic of the
sum of one table entry for each feature and pair, so scoring a batch is binning and adding.

Fitted on about ``SAMPLE`` labelled rows, chosen by a hash of doc_id; features and scores cover every row.  Null and empty texts have all-zero features and a score like any other.  Null labels are
left out; without labels of both kinds the score is the share of label 1, or 0.5 without any.  Repeated
doc_ids give repeated rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigloom.llm.common import ROWS_PER_BATCH, Cut, _arrow_schema, fresh

SAMPLE, BINS, ROUNDS, RATE, LEAVES, PAIRS, PAIR_BINS, PAIR_ROUNDS, LEAST, THRESHOLD = 20_000, 64, 150, 0.1, 3, 8, 8, 50, 5, 0.3

LINK = re.compile(r"https?://|www\.|\S@\S+\.\w")
FEATURES = [
    "log_chars", "log_words", "word_length", "word_spread", "distinct_words", "top_word", "lines", "line_length", "repeated_lines", "top_line", "upper", "digits",
    "space", "stops", "other_punctuation", "symbols", "high_bytes", "entropy", "top_byte", "upper_words", "plain_words", "repeated_pairs", "links", "long_words", "end_stops", "short_words", "doubled_words", "lone_marks",
]


def _class(chars: bytes) -> np.ndarray:
    out = np.zeros(256)
    out[list(chars)] = 1
    return out


CLASSES = np.stack([
    _class(bytes(range(65, 91))), _class(bytes(range(48, 58))), _class(b" \t\n\r"), _class(b".,;:?"), _class(b"!\"'()-[]/"), _class(b"#$%&*+<=>@\\^_`{|}~"), _class(bytes(range(128, 256))),
])


def features(text: str | None) -> list[float]:
    """The features of a text, in the order of ``FEATURES``."""
    if not text:
        return [0.0] * len(FEATURES)
    raw = np.bincount(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8), minlength=256)
    n = raw.sum()
    share = raw / n
    upper, digits, space, stops, other, symbols, high = CLASSES @ share
    words = text.split()
    k = max(1, len(words))
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    low = text.lower().split()
    distinct: dict[str, int] = {}
    for w in low:
        distinct[w] = distinct.get(w, 0) + 1
    lines = [x for x in text.split("\n") if x.strip()]
    own: dict[str, int] = {}
    for x in lines:
        own[x] = own.get(x, 0) + 1
    pairs = len(set(zip(low, low[1:], strict=False)))
    some = share[share > 0]
    m = max(1, len(lines))
    return [
        np.log1p(n), np.log1p(len(words)), lengths.mean() if len(words) else 0.0, lengths.std() if len(words) else 0.0, len(distinct) / k, max(distinct.values(), default=0) / k,
        np.log1p(len(lines)), np.log1p(n / m), 1 - len(own) / m, max(own.values(), default=0) / m if len(lines) > 1 else 0.0, upper, digits,
        space, stops, other, symbols, high, -(some * np.log2(some)).sum(), np.delete(share, 32).max(), sum(map(str.isupper, words)) / k, sum(map(str.isalpha, words)) / k,
        1 - pairs / max(1, len(words) - 1) if len(words) > 1 else 0.0, len(LINK.findall(text)) / k, (lengths > 15).sum() / k, sum(w.endswith(".") for w in words) / k, (lengths < 3).sum() / k,
        sum(map(str.__eq__, low, low[1:])) / k, sum(not any(map(str.isalnum, w)) for w in words if len(w) < 4) / k,
    ]


def feature_table(docs: DataFrame) -> DataFrame:
    """``(doc_id, x)``: the features of each row of ``docs (doc_id, text)``."""
    schema = "doc_id long, x array<float>"
    arrow = _arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh()
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS_PER_BATCH):
                part = whole.slice(at, ROWS_PER_BATCH)
                x = np.array([features(t.as_py()) for t in part.column(1)], np.float32)
                flat = pa.ListArray.from_arrays(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), flat.cast(arrow.field(1).type)], schema=arrow)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


class Gam:
    """Lookup tables by feature and by pair of features."""

    def __init__(self, edges: list[np.ndarray], base: float):
        self.edges, self.base = edges, base
        self.tables = [np.zeros(len(e) + 1) for e in edges]
        self.coarse: list[np.ndarray] = []
        self.pairs: list[tuple[int, int, np.ndarray]] = []

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)], axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        b = self.bins(x)
        z = np.full(len(x), self.base)
        for j, t in enumerate(self.tables):
            z += t[b[:, j]]
        for i, j, t in self.pairs:
            z += t[self.coarse[i][b[:, i]], self.coarse[j][b[:, j]]]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _tree(g: np.ndarray, h: np.ndarray, n: np.ndarray, leaves: int) -> np.ndarray:
    """Steps by bin of a tree of at most ``leaves`` leaves: greedy splits by gain."""
    parts = [(0, len(g))]
    while len(parts) < leaves:
        best = (1e-9, None, 0)
        for p, (a, b) in enumerate(parts):
            if b - a < 2:
                continue
            gl, hl, nl = np.cumsum(g[a:b])[:-1], np.cumsum(h[a:b])[:-1], np.cumsum(n[a:b])[:-1]
            gt, ht, nt = g[a:b].sum(), h[a:b].sum(), n[a:b].sum()
            gain = gl**2 / (hl + 1) + (gt - gl) ** 2 / (ht - hl + 1) - gt**2 / (ht + 1)
            gain[(nl < LEAST) | (nt - nl < LEAST)] = -1
            at = int(gain.argmax())
            if gain[at] > best[0]:
                best = (gain[at], p, a + at + 1)
        if best[1] is None:
            break
        a, b = parts.pop(best[1])
        parts += [(a, best[2]), (best[2], b)]
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + 1)
    return out


def _quadrants(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and steps of the best cut of a two-way table into four parts."""
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    best, out = 0.0, np.zeros_like(g)
    total = cg[-1, -1] ** 2 / (ch[-1, -1] + 1)
    for i in range(g.shape[0] - 1):
        for j in range(g.shape[1] - 1):
            parts = [(cg[i, j], ch[i, j]), (cg[i, -1] - cg[i, j], ch[i, -1] - ch[i, j]), (cg[-1, j] - cg[i, j], ch[-1, j] - ch[i, j])]
            parts.append((cg[-1, -1] - sum(p[0] for p in parts), ch[-1, -1] - sum(p[1] for p in parts)))
            gain = sum(a * a / (b + 1) for a, b in parts) - total
            if gain > best:
                best = gain
                v = [a / (b + 1) for a, b in parts]
                out = np.block([[np.full((i + 1, j + 1), v[0]), np.full((i + 1, g.shape[1] - j - 1), v[1])], [np.full((g.shape[0] - i - 1, j + 1), v[2]), np.full((g.shape[0] - i - 1, g.shape[1] - j - 1), v[3])]])
    return best, out


def fit(x: np.ndarray, y: np.ndarray, rounds: int = ROUNDS) -> Gam:
    """A model of ``y`` (0 or 1) on the columns of ``x``."""
    p = (y.sum() + 0.5) / (len(y) + 1) if len(y) else 0.5
    base = float(np.log(p / (1 - p)))
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) if len(c) else np.zeros(0) for c in x.T]
    model = Gam(edges, base)
    if len(y) == 0 or y.min() == y.max():
        return model
    b = model.bins(x)
    z = np.full(len(y), base)
    for _ in range(rounds):
        for j in range(x.shape[1]):
            q = 1 / (1 + np.exp(-z))
            k = len(model.tables[j])
            step = RATE * _tree(*(np.bincount(b[:, j], w, k) for w in (y - q, q * (1 - q), np.ones(len(y)))), LEAVES)
            model.tables[j] += step
            z += step[b[:, j]]
    model.coarse = [np.minimum(np.arange(len(e) + 1) * PAIR_BINS // (len(e) + 1), PAIR_BINS - 1) for e in edges]
    c = np.stack([model.coarse[j][b[:, j]] for j in range(x.shape[1])], axis=1)

    def table(i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
        q = 1 / (1 + np.exp(-z))
        at = c[:, i] * PAIR_BINS + c[:, j]
        return tuple(np.bincount(at, w, PAIR_BINS**2).reshape(PAIR_BINS, PAIR_BINS) for w in (y - q, q * (1 - q)))

    gains = sorted(((_quadrants(*table(i, j))[0], i, j) for i in range(x.shape[1]) for j in range(i)), reverse=True)
    model.pairs = [(i, j, np.zeros((PAIR_BINS, PAIR_BINS))) for gain, i, j in gains[:PAIRS] if gain > 0]
    for _ in range(PAIR_ROUNDS):
        for i, j, t in model.pairs:
            step = RATE * _quadrants(*table(i, j))[1]
            t += step
            z += step[c[:, i], c[:, j]]
    return model


def scored(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for each row of ``docs``, learnt from ``labels (doc_id, quality)``."""
    cut = Cut(docs.sparkSession)
    x = cut.write(feature_table(docs))
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    known = labels.where("doc_id is not null and quality is not null").where(~held).select("doc_id", "quality")
    chance = min(1.0, sample / max(1, known.count()))
    rows = known.where(F.pmod(F.xxhash64(F.lit("quality"), "doc_id"), F.lit(1 << 20)) < chance * (1 << 20)).join(x, "doc_id").select("doc_id", "x", "quality").collect()
    rows.sort(key=lambda r: (r.doc_id, r.quality, r.x))
    model = fit(np.array([r.x for r in rows], np.float64).reshape(-1, len(FEATURES)), np.array([r.quality for r in rows], np.float64))
    schema = "doc_id long, held_out boolean, score double, predicted int"
    arrow = _arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat = b.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES)).astype(np.float64)
            s = model.score(flat)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))], schema=arrow)

    return x.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "x").mapInArrow(run, schema)


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the model doesn't reject; all columns stay. Rows without doc_id stay."""
    bad = scored(docs, labels).where("predicted = 0 and doc_id is not null").select("doc_id").distinct()
    return docs.join(bad, "doc_id", "left_anti").select(*docs.columns)
