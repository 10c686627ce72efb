"""Language of texts by a linear-chain conditional random field over words.

A word's emission scores come from its affixes, letter n-grams and itself (the lexicon), hashed into one
weight table; transitions between labels are learnt with them.  Training sequences are spans of labelled
documents put one behind the other, so that labels switch within a sequence as in code-switched text.
Labelling takes forward-backward over all words of a batch at once: the documents of a batch form one
chain that starts afresh at each document, and blocks of the chain are multiplied out side by side, which
gives the marginals of texts of any length in a fixed number of array steps.

Fitted on about ``PER_LANG`` documents of each label (fewer, if labels are so many that this were over ``FITTED``
documents), chosen by a hash of doc_id, with up to ``SPANS`` evenly placed spans of ``SPAN`` words each; words
of over ``WIDE`` letters are left out of the fit only.  Predictions know all labels and read whole texts and whole words.  ``label_spans`` gives
the labelled stretches of code-switched texts.  A text's language has the largest sum of marginals, weighted by letters; the score is its share.  Null texts
and texts without a letter are ``und`` with score 0, as is everything if nothing is labelled.  Null doc_ids
aren't learnt from and count as not held out; repeated rows repeat; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigloom.llm.common import ROWS_PER_BATCH, _arrow_schema

PER_LANG, FITTED, SPANS, SPAN, WIDE = 1000, 200_000, 6, 40, 24
BUCKETS, EPOCHS, BATCH, RATE, DECAY = 1 << 17, 3, 128, 0.25, 1e-5
HELD, BLOCK, CELLS = 400_000, 128, 1 << 18
WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def word_features(words: list[str]) -> np.ndarray:
    """Buckets of the affixes, n-grams and lexicon entry of each word; ``BUCKETS`` fills up the row."""
    n = len(words)
    if not n:
        return np.zeros((0, 1), np.int64)
    longest = max(map(len, words))
    x = np.zeros((n, longest + 2), np.uint64)
    x[:, 0] = 94  # ^
    x[:, 1:-1] = np.array(words, f"U{longest}").view(np.uint32).reshape(n, -1)
    lengths = np.fromiter(map(len, words), np.int64, n) + 2
    x[np.arange(n), lengths - 1] = 36  # $
    width = int(lengths.max())
    x = x[:, :width]
    a, b = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)

    def mixed(h: np.ndarray, kind: int) -> np.ndarray:
        h = (h + np.uint64(kind)) * a
        h ^= h >> np.uint64(31)
        return ((h * b) >> np.uint64(40)).astype(np.int64) % BUCKETS

    out = []
    for k in (2, 3, 4):
        if width < k:
            continue
        h = np.zeros((n, width - k + 1), np.uint64)
        for i in range(k):
            h = h * a + x[:, i : width - k + 1 + i]
        h = mixed(h, k)
        h[np.arange(width - k + 1) > (lengths - k)[:, None]] = BUCKETS
        out.append(h)
    whole = np.zeros(n, np.uint64)
    for i in range(width):
        whole = np.where(i < lengths, whole * a + x[:, i], whole)
    out.append(mixed(whole, 9)[:, None])
    for k in (2, 3, 4):  # longer affixes, apart from the n-grams
        size = min(k + 1, width)
        first = last = np.zeros(n, np.uint64)
        rows = np.arange(n)
        for i in range(size):
            first = first * a + x[:, i]
            last = last * a + x[rows, np.maximum(lengths - size + i, 0)]
        out += [mixed(first, 10 + k)[:, None], mixed(last, 20 + k)[:, None]]
    return np.concatenate(out, axis=1)


def chain(e: np.ndarray, start: np.ndarray, step: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Normalised vectors v of v[t] = (v[t-1] @ step) * e[t], afresh as first * e[t] where ``start``."""
    n, k = e.shape
    blocks = -(-n // BLOCK)
    full = blocks * BLOCK
    e = np.concatenate([e, np.ones((full - n, k))]).reshape(blocks, BLOCK, k)
    start = np.concatenate([start, np.zeros(full - n, bool)]).reshape(blocks, BLOCK)
    whole = np.broadcast_to(np.eye(k), (blocks, k, k)).copy()
    for j in range(BLOCK):
        whole = whole @ step * e[:, j, None, :]
        s = start[:, j]
        if s.any():
            whole[s] = (first * e[s, j])[:, None, :]
        whole /= whole.max(axis=(1, 2), keepdims=True)
    into = np.empty((blocks, k))
    v = np.full(k, 1 / k)
    for b in range(blocks):
        into[b] = v
        v = v @ whole[b]
        v /= v.sum()
    out = np.empty((blocks, BLOCK, k))
    v = into
    for j in range(BLOCK):
        v = v @ step * e[:, j]
        s = start[:, j]
        if s.any():
            v[s] = first * e[s, j]
        v = v / v.sum(axis=1, keepdims=True)
        out[:, j] = v
    return out.reshape(full, k)[:n]


def marginals(scores: np.ndarray, start: np.ndarray, transitions: np.ndarray) -> np.ndarray:
    """Posterior of each label at each word; ``start`` marks the first word of each text."""
    k = scores.shape[1]
    e = np.exp(np.maximum(scores - scores.max(axis=1, keepdims=True), -60))
    step = np.exp(transitions - transitions.max())
    ends = np.append(start[1:], True)
    forward = chain(e, start, step, np.full(k, 1 / k))
    backward = chain(e[::-1], ends[::-1], step.T, np.ones(k))[::-1]
    p = forward * backward / e
    return p / p.sum(axis=1, keepdims=True)


class Crf:
    def __init__(self, labels: list[str]):
        self.labels = labels
        k = len(labels)
        self.weights, self.transitions = np.zeros((BUCKETS + 1, k), np.float64), np.zeros((k, k))

    def emissions(self, words: list[str]) -> np.ndarray:
        """Scores of whole words, those of about one length side by side."""
        out = np.zeros((len(words), len(self.labels)))
        by: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            by.setdefault(max(WIDE, 1 << len(w).bit_length()) if len(w) > WIDE else WIDE, []).append(i)
        for width, own in by.items():
            rows = max(1, CELLS // width)
            for at in range(0, len(own), rows):
                part = own[at : at + rows]
                f = word_features([words[i] for i in part])
                for j in range(f.shape[1]):
                    out[part] += self.weights[f[:, j]]
        return out

    def fit(self, spans: list[tuple[list[str], int]], epochs: int = EPOCHS, seed: int = 7) -> Crf:
        """``spans``: words with the number of their label."""
        rng = np.random.default_rng(seed)
        k = len(self.labels)
        if k < 2 or not any(len(w) <= WIDE for words, _ in spans for w in words):
            return self
        index: dict[str, int] = {}
        spans = [([w for w in words if len(w) <= WIDE], y) for words, y in spans]
        coded = [(np.array([index.setdefault(w, len(index)) for w in words]), y) for words, y in spans if words]
        feats = word_features(list(index))
        square, square_t = np.full_like(self.weights, 1e-4), np.full((k, k), 1e-4)
        for _ in range(epochs):
            order = rng.permutation(len(coded))
            for lo in range(0, len(order), BATCH):
                words, gold, start = [], [], []
                for i, o in enumerate(order[lo : lo + BATCH]):
                    w, y = coded[o]
                    words.append(w)
                    gold.append(np.full(len(w), y))
                    s = np.zeros(len(w), bool)
                    s[0] = i % 3 == 0  # two of three spans go on where another ended
                    start.append(s)
                words, gold, start = map(np.concatenate, (words, gold, start))
                start[0] = True
                types, at = np.unique(words, return_inverse=True)
                f = feats[types]
                scores = self.weights[f].sum(axis=1)[at]
                p = marginals(scores, start, self.transitions)
                grad = -p
                grad[np.arange(len(gold)), gold] += 1
                by_type = np.stack([np.bincount(at, grad[:, j], len(types)) for j in range(k)], axis=1)
                flat = f.ravel()
                g = np.stack([np.bincount(flat, np.repeat(by_type[:, j], f.shape[1]), BUCKETS + 1) for j in range(k)], axis=1) / len(start)
                g[BUCKETS] = 0
                g -= DECAY * self.weights
                square += g * g
                self.weights += RATE * g / np.sqrt(square)
                # transitions: observed less expected pairs, from the pair marginals
                on = np.flatnonzero(~start)
                seen = np.zeros((k, k))
                np.add.at(seen, (gold[on - 1], gold[on]), 1)
                e = np.exp(np.maximum(scores - scores.max(axis=1, keepdims=True), -60))
                step = np.exp(self.transitions - self.transitions.max())
                forward = chain(e, start, step, np.full(k, 1 / k))
                backward = chain(e[::-1], np.append(start[1:], True)[::-1], step.T, np.ones(k))[::-1]
                pair = forward[on - 1][:, :, None] * step * backward[on][:, None, :]
                pair /= pair.sum(axis=(1, 2), keepdims=True)
                gt = (seen - pair.sum(axis=0)) / len(start)
                square_t += gt * gt
                self.transitions += RATE * gt / np.sqrt(square_t)
        self.weights[BUCKETS] = 0
        return self

    def posteriors(self, texts: list[str | None], cache: dict | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of all words of the texts: posteriors of the labels and numbers of letters; and of each text its number of words."""
        cache = cache if cache is not None else {}
        split = [words_of(t) for t in texts]
        if len(cache) > HELD:
            cache.clear()
        new = [w for w in set().union(*split) if w not in cache]
        if new:
            table = cache.get("")
            e = self.emissions(new)
            lengths = np.fromiter(map(len, new), np.float64, len(new))
            at = 0 if table is None else len(table[0])
            cache[""] = (e, lengths) if table is None else (np.concatenate([table[0], e]), np.concatenate([table[1], lengths]))
            cache.update(zip(new, range(at, at + len(new)), strict=True))
        ids = [cache[w] for words in split for w in words]
        sizes = np.array([len(s) for s in split], np.int64)
        if not ids or not self.labels:
            return np.zeros((0, len(self.labels))), np.zeros(0), sizes * 0
        start = np.zeros(len(ids), bool)
        start[(np.cumsum(sizes) - sizes)[sizes > 0]] = True
        return marginals(cache[""][0][ids], start, self.transitions), cache[""][1][ids], sizes

    def label_texts(self, texts: list[str | None], cache: dict | None = None) -> list[tuple[str, float]]:
        """Language and score of each text."""
        p, lengths, sizes = self.posteriors(texts, cache)
        out = [("und", 0.0)] * len(texts)
        some = np.flatnonzero(sizes)
        if not len(some):
            return out
        total = np.add.reduceat(p * lengths[:, None], (np.cumsum(sizes) - sizes)[some], axis=0)
        total /= total.sum(axis=1, keepdims=True)
        for i, row in zip(some, total, strict=True):
            if any(map(str.isalpha, texts[i])):
                out[i] = (self.labels[int(row.argmax())], float(min(1.0, row.max())))
        return out

    def label_spans(self, texts: list[str | None], cache: dict | None = None) -> list[list[tuple[int, int, str, float]]]:
        """Stretches of words with one label in each text: first and last character (exclusive), label, mean posterior."""
        p, _, sizes = self.posteriors(texts, cache)
        best, out, at = p.argmax(axis=1) if len(p) else np.zeros(0, int), [], 0
        for text, n in zip(texts, sizes.tolist(), strict=True):
            places = [m.span() for m in WORD.finditer((text or "").lower())][:n] if n else []
            own, score = best[at : at + n], p[at : at + n].max(axis=1) if n else []
            cuts = [0, *(np.flatnonzero(own[1:] != own[:-1]) + 1).tolist(), n] if n else [0]
            out.append([(places[a][0], places[b - 1][1], self.labels[int(own[a])], float(np.mean(score[a:b]))) for a, b in zip(cuts, cuts[1:], strict=False)])
            at += n
        return out


def training_spans(docs: DataFrame, langs: dict[str, int]) -> list[tuple[list[str], str]]:
    """Spans of a bounded number of documents of each language; only these go to the driver."""
    chance = F.lit(0.0)
    per = max(1.0, min(PER_LANG, FITTED / max(1, len(langs))))
    shares = [x for lang, n in langs.items() for x in (F.lit(lang), F.lit(min(1.0, per / n)))]
    chance = F.element_at(F.create_map(*shares), F.col("lang")) if shares else chance
    picked = docs.where(F.pmod(F.xxhash64(F.lit("lang"), "doc_id"), F.lit(1 << 20)) < chance * (1 << 20))
    schema = "doc_id long, lang string, words array<string>"
    arrow = _arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i in range(b.num_rows):
                words = words_of(b.column(2)[i].as_py())
                n = max(1, min(SPANS, len(words) // SPAN))
                for s in range(n):
                    at = s * len(words) // n
                    rows.append((b.column(0)[i].as_py(), b.column(1)[i].as_py(), words[at : at + SPAN]))
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], f.type) for j, f in enumerate(arrow)], schema=arrow)

    rows = picked.select("doc_id", "lang", "text").mapInArrow(run, schema).collect()
    rows.sort(key=lambda r: (r.doc_id, r.lang, r.words))
    return [(r.words, r.lang) for r in rows]


def learn(docs: DataFrame) -> Crf:
    """A model of the labels of ``docs (doc_id, text, lang)``."""
    known = docs.where("lang is not null and doc_id is not null")
    langs = {r.lang: r.n for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    labels = sorted(langs)
    at = {x: i for i, x in enumerate(labels)}
    return Crf(labels).fit([(w, at[x]) for w, x in training_spans(known, langs)])


def label_spans(docs: DataFrame, model: Crf) -> DataFrame:
    """``(doc_id, start, end, lang, score)``: the stretches of each text of ``docs (doc_id, text)`` in one language, in characters of the
    lower-cased text.  Texts without words give no rows."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = "doc_id long, start long, end long, lang string, score double"
    arrow = _arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict = {}
        for b in batches:
            for at in range(0, b.num_rows, ROWS_PER_BATCH):
                part = b.slice(at, ROWS_PER_BATCH)
                ids = part.column(0).to_pylist()
                rows = [(i, *x) for i, own in zip(ids, shared.value.label_spans(part.column(1).to_pylist(), cache), strict=True) for x in own]
                yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], f.type) for j, f in enumerate(arrow)], schema=arrow)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def predict(docs: DataFrame) -> DataFrame:
    """The contract's row for each row of ``docs (doc_id, text, lang)``."""
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    model = docs.sparkSession.sparkContext.broadcast(learn(docs.where(~held)))
    schema = "doc_id long, held_out boolean, lang_pred string, score double"
    arrow = _arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict = {}
        for b in batches:
            for at in range(0, b.num_rows, ROWS_PER_BATCH):
                part = b.slice(at, ROWS_PER_BATCH)
                got = model.value.label_texts(part.column(2).to_pylist(), cache)
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), part.column(1), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], schema=arrow)

    return docs.select("doc_id", held.alias("held_out"), "text").mapInArrow(run, schema)
