"""I-Match fingerprints over randomised lexicon subsets, and likeness to an edited text and a neighbour.

The lexicon is the terms (lower-cased runs of word characters) whose document frequency lies in a band:
at least ``LEAST`` and at most ``MOST`` of all documents, i.e. a band of inverse document frequency.
Frequencies are counted over all documents.  As each lexicon term stands in ``LEAST`` of the documents, the lexicon
has at most ``1 / LEAST`` times as many terms as a document has distinct ones on average, however large the corpus
is, which bounds what is broadcast (below ``2 / LEAST`` documents: half as many as all documents have).

A fingerprint hashes the sorted distinct lexicon terms of a text in ``SUBSETS`` independent random subsets of the
lexicon, 64 bits each; a subset at level k keeps a term with a chance of 2**-k, and the subsets of level k + 1 lie in those
of level k.  A text has the hashes of its own level, where a subset holds about one of its terms (short texts: all or half
of the lexicon), and of the next one; level 0, the whole lexicon, is enough to tell whether two texts are equal but any
edit changes it.  Likeness is the share of equal hashes, at the greater of both levels, among the subsets that
aren't empty in both texts; texts whose levels are further apart than one, i.e. of very different sizes, have none.
A text with under ``FEW`` lexicon terms uses all its terms.

Null texts count as empty.  Null doc_ids come first in the order, ties are ordered by text; a single
document is its own neighbour; an empty table gives no rows.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigloom.llm.common import ROWS_PER_BATCH, Cut, _arrow_schema

LEAST, MOST, FEW, SUBSETS = 1 / 2000, 1 / 10, 4, 24
HELD = 400_000
#: Odd multipliers (fixed values): of subsets, of the mixing and of places in a sorted sequence.
A, B, C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93))
WORD = re.compile(r"\w+")


def _hash(term: str) -> int:
    return xxhash.xxh3_64_intdigest(term.encode("utf-8", "surrogatepass")) - (1 << 63)


def terms(text: str | None) -> set[str]:
    return set(WORD.findall((text or "").lower()))


def term_counts(docs: DataFrame) -> DataFrame:
    """``(term, n)``: hashed terms and the number of documents that hold them, pre-added in each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def out() -> pa.RecordBatch:
            got = pa.RecordBatch.from_arrays([pa.array(map(_hash, counts), pa.int64(), size=len(counts)), pa.array(counts.values(), pa.int64(), size=len(counts))], names=["term", "n"])
            counts.clear()
            return got

        for b in batches:
            for t in b.column(0):
                counts.update(terms(t.as_py()))
                if len(counts) > HELD:
                    yield out()
        yield out()

    return docs.select("text").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))


def lexicon(docs: DataFrame) -> np.ndarray:
    """Sorted hashes of the terms within the band."""
    cut = Cut(docs.sparkSession)
    n = docs.count()
    counts = cut.write(term_counts(docs).where("n > 1"))
    low, high = max(2, n * LEAST), n * MOST
    found = counts.where(F.col("n").between(low, high)).select("term").toArrow().column("term").to_numpy()
    cut.drop(counts)
    return np.sort(found)


def selected(text: str, lex: frozenset, known: dict) -> list[int]:
    """Sorted hashes of a text's distinct terms that count."""
    all_terms, got = terms(text), []
    for t in all_terms:
        h = known.get(t)
        if h is None:
            if len(known) > HELD:
                known.clear()
            h = _hash(t)
            known[t] = h = h if h in lex else False
        if h is not False:
            got.append(h)
    return sorted(got if len(got) >= FEW else map(_hash, all_terms))


def level_of(n: int) -> int:
    """The level at which a subset holds about one of ``n`` terms."""
    return (max(n, 1) - 1).bit_length()


def in_subset(h: np.ndarray, subset: int) -> np.ndarray:
    """A number for each term; the subset holds it at level k if the number is under 2**(64 - k)."""
    x = (h ^ (np.uint64(subset + 1) * A)) * B
    x ^= x >> np.uint64(31)
    x *= A
    return x ^ (x >> np.uint64(29))


def prints(texts: list[str], lex: frozenset, known: dict) -> np.ndarray:
    """(texts, 1 + 2 * SUBSETS): the level, then the subsets' hashes at it and at the next one, 0 for an empty subset."""
    parts = [selected(t, lex, known) for t in texts]
    sizes = np.array([len(p) for p in parts], np.int64)
    h = np.array([x for p in parts for x in p], np.int64).view(np.uint64)
    owner = np.repeat(np.arange(len(texts)), sizes)
    out = np.zeros((len(texts), 1 + 2 * SUBSETS), np.uint64)
    out[:, 0] = [level_of(int(n)) for n in sizes]
    power = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(int(sizes.max(initial=0)), C)]))
    limits = [np.uint64((1 << 64 - k) - 1) for k in range(64)]
    own = np.array([limits[int(k)] for k in out[:, 0]], np.uint64)[owner]
    for j in range(SUBSETS):
        x = in_subset(h, j)
        for step, limit in enumerate((own, own >> np.uint64(1))):
            at = np.flatnonzero(x <= limit)
            whose = owner[at]
            counts = np.bincount(whose, minlength=len(texts))
            some = np.flatnonzero(counts)
            if not len(some):
                continue
            starts = (np.cumsum(counts) - counts)[some]
            place = np.arange(len(at)) - np.repeat(starts, counts[some])
            value = np.add.reduceat((h[at] * A + B) * power[place], starts)  # the sorted terms in their order
            value ^= value >> np.uint64(32)
            out[some, 1 + step * SUBSETS + j] = value * B | np.uint64(1)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, from 0 to 1; two fingerprints without any term are alike."""
    level = np.maximum(a[:, 0], b[:, 0])
    near = np.abs(a[:, 0].astype(np.int64) - b[:, 0].astype(np.int64)) < 2

    def at(p: np.ndarray) -> np.ndarray:
        return np.where((p[:, 0] == level)[:, None], p[:, 1 : 1 + SUBSETS], p[:, 1 + SUBSETS :])

    x, y = at(a), at(b)
    some = ((x > 0) | (y > 0)).sum(axis=1)
    same = ((x == y) & (x > 0)).sum(axis=1)
    return np.where((a == b).all(axis=1), 1.0, np.where(near, same / np.maximum(some, 1), 0.0))


def as_text(p: np.ndarray) -> list[str]:
    return [f"{row[0]:02x}" + "".join(f"{v:016x}" for v in row[1:]) for row in p.tolist()]


def _tree(key: Column, bounds: list[int], lo: int, hi: int) -> Column:
    """Number of ``bounds`` at or below the key, as nested choices."""
    if lo == hi:
        return F.lit(lo)
    mid = (lo + hi) // 2
    return F.when(key < bounds[mid], _tree(key, bounds, lo, mid)).otherwise(_tree(key, bounds, mid + 1, hi))


def in_order(docs: DataFrame, parts: int) -> DataFrame | None:
    """``(bucket, guest, k, doc_id, text)``: buckets of ascending doc_id, each with the first rows of the next one
    (of the first one after the last) as guests.  The driver sees one number a bucket."""
    docs = docs.select("doc_id", "text", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("k"))
    shares = [i / (2 * parts) for i in range(1, 2 * parts)]
    bounds = docs.agg(F.percentile_approx("k", shares, 20 * parts).alias("b")).first().b
    if bounds is None:
        return None
    bounds = sorted(set(bounds))
    docs = docs.withColumn("bucket", _tree(F.col("k"), bounds, 0, len(bounds)))
    first = {r.bucket: r.k for r in docs.groupBy("bucket").agg(F.min("k").alias("k")).collect()}
    order = sorted(first)
    before = dict(zip(order, [order[-1], *order[:-1]], strict=True))
    pick = lambda d: F.get(F.array(*[F.lit(d.get(i)).cast("long") for i in range(len(bounds) + 1)]), F.col("bucket"))
    place = lambda b, g: F.struct(b.cast("long").alias("bucket"), F.lit(g).alias("guest"))
    home = place(F.col("bucket"), 0)
    dealt = F.when(F.col("k") == pick(first), F.array(home, place(pick(before), 1))).otherwise(F.array(home))
    return docs.select("doc_id", "text", "k", F.explode(dealt).alias("d")).select("d.bucket", "d.guest", "k", "doc_id", "text")


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def fingerprints(docs: DataFrame) -> DataFrame:
    """The contract's row for each document."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = in_order(docs, parts)
    if dealt is None:
        return docs.sparkSession.createDataFrame([], SCHEMA)
    shared = spark.sparkContext.broadcast(lexicon(docs))
    arrow = _arrow_schema(SCHEMA)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex, known = frozenset(shared.value.tolist()), {}

        def out(rows: list[tuple]) -> pa.RecordBatch:
            """Rows (bucket, guest, doc_id, text) in order; the last is only a neighbour."""
            texts = [r[3] for r in rows]
            edited = []
            for a, b in zip(texts, texts[1:], strict=False):
                n = len(a) // 4
                edited.append(a[: len(a) - n] + b[:n])
            p, e = prints(texts, lex, known), prints(edited, lex, known)
            here = [i for i, (a, b) in enumerate(zip(rows, rows[1:], strict=False)) if not a[1] and a[0] == b[0]]
            mine, after = p[here], p[[i + 1 for i in here]] if here else p[:0]
            columns = [
                [rows[i][2] for i in here], [len(texts[i]) for i in here],
                [hashlib.sha256(edited[i].encode("utf-8", "surrogatepass")).hexdigest() for i in here],
                as_text(mine), as_text(e[here]), likeness(mine, e[here]).tolist(), likeness(mine, after).tolist(),
            ]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

        held: list[tuple] = []
        for b in batches:
            bucket, guest, ids, text = (b.column(i) for i in (0, 1, 3, 4))
            for i in range(b.num_rows):
                held.append((bucket[i].as_py(), guest[i].as_py(), ids[i].as_py(), text[i].as_py() or ""))
                if len(held) > ROWS_PER_BATCH:
                    yield out(held)
                    held = held[-1:]
        if len(held) > 1:
            yield out(held)

    ready = dealt.repartitionById(2 * parts, F.col("bucket").cast("int")).sortWithinPartitions("bucket", "guest", "k", "text")
    return ready.mapInArrow(run, SCHEMA)
