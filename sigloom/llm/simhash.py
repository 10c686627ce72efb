"""SimHash near-duplicates: 64-bit fingerprints of 3-word shingles, linked at two or fewer differing bits.

Candidate search is an inverted index of positional bytes with a count filter.  Two fingerprints within two bits differ in
at most two of their eight bytes, so a pair must share at least six positional bytes.  The bytes stand in four blocks of
two, of which a pair shares two whole ones; a posting is two blocks of positional bytes, six postings a fingerprint.  Within
a posting's list the shared positional bytes of each pair are tallied, pairs below six are dropped, the rest verified.
Distinct fingerprints only are indexed (copies share one).

Lists of over ``PAIRED`` members are split by two more positional bytes, for each choice of six positions: what shares such a
list has reached the tally.  These lists have at most 65,536 members, all equal but for two bytes; those that are still long
are dealt by each member itself and its 16 one-bit neighbours within the two open bytes: members within two bits meet
there and link to the smallest, which keeps rows linear and components exact.

Texts that are null, empty or without words have fingerprint zero and are linked like any other.  Repeated
doc_ids give repeated rows; null doc_ids never become a component's id unless it has no other.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigloom.llm.common import Cut, arrow_pass
from sigloom.llm.components import connected

WORDS, BITS, NEEDED, PAIRED, SEED = 3, 2, 6, 32, 42
CHUNK = 1 << 15


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """Unsigned 64-bit SimHash of the word shingles of a text, repeats included."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return 0
    shingles = map(b" ".join, zip(*(w[i:] for i in range(words)), strict=False)) if len(w) >= words else [b" ".join(w)]
    digest, seed = xxhash.xxh64_intdigest, SEED
    h = np.array([digest(s, seed) for s in shingles], ">u8")
    counts = np.zeros(64, np.int64)
    for at in range(0, len(h), CHUNK):
        counts += np.unpackbits(h[at : at + CHUNK].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * counts > len(h)).tobytes(), "big")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame) -> DataFrame:
    """``(doc_id, fp)`` with the fingerprint as a signed long."""
    return arrow_pass(docs.select("doc_id", "text"), lambda c: {"doc_id": c["doc_id"], "fp": [_signed(fingerprint(t)) for t in c["text"]]}, "doc_id long, fp long")


def _mask(positions) -> int:
    return _signed(sum(0xFF << 8 * p for p in positions))


def tally(a: Column, b: Column) -> Column:
    """How many positional bytes two fingerprints share."""
    x = a.bitwiseXOR(b)
    return sum((F.when(x.bitwiseAND(F.lit(_mask([p]))) == 0, 1).otherwise(0) for p in range(8)), F.lit(0))


def _pairs(lists: DataFrame) -> DataFrame:
    """``(a, b)``: the pairs of ``lists (fps)`` that reach the tally and are within ``BITS``."""
    each = lists.select("fps", F.explode("fps").alias("a"))
    each = each.select("a", F.explode(F.filter("fps", lambda b: b < F.col("a"))).alias("b"))
    return each.where(tally(F.col("a"), F.col("b")) >= NEEDED).where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= BITS)


def links(distinct: DataFrame, cut: Cut | None = None) -> DataFrame:
    """``(a, b)`` edges that connect all of ``distinct (fp)`` within two bits, and only those."""
    cut = cut or Cut(distinct.sparkSession)
    masks = [_mask(2 * i + k for i in kept for k in (0, 1)) for kept in combinations(range(4), 2)]
    postings = F.explode(F.array(*[F.struct(F.lit(i).alias("c"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(masks)]))
    postings = distinct.repartition("fp").select("fp", postings.alias("p")).select("fp", "p.c", "p.key")
    sizes = postings.groupBy("c", "key").agg(F.count("*").alias("n")).where("n > 1")
    members = cut.write(postings.join(sizes, ["c", "key"]))
    short = members.where(F.col("n") <= PAIRED).groupBy("c", "key").agg(F.collect_list("fp").alias("fps"))
    return _pairs(short).union(_split(members.where(F.col("n") > PAIRED).select("fp").distinct()))


def _split(dense: DataFrame) -> DataFrame:
    """The same for the members of long lists, by six positional bytes."""
    choices = []
    for kept in combinations(range(8), NEEDED):
        open_bits = [8 * p + b for p in range(8) if p not in kept for b in range(8)]
        choices.append((_mask(kept), open_bits))
    postings = F.explode(F.array(*[F.struct(F.lit(i).alias("c"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, (m, _) in enumerate(choices)]))
    lists = dense.select("fp", postings.alias("p")).groupBy("p.c", "p.key").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)
    flips = F.array(*[F.array(F.lit(0).cast("long"), *[F.lit(_signed(1 << b)) for b in bits]) for _, bits in choices])
    long = lists.where(F.size("fps") > PAIRED).select("c", F.explode("fps").alias("a"))
    long = long.select("a", "c", F.explode(F.transform(F.get(flips, F.col("c")), lambda f: f.bitwiseXOR(F.col("a")))).alias("v"))
    hubs = long.groupBy("v", "c").agg(F.min("a").alias("b"), F.max("a").alias("top")).where("b < top")
    long = long.join(hubs, ["v", "c"]).where("a > b").select("a", "b").where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= BITS)
    return _pairs(lists.where(F.size("fps") <= PAIRED)).union(long)


def near_groups(docs: DataFrame) -> DataFrame:
    """``(doc_id, fp, component_id)`` for each row of ``docs``."""
    cut = Cut(docs.sparkSession)
    prints = cut.write(fingerprints(docs))
    own = cut.write(prints.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = connected(cut, links(own.select("fp"), cut))
    member = own.join(roots, own.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    ids = member.groupBy("root").agg(F.min("first").alias("component_id"))
    return prints.join(cut.write(member.join(ids, "root").select("fp", "component_id")), "fp").select("doc_id", "fp", "component_id")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """The contract's row for each document."""
    return near_groups(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id is their component's smallest; all columns stay.

    A row without doc_id stays. Of rows that share one doc_id, all stay or none."""
    groups = near_groups(docs).where("doc_id is not null").groupBy("doc_id").agg(F.min("component_id").alias("_kept"))
    gone = groups.where("doc_id <> _kept").select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
