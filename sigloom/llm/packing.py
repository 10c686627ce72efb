"""Best-fit packing into fixed-length sequences by a grouping genetic algorithm on islands.

Texts are tokenised by white-space-free chunks: no token of this vocabulary's splitter spans ASCII white
space, so a text's ids are its chunks' ids joined.  The distinct chunks of some texts are looked up at once, and a
worker remembers a bounded number of them.  Pieces
are dealt evenly into blocks of about ``BLOCK`` pieces.  A block is one packing problem, evolved on
``ISLANDS`` islands: crossover injects whole well-filled bins of one parent into the other, drops the bins
that hold their documents twice and best-fits the displaced documents.  After the first epoch every
island's elite migrates to the next island of its block, and the better result of the second epoch stays.
An island stops as soon as it reaches the lower bound, and a block with such an island has no second epoch.
The bins that end up loosely filled, a few in each block, are pooled for 64 blocks at a time and packed again.

Null texts count as empty and are one piece of one id.  Repeated rows, null doc_ids and ties are pieces
like any other.  An empty table gives no rows.  Other columns are ignored.
"""

from __future__ import annotations

import json
import os
import random
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sigloom.llm.common import Cut, _arrow_schema, fresh, held

LENGTH, BLOCK, ISLANDS, POPULATION, GENERATIONS, POOLED = 2048, 8192, 2, 4, 6, 64
TIGHT = 0.995
#: Chunks that a worker remembers of those the library encodes, and bytes beyond which none is remembered or merged in rows.
HELD, LONG = 50_000, 64
#: Bytes of texts whose ids are made at once, if there is more than one.
AT_ONCE = 4 << 20


class Merges:
    """The vocabulary's merges, for many runs at once: in each step every run of the present width merges its pair of lowest rank,
    the leftmost of equal ones, and meets the shorter runs.  As the library does it, one merge after another."""

    NONE, BITS = np.int32(np.iinfo(np.int32).max), 18

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        signs = {b: chr(b) for b in (*range(33, 127), *range(161, 173), *range(174, 256))}  # the byte-level alphabet
        signs |= {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in signs)}
        self.inner, self.last = (np.array([vocab[signs[b] + x] for b in range(256)], np.int32) for x in ("", end))
        self.made = np.array([vocab[x + y] for x, y in model["merges"]], np.int32)
        keys = [vocab[x] << 16 | vocab[y] for x, y in model["merges"]]
        self.keys, self.ranks = np.full(1 << self.BITS, -1, np.int64), np.full(1 << self.BITS, self.NONE)
        for rank, (key, at) in enumerate(zip(keys, self.slots(np.array(keys)).tolist(), strict=True)):
            while self.keys[at] not in (-1, key):
                at = (at + 1) % len(self.keys)
            self.keys[at], self.ranks[at] = key, rank

    def slots(self, keys: np.ndarray) -> np.ndarray:
        return (keys * 0x9E3779B1 & 0xFFFFFFFF) >> (32 - self.BITS)

    def rank(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """The ranks of the pairs ``x, y``, ``NONE`` where no merge has them."""
        keys = x.astype(np.int64) << 16 | y
        at = self.slots(keys)
        there = self.keys[at]
        out = np.where(there == keys, self.ranks[at], self.NONE)
        seek = np.flatnonzero((there != keys) & (there != -1))
        while len(seek):
            at[seek] = (at[seek] + 1) % len(self.keys)
            there = self.keys[at[seek]]
            out[seek] = np.where(there == keys[seek], self.ranks[at[seek]], self.NONE)
            seek = seek[(there != keys[seek]) & (there != -1)]
        return out

    def encode(self, raw: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of runs of bytes, one behind the other, and how many each has."""
        order = np.argsort(sizes, kind="stable")
        groups, n, done = np.searchsorted(sizes[order], np.arange(int(sizes.max(initial=0)) + 2)), np.zeros(len(sizes), np.int32), []
        rows, ids, ranks = np.zeros(0, np.int64), np.zeros((0, 0), np.int32), np.zeros((0, 0), np.int32)
        for width in range(len(groups) - 2, 0, -1):
            own = order[groups[width] : groups[width + 1]]
            if len(own):
                text = raw[starts[own][:, None] + np.arange(width)]
                own_ids = self.inner[text]
                own_ids[:, -1] = self.last[text[:, -1]]
                own_ranks = self.rank(own_ids[:, :-1].ravel(), own_ids[:, 1:].ravel()).reshape(len(own), width - 1)
                rows, ids, ranks = (np.concatenate(x) if len(rows) else x[1] for x in ((rows, own), (ids, own_ids), (ranks, own_ranks)))
            if not len(rows):
                continue
            at = ranks.argmin(1) if width > 1 else np.zeros(len(rows), np.int64)
            low = ranks[np.arange(len(rows)), at] if width > 1 else np.full(len(rows), self.NONE)
            over = low == self.NONE
            n[rows[over]] = width
            done.append((rows[over], ids[over]))
            rows, ids, ranks, at, low = (x[~over] for x in (rows, ids, ranks, at, low))
            each, stay = np.arange(len(rows)), np.ones(ids.shape, bool)
            stay[each, at + 1] = False
            ids[each, at] = self.made[low]
            ids = ids[stay].reshape(len(rows), width - 1)
            stay = np.ones(ranks.shape, bool)
            stay[each, at] = False
            ranks = ranks[stay].reshape(len(rows), max(width - 2, 0))
            for side in (-1, 0):
                k = np.flatnonzero((at + side >= 0) & (at + side < width - 2))
                ranks[k, at[k] + side] = self.rank(ids[k, at[k] + side], ids[k, at[k] + side + 1])
        out, firsts = np.zeros(int(n.sum(dtype=np.int64)), "<u4"), np.cumsum(n, dtype=np.int64) - n
        for which, found in done:
            out[firsts[which][:, None] + np.arange(found.shape[1])] = found
        return out, n


class Chunks:
    """Ids of texts as little-endian unsigned 32-bit bytes, made of those of the distinct white-space-free chunks of some texts.

    A chunk of letters and marks is put together from its lower-cased letters and its marks, which the vocabulary's splitter
    always parts; of the distinct ones all are merged at once.  Any other chunk is encoded by the library as it stands."""

    #: Letters that lower-casing and composition leave as they are, then marks that form one token run.
    PLAIN = "^(?P<letters>[a-zß-öø-ÿ]+)(?P<marks>[.,;:!?*#$%&|]*)$"

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.merges, self.known = Tokenizer.from_file(path), Merges(path), {}

    def encode(self, text: str) -> np.ndarray:
        got = self.known.get(text)
        if got is None:
            got = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")
            if len(text) <= LONG:
                if len(self.known) >= HELD:
                    self.known.clear()
                self.known[text] = got
        return got

    def parts(self, texts: pa.Array, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of ``texts``, one behind the other, and how many each has; the ``whole`` ones go to the library, and long ones."""
        ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
        sizes = np.diff(ends)
        whole = whole | (sizes > LONG)
        raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
        ids, n = self.merges.encode(raw, ends[:-1].astype(np.int64), np.where(whole, 0, sizes))
        at = np.flatnonzero(whole)
        if len(at):
            more = [self.encode(x) for x in texts.take(pa.array(at)).to_pylist()]
            # what the library has made stands behind the rest, and is put in its place
            places, n[at] = np.cumsum(n, dtype=np.int64) - n, [len(x) for x in more]
            places[at] = len(ids) + np.cumsum([0, *(len(x) for x in more)])[:-1]
            ids = np.concatenate([ids, *more])[np.repeat(places - (np.cumsum(n, dtype=np.int64) - n), n) + np.arange(int(n.sum(dtype=np.int64)))]
        return ids, n

    def blobs(self, texts: pa.Array) -> list[bytes]:
        """The ids of each of ``texts``."""
        lists = pc.ascii_split_whitespace(texts.fill_null(""))
        words = lists.flatten().dictionary_encode()
        chunks, n = words.dictionary, len(words.dictionary)
        plain = pc.extract_regex(pc.utf8_lower(chunks), self.PLAIN)
        whole = pc.or_(pc.is_null(plain), pc.match_substring(chunks, "İ"))  # the one letter that becomes two
        both = pa.concat_arrays([pc.if_else(whole, chunks, pc.struct_field(plain, 0)), pc.if_else(whole, "", pc.struct_field(plain, 1))]).dictionary_encode()
        codes, odd = both.indices.to_numpy(), np.zeros(len(both.dictionary), bool)
        odd[codes[:n][whole.to_numpy(zero_copy_only=False)]] = True
        ids, sizes = _joined(*self.parts(both.dictionary, odd), codes.reshape(2, n).T.ravel())
        ids, sizes = _joined(ids, sizes.reshape(n, 2).sum(1), words.indices.to_numpy())
        ends, counts = np.concatenate(([0], np.cumsum(sizes, dtype=np.int64))), pc.list_value_length(lists).to_numpy()
        cuts = ends[np.concatenate(([0], np.cumsum(counts)))].tolist()
        return [ids[i:j].tobytes() for i, j in zip(cuts, cuts[1:], strict=False)]

    def ids(self, text: str | None) -> bytes:
        return self.blobs(pa.array([(text or "").encode("utf-8", "replace").decode()], pa.string()))[0]


def _joined(ids: np.ndarray, sizes: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of runs of ``ids`` with these ``sizes`` those at ``places``, one behind the other, and their sizes."""
    n = sizes[places]
    back = (np.cumsum(sizes, dtype=np.int64) - sizes)[places] - (np.cumsum(n, dtype=np.int64) - n)
    return ids[np.repeat(back, n) + np.arange(int(n.sum(dtype=np.int64)))], n


@held
@lru_cache(maxsize=2)
def chunks(path: str) -> Chunks:
    """One cache for all tasks of a Python worker."""
    return Chunks(path)


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


ITEMS = "doc_id long, piece int, start long, length long, ids_crc32 long, deal long"


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """``batch (doc_id, text)`` in slices of one row or of up to ``AT_ONCE`` bytes."""
    ends = np.cumsum(pc.binary_length(batch.column(1)).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
    lo = 0
    while lo < batch.num_rows:
        most = (ends[lo - 1] if lo else 0) + AT_ONCE
        hi = max(lo + 1, int(np.searchsorted(ends, most, "right")))
        yield batch.slice(lo, hi - lo)
        lo = hi


def pieces(docs: DataFrame, path: str, length: int = LENGTH) -> DataFrame:
    """A row for each piece of each document, with an evenly spread number to deal it by."""
    arrow = _arrow_schema(ITEMS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh(chunks)
        own, at, task = chunks(path), 0, TaskContext.get().partitionId()
        for whole in batches:
            for part in slices(whole):
                rows = []
                for doc, blob in zip(part.column(0).to_pylist(), own.blobs(part.column(1)), strict=True):
                    blob += b"\x00\x00\x00\x00"
                    for k, i in enumerate(range(0, len(blob), 4 * length)):
                        piece = blob[i : i + 4 * length]
                        rows.append((doc, k, i // 4, len(piece) // 4, zlib.crc32(piece), (task << 40) + at))
                        at += 1
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(arrow)], schema=arrow)

    return docs.select("doc_id", "text").mapInArrow(run, ITEMS)


class Bins:
    """Best fit: the open bin with the least room that still takes the item, by a bit set of rooms."""

    def __init__(self, size: int):
        self.size, self.rooms, self.mask, self.bins = size, [[] for _ in range(size + 1)], 0, []

    def add(self, items: list[int], room: int) -> None:
        if room:
            self.rooms[room].append(len(self.bins))
            self.mask |= 1 << room
        self.bins.append((items, room))

    def fit(self, item: int, n: int) -> None:
        up = self.mask >> n
        if not up:
            self.add([item], self.size - n)
            return
        room = n + (up & -up).bit_length() - 1
        at = self.rooms[room].pop()
        if not self.rooms[room]:
            self.mask &= ~(1 << room)
        items = self.bins[at][0]
        items.append(item)
        left = room - n
        self.bins[at] = (items, left)
        if left:
            self.rooms[left].append(at)
            self.mask |= 1 << left


def best_fit(lengths: list[int], order: list[int], size: int, kept: list[tuple[list[int], int]] = ()) -> list[tuple[list[int], int]]:
    """Bins ``(items, room)``: ``kept`` ones, filled up and added to with ``order``."""
    out = Bins(size)
    for items, room in kept:
        out.add(list(items), room)
    for i in order:
        out.fit(i, lengths[i])
    return out.bins


def fitness(bins: list[tuple[list[int], int]], size: int) -> float:
    return sum((1 - room / size) ** 2 for _, room in bins) / max(1, len(bins))


def crossover(a: list, b: list, lengths: list[int], size: int, rng: random.Random) -> list:
    """``a`` with some whole well-filled bins of ``b``; what they displace is best-fitted, longest first."""
    good = [x for x in b if x[1] <= (1 - TIGHT) * size]
    if not good:
        good = sorted(b, key=lambda x: x[1])[: max(1, len(b) // 10)]
    inject = rng.sample(good, max(1, min(len(good), len(b) // 12)))
    held = {i for items, _ in inject for i in items}
    stay, displaced = [], []
    for items, room in a:
        if held.isdisjoint(items):
            stay.append((items, room))
        else:
            displaced += [i for i in items if i not in held]
    # loosely filled bins are opened as well, as their documents are what is left to place better
    loose = sorted(stay, key=lambda x: -x[1])[: max(1, len(stay) // 50)]
    opened = {id(x[0]) for x in loose if x[1] > 0}
    for items, _ in loose:
        if id(items) in opened:
            displaced += items
    stay = [x for x in stay if id(x[0]) not in opened]
    displaced.sort(key=lambda i: -lengths[i])
    return best_fit(lengths, displaced, size, inject + stay)


def evolve(lengths: list[int], size: int, seed: int, elites: list = (), population: int = POPULATION, generations: int = GENERATIONS) -> list:
    """The best bins found for items of these lengths, none over ``size``; ``elites`` start in the population."""
    bound = -(-sum(lengths) // size)
    rng = random.Random(seed)
    down = sorted(range(len(lengths)), key=lambda i: -lengths[i])
    people = list(elites) or [best_fit(lengths, down, size)]
    done = lambda: any(len(p) <= bound for p in people)
    while len(people) < population and not done():
        order = sorted(range(len(lengths)), key=lambda i: -lengths[i] * (0.75 + rng.random() / 2))
        people.append(best_fit(lengths, order, size))
    rank = lambda p: (len(p), -fitness(p, size))
    for _ in range(generations):
        if done() or len(people) < 2:
            break
        people.sort(key=rank)
        child = crossover(people[0], people[rng.randrange(1, len(people))], lengths, size, rng)
        if rank(child) < rank(people[-1]):
            people[-1] = child
        other = crossover(people[rng.randrange(1, len(people))], people[0], lengths, size, rng)
        if rank(other) < rank(people[-1]):
            people[-1] = other
    return min(people, key=rank)


PACKED = "doc_id long, piece int, start long, length long, ids_crc32 long, block long, island int, bin long, offset long, room long, n_bins long, fit double"


def _as_rows(rows: pd.DataFrame, bins: list, size: int) -> pd.DataFrame:
    at, offset, room = (np.zeros(len(rows), np.int64) for _ in range(3))
    lengths = rows["length"].to_numpy()
    for k, (items, left) in enumerate(bins):
        at[items], room[items] = k, left
        offset[items] = np.cumsum(lengths[items]) - lengths[items]
    return rows.assign(bin=at, offset=offset, room=room, n_bins=len(bins), fit=fitness(bins, size))


def _from_rows(bins: np.ndarray, lengths: np.ndarray, size: int) -> list:
    order = np.argsort(bins, kind="stable")
    cuts = np.flatnonzero(np.diff(bins[order])) + 1
    return [(x.tolist(), int(size - lengths[x].sum())) for x in np.split(order, cuts)] if len(bins) else []


COLUMNS = [x.split()[0] for x in PACKED.split(", ")]


def states(islands: DataFrame, size: int) -> DataFrame:
    """``(block, best, done)``: a block's best island, and whether that reached the lower bound: a second epoch would return it
    as it is.  ``islands`` has every item of a block once for each island."""
    state = islands.groupBy("block").agg(F.min(F.struct("n_bins", -F.col("fit"), "island")).alias("best"), F.sum("length").alias("total"))
    return state.select("block", "best", (F.col("best.n_bins") * (size * ISLANDS) < F.col("total") + size * ISLANDS).alias("done"))


def pack(docs: DataFrame, path: str | None = None, length: int = LENGTH, block: int = BLOCK) -> DataFrame:
    """The contract's row for each piece: its place in its document and in its sequence."""
    cut = Cut(docs.sparkSession)
    items = cut.write(pieces(docs, path or tokenizer_path(), length))
    blocks = max(1, -(-items.count() // block))
    items = items.withColumn("block", F.pmod(F.xxhash64("deal"), F.lit(blocks)).cast("long"))
    here = ["doc_id", "piece", "start", "length", "ids_crc32", "block"]

    def first(rows: pd.DataFrame) -> pd.DataFrame:
        fresh()
        rows = rows.sort_values("deal", ignore_index=True)
        seed = int(rows["block"][0]) * ISLANDS + int(rows["island"][0])
        return _as_rows(rows, evolve(rows["length"].tolist(), length, seed), length)[[*COLUMNS, "deal"]]

    def second(rows: pd.DataFrame) -> pd.DataFrame:
        fresh()
        rows = rows.sort_values(["migrant", "deal"], ignore_index=True)
        own = rows[rows["migrant"] == 0].reset_index(drop=True)
        away = rows[rows["migrant"] == 1].reset_index(drop=True)
        lengths = own["length"].to_numpy()
        elites = [_from_rows(x["bin"].to_numpy(), lengths, length) for x in (own, away)]
        seed = 1_000_003 * (1 + int(own["block"][0])) + int(own["island"][0])
        return _as_rows(own, evolve(lengths.tolist(), length, seed, elites), length)[COLUMNS]

    def pooled(rows: pd.DataFrame) -> pd.DataFrame:
        fresh()
        rows = rows.sort_values(["block", "bin", "offset"], ignore_index=True)
        old = (rows["block"] * (1 << 32) + rows["bin"]).to_numpy()
        elite = _from_rows(np.unique(old, return_inverse=True)[1], rows["length"].to_numpy(), length)
        best = evolve(rows["length"].tolist(), length, int(rows["pool"][0]), [elite, best_fit(rows["length"].tolist(), sorted(range(len(rows)), key=lambda i: -rows["length"][i]), length)])
        return _as_rows(rows, best, length).assign(sequence_id=lambda x: -1 - (x["pool"] * (1 << 32) + x["bin"]))[[*OUT]]

    islands = F.explode(F.array(*[F.lit(i) for i in range(ISLANDS)]))
    one = cut.write(items.withColumn("island", islands).groupBy("block", "island").applyInPandas(first, f"{PACKED}, deal long"))
    state = cut.write(states(one, length))
    done = one.join(state.where("done"), "block").where("island = best.island").select(*COLUMNS)
    rest = one.join(state.where("not done").select("block"), "block") if not state.where("not done").isEmpty() else None
    move = F.struct((F.col("island") + 1) % ISLANDS, F.lit(1))
    places = F.explode(F.array(F.struct(F.col("island").alias("island"), F.lit(0).alias("migrant")), F.struct(move["col1"].cast("int").alias("island"), F.lit(1).alias("migrant"))))
    two = done
    if rest is not None:
        moved = rest.select(*here, "bin", "offset", "room", "n_bins", "fit", "deal", places.alias("p")).select("*", "p.island", "p.migrant").drop("p")
        later = moved.groupBy("block", "island").applyInPandas(second, PACKED)
        best = Window.partitionBy("block")
        later = later.withColumn("best", F.min(F.struct("n_bins", -F.col("fit"), "island")).over(best)).where("island = best.island").drop("best")
        two = done.union(later.select(*COLUMNS))
    two = cut.write(two)
    cut.drop(one)
    tight = two.where(F.col("room") <= length * (1 - TIGHT)).withColumn("sequence_id", F.col("block") * F.lit(1 << 32) + F.col("bin"))
    loose = two.where(F.col("room") > length * (1 - TIGHT)).withColumn("pool", F.floor(F.col("block") / POOLED).cast("long"))
    loose = loose.groupBy("pool").applyInPandas(pooled, OUT_SCHEMA)
    return tight.select(*OUT).union(loose)


OUT = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
OUT_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
