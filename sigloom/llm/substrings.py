"""Suffix-array deduplication: bytes of repeated ``LENGTH``-byte strings go, but for their first document.

1. Documents are packed, as the scan meets them, into groups of about ``GROUP`` bytes, which are written once
   in buckets of the group's number; later passes meet their group without moving texts.
2. Every string of ``LENGTH`` bytes is owned by one of its ``ANCHOR``-byte windows, the one of least hash, so
   equal strings have equal owners.  Groups send the distinct hashes of their owners; hashes met in one
   document only are ruled out, exactly, as none of their strings can repeat.  This is a candidate search.
3. For each remaining owner a group sends the snippet around it that holds the strings it owns, once for
   equal snippets, to the shard of the owner's hash.  A shard rules out, exactly, the strings whose hash comes in
   one place of its distinct snippets only, and sorts all suffixes of the rest by external induced sorting
   (``suffix``); neighbours with a common prefix of ``LENGTH`` are equal strings, and each class gets its smallest doc_id.
4. The doc_ids go back to the groups, where each occurrence in a document of larger doc_id is removed.

Owners met in more than ``HOT`` places send their strings one by one, to shards by content, so that one
frequent phrase in ever other surroundings doesn't gather in one shard.

Null texts are empty; rows without doc_id neither lose anything nor cause a removal; rows that share a
doc_id don't remove each other's bytes and are judged alike.  An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import io
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigloom.llm.common import Cut, _arrow_schema, fresh
from sigloom.llm.suffix import sort_suffixes

LENGTH, ANCHOR = 50, 16
GROUP, BUCKET, SHARD, HOT, QUEUES = 6 << 20, 1_500_000, 2 << 20, 20_000, 2 << 20
#: Texts of up to this size are sent as they are; strings that a shard's replies are worked out for at once.
SHORT, AT_ONCE = 4096, 1 << 20
STEP = 1 << 16
NEVER = np.iinfo(np.int64).max
A, B, C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
LOW = np.uint64((1 << 18) - 1)


def squeeze(x: bytes | np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(x if isinstance(x, bytes) else np.ascontiguousarray(x).tobytes())


def squeezed_text(x: bytes) -> bytes:
    """``x``, whole UTF-8 or parts of it, squeezed unless it is short; ``plain_text`` tells them apart by the byte 0xFD of a frame's
    mark, which UTF-8 never has."""
    return squeeze(x) if len(x) > SHORT else x


def plain_text(x: bytes) -> bytes:
    return unsqueeze(x) if x[:4] == zstandard.FRAME_HEADER else x


def unsqueeze(x: bytes, kind=None) -> bytes | np.ndarray:
    raw = zstandard.ZstdDecompressor().decompress(x)
    return raw if kind is None else np.frombuffer(raw, kind)


def stretches(values: np.ndarray) -> Iterator[tuple[int, int]]:
    """Start and end of each stretch of equal values: only those that are there, however many there could be."""
    cuts = (np.flatnonzero(values[1:] != values[:-1]) + 1).tolist()
    return zip([0, *cuts], [*cuts, len(values)], strict=True) if len(values) else iter(())


def anchors(t: np.ndarray, ends: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of strings of ``length`` with one owner: owner's hash (48 bits), first start, number of starts, document.
    ``t``: the bytes of documents that end before ``ends``."""
    width = length - ANCHOR + 1
    hashes, lows, counts = [], [], []
    n = len(t)
    starts = np.concatenate([[0], ends[:-1]])
    long = ends - starts >= length
    # the first starts of documents, and the places behind their last starts, cut runs
    first, stop = starts[long], ends[long] - length + 1
    pad = np.concatenate([t, np.zeros(LENGTH + length + 16, np.uint8)])
    for lo in range(0, n, STEP):
        m = min(STEP, n - lo)
        k = m + width - 1
        w = np.ndarray((k + 8,), "<u8", pad.data, lo, (1,))
        h = w[:k] * A
        h ^= h >> np.uint64(29)
        h += w[8 : k + 8]
        h *= B
        h ^= h >> np.uint64(32)
        h *= A
        key = (h & ~LOW) | np.arange(k, dtype=np.uint64)
        s = 1
        while 2 * s <= width:
            key = np.minimum(key[:-s], key[s:])
            s *= 2
        if width > s:
            key = np.minimum(key[: s - width], key[width - s :])
        own = (key[:m] & LOW).astype(np.int64)
        at = np.concatenate([[0], np.flatnonzero(own[1:] != own[:-1]) + 1])
        # cut at the borders of documents too
        border = np.concatenate([first[np.searchsorted(first, lo) : np.searchsorted(first, lo + m)], stop[np.searchsorted(stop, lo) : np.searchsorted(stop, lo + m)]]) - lo
        at = np.union1d(at, border)
        size = np.diff(np.append(at, m))
        inside = np.searchsorted(first, at + lo, side="right") > np.searchsorted(stop, at + lo, side="right")
        at, size = at[inside], size[inside]
        g = h[own[at]]
        g = (g ^ (g >> np.uint64(31))) * C
        hashes.append(g >> np.uint64(16))
        lows.append(at + lo)
        counts.append(size)
    if not hashes:
        return np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(3))
    low = np.concatenate(lows)
    return np.concatenate(hashes), low, np.concatenate(counts), np.searchsorted(ends, low, side="right")


class Group:
    """A group's documents, read from its row."""

    def __init__(self, ids: bytes, sizes: bytes, text: bytes, length: int):
        self.ids, self.sizes = np.frombuffer(ids, np.int64), np.frombuffer(sizes, np.int64)
        self.text = unsqueeze(text, np.uint8)
        self.ends = np.cumsum(self.sizes)
        self.hash, self.low, self.count, self.doc = anchors(self.text, self.ends, length)
        known = self.ids[self.doc] != NEVER
        if not known.all():
            self.hash, self.low, self.count, self.doc = self.hash[known], self.low[known], self.count[known], self.doc[known]

    def owners(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct hashes in order, occurrences, whether in documents of different doc_id, and where each anchor's is."""
        values, back, n = np.unique(self.hash, return_inverse=True, return_counts=True)
        order = np.argsort(back, kind="stable")
        ids = self.ids[self.doc][order]
        cuts = np.cumsum(n) - n
        several = np.minimum.reduceat(ids, cuts) != np.maximum.reduceat(ids, cuts) if len(n) else np.zeros(0, bool)
        return values, n, several, back

    def snippets(self, flags: np.ndarray, back: np.ndarray, shards: int, length: int) -> tuple:
        """Candidate occurrences and their distinct snippets, numbered by first occurrence in ascending doc_id: start,
        number of strings, document and snippet of each occurrence; first occurrence and shard of each snippet."""
        flag = flags[back]
        take = np.flatnonzero(flag > 0)
        low, count, doc, h, hot = self.low[take], self.count[take], self.doc[take], self.hash[take], flag[take] > 1
        if hot.any():
            each = np.where(hot, count, 1)
            at = np.repeat(np.arange(len(take)), each)
            inner = np.arange(len(at)) - np.repeat(np.cumsum(each) - each, each)
            low, doc, h = low[at] + inner, doc[at], h[at]
            count = np.where(hot[at], 1, count[at])
            hot = hot[at]
        raw, seen = self.text.tobytes(), {}
        spans = zip(low.tolist(), (low + count + length - 1).tolist(), strict=True)
        number = np.fromiter((seen.setdefault(raw[a:b], len(seen)) for a, b in spans), np.int64, len(low))
        first = np.full(len(seen), -1, np.int64)
        first[number[::-1]] = np.arange(len(number))[::-1]
        shard = ((h[first] * A) >> np.uint64(40)).astype(np.int64)
        for i in np.flatnonzero(hot[first]):
            a = low[first[i]]
            shard[i] = int.from_bytes(hashlib.blake2b(raw[a : a + length], digest_size=5).digest(), "big")
        return low, count, doc, number, first, shard % shards


PACKED = "g long, ids binary, sizes binary, text binary, rest binary"


def pack(docs: DataFrame) -> DataFrame:
    """Groups of documents with their other columns; ``docs`` has doc_id and text."""
    arrow = _arrow_schema(PACKED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh()
        number = TaskContext.get().partitionId() << 32
        held: list[pa.RecordBatch] = []
        size = 0

        def out() -> pa.RecordBatch:
            nonlocal number, size
            t = pa.Table.from_batches(held)
            ids = t.column("doc_id").cast(pa.int64()).fill_null(NEVER).to_numpy()
            order = np.argsort(ids, kind="stable")
            t = t.take(pa.array(order))
            texts = [(x or "").encode("utf-8", "surrogatepass") for x in t.column("text").to_pylist()]
            sink = io.BytesIO()
            rest = t.set_column(t.schema.get_field_index("text"), "text", pa.array([x is None for x in t.column("text").to_pylist()]))
            with pa.ipc.new_stream(sink, rest.schema) as w:
                w.write_table(rest)
            row = (number, ids[order].tobytes(), np.array([len(x) for x in texts], np.int64).tobytes(), squeeze(b"".join(texts)), squeeze(sink.getvalue()))
            number, size = number + 1, 0
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, arrow, strict=True)], schema=arrow)

        for b in batches:
            at = 0
            lengths = np.cumsum([len(x.as_py() or "") for x in b.column(b.schema.get_field_index("text"))]) if b.num_rows else np.zeros(0)
            while at < b.num_rows:
                done = lengths[at - 1] if at else 0
                end = int(np.searchsorted(lengths, done + GROUP - size)) + 1
                part = b.slice(at, end - at)
                held.append(part)
                size += int(lengths[min(end, b.num_rows) - 1] - done)
                at = end
                if size >= GROUP:
                    yield out()
        if held:
            yield out()

    return docs.mapInArrow(run, PACKED)


class Written:
    """The groups as a bucketed table in the shared folder; ``drop`` takes it out of the catalogue."""

    def __init__(self, cut: Cut, groups: DataFrame, buckets: int):
        self.cut, self.name = cut, f"sigloom_{uuid.uuid4().hex}"
        path = f"{cut.root}/{self.name}"
        groups.write.bucketBy(buckets, "g").option("path", path).option("compression", "uncompressed").saveAsTable(self.name)
        self.frame = cut.spark.table(self.name)


def _flags(rows: pd.DataFrame, n: int) -> np.ndarray:
    """The flags of a group's owners from its rows of step 2, in the order of hashes."""
    got = [np.frombuffer(x, np.uint8) for x in rows[rows["kind"] == 0].sort_values("part")["data"]]
    out = np.concatenate(got) if got else np.zeros(0, np.uint8)
    return out if len(out) == n else np.zeros(n, np.uint8)


REPLY = "g long, kind int, part long, data binary, more binary"


def _owners(groups: DataFrame, buckets: int, length: int) -> DataFrame:
    schema = "bucket long, g long, hashes binary, counts binary"
    arrow = _arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                fresh()
                values, n, several, _ = Group(r["ids"], r["sizes"], r["text"], length).owners()
                at = ((values >> np.uint64(16)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
                counts = (np.minimum(n, 127) | (several.astype(np.int64) << 7)).astype(np.uint8)
                six = np.ascontiguousarray(values).view(np.uint8).reshape(-1, 8)[:, :6]
                rows = [(int(at[x]), r["g"], six[x:y].tobytes(), counts[x:y].tobytes()) for x, y in stretches(at)]
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], f.type) for i, f in enumerate(arrow)], schema=arrow)

    return groups.select("g", "ids", "sizes", "text").mapInArrow(run, schema)


def _judge(rows: pd.DataFrame) -> pd.DataFrame:
    """Flags of all owners of a bucket: 1 where two documents may share it, 2 where very many places do."""
    sizes = [len(x) for x in rows["counts"]]
    raw = np.frombuffer(b"".join(rows["hashes"]), np.uint8).reshape(-1, 6)
    wide = np.zeros((len(raw), 8), np.uint8)
    wide[:, :6] = raw
    counts = np.frombuffer(b"".join(rows["counts"]), np.uint8)
    _, back, groups = np.unique(wide.view("<u8").ravel(), return_inverse=True, return_counts=True)
    several = np.bincount(back, counts >> 7) > 0
    total = np.bincount(back, counts & 127)
    flag = ((groups > 1) | several).astype(np.uint8)
    flag += (flag > 0) & (total > HOT)
    out = flag[back]
    ends = np.cumsum(sizes)
    data = [out[e - s : e].tobytes() for e, s in zip(ends, sizes, strict=True)]
    return pd.DataFrame({"g": rows["g"], "kind": 0, "part": rows["bucket"], "data": data, "more": [b""] * len(rows)})


def recurring(t: np.ndarray, first: np.ndarray, strings: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of the stretches of those starts of strings of ``length`` whose hash comes again in ``t``: all strings that
    do, and few others.  Snippet i has ``strings[i]`` starts from ``first[i]`` on, and at least one place behind them has none."""
    n = len(t)
    pad = np.concatenate([t, np.zeros(length + 8, np.uint8)])
    steps = [*range(8, length - 7, 8), length - 8]
    h = np.empty(n, np.uint64)
    for lo in range(0, n, STEP):
        m = min(STEP, n - lo)
        w = np.ndarray((m + length,), "<u8", pad.data, lo, (1,))
        x = w[:m] * A
        for at in steps:
            x ^= x >> np.uint64(29)
            x += w[at : at + m]
            x *= B
        h[lo : lo + m] = x ^ (x >> np.uint64(32))
    edge = np.zeros(n + 1, np.int8)
    edge[first] += 1
    edge[first + strings] -= 1
    starts = np.cumsum(edge[:n], dtype=np.int8) > 0
    own = h[starts]
    own.sort()
    again = own[1:][own[1:] == own[:-1]]
    del own
    # a table of remainders leaves few to look up
    mask = np.uint64((1 << max(10, (8 * len(again)).bit_length())) - 1)
    held = np.zeros(int(mask) + 1, bool)
    held[(again & mask).astype(np.int64)] = True
    starts &= held[(h & mask).astype(np.int64)]
    asked = np.flatnonzero(starts)
    asked_h = h[asked]
    starts[asked[again[np.minimum(np.searchsorted(again, asked_h), len(again) - 1)] != asked_h] if len(again) else asked] = False
    turns = np.flatnonzero(np.diff(starts.view(np.int8), prepend=np.int8(0), append=np.int8(0)))
    return turns[::2], turns[1::2]


def _sort(rows: pd.DataFrame, length: int) -> pd.DataFrame:
    """The smallest doc_id of each string of a shard's snippets, sent back by group as runs of strings."""
    fresh()
    # the messages of all groups are joined: their number grows with groups times shards, so none gets work of its own
    rows = rows.sort_values("g", ignore_index=True)
    held = np.cumsum([0, *map(len, rows["sizes"])])  # where a message's snippets begin
    sizes = np.frombuffer(b"".join(rows["sizes"]), np.uint8).astype(np.int64) + length - 1
    ends = np.cumsum(sizes)
    text = b"".join(map(plain_text, rows["text"]))
    seen: dict[bytes, int] = {}
    number = np.fromiter((seen.setdefault(text[e - s : e], len(seen)) for e, s in zip(ends.tolist(), sizes.tolist(), strict=True)), np.int64, len(sizes))
    del text
    least = np.full(len(seen), NEVER)
    np.minimum.at(least, number, np.frombuffer(b"".join(rows["ids"]), np.int64))
    # UTF-8 has no byte over 0xF4, so adding 1 leaves 0 for ends and 0xFF free
    t = np.frombuffer(b"\xff".join(seen) + b"\xff", np.uint8) + np.uint8(1)
    sizes = np.fromiter(map(len, seen), np.int64, len(seen))
    del seen
    ends = np.cumsum(sizes + 1) - 1
    first = ends - sizes
    strings = sizes - length + 1
    best = np.repeat(least, sizes + 1)
    # only what other snippets have too is sorted: a string of one snippet is in no other document than the snippet is
    begin, stop = recurring(t, first, strings, length)
    if len(begin):
        size = stop - begin + length  # with an end mark behind each piece
        marks = np.cumsum(size) - 1
        own = np.arange(marks[-1] + 1)
        ok = own + length <= np.repeat(marks, size)
        own += np.repeat(begin - (marks + 1 - size), size)
        pieces = t[own]
        pieces[marks] = 0
        places, common = sort_suffixes(pieces, budget=QUEUES, cap=length)
        classes = np.cumsum(common < length, dtype=np.int32)
        del common, pieces
        ok = ok[places]
        places, classes = own[places[ok]], classes[ok]
        cuts = np.flatnonzero(np.concatenate([[True], classes[1:] != classes[:-1]]))
        best[places] = np.repeat(np.minimum.reduceat(best[places], cuts), np.diff(np.append(cuts, len(places))))
        del places, classes, own, ok
    data, more = [], []
    total = np.concatenate([[0], np.cumsum(strings[number])])[held]  # strings before each message
    x = 0
    while x < len(rows):
        y = max(x + 1, int(np.searchsorted(total, total[x] + AT_ONCE, side="right")) - 1)
        n = number[held[x] : held[y]]
        k = strings[n]
        at = np.repeat(first[n] - (np.cumsum(k) - k), k) + np.arange(k.sum())
        value = best[at]
        starts = np.zeros(len(value), bool)
        starts[np.cumsum(k) - k] = True
        starts[1:] |= value[1:] != value[:-1]
        runs = np.flatnonzero(starts)
        sizes_, ids_ = np.diff(np.append(runs, len(value))).astype(np.uint8).tobytes(), value[runs].tobytes()
        cuts = np.searchsorted(runs, total[x : y + 1] - total[x]).tolist()
        data += [sizes_[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
        more += [ids_[8 * a : 8 * b] for a, b in zip(cuts, cuts[1:], strict=False)]
        x = y
    return pd.DataFrame({"g": rows["g"], "kind": 1, "part": rows["shard"], "data": data, "more": more})


def covered(starts: np.ndarray, length: int) -> np.ndarray:
    """Which bytes lie in a string of ``length`` that begins where ``starts`` is set."""
    step = np.zeros(len(starts) + length + 1, np.int8)
    for lo in range(0, len(starts), AT_ONCE):
        at = np.flatnonzero(starts[lo : lo + AT_ONCE]) + lo
        if len(at):
            cut = np.flatnonzero(np.diff(at) > length)
            step[at[np.append(0, cut + 1)]] += 1
            step[at[np.append(cut, len(at) - 1)] + length] -= 1
    return np.cumsum(step[: len(starts)], dtype=np.int8) > 0


def removed(g: Group, rows: pd.DataFrame, shards: int, length: int) -> np.ndarray:
    """Which bytes of the group go."""
    gone = np.zeros(len(g.text), bool)  # first where a string begins that goes
    values, _, _, back = g.owners()
    flags = _flags(rows, len(values))
    replies = rows[rows["kind"] == 1].sort_values("part")
    if flags.any() and len(replies):
        low, count, doc, number, first, shard = g.snippets(flags, back, shards, length)
        del values, back
        order = np.argsort(shard, kind="stable")  # snippets as they were sent: by shard, then by number
        runs = np.frombuffer(b"".join(replies["data"]), np.uint8)
        ids = np.frombuffer(b"".join(replies["more"]), np.int64)
        least = np.repeat(ids, runs)
        size = count[first]
        begin = np.empty(len(first), np.int64)
        begin[order] = np.cumsum(size[order]) - size[order]
        total = np.cumsum(count)
        x = 0
        while x < len(count):  # an occurrence has few strings, so no slice has many more than AT_ONCE / 4
            y = max(x + 1, int(np.searchsorted(total, total[x] + AT_ONCE // 4)))
            k = count[x:y]
            inner = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
            hit = least[np.repeat(begin[number[x:y]], k) + inner] < np.repeat(g.ids[doc[x:y]], k)
            inner += np.repeat(low[x:y], k)
            gone[inner[hit]] = True
            x = y
    return covered(gone, length)


def _prepare(docs: DataFrame, length: int) -> tuple[DataFrame, DataFrame, int]:
    spark = docs.sparkSession
    cut = Cut(spark)
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // (2 * GROUP)))
    groups = Written(cut, pack(docs), parts).frame
    buckets, shards = max(1, total // (17 * BUCKET)), max(1, -(-total // SHARD))
    asked = _owners(groups, buckets, length)
    flags = cut.write(asked.groupBy("bucket").applyInPandas(_judge, REPLY))
    sent = "shard long, g long, ids binary, sizes binary, text binary"

    def send(blob: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        fresh()
        out: dict[str, list] = {"shard": [], "g": [], "ids": [], "sizes": [], "text": []}
        for r in blob.itertuples():
            g = Group(r.ids, r.sizes, r.text, length)
            values, _, _, back = g.owners()
            low, count, doc, _, first, shard = g.snippets(_flags(rows, len(values)), back, shards, length)
            order = np.argsort(shard, kind="stable")
            own, shard = first[order], shard[order]
            raw, stop = g.text.tobytes(), count[own] + length - 1
            ends = np.concatenate([[0], np.cumsum(stop)])
            text = b"".join([raw[a:b] for a, b in zip(low[own].tolist(), (low[own] + stop).tolist(), strict=True)])
            ids, sizes = g.ids[doc[own]].tobytes(), count[own].astype(np.uint8).tobytes()
            cuts = list(stretches(shard))
            out["shard"] += [int(shard[x]) for x, _ in cuts]
            out["g"] += [r.g] * len(cuts)
            out["ids"] += [ids[8 * x : 8 * y] for x, y in cuts]
            out["sizes"] += [sizes[x:y] for x, y in cuts]
            out["text"] += [squeezed_text(text[ends[x] : ends[y]]) for x, y in cuts]
        return pd.DataFrame(out)

    slim = groups.select("g", "ids", "sizes", "text")
    snippets = slim.groupBy("g").cogroup(flags.groupBy("g")).applyInPandas(send, sent)
    sorted_ = cut.write(snippets.groupBy("shard").applyInPandas(lambda rows: _sort(rows, length), REPLY))
    return groups, flags.union(sorted_), shards


DIGEST = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def digests(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """The contract's row for each document."""
    groups, replies, shards = _prepare(docs.select("doc_id", "text"), length)

    def finish(blob: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        fresh()
        out: list[tuple] = []
        for r in blob.itertuples():
            g = Group(r.ids, r.sizes, r.text, length)
            gone = removed(g, rows, shards, length)
            for i, e, n in zip(g.ids.tolist(), g.ends.tolist(), g.sizes.tolist(), strict=True):
                own, bytes_ = gone[e - n : e], g.text[e - n : e]
                k = int(own.sum())
                spans = int(np.count_nonzero(np.diff(own.view(np.int8), prepend=np.int8(0)) == 1)) if k else 0
                out.append((None if i == NEVER else i, n, k, spans, hashlib.sha256(bytes_[~own] if k else bytes_).hexdigest()))
        frame = pd.DataFrame(out, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])
        return frame.astype({"doc_id": "Int64"})

    return groups.select("g", "ids", "sizes", "text").groupBy("g").cogroup(replies.groupBy("g")).applyInPandas(finish, DIGEST)


def drop_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``docs`` without the repeated bytes of its texts; all columns stay (an ``n_chars`` is kept right).  Cut characters
    at the edges of what stays are left out; null texts stay null."""
    groups, replies, shards = _prepare(docs, length)
    schema = docs.schema
    names = docs.columns

    def finish(blob: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        fresh()
        out = []
        for r in blob.itertuples():
            g = Group(r.ids, r.sizes, r.text, length)
            gone = removed(g, rows, shards, length)
            rest = pa.ipc.open_stream(unsqueeze(r.rest)).read_all()
            null = rest.column("text").to_pylist()
            texts = [None if z else g.text[e - n : e][~gone[e - n : e]].tobytes().decode("utf-8", "ignore") for z, e, n in zip(null, g.ends.tolist(), g.sizes.tolist(), strict=True)]
            rest = rest.set_column(rest.schema.get_field_index("text"), "text", pa.array(texts, pa.string()))
            if "n_chars" in names:
                rest = rest.set_column(rest.schema.get_field_index("n_chars"), "n_chars", pa.array([None if x is None else len(x) for x in texts], rest.schema.field("n_chars").type))
            out.append(rest.select(names).to_pandas(types_mapper={pa.int64(): pd.Int64Dtype(), pa.int32(): pd.Int32Dtype()}.get))
        return pd.concat(out) if out else pd.DataFrame(columns=names)

    return groups.groupBy("g").cogroup(replies.groupBy("g")).applyInPandas(finish, schema)
