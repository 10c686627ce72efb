"""Operators against brute force on small inputs with nulls, empty and long texts, ties, repeats, empty tables and clashing columns."""

import collections
import hashlib

import random
import re
import time
import tracemalloc
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

pytest.importorskip("sigloom.llm")

from sigloom.llm import crf, gam, html, imatch, linededup, media, packing, sentences, simhash, substrings, suffix  # noqa: E402
from sigloom.llm.common import CLEANUP, Cut, fresh  # noqa: E402
from sigloom.llm.components import connected  # noqa: E402

DATA = "/root/testdata/sf0.001"
EXTRA = ["k", "pos", "id", "g", "key", "bucket", "root", "line", "hub", "fp", "_null", "_gone", "_k", "_text", "_lines_removed", "row", "lines", "gone", "t", "keys", "n_chars"]


def words(rng, n):
    return " ".join("".join(rng.choice(["th", "er", "on", "an", "re", "é", "st"]) for _ in range(rng.randint(1, 4))) for _ in range(n))


def sample(seed=0):
    rng = random.Random(seed)
    texts = [words(rng, rng.choice([3, 30, 200])) for _ in range(14)]
    passage = words(rng, 30)
    texts += [texts[0], texts[1] + "\n" + passage, passage + "\n" + texts[2], "", None, "x", passage, "\n\n \n", "a" * 3000, "漢字" * 40, texts[3].replace("th", "TH"), texts[4] + " end", "tab\tand\x0bspace\r\nline  twice"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, texts[3]), (None, "no id at all"), (None, None)]
    rng.shuffle(rows)
    return rows


def frame(spark, rows, text="string"):
    schema = f"doc_id long, text {text}, lang string, source string, " + ", ".join(f"{c} long" for c in EXTRA)
    return spark.createDataFrame([(i, t, "en", None, *range(len(EXTRA))) for i, t in rows], schema)


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, sample()).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return frame(spark, [])


def test_written_tables_leave_no_shuffle_files(spark):
    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: {b.name() for b in iter_java(manager.getAllBlocks()) if b.name().startswith("shuffle_")}

    def iter_java(seq):
        it = seq.iterator()
        while it.hasNext():
            yield it.next()

    cut, before, setting = Cut(spark), files(), spark.conf.get(CLEANUP)
    df = spark.range(5000).groupBy((F.col("id") % 999).alias("k")).count()
    written = [cut.write(df), cut.write_by(df, "k", 2)]
    for _ in range(100):  # executors are told to remove them, which isn't waited for
        if not files() - before:
            break
        time.sleep(0.1)
    assert not files() - before and spark.conf.get(CLEANUP) == setting
    assert [x.count() for x in written] == [999, 999]


# Components


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(40)] + [(5, 5)]
    own = {}
    find = lambda x: x if own.setdefault(x, x) == x else find(own[x])
    for a, b in edges:
        a, b = find(a), find(b)
        own[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in connected(Cut(spark), spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in own if find(x) != x}
    assert connected(Cut(spark), spark.createDataFrame([], "a long, b long")).count() == 0


# 1


def brute_marginals(scores, transitions):
    n, k = scores.shape
    out = np.zeros((n, k))
    for path in np.ndindex(*[k] * n):
        w = np.exp(sum(scores[i, y] for i, y in enumerate(path)) + sum(transitions[a, b] for a, b in zip(path, path[1:], strict=False)))
        for i, y in enumerate(path):
            out[i, y] += w
    return out / out.sum(axis=1, keepdims=True)


def test_marginals_equal_enumeration(monkeypatch):
    rng = np.random.default_rng(1)
    t = rng.normal(size=(3, 3))
    parts = [rng.normal(size=(n, 3)) for n in (1, 5, 2, 6)]
    start = np.concatenate([np.arange(len(p)) == 0 for p in parts])
    for block in (1, 2, 3, 128):
        monkeypatch.setattr(crf, "BLOCK", block)
        got = crf.marginals(np.concatenate(parts), start, t)
        assert np.allclose(got, np.concatenate([brute_marginals(p, t) for p in parts]))


def test_languages(spark, docs, none):
    df = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "lang")
    got = {r.doc_id: r for r in crf.predict(df).collect()}
    want = {r.doc_id: r.lang for r in df.collect()}
    held = [d for d in want if got[d].held_out]
    assert all(got[d].held_out == (zlib.crc32(str(d).encode()) % 4 == 2) for d in want)
    assert np.mean([got[d].lang_pred == want[d] for d in held]) > 0.95
    odd = crf.predict(docs.select("doc_id", "text", "lang")).collect()
    assert len(odd) == docs.count() and all(0 <= r.score <= 1 for r in odd)
    assert {r.lang_pred for r in odd} == {"en", "und"}
    assert crf.predict(none.select("doc_id", "text", "lang")).count() == 0
    switched = crf.Crf(["a", "b"]).fit([("aa ab ac".split() * 5, 0), ("zz zy zx".split() * 5, 1)] * 20)
    assert [x[0] for x in switched.label_texts(["aa ab ac", "zz zy", "12 34", None])] == ["a", "b", "und", "und"]
    assert switched.transitions[0, 0] > switched.transitions[0, 1]
    spans = crf.label_spans(spark.createDataFrame([(1, "aa ab ac aa, zz zy zx zz"), (2, None), (None, "zz")], "doc_id long, text string"), switched).collect()
    assert sorted((tuple(r)[:4] for r in spans), key=str) == [(1, 0, 11, "a"), (1, 13, 24, "b"), (None, 0, 2, "b")]
    long = "ab" * 5000  # words of any length are read whole, alone or beside others
    assert np.allclose(switched.emissions(["aa", long, "zz" + long]), np.concatenate([switched.emissions([w]) for w in ("aa", long, "zz" + long)]))
    assert not np.allclose(*switched.emissions(["zz" * 6 + "ab" * 40 + "zz" * 6, "zz" * 52]))


# 2


def test_pieces_equal_the_library_without_dropout():
    import sentencepiece

    own, model = sentences.Pieces(sentences.model_path()), sentencepiece.SentencePieceProcessor(model_file=sentences.model_path())
    texts = [t for _, t in sample(2) if t]
    assert [np.frombuffer(x, "<u2").tolist() for x in own.encode(texts, [0] * len(texts), dropout=0)] == model.encode(texts)


@pytest.mark.parametrize("dropout", [0.0, 0.1, 0.6])
def test_agendas_agree_and_decode(dropout):
    own = sentences.Pieces(sentences.model_path())
    texts = [t for _, t in sample(3) if t] + ["a▁b", "  lead", "日本\x00", "x" * 200]
    chunks = sorted({c for t in texts for c in sentences.CHUNK.findall(" " + t) if len(c) <= 32})
    limit = np.uint64(int(dropout * (1 << 64)))
    keys = [np.uint64(xxhash.xxh3_64_intdigest(c.encode(), 9)) for c in chunks]
    assert own.chunks(chunks, 9, dropout) == [own.one(c, k, limit) for c, k in zip(chunks, keys, strict=True)]
    assert [own.decode(x) for x in own.encode(texts, [1] * len(texts), dropout=dropout)] == texts


def test_round_trip(docs, none):
    got = sentences.round_trip(docs).collect()
    assert len(got) == docs.count() and all(r.lossless for r in got)
    back = sentences.decode(sentences.encode(docs, seed=1)).collect()
    assert sorted(r.text for r in back) == sorted(t or "" for _, t in sample())
    assert sentences.round_trip(none).count() == 0
    assert sorted(sentences.encode(docs, seed=1).collect(), key=str) != sorted(sentences.encode(docs, seed=2).collect(), key=str)


def test_occurrences_are_segmented_apart(spark):
    text = " ".join(["internationalization"] * 300) + " " + "x" * 40
    df = spark.createDataFrame([(i, text) for i in range(2)], "doc_id long, text string")
    a, b = (tuple(r.pieces) for r in sentences.encode(df).orderBy("doc_id").collect())
    own = sentences.Pieces(sentences.model_path())
    ways = lambda p: {tuple(w.split("|")) for w in "|".join(own.bytes[i].decode() for i in p).split("| ")}
    assert a != b and len(ways(a)) > 5 and len(ways(a) | ways(b)) > len(ways(a))
    again, known = [text, "a▁b  lead 日本\x00 " + text], {}
    first = own.encode(again, [5, 6], known=known)
    assert own.encode(again, [5, 6], known=known) == first == [own.encode([t], [o])[0] for t, o in zip(again, (5, 6), strict=True)]


def test_whole_texts_go_through_the_library(monkeypatch):
    """Dropout as the library has it, under a seed of the document, whatever stands beside it; others by chunks."""
    own = sentences.Pieces(sentences.model_path())
    texts = [t for _, t in sample(6) if t] + ["<s> <0x41> </s>  lead\n\ttrail  ", "日本\x00 ﬁ Å\u2028"]
    owners = list(range(len(texts)))
    whole = own.encode(texts + ["a▁b", "\ud800 x", None], [*owners, 1, 2, 3])
    assert whole[-1] == b"" and all(whole[-3:-1])
    assert [own.decode(x) for x in whole[:-2]] == [*texts, "a▁b"]
    monkeypatch.setattr(own, "keyed", None)
    assert own.verbatim and [own.encode([t], [o])[0] for t, o in zip(texts, owners, strict=True)] == whole[: len(texts)]
    again = texts[0] + " internationalization" * 50
    plain = np.frombuffer(own.encode([again], [0], dropout=0)[0], "<u2").tolist()
    ways = [own.encode([again], [o])[0] for o in range(20)]
    assert len(set(ways)) == 20 and own.model.encode(again) == plain
    assert own.encode([again], [0], seed=1) != ways[:1] and np.mean([len(w) // 2 for w in ways]) > len(plain)


# 3


def brute_lines(rows):
    shingles = lambda x: frozenset(x[i : i + 5] for i in range(len(x) - 4)) or frozenset([x])
    order = sorted({(i if i is not None else -(1 << 63)) for i, _ in rows})
    seen: list[tuple[str, frozenset]] = []
    lines = [(k, p, x) for k in order for i, t in rows if (i if i is not None else -(1 << 63)) == k and t for p, x in enumerate(t.split("\n")) if x.strip()]
    distinct = sorted({x for _, _, x in lines})
    own = {x: x for x in distinct}
    find = lambda x: x if own[x] == x else find(own[x])
    sets = {x: shingles(x) for x in distinct}
    for a in distinct:
        for b in distinct:
            if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                own[find(b)] = find(a)
    first = {}
    for k, p, x in lines:
        first[find(x)] = min(first.get(find(x), (k, p)), (k, p))
    del seen
    keep = lambda k, p, x: not x.strip() or first[find(x)] == (k, p)
    return sorted(((i, None if t is None else "\n".join(x for p, x in enumerate(t.split("\n")) if keep(i if i is not None else -(1 << 63), p, x))) for i, t in rows), key=str)


@pytest.mark.parametrize("paired", [2, 16])
def test_lines(spark, monkeypatch, paired):
    rng = random.Random(5)
    monkeypatch.setattr(linededup, "PAIRED", paired)
    base = words(rng, 60)
    rows = sample(4)
    for i in range(30):  # a large group of near copies, and lines that share half of it
        w = base.split()
        w[rng.randrange(60)] = "zz"
        rows.append((100 + i, words(rng, 4) + "\n" + " ".join(w) + "\nsame line"))
        rows.append((200 + i, " ".join(w[:30]) + " " + words(rng, 40)))
    df = frame(spark, rows).repartition(3)
    got = linededup.dedup_lines(df)
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == brute_lines(rows)
    kept = linededup.keep_first_lines(df)
    assert kept.columns == df.columns and all(r.n_chars == len(r.text) for r in kept.where("text is not null").collect())
    monkeypatch.setattr(linededup, "SMALL", -1)
    assert sorted(((r.doc_id, r.text) for r in linededup.dedup_lines(df).collect()), key=str) == brute_lines(rows)


def test_line_keys_in_parts(spark, monkeypatch):
    monkeypatch.setattr(linededup, "PART", 16)
    monkeypatch.setattr(linededup, "SMALL", -1)
    rows = sample(6)
    assert sorted(((r.doc_id, r.text) for r in linededup.dedup_lines(frame(spark, rows)).collect()), key=str) == brute_lines(rows)


@pytest.mark.parametrize("sieve", [1 << 20, 16])
def test_large_joins_shuffle_what_can_match(spark, monkeypatch, sieve):
    """Of 20,000 lines 200 are wanted: beyond SMALL only these and a few others go into the join's shuffle."""
    monkeypatch.setattr(linededup, "SMALL", -1)
    monkeypatch.setattr(linededup, "SIEVE", sieve)
    df = spark.range(20000).select(F.xxhash64("id").alias("id"), F.col("id").alias("line"))
    wanted = df.where("line % 100 = 0").select("id")
    got = linededup._among(df, wanted)
    assert sorted(r.line for r in got.collect()) == list(range(0, 20000, 100))
    left = linededup._sifted(df, wanted)
    assert left.columns == df.columns and left.where("line % 100 = 0").count() == 200
    assert left.count() < (2500 if sieve > 16 else 5000)
    assert linededup._sifted(df, wanted.limit(0)).count() == 0


def linked(spark, *lines):
    rows = list(enumerate(lines))
    got = linededup.dedup_lines(frame(spark, rows))
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == brute_lines(rows)


def test_lines_of_few_words(spark):
    linked(spark, "Newsletter", "Newsletter!", "Subscribe to our newsletter", "Subscribe to our newsletters", "Read more", "Read more.", "abcdef", "abcde")


def test_lines_by_prefix(spark):
    rng = random.Random(8)
    lines = []
    for _ in range(12):
        base = words(rng, 20)
        other = list(base)
        for at in (len(base) // 3, 2 * len(base) // 3):
            other[at] = "Z"
        lines += [base, "".join(other), base + " " + words(rng, 30)]
    lines += ["abcdeabcdeabcde", "abcdeabcdeabcdeabcde"]  # one set of shingles
    sets = [{x[i : i + 5] for i in range(len(x) - 4)} for x in lines]
    want = {(b, a) for a in range(len(lines)) for b in range(a) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    got = linededup.prefix_pairs(spark.createDataFrame([(i, i, x) for i, x in enumerate(lines)], "id long, root long, line string"))
    assert len(want) > 10 and want <= {(r.b, r.a) for r in got.collect()}


def copies(rng, n, of=80, most=3):
    """Copies of one line with up to so many edits, each too far from most others to be similar."""
    base = words(rng, 40)[:of]
    out = {base}
    while len(out) < n:
        x = list(base)
        for _ in range(rng.randint(1, most)):
            x[rng.randrange(len(x))] = rng.choice(["", "Z", "0", "Q7"])
        out.add("".join(x))
    return base, sorted(out)


def test_many_near_copies_make_few_pairs(spark):
    """Under a hub all components are found, by pairs that don't grow with the square of the group."""
    rng = random.Random(21)
    base, lines = copies(rng, 300)
    cut = lambda x: {x[i : i + 5] for i in range(len(x) - 4)}
    sets = [cut(x) for x in lines]
    like = {(i, j) for i in range(len(lines)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}

    def components(pairs):
        own = list(range(len(lines)))
        find = lambda i: i if own[i] == i else find(own[i])
        for i, j in sorted(pairs):
            own[max(find(i), find(j))] = min(find(i), find(j))
        return [find(i) for i in range(len(lines))]

    for hub in (lines.index(base), 7, 150):
        df = spark.createDataFrame([(i, i, x, hub, lines[hub]) for i, x in enumerate(lines)], "id long, root long, line string, hub long, against string")
        got = {tuple(r) for r in linededup.prefix_pairs(df).collect()}
        assert components(got & like) == components(like)
        if lines[hub] == base:
            assert len(got) < 12 * len(lines)
    assert len(set(components(like))) > 5


@pytest.mark.parametrize("share", [0, 30])
def test_lines_unlike_their_hub_seldom_meet(spark, share):
    """Lines that have little of the hub, or half of it, don't meet in what all of them lack; all similar ones are found."""
    rng = random.Random(23)
    base = words(rng, 60)
    lines = [base, *(base[: len(base) * share // 60] + " " + "".join(rng.choices("abcdefghijklmnopqrstuvwxyz ", k=150)) for _ in range(100))]
    lines += [x + "Q7" for x in lines[50:]] + [base[:-1] + "Z"]
    df = spark.createDataFrame([(i, i, x, 0, base) for i, x in enumerate(lines)], "id long, root long, line string, hub long, against string")
    sets = [{x[i : i + 5] for i in range(len(x) - 4)} for x in lines]
    like = {(i, j) for i in range(len(lines)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
    assert len(like) > 50 and like <= {tuple(r) for r in linededup.prefix_pairs(df).collect()}
    met = linededup.prefix_meetings(df)[0].count()
    assert met < 5000, met


def test_short_lines_share_no_single_frequent_shingle(spark):
    """Lines of one frequent shingle in common make no large key."""
    rng = random.Random(22)
    word = lambda n: "".join(rng.choice("bcdfghjklmnpqrstvwxz") for _ in range(n))
    rows = [(i, f"{word(9)} the {word(n)}") for i, n in enumerate([6, 12, 16, 22, 30] * 40)]
    keys = linededup.signed(spark.createDataFrame(rows, "id long, line string")).selectExpr("id", "explode(keys) as key")
    assert keys.groupBy("key").count().where("count > 3").count() == 0


def test_lines_of_long_words(spark):
    rng = random.Random(9)
    long = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(19)) for _ in range(8)]
    linked(spark, " ".join(long), " ".join(x[:9] + "Z" + x[10:] if i in (1, 4, 6) else x for i, x in enumerate(long)), " ".join(x[:9] + "Q" + x[10:] for x in long))


def test_recall_of_line_keys(spark):
    """Pairs of a similarity of 0.8 to 0.86, by length, that share a key."""
    rng, rows, pairs = random.Random(12), [], []
    cut = lambda x: {x[i : i + 5] for i in range(len(x) - 4)}
    for n in (4, 8, 14, 25, 40, 120):
        found = 0
        while found < 150:
            a = words(rng, n)
            b = list(a)
            for _ in range(max(1, len(a) // rng.randint(45, 70))):
                b[rng.randrange(len(b))] = rng.choice("abcdef")
            b = "".join(b) + rng.choice(["", "s", " " + words(rng, 1)])
            if 0.8 <= len(cut(a) & cut(b)) / len(cut(a) | cut(b)) < 0.86:
                pairs.append((n, len(rows), len(rows) + 1))
                rows += [(len(rows), a), (len(rows) + 1, b)]
                found += 1
    keys = {r.id: set(r["keys"]) for r in linededup.signed(spark.createDataFrame(rows, "id long, line string")).collect()}
    hits = collections.Counter(n for n, a, b in pairs if keys[a] & keys[b])
    print(hits)
    assert len(hits) == 6 and min(hits.values()) >= 0.9 * 150


def test_large_keys_are_settled_whole(spark):
    """Every similar pair of a key of many components is linked, however few keys it shares otherwise."""
    rng = random.Random(11)
    shingled = lambda x: {x[i : i + 5] for i in range(len(x) - 4)}
    lines = []
    while len(lines) < 300:
        a = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz ", k=98))
        b = a[:-1 - rng.randrange(9, 12)] + "".join(rng.choices("0123456789", k=10))
        x, y = shingled(a), shingled(b)
        if 0.8 <= len(x & y) / len(x | y) <= 0.82:
            lines += [a, b]
    texts = spark.createDataFrame(list(enumerate(lines)), "id long, line string")
    members = texts.selectExpr("1L as key", "id", "1L as n", f"{len(lines)}L as size")
    linker = linededup.Linker(Cut(spark), texts)
    linker.settle(members, members.selectExpr("id as a", "id as b").limit(0))
    assert {(r.node, r.root) for r in linker.roots.collect()} == {(i + 1, i) for i in range(0, 300, 2)}


def test_lines_of_nothing(none):
    assert linededup.dedup_lines(none).count() == 0


# 4


def test_additive_model():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 4))
    y = ((x[:, 0] > 0.3) | (x[:, 1] * x[:, 2] > 0)).astype(float)
    model = gam.fit(x[:2000], y[:2000], 60)
    assert ((model.score(x[2000:]) > 0.5) == y[2000:]).mean() > 0.85
    assert {1, 2} in [{i, j} for i, j, _ in model.pairs]
    assert gam.fit(x[:0], y[:0]).score(x[:2]).tolist() == [0.5, 0.5]
    assert (gam.fit(x[:50], np.ones(50)).score(x[:2]) > 0.9).all()


def test_quality(spark, docs, none):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality")
    df = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r.doc_id: r for r in gam.scored(df, labels).collect()}
    want = {r.doc_id: r.quality for r in labels.collect()}
    held = [d for d in want if got[d].held_out]
    assert np.mean([got[d].predicted == want[d] for d in held]) > 0.9
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0) and r.predicted == (r.score >= 0.3) for d, r in got.items())
    assert gam.keep_good(df, labels).columns == df.columns
    odd = spark.createDataFrame([(1, None), (None, 1), (2, 1), (2, 0)], "doc_id long, quality int")
    assert gam.scored(docs, odd).count() == docs.count() and gam.scored(none, labels).count() == 0
    assert gam.scored(docs, labels.limit(0)).first().score == 0.5


# 5


def test_media_round_trip(docs, none):
    by = collections.defaultdict(set)
    for r in media.media_digest(docs).collect():
        by[r.payload_sha256].add((r.n_bytes, r.payload_bytes, r.tail_crc32, r.media_sha256, r.feature))
    assert all(len(v) == 1 for v in by.values())
    for _, t in sample():
        payload, n = media.pad(t)
        blob = media.encode_avi(payload)
        ((n_bytes, size, crc, digest, _),) = by[hashlib.sha256(payload).hexdigest()]
        assert (n_bytes, size, crc, digest) == (n, len(payload), zlib.crc32(payload[-64:]), hashlib.sha256(blob).hexdigest())
        assert media.read_back(blob)[0] == payload and len(payload) % 64 == 0
    assert media.media_digest(none).count() == 0
    rows = media.clips(media.encode_media(docs)).collect()
    assert all(r.end_ms > r.start_ms for r in rows) and media.clips(media.encode_media(none)).count() == 0


def test_the_general_decoder_reads_the_same_frames():
    payload = bytes(range(256)) * 8
    frames = media.parse_avi(media.encode_avi(payload))["frames"]
    general = np.concatenate([media.decode_jpeg(f)[::8, ::8].ravel() for f in frames])
    assert general.tobytes()[: len(payload)] == payload
    assert media.decode_frames(frames).tobytes()[: len(payload)] == payload
    with pytest.raises(ValueError):
        media.parse_avi(b"no")


def test_shots():
    rng = np.random.default_rng(0)
    dark, bright = rng.integers(0, 60, (10, 512), np.uint8), rng.integers(190, 250, (7, 512), np.uint8)
    assert media.shots(np.concatenate([dark, bright, dark])) == [(0, 9), (10, 16), (17, 26)]
    assert media.shots(dark[:1]) == [(0, 0)] and media.shots(dark[:0]) == []


# 6


def test_fingerprint_by_definition():
    for _, t in sample():
        w = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode()))
        s = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
        h = [xxhash.xxh64_intdigest(x, 42) for x in s]
        want = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
        assert simhash.fingerprint(t) == want


@pytest.mark.parametrize("paired", [0, 32])
def test_links(spark, monkeypatch, paired):
    monkeypatch.setattr(simhash, "PAIRED", paired)
    rng = random.Random(1)
    values = [rng.getrandbits(64) for _ in range(30)] + [0]
    values += [v ^ sum(1 << b for b in rng.sample(range(64), rng.choice([1, 2, 3]))) for v in values for _ in range(4)]
    values = sorted(set(values))
    signed = {v: simhash._signed(v) for v in values}
    edges = {(min(a, b), max(a, b)) for a in values for b in values if a != b and bin(a ^ b).count("1") <= 2}
    got = [(r.a, r.b) for r in simhash.links(spark.createDataFrame([(v,) for v in signed.values()], "fp long")).collect()]
    back = {s: v for v, s in signed.items()}
    assert all((min(back[a], back[b]), max(back[a], back[b])) in edges for a, b in got)
    roots = lambda pairs: connected(Cut(spark), spark.createDataFrame([(signed.get(a, a), signed.get(b, b)) for a, b in pairs], "a long, b long"))
    want = {(r.node, r.root) for r in roots(edges).collect()}
    have = connected(Cut(spark), spark.createDataFrame(got, "a long, b long"))
    assert {(r.node, r.root) for r in have.collect()} == want


def test_near_duplicates(docs, none):
    rows = simhash.near_duplicates(docs).collect()
    assert len(rows) == docs.count()
    prints = {i: simhash.fingerprint(t) for i, t in sample()}
    assert all(int(r.fingerprint, 16) == prints[r.doc_id] for r in rows if r.doc_id is not None)
    assert {r.component_id for r in rows if r.doc_id in (0, 14)} == {0}
    zero = {r.component_id for r in rows if r.fingerprint == "0" * 16}
    assert len(zero) == 1 and simhash.near_duplicates(none).count() == 0
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and 14 not in {r.doc_id for r in kept.collect()}


# 7


def test_chunks_equal_whole_texts():
    from tokenizers import Tokenizer

    own, whole = packing.Chunks(packing.tokenizer_path()), Tokenizer.from_file(packing.tokenizer_path())
    texts = [t for _, t in sample() if t] + ["Don't WE'LL ÷ÿÅ ﬁ²½ x\x1cy a\u0085b c é İstanbul ΣΑΣ <|endoftext|> a<|startoftext|>b,c ###!! 3.14"]
    for t in texts:
        assert np.frombuffer(own.ids(t), "<u4").tolist() == whole.encode(t, add_special_tokens=False).ids


def test_merged_runs_equal_the_library():
    from tokenizers import Tokenizer

    own, whole, rng = packing.Chunks(packing.tokenizer_path()), Tokenizer.from_file(packing.tokenizer_path()), random.Random(31)
    word = lambda n, of="eeetaoinshrdluEAßéàÿ": "".join(rng.choices(of, k=n)) + rng.choice(["", "", ",", "...", "!?"])
    texts = ["", " ", "\n a\tb  c\x0b\x0c\r", None, " ".join(map(chr, [*range(33, 0xD800), *range(0xE000, 0x2FFFF)])), "İ İa Aİ,"]
    texts += [" ".join(word(rng.randint(1, 70)) for _ in range(400)) for _ in range(10)] + ["a" * 64 + " " + "a" * 65 + " " + "é" * 32 + " " + "é" * 33 + " " + "." * 70 + " x" + "!" * 70, word(3000)]
    texts += [" ".join(word(rng.randint(2, 9), "etaoins") for _ in range(3000))]
    got = own.blobs(pa.array(texts, pa.string()))
    for t, blob in zip(texts, got, strict=True):
        assert np.frombuffer(blob, "<u4").tolist() == whole.encode(t or "", add_special_tokens=False).ids == np.frombuffer(own.ids(t), "<u4").tolist()
    assert own.blobs(pa.array(texts, pa.string()).slice(3, 4)) == got[3:7] and own.blobs(pa.array([], pa.string())) == []
    many = pa.record_batch({"doc_id": range(len(texts)), "text": pa.array(texts, pa.string())})
    assert pa.Table.from_batches(packing.slices(many)).equals(pa.Table.from_batches([many]))


def test_tokenising_keeps_no_words():
    rng = random.Random(32)
    own = packing.Chunks(packing.tokenizer_path())
    texts = [" ".join("".join(rng.choices("etaoinshr", k=9)) + rng.choice(",.") for _ in range(20_000)) for _ in range(5)]
    own.ids(texts[0])
    tracemalloc.start()
    for t in texts[1:]:
        own.ids(t)
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert held < 2 << 20, held


def test_packing(spark, docs, none):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(packing.tokenizer_path())
    rows = packing.pack(docs, length=64, block=16).collect()
    want = collections.Counter((i, tuple(whole.encode(t or "", add_special_tokens=False).ids) + (0,)) for i, t in sample())
    got = collections.Counter()
    for (i, ids), n in want.items():
        pieces = [np.array(ids[a : a + 64], "<u4").tobytes() for a in range(0, len(ids), 64)]
        for k, p in enumerate(pieces):
            got[i, k, 64 * k, len(p) // 4, zlib.crc32(p)] += n
    assert got == collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows)
    by = collections.defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for own in by.values():
        own.sort()
        assert [o for o, _ in own] == np.cumsum([0, *(n for _, n in own)])[:-1].tolist() and sum(n for _, n in own) <= 64
    assert len(by) <= -(-sum(r.length for r in rows) // 64) + 2
    assert packing.pack(none).count() == 0


def test_evolution_beats_plain_best_fit():
    rng = random.Random(3)
    better = 0
    for seed in range(12):
        lengths = [rng.choice([26, 34, 40, 17, 51, 60, 9]) for _ in range(60)]
        plain = packing.best_fit(lengths, sorted(range(60), key=lambda i: -lengths[i]), 100)
        best = packing.evolve(lengths, 100, seed, generations=40)
        assert sorted(i for b, _ in best for i in b) == list(range(60)) and all(sum(lengths[i] for i in b) == 100 - room for b, room in best)
        assert len(best) <= len(plain)
        better += len(best) < len(plain)
    child = packing.crossover(plain, best, lengths, 100, rng)
    assert sorted(i for b, _ in child for i in b) == list(range(60))


# 8


@pytest.mark.parametrize("seed", range(150))
def test_suffixes_equal_sorting(seed):
    rng = random.Random(seed)
    k = rng.choice([1, 2, 3, 200])
    strings = [[rng.randint(1, k) for _ in range(rng.randint(1, rng.choice([3, 12, 40])))] for _ in range(rng.randint(1, 5))]
    strings += strings[: rng.choice([0, 2])]
    t = [x for s in strings for x in [*s, 0]]
    end, at = [0] * len(t), 0
    for i in reversed(range(len(t))):
        at = i if t[i] == 0 else at
        end[i] = at
    want = sorted((i for i in range(len(t)) if t[i]), key=lambda i: ([*t[i : end[i]], 0], end[i]))
    shared = lambda a, b: next((n for n, (x, y) in enumerate(zip([*t[a : end[a]], -1], [*t[b : end[b]], -2], strict=False)) if x != y), 0)
    for base, budget in ((1 << 20, 1 << 20), (0, 200)):  # in memory; by recursion and from disk
        places, common = suffix.sort_suffixes(np.array(t, np.uint8), base, budget)
        assert places.tolist() == want and common.tolist() == [0, *(shared(a, b) for a, b in zip(want, want[1:], strict=False))]


def test_queues_go_to_disk_and_back():
    q = suffix.Queues(100)
    for i in range(50):
        q.push(np.array([i % 3, 7]), 1 + i % 2, np.array([i, i]), np.array([i, -i]))
    assert q.spilled
    got = q.pop(7)
    assert got.shape == (3, 50) and got[:2].T.tolist() == sorted(got[:2].T.tolist())


def brute_removed(rows, length):
    first: dict[bytes, int] = {}
    for i, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - length + 1):
            if i is not None:
                first[b[p : p + length]] = min(first.get(b[p : p + length], i), i)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = [False] * len(b)
        for p in range(len(b) - length + 1):
            if i is not None and first[b[p : p + length]] < i:
                gone[p : p + length] = [True] * length
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((i, len(b), sum(gone), sum(g and not (p and gone[p - 1]) for p, g in enumerate(gone)), hashlib.sha256(kept).hexdigest(), kept, t is None))
    return out


@pytest.mark.parametrize("hot", [0, 20_000])
def test_repeats(spark, monkeypatch, hot):
    for name, value in (("HOT", hot), ("GROUP", 3000), ("SHARD", 4000), ("BUCKET", 50), ("STEP", 256)):
        monkeypatch.setattr(substrings, name, value)
    rows = sample(6) + [(300 + i, "common phrase of fifty bytes and a little more than that" + words(random.Random(i), 9)) for i in range(12)]
    df = frame(spark, rows).repartition(3)
    want = brute_removed(rows, 50)
    got = substrings.digests(df).collect()
    assert sorted(map(tuple, got), key=str) == sorted((w[:5] for w in want), key=str)
    texts = sorted(((r.doc_id, r.text) for r in substrings.drop_repeats(df).collect()), key=str)
    assert texts == sorted(((w[0], None if w[6] else w[5].decode("utf-8", "ignore")) for w in want), key=str)


def test_messages_of_a_shard_are_worked_off_together(monkeypatch):
    """Messages grow with groups times shards: none is squeezed, unsqueezed or sorted by itself."""
    texts = [bytes(random.Random(i % 40).choices(b"abcdefgh ", k=60)) for i in range(300)]
    rows = pd.DataFrame({"shard": 0, "g": range(300), "ids": [np.int64(7 * i).tobytes() for i in range(300)], "sizes": [bytes([11])] * 300, "text": texts})
    calls = []
    monkeypatch.setattr(substrings, "unsqueeze", lambda *a: calls.append(a))
    monkeypatch.setattr(substrings, "squeeze", lambda *a: calls.append(a))
    for at_once in (1, 100, 1 << 20):
        monkeypatch.setattr(substrings, "AT_ONCE", at_once)
        got = substrings._sort(rows, 50)
        assert got["g"].tolist() == list(range(300)) and not calls
        for i, (n, ids) in enumerate(zip(got["data"], got["more"], strict=True)):
            assert np.repeat(np.frombuffer(ids, np.int64), np.frombuffer(n, np.uint8)).tolist() == [7 * (i % 40)] * 11


def test_no_repeats_in_nothing(none):
    assert substrings.digests(none).count() == 0 and substrings.drop_repeats(none).count() == 0


def test_only_recurring_strings_are_sorted(monkeypatch):
    """Snippets that share an anchor in ever other surroundings leave little to sort, and the same doc_ids."""
    rng, sent = random.Random(8), []
    anchor, tail = "".join(rng.choices("abcdef", k=16)), "".join(rng.choices("abcdef", k=40))
    noise = lambda: "".join(rng.choices("abcdefghijklmnop", k=34))
    snippets = [(noise() + anchor + noise()).encode() for _ in range(300)] + [(noise() + anchor + tail[:34]).encode() for _ in range(2)]
    rows = pd.DataFrame({"shard": 0, "g": range(302), "ids": [np.array([500 - i]).tobytes() for i in range(302)], "sizes": [bytes([len(x) - 49]) for x in snippets], "text": snippets})
    monkeypatch.setattr(substrings, "sort_suffixes", lambda t, real=substrings.sort_suffixes, **a: sent.append(len(t)) or real(t, **a))
    got = substrings._sort(rows, 50)
    first = {}
    for i, x in enumerate(snippets):
        for j in range(len(x) - 49):
            first[x[j : j + 50]] = min(first.get(x[j : j + 50], 999), 500 - i)
    for x, data, more in zip(snippets, got["data"], got["more"], strict=True):
        runs = np.repeat(np.frombuffer(more, np.int64), np.frombuffer(data, np.uint8)).tolist()
        assert runs == [first[x[j : j + 50]] for j in range(len(x) - 49)]
    assert sent and sum(sent) < sum(map(len, snippets)) / 20
    del sent[:]
    assert len(substrings._sort(rows[:300], 50)) == 300 and sum(sent) < 2000


# 9


def test_imatch(spark, docs, none):
    rows = imatch.fingerprints(docs).collect()
    assert len(rows) == docs.count() and imatch.fingerprints(none).count() == 0
    own = sorted(((i if i is not None else -(1 << 63), t or "") for i, t in sample()))
    edited = collections.Counter()
    for (i, a), (_, b) in zip(own, own[1:] + own[:1], strict=True):
        n = len(a) // 4
        edited[None if i == -(1 << 63) else i, len(a), hashlib.sha256((a[: len(a) - n] + b[:n]).encode()).hexdigest()] += 1
    assert edited == collections.Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in rows)
    prints = {r.doc_id: r.fingerprint for r in rows}
    assert prints[0] == prints[14] and all(0 <= x <= 1 for r in rows for x in (r.near_edited, r.near_next))
    df = spark.read.parquet(f"{DATA}/documents.parquet")
    real = imatch.fingerprints(df).toPandas()
    assert real.near_edited.mean() > 0.4 and real.near_next.mean() < 0.1
    one = imatch.fingerprints(df.limit(1)).first()
    assert one.near_next == 1


def test_imatch_by_definition():
    """Fingerprints and likeness against plain loops over terms and subsets."""
    rng = random.Random(4)
    vocabulary = [words(rng, 1) + str(i) for i in range(900)]
    lex = frozenset(imatch._hash(t) for t in vocabulary[:700])
    texts = [" ".join(rng.choices(vocabulary, k=n)) for n in (0, 1, 3, 10, 40, 200, 800)]
    texts += [t[: len(t) // 2] + t[len(t) // 2 :].replace("st", "ST") for t in texts] + [texts[5] + " " + vocabulary[0] + "x"]
    full = (1 << 64) - 1

    def brute(text):
        own = sorted(imatch._hash(t) for t in set(re.findall(r"\w+", text.lower())))
        kept = [h for h in own if h in lex]
        own = kept if len(kept) >= imatch.FEW else own
        level = next(k for k in range(64) if len(own) <= 1 << k)
        rows = []
        for k in (level, level + 1):
            for j in range(imatch.SUBSETS):
                value, n = 0, 0
                for h in own:
                    h &= full
                    if int(imatch.in_subset(np.array([h], np.uint64), j)[0]) < 1 << 64 - k:
                        value = (value + (h * int(imatch.A) + int(imatch.B)) * pow(int(imatch.C), n, 1 << 64)) & full
                        n += 1
                rows.append((((value ^ value >> 32) * int(imatch.B)) & full | 1) if n else 0)
        return [level, *rows]

    got = imatch.prints(texts, lex, {})
    want = [brute(t) for t in texts]
    assert got.tolist() == want

    def alike(a, b):
        if a == b:
            return 1.0
        if abs(a[0] - b[0]) > 1:
            return 0.0
        k = max(a[0], b[0])
        pairs = [(x, y) for x, y in zip(*(p[1 + (k - p[0]) * imatch.SUBSETS :][: imatch.SUBSETS] for p in (a, b)), strict=True) if x or y]
        return sum(x == y for x, y in pairs) / max(1, len(pairs))

    for i in range(len(texts)):
        again = imatch.likeness(np.repeat(got[i : i + 1], len(texts), axis=0), got)
        assert np.allclose(again, [alike(want[i], w) for w in want])


# 10


def page(body, title="t"):
    return f"<!DOCTYPE html><html><head><title>{title}</title><style>p{{}}</style><script>var a='<p>no</p>';</script></head><body><nav><ul><li><a href=x>Home</a></ul></nav><!-- <p>no</p> -->{body}<footer>&copy; me</footer></body></html>"


def test_pages(spark):
    articles = [f"<article><h1>Head {i}</h1><p><b>One &amp; &#233; {i}<br><p>two\n  words{i}<div class='ad'>buy</div><p>shared line<aside>side</aside><form><p>mail</p></form><section class='comments'><p>first!</p></section></article>" for i in range(6)]
    rows = [(i, f"https://h.example/{i}", page(a)) for i, a in enumerate(articles)]
    rows += [(90 + i, "https://d.example/x", page(f"<div id=menu>m</div><div class=story><p>long enough text of the story {i} to be most of it</p><p>and more</p></div><div class=sidebar>other</div>")) for i in range(3)]
    rows += [(100, None, None), (101, "bad url", ""), (102, "https://one.example", page("<main><p>alone</p></main>")), (None, "https://h.example/z", page(articles[0])), (103, "https://t.example", "<p>cut <b"), (103, "https://t.example", "<p>cut <b")]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "page_id long, url string, html string, host long, main long")
    got = collections.defaultdict(list)
    for r in html.extract(df).collect():
        got[r.page_id].append(r.text)
        assert r.n_chars == len(r.text)
    for i in range(6):
        assert got[i] == [f"Head {i}\nOne & é {i}\ntwo words{i}\nshared line"]
    assert got[91] == ["long enough text of the story 1 to be most of it\nand more"]
    assert got[100] == got[101] == [""] and got[102] == ["alone"] and len(got[103]) == 2 and len(got[None]) == 1
    assert html.extract(df.limit(0)).count() == 0
    made = {r.host: r for r in html.templates(df.select("page_id", "url", "html")).collect()}
    assert made["h.example"].main == ">html>body>article" and "within" in made["h.example"].template


def test_pages_of_many_hosts(spark, monkeypatch):
    rows = [(i, f"http://u@H{i % 3}.example:80/", page(f"<article><p>text {i}</p></article>")) for i in range(9)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    want = sorted(html.extract(df).collect(), key=str)
    monkeypatch.setattr(html, "SMALL_MB", -1)
    assert sorted(html.extract(df).collect(), key=str) == want


def test_html_slots(spark):
    text = lambda i: f"Text of article {i} that is its own and long enough"
    ids = [(i, f"http://ids/{i}", f'<body class="postid-{i} x{"abcdef"[i]}"><div id="page"><article id="slug-{"abcdef"[i]}">{text(i)}</article><div class="author-bio">Who wrote it</div></div></body>') for i in range(6)]
    slugs = [(10 + i, f"http://slugs/{i}", f'<body><div id="page"><div id="{"abcdef"[i]}"><p>{text(i)}</p></div><div class="author-bio">Who wrote it</div></div></body>') for i in range(6)]
    single = [(20, "http://one/", f"<div><p>{text(20)}</p><ul><li>{text(21)} and some more of it<li>z</ul></div>"), (21, "http://two/", f"<main><article id=a>{text(1)}</article><article id=b>{text(2)}</article></main>")]
    got = {r.page_id: r.text for r in html.extract(spark.createDataFrame(ids + slugs + single, "page_id long, url string, html string")).collect()}
    for i in range(6):
        assert got[i] == text(i)
        assert got[10 + i] == text(i)  # a box with the same text on all pages belongs to the template
    assert got[20].startswith(text(20)) and text(21) in got[20] and got[21] == f"{text(1)}\n{text(2)}"


def test_html_names_and_nesting(spark):
    text = lambda i: f"Text of article {i} that is its own and long enough"
    wrap = lambda c, i: f"<html><body><nav>menu</nav><div class='{c}'><p>{text(i)}</p><math><mi>x</mi></math><svg><text>label {i}</text></svg></div><p class='ad'>buy<div class='zone'>Our fixed notice</div><footer>f</footer></body></html>"
    rows = [(i, f"http://widget/{i}", wrap("widget", i)) for i in range(5)] + [(10 + i, f"http://related/{i}", wrap("article related", i)) for i in range(5)]
    rows += [(20, "http://alone/", f"<div class=widget>{text(20)}</div>"), (21, "http://list/", f"<ul><li class=share>share<li>{text(21)}</ul>")]
    rows += [(30, "http://deep/", "<div>" * 100_000 + text(30)), (31, "http://deep/", ("<div>x" * 50_000) + "</div>" * 50_000)]
    rows += [(40 + i, "http://copies/", f"<div><section><p>{text(40)}</p></section><section>same</section></div>") for i in range(4)]
    got = {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(5):
        assert got[i] == got[10 + i] == f"{text(i)}\nxlabel {i}"
        assert i == 4 or got[40 + i] == f"{text(40)}\nsame"
    assert got[20] == text(20) and got[21] == text(21) and got[30] == text(30) and got[31].count("x") == 50_000


# The pipeline


def test_pipeline(spark):
    import corpus_pipeline as p

    assert [n for n, _ in p.STAGES] == ["quality", "lines", "near_copies", "passages", "sequences"]
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    for i, (_, f) in enumerate(p.STAGES):
        out = f(spark, docs, DATA)
        if i < 4:
            assert out.columns == docs.columns
            docs = Cut(spark).write(out)
            assert docs.where("n_chars <> length(text)").count() == 0
    alone = {(r.doc_id, r.piece, r.length) for r in out.collect()}
    assert alone == {(r.doc_id, r.piece, r.length) for r in p.run(spark, DATA).collect()}


def test_removal_takes_little_memory():
    half = np.random.default_rng(5).integers(97, 123, 2_000_000, dtype=np.uint8).tobytes()
    g = substrings.Group(np.array([1, 2]).tobytes(), np.array([len(half)] * 2).tobytes(), substrings.squeeze(half + half), 50)
    _, _, several, back = g.owners()
    flags, raw = several.astype(np.uint8), g.text.tobytes()
    low, count, doc, _, first, _ = g.snippets(flags, back, 1, 50)
    text = b"".join([raw[a:b] for a, b in zip(low[first].tolist(), (low + count + 49)[first].tolist(), strict=True)])
    asked = {"shard": [0], "g": [0], "ids": [g.ids[doc[first]].tobytes()], "sizes": [count[first].astype(np.uint8).tobytes()], "text": [substrings.squeezed_text(text)]}
    own = pd.DataFrame({"g": [0], "kind": [0], "part": [0], "data": [flags.tobytes()], "more": [b""]})
    rows = pd.concat([own, substrings._sort(pd.DataFrame(asked), 50)])
    tracemalloc.start()
    gone = substrings.removed(g, rows, 1, 50)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert not gone[: len(half)].any() and gone[len(half) :].all()
    assert peak < 24 * len(g.text), peak / len(g.text)


@pytest.mark.parametrize("length", [1, 3, 7])
def test_covered_bytes(monkeypatch, length):
    monkeypatch.setattr(substrings, "AT_ONCE", 8)
    for seed in range(40):
        starts = np.random.default_rng(seed).random(60) < 0.02 * seed
        starts[len(starts) - length + 1 :] = False
        want = [starts[max(0, i - length + 1) : i + 1].any() for i in range(len(starts))]
        assert substrings.covered(starts, length).tolist() == want


def test_workers_give_back_what_others_hold():
    own = packing.chunks(packing.tokenizer_path())
    fresh(packing.chunks)
    assert packing.chunks(packing.tokenizer_path()) is own
    fresh()
    assert packing.chunks.cache_info().currsize == 0


@pytest.mark.parametrize("words_", [1, 8])
def test_sketches_rule_out_no_similar_pair(spark, monkeypatch, words_):
    monkeypatch.setattr(linededup, "WORDS", words_)
    rng = random.Random(4)
    lines = []
    for _ in range(30):
        line = words(rng, rng.choice([2, 8, 40, 150]))
        for edits in (0, 1, 2, 8):
            chars = list(line)
            for _ in range(edits):
                chars[rng.randrange(len(chars))] = rng.choice("xyz")
            lines.append("".join(chars))
    texts = spark.createDataFrame(list(enumerate(lines)), "id long, line string").cache()
    pairs = spark.createDataFrame([(i, j) for i in range(len(lines)) for j in range(i)], "a long, b long").cache()
    near = {tuple(r) for r in linededup.may_be_similar(pairs, linededup._sketches(texts)).collect()}
    want = {tuple(r) for r in linededup.similar_pairs(pairs, texts).collect()}
    assert len(want) > 30 and want <= near
    if words_ == 8:
        assert len(near) < pairs.count() / 20


def test_lines_with_sketches(spark, monkeypatch):
    monkeypatch.setattr(linededup, "SKETCHED", 0)
    made = []
    monkeypatch.setattr(linededup, "may_be_similar", lambda p, s, real=linededup.may_be_similar: made.append(1) or real(p, s))
    rows = [(i, t) for i, t in sample() if t is not None and i is not None]
    got = sorted(((r.doc_id, r.text) for r in linededup.dedup_lines(frame(spark, rows)).collect()), key=str)
    assert made and got == brute_lines(rows)


def test_blocks_at_their_bound_are_done(spark):
    sizes = {0: [60, 60, 40, 40], 1: [60, 60, 60], 2: [100], 3: [51, 51, 98]}
    bins = {0: (3, 2), 1: (3, 3), 2: (1, 1), 3: (3, 3)}  # by island; the bounds are 2, 2, 1 and 2
    rows = [(b, i, n, bins[b][i], 0.5) for b, own in sizes.items() for n in own for i in (0, 1)]
    got = packing.states(spark.createDataFrame(rows, "block long, island int, length long, n_bins int, fit double"), 100).collect()
    assert {r.block: (r.best.island, r.done) for r in got} == {0: (1, True), 1: (0, False), 2: (0, True), 3: (0, False)}
