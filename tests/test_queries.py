"""Registered queries against their SQL, and DataFrame operators on small inputs."""

import dataclasses
import datetime as dt
import os
import random
import struct

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sigloom.functions import text as T
from sigloom.operators import evaluation, mining, occurrences, probability, reports, scoring, sessions, signatures, workload
from sigloom.operators.align import painted, tokens_of
from sigloom.operators.signatures import Bayes, Innocuous, Ordered, Substring, Weighted, settled, token_places
from sigloom.plans import catalog
from sigloom.sources import packets as P
from test_kernels import brute_align, brute_substrings

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def rows(df: pd.DataFrame) -> list:
    df = df[sorted(df.columns)].astype(object)
    return sorted(map(tuple, df.where(df.notna(), None).values.tolist()), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_sql(spark, duck, name):
    assert rows(catalog.QUERIES[name](spark, DATA).toPandas()) == rows(duck.sql(catalog.SQL[name]).df())


LIKE = ["xx alpha beta yy", "zz alpha beta qq", "alpha beta w", "v alpha beta alpha", "", None, "alph bet é"]
ONE, OTHER = "SECRETONE-0123456789-abcdefghij-KLMNOPQ", "OTHERKEY+zyxwvutsrq+9876543210+lmnopqrst"
CLUSTERED = [f"a1 GET /index q {ONE} zz", f"b2 {ONE} kk GET /index", f"c3 GET /index {ONE}", f"d4 {OTHER} 77 Host: example", f"e5 Host: example {OTHER}", "f6 lonely text"]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    """Folders of small tables: ``like`` for miners and aligners, ``clustered`` for trees."""

    def make(name: str, bad: list, good: list) -> str:
        at = tmp_path_factory.mktemp(name)
        texts = [*bad, *good]
        pd.DataFrame({"doc_id": range(len(texts)), "text": texts}).to_parquet(at / "documents.parquet")
        pd.DataFrame({"doc_id": range(len(texts)), "toxic": [1] * len(bad) + [0] * len(good)}).to_parquet(at / "labels.parquet")
        pd.DataFrame({"item_id": range(4), "text": ["abcabd", "xabcd", "", "cabdx"]}).to_parquet(at / "benchmark.parquet")
        return str(at)

    return {"like": make("like", LIKE, ["calm"] * 3), "clustered": make("clustered", CLUSTERED, ["GET /index HTTP"] * 9 + ["Host: nowhere"])}


@pytest.mark.parametrize("kfrac", [0.2, 0.5])
def test_pool_substrings_equal_brute_force(spark, folder, kfrac):
    samples = [t or "" for t in LIKE]
    least = min(len(samples), max(catalog.KMIN, int(kfrac * len(samples))))
    want = brute_substrings(samples, 4, least)
    query = catalog.pool_common_substrings
    if kfrac == 0.5:
        own: dict = {}
        for t in sorted(want, key=len, reverse=True):
            own[t] = [want[t].get(i, 0) - sum(own[u][i] * u.count(t) for u in own if len(u) > len(t)) for i in range(len(samples))]
        want = {t: {i: n for i, n in enumerate(c) if n > 0} for t, c in own.items() if sum(n > 0 for n in c) >= least}
        query = catalog.pool_common_substrings_pruned
    got = {tuple(r) for r in query(spark, folder["like"]).collect()}
    assert got and got == {(0, t, i, n) for t, c in want.items() for i, n in c.items()}


def test_alignment_pairs_equal_brute_force(spark, folder):
    items = pd.read_parquet(folder["like"] + "/benchmark.parquet").text.tolist()
    want = {}
    for i, (a, b) in enumerate(zip(items, items[1:], strict=False)):
        aligned = brute_align([ord(c) for c in a], [ord(c) for c in b], 0.8)
        want[i] = (len(aligned), aligned.count(T.GAP))
    assert {r.item_id: (r.n, r.gaps) for r in catalog.alignment_pairs(spark, folder["like"]).collect()} == want


def test_ordered_signature_equals_brute_force(spark, folder):
    samples = [t for t in LIKE if t and "alpha beta" in t]
    pools = spark.createDataFrame([(0, i, t) for i, t in enumerate(samples)], "pool_id int, sample_idx long, text string")
    inside = list(brute_substrings(samples, 2, len(samples)))
    lcs = painted(samples[0], inside)
    for s in samples[1:]:
        lcs = brute_align(lcs, painted(s, inside), 0.8)
    got = signatures.train_pools(pools, signatures.OrderedTree(kfrac=1.0, tokenize_all=True, do_cluster=False)).collect()
    assert [list(r.tokens) for r in got] == [tokens_of(lcs)] and tokens_of(lcs) == ["alpha beta "]
    assert [list(r.tokens) for r in catalog.lcseq_signature(spark, folder["like"]).collect()] == [[]]  # an empty sample shares nothing


def test_clusters_with_an_innocuous_pool(spark, folder):
    got = [set(r.tokens) for r in catalog.hier_cluster_roots(spark, folder["clustered"]).collect()]
    assert any("SECRETONE" in "|".join(t) for t in got) and any("OTHERKEY" in "|".join(t) for t in got)
    assert not any("SECRETONE" in "|".join(t) and "OTHERKEY" in "|".join(t) for t in got)


def test_clusters_with_a_background_that_stays_where_it_is(spark, folder, monkeypatch):
    """Beyond BACKGROUND symbols the innocuous pool was refused."""
    want = [tuple(r) for r in catalog.hier_cluster_roots(spark, folder["clustered"]).collect()]
    monkeypatch.setattr(catalog, "BACKGROUND", 5)
    assert [tuple(r) for r in catalog.hier_cluster_roots(spark, folder["clustered"]).collect()] == want and want


def test_learning_in_rounds_equals_learning_at_once(spark, monkeypatch):
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdef", k=7))
    marks = [word() for _ in range(4)]
    rows = [(p, i, " ".join([word(), marks[(p + i // 4) % 4], word(), marks[i % 4] if i < 6 else word()])) for p in range(3) for i in range(8)]
    rows += [(3, 0, "alone"), (4, 0, None), (4, 1, "")]
    streams = [" ".join([word(), word()] + [m for m in marks[:2] if rng.random() < 0.3]) for _ in range(60)] + [""]
    pools = spark.createDataFrame(rows, "pool_id int, sample_idx long, text string")
    background = spark.createDataFrame([(s,) for s in streams] + [(None,)], "s string").repartition(4)
    monkeypatch.setattr(signatures, "BLOCK", 400)
    monkeypatch.setattr(signatures, "SIGS", 2)
    for empty in (False, True):
        background = background.limit(0) if empty else background
        for most in (5, 20):
            learner = signatures.BayesTree(minlen=3, spec_threshold=0.5, min_cluster_size=2, max_fp_count=most)
            good = Innocuous.gather(background, "s", shares=True)
            want = signatures.train_pools(pools, dataclasses.replace(learner, innocuous=good)).collect()
            got = signatures.train_pools_apart(pools, learner, background, "s")
            key = lambda r: (r.pool_id, r.sig)
            assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want)) and sorted(want, key=key)


def test_backtracking_undoes_what_matches_innocuous_streams():
    samples = ["GET /index one", "two GET /index", "GET /index three"]
    kept = signatures.BayesTree(minlen=6, spec_threshold=1, max_fp_count=5)
    assert len(kept.train(samples)) == 1
    background = Innocuous(["GET /index HTTP"] * 6 + ["x"] * 994, shares=True)
    assert signatures.BayesTree(minlen=6, spec_threshold=1, max_fp_count=5, innocuous=background).train(samples) == []


def test_tokens_are_searched_at_once_and_pools_apart(spark, monkeypatch):
    """Spark joined small pools into one task, and each token was searched for through all streams."""
    rng = random.Random(2)
    streams = ["".join(rng.choices("abc", k=40)) for _ in range(50)] + [""]
    tokens = ["".join(rng.choices("abc", k=rng.randint(1, 5))) for _ in range(300)]
    plain, at_once = Innocuous(streams, shares=True), Innocuous(streams, shares=True)
    at_once.prepare(tokens)
    assert len(at_once._chances) == len(set(tokens)) > signatures.MANY
    assert {t: plain.chance(t) for t in tokens} == {t: at_once.chance(t) for t in tokens}
    pools = spark.createDataFrame([(i % 20, i, "GET /index %d" % i) for i in range(60)], "pool_id int, sample_idx long, text string")
    out = signatures.train_pools(pools, signatures.LongestSubstring())
    assert out.rdd.getNumPartitions() == 20 and out.count() == 20
    copy = "".join(rng.choices("abcdefgh", k=1000))
    compared = []
    monkeypatch.setattr(np, "flatnonzero", lambda x, real=np.flatnonzero: compared.append(1) or real(x))
    common = mining._suffixes([copy, copy])[2]
    assert common.max() == 1000 and 0 < len(compared) < 20  # rounds grow with the logarithm of a common prefix, not with it


def test_background_is_bounded(spark):
    df = spark.createDataFrame([("abc",), (None,), ("abd",)], "s string")
    pool = Innocuous.gather(df, "s", shares=True)
    assert pool.chance("ab") == pytest.approx(2 / 3) and pool.chance("q" * 80) < 1e-180
    with pytest.raises(ValueError):
        Innocuous.gather(df, "s", most=5)
    assert Innocuous.gather(df.limit(0), "s").streams == []


def test_settled_counts_equal_resolve(spark):
    scores = {"the": 1.0, "then": 2.5, "en": 1.5, "ent": 0.5, "nt": 3.0, "": 1.0}
    texts = ["thenthe", "enthen", "xthent", "the", "q", "", None, "thenthe"]
    streams = spark.createDataFrame(list(enumerate(texts)), "i long, s string")
    for a in (True, False):
        for b in (True, False):
            got = {(r.i, r.token): (r.n, r.positions) for r in occurrences.settled_counts(streams, scores, "i", "s", a, b).collect()}
            places = [(i, p, t, scores[t]) for i, s in enumerate(texts) for p, t in token_places(s or "", scores).items()]
            kept = occurrences.resolve(spark.createDataFrame(places, "i long, pos long, token string, score double"), "i", "token", "score", a, b)
            want = {(r.i, t): list(r.tokens).count(t) for r in kept.collect() for t in r.tokens}
            assert {k: n for k, (n, _) in got.items()} == want
    assert occurrences.settled_counts(streams, {}, "i", "s").count() == 0


def test_frequent_ngrams_send_few_bytes(spark, monkeypatch):
    """Eight bytes and more for each symbol were shuffled; frequencies over 255 in a chunk count in full."""
    rng = random.Random(3)
    texts = ["".join(rng.choices("abcdefgh ", k=2000)) for _ in range(100)] + ["the same twelve" + x for x in "ab" * 150]
    docs = spark.createDataFrame(list(enumerate(texts)), "i long, s string").coalesce(1)
    sent, real = [], mining._bitmap

    def counted(found, text, partial, *rest):
        sent.append(found.select(text).mapInArrow(partial, mining.PARTIAL).selectExpr("sum(octet_length(data))").first()[0])
        return real(found, text, partial, *rest)

    monkeypatch.setattr(mining, "_bitmap", counted)
    assert [tuple(r) for r in mining.frequent_ngrams(docs, "i", "s", 15, 300).collect()] == [("the same twelve", 300)]
    assert len(sent) == 2 and sum(sent) < 2 * sum(map(len, texts))


def test_frequent_ngrams_joined_and_sent(spark, monkeypatch):
    texts = ["abcabc", "abcx", "zabc", "abc", None, "ab", "abcabc"]
    docs = spark.createDataFrame(list(enumerate(texts)), "i long, s string")
    grams = {}
    for i, s in enumerate(texts):
        for at in range(len(s or "") - 2):
            own = grams.setdefault(s[at : at + 3], (set(), set()))
            own[0].add(i)
            own[1].add(s[at + 3] if at + 3 < len(s) else ("end", i))
    want = {(g, len(held)) for g, (held, ways) in grams.items() if len(held) >= 2 and len(ways) > 1}
    assert {tuple(r) for r in mining.frequent_ngrams(docs, "i", "s", 3, 2).collect()} == want
    monkeypatch.setattr(mining, "SENT", 0)
    assert {tuple(r) for r in mining.frequent_ngrams(docs, "i", "s", 3, 2).collect()} == want


def test_piece_counts(spark):
    tokens = spark.createDataFrame([("aab",), ("",), (None,), ("aab",), ("q",)], "t string")
    streams = spark.createDataFrame([("aaab",), (None,), ("baab",)], "s string")
    got = {r.t: dict(r.pieces) for r in probability.piece_counts(tokens, streams, "t", "s", 2).collect()}
    assert got == {"aab": {"a": 5, "b": 3, "aa": 3, "ab": 2}, "q": {"q": 0}}
    empty = probability.piece_counts(tokens, streams.limit(0), "t", "s").crossJoin(spark.createDataFrame([(0, 0)], "total long, n long"))
    assert {r.token: r.prob for r in probability.markov_probs(empty.withColumnRenamed("t", "token"), "token").collect()} == {"aab": 0.0, "q": 0.0}
    assert {r.token: r.prob for r in probability.best_partitions(empty.withColumnRenamed("t", "token"), "token").collect()} == {"aab": 0.0, "q": 0.0}


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 1
    assert set(e.oracle_sql()) <= set(e.queries())


def test_positions_with_nulls_ties_and_overlaps(spark):
    streams = spark.createDataFrame([(1, "aaaa"), (2, None), (3, ""), (4, "b\\E.*")], "id long, s string")
    tokens = spark.createDataFrame([(1, "aa"), (2, ""), (3, None), (4, ".*"), (5, "aa")], "k long, t string")
    got = {tuple(r) for r in occurrences.positions(streams, tokens, "id", "s", "k", "t").collect()}
    assert got == {(1, k, p) for k in (1, 5) for p in (0, 1, 2)} | {(4, 4, 3)}
    df = {r.k: (r.df, r.total) for r in occurrences.document_frequency(streams, tokens, "id", "s", "k", "t").collect()}
    assert df == {1: (1, 3), 2: (0, 0), 3: (0, 0), 4: (1, 1), 5: (1, 3)}
    count = streams.select("id", T.overlapping_count("s", F.lit("aa")).alias("o"), T.disjoint_count("s", F.lit("aa")).alias("d")).where("id = 1").first()
    assert (count.o, count.d) == (3, 2)
    assert occurrences.positions(streams, tokens.limit(0), "id", "s", "k", "t").count() == 0


def test_conflicts_equal_the_kernel(spark):
    scores = {"the": 1.0, "then": 2.5, "en": 1.5, "ent": 0.5, "nt": 3.0}
    texts = ["thenthe", "enthen", "xthent", "the", "q"]
    places = [(i, p, t, scores[t]) for i, s in enumerate(texts) for p, t in token_places(s, scores).items()]
    df = spark.createDataFrame(places, "i long, pos long, token string, score double")
    for a in (True, False):
        for b in (True, False):
            got = {r.i: list(r.tokens) for r in occurrences.resolve(df, "i", "token", "score", a, b).collect()}
            assert got == {i: settled(token_places(s, scores), scores, a, b) for i, s in enumerate(texts) if token_places(s, scores)}


def test_bridge_and_lines(spark):
    df = spark.createDataFrame([(bytearray(range(256)),)], "b binary")
    assert bytes(df.select(T.as_bytes(T.as_text("b"))).first()[0]) == bytes(range(256))
    got = spark.createDataFrame([("a\nhit\nb\nc",)], "s string").select(T.context_lines("s", "hit")).first()[0]
    assert got == ["a\nhit\nb"]


def packet(no, at, status="open", payload=b"x", src="a", proto="tcp"):
    return (no, src, "s", 1, 80, dt.datetime.fromtimestamp(at, dt.UTC), proto, status, bytearray(payload))


PACKETS = "pkt_no long, src string, dst string, sport int, dport int, ts timestamp, proto string, status string, payload binary"


def streams(spark, *rows, timeout=10):
    got = sessions.reassemble(spark.createDataFrame(list(rows), PACKETS), timeout).orderBy("emitted").collect()
    return [(r.src, r.pkts, r.status, bytes(r.data)) for r in got]


def test_reassembly(spark):
    assert streams(spark, packet(0, 0, payload=b"a"), packet(1, 1, "fin", b"b"), packet(2, 2, payload=b"c")) == [("a", 2, "fin", b"ab"), ("a", 1, "open", b"c")]
    assert streams(spark, packet(0, 0, payload=b""), packet(1, 1, payload=b"c"), packet(2, 2, "rst", b"")) == [("a", 2, "rst", b"c")]
    # a first packet that ends its connection is queued, and a stream has its last packet's status
    assert streams(spark, packet(0, 0, "fin", b"c"), packet(1, 1, payload=b"d")) == [("a", 2, "open", b"cd")]
    assert streams(spark, packet(0, 0, payload=b"c"), packet(1, 1, payload=b"d"), packet(2, 2, "fin", b"")) == [("a", 3, "fin", b"cd")]
    # a late packet extends its stream unless another came in between; a pause of just the time-out is none
    assert streams(spark, packet(0, 0), packet(1, 99, payload=b"y")) == [("a", 2, "open", b"xy")]
    assert streams(spark, packet(0, 0), packet(1, 11, src="b"), packet(2, 12, payload=b"y"))[0] == ("a", 1, "timeout", b"x")
    assert len(streams(spark, packet(0, 0), packet(1, 10, src="b"), packet(2, 12, payload=b"y"))) == 2
    assert streams(spark, packet(0, 0, "udp", b"u", proto="udp"), packet(1, 1, "udp", b"v", proto="udp")) == [("a", 1, "udp", b"u"), ("a", 1, "udp", b"v")]
    assert streams(spark) == []


def capture() -> bytes:
    out = struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, 1)
    for i, (flags, payload) in enumerate([(0x18, b"GET"), (0x11, b"!")]):
        tcp = struct.pack(">HHIIBBHHH", 1234, 80, 0, 0, 5 << 4, flags, 0, 0, 0) + payload
        ip = struct.pack(">BBHHHBBH4s4s", 0x45, 0, 20 + len(tcp), 0, 0, 64, 6, 0, bytes([10, 0, 0, 1]), bytes([10, 0, 0, 2])) + tcp
        frame = b"\0" * 12 + b"\x08\x00" + ip
        out += struct.pack("<IIII", 100 + i, 5, len(frame), len(frame)) + frame
    return out + b"\0" * 7


def test_captures(spark, tmp_path):
    (tmp_path / "a.pcap").write_bytes(capture())
    got = [(r.src, r.sport, r.status, bytes(r.payload)) for r in P.read_captures(spark, str(tmp_path)).orderBy("pkt_no").collect()]
    assert got == [("10.0.0.1", 1234, "open", b"GET"), ("10.0.0.1", 1234, "fin", b"!")]
    P.register(spark)
    df = spark.read.format("pcap").load(str(tmp_path / "a.pcap"))
    assert df.where("dport = 80").count() == 2
    assert [bytes(r.data) for r in sessions.reassemble(df).collect()] == [b"GET!"]
    with pytest.raises(ValueError):
        list(P.decode(b"x" * 40))


def test_stream_files_and_samples(spark, tmp_path):
    (tmp_path / "data").write_bytes(b"abcdef")
    (tmp_path / "offsets").write_bytes(struct.pack("<QQQ", 0, 2, 3))
    assert [bytes(r.data) for r in P.read_stream_file(spark, str(tmp_path)).orderBy("stream_id").collect()] == [b"ab", b"c", b"def"]
    assert P.read_samples(spark, str(tmp_path)).count() == 2
    assert evaluation.binaries(spark, str(tmp_path), b"cd", 3).select("data").first()[0] == b"abc"


def test_live_reassembly(spark, tmp_path):
    from sigloom.streaming.reassembly import reassemble

    rows = [packet(0, 1000, payload=b"a"), packet(1, 1001, "fin", b"b"), packet(2, 1002, payload=b"c"), packet(3, 5000, src="z"), packet(4, 9000, src="y")]
    (tmp_path / "in").mkdir()
    for i, r in enumerate(rows):
        spark.createDataFrame([r], PACKETS).coalesce(1).write.parquet(str(tmp_path / f"made{i}"))
        (file,) = (tmp_path / f"made{i}").glob("part*.parquet")
        os.utime(file.rename(tmp_path / "in" / f"{i}.parquet"), (1000 + i, 1000 + i))
    live = spark.readStream.schema(PACKETS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = reassemble(live, 100).writeStream.format("memory").queryName("live").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    got = {(r.src, r.pkts, r.status, bytes(r.data)) for r in spark.table("live").collect()}
    assert {("a", 2, "fin", b"ab"), ("a", 1, "timeout", b"c")} <= got


def test_signature_columns_equal_match(spark):
    texts = ["one two three", "three two one", "", "one", "two three\none"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for sig in (Substring("two"), Ordered(["one", "three"]), Ordered([]), Weighted({"one": 1.0, "two": 2.0}, 2.5)):
        assert [r[0] for r in df.select(sig.column("t")).collect()] == [sig.match(t) for t in texts]
    got = {r.sig: r.matched for r in evaluation.matches(df, [Substring("two"), Substring("x")], "t").collect()}
    assert got == {0: 3, 1: 0}
    again = {r.sig: r.matched for r in evaluation.matches_of_distinct(df, [Substring("two"), Substring("x"), Substring("two")], "t").collect()}
    assert again == {0: 3, 1: 0, 2: 3}
    ids = df.withColumn("i", F.monotonically_increasing_id())
    assert [(r.token, r.df) for r in occurrences.best_substrings(["one two", "xone twoy"], ids, "i", "t").collect()][0][1] >= 1
    tokens = spark.createDataFrame([(1, "one")], "k int, w string")
    assert occurrences.approximate_frequency(ids, tokens, "i", "t", "k", "w").first().df == 4


def test_thresholds(spark):
    s = spark.createDataFrame([(x,) for x in (1.0, 2.0, 9.0, 9.5)], "score double")
    assert scoring.biggest_jump(s).first()[0] == 9.0
    assert scoring.biggest_jump(s.where("score > 5")).first()[0] == 9.0
    bound = scoring.bounded(s, spark.createDataFrame([(float(i),) for i in range(5)], "score double"), 1)
    assert 3.0 < bound < 3.1
    with pytest.raises(ValueError):
        scoring.bounded(s, s.limit(0), 1)


def test_reports(spark):
    r = spark.createDataFrame([("a", t, w, s, float(s), 0.5 * s) for t in range(2) for w in ("w", "v") for s in range(3)], "algo string, trial int, workload string, sig int, fp double, fn double")
    best = reports.best_and_rest(r, ["algo", "trial"]).orderBy("trial", "sig").collect()
    assert [(b.sig, b.fp) for b in best] == [(None, 3.0), (0, 0.0)] * 2
    assert reports.additional_fp(r, ["algo"]).first().fp == 3.0
    m = evaluation.median_by(spark.createDataFrame([(1, x) for x in (1, 2, 3, 4)], "x int, y int"), ["x"], "y").first()
    assert m["median"] == 3
    assert "a & 3" in reports.latex_table(spark.createDataFrame([("a", "c", 3.0)], "r string, c string, v double"), "r", "c", "v")


def test_grid_series_and_workloads(spark, tmp_path):
    made = workload.generate(spark, 6, [b"GET ", (8, b"abc"), b" HTTP"], seed=3)
    again = workload.generate(spark, 6, [b"GET ", (8, b"abc"), b" HTTP"], seed=3, parts=2)
    texts = sorted(bytes(r.data).decode() for r in made.collect())
    assert texts == sorted(bytes(r.data).decode() for r in again.collect()) and len(set(texts)) > 1
    good = spark.createDataFrame([("POST it",), ("nothing",)], "t string")
    learners = {"BayesAnd": Bayes(innocuous=Innocuous(["POST it", "nothing"]))}
    series = evaluation.run_grid(spark, learners, texts, {"w": texts}, [2, 3], 1, good, "t", run_ts=1)
    assert {r.y for r in series.where("metric = 'fpos'").collect()} == {0.0}
    evaluation.write_series(series, str(tmp_path / "s"))
    assert evaluation.read_series(spark, str(tmp_path / "s")).count() == series.count()
    few = spark.createDataFrame([(1,), (2,)], "k long")
    assert workload.sample_streams(few, "k", 5).count() == 5 and workload.sample_streams(few.limit(0), "k", 5).count() == 0
    roles = evaluation.split_roles(few, "k", 1).orderBy("k").collect()
    assert [r.role for r in roles] == ["eval", "train"]
