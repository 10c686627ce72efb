"""Queries over the supplied tables, one or more for each operator, and their SQL.

Roles: ``documents`` are streams, ``labels.toxic`` parts them into a suspicious and an innocuous pool,
``benchmark`` is a dictionary of tokens, ``events`` are packets (user: connection, error: end of stream,
props: payload), ``conversations`` are requests and answers, ``lineitem`` is a table of results.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sigloom.functions import text as T
from sigloom.operators import evaluation, mining, occurrences, probability, reports, scoring, sessions, signatures, workload
from sigloom.operators.align import align_column

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: The pool sizes, trials and limits of the queries below.
POOL, MOST_FPOS, KMIN, KFRAC, GAP_HOURS = 40, 5, 4, 0.2, 6
#: Symbols of the innocuous pool up to which it goes to the tasks that learn.
BACKGROUND = 1 << 26


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


# Scans


@query("SELECT count(*) AS n_streams, CAST(sum(strlen(text)) AS BIGINT) AS n_bytes, CAST(min(length(text)) AS BIGINT) AS min_len, CAST(max(length(text)) AS BIGINT) AS max_len, round(avg(length(text)), 6) AS avg_len FROM documents")
def stream_scan_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.length("text")
    return table(spark, sf_dir, "documents", "text").agg(
        F.count("*").alias("n_streams"), F.sum(F.octet_length("text")).alias("n_bytes"), F.min(n).cast("bigint").alias("min_len"), F.max(n).cast("bigint").alias("max_len"), F.round(F.avg(n), 6).alias("avg_len")
    )


@query("SELECT doc_id, lang, CAST(length(text) AS BIGINT) AS n FROM documents WHERE doc_id = 7")
def stream_seek(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents", "doc_id", "lang", "text").where("doc_id = 7").select("doc_id", "lang", F.length("text").cast("bigint").alias("n"))


# Substring lookup


def _found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return occurrences.counts(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"), "doc_id", "text", "item_id", "text")


@query("SELECT b.item_id, count(d.doc_id) AS df FROM benchmark b LEFT JOIN documents d ON contains(d.text, b.text) GROUP BY b.item_id")
def token_doc_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = table(spark, sf_dir, "benchmark", "item_id", "text")
    return occurrences.document_frequency(table(spark, sf_dir, "documents", "doc_id", "text"), tokens, "doc_id", "text", "item_id", "text").select("item_id", "df")


@query("SELECT b.item_id, CAST(sum(len(list_filter(range(1, length(d.text) + 1), lambda i: substr(d.text, i, length(b.text)) = b.text))) AS BIGINT) AS n FROM benchmark b JOIN documents d ON contains(d.text, b.text) GROUP BY b.item_id")
def token_total_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(spark, sf_dir).groupBy("item_id").agg(F.sum("n").alias("n"))


@query("SELECT d.doc_id, b.item_id, CAST((length(d.text) - length(replace(d.text, b.text, ''))) / length(b.text) AS BIGINT) AS n FROM benchmark b JOIN documents d ON contains(d.text, b.text)")
def token_nonoverlap_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _found(spark, sf_dir).select("doc_id", "item_id")
    docs, tokens = table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text").withColumnRenamed("text", "token")
    return found.join(docs, "doc_id").join(tokens, "item_id").select("doc_id", "item_id", T.disjoint_count("text", F.col("token")).alias("n"))


@query("SELECT b.item_id, round(least(0.999, count(d.doc_id) / (SELECT count(*) FROM documents)), 9) AS p FROM benchmark b LEFT JOIN documents d ON contains(d.text, b.text) GROUP BY b.item_id")
def token_empirical_prob(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "documents", "doc_id").agg(F.count("*").alias("n"))
    return token_doc_frequency(spark, sf_dir).crossJoin(F.broadcast(n)).select("item_id", F.round(F.least(F.lit(0.999), F.col("df") / F.col("n")), 9).alias("p"))  # n is one row


@query("SELECT doc_id, CAST(len(regexp_extract_all(text, '(?i)license')) AS BIGINT) AS n FROM documents WHERE regexp_matches(text, '(?i)license')")
def icase_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", T.icase_count("text", "license").alias("n")).where("n > 0")


@query("SELECT lang, count(*) AS n FROM documents WHERE regexp_matches(text, '(?s)\\A(?:The .*\\.\\n)') GROUP BY lang")
def regex_match_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents", "lang", "text").where(T.matches_from_start("text", r"The .*\.\n")).groupBy("lang").agg(F.count("*").alias("n"))


@query("SELECT page_id, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS title FROM pages")
def tagged_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages", "page_id", "html").select("page_id", T.tagged_region("html", "<title>", "</title>").alias("title"))


#: A small dictionary whose tokens overlap and hold each other, with scores (fixed values).
SHORT = {"the": 1.0, "then": 2.5, "en": 1.5, "ent": 0.5, "tion": 3.0, "ion": 1.0, "on": 0.75, "and": 2.0, "nd": 0.25}
_SHORT_SQL = "(VALUES " + ", ".join(f"('{t}', {s})" for t, s in SHORT.items()) + ") AS k(token, score)"
_PLACES_SQL = (
    f"parts AS (SELECT d.doc_id, k.token, k.score, unnest(string_split(d.text, k.token)) AS part, generate_subscripts(string_split(d.text, k.token), 1) AS i, len(string_split(d.text, k.token)) AS m FROM documents d, {_SHORT_SQL} WHERE contains(d.text, k.token)), "
    "places AS (SELECT doc_id, token, score, pos FROM (SELECT doc_id, token, score, i, m, sum(length(part) + length(token)) OVER (PARTITION BY doc_id, token ORDER BY i) - length(token) AS pos FROM parts) WHERE i < m), "
    "longest AS (SELECT doc_id, CAST(pos AS BIGINT) AS pos, arg_max(token, length(token)) AS token, arg_max(score, length(token)) AS score FROM places GROUP BY doc_id, pos)"
)


@query(f"WITH {_PLACES_SQL} SELECT doc_id, token, count(*) AS n, CAST(sum(pos) AS BIGINT) AS positions FROM longest GROUP BY doc_id, token")
def token_positions_longest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return occurrences.settled_counts(table(spark, sf_dir, "documents", "doc_id", "text"), SHORT, "doc_id", "text")


#: The tokens left so far are carried along each document's places, which are folded in order.
@query(
    f"WITH {_PLACES_SQL}, items AS (SELECT doc_id, list({{'pos': pos, 'covered': pos + length(token), 'score': score, 'kept': [token]}} ORDER BY pos) AS items FROM longest GROUP BY doc_id), "
    "folded AS (SELECT doc_id, list_reduce(items, lambda acc, x: CASE WHEN x.pos >= acc.covered THEN {'pos': x.pos, 'covered': x.covered, 'score': x.score, 'kept': list_concat(acc.kept, x.kept)} "
    "WHEN x.score > acc.score THEN {'pos': x.pos, 'covered': x.covered, 'score': x.score, 'kept': list_concat(acc.kept[:-2], x.kept)} ELSE acc END).kept AS kept FROM items) "
    "SELECT doc_id, token, count(*) AS n FROM (SELECT doc_id, unnest(kept) AS token FROM folded) GROUP BY doc_id, token"
)
def token_conflict_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return occurrences.settled_counts(table(spark, sf_dir, "documents", "doc_id", "text"), SHORT, "doc_id", "text", False, False).select("doc_id", "token", "n")


@query("SELECT b.item_id, count(DISTINCT d.text) AS n_contents FROM benchmark b JOIN documents d ON contains(d.text, b.text) GROUP BY b.item_id")
def inverted_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return occurrences.inverted_index(_found(spark, sf_dir), table(spark, sf_dir, "documents", "doc_id", "text"), "doc_id", "text", "item_id")


# Scoring: the tokens are the words that at least min(n, max(KMIN, KFRAC * n)) suspicious documents hold


def _pools(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels", "doc_id", "toxic").join(table(spark, sf_dir, "documents", "doc_id", "text"), "doc_id")


def _words(pools: DataFrame) -> DataFrame:
    words = F.array_distinct(F.filter(F.split("text", "[ \\n]+"), lambda w: w != ""))
    return pools.select("doc_id", "toxic", F.sha2("text", 256).alias("content"), F.explode(words).alias("token"))


def _scores(pools: DataFrame) -> DataFrame:
    words = _words(pools)
    sizes = pools.agg(F.sum((F.col("toxic") == 1).cast("long")).alias("n_s"), F.sum((F.col("toxic") == 0).cast("long")).alias("n_i"))
    bad = words.where("toxic = 1").groupBy("token").agg(F.countDistinct("content").alias("contents"), F.count("*").alias("held"))
    bad = bad.crossJoin(F.broadcast(sizes)).where(F.col("held") >= F.least(F.col("n_s"), F.greatest(F.lit(KMIN), F.floor(F.col("n_s") * KFRAC))))  # sizes is one row
    good = words.where("toxic = 0").groupBy("token").agg(F.count("*").alias("df"))
    return scoring.token_scores(bad, good, "token", F.col("n_s"), F.col("n_i"))


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    pools = _pools(spark, sf_dir)
    return scoring.sample_scores(pools.select("doc_id", "toxic"), _words(pools).select("doc_id", "token"), _scores(pools), "doc_id", "token").withColumn("score", F.round("score", 6))


_SCORES_SQL = """pools AS (SELECT l.doc_id, l.toxic, d.text FROM labels l JOIN documents d ON l.doc_id = d.doc_id),
words AS (SELECT DISTINCT doc_id, toxic, text, token FROM (SELECT doc_id, toxic, text, unnest(string_split_regex(text, '[ \\n]+')) AS token FROM pools) WHERE token <> ''),
sizes AS (SELECT count(*) FILTER (toxic = 1) AS n_s, count(*) FILTER (toxic = 0) AS n_i FROM pools),
bad AS (SELECT token, count(DISTINCT text) AS contents, count(DISTINCT doc_id) AS held FROM words WHERE toxic = 1 GROUP BY token),
good AS (SELECT token, count(DISTINCT doc_id) AS df FROM words WHERE toxic = 0 GROUP BY token),
shares AS (SELECT b.token, b.contents / s.n_s AS p_w, least(0.999, coalesce(g.df, 0) / s.n_i) AS p_n FROM bad b CROSS JOIN sizes s LEFT JOIN good g ON b.token = g.token WHERE b.held >= least(s.n_s, greatest(4, floor(s.n_s * 0.2)))),
scores AS (SELECT token, p_w, p_n, greatest(-log10(p_n / (0.5 * p_w + 0.5 * p_n) + 1e-300), 0.0) AS score FROM shares WHERE greatest(-log10(p_n / (0.5 * p_w + 0.5 * p_n) + 1e-300), 0.0) > 0),
scored AS (SELECT p.doc_id, p.toxic, round(coalesce(x.score, 0.0), 6) AS score FROM pools p LEFT JOIN (SELECT w.doc_id, sum(s.score) AS score FROM words w JOIN scores s ON w.token = s.token GROUP BY w.doc_id) x ON p.doc_id = x.doc_id)"""


@query(f"WITH {_SCORES_SQL} SELECT token, round(p_w, 9) AS p_w, round(p_n, 9) AS p_n, round(score, 6) AS score FROM scores")
def bayes_token_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(_pools(spark, sf_dir)).select("token", F.round("p_w", 9).alias("p_w"), F.round("p_n", 9).alias("p_n"), F.round("score", 6).alias("score"))


@query(f"WITH {_SCORES_SQL} SELECT doc_id, toxic, score FROM scored")
def sample_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir)


@query(f"WITH {_SCORES_SQL} SELECT min(score) AS threshold FROM scored WHERE toxic = 1")
def threshold_min(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.least_score(_scored(spark, sf_dir).where("toxic = 1"))


@query(
    f"WITH {_SCORES_SQL}, steps AS (SELECT score, score - lag(score) OVER (ORDER BY score) AS jump FROM (SELECT DISTINCT score FROM scored WHERE toxic = 1)), "
    "best AS (SELECT jump, score AS upper FROM steps WHERE jump IS NOT NULL ORDER BY jump DESC, score LIMIT 1), low AS (SELECT min(score) AS lowest FROM scored WHERE toxic = 1) "
    "SELECT CASE WHEN jump > lowest THEN upper ELSE lowest END AS threshold FROM low LEFT JOIN best ON true"
)
def threshold_biggest_jump(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.biggest_jump(_scored(spark, sf_dir).where("toxic = 1"))


_BOUND_SQL = f"bound AS (SELECT min(score) AS threshold FROM (SELECT score FROM scored WHERE toxic = 0 ORDER BY score DESC LIMIT {MOST_FPOS + 1}))"


@query(f"WITH {_SCORES_SQL}, {_BOUND_SQL} SELECT round(threshold, 6) AS threshold FROM bound")
def threshold_bound_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = _scored(spark, sf_dir)
    top = scored.where("toxic = 0").orderBy(F.desc("score")).limit(MOST_FPOS + 1)
    return top.agg(F.round(F.min("score"), 6).alias("threshold"))


@query(
    f"WITH {_SCORES_SQL}, {_BOUND_SQL} SELECT CAST(count(*) FILTER (toxic = 0 AND score > threshold) AS BIGINT) AS fp, CAST(count(*) FILTER (toxic = 0) AS BIGINT) AS innocuous, "
    "CAST(count(*) FILTER (toxic = 1 AND score <= threshold) AS BIGINT) AS fn, CAST(count(*) FILTER (toxic = 1) AS BIGINT) AS suspicious FROM scored CROSS JOIN bound"
)
def bayes_match_fp_fn(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = _scored(spark, sf_dir)
    limit = scored.where("toxic = 0").orderBy(F.desc("score")).limit(MOST_FPOS + 1).agg(F.min("score").alias("threshold"))
    over, bad = F.col("score") > F.col("threshold"), F.col("toxic") == 1
    count = lambda c, name: F.sum(c.cast("long")).alias(name)
    return scored.crossJoin(F.broadcast(limit)).agg(count(~bad & over, "fp"), count(~bad, "innocuous"), count(bad & ~over, "fn"), count(bad, "suspicious"))  # the limit is one row


@query("SELECT doc_id, instr(substr(text, instr(text, 'the') + 3), 'tion') > 0 AND instr(substr(substr(text, instr(text, 'the') + 3), instr(substr(text, instr(text, 'the') + 3), 'tion') + 4), 'and') > 0 AS matched FROM documents WHERE instr(text, 'the') > 0")
def subsequence_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents", "doc_id", "text").where(F.instr("text", "the") > 0).select("doc_id", T.holds_in_order("text", ["the", "tion", "and"]).alias("matched"))


# n-grams

_GRAMS_SQL = """chars AS (SELECT doc_id, lang, unnest(string_split(text, '')) AS c, generate_subscripts(string_split(text, ''), 1) AS i FROM documents WHERE text <> ''),
lagged AS (SELECT lang, c, lag(c) OVER w AS p, lag(c, 2) OVER w AS q FROM chars WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
grams AS (SELECT lang, 0 AS k, '' AS context, c AS byte FROM lagged UNION ALL SELECT lang, 1, p, c FROM lagged WHERE p IS NOT NULL UNION ALL SELECT lang, 2, q || p, c FROM lagged WHERE q IS NOT NULL),
stats AS (SELECT lang, k, context, byte, n, CAST(sum(n) OVER (PARTITION BY lang, k, context) AS BIGINT) AS ctx_count FROM (SELECT lang, k, context, byte, count(*) AS n FROM grams GROUP BY lang, k, context, byte))"""


def _stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return probability.context_stats(table(spark, sf_dir, "documents", "lang", "text"), "lang", "text")


@query(f"WITH {_GRAMS_SQL} SELECT lang, CAST(k AS INTEGER) AS k, context, byte, n, ctx_count FROM stats")
def ngram_context_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stats(spark, sf_dir)


@query(
    f"WITH {_GRAMS_SQL} SELECT a.lang, a.context, a.byte, round(greatest(a.n / a.ctx_count, b.n / b.ctx_count, c.n / c.ctx_count), 9) AS prob FROM stats a "
    "JOIN stats b ON b.k = 1 AND b.lang = a.lang AND b.context = substr(a.context, 2) AND b.byte = a.byte JOIN stats c ON c.k = 0 AND c.lang = a.lang AND c.byte = a.byte WHERE a.k = 2"
)
def ngram_context_prob(spark: SparkSession, sf_dir: str) -> DataFrame:
    return probability.context_prob(_stats(spark, sf_dir), "lang").withColumn("prob", F.round("prob", 9))


@query(
    f"WITH {_GRAMS_SQL}, l0 AS (SELECT lang, 0 AS k, context, byte, n, ctx_count FROM stats WHERE k = 0), "
    "l1 AS (SELECT * FROM (SELECT s.lang, 1 AS k, s.context, s.byte, s.n, CAST(sum(s.n) OVER (PARTITION BY s.lang, s.context) AS BIGINT) AS ctx_count, p.n / p.ctx_count AS before FROM stats s JOIN l0 p ON p.lang = s.lang AND p.context = substr(s.context, 2) AND p.byte = s.byte WHERE s.k = 1) WHERE n / ctx_count >= before), "
    "l2 AS (SELECT * FROM (SELECT s.lang, 2 AS k, s.context, s.byte, s.n, CAST(sum(s.n) OVER (PARTITION BY s.lang, s.context) AS BIGINT) AS ctx_count, p.n / p.ctx_count AS before FROM stats s JOIN l1 p ON p.lang = s.lang AND p.context = substr(s.context, 2) AND p.byte = s.byte WHERE s.k = 2) WHERE n / ctx_count >= before) "
    "SELECT lang, CAST(k AS INTEGER) AS k, context, byte, n, ctx_count FROM l0 UNION ALL SELECT lang, k, context, byte, n, ctx_count FROM l1 UNION ALL SELECT lang, k, context, byte, n, ctx_count FROM l2"
)
def ngram_pruned_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return probability.pruned_stats(_stats(spark, sf_dir), "lang")


@query(
    "WITH grams AS (SELECT doc_id, i, substr(text, i, 24) AS gram, CASE WHEN i + 24 <= length(text) THEN substr(text, i + 24, 1) ELSE 'end ' || doc_id END AS nxt FROM (SELECT doc_id, text, unnest(range(1, length(text) - 22)) AS i FROM documents WHERE length(text) >= 24)) "
    "SELECT gram, count(DISTINCT doc_id) AS df FROM grams GROUP BY gram HAVING count(DISTINCT doc_id) >= 4 AND count(DISTINCT nxt) >= 2"
)
def common_ngrams_min_occ(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mining.frequent_ngrams(table(spark, sf_dir, "documents", "doc_id", "text"), "doc_id", "text", 24, 4)


# Learners: suspicious documents dealt into pools of about POOL samples


def _learning_pools(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad = _pools(spark, sf_dir).where("toxic = 1").select("doc_id", "text")
    n = max(1, -(-bad.count() // POOL))
    return bad.select((workload.portable_order("doc_id") % n).cast("int").alias("pool_id"), F.col("doc_id").alias("sample_idx"), "text")


@query()
def pool_common_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mining.pool_substrings(_learning_pools(spark, sf_dir), 4, prune=False, kmin=KMIN, kfrac=KFRAC)


@query()
def pool_common_substrings_pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mining.pool_substrings(_learning_pools(spark, sf_dir), 4, kmin=KMIN, kfrac=0.5)


@query()
def alignment_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "benchmark", "item_id", "text")
    pairs = items.join(items.select((F.col("item_id") - 1).alias("item_id"), F.col("text").alias("other")), "item_id")
    aligned = pairs.repartition(8, "item_id").select("item_id", align_column()("text", "other").alias("a"))
    return aligned.select("item_id", F.size("a").alias("n"), F.size(F.filter("a", lambda x: x == T.GAP)).alias("gaps"))


#: A pool's string is made of its shortest sample's substrings; longest, then first in order.
_POOLS_SQL = (
    f"pool_of AS (SELECT d.doc_id, coalesce(d.text, '') AS text, ((d.doc_id * 2654435761 + 40503) % 4294967296) % (SELECT greatest(1, CAST(ceil(count(*) / {POOL}.0) AS BIGINT)) FROM labels l JOIN documents d ON l.doc_id = d.doc_id WHERE toxic = 1) AS pool_id FROM labels l JOIN documents d ON l.doc_id = d.doc_id WHERE toxic = 1)"
)


@query(
    f"WITH {_POOLS_SQL}, base AS (SELECT pool_id, arg_min(text, (length(text), doc_id)) AS text, count(*) AS n FROM pool_of GROUP BY pool_id), "
    "starts AS (SELECT pool_id, text, n, unnest(range(1, length(text))) AS i FROM base), "
    "parts AS (SELECT DISTINCT pool_id, n, substr(text, i, len) AS token FROM (SELECT *, unnest(range(2, length(text) - i + 2)) AS len FROM starts)), "
    "held AS (SELECT p.pool_id, p.token FROM parts p JOIN pool_of d ON d.pool_id = p.pool_id AND contains(d.text, p.token) GROUP BY p.pool_id, p.token, p.n HAVING count(*) = p.n) "
    "SELECT CAST(pool_id AS INTEGER) AS pool_id, 0 AS sig, 'Substring' AS kind, token AS signature FROM (SELECT *, row_number() OVER (PARTITION BY pool_id ORDER BY length(token) DESC, encode(token)) AS r FROM held) WHERE r = 1"
)
def lcs_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signatures.train_pools(_learning_pools(spark, sf_dir), signatures.LongestSubstring()).drop("tokens")


@query()
def lcseq_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signatures.train_pools(_learning_pools(spark, sf_dir), signatures.OrderedTree(kfrac=1.0, tokenize_all=True, do_cluster=False))


def _token_pieces(spark: SparkSession, sf_dir: str, longest: int | None) -> DataFrame:
    """``(token, pieces, total, n)``: tokens of the suspicious pool, occurrences of their pieces over the innocuous documents
    as a map, and these documents' size."""
    pools = _pools(spark, sf_dir)
    good = pools.where("toxic = 0").select("doc_id", "text")
    size = good.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("total"), F.count("*").alias("n"))
    return probability.piece_counts(_scores(pools).select("token"), good, "token", "text", longest).crossJoin(F.broadcast(size))  # size is one row


def _pieces_sql(longest: int | None) -> str:
    most = f"least(length(token), {longest})" if longest else "length(token)"
    return (
        "calm AS (SELECT text FROM pools WHERE toxic = 0), size AS (SELECT CAST(coalesce(sum(length(text)), 0) AS BIGINT) AS total, count(*) AS n FROM calm), "
        f"spans AS (SELECT DISTINCT substr(token, a, len) AS piece FROM (SELECT token, a, unnest(range(1, least({most}, length(token) - a + 1) + 1)) AS len FROM (SELECT token, unnest(range(1, length(token) + 1)) AS a FROM scores))), "
        "lengths AS (SELECT DISTINCT length(piece) AS len FROM spans), "
        "windows AS (SELECT substr(text, i, len) AS piece FROM (SELECT text, len, unnest(range(1, length(text) - len + 2)) AS i FROM calm CROSS JOIN lengths)), "
        "pieces AS (SELECT s.piece, count(w.piece) AS n FROM spans s LEFT JOIN windows w ON w.piece = s.piece GROUP BY s.piece)"
    )


#: All ways to put a token together, from its end; pieces but the last have four symbols or more.
@query(
    f"WITH RECURSIVE {_SCORES_SQL}, {_pieces_sql(None)}, piece_shares AS (SELECT piece, least(0.999, p.n / greatest(1, s.n)) AS share FROM pieces p CROSS JOIN size s), "
    "ways AS (SELECT token, a, p.share AS prob, [length(token)] AS ends FROM (SELECT token, unnest(range(0, length(token))) AS a FROM scores) t JOIN piece_shares p ON p.piece = substr(token, a + 1) "
    "UNION ALL SELECT w.token, w.b, p.share * w.prob, list_concat([w.a], w.ends) FROM (SELECT *, unnest(range(0, a - 3)) AS b FROM ways) w JOIN piece_shares p ON p.piece = substr(w.token, w.b + 1, w.a - w.b)) "
    "SELECT token, round(prob, 12) AS prob, CAST(len(ends) AS BIGINT) AS n_pieces FROM (SELECT *, row_number() OVER (PARTITION BY token ORDER BY prob DESC, ends DESC) AS r FROM ways WHERE a = 0) WHERE r = 1"
)
def mpp_token_prob(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = probability.best_partitions(_token_pieces(spark, sf_dir, None), "token", least=3)
    return best.select("token", F.round("prob", 12).alias("prob"), F.size("pieces").cast("long").alias("n_pieces"))


#: One step of recursion is one symbol of a stream; a state's chance moves on with a hit, or back to the start or behind it.
@query(
    f"WITH RECURSIVE {_SCORES_SQL}, {_pieces_sql(10)}, "
    "places AS (SELECT token, i, unnest(range(0, least(i, 9) + 1)) AS k FROM (SELECT token, unnest(range(0, length(token))) AS i FROM scores)), "
    "hits AS (SELECT x.token, x.i, greatest(1 / max(s.total), max(coalesce(f.n / nullif(CASE WHEN k = 0 THEN s.total ELSE c.n END, 0), 0))) AS p FROM places x CROSS JOIN size s JOIN pieces f ON f.piece = substr(x.token, i - k + 1, k + 1) LEFT JOIN pieces c ON c.piece = substr(x.token, i - k + 1, k) AND k > 0 GROUP BY x.token, x.i), "
    "chain AS (SELECT token, list(p ORDER BY i) AS p, length(token) AS len FROM hits GROUP BY token), "
    "misses AS (SELECT token, len, p, list_transform(range(1, len + 1), lambda i: (1 - p[i]) * CASE WHEN substr(token, i, 1) = substr(token, 1, 1) THEN 1 ELSE 1 - p[1] END) AS to0, "
    "list_transform(range(1, len + 1), lambda i: CASE WHEN substr(token, i, 1) = substr(token, 1, 1) THEN 0 ELSE (1 - p[i]) * p[1] END) AS to1 FROM chain), "
    "walk AS (SELECT token, len, p, to0, to1, CAST(0 AS BIGINT) AS t, list_transform(range(0, len + 1), lambda i: CASE WHEN i = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS now FROM misses "
    "UNION ALL SELECT token, len, p, to0, to1, t + 1, list_transform(range(0, len + 1), lambda j: CASE WHEN j = 0 THEN list_dot_product(now[1:len], CAST(to0 AS DOUBLE[])) "
    "ELSE now[j] * p[j] + CASE WHEN j = len THEN now[j + 1] ELSE 0 END + CASE WHEN j = 1 THEN list_dot_product(now[1:len], CAST(to1 AS DOUBLE[])) ELSE 0 END END) FROM walk WHERE t < (SELECT total // greatest(1, n) FROM size)) "
    "SELECT token, round(now[len + 1], 9) AS prob FROM walk WHERE t = (SELECT total // greatest(1, n) FROM size)"
)
def markov_token_prob(spark: SparkSession, sf_dir: str) -> DataFrame:
    return probability.markov_probs(_token_pieces(spark, sf_dir, 10), "token").select("token", F.round("prob", 9).alias("prob"))


@query()
def hier_cluster_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of whole samples; scores and backtracking use the innocuous pool, which goes to the tasks while it is small."""
    background = _pools(spark, sf_dir).where("toxic = 0").select("text")
    learner = signatures.BayesTree(minlen=6, kmin=2, kfrac=1.0, spec_threshold=60, min_cluster_size=2)
    if (background.agg(F.sum(F.length("text"))).first()[0] or 0) > BACKGROUND:
        return signatures.train_pools_apart(_learning_pools(spark, sf_dir), learner, background, "text")
    good = signatures.Innocuous.gather(background, "text", most=BACKGROUND, shares=True)
    return signatures.train_pools(_learning_pools(spark, sf_dir), dataclasses.replace(learner, innocuous=good))


# Sessions


_EVENTS_SQL = "e AS (SELECT *, epoch_us(ts) / 1000000.0 AS t FROM events)"


@query(
    f"WITH {_EVENTS_SQL}, marked AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY user_id ORDER BY event_id) > {GAP_HOURS * 3600} THEN 1 ELSE 0 END AS new FROM e), "
    "numbered AS (SELECT *, 1 + sum(new) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS session FROM marked) "
    "SELECT user_id, CAST(session AS BIGINT) AS session, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM numbered GROUP BY user_id, session"
)
def sessionize_timeout(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events", "event_id", "ts", "user_id")
    split = sessions.by_gap(events, ["user_id"], "ts", "event_id", GAP_HOURS * 3600)
    return split.groupBy("user_id", "session").agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def _packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events", "event_id", "ts", "user_id", "event_type", "props")
    return events.select(
        F.col("event_id").alias("pkt_no"), F.col("user_id").cast("string").alias("src"), F.lit("server").alias("dst"), F.lit(0).alias("sport"), F.lit(80).alias("dport"), "ts",
        F.lit("tcp").alias("proto"), F.when(F.col("event_type") == "error", "rst").otherwise("open").alias("status"), F.encode("props", "UTF-8").alias("payload"),
    )


#: Every event has a payload, so a stream ends where its connection's packet before it ended it (unless that one began it)
#: or where the time-out had passed by the packet before; the state is carried along by recursion over a connection's packets.
@query(
    f"WITH RECURSIVE {_EVENTS_SQL}, g AS (SELECT *, lag(t) OVER (ORDER BY event_id) AS before FROM e), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM g), "
    "walk AS (SELECT user_id, i, event_id, t, strlen(props) AS size, CAST(1 AS BIGINT) AS stream, false AS closed FROM r WHERE i = 1 UNION ALL "
    f"SELECT r.user_id, r.i, r.event_id, r.t, strlen(r.props), w.stream + CASE WHEN w.closed OR r.before - w.t > {GAP_HOURS * 3600} THEN 1 ELSE 0 END, NOT (w.closed OR r.before - w.t > {GAP_HOURS * 3600}) AND r.event_type = 'error' FROM walk w JOIN r ON r.user_id = w.user_id AND r.i = w.i + 1) "
    "SELECT CAST(user_id AS VARCHAR) AS src, CAST(pkts AS BIGINT) AS pkts, CAST(bytes AS BIGINT) AS bytes, count(*) AS n FROM (SELECT user_id, stream, count(*) AS pkts, sum(size) AS bytes FROM walk GROUP BY user_id, stream) GROUP BY user_id, pkts, bytes"
)
def sessionize_reference_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    streams = sessions.reassemble(_packets(spark, sf_dir), GAP_HOURS * 3600)
    return streams.groupBy("src", F.col("pkts").cast("bigint").alias("pkts"), F.octet_length("data").cast("bigint").alias("bytes")).agg(F.count("*").alias("n"))


@query("SELECT conv_id, count(*) AS n, string_agg(text, chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id")
def conversation_reassembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.join_in_order(table(spark, sf_dir, "conversations", "conv_id", "turn", "text"), "conv_id", "turn", "text", "\n")


@query("SELECT doc_id, source FROM documents ORDER BY (doc_id * 2654435761 + 40503) % 4294967296, doc_id LIMIT 100")
def noise_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workload.sample_streams(table(spark, sf_dir, "documents", "doc_id", "source"), "doc_id", 100)


# Evaluation and reports: lineitem's order number modulo 5 is a trial, its line a workload, its supplier modulo 4 a signature


@query(
    "WITH p AS (SELECT * FROM (VALUES (0, 20, 0, 20), (0, 30, 20, 50), (1, 20, 50, 70), (1, 30, 70, 100)) AS v(trial, pool_size, lo, hi)), "
    "n AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i FROM (SELECT l.doc_id FROM labels l JOIN documents d ON l.doc_id = d.doc_id ORDER BY l.doc_id LIMIT 100)) SELECT CAST(trial AS INTEGER) AS trial, CAST(pool_size AS INTEGER) AS pool_size, doc_id FROM n JOIN p ON i >= lo AND i < hi"
)
def trial_pools(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = evaluation.trial_pools(100, [20, 30], 2)
    first = table(spark, sf_dir, "labels", "doc_id").join(table(spark, sf_dir, "documents", "doc_id"), "doc_id").orderBy("doc_id").limit(100)  # what the grid's pools take
    numbered = first.withColumn("i", F.row_number().over(Window.orderBy("doc_id")) - 1)
    return evaluation.pool_members(numbered, "i", grid).select("trial", "pool_size", "doc_id")


@query("SELECT l_returnflag, l_linenumber, m AS median FROM (SELECT l_returnflag, l_linenumber, list_sort(list(l_extendedprice))[count(*) // 2 + 1] AS m FROM lineitem GROUP BY l_returnflag, l_linenumber)")
def upper_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.median_by(table(spark, sf_dir, "lineitem", "l_returnflag", "l_linenumber", "l_extendedprice"), ["l_returnflag", "l_linenumber"], "l_extendedprice")


_RESULTS_SQL = "results AS (SELECT l_returnflag AS algo, l_orderkey % 5 AS trial, l_linenumber AS workload, l_suppkey % 4 AS sig, count(*) AS fp, round(avg(l_discount), 9) AS fn FROM lineitem GROUP BY ALL)"


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem", "l_returnflag", "l_orderkey", "l_linenumber", "l_suppkey", "l_discount")
    keys = [F.col("l_returnflag").alias("algo"), (F.col("l_orderkey") % 5).alias("trial"), F.col("l_linenumber").alias("workload"), (F.col("l_suppkey") % 4).alias("sig")]
    return lines.groupBy(*keys).agg(F.count("*").alias("fp"), F.round(F.avg("l_discount"), 9).alias("fn"))


@query(f"WITH {_RESULTS_SQL} SELECT algo, trial, workload, sig, fn, fp FROM (SELECT *, row_number() OVER (PARTITION BY algo, trial, workload ORDER BY fn, sig) AS r FROM results) WHERE r = 1")
def best_sig_per_workload(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.best_per_workload(_results(spark, sf_dir), ["algo", "trial"])


@query(
    f"WITH {_RESULTS_SQL}, best AS (SELECT DISTINCT algo, trial, sig FROM (SELECT *, row_number() OVER (PARTITION BY algo, trial, workload ORDER BY fn, sig) AS r FROM results) WHERE r = 1 AND fn < 0.0495), "
    "sums AS (SELECT algo, trial, sig, max(fp) AS fp FROM results GROUP BY algo, trial, sig), "
    "totals AS (SELECT s.algo, s.trial, CAST(sum(CASE WHEN b.sig IS NULL THEN s.fp ELSE 0 END) AS DOUBLE) AS fp FROM sums s LEFT JOIN best b ON b.algo = s.algo AND b.trial = s.trial AND b.sig = s.sig GROUP BY s.algo, s.trial), "
    "ranked AS (SELECT *, row_number() OVER (PARTITION BY algo ORDER BY fp, trial) - 1 AS r, count(*) OVER (PARTITION BY algo) AS n FROM totals) SELECT algo, trial, fp FROM ranked WHERE r = greatest(CAST(floor(n * 0.95) AS BIGINT) - 1, 0)"
)
def addtl_fpos_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.additional_fp(_results(spark, sf_dir), ["algo"], good=0.0495)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The suspicious pool's token scores applied to all labelled documents, by a threshold bounded on the innocuous ones."""
    return bayes_match_fp_fn(spark, sf_dir)


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
