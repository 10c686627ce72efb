"""False positives and negatives of signatures, trial grids, and result series."""

from __future__ import annotations

import time
from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def matches(streams: DataFrame, signatures: Iterable, text: str, most: int | None = None) -> DataFrame:
    """``(sig, matched, streams)`` of all signatures in one pass; ``most`` looks at so many streams only."""
    signatures = list(signatures)
    streams = streams.limit(most) if most is not None else streams
    if not signatures:
        return streams.sparkSession.createDataFrame([], "sig int, matched long, streams long")
    counted = streams.agg(F.count("*").alias("streams"), *[F.sum(F.coalesce(s.column(text), F.lit(False)).cast("long")).alias(f"s{i}") for i, s in enumerate(signatures)])
    rows = F.explode(F.array(*[F.struct(F.lit(i).alias("sig"), F.coalesce(f"s{i}", F.lit(0)).cast("long").alias("matched")) for i in range(len(signatures))]))
    return counted.select("streams", rows.alias("r")).select("r.sig", "r.matched", "streams")


def matches_of_distinct(streams: DataFrame, signatures: Iterable, text: str) -> DataFrame:
    """As ``matches``, with signatures of one text tested once."""
    signatures = list(signatures)
    first: dict[str, int] = {}
    for i, s in enumerate(signatures):
        first.setdefault(str(s), i)
    tested = matches(streams, [signatures[i] for i in first.values()], text)
    at = {k: n for n, k in enumerate(first)}
    pairs = streams.sparkSession.createDataFrame([(i, at[str(s)]) for i, s in enumerate(signatures)], "sig int, _t int")
    return pairs.join(tested.withColumnRenamed("sig", "_t"), "_t").select("sig", "matched", "streams")


def false_negatives(samples: DataFrame, signatures: Iterable, text: str, workload: str) -> DataFrame:
    """``(workload, sig, missed, samples)``: samples of each workload that a signature doesn't match."""
    signatures = list(signatures)
    if not signatures:
        return samples.sparkSession.createDataFrame([], "workload string, sig int, missed long, samples long")
    counted = samples.groupBy(F.col(workload).alias("workload")).agg(F.count("*").alias("samples"), *[F.sum((~F.coalesce(s.column(text), F.lit(False))).cast("long")).alias(f"s{i}") for i, s in enumerate(signatures)])
    rows = F.explode(F.array(*[F.struct(F.lit(i).alias("sig"), F.col(f"s{i}").alias("missed")) for i in range(len(signatures))]))
    return counted.select("workload", "samples", rows.alias("r")).select("workload", "r.sig", "r.missed", "samples")


def binaries(spark, folder: str, marker: bytes = b"ELF", most: int = 100_000_000) -> DataFrame:
    """Files of a folder that hold a marker, cut to ``most`` bytes: ``(path, data)``."""
    files = spark.read.format("binaryFile").load(folder)
    return files.where(F.contains("content", F.lit(bytearray(marker)))).select("path", F.substring("content", 1, most).alias("data"))


def split_roles(samples: DataFrame, order: str, n_eval: int) -> DataFrame:
    """``samples`` of one workload with ``role``: the first ``n_eval`` by order are ``eval``, the rest ``train``.  The cut is
    found as a top-k, so nothing is ranked as a whole."""
    cut = samples.select(order).orderBy(order).limit(n_eval).agg(F.max(order).alias("cut"), F.count("*").alias("n")).first()
    role = F.lit("train") if not n_eval or cut.cut is None else F.when(F.col(order) <= F.lit(cut.cut), "eval").otherwise("train")
    return samples.withColumn("role", role)


def trial_pools(n: int, sizes: list[int], trials: int, first: int = 0) -> list[tuple[int, int, int, int]]:
    """``(trial, pool_size, from, to)``: each pool takes the next fresh samples by row number."""
    at, out = first * sum(sizes), []
    for trial in range(first, trials):
        for size in sizes:
            out.append((trial, size, min(at, n), min(at + size, n)))
            at += size
    return out


def pool_members(samples: DataFrame, number: str, pools: list[tuple[int, int, int, int]]) -> DataFrame:
    """``samples`` in their pools, by a column that numbers them from 0.  As the pools follow each other, a sample's pool is
    found from its number alone."""
    if not pools:
        return samples.withColumns({"trial": F.lit(0), "pool_size": F.lit(0)}).limit(0)
    rows = samples.sparkSession.createDataFrame(pools, "trial int, pool_size int, lo long, hi long")
    return samples.join(F.broadcast(rows), (F.col(number) >= F.col("lo")) & (F.col(number) < F.col("hi"))).drop("lo", "hi")


SERIES = "run_ts long, algo string, metric string, workload string, trial int, x int, y double"


def run_grid(spark, learners: dict, train: list[str], evaluation: dict[str, list[str]], sizes: list[int], trials: int, innocuous: DataFrame, text: str, run_ts: int | None = None, longest: int = 10_000) -> DataFrame:
    """Result series of training every learner on every pool and testing its signatures."""
    run_ts, rows = run_ts if run_ts is not None else int(time.time()), []
    for trial, size, lo, hi in trial_pools(len(train), sizes, trials):
        pool = [s[:longest] for s in train[lo:hi]]
        for name, learner in learners.items():
            began = time.monotonic()
            sigs = learner.train(pool)
            rows.append((run_ts, name, "deltat", "", trial, size, time.monotonic() - began))
            for r in matches(innocuous, sigs, text).collect():
                if r.streams:
                    rows.append((run_ts, name, "fpos", "", trial, size, r.matched / r.streams))
            for s in sigs:
                rows += [(run_ts, name, "fneg", w, trial, size, sum(not s.match(x) for x in own) / len(own)) for w, own in evaluation.items() if own]
    return spark.createDataFrame(rows, SERIES)


def write_series(series: DataFrame, folder: str) -> None:
    """Tab-separated x and y, a folder for each run, learner, metric, workload and trial."""
    series.select("run_ts", "algo", "metric", "workload", "trial", F.concat_ws("\t", F.col("x").cast("string"), F.format_string("%f", "y")).alias("value")).write.partitionBy("run_ts", "algo", "metric", "workload", "trial").mode("append").text(folder)


def read_series(spark, folder: str) -> DataFrame:
    parts = spark.read.text(folder)
    xy = F.split("value", "\t")
    return parts.select(F.col("run_ts").cast("long"), F.col("algo").cast("string"), F.col("metric").cast("string"), F.col("workload").cast("string"), F.col("trial").cast("int"), xy[0].cast("int").alias("x"), xy[1].cast("double").alias("y"))


def upper_median(values) -> object:
    """The middle of a group's values; of an even number, the upper one."""
    own = F.array_sort(F.collect_list(values))
    return F.get(own, F.floor(F.size(own) / 2).cast("int"))


def median_by(series: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``(keys, median)``: upper medians by two windows' ranks, so that a large group needn't fit a row."""
    own = Window.partitionBy(*keys)
    ranked = series.withColumn("_r", F.row_number().over(own.orderBy(value))).withColumn("_n", F.count("*").over(own))
    return ranked.where(F.col("_r") == F.floor(F.col("_n") / 2) + 1).select(*keys, F.col(value).alias("median"))
