"""What is made of result series: the best signature of each workload, ranks over trials, and tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def best_per_workload(results: DataFrame, keys: list[str]) -> DataFrame:
    """``(keys, workload, sig, fn, fp)``: of each workload the signature with the fewest misses (then the first).
    ``results``: keys, workload, sig, fn, fp."""
    first = F.row_number().over(Window.partitionBy(*keys, "workload").orderBy("fn", "sig"))
    return results.withColumn("_r", first).where("_r = 1").select(*keys, "workload", "sig", "fn", "fp")


def best_and_rest(results: DataFrame, keys: list[str]) -> DataFrame:
    """Best signatures, one row each however many workloads it serves, and one row (``sig`` null) for the others: false
    positives summed, the largest misses of any workload."""
    best = best_per_workload(results, keys).select(*keys, "sig").distinct()
    by_sig = results.groupBy(*keys, "sig").agg(F.max("fp").alias("fp"), F.max("fn").alias("fn"))
    top = by_sig.join(best, [*keys, "sig"], "left_semi").select(*keys, "sig", "fp", "fn")
    rest = by_sig.join(best, [*keys, "sig"], "left_anti").groupBy(*keys).agg(F.sum("fp").alias("fp"), F.max("fn").alias("fn"))
    return top.unionByName(rest.withColumn("sig", F.lit(None).cast(results.schema["sig"].dataType)))


def trial_at(totals: DataFrame, keys: list[str], value: str, trial: str, place) -> DataFrame:
    """The trial at a place (from 0, by number of trials) of the trials sorted by a value."""
    own = Window.partitionBy(*keys)
    ranked = totals.withColumn("_r", F.row_number().over(own.orderBy(value, trial)) - 1).withColumn("_n", F.count("*").over(own))
    return ranked.where(F.col("_r") == place(F.col("_n"))).select(*keys, trial, value)


def median_trial(totals: DataFrame, keys: list[str], value: str, trial: str = "trial") -> DataFrame:
    """The trial in the middle; of an even number, the upper one."""
    return trial_at(totals, keys, value, trial, lambda n: F.floor(n / 2))


def additional_fp(results: DataFrame, keys: list[str], trial: str = "trial", good: float = 0.1, share: float = 0.95) -> DataFrame:
    """``(keys, trial, fp)``: false positives of signatures that are nobody's best with misses under ``good``, summed by
    trial, at rank ``int(n * share) - 1``."""
    served = best_per_workload(results, [*keys, trial]).where(F.col("fn") < good).select(*keys, trial, "sig").distinct().withColumn("_ok", F.lit(True))
    by_sig = results.groupBy(*keys, trial, "sig").agg(F.max("fp").alias("fp")).join(served, [*keys, trial, "sig"], "left")
    totals = by_sig.groupBy(*keys, trial).agg(F.sum(F.when(F.col("_ok"), 0.0).otherwise(F.col("fp"))).alias("fp"))
    return trial_at(totals, keys, "fp", trial, lambda n: F.greatest(F.floor(n * share) - 1, F.lit(0)))


def latex_table(rows: DataFrame, row: str, column: str, value: str, caption: str = "", form: str = "%.4f") -> str:
    """A table with a line for each ``row`` value and a column for each ``column`` value; made for reports of a few hundred cells."""
    wide = rows.groupBy(row).pivot(column).agg(F.first(value)).orderBy(row)
    names = [c for c in wide.columns if c != row]
    lines = [" & ".join([str(r[row]), *("--" if r[c] is None else form % r[c] for c in names)]) + r" \\" for r in wide.collect()]
    head = " & ".join([row, *map(str, names)]) + r" \\ \hline"
    return "\n".join([r"\begin{table}", r"\begin{tabular}{" + "l" * (len(names) + 1) + "}", head, *lines, r"\end{tabular}", rf"\caption{{{caption}}}", r"\end{table}"])
