"""Alignment of two symbol sequences with a gap symbol, and what is made of it."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigloom.functions.text import GAP

DIAGONAL, LEFT, UP = 0, 1, 2


def align(a: list[int] | np.ndarray, b: list[int] | np.ndarray, gap_penalty: float = 0.8) -> list[int]:
    """Common subsequence of two sequences as symbols, with ``GAP`` wherever a run of matches is left.

    Dynamic programming along anti-diagonals in single precision.  A match is worth 1; leaving a match, told by
    equality of the symbols before, costs the penalty once; free ends in front; ties go diagonal, then left, then
    up.  Memory: a byte a cell for directions."""
    a, b = np.asarray(a, np.int64), np.asarray(b, np.int64)
    n, m = len(a), len(b)
    if not n or not m:
        return []
    gap = np.float32(gap_penalty)
    way = np.zeros((n + 1, m + 1), np.uint8)
    # values of the two diagonals before, by row
    two, one = np.zeros(n + 1, np.float32), np.zeros(n + 1, np.float32)
    for d in range(2, n + m + 1):
        lo, hi = max(1, d - m), min(n, d - 1)
        i = np.arange(lo, hi + 1)
        j = d - i
        same = (a[i - 1] == b[j - 1]) & (a[i - 1] != GAP)
        inner = (i > 1) & (j > 1)
        was = inner & (a[i - 2] == b[j - 2])
        best = two[i - 1] + np.where(same, np.float32(1), np.where(was, -gap, np.float32(0))).astype(np.float32)
        way_d = np.zeros(len(i), np.uint8)
        left = one[i] - np.where((j > 1) & (a[i - 1] == b[j - 2]), gap, np.float32(0)).astype(np.float32)
        take = left > best
        best, way_d = np.where(take, left, best), np.where(take, LEFT, way_d)
        up = one[i - 1] - np.where((i > 1) & (a[i - 2] == b[j - 1]), gap, np.float32(0)).astype(np.float32)
        take = up > best
        best, way_d = np.where(take, up, best), np.where(take, UP, way_d)
        way[i, j] = way_d
        new = np.zeros(n + 1, np.float32)
        new[i] = best
        two, one = one, new
    out, i, j, matched = [], n, m, False
    while i > 0 and j > 0:
        move = way[i, j]
        if move == DIAGONAL and a[i - 1] == b[j - 1] and a[i - 1] != GAP:
            out.append(int(a[i - 1]))
            matched = True
        else:
            if matched:
                out.append(GAP)
            matched = False
        i -= move != LEFT
        j -= move != UP
    return out[::-1]


def tokens_of(aligned: list[int]) -> list[str]:
    """The runs of symbols between gaps."""
    out, run = [], []
    for s in [*aligned, GAP]:
        if s != GAP:
            run.append(chr(s))
        elif run:
            out.append("".join(run))
            run = []
    return out


def escaped(text: str) -> str:
    """The text as a regular expression of itself, with control and high symbols as hexadecimal."""
    return "".join(c if c.isascii() and c.isalnum() else "\\" + c if c in " \t\n\r" or (c.isascii() and c.isprintable()) else f"\\x{ord(c):02x}" if ord(c) < 256 else re.escape(c) for c in text)


def pattern_of(aligned: list[int]) -> str:
    """A regular expression with any stretch at each gap."""
    return "".join(".*" if s == GAP else escaped(chr(s)) for s in aligned)


def painted(sample: str, tokens: list[str]) -> list[int]:
    """A sample with everything outside of tokens collapsed into single gaps."""
    keep = np.zeros(len(sample), bool)
    for t in tokens:
        at = sample.find(t)
        while t and at >= 0:
            keep[at : at + len(t)] = True
            at = sample.find(t, at + 1)
    out: list[int] = []
    for c, k in zip(sample, keep, strict=True):
        if k:
            out.append(ord(c))
        elif not out or out[-1] != GAP:
            out.append(GAP)
    return out


def align_column(gap_penalty: float = 0.8):
    """The alignment of two string columns as an array column function."""

    @F.pandas_udf("array<int>")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([align([ord(c) for c in x or ""], [ord(c) for c in y or ""], gap_penalty) for x, y in zip(a, b, strict=True)])

    return run


def pairs_aligned(pairs: DataFrame, a: str | Column, b: str | Column, gap_penalty: float = 0.8) -> DataFrame:
    """``pairs`` with ``aligned``, the array of symbols."""
    return pairs.withColumn("aligned", align_column(gap_penalty)(a, b))
