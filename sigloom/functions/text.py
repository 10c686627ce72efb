"""Column expressions over byte streams and text, and the one-character-per-byte bridge."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The symbol that stands for a gap in alignments; bytes are 0 to 255.
GAP = 256


def as_text(data: Column | str) -> Column:
    """Bytes as a string of as many characters; text functions are then exact on bytes."""
    return F.decode(data, "ISO-8859-1")


def as_bytes(text: Column | str) -> Column:
    return F.encode(text, "ISO-8859-1")


def quoted(token: Column) -> Column:
    """The token as a regular expression that matches it and nothing else."""
    return F.regexp_replace(token, r"([^\p{L}\p{Nd}])", r"\\$1")


def overlapping_count(text: Column | str, token: Column) -> Column:
    """Number of positions at which a token occurs, overlaps included; 0 for an empty token."""
    text = F.col(text) if isinstance(text, str) else text
    return F.when(F.length(token) == 0, 0).otherwise(F.regexp_count(text, F.concat(F.lit("(?s)(?="), quoted(token), F.lit(")")))).cast("long")


def disjoint_count(text: Column | str, token: Column) -> Column:
    """Number of occurrences counted from the left without overlaps; 0 for an empty token."""
    text = F.col(text) if isinstance(text, str) else text
    shorter = F.length(F.replace(text, token, F.lit("")))
    return F.when(F.length(token) == 0, 0).otherwise((F.length(text) - shorter) / F.length(token)).cast("long")


def icase_count(text: Column | str, pattern: str) -> Column:
    """Occurrences of a pattern without regard to case."""
    return F.regexp_count(text, F.lit("(?i)" + pattern)).cast("long")


def matches_from_start(text: Column | str, pattern: str) -> Column:
    """Whether a pattern matches at the start of a stream; a dot matches any symbol."""
    return (F.col(text) if isinstance(text, str) else text).rlike(rf"(?s)\A(?:{pattern})")


def tagged_region(text: Column | str, start: str, end: str) -> Column:
    """The first region between two markers, markers left out; empty where there is none."""
    return F.regexp_extract(text, f"(?s){start}(.*?){end}", 1)


def context_lines(text: Column | str, token: str, around: int = 1) -> Column:
    """Lines that hold a token, each with the lines around it."""
    lines = F.split(text, "\n")
    hits = F.filter(F.sequence(F.lit(0), F.size(lines) - 1), lambda i: F.contains(F.get(lines, i), F.lit(token)))
    return F.transform(hits, lambda i: F.array_join(F.slice(lines, F.greatest(i - around, F.lit(0)) + 1, i + around + 1 - F.greatest(i - around, F.lit(0))), "\n"))


def holds_in_order(text: Column | str, tokens: list[str] | Column) -> Column:
    """Whether tokens occur one behind the other without overlaps, leftmost first. No tokens: true."""
    text = F.col(text) if isinstance(text, str) else text
    tokens = F.array(*[F.lit(t) for t in tokens]).cast("array<string>") if isinstance(tokens, list) else tokens

    def step(at: Column, token: Column) -> Column:
        found = F.locate_from(text, token, at) if hasattr(F, "locate_from") else F.call_function("locate", token, text, at)
        return F.when(at == 0, F.lit(0)).when(F.length(token) == 0, at).when(found > 0, found + F.length(token)).otherwise(F.lit(0))

    return F.aggregate(tokens, F.lit(1), step) > 0
