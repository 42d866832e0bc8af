"""Lines of texts and how many documents of a host hold them: what the two
line operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: host tables up to this many line hashes in all are broadcast (8 bytes each)
BROADCAST_HASHES = 250_000


def norm_line(line: Column) -> Column:
    """Lower-cased, ASCII white space collapsed, ends trimmed. The pattern
    runs only on lines that need it: most are clean, and it costs far more
    memory than the byte searches for what makes it necessary."""
    low = F.lower(line)
    untidy = F.contains(low, F.lit("  "))
    for c in "\t\x0b\x0c\r":
        untidy = untidy | F.contains(low, F.lit(c))
    return F.trim(F.when(untidy, F.regexp_replace(low, "[\\t\\x0B\\f\\r ]+", " ")).otherwise(low))


def line_key(line: Column) -> Column:
    """64-bit hash of a normalised line, null for a blank one."""
    n = norm_line(line)
    return F.when(n != "", F.xxhash64(n))


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def line_counts(docs: DataFrame, host: str, keys: str) -> DataFrame:
    """(host, key, n_docs) from rows (host, array of line hashes): in how
    many rows of its host a line occurs. A row counts a line once; the
    map-side sums collapse hot lines before the shuffle."""
    return (docs.select(host, F.explode(F.array_distinct(F.array_compact(keys))).alias("key"))
            .groupBy(host, "key").agg(F.count("*").alias("n_docs")))


def with_host_lines(docs: DataFrame, frequent: DataFrame, host: str, name: str) -> DataFrame:
    """Add to each row of docs the array ``name`` of its host's frequent
    line hashes (empty if none). frequent: (host, key). A host has at most
    (its mean number of lines) / (the ratio) of them, so the array stays
    small; the table is broadcast only if its counted size is, else it is
    joined by host, where the adaptive skew join splits a hot host."""
    per = materialize(frequent.groupBy(host).agg(F.collect_set("key").alias(name)), f"lines-{name.strip('_')}")
    total = per.agg(F.coalesce(F.sum(F.size(name)), F.lit(0)).alias("n"), F.count("*").alias("h")).first()
    small = total["n"] + total["h"] <= BROADCAST_HASHES
    right = F.broadcast(per) if small else per
    out = docs.join(right, host, "left")
    return out.withColumn(name, F.coalesce(F.col(name), F.array().cast("array<bigint>")))
