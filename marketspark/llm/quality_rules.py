"""Quality rules with cross-document line frequency.

Base rules count words, symbols, repeated lines and repeated 8-word windows
of a text. The corpus rule hashes normalised lines, counts in how many
distinct documents of a host each occurs, removes the lines above the host's
limit, and rejects documents that this depletes.

Distinct documents are distinct contents: exact copies of a document (after
white space and case) are one document of their host, so a document is
not taken for boilerplate because it was copied. The limit of a host is the
larger of ``max_docs`` and ``ratio`` times its distinct documents. A document
is depleted when it lost lines and keeps fewer than ``min_words`` words or
less than ``min_share`` of its words.

Defined results for odd input: null text has no words (base_failed); a null
host's lines have no limit; repeated rows each get a row; an empty table
gives no rows. Working columns are prefixed ``_qr_``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, ship, text_slices, tidy
from .lines import line_counts, line_key, lines_of, norm_line, with_host_lines

MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
WINDOW = 8
MAX_DOCS = 20
RATIO = 0.02
MIN_SHARE = 0.5
_SLICE_BYTES = 2_000_000
_WS = bytes(range(9, 14)) + b" "
_SYMBOLS = b"#*$%&|<>"


def repeated_words(codes: np.ndarray, doc: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Per word position: is it inside a window of words that its document
    holds at least twice? codes: word numbers; doc: document numbers,
    ascending. Windows are named exactly, by numbering pairs of halves."""
    n = len(codes)
    out = np.zeros(n, dtype=bool)
    if n < window:
        return out
    name = codes.astype(np.int64)
    size = 1
    while size < window:            # window is a power of two
        m = n - 2 * size + 1
        pair = name[:m] * (int(name.max()) + 1) + name[size:size + m]
        name = pd.factorize(pair)[0].astype(np.int64)
        size *= 2
    m = len(name)
    inside = doc[:m] == doc[window - 1:]
    where = np.flatnonzero(inside)
    pair = name[where] * (int(doc[-1]) + 1) + doc[where]
    group = pd.factorize(pair)[0]
    twice = where[np.bincount(group)[group] > 1]
    edge = np.zeros(n + 1, dtype=np.int64)
    np.add.at(edge, twice, 1)
    np.add.at(edge, twice + window, -1)
    return np.cumsum(edge[:-1]) > 0


def base_counts(texts: list[bytes | None], window: int = WINDOW) -> dict[str, np.ndarray]:
    words: list[bytes] = []
    n_words = np.zeros(len(texts), dtype=np.int64)
    chars, symbols, dup = (np.zeros(len(texts), dtype=np.int64) for _ in range(3))
    for i, t in enumerate(texts):
        if not t:
            continue
        w = t.split()
        words += w
        n_words[i] = len(w)
        solid = t.translate(None, _WS)
        # code points: bytes that do not continue a UTF-8 sequence
        chars[i] = len(solid) - len(solid.translate(None, _NOT_CONTINUED))
        symbols[i] = len(t) - len(t.translate(None, _SYMBOLS))
        lines = [x for x in t.split(b"\n") if x.strip(_WS)]
        dup[i] = len(lines) - len(set(lines))
    codes = pd.factorize(np.array(words, dtype=object))[0] if words else np.empty(0, np.int64)
    doc = np.repeat(np.arange(len(texts)), n_words)
    rep = repeated_words(codes, doc, window)
    return {"n_words": n_words, "word_chars": chars, "n_symbols": symbols, "n_dup_lines": dup,
            "n_repeat_words": np.bincount(doc, weights=rep, minlength=len(texts)).astype(np.int64)}


_NOT_CONTINUED = bytes(b for b in range(256) if not 0x80 <= b < 0xC0)


def base_rules(docs: DataFrame, *, text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words;
    the text itself is not carried along."""
    ship(docs.sparkSession)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    keep = [c for c in docs.columns if c != text_col and c.lower() not in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(0).cast(pa.binary()).to_pylist()
            for lo, hi in text_slices(texts, _SLICE_BYTES):
                got = base_counts(texts[lo:hi], window)
                yield pa.RecordBatch.from_arrays([*(c.slice(lo, hi - lo) for c in b.columns[1:]), *(pa.array(got[n]) for n in names)],
                                                 names=[*keep, *names])

    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.select(*keep).schema.fields)
    return docs.select(text_col, *keep).mapInArrow(tidy(run), fields + ", ".join(f"{n} long" for n in names))


def line_limits(docs: DataFrame, *, max_docs: int = MAX_DOCS, ratio: float = RATIO, host_col: str = "source",
                text_col: str = "text") -> DataFrame:
    """(_qr_host, key, n_docs): lines in more distinct documents of their
    host than its limit."""
    text = F.col(text_col)
    rows = (docs.where(F.col(host_col).isNotNull() & text.isNotNull())
            .select(F.col(host_col).cast("string").alias("_qr_host"), text.alias("_qr_text"))
            .withColumn("_qr_norm", norm_line(F.replace(F.col("_qr_text"), F.lit("\n"), F.lit(" "))))
            .select("_qr_host", F.xxhash64("_qr_norm").alias("_qr_c1"), F.xxhash64(F.lit(1), "_qr_norm").alias("_qr_c2"),
                    F.array_distinct(F.array_compact(F.transform(lines_of(F.col("_qr_text")), line_key))).alias("_qr_keys")))
    distinct = rows.dropDuplicates(["_qr_host", "_qr_c1", "_qr_c2"]).select("_qr_host", "_qr_keys")
    distinct = materialize(distinct, "quality-lines")
    totals = distinct.groupBy("_qr_host").agg(F.count("*").alias("docs"))
    return (line_counts(distinct, "_qr_host", "_qr_keys").where(F.col("n_docs") > max_docs)
            .join(totals, "_qr_host").where(F.col("n_docs") > F.greatest(F.lit(float(max_docs)), F.lit(ratio) * F.col("docs")))
            .select("_qr_host", "key", "n_docs"))


def quality(docs: DataFrame, *, min_words: int = MIN_WORDS, max_repeat_percent: int = MAX_REPEAT_PERCENT,
            max_docs: int = MAX_DOCS, ratio: float = RATIO, min_share: float = MIN_SHARE,
            id_col: str = "doc_id", host_col: str = "source", text_col: str = "text") -> DataFrame:
    """Per document: the base counts, base_failed, words_left after the
    frequent lines are removed, depleted, kept."""
    bad = line_limits(docs, max_docs=max_docs, ratio=ratio, host_col=host_col, text_col=text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(host_col).cast("string").alias("_qr_host"), F.col(text_col).alias("_qr_text"))
    rows = with_host_lines(rows, bad.select("_qr_host", "key"), "_qr_host", "_qr_bad")
    # the removed lines' words: only rows whose host has frequent lines are split again
    def words(x):
        n = norm_line(x)
        return F.when(n == "", F.lit(0)).otherwise(F.length(n) - F.length(F.replace(n, F.lit(" "), F.lit(""))) + 1)

    gone = F.aggregate(F.filter(lines_of(F.col("_qr_text")), lambda x: F.coalesce(F.array_contains(F.col("_qr_bad"), line_key(x)), F.lit(False))),
                       F.lit(0), lambda a, x: a + words(x))
    rows = rows.select("doc_id", "_qr_text", F.when(F.size("_qr_bad") > 0, gone).otherwise(F.lit(0)).cast("long").alias("words_removed"))
    out = base_rules(rows, text_col="_qr_text")
    left = F.col("n_words") - F.col("words_removed")
    return (out.withColumn("base_failed", (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words")))
            .withColumn("depleted", (F.col("words_removed") > 0) & ((left < min_words) | (left < F.lit(min_share) * F.col("n_words"))))
            .withColumn("kept", ~F.col("base_failed") & ~F.col("depleted"))
            .select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "words_removed", "depleted", "kept"))
