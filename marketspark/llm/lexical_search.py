"""Ranked lexical search by scanning documents with an Aho-Corasick automaton
of all item terms; there is no index of the documents.

A term is a maximal stretch of ASCII letters, digits and characters beyond
ASCII, with A-Z lowered. Texts are scanned as UTF-8 bytes: one byte table
lowers A-Z and turns every other ASCII byte into a space, so a term stands
between two spaces. The automaton holds every distinct term of the items
between such guards, hence it finds whole terms only; each of its outputs is
a term number, and a table maps term numbers to the items that hold them.

Two scans of the same texts: the first counts documents, their terms and, for
every item term, the documents that hold it (one row per term and task
leaves a task); the second scores. A task adds a document's term scores up
per item and keeps the best k documents of every item, so at most k rows per
item leave a task, and Spark ranks those.

The automaton travels to the tasks, so its size is checked: items are dealt,
in the order of their ids, to automatons of at most AUTOMATON_BYTES of terms
and AUTOMATON_PAIRS (term, item) pairs each; more items mean more scans, not a
larger automaton. Item texts reach the driver in such blocks, one at a time.

Defined results for odd input: a null text (document or item) has no term, so
it is never found and finds nothing; documents with a null id take part, after
all others among equal scores; rows with the same document id are separate
documents, each with its own rank; rows with the same item id are one item
with the terms of all; rows with a null item id are one item, too. Items
without terms, or without any document of positive score, return no row, and
empty tables return no rows. A text of any length is scanned whole. Equal
scores are ranked by ascending document id. Only the named columns are read,
so other columns may have any name.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ragged, ship, tidy

TOP_K = 10
AUTOMATON_BYTES = 4_000_000     # bytes of distinct terms of one automaton
AUTOMATON_PAIRS = 1_000_000     # (term, item) pairs of one automaton
_SCORES = 2_000_000             # (document, item) scores held at once

#: term bytes: 0-9 A-Z a-z and every byte beyond ASCII; A-Z are lowered
_TERM_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms_of(text: bytes | str | None) -> list[bytes]:
    """The terms of a text, in order, with repeats."""
    raw = text.encode("utf-8") if isinstance(text, str) else text or b""
    return raw.translate(_TERM_BYTES).split()


class TermAutomaton:
    """Counts given terms in texts in one pass over their bytes."""

    def __init__(self, terms: list[bytes]):
        import ahocorasick
        self._machine = ahocorasick.Automaton()
        for i, t in enumerate(terms):
            self._machine.add_word(f" {t.decode('latin-1')} ", i)
        if terms:
            self._machine.make_automaton()
        self.empty = not terms

    def count(self, text: bytes) -> tuple[int, Counter]:
        """Number of all terms of the text, and occurrences by term number."""
        guarded = b" " + text.translate(_TERM_BYTES) + b" "
        n = len(guarded.split())
        if self.empty or not n:
            return n, Counter()
        # guards are shared by neighbours: every match ends at its right guard
        return n, Counter([i for _, i in self._machine.iter(guarded.decode("latin-1"))])


class _Block:
    """A bounded block of items: their terms, and per term its items."""

    def __init__(self, items: list[tuple[int | None, set[bytes]]]):
        self.items = [i for i, _ in items]
        self.terms = sorted(set().union(*(t for _, t in items)))
        number = {t: k for k, t in enumerate(self.terms)}
        holders: list[list[int]] = [[] for _ in self.terms]
        for at, (_, terms) in enumerate(items):
            for t in terms:
                holders[number[t]].append(at)
        self.held_by = np.array([i for h in holders for i in sorted(h)], dtype=np.int64)
        self.n_items = np.array([len(h) for h in holders], dtype=np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.n_items)])[:-1].astype(np.int64)


def _blocks(items: DataFrame, id_col: str, text_col: str, max_bytes: int, max_pairs: int) -> Iterator[_Block]:
    """Items in the order of their ids, cut into blocks of bounded size."""
    held: dict[int | None, set[bytes]] = {}
    size = pairs = 0
    rows = items.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).alias("text")).orderBy(F.col("item_id").asc_nulls_last())
    for row in rows.toLocalIterator():
        terms = set(terms_of(row.text))
        new = terms - held.get(row.item_id, set())
        if held and row.item_id not in held and (size + sum(map(len, new)) > max_bytes or pairs + len(new) > max_pairs):
            yield _Block(list(held.items()))
            held, size, pairs = {}, 0, 0
        held.setdefault(row.item_id, set()).update(new)
        size, pairs = size + sum(map(len, new)), pairs + len(new)
    if held:
        yield _Block(list(held.items()))


_worker: dict = {}


def _automaton(terms: list[bytes], key: str) -> TermAutomaton:
    """The worker's automaton for these terms, built once per worker."""
    if _worker.get("key") != key:
        _worker["key"], _worker["automaton"] = key, TermAutomaton(terms)
    return _worker["automaton"]


def _counted(batch: pa.RecordBatch, machine: TermAutomaton) -> Iterator[tuple[int | None, int, Counter]]:
    """(doc id, number of terms, occurrences) of a batch's documents that
    hold a term; texts leave Arrow one at a time."""
    texts = batch.column(1).cast(pa.binary())
    for d, t in zip(batch.column(0).to_pylist(), texts):
        text = t.as_py()
        if text:
            n, tf = machine.count(text)
            if n:
                yield d, n, tf


def _statistics(docs: DataFrame, block: _Block, key: str) -> tuple[int, int, np.ndarray]:
    """Documents with a term, all their terms, and per term of the block the
    documents that hold it."""
    terms = block.terms

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = _automaton(terms, key)
        n_docs = n_terms = 0
        df: Counter = Counter()
        for batch in batches:
            for _, n, tf in _counted(batch, machine):
                n_docs += 1
                n_terms += n
                df.update(tf.keys())
        got = [(-2, n_docs), (-1, n_terms), *df.items()]
        yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in got], pa.int64()), pa.array([c for _, c in got], pa.int64())], names=["term", "c"])

    rows = docs.mapInArrow(tidy(run), "term long, c long").groupBy("term").agg(F.sum("c").alias("c")).collect()   # one row per term of the block
    count = {r["term"]: r["c"] for r in rows}
    return count.get(-2, 0), count.get(-1, 0), np.array([count.get(t, 0) for t in range(len(terms))], dtype=np.int64)


def weights(n_docs: int, df: np.ndarray) -> np.ndarray:
    """floor(1000 * ln((2 N + 2) / (2 df + 1))) of every term."""
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(d) + 1))) for d in df], dtype=np.int64)


def length_norm(n: int, n_docs: int, n_terms: int) -> int:
    return 100 - 90 + (90 * n * n_docs) // n_terms


class _Best:
    """The k best documents of every item so far."""

    def __init__(self, n_items: int, k: int):
        self.k = k
        self.floor = np.zeros(n_items, dtype=np.int64)      # a document below it cannot enter
        self.rows = pd.DataFrame({"at": np.empty(0, np.int64), "doc": np.empty(0, np.int64), "null": np.empty(0, bool), "score": np.empty(0, np.int64)})

    def add(self, scores: np.ndarray, ids: list) -> None:
        d, at = np.nonzero((scores > 0) & (scores >= self.floor))
        if len(d) == 0:
            return
        got = pd.DataFrame({"at": at, "doc": np.array([0 if i is None else i for i in ids], dtype=np.int64)[d],
                            "null": np.array([i is None for i in ids], dtype=bool)[d], "score": scores[d, at]})
        both = pd.concat([self.rows, got], ignore_index=True) if len(self.rows) else got
        both = both.sort_values(["at", "score", "null", "doc"], ascending=[True, False, True, True], kind="stable")
        both = both[both.groupby("at").cumcount() < self.k]
        self.rows = both
        full = both.groupby("at")["score"].agg(["size", "min"])
        full = full[full["size"] == self.k]
        self.floor[full.index.to_numpy()] = full["min"].to_numpy()


def _candidates(docs: DataFrame, block: _Block, key: str, n_docs: int, n_terms: int, df: np.ndarray, k: int) -> DataFrame:
    """(item_id, doc_id, score): every task's best k documents of each item."""
    terms, held_by, per_term, first, items = block.terms, block.held_by, block.n_items, block.first, block.items
    n_items = len(items)
    w = weights(n_docs, df)
    at_once = max(1, _SCORES // n_items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = _automaton(terms, key)
        best = _Best(n_items, k)
        ids: list = []
        term: list[int] = []
        tf: list[int] = []
        lens: list[int] = []
        norm: list[int] = []

        def score() -> None:
            of_doc = np.repeat(np.arange(len(ids)), lens)
            t, c = np.array(term, dtype=np.int64), np.array(tf, dtype=np.int64)
            part = w[t] * ((1_000_000_000 * c) // (1000 * c + 8 * np.array(norm, dtype=np.int64)[of_doc]))
            many = per_term[t]
            flat = np.zeros(len(ids) * n_items, dtype=np.int64)
            np.add.at(flat, np.repeat(of_doc * n_items, many) + held_by[ragged(first[t], many)], np.repeat(part, many))
            best.add(flat.reshape(len(ids), n_items), ids)
            for x in (ids, term, tf, lens, norm):
                x.clear()

        for batch in batches:
            for d, n, counts in _counted(batch, machine):
                if counts:
                    ids.append(d)
                    term += counts.keys()
                    tf += counts.values()
                    lens.append(len(counts))
                    norm.append(length_norm(n, n_docs, n_terms))
                    if len(ids) >= at_once or len(term) >= _SCORES:
                        score()
        if ids:
            score()
        r = best.rows
        yield pa.RecordBatch.from_arrays([pa.array([items[i] for i in r["at"].tolist()], pa.int64()),
                                          pa.array(r["doc"].to_numpy(), pa.int64(), mask=r["null"].to_numpy()),
                                          pa.array(r["score"].to_numpy(), pa.int64())], names=["item_id", "doc_id", "score"])

    return docs.mapInArrow(tidy(run), "item_id long, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, *, k: int = TOP_K, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
           item_text_col: str = "text", max_bytes: int = AUTOMATON_BYTES, max_pairs: int = AUTOMATON_PAIRS) -> DataFrame:
    """The k best documents of every item: item_id, rank, doc_id, score."""
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("text IS NOT NULL")
    parts = []
    for b, block in enumerate(_blocks(items, item_col, item_text_col, max_bytes, max_pairs)):
        if not block.terms:
            continue
        key = f"{spark.sparkContext.applicationId}-{id(block)}-{b}-{hash(tuple(block.terms))}"
        n_docs, n_terms, df = _statistics(rows, block, key)
        if n_docs == 0:
            break
        parts.append(_candidates(rows, block, key, n_docs, n_terms, df, k))
    if not parts:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    order = Window.partitionBy("item_id").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    best = reduce(DataFrame.unionByName, parts).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.select("item_id", "rank", "doc_id", "score")
