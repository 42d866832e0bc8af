"""Periodic runs of words, found in tiles whose size grows with the period.

A run is a stretch of words with smallest period q (words q apart are equal),
at least max(MIN_WORDS, MIN_PERIODS * q) words long, that no neighbouring word
extends. Periods are taken in octaves: 1 to 7, then [8, 16), [16, 32) and so
on. For the octave that starts at S (the first counts as S = 8), every S-th
place of a document is a boundary. A run with a period of the octave holds two
boundaries or more, and at the first of them at least S more words repeat one
period on.

1. A scan over the documents splits and numbers the words, and explodes each
   document into overlapping tiles per octave. A tile is a bounded stretch of
   boundaries with S words before and 3 S after the last. Only boundaries where the next 8 words are
   equal to those one period of the octave on (by a rolling hash of 8 words)
   need solving, and only tiles that hold one leave the task; all others
   cannot hold a run. Documents without any tile are finished there.
2. Tiles are dealt by (document, octave, tile), so that a long document's
   tiles are solved apart. In a tile, the Z-function of the words after a
   boundary gives how far they repeat q words on, and that of the reversed
   words before it how far back: the fragment of the q-periodic stretch around
   the boundary. A period whose stretch also has a smaller period p over p + q
   words is a multiple of that one's, and is left out.
3. Fragments are shuffled by (document, period) and touching ones stitched. Those long enough are collected per document and, on the
   words, freed of periods that are not the smallest.

Tiles, their fragments and the texts of documents with tiles are all that is
shuffled; a document's words outside step 1 and 3 never meet in one task, and
in those it is one row, as in its table.

Defined results for odd input: null and wordless texts have no words and no
runs, their collapsed text is empty; null ids stay null; rows with repeated
ids are separate documents; an empty table gives no rows; texts of any length
are searched whole; ties for the strongest run go to the smallest start, then
period. Only the named columns are read, so other columns may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, ordered, ship, text_slices, tidy

MIN_WORDS = 24
MIN_PERIODS = 3
GRAM = 8                        # words of the rolling hash; the first octave's boundaries are so far apart
TILE_WORDS = 4_096              # words of boundaries in a tile, or 4 S if more
_SLICE_BYTES = 4_000_000        # text that is split at once

_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_MIXERS = [np.uint64(pow(0xD1342543DE82EF95, i + 1, 1 << 64)) for i in range(GRAM)]


def _grams(ids: np.ndarray) -> np.ndarray:
    """A hash of the GRAM words from each place on (the array is padded)."""
    x = ids.astype(np.uint64) * _FACTOR
    x ^= x >> np.uint64(29)
    x *= _MIXERS[0]
    x ^= x >> np.uint64(32)
    n = len(ids) - GRAM + 1
    out = np.zeros(max(n, 0), dtype=np.uint64)
    for i, m in enumerate(_MIXERS):
        out += x[i:i + n] * m
    return out


def _octaves(longest: int) -> Iterator[tuple[int, int, int]]:
    """(boundary distance, first period, last period)."""
    yield GRAM, 1, GRAM - 1
    step = GRAM
    while MIN_PERIODS * step <= longest:
        yield step, step, 2 * step - 1
        step *= 2


def _open_boundaries(grams: np.ndarray, step: int, low: int) -> np.ndarray:
    """Boundaries (multiples of step) whose gram occurs again one period of
    the octave on."""
    rows = -(-len(grams) // step)
    padded = np.zeros(rows * step, dtype=np.uint64)
    padded[:len(grams)] = grams
    table = padded.reshape(rows, step)
    if low < step:              # the first octave: periods inside a row
        return np.flatnonzero((table[:, 1:] == table[:, :1]).any(axis=1)) * step
    return np.flatnonzero((table[1:] == table[:-1, :1]).any(axis=1)) * step


def tiles_of(texts: list[list[bytes]]) -> list[list[tuple[int, int, int, int, list[int], np.ndarray]]]:
    """Per document the tiles to solve: (step, first period, tile number,
    place of its first word, boundaries from there, word numbers)."""
    order = sorted(range(len(texts)), key=lambda i: len(texts[i]))
    number: dict[bytes, int] = dict.fromkeys(w for t in texts for w in t)
    number = dict(zip(number, range(len(number))))
    sizes = np.array([len(texts[i]) for i in order], dtype=np.int64)
    start = np.concatenate([[0], np.cumsum(sizes + 1)])             # a word of its own ends each document
    ids = np.empty(int(start[-1]) + GRAM, dtype=np.int64)
    ids[start[1:] - 1] = len(number) + np.arange(len(order))
    ids[start[-1]:] = len(number) + len(order) + np.arange(GRAM)
    for at, i in enumerate(order):
        ids[start[at]:start[at + 1] - 1] = np.fromiter(map(number.__getitem__, texts[i]), np.int64, len(texts[i]))
    grams = _grams(ids)
    out: list[list] = [[] for _ in texts]
    for step, low, high in _octaves(int(sizes[-1]) if len(sizes) else 0):
        first = int(np.searchsorted(sizes, max(MIN_WORDS, MIN_PERIODS * low)))      # shorter ones hold no such run
        if first == len(order):
            break
        base = int(start[first])
        found = _open_boundaries(grams[base:], step, low) + base
        if len(found) == 0:
            continue
        of_doc = np.searchsorted(start, found, side="right") - 1
        tile = (found - start[of_doc]) // max(TILE_WORDS, 4 * step)
        cut = np.flatnonzero((np.diff(of_doc) != 0) | (np.diff(tile) != 0)) + 1
        for part, d, t in zip(np.split(found, cut), of_doc[np.concatenate([[0], cut])].tolist(), tile[np.concatenate([[0], cut])].tolist()):
            lo = max(int(start[d]), int(part[0]) - step)
            hi = min(int(start[d + 1]) - 1, int(part[-1]) + 3 * step + GRAM)
            out[order[d]].append((step, low, t, lo - int(start[d]), (part - lo).tolist(), ids[lo:hi].astype(np.int32)))
    return out


def z_function(s: list[int]) -> list[int]:
    """Length of the longest common prefix of s and of s from each place on."""
    n = len(s)
    z = [0] * n
    left = right = 0
    for i in range(1, n):
        k = min(right - i, z[i - left]) if i < right else 0
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


def solve_tile(step: int, low: int, place: int, boundaries: list[int], ids: list[int]) -> list[tuple[int, int, int]]:
    """(period, lo, hi): stretches [lo, hi) of the document whose words equal
    those one period on, around the tile's boundaries, joined where they touch."""
    high = step - 1 if low < step else 2 * step - 1
    reach: dict[int, list[list[int]]] = {}
    for b in boundaries:
        after = ids[b:b + 3 * step + GRAM]
        z = z_function(after)
        top = min(high, len(after) - 1)
        periods = [q for q in range(low, top + 1) if z[q] >= GRAM]
        if not periods:
            continue
        back = ids[max(0, b - step):b][::-1]
        m = len(back)
        zb = z_function([*back, -1, *ids[max(0, b - step):b + top][::-1]])     # -1: no word
        for q in periods:
            if _has_smaller(z, q):
                continue
            # reversed words before b + q stand after the top - q words behind them
            left = zb[m + 1 + top - q]
            lo, hi = place + b - left, place + b + z[q]
            spans = reach.setdefault(q, [])
            if spans and lo <= spans[-1][1]:
                spans[-1][1] = max(spans[-1][1], hi)
            else:
                spans.append([lo, hi])
    return [(q, lo, hi) for q, spans in reach.items() for lo, hi in spans]


def _has_smaller(z: list[int], q: int) -> bool:
    """The words after the boundary have a period p < q over p + q words,
    and q, too: then both are multiples of one smaller period, and so is the
    whole stretch of period q."""
    return any(z[p] >= q and z[q] >= p for p in range(1, q))


def _primitive(words: list, start: int, q: int) -> bool:
    """No proper divisor of q is a period of the run that starts there."""
    unit = words[start:start + q]
    rest, p, divisors = q, 2, []
    while p * p <= rest:
        if rest % p == 0:
            divisors.append(p)
            while rest % p == 0:
                rest //= p
        p += 1
    if rest > 1:
        divisors.append(rest)
    return not any(unit[q // d:] == unit[:-(q // d)] for d in divisors)


def _numbered(texts: list[list[bytes]], ords: list, docs: list) -> Iterator[tuple]:
    """A row (kind, ord, doc_id, n, sha, text, step, low, tile, place,
    boundaries, words) for every document, then its tiles."""
    for o, d, words, tiles in zip(ords, docs, texts, tiles_of(texts)):
        joined = b" ".join(words)
        yield ("text" if tiles else "done", o, d, len(words), None if tiles else hashlib.sha256(joined).hexdigest(), joined if tiles else None,
               None, None, None, None, None, None)
        for step, low, t, place, bounds, ids in tiles:
            yield ("tile", o, None, None, None, None, step, low, t, place, bounds, ids)


_SCAN = pa.schema([("kind", pa.string()), ("ord", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int64()), ("sha", pa.string()), ("words", pa.string()),
                   ("step", pa.int64()), ("low", pa.int64()), ("tile", pa.int64()), ("place", pa.int64()), ("bounds", pa.list_(pa.int32())), ("ids", pa.list_(pa.int32()))])
_SCAN_DDL = ("kind string, ord long, doc_id long, n long, sha string, words string, step long, low long, tile long, place long, "
             "bounds array<int>, ids array<int>")


def _scan(docs: DataFrame, edit: Callable[[int | None, list[bytes]], list[bytes]] | None) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ords, ids = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            texts = batch.column(2).cast(pa.binary()).to_pylist()
            for lo, hi in text_slices(texts, _SLICE_BYTES):
                words = [(t or b"").split() for t in texts[lo:hi]]
                if edit is not None:
                    words = [edit(d, w) for d, w in zip(ids[lo:hi], words)]
                rows, held = [], 0
                for row in _numbered(words, ords[lo:hi], ids[lo:hi]):
                    rows.append(row)
                    held += len(row[-1]) * 4 if row[-1] is not None else len(row[5] or b"")
                    if held >= _SLICE_BYTES:
                        yield _batch(rows)
                        rows, held = [], 0
                if rows:
                    yield _batch(rows)

    return docs.mapInArrow(tidy(run), _SCAN_DDL)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows))
    cols[5] = [None if w is None else w.decode("utf-8") for w in cols[5]]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _SCAN)], schema=_SCAN)


def _fragments(tiles: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got: list[tuple[int, int, int, int]] = []
            for o, step, low, place, bounds, ids in zip(*(c for c in batch.columns)):
                o = o.as_py()
                got += [(o, q, lo, hi) for q, lo, hi in solve_tile(step.as_py(), low.as_py(), place.as_py(), bounds.as_py(), ids.as_py())]
            if got:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*got)], names=["ord", "period", "lo", "hi"])

    return tiles.mapInArrow(tidy(run), "ord long, period long, lo long, hi long")


def _stitched(fragments: DataFrame) -> DataFrame:
    """(ord, start, length, period) of maximal stretches long enough."""
    w = Window.partitionBy("ord", "period").orderBy("lo", "hi")
    reached = F.max("hi").over(w.rowsBetween(Window.unboundedPreceding, -1))
    part = F.sum(F.when(F.col("lo") <= F.col("reached"), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    joined = (fragments.withColumn("reached", reached).withColumn("part", part)
              .groupBy("ord", "period", "part").agg(F.min("lo").alias("start"), F.max("hi").alias("stop")))
    length = F.col("stop") - F.col("start") + F.col("period")
    return (joined.select("ord", "start", length.alias("length"), "period")
            .where(F.col("length") >= F.greatest(F.lit(MIN_WORDS), MIN_PERIODS * F.col("period"))))


_RUNS = "array<struct<start:long,length:long,period:long>>"


def _finished(texts: DataFrame) -> DataFrame:
    """Runs with their smallest period, and the collapsed text."""
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for o, d, n, words, runs in zip(*(c for c in batch.columns)):
                split = words.as_py().encode("utf-8").split(b" ")
                kept = sorted({(r["start"], r["length"], r["period"]) for r in runs.as_py() or []}, key=lambda r: (r[0], r[2]))
                kept = [r for r in kept if _primitive(split, r[0], r[2])]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([o.as_py()], pa.int64()), pa.array([d.as_py()], pa.int64()), pa.array([n.as_py()], pa.int64()),
                     pa.array([[dict(zip(("start", "length", "period"), r)) for r in kept]], run_type),
                     pa.array([b" ".join(collapse(split, kept)).decode("utf-8")], pa.string())], names=["ord", "doc_id", "n_words", "runs", "collapsed"])

    return texts.mapInArrow(tidy(run), f"ord long, doc_id long, n_words long, runs {_RUNS}, collapsed string")


def collapse(words: list, runs: list[tuple[int, int, int]]) -> list:
    """The words that no run holds after its first period."""
    if not runs:
        return words
    gone = np.zeros(len(words) + 1, dtype=np.int64)
    for start, length, period in runs:
        gone[start + period] += 1
        gone[start + length] -= 1
    keep = np.cumsum(gone[:-1]) == 0
    return [words[i] for i in np.flatnonzero(keep).tolist()]


def _strongest(runs):
    """The run of greatest exact length / period (long columns; a / b > c / d
    as a * d > c * b), first start and period among equals."""
    def better(a, b):
        x, y = a["length"] * b["period"], b["length"] * a["period"]
        return (x > y) | ((x == y) & ((a["start"] < b["start"]) | ((a["start"] == b["start"]) & (a["period"] < b["period"]))))
    return F.aggregate(F.slice(runs, 2, F.greatest(F.size(runs) - 1, F.lit(0))), F.element_at(runs, 1), lambda best, r: F.when(better(r, best), r).otherwise(best))


def find_runs(docs: DataFrame, *, edit: Callable[[int | None, list[bytes]], list[bytes]] | None = None,
              id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Two tables: (ord, doc_id, n_words, runs, collapsed) of the documents
    with a possible run (runs may be empty), and (ord, doc_id, n_words, sha) of
    those without one, sha being that of their words joined by spaces. edit
    may change a document's words before the search."""
    ship(docs.sparkSession)
    rows = materialize(_scan(ordered(docs, id_col, text_col), edit), "periods_scan")
    tiles = rows.where("kind = 'tile'").select("ord", "step", "low", "place", "bounds", "ids", "tile")
    # a fixed number of tasks: the work of a tile is not in its bytes, by which adaptive tasks are joined
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    dealt = tiles.repartition(tasks, "ord", "step", "tile").select("ord", "step", "low", "place", "bounds", "ids")
    runs = (_stitched(_fragments(dealt)).groupBy("ord")
            .agg(F.collect_list(F.struct("start", "length", "period")).alias("runs")))
    texts = rows.where("kind = 'text'").select("ord", "doc_id", "n", "words").join(runs, "ord", "left")
    return (_finished(texts.select("ord", "doc_id", "n", "words", F.col("runs").cast(_RUNS).alias("runs"))),
            rows.where("kind = 'done'").select("ord", "doc_id", F.col("n").alias("n_words"), "sha"))


def run_report(docs: DataFrame, **options) -> DataFrame:
    """Per document: number of runs, the strongest run, and digests of all
    runs and of the collapsed text."""
    found, plain = find_runs(docs, **options)
    best = F.when(F.size("runs") > 0, _strongest(F.col("runs")))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    text = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    found = (found.withColumn("best", best).withColumn("listed", text)
             .select("doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
                     F.expr("1000 * best.length div best.period").cast("long").alias("exponent_milli"),
                     F.sha2(F.col("listed").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256")))
    none = F.lit(None).cast("long")
    plain = plain.select("doc_id", F.lit(0).cast("long").alias("n_runs"), none.alias("start"), none.alias("length"), none.alias("period"),
                         none.alias("exponent_milli"), F.lit(hashlib.sha256(b"").hexdigest()).alias("runs_sha256"), F.col("sha").alias("collapsed_sha256"))
    return found.unionByName(plain)
