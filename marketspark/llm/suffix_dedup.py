"""Exact substring dedup with a run-length index.

Every byte covered by a string of ``length`` bytes that also starts earlier
(in a smaller doc_id, or earlier in the same document) is removed.

A window of ``length`` bytes is named by its anchor, the gram of ``gram``
bytes in it with the smallest hash. Equal windows have equal anchors at the
same place, so all occurrences of a window meet when the texts around
anchors (their contexts: the windows an anchor names) are dealt by anchor:
1. each task of the scan finds its texts' anchors; of equal contexts only
   the task's first goes on, the others are copies of it;
2. dealt by anchor hash, again only the first of equal contexts goes on,
   and only where another context shares the anchor;
3. their bytes are fetched and, anchor groups in blocks, indexed by a
   run-compressed Burrows-Wheeler transform with sampled run ends, whose
   streamed matching statistics mark the windows that occur earlier.
An anchor group larger than a block (a hot passage with ever new
surroundings) is decided by an aggregate over its windows' hashes instead.

Anchors and contexts are compared by 64-bit hashes each; windows inside a
block byte by byte.

Defined results for odd input: null text is empty; null ids come last, rows
of one id are ordered by their text's hash (equal rows in any order); texts
shorter than a window lose nothing; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, ordered, release, ship, tidy
from .run_index import RunIndex

LENGTH = 100
GRAM = 32
BLOCK_BYTES = 1_500_000    # context bytes indexed at once
HOT_CONTEXTS = 100_000     # contexts of one anchor beyond which windows are hashed
_SEGMENT = 500_000         # text bytes hashed at once
_COMBINE = 500_000         # anchors a task combines at once
_IDX = np.uint64((1 << 22) - 1)
_TABLE = np.random.default_rng(5).integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(32))
        x = x * np.uint64(0xD6E8FEB86659FD93)
        x = x ^ (x >> np.uint64(32))
        x = x * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """Mixed polynomial hash of every gram of ``gram`` bytes."""
    parts: list[tuple[int, np.ndarray]] = []
    with np.errstate(over="ignore"):
        size, h, power = 1, _TABLE[data], _BASE
        while True:
            if gram & size:
                parts.append((size, h))
            if size * 2 > gram:
                break
            h = h[:len(h) - size] * power + h[size:]
            power = power * power
            size *= 2
        n = len(data) - gram + 1
        out = np.zeros(max(n, 0), dtype=np.uint64)
        at = 0
        for size, h in reversed(parts):
            out = out * _power(size) + h[at:at + len(out)]
            at += size
    return _mix(out)


def _power(k: int) -> np.uint64:
    return np.uint64(pow(int(_BASE), k, 2**64))


_INVERSE = pow(int(_BASE), -1, 2**64)
_powers: dict = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("p", ())) < n:
        with np.errstate(over="ignore"):
            for name, base in (("p", int(_BASE)), ("i", _INVERSE)):
                a = np.full(n, base, dtype=np.uint64)
                a[0] = 1
                _powers[name] = np.multiply.accumulate(a)
    return _powers["p"][:n], _powers["i"][:n]


def anchors(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int, gram: int):
    """Anchors of the windows that lie in the ranges [start, end) of data:
    arrays (range number, first window, number of windows, anchor hash,
    context hash). Ties of the hash go to the leftmost gram."""
    n = len(data)
    width = length - gram + 1
    none = np.empty(0, np.int64)
    if n < length:
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    h = gram_hashes(data, gram)
    key = (h & ~_IDX) | np.arange(len(h), dtype=np.uint64)
    size = 1
    low = key
    while size * 2 <= width:
        low = np.minimum(low[:len(low) - size], low[size:])
        size *= 2
    if size < width:
        low = np.minimum(low[:len(low) - (width - size)], low[width - size:])
    pick = (low & _IDX).astype(np.int64)              # per window start: its anchor
    owner = np.full(n, -1, dtype=np.int64)
    counts = np.maximum(ends - starts - length + 1, 0)
    at = np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))
    owner[at] = np.repeat(np.arange(len(starts)), counts)
    if not len(at):
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    a, r = pick[at], owner[at]
    new = np.concatenate([[True], (a[1:] != a[:-1]) | (r[1:] != r[:-1])])
    first = np.flatnonzero(new)
    p0 = at[first]
    m = np.diff(np.append(first, len(at)))
    power, inverse = _power_tables(n + 1)
    with np.errstate(over="ignore"):
        total = np.concatenate([[np.uint64(0)], np.cumsum(_TABLE[data] * power[:n], dtype=np.uint64)])
        ctx = (total[p0 + m + length - 1] - total[p0]) * inverse[p0]
        ctx = _mix(ctx ^ _mix((m * 256 + (a[first] - p0)).astype(np.uint64)))
    return r[first], p0, m, h[a[first]], ctx


def _segments(texts: list, length: int) -> Iterator[list[tuple[int, int, bytes]]]:
    """Batches of (row, byte offset, bytes): long texts are cut into pieces
    that overlap by length - 1, so every window is in exactly one."""
    batch, size = [], 0
    for i, t in enumerate(texts):
        if t is None or len(t) < length:
            continue
        for s in range(0, len(t) - length + 1, _SEGMENT):
            piece = t[s:s + _SEGMENT + length - 1]
            batch.append((i, s, piece))
            size += len(piece)
            if size >= _SEGMENT:
                yield batch
                batch, size = [], 0
    if batch:
        yield batch


def _runs(*keys: np.ndarray) -> np.ndarray:
    """True where a sorted row differs from the one before."""
    out = np.zeros(len(keys[0]), dtype=bool)
    out[:1] = True
    for k in keys:
        out[1:] |= k[1:] != k[:-1]
    return out


def _merged(ords: np.ndarray, p0: np.ndarray, m: np.ndarray):
    """Runs of windows [p0, p0 + m) with touching ones of a document joined."""
    o = np.lexsort((p0, ords))
    ords, p0, m = ords[o], p0[o], m[o]
    if not len(ords):
        return ords, p0, m
    new = np.ones(len(ords), dtype=bool)
    new[1:] = (ords[1:] != ords[:-1]) | (p0[1:] != p0[:-1] + m[:-1])
    first = np.flatnonzero(new)
    return ords[first], p0[first], np.add.reduceat(m, first)


_ROW = ["anchor", "ctx", "ord", "p0", "m"]
_ROW_SCHEMA = "anchor long, ctx long, ord long, p0 long, m long"


def _batch(anchor, ctx, ords, p0, m) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x).view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64))
                                       for x in (anchor, ctx, ords, p0, m)], names=_ROW)


def _firsts(anchor, ctx, ords, p0, m):
    """Split rows into the first of each (anchor, ctx) and the copies."""
    o = np.lexsort((p0, ords, ctx, anchor))
    anchor, ctx, ords, p0, m = anchor[o], ctx[o], ords[o], p0[o], m[o]
    first = _runs(anchor, ctx)
    return (anchor[first], ctx[first], ords[first], p0[first], m[first]), (ords[~first], p0[~first], m[~first])


def _marks(ords, p0, m) -> pa.RecordBatch:
    """Marked windows as rows: ctx 0 and a spread anchor; a context's m is
    positive, a mark's negative."""
    ords, p0, m = _merged(ords, p0, m)
    return _batch(_mix(ords.astype(np.uint64) ^ _mix(p0.astype(np.uint64))), np.zeros(len(ords), np.int64), ords, p0, -m)


def _scan_anchors(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        n = 0

        def flush():
            rows = [np.concatenate(x) for x in zip(*held)]
            held.clear()
            firsts, copies = _firsts(*rows)
            yield _batch(*firsts)
            yield _marks(*copies)

        for b in batches:
            ords = b.column(0).to_numpy(zero_copy_only=False)
            texts = b.column(1).cast(pa.binary()).to_pylist()
            for batch in _segments(texts, length):
                data = np.frombuffer(b"".join(x[2] for x in batch), dtype=np.uint8)
                ends = np.cumsum([len(x[2]) for x in batch])
                starts = np.concatenate([[0], ends[:-1]])
                r, p0, m, anchor, ctx = anchors(data, starts, ends, length, gram)
                row = np.array([x[0] for x in batch])
                offset = np.array([x[1] for x in batch])
                held.append((anchor.view(np.int64), ctx.view(np.int64), ords[row[r]], p0 - starts[r] + offset[r], m))
                n += len(r)
                if n >= _COMBINE:
                    yield from flush()
                    n = 0
        if held:
            yield from flush()
    return run


def _grouped(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.Table]:
    """Tables of whole anchor groups (rows come sorted by anchor) with about
    ``least`` rows or more."""
    held: list[pa.RecordBatch] = []
    n = 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n < least:
            continue
        t = pa.Table.from_batches(held)
        a = t.column("anchor").to_numpy()
        cut = int(np.searchsorted(a, a[-1]))
        if cut == 0:
            held = t.combine_chunks().to_batches()
            continue
        yield t.slice(0, cut)
        held = t.slice(cut).combine_chunks().to_batches()
        n = t.num_rows - cut
    if n and held:
        yield pa.Table.from_batches(held)


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for t in _grouped(batches, 150_000):
        cols = [t.column(c).to_numpy() for c in _ROW]
        mark = cols[4] < 0
        if mark.any():
            yield _batch(*(c[mark] for c in cols))
        if mark.all():
            continue
        firsts, copies = _firsts(*(c[~mark] for c in cols))
        if len(copies[0]):
            yield _marks(*copies)
        anchor = firsts[0]
        new = _runs(anchor)
        group = np.cumsum(new) - 1
        shared = np.bincount(group)[group] > 1
        yield _batch(*(c[shared] for c in firsts))


def _fetch(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[], [], [], [], []]
            for o, text, needs in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), b.column(2).to_pylist()):
                for x in needs:
                    p = x["p0"]
                    for c, v in zip(out, (x["anchor"], o, p, x["m"], text[p:p + x["m"] + length - 1])):
                        c.append(v)
                if len(out[0]) > 20_000:
                    yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in out[:4]), pa.array(out[4], pa.binary())], names=_CTX)
                    out = [[], [], [], [], []]
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in out[:4]), pa.array(out[4], pa.binary())], names=_CTX)
    return run


_CTX = ["anchor", "ord", "p0", "m", "bytes"]


def _index_blocks(length: int, block_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _grouped(batches, max(1, block_bytes // (length + 34))):
            t = t.sort_by([("ord", "ascending"), ("p0", "ascending")])
            texts = t.column("bytes").to_pylist()
            ords, p0 = t.column("ord").to_numpy(), t.column("p0").to_numpy()
            index = RunIndex(texts)
            at = np.flatnonzero(index.later_copies(length))
            ctx = np.searchsorted(index.start, at, side="right") - 1
            yield _marks(ords[ctx], p0[ctx] + (at - index.start[ctx]), np.ones(len(at), dtype=np.int64))
    return run


def _hash_windows(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[], [], [], []]
            for o, p, m, text in zip(*(b.column(i).to_pylist() for i in (1, 2, 3, 4))):
                for k in range(m):
                    d = hashlib.blake2b(text[k:k + length], digest_size=16).digest()
                    for c, v in zip(out, (int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True), o, p + k)):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["w1", "w2", "ord", "p0"])
    return run


def repeated_windows(docs: DataFrame, *, length: int = LENGTH, gram: int = GRAM, block_bytes: int = BLOCK_BYTES,
                     hot_contexts: int = HOT_CONTEXTS) -> DataFrame:
    """Marked windows (ord, p0, m): the windows of ``length`` bytes starting
    at p0 .. p0 + m - 1 of document ord also start earlier. docs: ordered()."""
    spark = docs.sparkSession
    ship(spark)
    found = docs.select("ord", "text").mapInArrow(tidy(_scan_anchors(length, gram)), _ROW_SCHEMA)
    met = materialize(found.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(tidy(_meet), _ROW_SCHEMA), "suffix-met")
    release(spark)
    marks = met.where("m < 0").select("ord", "p0", (-F.col("m")).alias("m"))
    need = met.where("m > 0")
    hot = materialize(need.groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") > hot_contexts).select("anchor"), "suffix-hot")
    wanted = need.groupBy("ord").agg(F.collect_list(F.struct("anchor", "p0", "m")).alias("needs"))
    ctx = (docs.select("ord", "text").join(wanted, "ord").select("ord", "text", "needs")
           .mapInArrow(tidy(_fetch(length)), "anchor long, ord long, p0 long, m long, bytes binary"))
    any_hot = not hot.isEmpty()
    if any_hot:
        ctx = materialize(ctx, "suffix-contexts")
        each = ctx.join(hot, "anchor", "left_semi").select(*_CTX).mapInArrow(tidy(_hash_windows(length)), "w1 long, w2 long, ord long, p0 long")
        each = materialize(each, "suffix-windows")
        first = each.groupBy("w1", "w2").agg(F.min(F.struct("ord", "p0")).alias("f"))
        marks = marks.unionByName(each.join(first, ["w1", "w2"]).where(F.struct("ord", "p0") > F.col("f"))
                                  .select("ord", "p0", F.lit(1).cast("long").alias("m")))
        ctx = ctx.join(hot, "anchor", "left_anti").select(*_CTX)
    indexed = materialize(ctx.repartition("anchor").sortWithinPartitions("anchor", "ord", "p0")
                          .mapInArrow(tidy(_index_blocks(length, block_bytes)), _ROW_SCHEMA), "suffix-indexed")
    release(spark)
    return marks.unionByName(indexed.select("ord", "p0", (-F.col("m")).alias("m")))


def remove_repeats(docs: DataFrame, *, length: int = LENGTH, with_kept: bool = False, id_col: str = "doc_id",
                   text_col: str = "text", **params) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256 (of
    the remaining bytes) and, with_kept, the remaining bytes themselves."""
    rows = ordered(docs, id_col, text_col)
    marks = repeated_windows(rows, length=length, **params)
    per = marks.groupBy("ord").agg(F.collect_list(F.struct("p0", "m")).alias("marks"))
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * with_kept

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[], [], [], [], []]
            for text, spans in zip(b.column(1).cast(pa.binary()).to_pylist(), b.column(2).to_pylist()):
                text = text or b""
                kept, removed, n_spans = text, 0, 0
                if spans:
                    at, removed, parts = 0, 0, []
                    lo = hi = -1
                    for p, m in sorted((x["p0"], x["m"]) for x in spans):
                        if p > hi:
                            if hi >= 0:
                                parts.append(text[at:lo])
                                removed += hi - lo
                                n_spans += 1
                                at = hi
                            lo, hi = p, p + m - 1 + length
                        else:
                            hi = max(hi, p + m - 1 + length)
                    parts.append(text[at:lo])
                    parts.append(text[hi:])
                    removed += hi - lo
                    n_spans += 1
                    kept = b"".join(parts)
                for c, v in zip(out, (len(text), removed, n_spans, hashlib.sha256(kept).hexdigest(), kept)):
                    c.append(v)
            arrays = [b.column(0), *(pa.array(c, pa.int64()) for c in out[:3]), pa.array(out[3], pa.string())]
            if with_kept:
                arrays.append(pa.array(out[4], pa.binary()))
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return (rows.join(per, "ord", "left").select("doc_id", "text", "marks")
            .mapInArrow(tidy(run), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_kept))
