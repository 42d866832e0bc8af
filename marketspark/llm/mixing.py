"""Mixing sources to target weights.

Documents of a source are packed, in hash-dealt streams, into blocks of a
fixed number of words. Each output shard draws how many of its slots every
source fills (a multinomial draw conditioned on the exact totals, so the
targets are met). A source's slots are mapped through a pseudorandom
permutation of its block indices, one permutation per pass, and the drawn
slots are joined with the blocks by (source, index).

Defined results for odd input: null text has size 0; null source is a
source of its own, sorted last; documents without words take nothing;
repeated rows are separate documents; an empty table gives no rows. Extra
columns pass through untouched; working columns are prefixed ``_mx_``.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize, ship, tidy, with_word_count

BLOCK_WORDS = 128          # words per block
SHARD_SLOTS = 4096         # blocks per output shard
CHUNK_WORDS = 1_000_000    # words per packing stream on average (bounds one window group)
WEIGHT_CYCLE = (3, 1, 2)   # weights of the sorted sources, repeating
SHARE = 1.5                # the mix's size as a share of all sizes
MAX_PASSES = 2             # no source gives more than this many times its size
SEED = 20240607
#: numpy's hypergeometric draw takes populations below this; larger ones are drawn by _hypergeometric
_DRAW_LIMIT = 900_000_000


def water_fill(sizes: np.ndarray, weights: np.ndarray, total: float, cap: float) -> np.ndarray:
    """Targets proportional to weights that sum to total, none above
    cap * size: the excess of capped sources is reshared by weight among
    the others until none is above."""
    sizes = np.asarray(sizes, dtype=np.float64)
    weights = np.asarray(weights, dtype=np.float64)
    target = np.zeros(len(sizes))
    open_ = sizes > 0
    left = float(total)
    while open_.any() and left > 0:
        share = np.where(open_, weights, 0.0)
        want = left * share / share.sum()
        over = open_ & (want > cap * sizes)
        if not over.any():
            target[open_] = want[open_]
            break
        target[over] = cap * sizes[over]
        left -= float(target[over].sum())
        open_ &= ~over
    return target


def _log_ways(good: int, bad: int, n: int, k: int) -> float:
    """log of the number of ways to draw k of good and n - k of bad, but for
    a constant."""
    return -(math.lgamma(k + 1) + math.lgamma(good - k + 1) + math.lgamma(n - k + 1) + math.lgamma(bad - n + k + 1))


def _hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """How many of n draws without replacement are good, for populations of
    any size: ratio of uniforms around the mode, under a table mountain hat
    whose width is the standard deviation times a constant (the hat of
    Stadlober's ratio-of-uniforms method for unimodal counts)."""
    low, high = max(0, n - bad), min(n, good)
    if low == high:
        return low
    total = good + bad
    mean = n * good / total
    var = mean * (bad / total) * ((total - n) / max(1, total - 1))
    if var < 100:       # few of one kind: one draw after the other is exact and short enough
        return _few(rng, good, bad, n)
    top = min(high, max(low, (n + 1) * (good + 1) // (total + 2)))
    peak = _log_ways(good, bad, n, top)
    width = math.sqrt(8 / math.e * (var + 0.5)) + 3 - 2 * math.sqrt(3 / math.e)
    while True:
        u, v = rng.random(), rng.random()
        if u == 0.0:
            continue
        k = math.floor(mean + 0.5 + width * (v - 0.5) / u)
        if low <= k <= high and 2 * math.log(u) <= _log_ways(good, bad, n, k) - peak:
            return k


def _few(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """A draw of small variance: the smallest of the four margins is drawn
    one by one from what is left."""
    total = good + bad
    sides = {"good": good, "bad": bad, "drawn": n, "left": total - n}
    side = min(sides, key=sides.get)
    size, other = sides[side], (n if side in ("good", "bad") else good)
    hit = 0
    for i in range(size):       # i of the side are dealt, hit of them fell on the other side
        hit += rng.random() * (total - i) < other - hit
    return {"good": hit, "bad": n - hit, "drawn": hit, "left": good - hit}[side]


def _split_counts(rng: np.random.Generator, counts: np.ndarray, n: int) -> np.ndarray:
    """Counts per source among n draws without replacement."""
    total = int(counts.sum())
    if total < _DRAW_LIMIT:
        return rng.multivariate_hypergeometric(counts, n, method="marginals")
    out = np.zeros_like(counts)
    for i, c in enumerate(counts.tolist()):
        out[i] = _hypergeometric(rng, c, total - c, n)
        total, n = total - c, n - int(out[i])
    return out


def draw_shard(shard: int, shards: int, slots: np.ndarray, shard_slots: int, seed: int):
    """Slots of each source in one output shard and the source's slots in
    the shards before it. Walks a binary tree over the shards: every node
    splits its source counts between its halves by one seeded draw without
    replacement, so all shards agree without talking to each other and the
    counts add up to the totals exactly."""
    counts = np.asarray(slots, dtype=np.int64).copy()
    before = np.zeros_like(counts)
    lo, hi = 0, shards
    while hi - lo > 1:
        mid = (lo + hi) // 2
        n_left = min((mid - lo) * shard_slots, int(counts.sum()))
        left = _split_counts(np.random.default_rng([seed, lo, hi]), counts, n_left)
        if shard < mid:
            counts, hi = left, mid
        else:
            before, counts, lo = before + left, counts - left, mid
    return counts, before


def _mix64(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64)
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


def permute(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """Keyed pseudorandom permutation of [0, n): a four-round Feistel
    network over the next even power of two, walked until inside [0, n)."""
    if n <= 1:
        return np.zeros_like(np.asarray(index, dtype=np.int64))
    half = max(1, (int(n - 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    shift = np.uint64(half)
    keys = [int(_mix64(np.array([(key * 0x9E3779B97F4A7C15 + r + 1) & (2**64 - 1)],
                                dtype=np.uint64))[0]) for r in range(4)]

    def once(x):
        left, right = x >> shift, x & mask
        for k in keys:
            left, right = right, left ^ (_mix64(right ^ np.uint64(k)) & mask)
        return (left << shift) | right

    out = once(np.asarray(index, dtype=np.uint64))
    outside = out >= np.uint64(n)
    while outside.any():
        out[outside] = once(out[outside])
        outside = out >= np.uint64(n)
    return out.astype(np.int64)


@dataclass
class Mix:
    """A drawn mix. ``docs``: the sized documents with their place in their
    stream. ``segments``: one row per (document, block) with the words the
    block takes from it. ``sources``: per source size, weight, target,
    number of blocks and slots. ``slots``: the drawn slots (shard, place in
    shard, source, pass, block index)."""
    docs: DataFrame
    segments: DataFrame
    sources: DataFrame
    slots: DataFrame
    by_block: DataFrame

    def taken_segments(self) -> DataFrame:
        """segments joined by index with the passes drawn for their block:
        one row per (document, block) with ``_mx_passes`` (array of pass
        numbers, absent blocks excluded)."""
        # the planner cannot know how many slots a drawing task returns: never broadcast them
        return self.segments.join(self.by_block.hint("merge"), ["_mx_sid", "_mx_block"])


def draw_mix(docs: DataFrame, *, block_words: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS,
             chunk_words: int = CHUNK_WORDS, weight_cycle=WEIGHT_CYCLE, share: float = SHARE,
             max_passes: int = MAX_PASSES, seed: int = SEED, text_col: str = "text",
             source_col: str = "source", id_col: str = "doc_id") -> Mix:
    """Draw the mix of docs. The driver holds one row per source (a mix
    names its sources, so they are few) and nothing per document."""
    spark = docs.sparkSession
    ship(spark)
    sized = materialize(
        with_word_count(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).alias("_mx_source"),
                                    *_row_keys(id_col, source_col, text_col), F.col(text_col).alias("_mx_text")), "_mx_text", "size"), "mix-sizes")
    stats = sized.groupBy("_mx_source").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()
    stats.sort(key=lambda r: (r["_mx_source"] is None, r["_mx_source"] or ""))
    sizes = np.array([int(r["size"]) for r in stats], dtype=np.int64)
    weights = np.array([weight_cycle[i % len(weight_cycle)] for i in range(len(stats))], dtype=np.float64)
    targets = water_fill(sizes, weights, share * float(sizes.sum()), max_passes)
    streams = [max(1, -(-int(s) // chunk_words)) for s in sizes]
    src = _frame(spark, "_mx_source string, _mx_sid int, _mx_streams int, source_size long, weight double, target double",
                 [(r["_mx_source"], i, streams[i], int(sizes[i]), float(weights[i]), float(targets[i]))
                  for i, r in enumerate(stats)])
    # place every document in a stream of its source; a stream is bounded by chunk_words on average
    placed = (sized.join(F.broadcast(src), sized["_mx_source"].eqNullSafe(src["_mx_source"])).drop(src["_mx_source"])
              .withColumn("_mx_stream", F.pmod(F.xxhash64(F.lit(seed), "_mx_k1"), F.col("_mx_streams")).cast("int")))
    order = (Window.partitionBy("_mx_sid", "_mx_stream").orderBy("doc_id", "_mx_k1", "_mx_k2")
             .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = materialize(placed.withColumn("_mx_start", F.sum("size").over(order) - F.col("size")), "mix-placed")
    blocks = F.ceil(F.sum("size") / block_words).cast("long")
    prior = Window.partitionBy("_mx_sid").orderBy("_mx_stream").rowsBetween(Window.unboundedPreceding, -1)
    firsts = materialize(placed.groupBy("_mx_sid", "_mx_stream").agg(blocks.alias("_mx_n"))
                         .withColumn("_mx_first", F.coalesce(F.sum("_mx_n").over(prior), F.lit(0))), "mix-streams")
    n_blocks = np.zeros(len(stats), dtype=np.int64)
    for r in firsts.groupBy("_mx_sid").agg(F.sum("_mx_n").alias("n")).collect():
        n_blocks[r["_mx_sid"]] = r["n"]
    # slots per source: the target in blocks, in passes over the source and a rest
    slots = np.zeros(len(stats), dtype=np.int64)
    for i in range(len(stats)):
        if sizes[i] > 0:
            slots[i] = min(max_passes * n_blocks[i], int(round(targets[i] * float(n_blocks[i]) / float(sizes[i]))))
    b = block_words
    with_first = placed.where("size > 0").join(firsts.drop("_mx_n"), ["_mx_sid", "_mx_stream"])
    seg = (with_first
           .withColumn("_mx_local", F.explode(F.sequence(F.floor(F.col("_mx_start") / b),
                                                         F.floor((F.col("_mx_start") + F.col("size") - 1) / b))))
           .withColumn("_mx_from", F.greatest(F.col("_mx_start"), F.col("_mx_local") * b) - F.col("_mx_start"))
           .withColumn("_mx_to", F.least(F.col("_mx_start") + F.col("size"), (F.col("_mx_local") + 1) * b) - F.col("_mx_start"))
           .withColumn("_mx_block", F.col("_mx_first") + F.col("_mx_local"))
           .select("_mx_k1", "_mx_k2", "_mx_sid", "_mx_stream", "_mx_start", "_mx_block", "_mx_from", "_mx_to"))
    slot_rows = _slots(spark, slots, n_blocks, shard_slots, seed)
    by_block = slot_rows.groupBy("_mx_sid", "_mx_block").agg(F.sort_array(F.collect_list("pass")).alias("_mx_passes"))
    return Mix(placed, seg, src, slot_rows, by_block)


def _row_keys(id_col: str, source_col: str, text_col: str) -> list:
    """128 bits of hash that name a row by its id, source and text."""
    return [F.xxhash64(F.lit(k), id_col, F.coalesce(F.col(source_col), F.lit("")), F.col(source_col).isNull(), text_col).alias(f"_mx_k{k}")
            for k in (1, 2)]


def _frame(spark: SparkSession, schema: str, rows: list) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def _slots(spark: SparkSession, slots: np.ndarray, n_blocks: np.ndarray, shard_slots: int, seed: int) -> DataFrame:
    """One row per drawn slot. Shards are drawn independently in tasks."""
    shards = max(1, -(-int(slots.sum()) // shard_slots))
    slots, n_blocks = slots.copy(), n_blocks.copy()

    def run(batches):
        for pdf in batches:
            for shard in pdf["id"]:
                counts, before = draw_shard(int(shard), shards, slots, shard_slots, seed)
                sid = np.repeat(np.arange(len(counts)), counts)
                parts_pass, parts_block = [], []
                for s in np.flatnonzero(counts):
                    n = int(n_blocks[s])
                    j = before[s] + np.arange(counts[s], dtype=np.int64)
                    p = j // n
                    block = np.empty_like(j)
                    for e in np.unique(p):
                        block[p == e] = permute(j[p == e] % n, n, (seed * 1_000_003 + int(s)) * 31 + int(e))
                    parts_pass.append(p)
                    parts_block.append(block)
                if not parts_pass:
                    continue
                order = np.random.default_rng([seed, 7, int(shard)]).permutation(len(sid))
                yield pd.DataFrame({"shard": np.int64(shard), "place": order.astype(np.int64), "_mx_sid": sid.astype(np.int32),
                                    "pass": np.concatenate(parts_pass).astype(np.int32), "_mx_block": np.concatenate(parts_block)})

    parts = int(min(shards, max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))))
    return spark.range(0, shards, 1, parts).mapInPandas(
        tidy(run), "shard long, place long, _mx_sid int, pass int, _mx_block long")


def mix_report(docs: DataFrame, **params) -> DataFrame:
    """Per document: size, its source's size and target, words taken."""
    m = draw_mix(docs, **params)
    hit = (m.taken_segments()
           .withColumn("_mx_words", (F.col("_mx_to") - F.col("_mx_from")) * F.size("_mx_passes"))
           .groupBy("_mx_sid", "_mx_stream", "_mx_start").agg(F.sum("_mx_words").alias("taken")))
    full = m.docs.where("size > 0").join(hit.hint("merge"), ["_mx_sid", "_mx_stream", "_mx_start"], "left")
    empty = m.docs.where("size = 0").withColumn("taken", F.lit(None).cast("long"))
    return (full.unionByName(empty)
            .select("doc_id", F.col("_mx_source").alias("source"), "size", F.col("source_size"), F.col("target"),
                    F.coalesce("taken", F.lit(0)).cast("long").alias("taken")))


def mix_documents(docs: DataFrame, **params) -> DataFrame:
    """The mix as documents: per document and pass that takes some of it,
    one row with the columns of docs, whose text is the taken blocks' words
    in order (each with the white space up to the next word, so a wholly
    taken text comes back unchanged) and whose n_chars is its length."""
    m = draw_mix(docs, **params)
    parts = (m.taken_segments().select("*", F.explode("_mx_passes").alias("_mx_pass"))
             .groupBy("_mx_k1", "_mx_k2", "_mx_sid", "_mx_stream", "_mx_start", "_mx_pass")
             .agg(F.sort_array(F.collect_list(F.struct("_mx_from", "_mx_to"))).alias("_mx_spans")))
    # repeated rows share their keys: the n-th row takes what the n-th placed copy gives
    plan = (parts.groupBy("_mx_k1", "_mx_k2", "_mx_sid", "_mx_stream", "_mx_start")
            .agg(F.sort_array(F.collect_list(F.struct("_mx_pass", "_mx_spans"))).alias("_mx_takes"))
            .groupBy("_mx_k1", "_mx_k2")
            .agg(F.sort_array(F.collect_list(F.struct("_mx_sid", "_mx_stream", "_mx_start", "_mx_takes"))).alias("_mx_copies")))
    joined = (docs.select("*", *_row_keys("doc_id", "source", "text")).join(plan.hint("merge"), ["_mx_k1", "_mx_k2"])
              .withColumn("_mx_copy", F.row_number().over(Window.partitionBy("_mx_k1", "_mx_k2").orderBy(F.lit(0))))
              .where(F.col("_mx_copy") <= F.size("_mx_copies"))
              .withColumn("_mx_p", F.explode(F.element_at("_mx_copies", F.col("_mx_copy"))["_mx_takes"])))
    keep = [c for c in docs.columns if c != "text"]
    cut = joined.select("text", F.col("_mx_p._mx_spans").alias("_mx_spans"), *keep)
    fields = "text string" + "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema.fields)
    out = cut.mapInArrow(tidy(_cut_texts(keep)), fields)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def _cut_texts(keep: list[str]):
    word = re.compile("[^\x20\x09-\x0d]+")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for t, spans in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                at = [m.start() for m in word.finditer(t)]
                n = len(at)
                at[0] = 0
                at.append(len(t))
                out.append("".join(t[at[x["_mx_from"]]:at[min(x["_mx_to"], n)]] for x in spans))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()), *b.columns[2:]], names=["text", *keep])

    return run
