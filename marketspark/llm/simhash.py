"""SimHash near-dedup by a binary-trie self-join.

A fingerprint bit is set when it is set in over half of the hashes of the
document's word shingles. Distinct fingerprints form a binary trie; pairs of
its nodes are walked down together, adding up the bits in which they differ,
and a pair is dropped as soon as the error budget is exceeded.

To spread the walk over a cluster the trie is stored budget + 1 times, each
time with another block of bits first: two fingerprints within the budget
agree on at least one whole block, so each pair meets under one node of some
stored trie. Equal fingerprints are one trie leaf. Nodes that hold more
fingerprints than a task takes are walked further down in Spark: a node pair
becomes up to four child pairs.

Defined results for odd input: null and wordless texts have fingerprint
zero, linked like any other; null ids stay null and name no component
(their rows take the smallest non-null id of theirs, null if none); repeated
rows are one leaf; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, ship, tidy
from .components import components, local_components

SHINGLE_WORDS = 3
MAX_BITS = 2
HASH_SEED = 42
NODE_LIMIT = 200_000       # fingerprints under one trie node that a task takes
_FRONTIER = 100_000        # node pairs walked at once


def fingerprint(text: bytes | None, shingle_words: int = SHINGLE_WORDS) -> int:
    """64-bit SimHash of a text (unsigned)."""
    words = (text or b"").translate(_LOWER).split()
    if not words:
        return 0
    if len(words) <= shingle_words:
        return xxhash.xxh64_intdigest(b" ".join(words), HASH_SEED)
    shingles = map(b" ".join, zip(*(words[i:] for i in range(shingle_words))))
    h = np.fromiter((xxhash.xxh64_intdigest(s, HASH_SEED) for s in shingles), np.uint64, len(words) - shingle_words + 1)
    total = np.zeros(64, dtype=np.int64)
    for lo in range(0, len(h), 1 << 16):        # long texts in bounded pieces
        total += np.unpackbits(h[lo:lo + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(total * 2 > len(h)).tobytes(), "big")


_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def fingerprints(docs: DataFrame, *, shingle_words: int = SHINGLE_WORDS, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """doc_id, fp (the fingerprint's bits as a signed long), and text_hash,
    which tells rows that share an id apart."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = [fingerprint(t, shingle_words) for t in b.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(np.array(fp, dtype=np.uint64).view(np.int64)), b.column(2)], names=["doc_id", "fp", "text_hash"])

    return (docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("text_hash"))
            .mapInArrow(tidy(run), "doc_id long, fp long, text_hash long"))


def blocks(max_bits: int) -> list[tuple[int, int]]:
    """max_bits + 1 blocks of bits (first bit, width) covering all 64."""
    n = max_bits + 1
    edges = [64 * i // n for i in range(n + 1)]
    return [(edges[i], edges[i + 1] - edges[i]) for i in range(n)]


def rotate(fp: np.ndarray, first_bit: int) -> np.ndarray:
    """Bits from first_bit (counted from the top) on come first."""
    if first_bit == 0:
        return fp.copy()
    return (fp << np.uint64(first_bit)) | (fp >> np.uint64(64 - first_bit))


def _count(bits: np.ndarray) -> np.ndarray:
    return np.bitwise_count(bits).astype(np.int64)


def trie_pairs(keys: np.ndarray, frontier: np.ndarray, depth: int, max_bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Walk node pairs of the trie over the sorted distinct keys.

    frontier: rows (lo_a, hi_a, lo_b, hi_b, diff): two nodes as ranges of
    keys whose top ``depth`` bits are equal within a node, and the number of
    those bits in which the nodes differ; a node paired with itself stands
    for all pairs inside it. Yields index pairs of keys within max_bits.
    The frontier is walked in bounded pieces, depth first."""
    stack = [(depth, frontier)]
    while stack:
        d, f = stack.pop()
        if len(f) > _FRONTIER:
            half = len(f) // 2
            stack += [(d, f[half:]), (d, f[:half])]
            continue
        # two single leaves: compare the remaining bits at once
        single = (f[:, 1] - f[:, 0] == 1) & (f[:, 3] - f[:, 2] == 1)
        if single.any():
            s = f[single & (f[:, 0] != f[:, 2])]
            ok = _count(keys[s[:, 0]] ^ keys[s[:, 2]]) <= max_bits
            if ok.any():
                yield s[ok, 0], s[ok, 2]
            f = f[~single]
        if not len(f) or d >= 64:
            continue
        ones = np.concatenate([[0], np.cumsum((keys >> np.uint64(63 - d)) & np.uint64(1), dtype=np.int64)])
        la, ha, lb, hb, diff = f.T
        ma, mb = ha - (ones[ha] - ones[la]), hb - (ones[hb] - ones[lb])
        same = la == lb
        kids = [np.stack([la, ma, lb, mb, diff], 1), np.stack([ma, ha, mb, hb, diff], 1),
                np.stack([la, ma, mb, hb, diff + 1], 1),
                np.stack([ma, ha, lb, mb, diff + 1], 1)[~same]]
        nxt = np.concatenate(kids)
        alive = (nxt[:, 4] <= max_bits) & (nxt[:, 1] > nxt[:, 0]) & (nxt[:, 3] > nxt[:, 2])
        alive &= ~((nxt[:, 0] == nxt[:, 2]) & (nxt[:, 1] - nxt[:, 0] == 1))
        if alive.any():
            stack.append((d + 1, nxt[alive]))


def links(fps: DataFrame, *, max_bits: int = MAX_BITS, node_limit: int = NODE_LIMIT) -> DataFrame:
    """Spanning links (a, b) between distinct fingerprints (column fp):
    the connected components of the links are those of all pairs within
    max_bits. Pairs inside dense groups are not written out."""
    spark = fps.sparkSession
    ship(spark)
    parts = blocks(max_bits)
    # work items: (trie, path of the node pair, depth, diff, side)
    rows = None
    for t, (first, width) in enumerate(parts):
        rot = F.col("fp") if first == 0 else F.shiftleft("fp", first).bitwiseOR(F.shiftrightunsigned("fp", 64 - first))
        r = fps.select("fp", F.lit(t).alias("trie"), rot.alias("key")).withColumn(
            "item", F.shiftrightunsigned("key", 64 - width)).withColumn("depth", F.lit(width))
        rows = r if rows is None else rows.unionByName(r)
    rows = rows.withColumn("diff", F.lit(0)).withColumn("side", F.lit(0)).withColumn("self", F.lit(1))
    work = ["trie", "item", "depth", "diff"]
    heavy = materialize(rows.groupBy(*work).agg(F.count("*").alias("n")).where(F.col("n") > node_limit), "simhash-heavy")
    done = []
    while not heavy.isEmpty():
        marked = rows.join(heavy.select(*work, F.lit(True).alias("_heavy")), work, "left")
        done.append(marked.where(F.col("_heavy").isNull()).drop("_heavy"))
        rows = materialize(_children(marked.where("_heavy").drop("_heavy"), max_bits), "simhash-children")
        sides = rows.groupBy(*work).agg(F.count("*").alias("n"), F.min("side").alias("lo"), F.max("side").alias("hi"),
                                        F.min("self").alias("self"))
        alive = sides.where(F.when(F.col("self") == 1, F.col("n") > 1).otherwise(F.col("lo") < F.col("hi")))
        rows = materialize(rows.join(alive.select(*work), work, "left_semi"), "simhash-alive")
        heavy = materialize(alive.where((F.col("n") > node_limit) & (F.col("depth") < 64)).select(*work, "n"), "simhash-heavy")
    for d in done:
        rows = rows.unionByName(d.select(*rows.columns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry = None
        for b in batches:
            pdf = b.to_pandas()
            if carry is not None:
                pdf = pd.concat([carry, pdf], ignore_index=True)
            k = pdf[work].to_numpy()
            last = np.flatnonzero((k[1:] != k[:-1]).any(1))
            if len(last) == 0 or len(pdf) < 50_000:
                carry = pdf
                continue
            cut = int(last[-1]) + 1
            yield from _links_of(pdf.iloc[:cut], work, max_bits)
            carry = pdf.iloc[cut:]
        if carry is not None and len(carry):
            yield from _links_of(carry, work, max_bits)

    return (rows.select("trie", "item", "depth", "diff", "side", "key", "fp")
            .repartition(*[F.col(c) for c in work]).sortWithinPartitions(*work, "side", F.col("key"))
            .mapInArrow(tidy(run), "a long, b long"))


def _children(rows: DataFrame, max_bits: int) -> DataFrame:
    """Walk each work item one bit down: node pairs (0,0), (1,1), (0,1) and
    (1,0) become items of their own; a member joins those it belongs to."""
    bit = F.expr("cast(shiftrightunsigned(key, 63 - depth) & 1 as int)")
    r = rows.withColumn("bit", bit).withColumn("two", F.col("self") == 0)
    opts = F.expr("""filter(if(two,
        array(struct(bit * 3 as c, side as side, diff as diff, 0 as self),
              struct(if((side = 0) = (bit = 0), 1, 2) as c, side as side, diff + 1 as diff, 0 as self)),
        array(struct(bit * 3 as c, 0 as side, diff as diff, 1 as self),
              struct(1 as c, bit as side, diff + 1 as diff, 0 as self))), x -> x.diff <= """ + str(max_bits) + ")")
    return (r.withColumn("o", F.explode(opts))
            .select("fp", "trie", "key", F.xxhash64("item", "depth", "diff", F.col("o.c")).alias("item"),
                    (F.col("depth") + 1).alias("depth"), F.col("o.diff").alias("diff"), F.col("o.side").alias("side"), F.col("o.self").alias("self")))


def _links_of(pdf: pd.DataFrame, work: list[str], max_bits: int) -> Iterator[pa.RecordBatch]:
    """Walk many work items in one frontier. Keys of all items are laid
    side by side; the frontier holds one node pair per item."""
    k = pdf[work].to_numpy()
    edge = np.concatenate([[0], np.flatnonzero((k[1:] != k[:-1]).any(1)) + 1, [len(pdf)]])
    big = np.flatnonzero(np.diff(edge) > 1)
    if not len(big):
        return
    key = pdf["key"].to_numpy().view(np.uint64)
    fp = pdf["fp"].to_numpy()
    side = pdf["side"].to_numpy()
    depth = pdf["depth"].to_numpy()
    diff = pdf["diff"].to_numpy()
    found_a, found_b = [], []

    def flush():
        if not found_a:
            return None
        # spanning links only: every member to the smallest of its local component
        a, b = local_components(np.concatenate(found_a), np.concatenate(found_b))
        found_a.clear()
        found_b.clear()
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    size = 0
    for d in np.unique(depth[edge[big]]):
        items = big[depth[edge[big]] == d]
        lo, hi = edge[items], edge[items + 1]
        order = np.arange(len(key))
        front = np.empty((len(items), 5), dtype=np.int64)
        ones = np.concatenate([[0], np.cumsum(side)])
        n1 = ones[hi] - ones[lo]
        mid = hi - n1           # side 0 first, then side 1
        paired = n1 > 0
        front[:, 0], front[:, 1] = lo, np.where(paired, mid, hi)
        front[:, 2], front[:, 3] = np.where(paired, mid, lo), hi
        front[:, 4] = diff[lo]
        # the keys must ascend within each range: sort by (item, side, unsigned key)
        item_no = np.repeat(np.arange(len(edge) - 1), np.diff(edge))
        order = np.lexsort((key, side, item_no))
        skey, sfp = key[order], fp[order]
        for a, b in trie_pairs(skey, front, int(d), max_bits):
            found_a.append(sfp[a])
            found_b.append(sfp[b])
            size += len(a)
            if size > 500_000:
                out = flush()
                size = 0
                if out is not None:
                    yield out
    out = flush()
    if out is not None:
        yield out


def _grouped(docs: DataFrame, shingle_words: int, max_bits: int, node_limit: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, fp, text_hash, component (one of its fingerprints) and
    component_id of every row."""
    fps = materialize(fingerprints(docs, shingle_words=shingle_words, id_col=id_col, text_col=text_col), "simhash-fp")
    leaves = fps.groupBy("fp").agg(F.min("doc_id").alias("least"))
    leaves = materialize(leaves, "simhash-leaves")
    found = links(leaves.select("fp"), max_bits=max_bits, node_limit=node_limit)
    comp = components(found)                      # node, component (fingerprints that have links)
    named = (leaves.join(comp, leaves["fp"] == comp["node"], "left")
             .select("fp", "least", F.coalesce("component", "fp").alias("component")))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    by_fp = named.join(least, "component").select("fp", "component", "component_id")
    return fps.join(by_fp, "fp").select("doc_id", "fp", "text_hash", "component", "component_id")


def simhash_groups(docs: DataFrame, *, shingle_words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS,
                   node_limit: int = NODE_LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp, component_id (smallest doc_id reachable by links)."""
    return _grouped(docs, shingle_words, max_bits, node_limit, id_col, text_col).select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, *, shingle_words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS, node_limit: int = NODE_LIMIT) -> DataFrame:
    """docs without near-duplicates: one row of each group stays, of those
    with its smallest doc_id the one with the smallest fingerprint (then
    text hash). Rows that share an id are told apart by their text, so two
    texts under one id stay both where no other row is like them. Rows
    without an id stay."""
    groups = _grouped(docs, shingle_words, max_bits, node_limit, "doc_id", "text").where(F.col("doc_id").isNotNull())
    first = groups.groupBy("component").agg(F.min(F.struct("doc_id", "fp", "text_hash")).alias("one"))
    keep = first.select(F.col("one.doc_id").alias("_sh_id"), F.col("one.text_hash").alias("_sh_hash"))
    rows = docs.withColumn("_sh_text", F.xxhash64("text"))
    with_id = rows.join(keep, (rows["doc_id"] == keep["_sh_id"]) & (rows["_sh_text"] == keep["_sh_hash"]))
    with_id = with_id.dropDuplicates(["doc_id", "_sh_text"]).select(*docs.columns)
    return with_id.unionByName(docs.where(F.col("doc_id").isNull())).select(*docs.columns)
