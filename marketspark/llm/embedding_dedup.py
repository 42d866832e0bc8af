"""Embedding near-dedup by sorted projection passes.

In each pass every vector gets a key, the concatenated signs of its
projections on random directions of that pass. Vectors are ordered by their
keys lexicographically (a range partitioning), each is compared with a
bounded window of neighbours, and verified pairs are united across passes.

Windows alone would miss pairs inside a group larger than a window, so the
first passes gather tight groups into balls: a vector joins a leader in its
window if the ball stays within half the linking angle of its leader, so
that all members of a ball are linked with certainty by the triangle
inequality and need no comparison. The later passes order the leaders and
verify pairs of balls: linked as a whole, not at all, or (in between) by
comparing their members in bounded blocks. Their number grows with the
number of leaders, so that a pair at the limit is met in a window with
probability ``RECALL``.

Loose groups, whose members link but form no balls, are larger than the
windows too. So the links found only decide the components; inside each
component all leaders are then compared with each other, in bounded blocks
dealt by pair of blocks, and the links are counted from that.

Equal vectors are one vector with a weight. Vectors that are null, zero or
hold null or non-finite components link with nothing.

Defined results for odd input: null vec_ids are ignored as component names;
a vector of another length than the most common one links with nothing;
repeated ids are separate vectors; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, ship, tidy
from .components import components

MIN_COSINE = 0.9
BALL_PASSES = 4
PAIR_PASSES = 24          # at least, and at once
RECALL = 0.995            # of lone pairs at the limit, by the passes
WINDOW = 48
KEY_BITS = 48
BLOCK = 512               # members compared at once between two balls
SEED = 17
_EPS = 1e-9


def directions(dim: int, pass_no: int, bits: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, pass_no]).standard_normal((dim, bits))


def sort_keys(x: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """The concatenated hash bits of each row as one non-negative number."""
    bits = (x @ planes) > 0
    weights = np.uint64(1) << np.arange(planes.shape[1] - 1, -1, -1, dtype=np.uint64)
    return (bits * weights).sum(1, dtype=np.uint64).astype(np.int64)


def passes_needed(n: int, window: int, theta: float, least: int) -> int:
    """Passes after which a pair at angle theta among n vectors has shared a
    window with probability RECALL: it has to agree in the log2(n / window)
    key bits that tell windows apart."""
    p = (1 - theta / np.pi) ** max(0.0, np.log2(max(n, 1) / window))
    return max(least, int(np.ceil(np.log(1 - RECALL) / np.log1p(-min(p, 0.999)))))


def _matrix(col: pa.Array, dim: int) -> np.ndarray:
    """Unit rows in double precision from a binary column of doubles."""
    return np.frombuffer(b"".join(col.to_pylist()), dtype="<f8").reshape(-1, dim)


def unit_vectors(rows: DataFrame, vec_col: str) -> tuple[DataFrame, int]:
    """rows + _em_unit (unit vector as binary doubles; null if it links with
    nothing) and the vectors' length."""
    ship(rows.sparkSession)
    sizes = (rows.where(F.col(vec_col).isNotNull()).groupBy(F.size(vec_col).alias("n")).agg(F.count("*").alias("c"))
             .orderBy(F.desc("c"), "n").limit(1).collect())
    dim = int(sizes[0]["n"]) if sizes else 0
    keep = [c for c in rows.columns if c != vec_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for v in b.column(0).to_pylist():
                u = None
                if v is not None and len(v) == dim and None not in v:
                    a = np.array(v, dtype=np.float64)
                    if np.isfinite(a).all():
                        top = np.abs(a).max() if dim else 0.0
                        if top > 0:
                            a = a / top
                            u = (a / np.sqrt((a * a).sum())).astype("<f8").tobytes()
                out.append(u)
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(out, pa.binary())], names=[*keep, "_em_unit"])

    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.select(*keep).schema.fields)
    return rows.select(vec_col, *keep).mapInArrow(tidy(run), fields + "_em_unit binary"), dim


def _keyed(rows: DataFrame, dim: int, passes: list[int], bits: int, seed: int) -> DataFrame:
    """One row per vector and pass with its key; columns id, radius, unit."""
    planes = [directions(dim, p, bits, seed) for p in passes]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows == 0:
                continue
            x = _matrix(b.column(2), dim)
            for p, pl in zip(passes, planes):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(b.num_rows, p, dtype=np.int32)), pa.array(sort_keys(x, pl)), *b.columns],
                    names=["pass", "key", "id", "radius", "unit"])

    keyed = rows.select("id", "radius", "unit").mapInArrow(tidy(run), "pass int, key long, id long, radius double, unit binary")
    return keyed.repartitionByRange(F.col("pass"), F.col("key"), F.col("id")).sortWithinPartitions("pass", "key", "id")


def _absorb(rows: DataFrame, dim: int, pass_no: int, max_radius: float, window: int, bits: int, seed: int) -> DataFrame:
    """One ball pass: rows (child, leader, angle) for absorbed leaders. A row
    may join one of the last ``window`` leaders of its partition."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = np.zeros(window, dtype=np.int64)
        units = np.zeros((window, dim))
        n = 0
        for b in batches:
            child, leader, angle = [], [], []
            if b.num_rows == 0:
                continue
            x = _matrix(b.column(4), dim)
            own = b.column(2).to_numpy()
            radius = b.column(3).to_numpy()
            for i in range(len(x)):
                m = min(n, window)
                if m:
                    c = units[:m] @ x[i]
                    j = int(c.argmax())
                    a = float(np.arccos(min(1.0, c[j])))
                    if a + radius[i] <= max_radius:
                        child.append(own[i])
                        leader.append(ids[j])
                        angle.append(a)
                        continue
                units[n % window], ids[n % window] = x[i], own[i]
                n += 1
            if child:
                yield pa.RecordBatch.from_arrays([pa.array(np.array(child)), pa.array(np.array(leader)), pa.array(angle, pa.float64())],
                                                 names=["child", "leader", "angle"])

    return _keyed(rows, dim, [pass_no], bits, seed).mapInArrow(tidy(run), "child long, leader long, angle double")


def _near(rows: DataFrame, dim: int, passes: list[int], limit: float, window: int, bits: int, seed: int) -> DataFrame:
    """Pairs of leaders (a < b, angle, ra, rb) found in a window of a pass
    whose balls could hold a linked pair: angle <= limit + radii."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail = None
        for b in batches:
            if b.num_rows == 0:
                continue
            cur = (b.column(0).to_numpy(), b.column(2).to_numpy(), b.column(3).to_numpy(), _matrix(b.column(4), dim))
            if tail is not None:
                cur = tuple(np.concatenate([t, c]) for t, c in zip(tail, cur))
            old = 0 if tail is None else len(tail[0])
            p, ids, r, x = cur
            out = [[], [], [], [], []]
            for s in range(1, min(window, len(ids) - 1) + 1):
                lo = max(0, old - s)
                i = np.arange(lo, len(ids) - s)
                if not len(i):
                    continue
                j = i + s
                c = np.einsum("ij,ij->i", x[i], x[j])
                bound = np.cos(np.minimum(np.pi, limit + r[i] + r[j] + _EPS))
                ok = (p[i] == p[j]) & (c >= bound) & (ids[i] != ids[j])
                i, j, c = i[ok], j[ok], c[ok]
                for o, v in zip(out, (np.minimum(ids[i], ids[j]), np.maximum(ids[i], ids[j]), c, r[i], r[j])):
                    o.append(v)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(o)) for o in out], names=["a", "b", "cosine", "ra", "rb"])
            tail = tuple(v[-window:] for v in cur)

    return _keyed(rows, dim, passes, bits, seed).mapInArrow(tidy(run), "a long, b long, cosine double, ra double, rb double")


def _block_links(pairs: DataFrame, members: DataFrame, dim: int, min_cosine: float, block: int) -> DataFrame:
    """Exact comparison of the balls of uncertain pairs, in blocks of at
    most ``block`` members: rows (id, hits: weight of its linked partners,
    a, b)."""
    numbered = members.withColumn("_em_block", F.floor((F.row_number().over(_by_ball()) - 1) / block))
    blocks = numbered.groupBy("ball", "_em_block").agg(
        F.collect_list(F.struct("id", "weight", "unit")).alias("vs"))
    left = blocks.select(F.col("ball").alias("a"), F.col("vs").alias("va"))
    right = blocks.select(F.col("ball").alias("b"), F.col("vs").alias("vb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, hits, aa, bb = [], [], [], []
            for a, b, va, vb in zip(*(batch.column(i).to_pylist() for i in range(4))):
                xa = np.frombuffer(b"".join(v["unit"] for v in va), "<f8").reshape(-1, dim)
                xb = np.frombuffer(b"".join(v["unit"] for v in vb), "<f8").reshape(-1, dim)
                hit = (xa @ xb.T) >= min_cosine
                wa = np.array([v["weight"] for v in va])
                wb = np.array([v["weight"] for v in vb])
                for vs, n in ((va, hit @ wb), (vb, wa @ hit)):
                    for v, k in zip(vs, n.tolist()):
                        if k:
                            ids.append(v["id"])
                            hits.append(k)
                            aa.append(a)
                            bb.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in (ids, hits, aa, bb)], names=["id", "hits", "a", "b"])

    return (pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "va", "vb")
            .mapInArrow(tidy(run), "id long, hits long, a long, b long"))


def _component_links(leaders: DataFrame, dim: int, min_cosine: float, block: int) -> DataFrame:
    """Exact comparison of all leaders (component, id, radius, size, unit) of
    each component, in pairs of blocks of about ``block`` leaders: rows (a,
    null, weight of the balls that link with all of ball a) and (a, b, 0)
    for pairs of balls that only their members can decide."""
    theta = float(np.arccos(min_cosine))
    blocks = leaders.groupBy("component").agg(F.ceil(F.count("*") / block).cast("int").alias("_em_n"))
    own = F.pmod(F.hash("id"), F.col("_em_n"))
    dealt = (leaders.join(blocks, "component").withColumn("_em_own", own)
             .withColumn("_em_other", F.explode(F.sequence(F.lit(0), F.col("_em_n") - 1)))
             .select("component", F.least("_em_own", "_em_other").alias("lo"), F.greatest("_em_own", "_em_other").alias("hi"),
                     F.col("_em_own").alias("own"), "id", "radius", "size", "unit"))

    def compare(lo, hi, own, ids, r, size, x):
        left = own == lo
        right = own == hi
        il, ir = ids[left], ids[right]
        if not len(il) or not len(ir):
            return
        c = x[left] @ x[right].T
        rs = r[left][:, None] + r[right][None, :]
        sure = (rs == 0) & (c >= min_cosine)
        unsure = np.zeros_like(sure)
        if rs.any():
            angle = np.arccos(np.clip(c, -1.0, 1.0))
            sure |= (rs > 0) & (angle + rs <= theta - 1e-7)
            unsure = (rs > 0) & ~sure & (angle <= theta + rs + _EPS)
        if lo == hi:
            np.fill_diagonal(sure, False)
            unsure = np.triu(unsure, 1)
            more = ((il, sure @ size[right]),)
        else:
            more = ((il, sure @ size[right]), (ir, size[left] @ sure))
        for who, n in more:
            some = np.flatnonzero(n)
            yield who[some], None, n[some]
        u, v = np.nonzero(unsure)
        yield np.minimum(il[u], ir[v]), np.maximum(il[u], ir[v]), np.zeros(len(u), np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None

        def rows(cols, cuts):
            a, b, more = [], [], []
            for s, e in zip(cuts[:-1], cuts[1:]):
                for x, y, n in compare(cols[1][s], cols[2][s], *(v[s:e] for v in cols[3:])):
                    a.append(pa.array(x, pa.int64()))
                    b.append(pa.nulls(len(x), pa.int64()) if y is None else pa.array(y, pa.int64()))
                    more.append(pa.array(n, pa.int64()))
            if a:
                yield pa.RecordBatch.from_arrays([pa.concat_arrays(v) for v in (a, b, more)], names=["a", "b", "more"])

        for batch in batches:
            if batch.num_rows == 0:
                continue
            cur = [*(batch.column(i).to_numpy() for i in range(7)), _matrix(batch.column(7), dim)]
            if held is not None:
                cur = [np.concatenate(v) for v in zip(held, cur)]
            k = cur[:3]
            new = np.flatnonzero(np.logical_or.reduce([v[1:] != v[:-1] for v in k])) + 1
            cuts = [0, *new.tolist()]
            yield from rows(cur, cuts)
            held = [v[cuts[-1]:] for v in cur]
        if held is not None:
            yield from rows(held, [0, len(held[0])])

    return (dealt.repartition("component", "lo", "hi").sortWithinPartitions("component", "lo", "hi")
            .mapInArrow(tidy(run), "a long, b long, more long"))


def _by_ball():
    from pyspark.sql.window import Window
    return Window.partitionBy("ball").orderBy("id")


def embedding_groups(vectors: DataFrame, *, min_cosine: float = MIN_COSINE, ball_passes: int = BALL_PASSES,
                     pair_passes: int = PAIR_PASSES, window: int = WINDOW, key_bits: int = KEY_BITS, block: int = BLOCK,
                     seed: int = SEED, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of vectors."""
    theta = float(np.arccos(min_cosine))
    rows, dim = unit_vectors(vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("_em_v")), "_em_v")
    rows = materialize(rows, "embed-unit")
    # equal vectors are one; its number is a hash of the vector
    classes = rows.where(F.col("_em_unit").isNotNull()).groupBy("_em_unit").agg(
        F.min("vec_id").alias("least"), F.count("*").alias("weight"))
    classes = materialize(classes.select(F.xxhash64("_em_unit").alias("id"), "least", "weight", F.col("_em_unit").alias("unit")), "embed-classes")
    # balls: parent(child) -> leader, with the angle of the step
    ball = classes.select("id", F.col("id").alias("ball"))
    leaders = classes.select("id", F.lit(0.0).alias("radius"), "unit")
    for p in range(ball_passes):
        step = materialize(_absorb(leaders, dim, p, theta / 2 - 1e-6, window, key_bits, seed), f"embed-ball{p}")
        grown = (step.join(leaders.select(F.col("id").alias("child"), "radius"), "child")
                 .groupBy(F.col("leader").alias("id")).agg(F.max(F.col("angle") + F.col("radius")).alias("grown")))
        leaders = materialize(
            leaders.join(step.select(F.col("child").alias("id")), "id", "left_anti").join(grown, "id", "left")
            .select("id", F.greatest("radius", F.coalesce("grown", F.lit(0.0))).alias("radius"), "unit"), f"embed-leaders{p}")
        ball = materialize(
            ball.join(step.select(F.col("child").alias("ball"), "leader"), "ball", "left")
            .select("id", F.coalesce("leader", "ball").alias("ball")), f"embed-member{p}")
    members = classes.join(ball, "id").select("id", "ball", "weight", "least", "unit")
    total = passes_needed(leaders.count(), window, theta, pair_passes)
    parts = [materialize(_near(leaders, dim, list(range(1000 + p, 1000 + min(p + pair_passes, total))), theta, window, key_bits, seed)
                         .groupBy("a", "b").agg(F.first("cosine").alias("cosine"), F.max(F.col("ra") + F.col("rb")).alias("r")), "embed-near")
             for p in range(0, total, pair_passes)]
    near = parts[0]
    for part in parts[1:]:
        near = near.unionByName(part)
    if len(parts) > 1:
        near = near.groupBy("a", "b").agg(F.first("cosine").alias("cosine"), F.max("r").alias("r"))
    angle = F.acos(F.least(F.col("cosine"), F.lit(1.0)))
    sure = near.where(F.when(F.col("r") == 0, F.col("cosine") >= min_cosine).otherwise(angle + F.col("r") <= theta - 1e-7)).select("a", "b")
    open_ = near.where((F.col("r") > 0) & (angle + F.col("r") > theta - 1e-7)).select("a", "b")
    by_member = materialize(_block_links(open_, members, dim, min_cosine, block), "embed-blocks")
    weights = members.groupBy("ball").agg(F.sum("weight").alias("size"), F.min("least").alias("least"))
    weights = materialize(weights, "embed-balls")
    links = sure.unionByName(by_member.select("a", "b").distinct())
    comp = materialize(components(links), "embed-components")
    # the passes decide components; their links are counted exactly
    inner = (leaders.join(comp.withColumnRenamed("node", "id"), "id")
             .join(weights.select(F.col("ball").alias("id"), "size"), "id").select("component", "id", "radius", "size", "unit"))
    inner = materialize(_component_links(inner, dim, min_cosine, block), "embed-inner")
    whole = inner.where("b is null").groupBy(F.col("a").alias("ball")).agg(F.sum("more").alias("more"))
    rest = inner.where("b is not null").select("a", "b").join(open_, ["a", "b"], "left_anti")
    by_member = by_member.unionByName(materialize(_block_links(rest, members, dim, min_cosine, block), "embed-rest"))
    named = (weights.join(comp, weights["ball"] == comp["node"], "left")
             .select("ball", "size", "least", F.coalesce("component", "ball").alias("component")))
    name = named.groupBy("component").agg(F.min("least").alias("component_id"))
    per_ball = named.join(name, "component").join(whole, "ball", "left").select(
        "ball", "component_id", (F.col("size") - 1 + F.coalesce("more", F.lit(0))).alias("base"))
    hits = by_member.groupBy("id").agg(F.sum("hits").alias("hits"))
    per_class = (ball.join(per_ball, "ball").join(hits, "id", "left")
                 .select("id", "component_id", (F.col("base") + F.coalesce("hits", F.lit(0))).alias("n_links")))
    out = (rows.withColumn("id", F.when(F.col("_em_unit").isNotNull(), F.xxhash64("_em_unit"))).drop("_em_unit")
           .join(per_class, "id", "left"))
    cid = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), cid.alias("component_id"),
                      F.coalesce(F.col("vec_id") == cid, F.lit(False)).alias("kept"))
