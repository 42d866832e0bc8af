"""SimHash fingerprints, trie self-join and components by brute force."""

import random
import re

import numpy as np
import pytest
import xxhash
from llm_helpers import Union, clashing, doc, frame, odd_docs, words

from marketspark.llm import simhash
from marketspark.llm.components import components, local_components


def model_fp(text):
    w = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    sh = [" ".join(w[i:i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    h = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_hash_is_the_sql_function(spark):
    row = spark.sql("SELECT xxhash64('some words here') AS h").first()
    assert row.h & (2**64 - 1) == xxhash.xxh64(b"some words here", seed=42).intdigest()


def test_fingerprints_match_brute_force(spark):
    rows = odd_docs()
    got = sorted(((r.doc_id, r.fp & (2**64 - 1)) for r in simhash.fingerprints(frame(spark, rows)).collect()), key=repr)
    assert got == sorted(((r[0], model_fp(r[1])) for r in rows), key=repr)


def test_trie_pairs_match_brute_force():
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    keys = np.unique(np.concatenate([base] + [base ^ (np.uint64(1) << rng.integers(0, 64, 40, dtype=np.uint64)) for _ in range(4)]))
    front = np.array([[0, len(keys), 0, len(keys), 0]])
    for bits in (1, 2, 3):
        got = set()
        for a, b in simhash.trie_pairs(keys, front, 0, bits):
            pairs = {tuple(sorted(p)) for p in zip(a.tolist(), b.tolist())}
            assert not got & pairs
            got |= pairs
        want = {(i, j) for i in range(len(keys)) for j in range(i + 1, len(keys)) if int(keys[i] ^ keys[j]).bit_count() <= bits}
        assert got == want


@pytest.mark.parametrize("node_limit", [200_000, 8])
def test_links_give_all_components(spark, node_limit):
    """node_limit 8 makes the walk go down in Spark before tasks take over."""
    rng = random.Random(11)
    fps = set()
    for _ in range(60):
        f = rng.getrandbits(64)
        for _ in range(rng.randrange(1, 8)):
            fps.add(f)
            f ^= 1 << rng.randrange(64)
    block = rng.getrandbits(21) << 43           # a hot node: many fingerprints share a whole block
    fps |= {block | rng.getrandbits(16) for _ in range(150)}
    fps = sorted(fps)
    signed = [(x - 2**64 if x >= 2**63 else x,) for x in fps]
    got = components(simhash.links(spark.createDataFrame(signed, "fp long"), node_limit=node_limit)).collect()
    u = Union()
    for i, a in enumerate(signed):
        for b in signed[i + 1:]:
            if ((a[0] ^ b[0]) & (2**64 - 1)).bit_count() <= 2:
                u.join(a[0], b[0])
    want = {x[0]: u.find(x[0]) for x in signed}
    mine = {x[0]: x[0] for x in signed} | {r.node: r.component for r in got}
    assert mine == want


def test_groups_and_keep_one(spark):
    rng = random.Random(2)
    rows = []
    for g in range(30):
        w = words(rng, 300)
        for c in range(1 + g % 4):
            v = list(w)
            if c:
                v[rng.randrange(300)] = "changed"
            rows.append(doc(1000 - len(rows), " ".join(v)))
    rows += odd_docs()
    df = clashing(frame(spark, rows), ["fp", "component_id", "node", "key"])
    got = simhash.simhash_groups(df).collect()
    fp = [model_fp(r[1]) for r in rows]
    u = Union()
    for i in range(len(rows)):
        for j in range(i):
            if (fp[i] ^ fp[j]).bit_count() <= 2:
                u.join(i, j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[u.find(i)] = min(least.get(u.find(i), r[0]), r[0])
    want = sorted(((r[0], least.get(u.find(i))) for i, r in enumerate(rows)), key=repr)
    assert sorted(((r.doc_id, r.component_id) for r in got), key=repr) == want
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    ids = sorted(r.doc_id for r in kept.where("doc_id IS NOT NULL").select("doc_id").collect())
    assert ids == sorted(set(least.values()))
    assert kept.where("doc_id IS NULL").count() == 2


def test_empty(spark):
    empty = frame(spark, [])
    assert simhash.simhash_groups(empty).count() == 0
    assert simhash.keep_one(empty).count() == 0


def test_components_of_chains_and_hubs(spark):
    rng = random.Random(9)
    edges = [(i, i + 1) for i in range(0, 500)] + [(10_000, 10_001 + i) for i in range(800)] + [(7, 7), (20_000, 20_001)]
    rng.shuffle(edges)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long").repartition(5)).collect()}
    want = {i: 0 for i in range(501)} | {10_000 + i: 10_000 for i in range(801)} | {20_000: 20_000, 20_001: 20_000}
    assert got == want
    a, b = local_components(np.array([5, 3, 9]), np.array([3, 1, 8]))
    assert dict(zip(a.tolist(), b.tolist())) == {3: 1, 5: 1, 9: 8}
