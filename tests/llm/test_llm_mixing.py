"""Mixing: targets by brute force, draws, permutations, takes."""

import random

import numpy as np
import pytest
from llm_helpers import clashing, doc, frame, odd_docs, words

from marketspark.llm import mixing


def slow_fill(sizes, weights, total, cap):
    target, open_ = [0.0] * len(sizes), {i for i, s in enumerate(sizes) if s > 0}
    left = total
    while open_:
        w = sum(weights[i] for i in open_)
        over = [i for i in open_ if left * weights[i] / w > cap * sizes[i]]
        if not over:
            for i in open_:
                target[i] = left * weights[i] / w
            break
        for i in over:
            target[i] = cap * sizes[i]
        left -= sum(target[i] for i in over)
        open_ -= set(over)
    return target


def test_water_fill():
    rng = random.Random(1)
    for _ in range(50):
        sizes = [rng.choice([0, rng.randrange(1, 1000)]) for _ in range(rng.randrange(1, 9))]
        weights = [(3, 1, 2)[i % 3] for i in range(len(sizes))]
        got = mixing.water_fill(np.array(sizes), np.array(weights), 1.5 * sum(sizes), 2)
        assert got == pytest.approx(slow_fill(sizes, weights, 1.5 * sum(sizes), 2))
        assert all(t <= 2 * s + 1e-9 for t, s in zip(got, sizes))
        assert got.sum() == pytest.approx(1.5 * sum(sizes))


def test_permutations_are_bijections():
    for n in (1, 2, 3, 7, 64, 1000):
        a = mixing.permute(np.arange(n), n, 5)
        assert sorted(a.tolist()) == list(range(n))
    assert mixing.permute(np.arange(1000), 1000, 5).tolist() != mixing.permute(np.arange(1000), 1000, 6).tolist()


def test_shard_draws_add_up():
    slots = np.array([100, 0, 37, 263])
    shards = [mixing.draw_shard(k, 7, slots, 60, 3) for k in range(7)]
    assert sum(c for c, _ in shards).tolist() == slots.tolist()
    run = np.zeros(4, dtype=int)
    for counts, before in shards:
        assert before.tolist() == run.tolist()
        run += counts
    assert all(c.sum() == 60 for c, _ in shards[:6])


def mixed_rows(seed=4):
    rng = random.Random(seed)
    rows = [doc(i, " ".join(words(rng, rng.randrange(1, 200))), "hot" if i % 3 == 0 else f"s{i % 5}") for i in range(400)]
    return rows + [doc(900, " ".join(words(rng, 40)), None)]


def test_report(spark):
    rows = mixed_rows() + odd_docs()
    df = clashing(frame(spark, rows), ["size", "target", "shard", "taken"])
    got = mixing.mix_report(df, block_words=16, shard_slots=64, chunk_words=5000).collect()
    sizes = sorted(((r[0], len((r[1] or "").split())) for r in rows), key=repr)
    assert sorted(((r.doc_id, r.size) for r in got), key=repr) == sizes
    assert all(0 <= r.taken <= 2 * r.size for r in got)
    names = sorted({r[3] for r in rows if r[3] is not None}) + [None]
    per = {s: sum(len((r[1] or "").split()) for r in rows if r[3] == s) for s in names}
    target = dict(zip(names, slow_fill([per[s] for s in names], [(3, 1, 2)[i % 3] for i in range(len(names))], 1.5 * sum(per.values()), 2)))
    for s in names:
        mine = [r for r in got if r.source == s]
        assert all(r.source_size == per[s] and r.target == pytest.approx(target[s]) for r in mine)
        assert abs(sum(r.taken for r in mine) - target[s]) <= 40 + 0.01 * target[s]
    again = mixing.mix_report(df.repartition(5), block_words=16, shard_slots=64, chunk_words=5000).collect()
    assert sorted(got, key=repr) == sorted(again, key=repr)


def test_mixed_documents_hold_the_taken_words(spark):
    rows = mixed_rows()
    df = clashing(frame(spark, rows), ["size", "pass"])
    p = dict(block_words=16, shard_slots=64, chunk_words=5000)
    taken = {r.doc_id: (r.taken, r.size) for r in mixing.mix_report(df, **p).collect()}
    out = mixing.mix_documents(df, **p)
    assert out.columns == df.columns
    texts = {r[0]: r[1] for r in rows}
    got = {}
    for r in out.collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + len(r.text.split())
        assert set(r.text.split()) <= set(texts[r.doc_id].split()) and r.n_chars == len(r.text)
        if taken[r.doc_id][0] == 2 * taken[r.doc_id][1]:
            assert r.text == texts[r.doc_id]
    assert got == {k: t for k, (t, _) in taken.items() if t}


def test_repeated_rows_and_empty(spark):
    rows = [doc(1, "a b c d e f g h " * 5)] * 3 + [doc(2, "i j k l " * 30, "s1")]
    df = frame(spark, rows)
    p = dict(block_words=4, shard_slots=8)
    n = sum(r.taken for r in mixing.mix_report(df, **p).collect())
    assert n == sum(len(r.text.split()) for r in mixing.mix_documents(df, **p).collect())
    assert mixing.mix_report(frame(spark, [])).count() == 0
    assert mixing.mix_documents(frame(spark, [])).count() == 0
    assert mixing.mix_report(frame(spark, [doc(1, None), doc(2, "")])).count() == 2


def test_vast_populations_are_drawn_not_split(monkeypatch):
    """The draw for populations beyond numpy's limit: the same distribution
    (against numpy's draw where both work), exact totals, seeded."""
    rng = np.random.default_rng(3)
    for good, bad, n in ((500, 700, 300), (30, 9000, 4000), (9000, 30, 4000), (5000, 4000, 20), (50_000, 20_000, 60_000), (3, 2, 4)):
        own = np.array([mixing._hypergeometric(rng, good, bad, n) for _ in range(4000)])
        ref = rng.hypergeometric(good, bad, n, 4000)
        spread = max(ref.std(), 0.3)
        assert abs(own.mean() - ref.mean()) < 0.1 * spread and 0.92 < (own.std() + 0.05) / (ref.std() + 0.05) < 1.08, (good, bad, n)
        assert own.min() >= max(0, n - bad) and own.max() <= min(n, good)
    slots = np.array([4_000_000_000, 1_000_000_000, 7, 0])
    left = mixing._split_counts(np.random.default_rng([1, 0, 8]), slots, 2_000_000_000)
    assert int(left.sum()) == 2_000_000_000 and (left <= slots).all() and (left >= 0).all()
    assert left[0] != 1_600_000_000 and abs(int(left[0]) - 1_599_999_997) < 200_000      # a draw, five standard deviations wide
    assert (left == mixing._split_counts(np.random.default_rng([1, 0, 8]), slots, 2_000_000_000)).all()
    small = np.array([300, 200, 50])
    monkeypatch.setattr(mixing, "_DRAW_LIMIT", 0)
    parts = [mixing.draw_shard(k, 6, small, 100, 9) for k in range(6)]
    assert (sum(p[0] for p in parts) == small).all() and all(int(p[0].sum()) == 100 for p in parts[:5])
