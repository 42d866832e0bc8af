"""Embedding near-dedup against all pairs."""

import math

import numpy as np
from llm_helpers import Union, clashing

from marketspark.llm import embedding_dedup as ed

SCHEMA = "vec_id long, embedding array<float>, label int"


def rows_of(seed=1):
    rng = np.random.default_rng(seed)
    dim = 16
    out, n = [], 0

    def add(v):
        nonlocal n
        out.append((n, [float(x) for x in np.asarray(v, dtype=np.float32)], n % 3))
        n += 1

    for _ in range(150):
        add(rng.standard_normal(dim))
    for _ in range(6):                                  # tight groups, larger than a window
        c = rng.standard_normal(dim)
        for _ in range(90):
            add(c + 0.05 * rng.standard_normal(dim))
    for _ in range(12):                                 # loose groups near the limit
        c = rng.standard_normal(dim)
        for _ in range(6):
            add(c + 0.2 * rng.standard_normal(dim))
    c = rng.standard_normal(dim)
    for _ in range(300):                                # equal vectors
        add(c)
    add(3 * c)
    odd = [None, [0.0] * dim, [math.nan] * dim, [math.inf] + [1.0] * (dim - 1), [None] + [1.0] * (dim - 1), [1.0, 2.0], []]
    for v in odd:
        out.append((n, v, None))
        n += 1
    out.append((None, [float(x) for x in c], 1))
    return out, dim


def model(rows, dim):
    ok = [i for i, r in enumerate(rows) if r[1] and len(r[1]) == dim and None not in r[1] and np.isfinite(r[1]).all() and np.any(r[1])]
    x = np.array([rows[i][1] for i in ok], dtype=np.float64)
    x /= np.linalg.norm(x, axis=1)[:, None]
    hit = (x @ x.T) >= 0.9
    np.fill_diagonal(hit, False)
    return ok, hit


def test_links_and_components(spark):
    rows, dim = rows_of()
    df = clashing(spark.createDataFrame(rows, SCHEMA), ["n_links", "ball", "id", "weight"])
    got = {r.vec_id: r for r in ed.embedding_groups(df, window=24).collect()}
    ok, hit = model(rows, dim)
    links = dict.fromkeys(range(len(rows)), 0) | {i: int(h.sum()) for i, h in zip(ok, hit)}
    found = sum(r.n_links for r in got.values())
    assert all(got[rows[i][0]].n_links <= links[i] for i in range(len(rows)))       # no link below the limit
    assert found >= 0.99 * sum(links.values())                                      # recall
    u = Union()
    for a in range(len(ok)):
        for b in np.flatnonzero(hit[a]):
            if rows[ok[a]][0] is not None and rows[ok[b]][0] is not None:
                u.join(rows[ok[a]][0], rows[ok[b]][0])
    same = sum(got[i].component_id == u.find(i) for i in range(len(rows) - 1))
    assert same >= 0.99 * len(rows)
    for r in got.values():
        assert r.kept == (r.vec_id is not None and r.vec_id == r.component_id)
    for i in range(len(rows) - 8, len(rows) - 1):
        assert got[i].n_links == 0 and got[i].component_id == i and got[i].kept


def test_balls_are_compared_exactly():
    """The window passes never report a pair outside its bound."""
    planes = ed.directions(4, 0, 8, 1)
    x = np.eye(4)
    keys = ed.sort_keys(x, planes)
    assert keys.tolist() == [int("".join("1" if b else "0" for b in (row @ planes) > 0), 2) for row in x]


def test_empty_and_all_invalid(spark):
    assert ed.embedding_groups(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(1, None, 0), (2, [0.0, 0.0], 0), (2, [0.0, 0.0], 0)]
    got = ed.embedding_groups(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in got) == [(1, 0, 1, True), (2, 0, 2, True), (2, 0, 2, True)]


def test_loose_group_larger_than_the_windows(spark):
    """Members that link without forming balls are all counted."""
    rng = np.random.default_rng(3)
    c = rng.standard_normal(64)
    x = c / np.linalg.norm(c) + 0.3 * rng.standard_normal((3000, 64)) / 8
    rows = [(i, [float(v) for v in np.asarray(r, dtype=np.float32)], 0) for i, r in enumerate(x)]
    ok, hit = model(rows, 64)
    got = {r.vec_id: r for r in ed.embedding_groups(spark.createDataFrame(rows, SCHEMA)).collect()}
    links = hit.sum(1)
    assert links.sum() > 1_000_000
    assert sum(got[i].n_links == n for i, n in zip(ok, links.tolist())) >= 0.999 * len(ok)
    assert sum(got[i].n_links for i in ok) >= 0.9999 * links.sum()


def test_passes_grow_with_the_table():
    theta = math.acos(0.9)
    few, many = (ed.passes_needed(n, 48, theta, 24) for n in (10_000, 10_000_000))
    assert few == 24 and 70 < many < 90
    p = (1 - theta / math.pi) ** math.log2(10_000_000 / 48)
    assert 1 - (1 - p) ** many >= 0.995
