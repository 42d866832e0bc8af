"""Periodic runs against brute force: all stretches of all periods."""

import hashlib
import random
from fractions import Fraction

import pytest
from llm_helpers import clashing, doc, frame, odd_docs

from marketspark.llm import periodic_runs as P
from marketspark.llm.queries import planted


def smallest_period(w):
    return next(p for p in range(1, len(w) + 1) if w[p:] == w[:len(w) - p])


def brute_runs(w):
    n, out = len(w), []
    for q in range(1, n // 3 + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(24, 3 * q) and smallest_period(w[i:i + 2 * q]) == q:
                out.append((i, j - i + q, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_report(doc_id, text, edit=None):
    w = (text or "").encode().split()
    w = edit(doc_id, w) if edit else w
    runs = brute_runs(w)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=(None, None, None))
    return (doc_id, len(runs), *best, best[1] and 1000 * best[1] // best[2],
            hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest(),
            hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in gone)).hexdigest())


def runs_of(texts):
    """The three steps on lists, without Spark."""
    out = []
    for words, tiles in zip(texts, P.tiles_of(texts)):
        spans = {}
        for step, low, _, place, bounds, ids in tiles:
            for q, lo, hi in P.solve_tile(step, low, place, bounds, ids.tolist()):
                spans.setdefault(q, []).append((lo, hi))
        found = []
        for q, parts in spans.items():
            parts.sort()
            joined = [list(parts[0])]
            for lo, hi in parts[1:]:
                if lo <= joined[-1][1]:
                    joined[-1][1] = max(joined[-1][1], hi)
                else:
                    joined.append([lo, hi])
            found += [(lo, hi - lo + q, q) for lo, hi in joined if hi - lo + q >= max(24, 3 * q)]
        out.append(sorted((r for r in found if P._primitive(words, r[0], r[2])), key=lambda r: (r[0], r[2])))
    return out


def periodic_texts(rng, n):
    texts = []
    for _ in range(n):
        w = []
        for _ in range(rng.randrange(0, 5)):
            kind = rng.randrange(4)
            vocab = [f"w{i}".encode() for i in range(rng.choice((2, 3, 50)))]
            if kind == 0:
                w += [rng.choice(vocab) for _ in range(rng.randrange(0, 120))]
            else:
                unit = [rng.choice(vocab) for _ in range(rng.choice((1, 2, 3, 7, 8, 9, 15, 16, 17, 31, 40, 70)))]
                w += (unit * rng.randrange(1, 9))[:rng.randrange(1, 400)]
        texts.append(w)
    return texts


@pytest.mark.parametrize("seed", range(6))
def test_tiles_find_exactly_the_runs(seed, monkeypatch):
    if seed % 2:
        monkeypatch.setattr(P, "TILE_WORDS", 32)        # many tiles, so that fragments must be stitched
    texts = periodic_texts(random.Random(seed), 150)
    for w, got in zip(texts, runs_of(texts)):
        assert got == brute_runs(w), w


def test_one_word_and_a_square_free_text():
    same = [b"a"] * 5000
    assert runs_of([same]) == [[(0, 5000, 1)]]
    assert sum(len(t[-1]) for t in P.tiles_of([same])[0]) < 200_000
    thue = [b"x"]
    for _ in range(11):
        thue = [c for w in thue for c in {b"x": (b"x", b"y", b"z"), b"y": (b"x", b"z"), b"z": (b"y",)}[w]]
    assert runs_of([thue]) == [[]]


def test_z_function():
    rng = random.Random(1)
    for _ in range(100):
        s = [rng.randrange(2) for _ in range(rng.randrange(1, 40))]
        z = P.z_function(s)
        for i in range(1, len(s)):
            k = 0
            while i + k < len(s) and s[k] == s[i + k]:
                k += 1
            assert z[i] == k


def test_report_equals_brute_force(spark):
    rng = random.Random(5)
    docs = [doc(i, " \n".join(x.decode() for x in w)) for i, w in enumerate(periodic_texts(rng, 60))]
    docs += [doc(100 + i, " ".join(f"v{rng.randrange(30)}" for _ in range(rng.randrange(1, 500)))) for i in range(120)]
    got = {tuple(r) for r in P.run_report(frame(spark, docs), edit=planted).collect()}
    assert got == {brute_report(d[0], d[1], planted) for d in docs}
    assert sum(1 for r in got if r[1]) > 20      # the fixture holds documents with runs


def test_odd_input(spark):
    docs = odd_docs() + [doc(50, "a b " * 300), doc(50, "a b " * 300), doc(None, "z " * 24)]
    df = clashing(frame(spark, docs), ["ord", "kind", "runs", "words", "period", "n"])
    got = sorted(map(tuple, P.run_report(df).collect()), key=repr)
    assert got == sorted((brute_report(d[0], d[1]) if d[0] not in (7, 8) else (d[0], 0, None, None, None, None, hashlib.sha256(b"").hexdigest(),
                          hashlib.sha256(b" ".join(d[1].encode().split())).hexdigest()) for d in docs), key=repr)
    assert P.run_report(frame(spark, [])).collect() == []


def test_long_text_is_found_in_many_tiles(spark):
    unit = [f"u{i}" for i in range(700)]
    text = " ".join([f"p{i}" for i in range(999)] + unit * 60 + [f"q{i}" for i in range(500)])
    found, _ = P.find_runs(frame(spark, [doc(1, text)]))
    assert [tuple(r) for r in found.first()["runs"]] == [(999, 42_000, 700)]
    assert len(found.first()["collapsed"].split()) == 999 + 700 + 500
