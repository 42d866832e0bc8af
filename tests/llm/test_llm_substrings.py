"""Exact and fuzzy substring dedup by brute force."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from llm_helpers import clashing, doc, frame, odd_docs, words

from marketspark.llm import chaining, substring_dedup, suffix_dedup
from marketspark.llm.common import ordered
from marketspark.llm.run_index import RunIndex


def test_run_index_matches_brute_force():
    rng = random.Random(1)
    for _ in range(150):
        base = bytes(rng.choice(b"ab\x00\xff") for _ in range(60))
        texts = [b"".join(base[(i := rng.randrange(50)):i + rng.randrange(1, 20)] for _ in range(rng.randrange(0, 6)))
                 for _ in range(rng.randrange(1, 12))]
        n = rng.choice([3, 5, 8])
        index = RunIndex(texts)
        seen, want = set(), np.zeros(index.size, dtype=bool)
        for s, t in zip(index.start, texts):
            for i in range(len(t) - n + 1):
                want[s + i] = t[i:i + n] in seen
                seen.add(t[i:i + n])
        assert (index.later_copies(n) == want).all()


def test_run_index_compresses_repetition():
    text = bytes(random.Random(2).randrange(256) for _ in range(400))
    one, many = RunIndex([text]), RunIndex([text] * 40)
    assert many.runs < 45 + 2 * one.runs


def slow_repeats(rows, length):
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, i))
    seen, out = set(), []
    for i in order:
        t = (rows[i][1] or "").encode()
        gone = np.zeros(len(t), dtype=bool)
        for p in range(len(t) - length + 1):
            w = t[p:p + length]
            if w in seen:
                gone[p:p + length] = True
            seen.add(w)
        kept = bytes(b for b, g in zip(t, gone) if not g)
        spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        out.append((rows[i][0], len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def repetitive(seed=4):
    rng = random.Random(seed)
    passage = " ".join(words(rng, 60))
    rows = []
    for i in range(120):
        w = words(rng, rng.randrange(5, 80))
        t = " ".join(w)
        if i % 3 == 0:
            cut = rng.randrange(40)
            t += " " + passage[cut:cut + rng.randrange(60, 300)] + " " + " ".join(words(rng, 3))
        if i % 7 == 0:
            t += "\n" + t
        if i % 11 == 0 and rows:
            t = rows[rng.randrange(len(rows))][1]
        rows.append(doc(500 - i, t))
    return rows


@pytest.mark.parametrize("params", [{}, {"block_bytes": 2000}, {"hot_contexts": 4}])
def test_exact_removal_matches_brute_force(spark, params):
    rows = repetitive()
    df = clashing(frame(spark, rows), ["ord", "anchor", "n_bytes", "marks"]).repartition(4)
    got = suffix_dedup.remove_repeats(df, **params).collect()
    assert sorted((tuple(r) for r in got), key=repr) == slow_repeats(rows, 100)


def test_exact_removal_odd_input(spark):
    long_text = "".join(chr(97 + i * i % 23) for i in range(3000)) * 4
    rows = [doc(1, long_text), doc(2, "é" * 200), doc(3, "a" * 500), doc(4, None), doc(5, ""), (None, "a" * 150, None, None, None),
            (None, None, None, None, None), doc(6, "x" * 99), doc(7, "x" * 99), doc(8, long_text[:400]), doc(9, "b" * 120), doc(9, "b" * 120)]
    got = suffix_dedup.remove_repeats(frame(spark, rows), with_kept=True).collect()
    assert sorted((tuple(r)[:5] for r in got), key=repr) == slow_repeats(rows, 100)
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in got)
    assert suffix_dedup.remove_repeats(frame(spark, [])).count() == 0


def test_segments_of_long_texts(spark, monkeypatch):
    """Texts longer than what is hashed at once give the same anchors' windows."""
    t = bytes(random.Random(3).randrange(97, 123) for _ in range(5000))
    def windows(cut):
        monkeypatch.setattr(suffix_dedup, "_SEGMENT", cut)
        out = []
        for batch in suffix_dedup._segments([t], 100):
            data = np.frombuffer(b"".join(x[2] for x in batch), dtype=np.uint8)
            ends = np.cumsum([len(x[2]) for x in batch])
            starts = np.concatenate([[0], ends[:-1]])
            r, p0, m, anchor, _ = suffix_dedup.anchors(data, starts, ends, 100, 32)
            off = np.array([x[1] for x in batch])
            for i in range(len(r)):
                out += [(int(p0[i] - starts[r[i]] + off[r[i]] + k), int(anchor[i])) for k in range(m[i])]
        return sorted(out)
    assert windows(10**6) == windows(700)
    assert len(windows(700)) == 4901


def slow_chain_score(b, a, size, gap):
    n = len(b)
    f = [0.0] * n
    for i in sorted(range(n), key=lambda i: (b[i], a[i])):
        f[i] = size[i] + max([0.0] + [f[j] - gap * (b[i] - b[j] - size[j] + a[i] - a[j] - size[j]) for j in range(n)
                                     if b[j] + size[j] <= b[i] and a[j] + size[j] <= a[i]])
    return max(f)


def test_fenwick_chain_is_optimal():
    rng = random.Random(5)
    for _ in range(200):
        n = rng.randrange(1, 14)
        b, a, size = ([rng.randrange(60) for _ in range(n)] for _ in range(3))
        size = [1 + s % 6 for s in size]
        chains = chaining.best_chains(b, a, size, 0.25)
        assert sorted(i for c in chains for i in c) == list(range(n))
        top = chains[0]
        score = sum(size[i] for i in top)
        for i, j in zip(top, top[1:]):
            assert b[i] + size[i] <= b[j] and a[i] + size[i] <= a[j]
            score -= 0.25 * (b[j] - b[i] - size[i] + a[j] - a[i] - size[i])
        assert score == pytest.approx(slow_chain_score(b, a, size, 0.25))


@pytest.mark.parametrize("places", [16, 40, 101, 5000])
def test_seeds_of_long_texts(places):
    """Cut into pieces or not, texts give the same seeds."""
    rng = np.random.default_rng(6)
    per = np.array([0, 7, 8, 9, 300, 49, 50, 100, 1000, 15])
    h = rng.integers(0, 40, per.sum()).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for k, window, least in ((5, 4, 50), (5, 4, 0), (3, 6, 8)):
        want = list(zip(*(x.tolist() for x in substring_dedup.minimizers(h, per, k, window, least))))
        got = [r for part in substring_dedup.sampled(h, per, k, window, least, places) for r in zip(*(x.tolist() for x in part))]
        assert got == want and len(want) > 100


def test_a_text_longer_than_the_pieces(spark, monkeypatch):
    rng = random.Random(8)
    part = words(rng, 90)
    texts = [" ".join(words(rng, 400) + part + words(rng, 200)), " ".join(words(rng, 30) + part + words(rng, 500))]
    df = frame(spark, [doc(i, t) for i, t in enumerate(texts)])
    cut = substring_dedup.sampled
    monkeypatch.setattr(substring_dedup, "sampled", lambda *a: cut(*a, places=60))
    found = [r for r in substring_dedup.passage_report(df).collect() if r.n_removed]
    assert [(r.doc_id, r.source_docs) for r in found] == [(1, [0])] and 88 <= found[0].n_removed <= 96


def test_alignment_counts():
    x = np.arange(100, dtype=np.uint32)
    y = np.concatenate([x[:40], np.array([900, 901], np.uint32), x[40:]])
    lo, hi, a_lo, a_hi, good, columns = chaining.align_chain(x, y, [(10, 10, 20), (60, 62, 20)])
    assert (lo, hi, a_lo, a_hi, good, columns) == (0, 100, 0, 102, 100, 102)


def edited(rng, w, every):
    out = []
    for i, x in enumerate(w):
        if i % every == every // 2:
            kind = rng.randrange(3)
            if kind == 0:
                out.append("edit" + str(rng.randrange(10**6)))
            elif kind == 1:
                out += [x, "extra" + str(rng.randrange(10**6))]
        else:
            out.append(x)
    return out


def test_fuzzy_passages_are_found_and_clean_texts_left(spark):
    rng = random.Random(6)
    rows, planted = [], {}
    passages = [words(rng, 80, 50_000) for _ in range(10)]
    for i in range(200):
        w = words(rng, rng.randrange(20, 150), 50_000)
        if i % 4 == 0:
            p = passages[i // 4 % 10]
            at = rng.randrange(len(w))
            mid = p if i < 40 else edited(rng, p, 20)
            w[at:at] = mid
            planted[i] = (at, at + len(mid))
        rows.append(doc(i, " ".join(w)))
    rows += [doc(300, rows[4][1]), doc(301, " ".join(words(rng, 12, 50_000) * 9))]
    df = clashing(frame(spark, rows), ["seed", "chain", "ord", "n_words", "spans"])
    got = {r.doc_id: r for r in substring_dedup.passage_report(df).collect()}
    assert len(got) == len(rows)
    for i in range(200):
        r = got[i]
        if i in planted and i >= 40:
            lo, hi = planted[i]
            covered = sum(max(0, min(hi, s.end_word) - max(lo, s.first_word)) for s in r.spans)
            assert covered >= 0.7 * (hi - lo) and r.n_removed <= hi - lo + 4 and r.source_docs, (i, r)
        else:
            assert r.n_removed == 0 and not r.source_docs, (i, r)
    assert got[300].n_removed == got[300].n_words and got[300].source_docs == [4]
    assert got[301].n_removed >= 80 and got[301].source_docs == [301]
    out = {r.doc_id: r.text for r in substring_dedup.remove_passages(df).collect()}
    assert out[1] == rows[1][1] and out[300] == ""
    assert all(len(out[i].split()) == got[i].n_words - got[i].n_removed for i in got)


def test_fuzzy_odd_input(spark):
    rows = odd_docs()
    got = substring_dedup.passage_report(frame(spark, rows)).collect()
    assert sorted(((r.doc_id, r.n_words) for r in got), key=repr) == sorted(((r[0], len((r[1] or "").split())) for r in rows), key=repr)
    assert {r.doc_id for r in got if r.n_removed} == {8} and [r.n_removed for r in got if r.doc_id == 8] == [60_000]
    assert substring_dedup.passage_report(frame(spark, [])).count() == 0


def test_order_of_repeated_ids(spark):
    rows = [doc(2, "b"), doc(1, "a"), doc(2, "b"), (None, "c", None, None, None)]
    o = ordered(frame(spark, rows)).orderBy("ord").collect()
    assert [r.doc_id for r in o] == [1, 2, 2, None] and len({r.ord for r in o}) == 4


def brute_longest(equal, share):
    best = 0
    for i in range(len(equal)):
        for j in range(i + 1, len(equal) + 1):
            if equal[i] and equal[j - 1] and sum(equal[i:j]) >= share * (j - i):
                best = max(best, j - i)
    return best


def test_longest_good_range_matches_brute_force():
    rng = random.Random(8)
    for _ in range(300):
        equal = np.array([int(rng.random() < 0.75) for _ in range(rng.randrange(1, 40))])
        lo, hi = chaining._longest(equal, 0.8)
        if hi > lo:
            assert equal[lo] and equal[hi - 1] and equal[lo:hi].sum() >= 0.8 * (hi - lo)
        # trimming its ends can only shorten a range that was longest before
        assert (hi > lo) == (brute_longest(equal.tolist(), 0.8) > 0)


def test_good_run_beside_a_bad_gap_is_kept(spark):
    """60 equal words, 22 different ones, 25 equal ones: the run stays a copy."""
    rng = random.Random(9)
    rows, at = [], {}
    for i in range(20):
        head, foot = words(rng, 60, 50_000), words(rng, 25, 50_000)
        for j in range(2):
            lead = words(rng, 30, 50_000)
            at[2 * i + j] = len(lead)
            rows.append(doc(2 * i + j, " ".join(lead + head + words(rng, 22, 50_000) + foot + words(rng, 30, 50_000))))
    got = {r.doc_id: r for r in substring_dedup.passage_report(frame(spark, rows)).collect()}
    for i in range(20):
        r, lo = got[2 * i + 1], at[2 * i + 1]
        assert sum(max(0, min(lo + 60, s.end_word) - max(lo, s.first_word)) for s in r.spans) >= 58, (i, r)
        assert got[2 * i].n_removed == 0


def test_passages_with_a_changed_word_every_eight_are_found(spark):
    rng = random.Random(10)
    rows, at = [], {}
    for i in range(60):
        p = words(rng, 64, 50_000)
        changed = [x if j % 8 != 4 else f"edit{rng.randrange(10**6)}" for j, x in enumerate(p)]
        for j, q in enumerate((p, changed)):
            lead = words(rng, 30, 50_000)
            at[2 * i + j] = len(lead)
            rows.append(doc(2 * i + j, " ".join(lead + q + words(rng, 30, 50_000))))
    got = {r.doc_id: r for r in substring_dedup.passage_report(frame(spark, rows)).collect()}
    found = [i for i in range(60) if got[2 * i + 1].n_removed >= 56 and got[2 * i + 1].source_docs == [2 * i]]
    assert len(found) >= 57
    assert all(got[2 * i].n_removed == 0 for i in range(60))


def test_copies_whose_parts_first_occur_elsewhere(spark):
    """b copies c whole; both halves of the passage occur in earlier
    documents, in one half after the other or overlapping."""
    rng = random.Random(11)
    rows, copies = [], []
    for i in range(20):
        p = words(rng, 80, 50_000)
        parts = [p[:40], p[40:]] if i % 2 else [p[:42], p[20:62], p[38:]]
        for part in parts:
            rows.append(doc(len(rows), " ".join(words(rng, 30, 50_000) + part + words(rng, 30, 50_000))))
        for _ in range(2):
            rows.append(doc(len(rows), " ".join(words(rng, 30, 50_000) + p + words(rng, 30, 50_000))))
        copies.append(len(rows) - 1)
    got = {r.doc_id: r for r in substring_dedup.passage_report(frame(spark, rows)).collect()}
    for i in copies:
        assert 78 <= got[i].n_removed <= 84 and got[i].source_docs == [i - 1], got[i]
    assert sum(r.n_removed for r in got.values()) == sum(got[i].n_removed for i in copies)


def test_run_keys_name_equal_runs():
    rng = np.random.default_rng(2)
    seed = rng.integers(-2**62, 2**62, 30)
    pos = np.cumsum(rng.integers(1, 5, 30))
    ord_ = np.repeat([1, 2, 3], [30, 30, 10])
    keys = substring_dedup.run_keys(ord_, np.concatenate([pos, pos + 7, pos[:10]]), np.concatenate([seed, seed, seed[:10]]), 5, 4, 50)
    for k, far in zip(keys, (2, 6, None)):
        assert (k[:30] == k[30:60]).all()
        alive = k[:30][k[:30] != 0]
        assert len(set(alive.tolist())) == len(alive)
        if far:
            assert len(alive) == 31 - far and (k[60:71 - far] == k[:11 - far]).all() and not k[71 - far:].any()
    assert [int(x) for x in np.flatnonzero(keys[2][:30])] == [i for i in range(30) if pos[-1] + 5 - pos[i] >= 50]


def test_probe_stops_only_where_the_alignment_does():
    rng = np.random.default_rng(4)
    for _ in range(2000):
        x = rng.integers(0, 10**6, 140, dtype=np.uint32)
        y = np.where(rng.random(140) < rng.choice([0.02, 0.1, 0.3, 0.9]), rng.integers(0, 10**6, 140, dtype=np.uint32), x)
        y[66:72] = x[66:72]
        near = slice(56, 82)
        if not chaining.goes_on(x[near], y[near], [(10, 10, 6)], 50):
            assert not list(chaining.good_passages(x, y, [(66, 66, 6)], 50, 0.8))
            assert chaining.align_chain(x, y, [(66, 66, 6)])[4:] == chaining.align_chain(x[near], y[near], [(10, 10, 6)])[4:]


def test_first_of_equals_matches_brute_force():
    rng = np.random.default_rng(12)
    for n in (0, 1, 2, 7, 300):
        for wide in (1, 4, 400):
            key = np.sort(rng.integers(0, wide, n))
            ord_ = np.arange(n) // 3
            cols = [key, ord_, np.arange(n), key * 5]
            edge = np.unique(np.concatenate([[0, n], rng.integers(0, n + 1, 9)]))
            batches = [pa.RecordBatch.from_arrays([pa.array(c[lo:hi]) for c in cols], names=list("kopx")) for lo, hi in zip([0, *edge[:-1]], edge)]
            got = [r for c, a, p in substring_dedup.first_of_equals(iter(batches)) for r in zip(*(x.tolist() for x in (*c, a, p)))]
            first = {k: i for i, k in reversed(list(enumerate(key.tolist())))}
            assert got == [(k, i // 3, i, 5 * k, first[k] // 3, first[k]) for i, k in enumerate(key.tolist()) if (key == k).sum() > 1]


def test_seeds_that_no_other_text_has_are_not_stored(spark, monkeypatch):
    """They are most of the seeds: stored and moved twice, they filled the disk."""
    rng = random.Random(13)
    own = [doc(i, " ".join(words(rng, 400, 10**6))) for i in range(30)]
    part = words(rng, 80, 10**6)
    rows = own + [doc(30 + i, " ".join(words(rng, 20, 10**6) + part)) for i in range(2)]
    stored, keep = {}, substring_dedup.materialize
    def count(df, name):
        out = keep(df, name)
        stored[name] = out.count()
        return out
    monkeypatch.setattr(substring_dedup, "materialize", count)
    got = {r.doc_id: r.n_removed for r in substring_dedup.passage_report(frame(spark, rows)).collect()}
    assert got[31] >= 78 and sum(got.values()) == got[31]
    assert 0 < max(stored.values()) <= 2 * 80
