"""Ranked search against a plain-Python scorer."""

import math
import random
import re

import pytest
from llm_helpers import clashing, doc, frame, odd_docs

from marketspark.llm import lexical_search as S

TERM = re.compile("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, k=10):
    tok = [(d[0], terms(d[1])) for d in docs]
    tok = [t for t in tok if t[1]]
    n_docs, n_terms = len(tok), sum(len(t) for _, t in tok)
    df = {}
    for _, t in tok:
        for x in set(t):
            df[x] = df.get(x, 0) + 1
    out = []
    wanted = {}
    for i, text in items:
        wanted.setdefault(i, set()).update(terms(text))
    for i, ts in wanted.items():
        found = []
        for d, t in tok:
            m = 10 + (90 * len(t) * n_docs) // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[x] + 1))) * ((1_000_000_000 * t.count(x)) // (1000 * t.count(x) + 8 * m)) for x in ts if x in t)
            if score > 0:
                found.append((-score, d is None, d or 0, d))
        out += [(i, r, d, -s) for r, (s, _, _, d) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=repr)


ITEMS = [(1, "Alpha beta, the GAMMA"), (2, None), (3, "... !!"), (4, "w1 w2 w3 w1"), (4, "w9"), (5, "日本語 É é x"), (6, "nowhere tobefound"), (7, "alpha_beta w5-w6")]


def test_against_brute_force_with_odd_documents(spark):
    rng = random.Random(2)
    docs = odd_docs() + [doc(20 + i, " ".join(f"W{rng.randrange(40)}" for _ in range(rng.randrange(1, 60))) + rng.choice(["", ".", "_x", "é"])) for i in range(80)]
    items = frame(spark, ITEMS, "item_id long, text string")
    df = clashing(frame(spark, docs), ["item_id", "rank", "score", "term"])
    assert got(S.search(df, clashing(items, ["doc_id", "score"]))) == brute(docs, ITEMS)


def test_blocks_of_items_change_nothing(spark):
    rng = random.Random(3)
    docs = [doc(i, " ".join(f"t{rng.randrange(50)}" for _ in range(30))) for i in range(60)] + [doc(3, "t1 t1 t2"), doc(3, "t1 t1 t2")]
    items = [(i, " ".join(f"t{rng.randrange(50)}" for _ in range(6))) for i in range(12)]
    df, it = frame(spark, docs), frame(spark, items, "item_id long, text string")
    assert got(S.search(df, it, k=3, max_pairs=10)) == got(S.search(df, it, k=3)) == brute(docs, items, 3)


def test_ties_go_to_the_smaller_id(spark):
    docs = [doc(i, "same text here") for i in (9, 4, 7, None, 4)] + [doc(50 + i, f"other {i}") for i in range(20)]
    assert [r[2] for r in sorted(got(S.search(frame(spark, docs), frame(spark, [(1, "text")], "item_id long, text string"))), key=lambda r: r[1])] == [4, 4, 7, 9, None]


def test_empty_tables(spark):
    docs, items = frame(spark, [doc(1, "a")]), frame(spark, [(1, "a")], "item_id long, text string")
    assert got(S.search(docs.limit(0), items)) == []
    assert got(S.search(docs, items.limit(0))) == []


@pytest.mark.parametrize("seed", range(3))
def test_automaton_counts_whole_terms(seed):
    rng = random.Random(seed)
    text = "".join(rng.choice("abAB é1 ,_") for _ in range(500))
    words = sorted({w.encode() for w in terms(text)} | {b"ab", b"zz"})
    n, tf = S.TermAutomaton(words).count(text.encode())
    assert n == len(terms(text))
    assert {words[i].decode(): c for i, c in tf.items()} == {w: terms(text).count(w) for w in set(terms(text)) & {x.decode() for x in words}}
