"""Packing: round trip of ids, gapless places, the rule by brute force."""

import random
import zlib

import numpy as np
from llm_helpers import clashing, doc, frame, odd_docs, words

from marketspark.llm import common, packing


def tokenizer():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(packing.default_tokenizer_path())


TRICKY = ["Hello, WORLD. it's the dog's... 3.14 a.b,c", "naïve Élan. ÀÉÎ, ×. ÷, a×.b", "<|endoftext|> x<|startoftext|>.y", "é.é,  nbsp em.\u0085nel",
          "日本語。テスト, ok.", "don't. 'll. I'VE, we're", "a̧. İ.İ, ς.Σ,", "...,,, .a ,b .,", "\x00\x01 \x1c\x1d"]


def test_ids_equal_the_tokenizer():
    rng = random.Random(1)
    texts = TRICKY + [" ".join(words(rng, 50)) for _ in range(20)] + ["", "  "]
    tok = tokenizer()
    flat, lens = packing.encode_ids([t.encode() for t in texts], packing.default_tokenizer_path())
    at = 0
    for t, n in zip(texts, lens.tolist()):
        assert flat[at:at + n].tolist() == tok.encode(t, add_special_tokens=False).ids, t
        at += n
    assert at == len(flat)


def test_a_reused_worker_drops_the_encoder():
    path = packing.default_tokenizer_path()

    def run(batches):
        for b in batches:
            yield packing.encode_ids([b], path)[1].tolist()

    common.drop_kept()
    assert list(common.tidy(run, "packing")([b"one two"])) == [[2]]
    met = common.kept("packing")["encoder"].words.code
    assert set(met) == {b"one", b"two"}
    list(common.tidy(run, "packing")([b"one"]))             # the operator's next task finds it
    assert common.kept("packing")["encoder"].words.code is met
    list(common.tidy(iter)([]))                             # another operator's task does not
    assert not common.kept("packing")


def slow_rule(lengths, capacity):
    bins, out = [], []
    for s in lengths:
        def cost(gaps):
            c = {}
            for g in gaps:
                if 0 < g < capacity:
                    c[g] = c.get(g, 0) + 1
            return sum(v * v for v in c.values())
        options = [(cost(bins + [capacity - s]), 1, 0)]
        for g in sorted(set(bins)):
            if s <= g:
                rest = list(bins)
                rest.remove(g)
                options.append((cost(rest + [g - s]), 0, g))
        best = min(options)
        out.append(best[0])
        if best[1]:
            bins.append(capacity - s)
        else:
            bins.remove(best[2])
            bins.append(best[2] - s)
    return out, len(bins)


def test_sum_of_squares_rule():
    rng = random.Random(6)
    for _ in range(30):
        lengths = [rng.randrange(1, 21) for _ in range(60)]
        bins, offsets = packing.sum_of_squares(np.array(lengths), 20)
        fill = {}
        costs = []
        for s, b, o in zip(lengths, bins.tolist(), offsets.tolist()):
            assert o == fill.get(b, 0)
            fill[b] = o + s
            c = {}
            for v in fill.values():
                if v < 20:
                    c[20 - v] = c.get(20 - v, 0) + 1
            costs.append(sum(x * x for x in c.values()))
        assert max(fill.values()) <= 20
        want, n = slow_rule(lengths, 20)
        assert costs == want and len(fill) == n


def check_pack(rows, out, capacity):
    tok = tokenizer()
    want = []
    for r in rows:
        ids = tok.encode(r[1] or "", add_special_tokens=False).ids + [0]
        for p, s in enumerate(range(0, len(ids), capacity)):
            part = ids[s:s + capacity]
            want.append((r[0], p, s, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    assert sorted(((x.doc_id, x.piece, x.start, x.length, x.ids_crc32) for x in out), key=repr) == sorted(want, key=repr)
    seqs = {}
    for x in out:
        seqs.setdefault(x.sequence_id, []).append((x.offset, x.length))
    for parts in seqs.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= capacity
    return len(seqs), sum(x.length for x in out)


def test_pack_documents(spark):
    rng = random.Random(8)
    rows = [doc(i, " ".join(words(rng, rng.randrange(1, 120)))) for i in range(300)] + odd_docs()
    df = clashing(frame(spark, rows), ["piece", "length", "sequence_id", "offset"])
    n, total = check_pack(rows, packing.pack_documents(df, sequence_tokens=256).collect(), 256)
    assert n <= 1.03 * total / 256 + 2
    # several tasks and rounds give the same guarantees
    n2, _ = check_pack(rows, packing.pack_documents(df, sequence_tokens=256, task_pieces=120).collect(), 256)
    assert n2 <= 1.06 * total / 256 + 4
    a = packing.pack_documents(df, sequence_tokens=256, task_pieces=120).orderBy("doc_id", "piece", "sequence_id", "offset").collect()
    b = packing.pack_documents(df.repartition(3), sequence_tokens=256, task_pieces=120).orderBy("doc_id", "piece", "sequence_id", "offset").collect()
    assert a == b


def test_sequences_hold_the_ids(spark):
    rows = [doc(1, "one two three."), doc(2, "four five"), doc(None, "no id"), doc(3, None)]
    tok = tokenizer()
    texts = {r[0]: r[1] or "" for r in rows}
    for s in packing.sequences(frame(spark, rows), sequence_tokens=8).collect():
        at = 0
        for p in s.pieces:
            ids = tok.encode(texts[p.doc_id], add_special_tokens=False).ids + [0]
            part = ids[p.piece * 8:p.piece * 8 + 8]
            assert s.ids[at:at + len(part)] == part and p.offset == at
            at += len(part)
        assert at == len(s.ids) <= 8


def test_empty(spark):
    assert packing.pack_documents(frame(spark, [])).count() == 0
