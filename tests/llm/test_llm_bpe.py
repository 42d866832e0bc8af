"""The streaming transducer against the tokenizers library."""

import hashlib
import random

import pytest
from llm_helpers import clashing, doc, frame, odd_docs

from marketspark.llm import bpe_stream as B

PATH = B.default_tokenizer_path()


@pytest.fixture(scope="module")
def own():
    return B.Tokenizer(PATH)


@pytest.fixture(scope="module")
def library():
    import os
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer
    return Tokenizer.from_file(PATH)


ODD = ["", " ", "it's 'S 'RE x'rE ''s 's's", "a<|endoftext|>b <|endoftext|><|startoftext|> <|END", "<|endoftext", "ΑΣ ΣΑΣ Σ", "İstanbul ẞ",
       "é ́ ậ 한", "x" * 9000, "ab" * 7000 + "'s", "!?" * 5000 + "'ll", "日本語" * 4000, "é" * 5000,
       "\x00\x01\x1c\x1d a\x1cb", "a b c\u0085d​z", "12345 ½ ² Ⅷ", "😀" * 3000 + "z", "'" * 4095 + "s", "a" * 4095 + "'s x", "a" * 4094 + "'re"]


def texts(seed):
    rng = random.Random(seed)
    alphabet = "abcdefghijklmnopqrstuvwxyzABC 's't.,!?012éÀΣ日<|>̧́\n\t"
    out = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 60))) for _ in range(150)]
    for _ in range(15):         # long words of few letters: merges reach far
        few = rng.sample("thenigarsoudl", 4)
        out.append("".join(rng.choice(few) for _ in range(rng.randrange(3000, 9000))))
    return out


def model(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    return len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


@pytest.mark.parametrize("seed", range(3))
def test_round_trip_equals_the_library(own, library, seed):
    trip = B.RoundTrip(own, remember=50)        # forgets often
    for t in ODD + texts(seed):
        assert trip.digest(t.encode()) == model(library, t), t[:80]


def test_any_cut_of_the_stream_gives_the_same_ids(own, library):
    rng = random.Random(9)
    machine = own.encoder()
    for t in ODD + texts(4):
        ids, i = [], 0
        while i < len(t):
            k = rng.choice((1, 2, 3, 50, 3000))
            ids += machine.feed(t[i:i + k])
            i += k
        assert ids + machine.finish() == library.encode(t, add_special_tokens=False).ids, t[:80]


def test_memory_is_bounded_and_tokens_leave_early(own):
    machine, out = own.encoder(), 0
    for _ in range(200):
        out += len(machine.feed("theninga" * 64))
        assert len(machine._merges.held) <= machine._merges.full + 1 + 8 * 64
    assert out > 20_000


def test_lookahead_is_sufficient_on_small_merge_lists():
    rng = random.Random(5)
    letters = B.byte_letters()
    for _ in range(60):
        known, merges, vocab = list("abc"), [], {c: i for i, c in enumerate(letters)}
        while len(merges) < rng.randrange(2, 12):
            a, b = rng.choice(known), rng.choice(known)
            if a + b not in vocab:
                vocab[a + b] = len(vocab)
                known.append(a + b)
                merges.append((a, b))
        m = B.MergeList({"vocab": vocab, "merges": merges})
        for _ in range(40):
            head = bytes(rng.choice(b"abc") for _ in range(rng.randrange(m.lookahead + 1, m.lookahead + 20)))
            seen = set()
            for _ in range(8):
                tail = bytes(rng.choice(b"abc") for _ in range(rng.randrange(0, 12)))
                at, stable = 0, []
                for t in m.apply(m.symbols(head + tail, last=True)):
                    at += m.length[t]
                    if at > len(head) - m.lookahead:
                        break
                    stable.append(t)
                seen.add(tuple(stable))
            assert len(seen) == 1, (merges, head)


def test_short_and_long_merging_agree(own):
    rng = random.Random(6)
    for _ in range(200):
        raw = bytes(rng.choice(b"thenigarsoudl") for _ in range(rng.randrange(1, 80)))
        ids = own.merges.symbols(raw, last=True)
        assert own.merges._apply_short(ids) == own.merges._apply_long(ids)


def test_improper_merge_list_is_refused():
    vocab = {c: i for i, c in enumerate(B.byte_letters())} | {"abc": 256, "ab": 257}
    with pytest.raises(ValueError):
        B.MergeList({"vocab": vocab, "merges": [("ab", "c"), ("a", "b")]})


def test_byte_level_decoder_is_incremental():
    import public_tokenizers
    from tokenizers import Tokenizer
    path = public_tokenizers.path("byte_bpe_50k.json")
    library, own = Tokenizer.from_file(path), B.Tokenizer(path)
    with pytest.raises(ValueError):
        own.encoder()
    rng = random.Random(8)
    for t in ["naïve 日本語 😀<|endoftext|>x", ""]:
        ids = library.encode(t).ids
        machine = B.Decoder(own)
        assert "".join([*(machine.feed([i]) for i in ids), machine.finish()]) == library.decode(ids, skip_special_tokens=False) == t
    for _ in range(100):        # ids that cut characters
        ids = [rng.randrange(50_257) for _ in range(20)]
        machine = B.Decoder(own)
        assert "".join([*(machine.feed([i]) for i in ids), machine.finish()]) == library.decode(ids, skip_special_tokens=False)


def test_operators_on_odd_documents(spark, library):
    docs = odd_docs()
    df = clashing(frame(spark, docs), ["ids", "n_tokens", "ids_sha256"])
    got = sorted((tuple(r) for r in B.digests(df).collect()), key=repr)
    assert got == sorted(((d[0], *model(library, d[1])) for d in docs), key=repr)
    ids = B.encode(df)
    assert sorted((tuple(r) for r in ids.collect()), key=repr) == sorted(((d[0], library.encode(d[1] or "", add_special_tokens=False).ids) for d in docs), key=repr)
    back = B.decode(ids)
    assert sorted((tuple(r) for r in back.collect()), key=repr) == sorted(((d[0], library.decode(library.encode(d[1] or "", add_special_tokens=False).ids, skip_special_tokens=False)) for d in docs), key=repr)
    assert B.digests(df.limit(0)).collect() == []
