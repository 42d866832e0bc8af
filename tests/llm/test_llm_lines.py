"""Line dedup and quality rules against plain-Python counts."""

import pytest
import random
import re

from llm_helpers import clashing, doc, frame, odd_docs, words

from marketspark.llm import line_dedup, quality_rules


def norm(line):
    return re.sub(r"[\x20\x09-\x0d]+", " ", line.lower()).strip(" ")


def hosted(seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(240):
        lines = [" ".join(words(rng, 9)) for _ in range(3)]
        host = f"s{i % 3}" if i % 3 else "hot"
        if rng.random() < 0.4:
            lines.insert(1, "Subscribe  to our\tNEWSLETTER" if i % 2 else "subscribe to our newsletter ")
        if host == "s1" and rng.random() < 0.15:
            lines.append("Share this page")
        rows.append(doc(i, "\n".join(lines), host))
    return rows


def test_line_dedup_matches_brute_force(spark):
    rows = hosted() + odd_docs()
    got = line_dedup.drop_boilerplate(frame(spark, rows), ratio=0.1, min_pages=10).collect()
    pages, n = {}, {}
    for r in rows:
        if r[3] is not None:
            n[r[3]] = n.get(r[3], 0) + 1
            for k in {norm(x) for x in (r[1] or "").split("\n")} - {""}:
                pages[r[3], k] = pages.get((r[3], k), 0) + 1
    bad = {k for k, c in pages.items() if c >= 10 and n[k[0]] >= 10 and c > 0.1 * n[k[0]]}
    assert any(k[1] == "subscribe to our newsletter" for k in bad)

    def model(r):
        if r[1] is None:
            return (r[0], r[3], None, 0, 0)
        lines = r[1].split("\n")
        kept = [x for x in lines if (r[3], norm(x)) not in bad]
        return (r[0], r[3], "\n".join(kept), len(lines), len(lines) - len(kept))

    key = repr
    assert sorted(((r.doc_id, r.source, r.text, r.n_lines, r.n_dropped) for r in got), key=key) == sorted(map(model, rows), key=key)


def test_line_dedup_keeps_columns_and_replaces_clashes(spark):
    df = clashing(frame(spark, hosted()), ["key", "n_dropped", "pages", "host"])
    out = line_dedup.drop_boilerplate(df)
    assert sorted(out.columns) == sorted([c for c in df.columns if c != "n_dropped"] + ["n_lines", "n_dropped"])
    assert out.count() == 240


def test_empty_tables(spark):
    empty = frame(spark, [])
    assert line_dedup.drop_boilerplate(empty).count() == 0
    assert quality_rules.quality(empty).count() == 0


def model_counts(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0d]+", t)
    grams = {}
    for i in range(len(w) - 7):
        grams.setdefault(tuple(w[i:i + 8]), []).append(i)
    covered = {i + k for at in grams.values() if len(at) > 1 for i in at for k in range(8)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0d]", x)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered))


def test_quality_base_counts_match_brute_force(spark):
    rng = random.Random(3)
    texts = [" ".join(words(rng, rng.randrange(60), vocab=3)) for _ in range(60)]
    texts += ["a b c d e f g h " * 4, "#*$ %&|<> x\nx\nx\n \n", "one line\none line\nother"]
    rows = [doc(100 + i, t) for i, t in enumerate(texts)] + odd_docs()
    got = quality_rules.quality(clashing(frame(spark, rows), ["n_words", "kept", "key"])).collect()
    mine = sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got), key=repr)
    assert mine == sorted(((r[0], *model_counts(r[1])) for r in rows), key=repr)
    for r in got:
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert r.kept == (not r.base_failed and not r.depleted)


def test_quality_rejects_depleted_keeps_copies(spark):
    rng = random.Random(5)
    banner = " ".join(words(rng, 30))
    rows = [doc(i, banner + "\n" + " ".join(words(rng, 8 if i < 60 else 80)), "h") for i in range(120)]
    copy = "\n".join(" ".join(words(rng, 30)) for _ in range(3))
    rows += [doc(1000 + i, copy, "h") for i in range(200)]          # one document of its host, many times
    got = {r.doc_id: r for r in quality_rules.quality(frame(spark, rows), max_docs=20, ratio=0.02).collect()}
    assert all(got[i].depleted and not got[i].kept and got[i].words_removed == 30 for i in range(60))
    assert all(got[i].kept and got[i].words_removed == 30 for i in range(60, 120))
    assert all(got[1000 + i].kept and got[1000 + i].words_removed == 0 for i in range(200))


@pytest.mark.parametrize("pages,with_footer,gone", [(5, 5, True), (19, 19, True), (50, 15, True), (50, 5, False), (5, 3, True), (5, 2, False), (2, 2, False)])
def test_small_hosts_lose_their_footer(spark, pages, with_footer, gone):
    """The ratio decides from three pages on."""
    rows = [doc(i, f"own line {i}\nanother {i}" + ("\nfooter of the site" if i < with_footer else "")) for i in range(pages)]
    got = {r["doc_id"]: r["text"] for r in line_dedup.drop_boilerplate(frame(spark, rows)).collect()}
    assert got == {r[0]: r[1].replace("\nfooter of the site", "") if gone else r[1] for r in rows}
