"""Language ID and license scans by brute force."""

import random
from collections import Counter

from llm_helpers import clashing, doc, frame, odd_docs, words

from marketspark.llm import lang_id, license_scan

SAMPLES = {"en": "the quick brown fox jumps over the lazy dog and then it runs through this forest with all of those other animals",
           "de": "der schnelle braune fuchs springt über den faulen hund und läuft dann durch diesen wald mit allen anderen tieren",
           "es": "el rápido zorro marrón salta sobre el perro perezoso y luego corre por este bosque con todos los otros animales"}


def language_rows(n=90, seed=2):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        lang = sorted(SAMPLES)[i % 3]
        w = SAMPLES[lang].split()
        out.append(doc(i, " ".join(rng.choice(w) for _ in range(rng.randrange(8, 40))) + " 123 !?", "s", lang))
    return out


def slow_profile(texts, size):
    c = Counter(g for t in texts for w in lang_id.text_words(t) for g in lang_id.word_grams(w))
    return [g for g, _ in sorted(c.items(), key=lambda x: (-x[1], x[0]))][:size]


def test_profiles_and_predictions_match_brute_force(spark):
    rows = language_rows() + [r for r in odd_docs() if r[2] is None]
    df = frame(spark, rows)
    profiles = lang_id.train(df, profile_size=60)
    want = {lang: slow_profile([r[1] for r in rows if r[2] == lang and r[1] is not None], 60) for lang in SAMPLES}
    assert profiles == want
    test = language_rows(30, seed=9) + odd_docs() + [doc(77, "x² = ½"), doc(78, "² ½ ³")]
    got = lang_id.predict(clashing(frame(spark, test), ["score", "LANG_PRED", "words"]), profiles, profile_size=60)
    assert got.columns == ["doc_id", "lang", "source", "n_chars", "words", "lang_pred", "score"]
    model = []
    for r in test:
        top = slow_profile([r[1]], 60) if any(c.isalpha() for c in r[1] or "") else []
        if not top:
            model.append((r[0], "und", 0.0))
            continue
        d = lang_id.distances(top, profiles, 60)
        best = min(sorted(d), key=d.get)
        model.append((r[0], best, round(1 - d[best] / (60 * len(top)), 9)))
    assert sorted(((r.doc_id, r.lang_pred, round(r.score, 9)) for r in got.collect()), key=repr) == sorted(model, key=repr)


def test_held_out_accuracy(spark):
    import os
    import sys
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
    from marketspark.llm.queries import op8_lang_id
    sf = "/root/testdata/sf0.001"
    got = op8_lang_id(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert len(held) > 20 and sum(r.lang == r.lang_pred for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in got)


def test_training_is_bounded_and_null_safe(spark):
    rows = language_rows(60) + [doc(None, "nur ein text ohne nummer", "s", "de"), doc(1000, "x y", "s", None), doc(1001, None, "s", "en")]
    p = lang_id.train(frame(spark, rows), train_rows=5, profile_size=30)
    assert sorted(p) == ["de", "en", "es"] and all(len(v) <= 30 for v in p.values())
    empty = frame(spark, [])
    assert lang_id.train(empty) == {}
    assert lang_id.predict(empty, {}).count() == 0
    assert [r.lang_pred for r in lang_id.predict(frame(spark, [doc(1, "abc")]), {}).collect()] == ["und"]


def slow_scan(text, templates, k=5, least=0.8):
    """Licenses whose shingles are contained enough in some window of the
    scanner's size, by looking at every window start."""
    w = license_scan.words_of(text)
    out = set()
    for name, texts in templates.items():
        for t in texts:
            tw = license_scan.words_of(t)
            size = max(8, 1 << (len(tw) - 1).bit_length())
            want = set(license_scan.shingles_of(tw, k))
            for s in range(0, max(1, len(w)), size):
                part = w[s:s + 2 * size]
                have = set(license_scan.shingles_of(part, k))
                if len(tw) < k:
                    have |= {" ".join(part[i:i + len(tw)]) for i in range(len(part))}
                if len(want & have) >= least * len(want):
                    out.add(name)
    return out


TEMPLATES = license_scan.TEMPLATES | {"Short": ["public domain dedication"]}


def test_scan_matches_brute_force(spark):
    rng = random.Random(3)
    notices = [t for v in TEMPLATES.values() for t in v]
    rows = []
    for i in range(150):
        body = words(rng, rng.randrange(5, 120))
        if i % 3:
            w = rng.choice(notices).split()
            if i % 5 == 0 and len(w) > 20:              # an edited notice
                w[len(w) // 2] = "edited"
            if i % 7 == 0:
                w = w[: max(3, len(w) // 2)]            # half a notice
            at = rng.randrange(len(body) + 1)
            body[at:at] = w
        rows.append(doc(1000 + i, " ".join(body)))
    rows += odd_docs()
    got = {}
    for r in license_scan.scan_licenses(clashing(frame(spark, rows), ["matches", "license"]), TEMPLATES).collect():
        got.setdefault((r.doc_id, r.n_matches), []).append(sorted({m.license for m in r.matches}))
        for m in r.matches:
            assert 0.8 <= m.containment <= 1.0 and m.first_word < m.end_word
    hits = 0
    for r in rows:
        want = slow_scan(r[1], TEMPLATES)
        mine = next(v for (i, _), v in got.items() if i == r[0])[0]
        assert set(mine) <= want and bool(mine) == bool(want), (r[1], mine, want)   # overlapping notices: the best stands
        hits += bool(mine)
    assert hits > 60


def test_best_of_overlapping_notices(spark):
    rows = [doc(1, "Some words. This work is licensed under the GNU General Public License, version 3. More."), doc(2, "Released under the MIT License.")]
    got = {r.doc_id: [m.license for m in r.matches] for r in license_scan.scan_licenses(frame(spark, rows)).collect()}
    assert got == {1: ["GPL-3.0"], 2: ["MIT"]}
    assert license_scan.scan_licenses(frame(spark, [])).count() == 0


def test_bands_guarantee():
    for j in (0.05, 0.2, 0.5, 0.9):
        bands, rows = license_scan.bands_for(j, 128, 1e-6)
        assert bands * rows <= 128
        assert (1 - j ** rows) ** bands <= 1e-6 or rows == 1
