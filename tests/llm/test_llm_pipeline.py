"""The corpus pipeline stage by stage, and the package's isolation."""

import os
import random
import re

from llm_helpers import DOC_SCHEMA, doc, frame, odd_docs

import corpus_pipeline as cp
from marketspark.llm import simhash
from test_llm_packing import check_pack
from test_llm_simhash import model_fp

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
TEXT = "the quick brown fox jumps over the lazy dog and then it runs through this forest with all of those other animals".split()


def corpus():
    rng = random.Random(12)
    rows = []
    for i in range(150):
        lines = [" ".join(rng.choice(TEXT) + str(rng.randrange(50)) * (k % 4 == 0) for k in range(rng.randrange(20, 60))) for _ in range(3)]
        if i % 2 == 0:
            lines.append("All rights reserved by the site")
        rows.append(doc(i, "\n".join(lines), "hot" if i % 3 == 0 else f"s{i % 2}"))
    rows += [doc(200 + k, rows[7][1], "s1") for k in range(5)]          # copies
    return rows + [doc(300, "1234 !!! ???", "s1"), doc(301, None, "s1"), doc(302, "", "hot"), doc(None, "a text that has no id at all here", "s0")]


def test_stages_in_order():
    assert [n for n, _ in cp.STAGES] == ["language_id", "line_dedup", "simhash_dedup", "mix_sources", "pack"]
    assert cp.ORACLE_SQL is None


def test_stages_take_effect(spark):
    rows = corpus()
    docs = frame(spark, rows)
    columns = docs.columns
    kept = {}
    for name, stage in cp.STAGES[:4]:
        out = stage(spark, docs, "/nowhere")
        assert out.columns == columns and out.dtypes == docs.dtypes, name
        data = [tuple(r) for r in out.collect()]
        kept[name] = data
        docs = spark.createDataFrame(data, DOC_SCHEMA)
    # 8: documents without a language go, clean ones stay
    ids = [r[0] for r in kept["language_id"]]
    assert not {300, 301, 302} & set(ids) and set(range(150)) <= set(ids) and None in ids
    # 1: the sites' shared line goes from every page, nothing else does
    source = {r[0]: r[1] for r in rows}
    for r in kept["line_dedup"]:
        want = "\n".join(x for x in source[r[0]].split("\n") if x != "All rights reserved by the site")
        assert r[1] == want and r[4] == len(want)
    # 7: one document of each group
    before = {r[0]: model_fp(r[1]) for r in kept["line_dedup"]}
    after = [r[0] for r in kept["simhash_dedup"]]
    assert len(after) == len(set(after)) and 7 in after and not set(range(200, 205)) & set(after)
    for i in before.keys() - set(after):
        assert any((before[i] ^ before[j]).bit_count() <= simhash.MAX_BITS * len(before) for j in after if j is not None and j < i)
    # 10: words come from their documents, at most twice each
    text = {r[0]: r[1] for r in kept["simhash_dedup"]}
    words_out = {}
    for r in kept["mix_sources"]:
        assert set(r[1].split()) <= set(text[r[0]].split())
        words_out[r[0]] = words_out.get(r[0], 0) + len(r[1].split())
    assert all(n <= 2 * len(text[i].split()) for i, n in words_out.items())
    total = sum(len(t.split()) for t in text.values())
    assert abs(sum(words_out.values()) - 1.5 * total) <= 0.05 * total
    # 4: every token of the mix is packed once
    out = cp.STAGES[4][1](spark, docs, "/nowhere").collect()
    check_pack(kept["mix_sources"], out, 2048)


def test_run_on_files_and_odd_rows(spark, tmp_path):
    frame(spark, corpus() + odd_docs()).write.parquet(str(tmp_path / "documents.parquet"))
    out = cp.run(spark, str(tmp_path))
    assert {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"} <= set(out.columns)
    assert out.count() > 100
    empty = tmp_path / "none"
    frame(spark, []).write.parquet(str(empty / "documents.parquet"))
    assert cp.run(spark, str(empty)).count() == 0


def test_other_columns_pass_through_whatever_their_names(spark):
    from pyspark.sql import functions as F
    names = ["score", "n_lines", "lang_pred", "n_dropped", "pass", "size", "fp", "component_id", "_n", "Score2", "held_out", "words"]
    docs = frame(spark, corpus()[:60] + corpus()[-6:])
    for i, n in enumerate(names):
        docs = docs.withColumn(n, F.concat(F.lit(f"{n}-"), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))) if i % 2 else F.lit(777.0) + F.col("doc_id"))
    for name, stage in cp.STAGES[:4]:
        out = stage(spark, docs, "/nowhere")
        assert out.dtypes == docs.dtypes, name
        for r in out.collect():
            d = r["doc_id"]
            for i, n in enumerate(names):
                assert r[n] == (f"{n}-{'none' if d is None else d}" if i % 2 else None if d is None else 777.0 + d), (name, n)
        docs = spark.createDataFrame(out.collect(), docs.schema)


def test_texts_under_one_id_are_told_apart(spark):
    rows = [doc(1, "one text about something quite different from the rest of it"), doc(1, "a second text under the same number with other words in it"),
            doc(2, "a third text that nobody else has written down anywhere so far"), doc(2, "a third text that nobody else has written down anywhere so far"),
            doc(3, "one text about something quite different from the rest of it"), doc(None, "one text about something quite different from the rest of it")]
    got = sorted(((r[0], r[1][:9]) for r in simhash.keep_one(frame(spark, rows)).collect()), key=repr)
    assert got == [(1, "a second "), (1, "one text "), (2, "a third t"), (None, "one text ")]


def test_nothing_else_imports_this_package():
    for folder, _, files in os.walk(os.path.join(ROOT, "marketspark")):
        if os.path.basename(folder) == "llm" or "__pycache__" in folder:
            continue
        for f in files:
            if f.endswith(".py"):
                with open(os.path.join(folder, f), encoding="utf-8") as h:
                    assert not re.search(r"\bllm\b", h.read()), f


