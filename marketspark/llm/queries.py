"""The registered queries of this package: one ``opN_<name>`` per operator,
over the whole table it is meant for, with production parameters, and the
DuckDB SQL for those that SQL can express."""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (bpe_stream, embedding_dedup, lang_id, lexical_search, license_scan, line_dedup, mixing, packing, periodic_runs, quality_rules, simhash, substring_dedup,
               suffix_dedup)
from .common import table

#: the normalised form of a line ``l`` (see lines.norm_line)
_NORM_SQL = "trim(regexp_replace(lower(l), '[\\x20\\x09-\\x0D]+', ' ', 'g'), ' ')"


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their source's boilerplate lines dropped."""
    out = line_dedup.drop_boilerplate(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "source", "n_lines", "n_dropped", "text")


OP1_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, text FROM documents),
ln AS (SELECT rid, source, i, l, {_NORM_SQL} AS k FROM (
  SELECT rid, source, unnest(string_split(text, chr(10))) AS l,
         unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM d WHERE text IS NOT NULL)),
hosts AS (SELECT source, count(*) AS pages FROM d WHERE source IS NOT NULL GROUP BY source),
bad AS (SELECT source, k FROM (SELECT source, k, count(DISTINCT rid) AS n FROM ln WHERE k <> '' GROUP BY ALL) JOIN hosts USING (source)
  WHERE pages >= {line_dedup.MIN_PAGES} AND n >= {line_dedup.MIN_PAGES} AND n > {line_dedup.BOILERPLATE_RATIO} * pages),
marked AS (SELECT ln.*, bad.k IS NOT NULL AS gone FROM ln LEFT JOIN bad USING (source, k)),
done AS (SELECT rid, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  coalesce(string_agg(l, chr(10) ORDER BY i) FILTER (NOT gone), '') AS text FROM marked GROUP BY rid)
SELECT d.doc_id, d.source, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_dropped, 0) AS BIGINT) AS n_dropped,
  done.text AS text FROM d LEFT JOIN done USING (rid)"""


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and the cross-document verdict of every document."""
    return quality_rules.quality(table(spark, sf_dir, "documents"))


OP2_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, text FROM documents),
w AS (SELECT rid, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM (
  SELECT rid, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS ws FROM d WHERE text IS NOT NULL)),
win AS (SELECT rid, i, string_agg(w, ' ') OVER f AS g, count(*) OVER f AS n FROM w
  WINDOW f AS (PARTITION BY rid ORDER BY i ROWS BETWEEN CURRENT ROW AND {quality_rules.WINDOW - 1} FOLLOWING)),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM win WHERE n = {quality_rules.WINDOW}) WHERE c > 1),
rep AS (SELECT rid, count(DISTINCT i + k) AS n_repeat_words FROM twice, range({quality_rules.WINDOW}) r(k) GROUP BY rid),
wc AS (SELECT rid, count(*) AS n_words, sum(length(w)) AS word_chars FROM w GROUP BY rid),
ln AS (SELECT rid, source, i, l, {_NORM_SQL} AS k FROM (
  SELECT rid, source, unnest(string_split(text, chr(10))) AS l,
         unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM d WHERE text IS NOT NULL)),
dup AS (SELECT rid, count(*) - count(DISTINCT l) AS n_dup_lines FROM ln WHERE k <> '' GROUP BY rid),
content AS (SELECT min(rid) AS rid, source FROM (SELECT rid, source, {_NORM_SQL} AS c FROM (SELECT rid, source, text AS l FROM d WHERE text IS NOT NULL AND source IS NOT NULL)) GROUP BY source, c),
docs AS (SELECT source, count(*) AS docs FROM content GROUP BY source),
bad AS (SELECT source, k FROM (SELECT source, k, count(DISTINCT rid) AS n FROM ln SEMI JOIN content USING (rid) WHERE k <> '' GROUP BY ALL)
  JOIN docs USING (source) WHERE n > {quality_rules.MAX_DOCS} AND n > {quality_rules.RATIO} * docs),
gone AS (SELECT rid, sum(length(k) - length(replace(k, ' ', '')) + 1) AS words_removed FROM ln JOIN bad USING (source, k) GROUP BY rid),
j AS (SELECT doc_id, CAST(coalesce(n_words, 0) AS BIGINT) AS n_words, CAST(coalesce(word_chars, 0) AS BIGINT) AS word_chars,
  CAST(coalesce(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')), 0) AS BIGINT) AS n_symbols,
  CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
  CAST(coalesce(words_removed, 0) AS BIGINT) AS words_removed
  FROM d LEFT JOIN wc USING (rid) LEFT JOIN rep USING (rid) LEFT JOIN dup USING (rid) LEFT JOIN gone USING (rid)),
v AS (SELECT *, n_words < {quality_rules.MIN_WORDS} OR 100 * n_repeat_words > {quality_rules.MAX_REPEAT_PERCENT} * n_words AS base_failed,
  words_removed > 0 AND (n_words - words_removed < {quality_rules.MIN_WORDS} OR n_words - words_removed < {quality_rules.MIN_SHARE} * n_words) AS depleted FROM j)
SELECT *, NOT base_failed AND NOT depleted AS kept FROM v"""


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and component of every embedding at cosine 0.9."""
    return embedding_dedup.embedding_groups(table(spark, sf_dir, "embeddings"))


OP3_SQL = f"""
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) AS n FROM embeddings),
pairs AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id
  WHERE a.n > 0 AND b.n > 0 AND list_dot_product(a.e, b.e) / (a.n * b.n) >= {embedding_dedup.MIN_COSINE}),
reach(a, b) AS (SELECT vec_id, vec_id FROM v UNION SELECT reach.a, pairs.b FROM reach JOIN pairs ON reach.b = pairs.a),
comp AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
n AS (SELECT a AS vec_id, count(*) AS n_links FROM pairs GROUP BY a)
SELECT vec_id, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept
FROM comp LEFT JOIN n USING (vec_id)"""


def op4_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document tokenised and packed into sequences of 2048 tokens."""
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License notices found in every document: their ids and places."""
    out = license_scan.scan_licenses(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_matches", F.array_join(F.array_sort(F.array_distinct(F.col("matches.license"))), ",").alias("licenses"),
                      F.to_json("matches").alias("matches"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the bytes of 100-byte strings seen earlier."""
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))


OP6_SQL = f"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, i, md5(substring(h, 2 * i + 1, {2 * suffix_dedup.LENGTH})) AS w
  FROM (SELECT doc_id, h, unnest(range(0, greatest(length(h) // 2 - {suffix_dedup.LENGTH - 1}, 0))) AS i FROM d)),
later AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY w ORDER BY doc_id, i) AS r FROM w) WHERE r > 1),
runs AS (SELECT doc_id, i, sum(CASE WHEN p IS NULL OR i > p + {suffix_dedup.LENGTH} THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS run
  FROM (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM later)),
spans AS (SELECT doc_id, min(i) AS lo, max(i) + {suffix_dedup.LENGTH} AS hi FROM runs GROUP BY doc_id, run),
gaps AS (SELECT doc_id, lo, hi, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 0) AS prev FROM spans),
cut AS (SELECT doc_id, sum(hi - lo) AS n_removed, count(*) AS n_spans, max(hi) AS last,
  string_agg(substring(h, 2 * prev + 1, 2 * (lo - prev)), '' ORDER BY lo) AS parts FROM gaps JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
  CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(CASE WHEN last IS NULL THEN h ELSE parts || substring(h, 2 * last + 1) END)) AS kept_sha256
FROM d LEFT JOIN cut USING (doc_id)"""


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash fingerprint and near-duplicate component of every document."""
    g = simhash.simhash_groups(table(spark, sf_dir, "documents"))
    return g.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_lang_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document; fold 1 is held out."""
    docs = table(spark, sf_dir, "documents")
    fold = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    profiles = lang_id.train(docs.where(~fold))
    return lang_id.predict(docs.select("doc_id", fold.alias("held_out"), "text"), profiles)


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of every document that copy earlier ones, fuzzily."""
    out = substring_dedup.passage_report(table(spark, sf_dir, "documents"))
    return out.withColumn("spans", F.to_json("spans"))


def op10_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words every document gives to the mix of its sources."""
    return mixing.mix_report(table(spark, sf_dir, "documents"))


def planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """Every tenth document by the hash of its id repeats itself from one of
    its words on."""
    if doc_id is None or not words:
        return words
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a:a + p] * ((n - a) // p + 1))[:n - a]


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of words of every document, some planted."""
    return periodic_runs.run_report(table(spark, sf_dir, "documents"), edit=planted)


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of every benchmark item."""
    return lexical_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_TERM_SQL = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
OP12_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_TERM_SQL} AS ts FROM documents WHERE text IS NOT NULL),
stat AS (SELECT count(*) AS n_docs, CAST(sum(len(ts)) AS BIGINT) AS n_terms FROM d WHERE len(ts) > 0),
item AS (SELECT DISTINCT item_id, unnest({_TERM_SQL}) AS t FROM benchmark),
tf AS (SELECT rid, t, count(*) AS tf FROM (SELECT rid, unnest(ts) AS t FROM d) SEMI JOIN item USING (t) GROUP BY rid, t),
wt AS (SELECT t, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1))) AS BIGINT) AS w FROM (SELECT t, count(*) AS df FROM tf GROUP BY t), stat),
norm AS (SELECT rid, doc_id, 100 - 90 + (90 * len(ts) * n_docs) // n_terms AS m FROM d, stat WHERE len(ts) > 0),
part AS (SELECT rid, doc_id, t, w * ((1000000000 * tf) // (1000 * tf + 8 * m)) AS s FROM tf JOIN norm USING (rid) JOIN wt USING (t)),
score AS (SELECT item_id, rid, doc_id, CAST(sum(s) AS BIGINT) AS score FROM part JOIN item USING (t) GROUP BY item_id, rid, doc_id HAVING sum(s) > 0),
best AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM score)
SELECT item_id, rank, doc_id, score FROM best WHERE rank <= {lexical_search.TOP_K}"""


def op13_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document and their decoded text, as digests."""
    return bpe_stream.digests(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_line_dedup, op2_quality_rules, op3_embedding_dedup, op4_pack, op5_license_scan, op6_suffix_dedup, op7_simhash, op8_lang_id, op9_substring_dedup,
                                op10_mix, op11_periodic_runs, op12_lexical_search, op13_bpe)}
ORACLES: dict[str, str] = {"op1_line_dedup": OP1_SQL, "op2_quality_rules": OP2_SQL, "op3_embedding_dedup": OP3_SQL, "op6_suffix_dedup": OP6_SQL, "op12_lexical_search": OP12_SQL}


def llm_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def llm_oracles() -> dict[str, str]:
    return dict(ORACLES)
