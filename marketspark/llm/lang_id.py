"""Language identification by rank-order n-gram profiles.

A language's profile is the list of its most frequent character n-grams in
order of frequency. A document's most frequent n-grams are ranked the same
way; its out-of-place distance to a profile adds up how far each n-gram is
from its rank there (the maximum for one that is absent), and the nearest
profile names the language.

Defined results for odd input: null text, or text without a letter, is
``und`` with score 0; ties go to the language first in code point order;
null languages are not learned; with nothing to learn from every document
is ``und``; input columns named like the outputs are replaced by them; an
empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import ragged, ship, text_slices, tidy

MAX_GRAM = 3
PROFILE_SIZE = 400
TRAIN_ROWS = 2000          # labelled documents a language learns from at most
UNDETERMINED = "und"
_SLICE_BYTES = 2_000_000
_CACHE_WORDS = 60_000
_WORD = re.compile(r"[^\W\d_]+")


def word_grams(word: str, max_gram: int = MAX_GRAM) -> list[str]:
    """n-grams of a word padded with a mark on both sides, the bare mark
    excluded (what GramIds numbers)."""
    w = f"_{word}_"
    return [w[i:i + n] for n in range(1, max_gram + 1) for i in range(len(w) - n + 1) if w[i:i + n] != "_"]


def gram_key(gram: str) -> int:
    """Up to three code points in 63 bits, the first one on top, so that
    keys sort as the n-grams do by code point."""
    c = [ord(x) for x in gram] + [0] * (3 - len(gram))
    return (c[0] << 42) | (c[1] << 21) | c[2]


def key_gram(key: int) -> str:
    return "".join(chr(c) for c in ((key >> 42), (key >> 21) & 0x1FFFFF, key & 0x1FFFFF) if c)


class GramIds:
    """Numbers words and their n-grams (of up to three code points), and
    remembers the n-grams of each word. Callers clear it when it grows."""

    def __init__(self, max_gram: int = MAX_GRAM):
        if not 1 <= max_gram <= 3:
            raise ValueError("max_gram must be 1, 2 or 3")
        self.max_gram = max_gram
        self.clear()

    def clear(self) -> None:
        self.words: dict[str, int] = {}
        self.grams: dict[int, int] = {}
        self.flat = np.empty(0, dtype=np.int64)
        self.off = np.zeros(1, dtype=np.int64)
        self.keys = np.empty(0, dtype=np.int64)
        self.order = np.empty(0, dtype=np.int64)

    def add(self, words: list[str]) -> np.ndarray:
        known = self.words
        new = [w for w in dict.fromkeys(words) if w not in known]
        if new:
            known.update(zip(new, range(len(known), len(known) + len(new))))
            self._learn(new)
        return np.fromiter(map(known.__getitem__, words), np.int64, len(words))

    def _learn(self, new: list[str]) -> None:
        c = np.frombuffer("".join(f"_{w}_" for w in new).encode("utf-32-le"), dtype="<u4").astype(np.int64)
        lens = np.fromiter(map(len, new), np.int64, len(new)) + 2
        word = np.repeat(np.arange(len(new)), lens)
        left = np.repeat(np.cumsum(lens), lens) - np.arange(len(c))     # characters to the word's end
        parts, owner = [], []
        for n in range(1, self.max_gram + 1):
            at = np.flatnonzero((left >= n) if n > 1 else (left >= 1) & (left < lens[word]) & (left > 1))
            key = c[at] << 42
            if n > 1:
                key |= c[at + 1] << 21
            if n > 2:
                key |= c[at + 2]
            parts.append(key)
            owner.append(word[at])
        key, word = np.concatenate(parts), np.concatenate(owner)
        uniq, inv = np.unique(key, return_inverse=True)
        grams = self.grams
        ids = np.fromiter((grams.setdefault(k, len(grams)) for k in uniq.tolist()), np.int64, len(uniq))
        self.flat = np.concatenate([self.flat, ids[inv[np.argsort(word, kind="stable")]]])
        self.off = np.concatenate([self.off, self.off[-1] + np.cumsum(np.bincount(word, minlength=len(new)))])
        if len(grams) > len(self.keys):
            self.keys = np.fromiter(grams, np.int64, len(grams))
            self.order = np.empty(len(grams), dtype=np.int64)
            self.order[np.argsort(self.keys)] = np.arange(len(grams))

    def counts(self, code: np.ndarray) -> np.ndarray:
        """How often each n-gram occurs in the words numbered code."""
        uniq, n = np.unique(code, return_counts=True)
        lens = self.off[uniq + 1] - self.off[uniq]
        return np.bincount(self.flat[ragged(self.off[uniq], lens)], weights=np.repeat(n, lens))


def text_words(text: str | None) -> list[str]:
    """Lower-cased words of a text; none if no character is a letter (the
    pattern alone would take a superscript digit for one)."""
    words = _WORD.findall(text.lower()) if text else []
    return words if any(c.isalpha() for w in words for c in w) else []


def top_grams(code: np.ndarray, ids: GramIds, size: int) -> np.ndarray:
    """The size most frequent n-grams (ids) of a text given by its word
    numbers, most frequent first, ties by code point order."""
    count = ids.counts(code)
    seen = np.flatnonzero(count)
    return seen[np.lexsort((ids.order[seen], -count[seen]))][:size]


def train(labelled: DataFrame, *, lang_col: str = "lang", text_col: str = "text", id_col: str = "doc_id",
          max_gram: int = MAX_GRAM, profile_size: int = PROFILE_SIZE, train_rows: int = TRAIN_ROWS) -> dict[str, list[str]]:
    """Profiles from at most train_rows documents of each language, chosen
    by a hash of the id: {language: n-grams, most frequent first}. Each
    task counts its documents' n-grams; the counts meet in one aggregate."""
    ship(labelled.sparkSession)
    rows = labelled.select(F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    # choose by id first: texts are fetched for the chosen rows only. Of a language's n rows those with
    # the smallest hashes are wanted; the lowest share of 2 * train_rows / n holds them, so only about
    # that many reach the window
    place = F.shiftrightunsigned(F.xxhash64("doc_id"), 11) / F.lit(float(1 << 53))
    sizes = F.broadcast(rows.groupBy("lang").agg(F.count("*").alias("_size")))      # a row per language
    chosen = (rows.select("doc_id", "lang", F.xxhash64("text").alias("h"), place.alias("_place")).join(sizes, "lang")
              .where(F.col("_place") * F.col("_size") <= 2 * train_rows + 100)
              .withColumn("_n", F.row_number().over(Window.partitionBy("lang").orderBy("_place", "doc_id", "h")))
              .where(F.col("_n") <= train_rows).select(F.col("doc_id").alias("_i"), F.col("lang").alias("_l"), F.col("h").alias("_h")).distinct())
    sample = rows.join(F.broadcast(chosen), rows["doc_id"].eqNullSafe(chosen["_i"]) & (rows["lang"] == chosen["_l"])
                       & (F.xxhash64(rows["text"]) == chosen["_h"])).select("lang", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs = np.array(b.column(0).to_pylist(), dtype=object)
            texts = b.column(1).to_pylist()
            for lo, hi in text_slices(texts, _SLICE_BYTES):     # bounded, whatever a batch of texts holds
                ids = GramIds(max_gram)
                words = [text_words(t) for t in texts[lo:hi]]
                code = ids.add([w for doc in words for w in doc])
                of = np.repeat(langs[lo:hi], [len(doc) for doc in words])
                for lang in sorted(set(langs[lo:hi])):
                    n = ids.counts(code[of == lang])
                    seen = np.flatnonzero(n)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(seen), pa.string()), pa.array([key_gram(k) for k in ids.keys[seen].tolist()], pa.string()),
                         pa.array(n[seen].astype(np.int64))], names=["lang", "gram", "n"])

    counts = sample.mapInArrow(tidy(run), "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    top = counts.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).where(F.col("r") <= profile_size)
    profiles: dict[str, list[str]] = {}
    for r in top.orderBy("lang", "r").collect():        # languages x profile_size rows
        profiles.setdefault(r["lang"], []).append(r["gram"])
    return profiles


def distances(doc_top: list[str], profiles: dict[str, list[str]], profile_size: int = PROFILE_SIZE) -> dict[str, int]:
    """Out-of-place distance to every profile, spelled out (for tests)."""
    out = {}
    for lang, grams in profiles.items():
        rank = {g: i for i, g in enumerate(grams)}
        out[lang] = sum(abs(i - rank[g]) if g in rank else profile_size for i, g in enumerate(doc_top))
    return out


def predict(docs: DataFrame, profiles: dict[str, list[str]], *, text_col: str = "text", max_gram: int = MAX_GRAM,
            profile_size: int = PROFILE_SIZE, keep: list[str] | None = None) -> DataFrame:
    """docs' columns ``keep`` (default: all but the text) with lang_pred
    and score: the share of the greatest possible distance that the best
    language stays below. A kept text is sent to the workers once."""
    spark = docs.sparkSession
    ship(spark)
    keep = [c for c in docs.columns if c != text_col] if keep is None else keep
    keep = [c for c in keep if c.lower() not in ("lang_pred", "score")]
    sent = [text_col, *(c for c in keep if c != text_col)]
    langs = sorted(profiles)
    fixed = {lang: {gram_key(g): i for i, g in enumerate(profiles[lang])} for lang in langs}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = GramIds(max_gram)
        rank = np.empty((len(langs), 0), dtype=np.int64)
        for b in batches:
            texts = b.column(0).to_pylist()
            pred = [UNDETERMINED] * len(texts)
            score = [0.0] * len(texts)
            for lo, hi in text_slices(texts, _SLICE_BYTES) if langs else ():
                if len(ids.words) > _CACHE_WORDS:
                    ids.clear()
                    rank = np.empty((len(langs), 0), dtype=np.int64)
                words = [text_words(t) for t in texts[lo:hi]]
                code = ids.add([w for doc in words for w in doc])
                edge = np.concatenate([[0], np.cumsum([len(doc) for doc in words])])
                if rank.shape[1] < len(ids.keys):
                    more = ids.keys[rank.shape[1]:].tolist()
                    rank = np.concatenate([rank, np.array([[fixed[lang].get(g, -1) for g in more] for lang in langs],
                                                          dtype=np.int64)], axis=1)
                for i in np.flatnonzero(np.diff(edge)):
                    top = top_grams(code[edge[i]:edge[i + 1]], ids, profile_size)
                    r = rank[:, top]
                    d = np.where(r < 0, profile_size, np.abs(r - np.arange(len(top)))).sum(1)
                    best = int(d.argmin())
                    pred[lo + i] = langs[best]
                    score[lo + i] = 1.0 - float(d[best]) / (profile_size * len(top))
            cols = dict(zip(sent, b.columns))
            yield pa.RecordBatch.from_arrays([*(cols[c] for c in keep), pa.array(pred, pa.string()), pa.array(score, pa.float64())],
                                             names=[*keep, "lang_pred", "score"])

    out = docs.select(*sent)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema.fields)
    return out.mapInArrow(tidy(run), (fields + ", " if fields else "") + "lang_pred string, score double")


def identify(docs: DataFrame, *, fold=None, **params) -> DataFrame:
    """Learn from the rows with fold false (null fold: not learned from),
    then predict every row's language. fold: boolean column, default all."""
    labelled = docs if fold is None else docs.where(~fold)
    return predict(docs, train(labelled), **params)
