"""Best-fit packing of documents into fixed-length token sequences by the
sum-of-squares rule.

Every document becomes token ids plus an end id; only documents longer than
a sequence are cut, into full sequences and a rest. Pieces are dealt by hash
to packing tasks of bounded size. A task places its pieces one by one: among
the open sequences' residual gaps (and a new sequence) it takes the placement
after which the sum over gaps of the squared number of open sequences with
that gap is smallest. What a task leaves in badly filled sequences is packed
again with the leftovers of other tasks, in fewer and fewer tasks.

Defined results for odd input: null text is an empty document (one piece
holding only the end id); null ids stay null; repeated rows are packed as
separate documents; an empty table gives no rows.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_kept, kept, materialize, ragged, ship, text_slices, tidy

SEQUENCE_TOKENS = 2048
END_ID = 0
TOKENIZER = "word_bpe_49k.json"
TASK_PIECES = 40_000       # pieces a packing task takes on average
REPACK_GAP = 0.02          # sequences with a larger free share are packed again
REPACK_GAIN = 0.001        # ... until a round saves a smaller share of their sequences
SEED = 11
REMEMBER_WORDS = 800_000   # words of a generation that a worker remembers (speed only)
_SLICE_BYTES = 2_000_000   # text that is tokenised at once

#: Latin letters. The tokenizer's own pattern splits exactly between them
#: and a full stop or comma that follows.
_LATIN = re.compile(rb"(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+")


def default_tokenizer_path() -> str:
    import public_tokenizers
    return public_tokenizers.path(TOKENIZER)


class _Ids:
    """Grows: byte strings and their token ids, laid end to end."""

    def __init__(self):
        self.code: dict[bytes, int] = {}
        self.ids = np.empty(0, dtype=np.uint32)
        self.off = np.zeros(1, dtype=np.int64)

    def put(self, new: list[bytes], ids: np.ndarray, lens: np.ndarray) -> None:
        self.code.update(zip(new, range(len(self.code), len(self.code) + len(new))))
        self.ids = np.concatenate([self.ids, ids])
        self.off = np.concatenate([self.off, self.off[-1] + np.cumsum(lens)])

    def of(self, items: list[bytes]) -> np.ndarray:
        """Numbers of the items, -1 for unknown ones."""
        return np.fromiter(map(self.code.get, items, repeat(-1)), np.int64, len(items))

    def take(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = self.off[code + 1] - self.off[code]
        return self.ids[ragged(self.off[code], n)], n


def _byte_letters() -> dict[int, str]:
    """The usual letters of byte-level vocabularies: printable bytes stand
    for themselves, the others for code points from 256 on, in order."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(printable)]
    return {b: chr(256 + i) for i, b in enumerate(others)}


class _Encoder:
    """Token ids of words. Two generations of words are remembered: a full
    one is kept until the next is full, so frequent words stay known."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.path, self.tokenizer = path, Tokenizer.from_file(path)
        self.model, self.letters = self.tokenizer.model, _byte_letters()
        self.marks = {m: self._whole([m])[0] for m in (b".", b",")}
        self.words, self.older = _Ids(), _Ids()

    def _whole(self, words: list[bytes]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast([w.decode("utf-8") for w in words], add_special_tokens=False)]

    def _word(self, w: bytes) -> list[int] | None:
        """A plain word's ids straight from the merges: its letters are one
        unit of the tokenizer, already normal but for case."""
        if w.isalpha():
            return [t.id for t in self.model.tokenize(w.lower().decode("ascii"))]
        mark = w[-1:]
        if mark in self.marks:
            w = w[:-1]
            if w.isalpha():
                return [t.id for t in self.model.tokenize(w.lower().decode("ascii"))] + self.marks[mark]
        if _LATIN.fullmatch(w) is None:
            return None
        letters = w.decode("utf-8").lower().encode("utf-8").decode("latin-1").translate(self.letters)
        return [t.id for t in self.model.tokenize(letters)] + self.marks.get(mark, [])

    def encode(self, words: list[bytes], remember: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.words.code) > remember:
            self.words, self.older = _Ids(), self.words
        code = self.words.of(words)
        missing = np.flatnonzero(code < 0).tolist()
        if missing:
            new = list(dict.fromkeys(map(words.__getitem__, missing)))
            if self.older.code:
                at = self.older.of(new)
                known = np.flatnonzero(at >= 0)
                self.words.put([new[i] for i in known.tolist()], *self.older.take(at[known]))
                new = [new[i] for i in np.flatnonzero(at < 0).tolist()]
            ids = [self._word(w) for w in new]
            rest = [i for i, x in enumerate(ids) if x is None]
            for i, x in zip(rest, self._whole([new[i] for i in rest])):
                ids[i] = x
            lens = np.fromiter(map(len, ids), np.int64, len(ids))
            self.words.put(new, np.fromiter(chain.from_iterable(ids), np.uint32, int(lens.sum())), lens)
            code[missing] = self.words.of([words[i] for i in missing])
        return self.words.take(code)


def encode_ids(texts: list[bytes], path: str, remember: int = REMEMBER_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of all texts, concatenated, and their number per text.
    White space is a boundary for this tokenizer, so every distinct word is
    encoded once and remembered."""
    worker = kept("packing")
    if getattr(worker.get("encoder"), "path", None) != path:
        worker["encoder"] = _Encoder(path)
    words: list[bytes] = []
    per = np.empty(len(texts), dtype=np.int64)
    for i, t in enumerate(texts):
        w = t.split()
        per[i] = len(w)
        words += w
    out, n = worker["encoder"].encode(words, remember)
    total = np.concatenate([[0], np.cumsum(n)])
    bound = np.concatenate([[0], np.cumsum(per)])
    return out, total[bound[1:]] - total[bound[:-1]]


_PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, *, sequence_tokens: int = SEQUENCE_TOKENS, end_id: int = END_ID,
           tokenizer_path: str | None = None, with_ids: bool = False, remember_words: int = REMEMBER_WORDS,
           id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece of a tokenised document: doc_id, piece, start,
    length, ids_crc32, and with_ids its ids (array<int>). remember_words
    trades the workers' memory for speed and changes nothing else."""
    spark = docs.sparkSession
    ship(spark)
    path = tokenizer_path or default_tokenizer_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids_col = batch.column(0).to_pylist()
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            for lo, hi in text_slices(texts, _SLICE_BYTES):
                flat, lens = encode_ids([t or b"" for t in texts[lo:hi]], path, remember_words)
                cols: list[list] = [[], [], [], [], []]
                id_lists = []
                at = 0
                for d, n in zip(ids_col[lo:hi], lens.tolist()):
                    tokens = np.append(flat[at:at + n], np.uint32(end_id)).astype("<u4")
                    at += n
                    for p, s in enumerate(range(0, n + 1, sequence_tokens)):
                        part = tokens[s:s + sequence_tokens]
                        for c, v in zip(cols, (d, p, s, len(part), zlib.crc32(part.tobytes()))):
                            c.append(v)
                        if with_ids:
                            id_lists.append(part.astype(np.int32))
                arrays = [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), *(pa.array(c, pa.int64()) for c in cols[2:])]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    arrays.append(pa.array(id_lists, pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    return (docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
            .mapInArrow(tidy(run, "packing"), _PIECE_SCHEMA + (", ids array<int>" if with_ids else "")))


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Place lengths one by one; returns bin number and offset of each.

    Putting an item of length s into an open bin of gap g takes one bin
    from gap g and adds one to gap g - s: the sum of squared counts changes
    by 2 * (N[g - s] - N[g] + 1), by -2 * N[g] + 1 when it fills the bin (a
    full bin is not counted), and by 2 * N[capacity - s] + 1 for a new bin.
    Ties go to the smaller gap, and to an open bin before a new one."""
    count = np.zeros(capacity + 1, dtype=np.int64)
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    fill: list[int] = []
    bins = np.empty(len(lengths), dtype=np.int64)
    offsets = np.empty(len(lengths), dtype=np.int64)
    for i, s in enumerate(lengths.tolist()):
        best, gap = 2 * int(count[capacity - s]) + 1, -1
        if s == capacity:
            best = 0
        else:
            n = count[s:capacity]
            if n.any():
                delta = 2 * (count[:capacity - s] - n) + 2
                delta[0] = 1 - 2 * n[0]
                delta[n == 0] = np.iinfo(np.int64).max
                j = int(delta.argmin())
                if delta[j] <= best:
                    gap = j + s
        if gap < 0:
            b = len(fill)
            fill.append(0)
            gap = capacity
        else:
            b = stacks[gap].pop()
            count[gap] -= 1
        bins[i], offsets[i] = b, fill[b]
        fill[b] += s
        rest = gap - s
        if rest > 0:
            stacks[rest].append(b)
            count[rest] += 1
    return bins, offsets


_OUT = _PIECE_SCHEMA.replace("doc_id long,", "doc_id long, _pk_none boolean,") + ", sequence_id long, offset long, _pk_free double"


def _pack_task(capacity: int, round_no: int):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        drop_kept()
        # longest first; the order is fixed, so a rerun of the task gives the same bins
        pdf = pdf.sort_values(["length", "_pk_none", "doc_id", "piece", "start", "ids_crc32"],
                              ascending=[False, True, True, True, True, True], kind="stable", ignore_index=True)
        bins, offsets = sum_of_squares(pdf["length"].to_numpy(), capacity)
        used = np.bincount(bins, weights=pdf["length"].to_numpy())
        pdf["sequence_id"] = (round_no << 56) + (int(key[0]) << 28) + bins
        pdf["offset"] = offsets
        pdf["_pk_free"] = 1.0 - used[bins] / capacity
        return pdf[["doc_id", "_pk_none", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "_pk_free"]]
    return run


def pack(piece_rows: DataFrame, *, sequence_tokens: int = SEQUENCE_TOKENS, task_pieces: int = TASK_PIECES,
         repack_gap: float = REPACK_GAP, seed: int = SEED) -> DataFrame:
    """Assign every piece a sequence_id and its offset there."""
    # a null id travels as 0 and a flag: pandas would turn the column into floats
    todo = materialize(piece_rows.select(F.coalesce("doc_id", F.lit(0)).alias("doc_id"), F.col("doc_id").isNull().alias("_pk_none"),
                                         "piece", "start", "length", "ids_crc32"), "pack-pieces")
    done: list[DataFrame] = []
    n = todo.count()
    round_no = 0
    used_before = None
    while True:
        tasks = max(1, -(-n // task_pieces))
        dealt = todo.withColumn("_pk_task", F.pmod(
            F.xxhash64(F.lit(seed + round_no), "doc_id", "piece", "start", "ids_crc32"), F.lit(tasks)).cast("int"))
        placed = materialize(dealt.groupBy("_pk_task").applyInPandas(_pack_task(sequence_tokens, round_no), _OUT),
                             f"pack-round{round_no}")
        if tasks == 1:
            done.append(placed)
            break
        done.append(placed.where(F.col("_pk_free") <= repack_gap))
        todo = placed.where(F.col("_pk_free") > repack_gap)
        left = todo.count()
        if left == 0:
            break
        # the rest is packed again, among other neighbours, as long as that saves sequences
        used = placed.select("sequence_id").distinct().count()
        if used_before is not None and used > (1 - REPACK_GAIN) * used_before:
            done.append(todo)
            break
        used_before = todo.select("sequence_id").distinct().count()
        n, round_no = left, round_no + 1
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.select(F.when(~F.col("_pk_none"), F.col("doc_id")).alias("doc_id"), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def pack_documents(docs: DataFrame, *, sequence_tokens: int = SEQUENCE_TOKENS, end_id: int = END_ID,
                   tokenizer_path: str | None = None, remember_words: int = REMEMBER_WORDS, **params) -> DataFrame:
    """Tokenise and pack docs: one row per piece with its sequence."""
    return pack(pieces(docs, sequence_tokens=sequence_tokens, end_id=end_id, tokenizer_path=tokenizer_path,
                       remember_words=remember_words),
                sequence_tokens=sequence_tokens, **params)


def sequences(docs: DataFrame, **params) -> DataFrame:
    """The packed sequences themselves: sequence_id, ids (array<int>) and
    the pieces they hold, in order of offset."""
    keep = {k: params[k] for k in ("sequence_tokens", "end_id", "tokenizer_path") if k in params}
    rows = materialize(pieces(docs, with_ids=True, **keep), "pack-ids")
    rest = {k: v for k, v in params.items() if k in ("sequence_tokens", "task_pieces", "repack_gap", "seed")}
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    placed = pack(rows, **rest)
    from pyspark.sql.window import Window
    copy = Window.partitionBy(*key).orderBy(F.lit(0))
    a = rows.withColumn("_pk_copy", F.row_number().over(copy)).alias("a")
    b = placed.withColumn("_pk_copy", F.row_number().over(copy)).alias("b")
    on = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in [*key, "_pk_copy"]]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    joined = a.join(b, cond).select("b.sequence_id", "b.offset", "a.doc_id", "a.piece", "a.ids")
    return (joined.groupBy("sequence_id")
            .agg(F.sort_array(F.collect_list(F.struct("offset", "doc_id", "piece", "ids"))).alias("_pk"))
            .select("sequence_id", F.flatten(F.col("_pk.ids")).alias("ids"),
                    F.transform("_pk", lambda p: F.struct(p["doc_id"].alias("doc_id"), p["piece"].alias("piece"), p["offset"].alias("offset"))).alias("pieces")))
