"""BPE encoding and decoding as streaming transducers with bounded lookahead.

Encoding. The merge list itself says how far ahead one must read. Take text
known up to a place e and let the merges run in rank order. At first the last
boundary that no unknown text can reach is e. A merge (a, b) can move it, by
the length of a, only if the token before it is a; what then stands behind it
starts with a. A later merge (a', b') moves it again only if b' starts with
that a, i.e. if a lies on the left spine of the tree of merges that made b'
(or is b'). So the longest chain of merges of rising rank linked in this way,
weighted with the lengths of their left parts, bounds how far unknown text
reaches back: the sufficient lookahead, computed by one pass over the merges.
It holds for lists in which every merge joins bytes or results of earlier
merges; any other list is refused.

The transducer keeps a buffer of one lookahead and one chunk. Whenever it is
full, the buffer's merges run and the tokens that end a lookahead or more
before its end leave it: they are stable. No merge crosses a boundary of the
final tokens, so what is left starts afresh. In front of it stand three small
machines that also hold back only what may still change: one cuts out the
tokenizer's special strings, one normalises (NFC, lower case) up to the last
character that later ones cannot change, one cuts words, contractions, single
digits and runs of other characters, and passes a long piece on in parts.
Memory is constant for texts, words and pieces of any length, but for a row's
own text and for one character followed by endless combining marks.

Decoding reads one id after the other. Byte-level vocabularies turn ids into
bytes, and an incremental UTF-8 machine gives characters out once complete
(replacement characters for invalid bytes). Tokenizers that name no decoder
join the tokens' own strings with spaces; the machine then only remembers
whether a token went before.

A Spark task runs the transducer over one text after the other. Short words
repeat, and words share pieces, so the ids and decoded text of both are
remembered, REMEMBER_WORDS in each of two generations; this changes nothing
but the time.

Defined results for odd input: null text counts as empty: no ids, empty decoded
text; null ids (of documents) stay null; rows with repeated ids or texts are
encoded one by one; an empty table gives no rows; texts of any length are
encoded whole; there is nothing to tie. Only the named columns are read, so
other columns may have any name. Upper case is lowered character by character,
and letters, digits and marks are those of Python's Unicode tables.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterator
from itertools import repeat

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, tidy

TOKENIZER = "word_bpe_49k.json"
REMEMBER_WORDS = 250_000    # words, and pieces, a worker remembers in each of two generations (speed only)
REMEMBER_BYTES = 64         # longer words are not remembered
SLICE_BYTES = 65_536        # text that is cut into words at once
FEED_CHARS = 4_096          # characters of a long word fed at once
CHUNK_BYTES = 2_048         # bytes beyond the lookahead after which stable tokens leave
_SHORT = 24                 # symbols up to which merges are searched one by one

_NO_MERGE = 1 << 62         # ranks after all merges

# Fixed values of the tokenizer format: its split pattern and white space.
_SPLIT_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


def default_tokenizer_path() -> str:
    import public_tokenizers
    return public_tokenizers.path(TOKENIZER)


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies:
    printable bytes stand for themselves, the others for code points from
    256 on, in order."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(hidden)) for b in range(256)]


class MergeList:
    """A vocabulary with its merges, and their sufficient lookahead."""

    def __init__(self, model: dict):
        vocab: dict[str, int] = model["vocab"]
        self.end = model.get("end_of_word_suffix") or ""
        if model.get("continuing_subword_prefix") or model.get("byte_fallback") or model.get("ignore_merges") or model.get("dropout"):
            raise ValueError("only plain merge lists over bytes are supported")
        letters = byte_letters()
        missing = [c for c in letters if c not in vocab or c + self.end not in vocab]
        if missing:
            raise ValueError(f"the vocabulary lacks the bytes {missing}")
        self.byte_id = [vocab[c] for c in letters]
        self.last_byte_id = [vocab[c + self.end] for c in letters]
        pairs = [tuple(m.split(" ", 1)) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        made = set(self.byte_id) | set(self.last_byte_id)
        self.rank: dict[tuple[int, int], int] = {}      # in rank order
        self.result: list[int] = []                     # by rank
        self.left_part: dict[int, int] = {}
        self.length = dict.fromkeys(made, 1)
        for rank, (a, b) in enumerate(pairs):
            ia, ib, new = vocab[a], vocab[b], vocab[a + b]
            if ia not in made or ib not in made or (ia, ib) in self.rank:
                raise ValueError(f"merge {rank} ({a!r}, {b!r}) uses a token that no earlier merge made")
            self.rank[ia, ib] = rank
            self.result.append(new)
            if new not in made:         # a second way to a token does not change what it starts with
                made.add(new)
                self.left_part[new] = ia
                self.length[new] = self.length[ia] + self.length[ib]
            elif self.left_part.get(new) != ia:
                raise ValueError(f"token {a + b!r} is made in two ways")
        self.lookahead = self._lookahead()

    def _lookahead(self) -> int:
        reach: dict[int, int] = {}      # by left part: the longest chain of merges that ends with it
        longest = 0
        for a, b in self.rank:
            before, part = 0, b
            while part is not None:
                before = max(before, reach.get(part, 0))
                part = self.left_part.get(part)
            chain = self.length[a] + before
            reach[a] = max(reach.get(a, 0), chain)
            longest = max(longest, chain)
        return longest

    def symbols(self, raw: bytes, last: bool) -> list[int]:
        ids = [self.byte_id[b] for b in raw]
        if last and raw:
            ids[-1] = self.last_byte_id[raw[-1]]
        return ids

    def apply(self, ids: list[int]) -> list[int]:
        """The tokens of a piece: merges in rank order, leftmost first."""
        return self._apply_short(ids) if len(ids) <= _SHORT else self._apply_long(ids)

    def _apply_short(self, ids: list[int]) -> list[int]:
        get = self.rank.get
        ids = list(ids)
        near = list(map(get, zip(ids, ids[1:]), repeat(_NO_MERGE)))      # the rank of each neighbouring pair
        while near:
            best = min(near)
            if best == _NO_MERGE:
                break
            i = near.index(best)            # one at a time: the leftmost of the best
            ids[i] = self.result[best]
            del ids[i + 1], near[i]
            if i:
                near[i - 1] = get((ids[i - 1], ids[i]), _NO_MERGE)
            if i < len(near):
                near[i] = get((ids[i], ids[i + 1]), _NO_MERGE)
        return ids

    def _apply_long(self, ids: list[int]) -> list[int]:
        get, n = self.rank.get, len(ids)
        ids = list(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = [(rank, i, ids[i], ids[i + 1]) for i, rank in enumerate(map(get, zip(ids, ids[1:]))) if rank is not None]
        heapq.heapify(queue)
        while queue:
            rank, i, a, b = heapq.heappop(queue)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:        # one of the two is gone
                continue
            ids[i], ids[j] = self.result[rank], -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for x in (before[i], i):
                if x >= 0 and after[x] < n:
                    rank = get((ids[x], ids[after[x]]))
                    if rank is not None:
                        heapq.heappush(queue, (rank, x, ids[x], ids[after[x]]))
        return [t for t in ids if t >= 0]


class MergeStream:
    """Bytes of one piece in, stable tokens out."""

    def __init__(self, merges: MergeList):
        self.merges, self.held = merges, b""
        self.full = merges.lookahead + max(CHUNK_BYTES, merges.lookahead)

    def feed(self, raw: bytes) -> list[int]:
        out: list[int] = []
        self.held += raw
        while len(self.held) > self.full + 1:       # the last byte may turn out to end the piece
            known = self.held[:self.full]
            at, stable = 0, self.full - self.merges.lookahead
            for t in self.merges.apply(self.merges.symbols(known, last=False)):
                if at + self.merges.length[t] > stable:
                    break
                at += self.merges.length[t]
                out.append(t)
            self.held = self.held[at:]
        return out

    def finish(self, raw: bytes = b"") -> list[int]:
        out = self.feed(raw)
        last, self.held = self.held, b""
        return out + self.merges.apply(self.merges.symbols(last, last=True))


class Normaliser:
    """NFC, then lower case, of a text that comes in parts."""

    _joins_back: set[str] | None = None

    def __init__(self):
        self.held = ""

    @classmethod
    def _safe(cls, c: str) -> bool:
        """No character before c can change once c is there."""
        if c < "\x80":
            return True
        if unicodedata.combining(c):
            return False
        if cls._joins_back is None:
            seconds = {chr(x) for x in range(0x1161, 0x1176)} | {chr(x) for x in range(0x11A8, 0x11C3)}     # Hangul vowels and finals
            for x in range(0x80, 0x110000):
                parts = unicodedata.decomposition(chr(x)).split()
                if len(parts) == 2 and not parts[0].startswith("<"):
                    seconds.add(chr(int(parts[1], 16)))
            cls._joins_back = seconds
        return c not in cls._joins_back

    def feed(self, text: str) -> str:
        self.held += text
        for i in range(len(self.held) - 1, -1, -1):
            if self._safe(self.held[i]):
                out, self.held = self.held[:i], self.held[i:]
                return self.whole(out)
        return ""

    def finish(self, text: str = "") -> str:
        out, self.held = self.held + text, ""
        return self.whole(out)

    @staticmethod
    def whole(text: str) -> str:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")     # sigma is lowered without regard to word ends
        return text.lower()


_PIECE = regex.compile(_SPLIT_PATTERN.replace(r"\s", _WHITE))
_MORE = {"letters": regex.compile(r"[\p{L}]*"), "others": regex.compile(rf"[^{_WHITE}\p{{L}}\p{{N}}]*")}


class PieceStream:
    """Cuts normalised text that comes in parts into (bytes, ended) parts of
    pieces; a piece's last part has ended set."""

    def __init__(self):
        self._open, self._held = "", ""

    def feed(self, text: str, last: bool = False) -> Iterator[tuple[bytes, bool]]:
        text, at = self._held + text, 0
        self._held = ""
        if self._open:
            m = _MORE[self._open].match(text)
            at = m.end()
            ended = last or at < len(text)
            yield m.group().encode("utf-8"), ended
            if not ended:
                return
            self._open = ""
        for m in _PIECE.finditer(text, at):
            piece = m.group()
            if not last:
                if piece[0] == "'" and m.start() > len(text) - 3:       # may become a contraction
                    self._held = text[m.start():]
                    return
                if m.end() == len(text):
                    if piece[0].isalpha() or _MORE["letters"].match(piece).end():
                        self._open = "letters"
                    elif _MORE["others"].match(piece).end() == len(piece):
                        self._open = "others"
                    if self._open:
                        yield piece.encode("utf-8"), False
                        return
            yield piece.encode("utf-8"), True


class Encoder:
    """The whole transducer: text in parts in, token ids out."""

    def __init__(self, tokenizer: Tokenizer):
        self._tokenizer = tokenizer
        self._pieces, self._normal, self._merges = PieceStream(), Normaliser(), MergeStream(tokenizer.merges)
        self._held = ""

    def feed(self, text: str) -> list[int]:
        return self._run(text, last=False)

    def finish(self, text: str = "") -> list[int]:
        """The rest of the ids; the machine is then as new."""
        return self._run(text, last=True)

    def _run(self, text: str, last: bool) -> list[int]:
        out: list[int] = []
        text, self._held = self._held + text, ""
        special = self._tokenizer.special
        if special is not None:
            at = 0
            for m in special.finditer(text):
                out += self._part(text[at:m.start()], True)
                out.append(self._tokenizer.special_id[m.group()])
                at = m.end()
            text = text[at:]
            if not last:
                keep = next((i for i in range(max(0, len(text) - self._tokenizer.longest_special + 1), len(text))
                             if any(s.startswith(text[i:]) for s in self._tokenizer.special_id)), len(text))
                text, self._held = text[:keep], text[keep:]
        return out + self._part(text, last)

    def _part(self, text: str, last: bool) -> list[int]:
        out: list[int] = []
        normal = self._normal.finish(text) if last else self._normal.feed(text)
        for raw, ended in self._pieces.feed(normal, last):
            out += self._merges.finish(raw) if ended else self._merges.feed(raw)
        return out


class Decoder:
    """Token ids in, text out, one id after the other."""

    def __init__(self, tokenizer: Tokenizer, begun: bool = False):
        self._tokenizer, self._begun = tokenizer, begun
        self._utf8 = codecs.getincrementaldecoder("utf-8")("replace") if tokenizer.byte_decoder else None

    def feed(self, ids: list[int]) -> str:
        token = self._tokenizer.token
        if self._utf8 is not None:
            return self._utf8.decode(b"".join([self._tokenizer.token_bytes(i) for i in ids]))
        text = " ".join([t for t in map(token.get, ids) if t is not None])
        if text and self._begun:
            text = " " + text
        self._begun = self._begun or bool(text)
        return text

    def finish(self) -> str:
        return self._utf8.decode(b"", final=True) if self._utf8 is not None else ""


class Tokenizer:
    """A tokenizer file: its merges, special strings and decoder."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.path = path
        self.merges = MergeList(spec["model"])
        self.special_id = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.longest_special = max(map(len, self.special_id), default=0)
        self.special = re.compile("|".join(map(re.escape, sorted(self.special_id, key=len, reverse=True)))) if self.special_id else None
        self.token = {i: t for t, i in spec["model"]["vocab"].items()} | {i: t for t, i in self.special_id.items()}
        self.byte_decoder = (spec.get("decoder") or {}).get("type") == "ByteLevel"
        split = json.dumps(spec.get("pre_tokenizer") or {})
        kinds = [n["type"] for n in (spec.get("normalizer") or {}).get("normalizers", [])]
        self.can_encode = json.dumps(_SPLIT_PATTERN) in split and kinds in (["NFC", "Replace", "Lowercase"],)
        self._byte_of = {c: b for b, c in enumerate(byte_letters())}

    def token_bytes(self, i: int) -> bytes:
        t = self.token.get(i, "")
        try:
            return bytes([self._byte_of[c] for c in t])
        except KeyError:                # a special string of other characters
            return t.encode("utf-8")

    def encoder(self) -> Encoder:
        if not self.can_encode:
            raise ValueError(f"{self.path}: normaliser or split pattern not supported")
        return Encoder(self)


_BREAK = re.compile(rb"[\x20\x09-\x0D]")


class _Remembered:
    """A bounded memory of results in two generations: a full one is kept
    until the next is full, so frequent keys stay known."""

    def __init__(self, make, size: int):
        self._make, self._size = make, size
        self.known: dict = {}
        self._older: dict = {}

    def new(self, key):
        got = self._older.get(key) or self._make(key)
        if len(self.known) >= self._size:
            self._older = dict(self.known)
            self.known.clear()          # the same dict: callers keep its get
        self.known[key] = got
        return got


class RoundTrip:
    """Encodes texts word by word (white space ends every piece), and decodes
    the ids again; short words and their pieces are remembered."""

    def __init__(self, tokenizer: Tokenizer, remember: int = REMEMBER_WORDS):
        self.tokenizer = tokenizer
        self._machine, self._merges = tokenizer.encoder(), MergeStream(tokenizer.merges)
        self._words = _Remembered(self._word, remember)
        self._pieces = _Remembered(self._piece, remember)
        self._back = Decoder(tokenizer, begun=True)     # words and pieces end where characters do

    def _with_text(self, ids: list[int]) -> tuple[int, bytes, bytes]:
        return len(ids), " ".join(map(str, ids)).encode(), self._back.feed(ids).encode("utf-8")

    def _piece(self, piece: str) -> tuple[int, bytes, bytes]:
        return self._with_text(self._merges.finish(piece.encode("utf-8")))

    def _word(self, word: bytes) -> tuple[int, bytes, bytes]:
        text = word.decode("utf-8")
        if self.tokenizer.byte_decoder or (self.tokenizer.special is not None and self.tokenizer.special.search(text)):
            return self._with_text(self._machine.finish(text))
        known = self._pieces.known.get
        found = [known(p) or self._pieces.new(p) for p in _PIECE.findall(Normaliser.whole(text))]
        if len(found) == 1:
            return found[0]
        return sum([f[0] for f in found]), b" ".join([f[1] for f in found]), b"".join([f[2] for f in found])

    def parts(self, text: bytes) -> Iterator[tuple[int, bytes, bytes]]:
        """(number of ids, their decimals, decoded bytes) part by part; the
        decoded bytes are those after an earlier token."""
        at = 0
        while at < len(text):
            m = _BREAK.search(text, at + SLICE_BYTES)
            end = m.start() if m else len(text)
            if end - at <= 2 * SLICE_BYTES:
                known, held = self._words.known.get, []
                for w in text[at:end].split():
                    if len(w) <= REMEMBER_BYTES:
                        held.append(known(w) or self._words.new(w))
                    else:
                        yield from _joined(held)
                        held = []
                        yield from self._long(w, 0, len(w))
                yield from _joined(held)
            else:                       # a word longer than a slice: read in place
                first = at
                while first < end:
                    b = _BREAK.search(text, first)
                    stop = b.start() if b and b.start() < end else end
                    if stop > first:
                        yield from self._long(text, first, stop)
                    first = stop + 1
            at = end + 1 if m else end

    def _long(self, text: bytes, start: int, stop: int) -> Iterator[tuple[int, bytes, bytes]]:
        machine, back = self.tokenizer.encoder(), Decoder(self.tokenizer, begun=True)
        utf8 = codecs.getincrementaldecoder("utf-8")()
        for i in range(start, stop, FEED_CHARS):
            ids = machine.feed(utf8.decode(text[i:min(stop, i + FEED_CHARS)]))
            if ids:
                yield len(ids), " ".join(map(str, ids)).encode(), back.feed(ids).encode("utf-8")
        ids = machine.finish()
        if ids:
            yield len(ids), " ".join(map(str, ids)).encode(), back.feed(ids).encode("utf-8")

    def digest(self, text: bytes) -> tuple[int, str, str]:
        n, ids_hash, text_hash = 0, hashlib.sha256(), hashlib.sha256()
        for k, ids, decoded in self.parts(text):
            if not n:
                decoded = decoded if self.tokenizer.byte_decoder else decoded[1:]
            else:
                ids = b" " + ids
            n += k
            ids_hash.update(ids)
            text_hash.update(decoded)
        return n, ids_hash.hexdigest(), text_hash.hexdigest()


def _joined(held: list[tuple[int, bytes, bytes]]) -> Iterator[tuple[int, bytes, bytes]]:
    numbers = [h[0] for h in held]
    if 0 in numbers:                        # a word may hold no piece at all
        held = [h for h in held if h[0]]
    if held:
        yield sum(numbers), b" ".join([h[1] for h in held]), b"".join([h[2] for h in held])


_worker: dict = {}


def _tokenizer(path: str) -> Tokenizer:
    if _worker.get("path") != path:
        _worker.clear()
        _worker.update(path=path, tokenizer=Tokenizer(path))
    return _worker["tokenizer"]


def _round_trip(path: str, remember: int) -> RoundTrip:
    tokenizer = _tokenizer(path)
    if _worker.get("remember") != remember:
        _worker.update(remember=remember, round_trip=RoundTrip(tokenizer, remember))
    return _worker["round_trip"]


def digests(docs: DataFrame, *, tokenizer_path: str | None = None, remember_words: int = REMEMBER_WORDS,
            id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (decimal ids joined by a space) and
    decoded_sha256 of every text, encoded and decoded again."""
    ship(docs.sparkSession)
    path = tokenizer_path or default_tokenizer_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trip = _round_trip(path, remember_words)
        for batch in batches:
            got = [trip.digest(t.as_py() or b"") for t in batch.column(1).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.string()),
                                              pa.array([g[2] for g in got], pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return (docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
            .mapInArrow(tidy(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"))


def encode(docs: DataFrame, *, tokenizer_path: str | None = None, remember_words: int = REMEMBER_WORDS,
           id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids (array<int>) of every text."""
    ship(docs.sparkSession)
    path = tokenizer_path or default_tokenizer_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trip = _round_trip(path, remember_words)
        for batch in batches:
            for d, t in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())):
                ids = [int(i) for _, part, _ in trip.parts(t.as_py() or b"") for i in part.split()]
                yield pa.RecordBatch.from_arrays([pa.array([d], pa.int64()), pa.array([ids], pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return (docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
            .mapInArrow(tidy(run), "doc_id long, ids array<int>"))


def decode(encoded: DataFrame, *, tokenizer_path: str | None = None, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and text of every list of ids; null lists count as empty, ids
    outside the vocabulary give nothing."""
    ship(encoded.sparkSession)
    path = tokenizer_path or default_tokenizer_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(path)
        for batch in batches:
            for d, ids in zip(batch.column(0).to_pylist(), batch.column(1)):
                machine, known = Decoder(tokenizer), ids.as_py() or []
                text = "".join([*(machine.feed(known[i:i + FEED_CHARS]) for i in range(0, len(known), FEED_CHARS)), machine.finish()])
                yield pa.RecordBatch.from_arrays([pa.array([d], pa.int64()), pa.array([text], pa.string())], names=["doc_id", "text"])

    return (encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids"))
            .mapInArrow(tidy(run), "doc_id long, text string"))
