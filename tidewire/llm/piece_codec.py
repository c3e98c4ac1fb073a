"""SentencePiece encoding and decoding for merge-type vocabularies.

A text becomes the dummy prefix and its characters, white space written as
U+2581.  Every adjacent pair of symbols whose join is a piece enters an agenda;
the pair with the highest score goes first, of equal scores the leftmost.  It
is merged, and the pairs with its new neighbours enter the agenda in turn.
Symbols that are no piece at the end become one byte piece for each byte.

Two symbols can only meet inside a piece that the vocabulary has, so a text
falls apart exactly wherever no piece holds its two neighbouring characters
side by side.  Characters that pieces link, directly or through others, form
classes (letters of one script, marks, ...); the classes are read from the
vocabulary, and runs of one class after their white space go through a bounded
cache.  Long runs are cut at each pair that no piece holds before the agenda
starts, so text without spaces stays cheap too.

Models other than merge-type, with another normaliser than the identity, or
with pieces given by users or marked unused, are refused.

Defined results: a null text is an empty one and has the end id alone; null,
repeated and tied ids are rows of their own; whole texts are read, of any
length; an empty table gives an empty result; columns other than the two named
are never read, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from struct import pack

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.session import ensure_importable

from .storage import bounded_batches

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
MERGE_MODEL = 2
CACHED_WORDS = 300_000
LONGEST_CACHED = 64
SHORT = 24
PLACE_BITS = 32
PLACE_MASK = (1 << PLACE_BITS) - 1
#: Symbols: ids of pieces, then code points; a pair is two of them in one number.
OUTSIDE = 1 << 22
PAIR_BITS = 24
GONE = -1
#: Beyond all symbols and places, in rows of short words.
NONE = 1 << 23
NO_PLACE = 1 << 30
TOGETHER = 8192
ROWS = 128


class _Symbols(dict):
    """A character's id; characters outside the vocabulary count from ``OUTSIDE``."""

    def __missing__(self, char: str) -> int:
        return OUTSIDE + ord(char)


class PieceCodec:
    """Encodes and decodes whole texts with one model file."""

    def __init__(self, path: str, cached_words: int = CACHED_WORDS):
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        rule = model.normalizer_spec
        if model.trainer_spec.model_type != MERGE_MODEL or model.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("not a merge-type model with white space in front")
        if rule.precompiled_charsmap or rule.remove_extra_whitespaces or not (rule.escape_whitespaces and rule.add_dummy_prefix):
            raise ValueError("the model changes texts beyond the dummy prefix")
        if {p.type for p in model.pieces} - {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError("the model has unused or user-defined pieces")
        normal = [(i, p.piece, p.score) for i, p in enumerate(model.pieces) if p.type == NORMAL]
        self.ids = {piece: i for i, piece, _ in normal}
        order = {score: at << PLACE_BITS for at, score in enumerate(sorted({score for *_, score in normal}, reverse=True))}
        self.symbols = _Symbols((piece, i) for i, piece, _ in normal if len(piece) == 1)
        self.rank: dict[int, int] = {}
        self.joined: dict[int, int] = {}
        for i, piece, score in normal:
            for cut in range(1, len(piece)):
                sides = [self.symbols[x] if len(x) == 1 else self.ids.get(x) for x in (piece[:cut], piece[cut:])]
                if None not in sides:
                    pair = sides[0] << PAIR_BITS | sides[1]
                    self.rank[pair], self.joined[pair] = order[score], i
        self.pairs = np.array(sorted(self.rank), np.int64)
        self.pair_places = np.array([self.rank[pair] >> PLACE_BITS for pair in self.pairs.tolist()], np.int64)
        self.pair_joins = np.array([self.joined[pair] for pair in self.pairs.tolist()], np.int64)
        self.byte_ids = {int(p.piece[1:-1], 16): i for i, p in enumerate(model.pieces) if p.type == BYTE}
        self.unknown = next(i for i, p in enumerate(model.pieces) if p.type == UNKNOWN)
        self.end = model.trainer_spec.eos_id
        self.beside = {piece[i : i + 2] for piece in self.ids for i in range(len(piece) - 1)}
        self.words = _cutter(self.beside)
        kinds = {i: p.type for i, p in enumerate(model.pieces)}
        raw = {i: bytes([b]) for b, i in self.byte_ids.items()}
        self.token_bytes = [raw.get(i, b"" if kinds[i] == CONTROL else p.piece.replace(SPACE, " ").encode()) for i, p in enumerate(model.pieces)]
        self.most = cached_words
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _agenda(self, chars: str) -> list[int]:
        """The symbols that are left when no adjacent pair makes a piece.

        An entry is the place of the pair's score among all scores, then the
        pair's position; one whose symbols have changed since is passed over.
        """
        symbols, rank, joined = list(map(self.symbols.__getitem__, chars)), self.rank.get, self.joined
        n = len(symbols)
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        agenda = [r + i for i in range(n - 1) if (r := rank(symbols[i] << PAIR_BITS | symbols[i + 1])) is not None]
        heapify(agenda)
        while agenda:
            entry = heappop(agenda)
            a = entry & PLACE_MASK
            b = right[a]
            first = symbols[a]
            if b < 0 or first < 0:
                continue
            pair = first << PAIR_BITS | symbols[b]
            r = rank(pair)
            if r is None or r + a != entry:
                continue
            symbols[a] = both = joined[pair]
            symbols[b] = GONE
            after = right[a] = right[b]
            if after >= 0:
                left[after] = a
                if (r := rank(both << PAIR_BITS | symbols[after])) is not None:
                    heappush(agenda, r + a)
            before = left[a]
            if before >= 0 and (r := rank(symbols[before] << PAIR_BITS | both)) is not None:
                heappush(agenda, r + before)
        return [s for s in symbols if s >= 0]

    def _runs(self, word: str) -> Iterator[str]:
        """The parts of a long word that no piece links."""
        start, beside = 0, self.beside
        for i in range(1, len(word)):
            if word[i - 1 : i + 1] not in beside:
                yield word[start:i]
                start = i
        yield word[start:]

    def _packed(self, symbols: list[int]) -> bytes:
        """Ids as bytes; characters outside the vocabulary in their byte pieces."""
        if max(symbols) >= OUTSIDE:
            known, symbols = symbols, []
            for symbol in known:
                if symbol < OUTSIDE:
                    symbols.append(symbol)
                elif self.byte_ids:
                    symbols += map(self.byte_ids.__getitem__, chr(symbol - OUTSIDE).encode())
                else:
                    symbols.append(self.unknown)
        return pack(f"<{len(symbols)}i", *symbols)

    def _long_word(self, word: str) -> bytes:
        """Ids of one word: an agenda for each run that a piece may link."""
        out: list[int] = []
        for run in self._runs(word):
            out += self._agenda(run) if len(run) > 1 else (self.symbols[run],)
        return self._packed(out)

    def _places(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For pairs of symbols the place of their score, and what they join to."""
        pairs = left << PAIR_BITS | right
        at = np.minimum(np.searchsorted(self.pairs, pairs), len(self.pairs) - 1)
        found = self.pairs[at] == pairs
        return np.where(found, self.pair_places[at], NO_PLACE), self.pair_joins[at]

    def _short_words(self, words: list[str]) -> list[bytes]:
        """Ids of words of at most ``SHORT`` characters, their agendas side by side.

        A row of ``places`` is the agenda of one word: the place of each of its
        adjacent pairs.  Each turn takes the first lowest entry of every row,
        joins that pair, closes the gap and looks up the two new neighbours; rows
        without an entry are done.
        """
        width = max(map(len, words)) + 1
        symbols = np.full((len(words), width), NONE, np.int64)
        lengths = np.array([len(w) for w in words])
        inside = np.arange(width) < lengths[:, None]
        symbols[inside] = list(map(self.symbols.__getitem__, "".join(words)))
        places, joins = self._places(symbols[:, :-1], symbols[:, 1:])
        rows = np.arange(len(words))
        while True:
            at = places[rows].argmin(1)
            going = places[rows, at] != NO_PLACE
            rows, at = rows[going], at[going]
            if not len(rows):
                break
            symbols[rows, at] = joins[rows, at]
            step = np.arange(width - 1)
            symbols[rows, 1:] = np.take_along_axis(symbols[rows], np.minimum(step + 1 + (step >= at[:, None]), width - 1), 1)
            step = np.minimum(step + (step > at[:, None]), width - 2)
            places[rows], joins[rows] = np.take_along_axis(places[rows], step, 1), np.take_along_axis(joins[rows], step, 1)
            places[rows, at], joins[rows, at] = self._places(symbols[rows, at], symbols[rows, at + 1])
            rest = at > 0
            rows_, at_ = rows[rest], at[rest]
            places[rows_, at_ - 1], joins[rows_, at_ - 1] = self._places(symbols[rows_, at_ - 1], symbols[rows_, at_])
        inside = symbols != NONE
        flat, ends = symbols[inside], np.cumsum(inside.sum(1)).tolist()
        if (flat >= OUTSIDE).any():
            flat = flat.tolist()
            return [self._packed(flat[a:b]) for a, b in zip([0, *ends[:-1]], ends, strict=True)]
        raw = flat.astype("<i4").tobytes()
        return [raw[4 * a : 4 * b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian int32, without an end id."""
        return self.encode_marked([SPACE + text.replace(" ", SPACE) if text else "" for text in texts])

    def encode_marked(self, texts: list[str]) -> list[bytes]:
        """The same for texts that have the dummy prefix and the marks of white space."""
        if len(self.young) > self.most:
            self.young, self.old = {}, self.young
        words = [self.words(text) for text in texts]
        known, old = self.young, self.old
        missing = set().union(*words).difference(known)
        known.update((w, old[w]) for w in missing if w in old)
        fresh = [w for w in missing if w not in known]
        short = [w for w in fresh if len(w) <= SHORT]
        for start in range(0, len(short), TOGETHER):
            some = short[start : start + TOGETHER]
            known.update(zip(some, self._short_words(some), strict=True))
        long = [w for w in fresh if len(w) > SHORT]
        known.update((w, self._long_word(w)) for w in long)
        out = [b"".join(map(known.__getitem__, own)) for own in words]
        for word in long:
            if len(word) > LONGEST_CACHED:
                del known[word]
        return out

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(self.encode_all([text])[0], "<i4")

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: control ids are silent, the dummy prefix goes, bytes
        that are no UTF-8 become one U+FFFD each."""
        raw = b"".join(map(self.token_bytes.__getitem__, ids.tolist()))
        raw = raw[1:] if raw[:1] == b" " else raw
        try:
            return raw.decode()
        except UnicodeDecodeError:
            return _replaced(raw)


def _replaced(raw: bytes) -> str:
    out, at = [], 0
    while at < len(raw):
        for width in (1, 2, 3, 4):
            try:
                out.append(raw[at : at + width].decode())
                at += width
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            at += 1
    return "".join(out)


def _cutter(beside: set[str]):
    """A function that cuts a text where no piece can reach across.

    ``beside``: the pairs of neighbouring characters inside pieces.  If one has
    U+2581 after another character, texts stay whole.
    """
    if any(pair[0] != SPACE and pair[1] == SPACE for pair in beside):
        return lambda text: [text]
    parent: dict[str, str] = {}

    def root(c: str) -> str:
        while parent.setdefault(c, c) != c:
            parent[c] = parent[parent[c]]
            c = parent[c]
        return c

    for first, second in beside:
        if first != SPACE:
            parent[root(first)] = root(second)
    classes: dict[str, list[str]] = {}
    for c in sorted(parent):
        classes.setdefault(root(c), []).append(c)
    runs = [f"[{''.join(map(re.escape, own))}]+" for own in sorted(classes.values(), key=len, reverse=True)]
    return re.compile(f"{SPACE}*(?:{'|'.join([*runs, f'[^{SPACE}]'])})|{SPACE}+", re.DOTALL).findall


_codecs: dict[str, PieceCodec] = {}


def codec_for(path: str) -> PieceCodec:
    """One codec for each Python worker, kept between tasks."""
    if path not in _codecs:
        _codecs[path] = PieceCodec(path)
    return _codecs[path]


def _encoder(path: str):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from sentencepiece import SentencePieceProcessor

        codec, library = codec_for(path), SentencePieceProcessor(model_file=path)
        end = np.array([codec.end], "<i4").tobytes()
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                part = batch.slice(start, ROWS)
                texts = [t or "" for t in part.column(1).to_pylist()]
                own = [np.frombuffer(b + end, "<i4") for b in codec.encode_all(texts)]
                decoded = [codec.decode(ids) for ids in own]
                agrees = []
                for text, ids, back in zip(texts, own, decoded, strict=True):
                    theirs = library.encode(text, add_eos=True, num_threads=1)
                    agrees.append(ids.tolist() == theirs and library.decode(theirs) == back)
                offsets = np.zeros(len(own) + 1, np.int32)
                np.cumsum([len(x) for x in own], out=offsets[1:])
                flat = pa.array(np.concatenate(own), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.ListArray.from_arrays(pa.array(offsets), flat), pa.array(decoded, pa.string()), pa.array(agrees, pa.bool_())],
                    ["doc_id", "ids", "decoded", "agrees"])

    return encode


def encoded(docs: DataFrame, model: str, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids with the end id, the text decoded from them, agrees).

    ``agrees`` says that the library has the same ids and the same decoded text.
    Rows stay where they are: nothing is shuffled.
    """
    bounded_batches(docs.sparkSession, 256)
    ensure_importable(docs.sparkSession)
    kind = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(_encoder(model), f"doc_id {kind}, ids array<int>, decoded string, agrees boolean")


def codec_digests(docs: DataFrame, model: str) -> DataFrame:
    """Per document the length and digests of its ids and of the decoded text."""
    listed = F.array_join(F.col("ids").cast("array<string>"), " ")
    return encoded(docs, model).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(listed.cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"), "agrees")
