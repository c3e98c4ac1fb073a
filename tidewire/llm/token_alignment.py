"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes.

Both tokenizers spell out the same bytes.  A dangling-suffix transducer reads
their tokens in turn: its state is the side that leads and the bytes of that
side which the other has not matched yet.  The next token always comes from the
side behind; it eats from the residual or, if longer, leaves a residual of its
own.  An empty residual closes a group: the tokens since the last close cover
the same bytes.  Transitions are memoised by residual and next token.

Both tokenizers cut before white space that follows another character and between
a letter and a mark (the second one's vocabulary tells where), so the residual is
empty there too.  Words with the white space before them are thus aligned once,
many at a time, and go through a bounded cache, flat arrays by the word's place;
texts where one of them can't be aligned, or that hold characters whose kind is
not the same for all libraries, are read whole.

A pair of ids is linked in a document if the document has a group with both.
How many documents hold each pair is counted over the whole corpus; the counts
are written once as sorted flat arrays in the shared folder and memory-mapped
by the tasks that look up the pairs of their documents, so no pair of a frequent
token meets all the others in one task.

Defined results: null and empty texts, and texts that one side can't spell out,
have no tokens: zeros and an empty string; null and repeated ids are rows (and
documents) of their own; texts are read whole, at any length; an empty table
gives an empty result; columns other than the two named are never read.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.session import ensure_importable

from .piece_codec import SPACE, PieceCodec
from .storage import bounded_batches, get_bytes, mapped, put_file, work_folder, written

CACHED_WORDS = 280_000
LONGEST_CACHED = 64
MOST_TRANSITIONS = 400_000
ROWS = 128
SIDE_BITS = 32
LEAST_LINKS = 1 << 20
#: These count as white space for some libraries only.
LETTER, MARK = r"[^\W\d_]", r"[!-/:-@\[-`{-~]"
_letter, _mark = re.compile(LETTER).match, re.compile(MARK).match
_odd = re.compile("[\x1c-\x1f᠎]").search
#: One space and what both libraries read alike with or without the words around.
_plain = re.compile(rf" [^\s{SPACE}]+").fullmatch
#: ASCII and letters that have been letters in all versions of Unicode since 2.0.
_settled = re.compile("[\x00-\x7fÀ-ÖØ-öø-ſА-яぁ-ゔァ-ヺ一-龥가-힣]+").fullmatch


def _byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in byte-level vocabularies: visible
    Latin-1 characters for themselves, then code points from 256 for the rest."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(256 + n): b for n, b in enumerate(rest)}


#: The cut that byte-level pre-tokenisers of the library make (fixed value).
BYTE_LEVEL_CUT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class ByteLevelSide:
    """Ids of a byte-level vocabulary of the tokenizers library.

    ASCII words, and plain ones of settled letters too, go through a faster
    encoder over the same vocabulary, which merges by id where the library merges
    by the file's list.  Both give the same ids if merges make ids in ascending
    order and the library encodes every piece as itself: then whatever two symbols spell out a piece when its turn comes
    are the two that the list names.  That is tried for all pieces when the file
    is read; if it doesn't hold, the library encodes all words.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        spec = json.loads(self.tokenizer.to_str())
        step = spec["pre_tokenizer"] or {}
        self.by_word = spec["normalizer"] is None and step.get("type") == "ByteLevel" and step.get("use_regex", True)
        letters = _byte_letters()
        vocab = self.tokenizer.get_vocab()
        self.token_bytes = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            self.token_bytes[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        self.widths = np.array([len(b) for b in self.token_bytes])
        self.quick = self._quick(spec, vocab) if self.by_word else None

    def _quick(self, spec: dict, vocab: dict[str, int]):
        import tiktoken

        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        made = [vocab.get("".join(pair), -1) for pair in pairs]
        added = {t["id"] for t in spec["added_tokens"]}
        pieces = [(t, i) for t, i in vocab.items() if i not in added]
        alone = {i for t, i in pieces if len(t) == 1}
        model = self.tokenizer.model
        if min(made, default=0) < 0 or any(a >= b for a, b in zip(made, made[1:])) or alone | set(made) != {i for _, i in pieces} or len(alone) != 256:
            return None
        if any(len(found := model.tokenize(t)) != 1 or found[0].id != i for t, i in pieces):
            return None
        ranks = {self.token_bytes[i]: i for _, i in pieces}
        return tiktoken.Encoding("own", pat_str=BYTE_LEVEL_CUT, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def ids(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<i4").tobytes()

    def ids_of_plain_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words that begin with their only space, and how many each
        has.  The space parts a word from the one before, so they are read as one text."""
        ids = np.array(self._joined(words), "<i4")
        ends = np.cumsum(self.widths[ids])
        word_ends = np.cumsum([len(w.encode()) for w in words])
        closes = np.zeros(int(max(ends[-1], word_ends[-1])) + 1, bool)
        closes[word_ends] = True
        last = np.flatnonzero(closes[ends])
        if len(last) != len(words) or last[-1] != len(ids) - 1:
            return _flat(list(map(self.ids, words)))
        return ids, np.diff(last, prepend=-1)

    def _joined(self, words: list[str]) -> list[int]:
        text = "".join(words)
        if self.quick is not None and (text.isascii() or _settled(text)):
            return self.quick(text)
        return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def settled(self, word: str) -> bool:
        """Whether the faster encoder may read this plain word."""
        return self.quick is not None and (word.isascii() or _settled(word) is not None)

    def ids_of_words(self, words: list[str]) -> list[bytes]:
        """One call for words that end without white space and begin with white
        space or a mark: after a letter both are cut off, so a letter goes in
        front of each and the ids are parted again by their bytes."""
        if self.quick is None:
            return self._parted(words, lambda text: self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids)
        plain = [w for w in words if w.isascii()]
        rest = [w for w in words if not w.isascii()]
        found = dict(zip(plain, self._parted(plain, self.quick), strict=True)) | dict(zip(rest, self._parted(
            rest, lambda text: self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids), strict=True))
        return [found[w] for w in words]

    def _parted(self, words: list[str], encode) -> list[bytes]:
        if not words:
            return []
        ids = np.array(encode(" a" + " a".join(words)))
        ends = np.cumsum(self.widths[ids])
        sizes = np.array([len(w.encode()) for w in words]) + 2
        last = np.searchsorted(ends, np.cumsum(sizes)) + 1
        first = np.searchsorted(ends, np.cumsum(sizes) - sizes + 2) + 1
        raw = ids.astype("<i4").tobytes()
        return [raw[a:b] for a, b in zip((4 * first).tolist(), (4 * last).tolist(), strict=True)]


def _word_cutter(beside: set[str]):
    """Cuts a text where neither side can reach across: before white space that
    follows another character, but for the marks of white space that the second
    side's pieces hold after others (``beside``: pairs of characters in its
    pieces), and between a letter or number and a mark of ASCII, if no piece
    holds such a pair."""
    kept = {y for x, y in beside if y.isspace() and x != SPACE and not x.isspace()}
    parts = []
    if not any(_letter(x) and _mark(y) for x, y in beside):
        parts.append(rf"\s*+{LETTER}++(?={MARK})")
    if kept:
        marks = "".join(map(re.escape, sorted(kept)))
        parts.append(rf"\s*\S+(?:[{marks}]\s*\S+)*(?:[{marks}]\s*)?")
    else:
        parts.append(r"\s*\S+")
    return re.compile("|".join([*parts, r"\s+"])).findall


class State:
    """A residual; ``behind`` tells whose token comes next (0 first side, 1 second)."""

    __slots__ = ("behind", "residual", "after")

    def __init__(self, behind: int, residual: bytes):
        self.behind, self.residual, self.after = behind, residual, {}


class Transducer:
    """Groups of tokens of two sides that spell out the same bytes."""

    def __init__(self, first: list[bytes], second: list[bytes]):
        self.sides = (first, second)
        self.forget()

    def forget(self) -> None:
        self.closed = State(0, b"")
        self.states: dict[tuple[int, bytes], State] = {(0, b""): self.closed, (1, b""): self.closed}
        self.transitions = 0

    def _learn(self, state: State, token: int) -> State:
        spelt, residual = self.sides[state.behind][token], state.residual
        if spelt.startswith(residual):
            key = (1 - state.behind, spelt[len(residual):])
        elif residual.startswith(spelt):
            key = (state.behind, residual[len(spelt):])
        else:
            raise ValueError("the two sides spell out other bytes")
        found = self.states.get(key)
        if found is None:
            found = self.states[key] = State(*key)
        state.after[token] = found
        self.transitions += 1
        return found

    def groups(self, a: list[int], b: list[int]) -> tuple[list[int], list[int]]:
        """Where groups end on both sides, for tokens that spell out the same bytes."""
        if self.transitions > MOST_TRANSITIONS:
            self.forget()
        closed, learn = self.closed, self._learn
        begin, i, j, n = closed.after.get, 0, 0, len(a)
        ends: tuple[list[int], list[int]] = ([], [])
        while i < n:
            token = a[i]
            i += 1
            state = begin(token) or learn(closed, token)
            while state is not closed:
                if state.behind:
                    token = b[j]
                    j += 1
                else:
                    token = a[i]
                    i += 1
                state = state.after.get(token) or learn(state, token)
            ends[0].append(i)
            ends[1].append(j)
        return ends


class Alignment:
    """The groups of a text: ids of both sides and where each group ends."""

    def __init__(self, a: np.ndarray, b: np.ndarray, ends: tuple[list[int], list[int]]):
        self.a, self.b = a.astype(np.int64), b.astype(np.int64)
        self.ends = tuple(np.array(e, np.int64) for e in ends)
        self.sizes = tuple(np.diff(e, prepend=0) for e in self.ends)

    def links(self) -> np.ndarray:
        """A pair for each two tokens of a group, the first side's id in front."""
        (_, ends_b), (n_a, n_b) = self.ends, self.sizes
        each = np.repeat(n_b, n_a)  # for each token of the first side its group's tokens of the second
        within = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
        return np.repeat(self.a, each) << SIDE_BITS | self.b[np.repeat(np.repeat(ends_b - n_b, n_a), each) + within]

    def marked(self) -> np.ndarray:
        """The tokens in the order ``a1,a2|b1;``, each as three times its id and the mark behind."""
        (ends_a, ends_b), (n_a, n_b) = self.ends, self.sizes
        out = np.empty(len(self.a) + len(self.b), np.int64)
        a, b = 3 * self.a, 3 * self.b
        a[ends_a - 1] += 1
        b[ends_b - 1] += 2
        out[np.arange(len(a)) + np.repeat(ends_b - n_b, n_a)] = a
        out[np.arange(len(b)) + np.repeat(ends_a, n_b)] = b
        return out


def _flat(ids: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All ids, and how many each text has."""
    return np.frombuffer(b"".join(ids), "<i4"), np.array([len(b) // 4 for b in ids], np.int64)


def _ends_open(word: str) -> bool:
    return word[-1].isspace()


class _Places(dict):
    """Word to place; a word that is asked for first gets a free place or the next."""

    def __init__(self):
        super().__init__()
        self.size, self.free, self.fresh = 0, [], []

    def new(self) -> int:
        if self.free:
            return self.free.pop()
        self.size += 1
        return self.size - 1

    def __missing__(self, word: str) -> int:
        self.fresh.append(word)
        place = self[word] = self.new()
        return place


class Known:
    """What is known of words, and of texts that were read whole, by their place.

    ``numbers``: tokens of both sides, groups, links; ``texts``: the groups, None
    if a side doesn't spell out the word; ``links`` from ``starts`` on.
    """

    def __init__(self):
        self.places = _Places()
        self.texts: list[str | None] = []
        self.numbers = np.zeros((0, 4), np.int64)
        self.starts = np.zeros(0, np.int64)
        self.links = np.zeros(0, np.int64)
        self.n_links = self.kept_links = 0
        self.broken: set[int] = set()
        self.passing: list[str | int] = []

    def __getitem__(self, place: int) -> tuple[int, int, int, str, np.ndarray]:
        n_a, n_b, groups, n_links = self.numbers[place].tolist()
        start = int(self.starts[place])
        return n_a, n_b, groups, self.texts[place] or "", self.links[start : start + n_links]

    def put(self, places: np.ndarray, found: tuple[np.ndarray, list[str | None], np.ndarray]) -> None:
        """Keeps what ``Aligner._aligned`` found at these places."""
        numbers, texts, links = found
        size, end = self.places.size, self.n_links + len(links)
        if size > len(self.starts):
            more = max(size, 2 * len(self.starts)) - len(self.starts)
            self.numbers = np.concatenate((self.numbers, np.zeros((more, 4), np.int64)))
            self.starts = np.concatenate((self.starts, np.zeros(more, np.int64)))
            self.texts += [None] * more
        if end > len(self.links):
            self.links = np.concatenate((self.links[: self.n_links], np.zeros(max(end, 2 * len(self.links)) - self.n_links, np.int64)))
        self.links[self.n_links : end] = links
        self.numbers[places] = numbers
        self.starts[places] = np.cumsum(numbers[:, 3]) - numbers[:, 3] + self.n_links
        for place, text in zip(places.tolist(), texts, strict=True):
            self.texts[place] = text
        broken = places[numbers[:, 0] == 0].tolist()
        if broken or self.broken:
            self.broken.difference_update(places.tolist())
            self.broken.update(broken)
        self.n_links = end

    def taken(self, words: list[str]) -> tuple[np.ndarray, list[str | None], np.ndarray]:
        """What is known of these words, as ``put`` takes it."""
        own = list(map(self.places.__getitem__, words))
        at = np.array(own, np.int64)
        return self.numbers[at], list(map(self.texts.__getitem__, own)), self.links_of(at)

    def links_of(self, places: np.ndarray) -> np.ndarray:
        """The links at these places, one after the other."""
        each, starts = self.numbers[places, 3], self.starts[places]
        if not each.all():
            starts, each = starts[each > 0], each[each > 0]
        if not len(each):
            return np.zeros(0, np.int64)
        ends = np.cumsum(each)
        at = np.ones(ends[-1], np.int64)  # steps from link to link
        at[0] = starts[0]
        at[ends[:-1]] = starts[1:] - (starts[:-1] + each[:-1] - 1)
        return self.links[np.cumsum(at, out=at)]

    def drop_passing(self) -> None:
        """Long words and whole texts of the last call go; their links are the last ones."""
        for x in self.passing:
            place = self.places.pop(x) if isinstance(x, str) else x
            self.texts[place] = None
            self.places.free.append(place)
        self.passing = []
        self.n_links = self.kept_links
        if len(self.links) > 4 * self.n_links + LEAST_LINKS:
            self.links = self.links[: self.n_links].copy()


class Aligner:
    """Both sides and their transducer in one worker; what it knows is bounded."""

    def __init__(self, first: str, second: str):
        from sentencepiece import SentencePieceProcessor

        self.a = ByteLevelSide(first)
        self.b = PieceCodec(second, cached_words=CACHED_WORDS // 4)
        self.library = SentencePieceProcessor(model_file=second)
        self.transducer = Transducer(self.a.token_bytes, self.b.token_bytes)
        self.widths = [np.array([len(x) for x in table]) for table in self.transducer.sides]
        self.words = _word_cutter(self.b.beside)
        most = max(len(self.a.token_bytes), len(self.b.token_bytes))
        self.spelt = [f"{i}{mark}" for i in range(most) for mark in ",|;"]
        self.spelt_widths = np.array([len(x) for x in self.spelt])
        self.known, self.old = Known(), Known()

    def _aligned(self, texts: list[str], *sides: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, list[str | None], np.ndarray]:
        """Numbers, groups and links of texts with these ids (flat, and how many
        each text has); zeros and None for those that a side doesn't spell out.
        All of them run through the transducer in turn."""
        raw, tables = [t.encode() for t in texts], self.transducer.sides
        n_raw = np.array([len(r) for r in raw])
        flat, sizes = zip(*sides, strict=True)
        spelt = [np.concatenate(([0], np.cumsum(width[ids]))) for width, ids in zip(self.widths, flat, strict=True)]
        ends = [np.cumsum(size) for size in sizes]
        even = all((at[end] - at[end - size] == n_raw).all() for at, end, size in zip(spelt, ends, sizes, strict=True))
        kept, out = None, np.zeros((len(texts), 4), np.int64)
        if not (even and n_raw.all() and all(b"".join(map(table.__getitem__, ids.tolist())) == b"".join(raw) for ids, table in zip(flat, tables, strict=True))):
            kept = np.array([len(r) > 0 for r in raw], bool)
            for ids, size, end, table in zip(flat, sizes, ends, tables, strict=True):
                ids = list(map(table.__getitem__, ids.tolist()))
                kept &= [b"".join(ids[e - n : e]) == r for n, e, r in zip(size.tolist(), end.tolist(), raw, strict=True)]
            flat = [ids[np.repeat(kept, size)] for ids, size in zip(flat, sizes, strict=True)]
            sizes = [size[kept] for size in sizes]
        whole = Alignment(*flat, self.transducer.groups(*(x.tolist() for x in flat)))
        upto = [np.cumsum(size) for size in sizes]
        groups = np.searchsorted(whole.ends[0], upto[0]) + 1
        links = np.concatenate(([0], np.cumsum(whole.sizes[0] * whole.sizes[1])))[groups]
        numbers = np.stack([*sizes, np.diff(groups, prepend=0), np.diff(links, prepend=0)], 1)
        marked = whole.marked()
        text = "".join(map(self.spelt.__getitem__, marked.tolist()))
        at = np.concatenate(([0], np.cumsum(self.spelt_widths[marked])))[upto[0] + upto[1]].tolist()
        parts = [text[i : j - 1] for i, j in zip([0, *at[:-1]], at)]  # without the mark behind the last group
        if kept is None:
            return numbers, parts, whole.links()
        out[kept] = numbers
        rest = iter(parts)
        return out, [next(rest) if k else None for k in kept.tolist()], whole.links()

    def _ids(self, texts: list[str]) -> list[bytes]:
        return self.b.encode_marked([t.replace(" ", SPACE) for t in texts])

    def _read(self, words: list[str], plain: bool) -> None:
        """Aligns words of one kind.  Plain ones are given to the libraries, the
        second of which puts the space in front itself; of others those that end
        with white space come last."""
        if not words:
            return
        if plain:
            a, b = self.a.ids_of_plain_words(words), self.library.encode([w[1:] for w in words], num_threads=1)
            sizes = np.array(list(map(len, b)), np.int64)
            b = np.fromiter(chain.from_iterable(b), "<i4", sizes.sum()), sizes
        else:
            ending = list(filter(_ends_open, words))
            a = _flat(self.a.ids_of_words(words[: len(words) - len(ending)]) + list(map(self.a.ids, ending)))
            b = _flat(self._ids(words))
        self.known.put(np.array(list(map(self.known.places.__getitem__, words)), np.int64), self._aligned(words, a, b))

    def _learn(self, fresh: list[str]) -> None:
        """Takes up words that have a place but nothing else yet."""
        known, old = self.known, self.old.places
        long = [w for w in fresh if len(w) > LONGEST_CACHED]
        fresh = [w for w in fresh if len(w) <= LONGEST_CACHED]
        again = [w for w in fresh if w in old]
        if again:
            known.put(np.array(list(map(known.places.__getitem__, again)), np.int64), self.old.taken(again))
            fresh = [w for w in fresh if w not in old]
        plain = list(filter(_plain, fresh))
        settled = list(filter(self.a.settled, plain))
        self._read(settled, plain=True)
        self._read(list(set(plain).difference(settled)), plain=True)
        self._read(sorted(set(fresh).difference(plain), key=_ends_open), plain=False)
        known.kept_links = known.n_links
        self._read(sorted(long, key=_ends_open), plain=False)
        known.passing += long

    def parts(self, texts: list[str]) -> tuple[Known, list[list[int]]]:
        """What is known by place, and for each text the places of its words; none
        for a text that can't be aligned.  It holds until the next call."""
        self.known.drop_passing()
        if len(self.known.places) > CACHED_WORDS:
            self.known, self.old = Known(), self.known
        known = self.known
        texts = [" " + t if t else "" for t in texts]
        words = [self.words(t) if self.a.by_word and not _odd(t) else None for t in texts]
        out = [None if own is None else list(map(known.places.__getitem__, own)) for own in words]
        fresh, known.places.fresh = known.places.fresh, []
        self._learn(fresh)
        for i, (text, own) in enumerate(zip(texts, out, strict=True)):
            if own is None or known.broken and not known.broken.isdisjoint(own):
                place = known.places.new()
                known.passing.append(place)
                known.put(np.array([place]), self._aligned([text], _flat([self.a.ids(text)]), _flat(self._ids([text]))))
                out[i] = [] if place in known.broken else [place]
        return known, out


@lru_cache(4)
def aligner_for(first: str, second: str) -> Aligner:
    """One aligner for each Python worker, kept between tasks."""
    return Aligner(first, second)


def _aligner(first: str, second: str):
    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = aligner_for(first, second)
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                part = batch.slice(start, ROWS)
                sums, texts, pairs, times = [], [], [], []
                known, places = aligner.parts([t or "" for t in part.column(1).to_pylist()])
                for own in places:
                    at = np.array(own, np.int64)
                    distinct, counted = np.unique(known.links_of(at), return_counts=True)
                    sums.append(known.numbers[at].sum(0).tolist())
                    texts.append(";".join(map(known.texts.__getitem__, own)))
                    pairs.append(distinct)
                    times.append(counted)
                ends = pa.array(np.cumsum([0, *map(len, pairs)]), pa.int32())
                lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate(x), pa.int64())) for x in (pairs, times)]
                columns = [pa.array(column, pa.int64()) for column in zip(*sums, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *columns, pa.array(texts, pa.string()), *lists],
                    ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "pairs", "times"])

    return align


def aligned(docs: DataFrame, first: str, second: str, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document its groups and its pairs.

    ``groups``: the ids of both sides in order, as ``a1,a2|b1;a3|b2,b3``;
    ``pairs``: each linked pair once, the first side's id in the upper 32 bits;
    ``times``: how many links of the document have that pair.
    """
    bounded_batches(docs.sparkSession, 256)
    ensure_importable(docs.sparkSession)
    kind = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(
        _aligner(first, second),
        f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups string, pairs array<long>, times array<long>")


def pair_counts(rows: DataFrame) -> DataFrame:
    """(pair, documents, best): in how many documents a pair is linked, and
    whether no pair of the same first id has more.

    The maxima are one row for each id of the first vocabulary, which bounds
    their broadcast.
    """
    counts = rows.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("documents"))
    counts = written(counts, work_folder(rows.sparkSession, "pair-counts"))
    side = F.shiftright("pair", SIDE_BITS)
    most = counts.groupBy(side.alias("side")).agg(F.max("documents").alias("most"))
    return counts.join(F.broadcast(most), side == F.col("side")).select("pair", "documents", (F.col("documents") == F.col("most")).alias("best"))


def write_pair_counts(counts: DataFrame, folder: str) -> None:
    """Sorted flat arrays of pairs, counts and best flags, in ranges of pairs."""
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId()
        parts = [[np.asarray(batch.column(i)) if i < 2 else batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)] for batch in batches]
        if parts:
            for i, (name, kind) in enumerate((("pair", "<i8"), ("count", "<i8"), ("best", "?"))):
                put_file(f"{folder}/{number:05d}.{name}", [p[i].astype(kind).tobytes() for p in parts])
            yield pa.RecordBatch.from_pydict({"shard": pa.array([number], pa.int64()), "first": pa.array([int(parts[0][0][0])], pa.int64())})

    ensure_importable(counts.sparkSession)
    ranged = counts.repartitionByRange("pair").sortWithinPartitions("pair")
    shards = ranged.mapInArrow(write, "shard long, first long").collect()  # one row for each partition
    put_file(f"{folder}/manifest.json", [json.dumps(sorted((r.first, r.shard) for r in shards)).encode()])


class PairCounts:
    """The arrays of ``write_pair_counts``, memory-mapped."""

    def __init__(self, folder: str):
        shards = json.loads(get_bytes(f"{folder}/manifest.json"))
        self.firsts = np.array([first for first, _ in shards], np.int64)
        names = [f"{folder}/{shard:05d}." for _, shard in shards]
        self.shards = [[mapped(n + "pair", "<i8"), mapped(n + "count", "<i8"), mapped(n + "best", "?")] for n in names]

    def look_up(self, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Counts and best flags of pairs that the arrays hold."""
        counts, best = np.zeros(len(pairs), np.int64), np.zeros(len(pairs), np.int64)
        shard = np.searchsorted(self.firsts, pairs, side="right") - 1
        for at in np.unique(shard):
            own = shard == at
            keys, numbers, flags = self.shards[at]
            place = np.searchsorted(keys, pairs[own])
            counts[own], best[own] = numbers[place], flags[place]
        return counts, best


def _summer(folder: str):
    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = PairCounts(folder)
        for batch in batches:
            pairs, times = batch.column("pairs"), batch.column("times")
            ends = np.asarray(pairs.offsets)
            counts, best = held.look_up(np.asarray(pairs.flatten()))
            weight = np.asarray(times.flatten())
            totals = [np.concatenate(([0], np.cumsum(x))) for x in (weight * best, weight * counts)]
            ends = ends - ends[0]
            kept = [c for c in batch.schema.names if c not in ("pairs", "times")]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in kept), *(pa.array(t[ends[1:]] - t[ends[:-1]], pa.int64()) for t in totals)],
                [*kept, "n_best", "count_sum"])

    return sums


def with_corpus_links(rows: DataFrame, folder: str) -> DataFrame:
    """Rows with ``pairs`` and ``times`` replaced by what the corpus counts say."""
    ensure_importable(rows.sparkSession)
    kept = rows.drop("pairs", "times")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    return rows.mapInArrow(_summer(folder), f"{fields}, n_best long, count_sum long")


def alignment_report(docs: DataFrame, first: str, second: str) -> DataFrame:
    """Per document the sizes of its alignment, the digest of its groups, and
    how its links stand among those of all documents."""
    spark: SparkSession = docs.sparkSession
    folder = work_folder(spark, "alignment")
    digest = F.when(F.col("groups") == "", F.lit("")).otherwise(F.sha2(F.col("groups").cast("binary"), 256))
    rows = aligned(docs, first, second).withColumn("groups_sha256", digest).drop("groups")
    rows = written(rows, f"{folder}/rows")
    write_pair_counts(pair_counts(rows), f"{folder}/counts")
    out = with_corpus_links(rows, f"{folder}/counts")
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
