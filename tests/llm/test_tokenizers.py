"""Own codec and alignment against the libraries and plain versions."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest

from tidewire.llm.piece_codec import PieceCodec, codec_digests, encoded
from tidewire.llm.token_alignment import Aligner, ByteLevelSide, Transducer, aligned, alignment_report

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    None, "", " ", "  ", "\n", "a", "▁", "a▁b c", "<s> </s> <unk> <0x41>", "<|endoftext|> x", "don't, I'll!! we've", "x\r\n y\r", "a \r b;\r\n",
    "tab\tthere\x1cand\x1f !", "᠎a ᠎", "日本語のテキスト、です。 한국어", "🙂👩‍👩‍👧 ok", "é ́", "１２３ ² ½ 12345", "no break em ",
    "end  ", "\u0000 nul", "z" * 300 + " " + "!?" * 200, "word " * 3000, "Ünïcödé, naïve. Straße;Ελληνικά,русский-текст",
]


def texts(n=250, seed=7):
    rnd = random.Random(seed)
    alphabet = "abcdeXYZ  ▁　 \n\t\réß字かав🙂0123�.,'!-"
    far = [(1, 0xD800), (0xE000, 0x110000)]
    return ODD + ["".join(
        rnd.choice(alphabet) if rnd.random() < 0.85 else chr(rnd.randrange(*rnd.choice(far))) for _ in range(rnd.randrange(50))) for _ in range(n)]


@pytest.fixture(scope="module")
def pieces():
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=B)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_codec_equals_the_library(pieces):
    codec = PieceCodec(B)
    for _ in range(2):  # the second time from the cache
        for text, raw in zip(texts(), codec.encode_all([t or "" for t in texts()]), strict=True):
            ids = pieces.encode(text or "")
            assert codec.encode(text or "").tolist() == ids and len(raw) == 4 * len(ids)
            assert codec.decode(codec.encode(text or "")) == pieces.decode(ids)


def test_agenda_of_long_and_short_words_agree(monkeypatch):
    words = ["▁" + "".join(random.Random(i).choices("etaoinshrdlu", k=i % 24)) for i in range(400)]
    codec = PieceCodec(B)
    assert codec._short_words(words) == [codec._long_word(w) for w in words]


def test_codec_with_a_small_cache(pieces):
    codec = PieceCodec(B, cached_words=3)
    for text in texts(60, seed=3):
        assert codec.encode(text or "").tolist() == pieces.encode(text or "")


def test_bytes_that_are_no_text_become_replacements(pieces):
    codec = PieceCodec(B)
    import numpy as np

    for run in ([0xE6, 0x97], [0xFF], [0xE6, 0x97, 0xA5], [0x41, 0xC3]):
        ids = [codec.byte_ids[b] for b in run]
        assert codec.decode(np.array(ids)) == pieces.decode(ids)


def test_digests_of_odd_rows(spark, pieces):
    rows = [(i // 2, t, "x") for i, t in enumerate(texts(80))] + [(None, "same", "x")] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    found = sorted((tuple(r) for r in codec_digests(docs, B).collect()), key=repr)
    expected = []
    for doc, text, _ in rows:
        ids = pieces.encode(text or "", add_eos=True)
        expected.append((doc, len(ids), sha(" ".join(map(str, ids))), sha(pieces.decode(ids)), True))
    assert found == sorted(expected, key=repr)
    assert codec_digests(docs.where("false"), B).count() == 0
    assert encoded(docs, B).columns == ["doc_id", "ids", "decoded", "agrees"]


def brute(text, a_side, pieces):
    """Ids of both sides and groups by byte offsets; None if a side spells out other bytes."""
    from tidewire.llm.token_alignment import _byte_letters

    if not text:
        return None
    letters, whole = _byte_letters(), (" " + text).encode()
    a = a_side.encode(" " + text, add_special_tokens=False).ids
    b = pieces.encode(text)
    spelt_a = [bytes(letters[c] for c in a_side.id_to_token(i)) for i in a]
    spelt_b = [bytes([int(p[3:-1], 16)]) if len(p := pieces.id_to_piece(i)) == 6 and p.startswith("<0x") else p.replace("▁", " ").encode() for i in b]
    if b"".join(spelt_a) != whole or b"".join(spelt_b) != whole:
        return None

    def ends(spelt):
        at, out = 0, []
        for s in spelt:
            at += len(s)
            out.append(at)
        return out

    ends_a, ends_b = ends(spelt_a), ends(spelt_b)
    both, groups, i, j = set(ends_a) & set(ends_b), [], 0, 0
    for cut in sorted(both):
        k, m = ends_a.index(cut) + 1, ends_b.index(cut) + 1
        groups.append((a[i:k], b[j:m]))
        i, j = k, m
    return a, b, groups


def test_alignment_equals_byte_offsets(spark, pieces):
    from tokenizers import Tokenizer

    side = Tokenizer.from_file(A)
    side.encode_special_tokens = True
    rows = [(i if i % 9 else None, t, 0, "g") for i, t in enumerate(texts(150) + ["the cat, the dog. the end"] * 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_a int, groups string")
    plain = [(doc, brute(text, side, pieces)) for doc, text, *_ in rows]
    holders = Counter(p for _, x in plain if x for p in {(i, j) for own, other in x[2] for i in own for j in other})
    best = defaultdict(int)
    for (i, _), n in holders.items():
        best[i] = max(best[i], n)
    expected = []
    for doc, x in plain:
        a, b, groups = x or ([], [], [])
        links = [(i, j) for own, other in groups for i in own for j in other]
        text = ";".join(f"{','.join(map(str, own))}|{','.join(map(str, other))}" for own, other in groups)
        expected.append((doc, len(a), len(b), len(groups), len(links), sum(holders[p] == best[p[0]] for p in links),
                         sum(holders[p] for p in links), sha(text) if text else ""))
    found = [tuple(r) for r in alignment_report(docs.repartition(3), A, B).collect()]
    assert sorted(found, key=repr) == sorted(expected, key=repr)
    assert any(r[1] for r in found) and any(not r[1] for r in found)
    held = aligned(docs, A, B).where("n_links > 0").select("n_links", "pairs", "times").collect()
    assert all(sum(r.times) == r.n_links and sorted(set(r.pairs)) == r.pairs for r in held)


def test_alignment_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert alignment_report(docs, A, B).collect() == []
    empty = spark.createDataFrame([(1, None), (2, ""), (3, "▁")], "doc_id long, text string")
    assert sorted(tuple(r) for r in alignment_report(empty, A, B).collect()) == [(i, 0, 0, 0, 0, 0, 0, "") for i in (1, 2, 3)]


def test_transducer_closes_on_empty_residual():
    first, second = [b"ab", b"c", b"abc", b"d"], [b"a", b"bc", b"abcd", b"cd", b"b"]
    t = Transducer(first, second)
    assert t.groups([0, 1, 2, 3], [0, 1, 2]) == ([2, 4], [2, 3])
    assert t.groups([0, 1, 3], [0, 4, 3]) == ([1, 3], [2, 3])
    assert t.groups([], []) == ([], [])
    before = t.transitions
    t.groups([0, 1, 2, 3], [0, 1, 2])
    assert t.transitions == before  # all from memory
    with pytest.raises(ValueError):
        t.groups([3], [0])


def test_words_and_whole_texts_align_alike():
    some = [t for t in texts(120, seed=11) if t]
    by_word, whole = Aligner(A, B), Aligner(A, B)
    whole.a.by_word = False

    def result(aligner):
        entries, places = aligner.parts(some)
        return [(";".join(entries[i][3] for i in own), sum(entries[i][2] for i in own)) for own in places]

    assert result(by_word) == result(whole)


def test_quick_encoder_equals_the_library():
    side = ByteLevelSide(A)
    assert side.quick is not None
    rnd = random.Random(1)
    words = [" " * rnd.randrange(1, 3) + "".join(rnd.choice("etaoinshrdluXQZ019'-_.,!?$#\\") for _ in range(rnd.randrange(1, 14))) for _ in range(4000)]
    words = [w for w in words if not w[-1].isspace()]
    assert side.ids_of_words(words) == [side.ids(w) for w in words]


def test_plain_words_skip_the_agenda_and_known_ones_are_not_read_again():
    """F1 of round 3: op11 took 1452 CPU seconds a GB."""
    aligner, slow, read = Aligner(A, B), [], []
    marked, own = aligner.b.encode_marked, aligner._aligned
    aligner.b.encode_marked = lambda words: (slow.extend(words), marked(words))[1]
    aligner._aligned = lambda words, *sides: (read.extend(words), own(words, *sides))[1]
    some = ["the cat naïve café", "Straße русский the\ncat", "the cat naïve café"]
    entries, places = aligner.parts(some)
    assert slow == ["\ncat"]
    assert sorted(read) == sorted([" the", " cat", " naïve", " café", " Straße", " русский", "\ncat"])
    first = [[repr(entries[i]) for i in own] for own in places]
    entries, places = aligner.parts(some)
    assert len(read) == 7 and first == [[repr(entries[i]) for i in own] for own in places]


@pytest.mark.parametrize("limit", [0, 40, 100_000])
def test_forgetting_changes_nothing(monkeypatch, limit):
    """Small generations, long words and texts read whole give back their places."""
    from tidewire.llm import token_alignment

    monkeypatch.setattr(token_alignment, "CACHED_WORDS", limit)
    monkeypatch.setattr(token_alignment, "LEAST_LINKS", 64)
    some, aligner, whole = [t for t in texts(200, seed=5) if t] + ["q" * 200 + ", the"] * 3, Aligner(A, B), Aligner(A, B)
    whole.a.by_word = False

    def result(aligner, part):
        known, places = aligner.parts(part)
        links = [sorted(known.links_of(np.array(own, np.int64)).tolist()) for own in places]
        return [(";".join(known[i][3] for i in own), known.numbers[own].sum(0).tolist(), x) for own, x in zip(places, links, strict=True)]

    for _ in range(2):
        for start in range(0, len(some), 16):
            part = some[start : start + 16]
            assert result(aligner, part) == result(whole, part)
    assert not whole.known.places and whole.known.places.size <= 2 * 16 and len(whole.known.links) <= 200_000
    assert all(len(w) <= token_alignment.LONGEST_CACHED for w in aligner.known.places if w not in aligner.known.passing)


def test_plain_words_equal_the_libraries(pieces):
    side, rnd = ByteLevelSide(A), random.Random(2)
    assert side.quick is not None
    letters = "etaoinshrdluXQZ019'-_.,!?$#\\éßñöżДжяあカ漢字한🙂٣²"
    words = [" " + "".join(rnd.choice(letters) for _ in range(rnd.randrange(1, 14))) for _ in range(4000)]
    settled = [w for w in words if side.settled(w)]
    rest = [w for w in words if not side.settled(w)]
    assert len(settled) > 500 and len(rest) > 500
    for some in (settled, rest):
        ids, sizes = side.ids_of_plain_words(some)
        assert [x.astype("<i4").tobytes() for x in np.split(ids, np.cumsum(sizes)[:-1])] == [side.ids(w) for w in some]
    codec = PieceCodec(B)
    assert [np.frombuffer(x, "<i4").tolist() for x in codec.encode_all([w[1:] for w in words])] == pieces.encode([w[1:] for w in words])
