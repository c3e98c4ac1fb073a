"""Token-ID / binary output.

Layout of a token store (a folder in the shared file system)::

    shard-00000.ids   flat little-endian unsigned token ids (uint16 or uint32)
    shard-00000.off   int64 little-endian, n_docs + 1 offsets into the .ids file
    shard-00000.doc   int64 little-endian document ids, INT64_MIN for null
    manifest.json     dtype and, for each shard, first token and first document

Shards follow one another in ascending document id.  A shard knows only its
own offsets; the base of each comes from the prefix sums of the shard totals,
which are one small row for each partition.

Defined results: a null text is an empty one and holds just the end id; null
document ids come first; rows that repeat a document id are documents of their
own, in order of text; an empty table makes a store without shards; columns
other than the two named are never read.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import bounded_batches, get_bytes, mapped, put_file, work_folder
from .textkernel import raw_texts

NULL_ID = -(2**63)
END_ID = 1
CACHED_PIECES = 250_000
#: Bytes of Latin-1 that this module cuts by itself: white space, visible ASCII, letters.
_OWN = bytes([*range(9, 14), *range(32, 127), *range(0xC0, 0xD7), *range(0xD8, 0xF7), *range(0xF8, 0x100)])


def _is_own(text: str) -> bool:
    """Whether only own characters occur, and nothing that may be a special token."""
    try:
        return not text.encode("latin-1").translate(None, _OWN) and "<|" not in text
    except UnicodeEncodeError:
        return False


class Pieces:
    """Ids of whole texts by way of a bounded cache of pieces.

    The tokenizer drops white space and cuts a text by the vocabulary file's
    own pattern before it merges, so a text's ids are those of its pieces in
    order.  Texts of ASCII and Latin-1 letters are composed already; they are
    lower-cased and cut here, and pieces that are not in the cache go through the
    tokenizer in one call, whose word-end ids part them again.  In other texts
    the words with other characters, and those that may hold a special token,
    are entries of their own and go through the tokenizer one by one.  The cache
    has two halves: when the young one is full, the old one is dropped.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocab = self.tokenizer.get_vocab()
        self.dtype = np.dtype("<u2" if max(vocab.values()) < 2**16 else "<u4")
        spec = json.loads(self.tokenizer.to_str())
        suffix = spec["model"].get("end_of_word_suffix")
        self.cut = _split_pattern(spec) if suffix else None
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        if suffix:
            self.ends[[i for token, i in vocab.items() if token.endswith(suffix)]] = True
        self.young: dict[str | bytes, bytes] = {}
        self.old: dict[str | bytes, bytes] = {}

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def _keys(self, text: str) -> list[str | bytes]:
        """The pieces of a text; odd words stand as bytes."""
        if _is_own(text):
            return self.cut(text.lower())
        keys: list[str | bytes] = []
        for word in text.encode().split():
            own = word.decode()
            if _is_own(own):
                keys += self.cut(own.lower())
            else:
                keys.append(word)
        return keys

    def _learn(self, fresh: list[str | bytes]) -> None:
        own = [p for p in fresh if isinstance(p, str)]
        if own:
            ids = self.tokenizer.encode_batch_fast([" ".join(own)], add_special_tokens=False)[0].ids
            ids = np.array(ids, self.dtype)
            cuts = ((np.flatnonzero(self.ends[ids]) + 1) * self.dtype.itemsize).tolist()
            if len(cuts) != len(own):
                raise ValueError("the vocabulary doesn't end every piece with a word-end id")
            flat = ids.tobytes()
            self.young.update(zip(own, map(flat.__getitem__, map(slice, [0, *cuts[:-1]], cuts)), strict=True))
        self.young.update((w, self._whole(w.decode())) for w in fresh if isinstance(w, bytes))

    def encode_all(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text in the file's byte form, without an end id."""
        if self.cut is None:
            return [self._whole(t.decode()) for t in texts]
        if len(self.young) > CACHED_PIECES:
            self.young, self.old = {}, self.young
        keys = [self._keys(t.decode()) for t in texts]
        known, old = self.young, self.old
        missing = set().union(*keys).difference(known)
        known.update((p, old[p]) for p in missing if p in old)
        self._learn([p for p in missing if p not in old])
        return [b"".join(map(known.__getitem__, own)) for own in keys]

    def encode(self, text: bytes) -> bytes:
        return self.encode_all([text])[0]


def _split_pattern(spec: dict):
    """The file's pre-tokenisation for ASCII and Latin-1 letters, None if unknown."""
    normal = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
    steps = (spec["pre_tokenizer"] or {}).get("pretokenizers", [])
    if normal != ["NFC", "Replace", "Lowercase"]:
        return None
    if [s["type"] for s in steps] != ["Split", "ByteLevel"] or steps[1]["use_regex"] or steps[1]["add_prefix_space"]:
        return None
    if steps[0]["behavior"] != "Removed" or not steps[0]["invert"]:
        return None
    pattern = steps[0]["pattern"]["Regex"]
    for name, own in ((r"\p{L}", "a-zà-öø-ÿß"), (r"\p{N}", "0-9")):
        pattern = pattern.replace(f"[{name}]", f"[{own}]").replace(name, own)
    return None if r"\p" in pattern else re.compile(pattern).findall


_encoders: dict[str, Pieces] = {}


def encoder_for(path: str) -> Pieces:
    """One encoder for each Python worker, kept between tasks."""
    if path not in _encoders:
        _encoders[path] = Pieces(path)
    return _encoders[path]


def _shard(folder: str, number: int) -> str:
    return f"{folder}/shard-{number:05d}"


def _shard_writer(folder: str, tokenizer: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId()
        encoder = encoder_for(tokenizer)
        end = np.array([END_ID], encoder.dtype).tobytes()
        sizes: list[int] = []
        ids: list[int] = []

        def encoded() -> Iterator[bytes]:
            for batch in batches:
                for start in range(0, batch.num_rows, 256):
                    part = batch.slice(start, 256)
                    ids.extend(NULL_ID if d is None else d for d in part.column(0).to_pylist())
                    for own in encoder.encode_all([t or b"" for t in raw_texts(part.column(1))]):
                        sizes.append(len(own) // encoder.dtype.itemsize + 1)
                        yield own
                        yield end

        put_file(_shard(folder, number) + ".ids", encoded())
        offsets = np.zeros(len(sizes) + 1, "<i8")
        np.cumsum(sizes, out=offsets[1:])
        put_file(_shard(folder, number) + ".off", [offsets.tobytes()])
        put_file(_shard(folder, number) + ".doc", [np.array(ids, "<i8").tobytes()])
        yield pa.RecordBatch.from_pydict(
            {
                "shard": pa.array([number], pa.int64()),
                "n_docs": pa.array([len(sizes)], pa.int64()),
                "n_tokens": pa.array([int(offsets[-1])], pa.int64()),
                "width": pa.array([encoder.dtype.itemsize], pa.int64()),
            }
        )

    return write


def write_token_files(
    docs: DataFrame,
    folder: str,
    tokenizer: str,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
) -> dict:
    """Encode ``docs`` into a token store at ``folder``; return its manifest."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(doc_id).cast("long").alias("d"), F.col(text).cast("string").alias("t"))
    tie: Column = F.xxhash64("t")
    ranged = rows.repartitionByRange(F.col("d").asc_nulls_first(), tie).sortWithinPartitions(
        F.col("d").asc_nulls_first(), tie, "t"
    )
    totals = ranged.mapInArrow(
        _shard_writer(folder, tokenizer), "shard long, n_docs long, n_tokens long, width long"
    ).collect()  # one row for each partition
    kept = sorted(r for r in totals if r.n_docs)
    bases = list(accumulate((r.n_tokens for r in kept), initial=0))
    firsts = list(accumulate((r.n_docs for r in kept), initial=0))
    manifest = {
        "dtype": f"<u{kept[0].width if kept else 2}",
        "end_id": END_ID,
        "n_docs": firsts[-1],
        "n_tokens": bases[-1],
        "shards": [
            {"shard": r.shard, "first_token": b, "first_doc": f, "n_docs": r.n_docs, "n_tokens": r.n_tokens}
            for r, b, f in zip(kept, bases, firsts, strict=False)
        ],
    }
    put_file(f"{folder}/manifest.json", [json.dumps(manifest).encode()])
    return manifest


def _shard_reader(folder: str):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        manifest = json.loads(get_bytes(f"{folder}/manifest.json"))
        for batch in batches:
            for at in batch.column(0).to_pylist():
                shard = manifest["shards"][at]
                name = _shard(folder, shard["shard"])
                ids = mapped(name + ".ids", manifest["dtype"])
                offsets = mapped(name + ".off", "<i8")
                docs = mapped(name + ".doc", "<i8")
                for first in range(0, len(docs), 4096):
                    last = min(first + 4096, len(docs))
                    edges = offsets[first : last + 1]
                    sums = [
                        zlib.crc32(ids[a:b].astype("<u4").tobytes())
                        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)
                    ]
                    own = np.asarray(docs[first:last])
                    yield pa.RecordBatch.from_pydict(
                        {
                            "doc_id": pa.array(own, pa.int64(), mask=own == NULL_ID),
                            "start": pa.array(edges[:-1] + shard["first_token"], pa.int64()),
                            "n_tokens": pa.array(np.diff(edges), pa.int64()),
                            "ids_crc32": pa.array(sums, pa.int64()),
                        }
                    )

    return read


def read_token_digests(spark: SparkSession, folder: str) -> DataFrame:
    """Per document of a store: id, global start, length and checksum of its ids."""
    manifest = json.loads(get_bytes(f"{folder}/manifest.json"))
    n = len(manifest["shards"])
    return spark.range(0, n, 1, max(1, n)).mapInArrow(
        _shard_reader(folder), "doc_id long, start long, n_tokens long, ids_crc32 long"
    )


def document_ids(folder: str, position: int) -> np.ndarray:
    """The token ids of the document at ``position``, through the offsets."""
    manifest = json.loads(get_bytes(f"{folder}/manifest.json"))
    for shard in manifest["shards"]:
        at = position - shard["first_doc"]
        if 0 <= at < shard["n_docs"]:
            name = _shard(folder, shard["shard"])
            a, b = mapped(name + ".off", "<i8")[at : at + 2]
            return np.asarray(mapped(name + ".ids", manifest["dtype"])[a:b])
    raise IndexError(position)


def token_id_output(docs: DataFrame, tokenizer: str, folder: str | None = None) -> DataFrame:
    """Write ``docs`` as a token store and return what its files hold."""
    spark = docs.sparkSession
    folder = folder or work_folder(spark, "tokens")
    write_token_files(docs, folder, tokenizer)
    return read_token_digests(spark, folder)
