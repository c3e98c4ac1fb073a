"""MinHash near-dedup with tensored banding.

Instead of fresh minhashes for each of the ``m * m`` tables, two collections of
``m`` half-keys are drawn, ``HALF`` minhashes each; table (i, j) is keyed by
half-key i of the first and j of the second.  That takes ``2 * m * HALF``
minhashes for ``m * m`` tables, about the square root.  ``m`` follows from the
threshold, so that a pair at the threshold shares no table with a chance of at
most ``MISS``.

1. Texts become sets of word shingles; equal sets are one *class*.  All that
   follows works on classes, so exact copies are never compared.
2. In each table bucket the class that shares most buckets with others is the
   hub; every other class of the bucket is a candidate with the hub alone,
   never with all others.  Candidates are confirmed on their full sets, and
   links give components.
3. A bucket whose classes are all in one component needs no more.  In the other
   buckets further hubs are elected from the component with the most classes
   there, by a new order in each round, and only classes of other components
   meet them; links merge components, and up to ``HUB_ROUNDS`` rounds follow.
4. Classes of buckets that are still open go through an exact prefix-filter join:
   rarest shingles first, two sets with similarity t share one of the first
   ``n - ceil(t * n) + 1``, and what follows the first one that they share has
   to hold the rest of their overlap.  Each set carries the parities of its
   shingles in ``SKETCH_BITS`` groups: the parities in which two sets differ are
   never more than the shingles in which they do, so pairs that can't be
   similar end inside the join.  Its pairs across components are
   confirmed likewise.  So a link found by a shared bucket is never lost to the hubs.

Texts travel only for classes with a candidate, once as a member and once as
a hub; shingle sets are rebuilt where they are compared.

Defined results: null, empty and blank texts have empty sets and stay alone; a
text with fewer words than a shingle is one shingle; texts are read whole at
any length; rows that repeat are one class; a null document id names no
component, and a component of null ids alone has the id null; an empty table
gives an empty result; extra columns are never read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest

from .components import connected_components
from .storage import bounded_batches, mapped, put_file, removed, work_folder, written
from .textkernel import MULT, U64, jaccard_counts, mix64, raw_texts, shingle_set

HALF = 2
MISS = 1e-4
ORDER_BITS = 20
ORDER_SAMPLE = 4000
HUB_ROUNDS = 4
HUB_ORDERS = 8
SKETCH_BITS = 256
KEYS_PER_TASK = 500_000
SLICE_ROWS = 64


def table_side(threshold: float, *, half: int = HALF, miss: float = MISS) -> int:
    """Half-keys of each collection that keep the chance of a miss below ``miss``."""
    m = 1
    while 2 * (1 - threshold**half) ** m > miss:
        m += 1
    return m


def _permutations(count: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240229)
    return (
        rng.integers(1, 2**63, count, dtype=np.uint64) | U64(1),
        rng.integers(1, 2**63, count, dtype=np.uint64),
    )


def half_keys(flat: np.ndarray, starts: np.ndarray, m: int, half: int = HALF) -> np.ndarray:
    """Signed 32-bit half-keys, ``2 * m`` columns, of concatenated sets."""
    factors, masks = _permutations(2 * m * half)
    keys = np.empty((len(starts), 2 * m), np.int32)
    for k in range(2 * m):
        own = np.zeros(len(starts), U64)
        for j in range(k * half, (k + 1) * half):
            mixed = (flat ^ masks[j]) * factors[j]
            mixed ^= mixed >> U64(32)
            own = own * MULT + np.minimum.reduceat(mixed, starts)
        keys[:, k] = (mix64(own) >> U64(32)).astype(np.uint32).view(np.int32)
    return keys


def _signer(shingle: int, m: int):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(first, SLICE_ROWS)
                sets, digests = [], []
                for text in raw_texts(part.column(2)):
                    words = text.lower().split() if text else []
                    own = shingle_set(words, shingle)
                    sets.append(own)
                    digests.append(xxh3_128_digest(own.tobytes()) if len(own) else None)
                sizes = np.array([len(s) for s in sets], np.int64)
                full = np.flatnonzero(sizes)
                keys: list[np.ndarray | None] = [None] * len(sets)
                if len(full):
                    starts = np.concatenate([[0], np.cumsum(sizes[full])[:-1]])
                    found = half_keys(np.concatenate([sets[i] for i in full]), starts, m)
                    for i, own in zip(full, found, strict=True):
                        keys[i] = own
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        part.column(1),
                        pa.array(sizes),
                        pa.array(digests, pa.binary()),
                        pa.array(keys, pa.list_(pa.int32())),
                    ],
                    names=["doc_id", "text_hash", "n_shingles", "digest", "half_keys"],
                )

    return sign


def _linker(shingle: int, percent: int):
    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, hub_set = None, np.zeros(0, U64)
        for batch in batches:
            for first in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(first, SLICE_ROWS)
                linked = []
                hubs = part.column(0).to_pylist()
                for own, hub_text, text in zip(
                    hubs, raw_texts(part.column(2)), raw_texts(part.column(3)), strict=True
                ):
                    if own != hub:
                        hub, hub_set = own, shingle_set(hub_text.lower().split(), shingle)
                    other = shingle_set(text.lower().split(), shingle)
                    common = jaccard_counts(hub_set, other)
                    linked.append(100 * common >= percent * (len(hub_set) + len(other) - common))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1)], names=["src", "dst"]).filter(
                    pa.array(linked, pa.bool_())
                )

    return link


def _sizes_fit(a: Column, b: Column, percent: int) -> Column:
    return (F.least(a, b) * 100) >= (F.greatest(a, b) * percent)


def confirmed(pairs: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Those (src, dst) of ``pairs`` whose full sets are similar enough."""
    member = texts.select(F.col("node").alias("dst"), F.col("text").alias("dst_text"))
    hub = texts.select(F.col("node").alias("src"), F.col("text").alias("src_text"))
    rows = pairs.select("src", "dst").join(member, "dst").join(hub, "src")
    return rows.select("src", "dst", "src_text", "dst_text").mapInArrow(
        _linker(shingle, percent), "src long, dst long"
    )


def _rarity_order(nodes: DataFrame, shingle: int, uri: str) -> None:
    """A frequency for each slot of shingles, from a bounded sample of texts.

    It only sets the order in which prefixes are taken, the same for all texts,
    so any sample gives exact results; the sample keeps hot shingles last.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = np.zeros(1 << ORDER_BITS, np.int64)
        for batch in batches:
            for text in raw_texts(batch.column(0)):
                slots += np.bincount(
                    (shingle_set(text.lower().split(), shingle) >> U64(64 - ORDER_BITS)).astype(np.int64),
                    minlength=len(slots),
                )
        yield pa.RecordBatch.from_pydict({"slots": pa.array([slots.astype("<i4").tobytes()], pa.binary())})

    sample = nodes.orderBy(F.xxhash64("node")).limit(ORDER_SAMPLE).select("text").coalesce(1)
    total = np.zeros(1 << ORDER_BITS, "<i4")
    for row in sample.mapInArrow(count, "slots binary").collect():  # one fixed-size row
        total += np.frombuffer(row.slots, "<i4")
    put_file(uri, [total.tobytes()])


def parity_sketch(own: np.ndarray) -> np.ndarray:
    """Parities of the set's shingles in ``SKETCH_BITS`` groups, as signed 64-bit words."""
    group = (own & U64(SKETCH_BITS - 1)).astype(np.int64)
    odd = np.bincount(group, minlength=SKETCH_BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view("<i8")


_SKETCH = [f"s{i}" for i in range(SKETCH_BITS // 64)]


def _prefixer(shingle: int, percent: int, uri: str):
    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = mapped(uri, "<i4")
        for batch in batches:
            for first in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(first, SLICE_ROWS)
                chosen, sketches = [], []
                for text in raw_texts(part.column(3)):
                    own = shingle_set(text.lower().split(), shingle)
                    sketches.append(parity_sketch(own))
                    rare = np.asarray(order[(own >> U64(64 - ORDER_BITS)).astype(np.int64)])
                    size = len(own) - ceil(len(own) * percent / 100) + 1
                    chosen.append(own[np.lexsort((own, rare))[:size]].view(np.int64))
                sizes = [len(c) for c in chosen]
                owner = pa.array(np.repeat(np.arange(len(chosen)), sizes))
                place = np.concatenate([np.arange(size) for size in sizes])
                sketch = np.repeat(np.stack(sketches), sizes, axis=0)
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(i).take(owner) for i in range(3)), pa.array(np.concatenate(chosen)), pa.array(place),
                     *(pa.array(np.ascontiguousarray(sketch[:, i])) for i in range(len(_SKETCH)))],
                    names=["node", "n", "comp", "shingle", "place", *_SKETCH],
                )

    return prefixes


def _next_round(at: DataFrame, tried: DataFrame, number: int, percent: int) -> DataFrame:
    """Untried (src, dst) of a new hub in each bucket and the other components' classes."""
    order = F.xxhash64("node", F.lit(number), F.pmod("key", F.lit(HUB_ORDERS)))
    best = at.groupBy("key", "comp").agg(
        F.count(F.lit(1)).alias("c"), F.max(F.struct(order.alias("order"), "node", "n")).alias("top")
    )
    hubs = best.groupBy("key").agg(F.max(F.struct("c", "top", "comp")).alias("hub"))
    pairs = (
        at.join(hubs, "key")
        .where((F.col("comp") != F.col("hub.comp")) & _sizes_fit(F.col("n"), F.col("hub.top.n"), percent))
        .select(F.col("hub.top.node").alias("src"), F.col("node").alias("dst"))
        .distinct()
    )
    met = tried.union(tried.select("dst", "src"))
    return pairs.join(met, ["src", "dst"], "left_anti")


def _still_open(at: DataFrame) -> DataFrame:
    """The rows of those buckets whose classes are in several components."""
    keys = at.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("key")
    return at.join(keys, "key", "left_semi")


def _relabelled(rows: DataFrame, merged: DataFrame) -> DataFrame:
    """``rows`` with ``comp`` replaced where ``merged`` has another label for it."""
    step = merged.select(F.col("node").alias("comp"), F.col("label").alias("_into"))
    return rows.join(step, "comp", "left").withColumn("comp", F.coalesce("_into", "comp")).drop("_into")


def _merged(links: DataFrame, comps: DataFrame) -> DataFrame:
    """(node, label) of the components that ``links`` join."""
    ends = [comps.select(F.col("node").alias(c), F.col("comp").alias(f"{c}_comp")).distinct() for c in ("src", "dst")]
    named = links.join(ends[0], "src").join(ends[1], "dst")
    return connected_components(named.select(F.col("src_comp").alias("src"), F.col("dst_comp").alias("dst")))


def _exact_pairs(rest: DataFrame, shingle: int, percent: int, folder: str) -> DataFrame:
    """(src, dst) across components that may be similar, by prefixes and sketches."""
    _rarity_order(rest, shingle, f"{folder}/rarity")
    sketch = ", ".join(f"{c} long" for c in _SKETCH)
    prefixes = written(
        rest.mapInArrow(
            _prefixer(shingle, percent, f"{folder}/rarity"),
            f"node long, n long, comp long, shingle long, place long, {sketch}",
        ),
        f"{folder}/prefixes",
    )
    other = prefixes.select("shingle", *[F.col(c).alias(f"{c}_2") for c in prefixes.columns if c != "shingle"])
    # At the first shingle that two sets share, nothing before it is common.
    rest_fits = F.least(F.col("n") - F.col("place"), F.col("n_2") - F.col("place_2"))
    both = F.col("n") + F.col("n_2")
    differ = sum((F.bit_count(F.col(c).bitwiseXOR(F.col(f"{c}_2"))) for c in _SKETCH), F.lit(0))
    return (
        prefixes.join(other, "shingle")
        .where((F.col("node") < F.col("node_2")) & (F.col("comp") != F.col("comp_2"))
               & _sizes_fit(F.col("n"), F.col("n_2"), percent) & (rest_fits * (100 + percent) >= both * percent)
               & (differ * (100 + percent) <= both * (100 - percent)))
        .select(F.col("node").alias("src"), F.col("node_2").alias("dst"))
        .distinct()
    )


def near_duplicates(
    docs: DataFrame, *, shingle: int = 3, percent: int = 85, half: int = HALF, miss: float = MISS
) -> DataFrame:
    """Per row of ``docs``: doc_id, text_hash, n_shingles, digest, label, component_id.

    ``percent`` is the similarity in hundredths at which texts are linked;
    ``label`` numbers the components (null for empty sets).
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    folder = work_folder(spark, "near")
    m = table_side(percent / 100, half=half, miss=miss)
    base = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.col("text").cast("string").alias("text"))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    signed = written(
        base.mapInArrow(
            _signer(shingle, m),
            f"doc_id {id_type}, text_hash long, n_shingles long, digest binary, half_keys array<int>",
        ),
        f"{folder}/signed",
    )
    classes = written(
        signed.where("n_shingles > 0")
        .groupBy("digest", F.col("n_shingles").alias("n"))
        .agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("rep"),
             F.first("half_keys").alias("half_keys"))
        .withColumn("node", F.monotonically_increasing_id()),
        f"{folder}/classes",
    )
    keys = F.expr(
        f"flatten(transform(slice(half_keys, 1, {m}), (a, i) -> "
        f"transform(slice(half_keys, {m + 1}, {m}), (b, j) -> xxhash64(a, b, i * {m} + j))))"
    )
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-classes.count() * m * m // KEYS_PER_TASK))
    keyed = classes.select("node", "n", "half_keys").repartition(tasks, "node").select("node", "n", F.explode(keys).alias("key"))
    shared = written(
        keyed.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1"), f"{folder}/shared"
    )
    dense = written(keyed.join(shared, "key"), f"{folder}/dense")
    popular = dense.groupBy("node").agg(F.sum("c").alias("pop"))
    hubs = written(
        dense.join(popular, "node").groupBy("key").agg(F.max(F.struct("pop", "node", "n")).alias("hub")),
        f"{folder}/hubs",
    )
    stars = written(
        dense.join(hubs, "key")
        .where((F.col("node") != F.col("hub.node")) & _sizes_fit(F.col("n"), F.col("hub.n"), percent))
        .select(F.col("hub.node").alias("src"), F.col("node").alias("dst"))
        .distinct(),
        f"{folder}/stars",
    )
    nodes = dense.select("node").distinct()
    wanted = classes.join(nodes, "node").select(
        "node", "n", F.col("rep.doc_id").alias("_doc"), F.col("rep.text_hash").alias("_hash")
    )
    texts = written(
        base.join(wanted, base.doc_id.eqNullSafe(F.col("_doc")) & (base.text_hash == F.col("_hash")))
        .dropDuplicates(["node"])
        .select("node", "n", "text"),
        f"{folder}/texts",
    )
    links = written(confirmed(stars, texts, shingle, percent), f"{folder}/links-0")
    steps = [connected_components(links)]
    at = _relabelled(dense.select("key", "node", "n", F.col("node").alias("comp")), steps[0])
    at = written(_still_open(at), f"{folder}/open-0")
    tried = stars
    for number in range(1, HUB_ROUNDS + 1):
        pairs = written(_next_round(at, tried, number, percent), f"{folder}/pairs-{number}")
        if pairs.isEmpty():
            break
        links = written(confirmed(pairs, texts, shingle, percent), f"{folder}/links-{number}")
        tried = tried.union(pairs)
        if not links.isEmpty():
            steps.append(_merged(links, at))
            at = written(_still_open(_relabelled(at, steps[-1])), f"{folder}/open-{number}")
    open_nodes = at.select("node", "comp").distinct()
    rest = written(texts.join(open_nodes, "node").select("node", "n", "comp", "text"), f"{folder}/rest")
    if not rest.isEmpty():
        pairs = _exact_pairs(rest, shingle, percent, folder)
        links = written(confirmed(pairs, rest, shingle, percent), f"{folder}/links-rest")
        if not links.isEmpty():
            steps.append(_merged(links, rest))
    whole = classes.select("digest", "rep.doc_id", F.col("node").alias("comp"))
    for step in steps:
        whole = _relabelled(whole, step)
    whole = written(whole.withColumnRenamed("comp", "label"), f"{folder}/labelled")
    smallest = whole.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    named = written(whole.join(smallest, "label").select("digest", "label", "component_id"), f"{folder}/named")
    used = ["classes", "shared", "dense", "hubs", "stars", "texts", "rest", "prefixes", "links-rest", "labelled"]
    used += [f"{kind}-{i}" for kind in ("links", "open", "pairs") for i in range(HUB_ROUNDS + 1)]
    removed(spark, *(f"{folder}/{name}" for name in used))
    joined = signed.drop("half_keys").join(named, "digest", "left")
    alone = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return joined.select("doc_id", "text_hash", "n_shingles", "digest", "label", alone.alias("component_id"))


def near_duplicate_report(docs: DataFrame, **options) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id and kept."""
    return near_duplicates(docs, **options).select(
        "doc_id",
        "n_shingles",
        "component_id",
        F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"),
    )


def representatives(docs: DataFrame, *, shingle: int = 5, percent: int = 80, **options) -> DataFrame:
    """One row of ``docs`` for each near-duplicate group, columns unchanged.

    The row with the smallest document id stays, null ids last; of those that
    share the id, the one whose text has the smallest hash; of identical ones,
    any one.  Rows without words stay, each by itself.
    """
    marked = near_duplicates(docs, shingle=shingle, percent=percent, **options)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("rep")
    kept = marked.where("label is not null").groupBy("label").agg(first).select(
        F.col("rep.doc_id").alias("_doc"), F.col("rep.text_hash").alias("_hash")
    )
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col("doc_id").alias("_id"),
        F.xxhash64("text").alias("_own"),
        F.coalesce(F.col("text").cast("string").rlike(r"[^\x20\x09-\x0D]"), F.lit(False)).alias("_worded"),
    )
    same = F.col("_id").eqNullSafe(F.col("_doc")) & (F.col("_own") == F.col("_hash"))
    found = rows.join(kept, same, "left").where(~F.col("_worded") | F.col("_hash").isNotNull())
    repeated = marked.where("label is not null").groupBy("doc_id", "text_hash").count().where("count > 1")
    if not repeated.isEmpty():
        found = found.where("not _worded").unionByName(found.where("_worded").dropDuplicates(["_id", "_own"]))
    return found.select("_row.*")
