"""The audit against plain sets, on odd rows and at several block sizes."""

from itertools import permutations

import duckdb
import pytest

from tidewire.llm import filter_audit as audit
from tidewire.llm.queries import oracle_sql, queries

DOCS = [
    (1, "a b", "en"), (2, None, "en"), (3, "", None), (4, "a b", "de"), (5, "A B", ""), (6, "x " * 120, "en"), (7, "x " * 120, "fr"),
    (8, " ".join(f"w{i}" for i in range(150)), "en"), (9, " ".join(f"W{i}|" for i in range(150)), "de"), (None, "a b", "en"),
    (None, "a b", "de"), (10, "ÄÖ é\x0bz", None), (10, "ÄÖ é\x0bz", None), (11, " ".join(f"w{i}" for i in range(150)), "en"),
    (12, " ".join(f"w{i % 80}" for i in range(100)), "fr"), (13, "ABCDEFGHIJ" * 9000, "en"),
]
LABELS = [(1, 1, 0), (1, 0, 1), (4, None, 1), (8, 1, None), (11, 1, 0), (13, 0, 1), (None, 1, 1), (99, 1, 1)]


def plain(docs, labels):
    rows = []
    for doc, text, lang in docs:
        t = text or ""
        words = [w for w in t.replace("\x0b", " ").split(" ") if w]
        fails = "".join(f for f, on in zip("ABCDE", [
            len(words) < 100, 100 * len(set(words)) < 80 * len(words), 100 * sum("A" <= c <= "Z" for c in t) > 10 * len(t),
            any(c in "#$%&*|" for c in t), doc is not None and any(d is not None and d < doc and (o or "") == t for d, o, _ in docs)], strict=True) if on)
        own = [x for x in labels if doc is not None and x[0] == doc]
        rows.append((lang or "", set(fails), any(x[1] == 1 for x in own), any(x[2] == 1 for x in own)))
    out, shapley = [], {}
    for part in {r[0] for r in rows}:
        for order in permutations("ABCDE"):
            left = [r for r in rows if r[0] == part]
            for step, f in enumerate(order, 1):
                gone, failing = [r for r in left if f in r[1]], [r for r in rows if r[0] == part and f in r[1]]
                left = [r for r in left if f not in r[1]]
                shapley[part, f] = shapley.get((part, f), 0) + len(gone)
                out.append((part, "".join(order), step, len(left), len(gone), len(failing) - len(gone), sum(r[1] == {f} for r in failing),
                            sum(r[2] for r in gone), sum(r[3] for r in gone)))
    return sorted((*r, shapley[r[0], r[1][r[2] - 1]]) for r in out)


def test_audit_equals_plain_sets(spark):
    docs = spark.createDataFrame([(*d, 1, b"x") for d in DOCS], "doc_id long, text string, lang string, A int, members binary")
    labels = spark.createDataFrame([(*x, "b") for x in LABELS], "doc_id long, quality int, toxic int, part string")
    found = sorted(tuple(r) for r in audit.filter_interactions(docs.repartition(3), labels).collect())
    assert found == plain(DOCS, LABELS)
    assert len(found) == 600 * 4


@pytest.mark.parametrize("block", [1, 3, 64, 1 << 16])
def test_blocks_do_not_matter(spark, block):
    rows = spark.createDataFrame([(f"p{i % 3}", i % 2 == 0, i % 5 == 0, i % 7 == 0) for i in range(200)] + [(None, None, True, None)], "p string, f boolean, g boolean, l boolean")
    index = audit.bitmap_index(rows, ["f", "g"], ["l"], part="p", block=block)
    found = {(r.part, r.subset): (r.kept, r.l) for r in audit.subset_counts(index, ["f", "g"], ["l"]).collect()}
    for k in range(3):
        own = [i for i in range(200) if i % 3 == k]
        for subset in range(4):
            kept = [i for i in own if not (subset & 1 and i % 2 == 0) and not (subset & 2 and i % 5 == 0)]
            assert found[f"p{k}", subset] == (len(kept), sum(i % 7 == 0 for i in kept))
    assert found["", 0] == (1, 0) and found["", 2] == (0, 0)
    assert all(len(r.members) % 8 == 0 for r in index.collect())


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit.filter_interactions(docs, labels).collect() == []
    one = spark.createDataFrame([(1, None, None)], "doc_id long, text string, lang string")
    rows = audit.filter_interactions(one, labels).collect()
    assert len(rows) == 600 and {r.part for r in rows} == {""} and sum(r.removed for r in rows if r.step == 1) == 24


def test_too_many_filters_are_refused(spark):
    names = [f"f{i}" for i in range(audit.MOST_FILTERS + 1)]
    with pytest.raises(ValueError):
        audit.audit(spark.createDataFrame([], "part string, subset int, kept long"), names, [])


def test_query_agrees_with_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for name in ("documents", "labels"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf}/{name}.parquet')")
    expected = con.execute(oracle_sql()["op12_filter_audit"])
    df = queries()["op12_filter_audit"](spark, sf)
    assert df.columns == [d[0] for d in expected.description]
    assert sorted(map(tuple, df.collect())) == sorted(expected.fetchall())
