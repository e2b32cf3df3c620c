import hashlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pathloom.llm import fingerprints as fp, joins
from pathloom.llm.text import shingle_sets

from .conftest import DOC_SCHEMA, rows_of, words
from .test_text import shingles


def sets_of(*texts):
    return list(shingle_sets(pa.array(texts, pa.string())))


def jaccard(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def test_estimates():
    common, left, right = words(3000, 1, 10**6), words(1000, 2, 10**6), words(2000, 3, 10**6)
    a, b = sets_of(f"{common} {left}", f"{right} {common}")
    x, y = fp.sketch(a), fp.sketch(b)
    assert fp.resemblance(x, y) == pytest.approx(len(np.intersect1d(a, b)) / len(np.union1d(a, b)), abs=0.12)
    assert fp.containment(x, y) == pytest.approx(0.75, abs=0.15)
    assert fp.distinct_shingles(x) == pytest.approx(len(a), rel=0.25)
    assert fp.from_text(fp.to_text(x)).tolist() == x.tolist()
    whole = fp.sketch(np.union1d(a, b))
    assert fp.merge([x, y]).tolist() == whole.tolist()


def test_small_sets_are_exact():
    a, b = (fp.sketch(s) for s in sets_of("a b c d e f g", "b c d e f g h"))
    assert fp.resemblance(a, b) == 0.5 and fp.distinct_shingles(a) == 3 and fp.containment(a, b) == pytest.approx(2 / 3)
    empty = np.empty(0, np.uint64)
    assert fp.resemblance(empty, empty) == 1 and fp.resemblance(a, empty) == 0 and fp.containment(empty, a) == 1


def expected(rows):
    order = sorted(rows, key=lambda r: (-(r[0] if r[0] is not None else -1e18), r[1] or ""))
    out = []
    for i, (doc_id, text) in enumerate(order):
        text, behind = text or "", order[(i + 1) % len(order)][1] or ""
        third = len(text) // 3
        edited = text[:len(text) - third] + behind[:third]
        out.append((doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), jaccard(text, edited), jaccard(text, behind)))
    return out


@pytest.mark.parametrize("partitions", [1, 5])
def test_edited_texts(spark, odd_docs, odd_rows, partitions):
    found = fp.fingerprint_edits(odd_docs.repartition(partitions)).collect()
    want = expected([r[:2] for r in odd_rows])
    assert sorted((r.doc_id, r.n_chars, r.edited_sha256) for r in found if r.doc_id is not None) == sorted(w[:3] for w in want if w[0] is not None)
    assert sum(r.doc_id is None for r in found) == 2
    by_hash = {(w[0], w[2]): w for w in want}
    for row in found:
        if row.doc_id is not None:
            assert row.near_edited == pytest.approx(by_hash[row.doc_id, row.edited_sha256][3], abs=0.15)
            assert row.near_next == pytest.approx(by_hash[row.doc_id, row.edited_sha256][4], abs=0.15)
    same = [r.fingerprint for r in found if r.doc_id in (1, 3)]
    assert len(set(same)) == 1 and len({r.fingerprint for r in found if r.doc_id in (4, 5, 6)}) == 1


def test_many_rows(spark):
    rows = [(i * i, words(3 + i % 60, i)) for i in range(3000)]
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], DOC_SCHEMA)
    found = fp.fingerprint_edits(docs)
    assert rows_of(found, "doc_id", "n_chars", "edited_sha256") == sorted((w[:3] for w in expected(rows)), key=repr)


@pytest.mark.parametrize("broadcast_bytes", [0, 1 << 20])
def test_many_ranges_of_ids(spark, monkeypatch, broadcast_bytes):
    monkeypatch.setattr(joins, "PARTITION_BYTES", 2_000)
    monkeypatch.setattr(joins, "BROADCAST_BYTES", broadcast_bytes)
    rows = [(i * i, words(3 + i % 60, i)) for i in range(500)]
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], DOC_SCHEMA)
    dealt = fp._with_next(docs)
    assert dealt.select("bucket").distinct().count() > 100
    assert rows_of(fp.fingerprint_edits(docs), "doc_id", "n_chars", "edited_sha256") == sorted((w[:3] for w in expected(rows)), key=repr)


def test_partitions_grow_with_bytes(spark):
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert joins.partitions_for(spark, 0) == least and joins.partitions_for(spark, 1 << 30) == max(least, 64)
    assert joins.partitions_for(spark, 1 << 40) == 20_000 and joins.partitions_for(spark, 100 << 40) == 204_800


def test_one_row_and_none(spark, no_docs):
    row = fp.fingerprint_edits(spark.createDataFrame([(7, "abcdef", None, None, None)], DOC_SCHEMA)).first()
    assert row.edited_sha256 == hashlib.sha256(b"abcdab").hexdigest() and row.near_next == 1
    assert fp.fingerprint_edits(no_docs).collect() == []


def test_merging_parts(spark):
    texts = [(i % 3, words(200, i)) for i in range(30)] + [(None, "a b c d e f")]
    parts = spark.createDataFrame(texts, "key long, text string").withColumn("fingerprint", fp.fingerprint(F.col("text")))
    found = {r.key: r.fingerprint for r in fp.merge_fingerprints(parts, "key").collect()}
    for key in (0, 1, 2, None):
        union = np.unique(np.concatenate(sets_of(*(t for k, t in texts if k == key))))
        assert found[key] == fp.to_text(union[:fp.K])
