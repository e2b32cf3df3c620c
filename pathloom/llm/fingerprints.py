"""Bottom-k fingerprints of texts: the ``k`` smallest hashes of a text's distinct word shingles.

Fingerprints of parts merge into that of the whole, and two of them estimate resemblance and containment; one estimates the number of
distinct shingles. As text a fingerprint is the base64 of its hashes, little-endian, smallest first.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pathloom.llm.joins import bytes_of, left_join, partitions_for
from pathloom.llm.text import plain, releasing, shingle_sets
from pathloom.scale import cut_lineage

K = 128
BUCKETS_PER_PARTITION = 4


def sketch(shingles: np.ndarray, k: int = K) -> np.ndarray:
    """Of sorted distinct hashes."""
    return shingles[:k]


def merge(sketches: Iterable[np.ndarray], k: int = K) -> np.ndarray:
    """The fingerprint of all parts together."""
    return np.unique(np.concatenate([np.empty(0, np.uint64), *sketches]))[:k]


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated shared part of all shingles of both; exact for texts with up to ``k`` together. Two texts without shingles are alike."""
    if not len(a) and not len(b):
        return 1.0
    both = np.union1d(a, b)[:k]
    return float(np.isin(both, np.intersect1d(a, b, assume_unique=True), assume_unique=True).mean())


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated part of the shingles of ``a`` that ``b`` has; 1 for an ``a`` without shingles."""
    if not len(a):
        return 1.0
    # Below the largest hash that a full sketch holds, it holds every shingle.
    limit = b[-1] if len(b) == k else np.uint64(2**64 - 1)
    seen = a[a <= limit]
    return float(np.isin(seen, b, assume_unique=True).mean()) if len(seen) else 0.0


def distinct_shingles(a: np.ndarray, k: int = K) -> float:
    """Estimated number of distinct shingles; exact below ``k``."""
    return float(len(a)) if len(a) < k else (k - 1) / ((float(a[-1]) + 1) / 2.0**64)


def to_text(a: np.ndarray) -> str:
    return base64.b64encode(a.astype("<u8").tobytes()).decode()


def from_text(text: str | None) -> np.ndarray:
    return np.frombuffer(base64.b64decode(text or ""), "<u8")


def fingerprint(text: Column, k: int = K) -> Column:
    """The fingerprint of a text; a null text has that of an empty one."""

    @F.arrow_udf("string")
    def work(column: pa.Array) -> pa.Array:
        return pa.array([to_text(sketch(s, k)) for s in shingle_sets(plain(column))], pa.string())

    return work(text)


def merge_fingerprints(parts: DataFrame, key: str, value: str = "fingerprint", k: int = K) -> DataFrame:
    """One fingerprint per value of ``key``. Tasks merge what they hold before the shuffle, so a key with very many parts is small by then."""
    schema = parts.select(key, F.col(value).cast("string").alias(value)).schema

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}

        def flush() -> pa.RecordBatch:
            columns = [pa.array(list(held), batch.schema.field(0).type), pa.array([to_text(a) for a in held.values()], pa.string())]
            held.clear()
            return pa.RecordBatch.from_arrays(columns, names=[key, value])

        batch = None
        for batch in batches:
            found: dict = {}
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found.setdefault(name, []).append(from_text(text))
            for name, sketches in found.items():
                held[name] = merge([*sketches, *([held[name]] if name in held else [])], k)
            if len(held) > 20_000:
                yield flush()
        if batch is not None:
            yield flush()

    combined = parts.select(key, F.col(value).cast("string").alias(value)).mapInArrow(work, schema)
    return combined.repartition(key).sortWithinPartitions(key).mapInArrow(_merged_runs(key, value, k), schema)


def _merged_runs(key: str, value: str, k: int):
    """Merges the neighbouring rows of a key."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, held, kind = None, None, None

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([name], kind), pa.array([to_text(held)], pa.string())], names=[key, value])

        for batch in batches:
            kind = batch.schema.field(0).type
            for now, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if held is not None and now == name:
                    held = merge([held, from_text(text)], k)
                    continue
                if held is not None:
                    yield row()
                name, held = now, merge([from_text(text)], k)
        if held is not None:
            yield row()

    return work


def _with_next(docs: DataFrame) -> DataFrame:
    """``bucket, lead, doc_id, text`` dealt so that every document stands before the next one by descending id.

    Buckets are ranges of ids. Each also gets the first document of the bucket behind it (``lead``), the last one that of the first bucket. Text
    is moved once, and only one document per bucket twice.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    partitions = partitions_for(docs.sparkSession, bytes_of(rows, "text"))
    buckets = BUCKETS_PER_PARTITION * partitions
    place = F.coalesce(F.col("doc_id").cast("double"), F.lit(float("-inf")))  # a null id comes last
    # As many numbers as the shuffle has partitions times four, which is bounded in bytes.
    cuts = rows.filter("doc_id is not null").select(place.alias("place")).approxQuantile(
        "place", [i / buckets for i in range(1, buckets)], 0.25 / buckets)
    splits = [float("-inf"), *sorted(set(cuts)), float("inf")]
    if len(splits) > 2:
        dealt = Bucketizer(splits=splits, inputCol="place", outputCol="bucket").transform(rows.withColumn("place", place))
    else:
        dealt = rows.withColumns({"place": place, "bucket": F.lit(0.0)})
    dealt = dealt.withColumn("bucket", F.col("bucket").cast("long"))
    # One row per bucket, which stays with the executors.
    firsts = cut_lineage(dealt.groupBy("bucket").agg(F.max("place").alias("place")))
    last = firsts.agg(F.min("bucket")).scalar()
    before = F.lag("bucket").over(Window.orderBy(F.desc("bucket")))
    leads = firsts.select("place", F.coalesce(before, last).alias("before"))
    own = F.struct(F.col("bucket").alias("bucket"), F.lit(False).alias("lead"))
    lead = F.struct(F.col("before").alias("bucket"), F.lit(True).alias("lead"))
    joined = left_join(dealt, leads, "place")
    spread = joined.select("doc_id", "text", F.explode(F.when(F.col("before").isNull(), F.array(own)).otherwise(F.array(own, lead))).alias("to"))
    return (
        spread.select("to.bucket", "to.lead", "doc_id", "text")
        .repartition(partitions, "bucket")
        .sortWithinPartitions("bucket", "lead", F.col("doc_id").desc_nulls_last(), "text")
    )


_EDITS = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, "
          "near_next double")


def fingerprint_edits(docs: DataFrame, k: int = K) -> DataFrame:
    """Fingerprints of the texts of ``docs (doc_id, text)`` and of their edited forms; other columns are ignored.

    The edited text has its last third (``floor(n_chars / 3)`` code points) replaced by as many first code points of the
    next document, or all it has, by descending id; behind the last document comes the first. A null text is empty. Rows that repeat an id follow
    each other by text; rows with a null id come last. One row per row of ``docs``: ``doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited`` (resemblance of both) and ``near_next`` (to the next document). An empty table gives an empty one.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: tuple | None = None  # the last row of the batch before, which waits for its next: (bucket, lead, id, text, sketch)
        for batch in batches:
            for start in range(0, len(batch), 1024):
                part = batch.slice(start, 1024)
                texts = part.column(3)
                sketches = [sketch(s, k).copy() for s in shingle_sets(texts)]
                rows = list(zip(*(part.column(i).to_pylist() for i in range(4)), sketches))
                if kept is not None:
                    rows.insert(0, kept)
                kept = rows[-1]
                pairs = [(a, b) for a, b in zip(rows, rows[1:]) if a[0] == b[0] and not a[1]]
                edited = []
                for a, b in pairs:
                    third = len(a[3]) // 3
                    edited.append(a[3][:len(a[3]) - third] + b[3][:third])
                edited_sketches = [sketch(s, k) for s in shingle_sets(pa.array(edited, pa.string()))]
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.array([a[2] for a, _ in pairs], pa.int64()),
                    "n_chars": pa.array([len(a[3]) for a, _ in pairs], pa.int64()),
                    "edited_sha256": pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited], pa.string()),
                    "fingerprint": pa.array([to_text(a[4]) for a, _ in pairs], pa.string()),
                    "edited_fingerprint": pa.array([to_text(e) for e in edited_sketches], pa.string()),
                    "near_edited": pa.array([resemblance(a[4], e, k) for (a, _), e in zip(pairs, edited_sketches)], pa.float64()),
                    "near_next": pa.array([resemblance(a[4], b[4], k) for a, b in pairs], pa.float64()),
                })

    return _with_next(docs).mapInArrow(releasing(work), _EDITS)
