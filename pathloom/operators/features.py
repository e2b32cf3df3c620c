"""One standardized, frequency-weighted vector per URL."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import ElementwiseProduct, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DataType, DoubleType, StructField, StructType

from pathloom.functions.lookup import KnownTerms, known_terms
from pathloom.functions.weights import PositionWeight, PythonWeight, coefficients
from pathloom.scale import BROADCAST_BYTES, HOT_BYTES, HOT_KEYS, broadcast_size, cut_lineage, fits_broadcast, join_skewed

_DOUBLE_BYTES = 8
# Terms whose vectors a task holds at a time: few enough for the processor cache.
_TERMS_AT_ONCE = 1 << 12
# Word vectors are summed in at most so many passes; of more, the rare words are joined.
MAX_PIECES = 8


def weighted_coefficients(ranked: DataFrame, s: float, weight: PositionWeight | PythonWeight | None = None) -> DataFrame:
    """``id, url, split_url, coefficients``: per term the position weight times ``1 / order ** s``."""
    per_term = coefficients(F.col("word_frequency_orders"), s, weight)
    return ranked.select("id", "url", "split_url", per_term.alias("coefficients"))


def pair_terms(weighted: DataFrame) -> DataFrame:
    """``id, url, split_urls_and_coefficients``: the two arrays zipped into structs of ``word, coefficient``."""
    pairs = F.arrays_zip(F.col("split_url").alias("word"), F.col("coefficients").alias("coefficient"))
    return weighted.select("id", "url", pairs.alias("split_urls_and_coefficients"))


def _array_of_sums(size: int, prefix: str = "_sum_") -> Column:
    return F.array(*[F.col(f"{prefix}{i}") for i in range(size)])


def _sums(size: int) -> list[Column]:
    return [F.sum(F.col("vector")[i] * F.col("coefficient")).alias(f"_sum_{i}") for i in range(size)]


def vector_size_of(vectors: DataFrame) -> int:
    """Length of the vectors of a ``word, vector`` table; 0 if it is empty."""
    first = vectors.select(F.size(vector_to_array("vector"))).first()
    return 0 if first is None else first[0]


def join_word_vectors(weighted: DataFrame, vectors: DataFrame, *, hot_keys: int = HOT_KEYS,
                      broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """One row ``id, url, pos, word, coefficient, vector`` (``array<double>``) per term that has a word vector."""
    terms = (
        pair_terms(weighted)
        .select("id", "url", F.posexplode("split_urls_and_coefficients").alias("pos", "_pair"))
        .select("id", "url", "pos", "_pair.word", "_pair.coefficient")
    )
    arrays = vectors.select("word", vector_to_array("vector").alias("vector"))
    joined = join_skewed(terms, arrays, "word", payload=_DOUBLE_BYTES * F.size("vector"), hot_keys=hot_keys,
                         broadcast_bytes=broadcast_bytes)
    return joined.select("id", "url", "pos", "word", "coefficient", "vector")


def scale_word_vectors(terms: DataFrame) -> DataFrame:
    """Multiply each term's vector by its coefficient: ``id, url, pos, word, weighted_word_vector, coefficient``."""
    scaled = F.transform("vector", lambda x: x * F.col("coefficient"))
    return terms.select("id", "url", "pos", "word", scaled.alias("weighted_word_vector"), "coefficient")


def mean_vectors(terms: DataFrame, vector_size: int) -> DataFrame:
    """Weighted mean per URL, sum of ``coefficient * vector`` over sum of ``coefficient``, with both arrays rebuilt in
    position order: ``id, url, split_url, coefficients, vector`` (``array<double>``).

    The sums combine on the map side. The vector is null where the coefficients sum to zero.
    """
    in_order = F.array_sort(F.collect_list(F.struct("pos", "word", "coefficient")))
    total = F.col("_total")
    return (
        terms.groupBy("id", "url")
        .agg(in_order.alias("_terms"), F.sum("coefficient").alias("_total"), *_sums(vector_size))
        .select(
            "id",
            "url",
            F.col("_terms.word").alias("split_url"),
            F.col("_terms.coefficient").alias("coefficients"),
            F.when(total != 0, F.array(*[F.try_divide(f"_sum_{i}", total) for i in range(vector_size)])).alias("vector"),
        )
    )


class SharedVectors:
    """A table of word vectors that every task holds. One broadcast serves any number of feature sets; ``destroy`` it when they are computed."""

    def __init__(self, vectors: DataFrame):
        """:param vectors: ``word, vector`` with ``array<double>``, known to fit."""
        table = vectors.toArrow()
        components = np.array(table["vector"].combine_chunks().flatten())
        self.size = len(components) // max(len(table), 1)
        places = {word: place for place, word in enumerate(table["word"].to_pylist())}
        self._shared = vectors.sparkSession.sparkContext.broadcast((places, components.reshape(len(table), self.size)))

    @property
    def value(self) -> tuple[dict[str, int], np.ndarray]:
        return self._shared.value

    def destroy(self) -> None:
        self._shared.destroy()


def share_vectors(vectors: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> SharedVectors | None:
    """``vectors`` for every task, or None if they are larger than ``broadcast_bytes``."""
    arrays = vectors.select("word", vector_to_array("vector").alias("vector"))
    return SharedVectors(arrays) if fits_broadcast(arrays, "word", _DOUBLE_BYTES * F.size("vector"), broadcast_bytes) else None


def _summed(batch: pa.RecordBatch, places: dict[str, int], vector_of: np.ndarray) -> tuple[KnownTerms, pa.Array, np.ndarray, np.ndarray]:
    """The known terms of a batch, their coefficients, and per URL that has any the sum of coefficients and of weighted
    vectors. Terms with a null coefficient add nothing."""
    known = known_terms(batch["split_url"], places)
    weights = batch["coefficients"].flatten().filter(known.found)
    factor = weights.fill_null(0.0).to_numpy(zero_copy_only=False)
    sums = np.zeros((len(known.rows), vector_of.shape[1]))
    total = np.add.reduceat(factor, known.starts) if len(factor) else np.zeros(0)
    for first in range(0, len(factor), _TERMS_AT_ONCE):
        part = slice(first, first + _TERMS_AT_ONCE)
        rows = known.row_of[part]
        starts = np.flatnonzero(np.diff(rows, prepend=-1))
        weighted_vectors = vector_of[known.word_at[part]]
        weighted_vectors *= factor[part, None]
        # A URL may reach over into the next part.
        sums[rows[0] : rows[-1] + 1] += np.add.reduceat(weighted_vectors, starts)
    return known, weights, total, sums


def _lists(values: np.ndarray, mask: np.ndarray | None = None) -> pa.ListArray:
    edges = np.arange(len(values) + 1, dtype=np.int32) * (values.shape[1] if len(values) else 0)
    return pa.ListArray.from_arrays(edges, values.ravel(), mask=None if mask is None else pa.array(mask))


def _with_fields(rows: DataFrame, *fields: tuple[str, DataType]) -> StructType:
    return StructType([*rows.schema.fields, *(StructField(name, kind) for name, kind in fields)])


def _means_in_tasks(weighted: DataFrame, shared: SharedVectors) -> DataFrame:
    """:func:`mean_vectors` per row for word vectors that every task holds: no term rows, no join and no shuffle.

    Each Arrow batch of URLs looks its terms up in the word list and sums rows of the vector matrix per URL.
    """

    def means(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known, weights, total, sums = _summed(batch, *shared.value)
            with np.errstate(divide="ignore", invalid="ignore"):
                sums /= total[:, None]
            at = pa.array(known.rows)
            terms = known.regroup(batch["split_url"].flatten().filter(known.found))
            yield pa.RecordBatch.from_arrays(
                [batch["id"].take(at), batch["url"].take(at), terms, known.regroup(weights), _lists(sums, total == 0)],
                names=["id", "url", "split_url", "coefficients", "vector"],
            )

    return weighted.mapInArrow(means, _with_fields(weighted, ("vector", ArrayType(DoubleType()))))


def _means_by_pieces(weighted: DataFrame, vectors: DataFrame, pieces: int) -> DataFrame:
    """:func:`mean_vectors` per row for word vectors that fit every task in ``pieces`` pieces, one after the other.

    Each piece is a pass over the URLs that adds to the running sums of their rows; the last one divides. No term is shuffled, and sums are
    stored between passes, so that only one piece is held at a time.
    """
    arrays = vectors.select("word", vector_to_array("vector").alias("vector"))
    size = vector_size_of(vectors)
    doubles = ArrayType(DoubleType())
    running = _with_fields(weighted, ("_found", ArrayType(BooleanType())), ("_total", DoubleType()), ("_sums", doubles))
    rows = weighted
    for piece in range(pieces):
        shared = SharedVectors(arrays.where(F.pmod(F.xxhash64("word"), F.lit(pieces)) == piece))
        last = piece == pieces - 1

        def add(batches: Iterator[pa.RecordBatch], shared=shared, first=piece == 0, last=last) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                known, _, more, more_sums = _summed(batch, *shared.value)
                lists = batch["split_url"]
                edges = np.append(0, np.cumsum(lists.value_lengths().fill_null(0).to_numpy()))
                found = known.found.to_numpy(zero_copy_only=False)
                if first:
                    total, sums = np.zeros(len(batch)), np.zeros((len(batch), size))
                else:
                    found = found | batch["_found"].flatten().to_numpy(zero_copy_only=False)
                    total, sums = batch["_total"].to_numpy().copy(), batch["_sums"].flatten().to_numpy().reshape(len(batch), size).copy()
                if len(known.rows):
                    total[known.rows] += more
                    sums[known.rows] += more_sums
                if last:
                    yield _divided(batch, found, edges, total, sums)
                else:
                    yield pa.RecordBatch.from_arrays(
                        [*[batch[name] for name in ("id", "url", "split_url", "coefficients")], pa.ListArray.from_arrays(edges.astype(np.int32), pa.array(found)),
                         pa.array(total), _lists(sums)], names=running.names)

        rows = rows.mapInArrow(add, _with_fields(weighted, ("vector", doubles)) if last else running)
        if not last:
            rows = cut_lineage(rows)
            shared.destroy()
    return rows


def _divided(batch: pa.RecordBatch, found: np.ndarray, edges: np.ndarray, total: np.ndarray, sums: np.ndarray) -> pa.RecordBatch:
    """The rows with a known term: their known terms and coefficients, and ``sums / total``, null where the total is 0."""
    each = np.add.reduceat(np.append(found, False), edges[:-1]) * (np.diff(edges) > 0) if len(batch) else np.zeros(0, np.int64)
    rows = np.flatnonzero(each)
    with np.errstate(divide="ignore", invalid="ignore"):
        means = sums[rows] / total[rows, None]
    at, keep, starts = pa.array(rows), pa.array(found), np.append(0, np.cumsum(each[rows])).astype(np.int32)
    terms, weights = (pa.ListArray.from_arrays(starts, batch[name].flatten().filter(keep)) for name in ("split_url", "coefficients"))
    return pa.RecordBatch.from_arrays([batch["id"].take(at), batch["url"].take(at), terms, weights, _lists(means, total[rows] == 0)],
                                      names=["id", "url", "split_url", "coefficients", "vector"])


def pieces_for(vectors: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> int:
    """In how many pieces of at most about ``broadcast_bytes`` the vectors come."""
    arrays = vectors.select("word", vector_to_array("vector").alias("vector"))
    return -(-broadcast_size(arrays, "word", _DOUBLE_BYTES * F.size("vector")) // broadcast_bytes) if broadcast_bytes else MAX_PIECES + 1


def _means_beyond(ranked: DataFrame, weighted: DataFrame, vectors: DataFrame, hot_keys: int | None) -> DataFrame:
    """:func:`mean_vectors` per row for word vectors of any size.

    Ranks are frequencies, so the vectors of the first ranks, as many as ``HOT_BYTES`` hold, cover most terms; they are summed
    inside the tasks that read the URLs. Only the other terms meet their vectors by a shuffle, and both sums are added.
    """
    arrays = vectors.select("word", vector_to_array("vector").alias("vector"))
    size, width = vector_size_of(vectors), _DOUBLE_BYTES * F.size("vector")
    hot_keys = HOT_BYTES // (_DOUBLE_BYTES * max(size, 1) + 128) if hot_keys is None else hot_keys
    ranks = ranked.select(F.explode(F.arrays_zip(F.col("split_url").alias("word"), F.col("word_frequency_orders").alias("rank"))).alias("_"))
    words = cut_lineage(ranks.select("_.*").where(F.col("rank") <= hot_keys).select("word").distinct())
    hot = arrays.join(F.broadcast(words) if fits_broadcast(words, "word", limit=HOT_BYTES) else words, "word", "left_semi")
    hot = cut_lineage(hot)
    while not fits_broadcast(hot, "word", width, HOT_BYTES):  # words longer than expected
        hot_keys //= 2
        hot = cut_lineage(hot.limit(hot_keys))
    shared = SharedVectors(hot)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, vector_of = shared.value
        for batch in batches:
            known, _, total, sums = _summed(batch, places, vector_of)
            all_sums, all_total = np.zeros((len(batch), size)), np.zeros(len(batch))
            all_total[known.rows] = total
            all_sums[known.rows] = sums if sums.shape[1] else 0
            lists = batch["split_url"]
            found = pa.ListArray.from_arrays(np.append(0, np.cumsum(lists.value_lengths().fill_null(0).to_numpy())).astype(np.int32), known.found)
            yield pa.RecordBatch.from_arrays([*batch.columns, found, pa.array(all_total), _lists(all_sums)],
                                             names=[*batch.schema.names, "_found", "_total", "_sums"])

    numbered = cut_lineage(weighted).withColumn("_row", F.monotonically_increasing_id())
    doubles = ArrayType(DoubleType())
    schema = _with_fields(numbered, ("_found", ArrayType(BooleanType())), ("_total", DoubleType()), ("_sums", doubles))
    rows = cut_lineage(numbered.mapInArrow(partial, schema))
    shared.destroy()
    entries = F.arrays_zip(F.col("split_url").alias("word"), F.col("coefficients").alias("coefficient"), F.col("_found").alias("found"))
    cold = rows.select("_row", F.posexplode(entries).alias("pos", "_")).where("not _.found").select("_row", "pos", "_.word", "_.coefficient")
    met = cold.join(arrays.join(F.broadcast(hot.select("word")), "word", "left_anti"), "word")
    added = met.groupBy("_row").agg(F.collect_list("pos").alias("_pos"), F.sum("coefficient").alias("_more"), *_sums(size))
    added = added.select("_row", "_pos", "_more", _array_of_sums(size).alias("_added"))
    kept = F.filter(entries, lambda e, i: e["found"] | F.coalesce(F.array_contains("_pos", i), F.lit(False)))
    total = F.col("_total") + F.coalesce("_more", F.lit(0.0))
    sums = F.when(F.col("_added").isNull(), F.col("_sums")).otherwise(
        F.zip_with("_sums", "_added", lambda a, b: a + F.coalesce(b, F.lit(0.0))))
    return cut_lineage(rows.join(added, "_row", "left").select(
        "id", "url", F.transform(kept, lambda e: e["word"]).alias("split_url"),
        F.transform(kept, lambda e: e["coefficient"]).alias("coefficients"),
        F.when(total != 0, F.transform(sums, lambda x: x / total)).alias("vector"),
    ))


def url_means(ranked: DataFrame, vectors: DataFrame | SharedVectors, s: float, weight: PositionWeight | PythonWeight | None = None, *,
              hot_keys: int | None = None, broadcast_bytes: int = BROADCAST_BYTES, pieces: int | None = None) -> DataFrame:
    """Weighted mean vector per row of a ranked table, before standardization.

    Every row gives its own row, also if an ``id, url`` repeats; ``id`` may be of any type and keeps it. A term with a null
    coefficient stays in the arrays but adds nothing. Word vectors within ``broadcast_bytes``, and those that are shared
    already, are applied inside the tasks that read the URLs; larger ones come in pieces of that size, one after the other, up to
    ``MAX_PIECES``. Of still larger ones only the ``hot_keys`` most frequent are summed in tasks, and the others are joined.

    :param pieces: number of pieces, if it is not to follow from the size.
    """
    weighted = weighted_coefficients(ranked, s, weight)
    shared = vectors if isinstance(vectors, SharedVectors) else share_vectors(vectors, broadcast_bytes) if pieces is None else None
    if shared is not None:
        means = _means_in_tasks(weighted, shared)
    else:
        pieces = pieces_for(vectors, broadcast_bytes) if pieces is None else pieces
        means = _means_by_pieces(weighted, vectors, pieces) if pieces <= MAX_PIECES else _means_beyond(ranked, weighted, vectors, hot_keys)
    with_vector = means.where(F.col("vector").isNotNull())
    return with_vector.withColumn("vector", array_to_vector("vector"))


def _deviations(vectors: DataFrame, weight: str) -> np.ndarray:
    """Sample standard deviations of ``vector`` if each row stands for ``weight`` equal rows."""
    rows = F.col(weight).cast("double")
    found = vectors.agg(Summarizer.metrics("variance").summary(F.col("vector"), rows).alias("_spread"), F.sum(rows).alias("_n"),
                        F.sum(rows * rows).alias("_squares")).first()
    if not found["_n"]:
        return np.zeros(0)
    # Spark's weighted variance divides by n - sum(w * w) / n, as for weights that are no counts.
    n = found["_n"]
    return np.sqrt(found["_spread"]["variance"].toArray() * (n - found["_squares"] / n) / max(n - 1, 1.0))


def standardize(urls_and_vectors: DataFrame, weight: str | None = None) -> DataFrame:
    """Divide each dimension of ``vector`` by its sample standard deviation, without centring; a constant dimension
    becomes 0. Other columns stay.

    :param weight: column that tells for how many equal rows each row stands.
    """
    if weight is None:
        scaler = StandardScaler(inputCol="vector", outputCol="_scaled", withMean=False, withStd=True)
        scaled = scaler.fit(urls_and_vectors.select("vector")).transform(urls_and_vectors)
    else:
        deviations = _deviations(urls_and_vectors, weight)
        factors = np.divide(1.0, deviations, out=np.zeros_like(deviations), where=deviations > 0)
        scaled = ElementwiseProduct(scalingVec=Vectors.dense(factors), inputCol="vector", outputCol="_scaled").transform(urls_and_vectors)
    return scaled.select(*[F.col("_scaled").alias(c) if c == "vector" else c for c in urls_and_vectors.columns])


def url_features(ranked: DataFrame, vectors: DataFrame | SharedVectors, s: float,
                 weight: PositionWeight | PythonWeight | None = None, *, hot_keys: int | None = None,
                 broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``id, url, split_url, coefficients, vector``: standardized mean vectors of the URLs.

    A URL has no row if none of its terms has a vector or its coefficients sum to zero. The means are computed once, for
    the deviations, and stored in the checkpoint folder for whoever reads the result.
    """
    means = url_means(ranked, vectors, s, weight, hot_keys=hot_keys, broadcast_bytes=broadcast_bytes)
    return standardize(cut_lineage(means))
