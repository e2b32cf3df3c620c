"""The operators as queries over the given tables, each with its SQL counterpart where SQL can state it.

Arrays are shown as joined text or as one row per element, and doubles with six decimals, so that results compare by
value. ``pages`` serves as the URL table, ``embeddings`` as vectors, ``documents`` and ``labels`` as labelled clusters.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.functions.url import host_terms, path_terms, python_sorter, query_terms
from pathloom.functions.vectors import nearest_centre
from pathloom.functions.weights import PythonWeight, zipf_coefficient
from pathloom.operators import clustering, coordinates, features, many_fits, patterns, scores, terms, timing, vocabulary, word_blocks, word_vectors
from pathloom.plans import jobs
from pathloom.plans.search import grid_trials, random_trials, search_clusters
from pathloom.scale import cut_lineage, shared_dir
from pathloom.sources.tables import Quarantined, UrlStore, quarantine, read_labels, read_urls

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

# Keep more words than the default of 10 where vectors are looked up, so that small tables give long enough URLs.
MIN_COUNT = 2
S = 1.5


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLES[function.__name__] = sql
        return function

    return register


# ---------------------------------------------------------------- tables


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), "url")


def _split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return terms.split_urls(_urls(spark, sf_dir))


def _ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Read several times by the queries that use it, as a stored table is.
    return cut_lineage(vocabulary.rank_terms(_split(spark, sf_dir), MIN_COUNT))


def _embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return vectors.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("embedding"))


def _vector_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as features; the label stands for the URL."""
    return _embeddings(spark, sf_dir).select(
        F.col("vec_id").alias("id"), F.col("label").cast("string").alias("url"), array_to_vector("embedding").alias("vector")
    )


def _borrowed_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word vectors that SQL can know: the n-th word of the vocabulary takes the embedding with ``vec_id`` n."""
    words = vocabulary.vocabulary(_split(spark, sf_dir), MIN_COUNT)
    vectors = _embeddings(spark, sf_dir).withColumnRenamed("vec_id", "word_frequency_order")
    borrowed = words.join(vectors, "word_frequency_order").select("word", array_to_vector("embedding").alias("vector"))
    return cut_lineage(borrowed)


def _clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality and toxicity of a document as its cluster; many documents have none."""
    return _table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("id"), (F.col("quality") * 2 + F.col("toxic")).alias("cluster_id")
    )


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("label"))


def _scratch(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/tables-{uuid.uuid4().hex}"


def _joined(array: Column | str) -> Column:
    return F.array_join(array, "|")


def _six(value: Column | str) -> Column:
    return F.round(value, 6)


def _by_dimension(df: DataFrame, array: str, *keys: str) -> DataFrame:
    exploded = df.select(*keys, F.posexplode(array).alias("d", "value"))
    return exploded.select(*keys, "d", _six("value").alias("value"))


# ---------------------------------------------------------------- SQL building blocks

_SPLIT = r"""
cleaned AS (
  SELECT page_id AS id, url,
         regexp_replace(regexp_replace(url, '[\t\r\n]', '', 'g'), '^[\x00-\x20]+', '') AS u
  FROM pages),
parts AS (
  SELECT id, url, regexp_extract(u,
    '^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?',
    ['scheme', 'netloc', 'path', 'query']) AS p
  FROM cleaned),
lists AS (
  SELECT id, url,
    list_filter(string_split(p.netloc, '.')[1:greatest(len(string_split(p.netloc, '.')) - 2, 0)], lambda x: x <> '') AS host,
    list_filter(string_split_regex(CASE WHEN lower(p.scheme) IN ('', 'ftp', 'hdl', 'prospero', 'http', 'https', 'imap',
        'shttp', 'rtsp', 'rtsps', 'rtspu', 'sip', 'sips', 'mms', 'sftp', 'tel')
      THEN regexp_replace(p.path, ';[^/]*$', '') ELSE p.path END, '[/ +-]'), lambda x: x <> '') AS path,
    list_filter(string_split_regex(p.query, '[&=]'), lambda x: x <> '') AS query
  FROM parts),
split AS (
  SELECT id, url, host || path || CASE WHEN len(query) > 0 THEN ['?'] || query ELSE query END AS split_url
  FROM lists)"""

_TERMS = _SPLIT + """,
terms AS (
  SELECT id, url, unnest(split_url) AS word, CAST(generate_subscripts(split_url, 1) - 1 AS INTEGER) AS pos FROM split),
counts AS (SELECT word, count(*) AS "count" FROM terms GROUP BY word)"""


def _vocabulary_sql(min_count: int) -> str:
    return _TERMS + f""",
vocabulary AS (
  SELECT word, "count", row_number() OVER (ORDER BY "count" DESC, word) AS word_frequency_order
  FROM counts
  WHERE "count" >= {min_count} AND "count" < (SELECT CAST(floor(count(*) * 0.8::DOUBLE) AS BIGINT) FROM pages)),
kept AS (SELECT id, url, pos, word, word_frequency_order FROM terms JOIN vocabulary USING (word))"""


# Positions after pruning, and Zipf coefficients.
_WEIGHTED = _vocabulary_sql(MIN_COUNT) + f""",
weighted AS (
  SELECT id, url, word, word_frequency_order, 1 / pow(word_frequency_order, {S}) AS coefficient,
         CAST(row_number() OVER (PARTITION BY id, url ORDER BY pos) - 1 AS INTEGER) AS pos
  FROM kept)"""

_VECTORS = _WEIGHTED + """,
known AS (
  SELECT w.id, w.url, w.pos, w.word, w.coefficient, e.embedding::DOUBLE[] AS vector
  FROM weighted w JOIN embeddings e ON e.vec_id = w.word_frequency_order),
known_values AS (
  SELECT id, url, pos, word, coefficient, unnest(vector) AS x, CAST(generate_subscripts(vector, 1) - 1 AS INTEGER) AS d
  FROM known),
means AS (
  SELECT id, url, d, sum(x * coefficient) / sum(coefficient) AS value FROM known_values GROUP BY id, url, d)"""

_FEATURES = f"""WITH {_VECTORS}
SELECT id, d, round(coalesce(value / nullif(stddev_samp(value) OVER (PARTITION BY d), 0), 0), 6) + 0.0 AS value
FROM means"""

_EMBEDDING_VALUES = """
v AS (
  SELECT vec_id, label, unnest(embedding::DOUBLE[]) AS x,
         CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS d
  FROM embeddings)"""


# ---------------------------------------------------------------- sources and sinks

_SPLIT_RESULT = f"""WITH {_SPLIT}
SELECT id, url, len(split_url)::INTEGER AS n_terms, array_to_string(split_url, '|') AS terms FROM split"""


def _split_result(split: DataFrame) -> DataFrame:
    return split.select("id", "url", F.size("split_url").alias("n_terms"), _joined("split_url").alias("terms"))


_RANKED_RESULT = f"""WITH {_vocabulary_sql(MIN_COUNT)}
SELECT id, url, string_agg(word, '|' ORDER BY pos) AS terms, string_agg(word_frequency_order, '|' ORDER BY pos) AS orders
FROM kept GROUP BY id, url"""


def _ranked_result(ranked: DataFrame) -> DataFrame:
    orders = F.col("word_frequency_orders").cast("array<string>")
    return ranked.select("id", "url", _joined("split_url").alias("terms"), _joined(orders).alias("orders"))


@query("SELECT page_id AS id, url FROM pages")
def csv_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _scratch(spark)
    _urls(spark, sf_dir).write.csv(path, header=True)
    return read_urls(spark, path)


@query("SELECT doc_id AS id, source AS label FROM documents")
def csv_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _scratch(spark)
    _labels(spark, sf_dir).write.csv(path, header=True)
    return read_labels(spark, path)


@query(_SPLIT_RESULT)
def stored_split_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = UrlStore(_scratch(spark))
    store.write_split_urls(_split(spark, sf_dir))
    return _split_result(store.read_split_urls(spark))


@query(_RANKED_RESULT)
def stored_ranked_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = UrlStore(_scratch(spark))
    store.write_ranked_urls(_ranked(spark, sf_dir))
    return _ranked_result(store.read_ranked_urls(spark))


@query(f"""WITH {_EMBEDDING_VALUES}
SELECT CAST(vec_id AS VARCHAR) AS word, d, round(x, 6) + 0.0 AS value FROM v""")
def stored_word_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = UrlStore(_scratch(spark))
    vectors = _vector_rows(spark, sf_dir).select(F.col("id").cast("string").alias("word"), "vector")
    store.write_word_vectors(vectors.withColumn("word", F.upper("word")), 2)
    store.write_word_vectors(vectors, 3)
    read = store.read_word_vectors(spark, 3).withColumn("array", vector_to_array("vector"))
    return _by_dimension(read, "array", "word")


@query("SELECT vec_id AS id, CAST(label AS VARCHAR) AS url, label AS cluster_id FROM embeddings")
def stored_clustered_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = UrlStore(_scratch(spark))
    clustered = _vector_rows(spark, sf_dir).withColumn("cluster_id", F.col("url").cast("int"))
    store.write_clustered_urls(clustered.withColumn("cluster_id", F.lit(-5)), "kmeans")
    store.write_clustered_urls(clustered.withColumn("cluster_id", F.lit(-6)), "bisecting_kmeans")
    store.write_clustered_urls(clustered, "kmeans")
    return store.read_clustered_urls(spark, "kmeans").select("id", "url", "cluster_id")


# ---------------------------------------------------------------- terms


@query(_SPLIT_RESULT)
def split_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _split_result(_split(spark, sf_dir))


@query(f"""WITH {_SPLIT}
SELECT id, array_to_string(host, '|') AS host, array_to_string(path, '|') AS path,
       array_to_string(CASE WHEN len(query) > 0 THEN ['?'] || query ELSE query END, '|') AS query
FROM lists""")
def url_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.col("url")
    return _urls(spark, sf_dir).select(
        "id", _joined(host_terms(url)).alias("host"), _joined(path_terms(url)).alias("path"),
        _joined(query_terms(url)).alias("query"),
    )


_SORTED = f"""WITH {_SPLIT}
SELECT id, url, len(split_url)::INTEGER AS n_terms, array_to_string(list_sort(split_url), '|') AS terms FROM split"""


@query(_SORTED)
def sorted_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _split_result(terms.split_urls(_urls(spark, sf_dir), F.array_sort))


@query(_SORTED)
def sorted_terms_python(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _split_result(terms.split_urls(_urls(spark, sf_dir), python_sorter(sorted)))


@query(f"WITH {_TERMS} SELECT id, url, pos, word FROM terms")
def explode_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return terms.explode_terms(_split(spark, sf_dir))


# ---------------------------------------------------------------- vocabulary


@query("SELECT CAST(floor(count(*) * 0.8::DOUBLE) AS BIGINT) AS max_count FROM pages")
def max_word_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocabulary.max_word_count(_split(spark, sf_dir))


@query(f'WITH {_TERMS} SELECT word, "count" FROM counts')
def word_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocabulary.word_counts(terms.explode_terms(_split(spark, sf_dir)))


@query(f'WITH {_vocabulary_sql(10)} SELECT word, "count" FROM vocabulary')
def frequency_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    split = _split(spark, sf_dir)
    return vocabulary.frequency_filter(vocabulary.word_counts(terms.explode_terms(split)), split)


@query(f"WITH {_vocabulary_sql(10)} SELECT * FROM vocabulary")
def vocabulary_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocabulary.vocabulary(_split(spark, sf_dir))


@query(f'WITH {_vocabulary_sql(10)} SELECT word, "count" FROM vocabulary ORDER BY "count" DESC, word LIMIT 10')
def top_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocabulary.top_terms(_split(spark, sf_dir), 10)


@query(f"WITH {_vocabulary_sql(MIN_COUNT)} SELECT id, url, pos, word, word_frequency_order FROM kept")
def prune_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    split = _split(spark, sf_dir)
    kept = vocabulary.prune_terms(terms.explode_terms(split), vocabulary.vocabulary(split, MIN_COUNT))
    return kept.select("id", "url", "pos", "word", "word_frequency_order")


@query(f"WITH {_vocabulary_sql(MIN_COUNT)} SELECT id, url, pos, word, word_frequency_order FROM kept")
def prune_terms_shuffled(spark: SparkSession, sf_dir: str) -> DataFrame:
    split = _split(spark, sf_dir)
    words = vocabulary.vocabulary(split, MIN_COUNT, one_task_rows=0)
    kept = vocabulary.prune_terms(terms.explode_terms(split), words, hot_keys=5, broadcast_bytes=0)
    return kept.select("id", "url", "pos", "word", "word_frequency_order")


@query(_RANKED_RESULT)
def ranked_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranked_result(vocabulary.rank_terms(_split(spark, sf_dir), MIN_COUNT))


@query(_RANKED_RESULT)
def ranked_terms_in_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranked_result(vocabulary.rank_terms(_split(spark, sf_dir), MIN_COUNT, unique_ids=True))


@query(_RANKED_RESULT)
def ranked_terms_shuffled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As for a vocabulary that fits no task, with few hot words."""
    split = _split(spark, sf_dir)
    return _ranked_result(vocabulary.rank_terms(split, MIN_COUNT, hot_keys=5, one_task_rows=0, broadcast_bytes=0))


def _ranked_names_sql() -> str:
    return _RANKED_RESULT.replace("SELECT id, url, string_agg", "SELECT 'page ' || id AS id, url, string_agg")


def _named_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _split(spark, sf_dir).withColumn("id", F.concat(F.lit("page "), F.col("id").cast("string")))


@query(_ranked_names_sql())
def ranked_terms_string_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranked_result(vocabulary.rank_terms(_named_pages(spark, sf_dir), MIN_COUNT, unique_ids=True))


@query(_ranked_names_sql())
def ranked_terms_string_ids_shuffled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranked_result(vocabulary.rank_terms(_named_pages(spark, sf_dir), MIN_COUNT, hot_keys=5, broadcast_bytes=0))


@query(f"WITH {_vocabulary_sql(40)} SELECT id, url FROM split WHERE id NOT IN (SELECT id FROM kept)")
def dropped_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    split = _split(spark, sf_dir)
    return vocabulary.dropped_urls(split, vocabulary.rank_terms(split, 40))


# ---------------------------------------------------------------- features


@query(f"""WITH {_vocabulary_sql(10)}
SELECT word, round(1 / pow(word_frequency_order, {S}), 6) + 0.0 AS coefficient FROM vocabulary""")
def zipf_coefficients(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = vocabulary.vocabulary(_split(spark, sf_dir))
    return words.select("word", _six(zipf_coefficient(F.col("word_frequency_order"), S)).alias("coefficient"))


def _coefficient_rows(weighted: DataFrame) -> DataFrame:
    exploded = weighted.select("id", F.posexplode("coefficients").alias("pos", "coefficient"))
    return exploded.select("id", "pos", _six("coefficient").alias("coefficient"))


@query(f"WITH {_WEIGHTED} SELECT id, pos, round(coefficient, 6) + 0.0 AS coefficient FROM weighted")
def weighted_coefficients(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _coefficient_rows(features.weighted_coefficients(_ranked(spark, sf_dir), S))


_POSITION_WEIGHTED = f"""WITH {_WEIGHTED}
SELECT id, pos, round(coefficient / (pos + 1), 6) + 0.0 AS coefficient FROM weighted"""


@query(_POSITION_WEIGHTED)
def position_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _coefficient_rows(features.weighted_coefficients(_ranked(spark, sf_dir), S, lambda position: 1 / (position + 1)))


@query(_POSITION_WEIGHTED)
def position_weights_python(spark: SparkSession, sf_dir: str) -> DataFrame:
    weight = PythonWeight(lambda position: 1 / (position + 1))
    return _coefficient_rows(features.weighted_coefficients(_ranked(spark, sf_dir), S, weight))


@query(f"WITH {_WEIGHTED} SELECT id, url, pos, word, round(coefficient, 6) + 0.0 AS coefficient FROM weighted")
def paired_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = features.pair_terms(features.weighted_coefficients(_ranked(spark, sf_dir), S))
    exploded = pairs.select("id", "url", F.posexplode("split_urls_and_coefficients").alias("pos", "pair"))
    return exploded.select("id", "url", "pos", "pair.word", _six("pair.coefficient").alias("coefficient"))


def _known_terms(spark: SparkSession, sf_dir: str, **bound) -> DataFrame:
    weighted = features.weighted_coefficients(_ranked(spark, sf_dir), S)
    return features.join_word_vectors(weighted, _borrowed_vectors(spark, sf_dir), **bound)


_KNOWN = f"""WITH {_VECTORS}
SELECT id, pos, word, d, round(x, 6) + 0.0 AS value FROM known_values"""


@query(_KNOWN)
def join_word_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _by_dimension(_known_terms(spark, sf_dir), "vector", "id", "pos", "word")


@query(_KNOWN)
def join_word_vectors_shuffled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _by_dimension(_known_terms(spark, sf_dir, hot_keys=5, broadcast_bytes=0), "vector", "id", "pos", "word")


@query(f"WITH {_VECTORS} SELECT id, pos, word, d, round(x * coefficient, 6) + 0.0 AS value FROM known_values")
def scaled_word_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    scaled = features.scale_word_vectors(_known_terms(spark, sf_dir))
    return _by_dimension(scaled, "weighted_word_vector", "id", "pos", "word")


_MEANS = f"WITH {_VECTORS} SELECT id, url, d, round(value, 6) + 0.0 AS value FROM means"


@query(_MEANS)
def mean_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _borrowed_vectors(spark, sf_dir)
    weighted = features.weighted_coefficients(_ranked(spark, sf_dir), S)
    means = features.mean_vectors(features.join_word_vectors(weighted, vectors), features.vector_size_of(vectors))
    return _by_dimension(means, "vector", "id", "url")


@query(_MEANS)
def mean_vectors_in_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = features.url_means(_ranked(spark, sf_dir), _borrowed_vectors(spark, sf_dir), S)
    return _by_dimension(means.withColumn("array", vector_to_array("vector")), "array", "id", "url")


@query(_MEANS)
def mean_vectors_by_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As for word vectors that fit a task in three pieces only."""
    means = features.url_means(_ranked(spark, sf_dir), _borrowed_vectors(spark, sf_dir), S, pieces=3)
    return _by_dimension(means.withColumn("array", vector_to_array("vector")), "array", "id", "url")


@query(_MEANS)
def mean_vectors_beyond(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As for word vectors that fit no task: five words are summed in tasks, all others are joined."""
    means = features.url_means(_ranked(spark, sf_dir), _borrowed_vectors(spark, sf_dir), S, hot_keys=5, broadcast_bytes=0)
    return _by_dimension(means.withColumn("array", vector_to_array("vector")), "array", "id", "url")


@query(f"WITH {_VECTORS} SELECT 'page ' || id AS id, url, d, round(value, 6) + 0.0 AS value FROM means")
def mean_vectors_string_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = _ranked(spark, sf_dir).withColumn("id", F.concat(F.lit("page "), F.col("id").cast("string")))
    means = features.url_means(ranked, _borrowed_vectors(spark, sf_dir), S)
    return _by_dimension(means.withColumn("array", vector_to_array("vector")), "array", "id", "url")


@query(f"""WITH {_VECTORS}
SELECT id, url, string_agg(word, '|' ORDER BY pos) AS terms, round(sum(coefficient), 6) + 0.0 AS total FROM known
GROUP BY id, url""")
def rebuilt_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = features.vector_size_of(_borrowed_vectors(spark, sf_dir))
    rebuilt = features.mean_vectors(_known_terms(spark, sf_dir), size)
    total = F.aggregate("coefficients", F.lit(0.0), lambda a, b: a + b)
    return rebuilt.select("id", "url", _joined("split_url").alias("terms"), _six(total).alias("total"))


@query(f"""WITH {_EMBEDDING_VALUES}
SELECT vec_id AS id, d, round(coalesce(x / nullif(stddev_samp(x) OVER (PARTITION BY d), 0), 0), 6) + 0.0 AS value FROM v""")
def standardize(spark: SparkSession, sf_dir: str) -> DataFrame:
    scaled = features.standardize(_vector_rows(spark, sf_dir))
    return _by_dimension(scaled.withColumn("array", vector_to_array("vector")), "array", "id")


@query(_FEATURES)
def url_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = features.url_features(_ranked(spark, sf_dir), _borrowed_vectors(spark, sf_dir), S)
    return _by_dimension(table.withColumn("array", vector_to_array("vector")), "array", "id")


@query(f"""WITH {_WEIGHTED},
per_url AS (SELECT id, string_agg(word, '|' ORDER BY pos) AS terms FROM weighted GROUP BY id)
SELECT terms, count(*) AS urls FROM per_url GROUP BY terms""")
def term_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return patterns.term_patterns(_ranked(spark, sf_dir)).select(_joined("pattern.split_url").alias("terms"), "urls")


def _with_copies(ranked: DataFrame) -> DataFrame:
    """Every URL four more times, under other ids, so that patterns have many URLs."""
    copies = F.explode(F.sequence(F.lit(0), F.lit(4))).alias("copy")
    return ranked.select("*", copies).withColumn("id", F.col("id") * 5 + F.col("copy")).drop("copy")


_COPIED_FEATURES = f"""WITH {_VECTORS},
copied AS (SELECT id * 5 + copy AS id, d, value FROM means, (SELECT unnest(range(5)) AS copy))
SELECT id, d, round(coalesce(value / nullif(stddev_samp(value) OVER (PARTITION BY d), 0), 0), 6) + 0.0 AS value FROM copied"""


@query(_COPIED_FEATURES)
def features_by_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Computed once per pattern of terms, for URLs of which at least five share each."""
    table = patterns.features_by_pattern(_with_copies(_ranked(spark, sf_dir)), _borrowed_vectors(spark, sf_dir), S)
    return _by_dimension(table.withColumn("array", vector_to_array("vector")), "array", "id")


@query(_COPIED_FEATURES)
def features_by_pattern_shuffled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As for word vectors and patterns that fit no task."""
    ranked = _with_copies(_ranked(spark, sf_dir))
    table = patterns.pattern_features(patterns.term_patterns(ranked), _borrowed_vectors(spark, sf_dir), S, hot_keys=5, broadcast_bytes=0)
    found = patterns.to_urls(ranked, table, ["vector"], hot_keys=5, broadcast_bytes=0)
    return _by_dimension(found.withColumn("array", vector_to_array("vector")), "array", "id")


@query(_FEATURES)
def stored_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = UrlStore(_scratch(spark))
    store.write_ranked_urls(_ranked(spark, sf_dir))
    store.write_word_vectors(_borrowed_vectors(spark, sf_dir), 4)
    table = jobs.stored_features(spark, store, 4, S)
    return _by_dimension(table.withColumn("array", vector_to_array("vector")), "array", "id")


# ---------------------------------------------------------------- word vectors and clusters


def _trained_words(vectors: DataFrame, *keys: str) -> DataFrame:
    array = vector_to_array("vector")
    finite = F.forall(array, lambda x: ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.select(*keys, "word", F.size(array).alias("dimensions"), finite.alias("finite"))


# What SQL can know of trained vectors: whose they are, how long, and that they are numbers.
@query(f"WITH {_vocabulary_sql(MIN_COUNT)} SELECT word, 100 AS dimensions, true AS finite FROM (SELECT DISTINCT word FROM kept)")
def word_vectors_of_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _trained_words(word_vectors.word_vectors(_ranked(spark, sf_dir), window_size=4))


@query(f"""WITH {_vocabulary_sql(MIN_COUNT)}
SELECT window_size::INTEGER AS window_size, word, 100 AS dimensions, true AS finite
FROM (SELECT DISTINCT word FROM kept), (SELECT unnest([2, 3, 4, 5]) AS window_size)""")
def word_vectors_by_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _trained_words(word_vectors.word_vectors_by_window(_ranked(spark, sf_dir)), "window_size")


def _language_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as six terms of its language, drawn by hashes from twelve."""
    drawn = F.transform(F.sequence(F.lit(1), F.lit(6)), lambda i: F.concat("lang", F.lit(" "), F.pmod(F.xxhash64("doc_id", i), F.lit(12)).cast("string")))
    return _table(spark, sf_dir, "documents").where("lang is not null").select(drawn.alias("split_url"))


@query("""SELECT lang || ' ' || i AS word, true AS near_its_own FROM (SELECT DISTINCT lang FROM documents WHERE lang IS NOT NULL), (SELECT unnest(range(12)) AS i)""")
def word_vectors_in_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors trained in four blocks of words: words of one language, which stand together, are nearest to the mean of its words."""
    trained = cut_lineage(word_blocks.word_vectors_in_blocks(_language_terms(spark, sf_dir), 3, 16, blocks=4))
    vectors = trained.select("word", F.split("word", " ")[0].alias("lang"), "vector")
    means = vectors.groupBy(F.col("lang").alias("cluster_id")).agg(vector_to_array(Summarizer.mean(F.col("vector"))).alias("centre"))
    # One row for each language.
    centres = F.array(*[F.struct(F.lit(r.cluster_id).alias("cluster_id"), F.array(*map(F.lit, r.centre)).alias("centre")) for r in means.collect()])
    return vectors.select("word", (nearest_centre(vector_to_array("vector"), centres, "cosine") == F.col("lang")).alias("near_its_own"))


def _apart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings with one more, large dimension per label, so that the clusters are the labels."""
    vectors = _embeddings(spark, sf_dir)
    labels = [row.label for row in vectors.select("label").distinct().orderBy("label").collect()]
    more = F.array(*[F.when(F.col("label") == label, 1000.0).otherwise(0.0) for label in labels])
    return vectors.select(F.col("vec_id").alias("id"), F.col("label").cast("string").alias("url"),
                          array_to_vector(F.concat("embedding", more)).alias("vector"))


def _halved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings with three more dimensions whose signs are the bits of the label, each ten times the next."""
    bits = F.array(*[F.when(F.shiftright("label", bit).bitwiseAND(F.lit(1)) == 1, size).otherwise(-size)
                     for bit, size in ((2, 1e5), (1, 1e4), (0, 1e3))])
    return _embeddings(spark, sf_dir).select(F.col("vec_id").alias("id"), F.col("label").cast("string").alias("url"),
                                             array_to_vector(F.concat("embedding", bits)).alias("vector"))


def _by_first(clustered: DataFrame, *columns: str) -> DataFrame:
    """Every cluster named by its smallest id."""
    first = clustered.groupBy("cluster_id").agg(F.min("id").alias("first_of_cluster"))
    return clustered.join(first, "cluster_id").select("id", *columns, "first_of_cluster")


_BY_LABEL = "SELECT vec_id AS id, min(vec_id) OVER (PARTITION BY label) AS first_of_cluster FROM embeddings"
_BY_BITS = "SELECT vec_id AS id, min(vec_id) OVER (PARTITION BY label % 8) AS first_of_cluster FROM embeddings"


_BY_LABEL_MEASURES = "measures AS (SELECT unnest(['euclidean', 'cosine']) AS distance_measure)"


def _n_labels(spark: SparkSession, sf_dir: str) -> int:
    return _table(spark, sf_dir, "embeddings").select("label").distinct().count()


@query(_BY_LABEL)
def kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _by_first(clustering.cluster_urls(_apart(spark, sf_dir), _n_labels(spark, sf_dir)))


@query(_BY_LABEL)
def kmeans_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _by_first(clustering.cluster_urls(_apart(spark, sf_dir), _n_labels(spark, sf_dir), "cosine"))


@query(_BY_BITS)
def bisecting_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _by_first(clustering.cluster_urls(_halved(spark, sf_dir), 8, algorithm="bisecting_kmeans"))


# Under cosine distance only the largest of the three dimensions gives a direction.
@query("SELECT vec_id AS id, min(vec_id) OVER (PARTITION BY label % 8 >= 4) AS first_of_cluster FROM embeddings")
def bisecting_kmeans_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _by_first(clustering.cluster_urls(_halved(spark, sf_dir), 2, "cosine", algorithm="bisecting_kmeans"))


def _label_store(spark: SparkSession, sf_dir: str, windows: tuple[int, ...] = (4,)) -> UrlStore:
    """A store in which every URL is one term, its label, and every label has a direction of its own, so that the clusters are the labels."""
    store = UrlStore(_scratch(spark))
    rows = _table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), F.concat(F.lit("http://example.com/"), "label", F.lit("/"), "vec_id").alias("url"),
        F.array(F.col("label").cast("string")).alias("split_url"), F.array((F.col("label") + 1).cast("long")).alias("word_frequency_orders"),
    )
    store.write_ranked_urls(rows)
    labels = [row.label for row in rows.select(F.col("split_url")[0].alias("label")).distinct().orderBy("label").collect()]
    one_hot = F.array(*[F.when(F.col("word") == label, 1.0).otherwise(0.0) for label in labels])
    words = rows.select(F.col("split_url")[0].alias("word")).distinct().select("word", array_to_vector(one_hot).alias("vector"))
    for window in windows:
        store.write_word_vectors(words, window)
    return store


_STORED_BY_LABEL = """SELECT vec_id AS id, 'http://example.com/' || label || '/' || vec_id AS url,
  min(vec_id) OVER (PARTITION BY label) AS first_of_cluster FROM embeddings"""


def _stored_clusters(spark: SparkSession, sf_dir: str, algorithm: str) -> DataFrame:
    store = _label_store(spark, sf_dir)
    jobs.cluster_urls(spark, store, _n_labels(spark, sf_dir), "euclidean", 3.0, 4, algorithm=algorithm)
    return _by_first(store.read_clustered_urls(spark, algorithm), "url")


@query(_STORED_BY_LABEL)
def cluster_urls_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stored_clusters(spark, sf_dir, "kmeans")


@query(_STORED_BY_LABEL)
def cluster_urls_bisecting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stored_clusters(spark, sf_dir, "bisecting_kmeans")


# The labels' mean embeddings serve as fixed centres.
@query(f"""WITH {_EMBEDDING_VALUES},
centres AS (SELECT label AS cluster_id, d, avg(x) AS c FROM v GROUP BY label, d),
distances AS (
  SELECT v.vec_id, centres.cluster_id, sum((v.x - centres.c) * (v.x - centres.c)) AS distance
  FROM v JOIN centres USING (d) GROUP BY v.vec_id, centres.cluster_id)
SELECT vec_id AS id, arg_min(cluster_id, distance) AS cluster_id FROM distances GROUP BY vec_id""")
def assign_to_centres(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _embeddings(spark, sf_dir)
    size = vectors.select(F.size("embedding")).first()[0]
    means = F.array(*[F.avg(F.col("embedding")[i]) for i in range(size)])
    # One row per cluster, so the list of centres is as short as there are clusters.
    centres = vectors.groupBy(F.col("label").alias("cluster_id")).agg(means.alias("centre"))
    centre_list = centres.agg(F.collect_list(F.struct("cluster_id", "centre"))).scalar()
    with_centres = vectors.withColumn("centres", centre_list)
    nearest = nearest_centre(F.col("embedding"), F.col("centres"))
    return with_centres.select(F.col("vec_id").alias("id"), nearest.alias("cluster_id"))


# ---------------------------------------------------------------- scores and search


def _labelled_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vector_rows(spark, sf_dir).withColumn("cluster_id", F.col("url").cast("int"))


def _silhouette_row(spark: SparkSession, sf_dir: str, distance_measure: str) -> DataFrame:
    score = scores.silhouette(_labelled_vectors(spark, sf_dir), distance_measure)
    return spark.createDataFrame([(round(score, 6),)], "silhouette double")


def _silhouette_sql(distance: str) -> str:
    return f"""WITH pairs AS (
  SELECT a.vec_id, a.label AS own, b.label AS other, sum({distance}) AS total, count(*) AS n
  FROM (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings) a,
       (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings) b
  GROUP BY a.vec_id, a.label, b.label),
sides AS (
  SELECT vec_id, max(CASE WHEN own = other THEN n END) AS size,
         max(CASE WHEN own = other THEN total / nullif(n - 1, 0) END) AS a, min(CASE WHEN own <> other THEN total / n END) AS b
  FROM pairs GROUP BY vec_id)
SELECT round(avg(CASE WHEN size = 1 OR a = b THEN 0 ELSE (b - a) / greatest(a, b) END), 6) + 0.0 AS silhouette FROM sides"""


@query(_silhouette_sql("list_distance(a.e, b.e) ** 2"))
def silhouette_euclidean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _silhouette_row(spark, sf_dir, "euclidean")


@query(_silhouette_sql("1 - list_cosine_similarity(a.e, b.e)"))
def silhouette_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _silhouette_row(spark, sf_dir, "cosine")


_ALIGNED = """aligned AS (
  SELECT d.doc_id AS id, d.source AS label, coalesce(l.quality * 2 + l.toxic, -1) AS cluster_id
  FROM documents d LEFT JOIN labels l USING (doc_id))"""


@query(f"WITH {_ALIGNED} SELECT id, label, cluster_id FROM aligned")
def align_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores.align_labels(_labels(spark, sf_dir), _clusters(spark, sf_dir))


@query(f"""WITH {_ALIGNED},
codes AS (
  SELECT label, row_number() OVER (ORDER BY min(id)) AS label_id FROM aligned GROUP BY label)
SELECT id, label, cluster_id, label_id FROM aligned JOIN codes USING (label)""")
def encode_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    aligned = scores.align_labels(_labels(spark, sf_dir), _clusters(spark, sf_dir))
    return scores.encode_labels(aligned).select("id", "label", "cluster_id", "label_id")


def _v_measure_sql(assigned: str) -> str:
    return f"""pairs AS (SELECT label, cluster_id, count(*) AS n FROM {assigned} GROUP BY label, cluster_id),
by_label AS (SELECT label, sum(n) AS n FROM pairs GROUP BY label),
by_cluster AS (SELECT cluster_id, sum(n) AS n FROM pairs GROUP BY cluster_id),
size AS (SELECT sum(n) AS total FROM pairs),
entropies AS (
  SELECT (SELECT -sum(n / total * ln(n / total)) FROM by_label, size) AS h_label,
         (SELECT -sum(n / total * ln(n / total)) FROM by_cluster, size) AS h_cluster,
         (SELECT -sum(p.n / total * ln(p.n / c.n)) FROM pairs p JOIN by_cluster c USING (cluster_id), size) AS h_label_given,
         (SELECT -sum(p.n / total * ln(p.n / l.n)) FROM pairs p JOIN by_label l USING (label), size) AS h_cluster_given),
rates AS (
  SELECT CASE WHEN h_label = 0 THEN 1 ELSE 1 - h_label_given / h_label END AS h,
         CASE WHEN h_cluster = 0 THEN 1 ELSE 1 - h_cluster_given / h_cluster END AS c
  FROM entropies)
SELECT round(h, 6) + 0.0 AS homogeneity, round(c, 6) + 0.0 AS completeness,
       round(CASE WHEN h + c = 0 THEN 0 ELSE 2 * h * c / (h + c) END, 6) + 0.0 AS v_measure
FROM rates"""


def _six_scores(one_row: DataFrame) -> DataFrame:
    return one_row.select(*[_six(name).alias(name) for name in ["homogeneity", "completeness", "v_measure"]])


@query(f"WITH assigned AS (SELECT source AS label, lang AS cluster_id FROM documents), {_v_measure_sql('assigned')}")
def v_measure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _six_scores(scores.v_measure(_table(spark, sf_dir, "documents"), label="source", cluster="lang"))


@query(f"WITH {_ALIGNED}, {_v_measure_sql('aligned')}")
def evaluate_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _six_scores(scores.evaluate_clusters(_clusters(spark, sf_dir), _labels(spark, sf_dir)))


# Scored by their number of clusters, so that SQL knows every score and the best trial.
_KS, _WINDOWS, _EXPONENTS = (2, 3, 4, 5, 6), (3, 4), (1.0, 2.0)
_TRIALS = f"""trials AS (
  SELECT row_number() OVER (ORDER BY window_size, s, k)::INTEGER AS trial, k::INTEGER AS k, window_size::INTEGER AS window_size, s::DOUBLE AS s,
         least(k, (SELECT count(DISTINCT label) FROM embeddings))::DOUBLE AS score
  FROM (SELECT unnest({list(_KS)}) AS k), (SELECT unnest({list(_WINDOWS)}) AS window_size), (SELECT unnest({list(_EXPONENTS)}) AS s))"""


def _n_clusters(clustered: DataFrame) -> float:
    return float(clustered.select("cluster_id").distinct().count())


def _searched(spark: SparkSession, sf_dir: str, algorithm: str, **search) -> DataFrame:
    store = _label_store(spark, sf_dir, _WINDOWS)
    trials = grid_trials(_KS, ["euclidean"], _WINDOWS, _EXPONENTS)
    result = jobs.search_clusters_stored(spark, store, trials, algorithm=algorithm, score=_n_clusters, **search)
    stored = store.read_clustered_urls(spark, algorithm)
    rows, clusters = stored.count(), stored.select("cluster_id").distinct().count()
    best = F.col("trial") == trials.index(result.best) + 1
    return result.trials.select("trial", "algorithm", "k", "distance_measure", "window_size", "s", "score", best.alias("is_best"),
                                F.when(best, F.lit(rows)).alias("stored_rows"), F.when(best, F.lit(clusters)).alias("stored_clusters"))


def _searched_sql(algorithm: str) -> str:
    return f"""WITH {_TRIALS},
best AS (SELECT min(trial) AS trial FROM trials WHERE score = (SELECT max(score) FROM trials))
SELECT t.trial, '{algorithm}' AS algorithm, k, 'euclidean' AS distance_measure, window_size, s, score, t.trial = b.trial AS is_best,
       CASE WHEN t.trial = b.trial THEN (SELECT count(*) FROM embeddings)::INTEGER END AS stored_rows,
       CASE WHEN t.trial = b.trial THEN score::INTEGER END AS stored_clusters
FROM trials t, best b"""


@query(_searched_sql("kmeans"))
def search_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _searched(spark, sf_dir, "kmeans")


@query(_searched_sql("bisecting_kmeans"))
def search_bisecting_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _searched(spark, sf_dir, "bisecting_kmeans")


@query("""SELECT unnest(range(1, 21))::INTEGER AS trial, true AS in_range""")
def search_random_silhouettes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty random trials over trained vectors of the pages: every score is a silhouette or missing."""
    ranked = _ranked(spark, sf_dir)
    trials = random_trials(20, seed=11)
    trained = {size: cut_lineage(word_vectors.word_vectors(ranked, size)) for size in sorted({t.window_size for t in trials})}
    found = search_clusters(ranked, trained.__getitem__, trials).trials
    scored = found.filter("score is not null").count()
    return found.select("trial", F.coalesce(F.abs("score") <= 1, F.lit(scored >= 10)).alias("in_range"))


@query(_searched_sql("kmeans"))
def search_resumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search that finds half of its trials finished in a ledger."""
    ledger = f"{_scratch(spark)}/ledger"
    store = _label_store(spark, sf_dir, _WINDOWS)
    trials = grid_trials(_KS, ["euclidean"], _WINDOWS, _EXPONENTS)
    jobs.search_clusters_stored(spark, store, trials[::2], score=_n_clusters, ledger=ledger)
    return _searched(spark, sf_dir, "kmeans", ledger=ledger)


@query(f"""WITH {_BY_LABEL_MEASURES}
SELECT distance_measure, vec_id AS id, min(vec_id) OVER (PARTITION BY distance_measure, label) AS first_of_cluster FROM embeddings, measures""")
def kmeans_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fits of both distance measures in one pass each, beside fits with fewer clusters."""
    table, n = _apart(spark, sf_dir), _n_labels(spark, sf_dir)
    models = many_fits.fit_many(table, [many_fits.Fit(k, measure) for measure in ("euclidean", "cosine") for k in (n, 2, 3)])
    found = [_by_first(clustering.assign_clusters(models[at], table)).withColumn("distance_measure", F.lit(models[at].distance_measure)) for at in (0, 3)]
    return found[0].unionByName(found[1])


def _many_silhouettes_sql() -> str:
    return " UNION ALL ".join(f"SELECT '{name}' AS distance_measure, * FROM ({_silhouette_sql(distance)})" for name, distance in (
        ("euclidean", "list_distance(a.e, b.e) ** 2"), ("cosine", "1 - list_cosine_similarity(a.e, b.e)")))


@query(_many_silhouettes_sql())
def silhouettes_of_weighted_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Silhouettes of labelled vectors, each standing for one row."""
    rows = [(measure, many_fits.silhouette_of(_labelled_vectors(spark, sf_dir).withColumn("urls", F.lit(1)), measure, "urls")) for measure in ("euclidean", "cosine")]
    return spark.createDataFrame(rows, "distance_measure string, silhouette double").select("distance_measure", _six("silhouette").alias("silhouette"))


# ---------------------------------------------------------------- presentation and timing


@query("""SELECT l.doc_id AS id, l.quality * 2 + l.toxic AS cluster_id, d.source AS label
FROM labels l JOIN documents d USING (doc_id)""")
def attach_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coordinates.attach_labels(_clusters(spark, sf_dir), _labels(spark, sf_dir))


# Two dimensions, the sums of both halves of an embedding, so that SQL has the components in closed form.
_PLANE = """halves AS (
  SELECT vec_id, label, list_sum(embedding[1:len(embedding) // 2]::DOUBLE[]) AS a, list_sum(embedding[len(embedding) // 2 + 1:]::DOUBLE[]) AS b
  FROM embeddings),
angle AS (SELECT 0.5 * atan2(2 * covar_samp(a, b), var_samp(a) - var_samp(b)) AS t FROM halves),
signs AS (
  SELECT t, sign(CASE WHEN abs(cos(t)) >= abs(sin(t)) THEN cos(t) ELSE sin(t) END) AS first,
         sign(CASE WHEN abs(sin(t)) >= abs(cos(t)) THEN -sin(t) ELSE cos(t) END) AS second FROM angle),
plane AS (
  SELECT vec_id, label, round((a * cos(t) + b * sin(t)) * first, 6) + 0.0 AS x, round((b * cos(t) - a * sin(t)) * second, 6) + 0.0 AS y
  FROM halves, signs)"""


def _half_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    half = F.floor(F.size("embedding") / 2).cast("int")
    total = lambda array: F.aggregate(array, F.lit(0.0), lambda a, x: a + x)
    halves = F.array(total(F.slice("embedding", F.lit(1), half)), total(F.slice("embedding", half + 1, F.size("embedding"))))
    return _embeddings(spark, sf_dir).select(F.col("vec_id").alias("id"), F.col("label").cast("string").alias("url"),
                                             F.col("label").cast("int").alias("cluster_id"), array_to_vector(halves).alias("vector"))


def _vector_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _embeddings(spark, sf_dir).select(F.col("vec_id").alias("id"), F.concat(F.lit("label "), "label").alias("label"))


def _plane_result(plane: DataFrame) -> DataFrame:
    return plane.select(_six("x").alias("x"), _six("y").alias("y"), "id", "url", "label", "cluster_id")


_PLANE_RESULT = f"""WITH {_PLANE}
SELECT x, y, vec_id AS id, label::VARCHAR AS url, 'label ' || label AS label, label AS cluster_id FROM plane"""


@query(_PLANE_RESULT)
def plane_coordinates(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = coordinates.attach_labels(_half_sums(spark, sf_dir), _vector_labels(spark, sf_dir))
    return _plane_result(coordinates.plane_coordinates(labelled))


def _largest_sql(name: str, matrix: str) -> str:
    """``{name}_pair (v, value)``: the first eigenvector of a one-row table ``matrix (m)`` of rows, by squaring it fifteen times, and its eigenvalue."""
    square = "list_transform(m, lambda a: list_transform(m, lambda b: list_dot_product(a, b)))"
    trace = "list_sum(list_transform(q, lambda r, i: r[i]))"
    return f"""{name}_squares(n, m) AS (
  SELECT 0, m FROM {matrix}
  UNION ALL SELECT n + 1, list_transform(q, lambda r: list_transform(r, lambda x: x / {trace})) FROM (SELECT n, {square} AS q FROM {name}_squares WHERE n < 15)),
{name}_row AS (
  SELECT r FROM (SELECT unnest(m) AS r FROM {name}_squares WHERE n = 15) ORDER BY list_dot_product(r, r) DESC LIMIT 1),
{name}_vector AS (SELECT list_transform(r, lambda x: x / sqrt(list_dot_product(r, r))) AS v FROM {name}_row),
{name}_pair AS (SELECT v, list_dot_product(v, list_transform(m, lambda r: list_dot_product(r, v))) AS value FROM {name}_vector, {matrix})"""


@query(f"""WITH RECURSIVE parts AS (SELECT vec_id, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
centred AS (SELECT vec_id, i, x - avg(x) OVER (PARTITION BY i) AS x FROM parts),
covariances AS (SELECT a.i, b.i AS j, sum(a.x * b.x) / (count(*) - 1) AS c FROM centred a JOIN centred b USING (vec_id) GROUP BY a.i, b.i),
whole AS (SELECT list(r ORDER BY i) AS m FROM (SELECT i, list(c ORDER BY j) AS r FROM covariances GROUP BY i)),
{_largest_sql('first', 'whole')},
rest AS (SELECT list_transform(m, lambda r, i: list_transform(r, lambda x, j: x - value * v[i] * v[j])) AS m FROM whole, first_pair),
{_largest_sql('second', 'rest')}
SELECT (SELECT count(*) FROM embeddings) AS n, round(f.value, 4) AS x_variance, round(s.value, 4) AS y_variance, true AS uncorrelated, true AS signs
FROM first_pair f, second_pair s""")
def plane_coordinates_full_width(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Principal components of all dimensions of the embeddings: their variances are the two largest eigenvalues of the covariances, they are not correlated,
    and the dimension that each of them goes with most closely goes the same way."""
    vectors = _embeddings(spark, sf_dir)
    size = vectors.select(F.size("embedding")).first()[0]
    labelled = coordinates.attach_labels(_vector_rows(spark, sf_dir).withColumn("cluster_id", F.lit(0)), _vector_labels(spark, sf_dir))
    plane = coordinates.plane_coordinates(labelled).join(vectors.select(F.col("vec_id").alias("id"), "embedding"), "id")
    along = {axis: F.array(*[F.covar_samp(axis, F.col("embedding")[i]) for i in range(size)]) for axis in ("x", "y")}
    found = plane.agg(F.count(F.lit(1)).alias("n"), F.var_samp("x").alias("vx"), F.var_samp("y").alias("vy"), F.covar_samp("x", "y").alias("xy"),
                      along["x"].alias("ax"), along["y"].alias("ay"))
    same_way = [F.array_max(axis) >= -F.array_min(axis) for axis in ("ax", "ay")]
    return found.select("n", F.round("vx", 4).alias("x_variance"), F.round("vy", 4).alias("y_variance"), (F.abs("xy") < 1e-9 * F.col("vx")).alias("uncorrelated"),
                        (same_way[0] & same_way[1]).alias("signs"))


_PROFILE = """SELECT 'kmeans' AS algorithm, (SELECT count(*) FROM embeddings) AS n_rows, unnest(range(1, 11))::INTEGER AS run, true AS timed"""


@query(_PROFILE)
def profile_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    timings = timing.profile_fit(_vector_rows(spark, sf_dir), 10)
    return timings.select("algorithm", "n_rows", "run", (F.col("millis") >= 0).alias("timed"))


# ---------------------------------------------------------------- the jobs, over files and a store


def _csv(table: DataFrame, spark: SparkSession) -> str:
    path = _scratch(spark)
    table.write.csv(path, header=True)
    return path


@query(_SPLIT_RESULT)
def job_split_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = UrlStore(_scratch(spark))
    jobs.split_urls(spark, store, _csv(_urls(spark, sf_dir), spark))
    return _split_result(store.read_split_urls(spark))


@query(f"""WITH {_vocabulary_sql(40)},
ranked AS (
  SELECT id, url, string_agg(word, '|' ORDER BY pos) AS terms, string_agg(word_frequency_order, '|' ORDER BY pos) AS orders
  FROM kept GROUP BY id, url)
SELECT id, url, terms, orders, (SELECT count(*) FROM pages) - (SELECT count(*) FROM ranked) AS dropped FROM ranked""")
def job_rank_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = UrlStore(_scratch(spark))
    jobs.split_urls(spark, store, _csv(_urls(spark, sf_dir), spark))
    dropped = jobs.rank_terms(spark, store, min_count=40)
    return _ranked_result(store.read_ranked_urls(spark)).withColumn("dropped", F.lit(dropped).cast("long"))


def _stored_label_clusters(spark: SparkSession, sf_dir: str, clustered: DataFrame) -> UrlStore:
    store = UrlStore(_scratch(spark))
    store.write_clustered_urls(clustered, "kmeans")
    return store


# Labels stand behind other columns, and some are missing.
@query(f"""WITH assigned AS (
  SELECT CASE WHEN vec_id % 7 = 0 THEN NULL ELSE 'label ' || label END AS label, vec_id % 4 AS cluster_id FROM embeddings),
{_v_measure_sql('assigned')}""".replace("JOIN by_label l USING (label)", "JOIN by_label l ON p.label IS NOT DISTINCT FROM l.label"))
def job_evaluate_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    clustered = _half_sums(spark, sf_dir).withColumn("cluster_id", (F.col("id") % 4).cast("int"))
    labels = _vector_labels(spark, sf_dir).select(
        F.lit("test").alias("source"), "id", F.when(F.col("id") % 7 != 0, F.col("label")).alias("label"))
    store = _stored_label_clusters(spark, sf_dir, clustered)
    return _six_scores(jobs.evaluate_clusters(spark, store, _csv(labels, spark)))


@query(_PLANE_RESULT)
def job_plane_coordinates(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = _stored_label_clusters(spark, sf_dir, _half_sums(spark, sf_dir))
    return _plane_result(jobs.plane_coordinates(spark, store, _csv(_vector_labels(spark, sf_dir), spark)))


@query("""SELECT 'kmeans' AS algorithm, (SELECT count(*) FROM embeddings) AS n_rows, 10::BIGINT AS runs, true AS timed""")
def job_profile_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    summary = jobs.profile_clusters(spark, _label_store(spark, sf_dir), 4, "euclidean", 1.5, 4)
    return summary.select("algorithm", "n_rows", "runs", ((F.col("mean_millis") >= 0) & (F.col("std_millis") >= 0)).alias("timed"))


@query("""WITH aligned AS (SELECT doc_id AS id, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE source END AS label FROM documents),
codes AS (SELECT label, row_number() OVER (ORDER BY min(id)) AS label_id FROM aligned GROUP BY label)
SELECT a.id, a.label, c.label_id FROM aligned a JOIN codes c ON a.label IS NOT DISTINCT FROM c.label""")
def encode_null_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = _labels(spark, sf_dir).withColumn("label", F.when(F.col("id") % 5 != 0, F.col("label")))
    return scores.encode_labels(labels).select("id", "label", "label_id")


@query("SELECT doc_id AS id, source AS label FROM documents")
def csv_labels_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = _table(spark, sf_dir, "documents").select("lang", F.col("source").alias("label"), F.col("doc_id").alias("id"))
    return read_labels(spark, _csv(table, spark))


@query("SELECT vec_id AS id, label::VARCHAR AS url, label AS cluster_id FROM embeddings")
def emptied_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An empty table replaces its slice and leaves the other one."""
    clustered = _half_sums(spark, sf_dir)
    store = _stored_label_clusters(spark, sf_dir, clustered)
    store.write_clustered_urls(clustered, "bisecting_kmeans")
    store.write_clustered_urls(clustered.where("cluster_id < 0"), "kmeans")
    both = [store.read_clustered_urls(spark, algorithm) for algorithm in ("kmeans", "bisecting_kmeans")]
    return both[0].unionByName(both[1]).select("id", "url", "cluster_id")


_FAULTS = """WITH given AS (
  SELECT CASE WHEN page_id % 25 = 3 THEN page_id - 1 WHEN page_id % 25 NOT IN (0, 1) THEN page_id END AS id, page_id % 25 AS n, url FROM pages),
judged AS (
  SELECT id, url, CASE WHEN n = 0 THEN 'malformed' WHEN n = 1 THEN 'no id' WHEN count(*) OVER (PARTITION BY id) > 1 THEN 'id repeats' END AS reason
  FROM given)"""


def _quarantined(spark: SparkSession, sf_dir: str) -> Quarantined:
    n = F.col("page_id") % 25
    text = F.when(n == 0, F.concat(F.lit("page "), "page_id")).when(n == 1, F.lit(None)).when(n == 3, (F.col("page_id") - 1).cast("string"))
    return quarantine(spark, _csv(_table(spark, sf_dir, "pages").select(text.otherwise(F.col("page_id").cast("string")).alias("id"), "url"), spark))


@query(f"{_FAULTS} SELECT id, url FROM judged WHERE reason IS NULL")
def quarantine_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every 25 pages the first has no number as its id, the second none, and the fourth that of the third."""
    return _quarantined(spark, sf_dir).rows


@query(f"{_FAULTS} SELECT reason, count(*) AS lines FROM judged WHERE reason IS NOT NULL GROUP BY reason")
def quarantine_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _quarantined(spark, sf_dir).rejects.groupBy("reason").agg(F.count(F.lit(1)).alias("lines"))


@query("SELECT doc_id AS id, source AS label FROM documents")
def csv_labels_of_two_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label files of one folder whose columns stand in different orders."""
    path, labels = _scratch(spark), _labels(spark, sf_dir)
    labels.where("id % 2 = 0").write.csv(path, header=True)
    labels.where("id % 2 = 1").select(F.lit("x").alias("more"), "label", "id").write.mode("append").csv(path, header=True)
    return read_labels(spark, path)


@query(_SPLIT_RESULT)
def rewritten_split_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table that is read while it replaces itself, after a replacement that failed."""
    store, split = UrlStore(_scratch(spark)), _split(spark, sf_dir)
    store.write_split_urls(split.withColumn("url", F.concat("url", F.lit("!"))))
    try:
        store.write_split_urls(split.withColumn("url", F.raise_error(F.lit("the write fails")).cast("string")))
    except Exception:  # the version before stays
        store.write_split_urls(store.read_split_urls(spark).withColumn("url", F.expr("left(url, length(url) - 1)")))
    return _split_result(store.read_split_urls(spark))


# The events' values stand for measured times, their type for the algorithm, the user for the number of rows.
@query("""SELECT event_type AS algorithm, user_id AS n_rows, count(*) AS runs,
       round(avg(value), 6) + 0.0 AS mean_millis, round(stddev_samp(value), 6) + 0.0 AS std_millis
FROM events GROUP BY event_type, user_id""")
def timing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    timings = _table(spark, sf_dir, "events").select(
        F.col("event_type").alias("algorithm"), F.col("user_id").alias("n_rows"), F.col("value").alias("millis")
    )
    summary = timing.timing_summary(timings)
    return summary.select("algorithm", "n_rows", "runs", _six("mean_millis").alias("mean_millis"),
                          _six("std_millis").alias("std_millis"))
