"""The operators of this package as queries over the given tables, with SQL where SQL can state the result."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.llm import collocations, extraction, fingerprints, jaccard, language, mixing, mtree, packing, pivots, reputation, secrets, toxicity, warc
from pathloom.llm.folds import held_out
from pathloom.scale import shared_dir

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

# Rules of the URL query: verdict, host, start of the path.
URL_RULES = [
    ("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"), ("block", "com", "/de/"),
]


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLES[function.__name__] = sql
        return function

    return register


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query()
def op1_entropy_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


@query()
def op2_toxicity_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    labels = _table(spark, sf_dir, "labels").filter(~held_out(F.col("doc_id")))
    model = toxicity.fit(documents.filter(~held_out(F.col("doc_id"))), labels)
    scored = documents.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), toxicity.score(model, F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= toxicity.THRESHOLD).cast("int"))


_SHINGLES = r"""WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM words),
members AS (SELECT doc_id, len(s) AS n, unnest(s) AS shingle FROM sets),
shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS an, any_value(b.n) AS bn, count(*) AS common
  FROM members a JOIN members b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM shared WHERE 100 * common >= 80 * (an + bn - common)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reached(doc_id, other) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, e.b FROM reached r JOIN edges e ON e.a = r.other),
components AS (SELECT doc_id, min(other) AS component_id FROM reached GROUP BY doc_id)
SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id FROM sets JOIN components USING (doc_id)"""


@query(_SHINGLES)
def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar_documents(_table(spark, sf_dir, "documents"))


@query()
def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_edits(_table(spark, sf_dir, "documents"))


_BASE32 = "|| ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(h, {1 + 5 * i}, 5))::BIGINT >> {shift}) & 31) + 1)::BIGINT, 1)"
    for i in range(8) for shift in (15, 10, 5, 0)
)


@query(f"""WITH payloads AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
known AS (SELECT page_id, octet_length(payload)::BIGINT AS payload_bytes, sha1(payload) AS h FROM payloads),
firsts AS (SELECT *, min(page_id) OVER (PARTITION BY h, payload_bytes) AS first_id FROM known)
SELECT page_id, payload_bytes, {_BASE32} AS payload_digest,
       CASE WHEN first_id < page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first_id < page_id THEN first_id END AS refers_to
FROM firsts""")
def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/archives-{uuid.uuid4().hex}"
    warc.write_archives(_table(spark, sf_dir, "pages"), path)
    return warc.read_archives(spark, path)


@query()
def op6_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query()
def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language.fit(documents.filter(~held_out(F.col("doc_id"))))
    found = documents.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), language.predict(model, F.col("text")).alias("found"))
    return found.select("doc_id", "held_out", F.col("found.lang").alias("lang_pred"), "found.score", "found.rejected")


def _level_sql(name: str, table: str, mean: str) -> str:
    """The prior weight of a level and its shrunk rates; see ``reputation``."""
    return f"""{name}_fit AS (
  SELECT sum(n * (bad / n - {mean}) ** 2) AS square, sum({mean} * (1 - {mean})) AS within, sum(n * {mean} * (1 - {mean})) AS between_
  FROM {table} WHERE n > 0),
{name}_spread AS (SELECT CASE WHEN between_ > 0 THEN (square - within) / between_ ELSE 0 END AS spread FROM {name}_fit),
{name}_prior AS (SELECT CASE WHEN spread > 1e-6 THEN least(1e6, greatest(1.0, 1 / spread - 1)) ELSE 1e6 END AS weight FROM {name}_spread),
{name}_rates AS (SELECT t.*, weight, (bad + weight * {mean}) / (n + weight) AS {name}_rate FROM {table} t, {name}_prior)"""


_RULE_CASES = {
    kind: "CASE " + " ".join(
        f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{h + p if kind == 'rule' else verdict}'"
        for verdict, h, p in sorted(URL_RULES, key=lambda rule: -len(rule[1] + rule[2]))) + " END"
    for kind in ("rule", "verdict")
}


@query(rf"""WITH parts AS (
  SELECT page_id,
         coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
  FROM pages),
ruled AS (SELECT *, {_RULE_CASES['rule']} AS rule, {_RULE_CASES['verdict']} AS by_rule FROM parts),
counted AS (
  SELECT host, count(by_rule)::DOUBLE AS n, count(CASE WHEN by_rule = 'block' THEN 1 END)::DOUBLE AS bad FROM ruled GROUP BY host),
hosts AS (
  SELECT *, string_split(host, '.')[-1] AS suffix,
         CASE WHEN len(string_split(host, '.')) > 1 THEN array_to_string(string_split(host, '.')[-2:], '.') ELSE host END AS domain
  FROM counted),
domains AS (SELECT suffix, domain, sum(n) AS n, sum(bad) AS bad FROM hosts GROUP BY suffix, domain),
suffixes AS (
  SELECT suffix, sum(n) AS n, sum(bad) AS bad, (SELECT (sum(bad) + 0.5) / (sum(n) + 1) FROM domains) AS whole FROM domains GROUP BY suffix),
{_level_sql('suffix', 'suffixes', 'whole')},
domains_in AS (SELECT d.*, suffix_rate FROM domains d JOIN suffix_rates USING (suffix)),
{_level_sql('domain', 'domains_in', 'suffix_rate')},
hosts_in AS (SELECT h.*, domain_rate FROM hosts h JOIN domain_rates USING (domain)),
{_level_sql('host', 'hosts_in', 'domain_rate')},
bounds AS (
  SELECT host, least(1.0, host_rate + {reputation.DEVIATIONS} * sqrt(host_rate * (1 - host_rate) / (n + weight + 1))) AS bound FROM host_rates)
SELECT page_id, host, path, rule, coalesce(by_rule, CASE WHEN bound > {reputation.BLOCK_ABOVE} THEN 'block' ELSE 'allow' END) AS verdict
FROM ruled JOIN bounds USING (host)""")
def op8_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reputation.judge_urls(_table(spark, sf_dir, "pages"), URL_RULES).drop("posterior_bound")


@query("""WITH usable AS (
  SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: floor(1024 * x)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM usable q JOIN usable c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
ranked AS (
  SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score
  FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10""")
def op9_mtree_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mtree.top_k_inner_products(_table(spark, sf_dir, "embeddings"))


@query()
def op10_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.main_texts(_table(spark, sf_dir, "pages"))


def _cuts_sql() -> str:
    """The candidates' cuts with the counts of their parts."""
    return """SELECT c.lang, c.phrase, c.f AS a, k, p.f AS l, q.f AS r,
    (c.f::HUGEINT * c.f * 1000000 // (p.f::HUGEINT * q.f))::BIGINT AS score
  FROM (SELECT *, unnest(range(1, len(ws))) AS k FROM kept) c
  JOIN counts p ON p.lang = c.lang AND p.phrase = array_to_string(c.ws[1:k], ' ')
  JOIN counts q ON q.lang = c.lang AND q.phrase = array_to_string(c.ws[k + 1:], ' ')"""


@query(rf"""WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
phrases AS (
  SELECT lang, unnest(list_transform(range(1, len(w) - size + 2), lambda i: w[i:i + size - 1])) AS ws
  FROM words, (SELECT unnest([1, 2, 3]) AS size) WHERE len(w) >= size),
counts AS MATERIALIZED (SELECT lang, ws, array_to_string(ws, ' ') AS phrase, count(*) AS f FROM phrases GROUP BY lang, ws HAVING count(*) >= {collocations.LEAST_COUNT}),
totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM words GROUP BY lang),
inner_ AS (
  SELECT lang, unnest([ws[1:2], ws[2:3]]) AS ws, f FROM counts WHERE len(ws) = 3),
longest AS (SELECT lang, ws, max(f) AS f FROM inner_ GROUP BY lang, ws),
kept AS (
  SELECT c.* FROM counts c LEFT JOIN longest x ON x.lang = c.lang AND x.ws = c.ws
  WHERE len(c.ws) > 1 AND (x.f IS NULL OR 100 * x.f < {collocations.COVERED} * c.f)),
cuts AS ({_cuts_sql()}),
lowest AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS place FROM cuts),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM lowest WHERE place = 1)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= {collocations.TOP}""")
def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_table(spark, sf_dir, "documents").select("lang", "text"))


def _rounds_sql(rounds: int) -> str:
    """``a0, c1, a1, ...``: assignments and centroids of all rounds."""
    parts = []
    for i in range(rounds + 1):
        parts.append(f"""a{i} AS MATERIALIZED (
  SELECT rid, vec_id, v, min({{'d': list_sum(list_transform(v, lambda x, i: (x - cv[i]) * (x - cv[i])))::BIGINT, 'c': c}}) AS near
  FROM kept, (SELECT c, v AS cv FROM c{i}) GROUP BY rid, vec_id, v)""")
        if i < rounds:
            parts.append(f"""c{i + 1} AS MATERIALIZED (
  SELECT c{i}.c, coalesce(m.v, c{i}.v) AS v FROM c{i} LEFT JOIN (
    SELECT c, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS v FROM (
      SELECT c, i, sum(x) AS s, count(*) AS n FROM (SELECT near.c AS c, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM a{i}) GROUP BY c, i)
    GROUP BY c) m ON m.c = c{i}.c)""")
    return ",\n".join(parts)


@query(f"""WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding::DOUBLE[], lambda x: floor({pivots.SCALE} * x)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = {pivots.WIDTH} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (
  SELECT (row_number() OVER (ORDER BY sha256('{pivots.SALT}:' || coalesce(vec_id::VARCHAR, '')), v) - 1)::INTEGER AS c, v FROM kept
  QUALIFY c < {pivots.CLUSTERS}),
{_rounds_sql(pivots.ROUNDS)}
SELECT vec_id, near.c AS cluster, near.d AS distance, (sum(near.d) OVER (PARTITION BY near.c))::BIGINT AS cluster_inertia,
       (sum(near.d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c{pivots.ROUNDS}.v, ',')) AS centroid_sha256
FROM a{pivots.ROUNDS} JOIN c{pivots.ROUNDS} ON c = near.c""")
def op13_pivot_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivots.cluster_vectors(_table(spark, sf_dir, "embeddings"))


@query()
def op11_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_secrets(_table(spark, sf_dir, "documents"))
