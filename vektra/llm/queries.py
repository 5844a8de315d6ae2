"""The queries of this subpackage and their SQL, as ``__spark_entry__`` registers them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline

from . import ann, caps, packing, pieces, pii, quality, secrets, simhash, toxicity, urlrep
from .shared import held_out, table


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = secrets.train(secrets.labelled_samples(spark))
    found = secrets.scan(table(spark, sf_dir, "documents"), model)
    counts = [F.size(F.filter(F.transform("base", lambda s: s["kind"]), _is(k))).cast("long").alias(f"n_{k}") for k, *_ in secrets.BASE]
    both = F.array_sort(F.concat(F.transform("base", lambda s: _ranked(s)), F.transform("added", lambda s: _ranked(s))))
    return found.select("doc_id", *counts, F.sha2(secrets.written(F.col("base")), 256).alias("base_sha256"), secrets.written(both).alias("spans"))


def _is(value):
    return lambda x: x == value


def _ranked(span):
    rank = F.when(span["kind"] == "assign", 0).when(span["kind"] == "access", 1).when(span["kind"] == "hex", 2).otherwise(3)
    return F.struct(span["start"].alias("start"), rank.alias("k"), span["end"].alias("end"), span["kind"].alias("kind"))


#: The rules of the query, as (verdict, host, path).
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))


def op4_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's outcome is that of the labelled document with its id: bad if poor or toxic."""
    outcomes = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).cast("int").alias("bad"))
    return urlrep.judge(table(spark, sf_dir, "pages"), outcomes, RULES).select("page_id", "host", "path", "rule", "verdict")


OP4_SQL = """
WITH cut AS (
  SELECT page_id, url, strpos(url, '://') AS pos FROM pages),
mine AS (
  SELECT page_id,
    CASE WHEN pos > 0 THEN translate(regexp_extract(substr(url, pos + 3), '^([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
    CASE WHEN pos > 0 THEN regexp_extract(substr(url, pos + 3), '^([^/?#]*)([^?#]*)', 2) ELSE '' END AS path
  FROM cut),
worst AS (
  SELECT doc_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 WHEN quality IS NULL OR toxic IS NULL THEN NULL ELSE 0 END) AS bad
  FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
hosts AS (
  SELECT host, regexp_extract(host, '([^.]*\\.)?[^.]*$') AS domain, regexp_extract(host, '[^.]*$') AS suffix,
    count(bad)::DOUBLE AS n, coalesce(sum(bad), 0)::DOUBLE AS k
  FROM mine LEFT JOIN worst ON page_id = doc_id GROUP BY host),
domains AS (SELECT domain, suffix, sum(n) AS n, sum(k) AS k FROM hosts GROUP BY domain, suffix),
suffixes AS (SELECT suffix, sum(n) AS n, sum(k) AS k FROM hosts GROUP BY suffix),
total AS (SELECT sum(n) AS n, sum(k) AS k, CASE WHEN sum(n) > 0 THEN sum(k) / sum(n) ELSE 0 END AS m FROM hosts),
levels AS (
  SELECT 'host' AS level, n, k FROM hosts UNION ALL SELECT 'domain', n, k FROM domains UNION ALL SELECT 'suffix', n, k FROM suffixes),
sums AS (
  SELECT level, count(*) AS g, sum(l.n) AS n, sum(l.n * l.n) AS n2,
    sum(l.k * l.k / l.n) - 2 * any_value(m) * sum(l.k) + any_value(m) * any_value(m) * sum(l.n) AS s, any_value(m) AS m
  FROM levels l, total t WHERE l.n > 0 GROUP BY level),
rho AS (
  SELECT level, CASE WHEN m > 0 AND m < 1 AND n - n2 / n - (g - 1) > 0
    THEN (s / (m * (1 - m)) - (g - 1)) / (n - n2 / n - (g - 1)) ELSE 0 END AS r FROM sums),
strength AS (SELECT level, CASE WHEN r > 0 THEN least(greatest(1 / r - 1, 1.0), 10000.0) ELSE 10000.0 END AS c FROM rho),
ps AS (
  SELECT suffix, (s.k + c * ((t.k + 1.0) / (t.n + 10.0))) / (s.n + c) AS p
  FROM suffixes s, total t, (SELECT coalesce(max(c), 10000.0) AS c FROM strength WHERE level = 'suffix')),
pd AS (
  SELECT domain, d.suffix, (d.k + c * ps.p) / (d.n + c) AS p
  FROM domains d JOIN ps ON d.suffix = ps.suffix, (SELECT coalesce(max(c), 10000.0) AS c FROM strength WHERE level = 'domain')),
ph AS (
  SELECT host, h.n, c, (h.k + c * pd.p) / (h.n + c) AS p
  FROM hosts h JOIN pd ON h.domain = pd.domain AND h.suffix = pd.suffix, (SELECT coalesce(max(c), 10000.0) AS c FROM strength WHERE level = 'host')),
rated AS (SELECT host, p - 1.645 * sqrt(p * (1 - p) / (n + c + 1)) AS bound FROM ph),
ruled AS (
  SELECT m.page_id, m.host, m.path, bound,
    CASE WHEN (m.host = 'example.com' OR ends_with(m.host, '.example.com')) AND starts_with(m.path, '/en/7') THEN 'example.com/en/7'
         WHEN (m.host = 'example.net' OR ends_with(m.host, '.example.net')) AND starts_with(m.path, '/de/8') THEN 'example.net/de/8'
         WHEN (m.host = 'com' OR ends_with(m.host, '.com')) AND starts_with(m.path, '/en/') THEN 'com/en/'
         WHEN (m.host = 'net' OR ends_with(m.host, '.net')) AND starts_with(m.path, '/de/') THEN 'net/de/'
         WHEN (m.host = 'org' OR ends_with(m.host, '.org')) AND starts_with(m.path, '/es/') THEN 'org/es/' END AS rule
  FROM mine m LEFT JOIN rated r ON m.host = r.host)
SELECT page_id, host, path, rule,
  CASE WHEN rule = 'example.com/en/7' THEN 'allow' WHEN rule IS NOT NULL THEN 'block' WHEN bound >= 0.35 THEN 'block' ELSE 'allow' END AS verdict
FROM ruled
"""


def _tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), _tokenizer())


def _classified(module, label: str, threshold: float):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        docs = table(spark, sf_dir, "documents")
        model = module.train(docs, table(spark, sf_dir, "labels"), label)
        found = module.classify(docs, model, threshold=threshold)
        return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")

    return run


op3_toxicity = _classified(toxicity, "toxic", 0.3)
op6_quality = _classified(quality, "quality", 0.7)


#: The key of the query's pseudonyms; a real run passes its own.
KEY = "vektra"


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), KEY, found_col="found")
    counts = [F.size(F.filter("found", _is(k))).cast("long").alias(f"n_{k}") for k in pii.KINDS]
    return found.select("doc_id", "text", *counts)


def op1_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann.search(vectors, vectors.where(F.col("vec_id") % 50 == 0))


def op5_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return caps.near_duplicates(table(spark, sf_dir, "embeddings"))


def op9_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as model:
        return pieces.encode(table(spark, sf_dir, "documents"), model.read())


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_ann": op1_ann,
        "op2_pii": op2_pii,
        "op3_toxicity": op3_toxicity,
        "op4_url_reputation": op4_url_reputation,
        "op5_caps": op5_caps,
        "op6_quality": op6_quality,
        "op7_simhash": op7_simhash,
        "op8_packing": op8_packing,
        "op9_pieces": op9_pieces,
        "op10_secrets": op10_secrets,
        "pipeline": pipeline,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_url_reputation": OP4_SQL}
