"""Similarity search and encoding over ``embeddings`` and ``documents``."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import similarity as s
from ..session import stored
from .code import measured
from .corpus import NODES_SQL
from .registry import query, rounded, table

THRESHOLD = 0.3
CENTROIDS_SQL = """cells AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x,
  unnest(range(len(embedding))) AS d FROM embeddings),
centroids AS (SELECT label, d, avg(x) AS x FROM cells GROUP BY label, d),
pairs AS (SELECT c.label AS query_id, v.vec_id AS id,
  sum(c.x * v.x) / (sqrt(sum(c.x * c.x)) * sqrt(sum(v.x * v.x))) AS similarity
  FROM centroids c JOIN cells v USING (d) GROUP BY c.label, v.vec_id)"""


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")


def centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One query vector per label: the mean of its vectors."""
    cells = table(spark, sf_dir, "embeddings").select(
        "label", F.posexplode("embedding").alias("d", "x")
    )
    means = cells.groupBy("label", "d").agg(F.avg(F.col("x").cast("double")).alias("x"))
    packed = F.array_sort(F.collect_list(F.struct("d", "x")))
    return means.groupBy("label").agg(
        F.transform(packed, lambda p: p["x"]).alias("embedding")
    ).withColumnRenamed("label", "query_id")


@query(
    "similar_code",
    f"""WITH {CENTROIDS_SQL} SELECT CAST(query_id AS VARCHAR) AS query_id, CAST(id AS VARCHAR) AS id,
  round(similarity, 6) AS similarity FROM pairs WHERE similarity >= {THRESHOLD}""",
)
def similar_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = s.similar_code(vectors(spark, sf_dir), centroids(spark, sf_dir), THRESHOLD)
    return rounded(hits, "similarity", digits=6)


@query(
    "similar_code_top",
    f"""WITH {CENTROIDS_SQL} SELECT CAST(query_id AS VARCHAR) AS query_id, CAST(id AS VARCHAR) AS id,
  round(similarity, 6) AS similarity FROM pairs WHERE similarity >= {THRESHOLD}
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, CAST(id AS VARCHAR)) <= 5""",
)
def similar_code_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = s.similar_code(vectors(spark, sf_dir), centroids(spark, sf_dir), THRESHOLD, top=5)
    return rounded(hits, "similarity", digits=6)


@query(
    "similar_code_described",
    f"""WITH {NODES_SQL} SELECT code_id AS query_id, code_id AS id, 1.0::DOUBLE AS similarity,
  'Class: ' || split_part(code_id, ':', 2) AS purpose, cyclomatic, loc,
  round(maintainability, 6) AS maintainability FROM latest WHERE kind = 'class'""",
)
def similar_code_described(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every class searched in the encoded corpus; only itself is this close.

    A node's measures go along with its vector, so its text is not stored and no class has to
    be joined with its vector.
    """
    facts = ["code_id", "kind", "name", "path", "cyclomatic", "loc", "maintainability"]
    rows = measured(spark, sf_dir).select(F.struct(*facts).alias("node"), "code")
    encoded = s.encode_model(rows, "node", "code", s.hashing_model(256))
    encoded = stored(encoded.select("node.*", "embedding"), "encoded")
    every = encoded.select(F.col("code_id").alias("id"), "embedding")
    classes = encoded.where(F.col("kind") == "class")
    wanted = classes.select(F.col("code_id").alias("query_id"), "embedding")
    hits = s.similar_code(every, wanted, 0.99999)
    return rounded(s.describe_hits(hits, encoded), "similarity", "maintainability", digits=6)


def _weights_sql(width: int) -> str:
    return rf"""words AS (SELECT doc_id, unnest(regexp_extract_all(text, '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_]')) AS token
  FROM documents),
hashed AS (SELECT doc_id, md5(token) AS h, n FROM (SELECT doc_id, token, count(*) AS n FROM words GROUP BY ALL)),
summed AS (SELECT doc_id, CAST(('0x' || substr(h, 1, 8))::BIGINT % {width} AS INT) AS dim,
  sum(CASE WHEN substr(h, 9, 1) < '8' THEN n ELSE -n END) AS weight FROM hashed GROUP BY ALL),
unit AS (SELECT doc_id, dim, weight / sqrt(sum(weight * weight) OVER (PARTITION BY doc_id)) AS weight FROM summed)"""


@query(
    "encode_hashing",
    f"WITH {_weights_sql(64)} SELECT doc_id, dim, round(weight, 8) AS weight FROM unit WHERE weight <> 0",
)
def encode_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = s.encode_model(
        table(spark, sf_dir, "documents"),
        "doc_id",
        "text",
        s.hashing_model(64),
        element=T.DoubleType(),
    )
    cells = encoded.select("doc_id", F.posexplode("embedding").alias("dim", "weight"))
    return rounded(cells.where(F.col("weight") != 0), "weight")


def _letter_model():
    """A small stand-in model: counts of the letters a to z in the lowered text."""

    def predict(texts: np.ndarray) -> np.ndarray:
        rows = [[text.count(chr(97 + i)) for i in range(26)] for text in map(str.lower, texts)]
        return np.array(rows, dtype=np.float32)

    return predict


@query(
    "encode_model",
    f"""SELECT doc_id, unnest(range(26)) AS dim,
  unnest([{", ".join(f"len(low) - len(replace(low, '{chr(97 + i)}', ''))" for i in range(26))}])::DOUBLE AS weight
  FROM (SELECT doc_id, lower(text) AS low FROM documents)""",
)
def encode_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = s.encode_model(table(spark, sf_dir, "documents"), "doc_id", "text", _letter_model)
    cells = encoded.select("doc_id", F.posexplode("embedding").alias("dim", "weight"))
    return cells.select("doc_id", "dim", F.col("weight").cast("double").alias("weight"))


@query(
    "encode_incremental",
    """WITH keyed AS (SELECT doc_id, lang, 'hashing:' || substr(sha256(text), 1, 16) AS key FROM documents)
SELECT doc_id, key, key IN (SELECT key FROM keyed WHERE lang = 'en') AS reused, 32 AS width FROM keyed""",
)
def encode_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")

    def encode(snippets: DataFrame) -> DataFrame:
        return s.encode_model(snippets, "key", "code", s.hashing_model(32))

    english = documents.where(F.col("lang") == "en").select(
        s.snippet_key("hashing", "text").alias("key"), F.col("text").alias("code")
    )
    store = encode(english.dropDuplicates(["key"]))
    found, _ = s.encode_incremental(documents, store, encode, "hashing", "doc_id", "text")
    return found.select("doc_id", "key", "reused", F.size("embedding").alias("width"))


@query(
    "encode_incremental_vectors",
    f"""WITH {_weights_sql(32)} SELECT doc_id, dim, round(weight, 8) AS weight FROM unit WHERE weight <> 0""",
)
def encode_incremental_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vectors themselves, a third of them from a store that holds some keys twice."""
    documents = table(spark, sf_dir, "documents")

    def encode(snippets: DataFrame) -> DataFrame:
        return s.encode_model(snippets, "key", "code", s.hashing_model(32), element=T.DoubleType())

    some = documents.where(F.col("doc_id") % 3 == 0).select(
        s.snippet_key("hashing", "text").alias("key"), F.col("text").alias("code")
    )
    store = encode(some.union(some))
    found, _ = s.encode_incremental(documents, store, encode, "hashing", "doc_id", "text")
    cells = found.select("doc_id", F.posexplode("embedding").alias("dim", "weight"))
    return rounded(cells.where(F.col("weight") != 0), "weight")


@query(
    "similar_code_all",
    f"""WITH wanted AS (SELECT vec_id, embedding FROM embeddings WHERE vec_id % 20 = 0),
cells AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS d FROM embeddings),
pairs AS (SELECT q.vec_id AS query_id, v.vec_id AS id,
  sum(q.x * v.x) / (sqrt(sum(q.x * q.x)) * sqrt(sum(v.x * v.x))) AS similarity
  FROM cells q JOIN cells v USING (d) WHERE q.vec_id IN (SELECT vec_id FROM wanted) GROUP BY ALL)
SELECT CAST(query_id AS VARCHAR) AS query_id, CAST(id AS VARCHAR) AS id, round(similarity, 6) AS similarity
FROM pairs QUALIFY row_number() OVER (
  PARTITION BY query_id ORDER BY round(similarity, 9) DESC, CAST(id AS VARCHAR)) <= 10""",
)
def similar_code_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest vectors of every twentieth one, in blocks of queries and corpus."""
    every = vectors(spark, sf_dir)
    wanted = every.where(F.col("id") % 20 == 0).select(F.col("id").alias("query_id"), "embedding")
    every = every.select(F.col("id").cast("string").alias("id"), "embedding")
    wanted = wanted.select(F.col("query_id").cast("string").alias("query_id"), "embedding")
    hits = s.newest_rows(
        s._by_blocks(every, wanted, -1.0, 10), ["query_id"], [F.desc(F.round("similarity", 9)), F.col("id")], 10
    )
    return rounded(hits, "similarity", digits=6)
