"""A corpus cleaned for training: the stages run one after another, each on what the one before it has kept.

Every stage is (name, function); the function takes (spark, docs, sf_dir) and returns a DataFrame, which ``run`` writes as
Parquet and reads again for the next one. All but the last return the columns of their input, extra columns included.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinfold.llm import decontaminate, mixing, near_dup, secret_scan, toxicity
from twinfold.llm.common import documents, labels
from twinfold.session import stage

#: Columns that stages work on; all others are handed through under neutral names, so that no name can clash.
OWN = ("doc_id", "text", "lang", "source", "n_chars")

#: Words per shingle and similarity in percent of the near-duplicate stage.
SHINGLE, SIMILARITY = 5, 80

#: No SQL: the toxicity stage is a trained network. tests/llm/test_pipeline.py holds each stage against brute force.
ORACLE_SQL: str | None = None


def _neutral(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """``docs`` with extra columns renamed, and the names to give back."""
    extras = {c: f"_extra_{i}" for i, c in enumerate(docs.columns) if c not in OWN}
    return docs.select(*[F.col(f"`{c}`").alias(extras.get(c, c)) for c in docs.columns]), docs.columns


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity network rejects, at the threshold of their language, go."""
    plain, names = _neutral(docs)
    net = toxicity.train(plain, labels(spark, sf_dir))
    return toxicity.scored(plain, net, tuple(plain.columns)).where("NOT rejected").select(*plain.columns).toDF(*names)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (5-word shingles, similarity of at least 0.8) the document with the smallest doc_id stays.

    Rows that agree in doc_id and text are one document; a doc_id with two texts is two, each judged by its own group. A document without a
    doc_id stands behind those that have one. Documents without words stay.
    """
    plain, names = _neutral(docs)
    found = near_dup.near_duplicates(plain, SHINGLE, SIMILARITY).where("NOT stands")
    gone = found.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct()
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_hash"))
    known = plain.join(gone, same, "left_anti").select(*plain.columns)
    return known.dropDuplicates(["doc_id", "text"]).toDF(*names)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of the benchmark go."""
    plain, names = _neutral(docs)
    found = decontaminate.find_hits(plain, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), plain.columns)
    return found.where(F.size("word_spans") == 0).select(*plain.columns).toDF(*names)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret is replaced by a mark; n_chars follows the text."""
    plain, names = _neutral(docs)
    found = secret_scan.scan(plain, keep=tuple(plain.columns))
    clean = found.withColumn("_clean", secret_scan.redacted(F.col("text"), F.col("spans")))
    cut = F.size("spans") > 0
    kind = plain.schema["n_chars"].dataType
    changed = {"text": F.col("_clean"), "n_chars": F.when(cut, F.length("_clean").cast(kind)).otherwise(F.col("n_chars"))}
    return clean.select(*[changed.get(c, F.col(c)).alias(c) for c in plain.columns]).toDF(*names)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with how often (``copies``) and how many words that makes (``taken``).

    Rows that agree in doc_id, source and text become one, and their copies add up.
    """
    key = F.xxhash64("text", "source")
    keyed = docs.select("doc_id", "text", "lang", "source", key.alias("_hash"))
    size = F.col("size")
    sized = keyed.select("doc_id", "source", "text", "_hash", mixing.word_count(F.col("text")).alias("size"))
    rows = sized.select("doc_id", "source", "size", mixing.quality_weight(F.col("text"), size).alias("weight"), "_hash")
    chosen = mixing.mix(rows, extra=("_hash",)).where("copies > 0")
    counts = chosen.groupBy(F.col("doc_id").alias("_id"), F.col("_hash").alias("_key")).agg(
        F.first("size").alias("size"), F.first("source_size").alias("source_size"), F.first("target").alias("target"),
        F.sum("copies").alias("copies"), F.sum("taken").alias("taken"),
    )
    once = keyed.dropDuplicates(["doc_id", "_hash"])
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_hash") == F.col("_key"))
    return once.join(counts, same).select(
        "doc_id", "text", "lang", "source", "size", "source_size", "target", "copies", "taken"
    )


STAGES = [
    ("toxicity", not_toxic),
    ("near_duplicates", without_near_duplicates),
    ("decontamination", decontaminated),
    ("secret_scan", without_secrets),
    ("mixing", mixed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, function in STAGES:
        docs = stage(function(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
