"""The given tables in the shape of file observations, registry, fingerprints, alerts and questions.

Every view is derived from a whole table by one expression per column. ``oracle.py`` has the same views in SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinfold.fixed_values import SAMPLED_FRAMES
from twinfold.functions.bits import median_bits
from twinfold.functions.hashing import base_name, content_sha256, extension, size_bytes
from twinfold.functions.text import extracted_text
from twinfold.operators.alerts import current_status
from twinfold.operators.media import video_fingerprints as _fingerprints
from twinfold.operators.registry import corpus_scan, describe_text, first_sightings
from twinfold.session import stage
from twinfold.sources.tables import read_table

FILE_TYPES = ["txt", "pdf", "docx", "csv", "md", "html", "mp4", "jpg"]
EPOCH = "2024-01-01 00:00:00"


def _later(start, seconds):
    return start + F.make_dt_interval(secs=seconds.cast("decimal(18,6)"))


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One file observation per document, every 47 minutes, with its ``content``."""
    return observed(read_table(spark, f"{sf_dir}/documents.parquet", "doc_id"))


def observed(d: DataFrame) -> DataFrame:
    """Documents, in batch or as a stream, as file observations."""
    kind = F.get(F.array(*[F.lit(t) for t in FILE_TYPES]), F.pmod("doc_id", F.lit(len(FILE_TYPES))).cast("int"))
    shown = F.when(F.pmod("doc_id", F.lit(5)) == 0, F.upper(kind)).otherwise(kind)
    path = F.concat(F.lit("/srv/"), "source", F.lit("/doc_"), F.col("doc_id").cast("string"), F.lit("."), shown)
    start = F.lit(EPOCH).cast("timestamp_ntz")
    return d.select(F.col("doc_id").alias("id"), path.alias("file_path"), "text", "source").select(
        "id",
        base_name(F.col("file_path")).alias("file_name"),
        content_sha256(F.col("text")).alias("file_hash"),
        "file_path",
        extension(F.col("file_path")).alias("file_type"),
        size_bytes(F.col("text")).alias("file_size"),
        F.col("text").alias("content"),
        F.col("source").alias("downloaded_by"),
        _later(start, F.col("id") * 2820).alias("download_time"),
    )


def _cut_day(obs: DataFrame):
    """The day that halves the time the observations span."""
    first, last = F.min("download_time").cast("date"), F.max("download_time").cast("date")
    half = F.floor(F.date_diff(last, first) / 2).cast("int") + 1
    return obs.agg(F.date_add(first, half).cast("timestamp_ntz")).scalar()


def arrivals(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(new, earlier): the observations from the cut day on, and those before it."""
    obs = observations(spark, sf_dir)
    cut = _cut_day(obs)
    return obs.where(F.col("download_time") >= cut), obs.where(F.col("download_time") < cut)


_registries: dict[tuple[str, str], DataFrame] = {}


def build_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Take in all observations: the first one of each digest, with its extracted text."""
    return registered(first_sightings(observations(spark, sf_dir)))


def registered(obs: DataFrame) -> DataFrame:
    """Observations with the columns of the registry."""
    return describe_text(obs).withColumns({
        "image_phash": F.lit(None).cast("bigint"), "video_fingerprint": F.lit(None).cast("array<bigint>")
    })


def downloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registry as a stored table, which is what it is to all queries; taken in once per application."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _registries:
        _registries[key] = stage(build_registry(spark, sf_dir), "registry")
    return _registries[key]


_corpora: dict[tuple[str, str], DataFrame] = {}


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, arrived, extracted_text): every distinct text, whatever type its file claims; taken in once per application."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _corpora:
        texts = first_sightings(observations(spark, sf_dir)).select(
            "id", "download_time", extracted_text(F.col("content")).alias("extracted_text")
        )
        _corpora[key] = corpus_scan(stage(texts, "corpus"))  # a filter on the text, if it moved down to the scan, would clean it there again
    return _corpora[key]


def corpora(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(new, stored): the texts from the cut day on, and those before it."""
    texts = corpus(spark, sf_dir)
    cut = _cut_day(observations(spark, sf_dir))
    return texts.where(F.col("arrived") >= cut), texts.where(F.col("arrived") < cut)


def _flipped(bits, count, shift):
    """``bits`` with ``count`` neighbouring bits turned over, ``shift`` places from the lowest."""
    ones = F.call_function("shiftleft", F.lit(1).cast("bigint"), count.cast("int")) - 1
    return bits.bitwiseXOR(F.call_function("shiftleft", ones, shift.cast("int")))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, label, bits) of every embedding."""
    e = read_table(spark, f"{sf_dir}/embeddings.parquet", "vec_id")
    return e.select("vec_id", "label", median_bits(F.col("embedding")).alias("bits"))


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, bits): every embedding as a picture, and an edited copy of it that differs in 0 to 12 bits."""
    v = vectors(spark, sf_dir)
    edited = _flipped(F.col("bits"), F.pmod("vec_id", F.lit(13)), F.pmod("vec_id", F.lit(50)))
    both = F.inline(F.array(
        F.struct((F.col("vec_id") * 2).alias("id"), F.col("bits").alias("bits")),
        F.struct((F.col("vec_id") * 2 + 1).alias("id"), edited.alias("bits")),
    ))
    return v.select(both)


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(video_id, frame_no, bits): every embedding as a frame, and an edited copy of each clip.

    Clip k has 2k + 1 frames; its copy differs from it in (k mod 21) bits per frame.
    """
    v = vectors(spark, sf_dir).withColumn("clip", F.floor(F.sqrt(F.col("vec_id").cast("double"))).cast("bigint"))
    number = F.col("vec_id") - F.col("clip") * F.col("clip")
    edited = _flipped(F.col("bits"), F.pmod("clip", F.lit(21)), F.pmod("vec_id", F.lit(40)))
    both = F.inline(F.array(
        F.struct((F.col("clip") * 2).alias("video_id"), number.alias("frame_no"), F.col("bits").alias("bits")),
        F.struct((F.col("clip") * 2 + 1).alias("video_id"), number.alias("frame_no"), edited.alias("bits")),
    ))
    return v.select(both)


def fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fingerprints(frames(spark, sf_dir), SAMPLED_FRAMES)


def opened(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fingerprints if every video opened with a black frame."""
    black = F.array(F.lit(0).cast("bigint"))
    rest = F.slice("fingerprint", 2, F.size("fingerprint") - 1)
    return fingerprints(spark, sf_dir).select("video_id", F.concat(black, rest).alias("fingerprint"))


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.regexp_extract("props", "[0-9]+", 0).cast("bigint")
    return read_table(spark, f"{sf_dir}/events.parquet", "event_id").withColumn("k", k)


def alert_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as an alert: clicks and views as exact copies, the others as similar texts."""
    exact = F.col("event_type").isin("click", "view")
    name = lambda prefix, c, suffix="": F.concat(F.lit(prefix), F.col(c).cast("string"), F.lit(suffix))
    only_exact = lambda value: F.when(exact, value).otherwise(F.lit(""))
    return _events(spark, sf_dir).select(
        F.col("event_id").alias("id"),
        name("user", "user_id").alias("alert_for"),
        F.when(exact, "exact").otherwise("text_similar").alias("duplicate_type"),
        F.when(exact, F.lit(1.0)).otherwise(F.lit(0.75) + F.col("k") / F.lit(400.0)).alias("similarity"),
        name("new_", "event_id", ".txt").alias("new_file_name"),
        name("/srv/new_", "event_id", ".txt").alias("new_file_path"),
        F.when(exact, name("orig_", "k", ".txt")).otherwise(name("db_id:", "k")).alias("original_file"),
        only_exact(name("/srv/orig_", "k", ".txt")).alias("original_path"),
        only_exact(name("user", "k")).alias("original_user"),
        F.when(exact, F.col("ts") - F.make_dt_interval(F.lit(1))).alias("original_time"),
        F.col("k").alias("original_id"),
        F.col("ts").alias("created_time"),
    )


def status_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status changes of those alerts: views are shown; purchases shown, then resolved; signups resolved and
    shown again at the same moment; the others stay pending."""
    at = lambda secs: _later(F.col("ts"), F.lit(secs))
    change = lambda status, secs, seq: F.struct(
        F.col("event_id").alias("alert_id"), F.lit(status).alias("status"), at(secs).alias("ts"),
        (F.col("event_id") * 2 + seq).alias("seq"),
    )
    changes = (
        F.when(F.col("event_type") == "view", F.array(change("shown", 60, 0)))
        .when(F.col("event_type") == "purchase", F.array(change("shown", 60, 0), change("resolved", 120, 1)))
        .when(F.col("event_type") == "signup", F.array(change("resolved", 60, 0), change("shown", 60, 1)))
    )
    return _events(spark, sf_dir).select(F.inline(changes))


def alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return current_status(alert_log(spark, sf_dir), status_log(spark, sf_dir))


#: Questions of every kind; {u} and {k} stand for the user and the number of an event.
QUESTIONS = [
    "files from user u{u}", "show all pdfs", "files downloaded today", "files larger than {k} kb", "duplicates between u{u} and u{k}",
    "Hello there", "bye, u{u}", "I need help", "show stats", "summary of {k} files", "any duplicates for user u{u}?", "show my alerts",
    "what came yesterday", "files this  week", "files of this month", "downloads last month", "{k} mb or more", "size > {k}kb",
    "size > {k}", "find XLSX and docx {k}", "u{u}'s files", "list every file", "show downloads", "search report {k}", "find the file",
    "quarterly budget u{u}", "wav recordings {k}", "u{u} and u{k} duplicates of users", "show u{u}", "zażółć gęślą {k}",
]


def utterances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, text): a question per event, of each kind in turn."""
    kinds = F.array(*[F.lit(q) for q in QUESTIONS])
    text = F.get(kinds, F.pmod("event_id", F.lit(len(QUESTIONS))).cast("int"))
    text = F.replace(F.replace(text, F.lit("{u}"), F.col("user_id").cast("string")), F.lit("{k}"), F.col("k").cast("string"))
    return _events(spark, sf_dir).select(F.col("event_id").alias("id"), text.alias("text"))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, turn, id, text): every turn of a conversation as a question."""
    c = read_table(spark, f"{sf_dir}/conversations.parquet", "conv_id")
    return c.select("conv_id", "turn", F.col("conv_id").alias("id"), "text")
