"""The registered queries: each runs one operator over the whole of the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinfold.functions import hashing as h
from twinfold.functions import text as tx
from twinfold.functions.bits import to_hex
from twinfold.operators import alerts as al
from twinfold.operators import exact as ex
from twinfold.operators import media as md
from twinfold.operators import registry as rg
from twinfold.operators import text_similarity as ts
from twinfold.operators import utterances as ut
from twinfold.plans import streams as st
from twinfold.plans import tables as tb
from twinfold.plans import views as v

Query = Callable[[SparkSession, str], DataFrame]

AS_OF = "2024-01-30"
AS_OF_LATER = "2024-02-10"
KEYWORD = "doc_7"
TYPE = "doc"
USER = "SRC1"
USER_1, USER_2 = "src1", "src5"
START, END = "2024-01-05", "2024-01-20 12:00:00"
MIN_SIZE, MAX_SIZE = 2_000, 6_000
ALERT_USER, LAST_SEEN = "user8", 500


def _obs(columns: Callable[[], dict]) -> Query:
    """``columns`` makes the expressions when the query runs: that takes a session."""
    return lambda s, d: v.observations(s, d).select("id", *[c.alias(n) for n, c in columns().items()])


def _registry(run: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda s, d: run(v.downloads(s, d))


def _alerts(run: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda s, d: run(v.alerts(s, d))


def _sightings(run: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda s, d: run(v.observations(s, d))


def _log(run: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda s, d: run(v.utterances(s, d))


def _registry_insert(s: SparkSession, d: str) -> DataFrame:
    new, earlier = v.arrivals(s, d)
    return rg.insert_new(new, rg.first_sightings(earlier)).select("id", "file_hash", "file_name", "accepted")


def _exact_against_registry(s: SparkSession, d: str) -> DataFrame:
    new, earlier = v.arrivals(s, d)
    return ex.exact_dup_alerts(new, rg.first_sightings(earlier))


def _find_by_hash(s: SparkSession, d: str) -> DataFrame:
    registry = v.downloads(s, d)
    digest = registry.agg(F.min("file_hash")).first()[0]  # a literal, which the scan can use
    return ex.find_by_hash(registry, digest).select("id", "file_name", "file_hash", "file_path", "downloaded_by")


def _token_counts(s: SparkSession, d: str) -> DataFrame:
    words = F.col("words")
    return v.corpus(s, d).select("id", tx.all_tokens(F.col("extracted_text")).alias("words")).select(
        "id", F.size(words).cast("bigint").alias("tokens"), F.size(F.array_distinct(words)).cast("bigint").alias("terms")
    )


def _stopword_filter(s: SparkSession, d: str) -> DataFrame:
    kept = tx.tokens(F.col("extracted_text"))
    return v.corpus(s, d).select("id", F.sha2(F.array_join(kept, " "), 256).alias("kept_digest"))


def _idf(s: SparkSession, d: str) -> DataFrame:
    texts = v.corpus(s, d)
    idf = ts.idf_weights(ts.term_frequency(texts), texts.agg(F.count(F.lit(1))).scalar())
    return idf.select("term", "df", F.round("idf", 6).alias("idf"))


def _tfidf_norms(s: SparkSession, d: str) -> DataFrame:
    rows = ts.tfidf(v.corpus(s, d))
    return rows.groupBy("id").agg(
        F.count(F.lit(1)).alias("terms"),
        F.round(F.sqrt(F.sum(F.col("weight") * F.col("weight"))), 6).alias("norm"),
        F.round(F.max("weight"), 6).alias("top_weight"),
        F.round(F.sum("weight"), 6).alias("total_weight"),
    )


def _best_match(s: SparkSession, d: str) -> DataFrame:
    new, stored = v.corpora(s, d)
    return ts.best_match(new, stored).select(
        F.col("id").alias("new_id"), "match_id", F.round("score", 6).alias("similarity")
    )


def _text_alerts(s: SparkSession, d: str) -> DataFrame:
    files = v.downloads(s, d)
    found = ts.best_earlier_match(v.corpus(s, d))
    return ts.text_alerts(files.drop("extracted_text"), found)


def _stats(s: SparkSession, d: str) -> DataFrame:
    return al.stats(v.downloads(s, d), v.alerts(s, d))


def _preset(preset: str, as_of: str) -> Query:
    return _registry(lambda r: rg.search_preset(r, preset, as_of))


def _parameter(column: str) -> Query:
    return _log(lambda u: ut.utterance_parameters(u).select("id", column))


def queries() -> dict[str, Query]:
    return {
        # sources and registry
        "corpus_scan": lambda s, d: rg.corpus_scan(v.downloads(s, d)).select(
            "id", F.sha2("extracted_text", 256).alias("text_digest")
        ),
        "extract_text": lambda s, d: v.build_registry(s, d).select(
            "id", F.length("extracted_text").cast("bigint").alias("chars"), F.md5("extracted_text").alias("digest")
        ),
        "registry_insert": _registry_insert,
        "registry_bucketed": tb.registry_bucketed,
        "alert_status_current": _alerts(lambda a: a.select("id", "status")),
        # scalars
        "hash_sha256": _obs(lambda: {"sha256": h.content_sha256(F.col("content"))}),
        "hash_md5": _obs(lambda: {"md5": h.content_md5(F.col("content"))}),
        "file_extension": _obs(lambda: {"file_name": F.col("file_name"), "extension": h.extension(F.col("file_path"))}),
        "file_size": _obs(lambda: {"size": h.size_bytes(F.col("content"))}),
        "media_class": _obs(lambda: {"media": h.media_class(F.col("file_type")), "is_text": h.is_text(F.col("file_type"))}),
        # exact duplicates
        "find_by_hash": _find_by_hash,
        "find_by_hash_bucketed": tb.find_by_hash_bucketed,
        "exact_dup_alerts": _sightings(ex.exact_dup_alerts),
        "exact_dup_alerts_registry": _exact_against_registry,
        "cross_user_pairs": _sightings(ex.cross_user_members),
        "cross_user_one": _sightings(lambda o: ex.cross_user_members(o, USER_1)),
        "cross_user_two": _sightings(lambda o: ex.cross_user_members(o, USER_1, USER_2)),
        "cross_user_totals": _sightings(ex.cross_user_totals),
        "cross_user_totals_one": _sightings(lambda o: ex.cross_user_totals(o, USER_1)),
        "cross_user_totals_two": _sightings(lambda o: ex.cross_user_totals(o, USER_1, USER_2)),
        "duplicate_groups": _sightings(ex.duplicate_groups),
        "duplicate_report": _sightings(ex.duplicate_report),
        # text
        "text_clean": _obs(lambda: {"clean_digest": F.md5(tx.clean(F.col("content")))}),
        "token_counts": _token_counts,
        "stopword_filter": _stopword_filter,
        "term_frequency": lambda s, d: ts.term_frequency(v.corpus(s, d)),
        "idf_weights": _idf,
        "tfidf_norms": _tfidf_norms,
        "text_best_match": _best_match,
        "near_dup_pairs": lambda s, d: ts.near_dup_pairs(v.corpus(s, d)),
        "near_dup_groups": lambda s, d: ts.near_dup_groups(v.corpus(s, d)),
        "text_dup_alerts": _text_alerts,
        # images and videos
        "vector_fingerprint": lambda s, d: v.vectors(s, d).select("vec_id", "bits", to_hex(F.col("bits")).alias("hex")),
        "hamming_pairs": lambda s, d: md.hamming_pairs(v.images(s, d)),
        "fingerprint_groups": lambda s, d: md.fingerprint_groups(v.images(s, d)),
        "video_fingerprints": lambda s, d: v.fingerprints(s, d).select(
            "video_id", F.array_join(F.transform("fingerprint", to_hex), "|").alias("fingerprint")
        ),
        "video_pairs": lambda s, d: md.video_pairs(v.fingerprints(s, d)),
        "video_pairs_opened": lambda s, d: md.video_pairs(v.opened(s, d)),
        # searches
        "list_all": _registry(rg.list_all),
        "search_keyword": _registry(lambda r: rg.search_keyword(r, KEYWORD)),
        "search_type": _registry(lambda r: rg.search_type(r, TYPE)),
        "search_user": _registry(lambda r: rg.search_user(r, USER)),
        "search_dates": _registry(lambda r: rg.search_dates(r, START, END)),
        "search_size_min": _registry(lambda r: rg.search_size(r, MIN_SIZE)),
        "search_size_range": _registry(lambda r: rg.search_size(r, MIN_SIZE, MAX_SIZE)),
        "date_today": _preset("today", AS_OF),
        "date_yesterday": _preset("yesterday", AS_OF),
        "date_week": _preset("week", AS_OF),
        "date_month": _preset("month", AS_OF),
        "date_last_month": _preset("last_month", AS_OF_LATER),
        "preview_top20": _registry(lambda r: rg.preview(rg.list_all(r), F.desc("download_time"), F.desc("id"))),
        # alerts
        "alerts_all": _alerts(al.alerts_all),
        "alerts_pending": _alerts(lambda a: al.alerts_pending(a, ALERT_USER)),
        "max_alert_id": _alerts(al.max_alert_id),
        "alerts_since": _alerts(lambda a: al.alerts_since(a, ALERT_USER, LAST_SEEN)),
        "alerts_by_day": lambda s, d: tb.alerts_by_day(s, d, START, END),
        "stats": _stats,
        "alert_messages": _alerts(al.alert_messages),
        # questions
        "utterance_intents": _log(ut.utterance_intents),
        "intent_counts": _log(ut.intent_counts),
        "conversation_intents": lambda s, d: v.turns(s, d).select("conv_id", "turn", ut.intent(F.col("text")).alias("intent")),
        "conversation_intent_counts": lambda s, d: ut.intent_counts(v.turns(s, d)),
        "utterance_size": _parameter("min_bytes"),
        "utterance_type": _parameter("file_type"),
        "utterance_user": _parameter("user_name"),
        "utterance_two_users": _log(lambda u: ut.utterance_parameters(u).select("id", "user1", "user2")),
        "utterance_keyword": _parameter("keyword"),
        "utterance_routed": _log(ut.utterance_routed),
        # streams
        "monitor_alerts": st.monitor_alerts,
        "monitor_registry": st.monitor_registry,
        "stream_exact_alerts": st.stream_exact_alerts,
        "folder_files": st.folder_files,
        "folder_terms": st.folder_terms,
        "folder_registry": st.folder_registry,
        "alert_feed": lambda s, d: st.alert_feed_delivered(s, d, ALERT_USER),
        "stats_feed": st.stats_delivered,
    }
