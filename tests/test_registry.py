"""Searches of the registry."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from twinfold.functions import hashing as h
from twinfold.functions.matching import contains_like, date_range
from twinfold.operators import registry as rg
from twinfold.schemas import DOWNLOADS, TABLES, create_tables


@pytest.fixture(scope="module")
def registry(spark):
    rows = [
        (1, "Report_2024.docx", "a", "/p/1", "docx", 100, "quarterly figures", None, None, "Ann", dt.datetime(2024, 1, 1)),
        (2, "notes.doc", "b", "/p/2", "doc", 200, None, None, None, "bob", dt.datetime(2024, 1, 29)),
        (3, "100%.txt", "c", "/p/3", "txt", 300, "a report\\path", None, None, "ÉVA", dt.datetime(2024, 1, 30, 23, 59)),
        (4, "x.md", "d", "/p/4", "md", 400, "plain", None, None, None, dt.datetime(2024, 1, 31)),
    ]
    return spark.createDataFrame(rows, DOWNLOADS)


def _ids(df):
    return [r.id for r in df.collect()]


def test_searches(registry):
    assert _ids(rg.list_all(registry)) == [4, 3, 2, 1]
    assert _ids(rg.search_keyword(registry, "REPORT")) == [3, 1]
    assert _ids(rg.search_type(registry, "doc")) == [2, 1]
    assert _ids(rg.search_user(registry, "an")) == [1]
    assert _ids(rg.search_dates(registry, "2024-01-29", "2024-01-31")) == [3, 2]
    assert _ids(rg.search_size(registry, 200)) == [4, 3, 2]
    assert _ids(rg.search_size(registry, 200, 300)) == [3, 2]
    assert _ids(rg.search_size(registry, 200, -1)) == [4, 3, 2]


def test_like_has_wildcards_no_escape_and_folds_ascii_only(registry):
    assert _ids(rg.search_keyword(registry, "report_2")) == [1]
    assert _ids(rg.search_keyword(registry, "0%4")) == [1]
    assert _ids(rg.search_keyword(registry, "\\")) == [3]
    assert _ids(rg.search_user(registry, "Éva")) == [3]
    assert _ids(rg.search_user(registry, "éva")) == []
    assert _ids(rg.search_user(registry, "")) == [3, 2, 1]


@pytest.mark.parametrize(
    "preset,as_of,start,end",
    [
        ("today", "2024-01-30", "2024-01-30", "2024-01-31"),
        ("yesterday", "2024-03-01", "2024-02-29", "2024-03-01"),
        ("week", "2024-01-28", "2024-01-22", "2024-01-29"),
        ("week", "2024-01-29", "2024-01-29", "2024-01-30"),
        ("month", "2024-01-30", "2024-01-01", "2024-01-31"),
        ("last_month", "2024-01-15", "2023-12-01", "2024-01-01"),
    ],
)
def test_date_presets(spark, preset, as_of, start, end):
    found = spark.range(1).select(*[c.cast("string") for c in date_range(preset, as_of)]).first()
    assert tuple(found) == (f"{start} 00:00:00", f"{end} 00:00:00")


def test_preview(registry):
    order = (F.desc("download_time"), F.desc("id"))
    assert [(r.id, r.more) for r in rg.preview(rg.list_all(registry), *order, rows=3).collect()] == [(4, 1), (3, 1), (2, 1)]
    assert {r.more for r in rg.preview(rg.list_all(registry), *order).collect()} == {0}


@pytest.mark.parametrize(
    "path,want",
    [("/a/x.tar.GZ", "gz"), ("/a/.bashrc", ""), ("/a/name.", ""), ("/a.b/name", ""), ("x.PDF", "pdf"), ("/a/..x.y", "y")],
)
def test_extension(spark, path, want):
    assert spark.range(1).select(h.extension(F.lit(path))).first()[0] == want


def test_scalars(spark):
    row = spark.range(1).select(
        h.size_bytes(F.lit("é")), h.size_bytes(F.lit(None).cast("string")), h.content_sha256(F.lit(None).cast("binary")),
        h.media_class(F.lit("JPG")), h.media_class(F.lit("webm")), h.media_class(F.lit("")), contains_like(F.lit(None).cast("string"), "x"),
    ).first()
    assert tuple(row) == (2, 0, None, "image", "video", "other", None)


def test_tables_are_created_once(spark, tmp_path):
    spark.sql(f"CREATE DATABASE IF NOT EXISTS twin LOCATION '{tmp_path}/db'")
    for _ in range(2):
        create_tables(spark, "twin")
    assert {t.name for t in spark.catalog.listTables("twin")} == set(TABLES)
