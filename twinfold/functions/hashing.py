"""Content digests and file-metadata expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from twinfold.fixed_values import IMAGE_EXTENSIONS, TEXT_EXTENSIONS, VIDEO_EXTENSIONS


def content_sha256(content: Column) -> Column:
    """Lower-case hex SHA-256 of a string or binary column; null stays null."""
    return F.sha2(content, 256)


def content_md5(content: Column) -> Column:
    return F.md5(content)


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"[^/]+$", 0)


def extension(path: Column) -> Column:
    """Lower-case extension without its dot; empty for ``.profile``, ``name.`` and plain names."""
    return F.lower(F.regexp_extract(base_name(path), r"^.+\.([^.]+)$", 1))


def size_bytes(content: Column) -> Column:
    return F.coalesce(F.octet_length(content).cast("bigint"), F.lit(0).cast("bigint"))


def is_image(ext: Column) -> Column:
    return F.lower(ext).isin(IMAGE_EXTENSIONS)


def is_video(ext: Column) -> Column:
    return F.lower(ext).isin(VIDEO_EXTENSIONS)


def is_text(ext: Column) -> Column:
    return F.lower(ext).isin(TEXT_EXTENSIONS)


def media_class(ext: Column) -> Column:
    return F.when(is_image(ext), "image").when(is_video(ext), "video").otherwise("other")
