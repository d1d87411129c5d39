"""Texts of files of any size, as rows of pieces.

A file is cut near every multiple of a piece's size, behind the first white-space byte there. Such a byte is no part of a longer
character and ends every word, so no piece holds half of either: counts of words over the pieces of a file are those of its
whole text. Each piece is read by itself, by position, so the pieces of one huge file are read by many tasks, and no text has to fit a
cell. A run without white space that is longer than a piece is one piece.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinfold.functions.hashing import extension, is_text
from twinfold.functions.text import decode_utf8, extracted_text, has_text
from twinfold.sources.folder import file_system

PIECE_BYTES = 8 << 20
TASK_BYTES = 128 << 20

_SPACE = re.compile(rb"[\t-\r\x1c-\x20]")  # the white space of one byte that separates words
_STEP = 1 << 16


def read_piece(file: BinaryIO, number: int, size: int) -> bytes:
    """The piece of that number: empty where a run without white space goes through its whole range."""
    low, high = max(number * size - 1, 0), (number + 1) * size - 1
    file.seek(low)
    data = file.read(high - low)
    start = 0
    if number:
        found = _SPACE.search(data)
        if not found:
            return b""
        start = found.end()
    parts = [data[start:]]
    while more := file.read(_STEP):
        found = _SPACE.search(more)
        if found:
            parts.append(more[: found.end()])
            break
        parts.append(more)
    return b"".join(parts)


def file_pieces(files: DataFrame, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """(path, piece, content) of listed files (path, length); pieces are numbered from 0, empty ones are left out.

    A file that is gone or may not be read has no pieces; any other fault fails the task, which is run again.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, (path, piece) in enumerate(zip(batch.column("path").to_pylist(), batch.column("piece").to_pylist())):
                system, inner, _ = file_system(path)
                try:
                    with system.open_input_file(inner) as file:
                        content = read_piece(file, piece, piece_bytes)
                except (FileNotFoundError, PermissionError, IsADirectoryError):
                    continue
                if content:
                    one = batch.slice(i, 1)
                    yield pa.RecordBatch.from_arrays([one.column(0), one.column(1), pa.array([content], pa.binary())], ["path", "piece", "content"])

    last = F.floor((F.col("length") - 1) / piece_bytes)
    ranges = files.where("length > 0").select("path", F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("piece"))
    total = files.agg(F.sum("length")).first()[0] or 0
    tasks = max(files.sparkSession.sparkContext.defaultParallelism, math.ceil(total / TASK_BYTES))
    spread = ranges.repartition(tasks, "path", "piece")  # a number of tasks that stays: the rows are tiny, what they name is not
    return spread.mapInArrow(run, "path string, piece bigint, content binary")


def text_pieces(files: DataFrame, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """(id, piece, extracted_text): the cleaned pieces of the text files among ``files``, with the path as id; blank ones are left out.

    ``text_similarity.term_frequency`` takes them as it takes whole texts, and merges the counts of a file.
    """
    textual = files.where(is_text(extension(F.col("path"))))
    decoded = decode_utf8(F.col("content"))
    filled = file_pieces(textual, piece_bytes).where(has_text(decoded))
    return filled.select(F.col("path").alias("id"), "piece", extracted_text(decoded).alias("extracted_text"))
