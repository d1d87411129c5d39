"""Substring deduplication over content-defined chunks.

A gear rolling hash over the last ``REACH`` bytes cuts every text where its upper bits are zero, so a cut depends on the bytes around it
alone, and an insertion moves the cuts of a chunk or two, not those behind it. Chunks hold ``MIN_CHUNK`` to ``MAX_CHUNK`` bytes and end
between characters. Chunks of equal digest are the same; the document with the smallest doc_id keeps a chunk, and in all others it is a repeat.
A run of repeats one behind the other with at least ``MIN_WORDS`` words is a repeated passage.

The digest has 64 bits. A passage takes several chunks in a row, so that a chance collision makes no passage.

Chunks are numbers (digest, doc_id, place) and are shuffled once by digest. Digests that hold more than 1/``HOT`` of a bounded sample are
looked up in a map of at most ``HOT`` entries instead; a digest that the sample misses is only dealt less evenly.

Defined results: null and empty texts have no chunks. Rows with one doc_id are one document: what repeats within it is no repeat. Rows with a null
doc_id neither keep nor lose anything. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from twinfold.llm.common import text_bytes
from twinfold.session import stage

REACH = 16
MIN_CHUNK, MAX_CHUNK = 12, 64
CUT_BITS = 4  # a cut every 16 bytes or so
MIN_WORDS = 25
HOT = 1_000
SAMPLE = 200_000
PIECE = 1 << 22  # bytes hashed at a time

_GEAR = np.random.default_rng(5).integers(0, 1 << 32, 256, dtype=np.uint64).astype(np.uint32)
_BATCH = 500_000
_LENGTH_BITS, _WORD_BITS = 8, 8  # characters and words of a chunk, both at most MAX_CHUNK


def _candidates(data: np.ndarray) -> np.ndarray:
    """Ends of bytes after which the gear hash of the last REACH bytes asks for a cut."""
    found = []
    for start in range(0, len(data), PIECE):
        lead = min(start, REACH - 1)
        total = _GEAR[data[start - lead : start + PIECE]]
        width = 1
        while width < REACH:  # hash of 2w bytes: the newer w, and the older w shifted by w
            total[width:] = total[width:] + (total[:-width] << np.uint32(width))
            width *= 2
        ends = np.flatnonzero((total[lead:] >> np.uint32(32 - CUT_BITS)) == 0) + start + 1
        found.append(ends[ends >= REACH])
    return np.concatenate(found) if found else np.zeros(0, dtype=np.int64)


def cuts(text: bytes) -> list[int]:
    """Ends of the chunks, the end of the text included."""
    size = len(text)
    if not size:
        return []
    data = np.frombuffer(text, dtype=np.uint8)
    out: list[int] = []
    last = 0

    def cut(at: int) -> None:
        nonlocal last
        while at < size and text[at] & 0xC0 == 0x80:  # not inside a character
            at += 1
        out.append(at)
        last = at

    for end in _candidates(data).tolist():
        while end - last > MAX_CHUNK:
            cut(last + MAX_CHUNK - 3)  # room for the rest of a character
        if end - last >= MIN_CHUNK:
            cut(end)
    while size - last > MAX_CHUNK:
        cut(last + MAX_CHUNK - 3)
    if last < size:
        out.append(size)
    return out


def chunks(docs: DataFrame) -> DataFrame:
    """(digest, doc_id, place): every chunk; ``place`` holds its first character, its characters and its words (``place_parts``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids: list[np.ndarray] = []
            digests: list[int] = []
            places: list[np.ndarray] = []
            rows = 0

            def taken() -> pa.RecordBatch:
                arrays = [np.array(digests, dtype=np.uint64).view(np.int64), np.concatenate(ids), np.concatenate(places)]
                return pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], ["digest", "doc_id", "place"])

            for doc_id, text in zip(batch.column(0).to_pylist(), text_bytes(batch, "text")):
                if not text or doc_id is None:
                    continue
                ends = cuts(text)
                starts = [0, *ends[:-1]]
                digests += [xxhash.xxh3_64_intdigest(text[a:b]) for a, b in zip(starts, ends)]
                data = np.frombuffer(text, dtype=np.uint8)
                space = (data == 32) | ((data >= 9) & (data <= 13))
                first = np.concatenate([[True], space[:-1]]) & ~space
                upto = lambda marks: np.concatenate([[0], np.cumsum(marks)])[[0, *ends]]
                chars, words = upto((data & 0xC0) != 0x80), upto(first)
                place = (chars[:-1] << (_LENGTH_BITS + _WORD_BITS)) | (np.diff(chars) << _WORD_BITS) | np.diff(words)
                places.append(place.astype(np.int64))
                ids.append(np.full(len(ends), doc_id, dtype=np.int64))
                rows += len(ends)
                if rows > _BATCH:
                    yield taken()
                    ids, digests, places, rows = [], [], [], 0
            if rows:
                yield taken()

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, "digest bigint, doc_id bigint, place bigint")


def place_parts(place: int) -> tuple[int, int, int]:
    """(first character, characters, words) of a chunk."""
    return place >> (_LENGTH_BITS + _WORD_BITS), (place >> _WORD_BITS) & ((1 << _LENGTH_BITS) - 1), place & ((1 << _WORD_BITS) - 1)


def repeats(table: DataFrame) -> DataFrame:
    """(doc_id, place, keeper): the chunks whose digest a document with a smaller doc_id holds too; the smallest is the keeper."""
    total = table.count()
    part = table.select("digest") if total <= SAMPLE else table.select("digest").sample(min(1.0, SAMPLE / total), 5)
    counted = part.groupBy("digest").agg(F.count(F.lit(1)).alias("n"))
    frequent = counted.where(F.col("n") * HOT > min(total, SAMPLE)).orderBy(F.desc("n"), "digest").limit(HOT)
    hot = [r["digest"] for r in frequent.collect()]  # at most HOT numbers
    is_hot = F.col("digest").isin(hot) if hot else F.lit(False)
    keeper = F.min("doc_id").over(W.partitionBy("digest"))
    found = table.where(~is_hot).withColumn("keeper", keeper)
    if hot:
        least = table.where(is_hot).groupBy("digest").agg(F.min("doc_id").alias("keeper")).collect()  # at most HOT rows
        keepers = F.create_map(*[F.lit(x) for r in least for x in (r["digest"], r["keeper"])])
        found = found.unionByName(table.where(is_hot).withColumn("keeper", F.element_at(keepers, F.col("digest"))))
    return found.where("doc_id > keeper").select("doc_id", "place", "keeper")


def passages(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, start, end, n_words, first_doc_id): every repeated passage of a document, as code points [start, end).

    ``first_doc_id`` is the document that keeps the first chunk of the passage.
    """
    table = stage(chunks(docs), "chunks")
    found = repeats(table)
    listed = found.groupBy("doc_id").agg(F.sort_array(F.collect_set(F.struct("place", "keeper"))).alias("found"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[int, int, int, int, int]] = []
            lists = batch.column(1)
            offsets = lists.offsets.to_numpy()
            inner = lists.values
            place, keeper = (inner.field(k).to_numpy() for k in range(2))
            for doc_id, low, high in zip(batch.column(0).to_pylist(), offsets[:-1], offsets[1:]):
                start, size, words = place_parts(place[low:high])
                breaks = np.flatnonzero(start[1:] != (start + size)[:-1]) + 1
                firsts = np.concatenate([[0], breaks])
                lasts = np.concatenate([breaks, [high - low]]) - 1
                totals = np.add.reduceat(words, firsts)
                for a, b, n in zip(firsts, lasts, totals):
                    if n >= min_words:
                        out.append((doc_id, int(start[a]), int(start[b] + size[b]), int(n), int(keeper[low + a])))
            if out:
                names = ["doc_id", "start", "end", "n_words", "first_doc_id"]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names)

    return listed.mapInArrow(run, "doc_id bigint, start bigint, end bigint, n_words bigint, first_doc_id bigint")


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` with spans of code points cut out."""
    out, at = [], 0
    for start, end in sorted(spans):
        out.append(text[at:start])
        at = max(at, end)
    return "".join([*out, text[at:]])
