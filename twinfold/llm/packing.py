"""Packing without padding: every document is cut into pieces of binary length, and pieces of equal length share a bucket.

A document of n tokens becomes n // 2048 pieces of 2048 tokens and one piece for each power of two in the rest, the longest first. Each piece is
a sequence of its own, so no sequence crosses documents and none is padded. Sequences are numbered so that a bucket, the sequences of one
length, is one range of numbers: a batch of any size can be taken from a bucket without a mask.

Tokens come from a ready-made tokenizer whose pre-tokenizer never joins what white space parts, such as ``word_bpe_49k.json``: a text is
then the tokens of its words in a row, and each worker encodes a word once. Its own cache of words is bounded.

Defined results: a null or empty text is the end mark alone, a sequence of length 1. Rows are packed by themselves, rows with equal or null ids
too. Strings of special tokens in a text are read as the tokenizer reads them by default. Columns other than doc_id and text are
handed through only where asked for.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from twinfold.llm.common import extended, map_batches
from twinfold.session import stage

LONGEST = 2048
END = 1

#: Bytes of words that a worker remembers.
CACHED_BYTES = 32 << 20

#: A special token that parts words in the encoder, if the vocabulary has it, and the words between two of its calls.
PART, GROUP = "<|endoftext|>", 100

#: Bytes of texts, or characters of one long text, that are split into words at a time.
BATCH = 4 << 20

#: Counts by task and length up to which they are broadcast.
BROADCAST_ROWS = 200_000

_SPACE = re.compile(r"[\x20\x09-\x0D]")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Words:
    """Token ids of texts by way of their words, in Arrow and numpy arrays: no object is made for a word that is known."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks share the machine already
        from tokenizers import Tokenizer

        self._encoder = Tokenizer.from_file(path)
        self._forget()

    def _forget(self) -> None:
        self._known = pa.array([], pa.large_string())
        self._first = np.zeros(0, dtype=np.int64)  # where the ids of a known word begin, and how many there are
        self._count = np.zeros(0, dtype=np.int64)
        self._ids = np.zeros(0, dtype=np.uint32)

    def _encode(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words in a row, and how many each has; words go through the encoder in groups, parted by a special token."""
        part = self._encoder.token_to_id(PART)
        plain = words.to_pylist()
        grouped = part is not None and not pc.any(pc.match_substring(words, PART)).as_py()
        texts = [PART.join([*plain[i : i + GROUP], ""]) for i in range(0, len(plain), GROUP)] if grouped else plain
        encoded = [e.ids for e in self._encoder.encode_batch_fast(texts, add_special_tokens=False)]
        count = np.fromiter(map(len, encoded), dtype=np.int64, count=len(encoded))
        ids = np.fromiter(chain.from_iterable(encoded), dtype=np.uint32, count=int(count.sum()))
        if grouped:
            parts = np.flatnonzero(ids == part)
            count = np.diff(parts, prepend=-1) - 1
            ids = np.delete(ids, parts)
        return ids, count

    def _learn(self, words: pa.Array) -> None:
        fresh, count = self._encode(words)
        self._known = pa.concat_arrays([self._known, words])
        self._first = np.concatenate([self._first, len(self._ids) + np.cumsum(count) - count])
        self._count = np.concatenate([self._count, count])
        self._ids = np.concatenate([self._ids, fresh])

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and how many each text has. A null text has none."""
        if self._known.nbytes > CACHED_BYTES:
            self._forget()
        split = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
        words = split.flatten()
        spot = pc.index_in(words, value_set=self._known)
        at = pc.fill_null(spot, -1).to_numpy().astype(np.int64)
        if spot.null_count:
            unknown = words.filter(pc.is_null(spot))
            fresh = pc.unique(unknown)
            at[at < 0] = len(self._known) + pc.index_in(unknown, value_set=fresh).to_numpy()
            self._learn(fresh)
        count = self._count[at]
        upto = np.cumsum(count)
        total = int(upto[-1]) if len(upto) else 0
        ids = self._ids[np.repeat(self._first[at] - upto + count, count) + np.arange(total)]
        ends = np.concatenate([[0], upto])[split.offsets.to_numpy() - split.offsets[0].as_py()]
        return ids, np.diff(ends)


def segments(text: str) -> Iterator[str]:
    """``text`` in parts of about ``BATCH`` characters that end at white space."""
    at = 0
    while len(text) - at > BATCH:
        space = _SPACE.search(text, at + BATCH)
        if space is None:
            break
        yield text[at : space.end()]
        at = space.end()
    yield text[at:]


@lru_cache(maxsize=2)
def _words(path: str) -> Words:
    return Words(path)


def binary_lengths(n: int, longest: int = LONGEST) -> list[int]:
    """The pieces of a document of ``n`` tokens: as many of ``longest`` as it holds, then the powers of two in the rest."""
    rest = n % longest
    return [longest] * (n // longest) + [1 << b for b in reversed(range(longest.bit_length())) if rest >> b & 1]


def _encoded(path: str, texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, ids in a row, ids of each text, its end mark included) for about ``BATCH`` bytes of texts, or one longer text, at a time."""
    words = _words(path)
    upto = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    first = 0
    while first < len(texts):
        before = int(upto[first - 1]) if first else 0
        last = max(first + 1, int(np.searchsorted(upto, before + BATCH, side="right")))
        if last == first + 1 and upto[first] - before > BATCH:
            ids = np.concatenate([words.ids(pa.array([part]))[0] for part in segments(texts[first].as_py())])
            counts = np.array([len(ids)])
        else:
            ids, counts = words.ids(texts.slice(first, last - first))
        yield first, np.insert(ids, np.cumsum(counts), END), counts + 1
        first = last


def _cut(path: str, longest: int, names: list[str], out: StructType):
    """The task function: rows of pieces, with the task's number and the piece's place among those of its length there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(out)
        task = TaskContext.get().partitionId()
        seen = np.zeros(longest.bit_length(), dtype=np.int64)
        for batch in batches:
            column = lambda name: batch.column(batch.schema.get_field_index(name))
            for first, ids, totals in _encoded(path, column("text")):
                cuts = [binary_lengths(n, longest) for n in totals.tolist()]
                row = np.repeat(np.arange(len(totals)), [len(c) for c in cuts])
                length = np.array([n for c in cuts for n in c], dtype=np.int64)
                ends = np.concatenate([[0], np.cumsum(length)])
                start = ends[:-1] - np.concatenate([[0], np.cumsum(totals)])[row]
                rank = np.empty(len(row), dtype=np.int64)
                for size in np.unique(length):
                    of, bit = np.flatnonzero(length == size), int(size).bit_length() - 1
                    rank[of] = seen[bit] + np.arange(len(of))
                    seen[bit] += len(of)
                pieces = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids.astype(np.int32)))
                columns = [column(c).take(pa.array(row + first)) for c in names]
                columns += [pa.array(start), pa.array(length), pieces, pa.array(totals[row]), pa.array(np.full(len(row), task)), pa.array(rank)]
                columns = [c.cast(target.field(i).type) for i, c in enumerate(columns)]
                whole = pa.RecordBatch.from_arrays(columns, schema=target)
                for at in range(0, whole.num_rows, LONGEST):
                    yield whole.slice(at, LONGEST)

    return run


def packed(docs: DataFrame, tokenizer: str | None = None, longest: int = LONGEST, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, ``keep``, start, length, tokens (array of ids), doc_tokens, sequence_id, offset: a row per piece.

    ``longest`` is a power of two. ``tokenizer`` is the path of a file that every executor has. ``sequence_id`` counts from 0, the
    shortest bucket first; which document gets which number depends on how tasks were dealt, and on nothing else.

    The pieces are written once. What places them in their bucket is one count per task and length.
    """
    if longest < 1 or longest & (longest - 1):
        raise ValueError("the longest piece has to be a power of two")
    names = list(dict.fromkeys(["doc_id", *keep]))
    given = docs.select(*dict.fromkeys([*names, "text"]))
    out = extended(given, names, "start bigint, length bigint, tokens array<int>, doc_tokens bigint, _task bigint, _rank bigint")
    pieces = stage(given.mapInArrow(_cut(tokenizer or default_tokenizer(), longest, names, out), out), "pieces")

    counts = pieces.groupBy("length", "_task").agg(F.count(F.lit(1)).alias("n"))
    counts = stage(counts, "piece-counts")
    ahead = counts.groupBy("length").agg(F.sum("n").alias("n"))  # a dozen rows
    ahead = ahead.select("length", F.coalesce(F.sum("n").over(W.orderBy("length").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    earlier = W.partitionBy("length").orderBy("_task").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))).join(F.broadcast(ahead), "length")
    offsets = offsets.select("length", "_task", (F.col("base") + F.col("before")).alias("_first"))
    if counts.count() <= BROADCAST_ROWS:
        offsets = F.broadcast(offsets)
    placed = pieces.join(offsets, ["length", "_task"])
    number = F.col("_first") + F.col("_rank")
    return placed.select(*names, "start", "length", "tokens", "doc_tokens", number.alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))


def write_buckets(pieces: DataFrame, path: str) -> None:
    """The sequences as one folder per length, for training loops that take each batch from one bucket."""
    pieces.write.partitionBy("length").parquet(path)


def unsigned_crc32(pieces: DataFrame, name: str = "ids_crc32") -> DataFrame:
    """``pieces`` without tokens, with the CRC-32 of the ids as little-endian unsigned 32-bit numbers."""

    def digest(batch: pa.RecordBatch) -> dict[str, list[int]]:
        lists = batch.column(batch.schema.get_field_index("tokens"))
        ends = lists.offsets.to_numpy()
        data = memoryview(lists.values.to_numpy(zero_copy_only=False).astype("<u4").tobytes())
        return {name: [crc32(data[4 * a : 4 * b]) for a, b in zip(ends, ends[1:])]}

    return map_batches(pieces, digest, f"{name} bigint", [c for c in pieces.columns if c != "tokens"])
