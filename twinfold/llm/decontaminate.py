"""Benchmark decontamination with an Aho-Corasick automaton over word numbers.

Every window of ``WINDOW`` consecutive words of a benchmark item is a pattern (a shorter item is one pattern). Words are
numbered, so that a pattern is a sequence of ten numbers and the automaton has at most ten nodes per item word. Each text
is cut into words once and run through the automaton once; a hit marks its words, and word numbers lead back to
offsets in the original text.

The automaton is built in the workers from broadcast windows. A block holds about ``BLOCK_WINDOWS`` windows, which bounds the
broadcast and the automaton (about 200 MB); a larger benchmark is dealt into blocks by the hash of the window, and the texts
pass one automaton after another.

Defined results: a null or empty text has no words and no hits. Items without words have no windows. Repeated item
rows count once; a null item_id counts as the item named by the empty string. Every row of the documents gives one row, repeated rows
included. Columns other than the named ones are not looked at.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinfold.llm.common import map_batches, text_bytes
from twinfold.session import stage

WINDOW = 10
BLOCK_WINDOWS = 400_000

_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_SCAN = "n_words bigint, word_spans array<int>, items array<string>"


def words(text: bytes | None) -> list[bytes]:
    """Runs of a-z, 0-9 and characters above 0x7F after lower-casing A-Z."""
    return _WORD.findall(text.lower()) if text else []


def windows(tokens: list[bytes], size: int = WINDOW) -> list[tuple[bytes, ...]]:
    if not tokens:
        return []
    return [tuple(tokens[i : i + size]) for i in range(max(1, len(tokens) - size + 1))]


def window_table(benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """(window, item): the distinct windows of the items, words joined by one space."""

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column(0).to_pylist(), text_bytes(batch, "text")):
                found = sorted({b" ".join(w).decode() for w in windows(words(text), size)})
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(found), pa.array([item] * len(found))], ["window", "item"])

    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), "text")
    return items.mapInArrow(explode, "window string, item string").distinct()


class _Matcher:
    """The automaton of one block; built once per worker."""

    _built: dict[str, _Matcher] = {}

    def __init__(self, rows: list[tuple[str, list[str]]]):
        self.numbers: dict[bytes, int] = {}
        self.items: list[list[str]] = []
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for window, items in rows:
            tokens = window.encode().split(b" ")
            key = tuple(self.numbers.setdefault(t, len(self.numbers) + 1) for t in tokens)
            self.automaton.add_word(key, (len(self.items), len(tokens)))
            self.items.append(items)
        self.automaton.make_automaton()

    @classmethod
    def of(cls, key: str, rows) -> _Matcher:
        if key not in cls._built:
            cls._built.clear()
            cls._built[key] = cls(rows.value)
        return cls._built[key]

    def scan(self, tokens: list[bytes]) -> tuple[list[int], set[str]]:
        """Merged word spans [start, end) of all hits, flat, and the items hit."""
        number = self.numbers.get
        if not self.items:
            return [], set()
        starts: list[int] = []
        ends: list[int] = []
        found: set[int] = set()
        for end, (window, size) in self.automaton.iter(tuple([number(t, 0) for t in tokens])):
            found.add(window)
            start = end + 1 - size
            while starts and starts[-1] >= start:  # ends never fall, so only the last spans can be covered
                starts.pop()
                ends.pop()
            if starts and ends[-1] >= start:
                ends[-1] = end + 1
            else:
                starts.append(start)
                ends.append(end + 1)
        flat = [x for span in zip(starts, ends) for x in span]
        return flat, {i for w in found for i in self.items[w]}


def _merged(old: list[int], new: list[int]) -> list[int]:
    out: list[int] = []
    for start, end in sorted([*zip(old[::2], old[1::2]), *zip(new[::2], new[1::2])]):
        if out and start <= out[-1]:
            out[-1] = max(out[-1], end)
        else:
            out += [start, end]
    return out


def _scan_block(docs: DataFrame, rows: list[tuple[str, list[str]]], keep: list[str], more: bool) -> DataFrame:
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(rows)
    key = f"{spark.sparkContext.applicationId}-{id(shared)}-{hash(tuple(r[0] for r in rows[:50]))}-{len(rows)}"

    def build(batch: pa.RecordBatch) -> dict:
        matcher = _Matcher.of(key, shared)
        counts, spans, items = [], [], []
        earlier = (batch.column("word_spans").to_pylist(), batch.column("items").to_pylist()) if more else None
        for i, text in enumerate(text_bytes(batch, "text")):
            tokens = words(text)
            flat, hit = matcher.scan(tokens) if tokens else ([], set())
            if earlier:
                flat, hit = _merged(earlier[0][i], flat), hit | set(earlier[1][i])
            counts.append(len(tokens))
            spans.append(flat)
            items.append(sorted(hit))
        return {"n_words": counts, "word_spans": spans, "items": items}

    return map_batches(docs, build, _SCAN, keep=keep)


def find_hits(
    docs: DataFrame, benchmark: DataFrame, keep: list[str], size: int = WINDOW, block_windows: int = BLOCK_WINDOWS
) -> DataFrame:
    """``keep`` columns of ``docs`` with n_words, word_spans (flat [start, end) pairs of hit words) and items hit.

    ``docs`` needs a column ``text``; ``benchmark`` needs item_id and text.
    """
    spark = docs.sparkSession
    pairs = stage(window_table(benchmark, size), "windows")
    blocks = max(1, math.ceil(pairs.count() / block_windows))
    block = F.pmod(F.xxhash64("window"), F.lit(blocks))
    result = docs.select(*dict.fromkeys([*keep, "text"]))
    for b in range(blocks):
        # one block: about block_windows rows, whatever the size of the benchmark
        rows = pairs.where(block == b).groupBy("window").agg(F.sort_array(F.collect_list("item")).alias("items")).collect()
        more, last = b > 0, b == blocks - 1
        kept = list(keep) if last else list(dict.fromkeys([*keep, "text"]))
        result = _scan_block(result, sorted((r[0], list(r[1])) for r in rows), kept, more)
        if not last:
            result = stage(result, "scanned")
    return result


def hit_count(spans: str = "word_spans"):
    """The number of words in flat spans."""
    return F.aggregate(
        F.transform(F.col(spans), lambda x, i: F.when(i % 2 == 0, -x).otherwise(x).cast("bigint")),
        F.lit(0).cast("bigint"), lambda total, x: total + x,
    )


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated; one row per document."""
    found = find_hits(docs.select("doc_id", "text"), benchmark, ["doc_id"])
    return found.select(
        "doc_id", "n_words", hit_count().alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("word_spans") > 0).alias("contaminated"),
    )


def character_spans(text: str | None, word_spans: list[int]) -> list[tuple[int, int]]:
    """Word spans as code-point offsets [start, end) of the original text."""
    data = (text or "").encode()
    at = [m.span() for m in _WORD.finditer(data.lower())]
    chars = lambda byte: len(data[:byte].decode())
    return [(chars(at[s][0]), chars(at[e - 1][1])) for s, e in zip(word_spans[::2], word_spans[1::2])]


def items_digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
