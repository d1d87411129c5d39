"""Fill-in-the-middle examples: a text's lines become prefix, middle and suffix, and the middle goes last.

Each Arrow batch runs through one pipeline of ``pyarrow.compute``: texts are split into lists of lines, the lists are flattened with the index
of their text, each line gets its ordinal and from it a role, the lines of each role are filtered and put back into lists, and every list is
joined into one piece. There is no loop over texts or lines.

Where a text is cut and which form it takes follows from a digest of its doc_id, so reruns agree.

Defined results: a null text counts as empty, and an empty text stays as it is (form ``plain``), as does a text that contains one of the marks.
A null doc_id is drawn as an empty one. Rows with the same doc_id are drawn alike, each is cut by its own text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinfold.llm.common import extended

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"

#: Percent of the texts that are transformed, and of these the ones whose suffix comes first.
RATE, SUFFIX_FIRST = 100, 50

SEED = 7

#: Bytes of text that go through the pipeline at a time; a longer text goes alone.
SLICE = 8 << 20


def draws(doc_id: Column, seed: int = SEED) -> list[Column]:
    """Four numbers below 2^32 from the digest of ``seed``:doc_id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("bigint") for i in range(4)]


def _lines(texts: pa.LargeStringArray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Every line with its line end, the index of its text, and the number of lines of each text."""
    parts = pc.split_pattern(texts, "\n")
    flat, parent = pc.list_flatten(parts), pc.list_parent_indices(parts).to_numpy()
    count = pc.list_value_length(parts).to_numpy()
    last = np.zeros(len(flat), dtype=bool)
    last[np.cumsum(count) - 1] = True  # a split has one part at least
    ended = pc.binary_join_element_wise(flat, pa.array(["\n"], flat.type)[0], pa.array([""], flat.type)[0])
    whole = pc.if_else(pa.array(last), flat, ended)
    real = pc.or_(pc.invert(pa.array(last)), pc.not_equal(pc.binary_length(whole), 0))
    return whole.filter(real), parent[real.to_numpy(zero_copy_only=False)], count - np.bincount(parent[~real.to_numpy(zero_copy_only=False)], minlength=len(texts))


def _joined(lines: pa.Array, parent: np.ndarray, chosen: np.ndarray, n: int) -> pa.Array:
    """The chosen lines of each text as one string."""
    ends = np.concatenate([[0], np.cumsum(np.bincount(parent[chosen], minlength=n))])
    lists = pa.LargeListArray.from_arrays(pa.array(ends, pa.int64()), lines.filter(pa.array(chosen)))
    return pc.binary_join(lists, pa.array([""], lines.type)[0])


def transformed(texts: pa.Array, h: list[np.ndarray], rate: int = RATE, suffix_first: int = SUFFIX_FIRST) -> dict[str, pa.Array]:
    """n, form, prefix, middle, suffix (null if plain) and output of a batch of texts; ``h`` are the four draws of each."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    lines, parent, n = _lines(texts)
    first = np.cumsum(n) - n
    ordinal = np.arange(len(lines)) - first[parent]
    cuts = np.sort(np.stack([h[0] % (n + 1), h[1] % (n + 1)]), axis=0)
    role = (ordinal >= cuts[0][parent]).astype(np.int8) + (ordinal >= cuts[1][parent])
    prefix, middle, suffix = (_joined(lines, parent, role == r, len(texts)) for r in range(3))

    marked = [pc.match_substring(texts, mark) for mark in (PREFIX, SUFFIX, MIDDLE)]
    plain = pc.or_(pc.or_(pc.or_(*marked[:2]), marked[2]), pc.or_(pc.equal(pc.binary_length(texts), 0), pa.array(h[2] % 100 >= rate)))
    spm = pa.array(h[3] % 100 < suffix_first)
    mark = {m: pa.array([m], pa.large_string())[0] for m in (PREFIX, SUFFIX, MIDDLE, "")}
    join = lambda *parts: pc.binary_join_element_wise(*parts, mark[""])
    psm_text = join(mark[PREFIX], prefix, mark[SUFFIX], suffix, mark[MIDDLE], middle)
    spm_text = join(mark[SUFFIX], suffix, mark[PREFIX], prefix, mark[MIDDLE], middle)
    none = pa.scalar(None, pa.large_string())
    return {
        "n": pa.array(n, pa.int64()),
        "form": pc.if_else(plain, "plain", pc.if_else(spm, "spm", "psm")),
        "prefix": pc.if_else(plain, none, prefix), "middle": pc.if_else(plain, none, middle), "suffix": pc.if_else(plain, none, suffix),
        "output": pc.if_else(plain, texts, pc.if_else(spm, spm_text, psm_text)),
    }


def _slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """(first row, rows) of about ``SLICE`` bytes, one row at least."""
    upto = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    first = 0
    while first < len(texts):
        before = upto[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(upto, before + SLICE, side="right")))
        yield first, last - first
        first = last


def examples(
    docs: DataFrame, rate: int = RATE, suffix_first: int = SUFFIX_FIRST, seed: int = SEED, keep: tuple[str, ...] = ()
) -> DataFrame:
    """doc_id, ``keep``, n (lines), form, prefix, middle, suffix, output; one row per document."""
    names = list(dict.fromkeys(["doc_id", *keep]))
    given = docs.select(*[F.col(f"`{c}`") for c in names], F.col("text").alias("_text"), *[h.alias(f"_h{i}") for i, h in enumerate(draws(F.col("doc_id"), seed))])
    out = extended(given, names, "n bigint, form string, prefix string, middle string, suffix string, output string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(out)
        for batch in batches:
            column = lambda rows, name: rows.column(rows.schema.get_field_index(name))
            for first, count in _slices(column(batch, "_text")):
                rows = batch.slice(first, count)
                h = [column(rows, f"_h{i}").to_numpy(zero_copy_only=False) for i in range(4)]
                new = transformed(column(rows, "_text"), h, rate, suffix_first)
                columns = [*(column(rows, c) for c in names), *new.values()]
                yield pa.RecordBatch.from_arrays([c.cast(target.field(i).type) for i, c in enumerate(columns)], schema=target)

    return given.mapInArrow(run, out)


def restored(output: Column, form: Column) -> Column:
    """The text that an example was made from."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    text = lambda *order: F.concat(*[F.get(parts, i) for i in order])
    return F.when(form == "psm", text(1, 3, 2)).when(form == "spm", text(2, 3, 1)).otherwise(output)


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256."""
    return examples(docs).select(
        "doc_id", "n", "form", F.length("prefix").cast("bigint").alias("prefix_chars"), F.length("middle").cast("bigint").alias("middle_chars"),
        F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )
