"""Reading the given tables, and texts as UTF-8 bytes inside Arrow batches.

Bytes are enough for every tokenisation used here: ``bytes.split()`` cuts at exactly the six ASCII white-space
characters, ``bytes.lower()`` changes A-Z alone, and bytes above 0x7F stand for the characters above 0x7F.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from twinfold.sources.tables import read_table

#: A row of more than this share of the characters that a sample may hold is taken last.
LONG_SHARE = 1 / 64

#: A run of characters that are not ASCII white space, as a Java regular expression.
WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, f"{sf_dir}/documents.parquet", "doc_id")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def text_bytes(batch: pa.RecordBatch, name: str) -> list[bytes | None]:
    """The strings of a column as UTF-8 bytes, without decoding them."""
    column = batch.column(batch.schema.get_field_index(name))
    wide = pa.types.is_large_string(column.type)
    return column.cast(pa.large_binary() if wide else pa.binary()).to_pylist()


def extended(df: DataFrame, names: Iterable[str], added: str) -> StructType:
    """The schema of some columns of ``df``, and ``added`` (DDL) behind them."""
    return StructType([*df.select(*[F.col(f"`{c}`") for c in names]).schema.fields, *StructType.fromDDL(added).fields])


def map_batches(
    df: DataFrame, build: Callable[[pa.RecordBatch], dict[str, Iterable]], schema: str, keep: Iterable[str] = ()
) -> DataFrame:
    """Run ``build`` over the Arrow batches of ``df``; columns in ``keep`` are handed through in front of its own.

    ``build`` returns the new columns of one batch, as many rows as the batch has.
    """
    keep = list(keep)
    added = StructType.fromDDL(schema).fields
    out = StructType([*df.select(*keep).schema.fields, *added])
    names = [f.name for f in added]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(out)
        for batch in batches:
            if batch.num_rows == 0:
                continue
            new = build(batch)
            columns = [batch.column(batch.schema.get_field_index(c)) for c in keep]
            columns = [c.cast(target.field(i).type) for i, c in enumerate(columns)]
            columns += [pa.array(new[n], type=target.field(n).type, from_pandas=True) for n in names]
            yield pa.RecordBatch.from_arrays(columns, schema=target)

    return df.mapInArrow(run, out)


def crc_remainder(column: str, modulus: int) -> Column:
    """crc32 of the value as text, modulo; null counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def labelled_sample(docs: DataFrame, marks: DataFrame, label: str, rows_per_class: int, max_chars: int) -> DataFrame:
    """Labelled documents to learn from: doc_id, text, lang, label; at most 2 * rows_per_class rows and max_chars characters.

    Rows are chosen by a hash of their id, in its order, from all over the table, for label 0 and 1 apart. A doc_id that is labelled
    twice counts once, by its larger label. The bound on both sides makes the choice small enough to broadcast and to collect.

    Each label has half of the rows and characters, and what the other leaves. Rows of more than ``LONG_SHARE`` of ``max_chars`` come last in
    their label, the shortest first, so one that does not fit keeps out none but longer ones.
    """
    from pyspark.sql import Window as W

    from twinfold.session import stage

    spark = docs.sparkSession
    order = F.xxhash64("doc_id", F.lit(label))
    known = marks.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull())
    known = known.groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    totals = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    picked = None
    for value, total in totals.items():
        part = known.where(F.col("label") == value)
        if total > rows_per_class:  # about twice as many as wanted, then the first of them
            part = part.where(F.pmod(order, F.lit(1 << 20)) < int((1 << 20) * min(1.0, 2.0 * rows_per_class / total)))
        part = part.orderBy(order, "doc_id").limit(rows_per_class)
        picked = part if picked is None else picked.unionByName(part)
    if picked is None:
        picked = known.limit(0)
    met = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "lang").join(F.broadcast(picked), "doc_id")
    met = stage(met, f"labelled-{label}")
    size = F.length("text").cast("bigint")
    held = {r["label"]: r for r in met.groupBy("label").agg(F.count(F.lit(1)).alias("rows"), F.sum(size).alias("chars")).collect()}

    def share(of: str, most: int) -> Column:
        left = {value: most - sum(r[of] for other, r in held.items() if other != value) for value in held}
        return F.coalesce(*[F.when(F.col("label") == value, F.lit(max(most // 2, n))) for value, n in left.items()], F.lit(most))

    order = [F.greatest(size, F.lit(int(max_chars * LONG_SHARE))), F.xxhash64("doc_id", "text"), "doc_id"]
    room = W.partitionBy("label").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    sized = met.withColumn("_upto", F.sum(size).over(room)).withColumn("_place", F.row_number().over(room))
    fits = (F.col("_upto") <= share("chars", max_chars)) & (F.col("_place") <= share("rows", 2 * rows_per_class))
    return sized.where(fits).select("doc_id", "text", "lang", "label")
