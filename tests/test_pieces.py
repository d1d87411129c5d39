"""Files as rows of pieces."""

import io
import random

from pyspark.sql import functions as F

from twinfold.operators.text_similarity import idf_weights, term_frequency
from twinfold.sources.files import scan_folder, scan_observations
from twinfold.sources.pieces import file_pieces, read_piece, text_pieces


def test_pieces_make_up_the_file():
    rng = random.Random(4)
    for size in (1, 2, 7, 50):
        for _ in range(40):
            data = bytes(rng.choice(b"ab\xc3\xa9 \n") for _ in range(rng.randint(0, 120)))
            pieces = [read_piece(io.BytesIO(data), k, size) for k in range(-(-len(data) // size))]
            assert b"".join(pieces) == data
            assert all(p[-1:] in (b" ", b"\n") for p in [p for p in pieces if p][:-1])


def _texts():
    rng = random.Random(5)
    words = ["alpha", "Beta", "the", "caf\u00e9", "\u4e2d\u6587\u8bcd", "x", "\u03a3\u039f\u03a6\u039f\u03a3", "it's", "one.two", "\U0001f600"]
    text = lambda n: "".join(rng.choice(words) + rng.choice([" ", "\r\n", "\n", "  ", "\t", ", "]) for _ in range(n)).encode()
    return {
        "long.txt": text(4000), "bad.md": text(300).replace(b"Beta", b"Be\xffta \xe4\xb8"), "run.txt": b"y" * 5000 + b" end " + b"z" * 1023 + b" w2",
        "empty.txt": b"", "blank.csv": b" \n" * 900, "other.bin": text(500), "short.txt": b"alpha beta",
    }


def test_counts_of_pieces_are_those_of_whole_texts(spark, tmp_path):
    for name, data in _texts().items():
        (tmp_path / name).write_bytes(data)
    whole = scan_observations(spark, str(tmp_path), "ann").where("extracted_text IS NOT NULL")
    want_tf = term_frequency(whole.select(F.col("file_name").alias("id"), "extracted_text"))
    pieces = text_pieces(scan_folder(spark, str(tmp_path)), 1024)
    assert pieces.groupBy("id").count().where("count > 10").count() >= 1
    found_tf = term_frequency(pieces.withColumn("id", F.substring_index("id", "/", -1)))
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(found_tf) == rows(want_tf) and found_tf.count() > 10
    n = F.lit(whole.count())
    assert rows(idf_weights(found_tf, n)) == rows(idf_weights(want_tf, n))


def test_pieces_of_files_that_are_gone(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"some words here")
    (tmp_path / "b.txt").write_bytes(b"other words")
    files = spark.createDataFrame(
        [(str(tmp_path / "a.txt"), 15), (str(tmp_path / "b.txt"), 11), (str(tmp_path / "gone.txt"), 30)], "path string, length bigint"
    )
    found = file_pieces(files, 6).collect()
    for name, want in (("a.txt", b"some words here"), ("b.txt", b"other words")):
        parts = sorted((r.piece, bytes(r.content)) for r in found if r.path.endswith(name))
        assert b"".join(p for _, p in parts) == want
    assert not [r for r in found if "gone" in r.path]
    assert file_pieces(files.limit(0)).collect() == []
