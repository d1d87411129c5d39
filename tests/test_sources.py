"""Folder scan."""

import hashlib
import json
import os

from pyspark.sql import functions as F

from twinfold.operators.exact import exact_dup_alerts
from twinfold.session import stage
from twinfold.sources import files as files_module
from twinfold.sources.files import scan_observations
from twinfold.sources.tables import read_table


def test_scan(spark, tmp_path):
    contents = {"a.txt": b"Hello, World", "b.PDF": b"Hello, World", "c.bin": b"\x00\xff", "d.md": b"caf\xc3\xa9 \xff!"}
    for name, data in contents.items():
        (tmp_path / name).write_bytes(data)
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "e.txt").write_bytes(b"below")
    files = scan_observations(spark, str(tmp_path), "ann")
    found = {r.file_name: r for r in files.collect()}
    assert set(found) == set(contents)
    for name, data in contents.items():
        assert found[name].file_hash == hashlib.sha256(data).hexdigest()
        assert found[name].file_size == len(data)
        assert found[name].file_path == str(tmp_path / name)
    assert found["a.txt"].extracted_text == "hello  world"
    assert found["d.md"].extracted_text == "café  "
    assert found["c.bin"].extracted_text is None
    assert found["b.PDF"].file_type == "pdf"
    assert len({r.id for r in found.values()}) == 4
    assert [r.new_file_name for r in exact_dup_alerts(files).collect()] == ["b.PDF"]
    deep = scan_observations(spark, str(tmp_path), "ann", recursive=True, pattern="*.txt")
    assert {r.file_name for r in deep.collect()} == {"a.txt", "e.txt"}


def test_read_table_spreads_a_single_split(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(100).coalesce(1).write.parquet(path)
    assert spark.read.parquet(path).rdd.getNumPartitions() == 1
    assert read_table(spark, path, "id").rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_read_table_spreads_a_single_row_group(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(2000).selectExpr("id", "sha2(string(id), 512) AS text").coalesce(1).write.parquet(path)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")  # many splits of bytes, all rows in one of them
    try:
        assert spark.read.parquet(path).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
        table = read_table(spark, path, "id")
        held = table.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
        assert sum(held) == 2000 and max(held) < 1000
        assert sorted(r.id for r in table.collect()) == list(range(2000))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_corpus_cleans_texts_once(spark, sf_dir, monkeypatch):
    from twinfold.plans import views

    plans, write = [], views.stage
    monkeypatch.setattr(views, "_corpora", {})
    monkeypatch.setattr(views, "stage", lambda df, label: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or write(df, label))
    assert views.corpus(spark, sf_dir).where("extracted_text IS NULL OR extracted_text = ''").count() == 0
    assert plans[-1].count("lower(") == 1


def test_stage_cuts_the_plan(spark):
    staged = stage(spark.range(10).selectExpr("id", "id * 2 AS twice"), "test")
    assert staged.count() == 10
    assert "Range" not in staged._jdf.queryExecution().optimizedPlan().toString()


def test_large_files_are_hashed_in_pieces(spark, tmp_path, monkeypatch):
    """With a limit of ten bytes most files are large; digests are the same either way, and Spark opens none of the large ones."""
    monkeypatch.setattr(files_module, "PIECE_BYTES", 7)
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", "10")
    try:
        contents = {"a.txt": b"Hello, World " * 9, "b b%20.mp4": b"\x00\xff" * 50, "c.txt": b"small"}
        for name, data in contents.items():
            (tmp_path / name).write_bytes(data)
        rows = files_module.describe_files(files_module.scan_folder(spark, str(tmp_path)), F.lit("ann"), cell_bytes=10).collect()
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")
    assert {r.file_name: (r.file_hash, r.file_size) for r in rows} == {
        n: (hashlib.sha256(d).hexdigest(), len(d)) for n, d in contents.items()
    }
    texts = {r.file_name: r.extracted_text for r in rows}
    assert texts == {"a.txt": "hello  world " * 9, "b b%20.mp4": None, "c.txt": "small"}


def test_text_of_a_file_larger_than_a_cell(spark, tmp_path, monkeypatch):
    """Its first 200,000 characters, whatever bytes they take; the digest is that of the whole file."""
    text = "é日 word " * 60_000
    (tmp_path / "large.txt").write_text(text)
    row = files_module.describe_files(files_module.scan_folder(spark, str(tmp_path)), F.lit("ann"), cell_bytes=1000).first()
    assert row.file_hash == hashlib.sha256(text.encode()).hexdigest()
    assert row.extracted_text == text[:200_000]


def test_empty_and_unreadable_files(spark, tmp_path):
    (tmp_path / "empty.txt").write_bytes(b"")
    (tmp_path / "empty_too.mp4").write_bytes(b"")
    (tmp_path / ".half-written").write_bytes(b"x")
    listed = files_module.scan_folder(spark, str(tmp_path)).collect()
    gone = spark.createDataFrame([(f"{tmp_path}/gone.txt", listed[0].modificationTime, 5)], "path string, modificationTime timestamp, length long")
    rows = files_module.describe_files(files_module.scan_folder(spark, str(tmp_path)).unionByName(gone), F.lit("ann")).collect()
    assert {(r.file_name, r.file_hash, r.file_size, r.extracted_text) for r in rows} == {
        (n, hashlib.sha256(b"").hexdigest(), 0, None) for n in ("empty.txt", "empty_too.mp4")
    }
    read = files_module._read_by_path(gone, 100)
    assert [r.path for r in files_module.unread_files(read).collect()] == [f"{tmp_path}/gone.txt"]
    assert [r.new_file_name for r in exact_dup_alerts(scan_observations(spark, str(tmp_path), "ann")).collect()] != []
    (tmp_path / "none").mkdir()
    assert files_module.scan_folder(spark, str(tmp_path / "none")).collect() == []


def test_a_stream_sees_every_file_once(spark, tmp_path):
    """Files with old times that come late, empty files, a restart, a limit per batch; the log says what was handed out."""
    import os

    folder, seen = tmp_path / "in", []
    folder.mkdir()

    def drop(name, data, time):
        (folder / name).write_bytes(data)
        os.utime(folder / name, (time, time))

    def run(checkpoint, most=0):
        take = lambda rows, batch: seen.append([os.path.basename(r.path) for r in rows.orderBy("modificationTime", "path").collect()])
        stream = files_module.watch_folder(spark, str(folder), f"{checkpoint}/listing", most)
        stream.writeStream.foreachBatch(take).option("checkpointLocation", str(checkpoint)).trigger(availableNow=True).start().awaitTermination()

    drop("b.txt", b"b", 2_000), drop("a.txt", b"", 2_000), drop(".c", b"hidden", 1)
    run(tmp_path / "one")
    assert seen == [["a.txt", "b.txt"]]
    run(tmp_path / "one")
    assert len(seen) == 1
    drop("late.txt", b"late", 1_000), drop("b.txt", b"written again", 3_000)
    run(tmp_path / "one")
    assert seen[1:] == [["late.txt"]]
    for _ in range(3):
        run(tmp_path / "two", 2)
    assert sorted(n for batch in seen[2:] for n in batch) == ["a.txt", "b.txt", "late.txt"]
    entries = [json.loads(p.read_text()) for p in sorted((tmp_path / "two" / "listing").glob("*.json"))]
    assert [[os.path.basename(f[0]) for f in e] for e in entries] == [["late.txt", "a.txt"], ["b.txt"]]


def test_a_large_listing_is_read_by_many_tasks(spark, tmp_path, monkeypatch):
    from twinfold.sources import folder

    for i in range(25):
        (tmp_path / f"{i}.txt").write_text(str(i))
    monkeypatch.setattr(folder, "TASK_FILES", 10)
    parts = folder._FolderReader(folder._Listing({"path": str(tmp_path)})).partitions()
    assert [len(p.files) for p in parts] == [10, 10, 5]
    assert len({f[0] for p in parts for f in p.files}) == 25


def test_a_listing_leaves_no_names_in_the_plan(spark, tmp_path, monkeypatch):
    """Partitions name files that hold the listing; a scan that is planned twice lists twice."""
    import pickle

    from twinfold.sources import folder

    (tmp_path / "in" / "deep").mkdir(parents=True)
    names = [f"file-with-a-long-name-{i}.txt" for i in range(25)]
    for n in names:
        (tmp_path / "in" / n).write_text(n)
    (tmp_path / "in" / "deep" / "other.txt").write_text("x")
    (tmp_path / "in" / "gone.txt").symlink_to(tmp_path / "nowhere")
    monkeypatch.setattr(folder, "TASK_FILES", 10)
    reader = folder._FolderReader(folder._Listing({"path": str(tmp_path / "in"), "spool": str(tmp_path / "spool")}))
    for _ in range(2):
        parts = reader.partitions()
        assert b"file-with-a-long-name" not in pickle.dumps(parts)
        rows = [r for p in parts for r in reader.read(p)]
        assert [len(p.files) for p in parts] == [10, 10, 5]
        assert sorted(os.path.basename(path) for path, _, _ in rows) == sorted(names)
        assert {length for _, _, length in rows} == {len(n) for n in names}
    listed = files_module.scan_folder(spark, str(tmp_path / "in"))
    assert listed.count() == 25
    assert files_module.scan_folder(spark, str(tmp_path / "in"), recursive=True).count() == 26
    assert list(files_module.scan_folder(spark, str(tmp_path / "in"), "*-7.txt").select("length").first()) == [len(names[7])]


def test_local_files_are_handed_out_as_they_are_found(tmp_path, monkeypatch):
    from twinfold.sources import folder

    for i in range(5):
        (tmp_path / f"{i}.txt").write_text(str(i))
    monkeypatch.setattr(folder.fs, "FileSelector", None)  # a list of all files
    found = folder.list_files(str(tmp_path))
    assert next(found)[0].startswith("file:/") and len(list(found)) == 4
