"""Fingerprints and Hamming joins."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.bmp import picture, write_bmp
from twinfold.functions import bits as bt
from twinfold.operators import media as md
from twinfold.sources.images import image_fingerprints, read_images


def _signed(x):
    return x - (1 << 64) if x >= 1 << 63 else x


def _planted(seed, n):
    """Random codes, with copies of 0 to 14 flipped bits, many of them in one 16-bit field."""
    rng = random.Random(seed)
    codes = []
    for _ in range(n):
        base = rng.getrandbits(64)
        codes.append(base)
        for _ in range(3):
            width = rng.choice([16, 64])
            flips = rng.sample(range(width), rng.randint(0, min(14, width)))
            codes.append(base ^ sum(1 << f for f in flips))
    return codes


@pytest.mark.parametrize("seed,threshold,block", [(1, 10, 20_000), (2, 10, 3), (3, 3, 5), (4, 0, 10), (5, 13, 10)])
def test_pairs_equal_all_pairs(spark, seed, threshold, block):
    codes = _planted(seed, 25)
    images = spark.createDataFrame([(i, _signed(c)) for i, c in enumerate(codes)], "id long, bits long")
    first = {}
    for i, c in enumerate(codes):
        first.setdefault(c, i)
    want = {
        (i, j): (a ^ b).bit_count()
        for a, i in first.items() for b, j in first.items()
        if i < j and (a ^ b).bit_count() <= threshold
    }
    found = md.hamming_pairs(images, threshold, block).collect()
    assert {(r.id_a, r.id_b): r.distance for r in found} == want
    assert len(found) == len(want)


@pytest.mark.parametrize("fields", [2, 3, 4, 6, 11])
def test_any_cut_gives_the_same_pairs(spark, fields):
    threshold = 5 if fields == 2 else 10
    codes = sorted({_signed(c) for c in _planted(7, 12)})
    want = {(a, b) for a in codes for b in codes if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= threshold}
    df = spark.createDataFrame([(c,) for c in codes], "bits long")
    found = md.code_pairs(df, threshold, fields=fields).collect()
    assert {(r.bits_a, r.bits_b) for r in found} == want and len(found) == len(want)


def test_cuts_cover_the_bits_and_the_threshold():
    for threshold in range(30):
        for fields in range(1, threshold + 2):
            parts = md.cut(threshold, fields)
            assert sum(p.width for p in parts) == 64
            assert sum(p.radius + 1 for p in parts) == threshold + 1
    sizes = [len(md.best_cut(10, n)) for n in (10**3, 10**5, 10**7, 10**10)]
    assert sizes == sorted(sizes, reverse=True) and sizes[0] > sizes[-1]


def test_neighbours_are_listed_on_both_sides(spark):
    wide = md.cut(10, 2)
    assert [(p.width, p.radius, p.halves()) for p in wide] == [(32, 5, (3, 2)), (32, 4, (2, 2))]
    assert sum(sum(p.mask_counts()) for p in wide) == 7076  # one side alone would list 284,274
    row = spark.range(1).select(
        F.size(md._neighbours(F.lit(5).cast("bigint"), wide, 0)).alias("a"), F.size(md._neighbours(F.lit(5).cast("bigint"), wide, 1)).alias("b")
    ).first()
    assert row.a + row.b == 7076 and row.b == 2 * 529


@pytest.mark.parametrize("radius", [0, 1, 2, 3])
def test_codes_meet_once_in_the_middle(spark, radius):
    """A field of all 64 bits, so that the sign bit takes part: of all meeting points one is the first."""
    part = md.Field(0, 64, radius)
    one, other = part.halves()
    rows = []
    for bits in [(), (63,), (0, 63), (62, 63), (5, 9, 63), (1, 2, 3), (61, 62, 63)]:
        if len(bits) <= radius:
            b = sum(1 << x for x in bits)
            near = {m for m in part.masks(one)} & {b ^ m for m in part.masks(other)}
            rows += [(_signed(b), _signed(m)) for m in near]
    df = spark.createDataFrame(rows, "b long, m long")
    met = df.where(part.first_meeting(F.lit(0).cast("bigint"), F.col("b"), F.col("m"))).collect()
    assert sorted(r.b for r in met) == sorted({b for b, _ in rows})


def test_hex_and_back(spark):
    values = [0, 1, -1, -(1 << 63), (1 << 63) - 1, 123456789]
    df = spark.createDataFrame([(v,) for v in values], "b long").select("b", bt.to_hex(F.col("b")).alias("h"))
    for r in df.select("b", "h", bt.from_hex(F.col("h")).alias("again")).collect():
        assert r.h == format(r.b & (1 << 64) - 1, "016x") and r.again == r.b


def test_median_bits(spark):
    rng = np.random.default_rng(0)
    vectors = rng.normal(size=(20, 64))
    df = spark.createDataFrame([(v.tolist(),) for v in vectors], "v array<double>").select("v", bt.median_bits(F.col("v")).alias("b"))
    for r in df.collect():
        bits = np.array(r.v) > np.median(r.v)
        assert r.b == int.from_bytes(np.packbits(bits).tobytes(), "big", signed=True)
    short = spark.createDataFrame([([1.0, 2.0],)], "v array<double>").select(bt.median_bits(F.col("v"))).first()[0]
    assert short is None


def _sample(total, unreadable, n):
    step = max(1, total // n)
    return [i for i in (min(k * step, total - 1) for k in range(n)) if i not in unreadable]


def test_video_fingerprints(spark):
    lengths = {0: 1, 1: 7, 2: 10, 3: 25, 4: 104, 5: 3}
    unreadable = {3: {4, 6}, 5: {0, 1, 2}}
    rows = [
        (v, f, None if f in unreadable.get(v, ()) else v * 1000 + f) for v, n in lengths.items() for f in range(n)
    ]
    frames = spark.createDataFrame(rows, "video_id long, frame_no long, bits long")
    found = {r.video_id: r.fingerprint for r in md.video_fingerprints(frames, 10).collect()}
    want = {v: [v * 1000 + f for f in _sample(n, unreadable.get(v, ()), 10)] for v, n in lengths.items()}
    assert found == {v: f for v, f in want.items() if f}


@pytest.mark.parametrize("block,threshold,wider", [(20_000, 10, 2), (3, 10, 2), (20_000, 10, 0), (20_000, 0, 1), (20_000, 4, 3)])
def test_video_pairs_equal_all_pairs(spark, block, threshold, wider):
    """Clips of several lengths, many with one common opening frame."""
    rng = random.Random(9)
    lists = []
    for _ in range(12):
        base = [rng.getrandbits(64) for _ in range(rng.choice([1, 4, 10]))]
        if rng.random() < 0.6:
            base[0] = 0
        for _ in range(3):
            lists.append([c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 16))) if rng.random() < 0.8 else c for c in base])
        lists.append(base[: rng.randint(1, len(base))])
    lists.append(list(lists[0]))
    df = spark.createDataFrame([(i, [_signed(c) for c in f]) for i, f in enumerate(lists)], "video_id long, fingerprint array<long>")
    heads = [i for i, f in enumerate(lists) if f not in lists[:i]]
    want = {}
    for i in heads:
        for j in heads:
            pairs = list(zip(lists[i], lists[j]))
            total = sum((a ^ b).bit_count() for a, b in pairs)
            if i < j and total <= threshold * len(pairs):
                want[i, j] = (len(pairs), round(total / len(pairs), 6))
    found = md.video_pairs(df, threshold, block, wider).collect()
    assert {(r.video_a, r.video_b): (r.frames, r.mean_distance) for r in found} == want
    assert len(found) == len(want) > 0


def test_shared_frames_are_no_probe(spark):
    """All clips open black and two thirds close black: of ten frames, only the other eight are looked up."""
    rng = random.Random(3)
    clips = [[0] + [_signed(rng.getrandbits(64)) for _ in range(8)] + [0 if i % 3 else _signed(rng.getrandbits(64))] for i in range(60)]
    clips += [[c ^ 3 for c in clips[0]], [0, 5], [0]]
    groups = spark.createDataFrame([(i, c, 1) for i, c in enumerate(clips)], "video long, fingerprint array<long>, copies long")
    codes = md._places(groups).select("bits").distinct()
    near = md._near_codes(codes, 12, 20_000)
    plans = md.lookup_plans(groups, near, 10, 12).collect()
    for r in plans:
        if r.n == 10 and r.video < 60:
            assert {f.pos for f in r.plan} <= set(range(1, 10)) and sum(f.radius + 1 for f in r.plan) == 101
            assert r.video % 3 == 0 or 9 not in {f.pos for f in r.plan}
            assert r.list == clips[r.video]
    assert {(r.video, r.n) for r in plans} == {(i, n) for i, c in enumerate(clips) for n in (1, 2, 10) if n <= len(c)}
    found = md.video_pairs(groups.select(F.col("video").alias("video_id"), "fingerprint")).collect()
    assert (0, 60) in {(r.video_a, r.video_b) for r in found}


def test_tables_without_a_picture_or_video(spark):
    assert md.hamming_pairs(spark.createDataFrame([], "id long, bits long")).collect() == []
    empty = spark.createDataFrame([(1, [])], "video_id long, fingerprint array<long>")
    assert md.video_pairs(empty).collect() == []
    assert md.video_pairs(empty.limit(0)).collect() == []


def test_image_fingerprints(spark, tmp_path):
    one = picture(1)
    write_bmp(tmp_path / "one.bmp", one)
    write_bmp(tmp_path / "brighter.bmp", (one + 40).astype(np.uint8))
    write_bmp(tmp_path / "smaller.bmp", np.ascontiguousarray(one[::2, ::2]))
    write_bmp(tmp_path / "other.bmp", picture(2))
    (tmp_path / "broken.bmp").write_bytes(b"BM nothing")
    found = {r.path.rsplit("/", 1)[1]: r.image_phash for r in image_fingerprints(read_images(spark, str(tmp_path))).collect()}
    distance = lambda a, b: ((found[a] ^ found[b]) & (1 << 64) - 1).bit_count()
    assert set(found) == {"one.bmp", "brighter.bmp", "smaller.bmp", "other.bmp"}
    assert distance("one.bmp", "brighter.bmp") <= 4
    assert distance("one.bmp", "smaller.bmp") <= 10
    assert distance("one.bmp", "other.bmp") > 10
