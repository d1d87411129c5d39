"""Near-duplicate images and videos by the Hamming distance of 64-bit fingerprints.

Equal fingerprints are one row before any join, so a flood of copies costs nothing further. Candidates
come from an exact multi-index join: the 64 bits are cut into fields, and if two fingerprints differ in at most
tau bits, some field i differs in at most r_i bits as soon as the r_i + 1 add up to more than tau. The radius r_i is
split: one side lists its field's neighbours within the larger half of r_i, the other within the smaller half, and
equal values meet in the middle. Few wide fields list more neighbours and meet fewer strangers, so the number of
fields depends on the number of codes.
"""

from __future__ import annotations

from itertools import combinations
from math import comb
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinfold.fixed_values import IMAGE_HASH_THRESHOLD, SAMPLED_FRAMES
from twinfold.functions.bits import field, hamming
from twinfold.operators.skew import BLOCK_ROWS, block_join, largest_of, lookup_join
from twinfold.session import stage

_BITS = 64
_MAX_MASKS = 300_000
_LISTED = 8  # a listed neighbour is moved and sorted; that costs about as much as so many pairs met
_TASK_ROWS = 2_000_000  # neighbours that a task lists
WIDER = 2  # bits above the threshold that the radius of a video's frame may have


class Field(NamedTuple):
    offset: int
    width: int
    radius: int

    def halves(self) -> tuple[int, int]:
        """The radii of the two sides."""
        return self.radius - self.radius // 2, self.radius // 2

    def mask_counts(self) -> tuple[int, int]:
        one, other = (sum(comb(self.width, n) for n in range(r + 1)) for r in self.halves())
        return one, other

    def masks(self, radius: int) -> list[int]:
        """All values of at most ``radius`` bits."""
        return [sum(1 << b for b in bits) for n in range(radius + 1) for bits in combinations(range(self.width), n)]

    def first_meeting(self, bits_a: Column, bits_b: Column, value: Column) -> Column:
        """Whether ``value`` is the one meeting point that counts for two codes: a with the lowest of the bits in
        which they differ, as many as the first side may change, set as in b."""
        differ = self.of(bits_a.bitwiseXOR(bits_b))
        changed = self.of(bits_a).bitwiseXOR(value)
        rest = differ.bitwiseXOR(changed)
        negative = F.coalesce(F.try_subtract(F.lit(0).cast("bigint"), rest), rest)  # the lowest number is its own negative
        from_lowest = rest.bitwiseOR(negative)  # every bit from the lowest one of the rest up
        taken = F.least(F.bit_count(differ), F.lit(self.halves()[0]))
        only_differing = changed.bitwiseAND(differ) == changed
        return only_differing & (F.bit_count(changed) == taken) & (changed.bitwiseAND(from_lowest) == 0)

    def of(self, bits: Column) -> Column:
        return field(bits, self.offset, self.width)


def cut(threshold: int, fields: int) -> list[Field]:
    """64 bits in ``fields`` parts of about the same width and radius; the radii plus one add up to threshold + 1."""
    width, wider = divmod(_BITS, fields)
    share, more = divmod(threshold + 1, fields)
    parts, offset = [], 0
    for i in range(fields):
        w = width + (i < wider)
        parts.append(Field(offset, w, min(share - 1 + (i < more), w)))
        offset += w
    return [p for p in parts if p.radius >= 0]


def best_cut(threshold: int, n_codes: int) -> list[Field]:
    """The cut with the least work: neighbours listed, plus pairs met if codes were spread evenly."""

    def work(parts: list[Field]) -> float:
        counts = [p.mask_counts() for p in parts]
        listed = _LISTED * sum(map(sum, counts))
        met = sum(one * other / 2**p.width for p, (one, other) in zip(parts, counts)) * n_codes
        return (listed + met) if max(map(max, counts)) <= _MAX_MASKS else float("inf")

    return min((cut(threshold, m) for m in range(1, min(threshold + 1, _BITS) + 1)), key=work)


def _neighbours(bits: Column, parts: list[Field], side: int) -> Column:
    def around(i: int, part: Field) -> Column:
        value = part.of(bits)
        masks = F.lit(part.masks(part.halves()[side])).cast("array<bigint>")
        return F.transform(masks, lambda m: F.struct(F.lit(i).alias("field"), value.bitwiseXOR(m).alias("value")))

    return F.concat(*[around(i, p) for i, p in enumerate(parts)])


def code_pairs(
    codes: DataFrame, threshold: int = IMAGE_HASH_THRESHOLD, block_rows: int = BLOCK_ROWS, fields: int | None = None
) -> DataFrame:
    """(bits_a, bits_b, distance): all two different codes within ``threshold``, each pair once.

    ``codes`` has distinct ``bits`` and is read several times, so it should be staged. A pair that meets in
    several fields, or at several values of one, is kept at the first of them only, which the two codes alone decide,
    so nothing has to be de-duplicated by a shuffle.
    """
    n_codes = codes.count()
    parts = cut(threshold, fields) if fields else best_cut(threshold, n_codes)
    listed = n_codes * sum(p.mask_counts()[0] for p in parts)
    tasks = max(codes.sparkSession.sparkContext.defaultParallelism, -(-listed // _TASK_ROWS))
    spread = codes.select("bits").repartition(tasks, "bits")  # a small table becomes many rows
    a = spread.select(F.col("bits").alias("bits_a"), F.inline(_neighbours(F.col("bits"), parts, 0)))
    b = spread.select(F.col("bits").alias("bits_b"), F.inline(_neighbours(F.col("bits"), parts, 1)))
    code_a, code_b = F.col("bits_a"), F.col("bits_b")
    xor = code_a.bitwiseXOR(code_b)
    met_before, first = F.lit(False), F.lit(False)
    for i, part in enumerate(parts):
        near = F.bit_count(part.of(xor)) <= part.radius
        met_before = met_before | ((F.col("field") > i) & near)
        first = first | ((F.col("field") == i) & part.first_meeting(code_a, code_b, F.col("value")))
    wanted = (code_a < code_b) & (F.bit_count(xor) <= threshold) & ~met_before & first
    # a value's neighbours hold at most this many times the codes of the fullest value, and no more than all
    plain = F.array(*[F.struct(F.lit(i).alias("field"), p.of(F.col("bits")).alias("value")) for i, p in enumerate(parts)])
    held = largest_of(codes.select(F.inline(plain)).groupBy("field", "value").agg(F.count(F.lit(1)).alias("n")), "n")
    largest = min(n_codes, held * max(max(p.mask_counts()) for p in parts))
    met = block_join(a, b, ["field", "value"], "bits_a", "bits_b", wanted, block_rows, largest, grown=True)
    return met.select("bits_a", "bits_b", hamming(F.col("bits_a"), F.col("bits_b")).alias("distance"))


def fingerprint_groups(images: DataFrame) -> DataFrame:
    """(bits, id, copies): each fingerprint with its lowest id and the number of images that have it."""
    return images.where("bits IS NOT NULL").groupBy("bits").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies"))


def hamming_pairs(images: DataFrame, threshold: int = IMAGE_HASH_THRESHOLD, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(id_a, id_b, distance, copies_a, copies_b): similar fingerprints, each group of equal ones named by
    its lowest id."""
    groups = stage(fingerprint_groups(images), "fingerprint-groups")
    pairs = code_pairs(groups.select("bits"), threshold, block_rows)
    for s in ("a", "b"):
        named = groups.select(F.col("bits").alias(f"bits_{s}"), F.col("id").alias(f"id_{s}"), F.col("copies").alias(f"copies_{s}"))
        pairs = pairs.join(named, f"bits_{s}")
    a_first = F.col("id_a") < F.col("id_b")
    low = lambda c: F.when(a_first, F.col(f"{c}_a")).otherwise(F.col(f"{c}_b"))
    high = lambda c: F.when(a_first, F.col(f"{c}_b")).otherwise(F.col(f"{c}_a"))
    return pairs.select(
        low("id").alias("id_a"), high("id").alias("id_b"), F.col("distance").cast("bigint").alias("distance"),
        low("copies").alias("copies_a"), high("copies").alias("copies_b"),
    )


# ---- videos ------------------------------------------------------------------------------------


def video_fingerprints(frames: DataFrame, n_frames: int = SAMPLED_FRAMES) -> DataFrame:
    """(video_id, fingerprint): fingerprints of evenly spaced frames, in order.

    ``frames`` is (video_id, frame_no, bits) with bits null for a frame that cannot be read; such frames are
    left out. A clip shorter than ``n_frames`` repeats its last frame. Only the sampled frame numbers, at most
    ``n_frames`` per video, are joined with the frames.
    """
    length = frames.groupBy("video_id").agg((F.max("frame_no") + 1).alias("total"))
    step = F.greatest(F.lit(1).cast("bigint"), F.floor(F.col("total") / n_frames))
    index = F.posexplode(
        F.transform(F.sequence(F.lit(0), F.lit(n_frames - 1)), lambda i: F.least(i * step, F.col("total") - 1))
    )
    wanted = length.select("video_id", index.alias("pos", "frame_no"))
    readable = frames.where("bits IS NOT NULL").select("video_id", "frame_no", "bits")
    ordered = F.array_sort(F.collect_list(F.struct("pos", "bits")))
    return wanted.join(readable, ["video_id", "frame_no"]).groupBy("video_id").agg(ordered["bits"].alias("fingerprint"))


def _places(groups: DataFrame) -> DataFrame:
    """The frames of each group's list, with their places and the length of the list."""
    return groups.select("*", F.size("fingerprint").alias("length"), F.posexplode("fingerprint").alias("pos", "bits"))


def _near_codes(codes: DataFrame, widest: int, block_rows: int) -> DataFrame:
    """(bits_a, bits_b, distance) in both directions, each code beside itself too."""
    pairs = code_pairs(codes, widest, block_rows).select("bits_a", "bits_b", "distance")
    itself = codes.select("bits", "bits", F.lit(0))
    return pairs.union(pairs.select("bits_b", "bits_a", "distance")).union(itself).toDF("bits_a", "bits_b", "distance")


def lookup_plans(groups: DataFrame, near: DataFrame, threshold: int, widest: int) -> DataFrame:
    """(video, copies, length, n, list, plan): the places under which a video looks for others, and their radii.

    One row per video and ``n``, the frames it shares with its partners: those have exactly ``n``, the video at least as
    many. If the radii of some places, each plus one, add up to more than threshold * n, one of these places is within its radius in every
    pair wanted; so a frame that nearly all videos have can be left out if the others look a little farther. Of the choices with
    radii up to ``widest`` a video takes the one that meets the fewest videos: its rarest frames.
    """
    places = _places(groups)
    lengths = groups.agg(F.sort_array(F.collect_set(F.size("fingerprint")))).first()[0]  # no more than the longest list has frames
    shared = F.explode(F.filter(F.lit(lengths).cast("array<int>"), lambda n: n <= F.col("length"))).alias("n")
    mine = places.select("video", "copies", "length", "pos", "bits", shared).where("pos < n")
    mine = stage(mine.withColumn("place", F.struct("n", "pos", "bits")), "video-places")

    radii = range(threshold - 1, widest + 1)
    held = places.groupBy("length", "pos", "bits").agg(F.count(F.lit(1)).alias("held")).withColumnRenamed("bits", "bits_b")
    within = lambda r: F.sum(F.when(F.col("distance") <= r, F.col("held")).otherwise(0))
    met = near.join(held, "bits_b").groupBy("bits_a", "length", "pos").agg(F.array(*[within(r) for r in radii]).alias("met"))
    met = met.select(F.struct(F.col("length").alias("n"), "pos", F.col("bits_a").alias("bits")).alias("place"), "met")
    probing = mine.groupBy("place").agg(F.count(F.lit(1)).alias("probing"))
    costs = stage(probing.join(met, "place", "left"), "place-costs")  # a place no video of that length is near to meets none
    nobody = F.array(*[F.lit(0).cast("bigint") for _ in radii])
    costs = costs.withColumn("met", F.coalesce("met", nobody))
    known = lookup_join(mine, costs, "place", "probing", "video", largest_of(costs, "probing"))

    frame = F.struct(F.element_at("met", -1).alias("most"), "pos", "bits", "met")
    lists = known.groupBy("video", "n").agg(
        F.any_value("copies").alias("copies"), F.any_value("length").alias("length"), F.array_sort(F.collect_list(frame)).alias("frames")
    )
    need = F.lit(threshold) * F.col("n") + 1

    def radius(used: Column, i: Column) -> Column:
        each = F.floor(need / used)
        return (each - 1 + (i < need - each * used).cast("int")).cast("int")

    def choice(used: Column) -> Column:
        at = lambda f, i: F.element_at(f["met"], radius(used, i) - threshold + 2)
        total = F.aggregate(F.transform(F.slice("frames", 1, used), at), F.lit(0).cast("bigint"), lambda acc, x: acc + x)
        return F.struct(total.alias("met"), used.alias("used"))

    fewest = F.ceil(need / (widest + 1)).cast("int")
    best = F.array_min(F.transform(F.sequence(fewest, F.col("n")), choice))["used"]
    chosen = lists.withColumn("used", best)
    plan = F.transform(
        F.slice("frames", 1, F.col("used")),
        lambda f, i: F.struct(f["pos"].alias("pos"), f["bits"].alias("bits"), radius(F.col("used"), i).alias("radius")),
    )
    in_order = F.transform(F.array_sort(F.transform("frames", lambda f: F.struct(f["pos"], f["bits"]))), lambda f: f["bits"])
    return chosen.select(
        "video", "copies", "length", "n", in_order.alias("list"), F.filter(plan, lambda f: f["radius"] >= 0).alias("plan")
    )


def video_pairs(
    fingerprints: DataFrame, threshold: int = IMAGE_HASH_THRESHOLD, block_rows: int = BLOCK_ROWS, wider: int = WIDER
) -> DataFrame:
    """(video_a, video_b, frames, mean_distance, copies_a, copies_b): videos whose frames differ by at most
    ``threshold`` bits on average, up to the end of the shorter list.

    Videos are looked up under their rarest frames (``lookup_plans``), with radii up to ``wider`` bits above the threshold: of ten frames,
    two that all videos share are no probe. The short fingerprint lists travel along, so the join itself decides, at
    the first place of the plan that is within its radius, and passes on nothing but results. Videos with one and the same list are one
    group, named by its lowest id.
    """
    groups = stage(
        fingerprints.where(F.size("fingerprint") > 0).groupBy("fingerprint")
        .agg(F.min("video_id").alias("video"), F.count(F.lit(1)).alias("copies")),
        "video-groups",
    )
    widest = threshold + wider
    codes = stage(_places(groups).select("bits").distinct(), "video-codes")
    near = stage(_near_codes(codes, widest, block_rows), "near-codes")
    plans = stage(lookup_plans(groups, near, threshold, widest), "video-plans")
    probes = plans.select(
        F.col("video").alias("video_p"), F.col("copies").alias("copies_p"), "length", "n", "list", "plan", F.inline("plan")
    ).withColumnRenamed("bits", "bits_a")
    probing = largest_of(probes.groupBy("bits_a").agg(F.count(F.lit(1)).alias("rows")), "rows")
    around = largest_of(near.groupBy("bits_a").agg(F.count(F.lit(1)).alias("rows")), "rows")
    wide = block_join(
        probes, near, ["bits_a"], "video_p", "bits_b", F.col("distance") <= F.col("radius"), block_rows, max(probing, around)
    )
    wide = stage(wide.drop("bits_a", "radius", "distance"), "video-probes")
    found = _places(groups).select(
        F.col("length").alias("n"), "pos", F.col("bits").alias("bits_b"),
        F.col("video").alias("video_q"), F.col("copies").alias("copies_q"), F.col("fingerprint").alias("other"),
    )
    keys = ["n", "pos", "bits_b"]
    rows = [largest_of(side.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")), "rows") for side in (wide, found)]
    distances = F.zip_with("list", "other", lambda x, y: hamming(x, y).cast("bigint"))
    total = F.aggregate(distances, F.lit(0).cast("bigint"), lambda acc, x: acc + x)
    is_near = F.transform("plan", lambda f: F.element_at(distances, f["pos"] + 1) <= f["radius"])
    first = F.get(F.col("plan"), (F.array_position(is_near, True) - 1).cast("int"))["pos"]
    once = (F.col("n") < F.col("length")) | (F.col("video_p") < F.col("video_q"))  # videos of one length look for each other
    wanted = once & (total <= F.lit(threshold) * F.col("n")) & (first == F.col("pos"))
    met = block_join(wide, found, keys, "video_p", "video_q", wanted, block_rows, max(rows))
    p_first = F.col("video_p") < F.col("video_q")
    low = lambda c: F.when(p_first, F.col(f"{c}_p")).otherwise(F.col(f"{c}_q"))
    high = lambda c: F.when(p_first, F.col(f"{c}_q")).otherwise(F.col(f"{c}_p"))
    return met.select(
        low("video").alias("video_a"), high("video").alias("video_b"), F.col("n").cast("bigint").alias("frames"),
        F.round(total / F.col("n"), 6).alias("mean_distance"), low("copies").alias("copies_a"), high("copies").alias("copies_b"),
    )
