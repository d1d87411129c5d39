"""Exact duplicates and the registry, on small inputs with one digest holding a third of the rows."""

import datetime as dt
import random
import re
from collections import Counter

import pytest

from twinfold.operators import exact as ex
from twinfold.operators import registry as rg

COLUMNS = (
    "id long, file_hash string, file_name string, file_path string, file_type string, file_size long, "
    "extracted_text string, downloaded_by string, download_time timestamp_ntz"
)
USERS = ["ann", "Anna", "bob", "carl", None]


def _sightings(spark, n=60, seed=1, start=0):
    rng = random.Random(seed)
    rows = []
    for i in range(start, start + n):
        h = "hot" if rng.random() < 0.34 else f"h{rng.randrange(15)}"
        time = dt.datetime(2024, 1, 1) + dt.timedelta(minutes=rng.randrange(50))
        rows.append((i, h, f"f{i}.txt", f"/p/f{i}.txt", "txt", 10 + i, None, rng.choice(USERS), time))
    return spark.createDataFrame(rows, COLUMNS), rows


def _by_hash(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    return groups


def test_alerts_of_one_batch(spark):
    df, rows = _sightings(spark)
    firsts = {h: min(g, key=lambda r: (r[8], r[0])) for h, g in _by_hash(rows).items()}
    found = ex.exact_dup_alerts(df).collect()
    assert {(r.new_id, r.original_id) for r in found} == {(r[0], firsts[r[1]][0]) for r in rows if firsts[r[1]][0] != r[0]}
    assert all(r.similarity == 1.0 and r.duplicate_type == "exact" for r in found)
    assert {r.original_user for r in found} <= {"ann", "Anna", "bob", "carl", ""}


def test_insert_is_idempotent(spark):
    first, rows = _sightings(spark)
    empty = first.where("false")
    kept = rg.insert_new(first, empty).where("accepted").drop("accepted")
    assert kept.count() == len(_by_hash(rows))
    assert rg.insert_new(first, kept).where("accepted").count() == 0
    more, more_rows = _sightings(spark, 30, 2, 100)
    accepted = {r.file_hash for r in rg.insert_new(more, kept).where("accepted").collect()}
    assert accepted == set(_by_hash(more_rows)) - set(_by_hash(rows))
    assert ex.exact_dup_alerts(more, kept).count() == 30 - len(accepted)


def test_alert_against_the_registry_names_its_row(spark):
    first, _ = _sightings(spark)
    kept = rg.first_sightings(first)
    more, _ = _sightings(spark, 30, 2, 100)
    known = {r.file_hash: r.id for r in kept.collect()}
    by_id = {r.id: r.file_hash for r in more.collect()}
    for r in ex.exact_dup_alerts(more, kept).collect():
        assert r.original_id == known.get(by_id[r.new_id], r.original_id)


def _like(name, text):
    return re.search("".join({"%": ".*", "_": "."}.get(c, re.escape(c)) for c in text.lower()), name.lower()) is not None


def _pairs(rows, users):
    """All pairs of copies held by different users, by nested loops."""

    def wanted(a, b):
        if len(users) == 2:
            return (_like(a, users[0]) and _like(b, users[1])) or (_like(a, users[1]) and _like(b, users[0]))
        return not users or _like(a, users[0]) or _like(b, users[0])

    return [
        (h, a, b) for h, g in _by_hash(rows).items() for a in g for b in g
        if a[0] < b[0] and a[7] and b[7] and a[7] != b[7] and wanted(a[7], b[7])
    ]


USER_CASES = [(), ("ann",), ("NA",), ("ann", "bob"), ("ann", "ann"), ("an_", "%a"), ("nobody",), ("ann", "nobody")]


@pytest.mark.parametrize("users", USER_CASES)
def test_cross_user_members(spark, users):
    """Every file that is in a pair, once, and what it says of its digest."""
    df, rows = _sightings(spark, 80, 4)
    found = ex.cross_user_members(df, *users).collect()
    want = {r[0] for _, a, b in _pairs(rows, users) for r in (a, b)}
    assert sorted(r.id for r in found) == sorted(want)
    for r in found:
        group = [x for x in _by_hash(rows)[r.file_hash] if x[7]]
        assert r.users == len({x[7] for x in group})
        assert r.copies_by_others == sum(x[7] != r.downloaded_by for x in group)
        assert r.first_id == min((x[8], x[0]) for x in group)[1]


def test_every_copy_of_one_user_before_another(spark):
    """Two copies by one user before one by another: all three are in a pair."""
    time = dt.datetime(2024, 1, 1)
    rows = [(i, "h", f"f{i}", "/p", "txt", 1, None, user, time) for i, user in ((1, "u1"), (2, "u1"), (3, "u2"))]
    found = ex.cross_user_members(spark.createDataFrame(rows, COLUMNS)).collect()
    assert {(r.id, r.copies_by_others) for r in found} == {(1, 1), (2, 1), (3, 2)}


@pytest.mark.parametrize("users", USER_CASES)
def test_cross_user_totals_count_every_pair(spark, users):
    df, rows = _sightings(spark, 80, 4)
    want = Counter(h for h, _, _ in _pairs(rows, users))
    assert {r.file_hash: r.pairs for r in ex.cross_user_totals(df, *users).collect()} == want


def test_groups_and_report(spark):
    df, rows = _sightings(spark)
    groups = {h: g for h, g in _by_hash(rows).items() if len(g) > 1}
    found = {r.file_hash: r for r in ex.duplicate_groups(df).collect()}
    assert {h: r.files for h, r in found.items()} == {h: len(g) for h, g in groups.items()}
    assert {h: r.users for h, r in found.items()} == {h: len({x[7] for x in g} - {None}) for h, g in groups.items()}
    report = ex.duplicate_report(df).first()
    assert report.total_duplicates == sum(len(g) - 1 for g in groups.values())
    assert ex.duplicate_report(df.where("false")).first().duplicate_groups == 0


def test_find_by_hash(spark):
    df, _ = _sightings(spark)
    kept = rg.first_sightings(df)
    assert ex.find_by_hash(kept, "hot").count() == 1
    assert ex.find_by_hash(kept, "none").count() == 0
