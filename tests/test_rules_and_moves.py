from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from conftest import day, rows, sha
from shelfmark.operators import groups, moves, rules
from shelfmark.operators.prefixes import with_prefix

REQUEST = "category_type string, category string, sub_category string, path string, is_begins boolean, description string"


def test_rules_match_text_prefixes_and_the_lowest_id_wins(make):
    cards = make.cards(
        {"f_name": "1", "f_parent": "home/user/", "sha256": "A"},
        {"f_name": "2", "f_parent": "home/user2/x/", "sha256": "B"},
        {"f_name": "3", "f_parent": "other/", "sha256": "C"},
        {"f_name": "4", "f_parent": "home/user/", "sha256": None},
        {"f_name": "5", "f_parent": "home/user/", "sha256": "D"},
        {"f_name": "1", "f_parent": "other/", "sha256": "A"},
    )
    table = make.rules(
        {"id": 5, "f_path": ["home/"]}, {"id": 2, "f_path": ["home/user", "nowhere/"], "is_begins": False},
        {"id": 9, "f_path": ["other/"]},
    )
    known = make.categories((7, "D", "5"))
    result = rules.apply_rules(cards, table, known)
    assert rows(result) == [(2, "A", "1"), (2, "B", "2"), (7, "D", "5"), (9, "C", "3")]
    assert rows(rules.apply_rules(cards, table, result)) == rows(result)


def test_an_empty_rule_path_matches_everything(make):
    cards = make.cards({"f_name": "1", "f_parent": "", "sha256": "A"}, {"f_name": "2", "f_parent": "x/", "sha256": "B"})
    result = rules.apply_rules(cards, make.rules({"id": 1, "f_path": [""]}), make.categories())
    assert rows(result) == [(1, "A", "1"), (1, "B", "2")]
    assert rules.apply_rules(cards, make.rules(), make.categories()).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_prefix_join_equals_starts_with(spark, make, seed):
    import random

    pick = random.Random(seed)
    words = ["".join(pick.choice("ab/") for _ in range(pick.randint(0, 6))) for _ in range(60)]
    values = make.table([(w,) for w in set(words)], "v string")
    prefixes = make.table([(w[: pick.randint(0, 4)],) for w in words[:15]], "p string").distinct()
    expected = {(v, p) for (v,) in values.collect() for (p,) in prefixes.collect() if v.startswith(p)}
    assert set(map(tuple, with_prefix(values, "v", prefixes, "p").select("v", "p").collect())) == expected


def test_upsert_rules(make):
    table = make.rules({"id": 4, "sub_category": "Old", "f_path": ["p1"], "is_begins": False, "description": "keep"})
    requests = make.table(
        [("T", "C", "Old", "p2", True, "drop"), ("T", "C", "Old", "p1", True, ""), ("N", "C", "S", "q2", False, ""),
         ("N", "C", "S", "q1", True, "text"), ("", "C", "S", "q", True, ""), ("T", None, "S", "q", True, ""),
         ("T", "C", "", "q", True, ""), ("Z", "C", "S", "z", False, "")],
        REQUEST,
    )
    found = {(r.category_type, r.sub_category): r for r in rules.upsert_rules(table, requests).collect()}
    assert set(found) == {("T", "Old"), ("N", "S"), ("Z", "S")}
    old, new = found["T", "Old"], found["N", "S"]
    assert (old.id, old.f_path, old.is_begins, old.description) == (4, ["p1", "p2"], False, "keep")
    assert (new.f_path, new.is_begins, new.description) == (["q1", "q2"], True, "text")
    assert found["Z", "S"].description is None and {new.id, found["Z", "S"].id} == {5, 6}


def test_move_jobs(make):
    jobs = make.jobs((3, "d1", "a/", "b/"))
    requests = make.table(
        [("d1", "a/", "c/"), ("d1", "x/", "y/"), ("d2", "a/", "z/"), ("d1", "q/", "")],
        "device_uid string, path_from string, path_to string",
    )
    result = moves.create_move_jobs(jobs, requests)
    assert rows(result, "device_uid", "path_from", "path_to") == [("d1", "a/", "b/"), ("d1", "x/", "y/"), ("d2", "a/", "z/")]
    assert {r.id for r in result.collect()} == {3, 4, 5}
    assert rows(moves.rejected_move_jobs(jobs, requests)) == [("d1", "a/", "c/"), ("d1", "q/", "")]
    assert rows(moves.delete_move_job(result, "d1", "a/"), "path_from") == [("a/",), ("x/",)]


def test_plan_moves(make):
    jobs = make.jobs(
        (1, "d1", "a/", "t/"), (2, "d1", "b/", "t/"), (3, "d1", "c/", "u/"), (4, "d2", "a/", "t/"), (5, "d3", "a/", "a/")
    )
    cards = make.cards(
        {"f_parent": "a/", "f_name": "x", "sha256": "X"}, {"f_parent": "b/", "f_name": "x"}, {"f_parent": "b/", "f_name": "y"},
        {"f_parent": "b/", "f_name": "z"}, {"f_parent": "t/", "f_name": "z"}, {"f_parent": "c/", "f_name": "c"},
        {"f_parent": "a/", "f_name": "x", "device_uid": "d2"}, {"f_parent": "a/", "f_name": "x", "device_uid": "d3"},
    )
    plan = moves.plan_moves(jobs, cards)
    # z exists at the target, the second x meets the first, job 3 is beyond two jobs, d3 moves onto itself
    assert rows(plan, "job_id", "f_parent", "f_name", "new_id") == [
        (1, "a/", "x", sha("d1t/x")), (2, "b/", "y", sha("d1t/y")), (4, "a/", "x", sha("d2t/x")),
    ]
    after = moves.apply_moves(cards, plan)
    assert after.columns == cards.columns and after.count() == cards.count()
    assert rows(after.filter("f_parent = 't/' AND device_uid = 'd1'"), "f_name", "sha256") == [("x", "X"), ("y", None), ("z", None)]
    here = make.table([("d2",)], "uuid string")
    assert rows(moves.plan_moves(jobs, cards, here), "job_id") == [(4,)]
    assert rows(moves.plan_moves(jobs, cards, max_jobs=3, max_files=1), "job_id", "f_name").count((2, "y")) <= 1
    now = dt.datetime(2024, 6, 15)
    closed = moves.close_jobs(jobs.withColumn("done", F.when(F.col("id") == 4, F.lit(day(9)).cast("timestamp_ntz"))), after, F.lit(now))
    assert rows(closed, "id", "done") == [(1, now), (2, None), (3, None), (4, day(9)), (5, None)]


def test_top_n_of_a_hot_group(spark):
    data = spark.range(20000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("k"),
        F.xxhash64("id").alias("v"), "id",
    )
    got = groups.top_n(data, ["k"], [F.col("v"), F.col("id")], 5, spread="id", slices=8)
    best: dict = {}
    for row in data.collect():
        best.setdefault(row.k, []).append((row.v, row.id))
    expected = sorted((k, *pair) for k, pairs in best.items() for pair in sorted(pairs)[:5])
    assert rows(got, "k", "v", "id") == sorted(expected, key=lambda r: tuple((v is not None, str(v)) for v in r))


def test_numbered_is_dense(spark):
    data = spark.range(500).select(F.col("id").cast("string").alias("k"))
    got = groups.numbered(data, ["k"], F.lit(10), spark.range(1).schema["id"].dataType)
    found = got.collect()
    assert sorted(r.id for r in found) == list(range(11, 511))
    assert [r.k for r in sorted(found, key=lambda r: r.id)] == sorted((r.k for r in found), key=lambda k: sha(k))


def test_joined_text_spreads_a_large_group(spark):
    data = spark.range(300).select(F.lit("g").alias("g"), F.concat(F.lit("v"), F.col("id") % 100).alias("v"))
    one = groups.joined_text(data, ["g"], "v", "t").collect()
    assert len(one) == 1 and one[0].part == 0 and one[0].t.split(", ") == sorted(f"v{i}" for i in range(100))
    many = groups.joined_text(data, ["g"], "v", "t", per_row=7).collect()
    assert len(many) > 5 and len({r.part for r in many}) == len(many)
    assert sorted(v for r in many for v in r.t.split(", ")) == sorted(f"v{i}" for i in range(100))


def test_deep_page_equals_shallow_page(spark):
    data = spark.range(1000).select(F.xxhash64("id").alias("v"), "id")
    order = [F.col("v").asc_nulls_last(), F.col("id").asc_nulls_last()]
    for start, length in ((0, 10), (990, 50), (437, 100), (2000, 5)):
        near = rows(groups.page(data, order, start, length))
        assert rows(groups.page(data, order, start, length, in_one_task=1)) == near
        assert len(near) == max(0, min(length, 1000 - start))


def test_repeated(make):
    data = make.table([("a", 5), ("b", 0), ("c", -1), ("d", 1)], "k string, n bigint")
    assert rows(groups.repeated(data, "n", piece=2)) == [("a",)] * 5 + [("d",)]


def test_every_request_is_a_job_or_rejected(make):
    jobs = make.jobs((1, "d1", "a/", "b/"))
    asked = make.table(
        [("d1", "a/", "x/"), ("d1", "c/", "y/"), ("d1", "c/", "x/"), ("d1", "c/", ""), ("d1", "e/", None), ("d1", "c/", "x/")],
        "device_uid string, path_from string, path_to string",
    )
    added = rows(moves.create_move_jobs(jobs, asked).filter("id > 1"), "path_from", "path_to")
    rejected = rows(moves.rejected_move_jobs(jobs, asked), "path_from", "path_to")
    assert added == [("c/", "x/")]
    assert rejected == [("a/", "x/"), ("c/", ""), ("c/", "y/"), ("e/", None)]
