"""File cards shuffled without what follows from other columns, as seldom as can be; shuffles gone once rows are written."""

from __future__ import annotations

import glob
import re

import pytest
from conftest import plan_of, rows, sha
from pyspark.sql import functions as F

from shelfmark.functions.packing import lean, lean_id, packed_hash, whole
from shelfmark.operators import changes, moves, snapshot, stored
from shelfmark.plans import copies
from shelfmark.workload.tables import Catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.fixture
def odd(make):
    """Cards whose values follow from others, do not, and are missing."""
    cards = make.cards(
        {}, {"f_name": "x.JPG", "f_extension": "jpg"}, {"f_name": "y", "f_mime_type_java": None}, {"id": "7"}, {"id": "none"},
        {"id": ""}, {"id": sha("q"), "sha256": sha("c")}, {"f_name_lc": "none"}, {"f_name_lc": ""}, {"sha256": "c"},
        {"f_extension": ""}, {"f_extension": None},
    )
    return cards.withColumns({name: F.when(F.col(name) != "none", F.col(name)) for name in ("id", "f_name_lc")})


def test_lean_rows_come_back_as_they_were(odd):
    assert rows(whole(lean(odd), odd)) == rows(odd)
    assert not {"id", "f_extension", "f_mime_type_java", "f_name_lc"} & set(lean(odd).columns)
    assert lean(odd).filter("_rest IS NULL").count() >= 2
    ids = lean(odd).select(lean_id(odd).alias("id"))
    assert rows(ids) == rows(odd.select(packed_hash(F.col("id")).alias("id")))
    without_id = odd.filter("id IS NULL").withColumn("device_uid", F.lit(None).cast("string"))
    assert rows(whole(lean(without_id), without_id)) == rows(without_id)
    few = odd.select("id", "device_uid", "f_parent", "sha256")
    assert rows(whole(lean(few), few)) == rows(few)


def test_ids_meet_without_being_shuffled(odd, no_broadcast):
    left = changes.delete_rows(odd, odd.filter("sha256 IS NOT NULL").select("id"), ["id"])
    expected = {row.id for row in odd.filter("sha256 IS NOT NULL").collect()}
    assert rows(left) == rows(odd.filter(~F.coalesce(F.col("id").isin(*expected), F.lit(False))))
    assert "hashpartitioning(id" not in plan_of(left)
    found = changes.update_rows(odd, odd.select("id", F.lit(3).cast("bigint").alias("f_size")), ["id"], ["f_size"])
    assert plan_of(found).count("Exchange hashpartitioning") == 2
    assert rows(found, "id", "f_size") == rows(odd.withColumn("f_size", F.when(F.col("id").isNull(), 10).otherwise(3).cast("bigint")), "id", "f_size")


def test_lines_are_shuffled_once(spark, no_broadcast):
    plan = plan_of(Catalogue(spark, SF).file_card)
    assert plan.count("Exchange hashpartitioning") == 2  # lines and parts
    assert plan_of(Catalogue(spark, SF).listing).count("l_shipdate") and "hashpartitioning(l_suppkey" not in plan


def test_a_merge_shuffles_old_rows_by_folder_alone(make, no_broadcast):
    cards = make.cards({"f_name": "a"}, {"f_name": "b", "f_parent": "b/"})
    scope = make.table([("d1", "a/"), (None, "a/"), ("d1", None)], "device_uid string, f_parent string")
    merged = snapshot.merge_snapshot(cards, cards.limit(1), scope)
    merged.collect()
    assert len(re.findall(r"Exchange hashpartitioning\([^\n]*sha2", plan_of(merged))) == 0
    changed = snapshot.scan_changes(cards, cards.limit(0), scope)
    assert rows(changed, "f_name", "change") == [("a", "delete")]
    assert len(re.findall(r"Exchange hashpartitioning\([^\n]*sha2", plan_of(changed))) == 0


def test_a_move_joins_without_shuffling_ids(make, no_broadcast):
    cards = make.cards({"f_name": "a"}, {"f_name": "b"})
    plan = cards.filter("f_name = 'a'").select("id", F.lit("n").alias("new_id"), F.lit("to/").alias("path_to"))
    moved = moves.apply_moves(cards, plan)
    assert rows(moved, "id", "f_parent") == sorted([("n", "to/"), (sha("d1a/b"), "a/")])
    assert "hashpartitioning(id" not in plan_of(moved)


def test_groups_of_contents_are_shuffled_once(make):
    cards = make.cards({"sha256": "A"}, {"sha256": "A", "f_parent": "none"}, {"sha256": "B", "f_name_lc": "none"})
    cards = cards.withColumns({name: F.when(F.col(name) != "none", F.col(name)) for name in ("f_parent", "f_name_lc")})
    found = copies.duplicate_content_overview(cards)
    assert plan_of(found).count("Exchange hashpartitioning") == 1
    assert rows(found) == [("f.jpg", "A", 0, 2, "d1", "a/")]


def test_shuffles_go_with_the_write(make, spark, tmp_path):
    at = spark.conf.get("spark.local.dir", None) or "/tmp"
    before = set(glob.glob(f"{at}/blockmgr-*/*/shuffle_*.data"))
    cards = make.cards(*[{"f_name": str(n), "f_parent": f"{n % 3}/"} for n in range(50)])
    changes.write_file_cards(cards, f"{tmp_path}/cards")
    assert not set(glob.glob(f"{at}/blockmgr-*/*/shuffle_*.data")) - before
    assert rows(spark.read.parquet(f"{tmp_path}/cards")) == rows(cards)


def test_a_rewrite_takes_the_devices_in_parts(make, spark, tmp_path):
    cards = make.cards(*[{"device_uid": f"d{n}", "f_name": "a"} for n in range(12)])
    new = make.cards(*[{"device_uid": f"d{n}", "f_name": "b"} for n in range(20)]).withColumn("sha256", F.lit(None).cast("string"))
    stored.create(cards, root := f"{tmp_path}/base")
    scope = new.select("device_uid", "f_parent").filter("device_uid <> 'd3'")
    seen = []

    def rewrite(part, mine):
        seen.append(part.count())
        return snapshot.merge_snapshot(part, mine(new), mine(scope))

    stored.rewrite_by_part(spark, root, scope, rewrite)
    assert len(seen) > 1 and sum(seen) == 12
    assert rows(stored.read_cards(spark, root)) == rows(snapshot.merge_snapshot(cards, new, scope))
