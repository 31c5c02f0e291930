"""Shuffles that stay small: packed hashes, partitions that grow in number, joins that meet rows once."""

from __future__ import annotations

import re

from conftest import plan_of, rows
from pyspark.sql import functions as F

from shelfmark.functions.packing import full, slim
from shelfmark.operators import changes
from shelfmark.plans import copies, folder_totals
from shelfmark.session import tune
from shelfmark.workload.tables import Catalogue

HASH = "0A" * 32
ODD = [None, "", HASH, HASH.lower(), "A" * 32, "zz" * 32, "0A" * 31, "é\u0000x"]


def test_packed_values_come_back_as_they_were(make):
    names = [("Ab.JPG", "ab.jpg"), ("Ab.JPG", "other"), ("Ab.JPG", ""), ("Ab.JPG", None), (None, None), (None, "x"), ("", "")]
    data = [(text, text, *name) for text in ODD for name in names]
    df = make.table(data, "id string, sha256 string, f_name string, f_name_lc string")
    packed = slim(df)
    assert dict(packed.dtypes)["id"] == "binary"
    assert packed.select("id").distinct().count() == len(ODD)
    assert rows(full(packed, df)) == rows(df)


def test_ids_are_shuffled_packed(make, spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        table = make.table([(text, "n") for text in ODD], "id string, f_name string")
        left = changes.delete_rows(table, table.filter(F.col("id") == HASH), ["id"])
        assert rows(left) == rows(table.filter(F.coalesce(F.col("id") != HASH, F.lit(True))))
        assert "unhex" in plan_of(left)
        set_all = changes.update_rows(table, table.select("id", F.lit("m").alias("f_name")), ["id"], ["f_name"])
        assert rows(set_all) == rows(table.withColumn("f_name", F.when(F.col("id").isNull(), "n").otherwise("m")))
        assert "unhex" in plan_of(set_all)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_shuffles_start_with_many_partitions(spark):
    tune(spark)
    assert int(spark.conf.get("spark.sql.adaptive.coalescePartitions.initialPartitionNum")) >= 480


def test_categories_are_not_broadcast_by_an_estimate(make):
    cards = make.table([("h", "n", "d")], "sha256 string, f_name string, device_uid string")
    report = copies.few_copies_by_category(cards, make.categories((1, "h", "n")), make.rules({"id": 1}))
    assert re.search(r"SortMergeJoin.*\[sha256#\d+, f_name#\d+\]", plan_of(report))


def test_hashes_of_contents_are_made_behind_the_join(spark):
    plan = plan_of(Catalogue(spark, "/root/testdata/sf0.001").file_card.select("id", "sha256"))
    below = plan[plan.index("Join"):]
    assert "sha2(" in plan and "part-" not in below


def test_rows_meet_categories_without_a_count_first(make):
    cards = make.table([("d", "a/", "h", "n", 1)], "device_uid string, f_parent string, sha256 string, f_name string, f_size bigint")
    plan = plan_of(folder_totals.folder_totals(cards, make.categories((1, "h", "n")), make.rules({"id": 1})))
    assert not re.search(r"Exchange hashpartitioning\(device_uid#\d+, f_parent#\d+, sha256#\d+", plan)
