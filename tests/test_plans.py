"""What the planner makes of the operators: pushdown, no pairwise joins, split hot keys, early top-k."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from conftest import plan_of, rows
from shelfmark.operators import content, groups, rules, snapshot
from shelfmark.operators.changes import write_bucketed, write_file_cards
from shelfmark.plans import categories, copies, devices, media
from shelfmark.session import shared_dir
from shelfmark.sources import listing
from shelfmark.workload.queries import QUERIES

SF = "/root/testdata/sf0.001"
MAY_USE_PYTHON = {"block_devices"}


@pytest.fixture(scope="module")
def stored(spark, make, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("stored")) + "/cards"
    write_file_cards(make.cards(*[{"f_name": f"{i}", "device_uid": f"d{i % 3}"} for i in range(30)]), path)
    return spark.read.parquet(path)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - {"stream_merge", "stream_hash"}))
def test_no_pairwise_join_and_no_python(spark, name):
    plan = plan_of(QUERIES[name](spark, SF))
    assert "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan
    if name not in MAY_USE_PYTHON:
        assert "EvalPython" not in plan and "InPandas" not in plan


def test_filters_and_columns_reach_the_scan(spark, stored):
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = plan_of(devices.files_under_path(stored, "d1", "a"))
    assert "EqualTo(device_uid,d1)" in plan and "StringStartsWith(f_parent,a/)" in plan
    assert "ReadSchema: struct<id:string,device_uid:string,f_parent:string,f_name:string,f_last_modified_date:timestamp_ntz>" in plan
    assert "TakeOrderedAndProject" in plan
    count = plan_of(copies.duplicates(stored, "d1"))
    assert "GreaterThan(f_size,20000000)" in count and "ReadSchema: struct<device_uid:string,f_name:string,f_size:bigint,sha256:string>" in count


def test_a_group_is_cut_before_the_shuffle(make):
    work = content.hash_all(make.devices({"uid": "d1"}), make.cards({}), make.table([("d1",)], "uuid string"), max_files=1000)
    assert "WindowGroupLimit" in plan_of(work)


@pytest.fixture
def small_partitions(spark):
    """Limits low enough for test data to count as skewed; no broadcast, so that both sides shuffle."""
    wanted = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "10KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "5KB",
        "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "96",
    }
    before = {key: spark.conf.get(key, None) for key in wanted}
    for key, value in wanted.items():
        spark.conf.set(key, value)
    yield
    for key, value in before.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)


@pytest.fixture(scope="module")
def hot_cards(spark, tmp_path_factory):
    """A third of all files is one content under one name, each in a folder of its own."""
    path = str(tmp_path_factory.mktemp("hot")) + "/cards"
    hot = F.col("id") % 3 == 0
    n = F.col("id").cast("string")
    cards = spark.range(0, 30000, 1, 8).select(
        F.sha2(n, 256).alias("id"), F.lit("d1").alias("device_uid"), F.concat(F.lit("p"), n, F.lit("/")).alias("f_parent"),
        F.when(hot, "LICENSE").otherwise(n).alias("f_name"), F.lit(None).cast("string").alias("f_extension"),
        F.lit("2020-01-01").cast("timestamp_ntz").alias("f_creation_date"),
        F.lit("2020-01-01").cast("timestamp_ntz").alias("f_last_modified_date"), F.lit(5).cast("bigint").alias("f_size"),
        F.lit(None).cast("string").alias("f_mime_type_java"),
        F.when(hot, F.sha2(F.lit("hot"), 256)).otherwise(F.sha2(n, 224)).alias("sha256"),
        F.when(hot, "license").otherwise(n).alias("f_name_lc"),
    )
    cards.write.parquet(path)
    return spark.read.parquet(path)


def is_split(df) -> bool:
    df.write.format("noop").mode("overwrite").save()
    frame = df._jdf.queryExecution()
    frame.executedPlan().execute().count()
    return "skew=true" in frame.executedPlan().toString()


def test_a_hot_content_is_split_in_joins(spark, make, hot_cards, small_partitions):
    cold = hot_cards.filter("f_name != 'LICENSE'")
    known = cold.select(F.lit(1).alias("id"), "sha256", "f_name")
    known.write.mode("overwrite").parquet(shared := shared_dir(spark, "known"))
    known = spark.read.parquet(shared)
    open_folders = categories._uncategorised(hot_cards.select("sha256", "f_name", "f_parent"), known)
    assert is_split(open_folders) and open_folders.count() == 10000
    lost = copies._without_backup(hot_cards.unionByName(cold.withColumn("device_uid", F.lit("bk"))), "d1", ["bk"])
    assert is_split(lost) and lost.count() == 10000
    groups_of_names = hot_cards.groupBy("sha256", F.col("f_parent").alias("f_name")).agg(F.min("device_uid").alias("device_uid"))
    held = copies._held(groups_of_names, [], groups_of_names.select("sha256", "f_name"))
    assert is_split(held) and held.count() == 30000
    shared_content = copies.paths_sharing_content(hot_cards, "p3/")
    assert is_split(shared_content) and shared_content.count() == 10000


def test_a_hot_folder_or_device_is_split_in_joins(spark, make, hot_cards, small_partitions):
    in_one = hot_cards.withColumn("f_parent", F.when(F.col("f_name") == "LICENSE", "hot/").otherwise(F.col("f_parent")))
    in_one.write.mode("overwrite").parquet(path := shared_dir(spark, "folder"))
    cards = spark.read.parquet(path)
    scope = cards.filter("f_parent != 'hot/'").select("device_uid", "f_parent")
    merged = snapshot.merge_snapshot(cards, cards.limit(0), scope)
    assert is_split(merged) and merged.count() == 10000
    ruled = cards.filter("sha256 IS NOT NULL").join(
        rules.rule_of_folder(cards, make.rules({"id": 1, "f_path": ["p", "h"]})), "f_parent"
    )
    assert is_split(ruled) and ruled.count() == 30000
    many = cards.withColumn("device_uid", F.when(F.col("f_name") == "LICENSE", "hot").otherwise(F.col("f_name")))
    many.withColumn("sha256", F.lit(None).cast("string")).write.mode("overwrite").parquet(path := shared_dir(spark, "many"))
    cards = spark.read.parquet(path)
    uid = F.col("device_uid").alias("uid")
    devs = cards.select(uid, F.lit(False).alias("job_path_scan")).distinct()
    assert is_split(content._unhashed(devs, cards, 10**9))


def test_a_hot_text_group_is_split(spark, hot_cards, small_partitions):
    text = groups.joined_text(hot_cards, ["sha256", "f_name_lc"], "f_parent", "folders", per_row=1000)
    assert is_split(text)
    hot = text.filter("f_name_lc = 'license'").collect()
    assert len(hot) == 10 and sum(len(r.folders.split(", ")) for r in hot) == 10000


def test_results_do_not_change_under_skew_splits(spark, make, hot_cards, small_partitions):
    rules_table = make.rules({"id": 1, "f_path": ["p1"]}, {"id": 2, "f_path": ["p"]})
    result = rules.apply_rules(hot_cards, rules_table, make.categories())
    assert result.count() == 20001
    assert rows(result.filter("f_name = 'LICENSE'"), "id") == [(1,)]
    folders = hot_cards.select("device_uid", "f_parent")
    assert snapshot.merge_snapshot(hot_cards, hot_cards, folders).count() == 30000


def test_bucketed_tables_join_without_a_shuffle_on_the_id(spark, make, tmp_path):
    cards = make.cards(*[{"f_name": f"{i}"} for i in range(20)])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for name, table in {"cards_by_id": cards, "exif_by_id": cards.select("id", F.lit("m").alias("make"), F.lit("x").alias("model"))}.items():
            spark.sql(f"DROP TABLE IF EXISTS {name}")
            write_bucketed(table, name, "id", 4)
        found = media.exif_devices(spark.table("cards_by_id"), spark.table("exif_by_id"))
        assert "hashpartitioning(id" not in plan_of(found)
        assert rows(found, "make", "files") == [("m", 20)]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        for name in ("cards_by_id", "exif_by_id"):
            spark.sql(f"DROP TABLE IF EXISTS {name}")


def test_costly_rows_are_not_merged_into_one_task(spark, make, tmp_path):
    for i in range(40):
        (tmp_path / f"f{i}").write_text(str(i))
    work = make.cards(*[{"f_name": f"f{i}", "f_parent": ""} for i in range(40)])
    hashed = content.hash_files(work, make.table([("d1", str(tmp_path))], "uuid string, mountpoint string"))
    assert hashed.withColumn("task", F.spark_partition_id()).select("task").distinct().count() > 4
    repeated = groups.repeated(make.table([("hot", 40000)], "k string, n bigint"), "n", piece=1000)
    per_task = repeated.groupBy(F.spark_partition_id()).count().collect()
    assert len(per_task) > 4 and sum(r["count"] for r in per_task) == 40000


def test_merge_keeps_untouched_rows_out_of_the_id_shuffle(stored, make):
    scope = make.table([("d1", "a/")], "device_uid string, f_parent string")
    plan = plan_of(snapshot.merge_snapshot(stored, listing.scan_files(make.listing("d1", "a/1")), scope))
    untouched = plan[plan.index("LeftAnti"):plan.index("LeftOuter")]
    assert "hashpartitioning(id" not in untouched


class _Session:
    """What ``shared_dir`` asks of a session."""

    def __init__(self, master, folder=None):
        self.conf = {"spark.checkpoint.dir": folder} if folder else {}
        self.sparkContext = type("Context", (), {"master": master})


def test_shared_dir_is_the_one_the_session_names(spark):
    if not spark.conf.get("spark.checkpoint.dir", None):
        assert shared_dir(spark, "x") != shared_dir(spark, "x")
        assert spark.conf.get("spark.checkpoint.dir", None) is None
    for master in ("local[8]", "spark://somewhere:7077"):
        assert shared_dir(_Session(master, "/shared/"), "x").startswith("/shared/x-")


def test_a_cluster_needs_a_shared_folder():
    with pytest.raises(ValueError):
        shared_dir(_Session("spark://somewhere:7077"), "x")
