from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from conftest import day, rows, sha
from shelfmark.operators import changes, snapshot
from shelfmark.sources import listing

NOW = dt.datetime(2024, 6, 15, 12)


def scope(make, *folders):
    return make.table(list(folders), "device_uid string, f_parent string")


@pytest.fixture
def old(make):
    return make.cards(
        {"f_name": "same.txt", "sha256": "S1"},
        {"f_name": "changed.txt", "sha256": "S2"},
        {"f_name": "resized.txt", "sha256": "S3"},
        {"f_name": "gone.txt", "sha256": "S4"},
        {"f_name": "gone.txt", "f_parent": "unscanned/", "sha256": "S5"},
        {"f_name": "gone.txt", "device_uid": "d2", "sha256": "S6"},
    )


@pytest.fixture
def new(make):
    return make.cards(
        {"f_name": "same.txt"},
        {"f_name": "changed.txt", "f_last_modified_date": day(5), "f_creation_date": day(4), "f_size": 99},
        {"f_name": "resized.txt", "f_size": 77, "f_mime_type_java": "text/plain"},
        {"f_name": "new.txt", "f_size": None},
        {"f_name": "stray.txt", "f_parent": "unscanned/"},
    )


def test_merge(make, old, new):
    merged = snapshot.merge_snapshot(old, new, scope(make, ("d1", "a/")))
    assert merged.columns == old.columns
    assert rows(merged, "device_uid", "f_parent", "f_name", "sha256", "f_size", "f_last_modified_date") == sorted(
        [
            ("d1", "a/", "changed.txt", None, 99, day(5)),
            ("d1", "a/", "new.txt", None, None, day(1)),
            ("d1", "a/", "resized.txt", "S3", 10, day(1)),
            ("d1", "a/", "same.txt", "S1", 10, day(1)),
            ("d1", "unscanned/", "gone.txt", "S5", 10, day(1)),
            ("d2", "a/", "gone.txt", "S6", 10, day(1)),
        ],
        key=lambda r: tuple((v is not None, str(v)) for v in r),
    )
    assert rows(merged.filter("f_name = 'resized.txt'"), "f_mime_type_java") == [("image/jpeg",)]


def test_merge_with_itself_changes_nothing(make, old):
    folders = old.select("device_uid", "f_parent")
    assert rows(snapshot.merge_snapshot(old, old, folders)) == rows(old)
    assert snapshot.scan_changes(old, old, folders).count() == 0


def test_scan_changes(make, old, new):
    found = snapshot.scan_changes(old, new, scope(make, ("d1", "a/")))
    assert rows(found, "change", "f_name", "sha256", "f_size") == [
        ("delete", "gone.txt", "S4", 10), ("insert", "new.txt", None, None), ("update", "changed.txt", None, 99),
    ]


def test_sync_reads_only_the_scan_paths(make, old):
    seen = make.listing("d1", "a/same.txt", "a/Thumbs.db", "unscanned/other.txt", "a/b_files/hidden.txt")
    synced = snapshot.sync_device(old, seen, make.table([("d1", "a")], "device_uid string, path string"))
    assert rows(synced, "device_uid", "f_parent", "f_name") == [
        ("d1", "a/", "same.txt"), ("d1", "unscanned/", "gone.txt"), ("d2", "a/", "gone.txt"),
    ]


def test_a_vanished_folder_is_kept_by_the_scan_and_dropped_by_the_check(make, old):
    seen = make.listing("d1", "a/same.txt", "x/y/z.txt")
    left = snapshot.drop_missing_dirs(old, seen, "d1")
    assert rows(left.filter("f_parent = 'unscanned/'")) == []
    assert left.count() == 5


def test_a_folder_with_only_folders_is_there(make):
    cards = make.cards({"f_parent": "x/"}, {"f_parent": "x/y/"}, {"f_parent": "q/"}, {"f_parent": ""})
    left = snapshot.drop_missing_dirs(cards, make.listing("d1", "x/y/z.txt"), "d1")
    assert rows(left, "f_parent") == [("",), ("x/",), ("x/y/",)]


def test_import_devices(make):
    devices = make.devices({"uid": "known", "id": 7, "path_scan_date": day(3)})
    seen = make.table(
        [("sda", "", "known", "/", "ext4"), ("sdb", "B", "n1", "/b", "ext4"), ("sdc", "C", "n2", "/c", "ext4"),
         ("sdc", "C", "n2", "/c2", "ext4")],
        "name string, label string, uuid string, mountpoint string, fstype string",
    )
    result = snapshot.import_devices(devices, seen)
    found = {r.uid: r for r in result.collect()}
    assert set(found) == {"known", "n1", "n2"} and {r.id for r in found.values()} == {7, 8, 9}
    assert found["n1"].path_scan_date is None and found["n1"].visible and not found["n1"].job_calc_crc
    assert rows(snapshot.import_devices(result, seen), "uid", "id") == rows(result, "uid", "id")


def test_rekey(make):
    cards = make.cards({"f_name": "a"}, {"f_name": "b", "id": "OLD"}, {"f_name": "c", "id": "OLD2", "device_uid": "d2"})
    assert snapshot.rekey_count(cards, "d1").first()[0] == 1
    fresh = snapshot.rekey(cards, "d1")
    assert rows(fresh, "f_name", "id") == [("a", sha("d1a/a")), ("b", sha("d1a/b")), ("c", "OLD2")]
    assert snapshot.rekey_count(fresh, "d1").first()[0] == 0


def test_update_rows_sets_null(make):
    cards = make.cards({"f_name": "a", "sha256": "X"}, {"f_name": "b", "sha256": "Y"})
    new = cards.filter("f_name = 'a'").withColumn("sha256", F.lit(None).cast("string"))
    assert rows(changes.update_rows(cards, new, ["id"], ["sha256"]), "f_name", "sha256") == [("a", None), ("b", "Y")]


def test_delete_where_keeps_unknown(make):
    cards = make.cards({"f_name": "a", "f_size": None}, {"f_name": "b", "f_size": 1}, {"f_name": "c", "f_size": 9})
    assert rows(changes.delete_where(cards, F.col("f_size") > 5), "f_name") == [("a",), ("b",)]


def test_upsert_and_cascades(make):
    table = make.categories((1, "S", "a"), (2, "S", "b"))
    result = changes.upsert_rows(table, make.categories((9, "S", "b"), (3, "T", "c")), ["sha256", "f_name"])
    assert rows(result) == [(1, "S", "a"), (3, "T", "c"), (9, "S", "b")]
    assert rows(changes.cascade_rules(make.rules({"id": 9}), result)) == [(9, "S", "b")]


def test_insert_fills_missing_columns(make):
    table = make.cards({"f_name": "a"})
    assert changes.insert_rows(table, table.select("id", "f_name")).count() == 2


def test_sinks(spark, make, tmp_path):
    cards = make.cards(*[{"f_name": str(i), "device_uid": f"d{i % 3}"} for i in range(9)])
    changes.write_file_cards(cards, f"{tmp_path}/cards")
    assert rows(spark.read.parquet(f"{tmp_path}/cards")) == rows(cards)
    with pytest.raises(Exception, match="exists"):
        changes.write_file_cards(cards, f"{tmp_path}/cards")
    changes.write_script(make.table([("echo 1",), ("echo 2",)], "line string"), f"{tmp_path}/script")
    texts = [p.read_text() for p in (tmp_path / "script").glob("part-*")]
    assert texts == ["echo 1\necho 2\n"]
    assert rows(changes.to_json_rows(make.table([(1, None)], "a int, b string"))) == [('{"a":1,"b":null}',)]


def test_scan_files_to_merge_round_trip(make):
    seen = make.listing("d1", "a/x.jpg", "a/b/y.jpg")
    starts = make.table([("d1", "a")], "device_uid string, path string")
    empty = make.cards()
    first = snapshot.sync_device(empty, seen, starts)
    assert rows(first) == rows(listing.scan_files(seen))
    assert rows(snapshot.sync_device(first, seen, starts)) == rows(first)
