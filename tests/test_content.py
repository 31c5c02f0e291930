from __future__ import annotations

import datetime as dt
import hashlib

from pyspark.sql import functions as F

from conftest import day, rows, sha
from shelfmark.operators import changes, content, groups, metadata, thumbnails

NOW = dt.datetime(2024, 6, 15, 12)


def mounted(make, *uids, point="/mnt"):
    return make.table([(u, point) for u in uids], "uuid string, mountpoint string")


def test_hash_worklist(make):
    devices = make.devices({"uid": "d1"}, {"uid": "d2", "job_path_scan": True})
    cards = make.cards(
        {"f_name": "small", "f_size": 1}, {"f_name": "mid", "f_size": 5}, {"f_name": "limit", "f_size": 7},
        {"f_name": "big", "f_size": 8}, {"f_name": "empty", "f_size": 0}, {"f_name": "none", "f_size": None},
        {"f_name": "done", "f_size": 2, "sha256": "X"}, {"f_name": "other", "f_size": 1, "device_uid": "d2"},
    )
    assert rows(content.hash_worklist(devices, cards, "d1", max_size=7), "f_name") == [("limit",), ("mid",), ("small",)]
    assert rows(content.hash_worklist(devices, cards, "d1", max_files=2, max_size=7), "f_name") == [("mid",), ("small",)]
    assert rows(content.hash_worklist(devices, cards, "d2")) == []


def test_hash_candidates_and_limit_of_devices(make):
    devices = make.devices(
        {"uid": "ok"}, {"uid": "running", "job_calc_crc": True}, {"uid": "hidden", "visible": False},
        {"uid": "scan", "job_path_scan": True}, {"uid": "exif", "job_calc_exif": True},
        {"uid": "resize", "job_resize": True}, {"uid": "away"},
    )
    here = mounted(make, "ok", "running", "hidden", "scan", "exif", "resize")
    assert rows(content.hash_candidates(devices, here)) == [("ok", False), ("running", True)]
    cards = make.cards(*[{"f_name": f"{i}", "f_size": i, "device_uid": u} for u in ("ok", "running") for i in range(1, 6)])
    assert rows(content.hash_all(devices, cards, here, max_devices=2, max_files=3), "device_uid", "f_name") == [
        ("ok", "1"), ("ok", "2"), ("ok", "3"),
    ]
    assert rows(content.hash_all(devices, cards, here, max_devices=1)) == []


def test_job_marks(make):
    devices = make.devices({"uid": "a", "crc_date": day(1)}, {"uid": "b"})
    marked = content.mark_hash_job(devices, make.table([("b",)], "uid string"), True, F.lit(NOW))
    assert rows(marked, "uid", "job_calc_crc", "crc_date") == [("a", False, day(1)), ("b", True, NOW)]
    scanned = content.mark_scanned(devices, "a", F.lit(NOW))
    assert rows(scanned, "uid", "path_scan_date") == [("a", NOW), ("b", None)]
    assert scanned.schema["path_scan_date"].dataType.simpleString() == "timestamp_ntz"


def test_hash_files_reads_in_pieces_and_leaves_out_what_it_cannot_read(make, tmp_path):
    (tmp_path / "a").mkdir()
    big = b"x" * (3 * (1 << 20) + 17)
    (tmp_path / "a" / "big.bin").write_bytes(big)
    (tmp_path / "a" / "small.txt").write_bytes("héllo".encode())
    cards = make.cards(*[{"f_name": n} for n in ("big.bin", "small.txt", "missing.txt")])
    work = content.hash_worklist(make.devices({"uid": "d1"}), cards, "d1")
    hashes = content.hash_files(work, mounted(make, "d1", point=f"{tmp_path}/"), tasks=3)
    filled = content.apply_hashes(cards, hashes)
    assert rows(filled, "f_name", "sha256") == [
        ("big.bin", hashlib.sha256(big).hexdigest().upper()), ("missing.txt", None), ("small.txt", sha("héllo")),
    ]


def test_hash_folder(spark, tmp_path):
    (tmp_path / "one.txt").write_bytes(b"first")
    (tmp_path / "large.txt").write_bytes(b"0123456789")
    found = content.hash_folder(spark, str(tmp_path), max_size=9)
    assert rows(found, "length", "sha256") == [(10, None), (5, sha("first"))]


def test_exif_normalize(make):
    photo, video = "image/jpeg", "video/mp4"
    cases = {
        "plain": (photo, {"Date/Time": "2019:07:18 10:11:12", "Make": "M", "Orientation": "Top"}),
        "slash": (photo, {"Date/Time Original": "2010/05/19 11:33:07"}),
        "zeros": (photo, {"Date/Time": "0000:00:00 00:00:00", "Model": "X"}),
        "words": (photo, {"Date/Time": "unknown", "Model": "Y"}),
        "blank": (photo, {"Date/Time": "", "Model": "Z"}),
        "broken": (photo, {"Date/Time": "2010:05:19 11:33: 7", "Make": "M"}),
        "broken2": (photo, {"Date/Time": "2010:05:19 11:33:07", "Date/Time Digitized": "2010:13:19 11:33:07"}),
        "longmonth": (photo, {"Date/Time": "2019:02:31 10:00:00"}),
        "midnight": (photo, {"Date/Time": "2019:12:31 24:00:00"}),
        "place": (photo, {"GPS Latitude": "51", "gpsLatitudeD": "51.5", "gpsLongitudeD": "-0.25"}),
        "zero": (photo, {"gpsLatitudeD": "0", "gpsLongitudeD": "0.0"}),
        "half": (photo, {"gpsLatitudeD": "1"}),
        "video": (video, {"Creation Time": "Sat Jul 18 10:43:20 +03:00 2020", "Modification Time": "sun jul 19 01:02:03 GMT 2020"}),
        "zone": (video, {"Creation Time": "Sat Jul 18 10:43:20 MSK 2020"}),
        "weekday": (video, {"Creation Time": "Sun Jul 18 10:43:20 +03:00 2020"}),
        "empty": (video, {"Creation Time": ""}),
        "mixed": (video, {"Make": "M", "Date/Time": "bad:date"}),
        "none": (photo, {}),
        "text": ("text/plain", {"Make": "M"}),
    }
    files = make.table([(k, mime) for k, (mime, _) in cases.items()], "id string, f_mime_type_java string")
    tags = make.table([(k, t, v) for k, (_, ts) in cases.items() for t, v in ts.items()], "id string, tag string, value string")
    found = {r.id: r for r in metadata.exif_normalize(files, tags).collect()}
    assert set(found) == set(cases) - {"broken", "broken2", "zone", "weekday", "empty", "text"}
    assert found["plain"].date_time == dt.datetime(2019, 7, 18, 10, 11, 12) and found["plain"].make == "M"
    assert found["slash"].date_time_original == dt.datetime(2010, 5, 19, 11, 33, 7)
    assert found["zeros"].date_time is None and found["words"].date_time is None and found["blank"].model == "Z"
    assert found["longmonth"].date_time == dt.datetime(2019, 2, 28, 10)
    assert found["midnight"].date_time == dt.datetime(2020, 1, 1)
    assert (float(found["place"].gps_latitude_dec), float(found["place"].gps_longitude_dec)) == (51.5, -0.25)
    assert found["zero"].gps_latitude_dec is None and found["half"].gps_latitude_dec is None
    assert found["video"].date_time == dt.datetime(2020, 7, 18, 10, 43, 20)
    assert found["video"].date_time_original == dt.datetime(2020, 7, 19, 1, 2, 3)
    assert found["mixed"].make is None
    assert all(v is None for k, v in found["none"].asDict().items() if k != "id")


def test_exif_worklist(make):
    cards = make.cards(
        {"f_name": "a", "id": "1"}, {"f_name": "b", "id": "2", "f_mime_type_java": "video/mp4"},
        {"f_name": "c", "id": "3", "f_mime_type_java": "text/plain"}, {"f_name": "d", "id": "4", "f_mime_type_java": None},
        {"f_name": "e", "id": "5"}, {"f_name": "f", "id": "6", "device_uid": "d2"},
    )
    done = make.table([("5",)], "id string")
    assert rows(metadata.exif_worklist(cards, done, "d1"), "f_name") == [("a",), ("b",)]


def test_thumbnails(make):
    cards = make.cards(
        {"f_name": "a.JPG", "sha256": "AB12", "f_parent": "y/"}, {"f_name": "a.JPG", "sha256": "AB12", "f_parent": "x/"},
        {"f_name": "b", "sha256": "CD34"}, {"f_name": "made.jpg", "sha256": "EF56"}, {"f_name": "c.jpg"},
    )
    images = make.table([("EF56", "made.jpg", "k")], "sha256 string, f_name string, file_id string")
    work = thumbnails.thumbnail_worklist(cards, images, "d1")
    assert rows(work) == [("a/", "b", None, "CD34"), ("x/", "a.JPG", "JPG", "AB12")]
    key = "AB12_" + sha("a.JPG") + ".JPG"
    assert rows(thumbnails.thumbnail_keys(work), "file_id", "cache_path") == [
        (key, f"images-cache/AB/{key}"), ("CD34_" + sha("b"), "images-cache/CD/CD34_" + sha("b")),
    ]


def test_files_are_packed_by_bytes(spark):
    sizes = spark.range(3000).selectExpr("cast(id as string) AS id", "IF(id % 100 = 0, 5000, id % 7) AS f_size")
    packed = groups.packed(sizes, "f_size", 12, "id").groupBy("task").agg(F.sum("f_size").alias("s"), F.count("id").alias("n"))
    found = {r.task: r.s for r in packed.collect()}
    assert set(found) == set(range(12)) and sum(found.values()) == sizes.agg(F.sum("f_size")).first()[0]
    assert max(found.values()) <= sum(found.values()) / 12 + 5000
    empty = groups.packed(sizes.limit(0), "f_size", 12, "id")
    assert empty.collect() == [] and "task" in empty.columns
    zero = groups.packed(sizes.withColumn("f_size", F.lit(0)), "f_size", 12, "id")
    assert zero.count() == 3000


def test_files_below_a_uri_and_names_with_blanks(spark, make, tmp_path):
    folder = tmp_path / "a b" / "ü%"
    folder.mkdir(parents=True)
    (folder / "n 1.txt").write_bytes(b"one")
    (folder / "empty").write_bytes(b"")
    (folder / "big.bin").write_bytes(b"x" * (3 << 20))
    work = make.cards(*[{"f_parent": "ü%/", "f_name": n, "f_size": s} for n, s in [("n 1.txt", 3), ("empty", None), ("big.bin", 3 << 20), ("no", 1)]])
    digest = {sha("d1ü%/" + p.name): hashlib.sha256(p.read_bytes()).hexdigest().upper() for p in folder.iterdir()}
    for mount in (f"{tmp_path}/a b/", f"file://{tmp_path}/a%20b"):
        mounts = make.table([("d1", mount), ("d1", "zzz")], "uuid string, mountpoint string")  # the least path counts
        assert {r.id: r.sha256 for r in content.hash_files(work, mounts).collect()} == digest
    below = content.hash_folder(spark, f"{tmp_path}/a b")
    nothing = hashlib.sha256(b"").hexdigest().upper()  # an empty file is not listed
    assert sorted(r.sha256 for r in below.collect()) == sorted(set(digest.values()) - {nothing})


def test_repeated_changes_and_hashes_do_not_multiply_files(make):
    cards = make.cards({"f_name": "x"}, {"f_name": "y"})
    first = cards.filter("f_name = 'x'").first()
    twice = make.table([(first.id, "B"), (first.id, "A"), (first.id, "A")], "id string, sha256 string")
    assert rows(content.apply_hashes(cards, twice), "f_name", "sha256") == [("x", "A"), ("y", None)]
    version = [(first.id, first.f_last_modified_date, 10, "B"), (first.id, first.f_last_modified_date, 10, "A"), (first.id, day(9), 10, "0")]
    known = make.table(version, "id string, f_last_modified_date timestamp_ntz, f_size bigint, sha256 string")
    assert rows(content.apply_hashes(cards, known), "f_name", "sha256") == [("x", "A"), ("y", None)]
    table = make.table([(1, "a", 1), (2, "b", 2)], "k int, v string, w int")
    more = make.table([(2, "z", 9), (2, "c", 10), (3, "d", 4), (3, "d", 4)], "k int, v string, w int")
    assert rows(changes.upsert_rows(table, more, ["k"])) == [(1, "a", 1), (2, "c", 10), (3, "d", 4)]
