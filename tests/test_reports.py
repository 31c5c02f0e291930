from __future__ import annotations

import datetime as dt
import json
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from conftest import day, rows
from shelfmark.operators import changes
from shelfmark.plans import categories, copies, devices, folder_totals, folders, media, name_index, search


def test_device_index(make):
    devs = make.devices(
        {"uid": "d1", "label_v": "b", "path_scan_date": day(0)}, {"uid": "d2", "label_v": "a"},
        {"uid": "d3", "visible": False},
    )
    cards = make.cards({"f_name": "1"}, {"f_name": "2", "f_size": 0}, {"f_name": "3", "sha256": "X"}, {"f_name": "4", "f_size": None})
    index = devices.device_index(devs, cards, as_of=F.lit(day(10)))
    assert [tuple(r) for r in index.select("uid", "without_hash", "days_since_scan").collect()] == [("d2", 0, None), ("d1", 1, 10)]
    assert devices.device_list(devs).count() == 3


def test_device_files(make):
    cards = make.cards(
        {"f_name": "1", "f_parent": "A/x_files", "f_last_modified_date": day(9)},
        {"f_name": "2", "f_parent": "A/x_files/", "f_last_modified_date": day(8)},
        {"f_name": "3", "f_parent": "A", "f_last_modified_date": day(7)},
        {"f_name": "4", "f_parent": "AB/", "sha256": "X"}, {"f_name": "5", "device_uid": "d2"},
    )
    assert [r.f_name for r in devices.files_of_device_by_date(cards, "d1", 2).collect()] == ["2", "3"]
    assert rows(devices.files_under_path(cards, "d1", "A"), "f_name") == [("1",), ("2",), ("3",)]
    assert devices.files_of_device(cards, "d1", 3).count() == 3
    assert rows(devices.count_by_device(cards)) == [("d1", 4), ("d2", 1)]
    assert [r.f_name for r in devices.files_without_hash(cards, "d1", 2).collect()] == ["1", "2"]
    assert devices.files_without_hash_total(cards, "d1").first()[0] == 3


def test_debug_unhashed_joins_by_label(make):
    devs = make.devices({"uid": "u1", "label_v": "d1", "path_scan_date": day(1)}, {"uid": "d1", "label_v": "other"})
    cards = make.cards({"f_name": "1"}, {"f_name": "2"}, {"f_name": "3", "sha256": "X"})
    assert rows(devices.debug_unhashed(devs, cards, "d1")) == [("d1", day(1), 2)]
    assert rows(devices.debug_unhashed(devs, cards, "other")) == []


def test_no_backup(make):
    cards = make.cards(
        {"f_name": "saved", "sha256": "A"}, {"f_name": "page", "sha256": "B"}, {"f_name": "twice", "sha256": "C"},
        {"f_name": "unhashed"}, {"f_name": "twice2", "sha256": "C"}, {"f_name": "page2", "sha256": "E"},
        {"f_name": "s", "sha256": "A", "device_uid": "bk"}, {"f_name": "p", "sha256": "B", "device_uid": "bk", "f_parent": "x_files"},
        {"f_name": "q", "sha256": "E", "device_uid": "bk", "f_parent": "x_files/"},
        {"f_name": "n", "sha256": None, "device_uid": "bk"}, {"f_name": "o", "sha256": "C", "device_uid": "other"},
    )
    lost = copies.no_backup(cards, "d1", ["bk", "d1"])
    assert [r.f_name for r in lost.collect()] == ["page", "twice", "twice2"]
    assert copies.no_backup_total(cards, "d1", ["bk", "d1"]).first()[0] == 3
    assert [r.f_name for r in copies.no_backup(cards, "d1", ["bk"], rows=1).collect()] == ["page"]


def test_few_copies(make):
    cards = make.cards(
        {"f_name": "one", "sha256": "A"}, {"f_name": "one", "sha256": "A", "device_uid": "d2"},
        {"f_name": "single", "sha256": "B", "device_uid": "bad"},
        {"f_name": "held", "sha256": "C", "device_uid": "bad"}, {"f_name": "other", "sha256": "C", "device_uid": "d2"},
        {"f_name": "hidden", "sha256": "D", "device_uid": "back"}, {"f_name": "null", "sha256": None},
    )
    rules = make.rules({"id": 1, "category_type": "T", "description": "x"})
    cats = make.categories((1, "A", "one"), (1, "B", "single"), (1, "C", "held"), (1, "D", "hidden"))
    args = (["bad"], ["back"])
    assert rows(copies.few_copies_by_category(cards, cats, rules, *args)) == [("C", "held", "T", "x", "d2")]
    assert rows(copies.few_copies_by_category(cards, cats, rules, *args, copies=3), "f_name", "device_uid") == [("held", "d2"), ("one", "d1")]
    assert rows(copies.few_copies_by_category(cards, cats, rules), "f_name") == [("held",), ("hidden",), ("single",)]
    assert rows(copies.few_copies_recent(cards, *args), "f_name", "device_uid") == [("held", "d2"), ("other", "d2")]


def test_few_copies_recent_window(make):
    cards = make.cards(
        {"f_name": "new", "sha256": "A", "f_last_modified_date": dt.datetime(2019, 6, 1)},
        {"f_name": "old", "sha256": "B", "f_last_modified_date": dt.datetime(2019, 5, 31)},
    )
    assert [r.f_name for r in copies.few_copies_recent(cards).collect()] == ["new", "old"]
    as_of = F.lit(dt.datetime(2020, 6, 20))
    assert rows(copies.few_copies_recent(cards, as_of=as_of), "f_name") == [("new",)]


def test_duplicates(make):
    big = 30_000_000
    cards = make.cards(
        *[{"f_name": "a", "f_parent": f"{i}/", "sha256": "A", "f_size": big} for i in range(3)],
        *[{"f_name": "b", "f_parent": f"{i}/", "sha256": "B", "f_size": big + 1} for i in range(3)],
        *[{"f_name": "c", "f_parent": f"{i}/", "sha256": None, "f_size": big} for i in range(3)],
        *[{"f_name": "d", "f_parent": f"{i}/", "sha256": "D", "f_size": 20_000_000} for i in range(3)],
        {"f_name": "e", "sha256": "E", "f_size": big}, {"f_name": "f", "sha256": "E", "f_size": big},
    )
    assert [tuple(r) for r in copies.duplicates(cards, "d1").collect()] == [("B", "b", big + 1, 3), ("A", "a", big, 3)]


def test_whereabouts(make):
    cards = make.cards(
        {"f_name": "x", "sha256": "A", "f_parent": "p/", "id": "2"}, {"f_name": "x", "sha256": "A", "f_parent": "q/", "id": "1"},
        {"f_name": "y", "sha256": "A", "device_uid": "d2", "id": "0"}, {"f_name": "z", "sha256": "B", "f_parent": "q/"},
        {"f_name": "z", "sha256": "B", "device_uid": "d2", "f_parent": "r/"}, {"f_name": "n", "f_parent": "q/"},
    )
    mounts = make.table([("d1", "/mnt/d1")], "uuid string, mountpoint string")
    assert rows(copies.locate_copy(cards, mounts, "A"), "id", "path") == [("1", "/mnt/d1/q/x")]
    assert rows(copies.locate_copy(cards, mounts, "none")) == []
    assert rows(copies.paths_by_hash(cards, "A"), "f_parent", "device_uid") == [("a/", "d2"), ("p/", "d1"), ("q/", "d1")]
    assert rows(copies.file_by_natural_key(cards, "d1", "q/", "z"), "f_name") == [("z",)]
    assert rows(copies.paths_sharing_content(cards, "q/")) == [("d1", "p/", 1), ("d1", "q/", 2), ("d2", "a/", 1), ("d2", "r/", 1)]
    rules = make.rules({"id": 1, "description": "text"})
    found = copies.copies_on_device(cards, make.categories((1, "A", "x"), (1, "Z", "x")), rules, "d1", "A")
    assert [tuple(r) for r in found.select("f_parent", "category_type", "description").collect()] == [("p/", "T", "text"), ("q/", "T", "text")]


def test_names_are_compared_as_a_multiset(make):
    listed = ["IMG_1", "IMG_1", "IMG_1", "VID_2", "VID_2", "other", "IMG_9"]
    cards = make.cards({"f_name": "IMG_1"}, {"f_name": "IMG_9"}, {"f_name": "IMG_9", "device_uid": "d2"})
    found = copies.names_not_catalogued(make.table([(n,) for n in listed], "f_name string"), cards)
    assert rows(found, "f_name") == [("IMG_1",), ("IMG_1",), ("VID_2",), ("VID_2",)]
    assert found.filter("f_name = 'VID_2'").first().command == "adb pull /sdcard/DCIM/Camera/VID_2 /tmp/cp_back/VID_2"


def test_duplicate_content_overview(make):
    cards = make.cards(
        {"f_name": "X", "sha256": "A", "f_parent": "q/"}, {"f_name": "x", "sha256": "A", "f_parent": "p/", "device_uid": "d2"},
        {"f_name": "x", "sha256": "A", "f_parent": "p/"}, {"f_name": "y", "sha256": "A"}, {"f_name": "n"},
    )
    assert rows(copies.duplicate_content_overview(cards)) == [("x", "A", 0, 3, "d1, d2", "p/, q/"), ("y", "A", 0, 1, "d1", "a/")]
    places = [("A", "x", "d1", "p/"), ("A", "x", "d1", "q/"), ("A", "x", "d2", "p/"), ("A", "y", "d1", "a/")]
    assert [tuple(r) for r in copies.duplicate_content_places(cards).collect()] == places


def test_duplicate_content_overview_keeps_a_hot_content_in_one_row(make):
    parents = [f"p{at:06d}/" for at in range(100_001)]
    folders = make.spark.range(len(parents)).select(F.format_string("p%06d/", "id").alias("f_parent"))
    cards = make.cards({"f_name": "x", "sha256": "A"}).drop("f_parent").crossJoin(folders)
    assert rows(copies.duplicate_content_overview(cards)) == [("x", "A", 0, len(parents), "d1", ", ".join(parents))]


@pytest.fixture(scope="module")
def sorted_out(make):
    """Three rules; one content under two categorised names, files without category, size or hash."""
    rules = make.rules(
        {"id": 1, "category_type": "Photo", "category": "Trip", "sub_category": "Sea"},
        {"id": 2, "category_type": "Work", "category": "Src", "sub_category": "Web"},
        {"id": 3, "category_type": "Work", "category": "Doc", "sub_category": "Scan"},
    )
    cats = make.categories((1, "A", "x"), (2, "A", "y"), (3, "B", "z"))
    cards = make.cards(
        {"f_name": "x", "sha256": "A", "f_parent": "P/F/", "f_size": 1_572_864},
        {"f_name": "y", "sha256": "A", "f_parent": "P/F/", "f_size": 524_288},
        {"f_name": "z", "sha256": "B", "f_parent": "P/G/", "f_size": 0},
        {"f_name": "z", "sha256": "B", "f_parent": "Q/G/", "f_size": 5},
        {"f_name": "q", "sha256": "A", "f_parent": "P/F/sub/", "f_extension": "JPG", "f_last_modified_date": day(7)},
        {"f_name": "n", "sha256": None, "f_parent": "Q/F/", "f_last_modified_date": day(9)},
        {"f_name": "n", "sha256": None, "f_parent": "Q/F/", "device_uid": "d2", "f_last_modified_date": day(3)},
        {"f_name": "s", "sha256": "S", "f_parent": "Q/s_files"}, {"f_name": "s", "sha256": "S", "f_parent": "Q/s_files/"},
        {"f_name": "v", "sha256": "V", "f_parent": "Q/v/", "f_size": None},
    )
    return cards, cats, rules


def test_category_counts(sorted_out):
    cards, cats, rules = sorted_out
    assert [tuple(r) for r in categories.count_by_category_type(cards, cats, rules).collect()] == [(None, 5), ("Work", 2), ("Photo", 1)]
    assert rows(categories.count_by_category(cards, cats, rules, "Work")) == [("Doc", 1), ("Src", 1)]
    assert rows(categories.count_by_sub_category(cards, cats, rules, "Work", "Doc")) == [("Scan", 1)]


def test_uncategorised(sorted_out):
    cards, cats, _ = sorted_out
    assert [tuple(r) for r in categories.uncategorised_dirs_by_date(cards, cats).collect()] == [
        ("Q/F/", day(9).date()), ("P/F/sub/", day(7).date()), ("Q/s_files/", day(1).date()),
    ]
    assert [r.f_parent for r in categories.uncategorised_dirs_by_date(cards, cats, rows=2).collect()] == ["Q/F/", "P/F/sub/"]
    assert [(r.sha256, r.f_name) for r in categories.uncategorised_files_by_date(cards, cats).collect()] == [
        (None, "n"), ("A", "q"), (None, "n"), ("S", "s"),
    ]
    assert rows(categories.uncategorised_dirs_by_extension(cards, cats)) == [("P/F/sub/", 1), ("Q/F/", 2), ("Q/s_files/", 1)]
    assert rows(categories.uncategorised_dirs_by_extension(cards, cats, "jpg")) == [("P/F/sub/", 1)]
    assert rows(categories.big_uncategorised_dirs(cards, cats, "d1", 0)) == [("P/F/sub/", 1), ("Q/v/", 1)]
    assert rows(categories.big_uncategorised_dirs(cards, cats, "d1", 1)) == []


def test_files_with_category(sorted_out):
    cards, cats, rules = sorted_out
    exact = categories.files_with_category(cards, cats, rules, "P/F/")
    assert rows(exact, "f_name", "category") == [("x", "Trip"), ("y", "Src")]
    begins = categories.files_with_category(cards, cats, rules, "P/F/", begins=True)
    assert rows(begins, "f_name", "category") == [("q", None), ("x", "Trip"), ("y", "Src")]


def test_paths_of_category(make, sorted_out):
    cards, cats, rules = sorted_out
    jobs = make.jobs((1, "d1", "P/F/", "z/"), (2, "d2", "P/F/", "b/"))
    assert rows(categories.paths_of_category(cards, cats, rules, jobs, "Photo", "Trip", "Sea")) == [("P/F/", "d1", 2, "b/")]
    assert rows(categories.paths_of_category(cards, cats, rules, jobs, "Work", "Doc", "Scan")) == [("P/G/", "d1", 1, None), ("Q/G/", "d1", 1, None)]


def test_storage_by_folder(sorted_out):
    cards, cats, rules = sorted_out
    found = folders.storage_by_folder(cards, cats, rules, "d1", 1).collect()
    assert [tuple(r) for r in found] == [("P", 2, 3, 1, ["Photo", "Work"]), ("Q", 0, 4, 3, ["Work"])]
    deeper = {r.folder: r.category_types for r in folders.storage_by_folder(cards, cats, rules, "d1", 3).collect()}
    assert deeper == {"": ["Photo", "Work"], "sub": None}


def test_explore_folder_counts_a_file_once_per_name(sorted_out):
    cards, cats, rules = sorted_out
    found = folders.explore_folder(cards, cats, rules, "d1", "P", 2).collect()
    assert [tuple(r) for r in found] == [("F", 6, 0, ["Photo", "Work"]), ("G", 1, 0, ["Work"])]
    other = folders.explore_folder(cards, cats, rules, "d1", "Q", 2).collect()
    assert [tuple(r) for r in other] == [("F", 1, 1, None), ("G", 1, 0, ["Work"]), ("v", 1, 1, None)]
    with pytest.raises(ValueError):
        folders.explore_folder(cards, cats, rules, "d1", "P", 1)


def test_folders_at_depth(make):
    cards = make.cards(*[{"f_name": str(i), "f_parent": p} for i, p in enumerate(["b/x/", "a/", "b/y/", "/r/s/", "//", ""])])
    assert [r[0] for r in folders.folders_at_depth(cards, "d1", 0).collect()] == ["", "a", "b"]
    assert [r[0] for r in folders.folders_at_depth(cards, "d1", 1).collect()] == ["r", "x", "y"]


def test_scan_tree(make):
    seen = make.listing("d1", "home/a/1", "home/b/2", "home/locked/!", "home/c/d/3", "etc/4")
    paths = make.table([("d1", "home/a"), ("d1", "home/c/d"), ("d2", "home/b")], "device_uid string, path string")
    nodes = folders.scan_tree(seen, paths, "d1", "home")
    found = {r.id: (r.text, r.icon, r.children, r.state.selected) for r in nodes.collect()}
    assert found == {
        "home/a": ("a", "", True, True), "home/b": ("b", "", True, False),
        "home/c": ("c", "images/jstree/arrow_right.png", True, False),
        "home/locked": ("home/locked", "images/jstree/stop.png", False, False),
    }
    node = json.loads(changes.to_json_rows(nodes.filter("id = 'home/a'")).first()[0])
    assert node["state"] == {"opened": False, "disabled": False, "selected": True}


def test_search_names(make):
    cards = make.cards({"f_name": "My Red Car.jpg"}, {"f_name": "red-car.png"}, {"f_name": "car red"}, {"f_name": "Red Car"}, {"f_name": "Red Car", "device_uid": "d2"})
    assert [r[0] for r in search.search_names(cards, "RED car").collect()] == ["My Red Car.jpg", "Red Car", "red-car.png"]
    assert search.search_names(cards, "", 2).count() == 2
    many = make.cards(*[{"f_name": f"n{i}"} for i in range(150)])
    assert search.search_names(many, "n", 500).count() == 100


@pytest.mark.parametrize(
    "text", ["RED car", "red", "car.j", "r", "", "ed", "e_ c", "%car", "no such name", "\\", "a\\b", "ünï", "re  ca", "jpgx"]
)
def test_search_through_the_index_gives_the_same(spark, make, tmp_path_factory, text):
    names = ["My Red Car.jpg", "Red Car", "red-car.png", "ca", "", "R", "a\\b\\c", "ÜNÏcode.JPG", "recap", "jpg", "xjpg.jpg"]
    cards = make.cards(*[{"f_name": n, "f_parent": f"{p}/"} for n in names for p in "ab"])
    root = str(tmp_path_factory.mktemp("index") / "names")
    name_index.write_name_index(cards, root)
    for limit in (2, 500):
        expected = [r[0] for r in search.search_names(cards, text, limit).collect()]
        assert [r[0] for r in name_index.search_index(spark, root, text, limit).collect()] == expected


def test_search_through_the_index_reads_one_piece(spark, make, tmp_path):
    cards = make.cards(*[{"f_name": f"holiday {i:04d}.jpg"} for i in range(400)], {"f_name": "xylophone holiday.jpg"})
    name_index.write_name_index(cards, f"{tmp_path}/names")
    found = name_index.search_index(spark, f"{tmp_path}/names", "xylo holiday")
    assert [r[0] for r in found.collect()] == ["xylophone holiday.jpg"]
    from conftest import plan_of

    assert "EqualTo(piece,lop)" in plan_of(found) or "EqualTo(piece,xyl)" in plan_of(found) or "EqualTo(piece,ylo)" in plan_of(found)
    assert name_index.pieces_of_text("xylo holiday") == sorted({"xyl", "ylo", "hol", "oli", "lid", "ida", "day"})
    listed = spark.read.parquet(f"{tmp_path}/names/postings").filter("piece = 'xyl'")
    assert listed.count() == 1  # of more than 5,000 postings


def test_search_page(make):
    devs = make.devices({"uid": "d1", "label_v": "L1"})
    cards = make.cards(
        *[{"f_name": f"N{i}", "f_parent": f"p{9 - i}/", "sha256": f"S{i}"} for i in range(6)],
        {"f_name": "other", "device_uid": "unknown"},
    )
    page = search.search_page(cards, devs, 3, 1, 3, search="n", column=1, direction="asc").first()
    assert (page.draw, page.recordsTotal, page.recordsFiltered, page.error) == (3, 7, 6, "")
    assert [e.name for e in page.data] == ["N3", "N2", "N1"] and page.data[0].device == "L1"
    down = search.search_page(cards, devs, 3, 0, 10, column=3, direction="desc").first()
    assert [e.name for e in down.data][0] == "other" and down.data[0].device == "" and down.data[0].sha256 == ""
    odd = search.search_page(cards, devs, 3, 0, 3, column=8, direction="desc").first()
    assert [e.name for e in odd.data] == ["N0", "N1", "N2"]
    beyond = search.search_page(cards, devs, 3, 50, 3).first()
    assert beyond.data == [] and beyond.recordsTotal == 7


def test_media(make):
    cards = make.cards(
        {"f_name": "a.jpg", "id": "1", "sha256": "A", "f_last_modified_date": day(2)},
        {"f_name": "b.jpg", "id": "2", "sha256": "B", "f_last_modified_date": day(5)},
        {"f_name": "c.jpg", "id": "3"}, {"f_name": "d", "id": "4", "sha256": "D", "f_mime_type_java": "text/plain"},
    )
    exif = make._table(
        "exif",
        [{"id": "1", "make": "M", "model": "X", "gps_latitude": "t", "gps_latitude_dec": Decimal(1), "gps_longitude_dec": Decimal(2)},
         {"id": "2", "make": "M", "model": "X", "gps_latitude": "t"}, {"id": "3"}, {"id": "9", "make": "Z"}],
        lambda row: {},
    )
    assert [tuple(r) for r in media.exif_devices(cards, exif).collect()] == [
        ("M", "X", "2020-01-06 00:00:00", 2), (None, None, "2020-01-02 00:00:00", 1),
    ]
    assert rows(media.gps_points(cards, exif)) == [("a/a.jpg", 1.0, 2.0)]
    devs = make.devices({"uid": "d1", "label_v": "L"})
    found = media.files_of_exif_device(cards, devs, exif, "M", "X").collect()
    assert [(r.sha256, r.folders, r.labels, r.modified) for r in found] == [
        ("B", ["a/"], ["L"], "2020-01-06 00:00:00"), ("A", ["a/"], ["L"], "2020-01-03 00:00:00"),
    ]
    assert [r.f_name for r in media.images_of_folder(cards, "d1", "a/", rows=1).collect()] == ["b.jpg"]
    assert media.images_of_folder_total(cards, "d1", "a/").first()[0] == 2


def _tree(make):
    places = ["a/b/", "a/b/c/", "a/x_files/", "a/x_files", "", "b/", "a//", "/", "a/b"]
    cards = make.cards(*[
        {"f_parent": p, "f_name": f"{n}.jpg", "f_size": s, "sha256": h, "device_uid": d}
        for p in places for d in ("d1", "d2") for n, s, h in [(1, 3 << 20, "A"), (2, 5, "B"), (3, 0, "B"), (4, None, None)]
    ])
    category = make.categories((1, "A", "1.jpg"), (2, "B", "2.jpg"), (1, "B", "other.jpg"), (9, "C", "c.jpg"))
    return cards, category, make.rules({"id": 1, "category_type": "Photo"}, {"id": 2, "category_type": "Work"})


def test_folder_totals_answer_every_depth(make):
    cards, category, rules = _tree(make)
    totals = folder_totals.folder_totals(cards, category, rules)
    for depth in (1, 2, 3, 4, 6):
        expected = folders.storage_by_folder(cards, category, rules, "d1", depth)
        assert rows(folder_totals.storage_from_totals(totals, "d1", depth), *expected.columns) == rows(expected)
        assert rows(folder_totals.folders_from_totals(totals, "d1", depth - 1)) == rows(folders.folders_at_depth(cards, "d1", depth - 1))
    for value, depth in [("a", 2), ("b", 3), ("", 2), ("", 3), ("", 5), ("c", 4), ("none", 2)]:
        expected = folders.explore_folder(cards, category, rules, "d2", value, depth)
        assert rows(folder_totals.explore_from_totals(totals, "d2", value, depth), *expected.columns) == rows(expected)


def test_folder_totals_follow_changes(make):
    cards, category, rules = _tree(make)
    sums = lambda df: folder_totals.folder_totals(df, category, rules)
    gone, new = cards.filter("f_name = '1.jpg' OR f_parent = 'b/'"), cards.filter("device_uid = 'd2'").withColumn("f_parent", F.lit("n/"))
    after = cards.join(gone.select("id"), "id", "left_anti").select(*cards.columns).unionByName(new)
    merged = folder_totals.merge_totals(sums(cards), sums(new), sums(gone))
    columns = merged.columns
    key = lambda df: sorted(str(tuple(r)) for r in df.withColumn("size", F.coalesce("size", F.lit(0))).select(columns).collect())
    assert key(merged) == key(sums(after))


def test_more_media_types(spark, make):
    from shelfmark.settings import MIME_TYPES
    from shelfmark.sources import listing

    seen = make.listing("d1", "a/x.HEIC", "a/y.jpg", "a/z")
    known = lambda **more: rows(listing.scan_files(seen, **more), "f_name", "f_mime_type_java")
    assert known() == [("x.HEIC", None), ("y.jpg", "image/jpeg"), ("z", None)]
    assert known(mime_types={**MIME_TYPES, "heic": "image/heic"})[0] == ("x.HEIC", "image/heic")
    assert known(mime_types={}) == [("x.HEIC", None), ("y.jpg", None), ("z", None)]
