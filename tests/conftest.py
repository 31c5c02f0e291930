from __future__ import annotations

import datetime as dt
import hashlib
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from shelfmark import schema  # noqa: E402
from shelfmark.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("8", partitions=4)
    yield session
    session.stop()


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest().upper()


def day(n: int) -> dt.datetime:
    return dt.datetime(2020, 1, 1) + dt.timedelta(days=n)


class Maker:
    """Small tables from the columns a test cares about."""

    def __init__(self, session):
        self.spark = session

    def _table(self, kind, rows, defaults):
        struct = schema.TABLES[kind]
        full = [{**{f.name: None for f in struct.fields}, **defaults(row), **row} for row in rows]
        return self.spark.createDataFrame([tuple(r[f.name] for f in struct.fields) for r in full], struct)

    def cards(self, *rows: dict):
        """device, parent, name; content stands for the bytes, None for a file without a hash."""

        def fill(row):
            device, parent, name = row.get("device_uid", "d1"), row.get("f_parent", "a/"), row.get("f_name", "f.jpg")
            return {
                "id": sha(device + parent + name), "device_uid": device, "f_parent": parent, "f_name": name,
                "f_extension": name.rsplit(".", 1)[1] if "." in name[1:] else None, "f_creation_date": day(0),
                "f_last_modified_date": day(1), "f_size": 10, "f_mime_type_java": "image/jpeg",
                "f_name_lc": name.lower(),
            }

        return self._table("file_card", rows, fill)

    def devices(self, *rows: dict):
        def fill(row):
            return {
                "id": 1, "name": "n", "label_v": "label " + row["uid"], "visible": True, "reliable": True,
                "job_path_scan": False, "job_calc_crc": False, "job_calc_exif": False, "job_resize": False,
            }

        return self._table("device", rows, fill)

    def rules(self, *rows: dict):
        def fill(row):
            return {"category_type": "T", "category": "C", "sub_category": f"S{row['id']}", "f_path": [], "is_begins": True}

        return self._table("category_rule", rows, fill)

    def categories(self, *rows: tuple):
        return self.spark.createDataFrame(list(rows), schema.CATEGORY_FC)

    def jobs(self, *rows: tuple):
        return self.spark.createDataFrame([(*row, None) for row in rows], schema.JOB_PATH_MOVE)

    def listing(self, device: str, *paths, **times):
        rows = []
        for path in paths:
            path, denied = (path[:-1], True) if path.endswith("!") else (path, False)
            rows.append((device, path, None if path.endswith("/") else 10, day(0), times.get("modified", day(1)), denied))
        return self.spark.createDataFrame(rows, schema.LISTING)

    def table(self, rows, ddl):
        return self.spark.createDataFrame(rows, ddl)


@pytest.fixture(scope="session")
def make(spark):
    return Maker(spark)


def rows(df, *columns):
    chosen = df.select(*columns) if columns else df
    return sorted((tuple(r) for r in chosen.collect()), key=lambda r: tuple((v is not None, str(v)) for v in r))


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()
