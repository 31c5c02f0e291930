"""Catalogue tables derived from the TPC-H-like tables.

Suppliers are devices, parts are contents, and a line item places a part in a folder of a supplier's device.
"""

from __future__ import annotations

from functools import cached_property

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.functions.paths import file_id, sha256_text, thumbnail_key
from shelfmark.operators import content
from shelfmark.schema import DEVICE, EXIF
from shelfmark.session import tune

RULES = """
SELECT * FROM VALUES
  (1, 'Photo', 'Trip', 'Sea', array('A/F/m1/', 'A/F/m2/'), true, 'sea'),
  (2, 'Photo', 'Home', 'Cat', array('R/F/m3/'), true, CAST(NULL AS STRING)),
  (3, 'Work', 'Src', 'Web', array('N/O/'), false, 'web'),
  (4, 'Work', 'Doc', 'Scan', array('A/F/m'), true, 'scan')
AS t(id, category_type, category, sub_category, f_path, is_begins, description)
"""
# Tasks that the lines of one part are spread over.
_SHARES = 4


def _text(*parts) -> Column:
    return F.concat(*[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])


class Catalogue:
    """The derived tables of one data folder, each built when it is asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = tune(spark)
        self.sf_dir = sf_dir.rstrip("/")

    def source(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def device(self) -> DataFrame:
        key, uid = F.col("s_suppkey"), _text("dev-", F.col("s_suppkey"))
        scanned = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
        known = {
            "id": key.cast("int"), "uid": uid, "name": F.col("s_name"),
            "label_v": F.when(key % 10 == 1, uid).otherwise(F.col("s_name")),
            "visible": key % 7 != 0, "reliable": key % 4 != 0,
            "path_scan_date": F.when(key % 9 != 0, scanned),
            "job_path_scan": key % 11 == 5, "job_calc_crc": key % 50 == 3, "job_calc_exif": key % 13 == 7,
            "job_resize": F.lit(False),
        }
        return self.source("supplier").select(
            *[known.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in DEVICE.fields]
        )

    @cached_property
    def mounted(self) -> DataFrame:
        uid = _text("dev-", F.col("s_suppkey"))
        return self.source("supplier").filter("s_acctbal > 0").select(
            uid.alias("uuid"), F.concat(F.lit("/mnt/"), uid).alias("mountpoint")
        )

    @cached_property
    def part_file(self) -> DataFrame:
        return self._as_files(self.source("part"))

    @staticmethod
    def _as_files(parts: DataFrame, *more: str) -> DataFrame:
        """Rows with the columns of ``part`` as contents; behind a join, hashes and names need not travel to it."""
        key = F.col("p_partkey")
        kind = key % 5

        def by_kind(*values: str | None) -> Column:
            choice = F.when(kind == 0, F.lit(values[0]))
            for n, value in enumerate(values[1:], 1):
                choice = choice.when(kind == n, F.lit(value))
            return choice

        name = F.concat(
            F.when(kind < 2, "IMG_").otherwise(""), F.col("p_name"), F.lit(" "), key.cast("string"),
            by_kind(".jpg", ".JPG", ".mp4", ".js", ""),
        )
        return parts.select(
            *more, "p_partkey", name.alias("f_name"), by_kind("jpg", "JPG", "mp4", "js", None).alias("f_extension"),
            by_kind("image/jpeg", "image/jpeg", "video/mp4", "text/javascript", None).alias("f_mime_type_java"),
            (key % 17 * 1_500_000).alias("f_size"),
            F.when(key % 10 != 9, sha256_text(_text("part-", key))).alias("sha256"),
            "p_brand", "p_type", "p_size",
        )

    @staticmethod
    def _parent() -> Column:
        return F.concat(
            F.col("l_returnflag"), F.lit("/"), F.col("l_linestatus"), F.lit("/m"), F.month("l_shipdate").cast("string"),
            F.when(F.col("l_linenumber") == 7, "/page_files/").otherwise("/"),
        )

    def _files(self, lines: DataFrame) -> DataFrame:
        """Line items as (device, folder, part) with their first and last day, and the part as a content.

        Lines are shuffled once, by part and a share of the devices, and meet each part in all shares, so that a part on
        many lines is spread over several tasks.
        """
        share = F.pmod(F.xxhash64("l_suppkey"), F.lit(_SHARES)).cast("int")
        days = lines.select("l_suppkey", "l_partkey", self._parent().alias("f_parent"), "l_shipdate", share.alias("share"))
        placed = days.repartition("l_partkey", "share").groupBy("l_suppkey", "l_partkey", "f_parent", "share").agg(
            F.min("l_shipdate").alias("f_creation_date"), F.max("l_shipdate").alias("f_last_modified_date")
        )
        shares = F.explode(F.sequence(F.lit(0), F.lit(_SHARES - 1)))
        parts = self.source("part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size", shares.alias("p_share"))
        joined = placed.join(parts, (F.col("l_partkey") == F.col("p_partkey")) & (F.col("share") == F.col("p_share")))
        found = joined.withColumn("device_uid", _text("dev-", F.col("l_suppkey")))
        return self._as_files(found, "device_uid", "f_parent", "f_creation_date", "f_last_modified_date")

    @cached_property
    def card_with_part(self) -> DataFrame:
        joined = self._files(self.source("lineitem"))
        return joined.select(
            file_id(F.col("device_uid"), F.col("f_parent"), F.col("f_name")).alias("id"), "device_uid", "f_parent",
            "f_name", "f_extension", "f_creation_date", "f_last_modified_date", "f_size", "f_mime_type_java", "sha256",
            F.lower("f_name").alias("f_name_lc"), "p_partkey", "p_brand", "p_type", "p_size",
        )

    @cached_property
    def file_card(self) -> DataFrame:
        return self.card_with_part.drop("p_partkey", "p_brand", "p_type", "p_size")

    @cached_property
    def category_rule(self) -> DataFrame:
        return self.spark.sql(RULES)

    @cached_property
    def category_fc(self) -> DataFrame:
        key = F.col("p_partkey")
        named = self.part_file.filter((key % 3 != 0) & F.col("sha256").isNotNull())
        return named.select((key % 4 + 1).cast("int").alias("id"), "sha256", "f_name")

    @cached_property
    def exif(self) -> DataFrame:
        photos = self.card_with_part.filter((F.col("f_mime_type_java") == "image/jpeg") & (F.col("p_partkey") % 20 != 0))
        even, size = F.col("p_size") % 2 == 0, F.col("p_size")
        known = {
            "id": F.col("id"), "make": F.col("p_brand"), "model": F.col("p_type"),
            "gps_latitude_ref": F.when(even, "N"), "gps_latitude": F.when(even, size.cast("string")),
            "gps_latitude_dec": F.when(even, size), "gps_longitude_dec": F.when(even, -size),
        }
        return photos.select(*[known.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in EXIF.fields])

    @cached_property
    def image_resize(self) -> DataFrame:
        made = self.part_file.filter(
            (F.col("f_mime_type_java") == "image/jpeg") & F.col("sha256").isNotNull() & (F.col("p_partkey") % 4 == 0)
        )
        key = thumbnail_key(F.col("sha256"), F.col("f_name"), F.col("f_extension"))
        return made.select("sha256", "f_name", key.alias("file_id"))

    @cached_property
    def job_path_move(self) -> DataFrame:
        """One job per device and folder "A/F/m1...": eight such folders, so eight numbers per device."""
        month = F.regexp_extract("f_parent", r"m(\d+)/", 1).cast("int")
        code = F.when(month == 1, 0).otherwise(month - 9) * 2 + F.when(F.col("f_parent").contains("page"), 1).otherwise(0)
        folders = self.file_card.filter(F.col("f_parent").startswith("A/F/m1")).select("device_uid", "f_parent").distinct()
        device = F.substring_index("device_uid", "-", -1).cast("bigint")
        return folders.select(
            (device * 8 + code + 1).alias("id"), "device_uid", F.col("f_parent").alias("path_from"),
            F.concat(F.lit("archive/"), "f_parent").alias("path_to"), F.lit(None).cast("timestamp_ntz").alias("done"),
        )

    @cached_property
    def listing(self) -> DataFrame:
        """A later scan: heavy line items are gone, some files changed, some are new."""
        lines = self.source("lineitem").filter("l_quantity < 45")
        files = self._files(lines)
        changed, resized = F.col("p_brand").isin("Brand#1", "Brand#2"), F.col("p_brand") == "Brand#3"
        names = F.array_compact(
            F.array(
                F.col("f_name"), F.when(F.col("p_type") == "PROMO", F.concat(F.lit("copy of "), "f_name")),
                F.when(F.col("p_type") == "LARGE", _text("Main", F.col("p_partkey"), ".class")),
            )
        )
        one_day = F.expr("INTERVAL 1 DAY")
        when = F.col("f_last_modified_date")
        found = files.select("*", F.explode(names).alias("name")).select(
            "device_uid", F.concat("f_parent", "name").alias("path"),
            F.when(changed, F.col("f_size") + 1).when(resized, F.col("f_size") + 7).otherwise(F.col("f_size")).alias("length"),
            F.col("f_creation_date").alias("creation_time"),
            F.when(changed, when + one_day).otherwise(when).alias("modification_time"), F.lit(False).alias("denied"),
        )
        clutter = lines.groupBy(_text("dev-", F.col("l_suppkey")).alias("device_uid"), self._parent().alias("f_parent")).agg(
            F.min("l_shipdate").alias("creation_time"), F.max("l_shipdate").alias("modification_time")
        ).select(
            "device_uid", F.concat("f_parent", F.lit("Thumbs.db")).alias("path"), F.lit(1).cast("bigint").alias("length"),
            "creation_time", "modification_time", F.lit(False).alias("denied"),
        )
        uid, start = _text("dev-", F.col("s_suppkey")), F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
        library = self.source("supplier").select(
            uid.alias("device_uid"), _text("A/node_modules/lib", F.col("s_suppkey"), ".js").alias("path"),
            F.lit(5).cast("bigint").alias("length"), start.alias("creation_time"), start.alias("modification_time"),
            F.lit(False).alias("denied"),
        )
        locked = self.source("supplier").filter("s_acctbal < 0").select(
            uid.alias("device_uid"), F.lit("locked/").alias("path"), F.lit(None).cast("bigint").alias("length"),
            start.alias("creation_time"), start.alias("modification_time"), F.lit(True).alias("denied"),
        )
        return found.unionByName(clutter).unionByName(library).unionByName(locked)

    @cached_property
    def scan_path(self) -> DataFrame:
        starts = F.explode(F.array(F.lit("A"), F.lit("N/O"), F.lit("missing/dir")))
        return self.source("supplier").select(_text("dev-", F.col("s_suppkey")).alias("device_uid"), starts.alias("path"))

    @cached_property
    def tags(self) -> DataFrame:
        """Metadata tags of the photos and videos, dates in all layouts, broken and missing ones among them."""
        size, when = F.col("p_size"), F.col("f_last_modified_date")
        photo = F.col("f_mime_type_java") == "image/jpeg"
        photo_date = (
            F.when(size % 11 == 0, "2010:05:19 11:33: 7").when(size % 7 == 0, "0000:00:00 00:00:00")
            .when(size % 3 == 0, F.date_format(when, "yyyy/MM/dd HH:mm:ss"))
            .otherwise(F.date_format(when, "yyyy:MM:dd HH:mm:ss"))
        )
        zone = F.when(size % 5 == 0, " MSK ").otherwise(" +03:00 ")
        video_date = F.concat(F.date_format(when, "EEE MMM dd HH:mm:ss"), zone, F.date_format(when, "yyyy"))
        degrees = F.when(size % 10 == 0, F.lit("0")).otherwise(size.cast("string"))
        south = F.when(size % 10 == 0, F.lit("0")).otherwise((-size).cast("string"))
        placed = photo & (size % 2 == 0)
        values = {
            "Make": F.when(photo, F.col("p_brand")), "Model": F.when(photo, F.col("p_type")),
            "Date/Time": F.when(photo, photo_date), "Creation Time": F.when(~photo, video_date),
            "GPS Latitude": F.when(placed, degrees), "gpsLatitudeD": F.when(placed, degrees),
            "gpsLongitudeD": F.when(placed, south), "Orientation": F.when(photo, F.lit("Top")),
        }
        rows = F.array(*[F.struct(F.lit(tag).alias("tag"), value.alias("value")) for tag, value in values.items()])
        media = self.card_with_part.filter(F.col("f_mime_type_java").isin("image/jpeg", "video/mp4"))
        return media.select("id", F.inline(rows)).filter("value IS NOT NULL")

    @cached_property
    def name_list(self) -> DataFrame:
        """A name per line item, as a phone would list them, and one video per part that no device holds."""
        lines = self.source("lineitem").select("l_partkey").join(
            self.part_file.select("p_partkey", "f_name"), F.col("l_partkey") == F.col("p_partkey")
        )
        videos = self.source("part").select(_text("VID_", F.col("p_name"), ".mp4").alias("f_name"))
        return lines.select("f_name").unionByName(videos)

    @cached_property
    def block_report(self) -> DataFrame:
        """One report of block devices per supplier, its disk two levels below the root."""
        uid, empty = _text("dev-", F.col("s_suppkey")), F.lit(None).cast("string")

        def node(name: Column, fstype: Column, label: Column, uuid: Column, mount: Column, *children: Column) -> Column:
            fields = [name.alias("name"), fstype.alias("fstype"), label.alias("label"), uuid.alias("uuid"),
                      mount.alias("mountpoint")]
            return F.struct(*fields, *([F.array(*children).alias("children")] if children else []))

        label = F.when(F.col("s_acctbal") > 0, F.col("s_name"))
        disk = node(F.lit("sda1"), F.lit("ext4"), label, uid, F.concat(F.lit("/mnt/"), uid))
        swap = node(F.lit("sda2"), F.lit("swap"), empty, empty, F.lit("[SWAP]"))
        root = node(F.lit("sda"), empty, empty, empty, empty, disk, swap)
        report = F.struct(F.array(node(F.lit("bus"), empty, empty, empty, empty, root)).alias("blockdevices"))
        text = F.to_json(report, {"ignoreNullFields": "false"})
        return self.source("supplier").select("s_suppkey", text.alias("report"))

    @cached_property
    def broken_block_report(self) -> DataFrame:
        """Reports of which every tenth was cut off on its way."""
        cut = F.substring("report", F.lit(1), F.length("report") - 7)
        report = F.when(F.col("s_suppkey") % 10 == 4, cut).otherwise(F.col("report"))
        return self.block_report.withColumn("report", report)

    def document_files(self, root: str) -> DataFrame:
        """The documents as files below a folder, written by the tasks that read them: a work list of one device."""

        def write(batches):
            files, base = content.open_folder(root)
            for batch in batches:
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    folder = f"{base.rstrip('/')}/files/{doc_id % 50}"
                    files.create_dir(folder, recursive=True)
                    with files.open_output_stream(f"{folder}/{doc_id}.txt", compression=None) as file:
                        file.write((text or "").encode())
                device = pa.array(["texts"] * batch.num_rows)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), device], names=["doc_id", "f_size", "device_uid"])

        rows = self.source("documents").select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("f_size"))
        columns = "doc_id bigint, f_size bigint, device_uid string"
        rows.mapInArrow(write, columns).write.parquet(f"{root}/written")
        written = self.spark.read.schema(columns).parquet(f"{root}/written")
        key = F.col("doc_id").cast("string")
        return written.select(
            "doc_id", key.alias("id"), "device_uid", F.concat((F.col("doc_id") % 50).cast("string"), F.lit("/")).alias("f_parent"),
            F.concat(key, F.lit(".txt")).alias("f_name"), "f_size",
        )

    @cached_property
    def volume(self) -> DataFrame:
        name = F.when(F.col("s_acctbal") < 0, "USB").when(F.col("s_nationkey") == 3, "").otherwise(F.col("s_name"))
        text = F.when(F.col("s_nationkey") == 5, name).otherwise(F.concat(name, F.lit(" ("), _text("/media/", F.col("s_suppkey")), F.lit(")")))
        return self.source("supplier").select(name.alias("name"), text.alias("text"))

    @cached_property
    def rule_xml(self) -> DataFrame:
        """One <rule> element per customer; nation 7 lacks the last output."""

        def entry(text: Column) -> Column:
            return F.concat(F.lit('<outputEntry id="o"><text>'), text, F.lit("</text></outputEntry>"))

        quote = F.lit('"')
        last = F.when(F.col("c_nationkey") == 7, "").otherwise(entry(F.concat(quote, "c_name", quote)))
        rule = F.concat(
            F.lit('<rule id="r"><inputEntry id="i"><text>"home/'), "c_name", F.lit('"</text></inputEntry>'),
            entry((F.col("c_acctbal") > 0).cast("string")), entry(F.concat(quote, "c_mktsegment", quote)),
            entry(F.concat(quote, _text("N", F.col("c_nationkey")), quote)), last, F.lit("</rule>"),
        )
        return self.source("customer").select(rule.alias("rule"))

    @cached_property
    def rule_request(self) -> DataFrame:
        """Requests for rules: one per customer, nation 0 without a type, and more paths for a known rule."""
        new = self.source("customer").select(
            F.when(F.col("c_nationkey") == 0, "").otherwise(F.col("c_mktsegment")).alias("category_type"),
            _text("N", F.col("c_nationkey")).alias("category"), F.lit("Any").alias("sub_category"),
            F.concat(F.lit("home/"), "c_name", F.lit("/")).alias("path"), (F.col("c_acctbal") > 0).alias("is_begins"),
            F.when(F.col("c_acctbal") > 5000, F.col("c_name")).otherwise("").alias("description"),
        )
        known = self.source("region").select(
            F.lit("Photo").alias("category_type"), F.lit("Trip").alias("category"), F.lit("Sea").alias("sub_category"),
            _text("A/", F.col("r_name"), "/").alias("path"), F.lit(False).alias("is_begins"),
            F.lit("other").alias("description"),
        )
        return new.unionByName(known)

    @cached_property
    def move_request(self) -> DataFrame:
        """Requests to move: the finalised folders "R/F", some without a target, and folders that have a job."""
        folders = self.file_card.select("device_uid", "f_parent").distinct()
        chosen = folders.filter(F.col("f_parent").startswith("R/F/") | F.col("f_parent").startswith("A/F/m1"))
        target = F.when(F.col("f_parent").contains("page"), "").otherwise(F.concat(F.lit("old/"), "f_parent"))
        return chosen.select("device_uid", F.col("f_parent").alias("path_from"), target.alias("path_to"))

    @cached_property
    def seen_device(self) -> DataFrame:
        """Mounted devices named after customers; some are suppliers' and known."""
        return self.source("customer").select(
            F.col("c_name").alias("name"), F.col("c_mktsegment").alias("label"),
            _text("dev-", F.col("c_custkey")).alias("uuid"), F.lit("/mnt").alias("mountpoint"), F.lit("ext4").alias("fstype"),
        )
