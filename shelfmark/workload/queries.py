"""One entry per operator: the Spark job on the derived tables and the SQL that states its result.

Arrays and dates are shown as text, decimals as doubles, so both engines print them alike.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.functions.text import kilobytes
from shelfmark.operators import changes, content, metadata, moves, rules, snapshot, stored, thumbnails
from shelfmark.plans import categories, copies, devices, folder_totals, folders, media, name_index, search
from shelfmark.session import shared_dir, write_once
from shelfmark.sources import listing, names, rule_files, tables, volumes
from shelfmark.streaming import catalogue as streams
from shelfmark.streaming import worklist
from shelfmark.workload.oracle import with_tables
from shelfmark.workload.tables import Catalogue

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

PART_11 = hashlib.sha256(b"part-11").hexdigest().upper()
_CARD_SQL = (
    "id, device_uid, f_parent, f_name, f_extension, f_creation_date, f_last_modified_date, f_size, f_mime_type_java, "
    "sha256, f_name_lc"
)


def query(sql: str | None = None):
    """Register a function of the derived tables under its name."""

    def register(build: Callable[[Catalogue], DataFrame]) -> Callable[[Catalogue], DataFrame]:
        name = build.__name__
        QUERIES[name] = lambda spark, sf_dir: build(Catalogue(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = with_tables(sql)
        return build

    return register


def _now() -> Column:
    return F.lit("2024-06-15 12:00:00").cast("timestamp_ntz")


def _joined(name: str) -> Column:
    return F.array_join(name, ", ").alias(name)


# --- sources ---------------------------------------------------------------------------------------------------------


@query(f"SELECT {_CARD_SQL} FROM file_card")
def table_scan(c: Catalogue) -> DataFrame:
    """Written as a stored catalogue and scanned from there with its declared types."""
    root = shared_dir(c.spark, "table")
    changes.write_file_cards(c.file_card, f"{root}/file_card")
    return tables.read_table(c.spark, root, "file_card")


@query("SELECT device_uid, f_parent FROM scan_dir")
def scan_dirs(c: Catalogue) -> DataFrame:
    return listing.scan_dirs(c.listing, c.scan_path)


@query(f"SELECT {_CARD_SQL} FROM new_card")
def scan_files(c: Catalogue) -> DataFrame:
    return listing.scan_files(c.listing)


@query("""
SELECT DISTINCT f_parent, denied FROM (
  SELECT split_part(f_parent, '/', 1) AS f_parent, f_parent = 'locked/' AS denied FROM listed_dir
  WHERE device_uid = 'dev-1'
)""")
def child_dirs(c: Catalogue) -> DataFrame:
    return listing.child_dirs(c.listing, "dev-1", "#")


@query("""
SELECT 'sda1' AS name, CASE WHEN s_acctbal > 0 THEN s_name ELSE '' END AS label, 'dev-' || s_suppkey AS uuid,
  '/mnt/dev-' || s_suppkey AS mountpoint, 'ext4' AS fstype
FROM supplier""")
def block_devices(c: Catalogue) -> DataFrame:
    return volumes.block_devices(c.block_report)


@query("""
SELECT 'sda1' AS name, CASE WHEN s_acctbal > 0 THEN s_name ELSE '' END AS label, 'dev-' || s_suppkey AS uuid,
  '/mnt/dev-' || s_suppkey AS mountpoint, 'ext4' AS fstype
FROM supplier WHERE s_suppkey % 10 <> 4""")
def block_devices_of_whole_reports(c: Catalogue) -> DataFrame:
    """Reports that were cut off stop nobody: the others' devices come out, and ``broken_block_reports`` names them."""
    return volumes.block_devices(c.broken_block_report)


@query("SELECT s_suppkey FROM supplier WHERE s_suppkey % 10 = 4")
def broken_block_reports(c: Catalogue) -> DataFrame:
    return volumes.broken_reports(c.broken_block_report).select("s_suppkey")


@query("""
SELECT '' AS name, s_name AS label, s_name AS uuid, '/media/' || s_suppkey AS mountpoint, '' AS fstype
FROM supplier WHERE s_acctbal >= 0 AND s_nationkey NOT IN (3, 5)
  AND s_name IN (SELECT s_name FROM supplier WHERE s_acctbal >= 0 GROUP BY s_name HAVING count(*) = 1)
UNION ALL
SELECT '', 'USB', 'USB', min('/media/' || s_suppkey), '' FROM supplier WHERE s_acctbal < 0
HAVING count(*) = 1 AND min(s_nationkey) <> 5""")
def unique_volumes(c: Catalogue) -> DataFrame:
    return volumes.unique_volumes(c.volume)


@query("""
SELECT 'USB' AS name, count(*) AS volumes FROM supplier WHERE s_acctbal < 0 HAVING count(*) > 1
UNION ALL
SELECT s_name, count(*) FROM supplier WHERE s_acctbal >= 0 AND s_nationkey <> 3 GROUP BY s_name HAVING count(*) > 1""")
def repeated_volumes(c: Catalogue) -> DataFrame:
    return volumes.repeated_volumes(c.volume)


@query(r"SELECT replace(unnest(string_split(text, chr(10))), chr(13), '') AS f_name FROM documents")
def name_list(c: Catalogue) -> DataFrame:
    lines = c.source("documents").select(F.explode(F.split("text", "\n", -1)).alias("value"))
    return names.names_of_lines(lines)


@query("""
SELECT c_mktsegment AS category_type, 'N' || c_nationkey AS category, c_name AS sub_category, 'home/' || c_name AS path,
  c_acctbal > 0 AS is_begins, '' AS description
FROM customer WHERE c_nationkey <> 7""")
def rules_from_xml(c: Catalogue) -> DataFrame:
    return rule_files.rules_from_xml_text(c.rule_xml)


# --- table changes ---------------------------------------------------------------------------------------------------


@query(f"SELECT {_CARD_SQL} FROM file_card UNION ALL SELECT {_CARD_SQL} FROM new_card")
def insert_rows(c: Catalogue) -> DataFrame:
    return changes.insert_rows(c.file_card, listing.scan_files(c.listing))


@query("""
SELECT CASE WHEN p_type = 'PROMO' THEN 3 ELSE CAST(p_partkey % 4 + 1 AS INTEGER) END AS id, sha256, f_name FROM part_file
WHERE sha256 IS NOT NULL AND (p_partkey % 3 <> 0 OR p_type = 'PROMO')""")
def upsert_category(c: Catalogue) -> DataFrame:
    promoted = c.part_file.filter("p_type = 'PROMO' AND sha256 IS NOT NULL")
    rows = promoted.select(F.lit(3).alias("id"), "sha256", "f_name")
    return changes.upsert_rows(c.category_fc, rows, ["sha256", "f_name"])


@query("""
SELECT f.id, f.device_uid, f.f_parent, f.f_name, f.f_extension,
  CASE WHEN n.id IS NULL THEN f.f_creation_date ELSE n.f_creation_date END AS f_creation_date,
  CASE WHEN n.id IS NULL THEN f.f_last_modified_date ELSE n.f_last_modified_date END AS f_last_modified_date,
  CASE WHEN n.id IS NULL THEN f.f_size ELSE n.f_size END AS f_size, f.f_mime_type_java,
  CASE WHEN n.id IS NULL THEN f.sha256 END AS sha256, f.f_name_lc
FROM file_card f LEFT JOIN new_card n ON n.id = f.id""")
def update_fields(c: Catalogue) -> DataFrame:
    fields = ["f_creation_date", "f_last_modified_date", "f_size", "sha256"]
    return changes.update_rows(c.file_card, listing.scan_files(c.listing), ["id"], fields)


@query(f"SELECT {_CARD_SQL} FROM file_card WHERE id NOT IN (SELECT id FROM new_card)")
def delete_rows(c: Catalogue) -> DataFrame:
    return changes.delete_rows(c.file_card, listing.scan_files(c.listing), ["id"])


@query("""
SELECT e.id, e.make, e.model FROM exif e JOIN file_card f ON f.id = e.id WHERE f.f_parent NOT LIKE 'A/%'""")
def cascade_files(c: Catalogue) -> DataFrame:
    kept = changes.delete_where(c.file_card, F.col("f_parent").startswith("A/"))
    return changes.cascade_files(kept, c.exif).select("id", "make", "model")


@query("SELECT id, sha256, f_name FROM category_fc WHERE id IN (SELECT id FROM category_rule WHERE category_type <> 'Work')")
def cascade_rules(c: Catalogue) -> DataFrame:
    kept = changes.delete_where(c.category_rule, F.col("category_type") == "Work")
    return changes.cascade_rules(kept, c.category_fc)


@query("""
SELECT '{"f_parent":"' || f_parent || '","f_name":"' || f_name || '","sha256":'
  || coalesce('"' || sha256 || '"', 'null') || '}' AS json FROM file_card""")
def json_rows(c: Catalogue) -> DataFrame:
    return changes.to_json_rows(c.file_card.select("f_parent", "f_name", "sha256"))


# --- snapshots -------------------------------------------------------------------------------------------------------


@query(f"SELECT {_CARD_SQL} FROM merged")
def merge_snapshot(c: Catalogue) -> DataFrame:
    seen = _kept(c, c.listing, "listing")
    scope = _kept(c, listing.scan_dirs(seen, c.scan_path), "scope")
    return snapshot.merge_snapshot(_kept(c, c.file_card, "cards"), listing.scan_files(seen), scope)


def _kept(c: Catalogue, df: DataFrame, name: str) -> DataFrame:
    """The rows as a stored table, as an operator that reads them several times wants them."""
    path = shared_dir(c.spark, name)
    write_once(df, path)
    return c.spark.read.schema(df.schema).parquet(path)


@query(f"SELECT {_CARD_SQL} FROM merged")
def merge_stored(c: Catalogue) -> DataFrame:
    """The catalogue in files of folder ranges, of which the scan rewrites only those it touches."""
    root = shared_dir(c.spark, "stored")
    seen = _kept(c, c.listing, "listing")
    scope = _kept(c, listing.scan_dirs(seen, c.scan_path), "scope")
    stored.create(c.file_card, root)
    stored.merge_stored(c.spark, root, listing.scan_files(seen), scope)
    return stored.read_cards(c.spark, root)


@query(f"SELECT {_CARD_SQL} FROM merged")
def sync_device(c: Catalogue) -> DataFrame:
    return snapshot.sync_device(c.file_card, c.listing, c.scan_path)


@query("""
WITH old AS (SELECT o.* FROM file_card o SEMI JOIN scan_dir d ON o.device_uid = d.device_uid AND o.f_parent = d.f_parent),
new AS (SELECT n.* FROM new_card n SEMI JOIN scan_dir d ON n.device_uid = d.device_uid AND n.f_parent = d.f_parent)
SELECT coalesce(o.id, n.id) AS id,
  CASE WHEN o.id IS NULL THEN 'insert' WHEN n.id IS NULL THEN 'delete' ELSE 'update' END AS change,
  CASE WHEN n.id IS NULL THEN o.f_last_modified_date ELSE n.f_last_modified_date END AS f_last_modified_date,
  CASE WHEN n.id IS NULL THEN o.f_size ELSE n.f_size END AS f_size,
  CASE WHEN n.id IS NULL THEN o.sha256 END AS sha256
FROM old o FULL JOIN new n ON n.id = o.id
WHERE o.id IS NULL OR n.id IS NULL OR o.f_last_modified_date <> n.f_last_modified_date""")
def scan_changes(c: Catalogue) -> DataFrame:
    scope = listing.scan_dirs(c.listing, c.scan_path)
    found = snapshot.scan_changes(c.file_card, listing.scan_files(c.listing), scope)
    return found.select("id", "change", "f_last_modified_date", "f_size", "sha256")


@query(f"""
SELECT {_CARD_SQL} FROM file_card f WHERE device_uid <> 'dev-1'
  OR f_parent IN (SELECT f_parent FROM listed_dir WHERE device_uid = 'dev-1')""")
def drop_missing_dirs(c: Catalogue) -> DataFrame:
    return snapshot.drop_missing_dirs(c.file_card, c.listing, "dev-1")


@query("""
SELECT id, uid, name, label_v, visible, path_scan_date FROM device
UNION ALL
SELECT CAST((SELECT max(id) FROM device) + row_number() OVER (ORDER BY sha256('dev-' || c_custkey)) AS INTEGER),
  'dev-' || c_custkey, c_name, c_mktsegment, TRUE, NULL
FROM customer WHERE 'dev-' || c_custkey NOT IN (SELECT uid FROM device)""")
def import_devices(c: Catalogue) -> DataFrame:
    imported = snapshot.import_devices(c.device, c.seen_device)
    return imported.select("id", "uid", "name", "label_v", "visible", "path_scan_date")


def _old_ids(c: Catalogue) -> DataFrame:
    """Cards with the key of an older layout, taken from the lower-case name."""
    old = F.upper(F.sha2(F.concat("device_uid", "f_parent", "f_name_lc"), 256))
    return c.file_card.withColumn("id", old)


@query(f"SELECT {_CARD_SQL} FROM file_card")
def rekey(c: Catalogue) -> DataFrame:
    return snapshot.rekey(_old_ids(c))


@query("SELECT count(*) AS replaced FROM file_card WHERE f_name <> f_name_lc")
def rekey_count(c: Catalogue) -> DataFrame:
    return snapshot.rekey_count(_old_ids(c))


# --- content ---------------------------------------------------------------------------------------------------------


@query("""
SELECT f.id, f.device_uid, f.f_parent, f.f_name, f.f_size FROM file_card f JOIN device d ON d.uid = f.device_uid
WHERE d.uid = 'dev-1' AND NOT d.job_path_scan AND f.sha256 IS NULL AND f.f_size > 0 AND f.f_size <= 20000000
ORDER BY f.f_size, f.id LIMIT 1000""")
def hash_worklist(c: Catalogue) -> DataFrame:
    return content.hash_worklist(c.device, c.file_card, "dev-1", max_size=20_000_000)


@query("SELECT uid, job_calc_crc FROM candidate")
def hash_candidates(c: Catalogue) -> DataFrame:
    return content.hash_candidates(c.device, c.mounted)


_EVERY_DEVICE = 2_000_000_000


@query("SELECT id, device_uid, f_parent, f_name, f_size FROM due_file")
def hash_all(c: Catalogue) -> DataFrame:
    return content.hash_all(c.device, c.file_card, c.mounted, _EVERY_DEVICE, max_files=25, max_size=20_000_000)


@query("SELECT doc_id, upper(sha256(text)) AS sha256 FROM documents")
def content_hash(c: Catalogue) -> DataFrame:
    return content.content_hash(c.source("documents"), "text").select("doc_id", "sha256")


@query("SELECT doc_id, upper(sha256(coalesce(text, ''))) AS sha256 FROM documents")
def hash_files(c: Catalogue) -> DataFrame:
    """Every document as a file of its own, hashed from the files' bytes."""
    root = shared_dir(c.spark, "files")
    work = c.document_files(root)
    mounts = c.spark.createDataFrame([("texts", f"{root}/files")], "uuid string, mountpoint string")
    return content.hash_files(work, mounts).select(F.col("id").cast("bigint").alias("doc_id"), "sha256")


@query("SELECT doc_id, strlen(coalesce(text, '')) AS length, upper(sha256(coalesce(text, ''))) AS sha256 FROM documents")
def hash_folder(c: Catalogue) -> DataFrame:
    root = shared_dir(c.spark, "files")
    c.document_files(root)
    name = F.regexp_extract("path", r"(\d+)\.txt$", 1).cast("bigint")
    return content.hash_folder(c.spark, f"{root}/files").select(name.alias("doc_id"), "length", "sha256")


@query(f"""
SELECT f.* REPLACE (coalesce(f.sha256, CASE WHEN d.id IS NOT NULL THEN upper(sha256(f.f_name)) END) AS sha256)
FROM file_card f LEFT JOIN due_file d ON d.id = f.id""")
def apply_hashes(c: Catalogue) -> DataFrame:
    due = content.hash_all(c.device, c.file_card, c.mounted, _EVERY_DEVICE, max_files=25, max_size=20_000_000)
    return content.apply_hashes(c.file_card, content.content_hash(due, "f_name").select("id", "sha256"))


@query("""
SELECT uid, job_calc_crc AND uid NOT IN (SELECT uid FROM candidate) AS job_calc_crc,
  CASE WHEN uid IN (SELECT uid FROM candidate) THEN TIMESTAMP '2024-06-15 12:00:00' END AS crc_date
FROM device""")
def mark_hash_job(c: Catalogue) -> DataFrame:
    due = content.hash_candidates(c.device, c.mounted)
    return content.mark_hash_job(c.device, due, running=False, now=_now()).select("uid", "job_calc_crc", "crc_date")


@query("""
SELECT uid, CASE WHEN uid = 'dev-1' THEN TIMESTAMP '2024-06-15 12:00:00' ELSE path_scan_date END AS path_scan_date,
  CASE WHEN uid = 'dev-1' THEN TIMESTAMP '2024-06-15 12:00:00' END AS exif_date
FROM device""")
def mark_scanned(c: Catalogue) -> DataFrame:
    scanned = content.mark_scanned(c.device, "dev-1", _now())
    return content.mark_exif_done(scanned, "dev-1", _now()).select("uid", "path_scan_date", "exif_date")


@query("""
SELECT id, f_parent, f_name, f_mime_type_java FROM file_card
WHERE device_uid = 'dev-1' AND f_mime_type_java IN ('image/jpeg', 'video/mp4') AND id NOT IN (SELECT id FROM exif)""")
def exif_worklist(c: Catalogue) -> DataFrame:
    return metadata.exif_worklist(c.file_card, c.exif, "dev-1")


@query("""
SELECT id,
  CASE WHEN f_mime_type_java = 'image/jpeg' AND p_size % 7 = 0 THEN NULL ELSE date_trunc('second', t) END AS date_time,
  CASE WHEN f_mime_type_java = 'image/jpeg' THEN p_brand END AS make,
  CASE WHEN f_mime_type_java = 'image/jpeg' THEN p_type END AS model,
  CASE WHEN f_mime_type_java = 'image/jpeg' AND p_size % 2 = 0
    THEN CASE WHEN p_size % 10 = 0 THEN '0' ELSE CAST(p_size AS VARCHAR) END END AS gps_latitude,
  CASE WHEN f_mime_type_java = 'image/jpeg' AND p_size % 2 = 0 AND p_size % 10 <> 0 THEN CAST(p_size AS DOUBLE) END AS lat,
  CASE WHEN f_mime_type_java = 'image/jpeg' AND p_size % 2 = 0 AND p_size % 10 <> 0 THEN CAST(-p_size AS DOUBLE) END AS lon
FROM tag WHERE NOT broken""")
def exif_normalize(c: Catalogue) -> DataFrame:
    files = c.file_card.filter(F.col("f_mime_type_java").isNotNull()).select("id", "f_mime_type_java")
    lat, lon = F.col("gps_latitude_dec").cast("double"), F.col("gps_longitude_dec").cast("double")
    return metadata.exif_normalize(files, c.tags).select(
        "id", "date_time", "make", "model", "gps_latitude", lat.alias("lat"), lon.alias("lon")
    )


_MISSING_THUMBNAILS = """
SELECT min(f_parent) AS f_parent, f_name, f_extension, sha256 FROM file_card f
WHERE device_uid = 'dev-1' AND f_mime_type_java = 'image/jpeg' AND sha256 IS NOT NULL
  AND NOT EXISTS (SELECT 1 FROM image_resize i WHERE i.sha256 = f.sha256 AND i.f_name = f.f_name)
GROUP BY f_name, f_extension, sha256"""


@query(_MISSING_THUMBNAILS)
def thumbnail_worklist(c: Catalogue) -> DataFrame:
    return thumbnails.thumbnail_worklist(c.file_card, c.image_resize, "dev-1")


@query(f"""
SELECT sha256, f_name, file_id, 'images-cache/' || left(sha256, 2) || '/' || file_id AS cache_path FROM (
  SELECT sha256, f_name, sha256 || '_' || upper(sha256(f_name)) || '.' || f_extension AS file_id
  FROM ({_MISSING_THUMBNAILS})
)""")
def thumbnail_key(c: Catalogue) -> DataFrame:
    return thumbnails.thumbnail_keys(thumbnails.thumbnail_worklist(c.file_card, c.image_resize, "dev-1"))


# --- rules -----------------------------------------------------------------------------------------------------------


@query("""
SELECT id, sha256, f_name FROM category_fc
UNION ALL
SELECT min(r.id), f.sha256, f.f_name FROM file_card f
JOIN (SELECT id, unnest(f_path) AS path FROM category_rule) r ON starts_with(f.f_parent, r.path)
WHERE f.sha256 IS NOT NULL
  AND NOT EXISTS (SELECT 1 FROM category_fc x WHERE x.sha256 = f.sha256 AND x.f_name = f.f_name)
GROUP BY f.sha256, f.f_name""")
def apply_rules(c: Catalogue) -> DataFrame:
    return rules.apply_rules(c.file_card, c.category_rule, c.category_fc)


@query("""
WITH asked AS (
  SELECT c_mktsegment AS category_type, 'N' || c_nationkey AS category, 'Any' AS sub_category,
    'home/' || c_name || '/' AS path, c_acctbal > 0 AS is_begins,
    CASE WHEN c_acctbal > 5000 THEN c_name END AS description
  FROM customer WHERE c_nationkey <> 0
)
SELECT id, category_type, category, sub_category, is_begins, description, array_to_string(f_path, ', ')
  || CASE WHEN id = 1 THEN (SELECT string_agg(', A/' || r_name || '/', '' ORDER BY r_name) FROM region) ELSE '' END AS f_path
FROM category_rule
UNION ALL
SELECT CAST(4 + row_number() OVER (ORDER BY sha256(category_type || chr(1) || category || chr(1) || sub_category)) AS INTEGER),
  category_type, category, sub_category, bool_or(is_begins), min(description), string_agg(DISTINCT path, ', ' ORDER BY path)
FROM asked GROUP BY category_type, category, sub_category""")
def upsert_rule(c: Catalogue) -> DataFrame:
    levels = ["id", "category_type", "category", "sub_category", "is_begins", "description"]
    return rules.upsert_rules(c.category_rule, c.rule_request).select(*levels, _joined("f_path"))


# --- moves -----------------------------------------------------------------------------------------------------------


@query("""
SELECT id, device_uid, path_from, path_to FROM job_path_move
UNION ALL
SELECT (SELECT max(id) FROM job_path_move) + row_number() OVER (ORDER BY sha256(device_uid || chr(1) || f_parent)),
  device_uid, f_parent, 'old/' || f_parent
FROM (SELECT DISTINCT device_uid, f_parent FROM file_card WHERE f_parent LIKE 'R/F/%' AND f_parent NOT LIKE '%page%')""")
def create_move_job(c: Catalogue) -> DataFrame:
    jobs = moves.create_move_jobs(c.job_path_move, c.move_request)
    return jobs.select("id", "device_uid", "path_from", "path_to")


@query("""
SELECT DISTINCT device_uid, f_parent AS path_from, CASE WHEN f_parent LIKE '%page%' THEN '' ELSE 'old/' || f_parent END AS path_to
FROM file_card WHERE f_parent LIKE 'A/F/m1%' OR (f_parent LIKE 'R/F/%' AND f_parent LIKE '%page%')""")
def rejected_move_job(c: Catalogue) -> DataFrame:
    return moves.rejected_move_jobs(c.job_path_move, c.move_request)


@query("""
SELECT id, device_uid, path_from, path_to FROM job_path_move
WHERE NOT (device_uid = 'dev-1' AND path_from = 'A/F/m1/')""")
def delete_move_job(c: Catalogue) -> DataFrame:
    jobs = moves.delete_move_job(c.job_path_move, "dev-1", "A/F/m1/")
    return jobs.select("id", "device_uid", "path_from", "path_to")


def _plan(c: Catalogue) -> DataFrame:
    return moves.plan_moves(c.job_path_move, c.file_card, max_jobs=2, max_files=3)


@query("SELECT job_id, id, new_id, device_uid, f_parent, path_to, f_name FROM planned_move")
def plan_moves(c: Catalogue) -> DataFrame:
    return _plan(c)


@query("""
SELECT f.* REPLACE (coalesce(p.new_id, f.id) AS id, coalesce(p.path_to, f.f_parent) AS f_parent)
FROM file_card f LEFT JOIN planned_move p ON p.id = f.id""")
def apply_moves(c: Catalogue) -> DataFrame:
    return moves.apply_moves(c.file_card, _plan(c))


@query("""
SELECT id, device_uid, path_from, CASE WHEN NOT EXISTS (
    SELECT 1 FROM file_card f WHERE f.device_uid = j.device_uid AND f.f_parent = j.path_from
      AND f.id NOT IN (SELECT id FROM planned_move)
  ) THEN TIMESTAMP '2024-06-15 12:00:00' END AS done
FROM job_path_move j""")
def close_jobs(c: Catalogue) -> DataFrame:
    left = moves.apply_moves(c.file_card, _plan(c))
    return moves.close_jobs(c.job_path_move, left, _now()).select("id", "device_uid", "path_from", "done")


# --- reports: devices ------------------------------------------------------------------------------------------------


@query("""
SELECT name, label_v, uid, description, path_scan_date, reliable, coalesce(n, 0) AS without_hash,
  CAST(date_diff('day', CAST(path_scan_date AS DATE), DATE '2024-06-15') AS INTEGER) AS days_since_scan
FROM device LEFT JOIN (
  SELECT device_uid, count(*) AS n FROM file_card WHERE sha256 IS NULL AND f_size > 0 GROUP BY device_uid
) ON device_uid = uid WHERE visible""")
def device_index(c: Catalogue) -> DataFrame:
    return devices.device_index(c.device, c.file_card, as_of=F.to_date(_now()))


@query("SELECT name, label_v, uid, description, path_scan_date, visible, reliable FROM device")
def device_list(c: Catalogue) -> DataFrame:
    return devices.device_list(c.device)


@query("""
SELECT f_parent, f_name, f_last_modified_date FROM (
  SELECT * FROM file_card WHERE device_uid = 'dev-1' ORDER BY id LIMIT 200)""")
def files_of_device(c: Catalogue) -> DataFrame:
    return devices.files_of_device(c.file_card, "dev-1")


@query("""
SELECT f_parent, f_name, f_last_modified_date FROM (
  SELECT * FROM file_card WHERE device_uid = 'dev-1' AND NOT ends_with(f_parent, '_files')
  ORDER BY f_last_modified_date DESC, id LIMIT 200)""")
def files_of_device_by_date(c: Catalogue) -> DataFrame:
    return devices.files_of_device_by_date(c.file_card, "dev-1")


@query("SELECT device_uid, count(*) AS files FROM file_card GROUP BY device_uid")
def count_by_device(c: Catalogue) -> DataFrame:
    return devices.count_by_device(c.file_card)


@query("""
SELECT label_v, path_scan_date, count(*) AS files FROM device JOIN file_card ON device_uid = label_v
WHERE label_v = 'dev-1' AND sha256 IS NULL AND f_size > 0 GROUP BY label_v, path_scan_date""")
def debug_unhashed(c: Catalogue) -> DataFrame:
    return devices.debug_unhashed(c.device, c.file_card, "dev-1")


@query("""
SELECT f_parent, f_name, f_last_modified_date FROM (
  SELECT * FROM file_card WHERE device_uid = 'dev-1' AND (f_parent = 'A/F' OR starts_with(f_parent, 'A/F/'))
  ORDER BY id LIMIT 100)""")
def files_under_path(c: Catalogue) -> DataFrame:
    return devices.files_under_path(c.file_card, "dev-1", "A/F")


@query("""
SELECT f_parent, f_name, f_last_modified_date FROM (
  SELECT * FROM file_card WHERE device_uid = 'dev-1' AND sha256 IS NULL AND f_size > 0
  ORDER BY f_last_modified_date DESC, id LIMIT 200)""")
def files_without_hash(c: Catalogue) -> DataFrame:
    return devices.files_without_hash(c.file_card, "dev-1")


@query("SELECT count(*) AS files FROM file_card WHERE device_uid = 'dev-1' AND sha256 IS NULL AND f_size > 0")
def files_without_hash_total(c: Catalogue) -> DataFrame:
    return devices.files_without_hash_total(c.file_card, "dev-1")


# --- reports: copies -------------------------------------------------------------------------------------------------

_BACKUP = ["dev-2", "dev-3"]
_LOST = """
FROM file_card a WHERE a.sha256 IS NOT NULL AND a.device_uid = 'dev-1' AND NOT EXISTS (
  SELECT 1 FROM file_card b WHERE b.sha256 = a.sha256 AND b.device_uid <> 'dev-1'
    AND b.device_uid IN ('dev-2', 'dev-3') AND NOT ends_with(b.f_parent, '_files'))"""


@query(f"SELECT f_parent, f_name, f_last_modified_date {_LOST} ORDER BY f_parent, f_name LIMIT 200")
def no_backup(c: Catalogue) -> DataFrame:
    return copies.no_backup(c.file_card, "dev-1", _BACKUP)


@query(f"SELECT count(*) AS files {_LOST}")
def no_backup_total(c: Catalogue) -> DataFrame:
    return copies.no_backup_total(c.file_card, "dev-1", _BACKUP)


# Contents with the least device that may hold them; a device on the second list hides its contents.
_HOLDER = """holder AS (
  SELECT sha256, min(device_uid) AS device_uid FROM file_card WHERE device_uid NOT IN ('dev-0', 'dev-1') GROUP BY sha256
), shown AS (SELECT * FROM holder WHERE device_uid NOT IN ('dev-10', 'dev-11'))"""


@query(f"""
WITH copies AS (
  SELECT sha256, f_name, count(*) AS n FROM file_card WHERE sha256 IS NOT NULL GROUP BY sha256, f_name
), named AS (
  SELECT x.sha256, x.f_name, category_type, description, sum(n) AS n
  FROM category_fc x JOIN category_rule ON category_rule.id = x.id JOIN copies USING (sha256, f_name)
  GROUP BY x.sha256, x.f_name, category_type, description
), {_HOLDER}
SELECT sha256, f_name, category_type, description, device_uid FROM named JOIN shown USING (sha256) WHERE n < 20
ORDER BY sha256, f_name LIMIT 200""")
def few_copies_by_category(c: Catalogue) -> DataFrame:
    return copies.few_copies_by_category(
        c.file_card, c.category_fc, c.category_rule, ["dev-0", "dev-1"], ["dev-10", "dev-11"], copies=20
    )


_RECENT = f"""
WITH versions AS (
  SELECT sha256, f_name, f_last_modified_date FROM file_card WHERE {{since}} AND sha256 IS NOT NULL GROUP BY ALL HAVING count(*) = 1
), {_HOLDER}
SELECT sha256, f_name, device_uid, f_last_modified_date FROM versions JOIN shown USING (sha256)
ORDER BY f_last_modified_date DESC, sha256, f_name LIMIT {{rows}}"""


@query(_RECENT.format(since="TRUE", rows=200))
def few_copies_recent(c: Catalogue) -> DataFrame:
    return copies.few_copies_recent(c.file_card, ["dev-0", "dev-1"], ["dev-10", "dev-11"])


@query(_RECENT.format(since="f_last_modified_date >= TIMESTAMP '2000-06-01 00:00:00'", rows=100000))
def few_copies_last_year(c: Catalogue) -> DataFrame:
    as_of = F.lit("2001-06-15 12:00:00").cast("timestamp_ntz")
    return copies.few_copies_recent(c.file_card, ["dev-0", "dev-1"], ["dev-10", "dev-11"], rows=100_000, as_of=as_of)


@query("""
SELECT sha256, f_name, f_size, count(*) AS copies, replace(format('{:,}', f_size // 1024), ' ', '') AS size_kb
FROM file_card WHERE device_uid = 'dev-1' AND f_size > 20000000 AND sha256 IS NOT NULL
GROUP BY sha256, f_name, f_size HAVING count(*) > 1""")
def duplicates(c: Catalogue) -> DataFrame:
    return copies.duplicates(c.file_card, "dev-1").withColumn("size_kb", kilobytes(F.col("f_size")))


@query(f"""
SELECT f.id, f.f_name, f.f_parent, f.f_last_modified_date, r.category_type, r.description
FROM file_card f LEFT JOIN category_fc c ON c.sha256 = f.sha256 AND c.f_name = f.f_name
LEFT JOIN category_rule r ON r.id = c.id
WHERE f.device_uid = (SELECT min(device_uid) FROM file_card WHERE sha256 = '{PART_11}') AND f.sha256 = '{PART_11}'""")
def copies_on_device(c: Catalogue) -> DataFrame:
    first = c.file_card.filter(F.col("sha256") == PART_11).agg(F.min("device_uid")).scalar()
    return copies.copies_on_device(c.file_card, c.category_fc, c.category_rule, first, PART_11)


@query("""
SELECT f_name, 'adb pull /sdcard/DCIM/Camera/' || f_name || ' /tmp/cp_back/' || f_name AS command FROM (
  SELECT f_name FROM name_list EXCEPT ALL SELECT f_name FROM file_card
) WHERE starts_with(f_name, 'IMG_') OR starts_with(f_name, 'VID_')""")
def names_not_catalogued(c: Catalogue) -> DataFrame:
    return copies.names_not_catalogued(c.name_list, c.file_card)


_COMMANDS = """
WITH listed AS (
  SELECT f_name, count(*) AS n FROM name_list WHERE regexp_matches(f_name, '^(IMG|VID)_') GROUP BY f_name
), known AS (SELECT f_name, count(*) AS k FROM file_card GROUP BY f_name
), missing AS (SELECT f_name, n - coalesce(k, 0) AS times FROM listed LEFT JOIN known USING (f_name) WHERE n > coalesce(k, 0))"""


@query(f"{_COMMANDS} SELECT CAST(sum(times) AS BIGINT) AS commands FROM missing")
def names_not_catalogued_total(c: Catalogue) -> DataFrame:
    return copies.names_not_catalogued_total(c.name_list, c.file_card)


@query(f"""{_COMMANDS}
SELECT value, count(*) AS lines FROM (
  SELECT 'adb pull /sdcard/DCIM/Camera/' || f_name || ' /tmp/cp_back/' || f_name AS value, unnest(range(times)) FROM missing
) GROUP BY value""")
def copy_script(c: Catalogue) -> DataFrame:
    """The commands as a text script, written twice over and read back."""
    path = f"{shared_dir(c.spark, 'script')}/copy"
    commands = copies.names_not_catalogued(c.name_list, c.file_card).select("command")
    changes.write_script(commands.limit(0), path)
    changes.write_script(commands, path, replace=True)
    return c.spark.read.text(path).groupBy("value").agg(F.count(F.lit(1)).alias("lines"))


@query("""
SELECT f_name_lc, sha256, 0 AS part, count(*) AS files, string_agg(DISTINCT device_uid, ', ' ORDER BY device_uid) AS devices,
  string_agg(DISTINCT f_parent, ', ' ORDER BY f_parent) AS folders
FROM file_card WHERE sha256 IS NOT NULL GROUP BY sha256, f_name_lc""")
def duplicate_content_overview(c: Catalogue) -> DataFrame:
    return copies.duplicate_content_overview(c.file_card)


@query("SELECT DISTINCT sha256, f_name_lc, device_uid, f_parent FROM file_card WHERE sha256 IS NOT NULL")
def duplicate_content_places(c: Catalogue) -> DataFrame:
    return copies.duplicate_content_places(c.file_card)


@query(f"""
SELECT id, device_uid, f_parent, f_name, f_mime_type_java, mountpoint || '/' || f_parent || f_name AS path
FROM file_card JOIN mounted ON uuid = device_uid WHERE sha256 = '{PART_11}' ORDER BY id LIMIT 1""")
def locate_copy(c: Catalogue) -> DataFrame:
    return copies.locate_copy(c.file_card, c.mounted, PART_11)


_NATURAL = "device_uid = 'dev-1' AND f_parent = 'A/F/m1/'"


@query(f"""
SELECT device_uid, f_parent, f_name, f_mime_type_java FROM file_card
WHERE {_NATURAL} AND f_name = (SELECT min(f_name) FROM file_card WHERE {_NATURAL})""")
def file_by_natural_key(c: Catalogue) -> DataFrame:
    first = c.file_card.filter(_NATURAL).agg(F.min("f_name")).scalar()
    return copies.file_by_natural_key(c.file_card, "dev-1", "A/F/m1/", first)


@query(f"SELECT f_name, f_parent, device_uid FROM file_card WHERE sha256 = '{PART_11}'")
def paths_by_hash(c: Catalogue) -> DataFrame:
    return copies.paths_by_hash(c.file_card, PART_11)


@query("""
SELECT device_uid, f_parent, count(*) AS files FROM file_card
WHERE sha256 IN (SELECT sha256 FROM file_card WHERE f_parent = 'A/F/m1/page_files/' AND sha256 IS NOT NULL)
GROUP BY device_uid, f_parent""")
def paths_sharing_content(c: Catalogue) -> DataFrame:
    return copies.paths_sharing_content(c.file_card, "A/F/m1/page_files/")


# --- reports: categories ---------------------------------------------------------------------------------------------

_WITH_RULE = """file_card f {join} category_fc c ON c.sha256 = f.sha256 AND c.f_name = f.f_name
LEFT JOIN category_rule r ON r.id = c.id"""
_LEFT_RULE, _INNER_RULE = _WITH_RULE.format(join="LEFT JOIN"), _WITH_RULE.format(join="JOIN")
_OPEN = f"{_LEFT_RULE} WHERE c.id IS NULL AND f.f_size > 0 AND NOT ends_with(f.f_parent, '_files')"


@query(f"""
SELECT f_parent, count(*) AS files FROM {_LEFT_RULE}
WHERE f.device_uid = 'dev-1' AND f.sha256 IS NOT NULL AND c.id IS NULL AND NOT ends_with(f_parent, '_files')
  AND NOT ends_with(f_parent, '_files/')
GROUP BY f_parent HAVING count(*) > 2""")
def big_uncategorised_dirs(c: Catalogue) -> DataFrame:
    return categories.big_uncategorised_dirs(c.file_card, c.category_fc, "dev-1", max_files=2)


@query(f"SELECT r.category_type, count(*) AS files FROM {_LEFT_RULE} WHERE f.f_size > 0 GROUP BY r.category_type")
def count_by_category_type(c: Catalogue) -> DataFrame:
    return categories.count_by_category_type(c.file_card, c.category_fc, c.category_rule)


@query(f"""
SELECT r.category, count(*) AS files FROM {_INNER_RULE} WHERE r.category_type = 'Work' AND f.f_size > 0
GROUP BY r.category""")
def count_by_category(c: Catalogue) -> DataFrame:
    return categories.count_by_category(c.file_card, c.category_fc, c.category_rule, "Work")


@query(f"""
SELECT r.sub_category, count(*) AS files FROM {_INNER_RULE}
WHERE r.category_type = 'Work' AND r.category = 'Doc' AND f.f_size > 0 GROUP BY r.sub_category""")
def count_by_sub_category(c: Catalogue) -> DataFrame:
    return categories.count_by_sub_category(c.file_card, c.category_fc, c.category_rule, "Work", "Doc")


@query(f"""
SELECT f_parent, strftime(max(f_last_modified_date), '%Y-%m-%d') AS date FROM (
  SELECT DISTINCT f.f_parent, f.f_last_modified_date FROM {_OPEN}
  ORDER BY f_last_modified_date DESC, f_parent LIMIT 500
) GROUP BY f_parent""")
def uncategorised_dirs_by_date(c: Catalogue) -> DataFrame:
    found = categories.uncategorised_dirs_by_date(c.file_card, c.category_fc)
    return found.select("f_parent", F.col("date").cast("string").alias("date"))


@query(f"""
SELECT DISTINCT f.sha256, f.f_parent, f.f_name, f.f_last_modified_date FROM {_OPEN}
ORDER BY f_last_modified_date DESC, f.sha256 DESC NULLS FIRST, f_parent, f.f_name LIMIT 500""")
def uncategorised_files_by_date(c: Catalogue) -> DataFrame:
    return categories.uncategorised_files_by_date(c.file_card, c.category_fc)


@query(f"""
SELECT f.f_parent, count(*) AS files FROM {_OPEN} AND lower(coalesce(f.f_extension, '')) = 'jpg'
GROUP BY f.f_parent ORDER BY files DESC, f_parent LIMIT 500""")
def uncategorised_dirs_by_extension(c: Catalogue) -> DataFrame:
    return categories.uncategorised_dirs_by_extension(c.file_card, c.category_fc, "Jpg")


@query(f"""
SELECT f.device_uid, f.f_parent, f.f_name, f.f_last_modified_date, f.sha256, r.category_type, r.category, r.sub_category,
  r.description
FROM {_LEFT_RULE} WHERE starts_with(f.f_parent, 'A/F/m1')""")
def files_with_category(c: Catalogue) -> DataFrame:
    return categories.files_with_category(c.file_card, c.category_fc, c.category_rule, "A/F/m1", begins=True)


@query(f"""
SELECT x.f_parent, any_value(t.devices) AS devices, any_value(t.files) AS files, any_value(j.path_to) AS path_to
FROM (SELECT DISTINCT f.f_parent FROM {_INNER_RULE}
  WHERE r.category_type = 'Photo' AND r.category = 'Trip' AND r.sub_category = 'Sea') x
JOIN (SELECT f_parent, count(*) AS files, string_agg(DISTINCT device_uid, ', ' ORDER BY device_uid) AS devices
  FROM file_card GROUP BY f_parent) t ON t.f_parent = x.f_parent
LEFT JOIN (SELECT path_from, min(path_to) AS path_to FROM job_path_move GROUP BY path_from) j ON j.path_from = x.f_parent
GROUP BY x.f_parent""")
def paths_of_category(c: Catalogue) -> DataFrame:
    return categories.paths_of_category(
        c.file_card, c.category_fc, c.category_rule, c.job_path_move, "Photo", "Trip", "Sea"
    )


# --- reports: folders ------------------------------------------------------------------------------------------------


def _types(condition: str) -> str:
    return f"string_agg(DISTINCT r.category_type, ', ' ORDER BY r.category_type) FILTER (WHERE {condition})"


@query(f"""
SELECT split_part(f.f_parent, '/', 1) AS folder, CAST(round(sum(f_size) / 1048576) AS BIGINT) AS size_mib,
  count(*) AS files, count(*) FILTER (WHERE r.id IS NULL) AS uncategorised, {_types('c.id IS NOT NULL')} AS category_types
FROM {_LEFT_RULE} WHERE f.device_uid = 'dev-1' AND f.f_size > 0 GROUP BY 1""")
def storage_by_folder(c: Catalogue) -> DataFrame:
    found = folders.storage_by_folder(c.file_card, c.category_fc, c.category_rule, "dev-1", 1)
    return found.withColumn("category_types", F.array_join("category_types", ", "))


@query("""
WITH segment AS (
  SELECT sha256, string_split(f_parent, '/') AS s FROM file_card
  WHERE device_uid = 'dev-1' AND NOT regexp_matches(f_parent, '_files/?$')
), category AS (
  SELECT sha256, category_type FROM category_fc LEFT JOIN category_rule ON category_rule.id = category_fc.id
), listed AS (
  SELECT coalesce(s[3], '') AS folder, category.sha256 IS NULL AS open, category_type
  FROM segment LEFT JOIN category ON category.sha256 = segment.sha256 WHERE len(s) > 1 AND s[2] = 'F'
)
SELECT folder, count(*) AS files, CAST(count_if(open) AS BIGINT) AS uncategorised,
  array_to_string(list_sort(list_distinct(list(category_type) FILTER (category_type IS NOT NULL))), ', ') AS category_types
FROM listed GROUP BY folder""")
def explore_folder(c: Catalogue) -> DataFrame:
    found = folders.explore_folder(c.file_card, c.category_fc, c.category_rule, "dev-1", "F", 3)
    return found.withColumn("category_types", F.array_join("category_types", ", "))


@query("""
SELECT DISTINCT split_part(f_parent, '/', 4) AS folder FROM file_card
WHERE device_uid = 'dev-1' AND split_part(f_parent, '/', 4) <> ''""")
def folders_at_depth(c: Catalogue) -> DataFrame:
    return folders.folders_at_depth(c.file_card, "dev-1", 3)


def _totals(c: Catalogue) -> DataFrame:
    """Totals of the catalogue before the scan, brought up to date by what the scan changes and back again."""
    cards = _kept(c, c.file_card.select("device_uid", "f_parent", "sha256", "f_name", "f_size"), "cards")
    sums = lambda rows: folder_totals.folder_totals(rows, c.category_fc, c.category_rule)
    early = cards.filter("f_size % 7 <> 3")
    late = cards.filter("f_size % 7 = 3")
    gone = _kept(c, sums(early.filter("f_parent LIKE 'A/%'")), "gone")
    moved = folder_totals.merge_totals(sums(early), sums(late), gone)
    return folder_totals.merge_totals(_kept(c, moved, "totals"), gone, sums(cards.limit(0)))


def storage_by_folder_totals(c: Catalogue) -> DataFrame:
    found = folder_totals.storage_from_totals(_totals(c), "dev-1", 1)
    return found.withColumn("category_types", F.array_join("category_types", ", "))


def explore_folder_totals(c: Catalogue) -> DataFrame:
    found = folder_totals.explore_from_totals(_totals(c), "dev-1", "F", 3)
    return found.withColumn("category_types", F.array_join("category_types", ", "))


def folders_at_depth_totals(c: Catalogue) -> DataFrame:
    return folder_totals.folders_from_totals(_totals(c), "dev-1", 3)


for _build in (storage_by_folder_totals, explore_folder_totals, folders_at_depth_totals):  # the same rows from one table
    query()(_build)
    ORACLES[_build.__name__] = ORACLES[_build.__name__.removesuffix("_totals")]


@query("""
SELECT DISTINCT id, id AS text,
  CASE WHEN id = 'locked' THEN 'images/jstree/stop.png' WHEN id = 'N' THEN 'images/jstree/arrow_right.png' ELSE '' END AS icon,
  id <> 'locked' AS children,
  '{"opened":false,"disabled":false,"selected":' || CASE WHEN id = 'A' THEN 'true' ELSE 'false' END || '}' AS state
FROM (SELECT split_part(f_parent, '/', 1) AS id FROM listed_dir WHERE device_uid = 'dev-1')""")
def scan_tree(c: Catalogue) -> DataFrame:
    nodes = folders.scan_tree(c.listing, c.scan_path, "dev-1", "#")
    return nodes.withColumn("state", F.to_json("state"))


@query("""
SELECT DISTINCT '{"id":"A/' || id || '","text":"' || id || '","icon":"","children":true,"state":'
  || '{"opened":false,"disabled":false,"selected":false}}' AS json
FROM (SELECT split_part(f_parent, '/', 2) AS id FROM listed_dir WHERE device_uid = 'dev-1' AND starts_with(f_parent, 'A/'))
WHERE id <> ''""")
def tree_nodes_json(c: Catalogue) -> DataFrame:
    return changes.to_json_rows(folders.scan_tree(c.listing, c.scan_path, "dev-1", "A"))


# --- reports: search and media ---------------------------------------------------------------------------------------


@query("""
SELECT DISTINCT f_name FROM file_card WHERE f_name_lc LIKE '%img%ring%' ORDER BY f_name LIMIT 100""")
def search_names(c: Catalogue) -> DataFrame:
    return search.search_names(c.file_card, "IMG ring", 500)


@query("""
SELECT DISTINCT f_name FROM file_card WHERE f_name_lc LIKE '%img%ring%' ORDER BY f_name LIMIT 100""")
def search_names_indexed(c: Catalogue) -> DataFrame:
    """The same search through an index of three-letter pieces, which is built first."""
    root = shared_dir(c.spark, "names")
    name_index.write_name_index(c.file_card, root)
    return name_index.search_index(c.spark, root, "IMG ring", 500)


_HITS = """
SELECT DISTINCT f_name_lc, f_name, f_parent, sha256, label_v FROM file_card LEFT JOIN device ON uid = device_uid"""


@query(f"""
WITH hits AS ({_HITS})
SELECT 7 AS draw, (SELECT count(*) FROM hits) AS "recordsTotal",
  (SELECT count(*) FROM hits WHERE f_name_lc LIKE '%red%') AS "recordsFiltered", (
    SELECT string_agg(f_name || '|' || f_parent || '|' || coalesce(sha256, '') || '|' || coalesce(label_v, ''), ';'
      ORDER BY f_parent DESC, f_name_lc, f_name, sha256 NULLS LAST, label_v NULLS LAST)
    FROM (SELECT * FROM hits WHERE f_name_lc LIKE '%red%'
      ORDER BY f_name_lc, f_name, f_parent, sha256 NULLS LAST, label_v NULLS LAST LIMIT 25 OFFSET 50)
  ) AS data, '' AS error""")
def search_page(c: Catalogue) -> DataFrame:
    page = search.search_page(c.file_card, c.device, 7, 50, 25, "Red", 1, "desc")
    shown = F.transform("data", lambda e: F.concat_ws("|", e["name"], e["path"], e["sha256"], e["device"]))
    return page.withColumn("data", F.array_join(shown, ";"))


@query(f"""
WITH hits AS ({_HITS})
SELECT '{{"draw":1,"recordsTotal":' || (SELECT count(*) FROM hits) || ',"recordsFiltered":' || (SELECT count(*) FROM hits)
  || ',"data":[' || (
    SELECT string_agg('{{"name":"' || f_name || '","path":"' || f_parent || '","sha256":"' || coalesce(sha256, '')
      || '","device":"' || coalesce(label_v, '') || '"}}', ',' ORDER BY f_name, f_name_lc, f_parent, sha256 NULLS LAST,
      label_v NULLS LAST)
    FROM (SELECT * FROM hits ORDER BY f_name_lc, f_name, f_parent, sha256 NULLS LAST, label_v NULLS LAST LIMIT 10)
  ) || '],"error":""}}' AS json""")
def json_page(c: Catalogue) -> DataFrame:
    return changes.to_json_rows(search.search_page(c.file_card, c.device, 1, 0, 10))


@query("""
SELECT make, model, strftime(max(f_last_modified_date), '%Y-%m-%d %H:%M:%S') AS newest, count(*) AS files
FROM file_card JOIN exif ON exif.id = file_card.id GROUP BY make, model""")
def exif_devices(c: Catalogue) -> DataFrame:
    return media.exif_devices(c.file_card, c.exif)


@query("""
SELECT DISTINCT f.sha256, f.f_name, f.f_parent AS folders, d.label_v AS labels,
  strftime(f.f_last_modified_date, '%Y-%m-%d %H:%M:%S') AS modified
FROM file_card f JOIN device d ON d.uid = f.device_uid JOIN exif e ON e.id = f.id
WHERE e.make = 'Brand#2' AND e.model = 'ECONOMY'""")
def files_of_exif_device(c: Catalogue) -> DataFrame:
    found = media.files_of_exif_device(c.file_card, c.device, c.exif, "Brand#2", "ECONOMY")
    return found.select("sha256", "f_name", _joined("folders"), _joined("labels"), "modified")


@query("""
SELECT f_parent || f_name AS path, lat AS latitude, lon AS longitude FROM file_card JOIN exif ON exif.id = file_card.id
WHERE gps_latitude IS NOT NULL""")
def gps_points(c: Catalogue) -> DataFrame:
    return media.gps_points(c.file_card, c.exif)


_IMAGES = """
FROM file_card WHERE device_uid = 'dev-1' AND f_parent = 'N/O/m1/' AND sha256 IS NOT NULL AND f_mime_type_java = 'image/jpeg'"""


@query(f"""
SELECT thumbnail, 'images-cache/' || left(sha256, 2) || '/' || thumbnail AS cache_path, sha256, f_name, f_mime_type_java
FROM (SELECT *, sha256 || '_' || upper(sha256(f_name)) || '.' || f_extension AS thumbnail {_IMAGES}
  ORDER BY f_last_modified_date DESC, id LIMIT 350)""")
def images_of_folder(c: Catalogue) -> DataFrame:
    return media.images_of_folder(c.file_card, "dev-1", "N/O/m1/")


@query(f"SELECT count(*) AS images {_IMAGES}")
def images_of_folder_total(c: Catalogue) -> DataFrame:
    return media.images_of_folder_total(c.file_card, "dev-1", "N/O/m1/")


# --- streams ---------------------------------------------------------------------------------------------------------


def _merged_stream(c: Catalogue, root: str, fold_every: int | None = None) -> None:
    """The listing arrives as files of whole folders and is merged in micro-batches."""
    folder = F.substring_index("path", "/", 3)
    write_once(c.listing.repartition(8, "device_uid", folder), f"{root}/arrivals")
    arrivals = streams.read_listings(c.spark, f"{root}/arrivals", files_per_batch=4)
    merge = streams.stream_merge(arrivals, c.scan_path, f"{root}/catalogue", f"{root}/progress", fold_every=fold_every)
    merge.awaitTermination()


@query(f"SELECT {_CARD_SQL} FROM merged")
def stream_merge(c: Catalogue) -> DataFrame:
    root = shared_dir(c.spark, "stream-merge")
    streams.start_catalogue(c.file_card, f"{root}/catalogue")
    _merged_stream(c, root)
    return streams.current_cards(c.spark, f"{root}/catalogue")


@query(f"SELECT {_CARD_SQL} FROM merged")
def stream_merge_compacted(c: Catalogue) -> DataFrame:
    """After every batch the log is folded into the files it touches; old files and the folded log are removed."""
    root = shared_dir(c.spark, "stream-fold")
    streams.start_catalogue(c.file_card, f"{root}/catalogue")
    _merged_stream(c, root, fold_every=1)
    streams.drop_folded(c.spark, f"{root}/catalogue")
    stored.vacuum(c.spark, f"{root}/catalogue/base")
    return streams.current_cards(c.spark, f"{root}/catalogue")


@query("""
SELECT m.* REPLACE (coalesce(m.sha256, CASE WHEN d.id IS NOT NULL THEN upper(sha256(m.f_name)) END) AS sha256)
FROM merged m LEFT JOIN (
  SELECT m.id, row_number() OVER (PARTITION BY m.device_uid ORDER BY m.f_size, m.id) AS rn
  FROM merged m JOIN candidate c ON c.uid = m.device_uid AND NOT c.job_calc_crc
  WHERE m.sha256 IS NULL AND m.f_size > 0 AND m.f_size <= 700000000
) d ON d.id = m.id AND d.rn <= 20""")
def stream_merge_then_hash(c: Catalogue) -> DataFrame:
    """Scans are merged, then two ticks take ten files per device off the kept list; a file's name stands for its bytes."""
    root = shared_dir(c.spark, "stream-list")
    streams.start_catalogue(c.file_card, f"{root}/catalogue")
    worklist.start_worklist(c.spark, f"{root}/catalogue", f"{root}/open")
    _merged_stream(c, root)
    for _ in range(2):
        c.device.select("id").coalesce(1).write.mode("append").parquet(f"{root}/ticks")
    ticks = c.spark.readStream.schema("id int").option("maxFilesPerTrigger", 1).parquet(f"{root}/ticks")
    worklist.stream_hash_open(
        ticks, f"{root}/catalogue", f"{root}/open", c.device, c.mounted, lambda work: content.content_hash(work, "f_name"),
        f"{root}/ticked", max_devices=_EVERY_DEVICE, max_files=10, available_now=True,
    ).awaitTermination()
    hashes = streams.known_hashes(c.spark, f"{root}/open/hashes")
    return content.apply_hashes(streams.current_cards(c.spark, f"{root}/catalogue"), hashes)


@query(f"""
SELECT f.* REPLACE (coalesce(f.sha256, CASE WHEN d.id IS NOT NULL THEN upper(sha256(f.f_name)) END) AS sha256)
FROM file_card f LEFT JOIN (
  SELECT f.id, row_number() OVER (PARTITION BY f.device_uid ORDER BY f.f_size, f.id) AS rn
  FROM file_card f JOIN candidate c ON c.uid = f.device_uid AND NOT c.job_calc_crc
  WHERE f.sha256 IS NULL AND f.f_size > 0 AND f.f_size <= 700000000
) d ON d.id = f.id AND d.rn <= 20""")
def stream_hash(c: Catalogue) -> DataFrame:
    """Two ticks of ten files per device; a file's name stands for its bytes."""
    root = shared_dir(c.spark, "stream-hash")
    c.file_card.write.parquet(f"{root}/cards")
    streams.start_hashes(c.spark, f"{root}/hashes")
    c.device.select("id").coalesce(1).write.parquet(f"{root}/ticks")
    c.device.select("id").coalesce(1).write.mode("append").parquet(f"{root}/ticks")
    ticks = c.spark.readStream.schema("id int").option("maxFilesPerTrigger", 1).parquet(f"{root}/ticks")

    def cards(spark: SparkSession) -> DataFrame:
        return spark.read.schema(c.file_card.schema).parquet(f"{root}/cards")

    streams.stream_hash(
        ticks, cards, c.device, c.mounted, lambda work: content.content_hash(work, "f_name"), f"{root}/hashes",
        f"{root}/progress", max_devices=_EVERY_DEVICE, max_files=10, available_now=True,
    ).awaitTermination()
    return content.apply_hashes(cards(c.spark), streams.known_hashes(c.spark, f"{root}/hashes"))
