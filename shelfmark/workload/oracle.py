"""The derived tables once more, as SQL common table expressions."""

from __future__ import annotations

import re

from shelfmark.settings import EXCLUDED_DIRS

_PARENT = """l_returnflag || '/' || l_linestatus || '/m' || month(l_shipdate)
    || CASE WHEN l_linenumber = 7 THEN '/page_files/' ELSE '/' END"""

TABLES = {
    "device": """
SELECT CAST(s_suppkey AS INTEGER) AS id, 'dev-' || s_suppkey AS uid, s_name AS name,
  CASE WHEN s_suppkey % 10 = 1 THEN 'dev-' || s_suppkey ELSE s_name END AS label_v,
  CAST(NULL AS VARCHAR) AS name_v, CAST(NULL AS VARCHAR) AS description,
  s_suppkey % 7 <> 0 AS visible, s_suppkey % 4 <> 0 AS reliable,
  CASE WHEN s_suppkey % 9 <> 0 THEN TIMESTAMP '2024-01-01 00:00:00' END AS path_scan_date,
  CAST(NULL AS TIMESTAMP) AS crc_date, CAST(NULL AS TIMESTAMP) AS exif_date,
  s_suppkey % 11 = 5 AS job_path_scan, s_suppkey % 50 = 3 AS job_calc_crc,
  s_suppkey % 13 = 7 AS job_calc_exif, FALSE AS job_resize
FROM supplier""",
    "mounted": """
SELECT 'dev-' || s_suppkey AS uuid, '/mnt/dev-' || s_suppkey AS mountpoint FROM supplier WHERE s_acctbal > 0""",
    "part_file": """
SELECT p_partkey, p_brand, p_type, p_size,
  CASE WHEN p_partkey % 5 < 2 THEN 'IMG_' ELSE '' END || p_name || ' ' || p_partkey
    || CASE p_partkey % 5 WHEN 0 THEN '.jpg' WHEN 1 THEN '.JPG' WHEN 2 THEN '.mp4' WHEN 3 THEN '.js' ELSE '' END AS f_name,
  CASE p_partkey % 5 WHEN 0 THEN 'jpg' WHEN 1 THEN 'JPG' WHEN 2 THEN 'mp4' WHEN 3 THEN 'js' END AS f_extension,
  CASE p_partkey % 5 WHEN 0 THEN 'image/jpeg' WHEN 1 THEN 'image/jpeg' WHEN 2 THEN 'video/mp4'
    WHEN 3 THEN 'text/javascript' END AS f_mime_type_java,
  p_partkey % 17 * 1500000 AS f_size,
  CASE WHEN p_partkey % 10 <> 9 THEN upper(sha256('part-' || p_partkey)) END AS sha256
FROM part""",
    "card_with_part": f"""
SELECT upper(sha256(device_uid || f_parent || f_name)) AS id, device_uid, f_parent, f_name, f_extension,
  f_creation_date, f_last_modified_date, f_size, f_mime_type_java, sha256, lower(f_name) AS f_name_lc,
  p_partkey, p_brand, p_type, p_size
FROM (
  SELECT 'dev-' || l_suppkey AS device_uid, {_PARENT} AS f_parent, l_partkey,
    min(l_shipdate) AS f_creation_date, max(l_shipdate) AS f_last_modified_date
  FROM lineitem GROUP BY 1, 2, 3
) JOIN part_file ON l_partkey = p_partkey""",
    "file_card": """
SELECT id, device_uid, f_parent, f_name, f_extension, f_creation_date, f_last_modified_date, f_size, f_mime_type_java,
  sha256, f_name_lc
FROM card_with_part""",
    "category_rule": """
SELECT * FROM (VALUES
  (1, 'Photo', 'Trip', 'Sea', ['A/F/m1/', 'A/F/m2/'], TRUE, 'sea'),
  (2, 'Photo', 'Home', 'Cat', ['R/F/m3/'], TRUE, NULL),
  (3, 'Work', 'Src', 'Web', ['N/O/'], FALSE, 'web'),
  (4, 'Work', 'Doc', 'Scan', ['A/F/m'], TRUE, 'scan')
) AS t(id, category_type, category, sub_category, f_path, is_begins, description)""",
    "category_fc": """
SELECT CAST(p_partkey % 4 + 1 AS INTEGER) AS id, sha256, f_name FROM part_file
WHERE sha256 IS NOT NULL AND p_partkey % 3 <> 0""",
    "exif": """
SELECT id, p_brand AS make, p_type AS model, CASE WHEN p_size % 2 = 0 THEN CAST(p_size AS VARCHAR) END AS gps_latitude,
  CASE WHEN p_size % 2 = 0 THEN CAST(p_size AS DOUBLE) END AS lat,
  CASE WHEN p_size % 2 = 0 THEN CAST(-p_size AS DOUBLE) END AS lon
FROM card_with_part WHERE f_mime_type_java = 'image/jpeg' AND p_partkey % 20 <> 0""",
    "image_resize": """
SELECT sha256, f_name, sha256 || '_' || upper(sha256(f_name)) || '.' || f_extension AS file_id FROM part_file
WHERE f_mime_type_java = 'image/jpeg' AND sha256 IS NOT NULL AND p_partkey % 4 = 0""",
    "job_path_move": r"""
SELECT CAST(split_part(device_uid, '-', 2) AS BIGINT) * 8
    + CASE WHEN month = 1 THEN 0 ELSE month - 9 END * 2 + CASE WHEN path_from LIKE '%page%' THEN 1 ELSE 0 END + 1 AS id,
  device_uid, path_from, 'archive/' || path_from AS path_to, CAST(NULL AS TIMESTAMP) AS done
FROM (
  SELECT DISTINCT device_uid, f_parent AS path_from, CAST(regexp_extract(f_parent, 'm(\d+)/', 1) AS INTEGER) AS month
  FROM file_card WHERE f_parent LIKE 'A/F/m1%'
)""",
    "scanned": f"""
SELECT 'dev-' || l_suppkey AS device_uid, {_PARENT} AS f_parent, l_partkey,
  min(l_shipdate) AS creation_time, max(l_shipdate) AS modification_time
FROM lineitem WHERE l_quantity < 45 GROUP BY 1, 2, 3""",
    "seen_file": """
SELECT device_uid, f_parent, f_name,
  f_size + CASE WHEN p_brand IN ('Brand#1', 'Brand#2') THEN 1 WHEN p_brand = 'Brand#3' THEN 7 ELSE 0 END AS f_size,
  creation_time, modification_time + CASE WHEN p_brand IN ('Brand#1', 'Brand#2') THEN INTERVAL 1 DAY ELSE INTERVAL 0 DAY END
    AS modification_time,
  f_extension, f_mime_type_java, p_type, p_partkey
FROM scanned JOIN part_file ON l_partkey = p_partkey""",
    "new_card": """
SELECT upper(sha256(device_uid || f_parent || f_name)) AS id, device_uid, f_parent, f_name, f_extension,
  creation_time AS f_creation_date, modification_time AS f_last_modified_date, f_size, f_mime_type_java,
  CAST(NULL AS VARCHAR) AS sha256, lower(f_name) AS f_name_lc
FROM (
  SELECT * FROM seen_file
  UNION ALL
  SELECT * REPLACE ('copy of ' || f_name AS f_name) FROM seen_file WHERE p_type = 'PROMO'
  UNION ALL
  SELECT 'dev-' || s_suppkey, 'A/node_modules/', 'lib' || s_suppkey || '.js', 5, TIMESTAMP '2024-01-01 00:00:00',
    TIMESTAMP '2024-01-01 00:00:00', 'js', 'text/javascript', NULL, NULL
  FROM supplier
)""",
    "listed_dir": """
SELECT DISTINCT device_uid, array_to_string(list_slice(string_split(f_parent, '/'), 1, depth), '/') || '/' AS f_parent
FROM (
  SELECT device_uid, f_parent, unnest(range(1, len(string_split(f_parent, '/')))) AS depth
  FROM (
    SELECT device_uid, f_parent FROM scanned
    UNION SELECT 'dev-' || s_suppkey, 'A/node_modules/' FROM supplier
    UNION SELECT 'dev-' || s_suppkey, 'locked/' FROM supplier WHERE s_acctbal < 0
  )
)""",
    "scan_dir": rf"""
SELECT device_uid, f_parent FROM listed_dir
WHERE (f_parent LIKE 'A/%' OR f_parent LIKE 'N/O/%') AND NOT regexp_matches(f_parent, '_files')
  AND NOT regexp_matches('/' || f_parent, '/({"|".join(map(re.escape, EXCLUDED_DIRS))})/')""",
    "merged": """
SELECT o.* FROM file_card o ANTI JOIN scan_dir d ON o.device_uid = d.device_uid AND o.f_parent = d.f_parent
UNION ALL
SELECT n.id, n.device_uid, n.f_parent, n.f_name, n.f_extension,
  CASE WHEN o.f_last_modified_date = n.f_last_modified_date THEN o.f_creation_date ELSE n.f_creation_date END,
  n.f_last_modified_date,
  CASE WHEN o.f_last_modified_date = n.f_last_modified_date THEN o.f_size ELSE n.f_size END,
  n.f_mime_type_java, CASE WHEN o.f_last_modified_date = n.f_last_modified_date THEN o.sha256 END, n.f_name_lc
FROM new_card n SEMI JOIN scan_dir d ON n.device_uid = d.device_uid AND n.f_parent = d.f_parent
LEFT JOIN file_card o ON o.id = n.id""",
    "name_list": """
SELECT f_name FROM lineitem JOIN part_file ON l_partkey = p_partkey
UNION ALL
SELECT 'VID_' || p_name || '.mp4' FROM part""",
    "candidate": """
SELECT d.uid, d.job_calc_crc FROM device d SEMI JOIN mounted m ON m.uuid = d.uid
WHERE d.visible AND NOT d.job_calc_exif AND NOT d.job_path_scan AND NOT d.job_resize""",
    "due_file": """
SELECT id, device_uid, f_parent, f_name, f_size FROM (
  SELECT f.*, row_number() OVER (PARTITION BY f.device_uid ORDER BY f.f_size, f.id) AS rn
  FROM file_card f JOIN candidate c ON c.uid = f.device_uid AND NOT c.job_calc_crc
  WHERE f.sha256 IS NULL AND f.f_size > 0 AND f.f_size <= 20000000
) WHERE rn <= 25""",
    "planned_move": """
SELECT job_id, id, new_id, device_uid, f_parent, path_to, f_name FROM (
  SELECT *, row_number() OVER (PARTITION BY new_id ORDER BY job_id, id) AS nth FROM (
    SELECT job_id, f.id, upper(sha256(f.device_uid || path_to || f.f_name)) AS new_id, f.device_uid, f.f_parent, path_to,
      f.f_name, row_number() OVER (PARTITION BY f.device_uid, job_id ORDER BY f.id) AS rn
    FROM file_card f JOIN (
      SELECT id AS job_id, device_uid, path_from, path_to, row_number() OVER (PARTITION BY device_uid ORDER BY id) AS rj
      FROM job_path_move
    ) j ON rj <= 2 AND f.device_uid = j.device_uid AND f.f_parent = j.path_from
  ) WHERE rn <= 3
) p WHERE nth = 1 AND NOT EXISTS (SELECT 1 FROM file_card t WHERE t.id = p.new_id)""",
    "tag": """
SELECT id, f_mime_type_java, p_brand, p_type, p_size, f_last_modified_date AS t,
  CASE WHEN f_mime_type_java = 'image/jpeg' THEN p_size % 11 = 0 ELSE p_size % 5 = 0 END AS broken
FROM card_with_part WHERE f_mime_type_java IN ('image/jpeg', 'video/mp4')""",
}


def with_tables(select: str) -> str:
    """The query with the derived tables it needs defined in front of it."""
    needed: set[str] = set()

    def need(text: str) -> None:
        for name in TABLES:
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                need(TABLES[name])

    need(select)
    definitions = ",\n".join(f"{name} AS ({body})" for name, body in TABLES.items() if name in needed)
    own = select.strip()
    if not needed:
        return own
    return f"WITH {definitions},\n{own[5:]}" if own.startswith("WITH ") else f"WITH {definitions}\n{own}"
