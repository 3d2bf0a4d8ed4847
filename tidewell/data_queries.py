"""The queries on the general data-processing problems: pN_... over the tables of a folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.operators import changelog, differences, incremental, operations, schema_drift, small_files
from tidewell.operators.maintenance import latest_per_key
from tidewell.sources import shared

Query = Callable[[SparkSession, str], DataFrame]

#: The compared fields of the drift checks and how they are normalised.
CHECK_FIELDS = {"deployment_id": "number", "profile": "text", "table_name": "text", "source_count": "number", "mirror_count": "number", "diff": "number", "ok": "boolean", "checked_at": "time", "notes": "text"}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    rows = changelog.apply_feed(table(spark, folder, "update_events"))
    return rows.select(*changelog.KEY, changelog.row_md5(F.col("cells")).alias("row_md5"))


def p1_compacted(spark: SparkSession, folder: str) -> DataFrame:
    """The rows of each table after compaction of the store."""
    store = changelog.take_in(table(spark, folder, "update_events"))
    store.compact()
    return store.read().groupBy("entity", "tbl").agg(F.count("*").alias("n_rows"))


def _last_markers(spark: SparkSession, folder: str) -> DataFrame:
    """The last insert or delete of each key, moves counted as one of each."""
    by_key = changelog.by_key(changelog.changes(table(spark, folder, "update_events")))
    return latest_per_key(by_key.filter("op <> 'U'").select(*changelog.KEY, *changelog.SEQUENCE, "op"), changelog.KEY, changelog.SEQUENCE)


def cdc_delete(spark: SparkSession, folder: str) -> DataFrame:
    """The keys whose last whole change took the row away."""
    return _last_markers(spark, folder).filter("op = 'D'").select(*changelog.KEY)


def cdc_pk_change(spark: SparkSession, folder: str) -> DataFrame:
    """The moves of rows from one key to another, each once."""
    moved = changelog.changes(table(spark, folder, "update_events")).filter(F.col("was").isNotNull())
    return moved.select(*changelog.KEY, "was", *changelog.SEQUENCE).distinct()


def gtid_sets(spark: SparkSession, folder: str) -> DataFrame:
    """The ranges of the last successful checkpoint of each entity."""
    sets = incremental.last_successful(table(spark, folder, "cdc_states")).select("entity", F.inline("c_sets"))
    return sets.select("entity", "source", F.inline("ranges"))


def gtid_union(spark: SparkSession, folder: str) -> DataFrame:
    """The transactions that any committed run of an entity had, as the fewest ranges."""
    good = table(spark, folder, "cdc_states").filter("outcome = 'committed' AND entity IS NOT NULL").select("entity", F.inline(incremental.gtid_sets(F.col("gtid_executed"))))
    return incremental.merged_ranges(good.select("entity", "source", F.inline("ranges")), ["entity", "source"])


def check_differences(spark: SparkSession, folder: str) -> DataFrame:
    source = differences.one_per_key(table(spark, folder, "consistency_checks").select("check_id", *CHECK_FIELDS), "check_id")
    mirror = differences.one_per_key(table(spark, folder, "consistency_checks_mirror").select("check_id", *CHECK_FIELDS, "deleted", "mirror_seq"), "check_id", ["mirror_seq"])
    return differences.differences(source, mirror.filter(~F.coalesce("deleted", F.lit(False))), "check_id", CHECK_FIELDS)


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    one_sided = F.array(F.struct(F.lit("").alias("field"), F.lit(None).cast("string").alias("left_value"), F.lit(None).cast("string").alias("right_value")))
    kind = F.when(F.col("side") == "left", "missing_in_mirror").when(F.col("side") == "right", "missing_in_source").otherwise("value")
    every = check_differences(spark, folder).select("check_id", kind.alias("diff_kind"), F.explode(F.when(F.col("side") == "both", F.col("diffs")).otherwise(one_sided)).alias("d"))
    return every.select("check_id", F.col("d.field").alias("field_name"), "diff_kind")


def p2_values(spark: SparkSession, folder: str) -> DataFrame:
    """The values on both sides of each field that differs."""
    return check_differences(spark, folder).select("check_id", "side", F.inline("diffs"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return operations.found(table(spark, folder, "saved_ops"))


def p3_nodes(spark: SparkSession, folder: str) -> DataFrame:
    return operations.nodes_of(table(spark, folder, "saved_ops"))


def p3_joins(spark: SparkSession, folder: str) -> DataFrame:
    return operations.flat_tables(table(spark, folder, "saved_ops"))["joins"]


def p3_conditions(spark: SparkSession, folder: str) -> DataFrame:
    """The filters of operations, of their joins and of their trees in one table, with the place of the parent."""
    t = operations.flat_tables(table(spark, folder, "saved_ops"))
    out = [t[k].select("op_id", F.lit(k).alias("entity_table"), "entry_path", "parent_path", "field", "op") for k in ("filters", "join_filters", "tree_conditions")]
    return out[0].unionByName(out[1]).unionByName(out[2])


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return schema_drift.report(table(spark, folder, "manifests"), table(spark, folder, "segment_rows"))


def p4_table(spark: SparkSession, folder: str) -> DataFrame:
    """The values of every raw record under the newest columns of its table: one row a value, typed or rescued."""
    rows = table(spark, folder, "segment_rows").select("entity", "tbl", "segment_path", "schema_version", "row_no", "rec_key", "row_json")
    made = schema_drift.consistent(table(spark, folder, "manifests"), rows)
    typed = F.transform("cells", lambda c: F.struct(c["name"].alias("field_name"), c["type"].alias("field_type"), c["number"].alias("number"), c["at"].alias("moment"), c["text"].alias("text"), F.lit(None).cast("string").alias("rescued")))
    kept = F.transform(F.map_entries("_rescued"), lambda e: F.struct(e["key"].alias("field_name"), F.lit(None).cast("string").alias("field_type"), F.lit(None).cast("double").alias("number"), F.lit(None).cast("timestamp_ntz").alias("moment"), F.lit(None).cast("string").alias("text"), e["value"].alias("rescued")))
    none = F.array().cast("array<struct<field_name:string,field_type:string,number:double,moment:timestamp_ntz,text:string,rescued:string>>")
    return made.select("entity", "tbl", "segment_path", "schema_version", "row_no", "rec_key", F.inline(F.concat(typed, F.coalesce(kept, none))))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return small_files.small_files(table(spark, folder, "manifests"), table(spark, folder, "segment_rows"), shared.scratch_path(spark, "segments"))


def p5_compacted(spark: SparkSession, folder: str) -> DataFrame:
    """The records of all listed files once, as they stand in the new files."""
    return small_files.compact_segments(table(spark, folder, "manifests"), table(spark, folder, "segment_rows"), shared.scratch_path(spark, "segments"))[0].drop("out_path")


def p5_files(spark: SparkSession, folder: str) -> DataFrame:
    """Of each table the files before the compaction, its records, and the files after it."""
    records, _ = small_files.compact_segments(table(spark, folder, "manifests"), table(spark, folder, "segment_rows"), shared.scratch_path(spark, "segments"))
    return records.groupBy("entity", "tbl").agg(F.count_distinct("segment_path").alias("files_before"), F.count("*").alias("records"), F.count_distinct("out_path").alias("files_after"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return incremental.unprocessed(table(spark, folder, "update_events"), table(spark, folder, "cdc_states"), shared.scratch_path(spark, "unprocessed"))


def p6_resumed(spark: SparkSession, folder: str) -> DataFrame:
    """The same by two runs, of which the first fails between its write and its commit."""
    return incremental.unprocessed(table(spark, folder, "update_events"), table(spark, folder, "cdc_states"), shared.scratch_path(spark, "resumed"), failures=1)


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (p1_found, p1_compacted, p2_found, p2_values, p3_found, p3_nodes, p3_joins, p3_conditions, p4_found, p4_table, p5_found, p5_compacted, p5_files, p6_found, p6_resumed, cdc_delete, cdc_pk_change, gtid_sets, gtid_union)}


#: In SQL: the number at the end of a log file's name, and a text without outer blanks.
_FILE = "CAST(regexp_extract(binlog_file, '([0-9]+)$', 1) AS BIGINT)"

_FEED = f"""
WITH e AS (
  SELECT DISTINCT entity, tbl, nfc_normalize(pk) AS pk, nfc_normalize(pk_before) AS was, {_FILE} AS f, binlog_pos AS p, row_no AS r, upper(trim(op_type)) AS op, row_columns AS c, row_values AS v
  FROM update_events WHERE trim(coalesce(pk, '')) <> ''),
m AS (SELECT *, op = 'UPDATE' AND trim(coalesce(was, '')) <> '' AND was <> pk AS moved FROM e),
x AS (
  SELECT entity, tbl, pk, f, p, r, CASE WHEN moved THEN 'INSERT' ELSE op END AS op, c, v FROM m
  UNION ALL SELECT entity, tbl, was, f, p, r, 'DELETE', NULL, NULL FROM m WHERE moved),
base AS (SELECT entity, tbl, pk, f, p, r, op FROM x WHERE op <> 'UPDATE' QUALIFY row_number() OVER (PARTITION BY entity, tbl, pk ORDER BY f DESC, p DESC, r DESC) = 1),
cells AS (SELECT entity, tbl, pk, f, p, r, unnest(c) AS col, unnest(v) AS val FROM x WHERE op <> 'DELETE'),
newest AS (SELECT * FROM cells QUALIFY row_number() OVER (PARTITION BY entity, tbl, pk, col ORDER BY f DESC, p DESC, r DESC) = 1),
held AS (
  SELECT b.entity, b.tbl, b.pk, n.col, n.val FROM base b LEFT JOIN newest n ON n.entity = b.entity AND n.tbl = b.tbl AND n.pk = b.pk AND (n.f, n.p, n.r) >= (b.f, b.p, b.r)
  WHERE b.op = 'INSERT')
"""
_ROWS = "SELECT entity, tbl, pk, md5(coalesce(string_agg(col || '=' || val, '|' ORDER BY col) FILTER (WHERE val <> ''), '')) AS row_md5 FROM held GROUP BY ALL"


def _check_sql(with_values: bool = False) -> str:
    number = "coalesce(CAST(TRY_CAST(trim({0}) AS DECIMAL(38,9)) AS VARCHAR), trim({0}))"
    make = {"number": number, "boolean": "CASE lower(trim({0})) WHEN '1' THEN 'true' WHEN '0' THEN 'false' ELSE lower(trim({0})) END", "time": "coalesce(CAST(TRY_CAST({0} AS TIMESTAMP) AS VARCHAR), {0})", "text": "nfc_normalize({0})"}
    cols = ", ".join(f"nullif({make[k].format(f'CAST({f} AS VARCHAR)')}, '') AS {f}, CAST({f} AS VARCHAR) AS raw_{f}" for f, k in CHECK_FIELDS.items())
    shown = "s.check_id, 'both' AS side, '{0}' AS field, s.raw_{0} AS left_value, m.raw_{0} AS right_value" if with_values else "s.check_id, '{0}' AS field_name, 'value' AS diff_kind"
    values = " UNION ALL ".join(f"SELECT DISTINCT {shown.format(f)} FROM s JOIN m USING (check_id) WHERE s.{f} IS DISTINCT FROM m.{f}" for f in CHECK_FIELDS)
    one_sided = """
SELECT DISTINCT check_id, '' AS field_name, 'missing_in_mirror' AS diff_kind FROM s ANTI JOIN m USING (check_id)
UNION ALL SELECT DISTINCT check_id, '', 'missing_in_source' FROM m ANTI JOIN s USING (check_id)
UNION ALL """
    return f"""
WITH s AS (SELECT DISTINCT check_id, {cols} FROM consistency_checks),
m AS (SELECT DISTINCT check_id, {cols} FROM (SELECT * FROM consistency_checks_mirror QUALIFY rank() OVER (PARTITION BY check_id ORDER BY mirror_seq DESC) = 1) WHERE NOT deleted)
{"" if with_values else one_sided}{values}"""


_LISTED = r"""
WITH newest AS (SELECT entity, tbl, segments FROM manifests QUALIFY row_number() OVER (PARTITION BY entity, tbl ORDER BY manifest_version DESC, captured_at DESC) = 1),
raw AS (SELECT entity, tbl, unnest(segments).path AS path FROM newest),
listed AS (SELECT DISTINCT entity, tbl, trim(regexp_replace(regexp_replace('/' || path, '/[^/.]+/\.\./', '/', 'g'), '(/\.?)+(/|$)', '/', 'g'), '/') AS segment_path FROM raw)
"""

_UNPROCESSED = f"""
WITH s AS (SELECT entity, max(run_no) AS run_no FROM cdc_states WHERE outcome = 'committed' GROUP BY entity),
c AS (
  SELECT DISTINCT entity, {_FILE} AS f, binlog_pos AS p, lower(regexp_replace(coalesce(gtid_executed, ''), '\\s', '', 'g')) AS g
  FROM cdc_states JOIN s USING (entity, run_no) WHERE outcome = 'committed'),
parts AS (SELECT entity, unnest(string_split(g, ',')) AS part FROM c WHERE g <> ''),
ranges AS (SELECT entity, split_part(part, ':', 1) AS source, unnest(string_split(part, ':')[2:]) AS w FROM parts),
sets AS (SELECT entity, source, CAST(split_part(w, '-', 1) AS BIGINT) AS lo, CAST(split_part(w, '-', -1) AS BIGINT) AS hi FROM ranges),
e AS (SELECT DISTINCT entity, binlog_file, binlog_pos, row_no, lower(gtid) AS gtid, {_FILE} AS f FROM update_events),
held AS (SELECT DISTINCT e.entity, e.gtid FROM e JOIN sets ON sets.entity = e.entity AND sets.source = split_part(e.gtid, ':', 1) AND CAST(split_part(e.gtid, ':', 2) AS BIGINT) BETWEEN sets.lo AND sets.hi)
SELECT e.entity, e.binlog_file, e.binlog_pos, e.row_no FROM e LEFT JOIN c ON c.entity = e.entity LEFT JOIN held ON held.entity = e.entity AND held.gtid = e.gtid
WHERE c.entity IS NULL OR CASE WHEN e.gtid IS NOT NULL AND c.g <> '' THEN held.gtid IS NULL ELSE (e.f, e.binlog_pos) > (c.f, c.p) END
"""

_DRIFT = """
WITH v AS (
  SELECT entity, tbl, manifest_version AS b, list_transform(original_fields, lambda x: lower(x)) AS fields, list_transform(field_types, lambda x: trim(split_part(lower(x), '(', 1))) AS types,
    list_transform(CASE WHEN len(primary_key_columns) > 0 THEN primary_key_columns ELSE [primary_key] END, lambda x: lower(x)) AS key
  FROM manifests WHERE len(original_fields) > 0 QUALIFY row_number() OVER (PARTITION BY entity, tbl, manifest_version ORDER BY captured_at DESC) = 1),
s AS (
  SELECT *, lag(b) OVER w AS a, lag(fields) OVER w AS was, lag(types) OVER w AS was_types, lag(key) OVER w AS was_key FROM v WINDOW w AS (PARTITION BY entity, tbl ORDER BY b)),
p AS (SELECT * FROM s WHERE a IS NOT NULL),
gone AS (SELECT entity, tbl, a, b, f FROM (SELECT *, unnest(was) AS f FROM p) WHERE NOT list_contains(fields, f)),
fresh AS (SELECT entity, tbl, a, b, f FROM (SELECT *, unnest(fields) AS f FROM p) WHERE NOT list_contains(was, f)),
k AS (SELECT DISTINCT entity, tbl, schema_version, rec_key, row_json, unnest(json_keys(row_json)) AS field FROM segment_rows),
cells AS (SELECT entity, tbl, schema_version, rec_key, lower(field) AS f, json_extract_string(row_json, '$."' || field || '"') AS val FROM k),
recs AS (SELECT DISTINCT entity, tbl, schema_version, rec_key FROM segment_rows),
pairs AS (SELECT g.entity, g.tbl, g.a, g.b, g.f AS g, n.f AS n FROM gone g JOIN fresh n USING (entity, tbl, a, b)),
met AS (
  SELECT q.entity, q.tbl, q.b, q.g, q.n, x.val AS x, y.val AS y FROM pairs q
  JOIN recs ra ON ra.entity = q.entity AND ra.tbl = q.tbl AND ra.schema_version = q.a
  JOIN recs rb ON rb.entity = q.entity AND rb.tbl = q.tbl AND rb.schema_version = q.b AND rb.rec_key = ra.rec_key
  LEFT JOIN cells x ON x.entity = q.entity AND x.tbl = q.tbl AND x.schema_version = q.a AND x.rec_key = ra.rec_key AND x.f = q.g
  LEFT JOIN cells y ON y.entity = q.entity AND y.tbl = q.tbl AND y.schema_version = q.b AND y.rec_key = ra.rec_key AND y.f = q.n),
same AS (SELECT entity, tbl, b, g, n FROM met GROUP BY ALL HAVING bool_and(x IS NOT DISTINCT FROM y) AND bool_or(x IS NOT NULL))
"""

_CHANGES = """,
every AS (
  SELECT entity, tbl, b, n AS f, 'renamed' AS kind FROM same
  UNION SELECT entity, tbl, b, f, 'added' FROM fresh WHERE (entity, tbl, b, f) NOT IN (SELECT (entity, tbl, b, n) FROM same)
  UNION SELECT entity, tbl, b, f, 'removed' FROM gone WHERE (entity, tbl, b, f) NOT IN (SELECT (entity, tbl, b, g) FROM same)
  UNION SELECT entity, tbl, b, f, 'retyped' FROM (SELECT *, unnest(fields) AS f FROM p) WHERE list_contains(was, f) AND types[list_position(fields, f)] IS DISTINCT FROM was_types[list_position(was, f)]
  UNION SELECT entity, tbl, b, '', 'key_changed' FROM p WHERE key <> was_key)
SELECT entity, tbl, b AS manifest_version, f AS field_name, kind AS change_kind FROM every
"""

_TABLE = """,
target AS (SELECT entity, tbl, unnest(fields) AS f, unnest(types) AS t FROM s QUALIFY b = max(b) OVER (PARTITION BY entity, tbl)),
raw AS (SELECT DISTINCT entity, tbl, segment_path, schema_version, row_no, rec_key, row_json FROM segment_rows),
pair AS (SELECT entity, tbl, b, g, min(n) AS n FROM same GROUP BY ALL),
names AS (
  WITH RECURSIVE c AS (
    SELECT DISTINCT entity, tbl, schema_version AS v, f, f AS cur, schema_version AS upto FROM cells
    UNION ALL
    SELECT c.entity, c.tbl, c.v, c.f, p.n, p.b FROM c JOIN pair p ON p.entity = c.entity AND p.tbl = c.tbl AND p.g = c.cur AND p.b > c.upto
    WHERE NOT EXISTS (SELECT 1 FROM pair q WHERE q.entity = c.entity AND q.tbl = c.tbl AND q.g = c.cur AND q.b > c.upto AND q.b < p.b))
  SELECT entity, tbl, v, f, cur FROM c QUALIFY row_number() OVER (PARTITION BY entity, tbl, v, f ORDER BY upto DESC) = 1),
vals AS (
  SELECT r.*, names.cur AS field_name, k.val FROM (SELECT *, unnest(json_keys(row_json)) AS field FROM raw) r, LATERAL (SELECT json_extract_string(r.row_json, '$."' || r.field || '"') AS val) k
  JOIN names ON names.entity = r.entity AND names.tbl = r.tbl AND names.v = r.schema_version AND names.f = lower(r.field) WHERE k.val IS NOT NULL),
cast_ AS (
  SELECT v.*, t.t AS family,
    CASE WHEN t.t IN ('int', 'bigint', 'smallint', 'tinyint', 'mediumint', 'integer') AND regexp_full_match(val, '[+-]?[0-9]{1,18}') OR t.t IN ('decimal', 'numeric') AND regexp_full_match(val, '[+-]?[0-9]{1,28}([.][0-9]+)?')
      OR t.t IN ('float', 'double') AND regexp_full_match(val, '[+-]?[0-9]+([.][0-9]+)?([eE][+-]?[0-9]+)?') THEN CAST(val AS DOUBLE) END AS number,
    CASE WHEN t.t IN ('date', 'datetime', 'timestamp') AND regexp_full_match(val, '[0-9]{4}-[0-9]{2}-[0-9]{2}([ T][0-9]{2}:[0-9]{2}(:[0-9]{2}([.][0-9]+)?)?)?') THEN TRY_CAST(val AS TIMESTAMP) END AS moment,
    CASE WHEN t.t IN ('varchar', 'text') THEN val END AS text
  FROM vals v LEFT JOIN target t ON t.entity = v.entity AND t.tbl = v.tbl AND t.f = v.field_name)
SELECT entity, tbl, segment_path, schema_version, row_no, rec_key, field_name, CASE WHEN ok THEN family END AS field_type, number, moment, text, CASE WHEN NOT ok THEN val END AS rescued
FROM (SELECT *, number IS NOT NULL OR moment IS NOT NULL OR text IS NOT NULL AS ok FROM cast_)
"""

_ENTRIES = r"""
WITH n AS (SELECT DISTINCT op_id, spec FROM (SELECT * FROM saved_ops WHERE json_valid(spec)) QUALIFY rank() OVER (PARTITION BY op_id ORDER BY spec_version DESC) = 1),
d AS (
  SELECT op_id, CASE json_type(spec, '$.details') WHEN 'OBJECT' THEN json_extract(spec, '$.details') WHEN 'VARCHAR' THEN CAST(json_extract_string(spec, '$.details') AS JSON) ELSE CAST(spec AS JSON) END AS j FROM n),
t AS (SELECT d.op_id, substr(t.fullkey, 3) AS path, t.type AS type, t.value AS value FROM d, json_tree(d.j) t WHERE t.type IN ('OBJECT', 'VARCHAR')),
e AS (
  SELECT op_id, regexp_replace(regexp_replace(path, '^joins\.', 'joins[0].'), '(joins|on|filters|select)$', '\1[0]') AS path, type, value,
    CASE WHEN regexp_matches(path, '^joins(\[\d+\])?$') THEN 'alias' WHEN regexp_matches(path, '\.on(\[\d+\])?$') THEN 'left' ELSE 'field' END AS label
  FROM t WHERE regexp_matches(path, '^(joins|joins(\[\d+\])?\.(on|filters)|filters|select)(\[\d+\])?$')
  UNION ALL
  SELECT op_id, regexp_replace(path, '\.children(\.|$)', '.children[0]\1', 'g'), type, value, 'field'
  FROM t WHERE regexp_matches(path, '^filter_tree(\.children(\[\d+\])?)*$') AND NOT (type = 'OBJECT' AND coalesce(json_type(value, '$.children'), 'NULL') <> 'NULL'))
"""

_FOUND = """
SELECT op_id, path AS node_path, CASE type WHEN 'VARCHAR' THEN json_extract_string(value, '$') ELSE coalesce(json_extract_string(value, '$.' || label), '') END AS node_value FROM e
"""


def _flat(start: str, *labels: str, name: str = "", where: str) -> str:
    """The entries under a path as a flat table: its labels as columns, the first of which a bare string stands for."""
    scalar = "CASE WHEN json_type(value, '$.{0}') NOT IN ('OBJECT', 'ARRAY') THEN json_extract_string(value, '$.{0}') END"
    cols = [f"CASE type WHEN 'VARCHAR' THEN json_extract_string(value, '$') ELSE {scalar.format(x)} END AS {x}" if x == labels[0] else f"CASE type WHEN 'VARCHAR' THEN NULL ELSE {scalar.format(x)} END AS {x}" for x in labels]
    table = f"'{name}' AS entity_table, " if name else ""
    return f"""
SELECT op_id, {table}path AS entry_path, regexp_replace(path, '\\.?[^.\\[\\]]+(\\[[0-9]+\\])?$', '') AS parent_path, {", ".join(cols)} FROM e WHERE starts_with(path, '{start}') AND {where}"""


def oracle_sql() -> dict[str, str]:
    """The queries that SQL can express; the others are held against brute force in the tests."""
    return {
        "p1_found": _FEED + _ROWS,
        "p1_compacted": _FEED + "SELECT entity, tbl, count(DISTINCT pk) AS n_rows FROM held GROUP BY ALL",
        "cdc_delete": _FEED + "SELECT entity, tbl, pk FROM base WHERE op = 'DELETE'",
        "cdc_pk_change": _FEED + "SELECT DISTINCT entity, tbl, pk, was, f AS file_no, p AS pos, r AS row_no FROM m WHERE moved",
        "gtid_sets": _UNPROCESSED[: _UNPROCESSED.index(",\ne AS")] + " SELECT entity, source, lo, hi FROM sets",
        "p2_found": _check_sql(),
        "gtid_union": """
WITH parts AS (SELECT entity, unnest(string_split(lower(regexp_replace(gtid_executed, '\\s', '', 'g')), ',')) AS part FROM cdc_states WHERE outcome = 'committed' AND entity IS NOT NULL),
r AS (SELECT entity, split_part(part, ':', 1) AS source, unnest(string_split(part, ':')[2:]) AS w FROM parts WHERE part <> ''),
n AS (SELECT entity, source, CAST(split_part(w, '-', 1) AS BIGINT) AS lo, CAST(split_part(w, '-', -1) AS BIGINT) AS hi FROM r),
i AS (SELECT *, CASE WHEN lo > max(hi) OVER (PARTITION BY entity, source ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 1 ELSE 0 END AS fresh FROM n WHERE lo <= hi),
k AS (SELECT *, sum(fresh) OVER (PARTITION BY entity, source ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS island FROM i)
SELECT entity, source, min(lo) AS lo, max(hi) AS hi FROM k GROUP BY entity, source, island""",
        "p2_values": _check_sql(True),
        "p3_found": _ENTRIES + _FOUND,
        "p3_joins": _ENTRIES + _flat("joins[", "alias", "table", "type", where="NOT contains(path, '.')"),
        "p3_conditions": "SELECT * FROM ("
        + ") UNION ALL SELECT * FROM (".join(
            _ENTRIES + _flat(start, "field", "op", name=name, where=where) for name, start, where in (("filters", "filters[", "true"), ("join_filters", "joins[", "contains(path, '.filters[')"), ("tree_conditions", "filter_tree", "true"))
        )
        + ")",
        "p4_found": _DRIFT + _CHANGES,
        "p4_table": _DRIFT + _TABLE,
        "p5_found": _LISTED + "SELECT entity, tbl, segment_path FROM segment_rows SEMI JOIN listed USING (entity, tbl, segment_path) GROUP BY ALL HAVING count(DISTINCT row_no) < 20",
        "p5_compacted": _LISTED + "SELECT DISTINCT entity, tbl, segment_path, schema_version, row_no, rec_key, row_json FROM segment_rows SEMI JOIN listed USING (entity, tbl, segment_path)",
        "p5_files": _LISTED + f"""
SELECT entity, tbl, count(DISTINCT segment_path) AS files_before, count(*) AS records, CAST(ceil(count(*) / {small_files.FULL}.0) AS BIGINT) AS files_after
FROM (SELECT DISTINCT entity, tbl, segment_path, schema_version, row_no, rec_key, row_json FROM segment_rows SEMI JOIN listed USING (entity, tbl, segment_path)) GROUP BY ALL""",
        "p6_found": _UNPROCESSED,
        "p6_resumed": _UNPROCESSED,
    }
