"""Schemas that drift between the versions of a table: rescue-column ingestion and a report of each change.

Raw records are JSON texts. Ingestion enforces a target schema: known fields are
cast, and what is unknown or can't be cast is kept, as JSON, in the rescue column.
Approved fields are promoted later by replaying the rescued values.

The report uses the same enforcement: a record of the newer version, ingested under
the older version's fields, has exactly the new fields in its rescue part, and a
record of the older version under the newer fields has those that are gone. A
renamed field is one whose rescued values are the same on both sides.
"""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TABLE = ["entity", "tbl"]
RAW = "map<string,string>"
#: MySQL type families and the types that hold them here.
TYPES = {
    "tinyint": "bigint", "smallint": "bigint", "mediumint": "bigint", "int": "bigint", "integer": "bigint", "bigint": "bigint", "decimal": "decimal(38,9)", "numeric": "decimal(38,9)",
    "float": "double", "double": "double", "date": "timestamp_ntz", "datetime": "timestamp_ntz", "timestamp": "timestamp_ntz", "bit": "boolean", "bool": "boolean", "boolean": "boolean",
}


def type_family(col: Column) -> Column:
    """A type in lower case, up to the first parenthesis."""
    return F.trim(F.substring_index(F.lower(col), "(", 1))


def raw_fields(json: Column) -> Column:
    """The top fields of a JSON object as (name, text) entries; nested values as their JSON text, broken JSON as null."""
    return F.map_entries(F.from_json(json, RAW))


def enforce(entries: Column, fields: Column) -> Column:
    """entries of raw_fields under a list of lower-case names: struct<known, rescued>, each an array of (name, value).

    Names agree without regard to letter case and come out in lower case.
    """
    lowered = F.transform(entries, lambda e: F.struct(F.lower(e["key"]).alias("name"), e["value"].alias("value")))
    return F.struct(F.filter(lowered, lambda e: F.array_contains(fields, e["name"])).alias("known"), F.filter(lowered, lambda e: ~F.array_contains(fields, e["name"])).alias("rescued"))


def value_of(entries: Column, name: Column) -> Column:
    """The value of a name in (name, value) entries; of one given twice the last; null if it is absent."""
    hit = F.filter(entries, lambda e: e["name"] == name)
    return F.when(F.size(hit) > 0, F.element_at(hit, -1)["value"])


def ingest(df: DataFrame, json: str, schema: dict[str, str], renamed: dict[str, str] | None = None) -> DataFrame:
    """df with the typed columns of schema (name: SQL type), `_rescued` and `_broken`; json itself goes.

    `_rescued` is the JSON object of all fields that schema doesn't name or whose value
    can't be cast, null if there are none. A field of an old name in renamed counts as
    the new one. `_broken` is the text of a record that is no JSON object. Columns of df
    that clash with a schema name or these, without regard to case, are kept as `_in_<name>`.
    """
    renamed = {k.lower(): v.lower() for k, v in (renamed or {}).items()}
    names = {k.lower(): t for k, t in schema.items()}
    own = {"_json", "_entries", "_rescued", "_broken", *[f"_v_{n}" for n in names]}
    clash = {c: f"_in_{c}" for c in df.columns if c != json and c.lower() in {*names, *own}}
    kept = [F.col(f"`{c}`").alias(clash.get(c, c)) for c in df.columns if c != json]
    parsed = F.from_json(F.col(json), RAW)
    out = df.select(*kept, F.col(json).alias("_json"), F.map_entries(parsed).alias("_entries"))
    lowered = F.transform("_entries", lambda e: F.struct(F.lower(e["key"]).alias("name"), e["value"].alias("value")))
    out = out.withColumn("_entries", lowered)
    if renamed:
        new_name = F.create_map(*[F.lit(x) for kv in renamed.items() for x in kv])
        out = out.withColumn("_entries", F.transform("_entries", lambda e: F.struct(F.coalesce(F.try_element_at(new_name, e["name"]), e["name"]).alias("name"), e["value"].alias("value"))))
    typed = {n: value_of(F.col("_entries"), F.lit(n)) for n in names}
    out = out.withColumns({f"_v_{n}": v for n, v in typed.items()})
    out = out.withColumns({n: F.col(f"_v_{n}").try_cast(t) for n, t in names.items()})
    lost = [F.when(F.col(f"_v_{n}").isNotNull() & F.col(n).isNull(), F.lit(n)) for n in names]
    failed = F.array_compact(F.array(*lost)) if lost else F.array().cast("array<string>")
    known = F.array(*[F.lit(n) for n in names]) if names else F.array().cast("array<string>")
    rescued = F.filter("_entries", lambda e: e["value"].isNotNull() & (~F.array_contains(known, e["name"]) | F.array_contains(failed, e["name"])))
    # of a name given twice the last counts, as in the typed columns
    last = F.aggregate(rescued, F.create_map().cast("map<string,string>"), lambda m, e: F.map_concat(F.map_filter(m, lambda k, _: k != e["name"]), F.create_map(e["name"], e["value"])))
    return out.select(*[clash.get(c, c) for c in df.columns if c != json], *names, F.when(F.size(rescued) > 0, F.to_json(last)).alias("_rescued"), F.when(F.col("_entries").isNull(), F.col("_json")).alias("_broken"))


def promote(df: DataFrame, approved: dict[str, str]) -> DataFrame:
    """Replays the rescued values of approved fields (name: SQL type) into typed columns; what can't be cast stays rescued.

    A typed column that is already there keeps its value where it has one.
    """
    names = {k.lower(): t for k, t in approved.items()}
    held = F.from_json("_rescued", RAW)
    made = {n: F.try_element_at(held, F.lit(n)).try_cast(t) for n, t in names.items()}
    out = df.withColumns({f"_p_{n}": c for n, c in made.items()})
    taken = F.array_compact(F.array(*[F.when(F.col(f"_p_{n}").isNotNull(), F.lit(n)) for n in names]))
    left = F.map_filter(held, lambda k, _: ~F.array_contains(taken, k))
    out = out.withColumn("_rescued", F.when(F.size(left) > 0, F.to_json(left)))
    have = set(df.columns)
    out = out.withColumns({n: F.coalesce(F.col(n), F.col(f"_p_{n}")) if n in have else F.col(f"_p_{n}") for n in names})
    return out.drop(*[f"_p_{n}" for n in names])


def versions(manifests: DataFrame) -> DataFrame:
    """One row for each manifest that has fields, with those of the next lower version (null of the first): fields, types, key; prev_*; and is_last."""
    m = manifests.filter(F.size("original_fields") > 0).select(*TABLE, "manifest_version", "original_fields", "field_types", "primary_key", "primary_key_columns", "captured_at")
    m = m.groupBy(*TABLE, "manifest_version").agg(F.max(F.struct("captured_at", "original_fields", "field_types", "primary_key", "primary_key_columns")).alias("m")).select(*TABLE, "manifest_version", "m.*")
    key = F.when(F.size("primary_key_columns") > 0, F.col("primary_key_columns")).otherwise(F.array("primary_key"))
    one = m.select(
        *TABLE, "manifest_version", F.transform("original_fields", F.lower).alias("fields"),
        F.transform("original_fields", lambda n, i: F.struct(F.lower(n).alias("name"), type_family(F.get("field_types", i)).alias("type"))).alias("typed"),
        F.transform(key, F.lower).alias("key"),
    )
    w = Window.partitionBy(*TABLE).orderBy("manifest_version")
    lag = {f"prev_{c}": F.lag(c).over(w) for c in ("manifest_version", "fields", "typed", "key")}
    return one.withColumns({**lag, "is_last": F.lead("manifest_version").over(w).isNull()})


def rename_evidence(steps: DataFrame, rows: DataFrame) -> DataFrame:
    """The fields of each step that have the same values over all shared records: TABLE, manifest_version and matches,
    an array of (gone, new), each a list of names: all of one entry agree with each other.

    steps: TABLE, manifest_version, prev_manifest_version, fields, prev_fields, gone, new.
    The records of either version are ingested under the fields of the other, and only
    the rescued parts meet, by record key. Records are hashed over (table, key) after a
    join with the steps; a table with a third of all rows is split over its keys. Of the
    values of each field over the shared records a fingerprint is taken (two 64-bit
    hashes of key and value, and their number), so the work is linear in the fields;
    fields with equal fingerprints are the same.
    """
    roles = F.array(
        F.struct(F.col("manifest_version").alias("schema_version"), F.lit("newer").alias("role"), F.col("prev_fields").alias("target"), F.col("new").alias("wanted")),
        F.struct(F.col("prev_manifest_version").alias("schema_version"), F.lit("older").alias("role"), F.col("fields").alias("target"), F.col("gone").alias("wanted")),
    )
    role = steps.select(*[F.col(c).alias(f"s_{c}") for c in TABLE], F.col("manifest_version").alias("step"), F.inline(roles))
    raw = rows.select(*TABLE, F.col("schema_version").cast("int").alias("at"), "rec_key", "row_json")
    met = raw.join(role, (raw["entity"] == role["s_entity"]) & (raw["tbl"] == role["s_tbl"]) & (raw["at"] == role["schema_version"]))
    rescued = enforce(raw_fields(F.col("row_json")), F.col("target"))["rescued"]
    met = met.select(*TABLE, "step", "role", "rec_key", "wanted", rescued.alias("rescued"))
    values = F.transform("wanted", lambda n: value_of(F.col("rescued"), n))
    met = met.select(*TABLE, "step", "role", "rec_key", values.alias("values"))
    # a record written again under one version: the highest values stand for it, so that the result doesn't hang on order
    each = met.groupBy(F.xxhash64(*TABLE, "step", "rec_key").alias("_h"), *TABLE, "step", "rec_key").agg(
        F.max(F.when(F.col("role") == "older", F.struct("values"))).alias("older"), F.max(F.when(F.col("role") == "newer", F.struct("values"))).alias("newer")
    )
    shared = each.filter(F.col("older").isNotNull() & F.col("newer").isNotNull())
    cell = lambda new: lambda v, i: F.struct(F.lit(new).alias("is_new"), i.alias("at"), v.alias("value"))
    cells = shared.select(*TABLE, "step", "rec_key", F.inline(F.concat(F.transform("older.values", cell(False)), F.transform("newer.values", cell(True)))))
    marks = [F.bit_xor(F.xxhash64(F.lit(salt), "rec_key", F.col("value").isNull(), "value")).alias(salt) for salt in ("first", "second")]
    prints = cells.groupBy(*TABLE, "step", "is_new", "at").agg(*marks, F.count("value").alias("filled")).filter("filled > 0")
    places = lambda new: F.array_sort(F.collect_list(F.when(F.col("is_new") == new, F.col("at"))))
    equal = prints.groupBy(*TABLE, "step", "first", "second", "filled").agg(places(False).alias("i"), places(True).alias("j")).filter((F.size("i") > 0) & (F.size("j") > 0))
    named = equal.groupBy(*TABLE, "step").agg(F.collect_list(F.struct("i", "j")).alias("classes"))
    names = steps.select(*TABLE, F.col("manifest_version").alias("step"), "gone", "new")
    matched = F.transform("classes", lambda c: F.struct(F.transform(c["i"], lambda i: F.get("gone", i)).alias("gone"), F.transform(c["j"], lambda j: F.get("new", j)).alias("new")))
    return named.join(names, [*TABLE, "step"]).select(*TABLE, F.col("step").alias("manifest_version"), F.array_sort(matched).alias("matches"))


def _renamed(v: DataFrame, rows: DataFrame) -> DataFrame:
    """v, the versions, with gone, new and matches (see rename_evidence; null if there are none)."""
    v = v.withColumn("gone", F.array_sort(F.array_except("prev_fields", "fields"))).withColumn("new", F.array_sort(F.array_except("fields", "prev_fields")))
    candidates = v.filter((F.size("gone") > 0) & (F.size("new") > 0)).select(*TABLE, "manifest_version", "prev_manifest_version", "fields", "prev_fields", "gone", "new")
    return v.join(rename_evidence(candidates, rows), [*TABLE, "manifest_version"], "left")


def report(manifests: DataFrame, rows: DataFrame) -> DataFrame:
    """entity, tbl, manifest_version, field_name, change_kind of each change between successive versions that have fields.

    renamed, removed, added, retyped, and key_changed with field_name ''. A new field
    that agrees with several gone ones is one case renamed.
    """
    v = _renamed(versions(manifests).filter(F.col("prev_manifest_version").isNotNull()), rows)
    none = F.array().cast("array<string>")
    was, now = F.coalesce(F.flatten(F.transform("matches", lambda m: m["gone"])), none), F.coalesce(F.flatten(F.transform("matches", lambda m: m["new"])), none)

    def cases(names: Column, kind: str) -> Column:
        return F.transform(names, lambda n: F.struct(n.alias("field_name"), F.lit(kind).alias("change_kind")))

    old_type = lambda n: F.get(F.filter("prev_typed", lambda p: p["name"] == n), F.lit(0))["type"]
    retyped = F.transform(F.filter("typed", lambda t: F.array_contains("prev_fields", t["name"]) & ~t["type"].eqNullSafe(old_type(t["name"]))), lambda t: t["name"])
    key = F.when(~F.col("key").eqNullSafe(F.col("prev_key")), F.array(F.lit(""))).otherwise(none)
    every = F.concat(
        cases(F.array_intersect("new", now), "renamed"), cases(F.array_except("gone", was), "removed"), cases(F.array_except("new", now), "added"),
        cases(F.array_distinct(retyped), "retyped"), cases(key, "key_changed"),
    )
    return v.select(*TABLE, "manifest_version", F.inline(every))


# ---- one table from all versions ----

#: What a value must look like to be of a type family; families that aren't here hold any text.
_INT, _TIME, _BOOL = r"^[+-]?\d{1,18}$", r"^\d{4}-\d{2}-\d{2}([ T]\d{2}:\d{2}(:\d{2}(\.\d+)?)?)?$", r"(?i)^(0|1|true|false)$"
_DECIMAL, _DOUBLE = r"^[+-]?\d{1,28}(\.\d+)?$", r"^[+-]?\d+(\.\d+)?([eE][+-]?\d+)?$"
_PATTERNS = {"bigint": _INT, "decimal(38,9)": _DECIMAL, "double": _DOUBLE, "timestamp_ntz": _TIME, "boolean": _BOOL}


def targets(manifests: DataFrame, rows: DataFrame) -> DataFrame:
    """What the records of each table become: TABLE, typed (name and type family of the newest fields) and steps,
    the renames that the report finds: an array of (manifest_version, matches) in order."""
    v = versions(manifests)
    newest = v.filter("is_last").select(*TABLE, "typed")
    found = _renamed(v.filter(F.col("prev_manifest_version").isNotNull()), rows).filter(F.col("matches").isNotNull())
    steps = found.groupBy(*TABLE).agg(F.array_sort(F.collect_list(F.struct("manifest_version", "matches"))).alias("steps"))
    return newest.join(steps, TABLE, "left")


def current_name(name: Column, version: Column, steps: Column) -> Column:
    """The name that a field of a version has in the newest one, after all later renames; of several new names the first in order."""

    def after(at: Column, step: Column) -> Column:
        hit = F.get(F.filter(step["matches"], lambda m: F.array_contains(m["gone"], at)), F.lit(0))["new"]
        return F.when(step["manifest_version"] > version, F.coalesce(F.get(hit, F.lit(0)), at)).otherwise(at)

    return F.aggregate(F.coalesce(steps, F.array().cast("array<struct<manifest_version:int,matches:array<struct<gone:array<string>,new:array<string>>>>>")), name, after)


def consistent(manifests: DataFrame, rows: DataFrame) -> DataFrame:
    """Every raw record once under the newest columns of its table, its fields renamed as the report found, its values typed.

    The columns of rows but row_json, with cells: an array of (name, type, and the value in
    number, at, flag or text) in the order of the target's columns, null values left out;
    and _rescued, a map of the fields that the target doesn't name or whose values are not
    of its type, as texts. When a newer manifest approves such a field, or changes its type,
    the next build replays the rescued value into the typed column, for records of all
    versions. Tables without any fields have all values rescued; of a record that is no JSON object
    _rescued is null and _broken its text. Of a name given twice the last counts.
    """
    columns = [c for c in rows.columns if c != "row_json"]
    once = rows.distinct()
    t = targets(manifests, rows)
    joined = once.join(t, TABLE, "left")
    version = F.col("schema_version").cast("int")
    entries = F.transform(F.filter(raw_fields(F.col("row_json")), lambda e: e["value"].isNotNull()), lambda e: F.struct(current_name(F.lower(e["key"]), version, F.col("steps")).alias("name"), e["value"].alias("value")))
    # a name once, with its last value
    values = F.aggregate(entries, F.create_map().cast(RAW), lambda m, e: F.map_concat(F.map_filter(m, lambda k, _: k != e["name"]), F.create_map(e["name"], e["value"])))
    made = joined.withColumn("_values", values)

    def cell(field: Column) -> Column:
        v, family = F.try_element_at("_values", field["name"]), field["type"]
        kinds = {k: family.isin([f for f, x in TYPES.items() if x == k]) for k in _PATTERNS}
        numeric = functools.reduce(operator.or_, [kinds[k] & v.rlike(_PATTERNS[k]) for k in ("bigint", "decimal(38,9)", "double")])
        at = F.when(kinds["timestamp_ntz"] & v.rlike(_TIME), v.try_cast("timestamp_ntz"))
        flag = F.when(kinds["boolean"] & v.rlike(_BOOL), v.try_cast("boolean"))
        text = F.when(~family.isin(list(TYPES)), v)
        return F.struct(field["name"].alias("name"), family.alias("type"), F.when(numeric, v.try_cast("double")).alias("number"), at.alias("at"), flag.alias("flag"), text.alias("text"))

    cells = F.filter(F.transform(F.coalesce("typed", F.array().cast("array<struct<name:string,type:string>>")), cell), lambda c: F.coalesce(c["number"].isNotNull() | c["at"].isNotNull() | c["flag"].isNotNull() | c["text"].isNotNull(), F.lit(False)))
    made = made.withColumn("cells", cells)
    rescued = F.map_filter("_values", lambda k, _: ~F.array_contains(F.transform("cells", lambda c: c["name"]), k))
    return made.select(*columns, "cells", F.when(F.size(rescued) > 0, rescued).alias("_rescued"), F.when(F.col("_values").isNull(), F.col("row_json")).alias("_broken"))
