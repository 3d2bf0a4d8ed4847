"""Flat tables of saved operations: joins, join conditions, filters, condition trees and selected fields."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.operators.shredding import Places, entities, newest_first, shred, shred_entries

#: Where the entries lie under details, and the label of the value that names them.
LISTS = {"joins": "join", "joins[].on": "on", "joins[].filters": "join_filter", "filters": "filter", "select": "select"}
NAMED_BY = {"join": "alias", "on": "left", "join_filter": "field", "filter": "field", "select": "field", "tree": "field"}
_tree = re.compile(r"filter_tree(\.children\[\])*").fullmatch


def _is_list(shape: str) -> bool:
    return shape in LISTS or shape.endswith(".children") and _tree(shape[: -len(".children")]) is not None


def _what_of(shape: str) -> str | None:
    # a condition is a node under filter_tree that has no children, which shows when its children are joined to it
    return LISTS.get(shape[:-2]) if shape.endswith("[]") and shape[:-2] in LISTS else "tree" if _tree(shape) else None


def nodes_of(ops: DataFrame) -> DataFrame:
    """The adjacency table of the newest complete spec of each operation, from its details."""
    return shred(newest_first(ops, "op_id", "spec_version", "spec"), "_doc", "_text", "details", True)


def entries_of(ops: DataFrame, labels: list[str]) -> DataFrame:
    """One row for each entry of the newest complete spec of each operation: what it is, its path, and its scalar children of these labels."""
    places = Places(_is_list, _what_of, frozenset(labels), frozenset(["children"]))
    nodes = shred_entries(newest_first(ops, "op_id", "spec_version", "spec"), "_doc", "_text", places, "details", True)
    return entities(nodes, labels, ["children"]).filter((F.col("what") != "tree") | F.col("has_children").isNull())


def found(ops: DataFrame) -> DataFrame:
    """op_id, node_path, node_value of every entry; a bare string is its own value, an absent or null name is ''."""
    entries = entries_of(ops, sorted({*NAMED_BY.values()}))
    value = F.coalesce(*[F.when(F.col("what") == w, F.col(f"v_{label}")) for w, label in NAMED_BY.items()])
    value = F.when(F.col("kind") == "string", F.col("scalar")).otherwise(F.coalesce(value, F.lit("")))
    return entries.select(F.col("doc_id").alias("op_id"), F.col("path").alias("node_path"), value.alias("node_value"))


def flat_tables(ops: DataFrame) -> dict[str, DataFrame]:
    """The entity tables by name, each with op_id, entry_path, parent_path and its own columns."""
    entries = entries_of(ops, sorted({*NAMED_BY.values()} | {"table", "type", "op", "right", "as"})).withColumnRenamed("path", "entry_path")
    parent = F.regexp_replace("entry_path", r"\.?[^.\[\]]+(\[\d+\])?$", "")
    base = entries.withColumn("op_id", F.col("doc_id")).withColumn("parent_path", parent)

    def table(what: str, *labels: str) -> DataFrame:
        bare = F.when(F.col("kind") == "string", F.col("scalar"))
        made = [F.coalesce(bare, F.col(f"v_{x}")).alias(x) if x == NAMED_BY[what] else F.col(f"v_{x}").alias(x) for x in labels]
        return base.filter(F.col("what") == what).select("op_id", "entry_path", "parent_path", *made)

    return {
        "joins": table("join", "alias", "table", "type"), "join_on": table("on", "left", "op", "right"), "join_filters": table("join_filter", "field", "op"),
        "filters": table("filter", "field", "op"), "tree_conditions": table("tree", "field", "op"), "selected": table("select", "field", "as"),
    }
