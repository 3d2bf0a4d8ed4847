"""Deeply nested JSON texts as an adjacency table, and flat entity tables made from it.

Every value of a document is a node with its parent, label, ordinal in the parent
list and, if it is no object or list, its scalar. Entity tables come from joining
object nodes with their scalar children and pivoting the children's labels.
"""

from __future__ import annotations

import functools
import itertools
import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NODES = "doc_id bigint, node int, parent int, label string, ordinal int, kind string, scalar string, path string, shape string, size int"
ENTRIES = "doc_id bigint, node int, parent int, label string, kind string, scalar string, what string, path string, child boolean"
_ROWS_PER_BATCH = 20_000


@dataclass(frozen=True)
class Places:
    """Which nodes are entries, and which of their children matter.

    is_list says of a shape whether a list belongs there: a single object or string in
    its place counts as its entry 0. what_of names the kind of entry of a shape, None if
    it is none. labels are those of scalar children to keep, containers those of lists
    and objects of which only matters that they are filled.
    """

    is_list: Callable[[str], bool]
    what_of: Callable[[str], str | None]
    labels: frozenset[str]
    containers: frozenset[str] = frozenset()


def _strict(name: str) -> None:
    raise ValueError(name)


def _load(text: str | None):
    """The value of a complete JSON text, else an error. NaN and Infinity are no JSON."""
    return json.loads(text, parse_constant=_strict)


def _text(value: str) -> str:
    """As it is, but a lone surrogate, which no UTF-8 text can hold, becomes '?'."""
    return value if value.isascii() else value.encode("utf-8", "replace").decode()


def _scalar(value) -> str | None:
    return None if value is None else _text(value) if isinstance(value, str) else json.dumps(value)


def _kind(value) -> str:
    return "object" if isinstance(value, dict) else "list" if isinstance(value, list) else "null" if value is None else "string" if isinstance(value, str) else "other"


def _roots(batches: Iterator[pa.RecordBatch], inner: str | None, first: bool) -> Iterator[tuple]:
    """(document, value) of the complete texts, each parsed once; with first only the first complete one of equal neighbours."""
    done, last = False, None
    for batch in batches:
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if first and done and doc == last:
                continue
            done, last = False, doc
            try:
                root = _load(text)
                done = True
                if inner and isinstance(root, dict) and root.get(inner) is not None:
                    root = root[inner]
                    if isinstance(root, str):
                        root = _load(root)
            except (ValueError, TypeError, RecursionError):
                continue
            yield doc, root


def _batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    while part := list(itertools.islice(rows, _ROWS_PER_BATCH)):
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part), schema)], schema=schema)


def _nodes(roots: Iterator[tuple]) -> Iterator[tuple]:
    """Every node, as NODES."""
    for doc, root in roots:
        # value, parent, label, ordinal, path, shape; a stack, for any depth
        stack = [(root, None, None, None, "", "")]
        number = 0
        while stack:
            value, parent, label, ordinal, path, shape = stack.pop()
            kind = _kind(value)
            size = len(value) if kind in ("object", "list") else None
            yield doc, number, parent, label, ordinal, kind, None if size is not None else _scalar(value), path, shape, size
            if kind == "object":
                dot = "." if path else ""
                stack.extend((v, number, k, None, f"{path}{dot}{k}", f"{shape}{dot}{k}") for k, v in reversed([(_text(k), v) for k, v in value.items()]))
            elif kind == "list":
                stack.extend((v, number, label, i, f"{path}[{i}]", f"{shape}[]") for i, v in reversed(list(enumerate(value))))
            number += 1


def _entries(roots: Iterator[tuple], places: Places) -> Iterator[tuple]:
    """The entries and the children of entries that matter, as ENTRIES; nodes are numbered as in NODES."""
    is_list, what_of = functools.cache(places.is_list), functools.cache(places.what_of)  # shapes are few
    for doc, root in roots:
        # value, parent, whether that is an entry, label, ordinal, path, shape
        stack = [(root, None, False, None, None, "", "")]
        number = 0
        while stack:
            value, parent, of_entry, label, ordinal, path, shape = stack.pop()
            if isinstance(value, list):
                if of_entry and value and ordinal is None and label in places.containers:
                    yield doc, number, parent, label, "list", None, None, None, True
                stack.extend((v, number, False, label, i, f"{path}[{i}]", f"{shape}[]") for i, v in reversed(list(enumerate(value))))
                number += 1
                continue
            kind = _kind(value)
            what = None
            if kind in ("object", "string"):
                if is_list(shape):
                    path, shape = f"{path}[0]", f"{shape}[]"
                what = what_of(shape)
            child = of_entry and ordinal is None and (label in places.labels and kind in ("string", "other") or label in places.containers and kind != "null" and (kind != "object" or bool(value)))
            if what or child:
                yield doc, number, parent, label, kind, None if kind == "object" else _scalar(value), what, path if what else None, child
            if kind == "object":
                dot = "." if path else ""
                stack.extend((v, number, what is not None, k, None, f"{path}{dot}{k}", f"{shape}{dot}{k}") for k, v in reversed([(_text(k), v) for k, v in value.items()]))
            number += 1


def _schema(ddl: str) -> pa.Schema:
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}
    return pa.schema([(n, kinds[k]) for n, k in (c.split(" ") for c in ddl.split(", "))])


def newest_first(df: DataFrame, doc_id: str, version: str, text: str) -> DataFrame:
    """doc_id and text of all versions of each document in one task, the highest version first, of equal ones the higher text.

    Texts go over as they are and are parsed where they arrive; of a document with a third
    of all versions a task goes through the texts in order and parses the first complete one.
    """
    kept = df.select(F.col(doc_id).cast("long").alias("_doc"), F.col(version).alias("_version"), F.col(text).alias("_text")).filter(F.col("_text").isNotNull())
    return kept.repartition("_doc").sortWithinPartitions("_doc", F.desc("_version"), F.desc("_text")).select("_doc", "_text")


def shred(df: DataFrame, doc_id: str, text: str, inner: str | None = None, first: bool = False) -> DataFrame:
    """The adjacency table of the JSON texts: NODES, one row a node, numbered from 0 within its document.

    With inner, the value of that key of the top object is shredded in its place (an
    object, or JSON text of one); if it is absent or null, the top itself. Texts that
    are no complete JSON give no nodes. With first, of neighbours with one doc_id only the
    first complete text counts (see newest_first). shape is the path without positions.
    """
    return df.select(F.col(doc_id).cast("long"), F.col(text)).mapInArrow(lambda batches: _batches(_nodes(_roots(batches, inner, first)), _schema(NODES)), NODES)


def shred_entries(df: DataFrame, doc_id: str, text: str, places: Places, inner: str | None = None, first: bool = False) -> DataFrame:
    """Of the adjacency table only the entries and those of their children that matter: ENTRIES. Paths give lone entries the position 0."""
    return df.select(F.col(doc_id).cast("long"), F.col(text)).mapInArrow(lambda batches: _batches(_entries(_roots(batches, inner, first), places), _schema(ENTRIES)), ENTRIES)


def entities(nodes: DataFrame, labels: list[str], containers: list[str] = []) -> DataFrame:
    """doc_id, node, what, path, kind, scalar of the entries among ENTRIES, with their scalar children of the given labels as columns
    v_<label> and, as has_<label>, whether they hold a filled list or object of a label in containers; absent and null ones are null.

    The join of nodes with their children and the pivot are one aggregation: a node goes
    to its own number, a child to its parent's. So the documents are read and shredded once.
    """
    none = F.lit(None).cast("string")
    own = F.struct(F.col("node").alias("key"), "what", "path", "kind", F.when(F.col("kind") == "string", F.col("scalar")).alias("scalar"), none.alias("c_label"), none.alias("c_value"))
    child = F.struct(F.col("parent").alias("key"), none.alias("what"), none.alias("path"), none.alias("kind"), none.alias("scalar"), F.col("label").alias("c_label"), F.when(F.col("kind").isin("string", "other"), F.col("scalar")).alias("c_value"))
    sent = nodes.select("doc_id", F.inline(F.array_compact(F.array(F.when(F.col("what").isNotNull(), own), F.when(F.col("child"), child)))))
    values = [F.max(F.when(F.col("c_label") == x, F.col("c_value"))).alias(f"v_{x}") for x in labels]
    holds = [F.max(F.when(F.col("c_label") == x, F.lit(True))).alias(f"has_{x}") for x in containers]
    met = sent.groupBy("doc_id", "key").agg(*[F.max(c).alias(c) for c in ("what", "path", "kind", "scalar")], *values, *holds)
    return met.filter(F.col("what").isNotNull()).withColumnRenamed("key", "node")
