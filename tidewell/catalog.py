"""The tables that operations read: (entity, table) -> DataFrame, keys and columns."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tidewell.errors import SpecError
from tidewell.functions.text import nfc


@dataclass(frozen=True)
class Table:
    """key: the primary key's columns, () if unknown; hidden: columns that `*` and the default projection leave out.

    The texts of key and indexed columns are equal if their NFC forms are. in_nfc says that
    they are stored in that form (see normalised), so that lookups reach the scan.
    """

    df: DataFrame
    key: tuple[str, ...] = ()
    hidden: tuple[str, ...] = ()
    indexed: tuple[str, ...] = ()
    in_nfc: bool = False

    @property
    def base_columns(self) -> list[str]:
        return [c for c in self.df.columns if c not in self.hidden]


def normalised(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """df with the texts of columns in NFC: what a table of in_nfc columns is written from."""
    texts = [c for c in columns if df.schema[c].dataType == StringType()]
    return df.withColumns({c: nfc(F.col(f"`{c}`")) for c in texts})


class Catalog:
    """Names are matched exactly, else without regard to letter case; a name that so means several tables is an error."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.tables: dict[tuple[str, str], Table] = {}
        self.paths: dict[tuple[str, str], tuple[str, tuple[str, ...]]] = {}

    def register(self, entity: str, name: str, df: DataFrame, key: Iterable[str] = (), hidden: Iterable[str] = (), indexed: Iterable[str] = (), in_nfc: bool = False) -> None:
        key, indexed = tuple(key), tuple(indexed)
        if unknown := [k for k in (*key, *indexed) if k not in df.columns]:
            raise SpecError(f"key columns {unknown} are not in {entity}.{name}")
        if len(set(df.columns)) < len(df.columns):
            raise SpecError(f"{entity}.{name} has a column name twice")
        self.tables[entity, name] = Table(df, key, tuple(hidden), indexed, in_nfc)

    def register_parquet(self, entity: str, name: str, path: str, key: Iterable[str] = ()) -> None:
        """A table that is opened when it is first asked for."""
        self.tables.pop((entity, name), None)
        self.paths[entity, name] = path, tuple(key)

    def _opened(self, entity: str, name: str) -> Table:
        if (entity, name) not in self.tables:
            path, key = self.paths[entity, name]
            self.register(entity, name, self.spark.read.parquet(path), key)
        return self.tables[entity, name]

    @classmethod
    def of_folder(cls, spark: SparkSession, folder: str, names: dict[str, tuple[str, ...]], entity: str = "") -> Catalog:
        """The Parquet tables folder/<name>.parquet; names gives their keys."""
        out = cls(spark)
        for name, key in names.items():
            out.register_parquet(entity, name, f"{folder}/{name}.parquet", key)
        return out

    def table(self, entity: str, name: str) -> Table:
        known = {*self.tables, *self.paths}
        if (entity, name) in known:
            return self._opened(entity, name)
        near = [(e, n) for e, n in sorted(known) if (e.lower(), n.lower()) == (entity.lower(), name.lower())]
        if not near:
            raise SpecError(f"no table '{name}' in entity '{entity}'")
        if len(near) > 1:
            raise SpecError(f"'{entity}.{name}' may be any of {', '.join(f'{e}.{n}' for e, n in near)}")
        return self._opened(*near[0])

    def ensure(self, entity: str, name: str, schema, key: Iterable[str] = ()) -> Table:
        """The table; one first seen in a change stream starts empty with the schema of its changes."""
        try:
            return self.table(entity, name)
        except SpecError:
            self.register(entity, name, self.spark.createDataFrame([], schema), key)
            return self.tables[entity, name]

    def entities(self) -> dict[str, list[str]]:
        out: dict[str, list[str]] = {}
        for e, n in sorted({*self.tables, *self.paths}):
            out.setdefault(e, []).append(n)
        return out

    def field_values(self, entity: str, name: str, column: str, n: int = 100) -> DataFrame:
        """The first n distinct filled values of a column, in order."""
        c = F.col(f"`{column}`").cast("string")
        return self.table(entity, name).df.select(c.alias("value")).filter(F.col("value") != "").distinct().orderBy("value").limit(n)
