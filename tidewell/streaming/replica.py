"""Replicas kept up to date by a stream of changes.

Each micro-batch becomes one run of a ChangeStore. Folding is idempotent and does not
hang on the order of delivery, and the last batch taken in is saved with the run, so a
batch that is delivered again after a failure changes nothing.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidewell.functions.text import blank, strip
from tidewell.operators.changelog import SEQUENCE, ChangeStore, file_number, live_rows
from tidewell.operators.maintenance import to_repair
from tidewell.sources import shared
from tidewell.sources.readers import change_stream

#: The durability profiles: the seconds between their commits and the files of the log that one commit takes at most.
PROFILES = {"strict": (0, 1), "balanced": (2, 32), "throughput": (30, 128)}
#: Kinds of changes to whole tables: those that empty one, and those after which its snapshot is out of date.
EMPTYING, STALING = ("TRUNCATE", "DROP"), ("ALTER", "DROP", "RENAME")


class StaleTable(RuntimeError):
    """A table is read whose definition has changed since its last snapshot."""


class Replica:
    """Tables under path, folded from a change stream. With vacuum, runs that a compaction has replaced are removed at once."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 16, most_runs: int = 8, vacuum: bool = False):
        self.spark, self.path, self.most_runs, self.vacuum = spark, path.rstrip("/"), most_runs, vacuum
        self.store = ChangeStore(spark, f"{self.path}/store", buckets)

    def _taken(self, batch_id: int) -> bool:
        return batch_id <= self._folded()["upto"] or shared.exists(self.spark, f"{self.path}/batches/{batch_id}.json")

    def take(self, batch: DataFrame, batch_id: int) -> None:
        """One micro-batch; a batch taken before is left alone. Changes without a usable pk go to rejects.

        TRUNCATE and DROP empty their table up to their place; ALTER, DROP and RENAME leave
        it stale until a new snapshot is taken (see stale).
        """
        if self._taken(batch_id):
            return
        batch = batch.persist()  # it is gone through several times
        try:
            self._take(batch, batch_id, [])
        finally:
            batch.unpersist()

    def _take(self, batch: DataFrame, batch_id: int, snapshots: list) -> None:
        op = F.coalesce(F.upper(strip(F.col("op_type"))), F.lit(""))
        rejects = batch.filter(blank(F.col("pk")) & ~op.isin(*EMPTYING, *STALING))
        rejects.write.mode("overwrite").parquet(f"{self.path}/rejects/batch={batch_id}")
        runs = self.store.append(batch)
        if self.store.compact_if_needed(self.most_runs) and self.vacuum:
            self.store.vacuum()
        place = F.struct(file_number(F.col("binlog_file")).alias("f"), F.col("binlog_pos").alias("p"), F.col("row_no").alias("r"))
        tip = batch.agg(F.max(F.struct(place["f"], place["p"])).alias("p"), F.max("committed_at").cast("string").alias("at")).first()
        last = lambda kinds: F.max(F.when(op.isin(*kinds), place))
        marks = batch.filter(op.isin(*EMPTYING, *STALING)).groupBy("entity", "tbl").agg(last(EMPTYING).alias("emptied"), last(STALING).alias("stale")).collect()  # one a table
        found = {k: [[r["entity"], r["tbl"], list(r[k])] for r in marks if r[k]] for k in ("emptied", "stale")}
        shared.write_json(self.spark, f"{self.path}/batches/{batch_id}.json", {"runs": runs, "position": list(tip["p"]) if tip["p"] else None, "committed_at": tip["at"], **found, "snapshots": snapshots})
        self._fold()

    def resync(self, snapshot: DataFrame, entity: str, tbl: str, key: list[str], file: str, pos: int, batch_id: int) -> None:
        """Takes one table anew from a snapshot of its source at a position: what came before it counts for nothing, what comes after it wins."""
        if self._taken(batch_id):
            return
        number = int(re.search(r"(\d+)\s*$", file)[1])
        # the place right before the snapshot's rows
        mark = [entity, tbl, [number, pos, -1]]
        self._take(snapshot_changes(snapshot, entity, tbl, key, file, pos), batch_id, [mark])

    def repair(self, drift: DataFrame, sources: dict[str, tuple[DataFrame, list[str]]], file: str, pos: int, batch_id: int, most: int = 10) -> list[str]:
        """Takes anew the tables (`entity.tbl`) that a drift report finds to differ by more than most, from their sources (rows and key); their names.

        Batches from batch_id on are used, one a table.
        """
        wanted = [r["tbl"] for r in to_repair(drift, most).select("tbl").orderBy("tbl").collect() if r["tbl"] in sources]  # one a table
        for i, name in enumerate(wanted):
            entity, _, tbl = name.rpartition(".")
            self.resync(sources[name][0], entity, tbl, sources[name][1], file, pos, batch_id + i)
        return wanted

    def reset_table(self, entity: str, tbl: str, batch_id: int) -> None:
        """Empties one table up to the furthest place taken in; the others stay."""
        at = self.position()
        if at is None or self._taken(batch_id):
            return
        shared.write_json(self.spark, f"{self.path}/batches/{batch_id}.json", {"runs": [], "position": None, "committed_at": None, "emptied": [[entity, tbl, [*at, 2**31 - 1]]], "stale": [], "snapshots": []})

    def _folded(self) -> dict:
        names = [x for x in shared.listing(self.spark, f"{self.path}/state") if x.endswith(".json")]
        return shared.read_json(self.spark, f"{self.path}/state/{names[-1]}") if names else {"upto": -1, "position": None, "committed_at": None, "emptied": [], "stale": [], "snapshots": []}

    def _state(self) -> dict:
        """What all batches say, with the furthest place of each table; only batches since the last fold are read one by one."""
        out = self._folded()
        names = [x for x in shared.listing(self.spark, f"{self.path}/batches") if x.endswith(".json")]
        batches = [(int(x[:-5]), shared.read_json(self.spark, f"{self.path}/batches/{x}")) for x in names]
        # batches that a fold which died before it removed them has counted already say the same again
        parts = [out, *(b for _, b in batches)]
        merged = {"upto": max([out["upto"], *(i for i, _ in batches)]), "batches": len(batches)}
        merged["position"] = max((p["position"] for p in parts if p["position"]), default=None)
        merged["committed_at"] = max((p["committed_at"] for p in parts if p["committed_at"]), default=None)
        for kind in ("emptied", "stale", "snapshots"):
            last: dict[tuple[str, str], list] = {}
            for e, t, at in (x for p in parts for x in p[kind]):
                last[e, t] = max(last.get((e, t), at), at)
            merged[kind] = [[e, t, at] for (e, t), at in sorted(last.items())]
        return merged

    def _fold(self, most: int = 64) -> None:
        """One state in place of many batch files, so that what the driver reads doesn't grow with the life of the stream. Batch numbers must grow."""
        state = self._state()
        if state.pop("batches") < most:
            return
        old = shared.listing(self.spark, f"{self.path}/state")
        shared.write_json(self.spark, f"{self.path}/state/{state['upto']:020d}.json", state)
        for x in shared.listing(self.spark, f"{self.path}/batches"):
            shared.delete(self.spark, f"{self.path}/batches/{x}")
        for x in old:
            shared.delete(self.spark, f"{self.path}/state/{x}")

    def start(self, changes: DataFrame, profile: str = "strict", once: bool = False) -> StreamingQuery:
        """The running query; once takes what is there and ends."""
        w = changes.writeStream.foreachBatch(self.take).option("checkpointLocation", f"{self.path}/checkpoint")
        seconds, _ = PROFILES[profile]
        w = w.trigger(availableNow=True) if once else w.trigger(processingTime=f"{seconds} seconds") if seconds else w
        return w.start()

    def follow(self, log: str, profile: str = "strict", once: bool = False) -> StreamingQuery:
        """start() over the change log under a folder, each commit of as many files as the profile allows."""
        return self.start(change_stream(self.spark, log, files_per_trigger=PROFILES[profile][1]), profile, once)

    def position(self) -> tuple[int, int] | None:
        """(file number, position) of the furthest change taken in."""
        at = self._state()["position"]
        return tuple(at) if at else None

    def caught_up(self, tip: tuple[int, int]) -> bool:
        """Whether the replica has reached the source's position: reads may wait for it."""
        at = self.position()
        return at is not None and at >= tuple(tip)

    def stale(self) -> list[tuple[str, str]]:
        """The tables whose definition changed after their last snapshot: they need a new one (resync)."""
        state = self._state()
        taken = {(e, t): at for e, t, at in state["snapshots"]}
        return [(e, t) for e, t, at in state["stale"] if at > taken.get((e, t), [-1, -1, -1])]

    def rows(self) -> DataFrame:
        """entity, tbl, pk, cells. What came before a table's last TRUNCATE, DROP, snapshot or reset counts for nothing."""
        cells, state = self.store.merged(), self._state()
        last: dict[tuple[str, str], list] = {}
        for e, t, at in [*state["emptied"], *state["snapshots"]]:
            last[e, t] = max(last.get((e, t), at), at)
        for (e, t), at in last.items():
            seq = F.struct(*SEQUENCE)
            old = (F.col("entity") == e) & (F.col("tbl") == t) & (seq <= F.struct(*[F.lit(x).alias(n) for x, n in zip(at, SEQUENCE)]))
            cells = cells.filter(~old)
        return live_rows(cells)

    def table(self, entity: str, tbl: str, columns: dict[str, str], key: dict[str, str]) -> DataFrame:
        """One table with typed columns (name: SQL type); key names the parts of its primary key. Blank values are null.

        A stale table is an error: its columns are no longer those that columns names.
        """
        if (entity, tbl) in self.stale():
            raise StaleTable(f"{entity}.{tbl} has changed its definition; it needs a new snapshot")
        mine = self.rows().filter((F.col("entity") == entity) & (F.col("tbl") == tbl))
        parts = F.split("pk", "\u001f")
        values = F.map_from_entries(F.transform("cells", lambda c: F.struct(c["col"], c["value"])))
        keyed = [F.get(parts, F.lit(i)).try_cast(t).alias(n) for i, (n, t) in enumerate(key.items())]
        return mine.select(*keyed, *[F.when(F.try_element_at(values, F.lit(n)) != "", F.try_element_at(values, F.lit(n))).try_cast(t).alias(n) for n, t in columns.items()])

    def reset(self) -> None:
        """Forgets everything: the next snapshot starts anew."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.store.name}")
        shared.delete(self.spark, self.path)
        self.store = ChangeStore(self.spark, f"{self.path}/store", self.store.buckets)


def snapshot_changes(snapshot: DataFrame, entity: str, tbl: str, key: list[str], file: str, pos: int) -> DataFrame:
    """The rows of a snapshot as INSERTs at the source's position before the copy began: later changes win over them."""
    columns = [c for c in snapshot.columns if c not in key]
    text = lambda c: F.col(f"`{c}`").cast("string")
    return snapshot.select(
        F.lit(None).cast("bigint").alias("delivery_id"), F.lit(entity).alias("entity"), F.lit(tbl).alias("tbl"), F.lit("INSERT").alias("op_type"), F.concat_ws("\u001f", *[F.coalesce(text(k), F.lit("")) for k in key]).alias("pk"),
        F.lit(None).cast("string").alias("pk_before"), F.array(*[F.lit(c) for c in columns]).cast("array<string>").alias("row_columns"), F.array(*[text(c) for c in columns]).cast("array<string>").alias("row_values"),
        F.lit(file).alias("binlog_file"), F.lit(pos).cast("bigint").alias("binlog_pos"), F.lit(0).alias("row_no"), F.lit(None).cast("string").alias("gtid"), F.lit(None).cast("timestamp_ntz").alias("committed_at"), F.lit(None).cast("timestamp_ntz").alias("received_at"),
    )


def worker_state(last_applied: Column, now: Column) -> Column:
    """live within a minute of the last applied batch, lagging after it, unknown if there was none."""
    lag = F.unix_timestamp(now.cast("timestamp")) - F.unix_timestamp(last_applied.cast("timestamp"))
    return F.when(last_applied.isNull(), "unknown").when(lag < 60, "live").otherwise("lagging")
