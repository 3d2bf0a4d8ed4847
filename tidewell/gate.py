"""How many reads run at once in one driver."""

from __future__ import annotations

import threading
from collections.abc import Iterator
from contextlib import contextmanager

from tidewell.plans.compiler import Plan


class Busy(RuntimeError):
    """No place became free in time."""


class Gate:
    """Places for queries and, among them, for those with joins.

    A read with joins takes a place of both kinds, so many joins can't keep simple
    reads out. On a session with FAIR scheduling each kind runs in a pool of its own.
    """

    def __init__(self, queries: int = 8, joins: int = 2, wait: float = 30.0):
        self.wait = wait
        self.places = {"queries": threading.BoundedSemaphore(queries), "joins": threading.BoundedSemaphore(joins)}

    @contextmanager
    def open(self, plan: Plan) -> Iterator[Plan]:
        """The plan's actions belong inside; Busy if there is no place within the wait."""
        kinds = ["joins", "queries"] if plan.op.joins else ["queries"]
        context, taken = plan.catalog.spark.sparkContext, []
        try:
            for kind in kinds:
                if not self.places[kind].acquire(timeout=self.wait):
                    raise Busy(f"no place for {kind} within {self.wait} seconds")
                taken.append(kind)
            context.setLocalProperty("spark.scheduler.pool", f"tidewell_{kinds[0]}")
            yield plan
        finally:
            context.setLocalProperty("spark.scheduler.pool", None)
            for kind in reversed(taken):
                self.places[kind].release()
