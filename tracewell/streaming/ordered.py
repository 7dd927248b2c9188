"""State for each person that sees events in order of time, however they come in, and ends when nothing is due."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Ordered(StatefulProcessor):
    """Keeps a person's events until the watermark has passed them, then gives them to the rules one by one.

    Events are rows (passport_id, us, id, said): microseconds, a number that orders those of one instant, and a text.  Rules have
    one text of state.  A timer is set for the first event or deadline to come; with neither, all of the person's state goes.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getListState("pending", "us long, id long, said string")
        self.held = handle.getValueState("held", "held string, due long")

    def close(self) -> None:
        pass

    # ---- what a subclass says

    def event(self, who: Any, held: str | None, us: int, said: str | None, out: list) -> tuple[str | None, int | None]:
        """The state and the deadline (microseconds) after an event; None for neither."""
        raise NotImplementedError

    def deadline(self, who: Any, held: str | None, due: int, out: list) -> tuple[str | None, int | None]:
        """The state and the next deadline once `due` has come before any event of that instant."""
        raise NotImplementedError

    # ---- what Spark calls

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802
        now = timerValues.getCurrentWatermarkInMs()
        fresh = [(r.us, r.id, r.said) for r in rows if r.us // 1000 > now]
        return self._onward(key[0], fresh, now)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802
        return self._onward(key[0], [], timerValues.getCurrentWatermarkInMs())

    def _onward(self, who: Any, fresh: list[tuple], now: int) -> Iterator[Row]:
        waiting = [tuple(x) for x in self.pending.get()] if self.pending.exists() else []
        held, due = self.held.get() if self.held.exists() else (None, None)
        out: list[Row] = []
        ready = sorted((x for x in waiting + fresh if x[0] // 1000 <= now), key=lambda x: x[:2])
        later = [x for x in waiting + fresh if x[0] // 1000 > now]
        for us, _, said in ready:
            while due is not None and due <= us:
                held, due = self.deadline(who, held, due, out)
            held, due = self.event(who, held, us, said, out)
        while due is not None and due <= now * 1000:
            held, due = self.deadline(who, held, due, out)
        if ready or fresh:
            if later:
                self.pending.put(later)
            else:
                self.pending.clear()
        if held is None and due is None:
            self.held.clear()
        else:
            self.held.update((held, due))
        wake = min([x[0] // 1000 for x in later] + ([-(-due // 1000)] if due is not None else []), default=None)
        if wake is not None:
            self.handle.registerTimer(wake)
        return iter(out)


def ordered(events: DataFrame, rules: Ordered, said, schema: str, late: str) -> DataFrame:
    """Run rules over a stream of (passport_id, ts and, if there is one, id); what the events say is the text `said`."""
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    number = F.col("id").cast("long") if "id" in events.columns else F.lit(0).cast("long")
    rows = events.withWatermark("ts", late).filter("passport_id IS NOT NULL AND ts IS NOT NULL")
    rows = rows.select("passport_id", "ts", F.unix_micros("ts").alias("us"), number.alias("id"), said.alias("said"))
    return rows.groupBy("passport_id").transformWithState(rules, schema, "append", "eventTime")
