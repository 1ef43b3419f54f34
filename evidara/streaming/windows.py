"""Windows that open at a key's first event, over a stream: the rows of operators.folds.first_event_windows, as windows close."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROWS = "key string, window_start timestamp, number long"


def processor(width_seconds: int):
    """The state of a key: its open window (first event, events so far) and the times that the watermark hasn't passed, which may still be preceded.

    The class is made in here, so that it is sent to the tasks by value.
    """
    from pyspark.sql import Row
    from pyspark.sql.streaming import StatefulProcessor

    width = width_seconds * 1_000_000

    class Windows(StatefulProcessor):
        def init(self, handle) -> None:
            self.handle = handle
            self.window = handle.getValueState("window", "begin long, n long")
            self.waiting = handle.getListState("waiting", "at long")
            self.timer = handle.getValueState("timer", "at long")

        def settled(self, key, timers):
            """Put the times that nothing can precede any more into windows, give the windows that are over, and set the next timer."""
            from datetime import UTC, datetime, timedelta

            now = timers.getCurrentWatermarkInMs() * 1000
            waiting = sorted(r[0] for r in self.waiting.get())
            begin, n = self.window.get() if self.window.exists() else (None, 0)
            over = lambda: Row(key=str(key[0]), window_start=datetime(1970, 1, 1, tzinfo=UTC) + timedelta(microseconds=begin), number=n)
            left = 0
            while left < len(waiting) and waiting[left] <= now:
                at = waiting[left]
                if begin is not None and at >= begin + width:
                    yield over()
                    begin = None
                begin, n = (at, 1) if begin is None else (begin, n + 1)
                left += 1
            if begin is not None and begin + width <= now:
                yield over()
                begin, n = None, 0
            if begin is None:
                self.window.clear()
            else:
                self.window.update((begin, n))
            rest = waiting[left:]
            if rest:
                self.waiting.put([(t,) for t in rest])
            else:
                self.waiting.clear()
            soon = min(rest[:1] + ([begin + width] if begin is not None else []), default=None)
            if self.timer.exists():
                self.handle.deleteTimer(self.timer.get()[0])
                self.timer.clear()
            if soon is not None:
                at = max(-(-soon // 1000), timers.getCurrentWatermarkInMs() + 1)
                self.handle.registerTimer(at)
                self.timer.update((at,))

        def handleInputRows(self, key, rows, timerValues):
            self.waiting.appendList([(r.at_micros,) for r in rows])
            yield from self.settled(key, timerValues)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            self.timer.clear()
            yield from self.settled(key, timerValues)

        def close(self) -> None:
            pass

    return Windows()


def first_event_windows(events: DataFrame, key: str, at: str, width_seconds: int, late: str) -> DataFrame:
    """Rows (key, window_start, number) of a stream, each once its window is over: events may come in any order within `late`.

    A key's state is one window and the times that the watermark hasn't passed. The session needs the RocksDB state store. Events
    that come later than that are left out, as those without a time are.
    """
    timed = events.where(F.col(at).isNotNull()).select(F.col(key).cast("string").alias("key"), F.col(at).cast("timestamp").alias("at"))
    timed = timed.withColumn("at_micros", F.unix_micros("at")).withWatermark("at", late)
    return timed.groupBy("key").transformWithState(processor(width_seconds), ROWS, "append", "eventTime")
