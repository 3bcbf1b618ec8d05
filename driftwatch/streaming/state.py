"""Per-key stateful processors: predecessors, suppression, change patterns, in the order of event time.

Rows may come in any order within the watermark's delay. Each key holds them back in buckets of event time; the watermark
releases whole buckets, oldest first, and only then do they meet the key's state. Neighbouring buckets are stored as one
block of some thousand rows, so that calls to the store and frames follow the rows and not the minutes that they fall in,
and a frame stays bounded whatever the size of a micro-batch. A row whose bucket was released before it came is late: it is told with ``late`` set, and changes
nothing. Times are microseconds. Ids and keys keep their types.
"""

from __future__ import annotations

import pickle
from bisect import bisect_right
from collections.abc import Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: Milliseconds after an emission beyond which no alert is suppressed by it (the longest window).
LONGEST_WINDOW_MS = 2 * 3600 * 1000
#: Milliseconds of event time that are released together.
BUCKET_MS = 60_000
#: Rows of neighbouring buckets that are stored together; a single bucket may hold more.
BLOCK_ROWS = 4096
PATTERN_DEPTH = 10


class Ordered(StatefulProcessor):
    """Holds rows back until the watermark passes their bucket, then gives them to ``release`` in order."""

    #: Columns of the rows that are held (``at`` in microseconds and ``id`` give the order).
    held: list[str] = ["id", "at"]
    #: Whether the key's own state goes at some time.
    ends = False

    def __init__(self, output: T.StructType, bucket_ms: int = BUCKET_MS, block_rows: int = BLOCK_ROWS):
        self.output, self.bucket_ms, self.block_rows = output, bucket_ms, block_rows

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # a block is named by its first bucket; ``plan`` holds the key's timer and the names of its blocks
        self.buckets = handle.getMapState("buckets", "bucket long", "rows binary")
        self.plan = handle.getValueState("plan", "alarm long, blocks binary")
        self.open_state(handle)

    def open_state(self, handle: StatefulProcessorHandle) -> None:
        """Open the state of the key itself."""

    def load(self):
        """The key's own state."""
        raise NotImplementedError

    def save(self, known) -> None:
        raise NotImplementedError

    def release(self, key, rows: list[tuple], known) -> tuple[list[tuple], object]:
        """Output rows for the held rows of a bucket, which are in order (``late`` is added), and the key's new state."""
        raise NotImplementedError

    def expires(self, known) -> int | None:
        """When (in milliseconds) the key's own state is of no more use; None if never."""
        return None

    def forget(self) -> None:
        """Clear the key's own state."""

    def bucket(self, row: tuple) -> int:
        return row[self.held.index("at")] // (1000 * self.bucket_ms)

    def planned(self) -> tuple[int | None, list[int]]:
        found = self.plan.get()
        return (found[0], pickle.loads(found[1])) if found is not None else (None, [])

    def block(self, start: int) -> list[tuple]:
        return pickle.loads(self.buckets.getValue((start,))[0])

    def put(self, rows: list[tuple]) -> list[int]:
        """Store rows that are in order as blocks of whole buckets; the blocks' names."""
        starts, part = [], []
        for _, bucket in groupby(rows, self.bucket):
            own = list(bucket)
            if part and len(part) + len(own) > self.block_rows:
                starts.append(self.bucket(part[0]))
                self.buckets.updateValue((starts[-1],), (pickle.dumps(part),))
                part = []
            part += own
        if part:
            starts.append(self.bucket(part[0]))
            self.buckets.updateValue((starts[-1],), (pickle.dumps(part),))
        return starts

    def order(self, row: tuple) -> tuple:
        return row[self.held.index("at")], row[self.held.index("id")]

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        alarm, starts = self.planned()
        late: list[tuple] = []
        for frame in rows:
            parts: dict[int | None, list[tuple]] = {}
            for row in zip(*[frame[c].tolist() for c in self.held]):
                bucket = self.bucket(row)
                if (bucket + 1) * self.bucket_ms <= passed:
                    late.append(row)
                else:
                    # rows before all blocks go to the first one
                    parts.setdefault(starts[max(bisect_right(starts, bucket) - 1, 0)] if starts else None, []).append(row)
            for start, new in parts.items():
                before = self.block(start) if start is not None else []
                now = self.put(sorted(before + new, key=self.order))
                if start is not None and start not in now:
                    self.buckets.removeKey((start,))
                starts = sorted({*starts, *now} - ({start} - {*now}))
        self.set_alarm(passed, alarm, starts, self.expires(self.load()) if self.ends else None)
        if late:
            yield self.frame([(*self.late(key, row), True) for row in late])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        _, starts = self.planned()
        known, out = self.load(), []
        while starts and (starts[0] + 1) * self.bucket_ms <= passed:
            start = starts.pop(0)
            rows = self.block(start)
            ready = [row for row in rows if (self.bucket(row) + 1) * self.bucket_ms <= passed]
            self.buckets.removeKey((start,))
            starts = [*self.put(rows[len(ready) :]), *starts]
            for _, bucket in groupby(ready, self.bucket):
                new, known = self.release(key, list(bucket), known)
                out += new
            self.save(known)
            if len(out) >= self.block_rows:
                yield self.frame([(*row, False) for row in out])
                out = []
        if out:
            yield self.frame([(*row, False) for row in out])
        end = self.expires(known)
        if end is not None and end <= passed and not starts:
            self.forget()
            end = None
        self.set_alarm(passed, None, starts, end)

    def set_alarm(self, passed: int, now: int | None, starts: list[int], end: int | None) -> None:
        """One timer a key: the end of its oldest bucket, or of its state."""
        times = [*((start + 1) * self.bucket_ms for start in starts[:1]), *([end] if end is not None else [])]
        wanted = max(min(times), passed + 1) if times else None
        if wanted != now:
            if now is not None:
                self.handle.deleteTimer(now)
            if wanted is not None:
                self.handle.registerTimer(wanted)
        if wanted is None:
            self.plan.clear()
        else:
            self.plan.update((wanted, pickle.dumps(starts)))

    def late(self, key, row: tuple) -> tuple:
        """The output row that tells of a late one: its key, id and time, the rest null."""
        told = {"id": row[self.held.index("id")], "at": row[self.held.index("at")], "key": key[0], "website_id": key[0]}
        return tuple(told.get(name) for name in self.output.names[:-1])

    def frame(self, rows: list[tuple]) -> pd.DataFrame:
        columns = list(zip(*rows))
        whole = {T.LongType(): "Int64", T.IntegerType(): "Int32", T.ShortType(): "Int16", T.BooleanType(): "boolean"}
        series = {f.name: pd.Series(list(v), dtype=whole.get(f.dataType, "float64" if f.dataType == T.DoubleType() else "object")) for f, v in zip(self.output, columns)}
        return pd.DataFrame(series)

    def close(self) -> None:
        pass


class Predecessor(Ordered):
    """Emits every snapshot with the one before it."""

    held = ["id", "at", "content_hash"]

    def __init__(self, output: T.StructType, bucket_ms: int = BUCKET_MS, block_rows: int = BLOCK_ROWS):
        super().__init__(output, bucket_ms, block_rows)
        self.last_schema = T.StructType([T.StructField("id", output["id"].dataType), T.StructField("content_hash", T.StringType()), T.StructField("at", T.LongType())])

    def open_state(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", self.last_schema)

    def load(self):
        found = self.last.get()
        return tuple(found) if found is not None else None

    def save(self, known):
        if known is not None:
            self.last.update(known)

    def release(self, key, rows, known):
        before, out = known, []
        for id_, at, digest in rows:
            out.append((key[0], id_, at, digest, *(before or (None, None, None)), before is None))
            before = (id_, digest, at)
        return out, before


class Suppression(Ordered):
    """Emits the alerts that pass suppression; remembers the last emission of a key as long as it can matter."""

    held = ["id", "at", "window"]
    ends = True

    def open_state(self, handle: StatefulProcessorHandle) -> None:
        self.emitted = handle.getValueState("emitted", "at long")

    def load(self):
        found = self.emitted.get()
        return found[0] if found is not None else None

    def save(self, known):
        if known is not None:
            self.emitted.update((known,))

    def release(self, key, rows, known):
        last, out = known, []
        for id_, at, window in rows:
            if last is None or at - last >= window:
                out.append((id_, key[0], at))
                last = at
        return out, last

    def expires(self, known):
        # whole milliseconds, rounded up, so that no alert within the window comes after
        return -(-known // 1000) + LONGEST_WINDOW_MS if known is not None else None

    def forget(self) -> None:
        self.emitted.clear()


class ChangePattern(Ordered):
    """Emits the change pattern over the last ten hashes whenever snapshots are released."""

    held = ["id", "at", "content_hash"]

    def open_state(self, handle: StatefulProcessorHandle) -> None:
        self.history = handle.getListState("history", "content_hash string, at long")

    def load(self):
        return [tuple(r) for r in self.history.get()] if self.history.exists() else []

    def save(self, known):
        if known:
            self.history.put(known)

    def release(self, key, rows, known):
        history = (known + [(digest, at) for _, at, digest in rows])[-PATTERN_DEPTH:]
        gaps = [(b[1] - a[1]) / 1e6 for a, b in zip(history, history[1:]) if a[0] != b[0]]
        mean = sum(gaps) / len(gaps) if gaps else None
        return [(key[0], len(history), len(gaps), len(gaps) / len(history), mean, history[-1][1])], history

    def late(self, key, row):
        return (key[0], None, None, None, None, row[self.held.index("at")])
