"""State kept per group between micro-batches, and the timers that drop it."""

from __future__ import annotations

from statistics import median

from pyspark.sql import Row
from pyspark.sql.streaming.stateful_processor import StatefulProcessor
from pyspark.sql.types import StructType


def milliseconds(micros: int) -> int:
    """Rounded up, so that a timer is never early."""
    return -(-micros // 1000)


def ordered(values) -> tuple:
    """A sort key in which missing values come first."""
    return tuple((v is not None, v) if v is not None else (False,) for v in values)


class ConsensusOfPoll(StatefulProcessor):
    """Group (window start, keys): the last quote of each book, dropped when the window ends.

    ``state`` begins with the book, its last three fields are prices and probability, and what is between orders a book's quotes.
    """

    def __init__(self, state: StructType, out: list[str]):
        self.state, self.out = state, Row(*out)

    def init(self, handle):
        self.handle = handle
        self.quotes = handle.getListState("quotes", self.state)

    def handleInputRows(self, key, rows, timerValues):
        names, end, new = self.state.fieldNames(), None, []
        for row in rows:
            end = row["end_us_"]
            new.append(tuple(row[n] for n in names))
        if milliseconds(end) <= timerValues.getCurrentWatermarkInMs():
            return
        last = {quote[0]: tuple(quote) for quote in self.quotes.get()}
        if not last:
            self.handle.registerTimer(milliseconds(end))
        changed = False
        for quote in new:
            held = last.get(quote[0])
            if held is None or ordered(quote[1:-3]) >= ordered(held[1:-3]):
                last[quote[0]], changed = quote, True
        if changed:
            self.quotes.put(list(last.values()))
            a, b, p = (sorted(q[k] for q in last.values()) for k in (-3, -2, -1))
            best = [min(q[0] for q in last.values() if q[k] == top) for k, top in ((-3, a[-1]), (-2, b[-1]))]
            yield self.out(*key, a[len(a) // 2], b[len(b) // 2], median(p), len(last), p[-1] - p[0], a[-1], b[-1], *best)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.quotes.clear()
        yield from ()

    def close(self):
        pass


class CloseOfContest(StatefulProcessor):
    """Group (event, start): the earliest due capture, emitted and dropped when the event starts.

    ``state`` is the time of the capture, its lead, and the values that order captures of one time.
    """

    def __init__(self, state: StructType, out: list[str]):
        self.state, self.out = state, Row(*out)

    def init(self, handle):
        self.handle = handle
        self.capture = handle.getValueState("capture", self.state)

    def handleInputRows(self, key, rows, timerValues):
        names, start = self.state.fieldNames(), milliseconds(key[1])
        found = [tuple(row[n] for n in names) for row in rows]
        if start <= timerValues.getCurrentWatermarkInMs():
            return
        held = self.capture.get()
        if held is None:
            self.handle.registerTimer(start)
        else:
            found.append(tuple(held))
        first = min(found, key=ordered)
        if held is None or first != tuple(held):
            self.capture.update(first)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        held = self.capture.get()
        self.capture.clear()
        if held is not None:
            yield self.out(*key, *held)

    def close(self):
        pass
