"""N-gram counts of open cases, event by event: what arrives late corrects what was counted, what is closed is evicted.

Every case keeps its events since the watermark and the last ``n - 1`` activities before it, which no late event can come between any more. Arriving
events are put in their place; the n-grams that appear by that are sent with +1 and those that disappear with -1, so the sums over all rows ever sent are the counts of a batch
over the same events in any order of arrival within the lateness. A timer closes a case ``gap`` after its last event: the end is sent and the state goes.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tracefold.operators.traces import END, START

CHANGES = "log string, node array<string>, delta long"


def windows(tokens: list[str], n: int) -> Counter:
    return Counter(tuple(tokens[i : i + n]) for i in range(len(tokens) - n + 1))


class OpenCases(StatefulProcessor):
    """State of a case: its settled end (``tail``, and how many tokens were settled) and its unsettled events."""

    def __init__(self, n: int, gap_ms: int):
        self.n, self.gap = n, gap_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.tail = handle.getValueState("tail", "tokens array<string>, many long, last long, timer long")
        self.events = handle.getListState("events", "ts long, id long, activity string")

    def _read(self) -> tuple[list[str], int, int, int, list[tuple]]:
        tail = self.tail.get() if self.tail.exists() else None
        tokens, many, last, timer = (list(tail[0]), tail[1], tail[2], tail[3]) if tail else ([START], 1, 0, -1)
        return tokens, many, last, timer, [tuple(e) for e in self.events.get()] if self.events.exists() else []

    def _changes(self, key, new: Counter, old: Counter) -> Iterator[pd.DataFrame]:
        rows = [(key[0], list(node), new[node] - old[node]) for node in new | old if new[node] != old[node]]
        if rows:
            yield pd.DataFrame(rows, columns=["log", "node", "delta"])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        tokens, many, last, timer, old = self._read()
        arrived = [(int(ts), int(i), a) for pdf in rows for ts, i, a in zip(pdf["ts_ms"], pdf["event_id"], pdf["activity"], strict=True)]
        new = sorted([*old, *arrived])
        yield from self._changes(key, windows(tokens + [a for *_, a in new], self.n), windows(tokens + [a for *_, a in old], self.n))
        # what lies before the watermark is settled
        settled = [e for e in new if e[0] < timerValues.getCurrentWatermarkInMs()]
        tokens, many = (tokens + [a for *_, a in settled])[-(self.n - 1) :], many + len(settled)
        last = max([last, *(e[0] for e in arrived)])
        if timer >= 0:
            self.handle.deleteTimer(timer)
        timer = max(last + self.gap, timerValues.getCurrentWatermarkInMs() + 1)
        self.handle.registerTimer(timer)
        self.tail.update((tokens, many, last, timer))
        self.events.put([e for e in new if e not in settled]) if len(settled) < len(new) else self.events.clear()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        tokens, many, _, _, events = self._read()
        tokens, many = [*tokens, *(a for *_, a in events), END], many + len(events) + 1
        # a padded trace no longer than n is one node
        yield pd.DataFrame([(key[0], tokens[-self.n :] if many > self.n else tokens, 1)], columns=["log", "node", "delta"])
        self.tail.clear()
        self.events.clear()

    def close(self) -> None:
        pass


def ngram_changes(events: DataFrame, n: int = 2, lateness: str = "1 hour", gap_ms: int = 24 * 3_600_000) -> DataFrame:
    """Changes ``log, node, delta`` of the padded n-grams (n of 2 or more) of a stream of ``log, case_id, event_id, activity, ts``; events later than ``lateness`` are dropped.

    A case whose events lie more than ``gap_ms`` apart is two cases. Needs the RocksDB state store and append mode.
    """
    if n < 2:
        raise ValueError("single activities need no state")
    rows = events.withWatermark("ts", lateness).selectExpr("log", "case_id", "event_id", "activity", "ts", "unix_millis(ts) AS ts_ms")
    return rows.groupBy("log", "case_id").transformWithStateInPandas(OpenCases(n, gap_ms), CHANGES, "Append", "EventTime")
