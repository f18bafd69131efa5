"""Streaming lease and quarantine state, one processor per user.

Input rows: user_id, at, ord, kind, lease_id, expires_at, approver with kind one of grant,
redeem, revoke, bulk_revoke, quarantine, resume. Output: one outcome per input row that asks
for something, and a `lease_expired` row when a lease's time runs out unused.

Rows may arrive in any order. They wait in a buffer until the watermark has passed them and are
then taken by (at, ord), so the outcome is that of the batch ledger however they were dealt over
files; rows later than the watermark are dropped, as everywhere in a stream. Expiry and the
end of retention are entries of the same buffer. A user has one timer, set to the earliest entry.

State per user: the rows the watermark has not passed, the live leases, whether the user is locked,
and each ended lease for `retention` after its end. A later attempt on a forgotten lease is `unknown`.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.expressions import epoch_micros

OUTPUT = "user_id {kind}, ord bigint, kind string, lease_id bigint, outcome string"
ROW = "at_us bigint, ord bigint, kind string, lease_id bigint, expires_us bigint, approver string"
REDEEMED, REVOKED, EXPIRED = "redeemed", "revoked", "expired"
EXPIRE, FORGET = "expire", "forget"
AFTER_ALL = 2**62  # place of the processor's own entries among rows of one instant


def whole(value) -> int | None:
    return None if pd.isna(value) else int(value)


class AccessState(StatefulProcessor):
    def __init__(self, retention_us: int):
        self.retention_us = retention_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.buffer = handle.getListState("buffer", ROW)
        self.timer = handle.getValueState("timer", "at_ms bigint")
        self.live = handle.getMapState("live", "lease_id bigint", "expires_us bigint")
        self.ended = handle.getMapState("ended", "lease_id bigint", "status string, at_us bigint")
        self.locked = handle.getValueState("locked", "since bigint")

    # ---- rules ----------------------------------------------------------------------------
    def _end(self, lease: int, status: str, now: int) -> list[tuple]:
        if self.live.containsKey((lease,)):
            self.live.removeKey((lease,))
        self.ended.updateValue((lease,), (status, now))
        return [(now + self.retention_us, AFTER_ALL, FORGET, lease, None, None)]

    def _take(self, user: str, row: tuple) -> tuple[list[tuple], list[tuple]]:
        """Outcomes of a row (ord, kind, lease_id, outcome), and entries it adds to the buffer."""
        now, order, kind, lease, expires, approver = row
        is_live = lease is not None and self.live.containsKey((lease,))
        status, since = self.ended.getValue((lease,)) if lease is not None and self.ended.containsKey((lease,)) else (None, None)
        if kind == "grant":
            self.live.updateValue((lease,), (expires,))
            return [], [(expires, AFTER_ALL, EXPIRE, lease, None, None)]
        if kind == "redeem":
            if is_live:
                return [(order, kind, lease, REDEEMED)], self._end(lease, REDEEMED, now)
            denied = {None: "unknown", REDEEMED: "already_redeemed"}.get(status, status)
            return [(order, kind, lease, denied)], []
        if kind == "revoke":
            if is_live or status == EXPIRED:
                return [(order, kind, lease, REVOKED)], self._end(lease, REVOKED, now)
            return [(order, kind, lease, "unknown" if status is None else "no_effect")], []
        if kind == "bulk_revoke":
            every = sorted(k[0] for k in self.live.keys())
            return [(order, kind, k, REVOKED) for k in every], [e for k in every for e in self._end(k, REVOKED, now)]
        if kind == "quarantine":
            self.locked.update((now,))
        elif kind == "resume":
            if not self.locked.exists():
                return [(order, kind, None, "not_quarantined")], []
            if not approver or approver == user:
                return [(order, kind, None, "denied_missing_or_self")], []
            self.locked.clear()
            return [(order, kind, None, "approved")], []
        elif kind == EXPIRE and is_live:
            return [(None, "timer", lease, "lease_expired")], self._end(lease, EXPIRED, now)
        elif kind == FORGET and since is not None and since + self.retention_us <= now:
            self.ended.removeKey((lease,))  # else it has ended anew since: another entry follows
        return [], []

    # ---- order ----------------------------------------------------------------------------
    def _arm(self, earliest_us: int) -> None:
        """One timer, at the first millisecond not before the earliest entry."""
        due = -(-earliest_us // 1000)
        if self.timer.exists():
            if self.timer.get()[0] <= due:
                return
            self.handle.deleteTimer(self.timer.get()[0])
        self.timer.update((due,))
        self.handle.registerTimer(due)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        earliest = None
        for frame in rows:  # a frame at a time: a busy user's batch is never held whole
            cells = zip(*(frame[c] for c in ("at_us", "ord", "kind", "lease_id", "expires_us", "approver")))
            waiting = [(int(at), int(order), kind, whole(lease), whole(expires), approver) for at, order, kind, lease, expires, approver in cells]
            if waiting:
                self.buffer.appendList(waiting)
                first = min(r[0] for r in waiting)
                earliest = first if earliest is None else min(earliest, first)
        if earliest is not None:
            self._arm(earliest)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed, later, due, out = timerValues.getCurrentWatermarkInMs() * 1000, [], [], []
        for row in self.buffer.get():
            (due if row[0] <= passed else later).append(tuple(row))
        heapq.heapify(due)
        while due:
            outcomes, entries = self._take(str(key[0]), heapq.heappop(due))
            out += outcomes
            for entry in entries:
                if entry[0] <= passed:
                    heapq.heappush(due, entry)
                else:
                    later.append(entry)
        self.timer.clear()
        self.buffer.clear()
        if later:
            self.buffer.put(later)
            self._arm(min(row[0] for row in later))
        frame = pd.DataFrame(out, columns=["ord", "kind", "lease_id", "outcome"])
        frame.insert(0, "user_id", [key[0]] * len(out))
        yield frame.astype({"ord": "Int64", "lease_id": "Int64"})

    def close(self) -> None:
        pass


def stream_access(ledger: DataFrame, delay: str = "1 hour", retention_days: int = 400) -> DataFrame:
    kind = dict(ledger.dtypes)["user_id"]
    rows = ledger.select(
        "user_id", "ord", "kind", "lease_id", "approver", epoch_micros("at").alias("at_us"),
        epoch_micros("expires_at").alias("expires_us"),
        F.timestamp_micros(epoch_micros("at")).alias("event_time")).withWatermark("event_time", delay)
    return rows.groupBy("user_id").transformWithStateInPandas(
        AccessState(retention_days * 86_400_000_000), OUTPUT.format(kind=kind), "Append", "EventTime")
