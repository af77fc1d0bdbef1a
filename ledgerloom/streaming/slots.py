"""Extension: profiles of guided conversations as a stream. Each message's updates change its conversation's profile, and the slot to ask for next follows."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ledgerloom.operators.conversation import NUMBERS, SLOTS, slot_updates

OPTIONAL = ("autres_revenus_mensuels",)
#: Longest text that a slot takes.
LONGEST = 100


def accepted(field: str, text: str | None, number: float | None) -> str | float | None:
    """The value that an update brings to its slot; None if it is not valid."""
    if field in NUMBERS:
        return number if number is not None and number >= 0 else None
    text = (text or "").strip()
    return text[:LONGEST] or None


def next_slots(messages: DataFrame, key: str, idle: str = "1 hour", lateness: str = "10 minutes") -> DataFrame:
    """(key, event_id, next, missing) after each message that says something: the slot to ask for next in the fixed order (NULL: none), and all required ones that are open.

    messages: a stream of (key, event_id, ts, message, expected). A message counts once however often it is delivered within the watermark; messages of one batch
    are taken in the order of (ts, event_id), and updates of an earlier time than a slot's last one do not change it, so replays and late messages give the same
    profile. A conversation without messages for `idle` is forgotten.
    """
    once = messages.withWatermark("ts", lateness).dropDuplicatesWithinWatermark([key, "event_id"])
    named = once.withColumn("_id", F.struct(key, "event_id", "ts"))
    said = slot_updates(named, "_id", "message", "expected").select(f"_id.{key}", "_id.event_id", "_id.ts", "field", "text", "number")
    idle_ms = int(pd.Timedelta(idle).total_seconds() * 1000)
    kind = dict(messages.dtypes)[key]

    def step(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        # Slot: time of its last update and value.
        profile = json.loads(state.get[0]) if state.exists else {}
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id", "field"])
        out = []
        for (_, event), part in rows.groupby(["ts", "event_id"], sort=True):
            for r in part.itertuples(index=False):
                value = accepted(r.field, r.text, None if pd.isna(r.number) else float(r.number))
                at = [r.ts.value, int(r.event_id)]
                if value is not None and (r.field not in profile or profile[r.field][0] <= at):
                    profile[r.field] = [at, value]
            open_slots = [s for s in SLOTS if s not in profile and s not in OPTIONAL]
            out.append((group[0], event, open_slots[0] if open_slots else None, "|".join(open_slots)))
        state.update((json.dumps(profile),))
        state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs(), int(rows.ts.max().value // 1_000_000)) + idle_ms)
        yield pd.DataFrame(out, columns=[key, "event_id", "next", "missing"])

    return said.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, event_id bigint, next string, missing string", "profile string", "append", GroupStateTimeout.EventTimeTimeout)
