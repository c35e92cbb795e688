"""Fragments of one speaker as a stateful stream: messages wait until the watermark has passed them, and are then joined in their order."""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from dialoom.operators import extract

#: Event time is a hundredth of the date: pandas takes times up to 2262 only, and dates may lie beyond. The watermark is exact to a tenth of a second.
SCALE = 100
OUT = "dialog_id long, role string, text string, message_ids array<long>, last_us long, is_forwarded boolean"


def _step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    waiting, group, excluded = json.loads(state.get[0]) if state.exists else ([], None, False)
    if not state.hasTimedOut:
        for rows in parts:
            waiting += [[int(r.us), int(r.id), r.role, r.text, bool(r.excluded), bool(r.is_forwarded)] for r in rows.itertuples()]
    mark = state.getCurrentWatermarkMs() * 1000 * SCALE + SCALE - 1
    waiting.sort(key=lambda m: m[:2])
    ready = [m for m in waiting if m[0] <= mark]
    waiting = waiting[len(ready) :]
    out = []
    for us, i, role, text, gone, forwarded in ready:
        if gone:
            excluded = True
            continue
        if group and not excluded and group["role"] == role and us - group["us"] <= extract.GAP_MICROS:
            group["texts"].append(text)
            group["ids"].append(i)
            group["us"], group["forwarded"] = us, group["forwarded"] or forwarded
        else:
            if group:
                out.append(group)
            group = {"role": role, "texts": [text], "ids": [i], "us": us, "forwarded": forwarded}
        excluded = False
    if group and (excluded or group["us"] + extract.GAP_MICROS < mark):
        out.append(group)
        group = None
    if out:
        yield pd.DataFrame([(key[0], g["role"], "\n".join(g["texts"]), g["ids"], g["us"], g["forwarded"]) for g in out], columns=[c.split()[0] for c in OUT.split(", ")])
    if not waiting and not group:
        state.remove()
        return
    state.update((json.dumps([waiting, group, excluded]),))
    next_us = waiting[0][0] if waiting else group["us"] + extract.GAP_MICROS + 1
    state.setTimeoutTimestamp(max(next_us, mark) // (1000 * SCALE) + 1)


def fragments(messages: DataFrame, *, lateness: str = "10 minutes") -> DataFrame:
    """Streaming form of operators.extract.fragments over classified messages (dialog_id, id, date, role, excl, text, is_forwarded).

    A group is emitted once the watermark, `lateness` behind the newest date, has passed its end by the gap. Messages that come later than that are dropped, as the watermark does; so
    are messages without a date, which have no place in a stream. A dialog without open groups keeps no state.
    """
    us = F.unix_micros("date")
    rows = messages.where("date is not null").withColumn("clock", F.timestamp_micros(F.call_function("div", us - F.pmod(us, F.lit(SCALE)), F.lit(SCALE))))
    rows = rows.withWatermark("clock", f"{math.ceil(pd.Timedelta(lateness).total_seconds() * 1000 / SCALE)} milliseconds")
    rows = rows.select("dialog_id", "clock", F.col("id").alias("id"), "role", F.coalesce("text", F.lit("")).alias("text"), F.col("excl").isNotNull().alias("excluded"), F.coalesce("is_forwarded", F.lit(False)).alias("is_forwarded"), us.alias("us"))
    return rows.groupBy("dialog_id").applyInPandasWithState(_step, OUT, "state string", "append", GroupStateTimeout.EventTimeTimeout)
