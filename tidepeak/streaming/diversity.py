"""Token diversity of a live chat: each room's sliding window is a table of counts that ticks enter and leave.

A tick enters when the watermark has passed its end: its tokens add one each to the counts, and those of the
tick that leaves take one away. So a token is touched three times in its life, whatever the radius, and no
window is ever counted anew. Rows may come in any order within the watermark's delay.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidepeak.schema import room_type
from tidepeak.streaming.live import LATE

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class SlidingTokens(StatefulProcessor):
    """State of a room: the tokens of ticks that wait or are in the window, the count of each token in it, and where it stands."""

    def __init__(self, radius: int, width_ms: int, origin_ms: int) -> None:
        self.radius, self.width, self.origin = radius, width_ms, origin_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.ticks = handle.getMapState("ticks", "t int", "tokens array<string>")
        self.counts = handle.getMapState("counts", "token string", "n long")
        self.place = handle.getValueState("place", "edge int, n long, distinct long")

    def end_of(self, tick: int) -> int:
        return self.origin + (tick + 1) * self.width

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        edge = self.place.get()[0] if self.place.exists() else None
        new: dict[int, list[str]] = {}
        for batch in rows:
            for t, text in zip(batch["t"], batch["content"], strict=True):
                if edge is None or t > edge:  # an earlier tick is complete
                    new.setdefault(int(t), []).extend((text or "").split())
        for t, tokens in new.items():
            held = self.ticks.getValue((t,))[0] if self.ticks.containsKey((t,)) else []
            self.ticks.updateValue((t,), ([*held, *tokens],))
            # when its own window is complete, and when it has left all windows
            for at in (t + self.radius, t + 2 * self.radius + 1):
                self.handle.registerTimer(self.end_of(at))
        yield pd.DataFrame({"room": [], "t": [], "distinct": [], "n": []})

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        upto = (timerValues.getCurrentWatermarkInMs() - self.origin) // self.width - 1
        edge, n, distinct = self.place.get() if self.place.exists() else (None, 0, 0)
        out = []
        while edge is None or edge < upto:
            if n == 0:  # to the next tick that has any row
                ahead = [k[0] for k in self.ticks.keys() if edge is None or k[0] > edge]
                following = min(ahead, default=upto + 1)
                if following > upto:
                    edge = upto
                    break
                edge = following - 1
            edge += 1
            entering = self.ticks.getValue((edge,))[0] if self.ticks.containsKey((edge,)) else []
            for token, count in Counter(entering).items():
                before = self.counts.getValue((token,))[0] if self.counts.containsKey((token,)) else 0
                self.counts.updateValue((token,), (before + count,))
                distinct += before == 0
            n += len(entering)
            gone = edge - 2 * self.radius - 1
            if self.ticks.containsKey((gone,)):
                leaving = self.ticks.getValue((gone,))[0]
                for token, count in Counter(leaving).items():
                    left = self.counts.getValue((token,))[0] - count
                    distinct -= left == 0
                    if left:
                        self.counts.updateValue((token,), (left,))
                    else:
                        self.counts.removeKey((token,))
                n -= len(leaving)
                self.ticks.removeKey((gone,))
            elif edge - self.radius >= 0 and not entering and n == 0:
                continue
            if n and edge - self.radius >= 0:
                out.append((key[0], edge - self.radius, distinct, n))
        self.place.update((edge, n, distinct))
        yield pd.DataFrame(out, columns=["room", "t", "distinct", "n"])

    def close(self) -> None:
        pass


def token_diversity(chat: DataFrame, radius: int = 30, width: float = 1.0, origin: float = 0.0, late: str = LATE) -> DataFrame:
    """(room, t, distinct, n): different tokens and tokens within `radius` ticks of each tick of a stream (room, ts, content), once all of its window is there.

    A tick is `width` seconds, counted from `origin` (seconds since 1970). Ticks whose window is empty are not reported; their
    diversity is 1. State is kept by RocksDB, as its operator asks for.
    """
    chat.sparkSession.conf.set(PROVIDER, ROCKSDB)
    seconds = F.unix_micros("ts") / 1e6 - origin
    rows = chat.withWatermark("ts", late).select("room", "ts", F.floor(seconds / width).cast("int").alias("t"), "content").where("t >= 0")
    counter = SlidingTokens(radius, round(width * 1000), round(origin * 1000))
    return rows.groupBy("room").transformWithStateInPandas(counter, f"room {room_type(chat)}, t int, distinct long, n long", "append", "eventTime")
