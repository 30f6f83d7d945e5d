"""The store over a stream of blocks: when each comes to life, lives on and expires."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from skein.functions.rows import col
from skein.operators.blocks import TTL, content_hash

#: The state of ``lives`` is kept by this store, which knows timers.
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def first_sights(stream: DataFrame, content: str = "content", created_at: str = "created_at", ttl: int = TTL) -> DataFrame:
    """Blocks of a stream, each once in ``ttl`` seconds from its first sight; the watermark bounds the state. Storing again doesn't lengthen that; see ``lives``."""
    rows = stream.select(content_hash(col(content)).alias("hash"), col(content).alias("content"), col(created_at).alias("created_at"))
    return rows.withWatermark("created_at", f"{ttl} seconds").dropDuplicatesWithinWatermark(["hash"])


#: Columns of what is told, and groups of blocks that share a state.
TOLD = ["hash", "event", "ms", "content"]
GROUPS = 1024
#: Hexadecimal digits of a hash.
DIGITS = 64


class _Lives(StatefulProcessor):
    """Of the living blocks of a group the times at which they were last stored, as one state, and a timer for the first end; nothing of dead ones.

    A call costs much more than a row, so a group's blocks of a batch are told by one call, with numpy.
    """

    def __init__(self, ttl: int) -> None:
        self.ttl = 1000 * ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("living", "hashes binary, last binary")

    def _held(self) -> tuple[list[str], np.ndarray]:
        if not self.state.exists():
            return [], np.empty(0, np.int64)
        names, last = self.state.get()
        names = bytes(names).hex()
        return [names[i : i + DIGITS] for i in range(0, len(names), DIGITS)], np.frombuffer(bytes(last), np.int64)

    def _keep(self, names: np.ndarray, last: np.ndarray, before: np.ndarray, watermark: int) -> pd.DataFrame:
        """Tells and forgets the blocks whose end the watermark has passed; a block of just its time lives."""
        gone = last + self.ttl < watermark
        names, out, left = names[~gone], pd.DataFrame({"hash": names[gone], "event": "expired", "ms": last[gone] + self.ttl, "content": None}, columns=TOLD), last[~gone]
        old, new = (int(x.min()) + self.ttl + 1 if len(x) else None for x in (before, left))
        if old != new:
            if old is not None and old > watermark:  # else it goes when it has fired
                self.handle.deleteTimer(old)
            if new is not None:
                self.handle.registerTimer(new)
        if len(left):
            self.state.update((bytes.fromhex("".join(names)), left.tobytes()))
        elif len(before):
            self.state.clear()
        return out

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows), ignore_index=True)
        held, before = self._held()
        blank = np.full(len(held), None, object)
        code, names = pd.factorize(np.concatenate([np.array(held, object), batch["hash"].to_numpy(object)]))
        ms, content = np.concatenate([before, batch["ms"].to_numpy(np.int64)]), np.concatenate([blank, batch["content"].to_numpy(object)])
        order = np.lexsort((ms, np.arange(len(ms)) >= len(held), code))  # by block: what is held, then by time
        floor = np.full(len(names), np.iinfo(np.int64).min)
        floor[code[: len(held)]] = before
        code, ms, content, row = code[order], ms[order], content[order], order >= len(held)
        last = np.maximum(ms, floor[code])  # rows may be older than what is held
        known = np.r_[False, code[1:] == code[:-1]]
        prior = np.r_[0, last[:-1]]
        dead = known & (ms - prior > self.ttl)
        fresh = row & (dead | ~known)
        hashes = names[code]
        told = pd.DataFrame({"hash": hashes[row], "event": np.where(fresh[row], "stored", "renewed"), "ms": ms[row], "content": np.where(fresh, content, None)[row]}, columns=TOLD)
        ends = pd.DataFrame({"hash": hashes[dead], "event": "expired", "ms": prior[dead] + self.ttl, "content": None}, columns=TOLD)
        final = np.r_[code[1:] != code[:-1], True]
        over = self._keep(hashes[final], last[final], before, timerValues.getCurrentWatermarkInMs())
        yield from (x for x in (told, ends, over) if len(x))

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held, before = self._held()
        over = self._keep(np.array(held, object), before, before, timerValues.getCurrentWatermarkInMs())
        if len(over):
            yield over

    def close(self) -> None:
        pass


def lives(stream: DataFrame, content: str = "content", created_at: str = "created_at", ttl: int = TTL, late: str = "0 seconds", groups: int = GROUPS) -> DataFrame:
    """hash, event (stored, renewed, expired), at and content (of stored): the lives of the blocks of a stream.

    A block lives until ``ttl`` seconds after it was last stored; storing it again while it lives
    renews it, later it is stored anew. Its end is told once the watermark, ``late`` behind the
    latest time, has passed it; then its state goes. Rows of a batch may come in any order; null
    contents and times are left out. Times are kept by the millisecond. Blocks are dealt by hash to
    ``groups``, each with one state of 40 bytes a living block, which is read and written whole.
    """
    stream.sparkSession.conf.set(PROVIDER, ROCKS)
    rows = stream.filter(col(content).isNotNull() & col(created_at).isNotNull()).select(content_hash(col(content)).alias("hash"), col(content).alias("content"), col(created_at).alias("created_at"))
    told = rows.withWatermark("created_at", late).withColumn("ms", F.unix_millis("created_at")).withColumn("group", F.pmod(F.xxhash64("hash"), F.lit(groups)))
    made = told.groupBy("group").transformWithStateInPandas(statefulProcessor=_Lives(ttl), outputStructType="hash string, event string, ms long, content string", outputMode="Append", timeMode="EventTime")
    return made.select("hash", "event", F.timestamp_millis("ms").alias("at"), "content")


def snapshot(events: DataFrame) -> DataFrame:
    """The store (hash, content, created_at, seq) that a table of such events leaves: blocks whose last event isn't their end."""
    alive = events.groupBy("hash").agg(F.max_by("event", F.struct("at", F.col("event") == "expired")).alias("_event"), F.max(F.when(F.col("event") != "expired", F.col("at"))).alias("created_at"), F.max_by("content", F.when(F.col("content").isNotNull(), F.col("at"))).alias("content"))
    return alive.filter(F.col("_event") != "expired").select("hash", "content", "created_at", F.unix_micros("created_at").alias("seq"))
