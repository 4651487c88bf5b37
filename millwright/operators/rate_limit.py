"""Sliding-window request limits over recorded requests."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millwright.functions.common import micros

AUDIT = "client string, request_id long, us long, accepted boolean, retry_after_seconds int, remaining int"


class Limiter:
    """Accepted times of one client within the window; at most ``limit`` of them."""

    def __init__(self, limit: int, window_us: int, accepted: list[int] | None = None):
        self.limit, self.window_us = limit, window_us
        self.accepted: deque[int] = deque(accepted or [])

    def ask(self, us: int) -> tuple[bool, int | None, int | None]:
        while self.accepted and us - self.accepted[0] >= self.window_us:
            self.accepted.popleft()
        if len(self.accepted) >= self.limit:
            return False, int((self.window_us - (us - self.accepted[0])) / 1_000_000), None
        self.accepted.append(us)
        return True, None, self.limit - len(self.accepted)


def _with_runs(requests: DataFrame, window_us: int) -> DataFrame:
    """Requests with the number of the busy run they fall in.

    Time is cut into windows.  After a whole window without requests nothing
    accepted earlier can matter, so runs of busy windows are independent.  They
    are numbered on distinct (client, window) pairs, which are few however many
    requests a client sends.
    """
    timed = requests.select("client", "request_id", micros("ts").alias("us")).withColumn("slot", F.floor(F.col("us") / F.lit(window_us)))
    busy = timed.select("client", "slot").distinct()
    by_client = W.partitionBy("client").orderBy("slot")
    fresh = (F.col("slot") - F.lag("slot", 1).over(by_client) > 1).cast("int")
    runs = busy.withColumn("fresh", F.coalesce(fresh, F.lit(0))).withColumn("run", F.sum("fresh").over(by_client)).drop("fresh")
    return timed.join(runs, ["client", "slot"]).drop("slot")


def rate_limit_audit(requests: DataFrame, limit: int = 60, window_seconds: int = 60) -> DataFrame:
    """Which of ``requests(client, request_id, ts)`` pass; refused ones do not use up the limit.

    The decision depends on the order within a run, so runs are dealt out and
    sorted by Spark and read through once; a task holds one client's last
    ``limit`` times, never a whole group.
    """
    window_us = window_seconds * 1_000_000

    def decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, limiter = None, None
        for batch in batches:
            verdicts = []
            for client, run, us in zip(batch["client"], batch["run"], batch["us"], strict=True):
                if (client, run) != current:
                    current, limiter = (client, run), Limiter(limit, window_us)
                verdicts.append(limiter.ask(us))
            out = pd.DataFrame(verdicts, columns=["accepted", "retry_after_seconds", "remaining"])
            yield pd.concat([batch[["client", "request_id", "us"]].reset_index(drop=True), out.astype({"retry_after_seconds": "Int32", "remaining": "Int32"})], axis=1)

    ordered = _with_runs(requests, window_us).repartition("client", "run").sortWithinPartitions("client", "run", "us", "request_id")
    return ordered.select("client", "run", "us", "request_id").mapInPandas(decide, AUDIT).withColumn("ts", F.timestamp_micros("us")).drop("us")


def request_pressure(requests: DataFrame, window_seconds: int = 60) -> DataFrame:
    """Requests of the same client in the window up to each request: an upper bound of those accepted."""
    window_us = window_seconds * 1_000_000
    recent = W.partitionBy("client", "run").orderBy("us").rangeBetween(-(window_us - 1), 0)
    return _with_runs(requests, window_us).select("client", "request_id", F.count("*").over(recent).alias("in_window"))
