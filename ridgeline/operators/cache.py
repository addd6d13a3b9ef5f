"""Tiered reads: a memory table, a stored table and the source behind them, replayed over a log of requests.

An instance of the service serves all requests of its keys. A request is answered from memory if the
key was put there and has neither expired nor been evicted, else from the stored table if the key
was stored and has not expired there, else from the source, whose answer is stored. What memory
didn't have is put into memory. Which keys are in memory depends on every put before, so an instance
is one ordered fold; instances are partitions. A task streams its sorted requests and holds the
entries of one instance, of which expired ones are dropped.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Seconds and entries of the map cache's tiers, and of the cache of each user's segment answers.
MEMORY_S, MEMORY_ENTRIES, STORED_S = 600, 30, 600
USER_ENTRIES, USER_S = 120, 600
MEMORY, STORED, SOURCE = "memory_hit", "stored_hit", "miss"


class Memory:
    """Entries in the order in which they were put, each with its end. ``policy``: "oldest" makes room by evicting the
    first put, "clear" by evicting all."""

    def __init__(self, entries: int, seconds: float, policy: str):
        self.entries, self.seconds, self.policy, self.ends = entries, seconds, policy, OrderedDict()

    def get(self, key: str, now: float) -> bool:
        return key in self.ends and self.ends[key] > now

    def put(self, key: str, now: float) -> int:
        """Number of entries that had to make room."""
        if self.policy == "oldest":  # the other policy counts expired entries too
            while self.ends and next(iter(self.ends.values())) <= now:  # all live equally long, so the first end first
                self.ends.popitem(last=False)
        evicted = 0
        while len(self.ends) >= self.entries:
            evicted += len(self.ends) if self.policy == "clear" else 1
            self.ends.clear() if self.policy == "clear" else self.ends.popitem(last=False)
        self.ends[key] = now + self.seconds
        return evicted


def _replay(entries: int, memory_s: float, stored_s: float | None, policy: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, memory, table = object(), None, None
        for batch in batches:
            outcomes, evictions = [], []
            for instance, key, now in zip(*(batch.column(c).to_pylist() for c in ("instance", "cache_key", "at"))):
                if instance != current:
                    current, memory, table = instance, Memory(entries, memory_s, policy), OrderedDict()
                if memory.get(key, now):
                    outcome, evicted = MEMORY, 0
                else:
                    while table and next(iter(table.values())) <= now:
                        table.popitem(last=False)
                    outcome = STORED if key in table else SOURCE
                    if outcome == SOURCE and stored_s is not None:
                        table[key] = now + stored_s
                    evicted = memory.put(key, now)
                outcomes.append(outcome)
                evictions.append(evicted)
            yield pa.RecordBatch.from_arrays([batch.column("instance"), batch.column("request_id"), pa.array(outcomes, pa.string()), pa.array(evictions, pa.int64())], names=["instance", "request_id", "outcome", "evicted"])

    return run


def read_through(requests: DataFrame, entries: int = MEMORY_ENTRIES, memory_s: float = MEMORY_S, stored_s: float | None = STORED_S, policy: str = "oldest") -> DataFrame:
    """(instance, request_id, outcome, evicted) of every request. requests: instance (long), request_id (long), cache_key (string), at (seconds).

    outcome: memory_hit, stored_hit or miss. evicted: memory entries that made room for this one. Requests of an
    instance run by (at, request_id). ``stored_s`` None: there is no stored table. Null instances are one instance,
    null keys one key; without a time a request comes first, at 0.
    """
    log = requests.select("instance", "request_id", F.coalesce("cache_key", F.lit("")).alias("cache_key"), F.coalesce("at", F.lit(0)).cast("double").alias("at"))
    ordered = log.repartition("instance").sortWithinPartitions("instance", "at", "request_id")
    return ordered.mapInArrow(_replay(entries, memory_s, stored_s, policy), "instance long, request_id long, outcome string, evicted long")


def read_user_answers(requests: DataFrame) -> DataFrame:
    """``read_through`` of the cache of segment answers: memory alone, an instance a user, emptied when it is full."""
    return read_through(requests, USER_ENTRIES, USER_S, None, "clear")
