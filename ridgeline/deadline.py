"""Work under a time limit: jobs of a block are cancelled together, and what it stored is deleted."""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import SparkContext
from pyspark.sql import SparkSession

from ridgeline.cluster import scope

#: Seconds between two cancellations, for a block that starts job after job.
AGAIN_S = 0.2
#: Seconds that cancelled tasks are given to end before what they wrote is deleted.
GRACE_S = 30


class DeadlineExceeded(Exception):
    """The time of a block is over, or it was cancelled."""

    code = "timeout"


class Budget:
    """When a block has to end. Tasks may be sent one: the end is a time of the clock."""

    def __init__(self, seconds: float):
        self.end = time.time() + seconds
        self.cancelled = False

    def left(self) -> float:
        return 0.0 if self.cancelled else max(0.0, self.end - time.time())

    def check(self) -> None:
        """Raises DeadlineExceeded once nothing is left; for loops between jobs and within a task."""
        if not self.left():
            raise DeadlineExceeded

    def cancel(self) -> None:
        """Ends the block early, from any thread of the driver."""
        self.cancelled = True


def _settle(context: SparkContext, tag: str) -> None:
    """Waits for the tasks of cancelled jobs: one that still runs would write into a folder again that is deleted already."""
    tracker, until = context.statusTracker(), time.time() + GRACE_S
    jobs = context._jsc.sc().statusTracker().getJobIdsForTag(tag)
    stages = {s for job in jobs if (info := tracker.getJobInfo(job)) for s in info.stageIds}
    while time.time() < until and any((info := tracker.getStageInfo(s)) and info.numActiveTasks for s in stages):
        time.sleep(0.05)


@contextmanager
def deadline(spark: SparkSession, seconds: float) -> Iterator[Budget]:
    """Cancels the jobs that this thread runs inside, once ``seconds`` are over or its budget is cancelled.

    Whatever the block then fails with becomes DeadlineExceeded; errors before that stay as they are. A block that ends by
    itself, if late, does so unharmed. Tables stored inside are deleted either way. Jobs of other threads go on.
    """
    context, tag, budget, done = spark.sparkContext, f"deadline-{uuid.uuid4().hex}", Budget(seconds), threading.Event()

    def watch() -> None:
        while not done.wait(min(AGAIN_S, max(budget.left(), 0.01))):
            if not budget.left():
                context.cancelJobsWithTag(tag)
                done.wait(AGAIN_S)

    watcher = threading.Thread(target=watch, daemon=True)
    context.addJobTag(tag)
    watcher.start()
    try:
        with scope(spark):
            try:
                yield budget
            except Exception:
                _settle(context, tag)
                raise
    except Exception as error:
        if budget.left():
            raise
        raise DeadlineExceeded(f"after {seconds} s") from error
    finally:
        done.set()
        watcher.join()
        context.removeJobTag(tag)
