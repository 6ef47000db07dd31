"""Writes as a stream, the queue of work that they owe, and the quiet periods of a watcher.

A micro-batch is an epoch of the store: its number names the folders that it writes, so a batch that is run again after a
failure replaces its own output. The queue is a frame of jobs (project, kind, subject, priority, available_at, attempts,
claimed_by, claimed_at, error): one row for each project, kind and subject.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.ledger import WRITE
from ..sources.store import Store

JOB = "project string, kind string, subject string, priority int, available_at timestamp, attempts int, claimed_by string, claimed_at timestamp, error string"
PRIORITY = {"sync_index": 10, "derive_mentions": 20, "backfill_mentions": 50, "optimize": 100}
KEY = ["project", "kind", "subject"]
LEASE, RETRY = "INTERVAL 60 SECONDS", "INTERVAL 1 HOUR"
MOST_ATTEMPTS, BATCH, IDLE_ROUND = 8, 64, 16
QUIET, LONGEST = 1.0, 10.0


def writes(spark: SparkSession, folder: str, most_files: int = 1000) -> DataFrame:
    """Writes that arrive as files of JSON lines."""
    return spark.readStream.schema(WRITE).option("maxFilesPerTrigger", most_files).json(folder)


def cascade(store: Store, source: DataFrame, checkpoint: str, every: str = "5 seconds", available_now: bool = False, after: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Applies each batch of writes to the ledger, then to the projection, then to what `after` does with its jobs."""

    def epoch(batch: DataFrame, number: int) -> None:
        jobs = store.remember(batch, number + 1)
        if after is not None:
            after(jobs, number + 1)

    out = source.writeStream.foreachBatch(epoch).option("checkpointLocation", checkpoint)
    return (out.trigger(availableNow=True) if available_now else out.trigger(processingTime=every)).start()


# --- the queue


def priority_of(kind: Column) -> Column:
    return F.coalesce(*(F.when(kind == k, v) for k, v in PRIORITY.items()), F.lit(100))


def enqueue(queue: DataFrame, owed: DataFrame, now: Column) -> DataFrame:
    """The queue with what is owed (project, kind, subject): due now, unclaimed, no attempts; an exhausted job revives."""
    none = F.lit(None)
    new = owed.select(*KEY).distinct().select(*KEY, priority_of(F.col("kind")).alias("priority"), now.alias("available_at"), F.lit(0).alias("attempts"), none.cast("string").alias("claimed_by"), none.cast("timestamp").alias("claimed_at"), none.cast("string").alias("error"))
    return queue.join(new.select(*KEY), KEY, "left_anti").unionByName(new)


def due(queue: DataFrame, now: Column, kinds: list[str] | None = None) -> DataFrame:
    rows = queue.where((F.col("available_at") <= now) & (F.col("attempts") < MOST_ATTEMPTS))
    return rows if kinds is None else rows.where(F.col("kind").isin(kinds))


def claim(queue: DataFrame, worker: str, now: Column, batch: int = BATCH, kinds: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """The queue after a claim, and the jobs claimed: the first by priority, then by when they were due. A lease ends by itself."""
    first = due(queue, now, kinds).orderBy("priority", "available_at", *KEY).limit(batch)
    taken = first.withColumns({"claimed_by": F.lit(worker), "claimed_at": now, "attempts": F.col("attempts") + 1, "available_at": now + F.expr(LEASE)})
    return queue.join(taken.select(*KEY), KEY, "left_anti").unionByName(taken), taken


def _mine(queue: DataFrame, jobs: DataFrame) -> DataFrame:
    """Jobs whose claim still stands, as the queue has it."""
    held = jobs.select(*KEY, F.col("claimed_by").alias("by"), F.col("claimed_at").alias("at"))
    return queue.join(held, KEY).where(F.col("claimed_by").eqNullSafe(F.col("by")) & F.col("claimed_at").eqNullSafe(F.col("at"))).select(*queue.columns)


def complete(queue: DataFrame, jobs: DataFrame) -> DataFrame:
    """The queue without the jobs, as far as nobody has claimed or enqueued them since."""
    return queue.join(_mine(queue, jobs).select(*KEY), KEY, "left_anti")


def fail(queue: DataFrame, jobs: DataFrame, error: str, now: Column) -> DataFrame:
    """Failed jobs are released and due in an hour; after the last attempt they stay, exhausted."""
    none = F.lit(None)
    failed = _mine(queue, jobs).withColumns({"available_at": now + F.expr(RETRY), "claimed_by": none.cast("string"), "claimed_at": none.cast("timestamp"), "error": F.lit(error)})
    return queue.join(failed.select(*KEY), KEY, "left_anti").unionByName(failed)


def exhausted(queue: DataFrame) -> DataFrame:
    return queue.where(F.col("attempts") >= MOST_ATTEMPTS)


def replay(queue: DataFrame, now: Column) -> DataFrame:
    """Exhausted jobs due now, with no attempts."""
    dead = F.col("attempts") >= MOST_ATTEMPTS
    return queue.withColumns({"available_at": F.when(dead, now).otherwise(F.col("available_at")), "attempts": F.when(dead, 0).otherwise(F.col("attempts"))})


def discard(queue: DataFrame) -> DataFrame:
    return queue.where(F.col("attempts") < MOST_ATTEMPTS)


def drain(queue: DataFrame, work: Callable[[DataFrame], None], worker: str, now: Column, batch: int = BATCH, kinds: list[str] | None = None, rounds: int | None = None, written: Callable[[DataFrame], DataFrame] = DataFrame.persist) -> tuple[DataFrame, int]:
    """Claims and works until nothing is due, or for so many rounds. Index writes come first, by priority; a batch that fails is tried job by job.

    `written` cuts the queue's lineage between rounds. Returns the queue and how many jobs were done.
    """
    done = 0
    while rounds is None or rounds > 0:
        rounds = None if rounds is None else rounds - 1
        queue, taken = claim(queue, worker, now, batch, kinds)
        queue, taken = written(queue), written(taken)
        n = taken.count()
        if not n:
            break
        try:
            work(taken)
            queue, done = written(complete(queue, taken)), done + n
        except Exception:  # noqa: BLE001
            for row in taken.collect():  # at most a batch
                one = taken.where(" AND ".join(f"{k} <=> '{row[k]}'" for k in KEY))
                try:
                    work(one)
                    queue, done = complete(queue, one), done + 1
                except Exception as error:  # noqa: BLE001
                    queue = fail(queue, one, str(error)[:500], now)
            queue = written(queue)
    return queue, done


# --- the watcher


def flushes(changes: DataFrame, quiet: float = QUIET, longest: float = LONGEST) -> DataFrame:
    """root, flush, opened, closed, paths, deleted of changes (root, path, at in seconds, gone).

    A flush ends after `quiet` seconds without a change, and at the latest `longest` seconds after it began, counted from its first
    change. A deletion that would be alone in its flush waits one more quiet period for the other half of a move.
    """
    import pandas as pd

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["at", "path"])
        out, now, number = [], [], 0

        def close():
            nonlocal now, number
            number += 1
            out.append((rows["root"].iloc[0], number, now[0][0], now[-1][0], sorted({p for _, p, _ in now}), sorted({p for _, p, g in now if g} - {p for _, p, g in now if not g})))
            now = []

        for at, path, gone in zip(rows["at"], rows["path"], rows["gone"], strict=True):
            if now:
                alone = len(now) == 1 and now[0][2]
                if at - now[-1][0] >= quiet * (2 if alone else 1) or at - now[0][0] >= longest:
                    close()
            now.append((at, path, bool(gone)))
        if now:
            close()
        return pd.DataFrame(out, columns=["root", "flush", "opened", "closed", "paths", "deleted"])

    return changes.groupBy("root").applyInPandas(run, "root string, flush long, opened double, closed double, paths array<string>, deleted array<string>")


def stale(hits: DataFrame, recorded: DataFrame, seen: DataFrame) -> DataFrame:
    """Files of hits (path) that are no longer as recorded (path, size, mtime): to be ingested before the answer is given anew."""
    was, now = recorded.select("path", F.col("size").alias("s"), F.col("mtime").alias("m")), seen.select("path", "size", "mtime")
    rows = hits.select("path").distinct().join(now, "path", "left").join(was, "path", "left")
    return rows.where(~(F.col("size").eqNullSafe(F.col("s")) & F.col("mtime").eqNullSafe(F.col("m")))).select("path")
