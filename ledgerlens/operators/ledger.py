"""The ledger: evidence as it came, versions of what was promoted, and reads of them.

A write is a row (project, topic, content, seq, recorded_at, valid_from, valid_to). Evidence keeps every write with its verdict;
states are the promoted ones, numbered by topic, each superseding the one before. Both are append-only; a state that is
deleted or retired is one whose `deleted_at` is set in a frame that replaces it.

Defined cases: null content is empty; of writes of one topic the order is that of `seq`; an interval that ends at or before
its beginning raises; a topic without live states has no current one; reads are of one project, which must be named.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import byte_slice, excerpt, normal

SHORTEST = 8
MOST_PENDING = 10_000
WRITE = "project string, topic string, content string, seq long, recorded_at timestamp, valid_from timestamp, valid_to timestamp"
EVIDENCE = f"{WRITE}, norm string, reason string, evidence_version int, content_hash string"
STATE = "project string, topic string, version int, seq long, content string, valid_from timestamp, valid_to timestamp, recorded_at timestamp, supersedes int, deleted_at timestamp"


def of_project(rows: DataFrame, project: str) -> DataFrame:
    """Rows of one project; no reader goes without."""
    if not project:
        raise ValueError("a project must be named")
    return rows.where(F.col("project") == project)


def checked(rows: DataFrame) -> DataFrame:
    wrong = F.coalesce(F.col("valid_to") <= F.col("valid_from"), F.lit(False))
    return rows.where(F.when(wrong, F.raise_error(F.lit("an interval ends at or before its beginning")).cast("boolean")).otherwise(F.lit(True)))


def holds_at(at: Column) -> Column:
    """Half-open, a null bound is open."""
    return (F.col("valid_from").isNull() | (F.col("valid_from") <= at)) & (F.col("valid_to").isNull() | (at < F.col("valid_to")))


def judged(writes: DataFrame, current: DataFrame) -> DataFrame:
    """Writes with norm and reason: empty, too_short, restatement or promoted.

    A restatement equals the topic's last promoted content after normalisation. That is the last content that was neither empty nor
    short, since a repeat leaves it as it is; before the batch it is the current state's (project, topic, content).
    """
    key = ["project", "topic"]
    held = current.select(*key, normal(F.col("content")).alias("held"))
    rows = checked(writes).withColumn("norm", normal(F.coalesce("content", F.lit("")))).join(held, key, "left")
    long_enough = F.length("norm") >= SHORTEST
    before = F.last(F.when(long_enough, F.col("norm")), True).over(Window.partitionBy(*key).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1))
    reason = F.when(F.col("norm") == "", "empty").when(~long_enough, "too_short").when(F.col("norm").eqNullSafe(F.coalesce(before, F.col("held"))), "restatement").otherwise("promoted")
    return rows.withColumn("reason", reason).drop("held")


def live(states: DataFrame) -> DataFrame:
    return states.where("deleted_at IS NULL")


def current(states: DataFrame) -> DataFrame:
    """The newest live state of each topic."""
    newest = live(states).groupBy("project", "topic").agg(F.max_by(F.struct(*states.columns), "version").alias("s"))
    return newest.select("s.*")


def recorded(writes: DataFrame, states: DataFrame, evidence: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Evidence and states to append, and jobs that the change owes: (project, kind, subject), one for each topic and kind."""
    key = ["project", "topic"]
    said = judged(writes, current(states))
    order = Window.partitionBy(*key).orderBy("seq")
    kept = evidence.groupBy(*key).agg(F.max("evidence_version").alias("known"))
    new_evidence = said.join(kept, key, "left").withColumn("evidence_version", (F.coalesce("known", F.lit(0)) + F.row_number().over(order)).cast("int"))
    new_evidence = new_evidence.withColumn("content_hash", F.sha2(F.coalesce("content", F.lit("")), 256)).drop("known")
    numbers = states.groupBy(*key).agg(F.max("version").alias("newest"))
    alive = current(states).select(*key, F.col("version").alias("alive"))
    promoted = said.where("reason = 'promoted'").join(numbers, key, "left").join(alive, key, "left")
    version = (F.coalesce("newest", F.lit(0)) + F.row_number().over(order)).cast("int")
    promoted = promoted.withColumn("version", version).withColumn("supersedes", F.coalesce(F.lag("version").over(order), F.col("alive")))
    new_states = promoted.select(*key, "version", "seq", "content", "valid_from", "valid_to", "recorded_at", "supersedes", F.lit(None).cast("timestamp").alias("deleted_at"))
    kinds = F.array(*(F.lit(k) for k in ("sync_index", "derive_mentions")))
    jobs = new_states.select(*key).distinct().select("project", F.explode(kinds).alias("kind"), F.col("topic").alias("subject"))
    return new_evidence.select(*writes.columns, "norm", "reason", "evidence_version", "content_hash"), new_states, jobs


def version_back(states: DataFrame, asked: DataFrame) -> DataFrame:
    """For (project, topic, back): the live version so many before the newest, clamped at the oldest, with what was really given."""
    own = Window.partitionBy("project", "topic")
    placed = live(states).withColumns({"actual": F.row_number().over(own.orderBy(F.desc("version"))) - 1, "available": F.count("*").over(own)})
    return placed.join(asked, ["project", "topic"]).where(F.col("actual") == F.least("back", F.col("available") - 1)).withColumn("is_current", F.col("actual") == 0)


def as_of(states: DataFrame, at: Column, known_by: Column | None = None) -> DataFrame:
    """The newest state of each topic that was recorded by then, if it holds at the moment."""
    seen = live(states) if known_by is None else live(states).where(F.col("recorded_at") <= known_by)
    return current(seen).where(holds_at(at))


def soft_delete(states: DataFrame, named: DataFrame, now: Column) -> DataFrame:
    """States with those named (project, topic, version) deleted; the pointer is whatever `current` then finds."""
    gone = named.select("project", "topic", "version").distinct().withColumn("gone", F.lit(True))
    rows = states.join(gone, ["project", "topic", "version"], "left")
    return rows.withColumn("deleted_at", F.when(F.col("gone") & F.col("deleted_at").isNull(), now).otherwise(F.col("deleted_at"))).select(*states.columns)


def retire(states: DataFrame, topics: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """All states of the topics deleted, and the jobs that take them out of the index."""
    live_ones = live(states).join(topics.select("project", "topic").distinct(), ["project", "topic"], "left_semi")
    jobs = live_ones.select("project", F.lit("sync_index").alias("kind"), F.col("topic").alias("subject")).distinct()
    return soft_delete(states, live_ones, now), jobs


def retire_seen(states: DataFrame, seen: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """Retires topics whose newest live version is still the one that the caller saw (project, topic, version)."""
    same = current(states).join(seen.select("project", "topic", "version").distinct(), ["project", "topic", "version"], "left_semi")
    return retire(states, same, now)


def rename(names: DataFrame, aliases: DataFrame, asked: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Names (project, topic_id, name) after the renames asked for (project, old, new), aliases, and those refused as the new name is taken."""
    taken = names.select("project", F.col("name").alias("new"))
    refused = asked.join(taken, ["project", "new"], "left_semi")
    done = asked.join(taken, ["project", "new"], "left_anti")
    moved = names.join(done.withColumnRenamed("old", "name"), ["project", "name"], "left")
    after = moved.select("project", "topic_id", F.coalesce("new", "name").alias("name"))
    kept = aliases.unionByName(moved.where("new IS NOT NULL").select("project", "topic_id", F.col("name").alias("alias")))
    return after, kept.distinct(), refused


def found(names: DataFrame, aliases: DataFrame, asked: DataFrame) -> DataFrame:
    """Topics by name, otherwise by an alias that no name shadows: (project, name) to topic_id and how it was found."""
    by_name = asked.join(names, ["project", "name"]).select("project", "name", "topic_id", F.lit("name").alias("by"))
    other = aliases.join(names.select("project", F.col("name").alias("alias")), ["project", "alias"], "left_anti").withColumnRenamed("alias", "name")
    return by_name.unionByName(asked.join(other, ["project", "name"]).select("project", "name", "topic_id", F.lit("alias").alias("by")))


def purge(project: str, **tables: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """All tables without a project's rows, and how many each had of them."""
    rest = {name: df.where(~F.col("project").eqNullSafe(project)) for name, df in tables.items()}
    counts = [df.where(F.col("project") == project).agg(F.lit(name).alias("table"), F.count("*").alias("rows")) for name, df in tables.items()]
    out = counts[0]
    for c in counts[1:]:
        out = out.union(c)
    return rest, out


def insert_if_absent(rows: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """What of new (the first of each key, by its columns) is to be appended."""
    one = new.groupBy(*key).agg(F.min(F.struct(*new.columns)).alias("r")).select("r.*")
    return one.join(rows.select(*key).distinct(), key, "left_anti")


def upsert(rows: DataFrame, new: DataFrame, key: list[str], seq: str) -> DataFrame:
    """All rows, a new one in place of an old one of its key; the highest seq of a key counts."""
    last = new.groupBy(*key).agg(F.max_by(F.struct(*new.columns), seq).alias("r")).select("r.*")
    return rows.join(last.select(*key), key, "left_anti").unionByName(last.select(*rows.columns))


def to_remember(sections: DataFrame, states: DataFrame, evidence: DataFrame) -> DataFrame:
    """Sections (project, topic, content) that say something new: not what is current, nor what the topic's last evidence holds."""
    key = ["project", "topic"]
    now = current(states).select(*key, normal(F.col("content")).alias("held"))
    last = evidence.groupBy(*key).agg(F.max_by("content_hash", "evidence_version").alias("hash"))
    rows = sections.join(now, key, "left").join(last, key, "left")
    same = normal(F.col("content")).eqNullSafe(F.col("held")) | F.sha2("content", 256).eqNullSafe(F.col("hash"))
    return rows.where(~same).select(*sections.columns)


def grep(evidence: DataFrame, needle: str, folded: bool = True, limit: int = 20) -> DataFrame:
    """The newest evidence that has a literal text, filtered and superseded too, with the byte where it first stands and an excerpt."""
    text, part = (F.lower("content"), F.lower(F.lit(needle))) if folded else (F.col("content"), F.lit(needle))
    at = F.position(part, text)
    rows = evidence.where(at > 0).withColumn("byte", F.octet_length(F.substring(F.col("content"), F.lit(1), at - 1)).cast("long"))
    return rows.withColumn("excerpt", excerpt(F.col("content"), F.col("byte"))).orderBy(F.desc("recorded_at"), F.desc("seq")).limit(limit)


def spans_read(spans: DataFrame, states: DataFrame) -> DataFrame:
    """topic, content, spans and evidence joined: each span's own text, cut from its state by bytes."""
    rows = current(states).join(spans, ["project", "topic"])
    return rows.withColumn("span_text", byte_slice(F.col("content"), F.col("byte_start"), F.col("byte_end")))


def wrong_spans(spans: DataFrame, states: DataFrame) -> DataFrame:
    """The first span whose text its state doesn't hold, for each project that has any."""
    bad = spans_read(spans, states).where(~F.col("span_text").eqNullSafe(F.col("text")))
    return bad.groupBy("project").agg(F.min(F.struct("topic", "ordinal")).alias("first"), F.count("*").alias("wrong")).where("wrong > 0")


def may_defer(pending: DataFrame, most: int = MOST_PENDING) -> bool:
    """Whether a write may leave its work to later: counting stops at the bound."""
    return pending.limit(most).count() < most


def trusted(seen: DataFrame, records: DataFrame, build: str) -> DataFrame:
    """Files as seen (path, size, mtime, ctime, inode) that need no reading: same as recorded by this build, and settled two seconds before that reading."""
    rows = seen.alias("s").join(records.alias("r"), "path")
    same = F.col("r.build") == build
    for c in ("size", "mtime", "ctime", "inode"):
        same = same & (F.col(f"s.{c}") == F.col(f"r.{c}"))
    settled = F.greatest("s.mtime", "s.ctime") < F.col("r.read_at") - F.expr("INTERVAL 2 SECONDS")
    return rows.where(same & settled).select("path")
