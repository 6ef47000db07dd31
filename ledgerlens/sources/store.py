"""A ledger on shared storage: append-only folders by epoch, and the projection that is searched.

Each table is a folder of epochs; an epoch is written whole, by its number, so that a batch which runs twice writes the same
folder again. The newest row of a key is found when a table is read. Compaction writes all rows as one epoch and drops
the older ones.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.markdown import Tokens, span_frame
from ..functions.text import half_precision
from ..operators import ledger

TABLES = {
    "evidence": ledger.EVIDENCE,
    "states": ledger.STATE,
    "spans": "project string, topic string, ordinal int, byte_start long, byte_end long, header string, text string, tokens int, encoding string, vector array<float>, alive boolean",
}
KEYS = {"evidence": ["project", "topic", "evidence_version"], "states": ["project", "topic", "version"], "spans": ["project", "topic", "ordinal"]}


class Store:
    def __init__(self, spark: SparkSession, root: str, encoding: str = "", encoder=None, tokens: type[Tokens] = Tokens):
        self.spark, self.root, self.encoding, self.encoder, self.tokens = spark, root.rstrip("/"), encoding, encoder, tokens

    def _path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def _fs(self):
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.root)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def epochs(self, table: str) -> list[int]:
        fs, path = self._fs()
        at = path(self._path(table))
        if not fs.exists(at):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(at)]
        return sorted(int(n[6:]) for n in names if n.startswith("epoch="))

    def read(self, table: str) -> DataFrame:
        """The newest row of each key. The schema is the table's own, whatever the folder holds."""
        schema = T.StructType.fromDDL(TABLES[table])
        if not self.epochs(table):
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(T.StructType([*schema, T.StructField("epoch", T.LongType())])).parquet(self._path(table))
        newest = rows.groupBy(*KEYS[table]).agg(F.max_by(F.struct(*schema.names), "epoch").alias("r"))
        return newest.select("r.*")

    def write(self, table: str, rows: DataFrame, epoch: int) -> None:
        """An epoch's rows, in place of those that an earlier try of it left."""
        names = T.StructType.fromDDL(TABLES[table]).names
        rows.select(*names).write.mode("overwrite").parquet(f"{self._path(table)}/epoch={epoch}")

    def next_epoch(self) -> int:
        return max([0, *(e for t in TABLES for e in self.epochs(t))]) + 1

    def remember(self, writes: DataFrame, epoch: int | None = None) -> DataFrame:
        """Evidence, states and the projection of one batch of writes; returns the jobs done."""
        epoch = self.next_epoch() if epoch is None else epoch
        states = self.before(epoch, "states")
        evidence, new, jobs = ledger.recorded(writes, states, self.before(epoch, "evidence"))
        evidence, new = evidence.persist(), new.persist()
        try:
            self.write("evidence", evidence, epoch)
            self.write("states", new, epoch)
            self.project(new.select("project", "topic").distinct(), epoch)
            return self.spark.createDataFrame(jobs.collect(), jobs.schema)  # a batch's topics
        finally:
            evidence.unpersist()
            new.unpersist()

    def before(self, epoch: int, table: str) -> DataFrame:
        """A table as it was before an epoch, so that a second try of one starts where the first did."""
        if epoch not in self.epochs(table):
            return self.read(table)
        schema = T.StructType.fromDDL(TABLES[table])
        rows = self.spark.read.schema(T.StructType([*schema, T.StructField("epoch", T.LongType())])).parquet(self._path(table)).where(F.col("epoch") < epoch)
        return rows.groupBy(*KEYS[table]).agg(F.max_by(F.struct(*schema.names), "epoch").alias("r")).select("r.*")

    def cut(self, states: DataFrame) -> DataFrame:
        """Spans of current states, without vectors."""
        key = F.to_json(F.struct("project", "topic"))
        spans = span_frame(states.select(key.alias("topic_id"), F.col("topic").alias("name"), "content"), self.tokens)
        kind = T.StructType.fromDDL("project string, topic string")
        spans = spans.withColumn("k", F.from_json("topic_id", kind))
        return spans.select("k.project", "k.topic", "ordinal", "byte_start", "byte_end", "header", "text", "tokens", F.lit(self.encoding).alias("encoding"))

    def encoded(self, spans: DataFrame) -> DataFrame:
        vector = F.lit(None).cast("array<float>") if self.encoder is None else half_precision(self.encoder(F.concat_ws(": ", "header", "text")))
        return spans.withColumn("vector", vector)

    def project(self, topics: DataFrame, epoch: int) -> None:
        """Puts the spans of changed topics in the place of old ones: more are added, fewer leave tombstones, a retired topic leaves only those.

        Vectors are lent from old spans of a topic if all of them are as wanted.
        """
        old = self.before(epoch, "spans").where("alive").join(topics, ["project", "topic"], "left_semi")
        states = ledger.current(self.read("states")).join(topics, ["project", "topic"], "left_semi")
        new = lent(self.cut(states), old, self.encoded).withColumn("alive", F.lit(True))
        gone = old.join(new.select(*KEYS["spans"]), KEYS["spans"], "left_anti").withColumn("alive", F.lit(False))
        self.write("spans", new.unionByName(gone.select(*new.columns)), epoch)

    def reindex(self) -> int:
        """All current states cut anew as one epoch, vectors lent where they can be; the number of spans."""
        epoch = self.next_epoch()
        self.project(self.read("states").select("project", "topic").distinct(), epoch)
        return self.projection().count()

    def projection(self) -> DataFrame:
        return self.read("spans").where("alive").drop("alive")

    def holds(self, wanted: DataFrame) -> DataFrame:
        """Topics with `held`: whether the projection has exactly the wanted spans."""
        return matching(wanted, self.projection())

    def compact(self, table: str) -> None:
        """All rows as one epoch; then the older ones go. Readers see either, as newer epochs win."""
        old = self.epochs(table)
        if len(old) < 2:
            return
        self.write(table, self.read(table), old[-1] + 1)
        fs, path = self._fs()
        for e in old:
            fs.delete(path(f"{self._path(table)}/epoch={e}"), True)

    def purge(self, project: str) -> dict[str, int]:
        """Takes a project out of every table; how many rows each had."""
        counts = {}
        for table in TABLES:
            rows = self.read(table)
            counts[table] = rows.where(F.col("project") == project).count()
            old = self.epochs(table)
            if old:
                self.write(table, rows.where(~F.col("project").eqNullSafe(project)), old[-1] + 1)
                fs, path = self._fs()
                for e in old:
                    fs.delete(path(f"{self._path(table)}/epoch={e}"), True)
        return counts


def matching(wanted: DataFrame, stored: DataFrame) -> DataFrame:
    """project, topic, held: every wanted span is stored with the same header, text and encoding, and no other is."""
    key = ["project", "topic", "ordinal"]
    both = wanted.select(*key, "header", "text", "encoding", F.lit(True).alias("w")).join(stored.select(*key, *(F.col(c).alias(f"s_{c}") for c in ("header", "text", "encoding")), F.lit(True).alias("s")), key, "full")
    same = F.col("w").isNotNull() & F.col("s").isNotNull()
    for c in ("header", "text", "encoding"):
        same = same & F.col(c).eqNullSafe(F.col(f"s_{c}"))
    return both.groupBy("project", "topic").agg(F.bool_and(same).alias("held"))


def lent(wanted: DataFrame, stored: DataFrame, encoded) -> DataFrame:
    """The wanted spans with vectors: a topic's stored ones if all its spans match, else made anew."""
    good = matching(wanted, stored).where("held").select("project", "topic")
    key = ["project", "topic", "ordinal"]
    reused = wanted.join(good, ["project", "topic"], "left_semi").join(stored.select(*key, "vector"), key)
    fresh = encoded(wanted.join(good, ["project", "topic"], "left_anti"))
    return fresh.unionByName(reused.select(*fresh.columns))


def described(rows: DataFrame) -> str:
    """A table's schema as JSON, as outside tools ask for it."""
    return json.dumps(json.loads(rows.schema.json()), sort_keys=True)


class Session:
    """The verbs that a caller uses on one project: write, read, search by grep, topics, link and unlink go through frames of the store."""

    def __init__(self, store: Store, project: str):
        self.store, self.project = store, project

    def write(self, topic: str, content: str, seq: int, now, valid_from=None, valid_to=None) -> str:
        """Writes one memory; the verdict."""
        from .readers import single

        one = single(self.store.spark, self.project, topic, content, seq, now, valid_from, valid_to)
        states = ledger.of_project(self.store.read("states"), self.project)
        [verdict] = ledger.judged(one, ledger.current(states)).select("reason").collect()
        self.store.remember(one)
        return verdict["reason"]

    def read(self, topic: str, back: int = 0):
        """The state so many versions before the newest live one, clamped at the oldest; None for an unknown topic."""
        states = ledger.of_project(self.store.read("states"), self.project)
        asked = self.store.spark.createDataFrame([(self.project, topic, back)], "project string, topic string, back int")
        return ledger.version_back(states, asked).first()

    def grep(self, needle: str, folded: bool = True, limit: int = 20) -> DataFrame:
        return ledger.grep(ledger.of_project(self.store.read("evidence"), self.project), needle, folded, limit)

    def topics(self, limit: int = 20) -> DataFrame:
        now = ledger.current(ledger.of_project(self.store.read("states"), self.project))
        return now.orderBy(F.desc("recorded_at"), "topic").limit(limit).select("topic", "version", "recorded_at")

    def retire(self, topic: str, now: Column) -> None:
        states = self.store.read("states")
        one = self.store.spark.createDataFrame([(self.project, topic)], "project string, topic string")
        after, _ = ledger.retire(states.where((F.col("project") == self.project) & (F.col("topic") == topic)), one, now)
        epoch = self.store.next_epoch()
        self.store.write("states", after, epoch)
        self.store.project(one, epoch)
