"""Versioned relationships: assertion, retraction, reading as of a moment, mentions, and the bounded walk.

Edge versions are rows (src, dst, kind, derivation, confidence, valid_from, valid_to, created_at, invalidated_at,
tombstone, version). A version is live while `invalidated_at` is null; a tombstone says why it ended: `superseded`,
`closed` (what it said held until then) or `deleted` (it never held). Writes return frames to append or to put in the
place of live ones; nothing is changed in place.

The walk takes all questions of a batch together, over blocks of edges (`blocks`). Only frontiers are written; a
frontier holds at most `FRONTIER` steps a question, the most confident first, so a hub can't make it grow with the graph.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.materialise import written
from . import blocks
from .recall import Numbers, split, texts_of

DEPTH, MOST_DEPTH, FRONTIER, KEEP = 2, 4, 2000, 50
DECAY = 0.5
MENTION, PARENT, EXPLICIT = 0.5, 0.5, 1.0
KEY = ["src", "dst", "kind"]
CLAIM = ["derivation", "confidence", "valid_from", "valid_to"]
VERSION = "src long, dst long, kind string, derivation string, confidence double, valid_from timestamp, valid_to timestamp, created_at timestamp, invalidated_at timestamp, tombstone string, version int"
NAME_BITS = 1 << 26
#: A run's hash: those of its words, each times the factor more, in the bits of the mask.
RUN_FACTOR, RUN_MASK = 40503, (1 << 40) - 1
#: Lists into which the documents that have a name are dealt, and its topics.
SIDES = 32


def checked(claims: DataFrame) -> DataFrame:
    """The claims, of which none may end before it begins."""
    wrong = F.col("valid_from").isNotNull() & F.col("valid_to").isNotNull() & (F.col("valid_to") <= F.col("valid_from"))
    return claims.where(F.when(wrong, F.raise_error(F.lit("an interval ends at or before its beginning")).cast("boolean")).otherwise(F.lit(True)))


def live(versions: DataFrame) -> DataFrame:
    return versions.where("invalidated_at IS NULL")


def valid_at(at: Column) -> Column:
    """Half-open, a null bound is open."""
    return (F.col("valid_from").isNull() | (F.col("valid_from") <= at)) & (F.col("valid_to").isNull() | (at < F.col("valid_to")))


def as_of(versions: DataFrame, at: Column) -> DataFrame:
    """What held at a moment: valid then, and live or closed later; superseded and deleted versions never held."""
    return versions.where(valid_at(at) & (F.col("invalidated_at").isNull() | ((F.col("tombstone") == "closed") & (at < F.col("invalidated_at")))))


def of_kinds(edges: DataFrame, kinds: list[str] | None) -> DataFrame:
    """Edges of the given kinds; null asks for all."""
    return edges if kinds is None else edges.where(F.col("kind").isin(kinds))


def assert_edges(versions: DataFrame, claims: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """Superseded versions, and versions to append. A claim equal to its live version changes nothing.

    Of several claims of one edge in a batch the one of the highest `seq` counts.
    """
    last = checked(claims).groupBy(*KEY).agg(F.max_by(F.struct(*CLAIM), "seq").alias("c")).select(*KEY, *(F.col(f"c.{x}").alias(f"new_{x}") for x in CLAIM))
    held = last.join(live(versions), KEY, "left")
    same = F.col("created_at").isNotNull()
    for x in CLAIM:
        same = same & F.col(f"new_{x}").eqNullSafe(F.col(x))
    changed = held.where(~same)
    closed = changed.where(F.col("created_at").isNotNull()).select(*KEY, *CLAIM, "created_at", now.alias("invalidated_at"), F.lit("superseded").alias("tombstone"), "version")
    numbers = versions.groupBy(*KEY).agg(F.max("version").alias("newest"))
    new = changed.select(*KEY, *(F.col(f"new_{x}").alias(x) for x in CLAIM)).join(numbers, KEY, "left")
    none = F.lit(None)
    new = new.select(*KEY, *CLAIM, now.alias("created_at"), none.cast("timestamp").alias("invalidated_at"), none.cast("string").alias("tombstone"), (F.coalesce("newest", F.lit(0)) + 1).alias("version"))
    return closed, new


def retract_derived(versions: DataFrame, kind: str, origins: DataFrame, keep: DataFrame, now: Column) -> DataFrame:
    """Live deterministic edges of the given origins (src) that are not among keep (src, dst): closed."""
    mine = live(versions).where((F.col("kind") == kind) & (F.col("derivation") == "deterministic")).join(origins.select("src").distinct(), "src", "left_semi")
    gone = mine.join(keep.select("src", "dst").distinct(), ["src", "dst"], "left_anti")
    return gone.select(*versions.columns).withColumns({"invalidated_at": now, "tombstone": F.lit("closed")})


def close_edges(versions: DataFrame, named: DataFrame, reason: str, now: Column) -> DataFrame:
    """The live versions of named edges (src, dst, kind), ended as `closed` or `deleted`."""
    if reason not in ("closed", "deleted"):
        raise ValueError("an edge is closed or deleted")
    return live(versions).join(named.select(*KEY).distinct(), KEY, "left_semi").select(*versions.columns).withColumns({"invalidated_at": now, "tombstone": F.lit(reason)})


def applied(versions: DataFrame, ended: DataFrame, new: DataFrame | None = None) -> DataFrame:
    """All versions after a write: ended ones in place of those they were."""
    key = [*KEY, "version"]
    out = versions.join(ended.select(*key), key, "left_anti").unionByName(ended.select(*versions.columns))
    return out if new is None else out.unionByName(new.select(*versions.columns))


def history(versions: DataFrame, src: int, dst: int, kind: str) -> DataFrame:
    return versions.where((F.col("src") == src) & (F.col("dst") == dst) & (F.col("kind") == kind)).orderBy("version")


def targets(versions: DataFrame, origins: DataFrame, kind: str) -> DataFrame:
    """(src, dst) of live edges of a kind from the given origins."""
    return live(versions).where(F.col("kind") == kind).join(origins.select("src").distinct(), "src", "left_semi").select("src", "dst")


def link(versions: DataFrame, src: int, dst: int, kind: str, now: Column) -> tuple[DataFrame, DataFrame]:
    """An explicit edge of confidence 1; linking again changes nothing."""
    one = versions.sparkSession.createDataFrame([(src, dst, kind, "explicit", EXPLICIT, None, None, 0)], "src long, dst long, kind string, derivation string, confidence double, valid_from timestamp, valid_to timestamp, seq long")
    return assert_edges(versions, one, now)


# --- the walk


def ends(edges: DataFrame) -> DataFrame:
    """Each edge from both its ends: a, b, and whether it points from a to b."""
    side = lambda a, b, out: F.struct(F.col(a).alias("a"), F.col(b).alias("b"), F.lit(out).alias("outbound"))
    both = edges.select("kind", "confidence", F.explode(F.array(side("src", "dst", True), side("dst", "src", False))).alias("e"))
    return both.select("e.a", "e.b", "kind", "confidence", "e.outbound")


def walk(edges: DataFrame, seeds: DataFrame, depth: int = DEPTH, keep: int | None = None, frontier: int = FRONTIER, crowd: bool = False, most: int | None = None) -> DataFrame:
    """query, topic, origin, via, hops, kind, confidence, outbound of what each query's seeds (query, topic, place) reach over live edges.

    The first hop to arrive wins, in it the more confident crossing, then the earlier one. Walks of two seeds are two
    walks, each barred from its own start. A query that has reached `keep` topics goes no further. crowd: with how many topics
    the query reached through the same one. most: only rows that can be among so many of a query by rounded strength, then id.
    """
    if not 0 <= depth <= MOST_DEPTH:
        raise ValueError(f"a walk has at most {MOST_DEPTH} hops")
    if not depth:
        return seeds.sparkSession.createDataFrame([], blocks.REACHED + ", crowd long" * crowd)
    packed = blocks.pack(ends(edges))
    steps = written(seeds.select("query", F.lit(1).alias("hop"), F.col("topic").alias("origin"), F.col("place").cast("long").alias("pos"), "topic", F.lit(0).cast("long").alias("crowd")))
    for hop in range(1, depth):
        met = blocks.frontiers(packed, steps, hop, frontier)
        # frontier: the most confident first, otherwise in the order met
        line = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("confidence"), "pos", "topic", "kind", "asserted")).cast("long")
        new = met.where("topic IS NOT NULL").withColumn("line", line).where(F.col("line") <= frontier)
        if keep is not None:
            enough = met.where("topic IS NULL").groupBy("query").agg(F.sum("pos").alias("c")).where(F.col("c") >= keep).select("query")
            new = new.join(enough, "query", "left_anti")
        new = written(new.select("query", F.lit(hop + 1).alias("hop"), "origin", F.col("line").alias("pos"), "topic", F.lit(0).cast("long").alias("crowd")))
        steps = steps.unionByName(new)
    if crowd:
        many = blocks.results(packed, steps, DECAY).groupBy("query", F.col("via").alias("topic")).agg(F.count("*").alias("n"))
        steps = written(steps.join(many, ["query", "topic"], "left").select("query", "hop", "origin", "pos", "topic", F.coalesce("n", F.lit(0)).cast("long").alias("crowd")))
    return blocks.results(packed, steps, DECAY, crowd, most)


def walk_order(reached: DataFrame) -> DataFrame:
    """Places of what a query reached: fewer hops, then more confidence, then the smaller id."""
    return reached.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy("hops", F.desc("confidence"), "topic")))


def strength() -> Column:
    return F.col("confidence") * F.pow(F.lit(DECAY), F.col("hops") - 1)


def graph_channel(edges: DataFrame, seeds: DataFrame, depth: int = DEPTH, keep: int = KEEP) -> DataFrame:
    """item_id, channel, doc_id, score, place and via: the walk's worth, a path's strength times the relevance of the seed that it began at."""
    return _ranked(walk(edges, seeds, depth, keep), seeds, keep)


def _ranked(reached: DataFrame, seeds: DataFrame, keep: int) -> DataFrame:
    reached = reached.join(seeds.select("query", F.col("topic").alias("origin"), "relevance"), ["query", "origin"])
    worth = reached.withColumn("score", F.round(strength() * F.col("relevance"), 6))
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "topic"))
    return worth.withColumn("place", place).where(F.col("place") <= keep).select(F.col("query").alias("item_id"), F.lit("graph").alias("channel"), F.col("topic").alias("doc_id"), "score", "place", "via", "origin", "hops", "outbound")


# --- mentions


def first_words(docs: DataFrame, width: int) -> DataFrame:
    """topic, name: the first words of each document, for documents that have so many."""
    word, other = r"([\p{L}\p{N}_]++)", r"[^\p{L}\p{N}_]++"
    found = [F.regexp_extract("t", f"^[^\\p{{L}}\\p{{N}}_]*+{other.join([word] * width)}", k + 1) for k in range(width)]
    rows = docs.select(F.col("doc_id").alias("topic"), F.lower("text").alias("t")).select("topic", *(f.alias(f"w{k}") for k, f in enumerate(found)))
    return rows.where("w0 <> ''").select("topic", F.concat_ws(" ", *(f"w{k}" for k in range(width))).alias("name"))


def _probes(name: Column) -> Column:
    """Two bits for a name of words: where a hash over the hashes of its words falls in a table of `NAME_BITS`."""
    words = F.transform(F.split(name, " "), lambda w: F.crc32(F.encode(w, "utf-8")))
    h = F.aggregate(words, F.lit(0).cast("long"), lambda s, c: (s * F.lit(RUN_FACTOR) + c).bitwiseAND(F.lit(RUN_MASK)))
    return F.array(h.bitwiseAND(F.lit(NAME_BITS - 1)), F.shiftright(h, 14))


def name_runs(docs: DataFrame, names: DataFrame, widest: int) -> DataFrame:
    """src, run, n: how often a document has each run of up to `widest` words that may be a name.

    A table of a fixed number of bits lets through the runs that may be names; a few of them are none, and meet none.
    """
    # a row below nought for each width, so that one pass over the names says both
    at = names.select(F.explode(F.concat(_probes(F.col("name")), F.array(-F.size(F.split("name", " ")).cast("long")))).alias("at"))
    bit = F.when(F.col("at") < 0, F.lit(0).cast("long")).otherwise(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("at").bitwiseAND(F.lit(31)).cast("int")))
    found = at.groupBy(F.when(F.col("at") < 0, F.col("at")).otherwise(F.shiftright("at", 5)).alias("word")).agg(F.bit_or(bit).alias("bits")).toArrow()
    word, bits = found.column("word").to_numpy(), found.column("bits").to_numpy()
    widths = sorted(int(-w) for w in word[word < 0] if -w <= widest)
    table = np.zeros(NAME_BITS // 32, np.uint32)
    table[word[word >= 0]] = bits[word >= 0].astype(np.uint32)
    held = docs.sparkSession.sparkContext.broadcast(table)

    def runs(batches):
        own, number = held.value, Numbers(lambda w: zlib.crc32(w.encode()))
        has = lambda at: (own[at >> 5] >> (at & 31).astype(np.uint32) & 1).astype(bool)
        for ids, texts in texts_of(batches):
            found = [split(t) for t in texts]
            many = np.array([len(w) for w in found], np.int64)
            flat = [w for ws in found for w in ws]
            crc = np.fromiter(map(number.fresh().__getitem__, flat), np.int64, len(flat))
            left = np.repeat(np.cumsum(many), many) - np.arange(len(flat))  # words up to the end of the text, this one included
            row = np.repeat(np.arange(len(texts)), many)
            src, run = [], []
            for width in widths:
                h = np.zeros(max(len(flat) - width + 1, 0), np.int64)
                for k in range(width):
                    h = (h * RUN_FACTOR + crc[k : len(h) + k]) & RUN_MASK
                at = np.flatnonzero((left[: len(h)] >= width) & has(h & (NAME_BITS - 1)) & has(h >> 14))
                src.append(ids[row[at]])
                run += [" ".join(w.decode("latin-1") if isinstance(w, bytes) else w for w in flat[k : k + width]) for k in at.tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([*src, np.empty(0, np.int64)])), pa.array(run, pa.string())], ["src", "run"])

    return docs.select("doc_id", "text").mapInArrow(runs, "src long, run string").groupBy("src", "run").agg(F.count("*").alias("n"))


def mentions(docs: DataFrame, names: DataFrame, widest: int) -> DataFrame:
    """src, dst, n: how often a document's runs of up to `widest` words are another's name.

    A name that many documents have and many share makes as many rows as those numbers multiply to. Its documents and its topics
    are dealt into `SIDES` lists each, every two of which meet in a task of their own, so no row is shuffled; only topics of
    several names are summed up.
    """
    named = names.groupBy("name", "topic").agg(F.count("*").alias("m"))
    several = named.groupBy("topic").agg(F.count("*").alias("c")).where("c > 1").select("topic")
    rows = written(name_runs(docs, names, widest))
    side = lambda c: F.pmod(F.xxhash64(c), F.lit(SIDES))
    sources = rows.groupBy("run", side("src").alias("i")).agg(F.collect_list(F.struct("src", "n")).alias("s"))
    topics = named.join(several, "topic", "left_anti").groupBy(F.col("name").alias("run"), side("topic").alias("j")).agg(F.collect_list(F.struct("topic", "m")).alias("t"))
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 4 * docs.sparkSession.sparkContext.defaultParallelism)
    met = sources.join(topics, "run").select("s", "t").repartition(parts)
    alone = met.select(F.explode("s").alias("s"), "t").select("s", F.explode("t").alias("t")).where("s.src <> t.topic").select("s.src", F.col("t.topic").alias("dst"), (F.col("s.n") * F.col("t.m")).alias("n"))
    rest = rows.join(named.join(several, "topic", "left_semi"), rows["run"] == named["name"]).where(F.col("src") != F.col("topic"))
    return alone.unionByName(rest.groupBy("src", F.col("topic").alias("dst")).agg(F.sum(F.col("n") * F.col("m")).alias("n")))


def mention_channel(runs: DataFrame, names: DataFrame, seeds: DataFrame, keep: int = KEEP, frontier: int = FRONTIER) -> DataFrame:
    """The rows of `graph_channel` over edges of mentions at a depth of two hops, from the names themselves: no edge is made that isn't crossed.

    runs (src, run): which document has which name. Seeds (query, topic, place, relevance) of a query must not gain relevance with
    their place. All crossings of one step weigh the same, so what it finds is ranked by id alone, and of the topics of a name,
    or of the documents that have it, the 2 * keep + 2 smallest can do: a query has fewer than `keep` finds before its last
    hop, so at least `keep` of those are new, and no later one ranks above them. Lists have that bound; names may be any number's.
    """
    held, said = runs.select("src", F.col("run").alias("name")).distinct(), names.select("name", "topic").distinct()

    def smallest(rows: DataFrame, member: str) -> DataFrame:
        place = F.row_number().over(Window.partitionBy("name").orderBy(member))
        return rows.withColumn("k", place).where(F.col("k") <= 2 * keep + 2).select("name", F.col(member).alias("b"))

    lists = smallest(said, "topic").withColumn("outbound", F.lit(True)).unionByName(smallest(held.join(said.select("name").distinct(), "name", "left_semi"), "src").withColumn("outbound", F.lit(False)))
    lists = written(lists)
    asserted = F.when(F.col("outbound"), F.col("topic")).otherwise(F.col("b"))

    def crossed(steps: DataFrame) -> DataFrame:
        """query, origin, via, b, pos, outbound: the first step of each origin that crosses to b."""
        out = steps.join(held.withColumnRenamed("src", "topic"), "topic").withColumn("outbound", F.lit(True))
        back = steps.join(said, "topic").withColumn("outbound", F.lit(False))
        met = out.unionByName(back).join(lists, ["name", "outbound"]).where("b <> topic")
        best = met.groupBy("query", "origin", "b").agg(F.min(F.struct(F.col("pos"), asserted.alias("asserted"), F.col("topic").alias("via"), F.col("outbound"))).alias("m"))
        return best.select("query", "origin", "b", "m.pos", "m.via", "m.outbound", "m.asserted")

    def arrived(rows: DataFrame, hop: int) -> DataFrame:
        best = rows.groupBy("query", "b").agg(F.min(F.struct("pos", "asserted", "origin", "via", "outbound")).alias("m"))
        return best.select("query", F.col("b").alias("topic"), "m.origin", "m.via", F.lit(hop).alias("hops"), F.lit(MENTION).alias("confidence"), "m.outbound")

    first = written(crossed(seeds.select("query", F.col("topic").alias("origin"), "topic", F.col("place").cast("long").alias("pos"))))
    near = written(arrived(first, 1))
    enough = near.groupBy("query").agg(F.count("*").alias("c")).where(F.col("c") >= keep).select("query")
    line = F.row_number().over(Window.partitionBy("query").orderBy("pos", "b", "asserted")).cast("long")
    steps = first.join(enough, "query", "left_anti").withColumn("line", line).where(F.col("line") <= frontier).select("query", "origin", F.col("b").alias("topic"), F.col("line").alias("pos"))
    second = crossed(steps).where("b <> origin").join(near.select("query", F.col("topic").alias("b")), ["query", "b"], "left_anti")
    return _ranked(near.unionByName(arrived(second, 2)), seeds, keep)


def mention_claims(found: DataFrame) -> DataFrame:
    """What mentions say as claims of edges."""
    return found.select("src", "dst", F.lit("mentions").alias("kind"), F.lit("deterministic").alias("derivation"), F.lit(MENTION).alias("confidence"), *(F.lit(None).cast("timestamp").alias(c) for c in ("valid_from", "valid_to")), F.lit(0).cast("long").alias("seq"))


def restate_mentions(versions: DataFrame, changed: DataFrame, names: DataFrame, widest: int, now: Column) -> DataFrame:
    """All versions after the mentions of changed documents (doc_id, text) are stated anew."""
    found = written(mentions(changed, names, widest))
    ended = retract_derived(versions, "mentions", changed.select(F.col("doc_id").alias("src")), found, now)
    closed, new = assert_edges(versions, mention_claims(found), now)
    return applied(versions, ended.unionByName(closed.select(*ended.columns)), new)
