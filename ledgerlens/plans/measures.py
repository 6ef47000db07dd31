"""Ledger, ingest and evaluation queries by operators over the tables; held against SQL of another formulation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import markdown, text
from ..operators import graph, ledger, statistics
from ..streaming import cascade


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as writes: a topic is a user, the content is the type with a tenth of its value."""
    content = F.concat_ws(" ", "event_type", F.floor(F.col("value") / 10).cast("bigint").cast("string"))
    at = F.col("ts").cast("timestamp")
    return table(spark, sf_dir, "events").select(F.lit("events").alias("project"), F.col("user_id").cast("string").alias("topic"), content.alias("content"), F.col("event_id").alias("seq"), at.alias("recorded_at"), at.alias("valid_from"), F.lit(None).cast("timestamp").alias("valid_to"))


def chain(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    none = lambda schema: spark.createDataFrame([], schema)
    evidence, states, _ = ledger.recorded(event_writes(spark, sf_dir), none(ledger.STATE), none(ledger.EVIDENCE))
    return evidence, states


def ledger_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    evidence, _ = chain(spark, sf_dir)
    return evidence.select(F.col("topic").cast("bigint").alias("topic"), "seq", F.col("evidence_version").cast("long").alias("evidence_version"), "content_hash", "reason")


def ledger_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, states = chain(spark, sf_dir)
    return states.select(F.col("topic").cast("bigint").alias("topic"), "seq", F.col("version").cast("long").alias("version"), F.col("supersedes").cast("long").alias("supersedes"), "content")


def job_claim_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 64 jobs that are due: only those are gathered."""
    priority = F.when(F.col("event_type") == "click", 10).when(F.col("event_type") == "view", 20).when(F.col("event_type") == "purchase", 50).otherwise(100)
    jobs = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("subject"), F.col("event_type").alias("kind")).agg(F.max("ts").alias("available_at"), F.min(priority).alias("priority"), (F.max("event_id") % 10).alias("attempts"))
    order = ["priority", "available_at", "subject", "kind"]
    first = jobs.where(F.col("attempts") < cascade.MOST_ATTEMPTS).orderBy(*order).limit(cascade.BATCH)
    rows = F.sort_array(F.collect_list(F.struct(*order, "attempts")))
    numbered = first.agg(rows.alias("r")).select(F.posexplode("r").alias("n", "r"))
    return numbered.select("r.subject", "r.kind", F.col("r.priority").cast("long").alias("priority"), (F.col("r.attempts") + 1).alias("attempts"), (F.col("n") + 1).cast("long").alias("claim"))


def edges_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shipments as claims: the newest of each edge is live, closed or deleted by its supplier, older ones are superseded; read at the middle of time."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("src"), (-F.col("l_suppkey")).alias("dst"), F.col("l_shipdate").cast("timestamp").alias("created_at"), "l_orderkey", "l_linenumber", F.round(F.col("l_quantity") / 50, 2).alias("confidence"))
    middle = lines.agg(F.min("created_at").alias("a"), F.max("created_at").alias("b")).first()
    at = middle["a"] + (middle["b"] - middle["a"]) / 2
    from pyspark.sql import Window

    own = Window.partitionBy("src", "dst").orderBy("created_at", "l_orderkey", "l_linenumber")
    changed = lines.withColumn("before", F.lag("confidence").over(own)).where(~F.col("before").eqNullSafe(F.col("confidence")))
    rows = changed.withColumns({"version": F.row_number().over(own), "next": F.lead("created_at").over(own)})
    last = F.when(F.col("dst") % 7 == 0, "closed").when(F.col("dst") % 11 == 0, "deleted")
    tombstone = F.when(F.col("next").isNotNull(), "superseded").otherwise(last)
    rows = rows.withColumn("tombstone", tombstone)
    ended = F.when(F.col("tombstone").isNotNull(), F.coalesce("next", F.col("created_at") + F.expr("INTERVAL 90 DAYS")))
    # valid from its shipment, and for a year
    rows = rows.withColumns({"invalidated_at": ended, "valid_from": F.col("created_at"), "valid_to": F.col("created_at") + F.expr("INTERVAL 365 DAYS")})
    return graph.as_of(rows, F.lit(at)).select("src", "dst", F.col("version").cast("long").alias("version"), "confidence")


def shingle_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of one conversation by three-word shingles, fewer words being one: all pairs that share any. A conversation's turns are few."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    one, two = turns.select("conv_id", F.col("turn").alias("x"), F.col("text").alias("a")), turns.select("conv_id", F.col("turn").alias("y"), F.col("text").alias("b"))
    rows = one.join(two, "conv_id").where("x < y").select("conv_id", "x", "y", F.round(text.jaccard(F.coalesce("a", F.lit("")), F.coalesce("b", F.lit(""))), 6).alias("jaccard"))
    return rows.where("jaccard > 0")


def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.stratified(table(spark, sf_dir, "documents").select("doc_id", "lang"), 200, "lang", "doc_id").select("doc_id", "lang")


def cooccurrence_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers that ordered the same parts, by the rarity of the part."""
    orders, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    held = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("topic"), F.col("l_partkey").alias("name"))
    return statistics.cooccurrence(held, table(spark, sf_dir, "customer").count())


def span_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document packed into spans of at most 200 tokens."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("topic_id"), F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("name"), F.col("text").alias("content"))
    return markdown.span_frame(docs).withColumnRenamed("topic_id", "doc_id")


def page_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as Markdown, h1 as headings, cut into sections with names and parents."""
    body = F.regexp_replace(F.col("html"), r"(?is)<h1[^>]*>(.*?)</h1>", "\n\n# $1\n\n")
    body = F.regexp_replace(F.regexp_replace(body, r"(?is)</(p|li)>", "\n\n"), r"<[^>]*>", "")
    files = table(spark, sf_dir, "pages").select(F.concat(F.lit("page"), F.col("page_id").cast("string")).alias("path"), body.alias("text"))
    return markdown.section_frame(files)


def vector_recall_half(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of each query's exact ten nearest is found after storage in 16 bits."""
    from ..operators import recall

    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    asked = vectors.where("vec_id % 50 = 0")
    exact = recall.nearest(vectors, asked, 10)
    stored = recall.nearest(vectors.withColumn("embedding", text.half_precision("embedding")), asked, 20)
    hit = exact.join(stored.select("query_id", "vec_id").withColumn("hit", F.lit(1)), ["query_id", "vec_id"], "left")
    return hit.groupBy("query_id").agg(F.avg(F.coalesce("hit", F.lit(0))).alias("recall"))


def smallest_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n"))
    floor = F.greatest(F.lit(2.0) * F.pow(F.lit(0.5), F.least("n", F.lit(1000))), F.lit(1 / (statistics.DRAWS + 1)))
    return rows.select("user_id", "n", F.round(floor, 12).alias("smallest_p"), (floor < 0.05).alias("can_decide"))


def macro_contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each nation's part of the mean over segments of mean balances: a cluster's scores scaled by K / (C n)."""
    rows = table(spark, sf_dir, "customer")
    sizes = rows.groupBy("c_mktsegment").agg(F.count("*").alias("n"))
    many, groups = rows.select("c_nationkey").distinct().count(), sizes.count()
    part = F.col("c_acctbal") * F.lit(float(many)) / (F.lit(float(groups)) * F.col("n"))
    return rows.join(F.broadcast(sizes), "c_mktsegment").groupBy("c_nationkey").agg(F.round(F.sum(part), 4).alias("part"))


QUERIES = {
    f.__name__: f
    for f in (
        ledger_evidence, ledger_states, job_claim_order, edges_asof, shingle_jaccard, stratified_sample, cooccurrence_edges, span_packing, page_sections,
        vector_recall_half, smallest_p, macro_contributions,
    )
}

_CHAIN = """
w AS (SELECT user_id AS topic, event_id AS seq, trim(regexp_replace(event_type || ' ' || CAST(CAST(floor(value / 10) AS BIGINT) AS VARCHAR), '\\s+', ' ', 'g')) AS content FROM events),
good AS (SELECT topic, seq, content, lag(content) OVER (PARTITION BY topic ORDER BY seq) AS before FROM w WHERE length(content) >= 8),
said AS (SELECT w.topic, w.seq, w.content, CASE WHEN w.content = '' THEN 'empty' WHEN length(w.content) < 8 THEN 'too_short' WHEN g.before = w.content THEN 'restatement' ELSE 'promoted' END AS reason FROM w LEFT JOIN good g ON g.topic = w.topic AND g.seq = w.seq)"""

ORACLES = {
    "ledger_evidence": f"WITH {_CHAIN} SELECT topic, seq, (SELECT count(*) FROM w x WHERE x.topic = said.topic AND x.seq <= said.seq) AS evidence_version, sha256(content) AS content_hash, reason FROM said",
    "ledger_states": f"WITH {_CHAIN}, p AS (SELECT * FROM said WHERE reason = 'promoted') SELECT topic, seq, row_number() OVER w AS version, nullif(row_number() OVER w - 1, 0) AS supersedes, content FROM p WINDOW w AS (PARTITION BY topic ORDER BY seq)",
    "edges_asof": """WITH claims AS (SELECT l_partkey AS src, -l_suppkey AS dst, l_shipdate AS made, l_orderkey AS o, l_linenumber AS i, round(l_quantity / 50, 2) AS confidence FROM lineitem),
told AS (SELECT *, lag(confidence) OVER (PARTITION BY src, dst ORDER BY made, o, i) AS before FROM claims),
kept AS (SELECT *, row_number() OVER (PARTITION BY src, dst ORDER BY made, o, i) AS version, lead(made) OVER (PARTITION BY src, dst ORDER BY made, o, i) AS after FROM told WHERE before IS DISTINCT FROM confidence),
moment AS (SELECT min(made) + (max(made) - min(made)) / 2 AS t FROM claims)
SELECT src, dst, version, confidence FROM kept, moment WHERE after IS NULL AND made <= t AND t < made + INTERVAL 365 DAY AND (dst % 7 = 0 AND t < made + INTERVAL 90 DAY OR dst % 7 <> 0 AND dst % 11 <> 0)""",
    "shingle_jaccard": r"""WITH t AS (SELECT conv_id, turn, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS w FROM conversations),
s AS (SELECT conv_id, turn, list_distinct(CASE WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda k: w[k] || ' ' || w[k + 1] || ' ' || w[k + 2]) END) AS h FROM t)
SELECT a.conv_id, a.turn AS x, b.turn AS y, round(CAST(len(list_intersect(a.h, b.h)) AS DOUBLE) / len(list_distinct(list_concat(a.h, b.h))), 6) AS jaccard FROM s a JOIN s b ON b.conv_id = a.conv_id AND a.turn < b.turn WHERE len(list_intersect(a.h, b.h)) > 0""",
    "stratified_sample": """WITH sizes AS (SELECT lang, count(*) AS size FROM documents GROUP BY lang),
steps AS (SELECT lang, size, unnest(range(1, size + 1)) AS nth FROM sizes),
dealt AS (SELECT lang, nth FROM steps ORDER BY CAST(size AS DOUBLE) / nth DESC, sha256('7:' || lang) LIMIT 200),
members AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY sha256('7:' || CAST(doc_id AS VARCHAR)), doc_id) AS nth FROM documents)
SELECT m.doc_id, m.lang FROM members m JOIN dealt d ON d.lang = m.lang AND d.nth = m.nth""",
    "cooccurrence_edges": """WITH total AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM customer),
held AS (SELECT DISTINCT o_custkey AS topic, l_partkey AS name FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
rare AS (SELECT name, count(*) AS f FROM held GROUP BY name HAVING count(*) BETWEEN 2 AND greatest(CAST(floor(0.01 * (SELECT n FROM total)) AS BIGINT), 2)),
w AS (SELECT x.topic AS a, y.topic AS b, round(sum(ln((SELECT n FROM total) / r.f)), 6) AS weight FROM held x JOIN held y ON y.name = x.name AND x.topic < y.topic JOIN rare r ON r.name = x.name GROUP BY 1, 2),
ends AS (SELECT *, a AS topic, b AS other FROM w UNION ALL SELECT *, b, a FROM w),
kept AS (SELECT DISTINCT a, b, weight FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY weight DESC, other) AS n FROM ends) WHERE n <= 10)
SELECT a, b, weight, round(least(greatest(weight / (SELECT ln(n) FROM total), 0.05), 1), 6) AS confidence FROM kept""",
    "smallest_p": "SELECT user_id, count(*) AS n, round(greatest(2 * power(0.5::DOUBLE, count(*)), 1.0::DOUBLE / 10001), 12) AS smallest_p, greatest(2 * power(0.5::DOUBLE, count(*)), 1.0::DOUBLE / 10001) < 0.05 AS can_decide FROM events GROUP BY user_id",
    "macro_contributions": "SELECT c_nationkey, round(sum(c_acctbal * k / (c * n)), 4) AS part FROM (SELECT *, count(*) OVER (PARTITION BY c_mktsegment) AS n, CAST((SELECT count(DISTINCT c_nationkey) FROM customer) AS DOUBLE) AS k, (SELECT count(DISTINCT c_mktsegment) FROM customer) AS c FROM customer) GROUP BY c_nationkey",
}
