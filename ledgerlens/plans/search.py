"""Search over documents for all benchmark questions at once, from the operators; held against SQL of another formulation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.materialise import written
from ..operators import fusion, graph, recall


def tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    return read("documents").select("doc_id", "text"), read("benchmark").select("item_id", "text")


def linked(docs: DataFrame, items: DataFrame, width: int = 2) -> DataFrame:
    """Documents that a question names by their first words."""
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}_]+"), 0)
    runs = items.select("item_id", words.alias("w")).where(F.size("w") >= width)
    runs = runs.select("item_id", F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - width + 1), lambda k: F.array_join(F.slice("w", k, width), " "))).alias("name")).distinct()
    return runs.join(graph.first_words(docs, width), "name").select("item_id", F.col("topic").alias("doc_id")).distinct()


def mention_edges(docs: DataFrame, width: int = 3) -> DataFrame:
    """Live edges of mentions; names are the first words of documents."""
    found = graph.mentions(docs, graph.first_words(docs, width), width)
    return found.select("src", "dst", F.lit("mentions").alias("kind"), F.lit(graph.MENTION).alias("confidence"))


def index_lists(docs: DataFrame, items: DataFrame) -> DataFrame:
    return recall.channel_lists(docs, items, ("segmented", "ngram", "vector"))


def four_lists(docs: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The lists of all channels, and the seeds of the graph channel."""
    three = index_lists(docs, items)
    seeds = written(fusion.seeds(three, named=linked(docs, items)))
    names = graph.first_words(docs, 3)
    found = graph.mention_channel(written(graph.name_runs(docs, names, 3)), names, seeds)
    nothing = {c: F.lit(None).cast(k) for c, k in (("via", "long"), ("origin", "long"), ("hops", "int"), ("outbound", "boolean"))}
    return written(three.withColumns(nothing).unionByName(found)), seeds


def searched(spark: SparkSession, sf_dir: str, banded: bool = True) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    docs, items = tables(spark, sf_dir)
    lists, _ = four_lists(docs, items)
    return docs, items, fusion.shares(lists, banded=banded), lists


def long_place(df: DataFrame) -> DataFrame:
    return df.withColumn("place", F.col("place").cast("long"))


def one_channel(name: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return long_place(recall.channel_lists(*tables(spark, sf_dir), (name,)).drop("channel"))

    return run


def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return recall.nearest(vectors, vectors.where("vec_id % 50 = 0"))


def fused_rows(banded: bool):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        *_, parts, _ = searched(spark, sf_dir, banded)
        return fusion.fused(parts).select("item_id", "doc_id", F.round("score", 6).alias("score"), "channels")

    return run


def search_fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    *_, parts, _ = searched(spark, sf_dir)
    return long_place(fusion.fused(parts).where("place <= 10").select("item_id", "doc_id", F.round("score", 6).alias("score"), "place"))


def search_reranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items, parts, lists = searched(spark, sf_dir)
    rows = fusion.reranked(written(fusion.fused(parts)), lists, docs, items)
    return rows.where("place <= 10").select("item_id", "doc_id", F.col("fused_place").cast("long").alias("fused_place"), "blend", F.col("place").cast("long").alias("place"))


def why_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    *_, parts, _ = searched(spark, sf_dir)
    why = F.transform(F.filter("why", lambda w: w["kind"] == "channel"), lambda w: w["channel"])
    rows = fusion.why(parts).select("item_id", "doc_id", F.array_join(why, " ").alias("channels"))
    sums = parts.groupBy("item_id", "doc_id").agg(F.min("place").cast("long").alias("best_place"), F.max("via").alias("via"), F.round(F.sum("part"), 6).alias("score"))
    return rows.join(sums, ["item_id", "doc_id"])


def channel_leave_one_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    *_, parts, _ = searched(spark, sf_dir)
    dropped = parts.select("*", F.explode(F.array(*map(F.lit, fusion.CHANNELS))).alias("dropped")).where("channel <> dropped")
    return dropped.groupBy("item_id", "dropped", "doc_id").agg(F.round(F.sum("part"), 6).alias("score"))


def seed_interleave(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = tables(spark, sf_dir)
    rows = fusion.seeds(index_lists(docs, items), named=linked(docs, items))
    return rows.select(F.col("query").alias("item_id"), F.col("topic").alias("doc_id"), F.round("relevance", 6).alias("relevance"), F.col("place").cast("long").alias("seed"))


def graph_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists, _ = four_lists(*tables(spark, sf_dir))
    return long_place(lists.where("channel = 'graph'").select("item_id", "doc_id", "via", "score", "place"))


def judged(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Fused lists, relevance judgements (documents that hold the question whole), and the questions."""
    docs, items, parts, _ = searched(spark, sf_dir)
    return fusion.fused(parts), recall.holding(docs, items), items


def ndcg10(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked, qrels, items = judged(spark, sf_dir)
    gained = ranked.where("place <= 10").join(qrels, ["item_id", "doc_id"]).groupBy("item_id").agg(F.sum(1 / F.log2(F.col("place") + 1)).alias("dcg"))
    ideal = qrels.groupBy("item_id").agg(F.least(F.count("*"), F.lit(10)).alias("n"))
    ideal = ideal.select("item_id", F.aggregate(F.sequence(F.lit(1), F.col("n").cast("int")), F.lit(0.0), lambda s, k: s + 1 / F.log2(k + 1)).alias("best"))
    rows = items.select("item_id").join(gained, "item_id", "left").join(ideal, "item_id", "left")
    return rows.select("item_id", F.round(F.coalesce(F.col("dcg") / F.col("best"), F.lit(0.0)), 6).alias("ndcg"))


def recall50(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked, qrels, _ = judged(spark, sf_dir)
    rows = qrels.join(ranked, ["item_id", "doc_id"], "left")
    return rows.groupBy("item_id").agg(F.count("*").alias("judged"), F.count_if(F.col("place") <= 50).alias("found"), F.count_if(F.col("place").between(11, 50)).alias("deep"))


def recall_any_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked, qrels, _ = judged(spark, sf_dir)
    rows = qrels.join(ranked, ["item_id", "doc_id"], "left").withColumn("hit", F.coalesce((F.col("place") <= 5).cast("int"), F.lit(0)))
    each = rows.groupBy("item_id").agg(F.max("hit").alias("any5"), F.min("hit").alias("all5"))
    return each.agg(F.count("*").alias("queries"), F.round(F.avg("any5"), 6).alias("recall_any"), F.round(F.avg("all5"), 6).alias("recall_all"))


def kendall_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = recall.channel_lists(*tables(spark, sf_dir), ("segmented", "ngram"))
    side = lambda c, p: lists.where(F.col("channel") == c).select("item_id", "doc_id", F.col("place").alias(p))
    both = side("segmented", "x").join(side("ngram", "y"), ["item_id", "doc_id"])
    gathered = both.groupBy("item_id").agg(F.collect_list(F.struct("x", "y")).alias("m"))  # at most 50 a question
    pair = F.flatten(F.transform("m", lambda a: F.transform(F.filter("m", lambda b: b["x"] > a["x"]), lambda b: F.when(b["y"] > a["y"], 1.0).otherwise(-1.0))))
    rows = gathered.withColumn("p", pair).where(F.size("p") > 0)
    total = F.aggregate("p", F.lit(0.0), lambda s, v: s + v)
    return rows.select("item_id", F.size("p").cast("long").alias("pairs"), F.round(total / F.size("p"), 6).alias("agreement"))


def and_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recall.with_every_word(*tables(spark, sf_dir))


def best_span_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recall.best_spans(*tables(spark, sf_dir))


def name_runs_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, _ = tables(spark, sf_dir)
    # runs of three words only, as names have three
    return graph.mentions(docs, graph.first_words(docs, 3), 3).withColumnRenamed("n", "mentions")


def entity_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked(*tables(spark, sf_dir)).withColumnRenamed("doc_id", "topic")


def topics_name_or_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by name, by content or by both."""
    docs, items = tables(spark, sf_dir)
    name = linked(docs, items).withColumn("named", F.lit(True))
    content = recall.channel_lists(docs, items, ("segmented",)).select("item_id", "doc_id").withColumn("held", F.lit(True))
    rows = name.join(content, ["item_id", "doc_id"], "full")
    return rows.select("item_id", "doc_id", F.when(F.col("named").isNull(), "content").when(F.col("held").isNull(), "name").otherwise("both").alias("found_by"))


def part_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live edges between parts and suppliers (negative): an edge for each pair, from its last shipment."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    last = lines.groupBy(F.col("l_partkey").alias("src"), (-F.col("l_suppkey")).alias("dst")).agg(F.max(F.struct("l_shipdate", "l_orderkey", "l_linenumber", F.round(F.col("l_quantity") / 50, 2).alias("c"))).alias("m"))
    return last.select("src", "dst", F.lit("supplied_by").alias("kind"), F.col("m.c").alias("confidence"))


def part_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part whose key is divisible by 50, for a walk of its own."""
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").where("p_partkey % 50 = 0")
    return parts.select(F.col("p_partkey").alias("query"), F.col("p_partkey").alias("topic"), F.lit(1).alias("place"))


def part_walk(spark: SparkSession, sf_dir: str, depth: int) -> DataFrame:
    return graph.walk(part_edges(spark, sf_dir), part_seeds(spark, sf_dir), depth)


def graph_walk(depth: int):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return part_walk(spark, sf_dir, depth).select(F.col("query").alias("origin"), F.col("topic").alias("node"), "via", F.col("hops").cast("long").alias("hops"), F.round("confidence", 6).alias("confidence"))

    return run


def graph_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = graph.walk(part_edges(spark, sf_dir), part_seeds(spark, sf_dir), 2, most=50).withColumn("worth", F.round(graph.strength(), 6))
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("worth"), "topic"))
    return rows.select(F.col("query").alias("origin"), F.col("topic").alias("node"), "worth", place.cast("long").alias("place")).where("place <= 50")


def walk_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = part_walk(spark, sf_dir, 2)
    return rows.groupBy(F.col("query").alias("origin")).agg(F.count("*").alias("reached"), F.count_if(F.col("hops") == 1).alias("near"), F.round(F.max("confidence"), 6).alias("best"))


def hub_sharing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Finds of a question that came through one topic share: the worth of each over the root of their number."""
    rows = graph.walk(part_edges(spark, sf_dir), part_seeds(spark, sf_dir), 2, crowd=True).withColumn("worth", F.round(graph.strength(), 6))
    return rows.select(F.col("query").alias("origin"), "via", F.col("topic").alias("node"), F.round(F.col("worth") / F.sqrt("crowd"), 6).alias("share"))


QUERIES = {
    "bm25_segmented": one_channel("segmented"),
    "bm25_ngram": one_channel("ngram"),
    "vector_recall": one_channel("vector"),
    "fusion_banded": fused_rows(True),
    "fusion_reciprocal": fused_rows(False),
    "graph_walk_2hop": graph_walk(2),
    "graph_walk_4hop": graph_walk(4),
} | {
    f.__name__: f
    for f in (
        vector_topk, search_fused, search_reranked, why_trace, channel_leave_one_out, seed_interleave, graph_recall, ndcg10, recall50, recall_any_all,
        kendall_agreement, and_probe, best_span_collapse, name_runs_join, entity_linking, topics_name_or_content, graph_channel, walk_summary, hub_sharing,
    )
}
