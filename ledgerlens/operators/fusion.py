"""Fusion of channel lists, seeds of the graph channel, choice and placement of what is reranked, and the trace of why.

Lists are rows (item_id, channel, doc_id, score, place); more columns may follow. All frames carry item_id, so that every
question of a batch is answered by one plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

from ..functions.materialise import written

WEIGHTS = {"segmented": 0.125, "ngram": 0.125, "graph": 0.30, "vector": 1.0}
#: In this order lists are interleaved.
CHANNELS = ["segmented", "ngram", "vector", "graph"]
#: Scores that mean the same in every list: their range is 0 to 1, not what a list happens to hold.
CALIBRATED = {"graph"}
K, SEEDS, HEAD = 10, 64, 30
FLAT = 1.2e-7
GRAPH_SHOWN_FROM, GRAPH_SHOWN_AT_MOST = 0.5, 4
FUSION_SHARE = 0.2


def weighted(weights: dict[str, float] | None = None, without: set[str] = frozenset(), **changed: float) -> dict[str, float]:
    """The default weights, or those given, with some changed and some channels left out."""
    return {c: 0.0 if c in without else w for c, w in {**(WEIGHTS if weights is None else weights), **changed}.items()}


def order_of(channel: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, CHANNELS)), channel)


def shares(lists: DataFrame, weights: dict[str, float] | None = None, k: int = K, banded: bool = True) -> DataFrame:
    """The lists with `part`, what each entry adds to its document's fused score; channels of weight nought are gone.

    Banded: between 1 / (k + 1) for the best and 1 / (k + n) for the worst of n, by the score. A list with a null score, or a
    flat one that isn't calibrated, is shared by rank, as all are when banded is false.
    """
    weights = WEIGHTS if weights is None else weights
    weight = F.coalesce(*(F.when(F.col("channel") == c, F.lit(float(w))) for c, w in weights.items()), F.lit(1.0))
    by_rank = F.lit(1.0) / (F.lit(k) + F.col("place"))
    if not banded:
        return lists.withColumn("part", weight * by_rank).where(weight > 0)
    own = Window.partitionBy("item_id", "channel")
    n, low, high = F.count("*").over(own), F.min("score").over(own), F.max("score").over(own)
    unscored = F.max(F.col("score").isNull()).over(own)
    calibrated = F.col("channel").isin(list(CALIBRATED))
    within = F.when(calibrated, F.least(F.greatest("score", F.lit(0.0)), F.lit(1.0))).when(F.col("high") - F.col("low") > FLAT, (F.col("score") - F.col("low")) / (F.col("high") - F.col("low")))
    floor = F.lit(k + 1.0) / (F.lit(k) + F.col("n"))
    band = (floor + (F.lit(1.0) - floor) * within) / F.lit(k + 1.0)
    ranged = lists.withColumns({"n": n, "low": low, "high": high, "unscored": unscored})
    part = weight * F.when(F.col("unscored"), by_rank).otherwise(F.coalesce(band, by_rank))
    return ranged.withColumn("part", part).where(weight > 0).drop("n", "low", "high", "unscored")


def fused(parts: DataFrame) -> DataFrame:
    """item_id, doc_id, score, channels, span (by vote, if the lists have spans) and place."""
    spans = "span" in parts.columns
    if spans:
        # spans are voted for by every channel but the graph, which knows none: the heavier wins, the earlier on a tie
        votes = parts.groupBy("item_id", "doc_id", F.when(F.col("channel") != "graph", F.col("span")).alias("span")).agg(F.sum("part").alias("w"), F.count("*").alias("c"))
        vote = F.when(F.col("span").isNotNull(), F.struct(F.round("w", 9).alias("w"), (-F.col("span")).alias("s")))
        summed = votes.groupBy("item_id", "doc_id").agg(F.round(F.sum("w"), 9).alias("score"), F.sum("c").alias("channels"), F.coalesce(-F.max(vote)["s"], F.lit(0)).alias("span"))
    else:
        summed = parts.groupBy("item_id", "doc_id").agg(F.round(F.sum("part"), 9).alias("score"), F.count("*").alias("channels"))
    return summed.withColumn("place", F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")))


def collapsed(spans: DataFrame) -> DataFrame:
    """A list of spans as one of documents: each keeps its best span, and places are given anew."""
    first = Window.partitionBy("item_id", "channel", "doc_id").orderBy(F.desc("score"), "span")
    kept = spans.withColumn("n", F.row_number().over(first)).where("n = 1").drop("n", "place")
    return kept.withColumn("place", F.row_number().over(Window.partitionBy("item_id", "channel").orderBy(F.desc("score"), "doc_id")))


def seeds(lists: DataFrame, named: DataFrame | None = None, known: DataFrame | None = None, most: int = SEEDS, k: int = K) -> DataFrame:
    """query, topic, place, relevance: named documents (item_id, doc_id) first, then the lists in turn, each document once.

    Only documents of `known` (doc_id) may be seeds. A named one has relevance 1, any other its best (k + 1) / (k + rank).
    """
    best = lists.groupBy("item_id", "doc_id").agg(F.min(F.struct(F.col("place").cast("long").alias("p"), order_of(F.col("channel")).cast("long").alias("c"))).alias("met"), F.max(F.lit(k + 1.0) / (F.lit(k) + F.col("place"))).alias("relevance"))
    rows = best.select("item_id", "doc_id", F.lit(1).alias("later"), F.col("met.p").alias("p"), F.col("met.c").alias("c"), "relevance")
    if named is not None:
        said = named.select("item_id", "doc_id").distinct().select("item_id", "doc_id", F.lit(0).alias("later"), F.lit(0).cast("long").alias("p"), F.lit(0).cast("long").alias("c"), F.lit(1.0).alias("relevance"))
        rows = rows.join(said, ["item_id", "doc_id"], "left_anti").unionByName(said)
    if known is not None:
        rows = rows.join(known.select("doc_id").distinct(), "doc_id", "left_semi")
    place = F.row_number().over(Window.partitionBy("item_id").orderBy("later", "p", "c", "doc_id"))
    rows = rows.withColumn("place", place).where(F.col("place") <= most)
    return rows.select(F.col("item_id").alias("query"), F.col("doc_id").alias("topic"), "place", "relevance")


def rerankable(ranked: DataFrame, lists: DataFrame, head: int = HEAD) -> DataFrame:
    """The ranked rows with `shown` and `below`: the head, and the best finds of the graph alone from below it.

    Finds that came through one topic share its worth: score over the root of their number.
    """
    of = lists.groupBy("item_id", "doc_id").agg(F.bool_and(F.col("channel") == "graph").alias("alone"), F.max(F.when(F.col("channel") == "graph", F.struct(F.coalesce("score", F.lit(0.0)).alias("score"), F.col("via").alias("via")))).alias("g"))
    rows = ranked.join(of, ["item_id", "doc_id"], "left")
    eligible = (F.col("place") > head) & F.coalesce(F.col("alone"), F.lit(False)) & (F.col("g.score") >= GRAPH_SHOWN_FROM)
    rows = rows.withColumn("eligible", F.coalesce(eligible, F.lit(False)))
    sharing = F.count("*").over(Window.partitionBy("item_id", "eligible", F.col("g.via")))
    rows = rows.withColumn("worth", F.when(F.col("eligible"), F.col("g.score") / F.sqrt(sharing)))
    rows = rows.withColumn("turn", F.row_number().over(Window.partitionBy("item_id", "eligible").orderBy(F.desc("worth"), "place")))
    below = F.col("eligible") & (F.col("turn") <= GRAPH_SHOWN_AT_MOST)
    return rows.withColumns({"below": below, "shown": below | (F.col("place") <= head)}).drop("alone", "g", "eligible", "turn", "worth")


def blended(shown: DataFrame, share: float = FUSION_SHARE) -> DataFrame:
    """Rows with the blend of `score` and `model`, each scaled to 0..1 within its question (0 where flat)."""
    own = Window.partitionBy("item_id")

    def scaled(c: str) -> Column:
        low, high = F.min(c).over(own), F.max(c).over(own)
        return F.when(high > low, (F.col(c) - low) / (high - low)).otherwise(F.lit(0.0))

    return shown.withColumn("blend", F.round(F.lit(share) * scaled("score") + F.lit(1 - share) * scaled("model"), 6))


def placed(ranked: DataFrame, blends: DataFrame) -> DataFrame:
    """Final places: what was shown first, best blend first, then the rest as fused. With fewer than two shown the fused order stays."""
    several = blends.groupBy("item_id").agg(F.count("*").alias("c")).where("c > 1").select("item_id")
    scored = blends.join(several, "item_id", "left_semi").select("item_id", "doc_id", "blend")
    rows = ranked.withColumnRenamed("place", "fused_place").join(scored, ["item_id", "doc_id"], "left")
    order = [F.col("blend").isNull(), F.desc("blend"), F.col("fused_place")]
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("item_id").orderBy(*order)))


@pandas_udf(DoubleType())
def shared_words(question, text):
    """Plug point, the pair scorer: how many of the question's words the text has. Takes and gives columns of a batch."""
    import pandas as pd

    from .recall import words

    return pd.Series([float(len(words(q or "").keys() & words(t or "").keys())) for q, t in zip(question, text, strict=True)])


def reranked(ranked: DataFrame, lists: DataFrame, docs: DataFrame, questions: DataFrame, scorer=shared_words, head: int = HEAD) -> DataFrame:
    """item_id, doc_id, score, fused_place, blend, place."""
    chosen = rerankable(ranked, lists, head).where("shown").select("item_id", "doc_id", "score", "place")
    few = written(chosen)  # at most `head` and `GRAPH_SHOWN_AT_MOST` a question: they go to the documents
    held = docs.select("doc_id", "text").join(F.broadcast(few.select("doc_id").distinct()), "doc_id", "left_semi")
    pairs = few.join(held, "doc_id").join(questions.select("item_id", F.col("text").alias("question")), "item_id")
    model = pairs.withColumn("model", scorer(F.col("question"), F.col("text"))).drop("text", "question")
    return placed(ranked, blended(model))


def why(parts: DataFrame, final: DataFrame | None = None) -> DataFrame:
    """item_id, doc_id, why: channel entries in the order of lists, then the path, then the rerank, as an array of structs."""
    entry = lambda kind, channel, place, score, via, a, b: F.struct(F.lit(kind).alias("kind"), channel.alias("channel"), place.cast("long").alias("place"), score.alias("score"), via.alias("via"), a.alias("asserted_from"), b.alias("asserted_to"))
    none = F.lit(None).cast("long")
    channels = parts.select("item_id", "doc_id", order_of(F.col("channel")).cast("int").alias("o"), entry("channel", F.col("channel"), F.col("place"), F.col("score"), none, none, none).alias("e"))
    rows = channels
    if "via" in parts.columns:
        out = F.col("outbound")
        path = entry("path", F.lit("graph"), F.col("hops"), F.lit(None).cast("double"), F.col("via"), F.when(out, F.col("via")).otherwise(F.col("doc_id")), F.when(out, F.col("doc_id")).otherwise(F.col("via")))
        rows = rows.unionByName(parts.where("channel = 'graph'").select("item_id", "doc_id", F.lit(100).alias("o"), path.alias("e")))
    if final is not None:
        said = entry("reranked", F.lit(None).cast("string"), F.col("place"), F.col("blend"), none, none, none)
        rows = rows.unionByName(final.where("blend IS NOT NULL").select("item_id", "doc_id", F.lit(200).alias("o"), said.alias("e")))
    return rows.groupBy("item_id", "doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("o", "e"))), lambda x: x["e"]).alias("why"))
