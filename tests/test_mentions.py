"""Mentions of shared names, and the channel that walks them by their names, against edges made whole."""

import random

import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import graph, recall
from ledgerlens.plans import search


def corpus(spark, seed, words, n=90):
    """Documents of few words, so that names are shared and most documents have several."""
    pick = random.Random(seed)
    texts = [(k, " ".join(pick.choice(words) for _ in range(pick.randint(0, 14)))) for k in range(n)]
    return texts, spark.createDataFrame([*texts, (n, None)], "doc_id long, text string")


def brute(texts, names, widest):
    out = {}
    for src, text in texts:
        w = recall.WORD.findall(text.lower())
        for width in range(1, widest + 1):
            for k in range(len(w) - width + 1):
                for topic, name in names:
                    if topic != src and name == " ".join(w[k : k + width]):
                        out[src, topic] = out.get((src, topic), 0) + 1
    return out


def test_mentions_of_shared_names(spark):
    texts, docs = corpus(spark, 1, ["a", "B", "ça", "日本", "d"])
    names = [(r.topic, r.name) for r in graph.first_words(docs, 3).collect()]
    assert names == [(k, " ".join(w[:3])) for k, t in texts if len(w := recall.WORD.findall(t.lower())) >= 3]
    names += [(3, "a"), (3, "b d"), (names[0])]  # several names of one topic, and one that is said twice
    got = [(r.src, r.dst, r.n) for r in graph.mentions(docs, spark.createDataFrame(names, "topic long, name string"), 3).collect()]
    assert {(a, b): n for a, b, n in got} == brute(texts, names, 3) and len(got) == len({x[:2] for x in got})


@pytest.mark.parametrize(("words", "keep"), [("abcdefghijkl", 50), ("abcdefghijklmnopqr", 12), ("ab", 5), ("abcdefghijklmnopqr", 3)])
def test_channel_without_edges(spark, words, keep):
    _, docs = corpus(spark, keep, words, 150)
    pick = random.Random(keep)
    rows = [(q, t, k + 1, 11.0 / (10 + k // 2)) for q in range(9) for k, t in enumerate(pick.sample(range(150), 1 + q))]
    seeds = spark.createDataFrame(rows, "query long, topic long, place int, relevance double")
    names = graph.first_words(docs, 3)
    got = graph.mention_channel(graph.name_runs(docs, names, 3), names, seeds, keep)
    want = graph.graph_channel(search.mention_edges(docs), seeds, keep=keep)
    order = lambda df: sorted(map(tuple, df.select(*want.columns).collect()))
    assert order(got) == order(want) and {r.hops for r in got.select("hops").collect()} >= {1}


def test_no_edge_is_made_that_is_not_crossed(spark, monkeypatch):
    """A name that all documents share: edges grow with the square of them, rows of the channel don't."""
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("one name here and "), "id").alias("text"))
    items = spark.createDataFrame([(1, "one name")], "item_id long, text string")
    monkeypatch.setattr(search, "mention_edges", None)
    monkeypatch.setattr(graph, "mentions", None)
    lists, _ = search.four_lists(docs, items)
    assert [(r.doc_id, r.via) for r in lists.where("channel = 'graph'").orderBy("place").limit(2).collect()] == [(0, 1), (1, 0)]


def test_holding_whole_texts(spark):
    texts = [(0, "Say: the quick Brown fox, now"), (1, "the quick brown fox"), (2, None), (3, "xthe quick Brown foxes"), (4, "a b"), (5, "")]
    items = [(1, "the quick Brown fox"), (2, "a b"), (3, ""), (4, "quick"), (5, "zebra stripes are")]
    docs, asked = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = sorted((i, d) for i, t in items for d, text in texts if text is not None and t in text)
    assert sorted(map(tuple, recall.holding(docs, asked).collect())) == want
