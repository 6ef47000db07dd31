"""Fusion, seeds, choice, blend and placement on hand-made lists."""

import pytest

from ledgerlens.operators import fusion, recall

LIST = "item_id long, channel string, doc_id long, score double, place int"


def lists(spark, rows, schema=LIST):
    return spark.createDataFrame([(1, *r) for r in rows], schema)


def parts(spark, rows, **more):
    return {(r.channel, r.doc_id): r.part for r in fusion.shares(lists(spark, rows), **more).collect()}


def test_band_runs_from_the_first_place_to_the_last(spark):
    got = parts(spark, [("vector", k, 1.0 - k / 100, k) for k in range(1, 51)])
    assert got["vector", 1] == pytest.approx(1 / 11) and got["vector", 50] == pytest.approx(1 / 60)


def test_weight_nought_leaves_out(spark):
    got = fusion.fused(fusion.shares(lists(spark, [("vector", 1, 0.9, 1), ("ngram", 2, 5.0, 1)]), fusion.weighted(without={"ngram"})))
    assert [r.doc_id for r in got.collect()] == [1]
    assert fusion.weighted(graph=0.9)["graph"] == 0.9


def test_weak_paths_stay_low_in_their_band(spark):
    graph = [("graph", k, 0.5, k) for k in range(1, 5)]
    got = parts(spark, graph)
    floor = 11 / 14
    assert got["graph", 1] == pytest.approx(0.30 * (floor + (1 - floor) * 0.5) / 11) == pytest.approx(got["graph", 4])
    # a flat list without a range of its own is shared by rank, and so is one with a score unknown
    flat = parts(spark, [("vector", k, 0.5, k) for k in range(1, 3)])
    assert flat == {("vector", 1): pytest.approx(1 / 11), ("vector", 2): pytest.approx(1 / 12)}
    unknown = parts(spark, [("vector", 1, 0.5, 1), ("vector", 2, None, 2)])
    assert unknown == flat
    assert parts(spark, [("vector", 1, 0.9, 1), ("vector", 2, 0.1, 2)], banded=False) == flat


def test_spans_are_voted_for(spark):
    rows = [("vector", 1, 0.9, 1, 7), ("vector", 2, 0.1, 2, 0), ("segmented", 1, 9.0, 1, 3), ("ngram", 1, 9.0, 1, 3), ("graph", 5, 0.5, 1, None)]
    got = {r.doc_id: (r.span, r.channels) for r in fusion.fused(fusion.shares(lists(spark, rows, LIST + ", span long"))).collect()}
    assert got == {1: (7, 3), 2: (0, 1), 5: (0, 1)}
    tie = [("segmented", 1, 9.0, 1, 4), ("ngram", 1, 9.0, 1, 2)]
    assert [r.span for r in fusion.fused(fusion.shares(lists(spark, tie, LIST + ", span long"))).collect()] == [2]
    kept = fusion.collapsed(lists(spark, [("ngram", 1, 5.0, 1, 0), ("ngram", 1, 6.0, 2, 1), ("ngram", 2, 5.5, 3, 0)], LIST + ", span long")).collect()
    assert sorted((r.doc_id, r.span, r.place) for r in kept) == [(1, 1, 1), (2, 0, 2)]


def test_seeds_named_first_then_in_turn(spark):
    rows = lists(spark, [("vector", 5, 0.9, 1), ("segmented", 7, 3.0, 1), ("segmented", 5, 2.0, 2), ("ngram", 8, 1.0, 2), ("ngram", 9, 1.0, 3)])
    named = spark.createDataFrame([(1, 8)], "item_id long, doc_id long")
    known = spark.createDataFrame([(5,), (7,), (8,)], "doc_id long")
    got = sorted((r.place, r.topic, round(r.relevance, 6)) for r in fusion.seeds(rows, named, known).collect())
    assert got == [(1, 8, 1.0), (2, 7, 1.0), (3, 5, 1.0)]
    assert fusion.seeds(rows, most=2).count() == 2


def ranked(spark, n, finds):
    """n fused documents, and those of `finds` (doc: score, via) from the graph alone."""
    rows = [("vector", d, 1 - d / 1000, d, None) for d in range(1, n + 1) if d not in finds] + [("graph", d, s, 1, v) for d, (s, v) in finds.items()]
    both = lists(spark, rows, LIST + ", via long")
    order = spark.createDataFrame([(1, d, 1.0 - d / 1000, d) for d in range(1, n + 1)], "item_id long, doc_id long, score double, place int")
    return order, both


def test_finds_through_one_topic_share(spark):
    finds = {35: (0.6, 1), 36: (0.6, 1), 37: (0.6, 1), 38: (0.5, 2), 39: (0.55, 3), 40: (0.52, 4), 41: (0.51, 5), 42: (0.4, 6), 3: (0.9, 9)}
    rows = fusion.rerankable(*ranked(spark, 50, finds)).collect()
    assert sorted(r.doc_id for r in rows if r.below) == [38, 39, 40, 41]
    assert sorted(r.doc_id for r in rows if r.shown) == [*range(1, 31), 38, 39, 40, 41]


def test_placement(spark):
    order, both = ranked(spark, 8, {7: (0.9, 1)})
    rows = fusion.rerankable(order, both, head=3)
    shown = [r.doc_id for r in rows.where("shown").collect()]
    assert sorted(shown) == [1, 2, 3, 7]
    model = {1: 0.0, 2: 5.0, 3: 1.0, 7: 9.0}
    scored = spark.createDataFrame([(1, d, 1.0 - d / 1000, d, m) for d, m in model.items()], "item_id long, doc_id long, score double, place int, model double")
    got = [r.doc_id for r in fusion.placed(order, fusion.blended(scored)).orderBy("place").collect()]
    # as the list is refilled by hand: slots of the head and one more, best first, then the rest
    assert got == [7, 2, 3, 1, 4, 5, 6, 8]
    one = fusion.blended(scored.where("doc_id = 2"))
    assert [r.doc_id for r in fusion.placed(order, one).orderBy("place").collect()] == list(range(1, 9))


def test_why_follows_the_assertion(spark):
    rows = lists(spark, [("vector", 4, 0.9, 2, None, None, None), ("graph", 4, 0.4, 1, 3, 2, False)], LIST + ", via long, hops int, outbound boolean")
    [row] = fusion.why(fusion.shares(rows)).collect()
    assert [(w.kind, w.channel, w.place) for w in row.why] == [("channel", "vector", 2), ("channel", "graph", 1), ("path", "graph", 2)]
    assert (row.why[2].asserted_from, row.why[2].asserted_to) == (4, 3)


def test_blocks_of_questions_and_recall(spark):
    docs = spark.createDataFrame([(k, f"word{k % 7} word{k % 5} tail{k}") for k in range(60)] + [(60, None), (61, "")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "word3 word1"), (2, "tail9"), (3, ""), (4, "nothing here")], "item_id long, text string")
    whole = {tuple(r) for r in recall.channel_lists(docs, items, ("segmented", "vector")).collect()}
    assert whole == {tuple(r) for r in recall.channel_lists(docs.repartition(5), items, ("segmented", "vector"), block=1).collect()}
    assert {r[2] for r in whole if r[0] == 2 and r[1] == "segmented"} == {9}
    assert not [r for r in whole if r[0] == 3]
    vectors = spark.createDataFrame([(k, [float(k), 1.0]) for k in range(40)] + [(40, [0.0, 0.0])], "vec_id long, embedding array<float>")
    exact = recall.nearest(vectors, vectors.where("vec_id < 5"), depth=10)
    assert recall.recall_against(exact, exact) == 1.0 and recall.recall_against(exact, exact.where("place <= 5")) == 0.5
    assert exact.where("query_id = vec_id").count() == 0
