"""Walks against brute force, and the walk, writes and as-of reading of edges on hand-made rows."""

import datetime
from collections import defaultdict

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from ledgerlens import registry
from ledgerlens.operators import graph

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def live(spark):
    rows = registry.QUERIES["edge_versions"](spark, DATA).where("invalidated_at IS NULL").collect()
    return {(r.src, r.dst): r.confidence for r in rows}


def walked(near, origin, depth, frontier=2000):
    """Breadth first from one node, as one would by hand."""
    reached, seen, steps = {}, set(), [(origin, origin)]
    for hop in range(1, depth + 1):
        met = []
        for node, via in steps:
            for c, after in sorted(((c, b) for b, c in near[node].items()), key=lambda x: (-x[0], x[1])):
                if hop > 1 and after in (origin, via) or after in seen:
                    continue
                seen.add(after)
                reached.setdefault(after, (node, hop, c))
                met.append((c, after, node))
        met.sort(key=lambda x: -x[0])
        steps = [(node, via) for _, node, via in met[:frontier]]
    return reached


@pytest.mark.parametrize("depth", [2, 4])
def test_walks(spark, live, depth):
    near = defaultdict(dict)
    for (a, b), c in live.items():
        near[a][b] = near[b][a] = c
    want = {}
    for origin in pq.read_table(f"{DATA}/part.parquet").column("p_partkey").to_pylist():
        if origin % 50 == 0:
            want |= {(origin, n): x for n, x in walked(near, origin, depth).items()}
    got = {(r.origin, r.node): (r.via, r.hops, r.confidence) for r in registry.QUERIES[f"graph_walk_{depth}hop"](spark, DATA).collect()}
    assert got.keys() == want.keys() and all(got[k][:2] == want[k][:2] and got[k][2] == pytest.approx(want[k][2]) for k in want)


def test_front_is_all_suppliers(spark, live):
    got = {(r.src, r.dst): r.confidence for r in registry.QUERIES["endpoint_union_join"](spark, DATA).collect()}
    assert got == live


def edges_of(spark, rows):
    return spark.createDataFrame([(a, b, "related_to", c) for a, b, c in rows], "src long, dst long, kind string, confidence double")


def walk_of(spark, rows, seeds, depth, **more):
    start = spark.createDataFrame([(1, s, k + 1) for k, s in enumerate(seeds)], "query long, topic long, place int")
    return {r.topic: (r.origin, r.via, r.hops, r.confidence) for r in graph.walk(edges_of(spark, rows), start, depth, **more).collect()}


def test_a_seed_never_returns(spark):
    assert walk_of(spark, [(1, 2, 0.5)], [1], 4) == {2: (1, 1, 1, 0.5)}
    # two seeds are two walks: either may reach the other
    assert walk_of(spark, [(1, 2, 0.5)], [1, 2], 4) == {2: (1, 1, 1, 0.5), 1: (2, 2, 1, 0.5)}


def test_first_hop_wins_then_confidence(spark):
    rows = [(1, 2, 0.2), (1, 3, 0.9), (3, 2, 0.9), (3, 4, 0.4), (2, 4, 0.8), (5, 2, 0.3)]
    got = walk_of(spark, rows, [1, 5], 2)
    assert got[2] == (5, 5, 1, 0.3) and got[3] == (1, 1, 1, 0.9)
    # by way of 3, the more confident step of the frontier, although 2 crosses with more
    assert walk_of(spark, rows[:5], [1], 2)[4] == (1, 3, 2, 0.4)
    assert set(walk_of(spark, rows, [1], 4, frontier=1)) == {2, 3, 4, 5} - {5}
    assert set(walk_of(spark, rows, [1], 4, keep=2)) == {2, 3}
    with pytest.raises(ValueError):
        walk_of(spark, rows, [1], 5)
    assert graph.of_kinds(edges_of(spark, rows), ["other"]).count() == 0 and graph.of_kinds(edges_of(spark, rows), None).count() == 6


DAY = lambda n: datetime.datetime(2024, 1, n)


def test_reason_decides_what_history_keeps(spark):
    row = lambda dst, end, why: (1, dst, "k", "explicit", 1.0, None, None, DAY(1), end, why, 1)
    versions = spark.createDataFrame([row(2, None, None), row(3, DAY(9), "closed"), row(4, DAY(9), "superseded"), row(5, DAY(9), "deleted")], graph.VERSION)
    at = lambda n: {r.dst for r in graph.as_of(versions, F.lit(DAY(n))).collect()}
    assert at(5) == {2, 3} and at(9) == at(20) == {2}
    bounded = spark.createDataFrame([(1, 2, "k", "explicit", 1.0, DAY(10), DAY(20), DAY(1), None, None, 1)], graph.VERSION)
    assert [graph.as_of(bounded, F.lit(DAY(n))).count() for n in (9, 10, 19, 20)] == [0, 1, 1, 0]


def test_assert_retract_close(spark):
    now = lambda n: F.lit(DAY(n))
    claim = "src long, dst long, kind string, derivation string, confidence double, valid_from timestamp, valid_to timestamp, seq long"
    claims = lambda *rows: spark.createDataFrame([(a, b, "mentions", "deterministic", c, None, None, k) for k, (a, b, c) in enumerate(rows)], claim)
    none = spark.createDataFrame([], graph.VERSION)
    versions = graph.applied(none, *graph.assert_edges(none, claims((1, 2, 0.3), (1, 2, 0.5), (1, 3, 0.5)), now(1)))
    ended, new = graph.assert_edges(versions, claims((1, 2, 0.5), (1, 3, 0.7)), now(2))
    assert [(r.dst, r.tombstone, r.invalidated_at) for r in ended.collect()] == [(3, "superseded", DAY(2))]
    assert [(r.dst, r.version, r.confidence) for r in new.collect()] == [(3, 2, 0.7)]
    versions = graph.applied(versions, ended, new)
    assert versions.count() == 3 and graph.live(versions).count() == 2
    origin = spark.createDataFrame([(1,)], "src long")
    keep = spark.createDataFrame([(1, 2)], "src long, dst long")
    gone = graph.retract_derived(versions, "mentions", origin, keep, now(3))
    assert [(r.dst, r.version, r.tombstone) for r in gone.collect()] == [(3, 2, "closed")]
    versions = graph.applied(versions, gone)
    assert [(r.src, r.dst) for r in graph.targets(versions, origin, "mentions").collect()] == [(1, 2)]
    assert [r.tombstone for r in graph.history(versions, 1, 3, "mentions").collect()] == ["superseded", "closed"]
    deleted = graph.close_edges(versions, spark.createDataFrame([(1, 2, "mentions")], "src long, dst long, kind string"), "deleted", now(4))
    assert [(r.dst, r.tombstone) for r in deleted.collect()] == [(2, "deleted")]
    ended, new = graph.link(versions, 1, 9, "related_to", now(5))
    linked = graph.applied(versions, ended, new)
    assert new.count() == 1 and all(x.count() == 0 for x in graph.link(linked, 1, 9, "related_to", now(6)))
    with pytest.raises(Exception, match="interval"):
        graph.checked(spark.createDataFrame([(1, 2, "k", "explicit", 1.0, DAY(3), DAY(3), 0)], claim)).collect()


def test_mentions_by_brute_force(spark):
    texts = {1: "Deploy service", 2: "call the deploy service now", 3: "The technical debt is mounting", 4: "db", 5: "deploy the service", 6: None}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    names = spark.createDataFrame([(1, "deploy service"), (4, "db"), (3, "the technical debt")], "topic long, name string")
    assert {tuple(r) for r in graph.mentions(docs, names, 3).collect()} == {(2, 1, 1)}
    versions = graph.restate_mentions(spark.createDataFrame([], graph.VERSION), docs, names, 3, F.lit(DAY(1)))
    assert [(r.src, r.dst, r.confidence) for r in versions.collect()] == [(2, 1, 0.5)]
    changed = spark.createDataFrame([(2, "call nobody")], "doc_id long, text string")
    assert [r.tombstone for r in graph.restate_mentions(versions, changed, names, 3, F.lit(DAY(2))).collect()] == ["closed"]
