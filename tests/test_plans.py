"""Every query against the same question put to a second engine, on the small tables."""

import duckdb
import pytest

from ledgerlens import registry
from ledgerlens.plans import search

DATA = "/root/testdata/sf0.001"


def rows(frame):
    frame = frame[sorted(frame.columns)]
    for c in frame.columns:
        if str(frame[c].dtype).startswith("datetime"):
            frame = frame.assign(**{c: frame[c].astype("datetime64[us]").astype(str)})
        elif str(frame[c].dtype) in ("float64", "Float64", "Int64", "int64", "int32"):
            frame = frame.assign(**{c: frame[c].astype("float64")})
    return sorted(map(str, frame.astype(object).where(frame.notna(), None).itertuples(index=False, name=None)))


@pytest.fixture(scope="module")
def other():
    con = duckdb.connect()
    for t in registry.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.fixture(scope="module", autouse=True)
def once():
    """Lists and walks that many queries start from are made once: all read the same tables here."""
    kept = {name: getattr(search, name) for name in ("four_lists", "index_lists", "part_walk", "mention_edges")}
    made = {}

    def remembered(name, key):
        def call(*args):
            at = (name, *key(*args))
            if at not in made:
                made[at] = kept[name](*args)
            return made[at]

        return call

    for name in ("four_lists", "index_lists", "mention_edges"):
        setattr(search, name, remembered(name, lambda *a: ()))
    search.part_walk = remembered("part_walk", lambda s, d, depth: (depth,))
    yield
    for name, f in kept.items():
        setattr(search, name, f)


def test_every_query_is_held_against_something():
    alone = {"span_packing", "page_sections", "vector_recall_half"}  # greedy, or floating: tests/test_markdown.py, and below
    assert registry.QUERIES.keys() - registry.ORACLES.keys() == alone


def test_storage_in_16_bits_loses_little(spark):
    found = [r.recall for r in registry.QUERIES["vector_recall_half"](spark, DATA).collect()]
    assert found and sum(found) / len(found) >= 0.97


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_same_rows(spark, other, name):
    got, want = registry.QUERIES[name](spark, DATA).toPandas(), other.execute(registry.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
