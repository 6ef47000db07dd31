"""Words of questions counted document by document, and spans a bounded number at a time."""

import random

import pyarrow as pa
import pytest

from ledgerlens import registry
from ledgerlens.functions import markdown
from ledgerlens.operators import recall


@pytest.fixture(scope="module")
def rows(spark):
    pick = random.Random(5)
    texts = [(k, " ".join(pick.choice("a B ç d 日本 e".split()) for _ in range(pick.choice([0, 2, 9, 900])))) for k in range(40)]
    items = [(1, "a b"), (2, "日本 E d"), (3, ""), (4, None), (5, "zz"), (1, "Ç"), (6, "a")]
    return texts, items, spark.createDataFrame([*texts, (99, None)], "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")


@pytest.mark.parametrize("block", [1, 256])
def test_every_word_and_best_spans(rows, block):
    texts, items, docs, asked = rows
    want = {}
    for i, t in items:
        want.setdefault(i, set()).update(recall.words(t or ""))
    split = {d: recall.WORD.findall(t.lower()) for d, t in texts}
    got = sorted(map(tuple, recall.with_every_word(docs, asked, block).collect()))
    assert got == sorted((i, d) for i, ws in want.items() if ws for d, found in split.items() if ws <= set(found))
    best = {}
    for i, ws in want.items():
        for d, found in split.items():
            votes = [sum(w in ws for w in found[k : k + 200]) for k in range(0, len(found), 200)]
            if max(votes, default=0):
                best[i, d] = (votes.index(max(votes)), max(votes))
    assert {(r.item_id, r.doc_id): (r.span, r.votes) for r in recall.best_spans(docs, asked, block=block).collect()} == best


def test_no_posting_is_shuffled(spark):
    for name in ("and_probe", "best_span_collapse"):
        plan = registry.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan, name


def test_spans_leave_a_few_contents_at_a_time(spark, monkeypatch):
    topics = spark.createDataFrame([(k, "n", f"text {k}.\n\nmore") for k in range(300)], "topic_id long, name string, content string")
    made = []
    monkeypatch.setattr(type(topics), "mapInArrow", lambda self, run, kind: made.append(run) or self)
    markdown.span_frame(topics)
    batch = pa.RecordBatch.from_pylist([{"topic_id": k, "name": "n", "content": f"text {k}.\n\nmore"} for k in range(300)])
    sizes = [len(set(b.column(0).to_pylist())) for b in made[0](iter([batch]))]
    assert sum(sizes) == 300 and max(sizes) <= 64


def test_products_of_a_few_vectors_at_a_time(spark, monkeypatch):
    vectors = spark.createDataFrame([(k, [float(k % 7), 1.0, k / 9]) for k in range(700)], "vec_id long, embedding array<float>")
    seen, unit = [], recall.unit
    made = []
    monkeypatch.setattr(type(vectors), "mapInArrow", lambda self, run, kind: made.append(run) or self.selectExpr("vec_id AS item_id", "vec_id AS doc_id", "0D AS score"))
    recall.nearest(vectors, vectors.where("vec_id < 3"))
    monkeypatch.setattr(recall, "unit", lambda rows: seen.append(len(rows)) or unit(rows))
    list(made[0](iter([pa.RecordBatch.from_arrays([pa.array(range(700)), pa.array([[float(k % 7), 1.0, k / 9] for k in range(700)], pa.list_(pa.float32()))], ["vec_id", "embedding"])])))
    assert sum(seen) == 700 and max(seen) <= recall.ROWS
