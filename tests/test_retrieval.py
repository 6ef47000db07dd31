"""Retrieval queries against brute force that asks whole benchmark texts, on the small tables."""

import math
import re
from collections import Counter, defaultdict

import pyarrow.parquet as pq
import pytest

from ledgerlens import registry

DATA = "/root/testdata/sf0.001"


def column(table, key, value):
    rows = pq.read_table(f"{DATA}/{table}.parquet", columns=[key, value]).to_pydict()
    return dict(zip(rows[key], rows[value], strict=True))


def words(text):
    return re.findall(r"\w+", text.lower())


def grams(text):
    return [text[k : k + 2] for k in range(len(text) - 1)]


@pytest.fixture(scope="module")
def texts():
    return column("documents", "doc_id", "text"), column("benchmark", "item_id", "text")


def bm25(docs, items, terms, depth=50):
    counts = {i: Counter(terms(t)) for i, t in docs.items()}
    lengths = {i: sum(c.values()) for i, c in counts.items()}
    mean, df = sum(lengths.values()) / len(docs), Counter(t for c in counts.values() for t in c)
    out = {}
    for item, text in items.items():
        scores = defaultdict(float)
        for term in set(terms(text)):
            idf = math.log(1 + (len(docs) - df[term] + 0.5) / (df[term] + 0.5))
            for doc, c in counts.items():
                if c[term]:
                    scores[doc] += idf * c[term] * 2.5 / (c[term] + 1.5 * (0.25 + 0.75 * lengths[doc] / mean))
        best = sorted(scores.items(), key=lambda x: (-round(x[1], 6), x[0]))[:depth]
        out |= {(item, doc): score for doc, score in best}
    return out


@pytest.mark.parametrize(("name", "terms"), [("bm25_segmented", words), ("bm25_ngram", grams)])
def test_bm25_asks_every_term(spark, texts, name, terms):
    got = {(r.item_id, r.doc_id): r.score for r in registry.QUERIES[name](spark, DATA).collect()}
    assert got == pytest.approx(bm25(*texts, terms), abs=2e-6)


def test_and_probe_wants_every_word(spark, texts):
    docs, items = texts
    has = {i: set(words(t)) for i, t in docs.items()}
    want = {(i, d) for i, t in items.items() for d in docs if set(words(t)) <= has[d]}
    assert {tuple(r) for r in registry.QUERIES["and_probe"](spark, DATA).select("item_id", "doc_id").collect()} == want


def test_best_span_counts_every_word(spark, texts):
    docs, items = texts
    want = {}
    for doc, text in docs.items():
        spans = defaultdict(Counter)
        for pos, word in enumerate(words(text)):
            spans[pos // 200][word] += 1
        for item, asked in items.items():
            votes = {s: sum(c[w] for w in set(words(asked))) for s, c in spans.items()}
            if votes and max(votes.values()):
                best = min(votes, key=lambda s: (-votes[s], s))
                want[item, doc] = (best, votes[best])
    assert {(r.item_id, r.doc_id): (r.span, r.votes) for r in registry.QUERIES["best_span_collapse"](spark, DATA).collect()} == want


def test_passages_hold_the_whole_text(spark, texts):
    langs = column("documents", "doc_id", "lang")
    got = {r.doc_id: r.passage for r in registry.QUERIES["rendered_passages"](spark, DATA).collect()}
    assert got == {i: f"{langs[i]}: {t}" for i, t in texts[0].items()}
