"""Recall channels, fusion, reranking and the search they make up, for all queries of a batch at once."""

from __future__ import annotations

WEIGHTS = {"segmented": 0.125, "ngram": 0.125, "graph": 0.30, "vector": 1.0}
K = 10


def bm25(d, name: str, postings: str, terms: str, depth: int = 50) -> str:
    """CTEs for one channel: idf over matching terms only, k1 = 1.5, b = 0.75; rank by the rounded score, then id.

    Lengths and frequencies are counted per document before anything is shuffled; only postings of asked terms go on.
    """
    return f"""
{name}_all AS ({postings}),
{name}_q AS (SELECT DISTINCT item_id, term FROM ({terms}) asked),
{name}_len AS (SELECT doc_id, count(*) AS len FROM {name}_all GROUP BY doc_id),
{name}_n AS (SELECT CAST((SELECT count(*) FROM documents) AS DOUBLE) AS n, (SELECT CAST(sum(len) AS DOUBLE) FROM {name}_len) / (SELECT count(*) FROM documents) AS avglen),
{name}_tf AS (SELECT doc_id, term, count(*) AS tf FROM {name}_all WHERE term IN (SELECT term FROM {name}_q) GROUP BY doc_id, term),
{name}_df AS (SELECT term, ln(1 + (max(n) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM {name}_tf, {name}_n GROUP BY term),
{name}_s AS (SELECT q.item_id, t.doc_id, round(sum(f.idf * t.tf * 2.5 / (t.tf + 1.5 * (0.25 + 0.75 * l.len / n.avglen))), 6) AS score
             FROM {name}_q q JOIN {name}_tf t ON q.term = t.term JOIN {name}_df f ON f.term = t.term JOIN {name}_len l ON l.doc_id = t.doc_id, {name}_n n GROUP BY q.item_id, t.doc_id),
{name} AS (SELECT item_id, doc_id, score, place FROM (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS place FROM {name}_s) r WHERE place <= {depth})""".replace("0.5)", "CAST(0.5 AS DOUBLE))").replace("2.5 /", "CAST(2.5 AS DOUBLE) /").replace("1.5 *", "CAST(1.5 AS DOUBLE) *").replace("0.25 +", "CAST(0.25 AS DOUBLE) +").replace("0.75 *", "CAST(0.75 AS DOUBLE) *")


def segmented(d) -> str:
    return bm25(d, "segmented", d.tokens("documents", "doc_id", "text"), d.tokens("benchmark", "item_id", "text"))


def ngram(d) -> str:
    return bm25(d, "ngram", d.grams("documents", "doc_id", "text"), d.grams("benchmark", "item_id", "text"))


def lists(d) -> str:
    """CTE lists of all four channels; the graph is walked two hops from named documents and the other lists' heads."""
    return f"""{segmented(d)},{ngram(d)},
signed AS (SELECT doc_id, dim, sum(s) AS v FROM (SELECT doc_id, CAST('0x' || substr(md5(term), 1, 4) AS BIGINT) % 64 AS dim, CASE WHEN CAST('0x' || substr(md5(term), 5, 1) AS BIGINT) % 2 = 1 THEN 1 ELSE -1 END AS s FROM segmented_all) GROUP BY doc_id, dim),
asked_signed AS (SELECT item_id, dim, sum(s) AS v FROM (SELECT item_id, CAST('0x' || substr(md5(term), 1, 4) AS BIGINT) % 64 AS dim, CASE WHEN CAST('0x' || substr(md5(term), 5, 1) AS BIGINT) % 2 = 1 THEN 1 ELSE -1 END AS s FROM ({d.tokens('benchmark', 'item_id', 'text')})) GROUP BY item_id, dim),
norms AS (SELECT doc_id, sqrt(sum(v * v)) AS norm FROM signed GROUP BY doc_id HAVING sum(v * v) > 0),
asked_norms AS (SELECT item_id, sqrt(sum(v * v)) AS norm FROM asked_signed GROUP BY item_id HAVING sum(v * v) > 0),
dots AS (SELECT item_id, doc_id, sum(q.v * x.v) AS dot FROM asked_signed q JOIN signed x ON x.dim = q.dim GROUP BY item_id, doc_id),
cosines AS (SELECT q.item_id, n.doc_id, round(coalesce(t.dot, 0) / (q.norm * n.norm), 6) AS score FROM asked_norms q CROSS JOIN norms n LEFT JOIN dots t ON t.item_id = q.item_id AND t.doc_id = n.doc_id),
vector AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS place FROM cosines) WHERE place <= 50),
three AS (SELECT item_id, 'segmented' AS channel, 1 AS c, doc_id, place, score FROM segmented UNION ALL SELECT item_id, 'ngram', 2, doc_id, place, score FROM ngram UNION ALL SELECT item_id, 'vector', 3, doc_id, place, score FROM vector),
{mention_edges(d)},
first_met AS (SELECT item_id, doc_id, min(place * 10 + c) AS met, max(11.0::DOUBLE / (10 + place)) AS relevance FROM three GROUP BY item_id, doc_id),
sown AS (SELECT item_id, topic AS doc_id, 0 AS met, 1.0::DOUBLE AS relevance FROM linked UNION ALL SELECT f.* FROM first_met f WHERE NOT EXISTS (SELECT 1 FROM linked l WHERE l.item_id = f.item_id AND l.topic = f.doc_id)),
seeds AS (SELECT * FROM (SELECT item_id, doc_id AS topic, relevance, row_number() OVER (PARTITION BY item_id ORDER BY met, doc_id) AS seed FROM sown) WHERE seed <= 64),
one AS (SELECT DISTINCT item_id, topic AS origin, b AS node, seed FROM seeds JOIN mention_ends ON a = topic),
near AS (SELECT item_id, node, min(seed) AS seed FROM one GROUP BY item_id, node),
front AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY seed, node) AS line FROM one) WHERE line <= 2000 AND item_id IN (SELECT item_id FROM near GROUP BY item_id HAVING count(*) < 50)),
two AS (SELECT f.item_id, f.origin, f.node AS via, e.b AS node, min(f.line) AS line FROM front f JOIN mention_ends e ON e.a = f.node
        WHERE e.b <> f.origin AND NOT EXISTS (SELECT 1 FROM one o WHERE o.item_id = f.item_id AND o.node = e.b AND o.origin = f.origin) GROUP BY f.item_id, f.origin, f.node, e.b),
far AS (SELECT item_id, node, min_by(origin, line) AS origin, min_by(via, line) AS via FROM two t WHERE NOT EXISTS (SELECT 1 FROM near n WHERE n.item_id = t.item_id AND n.node = t.node) GROUP BY item_id, node),
arrived AS (SELECT n.item_id, s.topic AS origin, s.topic AS via, n.node, 1 AS hops FROM near n JOIN seeds s ON s.item_id = n.item_id AND s.seed = n.seed UNION ALL SELECT item_id, origin, via, node, 2 FROM far),
worths AS (SELECT a.item_id, a.node AS doc_id, a.via, round(0.5::DOUBLE * power(0.5::DOUBLE, a.hops - 1) * s.relevance, 6) AS score FROM arrived a JOIN seeds s ON s.item_id = a.item_id AND s.topic = a.origin),
graph AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS place FROM worths) WHERE place <= 50),
lists AS (SELECT item_id, channel, doc_id, place, score, NULL::BIGINT AS via FROM three UNION ALL SELECT item_id, 'graph', doc_id, place, score, via FROM graph)"""


def mention_edges(d) -> str:
    """CTEs mention_ends (each edge from both ends) and linked (documents that a question names by their first two words)."""
    return f"""
m_words AS ({d.tokens('documents', 'doc_id', 'text')}),
m_runs AS (SELECT doc_id, pos, term || ' ' || lead(term, 1) OVER w AS pair, term || ' ' || lead(term, 1) OVER w || ' ' || lead(term, 2) OVER w AS run FROM m_words WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
mention AS (SELECT DISTINCT r.doc_id AS src, n.doc_id AS dst FROM m_runs r JOIN m_runs n ON n.pos = 0 AND n.run = r.run WHERE r.doc_id <> n.doc_id),
mention_ends AS (SELECT src AS a, dst AS b FROM mention UNION SELECT dst AS a, src AS b FROM mention),
m_asked AS (SELECT item_id, term || ' ' || lead(term, 1) OVER (PARTITION BY item_id ORDER BY pos) AS pair FROM ({d.tokens('benchmark', 'item_id', 'text')})),
linked AS (SELECT DISTINCT q.item_id, n.doc_id AS topic FROM m_asked q JOIN m_runs n ON n.pos = 0 AND n.pair = q.pair)"""


def fused(d, shares: str = "banded") -> str:
    """CTE fused: banded shares by default, reciprocal ones on a flat list or when asked for; the graph's scores are calibrated."""
    weight = " ".join(f"WHEN '{c}' THEN {w}" for c, w in WEIGHTS.items())
    flat = f"1.0::DOUBLE / ({K} + place)"
    floor = f"(({K} + 1.0::DOUBLE) / ({K} + n))"
    within = "CASE WHEN channel = 'graph' THEN least(greatest(score, 0), 1) ELSE (score - lo) / (hi - lo) END"
    band = f"CASE WHEN channel = 'graph' OR hi - lo > 1.2e-7 THEN ({floor} + (1 - {floor}) * ({within})) / ({K} + 1) ELSE {flat} END"
    return f"""{lists(d)},
ranged AS (SELECT *, min(score) OVER (PARTITION BY item_id, channel) AS lo, max(score) OVER (PARTITION BY item_id, channel) AS hi, count(*) OVER (PARTITION BY item_id, channel) AS n FROM lists),
shared AS (SELECT item_id, channel, doc_id, place, score, via, CAST(CASE channel {weight} END AS DOUBLE) * {band if shares == 'banded' else flat} AS part FROM ranged),
summed AS (SELECT item_id, doc_id, round(sum(part), 9) AS score, count(*) AS channels FROM shared GROUP BY item_id, doc_id),
fused AS (SELECT item_id, doc_id, score, channels, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS place FROM summed)"""


def reranked(d) -> str:
    """CTE placed: the head of 30 and at most four strong finds of the graph alone, blended with the number of asked words in the text, in front."""
    return f"""{fused(d)},
alone AS (SELECT item_id, doc_id, max(score) AS score, max(via) AS via FROM shared GROUP BY item_id, doc_id HAVING bool_and(channel = 'graph')),
finds AS (SELECT f.item_id, f.doc_id, f.place, a.score / sqrt(count(*) OVER (PARTITION BY f.item_id, a.via)) AS worth FROM fused f JOIN alone a ON a.item_id = f.item_id AND a.doc_id = f.doc_id WHERE f.place > 30 AND a.score >= 0.5),
below AS (SELECT item_id, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY worth DESC, place) AS n FROM finds) WHERE n <= 4),
chosen AS (SELECT f.* FROM fused f WHERE f.place <= 30 UNION ALL SELECT f.* FROM fused f JOIN below b ON b.item_id = f.item_id AND b.doc_id = f.doc_id),
hit AS (SELECT q.item_id, t.doc_id, CAST(count(*) AS DOUBLE) AS hits FROM segmented_q q JOIN segmented_tf t ON q.term = t.term GROUP BY q.item_id, t.doc_id),
head AS (SELECT f.item_id, f.doc_id, f.place, f.score, coalesce(h.hits, 0) AS model FROM chosen f LEFT JOIN hit h ON h.item_id = f.item_id AND h.doc_id = f.doc_id),
scaled AS (SELECT *, min(score) OVER w AS flo, max(score) OVER w AS fhi, min(model) OVER w AS mlo, max(model) OVER w AS mhi, count(*) OVER w AS many FROM head WINDOW w AS (PARTITION BY item_id)),
blended AS (SELECT item_id, doc_id, round(0.2::DOUBLE * CASE WHEN fhi > flo THEN (score - flo) / (fhi - flo) ELSE 0 END + 0.8::DOUBLE * CASE WHEN mhi > mlo THEN (model - mlo) / (mhi - mlo) ELSE 0 END, 6) AS blend FROM scaled WHERE many > 1),
placed AS (SELECT f.item_id, f.doc_id, f.place AS fused_place, b.blend, row_number() OVER (PARTITION BY f.item_id ORDER BY b.blend IS NULL, b.blend DESC, f.place) AS place FROM fused f LEFT JOIN blended b ON b.item_id = f.item_id AND b.doc_id = f.doc_id)"""


#: Relevant are the documents that hold the passage whole.
def qrels(d) -> str:
    """A passage's first words are looked up as an equal run first, so no passage meets every document."""
    return f"""
doc_words AS ({d.tokens('documents', 'doc_id', 'text')}),
doc_runs AS (SELECT doc_id, term || ' ' || lead(term, 1) OVER w || ' ' || lead(term, 2) OVER w || ' ' || lead(term, 3) OVER w AS run FROM doc_words WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
item_words AS ({d.tokens('benchmark', 'item_id', 'text')}),
item_runs AS (SELECT item_id, pos, term || ' ' || lead(term, 1) OVER w || ' ' || lead(term, 2) OVER w || ' ' || lead(term, 3) OVER w AS run FROM item_words WINDOW w AS (PARTITION BY item_id ORDER BY pos)),
maybe AS (SELECT DISTINCT i.item_id, r.doc_id FROM item_runs i JOIN doc_runs r ON r.run = i.run WHERE i.pos = 0),
qrels AS (SELECT m.item_id, m.doc_id FROM maybe m JOIN benchmark b ON b.item_id = m.item_id JOIN documents d ON d.doc_id = m.doc_id WHERE contains(d.text, b.text))"""


def spans(d) -> str:
    return f"""words AS ({d.tokens('documents', 'doc_id', 'text')}),
spans AS (SELECT doc_id, CAST(floor(pos / 200) AS BIGINT) AS ordinal, count(*) AS tokens, min(pos) AS first_token, max(pos) AS last_token FROM words GROUP BY doc_id, CAST(floor(pos / 200) AS BIGINT))"""


QUERIES = {
    "bm25_segmented": lambda d: f"WITH {segmented(d)} SELECT item_id, doc_id, score, CAST(place AS BIGINT) AS place FROM segmented",
    "bm25_ngram": lambda d: f"WITH {ngram(d)} SELECT item_id, doc_id, score, CAST(place AS BIGINT) AS place FROM ngram",
    "and_probe": lambda d: f"""WITH asked AS (SELECT DISTINCT item_id, term FROM ({d.tokens('benchmark', 'item_id', 'text')}) q), wanted AS (SELECT item_id, count(*) AS n FROM asked GROUP BY item_id),
has AS (SELECT DISTINCT doc_id, term FROM ({d.tokens('documents', 'doc_id', 'text')}) t WHERE term IN (SELECT term FROM asked))
SELECT a.item_id, h.doc_id FROM asked a JOIN has h ON h.term = a.term JOIN wanted w ON w.item_id = a.item_id GROUP BY a.item_id, h.doc_id, w.n HAVING count(*) = w.n""",
    # every vector whose id is divisible by 50, against all
    "vector_topk": lambda d: f"""WITH v AS (SELECT vec_id, embedding, sqrt({d.dot('embedding', 'embedding')}) AS norm FROM embeddings),
scored AS (SELECT q.vec_id AS query_id, v.vec_id, round(CASE WHEN q.norm * v.norm > 0 THEN {d.dot('q.embedding', 'v.embedding')} / (q.norm * v.norm) ELSE 0 END, 6) AS cosine FROM (SELECT * FROM v WHERE vec_id % 50 = 0) q, v WHERE q.vec_id <> v.vec_id)
SELECT query_id, vec_id, cosine, CAST(place AS BIGINT) AS place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, vec_id) AS place FROM scored) r WHERE place <= 50""",
    "fusion_reciprocal": lambda d: f"WITH {fused(d, 'reciprocal')} SELECT item_id, doc_id, round(score, 6) AS score, CAST(channels AS BIGINT) AS channels FROM fused",
    "fusion_banded": lambda d: f"WITH {fused(d)} SELECT item_id, doc_id, round(score, 6) AS score, CAST(channels AS BIGINT) AS channels FROM fused",
    "search_fused": lambda d: f"WITH {fused(d)} SELECT item_id, doc_id, round(score, 6) AS score, CAST(place AS BIGINT) AS place FROM fused WHERE place <= 10",
    "search_reranked": lambda d: f"WITH {reranked(d)} SELECT item_id, doc_id, CAST(fused_place AS BIGINT) AS fused_place, blend, CAST(place AS BIGINT) AS place FROM placed WHERE place <= 10",
    "why_trace": lambda d: f"""WITH {fused(d)} SELECT item_id, doc_id, string_agg(channel, ' ' ORDER BY CASE channel WHEN 'segmented' THEN 1 WHEN 'ngram' THEN 2 WHEN 'vector' THEN 3 ELSE 4 END) AS channels, CAST(min(place) AS BIGINT) AS best_place, max(via) AS via, round(sum(part), 6) AS score FROM shared GROUP BY item_id, doc_id""",
    "channel_leave_one_out": lambda d: f"""WITH {fused(d)} SELECT s.item_id, x.dropped, s.doc_id, round(sum(s.part), 6) AS score FROM shared s JOIN (SELECT 'segmented' AS dropped UNION ALL SELECT 'ngram' UNION ALL SELECT 'vector' UNION ALL SELECT 'graph') x ON s.channel <> x.dropped GROUP BY s.item_id, x.dropped, s.doc_id""",
    "seed_interleave": lambda d: f"WITH {lists(d)} SELECT item_id, topic AS doc_id, round(relevance, 6) AS relevance, CAST(seed AS BIGINT) AS seed FROM seeds",
    "graph_recall": lambda d: f"WITH {lists(d)} SELECT item_id, doc_id, via, score, CAST(place AS BIGINT) AS place FROM graph",
    "vector_recall": lambda d: f"WITH {lists(d)} SELECT item_id, doc_id, score, CAST(place AS BIGINT) AS place FROM vector",
    "span_windows": lambda d: f"WITH {spans(d)} SELECT doc_id, ordinal, CAST(tokens AS BIGINT) AS tokens, CAST(first_token AS BIGINT) AS first_token, CAST(last_token AS BIGINT) AS last_token FROM spans",
    "best_span_collapse": lambda d: f"""WITH words AS ({d.tokens('documents', 'doc_id', 'text')}), asked AS (SELECT DISTINCT item_id, term FROM ({d.tokens('benchmark', 'item_id', 'text')}) q),
hits AS (SELECT item_id, doc_id, CAST(floor(pos / 200) AS BIGINT) AS span, count(*) AS votes FROM words w JOIN asked a ON a.term = w.term GROUP BY item_id, doc_id, CAST(floor(pos / 200) AS BIGINT))
SELECT item_id, doc_id, span, CAST(votes AS BIGINT) AS votes FROM (SELECT *, row_number() OVER (PARTITION BY item_id, doc_id ORDER BY votes DESC, span) AS n FROM hits) r WHERE n = 1""",
    "topics_name_or_content": lambda d: f"""WITH {segmented(d)},{mention_edges(d)}
SELECT coalesce(n.item_id, c.item_id) AS item_id, coalesce(n.topic, c.doc_id) AS doc_id, CASE WHEN n.topic IS NULL THEN 'content' WHEN c.doc_id IS NULL THEN 'name' ELSE 'both' END AS found_by FROM linked n FULL OUTER JOIN segmented c ON c.item_id = n.item_id AND c.doc_id = n.topic""",
    "shingle_jaccard": lambda d: f"""WITH words AS ({d.tokens('conversations', 'conv_id, turn', 'text')}), sh AS (SELECT DISTINCT conv_id, turn, term || ' ' || t2 || ' ' || t3 AS s FROM (SELECT conv_id, turn, term, lead(term, 1) OVER w AS t2, lead(term, 2) OVER w AS t3 FROM words WINDOW w AS (PARTITION BY conv_id, turn ORDER BY pos)) x WHERE t3 IS NOT NULL),
n AS (SELECT conv_id, turn, count(*) AS n FROM sh GROUP BY conv_id, turn), met AS (SELECT a.conv_id, a.turn AS x, b.turn AS y, count(*) AS n FROM sh a JOIN sh b ON a.conv_id = b.conv_id AND a.s = b.s AND a.turn < b.turn GROUP BY a.conv_id, a.turn, b.turn)
SELECT b.conv_id, b.x, b.y, round(CAST(b.n AS DOUBLE) / (p.n + q.n - b.n), 6) AS jaccard FROM met b JOIN n p ON p.conv_id = b.conv_id AND p.turn = b.x JOIN n q ON q.conv_id = b.conv_id AND q.turn = b.y""",
    "gone_sections": lambda d: f"WITH h AS ({d.headings()}), now AS (SELECT title FROM h WHERE page_id % 2 = 0) SELECT DISTINCT h.title FROM h WHERE page_id % 2 = 1 AND NOT EXISTS (SELECT 1 FROM now WHERE now.title = h.title)",
    "rendered_passages": lambda d: f"SELECT doc_id, lang || ': ' || text AS passage, {d.octets('text')} AS bytes, {d.sha('text')} AS content_hash FROM documents",
    "ndcg10": lambda d: f"""WITH {fused(d)}, {qrels(d)}, judged AS (SELECT item_id, count(*) AS relevant FROM qrels GROUP BY item_id),
gained AS (SELECT f.item_id, sum(1 / log2(f.place + 1)) AS dcg FROM fused f JOIN qrels r ON r.item_id = f.item_id AND r.doc_id = f.doc_id WHERE f.place <= 10 GROUP BY f.item_id),
steps AS (SELECT item_id, {d.series('least(relevant, 10) - 1')} AS i FROM judged), ideal AS (SELECT item_id, sum(1 / log2(i + 2)) AS best FROM steps GROUP BY item_id)
SELECT b.item_id, round(coalesce(g.dcg / i.best, 0), 6) AS ndcg FROM benchmark b LEFT JOIN gained g ON g.item_id = b.item_id LEFT JOIN ideal i ON i.item_id = b.item_id""",
    "recall50": lambda d: f"""WITH {fused(d)}, {qrels(d)} SELECT q.item_id, CAST(count(*) AS BIGINT) AS judged, CAST(count_if(f.place <= 50) AS BIGINT) AS found, CAST(count_if(f.place BETWEEN 11 AND 50) AS BIGINT) AS deep FROM qrels q LEFT JOIN fused f ON f.item_id = q.item_id AND f.doc_id = q.doc_id GROUP BY q.item_id""",
    "recall_any_all": lambda d: f"""WITH {fused(d)}, {qrels(d)}, hits AS (SELECT q.item_id, max(CASE WHEN f.place <= 5 THEN 1 ELSE 0 END) AS any5, min(CASE WHEN f.place <= 5 THEN 1 ELSE 0 END) AS all5 FROM qrels q LEFT JOIN fused f ON f.item_id = q.item_id AND f.doc_id = q.doc_id GROUP BY q.item_id)
SELECT CAST(count(*) AS BIGINT) AS queries, round(avg(any5), 6) AS recall_any, round(avg(all5), 6) AS recall_all FROM hits""",
    "kendall_agreement": lambda d: f"""WITH {lists(d)}, met AS (SELECT s.item_id, s.doc_id, s.place AS x, n.place AS y FROM segmented s JOIN ngram n ON n.item_id = s.item_id AND n.doc_id = s.doc_id),
pairs AS (SELECT a.item_id, sign(CAST(a.x - b.x AS DOUBLE)) * sign(CAST(a.y - b.y AS DOUBLE)) AS agree FROM met a JOIN met b ON a.item_id = b.item_id AND a.doc_id < b.doc_id)
SELECT item_id, CAST(count(*) AS BIGINT) AS pairs, round(avg(agree), 6) AS agreement FROM pairs GROUP BY item_id""",
}
