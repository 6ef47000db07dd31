"""Versioned relationships: assertion, as-of reading, retraction, strongest edges and the bounded walk.

Edges come from lineitem: part to supplier (suppliers negative), each shipment a claim whose confidence is its share of 50 pieces.
"""

from __future__ import annotations

VERSIONS = """
claims AS (SELECT l_partkey AS src, -l_suppkey AS dst, l_shipdate AS created_at, l_orderkey AS o, l_linenumber AS i, round(l_quantity / 50, 2) AS confidence FROM lineitem),
told AS (SELECT *, lag(confidence) OVER (PARTITION BY src, dst ORDER BY created_at, o, i) AS before FROM claims),
edge_versions AS (SELECT src, dst, created_at, confidence, row_number() OVER (PARTITION BY src, dst ORDER BY created_at, o, i) AS version,
                         lead(created_at) OVER (PARTITION BY src, dst ORDER BY created_at, o, i) AS invalidated_at FROM told WHERE before IS DISTINCT FROM confidence),
live AS (SELECT src, dst, confidence FROM edge_versions WHERE invalidated_at IS NULL),
ends AS (SELECT src AS a, dst AS b, confidence FROM live UNION ALL SELECT dst AS a, src AS b, confidence FROM live)"""

def hops(depth: int) -> str:
    """CTEs hop1.. and walk: from every part whose key is divisible by 50. A node is met once, by the first step of the frontier that crosses to it."""
    out = f"""{VERSIONS},
hop1 AS (SELECT p_partkey AS origin, p_partkey AS via, b AS node, confidence, row_number() OVER (PARTITION BY p_partkey ORDER BY confidence DESC, b) AS line FROM part JOIN (SELECT DISTINCT a, b, confidence FROM ends) e ON a = p_partkey WHERE p_partkey % 50 = 0),
walk1 AS (SELECT origin, via, node, 1 AS hops, confidence FROM hop1)"""
    for h in range(2, depth + 1):
        out += f""",
met{h} AS (SELECT f.origin, f.node AS via, e.b AS node, e.confidence, row_number() OVER (PARTITION BY f.origin, e.b ORDER BY f.line, e.confidence DESC) AS n, f.line AS pos
          FROM hop{h - 1} f JOIN ends e ON e.a = f.node WHERE f.line <= 2000 AND e.b <> f.origin AND e.b <> f.via AND NOT EXISTS (SELECT 1 FROM walk{h - 1} w WHERE w.origin = f.origin AND w.node = e.b)),
hop{h} AS (SELECT origin, via, node, confidence, row_number() OVER (PARTITION BY origin ORDER BY confidence DESC, pos, node) AS line FROM met{h} WHERE n = 1),
walk{h} AS (SELECT * FROM walk{h - 1} UNION ALL SELECT origin, via, node, {h} AS hops, confidence FROM hop{h})"""
    return f"{out}, walk AS (SELECT * FROM walk{depth})"


WALK = hops(2)

NAMES = lambda d: f"""
words AS ({d.tokens('documents', 'doc_id', 'text')}),
runs AS (SELECT doc_id, pos, term || ' ' || lead(term, 1) OVER (PARTITION BY doc_id ORDER BY pos) || ' ' || lead(term, 2) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM words),
names AS (SELECT doc_id AS topic, run AS name FROM runs WHERE pos = 0 AND run IS NOT NULL)"""  # noqa: E731

QUERIES = {
    "edge_versions": lambda d: f"WITH {VERSIONS} SELECT src, dst, CAST(version AS BIGINT) AS version, created_at, invalidated_at, CASE WHEN invalidated_at IS NOT NULL THEN 'superseded' END AS tombstone, confidence FROM edge_versions",
    # superseded versions never held; the last version is closed at 90 days for every seventh supplier
    "edges_asof": lambda d: f"""WITH {VERSIONS}, marked AS (SELECT *, CASE WHEN invalidated_at IS NOT NULL THEN 'superseded' WHEN dst % 7 = 0 THEN 'closed' WHEN dst % 11 = 0 THEN 'deleted' END AS tombstone, coalesce(invalidated_at, created_at + INTERVAL '90' DAY) AS ended FROM edge_versions),
moment AS (SELECT min(l_shipdate) + (max(l_shipdate) - min(l_shipdate)) / 2 AS t FROM lineitem)
SELECT src, dst, CAST(version AS BIGINT) AS version, confidence FROM marked, moment WHERE created_at <= t AND (tombstone IS NULL OR (tombstone = 'closed' AND t < ended))""",
    # edges no longer implied by what is kept: shipments of the second half of the orders
    "edge_retract": lambda d: f"WITH {VERSIONS}, kept AS (SELECT DISTINCT l_partkey AS src, -l_suppkey AS dst FROM lineitem WHERE l_orderkey % 2 = 0) SELECT l.src, l.dst, 'closed' AS reason FROM live l WHERE NOT EXISTS (SELECT 1 FROM kept k WHERE k.src = l.src AND k.dst = l.dst)",
    "edge_assert": lambda d: f"WITH {VERSIONS} SELECT src, dst, CAST(count(*) AS BIGINT) AS claims, CAST(count_if(before IS DISTINCT FROM confidence) AS BIGINT) AS appended FROM told GROUP BY src, dst",
    "lateral_topk_edges": lambda d: f"WITH {VERSIONS} SELECT a, b, confidence, CAST(n AS BIGINT) AS place FROM (SELECT a, b, confidence, row_number() OVER (PARTITION BY a ORDER BY confidence DESC, b) AS n FROM ends) WHERE n <= 5",
    "endpoint_union_join": lambda d: f"WITH {VERSIONS}, front AS (SELECT s_suppkey AS k FROM supplier) SELECT DISTINCT src, dst, confidence FROM (SELECT l.* FROM live l JOIN front f ON l.src = f.k UNION ALL SELECT l.* FROM live l JOIN front f ON l.dst = -f.k)",
    "graph_walk_2hop": lambda d: f"WITH {WALK} SELECT origin, node, via, CAST(hops AS BIGINT) AS hops, round(confidence, 6) AS confidence FROM walk",
    "graph_walk_4hop": lambda d: f"WITH {hops(4)} SELECT origin, node, via, CAST(hops AS BIGINT) AS hops, round(confidence, 6) AS confidence FROM walk",
    "graph_channel": lambda d: f"WITH {WALK} SELECT origin, node, round(worth, 6) AS worth, CAST(place AS BIGINT) AS place FROM (SELECT origin, node, confidence * power(0.5D, hops - 1) AS worth, row_number() OVER (PARTITION BY origin ORDER BY round(confidence * power(0.5D, hops - 1), 6) DESC, node) AS place FROM walk) WHERE place <= 50".replace("0.5D", "CAST(0.5 AS DOUBLE)"),
    "walk_summary": lambda d: f"WITH {WALK} SELECT origin, CAST(count(*) AS BIGINT) AS reached, CAST(count_if(hops = 1) AS BIGINT) AS near, round(max(confidence), 6) AS best FROM walk GROUP BY origin",
    "name_runs_join": lambda d: f"WITH {NAMES(d)} SELECT r.doc_id AS src, n.topic AS dst, CAST(count(*) AS BIGINT) AS mentions FROM runs r JOIN names n ON r.run = n.name WHERE r.doc_id <> n.topic GROUP BY r.doc_id, n.topic",
    # names of two words here: passages seldom hold three words of a document's beginning
    "entity_linking": lambda d: f"""WITH {NAMES(d)}, pair_names AS (SELECT doc_id AS topic, term || ' ' || after AS name FROM (SELECT doc_id, pos, term, lead(term) OVER (PARTITION BY doc_id ORDER BY pos) AS after FROM words) x WHERE pos = 0 AND after IS NOT NULL),
asked AS ({d.tokens('benchmark', 'item_id', 'text')}), asked_runs AS (SELECT item_id, term || ' ' || lead(term, 1) OVER (PARTITION BY item_id ORDER BY pos) AS run FROM asked)
SELECT DISTINCT a.item_id, n.topic FROM asked_runs a JOIN pair_names n ON a.run = n.name""",
    "cooccurrence_edges": lambda d: """WITH bought AS (SELECT DISTINCT l_orderkey AS o, l_partkey AS p FROM lineitem), spread AS (SELECT p, count(*) AS n FROM bought GROUP BY p),
pairs AS (SELECT x.p AS a, y.p AS b, x.o AS o FROM bought x JOIN bought y ON x.o = y.o AND x.p < y.p)
SELECT a, b, CAST(count(*) AS BIGINT) AS shared, round(sum(1.0 / (sa.n + sb.n)), 6) AS weight FROM pairs JOIN spread sa ON sa.p = a JOIN spread sb ON sb.p = b GROUP BY a, b""".replace("1.0 /", "CAST(1 AS DOUBLE) /"),
    "part_of_parent": lambda d: f"WITH h AS ({d.headings()}) SELECT page_id, CAST(pos AS BIGINT) AS pos, title, first_value(title) OVER (PARTITION BY page_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS parent FROM h",
    "hub_sharing": lambda d: f"WITH {WALK} SELECT origin, via, node, round(round(confidence * power(CAST(0.5 AS DOUBLE), hops - 1), 6) / sqrt(count(*) OVER (PARTITION BY origin, via)), 6) AS share FROM walk",
    "alias_lookup": lambda d: "SELECT s_suppkey AS topic, s_name AS name, CASE WHEN EXISTS (SELECT 1 FROM customer c WHERE c.c_name = s.s_name) THEN 'shadowed' ELSE 'alias' END AS kind FROM supplier s",
}
