"""Evidence, versions and time: the write path and the reads of one topic's history.

Writes come from events: a topic is a user, the order is the event id, the content is the type with a tenth of its value.
"""

from __future__ import annotations


def chain(d) -> str:
    """CTEs judged (every write with its verdict) and versions (promoted ones, numbered, with validity).

    A restatement equals the last promoted text, which is the last text that was neither empty nor short: a repeat leaves
    the current text as it is, so one lag over those rows decides, without replaying the chain.
    """
    return f"""
w AS (SELECT user_id AS topic, event_id AS seq, ts, event_type || ' ' || CAST(CAST(floor(value / 10) AS BIGINT) AS STRING) AS content FROM events),
n AS (SELECT topic, seq, ts, content, {d.normal('content')} AS norm FROM w),
long_enough AS (SELECT topic, seq, ts, content, norm, lag(norm) OVER (PARTITION BY topic ORDER BY seq) AS before FROM n WHERE length(norm) >= 8),
judged AS (
  SELECT topic, seq, ts, content, CASE WHEN norm = '' THEN 'empty' ELSE 'too_short' END AS reason FROM n WHERE length(norm) < 8
  UNION ALL SELECT topic, seq, ts, content, CASE WHEN norm = before THEN 'restatement' ELSE 'promoted' END AS reason FROM long_enough),
versions AS (
  SELECT topic, seq, ts AS valid_from, content, row_number() OVER (PARTITION BY topic ORDER BY seq) AS version,
         lag(seq) OVER (PARTITION BY topic ORDER BY seq) AS supersedes, lead(ts) OVER (PARTITION BY topic ORDER BY seq) AS valid_to
  FROM judged WHERE reason = 'promoted')"""


QUERIES = {
    "filter_verdict": lambda d: f"WITH {chain(d)} SELECT topic, seq, content, reason FROM judged",
    "evidence_versions": lambda d: f"WITH {chain(d)} SELECT topic, seq, CAST(row_number() OVER (PARTITION BY topic ORDER BY seq) AS BIGINT) AS evidence_version, {d.sha('content')} AS content_hash, reason FROM judged",
    "supersession_chain": lambda d: f"WITH {chain(d)} SELECT topic, seq, CAST(version AS BIGINT) AS version, supersedes, valid_from, valid_to FROM versions",
    "latest_per_topic": lambda d: f"WITH {chain(d)} SELECT topic, CAST(max(version) AS BIGINT) AS version, max_by(content, version) AS content, CAST(count(*) AS BIGINT) AS available FROM versions GROUP BY topic",
    # offsets 0, 1, 4 and 1000 back from the latest, clamped at the oldest live version
    "version_offset_read": lambda d: f"""WITH {chain(d)}, back AS (SELECT topic, version, content, row_number() OVER (PARTITION BY topic ORDER BY version DESC) - 1 AS offset_back, count(*) OVER (PARTITION BY topic) AS available FROM versions),
asked AS (SELECT 0 AS wanted UNION ALL SELECT 1 UNION ALL SELECT 4 UNION ALL SELECT 1000)
SELECT topic, CAST(wanted AS BIGINT) AS wanted, CAST(version AS BIGINT) AS version, CAST(offset_back AS BIGINT) AS actual_offset, offset_back = 0 AS is_current, CAST(available AS BIGINT) AS available, content
FROM asked, back WHERE offset_back = least(wanted, available - 1)""",
    "asof_states": lambda d: f"""WITH {chain(d)}, moment AS (SELECT min(ts) + (max(ts) - min(ts)) / 2 AS t FROM events)
SELECT topic, CAST(version AS BIGINT) AS version, content FROM versions, moment WHERE valid_from <= t AND (valid_to IS NULL OR t < valid_to)""",
    # the newest state of every third topic is deleted: the pointer goes back to the newest survivor
    "soft_delete_repoint": lambda d: f"""WITH {chain(d)}, ends AS (SELECT topic, version, content, max(version) OVER (PARTITION BY topic) AS newest FROM versions)
SELECT topic, CAST(max(version) AS BIGINT) AS version, max_by(content, version) AS content FROM ends WHERE NOT (topic % 3 = 0 AND version = newest) GROUP BY topic""",
    "retired_topics": lambda d: f"WITH {chain(d)} SELECT t.topic, CAST(count(v.topic) AS BIGINT) AS states FROM (SELECT DISTINCT topic FROM judged) t LEFT JOIN versions v ON v.topic = t.topic AND t.topic % 5 <> 0 GROUP BY t.topic",
    # literal and case-folded search over all evidence, filtered and superseded too; the newest 20
    "grep_evidence": lambda d: f"""WITH {chain(d)} SELECT topic, seq, reason, CAST(instr(lower(content), 'click 1') AS BIGINT) AS position, {d.octets("substr(content, 1, instr(lower(content), 'click 1') - 1)")} AS byte_offset
FROM judged WHERE contains(lower(content), 'click 1') ORDER BY ts DESC, seq LIMIT 20""",
    "pointer_repair": lambda d: f"""WITH {chain(d)}, newest AS (SELECT topic, max(version) AS live FROM versions GROUP BY topic), pointer AS (SELECT topic, CASE WHEN topic % 4 = 0 THEN live - 1 ELSE live END AS held FROM newest)
SELECT n.topic, CAST(p.held AS BIGINT) AS held, CAST(n.live AS BIGINT) AS repaired FROM newest n JOIN pointer p ON n.topic = p.topic WHERE n.live IS DISTINCT FROM p.held""",
    "conversation_versions": lambda d: "SELECT conv_id AS topic, turn, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS version, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS supersedes, role FROM conversations",
    "held_content_skip": lambda d: f"""SELECT doc_id, first_id, doc_id > first_id AS skipped FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY {d.sha('text')}) AS first_id FROM documents)""",
    "tenant_rows": lambda d: "SELECT source AS project, CAST(count(*) AS BIGINT) AS topics, CAST(count(DISTINCT lang) AS BIGINT) AS languages, min(doc_id) AS oldest FROM documents GROUP BY source",
    "locator_range": lambda d: "SELECT o_orderkey, 'file:' || o_orderpriority || '/' || CAST(o_orderkey AS STRING) AS locator FROM orders WHERE 'file:' || o_orderpriority >= 'file:1' AND 'file:' || o_orderpriority < 'file:3'",
    "recent_topics": lambda d: "SELECT o_orderkey AS topic, o_orderdate AS created_at FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 20",
    # one due job for each (project, kind, subject); a conflict makes it due at the later time with no attempts
    "job_coalesce": lambda d: "SELECT user_id % 7 AS project, event_type AS kind, user_id AS subject, max(ts) AS available_at, CAST(count(*) AS BIGINT) AS folded FROM events GROUP BY user_id % 7, event_type, user_id",
    "job_claim_order": lambda d: """WITH jobs AS (SELECT user_id AS subject, event_type AS kind, max(ts) AS available_at, min(CASE event_type WHEN 'click' THEN 10 WHEN 'view' THEN 20 WHEN 'purchase' THEN 50 ELSE 100 END) AS priority, max(event_id) % 10 AS attempts FROM events GROUP BY user_id, event_type)
SELECT subject, kind, CAST(priority AS BIGINT) AS priority, attempts + 1 AS attempts, CAST(claim AS BIGINT) AS claim FROM (SELECT *, row_number() OVER (ORDER BY priority, available_at, subject, kind) AS claim FROM jobs WHERE attempts < 8) WHERE claim <= 64""",
    "job_retry_state": lambda d: "SELECT event_id, event_id % 11 AS attempts, CASE WHEN event_id % 11 >= 8 THEN 'exhausted' WHEN event_id % 3 = 0 THEN 'retry' ELSE 'due' END AS state, ts + INTERVAL '1' HOUR AS retry_at FROM events",
    "upsert_latest": lambda d: "SELECT file, part, size, read_no FROM (SELECT l_orderkey AS file, l_partkey AS part, l_quantity AS size, CAST(l_linenumber AS BIGINT) AS read_no, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_shipdate DESC, l_partkey, l_suppkey, l_quantity) AS n FROM lineitem) r WHERE n = 1",
    "insert_if_absent": lambda d: "SELECT c.c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'F')",
    "trusted_files": lambda d: "SELECT o_orderkey, o_totalprice, NOT (prev IS DISTINCT FROM o_totalprice) AS same FROM (SELECT o_orderkey, o_totalprice, lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS prev FROM orders)",
    "bounded_count": lambda d: "SELECT CAST(count(*) AS BIGINT) AS pending, count(*) < 10000 AS may_defer FROM (SELECT event_id FROM events LIMIT 10000) j",
    "session_debounce": lambda d: f"""WITH gaps AS (SELECT user_id, event_id, ts, {d.seconds('ts')} - {d.seconds('lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)')} AS gap FROM events),
marked AS (SELECT user_id, event_id, ts, sum(CASE WHEN gap IS NULL OR gap > 3600 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS session FROM gaps)
SELECT user_id, CAST(session AS BIGINT) AS session, min(ts) AS opened, max(ts) AS closed, CAST(count(*) AS BIGINT) AS events FROM marked GROUP BY user_id, session""",
}
