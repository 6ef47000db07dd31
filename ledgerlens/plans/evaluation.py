"""Statistics of experiments: verdicts, paired tests, quantiles and samples, from labels, events and orders."""

from __future__ import annotations

QUERIES = {
    # labelled quality against toxicity as two arms: discordant pairs
    "mcnemar_counts": lambda d: "SELECT CAST(count_if(quality = 1 AND toxic = 0) AS BIGINT) AS a_only, CAST(count_if(quality = 0 AND toxic = 1) AS BIGINT) AS b_only, CAST(count_if(quality = toxic) AS BIGINT) AS ties FROM labels",
    # exact: 2 * sum of C(n, i) / 2^n for i up to the smaller side, in logs, by bands of documents
    "mcnemar_exact": lambda d: f"""WITH arms AS (SELECT doc_id % 97 AS unit, count_if(quality = 0) AS a, count_if(toxic = 1) AS b FROM labels GROUP BY doc_id % 97),
steps AS (SELECT unit, a, b, {d.series('CAST(least(a, b) AS BIGINT)')} AS i FROM arms WHERE a + b > 0),
terms AS (SELECT unit, a, b, i, sum(CASE WHEN i = 0 THEN 0 ELSE ln(CAST(a + b - i + 1 AS DOUBLE)) - ln(CAST(i AS DOUBLE)) END) OVER (PARTITION BY unit ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS log_c FROM steps)
SELECT unit, CAST(a AS BIGINT) AS a_only, CAST(b AS BIGINT) AS b_only, round(least(CAST(1 AS DOUBLE), 2 * sum(exp(log_c - CAST(a + b AS DOUBLE) * ln(CAST(2 AS DOUBLE))))), 4) AS p FROM terms GROUP BY unit, a, b""",
    "majority_verdict": lambda d: """WITH votes AS (SELECT user_id AS unit, CASE event_type WHEN 'click' THEN 'stale' WHEN 'view' THEN 'neither' ELSE 'current' END AS verdict, count(*) AS n FROM events GROUP BY 1, 2)
SELECT unit, verdict, round(agreement, 6) AS agreement FROM (SELECT unit, verdict, CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY unit) AS agreement, row_number() OVER (PARTITION BY unit ORDER BY n DESC, CASE verdict WHEN 'stale' THEN 0 WHEN 'neither' THEN 1 ELSE 2 END) AS place FROM votes) v WHERE place = 1""",
    "verdict_shares": lambda d: "SELECT event_type AS verdict, CAST(count(*) AS BIGINT) AS rows_, round(CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM events), 6) AS share FROM events GROUP BY event_type",
    "last_row_per_unit": lambda d: "SELECT user_id, event_type, max(event_id) AS event_id, max_by(value, event_id) AS value FROM events GROUP BY user_id, event_type",
    # exclusive quantiles: m = p (n + 1), between neighbours
    "latency_quantiles": lambda d: """WITH ranked AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events),
asked AS (SELECT 50 AS p UNION ALL SELECT 95), picked AS (SELECT event_type, p, value, i, n, greatest(least(CAST(floor(p * (n + 1) / CAST(100 AS DOUBLE)) AS BIGINT), n - 1), 1) AS j, p * (n + 1) / CAST(100 AS DOUBLE) AS m FROM ranked, asked)
SELECT event_type, CAST(p AS BIGINT) AS p, round(max(CASE WHEN i = j THEN value END) + (max(m) - max(j)) * (max(CASE WHEN i = j + 1 THEN value END) - max(CASE WHEN i = j THEN value END)), 6) AS quantile FROM picked WHERE i IN (j, j + 1) GROUP BY event_type, p""",
    "arm_summary": lambda d: "SELECT o_orderpriority AS arm, CAST(count(*) AS BIGINT) AS n, round(avg(o_totalprice), 4) AS mean, CAST(count_if(o_orderstatus = 'F') AS BIGINT) AS correct FROM orders GROUP BY o_orderpriority",
    "macro_means": lambda d: "SELECT round(avg(m), 4) AS macro_mean, CAST(count(*) AS BIGINT) AS arms FROM (SELECT c_mktsegment, avg(c_acctbal) AS m FROM customer GROUP BY c_mktsegment) g",
    "minimum_detectable": lambda d: "SELECT event_type, CAST(count(*) AS BIGINT) AS n, round((CAST(1.96 AS DOUBLE) + CAST(0.84 AS DOUBLE)) * stddev_samp(value) / sqrt(count(*)), 5) AS detectable FROM events GROUP BY event_type",
    "smallest_p": lambda d: "SELECT user_id, CAST(count(*) AS BIGINT) AS n, round(2 * power(CAST(0.5 AS DOUBLE), least(count(*), 40)), 12) AS smallest_p, 2 * power(CAST(0.5 AS DOUBLE), least(count(*), 40)) < CAST(0.05 AS DOUBLE) AS can_decide FROM events GROUP BY user_id",
    # proportional quotas, members by a seeded hash: larger samples contain smaller ones
    "stratified_sample": lambda d: f"""WITH ordered AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY {d.sha("'7' || CAST(doc_id AS STRING)")}) AS place, count(*) OVER (PARTITION BY lang) AS stratum, count(*) OVER () AS total FROM documents)
SELECT doc_id, lang FROM ordered WHERE place <= greatest(1, CAST(floor(CAST(200 AS DOUBLE) * stratum / total) AS BIGINT))""".replace("count(*) OVER ()", "(SELECT count(*) FROM documents)"),
    "hash_folds": lambda d: "SELECT fold, CAST(count(*) AS BIGINT) AS members, round(avg(c_acctbal), 4) AS mean FROM (SELECT c_acctbal, c_mktsegment, CAST(row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) % 5 AS BIGINT) AS fold FROM customer) f GROUP BY fold",
    # sign-flip randomisation, two-sided: 10,000 draws, whose signs are the bits of seeded hashes of the unit, four to a hex digit
    "paired_differences": lambda d: f"""WITH arms AS (SELECT o_custkey, avg(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END) AS a, avg(CASE WHEN o_orderstatus <> 'F' THEN o_totalprice END) AS b FROM orders GROUP BY o_custkey),
pairs AS (SELECT o_custkey, a - b AS diff FROM arms WHERE a IS NOT NULL AND b IS NOT NULL),
seen AS (SELECT count_if(diff > 1e-9) AS wins, count_if(diff < -1e-9) AS losses, count(*) AS units, sum(diff) AS total FROM pairs),
blocks AS (SELECT diff, block, {d.sha("'7:' || CAST(o_custkey AS STRING) || ':' || CAST(block AS STRING)")} AS bits FROM (SELECT o_custkey, diff, {d.series('39')} AS block FROM pairs) x),
digits AS (SELECT diff, block * 64 + k AS spot, instr('0123456789abcdef', substr(bits, CAST(k + 1 AS INTEGER), 1)) - 1 AS v FROM (SELECT diff, block, bits, {d.series('63')} AS k FROM blocks) x),
flips AS (SELECT spot, {', '.join(f'sum(CASE WHEN (v & {1 << j}) = 0 THEN diff ELSE -diff END) AS s{j}' for j in range(4))} FROM digits WHERE spot < 2500 GROUP BY spot),
far AS (SELECT {' + '.join(f'count_if(round(abs(s{j}), 4) >= round(abs(total), 4))' for j in range(4))} AS extreme FROM flips, seen)
SELECT CAST(wins AS BIGINT) AS wins, CAST(losses AS BIGINT) AS losses, CAST(units - wins - losses AS BIGINT) AS ties, CAST(units AS BIGINT) AS units, round(total / units, 4) AS mean, CASE WHEN units = 0 THEN CAST(1 AS DOUBLE) ELSE round(CAST(extreme + 1 AS DOUBLE) / 10001, 6) END AS p FROM seen, far""",
    "evidence_ids": lambda d: f"SELECT conv_id, turn, {d.digits('text')} AS first_number, 'D' || CAST(conv_id AS STRING) || '_' || CAST(turn AS STRING) AS topic FROM conversations",
    "session_rollup": lambda d: "SELECT conv_id, CAST(min(turn) AS BIGINT) AS best_turn, CAST(count(*) AS BIGINT) AS turns, CAST(count_if(role = 'user') AS BIGINT) AS asked FROM conversations GROUP BY conv_id",
}
