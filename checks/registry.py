"""Registration of checks and the common table expressions their SQL shares."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# The same fixtures as offsetlake.fixtures, written for the SQL side. ``part`` and ``off`` stand
# for the reserved words.
COMMON = """
WITH RECURSIVE
log AS (
  SELECT 'events.input' AS topic, CAST(event_id % 3 AS INT) AS part, event_id // 3 AS off,
         event_id AS id, ts, user_id AS owner, event_type AS kind,
         CASE WHEN event_id % 101 = 0 THEN substr(props, 1, length(props) - 1)
              ELSE props END AS payload
  FROM events
  UNION ALL
  SELECT 'orders.input', CAST(o_orderkey % 2 AS INT), o_orderkey // 2, o_orderkey,
         o_orderdate, o_custkey, o_orderstatus, '{"k": 1}'
  FROM orders),
pipelines(connector, topic, partitions, tab) AS (
  VALUES ('records', 'events.input', 3, 'records'),
         ('records-secondary', 'orders.input', 2, 'records'),
         ('other', 'other.input', 1, 'other_records')),
parts AS (
  SELECT connector, topic, tab, CAST(unnest(range(partitions)) AS INT) AS part FROM pipelines),
done AS (SELECT * FROM log WHERE ts < TIMESTAMP '2024-01-25'),
ledger AS (
  SELECT topic, part, 'b-' || (off // 100) AS batch_id, min(off) AS min_offset,
         max(off) AS max_offset, count(*) AS n, 'AFTER_PROCESSING' AS state
  FROM done GROUP BY ALL),
exact AS (
  SELECT p.connector, p.tab, p.topic, p.part, coalesce(max(l.max_offset) + 1, 0) AS off
  FROM parts p LEFT JOIN ledger l ON l.topic = p.topic AND l.part = p.part GROUP BY ALL),
cuts AS (
  SELECT d, topic, part, CASE WHEN topic = 'events.input'
         THEN coalesce(max(off) FILTER (WHERE ts < TIMESTAMP '2024-01-01' + to_days(d - 1)) + 1, 0)
         ELSE (max(off) + 1) * d // 30 END AS off
  FROM log, (VALUES (2), (3), (5), (10), (15), (20), (28)) AS days(d) GROUP BY d, topic, part),
bounds AS (
  SELECT c.topic, c.part, c.off AS low, h.high
  FROM cuts c JOIN (SELECT topic, part, max(off) + 1 AS high FROM log GROUP BY ALL) h USING (topic, part) WHERE c.d = 3),
committed AS (
  SELECT * FROM log WHERE (id // 50) % 11 <> 5),
good AS (
  SELECT *, CAST(regexp_extract(payload, '"k": ([0-9]+)', 1) AS INT) AS k FROM log
  WHERE topic = 'orders.input' OR id % 101 <> 0),
at05 AS (SELECT topic, part, off FROM cuts WHERE d = 5),
at28 AS (SELECT topic, part, off FROM cuts WHERE d = 28),
ckpt AS (
  SELECT CASE WHEN topic = 'events.input' THEN id // 500 ELSE id // 750 END AS run,
         topic, part, max(off) + 1 AS off
  FROM log GROUP BY ALL),
runs AS (
  SELECT run, 'run-' || run AS backup_id, run % 3 AS position, 'run-' || (run - run % 3) AS chain_id,
         CASE WHEN run % 3 > 0 THEN 'incremental' ELSE 'full' END AS kind,
         CASE WHEN run % 3 > 0 THEN 'run-' || (run - 1) END AS parent_id,
         strftime(TIMESTAMP '2024-01-01' + to_days(CAST(run AS INT)), '%Y-%m-%dT%H:%M:%SZ') AS created_at
  FROM (SELECT DISTINCT run FROM ckpt)),
records AS (
  SELECT run * 2 AS log_offset, backup_id AS key, created_at, false AS gone FROM runs
  UNION ALL SELECT run * 2 + 1, 'chain-state', NULL, false FROM runs
  UNION ALL SELECT run * 2 + 1000000000, backup_id, 'again', false FROM runs WHERE run % 5 = 0
  UNION ALL SELECT run * 2 + 2000000000, backup_id, NULL, true FROM runs WHERE run % 7 = 3),
latest AS (
  SELECT key, log_offset, created_at FROM records
  QUALIFY row_number() OVER (PARTITION BY key ORDER BY log_offset DESC) = 1 AND NOT gone),
firsts AS (SELECT user_id, min(event_id) AS first_id FROM events GROUP BY user_id),
lease AS (
  SELECT e.user_id AS token, e.event_type AS connector, e.ts, e.event_id = f.first_id AS pause,
         e.event_id <> f.first_id AND e.event_id % 53 = 0 AS resume,
         lag(e.ts) OVER (PARTITION BY e.user_id ORDER BY e.ts, e.event_id) AS before
  FROM events e JOIN firsts f USING (user_id)),
lease_ends AS (
  SELECT *, CASE WHEN ts - before >= INTERVAL 6 HOUR THEN before + INTERVAL 6 HOUR
                 WHEN resume THEN ts END AS ending,
         coalesce(ts - before >= INTERVAL 6 HOUR, false) AS gap
  FROM lease),
sessions AS (
  SELECT token, min(ts) AS s,
         max(connector) FILTER (WHERE pause) AS connector,
         coalesce(arg_min(ending, ts) FILTER (WHERE ending IS NOT NULL),
                  max(ts) + INTERVAL 6 HOUR) AS e,
         CASE WHEN NOT arg_min(gap, ts) FILTER (WHERE ending IS NOT NULL)
              THEN 'resumed' ELSE 'expired' END AS ended_by
  FROM lease_ends GROUP BY token)
"""


def until(day: int, rows: str = "good") -> str:
    """SQL rows of the log below the cut of a day."""
    return f"SELECT l.* FROM {rows} l JOIN cuts c ON c.topic = l.topic AND c.part = l.part AND c.d = {day} WHERE l.off < c.off"


def check(name: str, sql: str | None = None):
    def register(query):
        QUERIES[name] = query
        if sql is not None:
            ORACLES[name] = COMMON + sql
        return query

    return register
