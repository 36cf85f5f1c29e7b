"""Log scans, offset vectors, ledgers and their audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import check
from offsetlake import fixtures as fx
from offsetlake import schemas
from offsetlake.operators import audit, bounds, ledger, snapshot
from offsetlake.sources import compaction, storage, zones
from offsetlake.sources import log as logs
from offsetlake.sources import table as tables

POSITION = ["topic", "partition", "offset"]


def events_log(spark, sf):
    return fx.wide_log(spark, sf).filter(F.col("topic") == fx.EVENTS)


def committed_log(spark, sf):
    """Both topics in transactions of 50 records; every eleventh of a topic was aborted."""
    number = F.expr("id div 50")
    rows = fx.wide_log(spark, sf).withColumn("txn", F.concat_ws("/", "topic", number.cast("string")))
    aborted = rows.filter(number % 11 == 5).select("txn")
    return logs.read_committed(rows, aborted, "txn")


def ledger_vector(spark, sf):
    return ledger.exact_offsets(fx.pipelines(spark), ledger.fold_ledger(fx.ledger(spark, sf)))


@check(
    "log_scan",
    """SELECT topic, part AS "partition", off AS "offset", CAST(id AS VARCHAR) AS "key",
              payload AS "value", ts AS "timestamp", kind
       FROM log WHERE topic = 'events.input'""",
)
def log_scan(spark, sf):
    path = storage.work_dir(spark, "journal")
    logs.write_journal(fx.log(spark, sf), path)
    return logs.read_log(spark, path, [fx.EVENTS]).select(
        *POSITION,
        F.col("key").cast("string").alias("key"),
        F.col("value").cast("string").alias("value"),
        F.col("timestamp").cast("timestamp_ntz").alias("timestamp"),
        F.col("headers")[0]["value"].cast("string").alias("kind"),
    )


@check(
    "range_scan",
    """SELECT l.topic, l.part AS "partition", l.off AS "offset", l.id
       FROM log l JOIN at05 s ON s.topic = l.topic AND s.part = l.part
       JOIN at28 t ON t.topic = l.topic AND t.part = l.part
       WHERE l.off >= s.off AND l.off < t.off""",
)
def range_scan(spark, sf):
    log = fx.wide_log(spark, sf)
    starts, targets = fx.vector(log, "2024-01-05"), fx.vector(log, fx.TARGET_CUT)
    return snapshot.read_range(log, starts, targets).select(*POSITION, "id")


@check(
    "file_pruning",
    """SELECT l.topic, l.part AS "partition", l.low, l.high, count(*) FILTER (WHERE l.off >= s.off AND l.off < t.off) AS "rows"
       FROM (SELECT *, min(off) OVER w AS low, max(off) OVER w + 1 AS high FROM log
             WINDOW w AS (PARTITION BY topic, part, off // 200)) l
       JOIN cuts s ON s.topic = l.topic AND s.part = l.part AND s.d = CASE WHEN l.part = 1 THEN 5 ELSE 20 END
       JOIN at28 t ON t.topic = l.topic AND t.part = l.part
       WHERE l.low < t.off AND l.high > s.off GROUP BY ALL""",
)
def file_pruning(spark, sf):
    """The files that a read opens when partition 1 starts early and the others late, and what they give."""
    path, wide = storage.work_dir(spark, "journal"), fx.wide_log(spark, sf)
    logs.write_segments(fx.log(spark, sf), path, 200)
    zones.update_zones(spark, path)
    early, late = fx.vector(wide, "2024-01-05"), fx.vector(wide, "2024-01-20")
    starts = early.filter("partition = 1").unionByName(late.filter("partition <> 1"))
    targets = fx.vector(wide, fx.TARGET_CUT)
    read = zones.read_pruned(spark, path, starts, targets)
    segment = F.expr("offset div 200").alias("segment")
    taken = read.groupBy("topic", "partition", segment).agg(F.count(F.lit(1)).alias("taken"))
    # What the plan opens, and not what it might have opened.
    opened = zones.opened_files(read)
    listed = zones.read_zones(spark, path).join(opened.hint("merge"), "file").withColumn("segment", F.expr("low div 200"))
    found = listed.join(taken, ["topic", "partition", "segment"], "left")
    return found.select("topic", "partition", "low", "high", F.coalesce("taken", F.lit(0)).alias("rows"))


@check(
    "read_committed",
    """SELECT topic, part AS "partition", off AS "offset", id FROM committed""",
)
def read_committed(spark, sf):
    return committed_log(spark, sf).select(*POSITION, "id")


@check(
    "decode_json",
    """SELECT l.topic, l.part AS "partition", l.off AS "offset", g.k, g.k IS NULL AS bad
       FROM log l LEFT JOIN good g ON g.topic = l.topic AND g.part = l.part AND g.off = l.off""",
)
def decode_json(spark, sf):
    decoded = logs.decode_json(fx.wide_log(spark, sf), fx.PAYLOAD, "payload")
    return decoded.select(*POSITION, "row.k", F.col("_error").isNotNull().alias("bad"))


@check(
    "route_topics",
    """SELECT p.tab AS "table", l.topic, l.part AS "partition", count(*) AS "rows"
       FROM log l JOIN pipelines p USING (topic) GROUP BY ALL""",
)
def route_topics(spark, sf):
    routed = logs.route(fx.wide_log(spark, sf), fx.pipelines(spark))
    return routed.groupBy("table", "topic", "partition").agg(F.count(F.lit(1)).alias("rows"))


@check(
    "ledger_rows",
    """SELECT topic, part AS "partition", 'b-' || (off // 1000) AS batch_id,
              min(off) AS min_offset, max(off) AS max_offset, count(*) AS "rows",
              'AFTER_PROCESSING' AS state
       FROM log GROUP BY topic, part, off // 1000""",
)
def ledger_rows(spark, sf):
    path = storage.work_dir(spark, "table")
    batch = F.concat(F.lit("b-"), F.expr(f"offset div {fx.BATCH}").cast("string"))
    rows = fx.wide_log(spark, sf).withColumn("batch_id", batch)
    tables.bulk_load(rows.select("id", *POSITION, "batch_id"), path)
    return tables.read_ledger(spark, path)


@check(
    "ledger_checkpoint",
    """SELECT topic, part AS "partition", batch_id, min(off) AS min_offset, max(off) AS max_offset, count(*) AS "rows",
              count(*) AS stored
       FROM (SELECT *, 'e-' || (off * 8 // high) AS batch_id
             FROM log JOIN (SELECT topic, part, max(off) + 1 AS high FROM log GROUP BY ALL) USING (topic, part))
       GROUP BY topic, part, batch_id""",
)
def ledger_checkpoint(spark, sf):
    """Eight commits, folded and merged on the way; what was replaced is removed, and the blocks stay."""
    path, user = storage.work_dir(spark, "table"), schemas.struct(id=schemas.LONG)
    high = fx.vector(fx.wide_log(spark, sf)).withColumnRenamed("offset", "high")
    rows = fx.wide_log(spark, sf).join(F.broadcast(high), ["topic", "partition"]).withColumn("n", F.expr("offset * 8 div high"))
    letter = F.lit(None).cast(tables.LETTER.dataType).alias("letter")
    rows = storage.written(rows.select("id", *POSITION, letter, F.lit(0).alias("dead"), "n"), "rows")
    for n in range(8):
        tables.append_batch(rows.filter(F.col("n") == n).drop("n"), path, f"e-{n}")
        if n in (2, 4, 6):
            compaction.checkpoint_ledger(spark, path)
            compaction.compact(spark, path, user)
            compaction.vacuum(spark, path)
    stored = tables.read_table(spark, path, user).groupBy(*schemas.BLOCK_ID).agg(F.count(F.lit(1)).alias("stored"))
    return tables.read_ledger(spark, path).drop("state").join(stored, schemas.BLOCK_ID)


@check(
    "snapshot_cut",
    """SELECT l.topic, l.part AS "partition", l.off AS "offset", l.id
       FROM log l JOIN exact e ON e.topic = l.topic AND e.part = l.part WHERE l.off < e.off""",
)
def snapshot_cut(spark, sf):
    cut = ledger_vector(spark, sf)
    return snapshot.snapshot_at(fx.wide_log(spark, sf), cut).select(*POSITION, "id")


@check("exact_offsets", """SELECT topic, part AS "partition", off AS "offset" FROM exact""")
def exact_offsets(spark, sf):
    return ledger_vector(spark, sf)


@check(
    "observed_ahead",
    """SELECT rule, subject, CAST(NULL AS VARCHAR) AS detail FROM (
         SELECT 'observed-ahead' AS rule, topic || '-' || part AS subject
         FROM exact WHERE part = 1
         UNION ALL SELECT 'observed-unexpected', topic || '-9' FROM exact WHERE part = 0
         UNION ALL SELECT 'observed-duplicate', topic || '-0' FROM exact WHERE part = 0)""",
)
def observed_ahead(spark, sf):
    """Partition 0 lags (reported twice), 1 leads, 2 is absent, and 9 does not exist."""
    exact = ledger_vector(spark, sf)
    zero = exact.filter("partition = 0")
    lag = zero.withColumn("offset", F.col("offset") - 1)
    lead = exact.filter("partition = 1").withColumn("offset", F.col("offset") + 1)
    unknown = zero.withColumn("partition", F.lit(9))
    return ledger.audit_observed(exact, audit.union([lag, lag, lead, unknown]))


@check(
    "range_audit",
    """SELECT rule, subject, CAST(NULL AS VARCHAR) AS detail FROM (
         SELECT 'range-start-expired' AS rule, s.topic || '-' || s.part AS subject
         FROM cuts s JOIN bounds b ON b.topic = s.topic AND b.part = s.part
         WHERE s.d = 2 AND s.part = 0 AND s.off < b.low
         UNION ALL SELECT 'range-target-beyond-end', topic || '-1' FROM bounds WHERE part = 1
         UNION ALL SELECT 'range-no-start', topic || '-2' FROM bounds WHERE part = 2)""",
)
def range_audit(spark, sf):
    log = fx.wide_log(spark, sf)
    early = fx.vector(log, "2024-01-02").filter("partition = 0")
    later = fx.vector(log, "2024-01-05").filter("partition = 1")
    beyond = F.when(F.col("partition") == 1, F.col("offset") + 1_000_000_000)
    targets = fx.vector(log, fx.TARGET_CUT).withColumn("offset", F.coalesce(beyond, "offset"))
    return bounds.audit_ranges(early.unionByName(later), targets, fx.retained_bounds(log))


@check(
    "replayable_audit",
    """, c AS (SELECT *, 'run-' || run || '/' || topic AS of_run FROM ckpt WHERE NOT (topic = 'events.input' AND part = 2)),
       b AS (SELECT * FROM bounds WHERE NOT (topic = 'orders.input' AND part = 1)),
       j AS (SELECT c.*, b.low, b.high FROM c LEFT JOIN b ON b.topic = c.topic AND b.part = c.part)
       SELECT rule, subject, CAST(NULL AS VARCHAR) AS detail FROM (
         SELECT 'replay-expired' AS rule, of_run || '-' || part AS subject FROM j WHERE off < low
         UNION ALL SELECT 'replay-beyond-end', of_run || '-' || part FROM j WHERE off > high
         UNION ALL SELECT 'replay-no-bounds', of_run || '-' || part FROM j WHERE low IS NULL
         UNION ALL SELECT 'replay-incomplete-log', of_run || '-' || part FROM j WHERE low <> 0
         UNION ALL
         SELECT 'replay-partition-count', of_run FROM c GROUP BY of_run, topic
         HAVING count(*) <> (SELECT count(*) FROM b WHERE b.topic = c.topic))""",
)
def replayable_audit(spark, sf):
    """All checkpoints of the history; one lacks a partition, and the log lost another."""
    every = fx.checkpoints(spark, sf).withColumn("backup", F.format_string("run-%d", "run"))
    every = every.filter(~((F.col("topic") == fx.EVENTS) & (F.col("partition") == 2)))
    low_high = fx.retained_bounds(fx.wide_log(spark, sf))
    low_high = low_high.filter(~((F.col("topic") == fx.ORDERS) & (F.col("partition") == 1)))
    return bounds.audit_replayable(every.select("backup", *POSITION), low_high, complete=True, by=["backup"])


@check(
    "rehydrate_ledger",
    """, rows_ AS (
         SELECT topic || '-' || part AS key, off - 1 AS o, part FROM exact WHERE off > 0)
       SELECT key AS "key", min_offset, max_offset, 'AFTER_PROCESSING' AS state, action FROM (
         SELECT key, o AS min_offset, o AS max_offset, 'insert' AS action FROM rows_ WHERE part > 0
         UNION ALL SELECT key, 0, o, 'conflict' FROM rows_ WHERE part = 1)""",
)
def rehydrate_ledger(spark, sf):
    """Of the expected rows, partition 0 is there, 1 differs and 2 is missing."""
    expected = ledger.vector_to_ledger(ledger_vector(spark, sf))
    same = expected.filter(F.col("key").endswith("-0"))
    other = expected.filter(F.col("key").endswith("-1")).withColumn(
        "min_offset", F.lit(0).cast("long")
    )
    return ledger.rehydrate(expected, same.unionByName(other))


@check(
    "progress_audit",
    """SELECT rule, subject, CAST(NULL AS VARCHAR) AS detail FROM (
         SELECT 'progress-moved-back' AS rule, topic || '-1' AS subject FROM exact WHERE part = 1
         UNION ALL SELECT 'progress-lost-row', topic || '-2' FROM exact WHERE part = 2
         UNION ALL SELECT 'progress-unexpected-partition', topic || '-0-x'
         FROM exact WHERE part = 0 AND off > 0)""",
)
def progress_audit(spark, sf):
    """Partition 0 moved on, 1 went back, 2 is lost, and one row is foreign."""
    vector = ledger_vector(spark, sf)
    initial = ledger.vector_to_ledger(vector)
    zero = initial.filter(F.col("key").endswith("-0"))
    on = zero.withColumn("max_offset", F.col("max_offset") + 10)
    back = initial.filter(F.col("key").endswith("-1")).withColumn(
        "max_offset", F.col("max_offset") - 1
    )
    foreign = zero.withColumn("key", F.concat("key", F.lit("-x")))
    return ledger.audit_progress(audit.union([on, back, foreign]), initial, vector)


@check(
    "log_bounds",
    """SELECT topic, part AS "partition", min(off) AS low, max(off) + 1 AS high
       FROM log GROUP BY ALL""",
)
def log_bounds(spark, sf):
    return bounds.log_bounds(fx.wide_log(spark, sf))


@check(
    "block_ranges",
    """SELECT topic, part AS "partition", 'b-' || (off // 100) AS batch_id,
              min(off) AS min_offset, max(off) AS max_offset, count(*) AS "rows"
       FROM log GROUP BY topic, part, off // 100""",
)
def block_ranges(spark, sf):
    return fx.blocks(fx.wide_log(spark, sf))


@check(
    "ledger_fold",
    """SELECT topic, part AS "partition", batch_id, min_offset, max_offset, n AS "rows", state
       FROM ledger
       QUALIFY row_number() OVER (PARTITION BY topic, part ORDER BY max_offset DESC) = 1""",
)
def ledger_fold(spark, sf):
    return ledger.fold_ledger(fx.ledger(spark, sf))


@check(
    "verify_table",
    """SELECT count(*) AS row_count, count(DISTINCT owner) AS distinct_keys,
              count(*) FILTER (WHERE starts_with(kind, 'p')) AS prefixed,
              count(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-25') AS after_cut
       FROM log""",
)
def verify_table(spark, sf):
    late = F.col("ts") >= F.lit(fx.LEDGER_CUT).cast("timestamp_ntz")
    return audit.verify_table(
        fx.wide_log(spark, sf),
        "owner",
        {"prefixed": F.startswith("kind", F.lit("p")), "after_cut": late},
    )


@check(
    "duplicate_keys",
    """SELECT topic, owner, count(*) AS copies FROM log GROUP BY ALL HAVING count(*) > 1""",
)
def duplicate_keys(spark, sf):
    return audit.duplicates(fx.wide_log(spark, sf), ["topic", "owner"])


@check(
    "replay_end_offsets",
    """SELECT p.topic, p.part AS "partition", coalesce(max(c.off) + 1, 0) AS "offset"
       FROM parts p LEFT JOIN committed c ON c.topic = p.topic AND c.part = p.part GROUP BY ALL""",
)
def replay_end_offsets(spark, sf):
    return bounds.end_offsets(committed_log(spark, sf), fx.pipelines(spark))


@check(
    "resequence",
    """SELECT topic, part AS "partition", off AS "offset",
              row_number() OVER w - 1 AS new_offset, (row_number() OVER w - 1) // 500 AS batch
       FROM committed WINDOW w AS (PARTITION BY topic, part ORDER BY off)""",
)
def resequence(spark, sf):
    rows = committed_log(spark, sf).select(*POSITION)
    return bounds.resequence(rows, batch_records=500, bucket=1000)


@check(
    "offset_gaps",
    """SELECT topic, part AS "partition", off + 1 AS gap_start, nxt AS gap_end FROM (
         SELECT topic, part, off, lead(off) OVER (PARTITION BY topic, part ORDER BY off) AS nxt
         FROM committed) WHERE nxt > off + 1""",
)
def offset_gaps(spark, sf):
    return bounds.offset_gaps(committed_log(spark, sf), bucket=1000)


@check(
    "offset_diff",
    """SELECT side, topic, part AS "partition", off AS "offset", 1 AS copies FROM (
         SELECT 'left' AS side, topic, part, off FROM exact WHERE part > 0
         UNION ALL SELECT 'right', topic, part, off + 1 FROM exact WHERE part = 1)""",
)
def offset_diff(spark, sf):
    """Partition 0 is equal, 1 differs and 2 is missing on the right."""
    exact = ledger_vector(spark, sf)
    moved = F.col("offset") + F.col("partition")
    return audit.diff_rows(exact, exact.filter("partition < 2").withColumn("offset", moved))


@check(
    "barrier_cut",
    """SELECT tab AS "table", connector, topic, part AS "partition", off AS "offset" FROM exact""",
)
def barrier_cut(spark, sf):
    return snapshot.barrier_cut(fx.ledger(spark, sf), fx.pipelines(spark))


@check(
    "ledger_audit",
    """, r AS (
         SELECT p.connector, p.topic, l.part, min(min_offset) AS lo, max(max_offset) AS hi
         FROM ledger l JOIN pipelines p USING (topic) GROUP BY ALL)
       SELECT rule, subject, connector AS detail FROM (
         SELECT 'ledger-unexpected-topic' AS rule, 'x' || topic || '-' || part AS subject, connector
         FROM r WHERE part = 0
         UNION ALL SELECT 'ledger-duplicate-partition', topic || '-' || part, connector
         FROM r WHERE part = 1
         UNION ALL SELECT 'ledger-invalid-range', topic || '-01', connector
         FROM r WHERE part = 1 AND hi > lo
         UNION ALL SELECT 'ledger-invalid-partition', topic || '-' || part || 'b', connector FROM r
         UNION ALL SELECT 'ledger-offset-too-large', topic || '-' || part || 'b', connector FROM r
         UNION ALL SELECT 'ledger-partition-out-of-range', topic || '-7' || part, connector FROM r
         UNION ALL SELECT 'ledger-unfinished', topic || '-7' || part, connector FROM r)""",
)
def ledger_audit(spark, sf):
    """The folded ledger plus rows that each break one or two rules."""
    raw = fx.raw_ledger(spark, sf)
    big = F.lit("9223372036854775808").cast("decimal(20,0)")
    zero, one = (raw.filter(F.col("key").endswith(f"-{p}")) for p in (0, 1))
    topic = F.regexp_extract("key", r"\A(.*)-[0-9]+\z", 1)
    broken = [
        zero.withColumn("key", F.concat(F.lit("x"), "key")),
        one.withColumns(
            {
                "key": F.concat(topic, F.lit("-01")),
                "min_offset": F.col("max_offset"),
                "max_offset": F.col("min_offset"),
            }
        ),
        raw.withColumns({"key": F.concat("key", F.lit("b")), "max_offset": big}),
        raw.withColumns(
            {"key": F.regexp_replace("key", "-([0-9]+)$", "-7$1"), "state": F.lit("BEFORE")}
        ),
    ]
    return ledger.audit_ledger(audit.union([raw, *broken]), fx.pipelines(spark))
