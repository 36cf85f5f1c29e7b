"""Delivery, backups, recovery, streaming and leases, on real files."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import functions as F

from checks.log_checks import POSITION, committed_log
from checks.registry import check, until
from offsetlake import fixtures as fx
from offsetlake import schemas
from offsetlake.operators import bounds, dedup, ledger, lease, snapshot, splits
from offsetlake.plans import copy
from offsetlake.plans import recover as recovery
from offsetlake.sources import backup as backups
from offsetlake.sources import log as logs
from offsetlake.sources import prints, storage, zones
from offsetlake.sources import sweep as sweeping
from offsetlake.sources import table as tables
from offsetlake.streaming import dedup as dedup_stream
from offsetlake.streaming import deliver as delivery
from offsetlake.streaming import follow as following
from offsetlake.streaming import leases

ROWS = [*POSITION, "k"]
PLACE = """topic, part AS "partition", off AS "offset\""""
ALL_GOOD = f"SELECT {PLACE}, k FROM good"


def good_until(day):
    return f"SELECT {PLACE}, k FROM ({until(day)})"


def target(spark, name="table", order_by=()):
    return delivery.Target(storage.work_dir(spark, name), fx.PAYLOAD, fx.TOPICS, order_by)


def parted(spark, sf, *days):
    """The log cut at the vectors of some days: the pieces, the last one open, and the vectors."""
    log, wide = fx.log(spark, sf), fx.wide_log(spark, sf)
    *vectors, high = fx.vectors(wide, [*[f"2024-01-{day:02d}" for day in days], None])
    pieces = [snapshot.snapshot_at(log, vectors[0])]
    for start, end in zip(vectors, [*vectors[1:], high], strict=True):
        pieces.append(snapshot.read_range(log, start, end))
    return pieces, vectors


def run_stream(spark, journal, to, checkpoint=None):
    stream = logs.read_log(spark, journal, fx.TOPICS, streaming=True)
    query = delivery.deliver(stream, [to], checkpoint or storage.work_dir(spark, "checkpoint"))
    query.awaitTermination()


def backed_up(spark, sf):
    """A table delivered in two parts, with a full backup after the first, an increment after both."""
    source = target(spark)
    archive = storage.work_dir(spark, "archive")
    names = ["b-full", "b-next"]
    parts, _ = parted(spark, sf, 10, 20)
    parent = None
    for name, part in zip(names, parts[:2], strict=True):
        delivery.append_decoded(part, source, name)
        folded = ledger.fold_ledger(tables.read_ledger(spark, source.path))
        vector = folded.select("topic", "partition", (F.col("max_offset") + 1).alias("offset"))
        backups.write_backup(
            spark, source.path, "records", fx.PAYLOAD, vector, archive, name, parent
        )
        parent = name
    return source, archive, names, vector


@check("delivered_rows", ALL_GOOD)
def delivered_rows(spark, sf):
    """Two parts of the log, the first of them tried twice."""
    to = target(spark)
    (first, second), _ = parted(spark, sf, 15)
    delivery.append_decoded(first, to, "e-0")
    delivery.append_decoded(first, to, "e-0")
    delivery.append_decoded(second, to, "e-1")
    return tables.read_table(spark, to.path, fx.PAYLOAD).select(*ROWS)


@check(
    "dead_letters",
    """SELECT topic, part AS "partition", off AS "offset", payload AS "value",
              'payload is not valid' AS message
       FROM log WHERE topic = 'events.input' AND id % 101 = 0""",
)
def dead_letters(spark, sf):
    to = target(spark)
    delivery.append_decoded(fx.log(spark, sf), to, "e-0")
    message = F.filter("headers", lambda h: h["key"] == "error.message")[0]["value"]
    return tables.read_dead_letters(spark, to.path).select(
        *POSITION, F.col("value").cast("string").alias("value"), message.cast("string").alias("message")
    )


@check(
    "ordered_storage",
    """SELECT count(*) AS "rows", 0 AS inversions FROM good""",
)
def ordered_storage(spark, sf):
    """Rows out of the table's order (k, then offset) inside the files; there must be none."""
    to = target(spark, order_by=("k", "offset"))
    delivery.append_decoded(fx.log(spark, sf), to, "e-0")
    rows = tables.read_table(spark, to.path, fx.PAYLOAD).select(
        F.struct("k", "offset").alias("order"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.row_index").alias("at"),
    )
    after = rows.select("file", (F.col("at") + 1).alias("at"), F.col("order").alias("before"))
    return rows.join(after, ["file", "at"], "left").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col("before") > F.col("order")).alias("inversions"),
    )


@check("backup_full", good_until(10))
def backup_full(spark, sf):
    _, archive, names, _ = backed_up(spark, sf)
    return backups.read_chain(spark, archive, names[:1], "records", fx.PAYLOAD).select(*ROWS)


@check(
    "backup_incremental",
    f"{good_until(20)} EXCEPT {good_until(10)}",
)
def backup_incremental(spark, sf):
    """Only what the second backup holds itself."""
    _, archive, names, _ = backed_up(spark, sf)
    return backups.read_chain(spark, archive, names[1:], "records", fx.PAYLOAD).select(*ROWS)


@check(
    "restore_chain",
    f"""SELECT {PLACE}, CAST(k AS BIGINT) AS k, CAST(NULL AS VARCHAR) AS note FROM ({until(20)})""",
)
def restore_chain(spark, sf):
    """Restored into a table with a wider type and one more column."""
    _, archive, names, _ = backed_up(spark, sf)
    to = target(spark, "restored")
    to.schema = schemas.struct(k=schemas.LONG, note=schemas.STRING)
    recovery.restore(spark, archive, names, "records", fx.PAYLOAD, to, "r-1")
    return tables.read_table(spark, to.path, to.schema).select(*ROWS, "note")


@check(
    "backup_metrics",
    f"""SELECT backup, 'records' AS "table", count(*) AS "rows", true AS has_files, true AS has_bytes
       FROM (SELECT 'b-full' AS backup, * FROM ({until(10)})
             UNION ALL SELECT 'b-next', * FROM ({until(20)} EXCEPT {until(10)})) GROUP BY ALL""",
)
def backup_metrics(spark, sf):
    _, archive, _, _ = backed_up(spark, sf)
    found = backups.backup_metrics(spark, archive)
    return found.select("backup", "table", "rows", (F.col("files") > 0).alias("has_files"), (F.col("bytes") > 0).alias("has_bytes"))


@check(
    "backup_verified",
    f"""SELECT rule, topic || '-' || part AS subject, CAST(NULL AS VARCHAR) AS detail
       FROM (SELECT topic, part FROM ({until(20)}) GROUP BY ALL),
            (VALUES ('backup-row-count', 0), ('backup-offset-range', 0), ('backup-content', 0),
                    ('backup-content', 1)) AS v(rule, p)
       WHERE part = p""",
)
def backup_verified(spark, sf):
    """Compared with a cut that lacks the first row of partition 0 and has one other value in 1."""
    source, archive, names, vector = backed_up(spark, sf)
    copied = backups.read_chain(spark, archive, names, "records", fx.PAYLOAD)
    cut = tables.read_table(spark, source.path, fx.PAYLOAD)
    lowest = cut.groupBy("topic", "partition").agg(F.min("offset").alias("lowest"))
    cut = cut.join(F.broadcast(lowest), ["topic", "partition"])
    cut = cut.filter("NOT (partition = 0 AND offset = lowest)")
    other = (F.col("partition") == 1) & (F.col("offset") == F.col("lowest"))
    cut = cut.withColumn("k", F.when(other, -1).otherwise(F.col("k"))).drop("lowest")
    return backups.verify_backup(copied, cut.select(*copied.columns))


def ranged(spark, sf, start):
    """A start vector, the target vector, and the bounds of the log."""
    wide = fx.wide_log(spark, sf)
    return fx.vector(wide, start), fx.vector(wide, fx.TARGET_CUT), bounds.log_bounds(wide)


@check(
    "copy_range",
    """SELECT c.topic, c.part AS "partition",
              row_number() OVER (PARTITION BY c.topic, c.part ORDER BY c.off) - 1 AS "offset",
              c.off AS source_offset,
              (row_number() OVER (PARTITION BY c.topic, c.part ORDER BY c.off) - 1) // 500 AS batch,
              c.payload AS "value", c.kind
       FROM committed c JOIN at05 s ON s.topic = c.topic AND s.part = c.part
       JOIN at28 t ON t.topic = c.topic AND t.part = c.part
       WHERE c.off >= s.off AND c.off < t.off""",
)
def copy_range(spark, sf):
    """In two steps; the second call finds everything copied."""
    log = fx.packed(committed_log(spark, sf))
    starts, targets, limits = ranged(spark, sf, "2024-01-05")
    dest = storage.work_dir(spark, "copy")
    half = targets.join(starts.withColumnRenamed("offset", "s"), ["topic", "partition"]).agg(
        F.max(F.expr("(offset - s) div 2 + 1")).alias("half")
    ).collect()[0].half
    for _ in range(2):
        copy.copy_range(log, starts, targets, limits, dest, 500, half)
    return copy.read_copy(spark, dest).select(
        *POSITION,
        "source_offset",
        "batch",
        F.col("value").cast("string").alias("value"),
        F.col("headers")[0]["value"].cast("string").alias("kind"),
    )


@check(
    "orphans",
    f"""SELECT * FROM (VALUES
         ('uncommitted-batch', 'e-lost', 1), ('unfinished-backup', 'b-dead', 1), ('uncommitted-backup', 'b-crashed', 2),
         ('closed-chain', 'b-full', 2), ('closed-chain', 'b-next', 2)) AS v(reason, unit, paths),
       (SELECT count(*) AS reachable FROM ({until(20)}))""",
)
def orphans(spark, sf):
    """A lost batch, a backup without its block list, one without a manifest, and a closed chain; one root."""
    source, archive, names, vector = backed_up(spark, sf)
    (_, _, rest), _ = parted(spark, sf, 10, 20)
    delivery.append_decoded(rest, source, "e-lost")
    storage.remove(spark, f"{source.path}/ledger/commit=e-lost")
    for name in ("b-open", "b-crashed", "b-dead"):
        backups.write_backup(spark, source.path, "records", fx.PAYLOAD, vector, archive, name)
    storage.remove(spark, f"{archive}/blocks/backup=b-dead")
    manifests = spark.createDataFrame(
        [("b-full", None), ("b-next", "b-full"), ("b-open", None)], "backup_id STRING, parent_id STRING"
    )
    roots = manifests.filter("backup_id = 'b-open'")
    found = sweeping.table_orphans(spark, source.path).unionByName(
        sweeping.archive_orphans(spark, archive, manifests, roots)
    )
    found = storage.written(found.groupBy("reason", "unit").agg(F.count(F.lit(1)).cast("int").alias("paths")), "found")
    sweeping.sweep(spark, sweeping.table_orphans(spark, source.path), [source.path])
    sweeping.sweep(spark, sweeping.archive_orphans(spark, archive, manifests, roots), [archive])
    left = backups.read_chain(spark, archive, ["b-open"], "records", fx.PAYLOAD).count()
    return found.withColumn("reachable", F.lit(left).cast("long"))


@check(
    "replay_splits",
    """, inside AS (
         SELECT c.topic, c.part, c.off, s.off AS first, t.off AS target,
                row_number() OVER (PARTITION BY c.topic, c.part ORDER BY c.off) - 1 AS idx
         FROM committed c JOIN at05 s ON s.topic = c.topic AND s.part = c.part
         JOIN at28 t ON t.topic = c.topic AND t.part = c.part WHERE c.off >= s.off AND c.off < t.off),
       begun AS (
         SELECT topic, part, idx // 300 AS split, any_value(target) AS target, count(*) AS n,
                CASE WHEN idx // 300 = 0 THEN any_value(first) ELSE min(off) END AS start
         FROM inside GROUP BY topic, part, idx // 300)
       SELECT topic, part AS "partition", split, start, n AS "rows",
              coalesce(lead(start) OVER (PARTITION BY topic, part ORDER BY split), target) AS "end"
       FROM begun""",
)
def replay_splits(spark, sf):
    """Splits of 300 committed records each, over a log with gaps."""
    starts, targets, _ = ranged(spark, sf, "2024-01-05")
    return splits.plan_splits(committed_log(spark, sf), starts, targets, 300, bucket=1000)


@check("point_in_time", good_until(28))
def point_in_time(spark, sf):
    """A restored chain and the log range from its vector to the target."""
    _, archive, names, vector = backed_up(spark, sf)
    restored = backups.read_chain(spark, archive, names, "records", fx.PAYLOAD)
    targets = fx.vector(fx.wide_log(spark, sf), fx.TARGET_CUT)
    rows = recovery.point_in_time(restored, fx.log(spark, sf), vector, targets, fx.PAYLOAD)
    return rows.select(*ROWS)


@check(
    "reconcile_tables",
    """SELECT side, topic, part AS "partition", off AS "offset", k, 1 AS copies FROM (
         SELECT 'left' AS side, topic, part, off, k FROM good
         WHERE part = 1 AND (off % 1000 = 7 OR off % 1500 = 3)
         UNION ALL
         SELECT 'right', topic, part, off, -1 FROM good
         WHERE part = 1 AND off % 1000 = 7 AND NOT off % 1500 = 3)""",
)
def reconcile_tables(spark, sf):
    """In partition 1 the right side has other values and lost rows; the others are equal."""
    decoded = logs.decode_json(fx.wide_log(spark, sf), fx.PAYLOAD, "payload")
    left = logs.only_good(decoded).select(*POSITION, "row.k")
    touched = F.col("partition") == 1
    lost = touched & (F.col("offset") % 1500 == 3)
    other = touched & (F.col("offset") % 1000 == 7)
    right = left.filter(~lost).withColumn("k", F.when(other, -1).otherwise(F.col("k")))
    return backups.reconcile(left, right, bucket=100)


def printed_pair(spark, sf):
    """Two stored tables of the log in three batches; the right one lost and changed rows in the last."""
    sides = [target(spark, name) for name in ("left", "right")]
    pieces, _ = parted(spark, sf, 10, 20)
    touched = F.col("partition") == 1
    lost = touched & (F.col("offset") % 1500 == 3)
    changed = F.when(touched & (F.col("offset") % 1000 == 7), F.lit(b'{"k": -1}')).otherwise(F.col("value"))
    others = [*pieces[:2], pieces[2].filter(~lost).withColumn("value", changed)]

    def append(to, batches):
        for number, rows in enumerate(batches):
            delivery.append_decoded(rows, to, f"e-{number}")
            if number < 2:
                prints.update_prints(spark, to.path, fx.PAYLOAD, 100)

    # A piece is a stretch of the source's files, so few of their tasks have rows: the tables share the cores.
    with ThreadPoolExecutor(2) as pool:
        list(pool.map(append, sides, (pieces, others)))
    return sides


# Rows that the third batch has on one side only; a broken payload that is replaced becomes a row.
PRINTED = """, third AS (
         SELECT l.*, g.k FROM log l JOIN cuts c ON c.topic = l.topic AND c.part = l.part AND c.d = 20
         LEFT JOIN good g ON g.topic = l.topic AND g.part = l.part AND g.off = l.off
         WHERE l.off >= c.off AND l.part = 1),
       sides AS (
         SELECT 'left' AS side, topic, part, off, k FROM third
         WHERE k IS NOT NULL AND (off % 1000 = 7 OR off % 1500 = 3)
         UNION ALL
         SELECT 'right', topic, part, off, -1 FROM third WHERE off % 1000 = 7 AND NOT off % 1500 = 3)
"""


@check("fingerprint_diff", PRINTED + """SELECT side, topic, part AS "partition", off AS "offset", k, 1 AS copies FROM sides""")
def fingerprint_diff(spark, sf):
    """Row differences by the stored trees; the third batch has no stored leaves yet."""
    left, right = printed_pair(spark, sf)
    return prints.diff_tables(spark, left.path, right.path, fx.PAYLOAD, 100)


@check(
    "fingerprint_slots",
    PRINTED
    + """, slots AS (
         SELECT topic, part, off // 100 AS slot, count(*) FILTER (WHERE side = 'left') AS a, count(*) FILTER (WHERE side = 'right') AS b
         FROM sides GROUP BY topic, part, off // 100),
       held AS (SELECT topic, part, off // 100 AS slot, count(*) AS n FROM good GROUP BY ALL)
       SELECT s.topic, s.part AS "partition", s.slot, CAST(coalesce(n, 0) AS BIGINT) AS left_rows,
              CAST(coalesce(n, 0) - a + b AS BIGINT) AS right_rows
       FROM slots s LEFT JOIN held h ON h.topic = s.topic AND h.part = s.part AND h.slot = s.slot""",
)
def fingerprint_slots(spark, sf):
    """Buckets of 100 offsets whose sums differ, found from the table downwards."""
    left, right = printed_pair(spark, sf)
    return prints.differing(*(prints.leaves(spark, to.path, fx.PAYLOAD, 100) for to in (left, right)))


@check("stream_delivery", ALL_GOOD)
def stream_delivery(spark, sf):
    """A growing journal, a restart from the checkpoint, and a replay after the checkpoint is lost."""
    to = target(spark)
    journal, checkpoint = storage.work_dir(spark, "journal"), storage.work_dir(spark, "checkpoint")
    (first, second), _ = parted(spark, sf, 15)
    logs.write_journal(first, journal)
    run_stream(spark, journal, to, checkpoint)
    logs.write_journal(second, journal)
    run_stream(spark, journal, to, checkpoint)
    run_stream(spark, journal, to)
    return tables.read_table(spark, to.path, fx.PAYLOAD).select(*ROWS)


@check("stream_follow", ALL_GOOD)
def stream_follow(spark, sf):
    """A restored table follows the log from the vector of its backup."""
    _, archive, names, vector = backed_up(spark, sf)
    to = target(spark, "followed")
    recovery.restore(spark, archive, names, "records", fx.PAYLOAD, to, "r-1")
    journal = storage.work_dir(spark, "journal")
    logs.write_journal(fx.log(spark, sf), journal)
    stream = logs.read_log(spark, journal, fx.TOPICS, streaming=True)
    limits = bounds.log_bounds(fx.wide_log(spark, sf))
    query = following.follow(stream, vector, limits, to, storage.work_dir(spark, "checkpoint"))
    query.awaitTermination()
    return tables.read_table(spark, to.path, fx.PAYLOAD).select(*ROWS)


@check("stream_from_vector", ALL_GOOD)
def stream_from_vector(spark, sf):
    """A restored table follows a mapped journal by vectors: once, then after the journal grew, from the checkpoint."""
    _, archive, names, vector = backed_up(spark, sf)
    to = target(spark, "followed")
    recovery.restore(spark, archive, names, "records", fx.PAYLOAD, to, "r-1")
    journal, checkpoint = storage.work_dir(spark, "journal"), storage.work_dir(spark, "checkpoint")
    limits = bounds.log_bounds(fx.wide_log(spark, sf))
    (first, second), _ = parted(spark, sf, 28)
    logs.write_segments(first, journal, 10_000)
    zones.update_zones(spark, journal)
    following.follow_journal(journal, vector, limits, to, checkpoint).awaitTermination()
    logs.write_segments(second, journal, 10_000)
    zones.update_zones(spark, journal)
    following.follow_journal(journal, vector, limits, to, checkpoint).awaitTermination()
    return tables.read_table(spark, to.path, fx.PAYLOAD).select(*ROWS)


@check("stream_replay", good_until(28))
def stream_replay(spark, sf):
    """A restored table is replayed to its target in splits and stops there; a second run adds nothing."""
    _, archive, names, vector = backed_up(spark, sf)
    to = target(spark, "replayed")
    recovery.restore(spark, archive, names, "records", fx.PAYLOAD, to, "r-1")
    _, targets, limits = ranged(spark, sf, "2024-01-20")
    # Three splits or so, whatever the size of the log.
    records = 1 + targets.agg(F.max("offset")).first()[0] // 8
    for _ in range(2):
        following.replay_until(fx.log(spark, sf), vector, targets, limits, to, "r-1", records_per_split=records)
    following.require_at(to, targets)
    return tables.read_table(spark, to.path, fx.PAYLOAD).select(*ROWS)


WINDOW = 20
DEDUP = """, b AS (
         SELECT topic, part, off // 100 AS batch, count(*) AS n FROM log GROUP BY ALL),
       late AS (
         SELECT *, (SELECT count(*) FROM b a WHERE a.topic = b.topic AND (a.batch, a.part) > (b.batch, b.part)) AS others
         FROM b WHERE (part + batch) % 7 = 0),
       kept AS (
         SELECT topic, part, batch, 1 AS attempt, n FROM b
         UNION ALL
         SELECT topic, part, batch, 3, n FROM late l
         WHERE others + (SELECT count(*) FROM late e
                         WHERE e.topic = l.topic AND e.others + 1 > 20 AND (e.batch, e.part) < (l.batch, l.part)) >= 20)
"""


@check(
    "dedup_blocks",
    DEDUP + """SELECT topic, part AS "partition", batch, attempt, n AS "rows" FROM kept""",
)
def dedup_blocks(spark, sf):
    """Blocks in log order; some are retried at once, others again after the whole pass.

    The window is 20 blocks: immediate retries are refused, and late ones are refused only for
    blocks that are still among the last 20.
    """
    kept = dedup.dedup_blocks(attempted(spark, sf), ["table", "seq"], ["id", "payload"], window=WINDOW)
    return kept.groupBy("topic", "partition", "batch", "attempt").agg(
        F.count(F.lit(1)).alias("rows")
    )


def attempted(spark, sf):
    """Records of attempted blocks; each topic has a table of its own."""
    rows = fx.wide_log(spark, sf).withColumn("batch", F.expr("offset div 100"))
    first = rows.withColumn("attempt", F.lit(1))
    again = rows.filter("(partition + batch) % 4 = 0").withColumn("attempt", F.lit(2))
    late = rows.filter("(partition + batch) % 7 = 0").withColumn("attempt", F.lit(3))
    tried = first.unionByName(again).unionByName(late)
    seq = F.when(F.col("attempt") == 3, F.lit(1 << 40)).otherwise(F.lit(0)) + (
        F.col("batch") * 3 + F.col("partition")
    ) * 2 + F.when(F.col("attempt") == 2, 1).otherwise(0)
    return tried.withColumns({"seq": seq, "table": F.col("topic")})


def streamed_dedup(spark, sf):
    """First attempts and immediate retries as a batch, the late ones as a stream that begins there."""
    blocks = storage.written(
        dedup.block_ids(attempted(spark, sf), ["table", "seq", "batch", "attempt"], ["id", "payload"]), "attempts"
    )
    accepted = storage.written(dedup.accepted_blocks(blocks.filter("attempt < 3"), WINDOW), "accepted")
    source, out, checkpoint = (storage.work_dir(spark, n) for n in ("late", "kept", "checkpoint"))
    blocks.filter("attempt = 3").write.parquet(source)
    stream = spark.readStream.schema(blocks.schema).parquet(source)
    query = (
        dedup_stream.stream_accepted_blocks(stream, WINDOW, initial=dedup_stream.handed_over(accepted, WINDOW))
        .writeStream.option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(out)
    )
    query.awaitTermination()
    return accepted.unionByName(spark.read.schema(blocks.schema).parquet(out)), checkpoint


@check(
    "stream_dedup_blocks",
    DEDUP + """SELECT topic, part AS "partition", batch, attempt, n AS "rows" FROM kept""",
)
def stream_dedup_blocks(spark, sf):
    """The blocks that a stream accepts after a batch are those that one batch over everything accepts."""
    kept, _ = streamed_dedup(spark, sf)
    return kept.select("topic", "partition", "batch", "attempt", "rows")


@check(
    "stream_state_audit",
    DEDUP.replace("kept AS (", "whole AS (")
    + """, placed AS (
         SELECT *, row_number() OVER (PARTITION BY topic ORDER BY attempt = 3 DESC, batch DESC, part DESC) AS back FROM whole)
       SELECT topic AS "table", topic || '/' || part || '/' || min(o.off) || '/' || max(o.off) || '/' || count(*) AS block,
              CAST(20 - back AS BIGINT) AS place, 'held' AS rule
       FROM placed p JOIN (SELECT topic, part, off, off // 100 AS batch FROM log) o USING (topic, part, batch)
       WHERE back <= 20 GROUP BY topic, part, batch, attempt, back""",
)
def stream_state_audit(spark, sf):
    """The window of every table in the state store of the stopped stream, and what its audit finds."""
    _, checkpoint = streamed_dedup(spark, sf)
    state = dedup_stream.window_state(spark, checkpoint)
    first = state.groupBy("table").agg(F.min("number").alias("first"))
    held = state.join(first, "table").select(
        "table",
        F.substring_index("identity", "/", 5).alias("block"),
        (F.col("number") - F.col("first")).alias("place"),
        F.lit("held").alias("rule"),
    )
    found = dedup_stream.audit_window(spark, checkpoint, WINDOW)
    return held.unionByName(found.select(F.col("subject").alias("table"), F.col("detail").alias("block"), F.lit(0).cast("long").alias("place"), "rule"))


TTL = 6 * 3600


def ntz(name):
    return F.col(name).cast("timestamp_ntz").alias(name)


@check(
    "lease_sessions",
    """SELECT CAST(token AS VARCHAR) AS token, connector, s AS "start", e AS "end", ended_by
       FROM sessions""",
)
def lease_sessions(spark, sf):
    sessions = lease.lease_sessions(fx.lease_events(spark, sf), TTL)
    return sessions.select(
        "token", F.col("connectors")[0].alias("connector"), ntz("start"), ntz("end"), "ended_by"
    )


@check(
    "held_intervals",
    """, marked AS (
         SELECT connector, s, e, max(e) OVER (PARTITION BY connector ORDER BY s, e
                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach
         FROM sessions WHERE s < e),
       grouped AS (
         SELECT *, sum(CASE WHEN reach IS NULL OR s > reach THEN 1 ELSE 0 END)
                OVER (PARTITION BY connector ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g
         FROM marked)
       SELECT connector, min(s) AS "start", max(e) AS "end" FROM grouped GROUP BY connector, g""",
)
def held_intervals(spark, sf):
    sessions = lease.lease_sessions(fx.lease_events(spark, sf), TTL)
    return lease.held_intervals(sessions).select("connector", ntz("start"), ntz("end"))


@check(
    "holders_at",
    """, present AS (
         SELECT token, connector, e > TIMESTAMP '2024-01-01 12:00:00' AS live FROM sessions
         WHERE s <= TIMESTAMP '2024-01-01 12:00:00'
           AND NOT (ended_by = 'resumed' AND e <= TIMESTAMP '2024-01-01 12:00:00'))
       SELECT CAST(p.token AS VARCHAR) AS token, p.connector, p.live,
              NOT EXISTS (SELECT 1 FROM present o
                          WHERE o.connector = p.connector AND o.token <> p.token AND o.live) AS freed
       FROM present p""",
)
def holders_at(spark, sf):
    sessions = lease.lease_sessions(fx.lease_events(spark, sf), TTL)
    return lease.holders_at(sessions, "2024-01-01 12:00:00")


@check(
    "stream_leases",
    """SELECT CAST(token AS VARCHAR) AS token, connector, s AS "start", e AS "end", ended_by
       FROM sessions
       WHERE ended_by = 'resumed' OR e <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR""",
)
def stream_leases(spark, sf):
    """The same lives from a stream: those that ended before its watermark, an hour behind."""
    source, out = storage.work_dir(spark, "leases"), storage.work_dir(spark, "sessions")
    fx.lease_events(spark, sf).write.parquet(source)
    stream = spark.readStream.schema(schemas.LEASE_EVENTS).parquet(source)
    query = (
        leases.stream_sessions(stream, TTL, "1 hour")
        .writeStream.option("checkpointLocation", storage.work_dir(spark, "checkpoint"))
        .trigger(availableNow=True)
        .start(out)
    )
    query.awaitTermination()
    return spark.read.schema(leases.SESSIONS).parquet(out).select(
        "token", F.col("connectors")[0].alias("connector"), ntz("start"), ntz("end"), "ended_by"
    )
