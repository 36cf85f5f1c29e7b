"""The backup catalog, chains, recovery requests and health reports."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from checks.registry import check
from offsetlake import fixtures as fx
from offsetlake import schemas
from offsetlake.functions import ledger_key
from offsetlake.operators import audit, catalog, health, ledger, recovery
from offsetlake.sources import catalog as catalog_files
from offsetlake.sources import storage

def run_number():
    return F.regexp_extract("backup_id", r"([0-9]+)\z", 1).cast("long")



def first_offset(connectors, index, change):
    """Replace the first offset of one connector of a manifest."""

    def lower(c, i):
        offsets = F.transform(
            c["offsets"],
            lambda o, j: F.when(
                j == 0,
                F.struct(
                    o["topic"].alias("topic"),
                    o["partition"].alias("partition"),
                    change(o["offset"]).cast("decimal(20,0)").alias("offset"),
                ),
            ).otherwise(o),
        )
        return F.when(i == index, c.withField("offsets", offsets)).otherwise(c)

    return F.transform(connectors, lower)


def broken_history(spark, sf):
    """Of every nine runs, 4 is lost, 7 names an unknown parent and 8 falls back to offset 1."""
    rows = fx.manifests(spark, sf).filter(run_number() % 9 != 4)
    return rows.withColumns(
        {
            "parent_id": F.when(run_number() % 9 == 7, F.concat(F.lit("unknown-"), run_number().cast("string"))).otherwise(
                F.col("parent_id")
            ),
            "connectors": F.when(
                run_number() % 9 == 8, first_offset("connectors", 0, lambda _: F.lit(1))
            ).otherwise(F.col("connectors")),
        }
    )


@check(
    "catalog_lookup",
    """SELECT l.key AS "key", l.log_offset, l.created_at, r.kind, r.chain_id, r.position
       FROM latest l JOIN runs r ON r.backup_id = l.key WHERE l.key = 'run-0'""",
)
def catalog_lookup(spark, sf):
    found = catalog.lookup(fx.catalog(spark, sf), "run-0")
    manifest = catalog.parse_manifests(found)
    return found.select("key", "log_offset").join(
        manifest.select("key", "created_at", "kind", "chain_id", "position"), "key"
    )


@check(
    "catalog_audit",
    """SELECT CASE run % 4 WHEN 0 THEN 'catalog-invalid-json' WHEN 1 THEN 'catalog-key-mismatch'
                         ELSE 'catalog-unknown-field' END AS rule,
              CASE WHEN run % 4 = 1 THEN 'other-' || run ELSE backup_id END AS subject,
              CAST(NULL AS VARCHAR) AS detail
       FROM runs JOIN latest ON key = backup_id WHERE run % 4 < 3""",
)
def catalog_audit(spark, sf):
    """Of the newest manifests every fourth is cut short, under another key, and with a field of its own."""
    latest = catalog.latest_by_key(fx.catalog(spark, sf))
    run = F.regexp_extract("key", r"([0-9]+)\z", 1).try_cast("long")
    backup = F.col("key") != catalog.STATE_KEY
    broken = latest.withColumns(
        {
            "value": F.when(backup & (run % 4 == 0), F.expr("substr(value, 1, length(value) - 9)"))
            .when(backup & (run % 4 == 2), F.concat(F.expr("substr(value, 1, length(value) - 1)"), F.lit(',"extra":1}')))
            .otherwise(F.col("value")),
            "key": F.when(backup & (run % 4 == 1), F.concat(F.lit("other-"), run.cast("string"))).otherwise(F.col("key")),
        }
    )
    return catalog.audit_catalog(broken)


@check(
    "pipeline_audit",
    """, p AS (
         SELECT p_partkey AS n, CASE WHEN p_partkey % 10 = 3 THEN 'a b' ELSE 'c-' || (p_partkey - (p_partkey % 10 = 9)::INT) END AS connector,
                CASE WHEN p_partkey % 10 = 4 THEN NULL WHEN p_partkey % 10 = 8 THEN 't.same' ELSE 't.' || p_partkey END AS topic,
                CASE WHEN p_partkey % 10 = 5 THEN '1x' ELSE 'records' END AS tab, p_partkey % 7 AS partitions
         FROM part)
       SELECT rule, subject, CAST(NULL AS VARCHAR) AS detail FROM (
         SELECT 'pipeline-connector' AS rule, connector AS subject FROM p WHERE n % 10 = 3
         UNION ALL SELECT 'pipeline-topic', connector FROM p WHERE n % 10 = 4
         UNION ALL SELECT 'pipeline-table', connector FROM p WHERE n % 10 = 5
         UNION ALL SELECT 'pipeline-partitions', connector FROM p WHERE partitions < 1
         UNION ALL SELECT 'pipeline-connector-repeated', connector FROM p GROUP BY ALL HAVING count(*) > 1
         UNION ALL SELECT 'pipeline-topic-repeated', topic FROM p WHERE topic IS NOT NULL GROUP BY ALL HAVING count(*) > 1)""",
)
def pipeline_audit(spark, sf):
    """A pipeline per part: names with a blank, without a topic, no partitions, and repeats."""
    n = F.col("p_partkey")
    name = F.concat(F.lit("c-"), (n - (n % 10 == 9).cast("int")).cast("string"))
    topic = F.when(n % 10 == 8, "t.same").otherwise(F.concat(F.lit("t."), n.cast("string")))
    pipelines = spark.read.parquet(f"{sf}/part.parquet").select(
        F.when(n % 10 == 3, "a b").otherwise(name).alias("connector"),
        F.when(n % 10 != 4, topic).alias("topic"),
        F.when(n % 10 == 5, "1x").otherwise("records").alias("table"),
        (n % 7).cast("int").alias("partitions"),
    )
    return catalog.audit_pipelines(pipelines)


@check(
    "catalog_compact",
    """SELECT key AS "key", log_offset, created_at FROM latest""",
)
def catalog_compact(spark, sf):
    return catalog.latest_by_key(fx.catalog(spark, sf)).select(
        "key", "log_offset", F.get_json_object("value", "$.created_at").alias("created_at")
    )


@check(
    "catalog_segments",
    """SELECT key AS "key", log_offset, created_at FROM latest""",
)
def catalog_segments(spark, sf):
    """The same from segments: a base, deltas merged among themselves, and a last delta, at uneven cuts."""
    records = fx.catalog(spark, sf)
    last = fx.checkpoints(spark, sf).agg(F.max("run")).first()[0]
    cuts = [0, last // 2, last + 1, 1_000_000_000 + last, 2_000_000_000 + last // 3, 1 << 62]
    pieces = [records.filter((F.col("log_offset") >= a) & (F.col("log_offset") < b)) for a, b in zip(cuts, cuts[1:], strict=False)]
    folded = [catalog.fold_segment(p) for p in pieces]
    base = storage.written(catalog.merge_segments(folded[0].limit(0), folded[:1]), "base")
    middle = storage.written(catalog.merge_segments(None, [folded[3], folded[1]]), "middle")
    merged = catalog.merge_segments(base, [folded[4], middle, folded[2]])
    return merged.select("key", "log_offset", F.get_json_object("value", "$.created_at").alias("created_at"))


@check(
    "catalog_commit",
    """SELECT (run + 1) * 2 + i AS log_offset,
              CASE WHEN i = 0 THEN backup_id ELSE 'chain-state' END AS "key"
       FROM runs, (VALUES (0), (1)) AS v(i)""",
)
def catalog_commit(spark, sf):
    """The whole history committed run by run, as a backup job would over time."""
    path = storage.work_dir(spark, "catalog")
    rows = fx.manifests(spark, sf).select(
        run_number().alias("run"), F.to_json(F.struct(*schemas.MANIFESTS.names)).alias("manifest")
    )
    for row in rows.orderBy("run").toLocalIterator():
        manifest = json.loads(row.manifest)
        state = {"generation": row.run + 1, "chain_id": manifest["chain_id"]}
        catalog_files.commit_catalog(spark, path, manifest, state, row.run)
    return catalog_files.read_catalog(spark, path).select("log_offset", "key")


@check(
    "flatten_offsets",
    """SELECT 'run-' || c.run AS backup_id, p.connector, c.part AS "index", c.topic,
              c.part AS "partition", c.off AS "offset"
       FROM ckpt c JOIN pipelines p USING (topic)""",
)
def flatten_offsets(spark, sf):
    return catalog.flatten_offsets(fx.manifests(spark, sf))


@check(
    "recovery_connectors",
    """SELECT DISTINCT 'run-' || c.run AS backup_id, p.connector, c.topic
       FROM ckpt c JOIN pipelines p USING (topic) WHERE p.tab = 'records'""",
)
def recovery_connectors(spark, sf):
    return catalog.recovery_connectors(fx.manifests(spark, sf), "main", "records")


@check(
    "latest_backups",
    """SELECT backup_id, kind, created_at FROM runs ORDER BY created_at DESC, backup_id DESC LIMIT 5""",
)
def latest_backups(spark, sf):
    return catalog.latest_backups(fx.manifests(spark, sf), 5).select("backup_id", "kind", "created_at")


@check(
    "chain_walk",
    """, m AS (SELECT backup_id, parent_id FROM runs WHERE run % 9 <> 4),
       walk AS (
         SELECT backup_id AS tip, 0 AS step, backup_id FROM runs WHERE run % 3 = 2
         UNION ALL
         SELECT w.tip, w.step + 1, m.parent_id FROM walk w JOIN m USING (backup_id)
         WHERE m.parent_id IS NOT NULL)
       SELECT w.tip, w.step, w.backup_id, m.parent_id, m.backup_id IS NOT NULL AS "found",
              false AS repeated
       FROM walk w LEFT JOIN m USING (backup_id)""",
)
def chain_walk(spark, sf):
    """Every closed chain from its tip; in one of three the middle manifest is missing."""
    rows = fx.manifests(spark, sf)
    tips = rows.filter(run_number() % 3 == 2).select("backup_id")
    return catalog.walk_chain(rows.filter(run_number() % 9 != 4), tips)


@check(
    "chain_audit",
    """, m AS (
         SELECT * REPLACE (CASE WHEN run % 9 = 7 THEN 'unknown-' || run ELSE parent_id END AS parent_id)
         FROM runs WHERE run % 9 <> 4),
       state AS (
         SELECT chain_id, max(position) AS incrementals, max(run) AS tip, min(run) AS root
         FROM runs GROUP BY ALL),
       o AS (
         SELECT run, topic, part, CASE WHEN run % 9 = 8 AND topic = 'events.input' AND part = 0
                                       THEN 1 ELSE off END AS off FROM ckpt)
       SELECT 'chain-count' AS rule, s.chain_id AS subject, CAST(NULL AS VARCHAR) AS detail
       FROM state s LEFT JOIN m USING (chain_id)
       GROUP BY s.chain_id, incrementals HAVING count(m.run) <> incrementals + 1
       UNION ALL
       SELECT 'chain-tip', chain_id, NULL FROM state s WHERE tip % 9 IN (4, 7)
       UNION ALL
       SELECT 'chain-missing-parent', backup_id, chain_id FROM m
       WHERE parent_id IS NOT NULL AND parent_id NOT IN (SELECT backup_id FROM m)
       UNION ALL
       SELECT DISTINCT 'chain-offsets-backwards', m.backup_id, m.chain_id
       FROM m JOIN m p ON p.backup_id = m.parent_id
       JOIN o c ON c.run = m.run
       JOIN o q ON q.run = p.run AND q.topic = c.topic AND q.part = c.part WHERE c.off < q.off""",
)
def chain_audit(spark, sf):
    pipelines = fx.fed_pipelines(spark)
    states = fx.chain_states(fx.manifests(spark, sf), pipelines)
    return catalog.audit_chain(broken_history(spark, sf), states, pipelines)


@check(
    "manifest_audit",
    """SELECT rule, backup_id AS subject, CAST(NULL AS VARCHAR) AS detail FROM (
         SELECT 'manifest-chain-id' AS rule, * FROM runs WHERE run % 16 = 1
         UNION ALL SELECT 'manifest-destination', * FROM runs WHERE run % 16 = 2
         UNION ALL SELECT 'manifest-kind', * FROM runs WHERE run % 16 = 3
         UNION ALL SELECT 'manifest-no-connectors', * FROM runs WHERE run % 16 = 4
         UNION ALL SELECT 'manifest-duplicate-connector', * FROM runs WHERE run % 16 = 5
         UNION ALL SELECT 'manifest-offset-value', * FROM runs WHERE run % 16 = 6
         UNION ALL SELECT 'manifest-partitions', * FROM runs WHERE run % 16 = 7
         UNION ALL SELECT 'manifest-names', * FROM runs WHERE run % 16 = 8
         UNION ALL SELECT 'manifest-ledger', * FROM runs WHERE run % 16 = 9
         UNION ALL SELECT 'manifest-observed-range', * FROM runs WHERE run % 16 = 10
         UNION ALL SELECT 'manifest-offset-order', * FROM runs WHERE run % 16 = 11
         UNION ALL SELECT 'manifest-stray-ledger', * FROM runs WHERE run % 16 = 12
         UNION ALL SELECT 'manifest-duplicate-offset', * FROM runs WHERE run % 16 = 13
         UNION ALL SELECT 'manifest-parent-destination', * FROM runs
                   WHERE run % 16 = 14 AND parent_id IS NOT NULL)""",
)
def manifest_audit(spark, sf):
    """Of every sixteen runs, each of fourteen breaks one rule."""

    def when(slot, column, value):
        return F.when(run_number() % 16 == slot, value).otherwise(F.col(column))

    one = F.lit(1).cast("decimal(20,0)")
    connectors = F.col("connectors")

    def each(change):
        return F.transform(connectors, change)

    def ledger_row(key):
        return F.struct(
            key.alias("key"),
            (one - one).cast("decimal(20,0)").alias("min_offset"),
            one.alias("max_offset"),
            F.lit(ledger.FINISHED).alias("state"),
        )

    def observed(topic, *partitions):
        return F.array(
            *[
                F.struct(
                    topic.alias("topic"),
                    F.lit(p).cast("int").alias("partition"),
                    (one - one).cast("decimal(20,0)").alias("offset"),
                )
                for p in partitions
            ]
        )

    changed = {
        4: F.array().cast(schemas.MANIFESTS["connectors"].dataType),
        5: F.concat(connectors, connectors),
        6: first_offset("connectors", 0, lambda o: o + 1),
        7: each(lambda c: c.withField("partitions", c["partitions"] + 1)),
        8: each(lambda c: c.withField("table", F.lit("no-identifier"))),
        9: each(
            lambda c: c.withField(
                "ledger", F.transform(c["ledger"], lambda r: r.withField("state", F.lit("OPEN")))
            )
        ),
        10: each(lambda c: c.withField("observed", observed(c["topic"], 77))),
        11: each(lambda c: c.withField("offsets", F.reverse(c["offsets"]))),
        12: each(
            lambda c: c.withField(
                "ledger", F.concat(c["ledger"], F.array(ledger_row(ledger_key(c["topic"], F.lit(88)))))
            )
        ),
        13: each(lambda c: c.withField("observed", observed(c["topic"], 0, 0))),
    }
    broken = F.col("connectors")
    for slot, value in changed.items():
        broken = F.when(run_number() % 16 == slot, value).otherwise(broken)
    rows = fx.manifests(spark, sf).withColumns(
        {
            "connectors": broken,
            "chain_id": when(1, "chain_id", F.lit("no chain")),
            "name": when(2, "name", F.lit("store:a/../b")),
            "position": when(3, "position", -F.col("position") - 1),
            "parent_name": when(14, "parent_name", F.lit("store:")),
        }
    )
    return catalog.audit_manifests(rows)


@check(
    "backup_plan",
    """, r AS (
         SELECT 'run-' || (event_id // 500) AS run_id, min(ts) AS started_at FROM events GROUP BY 1),
       n AS (SELECT *, row_number() OVER (ORDER BY started_at, run_id) - 1 AS n FROM r)
       SELECT a.run_id, CASE WHEN a.n % 3 = 0 THEN 'full' ELSE 'incremental' END AS kind,
              c.run_id AS chain_id, a.n % 3 AS position, p.run_id AS parent_id, a.n + 1 AS generation
       FROM n a JOIN n c ON c.n = a.n - a.n % 3
       LEFT JOIN n p ON p.n = a.n - 1 AND a.n % 3 > 0""",
)
def backup_plan(spark, sf):
    events = spark.read.parquet(f"{sf}/events.parquet")
    run = F.concat(F.lit("run-"), F.expr("event_id div 500").cast("string"))
    runs = events.groupBy(run.alias("run_id")).agg(F.min("ts").alias("started_at"))
    return catalog.plan_backups(runs, fx.MAX_INCREMENTALS)


@check(
    "chain_ranges",
    """SELECT r.chain_id, r.position, r.backup_id, c.topic, c.part AS "partition",
              coalesce(p.off, 0) AS start, c.off AS target
       FROM ckpt c JOIN runs r USING (run)
       LEFT JOIN ckpt p ON r.position > 0 AND p.run = c.run - 1 AND p.topic = c.topic
                       AND p.part = c.part""",
)
def chain_ranges(spark, sf):
    return catalog.chain_ranges(fx.manifests(spark, sf))


def requests(spark, sf):
    """A request per backup: every fourth follows, the others aim at the end of the log."""
    ends = fx.vector(fx.wide_log(spark, sf)).select(
        F.struct("topic", "partition", F.col("offset").cast("decimal(20,0)").alias("offset")).alias("t")
    )
    targets = ends.agg(F.sort_array(F.collect_list("t")).alias("targets"))
    vector = targets.collect()[0].targets
    literal = F.array(
        *[
            F.struct(
                F.lit(t.topic).alias("topic"),
                F.lit(t.partition).alias("partition"),
                F.lit(t.offset).cast("decimal(20,0)").alias("offset"),
            )
            for t in vector
        ]
    )
    return fx.manifests(spark, sf).select(
        F.concat(F.lit("recover-"), "backup_id").alias("id"),
        "backup_id",
        F.lit("main").alias("source_database"),
        F.lit("records").alias("source_table"),
        F.lit("main").alias("dest_database"),
        F.lit("pitr_records").alias("dest_table"),
        F.when(run_number() % 4 != 3, literal).alias("targets"),
    )


@check(
    "recovery_plan",
    """, ends AS (SELECT topic, part, max(off) + 1 AS off FROM log GROUP BY ALL)
       SELECT 'recover-run-' || c.run AS id, p.connector,
              CASE WHEN c.run % 4 <> 3 THEN 'point-in-time' ELSE 'follow' END AS mode,
              c.topic, c.part AS "partition", c.off AS start,
              CASE WHEN c.run % 4 <> 3 THEN e.off END AS target
       FROM ckpt c JOIN pipelines p USING (topic)
       JOIN ends e ON e.topic = c.topic AND e.part = c.part""",
)
def recovery_plan(spark, sf):
    return recovery.recovery_plan(requests(spark, sf), fx.manifests(spark, sf))


@check(
    "recovery_audit",
    """SELECT rule, 'recover-' || backup_id AS subject, CAST(NULL AS VARCHAR) AS detail FROM (
         SELECT 'recovery-name' AS rule, * FROM runs WHERE run % 5 = 1
         UNION ALL SELECT 'recovery-same-table', * FROM runs WHERE run % 5 = 2
         UNION ALL SELECT 'recovery-unknown-backup', * FROM runs WHERE run % 5 = 3
         UNION ALL SELECT 'recovery-no-source-table', * FROM runs WHERE run % 5 = 4)
       UNION ALL
       SELECT 'target-missing', 'orders.input-' || part, 'recover-' || backup_id
       FROM runs, (VALUES (0), (1)) AS v(part) WHERE run % 5 = 0 AND run % 4 <> 3
       UNION ALL
       SELECT 'target-unknown', 'events.input-' || part, 'recover-run-' || run
       FROM runs, (VALUES (0), (1), (2)) AS v(part) WHERE run % 5 = 3 AND run % 4 <> 3""",
)
def recovery_audit(spark, sf):
    """Of every five requests, each breaks another rule; an unknown backup has no start at all."""

    def when(slot, column, value):
        return F.when(run_number() % 5 == slot, value).otherwise(F.col(column))

    rows = requests(spark, sf)
    events = F.filter("targets", lambda t: t["topic"] == fx.EVENTS)
    rows = rows.withColumns(
        {
            "targets": F.when(run_number() % 5 == 0, events)
            .when(run_number() % 5 == 3, events)
            .otherwise(F.col("targets")),
            "dest_table": when(1, "dest_table", F.lit("no-identifier")),
            "source_table": when(4, "source_table", F.lit("nothing")),
        }
    ).withColumns(
        {
            "dest_table": when(2, "dest_table", F.col("source_table")),
            "backup_id": when(3, "backup_id", F.concat(F.lit("lost-"), "backup_id")),
        }
    )
    return recovery.audit_recoveries(rows, fx.manifests(spark, sf))


@check(
    "targets_audit",
    """, s AS (SELECT topic, part, max(off) + 1 AS off FROM log
               WHERE topic = 'events.input' AND ts < TIMESTAMP '2024-01-21' GROUP BY ALL)
       SELECT rule, topic || '-' || part AS subject, CAST(NULL AS VARCHAR) AS detail FROM (
         SELECT 'target-before-start' AS rule, topic, part FROM s WHERE part = 0
         UNION ALL SELECT 'target-duplicate', topic, part FROM s WHERE part = 1
         UNION ALL SELECT 'target-missing', topic, part FROM s WHERE part = 2
         UNION ALL SELECT 'target-unknown', topic, part
         FROM log WHERE topic = 'orders.input' GROUP BY ALL)""",
)
def targets_audit(spark, sf):
    """Partition 0 is below its start, 1 is there twice, 2 is missing, and a topic is unknown."""
    log = fx.wide_log(spark, sf)
    events = log.filter(F.col("topic") == fx.EVENTS)
    starts = fx.vector(events, "2024-01-21")
    low = starts.filter("partition = 0").withColumn("offset", F.col("offset") - 1)
    twice = fx.vector(events, fx.TARGET_CUT).filter("partition = 1")
    other = fx.vector(log.filter(F.col("topic") == fx.ORDERS))
    return recovery.audit_targets(starts, audit.union([low, twice, twice, other]))


@check(
    "delivery_lag",
    """SELECT l.topic, l.part AS "partition", max(l.off) + 1 - any_value(e.off) AS lag
       FROM log l JOIN exact e ON e.topic = l.topic AND e.part = l.part GROUP BY ALL""",
)
def delivery_lag(spark, sf):
    from offsetlake.operators.bounds import log_bounds

    exact = ledger.exact_offsets(fx.pipelines(spark), ledger.fold_ledger(fx.ledger(spark, sf)))
    return health.delivery_lag(log_bounds(fx.wide_log(spark, sf)), exact)


@check(
    "retention_headroom",
    """SELECT 'run-' || c.run AS backup_id, c.topic, c.part AS "partition", c.off - b.low AS headroom
       FROM ckpt c LEFT JOIN bounds b ON b.topic = c.topic AND b.part = c.part""",
)
def retention_headroom(spark, sf):
    low_high = fx.retained_bounds(fx.wide_log(spark, sf))
    return health.retention_headroom(fx.manifests(spark, sf), low_high)


@check(
    "backup_report",
    """, expected AS (
         SELECT r.run, CASE WHEN run % 6 = 5 THEN 'BACKUP_FAILED' WHEN run % 9 = 4 THEN 'MISSING'
                            ELSE 'BACKUP_CREATED' END AS status,
                CASE WHEN run % 9 <> 4 THEN created_at END AS created_at FROM runs r)
       SELECT status, count(*) AS runs,
              date_diff('second', CAST(replace(replace(max(created_at), 'T', ' '), 'Z', '') AS TIMESTAMP),
                        TIMESTAMP '2025-01-01') AS age_seconds
       FROM expected GROUP BY ALL""",
)
def backup_report(spark, sf):
    rows = fx.manifests(spark, sf)
    status = F.when(run_number() % 6 == 5, "BACKUP_FAILED").otherwise("BACKUP_CREATED")
    runs = rows.select(F.col("backup_id").alias("run_id"), status.alias("status"))
    now = F.to_timestamp(F.lit("2025-01-01T00:00:00Z"), "yyyy-MM-dd'T'HH:mm:ssX")
    return health.backup_report(rows.filter(run_number() % 9 != 4), runs, now)


@check(
    "closed_chains",
    """SELECT chain_id, count(*) AS backups FROM runs
       WHERE chain_id <> (SELECT arg_max(chain_id, run) FROM runs)
         AND chain_id NOT IN (SELECT chain_id FROM runs WHERE run % 7 = 6) GROUP BY ALL""",
)
def closed_chains(spark, sf):
    """The newest chain is open, and every seventh backup is to be kept."""
    rows = fx.manifests(spark, sf)
    states = fx.chain_states(rows, fx.fed_pipelines(spark))
    newest = states.orderBy(F.desc("generation")).limit(1)
    return catalog.closed_chains(rows, newest, rows.filter(run_number() % 7 == 6).select("backup_id"))
