"""Mark and sweep of what crashed or finished runs left behind.

Files are listed by Spark and folded to the directories that are written as one: batches, checkpoints and segments of
tables; data and block lists of backups. What can be reached stays: batches that the ledger or a segment names,
finished entries, and backups on a chain from a root. The rest is marked, if nothing in it changed within a grace
period, and removed by a second, explicit call.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from offsetlake import schemas
from offsetlake.operators.catalog import walk_chain
from offsetlake.operators.skew import join_control
from offsetlake.sources import storage
from offsetlake.sources import table as tables
from offsetlake.sources.zones import list_files

ORPHANS = schemas.struct(reason=schemas.STRING, path=schemas.STRING, unit=schemas.STRING, files=schemas.LONG, bytes=schemas.LONG, modified=schemas.TIME)
SWEPT = 100_000


def _units(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    """``path, unit, files, bytes, modified`` of the directories below a root that match; the group is the unit's name."""
    files = list_files(spark, root)
    begin = F.regexp_extract("file", f"^(.*?/{pattern})/", 1)
    units = files.withColumns({"path": begin, "unit": F.regexp_extract("file", f"^.*?/{pattern}/", 2)}).filter("path <> ''")
    return units.groupBy("path", "unit").agg(F.count(F.lit(1)).alias("files"), F.sum("bytes").alias("bytes"), F.max("modified").alias("modified"))


def _marked(units: DataFrame, reason: Column | str) -> DataFrame:
    reason = F.lit(reason) if isinstance(reason, str) else reason
    return units.withColumn("reason", reason).select(*ORPHANS.names)


def table_orphans(spark: SparkSession, table: str) -> DataFrame:
    """Batches without a commit, and checkpoints and segments that were not finished."""
    found = []
    committed = tables.read_ledger(spark, table).select(F.col("batch_id").alias("unit")).distinct()
    batches = _units(spark, f"{table}/data", "(batch_id=([^/]+))")
    found.append(_marked(join_control(batches, committed, ["unit"], "left_anti"), "uncommitted-batch"))
    for kind, marker, reason in (("checkpoints", "_SUCCESS", "unfinished-checkpoint"), ("segments", "batches/_SUCCESS", "unfinished-segment")):
        done = [str(n) for n in tables.complete(spark, f"{table}/{kind}", marker)]
        units = _units(spark, f"{table}/{kind}", "(n=([0-9]+))")
        found.append(_marked(units.filter(~F.col("unit").isin(done)) if done else units, reason))
    return reduce(DataFrame.unionByName, found)


def reachable_backups(manifests: DataFrame, roots: DataFrame) -> DataFrame:
    """``backup_id`` of the roots and of all backups that they build on."""
    return walk_chain(manifests, roots.select("backup_id")).filter("found").select("backup_id").distinct()


def archive_orphans(spark: SparkSession, archive: str, manifests: DataFrame, roots: DataFrame) -> DataFrame:
    """Backups of an archive that were not finished, that no manifest names, or whose chain no root holds.

    ``roots`` are the backups to keep by themselves, the tip of the open chain first of all.
    """
    units = _units(spark, f"{archive}/data", "(backup=([^/]+)/table=[^/]+)").unionByName(
        _units(spark, f"{archive}/blocks", "(backup=([^/]+)/table=[^/]+)")
    )
    units = storage.settled(units.withColumn("place", F.regexp_extract("path", "(backup=[^/]+/table=[^/]+)$", 1)), "units")
    # One marker per backup and table, looked up by name.
    places = [r.place for r in units.select("place").distinct().toLocalIterator()]
    done = [(p,) for p in places if storage.exists(spark, f"{archive}/blocks/{p}/_SUCCESS")]
    finished = spark.createDataFrame(done, "place STRING").withColumn("_done", F.lit(True))
    named = manifests.select(F.col("backup_id").alias("unit")).distinct().withColumn("_named", F.lit(True))
    kept = reachable_backups(manifests, roots).select(F.col("backup_id").alias("unit")).withColumn("_kept", F.lit(True))
    known = units.join(finished, "place", "left").join(named, "unit", "left").join(kept, "unit", "left")
    reason = (
        F.when(F.col("_done").isNull(), "unfinished-backup").when(F.col("_named").isNull(), "uncommitted-backup").when(F.col("_kept").isNull(), "closed-chain")
    )
    return _marked(known, reason).filter("reason IS NOT NULL")


def settled_since(orphans: DataFrame, before) -> DataFrame:
    """Orphans in which nothing changed at or after a moment: a run that is still writing is none."""
    return orphans.filter(F.col("modified") < F.lit(before).cast("timestamp"))


def sweep(spark: SparkSession, orphans: DataFrame, roots: Sequence[str]) -> int:
    """Remove marked paths, at most ``SWEPT`` a call, and only below the given roots; returns how many."""
    inside = reduce(lambda a, b: a | b, [F.col("path").startswith(_plain(spark, root)) for root in roots])
    rows = orphans.filter(inside).select("path").distinct().limit(SWEPT).collect()
    for row in rows:
        storage.remove(spark, row.path)
    return len(rows)


def _plain(spark: SparkSession, path: str) -> str:
    """A path as file listings name it."""
    return storage.qualified(spark, path).rstrip("/") + "/"
