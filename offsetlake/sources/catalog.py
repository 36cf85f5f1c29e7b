"""The catalog as a directory of commits: ``commits/<generation>.json``, folded into segments.

One commit is one file with the manifest and the new chain state, so both become visible together.
The file name is the generation, and it is created without overwriting, so of two writers that
started from the same generation one is refused.

Beside them lie segments of folded commits, named by the last generation they cover: ``deltas/n=<g>`` folds the
commits after the segment before it, ``base/n=<g>`` everything up to g. A reader takes the newest
complete base, the deltas after it, and the commits after those, however long the history is.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from offsetlake import schemas
from offsetlake.operators.audit import ViolationError
from offsetlake.operators.catalog import STATE_KEY, fold_segment, latest_by_key, merge_segments
from offsetlake.sources import storage
from offsetlake.sources.table import complete

WIDTH = 20
SEGMENT_KEYS = 100_000  # records of one file
NAMED = 100  # commits that a reader names one by one; of more it lists the folder once


def _commits(path: str) -> str:
    return f"{path}/commits"


def _file(path: str, generation: int) -> str:
    return f"{_commits(path)}/{generation:0{WIDTH}d}.json"


def commit_catalog(spark: SparkSession, path: str, manifest: dict, state: dict, expected: int) -> None:
    """Publish a manifest and its chain state; ``expected`` is the generation they build on.

    Refused when the catalog is at another generation, also when another writer gets there first.
    Only the two file names in question are looked at, however long the history is.
    """
    generation = int(state["generation"])
    builds_on = expected == 0 or storage.exists(spark, _file(path, expected))
    published = False
    if builds_on and generation == expected + 1:
        record = {
            "generation": generation,
            "records": [
                {"key": manifest["backup_id"], "value": json.dumps(manifest)},
                {"key": STATE_KEY, "value": json.dumps(state)},
            ],
        }
        published = storage.publish_text(spark, _file(path, generation), json.dumps(record) + "\n")
    if not published:
        raise ViolationError(
            [Row(rule="catalog-stale-generation", subject=path, detail=str(expected))]
        )


def _generations(spark: SparkSession, path: str) -> list[int]:
    names = [n for n in storage.children(spark, _commits(path)) if n.endswith(".json") and n[0] != "."]
    return [int(n.removesuffix(".json")) for n in names]


def current_generation(spark: SparkSession, path: str) -> int:
    return max(_generations(spark, path), default=0)


def _segments(spark: SparkSession, path: str) -> tuple[int, list[int]]:
    """The generation of the newest base, 0 without one, and those of the deltas after it."""
    base = max(complete(spark, f"{path}/base"), default=0)
    return base, [n for n in complete(spark, f"{path}/deltas") if n > base]


def _records(spark: SparkSession, path: str, generations: Sequence[int]) -> DataFrame:
    """Records of all commits from the first to the last of ``generations``."""
    named = [_file(path, n) for n in generations] if len(generations) <= NAMED else _commits(path)
    commits = spark.read.schema(
        "generation LONG, records ARRAY<STRUCT<key: STRING, value: STRING>>"
    ).option("pathGlobFilter", "*.json").json(named)
    wanted = commits.filter(F.col("generation").between(min(generations), max(generations)))
    return wanted.select("generation", F.posexplode("records").alias("i", "r")).select(
        (F.col("generation") * 2 + F.col("i")).alias("log_offset"),
        F.col("r.key").alias("key"),
        F.col("r.value").alias("value"),
    )


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """Catalog records by ``log_offset``: of folded commits the last one of every key, of later ones all."""
    base, deltas = _segments(spark, path)
    parts = [f"{path}/base/n={base}"] * bool(base) + [f"{path}/deltas/n={n}" for n in deltas]
    frames = [spark.read.schema(schemas.CATALOG).parquet(part) for part in parts]
    tail = [n for n in _generations(spark, path) if n > max([base, *deltas])]
    if tail:
        frames.append(_records(spark, path, tail))
    return reduce(DataFrame.unionByName, frames, spark.createDataFrame([], schemas.CATALOG))


def write_delta(spark: SparkSession, path: str) -> int | None:
    """Fold the commits after the last segment into a delta, deletions kept; returns its generation, or None."""
    base, deltas = _segments(spark, path)
    tail = [n for n in _generations(spark, path) if n > max([base, *deltas])]
    if not tail:
        return None
    folded = fold_segment(_records(spark, path, tail)).repartition(1).sortWithinPartitions("key")
    storage.overwriting(folded).parquet(f"{path}/deltas/n={max(tail)}")
    return max(tail)


def write_base(spark: SparkSession, path: str) -> int | None:
    """Merge the base and all deltas into a new base, which has no deletions; returns its generation, or None."""
    base, deltas = _segments(spark, path)
    if not deltas:
        return None
    read = lambda part: spark.read.schema(schemas.CATALOG).parquet(f"{path}/{part}")
    old = read(f"base/n={base}") if base else spark.createDataFrame([], schemas.CATALOG)
    merged = merge_segments(old, [read(f"deltas/n={n}") for n in deltas])
    merged = merged.repartition(max(1, -(-merged.count() // SEGMENT_KEYS))).sortWithinPartitions("key")
    storage.overwriting(merged).parquet(f"{path}/base/n={deltas[-1]}")
    return deltas[-1]


def vacuum_catalog(spark: SparkSession, path: str) -> int:
    """Remove what the base before the newest covers: commits, deltas and older bases; returns how many paths.

    The newest commit always stays, since the next one builds on its file.
    """
    bases = complete(spark, f"{path}/base")
    if len(bases) < 2:
        return 0
    covered, newest = bases[-2], current_generation(spark, path)
    gone = [_file(path, n) for n in _generations(spark, path) if n <= covered and n < newest]
    gone += [f"{path}/deltas/n={n}" for n in complete(spark, f"{path}/deltas") if n <= covered]
    gone += [f"{path}/base/n={n}" for n in bases[:-2]]
    for one in gone:
        storage.remove(spark, one)
    return len(gone)


def read_state(spark: SparkSession, path: str) -> dict | None:
    """The current chain state."""
    rows = latest_by_key(read_catalog(spark, path).filter(F.col("key") == STATE_KEY)).collect()
    return json.loads(rows[0].value) if rows else None
