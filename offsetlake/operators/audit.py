"""Audits return violation rows (rule, subject, detail); ``require`` fails closed on any."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from offsetlake.functions.hashing import plain


class ViolationError(RuntimeError):
    """Raised by :func:`require`; carries the first violations found."""

    def __init__(self, rows, more: bool = False):
        self.rows, self.more = rows, more
        told = [f"{r.rule}: {r.subject} {r.detail or ''}".strip() for r in rows]
        super().__init__("; ".join([*told, "and more"] if more else told))


def require(violations: DataFrame, show: int = 20) -> None:
    # One job over all branches; take() would try the partitions of the union little by little.
    rows = violations.limit(show + 1).toArrow().to_pylist()
    if rows:
        raise ViolationError([Row(**row) for row in rows[:show]], more=len(rows) > show)


def violation(rows: DataFrame, rule: str, subject: Column, detail: Column | None = None):
    """All ``rows`` as violations of one rule."""
    detail = F.lit(None) if detail is None else detail
    return rows.select(
        F.lit(rule).alias("rule"),
        subject.cast("string").alias("subject"),
        detail.cast("string").alias("detail"),
    )


def union(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def broken_rules(
    rows: DataFrame, subject: Column, rules: Mapping[str, Column], detail: Column | None = None
) -> DataFrame:
    """One violation per row and rule that is true (or null) on it, in a single narrow pass."""
    named = [
        F.when(F.coalesce(broken, F.lit(True)), F.lit(name)) for name, broken in rules.items()
    ]
    detail = F.lit(None) if detail is None else detail
    return rows.select(
        F.explode(F.filter(F.array(*named), lambda rule: rule.isNotNull())).alias("rule"),
        subject.cast("string").alias("subject"),
        detail.cast("string").alias("detail"),
    )


def duplicates(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their count."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")


def diff_rows(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows on one side only, with how many copies are missing on the other; order is ignored.

    One grouped sum over both sides instead of two ``exceptAll``; equal rows cancel out before
    the shuffle when they meet in one task, and empty output means equal multisets. Maps come
    back as arrays of their entries in the order of the keys.
    """
    columns = left.columns
    left, right = (side.select(*[plain(side[c], side.schema[c].dataType).alias(c) for c in columns]) for side in (left, right))
    both = left.withColumn("_n", F.lit(1)).unionByName(right.withColumn("_n", F.lit(-1)))
    copies = both.groupBy(*columns).agg(F.sum("_n").alias("_n")).filter("_n <> 0")
    return copies.select(
        F.when(F.col("_n") > 0, "left").otherwise("right").alias("side"),
        *columns,
        F.abs("_n").alias("copies"),
    )


def verify_table(rows: DataFrame, key: str, predicates: Mapping[str, Column]) -> DataFrame:
    """Row count, exact distinct keys and one conditional count per named predicate.

    Rows are folded per key first: a hot key collapses on the map side, and the distinct count
    is then a plain count of the folded rows.
    """
    per_key = rows.groupBy(key).agg(
        F.count(F.lit(1)).alias("_rows"),
        *[F.count_if(predicate).alias(f"_{name}") for name, predicate in predicates.items()],
    )
    return per_key.agg(
        F.coalesce(F.sum("_rows"), F.lit(0)).alias("row_count"),
        F.count(key).alias("distinct_keys"),
        *[F.coalesce(F.sum(f"_{name}"), F.lit(0)).alias(name) for name in predicates],
    )
