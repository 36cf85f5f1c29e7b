"""Hard negatives of anchors: rows of another label that score a little less than a positive.

An anchor's positives are the rows of its own label with the highest inner products. Negatives lie in a
window below a positive's score, so that they are hard, but not so close that they may be positives
without a label. Both are exact searches in one hyperplane tree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offsetlake.llm.common import Work
from offsetlake.llm.hyperplane_tree import NO_HIGH, NO_LOW, build, numbered, search

RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def mine(
    vectors: DataFrame,
    is_anchor: Column,
    key: str = "vec_id",
    label: str = "label",
    vector: str = "vector",
    positives: int = 5,
    negatives: int = 10,
    window: tuple[int, int] = (30, 90),
    **shape,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``vector`` holds integers and ``label`` an integer. ``is_anchor`` is a condition on the column ``id``, the key. Positives
    are the first other rows of the anchor's label, negatives the first rows of other labels whose score is
    from ``window[0]`` to ``window[1]`` percent of the positive's; higher scores come first, equal ones by key. A positive without
    negatives gives no row, and a negative score of a positive leaves an empty window.

    Rows with a null key, label or vector take no part. Every other row does: rows that repeat a key are rows
    of their own, only the anchor's own row is not its positive. Shorter vectors count as filled up with zeros, scores must fit in
    62 bits. Other columns are ignored, whatever they are called; an empty table gives an empty result.
    """
    spark = vectors.sparkSession
    work = Work(spark, "hard-negatives")
    rows = numbered(vectors, work, key, label, vector)
    index = build(rows, work, **shape)
    if index is None:
        return spark.createDataFrame([], RESULT)
    anchors = rows.filter(is_anchor).select("uid", "id", "label", "vector")
    asks = anchors.select(F.col("uid").alias("ask"), "uid", "label", "vector", F.lit(NO_LOW).alias("low"), F.lit(NO_HIGH).alias("high"))
    found = search(index, asks, work, same=True, k=positives, name="positives")
    found = found.select(F.col("ask").alias("uid"), F.col("id").alias("positive_id"), F.col("rank").alias("place"), F.col("score").alias("positive_score"))
    # Exact bounds in integers: low * p <= 100 * n <= high * p.
    least, most = window
    low = F.expr(f"-((-{least} * positive_score - pmod(-{least} * positive_score, 100L)) div 100)")
    high = F.expr(f"({most} * positive_score - pmod({most} * positive_score, 100L)) div 100")
    # Positives with one score have one window.
    windows = found.select("uid", "positive_score").distinct().withColumns({"low": low, "high": high}).filter("low <= high")
    windows = windows.join(anchors.drop("id"), "uid").withColumn("ask", F.monotonically_increasing_id())
    windows = work.keep(windows, "windows")
    hard = search(index, windows.drop("positive_score"), work, same=False, k=negatives, name="negatives")
    hard = hard.select("ask", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    hard = hard.join(windows.select("ask", "uid", "positive_score"), "ask").drop("ask")
    named = found.join(anchors.select("uid", F.col("id").alias("anchor_id")), "uid")
    return named.join(hard, ["uid", "positive_score"]).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"
    )
