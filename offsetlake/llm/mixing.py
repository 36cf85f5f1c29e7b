"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks.

The mix has as many words as the input. Sources share them by weight, none above ``cap`` times
its own words. The words of the mix are dealt out in blocks of ``block`` words: highest
quotients ``votes / (2 * seats + 1)`` first, from all blocks to the sources, then from a source's
blocks to its shards. A shard lines up its documents in a seeded order and cuts them into blocks;
its quota takes every block ``quota div blocks`` times and a seeded, evenly spread choice of
``quota mod blocks`` blocks once more. How often the words before a position are taken has a closed
form, so no row per block ever exists.

Only DataFrame operations are used. Documents are reduced to narrow rows before any shuffle, equal
rows to one row with a count, and a source of any size is split into shards of about
``shard_words`` words. Documents without a word go round shards and windows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from offsetlake.llm.common import Work, word_count

BLOCK = 16
SHARD_WORDS = 1 << 20
CAP = 3
WEIGHTS = (1, 2, 3)


def apportion(rows: DataFrame, group: Sequence[str], key: str, votes: str, seats: str) -> DataFrame:
    """Sainte-Laguë: add ``quota``, the seats of each row among the rows of its group.

    ``seats`` holds the seats of the group on each of its rows; equal quotients go to the smaller
    ``key``. Rounding ``votes / d`` gives at most the wanted seats for one divisor and at least as
    many for another, at most two seats a row apart; only quotients between the two are ranked.
    Rows without votes get no seat, and neither does any row of a group without votes.
    """
    whole = W.partitionBy(*group) if group else W.partitionBy(F.lit(0))
    rows = (
        rows.withColumn("_all", F.sum(votes).over(whole).cast("double"))
        .withColumn("_half", F.count(F.lit(1)).over(whole) / 2 + 1)
        .withColumn("_share", F.when(F.col("_all") > 0, F.col(votes) / F.col("_all")).otherwise(0.0))
        .withColumn("_base", F.floor(F.col("_share") * F.greatest(F.col(seats) - F.col("_half"), F.lit(0)) + 0.5))
        .withColumn("_base", F.when(F.col(seats) > F.col("_half"), F.col("_base")).otherwise(0))
        .withColumn("_top", F.floor(F.col("_share") * (F.col(seats) + F.col("_half")) + 0.5))
        .withColumn("_open", F.col(seats) - F.sum("_base").over(whole))
    )
    by = [*group, key]
    quotient = F.col(votes) / (2 * F.col("_seat") + 1)
    ranked = W.partitionBy(*(group or [F.lit(0)])).orderBy(quotient.desc(), key, "_seat")
    extra = (
        rows.filter(F.col("_top") > F.col("_base"))
        .withColumn("_seat", F.explode(F.sequence("_base", F.col("_top") - 1)))
        .withColumn("_rank", F.row_number().over(ranked))
        .filter(F.col("_rank") <= F.col("_open"))
        .groupBy(*by)
        .agg(F.count(F.lit(1)).alias("_extra"))
    )
    return (
        rows.join(extra, by, "left")
        .withColumn("quota", F.col("_base") + F.coalesce("_extra", F.lit(0)))
        .drop("_all", "_half", "_share", "_base", "_top", "_open", "_extra")
    )


def targets(sources: DataFrame, cap: float = CAP, weights: Sequence[int] = WEIGHTS) -> DataFrame:
    """Add ``target`` to rows (source, source_size): one narrow row per source.

    Sources by code point, null last, have the weights in turn. A level is raised until
    min(level * weight, cap * size) sums up to all words; each round caps the sources that the
    level exceeds, and no source is ever released, so the loop ends at the latest when each
    source was capped once. Only two sums a round reach the driver.
    """
    order = W.orderBy(F.col("source").asc_nulls_last())
    choices = F.array(*[F.lit(float(w)) for w in weights])
    sources = (
        sources.withColumn("source_no", F.row_number().over(order))
        .withColumn("weight", F.element_at(choices, (F.pmod(F.col("source_no") - 1, F.lit(len(weights))) + 1).cast("int")))
        .withColumn("_cap", F.col("source_size") * float(cap))
    )
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    level, capped = 0.0, -1
    while True:
        over = F.col("_cap") < F.col("weight") * level
        held, weight, count = sources.agg(
            F.coalesce(F.sum(F.when(over, F.col("_cap"))), F.lit(0.0)),
            F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0.0)),
            F.count(F.when(over, 1)),
        ).first()
        if count == capped or not weight:
            break
        level, capped = (total - held) / weight, count
    return sources.withColumn("target", F.least("_cap", F.col("weight") * level)).drop("_cap")


def _taken_before(position: Column, block: int) -> Column:
    """Words taken of those before a position of the shard, repeats counted.

    All blocks are taken ``_rounds`` times and ``_more`` of the ``_blocks`` blocks once more: block
    b is one of those if (b * _more + _phase) div _blocks grows there.
    """

    def seats(b: Column) -> Column:
        return b * F.col("_rounds") + F.floor((b * F.col("_more") + F.col("_phase")) / F.col("_blocks"))

    at = F.floor(position / block)
    return block * seats(at) + (position - block * at) * (seats(at + 1) - seats(at))


def _source_key(source: Column) -> Column:
    """A key without null, so that joins and windows treat null as one more source."""
    return F.coalesce(F.concat(F.lit("s"), source), F.lit("n"))


def mix(
    documents: DataFrame,
    key: str = "doc_id",
    source: str = "source",
    text: str = "text",
    block: int = BLOCK,
    shard_words: int = SHARD_WORDS,
    cap: int = CAP,
    weights: Sequence[int] = WEIGHTS,
    seed: int = 0,
) -> DataFrame:
    """What a mix of all documents takes: one row per document.

    Returns ``key, source, size, source_size, target, taken, copies``. ``taken`` counts the words
    that the mix takes of the document, repeats counted, at most ``cap`` times its size;
    ``copies`` rounds taken / size up or down by a seeded draw, so that whole documents have
    the same expectation. A null text has no words, a null source is the last source, and a
    null key a key like others. Rows equal in key, source and size are dealt with as one and share
    what it takes evenly, rounded down; an empty table gives an empty result. A very long text is one row
    with its word count, and columns besides the three named ones are not read, whatever their names.
    The result depends on the rows and the seed alone, not on their order or partitioning.
    """
    work = Work(documents.sparkSession, "mix")
    size = F.coalesce(F.col("_size"), F.lit(0))
    narrow = documents.select(F.col(key).alias("key"), F.col(source).alias("source"), word_count(text).alias("size"))
    units = work.keep(
        narrow.groupBy("key", "source", "size").agg(F.count(F.lit(1)).alias("rows")).withColumn("_size", F.col("size") * F.col("rows")),
        "units",
    )
    sized = units.groupBy("source").agg(F.sum("_size").alias("source_size"))
    sources = work.keep(targets(work.keep(sized, "sizes"), cap, weights), "sources")
    blocks = F.floor(F.sum("source_size").over(W.partitionBy(F.lit(0))) / block + 0.5)
    quotas = apportion(sources.withColumn("_seats", blocks), [], "source_no", "target", "_seats")
    plan = work.keep(
        quotas.select(
            _source_key(F.col("source")).alias("_source"),
            "source_no",
            "source_size",
            "target",
            F.col("quota").alias("_quota"),
            F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard_words)).alias("_shards"),
        ),
        "plan",
    )

    draw = F.xxhash64(F.lit(seed), F.col("key"), F.col("size"))
    units = (
        units.withColumn("_source", _source_key(F.col("source")))
        .join(plan, "_source")
        .withColumn("_draw", draw)
        .withColumn("_shard", F.pmod(F.xxhash64(F.lit(seed + 1), F.col("key"), F.col("size")), F.col("_shards")))
    )
    # However many documents of a source have no word, they are in no shard: the mix takes nothing of them.
    worded, bare = units.filter("_size > 0"), units.filter("_size = 0")
    shards = worded.groupBy("_source", "_shard").agg(F.sum("_size").alias("_words"), F.max("_quota").alias("_quota"))
    shards = apportion(shards, ["_source"], "_shard", "_words", "_quota").select(
        F.col("_source").alias("_s"),
        F.col("_shard").alias("_n"),
        F.ceil(F.col("_words") / block).alias("_blocks"),
        "quota",
    )
    taken_quota = F.least("quota", cap * F.col("_blocks"))
    shards = work.keep(
        shards.withColumn("_rounds", F.floor(taken_quota / F.col("_blocks")))
        .withColumn("_more", taken_quota - F.col("_rounds") * F.col("_blocks"))
        .withColumn("_phase", F.pmod(F.xxhash64(F.lit(seed + 2), "_s", "_n"), F.col("_blocks")))
        .drop("quota"),
        "shards",
    )

    line = W.partitionBy("_source", "_shard").orderBy("_draw", "key", "size").rowsBetween(W.unboundedPreceding, 0)
    end = F.col("_end")
    taken = _taken_before(end, block) - _taken_before(end - size, block)
    per_row = F.least(F.coalesce(F.floor(F.col("_taken") / F.col("rows")), F.lit(0)), cap * F.col("size"))
    chance = F.pmod(F.xxhash64(F.lit(seed + 3), F.col("key"), F.col("size")), F.lit(1 << 20)) / float(1 << 20)
    copies = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size") + chance)).otherwise(0)
    lined = (
        worded.withColumn("_end", F.sum("_size").over(line))
        .join(shards, (F.col("_source") == F.col("_s")) & (F.col("_shard") == F.col("_n")), "left")
        .withColumn("_taken", taken)
        .select(*units.columns, "_taken")
    )
    return (
        lined.unionByName(bare, allowMissingColumns=True)
        .withColumn("taken", per_row.cast("long"))
        .withColumn("copies", copies.cast("int"))
        .withColumn("_row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))))
        .select(F.col("key").alias(key), F.col("source").alias(source), "size", "source_size", "target", "taken", "copies")
    )


def mixed_documents(documents: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", **options) -> DataFrame:
    """The documents of the mix, each as often as its ``copies`` say; columns as in ``documents``.

    Documents without a word are in no mix. Rows equal in key, source and size get the same number
    of copies each.
    """
    plan = mix(documents, key, source, text, **options).filter("copies > 0")
    plan = plan.select(
        *(F.col(a).alias(f"__mix_{b}") for a, b in ((key, "key"), (source, "source"), ("size", "size"), ("copies", "copies")))
    ).distinct()
    same = (
        documents[key].eqNullSafe(F.col("__mix_key"))
        & documents[source].eqNullSafe(F.col("__mix_source"))
        & (word_count(documents[text]) == F.col("__mix_size"))
    )
    return (
        documents.join(plan, same)
        .withColumn("__mix_copy", F.explode(F.sequence(F.lit(1), F.col("__mix_copies"))))
        .select(*documents.columns)
    )
