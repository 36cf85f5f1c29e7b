"""Ledger keys have the form ``<topic>-<partition>``."""

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_U32 = 2**32 - 1


def ledger_key(topic: Column, partition: Column) -> Column:
    return F.concat_ws("-", topic, partition.cast("string"))


def ledger_topic(key: Column) -> Column:
    """Everything before the last dash; topics may hold dashes themselves."""
    return F.regexp_extract(key, r"\A(.*)-[^-]*\z", 1)


def ledger_partition(suffix: Column) -> Column:
    """The partition as a number, or null if the text is not an unsigned 32-bit number.

    Leading zeros and one plus sign are accepted, so ``01`` and ``1`` are the same partition.
    """
    digits = F.regexp_extract(suffix, r"\A\+?0*([0-9]{1,10})\z", 1)
    number = F.when(digits != "", digits).cast("long")
    return F.when(number <= MAX_U32, number)
