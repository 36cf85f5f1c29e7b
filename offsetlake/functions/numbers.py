from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_I64 = 2**63 - 1
MAX_U64 = 2**64 - 1


def u64(value: Column) -> Column:
    """Unsigned 64-bit values do not fit a long; hold them as decimals until audited."""
    return value.cast("decimal(20,0)")


def next_offset(max_offset: Column) -> Column:
    """The exclusive next offset after the last processed one; 0 if nothing was processed."""
    return F.coalesce(max_offset + F.lit(1).cast("decimal(20,0)"), u64(F.lit(0)))
