from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The public 32-bit FNV-1a parameters.
FNV_OFFSET_BASIS = 2166136261
FNV_PRIME = 16777619


def fnv1a32(text: Column) -> Column:
    """32-bit FNV-1a of the UTF-8 bytes of a name, as a long."""
    digits = F.hex(F.encode(text, "UTF-8"))
    octets = F.when(
        F.length(digits) > 0, F.sequence(F.lit(0), (F.length(digits) / 2 - 1).cast("int"))
    ).otherwise(F.array().cast("array<int>"))

    def step(state: Column, position: Column) -> Column:
        octet = F.conv(F.substring(digits, position * 2 + 1, F.lit(2)), 16, 10).cast("long")
        return state.bitwiseXOR(octet) * F.lit(FNV_PRIME) % F.lit(2**32)

    return F.aggregate(octets, F.lit(FNV_OFFSET_BASIS).cast("long"), step)


def has_map(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return any(has_map(f.dataType) for f in kind.fields)
    return isinstance(kind, T.MapType) or isinstance(kind, T.ArrayType) and has_map(kind.elementType)


def plain(column: Column, kind: T.DataType) -> Column:
    """The value with every map, nested ones too, as an array of its entries in the order of the keys.

    Maps can be neither hashed nor grouped, and equal ones may list their entries differently.
    """
    if not has_map(kind):
        return column
    if isinstance(kind, T.MapType):
        entries = F.transform(
            F.map_entries(column),
            lambda e: F.struct(e["key"].alias("key"), plain(e["value"], kind.valueType).alias("value")),
        )
        return F.array_sort(entries, lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0))
    if isinstance(kind, T.ArrayType):
        return F.transform(column, lambda x: plain(x, kind.elementType))
    fields = F.struct(*[plain(column[f.name], f.dataType).alias(f.name) for f in kind.fields])
    return F.when(column.isNotNull(), fields)


def row_hash(*columns: Column | str) -> Column:
    """64-bit hash of one row. Nulls are made distinct from absent values."""
    parts = []
    for column in columns:
        column = F.col(column) if isinstance(column, str) else column
        parts += [column.isNull(), column]
    return F.xxhash64(*parts)


def content_hash(*columns: Column | str) -> Column:
    """Order-free hash of a group of rows: a plain sum, so it combines before the shuffle."""
    return F.sum(row_hash(*columns).cast("decimal(20,0)"))
