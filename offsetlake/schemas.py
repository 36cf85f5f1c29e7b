"""Schemas shared by all modules. Offsets are 64-bit and vectors are exclusive (next offset)."""

from pyspark.sql import types as T

STRING, BINARY, TIME = T.StringType(), T.BinaryType(), T.TimestampType()
INT, LONG = T.IntegerType(), T.LongType()
# Unsigned 64-bit values are held as decimals until they are audited.
U64 = T.DecimalType(20, 0)


def struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


HEADERS = T.ArrayType(struct(key=STRING, value=BINARY))
LOG = struct(
    topic=STRING,
    partition=INT,
    offset=LONG,
    key=BINARY,
    value=BINARY,
    timestamp=TIME,
    headers=HEADERS,
)
POSITION = ["topic", "partition", "offset"]

OFFSETS = struct(topic=STRING, partition=INT, offset=LONG)
LOG_BOUNDS = struct(topic=STRING, partition=INT, low=LONG, high=LONG)
PIPELINES = struct(
    connector=STRING,
    database=STRING,
    state_table=STRING,
    state_path=STRING,
    table=STRING,
    topic=STRING,
    partitions=INT,
)

RAW_LEDGER = struct(pipeline=STRING, key=STRING, min_offset=U64, max_offset=U64, state=STRING)
LEDGER = struct(
    topic=STRING,
    partition=INT,
    min_offset=LONG,
    max_offset=LONG,
    rows=LONG,
    state=STRING,
    batch_id=STRING,
)
BLOCK_ID = ["topic", "partition", "batch_id"]

CHECKPOINT_OFFSETS = T.ArrayType(struct(topic=STRING, partition=INT, offset=U64))
CHECKPOINT_LEDGER = T.ArrayType(
    struct(key=STRING, min_offset=U64, max_offset=U64, state=STRING)
)
CONNECTORS = T.ArrayType(
    struct(
        name=STRING,
        topic=STRING,
        partitions=LONG,
        database=STRING,
        table=STRING,
        state_database=STRING,
        state_table=STRING,
        state_path=STRING,
        offsets=CHECKPOINT_OFFSETS,
        observed=CHECKPOINT_OFFSETS,
        ledger=CHECKPOINT_LEDGER,
    )
)
BACKUP = struct(
    id=STRING,
    name=STRING,
    kind=STRING,
    chain_id=STRING,
    position=LONG,
    parent_id=STRING,
    parent_name=STRING,
)
MANIFESTS = struct(
    backup_id=STRING,
    name=STRING,
    kind=STRING,
    chain_id=STRING,
    position=LONG,
    parent_id=STRING,
    parent_name=STRING,
    created_at=STRING,
    connectors=CONNECTORS,
)
CHAIN_STATE = struct(
    generation=U64,
    chain_id=STRING,
    root=BACKUP,
    tip=BACKUP,
    incremental_count=LONG,
    pipelines=T.ArrayType(
        struct(
            connector=STRING,
            topic=STRING,
            partitions=LONG,
            database=STRING,
            table=STRING,
            state_table=STRING,
            state_path=STRING,
        )
    ),
)
CATALOG = struct(log_offset=LONG, key=STRING, value=STRING)
RECOVERIES = struct(
    id=STRING,
    backup_id=STRING,
    source_database=STRING,
    source_table=STRING,
    dest_database=STRING,
    dest_table=STRING,
    targets=CHECKPOINT_OFFSETS,
)
LEASE_EVENTS = struct(token=STRING, connectors=T.ArrayType(STRING), event=STRING, ts=TIME)
VIOLATION = struct(rule=STRING, subject=STRING, detail=STRING)
