from offsetlake.functions.hashing import content_hash, fnv1a32, row_hash
from offsetlake.functions.keys import ledger_key, ledger_partition, ledger_topic
from offsetlake.functions.names import (
    is_chain_id,
    is_destination,
    is_identifier,
    is_log_name,
    is_state_path,
)
from offsetlake.functions.numbers import MAX_I64, next_offset

__all__ = [
    "MAX_I64",
    "content_hash",
    "fnv1a32",
    "is_chain_id",
    "is_destination",
    "is_identifier",
    "is_log_name",
    "is_state_path",
    "ledger_key",
    "ledger_partition",
    "ledger_topic",
    "next_offset",
    "row_hash",
]
