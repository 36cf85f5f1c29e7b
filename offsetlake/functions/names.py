"""Name predicates. Null is never a valid name."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# The accepted name patterns. \A and \z, because $ also matches before a newline.
LOG_NAME = r"\A[A-Za-z0-9._-]{1,249}\z"
IDENTIFIER = r"\A[A-Za-z_][A-Za-z0-9_]*\z"
CHAIN_ID = r"\A[A-Za-z0-9-]+\z"
STATE_PATH = r"\A/[A-Za-z0-9_-]+(/[A-Za-z0-9_-]+)*\z"
DESTINATION = r"\A[A-Za-z_][A-Za-z0-9_]*:[A-Za-z0-9_.-]+(/[A-Za-z0-9_.-]+)*\z"
DOT_SEGMENT = r"[:/]\.{1,2}(/|\z)"


def _matches(value: Column, pattern: str) -> Column:
    return F.coalesce(value.rlike(pattern), F.lit(False))


def is_log_name(value: Column) -> Column:
    return _matches(value, LOG_NAME)


def is_identifier(value: Column) -> Column:
    return _matches(value, IDENTIFIER)


def is_chain_id(value: Column) -> Column:
    return _matches(value, CHAIN_ID)


def is_state_path(value: Column) -> Column:
    return _matches(value, STATE_PATH)


def is_destination(value: Column) -> Column:
    """``<identifier>:<path>`` with no ``.`` or ``..`` segment."""
    return _matches(value, DESTINATION) & ~_matches(value, DOT_SEGMENT)
