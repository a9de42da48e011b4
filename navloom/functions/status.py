"""Status words of route searches, as column expressions and plain numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The bits of a status word.
FAILURE, SUCCESS, IN_PROGRESS = 1 << 31, 1 << 30, 1 << 29
WRONG_MAGIC, WRONG_VERSION, OUT_OF_MEMORY, INVALID_PARAM = 1, 2, 4, 8
BUFFER_TOO_SMALL, OUT_OF_NODES, PARTIAL, ALREADY_OCCUPIED = 16, 32, 64, 128


def has(word, bit: int) -> Column:
    return F.col(word).cast("long").bitwiseAND(F.lit(bit).cast("long")) != 0


def failed(word) -> Column:
    return has(word, FAILURE)


def succeeded(word) -> Column:
    return has(word, SUCCESS)


def in_progress(word) -> Column:
    return has(word, IN_PROGRESS)


def detail(word) -> Column:
    return F.col(word).cast("long").bitwiseAND(255)
