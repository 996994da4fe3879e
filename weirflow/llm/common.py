"""Column helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: ASCII white space, as a Java and RE2 character class body.
WS = r"\x20\x09-\x0D"

#: Rows up to which a side table is broadcast; a row is at most a few hundred bytes.
BROADCAST_ROWS = 50_000


def words(text: Column) -> Column:
    """Maximal runs of characters other than ASCII white space."""
    return F.filter(F.split(text, f"[{WS}]+"), lambda w: w != "")


def side(df: DataFrame, rows: int) -> DataFrame:
    """A broadcast hint for a side whose counted rows prove it small; beyond that a shuffled join."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


#: Bits of a key filter, at most; 16 MB, which is broadcast.
FILTER_BITS = 1 << 27
_SLOT = 1 << 15


def maybe_in(df: DataFrame, key: str, keys: DataFrame, n: int) -> DataFrame:
    """``df`` without most rows whose ``key`` is not among the ``n`` of ``keys``, before they are shuffled for a join that removes the rest.

    A bitmap has a bit for each key's hash, 16 for every key as long as it stays within ``FILTER_BITS``; its size is bounded, so it is broadcast.
    """
    bits = min(FILTER_BITS, max(_SLOT, 1 << (16 * max(n, 1)).bit_length()))
    place = F.pmod(F.xxhash64(key), F.lit(bits))
    slot, bit = F.floor(place / _SLOT).cast("int"), (place % _SLOT).cast("int")
    table = keys.select(slot.alias("__slot"), bit.alias("__bit")).groupBy("__slot").agg(F.bitmap_construct_agg("__bit").alias("__bits"))
    byte = F.conv(F.hex(F.substring("__bits", F.floor(F.col("__bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    is_set = byte.bitwiseAND(F.call_function("shiftleft", F.lit(1), (F.col("__bit") % 8).cast("int"))) != 0
    return df.withColumns({"__slot": slot, "__bit": bit}).join(F.broadcast(table), "__slot").where(is_set).select(*df.columns)


def whole(text: Column) -> Column:
    """Null texts count as empty."""
    return F.coalesce(text, F.lit(""))


# --- in Python workers -------------------------------------------------------------------------

_HELD: dict[str, Callable[[], None]] = {}


def trim() -> None:
    """Gives freed memory back to the machine, where the C library can."""
    gc.collect()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass


def take_over(owner: str, clear: Callable[[], None] = lambda: None) -> None:
    """Called where an operator's task begins in a worker: what another operator remembered there is dropped.

    Workers are reused from stage to stage, so that memory would stay taken while the next operator works.
    """
    others = [o for o in _HELD if o != owner]
    for o in others:
        _HELD.pop(o)()
    _HELD[owner] = clear
    if others:
        trim()


@contextmanager
def uncollected() -> Iterator[None]:
    """Without the cyclic collector, which would go through large tables of words again and again; what runs inside makes no cycles."""
    gc.disable()
    try:
        yield
    finally:
        gc.enable()
