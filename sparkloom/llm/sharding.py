"""Shard placement through a permutation-filled lookup table (DataFrame functions only)."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column, fresh, ship

ship(__name__)


def is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def _number(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:13], 16)


def fill_table(shards: list[str], slots: int) -> list[int]:
    """The table: slot to index of its shard.

    Each shard prefers the slots in the order of its own permutation, start +
    i * step modulo a prime. Shards take turns; in its turn a shard claims the
    first slot of its order that is free. Shares differ by one slot at most, and
    a table without one of the shards keeps most of the other slots as they are.
    Raises ValueError if ``slots`` is no prime, or fewer than the shards.
    """
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards must be given, each once")
    if not is_prime(slots) or slots < len(shards):
        raise ValueError("the number of slots must be a prime, as large as the number of shards at least")
    at = [_number(f"start:{s}") % slots for s in shards]
    step = [_number(f"step:{s}") % (slots - 1) + 1 if slots > 2 else 1 for s in shards]
    table, free = [-1] * slots, slots
    while free:
        for k in range(len(shards)):
            while table[at[k]] >= 0:
                at[k] = (at[k] + step[k]) % slots
            table[at[k]] = k
            free -= 1
            if not free:
                break
    return table


def slot_of(key: Column, slots: int) -> Column:
    """A slot for a key: 52 bits of MD5 modulo the table's size; null counts as the empty key."""
    hexed = F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 13)
    return (F.conv(hexed, 16, 10).cast("long") % slots).cast("int")


def place(docs: DataFrame, shards: list[str], slots: int = 65537, key: str = "doc_id", slot: str = "slot", shard: str = "shard") -> DataFrame:
    """``docs`` with ``slot`` and ``shard`` (index in ``shards``) added.

    The table has ``slots`` entries at any input size; it is broadcast, and
    each row is placed by one probe without a shuffle. Null keys share one
    slot, equal keys (repeated rows) too. Empty input gives empty output.
    Columns of ``docs`` that have one of the two new names are replaced; all
    others stay, whatever their names.
    """
    spark = docs.sparkSession
    listed = ",".join(map(str, fill_table(shards, slots)))
    at, there, own = fresh(docs, "at", "there", "own")
    lookup = spark.range(1).select(F.posexplode(F.split(F.lit(listed), ",")).alias(there, own)).select(there, F.col(own).cast("int").alias(own))
    kept = [c for c in docs.columns if c not in (slot, shard)]
    placed = docs.select("*", slot_of(F.col(key), slots).alias(at)).join(F.broadcast(lookup), F.col(at) == F.col(there))
    return placed.select(*[column(c) for c in kept], F.col(at).alias(slot), F.col(own).alias(shard))
