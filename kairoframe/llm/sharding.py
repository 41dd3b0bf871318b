"""Sharding by a permutation-filled lookup table.

Every shard has its own preference order over the slots of a prime-sized table, and the shards
take turns claiming their next free slot. The table depends on the shards' names alone, holds
``SLOTS`` small integers whatever the data, and is broadcast, so that placing a row is one hash
and one lookup. Adding or removing a shard moves few other keys.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

SLOTS = 65_537
SHARDS = tuple(f"shard-{i:03d}" for i in range(128))


def _number(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def fill(shards: Sequence[str], slots: int = SLOTS) -> list[int]:
    """For each slot the index of the shard that claims it. ``slots`` must be a prime over the
    number of shards; names must differ."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards must be named, and differently")
    if slots <= len(shards) or any(slots % d == 0 for d in range(2, int(slots**0.5) + 1)):
        raise ValueError("slots must be a prime over the number of shards")
    at = [_number(f"offset:{s}") % slots for s in shards]
    step = [_number(f"step:{s}") % (slots - 1) + 1 for s in shards]
    owner, free = [-1] * slots, slots
    while free:
        for i in range(len(shards)):
            while owner[at[i]] >= 0:
                at[i] = (at[i] + step[i]) % slots
            owner[at[i]] = i
            free -= 1
            if not free:
                break
    return owner


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """A key's slot; null keys hash as the empty string."""
    text = F.coalesce(key.cast("string"), F.lit(""))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long") % slots


def lookup(spark: SparkSession, shards: Sequence[str], slots: int = SLOTS) -> DataFrame:
    """The table as ``(slot, shard_id, shard)``: ``slots`` rows, from two literals."""
    owners = ",".join(map(str, fill(shards, slots)))
    names = F.array(*map(F.lit, shards))
    return (
        spark.range(1).select(F.posexplode(F.split(F.lit(owners), ",")).alias("slot", "owner"))
        .select(F.col("slot").cast("long").alias("slot"), F.col("owner").cast("int").alias("shard_id"))
        .withColumn("shard", F.element_at(names, F.col("shard_id") + 1))
    )


def place(rows: DataFrame, key: str, shards: Sequence[str] = SHARDS, slots: int = SLOTS) -> DataFrame:
    """The rows' key with ``slot``, ``shard_id`` and ``shard``, one row for each input row, without
    a shuffle of the input. Rows of a repeated key go to one shard, so a key should be an id and
    not a source; null keys share a slot; other columns are not read; no rows give none."""
    keyed = rows.select(key).withColumn("slot", slot_of(F.col(key), slots))
    return keyed.join(F.broadcast(lookup(rows.sparkSession, shards, slots)), "slot").select(key, "slot", "shard_id", "shard")


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return place(table(spark, sf_dir, "documents"), "doc_id")


def _oracle() -> str:
    owners = ",".join(map(str, fill(SHARDS)))
    return f"""WITH lut AS (SELECT string_split('{owners}', ',') AS owners),
k AS (SELECT doc_id, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT % {SLOTS} AS slot FROM documents)
SELECT doc_id, slot, owners[slot + 1]::INT AS shard_id, 'shard-' || lpad(owners[slot + 1], 3, '0') AS shard FROM k, lut"""


ORACLE = _oracle()
