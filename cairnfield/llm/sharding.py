"""Sharding by a permutation-filled lookup table.

Shards take turns claiming slots of a table of prime size: each has a preference
order (offset + j * skip) mod size, and claims the first of it that is free. A
row goes to the shard of slot hash(key) mod size. The table's size is a
parameter, not a function of the data, so broadcasting it is bounded; the rows
themselves take no shuffle, whatever their keys.

Edge cases: a null key goes where the empty string goes; repeated keys
share a shard; an empty table gives an empty result; other columns aren't read, whatever
their names; a key column named slot or shard is returned as ``key``.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

def _number(text: str) -> int:
    """60 bits of a text's MD5; SQL engines can compute the same."""
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % i for i in range(2, int(n**0.5) + 1))


def fill(shards: list[str], size: int) -> list[int]:
    """For each slot the index of the shard that claimed it. size is a prime."""
    if not shards or len(set(shards)) < len(shards):
        raise ValueError("shards must be distinct, one at least")
    if not _is_prime(size) or size < len(shards):
        raise ValueError("the table's size must be a prime, no less than the number of shards")
    offset = [_number(f"{s}/offset") % size for s in shards]
    skip = [_number(f"{s}/skip") % (size - 1) + 1 for s in shards]
    owner, tried, claimed = [-1] * size, [0] * len(shards), 0
    while claimed < size:
        for i in range(len(shards)):
            while owner[slot := (offset[i] + tried[i] * skip[i]) % size] >= 0:
                tried[i] += 1
            owner[slot] = i
            claimed += 1
            if claimed == size:
                break
    return owner


def slot_of(key: Column, size: int) -> Column:
    text = F.coalesce(key.cast("string"), F.lit(""))
    return F.pmod(F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long"), F.lit(size)).cast("int")


def place(df: DataFrame, key: str, shards: list[str], size: int) -> DataFrame:
    """df's key with its slot and shard; the slot table is broadcast. At least a hundred
    slots for each shard keep shares within about one per cent."""
    owner = fill(shards, size)
    names = F.split(F.lit(",".join(map(str, owner))), ",")
    table = df.sparkSession.range(1).select(F.posexplode(names).alias("slot", "owner"))
    by_index = F.split(F.lit("\x00".join(shards)), "\x00")
    table = table.select("slot", F.get(by_index, F.col("owner").cast("int")).alias("shard"))
    given = df[f"`{key}`"]
    rows = df.select(given.alias("key"), slot_of(given, size).alias("slot")).join(F.broadcast(table), "slot")
    return rows.select(F.col("key").alias(key if key not in ("slot", "shard") else "key"), "slot", "shard")
