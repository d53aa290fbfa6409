"""Sharding by a permutation-filled lookup table (native: DataFrame and SQL functions only).

Each shard has a preference order of the slots of a table of prime size, from an offset and a skip hashed from its
name. Shards take turns: each claims the first slot of its order that is still free, until none is. A row goes to the
shard that holds slot hash(key) mod size, by a broadcast join with the table, whose size is a parameter and never
depends on the data. Every key, however frequent its other columns, is placed in constant time without a shuffle.
Adding or removing one shard moves few other keys.

Edge cases: a null key goes to the slot of the empty string; equal keys go to one shard; an empty table gives no rows;
`place` keeps all other columns, whatever their names, and adds two, named by the caller.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, unused

#: Production parameters: shards, and a prime number of slots of over 100 a shard (so loads differ by under 1 %).
N_SHARDS, N_SLOTS = 32, 4099


def _hash(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:12], 16)


def preferences(shard: int, n_slots: int) -> tuple[int, int]:
    """Offset and skip of a shard's order of slots; all slots occur as n_slots is prime."""
    return _hash(f"offset-{shard}") % n_slots, _hash(f"skip-{shard}") % (n_slots - 1) + 1


def slot_table(n_shards: int, n_slots: int, weights: list[int] | None = None) -> list[int]:
    """The shard of each slot. weights: turns of each shard in a round (1 by default)."""
    if n_slots < n_shards or any(n_slots % d == 0 for d in range(2, int(n_slots**0.5) + 1)):
        raise ValueError("the number of slots must be a prime not under the number of shards")
    orders, at, owner, left = [preferences(s, n_slots) for s in range(n_shards)], [0] * n_shards, [-1] * n_slots, n_slots
    while left:
        for s, (offset, skip) in enumerate(orders):
            for _ in range(weights[s] if weights else 1):
                while left and owner[slot := (offset + at[s] * skip) % n_slots] >= 0:
                    at[s] += 1
                if left:
                    owner[slot], left = s, left - 1
    return owner


def slot_frame(spark: SparkSession, n_shards: int, n_slots: int) -> DataFrame:
    """The table as (slot, shard), n_slots rows."""
    text = ",".join(map(str, slot_table(n_shards, n_slots)))
    return spark.range(1).select(F.posexplode(F.split(F.lit(text), ",")).alias("slot", "shard")).select(F.col("slot").cast("long"), F.col("shard").cast("int"))


def slot_of(key: Column, n_slots: int) -> Column:
    """md5, so that other engines compute the same slot."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    return F.pmod(F.conv(F.substring(digest, 1, 12), 16, 10).cast("long"), F.lit(n_slots))


def place(df: DataFrame, key: str, n_shards: int = N_SHARDS, n_slots: int = N_SLOTS, slot: str = "slot", shard: str = "shard") -> DataFrame:
    """df with the slot and the shard of each row."""
    at, slots, shards = (unused(name, df) for name in ("slot_at", "slot_nth", "slot_shard"))
    frame = slot_frame(df.sparkSession, n_shards, n_slots).toDF(slots, shards)
    out = df.withColumn(at, slot_of(F.col(f"`{key}`"), n_slots)).join(F.broadcast(frame), F.col(at) == F.col(slots))
    return out.select(*[F.col(f"`{c}`") for c in df.columns], F.col(at).alias(slot), F.col(shards).alias(shard))


def op4_shard_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return place(table(spark, sf_dir, "documents").select("doc_id"), "doc_id")


def oracle(n_shards: int = N_SHARDS, n_slots: int = N_SLOTS) -> str:
    """The same in DuckDB: the turns are a recursion over (turn, free slots)."""
    digest = "('0x' || substr(md5({}), 1, 12))::BIGINT"
    return f"""
WITH RECURSIVE prefs AS (
  SELECT s::INT AS shard, {digest.format("'offset-' || s")} % {n_slots} AS off, {digest.format("'skip-' || s")} % {n_slots - 1} + 1 AS skip
  FROM range({n_shards}) t(s)),
orders AS (
  SELECT shard, list((off + j * skip) % {n_slots} ORDER BY j) AS slots FROM prefs, range({n_slots}) r(j) GROUP BY shard),
turns(turn, slot, owner) AS (
  SELECT 0::BIGINT, NULL::BIGINT, list_transform(range({n_slots}), lambda x: -1)
  UNION ALL
  SELECT turn + 1, pick, list_concat(list_concat(owner[1:pick], [(turn % {n_shards})::INT]), owner[pick + 2:])
  FROM (SELECT turn, owner, list_filter(slots, lambda x: owner[x + 1] = -1)[1] AS pick
        FROM turns JOIN orders ON shard = turn % {n_shards} WHERE turn < {n_slots})),
slots AS (SELECT slot, ((turn - 1) % {n_shards})::INT AS shard FROM turns WHERE turn > 0),
keys AS (SELECT doc_id, {digest.format("coalesce(doc_id::VARCHAR, '')")} % {n_slots} AS slot FROM documents)
SELECT doc_id, keys.slot AS slot, shard FROM keys JOIN slots ON keys.slot = slots.slot"""
