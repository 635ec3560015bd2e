"""Sharding by a permutation-filled lookup table (operator 9, native).

Every shard walks the slots of a prime-sized table in its own order (an offset
and a step drawn from the MD5 of its name; a prime size makes each order a
permutation of all slots).  Shards take turns; each turn claims the shard's
next free slot, until the table is full, so slot counts differ by at most one.
A document hashes to a slot and the slot names its shard: one array lookup per
row.  Adding or removing a shard moves few documents.

The table has ``TABLE_SLOTS`` rows whatever the data holds, so its broadcast has
a fixed size.

Edge cases: the key is ``doc_id`` as text; a NULL ``doc_id`` uses the text's
MD5, and a NULL text the empty string, so NULL ids spread too; repeated rows
land together; an empty table gives no rows; other columns pass through, and a
column already called ``shard`` is replaced.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prospect.llm.common import fresh_names

SHARDS = 16
#: Prime, about a hundred slots for each shard.
TABLE_SLOTS = 1621


def _draw(name: str, salt: str) -> int:
    return int(hashlib.md5(f"{salt}:{name}".encode()).hexdigest()[:12], 16)


def fill_table(names: list[str], slots: int = TABLE_SLOTS) -> list[int]:
    """Index of the owning shard for every slot."""
    if not names or slots < len(names):
        raise ValueError("the table needs at least one shard and a slot for each")
    offset = [_draw(n, "offset") % slots for n in names]
    step = [_draw(n, "step") % (slots - 1) + 1 if slots > 1 else 0 for n in names]
    owner, walked, free = [-1] * slots, [0] * len(names), slots
    while free:
        for k in range(len(names)):
            while True:
                at = (offset[k] + walked[k] * step[k]) % slots
                walked[k] += 1
                if owner[at] < 0:
                    break
            owner[at] = k
            free -= 1
            if not free:
                break
    return owner


def shard_names(count: int) -> list[str]:
    return [f"shard-{k}" for k in range(count)]


def slot_column(slots: int = TABLE_SLOTS, doc_id: str = "doc_id", text: str = "text") -> Column:
    key = F.coalesce(F.col(doc_id).cast("string"), F.concat(F.lit("text:"), F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary"))))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 12), 16, 10).cast("long") % slots


def assign_shards(docs: DataFrame, shards: int = SHARDS, slots: int = TABLE_SLOTS) -> DataFrame:
    """``docs`` with an integer ``shard`` column, by a broadcast lookup of
    ``slots`` rows."""
    filled = ",".join(map(str, fill_table(shard_names(shards), slots)))
    keyed = docs.drop("shard")
    slot, = fresh_names(keyed, "slot")
    lookup = docs.sparkSession.range(1).select(F.posexplode(F.split(F.lit(filled), ",")).alias("at", "name"))
    lookup = lookup.select(F.col("at").cast("long").alias(slot), F.col("name").cast("int").alias("shard"))
    return keyed.withColumn(slot, slot_column(slots)).join(F.broadcast(lookup), slot).drop(slot)


def write_shards(sharded: DataFrame, path: str, files_per_shard: int = 1) -> None:
    """One folder per shard; rows of a shard are dealt to ``files_per_shard``
    tasks by their text, so a large shard is written by several."""
    salt = F.pmod(F.xxhash64("text"), F.lit(files_per_shard))
    sharded.repartition("shard", salt).write.partitionBy("shard").parquet(path)


def oracle(shards: int = SHARDS, slots: int = TABLE_SLOTS) -> str:
    """DuckDB SQL of ``assign_shards`` over ``documents``: the same turns as a
    recursive query over the table's state."""
    return f"""
WITH RECURSIVE names AS (
  SELECT k, ('0x' || substr(md5('offset:shard-' || k), 1, 12))::BIGINT % {slots} AS off,
         ('0x' || substr(md5('step:shard-' || k), 1, 12))::BIGINT % {slots - 1} + 1 AS step
  FROM (SELECT unnest(range({shards})) AS k)
), orders AS (
  SELECT k, list_transform(range({slots}), i -> (off + i * step) % {slots}) AS walk FROM names
), turns AS (
  SELECT 0 AS turn, CAST([] AS BIGINT[]) AS taken, CAST(NULL AS BIGINT) AS slot
  UNION ALL
  SELECT turn + 1, list_append(taken, pick), pick
  FROM (SELECT t.turn, t.taken, list_filter(o.walk, s -> NOT list_contains(t.taken, s))[1] AS pick
        FROM turns t JOIN orders o ON o.k = t.turn % {shards} WHERE t.turn < {slots})
), filled AS (SELECT slot, (turn - 1) % {shards} AS shard FROM turns WHERE slot IS NOT NULL)
SELECT d.doc_id, CAST(f.shard AS INTEGER) AS shard
FROM documents d JOIN filled f ON f.slot =
  ('0x' || substr(md5(coalesce(CAST(d.doc_id AS VARCHAR), 'text:' || md5(coalesce(d.text, '')))), 1, 12))::BIGINT % {slots}
"""
