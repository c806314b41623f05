"""Jump consistent hashing, with DataFrame expressions only.

A row's shard follows from its key and the number of shards alone, without a ring table; one more
shard takes rows only into itself. The generator is the usual 64-bit linear congruential step.
SQL's checked arithmetic has no wrapping product, so the state is held as two 32-bit halves.

A null key counts as 0. Rows with the same key share a shard. Repeated rows have slots of their
own. An empty table gives an empty result; other columns are ignored. Null text has no bytes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .packing import ranked

#: Fixed values of the published generator.
MULTIPLIER = 2862933555777941757
LAW = "key"

_MASK = 0xFFFFFFFF
_A_HIGH, _A_LOW = MULTIPLIER >> 32, MULTIPLIER & _MASK


def _step(high: Column, low: Column) -> tuple[Column, Column]:
    """state * MULTIPLIER + 1 modulo 2^64, every intermediate value below 2^63."""
    product = (low.bitwiseAND(F.lit(0xFFFF)) * F.lit(_A_LOW)) + F.shiftleft((F.shiftrightunsigned(low, 16) * F.lit(_A_LOW)).bitwiseAND(F.lit(0xFFFF)), 16) + F.lit(1)
    carry = F.shiftrightunsigned(product, 32) + F.shiftrightunsigned(F.shiftrightunsigned(low, 16) * F.lit(_A_LOW), 16)

    def times(x: Column, a: int) -> Column:  # modulo 2^32
        return (x.bitwiseAND(F.lit(0xFFFF)) * F.lit(a)) + F.shiftleft((F.shiftrightunsigned(x, 16) * F.lit(a & 0xFFFF)).bitwiseAND(F.lit(0xFFFF)), 16)

    return (carry + times(high, _A_LOW) + times(low, _A_HIGH)).bitwiseAND(F.lit(_MASK)), product.bitwiseAND(F.lit(_MASK))


def jump_shard(key: Column, shards: int) -> Column:
    """The shard, 0 to shards - 1, of a long key. A jump goes forward by one at least, so `shards` steps are enough."""
    if shards < 1:
        raise ValueError("at least one shard")
    key = F.coalesce(key.cast("long"), F.lit(0).cast("long"))
    start = F.struct(F.shiftrightunsigned(key, 32).alias("high"), key.bitwiseAND(F.lit(_MASK)).alias("low"), F.lit(-1).cast("long").alias("b"), F.lit(0).cast("long").alias("j"))

    def jump(s: Column, _: Column) -> Column:
        high, low = _step(s["high"], s["low"])
        j = F.floor((s["j"] + F.lit(1)).cast("double") * (F.lit(float(1 << 31)) / (F.shiftrightunsigned(high, 1) + F.lit(1)).cast("double")))
        moved = F.struct(high.alias("high"), low.alias("low"), s["j"].alias("b"), j.alias("j"))
        return F.when(s["j"] < F.lit(shards), moved).otherwise(s)

    return F.aggregate(F.sequence(F.lit(1), F.lit(shards)), start, jump, lambda s: s["b"].cast("int"))


def sharded(docs: DataFrame, shards: int) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and the shard after growing by one."""
    data = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    rows = docs.select("doc_id", (F.octet_length(data) + F.lit(16)).cast("long").alias("size"), F.crc32(data).alias("text_crc32"))
    rows = rows.select("*", F.lit(LAW).alias("law"), jump_shard(F.col("doc_id"), shards).alias("shard"), jump_shard(F.col("doc_id"), shards + 1).alias("grown_shard"))
    return ranked(rows, "shard", ["doc_id", "text_crc32", "size"], "slot", docs.count()).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")

