"""Measured sizes, so that nothing is broadcast because it is believed to be small."""

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_BROADCAST_ROWS = 100_000
MAX_BROADCAST_BYTES = 64 << 20
# Eight bytes each.
MAX_BROADCAST_HASHES = 2_000_000


def is_small(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS, max_bytes: int = MAX_BROADCAST_BYTES) -> bool:
    """Whether a table stays within both bounds.

    Takes the widths of at most ``max_rows + 1`` rows, partition by partition, so a large table is given up
    after its first partitions and nothing but numbers comes to the driver.
    """
    width = F.coalesce(F.octet_length(F.to_json(F.struct("*"))), F.lit(0))
    widths = df.select(width.alias("w")).take(max_rows + 1)
    return len(widths) <= max_rows and sum(row[0] for row in widths) <= max_bytes


def small_side(df: DataFrame, **bounds: int) -> DataFrame:
    """Mark a join side for broadcast if its measured size allows, else leave the choice to AQE."""
    return F.broadcast(df) if is_small(df, **bounds) else df


@dataclass
class KeysApart:
    """Keys as a join side: themselves, or their hashes if these tell them apart from all other rows. ``small`` sides are
    broadcast, so rows stay where they are."""

    keys: DataFrame
    on: list[str]
    small: bool
    hashed: bool = False

    def without(self, rows: DataFrame) -> DataFrame:
        """The rows that have none of the keys."""
        if not self.hashed:
            return rows.join(F.broadcast(self.keys) if self.small else self.keys, self.on, "left_anti")
        marked = rows.withColumn("_hash", F.xxhash64(*self.on))
        return marked.join(F.broadcast(self.keys), "_hash", "left_anti").drop("_hash")


def _hashes(keys: DataFrame, on: list[str]) -> DataFrame | None:
    """The hashes of keys, broadcast, unless there are too many; keys with nulls equal no row."""
    found = keys.dropna(subset=on).select(F.xxhash64(*on).alias("_hash")).distinct()
    return F.broadcast(found) if found.limit(MAX_BROADCAST_HASHES + 1).count() <= MAX_BROADCAST_HASHES else None


def keys_apart(rows: DataFrame, keys: DataFrame, on: list[str]) -> KeysApart:
    """``keys`` as a side from which ``rows`` are told apart without moving them, if their number allows.

    More keys than are broadcast as such go as hashes, once a join of the key columns has shown that no other row has one of
    these hashes.
    """
    keys = keys.select(*on)
    if is_small(keys):
        return KeysApart(keys, on, True)
    hashes = _hashes(keys, on)
    if hashes is not None:
        alike = rows.select(*on, F.xxhash64(*on).alias("_hash")).join(hashes, "_hash", "left_semi")
        if alike.join(keys, on, "left_anti").isEmpty():
            return KeysApart(hashes, on, True, hashed=True)
    return KeysApart(keys, on, False)


def having(rows: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """The rows that have one of the keys; of many keys the hashes leave few other rows to be moved."""
    if is_small(keys):
        return rows.join(F.broadcast(keys), on, "left_semi")
    hashes = _hashes(keys, on)
    if hashes is not None:
        rows = rows.withColumn("_hash", F.xxhash64(*on)).join(hashes, "_hash", "left_semi").drop("_hash")
    return rows.join(keys, on, "left_semi")


def spread(df: DataFrame) -> DataFrame:
    """Even rows out when a scan has fewer splits than there are cores, as a small single file has.

    For scans only. A scan of many splits, the case that matters, is left alone.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
