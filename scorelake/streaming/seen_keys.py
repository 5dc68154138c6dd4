"""A growing set of keys on disk, of which a batch reads only the files its own keys may be in.

Keys are kept in generations. A generation is dealt by hash into buckets, a file each, whose number
follows the generation's size: KEYS_PER_BUCKET keys a bucket, about. Beside the files it has a Bloom
filter per bucket. A batch becomes a generation; a tail of generations that is no more than twice as
large is merged with it into one, so there are at most as many generations as doublings, no small files
pile up, and a key is rewritten once a doubling.

To look a batch up, its keys are grouped by bucket with the filters, and only buckets that may hold one of
them are read. A key that is not held is taken for a held one with a probability of about 1 in 100, so k new
keys read 1 - 0.99^(k / buckets) of a generation's files, about. A batch that is as large as a generation
reads all of it. States are published as versions: a batch that is repeated starts from the state before it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorelake.sources.versions import Versions

KEYS_PER_BUCKET = 1 << 20
#: Bits of a filter per key, rounded up to a power of two in all, and bits that a key sets.
BITS, PROBES = 10, 6


def _bits(hashes: np.ndarray, size: int) -> np.ndarray:
    """Places of the bits of each hash, a row per probe; size is a power of two."""
    h = hashes.view(np.uint64)
    first, step = h & np.uint64(0xFFFFFFFF), (h >> np.uint64(32)) | np.uint64(1)
    return (first + np.arange(PROBES, dtype=np.uint64)[:, None] * step) & np.uint64(size - 1)


def bloom(hashes: np.ndarray) -> bytes:
    """A filter that holds 64-bit hashes."""
    size = 1 << max(6, math.ceil(math.log2(max(1, BITS * len(hashes)))))
    field = np.zeros(size, bool)
    field[_bits(hashes, size).ravel()] = True
    return np.packbits(field, bitorder="little").tobytes()


def may_hold(field: bytes, hashes: np.ndarray) -> np.ndarray:
    """Whether each hash may be in a filter; False is certain."""
    raw = np.frombuffer(field, np.uint8)
    at = _bits(hashes, 8 * len(raw))
    return ((raw[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).all(axis=0)


@dataclass(frozen=True)
class Lookup:
    """Rows whose keys are new, and how many of the key files were read for that."""

    rows: DataFrame
    read: int
    files: int


class SeenKeys:
    """The key set below a folder."""

    def __init__(self, spark: SparkSession, root: str, keys: Sequence[str], per_bucket: int = KEYS_PER_BUCKET) -> None:
        self.spark, self.keys, self.per_bucket = spark, list(keys), per_bucket
        self.versions = Versions(spark, root)

    def _generations(self, before: int | None) -> list[dict]:
        number = self.versions.latest(before)
        return [] if number is None else self.versions.content(number)["generations"]

    def _hash(self):
        return F.xxhash64(*self.keys)

    def _bucket(self, buckets: int):
        # Another hash than the filters': keys of one bucket must not share bits.
        return F.pmod(F.hash(*self.keys), F.lit(buckets))

    def _touched(self, generation: dict, hashed: DataFrame) -> list[int]:
        """Buckets of a generation that may hold a key of hashed (keys, __hash)."""
        filters = self.spark.read.parquet(f"{generation['folder']}/filters")
        probes = hashed.select(self._bucket(generation["buckets"]).alias("bucket"), "__hash").distinct()

        def probe(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            if left.empty or right.empty or not may_hold(right["field"].iloc[0], left["__hash"].to_numpy()).any():
                return pd.DataFrame({"bucket": pd.Series([], dtype="int32")})
            return pd.DataFrame({"bucket": left["bucket"].iloc[:1]})

        found = probes.groupBy("bucket").cogroup(filters.groupBy("bucket")).applyInPandas(probe, "bucket int")
        return sorted(r.bucket for r in found.collect())

    def unseen(self, rows: DataFrame, before: int | None = None) -> Lookup:
        """Rows whose key is not in the set, as it was before a version."""
        generations = self._generations(before)
        if not generations:
            return Lookup(rows, 0, 0)
        hashed = rows.select(*self.keys).distinct().withColumn("__hash", self._hash())
        n, read, new = hashed.count(), 0, rows
        for generation in generations:
            every = n >= generation["keys"]
            touched = list(range(generation["buckets"])) if every else self._touched(generation, hashed)
            read += len(touched)
            if touched:
                held = self.spark.read.parquet(f"{generation['folder']}/keys")
                if not every:
                    held = held.where(F.col("bucket").isin(touched))
                # Keys may be NULL; they are then held by their hash and compared with NULL in mind.
                same = [rows[k].eqNullSafe(F.col(f"__held.{k}")) for k in self.keys]
                held = held.select(*self.keys).alias("__held")
                condition = same[0]
                for one in same[1:]:
                    condition = condition & one
                new = new.join(held, condition, "left_anti")
        return Lookup(new, read, sum(g["buckets"] for g in generations))

    def add(self, rows: DataFrame, number: int | None = None) -> None:
        """Adds the keys of rows, none of which is in the set yet, and publishes the state (again, if it exists)."""
        generations = self._generations(number)
        added = rows.select(*self.keys).distinct()
        n = added.count()
        if n:
            tail: list[dict] = []
            while generations and generations[-1]["keys"] <= 2 * (n + sum(g["keys"] for g in tail)):
                tail.append(generations.pop())
            for old in tail:
                added = added.unionByName(self.spark.read.parquet(f"{old['folder']}/keys").select(*self.keys))
            generations.append(self._written(added, n + sum(g["keys"] for g in tail)))
        content = {"generations": generations, "folders": [g["folder"] for g in generations]}
        exists = number is not None and number in self.versions.numbers()
        self.versions.publish(content, number, again=exists)

    def _written(self, keys: DataFrame, n: int) -> dict:
        folder, buckets = self.versions.new_folder(), math.ceil(n / self.per_bucket)
        dealt = keys.withColumn("bucket", self._bucket(buckets)).repartition(min(buckets, 4096), "bucket")
        dealt.write.partitionBy("bucket").parquet(f"{folder}/keys")
        hashes = self.spark.read.parquet(f"{folder}/keys").select("bucket", self._hash().alias("h"))

        def build(group: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"bucket": group["bucket"].iloc[:1], "field": [bloom(group["h"].to_numpy())]})

        hashes.groupBy("bucket").applyInPandas(build, "bucket int, field binary").write.parquet(f"{folder}/filters")
        return {"folder": folder, "keys": n, "buckets": buckets}

    def states(self) -> Iterator[tuple[int, list[dict]]]:
        """Number and generations of every published state."""
        for number in self.versions.numbers():
            yield number, self.versions.content(number)["generations"]
