"""Shards of nearly equal size: a minimax contiguous partition of ordered groups of equal texts."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from daygrain.llm.common import stored

BUCKETS = 1 << 14  # ranges of the order whose totals come to the driver
PARTS = 1 << 10  # parts into which the rows of a group are dealt, so that a large group has no large part
FINER = 64  # points that are fetched inside a stretch in which a cut may fall


@dataclass
class Ends:
    """Some of the places where a cut can be made: running totals and numbers of the groups that end there.

    Between neighbours with consecutive numbers there is no other place.
    """

    totals: np.ndarray
    numbers: np.ndarray

    def last(self, limit: int) -> int:
        """Index of the last place at or before ``limit``; -1 if there is none."""
        return int(np.searchsorted(self.totals, limit, side="right")) - 1

    def open_after(self, i: int) -> bool:
        """Whether there are unknown places between places ``i`` and ``i + 1``."""
        if i + 1 >= len(self.numbers):
            return False
        return self.numbers[i + 1] - (self.numbers[i] if i >= 0 else 0) > 1

    def at(self, i: int) -> int:
        return int(self.totals[i]) if i >= 0 else 0

    def furthest(self, shards: int, capacity: int, hopeful: bool) -> list[int]:
        """Where greedy cuts of ``capacity`` come to: with known places only, or at best (``hopeful``)."""
        out, place = [], 0
        for _ in range(shards):
            i = self.last(place + capacity)
            unknown = hopeful and self.open_after(i)
            place = min(place + capacity, self.at(len(self.totals) - 1)) if unknown else max(place, self.at(i))
            out.append(place)
        return out

    def least_capacity(self, shards: int, low: int, hopeful: bool) -> int:
        """Binary search for the smallest capacity of at least ``low`` with which greedy cuts reach the end."""
        high = total = self.at(len(self.totals) - 1)
        while low < high:
            middle = (low + high) // 2
            if self.furthest(shards, middle, hopeful)[-1] >= total:
                high = middle
            else:
                low = middle + 1
        return low

    def cuts(self, shards: int, capacity: int) -> list[int]:
        """Ends of the shards, none larger than ``capacity``, each as near as can be to an even share of the rest."""
        total = self.at(len(self.totals) - 1)
        earliest = [total]  # from the right: where a shard must end for the rest to fit
        for _ in range(shards - 1):
            i = int(np.searchsorted(self.totals, earliest[-1] - capacity, side="left"))
            earliest.append(self.at(i) if earliest[-1] > capacity else 0)
        out, place = [], 0
        for k, floor in enumerate(reversed(earliest)):
            even = place + (total - place) / (shards - k)
            low, high = int(np.searchsorted(self.totals, max(place, floor), side="left")), self.last(place + capacity)
            choice = range(low, high + 1)
            near = int(np.searchsorted(self.totals, even))
            options = [i for i in (near - 1, near, low, high) if i in choice]
            best = min(options, key=lambda i: (abs(self.at(i) - even), i), default=None)
            place = max(place, floor) if best is None else self.at(best)
            out.append(place)
        return out


def find_cuts(groups: DataFrame, buckets: list, shards: int) -> list[int]:
    """Ends of the shards of least possible capacity.

    ``groups(_bucket, _at, _end)`` are the groups' numbers and running totals in their bucket; ``buckets``
    the ordered totals. Starts from the ends of the buckets and fetches places inside only those stretches in
    which a cut could fall for a capacity that is still in question.
    """
    spark = groups.sparkSession
    sizes, lasts = np.array([b["bytes"] for b in buckets]), np.array([b["groups"] for b in buckets])
    ends = Ends(np.cumsum(sizes), np.cumsum(lasts))
    offsets, before = ends.totals - sizes, ends.numbers - lasts
    total = int(ends.totals[-1])
    low = max(-(-total // shards), max(int(b["largest"]) for b in buckets))
    while True:
        high = ends.least_capacity(shards, low, hopeful=False)
        low = ends.least_capacity(shards, low, hopeful=True)
        if low >= high:
            return ends.cuts(shards, high)
        wanted = set()
        for a, b in zip(ends.furthest(shards, low, hopeful=False), ends.furthest(shards, high, hopeful=True)):
            for i in range(ends.last(a), ends.last(b) + 1):
                if ends.open_after(i):
                    first = (int(ends.numbers[i]) if i >= 0 else 0) + 1
                    inside = np.linspace(first, ends.numbers[i + 1] - 1, FINER).round().astype(np.int64)
                    wanted.update(inside.tolist())
        numbers = np.array(sorted(wanted))
        home = np.searchsorted(np.cumsum(lasts), numbers, side="left")
        rows = [(int(buckets[h]["_bucket"]), int(n - before[h]), int(n), int(offsets[h])) for h, n in zip(home, numbers)]
        places = spark.createDataFrame(rows, "_bucket long, _at int, number long, offset long")
        found = (
            groups.join(F.broadcast(places), ["_bucket", "_at"])
            .select("number", (F.col("_end") + F.col("offset")).alias("total"))
            .collect()
        )
        totals = np.concatenate([ends.totals, [r["total"] for r in found]])
        numbers = np.concatenate([ends.numbers, [r["number"] for r in found]])
        order = np.argsort(numbers)
        ends = Ends(totals[order], numbers[order])


def minimax_shards(
    df: DataFrame, shards: int, text: str = "text", doc_id: str = "doc_id", overhead: int = 16
) -> DataFrame:
    """One row per input row: the id, ``size``, ``text_crc32``, ``shard`` and ``slot``.

    ``size`` is the text's UTF-8 bytes plus ``overhead``. Equal texts are one group and share a shard.
    Groups are ordered by a hash of the text, which mixes lengths and sources, and cut into ``shards``
    contiguous runs whose largest total is the least possible. The binary search for that capacity, with a
    greedy check, runs on the driver over running totals: of the ends of BUCKETS ranges at first, then also of
    places inside the few ranges in which a cut could fall. What the driver holds depends on these constants
    and on ``shards``, not on the number of rows.

    Slots number the rows of a shard without gaps in that order, then by id. The rows of a group are dealt
    into PARTS parts, so that a group with very many rows is summed and numbered by many tasks.

    Null texts count as empty. Null ids come first in their part; rows with equal id and text get different
    slots. With fewer groups than shards some shards stay empty, and a group larger than an even share has
    its shard for itself or nearly so. An empty input gives an empty result. Other columns of ``df`` are
    ignored, whatever their names.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    rows = stored(
        df.select(
            F.col(doc_id).alias("_id"),
            (F.octet_length(body) + F.lit(overhead)).cast("long").alias("size"),
            F.crc32(F.encode(body, "UTF-8")).alias("text_crc32"),
            # half of a SHA-256
            F.substring(F.unhex(F.sha2(body, 256)), 1, 16).alias("_group"),
            F.monotonically_increasing_id().alias("_row"),
        ).withColumn("_part", F.pmod(F.xxhash64("_row"), F.lit(PARTS)))
    )
    parts = rows.groupBy("_group", "_part").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    in_group = Window.partitionBy("_group").orderBy("_part")
    parts = stored(
        parts.select(
            "*", (F.sum("n").over(in_group.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("_earlier")
        )
    )
    in_bucket = Window.partitionBy("_bucket").orderBy("_group").rowsBetween(Window.unboundedPreceding, 0)
    groups = stored(
        parts.groupBy("_group")
        .agg(F.sum("bytes").alias("bytes"), F.sum("n").alias("n"))
        .withColumn("_bucket", F.pmod(F.xxhash64("_group"), F.lit(BUCKETS)))
        .select(
            "*",
            F.sum("bytes").over(in_bucket).alias("_end"),
            F.sum("n").over(in_bucket).alias("_rows"),
            F.row_number().over(in_bucket).alias("_at"),
        )
    )
    # at most BUCKETS rows
    buckets = (
        groups.groupBy("_bucket")
        .agg(
            F.sum("bytes").alias("bytes"),
            F.sum("n").alias("n"),
            F.count("*").alias("groups"),
            F.max("bytes").alias("largest"),
        )
        .orderBy("_bucket")
        .collect()
    )
    cuts = find_cuts(groups, buckets, shards) if buckets else [0] * shards
    offset = before = 0
    starts = []
    for b in buckets:
        starts.append((b["_bucket"], offset, before))
        offset, before = offset + b["bytes"], before + b["n"]
    starts = df.sparkSession.createDataFrame(starts, "_bucket long, _offset long, _before long")
    inner = F.array(*[F.lit(c).cast("long") for c in cuts[:-1]]).cast("array<bigint>")
    placed = groups.join(F.broadcast(starts), "_bucket").select(
        "_group",
        F.size(F.filter(inner, lambda c: c < F.col("_end") + F.col("_offset"))).alias("shard"),
        (F.col("_before") + F.col("_rows") - F.col("n")).alias("_first"),
    )
    placed = stored(placed)
    # `shards` rows at most
    first = placed.groupBy("shard").agg(F.min("_first").alias("_shard_first"))
    placed = placed.join(F.broadcast(first), "shard")
    parts = stored(
        parts.join(placed, "_group").select(
            "_group", "_part", "shard", (F.col("_first") - F.col("_shard_first") + F.col("_earlier")).alias("_slot")
        )
    )
    rank = F.row_number().over(Window.partitionBy("_group", "_part").orderBy("_id", "_row"))
    return (
        rows.withColumn("_rank", rank)
        .join(parts, ["_group", "_part"])
        .select(
            F.col("_id").alias(doc_id), "size", "text_crc32", "shard", (F.col("_slot") + F.col("_rank") - 1).alias("slot")
        )
    )
