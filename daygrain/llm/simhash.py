"""Near duplicates by SimHash: fingerprints, pigeonhole blocks, verified links and their components."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daygrain.llm.common import components, ship, stored

BITS = 64


def shingles(text: str | None, words: int) -> Iterator[bytes]:
    """All word shingles of a text in order, repeats included; a shorter text is one, without words there is none."""
    parts = (text or "").encode().lower().split()
    joined = b" ".join(parts)
    if len(parts) <= words:
        yield from [joined] if parts else []
        return
    ends = list(itertools.accumulate(map(len, parts), lambda a, n: a + 1 + n))
    starts = [0, *[e + 1 for e in ends[: len(parts) - words]]]
    yield from (joined[a:b] for a, b in zip(starts, ends[words - 1 :]))


def fingerprint(text: str | None, words: int = 3) -> int:
    """SimHash over word shingles, repeats included, as a signed 64-bit integer.

    A-Z are lower-cased; words are runs without ASCII white space. A text of fewer than ``words`` words is
    one shingle, a text without words (or null) has fingerprint zero. A bit is 1 if it is set in over half
    of the shingles' XXH64 values (seed 42).
    """
    hashes = [xxhash.xxh64_intdigest(shingle, 42) for shingle in shingles(text, words)]
    if not hashes:
        return 0
    ones = np.zeros(BITS, dtype=np.int64)
    # a long text is counted in slices, so that its bits need little memory
    for at in range(0, len(hashes), 1 << 16):
        block = np.array(hashes[at : at + (1 << 16)], dtype="<u8")
        bits = np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int32)
    packed = np.packbits(2 * ones > len(hashes), bitorder="little")
    return int(packed.view("<i8")[0])


def block_masks(distance: int, blocks: int) -> list[int]:
    """Masks, as signed integers, that keep ``blocks - distance`` of the blocks.

    Two fingerprints that differ in at most ``distance`` bits differ in at most as many blocks, so they
    agree under at least one of these masks.
    """
    edges = [round(i * BITS / blocks) for i in range(blocks + 1)]
    parts = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in itertools.pairwise(edges)]
    masks = [sum(kept) for kept in itertools.combinations(parts, blocks - distance)]
    return [m - (1 << BITS) if m >> (BITS - 1) else m for m in masks]


def fingerprint_links(prints: DataFrame, distance: int = 2, blocks: int = 6) -> DataFrame:
    """All pairs ``(a, b)`` of distinct fingerprints at up to ``distance`` bits, from ``prints(print)``.

    Joined on blocks and verified inside the join. The join key keeps ``blocks - distance`` blocks (42 bits
    or more by default), so a key stands for at most ``2**22`` fingerprints however many documents there
    are, and a fingerprint has at most 2,080 others within two bits.
    """
    keys = F.explode(
        F.array(
            *[
                F.struct(F.lit(i).alias("mask"), F.col("print").bitwiseAND(F.lit(m)).alias("block"))
                for i, m in enumerate(block_masks(distance, blocks))
            ]
        )
    )
    blocked = prints.select("print", keys.alias("key")).select("print", "key.mask", "key.block")
    left, right = blocked.alias("l"), blocked.alias("r")
    return (
        left.join(
            right,
            (F.col("l.mask") == F.col("r.mask"))
            & (F.col("l.block") == F.col("r.block"))
            & (F.col("l.print") < F.col("r.print"))
            & (F.bit_count(F.col("l.print").bitwiseXOR(F.col("r.print"))) <= distance),
        )
        .select(F.col("l.print").alias("a"), F.col("r.print").alias("b"))
        .distinct()
    )


def near_duplicates(
    df: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    carry: tuple[str, ...] = (),
    words: int = 3,
    distance: int = 2,
    blocks: int = 6,
) -> DataFrame:
    """One row per input row: id, ``carry``, ``print`` (signed 64 bits), ``root`` and ``component_id``.

    Fingerprints at up to ``distance`` bits are linked. ``root`` is the least fingerprint of a component, as a
    signed integer, and ``component_id`` the least id in it.
    Documents with the same fingerprint are one node: copies are never paired.

    Null and empty texts have fingerprint zero and link like any other. Null ids take part but never name
    a component, unless all its ids are null. Repeated rows each get their row. An empty input gives an
    empty result. Other columns of ``df`` are ignored, whatever their names.
    """
    ship(df.sparkSession)

    @F.pandas_udf("long")
    def prints_of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([fingerprint(t, words) for t in batch], dtype="int64")

    rows = stored(
        df.select(
            F.col(doc_id).alias("_id"),
            *[F.col(c).alias(f"_carry_{c}") for c in carry],
            prints_of(F.col(text).cast("string")).alias("print"),
        )
    )
    nodes = stored(rows.groupBy("print").agg(F.min("_id").alias("_least")))
    links = fingerprint_links(nodes.select("print"), distance, blocks)
    roots = stored(components(links))
    linked = (
        nodes.join(roots, nodes["print"] == roots["node"], "left")
        .select("print", "_least", F.coalesce("root", "print").alias("root"))
    )
    named = linked.groupBy("root").agg(F.min("_least").alias("component_id"))
    by_print = stored(linked.join(named, "root").select("print", "root", "component_id"))
    return rows.join(by_print, "print").select(
        F.col("_id").alias(doc_id), *[F.col(f"_carry_{c}").alias(c) for c in carry], "print", "root", "component_id"
    )


def drop_near_duplicates(df: DataFrame, text: str = "text", doc_id: str = "doc_id", **options) -> DataFrame:
    """``df`` with one row of each component: the one with the least id, among equal ids the least text hash.

    Null ids come last. Of rows with the same id and text one stays, whichever. The other rules are those of
    :func:`near_duplicates`.
    """
    key = [F.xxhash64(F.col(doc_id)).alias("_id_key"), F.xxhash64(F.col(text)).alias("_text_key")]
    keys = ["_id_key", "_text_key"]
    keyed = df.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text"), *key)
    found = near_duplicates(keyed, "_text", "_id", carry=tuple(keys), **options)
    winners = stored(
        found.groupBy("root")
        .agg(F.min(F.struct(F.col("_id").isNull().alias("none"), F.col("_id"), *keys)).alias("_best"))
        .select("_best._id_key", "_best._text_key")
    )
    rows = df.select(*key, F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"))
    # both steps use the same keys, so that whole rows are dealt once
    stay = rows.join(winners, keys, "left_semi").groupBy(*keys).agg(F.first("_row").alias("_row"))
    return stay.select(*[F.col("_row")[c].alias(c) for c in df.columns])
