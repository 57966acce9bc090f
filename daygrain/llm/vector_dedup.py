"""Near-duplicate vectors: tiles of int8 products with rigorous bounds, doubtful pairs again in full precision."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daygrain.llm.common import components, ship, stored

TILE = 1024  # vectors of a tile, on average
EXACT = 1000  # components whose products of int8 codes a float32 sum holds exactly
PAIRS = 1 << 16  # pairs that are recomputed at once


class Quantised:
    """Unit vectors as int8 codes: ``unit = scale * code + rest`` with ``|rest| <= error``."""

    def __init__(self, vectors: np.ndarray):
        self.vectors = vectors
        # by the largest component first, so that squares neither overflow nor vanish
        shrunk = vectors / np.abs(vectors).max(axis=1, keepdims=True)
        self.unit = shrunk / np.sqrt((shrunk * shrunk).sum(axis=1, keepdims=True))
        self.scale = np.abs(self.unit).max(axis=1) / 127
        self.codes = np.rint(self.unit / self.scale[:, None]).astype(np.int8)
        rest = self.unit - self.scale[:, None] * self.codes
        # the slack covers rounding in the sums of this class
        self.error = np.sqrt((rest * rest).sum(axis=1)) + 1e-12 * vectors.shape[1]


def doubtful_pairs(a: Quantised, b: Quantised, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs whose cosine may reach the threshold, by the product of the codes and the bound of its error.

    With u = p + r and v = q + s (codes and rests), u.v - p.q = p.s + r.v, at most (1 + |r|)|s| + |r|.
    """
    product = np.zeros((len(a.codes), len(b.codes)))
    for at in range(0, a.codes.shape[1], EXACT):
        part = slice(at, at + EXACT)
        product += a.codes[:, part].astype(np.float32) @ b.codes[:, part].T.astype(np.float32)
    product *= a.scale[:, None]
    product *= b.scale[None, :]
    product += (1 + a.error)[:, None] * b.error[None, :]
    product += a.error[:, None]
    return np.nonzero(product >= threshold - 1e-12 * a.codes.shape[1])


def tile_links(a: Quantised, b: Quantised, threshold: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs with a cosine of at least ``threshold`` in double precision, each once within one tile."""
    left, right = doubtful_pairs(a, b, threshold)
    if same:
        once = left < right
        left, right = left[once], right[once]
    sure = np.zeros(len(left), bool)
    for at in range(0, len(left), PAIRS):
        part = slice(at, at + PAIRS)
        sure[part] = np.einsum("ij,ij->i", a.unit[left[part]], b.unit[right[part]]) >= threshold
    return left[sure], right[sure]


def forest(left: np.ndarray, right: np.ndarray, nodes: int) -> np.ndarray:
    """For every node the least node it is connected to."""
    root = np.arange(nodes)
    while True:
        least = np.minimum(root[left], root[right])
        new = root.copy()
        np.minimum.at(new, left, least)
        np.minimum.at(new, right, least)
        np.minimum.at(new, root[left], least)
        np.minimum.at(new, root[right], least)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def similar_vectors(
    df: DataFrame,
    threshold: float = 0.93,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    label: str = "label",
    tile: int = TILE,
) -> DataFrame:
    """One row per input row: the id, ``n_links``, ``component_id`` and ``kept``.

    Vectors of the same label and dimension link if their cosine in double precision is at least
    ``threshold``. Equal vectors of a label are one node that counts as often as it occurs. Nodes are dealt by
    hash into tiles of about ``tile`` vectors, every pair of tiles of a label is one task's unit of work, and
    from it come only link counts and the edges of a spanning forest: at most a row per vector, however many
    pairs link. So a label with very many rows, or a dense group, loads no single task.

    ``n_links`` counts the other rows that a row links with directly; ``component_id`` is the least id
    reachable over links, the row's own included; ``kept`` tells that the id is its component's. Rows whose
    label is null, or whose vector is null, empty, zero, or holds null or non-finite components, link with
    nothing. Null ids take part in links but name a component only if it has no other id. Repeated rows
    count as several rows and are kept alike. An empty input gives an empty result. Other columns are
    ignored, whatever their names.
    """
    ship(df.sparkSession)
    rows = stored(
        df.select(
            F.col(vec_id).alias("_id"),
            F.col(label).alias("_label"),
            F.col(embedding).cast("array<double>").alias("_vector"),
        ).select(
            "_id",
            "_label",
            F.when(
                F.col("_label").isNotNull()
                & ~F.exists("_vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
                & F.exists("_vector", lambda x: x != 0),
                # no negative zeros, so that equal vectors have equal bytes
                F.transform("_vector", lambda x: x + F.lit(0.0)),
            ).alias("_vector"),
        )
    )
    usable = rows.where(F.col("_vector").isNotNull())
    nodes = stored(
        usable.groupBy("_label", "_vector")
        .agg(F.count("*").alias("_n"), F.min("_id").alias("_least"))
        .withColumn("node", F.monotonically_increasing_id())
    )
    kind = ["_label", "_size"]
    sized = nodes.withColumn("_size", F.size("_vector"))
    tiles_of = stored(sized.groupBy(*kind).agg(F.ceil(F.count("*") / tile).cast("int").alias("_tiles")))
    tiles = stored(
        sized.join(tiles_of, kind)
        .withColumn("_tile", F.pmod(F.xxhash64("node"), F.col("_tiles")).cast("int"))
        .groupBy(*kind, "_tiles", "_tile")
        .agg(F.collect_list(F.struct("node", "_n", "_vector")).alias("_members"))
    )
    # each tile goes to its pairs with all tiles of its label
    paired = tiles.select(
        *kind, "_tile", "_members", F.explode(F.sequence(F.lit(0), F.col("_tiles") - 1)).alias("_other")
    ).select(*kind, F.least("_tile", "_other").alias("_a"), F.greatest("_tile", "_other").alias("_b"), "_tile", "_members")

    def links(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("_tile")
        sides = []
        for members in group["_members"]:
            ids = np.array([m["node"] for m in members], np.int64)
            counts = np.array([m["_n"] for m in members], np.int64)
            sides.append((ids, counts, Quantised(np.array([m["_vector"] for m in members], float))))
        first, last = sides[0], sides[-1]
        same = bool(group["_a"].iloc[0] == group["_b"].iloc[0])
        if not same and len(sides) < 2:
            return pd.DataFrame({"node": [], "links": [], "root": []})  # the other tile is empty
        left, right = tile_links(first[2], last[2], threshold, same)
        if same:
            ids, counts = first[:2]
        else:
            ids, counts = np.concatenate([first[0], last[0]]), np.concatenate([first[1], last[1]])
            right = right + len(first[0])
        found = np.zeros(len(ids), np.int64)
        np.add.at(found, left, counts[right])
        np.add.at(found, right, counts[left])
        touched = np.flatnonzero(found)
        root = forest(left, right, len(ids))
        return pd.DataFrame({"node": ids[touched], "links": found[touched], "root": ids[root[touched]]})

    found = stored(paired.groupBy(*kind, "_a", "_b").applyInPandas(links, "node long, links long, root long"))
    counted = found.groupBy("node").agg(F.sum("links").alias("_links"))
    roots = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    known = stored(
        nodes.join(counted, "node", "left")
        .join(roots, "node", "left")
        .withColumn("root", F.coalesce("root", "node"))
        .withColumn("n_links", F.coalesce("_links", F.lit(0)) + F.col("_n") - 1)
    )
    named = known.groupBy("root").agg(F.min("_least").alias("component_id"))
    known = stored(known.join(named, "root").select("_label", "_vector", "n_links", "component_id"))
    out = rows.join(known, ["_label", "_vector"], "left").select(
        F.col("_id").alias(vec_id),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
        F.coalesce("component_id", "_id").alias("component_id"),
    )
    return out.withColumn("kept", F.col(vec_id).eqNullSafe(F.col("component_id")))
