"""Packing of tokenised documents into sequences of fixed length by a grouping genetic algorithm on islands."""

from __future__ import annotations

import bisect
import functools
import random
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daygrain.llm.byte_bpe import CACHED_WORDS, encode_texts, packed
from daygrain.llm.common import ship, stored
from daygrain.llm.json_bpe import JsonBpe

BLOCK = 4096  # documents that are packed together, on average
ISLANDS, EPOCHS, POPULATION, CHILDREN = 3, 2, 5, 10
SOLID = 0.995  # a bin this full is handed on whole


@functools.cache
def coder(path: str, cached_words: int = CACHED_WORDS) -> JsonBpe:
    """One coder and one cache in each Python worker."""
    return JsonBpe(path, cached_words)


def document_pieces(
    df: DataFrame, path: str, text: str, doc_id: str, capacity: int, end_id: int, cached_words: int = CACHED_WORDS
) -> DataFrame:
    """Pieces of every document's ids and the end id: ``_id, _row, piece, start, length, ids_crc32``.

    Only documents of more than ``capacity`` ids are cut, into pieces of ``capacity`` behind a first piece
    with the rest. ``_row`` tells rows apart, also those with equal ids.
    """
    ship(df.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = coder(path, cached_words)
        end = packed([end_id])
        for batch in batches:
            at, piece, start, length, crc = [], [], [], [], []
            for row, coded in enumerate(encode_texts(bpe, batch["_text"].tolist())):
                coded += end
                total = len(coded) // 4
                bounds = [0, *range(total % capacity or capacity, total + 1, capacity)]
                for k, (a, b) in enumerate(zip(bounds, bounds[1:])):
                    at.append(row)
                    piece.append(k)
                    start.append(a)
                    length.append(b - a)
                    crc.append(zlib.crc32(coded[4 * a : 4 * b]))
            ids = batch[["_id", "_row"]].iloc[at].reset_index(drop=True)
            yield ids.assign(piece=piece, start=start, length=length, ids_crc32=crc)

    rows = df.select(
        F.col(doc_id).alias("_id"), F.monotonically_increasing_id().alias("_row"), F.col(text).cast("string").alias("_text")
    )
    kind = rows.schema["_id"].dataType.simpleString()
    return rows.mapInPandas(run, f"_id {kind}, _row long, piece int, start long, length long, ids_crc32 long")


# --- the genetic algorithm: a solution is a list of bins, a bin a tuple of lengths in descending order -------


def best_fit(bins: list[tuple[int, ...]], lengths: list[int], capacity: int) -> list[tuple[int, ...]]:
    """``lengths``, in their order, put each into the fullest bin that has room, or a new one."""
    full, open_bins, free = [], [], []
    for b in bins:
        room = capacity - sum(b)
        if room <= 0:
            full.append(b)
        else:
            free.append((room, len(open_bins)))
            open_bins.append(list(b))
    free.sort()
    for length in lengths:
        at = bisect.bisect_left(free, (length, -1))
        if at < len(free):
            room, i = free.pop(at)
        else:
            room, i = capacity, len(open_bins)
            open_bins.append([])
        open_bins[i].append(length)
        if room > length:
            bisect.insort(free, (room - length, i))
    return full + [tuple(sorted(b, reverse=True)) for b in open_bins]


def fitness(bins: list[tuple[int, ...]], capacity: int) -> tuple[int, float]:
    """Fewer bins first; among equals the one whose bins are more unevenly filled, so that rests gather."""
    return -len(bins), sum((sum(b) / capacity) ** 2 for b in bins)


def cross(giver: list[tuple[int, ...]], taker: list[tuple[int, ...]], capacity: int, rng: random.Random) -> list:
    """The taker with well-filled bins of the giver injected whole.

    Bins of the taker that hold a document of an injected bin go, and their other documents are put back by
    best fit, longest first.
    """
    injected = [b for b in giver if sum(b) >= SOLID * capacity and rng.random() < 0.5]
    # how many documents of each length are not placed yet
    rest = [0] * (capacity + 1)
    for b in taker:
        for x in b:
            rest[x] += 1
    for b in injected:
        for x in b:
            rest[x] -= 1
    kept = []
    order = [b for _, _, b in sorted((-sum(b), rng.random(), b) for b in taker)]
    # a few of the least filled bins are opened as well, so that their documents can go elsewhere
    opened = len(order) - max(2, len(order) // 20)
    for b in order[:opened]:
        for x in b:
            rest[x] -= 1
        if all(rest[x] >= 0 for x in b):
            kept.append(b)
        else:
            for x in b:
                rest[x] += 1
    displaced = [x for x in range(capacity, 0, -1) for _ in range(rest[x])]
    return best_fit(injected + kept, displaced, capacity)


def evolve(lengths: list[int], population: list, capacity: int, children: int, size: int, rng: random.Random) -> list:
    """The best ``size`` solutions, best first, after ``children`` crossings of ``population``.

    Without a population it starts from best fit in several orders; the first packing with the least possible number
    of bins ends the search.
    """
    least = -(-sum(lengths) // capacity)
    solutions = population or [best_fit([], lengths, capacity)]
    while len(solutions) < size and not population and len(solutions[-1]) > least:
        mixed = sorted(lengths, key=lambda x: -x * rng.uniform(0.8, 1.0))
        solutions.append(best_fit([], mixed, capacity))
    pool = [(fitness(s, capacity), s) for s in solutions]
    pool.sort(key=lambda x: x[0], reverse=True)
    for _ in range(children):
        if -pool[0][0][0] == least:
            break  # no packing has fewer bins
        a, b = rng.sample(range(len(pool)), 2) if len(pool) > 1 else (0, 0)
        child = cross(pool[min(a, b)][1], pool[max(a, b)][1], capacity, rng)
        pool.append((fitness(child, capacity), child))
        pool.sort(key=lambda x: x[0], reverse=True)
        del pool[size:]
    return [s for _, s in pool[:size]]


def _flat(bins: list[tuple[int, ...]]) -> list[int]:
    """A solution as one list, with a zero behind every bin."""
    return [x for b in bins for x in (*b, 0)]


def _bins(flat) -> list[tuple[int, ...]]:
    out, at = [], []
    for x in flat:
        if x:
            at.append(int(x))
        else:
            out.append(tuple(at))
            at = []
    return out


def pack_items(items: DataFrame, capacity: int, block: int, islands: int = ISLANDS, epochs: int = EPOCHS) -> DataFrame:
    """``items(_row, length)`` with ``sequence_id`` and ``offset``; lengths are 1 to ``capacity``, rows distinct.

    Rows are dealt by hash into blocks of about ``block``, however many there are. Each block is packed on
    several islands, each an own row with an own population, so that islands of all blocks spread over all
    tasks. After every epoch the best solution of each island migrates to the next island of its block;
    the best solution of a block at the end is used.
    """
    ship(items.sparkSession)
    total = items.count()
    blocks = max(1, round(total / block))
    dealt = stored(
        items.groupBy(F.pmod(F.xxhash64("_row"), F.lit(blocks)).alias("_block")).agg(
            F.sort_array(F.collect_list(F.struct(F.col("length"), F.col("_row"))), asc=False).alias("_items")
        )
    )
    schema = "_block long, _island int, lengths array<int>, population array<array<int>>"

    def grow(epoch: int):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                out = []
                for r in batch.itertuples(index=False):
                    rng = random.Random(f"{r[0]} {r[1]} {epoch}")
                    lengths = [int(x) for x in r[2]]
                    found = evolve(lengths, [_bins(s) for s in r[3]], capacity, CHILDREN, POPULATION, rng)
                    out.append((r[0], r[1], lengths, [_flat(s) for s in found]))
                yield pd.DataFrame(out, columns=["_block", "_island", "lengths", "population"])

        return run

    state = dealt.select(
        "_block",
        F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("_island"),
        F.transform("_items", lambda x: x["length"].cast("int")).alias("lengths"),
        F.array().cast("array<array<int>>").alias("population"),
    )
    # a number of tasks is given, so that small states of much work are not merged into one task
    tasks = min(blocks * islands, 4 * items.sparkSession.sparkContext.defaultParallelism)
    for epoch in range(epochs):
        spread = state.repartition(tasks, "_block", "_island")
        state = stored(spread.mapInPandas(grow(epoch), schema))
        elite = state.select(
            "_block", ((F.col("_island") + 1) % islands).cast("int").alias("_island"), F.col("population")[0].alias("_guest")
        )
        state = state.join(elite, ["_block", "_island"]).select(
            "_block", "_island", "lengths", F.array_union(F.array("_guest"), "population").alias("population")
        )
    best = state.groupBy("_block").agg(
        F.max_by(F.col("population")[0], -F.size(F.filter(F.col("population")[0], lambda x: x == 0))).alias("_best")
    )

    @F.pandas_udf("array<struct<_row: bigint, _bin: int, offset: bigint>>")
    def placed(rows: pd.Series, lengths: pd.Series, best: pd.Series) -> pd.Series:
        out = []
        for own, sizes, solution in zip(rows, lengths, best):
            waiting: dict[int, list[int]] = {}
            for row, size in zip(own, sizes):
                waiting.setdefault(int(size), []).append(int(row))
            result = []
            for number, chosen in enumerate(_bins(solution)):
                offset = 0
                for size in chosen:
                    result.append({"_row": waiting[size].pop(), "_bin": number, "offset": offset})
                    offset += size
            out.append(result)
        return pd.Series(out)

    return (
        dealt.join(best, "_block")
        .select(
            "_block",
            F.explode(placed(F.col("_items._row"), F.col("_items.length"), F.col("_best"))).alias("_at"),
        )
        .select("_at._row", (F.col("_block") * (1 << 24) + F.col("_at._bin")).alias("sequence_id"), "_at.offset")
    )


def pack_documents(
    df: DataFrame,
    path: str,
    text: str = "text",
    doc_id: str = "doc_id",
    capacity: int = 2048,
    end_id: int = 0,
    block: int = BLOCK,
    cached_words: int = CACHED_WORDS,
) -> DataFrame:
    """Pieces of all documents and their places: id, ``piece, start, length, ids_crc32, sequence_id, offset``.

    A document is its ids followed by ``end_id``; longer ones are cut into pieces of ``capacity``, the first
    of which may be shorter. Pieces of full length are sequences of their own (negative sequence ids); the
    first pieces of all documents are packed by the genetic algorithm.

    ``cached_words`` bounds the words whose ids a worker remembers: fewer take less memory and more time.

    A null or empty text is the end id alone. Repeated rows and null ids are documents like any other. An
    empty input gives an empty result. Other columns of ``df`` are ignored, whatever their names.
    """
    pieces = stored(document_pieces(df, path, text, doc_id, capacity, end_id, cached_words))
    whole = pieces.where(F.col("length") == capacity).select(
        "*", (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    part = pieces.where(F.col("length") < capacity)
    places = pack_items(part.select("_row", "length"), capacity, block)
    out = [F.col("_id").alias(doc_id), "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    return part.join(places, "_row").select(*out).unionByName(whole.select(*out))
