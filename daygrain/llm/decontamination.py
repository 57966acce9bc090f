"""Benchmark decontamination: suffix arrays over the words of training texts, searched for every benchmark suffix."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daygrain.llm.byte_bpe import in_batches
from daygrain.llm.common import ship, stored

#: Words of the benchmark that are searched at once; a larger one is searched in several passes.
BLOCK_WORDS = 1 << 20
#: Longer items are cut into overlapping pieces, so that blocks can be filled evenly.
PIECE_WORDS = 1 << 14
#: Words of one suffix array.
SHARD_WORDS = 1 << 21
#: ASCII characters other than digits and letters separate words; upper case goes before.
TO_SPACES = bytes(c if c >= 0x80 or chr(c).isalnum() else 0x20 for c in range(256))
CHUNK = 1 << 20


def word_chunks(text: str | None) -> Iterator[list[bytes]]:
    """The words of a text in order, in lists of bounded size: runs of digits, letters and all that is not ASCII."""
    raw = (text or "").encode().lower().translate(TO_SPACES)
    begin = 0
    while begin < len(raw):
        end = raw.find(b" ", begin + CHUNK)
        end = len(raw) if end < 0 else end
        yield raw[begin:end].split()
        begin = end


def words_of(text: str | None) -> list[bytes]:
    return [word for chunk in word_chunks(text) for word in chunk]


class Suffixes:
    """The suffixes of one block of benchmark pieces, as numbers of their words.

    ``starts`` and ``lengths`` are those of the distinct windows, ``sets`` and ``set_of`` the items that hold one, and
    ``orders`` are parts of the suffix array of the words.
    """

    def __init__(self, pieces: list[tuple[str | None, list[bytes]]], window: int):
        self.numbers: dict[bytes, int] = {}
        stream, first = [], {}
        holders: list[set[str]] = []
        self.starts, self.lengths, places = [], [], []
        for item, words in pieces:
            own = [self.numbers.setdefault(w, len(self.numbers) + 1) for w in words]
            length = min(window, len(own))
            for at in range(len(own) - length + 1 if own else 0):
                places.append((len(stream) + at, length))
                key = tuple(own[at : at + length])
                if key not in first:
                    first[key] = len(holders)
                    holders.append(set())
                    self.starts.append(len(stream) + at)
                    self.lengths.append(length)
                if item is not None:
                    holders[first[key]].add(item)
            stream += [*own, 0]
        self.words = np.array(stream, np.int64)
        self.starts, self.lengths = np.array(self.starts, np.int64), np.array(self.lengths, np.int64)
        # windows of the same items share their set
        sets = list({frozenset(h): None for h in holders})
        place = {s: i for i, s in enumerate(sets)}
        self.sets, self.set_of = sets, [place[frozenset(h)] for h in holders]
        self.least = int(self.lengths.min()) if len(self.lengths) else 0
        self.longest = max((len(words) for _, words in pieces), default=0)
        # the sorted suffixes that begin with a window, by its length
        begins = {}
        for at, length in places:
            begins.setdefault(length, set()).add(at)
        order = suffix_array(self.words, self.longest)
        self.orders = {n: order[np.isin(order, np.fromiter(own, np.int64, len(own)))] for n, own in begins.items()}

    def numbered(self, text: str | None) -> np.ndarray:
        """The words of a text by number; zero for those that the benchmark does not have."""
        get = self.numbers.get
        parts = [np.fromiter(map(get, own, repeat(0)), np.int64, len(own)) for own in word_chunks(text)]
        return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def suffix_array(words: np.ndarray, depth: int) -> np.ndarray:
    """Places in the order of their suffixes, by prefix doubling, compared on ``depth`` words or more.

    ``words`` are at least zero and end with a zero.
    """
    n = len(words)
    order = np.argsort(words, kind="stable")
    rank, done = _ranks(words[order], order), 1
    while done < depth and rank.max(initial=0) < n:
        later = np.zeros(n, np.int64)
        later[: n - done] = rank[done:]
        keys = rank * (n + 1) + later
        order = np.argsort(keys, kind="stable")
        rank, done = _ranks(keys[order], order), 2 * done
    return order


def _ranks(keys: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Ranks from 1 of places, equal for equal keys; ``keys`` are sorted."""
    rank = np.empty(len(order), np.int64)
    rank[order] = 1 + np.concatenate([[0], np.cumsum(keys[1:] != keys[:-1])]) if len(order) else 0
    return rank


def common_words(a: np.ndarray, at_a: np.ndarray, b: np.ndarray, at_b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """How many words from ``at_a`` in ``a`` and ``at_b`` in ``b`` on are equal and no zero, up to ``most``; all at once."""
    out = np.zeros(len(at_a), np.int64)
    live = np.flatnonzero(most > 0)
    step = 0
    while len(live):
        left, right = a[at_a[live] + step], b[at_b[live] + step]
        live = live[(left == right) & (left > 0)]
        step += 1
        out[live] = step
        live = live[most[live] > step]
    return out


def bounds(text: np.ndarray, order: np.ndarray, query: np.ndarray, starts: np.ndarray, lengths: np.ndarray, upper: bool):
    """For every ``query[start : start + length]`` the first place in ``order`` whose suffix of ``text`` is not less.

    With ``upper`` the first one that is greater and does not begin with it. All searches go on together.
    """
    low, high = np.zeros(len(starts), np.int64), np.full(len(starts), len(order), np.int64)
    while len(live := np.flatnonzero(low < high)):
        middle = (low[live] + high[live]) // 2
        at, begin, length = order[middle], starts[live], lengths[live]
        same = common_words(text, at, query, begin, length)
        whole = same == length
        # the first different word decides
        inside = np.minimum(begin + same, len(query) - 1)
        less = np.where(whole, upper, text[at + same * ~whole] < query[inside])
        low[live[less]] = middle[less] + 1
        high[live[~less]] = middle[~less]
    return low


def long_runs(words: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Runs of at least ``least`` words that are not zero, each with a zero behind it, and their places in ``words``."""
    marks = np.diff(np.concatenate([[0], (words > 0).astype(np.int8), [0]]))
    begins, ends = np.flatnonzero(marks == 1), np.flatnonzero(marks == -1)
    keep = ends - begins >= max(least, 1)
    begins, sizes = begins[keep], (ends - begins)[keep] + 1
    if not len(begins):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    ends = np.cumsum(sizes)
    places = np.repeat(begins - (ends - sizes), sizes) + np.arange(ends[-1])
    own = np.zeros(len(places), np.int64)
    inside = np.ones(len(places), bool)
    inside[ends - 1] = False
    own[inside] = words[places[inside]]
    return own, places


def occurrences(suffixes: Suffixes, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where windows occur in ``words``: places, numbers of the windows, and the longest verbatim matches from there.

    No window reaches over a word that the benchmark does not have, so only runs of its words go into the suffix array.
    """
    own, places = long_runs(words, suffixes.least)
    if not len(own):
        return (np.zeros(0, np.int64),) * 3
    order = suffix_array(own, suffixes.longest)
    query = suffixes.words
    low = bounds(own, order, query, suffixes.starts, suffixes.lengths, False)
    high = bounds(own, order, query, suffixes.starts, suffixes.lengths, True)
    counts = high - low
    window = np.repeat(np.arange(len(counts)), counts)
    at = order[np.repeat(low - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())]
    # the longest match from a place on: with a neighbour of its suffix among the suffixes that begin with windows
    longest = np.zeros(len(at), np.int64)
    for size, tests in suffixes.orders.items():
        own_size = np.flatnonzero(suffixes.lengths[window] == size)
        here = at[own_size]
        most = np.full(len(here), suffixes.longest)
        near = bounds(query, tests, own, here, most, False)
        for neighbour in (near - 1, near):
            valid = np.flatnonzero((neighbour >= 0) & (neighbour < len(tests)))
            match = common_words(own, here[valid], query, tests[neighbour[valid]], most[valid])
            longest[own_size[valid]] = np.maximum(longest[own_size[valid]], match)
    return places[at], window, longest


FOUND = "n_words long, starts array<int>, ends array<int>, items array<string>, longest int, longest_at int"


def search(suffixes: Suffixes, texts: list[str | None]) -> list[tuple]:
    """Per text: number of words, merged hit ranges (starts and ends), items, longest match and where it starts."""
    out = []
    for batch in in_batches([t or "" for t in texts]):
        numbered = [suffixes.numbered(t) for t in batch]
        sizes = np.array([len(x) + 1 for x in numbered])
        begins = np.cumsum(sizes) - sizes
        stream = np.concatenate([part for x in numbered for part in (x, np.zeros(1, np.int64))])
        found = []
        # shards overlap, so that every occurrence lies whole in one
        reach = max(suffixes.longest - 1, 0)
        for at in range(0, len(stream), SHARD_WORDS):
            place, window, longest = occurrences(suffixes, stream[at : at + SHARD_WORDS + reach])
            mine = place < SHARD_WORDS
            found.append((place[mine] + at, window[mine], longest[mine]))
        place, window, longest = (np.concatenate(x) for x in zip(*found))
        edges = np.zeros(len(stream) + 1, np.int64)
        np.add.at(edges, place, 1)
        np.add.at(edges, place + suffixes.lengths[window], -1)
        hit = np.diff(np.concatenate([[0], np.cumsum(edges[:-1]) > 0, [0]]).astype(np.int8))
        starts, ends = np.flatnonzero(hit == 1), np.flatnonzero(hit == -1)
        owner = np.searchsorted(begins, place, side="right") - 1
        per_text: dict[int, tuple[set[int], list[tuple[int, int]]]] = {}
        for text, number, length, at in zip(owner.tolist(), window.tolist(), longest.tolist(), place.tolist()):
            sets, best = per_text.setdefault(text, (set(), [(0, 0)]))
            sets.add(suffixes.set_of[number])
            best[0] = max(best[0], (length, -at))
        first = np.searchsorted(starts, begins).tolist()
        last = np.searchsorted(starts, begins + sizes).tolist()
        for text, words in enumerate(numbered):
            sets, [(length, at)] = per_text.get(text, (set(), [(0, 0)]))
            begin = int(begins[text])
            out.append(
                (
                    len(words),
                    starts[first[text] : last[text]] - begin,
                    ends[first[text] : last[text]] - begin,
                    sorted(set().union(*(suffixes.sets[i] for i in sets))),
                    length or None,
                    -at - begin if length else None,
                )
            )
    return out


def benchmark_blocks(benchmark: DataFrame, text: str, item_id: str, window: int, block_words: int) -> Iterator[list]:
    """The benchmark's pieces ``(item, words)`` in blocks of about ``block_words``, one after the other.

    Items of more than ``PIECE_WORDS`` are cut into pieces that overlap by a window less a word, so no window is lost.
    """
    ship(benchmark.sparkSession)

    @F.pandas_udf("array<string>")
    def cut(texts: pd.Series) -> pd.Series:
        out = []
        for words in map(words_of, texts):
            step = max(PIECE_WORDS - window + 1, 1)
            cuts = range(0, max(len(words) - window + 1, 1), step)
            out.append([b" ".join(words[a : a + step + window - 1]).decode() for a in cuts if words])
        return pd.Series(out, dtype=object)

    pieces = benchmark.select(
        F.col(item_id).cast("string").alias("item"), F.explode(cut(F.col(text).cast("string"))).alias("piece")
    ).distinct()
    pieces = stored(pieces.withColumn("n", F.size(F.split("piece", " "))))
    total = pieces.agg(F.sum("n")).first()[0] or 0
    blocks = -(-total // block_words)
    # dealt by hash of item and piece, as rows are distinct: sizes are nearly even, and the same in every run
    block = F.pmod(F.xxhash64("item", "piece"), F.lit(max(blocks, 1)))
    for number in range(blocks):
        rows = pieces.where(block == number).select("item", "piece").collect()
        yield [(r["item"], r["piece"].encode().split(b" ")) for r in rows]


def _finder(df: DataFrame, pieces: list, window: int):
    """A column function that searches texts for one block, which is broadcast; its size is that of a block."""
    shared = df.sparkSession.sparkContext.broadcast(pieces)

    @F.pandas_udf(FOUND)
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        suffixes = Suffixes(shared.value, window)
        for batch in batches:
            yield pd.DataFrame(search(suffixes, batch.tolist()), columns=[c.split()[0] for c in FOUND.split(", ")])

    return find


def _merged(starts: pd.Series, ends: pd.Series) -> pd.DataFrame:
    """Ranges of several blocks as disjoint ones."""
    out = []
    for begin, end in zip(starts, ends):
        own: list[list[int]] = []
        for a, b in sorted((int(a), int(b)) for x, y in zip(begin, end) for a, b in zip(x, y)):
            if own and a <= own[-1][1]:
                own[-1][1] = max(own[-1][1], b)
            else:
                own.append([a, b])
        out.append(([a for a, _ in own], [b for _, b in own]))
    return pd.DataFrame(out, columns=["starts", "ends"])


def contamination(
    df: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    carry: tuple[str, ...] = (),
    item_text: str = "text",
    item_id: str = "item_id",
    window: int = 10,
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """Per row: id, ``carry``, ``n_words, starts, ends, items, longest, longest_at``.

    A-Z are lower-cased; words are runs of digits, letters and characters that are not ASCII. ``window`` consecutive
    words of an item are a window, as are all words of an item with fewer. ``starts`` and ``ends`` are the ranges of
    words inside any occurrence of a window, merged where they touch. ``items`` are the ids, as sorted text, of items
    with occurring windows. ``longest`` is the length in words of the longest verbatim match with an item from
    one of its windows on, ``longest_at`` its first word, the first of equally long ones; both null without a hit. Where an item is longer
    than ``PIECE_WORDS``, matches are followed to the ends of its pieces.

    A null or empty text has no words. Items without words have no windows; items with null ids make hits but are not
    listed; repeated items count once. An empty table on either side gives no rows or no hits. Repeated rows and null
    ids are rows like others; other columns are ignored, whatever their names.

    The benchmark is searched in blocks of about ``block_words`` words, which are broadcast one by one; every block
    after the first costs one more pass over the texts, of which it keeps those with hits.
    """
    ship(df.sparkSession)
    body = F.col(text).cast("string")
    blocks = benchmark_blocks(benchmark, item_text, item_id, window, block_words)
    find = _finder(df, next(blocks, []), window)
    rows = df.select(
        F.col(doc_id).alias("_id"),
        *[F.col(c).alias(f"_carry_{c}") for c in carry],
        F.sha2(body, 256).alias("_digest"),
        find(body).alias("_found"),
    )
    later = []
    for pieces in blocks:
        found = df.select(F.sha2(body, 256).alias("_digest"), _finder(df, pieces, window)(body).alias("_more"))
        # one row of each text with hits, however many copies there are
        hits = found.where(F.size("_more.starts") > 0).groupBy("_digest").agg(F.first("_more").alias("_more"))
        later.append(stored(hits))
    fields = [f.split()[0] for f in FOUND.split(", ")]
    names = [F.col("_id").alias(doc_id), *[F.col(f"_carry_{c}").alias(c) for c in carry]]
    if not later:
        return rows.select(*names, *[f"_found.{f}" for f in fields])
    more = later[0]
    for other in later[1:]:
        more = more.unionByName(other)
    # a row per block at most, for each text
    more = more.groupBy("_digest").agg(F.collect_list("_more").alias("_more"))
    merged = F.pandas_udf(_merged, "starts array<int>, ends array<int>")
    every = F.concat(F.array("_found"), F.coalesce("_more", F.array().cast(more.schema["_more"].dataType)))
    every = rows.join(more, "_digest", "left").withColumn("_all", every)
    every = every.withColumn("_ranges", merged("_all.starts", "_all.ends")).withColumn(
        "_best",
        F.array_max(F.transform("_all", lambda x: F.struct(x["longest"].alias("n"), (-x["longest_at"]).alias("at")))),
    )
    return every.select(
        *names,
        "_found.n_words",
        "_ranges.starts",
        "_ranges.ends",
        F.array_sort(F.array_distinct(F.flatten("_all.items"))).alias("items"),
        F.col("_best.n").alias("longest"),
        (-F.col("_best.at")).alias("longest_at"),
    )


def remove_contaminated(df: DataFrame, benchmark: DataFrame, text: str = "text", window: int = 10, **options) -> DataFrame:
    """The rows of ``df`` whose text holds no window of the benchmark; the rules are those of :func:`contamination`.

    ``options`` are its ``item_text``, ``item_id`` and ``block_words``. Each block filters what the one before left.
    """
    ship(df.sparkSession)
    names = {"item_text": "text", "item_id": "item_id", "block_words": BLOCK_WORDS} | options
    out = df
    for pieces in benchmark_blocks(benchmark, names["item_text"], names["item_id"], window, names["block_words"]):
        out = out.where(F.size(_finder(df, pieces, window)(F.col(text).cast("string"))["starts"]) == 0)
    return out


def n_hit(starts: Column, ends: Column) -> Column:
    """The number of words in the ranges."""
    sizes = F.zip_with(ends, starts, lambda b, a: (b - a).cast("long"))
    return F.aggregate(sizes, F.lit(0).cast("long"), lambda total, size: total + size)
