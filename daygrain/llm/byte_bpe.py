"""Byte-level BPE encoding and decoding of whole texts."""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daygrain.llm.common import ship
from daygrain.llm.pretokenize import LONG, pieces, split_tokens

CACHED_WORDS = 400_000


def packed(ids: list[int]) -> bytes:
    """Ids as little-endian 32-bit integers."""
    return struct.pack(f"<{len(ids)}I", *ids)


class WordCache(dict):
    """Packed ids of words. When it is full, entries become the old ones, and old ones that are not used go."""

    def __init__(self, encode, most: int = CACHED_WORDS):
        super().__init__()
        self.encode, self.most, self.old = encode, most // 2, {}

    def __missing__(self, word: str) -> bytes:
        ids = self.old.get(word)
        if ids is None:
            ids = packed(self.encode(word))
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[word] = ids
        return ids


class ByteBpe:
    """Ranks of byte strings, loaded from a rank file (base64 and rank in each line)."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        vocabulary = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            vocabulary[rank] = token
        self.lengths = np.array([len(t) for t in vocabulary], np.int64)
        self.begins = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(vocabulary), np.uint8)
        self.decimals = [str(i) for i in range(len(vocabulary))]
        self.cache = WordCache(lambda word: self.merge(word.encode()))

    def merge(self, word: bytes) -> list[int]:
        """Ids of one word: adjacent parts are merged, least rank first and leftmost among equals."""
        ranks = self.ranks
        if word in ranks:
            return [ranks[word]]
        if len(word) > 64:
            return self._merge_long(word)
        parts = [word[i : i + 1] for i in range(len(word))]
        none = len(self.decimals)
        pairs = [ranks.get(a + b, none) for a, b in zip(parts, parts[1:])]
        while pairs:
            least = min(pairs)
            if least == none:
                break
            i = pairs.index(least)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del pairs[i]
            if i:
                pairs[i - 1] = ranks.get(parts[i - 1] + parts[i], none)
            if i < len(pairs):
                pairs[i] = ranks.get(parts[i] + parts[i + 1], none)
        return [ranks[p] for p in parts]

    def _merge_long(self, word: bytes) -> list[int]:
        """The same with a heap over a linked list, for words of any length."""
        ranks, n = self.ranks, len(word)
        ends = list(range(1, n + 1))  # part i is word[i:ends[i]]; 0 once merged away
        before = list(range(-1, n - 1))
        heap = []

        def offer(i: int) -> None:
            j = ends[i]
            if j < n and (rank := ranks.get(word[i : ends[j]])) is not None:
                heapq.heappush(heap, (rank, i, j, ends[j]))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, j, end = heapq.heappop(heap)
            if ends[i] != j or ends[j] != end:
                continue  # one of the parts has changed
            ends[i], ends[j] = end, 0
            if end < n:
                before[end] = i
                offer(i)
            if before[i] >= 0:
                offer(before[i])
        out, i = [], 0
        while i < n:
            out.append(ranks[word[i : ends[i]]])
            i = ends[i]
        return out

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit integers."""
        of = self.cache.__getitem__
        return [b"".join(map(of, words)) for words in split_tokens(texts)]

    def decode(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The bytes of the ids, and the offset in them at which each id's bytes start."""
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths)
        offsets = ends - lengths
        total = int(ends[-1]) if len(ends) else 0
        places = np.repeat(self.begins[ids] - offsets, lengths) + np.arange(total)
        return self.bytes[places].tobytes(), offsets


def in_batches(texts: list[str], longest: int = LONG) -> Iterator[list[str]]:
    """Consecutive texts, together about ``longest`` characters; longer texts alone."""
    batch, size = [], 0
    for text in texts:
        if batch and size + len(text) > longest:
            yield batch
            batch, size = [], 0
        batch.append(text)
        size += len(text)
    if batch:
        yield batch


@functools.cache
def coder(path: str) -> ByteBpe:
    """One coder and one cache in each Python worker."""
    return ByteBpe(path)


def encode_texts(bpe, texts: list[str | None]) -> Iterator[bytes]:
    """Ids of each text, in order; long texts are encoded piece by piece."""
    for batch in in_batches([t or "" for t in texts]):
        if len(batch) == 1 and len(batch[0]) > LONG:
            yield b"".join(bpe.encode_batch([p])[0] for p in pieces(batch[0]))
        else:
            yield from bpe.encode_batch(batch)


def encode(df: DataFrame, path: str, text: str = "text") -> DataFrame:
    """``df`` with ``ids`` (array of int) and ``offsets`` (the byte offset of every id's text).

    A null or empty text has no ids. Columns named ``ids`` or ``offsets`` are replaced.
    """
    ship(df.sparkSession)

    @F.pandas_udf("struct<ids: array<int>, offsets: array<bigint>>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        bpe = coder(path)
        for batch in batches:
            ids = [np.frombuffer(x, "<u4").astype(np.int64) for x in encode_texts(bpe, batch.tolist())]
            offsets = [np.cumsum(n) - n for n in (bpe.lengths[x] for x in ids)]
            yield pd.DataFrame({"ids": [x.astype(np.int32) for x in ids], "offsets": offsets})

    kept = [c for c in df.columns if c not in ("ids", "offsets")]
    coded = df.select(*[F.col(f"`{c}`") for c in kept], run(F.col(text).cast("string")).alias("_coded"))
    return coded.select(*[F.col(f"`{c}`") for c in kept], "_coded.ids", "_coded.offsets")


def decode(df: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """``df`` with ``decoded``: the bytes of the ids; null ids give null. A column of that name is replaced."""
    ship(df.sparkSession)

    @F.pandas_udf("binary")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bpe = coder(path)
        for batch in batches:
            yield pd.Series([None if x is None else bpe.decode(np.asarray(x, np.int64))[0] for x in batch], dtype=object)

    return df.withColumn("decoded", run(F.col(ids)))


def digests(df: DataFrame, path: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Per row the id, ``n_tokens``, and SHA-256 of the decimal ids and of the bytes decoded from them.

    Encodes and decodes within the task, so that the ids of a corpus need not leave it. A null text counts
    as empty: no tokens, and the digests of nothing. An empty input gives an empty result; repeated rows
    and null ids are rows like others, and other columns are ignored.
    """
    ship(df.sparkSession)

    @F.pandas_udf("struct<n_tokens: bigint, ids_sha256: string, decoded_sha256: string>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        bpe = coder(path)
        for batch in batches:
            rows = []
            for coded in encode_texts(bpe, batch.tolist()):
                ids = np.frombuffer(coded, "<u4")
                decimal = ",".join(map(bpe.decimals.__getitem__, ids.tolist())).encode()
                decoded, _ = bpe.decode(ids)
                rows.append((len(ids), hashlib.sha256(decimal).hexdigest(), hashlib.sha256(decoded).hexdigest()))
            yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return df.select(F.col(doc_id).alias(doc_id), run(F.col(text).cast("string")).alias("_coded")).select(
        doc_id, "_coded.*"
    )
