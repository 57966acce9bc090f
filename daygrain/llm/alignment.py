"""Alignment of the tokens that two tokenizers give the same text, by the byte offsets at which both end."""

from __future__ import annotations

import functools
import hashlib
import itertools
from array import array
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daygrain.llm.byte_bpe import in_batches
from daygrain.llm.common import ship, written
from daygrain.llm.json_bpe import JsonBpe, cut

#: Segments whose alignment a worker remembers.
CACHED_SEGMENTS = 400_000
#: Longer segments are not remembered.
LONG_SEGMENT = 200
#: Unknown segments that are encoded as one text.
TOGETHER = 1000
#: Links of a segment that are kept one by one; segments with more have a number for each pair of ids.
SINGLE_LINKS = 4096
#: Distinct id pairs whose counts are broadcast; with more, links are brought to the counts by a shuffle.
BROADCAST_PAIRS = 1 << 21
#: The alignment of a text without tokens.
NOTHING = (0, 0, 0, 0, "", np.zeros(0, np.int64), np.zeros(0, np.int64))


class Aligned(NamedTuple):
    """The alignment of a segment. ``pairs`` has a packed id pair for every link, ``many`` the numbers of the rest."""

    n_a: int
    n_b: int
    n_groups: int
    n_links: int
    text: str
    pairs: bytes
    many: tuple[tuple[int, int], ...]


#: In place of an alignment: the bytes of the tokens differ from those of the segment.
DIFFERENT = "different"


def align(ids_a: list[int], ids_b: list[int], ends_a: list[int], ends_b: list[int], stops: list[int]) -> list[Aligned]:
    """The alignments of consecutive segments that end at the offsets ``stops``, at which tokens of both end.

    ``ends`` are the cumulative ends of the tokens. Dictionaries lead from ends to tokens; the sorted ends that both
    have slice the ids into groups. Of tokens without bytes the last one at an offset counts.
    """
    at_a = dict(zip(ends_a, range(1, len(ids_a) + 1)))
    at_b = dict(zip(ends_b, range(1, len(ids_b) + 1)))
    common = sorted(at_a.keys() & at_b.keys())
    to_a, to_b = [0, *map(at_a.__getitem__, common)], [0, *map(at_b.__getitem__, common)]
    texts, links, singles, totals, many = [], array("q"), [0], [0], {}
    total = 0
    for group, (a, next_a, b, next_b) in enumerate(zip(to_a, to_a[1:], to_b, to_b[1:])):
        size = (next_a - a) * (next_b - b)
        total += size
        if size == 1:
            texts.append(f"{ids_a[a]}|{ids_b[b]}")
            links.append(ids_a[a] << 32 | ids_b[b])
        else:
            own_a, own_b = ids_a[a:next_a], ids_b[b:next_b]
            texts.append(f"{','.join(map(str, own_a))}|{','.join(map(str, own_b))}")
            if size <= SINGLE_LINKS:
                links.extend([x << 32 | y for x in own_a for y in own_b])
            else:
                # a long group: as many pairs as there are different ids, however often they repeat
                often_b = Counter(own_b)
                many[group] = {x << 32 | y: n * m for x, n in Counter(own_a).items() for y, m in often_b.items()}
        singles.append(len(links))
        totals.append(total)
    packed_links = links.tobytes()
    place = dict(zip(common, range(1, len(common) + 1)))
    out, begin = [], 0
    for stop in stops:
        end = place[stop]
        rest: dict[int, int] = {}
        for group in range(begin, end) if many else ():
            for pair, n in many.get(group, {}).items():
                rest[pair] = rest.get(pair, 0) + n
        out.append(
            Aligned(
                to_a[end] - to_a[begin],
                to_b[end] - to_b[begin],
                end - begin,
                totals[end] - totals[begin],
                ";".join(texts[begin:end]),
                packed_links[8 * singles[begin] : 8 * singles[end]],
                tuple(rest.items()),
            )
        )
        begin = end
    return out


class Aligner:
    """Aligns a byte-level tokenizer file (A) with a sentencepiece model (B), segment by segment with a cache.

    Texts are cut into segments at places where tokens of both end whatever comes before or after, so that groups
    never reach over a cut: A starts a token there by its split pattern, B as no piece holds a space behind another
    character, which is checked.
    """

    def __init__(self, path_a: str, path_b: str, most: int = CACHED_SEGMENTS):
        import sentencepiece

        self.a = JsonBpe(path_a, most=8, plain=True)
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if any("▁" in name.lstrip("▁") for name in names):
            raise ValueError("pieces of the model reach over spaces")
        self.bytes_b = [
            bytes([int(name[3:5], 16)]) if self.b.is_byte(i) else name.replace("▁", " ").encode()
            for i, name in enumerate(names)
        ]
        self.most, self.cache, self.old = most // 2, {}, {}

    def aligned(self, parts: list[str]) -> list[Aligned] | None:
        """The alignments of segments that are encoded as one text; None if the bytes of the tokens differ from it."""
        text = " " + " ".join(parts)
        ids_a, ids_b = self.a.segment(text), self.b.encode(text[1:])
        bytes_a, bytes_b = [self.a.entries[i] for i in ids_a], [self.bytes_b[i] for i in ids_b]
        if not b"".join(bytes_a) == b"".join(bytes_b) == text.encode():
            return None
        ends_a, ends_b = (list(itertools.accumulate(map(len, x))) for x in (bytes_a, bytes_b))
        stops = list(itertools.accumulate(len(part.encode()) + 1 for part in parts))
        return align(ids_a, ids_b, ends_a, ends_b, stops)

    def learn(self, parts: list[str]) -> dict[str, Aligned | str]:
        """The alignments of segments that the cache does not hold; long ones are not kept."""
        fresh, group = {}, []
        for part in parts:
            if part in self.old:
                fresh[part] = self.old[part]
            elif len(part) < LONG_SEGMENT and part and not part[0].isspace() and not part[-1].isspace():
                group.append(part)
            else:
                fresh[part] = (self.aligned([part]) or [DIFFERENT])[0]
        # as texts of several segments, which are cut between them
        for at in range(0, len(group), TOGETHER):
            own = group[at : at + TOGETHER]
            found = self.aligned(own) or [(self.aligned([part]) or [DIFFERENT])[0] for part in own]
            fresh |= zip(own, found)
        for part, found in fresh.items():
            if len(part) <= LONG_SEGMENT:
                if len(self.cache) >= self.most:
                    # entries that are not used until the next time go
                    self.old, self.cache = self.cache, {}
                self.cache[part] = found
        return fresh

    def texts(self, texts: list[str | None]) -> Iterator[tuple]:
        """Per text numbers of tokens, groups and links, the digest of the groups, the distinct pairs with numbers."""
        for batch in in_batches([t or "" for t in texts]):
            parts = [cut(text) if text else [] for text in batch]
            known = [list(map(self.cache.get, own)) for own in parts]
            fresh = self.learn(list({p for own, found in zip(parts, known) for p, x in zip(own, found) if x is None}))
            for own, found in zip(parts, known):
                if None in found:
                    found = [fresh[p] if x is None else x for p, x in zip(own, found)]
                yield NOTHING if not found or DIFFERENT in found else self.joined(found)

    @staticmethod
    def joined(found: list[Aligned]) -> tuple:
        n_a, n_b, n_groups, n_links, texts, pairs, many = zip(*found)
        keys, numbers = np.unique(np.frombuffer(b"".join(pairs), "<i8"), return_counts=True)
        if any(many):
            rest = Counter(dict(zip(keys.tolist(), numbers.tolist())))
            for own in many:
                for pair, n in own:
                    rest[pair] += n
            keys = np.array(sorted(rest), np.int64)
            numbers = np.array([rest[x] for x in keys.tolist()], np.int64)
        digest = hashlib.sha256(";".join(texts).encode()).hexdigest()
        return sum(n_a), sum(n_b), sum(n_groups), sum(n_links), digest, keys, numbers


@functools.cache
def aligner(path_a: str, path_b: str) -> Aligner:
    """One aligner and one cache in each Python worker."""
    return Aligner(path_a, path_b)


NUMBERS = ("n_a", "n_b", "n_groups", "n_links")


def aligned_texts(
    df: DataFrame, path_a: str, path_b: str, text: str = "text", doc_id: str = "doc_id", carry: tuple[str, ...] = ()
) -> DataFrame:
    """One row per row of ``df``, reread from the shared folder: ``_row, _id``, ``_carry_...``, the numbers of A and B
    tokens, groups and links, ``groups_sha256``, and the distinct linked pairs as arrays ``a``, ``b`` and ``links``.

    ``_row`` tells rows apart. The rules are those of :func:`token_links`.
    """
    ship(df.sparkSession)
    rows = df.select(
        F.monotonically_increasing_id().alias("_row"),
        F.col(doc_id).alias("_id"),
        *[F.col(c).alias(f"_carry_{c}") for c in carry],
        F.col(text).cast("string").alias("_text"),
    )
    kept = rows.drop("_text").schema
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    schema += ", n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
    schema += ", a array<int>, b array<int>, links array<bigint>"

    def lists(parts: list[np.ndarray], kind) -> pa.ListArray:
        ends = np.cumsum([0, *map(len, parts)])
        flat = np.concatenate(parts) if parts else np.zeros(0, kind)
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat.astype(kind)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = aligner(path_a, path_b).texts
        for batch in batches:
            found = list(texts(batch.column("_text").to_pylist()))
            *numbers, digests, keys, links = zip(*found) if found else [()] * 7
            arrays = [
                *(batch.column(f.name) for f in kept),
                *(pa.array(n, pa.int64()) for n in numbers),
                pa.array(digests, pa.string()),
                lists([k >> 32 for k in keys], np.int32),
                lists([k & 0xFFFFFFFF for k in keys], np.int32),
                lists(list(links), np.int64),
            ]
            names = [*kept.names, *NUMBERS, "groups_sha256", "a", "b", "links"]
            yield pa.RecordBatch.from_arrays(arrays, names)

    return written(rows.mapInArrow(run, schema), "aligned")


def pair_counts(aligned: DataFrame) -> DataFrame:
    """Per linked id pair ``pair, n_docs, best``: the rows that hold it linked, and if none of its A id has more.

    A row counts once however often it holds a pair. Reread from the shared folder.
    """
    spread = aligned.select(F.explode(F.arrays_zip("a", "b")).alias("_p"))
    packed = F.shiftleft(F.col("_p.a").cast("long"), 32).bitwiseOR(F.col("_p.b").cast("long"))
    counts = written(spread.groupBy(packed.alias("pair")).agg(F.count("*").alias("n_docs")), "pair_counts")
    by_a = counts.withColumn("_a", F.shiftright("pair", 32))
    most = by_a.groupBy("_a").agg(F.max("n_docs").alias("_most"))
    # at most one row per entry of A's vocabulary
    return written(
        by_a.join(F.broadcast(most), "_a").select("pair", "n_docs", (F.col("n_docs") == F.col("_most")).alias("best")),
        "pair_counts",
    )


def token_links(
    df: DataFrame,
    path_a: str,
    path_b: str,
    text: str = "text",
    doc_id: str = "doc_id",
    carry: tuple[str, ...] = (),
    broadcast_pairs: int = BROADCAST_PAIRS,
) -> DataFrame:
    """Per row: id, ``carry``, ``n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``.

    A space and the text is encoded by the byte-level tokenizer file ``path_a`` (A), the text by the sentencepiece
    model ``path_b`` (B), which adds the space itself; strings of special tokens are plain text. Offsets at which
    tokens of both end cut them into groups, within which all tokens of A are linked to all of B. A pair of ids
    counts the rows that hold it linked; a link is best if no pair of its A id counts more. ``count_sum`` adds the
    counts of a row's links, each as often as it occurs. Sums beyond 64 bits are null.

    A null or empty text, and one whose joined A or B bytes are not the space and the text, has no tokens: zeros
    and an empty digest. Repeated rows and null ids are rows like others and count in the pairs. An empty input
    gives an empty result. Other columns are ignored, whatever their names.

    Each text is encoded once; its distinct pairs are a table in the shared folder. The counts of up to
    ``broadcast_pairs`` pairs are broadcast, more of them are joined by a shuffle with the same result.
    """
    aligned = aligned_texts(df, path_a, path_b, text, doc_id, carry)
    counts = pair_counts(aligned)
    spread = aligned.select("_row", F.explode(F.arrays_zip("a", "b", "links")).alias("_p")).select(
        "_row",
        F.shiftleft(F.col("_p.a").cast("long"), 32).bitwiseOR(F.col("_p.b").cast("long")).alias("pair"),
        F.col("_p.links").alias("links"),
    )
    few = counts.count() <= broadcast_pairs
    sums = (
        spread.join(F.broadcast(counts) if few else counts, "pair")
        .groupBy("_row")
        .agg(
            F.try_sum(F.when(F.col("best"), F.col("links")).otherwise(0)).alias("n_best"),
            F.try_sum(F.try_multiply("links", "n_docs")).alias("count_sum"),
        )
        .withColumn("_some", F.lit(True))
    )
    some = F.col("_some").isNotNull()
    return aligned.join(sums, "_row", "left").select(
        F.col("_id").alias(doc_id),
        *[F.col(f"_carry_{c}").alias(c) for c in carry],
        *NUMBERS,
        *[F.when(some, F.col(c)).otherwise(F.lit(0).cast("long")).alias(c) for c in ("n_best", "count_sum")],
        "groups_sha256",
    )
