"""Language identification by compression with a dictionary of each language."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daygrain.llm.common import ship, stored

SAMPLE_TEXTS, SAMPLE_CHARS = 96, 1500  # of each language's dictionary, by default
MOST_LANGUAGES = 500  # more are an error: each has a dictionary in every worker
CHUNK = 4096  # bytes that are compressed at once, so that the dictionary counts everywhere in a long text
LEVEL = 6
NARROW = 0.01  # share by which the smallest size must be below the second
SHARPNESS = 40.0  # of the score, per byte and character
BETWEEN = re.compile(r"[\W\d_]+")
UNKNOWN = "und"


def dictionaries(
    df: DataFrame,
    learn: Column,
    text: str = "text",
    lang: str = "lang",
    doc_id: str = "doc_id",
    sample_texts: int = SAMPLE_TEXTS,
    sample_chars: int = SAMPLE_CHARS,
) -> dict[str, bytes]:
    """Raw dictionary content of every language among the rows with ``learn`` and a language, commonest first.

    About ``sample_texts`` rows of each language, chosen by a hash of id and text, give up to ``sample_chars``
    characters each, from a place chosen by the same hash; repeated rows give them once. These bounds are the only
    ones: counts cover all rows.
    """
    order = F.xxhash64(F.col(doc_id).cast("string"), F.col(text))
    rows = df.where(learn & F.col(lang).isNotNull() & (F.length(text) > 0)).select(
        F.col(lang).cast("string").alias("_lang"), F.col(text).alias("_text"), order.alias("_order")
    )
    # one row per language, so a small table as soon as their number is checked
    counts = stored(rows.groupBy("_lang").agg(F.count("*").alias("_n")))
    if (number := counts.count()) > MOST_LANGUAGES:
        raise ValueError(f"{number} languages; at most {MOST_LANGUAGES} can have a dictionary")
    share = F.pmod(F.col("_order"), F.lit(1_000_003)) < F.lit(1_000_003 * sample_texts) / F.col("_n")
    room = F.greatest(F.length("_text") - sample_chars, F.lit(0)) + 1
    sample = (
        rows.join(F.broadcast(counts), "_lang")
        .where(share)
        .select(
            "_lang",
            "_n",
            "_order",
            F.col("_text").substr((F.pmod("_order", room) + 1).cast("int"), F.lit(sample_chars)).alias("_text"),
        )
        .distinct()
        .collect()
    )
    parts: dict[str, list] = {}
    for r in sorted(sample, key=lambda r: (-r["_n"], r["_lang"], r["_order"], r["_text"])):
        parts.setdefault(r["_lang"], []).append(r["_text"])
    return {k: plain(" ".join(v)) for k, v in parts.items()}


def plain(text: str) -> bytes:
    """Lower-cased words with one space between, so that marks and capitals do not count."""
    return BETWEEN.sub(" ", text.lower()).encode()


class Compressors:
    """One compressor per language."""

    def __init__(self, contents: dict[str, bytes]):
        self.langs = list(contents)
        self.by_lang = []
        for lang in self.langs:
            words = zstandard.ZstdCompressionDict(contents[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            words.precompute_compress(level=LEVEL)
            self.by_lang.append(
                zstandard.ZstdCompressor(dict_data=words, write_content_size=False, write_checksum=False, write_dict_id=False)
            )

    def sizes(self, text: str) -> list[int]:
        """Compressed size of the whole text with each dictionary."""
        data = plain(text)
        chunks = [data[i : i + CHUNK] for i in range(0, len(data), CHUNK)]
        return [sum(len(c.compress(chunk)) for chunk in chunks) for c in self.by_lang]

    def predict(self, text: str | None) -> tuple[str, float, float]:
        """(language, score, margin) of a text."""
        if not text or not self.langs or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0, 0.0
        sizes = self.sizes(text)
        least = min(sizes)
        best = sizes.index(least)
        others = sizes[:best] + sizes[best + 1 :]
        weight = sum(math.exp(-SHARPNESS * (s - least) / len(text)) for s in sizes)
        margin = (min(others) - least) / least if others else 1.0
        return self.langs[best], 1.0 / weight, margin


def identify(
    df: DataFrame,
    learn: Column,
    text: str = "text",
    lang: str = "lang",
    doc_id: str = "doc_id",
    carry: tuple[str, ...] = (),
    sample_texts: int = SAMPLE_TEXTS,
    sample_chars: int = SAMPLE_CHARS,
) -> DataFrame:
    """Per row the id, ``carry``, ``lang_best``, ``score``, ``margin`` and ``rejected``.

    Every whole text is compressed, in chunks, with each language's dictionary; the smallest total wins
    (the commoner language among equals). ``score`` sets the sizes per character in proportion,
    ``margin`` is the share by which the second is larger, and a margin under NARROW is ``rejected``: the
    best language is then a guess. Dictionaries come from the rows with ``learn`` only, about ``sample_texts`` of
    each language with up to ``sample_chars`` characters of each; language and id of a row play no part in its
    prediction.

    Null and empty texts, texts without a letter, and all texts if no language can be learnt, are ``und``
    with score zero, rejected. Null languages are not learnt from. Repeated rows are rows like others; an
    empty input gives an empty result. Other columns are ignored, whatever their names.
    """
    ship(df.sparkSession)
    contents = dictionaries(df, learn, text, lang, doc_id, sample_texts, sample_chars)

    @F.pandas_udf("struct<lang_best: string, score: double, margin: double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        compressors = Compressors(contents)
        for batch in batches:
            yield pd.DataFrame([compressors.predict(t) for t in batch], columns=["lang_best", "score", "margin"])

    found = df.select(
        F.col(doc_id).alias("_id"),
        *[F.col(c).alias(f"_carry_{c}") for c in carry],
        run(F.col(text).cast("string")).alias("_found"),
    )
    return found.select(
        F.col("_id").alias(doc_id),
        *[F.col(f"_carry_{c}").alias(c) for c in carry],
        "_found.*",
        (F.col("_found.margin") < NARROW).alias("rejected"),
    )
