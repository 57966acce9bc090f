"""Secrets in texts: fixed patterns, and character Markov models of random strings and ordinary identifiers."""

from __future__ import annotations

import re
import string
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daygrain.llm.byte_bpe import in_batches
from daygrain.llm.common import ship

# fixed patterns; only ASCII letters match in either case
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
ASSIGN_HINTS = ("passw", "secret", "token", "apikey", "api_key")
ACCESS = re.compile("AKIA[A-Z0-9]+")
HEX = re.compile("[0-9a-f]{24,}")  # runs of 24 and more, as all shorter runs are dropped
KINDS = ("assign", "access", "hex", "markov")

LETTERS, DIGITS = re.compile("[A-Za-z]"), re.compile("[0-9]")

# symbols of the Markov models; everything else ends an identifier
SYMBOLS = string.ascii_letters + string.digits + "+/=_-"
BREAK = len(SYMBOLS)
STATES = BREAK + 1
LEAST_LENGTH = 16  # of an identifier that the models judge
LEAST_RATIO = float(np.log(1e6))  # log-likelihood ratio from which it counts as random
# share of an even distribution in each model: a random string may have any step, an ordinary one hardly
RANDOM_EVEN, ORDINARY_EVEN = 0.5, 0.001


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of all matches of the fixed patterns, in order."""
    found = []
    lower = text.lower()
    if any(hint in lower for hint in ASSIGN_HINTS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def labelled(text: str) -> tuple[list[str], list[tuple[int, int, int]]]:
    """The labelled samples of a text: its random strings, and the spans that are left out of the ordinary ones.

    Random are whole access and hex matches, and of an assignment the value alone, if it has itself LEAST_LENGTH
    characters and letters as well as digits; overlapping ones are one sample. Everything else of a match is neither.
    """
    spans = base_spans(text)
    proven = [(a, b) for a, kind, b in spans if kind > 0]
    for a, kind, b in spans:
        if kind == 0:
            value = ASSIGN.match(text, a, b)[2]
            if len(value) >= LEAST_LENGTH and DIGITS.search(value) and LETTERS.search(value):
                proven.append((b - len(value), b))
    merged: list[tuple[int, int]] = []
    for a, b in sorted(proven):
        if merged and a < merged[-1][1]:
            merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
        else:
            merged.append((a, b))
    samples = [text[a:b] for a, b in merged]
    return samples, spans


def _symbol_table() -> np.ndarray:
    table = np.full(0x110000, BREAK, np.uint8)
    table[[ord(c) for c in SYMBOLS]] = np.arange(BREAK)
    return table


class Runs:
    """Identifiers (runs of symbols) in texts that are joined by line ends, and their steps."""

    def __init__(self, texts: list[str], table: np.ndarray, least: int):
        joined = "\n".join(texts)
        symbols = table[np.frombuffer(joined.encode("utf-32-le"), np.uint32)]
        inside = np.concatenate([[False], symbols != BREAK, [False]])
        turns = np.flatnonzero(inside[1:] != inside[:-1])
        self.starts, self.ends = turns[::2], turns[1::2]
        long = self.ends - self.starts >= least
        self.starts, self.ends = self.starts[long], self.ends[long]
        # where each text starts in the joined one
        self.begins = np.cumsum([0, *[len(t) + 1 for t in texts[:-1]]]) if texts else np.zeros(0, np.int64)
        self.owner = np.searchsorted(self.begins, self.starts, side="right") - 1
        lengths = self.ends - self.starts
        self.first = np.cumsum(lengths) - lengths
        places = np.repeat(self.starts - self.first, lengths) + np.arange(int(lengths.sum()))
        current = symbols[places].astype(np.int32)
        before = np.concatenate([[BREAK], current[:-1]]).astype(np.int32)
        before[self.first] = BREAK
        self.steps = before * STATES + current

    def overlaps(self, spans: list[list[tuple[int, int, int]]]) -> np.ndarray:
        """Whether each run shares a character with one of its text's spans."""
        places = [(begin + a, begin + b) for begin, own in zip(self.begins.tolist(), spans) for a, _, b in own]
        out = np.zeros(len(self.starts), bool)
        if places:
            # spans of different kinds can overlap: the furthest end so far decides
            a, b = np.array(sorted(places)).T
            furthest = np.maximum.accumulate(b)
            i = np.searchsorted(a, self.ends, side="left") - 1
            out = (i >= 0) & (furthest[np.maximum(i, 0)] > self.starts)
        return out


def train(df: DataFrame, text: str = "text") -> np.ndarray:
    """Log-likelihood ratio of every step between symbols, random against ordinary.

    The labelled samples come from all texts: those of :func:`labelled` are random, identifiers outside all matches of
    the fixed patterns ordinary. Only the counts of steps come to the driver (at most 2 x 68 x 68). A symbol never
    seen has the even distribution.
    """
    ship(df.sparkSession)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = _symbol_table()
        totals = np.zeros(2 * STATES * STATES, np.int64)
        for batch in batches:
            for texts in in_batches([t or "" for t in batch["_text"]]):
                samples, spans = zip(*map(labelled, texts))
                runs = Runs(texts, table, 1)
                ordinary = np.repeat(~runs.overlaps(list(spans)), runs.ends - runs.starts)
                totals += np.bincount(runs.steps[ordinary], minlength=len(totals))
                found = Runs([x for own in samples for x in own], table, 1)
                totals += np.bincount(found.steps + STATES * STATES, minlength=len(totals))
        seen = np.flatnonzero(totals)
        yield pd.DataFrame({"step": seen, "n": totals[seen]})

    counted = (
        df.select(F.col(text).cast("string").alias("_text"))
        .mapInPandas(count, "step long, n long")
        .groupBy("step")
        .agg(F.sum("n").alias("n"))
        .collect()
    )
    counts = np.zeros(2 * STATES * STATES)
    for r in counted:
        counts[r["step"]] = r["n"]
    ordinary, randomly = counts.reshape(2, STATES, STATES)[:, :, :BREAK]

    def model(seen: np.ndarray, even: float) -> np.ndarray:
        total = seen.sum(axis=1, keepdims=True)
        share = np.divide(seen, total, out=np.full_like(seen, 1 / BREAK), where=total > 0)
        return (1 - even) * share + even / BREAK

    log = np.log(model(randomly, RANDOM_EVEN)) - np.log(model(ordinary, ORDINARY_EVEN))
    ratio = np.zeros((STATES, STATES))
    ratio[:, :BREAK] = log
    return ratio.ravel()


def find_spans(texts: list[str], ratio: np.ndarray, table: np.ndarray) -> list[list[tuple[int, int, int]]]:
    """(start, kind, end) of all secrets of every text, in order; runs that touch a base span add nothing."""
    spans = [base_spans(t) for t in texts]
    runs = Runs(texts, table, LEAST_LENGTH)
    if len(runs.starts):
        scores = np.add.reduceat(ratio[runs.steps], runs.first)
        for i in np.flatnonzero((scores >= LEAST_RATIO) & ~runs.overlaps(spans)):
            begin = runs.begins[runs.owner[i]]
            spans[runs.owner[i]].append((int(runs.starts[i] - begin), 3, int(runs.ends[i] - begin)))
    return [sorted(s) for s in spans]


def scan(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with ``secrets``: an array of (kind, start, end) of all secrets in the text, by start and kind.

    Kinds are ``assign``, ``access``, ``hex`` (fixed patterns) and ``markov``: identifiers of 16 characters
    and more that touch no pattern and are at least a million times likelier under the model of random
    strings than under that of ordinary identifiers. Both models are trained on all texts of ``df``.
    Positions count code points, the end is exclusive. Whole texts are scanned.

    A null text counts as empty and has no secrets. Repeated rows and null ids are rows like others. An empty
    input gives an empty result. A column of ``df`` named ``secrets`` is replaced.
    """
    return _with_spans(df, text, "secrets")


def _with_spans(df: DataFrame, text: str, name: str) -> DataFrame:
    ratio = train(df, text)

    @F.pandas_udf("array<struct<kind: string, start: int, end: int>>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        table = _symbol_table()
        for batch in batches:
            out = []
            for texts in in_batches([t or "" for t in batch]):
                for spans in find_spans(texts, ratio, table):
                    out.append([{"kind": KINDS[k], "start": a, "end": b} for a, k, b in spans])
            yield pd.Series(out, dtype=object)

    return df.withColumn(name, run(F.col(text).cast("string")))


def redact(df: DataFrame, text: str = "text", marker: str = "[secret]") -> DataFrame:
    """``df`` with every secret of the text replaced by ``marker``; overlapping secrets get one.

    Rows without secrets, null texts among them, are not changed. No row goes, and no other column changes.
    """
    name = "_spans"
    while name in df.columns:
        name += "_"

    @F.pandas_udf("string")
    def cut(texts: pd.Series, secrets: pd.Series) -> pd.Series:
        out = []
        for body, spans in zip(texts, secrets):
            if body is None or len(spans) == 0:
                out.append(body)
                continue
            parts, at = [], 0
            for s in spans:
                if s["start"] >= at:
                    parts += [body[at : s["start"]], marker]
                at = max(at, s["end"])
            out.append("".join([*parts, body[at:]]))
        return pd.Series(out, dtype=object)

    return _with_spans(df, text, name).withColumn(text, cut(F.col(text), F.col(name))).drop(name)
