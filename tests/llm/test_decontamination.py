"""Benchmark passages against a search by hand."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from daygrain.llm import decontamination
from tests.llm.data import LONG, PASSAGE, ROWS

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_by_hand(text):
    return WORD.findall((text or "").translate(UPPER))


def by_hand(texts, items, window):
    """Per text: words, hit words, items, longest match with its place."""
    windows = {}
    for item, text in items:
        words = words_by_hand(text)
        size = min(window, len(words))
        for at in range(len(words) - size + 1 if words else 0):
            windows.setdefault(tuple(words[at : at + size]), []).append((item, words[at:]))
    out = []
    for text in texts:
        words, hit, found, best = words_by_hand(text), set(), set(), (0, 0)
        for size in {len(w) for w in windows}:
            for at in range(len(words) - size + 1):
                for item, own in windows.get(tuple(words[at : at + size]), ()):
                    hit |= set(range(at, at + size))
                    found |= {str(item)} if item is not None else set()
                    n = size
                    while n < len(own) and at + n < len(words) and own[n] == words[at + n]:
                        n += 1
                    best = max(best, (n, -at))
        out.append((len(words), hit, sorted(found), best[0] or None, -best[1] if best[0] else None))
    return out


def random_case(seed, n=60):
    rng = random.Random(seed)
    vocabulary = ["a", "b", "c", "dé", "漢", "X1", "_", "of-it", "The"]
    items = [(rng.randrange(20), " ".join(rng.choices(vocabulary, k=rng.randrange(0, 12)))) for _ in range(25)]
    items += [(None, "b b b c c c a a"), (3, None), (4, " \n--"), (5, "b b b c c c a a"), (5, "zebra")]
    texts = [" ".join(rng.choices(vocabulary, k=rng.randrange(0, 60))) for _ in range(n)]
    return texts + [None, "", "ZEBRA", "b B b C c c A a, zebra" * 3], items


@pytest.mark.parametrize("window,shard,chunk", [(4, 1 << 21, 1 << 20), (4, 7, 5), (1, 50, 3), (10, 1 << 21, 1 << 20), (6, 3, 1)])
def test_search_by_hand(monkeypatch, window, shard, chunk):
    monkeypatch.setattr(decontamination, "SHARD_WORDS", shard)
    monkeypatch.setattr(decontamination, "CHUNK", chunk)
    texts, items = random_case(window)
    pieces = [(None if i is None else str(i), words) for i, t in items if (words := [w.encode() for w in words_by_hand(t)])]
    suffixes = decontamination.Suffixes(pieces, window)
    got = decontamination.search(suffixes, texts)
    hits = [{w for a, b in zip(s, e) for w in range(a, b)} for _, s, e, *_ in got]
    assert [(n, h, *rest) for (n, _, _, *rest), h in zip(got, hits)] == by_hand(texts, items, window)


def test_suffix_arrays_are_sorted():
    rng = np.random.default_rng(1)
    for n in (1, 2, 50, 400):
        words = np.append(rng.integers(0, 3, n), 0)
        order = decontamination.suffix_array(words, n + 1)
        assert order.tolist() == sorted(range(n + 1), key=lambda i: words[i:].tolist())


def check(spark, texts, items, window, block_words):
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(texts)], "doc_id long, text string, items int, piece string")
    bench = spark.createDataFrame([(i, t, 5) for i, t in items], "item_id long, text string, item int")
    found = decontamination.contamination(docs, bench, carry=("piece",), window=window, block_words=block_words)
    assert found.columns == ["doc_id", "piece", "n_words", "starts", "ends", "items", "longest", "longest_at"]
    rows = sorted(found.collect())
    want = by_hand(texts, items, window)
    got = [(r.n_words, {w for a, b in zip(r.starts, r.ends) for w in range(a, b)}, r["items"], r.longest, r.longest_at) for r in rows]
    assert got == want
    assert all(b < a for r in rows for b, a in zip(r.ends, r.starts[1:]))
    left = decontamination.remove_contaminated(docs, bench, window=window, block_words=block_words)
    assert left.columns == docs.columns
    assert {r.doc_id for r in left.collect()} == {i for i, x in enumerate(want) if not x[1]}


@pytest.mark.parametrize("block_words", [1 << 20, 40])
def test_frames_by_hand(spark, block_words):
    texts, items = random_case(9)
    check(spark, texts + texts[:9], items, 4, block_words)


def test_long_items_are_cut(spark, monkeypatch):
    monkeypatch.setattr(decontamination, "PIECE_WORDS", 16)
    words = [f"w{i % 37}x{i % 11}" for i in range(100)]
    docs = spark.createDataFrame([(a, " ".join(words[a : a + 30])) for a in range(0, 100, 7)] + [(200, "w1x1 w2x2")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")
    rows = decontamination.contamination(docs, bench).collect()
    assert all(r["items"] == (["1"] if r.doc_id < 100 and r.n_words >= 10 else []) for r in rows)
    assert all(sum(r.ends) - sum(r.starts) == r.n_words for r in rows if r["items"])


def test_awkward_rows(spark, docs, no_docs):
    items = [(1, PASSAGE), (2, LONG[:500]), (3, "été 漢字"), (4, None), (None, "Hello, world"), (6, "same " * 5)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = decontamination.contamination(docs, bench, carry=("source",)).collect()
    want = by_hand([r[1] for r in ROWS], items, 10)
    want = sorted(str((r[0], r[3], x[0], len(x[1]), *x[2:])) for r, x in zip(ROWS, want))
    got = [(r.doc_id, r.source, r.n_words, sum(r.ends) - sum(r.starts), r["items"], r.longest, r.longest_at) for r in rows]
    assert sorted(map(str, got)) == want
    assert decontamination.contamination(no_docs, bench).count() == 0
    clean = decontamination.contamination(docs, bench.limit(0))
    assert clean.where(F.size("items") > 0).count() == 0 and clean.count() == len(ROWS)
    assert decontamination.remove_contaminated(docs, bench.limit(0)).count() == len(ROWS)
