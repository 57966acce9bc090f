"""Pre-tokenisation, byte-level BPE and packing against the public libraries."""

import base64
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken
from tokenizers import Tokenizer

from daygrain.llm import byte_bpe, packing, pretokenize
from tests.llm.data import LONG, ROWS

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
JSON = public_tokenizers.path("byte_bpe_50k.json")
PARTS = ["'", "s", "t", "re", "ve", "ll", "d", "m", " ", " ", "\n", "\t", "1", "!", "é", "x", "　", "²", "Ⅷ", "'S", "漢", "🙂"]
PARTS += ["r", "e", "l", "v", "\x1c", "\x85", "_", " ", "<|endoftext|>"]


@pytest.fixture(scope="module")
def library():
    with open(RANKS, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def random_texts(n, seed=3):
    rng = random.Random(seed)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randrange(40))) for _ in range(n)]


def test_split_matches_the_pattern():
    pattern = regex.compile(public_tokenizers.PATTERN)
    texts = random_texts(4000)
    assert pretokenize.split_tokens(texts) == [pattern.findall(t) for t in texts]
    assert pretokenize.split_tokens([]) == [] and pretokenize.split_tokens(["", ""]) == [[], []]


def test_states_carry_over_blocks(monkeypatch):
    pattern = regex.compile(public_tokenizers.PATTERN)
    texts = random_texts(300, seed=4)
    for block in (1, 2, 7):
        monkeypatch.setattr(pretokenize, "BLOCK", block)
        assert pretokenize.split_tokens(texts) == [pattern.findall(t) for t in texts]


def test_composition_is_associative():
    compose = pretokenize.automaton()[0]
    n = range(len(compose))
    assert all(compose[compose[a, b], c] == compose[a, compose[b, c]] for a in n for b in n for c in n)


def test_pieces_are_split_alike():
    pattern = regex.compile(public_tokenizers.PATTERN)
    for text in [*random_texts(200, seed=5), LONG[:5000], " " * 500, "a" * 500]:
        cut = pretokenize.pieces(text, 20)
        assert "".join(cut) == text
        assert [w for p in cut for w in pattern.findall(p)] == pattern.findall(text)


def test_ids_match_the_library(library):
    bpe = byte_bpe.coder(RANKS)
    texts = [*random_texts(1500), LONG, "a" * 3000, " " * 700, "ab" * 900 + "é" * 99, "!" * 333]
    for text, coded in zip(texts, byte_bpe.encode_texts(bpe, texts)):
        ids = np.frombuffer(coded, "<u4")
        assert ids.tolist() == library.encode_ordinary(text)
        decoded, offsets = bpe.decode(ids)
        assert decoded == text.encode()
        assert [decoded[a:b] for a, b in zip(offsets, [*offsets[1:], len(decoded)])] == [
            library.decode_single_token_bytes(i) for i in ids.tolist()
        ]


def test_a_full_cache_changes_nothing(library):
    bpe = byte_bpe.ByteBpe(RANKS)
    bpe.cache.most = 3
    texts = random_texts(50)
    assert [np.frombuffer(x, "<u4").tolist() for x in bpe.encode_batch(texts)] == [library.encode_ordinary(t) for t in texts]


def test_encode_and_decode_frames(docs, no_docs, library):
    coded = byte_bpe.decode(byte_bpe.encode(docs, RANKS), RANKS).select("text", "ids", "offsets", "decoded", "first")
    rows = coded.collect()
    assert len(rows) == len(ROWS)
    for r in rows:
        assert r.ids == library.encode_ordinary(r.text or "")
        assert bytes(r.decoded) == (r.text or "").encode()
        assert len(r.offsets) == len(r.ids)
    assert byte_bpe.encode(no_docs, RANKS).count() == 0 and byte_bpe.digests(no_docs, RANKS).count() == 0


# --- packing -----------------------------------------------------------------------------------------


def test_words_give_the_ids_of_the_library():
    bpe, library = packing.coder(JSON), Tokenizer.from_file(JSON)
    texts = [*random_texts(1500, seed=8), LONG, " " * 300, "<|endoftext|>"]
    expected = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(x, "<u4").tolist() for x in byte_bpe.encode_texts(bpe, texts)] == expected


def check_packing(rows, documents, capacity):
    """Every document is there once, cut as told, and sequences hold their pieces without gaps."""
    library = Tokenizer.from_file(JSON)
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
    expected = {}
    for doc_id, text in documents:
        ids = library.encode(text or "", add_special_tokens=False).ids + [0]
        first = len(ids) % capacity or capacity
        starts = [0, *range(first, len(ids), capacity)]
        for k, a in enumerate(starts):
            part = ids[a : starts[k + 1] if k + 1 < len(starts) else len(ids)]
            crc = zlib.crc32(np.array(part, "<u4").tobytes())
            expected.setdefault(doc_id, []).append((k, a, len(part), crc))
    assert {d: sorted((r.piece, r.start, r.length, r.ids_crc32) for r in x) for d, x in by_doc.items()} == {
        d: sorted(x) for d, x in expected.items()
    }
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for x in sequences.values():
        at = 0
        for offset, length in sorted(x):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences)


@pytest.mark.parametrize("capacity", [16, 2048])
def test_packing_awkward_rows(docs, no_docs, capacity):
    rows = packing.pack_documents(docs, JSON, capacity=capacity).collect()
    check_packing(rows, [(r[0], r[1]) for r in ROWS], capacity)
    assert packing.pack_documents(no_docs, JSON).count() == 0


def test_packing_a_table_is_tight(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    # in several blocks, as on large inputs
    rows = packing.pack_documents(docs, JSON, block=40).collect()
    used = check_packing(rows, [(r.doc_id, r.text) for r in docs.collect()], 2048)
    assert used <= -(-sum(r.length for r in rows) // 2048) * 1.06 + 1


def test_crossing_keeps_every_document():
    rng = random.Random(1)
    lengths = [rng.randrange(1, 100) for _ in range(400)]
    a = packing.best_fit([], lengths, 100)
    b = packing.best_fit([], sorted(lengths, reverse=True), 100)
    for _ in range(20):
        child = packing.cross(a, b, 100, rng)
        assert sorted(x for bin in child for x in bin) == sorted(lengths)
        assert max(map(sum, child)) <= 100
        a, b = b, child
    best = packing.evolve(lengths, [], 100, 30, 5, rng)[0]
    assert len(best) <= len(packing.best_fit([], sorted(lengths, reverse=True), 100))


def test_search_beats_best_fit():
    """Lengths that best fit packs badly: crossing finds fewer sequences."""
    rng = random.Random(2)
    lengths = sorted((rng.randrange(500, 901) for _ in range(4096)), reverse=True)
    first = packing.best_fit([], lengths, 2048)
    found = packing.evolve(lengths, [], 2048, packing.CHILDREN, packing.POPULATION, random.Random(3))
    again = packing.evolve(lengths, found, 2048, packing.CHILDREN, packing.POPULATION, random.Random(4))
    assert len(again[0]) <= len(found[0]) < len(first)
    assert sorted(x for b in again[0] for x in b) == sorted(lengths)


def test_no_search_where_best_fit_meets_the_bound():
    assert len(packing.evolve([1024] * 40, [], 2048, 10, 5, random.Random(1))) == 1


def test_islands_are_spread_over_tasks(spark):
    rng = random.Random(5)
    items = spark.createDataFrame([(i, rng.randrange(500, 901)) for i in range(600)], "_row long, length long")
    seen = []
    real = packing.stored

    def noted(df):
        out = real(df)
        if "population" in df.columns:
            seen.append(out.rdd.getNumPartitions())
        return out

    packing.stored = noted
    try:
        placed = packing.pack_items(items, 2048, 100).collect()
    finally:
        packing.stored = real
    assert len(placed) == 600 and seen and min(seen) > 1
