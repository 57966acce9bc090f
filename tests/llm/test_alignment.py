"""Token links against the public libraries and a version that counts by hand."""

import bisect
import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from daygrain.llm import alignment, json_bpe, queries
from tests.llm.data import LONG, ROWS
from tests.llm.test_tokens import random_texts

A = public_tokenizers.path("byte_bpe_50k.json")
B = public_tokenizers.path("piece_bpe_32k.model")
ODD = [" ", "  ", "a ", "a  ", " a", "\n a", "a\n  b", "a▁b", "▁", "<s> x </s>", "<0x41>", "\x00 \x1c a", "é" * 300, "ab" * 900]
ODD += ["a" * 5000, "x" + " " * 400 + "y", "漢字 かな", "🙂 🙂🙂", "　x   y", "﻿ a", "ñ̃ é", "\r\n\r\n z", "don't we'll 's"]


class ByHand:
    """The definitions, text by text, on whole texts."""

    def __init__(self):
        self.a = Tokenizer.from_file(A)
        self.a.encode_special_tokens = True
        back = {ord(letter): b for b, letter in json_bpe.byte_letters().items()}
        self.bytes_a = {i: t.translate(back).encode("latin-1") for t, i in self.a.get_vocab(with_added_tokens=False).items()}
        self.b = sentencepiece.SentencePieceProcessor(model_file=B)

    def byte_b(self, i):
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[1:-1], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()

    def groups(self, text):
        if not text:
            return None
        ids_a, ids_b = self.a.encode(f" {text}", add_special_tokens=False).ids, self.b.encode(text)
        if b"".join(self.bytes_a[i] for i in ids_a) != f" {text}".encode():
            return None
        if b"".join(map(self.byte_b, ids_b)) != f" {text}".encode():
            return None
        ends = []
        for ids, of in ((ids_a, self.bytes_a.__getitem__), (ids_b, self.byte_b)):
            at, own = 0, []
            for i in ids:
                at += len(of(i))
                own.append(at)
            ends.append(own)
        common = sorted(set(ends[0]) & set(ends[1]))
        out = [([], []) for _ in common]
        for side, (ids, own) in enumerate(zip((ids_a, ids_b), ends)):
            for i, end in zip(ids, own):
                out[bisect.bisect_left(common, end)][side].append(i)
        return out


def expected(texts):
    hand = ByHand()
    aligned = [hand.groups(t) for t in texts]
    links = [Counter((a, b) for ga, gb in groups or [] for a in ga for b in gb) for groups in aligned]
    count = Counter(pair for own in links for pair in own)
    best = {}
    for (a, _), n in count.items():
        best[a] = max(best.get(a, 0), n)
    out = []
    for groups, own in zip(aligned, links):
        shown = ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in groups or [])
        out.append(
            (
                sum(len(a) for a, _ in groups or []),
                sum(len(b) for _, b in groups or []),
                len(groups or []),
                sum(own.values()),
                sum(n for (a, b), n in own.items() if count[a, b] == best[a]),
                sum(n * count[pair] for pair, n in own.items()),
                hashlib.sha256(shown.encode()).hexdigest() if groups else "",
            )
        )
    return out


COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def test_cuts_join_to_the_text():
    for text in [*random_texts(500, seed=21), *ODD, LONG]:
        assert " ".join(json_bpe.cut(text)) == text


def test_segments_give_the_ids_of_the_library():
    library = Tokenizer.from_file(A)
    for plain in (False, True):
        library.encode_special_tokens = plain
        coder = json_bpe.JsonBpe(A, most=50, plain=plain)
        texts = [*random_texts(1500, seed=22), *ODD, "x <|endoftext|>  y<|endoftext|>"]
        ids = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
        assert [np.frombuffer(x, "<u4").tolist() for x in coder.encode_batch(texts)] == ids


@pytest.mark.parametrize("singles,together,most", [(4096, 1000, 400), (2, 3, 4)])
def test_alignment_of_texts(monkeypatch, singles, together, most):
    monkeypatch.setattr(alignment, "SINGLE_LINKS", singles)
    monkeypatch.setattr(alignment, "TOGETHER", together)
    texts = [*random_texts(400, seed=23), *ODD, *random_texts(20, seed=23), LONG[:20000], None, ""]
    hand, aligner = ByHand(), alignment.Aligner(A, B, most)
    for text, (n_a, n_b, n_groups, n_links, digest, keys, numbers) in zip(texts, aligner.texts(texts), strict=True):
        groups = hand.groups(text) or []
        links = Counter(a << 32 | b for ga, gb in groups for a in ga for b in gb)
        assert dict(zip(keys.tolist(), numbers.tolist())) == links and keys.tolist() == sorted(links)
        assert (n_a, n_b) == (sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups))
        assert (n_groups, n_links) == (len(groups), sum(links.values()))
        shown = ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in groups)
        assert digest == (hashlib.sha256(shown.encode()).hexdigest() if groups else "")


@pytest.mark.parametrize("broadcast_pairs", [1 << 21, 0])
def test_links_of_awkward_rows(spark, docs, no_docs, broadcast_pairs):
    got = alignment.token_links(docs, A, B, carry=("source",), broadcast_pairs=broadcast_pairs).collect()
    want = sorted((str((r[0], r[3])), *x) for r, x in zip(ROWS, expected([r[1] for r in ROWS])))
    assert sorted((str((r.doc_id, r.source)), *[r[c] for c in COLUMNS]) for r in got) == want
    assert alignment.token_links(no_docs, A, B).count() == 0


def test_the_query_by_hand(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    want = dict(zip(texts, expected(list(texts.values()))))
    got = queries.op13_cross_tokenizer(spark, sf).collect()
    assert {r.doc_id: tuple(r[c] for c in COLUMNS) for r in got} == want and len(got) == len(want)
