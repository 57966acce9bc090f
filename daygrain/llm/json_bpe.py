"""Byte-level BPE by a tokenizer file: its merges as ranks, and cuts at which texts can be encoded one by one."""

from __future__ import annotations

import functools
import json
import os
import re
from itertools import groupby

import numpy as np

from daygrain.llm.byte_bpe import CACHED_WORDS, WordCache, packed
from daygrain.llm.pretokenize import split_tokens

# characters that no segment ends before a space with; more may be listed than the split pattern calls white space
WHITE = "".join(c for c in map(chr, range(0x3001)) if c.isspace())
PAIRS = tuple(f"{c} " for c in WHITE)
CUT = re.compile(r"(?<=\S) (?=.)", re.DOTALL)
#: Characters of a word or of white space; longer runs are left to the automaton.
LONG_RUN = 200
WHITE_RUN = re.compile(rf"\s{{{LONG_RUN + 1}}}")


def cut(text: str) -> list[str]:
    """The text cut at spaces, so that joining the parts by single spaces gives it back.

    A cut is made only before a space that follows a visible character and is not the last character. A token of
    the split pattern starts there whatever comes before, so the parts, each with its space, encode one by one.
    """
    if text[:1] == " " or text[-1:] == " " or any(p in text for p in PAIRS):
        return CUT.split(text)
    return text.split(" ")


@functools.cache
def byte_letters() -> dict[int, str]:
    """The letter by which byte-level vocabularies write each byte: itself if it is visible, else one from 256 on."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in visible]
    return {b: chr(b) for b in visible} | {b: chr(256 + i) for i, b in enumerate(hidden)}


def even(text: str) -> bool:
    """Whether a text has no very long word and no very long white space, on which regular expressions may give up."""
    return max(map(len, text.split()), default=0) <= LONG_RUN and WHITE_RUN.search(text) is None


class JsonBpe:
    """Ids by a byte-level tokenizer file; strings of special tokens give their ids unless they are ``plain``."""

    def __init__(self, path: str, most: int = CACHED_WORDS, plain: bool = False):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        self.model = tokenizer.model
        added = {t.content: i for i, t in tokenizer.get_added_tokens_decoder().items()}
        self.special = {} if plain else added
        self.splitter = re.compile("|".join(f"({re.escape(s)})" for s in added)) if self.special else None
        self.letters = byte_letters()
        back = {ord(letter): b for b, letter in self.letters.items()}
        with open(path, encoding="utf-8") as file:
            content = json.load(file)["model"]
        self.entries = {
            i: token.translate(back).encode("latin-1") for token, i in content["vocab"].items() if token not in added
        }
        pairs = (m.split(" ") if isinstance(m, str) else m for m in content["merges"])
        if [content["vocab"][a + b] for a, b in pairs] != list(range(256, len(self.entries))):
            raise ValueError("the ids of the vocabulary do not follow the order of its merges")
        self.ranks = tiktoken.Encoding(
            "file",
            pat_str=public_tokenizers.PATTERN,
            mergeable_ranks={token: i for i, token in self.entries.items()},
            special_tokens={},
        )
        self.cache = WordCache(self._ids, most)

    def _ids(self, word: str) -> list[int]:
        return [t.id for t in self.model.tokenize(word.encode().decode("latin-1").translate(self.letters))]

    def segment(self, text: str) -> list[int]:
        """Ids of a text without special tokens.

        Segments with a very long run are split into words by the automaton; all between them is encoded at once.
        """
        if even(text):
            return self.ranks.encode_ordinary(text)
        first, *rest = cut(text)
        out = []
        for regular, own in groupby([first, *(f" {part}" for part in rest)], even):
            if regular:
                out += self.ranks.encode_ordinary("".join(own))
            else:
                coded = b"".join(self.cache[word] for words in split_tokens(list(own)) for word in words)
                out += np.frombuffer(coded, "<u4").tolist()
        return out

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit integers."""
        out = []
        for text in texts:
            special = self.splitter is not None and any(s in text for s in self.special)
            parts = [p for p in self.splitter.split(text) if p] if special else [text]
            out.append(b"".join(packed([self.special[p]] if p in self.special else self.segment(p)) for p in parts))
        return out
