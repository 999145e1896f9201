"""Byte-level BPE vocabularies and piece vocabularies as tables: ids of texts, and the bytes of each id.

A byte-level file is read once per worker. Its merges, in rank order, are the ids from 256 on, so its vocabulary is a table of
ranks, which tiktoken encodes some five times as fast as the library the file was made for; the ids are the same. Where tiktoken's
pattern gives up (runs of millions of white spaces), that text is encoded by the other library.
"""

from __future__ import annotations

import json
import os

import numpy as np
import sentencepiece
import tiktoken
import tokenizers

from .op4_bpe import alphabet

#: How files of this kind cut texts before the merges: a fixed value of the format.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class ByteVocabulary:
    """A byte-level BPE file: no normaliser, no prefix space, merges in the order of ids. Else: ValueError."""

    def __init__(self, path: str, special: bool):
        """special: whether the strings of special tokens in a text become those tokens (else they are plain text)."""
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, cut = spec["model"], spec["pre_tokenizer"]
        vocab, merges = model["vocab"], [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        fits = model["type"] == "BPE" and not model.get("end_of_word_suffix") and not spec["normalizer"] and cut["type"] == "ByteLevel" and cut["use_regex"] and not cut["add_prefix_space"]
        if not fits or any(vocab[a + b] != 256 + k for k, (a, b) in enumerate(merges)):
            raise ValueError(f"{path} isn't a byte-level BPE file with its merges in the order of ids")
        byte = {c: b for b, c in enumerate(alphabet())}
        extra = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(byte[c] for c in t): i for t, i in vocab.items() if t not in extra}
        self.special = extra if special else {}
        self.coder = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=self.special)
        self.path, self.plain, self.allowed = path, None, set(self.special)
        self.size = max([*vocab.values(), *extra.values()]) + 1
        self.pieces = [b""] * self.size
        for t, i in [*ranks.items(), *((t.encode(), i) for t, i in extra.items())]:
            self.pieces[i] = t
        self.lengths = np.array([len(p) for p in self.pieces], np.int64)

    def encode(self, text: str) -> np.ndarray:
        try:
            return self.coder.encode_to_numpy(text, allowed_special=self.allowed, disallowed_special=())
        except ValueError:  # the pattern has run out of its stack
            if self.plain is None:
                os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
                self.plain = tokenizers.Tokenizer.from_file(self.path)
                self.plain.no_truncation()
                self.plain.no_padding()
                self.plain.encode_special_tokens = not self.special
            return np.array(self.plain.encode(text, add_special_tokens=False).ids, np.uint32)


class PieceVocabulary:
    """A sentencepiece file; U+2581 in a piece stands for a space, a byte piece for its byte."""

    def __init__(self, path: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = self.model.get_piece_size()
        self.pieces = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i in range(self.size) for p in [self.model.id_to_piece(i)]]
        self.lengths = np.array([len(p) for p in self.pieces], np.int64)

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


_held: dict[tuple, object] = {}


def byte_vocabulary(path: str, special: bool) -> ByteVocabulary:
    """One per file and worker process."""
    if (path, special) not in _held:
        _held[path, special] = ByteVocabulary(path, special)
    return _held[path, special]


def piece_vocabulary(path: str) -> PieceVocabulary:
    if (path,) not in _held:
        _held[(path,)] = PieceVocabulary(path)
    return _held[(path,)]
