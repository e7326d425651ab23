"""Two public tokenizers as token ids whose bytes add up to the text."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import sentencepiece
import tiktoken

FOLDER = "/opt/tokenizers"
BYTE_BPE, PIECE_BPE = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Fixed value: how the byte-level vocabulary splits text before merging.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@dataclass(frozen=True)
class Vocabularies:
    """The contents of both files: of the size of the vocabularies, whatever is encoded."""

    byte_bpe: bytes
    piece_bpe: bytes


def read_vocabularies(folder: str = FOLDER) -> Vocabularies:
    with open(f"{folder}/{BYTE_BPE}", "rb") as a, open(f"{folder}/{PIECE_BPE}", "rb") as b:
        return Vocabularies(a.read(), b.read())


def byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable bytes themselves, others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Coder:
    """Encodes with both tokenizers; ``a_bytes`` and ``b_bytes`` are the bytes of each token."""

    def __init__(self, given: Vocabularies) -> None:
        letters = byte_letters()
        vocabulary = json.loads(given.byte_bpe)["model"]["vocab"]
        ranks = {bytes(letters[c] for c in token): i for token, i in vocabulary.items()}
        # Ids rise in the order of the merges, so they serve as ranks; special tokens are ordinary text.
        self._a = tiktoken.Encoding("byte_bpe", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        self._b = sentencepiece.SentencePieceProcessor(model_proto=given.piece_bpe)
        self.a_bytes = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self.a_bytes[i] = token
        self.b_bytes = [self._piece(i) for i in range(self._b.get_piece_size())]
        self.a_sizes = np.array([len(t) for t in self.a_bytes], np.int64)
        self.b_sizes = np.array([len(t) for t in self.b_bytes], np.int64)

    def _piece(self, i: int) -> bytes:
        piece = self._b.id_to_piece(i)
        return bytes([int(piece[1:-1], 16)]) if self._b.is_byte(i) else piece.replace("▁", " ").encode()

    def encode(self, texts: Sequence[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids of both; none for a text that is null, empty, or not what both token sequences spell."""
        given = [text or "" for text in texts]
        out = []
        for text, b in zip(given, self._b.encode(given, num_threads=1)):
            a = self._a.encode_ordinary(" " + text) if text else []
            whole = b" " + text.encode()
            if not text or b"".join(map(self.a_bytes.__getitem__, a)) != whole or b"".join(map(self.b_bytes.__getitem__, b)) != whole:
                a, b = [], []
            out.append((np.array(a, np.uint16), np.array(b, np.uint16)))
        return out


@lru_cache(maxsize=2)
def coder(given: Vocabularies) -> Coder:
    return Coder(given)
