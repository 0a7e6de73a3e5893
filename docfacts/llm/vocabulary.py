"""Pieces of a fixed public vocabulary, looked up by hash over arrays of code points."""

from __future__ import annotations

import numpy as np

from docfacts.llm.wordhash import mix

#: Where the vocabulary is, unless a path is given.
DEFAULT = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
_BASE = np.uint64(0x9E3779B97F4A7C15)


def load(path: str = DEFAULT) -> list[tuple[int, str, float]]:
    """(id, piece, score) of the ordinary pieces of a SentencePiece model: no control, unknown, unused or byte pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [
        (i, model.id_to_piece(i), model.get_score(i))
        for i in range(model.get_piece_size())
        if not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or model.is_byte(i))
    ]


def byte_ids(path: str = DEFAULT) -> list[int]:
    """The id of each of the 256 byte pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]


class PieceTable:
    """Open-addressed table from piece hash to the piece's place in a list."""

    def __init__(self, pieces: list[str]):
        self.longest = max(map(len, pieces))
        self.size = 1 << (4 * len(pieces)).bit_length()
        self.keys = np.zeros(self.size, np.uint64)
        self.values = np.full(self.size, -1, np.int32)
        self.probes = 1
        for place, piece in enumerate(pieces):
            key = int(self.hash_all(np.frombuffer(piece.encode("utf-32-le"), np.uint32)[None, :], len(piece))[0])
            at, probe = key % self.size, 1
            while self.values[at] >= 0:
                at, probe = (at + 1) % self.size, probe + 1
            self.keys[at], self.values[at] = key, place
            self.probes = max(self.probes, probe)

    @staticmethod
    def hash_all(points: np.ndarray, n: int) -> np.ndarray:
        """Hash of each row's first n code points."""
        h = np.full(len(points), np.uint64(n), np.uint64)
        for j in range(n):
            h = h * _BASE + points[:, j]
        return mix(h)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Places of hashed strings, -1 where there is no such piece."""
        at = (keys & np.uint64(self.size - 1)).astype(np.int64)
        out = np.where(self.keys[at] == keys, self.values[at], -1)
        for step in range(1, self.probes):
            left = np.flatnonzero(out < 0)
            if not len(left):
                break
            a = (at[left] + step) & (self.size - 1)
            out[left] = np.where((self.keys[a] == keys[left]) & (self.values[a] >= 0), self.values[a], -1)
        return out

    def substrings(self, points: np.ndarray) -> dict[tuple[int, int], np.ndarray]:
        """(start, end) to the place of that substring in each row (same length), for all starts and bounded lengths."""
        n = points.shape[1]
        found = {}
        for size in range(1, min(n, self.longest) + 1):
            for start in range(n - size + 1):
                found[start, start + size] = self.find(self.hash_all(points[:, start : start + size], size))
        return found

    def spans(self, points: np.ndarray, lens: np.ndarray, lo: int, hi: int) -> np.ndarray:
        """(size - 1, row, start - lo): the place of the piece of that size at each start from ``lo`` up to ``hi``, -1 where there is none; rows have ``lens`` code points."""
        out = np.full((self.longest, len(points), hi - lo), -1, np.int32)
        h, power, wrap = np.zeros((len(points), hi - lo), np.uint64), 1, (1 << 64) - 1
        for size in range(1, self.longest + 1):
            m = min(hi, points.shape[1] - size + 1) - lo
            if m <= 0:
                break
            h = h[:, :m] * _BASE + points[:, lo + size - 1 : lo + size - 1 + m]
            power = power * int(_BASE) & wrap
            found = self.find(mix((h + np.uint64(size * power & wrap)).ravel())).reshape(h.shape)
            out[size - 1, :, :m] = np.where(np.arange(lo, lo + m) + size <= lens[:, None], found, -1)
        return out
