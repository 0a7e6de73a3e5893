"""Plain versions of stages, over a few hundred documents."""

from test_minhash import brute as brute_near
from test_substrings import brute

__all__ = ["brute_near", "brute_passages"]


def brute_passages(rows, window):
    found = brute([t for _, t in rows], window)
    return {i: (kept if removed else t) for (i, t), (_, removed, kept) in zip(rows, found, strict=True)}
