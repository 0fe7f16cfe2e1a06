"""Repeatable random numbers: the 32-bit generator known as mulberry32."""

from __future__ import annotations

from collections.abc import Iterator

_WORD = 0xFFFFFFFF


def mulberry32(seed: int) -> Iterator[float]:
    """Numbers in [0, 1), the same for a seed everywhere."""
    state = seed & _WORD
    while True:
        state = state + 0x6D2B79F5 & _WORD
        x = (state ^ state >> 15) * (state | 1) & _WORD
        x ^= x + ((x ^ x >> 7) * (x | 61) & _WORD) & _WORD
        yield (x ^ x >> 14) / 2**32


def places(n: int, of: int, seed: int) -> list[int]:
    """``n`` different places out of ``of``, in the order drawn."""
    drawn: dict[int, None] = {}
    for u in mulberry32(seed):
        if len(drawn) >= min(n, of):
            break
        drawn[int(u * of)] = None
    return list(drawn)
