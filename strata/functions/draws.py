"""Seeded draws that give the same numbers everywhere."""

from __future__ import annotations


class Mulberry32:
    """The generator mulberry32: numbers from 0 to below 1."""

    # The step 0x6D2B79F5, the masks 1 and 61, and the shifts 15, 7 and 14 of the generator as published.
    def __init__(self, seed: int):
        self.state = seed & 0xFFFFFFFF

    def __call__(self) -> float:
        self.state = (self.state + 0x6D2B79F5) & 0xFFFFFFFF
        t = self.state
        t = ((t ^ t >> 15) * (t | 1)) & 0xFFFFFFFF
        t ^= (t + (t ^ t >> 7) * (t | 61)) & 0xFFFFFFFF
        return (t ^ t >> 14) / 4294967296


def sample_places(n: int, k: int, seed: int) -> list[int]:
    """min(n, k) places of 0 to n - 1 in order, by the first k steps of a seeded shuffle.

    Only places that were swapped are remembered, so it takes k steps for any n.
    """
    if n <= k:
        return list(range(n))
    draw, moved, out = Mulberry32(seed), {}, []
    for at in range(k):
        other = at + int(draw() * (n - at))
        out.append(moved.get(other, other))
        moved[other] = moved.get(at, at)
    return sorted(out)
