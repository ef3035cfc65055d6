"""SplitMix64: a stream of 64-bit numbers that depends on nothing but its seed."""

from __future__ import annotations

_MASK = (1 << 64) - 1
GAMMA, FIRST, SECOND = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB  # fixed values


class SplitMix:
    def __init__(self, seed: int):
        self.state = seed & _MASK

    def next(self) -> int:
        self.state = self.state + GAMMA & _MASK
        z = (self.state ^ self.state >> 30) * FIRST & _MASK
        z = (z ^ z >> 27) * SECOND & _MASK
        return z ^ z >> 31

    def below(self, bound: int) -> int:
        """A number below ``bound``; 0 for a bound of 0."""
        return self.next() % bound if bound else 0
