"""Rounds of partition pairs: in a round no two pairs share a partition, and over all rounds every pair meets once."""

from __future__ import annotations


def pair_rounds(partitions: int) -> list[list[list[int]]]:
    """A round-robin tournament by the circle method; with an odd number one partition sits out each round."""
    if partitions < 2:
        return [[[0]]] if partitions else []
    n = partitions + partitions % 2
    circle, rounds = list(range(n)), []
    for _ in range(n - 1):
        pairs = [[circle[i], circle[n - 1 - i]] for i in range(n // 2)]
        rounds.append([sorted(p) for p in pairs if max(p) < partitions])
        circle = [circle[0], circle[-1], *circle[1:-1]]
    return rounds
