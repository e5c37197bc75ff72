"""Schedules: known lengths, every pair covered, rounds disjoint, buckets assigned once."""

import itertools

import pytest

from graphloom.plans import schedules as S


def pairs(states):
    return {tuple(sorted(p)) for s in states for p in itertools.combinations(s, 2)}


@pytest.mark.parametrize(("partitions", "capacity", "length"), [(16, 4, 43), (16, 8, 18), (8, 4, 10), (32, 8, 79)])
def test_beta(partitions, capacity, length):
    states = S.beta(partitions, capacity)
    assert len(states) == length
    assert len(pairs(states)) == partitions * (partitions - 1) // 2
    assert all(len(set(a) ^ set(b)) == 2 for a, b in itertools.pairwise(states))


@pytest.mark.parametrize(("partitions", "rounds"), [(4, 1), (8, 3), (16, 5), (32, 13), (64, 21)])
def test_cover(partitions, rounds):
    found = S.cover_rounds(partitions)
    assert len(found) == rounds
    assert all(sorted(p for s in r for p in s) == list(range(partitions)) for r in found)
    assert len(pairs(S.cover(partitions))) == partitions * (partitions - 1) // 2


def test_two_level_keeps_cached_partitions():
    states = S.two_level(16, 8, 2, cached=2, seed=3)
    assert all({0, 1} <= set(s) and len(s) <= 8 for s in states)
    assert len(pairs(states)) == 120


def test_orderings_by_name():
    assert S.edge_bucket_ordering("new_beta", 8, 4) == S.beta(8, 4)
    with pytest.raises(ValueError):
        S.edge_bucket_ordering("custom", 16, 8)
    with pytest.raises(NotImplementedError):
        S.node_partition_ordering("custom", 8, 4)
    assert S.dispersed_nodes(8, 4)[-1] == [4, 5, 6, 7]
    assert set(S.sequential_nodes(8, 4, 2)[0]) >= {0, 1}


def test_greedy_assigns_every_bucket_once(spark):
    rows = S.greedy_steps(S.schedule_frame(spark, S.cover(16))).collect()
    assert len(rows) == 256
    sizes = sorted(sum(1 for r in rows if r["step"] == k) for k in range(20))
    assert sizes == [12] * 16 + [16] * 4
