"""Partition schedules: which node partitions are together in memory at each step, made on the driver (a schedule has
one entry per step and slot, so its size depends on the partition count alone)."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

States = list[list[int]]


def beta(partitions: int, capacity: int) -> States:
    """Swap one partition at a time until every pair has been together.

    All slots but the last stay while the last runs over everything not met yet; then the stayers are finished and are
    replaced, one a step, by unfinished partitions.
    """
    if not 2 <= capacity <= partitions:
        raise ValueError("capacity must lie between 2 and the number of partitions")
    buffer, states = list(range(capacity)), [list(range(capacity))]
    open_ = set(range(partitions))
    while True:
        for p in sorted(open_.difference(buffer)):
            buffer[-1] = p
            states.append(list(buffer))
        open_.difference_update(buffer[:-1])
        waiting = sorted(open_.difference(buffer))
        if not waiting:
            return states
        for slot, p in enumerate(waiting[: capacity - 1]):
            buffer[slot] = p
            states.append(list(buffer))


def two_level(partitions: int, capacity: int, fine_to_coarse: int, cached: int = 0, seed: int = 0) -> States:
    """Beta over groups of ``fine_to_coarse`` randomly grouped partitions; ``cached`` ones are present in every state."""
    free = list(range(cached, partitions))
    random.Random(seed).shuffle(free)
    groups = [free[i : i + fine_to_coarse] for i in range(0, len(free), fine_to_coarse)]
    slots = (capacity - cached) // fine_to_coarse
    if slots >= len(groups):
        return [list(range(partitions))]
    return [[*range(cached), *(p for g in state for p in groups[g])] for state in beta(len(groups), slots)]


def _lines(bits: int) -> list[tuple[int, int]]:
    """Planes of GF(2)^bits (by two generators) that together hold every non-zero vector."""
    if bits == 2:
        return [(1, 2)]
    if bits == 3:
        return [(1, 2), (1, 4), (1, 6)]
    low = bits - 2
    found = [(1 << low, 2 << low)]
    for a, b in _lines(low):
        # Maps l -> c * l over GF(4), with a -> 1 and b -> w; each non-zero l meets every value once.
        found += [(a | x << low, b | y << low) for x, y in ((0, 0), (1, 2), (2, 3), (3, 1))]
    return found


def cover_rounds(partitions: int) -> list[States]:
    """Rounds of disjoint 4-sets that cover all pairs; the states of a round share nothing and can run at once."""
    bits = partitions.bit_length() - 1
    if partitions != 1 << bits or bits < 2:
        raise ValueError("a cover needs a power of two of at least 4 partitions")
    rounds = []
    for a, b in _lines(bits):
        seen: set[int] = set()
        states = []
        for p in range(partitions):
            if p not in seen:
                states.append(sorted((p, p ^ a, p ^ b, p ^ a ^ b)))
                seen.update(states[-1])
        rounds.append(states)
    return rounds


def cover(partitions: int) -> States:
    return [s for r in cover_rounds(partitions) for s in r]


def dispersed_nodes(partitions: int, capacity: int) -> States:
    """Node classification: replace one partition a step until all have been present."""
    buffer, states = list(range(capacity)), [list(range(capacity))]
    for k, p in enumerate(range(capacity, partitions)):
        buffer[k % capacity] = p
        states.append(list(buffer))
    return states


def sequential_nodes(partitions: int, capacity: int, train_partitions: int, seed: int = 0) -> States:
    """Node classification: one state with all train partitions, filled up at random."""
    rest = list(range(train_partitions, partitions))
    random.Random(seed).shuffle(rest)
    return [[*range(train_partitions), *rest[: max(0, capacity - train_partitions)]]]


def edge_bucket_ordering(kind: str, partitions: int, capacity: int, fine_to_coarse: int = 1, cached: int = 0, seed: int = 0) -> States:
    """A schedule by name: OLD_BETA, NEW_BETA, COMET, CUSTOM or ALL_BETA (the cover, which needs capacity 4)."""
    kind = kind.upper()
    if kind in ("OLD_BETA", "NEW_BETA"):
        return beta(partitions, capacity)
    if kind == "COMET":
        return two_level(partitions, capacity, fine_to_coarse, cached, seed)
    if kind in ("CUSTOM", "ALL_BETA"):
        if capacity != 4:
            raise ValueError("the cover needs capacity 4")
        return cover(partitions)
    raise ValueError(f"unknown ordering {kind}")


def node_partition_ordering(kind: str, partitions: int, capacity: int, train_partitions: int = 0, seed: int = 0) -> States:
    kind = kind.upper()
    if kind == "DISPERSED":
        return dispersed_nodes(partitions, capacity)
    if kind == "SEQUENTIAL":
        return sequential_nodes(partitions, capacity, train_partitions, seed)
    raise NotImplementedError(f"node partition ordering {kind}")


def schedule_rows(states: States) -> list[tuple[int, int, int]]:
    return [(step, slot, part) for step, state in enumerate(states) for slot, part in enumerate(state)]


def schedule_frame(spark: SparkSession, states: States) -> DataFrame:
    """(step, slot, part)."""
    return spark.createDataFrame(schedule_rows(states), "step int, slot int, part int")


def greedy_steps(schedule: DataFrame) -> DataFrame:
    """(src_part, dst_part, step): each bucket goes to the first state that holds both partitions."""
    a = schedule.select("step", F.col("part").alias("src_part"))
    b = schedule.select("step", F.col("part").alias("dst_part"))
    return a.join(b, "step").groupBy("src_part", "dst_part").agg(F.min("step").alias("step"))


def random_steps(schedule: DataFrame, salt: str = "steps") -> DataFrame:
    """(src_part, dst_part, step): each bucket goes to one of the states that hold both, by hash."""
    from graphloom.hashing import h48

    a = schedule.select("step", F.col("part").alias("src_part"))
    b = schedule.select("step", F.col("part").alias("dst_part"))
    both = a.join(b, "step").withColumn("h", h48(F.concat_ws("-", "src_part", "dst_part", "step"), salt))
    return both.groupBy("src_part", "dst_part").agg(F.min(F.struct("h", "step")).alias("m")).select("src_part", "dst_part", F.col("m.step").alias("step"))


def admit_evict(schedule: DataFrame) -> DataFrame:
    """(step, part, action): what each step loads and unloads, as set differences of consecutive states."""
    last = schedule.agg(F.max("step").alias("last"))
    next_ = schedule.select((F.col("step") + 1).alias("step"), "part")
    admit = schedule.where("step > 0").select("step", "part").join(next_, ["step", "part"], "left_anti").withColumn("action", F.lit("admit"))
    evict = next_.join(F.broadcast(last), F.col("step") <= F.col("last")).select("step", "part").join(schedule.select("step", "part"), ["step", "part"], "left_anti").withColumn("action", F.lit("evict"))
    return admit.unionByName(evict)


def round_devices(rounds: list[States]) -> list[tuple[int, int, int]]:
    """(round, device, part): the states of a round are dealt to devices in order."""
    return [(r, d, p) for r, states in enumerate(rounds) for d, state in enumerate(states) for p in state]


def transfer_plan(owned: DataFrame) -> DataFrame:
    """(round, part, from_device, to_device) wherever a partition changes its device between rounds."""
    w = Window.partitionBy("part").orderBy("round")
    moved = owned.withColumn("from_device", F.lag("device").over(w))
    return moved.where("from_device is not null and from_device != device").select("round", "part", "from_device", F.col("device").alias("to_device"))
