"""Packing documents into sequences of one length by cutting-stock column generation.

A document's ids and its end id are cut into whole sequences of ``LENGTH`` ids and a rest. Rests are counted by length
(a histogram of at most ``LENGTH`` numbers, whatever the data's size) and classed in units of ``UNIT`` ids. A linear
program over patterns (how many rests of each class share a sequence) minimises the ids of all sequences; its columns
are priced by a knapsack dynamic program over the simplex method's duals. Sequences may also be shorter, at a power of
two, which needs no padding either. Pattern counts are rounded down, and up where rests are left.

Rests are ranked by (class, longer first, place) and dealt to the patterns' sequences by rank, so the length at any rank,
and with it every offset and every gap, follows from the histogram: the plan is a short list of stretches of equal
sequences, which each task applies to its own documents. Rests that no pattern takes (the shortest of their classes) form
one stream that is cut to fill the gaps; as many pattern copies are given up as the stream needs to cover all gaps. What
is left of the stream fills sequences of its own, the last ones at powers of two, so nothing is padded.

Ranks come from counts of (shard, length): no row is sorted, and ids are shuffled only if those counts are too large to
send to every executor.

Defined cases: a null or empty text is the end id alone; repeated rows and rows with equal or null ids are documents of
their own; an empty table gives an empty result; extra columns are ignored; texts of any length are cut into as many
sequences as they fill; of rests with equal lengths those in earlier shards rank first; strings of the tokenizer's added
tokens in a text become those tokens, as in the library.
"""

from __future__ import annotations

import os
import zlib
from array import array
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import batch, map_arrow, materialize
from graphloom.llm.pieces import byte_letters, latin
from graphloom.runtime import sized_broadcast

#: Ids of a sequence and of a unit of the linear program; what a sequence costs beside its ids, in units.
LENGTH, UNIT, OPENING = 2048, 16, 0.5
#: Steps of the simplex method at most (each basis is a whole plan, the last one the best); words a worker remembers.
STEPS, MEMORY = 4000, 800_000


# Plan.
def _price(duals: np.ndarray, sizes: np.ndarray, stocks: np.ndarray, costs: np.ndarray) -> tuple[float, np.ndarray, int]:
    """Knapsack over units: the pattern and stock with the greatest value of duals above the stock's cost."""
    top = int(stocks.max())
    best, choice = np.zeros(top + 1), np.full(top + 1, -1)
    for c in range(1, top + 1):
        fits = np.searchsorted(sizes, c, "right")
        best[c], choice[c] = best[c - 1], -1
        if fits:
            value = best[c - sizes[:fits]] + duals[:fits]
            k = int(value.argmax())
            if value[k] > best[c]:
                best[c], choice[c] = value[k], k
    gain = best[stocks] - costs
    stock = int(gain.argmax())
    pattern, c = np.zeros(len(sizes), np.int64), int(stocks[stock])
    while c > 0:
        k = choice[c]
        if k < 0:
            c -= 1
        else:
            pattern[k] += 1
            c -= int(sizes[k])
    return float(gain[stock]), pattern, int(stocks[stock])


def solve(sizes: np.ndarray, demand: np.ndarray, top: int, opening: float = OPENING) -> list[tuple[float, np.ndarray, int]]:
    """(copies, pattern, stock) of the linear program: patterns of ``sizes`` units that meet ``demand`` exactly at the least
    cost; stocks are ``top`` and the powers of two below it, and cost their units and ``opening``."""
    stocks = np.array(sorted({top, *(1 << k for k in range(top.bit_length()) if 1 << k <= top)}))
    costs = stocks + opening
    n = len(sizes)
    own = np.searchsorted(stocks, sizes)
    patterns, used = [*np.eye(n, dtype=np.int64)], list(stocks[own])
    cost, inverse, copies = costs[own].copy(), np.eye(n), demand.astype(float)
    for _ in range(STEPS if n else 0):
        gain, pattern, stock = _price(cost @ inverse, sizes, stocks, costs)
        if gain <= 1e-7:
            break
        change = inverse @ pattern
        rising = np.flatnonzero(change > 1e-9)
        ratio = copies[rising] / change[rising]
        out = rising[int(ratio.argmin())]
        row = inverse[out] / change[out]
        step = copies[out] / change[out]
        copies -= step * change
        inverse -= np.outer(change, row)
        inverse[out], copies[out] = row, step
        np.maximum(copies, 0, out=copies)
        patterns[out], used[out], cost[out] = pattern, stock, stock + opening
    return list(zip(copies.tolist(), patterns, used, strict=True))


def _round(solution, share: float, demand: np.ndarray) -> np.ndarray:
    """Whole copies: a share of each, rounded down, then one more where the rests are there, greatest fraction first."""
    wanted = np.array([x * share for x, _, _ in solution])
    copies = np.floor(wanted + 1e-9).astype(np.int64)
    left = demand - sum((c * p for c, (_, p, _) in zip(copies, solution, strict=True)), np.zeros_like(demand))
    for k in np.argsort(copies - wanted, kind="stable"):
        if wanted[k] - copies[k] > 1e-6 and (solution[k][1] <= left).all():
            copies[k] += 1
            left = left - solution[k][1]
    return copies


@dataclass
class Plan:
    """Where every rest goes, by its length and its rank among rests of that length.

    Stretches are consecutive sequences that hold rests of the same lengths: ``first`` sequence, ``used`` ids, ``gap``
    behind them, ids of all gaps before (``ahead``), and offsets of the slots (``slot_offsets`` from ``slot_at`` on).
    """

    length: int
    count: np.ndarray
    in_class: np.ndarray
    class_of: np.ndarray
    packed: np.ndarray
    parts: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]
    stream: np.ndarray
    first: np.ndarray
    used: np.ndarray
    gap: np.ndarray
    ahead: np.ndarray
    slot_at: np.ndarray
    slot_offsets: np.ndarray
    sequences: int

    def place(self, rests: np.ndarray, ranks: np.ndarray):
        """(row, start in the rest, length, sequence, offset) of the pieces of rests with these lengths and ranks."""
        own = np.flatnonzero(rests > 0)
        rest, kind = rests[own], self.class_of[rests[own]]
        rank = self.in_class[rest] + ranks[own]
        whole = rank < self.packed[kind]
        rows, seqs, offsets = [], [], []
        for c in np.unique(kind[whole]):
            at = np.flatnonzero(whole & (kind == c))
            base, copies, seq, slot = self.parts[c]
            part = np.searchsorted(base, rank[at], "right") - 1
            k = rank[at] - base[part]
            s = seq[part] + k % copies[part]
            rows.append(own[at])
            seqs.append(s)
            offsets.append(self.slot_offsets[self.slot_at[np.searchsorted(self.first, s, "right") - 1] + slot[part] + k // copies[part]])
        out = [(np.concatenate(rows), np.zeros(int(whole.sum()), np.int64), rests[np.concatenate(rows)], np.concatenate(seqs), np.concatenate(offsets))] if rows else []
        cut = []
        for i, r, k in zip(own[~whole].tolist(), rest[~whole].tolist(), rank[~whole].tolist(), strict=True):
            at = int(self.stream[r]) + (k - max(int(self.in_class[r]), int(self.packed[self.class_of[r]]))) * r
            start = 0
            while start < r:
                s = int(np.searchsorted(self.ahead, at, "right")) - 1
                copy, inside = divmod(at - int(self.ahead[s]), int(self.gap[s]))
                take = min(int(self.gap[s]) - inside, r - start)
                cut.append((i, start, take, int(self.first[s]) + copy, int(self.used[s]) + inside))
                start, at = start + take, at + take
        if cut:
            out.append(tuple(np.array(cut, np.int64).T))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else tuple(np.zeros(0, np.int64) for _ in range(5))


def make_plan(count: np.ndarray, length: int = LENGTH, unit: int = UNIT) -> Plan:
    """The plan for ``count[r]`` rests of r ids, 0 < r < length; rests of no ids have no place."""
    if length & (length - 1) or length % unit:
        raise ValueError("sequences need a power of two of ids, and a whole number of units")
    count = count.astype(np.int64).copy()
    count[0] = 0
    lengths = np.arange(length)
    class_of = -(-lengths // unit)
    order = np.lexsort((-lengths, class_of))[1:]  # lengths by class, longer first, without 0
    before = np.concatenate([[0], np.cumsum(count[order])])
    position = np.zeros(length, np.int64)
    position[order] = before[:-1]
    demand = np.bincount(class_of, count, minlength=length // unit + 1).astype(np.int64)
    start = np.concatenate([[0], np.cumsum(demand)])[: len(demand)]
    in_class = position - start[class_of]
    tokens = np.concatenate([[0], np.cumsum(count[order] * order)])

    def ids_up_to(at: np.ndarray) -> np.ndarray:
        """Ids of the first rests by rank over all classes."""
        k = np.minimum(np.searchsorted(before, at, "right") - 1, len(order) - 1)
        return tokens[k] + (at - before[k]) * order[k]

    classes = np.flatnonzero(demand)
    solution = solve(classes, demand[classes], length // unit)

    def packed_by(copies) -> np.ndarray:
        packed = np.zeros_like(demand)
        for c, (_, pattern, _) in zip(copies, solution, strict=True):
            packed[classes] += c * pattern
        return packed

    def enough(copies) -> bool:
        """Whether the rests that no pattern takes cover all gaps."""
        packed = packed_by(copies)
        held = int((ids_up_to(start + packed) - ids_up_to(start)).sum())
        room = sum(int(c) * stock * unit for c, (_, _, stock) in zip(copies, solution, strict=True))
        return int(tokens[-1]) - held >= room - held

    low, high, copies = 0.0, 1.0, _round(solution, 1.0, demand[classes])
    if not enough(copies):
        copies = np.zeros(len(solution), np.int64)
        for _ in range(30):
            middle = (low + high) / 2
            tried = _round(solution, middle, demand[classes])
            if enough(tried):
                low, copies = middle, tried
            else:
                high = middle
    packed = packed_by(copies)

    parts: list = [[] for _ in demand]
    taken, sequence = np.zeros_like(demand), 0
    first, used, gap, many, slot_at, slot_offsets = [], [], [], [], [], []
    for n, (_, pattern, stock) in zip(copies.tolist(), solution, strict=True):
        if not n:
            continue
        slots, number = [], 0
        for c, k in zip(classes.tolist(), pattern.tolist(), strict=True):
            if k:
                parts[c].append((int(taken[c]), n, sequence, number))
                slots += [start[c] + taken[c] + i * n for i in range(k)]
                taken[c] += k * n
                number += k
        slots = np.array(slots)
        # Copies at which the length at any slot's rank changes.
        changes = {0}
        for s in slots:
            inside = before[np.searchsorted(before, s, "right") : np.searchsorted(before, s + n, "left")]
            changes.update((inside - s).tolist())
        changes = sorted(changes)
        for c, end in zip(changes, [*changes[1:], n], strict=True):
            sizes = order[np.searchsorted(before, slots + c, "right") - 1]
            first.append(sequence + c)
            used.append(int(sizes.sum()))
            gap.append(stock * unit - used[-1])
            many.append(end - c)
            slot_at.append(len(slot_offsets))
            slot_offsets += np.concatenate([[0], np.cumsum(sizes)[:-1]]).tolist()
        sequence += n
    stream = np.zeros(length, np.int64)
    ahead = 0
    for r in order.tolist():
        stream[r] = ahead
        ahead += max(0, int(count[r]) - max(0, int(packed[class_of[r]] - in_class[r]))) * r
    left = ahead - sum(g * n for g, n in zip(gap, many, strict=True))
    for size in (1 << k for k in reversed(range(length.bit_length()))):
        n, left = divmod(left, size)
        if n:
            first.append(sequence)
            used.append(0)
            gap.append(size)
            many.append(n)
            slot_at.append(len(slot_offsets))
            sequence += n
    total = np.array(gap, np.int64) * np.array(many, np.int64)
    return Plan(
        length, count, in_class, class_of, packed, [tuple(np.array(x, np.int64) for x in zip(*p, strict=True)) if p else () for p in parts], stream, np.array(first, np.int64), np.array(used, np.int64),
        np.array(gap, np.int64), np.cumsum(total) - total, np.array(slot_at, np.int64), np.array(slot_offsets, np.int64), sequence,
    )


# Documents.
#: Fixed value: marks that may follow a word.
_MARKS = b".,;:!?#$%*&|"
_encoders: dict[int, object] = {}


def _encoder(model: str):
    """Ids of texts (bytes) as little-endian 32-bit integers; words between ASCII white space are remembered.

    For tokenizers that drop white space and never look across it. Words of Latin letters, with or without marks behind
    them, go to the BPE model itself where probes show that this gives the same ids; all others to the whole tokenizer.
    """
    key = zlib.crc32(model.encode())
    if key in _encoders:
        return _encoders[key]
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(model)
    letters, merges = byte_letters(), tokenizer.model
    memory: dict[bytes, bytes] = {}
    older: dict[bytes, bytes] = {}
    pack = lambda ids: np.array(ids, "<u4").tobytes()

    def of_letters(word: bytes) -> bytes | None:
        """Ids of a word of Latin letters."""
        s = word.decode().lower()
        if not latin(s):
            return None
        if not s.isascii():
            s = "".join(map(letters.__getitem__, s.encode()))
        return array("I", [t.id for t in merges.tokenize(s)]).tobytes()

    library = lambda word: pack(tokenizer.encode(word.decode(), add_special_tokens=False).ids)
    probes = [x.encode() for x in ("the", "Zürich", "ÇÀ", "ofononwhnt", "œuvre", "ŐŁĲ", "Straße")]
    direct = all(of_letters(x) == library(x) for x in probes) and all(library(x + m) == library(x) + library(m) for x in probes for m in (b".", b"###", b",;"))

    def learn(new: list[bytes]) -> None:
        rest = []
        for w in new:
            stem = w.rstrip(_MARKS) if direct else b""
            ids = (memory.get(stem) or of_letters(stem)) if stem else None
            if ids is None:
                rest.append(w)
                continue
            if len(stem) < len(w):
                marks = w[len(stem) :]
                memory[stem] = ids
                if marks not in memory:
                    memory[marks] = library(marks)
                ids += memory[marks]
            memory[w] = ids
        for w, e in zip(rest, tokenizer.encode_batch_fast([w.decode() for w in rest], add_special_tokens=False), strict=True):
            memory[w] = pack(e.ids)

    def encode(texts: list[bytes]) -> list[bytes]:
        nonlocal memory, older
        if len(memory) > MEMORY:
            memory, older = {}, memory
        out = []
        for text in texts:
            words = text.split()
            found = list(map(memory.get, words))
            if None in found:
                new = {w for w, x in zip(words, found, strict=True) if x is None}
                known = new & older.keys()
                memory.update((w, older[w]) for w in known)
                learn(list(new - known))
                found = list(map(memory.__getitem__, words))
            out.append(b"".join(found))
        return out

    _encoders[key] = encode
    return encode


def encode_documents(docs: DataFrame, model: str, end_id: int, length: int = LENGTH) -> DataFrame:
    """(doc_id, shard, n_tokens, rest, nth, whole, ids) of every row: its ids with the end id, and how many rests of the same
    length and how many whole sequences its shard has before it. A written table: shards and places in them stay."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))
    out = pa.schema([("doc_id", pa.int64()), ("shard", pa.int32()), ("n_tokens", pa.int64()), ("rest", pa.int32()), ("nth", pa.int64()), ("whole", pa.int64()), ("ids", pa.binary())])

    def run(batches):
        encode, shard, end = _encoder(shared.value), TaskContext.get().partitionId(), end_id.to_bytes(4, "little")
        met, whole = [0] * length, 0
        for b in batches:
            ids = [x + end for x in encode(b.column("text").to_pylist())]
            sizes = [len(x) // 4 for x in ids]
            nth, ahead = [], []
            for n in sizes:
                nth.append(met[n % length])
                ahead.append(whole)
                met[n % length] += 1
                whole += n // length
            yield batch(out, doc_id=b.column("doc_id").to_pylist(), shard=[shard] * len(ids), n_tokens=sizes, rest=[n % length for n in sizes], nth=nth, whole=ahead, ids=ids)

    return materialize(map_arrow(rows, run, "doc_id long, shard int, n_tokens long, rest int, nth long, whole long, ids binary"), "encoded")


PIECES = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


def pack_documents(docs: DataFrame, model: str, end_id: int, length: int = LENGTH, unit: int = UNIT) -> DataFrame:
    """Pieces (doc_id, start, length, doc_tokens, sequence_id, offset, ids) of all documents; ``ids`` are little-endian
    unsigned 32-bit integers. ``model`` is the tokenizer's description (JSON)."""
    encoded = encode_documents(docs, model, end_id, length)
    counts = materialize(encoded.groupBy("shard", "rest").agg(F.count(F.lit(1)).alias("rows"), F.sum(F.floor(F.col("n_tokens") / F.lit(length))).alias("wholes")), "lengths")
    count = np.zeros(length, np.int64)
    for r in counts.groupBy("rest").agg(F.sum("rows").alias("rows")).collect():  # at most ``length`` rows
        count[r["rest"]] = r["rows"]
    plan = make_plan(count, length, unit)
    earlier = lambda c, w: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shards = counts.groupBy("shard").agg(F.sum("wholes").alias("wholes"))
    shards = shards.select("shard", earlier("wholes", Window.orderBy("shard")).alias("whole_base"))
    bases = counts.select("shard", "rest", earlier("rows", Window.partitionBy("rest").orderBy("shard")).alias("base")).join(shards, "shard")
    rows = encoded.join(sized_broadcast(materialize(bases, "bases"), 64), ["shard", "rest"])
    rows = rows.select("doc_id", "n_tokens", "rest", (F.col("nth") + F.col("base")).alias("rank"), (F.col("whole") + F.col("whole_base")).alias("whole"), "ids")
    names = ("doc_id", "start", "length", "doc_tokens", "sequence_id", "offset")

    def run(batches):
        for b in batches:
            n, rest, rank, whole = (b.column(c).to_numpy() for c in ("n_tokens", "rest", "rank", "whole"))
            row, start, size, sequence, offset = plan.place(rest, rank)
            filled = n // length
            own = np.repeat(np.arange(len(n)), filled)
            k = np.arange(len(own)) - np.repeat(np.cumsum(filled) - filled, filled)
            row, start, size = np.r_[row, own], np.r_[start + filled[row] * length, k * length], np.r_[size, np.full(len(own), length)]
            sequence, offset = np.r_[sequence, plan.sequences + whole[own] + k], np.r_[offset, np.zeros(len(own), np.int64)]
            ids = b.column("ids").to_pylist()
            cut = [ids[i][4 * s : 4 * (s + m)] for i, s, m in zip(row.tolist(), start.tolist(), size.tolist(), strict=True)]
            columns = dict(zip(names, (b.column("doc_id").take(pa.array(row)), start, size, n[row], sequence, offset), strict=True))
            yield pa.RecordBatch.from_arrays([*(pa.array(columns[c], pa.int64()) for c in names), pa.array(cut, pa.binary())], names=[*names, "ids"])

    return map_arrow(rows, run, PIECES)


def sequences(pieces: DataFrame, length: int = LENGTH, pad_id: int = 0) -> DataFrame:
    """(sequence_id, n_ids, ids, segments) of packed pieces: ids little-endian, padded unless their number is a power of two;
    segments are the pieces' lengths in order, for masks that keep documents apart."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "length", "ids")))
    rows = pieces.groupBy("sequence_id").agg(F.sum("length").alias("n_ids"), parts.alias("parts"))
    joined = F.aggregate("parts", F.lit(b""), lambda a, p: F.concat(a, p["ids"]))
    n = F.col("n_ids")
    missing = F.when(n.bitwiseAND(n - 1) == 0, F.lit(0)).otherwise(F.lit(length) - n)
    pad = F.unhex(F.repeat(F.lit(pad_id.to_bytes(4, "little").hex()), missing.cast("int")))
    return rows.select("sequence_id", "n_ids", F.concat(joined, pad).alias("ids"), F.transform("parts", lambda p: p["length"]).alias("segments"))
