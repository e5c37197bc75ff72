"""Packing, periodic runs and hard negatives against the library and brute force."""

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from graphloom.llm import hard_negatives, packing, periodic_runs


# Packing.
@pytest.fixture(scope="module")
def model():
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        return f.read()


def fills_of(pieces, length):
    """Ids of each sequence, which has no gap; pieces: (doc, start, length, doc_tokens, sequence, offset, ids)."""
    sequences, fills = {}, []
    for _, _, n, _, sequence, offset, _ in pieces:
        assert 0 < n <= length
        sequences.setdefault(sequence, []).append((offset, n))
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        fills.append(at)
    assert sorted(sequences) == list(range(len(sequences))) and max(fills, default=0) <= length
    return fills


def test_packing_of_odd_rows(spark, odd_rows, docs, empty, model):
    tokenizer = Tokenizer.from_str(model)
    extra = [(100, "İstanbul ẞ ǰ K Å ﬁ ΣΑΣ <|endoftext|>x <|ENDOFTEXT|> don't THE'RE a1b2 it's! H̱ ẖ ​﻿ 한국어 \x1c\x85", "en", "a", 1, 1, "x"), (101, "Zürich, ÇÀ### œuvre.", "en", "a", 1, 1, "x")]
    rows = odd_rows + extra
    ids = [np.array([*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 1], "<u4").tobytes() for r in rows]
    df = docs.unionByName(spark.createDataFrame(extra, docs.schema))
    for length, unit in ((2048, 16), (64, 4)):
        found = packing.pack_documents(df, model, 1, length, unit).cache()
        pieces = [tuple(r) for r in found.select("doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids").collect()]
        once = [p for p in pieces if p[0] != 8]  # the repeated rows have the same key here
        want = sorted((str(r[0]), x) for r, x in zip(rows, ids, strict=True) if r[0] != 8)
        by_doc = {}
        for p in once:
            by_doc.setdefault(str(p[0]), []).append((p[1], bytes(p[6])))
        assert {k: b"".join(x for _, x in sorted(v)) for k, v in by_doc.items()} == dict(want)
        assert sum(p[2] for p in pieces if p[0] == 8) == 2 * len(ids[8]) // 4
        fills = fills_of(pieces, length)
        assert all(n == length or n & (n - 1) == 0 for n in fills)
        joined = {r["sequence_id"]: r for r in packing.sequences(found, length).collect()}
        assert len(joined) == len(fills)
        for s, r in joined.items():
            parts = sorted((p[5], bytes(p[6])) for p in pieces if p[4] == s)
            assert bytes(r["ids"]) == b"".join(x for _, x in parts) and r["segments"] == [len(x) // 4 for _, x in parts]
        found.unpersist()
    assert packing.pack_documents(empty, model, 1).count() == 0


def test_plans_use_every_rest_once():
    r = np.random.default_rng(2)
    for count in (np.bincount(r.integers(1, 2048, 5000), minlength=2048), np.bincount(np.full(999, 700), minlength=2048), np.bincount([5], minlength=2048), np.zeros(2048, int), np.bincount(r.geometric(0.002, 20_000) % 2048, minlength=2048), np.bincount([2047] * 50 + [1] * 7, minlength=2048)):
        count[0] = 0
        plan = packing.make_plan(count)
        rests = np.repeat(np.arange(2048), count)
        ranks = np.concatenate([np.arange(c) for c in count])
        mix = r.permutation(len(rests))
        row, start, size, sequence, offset = plan.place(rests[mix], ranks[mix])
        assert (np.bincount(row, size, minlength=len(rests)) == rests[mix]).all()
        order = np.lexsort((offset, sequence))
        s, o, n = sequence[order], offset[order], size[order]
        first = np.r_[True, s[1:] != s[:-1]][: len(s)]
        assert (o == np.where(first, 0, np.r_[0, (o + n)[:-1]][: len(o)])).all()
        fills = np.bincount(s, n, minlength=plan.sequences).astype(int)
        assert len(fills) == plan.sequences and all(x == 2048 or x and x & (x - 1) == 0 for x in fills)
        for i in np.flatnonzero(np.bincount(row, minlength=len(rests)) > 1)[:20]:
            own = row == i
            assert sorted(zip(start[own], size[own], strict=True))[0][0] == 0


def test_column_generation_reaches_the_best_patterns():
    """Two classes of three fifths and two fifths of a stock share it pairwise; a lower bound is met where sizes divide the stock."""
    found = packing.solve(np.array([48, 80]), np.array([100, 100]), 128)
    used = [(round(x, 6), p.tolist(), s) for x, p, s in found if x > 1e-9]
    assert used == [(100.0, [1, 1], 128)]
    cost = sum(x * s for x, _, s in packing.solve(np.array([32, 64]), np.array([64, 10]), 128))
    assert cost == pytest.approx(64 * 32 + 10 * 64)


# Periodic runs.
def brute(words, least=24, periods=3):
    """For every period, all stretches of words that equal the word a period on."""
    number = {}
    w, found = np.array([number.setdefault(x, len(number)) for x in words]), {}
    for p in range(1, len(w) // periods + 1):
        same = np.r_[False, w[p:] == w[:-p], False]
        for s, e in np.flatnonzero(same[1:] != same[:-1]).reshape(-1, 2).tolist():
            if e + p - s >= max(least, periods * p):
                found.setdefault((s, e + p), p)
    return sorted((s, e - s, p) for (s, e), p in found.items())


def test_runs_match_brute_force():
    r = random.Random(4)
    texts = []
    for _ in range(250):
        n, k = r.randint(0, 160), r.choice([1, 2, 3, 12, 200])
        w = [r.randint(0, k) for _ in range(n)]
        for _ in range(r.randint(0, 2)):
            if n > 30:
                a = r.randint(0, n - 1)
                p = r.randint(1, max(1, (n - a) // 3))
                w = w[:a] + (w[a : a + p] * n)[: n - a]
                if r.random() < 0.5:
                    w[r.randint(0, n - 1)] = 999
        texts.append(w)
    for least, periods in ((24, 3), (6, 2), (3, 3), (40, 5)):
        got = periodic_runs.runs_of([np.array(w, np.int64) for w in texts], least, periods)
        assert [[tuple(map(int, x)) for x in g] for g in got] == [brute(w, least, periods) for w in texts]
    assert periodic_runs.runs_of([np.zeros(50_000, np.int64)])[0].tolist() == [[0, 50_000, 1]]


def test_runs_of_odd_rows(spark, odd_rows, docs, empty):
    repeats = [(200 + i, " ".join([f"w{j % (3 + i)}" for j in range(20 * i)]) + " tail", "en", "a", 1, 1, "x") for i in range(1, 5)]
    rows = odd_rows + repeats
    df = docs.unionByName(spark.createDataFrame(repeats, docs.schema))
    for rewrite in (None, periodic_runs.repeat_tail):
        want = []
        for row in rows:
            words = (row[1] or "").encode().split()
            words = rewrite(row[0], words) if rewrite else words
            runs = brute(words)
            kept = [not any(s + p <= i < s + n for s, n, p in runs) for i in range(len(words))] if runs else [True] * len(words)
            best = min(runs, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2])) if runs else (None,) * 3
            sha = lambda b: hashlib.sha256(b).hexdigest()
            want.append((row[0], len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha("".join(f"{s},{n},{p}\n" for s, n, p in runs).encode()), sha(b" ".join(w for w, k in zip(words, kept, strict=True) if k))))
        got = [tuple(r) for r in periodic_runs.digest(periodic_runs.find_runs(df, rewrite)).collect()]
        assert sorted(map(str, got)) == sorted(map(str, want)) and any(w[1] for w in want)
    assert periodic_runs.find_runs(empty).count() == 0


def test_tails_repeat_by_the_contract():
    for doc_id in (None, *range(60)):
        words = [str(i).encode() for i in range(37)]
        h = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
        a = (h // 10) % 37
        p = 1 + (37 - a) // (3 + (h // 10) % 8)
        want = [words[i] if i < a else words[a + (i - a) % p] for i in range(37)] if h % 10 == 0 else words
        assert periodic_runs.repeat_tail(doc_id, words) == want
    assert periodic_runs.repeat_tail(None, []) == []


# Hard negatives.
def brute_negatives(rows, positives=5, negatives=5, share=80):
    """rows: (id, label, vector, anchor) in index order for ties."""
    valid = [(i, y, [int(np.floor(256 * np.float64(x))) for x in v], a) for i, y, v, a in rows if i is not None and y is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    out = []
    for k, (i, y, v, anchor) in enumerate(valid):
        if not anchor:
            continue
        scored = [(-dot(v, w), j, z) for m, (j, z, w, _) in enumerate(valid) if m != k]
        for s, j, _ in sorted((x for x in scored if x[2] == y), key=lambda x: x[:2])[:positives]:
            near = [x for x in scored if x[2] != y and share * -s <= 100 * -x[0] <= 100 * -s]
            out += [(i, j, rank, n, -s, -t) for rank, (t, n, _) in enumerate(sorted(near, key=lambda x: x[:2])[:negatives], 1)]
    return sorted(out)


def negatives_of(spark, rows, **options):
    df = spark.createDataFrame(rows, "id long, label int, vector array<float>, anchor boolean").withColumn("dist", F.lit("clash")).withColumn("number", F.lit(3)).repartition(3)
    return sorted(map(tuple, hard_negatives.mine(df, **options).collect()))


def test_negatives_match_brute_force(spark, monkeypatch):
    r = np.random.default_rng(7)
    centres = r.normal(size=(6, 8))
    rows = [(i, int(r.integers(0, 4)), [float(x) for x in np.float32(centres[i % 6] + 0.4 * r.normal(size=8))], i % 9 == 0) for i in range(260)]
    hot = rows[5][2]
    rows += [(1000 + i, i % 2, hot, i == 0) for i in range(60)]  # one common vector, ties by id
    rows += [(2000, 77, rows[3][2], True), (2001, 3, [0.0] * 8, True), (2002, 3, [float("nan")] * 8, True), (2003, 3, [1.0, None] * 4, False), (2004, None, hot, True), (None, 1, hot, True), (2005, 1, None, True), (2006, 2, [0.5, 0.25], True)]
    want = brute_negatives(rows)
    assert len(want) > 300
    for block, shard, pivots in ((1024, 16, 32), (8, 2, 5)):  # many small blocks: radii prune and widen
        monkeypatch.setattr(hard_negatives, "BLOCK", block)
        monkeypatch.setattr(hard_negatives, "SHARD", shard)
        monkeypatch.setattr(hard_negatives, "PIVOTS", pivots)
        assert negatives_of(spark, rows) == want
    assert negatives_of(spark, rows, positives=2, negatives=3, share=60) == brute_negatives(rows, 2, 3, 60)


def test_negatives_of_odd_tables(spark):
    assert negatives_of(spark, []) == []
    assert negatives_of(spark, [(1, 1, [1.0], False), (2, 2, [1.0], False)]) == []
    twice = [(7, 1, [1.0, 0.5], True)] * 2 + [(8, 2, [1.0, 0.25], False)] * 2 + [(9, 2, [], False)]
    assert negatives_of(spark, twice) == brute_negatives(twice)
    assert negatives_of(spark, [(1, 1, [-1.0], True), (2, 1, [1.0], False), (3, 2, [0.5], False)]) == []
