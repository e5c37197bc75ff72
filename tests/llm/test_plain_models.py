"""Fitted models against plain loops: n-gram buckets and FTRL, path lengths and thresholds, and a very long turn."""

import math
import random
import re
import zlib
from itertools import groupby

import numpy as np
import pytest

from graphloom.llm import chat, quality_classifier as Q, quality_rules as R

BIG = 1 << 64


def plain_buckets(text):
    """Buckets of words, word pairs, shapes and shape pairs, one by one in whole numbers."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lower = lambda w: "".join(c.lower() if "A" <= c <= "Z" else c for c in w)
    lex = [zlib.crc32(lower(w).strip(Q._OUTER.decode()).encode()) for w in words]
    kind = lambda b: "d" if 48 <= b <= 57 else "X" if 65 <= b <= 90 else "x" if 97 <= b <= 122 or b >= 128 else chr(b)
    shape = [zlib.crc32("".join(k for k, _ in groupby(map(kind, w.encode()))).encode(), 1) for w in words]
    found = []
    for salt, h in ((1, lex), (2, shape)):
        mix = (0x9E3779B97F4A7C15 + 2 * salt) % BIG
        found += [((x + salt) * mix % BIG) >> 40 for x in h]
        for i in range(len(words) - 1):
            same = lex[i] == lex[i + 1]
            found.append(((int(mix) * 97 % BIG) if same else (h[i] * 0xC2B2AE3D27D4EB4F + h[i + 1] + salt) * mix % BIG) >> 40)
    return [x % (1 << Q.BITS) for x in found]


def plain_ftrl(texts, targets):
    """FTRL-proximal over dictionaries, feature by feature."""
    z, n, rows = {}, {}, []
    for t in texts:
        b = plain_buckets(t)
        x = {}
        for i in b:
            x[i] = x.get(i, 0) + 1
        rows.append({i: c / math.sqrt(max(len(b) / 4, 1)) for i, c in x.items()} | {"bias": 1.0})

    def weight(i):
        s = z.get(i, 0.0)
        return 0.0 if abs(s) <= Q.L1 else -(s - math.copysign(Q.L1, s)) / ((Q.BETA + math.sqrt(n.get(i, 0.0))) / Q.ALPHA + Q.L2)

    for _ in range(Q.EPOCHS):
        for x, y in zip(rows, targets, strict=True):
            w = {i: weight(i) for i in x}
            p = 1 / (1 + math.exp(-sum(w[i] * v for i, v in x.items())))
            for i, v in x.items():
                g = (p - y) * v
                before = n.get(i, 0.0)
                z[i] = z.get(i, 0.0) + g - (math.sqrt(before + g * g) - math.sqrt(before)) / Q.ALPHA * w[i]
                n[i] = before + g * g
    return weight, z


@pytest.fixture(scope="module")
def labelled():
    r = random.Random(9)
    word = lambda: "".join(r.choice("abcdeéß") for _ in range(r.randint(1, 5)))
    good = [" ".join(word() for _ in range(r.randint(5, 40))).capitalize() + "." for _ in range(25)]
    bad = [" ".join(r.choice(("BUY!!!", "free", "$$$", "99", "click")) for _ in range(r.randint(5, 40))) for _ in range(25)]
    return [*good, *bad, ""], [*[1] * 25, *[0] * 25, 1]


def test_buckets_and_weights_match_plain_loops(labelled):
    texts, targets = labelled
    for t in [*texts, "x  x\tx", "Ünï (code) 12-34!", "\x1c\x85 ​"]:
        assert sorted(Q.buckets(t).tolist()) == sorted(plain_buckets(t))
    got = Q.ftrl(texts, targets)
    weight, z = plain_ftrl(texts, targets)
    assert got[-1] == pytest.approx(weight("bias"), abs=1e-9)
    assert all(got[i] == pytest.approx(weight(i), abs=1e-9) for i in z if i != "bias")
    assert set(np.flatnonzero(got[:-1]).tolist()) == {i for i in z if i != "bias" and weight(i)}
    right = 0
    for t, y in zip(texts, targets, strict=True):
        b = plain_buckets(t)
        s = weight("bias") + sum(weight(i) for i in b) / math.sqrt(max(len(b) / 4, 1))
        assert Q.score_text(t, got) == pytest.approx(1 / (1 + math.exp(-s)), abs=1e-6)
        right += (s >= 0) == y
    assert right >= len(texts) - 1


def test_forest_scores_match_plain_path_lengths():
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=(300, 7)), rng.normal(size=(5, 7)) + 9])
    forest = R.IsolationForest.fit(x[:300], trees=20, tree_rows=64)

    def expected(n):
        return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n

    scores = []
    for row in x:
        total = 0.0
        for t in range(20):
            node = steps = 0
            while forest.feature[t][node] >= 0:
                node = int(forest.left[t][node]) + int(row[forest.feature[t][node]] >= forest.cut[t][node])
                steps += 1
            rest = forest.depth[t][node] - steps
            assert rest == pytest.approx(0.0) or rest > 0 and any(rest == pytest.approx(expected(n)) for n in range(2, 65))
            total += forest.depth[t][node]
        scores.append(2 ** (-total / 20 / expected(64)))
    assert np.allclose(forest.score(x), scores) and min(scores[300:]) > np.quantile(scores[:300], 0.99)


def test_the_threshold_is_the_best_of_all():
    r = random.Random(2)
    for loss in (0.0, 0.05, 0.5):
        counts = {(q, r.randint(1, R.BINS)): r.randint(1, 9) for q in (0, 1) for _ in range(30)}
        at, bad, good = R.calibrate(counts, loss)
        total = [sum(n for (q, _), n in counts.items() if q == k) for k in (0, 1)]
        share = lambda k, t: sum(n for (q, b), n in counts.items() if q == k and b > t) / total[k]  # noqa: E731, B023
        allowed = [t for t in range(R.BINS + 1) if share(1, t) <= loss]
        best = max(allowed, key=lambda t: (round(share(0, t) - share(1, t), 12), t))
        assert share(0, at * R.BINS) - share(1, at * R.BINS) == pytest.approx(share(0, best) - share(1, best))
        assert (bad, good) == (pytest.approx(share(0, at * R.BINS)), pytest.approx(share(1, at * R.BINS)))


def test_a_very_long_turn_comes_back_whole(spark):
    text = "".join(random.Random(1).choice(["word ", "</s>", "[INST]", "\\", "é😀", "[IN", "\n"]) for _ in range(400_000))
    turns = spark.createDataFrame([(1, 0, "user", text), (1, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    row = chat.digest(chat.format_turns(turns)).first()
    import hashlib

    assert row["loss_chars"] == len(text) and row["loss_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    assert row["turns_sha256"] == hashlib.sha256(f"user\n{text}\nassistant\n{text}\n".encode()).hexdigest()
