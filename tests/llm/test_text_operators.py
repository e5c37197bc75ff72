"""Rules, classifier, language model, fingerprints and mixing against plain Python on small, odd tables."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import class_lm, fingerprint, mixing, quality_classifier, quality_rules
from graphloom.llm.common import crc_mod

SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def test_rule_counts(docs, odd_rows, labels):
    got = quality_rules.judge_documents(docs, labels).collect()
    assert len(got) == len(odd_rows)
    want = Counter()
    for row in odd_rows:
        t = row[1] or ""
        w = SPACE.findall(t)
        grams = Counter(zip(w, w[1:], w[2:]))
        covered = {i + k for i, g in enumerate(zip(w, w[1:], w[2:])) if grams[g] > 1 for k in range(3)}
        lines = [x for x in t.split("\n") if SPACE.search(x)]
        want[row[0], len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered), len(w) < 50 or 100 * len(covered) > 50 * len(w)] += 1
    assert Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in got) == want
    assert not any(r["kept"] and r["base_failed"] for r in got)
    kept = {r["doc_id"] for r in got if r["kept"]}
    assert 10 not in kept and {20 + i for i in range(30)} & kept


def test_rules_filter_keeps_columns_and_agrees(docs, labels, empty):
    kept = quality_rules.filter_documents(docs, labels)
    assert kept.columns == docs.columns
    judged = quality_rules.judge_documents(docs, labels).where("kept")
    assert sorted(map(str, (r["doc_id"] for r in kept.collect()))) == sorted(map(str, (r["doc_id"] for r in judged.collect())))
    assert quality_rules.judge_documents(empty, labels).count() == 0
    assert quality_rules.filter_documents(docs, labels.limit(0)).count() >= kept.count()


def test_classifier(spark, docs, labels, empty):
    rows = [(i, " ".join(["good plain words here"] * 5 if i % 3 else ["BAD!! ### WORDS!!"] * 6), "s") for i in range(300)]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string")
    y = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(300)], "doc_id long, quality int, toxic int")
    w = quality_classifier.fit(table, y, crc_mod(F.col("doc_id"), 3) != 1)
    scored = {r["doc_id"]: r["score"] for r in quality_classifier.score_documents(table, w).collect()}
    assert all((scored[i] >= 0.5) == (i % 3 > 0) for i in range(300))
    assert quality_classifier.filter_documents(table, w).count() == 200
    odd = quality_classifier.score_documents(docs, w).collect()
    assert len(odd) == docs.count() and all(0 <= r["score"] <= 1 for r in odd)
    none = quality_classifier.fit(empty, labels.limit(0))
    assert {r["score"] for r in quality_classifier.score_documents(docs, none).collect()} == {0.5}
    assert quality_classifier.score_documents(empty, w).count() == 0


def test_class_model(docs, odd_rows, empty):
    use = crc_mod(F.col("doc_id"), 7) != 2
    model = class_lm.fit(docs, use)
    got = class_lm.score_documents(docs, model).collect()
    low = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
    tokens = [(r[0], [*SPACE.findall((r[1] or "").translate(low)), None]) for r in odd_rows]
    count = Counter()
    for i, w in tokens:
        if zlib.crc32(str("" if i is None else i).encode()) % 7 != 2:
            count.update(w)
    n, v = sum(count.values()), len(count)
    want = sorted((str(i), len(w), sum(count[x] > 0 for x in w), round(sum(math.log10((count[x] + 1) / (n + v + 1)) for x in w), 6)) for i, w in tokens)
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["n_known"], round(r["base_score"], 6)) for r in got) == want
    assert all(r["score"] < 0 or r["n_tokens"] == 1 for r in got)
    assert class_lm.score_documents(empty, model).count() == 0
    untrained = class_lm.score_documents(docs, class_lm.fit(empty, use)).collect()
    assert len(untrained) == len(odd_rows) and all(r["n_known"] == 0 and r["base_score"] == 0 for r in untrained)


def test_exchange_gains_likelihood():
    r = np.random.default_rng(0)
    pairs = np.zeros((21, 21), np.int64)
    for _ in range(4000):
        a = r.integers(1, 17)
        pairs[a, 1 + (a + 8 + r.integers(0, 4)) % 16] += 1

    def value(own):
        n = np.zeros((own.max() + 1,) * 2)
        np.add.at(n, (own[:, None].repeat(21, 1), own[None].repeat(21, 0)), pairs)
        f = lambda x: float((x * np.log(np.maximum(x, 1e-12))).sum())
        return f(n) - f(n.sum(0)) - f(n.sum(1))

    start, end = class_lm.exchange(pairs, 16, 4, rounds=0), class_lm.exchange(pairs, 16, 4)
    assert value(end) > value(start)


@pytest.mark.parametrize("hot", [class_lm.HOT, 100, 12])
def test_frequent_words_are_clustered_and_scored(spark, monkeypatch, hot):
    """Words beyond the first ones are exchanged; scores agree with plain Python, also of words whose counts are joined."""
    monkeypatch.setattr(class_lm, "TOP", 4)
    monkeypatch.setattr(class_lm, "CLASSES", 4)
    monkeypatch.setattr(class_lm, "HOT", hot)
    r = np.random.default_rng(1)
    rows = [(i, " ".join(f"{'ab'[j % 2]}{r.integers(20)}x{r.integers(10**6) if r.random() < 0.05 else ''}" for j in range(40)), None) for i in range(200)]
    docs = spark.createDataFrame([*rows, (None, None, None)], "doc_id long, text string, source string")
    use = F.coalesce(F.col("doc_id"), F.lit(0)) < 180
    model = class_lm.fit(docs, use)
    kinds = {bytes(w["word"]): w["kind"] for w in model.words.collect()}
    counts = Counter(w for i, text, _ in rows[:180] for w in class_lm.words_of(text))
    assert {bytes(w["word"]): w["n"] for w in model.words.collect()} == counts
    least = max(class_lm.LEAST, -(-sum(counts.values()) // hot))
    often = {w for w, n in counts.items() if n >= least}
    assert len(often) <= hot and all((0 < kinds[w] < model.first_surface) == (w in often) for w in counts)
    monkeypatch.setattr(class_lm, "ROUNDS", 0)
    first = {bytes(w["word"]): w["kind"] for w in class_lm.fit(docs, use).words.collect()}
    paths = [[0, *(class_lm.words_of(t or "")), 0] for _, t in [(i, t) for i, t, _ in rows[:180]] + [(None, None)]]

    def table(kinds):
        n = np.zeros((model.first_surface + class_lm.SURFACES,) * 2)
        for path in paths:
            k = [kinds[w] if w else 0 for w in path]
            np.add.at(n, (k[:-1], k[1:]), 1)
        return n

    n = table(kinds)
    assert class_lm.likelihood(n) > class_lm.likelihood(table(first)) or len(often) < 2
    freq = (n.sum(0) + 1) / (n.sum() + len(n))
    move = (n + class_lm.SMOOTH * freq) / (n.sum(1, keepdims=True) + class_lm.SMOOTH)
    total, once = Counter(), Counter()
    for w, c in counts.items():
        total[kinds[w]] += c
        once[kinds[w]] += c == 1

    def chance(w):
        k = kinds.get(w, model.first_surface + class_lm.surface(w))
        if k < model.first_surface:
            return counts[w] / total[k]
        unseen = (once[k] + 1) / (total[k] + 2)
        return (1 - unseen) * counts[w] / total[k] if counts[w] else unseen

    got = {x["doc_id"]: x["score"] for x in class_lm.score_documents(docs, model).collect()}
    for i, text, _ in [*rows, (None, "", None)]:
        words = class_lm.words_of(text)
        path = [0, *(kinds.get(w, model.first_surface + class_lm.surface(w)) for w in words), 0]
        want = sum(math.log10(move[x, y]) for x, y in zip(path, path[1:], strict=False)) + sum(math.log10(chance(w)) for w in words)
        assert got[i] == pytest.approx(want)


def test_best_class_is_the_best_by_full_counts():
    r = np.random.default_rng(4)
    pairs, own = r.integers(0, 5, (9, 9)), np.array([0, 1, 2, 3, 1, 2, 3, 4, 5])
    def table(own):
        n = np.zeros((6, 6))
        np.add.at(n, (own[:, None].repeat(9, 1), own[None].repeat(9, 0)), pairs)
        return n
    for w in range(1, 7):
        n = table(own)
        rest = np.arange(9) != w
        after, before = (np.bincount(own[rest], x[rest], minlength=6) for x in (pairs[w], pairs[:, w]))
        got = class_lm.best_class(n, class_lm._f(n), n.sum(1), n.sum(0), 3, own[w], np.arange(6), after, before, float(pairs[w, w]))
        values = []
        for k in (1, 2, 3):
            moved = own.copy()
            moved[w] = k
            values.append(class_lm.likelihood(table(moved)))
        assert values[got - 1] == pytest.approx(max(values))


def test_fingerprints(docs, odd_rows, empty):
    rows = sorted(((r[0] is not None, r[0] or 0, r[1] or "") for r in odd_rows), key=lambda x: x[:2])
    got = fingerprint.fingerprint_documents(docs)
    alone = {(g["doc_id"], g["fingerprint"]): (g["near"], g["near_edited"]) for g in fingerprint.compare(got, "fingerprint", "edited_fingerprint", "near").collect()}
    got = got.collect()
    assert len(got) == len(rows)
    word, ends, most = re.compile("[^ \t-\r]+"), tuple(fingerprint.ENDS), fingerprint.PARAGRAPH_WORDS

    def pieces(text):
        found = set()
        for line in re.split("[\n\x0b\x0c\r]", text):
            start = None
            for k, m in enumerate(word.finditer(line)):
                if start is None:
                    start, count = m.start(), 0
                count += 1
                if m[0].endswith(ends) or count == most:
                    found.add(line[start : m.end()])
                    start = None
                end = m.end()
            if start is not None:
                found.add(line[start:end])
        return found

    like = lambda a, b: 1 - len(pieces(a) ^ pieces(b)) / (len(pieces(a)) + len(pieces(b))) if pieces(a) or pieces(b) else 1.0
    by_id = defaultdict(list)
    for g in got:
        by_id[g["doc_id"]].append(g)
    for (known, i, t), (_, _, following) in zip(rows, rows[1:] + rows[:1], strict=True):
        if i == 8 and known:
            continue  # two rows: each other's neighbours
        (g,) = by_id[i if known else None]
        k = len(t) // 4
        edited = t[: len(t) - k] + following[:k]
        assert g["n_chars"] == len(t) and g["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert g["near_edited"] == pytest.approx(like(t, edited)) and g["near_next"] == pytest.approx(like(t, following))
        groups = g["fingerprint"].split(";")
        assert len(groups) == 1 << max(0, math.ceil(math.log2(max(len(pieces(t)) / fingerprint.SHARE, 1)))) and all(x.count(",") == 17 for x in groups)
    assert len({g["fingerprint"] for g in by_id[8]}) == 1 and by_id[8][0]["fingerprint"] == by_id[0][0]["fingerprint"]
    assert all(a is None or a == pytest.approx(b) for a, b in alone.values()) and sum(a is not None for a, _ in alone.values()) > len(alone) / 2
    assert fingerprint.fingerprint_documents(empty).count() == 0
    assert fingerprint.fingerprint_documents(docs.where("doc_id = 5")).first()["near_next"] == 1.0


@pytest.mark.parametrize("ids", [[None] * 60, [7] * 60, [None] * 25 + [3] * 25 + list(range(10))])
def test_next_rows_of_crowded_ids(spark, ids):
    """Ids that hold more rows than a range are split by text hash, and every row still finds its successor."""
    rows = [(i, f"text {k}") for k, i in enumerate(ids)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    hashed = {r["text"]: r["h"] for r in docs.select("text", F.xxhash64("text").alias("h")).collect()}
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, hashed[r[1]]))
    want = {(a, t): following for (a, t), (_, following) in zip(order, order[1:] + order[:1], strict=True)}
    found = fingerprint.with_next(docs)
    assert {(r["doc_id"], r["text"]): r["next"] for r in found.collect()} == want and found.count() == len(rows)
    borders = fingerprint._borders(docs.select("*", F.col("doc_id").isNotNull().alias("known"), F.coalesce("doc_id", F.lit(0)).alias("id"), F.xxhash64("text").alias("hash")), 12)
    assert len(borders) >= 10 and borders == sorted(set(borders))


def test_mixing(docs, odd_rows, empty):
    got = mixing.plan_mix(docs).collect()
    size = Counter()
    for r in odd_rows:
        size[r[3]] += len(SPACE.findall(r[1] or ""))
    order = sorted((s for s in size if s is not None)) + [None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target, stopped = {}, set()
    while True:
        left = 1.5 * sum(size.values()) - sum(2 * size[s] for s in stopped)
        level = left / sum(weight[s] for s in order if s not in stopped)
        target = {s: 2.0 * size[s] if s in stopped else level * weight[s] for s in order}
        new = {s for s in order if target[s] > 2 * size[s]}
        if not new:
            break
        stopped |= new
    taken = Counter()
    for g in got:
        assert g["target"] == pytest.approx(target[g["source"]]) and g["source_size"] == size[g["source"]]
        words = sum(d["words"] for d in g["draws"])
        assert words <= 2 * g["size"] and all(0 <= d["position"] <= 1 for d in g["draws"])
        taken[g["source"]] += words
    assert all(abs(taken[s] - target[s]) <= 1 for s in order)
    mixed = mixing.mix_documents(docs)
    assert mixed.columns == docs.columns
    assert sum(len(SPACE.findall(r["text"])) for r in mixed.collect()) == sum(taken.values())
    assert mixing.plan_mix(empty).count() == 0 and mixing.mix_documents(empty).count() == 0


def test_the_mixing_query_counts_the_mix_itself(spark, docs, odd_rows, tmp_path, monkeypatch):
    """Its words are those of the mix's texts (F33): with the mix's texts doubled they would double too. Repeated rows keep a row each."""
    from graphloom.llm import queries

    docs.write.parquet(f"{tmp_path}/documents.parquet")
    want = sorted((r["doc_id"] or -1, r["size"], sum(d["words"] for d in r["draws"]), r["draws"][0]["position"] if r["draws"] else -1) for r in mixing.plan_mix(docs).collect())
    read = lambda: sorted((r["doc_id"] or -1, r["size"], r["taken"], -1 if r["first_position"] is None else r["first_position"]) for r in queries.op3_mixing(spark, str(tmp_path)).collect())
    got = read()
    assert len(got) == len(odd_rows) and all(g[:3] == w[:3] and g[3] == pytest.approx(w[3], abs=1e-6) for g, w in zip(got, want, strict=True))
    mix = mixing.mix_documents
    monkeypatch.setattr(mixing, "mix_documents", lambda *a: mix(*a).withColumn("text", F.concat_ws(" ", "text", "text")))
    assert [g[2] for g in read()] == [2 * g[2] for g in got]


def test_word_shape_takes_the_whole_word():
    assert quality_classifier._shape(b"a" * 64 + b"7") == b"xd" and quality_classifier._shape(b"aB" * 40 + b"!!") == b"xX" * 40 + b"!"
