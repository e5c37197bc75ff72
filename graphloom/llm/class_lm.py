"""Language-model scoring with Brown classes.

Counting: one pass counts every word of the training texts. Words that make up ``1 / HOT`` of the tokens or more, and
occur ``LEAST`` times or more, are clustered: by that share they are ``HOT`` at most at any size of the corpus, however
many words it has. A second pass counts which word follows which, rarer words by the classes of their endings; the pairs
are kept in a table with a row for each word that holds the words beside it.

Exchange: the ``TOP`` most frequent words first move, one after another, to the class that raises the class bigrams'
likelihood most. Then all clustered words take part, with classes by the root of their number: in each of ``ROUNDS``
rounds half of the words are judged in Spark, each word by the classes of its neighbours, the moves are made together,
and a round that lowers the likelihood is taken back. Rarer and unseen words have one of ``SURFACES`` classes of endings.

Scoring: log10 P(class | class before) + log10 P(word | class). Transitions are smoothed towards class frequencies;
a class gives words it has not seen the share of its words seen once (Good-Turing) and splits the rest by count. Counts
of the ``HOT`` most frequent words travel with the code (a fixed bound); all other words of a text are joined with the
whole count table, so every count takes part.

Defined cases: null and empty texts consist of the end alone; texts of any length are counted and scored whole; of words
equally frequent the one that comes first in order counts as the more frequent; repeated rows are scored, and counted, one by one; a null
doc_id is the empty id when rows are dealt to training; without training rows no token is known and the base is 0; an
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import batch, map_arrow, materialize, texts_of

#: Words that are clustered first, their least classes, classes of endings, words whose counts travel, sweeps of the first exchange.
TOP, CLASSES, SURFACES, HOT, EXCHANGES = 1000, 64, 256, 200_000, 6
#: Weight of class frequencies in transitions; entries a worker counts or remembers at a time.
SMOOTH, MEMORY = 20.0, 400_000
#: Least count of clustered words, rounds in Spark, parts whose words move in turn, tokens whose pairs a worker counts at a time.
LEAST, ROUNDS, PARTS, CHAIN = 8, 4, 2, 2_000_000
_LOWER = bytes(i + 32 if 65 <= i <= 90 else i for i in range(256))
_surfaces: dict[bytes, int] = {}


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_LOWER).split()


def surface(word: bytes) -> int:
    """Class of a word's ending: its last bytes and whether punctuation follows them."""
    core = word.rstrip(b".,;:!?")
    return zlib.crc32(core[-3:] + (b"." if len(core) < len(word) else b"")) % SURFACES


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("text").cast("string").alias("text"))


def count_words(docs: DataFrame) -> DataFrame:
    """(word, n) over all texts; workers count in bounded tables before anything is shuffled."""
    out = pa.schema([("word", pa.binary()), ("n", pa.int64())])

    def run(batches):
        counts: Counter = Counter()
        for b in batches:
            for t in texts_of(b):
                counts.update(words_of(t))
            if len(counts) > MEMORY:
                yield batch(out, word=list(counts), n=list(counts.values()))
                counts = Counter()
        yield batch(out, word=list(counts), n=list(counts.values()))

    return map_arrow(_texts(docs), run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _endings(words: list[bytes]) -> list[int]:
    """Class of every word's ending."""
    if len(_surfaces) > MEMORY:
        _surfaces.clear()
    out = []
    for w in words:
        u = _surfaces.get(w)
        if u is None:
            u = _surfaces[w] = surface(w)
        out.append(u)
    return out


def count_pairs(docs: DataFrame, index: dict[bytes, int], clustered: int) -> DataFrame:
    """(a, b, n): how often unit b follows unit a.

    Unit 0 is a text's end, which also precedes its first word, 1 to ``clustered`` are the first words of ``index``, and
    the classes of endings follow.
    """
    shared = docs.sparkSession.sparkContext.broadcast(index)
    out = pa.schema([("a", pa.int32()), ("b", pa.int32()), ("n", pa.int64())])
    width = 1 + clustered + SURFACES

    def counted(chain):
        ids = np.array(chain, np.int64)
        pair, n = np.unique(ids[:-1] * width + ids[1:], return_counts=True)
        for i in range(0, len(pair), 1 << 16):
            p = pair[i : i + (1 << 16)]
            yield batch(out, a=p // width, b=p % width, n=n[i : i + (1 << 16)])

    def run(batches):
        own, memory = shared.value, {}
        chain = [0]
        for b in batches:
            for t in texts_of(b):
                words = words_of(t)
                try:
                    chain += [memory[w] for w in words]
                except KeyError:
                    for w in words:
                        if w not in memory:
                            i = own.get(w, clustered)
                            memory[w] = 1 + i if i < clustered else 1 + clustered + surface(w)
                    chain += [memory[w] for w in words]
                chain.append(0)
                if len(memory) > MEMORY:
                    memory.clear()
                if len(chain) > CHAIN:
                    yield from counted(chain)
                    chain = [0]
        yield from counted(chain)

    return map_arrow(_texts(docs), run, "a int, b int, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))


def neighbours(pairs: DataFrame, clustered: int) -> DataFrame:
    """(unit, beside): for each unit the units after it with their counts, and for clustered words those before it (n < 0).

    A row holds no more entries than twice the units, which are bounded.
    """
    entry = lambda other, n: F.struct(F.col(other).alias("other"), n.alias("n"))
    after = F.struct(F.col("a").alias("unit"), entry("b", F.col("n")).alias("beside"))
    before = F.struct(F.col("b").alias("unit"), entry("a", -F.col("n")).alias("beside"))
    both = F.when(F.col("b").between(1, clustered), F.array(after, before)).otherwise(F.array(after))
    rows = pairs.select(F.explode(both).alias("x")).select("x.unit", "x.beside")
    return rows.groupBy("unit").agg(F.collect_list("beside").alias("beside"))


def _beside(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(unit, borders, other, n) of a batch of :func:`neighbours`."""
    lists = b.column("beside")
    entries = lists.flatten()
    borders = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy())])
    return b.column("unit").to_numpy(), borders, entries.field("other").to_numpy(), entries.field("n").to_numpy()


def class_pairs(beside: DataFrame, kinds: np.ndarray) -> np.ndarray:
    """How often class j follows class i; ``kinds`` has the class of every unit."""
    size = int(kinds.max()) + 1
    shared = beside.sparkSession.sparkContext.broadcast(kinds)
    out = pa.schema([("pair", pa.int64()), ("n", pa.int64())])

    def run(batches):
        k, total = shared.value, np.zeros(size * size, np.int64)
        for b in batches:
            unit, borders, other, n = _beside(b)
            use = n > 0
            np.add.at(total, (np.repeat(k[unit], np.diff(borders)) * size + k[other])[use], n[use])
        at = np.flatnonzero(total)
        for i in range(0, len(at), 1 << 16):
            yield batch(out, pair=at[i : i + (1 << 16)], n=total[at[i : i + (1 << 16)]])

    found = map_arrow(beside, run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    matrix = np.zeros(size * size, np.int64)
    matrix[found["pair"].to_numpy()] = found["n"].to_numpy()
    return matrix.reshape(size, size)


def _f(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-12))


def likelihood(n: np.ndarray) -> float:
    """The part of the class bigrams' log likelihood that classes change."""
    x = n.astype(float)
    return float(_f(x).sum() - _f(x.sum(0)).sum() - _f(x.sum(1)).sum())


def best_class(n: np.ndarray, fn: np.ndarray, left: np.ndarray, right: np.ndarray, classes: int, a: int, kind: np.ndarray, after: np.ndarray, before: np.ndarray, own: float) -> int:
    """Best of the classes 1 to ``classes`` for one word of class ``a``, all other words staying.

    ``after`` and ``before`` say how often classes ``kind`` follow and precede it, itself left out; ``own`` how often it
    follows itself. ``n`` counts class pairs, ``left`` and ``right`` are its sums, ``fn`` is x log x of it.
    """
    choice = np.arange(1, classes + 1)
    out_w, in_w = np.zeros(len(n)), np.zeros(len(n))
    out_w[kind], in_w[kind] = after, before
    gain = np.zeros(classes)
    for m, f, mine, other in ((n, fn, out_w, in_w), (n.T, fn.T, in_w, out_w)):
        k = np.flatnonzero(mine)
        cells, old = m[1 : classes + 1, k], f[1 : classes + 1, k]
        at = np.flatnonzero(k == a)
        cells[a - 1] -= mine[k]
        if len(at):
            cells[:, at[0]] -= other[choice]
            cells[a - 1, at[0]] -= own
            old[:, at[0]] = _f(cells[:, at[0]])
        old[a - 1] = _f(cells[a - 1])
        each = _f(cells + mine[k]) - old
        inside = np.flatnonzero((k >= 1) & (k <= classes))
        each[k[inside] - 1, inside] = 0
        gain += each.sum(1)
    corner = n[choice, choice].copy()
    corner[a - 1] -= out_w[a] + in_w[a] + own
    gain += _f(corner + out_w[choice] + in_w[choice] + own) - _f(corner)
    for total, w in ((left, out_w.sum() + own), (right, in_w.sum() + own)):
        t = total[choice].copy()
        t[a - 1] -= w
        gain -= _f(t + w) - _f(t)
    b = int(np.argmax(gain))
    return b + 1 if gain[b] > gain[a - 1] + 1e-9 else a


def moves(beside: DataFrame, kinds: np.ndarray, n: np.ndarray, words: int, classes: int, part: int) -> pa.Table:
    """(unit, kind) of the words of one part that a better class was found for; there are no more than clustered words."""
    shared = beside.sparkSession.sparkContext.broadcast((kinds, n.astype(float)))
    out = pa.schema([("unit", pa.int64()), ("kind", pa.int64())])

    def judge(batches):
        own, n = shared.value
        fn, left, right = _f(n), n.sum(1), n.sum(0)
        for b in batches:
            unit, borders, other, count = _beside(b)
            units, found = [], []
            for u, s, e in zip(unit.tolist(), borders[:-1].tolist(), borders[1:].tolist(), strict=True):
                if not 1 <= u <= words or u % PARTS != part:
                    continue
                o, c = other[s:e], count[s:e]
                self_n = float(c[(o == u) & (c > 0)].sum())
                apart = o != u
                k, c = own[o[apart]], c[apart]
                after, before = (np.bincount(k[x], np.abs(c[x]), minlength=len(n)) for x in (c > 0, c < 0))
                at = np.flatnonzero(after + before)
                to = best_class(n, fn, left, right, classes, int(own[u]), at, after[at], before[at], self_n)
                if to != own[u]:
                    units.append(u)
                    found.append(to)
            yield batch(out, unit=units, kind=found)

    return map_arrow(beside.where(F.col("unit").between(1, words)), judge, "unit long, kind long").toArrow()


def cluster(beside: DataFrame, kinds: np.ndarray, words: int, classes: int, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Classes of all units after rounds of exchange over ``words`` of them, and how often class follows class."""
    n = class_pairs(beside, kinds)
    for r in range(rounds):
        found = moves(beside, kinds, n, words, classes, r % PARTS)
        after = kinds.copy()
        after[found["unit"].to_numpy()] = found["kind"].to_numpy()
        m = class_pairs(beside, after)
        if likelihood(m) > likelihood(n):
            kinds, n = after, m
    return kinds, n


def exchange(pairs: np.ndarray, words: int, classes: int = CLASSES, rounds: int = EXCHANGES) -> np.ndarray:
    """Class of every unit: 0 for the end, 1 to ``classes`` for the words (units 1 to ``words``), then the endings."""
    size = len(pairs)
    own = np.zeros(size, np.int64)
    own[1 : words + 1] = 1 + np.arange(words) % classes
    own[words + 1 :] = 1 + classes + np.arange(size - words - 1)
    many = 1 + classes + size - words - 1
    to, of = np.zeros((size, many)), np.zeros((many, size))
    np.add.at(to.T, own, pairs.T)
    np.add.at(of, own, pairs)
    n = np.zeros((many, many))
    np.add.at(n, own, to)
    fn, left, right = _f(n), n.sum(1), n.sum(0)
    for _ in range(rounds):
        moved = 0
        for w in range(1, words + 1):
            a, self_n = int(own[w]), float(pairs[w, w])
            out_w, in_w = to[w].copy(), of[:, w].copy()
            out_w[a] -= self_n
            in_w[a] -= self_n
            at = np.flatnonzero(out_w + in_w)
            b = best_class(n, fn, left, right, classes, a, at, out_w[at], in_w[at], self_n)
            if b == a:
                continue
            moved += 1
            own[w] = b
            for k, sign in ((a, -1), (b, 1)):
                n[k] += sign * out_w
                n[:, k] += sign * in_w
                n[k, k] += sign * self_n
                to[:, k] += sign * pairs[:, w]
                of[k] += sign * pairs[w]
            left, right = n.sum(1), n.sum(0)
            for k in (a, b):
                fn[k], fn[:, k] = _f(n[k]), _f(n[:, k])
        if not moved:
            break
    return own


class Model:
    """Everything of bounded size that scoring needs; counts of rarer words stay in a table."""

    def __init__(self, words: DataFrame, tokens: int, kinds: int, texts: int, hot: list[tuple[bytes, int]], hot_class: np.ndarray, first: int, n: np.ndarray, sums: dict[int, tuple[int, int]]):
        self.words, self.tokens, self.kinds, self.texts, self.first_surface = words, tokens, kinds, texts, first
        many = first + SURFACES
        freq = (n.sum(0) + 1.0) / (n.sum() + many)
        self.move = np.log10((n + SMOOTH * freq) / (n.sum(1, keepdims=True) + SMOOTH))
        self.norm = tokens + kinds + 1
        total, once = np.zeros(many), np.zeros(many)
        for k, (s, o) in sums.items():
            total[k], once[k] = s, o
        self.unseen = np.log10((once + 1) / (total + 2))
        self.seen = np.log10(np.maximum(1 - (once + 1) / (total + 2), 1e-12)) - np.log10(np.maximum(total, 1))
        self.seen[1:first] = -np.log10(np.maximum(total[1:first], 1))
        self.index = {w: i for i, (w, _) in enumerate(hot)}
        self.hot_class = np.append(hot_class, 0)
        counts = np.array([c for _, c in hot] + [texts], np.float64)
        self.hot_base = np.log10((counts + 1) / self.norm)
        self.hot_word = np.log10(np.maximum(counts, 1)) + self.seen[self.hot_class]
        self.hot_word[-1] = 0.0


def frequent(words: DataFrame) -> list[tuple[bytes, int]]:
    """At most ``HOT`` words, by falling count: all whose count lies in the highest eighths of octaves that fit."""
    eighth = F.floor(F.log2(F.col("n")) * 8)
    sizes = sorted(words.groupBy(eighth.alias("at")).count().collect(), reverse=True)
    held, least = 0, math.inf
    for at, n in sizes:
        held += n
        if held > HOT:
            break
        least = at
    if least == math.inf:
        return []
    found = words.where(eighth >= F.lit(least)).toArrow()
    return sorted(zip(found["word"].to_pylist(), found["n"].to_pylist(), strict=True), key=lambda x: (-x[1], x[0]))


def fit(docs: DataFrame, use: Column) -> Model:
    """Learn from the rows for which ``use`` holds."""
    train = docs.where(use)
    words = materialize(count_words(train), "words")
    texts = train.count()
    whole = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("kinds")).first()
    hot = frequent(words)
    least = max(LEAST, -(-whole["n"] // HOT))
    clustered = sum(n >= least for _, n in hot)
    top, classes = min(TOP, clustered), max(CLASSES, 2 * math.isqrt(clustered))
    first = 1 + classes
    index = {w: i for i, (w, _) in enumerate(hot)}
    endings = np.array([surface(w) for w, _ in hot], np.int64)
    tail = np.arange(SURFACES)
    beside = materialize(neighbours(count_pairs(train, index, clustered), clustered), "beside")
    # Each of the first words is a class of its own, all others have the classes of their endings.
    own = exchange(class_pairs(beside, np.concatenate([np.arange(1 + top), 1 + top + endings[top:clustered], 1 + top + tail])), top, CLASSES)
    kinds = np.concatenate([[0], 1 + np.arange(clustered) % classes, first + tail])
    kinds[1 : 1 + top] = own[1 : 1 + top]
    kinds, n = cluster(beside, kinds, clustered, classes, ROUNDS if clustered else 0)
    hot_class = first + endings
    hot_class[:clustered] = kinds[1 : 1 + clustered]
    words = named(words, index, hot_class, first)
    sums = words.groupBy("kind").agg(F.sum("n").alias("n"), F.count_if(F.col("n") == 1).alias("once")).collect()
    return Model(words, whole["n"] + texts, whole["kinds"] + (texts > 0), texts, hot, hot_class, first, n, {r["kind"]: (r["n"], r["once"]) for r in sums})


def named(words: DataFrame, index: dict[bytes, int], hot_class: np.ndarray, first: int) -> DataFrame:
    """(word, n, kind): the class of every word."""
    shared = words.sparkSession.sparkContext.broadcast((index, hot_class))
    out = pa.schema([("word", pa.binary()), ("n", pa.int64()), ("kind", pa.int64())])

    def run(batches):
        at, kinds = shared.value
        for b in batches:
            names = b.column("word").to_pylist()
            own = [at.get(w, -1) for w in names]
            yield batch(out, word=b.column("word"), n=b.column("n"), kind=[int(kinds[i]) if i >= 0 else first + u for i, u in zip(own, _endings(names), strict=True)])

    return materialize(map_arrow(words, run, "word binary, n long, kind long"), "named")


_PARTS = pa.schema([("row", pa.int64()), ("word", pa.binary()), ("times", pa.int64()), ("kind", pa.int32()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("known", pa.int64()), ("base", pa.float64()), ("score", pa.float64())])


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) of every row."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast({k: getattr(model, k) for k in ("index", "hot_class", "hot_base", "hot_word", "move", "first_surface", "texts")})
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def run(batches):
        m = shared.value
        index, first, end = m["index"], m["first_surface"], len(m["index"])
        known_end = int(m["texts"] > 0)
        for b in batches:
            ids = b.column("row").to_numpy()
            tokens, known, base, score, kept, names, times, own = [], [], [], [], [], [], [], []
            for text in texts_of(b):
                words = words_of(text)
                at = np.fromiter(map(index.get, words, repeat(-1)), np.int64, len(words))
                rare = np.flatnonzero(at < 0)
                kinds = m["hot_class"][at]
                counted: Counter = Counter()
                if len(rare):
                    found = [words[i] for i in rare.tolist()]
                    kinds[rare] = first + np.array(_endings(found), np.int64)
                    counted = Counter(found)
                path = np.concatenate([[0], kinds, [0]])
                hot = np.append(at[at >= 0], end)
                tokens.append(len(words) + 1)
                known.append(len(hot) - 1 + known_end)
                base.append(float(m["hot_base"][hot].sum()))
                score.append(float(m["hot_word"][hot].sum() + m["move"][path[:-1], path[1:]].sum()))
                kept.append(len(counted))
                names += counted
                times += counted.values()
                own += _endings(list(counted))
            n, rare, of = len(ids), len(names), np.repeat(ids, kept)
            # The row's number keeps its own part apart from all words.
            yield batch(_PARTS, row=ids, word=[b"\n%d" % i for i in ids.tolist()], times=np.zeros(n, np.int64), kind=np.full(n, -1, np.int32), doc_id=b.column("doc_id"), n_tokens=tokens, known=known, base=base, score=score)
            for i in range(0, rare, 1 << 16):
                j = min(rare, i + (1 << 16))
                zero = np.zeros(j - i, np.int64)
                yield batch(_PARTS, row=of[i:j], word=names[i:j], times=times[i:j], kind=first + np.array(own[i:j], np.int32), doc_id=pa.nulls(j - i, pa.int64()), n_tokens=zero, known=zero, base=zero.astype(float), score=zero.astype(float))

    parts = map_arrow(rows, run, "row long, word binary, times long, kind int, doc_id long, n_tokens long, known long, base double, score double")
    counted = parts.join(model.words.select("word", "n"), "word", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    table = lambda a: F.array(*[F.lit(float(x)) for x in a])
    at = F.col("kind")
    seen, unseen = (F.get(table(a), at) for a in (model.seen, model.unseen))
    rare = F.col("kind") >= 0
    gain = F.col("times") * F.when(F.col("n") > 0, F.log10(F.col("n").cast("double")) + seen).otherwise(unseen)
    base = F.col("times") * F.log10((F.col("n") + 1) / F.lit(float(model.norm)))
    counted = counted.select(
        "row", "doc_id", "n_tokens", F.when(rare, F.when(F.col("n") > 0, F.col("times")).otherwise(0)).otherwise(F.col("known")).alias("known"),
        F.when(rare, base).otherwise(F.col("base")).alias("base"), F.when(rare, gain).otherwise(F.col("score")).alias("score"),
    )
    summed = counted.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.sum("n_tokens").alias("n_tokens"), F.sum("known").alias("n_known"), F.sum("base").alias("base_score"), F.sum("score").alias("score"))
    return summed.select("doc_id", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")
