"""Quality rules: an isolation forest over rule statistics of documents.

Every document gets counts (words, symbols, repeated lines, repeated 3-word windows). Two fixed base rules reject short
and repetitive texts; an isolation forest over rates made from the counts gives every other document an anomaly score,
and the score's threshold is calibrated on all labelled rows.

Defined cases: a null or empty text has zero counts and fails the base rules; repeated rows are judged one by one;
an empty table gives an empty result; without labels of good documents nothing is rejected beyond the base rules;
label rows with a null quality are ignored, and those other than 0 and 1 play no part in the threshold; texts of any
length are read whole; extra columns of the input, whatever their names, pass through :func:`filter_documents`.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import batch, draw, map_arrow, materialize, texts_of

STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_marks", "n_digits", "n_bytes")
STATS_SCHEMA = "doc_id long, " + ", ".join(f"{c} long" for c in STATS)
#: Fixed values of the base rules.
SYMBOLS, MARKS, DIGITS = b"#*$%&|<>", b"!?=+~^@_", b"0123456789"
UPPER = bytes(range(65, 91))
MIN_WORDS, REPEAT_PERCENT = 50, 50
#: Forest parameters: trees, rows a tree sees, labelled rows the forest may draw from, share of good rows it may reject.
TREES, TREE_ROWS, FIT_ROWS, GOOD_LOSS = 128, 256, 16384, 0.002
BINS = 4096
#: By how much splits may lie outside the sample, for each column of :func:`rates`.
MARGINS = (2.0, 0.3, 0.2, 0.1, 0.1, 0.2, 0.1)


def repeat_words(words: list[bytes]) -> int:
    """Words inside a 3-word window that occurs at least twice, the first occurrence included."""
    n = len(words)
    if n < 4:
        return 0
    h = np.fromiter(map(hash, words), np.int64, n).view(np.uint64)
    key = (h[:-2] * np.uint64(0x9E3779B97F4A7C15) + h[1:-1]) * np.uint64(0xC2B2AE3D27D4EB4F) + h[2:]
    order = np.argsort(key, kind="stable")
    s = key[order]
    same = s[1:] == s[:-1]
    if not same.any():
        return 0
    twice = np.zeros(n - 2, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[k : n - 2 + k] |= twice
    return int(covered.sum())


def text_stats(text: str) -> tuple[int, ...]:
    """The counts named in :data:`STATS` of one whole text."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    white = sum(map(raw.count, (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r")))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    size = len(raw)
    gone = lambda chars: size - len(raw.translate(None, chars))
    return (len(words), len(text) - white, gone(SYMBOLS), len(lines) - len(set(lines)), repeat_words(words), gone(UPPER), gone(MARKS), gone(DIGITS), size - white)


def _stats_batches(batches):
    schema = pa.schema([("doc_id", pa.int64())] + [(c, pa.int64()) for c in STATS])
    for b in batches:
        rows = [text_stats(t) for t in texts_of(b)]
        yield batch(schema, doc_id=b.column("doc_id"), **{c: [r[i] for r in rows] for i, c in enumerate(STATS)})


def rule_statistics(docs: DataFrame) -> DataFrame:
    """One row of counts per document row."""
    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), _stats_batches, STATS_SCHEMA)


def rates(m: np.ndarray) -> np.ndarray:
    """Forest features (columns) from an array with the columns of :data:`STATS`."""
    words, chars, symbols, dup, repeat, upper, marks, digits, size = m.T.astype(np.float64)
    chars1, words1, size1 = np.maximum(chars, 1), np.maximum(words, 1), np.maximum(size, 1)
    return np.stack([chars / words1, symbols / words1, dup / words1 * 10, repeat / words1, upper / size1, marks / words1, digits / chars1], 1)


class IsolationForest:
    """Random axis-parallel splits over row samples; a short mean path marks an anomaly.

    A node's split is drawn from its rows' range widened on both sides by the feature's margin, so that rows beyond all
    that the sample holds end in an empty leaf early even where the sample does not vary in that feature.
    """

    def __init__(self, feature: np.ndarray, cut: np.ndarray, left: np.ndarray, depth: np.ndarray, rows: int):
        self.feature, self.cut, self.left, self.depth, self.rows = feature, cut, left, depth, rows

    @staticmethod
    def _expected(n: float) -> float:
        return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n

    @classmethod
    def fit(cls, x: np.ndarray, seed: int = 7, trees: int = TREES, tree_rows: int = TREE_ROWS) -> IsolationForest:
        rng = np.random.default_rng(seed)
        rows = max(2, min(tree_rows, len(x)))
        limit = int(np.ceil(np.log2(rows))) + 2
        width = 2 ** (limit + 1) + 1
        feature = np.full((trees, width), -1, np.int32)
        cut, depth, left = np.zeros((trees, width)), np.zeros((trees, width)), np.zeros((trees, width), np.int32)
        for t in range(trees):
            pick = x[rng.choice(len(x), rows, replace=len(x) < rows)]
            used, todo = 1, [(0, pick, 0)]
            while todo:
                node, part, d = todo.pop()
                if d >= limit or len(part) == 0:
                    depth[t, node] = d + cls._expected(len(part))
                    continue
                f = int(rng.integers(x.shape[1]))
                c = rng.uniform(part[:, f].min() - MARGINS[f], part[:, f].max() + MARGINS[f])
                low = part[:, f] < c
                feature[t, node], cut[t, node], left[t, node] = f, c, used
                todo += [(used, part[low], d + 1), (used + 1, part[~low], d + 1)]
                used += 2
        return cls(feature, cut, left, depth, rows)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Anomaly score in (0, 1): 2 to the power of minus the mean path over the expected path."""
        if len(x) == 0:
            return np.zeros(0)
        total, at = np.zeros(len(x)), np.arange(len(x))
        for t in range(len(self.feature)):
            node = np.zeros(len(x), np.int32)
            while True:
                f = self.feature[t, node]
                inner = f >= 0
                if not inner.any():
                    break
                right = x[at, np.maximum(f, 0)] >= self.cut[t, node]
                node = np.where(inner, self.left[t, node] + right, node)
            total += self.depth[t, node]
        return np.exp2(-total / len(self.feature) / max(self._expected(self.rows), 1e-9))


def base_failed(words: np.ndarray, repeat: np.ndarray) -> np.ndarray:
    return (words < MIN_WORDS) | (100 * repeat > REPEAT_PERCENT * words)


class Rules:
    """A fitted forest, its threshold and the shares of bad and good labelled rows above it; ``forest`` is None where no good document was labelled."""

    def __init__(self, forest: IsolationForest | None, threshold: float, bad_rejected: float = 0.0, good_rejected: float = 0.0):
        self.forest, self.threshold, self.bad_rejected, self.good_rejected = forest, threshold, bad_rejected, good_rejected

    def verdict(self, m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(base_failed, anomaly score, kept) of rows with the columns of :data:`STATS`."""
        failed = base_failed(m[:, 0], m[:, 4])
        score = self.forest.score(rates(m)) if self.forest else np.zeros(len(m))
        return failed, score, ~failed & (score <= self.threshold)


def fit_rules(stats: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, good_loss: float = GOOD_LOSS) -> Rules:
    """Fit the forest on at most ``fit_rows`` labelled good rows; calibrate the threshold on all labelled rows.

    Rows that the base rules reject play no part. Scores of all labelled rows, good and bad, are counted on a grid of
    :data:`BINS` steps, from which :func:`calibrate` takes the threshold.
    """
    quality = labels.where(F.col("quality").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"))
    judged = stats.join(quality, "doc_id").where((F.col("n_words") >= MIN_WORDS) & (100 * F.col("n_repeat_words") <= REPEAT_PERCENT * F.col("n_words")))
    judged = materialize(judged.select("doc_id", "quality", *STATS), "rules-labelled")
    good = judged.where("quality = 1")
    drawn = draw(good, ["doc_id", *STATS], fit_rows).select(*STATS).toPandas()
    if drawn.empty:
        return Rules(None, np.inf)
    forest = IsolationForest.fit(rates(drawn.to_numpy()))

    def binned(batches):
        for b in batches:
            m = np.stack([b.column(c).to_numpy(zero_copy_only=False) for c in STATS], 1)
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(np.ceil(forest.score(rates(m)) * BINS), BINS).astype(np.int64)), b.column("quality")], names=["bin", "quality"])

    counts = map_arrow(judged.where("quality in (0, 1)").select(F.col("quality").cast("int").alias("quality"), *STATS), binned, "bin long, quality int").groupBy("bin", "quality").count().collect()
    return Rules(forest, *calibrate({(r["quality"], r["bin"]): r["count"] for r in counts}, good_loss))


def calibrate(counts: dict[tuple[int, int], int], good_loss: float) -> tuple[float, float, float]:
    """(threshold, share of bad rows above, share of good rows above) from counts of (quality, bin).

    Of the thresholds above which at most ``good_loss`` of the good rows lie, it is the one with the largest share of
    bad rows above it less that of good rows, of several the highest; without bad rows it is the lowest.
    """
    above = np.zeros((2, BINS + 2))
    for (quality, at), n in counts.items():
        above[quality, at] += n
    above = above[:, ::-1].cumsum(1)[:, ::-1]
    bad, good = (x[1:] / max(x[0], 1) for x in above)
    allowed = np.flatnonzero(good <= good_loss)
    best = allowed[0] if not above[0, 0] else max(allowed, key=lambda t: (bad[t] - good[t], t))
    return best / BINS, float(bad[best]), float(good[best])


def apply_rules(stats: DataFrame, rules: Rules) -> DataFrame:
    """Counts plus base_failed, anomaly and kept."""
    out = pa.schema([("doc_id", pa.int64())] + [(c, pa.int64()) for c in STATS] + [("base_failed", pa.bool_()), ("anomaly", pa.float64()), ("kept", pa.bool_())])

    def judge(batches):
        for b in batches:
            m = np.stack([b.column(c).to_numpy(zero_copy_only=False) for c in STATS], 1)
            failed, score, kept = rules.verdict(m)
            yield batch(out, **{c: b.column(c) for c in ("doc_id", *STATS)}, base_failed=failed, anomaly=score, kept=kept)

    return map_arrow(stats.select("doc_id", *STATS), judge, STATS_SCHEMA + ", base_failed boolean, anomaly double, kept boolean")


def judge_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Counts and verdict of every document row; the texts are read once."""
    stats = materialize(rule_statistics(docs), "rules-stats")
    return apply_rules(stats, fit_rules(stats, labels))


def filter_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The document rows that the rules keep, with all their columns; no text is shuffled."""
    rules = fit_rules(materialize(rule_statistics(docs), "rules-stats"), labels)

    def keep(batches):
        for b in batches:
            m = np.array([text_stats(t) for t in texts_of(b)], np.int64).reshape(-1, len(STATS))
            yield b.filter(pa.array(rules.verdict(m)[2]))

    return map_arrow(docs, keep, docs.schema)
