"""The corpus pipeline, stage by stage, against plain Python over the rows that each stage was given."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from test_groups_and_tokens import brute_groups

import corpus_pipeline
from graphloom.llm import byte_bpe, mixing, quality_classifier, quality_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def sf_dir(spark, odd_rows, tmp_path_factory):
    """Odd rows, good and bad prose with labels, near copies."""
    r = random.Random(9)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7)))
    rows = [tuple(x) for x in odd_rows]
    for i in range(100, 260):
        words = [word() for _ in range(r.randint(60, 120))]
        if i % 4 == 0:  # bad: of a few words, which only the classifier can tell
            words = [r.choice(("klm", "nop", "qrstu", "mnopq")) + r.choice("klmn") for _ in words]
        if i % 16 == 1:  # also rejected by the rules
            words = [w.upper() + "!!" if k % 2 else w for k, w in enumerate(words)]
        rows.append((i, " ".join(words), "en", f"s{i % 5}", 1, None, "x"))
    near = rows[-1][1].split()
    rows += [(300 + k, " ".join([*near[:k], "other", *near[k + 1 :]]), "en", "s1", 1, None, "x") for k in (3, 30)]
    at = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, size long, position string").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, int(i % 4 > 0 and i % 16 != 1), 0) for i in range(100, 240)] + [(None, 1, 0), (3, None, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return at


def rows_of(df):
    return [tuple(r) for r in df.collect()]


def test_every_stage(spark, sf_dir):
    docs, given = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").where("doc_id is not null and quality is not null").collect()}
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        given.append(rows_of(docs))
        docs = corpus_pipeline.materialize(stage(spark, docs, sf_dir), f"stage{k}")
        assert k == len(corpus_pipeline.STAGES) - 1 or docs.columns == columns, name
    given.append(rows_of(docs))

    stats = {r: quality_rules.text_stats(r[1] or "") for r in given[0]}
    passed = {r: m for r, m in stats.items() if m[0] >= 50 and 100 * m[4] <= 50 * m[0]}
    kept = set(given[1])
    assert kept <= set(passed) and len(given[1]) == sum(r in kept for r in given[0])
    good = [m for r, m in passed.items() if labels.get(r[0]) == 1]
    drawn = spark.createDataFrame([(r[0], *m) for r, m in passed.items() if labels.get(r[0]) == 1], quality_rules.STATS_SCHEMA)
    drawn = drawn.orderBy(F.xxhash64("doc_id", *quality_rules.STATS), "doc_id").select(*quality_rules.STATS).toPandas().to_numpy()
    forest = quality_rules.IsolationForest.fit(quality_rules.rates(drawn))
    score = lambda ms: np.minimum(np.ceil(forest.score(quality_rules.rates(np.array(ms))) * quality_rules.BINS), quality_rules.BINS).astype(int).tolist()
    counts = Counter((1, b) for b in score(good)) + Counter((0, b) for b in score([m for r, m in passed.items() if labels.get(r[0]) == 0]))
    threshold = quality_rules.calibrate(dict(counts), quality_rules.GOOD_LOSS)[0]
    assert kept == {r for r, s in zip(passed, forest.score(quality_rules.rates(np.array(list(passed.values())))), strict=True) if s <= threshold}

    learn = sorted((r for r in given[1] if labels.get(r[0]) in (0, 1)), key=lambda r: (zlib_key(r[0]), r[0]))
    weights = quality_classifier.ftrl([r[1] for r in learn], [labels[r[0]] for r in learn]).astype(np.float32)
    want = Counter(r for r in given[1] if quality_classifier.score_text(r[1], weights) >= 0.5)
    assert Counter(given[2]) == want and 0 < len(given[2]) < len(given[1])

    groups = brute_groups([(r[0], r[1]) for r in given[2]])
    assert sorted(map(str, (r[0] for r in given[3]))) == sorted({str(g) for g in groups}) and set(given[3]) <= set(given[2])

    size = lambda t: len(WORD.findall(t))
    whole, taken, sources = {r[0]: r for r in given[3]}, Counter(), Counter()
    for r in given[4]:
        assert r[2:] == whole[r[0]][2:] and whole[r[0]][1].startswith(r[1])
        taken[r[0]] += size(r[1])
        sources[r[3]] += size(r[1])
    all_sources = Counter()
    for r in given[3]:
        all_sources[r[3]] += size(r[1])
        assert taken[r[0]] <= mixing.EPOCHS * size(r[1])
    assert abs(sum(sources.values()) - mixing.BUDGET * sum(all_sources.values())) <= len(all_sources) or all(sources[s] == 2 * all_sources[s] for s in sources)

    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = byte_bpe.read_ranks(f.read())
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = Counter((r[0], *[tuple(library.encode_ordinary(r[1]))], hashlib.sha256(r[1].encode()).hexdigest()) for r in given[4])
    assert Counter((r[0], tuple(r[2]), r[3]) for r in given[5]) == want and all(r[1] == len(r[2]) for r in given[5])
    assert Counter(map(repr, rows_of(corpus_pipeline.run(spark, sf_dir)))) == Counter(map(repr, given[5]))


def zlib_key(doc_id):
    import zlib

    return zlib.crc32(str(doc_id).encode())


def test_empty_tables(spark, sf_dir, tmp_path):
    for name in ("documents", "labels"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_without_labels_only_base_rules_reject(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    spark.read.parquet(f"{sf_dir}/labels.parquet").limit(0).write.parquet(f"{tmp_path}/labels.parquet")
    kept = corpus_pipeline.rules_stage(spark, docs, str(tmp_path))
    judged = [quality_rules.text_stats(r["text"] or "") for r in docs.collect()]
    assert kept.count() == sum(m[0] >= 50 and 100 * m[4] <= 50 * m[0] for m in judged)
    assert corpus_pipeline.classifier_stage(spark, kept, str(tmp_path)).count() == kept.count()
