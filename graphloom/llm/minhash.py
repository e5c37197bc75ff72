"""Near-duplicate groups by b-bit MinHash over word shingles.

1. Each text becomes its set of hashed 5-word shingles, ``BANDS * ROWS`` minima of it, band keys made from whole minima,
   and a signature of the minima's low ``BITS`` bits, packed.
2. Rows with the same set form a class; only one row of a class goes on.
3. Classes that share a band key are candidates. A bucket is never expanded into pairs: each member is paired with the
   bucket's centre, the member whose buckets hold the most members in all. Similarity is estimated by counting equal low
   bits, corrected for collisions; each member's likeliest partner is confirmed on the whole sets, then the other likely
   partners from whom it is still apart, and confirmed links are merged into components.
4. Buckets that still hold several components are settled without loss: members outside the bucket's largest component
   are held against all its members in blocks, by wider packed signatures. Of the partners whose estimate passes, a member's
   likeliest ``TRIES[0]`` are confirmed on whole sets, then, for members still apart, the next, until none is left. A
   pair is looked at only in the first bucket that it shares, by whole band keys.

Components come from min-label propagation with pointer jumping over DataFrames. With 32 bands of 4 rows a pair at
similarity 0.75 shares no bucket with probability 5e-6; the estimate's cut lies 4 standard deviations below 0.75.

Defined cases: a null, empty or blank text has the empty set, links with nothing and is its own group; texts of fewer
than five words have one shingle, the whole sequence; rows, not ids, are grouped, so a doc_id that occurs with two
texts can be in two groups, and of rows equal in id and text :func:`drop_duplicates` keeps the one whose columns have
the lowest hash; texts of any length are read whole; an empty table gives an
empty result; extra columns pass through :func:`drop_duplicates`; a row without doc_id takes part, never names a group
that has another id, and its component_id is null if its group has none.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import batch, map_arrow, materialize, shuffle_partitions, texts_of

#: Shingle length, bands, rows of a band, bits kept of a minimum; the similarity as a fraction; the estimate's cut.
WORDS, BANDS, ROWS, BITS = 5, 32, 4, 8
NUMERATOR, DENOMINATOR = 75, 100
ESTIMATE = 0.6
#: Partners of a member that are confirmed in each round of step 4; the last round takes all.
TRIES = (1, 16, 1 << 40)
#: Minima of the wide signature of step 4 and its cut, again 4 standard deviations below 0.75.
WIDE, WIDE_ESTIMATE = 512, 0.67
#: Bits of the filter that keeps texts without candidates from being moved: its size is fixed.
FILTER_BITS = 1 << 23
#: Members of a bucket that one task compares with at a time; words a worker remembers; shingles hashed at a time.
BLOCK, MEMORY, STEP = 1024, 400_000, 8192
_memory: dict[bytes, int] = {}
_LOWER = bytes(i + 32 if 65 <= i <= 90 else i for i in range(256))
_rng = np.random.default_rng(20240229)
_MUL = (_rng.integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
_ADD = _rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)
_WIDE_MUL = (_rng.integers(1, 1 << 63, WIDE, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
_WIDE_ADD = _rng.integers(0, 1 << 63, WIDE, dtype=np.uint64)
_BAND = (_rng.integers(1, 1 << 63, (BANDS, ROWS), dtype=np.uint64) << np.uint64(1)) | np.uint64(1)


def _word(w: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(w, digest_size=8).digest(), "little")


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(text: str) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a whole text's shingles."""
    words = text.encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    memory = _memory
    if len(memory) > MEMORY:
        memory.clear()
    try:
        codes = [memory[w] for w in words]
    except KeyError:
        for w in words:
            if w not in memory:
                memory[w] = _word(w)
        codes = [memory[w] for w in words]
    h = np.array(codes, np.uint64)
    k = min(WORDS, len(h))
    out = np.full(len(h) - k + 1, 0x632BE59BD9B4E019 + k, np.uint64)
    for i in range(k):
        out = _mix(out + h[i : len(h) - k + 1 + i])
    return np.unique(out)


def minima(s: np.ndarray, mul: np.ndarray = _MUL, add: np.ndarray = _ADD) -> np.ndarray:
    """32-bit minima of every hash function; memory stays bounded for any number of shingles."""
    low = np.full(len(mul), 0xFFFFFFFF, np.uint32)
    for i in range(0, len(s), STEP):
        for j in range(0, len(mul), 32):
            h = (s[i : i + STEP, None] * mul[None, j : j + 32] + add[None, j : j + 32]) >> np.uint64(32)
            low[j : j + 32] = np.minimum(low[j : j + 32], h.min(0).astype(np.uint32))
    return low


def band_keys(low: np.ndarray) -> np.ndarray:
    """One key a band, from whole minima; the band's number is part of the key."""
    h = (low.reshape(BANDS, ROWS).astype(np.uint64) * _BAND).sum(1, dtype=np.uint64)
    return _mix(h + np.arange(BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Similarity from packed signatures (the last axis), corrected for the chance that low bits agree."""
    same = (a == b).mean(-1)
    chance = 2.0**-BITS
    return (same - chance) / (1 - chance)


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two whole sets are similar enough."""
    if len(a) == 0 or len(b) == 0:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return DENOMINATOR * both >= NUMERATOR * (len(a) + len(b) - both)


_SIGNED = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("n_shingles", pa.int64()), ("node", pa.int64()), ("node2", pa.int64()), ("signature", pa.binary()), ("bands", pa.list_(pa.int64()))])


def _sign(batches):
    for b in batches:
        n, node, node2, signatures, bands = [], [], [], [], []
        for t in texts_of(b):
            s = shingles(t)
            n.append(len(s))
            if len(s) == 0:
                for x in (node, node2, signatures, bands):
                    x.append(None)
                continue
            key = np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), np.int64)
            low = minima(s)
            node.append(int(key[0]))
            node2.append(int(key[1]))
            signatures.append((low & np.uint32((1 << BITS) - 1)).astype(np.uint8).tobytes())
            bands.append(band_keys(low))
        yield batch(_SIGNED, doc_id=b.column("doc_id"), text_key=b.column("text_key"), n_shingles=n, node=node, node2=node2, signature=signatures, bands=bands)


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_key"))


def signatures(docs: DataFrame) -> DataFrame:
    """Set size, 128-bit set key (node, node2), packed signature and band keys of every row; null where the set is empty."""
    return map_arrow(_keyed(docs), _sign, "doc_id long, text_key long, n_shingles long, node long, node2 long, signature binary, bands array<long>")


def components(links: DataFrame) -> DataFrame:
    """(node, component) with the smallest node of each connected component of ``links`` (a, b); other nodes are left out.

    Each round gives every node the smallest label among itself and its neighbours, then jumps to that label's label,
    so the rounds grow with the logarithm of the longest path. Nothing is collected.
    """
    edges = materialize(links.select("a", "b").union(links.select("b", "a")).distinct(), "links")
    label = edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low"))
    label = materialize(label.select("node", F.least("node", "low").alias("component")), "labels")
    while True:
        near = edges.join(label.select(F.col("node").alias("b"), "component"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        step = label.join(near, "node").select("node", F.col("component").alias("old"), F.least("component", "near").alias("at"))
        jump = label.select(F.col("node").alias("at"), F.col("component").alias("far"))
        step = materialize(step.join(jump, "at").select("node", "old", F.least("at", "far").alias("component")), "labels")
        label = step.select("node", "component")
        if step.where("old != component").isEmpty():
            return label


def _merge(label: DataFrame | None, links: DataFrame) -> DataFrame | None:
    """Labels after further links: only the links between different components are walked."""
    if label is None:
        return None if links.isEmpty() else components(links)
    new = _apart(links, label).select(F.col("at_a").alias("a"), F.col("at_b").alias("b")).distinct()
    if new.isEmpty():
        return label
    over = components(new).select(F.col("node").alias("component"), F.col("component").alias("top"))
    known = links.select(F.col("a").alias("node")).union(links.select("b")).distinct().join(label, "node", "left_anti")
    every = label.unionByName(known.select("node", F.col("node").alias("component")))
    return materialize(every.join(over, "component", "left").select("node", F.coalesce("top", "component").alias("component")), "labels")


def _apart(pairs: DataFrame, label: DataFrame | None) -> DataFrame:
    """Pairs whose members lie in different components (at_a, at_b)."""
    if label is None:
        return pairs.withColumn("at_a", F.col("a")).withColumn("at_b", F.col("b"))
    for n in ("a", "b"):
        own = label.select(F.col("node").alias(n), F.col("component").alias(f"at_{n}"))
        pairs = pairs.join(own, n, "left").withColumn(f"at_{n}", F.coalesce(f"at_{n}", n))
    return pairs.where("at_a != at_b")


def _estimated(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """(a, b, likeness) of the pairs whose estimate passes."""
    for n in ("a", "b"):
        pairs = pairs.join(classes.select(F.col("node").alias(n), F.col("signature").alias(f"signature_{n}")), n)
    out = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("likeness", pa.float64())])

    def run(batches):
        for x in batches:
            if x.num_rows:
                s = [np.frombuffer(b"".join(x.column(c).to_pylist()), np.uint8).reshape(x.num_rows, -1) for c in ("signature_a", "signature_b")]
                e = estimate(*s)
                yield batch(out, a=x.column("a"), b=x.column("b"), likeness=e).filter(pa.array(e >= ESTIMATE))

    return map_arrow(pairs.select("a", "b", "signature_a", "signature_b"), run, "a long, b long, likeness double")


def confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar enough; ``texts`` (node, text) holds the candidates only."""
    both = pairs.select("a", "b")
    for n in ("a", "b"):
        both = both.join(texts.select(F.col("node").alias(n), F.col("text").alias(f"text_{n}")), n)
    out = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        for x in batches:
            keep = [linked(shingles(s), shingles(t)) for s, t in zip(texts_of(x, "text_a"), texts_of(x, "text_b"), strict=True)]
            yield batch(out, a=x.column("a"), b=x.column("b")).filter(pa.array(keep, pa.bool_()))

    return map_arrow(both.select("a", "b", "text_a", "text_b"), run, "a long, b long")


_PAIRS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _block_pairs(tries: int):
    """Pairs across components of each (key, block) group, whose rows come one after another, queries first."""

    def settle(t: pa.Table) -> pa.RecordBatch:
        key = t.column("key").to_numpy() ^ (t.column("block").to_numpy().astype(np.int64) * np.int64(0x5851F42D4C957F2D))
        starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        node, comp, band = (t.column(c).to_numpy() for c in ("node", "component", "band"))
        query = t.column("query").to_numpy(zero_copy_only=False)
        bands = t.column("bands").combine_chunks().flatten().to_numpy().reshape(t.num_rows, -1)
        wide = np.frombuffer(b"".join(t.column("wide").to_pylist()), np.uint8).reshape(t.num_rows, -1)
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for s, e in zip(starts, np.append(starts[1:], t.num_rows), strict=True):
            m = s + int(np.count_nonzero(query[s:e]))
            for q in range(s, m):
                apart = m + np.flatnonzero(comp[m:e] != comp[q])
                if band[q]:
                    apart = apart[~(bands[apart, : band[q]] == bands[q, : band[q]]).any(1)]
                like = estimate(wide[apart], wide[q])
                hit = np.flatnonzero(like >= WIDE_ESTIMATE)
                if len(hit) > tries:
                    hit = hit[np.lexsort((node[apart[hit]], -like[hit]))[:tries]]
                other = node[apart[hit]]
                a.append(np.minimum(other, node[q]))
                b.append(np.maximum(other, node[q]))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in (a, b)], schema=_PAIRS)

    def run(batches):
        held: list[pa.RecordBatch] = []
        for x in batches:
            if x.num_rows == 0:
                continue
            key, block = x.column("key").to_numpy(), x.column("block").to_numpy()
            last = (key[-1], block[-1])
            other = np.flatnonzero((key != last[0]) | (block != last[1]))
            cut = int(other[-1]) + 1 if len(other) else 0
            if cut == 0 and held and (held[-1].column("key")[-1].as_py(), held[-1].column("block")[-1].as_py()) != last:
                yield settle(pa.Table.from_batches(held).combine_chunks())
                held = []
            if cut:
                yield settle(pa.Table.from_batches([*held, x.slice(0, cut)]).combine_chunks())
                held = []
            held.append(x.slice(cut))
        if held:
            yield settle(pa.Table.from_batches(held).combine_chunks())

    return run


def _mixed(shared: DataFrame, label: DataFrame | None) -> DataFrame:
    """(key, band, node, component, main, blocks, rounds): members of buckets of three or more that hold several components."""
    rows = shared.where("n > 2").select("key", "band", "node")
    rows = rows.withColumn("component", F.col("node")) if label is None else rows.join(label, "node", "left").withColumn("component", F.coalesce("component", "node"))
    shares = rows.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"))
    mixed = shares.groupBy("key").agg(F.max(F.struct("n", "component")).alias("top"), F.count(F.lit(1)).alias("kinds"), F.sum("n").alias("n"))
    mixed = mixed.where("kinds > 1").select("key", F.col("top.component").alias("main"), F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"), F.ceil((F.col("n") - F.col("top.n")) / BLOCK).cast("int").alias("rounds"))
    return rows.join(mixed, "key")


def _wide(nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """(node, wide): a signature of more minima, for members that step 4 compares."""
    out = pa.schema([("node", pa.int64()), ("wide", pa.binary())])

    def run(batches):
        for b in batches:
            wide = [minima(shingles(t), _WIDE_MUL, _WIDE_ADD).astype(np.uint8).tobytes() for t in texts_of(b)]
            yield batch(out, node=b.column("node"), wide=wide)

    return map_arrow(texts.join(nodes, "node").select("node", "text"), run, "node long, wide binary")


def _residual(shared: DataFrame, label: DataFrame | None, signed: DataFrame, tries: int) -> DataFrame:
    """Candidate pairs (a, b) across components inside buckets, at most ``tries`` for a member and block."""
    spark = shared.sparkSession
    rows = _mixed(shared, label).join(signed, "node")
    cols = ["key", "band", "node", "component", "bands", "wide"]
    # Members and those that are held against them are both dealt into blocks, so a group has about 2 * BLOCK rows at most.
    block, turn = F.pmod(F.xxhash64("node"), F.col("blocks")), F.pmod(F.xxhash64("node", F.lit(1)), F.col("rounds"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    dealt = rows.select(*cols, F.lit(False).alias("query"), "blocks", block.cast("int").alias("own"), every("rounds").alias("turn"))
    asked = rows.where("component != main").select(*cols, F.lit(True).alias("query"), "blocks", turn.cast("int").alias("turn"), every("blocks").alias("own"))
    dealt, asked = (x.withColumn("block", F.col("turn") * F.col("blocks") + F.col("own")).drop("turn", "own", "blocks") for x in (dealt, asked))
    both = dealt.unionByName(asked).repartition(shuffle_partitions(spark), "key", "block").sortWithinPartitions("key", "block", F.desc("query"))
    return map_arrow(both.select("key", "block", "query", "band", "node", "component", "bands", "wide"), _block_pairs(tries), "a long, b long").distinct()


def _candidates(docs: DataFrame, classes: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, text) of the given nodes. A filter of fixed size keeps most other texts out of the shuffle."""
    rep = materialize(classes.select("node", "doc_id", "text_key").join(nodes, "node"), "asked")
    spot = lambda c: F.pmod(c, F.lit(FILTER_BITS)).cast("int")

    def gather(batches):
        bits = np.zeros(FILTER_BITS, bool)
        for b in batches:
            bits[b.column("spot").to_numpy()] = True
        yield pa.RecordBatch.from_arrays([pa.array([np.packbits(bits).tobytes()], pa.binary())], names=["bits"])

    parts = map_arrow(rep.select(spot(F.col("text_key")).alias("spot")).distinct().coalesce(8), gather, "bits binary").collect()
    bits = np.zeros(FILTER_BITS // 8, np.uint8)
    for r in parts:
        bits |= np.frombuffer(r["bits"], np.uint8)
    known = docs.sparkSession.sparkContext.broadcast(bits)

    def narrow(batches):
        for b in batches:
            at = b.column("spot").to_numpy()
            yield b.filter(pa.array((known.value[at >> 3] >> (7 - (at & 7))) & 1 == 1))

    source = _keyed(docs).withColumn("spot", F.coalesce(spot(F.col("text_key")), F.lit(0)))
    source = map_arrow(source, narrow, "doc_id long, text string, text_key long, spot int")
    texts = source.join(rep, source.doc_id.eqNullSafe(rep.doc_id) & (source.text_key == rep.text_key)).select("node", "text")
    return materialize(texts.dropDuplicates(["node"]), "candidates")


def group_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, n_shingles, component_id) of every row of ``docs``."""
    signed = materialize(signatures(docs), "signed")
    full = signed.where("node is not null")
    first = full.groupBy("node", "node2").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("first"), F.any_value("signature").alias("signature"), F.any_value("bands").alias("bands"))
    classes = materialize(first.select("node", "first.doc_id", "first.text_key", "signature", "bands"), "classes")
    members = classes.select("node", F.posexplode("bands").alias("band", "key"))
    crowds = members.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = materialize(members.join(crowds, "key"), "shared")

    weight = shared.groupBy("node").agg(F.sum("n").alias("weight"))
    centre = shared.join(weight, "node").groupBy("key").agg(F.max(F.struct("weight", "node")).alias("top")).select("key", F.col("top.node").alias("b"))
    star = shared.join(centre, "key").where("node != b").select(F.least("node", "b").alias("a"), F.greatest("node", "b").alias("b")).distinct()
    likely = materialize(_estimated(star, classes), "likely")
    involved = likely.select(F.col("a").alias("node")).union(likely.select("b")).union(shared.where("n > 2").select("node")).distinct()
    texts = _candidates(docs, classes, involved)

    sides = likely.select(F.col("a").alias("own"), "a", "b", "likeness").union(likely.select("b", "a", "b", "likeness"))
    best = sides.groupBy("own").agg(F.max(F.struct("likeness", "a", "b")).alias("top")).select("top.a", "top.b").distinct()
    best = materialize(best, "best")
    label = _merge(None, materialize(confirmed(best, texts), "confirmed"))
    rest = _apart(likely.select("a", "b").join(best, ["a", "b"], "left_anti"), label).select("a", "b")
    label = _merge(label, materialize(confirmed(rest, texts), "confirmed"))
    tested = likely.select("a", "b")
    signed_nodes = materialize(_wide(_mixed(shared, label).select("node").distinct(), texts).join(classes.select("node", "bands"), "node"), "wide")
    for tries in TRIES:
        pairs = materialize(_residual(shared, label, signed_nodes, tries).join(tested, ["a", "b"], "left_anti"), "residual")
        if pairs.isEmpty():
            if tries == TRIES[-1]:
                break
            continue
        label = _merge(label, materialize(confirmed(pairs, texts), "confirmed"))
        tested = tested.union(pairs)

    named = classes.select("node", "doc_id")
    named = named.withColumn("component", F.col("node")) if label is None else named.join(label, "node", "left").withColumn("component", F.coalesce("component", "node"))
    heads = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    named = materialize(named.join(heads, "component").select("node", "component_id"), "named")
    return signed.join(named, "node", "left").select("doc_id", "text_key", "n_shingles", F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def drop_duplicates(docs: DataFrame) -> DataFrame:
    """One row of each group, with all its columns: the one with the group's smallest doc_id."""
    kept = group_rows(docs).where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("id"), F.col("text_key").alias("key")).distinct()
    own = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("own_id"), F.xxhash64(F.col("text").cast("string")).alias("own_key"))
    rows = own.join(kept, F.col("own_id").eqNullSafe(F.col("id")) & (F.col("own_key") == F.col("key")))
    one = Window.partitionBy("own_id", "own_key").orderBy(F.xxhash64(F.to_json("row")))
    return rows.withColumn("n", F.row_number().over(one)).where("n = 1").select("row.*")
