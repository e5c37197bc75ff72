"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests, in DataFrame functions only.

A paragraph is a run of words inside a line that ends with a word whose last character is in ``ENDS``, or with the line,
or after ``PARAGRAPH_WORDS`` words: such runs find their old borders again behind an insertion. Its digest is a 64-bit
hash. A sketch has groups, by the digests' top bits, of ``3 * THIRD`` cells; their number is the least power of two that
leaves ``SHARE`` digests a group on average, so a sketch follows its text. Each distinct digest is added to three cells
of its group, one in each third; a cell holds a count and the exclusive-or of its digests and of their check hashes. The
fingerprint is the sketch as text (:func:`parse` reads it).

Two texts are compared by their sketches: the larger is folded to the groups of the smaller, one is subtracted from the
other, which cancels what the texts share, and peeling takes out cells that hold one digest until nothing is left. A
group that does not peel was too small: its digests are dealt into four groups by their next two bits, which makes four
times the cells (a group of ``HALVED`` at most into two at first), again and again until all peel; after all 64 bits a group holds one digest at most, so none is left
out. The likeness is 1 - d / (a + b) for d recovered digests of a and b distinct ones, and 1 for two empty texts.

The next document comes from a window over ranges of (doc_id, text hash) whose borders are rows of the table; the rows
at a border are also sent, as guests, to the range before, so every range finds its successor in one shuffle of the
texts. An id that holds more rows than a range (null among them) is split by text hash.

Defined cases: null texts are empty; an empty or blank text has an empty sketch; documents are ordered by doc_id (null
first), ties by text hash, and repeated rows follow each other; the last row's next is the first, a single row's next is
itself; texts of any length are used whole, with sketches in proportion; an empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

import math
from itertools import groupby

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import shuffle_partitions

#: Most words of a paragraph; cells of a third of a group; digests of a group; peeling rounds of a try; id ranges for each shuffle partition.
PARAGRAPH_WORDS, THIRD, SHARE, ROUNDS, RANGES = 16, 6, 16, 10, 8
#: Most digests of a group of two texts that its first retry halves; larger ones are dealt into four.
HALVED = 20
#: Fixed value: a word that ends so ends its paragraph: sentence marks, and the letters whose code is a multiple of 7.
ENDS = ".!?;:FMTbipw"
_PIECE = rf"(?:[^ \t-\r]++(?<![{ENDS}])[ \t]++){{0,{PARAGRAPH_WORDS - 1}}}[^ \t-\r]++"
_CELLS = 3 * THIRD



def _hash(k: Column) -> Column:
    return F.xxhash64(k, F.lit(1))


def _cells_of(h: Column) -> Column:
    """The three cells of a digest with the hash ``h``, one in each third, as bits."""
    slot = lambda i: F.pmod(F.shiftrightunsigned(h, 32 + 10 * i).bitwiseAND(F.lit(0x3FF)), F.lit(THIRD)).cast("int") + F.lit(THIRD * i)
    bit = lambda i: F.call_function("shiftleft", F.lit(1), slot(i))
    return bit(0).bitwiseOR(bit(1)).bitwiseOR(bit(2))


def digests(text: Column) -> Column:
    """Distinct paragraph digests: array of (k, c, m): digest, check hash, its cells as bits."""
    keys = F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(_PIECE), F.lit(0)), lambda p: F.xxhash64(p)))
    hashed = F.transform(keys, lambda k: F.struct(k.alias("k"), _hash(k).alias("h")))
    return F.transform(hashed, lambda x: F.struct(x["k"].alias("k"), x["h"].bitwiseAND(F.lit(0xFFFFFFFF)).alias("c"), _cells_of(x["h"]).alias("m")))


def levels(digests: Column) -> Column:
    """Top bits that tell a sketch's groups apart, for its number of digests."""
    return F.ceil(F.log2(F.greatest(F.size(digests) / F.lit(float(SHARE)), F.lit(1.0)))).cast("int")


def grouped(digests: Column, level: Column) -> Column:
    """The digests of each of ``2 ** level`` groups, in the order of their top bits."""
    upper = lambda i: lambda x: F.getbit(x["k"], F.lit(64) - i).cast("boolean")
    halve = lambda parts, i: F.flatten(F.transform(parts, lambda p: F.array(F.filter(p, lambda x: ~upper(i)(x)), F.filter(p, upper(i)))))
    return F.when(level > 0, F.aggregate(F.sequence(F.lit(1), F.greatest(level, F.lit(1))), F.array(digests), halve)).otherwise(F.array(digests))


def _put(sign: int):
    return lambda a, x: F.struct((a["n"] + F.lit(sign)).alias("n"), a["k"].bitwiseXOR(x["k"]).alias("k"), a["c"].bitwiseXOR(x["c"]).alias("c"))


def _in(j: Column):
    return lambda x: F.getbit(x["m"], j).cast("boolean")


def _cells(added: Column, taken: Column | None = None) -> Column:
    """The cells of one group of the digests ``added``, less those of ``taken``."""
    empty = F.struct(F.lit(0).alias("n"), F.lit(0).cast("long").alias("k"), F.lit(0).cast("long").alias("c"))
    one = lambda j: F.aggregate(F.filter(added, _in(j)), empty, _put(1))
    both = lambda j: F.aggregate(F.filter(taken, _in(j)), one(j), _put(-1))
    return F.transform(F.array(*map(F.lit, range(_CELLS))), one if taken is None else both)


def sketch(groups: Column) -> Column:
    """The cells of every group."""
    return F.transform(groups, lambda g: _cells(g))


def _clear(c: Column) -> Column:
    return (c["n"] == 0) & (c["k"] == 0) & (c["c"] == 0)


def fingerprint(cells: Column) -> Column:
    """A sketch as text: groups between semicolons, cells between commas; a cell's count, digests and checks, or nothing."""
    one = lambda c: F.when(_clear(c), F.lit("")).otherwise(F.concat_ws(":", c["n"].cast("string"), F.hex(c["k"]), F.hex(c["c"])))
    return F.array_join(F.transform(cells, lambda g: F.array_join(F.transform(g, one), ",")), ";")


def parse(text: Column) -> Column:
    """The sketch that :func:`fingerprint` wrote; an empty cell's three parts are missing, which stands for zeros."""
    number = lambda x: F.coalesce(F.conv(x, 16, -10).cast("long"), F.lit(0).cast("long"))
    count = lambda x: F.coalesce(F.when(x != "", x).cast("int"), F.lit(0))
    one = lambda c: F.struct(count(F.substring_index(c, ":", 1)).alias("n"), number(F.split_part(c, F.lit(":"), F.lit(2))).alias("k"), number(F.split_part(c, F.lit(":"), F.lit(3))).alias("c"))
    return F.transform(F.split(text, ";"), lambda g: F.transform(F.split(g, ","), one))


def _joined(x: Column, y: Column, sign: int) -> Column:
    put = lambda u, v: F.struct((u["n"] + F.lit(sign) * v["n"]).alias("n"), u["k"].bitwiseXOR(v["k"]).alias("k"), u["c"].bitwiseXOR(v["c"]).alias("c"))
    return F.zip_with(x, y, put)


def folded(cells: Column, groups: Column) -> Column:
    """A sketch with ``groups`` groups, made of one with as many or more: neighbours in the order of top bits are added."""
    rounds = F.log2(F.size(cells) / groups).cast("int")
    fold = lambda s, _: F.transform(F.sequence(F.lit(1), (F.size(s) / 2).cast("int")), lambda i: _joined(F.get(s, 2 * i - 2), F.get(s, 2 * i - 1), 1))
    return F.when(rounds > 0, F.aggregate(F.sequence(F.lit(1), F.greatest(rounds, F.lit(1))), cells, fold)).otherwise(cells)


def subtracted(a: Column, b: Column) -> Column:
    """The sketch of what only one of two sketches holds, with the fewer groups of the two."""
    least = F.least(F.size(a), F.size(b))
    return F.zip_with(folded(a, least), folded(b, least), lambda x, y: _joined(x, y, -1))


def crowded(cells: Column) -> Column:
    """Whether a subtracted group seems to hold more digests than cells, by the squares of its counts."""
    n = F.aggregate(cells, F.lit(0), lambda s, c: s + c["n"])
    return F.aggregate(cells, F.lit(0), lambda s, c: s + c["n"] * c["n"]) * F.lit(_CELLS) - n * n > F.lit(3 * _CELLS * _CELLS)


#: States of peeling: pure cells are to be found, to be taken out; it ended with cells left, or with none.
_FIND, _TAKE, _STUCK, _DONE = range(4)
_ITEMS = "array<struct<n:int,k:bigint,c:bigint,m:int>>"
_KEYS = "array<bigint>"


def peel(cells: Column, hopeless: Column | None = None) -> Column:
    """(cells, plus, minus, items, state) of a group after ``ROUNDS`` rounds: plus and minus hold the digests recovered of
    either side. A ``hopeless`` group is stuck at once. Spark copies the whole state at every step, so it holds bare digests, and no cells once peeling ended."""
    none, no_keys = F.array().cast(_ITEMS), F.array().cast(_KEYS)
    hashed = lambda k: F.struct(k.alias("k"), _hash(k).alias("h"))
    item = lambda n: lambda x: F.struct(F.lit(n).alias("n"), x["k"].alias("k"), x["h"].bitwiseAND(F.lit(0xFFFFFFFF)).alias("c"), _cells_of(x["h"]).alias("m"))
    pure = lambda n: lambda c: (c["n"] == n) & (c["c"] == _hash(c["k"]).bitwiseAND(F.lit(0xFFFFFFFF)))
    # Distinct keys of a side: a set of numbers costs far less than one of structs, which Spark compares pair by pair.
    side = lambda cells, n: F.transform(F.transform(F.array_distinct(F.transform(F.filter(cells, pure(n)), lambda c: c["k"])), hashed), item(n))
    keys = lambda items, n: F.transform(F.filter(items, lambda x: x["n"] == n), lambda x: x["k"])
    take = lambda cell, p: F.struct((cell["n"] - p["n"]).alias("n"), cell["k"].bitwiseXOR(p["k"]).alias("k"), cell["c"].bitwiseXOR(p["c"]).alias("c"))
    group = lambda cells, plus, minus, items, state: F.struct(cells.alias("cells"), plus.alias("plus"), minus.alias("minus"), items.alias("items"), state.alias("state"))

    def once(g: Column, _: Column) -> Column:
        find = group(g["cells"], g["plus"], g["minus"], F.concat(side(g["cells"], 1), side(g["cells"], -1)), F.lit(_TAKE))
        end = group(F.slice(g["cells"], 1, 0), g["plus"], g["minus"], none, F.when(F.forall(g["cells"], _clear), F.lit(_DONE)).otherwise(F.lit(_STUCK)))
        left = F.transform(g["cells"], lambda c, j: F.aggregate(F.filter(g["items"], _in(j)), c, take))
        taken = group(left, F.concat(g["plus"], keys(g["items"], 1)), F.concat(g["minus"], keys(g["items"], -1)), none, F.lit(_FIND))
        return F.when(g["state"] > _TAKE, g).when(g["state"] == _FIND, find).when(F.size(g["items"]) == 0, end).otherwise(taken)

    begin = group(cells, no_keys, no_keys, none, F.lit(_FIND))
    if hopeless is not None:
        begin = F.when(hopeless, group(F.slice(cells, 1, 0), no_keys, no_keys, none, F.lit(_STUCK))).otherwise(begin)
    return F.aggregate(F.sequence(F.lit(1), F.lit(2 * ROUNDS)), begin, once)


def first_try(a: Column, b: Column) -> Column:
    """Peeled groups of two subtracted sketches; crowded ones are left as they are."""
    return F.transform(subtracted(a, b), lambda g: peel(g, crowded(g)))


def retried(tried: Column, a: Column, b: Column) -> Column:
    """The digests in one of two texts only, from the first try, and for groups that did not peel from their digests ``a``
    and ``b`` (in groups as their sketches have them) with twice or four times the cells, again and again."""
    least = F.size(tried)
    used = F.log2(least).cast("int")
    recovered = lambda g: F.concat(g["plus"], g["minus"])

    def own(groups: Column, i: Column) -> Column:
        width = (F.size(groups) / least).cast("int")
        return F.flatten(F.slice(groups, i * width + 1, width))

    part = lambda a, b, at: F.struct(a.alias("a"), b.alias("b"), at.alias("at"))
    failed = F.filter(F.sequence(F.lit(0), least - 1), lambda i: F.get(tried, i)["state"] != _DONE)
    pending = F.transform(failed, lambda i: part(own(a, i), own(b, i), used))
    done = lambda t: t["g"]["state"] == _DONE
    hold = lambda pending, tried, found: F.struct(pending.alias("pending"), tried.alias("tried"), found.alias("found"))
    found = F.flatten(F.transform(F.filter(tried, lambda g: g["state"] == _DONE), recovered))
    attempt = lambda p: F.struct(p.alias("p"), peel(_cells(p["a"], p["b"])).alias("g"))
    no_tries = F.filter(F.transform(F.slice(pending, 1, 0), lambda p: F.struct(p.alias("p"), F.get(tried, F.lit(0)).alias("g"))), lambda t: F.lit(False))

    def step(held: Column, s: Column) -> Column:
        # The bits that deal a group: one for a small group at its first retry, else two, so 64 bits take 33 retries at most.
        bits = lambda p: F.when((s == 0) & (F.size(p["a"]) + F.size(p["b"]) <= HALVED), F.lit(1)).otherwise(F.lit(2))
        digit = lambda x, p, n: F.call_function("shiftrightunsigned", F.call_function("shiftleft", x["k"], p["at"]), F.lit(64 - n))
        deal = lambda p, n: F.transform(F.array(*[F.lit(q).cast("long") for q in range(2**n)]), lambda q: part(F.filter(p["a"], lambda x: digit(x, p, n) == q), F.filter(p["b"], lambda x: digit(x, p, n) == q), p["at"] + F.lit(n)))
        split = lambda p: F.when(bits(p) == 1, deal(p, 1)).otherwise(deal(p, 2))
        more = hold(F.slice(held["pending"], 1, 0), F.transform(F.flatten(F.transform(held["pending"], split)), attempt), held["found"])
        left = F.transform(F.filter(held["tried"], lambda t: ~done(t)), lambda t: t["p"])
        got = F.concat(held["found"], F.flatten(F.transform(F.filter(held["tried"], done), lambda t: recovered(t["g"]))))
        return F.when(F.size(held["pending"]) > 0, more).when(F.size(held["tried"]) > 0, hold(left, F.slice(held["tried"], 1, 0), got)).otherwise(held)

    return F.aggregate(F.sequence(F.lit(0), F.lit(67)), hold(pending, no_tries, found), step)["found"]


def likeness(a: Column, b: Column, items: Column) -> Column:
    """From the digests of two texts and how many of them differ."""
    both = F.size(a) + F.size(b)
    return F.when(both == 0, F.lit(1.0)).otherwise(F.lit(1.0) - items / both)


def compare(rows: DataFrame, a: str, b: str, out: str) -> DataFrame:
    """``rows`` with the likeness of two fingerprint columns alone; null where they are too small to recover what differs."""
    n = lambda c: F.aggregate(F.flatten(F.transform(c, lambda g: F.slice(g, 1, THIRD))), F.lit(0), lambda x, c: x + c["n"])
    read = rows.withColumns({"_a": parse(F.col(a)), "_b": parse(F.col(b))})
    read = read.withColumns({"_many": n(F.col("_a")) + n(F.col("_b")), "_tried": F.transform(subtracted(F.col("_a"), F.col("_b")), lambda g: peel(g))})
    items = F.aggregate("_tried", F.lit(0), lambda x, g: x + F.size(g["plus"]) + F.size(g["minus"]))
    near = F.when(F.col("_many") == 0, F.lit(1.0)).when(F.forall("_tried", lambda g: g["state"] == _DONE), F.lit(1.0) - items / F.col("_many"))
    return read.withColumn(out, near).drop("_a", "_b", "_many", "_tried")


_LOWEST = -(1 << 63)


def _borders(own: DataFrame, n: int) -> list[tuple[bool, int, int]]:
    """About ``n`` borders (known, doc_id, text hash) between ranges, the first below all rows.

    A border is the hash of a row, or, with the hash ``_LOWEST``, the id of one.
    """
    found = own.agg(
        F.min("doc_id").alias("low"), F.count_if(~F.col("known")).alias("none"), F.count(F.lit(1)).alias("all"), F.percentile_approx("doc_id", [i / n for i in range(1, n)], 20 * n).alias("cuts")
    ).first()
    if not found["all"]:
        return []
    cuts = [*(found["cuts"] or []), *([] if found["low"] is None else [found["low"]])]
    crowds = {(True, i): len(list(same)) for i, same in groupby(sorted(cuts))}
    if found["none"]:
        crowds[False, 0] = found["none"] * n // found["all"]
    out = {(*key, _LOWEST) for key in crowds}
    crowds = {key: m for key, m in crowds.items() if m > 1}
    if crowds:
        share = F.element_at(F.create_map(*[F.lit(x) for (known, i), m in crowds.items() for x in (f"{known}{i}".lower(), m)]), F.concat(F.col("known").cast("string"), F.col("id").cast("string")))
        part = F.floor((F.col("hash") / F.lit(2.0**64) + F.lit(0.5)) * share)
        rows = own.withColumn("part", part).where("part is not null").groupBy("known", "id", "part").agg(F.min("hash").alias("hash"))
        for _, parts in groupby(sorted((r["known"], r["id"], r["hash"]) for r in rows.collect()), lambda x: x[:2]):
            out |= {*list(parts)[1:]}
    return sorted(out)


def with_next(docs: DataFrame) -> DataFrame:
    """(doc_id, text, next): each row with the text of the row that follows it by id, the first row after the last."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    own = own.withColumn("known", F.col("doc_id").isNotNull()).withColumn("id", F.coalesce("doc_id", F.lit(0))).withColumn("hash", F.xxhash64("text"))
    borders = _borders(own, shuffle_partitions(docs.sparkSession) * RANGES)

    width = max(1, math.isqrt(len(borders)))
    blocks = [borders[i : i + width] for i in range(0, len(borders), width)]
    kind = "struct<known:boolean,id:bigint,hash:bigint>"
    longs = lambda xs: F.array(*[F.struct(*map(F.lit, x)).cast(kind) for x in xs]).cast(f"array<{kind}>")
    at = F.struct("known", "id", "hash").cast(kind)
    block = F.size(F.filter(longs([b[0] for b in blocks]), lambda x: x <= at))
    inside = F.size(F.filter(F.get(F.array(*map(longs, blocks)).cast(f"array<array<{kind}>>"), block - 1), lambda x: x <= at))
    own = own.withColumn("range", ((block - 1) * F.lit(width) + inside).cast("int")).withColumn("border", F.get(longs(borders), F.col("range") - 1))
    first = (F.col("border.known") == F.col("known")) & (F.col("border.id") == F.col("id")) & F.col("border.hash").isin(F.lit(_LOWEST), F.col("hash"))

    place = lambda r, guest, wrap: F.struct(r.alias("range"), F.lit(guest).alias("guest"), wrap.alias("wrap"))
    lowest = F.col("range") == 1
    here, before = place(F.col("range"), False, F.lit(False)), place(F.when(lowest, F.lit(len(borders))).otherwise(F.col("range") - 1), True, lowest)
    rows = own.withColumn("place", F.explode(F.when(first, F.array(here, before)).otherwise(F.array(here)))).select("doc_id", "text", "place.*")
    order = Window.partitionBy("range").orderBy("wrap", F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    return rows.withColumn("next", F.lead("text").over(order)).where("not guest").select("doc_id", "text", "next")


def edited_text(text: Column, following: Column) -> Column:
    """The text with its last quarter of code points replaced by the first as many of the following text."""
    quarter = F.floor(F.char_length(text) / 4).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.char_length(text) - quarter), F.substring(following, F.lit(1), quarter))


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """Fingerprints of every row and of its edited text, and the likenesses to the edited and the next text."""
    rows = with_next(docs).withColumn("edited", edited_text(F.col("text"), F.col("next")))
    rows = rows.select("doc_id", F.char_length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), F.array("text", "edited", "next").alias("texts"))
    rows = rows.withColumn("digests", F.transform("texts", lambda t: digests(t))).drop("texts")
    rows = rows.withColumn("groups", F.transform("digests", lambda d: grouped(d, levels(d))))
    rows = rows.withColumn("cells", F.transform("groups", lambda g: sketch(g)))
    other = F.array(F.lit(1), F.lit(2))
    rows = rows.withColumn("tried", F.transform(other, lambda i: first_try(F.get("cells", F.lit(0)), F.get("cells", i))))
    rows = rows.withColumn("items", F.transform(other, lambda i: F.size(retried(F.get("tried", i - 1), F.get("groups", F.lit(0)), F.get("groups", i)))))
    near = lambda i: likeness(F.get("digests", F.lit(0)), F.get("digests", F.lit(i)), F.get("items", F.lit(i - 1)))
    prints = F.transform(F.slice("cells", 1, 2), lambda c: fingerprint(c))
    return rows.withColumn("prints", prints).select(
        "doc_id", "n_chars", "edited_sha256", F.get("prints", F.lit(0)).alias("fingerprint"), F.get("prints", F.lit(1)).alias("edited_fingerprint"), near(1).alias("near_edited"), near(2).alias("near_next")
    )
