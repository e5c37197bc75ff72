"""Token-ID output: fixed-width bit packing with block offsets.

Documents are range-partitioned and sorted by doc_id (ties by text, null ids first); each partition encodes its texts,
appends the end id and emits chunks of whole documents, at least ``CHUNK_IDS`` ids each but the last. A chunk is a
self-contained image: a header, the byte offset of every block of ``BLOCK_IDS`` ids, the documents' ids and lengths, and
the ids packed with the fewest bits that hold the vocabulary. Blocks start on bytes, so a reader unpacks any range of
ids from the blocks that hold it, with numpy. Images are rows (shard, chunk, n_ids, image) of a parquet table, which any
store that Spark writes can hold and whose commit protocol survives lost executors.

Defined cases: a null or empty text is the end id alone; repeated rows and equal ids are written once each, in the order
above; an empty table gives an empty result; extra columns are ignored; a text longer than a chunk makes a longer chunk;
strings of the tokenizer's added tokens in a text become those tokens, as in the library.
"""

from __future__ import annotations

import os
import struct
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import batch, map_arrow, shuffle_partitions, texts_of
from graphloom.llm.pieces import byte_letters, latin, split_pieces

#: Ids of a block; ids after which a chunk is closed; pieces a worker learns before
#: it forgets those it has not met again; pieces given to the tokenizer at a time, and joined into one line.
BLOCK_IDS, CHUNK_IDS, MEMORY, STEP, LINE = 4096, 1 << 20, 600_000, 4096, 512
#: Fixed value: marks that may follow a word.
_MARKS = ".,;:!?#$%*&|"
MAGIC = b"GLTOK001"
_HEAD = struct.Struct("<8sIIQQQ")
CHUNKS = "shard int, chunk long, n_ids long, image binary"
_encoders: dict[int, tuple] = {}


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids as consecutive little-endian fields of ``bits`` bits, padded to a byte."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    return np.packbits(((ids[:, None].astype(np.uint32) >> np.arange(bits, dtype=np.uint32)) & 1).astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(data, n: int, bits: int) -> np.ndarray:
    """The first ``n`` ids of packed bytes."""
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", n).astype(np.uint32)
    flat = np.unpackbits(np.frombuffer(data, np.uint8), count=n * bits, bitorder="little").reshape(n, bits)
    return (flat.astype(np.uint32) << np.arange(bits, dtype=np.uint32)).sum(1, dtype=np.uint32)


def write_image(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray, bits: int) -> bytes:
    """A chunk's image."""
    blocks = [pack(ids[i : i + BLOCK_IDS], bits) for i in range(0, len(ids), BLOCK_IDS)]
    offsets = np.cumsum([0, *map(len, blocks)], dtype="<u8")
    known = np.array([d is not None for d in doc_ids], np.uint8)
    head = _HEAD.pack(MAGIC, bits, BLOCK_IDS, len(ids), len(blocks), len(doc_ids))
    return b"".join([head, offsets.tobytes(), np.array([d or 0 for d in doc_ids], "<i8").tobytes(), np.array(lengths, "<u8").tobytes(), known.tobytes(), *blocks])


class Image:
    """Reads a chunk's image; documents and ids are addressed by their place in it."""

    def __init__(self, data: bytes):
        magic, self.bits, self.block, self.n_ids, blocks, docs = _HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a token image")
        at = _HEAD.size
        self.offsets = np.frombuffer(data, "<u8", blocks + 1, at)
        at += 8 * (blocks + 1)
        self.doc_ids = np.frombuffer(data, "<i8", docs, at)
        self.lengths = np.frombuffer(data, "<u8", docs, at + 8 * docs).astype(np.int64)
        self.known = np.frombuffer(data, np.uint8, docs, at + 16 * docs).astype(bool)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)])
        self.payload = memoryview(data)[at + 17 * docs :]

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids start to stop; only the blocks that hold them are unpacked."""
        if start >= stop:
            return np.zeros(0, np.uint32)
        first, last = start // self.block, (stop - 1) // self.block
        parts = [unpack(self.payload[int(self.offsets[b]) : int(self.offsets[b + 1])], min(self.block, self.n_ids - b * self.block), self.bits) for b in range(first, last + 1)]
        return np.concatenate(parts)[start - first * self.block : stop - first * self.block]

    def document(self, k: int) -> np.ndarray:
        return self.ids(int(self.starts[k]), int(self.starts[k + 1]))


def _encoder(model: str):
    """(encode, bits) of a tokenizer description, kept for the life of the worker."""
    key = zlib.crc32(model.encode())
    if key not in _encoders:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_str(model)
        special = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
        memory: dict[str, bytes] = {}
        older: dict[str, bytes] = {}
        feed = tokenizer.encode("\n", add_special_tokens=False).ids
        letters, merges = byte_letters(), tokenizer.model
        blank, tokenize = letters[32], merges.tokenize

        def of_letters(piece: str) -> bytes:
            """Ids of a piece of Latin letters, with or without a space before them, by the BPE model alone."""
            s = "".join(map(letters.__getitem__, piece.encode())) if not piece.isascii() else blank + piece[1:] if piece[0] == " " else piece
            return array("I", [t.id for t in tokenize(s)]).tobytes()

        probes = ("the", " The", "Zürich", " ofononwhnt", " œuvre", "ŐŁĲ", " ß", "I")
        direct = all(of_letters(p) == np.array(tokenizer.encode(p, add_special_tokens=False).ids, "<u4").tobytes() for p in probes)
        joins = len(feed) == 1 and all(tokenizer.encode(x, add_special_tokens=False).ids.count(feed[0]) == 1 for x in ("a\n b", "a\nb", ".\n ."))

        def learn(new: list[str]) -> None:
            # Letters and the marks behind them are different pre-tokens, so both are remembered on their own. Letters go to
            # the BPE model itself where probes show that this gives the same ids. A line feed between two plain pieces is
            # a token of its own, so the other plain pieces are encoded many at a time.
            parts, wanted = [], set()
            for p in new:
                if not p:
                    wanted.add(p)
                    continue
                word = p[1:] if p[0] == " " else p
                if direct and latin(word):
                    memory[p] = of_letters(p)
                    continue
                stem = p.rstrip(_MARKS)
                if len(stem) == len(p) or not (stem[1:] if stem[:1] == " " else stem).isalpha():
                    wanted.add(p)
                    continue
                marks = p[len(stem) :]
                parts.append((p, stem, marks))
                if marks not in memory:
                    wanted.add(marks)
                if stem not in memory and stem not in wanted:
                    if direct and latin(stem[1:] if stem[0] == " " else stem):
                        memory[stem] = of_letters(stem)
                    else:
                        wanted.add(stem)
            plain = []
            for p in wanted if joins else ():
                words = p.split()
                if len(words) == 1 and len(words[0]) + (p[0] == " ") == len(p):
                    plain.append(p)
            rest = wanted.difference(plain)
            lines = [plain[i : i + LINE] for i in range(0, len(plain), LINE)]
            for pieces, e in zip(lines, tokenizer.encode_batch_fast(["\n".join(x) for x in lines], add_special_tokens=False), strict=True):
                ids = np.array([*e.ids, feed[0]], "<u4")
                ends = np.flatnonzero(ids == feed[0])
                if len(ends) != len(pieces):
                    rest.update(pieces)
                    continue
                raw, at = ids.tobytes(), 0
                for p, end in zip(pieces, (ends * 4).tolist(), strict=True):
                    memory[p] = raw[at:end]
                    at = end + 4
            rest = list(rest)
            for i in range(0, len(rest), STEP):
                for p, e in zip(rest[i : i + STEP], tokenizer.encode_batch_fast(rest[i : i + STEP], add_special_tokens=False), strict=True):
                    memory[p] = np.array(e.ids, "<u4").tobytes()
            for p, stem, marks in parts:
                memory[p] = memory[stem] + memory[marks]

        def encode(texts: list[str]) -> list[np.ndarray]:
            """The ids of each text; one that holds an added token's string is encoded as a whole, as the library does."""
            found = [any(s in t for s in special) for t in texts]
            if any(found):
                whole = iter([np.array(e.ids, "<u4") for e in tokenizer.encode_batch_fast([t for t, x in zip(texts, found, strict=True) if x], add_special_tokens=False)])
                plain = iter(encode_plain([t for t, x in zip(texts, found, strict=True) if not x]))
                return [next(whole if x else plain) for x in found]
            return encode_plain(texts)

        def encode_plain(texts: list[str]) -> list[np.ndarray]:
            nonlocal memory, older
            cut = [split_pieces(t) for t in texts]
            if len(memory) > MEMORY:
                memory, older = {}, memory
            new = set().union(*cut).difference(memory)
            known = [p for p in new if p in older]
            memory.update(zip(known, map(older.__getitem__, known), strict=True))
            new.difference_update(known)
            if new:
                learn(list(new))
            return [np.frombuffer(b"".join(map(memory.__getitem__, pieces)), "<u4") for pieces in cut]

        _encoders[key] = encode, max(1, (tokenizer.get_vocab_size() - 1).bit_length())
    return _encoders[key]


def write_tokens(docs: DataFrame, model: str, end_id: int) -> DataFrame:
    """Chunk images of all documents; ``model`` is the tokenizer's description (JSON)."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text"))
    rows = rows.repartitionByRange(shuffle_partitions(spark), "doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    out = pa.schema([("shard", pa.int32()), ("chunk", pa.int64()), ("n_ids", pa.int64()), ("image", pa.binary())])

    def run(batches):
        encode, bits = _encoder(shared.value)
        end = np.array([end_id], "<u4")
        shard, chunk = TaskContext.get().partitionId(), 0
        names, lengths, parts, held = [], [], [], 0

        def image():
            return batch(out, shard=[shard], chunk=[chunk], n_ids=[held], image=[write_image(names, lengths, np.concatenate(parts), bits)])

        for b in batches:
            for doc_id, ids in zip(b.column("doc_id").to_pylist(), encode(texts_of(b)), strict=True):
                names.append(doc_id)
                lengths.append(len(ids) + 1)
                parts += [ids, end]
                held += len(ids) + 1
                if held >= CHUNK_IDS:
                    yield image()
                    names, lengths, parts, held, chunk = [], [], [], 0, chunk + 1
        if held:
            yield image()

    return map_arrow(rows.select("doc_id", "text"), run, CHUNKS)


def read_index(chunks: DataFrame) -> DataFrame:
    """(shard, chunk, base): ids in all chunks before; shards are summed first, so no task orders all chunks."""
    sizes = chunks.select("shard", "chunk", "n_ids")
    before = lambda w: F.coalesce(F.sum("n_ids").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shards = sizes.groupBy("shard").agg(F.sum("n_ids").alias("n_ids"))
    shards = shards.select("shard", before(Window.orderBy("shard")).alias("ahead"))
    inside = sizes.withColumn("inside", before(Window.partitionBy("shard").orderBy("chunk")))
    return inside.join(shards, "shard").select("shard", "chunk", (F.col("ahead") + F.col("inside")).alias("base"))


def read_documents(chunks: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the images."""
    out = pa.schema([("doc_id", pa.int64()), ("shard", pa.int32()), ("chunk", pa.int64()), ("inside", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches):
        for b in batches:
            for shard, chunk, data in zip(*(b.column(c).to_pylist() for c in ("shard", "chunk", "image")), strict=True):
                im = Image(data)
                n = len(im.lengths)
                ids = im.ids(0, im.n_ids).astype("<u4")
                crc = [zlib.crc32(ids[s:e]) for s, e in zip(im.starts[:-1], im.starts[1:], strict=True)]
                yield batch(out, doc_id=[int(d) if k else None for d, k in zip(im.doc_ids, im.known, strict=True)], shard=[shard] * n, chunk=[chunk] * n, inside=im.starts[:-1], n_tokens=im.lengths, ids_crc32=crc)

    rows = map_arrow(chunks.select("shard", "chunk", "image"), run, "doc_id long, shard int, chunk long, inside long, n_tokens long, ids_crc32 long")
    return rows.join(read_index(chunks), ["shard", "chunk"]).select("doc_id", (F.col("base") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")
