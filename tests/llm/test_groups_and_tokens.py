"""Near-duplicates, tokens, byte BPE, chat and HTML against brute force, libraries and round trips."""

import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from graphloom.llm import byte_bpe, chat, html_pages, html_text, minhash, token_output
from graphloom.llm.pieces import split_pieces

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def sets(text):
    w = SPACE.findall((text or "").translate(LOW))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_groups(rows):
    """Component of each row by all pairs of sets."""
    s = [sets(t) for _, t in rows]
    at = list(range(len(rows)))

    def find(i):
        while at[i] != i:
            i = at[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(s[i] & s[j])
            if s[i] and s[j] and 100 * both >= 75 * (len(s[i]) + len(s[j]) - both):
                at[find(i)] = find(j)
    roots = [find(i) for i in range(len(rows))]
    low = {}
    for (doc, _), r in zip(rows, roots, strict=True):
        low[r] = doc if low.get(r) is None else low[r] if doc is None else min(low[r], doc)
    return [low[r] for r in roots]


def test_groups_of_odd_rows(docs, odd_rows, empty):
    got = sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in minhash.group_rows(docs).collect())
    want = brute_groups([(r[0], r[1]) for r in odd_rows])
    assert got == sorted((str(r[0]), len(sets(r[1])), str(c)) for r, c in zip(odd_rows, want, strict=True))
    kept = minhash.drop_duplicates(docs)
    assert kept.columns == docs.columns
    ids = sorted(str(r["doc_id"]) for r in kept.collect())
    assert ids == sorted({str(c) if r[0] is not None else "None" for r, c in zip(odd_rows, want, strict=True)})
    assert minhash.group_rows(empty).count() == 0 and minhash.drop_duplicates(empty).count() == 0


def test_groups_in_chains_and_hot_buckets(spark):
    r = random.Random(1)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    base = [word() for _ in range(100)]
    rows, current = [], list(base)
    for i in range(60):  # a chain: each differs a little from the one before, the ends share nothing
        current = list(current)
        current[(i * 3) % 100] = word()
        rows.append((i, " ".join(current)))
    for i in range(150):  # variants of one text, some too far from it
        v = list(base)
        for k in r.sample(range(100), r.randint(1, 7)):
            v[k] = word()
        rows.append((1000 + i, " ".join(v)))
    rows += [(5000 + i, " ".join(base)) for i in range(40)] + [(9000 + i, " ".join(word() for _ in range(50))) for i in range(40)]
    r.shuffle(rows)
    got = {x["doc_id"]: x["component_id"] for x in minhash.group_rows(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == dict(zip((i for i, _ in rows), brute_groups(rows), strict=True))


def test_low_bits_do_not_fake_a_shared_band(spark):
    """Nodes agree in the low bits of band 0 but meet in band 1 only: their pair is looked at there."""
    wide, low = bytes(range(256)) * 2, bytes(minhash.BANDS * minhash.ROWS)
    signed = [(i, low, [10 + i, 7, *range(100 * i, 100 * i + minhash.BANDS - 2)], wide) for i in range(1, 4)]
    signed = spark.createDataFrame(signed, "node long, signature binary, bands array<long>, wide binary")
    shared = spark.createDataFrame([(7, 1, i, 3) for i in range(1, 4)], "key long, band int, node long, n long")
    got = {(r["a"], r["b"]) for r in minhash._residual(shared, None, signed, 1 << 40).collect()}
    assert got == {(1, 2), (1, 3), (2, 3)}


def test_estimates_are_close():
    r = np.random.default_rng(3)
    pool = r.integers(0, 1 << 63, 4000, dtype=np.uint64)
    a, b = np.unique(pool[:1000]), np.unique(pool[150:1150])
    true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    sig = [(minhash.minima(x) & 255).astype(np.uint8) for x in (a, b)]
    assert abs(minhash.estimate(sig[0], sig[1]) - true) < 0.15


TEXTS = ["", " ", "a", "Hello  world \n\n x", "it's we'll 's 12 34x", "<|endoftext|> é中😀", "\x1c\x85  y z", "word,  word.\nWord!! ### | $$$", "aaaaaaaaaaaaaaaaaaaaaaaa" * 50]


def test_pieces_join_up():
    r = random.Random(2)
    for t in TEXTS + ["".join(r.choice("ab \n\t .") for _ in range(40)) for _ in range(300)]:
        assert "".join(split_pieces(t)) == t


def test_token_images(docs, odd_rows, empty):
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        model = f.read()
    tokenizer = Tokenizer.from_str(model)
    assert tokenizer.encode("a <|endoftext|> b", add_special_tokens=False).ids == [64, 220, 50256, 275]
    encode, bits = token_output._encoder(model)
    assert bits == 16 and [x.tolist() for x in encode(TEXTS)] == [tokenizer.encode(t, add_special_tokens=False).ids for t in TEXTS]
    got = sorted(token_output.read_documents(token_output.write_tokens(docs, model, 2)).collect(), key=lambda r: r["start"])
    known = [r["doc_id"] for r in got]
    assert known == sorted(known, key=lambda d: (d is not None, d)) and len(got) == len(odd_rows)
    text = {r[0]: r[1] or "" for r in odd_rows}
    at = 0
    for r in got:
        ids = np.array([*tokenizer.encode(text[r["doc_id"]], add_special_tokens=False).ids, 2], "<u4")
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert token_output.read_documents(token_output.write_tokens(empty, model, 2)).count() == 0


@pytest.mark.parametrize("bits", [1, 5, 13, 16, 17, 20])
def test_packing(bits):
    ids = np.random.default_rng(bits).integers(0, 1 << bits, 10_001).astype(np.uint32)
    assert (token_output.unpack(token_output.pack(ids, bits), len(ids), bits) == ids).all()
    im = token_output.Image(token_output.write_image([3, None], [4000, 6001], ids, bits))
    assert (im.document(1) == ids[4000:]).all() and (im.ids(4095, 8193) == ids[4095:8193]).all() and im.known.tolist() == [True, False]


def test_byte_bpe(docs, odd_rows, empty):
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        vocabulary = f.read()
    coder = byte_bpe.coder(vocabulary, public_tokenizers.PATTERN)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=coder.ranks, special_tokens={})
    for t in TEXTS + [r[1] or "" for r in odd_rows]:
        ids = coder.encode(t)
        assert ids == library.encode_ordinary(t) and coder.decode(ids) == t.encode()
    encoded = byte_bpe.encode_documents(docs, vocabulary, public_tokenizers.PATTERN)
    back = byte_bpe.decode_documents(encoded, vocabulary, public_tokenizers.PATTERN).collect()
    assert sorted(bytes(r["raw"]).decode() for r in back) == sorted(r[1] or "" for r in odd_rows)
    assert byte_bpe.round_trip(empty, vocabulary, public_tokenizers.PATTERN).count() == 0


def test_chat(spark):
    odd = ["", None, "</s>[INST] ok [/INST]", "a\\b[", "<", "</", "x<<SYS>", "[ROLE]\\", "\n"]
    rows = [(1, i, "user" if i % 2 == 0 else "assistant", t, 1) for i, t in enumerate(odd)] + [(2, None, None, "x", 0), (2, 1, "tool", "[/ROLE]<", 0), (None, 0, "assistant", "a", 0), (3, 0, "user", "q", 0), (3, 0, "user", "q", 0)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, loss int")
    out = chat.format_turns(table)
    segments = out.collect()
    assert not any(c in chat.INSTRUCT.escaped(t or "") for t in odd for c in chat.INSTRUCT.controls())
    for conv in (1, 2, None, 3):
        whole = "".join(s["segment"] for s in sorted((s for s in segments if s["conv_id"] == conv), key=lambda s: (s["turn_no"], s["part"])))
        want = [(r[2] or "", r[3] or "") for r in sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0))]
        assert chat.INSTRUCT.turns(whole) == want
    got = {r["conv_id"]: r for r in chat.digest(out).collect()}
    assert got[1]["n_turns"] == len(odd) and got[1]["valid"] and not got[2]["valid"] and not got[None]["valid"] and got[3]["n_turns"] == 2
    assert got[1]["loss_chars"] == sum(len(t or "") for t in odd[1::2])
    assert chat.digest(chat.format_turns(table.limit(0))).count() == 0
    with pytest.raises(ValueError):
        chat.Template(marks={"user": ("<", ">")}, learned=frozenset(), follows={})


def test_html(spark):
    model = html_text.train(250)
    right = 0
    for page in html_pages.pages(60, seed=77):
        nodes = html_text.parse(page, labelled=True)
        y = np.array([n.label for n in nodes])
        y[0] = html_pages.MIXED
        for i in range(1, len(nodes)):
            y[i] = y[nodes[i].parent] if y[i] < 0 else y[i]
        right += html_text.extract([page], model)[0] == html_text.block_text(nodes, y)
    assert right >= 40
    page = "<html><body><nav><ul><li><a href=/>Home</a></li></ul></nav><article><h1>T &amp; x</h1><p>Some  text&nbsp;here,<br>with more of it.<p>And <b>so</b> on.</article><footer>&copy; me</footer>"
    rows = spark.createDataFrame([(1, "u", page, "a"), (2, None, None, "b"), (3, "u", "", "c"), (None, "u", "<div", "d"), (1, "u", page, "a")], "page_id long, url string, html string, text string")
    got = {(r["page_id"], r["text"], r["n_chars"]) for r in html_text.extract_pages(rows, model).collect()}
    want = "T & x\nSome text here, with more of it.\nAnd so on."
    assert got == {(1, want, len(want)), (2, "", 0), (3, "", 0), (None, "", 0)}
    labels = np.log(np.array([[0.2, 0.3, 0.5], [0.9, 0.05, 0.05], [0.1, 0.8, 0.1]]))
    chain = [html_text.Node("#root", -1, ""), html_text.Node("div", 0, ""), html_text.Node("p", 1, "")]
    assert html_text.decode(chain, labels).tolist() in ([2, 0, 0], [2, 1, 1])
