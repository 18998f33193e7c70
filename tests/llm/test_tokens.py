"""Operators 5, 9 and 10 against the libraries."""

import hashlib
import random
import unicodedata
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lumendex.llm import byte_bpe, common, contract, prefix_counts, scan, token_files

PARTS = ["a", "B", "'", "s", "'ll", "'re", "'T", "'t", " ", "  ", "\n", "\t", "1", "22", "é", "É", "ß", "漢", "!", "…", "Σ", "İ",
         "é", "th", "ing", "<|endoftext|>", "😀", "'ve", "l", "x", "\u00a0", "\x1c", "\x00", "\x85", "٣"]


def noise(n, seed=1, longest=14):
    r = random.Random(seed)
    return ["".join(r.choice(PARTS) for _ in range(r.randint(0, longest))) for _ in range(n)]


@pytest.fixture(scope="module")
def library():
    ranks = byte_bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_classes_are_the_librarys():
    ranks = {bytes([i]): i for i in range(256)}
    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    table = scan.class_table()
    for pattern, kinds in ((r"\p{L}+", (scan.LETTER,)), (r"\p{N}+", (scan.NUMBER,)), (r"\s+", (scan.SPACE, scan.WHITE))):
        e = tiktoken.Encoding("class", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        assert bytes(e.encode_ordinary(every)).decode() == "".join(c for c in every if table[ord(c)] in kinds)


def test_byte_bpe_is_the_librarys(library, monkeypatch):
    texts = [*noise(3000), None, "", " " * 500, "x" * 3000, "'" * 50, "word " * 2000]
    want = [library.encode_ordinary(t or "") for t in texts]
    ids, counts = byte_bpe.ByteBpe().encode_batch(texts)
    assert counts.tolist() == [len(w) for w in want] and ids.tolist() == sum(want, [])
    monkeypatch.setattr(byte_bpe, "CHUNK", 7)
    monkeypatch.setattr(byte_bpe, "REMEMBERED", 50)
    again, same = byte_bpe.ByteBpe().encode_batch(texts)
    assert again.tolist() == ids.tolist() and same.tolist() == counts.tolist()


def test_offsets_lead_back(library):
    bpe = byte_bpe.ByteBpe()
    text = "Don't stop — 漢字 and 123 more"
    ids, _ = bpe.encode_batch([text])
    raw, places = text.encode(), bpe.offsets(ids).tolist()
    assert [raw[a:b] for a, b in zip(places, [*places[1:], len(raw)], strict=True)] == [library.decode_single_token_bytes(i) for i in ids.tolist()]
    assert bpe.decode_bytes(ids) == raw


def test_encode_and_decode_frames(spark):
    df = spark.createDataFrame([(1, "a b", "x"), (2, None, "y"), (None, "", None), (1, "a b", "z")], "doc_id long, text string, ids string")
    out = byte_bpe.encode(df)
    assert sorted((r.doc_id or 0, bytes(r.decoded)) for r in byte_bpe.decode(out).collect()) == [(0, b""), (1, b"a b"), (1, b"a b"), (2, b"")]
    assert byte_bpe.round_trip(df.limit(0)).collect() == []


def test_op5_over_the_table(spark, sf_dir, library):
    rows = {r.doc_id: r.text for r in common.table(spark, sf_dir, "documents").collect()}
    got = contract.op5_byte_bpe(spark, sf_dir).collect()
    assert len(got) == len(rows)
    for r in got:
        ids = library.encode_ordinary(rows[r.doc_id] or "")
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((rows[r.doc_id] or "").encode()).hexdigest()


@pytest.fixture(scope="module")
def words():
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def test_counts_are_the_librarys(words, monkeypatch):
    texts = [*noise(3000), "", None, "z" * 4000, "<|startoftext|>" * 3, "a<|endoftext|>b"]
    want = [len(e.ids) for e in words.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert prefix_counts.Counter().budgets(texts, 4)[0].tolist() == want
    monkeypatch.setattr(prefix_counts, "CHUNK", 9)
    assert prefix_counts.Counter().budgets(texts, 4)[0].tolist() == want


def test_every_prefix(words):
    count = prefix_counts.Counter()
    for text in [t for t in noise(400, 5) if "endoftext" not in t] + ["internationalisation don't we'll the 12,345 naïveté"]:
        plain = count._plain(text)
        table = count.prefix_table(plain)
        each = []
        for n in range(len(plain) + 1):
            each.append(len(words.encode(plain[:n], add_special_tokens=False).ids) if count._plain(plain[:n]) == plain[:n] else None)
        assert [table.at(n) for n, e in enumerate(each) if e is not None] == [e for e in each if e is not None]
        for budget in (0, 1, 3, 1000):
            best = table.longest(budget)
            assert table.at(best) <= budget
            assert all(e > budget for e in each[best + 1 :] if e is not None)
            assert count.budgets([plain], budget)[1].tolist() == [best]


DECOMPOSED = ["e\u0301", "o\u031b\u0301", "q\u0307\u0323", "\u1112\u1161\u11ab", "\u0301", "İ", "Σ", "か\u3099", "a", "'", "r", " ", "\n", "<|endoftext|>", "<|", "!", "—", "é", "1"]


def test_every_prefix_of_the_text_as_given(words):
    count, r = prefix_counts.Counter(), random.Random(2)
    texts = ["".join(r.choice(DECOMPOSED) for _ in range(r.randint(0, 14))) for _ in range(400)] + ["x!<|endoftext|>'re", "'re\u0301 '"]
    for text in texts:
        table = count.prefix_table(text)
        assert [table.at(n) for n in range(len(text) + 1)] == [len(words.encode(text[:n], add_special_tokens=False).ids) for n in range(len(text) + 1)], text
        n = table.longest(3)
        assert table.at(n) <= 3 and count.budgets([text], 3)[1].tolist() == [n]
        assert n == len(text) or unicodedata.normalize("NFC", text[:n]) + unicodedata.normalize("NFC", text[n:]) == unicodedata.normalize("NFC", text)


def test_limits_are_of_the_text_as_given(spark, words):
    text = "e\u0301 " * 3000
    df = spark.createDataFrame([(1, text, "x"), (2, None, "y"), (1, text, "z"), (None, "", None)], "doc_id long, text string, n_tokens string")
    got = prefix_counts.count_tokens(df, 2048).collect()
    first = [r for r in got if r.doc_id == 1]
    n = first[0].chars_in_limit
    assert len(first) == 2 and first[0] == first[1] and first[0].n_tokens == 3000 and first[0].n_bytes == 12000
    fits = lambda k: len(words.encode(text[:k], add_special_tokens=False).ids) <= 2048
    assert n == 3 * 2048 and fits(n) and not fits(n + 1)
    assert {(r.doc_id, r.n_bytes, r.n_tokens, r.over_limit, r.chars_in_limit) for r in got if r.doc_id != 1} == {(2, 0, 0, False, 0), (None, 0, 0, False, 0)}
    assert prefix_counts.count_tokens(df.limit(0), 3).collect() == []
    stored = {r.doc_id: r.counts for r in prefix_counts.prefix_tables(df).collect()}
    assert stored[2] == [0] and len(stored[1]) == 9001 and stored[1][9000] == 3000 and stored[1][3 * 2048] == 2048


def test_words_together_are_words_alone():
    r = random.Random(6)
    tables = prefix_counts.WordTables()
    some = sorted({"".join(r.choices("abcdeinst", k=r.randint(1, 20))) for _ in range(300)} | {"é" * k for k in range(1, 9)} | {"漢字", "x" * 200, "12", "'", "'re", "internationalisation"})
    counts, ends = tables.tables([w.encode() for w in some])
    assert [counts[a:b].tolist() for a, b in zip([0, *ends[:-1]], ends, strict=True)] == [list(tables.table(w)) for w in some]


def test_op9_over_the_table(spark, sf_dir, words):
    rows = {r.doc_id: r.text or "" for r in common.table(spark, sf_dir, "documents").collect()}
    got = contract.op9_token_counts(spark, sf_dir).collect()
    assert len(got) == len(rows)
    for r in got:
        n = len(words.encode(rows[r.doc_id], add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(rows[r.doc_id].encode()), n, n > 2048)


def test_code_lengths_are_optimal_and_limited():
    import heapq

    r = random.Random(3)
    for _ in range(50):
        counts = np.array([r.choice([0, 1, 2, 5, 100, 10000]) for _ in range(r.randint(2, 60))])
        if (counts > 0).sum() < 2:
            continue
        heap = [(int(c), i) for i, c in enumerate(counts) if c]
        heapq.heapify(heap)
        cost = 0
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            cost += a[0] + b[0]
            heapq.heappush(heap, (a[0] + b[0], 0))
        free = token_files.code_lengths(counts, 30)
        assert int((free.astype(int) * counts).sum()) == cost
        bits = int((counts > 0).sum() - 1).bit_length()
        tight = token_files.code_lengths(counts, bits)
        assert tight.max() <= bits and sum(2.0 ** -float(x) for x in tight[tight > 0]) == 1


def test_codec_round_trip():
    r = np.random.default_rng(4)
    ids = np.minimum(r.geometric(0.05, 20000), 300).astype(np.uint32)
    counts = np.array([0, 1, 255, 256, 257, 0, 5000, 1, 20000 - 5770])
    codec = token_files.Codec(token_files.code_lengths(np.bincount(ids)))
    data, places = codec.encode(ids, counts)
    assert codec.decode(data, places, counts).tolist() == ids.tolist()
    one = token_files.Codec(token_files.code_lengths(np.array([0, 7])))
    data, places = one.encode(np.ones(7, np.uint32), np.array([7]))
    assert one.decode(data, places, np.array([7])).tolist() == [1] * 7
    for x in ([], [3], [70000, 1, 1 << 24]):
        assert token_files._unpack(token_files._pack(np.array(x, np.uint32))).tolist() == x


def check_files(spark, df, rows, path):
    h = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    token_files.write(df, path)
    got = sorted(token_files.read(spark, path).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [k for k, _ in rows]
    start = 0
    for r, (_, text) in zip(got, rows, strict=True):
        ids = [*h.encode(text or "", add_special_tokens=False).ids, 2]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_token_files(spark, sf_dir):
    rows = [(None, "no key"), (-5, "a<|endoftext|>b"), (0, None), (1, ""), (2, "x" * 3000), (2, "x" * 3000), (9, "tie  'll\n")]
    df = spark.createDataFrame(rows[::-1], "doc_id long, text string").withColumns({"k": F.lit("k"), "packed": F.lit(1)})
    check_files(spark, df, rows, common.fresh_path(spark, "t"))
    got = {r.doc_id: r.ids for r in token_files.ids_of(spark, _written(spark, df)).collect()}
    assert got[1] == [2]
    table = common.table(spark, sf_dir, "documents")
    check_files(spark, table, sorted((r.doc_id, r.text) for r in table.collect()), common.fresh_path(spark, "t"))
    assert contract.op10_token_files(spark, sf_dir).count() == table.count()


def _written(spark, df):
    path = common.fresh_path(spark, "t")
    token_files.write(df, path)
    return path


def test_token_files_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    path = _written(spark, df)
    assert token_files.read(spark, path).collect() == []
