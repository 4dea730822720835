import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quillspark.llm import bpe, token_ids

SF = "/root/testdata/sf0.001"
ODD = [None, "", " ", "  two  spaces\n\n\tand tabs ", "é́ ñ 日本語 👩‍👩‍👧 ß", "İSTANBUL ǅ ΣΑΣ VELİ. Lİ, x יִ. שׁ? straße! ΟΔΟΣ.", "x" * 5000, "a\x1cb\x85c d e", "<|endoftext|> it's 'S 1234567 ½", "́start", "\x00\x01\x7f", "word " * 3000, "aaaaaaaaaabababab" * 40]


def texts(spark):
    return [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()] + ODD


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(enumerate(texts(spark))), "doc_id long, text string").repartition(3)


def test_encoding_is_the_librarys(spark, docs):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r.doc_id: r for r in bpe.digest(docs).collect()}
    for i, t in enumerate(texts(spark)):
        ids = enc.encode_ordinary(t or "")
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()), repr(t)[:80]


def test_transducer_on_random_strings_of_few_letters():
    ranks = {bytes([k]): k for k in range(256)} | {m: 256 + k for k, m in enumerate([b"ab", b"ba", b"abab", b"aa", b"bab", b"aab", b"abb", b"aaab"])}
    machine, r = bpe.Transducer(ranks), random.Random(1)
    for _ in range(3000):
        s = bytes(r.choice(b"aabc") for _ in range(r.randint(1, 30)))
        assert machine.encode(s) == [ranks[t] for t in ([s] if s in ranks else machine.merged(s))]


def test_decoding_stops_at_whole_characters():
    data = "aé日👩".encode() * 3
    for size in (1, 2, 3, 5):
        s = bpe.Utf8Stream()
        parts = [s.feed(data[k : k + size]) for k in range(0, len(data), size)] + [s.close()]
        assert b"".join(parts) == data and all(p.decode() is not None for p in parts)
    s = bpe.Utf8Stream()
    assert s.feed(b"\xf0\x9f\xff\xc3") + s.close() == b"\xf0\x9f\xff\xc3"


def test_shards_hold_the_librarys_ids(spark, docs, tmp_path):
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    t.encode_special_tokens = True
    manifest = token_ids.write_shards(docs, f"file://{tmp_path}", shards=5)
    got, start = {r.doc_id: r for r in token_ids.read_shards(manifest).collect()}, 0
    for i, text in enumerate(texts(spark)):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 1]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())), repr(text)[:80]
        start += len(ids)
    keys = spark.createDataFrame([(k,) for k in [*range(0, start, 7), -5]], "doc_id long")
    found = {r.doc_id: r.ids for r in token_ids.lookup(manifest, keys).collect()}
    assert set(found) == set(got) & set(range(0, start, 7)) and all(zlib.crc32(np.array(x, "<u4").tobytes()) == got[i].ids_crc32 for i, x in found.items())
    for row in manifest.collect():
        shard = token_ids.Shard(row.path)
        assert shard.find(np.arange(-50, 0)).max() == -1 and shard.find(np.array([10**12])).max() == -1
        assert len(shard.lookup(row.first_id)[0]) == got[row.first_id].n_tokens


def test_chunks_are_encoded_as_in_the_whole_text():
    """Marks after letters that leave combining characters behind, among others."""
    enc, r = token_ids.Encoder(public_tokenizers.path("word_bpe_49k.json")), random.Random(6)
    assert enc.chunked
    parts = [chr(k) for k in (*range(0x41, 0x5B), *range(0xC0, 0x180), *range(0x300, 0x310), *range(0x390, 0x3D0), *range(0x5D0, 0x5EB), *range(0xFB1D, 0xFB4F), *range(0x1E00, 0x1E20), 0x130, 0x1C5, 0x1F88, 0xFB01)] + [*".,;:!?'", " ", " ", "\n", "'s", "1", "_"] * 6
    texts = ["".join(r.choice(parts) for _ in range(r.randint(1, 12))) for _ in range(20_000)]
    for t, got, want in zip(texts, enc.encode(texts), enc.whole(texts), strict=True):
        assert got == want, repr(t)


def test_a_tokenizer_without_known_pieces_encodes_whole_texts():
    enc = token_ids.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["two  spaces ", "a b", ""]
    assert not enc.chunked and enc.encode(texts) == enc.whole(texts)


def test_an_id_that_most_rows_share_is_split(spark, tmp_path):
    rows = [(5, f"{k % 40} text") for k in range(400)] + [(k, "x") for k in range(10)]
    manifest = token_ids.write_shards(spark.createDataFrame(rows, "doc_id long, text string"), f"file://{tmp_path}", shards=6)
    assert max(r.n_docs for r in manifest.collect()) < 250
    got = sorted((r.start, r.doc_id) for r in token_ids.read_shards(manifest).collect())
    assert len(got) == 410 and [i for _, i in got] == sorted(i for i, _ in rows)
    assert token_ids.lookup(manifest, spark.createDataFrame([(5,), (77,)], "doc_id long")).count() == 401


def test_repeated_and_null_ids(spark, tmp_path):
    rows = [(None, "b"), (7, "two"), (7, "one"), (None, None), (3, "")]
    manifest = token_ids.write_shards(spark.createDataFrame(rows, "doc_id long, text string"), f"file://{tmp_path}", shards=1)
    got = sorted((r.start, r.doc_id, r.n_tokens) for r in token_ids.read_shards(manifest).collect())
    assert [x[1] for x in got] == [None, None, 3, 7, 7]
    shard = token_ids.Shard(manifest.collect()[0].path)
    assert len(shard.lookup(7)) == 2 and len(shard.lookup(3)) == 1 and shard.lookup(0) == []


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert token_ids.digest(empty).collect() == [] and bpe.digest(empty).collect() == []


def test_the_index_is_minimal_and_perfect():
    keys = np.random.default_rng(2).integers(-(2**62), 2**62, 5000)
    slots = token_ids.build_index(np.unique(keys))[1]
    assert sorted(slots) == list(range(len(np.unique(keys))))


def test_pieces_and_runs_agree_with_the_library():
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    codec, r = bpe.Codec(*bpe.default_vocabulary()), random.Random(3)
    parts = ["a", "the", "  ", " ", "\n", "\n\n", "\t", "\r\n", "é", "'s", "'ll", "1", "23", ".", "!?", "\x1c", "\x85", "\xa0", "　", "İ", "́", "日本", "👩‍👩", "Z", "--", "_"]
    for _ in range(4000):
        s = "".join(r.choice(parts) for _ in range(r.randint(0, 14)))
        ids = codec.encode(s)
        assert ids == np.array(enc.encode_ordinary(s), "<u4").tobytes(), repr(s)
        assert b"".join(codec.decode(ids, 3)) == s.encode()


def test_rests_of_many_pieces_are_those_of_each(monkeypatch):
    monkeypatch.setattr(bpe, "MOST_TOGETHER", 2000)
    ranks = {bytes([k]): k for k in range(256)} | {m: 256 + k for k, m in enumerate([b"ab", b"ba", b"abab", b"aa", b"bab", b"aab", b"abb", b"aaab"])}
    r = random.Random(5)
    pieces = [bytes(r.choice(b"aabc") for _ in range(r.randint(1, 30))) for _ in range(2000)]
    want = [[ranks[t] for t in ([s] if s in ranks else bpe.Transducer(ranks).merged(s))] for s in pieces[:50]]
    for requests in (1, 3, 1 << 30):
        monkeypatch.setattr(bpe, "REQUESTS", requests)
        machine = bpe.Transducer(ranks, 40)
        got = [np.frombuffer(x, "<u4").tolist() for x in machine.encode_all(pieces)]
        assert got[:50] == want and got == [machine.encode(s) for s in pieces]


def test_new_words_of_many_texts_run_together(monkeypatch):
    """The Python steps of a byte are shared by all words that are new, few or many."""
    r = random.Random(7)
    texts = ["first " + " ".join("".join(r.choice("bcdfgaeiouéß") for _ in range(r.randint(6, 14))) + r.choice(["", ".", ",\nso"]) for _ in range(100)) for _ in range(60)]
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    alone, together, of_one, of_all = [], [], bpe.Transducer.rest, bpe.Transducer.rests
    monkeypatch.setattr(bpe.Transducer, "rest", lambda self, s, data: alone.append(data) or of_one(self, s, data))
    monkeypatch.setattr(bpe.Transducer, "rests", lambda self, last, data: together.append(len(data)) or of_all(self, last, data))
    codec = bpe.Codec(*bpe.default_vocabulary())
    got = list(codec.encode_all(texts))
    assert got == [np.array(enc.encode_ordinary(t), "<u4").tobytes() for t in texts]
    assert len(together) == 1 and together[0] > 5000 and len(alone) < 60


@pytest.mark.parametrize("most_runs, most_bytes", [(4, bpe.MOST_BYTES), (1 << 17, (3000, 3000)), (50, (600, 900)), (1 << 17, bpe.MOST_BYTES)])
def test_groups_of_odd_runs_agree_with_the_library(monkeypatch, most_runs, most_bytes):
    monkeypatch.setattr(bpe, "MOST_RUNS", most_runs)
    monkeypatch.setattr(bpe, "MANY", 1)
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    codec, r = bpe.Codec(*bpe.default_vocabulary(), most_bytes), random.Random(9)
    parts = ["a", "the", "zqxj", " ", " ", "  ", "\n", "\n\n", " \n", "\n ", "\t", "\r\n", "é", "'s", "'ll", "1", "23", ".", "!?", "\x00", "\x1c", "\x85", "\xa0", "\u3000", "\u2028", "\u180e", "\u200b", "İ", "́", "日本", "👩‍👩", "--", "_", "w" * 300]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 40))) for _ in range(400)]
    assert list(codec.encode_all(iter(texts))) == [np.array(enc.encode_ordinary(t), "<u4").tobytes() for t in texts]
    assert codec.runs.size <= most_bytes[1]


def test_lookup_of_many_keys():
    r = random.Random(8)
    known = {r.randrange(1 << 40): k for k in range(3000)}
    table, keys = bpe.Lookup(known), np.array([*known, *(r.randrange(1 << 40) for _ in range(3000))])
    assert table.get(keys).tolist() == [known.get(k, -1) for k in keys.tolist()]
    assert bpe.Lookup({}).get(keys).max() == -1 and len(table.get(keys[:0])) == 0


def test_states_stay_under_their_limit_in_one_long_piece():
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    machine, r = bpe.Transducer(ranks, 500), random.Random(4)
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    s = "".join(r.choice("abcdefghij") for _ in range(40_000))
    assert machine.encode(s.encode()) == enc.encode_ordinary(s) and len(machine.states) <= 502


def test_clashing_columns_and_repeated_rows(spark):
    rows = [(1, "one two", 7, "x"), (1, "one two", 8, "y"), (None, None, 9, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int, ids_sha256 string").withColumn("start", F.lit("s"))
    got = sorted((r.doc_id or 0, r.n_tokens) for r in bpe.digest(docs).collect())
    assert got == [(0, 0), (1, 2), (1, 2)]
    got = sorted((r.start, r.n_tokens) for r in token_ids.digest(docs).collect())
    assert got == [(0, 1), (1, 3), (4, 3)]
