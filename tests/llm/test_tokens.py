"""Token operators against the tokenizers library."""

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from conftest import ODD
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from tokenizers.models import BPE

from tidemark.llm import distinct_bpe, rans

SMALL = "/root/testdata/sf0.001"
RANDOM = random.Random(5)
PARTS = ["a", "Word", " ", "  ", "\n", "\n\n", "\t", " ", " ", ".", ",", "'s", "'ll", "1", "23", "é", "日本", "#", "<|endoftext|>", "\x1c", "\x85", "é", "ẖ", "H̱", "Σ", "İ", "‍", "🙂"]
MIXED = [(1000 + k, "".join(RANDOM.choice(PARTS) for _ in range(RANDOM.randint(1, 40)))) for k in range(400)]


def pairs(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


@pytest.fixture(params=["odd", "mixed", "table", "empty"])
def docs(request, spark, documents):
    return {"odd": lambda: documents(ODD), "mixed": lambda: documents(MIXED), "empty": lambda: documents(ODD).limit(0),
            "table": lambda: spark.read.parquet(f"{SMALL}/documents.parquet")}[request.param]()


def bpe(docs):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    out = []
    for i, x in docs:
        ids = t.encode(x or "", add_special_tokens=False).ids
        out.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                    hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    return sorted(out, key=repr)


def test_distinct_bpe(docs):
    got = distinct_bpe.query(docs, block_bytes=20_000).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()
    assert sorted(map(tuple, got), key=repr) == bpe(pairs(docs))


def test_bpe_round_trip(documents):
    docs = documents(MIXED)
    back = distinct_bpe.decode(distinct_bpe.encode(docs)).collect()
    assert {r.doc_id: r.text for r in back} == dict(MIXED)


def test_rans_files(docs):
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = pairs(docs)
    got = rans.query(docs, block_tokens=3000, lanes=64, mark_steps=7, shard_bytes=50_000).select("doc_id", "start", "n_tokens", "ids_crc32").collect()
    ids = {}
    for i, x in rows:
        ids.setdefault(i, []).append(t.encode(x or "", add_special_tokens=False).ids + [1])
    got = sorted(map(tuple, got), key=lambda r: r[1])
    assert [r[0] for r in got] == sorted((i for i, _ in rows), key=lambda i: -1 if i is None else i)
    before = 0
    for i, start, n, c in got:
        assert start == before
        before += n
        assert (n, c) in [(len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for x in ids[i]]
    assert sorted(n for _, _, n, _ in got) == sorted(len(x) for v in ids.values() for x in v)


@pytest.mark.parametrize("n", [1, 63, 64, 65, 1000, 70_000])
def test_rans_round_trip_and_checkpoints(n):
    rng = np.random.default_rng(n)
    ids = (rng.zipf(1.3, n) % 50_000).astype(np.uint32)
    table = rans.Table.of(np.bincount(ids, minlength=50_000))
    assert int(table.freq.sum()) == 1 << table.precision and (table.freq[np.unique(ids)] > 0).all()
    words, marks = rans.encode(ids, table, 64, 10)
    assert (rans.decode(words, marks, table, n, 64) == ids).all()
    for m, end in zip(marks[::-1], [-(-n // 64), *[m[0] for m in marks[:0:-1]]]):  # any part, in any order
        assert (rans.decode_part(words, m, table, m[0], end, n, 64) == ids[m[0] * 64 : min(n, end * 64)]).all()


def test_rans_notices_damage(documents, tmp_path):
    docs = documents(ODD)
    rans.write(docs, f"{tmp_path}/a", lanes=4)
    rows = docs.sparkSession.read.parquet(f"{tmp_path}/a/blocks")
    rows.withColumn("words", F.encode(F.regexp_replace(F.hex("words"), "^.", "0"), "utf-8")).write.parquet(f"{tmp_path}/b/blocks")
    docs.sparkSession.read.parquet(f"{tmp_path}/a/tables").write.parquet(f"{tmp_path}/b/tables")
    with pytest.raises(Exception, match="damaged"):
        rans.read(docs.sparkSession, f"{tmp_path}/b", lambda d, i: (d,), "doc_id LONG").collect()


def test_rans_leaves_the_case_of_added_tokens():
    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    texts = ["<|ENDOFTEXT|>", "A <|endoftext|> B.", "Ab<|EndOfText|>Cd, <|STARTOFTEXT|>. X", "<|endoftext|>Ab<|startoftext|>", "Plain Text."]
    got = rans.token_bytes([x.encode() for x in texts], path)
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [t.encode(x, add_special_tokens=False).ids + [1] for x in texts]


def test_rans_plain_words_have_the_library_ids():
    rng = random.Random(3)
    letters = "aZéÉßÿÀñçøØ÷×µªº19.,'’#%$!_-|<>~`ſKİıǅ日本 \t\n̈́ﬁ"
    odd = ["".join(rng.choice(letters) for _ in range(rng.randrange(14))) for _ in range(4000)] + ["it's", "<|ENDOFTEXT|>", "a<|endoftext|>b", "don’t", "x'S"]
    path = public_tokenizers.path(rans.VOCABULARY)
    assert rans.model_of(path) is not None
    want = rans.library(path).encode_batch_fast(odd, add_special_tokens=False)
    assert rans.token_bytes([w.encode() for w in odd], path) == [np.array([*e.ids, rans.END], "<u4").tobytes() for e in want]


def test_rans_looks_a_known_word_up_once():
    path = public_tokenizers.path(rans.VOCABULARY)
    t = Tokenizer.from_file(path)
    texts = ["a word, don't 日本 a WORD. x;y", "", "日本 don't a <|endoftext|> word", "façade (a) façade."]
    want = [np.array([*t.encode(x, add_special_tokens=False).ids, rans.END], "<u4").tobytes() for x in texts]

    class Counted(rans.Words):
        looked = 0

        def __contains__(self, word):
            self.looked += 1
            return super().__contains__(word)

        def __missing__(self, word):
            self.looked += 1
            return super().__missing__(word)

    rans._memo[path] = Counted(path)
    try:
        assert rans.token_bytes([x.encode() for x in texts], path) == want
        cold = rans._memo[path].looked
        assert rans.token_bytes([x.encode() for x in texts], path) == want
        assert rans._memo[path].looked == cold and not rans._memo[path].later
    finally:
        del rans._memo[path]


def test_rans_forgets_words_and_keeps_their_ids(monkeypatch):
    path = public_tokenizers.path(rans.VOCABULARY)
    t = Tokenizer.from_file(path)
    rng = random.Random(4)
    texts = [" ".join(rng.choice(["a", "it's", "日本", "étude", "long" * 3, "X.", "q;r"]) + rng.choice(["", str(k), "日"]) for _ in range(20)) for k in range(60)]
    want = [np.array([*t.encode(x, add_special_tokens=False).ids, rans.END], "<u4").tobytes() for x in texts]
    for most in (0, 5, 40):
        monkeypatch.setattr(rans, "MEMO", most)
        rans._memo.pop(path, None)
        got = [b for at in range(0, 60, 3) for b in rans.token_bytes([x.encode() for x in texts[at : at + 3]], path)]
        assert got == want
    rans._memo.pop(path, None)


def test_rans_chunks_hold_every_row_once(monkeypatch):
    monkeypatch.setattr(rans, "CHUNK_BYTES", 10)
    texts = ["x" * 4, None, "é" * 3, "y", "z" * 50, "", "w" * 10, None]
    parts = list(rans._chunks(pa.record_batch([pa.array(texts)], ["text"]), "text"))
    assert [x for p in parts for x in p["text"].to_pylist()] == texts
    assert all(p.num_rows == 1 or sum(map(len, rans.utf8(p["text"]))) <= 10 for p in parts)
    assert list(rans._chunks(pa.record_batch([pa.array([], pa.string())], ["text"]), "text")) == []


def test_rans_encodes_each_new_run_once_and_many_at_a_time(monkeypatch):
    path = public_tokenizers.path(rans.VOCABULARY)
    t = Tokenizer.from_file(path)
    rng = random.Random(6)
    stems = ["".join(rng.choice("abcdeßéñ") for _ in range(8)) for _ in range(1500)]
    texts = [" ".join(rng.choice(stems).upper() + rng.choice(["", "", ".", ",", "..", "%%%", "&c"]) for _ in range(300)) + " it's 日本." for _ in range(20)]
    calls, encode = [], rans._encode_runs
    monkeypatch.setattr(rans, "_encode_runs", lambda p, runs: calls.append(runs) or encode(p, runs))
    rans._memo.pop(path, None)
    rans.model_of(path)
    calls.clear()
    want = [np.array([*t.encode(x, add_special_tokens=False).ids, rans.END], "<u4").tobytes() for x in texts]
    assert rans.token_bytes([x.encode() for x in texts], path) == want
    runs = [r for part in calls for r in part]
    assert len(runs) == len(set(runs)) > 1000 and len(calls) == -(-len(runs) // 1000)
    calls.clear()
    assert rans.token_bytes([x.encode() for x in reversed(texts)], path) == want[::-1] and not calls
    rans._memo.pop(path, None)


def test_rans_counts_ids_of_runs_without_an_end_piece(tmp_path):
    file = f"{tmp_path}/small.json"
    vocabulary = {p: i for i, p in enumerate(["a", "b", "c", "ab", "c</w>", "a</w>", "bc</w>"])}  # b has no piece that ends a run
    Tokenizer(BPE(vocab=vocabulary, merges=[("a", "b"), ("b", "c</w>")], end_of_word_suffix="</w>")).save(file)
    runs = ["abc", "ab", "b", "bc", "a", "aab", "cab"]
    for part in (runs, ["abc", "bc", "a"], ["b"]):
        ids, lens = rans._encode_runs(file, part)
        want = [[t.id for t in rans.library(file).model.tokenize(r)] for r in part]
        assert lens.tolist() == [len(w) for w in want] and ids.tolist() == sum(want, [])


def test_rans_keeps_the_words_that_come_again(monkeypatch):
    path = public_tokenizers.path(rans.VOCABULARY)
    monkeypatch.setattr(rans, "MEMO", 8)
    rans._memo.pop(path, None)
    for text in (b"often once", b"often rare some", b"often more than eight words in all", b"often"):
        rans.token_bytes([text], path)
    kept = rans._memo.pop(path).words.to_pylist()
    assert kept == [b"", b"often"]


def test_rans_parts_stops_from_words():
    texts = ["a. b, c.. d., e,. f.", "1, 2. é. é, x.y z,\tq.\n#. ,", ". , a", "a,b.c", "", "e.\x0bf,\x0cg.\rh,"]
    path = public_tokenizers.path(rans.VOCABULARY)
    words = rans.Words(path)
    want = [re.sub(rb"[.,](?=[ \t-\r]|\Z)(?<=[0-9A-Za-z][.,])", rb" \g<0>", x.encode()) for x in texts]
    assert [words.cleaned(x.encode()) for x in texts] == want
    t = Tokenizer.from_file(path)
    assert rans.token_bytes([x.encode() for x in texts], path) == [np.array([*t.encode(x, add_special_tokens=False).ids, rans.END], "<u4").tobytes() for x in texts]
