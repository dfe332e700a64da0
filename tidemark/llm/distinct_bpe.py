"""BPE encoding through a table of distinct words, and decoding through an id-to-piece table.

Texts are split into words in Spark; blocks send their distinct words to word shards, where each distinct word of the
corpus is encoded once by the tokenizers library; the ids come back by position. Splitting is exact for the byte-level
pattern: a space that follows a non-space and precedes a non-space always opens a new piece, and so does a single line
feed. Texts with two white-space characters in a row, or with a special token, are split by the full pattern.

Defined results: null and empty texts have no ids and decode to the empty text; repeated rows are encoded row by row;
texts of any length are part of one block; ties in the order of words change no result; an empty table gives no row; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema

from . import blocks as B
from .common import pack, ragged, stage, unpack, unpack_words

VOCABULARY = "byte_bpe_50k.json"
PATTERN = regex.compile(public_tokenizers.PATTERN)
#: Any two white-space characters in a row, of the widest notion of white space.
_DOUBLE = regex.compile(r"[\s\x1c-\x1f\x85]{2}")


@functools.lru_cache(4)
def library(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs a task per core already
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(path)
    made.no_truncation()
    made.no_padding()
    return made


@functools.lru_cache(4)
def special_tokens(path: str) -> tuple[str, ...]:
    with open(path, encoding="utf-8") as f:
        return tuple(t["content"] for t in json.load(f).get("added_tokens", []))


@functools.lru_cache(4)
def pieces(path: str) -> list[bytes]:
    """The id-to-piece table, bounded by the vocabulary: bytes of every id; an unused id has none."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = dict(zip(map(chr, plain), plain))
    letters |= {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}
    vocabulary = library(path).get_vocab(with_added_tokens=True)
    out = [b""] * (max(vocabulary.values(), default=-1) + 1)
    for piece, i in vocabulary.items():
        out[i] = bytes(letters[c] for c in piece) if all(c in letters for c in piece) else piece.encode()
    return out


def splitter(path: str):
    """Words of a text as keys: a key stands for a space and itself; one that opens with a space, for what follows it;
    one that opens with a line feed, for itself."""
    special = special_tokens(path)
    cut = regex.compile("(" + "|".join(map(regex.escape, special)) + ")") if special else None
    marks = [s.encode() for s in special]

    def exact(part: str) -> list[bytes]:
        return [(b" " + p if p[:1] != b" " or len(p) == 1 or p[1:2] in b" \n" else p[1:]) for p in (m.encode() for m in PATTERN.findall(part))]

    def split(text: bytes) -> list[bytes]:
        if not text:
            return []
        plain = text.decode("utf-8", "replace")
        if any(m in text for m in marks):
            out = []
            for k, part in enumerate(cut.split(plain)):
                out += [b" " + part.encode()] if k % 2 else exact(part)
            return out
        if _DOUBLE.search(plain) or text[:1] in b" \n" or text[-1:] in b" \n":
            return exact(plain)
        words = text.replace(b"\n", b" \n").split(b" ")
        words[0] = b" " + words[0]
        return words

    return split


def word_of(key: bytes) -> str:
    return (key[1:] if key[:1] == b" " else key if key[:1] == b"\n" else b" " + key).decode("utf-8", "replace")


def encoded(docs: DataFrame, path: str, block_bytes: int = B.BLOCK_BYTES) -> tuple[DataFrame, DataFrame]:
    """The blocks, and the answers of the word shards (the ids of each distinct word, once per block that asks)."""
    made = stage(B.make_blocks(docs, splitter(path), block_bytes), "bpe-blocks")
    shards = B.shards_for(made)

    def encode(t: pa.Table) -> pa.Table:
        words, index = B.word_index([unpack_words(w) for w in t["words"].to_pylist()])
        ids = [e.ids for e in library(path).encode_batch_fast([word_of(w) for w in words], add_special_tokens=False)]
        lens = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter((i for x in ids for i in x), np.uint32, int(lens.sum()))
        flat = flat.astype(np.uint16) if len(flat) and flat.max() < 65536 else flat
        starts = np.cumsum(lens) - lens
        out = []
        for block, at, own in zip(t["block"].to_pylist(), t["at"].to_pylist(), index):
            n, body = pack(lens[own].astype(np.uint32)), pack(flat[ragged(starts[own], lens[own])], 12, planes=False)
            out.append((block, 0, at, len(n).to_bytes(8, "little") + n + body))
        return B.answers(out)

    sent = B.send_words(made.select("block", "words"), shards)
    return made, sent.groupBy("shard").applyInArrow(encode, B.ANSWER)


def per_document(docs: DataFrame, each, schema: str, vocabulary: str = VOCABULARY, block_bytes: int = B.BLOCK_BYTES) -> DataFrame:
    """Applies ``each(doc_id, ids) -> row`` to the ids of every document, in the task that holds its block."""
    path = public_tokenizers.path(vocabulary)
    made, found = encoded(docs, path, block_bytes)
    out_schema = docs.sparkSession.createDataFrame([], schema).schema
    arrow = to_arrow_schema(out_schema)

    def join(block: pa.Table, ans: pa.Table) -> pa.Table:
        rows = []
        for row in block.to_pylist():
            lens, starts = np.zeros(row["n_words"], np.int64), np.zeros(row["n_words"], np.int64)
            flat, used = [], 0
            for at, a in zip(ans["at"].to_pylist(), ans["answer"].to_pylist()):
                at, k = B.positions(at), int.from_bytes(a[:8], "little")
                n, body = unpack(a[8 : 8 + k]).astype(np.int64), unpack(a[8 + k :])
                lens[at], starts[at] = n, used + np.cumsum(n) - n
                flat.append(body.astype(np.uint32))
                used += len(body)
            flat = np.concatenate(flat) if flat else np.zeros(0, np.uint32)
            tokens, at = unpack(row["tokens"]), 0
            for doc, n in zip(row["doc_ids"], unpack(row["lens"]).tolist()):
                own = tokens[at : at + n]
                at += n
                rows.append(each(doc, flat[ragged(starts[own], lens[own])]))
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [()] * len(arrow), arrow)], schema=arrow)

    blocks = made.select("block", "doc_ids", "lens", "tokens", "n_words")
    return blocks.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(join, schema)


def encode(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, ids of every row."""
    return per_document(docs, lambda doc, ids: (doc, ids.astype(np.int32)), "doc_id LONG, ids ARRAY<INT>", vocabulary)


def decode(rows: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, text of rows (doc_id, ids); null ids give the empty text, ids beyond the vocabulary nothing."""
    path = public_tokenizers.path(vocabulary)

    def run(batches):
        table = pieces(path)
        for b in batches:
            texts = [decoded(i or [], table).decode() for i in b["ids"].to_pylist()]
            yield pa.record_batch([b["doc_id"], pa.array(texts, pa.string())], ["doc_id", "text"])

    return rows.select("doc_id", "ids").mapInArrow(run, "doc_id LONG, text STRING")


def decoded(ids, table: list[bytes]) -> bytes:
    n = len(table)
    try:
        raw = b"".join(map(table.__getitem__, ids))
    except (IndexError, TypeError):
        raw = b"".join(table[i] for i in ids if i is not None and 0 <= i < n)
    return raw.decode("utf-8", "replace").encode()


def query(docs: DataFrame, block_bytes: int = B.BLOCK_BYTES) -> DataFrame:
    path = public_tokenizers.path(VOCABULARY)

    def digest(doc, ids):
        text = decoded(ids.tolist(), pieces(path))
        return doc, len(ids), hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(text).hexdigest()

    return per_document(docs, digest, "doc_id LONG, n_tokens LONG, ids_sha256 STRING, decoded_sha256 STRING", VOCABULARY, block_bytes)
