"""Static range asymmetric numeral system for token ids: shared frequency tables, independent interleaved blocks.

File format
    A folder of Parquet files, committed by Spark: ``blocks`` (one row per block, in ascending order of document) and
    ``tables`` (one row: the frequencies of all symbols, shared by every block). A block holds whole documents:

    ========== =========================================================================================
    shard, seq  order of the blocks: by shard, then by the number of their first document in the shard
    doc_ids     ids of its documents, in order
    lens        packed token counts of these documents
    lanes       number of interleaved coders; token i belongs to lane i mod lanes
    words       32-bit renormalisation words, in the order in which the decoder reads them
    marks       checkpoints: every ``MARK_STEPS`` steps the decoder's states and the place in ``words``
    crc_words, crc_ids   checksums of the payload and of the ids as little-endian 32-bit numbers
    ========== =========================================================================================

    Blocks decode independently of each other; checkpoints let the parts of one block be decoded in parallel.

Coder: 63-bit states, 32-bit words, frequencies that sum to 2 ** ``precision``; every symbol that occurs has at least 1.

Defined results: null and empty texts are the end id alone; rows with a null id come first; repeated ids keep one entry
per row, next to each other and ordered by their text; an empty table gives no block;
texts of any length are part of one block; symbols of equal frequency are in order of their ids; other columns are ignored, whatever their
names.
"""

from __future__ import annotations

import codecs
import math
import re
import uuid
import zlib
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import checkpoint_dir
from .common import pack, ragged, stage, unpack, utf8
from .distinct_bpe import library, special_tokens

VOCABULARY = "word_bpe_49k.json"
END = 1
LANES = 512
BLOCK_TOKENS = 1 << 18
MARK_STEPS = 256
LOW = np.uint64(1 << 31)
SHIFT = np.uint64(32)
#: Text of one shard, about; a shard is one sorted partition and so one file.
SHARD_BYTES = 32 << 20
#: Words remembered per worker: about 50 bytes each.
MEMO = 750_000
#: Text that is split into words at the same time; a longer text is alone.
CHUNK_BYTES = 8 << 20


class Table:
    """Frequencies of a shared table, and the arrays that coding needs."""

    def __init__(self, freq: np.ndarray, precision: int):
        self.freq, self.precision = freq.astype(np.uint64), precision
        self.start = np.cumsum(self.freq) - self.freq
        self.limit = ((LOW >> np.uint64(precision)) << np.uint64(32)) * self.freq
        self.rest = np.uint64(1 << precision) - self.freq
        self._slots = None

    @property
    def slots(self):
        """Symbol, frequency and place inside the symbol's slots, of every slot; only the decoder needs them."""
        if self._slots is None:
            n = self.freq.astype(np.int64)
            symbol = np.repeat(np.arange(len(n), dtype=np.uint32), n)
            self._slots = symbol, self.freq[symbol], np.arange(len(symbol), dtype=np.uint64) - self.start[symbol]
        return self._slots

    @classmethod
    def of(cls, counts: np.ndarray) -> "Table":
        """Frequencies in proportion to ``counts``; those that occur get at least 1, the rest 0."""
        used = np.flatnonzero(counts)
        precision = max(16, math.ceil(math.log2(max(1, len(used)))) + 2)
        total, freq = 1 << precision, np.zeros(len(counts), np.int64)
        if len(used):
            share = counts[used] * (total / counts[used].sum())
            got = np.maximum(1, np.floor(share)).astype(np.int64)
            while (off := total - int(got.sum())) != 0:  # give or take one each, largest first
                order = np.argsort(-got, kind="stable")[: abs(off)]
                if off < 0:
                    order = order[got[order] > 1]
                got[order] += 1 if off > 0 else -1
            freq[used] = got
        return cls(freq, precision)


def encode(ids: np.ndarray, table: Table, lanes: int = LANES, mark_steps: int = MARK_STEPS):
    """(words, marks) of one block; ``marks`` are (step, place, states) for step 0, mark_steps, 2 mark_steps, …"""
    n = len(ids)
    x = np.full(lanes, LOW, np.uint64)
    emitted, marks = [], []
    steps = -(-n // lanes)
    for first in range((steps - 1) // mark_steps * mark_steps, -1, -mark_steps):
        part = ids[first * lanes : (first + mark_steps) * lanes]
        freq, limit, start, rest = table.freq[part], table.limit[part], table.start[part], table.rest[part]
        for at in range((len(part) - 1) // lanes * lanes, -1, -lanes):
            f = freq[at : at + lanes]
            own = x[: len(f)]
            over = own >= limit[at : at + lanes]
            emitted.append(own[over].astype(np.uint32))  # the low 32 bits
            own = np.where(over, own >> SHIFT, own)
            x[: len(f)] = own + own // f * rest[at : at + lanes] + start[at : at + lanes]  # (q << precision) + (own - q * f) + start
        marks.append((first, len(emitted), x.copy()))
    emitted.reverse()
    sizes = np.cumsum([0, *map(len, emitted)])
    words = np.concatenate(emitted) if emitted else np.zeros(0, np.uint32)
    return words, [(step, int(sizes[steps - made]), states) for step, made, states in reversed(marks)]


def decode_part(words: np.ndarray, mark, table: Table, first: int, last: int, n: int, lanes: int) -> np.ndarray:
    """The ids of steps ``first`` to ``last`` of a block of n ids, from the checkpoint at ``first``."""
    _, place, states = mark
    x, k = states.copy(), np.uint64(table.precision)
    low = np.uint64((1 << table.precision) - 1)
    symbol, freq, place_in = table.slots
    slots = np.empty(min(n, last * lanes) - first * lanes, np.uint32)
    at = 0
    for step in range(first, last):
        size = min(lanes, n - step * lanes)
        own = x[:size]
        slot = (own & low).view(np.int64)
        slots[at : at + size] = slot
        at += size
        own = freq[slot] * (own >> k) + place_in[slot]
        under = own < LOW
        more = np.count_nonzero(under)
        own[under] = (own[under] << SHIFT) | words[place : place + more]
        place += more
        x[:size] = own
    return symbol[slots]


def decode(words: np.ndarray, marks: list, table: Table, n: int, lanes: int = LANES) -> np.ndarray:
    steps = -(-n // lanes)
    ends = [m[0] for m in marks[1:]] + [steps]
    parts = [decode_part(words, m, table, m[0], end, n, lanes) for m, end in zip(marks, ends)]
    return np.concatenate(parts) if parts else np.zeros(0, np.uint32)


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


# -- tokens -------------------------------------------------------------------------------------------------------------

#: Marks that compose with a Latin letter are in U+0300 to U+036F; with them, case must stay as it is before composition.
_COMBINING = (b"\xcc", b"\xcd")
#: A stop after an ASCII letter or digit is a piece of its own: words with and without it are one word then.
_STOPS = [(re.compile(mark + rb"(?=[ \t-\r]|\Z)(?<=[0-9A-Za-z]" + mark + rb")"), b" " + stop) for stop, mark in ((b".", rb"\."), (b",", b","))]


#: Runs into which the vocabulary splits words of lower-case Latin letters, digits and ASCII signs without apostrophes.
_RUNS = re.compile("[a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9]|[!-&(-/:-@\\[-`{-~]+")
_PLAIN = re.compile("[a-z\u00df-\u00f6\u00f8-\u00ff0-9!-&(-/:-@\\[-`{-~]+")
#: Characters that stand for the bytes of a piece: bytes without a printable Latin-1 character have one from 256 on, in order.
_EXTRA = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255)]
_SHOWN = "".join(chr(256 + _EXTRA.index(b) if b in _EXTRA else b) for b in range(256))


@lru_cache
def _bare(path: str):
    """The vocabulary's model alone, over text that is cut at blanks; and which ids end a run."""
    from tokenizers import Tokenizer, pre_tokenizers

    model = library(path).model
    made = Tokenizer(model)
    made.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
    vocabulary, suffix = made.get_vocab(), model.end_of_word_suffix
    last = np.zeros(max(vocabulary.values(), default=-1) + 1, bool)
    last[[i for piece, i in vocabulary.items() if suffix and piece.endswith(suffix)]] = True
    return made, last


def _encode_runs(path: str, runs: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of runs in order, and each run's number of ids."""
    model, last = _bare(path)
    text = " ".join(runs)
    if not text.isascii():
        text = codecs.charmap_decode(text.encode(), "strict", _SHOWN)[0].replace(_SHOWN[32], " ")
    ids = np.array(model.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
    ends = np.flatnonzero(last[ids]) + 1
    if len(ends) == len(runs) and ends[-1] == len(ids):
        return ids, np.diff(ends, prepend=0)
    found = model.encode(text, add_special_tokens=False)  # a run may have no id that ends it; this call numbers the runs, in more time
    return np.array(found.ids, np.uint32), np.bincount(np.array(found.word_ids, np.int64), minlength=len(runs))


def _run_ids(path: str) -> Callable[[list[str]], tuple[np.ndarray, np.ndarray]]:
    """Ids of plain words by the vocabulary's model alone: all of them in order, and each word's number of ids."""

    def ids(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        flat, sizes = [], []
        for word in words:
            if word.isalpha():
                flat.append(word)
                sizes.append(1)
            else:
                own = _RUNS.findall(word)
                flat += own
                sizes.append(len(own))
        runs = pa.array(flat, pa.large_string()).dictionary_encode()  # each distinct run is encoded once
        distinct = runs.dictionary.to_pylist()
        made = [_encode_runs(path, distinct[at : at + 1000]) for at in range(0, len(distinct), 1000)]
        found, lens = (np.concatenate(x) for x in zip(*made))
        of = runs.indices.to_numpy()
        starts, counts = (np.cumsum(lens) - lens)[of], lens[of]
        ends = np.cumsum(counts)[np.cumsum(sizes) - 1]
        return found[ragged(starts, counts)], np.diff(ends, prepend=0)

    return ids


@lru_cache
def model_of(path: str) -> Callable | None:
    """The vocabulary's model without the steps around it, if runs through it have the library's ids on a few words that show these steps."""
    ids = _run_ids(path)
    probes = ["the", "unbelievable", "fa\u00e7ade", "wei\u00df!!", "a1b22.###", "x|y_z", "\u00e0\u00ed"]
    found, lens = ids(probes)
    want = [e.ids for e in library(path).encode_batch_fast(probes, add_special_tokens=False)]
    return ids if lens.tolist() == [len(x) for x in want] and found.tolist() == sum(want, []) else None


class Words:
    """Ids of the words met so far, as little-endian 32-bit numbers: two Arrow columns, compact enough to outlive a task.

    New plain words are encoded by the model alone, many at a time: several times as fast as a call of the library for each.
    Other new words are noted in ``later``; the library encodes them.
    """

    def __init__(self, path: str):
        self.path, self.model, self.later = path, model_of(path), []
        self.words = self.ids = pa.array([b""], pa.large_binary())
        self.met = np.ones(1, np.int64)
        self.added = [s.encode().lower() for s in special_tokens(path)]
        self.special = re.compile(b"|".join(map(re.escape, self.added)) if self.added else b"(?!)", re.IGNORECASE).search

    def cleaned(self, text: bytes) -> bytes:
        """The text with words as they are looked up, between white space."""
        low = text.lower()
        if any(m in low for m in self.added):  # the library finds added tokens before it changes case
            low = b" ".join(w if self.special(w) or any(m in w for m in _COMBINING) else w.lower() for w in text.split())
        elif any(m in text for m in _COMBINING):
            low = text
        for pattern, apart in _STOPS:
            low = pattern.sub(apart, low)
        return low

    def look_up(self, words: pa.Array) -> pa.Array:
        """The ids of each of the distinct ``words``."""
        if len(self.words) > MEMO:
            self.forget()
        at = pc.index_in(words, value_set=self.words)
        new = words.filter(pc.is_null(at))
        at = pc.fill_null(at, -1).to_numpy(zero_copy_only=False).astype(np.int64)
        self.met[at[at >= 0]] += 1
        if len(new):
            at[at < 0] = np.arange(len(self.words), len(self.words) + len(new))
            self.ids = pa.concat_arrays([self.ids, self.encoded(new.to_pylist())])
            self.words = pa.concat_arrays([self.words, new])
            self.met = np.concatenate([self.met, np.ones(len(new), np.int64)])
        return self.ids.take(pa.array(at))

    def encoded(self, words: list[bytes]) -> pa.Array:
        blob = b"\n".join(words)
        texts = blob.decode("utf-8", "replace").lower().split("\n") if words else []
        plain = [self.model is not None and _PLAIN.fullmatch(t) is not None for t in texts]
        if self.special(blob):
            plain = [p and not self.special(w) for p, w in zip(plain, words)]
        self.later = [w for p, w in zip(plain, words) if not p]
        made = [self.settle()]
        if any(plain):
            ids, lens = self.model([t for p, t in zip(plain, texts) if p])
            ends = np.concatenate([[0], np.cumsum(4 * lens)]).astype(np.int64)
            made.append(pa.Array.from_buffers(pa.large_binary(), len(lens), [None, pa.py_buffer(ends), pa.py_buffer(ids.astype("<u4"))]))
        order = np.empty(len(words), np.int64)
        order[np.argsort(plain, kind="stable")] = np.arange(len(words))  # the library's words are first
        return pa.concat_arrays(made).take(pa.array(order))

    def settle(self) -> pa.Array:
        """The library's ids for the words in ``later``."""
        new, self.later, out = self.later, [], []
        for at in range(0, len(new), 20_000):
            part = [w.decode("utf-8", "replace") for w in new[at : at + 20_000]]
            out += [np.array(e.ids, "<u4").tobytes() for e in library(self.path).encode_batch_fast(part, add_special_tokens=False)]
        return pa.array(out, pa.large_binary())

    def forget(self) -> None:
        """Keeps the words that several chunks had; the others are the rare ones."""
        kept = np.flatnonzero(self.met > 1)
        kept = np.union1d(kept if len(kept) <= MEMO // 2 else [], [0]).astype(np.int64)  # the first is the empty word
        self.words, self.ids, self.met = self.words.take(pa.array(kept)), self.ids.take(pa.array(kept)), np.ones(len(kept), np.int64)


_memo: dict[str, Words] = {}


def token_bytes(texts: list[bytes], path: str, end: int = END) -> list[bytes]:
    """Ids of each text and the end id, as little-endian 32-bit numbers.

    The vocabulary drops white space and never lets a piece cross it, so a text is the sequence of its words. Each distinct
    word of ``texts`` is looked up once, and encoded once per worker while its memory of words lasts.
    """
    if path not in _memo:
        _memo[path] = Words(path)
    memo, last = _memo[path], end.to_bytes(4, "little")
    # Arrow's white space is that of bytes.split; blanks at the ends of a text make empty words, which have no ids.
    split = pc.ascii_split_whitespace(pa.array([memo.cleaned(t) for t in texts], pa.large_binary()).view(pa.large_string()))
    words = split.flatten().dictionary_encode()
    ids = memo.look_up(words.dictionary.view(pa.large_binary())).take(words.indices)
    bounds = np.frombuffer(ids.buffers()[1], np.int64)[split.offsets.to_numpy()].tolist() if len(ids) else [0] * (len(texts) + 1)
    data = memoryview(ids.buffers()[2] or b"")
    return [bytes(data[i:j]) + last for i, j in zip(bounds, bounds[1:])]


def _chunks(batch: pa.RecordBatch, column: str):
    """Slices of a batch with ``CHUNK_BYTES`` of the column each, or one row."""
    ends, at = np.cumsum(pc.fill_null(pc.binary_length(batch[column]), 0).to_numpy(zero_copy_only=False), dtype=np.int64), 0
    while at < len(ends):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + CHUNK_BYTES, "right")))
        yield batch.slice(at, to - at)
        at = to


def _packed(ids: bytes) -> bytes:
    """Ids in 16 bits where they fit, behind one byte that says so; the staged table's pages are compressed."""
    a = np.frombuffer(ids, "<u4")
    return b"\4" + ids if a.max() > 65535 else b"\2" + a.astype("<u2").tobytes()


def _unpacked(b: bytes) -> np.ndarray:
    return np.frombuffer(b, f"<u{b[0]}", offset=1)


def tokenised(docs: DataFrame, tokenise: Callable[[list[bytes]], list[bytes]], shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(shard, seq, doc_id, ids) in ascending order of doc_id: shards are ranges of ids, written as one file each.

    The range bounds come from a sample of ids that Spark takes; a range's size is bounded by the number of shards, and
    documents with one and the same id are spread by their text's hash.
    """
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, -(-total // shard_bytes))
    ordered = rows.withColumn("tie", F.xxhash64("text"))
    ordered = ordered.repartitionByRange(shards, "doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text")

    def run(batches):
        shard, seq = TaskContext.get().partitionId(), 0
        for b in batches:
            for part in _chunks(b, "text"):
                ids = tokenise(utf8(part["text"]))
                n = len(ids)
                yield pa.record_batch([pa.array(np.full(n, shard), pa.int32()), pa.array(np.arange(seq, seq + n)), part["doc_id"].cast(pa.int64()),
                                       pa.array([_packed(x) for x in ids], pa.binary())], ["shard", "seq", "doc_id", "ids"])
                seq += n

    return stage(ordered.mapInArrow(run, "shard INT, seq LONG, doc_id LONG, ids BINARY"), "rans-ids")


def shared_table(ids: DataFrame) -> DataFrame:
    """(symbol, freq) of all symbols: counts over all ids, brought to the coder's precision.

    Every task counts its own ids first; at most one row per symbol of the vocabulary and task is shuffled.
    """

    def count(batches):
        total = np.zeros(0, np.int64)
        for b in batches:
            own = np.concatenate([_unpacked(x) for x in b["ids"].to_pylist()] or [np.zeros(0, np.int64)])
            n = np.bincount(own.astype(np.int64), minlength=len(total))  # bincount's own cast is several times as slow
            n[: len(total)] += total
            total = n
        used = np.flatnonzero(total)
        yield pa.record_batch([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], ["symbol", "n"])

    return ids.select("ids").mapInArrow(count, "symbol LONG, n LONG").groupBy("symbol").agg(F.sum("n").alias("n"))


def frequencies(counts: DataFrame) -> Table:
    """The table on the driver: bounded by the vocabulary (12 bytes an id)."""
    rows = counts.toPandas()
    n = np.zeros(int(rows.symbol.max()) + 1 if len(rows) else 0, np.int64)
    n[rows.symbol.to_numpy(np.int64)] = rows.n.to_numpy(np.int64)
    return Table.of(n)


MARK = pa.struct([("step", pa.int64()), ("place", pa.int64()), ("states", pa.binary())])
BLOCK = pa.schema([("shard", pa.int32()), ("seq", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lens", pa.binary()), ("n_tokens", pa.int64()),
                   ("lanes", pa.int32()), ("words", pa.binary()), ("marks", pa.list_(MARK)), ("crc_words", pa.int64()), ("crc_ids", pa.int64())])
BLOCK_DDL = ("shard INT, seq LONG, doc_ids ARRAY<LONG>, lens BINARY, n_tokens LONG, lanes INT, words BINARY, "
             "marks ARRAY<STRUCT<step: LONG, place: LONG, states: BINARY>>, crc_words LONG, crc_ids LONG")


def write(docs: DataFrame, path: str, tokenise: Callable | None = None, vocabulary: str = VOCABULARY, block_tokens: int = BLOCK_TOKENS,
          lanes: int = LANES, mark_steps: int = MARK_STEPS, shard_bytes: int = SHARD_BYTES) -> None:
    """Encodes every document of ``docs`` and writes ``path``/blocks and ``path``/tables."""
    spark, file = docs.sparkSession, public_tokenizers.path(vocabulary)
    ids = tokenised(docs, tokenise or (lambda texts: token_bytes(texts, file)), shard_bytes)
    table = frequencies(shared_table(ids))
    spark.createDataFrame([(table.precision, pack(table.freq))], "precision INT, freq BINARY").coalesce(1).write.parquet(f"{path}/tables")
    freq, precision = spark.sparkContext.broadcast(pack(table.freq)), table.precision

    def run(batches):
        shared = Table(unpack(freq.value).astype(np.int64), precision)
        docs, parts, size, shard, seq = [], [], 0, None, 0

        def block():
            own = np.concatenate(parts).astype(np.uint32)
            words, marks = encode(own, shared, lanes, mark_steps)
            made = [{"step": s, "place": p, "states": x.tobytes()} for s, p, x in marks]
            lens = np.fromiter(map(len, parts), np.uint32, len(parts))
            row = [shard, seq, docs, pack(lens), len(own), lanes, words.tobytes(), made, zlib.crc32(words.tobytes()), crc(own)]
            return pa.record_batch([pa.array([v], f.type) for v, f in zip(row, BLOCK)], schema=BLOCK)

        # A task reads pieces of the shards' files, rows in order: a block ends where the next row does not follow.
        for b in batches:
            for s, n, doc, x in zip(b["shard"].to_pylist(), b["seq"].to_pylist(), b["doc_id"].to_pylist(), b["ids"].to_pylist()):
                if parts and (size >= block_tokens or s != shard or n != seq + len(docs)):
                    yield block()
                    docs, parts, size = [], [], 0
                if not parts:
                    shard, seq = s, n
                docs.append(doc)
                parts.append(_unpacked(x))
                size += len(parts[-1])
        if parts:
            yield block()

    ids.mapInArrow(run, BLOCK_DDL).write.option("compression", "none").parquet(f"{path}/blocks")


def read(spark, path: str, each: Callable, schema: str) -> DataFrame:
    """``each(doc_id, ids) -> tuple`` of every document, read back from the files, with the block's place.

    Columns shard and seq name the block, ``inside`` counts the block's ids before the document; checksums are verified before anything is returned.
    """
    head = spark.read.parquet(f"{path}/tables").first()
    freq, precision = spark.sparkContext.broadcast(bytes(head["freq"])), head["precision"]
    fields = spark.createDataFrame([], "shard INT, seq LONG, inside LONG, " + schema).schema
    arrow = to_arrow_schema(fields)

    def run(batches):
        shared = Table(unpack(freq.value).astype(np.int64), precision)
        for b in batches:
            for row in b.to_pylist():
                if zlib.crc32(row["words"]) != row["crc_words"]:
                    raise ValueError(f"block {row['shard']}/{row['seq']}: payload is damaged")
                words = np.frombuffer(row["words"], np.uint32)
                marks = [(m["step"], m["place"], np.frombuffer(m["states"], np.uint64)) for m in row["marks"]]
                ids = decode(words, marks, shared, row["n_tokens"], row["lanes"])
                if crc(ids) != row["crc_ids"]:
                    raise ValueError(f"block {row['shard']}/{row['seq']}: ids are damaged")
                ends = np.cumsum(unpack(row["lens"]).astype(np.int64)).tolist()
                out = [(row["shard"], row["seq"], i, *each(doc, ids[i:j])) for doc, i, j in zip(row["doc_ids"], [0, *ends], ends)]
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*out), arrow)], schema=arrow)

    return spark.read.parquet(f"{path}/blocks").mapInArrow(run, fields)


def starts(spark, path: str) -> DataFrame:
    """(shard, seq, before): the ids before each block, from the blocks' token counts alone.

    Blocks are summed per shard, shards are summed in order (one row per shard of ``SHARD_BYTES`` text), and blocks
    within their shard.
    """
    blocks = spark.read.parquet(f"{path}/blocks").select("shard", "seq", "n_tokens")
    shard = blocks.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    first = shard.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("first"))
    inside = F.sum("n_tokens").over(Window.partitionBy("shard").orderBy("seq")) - F.col("n_tokens")
    return blocks.withColumn("inside", inside).join(first, "shard").select("shard", "seq", (F.col("first") + F.col("inside")).alias("before"))


def query(docs: DataFrame, path: str | None = None, **how) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files."""
    spark = docs.sparkSession
    path = path or f"{checkpoint_dir(spark)}/llm-rans-{uuid.uuid4().hex}"
    write(docs, path, **how)
    rows = read(spark, path, lambda doc, ids: (doc, len(ids), crc(ids)), "doc_id LONG, n_tokens LONG, ids_crc32 LONG")
    return rows.join(starts(spark, path), ["shard", "seq"]).select("doc_id", (F.col("before") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")
