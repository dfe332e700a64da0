"""Conversation prefix trie from vertical bitmaps: which first turns conversations share, and what sharing them saves.

A conversation is the sequence of its turns' digests (128 bits of role and text). Conversations are range-partitioned by
(sequence, id), so that the members of a trie node are neighbours, and cut into blocks of at most ``BITS`` conversations.
A block is one vertical bitmap index: (position, turn) -> bitset of the block's conversations. The trie is walked depth
first: the parent's bitset, intersected with the postings of its members' next turns, yields the children; popcounts are
their members, and the members that end there are the node's end list.

Nodes on the path of a block's first or last conversation may go on in the neighbouring blocks; these open nodes carry sums
that add up, keyed by a chained hash of their path. What a block would count again (path nodes that the previous block
already has) is known from the two conversations at the cut: a scalar per block. So no node is gathered: a first turn that a
third of all conversations share is one partial row per block.

Saved bytes of a subtree are the bytes of all its members' turns from the node on, less those of its distinct nodes.

Defined results: null roles and texts are empty; turns are in ascending order, null first, equal ones by digest; rows
without conv_id belong to no conversation and are dropped; repeated rows are turns of their own; turns may have any
length, only their digests and sizes travel; a conversation's digests (16 bytes a turn) are one value; an empty table has
no node, not even the root; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, IntegerType, LongType, StringType, StructType

from .common import groups_for, pack, stage, unpack

#: Conversations of a block (the length of its bitsets) and turns after which a block is closed.
BITS = 4096
TURNS = 65_536
#: Turns a task should get.
TASK_TURNS = 100_000
#: Bytes of a turn's digest.
W = 16

#: part: 0 a node of one block, 1 an open node, 2 a partition's first and last conversation.
NODES = StructType()
for _name, _type in {"part": IntegerType(), "task": IntegerType(), **dict.fromkeys(("block", "conv_id", "depth", "parent_conv_id"), LongType()), "key": BinaryType(), "parent_key": BinaryType(),
                     **dict.fromkeys(("n", "children", "leaves", "member_bytes", "node_bytes", "before"), LongType()), "first_block": BooleanType(),
                     "ends_sha256": StringType(), "ends": BinaryType(), "head": BinaryType(), "tail": BinaryType(), "sizes": ArrayType(LongType())}.items():
    NODES.add(_name, _type)
NO_ENDS = hashlib.sha256(b"").hexdigest()


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos from 1, digest, size) of every turn; size is its text's bytes."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.octet_length(text).cast("long").alias("size"),
        F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary")).alias("digest"))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "digest")
    return rows.select("conv_id", F.row_number().over(order).cast("long").alias("pos"), "digest", "size")


def sequences(parts: DataFrame) -> DataFrame:
    """(conv_id, seq, sizes) from rows (conv_id, part, pos, digest, size); a null digest keeps a conversation without turns."""
    held = F.array_sort(F.collect_list(F.when(F.col("digest").isNotNull(), F.struct("part", "pos", "digest", "size"))))
    return parts.groupBy("conv_id").agg(held.alias("t")).select(
        "conv_id", F.unhex(F.array_join("t.digest", "")).alias("seq"), F.col("t.size").alias("sizes"))


def rebuilt(conversations: DataFrame, folds: int = 5, most: int = 9) -> DataFrame:
    """Sequences in which conversation c starts with the first h turns of conversation c - c % folds, h = crc32(c) % most.

    Heads have at most most - 1 turns, so a base sends few rows; a conversation's own turns stay where they are.
    """
    rows = stage(turns(conversations), "trie-turns")
    convs = rows.select("conv_id").distinct().withColumns({
        "base": F.col("conv_id") - F.col("conv_id") % folds, "h": F.crc32(F.col("conv_id").cast("string").cast("binary")) % most})
    heads = rows.where((F.col("conv_id") % folds == 0) & (F.col("pos") < most)).withColumnRenamed("conv_id", "base")
    own = rows.where(F.col("pos") > F.crc32(F.col("conv_id").cast("string").cast("binary")) % most)
    return sequences(
        convs.join(heads, "base").where("pos <= h").select("conv_id", F.lit(0).alias("part"), "pos", "digest", "size")
        .unionByName(own.select("conv_id", F.lit(1).alias("part"), "pos", "digest", "size"))
        .unionByName(convs.select("conv_id", F.lit(0).alias("part"), F.lit(0).cast("long").alias("pos"), F.lit(None).cast("string").alias("digest"), F.lit(0).cast("long").alias("size"))))


def plain(conversations: DataFrame) -> DataFrame:
    """Sequences of the conversations as they are."""
    return sequences(turns(conversations).withColumn("part", F.lit(0)))


def common(a: bytes, b: bytes) -> int:
    """Turns that two sequences share from the first on."""
    n = min(len(a), len(b)) // W
    low, high = 0, n
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[: mid * W] == b[: mid * W] else (low, mid - 1)
    return low


def path_keys(seq: bytes):
    """Chained hashes of a path's prefixes, the root's first."""
    h = hashlib.md5()
    yield h.digest()
    for at in range(0, len(seq), W):
        h.update(seq[at : at + W])
        yield h.digest()


def walk(seqs: list[bytes]):
    """Depth-first walk over the vertical bitmaps of sorted sequences: (parent, depth, bitset, end bitset) of every node, parents first."""
    postings: dict = {}
    ends: dict[int, int] = {}
    for i, s in enumerate(seqs):
        bit = 1 << i
        for d in range(len(s) // W):
            k = (d, s[d * W : d * W + W])
            postings[k] = postings.get(k, 0) | bit
        ends[len(s) // W] = ends.get(len(s) // W, 0) | bit
    parent, depth, bits, over = [-1], [0], [(1 << len(seqs)) - 1], [0]
    stack = [0]
    while stack:
        v = stack.pop()
        members, d = bits[v], depth[v]
        over[v] = done = members & ends.get(d, 0)
        left = members ^ done
        while left:
            low = (left & -left).bit_length() - 1
            child = members & postings[d, seqs[low][d * W : d * W + W]]
            left &= ~child
            stack.append(len(parent))
            parent.append(v)
            depth.append(d + 1)
            bits.append(child)
            over.append(0)
    return parent, depth, bits, over


def block_rows(task: int, block: int, first_block: bool, ids: list[int], seqs: list[bytes], sizes: list, shared: int, before_ends: bool):
    """Rows of one block. ``shared``: turns that its first conversation shares with the one before the block, -1 if there is none in
    this task; ``before_ends``: that one has no other turn, so what its block counted as a leaf is not one, or is counted again here."""
    parent, depth, bits, over = walk(seqs)
    n, last = len(parent), len(ids) - 1
    lowest, children, leaves, member, node = [0] * n, [0] * n, [0] * n, [0] * n, [0] * n
    smallest: list = [None] * n
    for v in range(n - 1, -1, -1):
        low = (bits[v] & -bits[v]).bit_length() - 1
        lowest[v] = low
        if over[v]:
            at = (over[v] & -over[v]).bit_length() - 1  # sorted by (sequence, id): the first that ends here has the smallest id
            smallest[v] = ids[at] if smallest[v] is None else min(smallest[v], ids[at])
        if not children[v]:
            leaves[v] = 1
        if (p := parent[v]) >= 0:
            size = int(sizes[low][depth[v] - 1])
            member[v] += bits[v].bit_count() * size
            node[v] += size
            children[p] += 1
            leaves[p] += leaves[v]
            member[p] += member[v]
            node[p] += node[v]
            smallest[p] = smallest[v] if smallest[p] is None else min(smallest[p], smallest[v])
    first_keys, last_keys = list(path_keys(seqs[0])), list(path_keys(seqs[last]))
    before = np.concatenate(([0], np.cumsum(sizes[0], dtype=np.int64))) if len(sizes[0]) else np.zeros(1, np.int64)
    out = {k: [] for k in ("part", "conv_id", "depth", "parent_conv_id", "key", "parent_key", "n", "children", "leaves", "member_bytes", "node_bytes", "before", "ends_sha256", "ends")}

    def key_of(v):
        return first_keys[depth[v]] if bits[v] & 1 else last_keys[depth[v]] if bits[v] >> last else None

    for v in range(n):
        d, key = depth[v], key_of(v)
        on_first = bool(bits[v] & 1)
        if on_first and d <= shared:  # what the blocks before have counted
            node[v] -= int(before[shared] - before[max(0, d - 1)])
            children[v] -= d < shared
            leaves[v] -= before_ends
        held = ids[(at := (over[v] & -over[v]).bit_length() - 1) : at + over[v].bit_count()] if over[v] else []
        p = parent[v]
        parent_key = key_of(p) if p >= 0 else None
        values = (int(key is not None), smallest[v], d, smallest[p] if p >= 0 and parent_key is None else None, key, parent_key, bits[v].bit_count(), children[v], leaves[v],
                  member[v], node[v], int(before[max(0, d - 1)]) if on_first else None,
                  None if key is not None else hashlib.sha256(",".join(map(str, held)).encode()).hexdigest() if held else NO_ENDS,
                  pack(np.array(held, np.int64).view(np.uint64)) if key is not None and held else None)
        for name, x in zip(out, values):
            out[name].append(x)
    return out | {"task": [task] * n, "block": [block] * n, "first_block": [first_block] * n}


def block_nodes(batches, bits: int):
    """Arrow batches of a partition sorted by (seq, conv_id) -> rows of ``NODES``; one block is held at a time."""
    schema = to_arrow_schema(NODES)
    task, block, before = TaskContext.get().partitionId(), 0, None
    ids, seqs, sizes, held, head = [], [], [], 0, None

    def made(out):
        n = len(out["part"])
        return pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) if f.name in out else pa.nulls(n, f.type) for f in schema], schema=schema)

    def flush():
        shared = common(before, seqs[0]) if before is not None else -1
        return made(block_rows(task, (task << 32) | block, before is None, ids, seqs, sizes, shared, before is not None and shared == len(before) // W))

    for b in batches:
        for i, s, z in zip(b.column("conv_id").to_pylist(), b.column("seq").to_pylist(), b.column("sizes").to_pylist()):
            if ids and (len(ids) == bits or held + len(z) > TURNS):
                yield flush()
                before, block = seqs[-1], block + 1
                ids, seqs, sizes, held = [], [], [], 0
            head = (s, z) if head is None else head
            ids.append(i)
            seqs.append(s)
            sizes.append(z)
            held += len(z)
    if ids:
        yield flush()
        yield made({"part": [2], "task": [task], "block": [task << 32], "head": [head[0]], "tail": [seqs[-1]], "sizes": [head[1]]})


def cuts(batches):
    """Per partition: turns shared with the partition before, bytes of these, and whether the conversation before ends there."""
    for b in batches:
        rows = []
        for r in b.to_pylist():
            if r["tail_before"] is not None:
                k = common(r["tail_before"], r["head"])
                rows.append((r["task"], k, sum(r["sizes"][:k]), k == len(r["tail_before"]) // W))
        cols = list(zip(*rows)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.bool_())],
                                         names=["task", "shared", "shared_bytes", "before_ends"])


def hash_ends(batches):
    """Hash of every key's ids, from rows sorted by (key, block): a running state, so a list of any length takes no memory."""
    key, state = None, None

    def made(rows):
        return pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.binary()), pa.array([h for _, h in rows], pa.string())], names=["key", "ends_sha256"])

    for b in batches:
        out = []
        for at in range(b.num_rows):
            k, ids = b.column("key")[at].as_py(), unpack(b.column("ends")[at].as_py()).view(np.int64)
            if k != key:
                if key is not None:
                    out.append((key, state.hexdigest()))
                key, state = k, hashlib.sha256()
                text = ""
            else:
                text = ","
            state.update((text + ",".join(map(str, ids.tolist()))).encode())
        yield made(out)
    if key is not None:
        yield made([(key, state.hexdigest())])


def trie(seqs: DataFrame, bits: int = BITS, parts: int | None = None) -> DataFrame:
    """One row per node of the trie over ``seqs`` (conv_id, seq, sizes), conv_id unique. ``parts``: tasks, else from the number of turns."""
    seqs = stage(seqs, "trie-sequences")
    if parts is None:
        parts = groups_for(seqs.agg(F.sum(F.size("sizes") + 1)).first()[0] or 0, TASK_TURNS)
    rows = stage(seqs.repartitionByRange(parts, "seq", "conv_id").sortWithinPartitions("seq", "conv_id").mapInArrow(lambda it: block_nodes(it, bits), NODES), "trie-nodes")

    # One row per partition: what its first block shares with the partition before.
    before = F.lag("tail").over(Window.orderBy("task"))
    at_cut = (rows.where("part = 2").select("task", "head", "sizes", "tail").withColumn("tail_before", before)
              .mapInArrow(cuts, "task INT, shared LONG, shared_bytes LONG, before_ends BOOLEAN"))
    again = F.col("first_block") & F.col("before").isNotNull() & (F.col("depth") <= F.col("shared"))
    opened = rows.where("part = 1").join(at_cut, "task", "left").withColumn("again", F.coalesce(again, F.lit(False))).withColumns({
        "node_bytes": F.col("node_bytes") - F.when(F.col("again"), F.col("shared_bytes") - F.col("before")).otherwise(0),
        "children": F.col("children") - F.when(F.col("again") & (F.col("depth") < F.col("shared")), 1).otherwise(0),
        "leaves": F.col("leaves") - F.when(F.col("again") & F.col("before_ends"), 1).otherwise(0)})
    merged = opened.groupBy("key").agg(
        F.min("conv_id").alias("conv_id"), F.first("depth").alias("depth"), F.first("parent_key").alias("parent_key"),
        *[F.sum(c).alias(c) for c in ("n", "children", "leaves", "member_bytes", "node_bytes")])
    merged = stage(merged, "trie-open")

    ended = rows.where("ends IS NOT NULL").select("key", "block", "ends")
    ended = ended.repartition("key").sortWithinPartitions("key", "block").mapInArrow(hash_ends, "key BINARY, ends_sha256 STRING")
    parents = merged.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id"))
    top = merged.join(parents, "parent_key", "left").join(ended, "key", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NO_ENDS)))

    # Children of open nodes look their parent up by (block, key): one row per block and open node, so no key is hot.
    here = rows.where("part = 1").select("block", F.col("key").alias("parent_key")).join(parents, "parent_key")
    inner = rows.where("part = 0")
    low = inner.where("parent_key IS NULL").unionByName(inner.where("parent_key IS NOT NULL").drop("parent_conv_id").join(here, ["block", "parent_key"]))

    def shown(df):
        return df.select("conv_id", "depth", "parent_conv_id", F.col("n").alias("n_convs"), F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"),
                         (F.col("member_bytes") - F.col("node_bytes")).alias("saved_tokens"), "ends_sha256")

    return shown(top).unionByName(shown(low))


def query(conversations: DataFrame) -> DataFrame:
    return trie(rebuilt(conversations))


#: crc32 of a text of decimal digits, by its definition.
_CRC = """CAST(xor(list_reduce(list_concat([4294967295], list_transform(string_split(CAST({0} AS VARCHAR), ''), lambda ch: CAST(ascii(ch) AS BIGINT))),
    lambda a, x: list_reduce([xor(a, x), 1, 1, 1, 1, 1, 1, 1, 1], lambda r, k: xor(r >> 1, 3988292384 * (r & 1)))), 4294967295) AS BIGINT)"""


def oracle() -> str:
    """The same by grouping all prefixes."""
    return f"""WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS pos FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, conv_id - conv_id % 5 AS base, {_CRC.format('conv_id')} % 9 AS h FROM (SELECT DISTINCT conv_id FROM t)),
p AS (SELECT c.conv_id, 0 AS part, t.pos, t.role, t.text FROM c JOIN t ON t.conv_id = c.base AND t.pos <= c.h
      UNION ALL SELECT c.conv_id, 1, t.pos, t.role, t.text FROM c JOIN t ON t.conv_id = c.conv_id AND t.pos > c.h),
q AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY part, pos) AS pos, md5(strlen(role) || ':' || role || text) AS k, strlen(text) AS b FROM p),
s AS (SELECT c.conv_id, coalesce(x.ks, []) AS ks, coalesce(x.bs, []) AS bs FROM c LEFT JOIN
      (SELECT conv_id, list(k ORDER BY pos) AS ks, list(b ORDER BY pos) AS bs FROM q GROUP BY conv_id) x USING (conv_id)),
m AS (SELECT conv_id, len(ks) AS n, d, array_to_string(ks[1:d], '') AS path, CASE WHEN d > 0 THEN array_to_string(ks[1:d - 1], '') END AS up,
      CASE WHEN d > 0 THEN bs[d] ELSE 0 END AS b FROM (SELECT *, unnest(range(0, len(ks) + 1)) AS d FROM s)),
v AS (SELECT path, min(d) AS depth, min(up) AS up, min(conv_id) AS conv_id, count(*) AS n_convs, min(b) AS b,
      sha256(coalesce(string_agg(CASE WHEN n = d THEN CAST(conv_id AS VARCHAR) END, ',' ORDER BY conv_id), '')) AS ends_sha256 FROM m GROUP BY path),
w AS (SELECT v.*, (SELECT count(*) FROM v AS x WHERE x.up = v.path) AS n_children FROM v),
a AS (SELECT substr(w.path, 1, 32 * CAST(u AS INT)) AS path, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((n_convs - 1) * b) AS saved_tokens
      FROM w, range(0, 1000) r(u) WHERE u <= w.depth GROUP BY 1)
SELECT w.conv_id, CAST(w.depth AS BIGINT) AS depth, y.conv_id AS parent_conv_id, w.n_convs, w.n_children, CAST(a.n_leaves AS BIGINT) AS n_leaves,
    CAST(a.saved_tokens AS BIGINT) AS saved_tokens, w.ends_sha256
FROM w JOIN a USING (path) LEFT JOIN v AS y ON y.path = w.up"""
