r"""Conversation prefix trie: balanced parentheses per shard, spines shared by shards merged level by level.

A conversation is the path of its turns' digests (128 bits of role and text); equal paths are one, with the number of
conversations that end there and the digest of their ids. Paths are dealt by ranges of their order, which is the order of
a walk through the trie, so a shard holds whole subtrees but for the nodes on its first and its last path, its spines.

A shard writes its trie as balanced parentheses. Blocks of their excess with a tree of block minima find the parenthesis
that closes a node, which delimits its subtree; ranks of the pairs `()` count its leaves, cumulative arrays over the nodes
give its savings. Nodes off the spines are finished. The spines, two paths a shard with what is finished below each of
their nodes, are the paths of the next level, where they are dealt and merged in the same way, until they fit one shard.
A node whose parent is on a spine learns the parent's smallest member at the end, from the finished spine nodes.

Conversations with equal paths are first joined into runs of RUN ids each, so no task takes the rows of a very common
one; the digest of a node's ids is one SHA-256 over their order and reads the runs of that node in one task, as a stream.

Edge cases: null role or text is empty; turns are ordered by turn (null first), then by their digest; repeated turns count
as turns; rows without conv_id belong to no conversation and are left out; a conversation without turns, once rebuilt,
ends at the root; an empty table gives an empty trie; extra columns are ignored. The digests and word counts of one
conversation are one row (40 bytes a turn), its texts are not.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelloom.llm._spark import checkpointed, met_unevenly, read
from panelloom.llm._text import ranges, span_hashes

_WORD = r"[^\x20\x09-\x0D]+"
#: Ids of one path that are joined to a run before they are shuffled.
RUN = 512
#: What stands for no member in minima.
_NONE = 2**63 - 1
_LISTS = ("words", "n", "least", "kids", "leaves", "saved")
NODE = "conv_id long, depth long, parent_conv_id long, k1 long, k2 long, p1 long, p2 long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
SPINE = "path binary, " + ", ".join(f"{c} array<long>" for c in _LISTS) + ", ends array<string>"
_EMPTY_DIGEST = hashlib.sha256(b"").hexdigest()


class Parentheses:
    """A balanced sequence, one bit a parenthesis, with the excess of 8-bit blocks and a tree of their minima."""

    _STEPS = np.where((np.arange(256)[:, None] >> np.arange(8)) & 1, 1, -1).astype(np.int8)

    def __init__(self, bits: np.ndarray):
        self.length = len(bits)
        self.packed = np.packbits(bits.astype(np.uint8), bitorder="little")
        inside = np.cumsum(self._STEPS, axis=1)[self.packed]
        #: Excess before each block.
        self.before = np.concatenate([[0], np.cumsum(inside[:, -1], dtype=np.int64)])[:-1]
        level = self.before + inside.min(axis=1)
        self.minima = [level]
        while len(level) > 1:
            level = np.append(level, np.full(len(level) % 2, level.max() + 1)).reshape(-1, 2).min(axis=1)
            self.minima.append(level)

    def excess(self, position: np.ndarray) -> np.ndarray:
        """Opened less closed parentheses up to and with each position."""
        block = position >> 3
        upto = np.cumsum(self._STEPS, axis=1)
        return self.before[block] + upto[self.packed[block], position & 7]

    def _in_block(self, block: np.ndarray, after: np.ndarray, target: np.ndarray) -> np.ndarray:
        """First place in a block, at `after` or later, whose excess is the target; -1 without one."""
        at = self.before[block][:, None] + np.cumsum(self._STEPS, axis=1)[self.packed[block]]
        hit = (at == target[:, None]) & (np.arange(8)[None, :] >= after[:, None])
        return np.where(hit.any(axis=1), block * 8 + hit.argmax(axis=1), -1)

    def find_close(self, opened: np.ndarray) -> np.ndarray:
        """The parenthesis that closes each of the opened ones: the next place with one less in excess."""
        target = self.excess(opened) - 1
        block = opened >> 3
        close = self._in_block(block, (opened & 7) + 1, target)
        left = np.flatnonzero(close < 0)
        if not len(left):
            return close
        target, node = target[left], block[left]
        # Up: to the first subtree on the right that goes down to the target.
        height, found = np.zeros(len(left), dtype=np.int64), np.zeros(len(left), dtype=bool)
        for h, minima in enumerate(self.minima):
            right = node + 1
            on = ~found & (node % 2 == 0) & (right < len(minima))
            here = on & (minima[np.minimum(right, len(minima) - 1)] <= target)
            node[here], height[here] = right[here], h
            found |= here
            node[~found] >>= 1
        # Down: to its first block that does.
        for h in range(len(self.minima) - 1, 0, -1):
            go = height == h
            child = node[go] * 2
            low = self.minima[h - 1]
            node[go] = child + (low[child] > target[go])
            height[go] = h - 1
        close[left] = self._in_block(node, np.zeros(len(left), dtype=np.int64), target)
        return close


class Ones:
    """Number of marked positions before any position, kept as bits and counts of 64-bit words."""

    def __init__(self, marks: np.ndarray):
        self.packed = np.packbits(np.pad(marks.astype(np.uint8), (0, -len(marks) % 64 + 64)), bitorder="little").view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.packed), dtype=np.int64)])

    def before_position(self, position: np.ndarray) -> np.ndarray:
        mask = (np.uint64(1) << (position & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[position >> 6] + np.bitwise_count(self.packed[position >> 6] & mask)


class Shard:
    """The trie of sorted, distinct paths with what is known of each node on them.

    size: turns of each path; digest: two 64-bit halves per turn; known: per name of _LISTS one number for each depth
    from 0 of each path; ends: {number of such a place: digest of the ids that end there}.
    """

    def __init__(self, size: np.ndarray, digest: np.ndarray, known: dict[str, np.ndarray], ends: dict[int, str]):
        self.size, self.first = size, np.cumsum(size) - size
        self.digest = digest
        m = len(size)
        shorter = np.minimum(size[1:], size[:-1])
        step, pair = ranges(shorter), np.repeat(np.arange(m - 1), shorter)
        differ = (digest[self.first[:-1][pair] + step] != digest[self.first[1:][pair] + step]).any(axis=1)
        #: Depth that each path shares with the one before; -1 for the first.
        self.shared = np.append(-1, shorter)
        np.minimum.at(self.shared, pair[differ] + 1, step[differ])
        self.place = np.cumsum(size + 1) - size - 1
        row, depth = np.repeat(np.arange(m), size + 1), ranges(size + 1)
        new = depth > self.shared[row]
        number = np.cumsum(new) - 1
        # The node at a depth of a path is the last one that was new at this depth.
        order = np.argsort(depth, kind="stable")
        last = np.maximum.accumulate(np.where(new[order], np.arange(len(order)), 0))
        self.node = np.empty(len(order), dtype=np.int64)
        self.node[order] = number[order][last]
        self.born, self.depth, self.row = np.flatnonzero(new), depth[new], row[new]
        count = len(self.born)
        self.parent = np.where(self.depth > 0, self.node[self.born - 1], -1)
        self.words = known["words"][self.born]
        total = {}
        for name in ("n", "kids", "leaves", "saved"):
            total[name] = np.zeros(count, dtype=np.int64)
            np.add.at(total[name], self.node, known[name])
        self.n, self.kids, self.leaves, self.saved = (total[c] for c in ("n", "kids", "leaves", "saved"))
        self.least = np.full(count, _NONE, dtype=np.int64)
        np.minimum.at(self.least, self.node, known["least"])
        self.ends = {int(self.node[k]): v for k, v in ends.items()}
        self._subtrees()

    def _subtrees(self) -> None:
        run = np.empty(2 * len(self.size), dtype=np.int64)
        run[0::2] = self.size - self.shared
        run[1::2] = self.size - np.append(self.shared[1:], -1)
        bits = np.repeat(np.arange(len(run)) % 2 == 0, run)
        sequence, opened = Parentheses(bits), np.flatnonzero(bits)
        close = sequence.find_close(opened)
        #: Nodes of each subtree, its top included; they follow the top.
        self.nodes = (close - opened + 1) // 2
        pair = np.zeros(len(bits), dtype=bool)
        pair[opened] = (close == opened + 1) & (self.kids == 0)
        leaves = Ones(pair)
        here = leaves.before_position(close) - leaves.before_position(opened)
        self.all_leaves = here + self._below(self.leaves)
        self.all_saved = self._below((self.n - 1) * self.words + self.saved)
        self.children = self.kids + np.bincount(self.parent[self.parent >= 0], minlength=len(self.parent))

    def _below(self, values: np.ndarray) -> np.ndarray:
        upto = np.concatenate([[0], np.cumsum(values)])
        at = np.arange(len(values))
        return upto[at + self.nodes] - upto[at]

    def keys(self, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """128 bits that stand for the turns down to each node."""
        begin = self.first[self.row[nodes]]
        return tuple(span_hashes(np.ascontiguousarray(self.digest[:, i]), begin, begin + self.depth[nodes]).view(np.int64) for i in (0, 1))

    def results(self, last: bool, keyed: bool) -> tuple[dict, list[dict]]:
        """Columns of the finished nodes, and the spines; the last shard finishes all."""
        m, count = len(self.size), len(self.parent)
        ends_of = lambda r: slice(self.place[r], self.place[r] + self.size[r] + 1)
        is_open = np.zeros(count, dtype=bool)
        spines = []
        if not last:
            for r in {0, m - 1}:
                is_open[self.node[ends_of(r)]] = True
            closed_child = np.flatnonzero(~is_open & (self.parent >= 0))
            closed_child = closed_child[is_open[self.parent[closed_child]]]
            kids, leaves, saved = self.kids.copy(), self.leaves.copy(), self.saved.copy()
            np.add.at(kids, self.parent[closed_child], 1)
            np.add.at(leaves, self.parent[closed_child], self.all_leaves[closed_child])
            np.add.at(saved, self.parent[closed_child], self.all_saved[closed_child])
            for r in sorted({0, m - 1}):
                nodes = self.node[ends_of(r)]
                # What both spines share is told by the first.
                own = np.arange(len(nodes)) > (self.shared[1:].min() if r else -1)
                turns = self.digest[self.first[r] : self.first[r] + self.size[r]]
                told = {"n": self.n, "kids": kids, "leaves": leaves, "saved": saved}
                spine = {c: np.where(own, v[nodes], 0) for c, v in told.items()} | {"least": np.where(own, self.least[nodes], _NONE), "words": self.words[nodes]}
                spines.append(spine | {"path": turns.astype(">u8").tobytes(), "ends": [self.ends.get(int(k)) if o else None for k, o in zip(nodes, own)]})
        done = np.flatnonzero(~is_open)
        parent = self.parent[done]
        inner = (parent >= 0) & ~is_open[parent]
        outer = (parent >= 0) & is_open[parent]
        none = np.zeros(len(done), dtype=bool)
        own_keys, parent_keys = self.keys(done), self.keys(np.maximum(parent, 0))
        columns = {
            "conv_id": (self.least[done], None), "depth": (self.depth[done], None), "parent_conv_id": (self.least[parent], ~inner),
            "k1": (own_keys[0], none if keyed else ~none), "k2": (own_keys[1], none if keyed else ~none), "p1": (parent_keys[0], ~outer), "p2": (parent_keys[1], ~outer),
            "n_convs": (self.n[done], None), "n_children": (self.children[done], None), "n_leaves": (self.all_leaves[done], None), "saved_tokens": (self.all_saved[done], None),
        }
        return columns | {"ends_sha256": [self.ends.get(int(k), _EMPTY_DIGEST) for k in done]}, spines


def _batch(columns: dict, spines: list[dict]) -> pa.RecordBatch:
    """Finished nodes and spines in one table: a row has a node, or a path of a spine."""
    count, more = len(columns["ends_sha256"]), len(spines)
    arrays, names = [], []
    for name, value in columns.items():
        own = pa.array(value, pa.string()) if isinstance(value, list) else pa.array(value[0], pa.int64(), mask=value[1])
        arrays.append(pa.concat_arrays([own, pa.nulls(more, own.type)]))
        names.append(name)
    kinds = {"path": pa.binary()} | {c: pa.list_(pa.int64()) for c in _LISTS} | {"ends": pa.list_(pa.string())}
    for name, kind in kinds.items():
        arrays.append(pa.concat_arrays([pa.nulls(count, kind), pa.array([s[name] for s in spines], kind)]))
        names.append(name)
    return pa.RecordBatch.from_arrays(arrays, names=names)


class _Held:
    """Paths that wait until they make a shard."""

    def __init__(self, level: int, capacity: int, last: bool):
        self.keyed, self.capacity, self.last = level > 1, capacity, last
        self.clear()

    def clear(self) -> None:
        self.paths: list[bytes] = []
        self.known: dict[str, list[np.ndarray]] = {c: [] for c in _LISTS}
        self.ends: dict[int, str] = {}
        self.places = 0

    def add(self, path: bytes, known: dict[str, np.ndarray], ends: dict[int, str]) -> Iterator[pa.RecordBatch]:
        self.paths.append(path)
        for c in _LISTS:
            self.known[c].append(known[c])
        self.ends |= {self.places + d: v for d, v in ends.items()}
        self.places += len(path) // 16 + 1
        # A shard of fewer than eight paths would not make the next level smaller.
        if not self.last and self.places >= self.capacity and len(self.paths) >= 8:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.paths:
            size = np.array([len(p) // 16 for p in self.paths])
            digest = np.frombuffer(b"".join(self.paths), dtype=">u8").astype(np.uint64).reshape(-1, 2)
            shard = Shard(size, digest, {c: np.concatenate(v) for c, v in self.known.items()}, self.ends)
            self.clear()
            yield _batch(*shard.results(self.last, self.keyed))


def _first_level(capacity: int):
    """Shards of (path, words, least, n, ids) in the order of path and least; runs of one path are joined here."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, path, state = _Held(1, capacity, False), None, None

        def finished() -> Iterator[pa.RecordBatch]:
            if path is not None:
                words, least, n, sha = state
                d = len(path) // 16
                zero = np.zeros(d + 1, dtype=np.int64)
                known = {"words": words, "n": zero + n, "least": zero + least, "kids": zero, "leaves": zero, "saved": zero}
                yield from held.add(path, known, {d: sha.hexdigest()})

        for batch in batches:
            words, offsets = np.asarray(batch.column(1).values), np.asarray(batch.column(1).offsets)
            rows = zip(*(batch.column(i).to_pylist() for i in (0, 2, 3, 4)))
            for i, (new, least, n, ids) in enumerate(rows):
                if new == path:
                    state[2] += n
                    state[3].update(b"," + ids.encode())
                    continue
                yield from finished()
                path, state = new, [np.append(0, words[offsets[i] : offsets[i + 1]]), least, n, hashlib.sha256(ids.encode())]
        yield from finished()
        yield from held.flush()

    return run


def _next_level(level: int, capacity: int, last: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Held(level, capacity, last)
        for batch in batches:
            names = batch.schema.names
            lists = {c: (np.asarray(batch.column(names.index(c)).values), np.asarray(batch.column(names.index(c)).offsets)) for c in _LISTS}
            ends = batch.column(names.index("ends")).to_pylist()
            for i, path in enumerate(batch.column(names.index("path")).to_pylist()):
                known = {c: v[o[i] : o[i + 1]] for c, (v, o) in lists.items()}
                yield from held.add(path, known, {d: x for d, x in enumerate(ends[i]) if x is not None})
        yield from held.flush()

    return run


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of up to RUN conversations of one path from rows (path, conv_id, words) in this order."""
    for batch in batches:
        paths, ids, words = (batch.column(i) for i in range(3))
        listed, numbers = paths.to_pylist(), ids.to_pylist()
        begin = [0]
        for i in range(1, len(listed)):
            if i - begin[-1] == RUN or listed[i] != listed[i - 1]:
                begin.append(i)
        ends = [*begin[1:], len(listed)] if listed else []
        begin = begin if listed else []
        at = pa.array(begin, pa.int64())
        joined = [",".join(map(str, numbers[a:b])) for a, b in zip(begin, ends)]
        counts = [b - a for a, b in zip(begin, ends)]
        yield pa.RecordBatch.from_arrays([paths.take(at), words.take(at), ids.take(at), pa.array(counts, pa.int64()), pa.array(joined, pa.string())], names=["path", "words", "least", "n", "ids"])


def conversation_paths(rows: DataFrame) -> DataFrame:
    """(conv_id, digests, words) of (conv_id, turn, role, text): hex digests and word counts of the turns in order."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    # The length of the role keeps role and text apart.
    digest = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    turns = rows.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn").cast("long").alias("turn"), digest.alias("digest"), F.regexp_count(text, F.lit(_WORD)).cast("long").alias("words")).alias("t"))
    return turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t")).select("conv_id", F.col("t.digest").alias("digests"), F.col("t.words").alias("words"))


def share_openings(paths: DataFrame, every: int = 20, most: int = 4) -> DataFrame:
    """Conversations that open with the first crc32(conv_id) % most turns of conversation conv_id - conv_id % every."""
    base = paths.where(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("base"), F.slice("digests", 1, most - 1).alias("base_digests"), F.slice("words", 1, most - 1).alias("base_words"))
    h = (F.crc32(F.col("conv_id").cast("string")) % most).cast("int")
    met = paths.withColumn("base", F.col("conv_id") - F.col("conv_id") % every).withColumn("h", h).join(base, "base", "left")
    tail = lambda c: F.filter(c, lambda x, i: i >= F.col("h"))
    head = lambda c, kind: F.coalesce(F.filter(c, lambda x, i: i < F.col("h")), F.array().cast(kind))
    return met.select("conv_id", F.concat(head("base_digests", "array<string>"), tail("digests")).alias("digests"), F.concat(head("base_words", "array<long>"), tail("words")).alias("words"))


def prefix_trie(paths: DataFrame, capacity: int = 1 << 18) -> DataFrame:
    """The nodes of the trie of (conv_id, digests, words), unique conv_id.

    (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256); a node is named by its
    smallest member and its depth. capacity: nodes of paths in one shard.
    """
    binary = F.unhex(F.array_join("digests", "")).alias("path")
    runs = paths.select(binary, "conv_id", "words").repartitionByRange("path", "conv_id").sortWithinPartitions("path", "conv_id")
    rows = checkpointed(runs.mapInArrow(_runs, "path binary, words array<long>, least long, n long, ids string"))
    step, level, finished = _first_level(capacity), 1, []
    dealt = rows.repartitionByRange("path").sortWithinPartitions("path", "least")
    while True:
        out = checkpointed(dealt.mapInArrow(step, f"{NODE}, {SPINE}"))
        finished.append(out.where("path is null").select(*[c.split()[0] for c in NODE.split(", ")]))
        spines = out.where("path is not null").select(*[c.split()[0] for c in SPINE.split(", ")])
        count, places = spines.agg(F.count(F.lit(1)), F.sum(F.size("n"))).first()
        if not count:
            break
        last, level = count <= 64 or places <= capacity, level + 1
        step = _next_level(level, capacity, last)
        dealt = (spines.coalesce(1) if last else spines.repartitionByRange(-(-places // capacity), "path")).sortWithinPartitions("path")
    nodes = reduce(DataFrame.unionAll, finished)
    own = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    spine_nodes = nodes.where("k1 is not null").select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("n"))
    told = met_unevenly(nodes.where("p1 is not null").drop("parent_conv_id"), spine_nodes, ["p1", "p2"], "parent_conv_id", ["conv_id", "depth"])
    return nodes.where("p1 is null").select(*own).unionAll(told.select(*own))


def op11_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the trie of all conversations, rebuilt to share their openings."""
    return prefix_trie(share_openings(conversation_paths(read(spark, sf_dir, "conversations"))))


ORACLE = r"""
with recursive t as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null
), g as (
  select *, md5(length(role)::varchar || ':' || role || text) as digest, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) as words from t
), c as (
  select conv_id, list({'d': digest, 'w': words} order by turn nulls first, digest) as turns from g group by conv_id
), crc(conv_id, s, pos, v, bit) as (
  select conv_id, conv_id::varchar, 0, 4294967295::bigint, 8 from c
  union all
  select conv_id, s, case when bit = 8 then pos + 1 else pos end,
         case when bit = 8 then xor(v, ascii(s[pos + 1])::bigint) when v & 1 = 1 then xor(v >> 1, 3988292384) else v >> 1 end,
         case when bit = 8 then 0 else bit + 1 end
  from crc where not (bit = 8 and pos = length(s))
), h as (select conv_id, xor(v, 4294967295) % 4 as h from crc where bit = 8 and pos = length(s)),
r as (
  select c.conv_id, list_concat(coalesce(b.turns, [])[1:h], c.turns[h + 1:]) as turns
  from c join h using (conv_id) left join c b on b.conv_id = c.conv_id - c.conv_id % 20
), p as (
  select conv_id, len(turns) as size, d, md5(array_to_string(list_transform(turns[1:d], lambda x: x.d), '')) as k, d || ':' || md5(array_to_string(list_transform(turns[1:d], lambda x: x.d), '')) as node,
         case when d = 0 then null else (d - 1) || ':' || md5(array_to_string(list_transform(turns[1:d - 1], lambda x: x.d), '')) end as up, case when d = 0 then 0 else turns[d].w end as words
  from (select *, unnest(range(0, len(turns) + 1)) as d from r)
), n as (
  select node, d, min(conv_id) as conv_id, any_value(up) as up, any_value(words) as words, count(*) as n_convs,
         sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (where size = d), '')) as ends_sha256
  from p group by node, d
), k as (select up, count(*) as n_children from n group by up),
a as (
  select q.node as top, sum((n.n_convs - 1) * n.words) as saved_tokens, count(*) filter (where k.n_children is null) as n_leaves
  from n join p q on q.conv_id = n.conv_id and q.d <= n.d left join k on k.up = n.node group by q.node
)
select n.conv_id, n.d::bigint as depth, u.conv_id as parent_conv_id, n.n_convs::bigint as n_convs, coalesce(k.n_children, 0)::bigint as n_children,
       a.n_leaves::bigint as n_leaves, a.saved_tokens::bigint as saved_tokens, n.ends_sha256
from n join a on a.top = n.node left join n u on u.node = n.up left join k on k.up = n.node
"""


def queries() -> dict:
    return {"op11_trie": op11_trie}


def oracle_sql() -> dict[str, str]:
    return {"op11_trie": ORACLE}
