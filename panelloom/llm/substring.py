r"""Exact substring dedup: compressed FM-indexes over content-routed shards.

A window is `length` consecutive words; a word goes when a window over it also starts earlier in the corpus.
Windows that are equal share their minimiser (the smallest hash among their `anchor`-word shingles), so runs of
windows with one minimiser, called segments here, are routed by it: equal windows always meet in one shard, and
the work grows with the text. Segments whose minimiser occurs once need no search.

Each shard builds an FM-index (Burrows-Wheeler transform in a bit-packed wavelet matrix, common prefix lengths up to
the threshold, one earliest place per group of equal windows; the suffix array is not kept) over the earliest
segment of every content but the last of its minimiser, which nothing can follow. All segments but the first of their
minimiser, which nothing can precede, are streamed through it by backward search: at every word the statistic is the
length of the longest match that starts there, made longer by one step of the search where the match goes on, and cut
back to the next shorter interval where it breaks off. A window is a repeat where the statistic reaches `length` and
the earliest place of the match is another than its own. Equal streamed segments of a shard take these steps once.

No minimiser is a bottleneck. One with over `rows` segments is spread over salts: each takes its share of the streamed
segments and a copy of the indexed ones, which are then the earliest of each content of the whole table. If it has over
`kinds` contents too (the rim of a very common passage), its windows are routed one by one, by their own hash as well.
Both go through the same index and search.

Words are known by 64 bits of their hash: a window could be taken for another only where two words share all 64 and the
other nineteen are equal. Rows are known by their id, or that they have none, and 63 bits of the hashes of their text.

Edge cases: null and empty texts have no words and lose none; texts shorter than a window lose none; rows are ordered
by doc_id, then by a hash of the text, null ids last; rows equal in both count as one document, so neither removes the
other; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelloom.llm._spark import checkpointed, read, row_identity
from panelloom.llm._text import mix, ranges, shingle_hashes, span_hashes, text_blocks
from panelloom.llm._tiles import by_unit

#: What tells rows apart: the id, and 63 bits of the text and whether there is an id. Segments carry it, so it is kept short.
IDENTITY = ("doc", "text_key")
#: Windows in one segment at most; a longer run (periodic text) is cut.
RUN = 64
#: Bytes of text that a task takes apart at a time; byte and word arrays are some fifty times as large.
BLOCK = 1 << 19
#: Bits of the role of a segment in its shard; without one of the first two it follows from the order in the shard.
INDEXED, STREAMED, DOUBLED = 1, 2, 4


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of values[i : i + width] for every i where it fits."""
    step, out = 1, values
    while 2 * step <= width:
        out = np.minimum(out[:-step], out[step:])
        step *= 2
    return np.minimum(out[: len(out) - (width - step)], out[width - step :]) if width > step else out


def segments_of(word_hash: np.ndarray, rows: np.ndarray, length: int, anchor: int) -> tuple[np.ndarray, ...]:
    """First word, windows, minimiser, content hash and weight of every segment; weight 2 if its minimiser repeats inside."""
    width = length - anchor + 1
    n = len(word_hash) - length + 1
    if n <= 0:
        none = np.zeros(0, np.int64)
        return none, none, none.astype(np.uint64), none.astype(np.uint64), none
    valid = rows[length - 1 :] == rows[:n]
    shingle = np.full(len(word_hash) - anchor + 1, np.uint64(2**64 - 1))
    hashes, first = shingle_hashes(word_hash, rows, anchor)
    shingle[first] = hashes
    least = _sliding_min(shingle, width)
    new = np.ones(n, dtype=bool)
    new[1:] = (least[1:] != least[:-1]) | ~valid[:-1] | (rows[1:n] != rows[: n - 1])
    index = np.flatnonzero(new)
    age = np.arange(n) - np.repeat(index, np.diff(np.append(index, n)))
    long_run = np.maximum.reduceat(age, index) >= width
    start_flag = (new | (age % RUN == 0)) & valid
    starts = np.flatnonzero(start_flag)
    if not len(starts):
        none = np.zeros(0, np.int64)
        return none, none, none.astype(np.uint64), none.astype(np.uint64), none
    windows = np.add.reduceat(valid.astype(np.int64), starts)
    twice = np.zeros(n, dtype=np.int8)
    for t in range(width):
        twice += shingle[t : t + n] == least
    doubled = np.maximum.reduceat(twice * valid, starts) > 1
    run_of = np.searchsorted(index, starts, side="right") - 1

    content = span_hashes(word_hash, starts, starts + windows + length - 1)
    return starts, windows, least[starts], content, 1 + (doubled | long_run[run_of]).astype(np.int64)


def _segment_rows(length: int, anchor: int):
    names = ["minimiser", "content", *IDENTITY, "place"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            identity = [np.asarray(batch.column(i)) for i in range(len(IDENTITY))]
            for block in text_blocks(batch, "text", BLOCK):
                starts, ends, rows = block.words()
                if len(starts) < length:
                    continue
                word = block.word_hashes(starts, ends)
                first, windows, least, content, weight = segments_of(word, rows, length, anchor)
                if not len(first):
                    continue
                base = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=block.rows))[:-1]])
                row = rows[first]
                place = (first - base[row]) * 256 + windows * 2 + weight - 1
                owner = block.first_row + row
                arrays = [least.view(np.int64), content.view(np.int64), *(x[owner] for x in identity), place]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], names=names)

    return run


def _pieces(length: int):
    """The words (hashes) of the wanted segments of each text, addressed to the key of their shard group."""
    names = ["key", *IDENTITY, "first", "role", "words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = batch.column(batch.schema.get_field_index("wanted"))
            offsets = np.asarray(wanted.offsets).astype(np.int64)
            place_all, key_all, role_all, parts_all, salts_all = (np.asarray(wanted.values.field(c)) for c in ("place", "minimiser", "role", "parts", "salts"))
            identity = [np.asarray(batch.column(i)) for i in range(len(IDENTITY))]
            for block in text_blocks(batch, "text", BLOCK):
                cut = offsets[block.first_row : block.first_row + block.rows + 1]
                if cut[-1] == cut[0]:
                    continue
                mine = slice(cut[0], cut[-1])
                owner = np.repeat(np.arange(block.rows), np.diff(cut))
                place, key, role, parts, salts = place_all[mine], key_all[mine].view(np.uint64), role_all[mine], parts_all[mine], salts_all[mine]
                starts, ends, rows = block.words()
                word = block.word_hashes(starts, ends)
                base = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=block.rows))[:-1]])
                first, windows = base[owner] + place // 256, place % 256 // 2
                role = role | np.where(place % 2, DOUBLED, 0)
                # Segments of a minimiser with many contents become single windows, routed by their own hash too.
                many = np.where(parts > 0, windows, 1)
                step = ranges(many)
                owner, first, key, role, parts, salts, windows = (np.repeat(x, many) for x in (owner, first, key, role, parts, salts, windows))
                first = first + step
                size = np.where(parts > 0, length, windows + length - 1)
                hot = np.flatnonzero(parts)
                if len(hot):
                    own = span_hashes(word, first[hot], first[hot] + length)
                    key[hot] = mix(key[hot] ^ ((own % parts[hot].astype(np.uint64)) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
                where = first - base[owner]
                if (salts > 1).any():
                    # Streamed pieces go to one salt, indexed ones to all.
                    salt = mix(identity[0][block.first_row + owner].view(np.uint64) ^ mix(where.astype(np.uint64))) % salts.astype(np.uint64)
                    copies = np.where(role & INDEXED, salts, 1)
                    own = np.repeat(salt, copies)
                    every = np.repeat(role & INDEXED, copies) > 0
                    to = np.where(every, ranges(copies).astype(np.uint64), own)
                    owner, first, key, size, where, salts, role = (np.repeat(x, copies) for x in (owner, first, key, size, where, salts, role))
                    role = np.where((salts > 1) & (to != own), role & ~STREAMED, role)
                    key = np.where(salts > 1, mix(key ^ (to + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)), key)
                at = np.repeat(first, size) + ranges(size)
                ends_at = np.concatenate([[0], np.cumsum(8 * size)]).astype(np.int32)
                words = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(ends_at.tobytes()), pa.py_buffer(word[at].tobytes())])
                row = block.first_row + owner
                yield pa.RecordBatch.from_arrays([*(pa.array(x) for x in (key.view(np.int64), *(x[row] for x in identity), where, role.astype(np.int32))), words], names=names)

    return run


class Bits:
    """A bit-packed sequence with the number of ones before any position."""

    def __init__(self, bits: np.ndarray):
        self.packed = np.packbits(np.pad(bits.astype(np.uint8), (0, -len(bits) % 64 + 64)), bitorder="little").view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.packed), dtype=np.int64)]).astype(np.int32)

    def ones(self, position: np.ndarray) -> np.ndarray:
        block = position >> 6
        part = self.packed[block] & ((np.uint64(1) << (position & 63).astype(np.uint64)) - np.uint64(1))
        return self.before[block] + np.bitwise_count(part)


class WaveletMatrix:
    """Rank over a sequence of small integers: one bit-packed level per bit, with popcounts per 64-bit word."""

    def __init__(self, sequence: np.ndarray, sigma: int):
        self.levels = []
        current = sequence
        for shift in range(max(1, int(sigma - 1).bit_length()) - 1, -1, -1):
            bits = ((current >> shift) & 1).astype(np.uint8)
            level = Bits(bits)
            self.levels.append((shift, level, len(sequence) - int(level.before[-1])))
            current = np.concatenate([current[bits == 0], current[bits == 1]])
        self.base = self.descend(np.arange(sigma), np.zeros(sigma, dtype=np.int64))

    def descend(self, symbol: np.ndarray, position: np.ndarray) -> np.ndarray:
        for shift, level, zeros in self.levels:
            ones = level.ones(position)
            position = np.where((symbol >> shift) & 1, zeros + ones, position - ones)
        return position

    def rank(self, symbol: np.ndarray, position: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol before each position."""
        return self.descend(symbol, position) - self.base[symbol]


def suffix_order(symbols: np.ndarray, separators: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array (separators distinct, by place), and the symbols each suffix shares with its predecessor, up to `length`."""
    n = len(symbols)
    rank = symbols.astype(np.int64) + len(separators)
    rank[separators] = np.arange(len(separators))
    span, order, powers = 1, np.argsort(rank, kind="stable"), {1: rank}
    while rank.max() != n - 1 and span < n:
        second = np.zeros(n, dtype=np.int64)
        second[:-span] = rank[span:] + 1
        key = rank * (int(second.max()) + 1) + second
        order = np.argsort(key, kind="stable")
        step = np.ones(n, dtype=np.int64)
        step[0] = 0
        step[1:] = key[order[1:]] != key[order[:-1]]
        rank = np.empty(n, dtype=np.int64)
        rank[order] = np.cumsum(step)
        span *= 2
        if span <= length:
            powers[span] = rank
    shared = np.zeros(n, dtype=np.int64)
    a, b = order[1:], order[:-1]
    for size in sorted(powers, reverse=True):
        ranks = np.append(powers[size], [-1, -2])
        shared[1:] += size * (ranks[np.minimum(a + shared[1:], n)] == ranks[np.where(b + shared[1:] < n, b + shared[1:], n + 1)])
    return order, np.minimum(shared, length).astype(np.int8)


class FMIndex:
    """Backward search over pieces of text, with what matching statistics up to `length` need besides it."""

    def __init__(self, pieces: list[np.ndarray], length: int):
        sizes = np.array([len(p) for p in pieces])
        self.length, self.starts = length, np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
        separators = self.starts + sizes
        self.size = int(separators[-1]) + 1
        text = np.zeros(self.size, dtype=np.int64)
        in_text = np.ones(self.size, dtype=bool)
        in_text[separators] = False
        self.values, codes = np.unique(np.concatenate(pieces), return_inverse=True)
        text[in_text] = codes + 1
        order, shared = suffix_order(text, separators, length)
        sigma = len(self.values) + 1
        self.tree = WaveletMatrix(text[order - 1], sigma)
        self.smaller = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=sigma))[:-1]])
        #: Common prefix with the suffix before; nothing is shared beyond the ends.
        self.shared = np.append(shared, np.int8(0))
        self._edges: dict[int, np.ndarray] = {}
        begins = shared < length
        begins[0] = True
        self.groups = Bits(begins)
        self.earliest = np.minimum.reduceat(order, np.flatnonzero(begins)).astype(np.int32)

    def symbols(self, words: np.ndarray) -> np.ndarray:
        """Symbols of words, -1 for those that the index does not hold."""
        at = np.minimum(np.searchsorted(self.values, words), len(self.values) - 1)
        return np.where(self.values[at] == words, at + 1, -1)

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One step of backward search for many intervals."""
        both = self.tree.rank(np.concatenate([symbol, symbol]), np.concatenate([low, high]))
        return self.smaller[symbol] + both[: len(symbol)], self.smaller[symbol] + both[len(symbol) :]

    def shorten(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The next larger intervals and the lengths of their matches."""
        depth = np.maximum(self.shared[low], self.shared[high]).astype(np.int64)
        depth[(low == 0) & (high == self.size)] = 0
        new_low, new_high = np.zeros_like(low), np.full_like(high, self.size)
        for d in np.unique(depth[depth > 0]):
            if d not in self._edges:
                self._edges[d] = np.append(np.flatnonzero(self.shared[:-1] < d), self.size)
            own, edges = np.flatnonzero(depth == d), self._edges[d]
            new_low[own] = edges[np.searchsorted(edges, low[own], side="right") - 1]
            new_high[own] = edges[np.searchsorted(edges, high[own], side="left")]
        return new_low, new_high, depth

    def matching_statistics(self, pieces: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Per word of the pieces, one after the other: the length of the longest match that starts there, and the
        earliest place of the match in the index where the length reaches the threshold (else -1).

        Lengths are exact up to the threshold and at least the threshold beyond it.
        """
        sizes = np.array([len(p) for p in pieces])
        starts = np.cumsum(sizes) - sizes
        stream = self.symbols(np.concatenate(pieces))
        matched, place = np.zeros(len(stream), dtype=np.int32), np.full(len(stream), -1, dtype=np.int64)
        by_size = np.argsort(-sizes, kind="stable")
        ends, sorted_sizes = (starts + sizes)[by_size], sizes[by_size]
        low, high = np.zeros(len(pieces), dtype=np.int64), np.full(len(pieces), self.size, dtype=np.int64)
        depth = np.zeros(len(pieces), dtype=np.int64)
        for back in range(1, int(sorted_sizes[0]) + 1):
            alive = int(np.searchsorted(-sorted_sizes, -back, side="right"))
            at = ends[:alive] - back
            symbol = stream[at]
            unknown = np.flatnonzero(symbol < 0)
            low[unknown], high[unknown], depth[unknown] = 0, self.size, 0
            todo = np.flatnonzero(symbol >= 0)
            while len(todo):
                new_low, new_high = self.extend(symbol[todo], low[todo], high[todo])
                found = new_high > new_low
                own = todo[found]
                low[own], high[own] = new_low[found], new_high[found]
                depth[own] += 1
                todo = todo[~found]
                if len(todo):
                    low[todo], high[todo], depth[todo] = self.shorten(low[todo], high[todo])
            matched[at] = depth[:alive]
            long = np.flatnonzero(depth[:alive] >= self.length)
            place[at[long]] = self.earliest[self.groups.ones(low[long] + 1) - 1]
        return matched, place


def roles_in_shard(frame: pd.DataFrame, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Flags of the indexed and of the streamed rows of a frame in the order of key, document and place."""
    role, key = frame["role"].to_numpy(), frame["key"].to_numpy()
    given, doubled = role & (INDEXED | STREAMED) > 0, role & DOUBLED > 0
    change = np.concatenate([[True], key[1:] != key[:-1], [True]])
    again = pd.Series(kind).where(~given, -1 - np.arange(len(kind))).duplicated().to_numpy()
    indexed = np.where(given, role & INDEXED > 0, (doubled | ~change[1:]) & ~again)
    return indexed, np.where(given, role & STREAMED > 0, doubled | ~change[:-1])


def repeats_in_shard(frame: pd.DataFrame, length: int) -> pd.DataFrame:
    """(identity of the row, first, n) of the stretches of streamed pieces that also start earlier in the shard."""
    none = pd.DataFrame({c: np.zeros(0, np.int64) for c in (*IDENTITY, "first", "n")})
    kind, _ = pd.factorize(frame["words"])
    is_indexed, is_streamed = roles_in_shard(frame, kind)
    if not is_indexed.any() or not is_streamed.any():
        return none
    indexed, streamed = frame[is_indexed], frame[is_streamed]
    read_words = lambda column: [np.frombuffer(w, dtype=np.uint64) for w in column]
    index = FMIndex(read_words(indexed["words"]), length)
    _, one_of, kind = np.unique(kind[is_streamed], return_index=True, return_inverse=True)
    texts = read_words(streamed["words"].iloc[one_of])
    matched, place = index.matching_statistics(texts)
    sizes = np.array([len(t) for t in texts])
    windows = (sizes - length + 1)[kind]
    row = np.repeat(np.arange(len(streamed)), windows)
    step = ranges(windows)
    at = (np.cumsum(sizes) - sizes)[kind][row] + step
    long = np.flatnonzero(matched[at] >= length)
    row, step, at = row[long], step[long], place[at[long]]
    piece = np.searchsorted(index.starts, at, side="right") - 1
    own = lambda table, c, rows: table[c].to_numpy()[rows]
    same = np.logical_and.reduce([own(indexed, c, piece) == own(streamed, c, row) for c in IDENTITY])
    same &= own(indexed, "first", piece) + at - index.starts[piece] == own(streamed, "first", row) + step
    row, step = row[~same], step[~same]
    if not len(row):
        return none
    begin = np.flatnonzero(np.append(True, (np.diff(step) != 1) | (row[1:] != row[:-1])))
    count = np.diff(np.append(begin, len(row)))
    head = row[begin]
    return pd.DataFrame({c: own(streamed, c, head) for c in IDENTITY} | {"first": own(streamed, "first", head) + step[begin], "n": count + length - 1})


def _search(length: int, shard_words: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        total = 0
        for frame in by_unit(frames, ["key"]):
            load = np.cumsum(frame["words"].str.len().to_numpy() // 8)
            key = frame["key"].to_numpy()
            cuts = np.flatnonzero(key[1:] != key[:-1]) + 1
            low, done = 0, 0
            for cut in [*cuts[np.flatnonzero(np.diff(load[cuts - 1] // shard_words, prepend=0))], len(frame)]:
                if cut > low:
                    held.append(frame.iloc[low:cut])
                    total += int(load[cut - 1]) - done
                    low, done = int(cut), int(load[cut - 1])
                    if total >= shard_words:
                        yield repeats_in_shard(pd.concat(held, ignore_index=True), length)
                        held, total = [], 0
        if held:
            yield repeats_in_shard(pd.concat(held, ignore_index=True), length)

    return run


def _cut():
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            spans = batch.column(batch.schema.get_field_index("spans"))
            spans_valid = np.asarray(spans.is_valid())
            offsets = np.asarray(spans.offsets).astype(np.int64)
            first_all, n_all = np.asarray(spans.values.field("first")), np.asarray(spans.values.field("n"))
            n_words = np.zeros(batch.num_rows, np.int64)
            removed = np.zeros(batch.num_rows, np.int64)
            digests: list[str] = []
            for block in text_blocks(batch, "text", BLOCK):
                starts, ends, rows = block.words()
                counts = np.bincount(rows, minlength=block.rows)
                base = np.concatenate([[0], np.cumsum(counts)])
                gone = np.zeros(len(starts) + 1, dtype=np.int64)
                for r in np.flatnonzero(spans_valid[block.first_row : block.first_row + block.rows]):
                    lo, hi = offsets[block.first_row + r], offsets[block.first_row + r + 1]
                    np.add.at(gone, base[r] + first_all[lo:hi], 1)
                    np.add.at(gone, base[r] + first_all[lo:hi] + n_all[lo:hi], -1)
                keep = np.cumsum(gone[:-1]) == 0
                step = np.zeros(len(block.data) + 1, dtype=np.int8)
                step[starts[keep]] += 1
                step[ends[keep]] -= 1
                inside = np.cumsum(step[:-1], dtype=np.int8) > 0
                data = block.data.copy()
                tails = ends[keep]
                tails = tails[tails < len(data)]
                gap = tails[~inside[tails]]
                data[gap] = 32
                inside[gap] = True
                place = np.concatenate([[0], np.cumsum(inside)])
                joined = data[inside].tobytes()
                kept = np.bincount(rows[keep], minlength=block.rows)
                word_base = np.concatenate([[0], np.cumsum(kept)])
                ks, ke = starts[keep], ends[keep]
                for r in range(block.rows):
                    a, b = word_base[r], word_base[r + 1]
                    digests.append(hashlib.sha256(joined[place[ks[a]] : place[ke[b - 1] - 1] + 1] if b > a else b"").hexdigest())
                n_words[block.first_row : block.first_row + block.rows] = counts
                removed[block.first_row : block.first_row + block.rows] = counts - kept
            yield pa.RecordBatch.from_arrays([ids, pa.array(n_words), pa.array(removed), pa.array(digests, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    return run


def _texts(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """The identity of each row (doc stands for the id in orders, the keys tell texts of one id apart), doc_id, text."""
    return docs.select(*row_identity(F.col(id_column), F.col(text_column))[: len(IDENTITY)], F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))


def repeated_spans(docs: DataFrame, length: int = 20, anchor: int = 6, kinds: int = 128, rows: int = 1024, shard_words: int = 1 << 17, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(identity of the row, first, n): stretches of n words from word `first` of a document, all covered by repeats."""
    texts, longs = _texts(docs, id_column, text_column), ", ".join(f"{c} long" for c in IDENTITY)
    segments = texts.select(*IDENTITY, "text").mapInArrow(_segment_rows(length, anchor), f"minimiser long, content long, {longs}, place long")
    often = segments.groupBy("minimiser").agg(F.sum(1 + F.col("place") % 2).alias("__n"), F.count(F.lit(1)).alias("n")).where("__n > 1").select("minimiser", "n")
    found = checkpointed(segments.join(often, "minimiser"))
    none = F.lit(0)
    plain = found.where(F.col("n") <= rows).select(*IDENTITY, F.struct("place", "minimiser", none.alias("role"), none.alias("parts"), F.lit(1).alias("salts")).alias("w"))
    crowded = found.where(F.col("n") > rows)
    at = F.struct(*IDENTITY, "place")
    contents = crowded.groupBy("minimiser", "content").agg(F.min(at).alias("first"))
    counted = contents.groupBy("minimiser").agg(F.count(F.lit(1)).alias("kinds"))
    # A content has 64 windows at most and 8 as a rule.
    parts = F.when(F.col("kinds") > kinds, F.ceil(F.col("kinds") / kinds) * 16).otherwise(0).cast("int")
    judged = contents.join(counted.select("minimiser", parts.alias("parts")), "minimiser")
    role = F.lit(STREAMED) + F.when(at == F.col("first"), INDEXED).otherwise(0)
    salted = crowded.join(judged, ["minimiser", "content"]).select(*IDENTITY, F.struct("place", "minimiser", role.alias("role"), "parts", F.ceil(F.col("n") / rows).cast("int").alias("salts")).alias("w"))
    wanted = plain.unionByName(salted).groupBy(*IDENTITY).agg(F.collect_list("w").alias("wanted"))
    # Two plans read the same exchange of the texts: this one and the cut in remove_repeats.
    pieces = texts.join(wanted, list(IDENTITY), "left").select(*IDENTITY, "text", "wanted", "doc_id").mapInArrow(_pieces(length), f"key long, {longs}, first long, role int, words binary")
    ordered = pieces.repartition("key").sortWithinPartitions("key", *IDENTITY, "first")
    return ordered.mapInPandas(_search(length, shard_words), f"{longs}, first long, n long")


def remove_repeats(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", **options) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of every row once the repeated stretches are cut out."""
    texts = _texts(docs, id_column, text_column)
    spans = repeated_spans(docs, id_column=id_column, text_column=text_column, **options)
    by_doc = spans.groupBy(*IDENTITY).agg(F.collect_set(F.struct("first", "n")).alias("spans"))
    joined = texts.join(by_doc, list(IDENTITY), "left").select("doc_id", "text", "spans", *IDENTITY)
    return joined.mapInArrow(_cut(), "doc_id long, n_words long, n_removed long, kept_sha256 string")


def op10_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty-word repeats removed from all documents."""
    return remove_repeats(read(spark, sf_dir, "documents"))


def queries() -> dict:
    return {"op10_substring": op10_substring}


def oracle_sql() -> dict[str, str]:
    return {}
