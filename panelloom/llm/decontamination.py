r"""Benchmark decontamination with a distributed positional inverted index.

The documents are indexed once: each block of whole texts becomes one row with the postings of its words (terms sorted,
their positions in one array), and the table is written before it is searched. Only words that a benchmark may hold are
posted: a bit table of fixed size, made from the benchmark's vocabulary, lets a posting pass or not; what it lets through
wrongly costs a posting, never a result. Terms are known by two independent 64-bit hashes.

A window is `length` consecutive words of an item, or all words of a shorter one. Equal windows of the benchmark are one.
Document frequencies from the index order the terms of every window by rarity over all documents; windows with a term
that no document holds are left out. In each block the postings of the rarest term give the candidate places; the lists
of the other terms, moved by their offsets, are intersected with them from the next rarest on. With slop > 0 a term may
stand up to so many words from its place: that is a proximity match, an exact one has no distance. Windows are shipped to
the blocks `ship` at a time, so a larger benchmark takes more passes over the index, not more memory.

Edge cases: null and empty texts have no words; an item without words has no window; rows that repeat a doc_id are
documents of their own; rows that repeat an item_id are one item with the windows of all; a null item_id is written as the
empty string; documents keep a null doc_id; an empty table on either side gives no hit; extra columns are ignored. Places
between documents of a block are left free, so no match goes over an end.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelloom.llm._spark import checkpointed, read
from panelloom.llm._text import TextBlock, ranges, span_hashes, text_blocks

#: Fixed value: bytes that part words once A-Z is lower-cased, the complement of [^\x00-\x2F\x3A-\x60\x7B-\x7F].
IS_BREAK = np.zeros(256, dtype=bool)
IS_BREAK[:128] = [not (48 <= b <= 57 or 97 <= b <= 122) for b in range(128)]
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Free places between the documents of a block; more than a window and its slop.
GAP = 64
#: Bits of the vocabulary table.
VOCABULARY_BITS = 24
#: Candidates that a task compares at a time.
CANDIDATES = 1 << 21
INDEX = "block long, doc_ids array<long>, n_words array<long>, first binary, second binary, upto binary, positions binary"
WINDOWS = "item_id string, w1 long, w2 long, t1 array<long>, t2 array<long>"
FOUND = "block long, doc long, kind int, a long, b long"
#: Kinds of found rows: words a to b - 1 of a document are hit; window (a, b) occurs; window (a, b) is near.
SPAN, EXACT, NEAR = 0, 1, 2


def _words(batch: pa.RecordBatch, limit: int) -> Iterator[tuple[TextBlock, np.ndarray, np.ndarray, np.ndarray]]:
    for block in text_blocks(batch, "text", limit):
        lowered = TextBlock(_LOWER[block.data], block.offsets, block.first_row)
        yield lowered, *lowered.words(IS_BREAK)


def _windows(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, starts, ends, rows in _words(batch, 1 << 20):
                one, two = block.word_hashes(starts, ends), block.second_hashes(starts, ends)
                counts = np.bincount(rows, minlength=block.rows)
                size = np.minimum(counts, length)
                many = np.where(counts > 0, counts - size + 1, 0)
                owner = np.repeat(np.arange(block.rows), many)
                first = np.repeat(np.cumsum(counts) - counts, many) + ranges(many)
                last = first + size[owner]
                at = np.repeat(first, size[owner]) + ranges(size[owner])
                offsets = pa.array(np.concatenate([[0], np.cumsum(size[owner])]), pa.int32())
                lists = [pa.ListArray.from_arrays(offsets, pa.array(h[at].view(np.int64))) for h in (one, two)]
                keys = [pa.array(span_hashes(h, first, last).view(np.int64)) for h in (one, two)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(block.first_row + owner)), *keys, *lists], names=["item_id", "w1", "w2", "t1", "t2"])

    return run


def benchmark_windows(items: DataFrame, length: int = 10, id_column: str = "item_id", text_column: str = "text") -> DataFrame:
    """(item_id as string, w1, w2, t1, t2): the windows of every item, known by 128 bits, and their terms in order."""
    rows = items.select(F.coalesce(F.col(id_column).cast("string"), F.lit("")).alias("item_id"), F.col(text_column).alias("text"))
    return rows.mapInArrow(_windows(length), WINDOWS)


def vocabulary_bits(windows: DataFrame) -> np.ndarray:
    """The bit table of the words of all windows: 2**VOCABULARY_BITS bits, whatever their number."""
    terms = windows.select(F.explode("t1").alias("t"))
    slots = terms.select(F.shiftrightunsigned("t", 64 - VOCABULARY_BITS).alias("slot")).distinct()
    cells = slots.groupBy(F.shiftright("slot", 3).alias("cell")).agg(F.sum(F.expr("shiftleft(1, cast(slot % 8 as int))")).alias("bits"))
    table = np.zeros(1 << (VOCABULARY_BITS - 3), dtype=np.uint8)
    found = cells.toPandas()
    table[found["cell"].to_numpy(np.int64)] = found["bits"].to_numpy(np.int64)
    return table


def _post(shipped, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, number = shipped.value, TaskContext.get().partitionId() << 32
        for batch in batches:
            for block, starts, ends, rows in _words(batch, limit):
                one = block.word_hashes(starts, ends)
                slot = (one >> np.uint64(64 - VOCABULARY_BITS)).astype(np.int64)
                kept = np.flatnonzero(table[slot >> 3] >> (slot & 7).astype(np.uint8) & 1)
                position = kept + rows[kept] * GAP
                one, two = one[kept], block.second_hashes(starts[kept], ends[kept])
                order = np.lexsort((two, one))
                one, two, position = one[order], two[order], position[order]
                new = np.ones(len(one), dtype=bool)
                new[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1])
                terms = np.flatnonzero(new)
                upto = np.append(terms[1:], len(one)) if len(terms) else terms
                counts = np.bincount(rows, minlength=block.rows).astype(np.int64)
                ids = batch.column(0).slice(block.first_row, block.rows)
                binary = [pa.array([x.tobytes()], pa.binary()) for x in (one[terms], two[terms], upto.astype(np.int32), position.astype(np.int32))]
                lists = [pa.ListArray.from_arrays(pa.array([0, block.rows], pa.int32()), x) for x in (ids, pa.array(counts))]
                yield pa.RecordBatch.from_arrays([pa.array([number]), *lists, *binary], names=["block", "doc_ids", "n_words", "first", "second", "upto", "positions"])
                number += 1

    return run


def positional_index(docs: DataFrame, table: np.ndarray, limit: int = 1 << 21, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per block of about `limit` bytes of whole texts: its documents and the postings of its terms.

    Term i has the 128 bits first[i], second[i] and the positions from upto[i - 1] to upto[i]. Position p of word w of
    document d is w + the words of the documents before d + d * GAP. The table is written, so blocks stay as they are.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(table)
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    return checkpointed(rows.mapInArrow(_post(shipped, limit), INDEX))


def _longs(value: pa.Scalar, kind=np.uint64) -> np.ndarray:
    return np.frombuffer(value.as_buffer(), dtype=kind)


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for one, two, upto in zip(*(batch.column(i) for i in range(3))):
            counts = np.diff(_longs(upto, np.int32), prepend=0).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(_longs(one, np.int64)), pa.array(_longs(two, np.int64)), pa.array(counts)], names=["t1", "t2", "n"])


def ordered_windows(index: DataFrame, windows: DataFrame) -> DataFrame:
    """(w1, w2, t1, t2, by_rarity): distinct windows whose terms all occur; by_rarity has the places of their terms."""
    distinct = windows.groupBy("w1", "w2").agg(F.first("t1").alias("t1"), F.first("t2").alias("t2"))
    frequency = index.select("first", "second", "upto").mapInArrow(_frequencies, "t1 long, t2 long, n long").groupBy("t1", "t2").agg(F.sum("n").alias("n"))
    terms = distinct.select("w1", "w2", F.size("t1").alias("size"), F.posexplode(F.arrays_zip("t1", "t2")).alias("at", "t")).select("w1", "w2", "size", "at", "t.t1", "t.t2")
    known = terms.join(frequency, ["t1", "t2"]).groupBy("w1", "w2", "size").agg(F.sort_array(F.collect_list(F.struct("n", "at"))).alias("order")).where(F.size("order") == F.col("size"))
    return distinct.join(known.select("w1", "w2", F.col("order.at").alias("by_rarity")), ["w1", "w2"])


def pack_windows(rows: list) -> dict[str, np.ndarray]:
    """Windows as arrays: terms numbered in order of rarity, with their offsets; -1 beyond the end of a short window."""
    width = max(len(r.t1) for r in rows)
    term, offset = np.full((len(rows), width, 2), 0, dtype=np.int64), np.zeros((len(rows), width), dtype=np.int64)
    size = np.array([len(r.t1) for r in rows])
    for i, r in enumerate(rows):
        offset[i, : size[i]] = r.by_rarity
        term[i, : size[i], 0] = np.take(r.t1, r.by_rarity)
        term[i, : size[i], 1] = np.take(r.t2, r.by_rarity)
    real = np.arange(width)[None, :] < size[:, None]
    known, number = np.unique(term[real], axis=0, return_inverse=True)
    numbers = np.full((len(rows), width), -1, dtype=np.int64)
    numbers[real] = number.reshape(-1)
    return {"w1": np.array([r.w1 for r in rows]), "w2": np.array([r.w2 for r in rows]), "size": size, "offset": offset, "number": numbers, "first": known[:, 0].view(np.uint64), "second": known[:, 1].view(np.uint64)}


def _places(first: np.ndarray, second: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Row of each term (one, two) in the table (first, second) sorted by both, -1 where it is absent."""
    low, high = np.searchsorted(first, one, side="left"), np.searchsorted(first, one, side="right")
    place = np.full(len(one), -1, dtype=np.int64)
    for step in range(int((high - low).max(initial=0))):
        at = np.minimum(low + step, len(first) - 1)
        place = np.where((low + step < high) & (second[at] == two), at, place)
    return place


def matches_in_block(windows: dict, first, second, upto, positions, slop: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(window, start, distance) of all matches, some windows at a time; distance is the largest of any term."""
    place = _places(first, second, windows["first"], windows["second"])
    number, size, offset = windows["number"], windows["size"], windows["offset"]
    term = np.where(number >= 0, place[number], -2)
    here = np.flatnonzero((term != -1).all(axis=1))
    if not len(here):
        return
    begins = np.concatenate([[0], upto[:-1]]).astype(np.int64)
    far = 1 << 40
    keys = np.repeat(np.arange(len(upto)), upto - begins) * far + positions
    many = (upto - begins)[term[here, 0]]
    cuts = np.flatnonzero(np.diff(np.cumsum(many) // CANDIDATES, prepend=0))
    for some in np.split(np.arange(len(here)), cuts):
        own, count = here[some], many[some]
        window = np.repeat(own, count)
        start = positions[np.repeat(begins[term[own, 0]], count) + ranges(count)] - offset[window, 0]
        distance = np.zeros(len(window), dtype=np.int64)
        for k in range(1, number.shape[1]):
            asked = np.flatnonzero(size[window] > k)
            if not len(asked):
                break
            w = window[asked]
            wanted = term[w, k] * far + start[asked] + offset[w, k]
            at = np.searchsorted(keys, wanted)
            after, before = keys[np.minimum(at, len(keys) - 1)], keys[np.maximum(at - 1, 0)]
            away = np.minimum(np.abs(after - wanted), np.abs(wanted - before))
            distance[asked] = np.maximum(distance[asked], away)
            left = distance <= slop
            window, start, distance = window[left], start[left], distance[left]
        if len(window):
            yield window, start, distance


def _search(shipped, slop: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = shipped.value
        for batch in batches:
            for block, counts, first, second, upto, positions in zip(*(batch.column(i) for i in range(6))):
                upto = _longs(upto, np.int32).astype(np.int64)
                if not len(upto):
                    continue
                counts = np.asarray(counts.values)
                base = np.cumsum(counts) - counts + np.arange(len(counts)) * GAP
                covered = np.zeros(base[-1] + counts[-1] + 2, dtype=np.int32)
                seen = []
                for window, start, distance in matches_in_block(windows, _longs(first), _longs(second), upto, _longs(positions, np.int32).astype(np.int64), slop):
                    rarest = start + windows["offset"][window, 0]
                    doc, exact = np.searchsorted(base, rarest, side="right") - 1, distance == 0
                    np.add.at(covered, start[exact], 1)
                    np.add.at(covered, start[exact] + windows["size"][window[exact]], -1)
                    seen.append(np.unique(np.stack([doc, np.where(exact, EXACT, NEAR), window], axis=1), axis=0))
                if not seen:
                    continue
                inside = np.concatenate([[0], (np.cumsum(covered) > 0).astype(np.int8), [0]])
                edges = np.diff(inside)
                begin, end = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
                owner = np.searchsorted(base, begin, side="right") - 1
                doc, kind, window = np.unique(np.concatenate(seen), axis=0).T
                columns = [
                    np.concatenate([owner, doc]),
                    np.concatenate([np.full(len(owner), SPAN), kind]).astype(np.int32),
                    np.concatenate([begin - base[owner], windows["w1"][window]]),
                    np.concatenate([end - base[owner], windows["w2"][window]]),
                ]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(columns[0]), block.as_py())), *map(pa.array, columns)], names=["block", "doc", "kind", "a", "b"])

    return run


def search(index: DataFrame, windows: DataFrame, slop: int = 0, ship: int = 1 << 17) -> DataFrame:
    """(block, doc, kind, a, b): hit words, exact and near windows of the documents of an index."""
    if not 0 <= slop < GAP // 2:
        raise ValueError("slop must be smaller than half the gap between documents")
    spark = index.sparkSession
    ordered = checkpointed(ordered_windows(index, windows))
    passes = -(-ordered.count() // ship)
    columns = index.select("block", "n_words", "first", "second", "upto", "positions")
    found = [spark.createDataFrame([], FOUND)]
    for number in range(passes):
        # Windows are dealt by their hash: one pass takes about `ship` of them.
        some = ordered.where(F.expr(f"pmod(w1, {passes}) = {number}")).collect()
        if some:
            shipped = spark.sparkContext.broadcast(pack_windows(some))
            found.append(columns.mapInArrow(_search(shipped, slop), FOUND))
    return checkpointed(reduce(DataFrame.unionAll, found))


def documents_of(index: DataFrame) -> DataFrame:
    """(block, doc, doc_id, n_words) of every indexed document."""
    return index.select("block", F.posexplode(F.arrays_zip("doc_ids", "n_words")).alias("doc", "d")).select("block", F.col("doc").cast("long").alias("doc"), "d.doc_ids", "d.n_words").withColumnRenamed("doc_ids", "doc_id")


def hit_spans(found: DataFrame) -> DataFrame:
    """(block, doc, spans): the hit stretches [a, b) of words of each hit document, in order and apart."""
    lists = found.where(F.col("kind") == SPAN).groupBy("block", "doc").agg(F.sort_array(F.collect_set(F.struct("a", "b"))).alias("all"))
    # Stretches of several passes may overlap: one that begins inside those before it is what is left of it.
    fold = "aggregate(all, named_struct('to', 0L, 'out', cast(array() as array<struct<a: bigint, b: bigint>>)), (s, x) -> named_struct('to', greatest(s.to, x.b), 'out', if(x.b <= s.to, s.out, concat(s.out, array(named_struct('a', greatest(s.to, x.a), 'b', x.b))))), s -> s.out)"
    return lists.select("block", "doc", F.expr(fold).alias("spans"))


def decontaminate(docs: DataFrame, items: DataFrame, length: int = 10, slop: int = 0, limit: int = 1 << 21, ship: int = 1 << 17) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans, items, near_items) of every document.

    spans: the hit words; items: those with an occurring window; near_items: those with a window that matches within
    `slop`, exact or not. Both are sorted as strings.
    """
    windows = checkpointed(benchmark_windows(items, length))
    index = positional_index(docs, vocabulary_bits(windows), limit)
    found = search(index, windows, slop, ship)
    items_of = windows.select(F.col("w1").alias("a"), F.col("w2").alias("b"), "item_id").distinct()
    # Half of the documents may hit one window: a table of up to `ship` rows is met without a shuffle by window.
    items_of = F.broadcast(items_of) if items_of.count() <= ship else items_of
    named = found.where(F.col("kind") != SPAN).join(items_of, ["a", "b"]).groupBy("block", "doc", "item_id").agg(F.min("kind").alias("kind"))
    lists = named.groupBy("block", "doc").agg(F.sort_array(F.collect_list(F.when(F.col("kind") == EXACT, F.col("item_id")))).alias("items"), F.sort_array(F.collect_list("item_id")).alias("near_items"))
    empty = F.array().cast("array<string>")
    joined = documents_of(index).join(hit_spans(found), ["block", "doc"], "left").join(lists, ["block", "doc"], "left")
    held = joined.withColumns({"items": F.coalesce("items", empty), "near_items": F.coalesce("near_items", empty), "n_hit": F.coalesce(F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x.b - x.a), F.lit(0).cast("long"))})
    return held.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), "spans", "items", "near_items")


def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against the ten-word windows of the whole benchmark."""
    return decontaminate(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")).drop("spans", "items", "near_items")


ORACLE = r"""
with d as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents
), b as (
  select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark
), s as (select item_id, w, least(10, len(w)) as l from b where len(w) > 0),
g as (select distinct item_id, l, array_to_string(w[i:i + l - 1], ' ') as p from (select *, unnest(range(1, len(w) - l + 2)) as i from s)),
n as (select distinct l from g),
t as (select doc_id, l, i, array_to_string(w[i:i + l - 1], ' ') as p from (select doc_id, w, l, unnest(range(1, len(w) - l + 2)) as i from d, n where len(w) >= l)),
m as (select t.doc_id, t.i, t.l, g.item_id from t join g using (l, p)),
h as (select doc_id, count(distinct k) as n_hit from (select doc_id, unnest(range(i, i + l)) as k from m) group by doc_id),
j as (
  select doc_id, count(*) as n_items, sha256(string_agg(item, ',' order by item)) as items_sha256
  from (select distinct doc_id, item_id::varchar as item from m) group by doc_id
)
select d.doc_id, len(d.w)::bigint as n_words, coalesce(h.n_hit, 0)::bigint as n_hit, coalesce(j.n_items, 0)::bigint as n_items,
       coalesce(j.items_sha256, sha256('')) as items_sha256, coalesce(h.n_hit, 0) > 0 as contaminated
from d left join h using (doc_id) left join j using (doc_id)
"""


def queries() -> dict:
    return {"op13_decontamination": op13_decontamination}


def oracle_sql() -> dict[str, str]:
    return {"op13_decontamination": ORACLE}
