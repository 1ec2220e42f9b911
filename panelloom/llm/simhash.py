"""SimHash near-duplicates by anchor-point covering.

Each document gets one or more 64-bit SimHash words over its word shingles. Every word is cut into two halves of
32 bits, each punctured to 31. The anchors are the codewords of the perfect Hamming(31, 26) code (covering radius
1). Two words that differ in at most three bits agree in one half up to one bit, so on that half the anchor within
distance 1 of the one lies within distance 2 (covering radius plus threshold) of the other: every fingerprint is
sent to all anchors within distance 2 (1 or 16 of 2**26) and compared only with what meets it there. Distinct
fingerprints travel, not documents, and cells of any size are cut.

For similarities as low as 0.8 no exact covering is affordable: such pairs differ in some 15 % of all bits. With
several words the same code is laid over many blocks of 31 bits drawn from all words, with threshold 0 in each: a
fingerprint goes to the one anchor within the covering radius of each block. Two fingerprints whose bits differ with
probability p share the anchor of a block with probability about (1 - p)**26, against 2**-26 at chance. similar_texts() uses that to
find candidates only, under a loose limit of bits, and decides by the exact Jaccard similarity of the shingle sets.

Edge cases: a null text and a text without words have fingerprint zero, linked like any other; fewer words than
the shingle length make one shingle; equal rows share a component; an empty table gives an empty result; other
columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelloom.llm import _tiles
from panelloom.llm._spark import checkpointed, components, free_shuffles, read, row_hash, whole_row
from panelloom.llm._text import TextBlock, mix, text_blocks

XXH64_SEED = 42
#: With several words, a pair is a candidate only if 31 fixed bits of theirs differ in at most so many, whatever the size of
#: the cell they meet in: at similarity 0.8 that is 5 on average and over 12 for one pair in some 3000, at chance 15.
SKETCH_BITS = 12
#: Pairs that a task holds before it sends on a spanning forest of them; components need no more than that.
HELD_PAIRS = 1 << 19
#: Rounds of blocks: in each the bits of all words are shuffled and cut into disjoint blocks of 31.
ROUNDS = 8
_LANES = np.uint64(0x0101010101010101)
#: Masks of the five parity checks of Hamming(31, 26): bit p - 1 stands for position p = 1..31.
_CHECKS = [np.uint32(sum(1 << (p - 1) for p in range(1, 32) if p >> b & 1)) for b in range(5)]


def majority(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For consecutive groups of `counts` hashes: the 64-bit word of the bits set in over half of each group."""
    out = np.zeros(len(counts), dtype=np.uint64)
    full = np.flatnonzero(counts)
    if not len(full):
        return out
    n = counts[full]
    starts = np.concatenate([[0], np.cumsum(n)[:-1]])
    pieces = -(-n // 255)
    first_piece = np.concatenate([[0], np.cumsum(pieces)[:-1]])
    piece = np.arange(pieces.sum()) - np.repeat(first_piece, pieces)
    piece_starts = np.repeat(starts, pieces) + 255 * piece
    for bit in range(8):
        lanes = np.add.reduceat((hashes >> np.uint64(bit)) & _LANES, piece_starts)
        sums = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), first_piece, axis=0)
        for lane in range(8):
            out[full] |= (2 * sums[:, lane] > n).astype(np.uint64) << np.uint64(8 * lane + bit)
    return out


def shingle_xxh64(block: TextBlock, k: int) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 (seed 42) of each lower-cased (A-Z) k-word shingle joined by spaces, and the shingles per row."""
    import xxhash

    data = block.data.copy()
    upper = (data >= 65) & (data <= 90)
    data[upper] += 32
    starts, ends, rows = block.words()
    n_words = np.bincount(rows, minlength=block.rows)
    counts = np.where(n_words >= k, n_words - k + 1, np.minimum(n_words, 1))
    if not len(starts):
        return np.zeros(0, np.uint64), counts
    keep = np.zeros(len(data) + 1, dtype=bool)
    step = np.zeros(len(data) + 1, dtype=np.int8)
    step[starts] += 1
    step[ends] -= 1
    keep[:-1] = np.cumsum(step[:-1], dtype=np.int8) > 0
    gap = ends[(ends < len(data))]
    gap = gap[~keep[gap]]
    data[gap] = 32
    keep[gap] = True
    place = np.concatenate([[0], np.cumsum(keep[:-1])])
    buffer = data[keep[:-1]].tobytes()
    first_word = np.concatenate([[0], np.cumsum(n_words)[:-1]])
    full = np.flatnonzero(counts)
    begin_of = np.concatenate([[0], np.cumsum(counts[full])[:-1]])
    first = np.repeat(first_word[full] - begin_of, counts[full]) + np.arange(counts.sum())
    last = first + np.repeat(np.minimum(n_words[full], k) - 1, counts[full])
    digest = xxhash.xxh64_intdigest
    spans = zip(place[starts[first]].tolist(), (place[ends[last] - 1] + 1).tolist())
    return np.fromiter((digest(buffer[a:b], XXH64_SEED) for a, b in spans), np.uint64, len(first)), counts


def fingerprints(docs: DataFrame, k: int = 3, words: int = 1, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, fp0, fp1, ...): signed 64-bit SimHash words; fp0 is over XXH64 itself, the others over remixed hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for block in text_blocks(batch, "text"):
                hashes, counts = shingle_xxh64(block, k)
                arrays = [ids.slice(block.first_row, block.rows)]
                for w in range(words):
                    own = hashes if w == 0 else mix(hashes ^ np.uint64(w * 0xA24BAED4963EE407 % 2**64))
                    arrays.append(pa.array(majority(own, counts).view(np.int64)))
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", *[f"fp{w}" for w in range(words)]])

    schema = ", ".join(["doc_id long", *[f"fp{w} long" for w in range(words)]])
    return docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text")).mapInArrow(run, schema)


def covering_anchors(half: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and codewords of Hamming(31, 26) within distance 2 of each 31-bit value."""
    half = half.astype(np.uint32)
    syndrome = np.zeros(len(half), dtype=np.uint32)
    for b, mask in enumerate(_CHECKS):
        syndrome |= (np.bitwise_count(half & mask).astype(np.uint32) & np.uint32(1)) << np.uint32(b)
    flip = lambda p: np.where(p > 0, np.uint32(1) << (np.maximum(p, 1) - 1).astype(np.uint32), 0).astype(np.uint32)
    rows, anchors = [np.arange(len(half))], [half ^ flip(syndrome)]
    odd = np.flatnonzero(syndrome)
    for p in range(1, 32):
        q = syndrome[odd] ^ np.uint32(p)
        use = q > p
        rows.append(odd[use])
        anchors.append(half[odd[use]] ^ np.uint32(1 << (p - 1)) ^ flip(q[use]))
    return np.concatenate(rows), np.concatenate(anchors)


def _anchor_rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Cells of one word: every anchor within distance 2 of each half."""
    for frame in frames:
        node = frame["node"].to_numpy()
        value = frame["fp0"].to_numpy().view(np.uint64)
        for side in range(2):
            half = (value >> np.uint64(32 * side)) & np.uint64(0x7FFFFFFF)
            rows, anchors = covering_anchors(half)
            yield pd.DataFrame({"cell": anchors.astype(np.int64) + (side << 32), "node": node[rows]})


def nearest_anchors(block: np.ndarray) -> np.ndarray:
    """The codeword of Hamming(31, 26) within distance 1 of each 31-bit value."""
    block = block.astype(np.uint32)
    syndrome = np.zeros(len(block), dtype=np.uint32)
    for b, mask in enumerate(_CHECKS):
        syndrome |= (np.bitwise_count(block & mask).astype(np.uint32) & np.uint32(1)) << np.uint32(b)
    return block ^ np.where(syndrome > 0, np.uint32(1) << (np.maximum(syndrome, 1) - np.uint32(1)), np.uint32(0)).astype(np.uint32)


def _block_rows(words: int, rounds: int, first: int = 0):
    """Cells of several words: the nearest anchor of every block of the rounds from `first` to `rounds`."""
    rng = np.random.default_rng(XXH64_SEED)
    a_round = 64 * words // 31
    blocks = [order[31 * i : 31 * i + 31] for order in (rng.permutation(64 * words) for _ in range(rounds)) for i in range(a_round)]
    numbered = list(enumerate(blocks))[a_round * first :]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            node = frame["node"].to_numpy()
            own = {c: frame[c] for c in frame.columns if c == "component"}
            packed = np.stack([frame[f"fp{w}"].to_numpy() for w in range(words)], axis=1).view(np.uint8)
            bits = np.ascontiguousarray(np.unpackbits(packed, axis=1, bitorder="little").T)
            for number, chosen in numbered:
                value = np.zeros(len(frame), dtype=np.uint32)
                for place, bit in enumerate(chosen):
                    value |= bits[bit].astype(np.uint32) << np.uint32(place)
                yield pd.DataFrame({"cell": nearest_anchors(value).astype(np.int64) + (number << 32), "node": node, **own})

    return run


def _compare(words: int, max_bits: int):
    """Links inside units, as spanning forests; of a cell that was cut a row (cell, null) besides."""
    keys = ["cell", "__ti", "__tj"]
    names = [f"fp{w}" for w in range(words)]

    def near(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether the words a, b of the nodes i, j are near enough."""
        close = sum(np.bitwise_count(a[w] ^ b[w]).astype(np.int16) for w in range(words)) <= max_bits
        return close if words == 1 else close & (np.bitwise_count((i ^ j) & np.int64(_LOW)) <= SKETCH_BITS)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n_held = [], 0
        for frame in _tiles.by_unit(frames, keys):
            bounds = _tiles.unit_bounds(frame, keys)
            heads = frame.iloc[bounds[:-1]]
            crowded = heads.loc[(heads["__g"] > 1) & (heads["__ti"] == 0), "cell"]
            if len(crowded):
                yield pd.DataFrame({"a": crowded, "b": pd.array([None] * len(crowded), dtype="Int64")})
            node = frame["node"].to_numpy()
            value = np.stack([frame[c].to_numpy().view(np.uint64) for c in names])
            sizes = np.diff(bounds)
            unit = np.repeat(np.arange(len(sizes)), sizes)
            small = np.repeat(sizes <= 8, sizes)
            left, right = [], []
            for s in range(1, min(8, len(node))):
                i = np.flatnonzero((unit[s:] == unit[:-s]) & small[s:])
                i = i[near(value[:, i], value[:, i + s], node[i], node[i + s])]
                left.append(node[i])
                right.append(node[i + s])
            for u in np.flatnonzero(sizes > 8):
                v = value[:, bounds[u] : bounds[u + 1]]
                members = node[bounds[u] : bounds[u + 1]]
                root = _tiles.dense_components(near(v[:, :, None], v[:, None, :], members[:, None], members[None, :]))
                own = np.flatnonzero(root != np.arange(len(root)))
                left.append(members[own])
                right.append(members[root[own]])
            held += zip(left, right)
            n_held += sum(map(len, left))
            if n_held > HELD_PAIRS:
                a, b = _tiles.spanning_edges(*map(np.concatenate, zip(*held)))
                yield pd.DataFrame({"a": a, "b": b})
                held, n_held = [], 0
        if n_held:
            a, b = _tiles.spanning_edges(*map(np.concatenate, zip(*held)))
            yield pd.DataFrame({"a": a, "b": b})

    return run


#: Bits of a node that are fp0's own, where a fingerprint has several words.
_LOW = 0x7FFFFFFF


def _node(words: int) -> Column:
    """fp0, or of several words 33 bits of their hash and 31 bits of fp0, which tell how far two nodes are apart."""
    low = F.lit(_LOW).cast("long")
    return F.col("fp0") if words == 1 else F.xxhash64(*[f"fp{w}" for w in range(words)]).bitwiseAND(F.bitwise_not(low)).bitwiseOR(F.col("fp0").bitwiseAND(low))


def _compared(units: DataFrame, prints: DataFrame, words: int, max_bits: int) -> DataFrame:
    ordered = units.select("cell", "node", "__ti", "__tj", "__g").join(prints, "node").repartition("cell", "__ti", "__tj").sortWithinPartitions("cell", "__ti", "__tj", "node")
    return checkpointed(ordered.mapInPandas(_compare(words, max_bits), "a long, b long"))


def _links(prints: DataFrame, words: int, max_bits: int, tile: int, passes: list) -> DataFrame:
    """(node, component) of the nodes linked to others: they meet in a cell and differ in at most max_bits bits.

    passes: functions that give the cells of the nodes, one pass's shuffles at a time. Cells whose nodes are all in one
    component after the passes before are left out, and a pass goes on from those components. Cells of over `tile` nodes
    are compared in chunks first, and in the end the nodes outside the largest component of such a cell with all others.
    """
    spark = prints.sparkSession
    sketch, sketch_bits = (F.col("node"), max_bits) if words == 1 else (F.col("node").bitwiseAND(F.lit(_LOW).cast("long")), SKETCH_BITS)
    linked, crowded = None, []

    def joined(new: DataFrame) -> DataFrame:
        edges = _stars(new)
        if linked is not None:
            edges = edges.unionByName(linked.where("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b")))
        return checkpointed(components(edges))

    for rows in passes:
        cells = prints.mapInPandas(rows, "cell long, node long")
        known = cells
        if linked is not None:
            labelled = prints.join(linked, "node", "left").withColumn("component", F.coalesce("component", "node"))
            known = labelled.mapInPandas(rows, "cell long, node long, component long")
        found = _compared(_tiles.once(known, "cell", "node", tile, sketch, sketch_bits), prints, words, max_bits)
        linked = joined(found.where("b is not null"))
        hot = found.where("b is null").select(F.col("a").alias("cell"))
        if not hot.isEmpty():
            hot, n = hot.distinct(), hot.count()
            crowded.append(cells.join(F.broadcast(hot) if n <= 100_000 else hot, "cell", "left_semi"))
        free_shuffles(spark)
    more = None
    for cells in crowded:
        new = _compared(_tiles.against_rest(cells, linked, ["cell"], "node", tile), prints, words, max_bits).where("b is not null")
        more = new if more is None else more.unionByName(new)
    return linked if more is None else joined(more)


def _stars(edges: DataFrame) -> DataFrame:
    """Edges with the same components: a node keeps the least of its links, on which its others hang instead.

    A node has no more links than it has cells, so what is gathered for one is small.
    """
    stars = edges.groupBy("a").agg(F.collect_set("b").alias("bs")).withColumn("m", F.array_min("bs"))
    others = F.transform(F.filter("bs", lambda b: b != F.col("m")), lambda b: F.struct(b.alias("a"), F.col("m").alias("b")))
    return stars.select(F.explode(F.concat(F.array(F.struct("a", F.col("m").alias("b"))), others)).alias("e")).select("e.*").distinct()


def near_duplicates(docs: DataFrame, k: int = 3, words: int = 1, max_bits: int = 3, tile: int = 1024, id_column: str = "doc_id", text_column: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, fp0, ..., component_id) for every row of docs; component_id is the smallest id reachable by links.

    With one word and max_bits <= 3 every link is found. With more words a pair whose words differ in at most
    max_bits bits in all is linked if it shares the anchor of some block; there are 64 * words // 31 blocks a round.
    """
    names = [f"fp{w}" for w in range(words)]
    prints = checkpointed(fingerprints(docs, k, words, id_column, text_column))
    distinct = prints.groupBy(*names).agg(F.min("doc_id").alias("first_id")).withColumn("node", _node(words))
    found = _links(distinct.select("node", *names), words, max_bits, tile, [_anchor_rows if words == 1 else _block_rows(words, rounds)])
    rooted = distinct.join(found, "node", "left").withColumn("root", F.coalesce("component", "node"))
    firsts = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    classes = rooted.select("root", *names).join(firsts, "root").select("component_id", *names)
    return prints.join(classes, names).select("doc_id", *names, "component_id")


def text_key(text: Column) -> Column:
    """64 bits of a text, never null; two of n texts share them by accident with probability n**2 / 2**65."""
    return F.xxhash64(text)


def _shingle_sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0)
            for block in text_blocks(batch, "text"):
                hashes, counts = shingle_xxh64(block, k)
                sets = [np.unique(own).tobytes() for own in np.split(hashes, np.cumsum(counts)[:-1])]
                yield pa.RecordBatch.from_arrays([keys.slice(block.first_row, block.rows), pa.array(sets, pa.binary())], names=["text_key", "shingles"])

    return run


def shared_counts(sets: list[np.ndarray], width: int = 4096) -> np.ndarray:
    """Sizes of the intersections of all pairs of sets, by products of incidence matrices of `width` values each."""
    n = len(sets)
    owner = np.repeat(np.arange(n), [len(x) for x in sets])
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    use = count[column] > 1
    owner, column = owner[use], (np.cumsum(count > 1) - 1)[column[use]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    out = np.zeros((n, n), dtype=np.int64)
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        a, b = np.searchsorted(column, [low, low + width])
        block = np.zeros((n, min(width, int(column[b - 1]) - low + 1)), dtype=np.float32)
        block[owner[a:b], column[a:b] - low] = 1
        out += (block @ block.T).astype(np.int64)
    return out


def _similar(similarity: float):
    keys = ["class", "__ti", "__tj"]
    least = Fraction(similarity).limit_denominator(10**6)

    def one(unit: pd.DataFrame) -> pd.DataFrame | None:
        sets = [np.frombuffer(x, dtype=np.uint64) for x in unit["shingles"]]
        sizes = np.array([len(x) for x in sets])
        shared = shared_counts(sets)
        root = _tiles.dense_components(shared * least.denominator >= (sizes[:, None] + sizes[None, :] - shared) * least.numerator)
        own = np.flatnonzero(root != np.arange(len(root)))
        node = unit["text_key"].to_numpy()
        return pd.DataFrame({"a": node[own], "b": node[root[own]]}) if len(own) else None

    return lambda frames: _tiles.run_units(frames, keys, one)


def similar_texts(docs: DataFrame, similarity: float = 0.8, k: int = 5, words: int = 12, max_bits: int = 150, tile: int = 1024, set_tile: int = 256, rounds: int = 16, rounds_a_pass: int = 8, text_column: str = "text") -> DataFrame:
    """(text_key, component) of every distinct text; texts are linked if their k-word shingle sets are that similar.

    Candidates are the classes of fingerprints that share an anchor and differ in at most max_bits of 64 * words bits and
    in at most SKETCH_BITS of 31 fixed ones;
    inside a class every pair of texts is compared by its shingle sets (two empty sets are equal), and only a Jaccard
    similarity of at least `similarity` links. So no link is false; a pair is missed only if it falls into two classes.
    A class of over set_tile texts is compared in chunks first, and then what is not in its largest component with all.
    The rounds of blocks are done in passes, one pass's shuffles at a time.
    """
    texts = docs.select(text_key(F.col(text_column)).alias("text_key"), F.col(text_column).alias("text"))
    names = [f"fp{w}" for w in range(words)]
    prints = fingerprints(texts, k, words, "text_key").withColumnRenamed("doc_id", "text_key").dropDuplicates(["text_key"])
    prints = checkpointed(prints.withColumn("node", _node(words)))
    distinct = checkpointed(prints.select("node", *names).distinct())
    # The first pass is one round alone: it joins most of what is alike, so that later passes leave out more cells.
    ends = [*range(1, min(2, rounds + 1)), *range(rounds_a_pass, rounds, rounds_a_pass), rounds]
    passes = [_block_rows(words, end, first) for first, end in zip([0, *ends], sorted(set(ends))) if end > first]
    found = _links(distinct, words, max_bits, tile, passes)
    classes = prints.select("text_key", "node").join(found, "node", "left")
    classes = checkpointed(classes.select("text_key", F.coalesce("component", "node").alias("class")))
    free_shuffles(docs.sparkSession)
    sizes = checkpointed(classes.groupBy("class").agg(F.count(F.lit(1)).alias("__n"), F.min("text_key").alias("__leader")).where("__n > 1"))
    # A text alone in its class needs no set.
    shared = classes.join(sizes, "class", "left_semi")
    sets = checkpointed(texts.join(shared, "text_key", "left_semi").select("text_key", "text").mapInArrow(_shingle_sets(k), "text_key long, shingles binary").dropDuplicates(["text_key"]))

    def compared(units: DataFrame) -> DataFrame:
        ordered = units.select("class", "text_key", "__ti", "__tj").join(sets, "text_key").repartition("class", "__ti", "__tj").sortWithinPartitions("class", "__ti", "__tj", "text_key")
        return checkpointed(ordered.mapInPandas(_similar(similarity), "a long, b long"))

    edges = compared(_tiles.chunked(classes, sizes, ["class"], "text_key", set_tile))
    crowded = classes.join(sizes.where(F.col("__n") > set_tile), "class", "left_semi")
    if not crowded.isEmpty():
        linked = checkpointed(components(edges))
        more = compared(_tiles.against_rest(crowded, linked, ["class"], "text_key", set_tile))
        edges = more.unionByName(linked.where("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b")))
        free_shuffles(docs.sparkSession)
    found = components(edges).withColumnRenamed("node", "text_key")
    return classes.join(found, "text_key", "left").select("text_key", F.coalesce("component", "text_key").alias("component"))


def one_of_each(docs: DataFrame, classes: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row of docs for each component of (text_key, component): the smallest id, null ids last, ties by row hash.

    Only keys are grouped; rows that are equal in everything are told by their count and thinned on their own.
    """
    keys = ["__id", "__text", "__row"]
    keyed = docs.select(whole_row(docs).alias("row"), F.col(id_column).alias("__id"), text_key(F.col(text_column)).alias("__text"), row_hash(docs).alias("__row"))
    rows = keyed.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).join(classes.withColumnRenamed("text_key", "__text"), "__text")
    firsts = rows.groupBy("component").agg(F.min(F.struct(F.col("__id").isNull().alias("__none"), *keys, "__n")).alias("f"))
    firsts = checkpointed(firsts.select(F.col("component").alias("__component"), *[F.col(f"f.{c}").alias(f"{c}_f") for c in (*keys, "__n")]))
    same = F.col("__id").eqNullSafe(F.col("__id_f")) & (F.col("__text") == F.col("__text_f")) & (F.col("__row") == F.col("__row_f"))
    alone = keyed.join(firsts.where("__n_f = 1"), same, "left_semi")
    several = keyed.join(firsts.where("__n_f > 1"), same).dropDuplicates(["__component"])
    return alone.select("row").unionByName(several.select("row")).select("row.*")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash classes of all documents at three bits over three-word shingles."""
    out = near_duplicates(read(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp0")), 16, "0").alias("fingerprint"), "component_id")


def queries() -> dict:
    return {"op9_simhash": op9_simhash}


def oracle_sql() -> dict[str, str]:
    return {}
