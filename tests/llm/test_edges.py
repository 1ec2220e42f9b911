"""Edge cases of operators and pipeline stages: repeated rows, null ids, clashing columns, very long texts, empty tables."""

import hashlib
import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from panelloom.llm import chat, embedding, lines, packing, simhash

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
DOCUMENT = "doc_id long, text string, lang string, source string, n_chars long"


def test_chat_of_repeated_rows_null_ids_and_long_texts(spark):
    long_text = "x </turn> ### \\ " * 20_000
    rows = [(1, 0, "user", "hi", "c"), (1, 0, "user", "hi", "c"), (1, 1, "assistant", long_text, "c"), (None, 3, None, None, "c"), (None, None, "assistant", "first", "c")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    got = {r.conv_id: r for r in chat.format_conversations(table).collect()}
    assert set(got) == {1, None}
    assert chat.read_turns(got[1].formatted) == [("user", "hi"), ("user", "hi"), ("assistant", long_text)]
    assert chat.read_turns(got[None].formatted) == [("assistant", "first"), ("", "")]
    assert "".join(chat.unescape(got[1].formatted[g.start : g.end]) for g in got[1].generated) == long_text


def test_embeddings_with_clashing_columns(spark):
    rows = [(i, [1.0, float(i % 2)], i % 3, "c", -1, True) for i in range(12)] + [(20, [1.0, None], 0, "c", -1, True), (21, [], 0, "c", -1, True), (22, [1.0, 0.0], None, "c", -1, True)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, unit string, component_id int, kept boolean")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding.near_duplicates(table).collect()}
    for i in range(12):
        same = [j for j in range(12) if j % 6 == i % 6]
        assert got[i] == (len(same) - 1, min(same), i == min(same))
    assert all(got[i] == (0, i, True) for i in (20, 21, 22))


def test_simhash_of_repeated_rows_null_ids_and_long_texts(spark):
    words = " ".join(f"w{i % 977}" for i in range(60_000))
    rows = [(1, words, "c"), (2, words + " tail", "c"), (None, words, "c"), (None, words, "c"), (3, None, "c"), (3, "", "c"), (4, "short one", "c"), (4, "short one", "c")]
    table = spark.createDataFrame(rows, "doc_id long, text string, fp0 string")
    got = [(r.doc_id, r.component_id) for r in simhash.near_duplicates(table).collect()]
    assert sorted(got, key=str) == sorted([(1, 1), (2, 1), (None, 1), (None, 1), (3, 3), (3, 3), (4, 4), (4, 4)], key=str)


def test_lines_of_a_very_long_text(spark):
    body = [f"line number {i}" for i in range(30_000)]
    rows = [(1, "\n".join(body)), (2, "\n".join(["own", *body[:100], "own too"]))]
    got = {r.doc_id: r for r in lines.remove_repeated_lines(spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, n_lines int")).collect()}
    assert (got[1].n_removed, got[2].n_removed, got[2].text) == (0, 100, "own\nown too")


def test_packing_equals_a_plain_version(spark):
    """Boundaries by trying all of them, places by sorting each bucket by its draw."""
    rng = random.Random(4)
    sizes = [rng.choice([0, 1, 2, 3, 5, 8, 13, 40, 41]) for _ in range(70)] + [3000]
    rows = [(i if i % 9 else None, " ".join(["w"] * n) if n else None, "c", 1) for i, n in enumerate(sizes)]
    rows += [rows[5], rows[5]]
    table = spark.createDataFrame(rows, "doc_id long, text string, bucket string, batch int")
    text_key = {r.text: r.k for r in table.select("text", F.xxhash64("text").alias("k")).distinct().collect()}
    lengths = sorted({len(WORDS.findall(r[1] or "")) for r in rows})
    own = [len(WORDS.findall(r[1] or "")) for r in rows]
    cost = lambda ends: sum(min(e for e in ends if e >= n) - n for n in own)
    best = min((cost((*inner, lengths[-1])), (*inner, lengths[-1])) for inner in itertools.combinations(lengths[:-1], 2))
    budget = 100
    want = []
    for k, end in enumerate(best[1]):
        low = best[1][k - 1] if k else -1
        mine = []
        for (doc, text, *_), n in zip(rows, own):
            if low < n <= end:
                drawn = str(doc) if doc is not None else str(text_key[text])
                draw = int(hashlib.md5(f"pack:{drawn}".encode()).hexdigest()[:13], 16)
                mine.append((draw, doc is not None, doc or 0, n, doc))
        per = max(1, budget // max(end, 1))
        want += [(doc, n, k, end, rank // per, rank % per, end - n) for rank, (_, _, _, n, doc) in enumerate(sorted(mine))]
    got = [tuple(r) for r in packing.pack(table, buckets=3, token_budget=budget, rank_rows=8).collect()]
    assert sum(r[6] for r in got) == best[0]
    assert sorted(got, key=str) == sorted(want, key=str)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    out = tmp_path_factory.mktemp("tables")
    spark.createDataFrame([(i, i % 2, 0) for i in range(8)], "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    return str(out)


def pages(count):
    rng = random.Random(2)
    say = lambda n: " ".join(f"word{rng.randrange(500)}" for _ in range(n))
    good = [(i, "\n".join(say(9) for _ in range(5)), "en", f"s{i % 2}", None) for i in range(count)]
    return [*good, (100, None, "en", "s0", None), (101, "", "en", None, 0), (102, "too short", "en", "s1", 9), (None, "\n".join(say(9) for _ in range(5)), "en", "s0", None), good[3]]


def test_quality_stage_keeps_clean_rows_and_their_columns(spark, folder):
    docs = spark.createDataFrame(pages(8), DOCUMENT)
    kept = corpus_pipeline.quality_rules(spark, docs.withColumn("kept", F.lit("clash")), folder)
    assert kept.columns == [*docs.columns, "kept"]
    ids = sorted(r.doc_id for r in kept.where("doc_id is not null").collect())
    assert set(ids) <= set(range(8)) and kept.where("text is null or text = ''").count() == 0
    bare = corpus_pipeline.quality_rules(spark, docs.where("doc_id > 50"), folder)
    assert bare.collect() == []


def test_line_stage_keeps_every_row_and_counts_its_characters(spark, folder):
    docs = spark.createDataFrame(pages(8), DOCUMENT)
    out = corpus_pipeline.line_dedup(spark, docs, folder)
    assert out.columns == docs.columns and out.count() == docs.count()
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in out.collect())


def test_every_stage_takes_an_empty_table(spark, folder):
    docs = spark.createDataFrame([], DOCUMENT)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        assert out.collect() == [], name
        assert out.columns == docs.columns or name == "packing"


def test_stages_hand_any_column_through(spark, folder):
    """Names with dots and backticks, names of helper columns, and maps."""
    odd = {"a.b": F.lit("dot"), "t`k": F.lit(1), "__id": F.lit(2), "__key": F.lit(3), "__copy": F.lit("c"), "row": F.lit("r"), "component": F.lit(4), "m": F.create_map(F.lit("k"), F.lit(5))}
    docs = spark.createDataFrame(pages(8), DOCUMENT).withColumns(odd)
    names = [c for c in docs.columns if c not in ("doc_id", "text", "lang", "source", "n_chars")]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns, name
        rows = out.collect()
        assert rows and {tuple(str(r[c]) for c in names) for r in rows} == {("dot", "1", "2", "3", "c", "r", "4", "{'k': 5}")}, name


def test_the_last_stage_places_every_row(spark, folder):
    docs = spark.createDataFrame(pages(8), DOCUMENT)
    out = corpus_pipeline.length_packing(spark, docs, folder).collect()
    assert len(out) == 13 and all(r.padding >= 0 for r in out)
    assert len({(r.bucket, r.batch, r.place) for r in out}) == 13
