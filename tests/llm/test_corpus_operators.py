"""Edge cases and brute-force twins of the corpus operators on small fixtures."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from panelloom.llm import chat, embedding, lines, mixing, packing, pii, quality, sharding, simhash, substring

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words string, size long"


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    say = lambda n: " ".join(rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa".split()) + str(rng.randrange(40)) for _ in range(n))
    shared = say(30)
    out = [None, "", " \n\t", "one", "one two", "été À b", "x " * 300, "a\nb\nc\nd\na\nb\nc\n"]
    out += [say(60) + "\n" + shared + "\n" + say(10) for _ in range(12)]
    out += [out[9], out[9], out[9] + " tail", "\n".join(say(3) for _ in range(5)), say(3000)]
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "en", None if i % 7 == 0 else f"s{i % 3}", None, "clash", 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).cache()


def test_substring_equals_brute_force(docs, texts):
    got = {r.doc_id: r for r in substring.remove_repeats(docs, kinds=2, rows=3, shard_words=500).collect()}
    seen = set()
    for i, t in enumerate(texts):
        words = WORDS.findall(t or "")
        gone = [False] * len(words)
        for j in range(len(words) - 19):
            key = tuple(words[j : j + 20])
            if key in seen:
                gone[j : j + 20] = [True] * 20
            seen.add(key)
        kept = " ".join(w for w, g in zip(words, gone) if not g)
        assert (got[i].n_words, got[i].n_removed, got[i].kept_sha256) == (len(words), sum(gone), hashlib.sha256(kept.encode()).hexdigest())


def test_substring_with_repeated_null_ids_and_common_windows(spark):
    rng = random.Random(8)
    say = lambda n: " ".join(f"{rng.choice('abcdefghij')}{rng.randrange(6)}" for _ in range(n))
    passages = [say(24), say(45), " ".join("ab" for _ in range(90))]
    rows = [(1, "a b c"), (2, "a b c d"), (2, "u v w x")]
    for i in range(160):
        rows.append((None if i % 11 == 0 else i // 2, " ".join([say(rng.randrange(30)), rng.choice(passages), say(rng.randrange(30)), rng.choice(passages), say(3)])))
    rows += [rows[20], rows[20], (None, rows[14][1]), (500, rows[14][1]), (501, None), (502, "")]
    order = sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0, zlib.crc32((r[1] or "").encode())))
    seen, expected = {}, {}
    for d, (i, t) in enumerate(order):
        words = WORDS.findall(t or "")
        gone = set()
        for j in range(len(words) - 19):
            if seen.setdefault(tuple(words[j : j + 20]), (d, j)) != (d, j):
                gone.update(range(j, j + 20))
        kept = " ".join(w for k, w in enumerate(words) if k not in gone)
        expected[i, t] = (i, len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    table = spark.createDataFrame([(*r, "clash", 7) for r in rows], "doc_id long, text string, spans string, doc int")
    for kinds, salted in ((512, 4096), (3, 5)):
        got = [tuple(r) for r in substring.remove_repeats(table, kinds=kinds, rows=salted, shard_words=700).collect()]
        assert sorted(got, key=str) == sorted((expected[r] for r in rows), key=str)


def test_matching_statistics_equal_brute_force():
    import numpy as np

    rng = np.random.default_rng(4)
    held = [rng.integers(0, 5, size=n).astype(np.uint32) for n in (40, 7, 33, 1, 60)]
    asked = [rng.integers(0, 6, size=n).astype(np.uint32) for n in (30, 1, 50)] + [held[2][3:29]]
    joined = [tuple(p.tolist()) for p in held]
    index = substring.FMIndex(held, 6)
    matched, place = index.matching_statistics(asked)
    at = 0
    for piece in (tuple(p.tolist()) for p in asked):
        for i in range(len(piece)):
            longest = max(n for n in range(len(piece) - i + 1) if n == 0 or any(piece[i : i + n] == h[j : j + n] for h in joined for j in range(len(h))))
            assert min(matched[at], 6) == min(longest, 6)
            if longest >= 6:
                first = min(int(s) + j for s, h in zip(index.starts, joined) for j in range(len(h) - 5) if h[j : j + 6] == piece[i : i + 6])
                assert place[at] == first
            at += 1


def test_simhash_equals_brute_force(docs, texts):
    import xxhash

    def word(t):
        t = re.sub("[A-Z]", lambda m: m.group().lower(), t or "")
        w = WORDS.findall(t)
        shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
        hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        return sum((2 * sum(h >> b & 1 for h in hashes) > len(hashes)) << b for b in range(64)) if hashes else 0

    prints = [word(t) for t in texts]
    root = list(range(len(prints)))
    for _ in prints:
        for a in range(len(prints)):
            for b in range(len(prints)):
                if (prints[a] ^ prints[b]).bit_count() <= 3:
                    root[a] = root[b] = min(root[a], root[b])
    for r in simhash.near_duplicates(docs, tile=2).collect():
        assert (r.fp0 % 2**64, r.component_id) == (prints[r.doc_id], root[r.doc_id])


def test_simhash_of_many_words_links_similar_texts_only(spark):
    rng = random.Random(11)
    rows, of = [], {}
    for group in range(40):
        words = [f"w{rng.randrange(10**6)}" for _ in range(300)]
        for copy in range(3):
            own = list(words)
            for place in range(37, 300, 75 if copy else 10**6):
                own[place] = f"new{rng.randrange(10**6)}"
            of[len(rows)] = 3 * group
            rows.append((len(rows), " ".join(own)))
    rows += [(1000, None), (1001, ""), (1002, None), (1003, "one"), (1004, "One")]
    of |= {1000: 1000, 1001: 1000, 1002: 1000, 1003: 1003, 1004: 1003}
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k=5, words=12, max_bits=122, tile=2).collect()
    assert {r.doc_id: r.component_id for r in got} == of


def test_cells_with_the_same_rows_are_kept_once(spark):
    from panelloom.llm import _tiles

    rows = spark.createDataFrame([(c, n) for c in range(5) for n in (1, 3, 5)] + [(7, 1), (7, 3), (8, 1), (8, 2), (9, 1)], "cell long, node long")
    got = [(r.cell, r.node) for r in _tiles.once(rows, "cell", "node", 10, F.col("node") % 2, 0).collect()]
    assert sorted(got) == [(0, 1), (0, 3), (0, 5), (7, 1), (7, 3)]


def test_crowded_groups_lose_no_link(spark):
    """Classes of several components in chunks of 4: the same components as without chunks."""
    rng = random.Random(21)
    rows, of = [], {}
    for base in range(4):
        words = [f"b{base}w{i}" for i in range(100)]
        for copy in range(9):
            own = list(words)
            for place in rng.sample(range(100), 3 if copy else 0):
                own[place] = f"n{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(own)))
    table = spark.createDataFrame(rows, "doc_id long, text string")
    groups = []
    for tile, set_tile in ((1024, 256), (3, 4)):
        got = simhash.similar_texts(table, max_bits=400, tile=tile, set_tile=set_tile, rounds=8)
        keyed = table.select("doc_id", simhash.text_key(F.col("text")).alias("text_key"))
        found = {}
        for r in keyed.join(got, "text_key").collect():
            found.setdefault(r.component, set()).add(r.doc_id)
        groups.append(sorted(map(sorted, found.values())))
    assert groups[0] == groups[1] and len(groups[0]) > 3


def test_spanning_edges_keep_components():
    import numpy as np

    from panelloom.llm import _tiles

    a, b = _tiles.spanning_edges(np.array([9, 7, 5, 2, 30, 9]), np.array([7, 5, 2, 9, 40, 9]))
    assert sorted(zip(a.tolist(), b.tolist())) == [(5, 2), (7, 2), (9, 2), (40, 30)]
    chain = np.arange(1000)
    a, b = _tiles.spanning_edges(chain[:-1], chain[1:])
    assert (a == chain[1:]).all() and (b == 0).all()


def test_lines_remove_later_windows(spark):
    rows = spark.createDataFrame([(1, "a\nb\nc\nd"), (2, "x\na\n\nb\nc\ny"), (3, None), (4, ""), (5, "a\nb\nc")], "doc_id long, text string")
    got = {r.doc_id: (r.n_removed, r.text) for r in lines.remove_repeated_lines(rows).collect()}
    assert got == {1: (0, "a\nb\nc\nd"), 2: (3, "x\n\ny"), 3: (0, None), 4: (0, ""), 5: (3, "")}


def test_lines_of_repeated_and_null_ids(spark):
    rows = [(1, "a b c"), (2, "a b c d"), (2, "u v w x"), (None, "p q r"), (3, "o p q r"), (4, "p q r s"), (None, "y p q r"), (4, "p q r s")]
    rows = [(i, t.replace(" ", "\n")) for i, t in rows]
    table = spark.createDataFrame([(*r, "clash", 1, 2) for r in rows], "doc_id long, text string, lines string, gone int, first int")
    expected = {(1, 0, "a b c"), (2, 3, "d"), (2, 0, "u v w x"), (None, 3, ""), (3, 0, "o p q r"), (4, 3, "s"), (None, 3, "y")}
    for hot in (1000, 1):
        lines.HOT = hot
        got = lines.remove_repeated_lines(table, carry=["lines", "gone", "first"]).collect()
        assert {(r.doc_id, r.n_removed, (r.text or "").replace("\n", " ")) for r in got} == expected and len(got) == 8
        assert all((r.row.lines, r.row.gone, r.row.first) == ("clash", 1, 2) for r in got)
    lines.HOT = 1000


def test_lines_equal_brute_force(spark):
    rng = random.Random(12)
    rows = [(i, "\n".join(rng.choice(["a", "b", "c", "", "d e", " ", "f"]) for _ in range(rng.randrange(1, 14)))) for i in range(60)]
    rows += [(100, "\n".join(rng.choice("abcdefgh") for _ in range(5000))), (101, None), (102, "")]
    seen, expected = set(), {}
    for i, t in rows:
        every = t.split("\n") if t is not None else []
        worded = [k for k, line in enumerate(every) if WORDS.search(line)]
        gone = set()
        for j in range(len(worded) - 2):
            key = tuple(every[k] for k in worded[j : j + 3])
            if key in seen:
                gone.update(worded[j : j + 3])
            seen.add(key)
        expected[i] = (len(every), len(gone), None if t is None else "\n".join(line for k, line in enumerate(every) if k not in gone))
    got = lines.remove_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_lines, r.n_removed, r.text) for r in got} == expected


def test_quality_without_labels_and_with_clashing_columns(spark, docs, texts):
    assert quality.train(docs, spark.createDataFrame([], "doc_id long, quality int")) is None
    got = {r.row.doc_id: r for r in quality.judge(docs, None).collect()}
    for i, t in enumerate(texts):
        assert got[i].n_words == len(WORDS.findall(t or ""))
        assert got[i].kept == (not got[i].base_failed)
    assert got[6].base_failed and not got[8].base_failed


def test_quality_separates_held_out_kinds(spark):
    rng = random.Random(1)
    good, bad = "the river runs past old mills and slow fields".split(), "CLICK!! $$$ buy>> now|| free### win%%% cash".split()
    rows = [(i, " ".join(rng.choice(good if i % 2 else bad) + rng.choice("abcdefgh") for _ in range(40)), i % 2) for i in range(200)]
    table = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    model = quality.train(table.where("doc_id < 120"), table.where("doc_id < 120").select("doc_id", "quality"))
    held = quality.judge(table.where("doc_id >= 120"), model).select("row.quality", (F.col("quality_probability") >= 0.5).alias("p")).collect()
    assert sum(r.p == bool(r.quality) for r in held) / len(held) >= 0.95


def test_chat_reads_back_what_it_wrote(spark):
    said = ["\\### Assistant: </turn> ok", "", None, "###</turn>\\", "line\nline \\\\", "</tur</turn>n>"]
    rows = [(c, t, r, s) for c in range(3) for t, (r, s) in enumerate(zip(["user", "assistant", "we:ird", None, "assistant", "user"], said))]
    out = chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert len(out) == 3
    for r in out:
        assert chat.read_turns(r.formatted) == [(role or "", text or "") for _, _, role, text in rows[:6]]
        loss = [chat.unescape(r.formatted[g.start : g.end]) for g in r.generated]
        assert loss == ["", "line\nline \\\\"]


def test_templates_fold_constants_and_stay_sandboxed():
    assert chat.parse("a{{ 'b' + 'c' | upper }}{% if 1 == 1 %}d{% else %}e{% endif %}") == [("text", "abCd")]
    for bad in ("{{ x.__class__ }}", "{{ open('f') }}", "{% import os %}", "{% for a in b %}", "{{ a[0] }}"):
        with pytest.raises(chat.TemplateError):
            chat.parse(bad)


def test_mixing_meets_targets(docs, texts):
    rows = mixing.mix_sources(docs).collect()
    assert len(rows) == len(texts)
    total = sum(r.size for r in rows)
    assert abs(sum({r.source: r.target for r in rows}.values()) - total) < 1e-3
    assert all(r.taken <= 3 * r.size and r.target <= 3 * r.source_size + 1e-6 for r in rows)
    assert mixing.water_fill([10, 10, 10], [1, 2, 3], 3) == [5, 10, 15]


def test_shards_are_minimax(spark, docs, texts):
    rows = sharding.shard(docs, shards=4).collect()
    of_text, load = {}, {}
    for r in rows:
        t = texts[r.doc_id] or ""
        assert of_text.setdefault(t, r.shard) == r.shard and r.text_crc32 == zlib.crc32(t.encode()) and r.size == len(t.encode()) + 1
        load[r.shard] = load.get(r.shard, 0) + r.size
    groups = docs.groupBy(F.shiftrightunsigned(F.xxhash64(F.coalesce("text", F.lit(""))), 4).alias("h")).agg(F.sum(F.octet_length(F.coalesce("text", F.lit(""))) + 1).alias("n")).orderBy("h").collect()
    assert max(load.values()) == sharding.smallest_capacity([g.n for g in groups], 4)
    for s in load:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))


def test_packing_boundaries_are_optimal():
    import itertools

    import numpy as np

    rng = np.random.default_rng(6)
    for m, buckets in ((1, 3), (2, 2), (6, 3), (9, 4), (9, 1), (9, 12)):
        lengths = np.sort(rng.choice(2000, size=m, replace=False)).astype(np.int64)
        counts = rng.integers(1, 9, size=m)
        waste = lambda ends: sum(c * (min(e for e in ends if e >= n) - n) for n, c in zip(lengths, counts))  # noqa: E731, B023
        best = min(waste([*ends, lengths[-1]]) for k in range(buckets) for ends in itertools.combinations(lengths[:-1], k))
        found = packing.bucket_boundaries(lengths, counts, buckets)
        assert len(found) <= buckets and waste(found) == best
    assert packing.bucket_boundaries(np.array([1000, 1001]), np.array([5, 5]), 8) == [1000, 1001]


def test_packing_takes_the_exact_histogram(spark):
    table = spark.createDataFrame([(i, "w " * n) for i, n in enumerate([1000] * 3 + [1001] * 2 + [0])] + [(None, None), (2, "w"), (2, "w w"), (2, "w w")], "doc_id long, text string")
    rows = packing.pack(table, buckets=8, token_budget=3000).collect()
    assert len(rows) == 10 and all(r.padding == 0 for r in rows)


def test_packing_fills_batches(docs, texts):
    rows = packing.pack(docs, buckets=3, token_budget=200).collect()
    assert len(rows) == len(texts)
    batches = {}
    for r in rows:
        assert r.n_tokens <= r.bucket_length
        batches.setdefault((r.bucket, r.batch), []).append(r)
    for own in batches.values():
        assert len(own) == 1 or len(own) * own[0].bucket_length <= 200
        assert sorted(r.place for r in own) == list(range(len(own)))


def test_embedding_equals_brute_force(spark):
    import numpy as np

    rng = np.random.default_rng(5)
    base = rng.normal(size=(20, 8))
    rows = [(i, [float(x) for x in base[i % 20] + rng.normal(size=8) * 0.05 * (i % 3)], i % 2) for i in range(120)]
    rows += [(500, rows[0][1], 0), (501, None, 0), (502, [0.0] * 8, 0), (503, [float("nan")] * 8, 0), (504, rows[0][1], None)]
    got = {r.vec_id: r for r in embedding.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), cell_rows=10, tile=8).collect()}
    unit = {i: np.float32(v).astype(float) for i, v, label in rows if v and label is not None and np.isfinite(v).all() and np.any(v)}
    label = {i: x for i, _, x in rows}
    link = lambda a, b: a != b and a in unit and b in unit and label[a] == label[b] and unit[a] @ unit[b] / np.linalg.norm(unit[a]) / np.linalg.norm(unit[b]) >= 0.98
    for i, _, _ in rows:
        seen, todo = {i}, [i]
        while todo:
            a = todo.pop()
            new = [b for b in unit if b not in seen and link(a, b)]
            seen.update(new)
            todo += new
        assert (got[i].n_links, got[i].component_id) == (sum(link(i, b) for b in unit), min(seen))


def test_pii_surrogates_keep_format_and_coreference(spark):
    rows = [(1, "Mail ann.lee7@corp.example.com or +1 (389) 555-5010."), (2, "389-555-5010? no: +13895555010, Mr. John Smith, 42.144.35.254"), (3, "ANN.LEE7@CORP.EXAMPLE.COM 4111111111111111 token = \"1beb58b8af68854f\""), (4, None), (5, ""), (6, "clean text, version 2.0 of 3 parts")]
    got = {r.doc_id: r for r in pii.replace_entities(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[4].text is None and got[5].text == "" and got[6].text == rows[5][1]
    for secret in ("ann.lee7", "555-5010", "5555010", "John", "Smith", "42.144.35.254", "4111111111111111", "1beb58b8af68854f", "ANN.LEE7"):
        assert all(secret not in (r.text or "") for r in got.values())
    mail = re.search(r"\S+@\S+\.com", got[1].text).group()
    assert mail.upper() in got[3].text
    phone = re.search(r"\+1 \(\d{3}\) \d{3}-\d{4}", got[1].text).group()
    assert re.sub(r"[^0-9+]", "", phone) in got[2].text
    assert re.search(r"Mr\. [A-Z][a-z]+ [A-Z][a-z]+", got[2].text)


def test_empty_tables(spark, docs):
    none = docs.where("false")
    assert substring.remove_repeats(none).count() == 0
    assert simhash.near_duplicates(none).count() == 0
    assert lines.remove_repeated_lines(none).count() == 0
    assert mixing.mix_sources(none).count() == 0
    assert sharding.shard(none).count() == 0
    assert packing.pack(none).count() == 0
    assert pii.replace_entities(none).count() == 0
    assert quality.judge(none, None).count() == 0
    assert embedding.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0
    assert chat.format_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_similar_texts_are_linked_by_exact_similarity(spark):
    rng = random.Random(5)
    sets, rows = [], []
    for _ in range(60):
        base = [f"w{rng.randrange(10**6)}" for _ in range(200)]
        for changes in (0, 3, 5, 7, 9):
            own = list(base)
            for place in rng.sample(range(200), changes):
                own[place] = f"n{rng.randrange(10**6)}"
            sets.append({tuple(own[i : i + 5]) for i in range(196)})
            rows.append((len(rows), " ".join(own)))
    root = list(range(len(rows)))
    for g in range(0, len(rows), 5):
        for _ in range(5):
            for a in range(g, g + 5):
                for b in range(g, g + 5):
                    if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                        root[a] = root[b] = min(root[a], root[b])
    table = spark.createDataFrame(rows, "doc_id long, text string")
    keys = {r.k: r.doc_id for r in table.select("doc_id", simhash.text_key(F.col("text")).alias("k")).collect()}
    groups = {}
    for r in simhash.similar_texts(table).collect():
        groups.setdefault(r.component, set()).add(keys[r.text_key])
    assert len(set(root)) < 300 and max(root) > 0
    assert sorted(map(sorted, groups.values())) == sorted([i for i in range(300) if root[i] == x] for x in set(root))


def test_pipeline_stages_keep_rows_without_an_own_id(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(9)
    say = lambda: " ".join(f"w{rng.randrange(10**6)}" for _ in range(60))
    copied, near, other, lone, twin = say(), say(), say(), say(), say()
    rows = [(1, copied, "a"), (1, copied, "a"), (1, copied, "b"), (None, copied, "a"), (2, near, "a"), (1, near + " more", "a"), (2, other, "a"), (None, lone, "a"), (None, twin, "b"), (None, twin, "b")]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = [(r.doc_id, r.text) for r in corpus_pipeline.near_dedup(spark, table, "").collect()]
    assert sorted(got, key=str) == sorted([(1, copied), (1, near + " more"), (2, other), (None, lone), (None, twin)], key=str)
    spark.createDataFrame([(2, 1)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    even = spark.createDataFrame([(None, "x y", "a"), (None, "z w", "a"), (3, "u v", "a"), (3, "s t", "a"), (3, "s t", "a")], "doc_id long, text string, source string")
    mixed = corpus_pipeline.source_mixing(spark, even, str(tmp_path)).collect()
    assert sorted((r.doc_id or 0, r.text) for r in mixed) == [(0, "x y"), (0, "z w"), (3, "s t"), (3, "s t"), (3, "u v")]


def test_pii_spellings_names_and_repeated_ids(spark):
    rows = [(1, "call 389-555-5010 or +1 (389) 555-5010 or 1 389-555-5010"), (1, "Dear Priya Raman, my name is Wei Zhang. Kind Words Here stay."), (None, "mail a.b@c.example, 0044 20-794-6095 and +44 20-794-6095"), (None, "none"), (1, "none"), (2, "Sun " * 20000 + "389-555-5010"), (2, "Sun " * 20000 + "389-555-5010")]
    table = spark.createDataFrame([(i, t, "clash", 1, ["x"]) for i, t in rows], "doc_id long, text string, kind string, place int, found array<string>")
    got = sorted((r for r in pii.replace_entities(table).collect()), key=lambda r: (str(r.doc_id), len(r.text), r.text))
    assert len(got) == len(rows) and sorted(r.n_entities for r in got) == [0, 0, 1, 1, 2, 3, 3]
    by = {(r.doc_id, r.n_entities): r.text for r in got}
    numbers = re.findall(r"\d{3}\W+\d{3}-\d{4}", by[1, 3])
    assert len({re.sub(r"\D", "", n) for n in numbers}) == 1 and "+1 (" in by[1, 3] and " 1 " in by[1, 3] and "555-5010" not in by[1, 3]
    assert by[2, 1].endswith(re.search(r"call (\S+)", by[1, 3])[1]) and by[2, 1].startswith("Sun Sun ")
    assert "Priya" not in by[1, 2] and "Wei" not in by[1, 2] and by[1, 2].endswith("Kind Words Here stay.")
    abroad = re.search(r"(00\d\d \S+) and \+(\S+ \S+)", by[None, 3])
    assert abroad[1] == "00" + abroad[2] and "20-794-6095" not in by[None, 3]


def test_pii_equals_a_plain_python_version(spark):
    """Every entity found by the pattern is replaced, equal ones equally, distinct ones distinctly, the rest is kept."""
    import regex

    rng = random.Random(17)
    some = lambda: rng.choice([f"u{rng.randrange(40)}@mail.example.org", f"10.0.{rng.randrange(9)}.{rng.randrange(200)}", f"555-{rng.randrange(100, 130)}-{rng.randrange(1000, 1010)}", f"Mr. John {rng.choice(['Smith', 'Jones', 'Brown'])}", f"{rng.randrange(100, 120)}-45-6789", f"token={rng.randrange(10**8, 10**8 + 20)}"])
    rows = [(i, " and ".join(rng.choice(["plain words", some(), "v2.0 of 3"]) for _ in range(6))) for i in range(150)]
    got = {r.doc_id: r for r in pii.replace_entities(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    of, back = {}, {}
    for i, t in rows:
        parts, at = regex.split(pii.PATTERN, t), 0
        entities = [m.group() for m in regex.finditer(pii.PATTERN, t)]
        assert got[i].n_entities == len(entities)
        shape = "(.+?)".join(re.escape(p) for p in parts)
        new = re.fullmatch(shape, got[i].text).groups() if entities else ()
        for old, put in zip(entities, new):
            assert old != put and of.setdefault(old, put) == put and back.setdefault(put, old) == old


def test_pii_parts_of_names_are_entities(spark):
    rows = [(1, "Mr. John Smith met Mrs. Smith. Mr. Smith left, said Dr. Smith"), (2, "Priya Raman wrote to Wei Zhang. Ms. Priya Raman and Mr. Zhang agreed"), (3, "Ship From: New York to: Los Angeles. Dear Customer Service, Supreme Court said no"), (4, "Г-жа Анна Иванова; Mrs. John"), (5, None)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_entities, r.text) for r in pii.replace_entities(table, "k").collect()}
    name = re.fullmatch(r"Mr\. (\w+) (\w+) met Mrs\. (\w+)\. Mr\. (\w+) left, said Dr\. (\w+)", got[1][1]).groups()
    assert got[1][0] == 4 and len(set(name[1:])) == 1 and name[0] != "John" and name[1] != "Smith" and not name[0].endswith("a")
    both = re.fullmatch(r"(\w+) (\w+) wrote to (\w+) (\w+)\. Ms\. (\w+) (\w+) and Mr\. (\w+) agreed", got[2][1]).groups()
    assert got[2][0] == 4 and both[:2] == both[4:6] and both[3] == both[6] and not {"Priya", "Raman", "Wei", "Zhang"} & set(both) and len(set(both)) == 4
    assert both[0] in pii.GIVEN["f", "latin"] or both[0].endswith("a")
    assert got[3] == (0, rows[2][1]) and got[5] == (0, None)
    anna = re.fullmatch(r"Г-жа ([А-я]+) ([А-я]+); Mrs\. (\w+)", got[4][1]).groups()
    assert anna[0] != "Анна" and anna[1] != "Иванова" and anna[0][-1] in "аья" and anna[2] == name[0]
    # The key decides: another one gives other surrogates, the same one the same.
    again, other = ({r.doc_id: r.text for r in pii.replace_entities(table, k).collect()} for k in ("k", "l"))
    assert again == {i: t for i, (_, t) in got.items()} and other[1] != again[1]


def test_pii_digest_is_an_hmac(spark):
    import hmac

    row = spark.createDataFrame([("ssn", "123456789", 3)], "kind string, canonical string, attempt int")
    for key in ("k", "long " * 40):
        got = row.select(pii._digest(key, F.col("kind"), F.col("canonical"), F.col("attempt"))).first()[0]
        assert got.lower() == hmac.new(key.encode(), b"ssn\x1f3\x1f123456789", "sha512").hexdigest()


def test_pii_more_given_names_than_the_list_stay_apart(spark):
    rows = [("given", f"f/latin/Name{chr(97 + i // 26)}{chr(97 + i % 26)}") for i in range(100)] + [("given", "m/latin/Nameaa"), ("surname", "n/latin/Nameaa")]
    got = pii.assign_surrogates(spark.createDataFrame(rows, "kind string, canonical string"), "s").collect()
    assert len(got) == 102 == len({r.surrogate.split("/")[2] for r in got})
    assert all(r.surrogate.split("/")[0] == r.canonical.split("/")[0] for r in got)


def test_pii_long_secrets_are_replaced_to_their_end(spark):
    token = "".join(random.Random(2).choice("abcdefXYZ019") for _ in range(500))
    got = pii.replace_entities(spark.createDataFrame([(1, f"token = {token} end")], "doc_id long, text string")).first()
    assert got.n_entities == 1 and got.text.startswith("token = ") and got.text.endswith(" end")
    assert token[200:] not in got.text and len(got.text) == len(f"token = {token} end")


def test_pii_surrogates_of_a_used_up_format_stay_apart(spark):
    rows = [("ssn", f"{i:02d}") for i in range(100)]
    got = pii.assign_surrogates(spark.createDataFrame(rows, "kind string, canonical string"), "s", max_attempts=2).collect()
    assert len(got) == len({r.surrogate for r in got}) == 100 and not {r.surrogate for r in got} & {c for _, c in rows}


def test_embedding_links_vectors_of_equal_length_only(spark):
    rows = [(i, [1.0, 0.01 * i, 0.5], 0) for i in range(4)] + [(9, [1.0, 0.0], 0), (10, [1.0, 0.0], 0), (11, None, 0)]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    assert got == {i: (3, 0, i == 0) for i in range(4)} | {9: (1, 9, True), 10: (1, 9, False), 11: (0, 11, True)}


def _spread_vectors(seed):
    """600 vectors without structure, 20 close copies and a dense group of 80; a brute-force table of links at 0.98."""
    import numpy as np

    rng = np.random.default_rng(seed)
    x = rng.normal(size=(600, 40))
    x = np.concatenate([x, x[:20] + rng.normal(size=(20, 40)) * 0.08, x[50] + rng.normal(size=(80, 40)) * 0.11]).astype(np.float32)
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    return x, (unit @ unit.T >= 0.98) & ~np.eye(len(x), dtype=bool)


def test_embedding_copies_only_vectors_that_may_have_neighbours(spark, monkeypatch):
    x, linked = _spread_vectors(11)
    shown = []
    tiled = embedding._tiles.tiled
    monkeypatch.setattr(embedding._tiles, "tiled", lambda *a: shown.append((a[0].count(), (out := tiled(*a)).count())) or out)
    rows = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: r.n_links for r in embedding.near_duplicates(rows, cell_rows=50, tile=50).collect()}
    assert got == {i: int(n) for i, n in enumerate(linked.sum(axis=1))} and max(got.values()) > 20
    # Before, each of the 700 was shown to several cells and tiles.
    ((in_cells, in_tiles),) = shown
    assert in_cells <= 2 * linked.any(axis=1).sum() < 260 and in_tiles <= 2 * in_cells


@pytest.mark.parametrize("part_rows", [1000, 60])
def test_embedding_sketches_miss_no_link(spark, part_rows):
    import numpy as np

    x, linked = _spread_vectors(12)
    table = [(i, v.tobytes(), f"0:{x.shape[1]}") for i, v in enumerate(x)]
    distinct = spark.createDataFrame(table, "node long, vector binary, label string")
    group = {r.node: r.component for r in embedding.near_groups(distinct, "<f4", 0.98, 300, part_rows).collect()}
    a, b = np.nonzero(linked)
    assert len(a) > 100 and all(group[i] == group[j] for i, j in zip(a.tolist(), b.tolist()))
    assert len(group) < 130


def test_embedding_sketch_pairs_equal_brute_force():
    import numpy as np

    rng = np.random.default_rng(3)
    centre = rng.integers(-120, 121, (30, 24))
    q = np.clip(centre[rng.integers(0, 30, 900)] + rng.integers(-12, 13, (900, 24)), -127, 127).astype(np.int8)
    apart = ((q[:, None, :].astype(int) - q[None, :, :]) ** 2).sum(axis=2)
    near = apart <= (embedding.REACH + 24**0.5) ** 2
    for within, left in ((True, 900), (False, 350)):
        sides = near if within else near & ((np.arange(900) < left)[:, None] != (np.arange(900) < left)[None, :])
        forest = embedding._Forest(900, hold=500)
        embedding.near_sketches(q, left, within, forest, leaf=40, first=8, wide=100)
        assert (forest.settle() == embedding._tiles.dense_components(sides)).all() and 1 < len(set(forest.root)) < 900


def test_embedding_rows_that_repeat_an_id(spark):
    rows = [(1, [1.0, 0.0], 0, "x"), (1, [0.0, 1.0], 0, "x"), (1, [0.0, 1.0], 0, "x"), (2, [2.0, 0.0], 0, "x"), (None, [1.0, 0.0], 0, "x"), (3, [1.0, None], 0, "x"), (4, [], 0, "x"), (5, [0.1, 1.0], 0, "x"), (6, [0.1, 1.0], 1, "x")]
    got = embedding.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, unit string"), tile=2).collect()
    assert sorted(map(tuple, got), key=str) == sorted([(1, 1, 1, True), (1, 2, 1, True), (1, 2, 1, True), (2, 1, 1, False), (None, 0, None, True), (3, 0, 3, True), (4, 0, 4, True), (5, 2, 1, False), (6, 0, 6, True)], key=str)


def test_base_counts_equal_brute_force(spark, texts):
    rng = random.Random(33)
    odd = ["a b c d e a b c d e", "# $ x|y <b>\n# $ x|y <b>\n\n \nz", "ааа бб\nааа бб\nвв", "w\u00a0v w", "\x1f one\x1f two", "é" * 5000, "\n\n\n", "a\r\na\r\nb"]
    odd += [" ".join(rng.choice("abc") for _ in range(rng.randrange(60))) + rng.choice(["", "\n", "\nx y\nx y"]) for _ in range(60)]
    every = [*texts, *odd]
    rows = [(i if i % 5 else None, t, i, "clash", 1) for i, t in enumerate(every)]
    table = spark.createDataFrame(rows, "doc_id long, text string, place int, row string, n_words int")
    for r in quality.judge(table, None).collect():
        t = every[r.row.place] or ""
        words = WORDS.findall(t)
        windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
        covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(5)} if len(windows) < 200 else {i + k for i, w in enumerate(windows) if w in twice(windows) for k in range(5)}
        seen, repeated = set(), 0
        for line in t.split("\n"):
            if WORDS.search(line):
                repeated += line in seen
                seen.add(line)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(words), sum(map(len, words)), sum(t.count(c) for c in "#*$%&|<>"), repeated, len(covered))
        assert r.base_failed == (len(words) < 10 or 100 * len(covered) > 20 * len(words)) and r.kept == (not r.base_failed) and r.row.row == "clash"


def twice(windows):
    counts = {}
    for w in windows:
        counts[w] = counts.get(w, 0) + 1
    return {w for w, n in counts.items() if n > 1}


def test_character_grams_are_of_code_points(spark):
    import numpy as np
    import pyarrow as pa

    from panelloom.llm._text import text_blocks

    said = ["абвгд", "abc", None, "ABCDe", "", "éééé", "абвг abcd"]
    (block,) = text_blocks(pa.record_batch([pa.array(said)], names=["text"]), "text")
    starts, ends, rows = block.words()
    *_, (feature, row) = quality._families(block, block.word_hashes(starts, ends), rows)
    grams = [(i, t[k : k + 4].lower()) for i, t in enumerate(said) if t for k in range(len(t) - 3)]
    assert row.tolist() == [i for i, _ in grams]
    of = {}
    for f, (_, gram) in zip(feature.tolist(), grams):
        assert of.setdefault(gram, f) == f
    assert len(set(of.values())) >= len(of) - 1 and np.all(feature >= 2 << quality.BITS)


def test_quality_training_rows_do_not_hang_on_their_order(spark):
    rng = random.Random(2)
    rows = [(i % 60, " ".join(rng.choice("alpha beta gamma delta".split() if i % 2 else "free win cash click".split()) for _ in range(20))) for i in range(180)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    models = [quality.train(spark.createDataFrame(r, "doc_id long, text string"), labels, max_labelled=40) for r in (rows, rows[::-1])]
    assert (models[0].weights == models[1].weights).all() and models[0].slope == models[1].slope


def test_shards_equal_a_plain_search(spark):
    """The largest shard is the least possible, by trying every capacity over the groups in order."""
    rng = random.Random(14)
    rows = [(i if i % 6 else None, "x" * rng.choice([0, 1, 5, 40, 300])) for i in range(80)] + [(7, "y" * 900), (7, "y" * 900), (8, None)]
    table = spark.createDataFrame([(*r, "clash", 3) for r in rows], "doc_id long, text string, h string, size int")
    groups = {}
    for i, t, h in table.select("doc_id", "text", F.shiftrightunsigned(F.xxhash64(F.coalesce("text", F.lit(""))), 4)).collect():
        groups[h] = groups.get(h, 0) + len(t or "") + 1
    sizes = [n for _, n in sorted(groups.items())]
    for shards in (1, 3, 16):
        def runs(capacity):
            used, load = 1, 0
            for n in sizes:
                if load + n > capacity:
                    used, load = used + 1, 0
                load += n
            return used

        best = next(c for c in range(max(sizes), sum(sizes) + 1) if runs(c) <= shards)
        got = sharding.shard(table, shards=shards).collect()
        load, slots = {}, {}
        for r in got:
            load[r.shard] = load.get(r.shard, 0) + r.size
            slots.setdefault(r.shard, []).append(r.slot)
        assert len(got) == len(rows) and max(load.values()) == best and all(0 <= s < shards for s in load)
        assert all(sorted(x) == list(range(len(x))) for x in slots.values())


def test_mixing_with_ties_repeated_rows_and_null_ids(spark):
    rows = [(1, "a b c", "x"), (1, "a b c", "x"), (None, "d e", "x"), (None, "d e", "x"), (2, None, "y"), (3, "", None), (4, "f " * 5000, "y"), (5, "f g", None)]
    table = spark.createDataFrame([(*r, "clash", 2) for r in rows], "doc_id long, text string, source string, key string, low int")
    one, two = (sorted(map(tuple, mixing.mix_sources(table).collect()), key=str) for _ in range(2))
    assert one == two and len(one) == len(rows)
    assert all(r[6] <= 3 * r[2] for r in one)


def clashing_words(count):
    """Pairs of words of which the repository's 64-bit word hashes share their upper 32 bits."""
    import numpy as np
    import pyarrow as pa

    from panelloom.llm._text import text_blocks

    seen, pairs = {}, []
    words = [f"v{i}" for i in range(500_000)]
    for block in text_blocks(pa.record_batch([pa.array([" ".join(words)])], names=["text"]), "text", 1 << 26):
        upper = (block.word_hashes(*block.words()[:2]) >> np.uint64(32)).tolist()
        for i, h in enumerate(upper):
            if h in seen and len(pairs) < count:
                pairs.append((words[seen[h]], words[i]))
            seen[h] = i
    assert len(pairs) == count
    return pairs


def test_substring_tells_words_apart_that_share_half_their_hash(spark):
    rows = []
    for k, (one, other) in enumerate(clashing_words(10)):
        opening = " ".join(f"w{k}x{i}" for i in range(19))
        rows += [(2 * k, f"{opening} {one}"), (2 * k + 1, f"{opening} {other}")]
    got = substring.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [r.n_removed for r in got] == [0] * 20


def texts_of_one_crc(make):
    seen = {}
    for i in range(10**6):
        text = make(i)
        key = zlib.crc32(text.encode())
        if key in seen:
            return make(seen[key]), text
        seen[key] = i
    raise AssertionError


def test_rows_without_id_whose_texts_share_a_crc_are_two_rows(spark):
    common = "\n".join(f"line {i} of what both hold" for i in range(3))
    one, other = texts_of_one_crc(lambda i: f"{common}\n" + "\n".join(f"own {i} {k}" for k in range(6)))
    rows = [(1, common), (None, one), (None, other), (2**63 - 1, one)]
    got = lines.remove_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    # The row with an id comes before the rows without, so of the equal texts the one without loses its lines.
    assert sorted((r.doc_id or 0, r.n_removed) for r in got) == [(0, 3), (0, 9), (1, 0), (2**63 - 1, 3)]
    words = " ".join(f"c{i}" for i in range(20))
    one, other = texts_of_one_crc(lambda i: f"{words} " + " ".join(f"own{i}n{k}" for k in range(25)))
    got = substring.remove_repeats(spark.createDataFrame([(1, words), (None, one), (None, other)], "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.n_words, r.n_removed) for r in got) == [(0, 45, 20), (0, 45, 20), (1, 20, 0)]


def test_similar_texts_are_found_at_the_threshold(spark):
    """Sixty pairs of a similarity from 0.80 to 0.85 over five-word shingles: nine in ten at least meet, nothing else does."""
    rng = random.Random(21)
    rows = []
    for pair in range(60):
        words = [f"w{rng.randrange(10**6)}" for _ in range(240)]
        other = list(words)
        for place in range(20, 20 + 40 * (4 + pair % 2), 40):
            other[place] = f"n{rng.randrange(10**6)}"
        sets = [{tuple(t[i : i + 5]) for i in range(236)} for t in (words, other)]
        assert 0.8 <= len(sets[0] & sets[1]) / len(sets[0] | sets[1]) <= 0.85
        rows += [(2 * pair, " ".join(words)), (2 * pair + 1, " ".join(other))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    classes = simhash.similar_texts(docs).join(docs.select("doc_id", simhash.text_key(F.col("text")).alias("text_key")), "text_key").collect()
    members = {}
    for r in classes:
        members.setdefault(r.component, []).append(r.doc_id)
    groups = [sorted(m) for m in members.values()]
    assert all(len(m) == 1 or (len(m) == 2 and m[0] // 2 == m[1] // 2) for m in groups)
    assert sum(len(m) == 2 for m in groups) >= 54
