"""Brute-force twins and edge cases of the prefix trie, the fill-in-middle transformation and the positional index."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelloom.llm import decontamination, infill, trie

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
UNITS = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
PLAIN_WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
lowered = lambda t: re.sub("[A-Z]", lambda m: m.group().lower(), t or "")


# Prefix trie


def trie_by_brute_force(conversations):
    """Rows of the trie of {conv_id: [(role, text), ...]}, already rebuilt."""
    members = {}
    for c, turns in conversations.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    nodes = {p: (min(m), len(p)) for p, m in members.items()}
    children = {}
    for p in members:
        if p:
            children.setdefault(p[:-1], []).append(p)
    out = []
    for p, m in members.items():
        below = [q for q in members if q[: len(p)] == p]
        saved = sum((len(members[q]) - 1) * len(WORDS.findall(q[-1][1])) for q in below if q)
        ends = ",".join(str(c) for c in sorted(m) if len(conversations[c]) == len(p))
        out.append((*nodes[p], nodes[p[:-1]][0] if p else None, len(m), len(children.get(p, [])), sum(q not in children for q in below), saved, sha(ends)))
    return sorted(out, key=str)


def rebuilt(conversations):
    out = {}
    for c, turns in conversations.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = conversations.get(c - c % 20, [])[:h] + turns[h:]
    return out


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def trie_rows(table, **options):
    got = trie.prefix_trie(trie.share_openings(trie.conversation_paths(table)), **options)
    assert got.columns == COLUMNS
    return sorted((tuple(r) for r in got.collect()), key=str)


@pytest.fixture(scope="module")
def conversations():
    rng = random.Random(5)
    out, openings = {}, [[("user", f"open {i} word"), ("assistant", "well " * i)] for i in range(3)]
    for c in [*range(90), 140, 141, 159, 2**40, 2**40 + 1]:
        kind = rng.randrange(5)
        if kind == 0:
            turns = [("system", "the same"), ("user", "copied conversation"), ("assistant", "as ever")]
        else:
            turns = [*rng.choice(openings)[: rng.randrange(3)], *[(rng.choice(["user", "assistant"]), f"t{rng.randrange(4)} x y") for _ in range(rng.randrange(1, 6))]]
        out[c] = turns
    out[33] = [("user", "one")]
    out[7] = [("user", f"turn {i % 3}") for i in range(120)]
    out[8] = out[7][:100] + [("user", "other end")]
    return out


def as_table(spark, conversations):
    rows = [(c, t, role, text, "clash", 3) for c, turns in conversations.items() for t, (role, text) in enumerate(turns)]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, path string, depth int")


@pytest.mark.parametrize("capacity", [1 << 18, 40, 8])
def test_trie_equals_brute_force(spark, conversations, capacity):
    """Small capacities make many shards and levels, so spines run through several merges."""
    assert trie_rows(as_table(spark, conversations), capacity=capacity) == trie_by_brute_force(rebuilt(conversations))


def test_trie_of_nulls_ties_and_repeats(spark):
    rows = [(1, None, None, None), (1, 0, "user", "a b"), (1, 0, "user", "a b"), (1, 1, "", "c"), (2, 0, "ab", "c"), (3, 0, "a", "bc"), (None, 0, "user", "lost"), (4, 5, "user", None), (4, 5, "user", "")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    order = lambda turns: [("", "")] * 1 + turns
    said = {1: order([("user", "a b"), ("user", "a b"), ("", "c")]), 2: [("ab", "c")], 3: [("a", "bc")], 4: [("user", ""), ("user", "")]}
    assert trie_rows(table) == trie_by_brute_force(rebuilt(said))


def test_turns_of_equal_number_follow_their_digests(spark):
    rows = [(1, 0, "user", t) for t in ("x", "y", "z")]
    digest = lambda t: hashlib.md5(f"4:user{t}".encode()).hexdigest()
    said = {1: [("user", t) for t in sorted("xyz", key=digest)]}
    assert trie_rows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")) == trie_by_brute_force(rebuilt(said))


def test_trie_of_an_empty_table(spark):
    assert trie_rows(spark.createDataFrame([], "conv_id long, turn long, role string, text string")) == []


def test_a_very_common_conversation_is_one_path_of_many_runs(spark, monkeypatch):
    monkeypatch.setattr(trie, "RUN", 7)
    said = {c: [("user", "hello there"), ("assistant", "x " * 2000)] for c in range(300)} | {1000: [("user", "hello there")]}
    assert trie_rows(as_table(spark, said)) == trie_by_brute_force(rebuilt(said))


def test_parentheses_close_as_a_stack_says():
    rng = np.random.default_rng(2)
    for n in (1, 3, 40, 5000):
        depth, bits = 0, []
        for left in range(2 * n, 0, -1):
            up = depth < left and (depth == 0 or rng.random() < 0.5 + 0.3 * np.sin(left / 300))
            bits.append(up)
            depth += 1 if up else -1
        stack, close = [], {}
        for i, up in enumerate(bits):
            if up:
                stack.append(i)
            else:
                close[stack.pop()] = i
        opened = np.array(sorted(close))
        assert trie.Parentheses(np.array(bits)).find_close(opened).tolist() == [close[i] for i in opened.tolist()]


# Fill in the middle


def fim(doc, text):
    text = text or ""
    h = hashlib.sha256(f"42:{'' if doc is None else doc}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    units = UNITS.findall(text)
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    parts = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return (doc, n, "plain", None, None, text, text)
    if h4 % 100 < 80:
        form, out = "spm", f"<S>{parts[2]}<P>{parts[0]}<M>{parts[1]}"
    else:
        form, out = "psm", f"<P>{parts[0]}<S>{parts[2]}<M>{parts[1]}"
    return (doc, n, form, len(parts[0]), len(parts[1]), out, text)


def test_infill_equals_brute_force_and_turns_back(spark):
    rng = random.Random(9)
    texts = [None, "", " ", "\n\t ", "one", " lead", "tail \n", "<P> inside", "a<", "été  ça là 中文 ok", "x " * 100_000, "\x00 nul \x1f", "a<P", "<S >"]
    texts += ["".join(rng.choice(["ab", " ", "\n", "  ", "<", ">", "P>", "é", "\t"]) for _ in range(rng.randrange(60))) for _ in range(150)]
    rows = [(i, t, "clash", "x", 1) for i, t in enumerate(texts)] + [(None, "no id at all", "", "", 2), (None, "another one", "", "", 2), (3, "same id", "", "", 0), (3, "same id", "", "", 0)]
    table = spark.createDataFrame(rows, "doc_id long, text string, output string, form string, h1 int")
    for limit in (1 << 22, 50):
        got = [tuple(r) for r in infill.restore(infill.fill_in_middle(table, limit=limit), limit=limit).collect()]
        assert sorted(got, key=str) == sorted((fim(r[0], r[1]) for r in rows), key=str)


def test_infill_shares_and_empty_table(spark):
    table = spark.range(400).select(F.col("id").alias("doc_id"), F.lit("some words to cut here").alias("text"))
    assert {r.form for r in infill.fill_in_middle(table, fim_percent=0).collect()} == {"plain"}
    assert {r.form for r in infill.fill_in_middle(table, fim_percent=100, spm_percent=0).collect()} == {"psm"}
    got = infill.fill_in_middle(spark.createDataFrame([], "doc_id long, text string"))
    assert infill.restore(got).collect() == []


# Decontamination


def contamination(rows, items, length, slop):
    """Per document what exact and near windows say, by looking at every place of every window."""
    documents = [(d, PLAIN_WORDS.findall(lowered(t))) for d, t in rows]
    counts = {}
    for _, words in documents:
        for w in words:
            counts[w] = counts.get(w, 0) + 1
    windows = {}
    for item, t in items:
        words = PLAIN_WORDS.findall(lowered(t))
        k = min(length, len(words))
        for i in range(len(words) - k + 1) if k else []:
            windows.setdefault(tuple(words[i : i + k]), set()).add("" if item is None else str(item))
    out = []
    for doc, words in documents:
        hit, exact, near = set(), set(), set()
        for window, names in windows.items():
            if any(w not in counts for w in window):
                continue
            first = min((counts[w], i) for i, w in enumerate(window))[1]
            for p in (p for p, w in enumerate(words) if w == window[first]):
                start = p - first
                away = max(min((abs(q - start - i) for q, w in enumerate(words) if w == x), default=10**9) for i, x in enumerate(window))
                if away <= slop:
                    near |= names
                if away == 0:
                    exact |= names
                    hit |= set(range(start, start + len(window)))
        out.append((doc, len(words), len(hit), len(exact), sha(",".join(sorted(exact))), bool(hit), sorted(hit), sorted(near)))
    return out


@pytest.mark.parametrize(("slop", "limit", "ship"), [(0, 1 << 21, 1 << 17), (0, 300, 5), (2, 900, 7)])
def test_decontamination_equals_brute_force(spark, slop, limit, ship):
    rng = random.Random(12)
    say = lambda n: [rng.choice("the of and A b C dé zwölf x9 long-tail don't Q".split()) + (str(rng.randrange(9)) if rng.random() < 0.7 else "") for _ in range(n)]
    items = [(i, " ".join(say(rng.randrange(4, 14)))) for i in range(12)] + [(12, None), (13, "..."), (14, "The of"), (3, "b b b b b"), (None, "x9 x9 dé"), (15, "never seen anywhere"), (16, "The of")]
    rows = []
    for i in range(60):
        words = say(rng.randrange(50))
        for _ in range(rng.randrange(3)):
            planted = (rng.choice(items)[1] or "").split()
            if rng.random() < 0.5 and planted:
                planted.insert(rng.randrange(len(planted)), "odd")
            at = rng.randrange(len(words) + 1)
            words[at:at] = planted
        rows.append((i, rng.choice([" ", "\n", ", "]).join(words)))
    rows += [(70, None), (71, ""), (72, " ;; "), (None, rows[5][1]), (5, rows[5][1]), (5, "other text of one id The OF"), (73, "b " * 400)]
    docs = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, text string, block string, kind int")
    table = spark.createDataFrame([(*r, 7) for r in items], "item_id long, text string, w1 int")
    got = []
    for r in decontamination.decontaminate(docs, table, length=6, slop=slop, limit=limit, ship=ship).collect():
        spans = [k for s in r.spans or [] for k in range(s.a, s.b)]
        got.append((*r[:6], spans, list(r.near_items)))
    assert sorted(got, key=str) == sorted(contamination(rows, items, 6, slop), key=str)


def test_decontamination_of_empty_tables(spark):
    docs, items = "doc_id long, text string", "item_id long, text string"
    one = spark.createDataFrame([(1, "a b c")], docs)
    got = decontamination.decontaminate(one, spark.createDataFrame([], items)).collect()
    assert [(r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got] == [(1, 3, 0, 0, sha(""), False)]
    assert decontamination.decontaminate(spark.createDataFrame([], docs), spark.createDataFrame([(1, "a b")], items)).collect() == []


def test_slop_must_fit_between_documents(spark):
    with pytest.raises(ValueError):
        decontamination.search(spark.createDataFrame([], decontamination.INDEX), spark.createDataFrame([], decontamination.WINDOWS), slop=40)
