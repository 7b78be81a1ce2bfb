"""The prefix trie, spelling variants and decontamination against plain loops."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import decontamination, prefix_trie, spelling
from corpusloom.llm.stages import Stages

LOWER = {i: i + 32 for i in range(65, 91)}
TURNS = "conv_id long, turn long, role string, text string"


# -- prefix trie ------------------------------------------------------------------------------------------------------

def trie(rows):
    by = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            by[c].append((t is not None, t or 0, r or "", x or ""))
    own = {c: [(r, x) for _, _, r, x in sorted(v)] for c, v in by.items()}
    members, ends, kids = defaultdict(list), defaultdict(list), defaultdict(list)
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        seq = tuple(own.get(c - int(math.fmod(c, 5)), [])[:h]) + tuple(v[h:])
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
        ends[seq].append(c)
    for s in members:
        if s:
            kids[s[:-1]].append(s)
    leaves, saved = {}, {}
    for s in sorted(members, key=len, reverse=True):
        leaves[s] = sum(leaves[k] for k in kids[s]) or 1
        saved[s] = sum(saved[k] for k in kids[s]) + ((len(members[s]) - 1) * len(s[-1][1].encode()) if s else 0)
    digest = lambda ids: hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()
    return sorted((min(m), len(s), min(members[s[:-1]]) if s else -1, len(m), len(kids[s]), leaves[s], saved[s], digest(ends[s])) for s, m in members.items())


def found_trie(df):
    return sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in df.collect())


def test_trie_of_edge_cases(spark, monkeypatch):
    rows = [(i, t, "u", f"x{(i * 7 + t) % 3}") for i in range(60) for t in range(i % 7)]
    rows += [(100, t, "a", f"long{t // 2}") for t in range(70)] + [(101, t, "a", f"long{t // 2}") for t in range(65)]  # over several blocks, as below
    rows += [(100, None, None, None), (None, 1, "a", "b"), (103, 1, None, "ñ"), (103, 1, "", None), (103, 1, None, "ñ"), (-3, 0, "u", "x0"), (-1, 5, "u", "x1"), (104, 1, "u", "w " * 50_000)]
    monkeypatch.setattr(prefix_trie, "BLOCK", 16)
    d = spark.createDataFrame(rows, TURNS)
    assert found_trie(prefix_trie.prefix_trie(d, Stages(spark, "t"))) == trie(rows)
    # columns of the same names as inner ones, and other names for its own
    clash = d.select(F.col("conv_id").alias("k1"), F.col("turn").alias("d"), F.col("role").alias("r"), F.col("text").alias("bytes"), F.lit(1).alias("h"))
    assert found_trie(prefix_trie.prefix_trie(clash, Stages(spark, "t"), "k1", "d", "r", "bytes")) == trie(rows)


def test_trie_of_nothing(spark):
    none = spark.createDataFrame([], TURNS)
    assert prefix_trie.prefix_trie(none, Stages(spark, "t")).count() == 0


def test_trie_of_tables(spark, small):
    d = spark.read.parquet(f"{small}/conversations.parquet")
    rows = [tuple(r) for r in d.select("conv_id", "turn", "role", "text").collect()]
    assert found_trie(prefix_trie.prefix_trie(d, Stages(spark, "t"))) == trie(rows)


def test_ids_of_a_node_are_hashed_in_pieces(monkeypatch):
    monkeypatch.setattr(prefix_trie, "PIECE", 3)
    keys = [(1, 1)] * 8 + [(1, 2)] + [(3, 0)] * 4
    ids = [*range(8), 5, *range(7, 11)]
    batch = lambda lo, hi: pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys[lo:hi]], pa.int64()), pa.array([k[1] for k in keys[lo:hi]], pa.int64()), pa.array(ids[lo:hi], pa.int64())], ["k1", "k2", "conv_id"])
    got = {(r["k1"], r["k2"]): r["ends_sha256"] for b in prefix_trie._digests(prefix_trie._pieces(iter([batch(0, 5), batch(5, 5), batch(5, 13)]))) for r in b.to_pylist()}
    want = {k: hashlib.sha256(",".join(str(i) for i, o in zip(ids, keys, strict=True) if o == k).encode()).hexdigest() for k in set(keys)}
    assert got == want


# -- spelling variants ------------------------------------------------------------------------------------------------

def variants(docs, least=6, count=5, ratio=5):
    n = Counter()
    for i, text in docs:
        for w, k in Counter(re.findall("[a-zÀ-ÿ]+", (text or "").translate(LOWER))).items():
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 199 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            if len(w) >= least:
                n[w] += k
    n = {w: k for w, k in n.items() if k >= count}
    gaps, near = defaultdict(set), defaultdict(set)
    for w in n:
        for i in range(len(w)):
            gaps[w[:i] + "*" + w[i + 1 :]].add(w)
            if (x := w[:i] + w[i + 1 :]) in n:
                near[w].add(x)
                near[x].add(w)
    for g in gaps.values():
        for w in g:
            near[w] |= g - {w}

    def form(w):
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        return best if best and n[best] >= ratio * n[w] else None

    def root(w):
        while form(w):
            w = form(w)
        return w

    return sorted((w, form(w) or "", root(w), k, len(near[w]), n[form(w)] if form(w) else -1) for w, k in n.items())


def found_variants(df):
    return sorted((r.word, r.form or "", r.root, r.n, r.n_near, -1 if r.form_n is None else r.form_n) for r in df.collect())


def test_variants_of_edge_cases(spark, monkeypatch):
    monkeypatch.setattr(spelling, "_PIECE", 64)  # runs across pieces
    monkeypatch.setattr(spelling, "_CANDIDATES", 200)  # words across several pieces of their neighbourhood
    chain = "kitten " * 1000 + "kittens " * 150 + "mittens " * 25 + "mittenss " * 5
    docs = [(1, chain), (1, chain), (2, None), (3, ""), (None, "Ärzteñ ärzteñ ärzteñ " * 6), (4, "aaaaaa " * 30 + "aaaaaaa " * 5 + "aaaaaaab " * 6), (5, ("q" * 5000 + " ") * 5 + ("q" * 4999 + " ") * 30), (6, "ÿ÷×ÿÿÿ.ÿ÷×ÿÿÿ ÿ÷×ÿÿ " * 9), (7, "short w0rds o'nly"), (8, "ABCdef,abcdef;" * 7 + "abcdeg " * 7)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    assert found_variants(spelling.spelling_variants(d, Stages(spark, "t"))) == variants(docs)
    clash = d.select(F.col("doc_id").alias("n"), F.col("text").alias("word"), F.lit("x").alias("candidate"))
    assert found_variants(spelling.spelling_variants(clash, Stages(spark, "t"), "n", "word")) == variants(docs)
    assert spelling.spelling_variants(spark.createDataFrame([], "doc_id long, text string"), Stages(spark, "t")).count() == 0
    with pytest.raises(ValueError):
        spelling.spelling_variants(d, Stages(spark, "t"), ratio=1)


def test_variants_of_tables(spark, small):
    d = spark.read.parquet(f"{small}/documents.parquet")
    assert found_variants(spelling.spelling_variants(d, Stages(spark, "t"))) == variants([(r.doc_id, r.text) for r in d.collect()])


def test_neighbourhood_is_whole_and_distinct():
    class Everything:
        value = np.full(1 << 10, (1 << 64) - 1, np.uint64)

    for word in ("a", "ab", "aab", "abcabc", "bbbb"):
        batch = pa.RecordBatch.from_arrays([pa.array([word]), pa.array([7])], ["word", "n"])
        got = [r["candidate"] for b in spelling._neighbours(Everything, "abc")(iter([batch])) for r in b.to_pylist()]
        cuts = [(word[:i], word[i:]) for i in range(len(word) + 1)]
        want = {a + b[1:] for a, b in cuts if b} | {a + c + b[1:] for a, b in cuts if b for c in "abc"} | {a + c + b for a, b in cuts for c in "abc"}
        assert sorted(got) == sorted(want - {word})


# -- decontamination --------------------------------------------------------------------------------------------------

def leaks(docs, items, width=10):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    wins = defaultdict(set)
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - width + 1) if w else 0):
            wins[tuple(w[k : k + width])] |= {str(i)} if i is not None else set()
    out = []
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for n in {len(x) for x in wins}:
            for k in range(len(w) - n + 1):
                if (x := tuple(w[k : k + n])) in wins:
                    hit |= set(range(k, k + n))
                    found |= wins[x]
        out.append((i, len(w), len(hit), sorted(found), bool(hit)))
    return sorted(out, key=repr)


def found_leaks(df, id_col="doc_id"):
    rows = df.collect()
    assert all(r["n_items"] == len(r["items"]) for r in rows)
    return sorted(((r[id_col], r["n_words"], r["n_hit"], list(r["items"]), r["contaminated"]) for r in rows), key=repr)


DOCS = [(1, None), (2, ""), (3, "a b c d e f g h i j k l"), (3, "a b c d e f g h i j k l"), (4, "x the THE éa1 . the-the"), (5, "the " * 3000), (6, "q" * 3_000_000 + " the a b"), (None, "c d e f g h i j k l m"), (7, "p0 p1 p2 p3 p4 p5"), (8, "b c d e f g h i j k X b c d e f g h i j k l m"), (9, "... ,, --")]
ITEMS = [(1, "b c d e f g h i j k l m"), (2, "The"), (3, None), (4, ""), (5, "the the"), (6, "p1 p2 p3 p4 p5"), (6, "p0 p1 p2"), (7, "the"), (8, "the " * 20), (None, "éA1"), (9, "c d e f g h i j k l, m")]


def test_leaks_of_edge_cases(spark):
    d = spark.createDataFrame(DOCS, "doc_id long, text string")
    i = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert found_leaks(decontamination.decontaminate(d, i, Stages(spark, "t"))) == leaks(DOCS, ITEMS)
    clash = d.select(F.col("doc_id").alias("win"), F.col("text").alias("token"), F.lit(1).alias("pos"))
    assert found_leaks(decontamination.decontaminate(clash, i, Stages(spark, "t"), "win", "token", width=4), "win") == leaks(DOCS, ITEMS, 4)


def test_leaks_of_nothing(spark):
    d, i = spark.createDataFrame(DOCS, "doc_id long, text string"), spark.createDataFrame(ITEMS, "item_id long, text string")
    assert found_leaks(decontamination.decontaminate(d, i.limit(0), Stages(spark, "t"))) == leaks(DOCS, [])
    assert decontamination.decontaminate(d.limit(0), i, Stages(spark, "t")).count() == 0


def test_leaks_of_tables(spark, small):
    d, i = spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/benchmark.parquet")
    assert found_leaks(decontamination.decontaminate(d, i, Stages(spark, "t"))) == leaks([(r.doc_id, r.text) for r in d.collect()], [(r.item_id, r.text) for r in i.collect()])


def test_words_of_long_texts_in_pieces(monkeypatch):
    monkeypatch.setattr(decontamination, "SPAN", 16)
    texts = ["one two three four five six seven", "", "x" * 50, " ", "y" * 40 + " " + "z" * 3, "a b", "c"]
    for first, span, starts, ends, _, bounds in decontamination._groups(pa.array(texts)):
        raw = span.tobytes().decode()
        for k in range(len(bounds) - 1):
            assert [raw[a:b] for a, b in zip(starts[bounds[k] : bounds[k + 1]], ends[bounds[k] : bounds[k + 1]], strict=True)] == texts[first + k].split()
