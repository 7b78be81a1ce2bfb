"""Byte-level text against unicodedata, and encodings against the libraries that own the vocabularies."""

import base64
import unicodedata

import pandas as pd
import pytest
from pyspark.sql import functions as F

from corpusloom.functions import bytelevel
from corpusloom.operators import bpe, tokens
from corpusloom.plans import catalogue

EVERYTHING = [chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000]
ODD = ["", " a", "a", "  a  b\n\n c\t", "don't DON'T we're 12 345", "éẋ̣ 각 Ω", " x　y z", "\x00\x1c\x85", "…—≠😀👩‍💻", "a" * 3000, "ab" * 2000, " " * 500]


def test_composition_of_all_of_unicode(spark):
    # a thousand characters to a text, apart; and each behind a letter and before marks
    texts = [" ".join(EVERYTHING[i : i + 500]) for i in range(0, len(EVERYTHING), 500)]
    texts += ["|".join(f"a{c}̣́{c}" for c in EVERYTHING[i : i + 500]) for i in range(0, len(EVERYTHING), 500)]
    d = spark.createDataFrame(pd.DataFrame({"t": texts})).repartition(4).select("t", bytelevel.nfc(F.col("t")).alias("c"))
    assert [r.t for r in d.collect() if r.c != unicodedata.normalize("NFC", r.t)] == []
    doubt = spark.createDataFrame(pd.DataFrame({"t": EVERYTHING})).filter(~F.regexp_like("t", F.lit(bytelevel.nfc_doubt()))).select("t").toPandas()
    sure = list(doubt["t"])
    assert len(sure) > 1_000_000 and not [c for c in sure if unicodedata.normalize("NFC", c) != c or unicodedata.combining(c)]
    # neighbours that are not in doubt never compose
    assert unicodedata.is_normalized("NFC", "".join(sure)) and unicodedata.is_normalized("NFC", "".join(sure[::-1]))
    assert spark.range(1).select(bytelevel.nfc(F.lit(None).cast("string")).alias("c")).first()["c"] is None


def test_bytes_as_characters(spark):
    texts = ["".join(EVERYTHING[i : i + 4000]) for i in range(0, len(EVERYTHING), 4000)]
    d = spark.createDataFrame(pd.DataFrame({"t": texts})).select("t", bytelevel.to_byte_characters(F.col("t")).alias("c"))
    hidden, shown = bytelevel.byte_table()
    table = str.maketrans(hidden, shown)
    for r in d.withColumn("back", bytelevel.to_bytes(F.col("c"))).collect():
        assert r.c == r.t.encode().decode("latin-1").translate(table) and bytes(r.back) == r.t.encode()
    assert shown[0] == "Ā" and dict(zip(hidden, shown))[" "] == "Ġ" and len(hidden) == 68


@pytest.fixture(scope="module")
def vocabulary():
    return pytest.importorskip("public_tokenizers")


def test_words_as_the_library_cuts_them(spark, vocabulary):
    tok = pytest.importorskip("tokenizers").Tokenizer.from_file(vocabulary.path("byte_bpe_50k.json"))
    d = spark.createDataFrame([(t,) for t in ODD], "t string").select("t", F.transform(bytelevel.words(F.col("t")), bytelevel.to_byte_characters).alias("w"))
    for r in d.collect():
        assert r.w == [w for w, _ in tok.pre_tokenizer.pre_tokenize_str(r.t)], r.t
    spaced = spark.createDataFrame([(t,) for t in ODD], "t string").select("t", bytelevel.with_prefix_space(F.col("t")).alias("s")).collect()
    assert all(r.s == (r.t if not r.t or r.t[0] == " " else " " + r.t) for r in spaced)


def test_counts_of_all_sizes_in_one_fold(spark, small, vocabulary):
    tiktoken = pytest.importorskip("tiktoken")
    ranks = bpe.ranks_of(bpe.read_vocabulary(spark, vocabulary.path("byte_bpe_multi_50k.tiktoken")))
    docs = spark.read.parquet(f"{small}/documents.parquet").select("text").union(spark.createDataFrame([(t,) for t in [*ODD, None]], "text string"))
    texts = [r.text or "" for r in docs.collect()]
    sizes = [256, 300, 8000, 24000, 48000, 60000]
    for nfc, space in ((False, False), (True, True)):
        got = {r["size"]: r.tokens for r in bpe.token_counts(bpe.word_counts(docs, nfc=nfc, prefix_space=space), ranks, sizes).collect()}
        seen = [unicodedata.normalize("NFC", t) if nfc else t for t in texts]
        seen = [f" {t}" if space and t and t[0] != " " else t for t in seen]
        for size in sizes:
            own = tiktoken.Encoding("own", pat_str=vocabulary.PATTERN, mergeable_ranks={t: r for t, r in ranks.items() if r < size}, special_tokens={})
            assert got[size] == sum(len(own.encode_ordinary(t)) for t in seen)


def test_ids_and_back(spark, vocabulary, tmp_path):
    tiktoken = pytest.importorskip("tiktoken")
    read = bpe.read_vocabulary(spark, vocabulary.path("byte_bpe_multi_50k.tiktoken"))
    bpe.write_vocabulary(read, str(tmp_path / "v"))
    ranks = bpe.ranks_of(bpe.read_vocabulary(spark, str(tmp_path / "v")))
    lines = b"".join(p.read_bytes() for p in (tmp_path / "v").glob("part-*")).split(b"\n")
    assert ranks == {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x)} and list(ranks.values()) == sorted(ranks.values())
    own = tiktoken.Encoding("own", pat_str=vocabulary.PATTERN, mergeable_ranks=ranks, special_tokens={})
    d = spark.createDataFrame([(t,) for t in ODD], "t string")
    d = d.withColumn("ids", tokens.encoder(lambda: bpe.Encoder(ranks))("t")).withColumn("back", tokens.decoder(lambda: bpe.Encoder(ranks))("ids"))
    for r in d.collect():
        assert r.ids == own.encode_ordinary(r.t) and r.back == r.t
    assert bpe.Encoder(ranks, nfc=True, prefix_space=True).encode("é") == own.encode_ordinary(" é")
    special = {bytes(r.token).decode(): r.id for r in bpe.special_tokens(read, ["<unk>", "<pad>", "<eos>"]).collect()}
    assert special == {"<unk>": 50256, "<pad>": 50257, "<eos>": 50258}
    shown = {r.id: r.token for r in bpe.as_characters(read).filter("id < 300").collect()}
    hidden, visible = bytelevel.byte_table()
    assert shown[ranks[b" t"]] == " t".translate(str.maketrans(hidden, visible))


def test_bad_vocabularies(spark):
    make = lambda rows: spark.createDataFrame([(bytearray(t), i) for t, i in rows], "token binary, id int")
    whole = [(bytes([b]), b) for b in range(256)]
    for rows, why in ((whole[1:], "without a token"), ([*whole, (b"a", 300)], "distinct"), ([*whole, (b"ab", 5)], "distinct")):
        with pytest.raises(ValueError, match=why):
            bpe.ranks_of(make(rows))
    assert bpe.merged(b"", {}, [1]) == ([], [0])


def test_statistics_are_the_library_s(spark, small, vocabulary):
    tok = pytest.importorskip("tokenizers").Tokenizer.from_file(vocabulary.path("byte_bpe_50k.json"))
    tok.encode_special_tokens = True
    want = {}
    for r in spark.read.parquet(f"{small}/documents.parquet").collect():
        n, c = want.get(r.lang, (0, 0))
        want[r.lang] = (n + len(tok.encode(r.text or "", add_special_tokens=False).ids) + 1, c + len(r.text or ""))
    assert {r.lang: (r.tokens, r.chars) for r in catalogue.QUERIES["bpe_encode_stats"](spark, small).collect()} == want


def test_cost_of_vocabularies(spark, small, vocabulary):
    tiktoken = pytest.importorskip("tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in open(vocabulary.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    texts = [unicodedata.normalize("NFC", r.text or "") for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    chars = sum(map(len, texts))
    rows = catalogue.QUERIES["vocab_cost"](spark, small).orderBy("ord").collect()
    counts = []
    for r in rows:
        own = tiktoken.Encoding("own", pat_str=vocabulary.PATTERN, mergeable_ranks={t: i for t, i in ranks.items() if i < r.vocab}, special_tokens={})
        counts.append(sum(len(own.encode_ordinary(t if not t or t[0] == " " else f" {t}")) for t in texts))
        embed, body = r.actual * 640, 8 * (4 * 640 * 640 + 3 * 640 * int(2 * 4 * 640 / 3) + 4 * 640) + 2 * 640
        assert (r.embed_params, r.body_params, r.total_params, r.full) == (embed, body, embed + body, r.actual >= 0.99 * r.vocab)
        assert r.tok_per_char == round(counts[-1] / chars, 6) and r.embed_pct == round(embed / (embed + body) * 100, 6)
        # the context is counted from the rounded rate in neither of the two
        assert r.context_chars == int(512 / (counts[-1] / chars))
        assert r.head_flop_pct == round(2 * embed / (2 * embed + 2 * body + 4 * 8 * 512 * 640) * 100, 6)
    assert [r.extra_tokens_pct for r in rows] == [round((n / counts[-1] - 1) * 100, 6) for n in counts]
    assert counts == sorted(counts, reverse=True)
