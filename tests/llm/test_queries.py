"""The registered queries and the pipeline over the smallest tables."""

import base64
import collections
import hashlib
import os
import re
import zlib

import pytest

duckdb = pytest.importorskip("duckdb")

import corpus_pipeline  # noqa: E402
from corpusloom.llm.queries import QUERIES  # noqa: E402
from corpusloom.llm.sql import ORACLE_SQL  # noqa: E402


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr(tuple(v[i] for i in order)) for v in values)


#: What the registered queries return at least: names and types.
COLUMNS = {
    "op1_minhash_near_dedup": "doc_id bigint, class_id bigint, class_size bigint, kept boolean",
    "op2_secret_scan": "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string",
    "op3_quality_fm": "doc_id bigint, held_out boolean, score double, predicted int",
    "op4_exact_dedup": "doc_id bigint, keep_id bigint, group_size bigint, kept boolean, text_sha256 string",
    "op5_mix_sources": "doc_id bigint, size bigint, source_size bigint, target double, taken bigint",
    "op6_byte_bpe": "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
    "op7_line_dedup": "doc_id bigint, n_lines bigint, n_kept bigint, dropped string",
    "op8_kd_shards": "doc_id bigint, size bigint, text_crc32 bigint, law string, shard int, slot bigint, grown_shard int",
    "op9_nn_descent": "vec_id bigint, n_links bigint, component_id bigint, kept boolean",
    "op10_url_filter": "page_id bigint, host string, path string, rule string, verdict string",
    "op11_prefix_trie": "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string",
    "op12_spelling_variants": "word string, form string, root string, n bigint, n_near bigint, form_n bigint",
    "op13_decontamination": "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean",
}


def check_secrets(rows, docs):
    """Base findings by the rule, overlapping none of their kind, and their digest."""
    kinds = [("assign", r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 8, 1), ("access", r"AKIA[A-Z0-9]+", 16, 0), ("hex", r"[0-9a-f]+", 32, 0)]
    for r in rows:
        found = [(m.start(), i, f"{k}:{m.start()}:{m.end()}") for i, (k, p, n, g) in enumerate(kinds) for m in re.finditer(p, docs[r["doc_id"]]) if len(m[g]) >= n]
        spans = [s for _, _, s in sorted(found)]
        assert hashlib.sha256(",".join(spans).encode()).hexdigest() == r["base_sha256"] and set(spans) <= set(r["spans"].split(","))
        assert [r[f"n_{k}"] for k, *_ in kinds] == [sum(s.startswith(k) for s in spans) for k, *_ in kinds]


def check_scores(rows, docs):
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5)


def check_mix(rows, docs):
    taken, target = collections.Counter(), {}
    for r in rows:
        assert r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", docs[r["doc_id"]])) and 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    assert sum(target.values()) == pytest.approx(1.5 * sum(r["size"] for r in rows))
    assert all(abs(taken[s] - t) < max(r["size"] for r in rows) for s, t in target.items())


def check_ids(rows, docs):
    tiktoken, public = pytest.importorskip("tiktoken"), pytest.importorskip("public_tokenizers")
    ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in open(public.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    own = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for r in rows:
        ids = own.encode_ordinary(docs[r["doc_id"]])
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(docs[r["doc_id"]].encode()).hexdigest()


def check_lines(rows, docs):
    for r in rows:
        lines, gone = docs[r["doc_id"]].split("\n"), [int(x) for x in r["dropped"].split(",") if x]
        assert r["n_lines"] == len(lines) and r["n_kept"] == len(lines) - len(gone) and gone == sorted(set(gone)) and all(lines[i].strip() for i in gone)
    # one line of each text is left at most
    left = collections.Counter(x.strip(" ").lower() for r in rows for i, x in enumerate(docs[r["doc_id"]].split("\n")) if str(i) not in r["dropped"].split(",") and x.strip(" "))
    assert max(left.values()) == 1


def check_shards(rows, docs):
    size, slots = collections.Counter(), collections.defaultdict(list)
    for r in rows:
        data = docs[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(data) + 1, zlib.crc32(data), "bytes", None)
        size[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert set(size) == set(range(16)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(size.values()) - min(size.values()) < 0.2 * sum(size.values()) / 16


CONTRACTS = {"op2_secret_scan": check_secrets, "op3_quality_fm": check_scores, "op5_mix_sources": check_mix, "op6_byte_bpe": check_ids, "op7_line_dedup": check_lines, "op8_kd_shards": check_shards}


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, small, name):
    got = QUERIES[name](spark, small)
    kinds = dict(got.dtypes)
    assert {c: kinds.get(c) for c, _ in (x.split() for x in COLUMNS[name].split(", "))} == dict(x.split() for x in COLUMNS[name].split(", "))
    found = got.collect()
    values = [tuple(r) for r in found]
    assert values
    if name in CONTRACTS:
        docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
        assert sorted(r["doc_id"] for r in found) == sorted(docs)
        CONTRACTS[name](found, docs)
    if name in ORACLE_SQL:
        con = duckdb.connect()
        for f in os.listdir(small):
            con.execute(f"create view {f[:-8]} as select * from read_parquet('{small}/{f}')")
        cur = con.execute(ORACLE_SQL[name])
        assert rows(got.columns, values) == rows([c[0] for c in cur.description], cur.fetchall())


def test_pipeline_stage_by_stage(spark, small, tmp_path):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns, seen = docs.columns, []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, small)
        out.write.parquet(str(tmp_path / str(i)))
        before, docs = docs, spark.read.parquet(str(tmp_path / str(i)))
        seen.append(name)
        if i < 4:
            assert docs.columns == columns
            known = {(r["doc_id"], r["text"]) for r in before.collect()}
            assert all((r["doc_id"], r["text"]) in known for r in docs.collect())
        if name == "quality_classifier":
            labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{small}/labels.parquet").collect()}
            stays = {r["doc_id"] for r in docs.collect()}
            right = [(i in stays) == bool(q) for i, q in labels.items()]
            assert sum(right) / len(right) > 0.95
        if name == "exact_dedup":
            texts = [re.sub(r"[\x20\x09-\x0D]", "", r["text"] or "") for r in docs.collect()]
            assert len(texts) == len(set(texts)) and set(texts) == {re.sub(r"[\x20\x09-\x0D]", "", r["text"] or "") for r in before.collect()}
        if name == "minhash_near_dedup":
            sets = []
            for r in docs.collect():
                w = (r["text"] or "").lower().split()
                sets.append({tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))})
            by = collections.defaultdict(list)
            for k, s in enumerate(sets):
                for g in s:
                    by[g].append(k)
            common = collections.Counter((a, b) for v in by.values() for x, a in enumerate(v) for b in v[x + 1 :])
            assert not [p for p, n in common.items() if n >= 0.8 * (len(sets[p[0]]) + len(sets[p[1]]) - n)]
        if name == "byte_bpe":
            assert docs.filter("not round_trip").count() == 0 and docs.count() == before.count()
    assert len(seen) == 5


def test_pipeline_is_registered():
    import __spark_entry__ as entry

    assert entry.queries()["pipeline"] is corpus_pipeline.run
    assert {n.split("_")[0] for n in entry.queries() if n.startswith("op")} == {f"op{i}" for i in range(1, 14)}
