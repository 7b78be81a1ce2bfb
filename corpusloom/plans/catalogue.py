"""The registered queries over the whole driver tables, each beside its SQL in ``oracles``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import bytelevel
from corpusloom.functions import text as tx
from corpusloom.operators import analysis, arrivals, bpe, corpus, dedup, mixing, quality, sampler, sampling, tokens, vectors
from corpusloom.plans import preparation
from corpusloom.plans.stages import Stages
from corpusloom.session import ship_code
from corpusloom.sources import corpus_file, files
from corpusloom.sources import token_store as store
from corpusloom.streaming import pull

from .oracles import ORACLE_SQL as ORACLE_SQL

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_code(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, dealt to the cores: small tables are one file, which one task would read."""
    d = table(spark, sf_dir, "documents")
    return d.repartition(spark.sparkContext.defaultParallelism) if d.rdd.getNumPartitions() < spark.sparkContext.defaultParallelism else d


# -- quality ---------------------------------------------------------------------------------------------------------

@query
def quality_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.report(quality.judged(documents(spark, sf_dir)))


@query
def quality_pass_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = quality.judged(documents(spark, sf_dir)).filter("reason is null")
    return d.select("doc_id", F.md5("text").alias("text_md5"))


@query
def reject_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(documents(spark, sf_dir)).select("doc_id", "reason")


@query
def unfiltered_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = quality.judged(documents(spark, sf_dir), filtered=False)
    return d.groupBy("source").agg(F.count_if(F.col("reason").isNull()).alias("written"), F.count_if(F.col("reason").isNotNull()).alias("rejected"))


@query
def text_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tx.strip(tx.text_or_empty(F.col("text")))
    lines = tx.split_lines(t)
    return documents(spark, sf_dir).select(
        "doc_id", F.length(t).cast("long").alias("chars"), tx.count_digits(t).cast("long").alias("digits"), tx.count_any(t, tx.TURKISH).cast("long").alias("turkish"),
        F.size(tx.words(tx.normalise(t))).cast("long").alias("words"), F.size(lines).cast("long").alias("lines"), F.size(F.array_distinct(lines)).cast("long").alias("distinct_lines"), F.octet_length(t).cast("long").alias("bytes"),
    )


@query
def folded_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", F.md5(tx.fold(F.col("text"))).alias("folded_md5"))


@query
def collapse_blank_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents(spark, sf_dir).withColumn("text", F.replace("text", F.lit("\n"), F.lit("\n \n")))
    return d.select("doc_id", F.md5(tx.close_blank_lines(F.col("text"))).alias("text_md5"))


# -- dedup -----------------------------------------------------------------------------------------------------------

@query
def exact_dedup_keep(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents(spark, sf_dir).select("doc_id", F.md5(tx.normalise(tx.text_or_empty(F.col("text")))).alias("key"))
    return dedup.keep_first(d, F.col("key")).select("doc_id", "first_id")


@query
def arrivals_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in three arrivals: the first of equal texts among all that have come."""
    d = documents(spark, sf_dir).select("doc_id", F.md5(tx.normalise(tx.text_or_empty(F.col("text")))).alias("key"))
    d = Stages(spark, "arrivals").write(d)
    seen, out = arrivals.Fingerprints(spark, f"{Stages(spark, 'fingerprints').root}/table"), None
    for i in range(3):
        part = seen.admit(d.filter(F.col("doc_id") % 3 == i), i, F.col("key")).select("doc_id", F.lit(i).alias("arrival"), "first_id", "first_arrival")
        out = part if out is None else out.unionByName(part)
    return out


@query
def simhash_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tx.text_or_empty(F.col("text"))
    return documents(spark, sf_dir).select("doc_id", dedup.exact_hash(t).alias("full"), dedup.simhash(t).alias("sig"))


@query
def near_dup_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.dedup_flags(documents(spark, sf_dir))


@query
def near_dup_blake2b(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.dedup_flags(documents(spark, sf_dir), "blake2b")


@query
def dedup_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.summary(dedup.dedup_flags(documents(spark, sf_dir)))


@query
def dedup_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    gone = dedup.dedup_flags(docs).filter("exact_dup or near_dup")
    kept = docs.join(gone.select("doc_id"), "doc_id", "left_anti").filter(tx.strip(F.col("text")) != "")
    return kept.select("doc_id", F.md5("text").alias("text_md5"))


# -- mixing ----------------------------------------------------------------------------------------------------------

LANGS, WEIGHTS = ("en", "fr", "de"), (0.70, 0.20, 0.10)
#: For the mixes, a lower share of Turkish letters lets English through.
MIX_LIMITS = {"min_turkish": 0.0, "min_length": 100}


def _sourced(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    """Documents of the listed languages with their verdicts, and three quarters of the accepted ones: so many that a source runs dry."""
    d = quality.judged(documents(spark, sf_dir).select("doc_id", "lang", "text"), **MIX_LIMITS)
    number = F.coalesce(*[F.when(F.col("lang") == lang, i) for i, lang in enumerate(LANGS)])
    d = Stages(spark, "sourced").write(d.select("doc_id", number.alias("source_id"), "reason").filter("source_id is not null"))  # narrow, and read several times
    return d, max(1, d.filter("reason is null").count() * 3 // 4)


@query
def mix_serial(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged, target = _sourced(spark, sf_dir)
    d = mixing.mix(judged.filter("reason is null"), WEIGHTS, target)
    return d.select("doc_id", "source_id", F.col("k").cast("long").alias("k"), "mix_pos")


@query
def mix_parallel(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged, target = _sourced(spark, sf_dir)
    d = mixing.mix(judged.filter("reason is null"), WEIGHTS, target, whole_rounds=True)
    return d.select("doc_id", "source_id", F.col("k").cast("long").alias("k"), "mix_pos")


@query
def mix_reject_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged, target = _sourced(spark, sf_dir)
    return mixing.reject_counts(judged, WEIGHTS, target)


@query
def worker_limited_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged, target = _sourced(spark, sf_dir)
    d = mixing.worker_limited(judged.filter("reason is null").select("doc_id"), 8, target // 8 + 1)
    return d.select("doc_id", "worker", F.col("k").cast("long").alias("k"))


@query
def pulled_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The accepted documents as a stream, of which each language gives its share of a quarter of them."""
    judged, _ = _sourced(spark, sf_dir)
    good = judged.filter("reason is null")
    quarter = good.count() // 4
    stages = Stages(spark, "pulled")
    stages.write(good)
    took = pull.Pull(spark, f"{stages.root}/taken", [quarter * q // 100 + 1 for q in mixing.quotas(WEIGHTS)])
    took.run(spark.readStream.schema(good.schema).parquet(f"{stages.root}/001"), f"{stages.root}/check")
    return took.rows().select("doc_id", "source_id", F.col("k").cast("long").alias("k"))


@query
def prepared_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole preparation, a language for each source: judged, mixed, without copies, written as text, encoded into a store; its documents."""
    docs, stages = documents(spark, sf_dir), Stages(spark, "prepared")
    paths = [f"{stages.root}/{lang}" for lang in LANGS]
    for lang, path in zip(LANGS, paths, strict=True):
        docs.filter(F.col("lang") == lang).select("doc_id", "text").write.parquet(path)
    target = max(1, _sourced(spark, sf_dir)[1])
    settings = preparation.Settings(target=target, **MIX_LIMITS)
    run, made = preparation.prepare(spark, f"{stages.root}/run", paths, WEIGHTS, _vocabulary("byte_bpe_multi_50k.tiktoken"), settings)
    return run.read(made["dedup"]).select("source_id", "id", "mix_pos", F.md5("text").alias("text_md5"))


def _table_plan(spark: SparkSession, sf_dir: str) -> list[dict]:
    """A plan for the sources of the documents: each weighs what it has, its documents are its shards, and a half of all is the target."""
    counted = table(spark, sf_dir, "documents").filter("source is not null").groupBy("source").count().orderBy("source").collect()  # a row for each source of a mix
    listed = [mixing.Source(r["source"], "part", float(r["count"]), r["count"], 8, 6) for r in counted]
    return mixing.plan(listed, sum(r["count"] for r in counted) // 2, 40)


@query
def source_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis.sources_table(spark, _table_plan(spark, sf_dir))


@query
def shard_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which worker of a source reads which of its shards, from the eighth on."""
    plans = _table_plan(spark, sf_dir)
    rows = [(p["source_id"], p["workers"], 8, max((s[-1] for s in p["shards"] if s), default=7)) for p in plans]
    d = spark.createDataFrame(rows, "source_id int, workers int, first int, last int").filter("last >= first")
    d = d.select("source_id", F.explode(F.sequence("first", "last")).alias("shard"), "workers", "first")
    return d.select("source_id", F.pmod(F.col("shard") - F.col("first"), F.col("workers")).alias("worker"), "shard")


@query
def shard_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shard of 30, and which of eight workers reads it from shard 8 on."""
    d = corpus.shard(table(spark, sf_dir, "documents").select("doc_id"), 30)
    return d.withColumn("worker", F.when(F.col("shard") >= 8, F.col("shard") % 8))


@query
def worker_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents dealt into 30 files by id; each of eight workers opens the files of its shards, from shard 8 on."""
    root = f"{Stages(spark, 'shards').root}/files"
    d = corpus.shard(table(spark, sf_dir, "documents").select("doc_id"), 30)
    # a file for each shard, named so that their order is the shards'
    d.select("doc_id", F.format_string("%02d", "shard").alias("part")).repartition("part").write.partitionBy("part").parquet(root)
    out = None
    names = [int(f.path.split("part=")[1][:2]) for f in files.list_files(spark, root)]
    for worker in range(8):
        mine = [i for i, shard in enumerate(names) if shard >= 8 and shard % 8 == worker]
        rows = files.read_shards(spark, root, len(names), mine, schema="doc_id long").select("doc_id", F.element_at(F.array(*[F.lit(x) for x in names]), F.col("shard") + 1).alias("shard"), F.lit(worker).alias("worker"))
        out = rows if out is None else out.unionByName(rows)
    return out


# -- corpus ----------------------------------------------------------------------------------------------------------

@query
def prefix_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.prefix_sample(table(spark, sf_dir, "documents"), 1_000_000)


@query
def corpus_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two corpus files, of even and of odd ids, written and read back one after the other; one that does not exist is left out."""
    docs, root = documents(spark, sf_dir), Stages(spark, "corpus").root
    for i in range(2):
        corpus_file.write_corpus(docs.filter(F.col("doc_id") % 2 == i), f"{root}/{i}")
    back = corpus_file.read_corpora(spark, [f"{root}/{i}" for i in range(3)])
    return back.groupBy("file_no", F.md5("text").alias("text_md5")).agg(F.count("*").alias("n"))


@query
def word_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.word_frequency(documents(spark, sf_dir))


@query
def pair_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.pair_frequency(corpus.word_frequency(documents(spark, sf_dir), 1))


@query
def token_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    words = docs.select("doc_id", F.explode(tx.words(tx.normalise(tx.text_or_empty(F.col("text"))))).alias("word"))
    d = tokens.token_to_id(words, tokens.vocabulary(corpus.word_frequency(docs, 1), 200))
    return d.groupBy("doc_id").agg(F.count("*").alias("words"), F.count_if(F.col("id").isNull()).alias("unknown"), F.coalesce(F.sum("id"), F.lit(0)).cast("long").alias("id_sum"))


# -- tokens ----------------------------------------------------------------------------------------------------------

def _tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word lengths as token ids, which SQL can repeat, and an end token."""
    t = tx.words(tx.normalise(tx.text_or_empty(F.col("text"))))
    d = documents(spark, sf_dir).select("doc_id", tokens.with_eos(tokens.word_length_tokens(t)).alias("tokens"))
    return tokens.offsets(Stages(spark, "tokens").write(d))  # read for its bounds, its sums and its rows


@query
def token_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tokens(spark, sf_dir).select("doc_id", "n", "off")


def _window_rows(w: DataFrame) -> DataFrame:
    return w.select("win", *[F.array_join(F.transform(c, lambda x: x.cast("string")), " ").alias(c) for c in ("x", "y")])


@query
def token_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _window_rows(tokens.windows(_tokens(spark, sf_dir), 64, 64))


@query
def overlapping_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = tokens.windows(_tokens(spark, sf_dir), 32, 8)
    return d.select("win", F.aggregate("x", F.lit(0), lambda s, x: s + x).cast("long").alias("sum_x"), F.get("y", F.lit(31)).cast("long").alias("last_y"))


@query
def next_token_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = tokens.windows(_tokens(spark, sf_dir), 64, 64)
    pairs = w.select(F.explode(F.arrays_zip("x", "y")).alias("p")).select(F.col("p.x").alias("tok"), F.col("p.y").alias("next_tok"))
    return pairs.groupBy("tok", "next_tok").agg(F.count("*").alias("n"))


@query
def split_train_val(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _tokens(spark, sf_dir)
    n = tokens.total(d)
    at = tokens.split_point(n, 0.1)
    parts = [tokens.stream_slice(d, a, b).select(F.lit(name).alias("part"), "doc_id", "off", "n") for name, a, b in (("train", 0, at), ("val", at, n))]
    return parts[0].unionByName(parts[1])


@query
def resume_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = tokens.window_count(tokens.total(_tokens(spark, sf_dir)), 64, 64)
    per_epoch, _ = analysis.steps(-(-n // 8), 4, 3)
    epoch, _, skip = analysis.resume_position(per_epoch + per_epoch // 3, per_epoch, 4, 8)
    return sampler.samples(spark, n, 42, epoch, skip)


@query
def replica_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of all replicas of three, each with its replica and its place there; what three do not share evenly is left out."""
    n = tokens.window_count(tokens.total(_tokens(spark, sf_dir)), 64, 64)
    parts = [sampler.samples(spark, n, 42, 0, replicas=3, replica=r).withColumn("replica", F.lit(r)) for r in range(3)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query
def token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The middle third of the stream, read back by offset from a store of raw tokens: sums over each thousand of its tokens."""
    path = Stages(spark, "token_store").root
    store.write_stream(_tokens(spark, sf_dir), path)
    stream = store.TokenStream(spark, path)
    third = stream[len(stream) // 3 : 2 * (len(stream) // 3)].read()
    d = third.select("off", F.posexplode("tokens").alias("i", "tok")).select((F.col("off") + F.col("i")).alias("pos"), "tok")
    return d.groupBy(F.floor(F.col("pos") / 1000).alias("part")).agg(F.count("*").alias("n"), F.sum("tok").alias("tok_sum"), F.sum(F.col("tok") * (F.col("pos") % 1000)).alias("place_sum"))


def _vocabulary(name: str) -> str:
    """A file of the installed tokenizers; without them an error."""
    import public_tokenizers

    return f"file://{public_tokenizers.path(name)}"


def _ranks(spark: SparkSession, name: str) -> dict[bytes, int]:
    return bpe.ranks_of(bpe.read_vocabulary(spark, _vocabulary(name)))


@query
def decoded_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that were encoded, padded to the end token and decoded again."""
    ranks = spark.sparkContext.broadcast(_ranks(spark, "byte_bpe_multi_50k.tiktoken"))
    ids, back = tokens.encoder(lambda: bpe.Encoder(ranks.value), add_eos=True, eos=50256), tokens.decoder(lambda: bpe.Encoder(ranks.value))
    return documents(spark, sf_dir).select("doc_id", F.md5(back(ids("text"))).alias("text_md5"))


@query
def bpe_encode_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of each language, with an end token for each document."""
    d = documents(spark, sf_dir).select("lang", tx.text_or_empty(F.col("text")).alias("text"))
    words = bpe.word_counts(d, ["lang"], nfc=False, prefix_space=False)
    counts = bpe.token_counts(words, _ranks(spark, "byte_bpe_50k.tiktoken"), [50256], ["lang"])
    whole = d.groupBy("lang").agg(F.sum(F.length("text")).cast("long").alias("chars"), F.count("*").alias("ends"))
    tokens_of = (F.coalesce("tokens", F.lit(0)) + F.col("ends")).cast("long")
    out = whole.join(counts.withColumnRenamed("lang", "of"), F.col("lang").eqNullSafe(F.col("of")), "left")
    return out.select("lang", tokens_of.alias("tokens"), "chars", F.round(F.try_divide(tokens_of, F.col("chars")), 6).alias("tok_per_char"))


@query
def byte_pair_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbouring bytes within the words of byte-level vocabularies, which merges are counted on."""
    t = tx.words(tx.normalise(tx.text_or_empty(F.col("text"))))
    words = documents(spark, sf_dir).select(F.explode(t).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return bpe.byte_pair_counts(words.select(bytelevel.with_prefix_space(F.col("word")).alias("word"), "n"))


# -- analysis --------------------------------------------------------------------------------------------------------

VOCABULARIES = (8000, 16000, 24000, 32000, 48000)


@query
def vocab_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What vocabularies of five sizes cost: the first tokens of one list, whose counts come from one fold of the corpus's words."""
    docs = documents(spark, sf_dir)
    chars, words = docs.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)), F.coalesce(F.sum(F.size(tx.words(tx.normalise(tx.text_or_empty(F.col("text")))))), F.lit(0))).first()
    ranks = _ranks(spark, "byte_bpe_multi_50k.tiktoken")
    sizes = spark.createDataFrame([(i, v, min(v, len(ranks))) for i, v in enumerate(VOCABULARIES)], "ord int, vocab long, actual long")
    counts = bpe.token_counts(bpe.word_counts(docs), ranks, VOCABULARIES)  # a row for each size
    listed = sizes.join(F.broadcast(counts), F.col("vocab") == F.col("size"), "left").select("ord", "vocab", "actual", F.coalesce("tokens", F.lit(0)).alias("tokens"))
    return analysis.vocab_cost(listed, 640, 8, chars, words)


@query
def lr_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every step of three epochs over the documents' windows."""
    n = tokens.window_count(tokens.total(_tokens(spark, sf_dir)), 64, 64)
    return analysis.lr_schedule(spark, analysis.steps(-(-n // 8), 4, 3)[1], 0.02, 0.1)


@query
def layer_placement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model of as many layers as each part has as its size, which grows by a half."""
    sizes = table(spark, sf_dir, "part").select(F.col("p_size").cast("long").alias("old")).filter("old > 0").distinct()
    return analysis.layer_placements(sizes.select(F.col("old").alias("model"), "old", (F.col("old") + F.floor((F.col("old") + 1) / 2)).alias("new")))


@query
def rope_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Angles for every position of the longest document."""
    longest = table(spark, sf_dir, "documents").agg(F.max(F.size(tx.words(tx.normalise(tx.text_or_empty(F.col("text")))))).alias("n")).first()["n"]
    return analysis.rope_table(spark, longest or 0, 32)


@query
def running_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "events").groupBy((F.col("event_id") % 50).alias("step")).agg(F.round(F.avg("value"), 6).alias("loss"))
    return analysis.running_best(d)


# -- sampling and vectors --------------------------------------------------------------------------------------------

def _logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("step_id"), F.posexplode(vectors.doubles(F.col("embedding"))).alias("token_id", "logit"))


def _history(logits: DataFrame) -> DataFrame:
    """Every third token of a step, twice."""
    h = logits.filter((F.col("step_id") + F.col("token_id")) % 3 == 0).select("step_id", "token_id")
    return h.union(h)


@query
def rep_penalty(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _logits(spark, sf_dir)
    return sampling.temperature(sampling.repetition_penalty(d, _history(d), 1.3), 0.8).select("step_id", "token_id", F.round("logit", 6).alias("logit"))


@query
def top_k_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _logits(spark, sf_dir).withColumn("logit", F.round("logit", 1))
    return sampling.top_k(d, 5)


@query
def softmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.softmax(_logits(spark, sf_dir)).select("step_id", "token_id", F.round("p", 6).alias("p"))


@query
def top_p_nucleus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.top_p(sampling.softmax(sampling.temperature(_logits(spark, sf_dir), 0.05)), 0.9).select("step_id", "token_id", F.round("p", 6).alias("p"))


@query
def next_token_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _logits(spark, sf_dir)
    return sampling.next_token(d, _history(d), 1.3, 0.1, 20, 0.9).select("step_id", "token_id", F.round("p", 6).alias("p"))


@query
def sampled_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _logits(spark, sf_dir)
    return sampling.draw(sampling.next_token(d, _history(d), 1.3, 0.1, 20, 0.9), 7)


@query
def masked_ce(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _logits(spark, sf_dir)
    t = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("step_id"), (F.col("vec_id") % 7).cast("int").alias("target"))
    return sampling.cross_entropy(d, t, pad_id=1)


@query
def eval_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Validation loss over at most 16 batches of 8 steps: the cap is the feature."""
    t = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("step_id"), (F.col("vec_id") % 7).cast("int").alias("target"))
    return sampling.evaluation_loss(sampling.step_losses(_logits(spark, sf_dir), t, pad_id=1), 8, 16)


def _hidden(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of one label as a sequence in the order of their ids; every fifth is masked at the end of its thousand."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("label").alias("seq_id"), F.col("vec_id").alias("pos"), F.col("embedding").alias("vec"), (F.col("vec_id") % 5 != 0).cast("int").alias("mask"))



@query
def pool_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = vectors.pool_mean(_hidden(spark, sf_dir), 64)
    return d.select("seq_id", F.posexplode("pooled").alias("i", "v")).select("seq_id", "i", F.round("v", 6).alias("v"))


@query
def pool_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    h = e.select((F.col("vec_id") / 8).cast("long").alias("seq_id"), (F.col("vec_id") % 8).alias("pos"), F.col("embedding").alias("vec"), (F.col("vec_id") % 8 < F.col("vec_id") / 8 % 8).cast("int").alias("mask"))
    return vectors.pool_last(h).select("seq_id", F.posexplode("pooled").alias("i", "v")).select("seq_id", "i", F.round("v", 6).alias("v"))


@query
def l2_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(vectors.normalised(F.col("embedding"))).alias("i", "v"))
    return e.select("vec_id", "i", F.round("v", 6).alias("v"))


@query
def dot_self(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors.normalised(F.col("embedding"))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(vectors.dot(F.col("embedding"), F.col("embedding")), 6).alias("dot"), F.round(vectors.norm(F.col("embedding")), 6).alias("norm"), F.round(vectors.dot(v, v), 6).alias("self_similarity"))


@query
def layer_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(vectors.layer_norm(F.col("embedding"))).alias("i", "v"))
    return e.select("vec_id", "i", F.round("v", 6).alias("v"), F.round(vectors.gelu(F.col("v")), 6).alias("gelu"))


@query
def rope_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(vectors.rotate(F.col("embedding"), F.col("vec_id") % 128)).alias("i", "v"))
    return e.select("vec_id", "i", F.round("v", 6).alias("v"))


@query
def context_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _tokens(spark, sf_dir).withColumn("batch", F.floor(F.col("doc_id") / 32))
    d = d.withColumns({"left": vectors.keep_left(F.col("tokens"), 16), "right": vectors.keep_right(F.col("tokens"), 16)})
    d = vectors.pad_batch(d, "batch", "tokens", pad_id=1, ctx=24)
    total = lambda c: F.aggregate(c, F.lit(0), lambda s, x: s + x).cast("long")
    return d.select("doc_id", total("left").alias("left_sum"), total("right").alias("right_sum"), total("padded").alias("padded_sum"), total("mask").alias("mask_sum"), F.size("padded").cast("long").alias("padded_len"))
