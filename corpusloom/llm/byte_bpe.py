"""Byte-level BPE with Spark's higher-order functions.

The bytes of a distinct word become token ids by a fold
of ranked merges: each step merges the pair of lowest rank, until no pair has one.
Texts meet their words' ids in Arrow blocks, without a shuffle; decoding looks up
each id's bytes and concatenates them.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .stages import Stages

#: Unicode white space, as the split pattern's \s means it; Java's own \s is ASCII only.
_WS = r"\t-\r\x20\u0085   -     　"
#: Buckets of the rank map: a prime, below what stands for the bucket of an empty slot.
BUCKETS, EMPTY = 32749, (1 << 15) - 1
#: Stands for "no rank": above all ranks.
NONE = 1 << 17
_ID_BITS = 20
_ID = (1 << _ID_BITS) - 1
#: Ranks are below 2**17; an entry of the rank map has 15 bits of its bucket before them, less 2**31 to be an integer.
_RANK_BITS = 17
_LOWEST_ENTRY = -(1 << 31)
#: Ends of a word, which merge with nothing; the first one, once a fold is done.
END = NONE << _ID_BITS | _ID
DONE = END + 1
#: A piece whose rank is to be looked up anew.
MARK = NONE << (_ID_BITS + 1)
#: Steps of a fold that are columns: most words need no more.
STEPS = 9
#: Occurrences of a pair above which one step merges them all.
MANY = 32
#: Frequent words, at most, that are folded once for all; a block's other distinct words are folded with the block.
DICTIONARY = 1 << 18
#: Longest of them, in bytes: their table has at most 64 MB.
DICTIONARY_BYTES = 64
#: Documents, about, whose words are counted to choose them.  None of the three has a part in the results.
SAMPLE_DOCS = 16_000
#: Rows that Python gets at a time: six workers of an executor hold texts, words and ids.
BATCH_ROWS = 500
#: Words of a block, unless one text has more.
BLOCK_WORDS = 1 << 19
#: Bytes of a block that one row holds: every step of a fold has a buffer for a row.
STATE_BYTES = 1 << 18


def java_pattern(pattern: str) -> str:
    """The split pattern with explicit classes for \\s and \\S."""
    out = pattern.replace(r"[^\s", f"[^{_WS}").replace(r"\S", f"[^{_WS}]").replace(r"\s", f"[{_WS}]")
    # contractions begin with an apostrophe, which neither a letter's nor a number's branch takes: these may come first
    contractions = "'s|'t|'re|'ve|'m|'ll|'d|"
    first = r" ?\p{L}+| ?\p{N}+|"
    return out.replace(contractions + first, first + contractions) if out.startswith(contractions + first) else out


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Tables:
    """The vocabulary, and what a fold looks up: ids of single bytes, ranks of byte pairs, a hash table of ranks of pairs."""

    def __init__(self, ranks: dict[bytes, int]):
        #: Stands for an end of a word in the number of a pair, above all ids.
        self.end = max(ranks.values()) + 1
        entries = {}
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    entries[a * (self.end + 1) + b] = rank
        pairs = [ranks.get(bytes([a, b]), NONE) for a in range(256) for b in range(256)]
        shift, table = _perfect(entries, (self.end + 1) ** 2)
        lists = {"bytes": ([ranks[bytes([b])] for b in range(256)], pa.int64()), "pairs": (pairs, pa.int32()), "shift": (shift, pa.int32()), "table": (table, pa.int32())}
        self.lists = pa.table({name: pa.array([x], pa.list_(kind)) for name, (x, kind) in lists.items()})
        self.pieces = pa.array(_by_rank(ranks), pa.binary())
        text = {}
        for token, rank in ranks.items():
            try:
                text[token.decode()] = rank
            except UnicodeDecodeError:
                pass
        #: Tokens that are text: a word that is a token has its id, whatever its bytes would merge to.
        self.words = pa.array(list(text), pa.string())
        self.word_ids = pa.array([str(r) for r in text.values()], pa.string())

    def folded(self, words: DataFrame, column: str = "word") -> DataFrame:
        """Add ``ids`` (comma-joined token ids; null for null) to a table of nonempty words: the fold of ranked merges over their bytes.

        The state has a number for each piece between two ends: the rank of its merge
        with the next piece, then its id.  A step merges the leftmost pair of the
        lowest rank.  Spark interprets what lambdas hold, so the first ``STEPS`` steps
        stand as columns, which are compiled; an ``aggregate`` goes on where words need
        more.  There, of a pair that occurs more than ``MANY`` times, one step merges
        all occurrences.

        The tables are literals that scalar subqueries bring in: in the expressions
        they would be hashed for every step, and printed with every plan.  Lambdas may
        not hold subqueries and get them as a column that the optimizer inlines.  A task
        has a copy for each mention of a table, nineteen of the rank map, which the
        driver holds at once when it sends a stage: hence four bytes for an entry.
        """
        one_row = words.sparkSession.createDataFrame(self.lists)
        of = {name: one_row.select(name).scalar() for name in self.lists.column_names}
        slots, limit, end = len(self.lists["table"][0]), F.lit(NONE << _ID_BITS), F.array(F.lit(END))

        def bound(value: Column, body) -> Column:
            return F.get(F.transform(F.array(value), body), F.lit(0))

        def id_of(x: Column) -> Column:
            return x.bitwiseAND(F.lit(_ID))

        def rank(x: Column) -> Column:
            return F.shiftright(x, _ID_BITS)

        def key(a: Column, b: Column) -> Column:
            return F.shiftleft(a, _ID_BITS).bitwiseOR(b)

        def piece(k: Column, table: Column = of["table"], shift: Column = of["shift"]) -> Column:
            # bucket and slot tell which pair it is; the entry, less the bucket, is the rank if it is that pair's, else below 0 or above all ranks
            pair = F.least(rank(k), F.lit(self.end).cast("long")) * (self.end + 1) + F.least(id_of(k), F.lit(self.end).cast("long"))
            bucket = pair % BUCKETS
            entry = F.get(table, ((pair + F.get(shift, bucket.cast("int"))) % slots).cast("int"))
            found = entry - F.lit(_LOWEST_ENTRY).cast("long") - F.shiftleft(bucket, _RANK_BITS)
            return key(F.least(found.bitwiseAND(F.lit((1 << 62) - 1)), F.lit(NONE).cast("long")), rank(k))

        def around(e: Column, m: Column, p: Column) -> list[Column]:
            return [key(id_of(F.get(e, p - 2)), rank(m)), key(rank(m), id_of(F.get(e, p + 1)))]

        def merge(e: Column, p: Column, *new: Column) -> Column:
            return F.concat(F.slice(e, F.lit(1), p - 2), new[0], F.slice(e, p + 2, F.size(e)), *new[1:])

        word, e, m, p = F.col(column), F.col("__e"), F.col("__m"), F.col("__p")
        d = words.withColumn("__c", F.transform(F.split(F.decode(word.cast("binary"), "ISO-8859-1"), ""), F.ascii))
        first = lambda t: F.transform("__c", lambda x, i: key(F.coalesce(F.get(t["pairs"], x * 256 + F.get("__c", i + 1)), F.lit(NONE)).cast("long"), F.get(t["bytes"], x)))
        d = d.withColumn("__t", F.struct(of["pairs"].alias("pairs"), of["bytes"].alias("bytes")))
        d = d.withColumn("__e", F.concat(end, bound(F.col("__t"), first), end)).drop("__c", "__t")
        for _ in range(STEPS):
            d = d.withColumn("__m", F.array_min(e)).withColumn("__p", F.array_position(e, m).cast("int"))
            d = d.withColumns(dict(zip(("__l", "__r"), around(e, m, p), strict=True)))
            d = d.withColumns({"__l": piece(F.col("__l")), "__r": piece(F.col("__r"))})
            # a lambda (over nothing) ends a unit of compiled code: all steps in one would be too long for the JVM's compiler
            d = d.withColumn("__e", F.when(m >= limit, e).otherwise(merge(e, p, F.array("__l", "__r"), F.filter(F.slice(e, F.lit(1), F.lit(0)), lambda x: F.lit(True)))))

        def every(e: Column, m: Column, new) -> Column:
            # of a run of marks, every other one merges: 111 becomes 101
            marks = F.split(F.regexp_replace(F.array_join(F.transform(e, lambda x: F.when(x == m, "1").otherwise("0")), ""), "11", "10"), "")
            at = lambda k, i: F.coalesce(F.get(k, i), F.lit("0")) == "1"
            marked = F.lit(MARK)
            merged = lambda k: F.filter(F.transform(e, lambda x, i: F.when(at(k, i), marked.bitwiseOR(rank(m))).when(at(k, i - 1), F.lit(None).cast("long")).when(at(k, i + 1), marked.bitwiseOR(id_of(x))).otherwise(x)), lambda x: x.isNotNull())
            return bound(marks, lambda k: bound(merged(k), lambda t: F.transform(t, lambda x, i: F.when(x >= marked, new(key(id_of(x), id_of(F.get(t, i + 1))))).otherwise(x))))

        def step(e: Column, m: Column, new) -> Column:
            # in a lambda, array_position throws an exception for each find
            at = F.array_min(F.transform(e, lambda x, i: F.when(x == m, i))) + 1
            one = bound(at, lambda p: merge(e, p, F.transform(F.array(*around(e, m, p)), new)))
            few = (F.size(e) <= MANY) | (F.size(e) - F.size(F.array_remove(e, m)) <= MANY)
            return F.when(m >= limit, F.concat(F.array(F.lit(DONE)), F.slice(e, F.lit(2), F.size(e)))).when(few, one).otherwise(every(e, m, new))

        def on(e: Column, t: Column) -> Column:
            more = bound(F.array_min(e), lambda m: step(e, m, lambda k: piece(k, t["table"], t["shift"])))
            return F.when(F.get(e, F.lit(0)) == DONE, e).otherwise(more)

        def steps(e: Column, t: Column) -> Column:
            # as many steps as pieces, in rounds: what is done goes through few of them
            side = F.sequence(F.lit(1), F.ceil(F.sqrt(F.size("__e"))).cast("int"))
            return F.aggregate(side, e, lambda e, i: F.when(F.get(e, F.lit(0)) == DONE, e).otherwise(F.aggregate(side, e, lambda e, n: on(e, t))))

        d = d.withColumn("__t", F.when(F.array_min(e) < limit, F.struct(of["table"].alias("table"), of["shift"].alias("shift"))))
        rest = bound(F.col("__t"), lambda t: steps(e, t))
        d = d.withColumn("__e", F.when(word.isNull() | (F.array_min(e) >= limit), e).otherwise(rest))
        ids = F.array_join(F.transform(F.slice(e, F.lit(2), F.size(e) - 2), id_of), ",")
        return d.withColumn("ids", ids).drop("__e", "__m", "__p", "__l", "__r", "__t")


def _perfect(entries: dict[int, int], keys_below: int) -> tuple[list[int], list[int]]:
    """A hash table without collisions, of 32 bits an entry: shifts by bucket, and ``bucket << 17 | rank`` by slot, less 2**31.

    Buckets and slots are primes whose product is ``keys_below`` at least.  So a
    key's bucket and slot tell which key it is, and an entry need not hold it.
    """
    slots = max(3 * len(entries) // 2, -(-keys_below // BUCKETS), BUCKETS + 1)
    while not all(slots % i for i in range(2, int(slots**0.5) + 1)):
        slots += 1
    buckets: list[list[int]] = [[] for _ in range(BUCKETS)]
    for key in entries:
        buckets[key % BUCKETS].append(key)
    shift, table = [0] * BUCKETS, [EMPTY << _RANK_BITS] * slots
    free = [True] * slots
    for at in sorted(range(BUCKETS), key=lambda i: -len(buckets[i])):
        keys = buckets[at]
        while not all(free[(k + shift[at]) % slots] for k in keys):
            shift[at] += 1
            if shift[at] >= slots:
                raise ValueError("the table of pairs is too small")
        for k in keys:
            slot = (k + shift[at]) % slots
            free[slot], table[slot] = False, at << _RANK_BITS | entries[k]
    return shift, [x + _LOWEST_ENTRY for x in table]


def _by_rank(ranks: dict[bytes, int]) -> list[bytes]:
    pieces = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        pieces[rank] = token
    return pieces


def words_of(text: str, pattern: str) -> str:
    quoted = java_pattern(pattern).replace("\\", "\\\\").replace("'", "\\'")
    return f"regexp_extract_all({text}, '{quoted}', 0)"


def _frequent(docs: DataFrame, stages: Stages, text: Column, pattern: str, dictionary: int, sample_docs: int) -> DataFrame:
    """The most frequent words of about ``sample_docs`` documents, those of the lowest text hashes; at most ``dictionary``."""
    share = min(1.0, sample_docs / max(1, docs.count()))
    some = docs.select(text.alias("t")).filter(F.pmod(F.xxhash64("t"), F.lit(1_000_000)) < F.lit(int(share * 1_000_000)))
    words = some.select(F.explode(F.expr(words_of("t", pattern))).alias("word")).filter(F.octet_length("word") <= DICTIONARY_BYTES)
    counts = stages.write(words.groupBy("word").agg(F.count("*").alias("n")).filter("n > 1"))
    bins = counts.groupBy(F.floor(F.log2("n") * 8).alias("bin")).agg(F.count("*").alias("words")).collect()  # a few hundred rows
    left, least = dictionary, None
    for r in sorted(bins, key=lambda r: -r["bin"]):
        left -= r["words"]
        if left < 0:
            break
        least = r["bin"]
    return counts.filter(F.floor(F.log2("n") * 8) >= F.lit(least)) if least is not None else counts.limit(0)


_held: list[tuple[object, pa.Array]] = []


def _value(shared) -> pa.Array:
    """The array in a broadcast Arrow stream; a process reads the last two only once."""
    for known, array in _held:
        if known is shared:
            return array
    array = pa.ipc.open_stream(shared.value).read_all().column(0).combine_chunks()
    _held[:] = [(shared, array), *_held[:1]]
    return array


def _stream(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _blocks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
    """Rows in groups of about ``BLOCK_WORDS`` words (the last column), or of one longer text."""
    held, words = [], 0
    for batch in batches:
        ends = np.cumsum(pc.list_value_length(batch.column(batch.num_columns - 1)).to_numpy())
        at = done = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, done + BLOCK_WORDS - words, "right")))
            held.append(batch.slice(at, to - at))
            words += int(ends[to - 1]) - done
            at, done = to, int(ends[to - 1])
            if words >= BLOCK_WORDS // 2:
                yield held
                held, words = [], 0
    if held:
        yield held


def _numbered(known):
    """Blocks of rows: the distinct words that the dictionary lacks, a row each, then the block with words replaced by numbers (in the dictionary, then among these)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for parts in _blocks_of(batches):
            block = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
            lists = block.column(block.num_columns - 1)
            flat = lists.flatten()
            table = _value(known)
            number = pc.index_in(flat, value_set=table)
            rest = number.is_null()
            other = flat.filter(rest).dictionary_encode()
            codes = number.fill_null(0).to_numpy().copy()
            codes[rest.to_numpy(zero_copy_only=False)] = other.indices.to_numpy() + len(table)
            offsets = np.zeros(len(lists) + 1, np.int32)
            np.cumsum(pc.list_value_length(lists).to_numpy(), out=offsets[1:])
            coded = pa.ListArray.from_arrays(pa.array(offsets), pa.array(codes.astype(np.int32)))
            state = _stream(pa.RecordBatch.from_arrays([*block.columns[:-1], coded], [f"c{i}" for i in range(block.num_columns)]))
            yield pa.RecordBatch.from_arrays([pa.nulls(len(other.dictionary), pa.binary()), other.dictionary], ["state", "word"])
            del block, lists, flat, number, rest, other, codes, coded
            # the first byte tells whether the block goes on in the next row
            for at in range(0, len(state), STATE_BYTES):
                part = (b"+" if at + STATE_BYTES < len(state) else b".") + state[at : at + STATE_BYTES]
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.binary()), pa.array([None], pa.string())], ["state", "word"])
            del state
            pa.default_memory_pool().release_unused()

    return run


def _assembled(known, names: list[str]):
    """The rows of numbered blocks with their texts' ids; a block's words come before its state."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Array] = []
        state: list[bytes] = []
        for batch in batches:
            at = 0
            for row in np.flatnonzero(batch.column(0).is_valid().to_numpy(zero_copy_only=False)).tolist():
                part = batch.column(0)[row].as_py()
                state.append(part[1:])
                held.append(batch.column(1).slice(at, row - at))
                at = row + 1
                if part[:1] == b"+":
                    continue
                block = pa.ipc.open_stream(b"".join(state)).read_all().combine_chunks().to_batches()[0]
                ids = pa.concat_arrays([_value(known), *held])
                held, state = [], []
                coded = block.column(block.num_columns - 1)
                for i in range(0, block.num_rows, BATCH_ROWS):
                    some = coded.slice(i, BATCH_ROWS)
                    ends = pc.subtract(some.offsets, some.offsets[0])
                    joined = pc.binary_join(pa.ListArray.from_arrays(ends, ids.take(some.flatten())), ",")
                    yield pa.RecordBatch.from_arrays([*[c.slice(i, BATCH_ROWS) for c in block.columns[:-1]], joined], [*names, "ids"])
                del block, coded, ids
                pa.default_memory_pool().release_unused()
            held.append(batch.column(1).slice(at))

    return run


def encode(docs: DataFrame, stages: Stages, tables: Tables, pattern: str, text_col: str = "text", keep_text: bool = True, decoded: bool = False, dictionary: int = DICTIONARY, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """Add ``ids``, the comma-joined token ids of every whole text, to the rows of ``docs``.

    Each match of ``pattern`` is a word; a word that is a token has its id.  The
    most frequent others (at most ``dictionary``, of up to 64 bytes, by the counts
    of about ``sample_docs`` documents) are folded once, and go to the tasks as a
    table of at most 64 MB.  Rows are dealt with in blocks of about half a million
    words, where they stand: a block's further distinct words are folded once for the
    block.  The ids do not depend on these bounds.  No text is shuffled.

    Null and empty texts have no ids; repeated rows repeat; words of any length are
    folded whole; an empty table gives no rows.  A column ``ids`` of ``docs`` is
    replaced, columns of other names stay (but for the text, without ``keep_text``).
    ``decoded`` adds what ``decode`` does, in the same Python worker.

    The result is lazy, so the session keeps Arrow batches of at most ``BATCH_ROWS``
    rows from here on.
    """
    spark = docs.sparkSession
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(rows)) <= BATCH_ROWS:
        spark.conf.set(rows, BATCH_ROWS)
    docs = docs.drop("ids", "decoded") if decoded else docs.drop("ids")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    frequent = tables.folded(_frequent(docs, stages, text, pattern, dictionary, sample_docs).select("word").repartition(12, "word")).toArrow()
    more = frequent.filter(pc.invert(pc.is_in(frequent["word"], value_set=tables.words)))
    column = lambda own, name: pa.concat_arrays([own, more[name].combine_chunks().cast(pa.string())])
    words, ids = (spark.sparkContext.broadcast(_stream(pa.RecordBatch.from_arrays([column(own, name)], ["c"]))) for own, name in ((tables.words, "word"), (tables.word_ids, "ids")))
    kept = [f for f in docs.schema.fields if keep_text or f.name != text_col]
    split = docs.select(*[F.col(f"`{f.name}`").alias(f"c{i}") for i, f in enumerate(kept)], F.expr(words_of(f"coalesce(cast(`{text_col}` as string), '')", pattern)).alias("words"))
    blocks = split.mapInArrow(_numbered(words), "state binary, word string")
    assemble, fields = _assembled(ids, [f.name for f in kept]), [*kept, T.StructField("ids", T.StringType())]
    if decoded:
        texts = _decoded(_pieces(spark, tables), len(kept))
        return tables.folded(blocks).select("state", "ids").mapInArrow(lambda batches: texts(assemble(batches)), T.StructType([*fields, T.StructField("decoded", T.BinaryType())]))
    return tables.folded(blocks).select("state", "ids").mapInArrow(assemble, T.StructType(fields))


def _pieces(spark, tables: Tables):
    return spark.sparkContext.broadcast(_stream(pa.RecordBatch.from_arrays([tables.pieces], ["c"])))


def n_tokens(ids: Column) -> Column:
    return F.when(ids == "", 0).otherwise(F.length(ids) - F.length(F.replace(ids, F.lit(","))) + 1).cast("long")


def _decoded(pieces, at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = max(1, batch.num_rows * (4 << 20) // max(1, batch.column(at).nbytes))
            for i in range(0, batch.num_rows, step):
                part = batch.slice(i, step)
                ids = part.column(at)
                some = pc.greater(pc.fill_null(pc.binary_length(ids), 0), 0)
                lists = pc.split_pattern(ids.filter(some), ",")
                found = _value(pieces).take(lists.flatten().cast(pa.int32()))
                lengths = np.zeros(len(ids), np.int64)
                lengths[some.to_numpy(zero_copy_only=False)] = pc.list_value_length(lists).to_numpy()
                ends = np.append(0, np.cumsum(lengths))
                # pieces lie one behind the other: a text is a stretch of them
                cuts = np.frombuffer(found.buffers()[1], np.int32)[found.offset : found.offset + len(found) + 1][ends] if len(found) else np.zeros(len(ends), np.int32)
                texts = pa.Array.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(np.ascontiguousarray(cuts, np.int32).tobytes()), found.buffers()[2] if len(found) else pa.py_buffer(b"")])
                yield pa.RecordBatch.from_arrays([*part.columns, texts], [*part.schema.names, "decoded"])

    return run


def decode(encoded: DataFrame, tables: Tables, ids_col: str = "ids") -> DataFrame:
    """Add ``decoded`` (binary): the bytes of each id, concatenated; a column of that name is replaced.  Null and empty ids have no bytes."""
    encoded = encoded.drop("decoded")
    pieces = _pieces(encoded.sparkSession, tables)
    return encoded.mapInArrow(_decoded(pieces, encoded.columns.index(ids_col)), T.StructType([*encoded.schema.fields, T.StructField("decoded", T.BinaryType())]))
