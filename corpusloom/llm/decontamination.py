"""Benchmark passages in documents: a prefix-filtered set join on the rarest shingles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .stages import Stages
from .wordhash import SPAN, _power_tables, mix64, texts_of

#: Words of a window, and of a shingle.
WINDOW = 10
SHINGLE = 5
#: What a word is made of, once A-Z is in lower case.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Bits of the filter that documents' shingles pass: 8 MB at most.
MAX_BITS = 1 << 26

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_WORD = np.ones(256, bool)
_IS_WORD[0x00:0x30] = _IS_WORD[0x3A:0x61] = _IS_WORD[0x7B:0x80] = False


def lowered(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(lowered(text), F.lit(WORD), F.lit(0))


def _words(span: np.ndarray, firsts: np.ndarray, lasts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of the words in lower-cased bytes; texts begin at ``firsts`` and end with ``lasts``."""
    black = _IS_WORD[span]
    start, end = black.copy(), black.copy()
    start[1:] &= ~black[:-1]
    end[:-1] &= ~black[1:]
    start[firsts] = black[firsts]
    end[lasts] = black[lasts]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    power, inverse = _power_tables(len(span) + 1)
    total = np.zeros(len(span) + 1, np.uint64)
    np.cumsum((span.astype(np.uint64) + np.uint64(1)) * power[: len(span)], out=total[1:])
    return starts, ends, mix64((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def _groups(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For neighbouring texts: number of the first, their bytes in lower case, words' starts, ends and hashes, and where each text's words begin.

    A group is as many whole texts as a span holds, or one longer text, which is
    worked on in pieces that end between words.
    """
    data, offsets = texts_of(column)
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, min(n, int(np.searchsorted(offsets, offsets[i] + SPAN, "right")) - 1))
        span = _LOWER[data[offsets[i] : offsets[j]]]
        at = offsets[i : j + 1] - offsets[i]
        if j > i + 1 or len(span) <= SPAN:
            some = at[1:] > at[:-1]
            starts, ends, hashes = _words(span, at[:-1][some], at[1:][some] - 1)
        else:
            parts, lo = [], 0
            while lo < len(span):
                hi = min(len(span), lo + SPAN)
                while hi < len(span) and _IS_WORD[span[hi]]:  # not within a word
                    gap = np.flatnonzero(~_IS_WORD[span[hi : hi + SPAN]])
                    hi = hi + int(gap[0]) if len(gap) else min(len(span), hi + SPAN)
                a, b, c = _words(span[lo:hi], np.array([0]), np.array([hi - lo - 1]))
                parts.append((a + lo, b + lo, c))
                lo = hi
            starts, ends, hashes = (np.concatenate(x) for x in zip(*parts, strict=True))
        yield i, span, starts, ends, hashes, np.searchsorted(starts, at)
        i = j


def _shingles(hashes: np.ndarray, bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words that lie in one text, and the word that each begins with."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    total = np.full(n, size, np.uint64)
    for k in range(size):
        total += hashes[k : n + k] * (mix64(np.array([k + 1], np.uint64))[0] | np.uint64(1))
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    at = np.flatnonzero(text[:n] == text[size - 1 :])
    return mix64(total[at]), at


def _in_filter(known: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    bits = np.uint64(len(known) * 64 - 1)
    ok = np.ones(len(hashes), bool)
    for s in (0, 33):
        at = (hashes >> np.uint64(s)) & bits
        ok &= ((known[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1)).astype(bool)
    return ok


def shingle_filter(shingles: DataFrame, n: int) -> np.ndarray:
    """A Bloom filter of ``shingles(token)``, 32 bits each and ``MAX_BITS`` at most; what it lets through is joined."""
    bits = min(MAX_BITS, 1 << max(16, (32 * max(1, n) - 1).bit_length()))
    token = F.col("token")
    places = F.explode(F.array(*[F.shiftrightunsigned(token, s).bitwiseAND(F.lit(bits - 1)) for s in (0, 33)])).alias("at")
    slots = shingles.select(places).select(F.shiftrightunsigned("at", 6).alias("slot"), F.call_function("shiftleft", F.lit(1).cast("long"), F.col("at").bitwiseAND(F.lit(63)).cast("int")).alias("bit"))
    found = slots.groupBy("slot").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(bits // 64, np.uint64)
    out[found.column("slot").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return out


def _window_shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(win, len, size, at, token)`` of every shingle of the windows ``(win, len)``."""
    for batch in batches:
        for first, _, _, _, hashes, bounds in _groups(batch.column(0)):
            for k in range(len(bounds) - 1):
                own = hashes[bounds[k] : bounds[k + 1]]
                size = min(SHINGLE, len(own))
                token, at = _shingles(own, np.array([0, len(own)]), size)
                row = batch.slice(first + k, 1)
                yield pa.RecordBatch.from_arrays([row.column(0).take(pa.array(np.zeros(len(at), np.int64))), pa.array(np.full(len(at), len(own), np.int32)), pa.array(np.full(len(at), size, np.int32)), pa.array(at.astype(np.int32)), pa.array(token.view(np.int64))], ["win", "len", "size", "at", "token"])


def windows_of(items: DataFrame, stages: Stages, id_col: str, text_col: str, width: int) -> DataFrame:
    """``(item, win)``: runs of ``width`` neighbouring words of each item, or all its words if they are fewer."""
    d = items.select(F.col(id_col).cast("string").alias("item"), words_of(F.col(text_col)).alias("w")).filter("size(w) > 0")
    d = d.withColumn("i", F.explode(F.expr(f"sequence(0, greatest(0, size(w) - {width}))")))
    return stages.write(d.select("item", F.array_join(F.slice("w", F.col("i") + 1, F.lit(width)), " ").alias("win")).distinct())


def _counted(known_of, sizes: list[int]):
    """``(token, n)``: how often the shingles that pass the filter occur, summed before they are handed on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = known_of.value
        for batch in batches:
            found = []
            for _, _, _, _, hashes, bounds in _groups(batch.column(0)):
                for size in sizes:
                    token, _ = _shingles(hashes, bounds, size)
                    found.append(token[_in_filter(known, token)])
            token, n = np.unique(np.concatenate(found) if found else np.zeros(0, np.uint64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(n.astype(np.int64))], ["token", "n"])

    return run


def _occurrences(known_of, sizes: list[int], width: int):
    """A row for each text with the number of its words, and one for each place of a shingle that passes the filter.

    A place comes with as many words around it as a window may reach: ``near`` is
    their text, ``lead`` says how many of them stand before the shingle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = known_of.value
        for batch in batches:
            for first, span, starts, ends, hashes, bounds in _groups(batch.column(2)):
                n_texts = len(bounds) - 1
                rows = np.arange(first, first + n_texts)
                n_words = np.diff(bounds)
                yield _rows(batch, rows, n_words, pa.nulls(n_texts, pa.int64()), np.zeros(n_texts), np.zeros(n_texts), pa.nulls(n_texts, pa.string()))
                raw = span.tobytes()
                for size in sizes:
                    token, at = _shingles(hashes, bounds, size)
                    hit = np.flatnonzero(_in_filter(known, token))
                    for lo in range(0, len(hit), 20_000):
                        some = hit[lo : lo + 20_000]
                        place, reach = at[some], width if size == SHINGLE else size
                        text = np.searchsorted(bounds, place, "right") - 1
                        left = np.maximum(bounds[text], place - (reach - size))
                        right = np.minimum(bounds[text + 1], place + reach)
                        near = pa.array([raw[a:b] for a, b in zip(starts[left].tolist(), ends[right - 1].tolist(), strict=True)], pa.binary()).cast(pa.string())
                        yield _rows(batch, first + text, n_words[text], pa.array(token[some].view(np.int64)), place - bounds[text], place - left, near)

    return run


def _rows(batch: pa.RecordBatch, rows: np.ndarray, n_words: np.ndarray, token: pa.Array, pos: np.ndarray, lead: np.ndarray, near: pa.Array) -> pa.RecordBatch:
    of = pa.array(rows)
    return pa.RecordBatch.from_arrays([batch.column(0).take(of), batch.column(1).take(of), pa.array(n_words.astype(np.int64)), token, pa.array(pos.astype(np.int64)), pa.array(lead.astype(np.int32)), near], ["uid", "id", "n_words", "token", "pos", "lead", "near"])


def passages(docs: DataFrame, items: DataFrame, stages: Stages, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", width: int = WINDOW) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(uid, id, n_words)`` of every document, ``(uid, start, end, win)`` of every window found, and ``(item, win)``.

    1. A window is a set of shingles of ``SHINGLE`` words (a shorter one is a single
       shingle).  Their occurrences in all documents give the order of rarity.
    2. A document that holds a window holds all its shingles, so that the necessary
       prefix of the order is one: the rarest.  Windows with a shingle that occurs
       nowhere are out.  A bounded filter keeps other shingles of the documents
       from being shuffled.
    3. A shingle at place p that is the window's a-th leaves room for the window
       only if p - a >= 0 and the document has the words behind it: the positional
       and the length bound.
    4. What remains is compared word by word, in a span of the window's length.
    """
    wins = windows_of(items, stages, item_col, item_text_col, width)
    spark = stages.spark
    shingles = stages.write(wins.select("win").distinct().mapInArrow(_window_shingles, "win string, len int, size int, at int, token long"))
    sizes = sorted(r["size"] for r in shingles.select("size").distinct().collect())  # five sizes at most
    tokens = shingles.select("token").distinct()
    known = spark.sparkContext.broadcast(shingle_filter(tokens, tokens.count()))
    text = docs.select(F.col(text_col).alias("text"))
    rarity = stages.write(text.mapInArrow(_counted(known, sizes), "token long, n long").groupBy("token").agg(F.sum("n").alias("n")), batch_rows=1000)
    known.unpersist()
    ordered = shingles.join(rarity, "token", "left")
    prefix = ordered.groupBy("win", "len").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token", "at")).alias("p"))
    prefix = stages.write(prefix.filter("p.n > 0").select("win", "len", F.col("p.token").alias("token"), F.col("p.at").alias("at")))
    rare = prefix.select("token").distinct()
    known = spark.sparkContext.broadcast(shingle_filter(rare, rare.count()))
    base = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = base.schema["id"].dataType.simpleString()
    found = base.mapInArrow(_occurrences(known, sizes, width), f"uid long, id {kind}, n_words long, token long, pos long, lead int, near string")
    found = stages.write(found, batch_rows=1000)
    known.unpersist()
    words = F.regexp_extract_all("near", F.lit(WORD), F.lit(0))
    fits = (F.col("pos") >= F.col("at")) & (F.col("n_words") - F.col("pos") >= F.col("len") - F.col("at"))
    same = F.array_join(F.slice(words, F.col("lead") - F.col("at") + 1, F.col("len")), " ") == F.col("win")
    hits = found.filter("token is not null").join(prefix, "token").filter(fits).filter(F.when(F.col("lead") >= F.col("at"), same))
    start = F.col("pos") - F.col("at")
    hits = stages.write(hits.select("uid", start.alias("start"), (start + F.col("len")).alias("end"), "win"))
    return found.filter("token is null").select("uid", "id", "n_words"), hits, wins


def decontaminate(docs: DataFrame, items: DataFrame, stages: Stages, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", width: int = WINDOW) -> DataFrame:
    """How much of each document lies in windows of benchmark items.

    Words are runs of digits, letters a-z (A-Z in lower case) and characters
    outside ASCII.  A window is ``width`` neighbouring words of an item; an item
    with fewer words is one window.  A word is hit if it lies in an occurrence of
    a window.

    Returns for every row of ``docs``: ``uid``, the id, ``n_words``, ``n_hit``,
    ``n_items`` (distinct items with windows in it), ``items`` (their ids as
    strings, sorted) and ``contaminated``.

    Null and empty texts have no words and no windows; texts of any length are
    searched whole.  Repeated documents have a row each; items of equal text are
    all listed, repeated ids once; an item without an id hits words, but is not
    listed.  No documents: no rows; no items: nothing is hit.
    """
    rows, hits, wins = passages(docs, items, stages, id_col, text_col, item_col, item_text_col, width)
    # windows of a document that overlap count their common words once; a document's windows are at most its words
    before = F.max("end").over(W.partitionBy("uid").orderBy("start").rowsBetween(W.unboundedPreceding, -1))
    spans = hits.groupBy("uid", "start").agg(F.max("end").alias("end"))
    new = F.greatest(F.lit(0), F.col("end") - F.greatest("start", F.coalesce(before, F.lit(0))))
    n_hit = spans.select("uid", new.alias("n")).groupBy("uid").agg(F.sum("n").alias("n_hit"))
    listed = hits.select("uid", "win").distinct().join(wins, "win").filter("item is not null").select("uid", "item").distinct()
    listed = listed.groupBy("uid").agg(F.array_sort(F.collect_list("item")).alias("items"))  # at most the benchmark's items
    out = rows.join(n_hit, "uid", "left").join(listed, "uid", "left")
    items_of = F.coalesce("items", F.array().cast("array<string>"))
    n = F.coalesce("n_hit", F.lit(0)).cast("long")
    return out.select("uid", F.col("id").alias(id_col), "n_words", n.alias("n_hit"), F.size(items_of).cast("long").alias("n_items"), items_of.alias("items"), (n > 0).alias("contaminated"))
