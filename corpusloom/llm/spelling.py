"""Spelling variants: every word's full neighbourhood, joined to the vocabulary."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stages import Stages
from .wordhash import mix64

#: Letters of a word: A-Z in lower case, and U+00C0 to U+00FF as they are.
_RUN = re.compile("[a-zÀ-ÿ]+")
#: Characters of a text that are looked at together.
_PIECE = 1 << 20
#: Distinct words that a task counts before it hands them on.
_WORDS = 200_000
#: Candidates in memory at a time.
_CANDIDATES = 1 << 20
#: Bits of the filter: 8 MB at most, whatever the vocabulary.
MAX_BITS = 1 << 26
_BASE = 0x9E3779B97F4A7C15


def _counts(least: int, every: int | None):
    """Words of ``(id, text)`` and how often they occur, summed before they are handed on."""

    def pieces(text: str) -> Iterator[str]:
        at = 0
        while at < len(text):
            end = at + _PIECE
            if end < len(text) and (rest := _RUN.match(text, end)):
                end = rest.end()
            yield text[at:end]
            at = end

    def lower(text: str) -> str:
        return text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")  # bytes: A-Z only

    def rows(found: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], ["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                salt = zlib.crc32(f"{'' if i is None else i}:".encode())
                for piece in pieces(lower(text.as_py() or "")):
                    for word, n in Counter(_RUN.findall(piece)).items():
                        if len(word) < least:
                            continue
                        if every:
                            h = zlib.crc32(word.encode(), salt)
                            if h % every == 0:
                                at = h % len(word)
                                word = word[:at] + word[at + 1 :]
                                if len(word) < least:
                                    continue
                        found[word] += n
                if len(found) > _WORDS:
                    yield rows(found)
                    found.clear()
        if found:
            yield rows(found)

    return run


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = 6, every: int | None = 199) -> DataFrame:
    """``(word, n)``: maximal runs of letters of whole texts, with A-Z in lower case, of at least ``min_length`` code points.

    Where ``every`` divides the CRC-32 of ``<id>:<run>``, the run loses one code
    point: misspellings at a known rate.  A null id stands as an empty one there, a
    null text has no words.
    """
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(_counts(min_length, every), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _powers(n: int) -> tuple[np.ndarray, np.uint64, np.uint64]:
    base, inverse = np.uint64(_BASE), np.uint64(pow(_BASE, -1, 1 << 64))
    return np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n, base, np.uint64)])), base, inverse


def _slots(hashes: np.ndarray, bits: int) -> list[np.ndarray]:
    """Three places of the filter for each hash."""
    return [(hashes >> np.uint64(s)) & np.uint64(bits - 1) for s in (0, 19, 38)]


def _finished(sums: np.ndarray, length: int) -> np.ndarray:
    return mix64(sums + np.uint64(length * 0xD6E8FEB86659FD93 % (1 << 64)))


def _matrix(words: list[str]) -> np.ndarray:
    """Code points of words of one length, a row each."""
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), -1).astype(np.uint64)


def _by_length(words: list[str], cells: int) -> Iterator[list[str]]:
    """Words of one length, as many as make ``cells`` values of the size of a word's neighbourhood."""
    groups: dict[int, list[str]] = {}
    for w in words:
        groups.setdefault(len(w), []).append(w)
    for length, group in groups.items():
        step = max(1, cells // (length + 1))
        for i in range(0, len(group), step):
            yield group[i : i + step]


def _filter_bits(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for group in _by_length(batch.column(0).to_pylist(), _CANDIDATES):
                codes = _matrix(group)
                power, _, _ = _powers(codes.shape[1])
                at = np.concatenate(_slots(_finished((codes * power[:-1]).sum(axis=1, dtype=np.uint64), codes.shape[1]), bits))
                yield pa.RecordBatch.from_arrays([pa.array((at >> np.uint64(6)).astype(np.int64)), pa.array((np.uint64(1) << (at & np.uint64(63))).view(np.int64))], ["slot", "bits"])

    return run


def vocabulary_filter(words: DataFrame, n_words: int) -> np.ndarray:
    """A Bloom filter of the vocabulary: 32 bits a word, three of them set, ``MAX_BITS`` at most.

    Too many words make more candidates pass, never fewer: the join decides.
    """
    bits = min(MAX_BITS, max(1 << 16, 1 << (32 * n_words - 1).bit_length())) if n_words else 1 << 16
    set_bits = words.select("word").mapInArrow(_filter_bits(bits), "slot long, bits long").groupBy("slot").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(bits // 64, np.uint64)
    out[set_bits.column("slot").to_numpy()] = set_bits.column("bits").to_numpy().view(np.uint64)
    return out


def _neighbours(filter_of, alphabet: str):
    """``(candidate, word, n)``: what a deletion, replacement or insertion makes of a word, each text once, as far as the filter has it."""
    chars = _matrix(list(alphabet)).ravel() if alphabet else np.zeros(0, np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: np.ndarray = filter_of.value
        bits = len(known) * 64

        def hits(sums: np.ndarray, length: int, new: np.ndarray) -> tuple[np.ndarray, ...]:
            """Indices of those candidates that are new texts and in the filter."""
            h = _finished(sums, length)
            ok = new
            for at in _slots(h, bits):
                ok = ok & ((known[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1)).astype(bool)
            return np.nonzero(ok)

        for batch in batches:
            count = dict(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
            for group in _by_length(list(count), _CANDIDATES // max(1, len(chars))):
                codes = _matrix(group)
                m, n = codes.shape
                power, base, inverse = _powers(n + 1)
                before = np.zeros((m, n + 1), np.uint64)
                np.cumsum(codes * power[:n], axis=1, out=before[:, 1:])
                whole = before[:, -1:]
                found: list[tuple[str, str]] = []
                # of equal neighbours only the last one is deleted: the others make the same text
                new = np.ones((m, n), bool)
                new[:, :-1] = codes[:, 1:] != codes[:, :-1]
                w, i = hits(before[:, :-1] + (whole - before[:, 1:]) * inverse, n - 1, new)
                found += [(group[a][:b] + group[a][b + 1 :], group[a]) for a, b in zip(w.tolist(), i.tolist(), strict=True)]
                step = max(1, _CANDIDATES // max(1, m * len(chars)))
                for lo in range(0, n + 1, step):
                    at = slice(lo, min(n, lo + step))
                    here = codes[:, at, None]
                    if here.size:
                        w, i, c = hits(whole[:, :, None] + (chars - here) * power[at][None, :, None], n, chars != here)
                        found += [(group[a][: b + lo] + alphabet[d] + group[a][b + lo + 1 :], group[a]) for a, b, d in zip(w.tolist(), i.tolist(), c.tolist(), strict=True)]
                    # an insertion after its own like makes the same text as one before it
                    at = slice(lo, min(n + 1, lo + step))
                    left = np.concatenate([np.zeros((m, 1), np.uint64), codes], axis=1)[:, at, None]
                    w, i, c = hits(before[:, at, None] + chars * power[at][None, :, None] + ((whole - before[:, at]) * base)[:, :, None], n + 1, chars != left)
                    found += [(group[a][: b + lo] + alphabet[d] + group[a][b + lo :], group[a]) for a, b, d in zip(w.tolist(), i.tolist(), c.tolist(), strict=True)]
                for j in range(0, len(found), 50_000):
                    some = found[j : j + 50_000]
                    yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in some], pa.string()), pa.array([x for _, x in some], pa.string()), pa.array([count[x] for _, x in some], pa.int64())], ["candidate", "word", "n"])

    return run


def near_words(words: DataFrame, stages: Stages) -> DataFrame:
    """``(word, n_near, best)`` for words ``(word, n)`` with a near word; ``best`` is its most frequent one, ``(n, word)``.

    All deletions, replacements and insertions over the alphabet of the vocabulary
    (90 letters at most) are made and joined to the vocabulary.  A candidate that is
    a word is near the one it was made from, and the other way round, so the
    candidates of a word's text are its near words: they are counted where they
    meet, and no pair needs its distance computed.  A Bloom filter of the
    vocabulary drops most candidates in the task that makes them.
    """
    letters = words.select(F.explode(F.array_distinct(F.split("word", ""))).alias("c")).filter("c <> ''").distinct()
    alphabet = "".join(sorted(r["c"] for r in letters.collect()))  # at most 90: the letters that runs are made of
    spark = stages.spark
    known = spark.sparkContext.broadcast(vocabulary_filter(words, words.count()))
    made = words.select("word", "n").mapInArrow(_neighbours(known, alphabet), "candidate string, word string, n long")
    best = F.min(F.struct((-F.col("n")).alias("less"), F.col("word").alias("form"))).alias("best")
    met = made.groupBy("candidate").agg(F.count("*").alias("n_near"), best)
    out = stages.write(met.join(words.select(F.col("word").alias("candidate")), "candidate", "left_semi"), batch_rows=2000)
    known.unpersist()
    return out.select(F.col("candidate").alias("word"), "n_near", F.struct((-F.col("best.less")).alias("n"), F.col("best.form").alias("word")).alias("best"))


def spelling_variants(docs: DataFrame, stages: Stages, id_col: str = "doc_id", text_col: str = "text", min_length: int = 6, min_count: int = 5, ratio: int = 5, every: int | None = 199) -> DataFrame:
    """Words of the corpus, each with the frequent word that it is a variant of.

    Words are those of ``word_counts`` with at least ``min_count`` occurrences over
    all texts.  Two are near if one inserted, deleted or replaced code point makes
    one of the other.  A word's ``form`` is its most frequent near word (of equally
    frequent ones the first in code-point order) if that is at least ``ratio`` times
    as frequent, else null.

    Returns ``word``, ``form``, ``root`` (where the forms lead; the word itself if it
    has none), ``n``, ``n_near`` and ``form_n``.  A form is ``ratio`` times as
    frequent, so chains are short; they are followed by doubling.

    Null and empty texts have no words, repeated rows count again, an empty table
    gives no rows; texts and words of any length are handled whole, in pieces.
    """
    if ratio < 2:
        raise ValueError("forms must be more frequent than their variants")
    words = stages.write(word_counts(docs, id_col, text_col, min_length, every).filter(F.col("n") >= min_count), batch_rows=500)
    near = near_words(words, stages)
    d = words.join(near, "word", "left").withColumn("has", F.col("best.n") >= ratio * F.col("n"))
    d = stages.write(d.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(F.col("has"), F.col("best.word")).alias("form"), F.when(F.col("has"), F.col("best.n")).alias("form_n")))
    up = stages.write(d.filter("form is not null").select("word", F.col("form").alias("root")))
    while True:
        after = up.select(F.col("word").alias("root"), F.col("root").alias("next"))
        nxt = stages.write(up.join(after, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        moved = nxt.filter("moved").limit(1).count()
        up = nxt.select("word", "root")
        if not moved:
            break
    return d.join(up, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
