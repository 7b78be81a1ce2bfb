"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.session import ship_code

from .wordhash import SPAN, distinct_per_text, texts_of, word_hashes

WORDS = 1 << 16
BINS = 10
FACTORS = 8
#: Labelled documents that the model is fitted on, at most.
TRAIN_ROWS = 6000

# byte classes: lower, upper, digit, space, newline, stop, comma, symbol, bar, other punctuation, control, beyond ASCII
_CLASS = np.full(256, 9, np.uint8)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = 0, 1, 2, 11
_CLASS[:32] = 10
for _c, _k in ((" ", 3), ("\n", 4), (".", 5), ("!", 5), ("?", 5), (",", 6), ("|", 8)):
    _CLASS[ord(_c)] = _k
for _c in "#$%&*@^~_=+<>":
    _CLASS[ord(_c)] = 7
CLASSES = 12
STATS = CLASSES + 7


def class_counts(column: pa.Array) -> np.ndarray:
    """Bytes of each class in every text; long texts are counted in pieces."""
    data, offsets = texts_of(column)
    n = len(offsets) - 1
    out = np.zeros(n * CLASSES, np.int64)
    for at in range(int(offsets[0]), int(offsets[-1]), SPAN):
        end = min(at + SPAN, int(offsets[-1]))
        first, last = np.searchsorted(offsets, at, "right") - 1, np.searchsorted(offsets, end - 1, "right") - 1
        edges = np.clip(offsets[first : last + 2], at, end)
        key = np.repeat(np.arange(last - first + 1) * CLASSES, np.diff(edges)) + _CLASS[data[at:end]]
        out[first * CLASSES : (last + 1) * CLASSES] += np.bincount(key, minlength=(last - first + 1) * CLASSES)
    return out.reshape(n, CLASSES)


def features(column: pa.Array, n_chars: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For groups of texts: index of the first, word buckets, bounds of each text's, and statistics."""
    counts = class_counts(column)
    meta = n_chars.cast(pa.float64()).to_numpy(zero_copy_only=False)
    for first, hashes, bounds in word_hashes(column):
        n = len(bounds) - 1
        of = np.repeat(np.arange(n), np.diff(bounds))
        words, times, cuts = distinct_per_text(hashes % np.uint64(WORDS), of, n)
        c = counts[first : first + n].astype(np.float64)
        size = c.sum(axis=1)
        total, distinct = np.diff(bounds).astype(np.float64), np.diff(cuts).astype(np.float64)
        most = np.zeros(n)
        some = distinct > 0
        if some.any():
            most[some] = np.maximum.reduceat(times, cuts[:-1][some])
        lines = c[:, 4] + 1
        m = meta[first : first + n]
        known = ~np.isnan(m)
        stats = np.column_stack([
            c / np.maximum(size, 1)[:, None], np.log1p(size), size / np.maximum(total, 1), distinct / np.maximum(total, 1), most / np.maximum(total, 1),
            np.log1p(total / lines), c[:, 5] / np.maximum(total, 1), np.where(known, np.log1p(np.maximum(np.nan_to_num(m), 0)), -1.0),
        ])
        yield first, words.astype(np.int64), cuts, stats


@dataclass
class Model:
    bias: float
    words: np.ndarray  # WORDS x (1 + FACTORS): weight, factors
    stats: np.ndarray  # STATS x (1 + FACTORS), of standardised values
    bins: np.ndarray  # STATS x BINS x (1 + FACTORS)
    mean: np.ndarray
    scale: np.ndarray
    edges: np.ndarray  # STATS x (BINS - 1)

    def dense(self, stats: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        z = np.clip((stats - self.mean) / self.scale, -4, 4) / np.sqrt(STATS)
        return z, np.column_stack([np.searchsorted(self.edges[j], stats[:, j], "right") for j in range(STATS)])

    def sums(self, words: np.ndarray, cuts: np.ndarray, stats: np.ndarray) -> tuple[np.ndarray, ...]:
        """Sums of x v and of (x v)^2 for every text, and what they were made of."""
        n = len(cuts) - 1
        length = np.diff(cuts)
        x = (1 / np.sqrt(np.maximum(length, 1))).astype(np.float32)
        total, squares = np.zeros((n, 1 + FACTORS), np.float32), np.zeros((n, 1 + FACTORS), np.float32)
        some = length > 0
        if some.any():
            rows = self.words[words]
            total[some] = np.add.reduceat(rows, cuts[:-1][some], axis=0)
            squares[some] = np.add.reduceat(rows * rows, cuts[:-1][some], axis=0)
        total, squares = total * x[:, None], squares * (x * x)[:, None]
        z, b = self.dense(stats)
        one = 1 / np.sqrt(STATS)
        picked = self.bins[np.arange(STATS), b]
        total = total + z @ self.stats + picked.sum(axis=1) * one
        squares = squares + (z * z) @ (self.stats**2) + (picked**2).sum(axis=1) * one * one
        return total, squares, x, z, b

    def margin(self, total: np.ndarray, squares: np.ndarray) -> np.ndarray:
        """bias + sum w x + 1/2 sum_f ((sum v x)^2 - sum (v x)^2): all pairs in linear time."""
        return self.bias + total[:, 0] + 0.5 * (total[:, 1:] ** 2 - squares[:, 1:]).sum(axis=1)

    def score(self, words: np.ndarray, cuts: np.ndarray, stats: np.ndarray) -> np.ndarray:
        total, squares, *_ = self.sums(words, cuts, stats)
        return 1 / (1 + np.exp(-np.clip(self.margin(total, squares).astype(np.float64), -30, 30)))


def fit(words: list[np.ndarray], stats: np.ndarray, labels: np.ndarray, epochs: int = 12, batch: int = 128, rate: float = 0.05, decay: float = 2e-4, seed: int = 5) -> Model:
    """Minimise the logistic loss with Adagrad; one class alone gives a constant score."""
    rng = np.random.default_rng(seed)
    n = len(labels)
    mean, scale = stats.mean(axis=0), stats.std(axis=0)
    scale[scale < 1e-9] = 1.0
    edges = np.quantile(stats, np.linspace(0, 1, BINS + 1)[1:-1], axis=0).T
    rate0 = float(np.clip(labels.mean(), 0.01, 0.99))

    def start(*shape: int) -> np.ndarray:
        out = rng.normal(0, 0.05, (*shape, 1 + FACTORS)).astype(np.float32)
        out[..., 0] = 0
        return out

    m = Model(float(np.log(rate0 / (1 - rate0))), start(WORDS), start(STATS), start(STATS, BINS), mean, scale, edges)
    grown = [np.full(p.shape, 1e-4, np.float32) for p in (m.words, m.stats, m.bins)]

    def step(p: np.ndarray, g: np.ndarray, acc: np.ndarray, at=slice(None)) -> None:
        g = g + decay * p[at]
        acc[at] += g * g
        p[at] -= rate * g / np.sqrt(acc[at])

    one = 1 / np.sqrt(STATS)
    for _ in range(epochs):
        order = rng.permutation(n)
        for i in range(0, n, batch):
            rows = order[i : i + batch]
            idx = np.concatenate([words[r] for r in rows])
            cuts = np.concatenate([[0], np.cumsum([len(words[r]) for r in rows])])
            total, squares, x, z, b = m.sums(idx, cuts, stats[rows])
            p = 1 / (1 + np.exp(-np.clip(m.margin(total, squares), -30, 30)))
            g = ((p - labels[rows]) / len(rows)).astype(np.float32)
            # the weight's derivative is x, a factor's is x (sum - v x)
            of = np.repeat(np.arange(len(rows)), np.diff(cuts))
            slope = np.concatenate([np.ones((len(rows), 1), np.float32), total[:, 1:]], axis=1) * g[:, None]
            seen, back = np.unique(idx, return_inverse=True)
            xs = x[of]
            each = slope[of] * xs[:, None]
            each[:, 1:] -= m.words[idx][:, 1:] * (g[of] * xs * xs)[:, None]
            grad = np.column_stack([np.bincount(back, weights=each[:, c], minlength=len(seen)) for c in range(1 + FACTORS)]).astype(np.float32)
            step(m.words, grad, grown[0], seen)
            gs = z.T.astype(np.float32) @ slope
            gs[:, 1:] -= m.stats[:, 1:] * ((z * z).T @ g)[:, None]
            gb = np.zeros_like(m.bins)
            for j in range(STATS):
                e = slope * one
                e = e.copy()
                e[:, 1:] -= m.bins[j, b[:, j]][:, 1:] * (g * one * one)[:, None]
                np.add.at(gb[j], b[:, j], e)
            step(m.stats, gs.astype(np.float32), grown[1])
            step(m.bins, gb, grown[2])
            m.bias -= 0.1 * rate * float(g.sum())
    return m


def train(docs: DataFrame, labels: DataFrame, max_rows: int = TRAIN_ROWS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """Fit on at most ``max_rows`` labelled documents whose ids do not belong to the held-out third.

    The sample is the rows with the smallest hashes of their ids, so it is the
    same in every run.  Without labelled rows the model gives 0.5 to everything.
    """
    ship_code(docs.sparkSession)
    l = labels.filter(F.col(label_col).isNotNull() & ~held_out(F.col(id_col))).select(F.col(id_col).alias("l_id"), F.col(label_col).cast("double").alias("label"))
    l = l.orderBy(F.xxhash64("l_id"), "label").limit(max_rows)
    d = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), _n_chars(docs))
    got = d.join(F.broadcast(l), F.col("id") == F.col("l_id")).select("id", "text", "n_chars", "label").mapInArrow(_train_rows, "id string, label double, words binary, stats binary").toArrow()
    if not got.num_rows:
        zero = np.zeros
        return Model(0.0, zero((WORDS, 1 + FACTORS), np.float32), zero((STATS, 1 + FACTORS), np.float32), zero((STATS, BINS, 1 + FACTORS), np.float32), zero(STATS), np.ones(STATS), zero((STATS, BINS - 1)))
    got = got.sort_by([("id", "ascending"), ("stats", "ascending")])
    words = [np.frombuffer(x, np.int32).astype(np.int64) for x in got["words"].to_pylist()]
    stats = np.array([np.frombuffer(x, np.float64) for x in got["stats"].to_pylist()])
    return fit(words, stats, got["label"].to_numpy())


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _n_chars(docs: DataFrame):
    return (F.col("n_chars") if "n_chars" in docs.columns else F.lit(None)).cast("double").alias("n_chars")


def _train_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, words, cuts, stats in features(batch.column(1), batch.column(2)):
            n = len(cuts) - 1
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, n).cast(pa.string()), batch.column(3).slice(first, n), pa.array([words[a:b].astype(np.int32).tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary()), pa.array([s.tobytes() for s in stats], pa.binary())], ["id", "label", "words", "stats"])


def _score_rows(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            scores = np.zeros(batch.num_rows)
            for first, words, cuts, stats in features(batch.column(1), batch.column(2)):
                scores[first : first + len(cuts) - 1] = m.score(words, cuts, stats)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores), *(batch.column(i) for i in range(3, batch.num_columns))], ["id", "score", *batch.schema.names[3:]])

    return run


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """``id``, ``score`` (0 to 1, higher is better) and the columns ``carry`` for every row, from its whole text.

    Neither labels nor language, source or id take part in a score.  Null texts
    count as empty, which have statistics but no words; a null ``n_chars`` has a
    value of its own; repeated rows get equal scores; an empty table no rows.
    """
    d = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), _n_chars(docs), *[F.col(c).alias(f"c_{i}") for i, c in enumerate(carry)])
    ship_code(docs.sparkSession)
    kinds = dict(d.dtypes)
    schema = f"id {kinds['id']}, score double" + "".join(f", c_{i} {kinds[f'c_{i}']}" for i in range(len(carry)))
    out = d.mapInArrow(_score_rows(docs.sparkSession.sparkContext.broadcast(model)), schema)
    return out.withColumnsRenamed({f"c_{i}": c for i, c in enumerate(carry)})


def _keep_rows(model, text_at: int, chars_at: int, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            n = batch.num_rows
            chars = batch.column(chars_at) if chars_at >= 0 else pa.nulls(n, pa.float64())
            scores = np.zeros(n)
            for first, words, cuts, stats in features(batch.column(text_at), chars):
                scores[first : first + len(cuts) - 1] = m.score(words, cuts, stats)
            yield batch.filter(pa.array(scores >= threshold))

    return run


def good_documents(docs: DataFrame, model: Model, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` whose score is ``threshold`` or more, with all their columns."""
    ship_code(docs.sparkSession)
    chars = docs.columns.index("n_chars") if "n_chars" in docs.columns else -1
    return docs.mapInArrow(_keep_rows(docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col), chars, threshold), docs.schema)
