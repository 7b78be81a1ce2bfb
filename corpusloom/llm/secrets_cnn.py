"""Secret scan: patterns, and a character convolutional network over candidates and their surroundings."""

from __future__ import annotations

import hashlib
import re
import string
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.session import ship_code

from .wordhash import SPAN, texts_of

KINDS = ("assign", "access", "hex", "cnn")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")
#: What the network looks at besides base findings: unbroken runs with a digit and a letter.
MIN_RUN = 20
_RUN = re.compile(rf"[A-Za-z0-9+/_=-]{{{MIN_RUN},}}")
_MIXED = re.compile(r"(?=.*[0-9])(?=.*[A-Za-z])")

CONTEXT = 24
WINDOW = 160
STEP = 96
EMBED, FILTERS, WIDTH, HIDDEN = 8, 24, 5, 16
#: Documents whose prose surrounds the labelled findings that the network is trained on, at most.
TRAIN_DOCS = 300
MIN_RECALL = 0.98

_RUN_BYTE, _HEX_BYTE, _MARK = (np.zeros(256, bool) for _ in range(3))
_RUN_BYTE[[*map(ord, string.ascii_letters + string.digits + "+/_=-")]] = True
_HEX_BYTE[[*map(ord, "0123456789abcdef")]] = True
_MARK[[ord(":"), ord("=")]] = True


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Spans of the patterns, leftmost and not overlapping per kind, by start and then kind."""
    found = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return [(s, e, KINDS[k]) for s, k, e in sorted(found)]


def candidates(text: str, base: list[tuple[int, int, str]]) -> list[tuple[int, int]]:
    """Runs that the patterns have not found."""
    out = []
    for m in _RUN.finditer(text):
        if _MIXED.match(m[0]) and not any(s < m.end() and m.start() < e for s, e, _ in base):
            out.append(m.span())
    return out


def windows(text: str, start: int, end: int) -> list[np.ndarray]:
    """Characters of a candidate and its surroundings: codes (2 rows: character, inside); long ones give several."""
    lo, hi = max(0, start - CONTEXT), min(len(text), end + CONTEXT)
    codes = np.frombuffer(text[lo:hi].encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = np.where(codes < 127, codes, 127).astype(np.int64)
    inside = np.zeros(len(codes), np.int64)
    inside[start - lo : end - lo] = 1
    both = np.stack([codes, inside])
    if both.shape[1] <= WINDOW:
        return [both]
    return [both[:, i : i + WINDOW] for i in range(0, both.shape[1] - (WINDOW - STEP), STEP)]


def _padded(items: list[np.ndarray]) -> np.ndarray:
    out = np.zeros((len(items), 2, WINDOW), np.int64)  # NUL pads
    for i, x in enumerate(items):
        out[i, :, : x.shape[1]] = x
    return out


@dataclass
class Network:
    embed: np.ndarray  # 128 x EMBED
    conv: np.ndarray  # (WIDTH * (EMBED + 1)) x FILTERS
    conv_bias: np.ndarray
    hidden: np.ndarray  # 2 FILTERS x HIDDEN
    hidden_bias: np.ndarray
    out: np.ndarray  # HIDDEN
    out_bias: np.ndarray
    slope: float = 1.0  # calibration: probability = sigmoid(slope * logit + shift)
    shift: float = 0.0
    threshold: float = 0.5

    def parameters(self) -> list[np.ndarray]:
        return [self.embed, self.conv, self.conv_bias, self.hidden, self.hidden_bias, self.out, self.out_bias]

    def forward(self, x: np.ndarray) -> tuple[np.ndarray, tuple]:
        codes, inside = x[:, 0], x[:, 1]
        e = np.concatenate([self.embed[codes], inside[..., None].astype(np.float32)], axis=2)
        n, length, d = e.shape
        cols = np.lib.stride_tricks.sliding_window_view(e, WIDTH, axis=1).transpose(0, 1, 3, 2).reshape(n, length - WIDTH + 1, WIDTH * d)
        a = np.maximum(cols @ self.conv + self.conv_bias, 0)
        mid = inside[:, WIDTH // 2 : length - WIDTH // 2, None]
        own, around = a * mid, a * (1 - mid)  # the largest answer inside the candidate, and outside
        i_own, i_around = own.argmax(axis=1), around.argmax(axis=1)
        pooled = np.concatenate([np.take_along_axis(own, i_own[:, None], 1)[:, 0], np.take_along_axis(around, i_around[:, None], 1)[:, 0]], axis=1)
        h = np.maximum(pooled @ self.hidden + self.hidden_bias, 0)
        return h @ self.out + self.out_bias[0], (codes, cols, pooled, i_own, i_around, h)

    def probability(self, items: list[np.ndarray], batch: int = 256) -> np.ndarray:
        parts = [self.forward(_padded(items[i : i + batch]))[0] for i in range(0, len(items), batch)]
        logits = np.concatenate(parts) if parts else np.zeros(0)
        return 1 / (1 + np.exp(-np.clip(self.slope * logits + self.shift, -30, 30)))


def _gradients(net: Network, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
    logit, (codes, cols, pooled, i_own, i_around, h) = net.forward(x)
    n = len(y)
    g = ((1 / (1 + np.exp(-np.clip(logit, -30, 30)))) - y).astype(np.float32) / n
    gh = np.outer(g, net.out) * (h > 0)
    gp = (gh @ net.hidden.T) * (pooled > 0)
    rows = np.arange(n)[:, None]
    g_conv, g_cols = np.zeros_like(net.conv), np.zeros_like(cols)
    for at, gk in ((i_own, gp[:, :FILTERS]), (i_around, gp[:, FILTERS:])):
        picked = cols[rows, at]  # n x FILTERS x fan-in
        g_conv += np.einsum("nfi,nf->if", picked, gk)
        np.add.at(g_cols, (rows, at), gk[..., None] * net.conv.T[None])
    d = EMBED + 1
    ge = g_cols.reshape(n, -1, WIDTH, d)[..., :EMBED]
    g_embed = np.zeros_like(net.embed)
    for w in range(WIDTH):
        part = ge[:, :, w].reshape(-1, EMBED)
        live = np.flatnonzero(part.any(axis=1))
        np.add.at(g_embed, codes[:, w : w + ge.shape[1]].reshape(-1)[live], part[live])
    return [g_embed, g_conv, gp[:, :FILTERS].sum(0) + gp[:, FILTERS:].sum(0), pooled.T @ gh, gh.sum(0), h.T @ g, np.array([g.sum()], np.float32)]


def fit(items: list[np.ndarray], labels: np.ndarray, epochs: int = 8, batch: int = 64, rate: float = 4e-3, seed: int = 3, min_recall: float = MIN_RECALL) -> Network:
    """Adam on four fifths; the rest calibrates (Platt) and sets the highest threshold whose recall is ``min_recall``."""
    rng = np.random.default_rng(seed)

    def start(*shape: int) -> np.ndarray:
        return rng.normal(0, np.sqrt(2 / shape[0]), shape).astype(np.float32)

    net = Network(rng.normal(0, 0.3, (128, EMBED)).astype(np.float32), start(WIDTH * (EMBED + 1), FILTERS), np.zeros(FILTERS, np.float32), start(2 * FILTERS, HIDDEN), np.zeros(HIDDEN, np.float32), start(HIDDEN), np.zeros(1, np.float32))
    order = rng.permutation(len(items))
    hold, use = order[: len(items) // 5], order[len(items) // 5 :]
    x, y = _padded(items), labels.astype(np.float32)
    one, two, t = [np.zeros_like(p) for p in net.parameters()], [np.zeros_like(p) for p in net.parameters()], 0
    for _ in range(epochs):
        rng.shuffle(use)
        for i in range(0, len(use), batch):
            t += 1
            for p, g, a, b in zip(net.parameters(), _gradients(net, x[use[i : i + batch]], y[use[i : i + batch]]), one, two, strict=True):
                a[...] = 0.9 * a + 0.1 * g
                b[...] = 0.999 * b + 0.001 * g * g
                p -= rate * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.999**t)) + 1e-8)
    logit, target = net.forward(x[hold])[0].astype(np.float64), y[hold]
    slope, shift = 1.0, 0.0
    for _ in range(300):  # Platt: logistic regression on the logit, with a pull to slope 1
        p = 1 / (1 + np.exp(-np.clip(slope * logit + shift, -30, 30)))
        slope -= 0.05 * (((p - target) * logit).mean() + 0.01 * (slope - 1))
        shift -= 0.05 * ((p - target).mean() + 0.01 * shift)
    net.slope, net.shift = float(slope), float(shift)
    p = np.sort(1 / (1 + np.exp(-np.clip(slope * logit[target == 1] + shift, -30, 30))))
    if len(p):
        net.threshold = float(max(0.5, p[int(np.floor((1 - min_recall) * len(p)))]))  # never below even odds
        if (p >= net.threshold).mean() < min_recall:
            net.threshold = float(p[int(np.floor((1 - min_recall) * len(p)))])
    return net


def labelled_findings(prose: list[str], n: int = 2400, seed: int = 11, findings: int = 20, vocabulary: int = 4000) -> tuple[list[np.ndarray], np.ndarray]:
    """Findings with labels: base findings of ``prose`` (1; of each text at most ``findings``, by their first window), and ``n`` made-up secrets (1) and look-alikes (0) put into it, of at most ``vocabulary`` of its words."""
    rng = np.random.default_rng(seed)
    items, labels = [], []
    for text in prose:
        for s, e, _ in base_spans(text)[:findings]:
            items.append(windows(text, s, e)[0])
            labels.append(1)
    pool = [t for t in prose if len(t) >= 80] or ["the quick brown fox jumps over the lazy dog and runs on through the wood until night falls "]
    words = [w for t in pool for w in t.split() if w.isascii() and w.isalpha()][:vocabulary] or ["word"]

    def draw(alphabet: str, low: int, high: int) -> str:
        return "".join(rng.choice(list(alphabet), rng.integers(low, high + 1)))

    word = lambda: str(words[rng.integers(len(words))])
    alnum, hexa = string.ascii_letters + string.digits, "0123456789abcdef"
    secret = [
        lambda: "ghp_" + draw(alnum, 36, 36), lambda: "sk_live_" + draw(alnum, 24, 32), lambda: "xoxb-" + draw(string.digits, 10, 12) + "-" + draw(alnum, 24, 24),
        lambda: "AIza" + draw(alnum + "_-", 35, 35), lambda: "eyJ" + draw(alnum, 20, 40) + "." + draw(alnum, 20, 40), lambda: draw(alnum + "+/", 40, 40), lambda: draw(alnum, 24, 64), lambda: draw(hexa, 32, 64), lambda: draw(alnum + "+/", 30, 60) + "==",
    ]
    benign = [
        lambda: "-".join(word().lower() for _ in range(4)) + "-" + draw(string.digits, 1, 4), lambda: "/".join([word().lower() for _ in range(4)] + [draw(string.digits, 2, 6)]), lambda: "_".join(word() for _ in range(4)) + draw(string.digits, 1, 3),
        lambda: "20" + draw(string.digits, 2, 2) + "-10-12T" + draw(string.digits, 6, 10), lambda: "".join(word().capitalize() for _ in range(4)) + draw(string.digits, 1, 2), lambda: draw("-=_", 20, 60) + draw(string.digits, 1, 2), lambda: draw(string.digits, 20, 30), lambda: "".join(word() for _ in range(4)) + draw(string.digits, 1, 2),
        lambda: word() + "=" + word() + "=" + draw(string.digits, 8, 20),
    ]
    lead = ["", "", "", "key: ", "export KEY=", 'auth "', "bearer "]
    for i in range(n):
        text = pool[rng.integers(len(pool))]
        at = text.find(" ", int(rng.integers(0, max(1, len(text) - 40)))) + 1
        if i % 3 == 2:  # as it stands: a stretch of prose
            made, before = text[at : at + int(rng.integers(20, 40))], ""
        else:
            made = (secret if i % 3 == 0 else benign)[int(rng.integers(len(secret) if i % 3 == 0 else len(benign)))]()
            before = lead[int(rng.integers(len(lead)))] if i % 3 == 0 or rng.random() < 0.5 else ""
        if not made:
            continue
        left, right = text[max(0, at - CONTEXT) : at] + before, " " + text[at : at + CONTEXT]
        items.append(windows(left + made + right, len(left), len(left) + len(made))[0])
        labels.append(int(i % 3 == 0))
    return items, np.array(labels)


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_docs: int = TRAIN_DOCS, max_chars: int = 4000) -> Network:
    """Train on findings in (and put into) the prose of ``max_docs`` documents, those with the smallest id hashes.

    Training alone is bounded, also by ``max_chars`` of each of these texts (from a
    place that the id's hash gives), which the driver holds; scanning reads all of every text.
    """
    d = docs.filter(F.col(text_col).isNotNull()).select(F.xxhash64(id_col).alias("h"), F.col(id_col).alias("id"))
    few = d.orderBy("h", "id").limit(max_docs)
    start = F.pmod(F.xxhash64("id"), F.greatest(F.lit(1), F.length("text") - max_chars + 1)).cast("int") + 1
    piece = F.substring("text", start, F.lit(max_chars))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(few.select("id").distinct()), "id").select("id", piece.alias("text")).orderBy("id", "text").limit(max_docs).collect()
    items, labels = labelled_findings([r["text"] for r in texts])
    return fit(items, labels)


def _flags(column: pa.Array) -> np.ndarray:
    """Texts that can hold a finding of any kind: an exact test on bytes, without looking at most texts twice."""
    data, offsets = texts_of(column)
    flags = np.zeros(len(column), bool)
    for at in range(int(offsets[0]), int(offsets[-1]), SPAN):
        lo, end = max(int(offsets[0]), at - MIN_RUN), min(at + SPAN, int(offsets[-1]))
        part = data[lo:end]
        hits = [np.flatnonzero(_MARK[part])]
        edge = np.diff(_RUN_BYTE[part].view(np.int8), prepend=0, append=0)
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        long = ends - starts >= 16  # access keys have 16 characters at least; a run over two texts costs a look, no finding
        hits += [starts[long], ends[long] - 1]
        where = np.concatenate(hits) + lo
        flags[np.searchsorted(offsets, where, "right") - 1] = True
        for s, e in zip(starts[long] + lo, ends[long] + lo, strict=True):  # a run may lie in several neighbouring texts
            flags[np.searchsorted(offsets, s, "right") - 1 : np.searchsorted(offsets, e - 1, "right")] = True
    return flags


def _joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


def scan_text(text: str, net: Network) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]], int]:
    """Base spans, those that the network adds, and how many base spans it would not have found."""
    base = base_spans(text)
    runs = [(s, e) for s, e, _ in base] + candidates(text, base)
    if not runs:
        return base, [], 0
    parts = [windows(text, s, e) for s, e in runs]
    p = net.probability([w for ws in parts for w in ws])
    cuts = np.cumsum([0, *map(len, parts)])
    sure = [bool(p[a:b].max() >= net.threshold) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    more = [(s, e, "cnn") for (s, e), ok in zip(runs[len(base) :], sure[len(base) :], strict=True) if ok]
    return base, more, sure[: len(base)].count(False)


def _scan(net):
    nothing = hashlib.sha256(b"").hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = net.value
        for batch in batches:
            n = batch.num_rows
            counts = np.zeros((5, n), np.int64)
            digest, spans = [nothing] * n, [""] * n
            for i in np.flatnonzero(_flags(batch.column(1))):
                base, more, counts[4, i] = scan_text(batch.column(1)[int(i)].as_py() or "", model)
                for _, _, k in base + more:
                    counts[KINDS.index(k), i] += 1
                if base:
                    digest[i] = hashlib.sha256(_joined(base).encode()).hexdigest()
                spans[i] = _joined(sorted(base + more, key=lambda x: (x[0], KINDS.index(x[2]), x[1])))
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, counts), pa.array(digest, pa.string()), pa.array(spans, pa.string())], ["id", "n_assign", "n_access", "n_hex", "n_cnn", "n_doubted", "base_sha256", "spans"])

    return run


def find_secrets(docs: DataFrame, net: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Secrets in every whole text: counts by kind, a digest of the base spans, and all spans.

    ``n_doubted`` counts base spans that the network alone would not have reported.

    Spans are ``kind:start:end`` in code points, ends exclusive.  Base findings
    (assignments, access keys, long hexadecimal numbers) stay whatever the network
    says; it judges them and every other unbroken run of 20 or more characters with letters
    and digits, together with 24 characters on either side, and adds those of
    the others at or above its threshold as ``cnn``.

    Null and empty texts have no spans; repeated rows repeat; a run of any length
    is judged whole, in overlapping windows; an empty table gives no rows.
    """
    ship_code(docs.sparkSession)
    d = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    out = d.mapInArrow(_scan(docs.sparkSession.sparkContext.broadcast(net)), f"id {dict(d.dtypes)['id']}, n_assign long, n_access long, n_hex long, n_cnn long, n_doubted long, base_sha256 string, spans string")
    return out.withColumnRenamed("id", id_col)
