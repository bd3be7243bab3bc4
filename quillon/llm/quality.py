"""Quality rules: text statistics, and a linear-chain conditional random field over lines.

The field marks each line content or boilerplate; the share of a document's word
characters in content lines decides whether the document is kept.
"""

from __future__ import annotations

import logging
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import map_batches, shuffled, stored, utf8

log = logging.getLogger(__name__)

SYMBOLS = b"#*$%&|<>"
#: Bound of the training sample: so many labelled documents of either class, and of each at most so many
#: neighbouring lines (from a place that its id tells).
SAMPLE, SAMPLE_LINES = 400, 40
N_FEATURES = 12
_BYTES = np.arange(256)
_BLANK = np.isin(_BYTES, list(b" \t\n\x0b\x0c\r"))
#: Classes of bytes that are counted per line.
_CLASSES = np.stack(
    [
        ~_BLANK & ((_BYTES & 0xC0) != 0x80),  # code points in words
        np.isin(_BYTES, list(SYMBOLS)),
        (_BYTES >= 65) & (_BYTES <= 90),
        (_BYTES >= 97) & (_BYTES <= 122),
        (_BYTES >= 48) & (_BYTES <= 57),
        np.isin(_BYTES, list(b"!?")),
        np.isin(_BYTES, list(b".,;:")),
        np.isin(_BYTES, list(b"|")),
    ]
).astype(np.uint8)


def repeated_words(words: list[bytes], size: int = 5) -> int:
    """How many words stand in a window of `size` words that the text has twice or more."""
    if len(words) <= size:
        return 0
    windows = list(zip(*(words[i:] for i in range(size)), strict=False))
    counts = Counter(windows)
    if len(counts) == len(windows):
        return 0
    twice = np.fromiter((counts[w] > 1 for w in windows), bool, len(windows))
    return int((np.convolve(twice, np.ones(size, np.int64)) > 0).sum())


def repeated_lines(lines: list[bytes]) -> int:
    """Lines with a word that equal an earlier line."""
    if len(lines) == 1:
        return 0
    full = [x for x in lines if x.strip(b" \t\n\x0b\x0c\r")]
    return len(full) - len(set(full))


def line_features(text: bytes) -> np.ndarray:
    """A row of N_FEATURES for each line of the text; the first column is the line's word characters."""
    body = np.frombuffer(text + b"\n", np.uint8)
    ends = np.flatnonzero(body == 10) + 1
    starts = np.concatenate(([0], ends[:-1]))
    counts = np.stack([np.add.reduceat(c[body], starts, dtype=np.int64) for c in _CLASSES]).astype(np.float64)
    chars, symbols, upper, lower, digits, marks, stops, bars = counts
    lines = text.split(b"\n")
    words = np.empty(len(lines))
    again = np.empty(len(lines))
    kinds = np.empty(len(lines))
    for i, line in enumerate(lines):
        w = line.split()
        words[i] = len(w)
        again[i] = sum(map(bytes.__eq__, w, w[1:]))
        kinds[i] = len(set(w))
    n, c = np.maximum(words, 1), np.maximum(chars, 1)
    return np.stack(
        [
            chars, np.ones(len(lines)), symbols / n, upper / np.maximum(upper + lower, 1), marks / n, bars / n, again / n,
            kinds / n, digits / c, stops / n, np.minimum(chars / n, 30) / 10, np.log1p(words) / 5,
        ],
        axis=1,
    )


@dataclass(frozen=True)
class LineField:
    """Weights of the field: emission (features x 2) and transition (2 x 2); state 1 is content."""

    emission: np.ndarray
    transition: np.ndarray
    mean: np.ndarray
    scale: np.ndarray

    def scores(self, features: np.ndarray) -> np.ndarray:
        return ((features[:, 1:] - self.mean) / self.scale) @ self.emission

    def decode(self, docs: list[np.ndarray]) -> list[np.ndarray]:
        """Viterbi over many documents at once: the most probable states, ties to content.

        docs: each document's scores (lines x 2). Documents are sorted by length, so
        that step t works on those that have a line t.
        """
        order = sorted(range(len(docs)), key=lambda i: -len(docs[i]))
        length = np.array([len(docs[i]) for i in order])
        start = np.concatenate(([0], np.cumsum(length)))
        every = np.concatenate([docs[i] for i in order]) if docs else np.zeros((0, 2))
        back = np.zeros((len(every), 2), np.int8)
        best = every[start[:-1]].copy() if docs else every
        for t in range(1, int(length[0]) if docs else 0):
            m = int(np.searchsorted(-length, -t, "left"))  # documents with more than t lines
            via = best[:m, :, None] + self.transition[None]
            back[start[:m] + t] = from_one = (via[:, 1] >= via[:, 0]).astype(np.int8)
            best[:m] = np.where(from_one, via[:, 1], via[:, 0]) + every[start[:m] + t]
        states = np.zeros(len(every), np.int8)
        now = (best[:, 1] >= best[:, 0]).astype(np.int8) if docs else np.zeros(0, np.int8)
        for t in range(int(length[0]) - 1 if docs else -1, -1, -1):
            m = int(np.searchsorted(-length, -t, "left"))
            at = start[:m] + t
            states[at] = now[:m]
            now[:m] = back[at, now[:m]]
        out: list[np.ndarray] = [states] * len(docs)
        for k, i in enumerate(order):
            out[i] = states[start[k] : start[k + 1]]
        return out


def _gradients(emission, transition, x, y, mask, weight):
    """Gradient of the mean log-likelihood of padded sequences x (docs x lines x features)."""
    n, t_max, _ = x.shape
    e = x @ emission
    alpha, beta = np.zeros((n, t_max, 2)), np.zeros((n, t_max, 2))
    alpha[:, 0] = e[:, 0]
    for t in range(1, t_max):
        new = np.logaddexp(alpha[:, t - 1, 0, None] + transition[0], alpha[:, t - 1, 1, None] + transition[1]) + e[:, t]
        alpha[:, t] = np.where(mask[:, t, None], new, alpha[:, t - 1])
    for t in range(t_max - 2, -1, -1):
        z = beta[:, t + 1] + e[:, t + 1]
        new = np.logaddexp(transition[None, :, 0] + z[:, 0, None], transition[None, :, 1] + z[:, 1, None])
        beta[:, t] = np.where(mask[:, t + 1, None], new, beta[:, t])
    total = np.logaddexp(alpha[:, -1, 0], alpha[:, -1, 1])
    p = np.exp(alpha + beta - total[:, None, None]) * mask[:, :, None]
    hot = np.stack([y == 0, y == 1], axis=2) * mask[:, :, None]
    g_e = np.einsum("ntf,nts,n->fs", x, hot - p, weight)
    pair = np.exp(alpha[:, :-1, :, None] + transition + (e + beta)[:, 1:, None, :] - total[:, None, None, None])
    both = mask[:, 1:, None, None] * (hot[:, :-1, :, None] * hot[:, 1:, None, :] - pair)
    return g_e / n, np.einsum("ntab,n->ab", both, weight) / n


def fit(features: list[np.ndarray], good: np.ndarray, steps: int = 60, rounds: int = 2, ridge: float = 0.01) -> LineField:
    """Fit from labelled documents whose lines have no labels of their own.

    Lines start with their document's label. After each round, lines of a bad document
    that the field takes for content become content, but for the document's worst line.
    """
    flat = np.concatenate(features)[:, 1:]
    mean, scale = flat.mean(axis=0), flat.std(axis=0)
    mean[0], scale[0] = 0, 1
    scale[scale == 0] = 1
    t_max = max(map(len, features))
    x = np.zeros((len(features), t_max, flat.shape[1]))
    mask = np.zeros((len(features), t_max), bool)
    for i, f in enumerate(features):
        x[i, : len(f)] = (f[:, 1:] - mean) / scale
        mask[i, : len(f)] = True
    y = np.where(good[:, None], 1, 0) * np.ones((1, t_max), int)
    weight = np.where(good, 0.5 / max(good.mean(), 1e-9), 0.5 / max(1 - good.mean(), 1e-9)) / mask.sum(axis=1) * 4
    emission, transition = np.zeros((flat.shape[1], 2)), np.zeros((2, 2))
    for r in range(rounds):
        m = [np.zeros_like(emission), np.zeros_like(transition)]
        v = [np.zeros_like(emission), np.zeros_like(transition)]
        for k in range(1, steps + 1):
            grads = _gradients(emission, transition, x, y, mask, weight)
            for w, g, mm, vv in zip((emission, transition), grads, m, v, strict=True):
                g = g - ridge * w
                mm += 0.1 * (g - mm)
                vv += 0.01 * (g * g - vv)
                w += 0.1 * (mm / (1 - 0.9**k)) / (np.sqrt(vv / (1 - 0.99**k)) + 1e-8)
        if r + 1 < rounds:
            margin = (x @ emission) @ np.array([-1.0, 1.0])
            y = np.where(~good[:, None] & (margin > 0), 1, np.where(good[:, None], 1, 0))
            worst = np.where(mask, margin, np.inf).argmin(axis=1)
            y[np.flatnonzero(~good), worst[~good]] = 0
    return LineField(emission, transition, mean, scale)


#: Used where a table has no labels of both classes: all lines are content.
PLAIN = LineField(np.zeros((N_FEATURES - 1, 2)), np.zeros((2, 2)), np.zeros(N_FEATURES - 1), np.ones(N_FEATURES - 1))


def train(docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text", label_col="quality", sample=SAMPLE) -> LineField:
    """A field fitted on at most `sample` documents of either label, those with the least hashes.

    The sample is the only thing that comes to the driver, as line features; of a longer
    document SAMPLE_LINES neighbouring lines. Its size doesn't grow with the corpus. Labels
    without a document don't count. Where a class has no labelled document there is
    nothing to fit: a warning is logged, and every line is content.
    """
    known = labels.select(F.col(id_col).cast("bigint").alias("id"), F.col(label_col).cast("int").alias("good")).where(
        "id is not null and good in (0, 1)"
    )
    known = known.distinct().join(shuffled(docs.select(F.col(id_col).cast("bigint").alias("id"))), "id", "left_semi")
    order = (F.xxhash64("id", F.lit(2)), F.col("id"))
    picked = [known.where(F.col("good") == g).orderBy(*order).limit(sample) for g in (0, 1)]
    ids = F.broadcast(picked[0].unionByName(picked[1]))
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text")).join(ids, "id").select("id", "good", "text")

    def cut(doc: int, text: bytes) -> bytes:
        found = line_features(text)
        at = doc * 2654435761 % 2**32 * (len(found) - SAMPLE_LINES + 1) >> 32 if len(found) > SAMPLE_LINES else 0
        return found[at : at + SAMPLE_LINES].tobytes()

    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        features = [cut(i, x) for i, x in zip(b.column(0).to_pylist(), utf8(b.column(2)), strict=True)]
        return pa.record_batch([b.column(0), b.column(1), pa.array(features, pa.binary())], names=["id", "good", "features"])

    found = stored(map_batches(rows, batch, "id bigint, good int, features binary"), "sample")
    data = [x for g in (0, 1) for x in found.where(F.col("good") == g).orderBy(*order, F.md5("features")).limit(sample).collect()]
    good = np.array([x.good == 1 for x in data], bool)
    if good.all() or not good.any():
        log.warning("no labelled documents of both classes: every line counts as content")
        return PLAIN
    return fit([np.frombuffer(x.features).reshape(-1, N_FEATURES) for x in data], good)


SCHEMA = (
    "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint,"
    " n_lines bigint, content_lines bigint, content_share double, base_failed boolean, kept boolean"
)
_SYMBOL = re.compile(rb"[#*$%&|<>]")


def judge(texts: list[bytes], field: LineField, least: float) -> dict[str, list]:
    """The columns of SCHEMA for whole texts (None: no words)."""
    features = [line_features(x) for x in texts]
    states = field.decode([field.scores(f) for f in features])
    out: dict[str, list] = {k.split()[0]: [] for k in SCHEMA.split(", ")}
    for text, f, s in zip(texts, features, states, strict=True):
        words = text.split()
        n, again, chars = len(words), repeated_words(words), int(f[:, 0].sum())
        share = float((f[:, 0] * s).sum()) / chars if chars else 0.0
        failed = n < 10 or 100 * again > 20 * n
        row = (n, chars, len(_SYMBOL.findall(text)), repeated_lines(text.split(b"\n")), again, len(f), int(s.sum()), share, failed, not failed and share >= least)
        for k, x in zip(out, row, strict=True):
            out[k].append(x)
    return out


def quality(
    docs: DataFrame, field: LineField, text_col: str = "text", least_content: float = 0.5, carry: list[str] | None = None
) -> DataFrame:
    """docs (or its columns carry) with a struct column quality (SCHEMA) added, in place of one of that name; rows stay as they are, repeated ones too.

    A null text has no words and fails. Texts without a line feed are one line.
    """
    carry = [c for c in (docs.columns if carry is None else carry) if c.lower() != "quality"]
    # a carried text goes to the workers once, inside its row
    at = carry.index(text_col) if text_col in carry and dict(docs.dtypes)[text_col] == "string" else None
    text = [] if at is not None else [F.col(text_col).cast("string").alias("text")]
    packed = docs.select(F.struct(*carry).alias("row"), *text)

    def batch(b: pa.RecordBatch) -> pa.Table | None:
        texts = utf8(b.column(0).field(at) if at is not None else b.column(1))
        cols = judge(texts, field, least_content)
        if not texts:
            return None
        found = pa.StructArray.from_arrays([pa.array(v) for v in cols.values()], list(cols))
        return pa.table({"row": b.column(0), "quality": found})

    schema = packed.select("row").schema.add("quality", StructType.fromDDL(SCHEMA))
    return map_batches(packed, batch, schema).select("row.*", "quality")
