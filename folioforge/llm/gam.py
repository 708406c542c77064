"""Generalised additive model with pairwise interactions, learned by cyclic boosting of shallow trees over bins.

Each feature is cut into bins; trees of at most four leaves on one feature at a time are added to that feature's lookup
table, feature after feature, round after round, so that no feature takes what another explains better. Then the pairs
whose joint bins explain most of what is left get tables of their own. A score is the sum of one look-up a table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import documents, extend, spread, text_of
from .kernel import STEP, blocks, shingle_hashes, tidied, utf8, word_hashes, words

BLOCK = 1 << 20
#: Labelled rows that a model learns from at most: those of the least hash of their key.
TRAINING_ROWS = 20_000
MAX_BINS, PAIR_BINS, PAIRS = 32, 8, 4
ROUNDS, PAIR_ROUNDS, RATE, SHRINK = 150, 60, 0.15, 2.0

FEATURES = (
    "log_words", "mean_word_bytes", "symbols_per_word", "upper_share", "bangs_per_word", "distinct_word_share",
    "repeated_neighbour_share", "distinct_window_share", "digit_share", "lines_per_word", "other_script_share", "stops_per_word",
)


def _lut(characters: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(characters)] = True
    return table


_CLASSES = {
    "symbol": _lut(b"#*$%&|<>"),
    "upper": _lut(bytes(range(65, 91))),
    "letter": _lut(bytes([*range(65, 91), *range(97, 123)])),
    "bang": _lut(b"!"),
    "digit": _lut(b"0123456789"),
    "line": _lut(b"\n"),
    "other": _lut(bytes(range(128, 256))),
    "stop": _lut(b"."),
}


def _counts(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> np.ndarray:
    """How many bytes of each row are in a class. Sums are held for STEP bytes at once, however long a text is."""
    at, total = np.zeros(len(offsets), np.int64), 0
    for lo in range(0, len(data), STEP):
        sums = np.cumsum(table[data[lo : lo + STEP]], dtype=np.int64)
        inside = (offsets > lo) & (offsets <= lo + len(sums))
        at[inside] = total + sums[offsets[inside] - lo - 1]
        total += int(sums[-1])
    return np.diff(at)


def text_features(texts: pa.Array) -> np.ndarray:
    """FEATURES of each text, one row a text; 0 where a share has no whole."""
    data, offsets = utf8(texts)
    starts, ends, first = words(data, offsets)
    hashes = word_hashes(data, starts, ends)
    windows = shingle_hashes(hashes)
    count = {name: _counts(data, offsets, table) for name, table in _CLASSES.items()}
    n_bytes, n_words = np.diff(offsets), np.diff(first)
    width = np.concatenate([[0], np.cumsum(ends - starts)])
    same = np.concatenate([[0], np.cumsum(np.append(hashes[1:] == hashes[:-1], False))]) if len(hashes) else np.zeros(1, np.int64)
    own = np.array([len(np.unique(hashes[a:b])) for a, b in zip(first[:-1], first[1:], strict=True)], np.int64)
    runs = np.array([len(np.unique(windows[a : b - 4])) if b - a >= 5 else 0 for a, b in zip(first[:-1], first[1:], strict=True)], np.int64)
    share = lambda part, whole: np.divide(part, whole, out=np.zeros(len(part)), where=whole > 0)
    inner = np.maximum(first[1:] - 1, first[:-1])
    columns = [
        np.log1p(n_words),
        share(width[first[1:]] - width[first[:-1]], n_words),
        share(count["symbol"], n_words),
        share(count["upper"], count["letter"]),
        share(count["bang"], n_words),
        share(own, n_words),
        share(same[inner] - same[first[:-1]], n_words),
        share(runs, np.maximum(n_words - 4, 0)),
        share(count["digit"], n_bytes),
        share(count["line"], n_words),
        share(count["other"], n_bytes),
        share(count["stop"], n_words),
    ]
    return np.stack([np.asarray(c, np.float64) for c in columns], axis=1)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _best_cut(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
    """(gain, last bin on the left) of the cut of ordered bins that lowers the loss most."""
    if len(g) < 2:
        return 0.0, -1
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gr, hr = g.sum() - gl, h.sum() - hl
    gain = gl**2 / (hl + SHRINK) + gr**2 / (hr + SHRINK) - g.sum() ** 2 / (h.sum() + SHRINK)
    at = int(gain.argmax())
    return float(gain[at]), at


def _shallow_tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Values of the bins in a tree of at most four leaves."""
    leaves = [(0, len(g))]
    for _ in range(2):
        split = []
        for a, b in leaves:
            gain, at = _best_cut(g[a:b], h[a:b])
            split += [(a, a + at + 1), (a + at + 1, b)] if gain > 1e-9 else [(a, b)]
        leaves = split
    out = np.zeros(len(g))
    for a, b in leaves:
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + SHRINK)
    return out


def _quadrants(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """(gain, values of the joint bins) of one cut on the first axis and one on the second below each side of it."""
    best, values = 0.0, np.zeros_like(g)
    for axis in (0, 1):
        gg, hh = (g, h) if axis == 0 else (g.T, h.T)
        _, at = _best_cut(gg.sum(axis=1), hh.sum(axis=1))
        if at < 0:
            continue
        gain, made = 0.0, np.zeros_like(gg)
        for rows in (slice(0, at + 1), slice(at + 1, len(gg))):
            side_g, side_h = gg[rows].sum(axis=0), hh[rows].sum(axis=0)
            _, cut = _best_cut(side_g, side_h)
            for part in (slice(0, cut + 1), slice(cut + 1, len(side_g))):
                a, b = side_g[part].sum(), side_h[part].sum()
                gain += a**2 / (b + SHRINK)
                made[rows, part] = a / (b + SHRINK)
        if gain > best:
            best, values = gain, made if axis == 0 else made.T
    return best, values


@dataclass
class AdditiveModel:
    base: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pair_edges: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    @classmethod
    def learn(cls, x: np.ndarray, y: np.ndarray) -> AdditiveModel:
        """x: rows by features; y: 0 or 1. Without rows, or with one label only, every score is the smoothed share of 1."""
        share = (y.sum() + 0.5) / (len(y) + 1)
        model = cls(base=float(np.log(share / (1 - share))))
        if len(y) == 0 or y.min() == y.max():
            return model
        cuts = lambda c, n: np.unique(np.quantile(c, np.linspace(0, 1, n + 1)[1:-1]))
        model.edges = [cuts(c, MAX_BINS) for c in x.T]
        model.pair_edges = [cuts(c, PAIR_BINS) for c in x.T]
        bins = [np.searchsorted(e, c, side="right") for e, c in zip(model.edges, x.T, strict=True)]
        model.tables = [np.zeros(len(e) + 1) for e in model.edges]
        logit = np.full(len(y), model.base)
        for _ in range(ROUNDS):
            for b, table in zip(bins, model.tables, strict=True):
                p = _sigmoid(logit)
                step = RATE * _shallow_tree(np.bincount(b, y - p, len(table)), np.bincount(b, p * (1 - p), len(table)))
                table += step
                logit += step[b]
        model._learn_pairs(x, y, logit)
        return model

    def _learn_pairs(self, x: np.ndarray, y: np.ndarray, logit: np.ndarray) -> None:
        coarse = [np.searchsorted(e, c, side="right") for e, c in zip(self.pair_edges, x.T, strict=True)]
        sizes = [len(e) + 1 for e in self.pair_edges]
        joint = {(i, j): coarse[i] * sizes[j] + coarse[j] for i, j in combinations(range(len(coarse)), 2)}

        def tree(i: int, j: int) -> tuple[float, np.ndarray]:
            p, shape = _sigmoid(logit), (sizes[i], sizes[j])
            g, h = (np.bincount(joint[i, j], v, shape[0] * shape[1]).reshape(shape) for v in (y - p, p * (1 - p)))
            return _quadrants(g, h)

        ranked = sorted(joint, key=lambda ij: -tree(*ij)[0])[:PAIRS]
        self.pairs = [(i, j, np.zeros((sizes[i], sizes[j]))) for i, j in ranked]
        for _ in range(PAIR_ROUNDS):
            for i, j, table in self.pairs:
                step = RATE * tree(i, j)[1]
                table += step
                logit += step.ravel()[joint[i, j]]

    def scores(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for e, table, c in zip(self.edges, self.tables, x.T, strict=False):
            total += table[np.searchsorted(e, c, side="right")]
        for i, j, table in self.pairs:
            total += table[tuple(np.searchsorted(self.pair_edges[k], x[:, k], side="right") for k in (i, j))]
        return _sigmoid(total)


def key_crc(key: str) -> Column:
    """crc32 of the key as text; null keys count as the empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary"))


def training_rows(labels: DataFrame, label: str, usable: Column, rows: int = TRAINING_ROWS, key: str = "doc_id") -> DataFrame:
    """(key, label) of at most rows usable labels, those of the least hash; small enough to broadcast."""
    picked = labels.filter(usable & F.col(label).isin(0, 1)).select(key, label)
    return picked.orderBy(F.xxhash64(key), label).limit(rows)


def one_text(docs: DataFrame, sample: DataFrame, label: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(text, label) of each row of a small sample; of documents that share a key, the one whose text has the least hash."""
    found = docs.select(F.col(key), text_of(text).alias("text")).join(F.broadcast(sample.distinct()), key)
    return found.groupBy(key, label).agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("text", label)


def _map_texts(docs: DataFrame, columns: list[str], text: str, ddl: str, made) -> DataFrame:
    """columns of docs and what made(texts) returns as Arrow arrays.

    text names a column, or a field of a struct among columns as in row.text; such a text is not sent twice.
    """
    outer, _, inner = text.partition(".")
    inside = bool(inner) and outer in columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pc.fill_null(pc.struct_field(batch.column(columns.index(outer)), inner), "") if inside else batch.column(len(columns))
            for part in blocks(pa.record_batch([*batch.columns[: len(columns)], texts], names=[*columns, "__text"]), len(columns), BLOCK):
                arrays, names = made(part.column(len(columns)))
                yield pa.record_batch([*part.columns[:-1], *arrays], names=[*columns, *names])

    # As a schema: in DDL, names of fields inside a struct would have to be plain words.
    kept = T.StructType([T.StructField(c, docs.schema[c].dataType) for c in columns])
    sent = docs.select(*columns) if inside else docs.select(*columns, text_of(text).alias("__text"))
    return sent.mapInArrow(tidied(run), extend(kept, ddl))


def learn_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", modulus: int = 4, held: int = 2, rows: int = TRAINING_ROWS) -> AdditiveModel:
    """A model of labels.quality from rows whose crc32(doc_id) mod modulus is not held; only text features go in.

    At most rows labels are drawn, those of the least hash, and each takes one document. Labels that are null or neither 0
    nor 1, and those of null keys or without a document, are not used; null texts count as empty. A document with two
    labels is learned once for each. Without labels, or with one value only, the score is one number for all texts.
    """
    sample = training_rows(labels, label, key_crc("doc_id") % modulus != held, rows)
    labelled = one_text(docs, sample, label)
    made = lambda t: ([pa.array(list(text_features(t)), pa.list_(pa.float64()))], ["x"])
    got = _map_texts(labelled, [label], "text", "x array<double>", made).toPandas()
    # Sorted, as rows arrive in any order and sums of floats depend on it.
    x = np.array(got["x"].tolist(), np.float64).reshape(-1, len(FEATURES))
    y = got[label].to_numpy(np.float64)
    order = np.lexsort((*x.T, y))
    return AdditiveModel.learn(x[order], y[order])


def score_quality(docs: DataFrame, model: AdditiveModel, columns: list[str] | None = None, text: str = "text") -> DataFrame:
    """columns (default doc_id) and score, from 0 to 1, for every row of docs.

    Null text counts as empty; an empty text has features of 0 and is scored like any other. Equal texts get equal
    scores. Repeated rows give repeated results, an empty table none; other columns of docs are not read.
    """
    made = lambda t: ([pa.array(model.scores(text_features(t)), pa.float64())], ["score"])
    return _map_texts(docs, columns or ["doc_id"], text, "score double", made)


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = learn_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_quality(spread(docs), model).select(
        "doc_id", (key_crc("doc_id") % 4 == 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted")
    )
