"""Toxicity by compression distance: a window is compressed once with a dictionary trained on ordinary text and once with
that dictionary followed by one trained on toxic text; what the second saves is its distance.

The toxic dictionary is trained on those stretches of toxic words whose byte runs many toxic and few ordinary documents
have, as all else in toxic documents is ordinary language. The ordinary dictionary is followed by as many bytes that match
nothing, so that both have its content at the same distance and only toxic content makes a difference. A document's score
is a calibrated function of the savings of its windows, fitted on labelled rows that trained no dictionary.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, spread, text_of
from .gam import _map_texts, key_crc, one_text, training_rows

#: Labelled rows of each kind that a model learns from at most.
TOXIC_ROWS, ORDINARY_ROWS = 2_000, 3_000
#: Bytes in a window, and how many it shares with the next, so that a cut splits no short word in both.
WINDOW, OVERLAP = 96, 14
#: A run of so many bytes marks toxic words if so large a share of toxic documents has it, and so many times the share of
#: ordinary ones.
RUNS, LEAST_SHARE, LEAST_LIFT = (5, 7), 0.03, 5.0
ORDINARY_BYTES = 8192
#: Bytes of the trained toxic dictionary, and bytes of the commonest stretches that follow it, for what training left out;
#: the pair that parts the calibration rows best is kept.
SHAPES = ((512, 0), (512, 512), (512, 1024), (512, 3072))
#: Saved bytes from which a window counts as a hit, for three of the document's features.
HITS = (3, 4, 5)
#: A false alarm weighs as so many misses when the threshold is set.
FALSE_ALARM = 3.0
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_PARAMETERS = dict(strategy=zstandard.STRATEGY_LAZY2, min_match=4, window_log=17, hash_log=15, chain_log=15, search_log=5, write_checksum=0, write_content_size=0, write_dict_id=0)


def plain(text: str) -> bytes:
    return b" " + b" ".join(text.lower().encode().split()) + b" "


def windows(text: str) -> list[bytes]:
    """Windows of the whole text, in lower case with single spaces; at least one."""
    whole = plain(text)
    return [whole[i : i + WINDOW] for i in range(0, max(1, len(whole) - OVERLAP), WINDOW - OVERLAP)]


def compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    parameters = zstandard.ZstdCompressionParameters.from_level(3, **_PARAMETERS)
    loaded = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    loaded.precompute_compress(compression_params=parameters)
    return zstandard.ZstdCompressor(dict_data=loaded, compression_params=parameters)


def _runs(word: bytes) -> set[tuple[int, int]]:
    """(start, end) of the byte runs of a word, spaces around it included, that may mark it as toxic."""
    return {(i, i + n) for n in RUNS for i in range(len(word) - n + 1)}


def _words(text: str) -> set[bytes]:
    return {f" {w} ".encode() for w in _WORD.findall(text.lower())}


def toxic_stretches(toxic: list[str], ordinary: list[str]) -> Counter[bytes]:
    """Stretches of words that set toxic documents apart, with the number of toxic documents that have them."""
    in_toxic, in_ordinary = Counter(), Counter()
    for texts, count in ((toxic, in_toxic), (ordinary, in_ordinary)):
        for t in texts:
            count.update({w[a:b] for w in _words(t) for a, b in _runs(w)})
    least = max(3, LEAST_SHARE * len(toxic))
    lifted = lambda r, n: n / len(toxic) >= LEAST_LIFT * (in_ordinary[r] + 1) / (len(ordinary) + 1)
    marked = {r for r, n in in_toxic.items() if n >= least and lifted(r, n)}

    def stretches(word: bytes) -> set[bytes]:
        inside = sorted((a, b) for a, b in _runs(word) if word[a:b] in marked)
        out, start, end = set(), None, 0
        for a, b in inside:
            if start is not None and a > end:
                out.add(word[start:end])
                start = None
            start, end = (a if start is None else start), max(end, b)
        return out | {word[start:end]} if start is not None else out

    found: Counter[bytes] = Counter()
    for t in toxic:
        found.update({s for w in _words(t) for s in stretches(w)})
    return found


def _train(size: int, samples: list[bytes], **shape) -> bytes:
    """A zstandard dictionary; where zstandard finds the samples too few to train one, the last of them."""
    try:
        return zstandard.train_dictionary(size, samples, **shape).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def _commonest(stretches: Counter[bytes], size: int) -> bytes:
    """The commonest stretches that are in none before them, the commonest last, where matches cost least."""
    out = b""
    for stretch, _ in sorted(stretches.items(), key=lambda s: (-s[1], s[0])):
        if stretch not in out and len(out) + len(stretch) <= size:
            out = stretch + out
    return out


@dataclass
class ToxicityModel:
    ordinary: bytes = b""
    toxic: bytes = b""
    weights: np.ndarray | None = None
    center: np.ndarray = field(default_factory=lambda: np.zeros(0))
    scale: np.ndarray = field(default_factory=lambda: np.ones(0))
    constant: float = 0.0

    def compressors(self) -> tuple:
        noise = np.random.Generator(np.random.PCG64(5)).integers(128, 256, len(self.toxic), dtype=np.uint8).tobytes()
        return compressor(self.ordinary + noise).compress, compressor(self.ordinary + self.toxic).compress

    def features(self, texts: list[str]) -> np.ndarray:
        """Per text: the largest saving, the mean of the three largest, hits of each size, log of windows, mean, share of hits."""
        ordinary, toxic = self.compressors()
        out = np.empty((len(texts), len(HITS) + 5))
        for row, text in enumerate(texts):
            parts = windows(text)
            saved = np.array([len(ordinary(w)) - len(toxic(w)) for w in parts])
            top = np.sort(saved)[:-4:-1]
            out[row] = (top[0], top.mean(), *((saved >= h).sum() for h in HITS), np.log1p(len(saved)), saved.mean(), (saved >= HITS[1]).mean())
        return out

    def scores(self, texts: list[str]) -> np.ndarray:
        if self.weights is None:
            return np.full(len(texts), self.constant)
        x = (self.features(texts) - self.center) / self.scale
        return 1 / (1 + np.exp(-np.clip(np.c_[np.ones(len(x)), x] @ self.weights, -30, 30)))

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> float:
        """Fit the score to (x, y) so that 0.5 is the best threshold; returns how well it parts them, misses against alarms."""
        self.center, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-9
        z = np.c_[np.ones(len(x)), (x - self.center) / self.scale]
        w = np.zeros(z.shape[1])
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            w += np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + 1e-2 * np.eye(len(w)), z.T @ (y - p) - 1e-2 * w)
        logit = z @ w
        cuts = np.unique(logit)
        cuts = (cuts[1:] + cuts[:-1]) / 2 if len(cuts) > 1 else cuts
        gain = [(logit[y == 1] >= c).mean() - FALSE_ALARM * (logit[y == 0] >= c).mean() for c in cuts]
        best = int(np.argmax(gain))
        w[0] -= cuts[best]
        self.weights = w
        return float(gain[best])

    @classmethod
    def learn(cls, toxic: list[str], ordinary: list[str]) -> ToxicityModel:
        """Two of three rows of either kind train the dictionaries, the third calibrates. Too few rows give one score for all."""
        share = (len(toxic) + 0.5) / (len(toxic) + len(ordinary) + 1)
        if len(toxic) < 6 or len(ordinary) < 6:
            return cls(constant=min(share, 0.49))
        learned = lambda texts: [t for i, t in enumerate(texts) if i % 3]
        ordinary_bytes = _train(ORDINARY_BYTES, [w for t in learned(ordinary) for w in windows(t)])
        stretches = toxic_stretches(learned(toxic), learned(ordinary))
        samples = [s for s, n in sorted(stretches.items()) for _ in range(n)]
        check, y = toxic[::3] + ordinary[::3], np.array([1.0] * len(toxic[::3]) + [0.0] * len(ordinary[::3]))
        best, found = -np.inf, None
        for size, more in SHAPES:
            model = cls(ordinary_bytes, _train(size, samples, k=16, d=6) + _commonest(stretches, more))
            gain = model.calibrate(model.features(check), y)
            if gain > best:
                best, found = gain, model
        return found


def learn_toxicity(docs: DataFrame, labels: DataFrame, modulus: int = 5, held: int = 0) -> ToxicityModel:
    """A model of labels.toxic from at most TOXIC_ROWS + ORDINARY_ROWS rows whose crc32(doc_id) mod modulus is not held.

    Labels are drawn by the least hash, and each takes one document, of which all windows are used. Labels that are null or
    neither 0 nor 1, and those of null keys or without a document, are not used; null texts count as empty. With fewer than
    six rows of either kind the score is one number for all texts.
    """
    usable = key_crc("doc_id") % modulus != held
    kinds = [training_rows(labels, "toxic", usable & (F.col("toxic") == value), rows) for value, rows in ((1, TOXIC_ROWS), (0, ORDINARY_ROWS))]
    sample = kinds[0].unionByName(kinds[1])
    got = one_text(docs, sample, "toxic").toPandas()
    # In an order of their own, as rows arrive in any.
    texts = {value: sorted(got["text"][got["toxic"] == value], key=lambda t: (zlib.crc32(t.encode()), t)) for value in (0, 1)}
    return ToxicityModel.learn(texts[1], texts[0])


def score_toxicity(docs: DataFrame, model: ToxicityModel, columns: list[str] | None = None, text: str = "text") -> DataFrame:
    """columns (default doc_id) and score, from 0 to 1, for every row of docs; 0.5 is the calibrated threshold.

    Null text counts as empty; an empty text is one window and saves nothing. Equal texts get equal scores. Repeated rows
    give repeated results, an empty table none; other columns of docs are not read.
    """
    made = lambda t: ([pa.array(model.scores(t.to_pylist()), pa.float64())], ["score"])
    return _map_texts(docs, columns or ["doc_id"], text, "score double", made)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = learn_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_toxicity(spread(docs), model).select(
        "doc_id", (key_crc("doc_id") % 5 == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
