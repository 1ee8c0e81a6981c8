"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

score(x) = sigmoid(w0 + sum_i w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2)):
the pairwise interactions of all features in time linear in the features a text has.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .labelled import labelled_sample
from .shared import flat_bytes, hash_spans, slices, small_batches, with_fields, word_spans

WORDS, BINS, FACTORS = 1 << 15, 12, 8
#: Edges of the bins of each structure statistic; a statistic's bin is one feature.
EDGES = {
    "log2_words": np.arange(1, 12, dtype=float),
    "upper": np.array([0, 0.02, 0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.85]),
    "digits": np.array([0, 0.005, 0.01, 0.02, 0.05, 0.1, 0.2, 0.3, 0.5, 0.7, 0.9]),
    "symbols": np.array([0, 0.01, 0.02, 0.03, 0.05, 0.08, 0.12, 0.2, 0.3, 0.5, 0.7]),
    "stops": np.array([0, 0.005, 0.01, 0.02, 0.03, 0.05, 0.08, 0.12, 0.2, 0.3, 0.5]),
    "word_length": np.array([1, 2, 3, 4, 5, 6, 7, 8, 10, 14, 20], float),
    "distinct": np.array([0.02, 0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]),
    "line_words": np.array([1, 2, 4, 7, 12, 20, 35, 60, 100, 200, 500], float),
}
MOST_METADATA = 8
SIZE = WORDS + BINS * (len(EDGES) + MOST_METADATA)
_CLASS = {k: np.zeros(256, np.int64) for k in ("upper", "digits", "symbols", "stops", "letters", "lines")}
_CLASS["upper"][65:91] = _CLASS["digits"][48:58] = _CLASS["lines"][10] = 1
_CLASS["letters"][65:91] = _CLASS["letters"][97:123] = _CLASS["letters"][128:] = 1
_CLASS["symbols"][[i for i in range(33, 127) if not chr(i).isalnum() and chr(i) not in ".,;:'\"?-()"]] = 1
_CLASS["stops"][[ord(c) for c in ".?!;"]] = 1


def features(texts: pa.Array, metadata: list[np.ndarray] = ()) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, feature and value of every feature of the texts, in order of rows.

    Words count as the root of their share of the text, so that their squares sum to 1; of each
    statistic, and of each metadata column by a hash of its value, one bin has the value 1.
    """
    raw, offsets = flat_bytes(texts, lower=False)
    rows = len(offsets) - 1
    starts, lens = word_spans(raw)
    low, _ = flat_bytes(texts)
    doc = np.searchsorted(offsets, starts, "right") - 1
    n = np.bincount(doc, minlength=rows)
    key = hash_spans(low, starts, lens) % np.uint64(WORDS)
    both, counts = np.unique(doc * WORDS + key.astype(np.int64), return_counts=True)
    row, word = both // WORDS, both % WORDS
    sums = {k: np.diff(np.concatenate(([0], np.cumsum(t[raw])))[offsets]) for k, t in _CLASS.items()}
    size = np.maximum(1, np.bincount(doc, lens, rows))
    some = np.maximum(1, n)
    stats = {
        "log2_words": np.log2(some), "upper": sums["upper"] / np.maximum(1, sums["letters"]), "digits": sums["digits"] / size,
        "symbols": sums["symbols"] / size, "stops": sums["stops"] / size, "word_length": size / some,
        "distinct": np.bincount(row, minlength=rows) / some, "line_words": n / np.maximum(1, sums["lines"]),
    }
    bins = [WORDS + BINS * i + np.searchsorted(EDGES[k], stats[k], "right") for i, k in enumerate(EDGES)]
    bins += [WORDS + BINS * (len(EDGES) + i % MOST_METADATA) + m % BINS for i, m in enumerate(metadata)]
    own = np.arange(rows)
    r = np.concatenate([row, *[own] * len(bins)])
    f = np.concatenate([word, *bins]).astype(np.int64)
    v = np.concatenate([np.sqrt(counts / n[row]), *[np.ones(rows)] * len(bins)])
    order = np.argsort(r, kind="stable")
    return r[order], f[order], v[order]


class FactorisationMachine:
    def __init__(self, w0: float = 0.0, w: np.ndarray | None = None, v: np.ndarray | None = None):
        self.w0, self.w, self.v = w0, w, v

    def margin(self, row: np.ndarray, feature: np.ndarray, value: np.ndarray, rows: int) -> np.ndarray:
        """Scores before the sigmoid; row must be sorted and hold each of the rows."""
        if not rows:
            return np.zeros(0)
        first = np.searchsorted(row, np.arange(rows))
        s, q = self._sums(feature, value, first)
        return self.w0 + np.add.reduceat(self.w[feature] * value, first) + 0.5 * (s * s - q).sum(1)

    def _sums(self, feature, value, first):
        x = self.v[feature] * value[:, None]
        return np.add.reduceat(x, first), np.add.reduceat(x * x, first)

    def fit(self, row, feature, value, y, epochs: int = 12, batch: int = 256, rate: float = 0.05, l2: float = 1e-4, seed: int = 11) -> FactorisationMachine:
        """Logistic loss by AdaGrad over shuffled batches; classes weigh alike."""
        rng = np.random.default_rng(seed)
        self.w, self.v = np.zeros(SIZE), rng.normal(0, 0.02, (SIZE, FACTORS))
        gw, gv, g0 = np.full(SIZE, 1e-2), np.full((SIZE, FACTORS), 1e-2), 1e-2
        weight = np.where(y > 0.5, 0.5 / max(1e-9, y.mean()), 0.5 / max(1e-9, 1 - y.mean()))
        ends = np.searchsorted(row, np.arange(len(y) + 1))
        for _ in range(epochs):
            for pick in np.array_split(rng.permutation(len(y)), max(1, len(y) // batch)):
                at = np.concatenate([np.arange(ends[i], ends[i + 1]) for i in pick])
                size = ends[pick + 1] - ends[pick]
                first, of = np.concatenate(([0], np.cumsum(size)[:-1])), np.repeat(np.arange(len(pick)), size)
                f, x = feature[at], value[at]
                s, q = self._sums(f, x, first)
                z = self.w0 + np.add.reduceat(self.w[f] * x, first) + 0.5 * (s * s - q).sum(1)
                g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[pick]) * weight[pick] / len(pick)
                dw = np.bincount(f, g[of] * x, SIZE)
                seen = np.unique(f)
                each = g[of][:, None] * x[:, None] * (s[of] - self.v[f] * x[:, None])
                dv = np.stack([np.bincount(f, each[:, k], SIZE)[seen] for k in range(FACTORS)], 1)
                dw, dv = dw[seen] + l2 * self.w[seen], dv + l2 * self.v[seen]
                gw[seen] += dw * dw
                gv[seen] += dv * dv
                g0 += g.sum() ** 2
                self.w[seen] -= rate * dw / np.sqrt(gw[seen])
                self.v[seen] -= rate * dv / np.sqrt(gv[seen])
                self.w0 -= rate * g.sum() / np.sqrt(g0)
        self.w, self.v = self.w.astype(np.float32), self.v.astype(np.float32)
        return self


def _metadata(batch: pa.RecordBatch, columns: list[str]) -> list[np.ndarray]:
    """Bins of metadata: numbers by the logarithm of their size (null: the last bin), other values by a hash."""
    out = []
    for c in columns:
        x = batch.column(c)
        if pa.types.is_integer(x.type) or pa.types.is_floating(x.type):
            v = np.nan_to_num(x.cast(pa.float64()).to_numpy(zero_copy_only=False), nan=-1.0)
            out.append(np.where(v < 0, BINS - 1, np.minimum(BINS - 2, np.log2(1 + np.maximum(v, 0)) * 0.7)).astype(np.int64))
        else:
            out.append(pd.util.hash_array(np.array([f"{c}={v}" for v in x.to_pylist()], object)).astype(np.int64) & 0xFFFF)
    return out


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", allowed: Column | None = None, per_class: int = 3000, metadata: list[str] = ()) -> FactorisationMachine | float:
    """A machine fitted on a bounded sample of labelled rows (about per_class of each class, by a hash of doc_id).

    With fewer than two classes there is nothing to tell apart: the share of label 1 (0.5 with no
    labels) is returned instead and becomes everyone's score.
    """
    small_batches(docs.sparkSession)
    sample = labelled_sample(docs, labels, label, F.lit(True) if allowed is None else allowed, per_class, metadata=metadata)

    def run(batches):
        for b in batches:
            for part in slices(b):
                r, f, v = features(part.column("text"), _metadata(part, metadata))
                ends = np.searchsorted(r, np.arange(part.num_rows + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), part.column("y"), pa.ListArray.from_arrays(ends, pa.array(f.astype(np.int32))), pa.ListArray.from_arrays(ends, pa.array(v.astype(np.float32)))], ["doc_id", "y", "f", "v"])

    got = sample.mapInArrow(run, "doc_id long, y double, f array<int>, v array<float>").toPandas().sort_values("doc_id", kind="stable")
    y = got["y"].to_numpy(float)
    if not 0 < y.sum() < len(y):
        return float(y.mean()) if len(y) else 0.5
    size = got["f"].map(len).to_numpy()
    return FactorisationMachine().fit(np.repeat(np.arange(len(y)), size), np.concatenate(list(got["f"])).astype(np.int64), np.concatenate(list(got["v"])).astype(float), y)


def score(docs: DataFrame, model: FactorisationMachine | float, metadata: list[str] = ()) -> DataFrame:
    """docs with a column quality_score (0 to 1, higher: label 1 likelier), for every row and its whole text.

    Null and empty texts are scored by their statistics, very long ones as a whole, repeated rows alike. A
    column of the same name is replaced, all others pass through; an empty table gives none.
    """
    small_batches(docs.sparkSession)
    spark, rest = docs.sparkSession, docs.drop("quality_score")
    held = spark.sparkContext.broadcast(model)  # of fixed size: SIZE * (FACTORS + 1) numbers
    schema = with_fields(rest, quality_score="double")

    def run(batches):
        m = held.value
        for b in batches:
            for part in slices(b):
                if isinstance(m, float):
                    s = np.full(part.num_rows, m)
                else:
                    s = 1 / (1 + np.exp(-np.clip(m.margin(*features(part.column("text"), _metadata(part, metadata)), part.num_rows), -30, 30)))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(s.astype(float))], [*part.schema.names, "quality_score"])

    return rest.mapInArrow(run, schema)
