"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, lean, slices, texts_of
from .sample import fitted, held_out, labelled

_EDGE = b".,;:!?\"'()[]{}*#$%&|<>=-_"
_NAMES = ("upper", "lower", "digit", "blank", "line", "bar", "symbol", "bang", "point", "other")


def _kinds() -> np.ndarray:
    kind = np.full(256, 9, np.uint8)
    for i, chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b" \t\r\x0b\x0c", b"\n", b"|", b"$%&*#@^~<>{}[]\\/=+_`", b"!", b".,;:?'\"()-")):
        kind[np.frombuffer(chars, np.uint8)] = i
    return kind


class _Buckets(dict):
    """Word to hash bucket: lower case, without punctuation at its edges. Emptied when full."""

    def __init__(self, bits: int, full: int = 150_000):
        super().__init__()
        self.bits, self.full = bits, full

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.full:
            self.clear()
        b = self[word] = xxhash.xxh3_64_intdigest(word.lower().strip(_EDGE) or word) >> (64 - self.bits)
        return b


def features(texts: list[bytes], n_chars: list, bits: int, buckets: _Buckets) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row of each word feature, its bucket, its value, dense statistics by row); values of a row have norm 1."""
    kind, n = _kinds(), len(texts)
    counts = np.zeros((n, 10))
    words_of, lines, repeated, distinct = [], np.zeros(n), np.zeros(n), np.zeros(n)
    for i, t in enumerate(texts):
        if t:
            counts[i] = np.bincount(kind[np.frombuffer(t, np.uint8)], minlength=10)
        w = t.split()
        words_of.append(w)
        own = [x for x in t.split(b"\n") if x.strip()]
        lines[i], repeated[i] = len(own), len(own) - len(set(own))
        distinct[i] = len(set(w))
    size = np.array([len(w) for w in words_of], np.int64)
    total = int(size.sum())
    codes = np.fromiter((buckets[x] for w in words_of for x in w), np.int64, count=total)
    owner = np.repeat(np.arange(n), size)
    echo = np.bincount(owner[1:][(codes[1:] == codes[:-1]) & (owner[1:] == owner[:-1])], minlength=n) if total else np.zeros(n)
    key, c = np.unique(owner << bits | codes, return_counts=True)
    row, bucket, value = key >> bits, key & ((1 << bits) - 1), np.log1p(c.astype(float))
    norm = np.sqrt(np.bincount(row, value * value, minlength=n))
    value = value / norm[row]
    chars = counts.sum(1)
    per = counts / np.maximum(chars, 1)[:, None]
    letters = np.maximum(counts[:, 0] + counts[:, 1] + counts[:, 9], 1)
    said = np.array([len(t) if x is None else float(x) for x, t in zip(n_chars, texts, strict=True)])
    dense = np.column_stack([
        per, np.sqrt(per[:, 5:9]), counts[:, 0] / letters, np.log1p(chars), np.log1p(size), np.log1p(np.maximum(said, 0)),
        chars / np.maximum(size, 1) / 10, distinct / np.maximum(size, 1), echo / np.maximum(size, 1), np.sqrt(echo / np.maximum(size, 1)), repeated / np.maximum(lines, 1), np.log1p(size / np.maximum(lines, 1)), chars == 0,
    ])
    return row, bucket, value, dense


class FactorisationMachine:
    """w0 + sum w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j, in time linear in the non-zero x.

    The pair sum is half of sum_f [(sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2].
    """

    def __init__(self, words: int, dense: int, rank: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        n = words + dense
        self.words, self.w0, self.w, self.v = words, 0.0, np.zeros(n), rng.normal(0, 0.05, (n, rank))
        self.mean, self.scale = np.zeros(dense), np.ones(dense)

    def _dense(self, dense: np.ndarray) -> np.ndarray:
        return np.clip((dense - self.mean) / self.scale, -4, 4) / 4

    def _sums(self, row, bucket, value, z):
        n, r = len(z), self.v.shape[1]
        vd = self.v[self.words :]
        s, q, lin = z @ vd, (z * z) @ (vd * vd), z @ self.w[self.words :]
        if len(row):
            starts = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
            own = row[starts]
            x = self.v[bucket] * value[:, None]
            s[own] += np.add.reduceat(x, starts)
            q[own] += np.add.reduceat(x * x, starts)
            lin[own] += np.add.reduceat(self.w[bucket] * value, starts)
        assert s.shape == (n, r)
        return s, q, lin

    def raw(self, row, bucket, value, dense) -> np.ndarray:
        s, q, lin = self._sums(row, bucket, value, self._dense(dense))
        return self.w0 + lin + 0.5 * (s * s - q).sum(1)

    def score(self, row, bucket, value, dense) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(row, bucket, value, dense), -30, 30)))

    def fit(self, row, bucket, value, dense, y, epochs: int = 12, size: int = 128, rate: float = 0.08, decay: float = 2e-4, seed: int = 11) -> FactorisationMachine:
        """Logistic loss by Adagrad over mini-batches. row ascends."""
        self.mean, self.scale = dense.mean(0), np.maximum(dense.std(0), 1e-6)
        z_all, n = self._dense(dense), len(y)
        first = np.searchsorted(row, np.arange(n + 1))
        gw, gv, g0 = np.full(self.w.shape, 1e-2), np.full(self.v.shape, 1e-2), 1e-2
        rate_y = np.clip(y.mean() if n else 0.5, 0.02, 0.98)
        self.w0 = float(np.log(rate_y / (1 - rate_y)))
        rng = np.random.default_rng(seed)
        for _ in range(epochs if n else 0):
            order = rng.permutation(n)
            for at in range(0, n, size):
                own = np.sort(order[at : at + size])
                take = np.concatenate([np.arange(first[i], first[i + 1]) for i in own])
                r = np.repeat(np.arange(len(own)), first[own + 1] - first[own])
                b, x, z = bucket[take], value[take], z_all[own]
                s, q, lin = self._sums(r, b, x, z)
                p = 1 / (1 + np.exp(-np.clip(self.w0 + lin + 0.5 * (s * s - q).sum(1), -30, 30)))
                err = (p - y[own]) / len(own)
                used = np.unique(b)
                place = np.searchsorted(used, b)
                e = err[r] * x
                dw = np.bincount(place, e, minlength=len(used)) + decay * self.w[used]
                xe = e[:, None] * s[r] - (err[r] * x * x)[:, None] * self.v[b]
                dv = np.column_stack([np.bincount(place, xe[:, f], minlength=len(used)) for f in range(xe.shape[1])]) if len(b) else np.zeros((0, self.v.shape[1]))
                dv += decay * self.v[used]
                gw[used] += dw * dw
                gv[used] += dv * dv
                self.w[used] -= rate * dw / np.sqrt(gw[used])
                self.v[used] -= rate * dv / np.sqrt(gv[used])
                d = slice(self.words, None)
                dw = err @ z + decay * self.w[d]
                dv = z.T @ (err[:, None] * s) - (err @ (z * z))[:, None] * self.v[d] + decay * self.v[d]
                gw[d] += dw * dw
                gv[d] += dv * dv
                self.w[d] -= rate * dw / np.sqrt(gw[d])
                self.v[d] -= rate * dv / np.sqrt(gv[d])
                g = err.sum()
                g0 += g * g
                self.w0 -= rate * g / np.sqrt(g0)
        return self


_FEATURES = "doc_id long, y int, bucket array<int>, value array<float>, dense array<double>"
_SCORES = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64())])


def _featurise(bits: int):
    schema = pa.schema([("doc_id", pa.int64()), ("y", pa.int32()), ("bucket", pa.list_(pa.int32())), ("value", pa.list_(pa.float32())), ("dense", pa.list_(pa.float64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = _Buckets(bits)
        for b in batches:
            texts, said = texts_of(b.column(2)), b.column(3).to_pylist()
            for i, j in slices(texts, 800_000):
                row, bucket, value, dense = features(texts[i:j], said[i:j], bits, buckets)
                at = np.searchsorted(row, np.arange(j - i + 1))
                yield batch(schema, [b.column(0).slice(i, j - i), b.column(1).slice(i, j - i), [bucket[at[k] : at[k + 1]] for k in range(j - i)], [value[at[k] : at[k + 1]] for k in range(j - i)], list(dense)])

    return run


def fit_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = 6000, bits: int = 13, rank: int = 8) -> FactorisationMachine:
    """A machine fitted on at most `most` labelled documents; without labelled documents it scores 0.5."""
    sample = labelled(docs, labels, label, most).select("doc_id", "y", "text", F.length("text").cast("long").alias("said"))
    width = features([b""], [0], bits, _Buckets(bits))[3].shape[1]

    def fit(rows: pa.Table) -> dict[str, np.ndarray]:
        list_of = lambda c: rows.column(c).combine_chunks()
        size = np.diff(list_of("bucket").offsets.to_numpy())
        flat = lambda c: list_of(c).flatten().to_numpy().astype(float)
        machine = FactorisationMachine(1 << bits, width, rank)
        machine.fit(np.repeat(np.arange(len(size)), size), flat("bucket").astype(np.int64), flat("value"), flat("dense").reshape(-1, width), rows.column("y").to_numpy().astype(float))
        return {"w0": np.array(machine.w0)} | {k: getattr(machine, k) for k in ("w", "v", "mean", "scale")}

    machine = FactorisationMachine(1 << bits, width, rank)
    learnt = fitted(sample.mapInArrow(lean(_featurise(bits)), _FEATURES), fit)
    for k, x in (learnt or {}).items():
        setattr(machine, k, float(x) if k == "w0" else x)
    return machine


def _score(machine: FactorisationMachine, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = _Buckets(bits)
        for b in batches:
            texts, said = texts_of(b.column(2)), b.column(3).to_pylist()
            for i, j in slices(texts, 800_000):
                scores = machine.score(*features(texts[i:j], said[i:j], bits, buckets))
                yield batch(_SCORES, [b.column(0).slice(i, j - i), b.column(1).slice(i, j - i), scores])

    return run


def quality_scores(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = 6000, bits: int = 13, rank: int = 8, threshold: float = 0.5) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of docs; see fit_quality for what is learnt.

    Inputs of a score are the words (hashed to 2^bits buckets), shares of character kinds, line and word
    statistics, and the text's length as metadata; never label, lang, source or id. Null texts count as empty, which get the score that
    their statistics give; a null id is returned as it is; repeated rows are scored alike; other columns are ignored.
    """
    machine = fit_quality(docs, labels, label, most, bits, rank)
    ids = F.col("doc_id").cast("long")
    said = F.length("text").cast("long")
    rows = docs.select(ids.alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text", said.alias("said"))
    scored = rows.mapInArrow(lean(_score(machine, bits)), "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_quality(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """Rows of docs that the classifier accepts, with their own columns; a row's decision is its own text's."""
    options = {"label": "quality", "most": 6000, "bits": 13, "rank": 8, "threshold": 0.5} | options
    machine = fit_quality(docs, labels, options["label"], options["most"], options["bits"], options["rank"])
    names, bits, threshold = docs.columns, options["bits"], options["threshold"]
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = _Buckets(bits)
        for b in batches:
            texts = texts_of(b.column(at))
            said = [None if t is None else len(t) for t in b.column(at).to_pylist()]
            keep = np.concatenate([machine.score(*features(texts[i:j], said[i:j], bits, buckets)) for i, j in slices(texts, 800_000)] or [np.zeros(0)]) >= threshold
            yield b.filter(pa.array(keep))

    return docs.mapInArrow(lean(run), docs.schema)
