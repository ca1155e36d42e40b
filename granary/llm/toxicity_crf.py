"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, lean, slices, texts_of
from .sample import fitted, held_out, labelled

_EDGE = b".,;:!?\"'()[]{}*#$%&|<>=-_/\\~^+"
_TOKEN = re.compile(rb"[^\x20\x09-\x0D]+")


def parts(word: bytes) -> list[int]:
    """Hashes of a token's features: the token without case and punctuation, its prefixes and its last letters."""
    try:
        w = word.decode().lower().strip(_EDGE.decode())
    except UnicodeDecodeError:
        w = word.decode(errors="replace").lower()
    if not w:
        return []
    names = ["=" + w] + [f"{n}<" + w[:n] for n in (3, 4, 5, 6, 7, 8) if len(w) > n] + (["4>" + w[-4:]] if len(w) > 4 else [])
    return [xxhash.xxh3_64_intdigest(x) for x in names]


class Parts(dict):
    """Token to features, emptied when full."""

    def __init__(self, f=parts, full: int = 300_000):
        super().__init__()
        self.f, self.full = f, full

    def __missing__(self, word: bytes):
        if len(self) >= self.full:
            self.clear()
        x = self[word] = self.f(word)
        return x


def token_labels(docs: list[list[bytes]], y: np.ndarray, seen: Parts, least: int = 5, strength: float = 0.85) -> dict[int, float]:
    """Features that mark a token as toxic: in `least` toxic documents at least, and seldom in others.

    Labels are of documents; a token's own label is 1 if its document is toxic and one of
    its features is in the returned table (its precision, smoothed), and 0 otherwise.
    """
    bad, good = Counter(), Counter()
    for words, label in zip(docs, y, strict=True):
        own = {f for w in set(words) for f in seen[w]}
        (bad if label else good).update(own)
    n_bad, n_good = max(1, int(y.sum())), max(1, int(len(y) - y.sum()))
    out = {}
    for f, c in bad.items():
        rate, other = c / n_bad, (good[f] + 0.5) / n_good
        precision = rate / (rate + other * 1.0)
        if c >= least and precision >= strength and c > 2 * good[f]:
            out[f] = precision
    return out


def chain(node: np.ndarray, first: np.ndarray, edge: np.ndarray, start: np.ndarray, lanes: int = 1024) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marginals of label 1 of a two-label chain, by forward-backward over many sequences at once.

    node: log-potential of label 1 for each token (label 0 has 0); first: True where a sequence begins;
    edge: log-potentials of label pairs, start: of first labels. The tokens are cut into lanes of equal length.
    Products of the lanes' 2 x 2 matrices give what enters each lane, exactly; a sequence's beginning is a
    matrix whose rows are equal, so nothing crosses it. Returns the marginals, the forward messages (before the first
    token of each sequence: see fit) and log Z of the whole.
    """
    n = len(node)
    k = max(1, -(-n // lanes))
    lanes = -(-n // k)
    pad = lanes * k - n
    e = np.exp(np.clip(np.concatenate((node, np.zeros(pad))), -30, 30)).reshape(lanes, k)
    f = np.concatenate((first, np.ones(pad, bool))).reshape(lanes, k)
    T, s = np.exp(edge), np.exp(start)
    a = np.where(f[..., None, None], s[None, None, None, :], T[None, None])  # [lane, step, from, to]
    a[..., 1] *= e[..., None]
    m = np.broadcast_to(np.eye(2), (lanes, 2, 2)).copy()
    for t in range(k):
        m = m @ a[:, t]
        m /= m.sum((1, 2))[:, None, None]
    enter, leave = np.empty((lanes, 2)), np.empty((lanes, 2))
    v = np.array([0.5, 0.5])
    for i in range(lanes):
        enter[i] = v
        v = v @ m[i]
        v /= v.sum()
    v = np.array([0.5, 0.5])
    for i in range(lanes - 1, -1, -1):
        leave[i] = v
        v = m[i] @ v
        v /= v.sum()
    fwd, bwd, logz = np.empty((lanes, k, 2)), np.empty((lanes, k, 2)), 0.0
    v = enter
    for t in range(k):
        v = np.einsum("li,lij->lj", v, a[:, t])
        z = v.sum(1)
        v = v / z[:, None]
        fwd[:, t] = v
        logz += np.log(z).sum()
    v = leave
    for t in range(k - 1, -1, -1):
        bwd[:, t] = v
        v = np.einsum("lij,lj->li", a[:, t], v)
        v = v / v.sum(1)[:, None]
    p = fwd * bwd
    p /= p.sum(2, keepdims=True)
    return p[..., 1].reshape(-1)[:n], np.stack((fwd.reshape(-1, 2)[:n], bwd.reshape(-1, 2)[:n])), logz


class Tagger:
    """Weights of the field and of the document score; bits: hashed feature space."""

    def __init__(self, bits: int = 16):
        self.bits, self.w, self.edge, self.start = bits, np.zeros(1 << bits), np.zeros((2, 2)), np.array([0.0, -4.0])
        self.edge[:, 1], self.doc, self.bias = -4.0, np.array([2.0, 2.0, 0.0]), -3.0

    def potential(self, seen: Parts, words: list[bytes]) -> np.ndarray:
        return np.fromiter((seen[w] for w in words), float, count=len(words))

    def emission(self):
        shift, w = 64 - self.bits, self.w
        return lambda word: float(sum(w[x >> shift] for x in parts(word)))

    def fit(self, docs: list[list[bytes]], y: np.ndarray, epochs: int = 12, around: int = 20, rate: float = 0.3, seed: int = 3) -> Tagger:
        """Maximises the conditional likelihood of token labels by Adagrad.

        Sequences are the surroundings of toxic tokens and, of the other text, as many pieces again
        and more, so training time depends on the sample's size only.
        """
        seen = Parts(full=100_000)
        marks = token_labels(docs, y, seen)
        rng, shift = np.random.default_rng(seed), 64 - self.bits
        pieces: list[tuple[list[bytes], np.ndarray]] = []
        plain: list[tuple[list[bytes], np.ndarray]] = []
        for words, label in zip(docs, y, strict=True):
            tag = np.array([bool(label) and any(f in marks for f in seen[w]) for w in words], bool)
            size = 2 * around
            for i in range(0, len(words), size):
                (pieces if tag[i : i + size].any() else plain).append((words[i : i + size], tag[i : i + size]))
        some = rng.permutation(len(plain))[: max(4000, 3 * len(pieces))]
        pieces += [plain[i] for i in some]
        if not pieces:
            return self
        ws = [w for x, _ in pieces for w in x]
        tags = np.concatenate([t for _, t in pieces])
        lens = np.array([len(x) for x, _ in pieces])
        first = np.zeros(len(ws), bool)
        first[np.cumsum(lens) - lens] = True
        feats = [seen[w] for w in ws]
        tok = np.repeat(np.arange(len(ws)), [len(x) for x in feats])
        idx = np.array([f >> shift for x in feats for f in x], np.int64)
        g_w, g_e, g_s = np.full(self.w.shape, 1e-3), np.full((2, 2), 1e-1), np.full(2, 1e-1)
        inner = ~first
        prev = np.flatnonzero(inner) - 1
        want_edge = np.zeros((2, 2))
        np.add.at(want_edge, (tags[prev].astype(int), tags[inner].astype(int)), 1)
        want_start = np.array([(~tags[first]).sum(), tags[first].sum()], float)
        n = len(ws)
        for _ in range(epochs * 4):
            node = np.bincount(tok, self.w[idx], minlength=n)
            p, (fwd, bwd), _ = chain(node, first, self.edge, self.start)
            T = np.exp(self.edge)
            pair = fwd[prev][:, :, None] * T[None] * (bwd[inner] * np.stack((np.ones(inner.sum()), np.exp(np.clip(node[inner], -30, 30))), 1))[:, None, :]
            pair /= pair.sum((1, 2))[:, None, None]
            err = p - tags
            dw = np.bincount(idx, err[tok], minlength=len(self.w)) / n + 2e-7 * self.w
            de = (pair.sum(0) - want_edge) / n
            ds = (np.array([(1 - p[first]).sum(), p[first].sum()]) - want_start) / n
            g_w += (dw * n / 50) ** 2
            g_e += (de * n / 50) ** 2
            g_s += (ds * n / 50) ** 2
            self.w -= rate * (dw * n / 50) / np.sqrt(g_w)
            self.edge -= rate * (de * n / 50) / np.sqrt(g_e)
            self.start -= rate * (ds * n / 50) / np.sqrt(g_s)
        own = Parts(self.emission(), full=100_000)
        x = np.array([self.summary(p) for i in range(0, len(docs), 200) for p in self.marginals(docs[i : i + 200], own)])
        self.calibrate(x, y.astype(float))
        return self

    def marginals(self, docs: list[list[bytes]], seen: Parts | None = None) -> list[np.ndarray]:
        """Probability of each token of each document to be toxic."""
        seen = Parts(self.emission()) if seen is None else seen
        flat = [w for d in docs for w in d]
        if not flat:
            return [np.zeros(0) for _ in docs]
        lens = np.array([len(d) for d in docs])
        ends = np.cumsum(lens)
        first = np.zeros(len(flat), bool)
        first[(ends - lens)[lens > 0]] = True
        p, _, _ = chain(self.potential(seen, flat), first, self.edge, self.start)
        return np.split(p, ends[:-1])

    @staticmethod
    def summary(p: np.ndarray) -> np.ndarray:
        """Expected toxic tokens (logarithm), the probability that there is one, and their share."""
        if not len(p):
            return np.zeros(3)
        total = p.sum()
        return np.array([np.log1p(total), 1 - np.exp(np.log1p(-np.minimum(p, 1 - 1e-12)).sum()), np.sqrt(total / len(p))])

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> None:
        """Logistic regression of the document's label on the summary, by Newton's method."""
        a = np.column_stack((x, np.ones(len(x))))
        w = np.zeros(4)
        for _ in range(25):
            p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
            g = a.T @ (p - y) + 0.1 * w
            h = (a * (p * (1 - p))[:, None]).T @ a + 0.1 * np.eye(4)
            w -= np.linalg.solve(h, g)
        self.doc, self.bias = w[:3], float(w[3])

    def score(self, p: np.ndarray) -> float:
        z = float(np.clip(self.summary(p) @ self.doc + self.bias, -30, 30))
        return 1 / (1 + np.exp(-z))


def spans(text: bytes, p: np.ndarray, least: float = 0.5) -> list[tuple[int, int]]:
    """Code point offsets (start, end) of runs of tokens that are toxic with probability `least` at least."""
    hits = np.flatnonzero(p >= least)
    if not len(hits):
        return []
    places, wanted, out = {}, set(hits.tolist()), []
    for i, m in enumerate(_TOKEN.finditer(text)):
        if i in wanted:
            places[i] = m.span()
    at, chars = 0, 0
    for i in hits.tolist():
        s, e = places[i]
        chars += len(text[at:s].decode(errors="replace"))
        begin = chars
        chars += len(text[s:e].decode(errors="replace"))
        at = e
        if out and out[-1][2] == i - 1:
            out[-1] = (out[-1][0], chars, i)
        else:
            out.append((begin, chars, i))
    return [(s, e) for s, e, _ in out]


def fit_tagger(docs: DataFrame, labels: DataFrame, label: str = "toxic", most: int = 4000, bits: int = 16) -> Tagger:
    """A tagger fitted on at most `most` labelled documents (see sample.labelled); without any it scores by its starting weights."""

    def fit(rows: pa.Table) -> dict[str, np.ndarray]:
        tagger = Tagger(bits).fit([t.split() for t in texts_of(rows.column("text"))], rows.column("y").to_numpy().astype(int))
        return {"bias": np.array(tagger.bias)} | {k: getattr(tagger, k) for k in ("w", "edge", "start", "doc")}

    tagger = Tagger(bits)
    for k, x in (fitted(labelled(docs, labels, label, most), fit) or {}).items():
        setattr(tagger, k, float(x) if k == "bias" else x)
    return tagger


def toxicity_scores(docs: DataFrame, labels: DataFrame, label: str = "toxic", most: int = 4000, threshold: float = 0.7, bits: int = 16) -> DataFrame:
    """(doc_id, held_out, score, predicted, spans) of every row of docs.

    spans: [(start, end)] in code points, of the tokens that the field marks. Labels are learnt from at
    most `most` documents that are not held out (see sample.labelled, token_labels). Whole texts are
    tagged. Null texts count as empty: no spans, and the score of a document without tokens; repeated rows are scored
    alike; a null id is returned as it is; other columns are ignored.
    """
    tagger = fit_tagger(docs, labels, label, most, bits)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("spans", kind)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Parts(tagger.emission())
        for b in batches:
            texts = texts_of(b.column(2))
            for i, j in slices(texts, 2_000_000):
                found = tagger.marginals([t.split() for t in texts[i:j]], seen)
                where = [[{"start": s, "end": e} for s, e in spans(t, p)] for t, p in zip(texts[i:j], found, strict=True)]
                yield batch(schema, [b.column(0).slice(i, j - i), b.column(1).slice(i, j - i), [tagger.score(p) for p in found], where])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text")
    scored = rows.mapInArrow(lean(run), "doc_id long, held_out boolean, score double, spans array<struct<start: long, end: long>>")
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "spans")
