"""Pseudo-likelihood of documents: each token is predicted from the tokens on both its sides."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, cut, join_unique, lean, mix, slices, texts_of
from .tokens import Tokeniser

_U = np.uint64
#: Places of the window, relative to the predicted token.
WINDOW = (-2, -1, 1, 2)
REACH = max(abs(p) for p in WINDOW)
#: Bits of a word's code that tell its way down the tree of its class, of which a vocabulary uses the first `depth`.
BITS = 16
#: Words that have an own row among the window's words, and rows that all others share.
CONTEXT = (192, 64)


def place_of(codes: np.ndarray, shared: int) -> np.ndarray:
    """Class (of `shared` ones) << BITS | way down its tree, of words that have no class of their own."""
    h = mix(codes ^ _U(0xA24BAED4963EE407))
    return ((((h >> _U(32)) * _U(shared)) >> _U(32)) << _U(BITS) | (h & _U((1 << BITS) - 1))).astype(np.int64)


def depth_of(words: int) -> int:
    """Levels of the trees, so that their leaves grow with the cube root of the number of distinct words."""
    return min(BITS, max(1, int(np.log2(words + 1) / 3)))


def _firsts(x: np.ndarray) -> np.ndarray:
    """Where a new value begins in sorted values."""
    return np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1])))


def _fours(order: np.ndarray, first: np.ndarray, none: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, begin): the rows order[first[i]:first[i + 1]] of a sum in columns of four, filled up with `none`, and where each sum's columns begin."""
    size = np.diff(first, append=len(order))
    parts = size + 3 >> 2
    begin = np.cumsum(parts) - parts
    rows = np.full(4 * (begin[-1] + parts[-1]), none)
    rows[np.arange(len(order)) + np.repeat(4 * begin - first, size)] = order
    return np.ascontiguousarray(rows.reshape(-1, 4).T), begin


def _summed(x: np.ndarray, rows: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Sums of rows of x as _fours tells them: whole blocks are added first, then an even number of floats is summed in pairs, as complex numbers."""
    got = np.take(x, rows[0], axis=0)
    for more in rows[1:]:
        got += np.take(x, more, axis=0)
    return np.add.reduceat(got.view(np.complex64), begin, axis=0).view(np.float32) if x.shape[1] % 2 == 0 else np.add.reduceat(got, begin, axis=0)


def _stepped(x: np.ndarray, squares: np.ndarray, d: np.ndarray, rate: float) -> None:
    """A step of Adagrad in place."""
    square = d * d
    squares += square
    np.sqrt(squares, out=square)
    np.divide(d, square, out=square)
    square *= np.float32(rate)
    x -= square


class Vocabulary:
    """Classes, leaves and shares of words, from counts over the whole corpus.

    codes, counts: the most frequent words (as codes of tokens.Tokeniser) with their counts, in that order. The first `own` of them
    have a class of their own; every other word shares one of the other classes and stands in a leaf of that class's binary tree. rest: for each
    leaf (tokens, distinct words) of the words that are not listed: such a word gets an equal share of the leaf's rest here, which rare_gains
    turns into its own share from the table of all counts; a word that the corpus has not seen keeps the share of one more word.
    """

    def __init__(self, codes: np.ndarray, counts: np.ndarray, own: int, rest: np.ndarray, classes: int, depth: int):
        self.first, self.classes, self.depth, self.shared = own, classes, depth, classes - own
        own = min(own, len(codes))
        leaf = place_of(codes, self.shared) >> (BITS - depth)
        total = np.bincount(leaf[own:], counts[own:], minlength=self.shared << depth) + rest[:, 0] + 1.0
        self.leaf_total = total
        order = np.argsort(codes)
        rank = np.arange(len(codes))
        self.codes, self.rank, self.starts, self.listed = codes[order], rank[order], None, None
        self.log = np.where(rank < own, 0.0, np.log(counts / total[leaf]))[order]
        self.equal = np.log((rest[:, 0] + 1.0) / (rest[:, 1] + 1.0))
        self.other = self.equal - np.log(total)
        mass = np.concatenate((counts[:own] + 1.0, np.ones(self.first - own), total.reshape(self.shared, -1).sum(1)))
        self.unigram = np.log(mass / mass.sum())

    def find(self, codes: np.ndarray) -> np.ndarray:
        """Where codes stand among the listed ones (of which there are some); any place for a code that is not listed."""
        if self.starts is None:
            # codes are spread evenly, so their first bits lead to within a few places
            self.starts = np.searchsorted(self.codes, np.arange(1 << 16, dtype=_U) << _U(48)).astype(np.int32)
        last = len(self.codes) - 1
        at = np.minimum(np.take(self.starts, (codes >> _U(48)).astype(np.int64)), last)
        behind = np.flatnonzero(np.take(self.codes, at) < codes)
        while len(behind):
            at[behind] += 1
            behind = behind[at[behind] <= last]
            behind = behind[(self.codes[at[behind]] < codes[behind]) & (self.codes[at[behind]] >> _U(48) == codes[behind] >> _U(48))]
        return np.minimum(at, last)

    def entries(self, texts: list[bytes], tokens: Tokeniser) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(class, leaf or -1, row as context, ln P(word | class and leaf)) of each word of texts, and the texts' bounds."""
        codes, bounds, _ = tokens.codes(texts)
        if not len(self.codes):
            return *self._placed(codes), bounds
        if self.listed is None:
            # what listed words get is worked out once
            cls, leaf, context, _ = self._placed(self.codes)
            own, single = self.rank < CONTEXT[0], self.rank < self.first
            context[own], cls[single], leaf[single] = self.rank[own], self.rank[single], -1
            self.listed = cls, leaf, context, self.log
        at = self.find(codes)
        found = [np.take(x, at) for x in self.listed]
        rare = np.flatnonzero(np.take(self.codes, at) != codes)
        for x, new in zip(found, self._placed(codes[rare]), strict=True):
            x[rare] = new
        return *found, bounds

    def _placed(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(class, leaf, row as context, ln P) of words that are not listed."""
        leaf = place_of(codes, self.shared) >> (BITS - self.depth)
        return self.first + (leaf >> self.depth), leaf, CONTEXT[0] + (codes >> _U(20)).astype(np.int64) % CONTEXT[1], self.other[leaf]


class Network:
    """softmax(tanh(sum_p E_p[word at p] + b) W + u) over classes, then a logistic choice at each node on the way to the word's leaf.

    One hidden layer over the window on both sides serves both: the class and every step down its tree depend on it.
    """

    PARTS = ("e", "b", "w", "u", "t", "c")

    def __init__(self, vocabulary: Vocabulary, hidden: int, seed: int = 13):
        rng = np.random.default_rng(seed)
        v = vocabulary
        self.vocabulary, self.hidden, self.depth, rows = v, hidden, v.depth, sum(CONTEXT)
        self.e = rng.normal(0, 0.1, (len(WINDOW), rows + 1, hidden)).astype(np.float32)
        self.b, self.u = np.zeros(hidden, np.float32), v.unigram.astype(np.float32)
        self.w = rng.normal(0, 0.1, (hidden, v.classes)).astype(np.float32)
        self.t = np.zeros((v.shared << v.depth, hidden), np.float32)
        # a node's bias is the share of tokens below its second branch
        mass, bias = v.leaf_total.reshape(v.shared, -1), np.zeros((v.shared, 1 << v.depth), np.float32)
        for j in range(v.depth - 1, -1, -1):
            pair = mass.reshape(v.shared, 1 << j, 2, -1).sum(3)
            bias[:, 1 << j : 2 << j] = np.log(pair[:, :, 1] / pair[:, :, 0])
        self.c = bias.ravel()

    def flat(self) -> np.ndarray:
        return np.concatenate([getattr(self, k).ravel() for k in self.PARTS])

    def set_flat(self, v: np.ndarray) -> Network:
        at = 0
        for name in self.PARTS:
            x = getattr(self, name)
            setattr(self, name, np.asarray(v[at : at + x.size], np.float32).reshape(x.shape))
            at += x.size
        return self

    def padded(self, context: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places, at): the tokens' rows as a sequence and where they stand in it; the row after the last one stands beyond a text's ends."""
        size = np.diff(bounds)
        at = np.arange(len(context)) + REACH * (np.repeat(np.arange(len(size)), size) + 1)
        places = np.full(len(context) + REACH * (len(size) + 1), sum(CONTEXT), np.uint16)
        places[at] = context
        return places, at

    def windows(self, context: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """The window's rows for each token."""
        places, at = self.padded(context, bounds)
        return np.stack([places[at + p] for p in WINDOW], 1)

    def apart(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of windows as a sequence in which each window has places of its own."""
        places = np.full((len(x), 2 * REACH + 1), sum(CONTEXT), np.uint16)
        places[:, [p + REACH for p in WINDOW]] = x
        return places.ravel(), np.arange(len(x)) * (2 * REACH + 1) + REACH

    def node(self, leaf: np.ndarray, j) -> tuple[np.ndarray, np.ndarray]:
        """The node of level j on the way to a leaf, and the branch that is taken there."""
        d = self.depth
        way = leaf & ((1 << d) - 1)
        return (leaf >> d << d) + ((1 << j) | (way >> (d - j))), (way >> (d - 1 - j)) & 1

    def layer(self, places: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The hidden layer of the tokens at `at`: what each place adds is looked up for the whole stretch and shifted."""
        row = places[at[0] - REACH : at[-1] + REACH + 1]
        n = len(row) - 2 * REACH
        h = np.take(self.e[0], row[REACH + WINDOW[0] :][:n], axis=0)
        h += self.b
        for e, p in zip(self.e[1:], WINDOW[1:], strict=True):
            h += np.take(e, row[REACH + p :][:n], axis=0)
        if n > len(at):
            h = np.take(h, at - at[0], axis=0)
        return np.tanh(h, out=h)

    def logits(self, h: np.ndarray) -> np.ndarray:
        """Logits of all classes up to a number a row of h."""
        z = h @ self.w
        z += self.u
        # no element of h is above 1; small logits need no shift to be raised
        if not np.abs(self.w).sum(0).max() + np.abs(self.u).max() < 60:
            z -= z.max(1)[:, None]
        return z

    def log_probabilities(self, x: np.ndarray, y: np.ndarray, leaf: np.ndarray) -> np.ndarray:
        """ln P(class y and leaf | window x) for each row."""
        return self.log_probabilities_along(*self.apart(x), y, leaf)

    def log_probabilities_along(self, places: np.ndarray, at: np.ndarray, y: np.ndarray, leaf: np.ndarray) -> np.ndarray:
        """ln P(class y and leaf | window) for each token at `at`."""
        out = np.empty(len(y))
        # each leaf's weights and bias at each step on its way, with the sign of the branch that is not taken
        ways = []
        for j in range(self.depth):
            node, right = self.node(np.arange(len(self.t)), j)
            sign = (1 - 2 * right).astype(np.float32)
            ways.append((np.take(self.t, node, axis=0) * sign[:, None], self.c[node] * sign))
        ones = np.ones(self.w.shape[1], np.float32)
        for i in range(0, len(y), 4096):
            t, f = y[i : i + 4096], leaf[i : i + 4096]
            h = self.layer(places, at[i : i + 4096])
            z = self.logits(h)
            picked = z[np.arange(len(t)), t]
            np.exp(z, out=z)
            got = (picked - np.log(z @ ones)).astype(float)
            below = np.flatnonzero(f >= 0)
            g, own = np.take(h, below, axis=0), f[below]
            # 1 / P of all choices so far: at most 16 factors of at most 1 + e^30
            inverse = np.ones(len(below))
            for weight, bias in ways:
                s = np.einsum("nh,nh->n", g, np.take(weight, own, axis=0))
                s += np.take(bias, own)
                np.exp(np.minimum(s, np.float32(30), out=s), out=s)
                s += 1
                inverse *= s
            got[below] -= np.log(inverse)
            out[i : i + 4096] = got
        return out

    def train(self, x: np.ndarray, y: np.ndarray, leaf: np.ndarray, state: list[np.ndarray], turn: int, rate: float = 0.05, size: int = 2048) -> int:
        """train_along over rows of windows."""
        return self.train_along(*self.apart(x), y, leaf, state, turn, rate, size)

    def train_along(self, places: np.ndarray, at: np.ndarray, y: np.ndarray, leaf: np.ndarray, state: list[np.ndarray], turn: int, rate: float = 0.05, size: int = 2048) -> int:
        """One pass of Adagrad over the tokens at `at`; state holds the sums of squares. Of the trees each step trains one level, in turn; returns the turn."""
        k, ones = self.hidden, np.ones(self.w.shape[1], np.float32)
        # each leaf's node and branch at each level; the last one stands for words without a leaf, at a node that no way has.
        # Nodes in few bits: short numbers are sorted by their digits
        small, levels = np.min_scalar_type(len(self.t)), []
        for j in range(self.depth):
            node, right = self.node(np.arange(len(self.t)), j)
            levels.append((np.append(node, 0).astype(small), np.append(right, 0).astype(np.float32)))
        for i in range(0, len(y), size):
            where, t, f = at[i : i + size], y[i : i + size], leaf[i : i + size]
            n = len(t)
            share = np.float32(1 / np.sqrt(n))
            h = self.layer(places, where)
            z = self.logits(h)
            np.exp(z, out=z)
            z *= (share / (z @ ones))[:, None]
            z[np.arange(n), t] -= share
            dh = z @ self.w.T
            node, right = (np.take(x, f) for x in levels[turn % self.depth])
            turn += 1
            way = np.take(self.t, node, axis=0)
            s = np.einsum("nh,nh->n", h, way)
            s += np.take(self.c, node)
            np.exp(np.clip(-s, -30, 30, out=s), out=s)
            s += 1
            err = (1 / s - right) * share
            err[f < 0] = 0
            way *= err[:, None]
            dh += way
            order = np.argsort(node, kind="stable")
            node = node[order]
            first = _firsts(node)
            used = node[first]
            rows = np.zeros((n + 1, k), np.float32)
            np.multiply(h, err[:, None], out=rows[:n])
            sums = (_summed(rows, *_fours(order, first, n)), np.add.reduceat(np.take(err, order), first))
            for name, d in zip("tc", sums, strict=True):
                squares = state[self.PARTS.index(name)]
                got = squares[used] + d * d
                squares[used] = got
                getattr(self, name)[used] -= rate * d / np.sqrt(got)
            dh *= 1 - h * h
            # a word's row of each place gets the sum of dh that far from where the word stands; beyond the tokens, and in the last rows, dh is 0
            row = places[where[0] - REACH : where[-1] + REACH + 1]
            around = np.zeros((len(row) + 4 * REACH + 1, k), np.float32)
            around[where - where[0] + 2 * REACH] = dh
            order = np.argsort(row, kind="stable")
            row = row[order]
            first = _firsts(row)
            rows, begin = _fours(order, first, len(row) + 2 * REACH)
            d = np.zeros(self.e.shape, np.float32)
            for place, p in zip(d, WINDOW, strict=True):
                place[row[first]] = _summed(around, rows + (REACH - p), begin)
            for name, d in (("e", d), ("b", np.ones(n, np.float32) @ dh), ("w", h.T @ z), ("u", np.ones(n, np.float32) @ z)):
                _stepped(getattr(self, name), state[self.PARTS.index(name)], d, rate)
        return turn

    def fresh_state(self) -> list[np.ndarray]:
        return [np.full(getattr(self, k).shape, 0.1, np.float32) for k in self.PARTS]


def count_words(docs: DataFrame, shared: int) -> DataFrame:
    """(code, place, n) over all texts: counted in each slice first, so a frequent word is one row of it."""
    schema = pa.schema([("code", pa.int64()), ("place", pa.int32()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokeniser()
        for b in batches:
            texts = texts_of(b.column(0))
            for i, j in slices(texts, 4_000_000):
                code, n = np.unique(tokens.codes(texts[i:j])[0], return_counts=True)
                yield batch(schema, [pa.array(code.view(np.int64)), place_of(code, shared).astype(np.int32), n])

    return docs.select("text").mapInArrow(lean(run), "code long, place int, n long").groupBy("code").agg(F.sum("n").alias("n"), F.first("place").alias("place"))


def vocabulary_of(counts: DataFrame, classes: int, own: int, listed: int) -> Vocabulary:
    """From the table of all counts; what comes to the driver is at most `listed` words, and a row a leaf.

    Words are listed from a count on, which a histogram over sixteenths of powers of two gives, so no order of all words is needed.
    """
    step = F.floor(F.log2(F.col("n").cast("double")) * 16).cast("int")
    steps = sorted(((r.step, r.k) for r in counts.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("k")).collect()), reverse=True)
    words, edge, taken = sum(k for _, k in steps), None, 0
    for s, k in steps:
        if taken + k > listed:
            break
        edge, taken = s, taken + k
    depth = depth_of(words)
    top = counts.where(step >= F.lit(edge)).select("code", "n").toPandas() if edge is not None else pd.DataFrame({"code": [], "n": []})
    top = top.sort_values(["n", "code"], ascending=[False, True])
    leaf = F.shiftright("place", BITS - depth)
    others = counts if edge is None else counts.where(step < F.lit(edge))
    found = others.groupBy(leaf.alias("leaf")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k")).toPandas()
    rest = np.zeros(((classes - own) << depth, 2))
    rest[found.leaf.to_numpy(int)] = found[["n", "k"]].to_numpy(float)
    return Vocabulary(top.code.to_numpy(np.int64).view(np.uint64), top.n.to_numpy(float), own, rest, classes, depth)


def rare_gains(docs: DataFrame, counts: DataFrame, vocabulary: Vocabulary, keys: DataFrame | None = None) -> DataFrame:
    """(key, gain) by the hash of a text: what its words that are not listed have over equal shares, by their own counts.

    The counts stay a table that is joined by the word's code; words that would be hot keys are listed. Of a text with copies only one is looked up.
    keys: the texts' hashes (key), where a table has them already.
    """
    schema = pa.schema([("key", pa.int64()), ("code", pa.int64()), ("times", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokeniser()
        for b in batches:
            keys, texts = b.column(0).to_numpy(zero_copy_only=False), texts_of(b.column(1))
            for i, j in slices(texts, 1_000_000):
                codes, bounds, _ = tokens.codes(texts[i:j])
                rare = np.ones(len(codes), bool)
                if len(vocabulary.codes) and len(codes):
                    rare = vocabulary.codes[vocabulary.find(codes)] != codes
                # a word that is several times in a text is one row
                owner, codes = np.repeat(np.arange(j - i), np.diff(bounds))[rare], codes[rare]
                order = np.argsort(codes + mix(owner))
                owner, codes = owner[order], codes[order]
                first = np.flatnonzero(np.concatenate(([True], (owner[1:] != owner[:-1]) | (codes[1:] != codes[:-1])))) if len(codes) else np.zeros(0, np.int64)
                yield batch(schema, [keys[i:j][owner[first]], codes[first].view(np.int64), np.diff(np.append(first, len(codes))).astype(np.int32)])

    keyed = docs.where("text is not null").select(F.xxhash64("text").alias("key"), "text")
    # a row a leaf: their number grows with the cube root of the vocabulary
    spark = docs.sparkSession
    equal = F.broadcast(spark.createDataFrame(pd.DataFrame({"leaf": np.arange(len(vocabulary.equal)), "equal": vocabulary.equal}), "leaf int, equal double"))
    gain = counts.withColumn("leaf", F.shiftright("place", BITS - vocabulary.depth)).join(equal, "leaf").select("code", (F.log("n") - F.col("equal")).alias("gain"))
    summed = keyed.mapInArrow(lean(run), "key long, code long, times int").join(gain.hint("shuffle_hash"), "code").groupBy("key").agg(F.sum(F.col("times") * F.col("gain")).alias("gain"))
    # copies of a text have summed theirs into one row
    return summed.join((keyed if keys is None else keys).groupBy("key").agg(F.count(F.lit(1)).alias("copies")), "key").select("key", (F.col("gain") / F.col("copies")).alias("gain"))


def fit_network(docs: DataFrame, vocabulary: Vocabulary, tokens: int, hidden: int, per: int = 500_000, early: int = 16, seed: int = 13) -> Network:
    """A network trained on every token of every document.

    Documents are dealt by a hash of id and text into buckets of about `per` tokens (the corpus has `tokens`). In each a copy of the network is trained, on the
    documents in the order of their hashes, and the copies' weights are averaged by their numbers of tokens, in two steps, so that
    no task gets a row of every other one. So the result follows from the documents, not from how they lie in files and tasks. First one bucket in
    `early` (of fewer buckets, one document in `early`) gives the weights that the second round, over all documents, starts from. How much is learnt from grows with the corpus.
    """
    buckets = max(1, -(-tokens // per))
    h = F.xxhash64("doc_id", "text", F.lit(seed))
    rows = docs.where("text is not null").select(F.pmod(h, F.lit(buckets)).cast("int").alias("bucket"), F.xxhash64(h).alias("h"), "text")
    piece = 4096
    schema = pa.schema([("slot", pa.int32()), ("bucket", pa.int32()), ("n", pa.int64()), ("v", pa.list_(pa.float32()))])

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("bucket")
        return pd.DataFrame({"slot": [rows.slot.iloc[0]], "bucket": [rows.bucket.iloc[0]], "n": [rows.n.sum()], "v": [np.sum(np.stack(rows.v.to_numpy()).astype(float), axis=0)]})

    def trained(some: DataFrame, start: np.ndarray | None, parts: int) -> np.ndarray | None:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            split = Tokeniser()

            def groups() -> Iterator[tuple[int, list[bytes], bool]]:
                """Texts of one bucket of about 400,000 bytes at a time, whatever batches they come in, and whether the bucket ends."""
                own, held, size = None, [], 0
                for b in batches:
                    for bucket, text in zip(b.column(0).to_pylist(), texts_of(b.column(1)), strict=True):
                        if own is not None and (bucket != own or size > 400_000):
                            yield own, held, bucket != own
                            held, size = [], 0
                        own = bucket
                        held.append(text)
                        size += len(text)
                if own is not None:
                    yield own, held, True

            net = None
            for bucket, texts, ends in groups():
                if net is None:
                    net, n, turn = Network(vocabulary, hidden), 0, 0
                    net = net if start is None else net.set_flat(start.copy())
                    state = net.fresh_state()
                c, leaf, context, _, bounds = vocabulary.entries(texts, split)
                turn = net.train_along(*net.padded(context, bounds), c, leaf, state, turn)
                n += len(c)
                if ends:
                    v = (net.flat().astype(float) * n).astype(np.float32)
                    cuts = range(0, len(v), piece)
                    if n:
                        yield batch(schema, [[k // piece for k in cuts], [bucket for _ in cuts], [n for _ in cuts], [v[k : k + piece] for k in cuts]])
                    net = None

        dealt = some.repartition(parts, "bucket").sortWithinPartitions("bucket", "h", "text").select("bucket", "text")
        total = dealt.mapInArrow(lean(run), "slot int, bucket int, n long, v array<float>")
        total = total.groupBy("slot", F.pmod("bucket", F.lit(61)).alias("salt")).applyInPandas(add, "slot int, bucket int, n long, v array<double>")
        total = total.groupBy("slot").applyInPandas(add, "slot int, bucket int, n long, v array<double>").toPandas().sort_values("slot")
        return np.concatenate(total.v.to_numpy()) / total.n.iloc[0] if len(total) else start

    first = rows.where(F.pmod("h" if buckets < early else "bucket", F.lit(early)) == 0)
    start = trained(first, None, max(1, min(buckets, 20_000) // early))
    learnt = trained(rows, start, min(buckets, 20_000))
    network = Network(vocabulary, hidden)
    return network if learnt is None else network.set_flat(learnt)


def score_texts(texts: list[bytes], network: Network, tokens: Tokeniser) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and summed ln P(token | both sides) of each text."""
    c, leaf, context, log, bounds = network.vocabulary.entries(texts, tokens)
    p = np.concatenate(([0.0], np.cumsum(network.log_probabilities_along(*network.padded(context, bounds), c, leaf) + log)))
    return np.diff(bounds), p[bounds[1:]] - p[bounds[:-1]]


def pseudo_likelihood(docs: DataFrame, classes: int = 64, own: int = 48, listed: int = 20_000, hidden: int = 24, per: int = 500_000) -> DataFrame:
    """(doc_id, n_tokens, pll, pll_mean) of every row of docs.

    pll is the sum over all tokens of ln P(class | two tokens on either side) + ln P(way to the word's leaf | class, the same tokens)
    + ln P(token | leaf): the first two by a network trained here on all tokens of the corpus, the last from the counts of all words over
    all of it. The leaves grow with the vocabulary (see depth_of). pll_mean is per token.
    Null or empty texts have no tokens: pll 0 and a null mean; an empty table gives none; texts of any length are scored whole. Repeated rows and copies are
    scored alike; a null id is returned as it is; other columns are ignored. Words are compared in lower case (A-Z).
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    counts = cut(count_words(rows, classes - own))
    vocabulary = vocabulary_of(counts, classes, own, listed)
    network = fit_network(rows, vocabulary, counts.agg(F.sum("n")).first()[0] or 0, hidden, per)
    schema = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("n_tokens", pa.int64()), ("pll", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokeniser()
        for b in batches:
            texts = texts_of(b.column(2))
            for i, j in slices(texts, 1_000_000):
                yield batch(schema, [b.column(0).slice(i, j - i), b.column(1).slice(i, j - i), *score_texts(texts[i:j], network, tokens)])

    scored = rows.select("doc_id", F.xxhash64("text").alias("key"), "text").mapInArrow(lean(run), "doc_id long, key long, n_tokens long, pll double")
    scored = cut(scored)
    # texts with many copies are keys with many rows
    gains = cut(rare_gains(rows, counts, vocabulary, scored.where("key is not null")))
    scored = join_unique(scored, gains, ["key"], "left").select("doc_id", "n_tokens", (F.col("pll") + F.coalesce("gain", F.lit(0.0))).alias("pll"))
    return scored.withColumn("pll_mean", F.when(F.col("n_tokens") > 0, F.col("pll") / F.col("n_tokens")))
