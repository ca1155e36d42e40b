"""N-gram Jaccard self-join by partitioning the universe of shingles (pigeonhole on segments)."""

from __future__ import annotations

import hashlib
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import batch, beside, checkpoints, components, cut, delete, join_unique, lean, mix, shared_folder, slices, texts_of
from .tokens import Tokeniser

_U = np.uint64
#: Odd multipliers of the words of a shingle.
_WEIGHTS = (_U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F), _U(0x165667B19E3779F9), _U(0xD6E8FEB86659FD93), _U(0xA0761D6478BD642F), _U(0xE7037ED1A0B428DB), _U(0x8EBC6AF09C88C6E3), _U(0x589965CC75374CC3))


def shingle_sets(texts: list[bytes], tokens: Tokeniser, k: int) -> list[np.ndarray]:
    """Of each text the sorted distinct 64-bit codes of its word k-grams; of the whole sequence if it is shorter; empty without words."""
    h, bounds, _ = tokens.codes(texts)
    n = len(h)
    whole = np.zeros(max(0, n - k + 1), _U)
    for i in range(k):
        whole += h[i : i + len(whole)] * _WEIGHTS[i]
    whole = mix(whole)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= k:
            s = np.sort(whole[a : b - k + 1])
            out.append(s[np.concatenate(([True], s[1:] != s[:-1]))])
        elif b > a:
            x = np.full(1, b - a, _U)
            for i in range(b - a):
                x += h[a + i] * _WEIGHTS[i]
            out.append(mix(x))
        else:
            out.append(np.empty(0, _U))
    return out


#: What layout has worked out. A plain function with its own table is sent to executors by value, a function that lru_cache has wrapped is not.
_LAYOUTS: dict[tuple[int, int, float], tuple[int, int, int, int]] = {}


def layout(size: int, percent: int, ratio: float = 1.4) -> tuple[int, int, int, int]:
    """Of a set's size: its band, the band's least size, the largest number of differing tokens H and the segments m.

    Linked sets have sizes a <= b with a >= t b, and differ in at most (1-t)/(1+t) (a+b) tokens. A band
    answers for its own pairs and for partners above it, so H is taken for its largest sizes. m is H+1
    and a few spare segments: as many of a set's segments may be skipped (empty, or too frequent) at no loss.
    """
    known = _LAYOUTS.get((size, percent, ratio))
    if known:
        return known
    low, band = 1, 0
    while True:
        high = max(low + 1, int(low * ratio) + 1)
        if size < high:
            break
        low, band = high, band + 1
    a = high - 1
    h = (100 - percent) * (a + a * 100 // percent) // (100 + percent)
    if len(_LAYOUTS) >= 4096:
        _LAYOUTS.clear()
    _LAYOUTS[size, percent, ratio] = found = band, low, h, h + 1 + (h and 1 + (h + 1) // 12)
    return found


#: Turns in which each document of an open bucket meets one leader, before members meet each other; they cost disk, so none by default.
STARS = 0
#: Documents with at most so many open buckets carry the list of them, so that a pair is one row and not one in each bucket that it shares.
LISTED = 128
#: Independent ways to cut the universe into segments; one after another for sets whose codes crowd in few segments.
WAYS = 4


def _cut_up(s: np.ndarray, m: int, way: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes in the order of their segments, first place of each segment that is not empty, its number) in one way of cutting the universe."""
    if way:
        turned = mix(s + _U(way) * _U(0xD1342543DE82EF95))
        order = np.argsort(turned)
        s, turned = s[order], turned[order]
    else:
        turned = s
    seg = ((turned >> _U(32)) * _U(m)) >> _U(32)
    starts = np.flatnonzero(np.concatenate(([True], seg[1:] != seg[:-1])))
    return s, starts, seg[starts]


def _place(which: np.ndarray, band: int, way: int) -> np.ndarray:
    return mix(which + _U(band) * _U(1 << 32) + _U(way) * _U(1 << 56) + _U(1 << 60))


def _bands(size: int, percent: int) -> list[int]:
    """Sizes that stand for the bands of a set: its own and, as the larger partner, the one below."""
    band, low, _, _ = layout(size, percent)
    return [size] + ([low - 1] if band and -(-percent * size // 100) < low else [])


def _crowded(counts: np.ndarray, h: int) -> bool:
    """Whether a set that differs in at most h tokens may share no neighbourhood: each segment differs in two tokens, or its only one is gone."""
    return 2 * len(counts) - int((counts == 1).sum()) <= h


def signatures(s: np.ndarray, percent: int, skip: dict[int, set[int]] | None = None) -> np.ndarray:
    """Signatures of a set: for its own band and, as the larger partner, for the band below.

    A segment is a range of the shingle codes, its signature a sum over its tokens. Allocation, by cost:
    segments that are empty or in skip[band + 256 * way] (found to be too frequent) get -1, not compared; the rest get 0,
    compared as they are, which suffices if m less the skipped ones is over H. Otherwise one-deletion
    neighbourhoods are added for all others (+1), which suffices if twice the compared ones are over H. A set that may have a partner
    for which they do not is also cut up in other ways, and at last has a signature for its whole band; its
    partner does the same, as the test holds for both. What skipped segments take away, see _where.
    """
    out = []
    for at in _bands(len(s), percent):
        k, _, h, m = layout(at, percent)
        for way in range(WAYS):
            codes, starts, which = _cut_up(s, m, way)
            counts = np.diff(np.append(starts, len(s)))
            mixed = mix(codes ^ _U(0x5851F42D4C957F2D))
            total = np.add.reduceat(mixed, starts)
            place = _place(which, k, way)
            keep = np.ones(len(which), bool)
            if skip and k + 256 * way in skip:
                hot = skip[k + 256 * way]
                keep = ~np.isin(which, np.fromiter(hot, _U, len(hot)))
            out.append(mix(total[keep] + place[keep]))
            if int(keep.sum()) <= h:
                owner = np.repeat(np.arange(len(starts)), counts)
                near = (total + place * _U(3)) ^ _U(0xA5A5A5A5A5A5A5A5)
                less = (total[owner] - mixed + place[owner] * _U(3)) ^ _U(0xA5A5A5A5A5A5A5A5)
                out += [mix(near[keep]), mix(less[keep[owner]])]
            if not _crowded(counts, h):
                break
        else:
            out.append(_place(np.zeros(1, _U), k, WAYS))
    return np.concatenate(out)


_SETS = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("live", pa.int64()), ("set_key", pa.binary()), ("sigs", pa.list_(pa.int64())), ("bits", pa.list_(pa.int64()))])
_PAIRS = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("linked", pa.bool_())])


#: Bits of a set's parity map: bit i is the parity of the number of its codes that are i modulo their number. A token
#: that only one of two sets has turns one bit, so the maps differ in at most as many bits as the sets in tokens.
BITS = 1024


def parity(s: np.ndarray) -> np.ndarray:
    odd = np.bincount((s & _U(BITS - 1)).astype(np.int64), minlength=BITS) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0] + [len(p) for p in parts])
    flat = np.concatenate(parts).view(np.int64) if parts else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))


def _sets(k: int, percent: int):
    """Of each text: the size of its set, the segments of its own band that are not empty, a key of the whole set, its signatures."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokeniser()
        for b in batches:
            texts = texts_of(b.column(1))
            for i, j in slices(texts, 1_000_000):
                sets = shingle_sets(texts[i:j], tokens, k)
                live, sigs = [], []
                for s in sets:
                    live.append(len(_cut_up(s, layout(len(s), percent)[3], 0)[1]) if len(s) else 0)
                    sigs.append(signatures(s, percent) if len(s) else s)
                key = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
                yield batch(_SETS, [b.column(0).slice(i, j - i), [len(s) for s in sets], live, key, _lists(sigs), _lists([parity(s).view(_U) for s in sets])])

    return run


def _signatures_without(k: int, percent: int):
    """Signatures again, with segments to skip (see _where): neighbourhoods make up for them."""
    schema = pa.schema([("doc_id", pa.int64()), ("sigs", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokeniser()
        for b in batches:
            sigs = []
            for s, skip in zip(shingle_sets(texts_of(b.column(1)), tokens, k), b.column(2).to_pylist(), strict=True):
                hot: dict[int, set[int]] = {}
                for x in skip or ():
                    hot.setdefault(x >> 32, set()).add(x & 0xFFFFFFFF)
                sigs.append(signatures(s, percent, hot) if len(s) else s)
            yield batch(schema, [b.column(0), _lists(sigs)])

    return run


def _where(k: int, percent: int):
    """Input is doc_id, text, its hot signatures; output the segments that they are of, as (band + 256 * way) << 32 | segment.

    short: those of the document's hot signatures through which alone a partner may be found: of neighbourhoods and of whole bands, and those
    of segments where neighbourhoods of the other segments do not suffice.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("skip", pa.list_(pa.int64())), ("short", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokeniser()
        for b in batches:
            skips, shorts = [], []
            for s, hot in zip(shingle_sets(texts_of(b.column(1)), tokens, k), b.column(2).to_pylist(), strict=True):
                wanted = np.array(hot, np.int64).view(_U)
                skip, short, plain = [], [], set()
                for at in _bands(len(s), percent) if len(s) else []:
                    kk, _, h, m = layout(at, percent)
                    for way in range(WAYS):
                        codes, starts, which = _cut_up(s, m, way)
                        sig = mix(np.add.reduceat(mix(codes ^ _U(0x5851F42D4C957F2D)), starts) + _place(which, kk, way))
                        bad = np.isin(sig, wanted)
                        skip += [((kk + 256 * way) << 32) | int(x) for x in which[bad]]
                        plain.update(sig[bad].view(np.int64).tolist())
                        counts = np.diff(np.append(starts, len(s)))
                        # a partner may have fewer segments still
                        if _crowded(counts[~bad], h) if bad.any() else False:
                            short += sig[bad].view(np.int64).tolist()
                        if not _crowded(counts, h):
                            break
                skips.append(skip)
                shorts.append(short + [x for x in hot if x not in plain])
            yield batch(schema, [b.column(0), skips, shorts])

    return run


class _Sets:
    """The sets of the texts met last, of `most` codes in all."""

    def __init__(self, k: int, most: int = 3_000_000):
        self.k, self.most, self.size, self.tokens = k, most, 0, Tokeniser()
        self.kept: OrderedDict[int, tuple[bytes, np.ndarray]] = OrderedDict()

    def of(self, doc: int, text: bytes) -> np.ndarray:
        found = self.kept.get(doc)
        if found and found[0] == text:
            self.kept.move_to_end(doc)
            return found[1]
        s = shingle_sets([text], self.tokens, self.k)[0]
        self.kept[doc] = text, s
        self.size += len(s)
        while self.size > self.most and len(self.kept) > 1:
            self.size -= len(self.kept.popitem(last=False)[1][1])
        return s


def _verify(k: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = _Sets(k)
        for b in batches:
            linked = []
            for x, y, s, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), texts_of(b.column(2)), texts_of(b.column(3)), strict=True):
                right, left = sets.of(y, t), sets.of(x, s)
                same = len(np.intersect1d(left, right, assume_unique=True))
                linked.append(bool(same) and 100 * same >= percent * (len(left) + len(right) - same))
            yield batch(_PAIRS, [b.column(0), b.column(1), linked])

    return run


def ngram_jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 4, percent: int = 85, hot: int = 4096, small: int = 200_000) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of docs.

    Two documents link when 100 * |intersection| >= percent * |union| of their sets of distinct word
    k-grams (lower-cased A-Z; a text with fewer words is one shingle). component_id is the smallest id
    that links reach. Candidates come from equal signatures of universe segments (see signatures); each
    is verified on both whole sets, so the result is exact up to collisions of 64-bit shingle codes
    inside a pair. Groups of near copies are not expanded: every member is first verified against the
    first member of its buckets, then against leaders drawn from them, and then only members of different components are compared. Of the components in a bucket first
    the delegates (the smallest ids) meet: parity maps have a metric, so with the farthest member of each from its delegate known
    one row a component tells whether it has a partner there; members of those that do are compared if their sizes and parity maps
    allow it (in the condition of the join, so other pairs are never rows) and they share enough segments.
    A signature that over `hot` different components share is not expanded either; its documents get
    one-deletion neighbourhoods of their other segments, again while such signatures are left. Where these cannot suffice, the documents
    concerned are compared with the components of the bucket in the same two steps.

    Null or empty texts have n_shingles 0 and link with nothing; an empty table gives none; whole texts of any length count; rows with one
    id are one document, which has the set of the row with most shingles; a null id is returned with a null component; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sets = cut(rows.mapInArrow(lean(_sets(k, percent)), "doc_id long, n_shingles long, live long, set_key binary, sigs array<long>, bits array<long>"))
    size = sets.where("n_shingles > 0 and doc_id is not null").groupBy("doc_id").agg(F.max(F.struct(F.col("n_shingles").alias("n"), "live", F.col("set_key").alias("key"), "bits")).alias("x"))
    size = cut(size.select("doc_id", "x.*"))

    # copies: the first document of each set stands for all of them
    first = cut(size.groupBy("key").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("c")).where("c > 1").select("key", "rep"))
    links_of_copies = cut(join_unique(size.select("doc_id", "key"), first, ["key"], small=small).where("doc_id <> rep").select(F.col("rep").alias("a"), F.col("doc_id").alias("b")))
    spare = beside(links_of_copies.select(F.col("b").alias("doc_id")), small)
    own = size.join(spare, "doc_id", "left_anti").select("doc_id", "n", "live", "bits")

    def apart(x: str, y: str) -> Column:
        """Bits in which two parity maps differ; at most the tokens in which the sets do."""
        return sum((F.bit_count(F.col(x)[i].bitwiseXOR(F.col(y)[i])) for i in range(BITS // 64)), F.lit(0))

    def most(n: str, m: str) -> Column:
        return F.floor((100 - percent) * (F.col(n) + F.col(m)) / (100 + percent))

    def buckets_of(sigs: DataFrame) -> DataFrame:
        """Signatures that two documents at least share, and the first of them."""
        w = Window.partitionBy("sig").orderBy("doc_id")
        near = sigs.select("sig", "doc_id", F.lag("doc_id").over(w).alias("before"), F.lead("doc_id").over(w).alias("after"), F.first("doc_id").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("pivot"))
        fresh = F.col("before").isNull() | (F.col("before") != F.col("doc_id"))
        return cut(near.where(fresh & (F.col("before").isNotNull() | (F.col("after") != F.col("doc_id")))).select("sig", "doc_id", "pivot"))

    def verified(pairs: DataFrame) -> DataFrame:
        """Pairs (a, b) whose sizes allow a link and whose sets have it."""
        x, y = size.select(F.col("doc_id").alias("a"), F.col("n").alias("na")), size.select(F.col("doc_id").alias("b"), F.col("n").alias("nb"))
        asked = cut(pairs.join(x, "a").join(y, "b").where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")).select("a", "b"))
        needed = cut(asked.select(F.col("a").alias("doc_id")).unionByName(asked.select(F.col("b").alias("doc_id"))).distinct())
        # ids only, and only up to a checked number; else Spark shuffles both sides
        text = rows.join(beside(needed, small), "doc_id", "left_semi")
        both = asked.join(text.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")), "a").join(text.select(F.col("doc_id").alias("b"), F.col("text").alias("tb")), "b")
        found = both.select("a", "b", "ta", "tb").mapInArrow(lean(_verify(k, percent)), "a long, b long, linked boolean").where("linked").select("a", "b")
        return cut(found.distinct())

    def placed(some: DataFrame, comp: DataFrame) -> DataFrame:
        """some (with doc_id) with the component of each document so far."""
        return some.join(comp.select(F.col("node").alias("doc_id"), "component"), "doc_id", "left").withColumn("comp", F.coalesce("component", "doc_id")).drop("component")

    def delegates(member: DataFrame) -> DataFrame:
        """(comp, dn, bits, far, lo, hi) of the components of member: the delegate's size and map, the largest distance of a member, the sizes."""
        every = member.select("doc_id", "comp").distinct().join(own, "doc_id")
        head = own.select(F.col("doc_id").alias("comp"), F.col("n").alias("dn"), F.col("bits").alias("db"))
        return every.join(head, "comp").groupBy("comp").agg(F.first("db").alias("db"), F.max(apart("bits", "db")).alias("far"), F.min("n").alias("lo"), F.max("n").alias("hi"))

    def crossing(member: DataFrame) -> DataFrame:
        """(a, b): documents of different components in a bucket of member (sig, doc_id, comp, need) that may link."""
        sides = cut(member.select("sig", "comp").distinct().join(cut(delegates(member)), "comp"))
        p, q = sides.alias("p"), sides.alias("q")
        able = (F.col("p.comp") != F.col("q.comp")) & (100 * F.least("p.hi", "q.hi") >= percent * F.greatest("p.lo", "q.lo"))
        reach = apart("p.db", "q.db") - F.col("p.far") - F.col("q.far") <= most("p.hi", "q.hi")
        # a row for each component of a bucket that has a partner there, not for each pair
        open_ = p.join(q, (F.col("p.sig") == F.col("q.sig")) & able & reach, "left_semi").select("sig", "comp")
        full = member.join(open_, ["sig", "comp"], "left_semi")
        shared = full.groupBy("doc_id").agg(F.collect_list("sig").alias("sigs")).select("doc_id", F.when(F.size("sigs") <= LISTED, F.col("sigs")).alias("sigs"))
        full = cut(full.join(shared, "doc_id").join(own, "doc_id"))
        x, y = full.alias("x"), full.alias("y")
        fit = (F.col("x.comp") < F.col("y.comp")) & (100 * F.least("x.n", "y.n") >= percent * F.greatest("x.n", "y.n")) & (apart("x.bits", "y.bits") <= most("x.n", "y.n"))
        need = F.when(F.col("x.n") <= F.col("y.n"), F.col("x.need")).otherwise(F.col("y.need")) - most("x.n", "y.n")
        # a row in one of the pair's buckets only, if it has enough of them; in all where a list is missing
        both = F.array_intersect("x.sigs", "y.sigs")
        once = both.isNull() | ((F.size(both) >= need) & (F.array_min(both) == F.col("x.sig")))
        pairs = x.join(y, (F.col("x.sig") == F.col("y.sig")) & fit & once).groupBy(F.col("x.doc_id").alias("p"), F.col("y.doc_id").alias("q"))
        pairs = pairs.agg(F.count(F.lit(1)).alias("c"), F.first(F.when(both.isNull(), need).otherwise(1)).alias("need")).where("c >= need")
        return pairs.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"))

    def closed(buckets: DataFrame, links: DataFrame, skipped: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
        """(links, crowd): all links that a bucket's members can add to the components so far; the signatures that too many components share.

        skipped: (doc_id, skip) of the segments that have no signature in buckets.
        """
        star = buckets.where("pivot <> doc_id").groupBy(F.col("pivot").alias("a"), F.col("doc_id").alias("b")).agg(F.count("*").alias("c"))
        best = star.groupBy("b").agg(F.max_by("a", F.struct("c", -F.col("a"))).alias("a")).select("a", "b")
        links = cut(links.unionByName(verified(best)).distinct())
        turn = 0
        while True:
            member = placed(buckets.select("sig", "doc_id"), components(links))
            mixed = member.groupBy("sig").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi")
            member = cut(member.join(mixed.select("sig"), "sig", "left_semi"))
            if turn == STARS or member.isEmpty():
                break
            # one pair a document: with the leader, drawn anew each turn, of a bucket that it shares with another component
            lead = member.groupBy("sig").agg(F.min_by(F.struct("doc_id", "comp"), F.xxhash64("doc_id", F.lit(turn))).alias("lead"))
            met = member.join(lead, "sig").where(F.col("comp") != F.col("lead.comp")).groupBy(F.col("doc_id").alias("b"), F.col("lead.doc_id").alias("a")).agg(F.count(F.lit(1)).alias("c"))
            new = verified(met.groupBy("b").agg(F.max_by("a", F.struct("c", -F.col("a"))).alias("a")).select("a", "b"))
            if new.isEmpty():
                break
            links = cut(links.unionByName(new).distinct())
            turn += 1
        crowd = cut(member.groupBy("sig", "comp").agg(F.first("comp").alias("one")).groupBy("sig").count().where(F.col("count") > hot).select("sig"))
        met = member.join(crowd, "sig", "left_semi").groupBy("doc_id").agg(F.count(F.lit(1)).alias("unused"))
        # a linked pair shares all but H of the smaller set's segments, less those that are not compared
        some = member.join(crowd, "sig", "left_anti").join(met, "doc_id", "left").join(own.select("doc_id", "live"), "doc_id")
        missing = F.coalesce("unused", F.lit(0))
        if skipped is not None:
            some = some.join(skipped.select("doc_id", F.size("skip").alias("without")), "doc_id", "left")
            missing = missing + F.coalesce("without", F.lit(0))
        some = cut(some.select("sig", "doc_id", "comp", (F.col("live") - missing).alias("need")))
        if not some.isEmpty():
            links = cut(links.unionByName(verified(crossing(some))).distinct())
        return links, crowd

    exploded = lambda x: x.where("doc_id is not null").select("doc_id", F.explode("sigs").alias("sig"))
    buckets = buckets_of(exploded(sets.join(spare, "doc_id", "left_anti")))
    links, crowd = closed(buckets, links_of_copies)
    # signatures that too many components share still: neighbourhoods instead, until none is new
    skips = None
    while not crowd.isEmpty():
        hit = buckets.join(crowd, "sig", "left_semi").groupBy("doc_id").agg(F.collect_set("sig").alias("hot"))
        where = cut(rows.join(hit, "doc_id").select("doc_id", "text", "hot").mapInArrow(lean(_where(k, percent)), "doc_id long, skip array<long>, short array<long>"))
        # documents whose other segments cannot make up for these: against the components of the bucket, by their delegates first
        short = cut(where.select("doc_id", F.explode("short").alias("sig")).distinct())
        if not short.isEmpty():
            comp = components(links)
            member = cut(placed(buckets.join(short.select("sig").distinct(), "sig", "left_semi").select("sig", "doc_id"), comp))
            sides = cut(member.select("sig", "comp").distinct().join(cut(delegates(member)), "comp"))
            asked = cut(placed(short, comp).join(own, "doc_id").select("sig", F.col("doc_id").alias("q"), F.col("comp").alias("cq"), F.col("n").alias("nq"), F.col("bits").alias("bq")))
            x, y = asked.alias("x"), sides.alias("y")
            able = (F.col("x.sig") == F.col("y.sig")) & (F.col("cq") != F.col("y.comp")) & (100 * F.least("nq", "hi") >= percent * F.greatest("nq", "lo")) & (apart("bq", "db") - F.col("far") <= most("nq", "hi"))
            open_ = y.join(x, able, "left_semi").select("sig", "comp")
            full = member.join(open_, ["sig", "comp"], "left_semi").join(own, "doc_id").alias("y")
            fit = (F.col("cq") != F.col("y.comp")) & (100 * F.least("nq", "n") >= percent * F.greatest("nq", "n")) & (apart("bq", "bits") <= most("nq", "n"))
            near = x.join(y, able, "left_semi").alias("x").join(full, (F.col("x.sig") == F.col("y.sig")) & fit)
            rest = cut(near.select(F.least("q", "doc_id").alias("a"), F.greatest("q", "doc_id").alias("b")).distinct())
            links = cut(links.unionByName(verified(rest)).distinct())
        new = where.where(F.size("skip") > 0).select("doc_id", "skip")
        if new.isEmpty():
            break
        skips = cut(new if skips is None else skips.unionByName(new).groupBy("doc_id").agg(F.array_distinct(F.flatten(F.collect_list("skip"))).alias("skip")))
        again = rows.join(skips, "doc_id").select("doc_id", "text", "skip")
        buckets = buckets_of(exploded(again.mapInArrow(lean(_signatures_without(k, percent)), "doc_id long, sigs array<long>")))
        links, crowd = closed(buckets, links, skips)
    comp = components(links)
    return sets.select("doc_id", "n_shingles").join(comp.select(F.col("node").alias("doc_id"), "component"), "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, k: int = 5, percent: int = 80, small: int = 100_000) -> DataFrame:
    """docs with their own columns, of each component only the document with the smallest id.

    Documents without words and rows with a null id stay; of repeated rows one stays. The ids that
    go are broadcast only if there are at most `small` of them. What the join has checkpointed is deleted when the ids are known; no other
    operator of the session may make checkpoints meanwhile.
    """
    spark = docs.sparkSession
    shared_folder(spark)
    before = checkpoints(spark)
    found = ngram_jaccard_components(docs, k=k, percent=percent)
    made = checkpoints(spark) - before
    gone = cut(found.where("component_id <> doc_id").select("doc_id").distinct())
    beside = F.broadcast if gone.count() <= small else (lambda x: x)
    kept = docs.join(beside(gone), "doc_id", "left_anti").select(*docs.columns)
    twice = cut(found.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id"))
    delete(spark, made)
    if twice.isEmpty():
        return kept
    # rows that share an id: one of those that are wholly alike
    again = kept.join(twice, "doc_id", "left_semi").dropDuplicates([c for c in docs.columns])
    return kept.join(twice, "doc_id", "left_anti").select(*docs.columns).unionByName(again.select(*docs.columns))
