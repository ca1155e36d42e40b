"""Operators of the pipeline against brute force on small tables, and their edge cases."""

from __future__ import annotations

import hashlib
import os
import random
import re
import subprocess
import sys
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from granary.llm import contamination, imatch, linedup, mixing, ngram_join, pii_bootstrap, preference, pseudo_lm, quality_fm, sample, sql, tokens, toxicity_crf
from tests.oracle import rows_of_duck, rows_of_spark

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def frame(spark, texts, source="s"):
    rows = [(i, t, "en", source, len(t) if t is not None else None) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


EDGES = [None, "", " \n\t", "one", "two words", "x" * 20_000, "Ünï 😀 \x00 weird", "one"]


@pytest.fixture(scope="module")
def corpus():
    """Texts with exact and near copies, a shared passage and edge cases."""
    rng = random.Random(5)
    passage = words(rng, 60)
    texts = list(EDGES)
    for i in range(40):
        w = words(rng, rng.randrange(4, 160))
        if i % 5 == 0:
            w += passage
        texts.append(" ".join(w))
        if i % 3 == 0:
            for _ in range(rng.randrange(1, 4)):
                v = list(w)
                for _ in range(rng.randrange(0, 3)):
                    v[rng.randrange(len(v))] = "changed"
                texts.append(" ".join(v))
    return texts


def sets_of(texts, k):
    out = []
    for t in texts:
        w = (t or "").encode().lower().split()
        out.append({tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    return out


def components_of(sets, percent):
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            same = len(sets[i] & sets[j])
            if same and 100 * same >= percent * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return [find(i) for i in range(len(sets))]


@pytest.mark.parametrize(("k", "percent", "hot"), [(4, 85, 256), (5, 80, 256), (4, 85, 2)])
def test_ngram_components(spark, corpus, k, percent, hot):
    got = ngram_join.ngram_jaccard_components(frame(spark, corpus), k=k, percent=percent, hot=hot).orderBy("doc_id").collect()
    sets = sets_of(corpus, k)
    assert [r.n_shingles for r in got] == [len(s) for s in sets]
    assert [r.component_id for r in got] == components_of(sets, percent)


def test_segments_lose_no_pair():
    """Every linked pair shares a signature, at the edge of the threshold too."""
    rng = np.random.default_rng(1)
    for size in (5, 6, 7, 9, 13, 20, 40, 90, 300):
        for _ in range(30):
            base = rng.integers(0, 2**63, size * 2, dtype=np.uint64)
            a = np.unique(base[:size])
            for drop in range(size // 4):
                for add in range(size // 4):
                    b = np.unique(np.concatenate((a[drop:], base[size : size + add])))
                    if len(b) and 100 * (len(a) - drop) >= 85 * (len(a) + add):
                        assert np.intersect1d(ngram_join.signatures(a, 85), ngram_join.signatures(b, 85)).size


def test_crowded_sets_lose_no_pair():
    """Pairs all of whose codes lie in one segment of the first cut."""
    rng = np.random.default_rng(3)
    for size in (9, 14, 16, 18, 40):
        for _ in range(40):
            a = np.unique(rng.integers(0, 2**33, size, dtype=np.uint64))
            b = np.unique(np.concatenate((a[1:], rng.integers(0, 2**33, 1, dtype=np.uint64))))
            if 100 * (len(a) - 1) >= 85 * (len(a) + 1):
                assert np.intersect1d(ngram_join.signatures(a, 85), ngram_join.signatures(b, 85)).size


@pytest.mark.parametrize(("hot", "listed"), [(3, 128), (4096, 128), (4096, 5), (4096, 0)])
def test_one_bucket_of_many(spark, monkeypatch, hot, listed):
    """A long passage that all documents share and two large groups of near copies, with signatures crowded from the first pass on."""
    monkeypatch.setattr(ngram_join, "LISTED", listed)
    rng = random.Random(11)
    passage = words(rng, 40, 10_000)
    heads = [words(rng, 25, 10_000) for _ in range(2)]
    texts = []
    for i in range(240):
        own = list(heads[i % 2]) if i < 160 else words(rng, 25, 10_000)
        if i < 160:
            own[rng.randrange(25)] = f"v{i}"
        texts.append(" ".join(own + passage))
    got = {r.doc_id: r.component_id for r in ngram_join.ngram_jaccard_components(frame(spark, texts).repartition(6), hot=hot).collect()}
    assert [got[i] for i in range(len(texts))] == components_of(sets_of(texts, 4), 85)


def test_functions_load_without_the_package(tmp_path):
    """Executors have no copy of the package: what they run must load where it cannot be imported."""
    made = [ngram_join._sets(4, 85), ngram_join._signatures_without(4, 85), ngram_join._where(4, 85), ngram_join._verify(4, 85)]
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    for run in made:
        load = subprocess.run([sys.executable, "-c", "import pickle, sys; pickle.load(sys.stdin.buffer)"], input=cloudpickle.dumps(run), cwd=tmp_path, env=env, capture_output=True, check=False)
        assert load.returncode == 0, load.stderr.decode()


def test_ngram_null_ids_and_empty_table(spark):
    df = spark.createDataFrame([(None, "a b c d"), (1, "a b c d"), (2, "a b c d"), (2, "a b c d")], "doc_id long, text string")
    got = sorted(((r.doc_id is None, r.doc_id or 0), r.component_id) for r in ngram_join.ngram_jaccard_components(df).collect())
    assert got == [((False, 1), 1), ((False, 2), 1), ((False, 2), 1), ((True, 0), None)]
    assert ngram_join.ngram_jaccard_components(df.limit(0)).count() == 0
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in ngram_join.one_of_each(df).collect()) == [(False, 1), (True, 0)]


def test_tokens_equal_split():
    t = tokens.Tokeniser()
    texts = [b"", b" A  b\x0bA\n", b"x", "é é".encode()]
    codes, bounds, (first,) = t.codes(texts, (1,))
    flat = [w.lower() for x in texts for w in x.split()]
    assert np.diff(bounds).tolist() == [len(x.split()) for x in texts]
    assert len({int(c) for c in codes}) == len(set(flat)) and codes[0] == codes[2]
    assert len({int(c) for c in first}) == len({w[:1] for w in flat})


def run_lines(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return {(r.doc_id, r.text): (r.text_kept, r.lines_gone, r.emptied) for r in linedup.dedup_lines(df, 5).collect()}


def test_line_dedup_by_hand(spark):
    got = run_lines(spark, [(1, "a b\nc d e\nf"), (2, "z\na b\nc d e\nq"), (3, "a b\nzz"), (4, "a b\nc d e\nf"), (5, None), (6, ""), (None, "a b\nc d e")])
    # the null id is the earliest document
    assert got[(None, "a b\nc d e")] == ("a b\nc d e", 0, False)
    assert got[(1, "a b\nc d e\nf")] == ("f", 2, False)
    assert got[(2, "z\na b\nc d e\nq")] == ("z\nq", 2, False)
    assert got[(3, "a b\nzz")][1] == 0
    assert got[(4, "a b\nc d e\nf")] == ("", 3, True)
    assert got[(5, None)] == (None, 0, False) and got[(6, "")] == ("", 0, False)


def test_line_dedup_takes_the_longest_earlier_run(spark):
    a = "one two three four five"
    got = run_lines(spark, [(1, f"{a}\nb"), (2, f"{a}\nc\nd"), (3, f"{a}\nc\nd\nz z2")])
    assert [v[0] for _, v in sorted(got.items())] == [f"{a}\nb", "c\nd", "z z2"]
    x, y = " ".join(f"x{i}" for i in range(60)), " ".join(f"y{i}" for i in range(10))
    df = spark.createDataFrame([(1, x), (2, f"{x}\n{y}"), (3, f"{x}\n{y}")], "doc_id long, text string")
    assert [(r.text_kept, r.emptied) for r in linedup.dedup_lines(df).orderBy("doc_id").collect()] == [(x, False), (y, False), ("", True)]


def brute_lines(texts, min_words):
    """The indexes of lines to delete by comparing all places with each other."""
    lines = [[(i, x, len(x.split())) for i, x in enumerate(t.split("\n")) if x.split()] for t in texts]
    gone = [set() for _ in texts]
    for d, mine in enumerate(lines):
        for p in range(len(mine)):
            for e in range(d + 1):
                for q in range(len(lines[e]) if e < d else p):
                    n = 0
                    while p + n < len(mine) and q + n < len(lines[e]) and mine[p + n][1] == lines[e][q + n][1]:
                        n += 1
                    if sum(x[2] for x in mine[p : p + n]) >= min_words:
                        gone[d] |= {x[0] for x in mine[p : p + n]}
    return gone


@pytest.mark.parametrize("min_words", [1, 4, 9])
def test_line_dedup_equals_brute_force(spark, min_words):
    rng = random.Random(min_words)
    # few different lines, so runs nest, overlap their source and share prefixes with several documents
    texts = ["\n".join(" ".join(["ab"[rng.randrange(2)]] * rng.choice((0, 1, 1, 2, 5))) for _ in range(rng.randrange(0, 16))) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    want = brute_lines(texts, min_words)
    for r in linedup.dedup_lines(df, min_words).collect():
        assert r.lines_gone == len(want[r.doc_id]) and r.text_kept == "\n".join(x for i, x in enumerate(texts[r.doc_id].split("\n")) if i not in want[r.doc_id]), (r, want[r.doc_id])


def test_joins_with_a_frequent_key(spark):
    from granary.llm.common import join_unique

    rows = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"), "id").cache()
    keyed = spark.range(0, 3000, 2).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    for how in ("inner", "left"):
        want = sorted(map(tuple, rows.join(keyed, "k", how).collect()), key=str)
        assert sorted(map(tuple, join_unique(rows, keyed, ["k"], how, small=10, share=10, least=5).collect()), key=str) == want


def test_line_dedup_equals_sql(spark):
    import duckdb

    rng = random.Random(3)
    lines = [" ".join(words(rng, rng.randrange(1, 30))) for _ in range(25)]
    texts = ["\n".join(rng.choice(lines) if rng.random() < 0.8 else " ".join(words(rng, 5)) for _ in range(rng.randrange(0, 14))) for _ in range(60)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    c = duckdb.connect()
    c.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    c.executemany("INSERT INTO documents VALUES (?, ?)", list(enumerate(texts)))
    got = linedup.dedup_lines(df).select("doc_id", F.col("lines_gone").cast("long").alias("lines_gone"), "text_kept", "emptied")
    assert rows_of_spark(got) == rows_of_duck(c, sql.ORACLE["op3_line_dedup"])


def test_line_dedup_empty_and_extra_columns(spark):
    df = spark.createDataFrame([(1, "a", "x")], "doc_id long, text string, text_kept string")
    assert linedup.dedup_lines(df).columns == ["doc_id", "text", "text_kept", "lines_gone", "emptied"]
    assert linedup.dedup_lines(df.limit(0)).count() == 0
    assert linedup.without_repeats(df.select("doc_id", "text")).collect()[0].text == "a"


def fill(sizes):
    """Water-filling by hand: sources in order with weights 1, 2, 3."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: i % 3 + 1 for i, s in enumerate(names)}
    total, out, open_ = sum(sizes.values()), {}, set(names)
    while open_:
        left = total - sum(out.values())
        level = left / sum(w[s] for s in open_)
        full = [s for s in open_ if level * w[s] > 3 * sizes[s]]
        if not full:
            return out | {s: level * w[s] for s in open_}
        for s in full:
            out[s] = 3.0 * sizes[s]
            open_.discard(s)
    return out


def test_mixing(spark):
    rng = random.Random(9)
    rows = [(i, " ".join(words(rng, rng.randrange(0, 60))), rng.choice(["b", "a", "c", None, "d"]) if i > 20 else "rare") for i in range(1500)]
    rows += [(2000, None, "a"), (2001, "", "zero"), (None, "some words here", "a"), (None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(df).collect()
    assert len(got) == len(rows)
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    want, taken, largest = fill(sizes), defaultdict(int), defaultdict(int)
    for r in got:
        assert r.mix_target == pytest.approx(want[r.source]) and r.mix_source_size == sizes[r.source]
        assert 0 <= r.mix_taken <= 3 * r.mix_size and r.mix_taken == r.mix_copies * r.mix_size
        taken[r.source] += r.mix_taken
        largest[r.source] = max(largest[r.source], r.mix_size)
    for s, t in want.items():
        assert abs(taken[s] - t) <= largest[s]
    again = sorted(map(repr, mixing.mix(df.repartition(7)).collect()))
    assert again == sorted(map(repr, got))
    assert mixing.mix(df.limit(0)).count() == 0


def test_next_document(spark, monkeypatch):
    texts = ["abcdef", "", None, "xyz" * 5, "abcdef", "😀😀😀é"]
    ids = [3, 10_000, -5, 7, 70_000_000, 8]
    df = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string")
    got = {r.doc_id: r for r in imatch.edited_likeness(df).collect()}
    order = sorted(range(len(ids)), key=lambda i: -ids[i])
    for at, i in enumerate(order):
        t, n = texts[i] or "", texts[order[(at + 1) % len(order)]] or ""
        m = len(t) // 3
        e = t[: len(t) - m] + n[:m]
        assert got[ids[i]].edited_sha256 == hashlib.sha256(e.encode()).hexdigest() and got[ids[i]].n_chars == len(t)
        assert 0 <= got[ids[i]].near_edited <= 1 and 0 <= got[ids[i]].near_next <= 1
    assert got[3].fingerprint == got[70_000_000].fingerprint and got[3].fingerprint != got[7].fingerprint


def test_a_row_moves_once_to_meet_its_next(spark):
    rng = random.Random(4)
    texts = [rng.randbytes(10_000).hex() for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").localCheckpoint()
    most = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    written = lambda: spark._jsc.sc().statusStore().executorList(True).apply(0).totalShuffleWrite()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        begun = written()
        got = imatch.with_next(df, ["text"], width=20, task=500_000).collect()
        moved = written() - begun
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", most)
    assert {r.doc_id: r.next_text for r in got} == {i: texts[(i - 1) % 200] for i in range(200)}
    # every text once, and twice the ten behind the ends of ranges
    assert moved < 1.2 * sum(map(len, texts))


def test_following_by_ranges(spark):
    ids = [5, 1, 900, 901, 12_345, -70, 64]
    got = {r.key: r.next for r in imatch._following(spark.createDataFrame([(i,) for i in ids], "key long"), 3).collect()}
    down = sorted(ids, reverse=True)
    assert got == dict(zip(down, [*down[1:], None], strict=True))


def test_fingerprints_tell_edits_from_strangers(spark):
    rng = random.Random(2)
    texts = [" ".join(words(rng, 120, 3000)) for _ in range(80)]
    got = imatch.edited_likeness(frame(spark, texts)).agg(F.avg("near_edited").alias("e"), F.avg("near_next").alias("n")).first()
    assert got.e > 0.15 > got.n
    assert imatch.imatch(frame(spark, [])).count() == 0


def test_terms_outside_the_band_do_not_count(spark):
    # 160,000 words that one document of 20 has each, and ten that eight or all documents have
    texts = [" ".join([f"r{i}x{j}" for j in range(8000)] + [f"b{j}" for j in range(10) if i < 8 or j < 3]) for i in range(20)]
    got = {r.doc_id: r.fingerprint for r in imatch.imatch(frame(spark, texts), low=0.1, high=0.5).collect()}
    assert all(got[i] == got[0] for i in range(8)) and got[0].level == 0 and any(h is not None for h in got[0].hashes)


def x64(data, seed=42):
    import xxhash

    h = xxhash.xxh64_intdigest(data, seed)
    return h - (1 << 64) if h >> 63 else h


def brute_fingerprints(texts, low, high):
    """Fingerprints by plain loops: the band from document frequencies, sorted terms, sub-lexicons of two levels."""
    of = lambda t: {x64(w.lower().encode()) for w in re.findall(r"[^\x20\x09-\x0D]+", t)}
    df = Counter(x for t in texts for x in of(t))
    band = {x for x, c in df.items() if low * len(texts) <= c <= high * len(texts)}
    long_ = lambda v: (v & (1 << 64) - 1).to_bytes(8, "little")

    def one(text):
        every = sorted(of(text))
        own = [x for x in every if x in band] or every
        level = 0
        while 16 * 4 ** (level + 1) <= len(own):
            level += 1
        hashes = []
        for up in (0, 1):
            m = 16 * 4 ** (level + up)
            for g in range(16):
                part = [x for x in own if x64(up.to_bytes(4, "little"), x64(long_(x)) & (1 << 64) - 1) % m == g]
                h = 42
                for x in part:
                    h = x64(long_(x), x64(g.to_bytes(4, "little"), h & (1 << 64) - 1) & (1 << 64) - 1)
                hashes.append(h if part else None)
        return level, hashes

    return one


def brute_likeness(a, b):
    (n, x), (m, y) = a, b
    pairs = {0: (x, y), 1: (x[:16], y[16:]), -1: (x[16:], y[:16])}.get(n - m)
    if pairs is None:
        return 0.0
    known = [(p, q) for p, q in zip(*pairs, strict=True) if p is not None or q is not None]
    return sum(p == q for p, q in known) / len(known) if known else 1.0


def test_fingerprints_equal_brute_force(spark):
    rng = random.Random(12)
    base = words(rng, 300, 900)
    texts = [*(t or "" for t in EDGES), *(" ".join(words(rng, rng.randrange(1, 200), 900)) for _ in range(40)), " ".join(base), " ".join(base[:250]), " ".join(base).upper()]
    ids = rng.sample(range(5000), len(texts))
    df = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string").repartition(5)
    low, high = 0.03, 0.3
    one = brute_fingerprints(texts, low, high)
    show = lambda f: f"{f[0]}:" + ".".join("-" if h is None else f"{h & (1 << 64) - 1:016x}"[8:] for h in f[1])
    order = sorted(range(len(ids)), key=lambda i: -ids[i])
    got = {r.doc_id: r for r in imatch.edited_likeness(df, low, high).collect()}
    for at, i in enumerate(order):
        t, n = texts[i], texts[order[(at + 1) % len(order)]]
        m = len(t) // 3
        e = t[: len(t) - m] + n[:m]
        r = got[ids[i]]
        assert r.fingerprint == show(one(t)) and r.edited_fingerprint == show(one(e))
        assert r.near_edited == pytest.approx(brute_likeness(one(t), one(e))) and r.near_next == pytest.approx(brute_likeness(one(t), one(n)))


KINDS = ("email", "ip", "card", "phone")


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        x = int(c) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def base_by_re(t):
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t):
        out.append((m.start(), 0, m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        if 14 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t):
        if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def test_personal_data_base(spark):
    rng = random.Random(4)
    bits = ["a.b+c@d-e.co.uk", "x@y", "@z.z", "1.2.3.4", "1.2.3.4.5.6.7.8", "999.1.1.1", "001.02.3.4", "4111 1111 1111 1111", "4111-1111-1111-1111", "4111111111111112", "1" * 40, "+1 (555) 123-4567", "+1--2", "++49 30 1234567", "é", "😀", " ", "\n", "a@b.c_d@e.f", ".", "-", "12", "+"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(0, 12))) for _ in range(400)] + ["9" * 60_000, "a@" * 5000, "a." * 8000 + "@b.c" + ".d" * 8000, None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for r in pii_bootstrap.personal_data(df).collect():
        want = [(s, KINDS[k], e) for s, k, e in base_by_re(texts[r.doc_id] or "")]
        assert [(x.start, x.kind, x.end) for x in r.base] == want
        assert [x for x in r.spans if x.kind in KINDS] == list(r.base)


def test_contexts_reveal_identifiers(spark):
    said = [f"user-mail: someone{i}@example.org thanks" for i in range(6)] + ["user-mail: agent007(at)example thanks", "chapter 12 begins", "plain words only"]
    got = {r.doc_id: r for r in pii_bootstrap.personal_data(frame(spark, said)).collect()}
    new = got[6].spans
    assert [(x.kind, said[6][x.start : x.end]) for x in new] == [("id", "agent007(at)example")]
    assert got[7].spans == [] and got[8].spans == []
    assert pii_bootstrap.personal_data(frame(spark, [])).count() == 0


def test_keys_reveal_others_by_two_words_of_context(spark):
    rng = random.Random(4)
    key = lambda: "".join(rng.choice("0123456789abcdef") for _ in range(39)) + "a7"
    known = [f"some {rng.choice('xyz')} token = \"{key()}\" here w{i}" for i in range(6)]
    shouted = 'AND TOKEN = "9233A8ECF7C5B09F"!! THEN'
    grouped = 'a token = "12 34 56x" end'
    plain = ["Apache License, Version 2.0.", "x is 5 and y is 7", "version 3 of it"]
    texts = [*known, shouted, grouped, *plain]
    got = {r.doc_id: [texts[r.doc_id][s.start : s.end] for s in r.spans] for r in pii_bootstrap.personal_data(frame(spark, texts)).collect()}
    assert all(len(got[i]) == 1 and len(got[i][0]) == 41 for i in range(6))
    assert got[6] == ["9233A8ECF7C5B09F"] and got[7] == ["12 34 56x"]
    assert not any(got[i] for i in (8, 9, 10))


def test_contexts_by_plain_loops(spark):
    texts = ["One, two 3 (four) five 6 7x eight", "9 a b c d 10", "no digits", "x@y", " 5 "]
    rows = frame(spark, texts).select("doc_id", pii_bootstrap.contexts(F.col("text"), pii_bootstrap._IDENT).alias("c")).collect()
    got = {r.doc_id: [tuple(c) for c in r.c] for r in rows}
    assert got[0] == [("one two", "two", "four"), ("four five", "five", "eight")]
    assert got[1] == [("", "", "a"), ("c d", "d", "")] and got[2] == [] and got[3] == [("", "", "")] and got[4] == [("", "", "")]


def brute_marginals(node, edge, start):
    n = len(node)
    p = np.zeros(n)
    total = 0.0
    for code in range(2**n):
        y = [(code >> i) & 1 for i in range(n)]
        s = start[y[0]] + sum(node[i] * y[i] for i in range(n)) + sum(edge[y[i], y[i + 1]] for i in range(n - 1))
        total += np.exp(s)
        p += np.exp(s) * np.array(y)
    return p / total


def test_chain_is_exact():
    rng = np.random.default_rng(0)
    edge, start = rng.normal(size=(2, 2)), rng.normal(size=2)
    sizes = [3, 1, 7, 5, 2]
    nodes = [rng.normal(size=n) * 2 for n in sizes]
    first = np.zeros(sum(sizes), bool)
    first[np.cumsum([0, *sizes[:-1]])] = True
    for lanes in (1, 4, 100):
        p, _, _ = toxicity_crf.chain(np.concatenate(nodes), first, edge, start, lanes)
        assert np.allclose(p, np.concatenate([brute_marginals(n, edge, start) for n in nodes]), atol=1e-9)


def test_offsets_are_code_points():
    text = "a😀 bad  wörst ok".encode()
    assert toxicity_crf.spans(text, np.array([0.1, 0.9, 0.9, 0.0])) == [(3, 13)]
    assert "a😀 bad  wörst ok"[3:13] == "bad  wörst"


def labelled_corpus(bad_word):
    rng = random.Random(8)
    texts, y = [], []
    for i in range(900):
        w = words(rng, rng.randrange(5, 60))
        label = i % 4 == 0
        if label:
            for _ in range(4):
                w.insert(rng.randrange(len(w)), bad_word(rng))
        texts.append(" ".join(w))
        y.append(int(label))
    return texts, y


def held_accuracy(got, y):
    held = [r for r in got if r.held_out]
    assert held and all(0 <= r.score <= 1 for r in got)
    return np.mean([r.predicted == y[r.doc_id] for r in held])


def test_toxicity_held_out(spark):
    texts, y = labelled_corpus(lambda r: r.choice(["nasty", "vile", "awful"]))
    labels = spark.createDataFrame([(i, v, v) for i, v in enumerate(y)], "doc_id long, quality int, toxic int")
    got = toxicity_crf.toxicity_scores(frame(spark, texts), labels).collect()
    assert held_accuracy(got, y) > 0.95
    r = next(r for r in got if y[r.doc_id])
    assert {texts[r.doc_id][s.start : s.end].split()[0] for s in r.spans} <= {"nasty", "vile", "awful"} and r.spans
    edge = toxicity_crf.toxicity_scores(frame(spark, EDGES), labels.limit(0)).collect()
    assert len(edge) == len(EDGES) and all(not r.spans for r in edge)


def test_quality_held_out(spark):
    texts, _ = labelled_corpus(lambda r: "x")
    y = [int(i % 3 > 0) for i in range(len(texts))]
    texts = [t if q else " ".join(w.upper() + "!!" for w in t.split()) for t, q in zip(texts, y, strict=True)]
    labels = spark.createDataFrame([(i, v, 0) for i, v in enumerate(y)], "doc_id long, quality int, toxic int")
    docs = frame(spark, texts)
    assert held_accuracy(quality_fm.quality_scores(docs, labels).collect(), y) > 0.97
    kept = {r.doc_id for r in quality_fm.keep_quality(docs, labels).collect()}
    assert quality_fm.keep_quality(docs, labels).columns == docs.columns
    assert np.mean([(i in kept) == bool(q) for i, q in enumerate(y)]) > 0.97
    edge = quality_fm.quality_scores(frame(spark, EDGES), labels.limit(0)).collect()
    assert all(abs(r.score - 0.5) < 0.1 for r in edge) and len(edge) == len(EDGES)


def test_pairs_in_linear_time_equal_the_double_sum():
    m = quality_fm.FactorisationMachine(8, 3, 4)
    m.w = np.random.default_rng(1).normal(size=11)
    row, bucket, value = np.array([0, 0, 1]), np.array([1, 5, 2]), np.array([0.5, 2.0, 1.0])
    dense = np.array([[1.0, -2.0, 0.5], [0.0, 1.0, 2.0]])
    got = m.raw(row, bucket, value, dense)
    for i in range(2):
        x = np.zeros(11)
        x[bucket[row == i]] = value[row == i]
        x[8:] = m._dense(dense)[i]
        want = m.w0 + m.w @ x + sum(m.v[a] @ m.v[b] * x[a] * x[b] for a in range(11) for b in range(a))
        assert got[i] == pytest.approx(want)


def test_held_out_by_checksum(spark):
    import zlib

    got = spark.range(50).select("id", sample.held_out(F.col("id")).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 3 == 1) for r in got)


def lm(docs, classes, own, listed, hidden, per=2_000_000):
    rows = docs.select("doc_id", "text")
    counts = pseudo_lm.count_words(rows, classes - own).cache()
    voc = pseudo_lm.vocabulary_of(counts, classes, own, listed)
    return voc, pseudo_lm.fit_network(rows, voc, counts.agg(F.sum("n")).first()[0], hidden, per)


def test_pseudo_likelihood_by_hand(spark):
    rng = random.Random(6)
    texts = [" ".join(("left right" if rng.random() < 0.8 else "right left") + f" n{rng.randrange(40)}" for _ in range(30)) for _ in range(120)] + list(EDGES)
    docs = frame(spark, texts)
    voc, net = lm(docs, 16, 8, 20, 8)
    n, got = pseudo_lm.score_texts([(t or "").encode() for t in texts], net, tokens.Tokeniser())
    # a text's score is the sum over its tokens in plain loops: the class, each choice on the way to the leaf, the share there
    for k in (0, 3, 120, 124):
        c, leaf, context, log, _ = voc.entries([(texts[k] or "").encode()], tokens.Tokeniser())
        total = 0.0
        for i in range(len(c)):
            at = [context[i + p] if 0 <= i + p < len(c) else sum(pseudo_lm.CONTEXT) for p in pseudo_lm.WINDOW]
            h = np.tanh(net.b + sum(net.e[p][x] for p, x in enumerate(at)))
            z = h @ net.w + net.u
            total += float(z[c[i]] - np.log(np.exp(z).sum()) + log[i])
            if leaf[i] >= 0:
                at_node, base = 1, (c[i] - voc.first) << voc.depth
                for j in range(voc.depth):
                    right = leaf[i] >> (voc.depth - 1 - j) & 1
                    s = float(h @ net.t[base + at_node] + net.c[base + at_node])
                    total -= np.log1p(np.exp(-s if right else s))
                    at_node = 2 * at_node + right
        assert got[k] == pytest.approx(total, abs=1e-3) and n[k] == len((texts[k] or "").split())
    c, leaf, context, _, bounds = voc.entries([t.encode() for t in texts[:120]], tokens.Tokeniser())
    fresh = pseudo_lm.Network(voc, 8)
    fresh.w[:] = 0
    x = net.windows(context, bounds)
    assert net.log_probabilities(x, c, leaf).mean() > fresh.log_probabilities(x, c, leaf).mean() + 0.2
    rows = {r.doc_id: r for r in pseudo_lm.pseudo_likelihood(docs).collect()}
    assert rows[121].n_tokens == 0 and rows[121].pll == 0.0 and rows[121].pll_mean is None
    assert pseudo_lm.pseudo_likelihood(docs.limit(0)).count() == 0


def test_probabilities_of_all_words_sum_to_one(spark):
    rng = random.Random(2)
    texts = [" ".join(f"x{int(60 * rng.random() ** 2)}" for _ in range(30)) for _ in range(60)]
    voc, net = lm(frame(spark, texts), 12, 6, 10_000, 4)
    every = sorted({w for t in texts for w in t.split()})
    c, leaf, _, log, _ = voc.entries([" ".join(every).encode()], tokens.Tokeniser())
    x = np.repeat(np.array([[3, 0, 200, 256]]), len(every), axis=0)
    # a share is kept for words that the corpus has not seen
    assert 0.75 < np.exp(net.log_probabilities(x, c, leaf) + log).sum() <= 1 + 1e-4


def test_pseudo_likelihood_does_not_depend_on_partitions(spark):
    rng = random.Random(8)
    docs = frame(spark, [" ".join(f"x{int(60 * rng.random() ** 2)}" for _ in range(rng.randrange(5, 40))) for _ in range(200)])
    one, many = ({r.doc_id: r.pll for r in pseudo_lm.pseudo_likelihood(docs.repartition(k), 16, 8, 30, 8, 500).collect()} for k in (1, 40))
    assert len(one) == 200 and one == pytest.approx(many, rel=1e-4)


def test_words_that_are_not_listed_have_their_own_counts(spark):
    rng = random.Random(8)
    texts = [" ".join(f"x{int(60 * rng.random() ** 2)}" for _ in range(rng.randrange(5, 40))) for _ in range(80)]
    docs = frame(spark, [*texts, *texts[:10], *EDGES])
    voc, net = lm(docs, 16, 0, 10_000, 8)
    _, want = pseudo_lm.score_texts([t.encode() for t in texts], net, tokens.Tokeniser())
    counts = pseudo_lm.count_words(docs, 16).cache()
    bare = pseudo_lm.vocabulary_of(counts, 16, 0, 0)
    assert len(bare.codes) == 0 and len(voc.codes) > 50
    gains = {r.key: r.gain for r in pseudo_lm.rare_gains(docs, counts, bare).collect()}
    keys = {r.doc_id: r.k for r in docs.select("doc_id", F.xxhash64("text").alias("k")).collect()}
    for i in range(80):
        _, _, _, a, _ = voc.entries([texts[i].encode()], tokens.Tokeniser())
        _, _, _, b, _ = bare.entries([texts[i].encode()], tokens.Tokeniser())
        assert b.sum() + gains[keys[i]] == pytest.approx(a.sum(), abs=1e-6)


def test_listed_words_are_found_by_their_first_bits():
    rng = np.random.default_rng(5)
    # many codes with the same 16 bits, both ends of the range, and codes that are not listed
    codes = np.unique(np.concatenate((rng.integers(0, 1 << 64, 300, np.uint64), np.uint64(7 << 48) + rng.integers(0, 99, 40).astype(np.uint64), np.array([0, (1 << 64) - 1], np.uint64))))
    for listed in (codes, codes[::2], codes[:1]):
        v = pseudo_lm.Vocabulary(listed, np.ones(len(listed)), 2, np.zeros((4, 2)), 4, 1)
        assert np.array_equal(v.codes[v.find(codes)] == codes, np.isin(codes, listed))


@pytest.mark.parametrize("hidden", [5, 6])
def test_a_step_of_training_follows_the_gradient(hidden):
    rng = np.random.default_rng(7)
    codes = rng.integers(0, 1 << 64, 50, np.uint64)
    v = pseudo_lm.Vocabulary(codes, np.arange(50.0, 0, -1), 4, np.zeros((16, 2)), 6, 3)
    n, rows = 40, sum(pseudo_lm.CONTEXT) + 1
    x, y = rng.integers(0, rows, (n, 4)), rng.integers(0, 6, n)
    x[:, 1] = 3
    leaf = np.where(y < 4, -1, (y - 4 << 3) + rng.integers(0, 8, n))
    net = pseudo_lm.Network(v, hidden)
    net.t += rng.normal(0, 0.3, net.t.shape).astype(np.float32)
    old = {k: getattr(net, k).astype(float) for k in net.PARTS}
    net.train(x, y, leaf, net.fresh_state(), 1)
    grads = {k: np.zeros_like(g) for k, g in old.items()}
    for i in range(n):
        h = np.tanh(old["b"] + sum(old["e"][p][x[i, p]] for p in range(4)))
        z = np.exp(h @ old["w"] + old["u"])
        z = z / z.sum() - (np.arange(6) == y[i])
        dh = old["w"] @ z
        grads["u"] += z
        grads["w"] += np.outer(h, z)
        if leaf[i] >= 0:
            node, right = (leaf[i] >> 3 << 3) + (2 | (leaf[i] & 7) >> 2), (leaf[i] >> 1) & 1
            err = 1 / (1 + np.exp(-(h @ old["t"][node] + old["c"][node]))) - right
            grads["t"][node] += err * h
            grads["c"][node] += err
            dh = dh + err * old["t"][node]
        dh = dh * (1 - h * h)
        grads["b"] += dh
        for p in range(4):
            grads["e"][p][x[i, p]] += dh
    for k in net.PARTS:
        g = grads[k] / np.sqrt(n)
        assert getattr(net, k) == pytest.approx(old[k] - 0.05 * g / np.sqrt(0.1 + g * g), abs=1e-5)
    # large logits are shifted, so that none is too large to be raised
    small = net.log_probabilities(x, y, leaf)
    net.u += 500
    assert net.log_probabilities(x, y, leaf) == pytest.approx(small, abs=1e-3)


def test_training_along_texts_equals_training_on_their_windows():
    rng = np.random.default_rng(9)
    v = pseudo_lm.Vocabulary(rng.integers(0, 1 << 64, 50, np.uint64), np.arange(50.0, 0, -1), 4, np.zeros((16, 2)), 6, 3)
    # empty texts, texts of one word, and a step that ends inside a text
    bounds = np.cumsum([0, 0, 1, 70, 0, 2, 33, 0])
    n, y = bounds[-1], rng.integers(0, 6, bounds[-1])
    context, leaf = rng.integers(0, sum(pseudo_lm.CONTEXT), n), np.where(y < 4, -1, (y - 4 << 3) + rng.integers(0, 8, n))
    a, b = pseudo_lm.Network(v, 6), pseudo_lm.Network(v, 6)
    windows = a.windows(context, bounds)
    assert a.train_along(*a.padded(context, bounds), y, leaf, a.fresh_state(), 0, size=40) == b.train(windows, y, leaf, b.fresh_state(), 0, size=40) == 3
    assert a.flat() == pytest.approx(b.flat(), abs=1e-5)
    assert a.log_probabilities_along(*a.padded(context, bounds), y, leaf) == pytest.approx(b.log_probabilities(windows, y, leaf), abs=1e-4)


def benchmark_texts(rng):
    return [" ".join(words(rng, rng.randrange(16, 60), 2000)) + ". " + " ".join(words(rng, 4, 2000)) + "." for _ in range(20)]


def test_contamination_recall_and_precision(spark):
    rng = random.Random(7)
    items, texts, want = benchmark_texts(rng), [], set()
    for i in range(300):
        w = words(rng, rng.randrange(20, 300), 2000)
        if i % 4 == 0:
            j = rng.randrange(len(items))
            own = items[j].upper().split()
            if i % 8 == 0:
                for _ in range(len(own) // 10):
                    own[rng.randrange(len(own))] = "other"
            at = rng.randrange(len(w))
            w[at:at] = own
            want.add((i, j))
        texts.append(" ".join(w))
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in contamination.contaminated(frame(spark, texts), bench, block=8).collect()}
    # every pair by brute force over all windows
    brute = set()
    for i, t in enumerate(texts):
        own = contamination.plain(t.encode()).split()
        for j, it in enumerate(items):
            x = contamination.plain(it.encode()).split()
            best = max(contamination.lcs(x, own[a : a + len(x) + 24]) for a in range(0, max(1, len(own) - len(x)), 8))
            if best >= 0.75 * len(x):
                brute.add((i, j))
    assert want <= brute
    assert len(got & brute) >= 0.95 * len(brute) and not got - want
    kept = contamination.without_contaminated(frame(spark, texts), bench)
    assert {r.doc_id for r in kept.collect()} == set(range(300)) - {i for i, _ in got} and kept.columns == DOCS.replace(" long", "").replace(" string", "").split(", ")


def brute_contamination(items, texts):
    """Every pair that passes the verification, over all windows of all texts."""
    out = set()
    for j, it in enumerate(items):
        x, last = contamination.plain(it.encode()).split(), contamination.answer(it.encode())
        for i, t in enumerate(texts):
            own = contamination.plain(t.encode()).split()
            for a in range(0, max(1, len(own) - len(x)), 8):
                w = own[a : a + len(x) + 24]
                share = contamination.lcs(x, w) / len(x)
                if share >= 0.75 or (share >= 0.55 and contamination.contains(w, last)):
                    out.add((i, j))
                    break
    return out


def test_contamination_finds_all_paraphrases(spark):
    rng = random.Random(11)
    common = [f"c{i}" for i in range(60)]
    say = lambda n: [rng.choice(common) if rng.random() < 0.6 else f"r{rng.randrange(3000)}" for _ in range(n)]
    items = [" ".join(say(rng.randrange(14, 60))) + ". " + " ".join(say(4)) + "." for _ in range(20)]
    texts = []
    for i in range(240):
        own = items[i % 20].split()
        for at in rng.sample(range(len(own) - 4), int((len(own) - 4) * (i % 6) * 0.08)):
            own[at] = rng.choice(common)
        w = say(rng.randrange(20, 200))
        at = rng.randrange(len(w))
        texts.append(" ".join(w[:at] + own + w[at:]))
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in contamination.contaminated(frame(spark, texts), bench).collect()}
    want = brute_contamination(items, texts)
    assert len(want) >= 200 and got == want


def test_contamination_of_long_items():
    rng = random.Random(17)
    items = [" ".join(words(rng, n, 3000)).encode() for n in (100, 200, 400, 900)]
    texts = [" ".join(words(rng, 300, 3000)).encode() + b" " + t + b" " + " ".join(words(rng, 77, 3000)).encode() for t in items]
    find = contamination.Searcher(list(enumerate(items)), np.random.default_rng(2).normal(size=(1 << 10, 48)), np.ones(1 << 10), 10, 0.55, 0.75, 0.55)
    # passages grow with the items, and a copy is found and counted whole
    assert {size: own.tolist() for size, own, _ in find.scales if len(own)} == {16: [0], 32: [1], 64: [2], 128: [3]}
    assert [(d, j, g) for d, j, g, _, _ in sorted(find.search(texts, tokens.Tokeniser()))] == [(i, i, n) for i, n in enumerate((100, 200, 400, 900))]


def test_rare_words_in_halves(spark, monkeypatch):
    items = [(i, f"same words in all of these items number {i} of many".encode()) for i in range(9)]
    texts = [b"before " + t + b" after" for _, t in items] + [b"", b"nothing of this"]
    find = lambda: {(d, j): (g, n) for d, j, g, n, _ in contamination.Searcher(items, np.zeros((1 << 8, 4), np.float32), np.ones(1 << 8), 8, 0.55, 0.75, 0.55).search(texts, tokens.Tokeniser())}
    whole = find()
    monkeypatch.setattr(contamination, "PAIRS", 10)
    assert find() == whole and all(whole[i, i] == (11, 11) for i in range(9))


def test_contamination_edges(spark):
    bench = spark.createDataFrame([(1, "one two three four five six seven eight nine ten"), (2, None), (3, "")], "item_id long, text string")
    got = contamination.contaminated(frame(spark, [*EDGES, "say One, two THREE four five six seven eight nine ten!"]), bench).collect()
    assert [(r.doc_id, r.item_id, r.lcs) for r in got] == [(len(EDGES), 1, 10)]
    assert contamination.contaminated(frame(spark, EDGES), bench.limit(0)).count() == 0
    assert contamination.contaminated(frame(spark, []), bench).count() == 0


def test_lcs_by_table():
    rng = random.Random(1)
    for _ in range(200):
        a, b = [bytes([rng.randrange(97, 101)]) for _ in range(rng.randrange(1, 12))], [bytes([rng.randrange(97, 101)]) for _ in range(rng.randrange(0, 15))]
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                t[i + 1][j + 1] = t[i][j] + 1 if a[i] == b[j] else max(t[i][j + 1], t[i + 1][j])
        assert contamination.lcs(a, b) == t[-1][-1]


def test_preference_by_hand(spark):
    turns = [(1, 0, "user", "hi"), (1, 1, "assistant", "yes"), (1, 2, "user", "more"), (1, 3, "assistant", "good"), (2, 0, "user", "hi"), (2, 1, "assistant", "yes"), (2, 2, "user", "more"), (2, 3, "assistant", None), (3, 0, "user", "hi")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    pairs = spark.createDataFrame([(1, 2), (1, 3), (1, 1), (1, 9)], "chosen_id long, rejected_id long")
    got = {(r.chosen_id, r.rejected_id): r for r in preference.preference_format(df, pairs).collect()}
    assert set(got) == {(1, 2), (1, 3), (1, 1)}
    r = got[(1, 2)]
    assert r.n_common == 3 and r.prompt.count("<|end|>") == 3
    assert r.chosen == "<|assistant|>\ngood\n<|end|>\n" and r.rejected == "<|assistant|>\n\n<|end|>\n"
    assert r.chosen_mask == "14:0,13:1"
    assert got[(1, 3)].rejected == "" and got[(1, 1)].n_common == 4 and got[(1, 1)].chosen == ""
    opening = preference.preference_format(df).collect()
    assert len(opening) == 1 and opening[0].n_common >= 1
    assert preference.preference_format(df.limit(0)).count() == 0
    foreign = preference.preference_rows(preference.with_foreign_replies(preference.conversations(df))).collect()
    assert sorted((r.chosen_id, r.rejected_id) for r in foreign) == [(1, 2), (2, 1)]


def test_pairs_of_a_frequent_opening(spark):
    turns = [(i, 0, "user", "hi" if i % 3 else f"u{i}") for i in range(0, 9000, 7)] + [(i, 1, "assistant", f"a{i}") for i in range(0, 9000, 7)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    pairs, alone = preference.pair_by_opening(preference.conversations(df), width=500)
    got = sorted((r.chosen_id, r.rejected_id) for r in pairs.collect())
    same = [i for i in range(0, 9000, 7) if i % 3]
    assert got == [(a, b) for a, b in zip(same[::2], same[1::2], strict=False)]
    assert alone.count() == len(range(0, 9000, 7)) - 2 * len(got)
    both = preference.preference_format(df, foreign=True)
    assert both.count() == len(got) + alone.count() and both.where("prompt = ''").count() == 0
