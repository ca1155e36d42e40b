"""Cases by hand for operators whose order, rounding or edges matter."""

from __future__ import annotations

import datetime as dt
import hashlib

import pytest
from pyspark.sql import functions as F

from granary.functions import text as T
from granary.operators import budget, chunk, evaluate, fuse, graph, ingest, logs, memory, relational, retrieve
from granary.sources import documents as sources
from granary.sources import monitoring


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'double' if isinstance(v, float) else 'long'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first().x


def test_sentences(spark):
    assert one(spark, T.sentences(F.col("t")), t="a.b!c\nd。e") == ["a.", "b!", "c", "d。", "e"]
    assert one(spark, T.sentences(F.col("t")), t="...") == [".", ".", "."]
    assert one(spark, T.sentences(F.col("t")), t="3.5") == ["3.", "5"]
    assert one(spark, T.sentences(F.col("t")), t=None) == []
    assert chunk.split_sentences("a.b!c\nd。e") == ["a.", "b!", "c", "d。", "e"]


@pytest.mark.parametrize(("given", "minutes"), [("7d", 10080), ("6h", 360), ("30m", 30), ("15", 15), ("abc", 60), (None, 60), ("", 60)])
def test_range(spark, given, minutes):
    assert one(spark, T.range_minutes(F.col("t")), t=given) == minutes


def test_masks(spark):
    assert one(spark, T.mask_message(F.col("t")), t="call 13812345678 sk-abcdef1234567890 now") == "call 138****78 sk-**** now"
    assert one(spark, T.mask_message(F.col("t")), t="138123456789012") == "138123456789012"
    assert one(spark, T.mask_secrets(F.col("t")), t='{"Password": "x"} token=abc') == '{"Password":"****"} token=****'


def test_cleaning(spark):
    assert one(spark, T.clean_txt(F.col("t")), t=" a\r\n\r\n\r\n\r\nb  ") == "a\n\nb"
    assert one(spark, T.clean_markdown(F.col("t")), t="> **b** ![alt](x) [l](y) `c`") == "b alt l c"
    assert one(spark, T.extension(F.col("t")), t="A.B.PDF") == "pdf"
    assert one(spark, T.extension(F.col("t")), t="none") == ""
    assert one(spark, T.iso_of_nanos(F.col("t")), t="1718447000123000000") == "2024-06-15T10:23:20.123Z"
    assert one(spark, T.iso_of_nanos(F.col("t")), t="bad") == "bad"
    assert one(spark, T.json_array(F.col("t")), t='x ["a"] y') == '["a"]'
    assert one(spark, T.question_kind(F.col("t")), t="什么是配置") == "CONCEPT"
    assert one(spark, T.question_kind(F.col("t")), t="如何") == "DETAIL"
    assert one(spark, T.bounded_utf16(F.col("t"), 3), t="ab😀c") == "ab"


def test_packing():
    assert [len(c) for c in chunk.pack(["aaaa", "bbb", "cc", "dddddd"], 7)] == [7, 2, 6]
    assert chunk.tail_after_sentence("aaaaaaa. b", 10) == "b"
    assert chunk.tail_after_sentence("one two. three", 10) == "two. three"
    assert chunk.tail_after_sentence("one two.", 5) == ""
    text = "First one. Second one. Third one."
    parts = chunk.semantic(text, [], "d", 22, 5)
    assert [c["content"] for c in parts] == ["First one.Second one.", "Third one."]
    assert [c["chunk_id"] for c in parts] == ["d_chunk_0", "d_chunk_1"]
    rows = chunk.semantic("", [(None, "short", 0, 0), ("t", "Another one. And more.", 1, 1)], "d", 15, 0)
    assert [(c["chunk_index"], c["total_chunks"]) for c in rows] == [(0, 1), (1, 2), (2, 2)]
    family = chunk.parent_child("p one.\n\np two.", "d", 3, 2, 0)
    assert {c["parent_id"] for c in family if c["level"] == "child"} == {"d_parent_0", "d_parent_1"}
    levels = chunk.multi("One. Two.\n\nThree.", [], "d", 100, 100, 4)
    assert {c["level"] for c in levels} == {"section", "paragraph", "sentence"}


def test_summary_index_numbers_run_on():
    # a long section is followed by another one: their ids differ
    ids = [c["chunk_id"] for c in chunk.summary_index("", [(None, "aaa\n\nbbb", 0, 0), (None, "ccc", 0, 1)], "d", 4, 2)]
    assert ids == ["d_chunk_0_summary", "d_chunk_1_summary", "d_chunk_2_summary"]


def test_model_shells():
    assert [c["content"] for c in chunk.propositions("text", "d", model=lambda t: 'so: ["One fact", " "]')] == ["One fact"]
    assert [c["content"] for c in chunk.propositions("text", "d", model=lambda t: "no")] == ["text"]
    assert chunk.propositions(None, "d") == []
    assert [c["content"] for c in chunk.contextual("t", [(None, "a", 0, 0), (None, "b", 0, 1)], "d", 5, lambda t, p: ["ctx"])] == ["ctx\na", "\nb"]
    assert chunk.segments("aaaa。bbbb", 6) == ["aaaa。", "bbbb"]


def hits(spark, rows):
    return spark.createDataFrame(rows, "query_id long, path int, rank long, id string, score double")


def test_reciprocal_rank(spark):
    lists = hits(spark, [(1, 0, 0, "a", 1.0), (1, 0, 1, "b", 0.5), (1, 1, 0, "b", 1.0), (1, 1, 1, "c", 0.5)])
    out = [(r.id, r.score) for r in fuse.reciprocal_rank(lists, 60).orderBy("rank").collect()]
    assert [i for i, _ in out] == ["b", "a", "c"]
    assert out[0][1] == pytest.approx(1 / 62 + 1 / 61, abs=1e-9)
    tied = hits(spark, [(1, 0, 0, "a", 1.0), (1, 1, 0, "b", 1.0)])
    assert [r.id for r in fuse.reciprocal_rank(tied).orderBy("rank").collect()] == ["a", "b"]
    same = hits(spark, [(1, 0, 0, "a", 3.0), (1, 0, 1, "b", 3.0)])
    assert {r.score for r in fuse.normalised(same).collect()} == {1.0}


@pytest.mark.parametrize(("n", "order"), [(8, [1, 3, 5, 7, 8, 6, 4, 2]), (7, [1, 3, 5, 7, 6, 4, 2]), (2, [1, 2])])
def test_lost_in_the_middle(spark, n, order):
    rows = spark.range(n).select(F.lit(1).alias("query_id"), F.col("id").alias("rank"))
    assert [r["rank"] + 1 for r in fuse.lost_in_the_middle(rows).orderBy("position").collect()] == order


def test_weighted_order(spark):
    rows = spark.range(10).select(F.lit(1).alias("query_id"), F.col("id").alias("rank"))
    assert [r["rank"] + 1 for r in fuse.weighted_order(rows, 0.4, 0.4).orderBy("position").collect()] == [1, 2, 3, 4, 9, 10, 5, 6, 7, 8]


def test_sentence_window(spark):
    rows = spark.createDataFrame([("a", list("abcde")), ("zz", list("abc"))], "sentence string, sentences array<string>")
    got = [(r.content, r.hit_index) for r in fuse.sentence_window(rows, 2).collect()]
    assert got == [("a\nb\nc", 0), ("zz", None)]


def test_paths(spark):
    a = spark.createDataFrame([(1, "x", 0.5, 0)], "query_id long, id string, score double, rank long")
    none = a.limit(0)
    got = retrieve.multi_path([a, none], lambda u, more: fuse.reciprocal_rank(u, limit=None, payload=more), 10).collect()
    assert [(r.id, r.score) for r in got] == [("x", 0.5)]


def test_rerank(spark):
    rows = spark.createDataFrame([(1, "a", 3.0, 0), (1, "b", 2.0, 1), (1, "c", 1.0, 2)], "query_id long, id string, score double, rank long")
    assert retrieve.rerank(rows, 3, lambda d: d.withColumn("new_score", F.lit(0.0))).count() == 3
    best = retrieve.rerank(rows, 1, lambda d: d.withColumn("new_score", -F.col("score")))
    assert [r.id for r in best.collect()] == ["c"]
    assert [r.id for r in retrieve.rerank(rows, 1).collect()] == ["a"]


def test_cosine_edges(spark):
    z = spark.createDataFrame([([0.0, 0.0], [1.0, 0.0])], "a array<double>, b array<double>")
    assert z.select(retrieve.cosine(F.col("a"), F.col("b")).alias("x")).first().x is None
    bad = spark.createDataFrame([([0.0], [1.0, 0.0])], "a array<double>, b array<double>")
    with pytest.raises(Exception, match="differ in length"):
        bad.select(retrieve.cosine(F.col("a"), F.col("b"))).collect()


def test_replay_plan(spark):
    say = lambda n, a: [(1, i, f"q{i}", a(i)) for i in range(n)]
    make = lambda rows: spark.createDataFrame(rows, "s long, t long, question string, answer string")
    got = budget.replay_plan(make(say(3, lambda i: f"a{i}")), "s", ["t"]).orderBy("position").collect()
    assert [r.question for r in got] == ["q0", "q1", "q2"] and not got[0].capped
    got = budget.replay_plan(make(say(6, lambda i: "x" * 250)), "s", ["t"], 6, 400, 200).orderBy("position").collect()
    assert [r.question for r in got] == ["q4", "q5"] and got[0].capped
    assert [r.question for r in budget.replay_plan(make(say(10, lambda i: "a")), "s", ["t"]).orderBy("position").collect()] == [f"q{i}" for i in range(4, 10)]
    assert budget.replay_plan(make([(1, 0, None, " "), (1, 1, "", None)]), "s", ["t"]).count() == 0


def test_bounds(spark):
    got = one(spark, budget.head_and_tail(F.col("t"), 200), t="A" * 120 + "M" * 120 + "Z" * 120)
    assert got.startswith("A") and got.endswith("Z") and "M" not in got and "省略" in got
    got = one(spark, budget.spill_bound(F.col("t"), 100), t="x" * 500)
    assert len(got) <= 100 and "500" in got
    assert one(spark, budget.spill_bound(F.col("t"), 100), t=None) is None


@pytest.mark.parametrize(("n", "most"), [(21, 5), (100, 5), (4, 5)])
def test_downsample(spark, n, most):
    rows = spark.range(n).select(F.lit("s").alias("series"), F.col("id").alias("t"))
    got = [r.t for r in budget.downsampled(rows, "series", ["t"], most).orderBy("point").collect()]
    step = (n - 1) / (most - 1)
    want = list(range(n)) if n <= most else [0, *[int(i * step + 0.5) for i in range(1, most - 1)], n - 1]
    assert got == want


def test_downsample_orders(spark):
    """Series of any order column, null series and null, equal and uneven places are numbered as one window would."""
    values = [None, None, 0.0, 0.0, 1.0, 1.5, 2.0, 1e9, 1e9, 5e9] * 3
    rows = spark.createDataFrame([(s, v, i) for s in ("a", None) for i, v in enumerate(values)] + [("one", None, 1)], "series string, v double, t long")
    forms = {"double": "v", "timestamp": "timestamp_seconds(v)", "date": "date_add(date'1970-01-01', cast(v / 1e7 as int))", "string": "cast(v as string)"}
    for form in forms.values():
        table = rows.selectExpr("series", f"{form} as v", "t")
        got = sorted((r.series or "", r.point, r.t) for r in budget.downsampled(table, "series", ["v", "t"], 7, 5).collect())
        want = []
        for s in ("", "a"):
            order = [r.t for r in table.where("series = 'a'").orderBy("v", "t").collect()]
            step = (len(order) - 1) / 6
            want += [(s, i, order[0 if i == 0 else len(order) - 1 if i == 6 else int(i * step + 0.5)]) for i in range(7)]
        assert got == [*want, ("one", 0, 1)]


def test_capped(spark):
    got = budget.capped(spark.range(87), [F.asc("id")], 3)
    rows = got.withColumn("note", budget.spill_note("alerts", 3)).collect()
    assert len(rows) == 3 and {r.total for r in rows} == {87} and "87" in rows[0].note


def test_last_messages(spark):
    rows = spark.createDataFrame([("s", i) for i in range(16)], "s string, t long")
    assert sorted(r.t for r in budget.last_messages(rows, "s", ["t"]).collect()) == list(range(4, 16))


def test_relational(spark):
    assert [relational.clamp_page(-5, 0), relational.clamp_page(2, 100000)] == [(1, 20), (2, 100)]
    alerts = spark.createDataFrame([(1, "odd", "active", 1), (2, "critical", "active", 1), (3, "info", "active", 2), (4, "critical", "closed", 3)], "alert_id long, severity string, status string, alert_time long")
    assert [r.alert_id for r in relational.active_alerts(alerts).collect()] == [1, 2, 3]
    r = relational.alert_statistics(alerts).first()
    assert (r.critical, r.warning, r.info, r.total) == (1, 0, 1, 2)
    bases = spark.createDataFrame([(1,), (2,)], "kb long")
    docs = spark.createDataFrame([(1, 1), (1, 1)], "kb long, deleted_flag long")
    assert sorted((r.kb, r.document_count) for r in relational.with_document_counts(bases, docs, ["kb"], F.col("deleted_flag") == 0).collect()) == [(1, 0), (2, 0)]
    with pytest.raises(ValueError):
        relational.scoped(docs, " ", "x")
    t = spark.createDataFrame([(1, "a"), (2, None)], "k long, v string")
    assert sorted((r.k, r.v) for r in relational.updated(t, F.col("v") == "a", v="b").collect()) == [(1, "b"), (2, None)]
    assert relational.deleted(t, F.col("v") == "a").count() == 1
    up = relational.upserted(t, spark.createDataFrame([(2, "n"), (3, "m")], "k long, v string"), "k", "v")
    assert sorted((r.k, r.v) for r in up.collect()) == [(1, "a"), (2, "n"), (3, "m")]
    made = relational.create_alert(alerts.select(F.lit(None).cast("string").alias("alert_id"), F.lit("closed").alias("status")).limit(1)).first()
    assert made.status == "active" and len(made.alert_id) == 32
    b, i = relational.branch_and_intent(F.lit(False), F.lit(2))
    assert one(spark, F.concat_ws(" ", b, i), x=1) == "TOOL_CALL tool_invocation"
    assert relational.admin_tenant(" ", "me") == "me"
    store = spark.createDataFrame([], "memory_id string, content string, type string, scope string, importance double, status int, created_at string")
    new = spark.createDataFrame([("m", "c", None)], "memory_id string, content string, type string")
    r = relational.insert_memory(store, new, F.lit("now")).first()
    assert (r.type, r.scope, r.importance, r.status, r.created_at) == ("FACT", "/", 0.5, 1, "now")


def test_memory(spark):
    now = dt.datetime(2024, 2, 1, 1)
    store = spark.createDataFrame([("a", [0.8, 0.6], 1, 0.5, now - dt.timedelta(days=30)), ("b", [0.54, (1 - 0.54**2) ** 0.5], 1, 1.0, now)], "memory_id string, embedding array<double>, status int, importance double, created_at timestamp_ntz")
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, query_vec array<double>")
    got = memory.recall(store, q, F.lit("2024-02-01 01:00:00").cast("timestamp_ntz")).collect()
    assert [(r.memory_id, r.composite) for r in got] == [("a", 0.65)]
    # two hours over midnight are no whole day
    assert one(spark, memory.recency(F.lit("2024-01-31 23:00:00").cast("timestamp_ntz"), F.lit("2024-02-01 01:00:00").cast("timestamp_ntz")), x=1) == 1.0
    facts = memory.parsed_facts(spark.createDataFrame([('```json\n[{"content":"long enough fact","type":"odd"},{"content":"short"}]\n```',), ('{"facts":[{"content":"another long fact","type":"EPISODE"}]}',)], "reply string"))
    assert sorted((r.content, r.type) for r in facts.collect()) == [("another long fact", "EPISODE"), ("long enough fact", "FACT")]
    assert one(spark, memory.importance_of(F.col("t")), t="about 0.7!") == 0.7
    assert one(spark, memory.importance_of(F.col("t")), t="none") == 0.5
    assert one(spark, memory.parsed_decision(F.col("t"))["action"], t='{"action":"UPDATE"}') == "KEEP"
    rows = spark.createDataFrame([("x", "h", "/", 1, 1), ("y", "h", "/", 1, 2)], "memory_id string, content_hash string, scope string, status int, created_at int")
    assert {r.memory_id: r.status for r in memory.without_duplicates(rows).collect()} == {"x": 0, "y": 1}


def test_conflicts(spark):
    schema = "memory_id string, tenant_id string, user_id string, content string, content_hash string, status int, embedding array<double>"
    store = spark.createDataFrame([("o1", "t", "u", "old", "h1", 1, [1.0, 0.0]), ("o2", "t", "u", "other", "h2", 1, [0.0, 1.0])], schema)
    new = spark.createDataFrame([("n1", "t", "u", "new", "h3", 1, [1.0, 0.01]), ("n2", "t", "v", "alien", "h4", 1, [1.0, 0.0])], schema)
    for action, want in (("UPDATE", {"o1": "new", "o2": "other", "n2": "alien"}), ("DELETE", {"o2": "other", "n1": "new", "n2": "alien"}), ("KEEP", {"o1": "old", "o2": "other", "n2": "alien"})):
        decided = memory.conflicts(new, store, lambda d, a=action: d.withColumn("action", F.lit(a)))
        assert {r.memory_id: r.content for r in memory.resolved(store, decided).collect()} == want


def test_graph(spark):
    edges = spark.createDataFrame([("1", "2"), ("2", "3"), ("3", "4")], "source_id string, target_id string")
    near = graph.k_hop(edges, spark.createDataFrame([("1",)], "entity_id string"), 2)
    assert {r.node: r.hops for r in near.collect()} == {"1": 0, "2": 1, "3": 2}
    assert sorted((r.source_id, r.target_id) for r in graph.subgraph_edges(edges, near).collect()) == [("1", "2"), ("2", "3")]
    rel = graph.resolve_relations(spark.createDataFrame([("a", "b"), ("a", "zz")], "source string, target string"), spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "entity_id long, name string"), "entity_id")
    assert [(r.source_id, r.target_id, r.confidence) for r in rel.collect()] == [(1, 3, 1.0)]
    parsed = graph.parsed_extraction(spark.createDataFrame([('```json\n{"entities":[{"name":"n","type":"T"}]}\n```',), ("bad",)], "reply string")).collect()
    assert [len(r.entities) for r in parsed] == [1, 0] and parsed[0].relations == []
    ents = spark.createDataFrame([(1, "alpha beta", "T"), (2, "beta", "T")], "entity_id long, name string, type string")
    found = graph.text_matches(ents, spark.createDataFrame([(7, "alpha beta")], "query_id long, text string"), 5).orderBy("rank").collect()
    assert [r.entity_id for r in found] == [1, 2]


def test_words_keep_their_smallest_ids(spark):
    """However many names contain a word, k ids of it go on; matches stay what comparing all gives."""
    names = {i: f"{('red', 'blue')[i % 2]} {('ring', 'bolt', 'nut')[i % 3]} {i % 50}" for i in range(600)}
    ents = spark.createDataFrame(list(names.items()), "entity_id long, name string")
    texts = {i: f"{('bolt', 'red', 'ue ri', 'none')[i % 4]} {i} nut" for i in range(80)}
    kept = graph.word_matches(ents, spark.createDataFrame([("red",), ("bolt",), ("none",)], "word string"), 4).collect()
    assert sorted((r.word, r.entity_id) for r in kept) == sorted((w, i) for w in ("red", "bolt") for i in [j for j in names if w in names[j]][:4])
    got = {(r.query_id, r.entity_id): r["rank"] for r in graph.text_matches(ents, spark.createDataFrame(list(texts.items()), "query_id long, text string"), 4).collect()}
    want = {}
    for q, t in texts.items():
        asked = [t, *[w for w in t.split() if len(w) > 1]]
        at = sorted((min(p for p, w in enumerate(asked) if w in n), i) for i, n in names.items() if any(w in n for w in asked))
        want |= {(q, i): r for r, (_, i) in enumerate(at[:4])}
    assert got == want


def test_evaluate(spark):
    rows = spark.createDataFrame([(0.9, 0.8, 0.1), (0.9, 0.8, 0.3)], "faithful double, relevant double, hallucinated double")
    assert [(r.overall, r.acceptable) for r in evaluate.answer_quality(rows).collect()] == [(0.86, True), (0.82, False)]
    assert [one(spark, evaluate.score_of(F.col("t")), t=t) for t in ("score: 1.7", "-0.4", "none")] == [1.0, 0.4, 0.5]
    assert one(spark, evaluate.hallucination_of(F.col("t")), t="9 幻觉比例：0.2") == 0.2
    usage = spark.createDataFrame([("m", 1000, 500), ("x", 10, 0), ("m", 0, 0)], "model string, prompt long, completion long")
    prices = spark.createDataFrame([("m", 0.5, 2.0)], "model string, input_per_1k double, output_per_1k double")
    assert sorted((r.model, r.cost) for r in evaluate.token_cost(usage, prices).collect()) == [("m", 1.5), ("x", 0.0)]
    said = iter(["", " ", "ok"])
    assert evaluate.guarded(lambda: next(said)) == "ok"
    assert evaluate.guarded(lambda: "x" * 501) is None
    waits, calls = [], iter([ValueError(), ValueError(), "fine"])

    def call():
        x = next(calls)
        if isinstance(x, Exception):
            raise x
        return x

    assert evaluate.guarded(call, sleep=waits.append) == "fine" and waits == [0.5, 1.0]
    assert evaluate.routed("a", ["b", " ", "a", None]) == ["a", "b"] and evaluate.routed(None, [], "d") == ["d"]
    p = evaluate.Prompts()
    p.register("n", 1, "x")
    p.register("n", 2, "y")
    assert p.get("n") == "y" and p.get("n", 1) == "x"
    with pytest.raises(ValueError):
        p.register("n", 1, "z")
    assert one(spark, evaluate.failure_kind(F.lit(429), F.lit("Quota used")), x=1) == "QUOTA"


def test_ingest(spark):
    assert one(spark, T.digest(F.col("t")), t="hello") == hashlib.sha256(b"hello").hexdigest()
    new = ingest.hashed(spark.createDataFrame([(1, "a", "t"), (2, "a", "t"), (3, "b", "t"), (4, "a", None)], "doc_id long, text string, tenant string"))
    old = ingest.hashed(spark.createDataFrame([(9, "b", "t", 0), (8, "a", "t", 1)], "doc_id long, text string, tenant string, deleted_flag long"))
    assert {r.doc_id: r.duplicate for r in ingest.split_duplicates(new, old, ["tenant"], "doc_id").collect()} == {1: False, 2: True, 3: True, 4: False}
    files = spark.createDataFrame([("a.txt", bytearray(b"x"), "text/plain; charset=utf-8"), ("a.exe", bytearray(b"x"), None), ("a.md", bytearray(b""), None)], "file_name string, content binary, mime_type string")
    assert [r.reject_reason for r in ingest.validated(files).collect()] == [None, "extension", "empty"]
    calls = []
    rows = spark.createDataFrame([("x",), ("x",), (" ",), (None,)], "content string")
    got = ingest.embedded(rows, lambda texts: [[float(len(t))] for t in texts])
    assert sorted((r.content or "-", list(r.embedding)) for r in got.collect()) == [(" ", []), ("-", []), ("x", [1.0]), ("x", [1.0])] and not calls


def test_parsers(spark):
    md = sources.parse_markdown("pre\n# One\ntext\n```\n# no heading\n```\n## Two\nmore")
    assert [(s["title"], s["level"]) for s in md["sections"]] == [(None, 0), ("One", 1), ("Two", 2)]
    assert "# no heading" in md["sections"][1]["content"]
    html = sources.parse_html("<html><head><title>T</title><meta name='a' content='b'></head><body><nav>x</nav><h1>H</h1><p>one</p><p>two</p><h2>I</h2><div class='sidebar'>s</div></body></html>")
    assert html["metadata"]["title"] == "T" and html["metadata"]["meta_a"] == "b"
    assert [(s["title"], s["content"], s["level"]) for s in html["sections"]] == [("H", "one\ntwo", 1)]
    plain = sources.parse_html("<p>long enough text to be a section</p><p>short</p>")
    assert [s["content"] for s in plain["sections"]] == ["long enough text to be a section"]
    assert sources.parse_txt("a\n\n\n b ")["sections"][1]["content"] == "b"
    assert [s["title"] for s in sources.page_sections(["a", " ", "b"])] == ["第 1 页", "第 3 页"]
    files = spark.createDataFrame([("a.md", bytearray(b"# T\nx"), None), ("a.bin", bytearray(b"plain"), None), ("a.pdf", bytearray(b"%PDF"), None)], "file_name string, content binary, mime_type string")
    got = {r.file_name: r for r in sources.parsed(files).collect()}
    assert got["a.md"].sections[0].title == "T" and got["a.bin"].text_content == "plain" and "error" in got["a.pdf"].metadata


def test_office_files():
    import io
    import zipfile

    def packed(**files):
        b = io.BytesIO()
        with zipfile.ZipFile(b, "w") as z:
            for k, v in files.items():
                z.writestr(k.replace("__", "/").replace("_x", ".x"), v)
        return b.getvalue()

    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    doc = packed(word__document_xml=f'<w:document {w}><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>H</w:t></w:r></w:p><w:p><w:r><w:t>body</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>')
    assert [(s["title"], s["content"], s["level"]) for s in sources.parse_docx(doc)["sections"]] == [("H", "body\na\tb", 1)]
    n = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    x = packed(xl__workbook_xml=f'<workbook {n}><sheets><sheet name="S"/></sheets></workbook>', xl__sharedStrings_xml=f"<sst {n}><si><t>hi</t></si></sst>", xl__worksheets__sheet1_xml=f'<worksheet {n}><sheetData><row><c t="s"><v>0</v></c><c><v>2</v></c></row></sheetData></worksheet>')
    assert sources.parse_xlsx(x)["sections"][0]["content"] == "Sheet: S\nhi\t2"


def test_monitoring(spark):
    body = '{"status":"success","data":{"result":[{"stream":{"level":"WARN"},"values":[["1718447000123000000","line"]]}]}}'
    replies = monitoring.fetched(spark, ["u", "v"], lambda u: body if u == "u" else "broken")
    r = monitoring.loki_rows(replies).collect()
    assert [(x.timestamp, x.level, x.source, x.message) for x in r] == [("2024-06-15T10:23:20.123Z", "WARN", "unknown", "line")]
    assert [x.s for x in replies.select(monitoring.reply_status(F.col("body")).alias("s")).collect()] == ["success", "error"]
    alerts = '{"status":"success","data":{"alerts":[{"labels":{"alertname":"A"},"state":"firing"}]}}'
    r = monitoring.prometheus_alerts(monitoring.fetched(spark, ["u"], lambda u: alerts)).first()
    assert (r.alert_name, r.state, r.severity, r.description) == ("A", "firing", "unknown", "")
    points = '{"data":{"resultType":"matrix","result":[{"metric":{"j":"x"},"values":[[1,"2"],[3,"4"]]},{"metric":{},"value":[5,"6"]}]}}'
    assert sorted((x.timestamp, x.value) for x in monitoring.prometheus_points(monitoring.fetched(spark, ["u"], lambda u: points)).collect()) == [("1", "2"), ("3", "4"), ("5", "6")]
    assert logs.topic_selector("system-metrics", 'a"b') == '{job="varlogs"} |= "a\\"b"' and logs.topic_selector("odd") == '{job=~".*"}'
    sample = monitoring.sample_logs(spark)
    assert logs.topic_logs(sample, "application-logs", "ERROR redis").count() == 1 and logs.topic_logs(sample, "odd").count() == 0
    assert logs.topic_logs(sample, "system-events", None, 0).count() == 3 and logs.store_limit(0) == 100
    assert "direction=backward" in monitoring.loki_url("http://h", "odd", None, 0, 1) and monitoring.sample_alerts(spark).count() == 3


def test_stream_equals_batch(spark, tmp_path):
    from granary.streaming.ingest import document_stream, start_ingest

    src = str(tmp_path / "in")
    spark.createDataFrame([(1, "One. Two."), (2, "One. Two."), (3, "Three.")], "doc_id long, text string").repartition(1).write.parquet(src)
    for _ in range(2):
        start_ingest(document_stream(spark, src, "doc_id long, text string"), str(tmp_path / "store"), str(tmp_path / "cp"), lambda t, s, n: chunk.semantic(t, s, n, 100, 0)).awaitTermination(60)
    got = spark.read.parquet(str(tmp_path / "store" / "documents"))
    assert sorted(r.doc_id for r in got.collect()) == [1, 3]
    assert spark.read.parquet(str(tmp_path / "store" / "chunks")).count() == 2
    # a later batch with a known text adds nothing
    spark.createDataFrame([(4, "Three."), (5, "Four.")], "doc_id long, text string").repartition(1).write.mode("append").parquet(src)
    start_ingest(document_stream(spark, src, "doc_id long, text string"), str(tmp_path / "store"), str(tmp_path / "cp"), lambda t, s, n: chunk.semantic(t, s, n, 100, 0)).awaitTermination(60)
    assert sorted(r.doc_id for r in spark.read.parquet(str(tmp_path / "store" / "documents")).collect()) == [1, 3, 5]


def test_any_number_of_queries(spark):
    many = spark.range(5000).select(F.col("id").alias("query_id"), F.lit("alpha").alias("text"), F.array(F.lit(1.0)).alias("query_vec"))
    ents = spark.createDataFrame([(1, "alpha")], "entity_id long, name string")
    store = spark.createDataFrame([(1, 1, [1.0], dt.datetime(2024, 2, 1), 0.5)], "memory_id long, status int, embedding array<double>, created_at timestamp_ntz, importance double")
    assert memory.recall(store, many, F.lit("2024-02-01 01:00:00").cast("timestamp_ntz")).count() == 5000
    assert graph.text_matches(ents, many, 5).count() == 5000
    assert retrieve.vector_search(store.withColumnRenamed("memory_id", "vec_id"), many, 1).count() == 5000


def edits(a, b):
    """Edit distance with swaps of neighbours, by the table."""
    d = [[i + j if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


def test_fuzzy_terms(spark):
    vocabulary = ["kitten", "kittens", "mitten", "sitten", "iktten", "kit", "sitting", "kitchen", "to", "ot", "cat", "act", "cut", "cart", "dog", "cta"]
    q = spark.createDataFrame([(1, "kitten to cat")], "query_id long, text string")
    got = {(r.asked, r.term) for r in retrieve.fuzzy_terms(q, spark.createDataFrame([(v,) for v in vocabulary], "term string")).collect()}
    assert got == {(a, v) for a, most in (("kitten", 2), ("to", 0), ("cat", 1)) for v in vocabulary if edits(a, v) <= most}


def test_near_pairs_by_tiles(spark):
    rows = [(i, 1, "k", [float(i % 7), 1.0, float(i % 3)]) for i in range(40)]
    store = spark.createDataFrame(rows, "memory_id long, status int, key string, embedding array<double>")
    import math

    cos = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True)) / math.sqrt(sum(x * x for x in a) * sum(y * y for y in b))
    want = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and cos(a[3], b[3]) > 0.95}
    got = [(r.a, r.b) for r in memory.near_pairs(store, ["key"], 0.95).collect()]
    assert set(got) == want and len(got) == len(want)


def test_a_long_series_of_local_times_has_many_spans(spark):
    """Points of one series are numbered in spans: no task of the ranking window gets all of them."""
    rows = spark.range(3000).select(F.lit("s").alias("series"), F.timestamp_add("SECOND", (F.col("id") * 37) % 3000, F.lit("2024-03-31 01:30:00").cast("timestamp_ntz")).alias("ts"), "id")
    got = budget.downsampled(rows, "series", ["ts", "id"], 20)
    ordered = sorted(((r.id * 37) % 3000, r.id) for r in rows.collect())
    want = {int(p * (2999 / 19) + 0.5) if 0 < p < 19 else 0 if p == 0 else 2999 for p in range(20)}
    assert sorted(r.id for r in got.collect()) == sorted(ordered[i][1] for i in want)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "unix_date" in plan


def test_properties_of_an_entity_that_is_told_of_often(spark):
    rows = [(i, "n", None if i % 2 else "t", f"d{i}" if i == 3 else None, {f"k{i % 3}": str(i)} if i % 5 else None) for i in range(30)]
    df = spark.createDataFrame(rows, "entity_id long, name string, type string, description string, properties map<string, string>")
    got = {r.type: (r.entity_id, r.description, r.properties) for r in graph.merge_entities(df, "entity_id").collect()}
    want = {}
    for i, _, t, d, p in rows:
        e, old, props = want.get(t, (i, None, {}))
        want[t] = (e, old or d, {**props, **(p or {})})
    assert got == want


def test_a_text_with_very_many_copies_is_embedded_once(spark):
    def embed(texts):
        return [[float(len(t)), float(len(set(texts)) == len(texts))] for t in texts]

    rows = spark.range(12_000).select("id", F.when(F.col("id") < 11_000, "copy").when(F.col("id") == 11_000, None).otherwise(F.col("id").cast("string")).alias("content"))
    got = ingest.embedded(rows, embed)
    assert got.count() == 12_000 and got.where("get(embedding, 0) = 4 and get(embedding, 1) = 1").count() == 11_000
    assert got.where("content is null").first().embedding == []


def test_long_texts_leave_in_pieces():
    import pandas as pd

    from granary.functions.text import pieces

    pdf = pd.DataFrame({"i": range(7), "text": ["a" * 4, None, "b" * 7, b"c" * 30, "", "d", "e"]})
    assert [p["i"].tolist() for p in pieces(pdf, "text", 10)] == [[0, 1], [2], [3], [4, 5, 6]] and list(pieces(pdf[:0], "text")) == []
