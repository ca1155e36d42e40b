"""Knowledge graph over two tables: vertices (entity_id, name, type, ...) and edges (relation_id, source_id, target_id, ...)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .retrieve import vector_search
from .tables import written


def chunk_context(chunks: DataFrame, doc: str, order: str, text: str, n: int = 200) -> DataFrame:
    """chunks with context: n characters of the chunk before, and after ' ... ' n of the one behind."""
    w = Window.partitionBy(doc).orderBy(order)
    before, after = F.lag(text).over(w), F.lead(text).over(w)
    out = F.concat(F.coalesce(F.substring(before, 1, n), F.lit("")), F.when(after.isNotNull(), F.concat(F.lit(" ... "), F.substring(after, 1, n))).otherwise(F.lit("")))
    return chunks.withColumn("context", out)


def merge_entities(entities: DataFrame, order: str) -> DataFrame:
    """One entity for each (name, type): the first one's id and description (the first that is not null), properties of all, later ones on top.

    A property's last value comes from an aggregation by its key, pre-aggregated in each task, so an entity that is told of very often is a row a task and key.
    """
    described_ = F.min(F.when(F.col("description").isNotNull(), F.struct(F.col(order).alias("o"), F.col("description").alias("d"))))
    keyed = entities.groupBy("name", "type").agg(F.min_by("entity_id", order).alias("entity_id"), described_.alias("_d"))
    said = entities.select("name", "type", F.col(order).alias("_o"), F.explode("properties").alias("_k", "_v"))
    last = said.groupBy("name", "type", "_k").agg(F.max(F.struct("_o", "_v"))["_v"].alias("_v"))
    merged = last.groupBy(F.col("name").alias("_name"), F.col("type").alias("_type")).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("_k", "_v")))).alias("properties"))
    rows = keyed.join(merged, keyed["name"].eqNullSafe(merged["_name"]) & keyed["type"].eqNullSafe(merged["_type"]), "left")
    return rows.select("entity_id", "name", "type", F.col("_d.d").alias("description"), F.coalesce("properties", F.expr("cast(map() as map<string, string>)")).alias("properties"))


def resolve_relations(relations: DataFrame, entities: DataFrame, order: str, default_document: str | None = None) -> DataFrame:
    """Relations by name (source, target) to ids: the first entity of a name counts, whatever its type; unresolved ones are dropped."""
    ids = entities.groupBy("name").agg(F.min_by("entity_id", order).alias("id"))
    s = ids.select(F.col("name").alias("source"), F.col("id").alias("source_id"))
    t = ids.select(F.col("name").alias("target"), F.col("id").alias("target_id"))
    out = relations.join(s, "source").join(t, "target").withColumn("confidence", F.coalesce("confidence", F.lit(1.0)) if "confidence" in relations.columns else F.lit(1.0))
    return out if default_document is None else out.withColumn("document_id", F.coalesce("document_id", F.lit(default_document)) if "document_id" in relations.columns else F.lit(default_document))


def save_relations(edges: DataFrame, rows: DataFrame, vertices: DataFrame, order: str = "updated_at") -> DataFrame:
    """edges after rows: the latest of each relation_id, those without both ends left out."""
    known = vertices.select("entity_id")
    ok = rows.join(known.withColumnRenamed("entity_id", "source_id"), "source_id", "left_semi").join(known.withColumnRenamed("entity_id", "target_id"), "target_id", "left_semi")
    both = edges.withColumn("_new", F.lit(0)).unionByName(ok.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    w = Window.partitionBy("relation_id").orderBy(F.desc("_new"), F.desc(order))
    return both.withColumn("_i", F.row_number().over(w)).where("_i = 1").drop("_i", "_new")


#: A vertex with more neighbours is a hub; the largest ones are told apart, so many at most.
HUB, HUBS = 10_000, 100_000
#: Pairs of a centre and a node that one part of a join makes.
PAIRS = 16_000_000
#: About so many nodes or centres make a list; of these lists so many nodes and so many centres make their rows at once.
LISTED, NODES, RUN = 1024, 32, 128


def k_hop(edges: DataFrame, centres: DataFrame, depth: int, hub: int = HUB) -> DataFrame:
    """(centre, node, hops): nodes within `depth` undirected steps of each centre, with the fewest steps.

    A centre that has but one neighbour reaches what that one reaches, a step further, and nothing else: the neighbour's walk is done once for all such centres (often many
    around one hub), and their rows come from a join with it, without a shuffle of the rows that it makes. For the other centres see _walk.
    A hub's neighbours lie in parts of about `hub` rows, by a hash of the neighbour, and what reaches
    a hub goes to each part, so no task gets all of them. Hubs (entity and number of parts) are a small table that is broadcast: at most HUBS of those with most neighbours.
    """
    starts = centres.select(F.col("entity_id").alias("centre")).distinct()
    if depth < 1:
        return _walk(edges, None, starts, 0)
    both = edges.select(F.col("source_id").alias("a"), F.col("target_id").alias("b")).union(edges.select("target_id", "source_id")).distinct()
    both = written(both, "both")
    large = both.groupBy("a").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hub).orderBy(F.desc("n"), "a").limit(HUBS)
    hubs = written(large.select("a", F.ceil(F.col("n") / hub).cast("int").alias("parts")), "hubs")
    if hubs.isEmpty():
        hubs = None
    else:
        both = both.join(F.broadcast(hubs), "a", "left").select("a", "b", F.pmod(F.xxhash64("b"), F.coalesce("parts", F.lit(1))).cast("int").alias("part"))
    others = both.where(~F.col("a").eqNullSafe(F.col("b"))).join(starts.select(F.col("centre").alias("a")), "a", "left_semi")
    single = others.groupBy("a").agg(F.count(F.lit(1)).alias("n"), F.min("b").alias("by")).where("n = 1 and by is not null")
    single = written(single.select(F.col("a").alias("centre"), "by"), "single")
    if single.isEmpty():
        return _walk(both, hubs, starts, depth)
    near = written(_walk(both, hubs, single.select(F.col("by").alias("centre")).distinct(), depth - 1).withColumnRenamed("centre", "by"), "near")
    own = single.select("centre", F.col("centre").alias("node"), F.lit(0).alias("hops"))
    out = own.unionByName(_around(single, near))
    rest = starts.join(single, "centre", "left_anti")
    return out if rest.isEmpty() else out.unionByName(_walk(both, hubs, rest, depth))


def _around(single: DataFrame, near: DataFrame) -> DataFrame:
    """(centre, node, hops) of single (centre, by) and near (by, node, hops): each centre with all nodes of its neighbour, a step further, but itself.

    A neighbour's nodes lie in parts by a hash, so many that a part makes about PAIRS rows, and its centres go to each of these parts; where there are more centres than nodes, the
    centres lie in parts and the nodes go to each. Both move as lists, of which the rows are made at last: a node's rows with a run of centres, then the next node's with the same
    run. Runs are short and of one length, so that columns of the result repeat themselves within a page of a file and hardly take place, however many rows there are.
    """
    sizes = near.groupBy("by").agg(F.count(F.lit(1)).alias("n")).join(single.groupBy("by").agg(F.count(F.lit(1)).alias("m")), "by")
    sizes = written(sizes.select("by", "n", "m", (F.col("n") >= F.col("m")).alias("wide"), (F.col("n") * F.col("m")).alias("pairs"), (F.floor(F.col("n") * F.col("m") / PAIRS) + 1).alias("parts")), "sizes")
    tasks = near.sparkSession.sparkContext.defaultParallelism + (sizes.agg(F.sum("pairs")).first()[0] or 0) // PAIRS
    tasks = min(tasks, 20_000)

    def listed(rows: DataFrame, key: str, size: str, split: Column, value: Column) -> DataFrame:
        """(by, split, parts, list, values): values of each neighbour in lists of about LISTED; a list belongs to one part where split holds."""
        parts = F.when(split, F.col("parts")).otherwise(1)
        lists = F.pmod(F.xxhash64(key), parts * F.ceil(F.col(size) / (parts * LISTED)))
        return written(rows.join(sizes, "by").groupBy("by", split.alias("split"), "parts", lists.alias("list")).agg(F.collect_list(value).alias("values")), "lists")

    every = F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)
    part = F.explode(F.when(F.col("split"), F.array(F.pmod("list", "parts"))).otherwise(every)).alias("part")
    pieces = lambda n: F.explode(F.transform(F.sequence(F.lit(1), F.size("values"), F.lit(n)), lambda i: F.slice("values", i, n)))
    far = listed(near, "node", "n", F.col("wide"), F.struct("node", (F.col("hops") + 1).alias("hops"))).select("by", part, "values").select("by", "part", pieces(NODES).alias("nodes"))
    asked = listed(single, "centre", "m", ~F.col("wide"), F.col("centre")).select("by", part, "values").select("by", "part", pieces(RUN).alias("run"))
    met = far.repartition(tasks, "by", "part").join(asked.repartition(tasks, "by", "part"), ["by", "part"])
    rows = met.select(F.explode("nodes").alias("x"), "run").select("x.node", "x.hops", F.explode("run").alias("centre"))
    return rows.where(~F.col("node").eqNullSafe(F.col("centre"))).select("centre", "node", "hops")


def _walk(both: DataFrame, hubs: DataFrame | None, starts: DataFrame, depth: int) -> DataFrame:
    """(centre, node, hops) of each of starts (centre). The steps are unrolled; each goes on only from the nodes that the one before has added."""
    seen = starts.select("centre", F.col("centre").alias("node"), F.lit(0).alias("hops"))
    front = seen
    for hop in range(1, depth + 1):
        ahead, on = front.select("centre", F.col("node").alias("a")), ["a"]
        if hubs is not None:
            ahead = ahead.join(F.broadcast(hubs), "a", "left").select("centre", "a", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("part"))
            on = ["a", "part"]
        reached = ahead.join(both, on).select("centre", F.col("b").alias("node")).distinct()
        old = seen.select(F.col("centre").alias("_c"), F.col("node").alias("_n"))
        front = reached.join(old, (F.col("centre") == F.col("_c")) & F.col("node").eqNullSafe(F.col("_n")), "left_anti").withColumn("hops", F.lit(hop))
        seen = seen.unionByName(front)
    return seen


def subgraph_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Directed edges with both ends among a centre's nodes, with the centre and a label (description, else type)."""
    x = nodes.select("centre", F.col("node").alias("source_id"))
    y = nodes.select("centre", F.col("node").alias("target_id"))
    label = F.coalesce(*[F.col(c) for c in ("description", "type") if c in edges.columns], F.lit(""))
    return edges.withColumn("label", label).join(x, "source_id").join(y, ["centre", "target_id"])


def by_name(entities: DataFrame, text: str) -> DataFrame:
    """Entities whose name contains text, with respect to case."""
    return entities.where(F.contains("name", F.lit(text)))


def by_type(entities: DataFrame, kind: str, limit: int) -> DataFrame:
    return entities.where(F.col("type") == kind).orderBy("entity_id").limit(limit)


def word_matches(entities: DataFrame, words: DataFrame, k: int, grams: int = 3) -> DataFrame:
    """(word, entity_id): for each of words (word), each there once, the k smallest ids of entities whose name contains it.

    A name that contains a word has the word's first `grams` letters (all of a shorter one) somewhere, so candidates come from an equi-join of letter groups, and contains is checked
    on them only. Of entities with one name, and of those of one word, only the k smallest ids go on, which each task sees to before rows are shuffled.
    """
    smallest = lambda rows, by: rows.withColumn("_i", F.dense_rank().over(Window.partitionBy(by).orderBy("entity_id"))).where(F.col("_i") <= k).drop("_i")
    places = F.sequence(F.lit(1), F.greatest(F.length("name"), F.lit(1)))
    parts = F.flatten(F.transform(places, lambda i: F.transform(F.sequence(F.lit(1), F.lit(grams)), lambda n: F.substring("name", i, n))))
    named = smallest(entities.select("entity_id", "name"), "name").select("entity_id", "name", F.explode(F.array_distinct(parts)).alias("gram"))
    hits = named.join(words.select("word", F.substring("word", 1, grams).alias("gram")), "gram").where(F.contains(F.col("name"), F.col("word")))
    return smallest(hits.select("word", "entity_id"), "word").distinct()


def text_matches(entities: DataFrame, queries: DataFrame, k: int, grams: int = 3) -> DataFrame:
    """(query_id, entity_id, rank): entities whose name contains the whole query, then those that contain a word of it longer than one letter.

    An entity stands at its first match; words in order, then ids. Words that queries share are looked for once, see word_matches. The k smallest ids of each word will do: what stands
    before one of a query's k best by a smaller id of the same word is among the k best itself.
    """
    words = F.filter(F.split(F.col("text"), r"\s+"), lambda w: F.length(w) > 1)
    asked = queries.select("query_id", F.posexplode(F.concat(F.array("text"), words)).alias("at", "word")).where("word <> ''")
    hits = asked.join(word_matches(entities, asked.select("word").distinct(), k, grams), "word")
    first = hits.groupBy("query_id", "entity_id").agg(F.min("at").alias("at"))
    w = Window.partitionBy("query_id").orderBy("at", "entity_id")
    return first.withColumn("rank", (F.row_number().over(w) - 1).cast("long")).where(F.col("rank") < k).select("query_id", "entity_id", "rank")


def described(entities: DataFrame) -> Column:
    return F.format_string("%s(%s)", "name", "type")


def vector_matches(entities: DataFrame, queries: DataFrame, k: int, skip_self: bool = False) -> DataFrame:
    """(query_id, entity_id, score, rank): the entities (entity_id, embedding) whose vectors are most similar to a query's (query_id, query_vec)."""
    return vector_search(entities, queries, k, "cosine", "entity_id", "embedding", skip_self).withColumnRenamed("id", "entity_id")


def graph_search(entities: DataFrame, edges: DataFrame, matches: DataFrame, depth: int = 1, kind: str | None = None) -> DataFrame:
    """(query_id, content, score): one hit a query, the neighbourhood of its matches as name(type), name(type).

    A type filter applies before anything is cut. Neighbours of several matches count once. The score is that of the best match, 0.5 where matches have none.
    """
    chosen = matches.join(entities.where(F.col("type") == kind).select("entity_id"), "entity_id", "left_semi") if kind else matches
    near = k_hop(edges, chosen.select("entity_id").distinct(), depth)
    mine = chosen.select("query_id", F.col("entity_id").alias("centre")).join(near, "centre").select("query_id", F.col("node").alias("entity_id")).distinct()
    text = mine.join(entities.select("entity_id", described(entities).alias("d")), "entity_id")
    hits = text.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("entity_id", "d"))), lambda x: x["d"]), ", ").alias("content"))
    if "score" not in matches.columns:
        return hits.withColumn("score", F.lit(0.5))
    return hits.join(chosen.groupBy("query_id").agg(F.coalesce(F.max("score"), F.lit(0.5)).alias("score")), "query_id")


def counts(entities: DataFrame, edges: DataFrame) -> DataFrame:
    return entities.agg(F.count(F.lit(1)).alias("entities")).withColumn("relations", edges.agg(F.count(F.lit(1)).alias("n")).scalar())


def parsed_extraction(replies: DataFrame, reply: str = "reply") -> DataFrame:
    """replies with entities and relations of a model's JSON reply; broken JSON gives empty arrays."""
    from ..functions.text import unfenced

    schema = "struct<entities: array<struct<name: string, type: string, description: string>>, relations: array<struct<source: string, target: string, type: string, description: string, confidence: double>>>"
    parsed = F.from_json(unfenced(F.col(reply)), schema)
    out = replies.withColumn("_p", parsed)
    for name in ("entities", "relations"):
        kind = schema.split(f"{name}: ")[1].split(">>, ")[0].rstrip(">") + ">>"
        out = out.withColumn(name, F.coalesce(F.col(f"_p.{name}"), F.array().cast(kind)))
    return out.drop("_p")


def in_batches(texts: DataFrame, order: str, size: int = 5) -> DataFrame:
    """texts with batch and progress rows of a build job: batch numbers from 0 and the texts done after each."""
    w = Window.partitionBy("document_id").orderBy(order)
    n = F.row_number().over(w)
    return texts.withColumn("batch", F.floor((n - 1) / size).cast("int")).withColumn("done", n).withColumn("total", F.count(F.lit(1)).over(Window.partitionBy("document_id")))


# States of a build job.
JOB_STATES = ("PENDING", "PROCESSING", "COMPLETED", "FAILED")


def build_graph(texts: DataFrame, extract, order: str, size: int = 5) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(entities, relations, job) of texts (document_id, order, text): extracted (extract adds reply), merged by name and type, and resolved.

    job has a row a document: batches, texts done, state COMPLETED, or FAILED with its message if every reply of it was broken.
    """
    batched = in_batches(texts, order, size)
    parsed = parsed_extraction(extract(batched))
    found = parsed.select("document_id", F.posexplode("entities").alias("_i", "e"), F.col(order).alias("_o"))
    found = found.select("document_id", F.struct("document_id", "_o", "_i").alias("at"), "e.name", "e.type", "e.description").withColumn("entity_id", F.concat_ws("|", "name", "type")).withColumn("properties", F.create_map(F.lit("document"), F.col("document_id").cast("string")))
    entities = merge_entities(found, "at")
    named = parsed.select("document_id", F.explode("relations").alias("r")).select("document_id", "r.*")
    relations = resolve_relations(named, found.select("entity_id", "name", "at"), "at")
    broken = F.size("entities") + F.size("relations") == 0
    job = parsed.groupBy("document_id").agg(F.max("total").alias("total"), F.max("done").alias("done"), (F.max("batch") + 1).alias("batches"), F.min(broken.cast("int")).alias("_broken"))
    job = job.withColumn("state", F.when(F.col("_broken") == 1, JOB_STATES[3]).otherwise(JOB_STATES[2])).withColumn("message", F.when(F.col("_broken") == 1, "nothing was extracted")).drop("_broken")
    return entities, relations, job


def subgraph_of_text(entities: DataFrame, edges: DataFrame, text: str, depth: int = 1) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) around the first entity whose name contains text."""
    centre = by_name(entities, text).orderBy("entity_id").limit(1).select("entity_id")
    nodes = k_hop(edges, centre, depth)
    return nodes, subgraph_edges(edges, nodes)


def schema_faults(entities: DataFrame, dimension: int, vector: str = "embedding") -> DataFrame:
    """(fault, n): ids that occur more than once, and vectors that do not have the index's dimension."""
    twice = entities.groupBy("entity_id").agg(F.count(F.lit(1)).alias("c")).where("c > 1").agg(F.count(F.lit(1)).alias("n")).select(F.lit("duplicate id").alias("fault"), "n")
    wrong = entities.where(F.col(vector).isNotNull() & (F.size(vector) != dimension)).agg(F.count(F.lit(1)).alias("n")).select(F.lit("dimension").alias("fault"), "n")
    return twice.unionByName(wrong)
