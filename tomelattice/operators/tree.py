"""The category tree: built level by level, extended batch by batch.

Documents have doc_id, ordinal (a unique order), title, summary, keywords, entities and questions;
chapters have doc_id, section_index, chunk_id, title, summary, keywords, entities and questions.
Nodes carry no text.  Ids follow from a node's place, so that a rebuild gives the same ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tomelattice.functions.parsing import parsed, string_list
from tomelattice.functions.text import is_blank, leaf_name, normalized
from tomelattice.model.calls import asked, prompt
from tomelattice.model.provider import Provider
from tomelattice.operators.ranking import part_of, ranked
from tomelattice.session import Stage, stage

#: Levels of categories at most, characters of a summary in a prompt and in a name, names.
DEEPEST, PROMPT_SUMMARY, NAME_SUMMARY = 8, 200, 20
CATEGORY, DOCUMENT, ROOT = "类别", "文档", "Root"
#: Summaries that one clustering prompt holds.
CLUSTERED = 200
#: Documents whose summaries one prompt holds that describes a category to the model.
DESCRIBING = 100

NODE = ["node_id", "name", "description", "type", "key_entities", "keywords", "example_questions"]
_STRINGS = "array<string>"


def _none() -> Column:
    return F.array().cast(_STRINGS)


def _id(*parts: Column) -> Column:
    return F.concat(F.lit("n-"), F.substring(F.sha2(F.concat_ws("\n", *parts), 256), 1, 24))


def document_nodes(docs: DataFrame, chapters: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, links (parent, child, pos) and chunks (node_id, chunk_id, pos) of all documents.

    A document of one chapter is a leaf; one of several is a document node over a leaf for each; one
    without a chapter is a leaf without a chunk.
    """
    counts = chapters.groupBy("doc_id").agg(F.count("*").alias("n"))
    sized = docs.join(counts, "doc_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    own = _id(F.lit("doc"), F.col("doc_id"))
    only = chapters.select("doc_id", F.col("title").alias("chapter_title"), "chunk_id", "section_index").join(sized.where("n <= 1").select("doc_id"), "doc_id", "left_semi")
    top = sized.join(only, "doc_id", "left").select(
        own.alias("node_id"), F.when(F.col("n") > 1, F.coalesce(F.when(~is_blank("title"), F.col("title")), F.col("doc_id"))).otherwise(leaf_name("summary", "chapter_title", "title", "doc_id")).alias("name"), F.coalesce("summary", F.lit("")).alias("description"),
        F.when(F.col("n") > 1, "DOCUMENT").otherwise("LEAF").alias("type"), F.coalesce("entities", _none()).alias("key_entities"), F.coalesce("keywords", _none()).alias("keywords"), F.coalesce("questions", _none()).alias("example_questions"), "chunk_id",
    )
    several = chapters.join(sized.where("n > 1").select("doc_id", F.col("title").alias("doc_title")), "doc_id")
    leaf = _id(F.lit("chunk"), F.col("chunk_id"))
    leaves = several.select(
        leaf.alias("node_id"), leaf_name("summary", "title", "doc_title", "doc_id").alias("name"), F.coalesce("summary", F.lit("")).alias("description"), F.lit("LEAF").alias("type"),
        F.coalesce("entities", _none()).alias("key_entities"), F.array_distinct(F.coalesce("keywords", _none())).alias("keywords"), F.coalesce("questions", _none()).alias("example_questions"), "chunk_id", own.alias("parent"), "section_index",
    )
    nodes = top.select(*NODE).unionByName(leaves.select(*NODE))
    links = leaves.select("parent", F.col("node_id").alias("child"), F.col("section_index").cast("long").alias("pos"))
    chunks = top.where("chunk_id is not null").select("node_id", "chunk_id", F.lit(0).cast("long").alias("pos")).unionByName(leaves.select("node_id", "chunk_id", F.lit(0).cast("long").alias("pos")))
    return nodes, links, chunks


def _clustered(items: DataFrame, provider: Provider) -> DataFrame:
    """Items (group, item, pos, text) in order, in blocks of CLUSTERED, with `blocks` of the group, `block`, and `cluster` and `cluster_name` within the block."""
    placed = ranked(items, ["group"], ["pos"], "_at", "_n").withColumn("block", F.floor((F.col("_at") - 1) / CLUSTERED)).withColumn("blocks", F.ceil(F.col("_n") / CLUSTERED))
    placed = placed.withColumn("_r", F.col("_at") - F.col("block") * CLUSTERED).withColumn("_n", F.least(F.lit(CLUSTERED), F.col("_n") - F.col("block") * CLUSTERED))
    placed = stage(placed.select("group", "item", "pos", "text", "blocks", "block", "_r", "_n"))
    line = F.concat(F.lit("["), (F.col("_r") - 1).cast("string"), F.lit("] "), F.substring(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " "), 1, PROMPT_SUMMARY))
    asking = placed.select("group", "block", F.struct("_r", line.alias("line")).alias("x")).groupBy("group", "block").agg(F.sort_array(F.collect_list("x")).alias("x"))  # CLUSTERED rows at most
    answers = asked(asking.select("group", "block", prompt("CLUSTER_DOCUMENTS", F.array_join(F.col("x.line"), "\n")).alias("prompt")), "CLUSTER_DOCUMENTS", provider)
    schema = "clusters array<struct<name: string, chunkIndices: array<int>>>"
    named = answers.where("answer.success").select("group", "block", F.posexplode(parsed("answer.content", schema)["clusters"]).alias("cluster", "c")).where("c.chunkIndices is not null")
    picked = named.select("group", "block", "cluster", F.trim(F.col("c.name")).alias("name"), F.explode("c.chunkIndices").alias("i")).where("i is not null")
    first = picked.groupBy("group", "block", "i").agg(F.min_by(F.struct("cluster", "name"), "cluster").alias("by")).select("group", "block", (F.col("i") + 1).cast("long").alias("_r"), "by.cluster", "by.name")
    joined = stage(placed.join(first, ["group", "block", "_r"], "left"))
    usable = joined.where("cluster is not null").select("group", "block", F.lit(True).alias("usable")).distinct()
    own_name = F.when(is_blank("text"), DOCUMENT).otherwise(F.substring("text", 1, NAME_SUMMARY))
    chosen = F.struct(F.coalesce(F.col("cluster").cast("long"), F.lit(1 << 20) + F.col("_r")).alias("cluster"), F.when(F.col("cluster").isNull(), own_name).when(is_blank("name"), CATEGORY).otherwise(F.col("name")).alias("name"))
    either = joined.join(usable, ["group", "block"], "left").withColumn("x", F.when(F.col("usable"), chosen).otherwise(_thirds()))
    return either.select("group", "item", "pos", "text", "blocks", "block", F.col("x.cluster").alias("cluster"), F.col("x.name").alias("cluster_name"))


def _thirds() -> Column:
    """Cluster and name by place _r of _n: three contiguous near-equal parts, or single documents if there are three at most."""
    part = part_of(F.col("_r"), F.col("_n"), 3)
    few = F.col("_n") <= 3
    return F.struct(F.when(few, F.col("_r") - 1).otherwise(part - 1).cast("long").alias("cluster"), F.when(few, F.concat(F.lit(f"{DOCUMENT} "), F.col("_r").cast("string"))).otherwise(F.concat(F.lit(f"{CATEGORY} "), part.cast("string"))).alias("name"))


def clusters_of(groups: DataFrame, provider: Provider | None) -> DataFrame:
    """Documents (group, doc_id, ordinal, summary) with `cluster`, a number from 0, and its name.

    A model groups the documents of a group in blocks of CLUSTERED, then the blocks' clusters, by
    their names and first summaries, in blocks again, until one block holds all of a group.  In a
    block the first cluster that names a document gets it, numbers out of range don't count, and
    what none names is its own cluster.  A block without a usable answer is cut into three
    contiguous near-equal parts, or single documents if there are three at most; so is a group
    without a model, and one whose clusters are no fewer than half of what was to be clustered, for
    that would not come to an end.
    """
    if provider is None:
        placed = ranked(groups, ["group"], ["ordinal"], "_r", "_n").withColumn("x", _thirds())
        return placed.select("group", "doc_id", "ordinal", F.col("x.cluster").alias("cluster"), F.col("x.name").alias("cluster_name"))
    of = groups.select("group", "doc_id", "ordinal", F.col("doc_id").alias("item"))
    items = groups.select("group", F.col("doc_id").alias("item"), F.col("ordinal").cast("long").alias("pos"), F.col("summary").alias("text"))
    done = None
    while True:
        t = _clustered(items, provider)
        key = F.concat_ws("-", F.col("block").cast("string"), F.col("cluster").cast("string"))
        t = Stage(t.withColumn("key", key), open=F.count(F.when(F.col("blocks") > 1, 1)))
        of = stage(of.join(t.df.select("group", "item", "blocks", "key", "cluster", "cluster_name"), ["group", "item"]))
        ended = of.where("blocks = 1").select("group", "doc_id", "ordinal", "cluster", "cluster_name")
        done = ended if done is None else done.unionByName(ended)
        if not t.seen["open"]:
            return done
        more = t.df.where("blocks > 1").groupBy("group", "key").agg(F.min("pos").alias("pos"), F.min_by("cluster_name", "pos").alias("name"), F.min_by("text", "pos").alias("first"), F.count("*").alias("n"))
        sizes = more.groupBy("group").agg((F.count("*") * 2 <= F.sum("n")).alias("fewer"))
        more = stage(more.join(sizes, "group"))
        items = more.where("fewer").select("group", F.col("key").alias("item"), "pos", F.concat_ws(": ", "name", "first").alias("text"))
        stuck = of.where("blocks > 1").join(more.where("not fewer").select("group").distinct(), "group", "left_semi")
        cut = ranked(stuck.select("group", "doc_id", "ordinal"), ["group"], ["ordinal"], "_r", "_n").withColumn("x", _thirds())
        done = done.unionByName(stage(cut.select("group", "doc_id", "ordinal", F.col("x.cluster").alias("cluster"), F.col("x.name").alias("cluster_name"))))
        of = of.where("blocks > 1").join(more.where("fewer").select("group").distinct(), "group", "left_semi").select("group", "doc_id", "ordinal", F.col("key").alias("item"))
        if items.isEmpty():
            return done


def described(groups: DataFrame, docs: DataFrame, provider: Provider | None) -> DataFrame:
    """(group, keywords, entities, questions): what a model says of the summaries of a group's documents; empty lists where it fails.

    All documents count: blocks of DESCRIBING summaries are asked for one by one, and a group has
    the distinct entries of its blocks' lists in order.
    """
    if provider is None:
        return groups.select("group").distinct().select("group", *(_none().alias(c) for c in ("keywords", "entities", "questions")))
    placed = ranked(groups.select("group", "doc_id", "ordinal"), ["group"], ["ordinal"], "_r").withColumn("block", F.floor((F.col("_r") - 1) / DESCRIBING))
    told = placed.join(docs.select("doc_id", "summary"), "doc_id").groupBy("group", "block").agg(F.sort_array(F.collect_list(F.struct("_r", "summary"))).alias("s"))  # DESCRIBING rows at most
    text = F.array_join(F.transform("s.summary", lambda x: F.coalesce(x, F.lit(""))), " ")
    out = stage(told.select("group", "block", text.alias("text")))
    lists = (("keywords", "EXTRACT_KEYWORDS"), ("entities", "EXTRACT_ENTITIES"), ("questions", "GENERATE_EXAMPLE_QUESTIONS"))
    for column, kind in lists:
        answers = asked(out.withColumn("prompt", prompt(kind, "text")), kind, provider)
        out = stage(answers.withColumn(column, F.when(F.col("answer.success"), string_list("answer.content")).otherwise(_none())).drop("prompt", "answer"))
    merged = lambda c: F.array_distinct(F.flatten(F.transform("x", lambda b: F.coalesce(b[c], _none()))))
    whole = out.groupBy("group").agg(F.min_by("keywords", "block").alias("_k"), F.min_by("entities", "block").alias("_e"), F.min_by("questions", "block").alias("_q"), F.sort_array(F.collect_list(F.struct("block", *(c for c, _ in lists)))).alias("x"))
    # A single block's lists stay as the model gave them.
    return stage(whole.select("group", *(F.when(F.size("x") == 1, F.col(first)).otherwise(merged(c)).alias(c) for (c, _), first in zip(lists, ("_k", "_e", "_q")))))


class Tree:
    """Nodes without lists, links (parent, child, pos), chunks (node_id, chunk_id, pos) and the root's id (None for an empty tree)."""

    def __init__(self, nodes: DataFrame, links: DataFrame, chunks: DataFrame, root: str | None) -> None:
        self.nodes, self.links, self.chunks, self.root = nodes, links, chunks, root
        self.delta: Tree | None = None  # of a grown tree, the rows that are new or changed

    def postings(self) -> DataFrame:
        """(keyword, node_id, pos) of all nodes' keywords."""
        each = self.nodes.select("node_id", F.posexplode("keywords").alias("pos", "k")).select(normalized("k").alias("keyword"), "node_id", "pos")
        return each.where("keyword is not null").groupBy("keyword", "node_id").agg(F.min("pos").alias("pos"))

    def with_lists(self) -> DataFrame:
        """Nodes with children_ids and chunk_ids in order, as schema.NODES."""
        ordered = lambda t, by, x, name: t.groupBy(F.col(by).alias("node_id")).agg(F.sort_array(F.collect_list(F.struct("pos", F.col(x).alias("x")))).alias("l")).select("node_id", F.col("l.x").alias(name))
        out = self.nodes.join(ordered(self.links, "parent", "child", "children_ids"), "node_id", "left").join(ordered(self.chunks, "node_id", "chunk_id", "chunk_ids"), "node_id", "left")
        return out.withColumn("children_ids", F.coalesce("children_ids", _none())).withColumn("chunk_ids", F.coalesce("chunk_ids", _none()))


def build(docs: DataFrame, chapters: DataFrame, provider: Provider | None = None) -> Tree:
    """A tree over all documents.

    A group of one document is that document; a group whose documents fall into several clusters is
    a category over one group for each; one that falls into a single cluster, or lies DEEPEST
    levels deep, is a category over its documents.  All groups of a level are treated together.
    """
    docs = stage(docs)
    nodes, links, chunks = document_nodes(docs, chapters)
    node_of = _id(F.lit("doc"), F.col("doc_id"))
    open_ = stage(docs.select(F.lit("root").alias("group"), F.lit(ROOT).alias("name"), F.lit(None).cast("string").alias("above"), F.lit(0).cast("long").alias("pos"), "doc_id", "ordinal", "summary"))
    root = None
    for depth in range(DEEPEST + 1):
        if open_.isEmpty():
            break
        counted = open_.groupBy("group").agg(F.count("*").alias("n"))
        open_ = stage(open_.join(counted, "group"))
        single = open_.where("n = 1")
        links = links.unionByName(single.where("above is not null").select(F.col("above").alias("parent"), node_of.alias("child"), "pos"))
        if depth == 0 and (one := single.select(node_of.alias("id")).first()):
            root = one["id"]
        groups = open_.where("n > 1")
        if depth == DEEPEST:
            split = groups.select("group", "doc_id", "ordinal", F.lit(0).cast("long").alias("cluster"), F.col("name").alias("cluster_name"))
        else:
            split = clusters_of(groups.select("group", "doc_id", "ordinal", "summary"), provider)
        split = stage(split)
        many = split.groupBy("group").agg(F.countDistinct("cluster").alias("clusters"), F.min("cluster_name").alias("only"))
        group_id = _id(F.lit("group"), F.col("group"))
        heads = stage(groups.select("group", "name", "above", "pos").distinct().join(many, "group").withColumn("flat", F.col("clusters") <= 1))
        told = described(groups.select("group", "doc_id", "ordinal"), docs, provider)
        named = F.when(F.col("flat") & (F.col("above").isNotNull() | (F.lit(depth) == DEEPEST)), F.col("name")).when(F.col("flat"), F.col("only")).otherwise(F.col("name"))
        new = stage(
            heads.join(told, "group", "left").select(
                group_id.alias("node_id"), named.alias("name"), F.when(F.col("flat"), F.lit("")).otherwise(F.concat(F.col("clusters").cast("string"), F.lit(" subcategories"))).alias("description"), F.lit("CATEGORY").alias("type"),
                F.coalesce("entities", _none()).alias("key_entities"), F.coalesce("keywords", _none()).alias("keywords"), F.coalesce("questions", _none()).alias("example_questions"),
            )
        )
        nodes = nodes.unionByName(new)
        links = links.unionByName(heads.where("above is not null").select(F.col("above").alias("parent"), group_id.alias("child"), "pos"))
        if depth == 0 and root is None and (top := new.first()):
            root = top["node_id"]
        within = split.join(heads.select("group", "flat"), "group")
        links = links.unionByName(within.where("flat").select(group_id.alias("parent"), node_of.alias("child"), F.col("ordinal").cast("long").alias("pos")))
        below = within.where("not flat").join(docs.select("doc_id", "summary"), "doc_id")
        open_ = stage(below.select(F.concat_ws("/", "group", F.col("cluster").cast("string")).alias("group"), F.col("cluster_name").alias("name"), group_id.alias("above"), F.col("cluster").alias("pos"), "doc_id", "ordinal", "summary"))
    return Tree(stage(nodes), stage(links), stage(chunks), root)


def overlaps(docs: DataFrame, categories: DataFrame) -> DataFrame:
    """(doc_id, child, score): the matches of documents with the categories below the node each has reached.

    docs has doc_id, node_id and keywords; categories has node_id, child, words and entities.  A
    category matches with each of its keywords that is among the document's, as often as it has it,
    and with each of its entities that holds, or is held by, one of them; letter case doesn't
    matter, empty entries don't count.  Documents meet categories by equal keywords, or by equal
    parts of words, not each with each.
    """
    low = lambda c: F.transform(F.coalesce(c, _none()), F.lower)
    theirs = stage(docs.select("node_id", "doc_id", F.explode(F.array_distinct(low(F.col("keywords")))).alias("k")).where("k <> ''"))
    words = categories.select("node_id", "child", F.explode(low(F.col("words"))).alias("k")).groupBy("node_id", "child", "k").agg(F.count("*").alias("n"))
    names = stage(categories.select("node_id", "child", F.posexplode(low(F.col("entities"))).alias("i", "e")).where("e <> ''"))
    parts = lambda c: F.explode(F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.length(c)), lambda n: F.transform(F.sequence(F.lit(1), F.length(c) - n + 1), lambda i: F.substring(F.col(c), i, n))))))
    # Pairs of an entity and a keyword of which one holds the other, each met once for all documents and categories.
    entity, keyword = names.select("e").distinct(), theirs.select("k").distinct()
    holds = entity.select("e", parts("e").alias("k")).join(keyword, "k").select("e", "k")
    held = keyword.select("k", parts("k").alias("e")).join(entity, "e").select("e", "k")
    met = stage(holds.union(held).distinct())
    same = theirs.join(words, ["node_id", "k"]).select("doc_id", "child", "n")
    alike = names.join(met, "e").join(theirs, ["node_id", "k"]).select("doc_id", "child", "i").distinct().select("doc_id", "child", F.lit(1).cast("long").alias("n"))
    return same.unionByName(alike).groupBy("doc_id", "child").agg(F.sum("n").alias("score"))


def best_categories(docs: DataFrame, tree: Tree) -> DataFrame:
    """(doc_id, node_id): from the root down, the child category with most matches, of equals the first, until none has any.

    docs has doc_id and keywords.  Documents that match no category get the root; none if the root
    is no category.  A document meets only children of the category it has reached, by what they
    have in common.
    """
    inner = tree.nodes.where(F.col("type").isin("CATEGORY", "ROOT"))
    children = stage(tree.links.join(inner.select(F.col("node_id").alias("child"), F.col("keywords").alias("words"), F.col("key_entities").alias("entities")), "child").select(F.col("parent").alias("node_id"), "child", "pos", "words", "entities"))
    at_root = inner.where(F.col("node_id") == F.lit(tree.root))
    state = stage(docs.select("doc_id", "keywords", F.lit(tree.root).alias("node_id"), F.array(F.lit(tree.root)).alias("way")).join(at_root.select("node_id"), "node_id", "left_semi"))
    done = None
    while not state.isEmpty():
        found = overlaps(state, children.join(state.select("node_id").distinct(), "node_id", "left_semi"))
        # A category passed before, as broken trees may have it, is not entered again.
        scored = found.join(state.select("doc_id", "node_id", "way"), "doc_id").join(children.select("node_id", "child", "pos"), ["node_id", "child"]).where(~F.array_contains("way", F.col("child")))
        next_ = scored.groupBy("doc_id").agg(F.max_by("child", F.struct("score", -F.col("pos"))).alias("next"))
        moved = stage(state.join(next_, "doc_id", "left"))
        stay = moved.where("next is null").select("doc_id", "node_id")
        done = stay if done is None else done.unionByName(stay)
        state = stage(moved.where("next is not null").select("doc_id", "keywords", F.col("next").alias("node_id"), F.concat("way", F.array("next")).alias("way")))
    return done if done is not None else state.select("doc_id", "node_id")


def attach(tree: Tree, docs: DataFrame, chapters: DataFrame) -> Tree:
    """The tree with a batch of documents under their best categories, whose lists take in the documents' keywords, entities and questions.

    Documents of one batch don't see each other.  Those that match nothing below the root, and all
    if the root is no category, get a new root of the same name over the old one and themselves.
    """
    if tree.root is None:
        return build(docs, chapters)
    docs = stage(docs)
    nodes, links, chunks = document_nodes(docs, chapters)
    own = docs.select("doc_id", "ordinal", "keywords", "entities", "questions", _id(F.lit("doc"), F.col("doc_id")).alias("child"))
    found = own.join(best_categories(docs, tree), "doc_id", "left")
    placed = stage(found.where((F.col("node_id") != F.lit(tree.root)) & F.col("node_id").isNotNull()))
    loose = stage(found.where((F.col("node_id") == F.lit(tree.root)) | F.col("node_id").isNull()))
    last = tree.links.groupBy(F.col("parent").alias("node_id")).agg((F.max("pos") + 1).alias("base"))
    put = ranked(placed.select("node_id", "child", "ordinal"), ["node_id"], ["ordinal"], "_r").join(last, "node_id", "left")
    links = links.unionByName(put.select(F.col("node_id").alias("parent"), "child", (F.coalesce("base", F.lit(0)) + F.col("_r") - 1).cast("long").alias("pos")))
    lists = {"keywords": "keywords", "key_entities": "entities", "example_questions": "questions"}
    grown = [
        placed.select("node_id", "ordinal", F.posexplode(c).alias("i", "x")).groupBy("node_id", "x").agg(F.min(F.struct("ordinal", "i")).alias("at")).groupBy("node_id").agg(F.sort_array(F.collect_list(F.struct("at", "x"))).alias("l")).select("node_id", F.col("l.x").alias(f"_{n}"))
        for n, c in lists.items()
    ]
    hosts = placed.select("node_id").distinct()
    old = tree.nodes.join(hosts, "node_id", "left_semi")
    for g in grown:
        old = old.join(g, "node_id", "left")
    for n in lists:
        old = old.withColumn(n, F.when(F.col(f"_{n}").isNull(), F.col(n)).otherwise(F.array_distinct(F.concat(n, f"_{n}"))))
    nodes = old.select(*NODE).unionByName(nodes)
    root = tree.root
    if not loose.isEmpty():
        above = stage(tree.nodes.where(F.col("node_id") == F.lit(root)).select(_id(F.lit("above"), F.col("node_id"), F.lit(str(loose.agg(F.min("doc_id")).first()[0]))).alias("node_id"), "name", F.lit("").alias("description"), F.lit("CATEGORY").alias("type"), "key_entities", "keywords", "example_questions"))
        new_root = above.first()["node_id"]
        under = ranked(loose.select("child", "ordinal"), [], ["ordinal"], "_r").select(F.lit(new_root).alias("parent"), "child", F.col("_r").cast("long").alias("pos"))
        first = above.select(F.col("node_id").alias("parent"), F.lit(root).alias("child"), F.lit(0).cast("long").alias("pos"))
        nodes, links, root = nodes.unionByName(above.select(*NODE)), links.unionByName(first).unionByName(under), new_root
    delta = Tree(stage(nodes), stage(links), stage(chunks), root)
    kept = tree.nodes.join(hosts, "node_id", "left_anti").select(*NODE)
    out = Tree(kept.unionByName(delta.nodes), tree.links.unionByName(delta.links), tree.chunks.unionByName(delta.chunks), root)
    out.delta = delta
    return out
