"""The keyword index and walks down the tree."""

import json
import re

import pytest
from pyspark.sql import functions as F

from tomelattice import schema
from tomelattice.model.provider import MARK, OfflineProvider, ScriptedProvider
from tomelattice.operators import index, navigate as nav
from tomelattice.operators import tree as trees


@pytest.fixture(scope="module")
def nodes(spark):
    rows = [
        ("root", "Root", "", "CATEGORY", ["tech_cat", "legal_leaf"], [], ["tech", "legal"], ["knowledge"], []),
        ("tech_cat", "Technology", "", "CATEGORY", ["tech_leaf", "gone", None], [], ["java", "programming"], ["code"], []),
        ("tech_leaf", "Java", "", "LEAF", [], ["chunk1"], ["java", "spring"], ["tutorial"], []),
        ("legal_leaf", "Law", "", "LEAF", None, ["chunk2", "", None], ["law", "regulation"], ["compliance"], []),
    ]
    return spark.createDataFrame(rows, schema.NODES)


@pytest.fixture(scope="module")
def entries(spark):
    return index.postings(spark.createDataFrame([("java", "tech_leaf", 0), ("programming", "tech_cat", 0), ("law", "legal_leaf", 0)], schema.POSTINGS))


def walk(spark, nodes, entries, cases):
    """Walks the cases' queries as one batch, with a model that knows each by its text."""

    def answer(prompt, kind):
        _, keywords, decision = next(c for c in cases if c[0].strip() and prompt.split(MARK, 1)[1].startswith(c[0]))[:3]
        out = keywords if kind == "EXTRACT_QUERY_KEYWORDS" else decision
        if out is None:
            raise RuntimeError("no model")
        return out if isinstance(out, str) else json.dumps(out)

    q = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "query_id int, query string")
    found, log = nav.navigate(q, nodes, "root", entries, None, ScriptedProvider(answer))
    chunks = {i: set() for i in range(len(cases))}
    for r in found.collect():
        chunks[r.query_id].add(r.chunk_id)
    logged = {r.query_id: r for r in log.collect()}
    return [(chunks[i], logged[i].outcome, logged[i].error) for i in range(len(cases))], logged


SELECT = {"action": "select_child", "selectedIndex": 0, "confidence": 0.95}


CASES = [  # query, keywords, decision; chunks, outcome, error
    ("1 java?", "java", SELECT, {"chunk1"}, "arrived", None),
    ("2 code", "programming", SELECT, {"chunk1"}, "arrived", None),
    ("3 code", "unknown_term", SELECT, {"chunk1"}, "arrived", None),
    ("4 java programming", None, SELECT, {"chunk1"}, "arrived", None),
    ("5 programming", "programming", SELECT | {"confidence": 0.2}, set(), "fallback", None),
    ("6 java law", "programming", SELECT | {"confidence": 0.2}, {"chunk2"}, "fallback", None),  # equal leaves: by id
    ("7 x", "programming", "not JSON", set(), "error", "NAV_004"),
    ("8 x", "programming", {"action": "expand_multiple", "selectedIndexes": [0]}, {"chunk1"}, "expanded", None),
    ("9 x", "programming", {"action": "expand_multiple", "selectedIndexes": [99]}, set(), "stopped", None),
    ("10 x", "unknown_term", {"action": "expand_multiple", "selectedIndexes": [0, 1]}, {"chunk1", "chunk2"}, "expanded", None),
    ("11 law", "programming", {"action": "fallback_search"}, {"chunk2"}, "fallback", None),
    ("12 x", "programming", {"action": "stop"}, set(), "stopped", None),
    (" ", "java", SELECT, set(), "error", "NAV_007"),
]


def test_walks(spark, nodes, entries):
    assert walk(spark, nodes, entries, CASES)[0] == [c[3:] for c in CASES]
    assert walk(spark, nodes, entries, CASES[-1:])[0] == [CASES[-1][3:]]


def test_cycle_falls_back(spark, entries):
    rows = [("root", "R", "", "CATEGORY", ["a"], [], [], [], []), ("a", "A", "", "CATEGORY", ["root"], ["own"], [], [], [])]
    ring = spark.createDataFrame(rows, schema.NODES)
    got, log = walk(spark, ring, entries, [("zzz", "zzz", SELECT)])
    assert got == [(set(), "fallback", None)] and log[0].path == "root/a"
    starts = spark.createDataFrame([(1, "root"), (2, "a")], "query_id int, node_id string")
    assert {(r.query_id, r.chunk_id) for r in nav.leaf_chunks(starts, ring).collect()} == {(2, "own")}


def test_unknown_chunks_have_empty_summaries(spark, nodes):
    known = spark.createDataFrame([("chunk1", "s")], "chunk_id string, summary string")
    assert {(r.chunk_id, r.summary) for r in nav.with_chunks(nav.chunk_links(nodes), known).collect()} == {("chunk1", "s"), ("chunk2", "")}


def score(spark, rows, query):
    d = spark.createDataFrame(rows, "keyword string, node_id string, weight double")
    entries = index.postings(d.withColumn("pos", index.F.lit(0)))
    q = spark.createDataFrame([(1, query)], "query_id int, query string")
    return {r.node_id: r.score for r in index.scores(index.matches(q, entries), entries, index.weights(d)).collect()}


def test_scores(spark):
    assert score(spark, [("term", "node1", 1.0), ("knowledge", "node2", 2.0), ("base", "node1", 0.5)], "Term knowledge BASE") == {"node1": 1.5, "node2": 2.0}
    assert score(spark, [("key", "n", 1.0), (" KEY", "n", 2.0)], "key") == {"n": 2.0}
    assert score(spark, [("alpha", "n1", 1.0)], "alpha alpha") == {"n1": 2.0}
    assert score(spark, [("集群", "n1", 1.0), ("的", "n2", 1.0)], "集群的配置") == {"n1": 1.0}
    assert score(spark, [("集群", "n1", 1.0), ("b", "n2", 1.0)], "b 集群的配置") == {"n2": 1.0}
    assert score(spark, [("x", "n", 1.0)], "") == {}


def test_dictionary(spark):
    empty = index.Dictionary(*(spark.createDataFrame([], s) for s in (schema.POSTINGS, schema.WEIGHTS, schema.DEFINITIONS)))
    d = empty.add(spark.createDataFrame([("JAVA", "a", 1.0)], "keyword string, node_id string, weight double"))
    d = d.add(spark.createDataFrame([("java", "b", 3.0), ("java", "a", 0.5), (" ", "c", 1.0)], "keyword string, node_id string, weight double"))
    assert d.lookup(" Java ") == ["a", "b"] and d.weight("java") == 3.0 and d.weight("none") == 1.0 and d.size() == 1
    assert d.contains("java") and not d.remove("JAVA").contains("java") and d.remove_node("a").lookup("java") == ["b"] and d.clear().size() == 0


def docs_of(spark, rows):
    docs = spark.createDataFrame([(i, n, i, s, k, [], []) for n, (i, s, k) in enumerate(rows)], "doc_id string, ordinal long, title string, summary string, keywords array<string>, entities array<string>, questions array<string>")
    chapters = docs.selectExpr("doc_id", "0 as section_index", "concat(doc_id, '#0') as chunk_id", "title", "summary", "keywords", "entities", "questions")
    return docs, chapters


def shape(tree):
    """The tree as nested tuples of names."""
    nodes = {r.node_id: r for r in tree.with_lists().collect()}

    def of(i):
        n = nodes[i]
        return (n.name, *map(of, n.children_ids)) if n.children_ids else n.name

    seen = set()

    def count(i):
        assert i not in seen
        seen.add(i)
        for c in nodes[i].children_ids:
            count(c)

    if tree.root:
        count(tree.root)
        assert seen == set(nodes)
    return of(tree.root) if tree.root else None


def test_build(spark):
    assert shape(trees.build(*docs_of(spark, []))) is None
    assert shape(trees.build(*docs_of(spark, [("a", "sa", [])]))) == "sa"
    assert shape(trees.build(*docs_of(spark, [("a", "sa", []), ("b", "sb", [])]))) == ("Root", "sa", "sb")
    five = trees.build(*docs_of(spark, [(c, f"s{c}", []) for c in "abcde"]))
    assert shape(five) == ("Root", ("类别 1", "sa", "sb"), ("类别 2", "sc", "sd"), "se")

    def cluster(prompt, kind):
        return json.dumps({"clusters": [{"name": " x ", "chunkIndices": [2, 0, 99, None]}, {"name": "", "chunkIndices": [0, 1]}, None]}) if kind == "CLUSTER_DOCUMENTS" else "[]"

    four = trees.build(*docs_of(spark, [(c, f"s{c}", []) for c in "abcd"]), ScriptedProvider(cluster))
    assert shape(four)[1:] == (("x", "sa", "sc"), "sb", "sd") or shape(four)[0] == "Root"
    one = trees.build(*docs_of(spark, [(c, f"s{c}", []) for c in "ab"]), ScriptedProvider(lambda p, k: '{"clusters": [{"name": "only", "chunkIndices": [0, 1]}]}' if k == "CLUSTER_DOCUMENTS" else "[]"))
    assert shape(one) == ("only", "sa", "sb")
    assert shape(trees.build(*docs_of(spark, [(c, f"s{c}", []) for c in "abcd"]), ScriptedProvider(lambda p, k: "broken"))) == ("Root", ("类别 1", "sa", "sb"), "sc", "sd")


def test_large_groups_are_clustered_by_the_model(spark, monkeypatch):
    """A thousand documents fall into the model's clusters, though no prompt holds them all; a category of 300 is described by all of them."""
    rows = spark.range(1000).selectExpr("'g' as `group`", "lpad(cast(id as string), 4, '0') as doc_id", "id as ordinal", "concat('topic', id % 7) as summary")

    def model(prompt, kind):
        groups: dict = {}
        for i, topic in re.findall(r"^\[(\d+)\].*?topic(\d)", prompt, re.M):
            groups.setdefault(topic, []).append(int(i))
        return json.dumps({"clusters": [{"name": f"T{t}", "chunkIndices": x} for t, x in groups.items()]})

    got = trees.clusters_of(rows, ScriptedProvider(model)).collect()
    assert len(got) == 1000 and len({r.cluster for r in got}) == 7
    assert all(r.cluster_name == f"T{int(r.doc_id) % 7}" for r in got)
    one_each = trees.clusters_of(rows, ScriptedProvider(lambda p, k: json.dumps({"clusters": [{"name": str(i), "chunkIndices": [i]} for i in range(200)]}))).collect()
    assert len(one_each) == 1000 and {r.cluster_name for r in one_each} == {"类别 1", "类别 2", "类别 3"}
    few = rows.where("ordinal < 300")
    docs = few.select("doc_id", F.concat(F.lit("word"), "doc_id").alias("summary"))
    said = trees.described(few, docs, ScriptedProvider(lambda p, k: json.dumps(re.findall(r"word\d+", p) if k == "EXTRACT_KEYWORDS" else []))).first()
    assert len(said.keywords) == 300


def test_attach(spark):
    def model(prompt, kind):
        if kind == "CLUSTER_DOCUMENTS":
            return '{"clusters": [{"name": "tech", "chunkIndices": [0, 1]}, {"name": "law", "chunkIndices": [2, 3]}]}' if "[3]" in prompt else "no"
        return json.dumps(["java"] if "java" in prompt else ["court"]) if kind == "EXTRACT_KEYWORDS" else "[]"

    old = trees.build(*docs_of(spark, [("a", "java a", ["java"]), ("b", "java b", ["java"]), ("c", "court c", ["court"]), ("d", "court d", ["court"])]), ScriptedProvider(model))
    assert shape(old)[1][0] == "tech"
    docs, chapters = docs_of(spark, [("n", "new", ["court", "judge"]), ("m", "more", ["garden"])])
    new = trees.attach(old, docs, chapters)
    got = shape(new)
    assert got[1][2] == ("law", "court c", "court d", "new") and got[2] == "more" and got[0] == "Root"
    law = new.nodes.where("name = 'law'").first()
    assert law.keywords == ["court", "judge"]
    assert {(r.keyword, r.node_id) for r in new.postings().collect()} >= {("judge", law.node_id)}
    assert shape(trees.attach(trees.build(*docs_of(spark, [])), docs, chapters)) == ("Root", "new", "more")


def test_offline_model(spark, nodes, entries):
    q = spark.createDataFrame([(1, "Java tutorial"), (2, "law")], "query_id int, query string")
    found, log = nav.navigate(q, nodes, "root", entries, None, OfflineProvider())
    assert {(r.query_id, r.chunk_id) for r in found.collect()} == {(1, "chunk1"), (2, "chunk2")} and log.count() == 2


def test_every_document_describes_its_category(spark):
    """Keywords of documents beyond the first prompt are among the category's."""
    docs, _ = docs_of(spark, [(f"d{i:03d}", f"word{i:03d}", []) for i in range(205)])
    said = ScriptedProvider(lambda p, kind: json.dumps(p.split(MARK)[1].split()))
    got = trees.described(docs.selectExpr("'g' as group", "doc_id", "ordinal"), docs, said).collect()
    assert [(r.group, sorted(r.keywords)) for r in got] == [("g", [f"word{i:03d}" for i in range(205)])]
