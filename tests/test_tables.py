"""Ranks, duplicates, prompts, hierarchies against plain versions."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tomelattice import schema, session
from tomelattice.functions.text import SIMILAR_AT
from tomelattice.model.provider import edit_similarity
from tomelattice.operators import dedupe, hierarchy, prompts, ranking
from tomelattice.operators.hierarchy import Hierarchy


def test_ranked(spark):
    df = spark.range(1000).selectExpr("id", "case when id % 3 = 0 then null when id < 700 then 1 else id % 5 end as g", "'x' as rank2")
    seen = defaultdict(list)
    for r in sorted(ranking.ranked(df, ["g"], ["id"], "r", "n").collect(), key=lambda r: r.id):
        seen[r.g].append((r.r, r.n))
    assert all([r for r, _ in v] == list(range(1, len(v) + 1)) and {n for _, n in v} == {len(v)} for v in seen.values())
    with pytest.raises(ValueError):
        ranking.ranked(df.withColumnRenamed("rank2", "r"), [], ["id"], "r")


def test_equal_parts_and_shards(spark):
    df = spark.range(11).selectExpr("id", "1 as g")
    assert [p for _, p in sorted((r.id, r.part) for r in ranking.equal_parts(df, ["g"], ["id"], 3).collect())] == [1] * 4 + [2] * 4 + [3] * 3
    assert [p for _, p in sorted((r.id, r.part) for r in ranking.equal_parts(df.limit(2), ["g"], ["id"], 3).collect())] == [1, 2]
    assert sorted((r.id, r.shard) for r in ranking.sharded(df, ["id"], 4).collect()) == [(i, i // 4) for i in range(11)]
    assert ranking.ranked(df.limit(0), [], ["id"]).count() == 0
    assert {r.shard for r in ranking.hash_sharded(df.withColumn("k", F.lit(None).cast("string")), "k", 4).collect()} == {0}


def test_new_documents(spark):
    batch = spark.createDataFrame([("a", 1), ("a", 0), ("b", 2), (None, 3), ("k", 4)], "md5 string, ordinal int")
    known = spark.createDataFrame([("k",), (None,)], "md5 string")
    assert sorted((r.md5 or "", r.ordinal) for r in dedupe.new_documents(batch, known).collect()) == [("", 3), ("a", 0), ("b", 2)]


def test_garbage(spark):
    old = spark.createDataFrame([("1", "s1"), ("2", "s2"), ("3", "s3"), ("4", None)], "chunk_id string, source string")
    new = spark.createDataFrame([("1", "s1"), ("2", "s9"), ("4", None)], "chunk_id string, source string")
    assert [r.chunk_id for r in dedupe.orphans(old, new, "chunk_id").collect()] == ["3"]
    assert [r.source for r in dedupe.orphaned_sources(old, new).collect()] == ["s2"]
    assert sorted((r.chunk_id, r.source) for r in dedupe.overlaid(old, new, "chunk_id").collect() if r.source) == [("1", "s1"), ("2", "s9"), ("3", "s3")]
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, None)], "id string, v int, t string")
    assert sorted((r.id, r.v, r.t) for r in dedupe.latest(rows, "id", "v").collect()) == [("a", 2, "y"), ("b", 1, None)]


def test_rules(spark):
    rows = spark.createDataFrame([("1", "t", None, "p"), ("", "t", "c", None), ("2", None, "c", None), ("3", "t", "", None)], "id string, title string, content string, file_path string")
    good, bad = schema.valid_documents(rows)
    assert [r.id for r in good.collect()] == ["1"] and {r.fault for r in bad.collect()} == {"no id", "no title", "neither content nor file_path"}
    kw = spark.createDataFrame([(" Java", None, None, "d", 0), ("java", "x", "", "d", 3), (None, "", "", "d", 1), (" ", "", "", "d", 1)], schema.DEFINITIONS)
    assert [(r.normalized, r.keyword, r.definition, r.frequency) for r in schema.valid_definitions(kw).collect()] == [("java", "Java", "", 3)]


def test_alike_against_all_pairs(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choices("ab中", k=rng.randint(0, 30))) for _ in range(60)]
    for t in list(texts):
        x = list(t * 2)
        for _ in range(rng.randint(0, 4)):
            if x:
                x[rng.randrange(len(x))] = rng.choice(["c", "", "dd"])
        texts += [t * 2, "".join(x)]
    texts += ["Same  Text", "same text", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, prompt string")
    norm = [None if t is None else " ".join(t.lower().split(" ")).strip() if "  " not in t else " ".join(t.lower().split()) for t in texts]
    want = {(i, j) for i in range(len(texts)) for j in range(i + 1, len(texts)) if None not in (norm[i], norm[j]) and norm[i] != norm[j] and edit_similarity(norm[i], norm[j]) >= SIMILAR_AT}
    got = {(r.id_a, r.id_b): r.similarity for r in prompts.alike(rows).collect()}
    assert {p for p in got if norm[p[0]] != norm[p[1]]} == want and len(want) > 20
    assert got[len(texts) - 3, len(texts) - 2] == 1.0


def test_rate_limit_against_fold(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice(["a", "b", None]), float(rng.randint(0, 2000))) for i in range(600)]
    df = spark.createDataFrame([*rows, (999, "a", None)], "id int, k string, t double")
    want = {}
    for k in ("a", "b", None):
        admitted = []
        for i, _, t in sorted((r for r in rows if r[1] == k), key=lambda r: (r[2], r[0])):
            want[i] = sum(x > t - 60 for x in admitted) < 5
            if want[i]:
                admitted.append(t)
    assert {r.id: r.admitted for r in prompts.rate_limited(df, "k", "t", "id").collect()} == want


def test_cache_and_usage(spark):
    rows = [(1, "A", "p", False, 4, 2, 10), (2, "A", "p", True, 4, 2, 20), (3, "A", "p", True, 4, 2, 0), (4, "ANSWER_QUESTION", "p", True, 1, 1, 5), (5, "ANSWER_QUESTION", "p", True, 1, 1, None)]
    df = spark.createDataFrame(rows, "at int, request_type string, prompt string, success boolean, input_tokens int, output_tokens int, duration_ms int")
    replayed = prompts.replayed(df, "at")
    assert {r.at: r.hit for r in replayed.collect()} == {1: False, 2: False, 3: True, 4: False, 5: False}
    stats = {r.request_type: r for r in prompts.cache_statistics(replayed).collect()}
    assert (stats["A"].hits, stats["A"].misses, stats["A"].entries) == (1, 2, 1)
    use = {r.request_type: r for r in prompts.usage(df, "request_type").collect()}
    assert (use["A"].calls, use["A"].total_tokens, use["A"].average_ms) == (3, 18, 10.0)
    assert prompts.usage(df.limit(0), "request_type").count() == 0


def plain_hierarchy(rows):
    ids = {i for i, _ in rows if i is not None}
    down = defaultdict(set)
    for i, c in rows:
        if i is not None:
            down[i] |= {x for x in c or [] if x in ids}
    listed = {x for s in down.values() for x in s}
    place = {i: (0, i) for i in ids - listed}
    layer = dict(place)
    while layer:
        new = {}
        for i, (n, r) in layer.items():
            for x in down[i]:
                if x not in place:
                    new[x] = min(new.get(x, (n + 1, r)), (n + 1, r))
        place |= new
        layer = new
    below = {}
    for i in ids:
        seen, todo = set(), list(down[i])
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += down[x]
        below[i] = seen
    return ids, place, below


@pytest.mark.parametrize("kernel", [1_000_000, 0])
def test_hierarchy_against_plain(spark, monkeypatch, kernel):
    """The same comes out of one task and of rounds over tables."""
    monkeypatch.setattr(hierarchy, "KERNEL", kernel)
    rows = []
    for seed, n in enumerate([1, 12, 40, 40, 60, 80]):  # graphs apart from each other
        rng = random.Random(seed)
        name = lambda i: f"{seed}n{i:02d}"  # noqa: B023, E731
        rows += [(name(i), [name(rng.randrange(i + 1, n)) for _ in range(rng.choice([0, 1, 1, 2]))] if i + 1 < n else None) for i in range(n)]
        rows += [(name(rng.randrange(n)), [name(rng.randrange(n)), None, "gone", ""]) for _ in range([1, 0, 3, 8, 0, 2][seed])]
    rows += [("x", ["y"]), ("y", ["x"]), ("self", ["self"]), ("4n03", ["x"]), ("u", ["v"]), ("v", ["w"]), ("w", ["u", "t"]), ("t", []), (None, ["4n00"])]
    ids, place, below = plain_hierarchy(rows)
    h = Hierarchy(spark.createDataFrame([(i, c, 1) for i, c in rows], "node_id string, children_ids array<string>, root string"))
    want = {(i, place.get(i, (0, ""))[1], place.get(i, (-1,))[0], int(i in below[i])) for i in ids}
    got = [tuple(r) for r in h.found().collect()]
    assert set(got) == want and len(got) == len(want)
    if not kernel:
        return
    table = h.table(paths=True).collect()
    assert {(r.node_id, r.root_id, r.node_depth, r.on_cycle) for r in table} == want and len(table) == len(ids)
    assert {(r.node, r.descendant) for r in h.descendants().collect()} == {(i, x) for i in ids for x in below[i]}
    # Ranges: a node's are inside its parent's and apart from its siblings'.
    at = {r.node_id: r for r in table if r.pre is not None}
    for r in at.values():
        if r.parent_id is not None:
            p = at[r.parent_id]
            assert p.pre < r.pre and r.pre + r.size <= p.pre + p.size
    for root in {r.root_id for r in at.values()}:
        assert sorted(r.pre for r in at.values() if r.root_id == root) == list(range(at[root].size))
    for r in at.values():
        assert len(r.path) == place[r.node_id][0] + 1 and r.path[0] == place[r.node_id][1] and r.path[-1] == r.node_id


def test_components(spark):
    links = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("e", "d"), ("e", "f"), ("f", "g"), ("x", "a"), ("s", "s"), ("g", "h"), ("h", "g2"), ("g2", "g"), ("g", "y")]
    got = {r.node: r.ring for r in hierarchy.components(spark.createDataFrame(links, "parent string, child string")).collect()}
    groups = {frozenset(k for k, v in got.items() if v == ring) for ring in got.values()}
    assert groups == {frozenset("abc"), frozenset("de"), frozenset("s"), frozenset(["g", "h", "g2"])}


def test_ranges_and_points(spark):
    rng = random.Random(1)
    ranges = [(i, "r", p := rng.randrange(200), rng.randrange(1, 201 - p)) for i in range(60)]
    points = [("r", rng.randrange(200), i) for i in range(80)]
    got = hierarchy.within(spark.createDataFrame(ranges, "id int, root string, pre long, size long"), spark.createDataFrame(points, "root string, at long, p int"))
    pairs = [(r.id, r.p) for r in got.collect()]
    assert sorted(pairs) == sorted((i, q) for i, _, pre, size in ranges for _, at, q in points if pre <= at < pre + size)


def test_long_rings_and_chains(spark, monkeypatch):
    """A ring and a chain of 10 000 nodes each, and a ring that a root leads to, take few written stages."""
    written = []
    begin = session.Stage.__init__
    monkeypatch.setattr(session.Stage, "__init__", lambda self, *a, **k: (written.append(1), begin(self, *a, **k))[1])
    n = 10_000
    name = "concat('{0}', lpad(cast({1} as string), 5, '0'))"
    ring = spark.range(n).selectExpr(f"{name.format('r', 'id')} as node_id", f"array({name.format('r', f'(id + 1) % {n}')}) as children_ids")
    chain = spark.range(n).selectExpr(f"{name.format('c', 'id')} as node_id", f"array({name.format('c', 'id + 1')}) as children_ids")
    led = spark.range(500).selectExpr(f"{name.format('l', 'id')} as node_id", f"array({name.format('l', '(id + 1) % 500')}) as children_ids")
    way = spark.createDataFrame([("top", ["l00003"])], "node_id string, children_ids array<string>")
    rows = Hierarchy(ring.union(chain).union(led).union(way)).found().collect()
    assert len(written) <= 60
    by = {r.node_id: r for r in rows}
    assert len(by) == 2 * n + 501 and all((r.on_cycle, r.root_id) == (1, "") for r in rows if r.node_id[0] == "r")
    assert all(by[f"c{i:05d}"].node_depth == i and not by[f"c{i:05d}"].on_cycle for i in range(n))
    assert all(by[f"l{i:05d}"].node_depth == 1 + (i - 3) % 500 and by[f"l{i:05d}"].on_cycle for i in range(500)) and not by["top"].on_cycle


def test_empty_hierarchy(spark):
    empty = Hierarchy(spark.createDataFrame([], "node_id string, children_ids array<string>"))
    assert empty.table().count() == 0 and empty.descendants().count() == 0
