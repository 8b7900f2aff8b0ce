"""Knowledge bases end to end, stores, sources, streams, hooks and model wrappers."""

import http.server
import io
import json
import logging
import re
import sys
import threading
import zipfile

import pyarrow as pa
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from tomelattice import schema
from tomelattice.engine import Engine, Settings
from tomelattice.errors import KnowledgeBaseError, StorageError
from tomelattice.functions.parsing import json_text
from tomelattice.hooks import TYPES, Hooks, logging_hook
from tomelattice.model.provider import MARK, CachedProvider, HttpProvider, OfflineProvider, RateLimitedProvider, Response, ScriptedProvider, SharedWindow, SlotProvider, composed
from tomelattice.operators.comprehend import understand
from tomelattice.operators.prompts import CACHE_LIMITS
from tomelattice.registry import CHUNK_STORE, DICTIONARY_STORE, Registry
from tomelattice.sources import charset, docx, files
from tomelattice.store import Store
from tomelattice.streaming.ingest import ingest_stream, table_stream
from tomelattice.streaming.limits import rate_limited_stream


_CHUNK_COLUMNS = re.split(r", (?=\w+ )(?![^<]*>)", schema.CHUNKS)
cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers don't know this file


def scripted(prompt, kind):
    text = prompt.split(MARK, 1)[1].lower()
    word = next((w for w in ("alpha", "gamma") if w in text), "beta")
    if kind == "COMPREHEND_CHUNK":
        if "poison" in text:
            raise RuntimeError("refused")
        return json.dumps({"summary": f"about {word}", "keywordDefinitions": [{"keyword": word}], "entities": [], "exampleQuestions": []})
    if kind == "CLUSTER_DOCUMENTS":
        return json.dumps({"clusters": [{"name": f"c{i}", "chunkIndices": [i]} for i in range(text.count("["))]})
    if kind == "DECIDE_NAVIGATION":
        return '{"action": "select_child", "selectedIndex": 0, "confidence": 0.9}'
    return {"EXTRACT_QUERY_KEYWORDS": word, "ANSWER_QUESTION": "it is " + text}.get(kind, "[]")


def test_lifecycle(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "alpha.md").write_text("# Alpha\nalpha body\n")
    (folder / "beta.md").write_text("# Beta\nbeta body\n")
    (folder / "copy.md").write_text("# Beta\nbeta body\n")
    (folder / "bad.md").write_text("poison")
    (folder / "gbk.txt").write_bytes(b"line\n" * 100 + "中文".encode("gbk"))
    engine = Engine(spark, f"file://{tmp_path}/root", ScriptedProvider(scripted), Settings(concurrent=2))
    assert engine.names() == ["default"]
    kb = engine.get()
    with pytest.raises(KnowledgeBaseError, match="NAV_001"):
        kb.search("alpha")
    report = {r.title: r for r in kb.ingest_files(f"file://{folder}").collect()}
    assert {t: (r.success, r.skipped) for t, r in report.items()} == {"alpha.md": (True, False), "beta.md": (True, False), "copy.md": (True, True), "bad.md": (False, False), "gbk.txt": (True, False)}
    assert "refused" in report["bad.md"].message
    with pytest.raises(KnowledgeBaseError, match="NAV_007"):
        kb.search(" ")
    for f in folder.iterdir():
        f.unlink()
    found = kb.read(kb.search("alpha?")).collect()
    assert [(r.section_title, r.summary, r.text) for r in found] == [("alpha.md", "about alpha", "# Alpha\nalpha body\n")]
    # A new handle sees what was committed, and takes in more.
    again = Engine(spark, f"file://{tmp_path}/root", ScriptedProvider(scripted)).get()
    docs = spark.createDataFrame([("g", "Gamma", "gamma body " + "x" * 1200, None), ("h", "", "no title", None), ("i", "Empty", " ", None)], "id string, title string, content string, file_path string")
    rows = {r.id: r for r in again.ingest_async(docs).result().collect()}
    assert rows["g"].success and not rows["h"].success and not rows["i"].success
    q = spark.createDataFrame([("1", "gamma"), ("2", "alpha")], "query_id string, query string")
    answers = {r.query_id: r for r in again.ask(q).collect()}
    assert "gamma body" in answers["1"].answer and "alpha body" in answers["2"].answer and len(answers["1"].sources) == 1
    assert again.statistics()["documents"] == 4
    # A reference is read from its file, as long as that is there.
    (folder / "ref.md").write_text("# Alpha two\nalpha again\n")
    fresh = engine.create("refs")
    fresh.ingest_files(f"file://{folder}", mode="REFERENCE", policy="CHAPTER")
    assert [r.text for r in fresh.read(fresh.search("alpha")).collect()] == ["# Alpha two\nalpha again\n"]
    (folder / "ref.md").unlink()
    assert [r.text for r in fresh.read(fresh.search("alpha")).collect()] == [None]
    engine.switch("refs")
    engine.delete("refs")
    assert engine.names() == ["default"] and engine.current == "default"
    for bad in ("a b", "", "x" * 51):
        with pytest.raises(StorageError):
            engine.create(bad)
    with pytest.raises(StorageError):
        engine.delete("default")
    again.rebuild(docs.limit(1))
    assert again.statistics()["documents"] == 1
    engine.close()


def test_settings():
    assert Settings(prompt_chars=1, threshold=1).prompt_chars == 200
    for bad in ({"concurrent": 0}, {"concurrent": 101}, {"max_steps": 4}):
        with pytest.raises(ValueError):
            Settings(**bad)


def test_store(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    assert store.pointer() is None and store.table("t", "id long").count() == 0
    store.commit({"t": spark.range(3)}, {"log": spark.range(1)}, root="a")
    store.commit({"t": store.table("t", "id long").where("id > 0")}, {"log": spark.range(5, 7)}, root="b")
    assert sorted(r.id for r in store.table("t", "").collect()) == [1, 2] and sorted(r.id for r in store.table("log", "").collect()) == [0, 5, 6]
    assert store.facts() == {"root": "b"}
    store.commit({"t": spark.range(1), "log": spark.range(1)})
    assert len(store.clean()) == 2 and store.table("log", "").count() == 1
    (tmp_path / "s" / "current.json").write_text("{")
    with pytest.raises(StorageError, match="STORAGE_004"):
        store.pointer()


def test_charsets():
    assert charset.detect(b"a" * 65535 + "中".encode()[:1], cut=True) == "UTF-8"
    assert charset.detect("中文".encode("gbk")) == "GBK" and charset.detect("﻿x".encode("utf-16-le")) == "UTF-16LE" and charset.detect(b"\xff\xff\xff") == "ISO-8859-1"
    assert charset.decode("中文".encode("gbk"), "UTF-8") == ("中文", "GBK")
    assert charset.decode(b"") == ("", "UTF-8")
    text = "line\n" * 6000 + "中文"
    assert charset.decode(text.encode("gbk")) == (text, "GBK")


def test_charset_columns(spark):
    rows = spark.createDataFrame([(1, bytearray("中".encode("gbk"))), (2, None)], "id int, b binary")
    got = {r.id: (r.d, r.x.text if r.x else None) for r in rows.select("id", charset.detected("b").alias("d"), charset.decoded("b").alias("x")).collect()}
    assert got[1] == ("GBK", "中") and got[2][0] is None


def test_docx_and_html():
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    run = lambda t, p="": f"<w:r><w:rPr>{p}</w:rPr><w:t>{t}</w:t></w:r>"
    body = (
        f'<w:p><w:pPr><w:pStyle w:val="H9"/></w:pPr>{run("Title")}</w:p><w:p>{run("plain ")}{run("bold", "<w:b/>")}{run("both", "<w:b/><w:i/>")}{run("off", chr(60) + "w:b w:val=" + chr(34) + "0" + chr(34) + "/>")}</w:p>'
        f'<w:p><w:pPr><w:numPr><w:ilvl w:val="0"/><w:numId w:val="1"/></w:numPr><w:ind w:left="1440"/></w:pPr>{run("item")}</w:p><w:p>{run("• dot")}</w:p>'
        f"<w:tbl><w:tr><w:tc><w:p>{run('a|b')}</w:p></w:tc><w:tc><w:p>{run('c')}</w:p></w:tc></w:tr><w:tr><w:tc><w:p>{run('d')}</w:p></w:tc></w:tr></w:tbl>"
    )
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{body}</w:body></w:document>")
        z.writestr("word/styles.xml", f'<w:styles {w}><w:style w:styleId="H9"><w:name w:val="heading 9"/></w:style></w:styles>')
        z.writestr("word/numbering.xml", f'<w:numbering {w}><w:abstractNum w:abstractNumId="0"><w:lvl w:ilvl="0"><w:numFmt w:val="decimal"/></w:lvl></w:abstractNum><w:num w:numId="1"><w:abstractNumId w:val="0"/></w:num></w:numbering>')
    assert docx.to_markdown(data.getvalue()).split("\n") == ["###### Title", "plain **bold*****both***off", "    1. item", "- • dot", "| a\\|b | c |", "| --- | --- |", "| d |  |"]
    assert files.extract("x.DOCX", b"no zip")[2].startswith("BadZipFile")
    assert files.html_to_markdown("<p>a &amp; b</p><h2 id=x>T <b>x</b></h2><script>no</script>c") == "a & b\n\n## T x\nc"
    assert files.extract("a.pdf", b"")[2] is not None or files.pypdf is not None


def test_understand():
    calls = []

    def answer(prompt, kind):
        calls.append((kind, prompt.split(MARK, 1)[1]))
        n = len(calls)
        return "all of it" if kind == "GENERATE_SUMMARY" else "```json\n" + json.dumps({"summary": f"s{n}", "keywordDefinitions": [{"keyword": "Key"}, {"keyword": "key"}, {"keyword": f"k{n}"}], "entities": ["e", " "], "exampleQuestions": None}) + "\n```"

    out = understand(ScriptedProvider(answer), "line\n" * 100, 200)
    assert [k for k, _ in calls] == ["COMPREHEND_CHUNK"] * 3 + ["GENERATE_SUMMARY"] and calls[1][1].startswith("s1\nKey, k1\n") and calls[-1][1] == "s1 s2 s3"
    assert (out["summary"], [d["keyword"] for d in out["definitions"]], out["entities"], out["calls"]) == ("all of it", ["Key", "k1", "k2", "k3"], ["e"], 4)
    assert understand(ScriptedProvider(answer), None)["calls"] == 0
    assert understand(SlotProvider(heavy=ScriptedProvider(lambda p, k: 1 / 0)), "x")["error"]


def test_answers_are_kept(spark, tmp_path):
    """Texts that were understood before are not asked again, nor are equal prompts; small batches write little."""
    calls = spark.sparkContext.accumulator(0)

    def counting(prompt, kind):
        calls.add(1)
        return scripted(prompt, kind)

    hooks, seen = Hooks(), []
    for kind in TYPES:
        hooks.register(kind, lambda e: seen.append(e.type))
    engine = Engine(spark, f"file://{tmp_path}/root", ScriptedProvider(counting), Settings(concurrent=2), hooks)
    kb = engine.get()
    docs = lambda *names: spark.createDataFrame([(n, n, f"# {n}\nthe words of {n}") for n in names], "id string, title string, content string")
    kb.ingest(docs(*(f"alpha{i:03d}" for i in range(60))))
    first = calls.value
    assert first > 0
    before = {n: len(f) for n, f in kb.store.pointer()["tables"].items()}
    report = kb.ingest(docs("alpha001", "gamma1", "poison"))
    assert {r.title: (r.success, r.skipped) for r in report.collect()} == {"alpha001": (True, True), "gamma1": (True, False), "poison": (False, False)}
    tables = kb.store.pointer()["tables"]
    assert all(len(tables[n]) == before[n] + 1 for n in ("nodes", "links", "held", "postings", "documents"))
    assert spark.read.parquet(f"file://{tmp_path}/root/default/{tables['nodes'][-1]}").count() <= 4 and kb.table("nodes").count() >= 61
    assert kb.table("nodes").count() == kb.table("nodes").select("node_id").distinct().count()
    calls.value = 0
    kb.rebuild(docs(*(f"alpha{i:03d}" for i in range(60))))
    assert calls.value == 0
    cache = engine.cache()
    assert cache.statistics()["COMPREHEND_CHUNK"]["hits"] >= 60 and "COMPREHEND_CHUNK: " in cache.text() and cache.sizes()["COMPREHEND_CHUNK"] == 61
    cache.log()
    cache.warm("EXTRACT_QUERY_KEYWORDS", {"q": "alpha"})
    assert cache.sizes()["EXTRACT_QUERY_KEYWORDS"] == 1
    cache.clear("EXTRACT_QUERY_KEYWORDS")
    cache.trim()
    assert "EXTRACT_QUERY_KEYWORDS" not in cache.sizes()
    cache.reconfigure(None)
    assert not cache.keeps("COMPREHEND_CHUNK")
    cache.reset()
    assert cache.statistics() == {}
    kb.search("alpha")
    assert set(seen) == set(TYPES) - {"CONTENT_READ"} and "NAVIGATION_STEP" in seen
    assert kb.chunk_exists(kb.chunk_ids().first()[0]) and not kb.chunk_exists("none") and kb.healthy()
    assert kb.contains_value("documents", "title", "alpha003") and not kb.contains_value("documents", "title", "gamma1")
    copied = kb.copy_sources(f"file://{tmp_path}/copies").collect()
    assert len(copied) == 60 and all(len(open(r.path, "rb").read()) == r.bytes > 0 for r in copied) and kb.usage()["texts"] > 0
    kb.clear()
    assert kb.table("documents").count() == 0 and kb.tree().root is None


def test_limit_of_all_workers(spark):
    """Calls of several workers take turns given out in one place."""
    window = SharedWindow(3, 1000.0)
    provider = RateLimitedProvider(ScriptedProvider(lambda p, k: "x"), window=window, sleep=None)

    def turns(batches):
        for b in batches:
            yield pa.record_batch([pa.array([provider.window.delay() for _ in range(b.num_rows)])], ["wait"])

    waits = sorted(r.wait for r in spark.range(6).repartition(3).select("id").mapInArrow(turns, "wait double").collect())
    window.close()
    assert waits[:3] == [0, 0, 0] and all(900 < w <= 1000 for w in waits[3:])


def test_http_provider():
    class Model(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            asked = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            body = json.dumps({"choices": [{"message": {"content": asked["messages"][0]["content"].upper()}}], "usage": {"prompt_tokens": 3, "completion_tokens": 2}}).encode()
            self.send_response(200 if asked["model"] == "m" else 500)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *args):
            pass

    server = http.server.HTTPServer(("127.0.0.1", 0), Model)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}/"
    good = HttpProvider(url, "m").chat("hi", "ANSWER_QUESTION")
    assert (good.content, good.input_tokens, good.output_tokens, good.success) == ("HI", 3, 2, True)
    assert not HttpProvider(url, "other").chat("hi", "ANSWER_QUESTION").success
    server.shutdown()
    assert not HttpProvider(url, "m", timeout=1).chat("hi", "ANSWER_QUESTION").success


def test_stores_by_kind(spark, tmp_path):
    stores = Registry()
    own = stores.find(CHUNK_STORE, spark, f"file://{tmp_path}/chunks")
    with pytest.raises(StorageError):
        own.ids()
    own.open(), own.open()
    row = lambda i, s: spark.createDataFrame([(i, s)], "chunk_id string, summary string").selectExpr(*(c.split()[0] if c.split()[0] in ("chunk_id", "summary") else f"cast(null as {c.split(' ', 1)[1]}) as {c.split()[0]}" for c in _CHUNK_COLUMNS))
    text = lambda i, t: spark.createDataFrame([(i, t)], schema.CHUNK_CONTENT)
    own.save(row("a", "1"), text("a", "x"))
    own.save(row("a", "2"), text("a", "xyz"))
    own.save(row("b", "3"), text("b", None))
    assert {r.chunk_id: r.summary for r in own.chunks().collect()} == {"a": "2", "b": "3"} and own.contents(["a"]).first().content == "xyz"
    assert own.exists("b") and not own.exists("c") and own.usage() == "2 chunks, 3 bytes"
    assert own.store.compact({"chunks": ["chunk_id"]}) == {"chunks": 3} and own.chunks().count() == 2
    own.delete(["a"])
    assert [r.chunk_id for r in own.ids().collect()] == ["b"] and own.healthy()
    own.clear()
    assert own.ids().count() == 0
    own.close()
    assert not own.healthy()
    words = stores.find(DICTIONARY_STORE, spark, f"file://{tmp_path}/words")
    words.open()
    words.save(spark.createDataFrame([], schema.DEFINITIONS), spark.createDataFrame([("k", "n", 0)], schema.POSTINGS))
    assert words.postings([" K "]).count() == 1 and words.definitions().count() == 0
    stores.register(CHUNK_STORE, "late", lambda: "late", 200)
    stores.register(CHUNK_STORE, "first", lambda: "first", 1)
    assert stores.names(CHUNK_STORE) == ["first", "folder", "late"] and stores.find(CHUNK_STORE) == "first" and stores.find(CHUNK_STORE, name="late") == "late"
    with pytest.raises(StorageError):
        stores.find("nothing")


def test_json_text(spark):
    row = spark.sql("select named_struct('a', 1, 'b', null) as s, array('x', null) as l, 'q\"' as t, cast(null as string) as n").select(*(json_text(c).alias(c) for c in "sltn")).first()
    assert json.loads(row.s) == {"a": 1, "b": None} and json.loads(row.l) == ["x", None] and json.loads(row.t) == 'q"' and row.n is None


def test_wrappers():
    asked = []

    class Base:
        def chat(self, prompt, kind):
            asked.append(prompt)
            return Response("", success=False) if prompt == "fails" else Response("x")

    kept = CachedProvider(Base(), CACHE_LIMITS | {"EXTRACT_KEYWORDS": (2, 1)}, similar=True)
    for p in ("i" + MARK + "hello world", "i" + MARK + "hello world", "i" + MARK + "hello xorld", "fails", "fails"):
        kept.chat(p, "EXTRACT_KEYWORDS")
    assert asked == ["i" + MARK + "hello world", "fails", "fails"] and kept.statistics()["hits"] == 2
    for p in ("aaaaaaaaaa", "bbbbbbbbbb", "cccccccccc"):
        kept.chat(p, "EXTRACT_KEYWORDS")
    assert kept.sizes() == {"EXTRACT_KEYWORDS": 2}
    kept.chat("q", "ANSWER_QUESTION"), kept.chat("q", "ANSWER_QUESTION")
    assert asked[-2:] == ["q", "q"]
    kept.warm("GENERATE_SUMMARY", {"w": "warm"})
    assert kept.chat("w", "GENERATE_SUMMARY").content == "warm"
    kept.clear()
    assert kept.sizes() == {}
    now, slept = [0.0], []

    def sleep(s):
        slept.append(s)
        now[0] += s

    limited = RateLimitedProvider(Base(), 2, 10.0, lambda: now[0], sleep)
    for _ in range(5):
        limited.chat("p", "EXTRACT_KEYWORDS")
    assert slept == [10.0, 10.0]
    assert composed(OfflineProvider(), CACHE_LIMITS, (5, 60.0)).chat("i" + MARK + "Some Words here. More.", "GENERATE_SUMMARY").content == "Some Words here."
    assert not OfflineProvider().chat("x", "NO_SUCH").success


def test_hooks(caplog):
    hooks, seen = Hooks(), []
    hooks.register("COMMITTED", lambda e: seen.append("late"), 5)
    hooks.register("COMMITTED", lambda e: 1 / 0, 0)
    hooks.register("COMMITTED", lambda e: seen.append(e.data["x"]), 1)
    hooks.register("COMMITTED", "tomelattice.hooks:logging_hook", 9)
    with caplog.at_level(logging.INFO):
        hooks.fire("COMMITTED", x=1)
    assert seen == [1, "late"] and "COMMITTED" in caplog.text
    with pytest.raises(ValueError):
        hooks.register("NONE", logging_hook)


def test_streams(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1), ("b", 2), ("a", 3)], "md5 string, ordinal int")
    rows.coalesce(1).write.parquet(str(tmp_path / "docs"))
    rows.selectExpr("if(md5 = 'b', 'c', md5) as md5", "ordinal + 10 as ordinal").coalesce(1).write.mode("append").parquet(str(tmp_path / "docs"))
    taken = []
    known = lambda: spark.createDataFrame([(m,) for m in taken], "md5 string")
    ingest_stream(table_stream(spark, str(tmp_path / "docs"), 1), lambda df, n: taken.extend(r.md5 for r in df.collect()), known, str(tmp_path / "cp")).awaitTermination()
    assert sorted(taken) == ["a", "b", "c"]


def test_rate_limited_stream(spark, tmp_path):
    events = spark.createDataFrame([(i, "k", 1e9 + 10 * i) for i in range(20)], "id int, k string, t double").select("id", "k", F.timestamp_seconds("t").alias("ts"))
    events.coalesce(1).write.parquet(str(tmp_path / "e"))
    out = rate_limited_stream(table_stream(spark, str(tmp_path / "e")), "k", "ts", "id")
    q = out.writeStream.format("memory").queryName("admitted").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {r.id: r.admitted for r in spark.table("admitted").collect()}
    assert got == {i: i % 6 < 5 for i in range(20)}
