"""Wrong charsets, pieces, packing, leakage, repetition and term counts."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tests.llm.test_sets import plain_tokens

from tomelattice.llm import leakage, mojibake, packing, repetition, splitting, terms


def sentences(rng, n):
    zh = ["数据库", "服务器", "在线", "备份", "应当", "立即", "检查", "配置", "的", "和", "由", "记录", "，", "。", "系统", "通知", "恢复"]
    fr = ["déjà", "près", "du", "dépôt", "créée", "où", "élève", "système", "à", "naïve", "Été"]
    de = ["größere", "Übung", "für", "schöne", "Straße", "und", "Änderung", "läuft"]
    ru = ["журнал", "очередь", "проверка", "узел"]
    ja = ["設定", "する", "ファイル", "です", "ノード"]
    en = ["the", "queue", "restarts", "every", "node", "“quoted”", "—"]
    out = []
    for _ in range(n):
        words = rng.choices([zh, fr, de, en, ru, ja], [6, 2, 2, 4, 0.4, 0.4])[0]
        out.append(("" if words in (zh, ja) else " ").join(rng.choices(words, k=rng.randint(15, 60))))
    return out


def test_restoring_undoes_garbling():
    rng = random.Random(1)
    for state in mojibake.PAIRS:
        lost = 0
        for t in sentences(rng, 60):
            clean = t.encode("gbk", "ignore").decode("gbk") if state.startswith("gbk") else t.encode("cp850", "ignore").decode("cp850") if state.startswith("cp850") else t.encode("latin-1", "ignore").decode("latin-1") if state.startswith("latin") else t
            back, whole = mojibake.restore(mojibake.garble(clean, state), state)
            assert not whole or back == clean
            lost += not whole
        if state in ("utf-8>latin-1", "utf-8>cp1252", "utf-8>mac-roman", "gbk>latin-1", "utf-8>cp1252 twice"):
            assert lost == 0


def test_held_out_accuracy(spark):
    """Clean texts and texts garbled in whole or in part, none of them seen before; quotations are no case."""
    rng = random.Random(2)
    plain = sentences(rng, 700)
    rows, truth, original = [], set(), {}
    for i, t in enumerate(plain):
        ref = f"r{i}"
        original[ref] = t
        if rng.random() < 0.1:
            state = rng.choice(list(mojibake.PAIRS))
            bad = mojibake.garble(t, state)
            whole = rng.random() < 0.5
            if sum(a != b for a, b in zip(bad, t)) > 5 and any(ord(c) > 127 for c in bad):
                truth.add(ref)
                t, original[ref] = (bad, t) if whole else (f"{plain[i - 1]}\n\n{bad}", f"{plain[i - 1]}\n\n{t}")
        elif rng.random() < 0.05:
            t = original[ref] = t + "\n`锟斤拷` `Ã¼` `" + mojibake.garble("数据库备份", "utf-8>gbk") + "`"
        rows.append(("s", ref, t, 1))
    rows += [("s", "null", None, 1), ("s", "empty", "", 1), ("s", "ascii", "abc", 1)]
    df = spark.createDataFrame(rows, "src string, ref string, text string, spans int")
    got = {r.ref: r for r in mojibake.garbled(df).collect()}
    hits = len(truth & set(got))
    assert hits >= 0.95 * len(truth) and len(set(got) - truth) <= 0.05 * len(truth) and len(truth) > 40
    whole = [r for r in got.values() if r.whole and r.ref in truth]
    assert len(whole) > len(truth) / 3 and sum(r.restored == original[r.ref] for r in whole) >= 0.9 * len(whole)
    assert mojibake.garbled(df.limit(0)).count() == 0


def test_viterbi_against_paths():
    rng = np.random.default_rng(3)
    import itertools

    for _ in range(20):
        g = rng.normal(0, 6, (5, 2)).astype(np.float32)

        def worth(path):
            total, now = 0.0, 0
            for t, s in enumerate(path):
                if s != now:
                    total += (mojibake.LEAVE if now else 0) + (mojibake.ENTER if s else 0)
                total += g[t, s - 1] if s else 0
                now = s
            return total + (mojibake.LEAVE if now else 0)

        best = max(map(worth, itertools.product(range(3), repeat=5)))
        assert worth(mojibake.viterbi([g, g[:3]])[0]) == pytest.approx(best, abs=1e-3)


def test_viterbi_decodes_only_what_may_be_garbled(monkeypatch):
    """Long clean stretches cost no steps, and change no state."""
    rng = np.random.default_rng(5)
    whole, decoded = mojibake._decoded, []
    monkeypatch.setattr(mojibake, "_decoded", lambda gains: decoded.extend(map(len, gains)) or whole(gains))
    sequences = []
    for n in (0, 1, 40, 2000, 3000):
        g = rng.normal(-3, 1, (n, 3)).astype(np.float32)
        for a in range(10, n - 20, 500):
            g[a : a + int(rng.integers(2, 9)), int(rng.integers(3))] = 4
        sequences.append(g)
    got = mojibake.viterbi(sequences)
    assert [x.tolist() for x in got] == [x.tolist() for x in whole(sequences)] and sum((x > 0).sum() for x in got) > 20
    assert sum(decoded) < 300


def test_surely_garbled_tries_few_charsets(monkeypatch):
    """Only charsets that a line's first character may have been read in are tried; what is found stays the same."""
    tried, encode = [], mojibake._encode
    monkeypatch.setattr(mojibake, "_encode", lambda *a: tried.append(a[1]) or encode(*a))
    assert not any(map(mojibake.surely_garbled, ["数据库服务器", "Привет мир", "naïve café", "日本語テスト", "“x” – y…"]))
    assert len(tried) <= 5
    for state in ("utf-8>latin-1", "utf-8>cp1252", "utf-8>mac-roman", "utf-8>cp1251"):
        assert mojibake.surely_garbled("abc\n" + mojibake.garble("Grüße aus Köln", state))
    assert mojibake.surely_garbled("汉字".encode().decode("gbk"))


alphabet = st.lists(st.sampled_from(["a", "中", "é", "😀", " ", "\n", "。", ". ", "# x\n", "\n\n", "第一章 x\n", "```\n", "word " * 30, "x" * 700, "汉" * 300]), max_size=120).map("".join)


@given(alphabet)
@settings(max_examples=150, deadline=None)
def test_pieces(text):
    data = text.encode()
    pieces = splitting.split(data)
    if len(data) <= splitting.LIMIT:
        assert pieces == ([(0, 0, len(data))] if data else [])
        return
    assert pieces[0][:2] == (0, 0) and pieces[-1][2] == len(data)
    for (a, _, e), (b, c, _) in zip(pieces, pieces[1:]):
        assert c == e and b >= a and splitting.LEAST <= c - b <= splitting.MOST
    for a, _, e in pieces:
        assert e - a <= splitting.LIMIT
        data[a:e].decode()


def test_cuts_at_headings():
    text = "".join(f"# part {i}\n" + "some words here. " * 90 + "\n" for i in range(4)).encode()
    cuts = [c for _, c, _ in splitting.split(text)[1:]]
    assert all(text[c:].startswith(b"# part") for c in cuts) and len(cuts) == 3


def test_oversized(spark):
    body = "一" * 900 + "\n"
    docs = spark.createDataFrame([("a", body + "x" * 10, 1), ("b", None, 1), ("c", "", 1), ("d", "é" * 3000, 1)], "doc string, text string, piece int")
    refs = spark.createDataFrame([("a", 0, 0), ("a", 0, 0), ("a", 3, 2701), ("b", 0, 0), ("c", 0, 0), ("d", 0, -5), ("d", 1, 99_999), ("d", None, 0), (None, 0, 0), ("gone", 0, 0)], "doc string, section int, begin long")
    got = defaultdict(list)
    for r in splitting.oversized(docs, refs).orderBy("doc", "section", "piece").collect():
        got[r.doc, r.section].append(r)
    assert set(got) == {("a", 0), ("d", 0)}
    assert "".join(r.text[len(r.text.encode()[: r.byte_cut - r.byte_begin].decode()) :] for r in got["a", 0]) == body
    assert splitting.oversized(docs.limit(0), refs.limit(0)).count() == 0


def test_best_pattern():
    rng = np.random.default_rng(4)
    import itertools

    for _ in range(20):
        worth = np.where(rng.random(6) < 0.3, -np.inf, rng.normal(0, 1, 6))
        want = max((sum(worth[i - 1] for i in c) for k in range(1, 5) for c in itertools.combinations_with_replacement(range(1, 7), k) if sum(c) == 6), default=-np.inf)
        value, counts = packing.best_pattern(worth, 6, 4)
        assert value == pytest.approx(want) if np.isfinite(want) else value == -np.inf
        assert not np.isfinite(want) or ((counts * np.arange(1, 7)).sum() == 6 and counts.sum() <= 4)


@given(st.lists(st.integers(0, 40), min_size=16, max_size=16))
@settings(max_examples=30, deadline=None)
def test_plans(counts):
    h = np.array(counts)
    containers = packing.plan(h)
    total = sum((c * n for c, n in containers), np.zeros(16, np.int64))
    assert (total == h).all() and all((c * np.arange(1, 17)).sum() <= 16 and n > 0 for c, n in containers)
    used = sum(n for _, n in containers)
    assert used <= 1.2 * (h * np.arange(1, 17)).sum() / 16 + (h * (np.arange(1, 17) > 8)).sum() + 2


def test_pack(spark):
    pytest.importorskip("tiktoken")
    rng = random.Random(5)
    texts = [" ".join(rng.choices(["token", "数据", "x1", "."], k=rng.choice([1, 30, 200, 700, 1500, 4000]))) for _ in range(300)]
    texts += [texts[0]] * 50 + [None, ""]
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "id int, text string, container int").repartition(5)
    rows = packing.pack(df, "id", "text").collect()
    encode = packing.tokenizer(packing.VOCABULARY).encode_ordinary
    by_doc, load = defaultdict(list), Counter()
    for r in rows:
        by_doc[r.doc].append(r)
        if r.container is not None:
            load[r.container] += r.tokens
    assert max(load.values()) <= 2048 and sum(load.values()) >= 0.95 * 2048 * (len(load) - 1)
    assert set(load) == set(range(len(load)))
    for i, t in enumerate(texts):
        n = len(encode(t or ""))
        parts = sorted((r.token_begin, r.tokens) for r in by_doc[i])
        assert sum(x for _, x in parts) == n and (len(parts) == 1 or n > 2048) and all(b == 2048 * k for k, (b, _) in enumerate(parts))
        assert n or by_doc[i][0].container is None
    assert packing.pack(df.limit(0), "id", "text").count() == 0


def grams(text, k):
    t = plain_tokens(text)
    return [tuple(t[i : i + k]) for i in range(len(t) - k + 1)]


def test_leaked(spark, monkeypatch):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(300)]
    items = [" ".join(rng.choices(words, k=rng.randint(10, 80))) for _ in range(60)] + ["a " * 40, None, "", "x y " * 15]
    items.append(items[0])
    docs = []
    for i in range(400):
        t = rng.choices(words, k=rng.randint(0, 300))
        if i % 4 == 0:
            w = (rng.choice(items) or "").split()
            n = rng.choice([15, 19, 20, 21, 40])
            at = rng.randint(0, max(0, len(w) - n))
            t[rng.randint(0, len(t)) :][:0] = w[at : at + n]
            k = rng.randint(0, len(t))
            t = t[:k] + w[at : at + n] + t[k:]
        docs.append(" ".join(t))
    docs += [None, "", "a " * 25, "b " + "x y " * 400, items[1], "中" * 30_000]
    exact = {i: set(grams(t, 20)) for i, t in enumerate(items)}
    want = {(d, i): len(x) for d, t in enumerate(docs) for g in [set(grams(t, 20))] for i, e in exact.items() if (x := g & e)}
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(docs)], "id int, text string, item int").repartition(3)
    it = spark.createDataFrame([(i, t, 1) for i, t in enumerate(items)], "id int, text string, doc int")
    got = {(r.doc, r.item): r.common for r in leakage.leaked(df, "id", "text", it, "id", "text").collect()}
    assert got == want and len(want) > 50
    monkeypatch.setattr(leakage, "ITEM_CHARS", 3000)
    assert {(r.doc, r.item): r.common for r in leakage.leaked(df, "id", "text", it, "id", "text").collect()} == want
    assert leakage.leaked(df, "id", "text", it.limit(0), "id", "text").count() == 0
    assert leakage.leaked(df.limit(0), "id", "text", it, "id", "text").count() == 0


def test_repetition(spark):
    rng = random.Random(7)
    words = [f"w{i}" for i in range(500)]
    texts = []
    for i in range(600):
        t = rng.choices(words, k=rng.randint(5, 200))
        if i % 20 == 0:
            t = t[:20] * rng.randint(2, 12) + t[20:]
        texts.append(" ".join(t))
    texts += [None, "", "a " * 39, "a " * 40, "line\n" * 3000]
    share = lambda t: 1 - len(set(grams(t, 8))) / len(grams(t, 8)) if grams(t, 8) else 0.0
    df = spark.createDataFrame([(i, t, 0.5) for i, t in enumerate(texts)], "id int, text string, score double")
    rows = {r.ref: r for r in repetition.repetition(df, "id", "text").collect()}
    assert len(rows) == len(texts)
    for i, t in enumerate(texts):
        assert rows[i].share == pytest.approx(share(t)) and rows[i].tokens == len(plain_tokens(t))
    want = {i for i, t in enumerate(texts) if len(plain_tokens(t)) >= 40 and share(t) >= 0.3}
    passed = {i for i, r in rows.items() if r.anomalous}
    assert want <= passed and len(passed) < len(texts) / 4 and len(want) > 10
    assert repetition.repetition(df.limit(0), "id", "text").count() == 0


def test_forest_isolates_outliers():
    rng = np.random.default_rng(8)
    rows = np.concatenate([rng.normal(0, 0.05, (500, 5)), rng.normal(1, 0.05, (10, 5))])
    score = repetition.IsolationForest(rows).score(rows)
    assert score[500:].min() > score[:500].mean() + 2 * score[:500].std()
    forest, threshold = repetition.fit(np.abs(rows), np.arange(510) >= 500)
    assert (forest.score(np.abs(rows))[500:] >= threshold).all()
    assert repetition.fit(rows, np.zeros(510, bool)) == (None, 0.0)


@given(st.lists(st.integers(0, 65535), max_size=300), st.booleans())
@settings(max_examples=50, deadline=None)
def test_containers(ids, many):
    x = np.unique(np.array(ids + list(range(5000)) * many, np.int64))
    assert terms.unpack(terms.pack(x)).tolist() == x.tolist()


def test_patterns_of_short_texts():
    """Where texts are short, patterns have as many of them as fill a container, and hold most."""
    size = packing.CAPACITY // packing.GRAIN
    histogram = np.zeros(size, np.int64)
    histogram[[4, 6, 10, 14]] = [700, 500, 300, 200]
    few = packing.most_together(histogram)
    patterns, x = packing.fit(histogram, few=few)
    lengths = np.arange(1, size + 1)
    assert few > packing.FEW and len(patterns) and (patterns @ lengths <= size).all()
    held = (np.floor(x + 1e-6)[:, None] * patterns).sum()
    assert held >= histogram.sum() / 2
    containers = packing.plan(histogram)
    assert (sum(c * n for c, n in containers) == histogram).all() and sum(n for _, n in containers) <= 1.1 * (histogram @ lengths) / size + 1


def test_frequencies(spark):
    rng = random.Random(9)
    rows = [(rng.choice(["s", "t"]), rng.choice([" A", "a", "b\t", "中", "", None, f"k{rng.randint(0, 40)}"]), rng.choice([None, "", *(f"r{i}" for i in range(60))]), rng.choice([None, 0, -1, 1, 3, 9]), "x") for _ in range(3000)]
    rows += [("s", "only null", None, 3, "x")] + [("t", "hot", f"r{i % 60}", 2, "x") for i in range(3000)]
    best = defaultdict(dict)
    size = defaultdict(set)
    for s, k, r, n, _ in rows:
        if k is None:
            continue
        own = best[s, k.strip("".join(map(chr, range(33)))).lower()]
        if r:
            own[r] = max(own.get(r, 0), max(n or 1, 1))
            size[s].add(r)
    want = {}
    for (s, k), own in best.items():
        n, total = len(own), sum(own.values())
        want[s, k] = (n, total, "common" if n > 0.05 * len(size[s]) else "rare" if 0 < n <= 2 and total <= 5 else None)
    df = spark.createDataFrame(rows, "src string, term string, record string, n int, block string").repartition(4)
    got = {(r.src, r.term): (r.records, r.total, r.mark) for r in terms.frequencies(df).collect()}
    assert got == want
    assert terms.frequencies(df.limit(0)).count() == 0


def test_learned_from_all_texts(spark):
    """What is only in the last, short text among long ones is known as well."""
    rng = random.Random(7)
    zh = "".join(rng.choices("数据库服务器在线备份应当立即检查配置的和由记录，。系统通知恢复", k=60_000)) + "\n"
    ru = [" ".join(rng.choices(["журнал", "очередь", "проверка", "узел", "запись", "сервер"], k=60)) for _ in range(21)]
    rows = [("a", "long", zh * 33), ("b", "clean", "\n".join(ru[:20])), ("c", "bad", mojibake.garble(ru[20], "utf-8>cp1252"))]
    texts = spark.createDataFrame(rows, "src string, ref string, text string").coalesce(1)
    assert set(map(ord, "".join(ru[:20]))) - {32, 10} <= set(mojibake.learn(texts.select("text")).clean.tolist())
    got = {r.ref: r.restored for r in mojibake.garbled(texts).collect()}
    assert got == {"bad": ru[20]}


def test_unknown_script_is_restored(spark):
    """Garbled text in a script that no clean text has, but that a strict inverse restores, is found."""
    rng = random.Random(8)
    zh = ["".join(rng.choices("数据库服务器在线备份应当立即检查配置的和由记录，。、「」系统通知恢复", k=80)) for _ in range(300)]
    kana = "".join(rng.choices("あいうえおかきくけこさしすせそたちつてとなにぬねの", k=40))
    rows = [("a", str(i), t) for i, t in enumerate(zh)] + [("c", "bad", mojibake.garble(kana, "utf-8>latin-1"))]
    got = {r.ref: r.restored for r in mojibake.garbled(spark.createDataFrame(rows, "src string, ref string, text string")).collect()}
    assert got == {"bad": kana}
