"""The training-data operators against brute force, on small tables with nulls, empty and long texts, ties, copies and extra columns."""

import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from snapforge.llm import jaccard_join, language_id, license_scan, mixing, multi_index, packing, preference, token_counts, url_filter
from snapforge.llm.common import connected_components, fresh_path

R = random.Random(5)
WORDS = ["the", "of", "casa", "und", "être", "x1", "don't", "naïve", "state-of-the-art", "3.14", "END.", "ñandú", "日本", "  ", "<|endoftext|>", "\t"]


def texts(n):
    out = [" ".join(R.choice(WORDS) for _ in range(R.randint(0, 60))) for _ in range(n)]
    return out + [None, "", "   ", out[0], "a" * 20_000, "word " * 30_000]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, ["s1", "s2", None][i % 3], "en", i, "clash") for i, t in enumerate(texts(60))]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long, digest string")


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (3, 2), (4, 3), (9, 8), (7, 9), (5, 5)], "a long, b long")
    assert dict(map(tuple, connected_components(edges).collect())) == {1: 1, 2: 1, 3: 1, 4: 1, 7: 7, 8: 7, 9: 7}


def test_components_of_more_edges_than_a_task_takes(spark, monkeypatch):
    from snapforge.llm import common

    monkeypatch.setattr(common, "CONTRACTED", 20)
    r = random.Random(9)
    pairs = [(i, i + 1) for i in range(0, 60)] + [(r.randrange(100, 400), r.randrange(100, 400)) for _ in range(180)] + [(500, 500 + i) for i in range(1, 50)]
    edges = spark.createDataFrame(pairs, "a long, b long").repartition(6)
    parent = {x: x for p in pairs for x in p}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = dict(map(tuple, connected_components(edges).collect()))
    assert got == {x: find(x) for x in parent if any(x in p and p[0] != p[1] for p in pairs)}


def test_token_counts(spark, docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(token_counts.tokenizer_path("byte_bpe_50k.json"))
    cache = fresh_path(spark, "cache")
    got = {r.doc_id: (r.n_bytes, r.n_tokens) for r in token_counts.count_tokens(docs, cache, tokenizer="byte_bpe_50k.json").collect()}
    for r in docs.collect():
        x = r.text or ""
        assert got[r.doc_id] == (len(x.encode()), len(t.encode(x, add_special_tokens=False).ids))
    before = spark.read.parquet(cache).count()
    assert before == docs.select(F.coalesce("text", F.lit(""))).distinct().count()
    again = token_counts.count_tokens(docs, cache, tokenizer="byte_bpe_50k.json")
    assert again.count() == docs.count() and spark.read.parquet(cache).count() == before
    assert token_counts.count_tokens(docs.where("false"), fresh_path(spark, "cache"), tokenizer="byte_bpe_50k.json").count() == 0


def test_packing(spark, docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.tokenizer_path("word_bpe_49k.json"))
    rows = packing.pack_documents(docs, window=256).collect()
    want = {r.doc_id: np.array([*t.encode(r.text or "", add_special_tokens=False).ids, 2], "<u4") for r in docs.collect()}
    by: dict = {}
    for r in rows:
        piece = want[r.doc_id][r.start : r.start + r.length]
        assert len(piece) == r.length and zlib.crc32(piece.tobytes()) == r.ids_crc32 and r.doc_tokens == len(want[r.doc_id])
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert sum(r.length for r in rows) == sum(map(len, want.values()))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 256
    assert len(by) <= 1.05 * sum(map(len, want.values())) / 256 + 2
    assert packing.pack_documents(docs.where("false")).count() == 0


def test_word_ids_are_the_library_s():
    atoms = ["'s", "'t", "'re", "'ve", "'ll", "'m", "'d", "'S", "'RE", "'", "don't", "Hello", "wörld", "<|endoftext|>", "<|", "|>", "<", "|", "é", "É", "İ", "ß", "ſ", "ǅ", "1", "23", "_", "!", "?'s", " ", "  ", "\t", "\n", "\x0b"]
    atoms += ["\x1c", "\x85", "\xa0", "\u3000", "日本", "🙂", "a", "B", "\xad", "²", "½", "µ", "×", "ª", "º", "\x00", "\u0301", "ɐ", "ɏ", "Straße", "'r", "'l", "re"]
    r = random.Random(4)
    rows = ["".join(r.choice(atoms) for _ in range(r.randint(0, 12))) for _ in range(6000)] + [None, "", "word " * 3000, "x" * 5000]
    encode = packing.WordIds("word_bpe_49k.json")
    for _ in range(2):  # the second time from what it kept
        ids, offsets = encode(pa.array(rows))
        for x, a, b in zip(rows, offsets, offsets[1:]):
            assert ids[a:b].tolist() == encode.tokenizer.encode(x or "", add_special_tokens=False).ids, x
    assert encode(pa.array([], pa.string()))[1].tolist() == [0]


def test_packing_ties_and_whole_windows(spark):
    one = ["a"] * 15, ["a"] * 16, ["a"] * 31, ["a"] * 32, ["a"] * 14
    rows = [(i % 3, " ".join(x)) for i, x in enumerate(one * 4)]
    got = packing.pack_documents(spark.createDataFrame(rows, "doc_id long, text string"), window=16).collect()
    assert sum(r.length for r in got) == 4 * sum(len(x) + 1 for x in one) and len({(r.sequence_id, r.offset) for r in got}) == len(got)
    assert sum(r.length == 16 for r in got) == 4 * (1 + 1 + 2 + 2)


def test_least_squares():
    a = np.array([[1.0, 0, 2], [0, 1, 1]])
    x = packing.least_squares(a, np.array([4.0, 2.0]))
    assert (x >= 0).all() and np.allclose(a @ x, [4, 2])
    assert (packing.least_squares(np.eye(2), np.array([-1.0, 3.0])) == [0, 3]).all()
    plan = packing.plan_patterns({5: 3, 11: 3, 16: 2, 1: 7}, 16, grid=4)
    assert sum(n * sum(p) for p, n in plan) == 15 + 33 + 32 + 7 and all(sum(p) <= 16 for p, _ in plan)


def test_mixing(spark, docs):
    rows = mixing.mix_plan(docs).collect()
    total = sum(r["size"] for r in rows)
    sources = {r.source: (r.source_size, r.target) for r in rows}
    assert sum(t for _, t in sources.values()) == pytest.approx(total) and all(t <= 3 * s + 1e-9 for s, t in sources.values())
    for s, (_, t) in sources.items():
        taken = sum(r["size"] * r.repeats for r in rows if r.source == s)
        assert abs(taken - t) <= max(r["size"] for r in rows if r.source == s) and all(0 <= r.repeats <= 3 for r in rows)
    assert sorted(map(tuple, mixing.mix_plan(docs).collect()), key=str) == sorted(map(tuple, rows), key=str)
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r.repeats for r in rows)
    assert mixing.mix_plan(docs.where("false")).count() == 0


def test_language(spark):
    words = {"aa": "the and that with from have".split(), "bb": "der und das ist nicht mit".split(), "cc": "les des une dans pour être".split()}
    rows = [(i, " ".join(R.choice(words[k]) for _ in range(R.randint(3, 40))), k) for i, k in enumerate(list(words) * 40)]
    docs = spark.createDataFrame([*rows, (900, None, None), (901, "12 34", "aa"), (902, "", "bb"), (903, "und das " * 20_000, "bb")], "doc_id long, text string, lang string").withColumn("score", F.lit("clash"))
    models = language_id.train(language_id.sample(docs.where(~language_id.held_out())))
    got = {r.doc_id: r for r in language_id.predict(docs, models).collect()}
    assert all(got[i].lang_pred == k for i, _, k in rows) and got[903].lang_pred == "bb"
    assert all(got[i].lang_pred == "und" and got[i].score == 0 and got[i].rejected for i in (900, 901, 902))
    assert all(0 <= r.score <= 1 for r in got.values()) and sum(got[i].rejected for i, *_ in rows) <= 1
    none = language_id.train(language_id.sample(docs.where("false")))
    assert {r.lang_pred for r in language_id.predict(docs, none).collect()} == {"und"}
    logs = models.log_probability(*language_id.symbols(["the"], models.alphabet)[:2])
    assert np.isfinite(logs).all()


def brute_components(rows):
    sets, parent = {}, {}
    for i, t in rows:
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        w = [x for x in __import__("re").split("[\x20\x09-\x0d]+", lowered) if x]
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
        parent[i] = i

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for x in ids:
        for y in ids:
            if x < y and sets[x] and sets[y] and 4 * len(sets[x] & sets[y]) >= 3 * len(sets[x] | sets[y]):
                a, b = find(x), find(y)
                parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_jaccard_join(spark):
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    for n in (1, 3, 5, 7, 9, 12, 20, 40, 90, 200, 500, 900):
        for _ in range(4):
            base = [R.choice(vocabulary) for _ in range(n)]
            rows += [base, list(base)]
            for edits in (1, 2, 3, max(1, n // 60), max(1, n // 40)):
                copy = list(base)
                for _ in range(edits):
                    copy[R.randrange(len(copy))] = R.choice(vocabulary)
                rows.append(copy)
    data = [(i, " ".join(w).upper() if i % 7 == 0 else "\n".join(w)) for i, w in enumerate(rows)] + [(5000, None), (5001, ""), (5002, " \t ")]
    docs = spark.createDataFrame([(i, t, "clash") for i, t in data], "doc_id long, text string, n_shingles string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(docs).collect()}
    assert got == brute_components(data)
    assert jaccard_join.jaccard_components(docs.where("false")).count() == 0
    rows = docs.where("doc_id % 9 = 0 OR doc_id > 4000")
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(rows, exact=True).collect()} == brute_components([x for x in data if x[0] % 9 == 0 or x[0] > 4000])


def test_jaccard_join_of_a_hot_family(spark, monkeypatch):
    """Copies of copies, whose chains join sets that don't link, over several map tasks and group tiles; null and repeated ids."""
    monkeypatch.setattr(jaccard_join, "DEAL", 300)
    r = random.Random(8)
    base = [f"v{r.randrange(500)}" for _ in range(120)]
    rows = []
    for i in range(160):
        base = list(base) if i % 20 else [f"u{r.randrange(50)}" for _ in range(40)] + base[40:]
        base[r.randrange(len(base))] = f"n{i}"
        rows.append((i, " ".join(base)))
    rows += [(200 + i, rows[i][1]) for i in range(0, 160, 11)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard_join.jaccard_components(docs).collect()}
    want = brute_components(rows)
    assert got == want and 1 < len({c for _, c in want.values()}) < 100
    odd = spark.createDataFrame([(None, "a b c"), (None, "a b c"), (1, "a b c"), (1, "d e f"), (2, "d e f")], "doc_id long, text string")
    assert sorted(map(tuple, jaccard_join.jaccard_components(odd).collect()), key=str) == [(1, 1, 1), (1, 1, 1), (2, 1, 1), (None, 1, None), (None, 1, None)]


def test_groups_of_signatures():
    """Map side and reduce side together connect all members of a group, by edges that have its number if it has three or more."""
    r = random.Random(3)
    rows = [(r.randrange(40), i, r.randrange(1, 60) * 2) for i in range(300)]
    onward, edges = [], []
    for k in range(0, 300, 50):
        part = [np.array(x, t) for x, t in zip(zip(*rows[k : k + 50]), (np.uint64, np.int64, np.uint64))]
        on, e = jaccard_join._group(*part, everywhere=False)
        onward.append(on)
        edges += e
    _, e = jaccard_join._group(*(np.concatenate(x) for x in zip(*onward)), everywhere=True)
    dig = {i: d for _, i, d in rows}
    of: dict = {}
    for a, b, gids in edges + e:
        for x, y, own in zip(a.to_pylist(), b.to_pylist(), gids.to_pylist()):
            for g in own or [None]:
                of.setdefault(g, []).append((x, y))
    for s in {s for s, _, _ in rows}:
        own = {i for t, i, _ in rows if t == s}
        kinds = {dig[i] for i in own}
        tree = of.get(s, []) if len(kinds) > 2 else of.get(s, []) + of.get(None, [])
        reached, todo = set(), [min(own)]
        while todo:  # by edges and equal digests
            x = todo.pop()
            if x not in reached:
                reached.add(x)
                todo += [b for a, b in tree if a == x] + [a for a, b in tree if b == x] + [y for y in own if dig[y] == dig[x]]
        assert own <= reached


def test_local_stars():
    from snapforge.llm.common import local_stars

    r = np.random.default_rng(4)
    for n in (1, 5, 60, 400):
        u, v = r.integers(0, 300, n), r.integers(0, 300, n)
        a, b = local_stars(u, v)
        parent = {int(x): int(x) for x in (*u, *v)}

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for x, y in zip(u.tolist(), v.tolist()):
            p, q = find(x), find(y)
            parent[max(p, q)] = min(p, q)
        assert {x: find(x) for x in parent if find(x) != x} == dict(zip(b.tolist(), a.tolist()))


def test_schemes():
    for band in range(2, 40):
        plan = jaccard_join.scheme(band)
        k = 2 * (int(jaccard_join.bands()[band + 1]) - 1) // 7
        if plan and k <= jaccard_join.LARGE:
            n1, n2, choices, _, _ = plan
            assert n2 - choices.shape[1] == -(-(k + 1) // n1) - 1


def vectors(spark, n=400, d=16):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(n, d))
    x[100:160] = x[7] + rng.normal(size=(60, d)) * 0.05
    x[200:203] = x[9]
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    rows += [(1000, None), (1001, [0.0] * d), (1002, [float("nan")] * d), (1003, [None] * d), (1004, [1.0])]
    return x, spark.createDataFrame([(*r, "clash") for r in rows], "vec_id long, embedding array<double>, component_id string")


def test_near_duplicate_vectors(spark):
    x, rows = vectors(spark)
    got = {r.vec_id: r for r in multi_index.near_duplicates(rows).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    links = (u @ u.T >= 0.9) & ~np.eye(len(u), dtype=bool)
    assert [got[i].n_links for i in range(len(x))] == links.sum(1).tolist()
    assert got[150].component_id == 7 and got[7].kept and not got[150].kept
    assert all(got[i].n_links == 0 and got[i].component_id == i and got[i].kept for i in range(1000, 1005))
    assert multi_index.near_duplicates(rows.where("false")).count() == 0


def test_links_at_the_threshold(spark):
    """Cosines of 27/30, 54/60, and of any two of ten equal components of eleven, are 0.9; 26/30 is below it."""
    exact = [[3, 4, 1, 2, 0], [3, 4, 2, 0, 1], [2, 5, 2, 4, 0], [5, 5, 4, 5, 3], [3, 4, 1, 0, 2]]
    rows = [(i, [float(c) for c in [0] * 5 * (i // 2) + v] + [0.0] * (10 - 5 * (i // 2))) for i, v in enumerate(exact[:4])]
    ten = np.zeros((40, 24))
    rng = np.random.default_rng(1)
    for row in ten:
        row[rng.permutation(11)[:10]] = 0.1
    for table, links in ((rows, [1] * 4), (list(enumerate(ten.tolist())), [39] * 40)):
        got = multi_index.near_duplicates(spark.createDataFrame(table, "vec_id long, embedding array<double>")).orderBy("vec_id").collect()
        assert [r.n_links for r in got] == links
    x = multi_index.scaled(np.array(exact, float)).T
    assert multi_index.meets(0.9, x, x, np.array([0, 2, 0]), np.array([1, 3, 4])).tolist() == [True, True, False]
    far = multi_index.scaled(np.array([[1e300, 1e300], [1e-310, 0.0]]))
    assert np.isfinite(far).all() and (np.abs(far).max(1) >= 0.5).all()


def test_nearest(spark):
    x, rows = vectors(spark)
    got: dict = {}
    for r in multi_index.nearest(rows, "vec_id % 10 = 0", k=5).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    hits = 0
    for q in range(0, 400, 10):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[q] = np.inf
        assert len(got[q]) == 5 and all(s == pytest.approx(d[v]) for v, s in got[q]) and [s for _, s in got[q]] == sorted(s for _, s in got[q])
        hits += len({v for v, _ in got[q]} & set(np.lexsort((np.arange(400), d))[:5].tolist()))
    assert hits >= 0.9 * 5 * 40 and not set(got) & set(range(1000, 1005))


def test_vectors_of_large_cells_and_odd_ids(spark, monkeypatch):
    """Cells of several tiles, ids with a common factor, repeated rows of one id, floats, ties, and fewer candidates than asked for."""
    monkeypatch.setattr(multi_index.tiles, "__defaults__", (16,))
    rng = np.random.default_rng(8)
    x = rng.normal(size=(240, 8)).astype(np.float32)
    x[40:140] = x[0] + rng.normal(size=(100, 8)).astype(np.float32) * np.float32(0.03)
    x[200:206] = x[5]
    rows = [(i * 64, x[i].tolist()) for i in range(len(x))]
    vectors = spark.createDataFrame(rows + [rows[5]], "vec_id long, embedding array<float>")
    u = x.astype(np.float64)
    u = multi_index.unit(u)
    links = (np.einsum("id,jd->ij", u, u) >= 0.9) & ~np.eye(len(u), dtype=bool)
    got = multi_index.near_duplicates(vectors).collect()
    n = {r.vec_id: r.n_links for r in got}
    assert len(got) == 241 and [n[i * 64] for i in range(240) if i not in {5, *range(200, 206)}] == [links[i].sum() for i in range(240) if i not in {5, *range(200, 206)}]
    assert {r.vec_id for r in got if r.component_id == 5 * 64} >= {5 * 64, *(i * 64 for i in range(200, 206))}
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    d = np.sqrt(((x.astype(np.float64)[:, None] - x.astype(np.float64)[None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    for k, few in ((10, 240), (10, 6)):
        some = vectors.where(f"vec_id < {few * 64}")
        found: dict = {}
        for r in multi_index.nearest(some, "vec_id % 640 = 0", k=k).collect():
            found.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
        hits = total = 0
        for q, own in found.items():
            want = sorted((float(d[q // 64, j]), j * 64) for j in range(few) if j * 64 != q)[:k]
            assert sorted(own) == list(range(1, len(want) + 1)) and [own[i] for i in sorted(own)] == sorted(own.values(), key=lambda z: (z[1], z[0]))
            hits += len({v for v, _ in own.values()} & {v for _, v in want})
            total += len(want)
        assert set(found) == {i for i in range(0, few * 64, 640)} and hits >= 0.9 * total
    assert multi_index.nearest(vectors.where("false"), "true").count() == 0


def test_multi_sequence():
    d1, d2 = [0.1, 0.5, 0.9], [0.0, 0.3, 2.0]
    order = list(multi_index.multi_sequence(d1, d2, [0, 1, 2], [0, 1, 2]))
    sums = [d1[c // 3] + d2[c % 3] for c in order]
    assert sorted(order) == list(range(9)) and sums == sorted(sums)


def test_url_filter(spark):
    urls = [None, "no scheme", "HTTP://A.Example.COM/en/7?x", "http://example.com/en/8", "http://b.example.net/de/8#t", "http://c.example.net/de/9", "http://x.org/es/1", "http://freecasino.example.org/a", "http://library.example.org/a", "http://notcom/en/", "http://h?x://y/z"]
    pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)], "page_id long, url string, verdict string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(pages).collect()}
    assert got[0] == got[1] == ("", "", None, "allow")
    assert got[2] == ("a.example.com", "/en/7", "example.com/en/7", "allow") and got[3][2:] == ("com/en/", "block")
    assert got[4][2:] == ("example.net/de/8", "block") and got[5][2:] == ("net/de/", "allow") and got[6][2:] == ("org/es/", "block")
    assert got[7][2:] == (None, "block") and got[8][2:] == (None, "allow") and got[9][2] is None and got[10][:2] == ("h", "")
    assert url_filter.Words().segment("cheappills") == ("cheap", "pills") and url_filter.Words().segment("qqqqzz") == ("qqqqzz",)


def test_url_filter_words_of_the_corpus(spark):
    model = url_filter.Words()
    phrases = {"-".join(x.split()) for x in url_filter.BLOCKED + url_filter.ALLOWED}
    assert not phrases & {"casino-win", "free-bets", "ads-track", "spam-farm", "cheap-pills", "adult-x"}
    assert model.segment("uploads") == ("uploads",) and model.segment("alphabets") == ("alphabets",) and model.segment("adulteducation") == ("adult", "education")
    clean, bad = ["uploads", "alphabets", "pillsbury", "adulteducation"], ["gambling", "lottery", "weightloss", "viagraonline"]
    pages = spark.createDataFrame([(i, f"http://{w}.example.org/a") for i, w in enumerate(clean + bad)], "page_id long, url string")
    texts = spark.createDataFrame([("The Pillsbury mill, by Pillsbury.",), (None,), ("",)], "text string")
    seen = url_filter.lexicon_counts(pages.select(*[c.alias(n) for c, n in zip(url_filter.host_and_path(F.col("url")), ("host", "path"))]), texts)
    assert seen["pillsbury"] == 3 and "mill" not in seen and "weightloss" not in seen
    got = {r.page_id: r.verdict for r in url_filter.judge(pages, texts).collect()}
    assert [got[i] for i in range(8)] == ["allow"] * 4 + ["block"] * 4


def test_segmentation_and_bayes_are_brute_force():
    r = random.Random(10)
    blocked, allowed = ("bad worse bad", "ugly worse"), ("good fine", "fine better good good", "bad luck")
    model = url_filter.Words({"badger": 40, "gerbil": 9, "good": 3}, blocked, allowed)

    def cost(words):
        return sum(model._cost(w) for w in words)

    def cuts(run):
        return [(run,)] if len(run) < 2 else [(run,)] + [(run[:i], *rest) for i in range(1, len(run)) for rest in cuts(run[i:])]

    parts = ["bad", "worse", "good", "fine", "badger", "gerbil", "q", "zx", "ugly", "e"]
    for _ in range(60):
        run = "".join(r.choice(parts) for _ in range(r.randint(1, 3)))[:11]
        assert cost(model.segment(run)) == pytest.approx(min(cost(c) for c in cuts(run))) and "".join(model.segment(run)) == run
    # multinomial naive Bayes with add-one smoothing, from the examples alone
    bad, good = (" ".join(x).split() for x in (blocked, allowed))
    vocabulary = {*bad, *good}
    for words in (["bad"], ["good", "bad", "bad"], ["luck", "unseen"], ["worse", "fine", "ugly"]):
        want = math.log(url_filter.PRIOR_BLOCKED / (1 - url_filter.PRIOR_BLOCKED))
        for w in words:
            if w in vocabulary:
                want += math.log((bad.count(w) + 1) / (len(bad) + len(vocabulary))) - math.log((good.count(w) + 1) / (len(good) + len(vocabulary)))
        assert model.score("-".join(words) + ".example.org", "/") == pytest.approx(want + sum(model.odds.get(w, 0) for w in ("example", "org")))


def test_url_filter_on_odd_tables(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "MOST_WORDS", 2)
    pages = spark.createDataFrame([(1, "http://casino.example.org/a"), (1, "http://casino.example.org/a"), (None, "http://library.example.org/"), (3, "http://h/" + "casino" * 3000)], "page_id long, url string")
    got = url_filter.judge(pages).collect()
    assert sorted(r.verdict for r in got) == ["allow", "block", "block", "block"] and got[0] == got[1]
    assert url_filter.judge(pages.where("false")).count() == 0 and len(url_filter.lexicon_counts(pages.selectExpr("'h' host", "url path"), None)) <= 2


def test_preference(spark):
    turns = [(0, 0, "user", "hi"), (0, 1, "assistant", "yes"), (1, 0, "user", "hi"), (1, 1, "assistant", "no"), (2, 0, "user", None), (None, 0, "user", "x")]
    rows = spark.createDataFrame([(*t, "clash") for t in turns], "conv_id long, turn long, role string, text string, pair_id string")
    a, b = preference.format_pairs(preference.neighbours(rows)).orderBy("pair_id").collect()
    assert a.prompt == "<|user|>\nhi\n<|end|>\n" and a.chosen == "<|assistant|>\nyes\n<|end|>\n" and a.rejected.startswith("<|assistant|>\nno")
    start, length = map(int, a.chosen_spans.split(":"))
    assert a.chosen[start : start + length] == "yes"
    assert (b.chosen_id, b.rejected_id, b.prompt, b.prompt_turns) == (2, None, "", 0)


def test_preference_on_odd_tables(spark):
    schema = "conv_id long, turn long, role string, text string"
    equal = [(c, t, "user", "a") for c in (0, 1) for t in (0, 1)]
    odd = [(4, 0, "user", "hi"), (4, 0, "user", "hi"), (4, None, None, None), (5, 0, "user", "hi"), (5, 0, "user", "hi"), (5, 1, "assistant", "z" * 50_000)]
    got = {r.pair_id: r for r in preference.format_pairs(preference.neighbours(spark.createDataFrame(equal + odd, schema))).collect()}
    assert (got[0].chosen, got[0].rejected, got[0].prompt_turns, got[0].chosen_spans) == ("", "", 2, "")
    assert got[2].prompt_turns == 2 and got[2].chosen == "<|unknown|>\n\n<|end|>\n" and len(got[2].rejected) > 50_000
    assert preference.format_pairs(preference.neighbours(spark.createDataFrame([], schema))).count() == 0


def test_mixing_and_counting_on_odd_tables(spark):
    rows = [(1, "a b c", "s")] * 4 + [(None, "a b", "s"), (None, None, None), (2, "w " * 40_000, "s"), (3, "", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    plan = mixing.mix_plan(docs).collect()
    assert len(plan) == len(rows) and len({r.repeats for r in plan if r.doc_id == 1}) == 1
    one = mixing.mix_plan(docs.where("source = 's'")).collect()  # the only source has all to itself
    assert sum(r["size"] * r.repeats for r in one) == sum(r["size"] for r in one) == one[0].target
    cache = fresh_path(spark, "cache")
    got = token_counts.count_tokens(docs, cache, tokenizer="byte_bpe_50k.json").collect()
    assert len(got) == len(rows) and len({tuple(r) for r in got if r.doc_id == 1}) == 1
    assert sorted((r.n_bytes, r.n_tokens) for r in got if r.doc_id is None)[0] == (0, 0) and spark.read.parquet(cache).count() == 4


def test_license_scan(spark):
    rows = [(0, "Foo bar. Licensed under the Apache License, version 2.0! More."), (1, "this work is licensed under the GNU General Public License version 3"), (2, "This work is licensed under GNU General Public License, version 3."), (3, "licensed under the sea"), (4, None), (5, ""), (6, "all rights reserved " * 3), (7, "x " * 30_000 + "Released under the MIT License.")]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, spans string")
    got = {r.doc_id: r for r in license_scan.scan(docs).collect()}
    assert got[0].licenses == "apache-2.0" and (got[0].spans[0].start, got[0].spans[0].end, got[0].coverage) == (2, 10, 1.0)
    assert got[1].licenses == "gpl-3.0" and got[2].licenses == "gpl-3.0" and 0.75 <= got[2].coverage < 1
    assert all(got[i].n_matches == 0 for i in (3, 4, 5)) and got[6].n_matches == 3 and got[7].licenses == "mit"


def aligned(own, part):
    """One window's alignment, cell by cell."""
    band, width = license_scan.BAND, 2 * license_scan.BAND + 1
    if (part[band : band + len(own)] == own).all():
        return len(own), band, band + len(own)
    best = [(0, -1, -1)] * (width + 1)
    for i, word in enumerate(own):
        new = []
        for k in range(width + 1):
            j, option = i + k, best[k + 1] if k < width else best[k]
            if k and new[k - 1][0] >= option[0]:
                option = new[k - 1]
            if j < len(part) and part[j] == word and best[k][0] + 1 > option[0]:
                option = (best[k][0] + 1, j if best[k][1] < 0 else best[k][1], j + 1)
            new.append(option)
        best = new
    return max(best, key=lambda x: x[0])


def test_license_scan_finds_every_alignment(spark):
    T = license_scan.Templates()
    short = {n: t for n, t in zip(T.names, T.words) if 3 < len(t) < 45}
    rows = [("Released under MIT License", "mit")]
    for name in short:
        own = "".join(c if c.isalnum() else " " for c in license_scan.TEMPLATES[name]).split()
        for i in range(len(own)):
            rows += [(" ".join(own[:i] + x + own[i + 1 :]), name) for x in ([], ["qq"], [own[i], "qq"])]
    docs = spark.createDataFrame([(i, f"zz {t} zz") for i, (t, _) in enumerate(rows)], "doc_id long, text string")
    got = {r.doc_id: r for r in license_scan.scan(docs).collect()}
    # some edits make an equal or better match of another notice, which takes the place
    assert [t for i, (t, n) in enumerate(rows) if not got[i].n_matches or n.split("-")[0] not in got[i].licenses and got[i].coverage < 1] == []
    r = random.Random(2)
    brief = [t for t, w in enumerate(T.words) if len(w) < 45]
    for _ in range(60):
        t = r.choice(brief)
        text = [w for x in T.words[t] for w in r.choice([[x], [x], [x], [], [x, np.uint64(1)], [np.uint64(1)]])]
        text = np.array([np.uint64(1)] * r.randint(0, 3) + text, np.uint64)
        every, pad = set(), np.zeros(60, np.int32)
        for u, (code, own) in enumerate(zip(T.codes, T.own)):
            at = np.minimum(np.searchsorted(T.vocabulary, text), len(T.vocabulary) - 1)
            ids = np.concatenate([pad, code[np.where(T.vocabulary[at] == text, at + 1, 0)], pad])
            for low in range(len(ids) - len(own) - 2 * license_scan.BAND + 1):
                n, a, b = aligned(own, ids[low : low + len(own) + 2 * license_scan.BAND])
                if n >= 0.75 * len(own):
                    every.add((0, u, n, low + a - 60, low + b - 60))
        assert set(T.found(text, np.array([0, len(text)]))) == every


def test_winnowing_keeps_a_place_of_every_common_run():
    r = np.random.default_rng(6)
    for window in (1, 2, 3, 5):
        x = r.integers(0, 9, 400).astype(np.uint64)
        for _ in range(100):
            n, a = int(r.integers(window, 12)), int(r.integers(0, 380))
            y = np.concatenate([r.integers(0, 9, int(r.integers(0, 6))).astype(np.uint64) + np.uint64(20), x[a : a + n], r.integers(0, 9, 5).astype(np.uint64) + np.uint64(20)])
            shift = a - (len(y) - 5 - n)
            kept = set(license_scan.winnow(x, window).tolist())
            assert any(p + shift in kept and a <= p + shift < a + n for p in license_scan.winnow(y, window).tolist())
    assert license_scan.shortest_run(5, 0.75) == 1 and license_scan.shortest_run(40, 1.0) > license_scan.shortest_run(40, 0.75)


def test_license_scan_of_whole_licenses(spark):
    r = random.Random(11)
    rows = []
    for name in ("mit-license", "bsd-3-clause", "isc", "zlib", "apache-2.0-header"):
        words = license_scan.TEMPLATES[name].split()
        for share in (0.02, 0.1):
            text = [w for x in words for w in ([x] if r.random() > share else r.choice([[], [x, "oder"], ["xyz"]]))]
            rows.append((len(rows), "preface " * 7 + " ".join(text) + " code" * 9, name))
    docs = spark.createDataFrame([x[:2] for x in rows], "doc_id long, text string")
    got = {x.doc_id: x for x in license_scan.scan(docs).collect()}
    for i, _, name in rows:
        best = max(got[i].spans, key=lambda s: s.end - s.start)
        assert best.name == name and best.coverage >= 0.75 and best.start >= 6
    assert license_scan.scan(docs.where("false")).count() == 0 and license_scan.scan(docs, templates={}).agg(F.sum("n_matches")).first()[0] == 0


def test_pipeline(spark, docs, tmp_path):
    import corpus_pipeline

    rows = docs.select("doc_id", "text", "lang", "source", "n_chars")
    rows.write.parquet(f"{tmp_path}/documents.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert out and {r.doc_id for r in out} <= {r.doc_id for r in rows.collect()}
    kept = corpus_pipeline.deduplicate(spark, rows, str(tmp_path))
    assert kept.columns == rows.columns and {r.doc_id for r in kept.collect()} == {c for _, c in brute_components([(r.doc_id, r.text) for r in rows.collect()]).values()}


def test_pipeline_stages_on_odd_tables(spark, tmp_path):
    """Clashing names, shared and null ids, repeated rows, and no rows at all."""
    import corpus_pipeline

    names = ["score", "entropy", "rejected", "lang_pred", "place", "size", "repeats", "row", "copy", "component_id", "n_shingles", "id", "x", "__nth"]
    said = {"en": "the cat and the dog sat on a mat with some of their other friends".split(), "de": "der hund und die katze sind nicht mit uns auf dem dach".split()}
    r = random.Random(7)
    rows = [(i, " ".join(r.choice(said[k]) for _ in range(12)), k, ["s", None, "t"][i % 3], 7) for i, k in enumerate(["en", "de"] * 30)]
    rows += [rows[5], rows[5], (6, "eine ganz andere katze und der hund", "de", "s", 1), (None, rows[3][1], "de", None, 2), (None, None, None, None, None), (900, "", "en", "s", 0), (901, "der hund " * 9000, "de", "t", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.select("*", *[F.lit(f"own {n}").alias(n) for n in names])
    for table in (docs, docs.where("false")):
        left = table
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, left, "")
            if name == "packing":
                break
            assert out.columns == docs.columns
            got, had = [tuple(x) for x in out.collect()], [tuple(x) for x in left.collect()]
            assert set(got) <= set(had) and all(x[5:] == tuple(f"own {n}" for n in names) for x in got)
            if name == "near_duplicates":
                want = brute_components([x[:2] for x in sorted({(x[0], x[1]) for x in had if x[0] is not None}, reverse=True)])  # of an id the first text
                ids = [x[0] for x in got if x[0] is not None]
                assert len(ids) == len(set(ids)) and set(ids) == {c for _, c in want.values()} and sum(x[0] is None for x in got) == sum(x[0] is None for x in had)
                assert all(x[1] == min(y[1] for y in had if y[0] == x[0]) for x in got if x[0] is not None)
            left = spark.createDataFrame(got, docs.schema)
        assert sum(x.length for x in out.collect()) == sum(p.n for p in packing.pieces(left, tokenizer="word_bpe_49k.json", window=4096, end_id=2).selectExpr("sum(length) n").collect() if p.n)
    docs.where("false").write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def brute_kneser_ney(rows, order):
    """By order, {gram: probability} and {context: weight}: interpolated Kneser-Ney over texts of symbols, None before their start."""
    grams = [tuple(row[i - k] if i >= k else None for k in range(order - 1, -1, -1)) for row in rows for i in range(1, len(row))]
    counts = [dict() for _ in range(order + 1)]
    for g in grams:
        counts[order][g] = counts[order].get(g, 0) + 1
    for n in range(order - 1, 0, -1):
        for g in counts[n + 1]:
            counts[n][g[1:]] = counts[n].get(g[1:], 0) + 1
    return counts


def test_kneser_ney_probabilities():
    r = random.Random(12)
    texts = {"aa": ["".join(r.choice("ab c") for _ in range(40)) for _ in range(9)], "bb": ["".join(r.choice("bcd ") for _ in range(30)) for _ in range(9)]}
    models = language_id.train(texts)
    size = len(models.alphabet) + 2
    for k, x in enumerate(models.languages):
        rows = []
        for t in [t for i, t in enumerate(texts[x]) if i % 5]:
            codes, _, _ = language_id.symbols([t], models.alphabet)
            rows.append(codes.tolist())
        counts = brute_kneser_ney(rows, language_id.ORDER)
        discount = [language_id._discounts(np.array(list(c.values()))) if c else 0 for c in counts]

        def p(gram):
            if not gram:
                return 1 / size
            n, shorter = len(gram), p(gram[1:])
            own = {g: c for g, c in counts[n].items() if g[:-1] == gram[:-1]}
            total = sum(own.values())
            if not total:
                return shorter
            return max(own.get(gram, 0) - discount[n], 0) / total + discount[n] * len(own) / total * shorter

        text = "abc dab"
        codes, offsets, _ = language_id.symbols([text], models.alphabet)
        logs = models.log_probability(codes, offsets)[:, k]
        for i in range(1, len(codes)):
            gram = tuple(int(codes[i - j]) if i >= j else None for j in range(language_id.ORDER - 1, -1, -1))
            assert logs[i] == pytest.approx(math.log(p(gram)), abs=1e-4)
            assert sum(p((*gram[:-1], c)) for c in range(size)) == pytest.approx(1)


def test_language_sample_is_bounded(spark, monkeypatch):
    rows = [(i, "abc " * 50, ["x", "y", "z"][i % 3]) for i in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    monkeypatch.setattr(language_id, "SAMPLE_TOTAL", 3000)
    got = language_id.sample(docs)
    assert {k: len(v) for k, v in got.items()} == {"x": 5, "y": 5, "z": 5}
    models = language_id.train(got)
    same = language_id.predict(docs.limit(6), models).collect()
    assert {x.lang_pred for x in same} == {"x"} and language_id.predict(docs.where("false"), models).count() == 0


def test_sketches_keep_every_link():
    import numpy as np

    from snapforge.llm import jaccard_join as J

    rng = np.random.default_rng(5)
    for n in (1, 3, 40, 64, 65, 700):
        x = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2))
        assert (J._unpack(J._pack(x)) == x >> np.uint64(16) << np.uint64(16)).all()
        for share in (0.6, 0.8, 0.9, 1.0):
            y = np.unique(np.concatenate([x[: int(len(x) * share)], rng.integers(0, 1 << 63, n // 10, dtype=np.uint64)]))
            a, b = J.sketch(x), J.sketch(y)
            cells = min(len(a), len(b))
            differ = int((J._fold(a, cells) != J._fold(b, cells)).sum())
            assert differ <= len(np.setxor1d(x, y))
            if J._links(x, y):
                assert 7 * differ <= len(x) + len(y)
    assert not J._links(np.zeros(0, np.uint64), np.zeros(0, np.uint64))
