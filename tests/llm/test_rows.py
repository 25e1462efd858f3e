"""Each operator on odd rows: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import hashlib
import itertools
import math
import random
import re
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparkloom.llm import cap_filters, common, decontaminate, html_text, kneser_ney, mixing, parity_join, sharding, suffix_dedup, toxicity, url_cascade

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, size string, node string, component string"


def make_docs(spark, texts, schema=DOCS):
    """Rows (id, text[, lang[, source]]) with columns whose names the operators use inside."""
    rows = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", len(r[1] or ""), "x", "y", "z") for r in texts]
    return spark.createDataFrame(rows, schema)


BASE = " ".join(f"word{k}" for k in range(120))
ODD = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "one"), (5, "one"), (None, "null id here and more"), (6, BASE), (7, BASE.upper()), (8, BASE + " tail"), (9, "w " * 30000), (10, "a b c"), (11, None, None, None), (12, "é ß 漢 𝄞 x y z")]


# ---- mixing --------------------------------------------------------------------


def plain_targets(sizes, weights=(1, 2, 3), most=3):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    target, left, free = {}, sum(sizes.values()), set(order)
    while free:
        level = left / sum(w[s] for s in free)
        over = [s for s in free if level * w[s] >= most * sizes[s]]
        if not over:
            target |= {s: level * w[s] for s in free}
            break
        for s in over:
            target[s] = float(most * sizes[s])
            left -= most * sizes[s]
            free.discard(s)
    return target


def test_mixing_targets_and_copies(spark):
    rng = np.random.default_rng(1)
    rows = [(i, "w " * int(rng.integers(0, 60)), "en", [None, "b", "a", "Z", "ä"][int(rng.choice(5, p=[0.1, 0.5, 0.1, 0.2, 0.1]))]) for i in range(3000)]
    got = mixing.mix_sources(make_docs(spark, rows)).toPandas()
    size = {i: len(WORD.findall(t)) for i, t, *_ in rows}
    sizes = Counter()
    for i, _, _, s in rows:
        sizes[s] += size[i]
    want = plain_targets(sizes)
    by = {s: got[got.source.isna() if s is None else got.source == s] for s in sizes}
    for s, part in by.items():
        assert abs(part.target.iloc[0] - want[s]) < 1e-6
        assert abs(part.taken.sum() - want[s]) <= 60
    assert all(t <= 3 * size[i] for i, t in zip(got.doc_id, got.taken))
    again = mixing.mix_sources(make_docs(spark, rows).repartition(7)).toPandas()
    assert sorted(zip(got.doc_id, got.taken)) == sorted(zip(again.doc_id, again.taken))


def test_mixing_odd_rows(spark):
    got = mixing.mix_sources(make_docs(spark, ODD)).toPandas()
    assert len(got) == len(ODD) and got[got["size"] == 0].taken.sum() == 0
    assert mixing.mix_sources(make_docs(spark, ODD).limit(0)).count() == 0
    docs = make_docs(spark, ODD)
    copies = mixing.take_copies(docs)
    assert copies.columns == docs.columns
    assert copies.count() == got.copies[got["size"] > 0].sum() + got.copies[got["size"] == 0].sum()


# ---- toxicity ------------------------------------------------------------------


def test_toxicity_chain(spark):
    rng = np.random.default_rng(2)
    rows, labels = [], []
    for i in range(400):
        bad, low = rng.random() < 0.3, rng.random() < 0.3
        words = [f"w{chr(97 + int(k))}" for k in rng.integers(0, 26, 30)]
        words += ["grimbolt"] * bad + ["THE$$$"] * (20 * low)
        rng.shuffle(words)
        rows.append((i, " ".join(words)))
        labels.append((i, int(not low), int(bad)))
    lab = spark.createDataFrame(labels[:300] + [(None, 1, 1), (3, None, 1), (labels[0][0], labels[0][1], labels[0][2])], "doc_id long, quality int, toxic int")
    got = toxicity.score_toxicity(make_docs(spark, rows + [(900, None), (901, "")]), lab).toPandas().set_index("doc_id")
    held = [(got.toxic[i], bool(t)) for i, _, t in labels[300:]]
    assert np.mean([a == b for a, b in held]) > 0.95
    assert not got.toxic[900] and got.p_toxic[900] == got.p_toxic[901]
    assert toxicity.score_toxicity(make_docs(spark, rows).limit(0), lab).count() == 0
    assert not toxicity.score_toxicity(make_docs(spark, rows[:3]), lab.limit(0)).toPandas().toxic.any()


# ---- url filter ----------------------------------------------------------------


def test_cascade_is_exact(spark):
    keys = [f"k{i}" for i in range(4000)]
    listed = set(keys[::7])
    universe = spark.createDataFrame([(k, k in listed) for k in keys], "key string, l boolean")
    levels = url_cascade.build_cascade(universe.withColumnRenamed("l", "listed"), F.col("listed"))
    assert len(levels) > 2
    got = universe.select("key", url_cascade.member(F.col("key"), levels).alias("m")).toPandas()
    assert {k for k, m in zip(got.key, got.m) if m} == listed


def test_url_rules(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://A.Org", "x://Sub.Example.ORG/es/1?q#f", "http://example.org/en/12", "http://q.com/fr/x", "http://notcom/fr/", "https://www.cheap-pills.example.net/en/4#top", "http://badcheap-pills.example.net/", "http://fr.com/de/", "a://b.org/x://c.com/fr/", "http://example.org?x"]
    pages = spark.createDataFrame([(i, u, "h", "p") for i, u in enumerate(urls)], "page_id long, url string, host string, verdict string")
    got = url_cascade.judge_urls(pages).orderBy("page_id").toPandas()
    assert list(got.host) == ["", "", "", "", "a.org", "sub.example.org", "example.org", "q.com", "notcom", "www.cheap-pills.example.net", "badcheap-pills.example.net", "fr.com", "b.org", "example.org"]
    assert list(got.rule.where(got.rule.notna(), None)) == [None] * 5 + ["example.org/es/", "example.org/en/1", "com/fr/", None, None, None, "com/de/", "org/", None]
    assert list(got.verdict) == ["allow"] * 5 + ["block", "block", "allow", "allow", "block", "allow", "block", "allow", "allow"]
    assert url_cascade.judge_urls(pages.limit(0)).count() == 0


# ---- substring deduplication ---------------------------------------------------


def plain_repeats(rows, length):
    seen, out = set(), []
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - length + 1):
            w = b[p : p + length]
            if w in seen:
                gone[p : p + length] = True
            seen.add(w)
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        out.append((i, len(b), int(gone.sum()), int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum()), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("length, block, bucket", [(100, 1 << 22, 1 << 22), (100, 700, 64), (64, 3000, 200)])
def test_repeated_bytes(spark, monkeypatch, length, block, bucket):
    monkeypatch.setattr(suffix_dedup, "BLOCK", block)
    monkeypatch.setattr(suffix_dedup, "BUCKET", bucket)
    rng = np.random.default_rng(3)
    piece = lambda n: "".join(rng.choice(list("abcdé "), n))
    shared = [piece(n) for n in (63, 99, 100, 101, 180, 400)]
    rows = []
    for i in range(60):
        parts = [piece(int(rng.integers(0, 150)))]
        for _ in range(int(rng.integers(0, 3))):
            parts += [shared[int(rng.integers(len(shared)))], piece(int(rng.integers(0, 60)))]
        rows.append((i, "".join(parts)))
    rows += [(70, None), (71, ""), (72, "z" * 500), (73, rows[5][1]), (74, "z" * 130)]
    got = suffix_dedup.repeated_bytes(make_docs(spark, rows).repartition(5), length).toPandas()
    assert sorted(map(tuple, got.itertuples(index=False))) == sorted(plain_repeats(rows, length))


def test_repeated_bytes_odd_rows(spark):
    got = suffix_dedup.repeated_bytes(make_docs(spark, ODD)).toPandas()
    assert len(got) == len(ODD) and got.n_removed[got.doc_id == 9].iloc[0] == 59998
    assert suffix_dedup.repeated_bytes(make_docs(spark, ODD).limit(0)).count() == 0


# ---- sharding ------------------------------------------------------------------


def test_table_shares_and_moves():
    shards = [f"s{k}" for k in range(12)]
    table = sharding.fill_table(shards, 1201)
    counts = Counter(table)
    assert set(table) == set(range(12)) and max(counts.values()) - min(counts.values()) <= 1
    fewer = sharding.fill_table(shards[:-1], 1201)
    moved = sum(a != b for a, b in zip(table, fewer) if a != 11)
    assert moved < 0.25 * 1201
    with pytest.raises(ValueError):
        sharding.fill_table(shards, 1200)


def test_placement(spark):
    got = sharding.place(make_docs(spark, ODD), ["a", "b", "c"], 101).toPandas()
    table = sharding.fill_table(["a", "b", "c"], 101)
    assert len(got) == len(ODD)
    for i, slot, shard in zip(got.doc_id, got.slot, got.shard):
        key = "" if math.isnan(i) else str(int(i))
        assert slot == int(hashlib.md5(key.encode()).hexdigest()[:13], 16) % 101 and shard == table[slot]
    assert sharding.place(make_docs(spark, ODD).limit(0), ["a"], 3).count() == 0


# ---- page text -----------------------------------------------------------------


def test_main_text():
    page = "<html><head><title>t</title><style>p{}</style></head><body><header><h1>Site</h1></header><nav><ul><li><a href=/>menu</a></ul></nav><div class='ad'>buy</div><article><h1>Head</h1><p>First <b>bold</b> text &amp; more &eacute;.<br>Next\n line<p>Short.</p><aside>side</aside><form>f</form><script>var a='</p>';</script><div id=comments><p>reader</p></div></article><footer>foot</footer>"
    assert html_text.main_text(page) == "Head\n\nFirst bold text & more é. Next line\n\nShort."
    plain = "<div class=sidebar><p>side</p></div><div><h1>Head</h1><p>" + "long text " * 20 + "</p><p>Ok.</p><p>" + "more text " * 20 + "</p></div><div class='cookie-notice'>x</div>"
    assert html_text.main_text(plain).split("\n\n") == ["Head", ("long text " * 20).strip(), "Ok.", ("more text " * 20).strip()]
    assert [html_text.main_text(x) for x in (None, "", "<p>", "<nav>a</nav>", "plain")] == ["", "", "", "", "plain"]


def test_main_text_keeps_every_content_block():
    blocks = ["Title", *[f"{k} " + "word " * 60 for k in range(6)], "long " * 1200, *[f"{k} " + "word " * 60 for k in range(6, 12)]]
    body = "".join(f"<p>{t}</p>" for t in blocks)
    assert html_text.main_text(f"<div>{body}</div>").split("\n\n") == [t.strip() for t in blocks]
    two = "<article><p>First " + "one " * 50 + "</p></article><article><p>Second " + "two " * 20 + "</p></article>"
    assert html_text.main_text(two).split("\n\n") == [("First " + "one " * 50).strip(), ("Second " + "two " * 20).strip()]
    teaser = "<article><p>Teaser text here.</p></article><div><p>" + "real text " * 50 + "</p></div>"
    assert html_text.main_text(teaser).split("\n\n") == ["Teaser text here.", ("real text " * 50).strip()]


def test_extract_pages(spark):
    rows = [(1, "u", None, "t"), (2, None, "", "t"), (3, "u", "<p>x y</p>", "t"), (3, "u", "<p>x y</p>", "t"), (4, "u", "<article>" + "<p>word</p>" * 20000, "t")]
    got = html_text.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).orderBy("page_id").toPandas()
    assert list(got.n_chars) == [0, 0, 3, 3, 20000 * 4 + 19999 * 2]
    assert html_text.extract_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


# ---- near vectors --------------------------------------------------------------


def union(ids, links):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("chunk", [512, 7])
def test_near_vectors(spark, chunk):
    rng = np.random.default_rng(4)
    base = rng.standard_normal((12, 16))
    rows = []
    for i in range(160):
        v = base[i % 12] + rng.standard_normal(16) * rng.choice([0.0, 0.1, 0.3])
        rows.append((i, [float(x) for x in v], int(i % 2)))
    rows += [(500, None, 1), (501, [0.0] * 16, 1), (502, [1.0, None] + [0.0] * 14, 0), (503, [float("nan")] * 16, 0), (504, rows[0][1], None), (505, [], 0), (506, [float("inf")] + [1.0] * 15, 0), (507, rows[3][1], 1), (507, rows[3][1], 1), (508, [2 * x for x in rows[4][1]], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("unit", F.lit(1)).withColumn("rep", F.lit(2))
    got = cap_filters.near_vectors(df, chunk=chunk).toPandas()
    able = [k for k, (_, v, lab) in enumerate(rows) if v and lab is not None and None not in v and np.isfinite(v).all() and any(v)]
    deg, links = Counter(), []
    for a, b in itertools.combinations(able, 2):
        x, y = np.array(rows[a][1]), np.array(rows[b][1])
        if rows[a][2] == rows[b][2] and x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.93:
            deg[a] += 1
            deg[b] += 1
            links.append((rows[a][0], rows[b][0]))
    comp = union({r[0] for r in rows}, links)
    want = sorted((r[0], deg[k], comp[r[0]], comp[r[0]] == r[0]) for k, r in enumerate(rows))
    found = sorted(map(tuple, got[["vec_id", "n_links", "component_id", "kept"]].itertuples(index=False)))
    assert found == want
    assert cap_filters.near_vectors(df.limit(0)).count() == 0


def test_near_vectors_of_null_and_repeated_ids(spark):
    x, y = [1.0] + [0.0] * 15, [0.0, 1.0] + [0.0] * 14
    near = lambda v, e: [c + e * (k == 5) for k, c in enumerate(v)]
    rows = [(1, x, 0), (2, near(x, 0.1), 0), (1, y, 0), (3, near(y, 0.1), 0), (1, x, 1), (None, near(x, 0.2), 0), (None, [0.0] * 3 + [1.0] * 13, 0), (None, None, 0)]
    got = cap_filters.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    want = [(1, 2, 1, True), (2, 2, 1, False), (None, 2, 1, False), (1, 1, 1, True), (3, 1, 1, False), (1, 0, 1, True), (None, 0, None, True), (None, 0, None, True)]
    assert Counter(tuple(r) for r in got) == Counter(want)


# ---- decontamination -----------------------------------------------------------


@pytest.mark.parametrize("index_chars", [1 << 23, 200])
def test_leaks(spark, index_chars):
    rng = np.random.default_rng(5)
    say = lambda n: " ".join(f"t{int(k)}" for k in rng.zipf(1.3, n) % 900)
    items = [(i, f"{say(20)}. {say(8)}.") for i in range(20)] + [(20, None), (21, ""), (22, "..."), (None, "x"), (23, "single")]
    rows = [(i, say(400)) for i in range(40)]
    for i in range(0, 20, 2):
        rows.append((100 + i, f"{say(int(rng.integers(0, 300)))} {items[i][1].upper().replace('.', ' ;')} {say(90)}"))
    rows += [(200, None), (201, ""), (202, items[1][1].split(".")[0] + " no answer"), (203, items[3][1]), (203, items[3][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.find_leaks(make_docs(spark, rows), bench, index_chars=index_chars).toPandas()
    pairs = Counter(zip(got.doc_id, got.item_id))
    want = Counter({(100 + i, i): 1 for i in range(0, 20, 2)}) + Counter({(203, 3): 2})
    assert {p: n for p, n in pairs.items() if p[1] != 23} == dict(want)
    assert decontaminate.find_leaks(make_docs(spark, rows), bench.limit(0)).count() == 0
    assert decontaminate.find_leaks(make_docs(spark, rows).limit(0), bench).count() == 0


@pytest.mark.parametrize("kind", ["equal", "template", "mixed"])
def test_leaks_of_items_with_common_terms(spark, kind):
    say = lambda k, n: " ".join(f"w{(k * 7 + j * j) % 97}" for j in range(n))
    if kind == "equal":
        items = [(k, "What is the tallest hill of the old northern land here? It is the grey one.") for k in range(5)]
    elif kind == "template":
        items = [(k, f"Which of these towns lies on the long river to the sea? The town is {['north', 'south', 'west'][k % 3]} gate.") for k in range(12)]
    else:
        items = [(k, f"{say(k, 12)}. {say(k + 3, 5)}.") for k in range(9)] + [(20 + k, "What is the tallest hill of the old northern land here? It is the grey one.") for k in range(3)]
    rows = [(k, f"{say(k, 80)} {items[k % len(items)][1]} {say(k + 1, 90)}") for k in range(24)] + [(50, say(3, 300))]
    index = decontaminate.Index(items, (df := Counter(t for _, text in items for t in set(decontaminate.words_of(text)))), len(items), sum(len(decontaminate.words_of(t)) for _, t in items) / len(items), 0.5, 64)
    want = Counter()
    for d, text in rows:
        words = decontaminate.words_of(text)
        tiles = [words[k : k + 128] for k in range(0, len(words), 64)]
        want.update({(d, i) for tile in tiles for i, _, q, a in index.judge(tile, range(len(items))) if q >= 0.8 and a >= 0.8})
    assert len(df) and len(want) >= 24
    got = decontaminate.find_leaks(make_docs(spark, rows), spark.createDataFrame(items, "item_id long, text string"))
    assert Counter((r.doc_id, r.item_id) for r in got.collect()) == want


# ---- Jaccard join --------------------------------------------------------------


def plain_sets(rows, k):
    sets = []
    for _, t in rows:
        w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets.append({tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    return sets


@pytest.mark.parametrize("k, percent, chunk", [(4, 85, 1024), (5, 80, 5)])
def test_jaccard_components(spark, monkeypatch, k, percent, chunk):
    monkeypatch.setattr(parity_join, "CHUNK", chunk)
    rng = np.random.default_rng(6)
    say = lambda n: [f"v{int(x)}" for x in rng.integers(0, 400, n)]
    rows = []
    for i in range(250):
        if i < 30 or rng.random() < 0.2:
            words = say(int(rng.choice([2, 3, 4, 5, 9, 20, 60, 150, 400])))
        else:
            words = list(rows[int(rng.integers(0, 30))][1].split())
            for _ in range(int(rng.integers(0, 4))):
                words[int(rng.integers(len(words)))] = "edit"
        rows.append((i, " ".join(words)))
    rows += [(300, None), (301, ""), (302, " \n"), (303, rows[7][1].upper()), (303, rows[7][1].upper()), (304, "w " * 30000)]
    sets = plain_sets(rows, k)
    links = [(rows[a][0], rows[b][0]) for a, b in itertools.combinations(range(len(rows)), 2) if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    comp = union({r[0] for r in rows}, links)
    got = parity_join.jaccard_components(make_docs(spark, rows), k, percent).toPandas()
    want = sorted((r[0], len(s), comp[r[0]]) for r, s in zip(rows, sets))
    assert sorted(map(tuple, got.itertuples(index=False))) == want
    assert parity_join.jaccard_components(make_docs(spark, rows).limit(0)).count() == 0


def test_sketches_bound_the_difference():
    rng = np.random.default_rng(7)
    for _ in range(50):
        a = np.unique(rng.integers(0, 1 << 63, 200, dtype=np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) < 0.8], rng.integers(0, 1 << 63, 30, dtype=np.uint64)]))
        apart = len(np.setxor1d(a, b))
        x, y = parity_join.bit_sketch(a), parity_join.bit_sketch(b)
        n = min(len(x), len(y))
        assert np.bitwise_count(parity_join.fold(x, n) ^ parity_join.fold(y, n)).sum() <= apart


# ---- quality -------------------------------------------------------------------


def plain_model(texts):
    """Interpolated modified Kneser-Ney trigrams by dictionaries."""
    three = Counter()
    for t in texts:
        s = ["<", "<", *t, ">"]
        three.update(zip(s, s[1:], s[2:]))
    two, one = Counter(), Counter()
    for a, b, c in three:
        two[b, c] += 1
    for b, c in two:
        one[c] += 1
    ds = [kneser_ney.discounts([sum(1 for v in x.values() if v == k) for k in (1, 2, 3, 4)]) for x in (one, two, three)]

    def part(counts, own, d, lower):
        total = sum(counts)
        spread = sum(d[min(v, 3) - 1] for v in counts)
        return ((own - d[min(own, 3) - 1] if own else 0) + spread * lower) / total

    by2, by3 = {}, {}
    for (b, _), v in two.items():
        by2.setdefault(b, []).append(v)
    for (a, b, _), v in three.items():
        by3.setdefault((a, b), []).append(v)

    def prob(a, b, c):
        p = part(one.values(), one[c], ds[0], 1 / (len(one) + 1))
        if b in by2:
            p = part(by2[b], two[b, c], ds[1], p)
        if (a, b) in by3:
            p = part(by3[a, b], three[a, b, c], ds[2], p)
        return p

    return prob


def test_perplexity_matches_plain_model(spark):
    rng = np.random.default_rng(8)
    rows = [(i, "".join(rng.choice(list("abcé 𝄞"), int(rng.integers(0, 40))))) for i in range(60)] + [(90, None), (91, "QQQ zzz")]
    good = spark.createDataFrame([(i,) for i in range(0, 40, 2)], "doc_id long")
    got = kneser_ney.perplexities(make_docs(spark, rows), good).toPandas().set_index("doc_id")
    prob = plain_model([t for i, t in rows if i < 40 and i % 2 == 0])
    for i, t in rows:
        s = ["<", "<", *(t or ""), ">"]
        want = sum(math.log(prob(*g)) for g in zip(s, s[1:], s[2:]))
        assert abs(got.logp[i] - want) < 1e-6 and got.n_tokens[i] == len(t or "") + 1


def test_quality_keeps_clean_and_rejects_junk(spark):
    rng = np.random.default_rng(9)
    clean = [(i, " ".join(rng.choice(["the", "cat", "sat", "on", "mats", "and", "ran"], 40)), ["en", None][i % 2]) for i in range(120)]
    junk = [(200 + i, "$%^&* ZXQ" * 20) for i in range(10)]
    labels = spark.createDataFrame([(i, 1) for i in range(100)] + [(200, 0), (None, 1), (5, None)], "doc_id long, quality int")
    got = kneser_ney.judge_quality(make_docs(spark, clean + junk + [(300, None), (301, "")]), labels).toPandas().set_index("doc_id")
    assert got.keep[[i for i, *_ in clean]].all() and not got.keep[[i for i, _ in junk]].any() and got.keep[300]
    assert kneser_ney.judge_quality(make_docs(spark, clean).limit(0), labels).count() == 0
    assert kneser_ney.judge_quality(make_docs(spark, clean[:5]), labels.limit(0)).toPandas().keep.all()


def test_quality_threshold_is_the_quantile_itself(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{n}.parquet") for n in ("documents", "labels"))
    got = kneser_ney.judge_quality(docs, labels).join(labels, "doc_id").toPandas()
    low, best = got[got.quality == 0], got[got.quality == 1]
    assert (~low.keep).mean() >= 0.9 and best.keep.mean() >= 0.98
    for _, part in best.groupby("lang"):
        logs = np.log(part.perplexity)
        assert part.threshold.iloc[0] <= max(part.perplexity.max(), np.exp(logs.mean() + 2.5759 * logs.std())) * 1.0001


def test_quality_scores_no_text_by_itself(spark):
    rng = np.random.default_rng(10)
    rows = [(i, "".join(rng.choice(list("abcdefgh "), 60))) for i in range(40)]
    trusted = spark.createDataFrame([(i,) for i in range(40)], "doc_id long")
    got = kneser_ney.perplexities(make_docs(spark, rows), trusted, folds=2).toPandas().set_index("doc_id")
    fold = {r.doc_id: r.f for r in trusted.select("doc_id", kneser_ney.fold_of(F.col("doc_id"), 2).alias("f")).collect()}
    for f in (0, 1):
        prob = plain_model([t for i, t in rows if fold[i] != f])
        for i, t in rows:
            if fold[i] == f:
                s = ["<", "<", *t, ">"]
                assert abs(got.logp[i] - sum(math.log(prob(*g)) for g in zip(s, s[1:], s[2:]))) < 1e-6


def test_components_in_one_task_and_in_many(spark, monkeypatch):
    chain = [(i, i + 1) for i in range(60)]
    hub = [(500, i) for i in range(501, 560)]
    odd = [(None, 3), (70, 70), (5, None), (80, 79), (79, 80)]
    want = {i: 0 for i in range(61)} | {i: 500 for i in range(500, 560)} | {79: 79, 80: 79}
    links = spark.createDataFrame(chain + hub + odd, "a long, b long").repartition(5)
    for most in (100_000, 50):
        monkeypatch.setattr(common, "TASK_LINKS", most)
        rows = common.components(links).collect()
        assert len(rows) == len(want) and {r["id"]: r["component"] for r in rows} == want
    assert common.components(links.limit(0)).count() == 0


def test_few_links_are_joined_in_one_pass(spark, monkeypatch):
    rng = random.Random(5)
    pairs = [(rng.randrange(-300, 300), rng.randrange(-300, 300)) for _ in range(250)] + [(k, k + 1) for k in range(1000, 1400)] + [(7, 7), (None, 3), (4, None)]
    links = spark.createDataFrame(pairs, "a long, b long").repartition(5)
    want = {r.id: r.component for r in common.components(links).collect()}
    settle, settled = common.settle, []
    monkeypatch.setattr(common, "settle", lambda *a, **k: settled.append(a) or settle(*a, **k))
    rows = common.components(links, most=len(pairs)).collect()
    assert {r.id: r.component for r in rows} == want and len(rows) == len(want) and not settled
    assert common.components(links.limit(0), most=0).count() == 0
    monkeypatch.setattr(common, "TASK_LINKS", 100)
    assert {r.id: r.component for r in common.components(links, most=len(pairs)).collect()} == want and settled


def test_shingle_workers_hold_little(spark):
    rng = random.Random(6)
    texts = [" ".join(str(rng.randrange(50_000)) for _ in range(600)) for _ in range(1024)]
    batch = pa.RecordBatch.from_pydict({"doc_id": range(1024), "mark": range(1024), "text": texts})
    for work, given in ((parity_join._own_sets(5, 0), batch), (parity_join._keys(5, 80, 0), batch.select(["text"]))):
        tracemalloc.start()
        for _ in work([given]):
            pass
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 48 << 20
