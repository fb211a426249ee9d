import gzip
import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallybook.llm import decontamination, quality, toxicity, url_filter, warc
from tallybook.llm.shared import files, new_folder


def rows_of(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=str)


# 1: benchmark decontamination


def best_windows(text, items, size=5, similarity=0.8):
    words, out = decontamination.words_of(text or ""), {}
    for k, (item, passage) in enumerate(items):
        own = decontamination.words_of(passage or "")
        n, z = len(own), min(size, len(own))
        if not n:
            continue
        want, runs = Counter(tuple(own[i : i + z]) for i in range(n - z + 1)), [tuple(words[i : i + z]) for i in range(len(words) - z + 1)]
        for s in range(len(words) - n + 1):
            common = sum((Counter(runs[s : s + n - z + 1]) & want).values())
            value = common / (2 * (n - z + 1) - common)
            if value >= similarity and value > out.get(k, (0,))[0]:
                out[k] = (value, s, n)
    return sorted(((items[k][0], round(v, 9), s, n) for k, (v, s, n) in out.items()), key=str)


def leak_case():
    rng = random.Random(8)
    items = [(k, " ".join(f"v{rng.randrange(300)}" for _ in range(rng.randint(12, 45)))) for k in range(12)]
    items += [(50, "one two"), (51, "... !"), (52, ""), (53, None), (None, items[0][1]), (1, items[1][1]), (54, "ha ha ha ha ha ha ha ha")]
    docs = []
    for k in range(60):
        words = (items[k % 12][1]).split()
        for _ in range(rng.randrange(4)):
            words[rng.randrange(len(words))] = rng.choice(["other", "v1"])
        if k % 5 == 0:
            words.insert(rng.randrange(len(words)), "more")
        docs.append((k, f"V9, {'v8 ' * rng.randrange(3)}" + " ".join(words).upper() + ". one two tail " + "ha " * (k % 12)))
    return docs + [(90, None), (91, ""), (None, items[3][1]), (92, "v1"), (0, docs[0][1])], items


@pytest.mark.parametrize("block_bytes", [1 << 24, 200])
def test_leaks_against_all_windows(spark, block_bytes):
    docs, items = leak_case()
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = [(r[0], r[1], round(r[2], 9), *r[3:]) for r in decontamination.find(df, bench, block_bytes=block_bytes).collect()]
    want = [(d, *m) for d, t in docs for m in best_windows(t, items)]
    assert sorted(got, key=str) == sorted(want, key=str) and len(want) > 60
    hit = {(d, t) for d, t in docs if best_windows(t, items)}
    assert rows_of(decontamination.clean(df, bench, block_bytes=block_bytes), "doc_id", "text") == sorted((x for x in docs if x not in hit), key=str)


def short_windows(text, items, size=5, similarity=0.8):
    """Whole texts against the items that have more words."""
    words, out = decontamination.words_of(text or ""), []
    for item, passage in items:
        own = decontamination.words_of(passage or "")
        z = min(size, len(own))
        if z and z <= len(words) < len(own):
            a, b = (Counter(tuple(w[i : i + z]) for i in range(len(w) - z + 1)) for w in (words, own))
            common = sum((a & b).values())
            value = common / (sum(a.values()) + sum(b.values()) - common)
            if value >= similarity:
                out.append((item, round(value, 9), 0, len(words)))
    return out


def test_leaks_in_texts_shorter_than_an_item(spark):
    rng = random.Random(4)
    items = [(k, " ".join(f"v{rng.randrange(200)}" for _ in range(rng.randint(5, 70)))) for k in range(30)] + [(30, "ha " * 40), (31, " ".join(f"y{k}" for k in range(60)))]
    docs = [(1000, " ".join(f"y{k}" for k in range(57)))]
    for k, text in items:
        w = text.split()
        for cut in range(1, 14):
            docs.append((k * 20 + cut, " ".join(w[:-cut] if cut % 3 else w[cut:])))
        docs.append((k * 20 + 14, " ".join(w[: len(w) // 2] + w[len(w) // 2 + 1 :])))
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = {(d, *m) for d, t in docs for m in [*best_windows(t, items), *short_windows(t, items)]}
    got = {(r[0], r[1], round(r[2], 9), *r[3:]) for r in decontamination.find(df, bench).collect()}
    assert got == want and (1000, 31, round(53 / 56, 9), 0, 57) in got and len({x[:2] for x in want}) > 100
    assert {r.doc_id for r in decontamination.clean(df, bench).collect()} == {d for d, _ in docs} - {x[0] for x in want}


def test_leaks_that_differ_in_a_repeated_shingle():
    for k in range(40):
        common = [f"c{k}x{j}" for j in range(200)]
        item, text = (" ".join([*common, *[f"{x}{k}"] * 24]) for x in "ab")
        got = decontamination.Items([(k, item)], 5, 0.8, 24).build().matches("tail " + text + " tail")
        assert [(m["item_id"], round(m["similarity"], 9), m["start"], m["n_words"]) for m in got] == best_windows("tail " + text + " tail", [(k, item)]) != []


def test_leaks_odd_rows(spark, odd, empty):
    bench = spark.createDataFrame([(1, "three words only"), (2, "w1 w2 w3 w4 w5 w6")], "item_id long, text string")
    assert [r.doc_id for r in decontamination.find(odd, bench).collect()] == [5]
    kept = decontamination.clean(odd, bench)
    assert kept.columns == odd.columns and kept.count() == odd.count() - 1
    assert decontamination.find(empty, bench).count() == 0 and decontamination.clean(empty, bench).count() == 0
    assert decontamination.find(odd, bench.limit(0)).count() == 0 and decontamination.clean(odd, bench.limit(0)).count() == odd.count()


def test_hamming_index_finds_all_in_radius(monkeypatch):
    monkeypatch.setattr(decontamination, "_CELLS", 3000)
    rng = np.random.default_rng(2)
    a = rng.integers(0, 1 << 63, (200, 2)).astype(np.uint64)
    b = a[rng.integers(0, 200, 300)].copy()
    for k in range(300):
        for bit in rng.choice(128, rng.integers(0, 40), replace=False):
            b[k, bit // 64] ^= np.uint64(1) << np.uint64(bit % 64)
    apart = (np.bitwise_count(b[:, None] ^ a[None])).astype(int).sum(axis=2)
    for radius in (0, 3, 8, 12, 38, 127):
        index = decontamination.HammingIndex(a, radius)
        assert index.tiled == (radius > 12) and (index.tiled or len(index.blocks) == radius + 1)
        row, at = index.pairs(b)
        assert sorted(zip(row.tolist(), at.tolist())) == sorted(map(tuple, np.argwhere(apart <= radius).tolist()))
        assert not len(decontamination.HammingIndex(a[:0], radius).pairs(b)[0])


def test_few_pairs_are_candidates_and_true_ones_all_are():
    """4,000 items of one length: hardly any other pair is within the radius, and pairs at similarity 0.8 are."""
    rng = np.random.default_rng(3)
    runs = rng.integers(0, 1 << 63, (4000, 56)).astype(np.uint64)
    zero = np.zeros(1, np.int64)
    index = decontamination.HammingIndex(np.concatenate([decontamination.simhashes(r, zero, 56) for r in runs]), 38)
    other = np.concatenate([decontamination.simhashes(rng.integers(0, 1 << 63, 56).astype(np.uint64), zero, 56) for _ in range(300)])
    assert len(index.pairs(other)[0]) < 0.001 * 300 * 4000
    alike = runs[:2000].copy()
    alike[:, :6] = rng.integers(0, 1 << 63, (2000, 6)).astype(np.uint64)  # 50 of 62 in common: 0.806
    prints = np.concatenate([decontamination.simhashes(r, zero, 56) for r in alike])
    row, at = index.pairs(prints)
    assert set(range(2000)) <= set(row[row == at].tolist())


def test_op1_query(spark, sf_dir, duck):
    items = duck.sql("select item_id, text from benchmark").fetchall()
    docs = duck.sql("select doc_id, text from documents").fetchall()
    shingle = {tuple(w[i : i + 5]) for _, t in items for w in [decontamination.words_of(t)] for i in range(len(w) - 4)}
    want = []
    for d, t in docs:
        w = decontamination.words_of(t)
        if any(tuple(w[i : i + 5]) in shingle for i in range(len(w) - 4)):
            want += [(d, *m) for m in best_windows(t, items)]
    got = [(r[0], r[1], round(r[2], 9), *r[3:]) for r in decontamination.query(spark, sf_dir).collect()]
    assert sorted(got) == sorted(want)


# 4: toxicity


@pytest.fixture(scope="module")
def talk(spark):
    """Clean and toxic talk in two vocabularies of unlike shares; a fifth of the rows has no label."""
    rng = random.Random(6)
    docs, labels = [], []
    for k in range(1500):
        toxic, base = k % 6 == 0, "a" if rng.random() < 0.5 + 0.2 * (k % 6 == 0) else "b"
        words = [f"{base}{int(rng.expovariate(0.02))}" for _ in range(rng.randint(8, 120))]
        for _ in range(max(1, len(words) // 12) if toxic else 0):
            words.insert(rng.randrange(len(words)), rng.choice(["Grumph", "zonk!", "blarg,"]))
        docs.append((k, " ".join(words), base, "s"))
        if k % 5 != 2:
            labels.append((k, int(toxic)))
    labels += [(None, 1), (3, None), (10**6, 1), (4, 0), (4, 0)]
    return docs, spark.createDataFrame(docs, "doc_id long, text string, lang string, source string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_held_out_accuracy(spark, talk):
    docs, df, labels = talk
    model = toxicity.train(df, labels)
    got = {r.doc_id: r.score for r in toxicity.with_scores(df, model).collect()}
    held = [d for d, *_ in docs if zlib.crc32(str(d).encode()) % 5 == 0]
    right = [(got[d] >= 0.5) == (d % 6 == 0) for d in held]
    assert len(held) > 200 and np.mean(right) > 0.98
    assert all(0 <= s <= 1 for s in got.values())


def test_labels_of_held_out_rows_and_other_columns_change_nothing(spark, talk):
    _, df, labels = talk
    turned = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    moved = df.withColumn("lang", F.lit(None).cast("string")).withColumn("source", F.lit("x"))
    a = rows_of(toxicity.with_scores(df, toxicity.train(df, labels)), "doc_id", F.round("score", 9))
    b = rows_of(toxicity.with_scores(moved, toxicity.train(moved, turned)), "doc_id", F.round("score", 9))
    assert a == b


def test_toxicity_odd_rows(spark, talk, odd, empty):
    _, df, labels = talk
    model = toxicity.train(df, labels)
    got = toxicity.with_scores(odd, model)
    assert got.columns == [c for c in odd.columns if c != "score"] + ["score"] and got.count() == odd.count()
    assert len({r.score for r in got.where("text is null or trim(text) = ''").collect()}) == 1
    assert toxicity.with_scores(empty, model).count() == 0
    for none in (toxicity.train(empty, labels), toxicity.train(df, labels.limit(0))):
        assert {r.score < 1e-9 for r in toxicity.with_scores(odd, none).collect()} == {True}
    some = toxicity.train(df, labels.where("toxic = 1"))
    assert {r.score > 0.99 for r in toxicity.with_scores(odd, some).collect()} == {True}


def plain_toxicity(docs, labels, options):
    """The differences of the two models by their definitions, in plain Python, and exact counts; ``models`` takes those that a sketch gives."""
    fold = lambda d: zlib.crc32(str(d).encode()) % 5
    label = {}
    for d, t in labels:
        if d is not None and t in (0, 1) and fold(d):
            label[d] = max(t, label.get(d, 0))
    parts = {}
    for d, t in docs:
        if d in label:
            parts.setdefault((label[d], fold(d) == 4), set()).add(t or "")
    pairs_of = lambda t: list(zip(["", *toxicity.words_of(t)], toxicity.words_of(t)))
    corpus, before = Counter(), {}
    for _, t in docs:
        corpus.update(pairs_of(t or ""))
    for u, v in corpus:
        before.setdefault(v, set()).add(u)
    starts = Counter()
    for (u, _), n in corpus.items():
        starts[u] += n
    n, d, after, context, used, everywhere = {}, {}, {}, {}, {}, Counter()
    for (_, v), k in corpus.items():
        everywhere[v] += k
    sizes = Counter(label.values())
    for c in (0, 1):
        n[c], d[c], context[c] = Counter(), Counter(), Counter()
        for t in parts[c, False]:
            n[c].update(pairs_of(t))
            d[c].update(set(pairs_of(t)))
        after[c] = Counter(v for _, v in n[c])
        used[c] = Counter()
        for (_, v), k in n[c].items():
            used[c][v] += k
        for (u, _), k in n[c].items():
            context[c][u] += k
    held = {x for c in (0, 1) for x in d[c] if d[c][x] > options.pair_discount}
    known = {v for c in (0, 1) for v in after[c] if after[c][v] > options.discount} | {v for _, v in held}

    def models(types, ahead):
        assert sorted(known) == sorted(ahead)
        assert all(abs(ahead[v] - len(before[v])) <= 1 + 0.3 * len(before[v]) for v in known)
        shared = {v: (ahead[v] + 1) / (types + len(known) + 1) for v in known}
        gamma, p, extra, back = {}, {}, {}, {}
        for c in (0, 1):
            total = len(n[c])
            part = sizes[c] / sizes.total()
            excess = options.excess if part > 0.5 else min(options.excess, part**-0.6)
            ratio = {v: (used[c][v] / used[c].total()) / (everywhere[v] / everywhere.total()) for v in known}
            kept = {v: max(after[c][v] - max(options.discount, after[c][v] * min(1, excess / ratio[v] if ratio[v] else 1)), 0) / total for v in known}
            gamma[c] = 1 - sum(kept.values())
            p[c] = {v: kept[v] + gamma[c] * shared[v] for v in known}
            extra[c], back[c] = {}, {}
            for u, v in held:
                k = n[c][u, v]
                if d[c][u, v] <= options.pair_discount:
                    continue
                expected = max(p[c][v], corpus[u, v] / starts[u])
                extra[c][u, v] = max(k - max(options.pair_discount, options.pair_excess * context[c][u] * expected), 0) / context[c][u]
                back[c][u] = back[c].get(u, 1) - extra[c][u, v]

        def difference(text):
            total = {0: 0.0, 1: 0.0}
            words = pairs_of(text)
            for c in (0, 1):
                for u, v in words:
                    low = p[c][v] if v in known else gamma[c] * 1e-9  # any shared probability: it is the same in both
                    total[c] += np.log(back[c].get(u, 1) * low + extra[c].get((u, v), 0))
            return (total[1] - total[0]) / len(words) - np.log(gamma[1] / gamma[0]) if words else 0.0

        return difference, sum(x > 0 for c in (0, 1) for x in extra[c].values())

    return models, parts


@pytest.mark.parametrize("options", [toxicity.Options(), toxicity.Options(discount=1.0, excess=1.5, pair_discount=2.0, pair_excess=1.2)])
def test_models_against_plain_kneser_ney(spark, talk, options):
    docs, df, labels = talk
    rows = [(k, t) for k, t, *_ in docs]
    # an expression that the toxic rows have far oftener than its words let expect, and one that all have
    rows = [(k, t + (" low blow" if k % 6 == 0 and k % 4 == 0 else " blow low" if k % 3 else "") + " by the way") for k, t in rows]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    models, parts = plain_toxicity(rows, [tuple(r) for r in labels.collect()], options)
    seen = []
    counts = toxicity.corpus_counts
    try:
        toxicity.corpus_counts = lambda *a: seen.append((counts(*a), a[1])) or seen[-1][0]
        model = toxicity.train(df, labels, options)
    finally:
        toxicity.corpus_counts = counts
    every = {x for _, t in rows for x in zip(["", *toxicity.words_of(t)], toxicity.words_of(t))}
    assert abs(seen[0][0].types / len(every) - 1) < 0.03
    difference, bigrams = models(seen[0][0].types, dict(zip(seen[0][1], seen[0][0].before)))
    assert len(model.words) > 3 and (bigrams > 0) == (len(model.pairs) > 0)
    texts = [t for _, t in rows] + ["", "unseen words only", "low blow low blow", "grumph"]
    got, want = np.array([model.difference(toxicity.words_of(t)) for t in texts]), np.array([difference(t) for t in texts])
    assert np.abs(got - want).max() < 1e-9 and (want < -1e-6).any() and (want > 1e-3).sum() > 100
    # the curve is fitted on the fourth fold alone, by weighted maximum likelihood: a step either way is no better
    x = [(toxicity.stretched(difference(t)), c) for (c, held), some in parts.items() if held for t in some]
    weight = {c: sum(1 for d, t in {(r.doc_id, r.toxic) for r in labels.collect()} if t == c and d is not None and zlib.crc32(str(d).encode()) % 5) / len([1 for _, k in x if k == c]) for c in (0, 1)}
    loss = lambda a, b: sum(weight[c] * np.logaddexp(0, (a + b * s) * (1 - 2 * c)) for s, c in x) / sum(weight.values())
    a, b = model.curve
    assert all(loss(a, b) <= loss(a + e, b + f) + 0.05 for e in (-1, 0, 1) for f in (-0.5, 0, 0.5))


def test_corpus_counts(spark):
    rng = random.Random(1)
    texts = [" ".join(f"u{rng.randrange(400)} {rng.choice(['x', 'y', 'z'])}" for _ in range(rng.randrange(60))) for _ in range(300)] + ["q y", None, ""]
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(5)
    seen, every, starts = {}, Counter(), Counter()
    for t in texts:
        w = toxicity.words_of(t or "")
        for u, v in zip(["", *w], w):
            seen.setdefault(v, set()).add(u)
            every[u, v] += 1
            starts[u] += 1
    pairs = [("u3", "x"), ("", "q"), ("x", "u7"), ("never", "x")]
    got = toxicity.corpus_counts(df, ["x", "u3", "absent"], pairs)
    assert got.tokens == every.total() and got.words.tolist() == [sum(n for (_, v), n in every.items() if v == w) for w in ("x", "u3", "absent")]
    assert got.before == pytest.approx([len(seen["x"]), len(seen["u3"]), 0], rel=0.2, abs=0.5) and abs(got.types / len(every) - 1) < 0.05
    assert got.pairs.tolist() == [every[p] for p in pairs] and got.contexts.tolist() == [starts[u] for u, _ in pairs]
    none = toxicity.corpus_counts(df.limit(0), ["x"], [])
    assert none.before.tolist() == [0] and none.types == 0


def test_predecessors_have_no_ceiling(spark):
    texts = [" ".join(f"p{k} common" for k in range(s, s + 1500)) for s in range(0, 12000, 1000)]
    df = spark.createDataFrame([(t,) for t in texts * 2], "text string").repartition(4)
    much = toxicity.corpus_counts(spark.createDataFrame([(" ".join(f"p{k} common" for k in range(s, s + 20_000)),) for s in range(0, 400_000, 20_000)], "text string"), ["common"], [])
    assert much.before[0] == pytest.approx(400_000, rel=0.2)
    got = toxicity.corpus_counts(df, ["common", "p1000"], [("p7", "common")])
    # every text but the first begins with a word that also follows "common" in another
    assert got.before == pytest.approx([12500, 2], rel=0.2) and abs(got.types / (12500 + 12499 + 12) - 1) < 0.03
    assert got.pairs.tolist() == got.contexts.tolist() == [2]


def test_evidence_counts_for_both_classes(spark, talk):
    """Long clean documents, and words of the ordinary class, do not gather towards toxic."""
    docs, df, labels = talk
    model = toxicity.train(df, labels)
    clean = " ".join(t for k, t, *_ in docs[:600] if k % 6)
    assert len(clean.split()) > 20_000 and model.score(toxicity.words_of(clean)) < 0.5
    assert model.difference(["grumph"]) > 0 and model.difference(["grumph", *["unseen"] * 99]) > 0
    assert abs(100 * model.difference(["grumph", *["unseen"] * 99]) - model.difference(["grumph"])) < 1e-9


def test_op4_query(spark, sf_dir, duck):
    got = toxicity.query(spark, sf_dir).toPandas()
    assert sorted(got["doc_id"]) == sorted(r[0] for r in duck.sql("select doc_id from documents").fetchall())
    assert got["held_out"].notna().all() and (got["held_out"] == [zlib.crc32(str(d).encode()) % 5 == 0 for d in got["doc_id"]]).all()
    assert ((got["score"] >= 0.5) == (got["predicted"] == 1)).all()


# 6: URL filters


def test_urls_against_sql(spark, sf_dir, duck):
    got = rows_of(url_filter.query(spark, sf_dir), "page_id", "host", "path", "rule", "verdict")
    assert got == sorted(duck.sql(f"select page_id, host, path, rule, verdict from ({url_filter.ORACLE_SQL})").fetchall(), key=str)


URLS = [
    None, "", "no scheme", "://", "http://", "http://COM", "http://com/", "http://a.b.COM/x", "http://example.com", "http://example.com?/en/", "http://example.com/en/", "http://example.com/en",
    "http://www.example.com/en/1#a?b", "http://x.www.Example.com/en/", "http://notexample.com/en/", "http://a.net/es/", "http://net/fr/x", "http://.com/", "http://com./", "http://a..com/x", "x://y://com/",
    "http://café.com/é", "http://a.com\n/en/", "http://user@a.com:80/", "http://" + "a." * 300 + "com/" + "p" * 5000,
]


@pytest.mark.parametrize("few", [100, 1])
def test_urls_odd_rows(spark, few):
    import duckdb

    pages = spark.createDataFrame([(k, u, "r", f"e{k}") for k, u in enumerate(URLS + URLS[5:8] * 2)] + [(None, None, None, None)], "page_id long, url string, rule string, e string")
    rules = url_filter.contract_rules(spark)
    got = url_filter.judge(pages, rules.unionByName(rules), in_row=few)
    assert got.columns == ["page_id", "url", "e", "host", "path", "rule", "verdict"]
    con = duckdb.connect()
    con.register("p", pages.toPandas())
    con.sql("create view pages as select page_id::bigint as page_id, url from p")
    assert rows_of(got, "page_id", "host", "path", "rule", "verdict") == sorted(con.sql(f"select page_id, host, path, rule, verdict from ({url_filter.ORACLE_SQL})").fetchall(), key=str)
    assert url_filter.judge(pages.limit(0), rules).count() == 0
    assert {r.verdict for r in url_filter.judge(pages, rules.limit(0), default="block").collect()} == {"block"}


def test_urls_run_no_python(spark, sf_dir):
    plan = url_filter.query(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "MapIn" not in plan


def test_ties_of_rules(spark):
    rules = spark.createDataFrame([("a.com", "/bb", "allow"), ("x.a.com", "/", "block"), ("b.com", "/p", "block"), ("b.com", "/p", "allow"), ("c.com", "", "block"), ("", "/q", "block"), (None, "/", "block"), ("d.com", None, "block")], "host string, path string, action string")
    pages = spark.createDataFrame([("http://x.a.com/bbb",), ("http://b.com/pp",), ("http://c.com",), ("http://e.com/q",), ("http://d.com/",)], "url string")
    for in_row in (200, 0):
        got = rows_of(url_filter.judge(pages, rules, in_row=in_row), "url", "rule", "verdict")
        # as many characters: the longer host; the same host and path: block
        assert got == sorted([("http://x.a.com/bbb", "x.a.com/", "block"), ("http://b.com/pp", "b.com/p", "block"), ("http://c.com", "c.com", "block"), ("http://e.com/q", None, "allow"), ("http://d.com/", None, "allow")], key=str)


def test_plan_of_url_rules(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    few = url_filter.judge(pages, url_filter.contract_rules(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in few and "Generate" not in few and "Join" not in few
    many = url_filter.judge(pages, url_filter.contract_rules(spark), in_row=0)._jdf.queryExecution().optimizedPlan().toString()
    # no page goes through the expansion: what is exploded has host and path only
    assert all("html" not in line and "_page" not in line for line in many.splitlines() if "Generate" in line)
    assert "Cartesian" not in many and "monotonically" not in many


# 8: quality rules


def test_quality_against_sql(spark, sf_dir, duck):
    cols = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    assert rows_of(quality.query(spark, sf_dir), *cols) == sorted(duck.sql(f"select {', '.join(cols)} from ({quality.ORACLE_SQL})").fetchall(), key=str)


def test_quality_odd_rows(spark, odd, odd_rows, empty):
    import duckdb

    cols = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    extra = [(100, "a b c d e f g h a b c d e f g h"), (101, "a " * 8), (102, "a " * 9), (103, "x\nx\n x\n\n \nx"), (104, "#*$%&|<>! 😀 é"), (105, "the a\tb\x0bc\x0cd\re " * 30)]
    docs = odd.select("doc_id", "text").unionByName(spark.createDataFrame(extra, "doc_id long, text string"))
    con = duckdb.connect()
    con.register("d", docs.toPandas())
    con.sql("create view documents as select doc_id::bigint as doc_id, text from d")
    assert rows_of(quality.judge(docs), *cols) == sorted(con.sql(f"select {', '.join(cols)} from ({quality.ORACLE_SQL})").fetchall(), key=str)
    got = quality.judge(odd)
    assert set(odd.columns) <= set(got.columns) and got.count() == len(odd_rows)
    assert quality.judge(empty).count() == 0
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan.replace("REPARTITION", "").split("Project")[1] and "Python" not in plan


# 2: WARC


def test_warc_against_sql(spark, sf_dir, duck):
    cols = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert rows_of(warc.query(spark, sf_dir), *cols) == sorted(duck.sql(f"select {', '.join(cols)} from ({warc.ORACLE_SQL})").fetchall(), key=str)


def test_warc_round_trip(spark):
    big, small = "é" * 500 + "\r\n\r\n" * 3, "x" * 999
    rows = [(1, "http://a/1", big), (2, None, big), (3, "http://a/\r\nWARC-Type: x%41", big), (3, "http://a/3", big), (None, "http://n", big), (4, "u", small), (5, "u", small), (6, "u", None), (7, "u", ""), (8, "u", "y" * 1000), (9, "ü", "z" * 300000), (None, None, None), (None, "q", "w" * 2000), (None, "q", "w" * 2000)]
    pages = spark.createDataFrame([(*r, "c", "d") for r in rows], "page_id long, url string, html string, offset string, payload string").repartition(3)
    path = new_folder(spark, "w")
    index = warc.write_archives(pages, path)
    got = warc.read_records(index, path, gap=0, most=1000).collect()
    want = []
    for p, u, h in rows:
        raw = (h or "").encode()
        refers = 3 if h == big and p != 3 else None
        want.append((p, u, "response" if refers is None else "revisit", refers, len(raw), hashlib.sha1(raw).hexdigest(), raw if refers is None else None))
    assert sorted((tuple(r) for r in got), key=str) == sorted(want, key=str)
    some = warc.read_records(index.where("page_id in (2, 9)"), path).collect()
    assert sorted(r.page_id for r in some) == [2, 9]
    assert {r.record_type for r in index.collect()} == {"response", "revisit"}


def test_archives_as_other_readers_see_them(spark):
    """URLs as they are in the target line, record ids that no two records share."""
    urls = ["http://a/%20b", "http://a/%2520b?x=%41", "http://ü/ä b", "http://a/\r\nX: y%41", " http://blank ", None, "http://a/%20b"]
    pages = spark.createDataFrame([(k if k < 5 else None, u, f"text {k}") for k, u in enumerate(urls)], "page_id long, url string, html string").coalesce(2)
    path = new_folder(spark, "w")
    index = warc.write_archives(pages, path)
    raw = []
    fs, folder = files(path)
    for r in index.collect():
        with fs.open_input_file(f"{folder}/{r.file}") as f:
            raw.append(gzip.decompress(f.read_at(r.length, r.offset)))
    heads = [dict(x.split(b": ", 1) for x in r.partition(b"\r\n\r\n")[0].split(b"\r\n")[1:]) for r in raw]
    plain = [h[b"WARC-Target-URI"].decode() for h in heads if b"WARC-Target-URI" in h and b"X-Target-URI-Escaped" not in h]
    assert sorted(plain) == sorted(["http://a/%20b", "http://a/%2520b?x=%41", "http://ü/ä b", "http://a/%20b"])
    assert len({h[b"WARC-Record-ID"] for h in heads}) == len(urls)
    assert sorted(str(r.url) for r in warc.read_records(index, path).collect()) == sorted(map(str, urls))


def test_warc_of_nothing(spark):
    path = new_folder(spark, "w")
    index = warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert index.count() == 0 and warc.read_records(index, path).count() == 0


def test_ranges_are_coalesced():
    rows = [{"file": f, "offset": o, "length": n} for f, o, n in [("a", 0, 10), ("a", 10, 5), ("a", 18, 2), ("a", 40, 5), ("b", 45, 5), ("b", 50, 500), ("b", 550, 1)]]
    got = [[(r["file"], r["offset"]) for r in g] for g in warc.ranges(rows, 3, 100)]
    assert got == [[("a", 0), ("a", 10), ("a", 18)], [("a", 40)], [("b", 45)], [("b", 50)], [("b", 550)]]
