import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash

from tallybook.llm import simhash
from tallybook.llm.components import components


def fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0d]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    if not words:
        return 0
    runs = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    ones = [0] * 64
    for r in runs:
        h = xxhash.xxh64_intdigest(r, 42)
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(runs))


def groups(prints, radius):
    """Root of each print, by all pairs."""
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    a = np.array(prints, np.uint64)
    for i in range(len(a)):
        for j in np.flatnonzero(np.bitwise_count(a[i + 1 :] ^ a[i]) <= radius) + i + 1:
            x, y = find(i), find(j)
            root[max(x, y)] = min(x, y)
    return [find(k) for k in range(len(a))]


def expected(rows):
    prints = [fingerprint(r[1]) for r in rows]
    roots = groups(prints, 4)
    least = {}
    for r, g in zip(rows, roots):
        if r[0] is not None:
            least[g] = min(least.get(g, r[0]), r[0])
    return sorted(((r[0], f"{p:016x}", least.get(g)) for r, p, g in zip(rows, prints, roots)), key=str)


def test_query_against_brute_force(spark, sf_dir, duck):
    rows = duck.sql("select doc_id, text from documents").fetchall()
    got = sorted((tuple(r) for r in simhash.query(spark, sf_dir).collect()), key=str)
    assert got == expected(rows)


def test_odd_rows(odd, odd_rows):
    got = simhash.near_duplicates(odd).collect()
    assert sorted(((r.doc_id, f"{r.fp & (1 << 64) - 1:016x}", r.component_id) for r in got), key=str) == expected(odd_rows)


def test_empty(empty):
    assert simhash.near_duplicates(empty).count() == 0
    assert simhash.keep_one(empty).columns == empty.columns and simhash.keep_one(empty).count() == 0


@pytest.mark.parametrize("cell_rows, side", [(1 << 17, 512), (50, 16)])
def test_links_of_near_fingerprints(spark, cell_rows, side):
    """Dense balls, chains of links, and lone prints; also with cells that must be split."""
    rng = random.Random(cell_rows)
    prints = set()
    for _ in range(40):
        seed = rng.getrandbits(64)
        for _ in range(20):
            x = seed
            for b in rng.sample(range(64), rng.randrange(7)):
                x ^= 1 << b
            prints.add(x)
            seed = x if rng.random() < 0.3 else seed
    prints |= {rng.getrandbits(64) for _ in range(300)} | {0, (1 << 64) - 1, 15, 255}
    prints = sorted(prints)
    signed = [x - (1 << 64) if x >> 63 else x for x in prints]
    links = simhash.fingerprint_links(spark.createDataFrame([(x,) for x in signed], "fp long"), 4, cell_rows, side)
    assert links.count() < 4 * len(prints)
    roots = {r.node: r.root for r in components(links).collect()}
    got, want = {}, {}
    for x, g in zip(signed, groups(prints, 4)):
        got.setdefault(roots.get(x, x), set()).add(x)
        want.setdefault(g, set()).add(x)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def balls(rng, n):
    """Different prints, many within few bits of another one."""
    prints = set()
    for _ in range(n):
        x = rng.getrandbits(64)
        for _ in range(6):
            prints.add(x)
            for b in rng.sample(range(64), rng.randrange(1, 7)):
                x ^= 1 << b
    return sorted(prints | {0, (1 << 64) - 1, 15, 255})


@pytest.mark.parametrize("agree, radius, cell_rows", [(0, 4, 60), (1, 4, 1 << 17), (1, 4, 4), (2, 4, 1 << 17), (2, 4, 2), (3, 2, 1 << 17), (4, 1, 1 << 17), (1, 0, 1 << 17)])
def test_cells_of_any_number_of_blocks(spark, monkeypatch, agree, radius, cell_rows):
    """Every choice of blocks finds the same groups, also where cells are compared by tiles or split."""
    if agree == 1:
        monkeypatch.setattr(simhash, "_SMALL_CELL", 3)
    prints = balls(random.Random(agree), 80)
    signed = [x - (1 << 64) if x >> 63 else x for x in prints]
    roots = {r.node: r.root for r in components(simhash.fingerprint_links(spark.createDataFrame([(x,) for x in signed], "fp long"), radius, cell_rows, 16, agree)).collect()}
    got, want = {}, {}
    for x, g in zip(signed, groups(prints, radius)):
        got.setdefault(roots.get(x, x), set()).add(x)
        want.setdefault(g, set()).add(x)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_comparisons_grow_less_than_with_the_square():
    """Twenty million prints: few cells a print and few comparisons each, where all pairs would be 2 * 10 ** 14."""
    for n in (236_000, 3_000_000, 20_000_000):
        cost = {k: (len(simhash._masks(4, k)) * n, simhash._pairs_in(simhash._masks(4, k), n)) for k in range(5)}
        rows, pairs = min(cost.values(), key=lambda x: x[0] * simhash._ROW_COST + x[1] * simhash._PAIR_COST)
        assert rows <= 15 * n and pairs <= 1100 * n


def test_components_of_a_long_chain(spark):
    edges = [(k, k + 1) for k in range(200)] + [(900, 901), (901, 900), (5, 5), (None, 3)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(1, 201)} | {901: 900}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_keep_one(odd, odd_rows):
    got = simhash.keep_one(odd)
    assert got.columns == odd.columns
    rows = got.collect()
    groups_ = groups([fingerprint(r[1]) for r in odd_rows], 4)
    assert len(rows) == len(set(groups_))
    by = {}
    for r, g in zip(odd_rows, groups_):
        by.setdefault(g, []).append(r[0])
    assert sorted((r.doc_id for r in rows), key=str) == sorted((min((x for x in ids if x is not None), default=None) for ids in by.values()), key=str)


def alike_groups(texts, size=5, similarity=0.8):
    """Root of each text, by exact weighted shingle similarity of all pairs."""
    counts = []
    for t in texts:
        w = re.findall(rb"[^\x20\x09-\x0d]+", (t or "").encode().lower())
        counts.append(Counter(tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))) if w else Counter())
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(counts):
        for j in range(i):
            b = counts[j]
            common = sum((a & b).values())
            union = sum(a.values()) + sum(b.values()) - common
            if a == b or union and common / union >= similarity:
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [find(k) for k in range(len(texts))]


@pytest.mark.parametrize("group_rows", [1 << 17, 6])
def test_keep_one_similar_joins_scattered_edits(spark, group_rows, monkeypatch):
    """Groups whole and in parts; copies with one-word edits all over, repeated words, a hot line, a chain, exact copies."""
    if group_rows < 100:  # and places of few pairs
        monkeypatch.setattr(simhash, "_PLACE_PAIRS", 5)
    rng = random.Random(11)
    line = " ".join(f"hot{k}" for k in range(12))
    texts = [None, "", " ", "one", "one", "ha " * 60, "ha " * 70, "ha " * 90, line, line]
    for k in range(12):
        base = [f"b{rng.randrange(3000)}" for _ in range(rng.randrange(60, 400))]
        for _ in range(12):
            words = list(base)
            for at in rng.sample(range(len(base)), rng.randrange(len(base) // 30 + 1)):
                words[at] = f"e{rng.random()}"
            texts.append(" ".join(words) + (" " + line if k % 3 == 0 else ""))
    chain = [f"c{k}" for k in range(200)]
    for _ in range(8):
        chain[rng.randrange(200)] = f"d{rng.random()}"
        texts.append(" ".join(chain))
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    want = sorted(set(alike_groups(texts)))
    assert sorted(r.doc_id for r in simhash.keep_one_similar(docs, group_rows=group_rows).collect()) == want
    assert simhash.keep_one(docs).count() > len(want)


def test_near_copies_of_one_text_cost_few_pairs_each(spark, monkeypatch):
    """Near copies that are like the text that they come from, but less than 0.8 like each other; and some like a copy only."""
    rng = random.Random(4)
    base = [f"b{k}" for k in range(150)]
    texts = [" ".join(base)]
    for k in range(400):
        words = list(base)
        for at in rng.sample(range(150), 3):
            words[at] = f"e{rng.random()}"
        if k % 40 == 0:
            texts.append(" ".join(words))
            for at in rng.sample(range(150), 3):
                words[at] = f"e{rng.random()}"
        texts.append(" ".join(words))
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    met, alike = [], simhash._alike
    monkeypatch.setattr(simhash, "_alike", lambda docs, nodes, pairs, *a: met.append(pairs.count()) or alike(docs, nodes, pairs, *a))
    assert sorted(r.doc_id for r in simhash.keep_one_similar(docs).collect()) == sorted(set(alike_groups(texts)))
    assert sum(met) < 20 * len(texts) < len(texts) ** 2 / 10


def test_texts_that_share_too_little_do_not_meet(spark, monkeypatch):
    """Texts that share seven in ten shingles: their groups are large, but nothing is compared pair by pair."""
    rng = random.Random(8)
    line = " ".join(f"hot{k}" for k in range(38))
    texts = [line + " " + " ".join(f"u{rng.random()}" for _ in range(7)) for _ in range(200)]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    met, alike = [], simhash._alike
    monkeypatch.setattr(simhash, "_alike", lambda docs, nodes, pairs, *a: met.append(pairs.count()) or alike(docs, nodes, pairs, *a))
    assert simhash.keep_one_similar(docs).count() == len(set(alike_groups(texts))) == 200
    assert sum(met) < len(texts)


def test_sketches_leave_out_only_what_cannot_be_alike():
    """Sets of shingles of unlike sizes, so that sketches have to be folded, against the exact comparison."""
    rng = np.random.default_rng(3)
    runs, met = [], []
    for n in (1, 4, 5, 30, 33, 120, 130, 500, 515, 3000):
        base = rng.integers(-(1 << 62), 1 << 62, n)
        for share in (0, 0.02, 0.05, 0.1, 0.2, 0.5, 1):
            new = rng.integers(-(1 << 62), 1 << 62, int(share * n))
            runs.append(np.unique(np.concatenate((base[len(new) // 2 :], new))))
    met = [(i, j) for i in range(len(runs)) for j in range(len(runs)) if i != j]
    at, bt = np.array(met).T
    words = [np.frombuffer(simhash._odd(x), np.uint64) for x in runs], [x.view(np.uint64) for x in runs]
    kept = []
    for loads, alike in zip(words, (simhash._odd_alike(0.8), simhash._runs_alike(0.8))):
        ends = np.cumsum([0, *map(len, loads)])
        kept.append(alike(np.concatenate(loads), ends[:-1], ends[1:], np.array([len(x) for x in runs]), at, bt))
    common = np.array([len(np.intersect1d(runs[i], runs[j])) / len(np.union1d(runs[i], runs[j])) for i, j in met])
    assert (kept[1] == (common >= 0.8 - 1e-9)).all() and kept[1].sum() > 50
    near = np.array([min(len(runs[i]), len(runs[j])) >= 0.8 * max(len(runs[i]), len(runs[j])) for i, j in met])  # others don't meet
    assert kept[0][kept[1]].all() and (kept[0] & near).sum() < 1.2 * kept[1].sum() < near.sum() / 2


def test_keep_one_similar_odd_rows(odd, odd_rows, empty):
    got = simhash.keep_one_similar(odd)
    assert got.columns == odd.columns and got.count() == len(set(alike_groups([r[1] for r in odd_rows])))
    assert simhash.keep_one_similar(empty).count() == 0
