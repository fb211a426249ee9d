"""Each stage of the pipeline against a brute-force version, on the input that the stage before it left."""

import bisect
import re

import numpy as np
import pytest
from test_filters import best_windows, plain_toxicity
from test_simhash import alike_groups
from test_substring import brute

import corpus_pipeline
from tallybook.llm import toxicity
from tallybook.llm.shared import table, written
from tallybook.llm.tokens import encoder, public_path


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    docs, out = table(spark, sf_dir, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        made = written(stage(spark, docs, sf_dir), name)
        out.append((docs, made))
        docs = made
    return out


def keyed(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_names_and_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash_near_duplicates", "substring_dedup", "decontamination", "packing"]
    for before, after in stages[:-1]:
        assert after.columns == before.columns and after.dtypes == before.dtypes


def test_toxicity(spark, sf_dir, stages):
    """The models by their definitions in plain Python, the curve as fitted: the same documents stay."""
    before, after = stages[0]
    labels = table(spark, sf_dir, "labels")
    options, seen, counts = toxicity.Options(), [], toxicity.corpus_counts
    try:
        toxicity.corpus_counts = lambda *a: seen.append((counts(*a), a[1])) or seen[-1][0]
        model = toxicity.train(before, labels, options)
    finally:
        toxicity.corpus_counts = counts
    rows = sorted(keyed(before).items())
    models, _ = plain_toxicity(rows, [(r.doc_id, r.toxic) for r in labels.collect()], options)
    difference, _ = models(seen[0][0].types, dict(zip(seen[0][1], seen[0][0].before)))
    z = {d: model.curve[0] + model.curve[1] * toxicity.stretched(difference(t or "")) for d, t in rows}
    assert all(abs(x) > 1e-6 for x in z.values())
    assert keyed(after) == {d: t for d, t in rows if z[d] < 0}


def test_near_duplicates(stages):
    before, after = (sorted(keyed(x).items()) for x in stages[1])
    least = {}
    for (d, t), g in zip(before, alike_groups([t for _, t in before])):
        least.setdefault(g, (d, t))
    assert after == sorted(least.values()) and len(after) < len(before)


def test_substrings(stages):
    before, after = stages[2]
    want = {d: kept for d, _, _, kept in brute([(r.doc_id, r.text) for r in before.collect()])}
    assert {d: re.findall(r"[^\x20\x09-\x0D]+", t or "") for d, t in keyed(after).items()} == want
    assert all(r.n_chars == len(r.text) for r in after.collect() if keyed(before)[r.doc_id] != r.text)


def test_leaks(spark, sf_dir, stages):
    before, after = map(keyed, stages[3])
    items = [(r.item_id, r.text) for r in table(spark, sf_dir, "benchmark").collect()]
    assert after == {d: t for d, t in before.items() if not best_windows(t, items)}


def best_fit(lengths, room):
    """How many sequences best-fit decreasing opens, one document at a time."""
    free = []
    for n in sorted(lengths, reverse=True):
        k = bisect.bisect_left(free, n)
        left = free.pop(k) if k < len(free) else room
        if left > n:
            bisect.insort(free, left - n)
        yield k, left == room


def test_packing(stages):
    before, after = stages[4]
    rows = after.collect()
    encode, got = encoder(public_path("word_bpe_49k.json")).tokenizer, {}
    for r in rows:
        assert len(r.ids) == 4 * r.length and 0 < r.length <= 4096
        got.setdefault(r.doc_id, []).append((r.piece, r.start, r.ids))
    for d, t in keyed(before).items():
        ids = np.array([*encode.encode(t or "", add_special_tokens=False).ids, 1], "<u4").tobytes()
        assert sorted(got.pop(d)) == [(k, 4096 * k, ids[16384 * k : 16384 * (k + 1)]) for k in range(-(-len(ids) // 16384))]
    assert not got
    places = {}
    for r in rows:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for some in places.values():  # from 0, without gaps or overlaps
        some.sort()
        assert [o for o, _ in some] == [sum(n for _, n in some[:k]) for k in range(len(some))] and sum(n for _, n in some) <= 4096
    assert len(places) == sum(opened for _, opened in best_fit([r.length for r in rows], 4096))


def test_odd_rows(spark, sf_dir, odd, empty):
    for docs in (odd, empty):
        for name, stage in corpus_pipeline.STAGES:
            docs = written(stage(spark, docs, sf_dir), name)
        assert docs.columns[:2] == ["doc_id", "piece"]
    assert docs.count() == 0
