import hashlib
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tallybook.llm import substring


def brute(rows, window=35):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    seen = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for (d, _), w in zip(rows, words):
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        out.append((d, len(w), len(gone), [x for k, x in enumerate(w) if k not in gone]))
    return sorted(out, key=str)


def test_query_against_sql(spark, sf_dir, duck):
    got = substring.query(spark, sf_dir).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    want = duck.sql(f"select doc_id, n_words, n_removed, kept_sha256 from ({substring.ORACLE_SQL})").fetchall()
    assert sorted(map(tuple, got)) == sorted(want)


@pytest.mark.parametrize("window", [35, 8, 20])
def test_odd_rows(odd, odd_rows, window):
    got = substring.remove_repeats(odd, window)
    assert got.columns == [c for c in odd.columns if c != "n_words"] + ["n_words", "n_removed"]
    rows = got.collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in rows), key=str) == brute([x[:2] for x in odd_rows], window)
    texts = {r[1] for r in odd_rows}
    assert all(r.text in texts for r in rows if not r.n_removed)


def test_frequent_anchors_change_nothing(odd, odd_rows, monkeypatch):
    """Every anchor counts as frequent, so rows are dealt out in the other ways."""
    rows = [x[:2] for x in odd_rows]
    def all_often(sample):
        whole = substring._index_rows(odd.select(F.col("doc_id").alias("_d"), F.xxhash64("text").alias("_h"), F.col("text").alias("_text")), 35)
        counts = whole.groupBy("a", "b").count().where("count > 2").collect()
        return [r.a for r in whole.select("a").distinct().limit(500).collect()], [(r.a, r.b) for r in counts][:200]

    monkeypatch.setattr(substring, "_often", all_often)
    got = substring.remove_repeats(odd).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in got), key=str) == brute(rows)


def test_kept_text_keeps_its_white_space():
    words = b"a b  c\nd e".split()
    import numpy as np

    assert substring._clean(words, b" a b  c\nd e ", np.array([0, 0, 0, 0, 0], bool)) == b" a b  c\nd e "
    assert substring._clean(words, b" a b  c\nd e ", np.array([0, 0, 1, 0, 0], bool)) == b"a b\nd e"
    assert substring._clean(words, b" a b  c\nd e ", np.array([1, 1, 1, 1, 1], bool)) == b""


def test_empty(empty):
    assert substring.remove_repeats(empty).count() == 0
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0")
