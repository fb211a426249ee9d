import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallybook.llm import packing, token_counts, token_files
from tallybook.llm.shared import new_folder
from tallybook.llm.tokens import Encoder, public_path

FILES = ["byte_bpe_50k.json", "word_bpe_49k.json"]


def ids_of(coder, text, end):
    return np.array([*coder.tokenizer.encode(text or "", add_special_tokens=False).ids, end], "<u4")


@pytest.mark.parametrize("name", FILES)
def test_cells_give_the_tokenizers_ids(name, odd_rows, duck):
    coder = Encoder(public_path(name), limit=3000)
    texts = [r[1] or "" for r in odd_rows] + [r[0] for r in duck.sql("select text from documents").fetchall()]
    texts += ["", " ", "\n", "a  b", " a\n\n b\t", "don't you're WE'LL", "a\x1cb", "x  y", "﻿a", "U.S. 3.14 a...b ?! x!?&", "Á ́b", "ΣΑΣ. Σ", "tail  ", "½² x½.", "e.g.,x ., .a", "1,2;3:4"]
    rng = random.Random(2)
    texts += ["".join(rng.choice("ab .,!\n\t'sÉ1&|é") for _ in range(rng.randrange(40))) for _ in range(400)]
    for _ in range(2):
        assert [coder.ids(t) for t in texts] == [coder.whole(t) for t in texts]


@pytest.mark.parametrize("vocabulary", [50_257, 70_000])
def test_token_files_round_trip(spark, odd, odd_rows, vocabulary):
    path, coder = new_folder(spark, "t"), Encoder(public_path(FILES[0]))
    manifest = token_files.write_token_files(odd, path, public_path(FILES[0]), 2, vocabulary, shards=3)
    assert manifest["dtype"] == ("<u2" if vocabulary < 65536 else "<u4")
    got = sorted(token_files.read_token_files(spark, path).collect(), key=lambda r: r.start)
    order = sorted(odd_rows, key=lambda r: (r[0] is not None, r[0] or 0))
    assert [r.doc_id for r in got] == [r[0] for r in order]
    want = sorted((str(r[0]), ids_of(coder, r[1], 2).tobytes()) for r in odd_rows)
    assert sorted((str(r.doc_id), bytes(r.ids)) for r in got) == want
    assert [r.start for r in got] == np.cumsum([0, *(r.n_tokens for r in got)])[:-1].tolist()


def test_many_tiny_documents_in_one_shard(spark):
    n = 200_000
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 7 > 0, F.lit("a b")).alias("text"))
    path = new_folder(spark, "t")
    manifest = token_files.write_token_files(docs, path, public_path("byte_bpe_50k.json"), 2, 50_257, shards=1)
    assert [(r["documents"], r["tokens"]) for r in manifest["shards"]] == [(n, 3 * n - 2 * -(-n // 7))]
    got = token_files.read_token_files(spark, path).agg(F.count("*"), F.sum("n_tokens"), F.max("start"), F.countDistinct("doc_id")).first()
    assert tuple(got) == (n, 3 * n - 2 * -(-n // 7), 3 * n - 2 * -(-n // 7) - (1 if (n - 1) % 7 == 0 else 3), n)


def test_token_files_of_nothing(spark, empty):
    path = new_folder(spark, "t")
    assert token_files.write_token_files(empty, path, public_path(FILES[0]), 2, 50_257)["shards"] == []
    assert token_files.read_token_files(spark, path).count() == 0


def test_op3_query(spark, sf_dir, duck):
    coder, at, want = Encoder(public_path(FILES[0])), 0, []
    for d, t in duck.sql("select doc_id, text from documents order by doc_id").fetchall():
        ids = ids_of(coder, t, 2)
        want.append((d, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert sorted(map(tuple, token_files.query(spark, sf_dir).collect())) == want


def packed(rows, room):
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for spans in bins.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at and length
            at += length
        assert at <= room
    return len(bins)


def best_fit(lengths, room):
    free = []
    for x in sorted(lengths, reverse=True):
        fits = [k for k, v in enumerate(free) if v >= x]
        if fits:
            free[min(fits, key=lambda k: free[k])] -= x
        else:
            free.append(room - x)
    return len(free)


@pytest.mark.parametrize("seed", range(60))
def test_plan_is_best_fit_decreasing(seed):
    rng = random.Random(seed)
    room = rng.choice([1, 7, 16, 50])
    counts = {n: rng.randrange(30) for n in range(1, room + 1)}
    rows = [type("R", (), {"sequence_id": first + (r - low) // per, "offset": at + (r - low) % per * n, "length": n}) for n, low, high, first, per, at in packing.plan(counts, room) for r in range(low, high)]
    assert len(rows) == sum(counts.values())
    assert packed(rows, room) == best_fit([n for n, c in counts.items() for _ in range(c)], room)


def test_plan_of_huge_counts_is_small():
    assert len(packing.plan({n: 10**12 + n for n in range(1, 4097)}, 4096)) < 50_000


@pytest.mark.parametrize("room", [4096, 64])
def test_packing(odd, odd_rows, room):
    coder = Encoder(public_path(FILES[1]))
    rows = packing.pack(odd, public_path(FILES[1]), 1, room).collect()
    want = []
    for r in odd_rows:
        ids = ids_of(coder, r[1], 1)
        want += [(str(r[0]), p, at, ids[at : at + room].tobytes()) for p, at in enumerate(range(0, len(ids), room))]
    assert sorted((str(r.doc_id), r.piece, r.start, bytes(r.ids)) for r in rows) == sorted(want)
    assert all(r.length * 4 == len(r.ids) for r in rows)
    assert packed(rows, room) == best_fit([r.length for r in rows], room)


def test_op5_query(spark, sf_dir, duck):
    coder, want = Encoder(public_path(FILES[1])), []
    for d, t in duck.sql("select doc_id, text from documents").fetchall():
        ids = ids_of(coder, t, 1)
        want += [(d, p, at, len(ids[at : at + 4096]), zlib.crc32(ids[at : at + 4096].tobytes())) for p, at in enumerate(range(0, len(ids), 4096))]
    rows = packing.query(spark, sf_dir).collect()
    assert sorted(tuple(r)[:5] for r in rows) == sorted(want)
    assert packed(rows, 4096) == best_fit([r.length for r in rows], 4096)


def test_packing_nothing(empty):
    assert packing.pack(empty, public_path(FILES[1]), 1).count() == 0


def naive(word, first, rest):
    at = n = 0
    while at < len(word):
        end = next((e for e in range(len(word), at, -1) if word[at:e] in (first if at == 0 else rest)), None)
        if end is None:
            return 1
        at, n = end, n + 1
    return n


@pytest.mark.parametrize("seed", range(200))
def test_automaton_against_longest_match(seed):
    rng = random.Random(seed)
    some = lambda most: {bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(1, most))}
    first, rest = some(6), some(8)
    machine = token_counts.Automaton(first, rest)
    for _ in range(30):
        word = bytes(rng.choice(b"abc") for _ in range(rng.randrange(14)))
        assert machine.count(word) == naive(word, first, rest)


def test_automaton_against_word_piece():
    from tokenizers import models

    rng = random.Random(4)
    pieces = {"".join(rng.choice("abcd") for _ in range(rng.randint(1, 5))) for _ in range(60)}
    vocab = {p: k for k, p in enumerate(sorted(pieces | {"##" + p for p in list(pieces)[::2]} | {"[UNK]"}))}
    model = models.WordPiece(vocab, unk_token="[UNK]", max_input_chars_per_word=1000)
    plain = [p.encode() for p in vocab if p[0] not in "#["]
    machine = token_counts.Automaton(plain, [p[2:].encode() for p in vocab if p.startswith("##")])
    for _ in range(500):
        word = "".join(rng.choice("abcd") for _ in range(rng.randint(1, 20)))
        assert machine.count(word.encode()) == len(model.tokenize(word))


def test_op9_query_and_odd_rows(spark, sf_dir, duck, odd, odd_rows, empty):
    first, rest = map(set, token_counts.byte_pieces(public_path(FILES[0])))
    longest = max(map(len, first | rest))

    def count(text):
        total = 0
        words = (text or "").encode().split()
        for w in words:
            at, w = 0, b" " + w
            while at < len(w):
                at = next(e for e in range(min(len(w), at + longest), at, -1) if w[at:e] in (rest if at else first))
                total += 1
        return len(words), total

    want = [(d, *count(t)) for d, t in duck.sql("select doc_id, text from documents").fetchall()]
    assert sorted(tuple(r) for r in token_counts.query(spark, sf_dir).collect()) == sorted(want)
    got = token_counts.with_token_counts(odd, public_path(FILES[0]))
    assert got.columns == [c for c in odd.columns if c != "n_words"] + ["n_words", "n_tokens"]
    assert sorted((str(r.doc_id), r.n_words, r.n_tokens) for r in got.collect()) == sorted((str(r[0]), *count(r[1])) for r in odd_rows)
    assert token_counts.with_token_counts(empty, public_path(FILES[0])).count() == 0
