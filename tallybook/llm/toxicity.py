"""Toxicity (operator 4): class-conditional Kneser-Ney models.

Two bigram models, toxic and ordinary, are counted on labelled documents. A document's score compares its two
log-likelihoods, each divided by the number of words: the difference goes through a logistic curve of one input, which
is fitted on labelled rows that the counts did not see. Words for and against either class count alike.

Each model is interpolated Kneser-Ney of order two. The top order counts occurrences of bigrams, the lower one how
many different words come before a word; from there both models back off to the same distribution, the continuation
counts of all documents. What a discount takes from a count goes to the backoff. A discount here is

* of a word: ``discount``, or as large a part of its count as ``excess`` times its share of all documents' words is of
  its share of the class's, if that is more;
* of a bigram: ``pair_discount``, or ``pair_excess`` times what the lower order, or the bigram's share of its context in
  all documents, leads to expect, if that is more; and the whole count if so few documents of the class hold the bigram.

So an expression that a class uses about as often as the corpus does, and one that is rare, are judged by the shared
counts in both models and say nothing, whatever mixture of languages and topics the labelled documents are. Shares of
occurrences don't change as the corpus grows, so this holds at any size. Both models stay proper distributions.

Learning takes at most ``per_class`` labelled documents of each class for the counts and as many for the curve, those
with the least hash of the id, so the models are bounded; the curve weighs rows so that classes count as often as they
are labelled. The corpus counts take every document. How many different words come before each word of the models, and
how many bigrams there are, is counted by HyperLogLog registers, which have no ceiling: a task sends 256 bytes a word
however long its documents are, where the bigrams themselves took three times the input.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import small_batches, table, text_bytes, written

_WORD = re.compile(r"\w+")
_LOG_OWN, _LOG_ALL = 8, 14  # registers for the bigrams that end in one word, and for all bigrams
_BLOCK = 1 << 14  # registers or counts in a row
START = ""


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


@dataclass(frozen=True)
class Options:
    """See the module; ``per_class`` documents of a class are learnt from at most."""

    per_class: int = 4000
    discount: float = 3.0
    excess: float = 4.0
    pair_discount: float = 5.0
    pair_excess: float = 8.0

    def excess_of(self, part: float) -> float:
        """A word of one class alone is ``1 / part`` times as frequent there as everywhere; the rarer class's bound stays below."""
        return self.excess if part > 0.5 else min(self.excess, part**-0.6)


@dataclass
class Model:
    """Arrays by word number; 0 is any word without evidence, 1 the start. ``pairs``: by ``u << 32 | v``, sorted.

    A probability of word 0 is given as a multiple of the shared one, which is the same in both models.
    """

    words: dict[str, int]
    p: np.ndarray  # (2, words): the lower order; row 1 is toxic
    back: np.ndarray  # (2, words): what a context gives to the lower order
    pairs: np.ndarray
    extra: np.ndarray  # (2, pairs): discounted share of the bigram in its context
    curve: np.ndarray  # bias and weight

    def likelihoods(self, words: list[str]) -> np.ndarray:
        """(2, words): each word's log-likelihood given the word before, but for what both models share."""
        get = self.words.get
        v = np.array([get(w, 0) for w in words], np.int64)
        u = np.concatenate(([1], v[:-1]))[: len(v)]
        p = self.back[:, u] * self.p[:, v]
        if len(self.pairs):
            key = u << 32 | v
            at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
            found = self.pairs[at] == key
            p[:, found] += self.extra[:, at[found]]
        return np.log(p)

    def difference(self, words: list[str]) -> float:
        """The toxic less the ordinary log-likelihood per word, from that of a text without evidence (as one without words)."""
        if not words:
            return 0.0
        ordinary, toxic = self.likelihoods(words).mean(axis=1)
        return float(toxic - ordinary - np.log(self.p[1, 0] / self.p[0, 0]))

    def score(self, words: list[str]) -> float:
        z = float(self.curve @ (1.0, stretched(self.difference(words))))
        return 1 / (1 + np.exp(-min(max(z, -30.0), 30.0)))


def stretched(difference: float) -> float:
    """Differences of a thousandth and of a tenth both matter, so the curve takes their logarithm, with the sign."""
    return float(np.sign(difference) * np.log1p(1000 * abs(difference)))


def _fold(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5))


def _labelled(docs: DataFrame, labels: DataFrame, per_class: int) -> tuple[DataFrame, dict[int, int]]:
    """``toxic, part, text``: the learning rows, at most ``per_class`` of each class in each of two parts, a written
    table; and how many labels each class has."""
    one = labels.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    one = one.withColumn("fold", _fold(F.col("doc_id"))).where("fold != 0").withColumn("part", F.when(F.col("fold") == 4, 1).otherwise(0))
    one = written(one.select("doc_id", "toxic", "part", F.xxhash64("doc_id").alias("nth")), "labels")
    sizes = {r["toxic"]: r["count"] for r in one.groupBy("toxic").count().collect()}
    chosen = None
    for toxic in (0, 1):
        for part in (0, 1):
            some = one.where((F.col("toxic") == toxic) & (F.col("part") == part)).orderBy("nth", "doc_id").limit(per_class)
            chosen = some if chosen is None else chosen.unionByName(some)
    chosen = written(chosen.select(F.col("doc_id").alias("_id"), "toxic", "part"), "chosen")
    # at most 4 * per_class ids
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("_id"))
    # copies of one text count once in a class
    rows = rows.withColumn("_text", F.xxhash64("text")).dropDuplicates(["toxic", "part", "_text"])
    return written(rows.select("toxic", "part", F.coalesce("text", F.lit("")).alias("text")), "labelled"), sizes


def _bigrams(rows: DataFrame) -> DataFrame:
    """``toxic, u, v, n, d``: how often, and in how many documents, a bigram occurs in the learning rows of a class."""
    schema = pa.schema([("toxic", pa.int64()), ("u", pa.string()), ("v", pa.string()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for toxic, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                w = words_of(text)
                if w:
                    pairs = Counter(zip([START, *w], w))
                    u, v = zip(*pairs)
                    yield pa.RecordBatch.from_arrays([pa.array([toxic] * len(u)), pa.array(u), pa.array(v), pa.array(list(pairs.values()))], schema=schema)

    out = rows.select(F.col("toxic").cast("long"), "text").mapInArrow(run, "toxic long, u string, v string, n long")
    return written(out.groupBy("toxic", "u", "v").agg(F.sum("n").alias("n"), F.count("*").alias("d")), "bigrams")


@dataclass
class Corpus:
    """Counts over all documents, by number of the words and bigrams that were asked for."""

    before: np.ndarray  # about how many different words come before a word
    words: np.ndarray  # occurrences of a word
    tokens: float  # occurrences of all words
    types: float  # about how many different bigrams
    pairs: np.ndarray  # occurrences of a bigram
    contexts: np.ndarray  # occurrences of its first word as a context


def _ranks(hashes: np.ndarray, log_registers: int) -> np.ndarray:
    """The place of the first one bit after those that choose the register."""
    rest = hashes << np.uint64(log_registers) >> np.uint64(log_registers)
    return (65 - log_registers - np.frexp(rest.astype(np.float64))[1]).astype(np.uint8)


def distinct(registers: np.ndarray) -> np.ndarray:
    """HyperLogLog's estimate for each row of registers, with linear counting while registers are empty."""
    m, empty = registers.shape[1], (registers == 0).sum(axis=1)
    raw = 0.7213 / (1 + 1.079 / m) * m * m / np.sum(2.0 ** -registers.astype(np.float64), axis=1)
    return np.where((empty > 0) & (raw <= 2.5 * m), m * np.log(m / np.maximum(empty, 1)), raw)


_SENT = "kind int, block int, salt int, payload binary"


def _merged(rows: DataFrame, by: list[str]) -> DataFrame:
    """Blocks of registers (kinds 0 and 1) by their maximum, of counts by their sum."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, None

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*(pa.array([x], pa.int32()) for x in last), pa.array([held.tobytes()], pa.binary())], names=["kind", "block", "salt", "payload"])

        for batch in batches:
            for kind, block, salt, payload in zip(*(c.to_pylist() for c in batch.columns)):
                key = (kind, block, salt if "salt" in by else 0)
                values = np.frombuffer(payload, np.uint8 if kind < 2 else np.int64)
                if key != last:
                    if last is not None:
                        yield out()
                    last, held = key, values
                else:
                    held = np.maximum(held, values) if kind < 2 else held + values
        if last is not None:
            yield out()

    return rows.repartition(*by).sortWithinPartitions(*by).mapInArrow(run, _SENT)


def corpus_counts(docs: DataFrame, words: list[str], pairs: list[tuple[str, str]], text: str = "text") -> Corpus:
    """Counts of ``words`` and ``pairs`` in all of ``docs``. A task sends its registers and counts once, in blocks.

    Blocks of many tasks are merged in two steps, so that none meets the blocks of all tasks at once.
    """
    spark = docs.sparkSession
    small_batches(spark)
    starts = {u: k for k, u in enumerate(sorted({u for u, _ in pairs}))}
    sent = spark.sparkContext.broadcast(({w: k + 1 for k, w in enumerate(words)}, pairs, starts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, wanted, starts = sent.value
        get, digest = known.get, xxhash.xxh64_intdigest
        own, every = np.zeros((len(known) + 1) << _LOG_OWN, np.uint8), np.zeros(1 << _LOG_ALL, np.uint8)
        hashes: dict[str, int] = {}

        def mixed(before: np.ndarray, h: np.ndarray) -> np.ndarray:
            both = (before * np.uint64(0x9E3779B97F4A7C15) + h) * np.uint64(0xBF58476D1CE4E5B9)
            both = (both ^ (both >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
            return both ^ (both >> np.uint64(29))

        def hashed(some: list[str]) -> np.ndarray:
            return np.array([0 if x == START else digest(x, 3) for x in some], np.uint64)

        class Wanted:
            """Counts of some hashes."""

            def __init__(self, some: np.ndarray):
                self.order = np.argsort(some)
                self.some, self.counts = some[self.order], np.zeros(len(some), np.int64)

            def add(self, values: np.ndarray) -> None:
                if len(self.some):
                    at = np.minimum(np.searchsorted(self.some, values), len(self.some) - 1)
                    self.counts += np.bincount(self.order[at[self.some[at] == values]], minlength=len(self.counts))

        of_pairs = Wanted(mixed(hashed([u for u, _ in wanted]), hashed([v for _, v in wanted])))
        of_starts = Wanted(hashed(list(starts)))
        of_words = np.zeros(len(known) + 1, np.int64)
        for batch in batches:
            after, before, ids = [], [], []
            for raw in text_bytes(batch.column(0)):
                w = words_of(raw.decode())
                if not w:
                    continue
                if len(hashes) > 400_000:
                    hashes.clear()
                for x in w:
                    if x not in hashes:
                        hashes[x] = digest(x, 3)
                h = np.fromiter(map(hashes.__getitem__, w), np.uint64, len(w))
                after.append(h)
                before += [np.zeros(1, np.uint64), h[:-1]]
                ids.append(np.array([get(x, 0) for x in w], np.int64))
            if not ids:
                continue
            u, v = np.concatenate(before), np.concatenate(ids)
            both = mixed(u, np.concatenate(after))
            of_pairs.add(both)
            of_starts.add(u)
            of_words += np.bincount(v, minlength=len(of_words))
            np.maximum.at(every, (both >> np.uint64(64 - _LOG_ALL)).astype(np.int64), _ranks(both, _LOG_ALL))
            both, v = both[v > 0], v[v > 0]
            np.maximum.at(own, v << _LOG_OWN | (both >> np.uint64(64 - _LOG_OWN)).astype(np.int64), _ranks(both, _LOG_OWN))
        salt = TaskContext.get().partitionId() % 64
        for kind, values in enumerate((own, every, of_pairs.counts, of_starts.counts, of_words)):
            cuts = range(0, len(values), _BLOCK)
            some = [k for k, at in enumerate(cuts) if values[at : at + _BLOCK].any()]
            for k in some:
                payload = values[k * _BLOCK : (k + 1) * _BLOCK].tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([kind], pa.int32()), pa.array([k], pa.int32()), pa.array([salt], pa.int32()), pa.array([payload], pa.binary())], names=["kind", "block", "salt", "payload"])

    made = docs.select(F.col(f"`{text}`").cast("string").alias("text")).mapInArrow(run, _SENT)
    out = [np.zeros(n, np.uint8 if k < 2 else np.int64) for k, n in enumerate(((len(words) + 1) << _LOG_OWN, 1 << _LOG_ALL, len(pairs), len(starts), len(words) + 1))]
    for r in _merged(_merged(made, ["kind", "block", "salt"]), ["kind", "block"]).collect():  # of the models' words and pairs
        values = np.frombuffer(r["payload"], np.uint8 if r["kind"] < 2 else np.int64)
        out[r["kind"]][r["block"] * _BLOCK : r["block"] * _BLOCK + len(values)] = values
    own, every, pair_counts, start_counts, word_counts = out
    before = distinct(own.reshape(-1, 1 << _LOG_OWN))[1:]
    contexts = start_counts[[starts[u] for u, _ in pairs]] if pairs else np.empty(0)
    return Corpus(before, word_counts[1:], float(word_counts.sum()), float(distinct(every[None, :])[0]), pair_counts, contexts)


def lower_order(counts: np.ndarray, share: np.ndarray, everywhere: np.ndarray, total: float, discount: float, excess: float) -> tuple[np.ndarray, float]:
    """The discounted share of each word among the ``total`` continuation counts of a class, and what is left to the shared distribution.

    ``share`` and ``everywhere`` are the word's parts of the class's words and of all words.
    """
    taken = np.maximum(discount, counts * np.minimum(1, excess * everywhere / np.where(share > 0, share, 1)))
    kept = np.maximum(counts - taken, 0) / total
    return kept, 1.0 - float(kept.sum())


def top_order(n: np.ndarray, documents: np.ndarray, context: np.ndarray, expected: np.ndarray, options: Options) -> np.ndarray:
    """The discounted share of each bigram in its context, which occurs ``context`` times."""
    taken = np.where(documents <= options.pair_discount, n, np.maximum(options.pair_discount, options.pair_excess * context * expected))
    return np.maximum(n - taken, 0) / context


def train(docs: DataFrame, labels: DataFrame, options: Options = Options()) -> Model:
    """Learns from ``labels`` (``doc_id, toxic``) of documents whose crc32(id as text) mod 5 isn't 0.

    Folds 1 to 3 give the counts, fold 4 the curve. Null labels and ids are ignored; of several labels of an id
    toxic wins. Without rows of both classes in both parts, every score is the share of toxic rows (0 of none).
    """
    rows, sizes = _labelled(docs, labels, options.per_class)
    parts = {(r["toxic"], r["part"]): r["count"] for r in rows.groupBy("toxic", "part").count().collect()}
    bigrams = _bigrams(rows.where("part = 0"))
    totals = {r["toxic"]: (r["types"], r["tokens"]) for r in bigrams.groupBy("toxic").agg(F.count("*").alias("types"), F.sum("n").alias("tokens")).collect()}
    if len(parts) < 4 or len(totals) < 2:
        n = sum(parts.values())
        share = sum(c for (t, _), c in parts.items() if t) / n if n else 0.0
        bias = -30.0 if share == 0 else 30.0 if share == 1 else float(np.log(share / (1 - share)))
        return Model({}, np.ones((2, 2)), np.ones((2, 2)), np.empty(0, np.int64), np.ones((2, 0)), np.array([bias, 0.0]))
    # all of this is of the bounded sample
    after = bigrams.groupBy("toxic", "v").agg(F.count("*").alias("types"), F.sum("n").alias("n")).where(F.col("types") > options.discount).orderBy("v").toPandas()
    pairs = bigrams.where(F.col("d") > options.pair_discount)
    contexts = bigrams.join(pairs.select("u").distinct(), "u", "left_semi").groupBy("toxic", "u").agg(F.sum("n").alias("context"))
    pairs = pairs.join(contexts, ["toxic", "u"]).orderBy("u", "v", "toxic").toPandas()
    words = sorted({*after["v"], *pairs["v"]})
    both = sorted(set(zip(pairs["u"], pairs["v"])))
    return _model(after, totals, pairs, words, both, corpus_counts(docs, words, both), rows, sizes, options)


def _model(after: pd.DataFrame, totals: dict[int, tuple[int, int]], pairs: pd.DataFrame, words: list[str], both: list[tuple[str, str]], corpus: Corpus, rows: DataFrame, sizes: dict[int, int], options: Options) -> Model:
    at = {w: k for k, w in enumerate(words)}
    shared = (corpus.before + 1) / (corpus.types + len(words) + 1)
    nth = {x: k for k, x in enumerate(both)}
    p, gamma, kept = np.zeros((2, len(words))), np.zeros(2), []
    for c in (0, 1):
        counts, share = np.zeros(len(words)), np.zeros(len(words))
        some = after[after["toxic"] == c]
        k = [at[v] for v in some["v"]]
        counts[k], share[k] = some["types"], some["n"] / totals[c][1]
        own, gamma[c] = lower_order(counts, share, corpus.words / corpus.tokens, totals[c][0], options.discount, options.excess_of(sizes[c] / sum(sizes.values())))
        p[c] = own + gamma[c] * shared
        some = pairs[pairs["toxic"] == c]
        k = np.array([nth[x] for x in zip(some["u"], some["v"])], np.int64)
        v = np.array([at[x] for x in some["v"]], np.int64)
        expected = np.maximum(p[c][v], corpus.pairs[k] / np.maximum(corpus.contexts[k], 1)) if len(k) else np.empty(0)
        share = top_order(some["n"].to_numpy(np.float64), some["d"].to_numpy(np.float64), some["context"].to_numpy(np.float64), expected, options)
        kept += [(c, *both[i], x) for i, x in zip(k.tolist(), share.tolist()) if x > 0]
    # only words and bigrams that tell the classes apart stay in the model
    telling = {w for w, a, b in zip(words, p[0] / (gamma[0] * shared), p[1] / (gamma[1] * shared)) if a > 1 + 1e-12 or b > 1 + 1e-12}
    telling |= {x for _, u, v, _ in kept for x in (u, v) if x != START}
    known = {START: 1} | {w: k + 2 for k, w in enumerate(sorted(telling))}
    size = len(known) + 1
    model = Model(known, np.ones((2, size)), np.ones((2, size)), np.unique(np.array([known[u] << 32 | known[v] for _, u, v, _ in kept], np.int64)), np.zeros((2, 0)), np.zeros(2))
    model.p[:, 0] = model.p[:, 1] = gamma
    for w in telling:
        # a word that is but a context has the shared probability, given as a multiple like that of word 0
        model.p[:, known[w]] = p[:, at[w]] if w in at else gamma
    model.extra = np.zeros((2, len(model.pairs)))
    for c, u, v, x in kept:
        model.extra[c, np.searchsorted(model.pairs, known[u] << 32 | known[v])] = x
        model.back[c, known[u]] -= x
    model.back = np.maximum(model.back, 1e-9)
    made = _differences(rows.where("part = 1").select("toxic", "text"), model).toPandas()  # of the bounded sample
    toxic = made["toxic"].to_numpy(np.float64)
    true = np.array([sizes[0], sizes[1]]) / sum(sizes.values())
    seen = np.array([(toxic == 0).mean(), (toxic == 1).mean()])
    model.curve = _fit(np.array([stretched(x) for x in made["difference"]]), toxic, (true / seen)[toxic.astype(int)])
    return model


def _differences(rows: DataFrame, model: Model) -> DataFrame:
    sent = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [sent.value.difference(words_of(x)) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got, pa.float64())], names=["toxic", "difference"])

    return rows.mapInArrow(run, "toxic int, difference double")


def _fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.01) -> np.ndarray:
    """Weighted logistic regression by Newton's method."""
    x = np.column_stack((np.ones(len(x)), x))
    w, keep = np.zeros(2), np.diag([1e-6, ridge])
    for _ in range(100):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weight * q * (1 - q))[:, None]).T @ x + keep, x.T @ (weight * (q - y)) + keep @ w)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return w


def with_scores(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with all columns and ``score`` (0 to 1). Only the text counts; null and empty texts get one same score.

    A column ``score`` of ``docs`` is replaced. Rows are scored one by one.
    """
    small_batches(docs.sparkSession)
    keep = [c for c in docs.columns if c != "score"]
    rows = docs.select(F.struct(*[f"`{c}`" for c in keep]).alias("row"), F.col(f"`{text}`").cast("string").alias("text"))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [sent.value.score(words_of(x or "")) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got, pa.float64())], names=["row", "score"])

    schema = rows.select("row", F.lit(0.0).alias("score")).schema
    return rows.mapInArrow(run, schema).select("row.*", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4: ``doc_id, held_out, score, predicted`` for every document; a null id is not held out, as it has no labels."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = with_scores(docs, train(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", F.coalesce(_fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
