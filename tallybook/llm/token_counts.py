"""Token counts (operator 9): greedy longest-match word pieces, counted by a linear automaton.

The vocabulary's pieces form a trie with failure links. Where a match cannot go on, the greedy rule has already
fixed some pieces; their number is precomputed for each node ("popped"), and the failure link leads to the node
of what is left over. So a word costs one step per byte and no piece is built. Counts of words are kept, since
most words of a text have been met before.
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Iterable, Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import small_batches, table, text_bytes
from .tokens import public_path

_KNOWN_WORDS = 400_000


class Automaton:
    """Counts the pieces of a word: the longest of ``first`` that begins it, then the longest of ``rest``, and so on.

    A word that cannot be cut so to its end is one unknown token, as in WordPiece. Empty pieces are ignored;
    the empty word has no pieces.
    """

    def __init__(self, first: Iterable[bytes], rest: Iterable[bytes]):
        self.step: dict[int, int] = {}  # node * 256 + byte: node
        ends, children, nodes = set(), [[], []], 2  # node 0 begins a word, node 1 a later piece
        for root, pieces in ((0, first), (1, rest)):
            for piece in pieces:
                at = root
                for b in piece:
                    key = at << 8 | b
                    if key not in self.step:
                        self.step[key] = nodes
                        children[at].append((b, nodes))
                        children.append([])
                        nodes += 1
                    at = self.step[key]
                if at > 1:
                    ends.add(at)
        self.fail, self.popped = [-1] * nodes, [0] * nodes
        queue = deque((0, 1))
        while queue:
            at = queue.popleft()
            for b, child in children[at]:
                queue.append(child)
                if child in ends:
                    self.fail[child], self.popped[child] = 1, 1
                    continue
                to, popped = self.fail[at], self.popped[at]
                while to >= 0 and (to << 8 | b) not in self.step:
                    popped += self.popped[to]
                    to = self.fail[to]
                if to >= 0:
                    self.fail[child], self.popped[child] = self.step[to << 8 | b], popped

    def count(self, word: bytes) -> int:
        step, fail, popped = self.step.get, self.fail, self.popped
        at = tokens = 0
        for b in word:
            to = step(at << 8 | b, -1)
            while to < 0:
                tokens += popped[at]
                at = fail[at]
                if at < 0:
                    return 1
                to = step(at << 8 | b, -1)
            at = to
        while at > 1:
            tokens += popped[at]
            at = fail[at]
            if at < 0:
                return 1
        return tokens


def byte_pieces(path: str) -> tuple[list[bytes], list[bytes]]:
    """Pieces of a byte-level vocabulary: those that begin with a space open a word (without it), the others go on.

    Every byte is a piece of its own, so no word is unknown. A piece that is just the space opens a word
    whose next bytes have no longer piece; it counts as a token.
    """
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(sorted(set(range(256)) - set(plain)))}
    with open(path, encoding="utf-8") as f:
        plan = json.load(f)
    special = {t["content"] for t in plan["added_tokens"]}
    pieces = [bytes(map(letters.__getitem__, p)) for p in plan["model"]["vocab"] if p not in special]
    return [p for p in pieces if p[:1] == b" "], [p for p in pieces if p[:1] != b" "]


_automata: dict[str, tuple[Automaton, dict[bytes, int]]] = {}


def automaton(path: str) -> tuple[Automaton, dict[bytes, int]]:
    """One automaton per vocabulary in a worker, and the words that it has counted."""
    if path not in _automata:
        _automata[path] = Automaton(*byte_pieces(path)), {}
    return _automata[path]


def with_token_counts(docs: DataFrame, vocabulary: str, text: str = "text") -> DataFrame:
    """``docs`` with all columns, ``n_words`` and ``n_tokens``; each word is taken with a space before it.

    Words are separated by ASCII white space and unchanged. Null and empty texts have none. Columns that are
    called like the new ones are replaced. Rows are counted one by one.
    """
    small_batches(docs.sparkSession)
    keep = [c for c in docs.columns if c not in ("n_words", "n_tokens")]
    rows = docs.select(F.struct(*[f"`{c}`" for c in keep]).alias("row"), F.col(f"`{text}`").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, known = automaton(vocabulary)
        for batch in batches:
            n_words, n_tokens = [], []
            for raw in text_bytes(batch.column(1)):
                words = raw.split()
                if len(known) > _KNOWN_WORDS:  # common words come early: the early half stays
                    kept = dict(islice(known.items(), _KNOWN_WORDS // 2))
                    known.clear()
                    known.update(kept)
                total = 0
                for w in words:
                    n = known.get(w)
                    if n is None:
                        n = known[w] = machine.count(b" " + w)
                    total += n
                n_words.append(len(words))
                n_tokens.append(total)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_tokens, pa.int64())], names=["row", "n_words", "n_tokens"])

    zero = F.lit(0).cast("long")
    schema = rows.select("row", zero.alias("n_words"), zero.alias("n_tokens")).schema
    return rows.mapInArrow(run, schema).select("row.*", "n_words", "n_tokens")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9: ``doc_id, n_words, n_tokens`` of every document."""
    return with_token_counts(table(spark, sf_dir, "documents").select("doc_id", "text"), public_path("byte_bpe_50k.json")).drop("text")
