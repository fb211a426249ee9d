"""Encoding whole texts with a public tokenizer, in bounded memory and once per distinct word."""

from __future__ import annotations

import json
import os
import re
from itertools import islice

import numpy as np

#: Texts with white space or controls that a tokenizer's pattern may treat in its own way are encoded as one.
_ODD = re.compile("[\x0b\x0c\x1c-\x1f\x85\xa0 ᠎ -‏ -  ⁠　﻿]")
_LETTERS = "[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+(?=[.,!?;: \n\t\r]|$)"
_CELL = re.compile(f"[ \n\t\r]*{_LETTERS}|[ \n\t\r]*[^ \n\t\r]+|[ \n\t\r]+")
_BARE = re.compile(f"{_LETTERS}|[^ \n\t\r]+")
_WIDE = re.compile("[^\x00-ɏ]")
_END = "</w>"


class Encoder:
    """``ids(text)``: the ids of a text as little-endian unsigned 32-bit integers, as ``Tokenizer.encode`` gives them.

    The tokenizers' patterns end a piece where white space begins after something else, and between a letter and a
    stop, so a text is cut there and a known cell isn't encoded again. Of ``limit`` cells the later half is forgotten: common words
    come early, and those stay. New cells are encoded joined, and the ids are dealt back by the bytes that
    they stand for; if those do not meet the cells' ends, each cell is encoded by itself. Texts in which a
    special token is spelled out, or that hold other than plain white space, are encoded whole.
    """

    def __init__(self, path: str, limit: int = 800_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            plan = json.load(f)
        #: white space ends words and is dropped, letters are made small
        self.words = "Lowercase" in json.dumps(plan["normalizer"]) and '"Removed"' in json.dumps(plan["pre_tokenizer"])
        vocabulary = self.tokenizer.get_vocab()
        self.size = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for piece, k in vocabulary.items():  # a letter of a piece is a byte
            self.size[k] = len(piece.removesuffix(_END)) if self.words else len(piece)
        special = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(special)) if special else None
        self.limit, self.known = limit, {}

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, cells: list[str]) -> None:
        ids = np.array(self.tokenizer.encode_batch_fast([(" " if self.words else "").join(cells)], add_special_tokens=False)[0].ids, "<u4")
        ends = np.cumsum(np.fromiter((len(c.encode()) for c in cells), np.int64, len(cells)))
        at = np.cumsum(self.size[ids])
        cuts = np.searchsorted(at, ends)
        if len(at) and at[-1] == ends[-1] and np.array_equal(at[cuts], ends):
            start = 0
            raw = ids.tobytes()
            for c, end in zip(cells, (4 * (cuts + 1)).tolist()):
                self.known[c] = raw[start:end]
                start = end
        else:
            for c in cells:
                self.known[c] = self.whole(c)

    def ids(self, text: str) -> bytes:
        if _ODD.search(text) or (self.special and self.special.search(text)):
            return self.whole(text)
        if not self.words:
            cells = _CELL.findall(text)
        else:  # beyond these letters a small one may depend on its neighbours
            cells = _BARE.findall(text if _WIDE.search(text) else text.lower())
        known = self.known
        if len(known) > self.limit:
            known = self.known = dict(islice(known.items(), self.limit // 2))
        parts = list(map(known.get, cells))
        if None in parts:
            gaps = [k for k, x in enumerate(parts) if x is None]
            self._learn_all(list({cells[k] for k in gaps}))
            for k in gaps:
                parts[k] = known[cells[k]]
        return b"".join(parts)

    def _learn_all(self, cells: list[str]) -> None:
        inner = cells
        if not self.words:  # joined, cells that begin with white space and end with something else stay apart
            inner = [c for c in cells if c[0] in " \n\t\r" and c[-1] not in " \n\t\r"]
            for c in set(cells).difference(inner):
                self.known[c] = self.whole(c)
        for at in range(0, len(inner), 512):
            self._learn(inner[at : at + 512])


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per path in a worker: its words stay known from task to task."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def public_path(name: str) -> str:
    """Where a public tokenizer's file lies; a parameter of every operator that takes one."""
    import public_tokenizers

    return public_tokenizers.path(name)
