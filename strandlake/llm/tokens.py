"""Whole-text token ids of a `tokenizers` file, with pieces cached so that repeated words are encoded once."""

from __future__ import annotations

import re
import unicodedata
from itertools import chain

import numpy as np

_LATIN = [chr(c) for c in (9, 10, 13, *range(0x20, 0x7F), *range(0xA0, 0x250)) if c != 0x130]
_SPECIAL = "<|"


def _chars(test) -> str:
    return "".join(re.escape(c) for c in _LATIN if test(unicodedata.category(c)))


class _Pieces(dict):
    """Piece -> its ids as little-endian bytes. Over the limit a new generation begins, into which what is asked for again is taken over."""

    def __init__(self, tokenizer, limit: int):
        self.tokenizer, self.limit, self.old = tokenizer, limit, {}
        words = tokenizer.get_vocab()
        self.last = np.zeros(max(words.values()) + 1, bool)
        self.last[[i for w, i in words.items() if w.endswith("</w>")]] = True

    def fill(self, pieces: set[str]) -> None:
        if len(self) > self.limit:
            self.old = dict(self)
            self.clear()
        new = pieces.difference(self)
        known = new.intersection(self.old)
        self.update((p, self.old[p]) for p in known)
        new = list(new - known)
        for k in range(0, len(new), 10_000):
            self._encode(new[k : k + 10_000])

    def _encode(self, new: list[str]) -> None:
        """New pieces in texts of 200: spaces keep them apart, and each ends with the only id that closes a word."""
        found = self.tokenizer.encode_batch_fast([" ".join(new[k : k + 200]) for k in range(0, len(new), 200)], add_special_tokens=False)
        ids = np.array(list(chain.from_iterable(e.ids for e in found)), "<u4")
        ends = np.flatnonzero(self.last[ids]) + 1
        if len(ends) == len(new):
            data, cuts = ids.tobytes(), [0, *(4 * ends).tolist()]
            self.update(zip(new, (data[a:b] for a, b in zip(cuts, cuts[1:]))))
        else:
            for p, e in zip(new, self.tokenizer.encode_batch_fast(new, add_special_tokens=False)):
                self[p] = np.array(e.ids, "<u4").tobytes()


class Encoder:
    """ids(texts): one bytes object a text, unsigned 32-bit little-endian ids.

    The word-level path holds for lower-casing BPE files that drop white space and cut at letters, single digits and
    runs of symbols, and only for Latin characters, where that cutting and lower-casing are certain; every other file or text goes
    to the tokenizer whole. cache: entries of a generation; a worker keeps two.
    """

    def __init__(self, path: str, cache: int = 300_000):
        import json

        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        spec = json.load(open(path))
        split = ((spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0].get("pattern", {}).get("Regex")
        norm = [n.get("type") for n in (spec.get("normalizer") or {}).get("normalizers", [])]
        self.by_word = split == r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+" and norm == ["NFC", "Replace", "Lowercase"] and not spec.get("post_processor")
        letters, digits = _chars(lambda k: k[0] == "L"), _chars(lambda k: k[0] == "N")
        spaces = _chars(lambda k: k[0] in "Z") + "\t\n\r"
        self.find = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{digits}]|[^{letters}{digits}{spaces}]+").findall
        self.other = re.compile("[^" + "".join(re.escape(c) for c in _LATIN) + "]").search
        self.cache = _Pieces(self.tokenizer, cache)

    def ids(self, texts: list[str]) -> list[bytes]:
        out: list[bytes | None] = [None] * len(texts)
        whole = [i for i, t in enumerate(texts) if not self.by_word or _SPECIAL in t or self.other(t)]
        if whole:
            for i, e in zip(whole, self.tokenizer.encode_batch_fast([texts[i] for i in whole], add_special_tokens=False)):
                out[i] = np.array(e.ids, "<u4").tobytes()
        cut = {i: self.find(t.lower()) for i, t in enumerate(texts) if out[i] is None}
        self.cache.fill(set(chain.from_iterable(cut.values())))
        for i, pieces in cut.items():
            out[i] = b"".join(map(self.cache.__getitem__, pieces))
        return out


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per worker process and file."""
    if path not in _encoders:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _encoders[path] = Encoder(path)
    return _encoders[path]
