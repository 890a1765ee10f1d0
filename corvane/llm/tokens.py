"""Encoding whole documents with a public tokenizer, by blocks.

``Encoder`` returns exactly what the tokenizers library returns for each text.
For the word-level BPE file most texts hold only ASCII and Latin-1 letters; for
those the pre-tokens are found with numpy, each distinct one is encoded by the
library once and kept in a bounded table of ids, and the ids are gathered.
Every other text goes to the library as it is.
"""

from __future__ import annotations

import json
import os

import numpy as np

os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core; threads of its own would only hold memory
from tokenizers import Tokenizer, pre_tokenizers  # noqa: E402

from . import kernels  # noqa: E402

#: The split pattern for which the vectorised path holds.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Distinct pre-tokens kept; beyond it the table starts anew, which only costs time.
KEPT_WORDS = 400_000

SECOND = 0x5851F42D4C957F2D

# Classes of bytes: 0 space, 1 letter, 2 digit, 3 symbol, 4 not for the vectorised path.
_CLASS = np.full(256, 4, np.uint8)
_CLASS[[9, 10, 13, 32]] = 0
_CLASS[33:127] = 3
_CLASS[[*range(65, 91), *range(97, 123)]] = 1
_CLASS[48:58] = 2
_CLASS[0x80:0xC0] = 1  # second bytes; the lead byte decides
_CLASS[0xC3] = 1
#: Lower case of ASCII, and of the second byte after 0xC3.
_LOW = kernels.LOWER.copy()
_LOW[0x80:0x9F] += 0x20
#: What may follow an apostrophe that starts a piece.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")


class Encoder:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.path, self._library = path, None
        parts = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        kinds = [x["type"] for x in (spec.get("normalizer") or {}).get("normalizers", [])]
        self.fast = parts[0].get("pattern", {}).get("Regex") == WORD_PATTERN and kinds == ["NFC", "Replace", "Lowercase"] and spec["model"].get("end_of_word_suffix") == "</w>"
        if self.fast:
            # The same model for text that is lower case and split at spaces already.
            self.words = Tokenizer.from_str(json.dumps(spec | {"added_tokens": [], "normalizer": None}))
            self.words.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
            vocab = spec["model"]["vocab"]
            self.ends = np.zeros(max(vocab.values()) + 1, bool)
            self.ends[[i for k, i in vocab.items() if k.endswith("</w>")]] = True
            self.added = [x["content"].encode() for x in spec["added_tokens"]]
            self._reset()

    @property
    def library(self) -> Tokenizer:
        """The tokenizer as the file has it, made when a text first needs it."""
        if self._library is None:
            self._library = Tokenizer.from_file(self.path)
        return self._library

    def _reset(self) -> None:
        self.keys = [np.zeros(0, np.uint64), np.zeros(0, np.uint64)]  # sorted: all but the newest, the newest
        self.at = [np.zeros(0, np.int64), np.zeros(0, np.int64)]
        self.checks = np.zeros(0, np.uint64)  # the second number of each word: a hit must agree in both
        self.offset = np.zeros(1, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids as uint32, and where each text's begin (one more than texts)."""
        if not self.fast:
            return self._by_library(texts)
        plain = [self._plain(t) for t in texts]
        if all(plain):
            return self._by_words(texts)
        quick, q = self._by_words([t for t, p in zip(texts, plain) if p])
        slow, s = self._by_library([t for t, p in zip(texts, plain) if not p])
        out, i, j = [], 0, 0
        for p in plain:
            if p:
                out.append(quick[q[i] : q[i + 1]])
                i += 1
            else:
                out.append(slow[s[j] : s[j + 1]])
                j += 1
        return np.concatenate(out), np.cumsum([0, *map(len, out)])

    def _plain(self, text: bytes) -> bool:
        if text.isascii():
            return not text.translate(None, _PLAIN_ASCII) and not (b"<|" in text and any(a in text for a in self.added))
        return not text.translate(None, _PLAIN) and b"\xc3\x97" not in text and b"\xc3\xb7" not in text and not (b"<|" in text and any(a in text for a in self.added))

    def _by_library(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        found = self.library.encode_batch_fast([t.decode("utf-8", "replace") for t in texts], add_special_tokens=False)
        ids = [np.array(e.ids, np.uint32) for e in found]
        return np.concatenate([np.zeros(0, np.uint32), *ids]), np.cumsum([0, *map(len, ids)])

    def _by_words(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        buf, starts = kernels.concatenated(texts)
        buf = _LOW[buf]
        s, e = _pieces(buf)
        h, second = kernels.span_keys(buf, s, e, SECOND)
        unique, first, inverse = np.unique(h, return_index=True, return_inverse=True)
        if (second != second[first][inverse]).any():  # words that share one hash only
            return self._by_library(texts)
        if len(self.offset) > KEPT_WORDS:
            self._reset()
        entry = self._find(unique)
        missing = np.flatnonzero(entry < 0)
        if len(missing):
            raw = buf.tobytes()
            self._learn(unique[missing], second[first[missing]], [raw[s[i] : e[i]].decode("utf-8") for i in first[missing]])
            entry = self._find(unique)
        if (self.checks[entry] != second[first]).any():
            return self._by_library(texts)
        entry = entry[inverse]
        begin = self.offset[entry]
        length = self.offset[entry + 1] - begin
        ends = np.zeros(len(length) + 1, np.int64)
        np.cumsum(length, out=ends[1:])
        ids = self.ids[np.repeat(begin - ends[:-1], length) + np.arange(ends[-1])]
        return ids, ends[np.searchsorted(s, starts)]

    def _find(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), -1, np.int64)
        for have, at in zip(self.keys, self.at):
            if len(have):
                i = np.minimum(np.searchsorted(have, keys), len(have) - 1)
                hit = have[i] == keys
                out[hit] = at[i[hit]]
        return out

    def _learn(self, keys: np.ndarray, checks: np.ndarray, words: list[str]) -> None:
        """Encode new pre-tokens; every one ends with the one id that has the word's end."""
        lines = [" ".join(words[i : i + 50]) for i in range(0, len(words), 50)]
        ids = np.concatenate([np.array(x.ids, np.uint32) for x in self.words.encode_batch_fast(lines, add_special_tokens=False)])
        ends = np.flatnonzero(self.ends[ids]) + 1
        if len(ends) != len(words):
            raise ValueError("a pre-token did not end with an end-of-word id")
        base, n = self.offset[-1], len(self.offset) - 1
        self.offset = np.concatenate([self.offset, base + ends])
        self.ids = np.concatenate([self.ids, ids])
        self.checks = np.concatenate([self.checks, checks])
        new_keys = np.concatenate([self.keys[1], keys])
        new_at = np.concatenate([self.at[1], np.arange(n, n + len(words))])
        if len(new_keys) > max(50_000, len(self.keys[0]) // 4):
            new_keys, new_at = np.concatenate([self.keys[0], new_keys]), np.concatenate([self.at[0], new_at])
            order = np.argsort(new_keys)
            self.keys, self.at = [new_keys[order], new_keys[:0]], [new_at[order], new_at[:0]]
        else:
            order = np.argsort(new_keys)
            self.keys[1], self.at[1] = new_keys[order], new_at[order]


_PLAIN_ASCII = bytes(i for i in range(128) if _CLASS[i] != 4)
_PLAIN = bytes(i for i in range(256) if _CLASS[i] != 4)


def _pieces(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the pre-tokens of lower-cased plain text."""
    kind = _CLASS[buf]
    edge = np.ones(len(buf) + 1, bool)
    edge[1:-1] = (kind[1:] != kind[:-1]) | (kind[1:] == 2)
    edge = np.flatnonzero(edge)
    s, e = edge[:-1], edge[1:]
    s, e = s[kind[s] != 0], e[kind[s] != 0]
    lone = np.flatnonzero((buf[s] == 39) & (e - s == 1))
    lone = lone[lone + 1 < len(s)]
    lone = lone[(s[lone + 1] == e[lone]) & (kind[s[np.minimum(lone + 1, len(s) - 1)]] == 1)]
    if len(lone):
        s, e, n = s.copy(), e.copy(), len(buf)
        a = s[lone]
        one, two = buf[np.minimum(a + 1, n - 1)], buf[np.minimum(a + 2, n - 1)]
        take = np.zeros(len(lone), np.int64)
        for c in CONTRACTIONS:
            c = c.encode()
            fits = (one == c[0]) & ((two == c[-1]) if len(c) == 2 else True) & (e[lone + 1] - s[lone + 1] >= len(c))
            take[fits & (take == 0)] = len(c)
        e[lone] += take
        s[lone + 1] += take
        full = s < e
        s, e = s[full], e[full]
    return s, e
