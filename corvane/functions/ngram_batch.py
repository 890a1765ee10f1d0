"""What BLEU and ROUGE count in the pairs of an Arrow batch: tokens of both sides, n-grams they share, common subsequences.

A reference answers many responses, so that its counts are kept. An n-gram is only looked up where its first n - 1 tokens
were met, so that of a long response little more than its tokens is gone through. Stems are kept by word; nothing is
joined, and what is kept is bounded.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa

from .ngram import ENTITIES, common_subsequence, split_13a, stemmed
from .subsequence import lengths

#: Names of the counts: sizes of both sides in BLEU's tokens, shared n-grams of them, sizes in stems, shared stems and pairs, common subsequence.
COUNTS = ["n_a", "n_b", "h1", "h2", "h3", "h4", "n_sa", "n_sb", "r1", "r2", "rl"]
#: Stems kept, characters of a text that is kept, and tokens of a side whose subsequences numpy finds.
STEMS, KEPT, LONG = 200_000, 2000, 2000

_stems: dict[str, str] = {}
_piece = lru_cache(50_000)(split_13a)


def bleu_tokens(text: str) -> list[str]:
    """``ngram.tokens_13a`` piece by piece, as its steps don't look across spaces; most pieces are plain words."""
    text = text.replace("<skipped>", "").replace("-\n", "").replace("\n", " ")
    for entity, char in ENTITIES:
        text = text.replace(entity, char)
    out = []
    for piece in text.split():
        if piece.isalnum():
            out.append(piece)
        elif piece[-1] in ".," and piece[:-1].isalnum():
            out += (piece[:-1], piece[-1])
        else:
            out += _piece(piece) if len(piece) <= 40 else split_13a(piece)
    return out


def stems(text: str) -> list[str]:
    words = re.findall("[a-z0-9]+", text.lower())
    new = set(words).difference(_stems)
    if len(_stems) + len(new) > STEMS:
        _stems.clear()
        new = set(words)
    for w in new:
        if len(w) > 3:
            _stems[w] = stemmed.__wrapped__(w)
    return list(map(_stems.get, words, words))


class Side:
    """A reference: its tokens and stems, and how often it has each n-gram."""

    def __init__(self, text: str):
        tokens, self.stems = bleu_tokens(text), stems(text)
        self.n_tokens = len(tokens)
        self.grams = [_counted(tokens, n) for n in range(1, 5)]
        self.stem_grams = [_counted(self.stems, n) for n in (1, 2)]


def _counted(tokens: list[str], n: int) -> Counter:
    return Counter(tokens) if n == 1 else Counter(zip(*(tokens[i:] for i in range(n))))


_kept = lru_cache(512)(Side)


def shared(tokens: list[str], grams: list[Counter]) -> tuple[list[int], list[int]]:
    """How many n-grams the tokens share with those counted, for each n; and the places of shared tokens."""
    one = grams[0]
    at = first = [i for i, t in enumerate(tokens) if t in one]
    hits = []
    for n, counts in enumerate(grams, 1):
        if n == 1:
            met = Counter([tokens[i] for i in at])
        else:
            places = [(i, g) for i in at if (g := tuple(tokens[i : i + n])) in counts]
            at, met = [i for i, _ in places], Counter([g for _, g in places])
        hits.append(sum(min(k, counts[g]) for g, k in met.items()))
    return hits, first


def of_batch(ok: pa.Array, a: pa.Array, b: pa.Array, with_subsequence: bool) -> pa.StructArray:
    """The counts of each response ``a`` and reference ``b``; zeros unless ``ok``."""
    out = np.zeros((len(COUNTS), len(a)), np.int32)
    texts = [[x.decode("utf-8", "replace") for x in c.cast(pa.binary()).to_pylist()] for c in (a, b)]
    long: list[tuple[int, tuple[np.ndarray, np.ndarray]]] = []
    for row, (good, given, wanted) in enumerate(zip(ok.to_pylist(), *texts)):
        if not good or not given or not wanted:
            continue
        side = _kept(wanted) if len(wanted) <= KEPT else Side(wanted)
        tokens, own = bleu_tokens(given), stems(given)
        hits, _ = shared(tokens, side.grams)
        stem_hits, at = shared(own, side.stem_grams)
        out[:10, row] = [len(tokens), side.n_tokens, *hits, len(own), len(side.stems), *stem_hits]
        if with_subsequence and at:
            ours = [own[i] for i in at]
            met = set(ours)
            theirs = [s for s in side.stems if s in met]
            if max(len(ours), len(theirs)) > LONG:
                number = {s: i for i, s in enumerate(met)}
                long.append((row, tuple(np.array([number[s] for s in x], np.int64) for x in (ours, theirs))))
            else:
                out[10, row] = common_subsequence(*sorted((ours, theirs), key=len, reverse=True))
    if long:
        out[10, [row for row, _ in long]] = lengths([pair for _, pair in long])
    return pa.StructArray.from_arrays([pa.array(c, pa.int32()) for c in out], names=COUNTS)
