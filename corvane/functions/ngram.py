"""BLEU and ROUGE of one response against one reference, in plain Python; :mod:`ngram_sql` scores whole columns.

BLEU follows Papineni et al. 2002 as standardised by Post 2018: 13a
tokenisation, clipped counts up to four-grams, exponential smoothing, effective
order, brevity penalty, case-sensitive. ROUGE follows Lin 2004: lower-case
alphanumeric tokens, Porter stems of tokens over three letters, F of unigrams,
bigrams and the longest common subsequence.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from functools import lru_cache

NGRAM_METRICS = ["bleu", "rouge1_f", "rouge2_f", "rougeL_f"]

# The steps of 13a tokenisation.
ENTITIES = [("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")]
_TOKEN_STEPS = [
    (re.compile(r"([\{-\~\[-\` -\&\(-\+\:-\@\/])"), r" \1 "),
    (re.compile(r"([^0-9])([\.,])"), r"\1 \2 "),
    (re.compile(r"([\.,])([^0-9])"), r" \1 \2"),
    (re.compile(r"([0-9])(-)"), r"\1 \2 "),
]


def tokens_13a(text: str) -> list[str]:
    text = text.replace("<skipped>", "").replace("-\n", "").replace("\n", " ")
    for entity, char in ENTITIES:
        text = text.replace(entity, char)
    return split_13a(text)


def split_13a(text: str) -> list[str]:
    """The tokens of a text whose entities are replaced."""
    text = f" {text} "
    for pattern, by in _TOKEN_STEPS:
        text = pattern.sub(by, text)
    return text.split()


def _grams(tokens: list[str], n: int) -> Counter:
    return Counter(zip(*(tokens[i:] for i in range(n))))


def bleu(response: str, reference: str) -> float:
    """Sentence BLEU between 0 and 1."""
    ours, theirs = tokens_13a(response), tokens_13a(reference)
    logs, penalty, matched = [], 1.0, False
    for n in range(1, 5):
        total = len(ours) - n + 1
        if total <= 0:
            break
        hits = sum((_grams(ours, n) & _grams(theirs, n)).values())
        matched |= hits > 0
        if hits:
            logs.append(math.log(hits / total))
        else:
            penalty *= 2
            logs.append(math.log(1 / (penalty * total)))
    if not matched:
        return 0.0
    brevity = min(0.0, 1 - len(theirs) / len(ours))
    return math.exp(brevity + sum(logs) / len(logs))


class Porter:
    """Porter's suffix stripping (1980), with the usual departures for short words and a few irregular ones."""

    # Irregular forms and the suffix lists of steps 2 to 4.
    IRREGULAR = {"skies": "sky", "sky": "sky", "dying": "die", "lying": "lie", "tying": "tie", "news": "news", "innings": "inning", "inning": "inning", "outings": "outing", "outing": "outing", "cannings": "canning", "canning": "canning", "howe": "howe", "proceed": "proceed", "exceed": "exceed", "succeed": "succeed"}
    STEP2 = [("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("bli", "ble"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"), ("fulli", "ful")]
    STEP3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
    STEP4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]
    #: Longest first, and as tuples that tell soon that a word has none of them.
    LONGEST2, LONGEST4 = sorted(STEP2, key=lambda x: -len(x[0])), sorted(STEP4, key=len, reverse=True)
    ENDS2, ENDS3, ENDS4 = tuple(end for end, _ in STEP2), tuple(end for end, _ in STEP3), tuple(STEP4)
    KINDS = defaultdict(lambda: "c", {ord(v): "v" for v in "aeiou"})

    @staticmethod
    def kinds(word: str) -> str:
        """c or v for each letter; y is a vowel after a consonant."""
        if "y" not in word:
            return word.translate(Porter.KINDS)
        out = ""
        for i, ch in enumerate(word):
            vowel = ch in "aeiou" or ch == "y" and i > 0 and out[-1] == "c"
            out += "v" if vowel else "c"
        return out

    def measure(self, stem: str) -> int:
        return len(re.findall("v+c+", self.kinds(stem)))

    def _short_end(self, word: str) -> bool:
        kinds = self.kinds(word)
        return kinds[-3:] == "cvc" and word[-1] not in "wxy" or kinds == "vc"

    def stem(self, word: str) -> str:
        if word in self.IRREGULAR:
            return self.IRREGULAR[word]
        if len(word) <= 2:
            return word
        for step in (self._plural, self._past, self._final_y, self._double, self._derived, self._suffix, self._tidy):
            word = step(word)
        return word

    def _plural(self, w: str) -> str:
        if w.endswith("sses"):
            return w[:-2]
        if w.endswith("ies"):
            return w[:-1] if len(w) == 4 else w[:-2]
        return w[:-1] if w.endswith("s") and not w.endswith("ss") else w

    def _past(self, w: str) -> str:
        if w.endswith("ied"):
            return w[:-1] if len(w) == 4 else w[:-2]
        if w.endswith("eed"):
            return w[:-1] if self.measure(w[:-3]) else w
        for end in ("ed", "ing"):
            if w.endswith(end) and "v" in self.kinds(w[: -len(end)]):
                w = w[: -len(end)]
                if w.endswith(("at", "bl", "iz")):
                    return w + "e"
                if len(w) > 1 and w[-1] == w[-2] and self.kinds(w)[-1] == "c":
                    return w if w[-1] in "lsz" else w[:-1]
                return w + "e" if self.measure(w) == 1 and self._short_end(w) else w
        return w

    def _final_y(self, w: str) -> str:
        return w[:-1] + "i" if w.endswith("y") and len(w) > 2 and self.kinds(w[:-1])[-1] == "c" else w

    def _double(self, w: str) -> str:
        if w.endswith("alli") and self.measure(w[:-4]):
            return self._double(w[:-4] + "al")
        for end, by in self.LONGEST2 if w.endswith(self.ENDS2) else ():
            if w.endswith(end):
                return w[: -len(end)] + by if self.measure(w[: -len(end)]) else w
        return w[:-1] if w.endswith("logi") and self.measure(w[:-3]) else w

    def _derived(self, w: str) -> str:
        for end, by in self.STEP3 if w.endswith(self.ENDS3) else ():
            if w.endswith(end):
                return w[: -len(end)] + by if self.measure(w[: -len(end)]) else w
        return w

    def _suffix(self, w: str) -> str:
        for end in self.LONGEST4 if w.endswith(self.ENDS4) else ():
            if w.endswith(end):
                stem = w[: -len(end)]
                return stem if self.measure(stem) > 1 and (end != "ion" or stem[-1:] in ("s", "t")) else w
        return w

    def _tidy(self, w: str) -> str:
        if w.endswith("e"):
            m = self.measure(w[:-1])
            if m > 1 or m == 1 and not self._short_end(w[:-1]):
                w = w[:-1]
        return w[:-1] if w.endswith("ll") and self.measure(w[:-1]) > 1 else w


_porter = Porter()


@lru_cache(maxsize=100_000)
def stemmed(token: str) -> str:
    return _porter.stem(token) if len(token) > 3 else token


def rouge_tokens(text: str) -> list[str]:
    return [stemmed(t) for t in re.findall("[a-z0-9]+", text.lower())]


def _f(hits: int, ours: int, theirs: int) -> float:
    return 2 * hits / (ours + theirs) if hits else 0.0


def common_subsequence(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence; the row of the table is one integer, a bit for each token of ``a``."""
    places: dict[str, int] = {}
    for i, t in enumerate(a):
        places[t] = places.get(t, 0) | 1 << i
    row, every = (1 << len(a)) - 1, (1 << len(a)) - 1
    for t in b:
        hit = row & places.get(t, 0)
        row = (row + hit | row - hit) & every
    return len(a) - row.bit_count()


def rouge(response: str, reference: str) -> tuple[float, float, float]:
    """F of unigrams, bigrams and the longest common subsequence."""
    ours, theirs = rouge_tokens(response), rouge_tokens(reference)
    out = []
    for n in (1, 2):
        a, b = _grams(ours, n), _grams(theirs, n)
        out.append(_f(sum((a & b).values()), sum(a.values()), sum(b.values())))
    return out[0], out[1], _f(common_subsequence(ours, theirs), len(ours), len(theirs))
