"""Secret scans: fixed patterns, and character Markov models for what they miss.

Two first-order Markov models over characters, one of random strings and
one of ordinary identifiers and words, are trained from labelled samples: keys as
generators make them; identifiers, and with ``fit`` words of the corpus in all its
languages, from a bounded sample of its texts. A candidate
token is a secret if its log-likelihood ratio per character is above a
threshold. Candidates are runs of ``[A-Za-z0-9+/_=-]`` of 20 characters or more, of any
length; of a run that is not a secret as a whole, its parts between ``/`` and ``=`` and all
its windows of 20 characters are candidates. Base spans are cut out of a run; what is left of
it is scored for itself, beside an access key or a hex string also if it is shorter.

Not secrets by themselves are runs of digits only (numbers, unless a key is assigned
them), UUIDs (identifiers), and runs of one character or of the alphabet.

Defined results: null and empty texts have no spans; an empty table gives no rows, and
nothing is learned from it; repeated rows are
documents of their own; other columns are ignored; texts of any length are
scanned whole; positions are code points, ends exclusive. ``redact`` leaves a column
``n_chars`` that holds no numbers as it is.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_block, mapped
from .decontam import merged

# The base patterns and the least lengths.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
LEAST_VALUE, LEAST_ACCESS = 6, 20
KINDS = ("assign", "access", "hex", "markov")
#: Lower-case strings of which one stands in every text with an assignment.
_ASSIGN_HINTS = ("passw", "secret", "token", "key")

CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
PART = re.compile(r"[A-Za-z0-9+_-]{20,}")
WINDOW = 20
UUID = re.compile(r"[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}")
#: Texts that words are learned from, and words of each, at most.
TEXTS, TEXT_WORDS = 1024, 64
#: Log-likelihood ratio per character (nats) from which a candidate is a secret.
THRESHOLD = 0.35

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"

# Words that ordinary identifiers consist of.
IDENTIFIER_WORDS = """account action active address agent array attribute author backup balance base batch block body branch buffer build
button cache call card category channel check child class client code collection color column command comment common component config
connection content context control count create current customer data database date default delete description detail device dialog
directory display document domain download element email enable error event example export factory field file filter font format
frame function global graph group handler hash header height history image import index info input instance integer interface item
iterator label language layout length level library line link list local location login manager mapping master member memory message
method model module name network node notification number object option order output package page parameter parent password path
payment pattern permission pixel platform player plugin point policy position price process product profile project property provider
query queue random range record reference region register release remote render report request resource response result return route
sample schedule schema score screen search section select sequence server service session setting shape signal size source stack
start state status storage stream string style subject summary support symbol system table target task template test text theme thread
time title token tool total track transaction transfer tree type update upload user utility value variable vector version view widget
window worker wrapper write""".split()


def random_samples(n: int, seed: int = 7) -> list[str]:
    """Labelled positives: strings as key generators make them."""
    rng = np.random.default_rng(seed)
    alphabets = [ALPHABET[:62], ALPHABET[:62] + "+/", ALPHABET[:62] + "_-", ALPHABET[:26] + ALPHABET[52:62], ALPHABET[26:62], "0123456789abcdef"]
    return ["".join(rng.choice(list(alphabets[i % len(alphabets)]), size=int(rng.integers(20, 65)))) for i in range(n)]


def ordinary_samples(n: int, seed: int = 11) -> list[str]:
    """Labelled negatives: snake, camel, kebab and path identifiers, some with numbers."""
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        parts = [IDENTIFIER_WORDS[j] for j in rng.integers(0, len(IDENTIFIER_WORDS), size=int(rng.integers(2, 6)))]
        if i % 3 == 0:
            parts.insert(int(rng.integers(1, len(parts) + 1)), str(int(rng.integers(0, 3000))))
        style = i % 5
        if style == 0:
            out.append("_".join(parts))
        elif style == 1:
            out.append("".join(p.capitalize() for p in parts))
        elif style == 2:
            out.append("-".join(parts))
        elif style == 3:
            out.append("/".join(parts))
        else:
            out.append("_".join(p.upper() for p in parts))
    return out


class Markov:
    """log P(next | current) of the two models, as one table of ratios."""

    def __init__(self, secrets: list[str], ordinary: list[str], smoothing: float = 0.5):
        self.code = np.full(128, -1, np.int64)
        for i, c in enumerate(ALPHABET):
            self.code[ord(c)] = i
        self.ratio = self._fit(secrets, smoothing) - self._fit(ordinary, smoothing)
        # Neither kind of sample repeats one character, so that repeats (rules, padding) speak for neither.
        same = np.arange(len(ALPHABET))
        self.ratio[same, same] = np.minimum(self.ratio[same, same], 0)
        self.ratio[same[:-1], same[1:]] = np.minimum(self.ratio[same[:-1], same[1:]], 0)  # so do alphabets

    def _fit(self, samples: list[str], smoothing: float) -> np.ndarray:
        n = len(ALPHABET)
        counts = np.full((n + 1, n), smoothing)  # row n: the first character
        for s in samples:
            c = self.code[np.frombuffer(s.encode("ascii", "ignore"), np.uint8) & 127]
            c = c[c >= 0]
            if len(c):
                np.add.at(counts, (np.concatenate([[n], c[:-1]]), c), 1)
        return np.log(counts / counts.sum(axis=1, keepdims=True))

    def ratios(self, token: str) -> np.ndarray:
        """Log-likelihood ratio of each character."""
        c = self.code[np.frombuffer(token.encode("ascii"), np.uint8)]
        return self.ratio[np.concatenate([[len(ALPHABET)], c[:-1]]), c]

    def score(self, token: str) -> float:
        """Mean log-likelihood ratio of a character; above 0: rather random."""
        return float(self.ratios(token).mean())


class Scanner:
    def __init__(self, threshold: float = THRESHOLD, samples: int = 4000, extra_secrets: tuple = (), extra_ordinary: tuple = ()):
        self.threshold = threshold
        self.model = Markov(random_samples(samples) + list(extra_secrets), ordinary_samples(samples) + list(extra_ordinary))

    def base(self, text: str) -> list[tuple[str, int, int]]:
        """(kind, start, end) by start, then kind."""
        out = []
        low = text.lower()
        if any(h in low for h in _ASSIGN_HINTS):
            out += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= LEAST_VALUE]
        if "AKIA" in text:
            out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
        out += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
        return sorted(out, key=_order)

    def parts(self, token: str) -> list[tuple[int, int]]:
        """Where a candidate run is a secret: all of it, or the parts and windows that are, joined where they meet."""
        if token.isdigit() or UUID.fullmatch(token):
            return []
        if self.model.score(token) >= self.threshold:
            return [(0, len(token))]
        found = [m.span() for m in PART.finditer(token) if self.model.score(m.group()) >= self.threshold]
        total = np.concatenate([[0.0], np.cumsum(self.model.ratios(token))])
        means = (total[WINDOW:] - total[:-WINDOW]) / WINDOW
        return merged(found + [(i, i + WINDOW) for i in np.flatnonzero(means >= self.threshold).tolist()])

    def left(self, token: str, beside: bool) -> list[tuple[int, int]]:
        """``parts`` of what is left of a run; a short rest beside an inner base span is a secret or not as a whole."""
        if len(token) >= WINDOW:
            return self.parts(token)
        return [(0, len(token))] if beside and token and self.model.score(token) >= self.threshold else []

    def spans(self, text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
        """Base spans, and all spans: the Markov models add what no base span covers."""
        base = self.base(text)
        added = []
        ends = itertools.accumulate((e for _, _, e in base), max, initial=0)
        cuts = [b for b, end in zip(base, ends) if b[2] > end]  # without spans inside others
        i = 0  # the first cut that may reach into the run
        for m in CANDIDATE.finditer(text):
            while i < len(cuts) and cuts[i][2] <= m.start():
                i += 1
            at, beside = m.start(), False
            for kind, s, e in [*itertools.takewhile(lambda c: c[1] < m.end(), itertools.islice(cuts, i, None)), ("", m.end(), m.end())]:
                inner = kind in KINDS[1:3]
                added += [("markov", at + a, at + b) for a, b in self.left(text[at:s], beside or inner)]
                at, beside = max(at, e), inner
        return base, sorted(base + added, key=_order)

    def digest(self, texts: list[bytes]) -> dict[str, pa.Array]:
        rows = []
        for raw in texts:
            base, every = self.spans(raw.decode("utf-8", "replace"))
            count = [sum(k == kind for k, _, _ in base) for kind in KINDS[:3]]
            rows.append((*count, hashlib.sha256(_line(base).encode()).hexdigest(), _line(every)))
        kinds = {"n_assign": pa.int64(), "n_access": pa.int64(), "n_hex": pa.int64(), "base_sha256": pa.string(), "spans": pa.string()}
        return {k: pa.array(c, t) for (k, t), c in zip(kinds.items(), zip(*rows))}

    def redacted(self, text: str, mark: str) -> str:
        """The text with every span (overlapping ones as one) replaced."""
        out, at = [], 0
        for _, s, e in self.spans(text)[1]:
            if s >= at:
                out += [text[at:s], mark]
            at = max(at, e)
        return "".join([*out, text[at:]]) if out else text


def _order(span: tuple[str, int, int]) -> tuple[int, int]:
    return span[1], KINDS.index(span[0])


def _line(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def fit(docs: DataFrame, texts: int = TEXTS) -> Scanner:
    """A scanner that knows words of ``docs``: of ``texts`` texts at most, drawn by hash, TEXT_WORDS letters-only words each.

    Runs long enough to be candidates are not learned from.
    """
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL")
    n = source.count()
    draw = F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 11)
    some = source.where(draw <= int(min(1.0, 2 * texts / max(1, n)) * (2**53 - 1)))
    words = F.array_distinct(F.regexp_extract_all("text", F.lit(f"(?<![A-Za-z0-9+/_=-])([A-Za-z]{{5,{WINDOW - 1}}})(?![A-Za-z0-9+/_=-])"), F.lit(1)))
    picked = some.select(draw.alias("draw"), F.slice(F.array_sort(F.transform(words, lambda w: F.struct(F.xxhash64(w).alias("h"), w.alias("w")))), 1, TEXT_WORDS)["w"].alias("words"))
    rows = picked.orderBy("draw", F.array_join("words", " ")).limit(texts).collect()
    return Scanner(extra_ordinary=tuple(sorted({w for r in rows for w in r["words"]})))


def scan(docs: DataFrame, scanner: Scanner | None = None) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, by ``scanner`` or one that knows identifiers only."""
    held = docs.sparkSession.sparkContext.broadcast(Scanner() if scanner is None else scanner)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return source.transform(mapped, by_block(lambda texts: held.value.digest(texts)), "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def _numeric(kind: pa.DataType) -> bool:
    return pa.types.is_integer(kind) or pa.types.is_floating(kind)


def redact(docs: DataFrame, mark: str = "[secret]", scanner: Scanner | None = None) -> DataFrame:
    """``docs`` with secrets replaced in ``text`` (and ``n_chars``, if there, where the text changes); null stays null."""

    held = docs.sparkSession.sparkContext.broadcast(Scanner() if scanner is None else scanner)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            old = batch.column("text").to_pylist()
            new = [t if t is None else held.value.redacted(t, mark) for t in old]
            columns = {"text": new}
            if "n_chars" in names and _numeric(batch.column("n_chars").type):
                columns["n_chars"] = [n if a == b else len(b) for n, a, b in zip(batch.column("n_chars").to_pylist(), old, new)]
            for name, values in columns.items():
                i = names.index(name)
                batch = batch.set_column(i, batch.schema.field(i), pa.array(values, batch.column(i).type))
            yield batch

    return docs.transform(mapped, run, docs.schema)
