"""Small vocabulary of scalar and array expressions, rendered as Spark SQL or as DuckDB SQL.

Metrics are written once against it. In Spark the text becomes a Catalyst
column through ``F.expr``, so it stays in generated code; as DuckDB SQL the same
rule can be checked by a second engine.

Patterns are written in the common subset of the regular expression dialects.
``\\s``, ``\\w`` and ``\\b`` mean Unicode spaces, letters, digits and underscores, and
borders between those and others. Engines disagree on them, so that Spark gets
explicit classes; DuckDB, whose borders know ASCII alone, gets texts whose other
characters are replaced by ASCII ones of the same kind where a pattern has borders.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from itertools import count
from re import _parser

SPACE = r"\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
WORD = r"\p{L}\p{N}_"
#: ``SPACE`` as a Java class that most characters leave after two comparisons: a table of small ones, and a range around the others.
JAVA_SPACE = "[" + "".join(rf"\x{{{c:x}}}" for c in [*range(9, 14), *range(0x1C, 0x21), 0x85, 0xA0]) + r"[\x{1680}-\x{3000}&&[\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]]]"
#: Those of ``JAVA_SPACE`` that are neither a blank nor a newline, which few texts hold.
ODD_SPACE = JAVA_SPACE.replace(r"\x{20}", "").replace(r"\x{a}", "")


#: A border of words where lookaround exists, before and after characters of words, and anywhere.
#: Java looks behind by code units unless a letter of two of them stands in the pattern; the one added here is among \p{L} anyway.
BEHIND = WORD + "\U0001d400"
BEGIN, END = rf"(?<![{BEHIND}])", rf"(?![{WORD}])"
BORDER = rf"(?:(?<=[{BEHIND}]){END}|{BEGIN}(?=[{WORD}]))"


def border(before: str, after: str) -> str:
    """What ``\\b`` means between two parts of a pattern; a letter after it is looked for first, which is cheap."""
    if re.match(r"\w", after):
        return f"(?={after[0]}){BEGIN}"
    if after.startswith(r"\w"):
        return BEGIN
    return END if re.search(r"(^|[^\\])\w$|\\w\+?$", before) else BORDER


def portable(pattern: str, borders: bool = False) -> str:
    """The pattern with explicit classes for ``\\s`` and ``\\w``, inside brackets and outside, and lookaround for ``\\b`` if ``borders``."""
    out, inside, i = [], False, 0
    while i < len(pattern):
        two = pattern[i : i + 2]
        if two in (r"\s", r"\w"):
            body = SPACE if two == r"\s" else WORD
            out.append(body if inside else JAVA_SPACE if borders and two == r"\s" else f"[{body}]")
            i += 2
            continue
        if two[0] == "\\":
            out.append(border(pattern[:i], pattern[i + 2 :]) if borders and two == r"\b" else two)
            i += 2
            continue
        if two[0] == "[":
            inside = True
        elif two[0] == "]":
            inside = False
        out.append(two[0])
        i += 1
    return "".join(out)


def required(pattern: str) -> list[frozenset[str]]:
    """Sets of texts of each of which one stands in whatever a pattern matches; none for patterns that Python does not read."""
    try:
        parsed = _parser.parse(pattern)
    except (re.error, OverflowError):
        return []
    return [] if parsed.state.flags & re.IGNORECASE else _required(parsed)


def _required(parts) -> list[frozenset[str]]:
    out, run = [], ""
    for op, value in parts:
        if op is _parser.LITERAL:
            run += chr(value)
            continue
        if run:
            out.append(frozenset([run]))
            run = ""
        if op is _parser.SUBPATTERN:
            out += _required(value[3]) if not (value[1] or value[2]) else []
        elif op in (_parser.MAX_REPEAT, _parser.MIN_REPEAT) and value[0] > 0:
            out += _required(value[2])
        elif op is _parser.IN and len(value) <= 3 and all(kind is _parser.LITERAL for kind, _ in value):
            out.append(frozenset(chr(c) for _, c in value))
        elif op is _parser.BRANCH:
            found = [max(_required(branch), key=_rarity, default=None) for branch in value[1]]
            if None not in found:
                out.append(frozenset().union(*found))
    return out + ([frozenset([run])] if run else [])


def _rarity(texts: frozenset[str]) -> int:
    """How long they are at least; a mark counts as much as three letters."""
    return min(len(t) if t.isalnum() else len(t) + 2 for t in texts)


class Dialect:
    """What both engines write alike."""

    def __init__(self):
        self._names = count()

    def name(self) -> str:
        return f"x{next(self._names)}"

    def let(self, value: str, body: Callable[[str], str]) -> str:
        return body(value)

    def num(self, value: float) -> str:
        return f"CAST({value!r} AS DOUBLE)"

    def lit(self, text: str) -> str:
        raise NotImplementedError

    def ladder(self, x: str, steps: list[tuple[float, float]], rest: float, op: str = "<=") -> str:
        """The value of the first step whose bound x meets."""
        return "CASE " + " ".join(f"WHEN {x} {op} {bound} THEN {self.num(v)}" for bound, v in steps) + f" ELSE {self.num(rest)} END"

    def clamp(self, x: str) -> str:
        return f"greatest({self.num(0.0)}, least({self.num(1.0)}, {x}))"

    def floor0(self, x: str) -> str:
        return f"greatest({self.num(0.0)}, {x})"

    def when(self, condition: str, value: str, rest: str) -> str:
        return f"CASE WHEN {condition} THEN {value} ELSE {rest} END"

    def weight(self, condition: str, value: float) -> str:
        return self.when(condition, self.num(value), self.num(0.0))

    def any_sub(self, s: str, phrases: list[str]) -> str:
        return "(" + " OR ".join(f"contains({s}, {self.lit(p)})" for p in phrases) + ")"

    def count_sub(self, s: str, phrases: list[str]) -> str:
        """How many of the phrases occur."""
        return "(" + " + ".join(f"CAST(contains({s}, {self.lit(p)}) AS INT)" for p in phrases) + ")"

    def any_match(self, s: str, patterns: list[str]) -> str:
        return "(" + " OR ".join(self.matches(s, p) for p in patterns) + ")"

    def count_match(self, s: str, patterns: list[str]) -> str:
        return "(" + " + ".join(f"CAST({self.matches(s, p)} AS INT)" for p in patterns) + ")"

    def occurrences(self, s: str, phrase: str) -> str:
        return f"((length({s}) - length(replace({s}, {self.lit(phrase)}, ''))) / {len(phrase)})"

    def strip(self, s: str) -> str:
        return self.replace(s, rf"^\s+|\s+$", "")

    def words(self, s: str) -> str:
        return self.filter(self.split(s, r"\s+"), lambda x: f"{x} <> ''")

    def sentences(self, s: str, longer_than: int = 0) -> str:
        """Stripped parts between ends of sentences, of more than so many characters."""
        return self.filter(self.map(self.split(s, "[.!?]+"), self.strip), lambda x: f"length({x}) > {longer_than}")

    def lines(self, s: str) -> str:
        return self.split(s, r"\n")

    def squeezed(self, s: str) -> str:
        """Each run of blanks and tabs as one blank."""
        return self.replace(s, r"[ \t]+", " ")

    def if_held(self, s: str, x: str, condition: str) -> str:
        """A condition that is met only where s holds x."""
        return condition

    def says_one(self, s: str, words: str) -> str:
        """Does one of the words, all of at least four letters, digits and underscores, stand whole in s?"""
        return f"{self.size(self.common(self.every(s, r'\w{4,}'), words))} > 0"

    def position(self, s: str, pattern: str) -> str:
        """Characters before the first match (0 also without one)."""
        return f"length({self.first(s, f'(?s)^(.*?)(?:{pattern})')})"

    def one_of(self, s: str, values: list[str]) -> str:
        return f"{s} IN ({', '.join(self.lit(v) for v in values)})"


#: The characters of ``SPACE``.
SPACES = "".join(chr(c) for c in [*range(9, 14), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])


class SparkSql(Dialect):
    def strip(self, s: str) -> str:
        """Goes from both ends, not through the text."""
        return self.trim(s, SPACES)

    def words(self, s: str) -> str:
        """Split at blanks, which takes no pattern, once the other spaces are blanks."""

        def made(x: str) -> str:
            even = self.when(f"rlike({x}, {self.lit(ODD_SPACE)})", f"regexp_replace({x}, {self.lit(JAVA_SPACE)}, ' ')", f"replace({x}, {self.lit(chr(10))}, ' ')")
            return f"array_remove(split({even}, ' ', -1), '')"

        return self.let(s, made)

    def sentences(self, s: str, longer_than: int = 0) -> str:
        """Split at single points, which takes no pattern: the empty parts between neighbouring ends go by their length."""
        parts = f"split(replace(replace({s}, '!', '.'), '?', '.'), {self.lit(chr(92) + '.')}, -1)"
        return self.filter(self.map(parts, self.strip), lambda x: f"length({x}) > {longer_than}")

    def lines(self, s: str) -> str:
        return f"split({s}, {self.lit(chr(10))}, -1)"

    def squeezed(self, s: str) -> str:
        """A blank that stands alone is left, so that most texts need no pattern."""
        return self.when(f"contains({s}, '  ') OR contains({s}, {self.lit(chr(9))})", self.replace(s, r"[ \t]{2,}|\t", " "), s)

    def if_held(self, s: str, x: str, condition: str) -> str:
        return f"contains({s}, {x}) AND ({condition})"

    def says_one(self, s: str, words: str) -> str:
        """Looks for the few words, instead of taking all words from the text."""
        x = self.name()
        return f"exists({words}, {x} -> {self.has_word(s, x)})"

    def lit(self, text: str) -> str:
        return '"' + text.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n") + '"'

    def rx(self, pattern: str) -> str:
        return self.lit("(?d)" + portable(pattern, True))

    def let(self, value: str, body: Callable[[str], str]) -> str:
        """``body`` over a value that is made once, however often it is used."""
        if re.fullmatch(r"\w+", value):
            return body(value)
        x = self.name()
        return f"get(transform(array({value}), {x} -> {body(x)}), 0)"

    def ladder(self, x: str, steps: list[tuple[float, float]], rest: float, op: str = "<=") -> str:
        return self.let(x, lambda v: super(SparkSql, self).ladder(v, steps, rest, op))

    def any_match(self, s: str, patterns: list[str]) -> str:
        return self.let(s, lambda v: super(SparkSql, self).any_match(v, patterns))

    def count_match(self, s: str, patterns: list[str]) -> str:
        return self.let(s, lambda v: super(SparkSql, self).count_match(v, patterns))

    def matches(self, s: str, pattern: str) -> str:
        """A text without what a match must hold is not searched for the pattern, which is far dearer."""
        wanted = sorted((t for t in required(pattern) if _rarity(t) > 1 and len(t) <= 6), key=_rarity, reverse=True)[:3]
        # Whether there is a match does not hang on how far a word goes at its ends.
        shorter = re.sub(r"(?<!\\)\\w\+$", r"\\w", re.sub(r"^\\b\\w\+", r"\\w", pattern))
        held = [self.any_sub(s, sorted(t)) for t in wanted]
        return f"({' AND '.join([*held, f'rlike({s}, {self.rx(shorter)})'])})"

    def first(self, s: str, pattern: str, group: int = 1) -> str:
        return f"regexp_extract({s}, {self.rx(pattern)}, {group})"

    def every(self, s: str, pattern: str, group: int = 0) -> str:
        return f"regexp_extract_all({s}, {self.rx(pattern)}, {group})"

    def replace(self, s: str, pattern: str, by: str) -> str:
        made = f"regexp_replace({s}, {self.rx(pattern)}, {self.lit(by)})"
        held = max(required(pattern.removeprefix("(?i)")), key=_rarity, default=None) if pattern.startswith("(?i)") else None
        return self.when(self.let(f"lower({s})", lambda low: self.any_sub(low, sorted(t.lower() for t in held))), made, s) if held else made

    def split(self, s: str, pattern: str) -> str:
        return f"split({s}, {self.rx(pattern)}, -1)"

    def has_word(self, s: str, word: str) -> str:
        return f"(contains({s}, {word}) AND rlike({s}, {self._whole(word)}))"

    def count_word(self, s: str, word: str) -> str:
        return f"CASE WHEN NOT contains({s}, {word}) THEN 0 ELSE regexp_count({s}, {self._whole(word)}) END"

    def _whole(self, word: str) -> str:
        quoted, end = r"\Q", r"\E"
        return f"concat({self.lit(f'(?={quoted}')}, {word}, {self.lit(f'{end}){BORDER}{quoted}')}, {word}, {self.lit(end + BORDER)})"

    def filter(self, a: str, f: Callable[[str], str]) -> str:
        x = self.name()
        return f"filter({a}, {x} -> {f(x)})"

    def map(self, a: str, f: Callable[[str], str]) -> str:
        x = self.name()
        return f"transform({a}, {x} -> {f(x)})"

    def size(self, a: str) -> str:
        return f"size({a})"

    def at(self, a: str, i: int) -> str:
        return f"get({a}, {i})" if i >= 0 else f"get({a}, size({a}) - {-i})"

    def part(self, a: str, skip: int, drop_last: int = 0) -> str:
        return f"slice({a}, {skip + 1}, greatest(0, size({a}) - {skip + drop_last}))"

    def distinct(self, a: str) -> str:
        return f"array_distinct({a})"

    def common(self, a: str, b: str) -> str:
        return f"array_intersect({a}, {b})"

    def joint(self, a: str, b: str) -> str:
        return f"array_union({a}, {b})"

    def holds(self, a: str, x: str) -> str:
        return f"array_contains({a}, {x})"

    def total(self, a: str) -> str:
        x, y = self.name(), self.name()
        return f"aggregate({a}, CAST(0 AS DOUBLE), ({x}, {y}) -> {x} + {y})"

    def sort(self, a: str) -> str:
        return f"sort_array({a})"

    def repeated(self, a: str, times: int) -> str:
        """Does a value occur at least so often in a sorted array of no nulls? Equal values are neighbours."""
        x, y = self.name(), self.name()
        return f"exists(zip_with({a}, slice({a}, {times}, greatest(0, size({a}) - {times - 1})), ({x}, {y}) -> {x} <=> {y}), {x} -> {x})"

    def literal_list(self, s: str) -> str:
        """A list literal in a string, with single or double quotes; else what stands in single quotes."""
        parsed = f"from_json({s}, 'array<string>', map('allowSingleQuotes', 'true'))"
        x = self.name()
        return f"CASE WHEN {parsed} IS NOT NULL AND NOT exists({parsed}, {x} -> {x} IS NULL) THEN {parsed} ELSE {self.every(s, "'([^']+)'", 1)} END"

    def find(self, s: str, x: str) -> str:
        return f"(locate({x}, {s}) - 1)"

    def trim(self, s: str, characters: str) -> str:
        return f"trim(BOTH {self.lit(characters)} FROM {s})"

    def text_array(self, values: list[str]) -> str:
        return f"array({', '.join(self.lit(v) for v in values)})"


class DuckSql(Dialect):
    def lit(self, text: str) -> str:
        if "\n" in text:
            return "(" + " || chr(10) || ".join(self.lit(part) for part in text.split("\n")) + ")"
        return "'" + text.replace("'", "''") + "'"

    def rx(self, pattern: str) -> str:
        return "'" + portable(pattern).replace("'", "''") + "'"

    def ascii(self, s: str) -> str:
        """Other spaces as a blank, other letters and digits as an underscore, what is neither as a control character."""
        for pattern, by in ((r"[\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]", "' '"), (r"[^\p{L}\p{N}\x{0}-\x{7f}]", "chr(1)"), (r"[^\x{0}-\x{7f}]", "'_'")):
            s = f"regexp_replace({s}, '{pattern}', {by}, 'g')"
        return s

    def matches(self, s: str, pattern: str) -> str:
        return f"regexp_matches({self.ascii(s) if r'\b' in pattern else s}, {self.rx(pattern)})"

    def first(self, s: str, pattern: str, group: int = 1) -> str:
        return f"regexp_extract({s}, {self.rx(pattern)}, {group})"

    def every(self, s: str, pattern: str, group: int = 0) -> str:
        return f"regexp_extract_all({s}, {self.rx(pattern)}, {group})"

    def replace(self, s: str, pattern: str, by: str) -> str:
        return f"regexp_replace({self.ascii(s) if r'\b' in pattern else s}, {self.rx(pattern)}, {self.lit(by)}, 'g')"

    def split(self, s: str, pattern: str) -> str:
        return f"regexp_split_to_array({s}, {self.rx(pattern)})"

    def has_word(self, s: str, word: str) -> str:
        return f"(CASE WHEN {word} = '' THEN regexp_matches({s}, '[{WORD}]') ELSE regexp_matches({s}, {self._whole(word)}) END)"

    def count_word(self, s: str, word: str) -> str:
        twice = lambda x: rf"regexp_replace({x}, '([^{WORD}])', '\1\1', 'g')"  # noqa: E731 neighbours then share no border
        return f"len(regexp_extract_all({twice(s)}, {self._whole(twice(word))}))"

    def _whole(self, word: str) -> str:
        """The word with the characters beside it, of the other kind than its ends."""
        begin = f"CASE WHEN regexp_matches({word}, '^[{WORD}]') THEN '(?:^|[^{WORD}])' ELSE '[{WORD}]' END"
        end = f"CASE WHEN regexp_matches({word}, '[{WORD}]$') THEN '(?:[^{WORD}]|$)' ELSE '[{WORD}]' END"
        return f"{begin} || regexp_escape({word}) || {end}"

    def filter(self, a: str, f: Callable[[str], str]) -> str:
        x = self.name()
        return f"list_filter({a}, lambda {x}: {f(x)})"

    def map(self, a: str, f: Callable[[str], str]) -> str:
        x = self.name()
        return f"list_transform({a}, lambda {x}: {f(x)})"

    def size(self, a: str) -> str:
        return f"len({a})"

    def at(self, a: str, i: int) -> str:
        return f"list_extract({a}, {i + 1 if i >= 0 else i})"

    def part(self, a: str, skip: int, drop_last: int = 0) -> str:
        return f"list_slice({a}, {skip + 1}, len({a}) - {drop_last})"

    def distinct(self, a: str) -> str:
        return f"list_distinct({a})"

    def common(self, a: str, b: str) -> str:
        return f"list_intersect({a}, {b})"

    def joint(self, a: str, b: str) -> str:
        return f"list_distinct(list_concat({a}, {b}))"

    def holds(self, a: str, x: str) -> str:
        return f"list_contains({a}, {x})"

    def total(self, a: str) -> str:
        return f"coalesce(list_sum({a}), CAST(0 AS DOUBLE))"

    def sort(self, a: str) -> str:
        return f"list_sort({a})"

    def repeated(self, a: str, times: int) -> str:
        x = self.name()
        return f"(len(list_filter(range(1, len({a}) - {times - 2}), lambda {x}: list_extract({a}, {x}) = list_extract({a}, {x} + {times - 1}))) > 0)"

    def literal_list(self, s: str) -> str:
        return self.every(s, "'([^']+)'", 1)

    def find(self, s: str, x: str) -> str:
        return f"(instr({s}, {x}) - 1)"

    def trim(self, s: str, characters: str) -> str:
        return f"trim({s}, {self.lit(characters)})"

    def text_array(self, values: list[str]) -> str:
        return f"[{', '.join(self.lit(v) for v in values)}]::VARCHAR[]"
