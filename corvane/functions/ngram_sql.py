"""BLEU and ROUGE of whole columns: counts by Arrow batch (``ngram_batch``), scores from them as expressions of the JVM.

Each response is counted in its own task; no word or n-gram is shuffled, so that frequent ones can't gather in a task.
Porter's rules are also one expression, in SQL that other engines read too, over a table of words.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .core_metrics import with_prepared
from .ngram import Porter
from .ngram_batch import COUNTS, of_batch

# ---- stems ----------------------------------------------------------------------------------------------------------


class Stems:
    """Porter's steps as SQL. ``spark``: for Spark, else for DuckDB."""

    def __init__(self, spark: bool):
        self.spark = spark

    def let(self, value: str, name: str, body: str) -> str:
        """``body`` with ``name`` for a value that is made once."""
        return f"transform(array({value}), {name} -> {body})[0]" if self.spark else f"list_transform([{value}], lambda {name}: {body})[1]"

    def ends(self, word: str, *suffixes: str) -> str:
        function = "endswith" if self.spark else "suffix"
        return "(" + " OR ".join(f"{function}({word}, '{s}')" for s in suffixes) + ")"

    @staticmethod
    def cut(word: str, n: int) -> str:
        return f"left({word}, length({word}) - {n})"

    @staticmethod
    def some(kinds: str) -> str:
        """The measure is above 0."""
        return f"contains({kinds}, 'VC')"

    @staticmethod
    def more(kinds: str) -> str:
        """The measure is above 1."""
        return f"{kinds} LIKE '%VC%VC%'"

    def short_end(self, word: str, kinds: str) -> str:
        return f"({self.ends(kinds, 'CVC')} AND right({word}, 1) NOT IN ('w', 'x', 'y') OR {kinds} = 'VC')"

    def kinds(self, word: str) -> str:
        """V or C for each letter; y is a vowel after a consonant."""
        others = "bcdfghjklmnpqrstvwxz0123456789"
        plain = f"translate({word}, 'aeiou{others}', '{'V' * 5}{'C' * len(others)}')"
        solved = "CASE WHEN left(p, 1) = 'y' THEN concat('C', substr(p, 2)) ELSE p END"
        for _ in range(4):
            solved = f"replace(replace({solved}, 'Cy', 'CV'), 'Vy', 'VC')"
        return self.let(plain, "p", f"CASE WHEN contains(p, 'y') THEN {solved} ELSE p END")

    def steps(self) -> list:
        ends, cut, some, more, short = self.ends, self.cut, self.some, self.more, self.short_end

        def plural(w: str, k: str) -> str:
            return f"CASE WHEN {ends(w, 'sses')} THEN {cut(w, 2)} WHEN {ends(w, 'ies')} THEN CASE WHEN length({w}) = 4 THEN {cut(w, 1)} ELSE {cut(w, 2)} END WHEN {ends(w, 's')} AND NOT {ends(w, 'ss')} THEN {cut(w, 1)} ELSE {w} END"

        def past(w: str, k: str) -> str:
            double = "length(x) > 1 AND right(x, 1) = left(right(x, 2), 1) AND right(kx, 1) = 'C'"
            mended = f"CASE WHEN {ends('x', 'at', 'bl', 'iz')} THEN concat(x, 'e') WHEN {double} THEN CASE WHEN right(x, 1) IN ('l', 's', 'z') THEN x ELSE {cut('x', 1)} END WHEN {some('kx')} AND NOT {more('kx')} AND {short('x', 'kx')} THEN concat(x, 'e') ELSE x END"
            after = lambda n: self.let(cut(w, n), "x", self.let(cut(k, n), "kx", mended))
            return f"CASE WHEN {ends(w, 'ied')} THEN CASE WHEN length({w}) = 4 THEN {cut(w, 1)} ELSE {cut(w, 2)} END WHEN {ends(w, 'eed')} THEN CASE WHEN {some(cut(k, 3))} THEN {cut(w, 1)} ELSE {w} END WHEN {ends(w, 'ed')} AND contains({cut(k, 2)}, 'V') THEN {after(2)} WHEN {ends(w, 'ing')} AND contains({cut(k, 3)}, 'V') THEN {after(3)} ELSE {w} END"

        def final_y(w: str, k: str) -> str:
            return f"CASE WHEN {ends(w, 'y')} AND length({w}) > 2 AND right({cut(k, 1)}, 1) = 'C' THEN concat({cut(w, 1)}, 'i') ELSE {w} END"

        def ally(w: str, k: str) -> str:
            return f"CASE WHEN {ends(w, 'alli')} AND {some(cut(k, 4))} THEN {cut(w, 2)} ELSE {w} END"

        def replaced(w: str, k: str, pairs: list[tuple[str, str]], otherwise: str) -> str:
            whens = [f"WHEN {ends(w, s)} THEN CASE WHEN {some(cut(k, len(s)))} THEN concat({cut(w, len(s))}, '{by}') ELSE {w} END" for s, by in sorted(pairs, key=lambda p: -len(p[0]))]
            return f"CASE {' '.join(whens)} ELSE {otherwise} END"

        def double(w: str, k: str) -> str:
            return replaced(w, k, Porter.STEP2, f"CASE WHEN {ends(w, 'logi')} AND {some(cut(k, 3))} THEN {cut(w, 1)} ELSE {w} END")

        def derived(w: str, k: str) -> str:
            return replaced(w, k, Porter.STEP3, w)

        def suffix(w: str, k: str) -> str:
            whens = []
            for s in sorted(Porter.STEP4, key=len, reverse=True):
                right_before = f" AND right({cut(w, 3)}, 1) IN ('s', 't')" if s == "ion" else ""
                whens.append(f"WHEN {ends(w, s)} THEN CASE WHEN {more(cut(k, len(s)))}{right_before} THEN {cut(w, len(s))} ELSE {w} END")
            return f"CASE {' '.join(whens)} ELSE {w} END"

        def final_e(w: str, k: str) -> str:
            return f"CASE WHEN {ends(w, 'e')} AND ({more(cut(k, 1))} OR {some(cut(k, 1))} AND NOT {short(cut(w, 1), cut(k, 1))}) THEN {cut(w, 1)} ELSE {w} END"

        def final_l(w: str, k: str) -> str:
            return f"CASE WHEN {ends(w, 'll')} AND {more(cut(k, 1))} THEN {cut(w, 1)} ELSE {w} END"

        return [plural, past, final_y, ally, double, derived, suffix, final_e, final_l]

    def stem(self, word: str) -> str:
        """SQL of a token's stem, if it has more than three letters; tokens hold a-z and 0-9."""
        steps = self.steps()
        # Few suffixes but those of step 1 end in these letters; what can't change is passed on.
        body = f"w{len(steps)}"
        for i in range(len(steps) - 1, -1, -1):
            w, k = f"w{i}", f"k{i}"
            made = self.let(self.kinds(w), k, steps[i](w, k)) if i else steps[i](w, k)
            body = self.let(made, f"w{i + 1}", body)
        irregular = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in Porter.IRREGULAR.items())
        return self.let(word, "w0", f"CASE WHEN length(w0) <= 3 THEN w0 ELSE coalesce(CASE w0 {irregular} END, {body}) END")


# ---- scores ---------------------------------------------------------------------------------------------------------


def counts(with_subsequence: bool) -> Column:
    """Over the prepared ok, r and e: what the metrics read, as one struct."""

    def of_columns(ok: pa.Array, r: pa.Array, e: pa.Array) -> pa.Array:
        return of_batch(ok, r, e, with_subsequence)

    return F.arrow_udf(of_columns, ", ".join(f"{c} int" for c in COUNTS))("ok", "r", "e")


def _guarded(value: Column) -> Column:
    r, e = F.col("r"), F.col("e")
    return F.when(~F.col("ok"), 0.0).when((r == "") & (e == ""), 1.0).when((r == "") | (e == ""), 0.0).otherwise(value)


def bleu() -> Column:
    n, m = F.col("grams.n_a"), F.col("grams.n_b")
    total, zeros = F.lit(0.0), F.lit(0)
    for k in range(1, 5):
        places, hits = n - k + 1, F.col(f"grams.h{k}")
        zeros = zeros + F.when((places > 0) & (hits == 0), 1).otherwise(0)
        # A count of zero is smoothed by a half, a quarter and so on.
        total = total + F.when(places <= 0, 0.0).when(hits > 0, F.log(hits / places)).otherwise(-F.log(F.pow(F.lit(2.0), zeros) * places))
    orders = F.least(n, F.lit(4))
    any_hit = F.col("grams.h1") + F.col("grams.h2") + F.col("grams.h3") + F.col("grams.h4") > 0
    brevity = F.least(F.lit(0.0), 1 - m / F.greatest(n, F.lit(1)))
    return _guarded(F.when(any_hit, F.exp(brevity + total / F.greatest(orders, F.lit(1)))).otherwise(0.0))


def rouge(n: int) -> Column:
    """F of stems or of pairs of them."""
    sizes = [F.greatest(F.col(f"grams.{c}") - (n - 1), F.lit(0)) for c in ("n_sa", "n_sb")]
    return _guarded(2 * F.col(f"grams.r{n}") / F.greatest(sizes[0] + sizes[1], F.lit(1)))


def rouge_l() -> Column:
    return _guarded(2 * F.col("grams.rl") / F.greatest(F.col("grams.n_sa") + F.col("grams.n_sb"), F.lit(1)))


def with_ngram_metrics(prepared: DataFrame, with_subsequence: bool = True) -> tuple[DataFrame, dict[str, Column]]:
    """``prepared`` (ok, r, e) with what the metrics read, and the metrics."""
    out = {"bleu": bleu(), "rouge1_f": rouge(1), "rouge2_f": rouge(2)} | ({"rougeL_f": rouge_l()} if with_subsequence else {})
    return prepared.withColumn("grams", counts(with_subsequence)), out


def ngram_scores(responses: DataFrame, keys: list[str], with_subsequence: bool = True) -> DataFrame:
    """keys, bleu, rouge1_f, rouge2_f and, unless it is left out, rougeL_f."""
    df, metrics = with_ngram_metrics(with_prepared(responses, keys), with_subsequence)
    return df.select("k.*", *[c.alias(m) for m, c in metrics.items()])
