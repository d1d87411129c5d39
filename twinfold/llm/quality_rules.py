"""Quality rules as a short-circuit cascade, with DataFrame functions only.

Every rule is a Boolean column that is true for documents to reject. On a bounded sample (``SAMPLE_ROWS`` rows at most) each
rule is run alone: its time is its cost, the share it rejects its selectivity. The cascade asks the rules in the order of
rejections per second, nested so that a later rule is only evaluated where all earlier ones let the document pass. The order changes
the time, never the verdict: a document is kept if no rule rejects it.

Defined results: a null or empty text has no words, and every count is 0. A rule that gives null does not reject. Repeated rows
each give a row. Other columns are not looked at, whatever their names.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinfold.llm.common import WORD
from twinfold.session import stage

SAMPLE_ROWS = 2_000
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
SYMBOLS = "#*$%&|<>"
WINDOW = 3


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once."""
    return F.transform(F.array(value), body)[0]


def _repeat_words(words: Column) -> Column:
    """Words inside 3-word windows that occur twice or more.

    Each window is one number: the upper bits of its hash, and its place in the lower bits. After sorting, equal windows are
    neighbours; their words are compared too, so that equal hashes alone do not count.
    """

    def places(size: Column, packed: Column) -> Column:
        low = size - 1
        same_words = lambda p, q: F.forall(
            F.sequence(F.lit(0), F.lit(WINDOW - 1)), lambda k: F.get(words, (p + k).cast("int")) == F.get(words, (q + k).cast("int"))
        )
        same = lambda x, y: (x.bitwiseAND(-size) == y.bitwiseAND(-size)) & same_words(x.bitwiseAND(low), y.bitwiseAND(low))
        at = lambda i: F.get(packed, i)
        repeated = F.transform(
            packed,
            lambda x, i: F.when(
                F.coalesce(same(x, at(i + 1)), F.lit(False)) | ((i > 0) & F.coalesce(same(x, at(i - 1)), F.lit(False))),
                x.bitwiseAND(low),
            ),
        )
        return F.sort_array(F.array_compact(repeated))

    def covered(starts: Column) -> Column:
        state = lambda upto, total: F.struct(upto.cast("bigint").alias("upto"), total.cast("bigint").alias("total"))
        return F.aggregate(
            starts, state(F.lit(0), F.lit(0)),
            lambda s, p: state(p + WINDOW, s["total"] + p + WINDOW - F.greatest(p, s["upto"])),
            lambda s: s["total"],
        )

    n = F.size(words)
    size = F.pow(F.lit(2.0), F.ceil(F.log2(n.cast("double")))).cast("bigint")  # the least power of two that is not below n
    window = lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(WINDOW)])
    packed = lambda m: F.sort_array(
        F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: window(i).bitwiseAND(-m).bitwiseOR(i.cast("bigint")))
    )
    total = _let(size, lambda m: _let(packed(m), lambda s: covered(places(m, s))))
    return F.when(n > WINDOW, total).otherwise(F.lit(0).cast("bigint"))


def text_counts(docs: DataFrame) -> DataFrame:
    """doc_id, text, and the counts n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words."""
    whole = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    split = whole.select(
        "doc_id", "text", F.regexp_extract_all("text", F.lit(f"({WORD})"), F.lit(1)).alias("words"),
        F.filter(F.split("text", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
    )
    count = lambda column: column.cast("bigint")
    return split.select(
        "doc_id", "text", count(F.size("words")).alias("n_words"),
        count(F.length(F.regexp_replace("text", r"[\x20\x09-\x0D]+", ""))).alias("word_chars"),
        count(F.length(F.regexp_replace("text", f"[^{SYMBOLS}]+", ""))).alias("n_symbols"),
        count(F.size("lines")).alias("n_lines"),
        count(F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
        _repeat_words(F.col("words")).alias("n_repeat_words"),
    )


@dataclass(frozen=True)
class Rule:
    name: str
    reject: str  # SQL over the columns of text_counts


RULES = (
    Rule("symbols", "10 * n_symbols > word_chars"),
    Rule("repeated_lines", "2 * n_dup_lines > n_lines"),
    Rule("short_words", "word_chars < 2 * n_words"),
    Rule("long_words", "word_chars > 20 * n_words"),
    Rule("capitals", "2 * length(regexp_replace(text, '[^A-Z]+', '')) > word_chars"),
    Rule("marks", "3 * length(regexp_replace(text, '[^!-/:-@\\\\[-`{-~]+', '')) > word_chars"),
    Rule("digits", "2 * length(regexp_replace(text, '[^0-9]+', '')) > word_chars"),
)


#: Rows on which each rule is timed, how often, and the least time that a rule is taken to need.
TIMED_ROWS, TIMED_ROUNDS, LEAST_SECONDS = 20_000, 3, 2e-3

#: Characters that the repeated rows hold at most, or the sample once where it holds more.
TIMED_CHARS = 20_000_000


def bounded_sample(docs: DataFrame, rows: int = SAMPLE_ROWS, seed: int = 7) -> DataFrame:
    """About ``rows`` rows, and never more, from all over the table; written once."""
    total = docs.count()
    part = docs if total <= rows else docs.sample(min(1.0, 1.2 * rows / total), seed)
    return stage(part.limit(rows), "sample")


def measured_order(
    counts: DataFrame, rules: tuple[Rule, ...] = RULES, rows: int = TIMED_ROWS, rounds: int = TIMED_ROUNDS
) -> list[tuple[Rule, float, float]]:
    """(rule, seconds for ``rows`` rows, share rejected) in the order of the cascade; ``counts`` is a sample with the rules' columns.

    A job costs more than a rule does on a small sample, so each row is judged several times over, about ``rows`` in all, the rules take turns
    in ``rounds``, and the shortest time of each counts, less that of a job that judges nothing. What a rule reads from
    the counts costs it nothing: every document needs them anyway.
    """
    held, chars = counts.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    times = max(1, min(-(-rows // max(held, 1)), TIMED_CHARS // max(chars, 1)))
    many = counts.withColumn("_again", F.explode(F.sequence(F.lit(1), F.lit(times))))

    def run(condition: str) -> tuple[float, float]:
        start = time.perf_counter()
        total, hit = many.agg(F.count(F.lit(1)), F.count_if(F.expr(condition))).first()
        return time.perf_counter() - start, (hit / total if total else 0.0)

    nothing = "n_words < 0"
    asked = [nothing, *[r.reject for r in rules]]
    seconds = {condition: float("inf") for condition in asked}
    shares = {}
    for turn in range(rounds + 1):  # the first turn pays for compilation
        for condition in asked:
            took, shares[condition] = run(condition)
            if turn:
                seconds[condition] = min(seconds[condition], took)
    measured = [(r, max(seconds[r.reject] - seconds[nothing], LEAST_SECONDS), shares[r.reject]) for r in rules]
    return sorted(measured, key=lambda m: -m[2] / m[1])


def cascade(rules: list[Rule]) -> Column:
    """True where no rule rejects; each rule is only asked where those before it passed."""
    verdict = F.lit(True)
    for rule in reversed(rules):
        verdict = F.when(F.expr(rule.reject), F.lit(False)).otherwise(verdict)
    return verdict


def judged(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The counts of every document with ``base_failed`` and ``kept``."""
    counts = text_counts(docs)
    sample = stage(text_counts(bounded_sample(docs.select("doc_id", "text"))), "counted")
    order = [rule for rule, _, _ in measured_order(sample, rules)]
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    base = counts.withColumn("base_failed", failed)
    return base.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        F.when(F.col("base_failed"), F.lit(False)).otherwise(cascade(order)).alias("kept"),
    )
