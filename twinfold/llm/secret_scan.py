"""Secret scans over a trigram inverted index, with DataFrame functions only.

From each rule's regular expression a Boolean query of trigrams is derived: an OR of sets, each of which has to occur in a text that
matches. The index posts every document under those trigrams of the rules that occur in its lower-cased text; the
postings of a document are brought together as bits, and a rule's candidates are the documents that hold one of its sets in
full. Only candidates are run through the rule's expression. A rule without mandatory trigrams scans all documents.

A match of a rule counts if its group ``measured`` has at least ``least`` characters; a match that fails is dropped, and the search goes
on behind it. Offsets are code points, end exclusive.

Defined results: a null or empty text has no spans. Documents that share a doc_id (null included) share candidates, never spans:
each row is verified by itself. Columns other than doc_id and text are handed through only where asked for.
"""

from __future__ import annotations

import re._constants as rc
import re._parser as rp
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinfold.session import stage

BITS = 62  # trigrams per mask
MAX_CHOICES = 8  # a class of more characters is not spelled out


@dataclass(frozen=True)
class Rule:
    kind: str
    regex: str
    measured: int = 0  # the group whose length counts; 0 is the whole match
    least: int = 1


#: What may stand between the lines of a key: its headers, in which no two hyphens meet; base64, line ends (real or spelled out) and quoting up to the END line; or, where
#: that line is missing, whole lines of base64, and runs of it that are padded or have 16 characters. All possessive: no backtracking, no deep stack in Java.
_KEY_HEADERS = r"""(?:(?:[\x20\x09-\x0D]|\\+[nrt])*+[A-Z][A-Za-z0-9]*+-[A-Za-z0-9-]*+:\x20[^\r\n\\-]*+(?:-[^\r\n\\-]++)*+(?=[\r\n\\]))*+"""
_KEY_TO_END = r"""[A-Za-z0-9+/=\x20\x09-\x0D\\"'`,#>*|]*+-----END\x20[A-Z\x20]*PRIVATE\x20KEY-----"""
_KEY_LINES = (
    r"""(?:(?:[\x20\t"'`]|[\r\n]|\\+[nrt])*+[A-Za-z0-9+/]{16,}+=*+"""
    r"""|[\x20\t"'`+,#>*|]*+(?:[\r\n]|\\+[nr])(?:[\x20\t"'`#>*|]|[\r\n]|\\+[nrt])*+[A-Za-z0-9+/]++(?:=++|(?=[\x20\t"'`,]*+(?:[\r\n\\]|$))))*+"""
)

#: Kinds, expressions and lengths that decide results; the first three are the base.
RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]+", 0, 24),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 0, 20),
    Rule("google", r"AIza[A-Za-z0-9_-]+", 0, 39),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]+", 0, 24),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 40),
    Rule("private_key", rf"-----BEGIN [A-Z ]*PRIVATE KEY-----{_KEY_HEADERS}(?:{_KEY_TO_END}|{_KEY_LINES})"),
)
BASE = 3

Literals = frozenset[str]


def _literal_sets(parsed) -> list[tuple[Literals, str, bool]]:
    """Alternatives of a parsed expression: (literals that must occur, the literal run at its end, whether all of it is that run)."""
    found: list[tuple[Literals, str, bool]] = [(frozenset(), "", True)]

    def follow(options: list[tuple[Literals, str, bool]]) -> None:
        nonlocal found
        joined = []
        for literals, run, exact in found:
            for more, tail, whole in options:
                if whole:
                    joined.append((literals | more, run + tail, exact))
                else:  # a gap: what has been gathered so far ends here
                    joined.append((literals | more | ({run} if run else frozenset()), tail, False))
        found = joined

    for op, value in parsed:
        if op is rc.LITERAL:
            follow([(frozenset(), chr(value).lower(), True)])
        elif op is rc.SUBPATTERN:
            follow(_literal_sets(value[3]))
        elif op is rc.BRANCH:
            follow([option for branch in value[1] for option in _literal_sets(branch)])
        elif op is rc.IN and all(k is rc.LITERAL for k, _ in value) and len(value) <= MAX_CHOICES:
            follow([(frozenset(), c, True) for c in sorted({chr(v).lower() for _, v in value})])
        elif op in (rc.MAX_REPEAT, rc.MIN_REPEAT) and value[0] == value[1] == 1:
            follow(_literal_sets(value[2]))
        else:  # classes, optional parts and repeats ask for nothing
            follow([(frozenset(), "", False)])
    return found


def trigram_query(regex: str) -> list[frozenset[str]] | None:
    """The sets of lower-cased trigrams of which one occurs in full in every text that matches; None if any text may match."""
    sets = []
    for literals, run, _ in _literal_sets(rp.parse(regex)):
        grams = frozenset(t[i : i + 3] for t in {*literals, run} for i in range(len(t) - 2))
        if not grams:
            return None
        sets.append(grams)
    return [s for s in dict.fromkeys(sets) if not any(other < s for other in sets)]


def vocabulary(rules: tuple[Rule, ...]) -> list[str]:
    return sorted({g for r in rules for s in trigram_query(r.regex) or [] for g in s})


def postings(docs: DataFrame, grams: list[str]) -> DataFrame:
    """(gram, doc_id): a document under the number of each trigram that its lower-cased text holds."""
    low = docs.select("doc_id", F.lower("text").alias("low"))
    held = F.array(*[F.when(F.contains("low", F.lit(g)), F.lit(i)) for i, g in enumerate(grams)])
    return low.select("doc_id", F.explode(F.array_compact(held)).alias("gram"))


def candidates(index: DataFrame, rules: tuple[Rule, ...], grams: list[str]) -> DataFrame:
    """(doc_id, rules): the numbers of the rules whose query the document's postings answer."""
    number = {g: i for i, g in enumerate(grams)}
    masks = range((len(grams) + BITS - 1) // BITS)
    bit = F.expr(f"shiftleft(1L, cast(gram % {BITS} as int))")
    held = index.groupBy("doc_id").agg(
        *[F.bit_or(F.when(F.floor(F.col("gram") / BITS) == m, bit).otherwise(F.lit(0).cast("bigint"))).alias(f"m{m}") for m in masks]
    )

    def holds(grams_of_set: frozenset[str]) -> Column:
        needed = [sum(1 << (number[g] % BITS) for g in grams_of_set if number[g] // BITS == m) for m in masks]
        tests = [F.col(f"m{m}").bitwiseAND(F.lit(n)) == F.lit(n) for m, n in zip(masks, needed) if n]
        return reduce(lambda a, b: a & b, tests)

    flags = [
        F.when(reduce(lambda a, b: a | b, [holds(s) for s in query]), F.lit(i))
        for i, query in enumerate(trigram_query(r.regex) for r in rules) if query is not None
    ]
    return held.select("doc_id", F.array_compact(F.array(*flags)).alias("rules")).where(F.size("rules") > 0)


_SPAN = "array<struct<start:bigint,rank:int,end:bigint>>"


def _spans(text: Column, rule: Rule, rank: int) -> Column:
    """The spans of one rule in one text, by the lengths of its matches and of the pieces between them."""
    state = lambda at, spans: F.struct(at.cast("bigint").alias("at"), spans.cast(_SPAN).alias("spans"))
    measured = lambda match: F.length(match if rule.measured == 0 else F.regexp_extract(match, rule.regex, rule.measured))

    def step(acc: Column, pair: Column) -> Column:
        start = acc["at"] + F.length(pair["gap"])
        end = start + F.length(pair["match"])
        span = F.struct(start.cast("bigint").alias("start"), F.lit(rank).alias("rank"), end.cast("bigint").alias("end"))
        return state(end, F.when(measured(pair["match"]) >= rule.least, F.array_append(acc["spans"], span)).otherwise(acc["spans"]))

    def located(matches: Column) -> Column:
        gaps = F.slice(F.split(text, rule.regex, -1), F.lit(1), F.size(matches))
        pairs = F.zip_with(gaps, matches, lambda g, m: F.struct(g.alias("gap"), m.alias("match")))
        return F.aggregate(pairs, state(F.lit(0), F.array()), step, lambda s: s["spans"])

    none = F.array().cast(_SPAN)
    every = lambda matches: F.when(F.exists(matches, lambda m: measured(m) >= rule.least), located(matches)).otherwise(none)
    return F.transform(F.array(F.regexp_extract_all(text, F.lit(rule.regex), F.lit(0))), every)[0]


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, ``keep`` and ``spans``: array of (start, rank, end), ordered, rank being the rule's number."""
    columns = list(dict.fromkeys(["doc_id", "text", *keep]))
    whole = docs.select(*columns)
    grams = vocabulary(rules)
    index = stage(postings(whole, grams), "postings")
    found = candidates(index, rules, grams).select(F.col("doc_id").alias("_doc"), F.col("rules").alias("_rules"))
    met = whole.join(found, F.col("doc_id").eqNullSafe(F.col("_doc")), "left")
    text = F.coalesce(F.col("text"), F.lit(""))
    each = []
    for rank, rule in enumerate(rules):
        spans = _spans(text, rule, rank)
        if trigram_query(rule.regex) is not None:
            asked = F.coalesce(F.array_contains("_rules", rank), F.lit(False))
            spans = F.when(asked, spans).otherwise(F.array().cast(_SPAN))
        each.append(spans)
    return met.select(*dict.fromkeys(["doc_id", *keep]), F.sort_array(F.flatten(F.array(*each))).alias("spans"))


def listing(spans: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """kind:start:end of each span, comma-joined."""
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["rank"] + 1), s["start"], s["end"])), ",")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans; one row per document."""
    found = scan(docs)
    base = F.filter("spans", lambda s: s["rank"] < BASE)
    count = lambda rank: F.size(F.filter("spans", lambda s: s["rank"] == rank)).cast("bigint")
    return found.select(
        "doc_id", *[count(i).alias(f"n_{RULES[i].kind}") for i in range(BASE)],
        F.sha2(listing(base), 256).alias("base_sha256"), listing(F.col("spans")).alias("spans"),
    )


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """``text`` with every stretch of overlapping or touching spans replaced by ``mark``."""
    state = lambda at, out: F.struct(at.cast("bigint").alias("at"), out.alias("out"))
    cut = lambda start, length: F.substring(text, (start + 1).cast("int"), length.cast("int"))

    def step(acc: Column, s: Column) -> Column:
        fresh = state(s["end"], F.concat(acc["out"], cut(acc["at"], s["start"] - acc["at"]), F.lit(mark)))
        overlap = state(F.greatest(acc["at"], s["end"]), acc["out"])
        return F.when((s["start"] <= acc["at"]) & (acc["out"] != ""), overlap).otherwise(fresh)

    rest = lambda acc: F.concat(acc["out"], cut(acc["at"], F.length(text).cast("bigint") - acc["at"]))
    return F.when(F.size(spans) == 0, text).otherwise(F.aggregate(spans, state(F.lit(0), F.lit("")), step, rest))
