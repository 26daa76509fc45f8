"""Quality rules as a short-circuit cascade, in DataFrame functions only.

Every rule is a boolean expression ("rejects") over counts of one text.  Before the
pass, each rule's cost (seconds) and selectivity (share rejected) are measured on a
bounded sample of the whole table, and the rules are ordered by rejection per cost.  The cascade is one
``CASE`` expression: Spark evaluates its branches in order and stops at the first
that holds, so a text that a cheap rule rejects never pays for the dear ones.  The
order changes the cost and never the verdict.

All work stays within a row (array functions): no shuffle, no join, and memory is
bounded by the longest text.  Repeated five-word windows are found by hashing the
windows; only a text whose windows are not all distinct pays for the sort that
locates them.

Defined results: a null or empty text has no words and fails ``base``; extra columns
are kept (``filter_quality``) or ignored (``quality_table``); repeated rows give
repeated results; an empty table gives an empty result.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty, words_of

WINDOW = 5
SYMBOLS = "[#*$%&|<>]"


def n_symbols(text: Column) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(SYMBOLS), F.lit(0))).cast("long")


def n_dup_lines(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return (F.size(lines) - F.size(F.array_distinct(lines))).cast("long")


def word_chars(words: Column) -> Column:
    return F.length(F.array_join(words, "")).cast("long")


def window_hashes(words: Column) -> Column:
    """A hash for each run of WINDOW words, in order of position."""
    n = F.size(words) - (WINDOW - 1)
    return F.when(n >= 1, F.transform(F.sequence(F.lit(1), n), lambda i: F.xxhash64(F.slice(words, i, WINDOW)))).otherwise(F.array().cast("array<bigint>"))


def n_repeat_words(windows: Column) -> Column:
    """Words inside windows that occur twice or more in the text."""
    pairs = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    # An array of one element binds a value to a name inside a single expression.
    bound = F.transform(F.array(pairs), lambda p: F.transform(F.array(F.filter(p, lambda x, k: ((k > 0) & (F.get(p, k - 1)["h"] == x["h"])) | ((k < F.size(p) - 1) & (F.get(p, k + 1)["h"] == x["h"])))), lambda q: _covered(F.array_sort(F.transform(q, lambda x: x["i"])))))
    return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0).cast("long")).otherwise(F.flatten(bound)[0])


def _covered(starts: Column) -> Column:
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-1).alias("end"))
    return F.aggregate(starts, zero, lambda a, i: F.struct((a["n"] + i + WINDOW - F.greatest(i, a["end"])).alias("n"), (i + WINDOW).alias("end")), lambda a: a["n"])


@dataclass(frozen=True)
class Rule:
    """``rejects`` takes the columns named in ``needs`` and says which texts go."""

    name: str
    rejects: Callable[[Column], Column]


def _once(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f(value)`` with ``value`` evaluated once, and only where the branch is reached."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _n(words: Column) -> Column:
    return F.size(words).cast("long")


#: Each rule sees a struct with ``text`` and ``words``.
RULES = (
    Rule("few_words", lambda d: _n(d["words"]) < 10),
    Rule("repeats", lambda d: 100 * _once(window_hashes(d["words"]), n_repeat_words) > 20 * _n(d["words"])),
    Rule("word_length", lambda d: ~word_chars(d["words"]).between(2 * _n(d["words"]), 15 * _n(d["words"]))),
    Rule("symbols", lambda d: 10 * n_symbols(d["text"]) > _n(d["words"])),
    Rule("dup_lines", lambda d: 10 * n_dup_lines(d["text"]) > 3 * F.size(F.split(d["text"], "\n", -1))),
    Rule("shouting", lambda d: 2 * F.length(F.regexp_replace(d["text"], "[^!?]", "")) > _n(d["words"])),
    Rule("few_letters", lambda d: 10 * F.size(F.filter(d["words"], lambda w: w.rlike(r"\p{L}"))) < 7 * _n(d["words"])),
)
#: The contract's own part of the verdict.
BASE = ("few_words", "repeats")
#: Rows drawn for the estimates, characters read of each, passes over them, repetitions.
SAMPLE_ROWS, SAMPLE_CHARS, PASSES, REPEATS = 512, 20_000, 2, 3
#: (application, rule) -> seconds a character.
_COSTS: dict[tuple[str, str], float] = {}


def measure(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS) -> list[tuple[str, float, float]]:
    """(rule, seconds a character, share rejected) on about ``sample_rows`` rows drawn from the whole table
    with a fixed seed, of which texts longer than ``SAMPLE_CHARS`` are cut: the estimates order
    rules, they judge nothing.  The sample's words are split once and kept; a rule's seconds
    are the least of ``REPEATS`` runs of ``PASSES`` passes, less those of a run that only
    reads the sample.  What a rule costs does not depend on the table, so it is timed once in
    an application; shares are counted for each table."""
    n = docs.count()
    drawn = docs.select(F.substring(text_or_empty(F.col(f"`{text}`")), 1, SAMPLE_CHARS).alias("text"))
    if n > sample_rows:
        drawn = drawn.sample(min(1.0, sample_rows / n), 11)
    head = drawn.limit(2 * sample_rows).collect()
    if not head:
        return [(rule.name, 1.0, 0.0) for rule in rules]
    sample = docs.sparkSession.createDataFrame([(r["text"],) for r in head], "text string").coalesce(1)
    sample = sample.withColumn("words", words_of(F.col("text"))).withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(PASSES)))).cache()

    doc = F.struct("text", "words")
    hits = sample.agg(*[F.sum(rule.rejects(doc).cast("int")).alias(rule.name) for rule in rules]).first()  # fills the cache

    def timed(rejects: Column) -> float:
        job = sample.select(F.sum(rejects.cast("int")).alias("n"))
        best = float("inf")
        for _ in range(REPEATS):
            began = time.perf_counter()
            job.first()
            best = min(best, time.perf_counter() - began)
        return best

    app = docs.sparkSession.sparkContext.applicationId
    missing = [rule for rule in rules if (app, rule.name) not in _COSTS]
    if missing:
        idle = timed((F.size("words") >= 0) & (F.length("text") >= 0))
        chars = PASSES * max(1, sum(len(r["text"]) for r in head))
        for rule in missing:
            _COSTS[app, rule.name] = max(timed(rule.rejects(doc)) - idle, 1e-6) / chars
    sample.unpersist()
    return [(rule.name, _COSTS[app, rule.name], (hits[rule.name] or 0) / PASSES / len(head)) for rule in rules]


def ordered(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    score = {name: share / cost for name, cost, share in measure(docs, text, rules, sample_rows)}
    return sorted(rules, key=lambda r: (-score[r.name], r.name))


def cascade(rules: list[Rule], doc: Column) -> Column:
    """The name of the first rule that rejects, null if none does."""
    out = F.lit(None).cast("string")
    for rule in reversed(rules):
        out = F.when(rule.rejects(doc), F.lit(rule.name)).otherwise(out)
    return out


def filter_quality(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows that no rule rejects, with their own columns."""
    order = ordered(docs, text, rules)
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), text_or_empty(F.col(f"`{text}`")).alias("text"))
    # The optimizer moves a filter below the projection that its columns come from, which
    # would split the text anew for every window of words; it does not move one that reads
    # the output of a generator.
    split = packed.select("row", "text", F.explode(F.array(words_of(F.col("text")))).alias("words"))
    return split.filter(cascade(order, F.struct("text", "words")).isNull()).select("row.*")


def quality_table(docs: DataFrame, key: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Counts and verdict of every row."""
    order = [r for r in ordered(docs, text, rules) if r.name not in BASE]
    base = docs.select(F.col(f"`{key}`").alias("doc_id"), text_or_empty(F.col(f"`{text}`")).alias("text"))
    base = base.withColumn("words", words_of(F.col("text"))).withColumn("windows", window_hashes(F.col("words")))
    counted = base.select(
        "doc_id", "text", "words", F.size("words").cast("long").alias("n_words"), word_chars(F.col("words")).alias("word_chars"), n_symbols(F.col("text")).alias("n_symbols"),
        n_dup_lines(F.col("text")).alias("n_dup_lines"), n_repeat_words(F.col("windows")).alias("n_repeat_words"),
    )
    failed = counted.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))
    judged = failed.withColumn("rejected_by", F.when(F.col("base_failed"), F.lit("base")).otherwise(cascade(order, F.struct("text", "words"))))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", F.col("rejected_by").isNull().alias("kept"), "rejected_by")


#: The same in DuckDB SQL over ``documents``.
SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
w AS (SELECT *, [array_to_string(words[i:i + 4], ' ') FOR i IN range(1, len(words) - 3)] AS win FROM d),
p AS (SELECT doc_id, u.i AS i, u.g AS g FROM (SELECT doc_id, unnest([{'i': k, 'g': win[k]} FOR k IN range(1, len(win) + 1)]) AS u FROM w)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM p) WHERE c > 1),
n AS (SELECT doc_id, sum(least(5, coalesce(nxt - i, 5))) AS n_repeat_words FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM r) GROUP BY doc_id),
c AS (SELECT w.doc_id, text, words, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
    coalesce(n.n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN n ON w.doc_id = n.doc_id),
f AS (SELECT *, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR word_chars < 2 * n_words OR word_chars > 15 * n_words OR 10 * n_symbols > n_words
    OR 10 * n_dup_lines > 3 * len(string_split(text, chr(10))) OR 2 * length(regexp_replace(text, '[^!?]', '', 'g')) > n_words
    OR 10 * len(list_filter(words, lambda x: regexp_matches(x, '\p{L}'))) < 7 * n_words) AS kept
FROM f
"""
