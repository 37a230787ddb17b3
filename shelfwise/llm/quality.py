"""Quality rules as a short-circuit cascade, in DataFrame functions only.

A rule is a condition on a few features of one text. The verdict is "rejected by any rule", which no
order changes; the order decides the cost. ``plan`` measures each rule on a bounded sample, its time
and the share it rejects, and sorts by rejection per cost. ``cascade`` then builds one CASE expression
in that order over the text itself, so the features of a later rule are computed only for documents
that every earlier rule let through.

Cases: a null text has no words; a text without words fails ``too_short``. Rows that repeat are judged
alike, each by itself. An empty table or sample keeps the given order. Extra columns stay as they are:
the features are built beside them in expressions, not as columns, unless ``features`` is asked for.
"""

from __future__ import annotations

import re
import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.shared import BLANKS, settle

_BLANKS = BLANKS.replace("\\", "\\\\")

# Positions share a long with 40 bits of a window's hash; longer texts take the exact path.
_POSITION_BITS = 24


def _repeat_words(w: str) -> str:
    """Words inside 3-word windows that occur twice or more, without leaving the row.

    Hash and position of each window are packed in a long and sorted, so equal windows are neighbours
    and are compared word by word. Where two different windows share a hash (or a text is too long for
    the packing) the windows themselves are sorted instead."""
    bits, mask = _POSITION_BITS, (1 << _POSITION_BITS) - 1
    at = f"cast({{}} & {mask}L as int)"
    window = f"concat_ws(' ', {w}[{{0}}], {w}[{{0}} + 1], {w}[{{0}} + 2])"
    near = f"shiftright(k[i], {bits}) = shiftright(k[i + 1], {bits})"
    same = " and ".join(f"{w}[{at.format('k[i]')} + {o}] = {w}[{at.format('k[i + 1]')} + {o}]" for o in range(3))
    packed = f"sort_array(transform(sequence(0, size({w}) - 3), i -> shiftleft(xxhash64({w}[i], {w}[i + 1], {w}[i + 2]), {bits}) | i))"
    # g: the indexes i of sorted windows whose next neighbour has the same hash
    hits = f"filter(sequence(0, size(k) - 2), i -> {near})"
    places = f"array_distinct(sort_array(flatten(transform(g, i -> array({at.format('k[i]')}, {at.format('k[i + 1]')})))))"
    exact_sort = f"sort_array(transform(sequence(0, size({w}) - 3), i -> struct({window.format('i')} as t, i as p)))"
    exact = (f"transform(array({exact_sort}), k -> array_distinct(sort_array(flatten(transform(filter(sequence(0, size(k) - 2), "
             f"i -> k[i].t = k[i + 1].t), i -> array(k[i].p, k[i + 1].p))))))[0]")
    fast = (f"transform(array({packed}), k -> transform(array({hits}), g -> "
            f"CASE WHEN forall(g, i -> {same}) THEN {places} END)[0])[0]")
    covered = ("transform(array({}), p -> aggregate(zip_with(p, slice(p, 2, size(p)), (a, b) -> least(3, coalesce(b - a, 3))), "
               "0L, (x, y) -> x + y))[0]")
    chosen = f"CASE WHEN size({w}) > {1 << bits} THEN {exact} ELSE coalesce({fast}, {exact}) END"
    return f"CASE WHEN size({w}) < 4 THEN 0L ELSE {covered.format(chosen)} END"


def _count(text: str, drop: str) -> str:
    """Characters left when everything matching ``drop`` is taken out."""
    return f"cast(length(regexp_replace({text}, '{drop}', '')) as bigint)"


#: Feature name -> SQL over __text (never null) and __words (its words).
FEATURES: dict[str, str] = {
    "n_words": "cast(size(__words) as bigint)",
    "word_chars": "cast(length(array_join(__words, '')) as bigint)",
    "n_symbols": _count("__text", "[^#*$%&|<>]+"),
    "n_lines": f"cast(size(filter(split(__text, '\\n'), x -> x rlike '{_BLANKS.replace('[', '[^', 1)}')) as bigint)",
    "n_dup_lines": (f"transform(array(filter(split(__text, '\\n'), x -> x rlike '{_BLANKS.replace('[', '[^', 1)}')), "
                    "y -> cast(size(y) - size(array_distinct(y)) as bigint))[0]"),
    "n_upper": _count("__text", "[^A-Z]+"),
    "n_digits": _count("__text", "[^0-9]+"),
    "n_repeat_words": _repeat_words("__words"),
}
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: str  # SQL over feature names


RULES = (
    Rule("too_short", "n_words < 50"),
    Rule("repeats", "100 * n_repeat_words > 50 * n_words"),
    Rule("symbols", "10 * n_symbols > n_words"),
    Rule("capitals", "10 * n_upper > 4 * word_chars"),
    Rule("digits", "10 * n_digits > 4 * word_chars"),
    Rule("word_length", "2 * word_chars < 5 * n_words or word_chars > 15 * n_words"),
    Rule("copied_lines", "2 * n_dup_lines > n_lines"),
)
BASE_FAILED = "(n_words < 50 or 100 * n_repeat_words > 50 * n_words)"


def _inlined(condition: str, names=FEATURES) -> str:
    return re.sub(r"\b(" + "|".join(names) + r")\b", lambda m: f"({FEATURES[m[1]]})", condition)


def _over_text(body: str) -> str:
    """``body`` with __text and __words bound once in the row, so that a filter pushed down keeps them shared."""
    return (f"transform(array(coalesce(text, '')), __text -> transform(array(array_remove(split(__text, '{_BLANKS}'), '')), "
            f"__words -> {body})[0])[0]")


def _prepared(docs: DataFrame) -> DataFrame:
    return (docs.withColumn("__text", F.coalesce(F.col("text"), F.lit("")))
            .withColumn("__words", F.expr(f"array_remove(split(__text, '{_BLANKS}'), '')")))


def features(docs: DataFrame, names=tuple(FEATURES)) -> DataFrame:
    """Every row with the named features, plus any feature they need no column for."""
    out = _prepared(docs).select("*", *[F.expr(FEATURES[n]).alias(n) for n in names])
    return out.drop("__text", "__words")


def plan(docs: DataFrame, rules=RULES, sample_rows: int = 400, fraction: float = 0.2, repeats: int = 2) -> list[tuple[Rule, float, float]]:
    """(rule, seconds, share rejected) on at most ``sample_rows`` sampled documents, best first.

    The sample serves the order alone; every document is judged by every rule it needs."""
    sample = settle(docs.select("text").sample(fraction, seed=7).limit(sample_rows))
    measured = []
    for rule in rules:
        hit = F.expr(_over_text(f"cast({_inlined(rule.rejects)} as int)"))
        job = sample.agg(F.count("*").alias("n"), F.coalesce(F.sum(hit), F.lit(0)).alias("hit"))
        spent = []
        for _ in range(repeats):
            start = time.perf_counter()
            n, hit = job.first()
            spent.append(time.perf_counter() - start)
        measured.append((rule, min(spent), hit / n if n else 0.0))
    return sorted(measured, key=lambda m: -m[2] / max(m[1], 1e-6))


def verdict(rules: list[Rule]) -> Column:
    """The first rule that rejects, in the given order, or ''; features are computed inside the branches."""
    branches = " ".join(f"WHEN {_inlined(r.rejects)} THEN '{r.name}'" for r in rules)
    return F.expr(_over_text(f"CASE {branches} ELSE '' END"))


def cascade(docs: DataFrame, rules=RULES) -> DataFrame:
    """The documents that no rule rejects, with their own columns."""
    return docs.where(verdict([m[0] for m in plan(docs, rules)]) == "")


def judged(docs: DataFrame, rules=RULES) -> DataFrame:
    """Every document with the base counts, the base verdict and whether the whole cascade keeps it.

    The base counts are wanted for every row, so rules on them read the columns; the other rules run
    in measured order behind them and only where the base passes."""
    order = [m[0] for m in plan(docs, rules)]
    late = F.expr("CASE WHEN " + BASE_FAILED + " THEN false " + "".join(
        f"WHEN {_inlined(r.rejects, [n for n in FEATURES if n not in BASE])} THEN false " for r in order
        if r.name not in ("too_short", "repeats")) + "ELSE true END")
    rows = _prepared(docs.select("doc_id", "text")).select(
        "doc_id", "__text", "__words", *[F.expr(FEATURES[n]).alias(n) for n in BASE])
    return rows.select("doc_id", *BASE, F.expr(BASE_FAILED).alias("base_failed"), late.alias("kept"))
