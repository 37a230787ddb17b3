"""Secrets in texts, in DataFrame functions only.

Base spans come from three patterns. Further ones come from two character Markov models, one of random
strings and one of ordinary identifiers: every long token outside the base spans is scored by the
log-likelihood ratio of its character pairs. The labelled samples are by default the corpus' own
tokens, what the base patterns confirm as secrets against all other long tokens; a caller may pass
its own (token, is_secret) rows. A model is the pair counts over all samples, at most 2 * 66 * 66 rows.

Offsets need no Python: ``split`` by a pattern gives the texts between its matches, so running sums of
the lengths of gaps and matches are the places of the matches, in code points.

Cases: a null or empty text has no spans. Rows that repeat are each searched. Whole texts of any
length are searched. Without secret or without ordinary samples there is no model and nothing is
added. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.shared import kept_columns, settle

KINDS = ("assign", "access", "hex", "random")
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}+"          # whole runs, so the length can be part of the pattern
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}+"
TOKEN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-."
_BLOCK = 512


def _text(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _let(name: str, value: str, body: str) -> str:
    """``value`` computed once and named inside ``body``."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _matches(text: str, pattern: str, group: int = 0) -> str:
    """SQL for the array of (s, e, x) of all matches, x being the wanted group.

    Running sums are taken in blocks, so a text with very many matches stays near linear."""
    r = _text(pattern)
    steps = "transform(sequence(0, size(m) - 1), i -> length(p[i]) + length(m[i]))"
    sums = f"transform(sequence(0, (size(m) - 1) div {_BLOCK}), b -> aggregate(slice(n, b * {_BLOCK} + 1, {_BLOCK}), 0, (a, x) -> a + x))"
    before = "aggregate(bs, array(0), (a, x) -> concat(a, array(element_at(a, -1) + x)))"
    ends = (f"flatten(transform(sequence(0, size(bs) - 1), b -> slice(aggregate(slice(n, b * {_BLOCK} + 1, {_BLOCK}), array(o[b]), "
            f"(a, x) -> concat(a, array(element_at(a, -1) + x))), 2, {_BLOCK})))")
    rows = "transform(sequence(0, size(m) - 1), i -> struct(e[i] - length(m[i]) as s, e[i] as e, g[i] as x))"
    found = _let("m", f"regexp_extract_all({text}, {r}, 0)", _let("g", f"regexp_extract_all({text}, {r}, {group})" if group else "m",
                 _let("p", f"split({text}, {r}, -1)", _let("n", steps, _let("bs", sums, _let("o", before, _let("e", ends, rows)))))))
    return f"CASE WHEN {text} rlike {r} THEN {found} ELSE cast(array() as array<struct<s:int,e:int,x:string>>) END"


def candidates(docs: DataFrame) -> DataFrame:
    """(doc_id, assign, access, hex, other): base spans by kind and the long tokens outside them."""
    rows = kept_columns(docs, "doc_id", "text").select("doc_id", F.coalesce("text", F.lit("")).alias("t"))
    found = rows.select("doc_id", F.expr(f"filter({_matches('t', ASSIGN, 2)}, z -> length(z.x) >= 6)").alias("assign"),
                        F.expr(f"filter({_matches('t', ACCESS)}, z -> z.e - z.s >= 20)").alias("access"),
                        F.expr(_matches("t", HEX)).alias("hex"), F.expr(_matches("t", TOKEN)).alias("tokens"))
    base = "concat(assign, access, hex)"
    return found.select("doc_id", "assign", "access", "hex",
                        F.expr(f"filter(tokens, z -> not exists({base}, b -> b.s < z.e and z.s < b.e))").alias("other"))


def labelled(found: DataFrame, least: int = 16) -> DataFrame:
    """(token, is_secret): what the base patterns confirm, and the other long tokens."""
    return (found.select(F.explode(F.expr(
        f"concat(transform(filter(concat(assign, access, hex), z -> length(z.x) >= {least}), z -> struct(z.x as token, true as is_secret)), "
        "transform(other, z -> struct(z.x as token, false as is_secret)))")).alias("r")).select("r.*"))


def _codes(token: str) -> str:
    """Alphabet places of a token's characters; others are -1."""
    return f"transform(filter(split({token}, ''), c -> c != ''), c -> locate(c, '{ALPHABET}') - 1)"


def train(samples: DataFrame) -> list[float] | None:
    """Log-likelihood ratio of every character pair, secret over ordinary; null without samples of both."""
    pairs = (samples.select("is_secret", F.explode(F.expr(_let("k", _codes("token"),
             f"filter(zip_with(k, slice(k, 2, size(k)), (a, b) -> IF(a < 0 or b < 0, null, a * {len(ALPHABET)} + b)), v -> v is not null)")))
             .alias("pair")).groupBy("is_secret", "pair").count())
    counts: dict[bool, dict[int, int]] = {True: {}, False: {}}
    for secret, pair, n in pairs.collect():  # at most two rows for each pair of characters
        counts[secret][pair] = n
    if not counts[True] or not counts[False]:
        return None
    size, logs = len(ALPHABET), {}
    for k, n in counts.items():
        alone = [0.5 + sum(n.get(a * size + b, 0) for a in range(size)) for b in range(size)]
        share = [x / sum(alone) for x in alone]  # pairs that were not seen fall back to how common the character is
        row = [sum(n.get(a * size + b, 0) for b in range(size)) for a in range(size)]
        logs[k] = [math.log((n.get(a * size + b, 0) + 2 * share[b]) / (row[a] + 2)) for a in range(size) for b in range(size)]
    ratio = [x - y for x, y in zip(logs[True], logs[False])]
    return ratio


def score(token: str, ratio: list[float]):
    """The log-likelihood ratio of a token column under the models."""
    table = ",".join(f"{x:.5g}" for x in ratio)
    size = len(ALPHABET)
    pairs = f"zip_with(k, slice(k, 2, size(k)), (a, b) -> IF(a < 0 or b < 0, 0D, coalesce(r[a * {size} + b], 0D)))"
    return _let("r", f"cast(split('{table}', ',') as array<double>)", _let("k", _codes(token), f"aggregate({pairs}, 0D, (a, x) -> a + x)"))


def spans(docs: DataFrame, samples: DataFrame | None = None, threshold: float = 10.0) -> DataFrame:
    """(doc_id, spans array of (s, kind, e, base)), by start and kind; a token is random from ``threshold`` on."""
    found = settle(candidates(docs))
    ratio = train(labelled(found) if samples is None else samples)
    rows = [f"transform({k}, z -> struct(z.s as s, {n} as k, z.e as e))" for n, k in enumerate(KINDS[:3])]
    if ratio is not None:
        rows.append(f"transform(filter(other, z -> {score('z.x', ratio)} >= {threshold}D), z -> struct(z.s as s, 3 as k, z.e as e))")
    names = "array('" + "','".join(KINDS) + "')"
    return found.select("doc_id", F.expr(
        f"transform(sort_array(concat({', '.join(rows)})), z -> struct(z.s as start, {names}[z.k] as kind, z.e as end, z.k < 3 as base))").alias("spans"))


def joined(only_base: bool = False):
    """kind:start:end of the spans, comma-joined."""
    rows = "filter(spans, z -> z.base)" if only_base else "spans"
    return F.expr(f"array_join(transform({rows}, z -> concat_ws(':', z.kind, cast(z.start as string), cast(z.end as string))), ',')")
