"""DuckDB twins of the registered queries: named SQL views that may read each other."""

from __future__ import annotations

import re

VIEWS: dict[str, str] = {}

_REFERENCE = re.compile(r"\b(?:from|join)\s+([a-z_][a-z0-9_]*)", re.IGNORECASE)


def _needs(name: str, seen: dict[str, None]) -> None:
    for ref in _REFERENCE.findall(VIEWS[name]):
        if ref in VIEWS and ref != name and ref not in seen:
            _needs(ref, seen)
            seen[ref] = None


def _exact_rounding(sql: str) -> str:
    """Round the decimal text of a double, as Spark and Python-style decimals do. DuckDB's own
    half-even rounding of doubles works on a product with a power of ten and misses ties."""
    out, at = [], 0
    while (start := sql.find("round_even(", at)) >= 0:
        depth, comma, end = 0, -1, start + len("round_even")
        while True:
            ch = sql[end]
            depth += (ch == "(") - (ch == ")")
            if ch == "," and depth == 1:
                comma = end
            if depth == 0:
                break
            end += 1
        value = _exact_rounding(sql[start + len("round_even("):comma])
        out += [sql[at:start], f"round_even(CAST(CAST(({value}) AS VARCHAR) AS DECIMAL(38,15)){sql[comma:end]})"]
        at = end + 1
    return "".join(out) + sql[at:]


def sql_for(name: str) -> str:
    """The view's SQL with the views it reads, in order, as common table expressions."""
    seen: dict[str, None] = {}
    _needs(name, seen)
    seen[name] = None
    ctes = ",\n".join(f"{n} AS (\n{VIEWS[n].strip()}\n)" for n in seen)
    return f"WITH {_exact_rounding(ctes)}\nSELECT * FROM {name}"


def load() -> dict[str, str]:
    from oracles import (customers, domain, forecasting, quality, replenishment, reporting,  # noqa: F401
                         scalars, stock, classification, alerting)
    return VIEWS
