"""Imports every module that registers frames and queries."""


def load() -> None:
    from shelfwise.plans import (domain, queries_alerts, queries_classify, queries_forecast, queries_quality,  # noqa: F401
                                 queries_replenish, queries_reports, queries_sources,
                                 queries_stock)
