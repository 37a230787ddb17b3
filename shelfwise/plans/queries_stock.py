"""Registered queries: stock health, stocking gaps and outside purchases."""

from __future__ import annotations

from datetime import timedelta

from shelfwise.operators import purchasing, stock
from shelfwise.plans.catalog import AS_OF, frame, query
from shelfwise.session import settle

START_90 = AS_OF - timedelta(days=90)


@query
def outside_purchase_summary(c):
    return purchasing.outside_summary(c["sales_detail"], START_90)


@query
def margin_baselines(c):
    return purchasing.margin_baselines(c["sales_detail"], START_90)


@query
def outside_purchase_flags(c):
    # Read by the gap check and by the understocking report: stored once.
    return settle(purchasing.outside_flags(c["sales_detail"], c["recommendations"], START_90))


@query
def outside_purchase_orders(c):
    # Few synthetic pairs are bought five times, so two purchases count as often here.
    flags = purchasing.outside_flags(c["sales_detail"], c["recommendations"], START_90, high=2, medium=1)
    return purchasing.outside_orders(flags, AS_OF)


@query
def stocking_gaps(c):
    return purchasing.stocking_gaps(c["recommendations"], c["sku_master"], c["inventory"], AS_OF)


@query
def stocking_gaps_confirmed(c):
    return purchasing.confirm_gaps(c["stocking_gaps"], c["outside_purchase_flags"], c["sales_detail"], START_90)


@query
def profit_per_unit(c):
    return stock.profit_per_unit(c["sales_detail"], AS_OF)


@query
def chronic_understocking(c):
    return stock.chronic_understocking(c["inventory"], c["sku_master"], c["sales_detail"], c["recommendations"],
                                       c["outside_purchase_flags"], AS_OF)


@query
def understocking_report(c):
    """The top 20 of each location, a view that nothing else reads."""
    return stock.understocking_report(c["chronic_understocking"])


@query
def network_orders(c):
    return stock.network_orders(c["chronic_understocking"], AS_OF)


@query
def transfer_intelligence(c):
    return purchasing.transfer_intelligence(c["stocking_gaps_confirmed"], c["chronic_understocking"], c["sku_master"])


@query
def resolved_unit_costs(c):
    return stock.resolved_costs(c["inventory"], c["sku_master"], c["purchase_orders"])


@query
def dead_stock(c):
    return stock.dead_stock(c["inventory"], c["sku_master"], c["purchase_orders"], c["sales"], c["sales_detail"],
                            c["recommendations"], c["chronic_understocking"], AS_OF)


@query
def dead_stock_flags(c):
    return stock.dead_stock_flags(c["dead_stock"])


@query
def dead_stock_summary(c):
    return stock.dead_stock_summary(c["dead_stock"])
