"""Implied market price and the dated price map (built-in expressions only)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def implied_price(yes_bid="yes_bid", no_bid="no_bid", last_price="last_price") -> Column:
    """``yes/(yes+no)`` when the bid sum is positive, else ``last/100``.

    The sum test guards the division (ANSI mode raises on zero). An absent
    bid gives NULL instead of an error; so does an absent last price when the
    fallback is needed.
    """
    y, n, last = F.col(yes_bid), F.col(no_bid), F.col(last_price)
    return (F.when(y.isNull() | n.isNull(), F.lit(None).cast("double"))
            .when(y + n > 0, y / (y + n))
            .otherwise(last / F.lit(100)))


def upsert_price(price_map, stamp, price) -> Column:
    """Set ``price_map[stamp] = price``; a missing map starts empty.

    ``map_concat`` rejects a repeated key, so the old entry is filtered first.
    """
    m = F.coalesce(price_map if isinstance(price_map, Column) else F.col(price_map),
                   F.create_map().cast("map<string,double>"))
    stamp_c = stamp if isinstance(stamp, Column) else F.lit(stamp)
    kept = F.map_filter(m, lambda k, v: k != stamp_c)
    return F.map_concat(kept, F.create_map(stamp_c, price.cast("double")))


def price_map(stamp, price) -> Column:
    stamp_c = stamp if isinstance(stamp, Column) else F.lit(stamp)
    return F.create_map(stamp_c, price.cast("double"))
