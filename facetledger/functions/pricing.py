"""Dollar estimates from token counts. Price lists are fixed and small, so they are literals, not joins."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from facetledger.vocab import DEFAULT_PRICE, FAMILY_PRICES, MODEL_PRICES, WALKER_PRICES

MILLION = 1_000_000


def price(model: Column, exact=MODEL_PRICES, families=FAMILY_PRICES, default=DEFAULT_PRICE) -> Column:
    """(input, output) dollars per million tokens: by model, else by family prefix, else the default."""
    pair = lambda p: F.struct(F.lit(float(p[0])).alias("input"), F.lit(float(p[1])).alias("output"))
    found = F
    for name, value in exact.items():
        found = found.when(model == name, pair(value))
    for prefix, value in families.items():
        found = found.when(F.startswith(model, F.lit(prefix)), pair(value))
    return found.otherwise(pair(default))


def estimate_cost(model: Column, input_tokens: Column, output_tokens: Column, **prices) -> Column:
    """Input plus output dollars. Cache tokens are not priced."""
    p = price(model, **prices)
    return input_tokens * p["input"] / MILLION + output_tokens * p["output"] / MILLION


def walker_cost(model: Column, input_tokens: Column, output_tokens: Column, prices=WALKER_PRICES) -> Column:
    """Dollars of a scoring model, 6 digits; 0 for an unlisted model."""
    cost = F
    for name, (inp, out) in prices.items():
        cost = cost.when(model == name, F.bround((input_tokens * F.lit(inp) + output_tokens * F.lit(out)) / MILLION, 6))
    return cost.otherwise(F.lit(0.0))
