"""Display text: money, shares, ages and the session status label."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from facetledger.vocab import ACTIVITY_WORDS, DOMAIN_WORDS

MISSING = "—"


def money(amount: Column) -> Column:
    """Dollars with more digits the smaller the amount."""
    return (
        F.when(amount >= 100, F.format_string("$%,d", F.bround(amount, 0).cast("bigint")))
        .when(amount >= 1, F.format_string("$%.2f", amount))
        .when(amount >= 0.001, F.format_string("$%.4f", amount))
        .otherwise(F.format_string("$%.6f", amount))
    )


def percent(share: Column) -> Column:
    """A 0-100 share with one digit."""
    return F.when(share.isNull(), F.lit(MISSING)).otherwise(F.format_string("%.1f%%", share))


def share_of(part: Column, whole: Column) -> Column:
    return F.when(whole <= 0, F.lit(MISSING)).otherwise(percent(part / whole * 100.0))


def cache_share(read: Column, total: Column) -> Column:
    """Cache-hit share without digits; a dash where no input was read."""
    value = F.try_divide(read.cast("double"), total.cast("double")) * 100.0
    return F.when(total <= 0, F.lit(MISSING)).otherwise(F.format_string("%.0f%%", value))


def age(seconds: Column) -> Column:
    whole = lambda value: F.floor(value).cast("bigint")
    return (
        F.when(seconds < 5, F.lit("just now"))
        .when(seconds < 60, F.format_string("%ds ago", whole(seconds)))
        .when(seconds < 3600, F.format_string("%dm ago", whole(seconds / 60)))
        .when(seconds < 86400, F.format_string("%.1fh ago", seconds / 3600.0))
        .otherwise(F.format_string("%.1fd ago", seconds / 86400.0))
    )


def _lookup(words: dict[str, str], key: Column) -> Column:
    pairs = [F.lit(x) for pair in words.items() for x in pair]
    return F.element_at(F.create_map(*pairs), key)


def status_label(project: Column, activity: Column, domain: Column, tags: Column, cost: Column) -> Column:
    """Project (20 characters at most), activity and domain words, three tags and dollars, bar-separated.

    ``project`` and ``tags`` are arrays of values, most confident first.
    """
    name = F.get(project, F.lit(0))
    short = F.when(F.length(name) > 20, F.concat(F.substring(name, 1, 18), F.lit(".."))).otherwise(name)
    shown_project = F.when((name != "") & ~name.isin("unattributed", "unknown"), short)
    shown_activity = F.when(
        (activity != "") & (activity != "unknown"), F.coalesce(_lookup(ACTIVITY_WORDS, activity), activity)
    )
    word = F.coalesce(_lookup(DOMAIN_WORDS, domain), F.substring(domain, 1, 4))
    shown_domain = F.when((domain != "") & (domain != "unknown") & (word != ""), word)
    listed = F.array_join(F.slice(tags, 1, 3), ",")
    shown_tags = F.when(listed != "", listed)
    shown_cost = F.when(cost > 0, F.format_string("$%.2f", F.round(cost, 2).cast("double")))
    return F.concat_ws(" | ", shown_project, shown_activity, shown_domain, shown_tags, shown_cost)
