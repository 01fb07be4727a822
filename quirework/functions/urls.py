"""Addresses, links and the checks on requests, as native columns."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import rules

_HOST = r"^(?:[a-z][a-z0-9+.-]*:)?//([^/?#]*)"


def authority(url: Column) -> Column:
    """Host with user and port, lower-case; empty where there is none. Never fails on malformed addresses."""
    return F.regexp_extract(F.lower(F.regexp_replace(url, r"(?U)^\s+|\s+$", "")), _HOST, 1)


def domain(url: Column) -> Column:
    """The authority without one leading www."""
    return F.regexp_replace(authority(url), r"^www\.", "")


def social_links(links: Column) -> Column:
    """Links to social networks without slashes at their end, distinct and sorted; null counts as none."""
    names = "|".join(d.replace(".", r"\.") for d in rules.SOCIAL_DOMAINS)
    found = F.filter(F.coalesce(links, F.array().cast("array<string>")), lambda x: domain(x).rlike(rf"^(?:.*\.)?(?:{names})$"))
    return F.array_sort(F.array_distinct(F.transform(found, lambda x: F.regexp_replace(x, "/+$", ""))))


def _holding(links: Column, parts: tuple[str, ...]) -> Column:
    any_of = lambda x: F.exists(F.array(*map(F.lit, parts)), lambda p: F.contains(F.lower(x), p))
    return F.array_sort(F.array_distinct(F.filter(F.coalesce(links, F.array().cast("array<string>")), any_of)))


def booking_links(links: Column) -> Column:
    return _holding(links, rules.BOOKING_SITES)


def review_links(links: Column) -> Column:
    return _holding(links, rules.REVIEW_SITES)


def selector(c: Column) -> Column:
    """A trimmed selector; null where it is blank."""
    return F.nullif(F.trim(c), F.lit(""))


def selector_ok(c: Column) -> Column:
    bad = "|".join(rules.BAD_SELECTOR)
    return selector(c).isNull() | (~F.lower(c).rlike(bad) & (F.length(selector(c)) <= rules.LONGEST_SELECTOR))


def url_ok(url: Column) -> Column:
    return F.coalesce(F.lower(url).rlike(r"^https?://[^/?#\s]+"), F.lit(False))


def batch_error(urls: Column, allow_mixed: Column, delay_min: Column, delay_max: Column, wait_selector: Column) -> Column:
    """The first rule that a batch request breaks, or null."""
    return (
        F.when(~F.coalesce(F.size(urls), F.lit(0)).between(1, rules.MOST_URLS), "url count")
        .when(~F.forall(urls, url_ok), "url")
        .when(~F.coalesce((delay_min >= 0) & (delay_max >= 0), F.lit(False)), "negative delay")
        .when(delay_min > delay_max, "delay range")
        .when(~allow_mixed & (F.size(F.array_distinct(F.transform(urls, domain))) > 1), "mixed domains")
        .when(~selector_ok(wait_selector), "selector")
    )


def status_error(code: Column) -> Column:
    """The error that an HTTP status stands for; every other status, server errors too, passes as null."""
    out = F.lit(None).cast("string")
    for number, name in rules.STATUS_ERRORS:
        out = F.when(code == number, F.lit(name)).otherwise(out)
    return out


def retried(error: Column) -> Column:
    return error.isin(*rules.RETRIED)


def backoff_seconds(attempt: Column) -> Column:
    """Delay after the attempt of a number from 1: it doubles up to a cap."""
    return F.least(F.lit(rules.BACKOFF_CAP), F.lit(rules.BACKOFF_BASE) * F.pow(F.lit(2.0), attempt - 1))


def parts(url: Column) -> Column:
    """Scheme, host, port, user and password, empty where absent; null parts never fail a row."""
    own = authority(url)
    login = F.when(own.contains("@"), F.substring_index(own, "@", 1)).otherwise(F.lit(""))
    host = F.substring_index(own, "@", -1)
    return F.struct(
        F.regexp_extract(F.lower(url), r"^([a-z][a-z0-9+.-]*):", 1).alias("scheme"), F.regexp_replace(host, r":\d*$", "").alias("host"), F.regexp_extract(host, r":(\d+)$", 1).alias("port"),
        F.substring_index(login, ":", 1).alias("user"), F.when(login.contains(":"), F.regexp_replace(login, "^[^:]*:", "")).otherwise(F.lit("")).alias("password"),
    )


def top_domains(links: DataFrame, most: int = 10) -> DataFrame:
    """The domains that each page links to most (page, domain, links), from its links (page, origin, link, place).

    Of the `most` most frequent authorities of a page - of equal ones those linked first - its own, origin, is left out, so one fewer may remain.
    Links combine to counts before the shuffle; only a page's distinct domains are ranked.
    """
    counted = links.groupBy("page", F.lower("origin").alias("origin"), authority(F.col("link")).alias("domain")).agg(F.count("*").alias("links"), F.min("place").alias("place"))
    ranked = counted.withColumn("_rank", F.row_number().over(Window.partitionBy("page", "origin").orderBy(F.desc("links"), "place", "domain")))
    return ranked.where((F.col("_rank") <= most) & ~F.col("domain").eqNullSafe(F.col("origin"))).select("page", "domain", "links")
