"""Signals about a page as a whole, as native columns."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import rules


def platform(html: Column) -> Column:
    low, out = F.lower(html), F.lit(rules.NO_PLATFORM)
    for name, marks in reversed(rules.PLATFORMS):
        seen = low.contains(marks[0])
        for mark in marks[1:]:
            seen |= low.contains(mark)
        out = F.when(seen, F.lit(name)).otherwise(out)
    return out


def chat_widget(html: Column) -> Column:
    return F.lower(html).rlike("|".join(w.replace(".", r"\.") for w in rules.CHAT_WIDGETS))


def outdated_copyright(html: Column, year: int) -> Column:
    """A copyright notice and no mention of the year. References are decoded first, as a browser does."""
    low = F.lower(F.replace(html, F.lit("&copy;"), F.lit("©")))
    return (low.contains("copyright") | low.contains("©")) & ~low.contains(str(year))


def mobile_ready(html: Column) -> Column:
    return html.rlike(r"(?i)<meta\b[^>]*\bname\s*=\s*[\"']?(?-i:viewport)[\"'\s>/]")


def missing_ssl(final_url: Column) -> Column:
    return ~F.startswith(final_url, F.lit("https"))
