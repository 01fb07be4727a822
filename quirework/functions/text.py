"""Text of pages and what is found in it, as native columns."""

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import rules

#: Comments, scripts, styles and tags; runs of them become one blank.
MARKUP = r"(?is)(?:<!--.*?-->|<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>|<[^>]*>)+"
_NAMED = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&"))


def _once(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, with value worked out once however often body names it."""
    return F.transform(F.array(value), body)[0]


def decode_entities(html: Column) -> Column:
    """Common named references and decimal ones; &amp; comes last, so nothing is decoded twice."""
    return _once(html, _decoded)


def _decoded(html: Column) -> Column:
    codes = F.regexp_extract_all(html, F.lit(r"&#(\d{1,6});"), F.lit(1))
    letters = F.transform(codes, lambda n: F.decode(F.unhex(F.lpad(F.hex(n.cast("int")), 8, "0")), "UTF-32"))
    parts = F.zip_with(F.split(html, r"&#\d{1,6};", -1), F.concat(letters, F.array(F.lit(""))), lambda s, c: F.concat(s, c))
    out = F.when(html.contains("&#"), F.array_join(parts, "")).otherwise(html)
    for name, letter in _NAMED:
        out = F.replace(out, F.lit(name), F.lit(letter))
    return out


def clean_text(html: Column) -> Column:
    """Text nodes of a page; scripts and styles are dropped, navigation is not.

    The run of markup is possessive: long runs need no deep stack.
    """
    return decode_entities(F.regexp_replace(html, MARKUP + "+", " "))


def emails(text: Column) -> Column:
    """Distinct addresses in code-point order. (?U): letters and digits of any script bound a word."""
    found = F.regexp_extract_all(text, F.lit("(?U)" + rules.EMAIL), F.lit(0))
    none = F.when(text.isNotNull(), F.array().cast("array<string>"))
    return F.when(text.contains("@"), F.array_sort(F.array_distinct(found))).otherwise(none)


def phones(text: Column) -> Column:
    """Distinct telephone numbers of at least seven digits in code-point order."""
    found = F.transform(F.regexp_extract_all(text, F.lit("(?U)" + rules.PHONE), F.lit(0)), stripped)
    return F.array_sort(F.array_distinct(F.filter(found, lambda p: F.length(F.regexp_replace(p, r"(?U)\D", "")) >= rules.LEAST_DIGITS)))


def stripped(c: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def collapsed(c: Column) -> Column:
    return stripped(F.regexp_replace(c, r"(?U)\s+", " "))


def title(html: Column) -> Column:
    return collapsed(decode_entities(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title", 1)))


def mission_statement(text: Column) -> Column:
    """The first three lines of more than thirty characters."""
    lines = F.filter(F.transform(F.split(text, "\n"), stripped), lambda x: F.length(x) > rules.LEAST_LINE)
    return F.array_join(F.slice(lines, 1, rules.MOST_LINES), "\n")


def description(meta: Column) -> Column:
    own = F.nullif(F.try_element_at(meta, F.lit("description")), F.lit(""))
    return F.coalesce(own, F.nullif(F.try_element_at(meta, F.lit("og:description")), F.lit("")), F.lit(""))


def word_count(text: Column) -> Column:
    return F.size(F.array_remove(F.split(text, r"(?U)\s+"), ""))
