"""URL filters: host-suffix and path-prefix expressions, joined on short hash prefixes, confirmed by full digests.

1. Each distinct address is parsed once, and expanded: every suffix of its host at a label border, with every prefix of
   its path that ends at a slash (and the empty one). No more labels and slashes are taken than some rule has.
2. An expression meets the rules on the first `prefix_chars` hexadecimal digits of its SHA-256, as they are kept for a rule's host and its
   path up to the last slash. Short prefixes collide, so nothing is decided by them.
3. A meeting is confirmed when the full digest of the suffix and as much of the path as the rule has equals the rule's.
4. Of the confirmed rules of an address the longest (host and path together) wins; between equally long ones that with the longer
   host; of one rule given with several verdicts, block. Addresses that no rule fits get the `default` verdict.

Rules up to a checked number are broadcast, and then only addresses are shuffled; beyond it both sides are, as
plain exchanges whose hot prefixes (`com/` fits most of the web) Spark can split. Repeated addresses are judged once, and
verdicts return to their rows by a join of plain exchanges again.

A host is what stands after the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased, ports and user names included; the path follows up to `?`,
`#` or the end. Escapes and dot segments stay as written.

Defined results: null addresses and such without `://` have an empty host and path and fit no rule; repeated rows each get their row, null ids
too; very long addresses expand no further than the rules' own depth; rules without a host, or whose path isn't empty and doesn't begin with a slash, fit
nothing; rules with a null verdict are left out, a null path is an empty one; empty tables give no rows, and without rules all rows get the default. Only the id and the address of `pages` are read
by judged(), so other columns may have any name; admitted() returns the columns of `pages` as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

_PARTS = r"://([^/?#]*)([^?#]*)"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, _PARTS, 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def _count(text: Column, mark: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(mark), F.lit("")))


def _through(path: Column, slashes: Column) -> Column:
    """A path up to and with its slash of that number, from 1; of none: the empty path."""
    return F.when(slashes > 0, F.concat(F.call_function("substring_index", path, F.lit("/"), slashes), F.lit("/"))).otherwise("")


def _digest(expression: Column) -> Column:
    return F.sha2(expression, 256)


def parsed(urls: DataFrame) -> DataFrame:
    """url, host and path of each row of a table with the column url."""
    return urls.select("url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))


def compiled(rules: DataFrame, prefix_chars: int = 8) -> DataFrame:
    """Rules (host, path, verdict) as they are joined: prefix, digest, rule, verdict, and the lengths that confirm and rank."""
    host, path = F.translate("host", _UPPER, _LOWER), F.coalesce("path", F.lit(""))
    own = rules.select(host.alias("host"), path.alias("path"), "verdict").where("host <> '' AND (path = '' OR path LIKE '/%') AND verdict IS NOT NULL")
    own = own.groupBy("host", "path").agg(F.when(F.bool_or(F.col("verdict") == "block"), "block").otherwise(F.max("verdict")).alias("verdict"))
    slashes = _count(F.col("path"), "/")
    return own.select(
        F.left(_digest(F.concat("host", _through(F.col("path"), slashes))), F.lit(prefix_chars)).alias("prefix"), _digest(F.concat("host", "path")).alias("digest"), F.concat("host", "path").alias("rule"), "verdict",
        F.length("host").alias("host_chars"), F.length("path").alias("path_chars"), (_count(F.col("host"), ".") + 1).alias("labels"), slashes.alias("slashes"),
    )


def expressions(addresses: DataFrame, most_labels: int, most_slashes: int, prefix_chars: int = 8) -> DataFrame:
    """addresses (url, host, path) with a row for each suffix of the host and prefix of the path, and the digits they are joined on."""
    labels, slashes = F.least(_count(F.col("host"), ".") + 1, F.lit(most_labels)), F.least(_count(F.col("path"), "/"), F.lit(most_slashes))
    suffixes = F.transform(F.sequence(F.lit(1), labels), lambda k: F.call_function("substring_index", F.col("host"), F.lit("."), -k))
    prefixes = F.transform(F.sequence(F.lit(0), slashes), lambda k: _through(F.col("path"), k))
    each = addresses.where("host <> ''").select("url", "path", F.explode(suffixes).alias("suffix"), prefixes.alias("prefixes")).select("url", "path", "suffix", F.explode("prefixes").alias("border"))
    return each.select("url", "path", "suffix", F.left(_digest(F.concat("suffix", "border")), F.lit(prefix_chars)).alias("prefix"))


def fitting(addresses: DataFrame, rules: DataFrame, prefix_chars: int = 8, broadcast_rules: int = 500_000) -> DataFrame:
    """url, rule and verdict of every distinct address in `addresses` (url, host, path) that some rule fits: its strongest one."""
    ready = written(compiled(rules, prefix_chars), "rules")
    n, labels, slashes = ready.agg(F.count("*"), F.max("labels"), F.max("slashes")).first()
    probes = expressions(addresses, labels or 1, slashes or 0, prefix_chars)
    met = probes.join(F.broadcast(ready) if n <= broadcast_rules else ready.hint("merge"), "prefix")
    confirmed = met.where(_digest(F.concat("suffix", F.left("path", F.col("path_chars")))) == F.col("digest"))
    strength = F.struct(F.col("host_chars") + F.col("path_chars"), "host_chars")
    best = confirmed.groupBy("url").agg(F.max_by(F.struct("rule", "verdict"), strength).alias("b"))
    return best.select("url", "b.rule", "b.verdict")


def _judged(pages: DataFrame, rules: DataFrame, default: str, **options: int) -> DataFrame:
    """pages (url and whatever else) with `_host`, `_path`, `_rule` and `_verdict`."""
    addresses = parsed(pages.select("url").where("contains(url, '://')").distinct())
    best = written(fitting(addresses, rules, **options), "verdicts").select(F.col("url").alias("_url"), F.col("rule").alias("_rule"), F.col("verdict").alias("_verdict"))
    out = pages.join(best.hint("merge"), F.col("url") == F.col("_url"), "left").drop("_url")
    return out.withColumns({"_host": host_of(F.col("url")), "_path": path_of(F.col("url")), "_verdict": F.coalesce("_verdict", F.lit(default))})


def judged(pages: DataFrame, rules: DataFrame, default: str = "allow", **options: int) -> DataFrame:
    """page_id, host, path, rule (host and path of the one that decides, else null) and verdict of every row of pages."""
    out = _judged(pages.select("page_id", "url"), rules, default, **options)
    return out.select("page_id", F.col("_host").alias("host"), F.col("_path").alias("path"), F.col("_rule").alias("rule"), F.col("_verdict").alias("verdict"))


def admitted(pages: DataFrame, rules: DataFrame, default: str = "allow", **options: int) -> DataFrame:
    """The rows of pages that aren't blocked."""
    return _judged(pages, rules, default, **options).where("_verdict <> 'block'").select([F.col(f"`{c}`") for c in pages.columns])
