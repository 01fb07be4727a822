"""Links to listed domains and their subdomains, by equal keys: a host meets a list of any size on each of its suffixes at dots.

Each distinct host is looked up once. Lists up to a checked number are broadcast, beyond it hosts and domains are shuffled. The domain of a link is its authority, lower-case and
without one leading www; ports and user names are part of it, so such links are on no listed domain. Null links and domains, and links without a host, match nothing; repeated rows stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.urls import domain
from ..shared import written


def suffixes(host: Column) -> Column:
    """A host and what remains of it after each of its dots."""
    labels = F.length(host) - F.length(F.replace(host, F.lit("."), F.lit(""))) + 1
    return F.transform(F.sequence(F.lit(1), labels), lambda k: F.call_function("substring_index", host, F.lit("."), -k))


def on_domains(links: DataFrame, link: str, domains: DataFrame, broadcast_rows: int = 1_000_000) -> DataFrame:
    """The rows of links whose link is on one of domains (domain), or on a subdomain."""
    listed = written(domains.where("domain <> ''").select(F.lower("domain").alias("_suffix")).distinct(), "domains")
    hosts = links.select(domain(F.col(link)).alias("_host")).where("_host <> ''").distinct()
    probes = hosts.select("_host", F.explode(suffixes(F.col("_host"))).alias("_suffix"))
    small = listed.count() <= broadcast_rows
    found = written(probes.join(F.broadcast(listed) if small else listed.hint("merge"), "_suffix", "left_semi").select("_host").distinct(), "hosts")
    return links.withColumn("_host", domain(F.col(link))).join(found, "_host", "left_semi").drop("_host")
