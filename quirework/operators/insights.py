"""The record of insights for each page."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import signals, text, urls
from .parse import calls_to_action, parsed


def insights(pages: DataFrame, as_of_year: int) -> DataFrame:
    """pages (final_url and html) with seo, content, leads and pitch_hooks. The page is parsed once; the rest is native."""
    p = parsed(pages)
    html = F.col("html")
    flat = p.select(
        *[c for c in pages.columns], "main_text", "meta", "links", "forms",
        text.clean_text(html).alias("_clean"), text.title(html).alias("_title"),
        urls.social_links(F.col("links")).alias("_social"), urls.booking_links(F.col("links")).alias("_booking"),
        urls.review_links(F.col("links")).alias("_review"), calls_to_action(F.col("actions")).alias("_ctas"), signals.chat_widget(html).alias("_chat"),
    )
    flat = flat.withColumns({"_emails": text.emails(F.col("_clean")), "_phones": text.phones(F.col("_clean"))})
    hooks = F.struct(
        ((F.size("_emails") == 0) & (F.size("_phones") == 0)).alias("missing_contact_info"),
        (F.size("forms") == 0).alias("missing_lead_capture_forms"),
        (F.size("_social") == 0).alias("missing_social_presence"),
        signals.missing_ssl(F.col("final_url")).alias("missing_ssl"),
        signals.outdated_copyright(html, as_of_year).alias("outdated_copyright"),
        (~signals.mobile_ready(html)).alias("missing_mobile_optimization"),
        (~F.col("_chat")).alias("missing_chat_automation"),
        (F.size("_booking") == 0).alias("missing_online_booking"),
    )
    leads = F.struct(
        F.col("_emails").alias("emails"), F.col("_phones").alias("phones"), F.col("_social").alias("social_links"), F.col("forms").alias("forms"), F.col("_ctas").alias("ctas"),
        F.struct(F.col("_chat").alias("has_chat_widget"), F.col("_booking").alias("booking_links")).alias("automation"), F.struct(F.col("_review").alias("review_links")).alias("reputation"),
    )
    seo = F.struct(F.col("_title").alias("title"), text.description(F.col("meta")).alias("description"), signals.platform(html).alias("platform"))
    content = F.struct(text.mission_statement(F.col("main_text")).alias("mission_statement"))
    rest = [c for c in pages.columns if c != "html"]
    return flat.select(*rest, seo.alias("seo"), content.alias("content"), leads.alias("leads"), hooks.alias("pitch_hooks"), F.size("links").alias("link_count"), F.length("main_text").alias("text_length"))
