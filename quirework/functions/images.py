"""Plans for image conversions, as native columns: parameters are worked out before any pixel is touched."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import rules


def canonical_format(name: Column) -> Column:
    """Upper-case name; JPG and TIF are other names of JPEG and TIFF. Null for unknown formats."""
    up = F.upper(name)
    return F.when(F.lower(name).isin(*rules.FORMATS), F.when(up == "JPG", "JPEG").when(up == "TIF", "TIFF").otherwise(up))


def mapped_quality(fmt: Column, percent: Column) -> Column:
    """A percentage on the format's own scale, which may be reversed, as a double; null without a percentage."""
    out = F.lit(None).cast("double")
    for name, low, high in rules.QUALITY_RANGES:
        value = F.lit(float(low)) + F.lit(float(high - low)) * percent / F.lit(100.0)
        out = F.when((fmt == name) & percent.isNotNull(), F.least(F.greatest(value, F.lit(float(min(low, high)))), F.lit(float(max(low, high))))).otherwise(out)
    return out


def target_width(ow: Column, oh: Column, w: Column, h: Column) -> Column:
    """0 and null stand for not given; one given side keeps the shape, truncated to whole pixels."""
    w, h = F.nullif(w, F.lit(0)), F.nullif(h, F.lit(0))
    return F.coalesce(w, F.when(h.isNotNull(), (h * (ow.cast("double") / oh)).cast("int")), ow)


def target_height(ow: Column, oh: Column, w: Column, h: Column) -> Column:
    w, h = F.nullif(w, F.lit(0)), F.nullif(h, F.lit(0))
    return F.coalesce(h, F.when(w.isNotNull(), (w / (ow.cast("double") / oh)).cast("int")), oh)


def interpolation(ow: Column, oh: Column, w: Column, h: Column) -> Column:
    """Null where nothing changes."""
    return F.when((ow == w) & (oh == h), None).when((w < ow) | (h < oh), "area").otherwise("lanczos4")


def tiff_codec(quality: Column, transparent: Column, method: Column) -> Column:
    out = F.lit("none")
    for least, name in reversed(rules.TIFF_CODECS):
        out = F.when(quality >= least, F.lit(name)).otherwise(out)
    return F.when(method != "auto", method).when(transparent, "deflate").otherwise(out)


def output_name(filename: Column, fmt: Column) -> Column:
    """Without the last extension and with other characters as underscores; the format is the new extension."""
    base = F.regexp_replace(filename, r"(?<=[^.])\.[^./]*$", "")
    return F.concat(F.regexp_replace(base, r"[^a-zA-Z0-9_.-]", "_"), F.lit("."), F.lower(fmt))


def request_error(fmt: Column, max_size: Column, quality: Column) -> Column:
    """The first rule that an image request breaks, or null. A target size is not supported."""
    return (
        F.when(canonical_format(fmt).isNull(), "format")
        .when(max_size.isNotNull() == quality.isNotNull(), "either quality or size")
        .when(~quality.between(0, 100), "quality range")
        .when(max_size > 0, "unsupported: target size")
    )
