"""Text and label functions over columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def size_label(size: Column) -> Column:
    """Bytes as B, KB or MB, the latter two with one decimal, halves up."""
    tenths = lambda unit: F.floor(size * 10 / unit + 0.5).cast("long")
    shown = lambda unit, name: F.concat(F.floor(tenths(unit) / 10).cast("string"), F.lit("."), (tenths(unit) % 10).cast("string"), F.lit(name))
    return F.when(size < 1024, F.concat(size.cast("string"), F.lit(" B"))).when(size < 1024 * 1024, shown(1024, " KB")).otherwise(shown(1024 * 1024, " MB"))


def escaped(text: Column) -> Column:
    """Text with the five HTML-special characters as references."""
    for raw, reference in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(raw), F.lit(reference))
    return text


def shortened(text: Column, n: int) -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("…"))).otherwise(text)


def first_match(text: Column, *patterns: str) -> Column:
    """First group of the first pattern that matches with a non-empty group, else null."""
    return F.coalesce(*[F.nullif(F.regexp_extract(text, p, 1), F.lit("")) for p in patterns])


def without_subset_prefix(name: Column) -> Column:
    """Font names without the six-letter prefix of a subset."""
    return F.regexp_replace(name, r"^[A-Z]{6}\+", "")


def has_subset_prefix(name: Column) -> Column:
    return name.rlike(r"^[A-Z]{6}\+")


def output_name(name: Column, lossy: bool, quality: Column | None, dpi: Column | None, day: Column) -> Column:
    """``base_lossless_yyyymmdd.pdf`` or ``base_lossy-qNN[-DDDdpi]_yyyymmdd.pdf``; quality 85 if null."""
    mode = F.lit("lossless")
    if lossy:
        q = F.coalesce(quality, F.lit(85)).cast("string") if quality is not None else F.lit("85")
        cap = F.coalesce(F.concat(F.lit("-"), dpi.cast("string"), F.lit("dpi")), F.lit("")) if dpi is not None else F.lit("")
        mode = F.concat(F.lit("lossy-q"), q, cap)
    return F.concat(F.regexp_replace(name, r"(?i)\.pdf$", ""), F.lit("_"), mode, F.lit("_"), F.date_format(day, "yyyyMMdd"), F.lit(".pdf"))


def pdf_text(digits: Column) -> Column:
    """A text string given as hex: UTF-16 or UTF-8 after their marks, else one byte a character; null if empty."""
    raw = F.unhex(digits)
    wide = F.decode(F.unhex(F.substring(digits, 5, 2**31 - 1)), "UTF-16BE")
    marked = F.decode(F.unhex(F.substring(digits, 7, 2**31 - 1)), "UTF-8")
    low = F.lower(digits)
    return F.nullif(F.when(low.startswith("feff"), wide).when(low.startswith("efbbbf"), marked).otherwise(F.decode(raw, "ISO-8859-1")), F.lit(""))


def pdf_date(text: Column) -> Column:
    """The moment of ``D:yyyymmddHHmmss+hh'mm'``, of which all but the year may be missing (then its start, in UTC); null for other text."""
    part = lambda n, default: F.coalesce(F.nullif(F.regexp_extract(text, r"^(?:D:)?(\d{4})(\d\d)?(\d\d)?(\d\d)?(\d\d)?(\d\d)?", n), F.lit("")), F.lit(default))
    zone = lambda n: F.regexp_extract(text, r"\d([+-])(\d\d)'?(\d\d)?'?$", n)
    offset = F.when(zone(1) == "", F.lit("+00:00")).otherwise(F.concat(zone(1), zone(2), F.lit(":"), F.coalesce(F.nullif(zone(3), F.lit("")), F.lit("00"))))
    stamp = F.concat(part(1, ""), F.lit("-"), part(2, "01"), F.lit("-"), part(3, "01"), F.lit(" "), part(4, "00"), F.lit(":"), part(5, "00"), F.lit(":"), part(6, "00"), offset)
    return F.try_to_timestamp(stamp, F.lit("yyyy-MM-dd HH:mm:ssXXX"))


def batch_tier(total: Column) -> Column:
    """``large`` from 50 MB on, ``medium`` from 20 MB on, else null."""
    return F.when(total >= 50 * 1024 * 1024, "large").when(total >= 20 * 1024 * 1024, "medium")


def error_kind(message: Column) -> Column:
    low = F.lower(message)
    return F.when(low.contains("encrypt") | low.contains("password"), "encrypted").when(low.contains("invalid") | low.contains("parse"), "invalid").otherwise("other")


def xmp_fields(xmp: Column) -> dict[str, Column]:
    """Conformance and language declarations of XMP text: element form first, then attribute form."""

    def pair(prefix: str, name: str, value: str) -> Column:
        return first_match(xmp, rf"<{prefix}:{name}[^>]*>\s*({value})\s*</{prefix}:{name}>", rf'{prefix}:{name}="({value})"')

    title = first_match(xmp, r"(?s)<dc:title[^>]*>.*?<rdf:li[^>]*>(.*?)</rdf:li>")
    language = first_match(xmp, r"(?s)<dc:language[^>]*>.*?<rdf:li[^>]*>\s*(.*?)\s*</rdf:li>")
    other = first_match(xmp, r'xml:lang="([^"]+)"')
    return {
        "pdfa_part": pair("pdfaid", "part", r"\d+"),
        "pdfa_conformance": F.upper(pair("pdfaid", "conformance", r"[A-Za-z]+")),
        "pdfua_part": pair("pdfuaid", "part", r"\d+"),
        "title": F.nullif(F.trim(title), F.lit("")),
        "language": F.coalesce(language, F.when(other != "x-default", other)),
    }
