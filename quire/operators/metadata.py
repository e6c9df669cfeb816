"""Document properties: information fields, viewer preferences, versions, page modes and embedded metadata, as column updates."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What page modes and layouts may be, and the preferences of viewers.
PAGE_MODES = ("UseNone", "UseOutlines", "UseThumbs", "FullScreen", "UseOC", "UseAttachments")
PAGE_LAYOUTS = ("SinglePage", "OneColumn", "TwoColumnLeft", "TwoColumnRight", "TwoPageLeft", "TwoPageRight")
NON_FULL_SCREEN = ("UseNone", "UseOutlines", "UseThumbs", "UseOC")
PREFERENCES = ("HideToolbar", "HideMenubar", "HideWindowUI", "FitWindow", "CenterWindow", "DisplayDocTitle")
FIELDS = ("Title", "Author", "Subject", "Keywords", "Creator", "Producer", "Created", "Modified", "Trapped")


def set_field(info: Column, field: str, value: Column) -> Column:
    """An information map with one field set; null removes it."""
    if field not in FIELDS:
        raise ValueError(f"no such field: {field}")
    rest = F.map_filter(info, lambda k, _: k != field)
    return F.when(value.isNull(), rest).otherwise(F.map_concat(rest, F.create_map(F.lit(field), value)))


def set_preference(preferences: Column, name: str, value: bool) -> Column:
    """A map of viewer preferences with one set."""
    if name not in PREFERENCES:
        raise ValueError(f"no such preference: {name}")
    return F.map_concat(F.map_filter(preferences, lambda k, _: k != name), F.create_map(F.lit(name), F.lit(value)))


def checked(value: str, allowed: tuple[str, ...]) -> Column:
    if value not in allowed:
        raise ValueError(f"{value!r} is none of {', '.join(allowed)}")
    return F.lit(value)


def version(v: Column) -> Column:
    """1.v, or from 10 on 2.(v - 10)."""
    return F.when(v >= 10, F.concat(F.lit("2."), (v - 10).cast("string"))).otherwise(F.concat(F.lit("1."), v.cast("string")))


def xmp(title: Column, creator: Column, date: Column) -> Column:
    """A small metadata packet."""
    safe = lambda c: F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    return F.concat(F.lit("<x:xmpmeta><rdf:RDF><dc:title>"), safe(title), F.lit("</dc:title><dc:creator>"), safe(creator), F.lit("</dc:creator><xmp:MetadataDate>"), date, F.lit("</xmp:MetadataDate></rdf:RDF></x:xmpmeta>"))


def set_xmp_date(packet: Column, date: str) -> Column:
    """A packet with another date."""
    return F.regexp_replace(packet, r"(<xmp:MetadataDate>)[^<]*(</xmp:MetadataDate>)", f"$1{date}$2")


def mark_conformance(packet: Column, part: int) -> Column:
    """A packet that names a part of the accessibility standard; an earlier name goes."""
    return F.replace(unmark_conformance(packet), F.lit("</rdf:RDF>"), F.lit(f"<pdfuaid:part>{part}</pdfuaid:part></rdf:RDF>"))


def unmark_conformance(packet: Column) -> Column:
    """A packet without that name."""
    return F.regexp_replace(packet, "<pdfuaid:part>[^<]*</pdfuaid:part>", "")


def cleared(documents: DataFrame, columns: tuple[str, ...], chosen: Column) -> DataFrame:
    """Properties (metadata, ids, labels, marks kept as columns) taken from the chosen documents."""
    kinds = dict(documents.dtypes)
    return documents.withColumns({c: F.when(chosen, F.lit(None).cast(kinds[c])).otherwise(F.col(c)) for c in columns})


def opening(page: Column, view: str = "/Fit") -> Column:
    """Where a document opens: a page and how it is shown."""
    return F.concat(F.lit("["), page.cast("string"), F.lit(f" {view}]"))


# The standards' name spaces in metadata, and what they are called.
SUBFORMATS = (
    ("http://www.aiim.org/pdfe/ns/id/", "ISO_PDFEVersion", "PDF/E"), ("http://www.aiim.org/pdfua/ns/id/", "part", "PDF/UA"), ("http://www.aiim.org/pdfa/ns/id/", "part", "PDF/A"), ("http://www.aiim.org/pdfa/ns/id", "part", "PDF/A"),
    ("http://www.aiim.org/pdfa/ns/id.html", "part", "PDF/A"), ("http://www.npes.org/pdfx/ns/id/", "GTS_PDFXVersion", "PDF/X"), ("http://www.npes.org/pdfvt/ns/id/", "GTS_PDFVTVersion", "PDF/VT"),
)


def subformats(packet: Column) -> Column:
    """An array of the standards that a metadata packet names, as PDF/UA-1 or PDF/A-2b; a packet that is no XML names none.

    Elements count by their name space, whatever its prefix.
    """
    @F.pandas_udf("array<string>")
    def made(packets: pd.Series) -> pd.Series:
        from xml.etree import ElementTree

        def one(text: str | None) -> list[str]:
            try:
                root = ElementTree.fromstring(text or "<none/>")
            except ElementTree.ParseError:
                return []

            def value(space: str, name: str) -> str:
                tag = f"{{{space}}}{name}"
                return next((v for e in root.iter() for v in (e.text if e.tag == tag else None, e.get(tag)) if v), "").strip()

            found = [(kind, value(space, name), value(space, "conformance").lower() if kind == "PDF/A" else "") for space, name, kind in SUBFORMATS]
            return [f"{kind}-{part}{level}" for kind, part, level in found if part]

        return packets.map(one, na_action=None)

    return made(packet)
