"""URLs, HTML and identifiers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import as_column, scrub_markup

# Query parameters that only track.
TRACKERS = ("fbclid", "gclid", "mc_cid", "mc_eid", "ref", "ref_src", "igshid")


def canonical_url(url: Column | str) -> Column:
    """Lower-cased scheme and host, no fragment, no tracking parameters, the rest sorted, no last slash."""
    u = F.regexp_replace(F.trim(as_column(url)), "#.*$", "")
    base = F.regexp_extract(u, r"^([^?]*)", 1)
    head = F.lower(F.regexp_extract(base, r"^([a-zA-Z]+://[^/]*)", 1))
    path = F.regexp_replace(F.regexp_replace(base, r"^[a-zA-Z]+://[^/]*", ""), "/+$", "")
    pairs = F.filter(F.split(F.regexp_extract(u, r"\?(.*)$", 1), "&"), lambda p: (p != "") & ~p.startswith("utm_") & ~F.regexp_extract(p, "^([^=]*)", 1).isin(*TRACKERS))
    query = F.array_join(F.array_sort(pairs), "&")
    return F.concat(head, path, F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))


def host(url: Column | str) -> Column:
    return F.lower(F.regexp_extract(as_column(url), r"^[a-zA-Z]+://([^/?#]*)", 1))


def html_text(html: Column | str) -> Column:
    """Text of a page: navigation, scripts and styles out, then all markup."""
    t = F.regexp_replace(as_column(html), r"(?is)<(nav|header|footer|aside)\b.*?</(nav|header|footer|aside)>", " ")
    return F.trim(F.regexp_replace(scrub_markup(t), r"\s+", " "))


def domain_hash(kind: str, *parts: Column) -> Column:
    """sha256 over a kind and parts, separated by 0x1F: ids that cannot collide across kinds."""
    return F.sha2(F.concat_ws("\x1f", F.lit(kind), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


def canonical_json(m: Column) -> Column:
    """A map as JSON with sorted keys."""
    entries = F.array_sort(F.map_entries(m))
    return F.to_json(F.map_from_entries(entries))
