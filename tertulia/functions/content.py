"""Emojis, links and domains as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tertulia.fixed_values import UNKNOWN_DOMAIN
from tertulia.functions import patterns as P
from tertulia.functions.base import strip

# Domain consolidation, first hit wins (marks looked for -> domain shown).
DOMAIN_GROUPS = [
    (("youtube", "youtu.be"), "youtube.com"),
    (("linkedin", "lnkd.in"), "linkedin.com"),
    (("github",), "github.com"),
    (("x.com", "twitter"), "x.com"),
]
# Hosts that really belong to each group, for the strict reading.
DOMAIN_HOSTS = [
    (("youtube.com", "youtu.be"), "youtube.com"),
    (("linkedin.com", "lnkd.in"), "linkedin.com"),
    (("github.com",), "github.com"),
    (("x.com", "twitter.com"), "x.com"),
]


def extract_emojis(text: Column) -> Column:
    """Emojis in text order; skin tones, families, flags and keycaps stay whole."""
    return F.regexp_extract_all(text, F.lit(P.EMOJI), F.lit(0))


def extract_links(text: Column) -> Column:
    """Links in text order, without closing punctuation."""
    found = F.regexp_extract_all(text, F.lit(P.LINK), F.lit(0))
    return F.transform(found, lambda link: F.rtrim(link, F.lit(".,;:!?")))


def _any(conditions: list[Column]) -> Column:
    out = conditions[0]
    for condition in conditions[1:]:
        out = out | condition
    return out


def url_domain(url: Column, strict: bool = False) -> Column:
    """Domain of a URL, the usual platforms consolidated under one name.

    By default a platform is recognised by a substring (so ``netflix.com`` counts as
    ``x.com``); ``strict=True`` compares whole host suffixes instead.
    """
    bare = F.regexp_replace(F.lower(strip(url)), P.URL_SCHEME, "")
    host = F.regexp_extract(bare, P.URL_HOST, 0)
    if strict:
        port_free = F.regexp_replace(host, ":[0-9]*$", "")
        tests = [
            (_any([(port_free == h) | port_free.endswith(f".{h}") for h in hosts]), name)
            for hosts, name in DOMAIN_HOSTS
        ]
    else:
        tests = [(_any([host.contains(m) for m in marks]), name) for marks, name in DOMAIN_GROUPS]
    domain = F.when(host == "", UNKNOWN_DOMAIN)
    for condition, name in tests:
        domain = domain.when(condition, name)
    return domain.otherwise(host)
