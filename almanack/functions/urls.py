"""Identifiers taken from URLs, and stable hash ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from almanack.functions.base import strip


def host_or_raw(c: Column) -> Column:
    """Host name of a URL, or the raw value when it does not parse."""
    return F.coalesce(F.try_parse_url(c, F.lit("HOST")), c)


def last_segment(c: Column) -> Column:
    """Last path segment, trailing slashes ignored."""
    return F.element_at(F.split(F.regexp_replace(c, "/+$", ""), "/"), -1)


def url_id(c: Column, kind: str, name: str = "") -> Column:
    """``number`` of a path, a query ``param``, the ``segment``, or a ``slug`` of the whole URL."""
    if kind == "number":
        return F.nullif(F.regexp_extract(c, rf"/{name}/(\d+)", 1), F.lit(""))
    if kind == "param":
        return F.nullif(F.regexp_extract(c, rf"{name}=(\d+)", 1), F.lit(""))
    if kind == "segment":
        return last_segment(c)
    if kind == "slug":
        bare = F.lower(F.regexp_replace(c, "https?://", ""))
        dashed = F.regexp_replace(F.regexp_replace(bare, "[^a-z0-9]+", "-"), "^-+|-+$", "")
        return F.left(dashed, F.lit(60))
    raise ValueError(kind)


def stable_id(prefix: str, c: Column, algo: str = "md5", n: int = 12) -> Column:
    """A short reproducible id: prefix, then the first ``n`` hex digits of a digest."""
    digest = F.md5(c) if algo == "md5" else F.sha1(c)
    return F.concat(F.lit(prefix), F.substring(digest, 1, n))


def slug_or_hash(prefix: str, url: Column, raw: Column, generic: tuple[str, ...]) -> Column:
    """The last URL segment, or a digest of ``raw`` where the segment says nothing."""
    seg = F.coalesce(last_segment(url), F.lit(""))
    usable = (seg != "") & ~seg.isin(*generic)
    return F.when(usable, F.concat(F.lit(prefix), seg)).otherwise(stable_id(prefix, raw, "sha1", 10))


def account_id(c: Column, host: str, path: str = "", lengths: str = "2,32") -> Column:
    """Account name from a profile URL or a bare name; null when neither form is valid."""
    raw = strip(c)
    from_url = F.regexp_extract(raw, rf"^https?://{host}/{path}([A-Za-z0-9_-]{{2,}}?)/?$", 1)
    return F.when(from_url != "", from_url).when(raw.rlike(rf"^[A-Za-z0-9_-]{{{lengths}}}$"), raw)


def article_url(guid: Column, link: Column, aggregator: str) -> Column:
    """The guid when it is a direct link, else the link; null when neither is set."""
    g, k = F.coalesce(strip(guid), F.lit("")), F.coalesce(strip(link), F.lit(""))
    direct = g.startswith("http") & ~g.contains(aggregator)
    return F.nullif(F.when(direct, g).otherwise(k), F.lit(""))
