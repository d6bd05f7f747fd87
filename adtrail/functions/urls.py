"""URL columns: parts, image test, job names. Registrable domains are in `adtrail.operators.domains`."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from adtrail import fixed
from adtrail.functions.cols import Col, as_col

_AUTHORITY = r"^(?:[a-zA-Z0-9+.-]+:)?//([^/?#]*)"
_PATH = r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)"
_QUERY = r"^[^?#]*\?([^#]*)"
_HOST = r"^(?:(?:[a-zA-Z0-9+.-]+:)?//)?(?:[^/?#]*@)?([^/?#:@]*)"
IPV4 = r"^\d{1,3}(\.\d{1,3}){3}$"


def netloc(url: Col) -> Column:
    """Text between ``//`` and the path, with user info and port; ``""`` without ``//``."""
    return F.regexp_extract(as_col(url), _AUTHORITY, 1)


def url_path(url: Col) -> Column:
    """Path without the parameters of its last segment."""
    return F.regexp_replace(F.regexp_extract(as_col(url), _PATH, 1), r";[^/]*$", "")


def url_query(url: Col) -> Column:
    return F.regexp_extract(as_col(url), _QUERY, 1)


def host(url: Col) -> Column:
    """Lower-case host without user info, port and trailing dots."""
    return F.regexp_replace(F.lower(F.regexp_extract(as_col(url), _HOST, 1)), r"\.+$", "")


def fqdn(url: Col) -> Column:
    """The host with empty labels dropped."""
    return F.array_join(F.filter(F.split(host(url), r"\."), lambda p: p != ""), ".")


def is_image_url(url: Col, extensions=fixed.IMAGE_EXTENSIONS) -> Column:
    """The last path segment ends in a known image extension (case-sensitive)."""
    return F.regexp_extract(url_path(url), r"\.([^./]*)$", 1).isin(*extensions)


def complete_scheme(url: Col, reference: Col) -> Column:
    """Give ``//x`` the scheme of the page it stands on."""
    u, ref = as_col(url), as_col(reference)
    bare = u.startswith("//")
    return (F.when(bare & ref.startswith("http://"), F.concat(F.lit("http:"), u))
            .when(bare & ref.startswith("https://"), F.concat(F.lit("https:"), u))
            .otherwise(u))


def split_job(job: Col) -> Column:
    """``agent:encoded-url`` as ``struct<agent, url>``."""
    parts = F.split(as_col(job), ":")
    return F.struct(parts[0].alias("agent"), F.url_decode(parts[1]).alias("url"))


def make_job(agent: Col, url: Col) -> Column:
    return F.concat_ws(":", as_col(agent), F.url_encode(as_col(url)))


def strip_www(domain: Col, exact: bool = False) -> Column:
    """Drop a leading ``www.``; ``exact`` drops the first four characters unseen."""
    d = as_col(domain)
    return F.substring(d, 5, 1 << 30) if exact else F.regexp_replace(d, r"^www\.", "")
