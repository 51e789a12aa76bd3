"""Derivations from one page view."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from stallwise.functions.text import text, trim

# Channels, with the text in the host that marks them, in order of precedence.
CHANNELS = (
    ("WhatsApp", "whatsapp"),
    ("Instagram", "instagram"),
    ("Facebook", r"facebook|fb\."),
    ("Google", "google"),
)
# URLs of schemes that need a host (any letter case), and all other URLs, whose host may be empty.
# Both leave out user, password and port; neither matches a host with blanks or reserved characters.
WEB_SCHEME = r"(?i)^(?:https?|ftp|wss?):"
WEB_URL = WEB_SCHEME + r"[/\\]*(?:[^/\\?#]*@)?(\[[^\]]*\]|[^/\\?#:@\s<>^|%\[\]]+)(?::[0-9]*)?(?:[/\\?#]|$)"
OTHER_URL = r"^[A-Za-z][A-Za-z0-9+.\-]*:(?://(?:[^/?#]*@)?([^/?#:@\s<>^|%\[\]]*)(?::[0-9]*)?(?:[/?#]|$)|(?!//))"
# Fixed value: hosts of the hosting service count as the shop itself.
OWN_HOST_SUFFIX = "onrender.com"


def utc_day(ts: Column) -> Column:
    """Date of an instant in UTC, whatever the session's time zone."""
    micros = F.unix_micros(ts)
    day = F.lit(86_400_000_000)
    return F.date_from_unix_date(((micros - F.pmod(micros, day)) / day).cast("int")).cast("string")


def page_kind(path: Column) -> Column:
    """``shop`` for the front page, ``product`` for a piece's page, NULL for what is not counted."""
    return F.when(path == "/", "shop").when(path.rlike("^/piece/[^/]+/?$"), "product")


def visitor_id(ip: Column, user_agent: Column, day: Column, salt: str) -> Column:
    """Daily changing 32-digit hash of address and browser."""
    raw = F.concat(F.concat_ws("|", text(ip), text(user_agent), day), F.lit(salt))
    return F.substring(F.sha2(raw, 256), 1, 32)


def url_host(url: Column) -> Column:
    """Host name of an absolute URL, NULL where the text is not one."""
    u = trim(text(url))
    web = F.lower(F.regexp_extract(u, WEB_URL, 1))
    other = F.when(u.rlike(OTHER_URL), F.regexp_extract(u, OTHER_URL, 1))
    return F.when(u.rlike(WEB_SCHEME), F.when(web != "", web)).otherwise(other)


def referrer_channel(referer: Column, own_host: Column | str) -> Column:
    """Where a visit came from: a named channel, a host, or ``direct``."""
    host = F.regexp_replace(url_host(referer), r"^www\.", "")
    own = own_host if isinstance(own_host, Column) else F.lit(own_host)
    direct = host.isNull() | host.endswith(OWN_HOST_SUFFIX) | F.coalesce(host == own, F.lit(False))
    out = F.when(direct, "direct")
    for name, pattern in CHANNELS:
        out = out.when(host.rlike(pattern), name)
    return out.otherwise(F.substring(host, 1, 60))
