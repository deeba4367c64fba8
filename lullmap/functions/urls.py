"""URL identity, redaction and listing families as column expressions."""

from __future__ import annotations

from collections.abc import Sequence
from urllib.parse import quote, unquote

from pyspark.sql import Column
from pyspark.sql import functions as F

# The parts of a URL, what hides a secret, the listing families and
# watch addresses.
URL_PARTS = r"(?s)^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"
SEPARATOR = "\u0001"
HIDDEN = "<redacted>"
SCHEME_TOKEN = r"(?iU)\b[a-z][a-z0-9+.\-]*://[^\s'\"]+"
BARE_CREDENTIALS = r"(?iU)\b[\w.\-]+:[^\s\"]*@([\w.\-]+(?::\d+)?)"
BRACKETED = r"^(?:[^\[\]]*@)?\[(?:[0-9A-Fa-f:.]+(?:%[^\[\]]*)?|[vV][0-9A-Fa-f]+\.[^\[\]]+)\](?::[^\[\]]*)?$"
DEFAULT_PORTS = {"http": 80, "https": 443}
MAX_PORT = 65535
FAMILIES = {
    "twitch_channel": r"(?i)^https?://(?:[a-z]{1,3}\.)?twitch\.tv/([A-Za-z0-9_]{2,25})/videos(?:[/?#]|$)",
    "youtube_playlist": (
        r"(?i)^https?://(?:www\.|m\.)?youtube\.com/(?:playlist\?list=|watch\?.*?[?&]list=)"
        r"([A-Za-z0-9_-]{10,60})"
    ),
    "youtube_channel": (
        r"(?i)^https?://(?:www\.|m\.)?youtube\.com/"
        r"(@[A-Za-z0-9_.-]{3,30}|channel/UC[A-Za-z0-9_-]{10,40}"
        r"|c/[A-Za-z0-9_.-]{1,40}|user/[A-Za-z0-9_.-]{1,40})"
        r"(?:/(videos|shorts|streams))?(?:[/?#]|$)"
    ),
}
DEFAULT_TABS = {"twitch_channel": "archives", "youtube_channel": "videos", "youtube_playlist": "videos"}
WATCH = {"twitch": "https://www.twitch.tv/videos/", "youtube": "https://www.youtube.com/watch?v="}


def url_parts(c: Column) -> Column:
    """Array of scheme, authority, path, query and fragment; a single element for no URL.

    One pattern match. The functions below use the parts many times, so a table job adds
    them as a column first and hands that in.
    """
    return F.split(F.regexp_replace(c, URL_PARTS, SEPARATOR.join(f"${i}" for i in range(1, 6))), SEPARATOR)


def _is_url(parts: Column) -> Column:
    return F.size(parts) == 5


def _authority(netloc: Column) -> tuple[Column, Column, Column, Column]:
    """Userinfo (null if none), place after it, host and port text (empty if none)."""
    place = F.substring_index(netloc, "@", -1)
    user = F.when(
        F.instr(netloc, "@") > 0, F.substring(netloc, F.lit(1), F.length(netloc) - F.length(place) - 1)
    )
    bracketed = place.startswith("[")
    host = F.when(
        bracketed, F.substring_index(F.substring(place, 2, 1 << 30), "]", 1)
    ).otherwise(F.substring_index(place, ":", 1))
    tail = F.when(bracketed, F.concat(F.lit("x"), F.substring_index(place, "]", -1))).otherwise(place)
    colon = F.instr(tail, ":")
    port = F.when(colon > 0, F.substring(tail, colon + 1, F.lit(1 << 30))).otherwise("")
    return user, place, host, port


def _broken(port: Column) -> Column:
    digits = F.translate(port, "0123456789", "") == ""
    return (port != "") & (~digits | F.coalesce(port.try_cast("long") > MAX_PORT, F.lit(True)))


def canonical_url(c: Column, parts: Column | None = None) -> Column:
    """One key for the addresses of one resource.

    Scheme and host in lower case, no default port, no trailing slash, no fragment;
    credentials and query only as hashes, credentials first. Text that is no URL, or has
    a broken port, stays as it is.
    """
    parts = url_parts(c) if parts is None else parts
    part = lambda i: F.get(parts, F.lit(i))
    user, _, host, port = _authority(part(1))
    scheme, query = F.lower(part(0)), part(3)
    number = port.try_cast("int")
    usual = F.lit(False)
    for name, default in DEFAULT_PORTS.items():
        usual = usual | ((scheme == name) & (number == default))
    shown_port = F.when((number > 0) & ~usual, F.concat(F.lit(":"), number.cast("string")))
    path = F.rtrim(part(2), F.lit("/"))
    pair = F.when(F.instr(user, ":") > 0, user).otherwise(F.concat(user, F.lit(":")))
    tags = F.concat_ws(
        "&",
        F.when(user.isNotNull(), F.concat(F.lit("u="), F.substring(F.sha1(pair), 1, 8))),
        F.when(query != "", F.concat(F.lit("q="), F.substring(F.sha1(query), 1, 12))),
    )
    tagged = user.isNotNull() | (query != "")
    key = F.concat(
        scheme,
        F.lit("://"),
        F.lower(host),
        F.coalesce(shown_port, F.lit("")),
        F.when(path == "", F.lit("/")).otherwise(path),
        F.when(tagged, F.concat(F.lit("?"), tags)).otherwise(""),
    )
    return F.when(_is_url(parts) & ~_broken(port), key).otherwise(c)


def redact_url(c: Column, parts: Column | None = None) -> Column:
    """Hide credentials, query and fragment of a URL; anything else passes through.

    Of a URL whose authority has brackets but no address in them only the scheme is shown.
    """
    parts = url_parts(c) if parts is None else parts
    part = lambda i: F.get(parts, F.lit(i))
    user, place, host, port = _authority(part(1))
    number = port.try_cast("int")
    shown = F.when(_broken(port), place).otherwise(
        F.concat(
            F.when(host == "", place).otherwise(F.lower(host)),
            F.when(number > 0, F.concat(F.lit(":"), number.cast("string"))).otherwise(""),
        )
    )
    masked = F.concat(
        F.lower(part(0)),
        F.lit("://"),
        F.when(user.isNotNull(), F.lit(HIDDEN + "@")).otherwise(""),
        shown,
        part(2),
        F.when(part(3) != "", F.lit("?" + HIDDEN)).otherwise(""),
        F.when(part(4) != "", F.lit("#" + HIDDEN)).otherwise(""),
    )
    unreadable = part(1).rlike(r"[\[\]]") & ~part(1).rlike(BRACKETED)
    hidden = F.concat(part(0), F.lit("://" + HIDDEN))
    return F.when(_is_url(parts) & (part(1) != ""), F.when(unreadable, hidden).otherwise(masked)).otherwise(c)


def redact_text(c: Column, secrets: Sequence[str] = ()) -> Column:
    """Hide secrets of every URL in a text, and bare ``user:password@host`` credentials.

    Known ``secrets`` are hidden first, also where they stand percent-encoded or decoded.
    """
    for secret in sorted(filter(None, secrets)):
        for form in dict.fromkeys((secret, unquote(secret), quote(secret, safe=""))):
            c = F.replace(c, F.lit(form), redact_url(F.lit(secret)))
    tokens = F.regexp_extract_all(c, F.lit(SCHEME_TOKEN), F.lit(0))
    found = F.transform(tokens, lambda t: F.struct(t.alias("url"), url_parts(t).alias("parts")))
    masked = F.transform(found, lambda t: redact_url(t["url"], t["parts"]))
    woven = F.zip_with(
        F.split(c, SCHEME_TOKEN), masked, lambda gap, url: F.concat(gap, F.coalesce(url, F.lit("")))
    )
    swept = F.when(c.contains("://"), F.array_join(woven, "")).otherwise(c)
    return F.when(c.contains("@"), F.regexp_replace(swept, BARE_CREDENTIALS, HIDDEN + "@$1")).otherwise(swept)


def classify_listing_url(c: Column) -> Column:
    """Struct of listing family, listed name and tab; null for other addresses."""
    url = F.trim(c)
    found = F.lit(None)
    for family, pattern in reversed(FAMILIES.items()):
        tab = F.lit(DEFAULT_TABS[family])
        if family == "youtube_channel":
            given = F.lower(F.regexp_extract(url, pattern, 2))
            tab = F.when(given != "", given).otherwise(tab)
        row = F.struct(
            F.lit(family).alias("family"),
            F.regexp_extract(url, pattern, 1).alias("name"),
            tab.alias("tab"),
        )
        found = F.when(url.rlike(pattern), row).otherwise(found)
    return found


def entry_url(video_id: Column, platform: Column) -> Column:
    """Watch address of a listed entry."""
    return F.when(
        platform == "youtube", F.concat(F.lit(WATCH["youtube"]), video_id)
    ).otherwise(F.concat(F.lit(WATCH["twitch"]), F.regexp_replace(video_id, "^v", "")))
