"""Canonical form of page addresses: two urls that lead to the same page get the same form."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from weirmill.functions.text import strip

_PARTS = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$"

#: Fixed value: query parameters that only record campaign, referrer, click or session.
TRACKING_PARAM = (
    r"^(?:utm_.*|mtm_.*|pk_.*|hsa_.*|mc_cid|mc_eid|gclid|gclsrc|gbraid|wbraid|dclid|fbclid|msclkid|yclid|twclid|ttclid|igshid|"
    r"li_fat_id|_ga|_gl|_hsenc|_hsmi|mkt_tok|vero_id|cmpid|campaign|campaign_id|ref|ref_src|ref_url|referer|referrer|source|src|"
    r"sid|sessid|session|session_id|sessionid|phpsessid|jsessionid|aspsessionid.*|cfid|cftoken|click_id|clickid|spm|trk|icid)$"
)
_INDEX_FILE = r"(?i)/(?:index|default|home)\.(?:html?|xhtml|shtml|php[0-9]?|aspx?|jspx?|cfm|cgi)$"


def _unescape(part: Column) -> Column:
    """Percent escapes decoded, except those of reserved characters, which get upper-case hex digits."""
    kept = F.regexp_replace(part, r"%(?![0-9A-Fa-f]{2})", "%25")
    reserved = F.regexp_replace(kept, r"(?i)%(2f|3f|23|26|3d|25|3b|2b|40|3a|2c|24|21|27|28|29|2a|5b|5d|20|0[0-9a-f]|1[0-9a-f]|7f)", "%25$1")
    decoded = F.coalesce(F.try_url_decode(F.regexp_replace(reserved, r"\+", "%2B")), part)
    return F.when(part.contains("%"), decoded).otherwise(part)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.transform(F.array(value), body)[0]


def _form(part: Column) -> Column:
    """The canonical form of scheme, host, path and query."""
    host = F.regexp_replace(F.regexp_replace(part["host"], r"^(?:www\.)+", ""), r"\.(?=$|:)", "")
    host = F.when(part["scheme"] == "http", F.regexp_replace(host, r":(?:80)?$", "")).otherwise(F.regexp_replace(host, r":(?:443)?$", ""))
    path = _let(F.regexp_replace(part["path"], r"(?i);(?:jsessionid|phpsessid|sid)=[^/;]*", ""), _unescape)
    path = F.regexp_replace(F.regexp_replace(F.regexp_replace(path, r"/{2,}", "/"), _INDEX_FILE, "/"), r"/+$", "")
    params = F.filter(
        F.split(part["query"], "[&;]"), lambda p: (p != "") & ~F.lower(F.regexp_extract(p, r"^([^=]*)", 1)).rlike(TRACKING_PARAM)
    )
    query = F.when(part["query"] == "", F.lit("")).otherwise(F.array_join(F.array_sort(F.transform(params, _unescape)), "&"))
    return _let(query, lambda q: F.concat(host, path, F.when(q != "", F.concat(F.lit("?"), q)).otherwise(F.lit(""))))


def canonical_url(url: Column) -> Column:
    """The page a url leads to, as ``host/path?params``.

    Ignored: scheme, ``www.``, case of the host, default port, escaping, final slash or index file, fragment, order of
    parameters and tracking parameters. Null and blank urls give null; text that is no url keeps its trimmed form.
    """
    pick = lambda u, i: F.regexp_extract(u, _PARTS, i)
    parts = lambda u: F.struct(
        F.lower(pick(u, 1)).alias("scheme"), F.lower(pick(u, 2)).alias("host"), pick(u, 3).alias("path"), pick(u, 4).alias("query")
    )
    return _let(strip(url), lambda u: F.when(u != "", _let(parts(u), _form)))
