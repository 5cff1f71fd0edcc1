"""Expressions over query texts, URLs and IRIs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# What a script's `\s` matches, with the Unicode spaces and the BOM.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000\ufeff"
)


def query_hash(text) -> Column:
    """MD5 of the text without any white space."""
    return F.md5(F.translate(_col(text), WHITE_SPACE, ""))


def bucket_url_child(url, ts_ms) -> Column:
    """`dir(url)/<ts>/`, or `none` for something that is no web address."""
    made = F.concat(F.regexp_replace(_col(url), "[^/]*$", ""), _col(ts_ms).cast("string"), F.lit("/"))
    return F.when(made.contains("http"), made).otherwise(F.lit("none"))


def bucket_url_sibling(url, ts_ms) -> Column:
    """The bucket next to `url`: its last path segment replaced by `<ts>/`."""
    return F.concat(
        F.regexp_replace(_col(url), "[^/]*/[^/]*$", ""), _col(ts_ms).cast("string"), F.lit("/")
    )


def stream_of_inbox(url) -> Column:
    return F.regexp_replace(_col(url), r"/[0-9]+/$", "/")


def expand_iri(term, prefixes) -> Column:
    """`<iri>` or `prefix:local` to the full IRI; an unknown prefix gives an empty string.

    `prefixes` is a map column. Only the text up to a second colon counts as local part.
    """
    term = F.trim(_col(term))
    parts = F.split(term, ":")
    named = F.concat(F.try_element_at(_col(prefixes), parts[0]), F.get(parts, F.lit(1)))
    return F.when(term.startswith("<"), F.substring(
        term, F.lit(2), F.greatest(F.length(term) - 2, F.lit(0))
    )).otherwise(F.coalesce(named, F.lit("")))


def storage_root(url) -> Column:
    return F.substring_index(_col(url), "/", 3)


def meta_url(url) -> Column:
    """Description document of the container that holds `url`."""
    return F.regexp_replace(_col(url), "/[^/]*$", "/.meta")


def retarget_query(text, old, new) -> Column:
    """First occurrence of `old` in the text replaced by `new`, taken literally."""
    text, old, new = _col(text), _col(old), _col(new)
    at = F.position(old, text)
    return F.when(at > 0, F.overlay(text, new, at, F.length(old))).otherwise(text)


def joined_text(*values) -> Column:
    """Values as one text from which each could be read again: separators in them are escaped, and
    null differs from every text."""
    if not values:
        return F.lit("")
    parts = [F.regexp_replace(_col(v).cast("string"), r"([\\|])", r"\\$1") for v in values]
    return F.concat_ws("|", *[F.coalesce(p, F.lit("\\N")) for p in parts])


def event_iri(query_hash_, var, start, base) -> Column:
    """Id of a result event. It is a digest of what the event is, so re-runs write the same."""
    key = F.concat_ws("|", _col(query_hash_), _col(var), _col(start).cast("string"))
    return F.concat(F.lit(base), F.sha2(key, 256))


def bucket_ts_of_url(url) -> Column:
    """The number in the last path segment of a bucket URL, as epoch milliseconds."""
    return F.try_element_at(F.split(_col(url), "/"), F.lit(-2)).try_cast("bigint")


def is_container(url) -> Column:
    return _col(url).endswith("/")
