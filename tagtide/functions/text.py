"""Column functions over names, links and author keys."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tagtide.constants import MAX_TAG_LENGTH

# The characters that count as white space at the ends of a text.
_EDGE_SPACE = (
    "\t\n\x0b\f\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000\ufeff"
)
_TAG_SHAPE = r"\A[\p{L}\p{N}_]{1,%d}\z" % MAX_TAG_LENGTH
# Scheme, optional user part, host, optional port, then a path, query, fragment or the end.
_HTTP_HOST = r"(?i)^https?:[/\\]*(?:[^/?#]*@)?([^\s/:?#@<>\[\]\\^|%]+)(?::[0-9]*)?(?:[/?#]|$)"


def trim_edges(text: Column) -> Column:
    return F.btrim(text, F.lit(_EDGE_SPACE))


def nfkc(text: Column) -> Column:
    """Compatibility composition, through the ICU library Spark ships for collations."""
    return F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), text, F.lit(True))


def casefold_tag(name: Column) -> Column:
    """NFKC then lower case. Plain ASCII names skip the normaliser."""
    return (
        F.when(name.isNull(), F.lit(None).cast("string"))
        .when(name.rlike(r"\A\p{ASCII}*\z"), F.lower(name))
        .otherwise(F.lower(nfkc(name)))
    )


def _fits(text: Column) -> Column:
    # The length limit counts characters beyond the basic plane twice.
    units = F.length(text) + F.length(F.regexp_replace(text, r"[\x{0}-\x{FFFF}]", ""))
    return (F.length(text) <= MAX_TAG_LENGTH // 2) | (units <= MAX_TAG_LENGTH)


def tag_display(raw: Column) -> Column:
    """The tag as written, without edge space and one leading '#'; NULL if unusable."""
    edged = trim_edges(raw)
    shown = F.when(F.startswith(edged, F.lit("#")), F.substr(edged, F.lit(2))).otherwise(edged)
    return F.when(shown.rlike(_TAG_SHAPE) & _fits(shown), shown)


def clean_tag_input(raw: Column) -> Column:
    """Percent-decoded, trimmed, checked and casefolded tag name, else NULL."""
    decoded = F.try_url_decode(F.replace(raw, F.lit("+"), F.lit("%2B")))
    return casefold_tag(tag_display(decoded))


def origin_host(uri: Column) -> Column:
    """Lower-case host of an http(s) object id, else NULL."""
    return F.nullif(F.lower(F.regexp_extract(uri, _HTTP_HOST, 1)), F.lit(""))


def author_hash(acct: Column, salt: str) -> Column:
    """Sixteen bytes of the salted SHA-256 of a handle: enough to count with."""
    digest = F.sha2(F.concat(F.lit(salt + " "), F.lower(acct)), 256)
    return F.unhex(F.substring(digest, 1, 32))


def hash_hex(value: Column) -> Column:
    return F.lower(F.hex(value))


def tag_list(tags: Column) -> Column:
    """Casefolded distinct names of an array of tag structs, first order kept."""
    names = F.transform(F.coalesce(tags, F.array()), lambda t: casefold_tag(t["name"]))
    return F.array_distinct(F.filter(names, lambda n: n.isNotNull() & (n != "")))


def epoch_seconds(iso: Column) -> Column:
    """Whole seconds of an ISO-8601 text, else NULL. Fractions are floored."""
    shaped = F.when(iso.rlike(r"^\s*[+-]?\d{4,6}-\d{2}(-\d{2})?"), iso)
    return F.unix_seconds(F.try_to_timestamp(shaped))


def parse_int_prefix(text: Column) -> Column:
    """The leading integer of a text, as counters sent as strings need it."""
    return F.regexp_extract(text, r"^\s*([+-]?\d+)", 1).try_cast("bigint")
