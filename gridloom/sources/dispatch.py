"""Which reader a source string calls for, from the string alone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Hosts whose signed URLs the object store reads itself.
AZURE_HOST = r"\.(blob|dfs)\.core\.windows\.net$"


def scheme(src: Column) -> Column:
    """Lower-case scheme; a single letter is a drive of a local path."""
    found = F.lower(F.regexp_extract(src, r"^([A-Za-z][A-Za-z0-9+.\-]*)://", 1))
    return F.when(F.length(found) > 1, found)


def authority(src: Column) -> Column:
    return F.lower(F.regexp_extract(src, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1))


def host(src: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(authority(src), r"^.*@", ""), r":\d*$", "")


def query(src: Column) -> Column:
    """The query without the question mark, empty if there is none."""
    return F.regexp_extract(src, r"^[^?#]*\?([^#]*)", 1)


def _has(src: Column, *names: str) -> Column:
    keys = F.transform(F.split(query(src), "&"), lambda kv: F.lower(F.substring_index(kv, "=", 1)))
    return F.arrays_overlap(keys, F.array(*[F.lit(n.lower()) for n in names]))


def presigned(src: Column) -> Column:
    """A signed http(s) URL outside Azure: AccessKeyId and Signature, or one of the two newer signatures."""
    signed = (_has(src, "AccessKeyId") & _has(src, "Signature")) | _has(src, "X-Amz-Signature", "X-Goog-Signature")
    return F.coalesce(scheme(src).isin("http", "https"), F.lit(False)) & ~host(src).rlike(AZURE_HOST) & signed


def azure_sas(src: Column) -> Column:
    """An Azure https URL with a pair that begins with ``sig=`` (in this case only)."""
    return F.coalesce(scheme(src) == "https", F.lit(False)) & host(src).rlike(AZURE_HOST) & F.exists(F.split(query(src), "&"), lambda kv: kv.startswith("sig="))


def kind(src: Column) -> Column:
    return F.when(presigned(src), "http").when(scheme(src).isNotNull() & (scheme(src) != "file"), "store").otherwise("local")
