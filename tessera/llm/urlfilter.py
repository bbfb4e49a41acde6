"""URL filter: a blocked Bloom filter in front of an exact hash join.

URLs are compared in canonical form: lower case host without ``www.``, ``m.`` or a default
port; no scheme, fragment, user or trailing slash; no tracking parameters (``utm_*``,
``ref``, ``gclid``, ``fbclid``, ``sessionid``); the others in sorted order.

The filter is a relation of blocks of 512 bits: (block, w0 ... w7).  A key's hash chooses
its block and one bit in each of ``BITS`` of the block's eight words, so that a probe touches one
row.  Probing is an equi-join on the block number: Spark broadcasts the blocks while
their written size is below its limit, and shuffles by block beyond it (pages without a URL are spread
over all blocks).  What doesn't pass goes straight to the result, without a further join; only what passes is
joined with the list itself on the canonical URL, which removes the false positives.

The corpus has no list, so the query makes one from ``pages``, by the MD5 of the canonical URL: a sixteenth of the URLs are
listed, and as many that are on no page (a sixteenth of the URLs, at other hosts).

Defined results.  A null URL, or one without a host, is on no list: the page is
kept.  Null and empty list entries are ignored, repeated ones are one.  Repeated pages are
kept or removed one by one.  Ties don't arise; URLs of any length are compared whole.  Extra columns are kept under any name.  An
empty list keeps everything; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, named, own_columns, own_name

KEYS_PER_BLOCK = 40
BITS = 8
#: First hexadecimal digit of the MD5 of the URLs that the query lists, and of those that it lists at a host without pages.
LISTED, ABSENT = "0", "1"
NOWHERE = "absent."
TRACKING = "^(utm_[^=]*|ref|gclid|fbclid|sessionid)(=.*)?$"


def _host_path_query(url: Column) -> tuple[Column, Column, Column]:
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), "^[A-Za-z][A-Za-z0-9+.-]*://", ""), "#.*$", "")
    host = F.lower(F.regexp_extract(bare, "^([^/?]*)", 1))
    host = F.regexp_replace(F.regexp_replace(F.regexp_replace(host, "^.*@", ""), ":(80|443)$", ""), "^(www|m)[.]", "")
    path = F.regexp_replace(F.regexp_extract(bare, "^[^/?]*([^?]*)", 1), "/+$", "")
    return host, path, F.regexp_extract(bare, "[?](.*)$", 1)


def canonical(url: Column) -> Column:
    """The canonical form; null for null, empty, and URLs without a host."""
    host, path, query = _host_path_query(url)
    params = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(TRACKING)))
    tail = F.when(F.size(params) > 0, F.concat(F.lit("?"), F.array_join(params, "&"))).otherwise("")
    return F.when(host != "", F.concat(host, path, tail))


def _bits(h: Column) -> list[Column]:
    """The mask of each of the eight words: one bit a word, from six bits of a second hash."""
    return [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(h, 6 * i).bitwiseAND(63).cast("int")) for i in range(BITS)]


def bloom_blocks(keys: DataFrame, n_blocks: int) -> DataFrame:
    """(block, w0 ... w7) from a column ``key``; mergeable by a bitwise or of equal blocks."""
    first, second = F.xxhash64("key"), F.xxhash64("key", F.lit(1))
    masks = [m.alias(f"w{i}") for i, m in enumerate(_bits(second))]
    return keys.select(F.pmod(first, F.lit(n_blocks)).alias("block"), *masks).groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(BITS)])


def filter_listed(pages: DataFrame, listed: DataFrame, url: str = "url") -> DataFrame:
    """``pages`` (with all columns) without those whose canonical URL is in ``listed`` (column ``url``)."""
    keys = materialize(listed.select(canonical(F.col("url")).alias("key")).filter("key is not null").distinct(), "listed")
    n_blocks = max(1, -(-keys.count() // KEYS_PER_BLOCK))
    key, at, block, exact_key, *words = (own_name(pages, n) for n in ("key", "at", "block", "listed", *(f"w{i}" for i in range(BITS))))
    blocks = materialize(bloom_blocks(keys, n_blocks), "bloom").select(F.col("block").alias(block), *[F.col(f"w{i}").alias(w) for i, w in enumerate(words)])
    place = F.coalesce(F.when(F.col(key).isNotNull(), F.xxhash64(key)), F.monotonically_increasing_id())  # a page without a URL probes any block, in vain
    rows = pages.withColumn(key, canonical(named(url))).withColumn(at, F.pmod(place, F.lit(n_blocks)))
    passed = F.col(key).isNotNull() & F.col(block).isNotNull()
    for w, m in zip(words, _bits(F.xxhash64(key, F.lit(1))), strict=True):
        passed &= F.col(w).bitwiseAND(m) == m
    probed = rows.join(blocks, F.col(at) == F.col(block), "left")
    passed = F.coalesce(passed, F.lit(False))
    maybe = probed.filter(passed).join(keys.select(F.col("key").alias(exact_key)), F.col(key) == F.col(exact_key), "left_anti")
    return probed.filter(~passed).select(own_columns(pages)).unionAll(maybe.select(own_columns(pages)))


def listed_urls(pages: DataFrame) -> DataFrame:
    """The query's list (url): see above."""
    digit = F.substring(F.md5("url"), 1, 1)
    urls = pages.select(canonical(F.col("url")).alias("url")).filter("url is not null")
    return urls.filter(digit.isin(LISTED, ABSENT)).select(F.when(digit == LISTED, F.col("url")).otherwise(F.concat(F.lit(NOWHERE), F.col("url"))).alias("url"))


def op6_url_filter(spark, sf_dir):
    """Pages whose canonical URL isn't on the list."""
    from .common import table

    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    kept = filter_listed(pages, listed_urls(pages))
    return kept.select("page_id", "url", canonical(F.col("url")).alias("canonical_url"))


ORACLE = f"""
WITH b AS (SELECT page_id, url, regexp_replace(regexp_replace(trim(url), '^[A-Za-z][A-Za-z0-9+.-]*://', ''), '#.*$', '') AS bare FROM pages),
c AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(lower(regexp_extract(bare, '^([^/?]*)', 1)), '^.*@', ''), ':(80|443)$', ''), '^(www|m)[.]', '') AS host,
  regexp_replace(regexp_extract(bare, '^[^/?]*([^?]*)', 1), '/+$', '') AS path,
  list_sort(list_filter(string_split(regexp_extract(bare, '[?](.*)$', 1), '&'), lambda p : p <> '' AND NOT regexp_matches(p, '{TRACKING}'))) AS params FROM b),
d AS (SELECT page_id, url, host, CASE WHEN host <> '' THEN host || path || CASE WHEN len(params) > 0 THEN '?' || array_to_string(params, '&') ELSE '' END END AS canonical_url FROM c),
l AS (SELECT CASE left(md5(canonical_url), 1) WHEN '{LISTED}' THEN canonical_url ELSE '{NOWHERE}' || canonical_url END AS listed FROM d WHERE canonical_url IS NOT NULL AND left(md5(canonical_url), 1) IN ('{LISTED}', '{ABSENT}'))
SELECT page_id, url, canonical_url FROM d
WHERE canonical_url IS NULL OR canonical_url NOT IN (SELECT listed FROM l)"""
