"""URL filters: prefix rules, then listed canonical URLs through a blocked Bloom filter.

A URL's canonical form is its lower-cased host without ``www.`` and its path without a last ``/``.
Listed URLs set ``BITS`` bits in one 64-bit block of a filter of at most ``MAX_BLOCKS`` blocks; the
filter's rows (16 bytes a block, so its size is bounded however long the list) are broadcast to the
pages. Pages whose bits are all set are possible hits; only they are shuffled, to an exact join
with the list by the canonical URL, which removes false positives. A longer list
than the filter was made for lets more pages through to the exact join; the result is the same.

Only DataFrame functions run. A hot host or URL is a hot key of the exact join only, a plain join
of two tables that can be split; pages without a hit never move.

Defined results: a null URL or one without ``://`` has an empty host and path, fits no rule, is on no
list and is allowed; repeated rows each come back; extra columns are ignored; an empty list
blocks nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provenant.llm import common as C

# The rules (host, path, verdict).
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)
BITS = 4
MAX_BLOCKS = 1 << 18
URLS_A_BLOCK = 5


def _rest(url):
    """The URL behind its first ``://``, or null."""
    return F.when(F.instr(url, "://") > 0, F.substring_index(F.expr("substring(url, instr(url, '://') + 3)"), "#", 1))


def parsed(pages: DataFrame) -> DataFrame:
    """Add host, path and canonical to rows with a column url."""
    rest = F.substring_index(_rest(F.col("url")), "?", 1)
    host = F.translate(F.substring_index(rest, "/", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.expr("substring(rest, length(substring_index(rest, '/', 1)) + 1)")
    out = pages.withColumn("rest", rest).withColumn("host", F.coalesce(host, F.lit(""))).withColumn("path", F.coalesce(path, F.lit(""))).drop("rest")
    return out.withColumn("canonical", F.concat(F.regexp_replace("host", "^www\\.", ""), F.regexp_replace("path", "/$", "")))


def _rule():
    """(rule, verdict) of the longest rule that fits, as a struct; null if none does."""
    out = None
    for host, path, verdict in sorted(RULES, key=lambda r: -len(r[0] + r[1])):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        found = F.struct(F.lit(host + path).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, found) if out is None else out.when(fits, found)
    return out


def _mask():
    """BITS bits of a 64-bit word, from a second hash of the canonical URL."""
    bits = F.lit(0).cast("long")
    for k in range(BITS):
        bits = bits.bitwiseOR(F.expr(f"shiftleft(1L, cast((shiftright(xxhash64(canonical, 1), {6 * k}) & 63) as int))"))
    return bits


def bloom(listed: DataFrame) -> tuple[DataFrame, int]:
    """The filter (block, bits) of a table with a column canonical, and its number of blocks."""
    blocks = 64
    while blocks < MAX_BLOCKS and blocks * URLS_A_BLOCK < listed.count():
        blocks *= 2
    place = F.expr(f"xxhash64(canonical) & {blocks - 1}L")
    return listed.groupBy(place.alias("block")).agg(F.bit_or(_mask()).alias("bits")), blocks


def filter_urls(pages: DataFrame, listed: DataFrame, page_id: str = "page_id", url: str = "url") -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, listed (the method's finding).

    ``listed`` has canonical URLs in its column ``canonical``; nulls and repeats don't matter.
    """
    listed = C.written(listed.select("canonical").where("canonical is not null and canonical <> ''").distinct(), "listed")
    bits, blocks = bloom(listed)
    rows = parsed(pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url")))
    rows = rows.withColumn("found", _rule()).select("page_id", "host", "path", "canonical", F.col("found.rule").alias("rule"), F.col("found.verdict").alias("ruled"),
                                                   F.expr(f"xxhash64(canonical) & {blocks - 1}L").alias("block"), _mask().alias("mask"))
    # The filter has at most MAX_BLOCKS rows of 16 bytes.
    probed = rows.join(F.broadcast(bits), "block", "left").withColumn("maybe", F.coalesce((F.col("bits").bitwiseAND(F.col("mask")) == F.col("mask")) & (F.col("host") != ""), F.lit(False)))
    probed = C.written(probed.select("page_id", "host", "path", "canonical", "rule", "ruled", "maybe"), "probed")
    hits = probed.where("maybe").join(listed.withColumn("listed", F.lit(True)), "canonical", "left").withColumn("listed", F.coalesce("listed", F.lit(False)))
    misses = probed.where("not maybe").withColumn("listed", F.lit(False))
    out = hits.select(misses.columns).unionByName(misses)
    verdict = F.coalesce("ruled", F.when(F.col("listed"), "block").otherwise("allow"))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "listed")


def listed_urls(pages: DataFrame) -> DataFrame:
    """The query's list, from the pages themselves: canonical URLs of pages whose title is junk
    (three or more words that end in ``!!`` or ``***``, or that are set off by ``|``)."""
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    junk = F.size(F.split(title, r"!!|\*\*\*|\|")) > 3
    return parsed(pages.where(junk).select("url")).select("canonical")


ORACLE = r"""
with u as (select page_id, html, case when strpos(url, '://') > 0 then split_part(split_part(substr(url, strpos(url, '://') + 3), '#', 1), '?', 1) end r from pages),
p as (select page_id, html, coalesce(translate(split_part(r, '/', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') host,
             coalesce(substr(r, length(split_part(r, '/', 1)) + 1), '') path from u),
c as (select *, regexp_replace(host, '^www\.', '') || regexp_replace(path, '/$', '') canonical from p),
l as (select distinct canonical from c where canonical <> ''
      and len(regexp_split_to_array(regexp_extract(html, '<title>([^<]*)</title>', 1), '!!|\*\*\*|\|')) > 3),
rules(h, q, v) as (values ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
fit as (select page_id, arg_max(h || q, length(h || q)) rule, arg_max(v, length(h || q)) v from c, rules
        where (host = h or ends_with(host, '.' || h)) and starts_with(path, q) group by page_id)
select c.page_id, c.host, c.path, fit.rule,
       coalesce(fit.v, case when l.canonical is not null and c.host <> '' then 'block' else 'allow' end) verdict,
       (l.canonical is not null and c.host <> '') listed
from c left join fit on fit.page_id = c.page_id left join l on l.canonical = c.canonical
"""
