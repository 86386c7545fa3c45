"""URL filters in DataFrame functions alone: rules by host and path, then a list of canonical URLs behind a blocked Bloom filter.

Rules come first; where none fits, a URL is blocked if the list holds its canonical form. The list's blocked Bloom filter
has blocks of 256 bits, of which a URL sets or asks for eight. It is built by a grouped bit_or and has at most MOST_BLOCKS
rows (about 10 MB), whatever the list's length, so it may be broadcast; a longer list passes more false hits. Possible hits
alone reach an exact hash join with the list, first as distinct forms, so that a form which very many pages share is one row
there; pages then meet the forms found by salted keys. Results don't depend on the filter's size.

Rows are judged one by one, repeated ones too. A null URL and one without "://" have an empty host and path, fit no rule and
are on no list: they are allowed. Null entries of the list list nothing. Very long URLs are judged whole. An empty table gives
no rows, an empty list blocks nothing, and further columns of pages are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quorum_spark.operators.scratch import Scratch

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Fixed values: (host, path, verdict).
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
#: First labels of hosts, behind www. or m., whose URLs make up the list of the query.
LISTED_LABELS = ("spam-farm", "cheap-pills", "casino-win", "adult-x", "free-bets", "ads-track")
#: Query parameters that name no content.
TRACKING = "(utm_[^=]*|ref|fbclid|gclid)(=.*)?"
BITS, WORDS, MOST_BLOCKS = 12, 4, 1 << 17
#: Pages of one form are spread over so many keys.
SALTS = 32


def _after(url: Column) -> Column:
    """What follows the first "://"; empty if there is none."""
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(_after(url), F.lit("")), "^[^/?#]*", 0), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(_after(url), F.lit("")), "^[^/?#]*([^?#]*)", 1)


def canonical(url: Column) -> Column:
    """The form that scheme, letter case of the host, www. or m., default ports, trailing slashes, .html, tracking parameters, the order of parameters and fragments don't change. Null where there is no host."""
    host = F.regexp_replace(F.regexp_replace(host_of(url), ":(80|443)?$", ""), "^(www|m)\\.", "")
    path = F.regexp_replace(F.rtrim(path_of(url), F.lit("/")), "\\.html$", "")
    asked = F.split(F.regexp_extract(_after(url), "^[^?#]*\\?([^#]*)", 1), "&")
    kept = F.array_join(F.array_sort(F.filter(asked, lambda p: (p != "") & ~p.rlike(f"^{TRACKING}$"))), "&")
    return F.when(host != "", F.concat(host, path, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise("")))


def rule_of(host: Column, path: Column, rules: tuple) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; nulls where none does. Rules are a short list, a branch each."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def _block(form: str, blocks: int) -> Column:
    return F.pmod(F.xxhash64(form), F.lit(blocks))


def _asked(form: str) -> list[Column]:
    """The bits of a form within its block: two in each of four 64-bit words."""
    h, one = F.xxhash64(form, F.lit(1)), F.lit(1).cast("long")
    bit = lambda k: F.call_function("shiftleft", one, F.shiftright(h, 6 * k).bitwiseAND(63).cast("int"))
    return [bit(2 * k).bitwiseOR(bit(2 * k + 1)) for k in range(WORDS)]


def bloom(forms: DataFrame, blocks: int) -> DataFrame:
    """(block, w0..w3): the blocked Bloom filter of forms (form); blocks without a form have no row."""
    rows = forms.select(_block("form", blocks).alias("block"), *[c.alias(f"w{k}") for k, c in enumerate(_asked("form"))])
    return rows.groupBy("block").agg(*[F.bit_or(f"w{k}").alias(f"w{k}") for k in range(WORDS)])


def judge(pages: DataFrame, listed: DataFrame, rules: tuple = RULES, most_blocks: int = MOST_BLOCKS) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict. pages: page_id, url; listed: url."""
    scratch = Scratch(pages.sparkSession, "urls")
    forms = scratch.cut(listed.select(canonical(F.col("url")).alias("form")).where("form is not null").distinct(), "listed")
    blocks = min(most_blocks, forms.count() * BITS // (64 * WORDS) + 1)
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    rows = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("ruled"), F.when(rule.isNull(), canonical(F.col("url"))).alias("form"))
    passing = F.lit(True)
    for k, bits in enumerate(_asked("form")):
        passing &= F.col(f"w{k}").bitwiseAND(bits) == bits
    asked = rows.withColumn("block", F.when(F.col("form").isNotNull(), _block("form", blocks)))
    asked = asked.join(F.broadcast(bloom(forms, blocks)), "block", "left").withColumn("possible", F.coalesce(F.col("form").isNotNull() & passing, F.lit(False)))
    possible = asked.where("possible").select("page_id", "host", "path", "rule", "form", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).alias("salt"))
    found = possible.select("form").distinct().join(forms.hint("shuffle_hash"), "form", "left_semi")
    found = found.select("form", F.lit(True).alias("on_list"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"))
    sure = possible.join(found, ["form", "salt"], "left").select("page_id", "host", "path", "rule", F.when(F.col("on_list"), "block").otherwise("allow").alias("verdict"))
    rest = asked.where("not possible").select("page_id", "host", "path", "rule", F.coalesce("ruled", F.lit("allow")).alias("verdict"))
    return rest.union(sure)


def listed_pages(pages: DataFrame, labels: tuple = LISTED_LABELS) -> DataFrame:
    """(url) of pages whose host begins with a listed label, www. and m. aside."""
    label = F.regexp_extract(host_of(F.col("url")), "^(?:(?:www|m)\\.)?([^.]*)", 1)
    return pages.where(label.isin(*labels)).select("url")
