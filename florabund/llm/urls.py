"""URL filter: a blocked Bloom filter of listed canonical URLs, then an exact hash join of what it lets pass. DataFrame functions only.

The filter is a table of 256-bit blocks (four longs), one bit set in each long per URL. A URL
touches one block, so probing is one broadcast lookup. Its size follows the list up to
`max_blocks`, a fixed bound of the broadcast; a longer list only passes more false positives on to the
exact join, which takes them out again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

#: (host, path, verdict): a rule fits a host and its subdomains where the path starts with the rule's path.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
#: Labels of hosts whose pages make the default list.
SPAM_LABELS = ["spam-farm", "cheap-pills", "casino-win", "free-bets", "ads-track", "adult-x"]
#: Queries' parameters that do not select content.
TRACKING = "utm_[a-z]+|ref|fbclid|gclid"
#: A hot URL's rows go to this many tasks in the exact join.
SALTS = 16
WORDS = 4


def _after(url: str | Column) -> Column:
    """What follows the first ://, or null."""
    u = F.col(url) if isinstance(url, str) else url
    at = F.instr(u, "://")
    return F.when(at > 0, F.substr(u, at + 3))


def host_of(url: str | Column) -> Column:
    """Host: after the first :// up to / ? # or the end, A-Z lower-cased; empty where there is none."""
    raw = F.regexp_extract(_after(url), "^[^/?#]*", 0)
    return F.coalesce(F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: str | Column) -> Column:
    """Path: after the host up to ? # or the end; empty where there is none."""
    return F.coalesce(F.regexp_extract(_after(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: str | Column) -> Column:
    """host and path without www. or m., a closing slash or .html, plus the query without tracking parameters; empty for no URL."""
    host = F.regexp_replace(host_of(url), "^(www|m)\\.", "")
    path = F.regexp_replace(path_of(url), "(/|\\.html?)$", "")
    query = F.regexp_extract(_after(url), "^[^?#]*\\?([^#]*)", 1)
    kept = F.array_join(F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(f"^({TRACKING})(=|$)"))), "&")
    out = F.concat(host, path, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(""))
    return F.when(host_of(url) == "", "").otherwise(F.coalesce(out, F.lit("")))


def rule_for(host: str, path: str, rules: list[tuple[str, str, str]] = RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits, else null."""
    best = None
    for h, p, verdict in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), len(r[0])), reverse=True):
        fits = ((F.col(host) == h) | F.col(host).endswith("." + h)) & F.col(path).startswith(p)
        value = F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))
        best = F.when(fits, value) if best is None else best.when(fits, value)
    return best


def _bits(key: str) -> list[Column]:
    """One bit for each long of a block."""
    return [F.expr(f"shiftleft(1L, cast(pmod(xxhash64({key}, {k}), 64) as int))") for k in range(1, WORDS + 1)]


def _block(key: str, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(0)), F.lit(blocks)).cast("int")


def bloom(listed: DataFrame, key: str, blocks: int) -> DataFrame:
    """The filter: block and its longs w1.., for the blocks that hold something."""
    rows = listed.select(_block(key, blocks).alias("block"), *[b.alias(f"b{k}") for k, b in enumerate(_bits(key), 1)])
    return rows.groupBy("block").agg(*[F.bit_or(f"b{k}").alias(f"w{k}") for k in range(1, WORDS + 1)])


def listed_hits(urls: DataFrame, listed: DataFrame, key: str, max_blocks: int = 1 << 16, rows_per_block: int = 16) -> DataFrame:
    """urls (any columns, a key column) plus listed: whether the key is in listed(key). Null and empty keys never are.

    urls is read once; only rows that pass the filter are shuffled, each hot key over SALTS tasks.
    """
    listed = stored(listed.select(key).filter(f"{key} is not null and {key} <> ''").distinct())
    n = listed.count()
    blocks = max(1, min(max_blocks, n // rows_per_block + 1))
    rows = bloom(listed, key, blocks).withColumnRenamed("block", "__block")
    probe = urls.withColumn("__block", _block(key, blocks)).join(F.broadcast(rows), "__block", "left")
    maybe = F.lit(True)
    for k, b in enumerate(_bits(key), 1):
        maybe = maybe & (F.col(f"w{k}").bitwiseAND(b) != 0)
    probe = stored(probe.withColumn("__maybe", F.coalesce(maybe, F.lit(False))).drop("__block", *[f"w{k}" for k in range(1, WORDS + 1)]))
    hit = probe.filter("__maybe").drop("__maybe").withColumn("__salt", F.pmod(F.xxhash64(*urls.columns), F.lit(SALTS)).cast("int"))
    exact = listed.select(F.col(key).alias("__key"), F.lit(True).alias("listed"), F.explode(F.array(*map(F.lit, range(SALTS)))).alias("__of"))
    hit = hit.join(exact, (hit[key] == exact["__key"]) & (hit["__salt"] == exact["__of"]), "left").drop("__salt", "__of", "__key")
    return probe.filter("not __maybe").drop("__maybe").withColumn("listed", F.lit(False)).unionByName(hit.withColumn("listed", F.coalesce("listed", F.lit(False))))


def judge(pages: DataFrame, listed: DataFrame, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """A row for each row of pages(page_id, url): page_id, url, host, path, canonical_url, rule, verdict, listed.

    listed(url): URLs to block where no rule fits. Null URLs and those without :// have empty host
    and path, fit no rule, are never listed and so are allowed. Repeated rows are judged each for itself.
    Of two rules of one length the one with the longer host decides. Texts of any length are read whole, other columns are
    ignored, whatever their names; empty pages give no rows and an empty list blocks nothing.
    """
    urls = pages.select("page_id", "url", host_of("url").alias("host"), path_of("url").alias("path"), canonical("url").alias("canonical_url"))
    found = listed_hits(urls, listed.select(canonical("url").alias("canonical_url")), "canonical_url")
    fit = rule_for("host", "path", rules)
    return found.withColumn("__rule", fit).select(
        "page_id", "url", "host", "path", "canonical_url", F.col("__rule.rule").alias("rule"), F.coalesce("__rule.verdict", F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"), "listed"
    )


def spam_list(pages: DataFrame, labels: list[str] = SPAM_LABELS) -> DataFrame:
    """The default list: URLs of pages on hosts with one of the labels."""
    return pages.select("url").filter(F.arrays_overlap(F.split(host_of("url"), "\\."), F.array(*map(F.lit, labels))))
