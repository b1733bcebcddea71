"""URL filter by a weighted vocabulary.

An Aho-Corasick automaton finds all terms in the lower-cased url in one pass. A hit counts when no letter
or digit of ASCII stands next to it. The weights of the distinct terms hit are summed up, and a url is rejected
from LIMIT on: a strict term reaches it alone, soft terms only several together.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import prepare

#: Sum of weights that rejects a url.
LIMIT = 6
# The default vocabulary by weight. One strict term rejects, two soft ones, three weak ones, or a soft and two weak ones.
STRICT = (
    "adult", "bets", "botnet", "camgirl", "camgirls", "carding", "casino", "cialis", "darknet", "erotic", "escort", "escorts", "fakeid", "gambling", "hentai", "keygen", "malware",
    "milf", "nsfw", "nude", "nudes", "phishing", "pills", "porn", "porno", "ransomware", "roulette", "sexcam", "spam", "sportsbook", "spyware", "striptease", "swingers", "trojan", "viagra", "warez", "xanax", "xxx",
)
SOFT = (
    "ads", "baccarat", "bet", "betting", "bingo", "blackjack", "bonus", "cheap", "click", "coupon", "dating", "deal", "deals", "farm", "forex", "free", "giveaway", "hack", "jackpot", "loan", "loans",
    "lottery", "lucky", "payday", "pharmacy", "poker", "prize", "promo", "replica", "singles", "slots", "sweepstakes", "torrent", "track", "wager", "win", "winner",
)
WEAK = (
    "affiliate", "bargain", "buy", "cash", "claim", "clearance", "credit", "debt", "discount", "earn", "exclusive", "gift", "guaranteed", "hot", "instant", "limited", "miracle", "money",
    "now", "offer", "outlet", "popup", "profit", "quick", "referral", "reward", "rich", "sale", "save", "sponsored", "subscribe", "traffic", "trial", "urgent", "vip", "voucher",
)
VOCABULARY = {**dict.fromkeys(STRICT, 6), **dict.fromkeys(SOFT, 3), **dict.fromkeys(WEAK, 2)}


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty without a scheme mark."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    low = lambda c: F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.coalesce(low(host), F.lit("")), F.coalesce(path, F.lit(""))


def rule_for(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """The longest rule (host, path, verdict) that fits, as a struct rule, verdict; else null."""
    chain = None
    for h, p, verdict in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r)):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        hit = F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))
        chain = F.when(fits, hit) if chain is None else chain.when(fits, hit)
    return chain if chain is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def term_hits(pages: DataFrame, vocabulary: dict[str, int] = VOCABULARY, limit: int = LIMIT) -> DataFrame:
    """Adds n_strict and n_soft, the distinct terms in the column url that reach the limit alone and that do not, and
    their weight together; null url: 0."""
    prepare(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        find = ahocorasick.Automaton()
        for t in vocabulary:
            find.add_word(t, t)
        if vocabulary:
            find.make_automaton()
        for b in batches:
            strict, soft, weight = [], [], []
            for url in b.column(b.schema.get_field_index("url")).to_pylist():
                got = set()
                low = (url or "").lower() if (url or "").isascii() else "".join(c.lower() if c.isascii() else c for c in url)
                for end, t in find.iter(low) if vocabulary else ():
                    a, z = end - len(t), end + 1
                    if not (a >= 0 and low[a].isascii() and low[a].isalnum()) and not (z < len(low) and low[z].isascii() and low[z].isalnum()):
                        got.add(t)
                alone = sum(vocabulary[t] >= limit for t in got)
                strict.append(alone)
                soft.append(len(got) - alone)
                weight.append(sum(map(vocabulary.__getitem__, got)))
            made = [pa.array(x, pa.int64()) for x in (strict, soft, weight)]
            yield pa.RecordBatch.from_arrays([*b.columns, *made], [*b.schema.names, "n_strict", "n_soft", "weight"])

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema.fields)
    return pages.mapInArrow(run, f"{ddl}, n_strict long, n_soft long, weight long")


def filter_urls(pages: DataFrame, rules: list[tuple[str, str, str]], vocabulary: dict[str, int] = VOCABULARY, limit: int = LIMIT) -> DataFrame:
    """Verdict on every url: that of the longest rule that fits, else block where the weights of the distinct terms reach the limit.

    pages: page_id, url; other columns are ignored. Returns page_id, host, path, rule, verdict, n_strict, n_soft, weight.

    Null or scheme-less url: host and path are empty, so only a rule with an empty host could fit; the
    vocabulary still judges the string, and null is allowed. Null ids and repeated rows are kept. Empty
    table: empty result. Empty vocabulary: rules alone decide.
    """
    hit = term_hits(pages.select("page_id", "url"), vocabulary, limit)
    host, path = host_and_path(F.col("url"))
    judged = hit.select("page_id", host.alias("host"), path.alias("path"), "n_strict", "n_soft", "weight")
    judged = judged.withColumn("fit", rule_for(F.col("host"), F.col("path"), rules))
    own = F.when(F.col("weight") >= limit, "block").otherwise("allow")
    return judged.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), F.coalesce("fit.verdict", own).alias("verdict"), "n_strict", "n_soft", "weight")
