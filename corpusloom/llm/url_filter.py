"""URL filters: rules first, then logistic regression on hashed character n-grams of host and path."""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import column_udf, load, ship

#: (verdict, rule): a rule is a host and the beginning of a path.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
SLOTS = 1 << 15
ORDERS = (3, 4, 5)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: The small labelled table: 1 for a url that a text crawl does not want.  Hosts are made of words by topic, each alone, with another of its topic,
#: and with a modifier that either kind may have.  Those of the last wanted topic are common words and names that have the letters of an unwanted one inside.
#: ``filter_urls`` takes any other table of (url, label).
_UNWANTED = {
    "pharmacy": "pills meds pharmacy viagra cialis tablets weightloss",
    "betting": "bets betting bookmaker odds wager sportsbook bet",
    "casino": "casino slots jackpot roulette poker bingo lottery",
    "adult": "porn xxx sex cams nude escorts adult erotic dating",
    "advertising": "ads adserver adservices clicks tracker tracking banners popups pixel syndication ad",
    "link spam": "spam backlinks linkfarm seo traffic bulkmail contentfarm",
    "fraud": "prize winner giveaway iphone payday loans instantcredit crypto forex bonus",
    "copies": "replica rolex handbags torrents warez cracks keygen",
}
_WANTED = {
    "reference": "wikipedia encyclopedia dictionary archive gutenberg library reference atlas translation",
    "news": "bbc guardian times herald gazette observer chronicle post newsroom weather radio",
    "science": "nature physics astronomy chemistry biology mathematics journal geology institute statistics",
    "learning": "university school college teaching academy lectures students languages textbooks",
    "public life": "parliament council ministry courts townhall embassy elections park hospital",
    "culture": "museum theatre orchestra poetry stories cathedral gallery festival choir literature history philosophy",
    "daily life": "cooking recipes gardening travel parenting health trains mountains fishing village forest",
    "technology": "software docs github stackoverflow kernel python electronics robotics networking",
    "people": "annette thomas margaret schmidt letters diary blogger notes daniel sofia",
    "near misses": "middlesex adriatic alphabet better elizabeth diabetes address roads shadows spinoza winchester winter freedom farmers windfarm athletics railway pillars caterpillar linked headlines cards camping department adults-learning",
}
_FIRST, _LAST = ("best-", "my", "free-", "the-", "cheap-", "online"), ("24", "-online", "hub", "-now", "world", "-win", "site", "-store")
_PLACES, _ENDS = ("", "www.", "m.", "blog.", "news.", "cdn."), ("com", "org", "net", "info")
_OFFERS, _TEXTS = ("buy-now?aff=7", "order/cheap.php", "win/bonus", "click.html?id=99"), ("article/1", "en/2024/about.html", "posts/12?page=2", "de/index")


def labelled_table(unwanted: Mapping[str, str] = _UNWANTED, wanted: Mapping[str, str] = _WANTED) -> tuple[tuple[str, int], ...]:
    """Four hosts of each word with paths that are as common for either kind, so they tell nothing; an unwanted word has an offer's path besides."""
    table = []
    for label, topics in ((1, unwanted), (0, wanted)):
        n = 0
        for words in map(str.split, topics.values()):
            for i, word in enumerate(words):
                hosts = (word, _FIRST[n % 6] + word, word + _LAST[n % 8], f"{word}-{words[i - 1]}")
                ends = ("", _TEXTS[n % 4], "", _TEXTS[(n + 1) % 4]) if n % 2 else (_TEXTS[n % 4], "", _TEXTS[(n + 1) % 4], "")
                urls = [f"http://{_PLACES[(n + j) % 6]}{host}.{_ENDS[(n + j) % 4]}/{end}" for j, (host, end) in enumerate(zip(hosts, ends, strict=True))]
                if label:
                    urls.append(f"https://{word}.{_ENDS[n % 4]}/{_OFFERS[n // 2 % 4]}")
                table += [(url, label) for url in urls]
                n += 1
    return tuple(table)


LABELLED = labelled_table()


def host_of(url: str) -> Column:
    after = F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^(?s:.*?)://([^/?#]*+)", 1)
    return F.translate(after, _UPPER, _LOWER)


def path_of(url: str) -> Column:
    return F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^(?s:.*?)://[^/?#]*+((?:/[^?#]*+)?)", 1)


def match_rule(host: str, path: str, rules: Sequence[tuple[str, str]] = RULES) -> Column:
    """struct(verdict, rule) of the longest rule that fits, null if none does; of equally long ones the first given."""
    out = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, rule in reversed(sorted(rules, key=lambda r: -len(r[1]))):
        name, slash, start = rule.partition("/")
        fits = ((F.col(host) == name) | F.endswith(F.col(host), F.lit("." + name))) & F.startswith(F.col(path), F.lit(slash + start))
        out = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))).otherwise(out)
    return out


def slots(host: str, path: str) -> list[int]:
    """The hashed character n-grams of host and path, each once."""
    found = set()
    for tag, part in (("h", f"^{host}$"), ("p", f"^{path}$")):
        for n in ORDERS:
            found.update(zlib.crc32(f"{tag}{part[i : i + n]}".encode()) % SLOTS for i in range(max(1, len(part) - n + 1)))
    return sorted(found)


def fit(labelled: Sequence[tuple[str, str, int]], rounds: int = 1000, rate: float = 4.0, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias by full gradient steps over a small table of (host, path, label), both kinds of which weigh the same; zero weights if it is empty."""
    w, b = np.zeros(SLOTS), 0.0
    if not labelled:
        return w, b
    at = [slots(h, p) for h, p, _ in labelled]
    row, col = np.repeat(np.arange(len(at)), [len(a) for a in at]), np.concatenate(at)
    size = 1 / np.sqrt([len(a) for a in at])
    y = np.array([x for _, _, x in labelled], float)
    weight = np.where(y > 0, 1 / max(1.0, y.sum()), 1 / max(1.0, (1 - y).sum()))
    weight /= weight.sum()
    for _ in range(rounds):
        z = np.bincount(row, w[col], len(at)) * size + b
        e = (1 / (1 + np.exp(-z)) - y) * weight
        w -= rate * (np.bincount(col, (e * size)[row], SLOTS) + decay * w)
        b -= rate * e.sum()
    return w, b


def split_url(url: str | None) -> tuple[str, str]:
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min((i for c in "/?#" if (i := rest.find(c)) >= 0), default=len(rest))
    path = rest[cut:]
    end = min((i for c in "?#" if (i := path.find(c)) >= 0), default=len(path))
    return rest[:cut].translate(str.maketrans(_UPPER, _LOWER)), path[:end]


def filter_urls(pages: DataFrame, url: str = "url", rules: Sequence[tuple[str, str]] = RULES, labelled: Sequence[tuple[str, int]] = LABELLED) -> DataFrame:
    """``pages`` with host, path, rule, score and verdict columns (columns of those names are replaced), row by row.

    A null url or one without ``://`` has an empty host and path and is left to the model.  ``score`` is the
    model's probability of ``block``; it decides from 0.5 on where no rule fits.  Very long urls are
    scored whole, ties between rules go to the one given first, repeated rows are judged alike.
    """
    ship(pages.sparkSession)
    model = fit([(*split_url(u), y) for u, y in labelled])

    def scores(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        w, b = model
        for hosts, paths in batches:
            at = [slots(h, p) for h, p in zip(hosts, paths, strict=True)]
            n = np.array([len(a) for a in at])
            z = np.add.reduceat(w[np.concatenate(at)], np.concatenate(([0], np.cumsum(n)[:-1]))) / np.sqrt(n) + b if at else np.zeros(0)
            yield pd.Series(1 / (1 + np.exp(-z)))

    made = ("host", "path", "rule", "score", "verdict")
    base = pages.withColumn("__url", F.col(url))
    base = base.select(*(c for c in base.columns if c not in made), host_of("__url").alias("host"), path_of("__url").alias("path"))
    base = base.withColumn("__rule", match_rule("host", "path", rules)).withColumn("score", column_udf("double", scores)("host", "path"))
    return (
        base.withColumn("rule", F.col("__rule.rule"))
        .withColumn("verdict", F.coalesce("__rule.verdict", F.when(F.col("score") >= 0.5, "block").otherwise("allow")))
        .drop("__rule", "__url")
    )


def op5_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    pages = load(spark, folder, "pages").select("page_id", "url")
    return filter_urls(pages).select("page_id", "host", "path", "rule", "verdict", "score")
