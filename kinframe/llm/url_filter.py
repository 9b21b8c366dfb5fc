"""Judges urls by a weighted vocabulary (Aho-Corasick) and by rules on host and path."""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: One strict term, or SOFT_HITS distinct soft ones, reject a url.
STRICT = ("cheap-pills", "escorts", "hentai", "malware", "phishing", "porn", "spam-farm", "warez", "xxx")
SOFT = ("adult", "bet", "bonus", "casino", "cheap", "crack", "escort", "farm", "free", "gambling", "jackpot", "keygen", "loan", "nude", "pills", "poker", "sex", "slots", "spam", "torrent", "viagra", "win")
SOFT_HITS = 2
#: (verdict, host, path)
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or end, A-Z lower-cased; null or no ://: empty."""
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ?, # or end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_columns(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits (as host + path; null if none) and its verdict."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):  # longer ones are tested first
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


@lru_cache(maxsize=4)
def _automaton(strict: tuple[str, ...], soft: tuple[str, ...]):
    import ahocorasick

    a = ahocorasick.Automaton()
    for k, terms in (("strict", strict), ("soft", soft)):
        for t in terms:
            a.add_word(t, (k, t))
    a.make_automaton()
    return a


def term_hits(strict=STRICT, soft=SOFT):
    """A Pandas UDF: url -> (strict_hits, soft_hits), distinct terms between boundaries (no a-z or 0-9 beside them)."""
    strict, soft = tuple(strict), tuple(soft)

    @F.pandas_udf("strict_hits int, soft_hits int")
    def hits(urls: pd.Series) -> pd.DataFrame:
        a, fold = _automaton(strict, soft), str.maketrans(UPPER, LOWER)
        inner = frozenset(LOWER + "0123456789")
        rows = []
        for u in urls:
            found = set()
            if u:
                u = u.translate(fold)
                for end, (kind, term) in a.iter(u):
                    start = end - len(term)
                    if (start < 0 or u[start] not in inner) and (end + 1 >= len(u) or u[end + 1] not in inner):
                        found.add((kind, term))
            n = sum(k == "strict" for k, _ in found)
            rows.append((n, len(found) - n))
        return pd.DataFrame(rows, columns=["strict_hits", "soft_hits"]).astype("int32")

    return hits


def judge_urls(pages: DataFrame, url: str = "url", key: str = "page_id", strict=STRICT, soft=SOFT, rules=RULES, soft_hits: int = SOFT_HITS) -> DataFrame:
    """key, host, path, rule, verdict, strict_hits, soft_hits for every row; row by row, so nothing is shuffled.

    A rule's verdict goes before the vocabulary's. Null and empty urls have empty host and path, no hits and
    are allowed. Other columns are ignored.
    """
    rows = pages.select(F.col(key).alias("page_id"), F.col(url).alias("_url"))
    rows = rows.select("page_id", host_of(F.col("_url")).alias("host"), path_of(F.col("_url")).alias("path"), term_hits(strict, soft)(F.col("_url")).alias("_h"))
    rule, verdict = rule_columns(F.col("host"), F.col("path"), rules)
    own = F.when((F.col("_h.strict_hits") >= 1) | (F.col("_h.soft_hits") >= soft_hits), "block").otherwise("allow")
    return rows.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"), "_h.strict_hits", "_h.soft_hits")


def url_sql(strict=STRICT, soft=SOFT, rules=RULES, soft_hits: int = SOFT_HITS) -> str:
    """The same over pages in DuckDB's SQL."""
    has = lambda t: f"CASE WHEN regexp_matches(low, '(^|[^a-z0-9]){t}($|[^a-z0-9])') THEN 1 ELSE 0 END"
    fits = [(v, f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')", h + p) for v, h, p in sorted(rules, key=lambda r: -len(r[1]) - len(r[2]))]
    return f"""
WITH u AS (SELECT page_id, coalesce(translate(url, '{UPPER}', '{LOWER}'), '') AS low, coalesce(url, '') AS url FROM pages),
p AS (SELECT page_id, low, translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), '{UPPER}', '{LOWER}') AS host,
             regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path FROM u),
r AS (SELECT page_id, host, path, CASE {" ".join(f"WHEN {c} THEN '{n}'" for _, c, n in fits)} END AS rule,
             CASE {" ".join(f"WHEN {c} THEN '{v}'" for v, c, _ in fits)} END AS said,
             CAST({" + ".join(map(has, strict))} AS INTEGER) AS strict_hits, CAST({" + ".join(map(has, soft))} AS INTEGER) AS soft_hits FROM p)
SELECT page_id, host, path, rule, coalesce(said, CASE WHEN strict_hits >= 1 OR soft_hits >= {soft_hits} THEN 'block' ELSE 'allow' END) AS verdict, strict_hits, soft_hits FROM r
"""
