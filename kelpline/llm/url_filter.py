"""URL filters: host and path rules, then a weighted vocabulary found by Aho-Corasick.

A task builds one automaton over all terms and runs it over each whole lower-cased URL: scheme, host,
path, query and fragment. A hit counts only between boundaries: no ASCII letter or digit next to it.
Every term has a weight in hundredths. A term of weight ``FULL`` is strict: one hit rejects. Others are
soft: distinct ones reject together when there are ``soft_needed`` of them and their weights reach
``FULL``; a soft term counts once however often it stands in a URL. The vocabulary is a parameter: a
dict, or a table (term, weight); ``learn_vocabulary`` makes one from labelled URLs. Host-and-path rules
come first: a rule fits its host and all subdomains if the url's path starts with the rule's; the
longest fitting rule decides.

Defined results: a null url has no host, path, rule or terms and is allowed. One without ``://`` has an
empty host and path and fits no rule; its terms count. Rows that repeat a page_id are judged each by
itself. Of rules of equal length the one given first decides. An empty table gives no rows. Extra
columns don't matter.
"""

from __future__ import annotations

from collections.abc import Sequence

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .maptext import map_texts

FULL, SOFT_NEEDED = 100, 2
#: The default vocabulary: lower-case terms of ASCII letters, digits and inner marks.
VOCABULARY: dict[str, int] = {
    **dict.fromkeys(("porn", "porno", "xxx", "xvideos", "hentai", "viagra", "cialis", "casino", "escort", "escorts", "warez", "keygen", "cheap-pills", "spam-farm", "payday-loan", "camgirls", "torrentz"), FULL),
    **dict.fromkeys(("sex", "adult", "nude", "betting", "poker", "crack", "cracked", "pills", "replica", "spam"), 60),
    **dict.fromkeys(("cheap", "bonus", "loan", "loans", "jackpot", "hack", "bet", "slots", "torrent", "pharmacy", "dating"), 50),
    **dict.fromkeys(("free", "win", "winner", "farm", "deal", "deals", "discount", "prize", "click", "promo", "offer"), 35),
}
#: (action, host, path)
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule as host and path in one string, and its action; nulls if none fits."""
    name, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for act, of, start in sorted(reversed(rules), key=lambda r: len(r[1]) + len(r[2])):  # the last that fits counts
        fits = ((host == of) | host.endswith("." + of)) & path.startswith(start)
        name, action = F.when(fits, of + start).otherwise(name), F.when(fits, act).otherwise(action)
    return name, action


def _finder(vocabulary: dict[str, int]):
    def make():
        automaton = ahocorasick.Automaton()
        for term, weight in vocabulary.items():
            automaton.add_word(term, (term, weight))
        if vocabulary:
            automaton.make_automaton()
        inside = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")

        def run(data: np.ndarray, offsets: np.ndarray) -> list[pa.Array]:
            raw, n_strict, n_soft, weights = data.tobytes(), [], [], []
            for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                text, strict, soft = raw[a:b].decode("utf-8", "replace"), 0, {}
                for end, (term, weight) in automaton.iter(text) if vocabulary else ():
                    start = end - len(term)
                    if (start < 0 or text[start] not in inside) and (end + 1 == len(text) or text[end + 1] not in inside):
                        if weight >= FULL:
                            strict += 1
                        else:
                            soft[term] = weight
                n_strict.append(strict)
                n_soft.append(len(soft))
                weights.append(sum(soft.values()))
            return [pa.array(x, pa.int64()) for x in (n_strict, n_soft, weights)]

        return run

    return make


def judge_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, vocabulary: dict[str, int] | DataFrame | None = None, soft_needed: int = SOFT_NEEDED) -> DataFrame:
    """page_id, host, path, rule, verdict, and n_strict (hits), n_soft (distinct terms) and soft_weight of the url's terms.

    The vocabulary (a dict, or a table with columns term and weight) goes to every task: its size is
    that of a word list, whatever the number of pages. Terms are lower case.
    """
    if isinstance(vocabulary, DataFrame):
        vocabulary = {r["term"]: r["weight"] for r in vocabulary.where("term <> '' AND weight > 0").select("term", "weight").collect()}
    words = VOCABULARY if vocabulary is None else vocabulary
    url = F.col("url").cast("string")
    lowered = F.translate(F.coalesce(url, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    parts = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"), lowered.alias("lowered"))
    counted = map_texts(parts, "lowered", _finder(words), "n_strict long, n_soft long, soft_weight long", ["page_id", "host", "path"])
    name, action = rule_of(F.col("host"), F.col("path"), rules)
    own = F.when((F.col("n_strict") > 0) | ((F.col("n_soft") >= soft_needed) & (F.col("soft_weight") >= FULL)), "block").otherwise("allow")
    return counted.select("page_id", "host", "path", name.alias("rule"), F.coalesce(action, own).alias("verdict"), "n_strict", "n_soft", "soft_weight")


def learn_vocabulary(urls: DataFrame, terms: int = 1000, least: int = 5, strict_share: float = 0.98) -> DataFrame:
    """(term, weight) from rows (url, bad boolean): the ``terms`` terms of the largest weight.

    A term's weight is its share of bad URLs, beyond the share that all URLs have, in hundredths. Terms
    in fewer than ``least`` URLs are left out; from ``strict_share`` on a term is strict.
    """
    lowered = F.translate("url", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    rows = urls.where("url IS NOT NULL AND bad IS NOT NULL").select(F.explode(F.array_distinct(F.regexp_extract_all(lowered, F.lit("([a-z0-9]{3,})"), 1))).alias("term"), F.col("bad").cast("int").alias("bad"))
    whole = urls.agg(F.coalesce(F.avg(F.col("bad").cast("int")), F.lit(0.0))).first()[0]
    counts = rows.groupBy("term").agg(F.count("*").alias("n"), F.sum("bad").alias("b")).where(F.col("n") >= least)
    share = (F.col("b") + whole) / (F.col("n") + 1)
    weight = F.when(F.col("b") >= strict_share * F.col("n"), FULL).otherwise(F.least(F.floor(100 * (share - whole) / max(1e-9, 1 - whole)), F.lit(FULL - 1)))
    return counts.select("term", weight.cast("int").alias("weight")).where("weight > 0").orderBy(F.desc("weight"), "term").limit(terms)


def _found(term: str) -> str:
    return f"regexp_matches(t, '(^|[^a-z0-9]){term}($|[^a-z0-9])')"


def _sum(cells: Sequence[str]) -> str:
    return " + ".join(cells)


_SOFT = {t: w for t, w in VOCABULARY.items() if w < FULL}

#: DuckDB SQL for the contract's columns.
ORACLE = rf"""
WITH u AS (SELECT page_id, coalesce(url, '') AS url, CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, url, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r AS (SELECT host AS rh, path AS rp, action FROM (VALUES {", ".join(f"('{h}', '{p}', '{a}')" for a, h, p in RULES)}) v(host, path, action)),
m AS (SELECT page_id, rh || rp AS rule, action, row_number() OVER (PARTITION BY page_id ORDER BY length(rh || rp) DESC) AS k
      FROM p JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)),
c AS (SELECT page_id, host, path, ({" OR ".join(_found(t) for t, w in VOCABULARY.items() if w >= FULL)}) AS strict,
             ({_sum([f"CAST({_found(t)} AS INTEGER)" for t in _SOFT])}) AS n_soft, ({_sum([f"{w} * CAST({_found(t)} AS INTEGER)" for t, w in _SOFT.items()])}) AS weight
      FROM (SELECT *, translate(url, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM p))
SELECT c.page_id, host, path, rule, coalesce(action, CASE WHEN strict OR (n_soft >= {SOFT_NEEDED} AND weight >= {FULL}) THEN 'block' ELSE 'allow' END) AS verdict
FROM c LEFT JOIN m ON m.page_id = c.page_id AND m.k = 1
"""
