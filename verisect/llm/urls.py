"""URL filter: a weighted vocabulary found by an Aho-Corasick automaton, with host and path rules first.

The automaton reads the lower-cased URL once. A hit counts only between boundaries (no ASCII letter or
digit beside it). One strict term, or distinct soft terms whose weights add up to ``limit``, block a URL. No
soft term weighs that much, so it takes two or more of them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verisect.llm.common import table

#: One of these blocks a URL.
STRICT = ("adult-x", "bestiality", "camgirls", "escorts", "hentai", "milf", "porn", "porno", "pornhub", "sexcam", "sexshop", "xvideos", "xxx")
#: Term and weight; distinct ones add up.
SOFT = {
    "ads": 2, "adult": 2, "bet": 1, "bets": 2, "betting": 2, "bonus": 1, "casino": 2, "cheap": 1, "crack": 2, "dating": 1, "erotic": 2,
    "farm": 1, "free": 1, "gambling": 2, "hacked": 1, "jackpot": 2, "keygen": 2, "loan": 1, "naked": 2, "nude": 2, "pills": 2,
    "poker": 2, "sex": 2, "slots": 1, "spam": 2, "torrent": 1, "track": 1, "viagra": 2, "warez": 2, "win": 1,
}
SOFT_LIMIT = 3
#: (verdict, host, path): a rule holds for its host and all subdomains where the path starts with its own.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LOWERED = {ord(a): b for a, b in zip(_UPPER, _LOWER, strict=True)}
_INSIDE = frozenset(_LOWER + "0123456789")


def automaton(strict: tuple[str, ...], soft: dict[str, float], limit: float) -> ahocorasick.Automaton:
    """Terms with their weights; a strict term weighs the limit."""
    found = ahocorasick.Automaton()
    for term, weight in [*soft.items(), *((t, limit) for t in strict)]:
        if term:
            found.add_word(term, (term, weight))
    if len(found):
        found.make_automaton()
    return found


#: Terms of a vocabulary at most: a worker holds their automaton, of some 100 bytes a letter.
MOST_TERMS = 200_000


def as_vocabulary(terms: DataFrame) -> tuple[tuple[str, ...], dict[str, float]]:
    """(strict, soft) of a table (term, weight, strict) of MOST_TERMS rows at most, else an error. Terms are
    lower-cased (A-Z); null and empty ones don't count; of a term that comes twice a strict row wins, then the
    larger weight; a null weight is 0."""
    low = F.translate("term", _UPPER, _LOWER)
    rows = terms.filter("term <> ''").groupBy(low.alias("term")).agg(F.max(F.coalesce(F.col("weight").cast("double"), F.lit(0.0))).alias("weight"), F.coalesce(F.bool_or("strict"), F.lit(False)).alias("strict"))
    found = rows.limit(MOST_TERMS + 1).collect()
    if len(found) > MOST_TERMS:
        raise ValueError(f"a vocabulary has {MOST_TERMS} terms at most")
    return tuple(sorted(r["term"] for r in found if r["strict"])), {r["term"]: r["weight"] for r in sorted(found) if not r["strict"]}


#: The automaton that this worker built last, by its vocabulary: tasks that follow use it again.
_BUILT: dict[str, ahocorasick.Automaton] = {}


def built(key: str, vocabulary: tuple) -> ahocorasick.Automaton:
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = automaton(*vocabulary)
    return _BUILT[key]


def weight_of(url: str | None, terms: ahocorasick.Automaton) -> float:
    """The sum of the weights of the distinct terms between boundaries."""
    if not url or not len(terms):
        return 0
    text, hits = url.translate(_LOWERED), {}
    for end, (term, weight) in terms.iter(text):
        before, after = text[end - len(term) : end - len(term) + 1] if end >= len(term) else "", text[end + 1 : end + 2]
        if before not in _INSIDE and after not in _INSIDE:
            hits[term] = weight
    return sum(hits.values())


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty without ://."""
    host = F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1)
    return F.translate(F.coalesce(host, F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or the end."""
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def filter_urls(pages: DataFrame, rules=RULES, strict=STRICT, soft=SOFT, limit: float = SOFT_LIMIT, vocabulary: DataFrame | None = None) -> DataFrame:
    """One row per row of pages (page_id, url): page_id, host, path, rule, weight, verdict.

    The longest rule that fits decides; without one, the vocabulary does: strict and soft terms, or a table of
    them (as_vocabulary) in their place. Null or empty URLs, and those
    without ://, have empty host and path; the vocabulary still reads the latter. Rows are judged one by
    one, so ties and repeats stay; other columns are dropped; an empty table gives an empty result.
    """
    if vocabulary is not None:
        strict, soft = as_vocabulary(vocabulary)
    words = (tuple(strict), dict(soft), limit)
    name = hashlib.md5(repr((words[0], sorted(words[1].items()), limit)).encode()).hexdigest()
    shared = pages.sparkSession.sparkContext.broadcast(words)
    slim = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = built(name, shared.value)
        for b in batches:
            weights = pa.array([float(weight_of(u.as_py(), terms)) for u in b.column(1)], pa.float64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), weights], ["page_id", "url", "weight"])

    seen = slim.mapInArrow(weigh, "page_id long, url string, weight double").withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    rule, verdict = F.lit(None).cast("string"), F.when(F.col("weight") >= limit, "block").otherwise("allow")
    for said, host, path in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):  # the longest is asked first
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        rule, verdict = F.when(fits, host + path).otherwise(rule), F.when(fits, said).otherwise(verdict)
    return seen.select("page_id", "host", "path", rule.alias("rule"), "weight", verdict.alias("verdict"))


def op8_url_filter(spark, sf_dir: str) -> DataFrame:
    """Query: the verdict on every page's url, by the contract's rules and the vocabulary above."""
    return filter_urls(table(spark, sf_dir, "pages"))


def _sql() -> str:
    word = lambda t: f"regexp_matches(u, '(^|[^a-z0-9]){t}([^a-z0-9]|$)')"
    weight = " + ".join([*(f"case when {word(t)} then {w} else 0 end" for t, w in SOFT.items()), *(f"case when {word(t)} then {SOFT_LIMIT} else 0 end" for t in STRICT)])
    fits = lambda h, p: f"(host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '{p}')"
    longest = sorted(RULES, key=lambda r: (len(r[1] + r[2]), r), reverse=True)
    rule = " ".join(f"when {fits(h, p)} then '{h + p}'" for _, h, p in longest)
    verdict = " ".join(f"when {fits(h, p)} then '{said}'" for said, h, p in longest)
    return f"""
with parts as (
  select page_id, translate(coalesce(url, ''), '{_UPPER}', '{_LOWER}') as u,
    translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1), ''), '{_UPPER}', '{_LOWER}') as host,
    coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1), '') as path
  from pages
), weighed as (select page_id, host, path, cast({weight} as double) as weight from parts)
select page_id, host, path, case {rule} else null end as rule, weight,
  case {verdict} when weight >= {SOFT_LIMIT} then 'block' else 'allow' end as verdict
from weighed
"""


OP8_SQL = _sql()
