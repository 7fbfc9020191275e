"""URL filters: host and path rules, then a weighted vocabulary of terms.

Rules are column expressions.  Terms are found by one Aho-Corasick automaton
over the lower-cased url; an occurrence counts where it stands between
boundaries (an end, or a character other than a-z and 0-9).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .staging import named

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Fixed values: (verdict, host, path).
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
#: General terms, by trade.  What names a trade is strict; what it shares with other matters is soft, and all soft ones weigh the same.
STRICT_TERMS = (
    "porn porno pornography xxx hentai camgirl camgirls milf nsfw escorts "
    "casino casinos sportsbook blackjack roulette baccarat gambling "
    "viagra cialis levitra xanax tramadol phentermine "
    "phishing malware ransomware keylogger warez keygen serialz "
    "adserver doubleclick clickbait"
)
SOFT_TERMS = (
    "adult sex sexy nude naked erotic fetish escort dating webcam lingerie "
    "bet bets betting poker jackpot slot slots lottery lotto odds win winner bonus spins bingo "
    "pills pill pharmacy pharma drug drugs prescription tablets diet slim cheap cheapest discount "
    "spam scam hoax fraud loan loans payday credit debt cash money earn rich bitcoin crypto forex "
    "torrent torrents crack cracked hack hacks cheats pirate proxy "
    "ads ad advert adverts banner banners popup popups sponsor sponsored promo affiliate affiliates track tracker tracking click clicks traffic "
    "seo backlink backlinks farm parked redirect free"
)
STRICT, SOFT = 1.0, 0.5
VOCABULARY = tuple((t, STRICT) for t in STRICT_TERMS.split()) + tuple((t, SOFT) for t in SOFT_TERMS.split())
#: Distinct soft terms, and their weights together, that reject a url.
SOFT_HITS, SOFT_WEIGHT = 2, 1.0
#: Terms that workers hold in one pass; a longer vocabulary is counted in several automata.
MAX_TERMS = 1_000_000
#: Of a learnt term: toxic documents that hold it, at least; the least share of toxic ones among all that hold it, by
#: the lower end of Wilson's interval at 95 %, for a soft and for a strict term.
LEAST_DOCUMENTS, SOFT_SHARE, STRICT_SHARE = 10, 0.5, 0.9
_Z2 = 3.8416
#: Labelled rows that terms are learnt from, at most: those whose ids have the least digests.
MAX_LABELLED = 20_000


def learned_terms(docs: DataFrame, labels: DataFrame, *, id: str = "doc_id", text: str = "text", toxic: str = "toxic") -> DataFrame:
    """(term, weight) of words `[a-z0-9]+`, after lower-casing A-Z, that tell toxic documents from others, by MAX_LABELLED labelled ones.

    A document counts once for a word.  Null labels and texts teach nothing; rows that share an id are joined with each label of it.
    The labels go to the texts, which are not shuffled.
    """
    marked = labels.where(named(toxic).isNotNull() & named(id).isNotNull()).select(named(id).alias("_id"), (named(toxic) == 1).cast("long").alias("_toxic"))
    marked = marked.orderBy(F.md5(F.col("_id").cast("string")), "_toxic").limit(MAX_LABELLED)
    rows = docs.select(named(id).alias("_id"), named(text).cast("string").alias("_text")).join(F.broadcast(marked), "_id")
    words = F.array_distinct(F.regexp_extract_all(lower_ascii(F.col("_text")), F.lit("[a-z0-9]+"), F.lit(0)))
    counts = rows.select("_toxic", F.explode(words).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"), F.sum("_toxic").alias("k"))
    p, n = F.col("k") / F.col("n"), F.col("n")
    low = (p + _Z2 / (2 * n) - F.sqrt(F.lit(_Z2)) * F.sqrt(p * (1 - p) / n + _Z2 / (4 * n * n))) / (1 + _Z2 / n)
    told = counts.where(F.col("k") >= LEAST_DOCUMENTS).withColumn("low", low).where(F.col("low") >= SOFT_SHARE)
    return told.select("term", F.when(F.col("low") >= STRICT_SHARE, STRICT).otherwise(SOFT).alias("weight"))


def general_terms(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(VOCABULARY, "term string, weight double")


def terms_of(vocabulary: DataFrame) -> Iterator[tuple[tuple[str, float], ...]]:
    """A table (term, weight) as terms, MAX_TERMS at a time: lower case, the greatest weight of a repeated one; null and empty terms are none."""
    rows = vocabulary.select(lower_ascii(F.col("term")).alias("term"), F.col("weight").cast("double").alias("weight")).where("term <> '' and weight > 0")
    part: list[tuple[str, float]] = []
    for r in rows.groupBy("term").agg(F.max("weight").alias("weight")).orderBy("term").toLocalIterator():
        part.append((r["term"], r["weight"]))
        if len(part) == MAX_TERMS:
            yield tuple(part)
            part = []
    if part:
        yield tuple(part)


def lower_ascii(column: Column) -> Column:
    return F.translate(column, UPPER, LOWER)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Both empty where the url is null or has no ``://``."""
    at = F.coalesce(F.locate("://", url), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + F.lit(3), F.length(url))).otherwise(F.lit(""))
    return lower_ascii(F.regexp_extract(rest, r"^([^/?#]*)", 1)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def term_hits(vocabulary: tuple[tuple[str, float], ...]):
    """A vectorised function url -> (strict, soft, weight): the distinct terms of either kind, and the soft ones' weights in thousandths."""

    @F.pandas_udf("strict long, soft long, weight long")
    def hits(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for term, weight in vocabulary:
            automaton.add_word(term, (term, weight))
        if vocabulary:
            automaton.make_automaton()
        for urls in batches:
            rows = []
            for url in urls:
                found = {}
                if url and vocabulary:
                    for end, (term, weight) in automaton.iter(url):
                        low, high = end - len(term), end + 1
                        if not (low >= 0 and _inside(url[low])) and not (high < len(url) and _inside(url[high])):
                            found[term] = weight
                soft = [round(w * 1000) for w in found.values() if w < 1]
                rows.append((len(found) - len(soft), len(soft), sum(soft)))
            yield pd.DataFrame(rows, columns=["strict", "soft", "weight"])

    return hits


def _inside(c: str) -> bool:
    return "a" <= c <= "z" or "0" <= c <= "9"


def filter_urls(
    pages: DataFrame,
    *,
    id: str = "page_id",
    url: str = "url",
    rules=RULES,
    vocabulary: DataFrame | tuple[tuple[str, float], ...] = VOCABULARY,
    soft_hits: int = SOFT_HITS,
    soft_weight: float = SOFT_WEIGHT,
) -> DataFrame:
    """Judge every url; one row out for each row in.

    Returns page_id, host, path, rule (the longest fitting rule's host and
    path, or null), verdict, n_strict and n_soft (distinct terms).  Where no
    rule fits, one strict term rejects, and so do ``soft_hits`` distinct soft
    ones whose weights come to ``soft_weight``.  ``vocabulary``: a table (term,
    weight) or such pairs.

    Cases: a null or malformed url has an empty host and path and no rule; its
    terms still count where it has text; a very long url is read whole; null
    ids keep their rows; repeated rows are judged alike; an empty table gives
    no rows, an empty vocabulary no terms; other columns are ignored.  Between
    rules of one length the first listed wins.
    """
    parts = list(terms_of(vocabulary)) if isinstance(vocabulary, DataFrame) else [tuple(vocabulary)]
    host, path = host_and_path(F.col("_url"))
    ranked = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, on, below in reversed(ranked):
        fits = ((F.col("host") == on) | F.col("host").endswith("." + on)) & F.col("path").startswith(below)
        rule, verdict = F.when(fits, on + below).otherwise(rule), F.when(fits, says).otherwise(verdict)
    each = [term_hits(terms)(lower_ascii(F.col("_url"))) for terms in parts or [()]]
    found = F.struct(*[sum((hits[c] for hits in each[1:]), each[0][c]).alias(c) for c in ("strict", "soft", "weight")])
    rejected = (F.col("_found.strict") >= 1) | ((F.col("_found.soft") >= soft_hits) & (F.col("_found.weight") >= round(soft_weight * 1000)))
    return (
        pages.select(named(id).alias("page_id"), named(url).cast("string").alias("_url"))
        .select("page_id", "_url", host.alias("host"), path.alias("path"), found.alias("_found"))
        .select(
            "page_id", "host", "path", rule.alias("rule"),
            F.coalesce(verdict, F.when(rejected, "block").otherwise("allow")).alias("verdict"),
            F.col("_found.strict").alias("n_strict"), F.col("_found.soft").alias("n_soft"),
        )
    )


def oracle_sql() -> str:
    low = lambda column: f"translate({column}, '{UPPER}', '{LOWER}')"
    ranked = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    cases = lambda pick: "CASE " + " ".join(
        f"WHEN (host = '{on}' OR ends_with(host, '.{on}')) AND starts_with(path, '{below}') THEN '{pick(says, on, below)}'" for says, on, below in ranked
    ) + " END"
    listed = ", ".join(f"('{t}', {w})" for t, w in VOCABULARY)
    return rf"""
WITH m AS (SELECT doc_id, toxic FROM labels WHERE toxic IS NOT NULL ORDER BY md5(doc_id::VARCHAR), toxic LIMIT {MAX_LABELLED}),
c AS (SELECT term, count(*)::DOUBLE AS n, sum(CASE WHEN toxic = 1 THEN 1 ELSE 0 END)::DOUBLE AS k
           FROM (SELECT toxic, unnest(list_distinct(regexp_extract_all({low('text')}, '[a-z0-9]+'))) AS term FROM documents JOIN m USING (doc_id)) GROUP BY term),
b AS (SELECT term, (k / n + {_Z2} / (2 * n) - sqrt({_Z2}) * sqrt(k / n * (1 - k / n) / n + {_Z2} / (4 * n * n))) / (1 + {_Z2} / n) AS low FROM c WHERE k >= {LEAST_DOCUMENTS}),
v AS (SELECT term, max(weight) AS weight FROM (SELECT term, CASE WHEN low >= {STRICT_SHARE} THEN {STRICT} ELSE {SOFT} END AS weight FROM b WHERE low >= {SOFT_SHARE} UNION ALL VALUES {listed}) GROUP BY term),
u AS (SELECT page_id, row_number() OVER () AS row, {low('url')} AS low, CASE WHEN contains(url, '://') THEN url[strpos(url, '://') + 3:] ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, row, low, {low("regexp_extract(rest, '^([^/?#]*)', 1)")} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
t AS (SELECT row, count(*) FILTER (weight >= 1) AS n_strict, count(*) FILTER (weight < 1) AS n_soft, coalesce(sum(weight) FILTER (weight < 1), 0) AS soft
      FROM (SELECT row, unnest(list_distinct(regexp_extract_all(coalesce(low, ''), '[a-z0-9]+'))) AS term FROM h) JOIN v USING (term) GROUP BY row)
SELECT page_id, host, path, {cases(lambda v, h, p: h + p)} AS rule,
       coalesce({cases(lambda v, h, p: v)}, CASE WHEN coalesce(n_strict, 0) >= 1 OR (coalesce(n_soft, 0) >= {SOFT_HITS} AND soft >= {SOFT_WEIGHT}) THEN 'block' ELSE 'allow' END) AS verdict,
       coalesce(n_strict, 0)::BIGINT AS n_strict, coalesce(n_soft, 0)::BIGINT AS n_soft
FROM h LEFT JOIN t USING (row)
"""
