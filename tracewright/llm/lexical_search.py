"""Ranked lexical search over term-bucketed postings.

A posting says how often a term stands in a document and how many terms the
document has.  Postings are dealt by term, a term's own over SALTS parts, and
sorted by term.  Items' terms join them, each match gets an integer score, and
the sums for each item and document are ranked.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .kernels import ALNUM, slices, terms
from .staging import named, small_batches, staged

#: Parts over which one term's postings are dealt.
SALTS = 64
#: Distinct terms asked for, and rows (item, term), up to which workers hold them all; beyond, they are joined by shuffles.
HELD_TERMS, HELD_ROWS = 200_000, 500_000


def item_terms(items: DataFrame, *, id: str = "item_id", text: str = "text") -> DataFrame:
    """(item_id, term, times): the terms of each item.  Rows that share an id, also a null one, are one item; without text, none."""
    kind = items.schema[id].dataType
    schema = T.StructType([T.StructField("item_id", kind), T.StructField("term", T.StringType()), T.StructField("times", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high in slices(batch.column(1)):
                distinct, row, code, count = terms(batch.column(1).slice(low, high - low), ALNUM)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row + low)), distinct.take(pa.array(code)), pa.array(count)], names=["item_id", "term", "times"])

    small_batches(items.sparkSession)
    found = items.select(named(id).alias("item_id"), named(text).cast("string").alias("text")).mapInArrow(run, schema)
    return found.groupBy("item_id", "term").agg(F.sum("times").alias("times"))


def postings(docs: DataFrame, *, id: str = "doc_id", text: str = "text", asked: tuple[str, ...] | None = None) -> DataFrame:
    """(term, row, doc_id, tf, n) of all documents, dealt by term and sorted by it; ``asked`` leaves other terms out before the shuffle.

    ``row`` tells rows of one id apart.  A row without a term stands for a slice
    of texts: tf sums its terms, n counts its documents that have any.
    """
    kind = docs.schema[id].dataType
    schema = T.StructType(
        [T.StructField("term", T.StringType()), T.StructField("row", T.LongType()), T.StructField("doc_id", kind), T.StructField("tf", T.LongType()), T.StructField("n", T.LongType())]
    )
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = None if asked is None else pa.array(asked, pa.string())
        for batch in batches:
            row_id, doc_id, column = batch.columns
            for low, high in slices(column):
                distinct, row, code, count = terms(column.slice(low, high - low), ALNUM)
                n = np.bincount(row, weights=count, minlength=high - low).astype(np.int64)
                total = [pa.nulls(1, pa.string()), pa.nulls(1, pa.int64()), pa.nulls(1, doc_id.type), pa.array([int(n.sum())]), pa.array([int((n > 0).sum())])]
                yield pa.RecordBatch.from_arrays(total, names=names)
                if wanted is not None:
                    held = pc.is_in(distinct, value_set=wanted).to_numpy(zero_copy_only=False)[code]
                    row, code, count = row[held], code[held], count[held]
                order = np.argsort(code, kind="stable")  # a term's rows stand together, which packs better
                row, code, count = row[order], code[order], count[order]
                at = pa.array(row + low)
                yield pa.RecordBatch.from_arrays([distinct.take(pa.array(code)), row_id.take(at), doc_id.take(at), pa.array(count), pa.array(n[row])], names=names)

    small_batches(docs.sparkSession)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), named(id).alias("doc_id"), named(text).cast("string").alias("text"))
    found = rows.mapInArrow(run, schema)
    return found.repartition(F.col("term"), F.pmod(F.xxhash64("row"), F.lit(SALTS))).sortWithinPartitions("term", "row")


def search(
    docs: DataFrame,
    items: DataFrame,
    *,
    id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    k: int = 20,
    k1_milli: int = 1200,
    b_percent: int = 25,
) -> DataFrame:
    """The ``k`` best documents of every item: (item_id, rank, doc_id, score).

    A term in df of N documents (those that have terms) weighs w = floor(1000
    ln((2N + 2) / (2df + 1))); a match adds w * ((10**9 tf) div (1000 tf + k1
    m / 100)) for each time that the item has the term, where m = 100 - b + (b
    n N) div L, n the document's terms and L all documents' terms.  Whole
    numbers of 64 bits throughout: b n N stays below 2**63, else an error is
    raised.  Equal scores go by document id, null ids last, then by the row's place.

    Terms of items are a query: up to HELD_TERMS of them reach the tasks that
    build postings, so that no other term is shuffled, and up to HELD_ROWS of
    their rows are broadcast to a document's matches, which are then summed
    where they are.  Beyond either number the same rows come from shuffled
    joins.  Only k rows of an item leave a task before the ranking.

    Cases: null and empty texts have no terms and are no documents of N; a very
    long text is one task's memory; repeated rows are documents of their own,
    also where they share an id; rows that share an item id are one item; a
    null item id is an id; items without terms or matches have no rows, and so
    have empty tables; other columns are ignored.
    """
    wanted = staged(item_terms(items, id=item_id, text=item_text))
    rows, distinct = wanted.agg(F.count(F.lit(1)), F.count_distinct("term")).first()
    few = distinct <= HELD_TERMS
    asked = tuple(sorted(r["term"] for r in wanted.select("term").distinct().collect())) if few else None
    index = staged(postings(docs, id=id, text=text, asked=asked))
    length, n_docs = index.where("term IS NULL").agg(F.coalesce(F.sum("tf"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    found = index.where("term IS NOT NULL")
    if not few:
        found = found.join(wanted.select("term").distinct(), "term", "left_semi")
    weight = F.floor(1000 * F.log((2 * F.lit(n_docs) + 2) / (2 * F.col("df") + 1))).cast("long")
    weights = found.groupBy("term").agg(F.count(F.lit(1)).alias("df")).select("term", weight.alias("weight"))
    scored = (
        found.join(F.broadcast(weights) if few else weights, "term")
        .where("weight > 0")
        .selectExpr("term", "row", "doc_id", "tf", "weight", f"{100 - b_percent} + ({b_percent} * n * {n_docs}L) div {max(length, 1)}L AS m")
        .selectExpr("term", "row", "doc_id", f"weight * ((1000000000L * tf) div (1000 * tf + ({k1_milli} * m) div 100)) AS score")
    )
    hits = scored.repartition("row").join(F.broadcast(wanted), "term") if rows <= HELD_ROWS else scored.join(wanted, "term")
    sums = hits.groupBy("row", "doc_id", "item_id").agg(F.sum(F.col("score") * F.col("times")).alias("score")).where("score > 0")
    best = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "row")
    return sums.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


ORACLE_SQL = r"""
WITH w AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
p AS (SELECT doc_id, term, count(*) AS tf FROM w GROUP BY ALL),
d AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM p GROUP BY 1),
s AS (SELECT count(*)::BIGINT AS big_n, sum(n)::BIGINT AS big_l FROM d),
i AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY ALL),
t AS (SELECT term, floor(1000 * ln((2 * any_value(big_n) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS weight FROM p, s WHERE term IN (SELECT term FROM i) GROUP BY 1),
m AS (SELECT doc_id, term, weight * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * big_n) // big_l))) AS score FROM p JOIN d USING (doc_id) JOIN t USING (term), s),
r AS (SELECT item_id, doc_id, sum(score * times)::BIGINT AS score FROM m JOIN i USING (term) GROUP BY ALL HAVING sum(score * times) > 0),
k AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM r)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM k WHERE rank <= 20
"""
