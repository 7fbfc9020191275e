"""Which texts hold which strings, by the rarest piece of each string."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import written

#: Characters of a piece that is no word.  A shorter string is its own piece.
PIECE = 5
#: Parts of one ``by`` up to which texts are compared with each of them: so few comparisons cost less than cutting a text.
FEW = 8


def runs(text: Column, length: int) -> Column:
    """The distinct runs of ``length`` characters."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{length}}}))"), F.lit(1)))


def words(text: Column) -> Column:
    """The distinct pieces between blanks."""
    return F.array_distinct(F.split(text, " "))


def inner_words(part: Column) -> Column:
    """The words of a part that are whole in any text that holds it: those with a blank on either side."""
    each = F.split(part, " ")
    return F.filter(F.array_distinct(F.slice(each, 2, F.greatest(F.size(each) - 2, F.lit(0)))), lambda w: F.length(w) > 0)


def contains_join(texts: DataFrame, parts: DataFrame, text_key: str, text: str, part_key: str, part: str, by: tuple[str, ...] = ()) -> DataFrame:
    """(by…, text_key, part_key) of every text that holds a part; columns of ``by`` have one name on both sides and are equal.

    A part's pieces are its inner words; where it has none, its runs of PIECE
    characters, or itself if it is shorter.  Of these the one that the fewest
    texts hold is its own; texts that have that piece are compared in full.  So
    a part meets no more texts than its rarest piece does, and all joins are
    on (by, piece): neither side is broadcast or multiplied by the other.
    Texts are cut into runs only where a part of their ``by`` needs it, and not
    at all where their ``by`` has FEW parts: these are compared in full.

    Null and empty parts are in no text here; keys are unique within ``by``,
    of any type; texts that repeat under several keys are found under each.
    """
    known = parts.where(F.length(part) > 0).select(*by, F.col(part_key).alias("_part"), F.col(part).alias("_p"))
    whole = texts.select(*by, F.col(text_key).alias("_text"), F.col(text).alias("_t"))
    told = [*by, F.col("_text").alias(text_key), F.col("_part").alias(part_key)]
    near = None
    if by:
        many = known.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > FEW).select(*by)
        near = whole.join(known.join(many, list(by), "left_anti"), list(by)).where(F.contains("_t", "_p")).select(*told)
        known = known.join(many, list(by), "left_semi")
    length = F.least(F.length("_p"), F.lit(PIECE))
    kind = F.when(F.size(inner_words(F.col("_p"))) > 0, 0).otherwise(length)  # 0: words; else the length of runs
    sorted_out = known.withColumn("_kind", kind)
    kinds = [r["_kind"] for r in sorted_out.select("_kind").distinct().collect()]  # PIECE + 1 at most
    if near is not None and not kinds:
        return near
    own = F.when(F.col("_kind") == 0, inner_words(F.col("_p"))).when(F.length("_p") < PIECE, F.array("_p")).otherwise(runs(F.col("_p"), PIECE))
    cut = sorted_out.select(*by, "_kind", "_part", F.explode(own).alias("_piece"))
    held = None
    for k in kinds or [0]:
        mine = texts
        if by:
            mine = texts.join(sorted_out.where(F.col("_kind") == k).select(*by).distinct(), list(by), "left_semi")
        each = mine.select(*by, F.lit(k).alias("_kind"), F.col(text_key).alias("_text"), F.explode(words(F.col(text)) if k == 0 else runs(F.col(text), k)).alias("_piece"))
        held = each if held is None else held.unionByName(each)
    on = [*by, "_kind", "_piece"]
    held = written(held.join(cut.select(*on).distinct(), on, "left_semi"))
    counts = held.groupBy(*on).agg(F.count(F.lit(1)).alias("_n"))
    rarest = cut.join(counts, on, "left").groupBy(*by, "_kind", "_part").agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), F.col("_piece").alias("p"))).alias("x"))
    rarest = rarest.where("x.n > 0").select(*by, "_kind", "_part", F.col("x.p").alias("_piece"))
    met = held.join(rarest, on).select(*by, "_text", "_part")
    full = met.join(whole, [*by, "_text"]).join(known, [*by, "_part"]).where(F.contains("_t", "_p"))
    found = full.select(*told)
    return found if near is None else found.unionByName(near)
