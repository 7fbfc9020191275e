r"""Personal data: base patterns, and identifiers found by bootstrapped contexts.

Base spans come from four regular expressions; keys assigned as quoted
hexadecimal numbers in lower case seed a fifth kind, secret.  Seeds and
candidates (tokens with a digit or an at sign) are the instances of a graph;
its patterns are the word before an instance, the two words before, and the
word after.  Scores go back and forth: a pattern is worth the share of its
instances that are known of a kind, a candidate the combined worth of its
patterns; after ROUNDS rounds, candidates of high confidence are identifiers
of that kind, whatever they look like.

All of it is DataFrame operations.  Matches carry the lengths of the text
between them, so positions are running sums over a text's few matches.

The expressions below find what the plain ones find (see PLAIN), but try each
run of characters once: a lookbehind, or the end of the last match, stands
before the first character, and no repeated group needs a stack.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .staging import fresh_name, named, staged

#: The kinds, in their order, and the plain patterns.
KINDS = ("email", "ip", "card", "phone")
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
FOUND = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++\.[A-Za-z0-9-][A-Za-z0-9.-]*?(?=\.\.|\.?(?![A-Za-z0-9.-]))",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9][0-9\x20-]*?(?<=[0-9])(?![\x20-]?[0-9])",
    "phone": PLAIN["phone"],
}
#: Seeds that are no base spans: a number of 32 to 64 hexadecimal digits, quoted behind a colon or an equals sign.
SEEDS = {"secret": r"""(?<=[:=][\x20]?["'])[0-9a-f]{32,64}(?=["'])"""}
#: All kinds, as spans list them.
ALL_KINDS = (*KINDS, *SEEDS)
#: A text without this can hold no match of the kind.
NEEDS = {"email": "@", "ip": ".", "card": "", "phone": "+"}
CANDIDATE = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+"
#: What may open a value that a word stands before.
OPENED = r"""["'(\[<{]+$"""
WORD_BEFORE = r"([^\x20\x09-\x0D]{1,40})[\x20\x09-\x0D]*$"
TWO_BEFORE = r"([^\x20\x09-\x0D]{1,40})[\x20\x09-\x0D]+([^\x20\x09-\x0D]{1,40})[\x20\x09-\x0D]*$"
WORD_AFTER = r"^[^\x20\x09-\x0D]*[\x20\x09-\x0D]+([^\x20\x09-\x0D]{1,40})"
TRIMMED = r"""[.,;:!?()"'\[\]<>{}=|]"""
#: Characters of text beside a match in which its neighbouring words are sought.
CONTEXT = 64
ROUNDS = 3
#: Distinct known instances that a pattern needs, and the worth below which it counts nothing.
SUPPORT, PATTERN_WORTH = 3, 0.6
#: Score from which a candidate is an identifier.
CONFIDENCE = 0.8


def _hits(text: Column, kind: str, pattern: str) -> Column:
    """array<(kind, gap, hit, before, earlier, after)> of the matches; gap: characters since the last match; earlier: the word before the one before."""
    parts, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    zipped = F.zip_with(parts, hits, lambda p, h: F.struct(p.alias("part"), h.alias("hit")))

    def made(x: Column, i: Column) -> Column:
        nearby = F.regexp_replace(F.substring(x["part"], -CONTEXT, CONTEXT), OPENED, "")
        following = F.substring(F.element_at(parts, i + 2), 1, CONTEXT)
        return F.struct(
            F.lit(kind).alias("kind"), F.length(x["part"]).cast("long").alias("gap"), x["hit"].alias("hit"),
            F.lower(F.regexp_extract(nearby, WORD_BEFORE, 1)).alias("before"), F.lower(F.regexp_extract(nearby, TWO_BEFORE, 1)).alias("earlier"), F.lower(F.regexp_extract(following, WORD_AFTER, 1)).alias("after"),
        )

    # a text's last part has no match behind it
    return F.transform(F.slice(zipped, 1, F.size(hits)), made)


def luhn(digits: Column) -> Column:
    """The Luhn check of a string of digits."""
    doubled = F.transform(
        F.split(F.reverse(digits), ""),
        lambda d, i: F.when(i % 2 == 1, d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)).otherwise(d.cast("int")),
    )
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + x) % 10 == 0


def _valid(kind: Column, hit: Column) -> Column:
    digits = F.regexp_replace(hit, "[^0-9]", "")
    parts = F.transform(F.split(hit, r"\."), lambda p: F.regexp_replace(p, "^0+", ""))
    ip = F.forall(parts, lambda p: (F.length(p) < 3) | ((F.length(p) == 3) & (p <= "255")))
    n = F.length(digits)
    card = F.when(n.between(13, 19), luhn(digits)).otherwise(False)
    secret = hit.rlike("[0-9]") & hit.rlike("[a-f]")
    return F.when(kind == "email", True).when(kind == "secret", secret).when(kind == "ip", ip).when(kind == "card", card).when(kind == "phone", n.between(9, 15)).otherwise(True)


def base_matches(docs: DataFrame) -> DataFrame:
    """(row, id, text) -> (row, id, hits): every match, and every candidate token, with its neighbours."""
    text = F.col("text")
    none = _hits(F.lit(""), "none", "x")
    digits = text.rlike("[0-9]")
    found = [
        F.when(F.contains(text, F.lit(NEEDS[k])) if k == "email" else (digits & F.contains(text, F.lit(NEEDS[k])) if NEEDS[k] else digits), _hits(text, k, FOUND[k])).otherwise(none) for k in KINDS
    ]
    quoted = digits & (F.contains(text, F.lit('"')) | F.contains(text, F.lit("'")))
    found += [F.when(quoted, _hits(text, k, p)).otherwise(none) for k, p in SEEDS.items()]
    found.append(F.when(digits | F.contains(text, F.lit("@")), _hits(text, "token", CANDIDATE)).otherwise(none))
    return docs.select("row", "id", F.concat(*found).alias("hits"))


def spans_of(matches: DataFrame) -> DataFrame:
    """(row, kind, start, end, surface, before, earlier, after): valid base spans and seeds, and candidate tokens outside them."""
    each = matches.select("row", F.posexplode("hits").alias("n", "x")).select("row", "n", "x.*")
    upto = Window.partitionBy("row", "kind").orderBy("n")
    ends = F.sum(F.col("gap") + F.length("hit")).over(upto)
    placed = each.withColumn("end", ends).withColumn("start", F.col("end") - F.length("hit"))
    lead = F.length(F.regexp_extract("hit", rf"^{TRIMMED}*", 0))
    core = F.regexp_replace("hit", rf"^{TRIMMED}+|{TRIMMED}+$", "")
    token = F.col("kind") == "token"
    placed = placed.where(_valid(F.col("kind"), F.col("hit"))).select(
        "row", "kind", F.when(token, F.col("start") + lead).otherwise(F.col("start")).alias("start"),
        F.when(token, core).otherwise(F.col("hit")).alias("surface"), "before", "earlier", "after",
    ).withColumn("end", F.col("start") + F.length("surface"))
    order = Window.partitionBy("row").orderBy("start", "end", "kind")
    base = F.col("kind") != "token"
    behind = F.max(F.when(base, F.col("end"))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    ahead = F.min(F.when(base, F.col("start"))).over(Window.partitionBy("row").orderBy(F.col("start").desc(), F.col("end").desc(), F.col("kind").desc()).rowsBetween(Window.unboundedPreceding, -1))
    free = (F.coalesce(behind, F.lit(-1)) <= F.col("start")) & (F.coalesce(ahead, F.col("end")) >= F.col("end"))
    return placed.withColumn("free", base | free).where("free and length(surface) >= 5").drop("free").unionByName(placed.where(base & (F.length("surface") < 5)))


def _patterns() -> list[Column]:
    """The lexical patterns around an instance, null where a word is missing."""
    word = lambda mark, *c: F.when(F.length(c[0]) > 0, F.concat_ws(" ", F.lit(mark), *c))
    return [word("<", "before"), word("<<", "earlier", "before"), word(">", "after")]


def discovered(spans: DataFrame) -> DataFrame:
    """(surface, kind): candidate surfaces that the pattern graph takes for identifiers.

    Edges are distinct (pattern, instance) pairs, so repeated contexts count once.
    Each round counts a pattern's support anew, over seeds and candidates of
    high confidence, so what a round finds induces patterns for the next.
    """
    graph = staged(
        spans.select("kind", F.lower("surface").alias("surface"), F.explode(F.array_compact(F.array(*_patterns()))).alias("pattern"))
        .distinct()
    )
    size = staged(graph.groupBy("pattern").agg(F.count(F.lit(1)).alias("size")))
    fixed = graph.where("kind <> 'token'").select("pattern", "kind", F.lit(1.0).alias("score"))
    open_ = graph.where("kind = 'token'").select("pattern", "surface")
    scores = None
    for _ in range(ROUNDS):
        known = fixed if scores is None else fixed.unionByName(open_.join(scores, "surface").select("pattern", "kind", "score"))
        worth = (
            known.groupBy("pattern", "kind").agg(F.sum("score").alias("good"), F.count_if(F.col("score") >= CONFIDENCE).alias("support"))
            .where(F.col("support") >= SUPPORT).join(size, "pattern")
            .select("pattern", "kind", (F.col("good") / (F.col("size") + 1)).alias("worth"))
            .where(F.col("worth") >= PATTERN_WORTH)
        )
        miss = F.sum(F.ln(F.greatest(F.lit(1.0) - F.col("worth"), F.lit(1e-9))))
        scores = staged(open_.join(worth, "pattern").groupBy("surface", "kind").agg((F.lit(1.0) - F.exp(miss)).alias("score")))
    best = scores.groupBy("surface").agg(F.max(F.struct("score", "kind")).alias("top"))
    return best.where(F.col("top.score") >= CONFIDENCE).select("surface", F.col("top.kind").alias("kind"))


def find_personal_data(docs: DataFrame, *, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: row (a key of its own), id, spans: array of (rank, start, end, kind, base).

    Spans are sorted by kind as ALL_KINDS lists them, then start; start and end
    count code points.  Base spans of one kind do not overlap; a seed of another
    kind may overlap a base span, a discovered span overlaps neither.

    Cases: null and empty texts have no spans; null or repeated ids keep their
    rows apart; repeated rows get equal spans, and count once as instances; a
    very long text is matched whole, in one task; an empty table gives no rows;
    other columns are ignored.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("row"), named(id).alias("id"), F.coalesce(named(text).cast("string"), F.lit("")).alias("text"))
    matches = staged(base_matches(rows))
    spans = staged(spans_of(matches.where(F.size("hits") > 0)))
    names = discovered(spans).withColumnRenamed("kind", "named")
    base = spans.where("kind <> 'token'").select("row", "kind", "start", "end", F.col("kind").isin(*KINDS).alias("base"))
    more = spans.where("kind = 'token'").withColumn("key", F.lower("surface")).join(names.withColumnRenamed("surface", "key"), "key")
    every = base.unionByName(more.select("row", F.col("named").alias("kind"), "start", "end", F.lit(False).alias("base")))
    order = reduce(lambda c, k: F.when(F.col("kind") == k[1], k[0]).otherwise(c), enumerate(ALL_KINDS), F.lit(len(ALL_KINDS)))
    listed = every.groupBy("row").agg(F.sort_array(F.collect_list(F.struct(order.alias("rank"), "start", "end", "kind", "base"))).alias("spans"))
    empty = F.array().cast(listed.schema["spans"].dataType)
    return matches.select("row", "id").join(listed, "row", "left").withColumn("spans", F.coalesce("spans", empty))


def personal_data(docs: DataFrame, *, id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, the number of base spans of each kind, base_sha256, spans, n_spans and n_added (spans that are no base spans).

    Cases: as ``find_personal_data``.
    """
    found = find_personal_data(docs, id=id, text=text)
    line = lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])
    base = F.filter("spans", lambda s: s["base"])
    of = lambda k: F.filter(base, lambda s: s["kind"] == k)
    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select(
        F.col("id").alias("doc_id"), *counts, F.sha2(F.array_join(F.transform(base, line), ","), 256).alias("base_sha256"),
        F.array_join(F.transform("spans", line), ",").alias("spans"), F.size("spans").cast("long").alias("n_spans"), (F.size("spans") - F.size(base)).cast("long").alias("n_added"),
    )


def redact(docs: DataFrame, *, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows with each span's characters replaced by its kind in angle brackets; columns stay as they are.

    Overlapping spans of several kinds become one, named by the first.

    Cases: a null text stays null; null or repeated ids keep their rows apart;
    repeated rows are redacted alike; a very long text costs one task its own
    size; an empty table gives no rows; columns of any name keep their values.
    """
    number = fresh_name(docs.columns, "_row")
    cut = fresh_name(docs.columns, "_cuts")
    keyed = staged(docs.withColumn(number, F.monotonically_increasing_id()))
    rows = keyed.select(named(number).alias("number"), named(text).alias("text"))
    found = find_personal_data(rows, id="number", text="text").where(F.size("spans") > 0).select(F.col("id").alias("number"), "spans")
    by_place = Window.partitionBy("number").orderBy("start", "rank")
    each = found.select("number", F.explode("spans").alias("s")).select("number", "s.rank", "s.kind", "s.start", "s.end")
    behind = F.max("end").over(by_place.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.when(behind.isNull() | (F.col("start") >= behind), 1).otherwise(0)
    islands = each.withColumn("opens", opens).withColumn("island", F.sum("opens").over(by_place))
    merged = islands.groupBy("number", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min_by("kind", F.struct("start", "rank")).alias("kind"))
    last = F.coalesce(F.lag("end").over(Window.partitionBy("number").orderBy("start")), F.lit(0).cast("long"))
    cuts = merged.withColumn("last", last).groupBy(F.col("number").alias(number)).agg(F.sort_array(F.collect_list(F.struct("start", "end", "last", "kind"))).alias(cut))
    body, places = named(text), F.col(cut)
    pieces = F.transform(
        places, lambda c: F.concat(F.substring(body, (c["last"] + 1).cast("int"), (c["start"] - c["last"]).cast("int")), F.lit("<"), F.upper(c["kind"]), F.lit(">"))
    )
    tail = F.substring(body, (F.element_at(places, -1)["end"] + 1).cast("int"), F.lit((1 << 31) - 1))
    whole = F.when(places.isNotNull(), F.concat(F.array_join(pieces, ""), tail)).otherwise(body)
    joined = keyed.join(cuts, number, "left")
    return joined.select(*[whole.alias(c) if c == text else named(c) for c in docs.columns])
