"""Integrity checks: each gives violation or grade rows, none stops at the first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.tokens import token_counts
from ..sources.shared import written
from .containment import contains_join


def required_fields(rows: DataFrame, key: str, fields: tuple[str, ...], allowed: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """(key, field, problem): fields that are null or blank, and values outside their list."""
    told = [F.when(F.col(f).isNull() | (F.length(X.stripped(F.col(f).cast("string"))) == 0), F.struct(F.lit(f).alias("field"), F.lit("missing").alias("problem"))) for f in fields]
    told += [F.when(~F.col(f).isin(*values), F.struct(F.lit(f).alias("field"), F.lit("not allowed").alias("problem"))) for f, values in (allowed or {}).items()]
    return rows.select(key, F.explode(F.array_compact(F.array(*told))).alias("x")).select(key, "x.*")


def unexpected_fields(records: DataFrame, key: str, raw: str, known: tuple[str, ...]) -> DataFrame:
    """(key, field): fields of a JSON object that are not among the known ones."""
    given = F.json_object_keys(raw)
    return records.select(key, F.explode(F.array_except(given, F.array(*[F.lit(k) for k in known]))).alias("field"))


def artifact_gate(files: DataFrame, calls: DataFrame, judge: DataFrame, texts: DataFrame, required: tuple[str, ...], sections: dict[str, tuple[str, ...]], arms: tuple[str, ...], n_items: int, keys: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """(place, problem) for everything that keeps a run from being complete; no rows if it is clean.

    files: (name) of the run's folder; calls: (file, arm, output_tokens) and
    judge: (file, arm, item_pass, judge_error), one row for each record file,
    ``arm`` as its name says with ``said`` as its content says; texts: (name,
    text); sections: what each text must hold; keys: the fields that each JSON
    text must have, as paths below ``$``; one that is no object has no fields.
    """
    spark = files.sparkSession
    told = lambda df, place, problem: df.select(place.alias("place"), problem.alias("problem"))
    listed = spark.createDataFrame([(n,) for n in required], "name string")  # a handful
    out = told(listed.join(files, "name", "left_anti"), F.col("name"), F.lit("missing"))
    each = spark.createDataFrame([(k, a) for k in ("calls", "judge") for a in arms], "kind string, arm string")
    counts = calls.groupBy("arm").agg(F.count(F.lit(1)).alias("n")).withColumn("kind", F.lit("calls")).unionByName(judge.groupBy("arm").agg(F.count(F.lit(1)).alias("n")).withColumn("kind", F.lit("judge")))
    short = each.join(counts, ["kind", "arm"], "left").na.fill(0, ["n"]).where(F.col("n") != n_items)
    out = out.unionByName(told(short, F.concat_ws("/", "kind", "arm"), F.format_string(f"expected {n_items} records, found %d", "n")))
    out = out.unionByName(told(calls.where(~F.col("said").eqNullSafe(F.col("arm"))), F.col("file"), F.lit("another arm")))
    out = out.unionByName(told(calls.where(F.coalesce("output_tokens", F.lit(0)) <= 0), F.col("file"), F.lit("no output tokens")))
    out = out.unionByName(told(judge.where(F.col("item_pass").isNull()), F.col("file"), F.lit("item_pass is no flag")))
    out = out.unionByName(told(judge.where(F.coalesce("judge_error", F.lit(True))), F.col("file"), F.lit("judge error")))
    for name, parts in sections.items():
        for part in parts:
            out = out.unionByName(told(texts.where((F.col("name") == name) & ~F.contains("text", F.lit(part))), F.col("name"), F.lit(f"lacks {part}")))
    if keys:
        # the fields of all files are looked up in one pass over the texts
        absent = [F.when((F.col("name") == name) & F.try_variant_get("v", f"$.{k}", "variant").isNull(), F.lit(f"lacks the field {k}")) for name, fields in keys.items() for k in fields]
        read = texts.where(F.col("name").isin(*keys)).select("name", F.try_parse_json("text").alias("v"))
        readable = F.coalesce(F.schema_of_variant("v").startswith("OBJECT"), F.lit(False))
        problems = F.when(readable, F.array_compact(F.array(*absent))).otherwise(F.array(F.lit("is no JSON object")))
        out = out.unionByName(read.select(F.col("name").alias("place"), F.explode(problems).alias("problem")))
    return out


def repeated_ids(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def flag_mismatches(manifest: DataFrame, truth: DataFrame, key: str, flag: str) -> DataFrame:
    """Items whose flag differs between two sources, and items that one of them lacks."""
    a, b = manifest.select(key, F.col(flag).alias("stated")), truth.select(key, F.col(flag).alias("actual"))
    both = a.withColumn("_a", F.lit(1)).join(b.withColumn("_b", F.lit(1)), key, "full_outer")
    problem = F.when(F.col("_b").isNull(), "no truth").when(F.col("_a").isNull(), "orphan").when(~F.col("stated").eqNullSafe(F.col("actual")), "differs")
    return both.withColumn("problem", problem).where(F.col("problem").isNotNull()).select(key, "stated", "actual", "problem")


def record_drift(recomputed: DataFrame, committed: DataFrame) -> DataFrame:
    """Rows on one side only, with multiplicity; none where both agree."""
    extra = recomputed.exceptAll(committed).withColumn("side", F.lit("recomputed"))
    return extra.unionByName(committed.exceptAll(recomputed).withColumn("side", F.lit("committed")))


def touched(before: DataFrame, after: DataFrame, key: str, fields: tuple[str, ...]) -> DataFrame:
    """Keys where any field changed; null is a value."""
    b, a = before.alias("b"), after.alias("a")
    changed = F.lit(False)
    for f in fields:
        changed = changed | ~F.col(f"b.{f}").eqNullSafe(F.col(f"a.{f}"))
    return b.join(a, F.col(f"b.{key}") == F.col(f"a.{key}")).where(changed).select(F.col(f"b.{key}"))


def line_rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line_no, line): physical lines from 1."""
    return docs.select(key, F.posexplode(F.split(text, "\n", -1)).alias("n", "line")).select(key, (F.col("n") + 1).cast("long").alias("line_no"), "line")


def resolve_paths(citations: DataFrame, files: DataFrame, lines: DataFrame | None = None) -> DataFrame:
    """The citations with ``path`` as a file's own and ``how`` it was found: exact, short id, suffix, ambiguous or none.

    files: (path).  A short id is the first eight characters of a file's name,
    hexadecimal; an elided path is an ellipsis, a slash and the path's last
    parts.  Files are keyed by name and by their ends at slashes, so that all
    three are equi-joins.  A path that is not resolved stays as it is.

    Eight characters name more than one file once there are many.  With ``lines``
    (path, line_no, line) a name of several files is that of the one whose cited
    line holds the quote; where none or several do, it stays ambiguous.
    """
    paths = files.select(F.col("path").alias("_file")).distinct()
    steps = F.split("_file", "/")
    name = F.element_at(steps, -1)
    ends = F.transform(F.sequence(F.lit(1), F.size(steps)), lambda i: F.array_join(F.slice(steps, i, F.size(steps)), "/"))
    keys = paths.select("_file", F.lit("exact").alias("how"), F.col("_file").alias("_key"))
    keys = keys.unionByName(paths.select("_file", F.lit("short id").alias("how"), F.substring(name, 1, 8).alias("_key")).where(F.col("_key").rlike("^[0-9a-f]{8}$")))
    keys = keys.unionByName(paths.select("_file", F.lit("suffix").alias("how"), F.explode(ends).alias("_key")))
    elided = F.regexp_extract("path", r"^(?:…|\.\.\.)/(.+)$", 1)
    kind = F.when(elided != "", "suffix").when(F.col("path").rlike("^[0-9a-f]{8}$"), "short id")
    asked = citations.select("path").distinct()
    wanted = asked.select("path", F.lit("exact").alias("how"), F.col("path").alias("_key")).unionByName(
        asked.select("path", kind.alias("how"), F.when(elided != "", elided).otherwise(F.col("path")).alias("_key")).where("how IS NOT NULL")
    )
    met = wanted.join(keys, ["how", "_key"]).select("path", "how", "_file")
    if lines is not None:
        met = written(met)
    found = met.groupBy("path").agg(
        F.min(F.when(F.col("how") == "exact", F.col("_file"))).alias("_own"), F.min("_file").alias("_one"), F.max("_file").alias("_other"), F.max("how").alias("_how")
    )
    how = F.when(F.col("_own").isNotNull(), "exact").when(F.col("_one").isNull(), "none").when(F.col("_one") == F.col("_other"), F.col("_how")).otherwise("ambiguous")
    told = citations.join(found, "path", "left").withColumn("how", how)
    if lines is not None:
        several = found.where(how == "ambiguous").select("path")
        # written, so that the planner knows how few they are before it deals the lines
        each = written(citations.select("cite", "path", "line", X.quote_key(F.col("quote")).alias("_q")).join(met.join(several, "path"), "path").select("cite", "line", "_q", F.col("how").alias("_kind"), "_file"))
        stands = each.join(lines.select(F.col("path").alias("_file"), F.col("line_no").alias("line"), F.col("line").alias("_text")), ["_file", "line"]).where(F.contains(X.quote_key(F.col("_text")), F.col("_q")))
        settled = stands.groupBy("cite").agg(F.min("_file").alias("_held"), F.max("_file").alias("_last"), F.max("_kind").alias("_kind")).where("_held = _last").drop("_last")
        told = told.join(settled, "cite", "left").withColumn("how", F.coalesce("_kind", "how")).withColumn("_one", F.coalesce("_held", "_one"))
    path = F.when(F.col("how").isin("short id", "suffix"), F.col("_one")).otherwise(F.col("path"))
    return told.select(*[path.alias(c) if c == "path" else F.col(c) for c in citations.columns], "how")


def grade_citations(citations: DataFrame, lines: DataFrame, near: int = 5) -> DataFrame:
    """(cite, path, line, quote) against (path, line_no, line): a grade for each citation.

    VALID: the quote stands on the cited line; DRIFT: within ``near`` lines;
    ELSEWHERE: farther in the file; SPLICE?: each part around an ellipsis is in
    the file; NOT-FOUND; NO-FILE.  ``nearest`` is the hit next to the cited
    line, the earlier of two.

    First a citation meets the lines about the cited one, by an equi-join on
    (path, line).  Quotes that are not there are looked up in their files by
    their rarest pieces, and so are the parts of those that are nowhere as a
    whole.  So the work is linear in lines and citations, not their product.
    All lines of a cited file count.  An empty quote stands on any near line.
    """
    held = lines.join(citations.select("path").distinct(), "path", "left_semi").groupBy("path").agg(F.count(F.lit(1)).alias("n_lines"))
    said = citations.select("cite", "path", "line", X.quote_key(F.col("quote")).alias("q"))
    about = said.withColumn("line_no", F.explode(F.sequence(F.col("line") - near, F.col("line") + near)))
    met = about.join(lines.select("path", "line_no", F.col("line").alias("text")), ["path", "line_no"])
    met = met.select("cite", "line", "line_no", "q", X.quote_key(F.col("text")).alias("key")).where(F.contains("key", "q"))
    order = F.struct(F.abs(F.col("line_no") - F.col("line")).alias("d"), F.col("line_no").alias("l"))
    close = met.groupBy("cite").agg(F.min(order)["l"].alias("nearest"))
    first = written(said.join(held, "path", "left").join(close, "cite", "left"))

    rest = first.where("nearest IS NULL AND n_lines IS NOT NULL AND length(q) > 0").select("cite", "path", "line", "q")
    parts = F.filter(F.split("q", r"\s*(?:\.\.\.|…)\s*"), lambda p: F.length(p) > 0)
    # a quote's whole is piece 0; the parts around its ellipses follow, where there are two or more
    split = rest.withColumn("parts", F.when(F.size(parts) > 1, F.array_distinct(parts)).otherwise(F.array().cast("array<string>")))
    each = split.select("path", "cite", "line", F.posexplode(F.concat(F.array("q"), "parts")).alias("i", "part")).withColumn("piece", F.struct("cite", "line", "i"))
    texts = lines.join(rest.select("path").distinct(), "path", "left_semi").select("path", "line_no", X.quote_key(F.col("line")).alias("key"))
    met = contains_join(texts, each, "line_no", "key", "piece", "part", by=("path",)).select("line_no", "piece.*")
    far = met.groupBy("cite").agg(F.min(F.when(F.col("i") == 0, order))["l"].alias("farther"), F.size(F.collect_set(F.when(F.col("i") > 0, F.col("i")))).alias("n_seen"))
    far = far.join(split.select("cite", F.size("parts").alias("n_parts")), "cite")
    far = far.select("cite", "farther", ((F.col("n_parts") > 0) & (F.col("n_seen") == F.col("n_parts"))).alias("spliced"))
    graded = first.join(far, "cite", "left").withColumn("nearest", F.coalesce("nearest", "farther"))
    distance = F.abs(F.col("nearest") - F.col("line"))
    grade = (
        F.when(F.col("n_lines").isNull(), "NO-FILE").when(distance == 0, "VALID").when(distance <= near, "DRIFT")
        .when(distance > near, "ELSEWHERE").when(F.col("spliced"), "SPLICE?").otherwise("NOT-FOUND")
    )
    return graded.select("cite", "path", "line", "nearest", grade.alias("grade"))


def check_ranges(citations: DataFrame, lines: DataFrame, near: int = 5) -> DataFrame:
    """(cite, path, line, quote or null) -> status: missing file, out of range, bad quote, ok.

    The quote is sought in the joined text of the lines around the cited one.
    """
    held = lines.groupBy("path").agg(F.max("line_no").alias("n_lines"))
    around = citations.select("cite", "path", F.col("line").alias("at")).join(lines, "path").where(F.abs(F.col("line_no") - F.col("at")) <= near)
    window = around.groupBy("cite").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "line"))), lambda s: s["line"]), " ").alias("window"))
    told = citations.join(held, "path", "left").join(window, "cite", "left")
    quote = F.contains(X.collapsed(F.coalesce("window", F.lit(""))), X.collapsed(F.col("quote")))
    status = F.when(F.col("n_lines").isNull(), "missing file").when((F.col("line") < 1) | (F.col("line") > F.col("n_lines")), "out of range").when(F.col("quote").isNotNull() & ~quote, "bad quote").otherwise("ok")
    return told.select("cite", "path", "line", status.alias("status"))


def grade_tallies(graded: DataFrame) -> DataFrame:
    """Counts by the grade's name, without what stands in brackets."""
    return graded.groupBy(F.substring_index("grade", "(", 1).alias("grade")).agg(F.count(F.lit(1)).alias("n"))


def basename_index(paths: DataFrame) -> DataFrame:
    """(name, path): the first path, in order, of each file name."""
    return paths.groupBy(F.substring_index("path", "/", -1).alias("name")).agg(F.min("path").alias("path"), F.count(F.lit(1)).alias("n_paths"))


def text_rules(docs: DataFrame, key: str, text: str, rules: tuple[tuple[str, str, str, bool], ...]) -> DataFrame:
    """(rule, severity, expression, must): a finding where the expression's presence is not as it must be."""
    told = [F.when(F.col(text).rlike(p) != F.lit(must), F.struct(F.lit(r).alias("rule"), F.lit(s).alias("severity"))) for r, s, p, must in rules]
    return docs.select(key, F.explode(F.array_compact(F.array(*told))).alias("x")).select(key, "x.*")


def harvested_strings(rows: DataFrame, key: str, raw: str, depth: int = 4) -> DataFrame:
    """(key, strings): all strings of a JSON value down to ``depth`` levels below it, by their place.

    Each level is one lateral expansion of the objects and lists above it.
    """
    spark = rows.sparkSession
    level = rows.select(key, F.lit("").alias("place"), F.try_parse_json(raw).alias("v"))
    found = None
    for k in range(depth + 1):
        texts = level.where(F.schema_of_variant("v") == "STRING").select(key, "place", F.variant_get("v", "$", "string").alias("s"))
        found = texts if found is None else found.unionByName(texts)
        if k < depth:
            inner = level.where(F.schema_of_variant("v").rlike("^(OBJECT|ARRAY)")).withColumnRenamed("v", "_above")
            each = inner.lateralJoin(spark.tvf.variant_explode(F.col("_above").outer()))
            level = each.select(key, F.concat_ws(".", "place", F.coalesce("key", F.lpad(F.col("pos").cast("string"), 9, "0"))).alias("place"), F.col("value").alias("v"))
    strings = found.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("place", "s"))).alias("x"))
    none = F.array().cast("array<string>")
    return rows.select(key).join(strings, key, "left").select(key, F.coalesce(F.transform("x", lambda e: e["s"]), none).alias("strings"))


def paragraphs(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, paragraph_no, paragraph): blocks between blank lines."""
    return docs.select(key, F.posexplode(F.split(text, r"\n\s*\n")).alias("paragraph_no", "paragraph")).where(F.length(X.stripped(F.col("paragraph"))) > 0)


def budgets(docs: DataFrame, key: str, text: str, max_lines: int, max_chars: int) -> DataFrame:
    """Texts over a budget of lines or characters."""
    sized = docs.select(key, F.size(F.split(text, "\n", -1)).cast("long").alias("lines"), F.length(text).cast("long").alias("chars"))
    return sized.where((F.col("lines") > max_lines) | (F.col("chars") > max_chars))


def token_budgets(docs: DataFrame, keys: tuple[str, ...], text: str, max_tokens: int, file: str, token_bytes: int = 1) -> DataFrame:
    """(…, tokens): texts over a budget of tokens, counted by a tokenizer's file; null texts have none.

    A text of no more bytes than tokens are allowed cannot exceed them, so it is
    not encoded: ``token_bytes`` is the least number of bytes of a token, 0 for
    a tokenizer that rewrites texts and so may make more of them.
    """
    within = F.octet_length(text) <= max_tokens * token_bytes if token_bytes else F.lit(False)
    asked = docs.select(*keys, text).where(F.col(text).isNotNull() & ~within)
    return asked.select(*keys, token_counts(file)(F.col(text)).alias("tokens")).where(F.col("tokens") > max_tokens)


#: Lines that ``hunks`` orders in one task, at about.
TASK_LINES = 250_000


def hunks(lines: DataFrame, path: str = "path", order: str = "line_no", line: str = "line") -> DataFrame:
    """Unified-diff hunks: declared and counted lengths, the shift before each, overlap with the one before.

    A hunk's number is the running count of its headers; a file's lines are
    ordered in one window.  Files are dealt to more tasks as the lines grow, so
    that a task's lines do not; a count goes before.
    """
    lines = lines.repartition(lines.count() // TASK_LINES + 1, path)
    by_line = Window.partitionBy(path).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    header = F.col(line).startswith("@@")
    numbered = lines.withColumn("hunk", F.sum(F.when(header, 1).otherwise(0)).over(by_line)).where("hunk > 0")
    pattern = r"^@@ -([0-9]+)(?:,([0-9]+))? \+([0-9]+)(?:,([0-9]+))? @@"
    part = lambda k: F.max(F.when(header, F.regexp_extract(line, pattern, k)))
    number = lambda c, empty: F.coalesce(c.try_cast("long"), F.lit(empty))
    starts = lambda p: F.col(line).startswith(p) & ~header
    out = numbered.groupBy(path, "hunk").agg(
        number(part(1), 0).alias("old_start"), number(part(2), 1).alias("old_declared"), number(part(3), 0).alias("new_start"), number(part(4), 1).alias("new_declared"),
        F.count_if(starts("-") | starts(" ")).alias("old_counted"), F.count_if(starts("+") | starts(" ")).alias("new_counted"),
        F.count_if(starts("+")).alias("added"), F.count_if(starts("-")).alias("removed"),
    )
    by_hunk = Window.partitionBy(path).orderBy("hunk")
    shift = F.coalesce(F.sum(F.col("added") - F.col("removed")).over(by_hunk.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    previous_end = F.lag(F.col("old_start") + F.col("old_counted")).over(by_hunk)
    return out.select(
        "*", shift.alias("shift"), (F.col("old_declared") == F.col("old_counted")).alias("old_ok"), (F.col("new_declared") == F.col("new_counted")).alias("new_ok"),
        F.coalesce(F.col("old_start") < previous_end, F.lit(False)).alias("overlaps"), (F.col("new_start") == F.col("old_start") + shift).alias("placed_ok"),
    )
