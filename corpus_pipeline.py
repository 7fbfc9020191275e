"""The corpus pipeline: five stages, each a table of documents to the next.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir)
and returns a DataFrame with the columns of documents; the last adds copies.

Cases, for every stage: null texts and texts without words fall to the quality
rules and pass the others as they are; null and repeated ids keep their rows
apart; repeated rows meet as near duplicates, of which one stays; a very long
text is worked on whole, in one task; an empty table gives an empty table;
columns of any other name keep their values, and what a stage adds for itself
takes a name that the input does not have (the last one's ``copies`` too).
n_chars follows the text where a stage changes it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.llm import decontaminate, mixing, near_dedup, pii, quality_rules
from tracewright.llm.staging import columns_of, fresh_name, temporary
from tracewright.sources.shared import new_folder

#: No SQL gives these rows: two stages are fitted models and one is a similarity join.
ORACLE_SQL = None


def keep_sound(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality rules: documents that the fixed rules or the forest reject go."""
    rules = quality_rules.fit_rules(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    told = fresh_name(docs.columns, "rules")
    return quality_rules.apply_rules(docs, rules, into=told).where(F.col(told)["kept"]).select(*columns_of(docs))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Near duplicates (five words, a similarity of 0.8): one document of each group stays."""
    return near_dedup.drop_near_duplicates(docs, width=5, percent=80)


def cut_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages leave the texts; a document of nothing else goes."""
    told = fresh_name(docs.columns, "marks")
    marked = decontaminate.mark_benchmark(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), cut=True, into=told)
    hit = decontaminate.hit_words(told)
    return _recounted(marked.where((hit == 0) | (hit < F.col(told)["n_words"])).select(*columns_of(docs)))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data gives way to the name of its kind."""
    return _recounted(pii.redact(docs))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document with the number of copies that the mix takes of it."""
    return mixing.mix_documents(docs, weights=(3, 1, 2), share=1.5, cap=2.0, into=fresh_name(docs.columns, "copies"))


def _recounted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


STAGES = [
    ("quality rules", keep_sound),
    ("near duplicates", keep_one_of_each),
    ("benchmark decontamination", cut_benchmark),
    ("personal data", redact_personal_data),
    ("source mixing", mix),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what one keeps is written before the next begins."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    last = None
    for _, stage in STAGES[:-1]:
        with temporary(spark) as gone:  # what a stage wrote for itself, and what it read, go once its result is written
            where = new_folder(spark, "stage")
            stage(spark, docs, sf_dir).write.parquet(where)
            gone += [last] if last else []
        docs, last = spark.read.parquet(where), where
    return STAGES[-1][1](spark, docs, sf_dir)
