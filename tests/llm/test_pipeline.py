import random
import re

import pytest

import corpus_pipeline as P
from tracewright.llm.staging import staged

from .helpers import components


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 8)))
    text = lambda n: " ".join(word() for _ in range(n))
    items = [(i, text(20)) for i in range(3)]
    docs = [(i, text(rng.randint(60, 120))) for i in range(80)]
    docs += [(100 + i, docs[i][1]) for i in range(5)] + [(110 + i, docs[i][1] + " " + word()) for i in range(5)]
    docs += [(120 + i, text(60) + " " + items[i][1] + " " + text(10)) for i in range(3)]
    docs += [(130, text(60) + " mail me@x.example.org now"), (131, "too short"), (132, None), (133, " ".join(w.upper() + "!!###" for w in text(90).split())), (134, text(70).replace(" ", " $$$ "))]
    labels = [(i, 1) for i in range(60)] + [(i, 0) for i in (133, 134)]
    where = str(tmp_path_factory.mktemp("sf"))
    full = [(i, t, "en", f"s{i % 3}" if i % 11 else None, len(t or "")) for i, t in docs]
    spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame([(i, q, 0) for i, q in labels], "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{where}/benchmark.parquet")
    return where, docs, items


def test_stages(spark, folder):
    where, docs, items = folder
    table = spark.read.parquet(f"{where}/documents.parquet")
    texts, tables = [dict(docs)], [table]
    for k, (_, stage) in enumerate(P.STAGES):
        out = stage(spark, tables[-1], where)
        if k < 4:
            assert out.columns == table.columns
            out = staged(out)
            texts.append({r["doc_id"]: r["text"] for r in out.collect()})
        tables.append(out)
    sound = texts[1]
    assert not {131, 132} & set(sound) and len(set(range(80)) - set(sound)) <= 2
    ids = sorted(sound)
    roots, _ = components([sound[i] for i in ids], 5, 80)
    assert set(texts[2]) == {ids[r] for r in roots}
    for i, t in texts[3].items():
        for _, passage in items:
            assert passage not in t
        if i not in (120, 121, 122):
            assert t == texts[2][i]
    assert all(texts[3][i].split() == [w for w in texts[2][i].split() if w not in items[i - 120][1].split()] for i in (120, 121, 122) if i in texts[3])
    assert texts[4][130] == re.sub(r"me@x.example.org", "<EMAIL>", texts[3][130])
    assert all(texts[4][i] == t for i, t in texts[3].items() if i != 130)
    assert sorted(map(tuple, tables[5].collect()), key=str) == sorted(map(tuple, P.run(spark, where).collect()), key=str)
    assert tables[5].count() == len(texts[4])


def test_empty_documents(spark, folder, tmp_path):
    where, *_ = folder
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{where}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0


NAMES = (
    "kept", "KEPT_", "spans", "items", "n_words", "rules", "marks", "_row", "_cuts", "cuts", "component_id", "component", "hits", "row", "size", "target", "node",
    "label", "copies", "key", "tie", "whole", "source_size", "number", "block", "a.b", "with space",
)


def test_clashing_columns_keep_their_values(spark, folder):
    """Columns of the names that operators use inside, each with values of its own, come through every stage."""
    where, *_ = folder
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{where}/documents.parquet").where("doc_id < 70 or doc_id >= 120")
    mine = lambda k, name: f"{name}-{k}"
    docs = docs.withColumns({name: F.concat(F.lit(f"{name}-"), F.col("doc_id").cast("string")) for name in NAMES})
    for k, (_, stage) in enumerate(P.STAGES):
        out = stage(spark, docs, where)
        assert out.columns == [*docs.columns, *(["copies_"] if k == 4 else [])]
        assert [f.dataType for f in out.schema.fields[: len(docs.columns)]] == [f.dataType for f in docs.schema.fields]
        rows = out.collect()
        assert len(rows) > 60
        for r in rows:
            d = r.asDict()
            assert all(d[name] == mine(d["doc_id"], name) for name in NAMES)


def test_null_and_odd_rows_pass_every_stage(spark, folder):
    """Null ids, texts, sources and languages, empty and repeated rows: no stage fails or loses a row that it should keep."""
    where, documents, _ = folder
    text = documents[3][1]
    rows = [(None, None, None, None, None), (None, "", "en", None, 0), (1, text, None, "s1", None), (1, text, None, "s1", None), (None, text, "en", "s1", 1), (5, "\x0b \n", "en", "s2", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    counts = [len(stage(spark, docs, where).collect()) for _, stage in P.STAGES]
    assert counts == [3, 4, 6, 6, 6]


def test_a_very_long_text_is_worked_on_whole(spark, folder):
    where, _, items = folder
    rng = random.Random(3)
    words = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 8))) for _ in range(300_000)]
    long = " ".join(words[:150_000]) + " " + items[1][1] + " " + " ".join(words[150_000:]) + " me@x.example.org"
    docs = spark.createDataFrame([(1, long, "en", "s1", len(long)), (2, long, "en", "s1", len(long))], "doc_id long, text string, lang string, source string, n_chars long")
    (_, sound), (_, one), (_, cut), (_, redact), (_, mix) = P.STAGES
    assert [r["doc_id"] for r in one(spark, docs, where).collect()] == [1]
    assert all(r["text"].split()[:-1] == words for r in cut(spark, docs, where).collect())
    assert all(r["text"].endswith(" <EMAIL>") for r in redact(spark, docs, where).collect())
    assert sum(r["copies"] for r in mix(spark, docs, where).collect()) == 3
    # the same words throughout, so the rates are those of the short good texts; in the others one rate is far off
    odd = long.replace(" ", " $$$ ")
    both = docs.unionByName(spark.createDataFrame([(3, odd, "en", "s1", len(odd)), (4, "a b c " * 100_000, "en", "s1", 600_000)], docs.schema))
    kept = sorted(r["doc_id"] for r in sound(spark, both, where).collect())
    print("kept", kept)
    assert kept == [1, 2]


def test_the_mix_holds_the_redacted_texts(spark, folder):
    where, *_ = folder
    out = P.run(spark, where)
    assert out.columns == [*spark.read.parquet(f"{where}/documents.parquet").columns, "copies"]
    text = {r["doc_id"]: r["text"] for r in out.collect()}
    assert "<EMAIL>" in text[130] and sum(r["copies"] for r in out.collect()) > 0
