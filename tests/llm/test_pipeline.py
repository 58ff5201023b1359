"""The pipeline on a small folder of tables: every stage's decisions take effect, clean rows stay."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(8)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(400)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [text(30) for _ in range(4)]
    rows = [(i, text(80)) for i in range(200)]
    rows += [(300 + i, "".join(chr(33 + (i * 7 + j * j) % 90) for j in range(200))) for i in range(10)]  # junk
    for i in range(10):  # near copies, one word in eighty changed
        words = rows[i][1].split()
        words[40] = "zz"
        rows.append((400 + i, " ".join(words)))
    rows += [(500 + i, f"{text(40)} {items[i].upper()} {text(40)}") for i in range(4)]  # leaks
    rows += [(600 + i, f"{text(40)} password = abcdefghijklmnop{i} {text(40)}") for i in range(4)]  # secrets
    rows += [(700, None), (701, "")]
    path = tmp_path_factory.mktemp("tables")
    spark.createDataFrame([(i, t, "en" if i % 2 else "de", f"src{i % 4}", None if t is None else len(t)) for i, t in rows], SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(0, 200)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path), dict(rows)


def test_each_stage_does_its_work_and_keeps_clean_rows(spark, folder):
    path, texts = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns, clean = docs.columns, set(range(200))
    seen = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, path).cache()
        assert docs.columns == columns, name
        seen.append({r["doc_id"]: r["text"] for r in docs.collect()})
    quality, near, leaks, secrets = seen
    assert not set(quality) & set(range(300, 310)) and not {700, 701} & set(quality)
    assert len(clean - set(quality)) <= 3
    assert set(quality) - set(near) == {400 + i for i in range(10) if i in quality}
    assert set(near) - set(leaks) == {500 + i for i in range(4) if 500 + i in near}
    assert set(secrets) == set(leaks)
    for i, t in secrets.items():
        assert ("[SECRET]" in t) == (600 <= i < 604) and "abcdefghijklmnop" not in t
    mix = corpus_pipeline.STAGES[-1][1](spark, docs, path)
    assert mix.columns == [*columns, "copies"] and 0 < mix.count() <= len(secrets)


def test_run_equals_the_stages_in_turn(spark, folder):
    path, _ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, path).cache()
    key = lambda r: (r["doc_id"], r["text"], r["copies"])
    assert sorted(map(key, corpus_pipeline.run(spark, path).collect())) == sorted(map(key, docs.collect()))


def test_secrets_of_repeated_rows_are_redacted(spark, folder):
    path, texts = folder
    docs = spark.read.parquet(f"{path}/documents.parquet").where("doc_id between 600 and 605 or doc_id = 701")
    out = corpus_pipeline.redact_secrets(spark, docs.union(docs).union(docs.withColumn("doc_id", F.lit(None).cast("long"))), path).collect()
    assert len(out) == 15 and sum("[SECRET]" in r["text"] for r in out) == 12 and not any("abcdefghijklmnop" in r["text"] for r in out)
