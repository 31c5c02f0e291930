from __future__ import annotations

import random

import corpus_pipeline
from corpus_fixtures import docs, folder  # noqa: F401
from pyspark.sql import functions as F

from shelfmark.llm.queries import QUERIES


def _tables(spark, docs):
    rng = random.Random(8)
    words = [f"word{i}" for i in range(400)]
    prose = lambda n: " ".join(rng.choices(words, k=n)).capitalize() + "."
    passage = prose(30)
    rows = [(i, prose(80), f"s{i % 3}") for i in range(100)]
    rows += [(200 + i, "BAD!! " * (40 + i), "s0") for i in range(30)]
    rows += [(300 + i, rows[i][1] + (" extra" if i % 2 else ""), "s1") for i in range(20)]
    rows += [(400, prose(40) + " " + passage + " " + prose(40), "s2"), (401, prose(60) + " mail a.b@c.org now " + prose(20), None)]
    rows += [(402, rows[50][1], "s2"), (402, rows[50][1], "s2"), (None, prose(70), "s0"), (None, prose(70) + passage, "s0"), (None, None, None)]
    labels = [(i, 0 if 200 <= i < 230 else 1, 0) for i, _, _ in rows if i is not None]
    return {
        "documents": docs(*rows).withColumn("score", F.lit("clash")).withColumn("size", F.lit(-1)),
        "labels": spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"),
        "benchmark": spark.createDataFrame([(1, passage)], "item_id bigint, text string"),
    }


def test_every_stage_decides(spark, docs, folder):
    where = folder(**_tables(spark, docs))
    current = spark.read.parquet(f"{where}/documents.parquet")
    columns, seen = current.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        current = spark.createDataFrame(stage(spark, current, where).collect(), stage(spark, current, where).schema)
        seen[name] = current.collect()
        if name != "mix":
            assert current.columns == columns
    ids = {name: [r.doc_id for r in rows] for name, rows in seen.items()}
    good = ids["quality classifier"]
    assert not [i for i in good if i is not None and 200 <= i < 230]
    assert len([i for i in good if i is not None and (i < 100 or i >= 300)]) == 124
    single = ids["near-duplicates"]
    assert sorted(i for i in single if i is not None) == [*range(100), 400, 401]
    assert len([i for i in single if i is None]) == len([i for i in good if i is None])
    clean = ids["benchmark decontamination"]
    assert 400 not in clean and len([i for i in clean if i is not None]) == 101
    assert len([i for i in clean if i is None]) == len([i for i in single if i is None]) - 1
    text = {r.doc_id: r for r in seen["personal data"]}[401]
    assert "[EMAIL]" in text.text and "a.b@c.org" not in text.text and text.n_chars == len(text.text)
    mix = seen["mix"]
    assert all(0 < r.taken <= 3 * r["size"] and r["size"] > 0 for r in mix)
    size = sum(len((r.text or "").split()) for r in seen["personal data"])
    assert abs(sum(r.taken for r in mix) - size) <= 4


def test_empty_tables(spark, docs, folder):
    full = _tables(spark, docs)
    where = folder(**{name: df.limit(0) for name, df in full.items()})
    assert QUERIES["pipeline"](spark, where).count() == 0


def _long(spark, docs, *rows):
    clash = ["_i", "_d", "_digest", "_score", "_spans", "_size", "_n", "_id", "_source", "_m", "taken"]
    df = docs(*rows)
    for name in clash:
        df = df.withColumn(name, F.concat(F.lit(f"{name} of "), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))))
    return df


def test_repeated_ids_lose_no_text(spark, docs, folder):
    rng = random.Random(12)
    prose = lambda n: " ".join(f"w{rng.randrange(5000)}" for _ in range(n))
    a, b, c = prose(60), prose(60), prose(60)
    near = a + " more"
    rows = [(5, a), (5, b), (3, a), (7, b + " more"), (9, c), (9, c), (2, near), (2, near + " again"), (4, ""), (4, None), (None, a)]
    df = _long(spark, docs, *rows)
    stage = dict(corpus_pipeline.STAGES)["near-duplicates"]
    found = stage(spark, df, "")
    assert found.columns == df.columns
    kept = sorted(((r.doc_id, r.text) for r in found.collect()), key=str)
    smallest = min((near, near + " again"), key=lambda t: __import__("hashlib").md5(t.encode()).hexdigest())
    assert kept == sorted([(2, smallest), (5, b), (9, c), (4, None), (None, a)], key=str)
    assert all(getattr(r, "_n") == f"_n of {r.doc_id if r.doc_id is not None else 'none'}" for r in found.collect())


def test_working_columns_clash_with_none_of_the_documents(spark, docs, folder):
    tables = _tables(spark, docs)
    names = ["_i", "_d", "_digest", "_score", "_spans", "_size", "_n", "_id", "_source", "_m"]
    tables["documents"] = tables["documents"].withColumns({name: F.concat(F.lit(name), "doc_id") for name in names})
    where = folder(**tables)
    current = spark.read.parquet(f"{where}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        current = spark.createDataFrame(stage(spark, current, where).collect(), stage(spark, current, where).schema)
    rows = current.filter("doc_id IS NOT NULL").collect()
    assert len(rows) > 50 and all(r[name] == f"{name}{r.doc_id}" for r in rows for name in names)


def test_mix_takes_the_same_of_rows_alike(spark, docs):
    rng = random.Random(3)
    rows = [(1, " ".join(f"w{rng.randrange(99)}" for _ in range(10)), "a") for _ in range(40)]
    rows += [(2, " ".join("x" for _ in range(30)), "b")]
    stage = dict(corpus_pipeline.STAGES)["mix"]
    once = sorted((r.text, r.taken) for r in stage(spark, docs(*rows), "").collect())
    rng.shuffle(rows)
    again = sorted((r.text, r.taken) for r in stage(spark, docs(*rows).repartition(5), "").collect())
    assert once == again


def test_what_stages_leave_is_removed(spark, docs, folder, monkeypatch, tmp_path):
    from shelfmark.llm import common

    monkeypatch.setattr(common, "shared_dir", lambda spark, purpose: f"{tmp_path}/scratch/{purpose}-{len(common._written)}")
    where = folder(**_tables(spark, docs))
    assert corpus_pipeline.run(spark, where).count() > 0
    left = {p.name.rsplit("-", 1)[0] for p in (tmp_path / "scratch").iterdir()}
    assert {"quality-classifier", "near-duplicates", "benchmark-decontamination", "personal-data"} <= left
    assert not left & {"signatures", "sets", "postings", "statistics", "promising"}
