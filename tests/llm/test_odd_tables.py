"""Tables with odd columns: clashing, missing, nulls everywhere."""

import pytest
from pyspark.sql import functions as F

from patchweave.llm import chosen_path, decontaminate, fair_mix, kneser_ney, splitters, suffix_dedup
from patchweave.llm.common import pick, wrapped

NAMES = ["row", "key", "hash", "target", "pass", "at", "m", "d", "th", "sid", "c0", "finish", "a.b"]


def odd(spark):
    rows = [(1, "alpha beta gamma delta epsilon zeta", "en", "s1"), (2, None, None, None), (None, "alpha beta gamma delta epsilon zeta eta", None, "s1"), (3, "", "en", None), (3, "one two", "en", "s2")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    for n in NAMES:
        df = df.withColumn(n, F.lit(f"own {n}"))
    return df


def test_pick_and_wrapped(spark):
    df = odd(spark).withColumnRenamed("row", "Doc_Id2")
    assert pick(df, doc_id="long", gone="string").collect()[0] == (1, None)
    assert wrapped(odd(spark)).select("row.*").columns == odd(spark).columns


@pytest.mark.parametrize("stage", ["quality", "near", "leaks", "mix"])
def test_stages_return_their_rows(spark, stage):
    df = odd(spark)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([(None, None), (4, "nothing like it here")], "item_id long, text string")
    out = {
        "quality": lambda: kneser_ney.keep_good(df, none), "near": lambda: chosen_path.one_of_each(df),
        "leaks": lambda: decontaminate.clean(df, items), "mix": lambda: fair_mix.mixed_documents(df, n_ranges=2),
    }[stage]()
    assert out.columns == df.columns
    got = out.collect()
    assert got and all(r[n] == f"own {n}" for r in got for n in NAMES)
    if stage == "leaks":
        assert len(got) == 5
    if stage == "quality":
        assert sorted(r.text for r in got)[0] == "alpha beta gamma delta epsilon zeta" and len(got) == 3
    if stage == "near":
        assert len(got) == 5  # 5 of 6 shingles at most are shared: 2 of 3 here


def test_operators_on_odd_tables(spark):
    df = odd(spark)
    assert splitters.shard(df, 4).count() == suffix_dedup.remove_repeats(df).count() == chosen_path.similar(df).count() == fair_mix.mix(df).count() == 5


def test_names_that_differ_by_case_or_come_twice(spark):
    df = spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta", "x", "own", 5), (2, None, "y", None, 6)], "doc_id long, text string, TEXT2 string, source string, DOC2 long")
    df = df.toDF("doc_id", "text", "TEXT", "text", "Doc_Id")
    assert [tuple(r) for r in pick(df, doc_id="long", text="string").collect()] == [(1, "alpha beta gamma delta epsilon zeta"), (2, None)]
    assert splitters.shard(df, 4).count() == fair_mix.mix(df).count() == suffix_dedup.remove_repeats(df).count() == 2
    items = spark.createDataFrame([(4, "alpha beta")], "item_id long, text string")
    assert decontaminate.clean(df, items).columns == df.columns
    assert [r[0] for r in decontaminate.clean(df, items).collect()] == [2]
