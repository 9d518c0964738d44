import math
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from themeloom.functions import text as tx
from themeloom.operators import reports, selection, weighting

DOCS = [
    (1, "Red apple, red PEAR!", 0),
    (2, "apple tart; pear tart", 0),
    (3, "fast car on the road", 1),
    (4, "a", 2),
    (5, "noise words here", -1),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, "doc_id long, text string, topic int")


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_tokens_and_ngrams(spark):
    df = spark.createDataFrame([("Été d'été, x_1 a 42",), ("",)], "text string")
    got = [r[0] for r in df.select(tx.tokens("text")).collect()]
    assert got == [["été", "été", "x_1", "42"], []]
    words = df.select(tx.tokens("text").alias("w"))
    grams = [r[0] for r in words.select(tx.ngrams(F.col("w"), 1, 3)).collect()]
    assert grams[0][4:] == ["été été", "été x_1", "x_1 42", "été été x_1", "été x_1 42"] and grams[1] == []
    with pytest.raises(ValueError):
        tx.ngrams(F.col("w"), 2, 1)


def test_snippet_and_clip(spark):
    df = spark.createDataFrame([("  a   b\n c ",), (None,), ("x" * 130,)], "text string")
    got = [r[0] for r in df.select(tx.snippet(F.col("text"))).collect()]
    assert got == ["a b c", "", "x" * 120 + "..."]


def test_ctfidf_by_hand(docs):
    counts = weighting.count_terms(docs, stop=("on", "the"))
    totals = dict(rows(weighting.topic_totals(counts)))
    assert totals == {0: 8, 1: 3, 2: 1}
    mean = 12 / 3
    got = {(t, w): (n, df, s) for t, w, n, _, df, s in rows(weighting.ctfidf(counts))}
    assert got[(0, "red")][:2] == (2, 1)
    assert got[(0, "red")][2] == pytest.approx(2 / 8 * math.log(1 + mean / 1))
    assert all(t != 2 for t, _ in got)
    ranked = rows(weighting.top_words(weighting.ctfidf(counts), 2))
    assert [r[2] for r in ranked if r[0] == 0] == ["apple", "pear"]


def test_bm25_by_hand(docs):
    counts = weighting.count_terms(docs, stop=())
    cells = counts.filter(F.col("term").isNotNull())
    topics = counts.select("topic").distinct()
    got = {(t, w): x for t, w, x in rows(weighting.bm25(cells, 1.5, 0.75, value="n", topics=topics))}
    dl, avg, n, df, x = 8, (8 + 5 + 0) / 3, 3, 1, 2
    idf = math.log((n - df + 0.5) / (df + 0.5) + 1)
    assert got[(0, "red")] == pytest.approx(idf * x * 2.5 / (x + 1.5 * (0.25 + 0.75 * dl / avg)))
    flat = {(t, w): s for t, w, s in rows(weighting.bm25(cells, 1.5, 0.0, value="n", topics=topics))}
    assert flat[(0, "red")] == pytest.approx(idf * x * 2.5 / (x + 1.5))


def test_noise_only_gives_empty_tables(docs):
    noise = docs.withColumn("topic", F.lit(-1))
    ranked = weighting.top_words(weighting.weigh_terms(noise))
    assert ranked.collect() == [] and weighting.words_only(weighting.nest_words(ranked)).columns == ["topic", "words"]
    info = reports.topic_info(noise, ranked).collect()
    assert [(r["Topic"], r["Count"], r["Name"]) for r in info] == [(-1, 5, "Outliers")]


def test_stop_words_keep_repeats(spark):
    df = spark.createDataFrame([(["the", "red", "red"],)], "w array<string>")
    assert df.select(tx.drop_stop_words(F.col("w"), ("the",))).first()[0] == ["red", "red"]


def test_limits_and_samples(docs):
    assert selection.limit_documents(docs, 0).count() == 5
    assert [r[0] for r in selection.limit_documents(docs, 2).collect()] == [1, 2]
    first = rows(selection.seeded_sample(docs, 3))
    assert first == rows(selection.seeded_sample(docs.repartition(3), 3)) and len(first) == 3
    assert selection.sample_per_topic(docs, 1).count() == 3


def test_plane_points_checks(spark):
    with pytest.raises(ValueError):
        selection.plane_points(spark.createDataFrame([([1.0],)], "v array<double>"), "v")
    with pytest.raises(ValueError):
        selection.plane_points(spark.createDataFrame([([1.0, 2.0],), ([1.0, 2.0, 3.0],)], "v array<double>"), "v")


def test_one_time_bin(spark):
    df = spark.createDataFrame([("2024-01-01", 0), ("2024-01-01", 1)], "ts string, topic int")
    got = reports.topics_over_time(df, "ts").collect()
    assert sorted((r["bin"], r["topic"], r["n"], r["share"]) for r in got) == [(0, 0, 1, 0.5), (0, 1, 1, 0.5)]


def test_ranking_trims_before_the_shuffle(spark, docs):
    for df in (weighting.top_words(weighting.weigh_terms(docs)), selection.sample_per_topic(docs, 3)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "WindowGroupLimit" in plan
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_hash_vectors_hold_a_slice_of_words_at_a_time(spark, monkeypatch):
    from themeloom.operators import embedding

    texts = ["one two three four five six seven", "", "seven two", None, "three " * 40, "nine"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    whole = embedding.hash_vectors(df).orderBy("doc_id").collect()
    monkeypatch.setattr(embedding, "SLICE", 3)
    assert embedding.hash_vectors(df).orderBy("doc_id").collect() == whole


def test_ngrams_are_counted_in_chunks_before_the_shuffle(spark, monkeypatch):
    rows = [(1, 0, "alpha beta gamma alpha beta"), (2, 0, "alpha beta"), (3, 5, "alpha"), (4, 5, ""), (5, 7, None), (6, -1, "beta beta"), (7, None, "gamma"), (8, 0, "beta gamma alpha beta")]
    docs = spark.createDataFrame(rows, "doc_id long, topic int, text string").coalesce(1)
    for low, high in ((1, 2), (2, 2), (1, 3), (2, 3)):
        want = weighting.explode_terms(docs.filter("topic >= 0"), "text", ("topic",), (), (low, high), outer=True)
        want = want.groupBy("topic", "term").agg(F.count("term").alias("n")).collect()
        # also where a document is a chunk of its own
        for chunk in (1 << 20, 1):
            monkeypatch.setattr(weighting, "CHUNK_WORDS", chunk)
            got = weighting.count_terms(docs, stop=(), ngram_range=(low, high))
            assert Counter(map(tuple, got.collect())) == Counter(map(tuple, want))
    words = pa.array([["a", "b"], ["a", "b", "a", "b"], None, ["b"]], pa.list_(pa.string()))
    table = weighting.ngram_table(pa.array(["x", "x", "y", "y"]).dictionary_encode(), words, 1, 2)
    assert sorted(map(tuple, (r.values() for r in table.to_pylist())), key=str) == sorted(
        [("x", "a", 3), ("x", "b", 3), ("x", "a b", 3), ("x", "b a", 1), ("y", None, 0), ("y", "b", 1)], key=str
    )
    # frequent n-grams reach the shuffle once a chunk, and no partial sums of single occurrences stand before it
    plan = weighting.count_terms(docs, ngram_range=(1, 2))._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.index("Exchange") :]
    assert "HashAggregate" not in below and "Generate" not in below


def test_words_are_hashed_together():
    """Many words at once have the vectors that their grams give one by one."""
    import numpy as np

    from themeloom.operators import embedding

    words = ["apple", "été", "a", "", "日本語x", "𝔸b_1", "apple"]
    want = np.zeros((len(words), 16))
    for row, word in zip(want, words):
        framed = f"<{word}>"
        for i in range(len(framed) - 2):
            place, sign = embedding._placed(framed[i : i + 3], 16)
            row[place] += sign
    assert (embedding._WordVectors(16).of(words) == want).all()
    assert embedding._WordVectors(16).of([]).shape == (0, 16)
