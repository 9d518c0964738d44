import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from themeloom import ThemeModel, run
from themeloom.operators import embedding, keywords, naming, reports
from themeloom.sources import documents, sinks

FIVE = [(1, 'a "quoted"\nline'), (2, "tab\there"), (3, "été"), (4, "comma, here"), (5, "plain")]
SCHEMA = "doc_id bigint, text string"


@pytest.fixture(scope="module")
def five(spark):
    return spark.createDataFrame(FIVE, SCHEMA)


def back(df):
    return sorted((r["doc_id"], r["text"]) for r in df.collect())


def test_every_format_reads_the_same(spark, five, tmp_path):
    base = str(tmp_path)
    for kind, sep in (("csv", ","), ("tsv", "\t")):
        five.write.option("header", True).option("quoteAll", True).option("escape", '"').option("sep", sep).csv(f"{base}/x.{kind}")
    sinks.write_json_array(five.repartition(2), f"{base}/x.json")
    five.write.json(f"{base}/y.json")
    five.write.json(f"{base}/x.jsonl")
    five.write.parquet(f"{base}/x.PARQUET")
    sinks.write_feather(five, f"{base}/x.feather")
    for name in ("x.csv", "x.tsv", "x.json", "y.json", "x.jsonl", "x.PARQUET", "x.feather"):
        assert back(documents.load_documents(spark, f"{base}/{name}")) == FIVE, name
    with open(f"{base}/one.json", "w") as f:
        json.dump([{"doc_id": i, "text": t} for i, t in FIVE], f, indent=1)
    assert back(documents.load_documents(spark, f"{base}/one.json")) == FIVE


def test_bad_paths_and_types(spark, five, tmp_path):
    with pytest.raises(FileNotFoundError):
        documents.load_documents(spark, str(tmp_path / "none.csv"))
    with pytest.raises(FileNotFoundError):
        documents.load_vectors(spark, str(tmp_path / "none"))
    (tmp_path / "x.xyz").write_text("a")
    with pytest.raises(ValueError):
        documents.load_documents(spark, str(tmp_path / "x.xyz"))


def test_reply_parsing(spark):
    replies = [
        ('{"topic_name": " A b ", "reasoning": "why"}', ("A b", "why")),
        ('{"topic_name": "A", "reasoning": "why"', ("A", "why")),
        ('text "topic_name" : "B" end', ("B", "")),
        ("nothing", ("", "")),
        ("", ("", "")),
        ('{"reasoning": "r"}', ("", "r")),
    ]
    df = spark.createDataFrame([(i, r) for i, (r, _) in enumerate(replies)], "i int, reply string")
    got = df.select("i", naming.parse_reply(F.col("reply")).alias("p")).orderBy("i").select("p.*").collect()
    assert [tuple(r) for r in got] == [w for _, w in replies]


def test_names_when_the_model_fails(spark):
    topics = spark.createDataFrame([(0, ["a", "b", "c", "d"]), (1, ["x"])], "topic int, words array<string>")
    prompts = naming.keyword_prompts(topics)

    def broken():
        raise RuntimeError("no weights")

    got = {r["topic"]: r["name"] for r in naming.names_from_keywords(prompts, naming.generate(prompts, broken)).collect()}
    assert got == {0: "a_b_c", 1: "x"}
    got = {r["topic"]: r["name"] for r in naming.names_from_keywords(prompts).collect()}
    assert got == {0: "a & b & c", 1: "x"}


def test_names_from_documents(spark):
    docs = spark.createDataFrame(
        [(1, "Fast cars cars", 0, [1.0, 0.0]), (2, "slow cars", 0, [0.9, 0.1]), (3, "a b", 1, [0.0, 1.0])],
        "doc_id long, text string, topic int, embedding array<double>",
    )
    chosen = naming.representative_documents(docs, count=2)
    prompts = naming.document_prompts(chosen)

    def model():
        return lambda prompts, **_: [p + '{"topic_name": "Cars"}' if "cars" in p else p for p in prompts]

    got = {r["topic"]: (r["name"], r["reasoning"]) for r in naming.names_from_documents(prompts, chosen, naming.generate(prompts, model)).collect()}
    assert got == {0: ("Cars", "Based on 2 representative documents"), 1: ("Topic", "Based on 1 representative documents")}
    spare = {r["topic"]: r["name"] for r in naming.fallback_names(docs).collect()}
    assert spare == {0: "cars & fast & slow", 1: "Topic"}


def test_diverse_words_by_hand(spark):
    rel = spark.createDataFrame(
        [(0, 1, "a", [1.0, 0.0], 0.9), (0, 2, "b", [1.0, 0.05], 0.89), (0, 3, "c", [0.0, 1.0], 0.5)],
        "topic int, rank int, word string, vector array<double>, relevance double",
    )
    words = lambda d: [r["word"] for r in keywords.refine_by_diversity(rel, 3, d).orderBy("rank").collect()]
    assert words(0.0) == ["a", "b", "c"] == [r["word"] for r in keywords.refine_by_similarity(rel, 3).orderBy("rank").collect()]
    assert words(0.5) == ["a", "c", "b"] and words(1.0) == ["a", "c", "b"]


def test_encoders(spark):
    df = spark.createDataFrame([(1, "some words"), (2, "")], SCHEMA)
    got = {r["doc_id"]: np.array(r["embedding"]) for r in embedding.embed(df, width=16).collect()}
    assert np.linalg.norm(got[1]) == pytest.approx(1) and not got[2].any() and len(got[2]) == 16
    with pytest.raises(ValueError):
        embedding.embed(df, None)
    with pytest.raises(ValueError):
        embedding.embed(df, "other")
    cut = {r["doc_id"]: r["embedding"] for r in embedding.embed(df, width=16, max_words=1).collect()}
    whole = {r["doc_id"]: r["embedding"] for r in embedding.embed(df.filter("doc_id = 1").withColumn("text", F.lit("some")), width=16).collect()}
    assert cut[1] == whole[1]


def test_model_end_to_end(spark, tmp_path):
    lines = ["cats purr and sleep", "cats chase mice", "sleepy cats purr", "stocks rise in trade", "bond trade and stocks", "traders sell stocks"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(lines * 4)], SCHEMA)
    docs.write.parquet(f"{tmp_path}/docs.parquet")
    model = run(
        spark, f"{tmp_path}/docs.parquet", output=f"{tmp_path}/out",
        reduction={"method": "pca", "components": 2}, clustering={"method": "kmeans", "n_clusters": 2, "restarts": 2},
        weighting={"ngram_range": (1, 2), "use_bm25": True, "top_n_words": 5},
    )
    info = model.topic_info().collect()
    assert sum(r["Count"] for r in info) == 24 and all(len(r["Top_words"]) <= 5 for r in info)
    assert model.document_info().count() == 24
    assert {r["method"] for r in model.topic_lines().collect()} == {"PCA + KMEANS"}
    times = docs.select("doc_id", F.timestamp_seconds(F.col("doc_id") * 60).alias("ts"))
    assert model.topics_over_time(times, nr_bins=3).agg(F.sum("n")).first()[0] == 24
    for name in ("topic_info", "document_info", "embeddings.parquet", "reduced.parquet", "parameters"):
        assert os.path.isdir(f"{tmp_path}/out/{name}")
    assert spark.read.json(f"{tmp_path}/out/parameters").first()["seed"] == 42
    assert set(model.charts()) == {"points_2d", "topic_distribution", "topic_words_grid"}
    with pytest.raises(ValueError):
        ThemeModel().topics()
    with pytest.raises(ValueError):
        run(spark, f"{tmp_path}/docs.parquet", clustering={"method": "kmeans"}, reduction={"method": "pca", "components": 2})


def test_escaped_quotes_in_broken_replies(spark):
    replies = [('text before {"topic_name": "The \\"big\\" one", "reasoning": "as said"} after',), ('{"topic_name": "cut off',)]
    got = spark.createDataFrame(replies, "reply string").select(naming.parse_reply(F.col("reply")).alias("p")).select("p.*").collect()
    assert [r.name for r in got] == ['The "big" one', "cut off"]


def test_csv_in_several_tasks(spark, tmp_path):
    path = f"{tmp_path}/many.csv"
    with open(path, "w") as out:
        out.write("doc_id,text\n" + "".join(f"{i},some words here\n" for i in range(60_000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200k")
    try:
        split = documents.read_csv(spark, path, "doc_id long, text string", multi_line=False)
        assert split.rdd.getNumPartitions() > 3 and split.count() == 60_000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_topics_without_words_keep_their_count(spark):
    labels = spark.createDataFrame([(1, 0), (2, 0), (3, 1), (4, -1)], "doc_id long, topic int")
    ranked = spark.createDataFrame([(0, 1, "cats", 0.5)], "topic int, rank int, word string, score double")
    info = {r["Topic"]: r for r in reports.topic_info(labels, ranked).collect()}
    assert {t: r["Count"] for t, r in info.items()} == {0: 2, 1: 1, -1: 1}
    assert info[1]["Name"] == "" and info[1]["Top_words"] == []
