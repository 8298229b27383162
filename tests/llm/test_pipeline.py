"""The pipeline, stage by stage, against brute force."""

import random
from collections import Counter

import numpy as np
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from lumenfold.llm import byte_bpe, secret_scan
from lumenfold.llm.queries import PATTERN, VOCABULARY
from tests.llm.test_operators import WORDS, exact_components, fair_targets

FOLDER = "/root/testdata/sf0.001"
_draw = random.Random(5)
NOISE = " ".join("".join(_draw.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(_draw.randrange(3, 9))) for _ in range(60))


def test_stages(spark):
    given = spark.read.parquet(f"{FOLDER}/documents.parquet")
    odd = spark.createDataFrame([(9001, None, None, None, 0), (9002, "12 !", "en", "a", 4), (9003, "Zorro Über password=hunter2222 ok then this is it", None, "é", 9), (9003, "Zorro Über password=hunter2222 ok then this is it", None, "é", 9), (9004, NOISE, "en", "a", 9)], given.schema)
    docs = given.unionByName(odd).withColumn("size", F.lit("clash")).withColumn("row", F.lit(1))
    tables = {"": [r.asDict() for r in docs.collect()]}
    for name, stage in corpus_pipeline.STAGES:
        docs = spark.createDataFrame(stage(spark, docs, FOLDER).collect(), None if name == "byte_bpe" else docs.schema)
        tables[name] = [r.asDict() for r in docs.collect()]
    names = set(tables[""][0])
    assert all(set(t[0]) == names for n, t in tables.items() if n != "byte_bpe")
    found = tables["language_id"]
    assert {r["doc_id"] for r in tables[""]} - {r["doc_id"] for r in found} == {r["doc_id"] for r in tables[""] if not any(c.isalpha() for c in r["text"] or "") or r["doc_id"] == 9004}
    assert all(r["lang"] for r in found)
    groups = exact_components([(r["doc_id"], r["text"]) for r in found], 5)
    once = tables["near_dedup"]
    assert sorted(r["doc_id"] for r in once) == sorted({c for _, _, c in groups})
    clean = {r["doc_id"]: r["text"] for r in tables["secret_scan"]}
    assert set(clean) == {r["doc_id"] for r in once}
    assert "hunter2222" not in clean[9003] and "Zorro Über [secret] ok" in clean[9003]
    scanned = {r.doc_id: r.secret_spans for r in secret_scan.scan(spark.createDataFrame([(r["doc_id"], r["text"]) for r in once], "doc_id long, text string")).collect()}
    for r in once:
        if not scanned[r["doc_id"]]:
            assert clean[r["doc_id"]] == r["text"]
    size, taken = Counter(), Counter()
    for r in tables["secret_scan"]:
        size[r["source"]] += len(WORDS.findall(r["text"]))
    for r in tables["source_mix"]:
        taken[r["source"]] += len(WORDS.findall(r["text"]))
    want = fair_targets(size)
    assert abs(sum(taken.values()) - sum(want.values())) < 0.1 * sum(want.values())
    assert max(Counter(r["doc_id"] for r in tables["source_mix"]).values()) <= 2
    with open(VOCABULARY, "rb") as f:
        library = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=byte_bpe.ranks_of(f.read()), special_tokens={})
    texts = {r["doc_id"]: r["text"] for r in tables["source_mix"]}
    assert Counter(r["doc_id"] for r in tables["byte_bpe"]) == Counter(r["doc_id"] for r in tables["source_mix"])
    for r in tables["byte_bpe"]:
        assert r["round_trip"]
        assert np.frombuffer(r["token_ids"], "<u4").tolist() == library.encode_ordinary(texts[r["doc_id"]])


def test_short_and_foreign_texts_stay(spark):
    """Language ID drops what has no letter and long texts of random letters, not short texts or unknown scripts."""
    given = spark.read.parquet(f"{FOLDER}/documents.parquet").drop("source")
    more = [(9001, "Hi"), (9002, "OK"), (9003, "I am"), (9004, "Привет, мир! " * 20), (9005, "日本語のテキスト" * 20), (9006, "x"), (9101, NOISE), (9102, "12 !"), (9103, None), (9104, "")]
    docs = given.unionByName(spark.createDataFrame([(i, t, None, 0) for i, t in more], given.schema))
    kept = {r.doc_id for r in corpus_pipeline.identify(spark, docs, FOLDER).collect()}
    assert {i for i, _ in more if i in kept} == {9001, 9002, 9003, 9004, 9005, 9006}
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r.doc_id for r in corpus_pipeline.identify(spark, unlabelled, FOLDER).collect()} == {r.doc_id for r in docs.collect() if any(c.isalpha() for c in r.text or "")}


def test_dedup_of_one_id_with_several_texts(spark):
    """Each text of an id is judged on its own, and which of equal rows stays does not depend on their order."""
    t = " ".join(f"first{i}" for i in range(60))
    u = " ".join(f"second{i}" for i in range(60))
    kind = "doc_id long, text string, lang string, source string, _text_hash string, _key string"
    rows = [(3, t, "en", "a", "h", "k"), (5, u, "en", "a", "h", "k"), (5, f"{t} more", "en", "a", "h", "k"), (7, u, "en", "b", "h", "k"), (8, None, None, None, None, None), (9, "", "en", "a", "h", "k"), (None, t, "en", "a", "h", "k"), (None, t, "en", "a", "h", "k"), (-4, f"{u} {u}x tail", "en", "a", "h", "k")]
    rows += [(11, "one two three four five six", "en", s, "h", k) for s in "abc" for k in "xyz"] + [(12, "repeated row of this id once", "en", "a", "h", "k")] * 3
    found = []
    for order in (rows, rows[::-1]):
        stage = corpus_pipeline.deduplicate(spark, spark.createDataFrame(order, kind).repartition(3), FOLDER)
        assert stage.columns == ["doc_id", "text", "lang", "source", "_text_hash", "_key"]
        found.append(sorted(map(tuple, stage.collect()), key=repr))
    assert found[0] == found[1]
    assert sorted((r[0], r[1]) for r in found[0] if r[0] is not None and r[0] < 10 and r[1]) == [(-4, f"{u} {u}x tail"), (3, t)]  # -4 repeats the words of 5 and 7
    assert [r[0] for r in found[0] if r[0] in (11, 12)] == [11, 12] and sum(r[0] is None for r in found[0]) == 2 and {8, 9} <= {r[0] for r in found[0]}


def test_empty_table_through_all_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = spark.createDataFrame([], stage(spark, docs, FOLDER).schema)
    assert docs.count() == 0
