"""The pipeline's stages follow each other, and its rows are those of its parts."""

import hashlib
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from fourfold.llm import encoding, linededup, mixing, neardup, pieces, queries

from .test_operators import brute_components, brute_lines, plain_viterbi, words_of

D = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet").unionByName(spark.createDataFrame([(900001, None, None, None, None), (900002, "123 456", "en", "x", 7)], "doc_id long, text string, lang string, source string, n_chars long"))
    docs.cache()
    first = corpus_pipeline.identify_language(spark, docs, D)
    gone = {r[0] for r in docs.join(first, "doc_id", "left_anti").select("doc_id").collect()}
    assert gone == {900001, 900002}
    second = corpus_pipeline.dedup_lines(spark, first, D)
    want = {r["doc_id"]: r["text"] for r in linededup.dedup_lines(first).filter("n_lines = 0 or n_kept > 0").collect()}
    assert {r["doc_id"]: r["text"] for r in second.collect()} == want
    second = second.cache()
    third = corpus_pipeline.drop_near_duplicates(spark, second, D)
    kept = {r["doc_id"] for r in neardup.near_duplicates(second).filter("kept").collect()}
    assert {r["doc_id"] for r in third.collect()} == kept
    third = third.cache()
    fourth = corpus_pipeline.mix_sources(spark, third, D)
    copies = {r["doc_id"]: r["copies"] for r in mixing.with_copies(third).select("doc_id", "copies").collect() if r["copies"]}
    assert {r["doc_id"]: r["count"] for r in fourth.groupBy("doc_id").count().collect()} == copies
    for stage in (first, second, third, fourth):
        assert stage.columns == list(corpus_pipeline.COLUMNS)
    fifth = corpus_pipeline.encode_text(spark, fourth, D)
    assert fifth.filter("not round_trip").count() == 0 and fifth.count() == fourth.count()
    back = encoding.decode(fifth).select("doc_id", "decoded").distinct()
    assert back.join(fourth.select("doc_id", "text").distinct(), "doc_id").filter(F.col("decoded") != F.col("text")).count() == 0


def odd_documents(spark):
    """Null ids, texts and sources, repeated rows, blank and very long texts, and columns whose names clash with those made inside."""
    line = "The licence text that every file of this project repeats at its end"
    rows = [
        (1, f"Ein Satz über das Wetter in der Stadt und auf dem Land\n{line}", "de", "a", 1), (1, f"Ein Satz über das Wetter in der Stadt und auf dem Land\n{line}", "de", "a", 1),
        (None, "the quick brown fox jumps over the lazy dog near the river bank", "en", "b", 1), (None, "the quick brown fox jumps over the lazy dog near the river bank today", "en", None, 1),
        (2, f"{line}\nthe cat and the dog were seen in the garden of the old house", "en", None, 1), (3, None, None, None, None), (4, " \n ", "en", "a", 3), (5, "12 34", "en", "a", 5),
        (6, " ".join(f"word{i % 5000}x{i % 77}" for i in range(80_000)), "en", "b", 1), (1, "une phrase tout autre sur les arbres et les fleurs du jardin", "fr", "c", 1), (7, "漢" * 5_000, "zh", "c", 5_000),
    ]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return frame.withColumns({c: F.lit(1) for c in ("row", "doc", "key", "kept", "lines", "copies", "ids", "lang_pred", "n_kept")})


def test_stages_on_odd_documents(spark):
    docs = odd_documents(spark)
    first = corpus_pipeline.identify_language(spark, docs, D).cache()
    assert sorted((r["doc_id"] or 0) for r in first.collect()) == [0, 0, 1, 1, 1, 2, 6, 7]
    second = corpus_pipeline.dedup_lines(spark, docs, D).cache()
    texts = [(r["doc_id"], r["text"]) for r in second.collect()]
    assert sum(i == 1 for i, _ in texts) == 2 and sum(i is None for i, _ in texts) == 1  # repeated rows lose all their lines
    assert (2, "the cat and the dog were seen in the garden of the old house") in texts and (3, None) in texts
    third = corpus_pipeline.drop_near_duplicates(spark, docs, D).cache()
    assert sorted((r["doc_id"] or 0) for r in third.collect()) == [0, 1, 1, 2, 3, 4, 5, 6, 7]
    fourth = corpus_pipeline.mix_sources(spark, docs, D)
    assert fourth.columns == list(corpus_pipeline.COLUMNS)
    fifth = corpus_pipeline.encode_text(spark, docs, D)
    assert fifth.count() == docs.count() and fifth.filter("not round_trip").count() == 0


def test_stages_on_no_documents(spark):
    none = odd_documents(spark).filter("false")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, D).count() == 0, name


def test_nothing_to_learn_from_keeps_texts(spark):
    docs = odd_documents(spark).withColumn("lang", F.lit(None).cast("string"))
    assert corpus_pipeline.identify_language(spark, docs, D).count() == 8


def test_run_against_brute_force(spark):
    """All rows of a whole run; from the first stage's rows on every stage is repeated by comparing, counting and searching plainly."""
    docs = spark.read.parquet(f"{D}/documents.parquet")
    langs = corpus_pipeline.identify_language(spark, docs, D).collect()
    assert {r["doc_id"] for r in docs.collect() if any(c.isalpha() for c in r["text"] or "")} == {r["doc_id"] for r in langs}
    about = {r["doc_id"]: r for r in langs}
    texts = dict(brute_lines([(r["doc_id"], r["text"]) for r in sorted(langs, key=lambda r: r["doc_id"])]))
    texts = {i: t for i, t in texts.items() if words_of(t) or not words_of(about[i]["text"])}
    texts = {i: texts[i] for i, (_, of) in brute_components(list(texts.items())).items() if of == i}
    sizes = Counter()
    for i, t in texts.items():
        sizes[about[i]["source"]] += len(words_of(t))
    order = sorted(sizes, key=lambda s: s.encode())
    weight = {s: 1 + k % 3 for k, s in enumerate(order)}
    target, free, left = {}, set(order), float(sum(sizes.values()))
    while free:
        level = left / sum(weight[s] for s in free)
        full = {s for s in free if level * weight[s] > 3 * sizes[s]} or free
        target |= {s: min(3.0 * sizes[s], level * weight[s]) for s in full}
        left -= sum(target[s] for s in full)
        free -= full
    want = Counter()
    model = pieces.load()
    table = {p: k for k, (p, u) in enumerate(zip(model.pieces, model.usable, strict=True)) if u}
    memo = {}
    for i, t in texts.items():
        rate = target[about[i]["source"]] / sizes[about[i]["source"]]
        u = int(hashlib.md5(f"{mixing.SEED}|{i}".encode()).hexdigest()[:8], 16) / 2**32
        copies = int(rate) + (u < rate - int(rate))
        if copies:
            for w in pieces.word_forms(t):
                if w not in memo:
                    memo[w] = plain_viterbi(model, table, w)
            want[i, about[i]["source"], about[i]["lang"], tuple(x for w in pieces.word_forms(t) for x in memo[w])] += copies
    out = corpus_pipeline.run(spark, D).collect()
    assert Counter((r["doc_id"], r["source"], r["lang"], tuple(r["ids"])) for r in out) == want
    assert all(r["round_trip"] and r["n_pieces"] == len(r["ids"]) for r in out)


def test_stage_list():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_duplicates", "mixing", "sentencepiece"]


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{D}/documents.parquet'")
    got = queries.queries()[name](spark, D).toPandas()
    want = con.execute(queries.oracle_sql()[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    key = lambda f: f[columns].sort_values(columns).reset_index(drop=True)
    assert (key(got) == key(want)).all().all()
