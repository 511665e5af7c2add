"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, for every operator and stage."""

import hashlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from attestor.llm import decontaminate, langid, line_dedup, maxscore, packing, pseudo_likelihood, quality, simhash, token_shards, toxicity
from attestor.llm.common import shared_folder

LONG = "one two three four five six seven eight nine ten eleven twelve " * 3000
SHAPE = "doc_id long, text string, lang string, source string, n_chars long, row string, fp long, n_words long, kept string, fingerprint string, items string, rejected boolean, score double"
ROWS = [
    (1, "a plain text of some words", "en", "s1"),
    (1, "a plain text of some words", "en", "s1"),
    (2, None, None, None),
    (3, "", "en", "s1"),
    (4, LONG, "en", "s2"),
    (None, "a text without an id", None, "s2"),
    (5, "ein kurzer text mit wörtern", "de", "s1"),
    (6, " \n\t ", "de", None),
]


@pytest.fixture(params=["odd", "empty"])
def docs(spark, request):
    rows = [(*r, None, "r", 7, 7, "k", "f", "i", True, 0.5) for r in ROWS]
    return spark.createDataFrame(rows if request.param == "odd" else [], SHAPE)


@pytest.fixture
def benchmark(spark):
    return spark.createDataFrame([(1, "six seven eight nine ten eleven twelve one two three four"), (2, None), (3, ""), (4, "plain text")], "item_id long, text string")


@pytest.fixture
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (1, 1, 1), (4, 1, 0), (5, 1, 0), (None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")


def rows_of(df):
    return [r.asDict() for r in df.collect()]


def test_decontaminate(docs, benchmark):
    found = rows_of(decontaminate.matches(docs, benchmark))
    by = {(r["row"]["doc_id"], r["row"]["text"] is None): r for r in found}
    assert len(found) == docs.count()
    if found:
        assert by[4, False]["items"] == ["1"] and by[4, False]["longest_match"] == 11 and by[4, False]["longest_at"] == 5
        assert by[1, False]["items"] == ["4"] and by[1, False]["n_hit"] == 2
        assert by[2, True]["n_words"] == 0 and by[2, True]["items"] == []
    assert decontaminate.decontaminated(docs, benchmark).columns == docs.columns


def test_many_blocks_give_the_same(docs, benchmark):
    one, many = (sorted(rows_of(decontaminate.matches(docs, benchmark, block_chars=n)), key=repr) for n in (10**6, 5))
    assert one == many


def test_simhash(docs):
    found = rows_of(simhash.near_duplicates(docs))
    assert len(found) == docs.count()
    if found:
        empty = [r for r in found if r["doc_id"] in (2, 3, 6)]
        assert {r["fingerprint"] for r in empty} == {"0" * 16} and {r["component_id"] for r in empty} == {2}
        assert {r["component_id"] for r in found if r["doc_id"] is None} == {None}
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] or 0) for r in rows_of(kept)) == ([0, 1, 2, 4, 5] if found else [])


def test_lines(docs):
    found = rows_of(line_dedup.deduplicated(docs))
    assert all(r["n_dropped"] == 0 and r["kept"] == (r["row"]["text"] or "") for r in found)
    assert {r["row"]["doc_id"]: r["n_lines"] for r in found}.get(2, 1) == 1
    assert line_dedup.cleaned(docs).columns == docs.columns


def test_language(docs):
    model = langid.trained(docs)
    found = rows_of(langid.identified(docs, model))
    assert len(found) == docs.count()
    assert all((r["lang_pred"], r["score"], r["rejected"]) == ("und", 0.0, True) for r in found if r["row"]["doc_id"] in (2, 3, 6))
    assert langid.accepted(docs, model).columns == docs.columns


def test_no_language_is_lost(spark):
    rng = np.random.default_rng(1)
    words = {"de": "der die das und nicht wörter über schule fährt heute".split(), "en": "the and not words about school drives today with from".split()}
    text = lambda k, n: " ".join(rng.choice(words[k], n))
    rows = [(i, text("de", 5000), "de") for i in range(40)] + [(100 + i, text("en", 30), "en") for i in range(40)]
    long = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.trained(long)
    assert model.langs == ["de", "en"]
    assert langid.accepted(long, model).count() == 80
    found = {r["row"]["doc_id"]: r["lang_pred"] for r in langid.identified(long, model).collect()}
    assert all(found[i] == k for i, _, k in rows)


def test_without_labels_nothing_is_rejected(docs):
    bare = docs.withColumn("lang", F.lit(None).cast("string"))
    model = langid.trained(bare)
    assert not model.langs and langid.accepted(bare, model).count() == bare.count()
    assert all((r["lang_pred"], r["rejected"]) == ("und", False) for r in langid.identified(bare, model).collect())


def test_item_without_an_id_counts_for_hits(spark):
    docs = spark.createDataFrame([(1, "x one two three y")], "doc_id long, text string")
    items = spark.createDataFrame([(None, "one two"), (7, "three")], "item_id long, text string")
    (found,) = rows_of(decontaminate.matches(docs, items))
    assert (found["n_hit"], found["items"], found["longest_match"]) == (3, ["7"], 2)


def test_long_white_space_round_trip(spark):
    ranks = token_shards.ranks(spark, f"file://{token_shards.VOCABULARY}")
    texts = ["a" + " " * 1_000_000 + "b", "\n\t" * 30_000, " " * 5000 + "x", "no runs at all"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    folder = shared_folder(spark, "blanks")
    token_shards.materialised(docs, folder, ranks, key=3, length=256, shard_rows=64).count()
    back = {v: k for k, v in ranks.items()}
    read = list(token_shards.read_from(folder))
    total = sum(len(back[int(t)]) for _, some in read for t in some if int(t) != token_shards.END_MARK)
    assert total == sum(len(t.encode()) for t in texts)
    code = token_shards.encoder("blanks", ranks)
    for text in texts:
        ids = [x for piece in token_shards.without_long_runs(text) for x in code.encode_ordinary(piece)]
        assert b"".join(back[i] for i in ids).decode() == text
    assert token_shards.without_long_runs("a b") == ["a b"]


def test_toxicity(docs, labels):
    found = rows_of(toxicity.scored(docs, toxicity.trained(docs, labels)))
    assert len(found) == docs.count() and all(0 <= r["score"] <= 1 for r in found)


def test_quality(docs, labels):
    found = rows_of(quality.judged(docs, labels))
    assert len(found) == docs.count()
    assert all(r["perplexity"] is None and r["keep"] for r in found if r["doc_id"] in (2, 3, 6))


def test_pseudo_likelihood(docs):
    words = pseudo_likelihood.vocabulary(docs)
    found = rows_of(pseudo_likelihood.scored(docs, words, pseudo_likelihood.trained(docs, words)))
    assert len(found) == docs.count()
    assert all((r["n_words"], r["log_prob"]) == (0, 0.0) for r in found if r["row"]["doc_id"] in (2, 3, 6))


def test_packing(docs):
    found = rows_of(packing.packed_documents(docs, capacity=64))
    assert len(found) == (0 if not docs.count() else 7 + -(-36000 // 64))
    assert all(r["bin_id"] is None for r in found if r["doc_id"] in (2, 3, 6))


def test_token_shards(spark, docs):
    ranks = {bytes([b]): b for b in range(256)}
    folder = shared_folder(spark, "edges")
    found = rows_of(token_shards.materialised(docs, folder, ranks, key=1, length=64, shard_rows=16, end_mark=300))
    read = list(token_shards.read_from(folder))
    assert len(found) == len(read) == len({r["slot"] for r in found})
    assert sum(len(t) for _, t in read) == sum(len((r["text"] or "").encode()) + 1 for r in rows_of(docs))


def test_top_k(spark):
    shape = "vec_id long, embedding array<float>, label int, score long, rank int, query_id long, v string"
    rows = [(0, [1.0, 0.5]), (50, [0.5, 0.5]), (1, None), (2, [1.0, None]), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]), (None, [1.0, 1.0]), (7, [1.0]), (5, [0.25, 0.25]), (5, [0.25, 0.25]), (6, []), (100, None)]
    found = maxscore.top_k(spark.createDataFrame([(*r, None, None, None, None, None) for r in rows], shape)).collect()
    got = {q: [(r["vec_id"], r["score"]) for r in sorted(found, key=lambda r: r["rank"]) if r["query_id"] == q] for q in (0, 50)}
    assert got[0] == [(7, 65536), (50, 49152), (5, 24576), (5, 24576), (6, 0)]
    assert got[50] == [(0, 49152), (7, 32768), (5, 16384), (5, 16384), (6, 0)] and len(found) == 10
    assert maxscore.top_k(spark.createDataFrame([], shape)).count() == 0


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stage(spark, docs, benchmark, tmp_path, name):
    benchmark.write.parquet(f"{tmp_path}/benchmark.parquet")
    out = dict(corpus_pipeline.STAGES)[name](spark, docs, str(tmp_path))
    out.collect()
    assert name == "sequences" or out.columns == docs.columns
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None


def test_digest_is_that_of_sorted_names(spark):
    row = spark.range(1).select(decontaminate.items_digest(F.array(F.lit("9"), F.lit("10"))).alias("d")).first()
    assert row["d"] == hashlib.sha256(b"10,9").hexdigest()


def test_longest_match_over_all_items():
    rng = np.random.default_rng(3)
    draw = lambda low, high: rng.choice(list("abc"), rng.integers(low, high)).tolist()
    items = [draw(0, 30) for _ in range(25)]
    texts = [draw(0, 80) + items[k % 25] + draw(0, 9) for k in range(40)]
    block = decontaminate.TestBlock([(str(k), " ".join(x)) for k, x in enumerate(items)], 10)
    held = type("Held", (), {"value": block})
    found = decontaminate.judged([held], pa.array([" ".join(x) for x in texts]))
    windows = {tuple(x[i : i + 10]) for x in items if x for i in range(max(1, len(x) - 9))}
    inside = {tuple(x[i:j]) for x in items for i in range(len(x)) for j in range(i + 1, len(x) + 1)}
    for words, longest, at in zip(texts, found[3].to_pylist(), found[4].to_pylist(), strict=True):
        best = (0, 1)
        for i in range(len(words)):
            if any(tuple(words[i : i + k]) in windows for k in range(1, 11)):
                best = max(best, (max(j - i for j in range(i + 1, len(words) + 1) if tuple(words[i:j]) in inside), -i), key=lambda b: b[0])
        assert (longest, at) == (best[0], -best[1])
