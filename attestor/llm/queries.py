"""The named queries of these operators and the SQL they are checked with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestor.llm import decontaminate, exact_dedup, hard_negatives, langid, line_dedup, maxscore, packing, pseudo_likelihood, quality, simhash, token_shards, toxicity, whitening
from attestor.llm.common import shared_folder, stored, table

TRAINING_KEY = 20240607


def op1_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sequence of the training order: slot, shard, tokens and documents."""
    docs = table(spark, sf_dir, "documents")
    ranks = token_shards.ranks(spark, f"file://{token_shards.VOCABULARY}")
    return token_shards.materialised(docs, shared_folder(spark, "training"), ranks, key=TRAINING_KEY)


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows in every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.matches(docs, table(spark, sf_dir, "benchmark"))
    return found.select("row.doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), decontaminate.items_digest().alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Perplexity of every document and whether it is kept."""
    return quality.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bin and place of every piece of every document."""
    docs = stored(packing.near_clusters(table(spark, sf_dir, "documents")), "clusters")
    return packing.packed_documents(docs, tokens=F.col("tokens"), cluster=F.col("cluster"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines before and after dropping those that many documents share."""
    found = line_dedup.deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("row.doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op7_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pseudo-log-likelihood of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    words = pseudo_likelihood.vocabulary(docs)
    found = pseudo_likelihood.scored(docs, words, pseudo_likelihood.trained(docs, words))
    mean = F.when(F.col("n_words") > 0, F.col("log_prob") / F.col("n_words"))
    return found.select("row.doc_id", "n_words", "log_prob", mean.alias("mean_log_prob"))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document."""
    docs = table(spark, sf_dir, "documents")
    found = langid.identified(docs.select("doc_id", "text"), langid.trained(docs))
    return found.select("row.doc_id", langid.held_out("row.doc_id").alias("held_out"), "lang_pred", "score", "cross_entropy", "rejected")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = toxicity.scored(docs, toxicity.trained(docs, table(spark, sf_dir, "labels")))
    return found.select("row.doc_id", toxicity.held_out("row.doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op10_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best vectors for every query vector."""
    return maxscore.top_k(table(spark, sf_dir, "embeddings"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Negatives in the windows of every anchor's positives."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mined(table(spark, sf_dir, "embeddings"), label=label)


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group of equal texts of every document, and the row that stays."""
    found = exact_dedup.decided(table(spark, sf_dir, "documents").select("doc_id", "text"), digests=True)
    return found.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", "text_sha256")


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whitened components of every vector."""
    found = whitening.whitened(table(spark, sf_dir, "embeddings"))
    return found.withColumnRenamed("id", "vec_id")


NUMBERED = (op1_token_shards, op2_decontaminate, op3_quality, op4_simhash, op5_packing, op6_line_dedup, op7_pseudo_likelihood, op8_language, op9_toxicity, op10_maxscore, op11_hard_negatives, op12_exact_dedup, op13_whitening)
QUERIES = {f.__name__: f for f in NUMBERED}

_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES = {
    "op2_decontaminate": f"""
with dw as (select doc_id, regexp_extract_all({_LOWERED}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') w from documents),
bw as (select item_id, regexp_extract_all({_LOWERED}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') w from benchmark),
win as (select distinct item_id, least(10, len(w)) k, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') s
        from (select *, unnest(range(1, greatest(len(w) - 9, 1) + 1)) i from bw where len(w) > 0)),
widths as (select distinct k from win),
occ as (select doc_id, i, k, array_to_string(w[i:i + k - 1], ' ') s
        from (select doc_id, w, k, unnest(range(1, len(w) - k + 2)) i from dw, widths where len(w) >= k)),
hits as (select doc_id, i, k, item_id from occ join win using (k, s)),
words as (select doc_id, count(distinct p) n_hit from (select doc_id, unnest(range(i, i + k)) p from (select distinct doc_id, i, k from hits)) group by 1),
items as (select doc_id, count(distinct item_id) n_items, sha256(string_agg(distinct item_id::varchar, ',' order by item_id::varchar)) items_sha256 from hits group by 1)
select doc_id, len(w) n_words, coalesce(n_hit, 0) n_hit, coalesce(n_items, 0) n_items, coalesce(items_sha256, sha256('')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
from dw left join words using (doc_id) left join items using (doc_id)""",
    "op6_line_dedup": """
with l as (select doc_id, i, x, translate(trim(x, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') k
           from (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) x, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) i from documents)),
f as (select k, max(doc_id) last from l where length(k) >= 40 group by k having count(distinct doc_id) >= 5)
select doc_id, count(*) n_lines, count(*) filter (doc_id < last) n_dropped,
       sha256(coalesce(string_agg(x, chr(10) order by i) filter (last is null or doc_id = last), '')) kept_sha256
from l left join f using (k) group by doc_id""",
    "op10_maxscore": """
with v as (select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) q from embeddings
           where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select a.vec_id query_id, b.vec_id, list_sum(list_transform(list_zip(a.q, b.q), lambda p: coalesce(p[1], 0) * coalesce(p[2], 0)))::bigint score
      from v a join v b on a.vec_id <> b.vec_id where a.vec_id % 50 = 0)
select query_id, row_number() over (partition by query_id order by score desc, vec_id)::integer "rank", vec_id, score from s
qualify "rank" <= 5""",
    "op11_hard_negatives": """
with v as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end l, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) q from embeddings
           where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select a.vec_id anchor_id, b.vec_id, a.l = b.l same, list_sum(list_transform(list_zip(a.q, b.q), lambda p: coalesce(p[1], 0) * coalesce(p[2], 0)))::bigint score
      from v a join v b on a.vec_id <> b.vec_id where a.vec_id % 50 = 0),
p as (select anchor_id, vec_id positive_id, score positive_score from s where same qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5)
select anchor_id, positive_id, row_number() over (partition by anchor_id, positive_id order by score desc, vec_id)::integer "rank", vec_id negative_id, positive_score, score negative_score
from p join s using (anchor_id) where not same and 50 * positive_score <= 100 * score and 100 * score <= 95 * positive_score
qualify "rank" <= 3""",
    "op12_exact_dedup": f"""
with t as (select doc_id, {_LOWERED} t from documents)
select doc_id, max(doc_id) over (partition by t) keep_id, count(*) over (partition by t) group_size,
       row_number() over (partition by t order by doc_id desc nulls last) = 1 kept, sha256(t) text_sha256
from t""",
}
