"""Runnable queries: sources, sinks and the batch forms of the streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from attestor.operators import maintain as M
from attestor.plans.registry import query
from attestor.sources import readers as RD
from attestor.sources import sinks as SK
from attestor.streaming import jobs as J


def s(col):
    return col.cast("string")


def corpus_lines(t):
    """One corpus item per order, as JSON text."""
    k = F.col("o_orderkey")
    disclosure = F.struct(
        F.concat(F.lit("https://t.example.org/"), s(k)).alias("sourceUrl"), F.lit("Council").alias("governmentInstitution"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("awardDate"), s(1 + k % 8).alias("beeLevel")
    )
    rows = F.when(k % 3 == 0, F.array().cast("array<struct<sourceUrl:string,governmentInstitution:string,awardDate:string,beeLevel:string>>")).when(k % 3 == 1, F.array(disclosure)).otherwise(F.array(disclosure, disclosure))
    item = F.struct(F.concat(F.lit("Firm "), s(k)).alias("canonicalName"), F.array(F.lit("Alias")).alias("aliases"), rows.alias("procurement"))
    return t.raw("orders").select(F.to_json(item).alias("value"))


@query(
    "read_corpus",
    """select 'Firm '||k as "canonicalName", p as "position", case when p is not null then 'https://t.example.org/'||k end as "sourceUrl", case when p is not null then 'Council' end as "governmentInstitution",
         case when p is not null then strftime(d,'%Y-%m-%d') end as "awardDate", case when p is not null then (1+k%8)::varchar end as "beeLevel" from (select *, unnest(case k%3 when 0 then [null] when 1 then [0] else [0,1] end) p from orders_d)""",
)
def read_corpus(t):
    return RD.corpus_disclosures(RD.parse_corpus(corpus_lines(t))).select("canonicalName", "position", "sourceUrl", "governmentInstitution", "awardDate", "beeLevel")


@query(
    "read_source_registry",
    """select 'fam'||page_id source_family_id, 'I' institution, 'awarded' evidence_mode, 'pdf' adapter, url source_url,
        'fam'||page_id||':'||regexp_replace(left(regexp_extract(regexp_replace(url,'/+$',''),'([^/]*)$',1),60),'[^\\p{L}\\p{N}._-]','-','g')||':'||left(sha256(url),16) document_key from pages where page_id%4<>0""",
)
def read_source_registry(t):
    p = t.raw("pages")
    family = F.struct(
        F.concat(F.lit("fam"), s(F.col("page_id"))).alias("source_family_id"),
        F.lit("I").alias("institution"),
        F.lit("awarded").alias("evidence_mode"),
        F.lit("pdf").alias("adapter"),
        F.when(F.col("page_id") % 4 == 0, False).when(F.col("page_id") % 4 == 1, True).alias("active"),
        F.array("url").alias("seed_urls"),
    )
    return RD.parse_registry(p.select(F.to_json(F.struct(F.array(family).alias("source_families"))).alias("value")))


@query(
    "read_documents",
    "select doc_id, octet_length(encode(text)) bytes, sha256(text) sha256, md5(text) text_md5 from documents",
)
def read_documents(t):
    docs = t.raw("documents").select("doc_id", F.encode("text", "UTF-8").alias("content"))
    return RD.with_content_hash(docs).select("doc_id", "bytes", "sha256", F.md5("text").alias("text_md5"))


WRITTEN = """
wi as (select 'Firm '||k "canonicalName", case k%3 when 0 then 0 when 1 then 1 else 2 end n from orders_d)"""


@query("write_corpus", f"with {WRITTEN} select * from wi")
def write_corpus(t):
    """Items written and read back, with the number of their disclosures."""
    items = RD.parse_corpus(corpus_lines(t))
    folder = SK.shared_folder(t.spark, "corpus")
    SK.write_corpus(items, items.select(F.array().cast("array<string>").alias("reasons")), folder)
    return RD.read_corpus(t.spark, f"{folder}/corpus").select("canonicalName", F.size("procurement").cast("long").alias("n"))


@query("read_existing_names", "select distinct lower(x) name_key from (select unnest(['firm '||id, replace(trim(regexp_replace(canonical_name,'\\s+',' ','g')),'&',' and ')]) x from entities)")
def read_existing_names(t):
    lines = t["entities"].select(F.concat_ws("\t", "slug", "canonical_name", "visibility").alias("value"))
    return RD.existing_names(lines)


@query(
    "append_evidence",
    """select content_hash, min(id) id from evidence_raw where content_hash not in (select content_hash from evidence_raw where id%5=0) group by 1""",
)
def append_evidence(t):
    rows = t["evidence_raw"].select("content_hash", "id")
    return SK.unseen_evidence(rows, rows.filter(F.col("id") % 5 == 0))


@query(
    "append_audit",
    """select sha256('entity.unmerged|'||id||'|'||'{"visibility":"draft","merged_into_id":null}') id, 'job' actor_id, 'entity.unmerged' "action", 'entity' target_type, id::varchar target_id,
        '{"visibility":"'||visibility||'","merged_into_id":'||merged_into_id||'}' before_state, '{"visibility":"draft","merged_into_id":null}' after_state, 'Reversed' reason from entities where merged_into_id is not null and id%2=0""",
)
def append_audit(t):
    before = t["entities"].select("id", "visibility", "merged_into_id")
    back = before.filter(F.col("merged_into_id").isNotNull() & (F.col("id") % 2 == 0)).select(F.col("id").alias("absorbed_id"))
    after = M.unmerge_entities(before, back)
    return SK.audit_rows(before, after, "id", action="entity.unmerged", target="entity", actor="job", reason="Reversed")


@query(
    "submission_rate_limit",
    """with recursive r as (select id, ip_hash, created_at, row_number() over (partition by ip_hash order by created_at, id) n from submissions),
      f as (select id, ip_hash, created_at, n, true accepted, [created_at] kept from r where n=1
        union all select id, ip_hash, created_at, n, len(near)<2, case when len(near)<2 then list_append(near, created_at) else near end
        from (select r.id, r.ip_hash, r.created_at, r.n, list_filter(f.kept, lambda x: x >= r.created_at - interval 1 hour) near from f join r on r.ip_hash=f.ip_hash and r.n=f.n+1))
      select id, ip_hash, accepted from f""",
)
def submission_rate_limit(t):
    """Threshold 2: an address has at most three events in an hour here."""
    return J.submission_rate_limit(t["submissions"], limit=2)


@query(
    "stream_source_changes",
    """select id, source_id, p is null as first, coalesce(p<>content_hash, true) changed from (select *, lag(content_hash) over (partition by source_id order by started_at, id) p from source_checks)""",
)
def stream_source_changes(t):
    return J.source_changes(t["source_checks"])


@query("stream_publication_counts", "select strftime(published_at,'%Y-%m-%d') as day, event_type, count(*) n from publication_events group by 1,2")
def stream_publication_counts(t):
    return J.publication_counts(t["publication_events"])


@query("stream_dedupe_evidence", "select sha256(text) content_hash, min(doc_id) doc_id from documents where sha256(text) not in (select sha256(text) from documents where doc_id%7=0) group by 1")
def stream_dedupe_evidence(t):
    docs = t.raw("documents").select("doc_id", F.sha2("text", 256).alias("content_hash"))
    return J.dedupe_evidence(docs, docs.filter(F.col("doc_id") % 7 == 0))
