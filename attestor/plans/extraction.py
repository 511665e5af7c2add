"""Runnable queries: claims from text, and supplier rows from registers."""

from __future__ import annotations

from pyspark.sql import functions as F

from attestor.operators import extract as X
from attestor.operators import ranking as R
from attestor.operators import registers as G
from attestor.operators import reports as RP
from attestor.plans import inputs as I
from attestor.plans.registry import query

# What each generated certificate says, worked out from the order alone.
CERT = """
cb as (select o_orderkey k, o_custkey c, o_orderkey%5 f, (o_orderkey//5)%3 e, (o_orderkey//15)%3 a, (o_orderdate::date + interval 264 month)::date d from orders),
cd as (select *, case f when 0 then strftime(d,'%Y-%m-%d') when 1 then strftime(d,'%-d %B %Y') when 2 then strftime(d,'%d/%m/%Y') when 3 then strftime(d,'%-d %B %Y') end draw,
   case when f=2 and day(d)<=12 then 'Interpreted "'||strftime(d,'%d/%m/%Y')||'" as DD/MM/YYYY (South African certificate convention).' end dwarn,
   case e when 0 then d+364 when 2 then d-30 end x, case e when 0 then strftime(d+364,'%Y-%m-%d') when 2 then strftime(d-30,'%-d %b %Y') end xraw from cb),
-- label hits: a trailing label prefers a date that follows it
hit as (select *, case when f=4 then null when f=3 and x is not null then x else d end ih, f=3 and x is not null ih_is_x from cd),
i0 as (select *, case when ih>=date '2020-01-01' then ih end ii from hit),
pr as (select *, f<>4 and e=0 and (ii is null or x is null or ii=x) pairs from i0),
i1 as (select *, case when ii is null and pairs then d else ii end i1, case when ii is null and pairs then false else ih_is_x end i1x from pr),
fin as (select *, i1 issue, case when i1 is not null and x is not null and i1>=x then null else x end expiry,
   case when i1 is not null and i1>x then 1 end reversed from i1),
certs as (select k, c, a, issue, case when i1x then xraw else draw end iraw, case when not i1x then dwarn end iwarn, expiry, xraw,
   case when issue is not null and expiry is null and e=1 then (issue + interval 12 month)::date - 1 end derived, e, f, ih, x, d from fin)"""

CERT_CLAIMS = (
    "select k doc_id, 'bee_level' field_key, 'B-BBEE status level: Level '||(1+k%8) raw_value, (1+k%8)::varchar normalized_value, 0.82 confidence, null::varchar warning from certs"
    " union all select k, 'recognition_level', 'Recognition level: '||(100+k%36)||'%', (100+k%36)||'%', 0.72, null from certs"
    " union all select k, 'scorecard_type', 'Scorecard type: '||['Generic','QSE','EME'][k%3+1], ['generic','qse','eme'][k%3+1], 0.72, null from certs"
    " union all select k, 'issue_date', iraw, strftime(issue,'%Y-%m-%d'), case when iwarn is null then 0.86 else 0.62 end, iwarn from certs where issue is not null"
    " union all select k, 'expiry_date', xraw, strftime(expiry,'%Y-%m-%d'), 0.86, null from certs where expiry is not null"
    " union all select k, 'expiry_date', 'Valid for 12 months from date of issue', strftime(derived,'%Y-%m-%d'), 0.7, 'Derived from stated 12-month validity and issue date; not printed as a calendar expiry.' from certs where derived is not null"
    " union all select k, 'registration_number', (1990+c%30)||'/'||lpad((c%1000000)::varchar,6,'0')||'/07', (1990+c%30)||lpad((c%1000000)::varchar,6,'0')||'07', 0.9, null from certs"
    " union all select k, 'verification_agency', 'AQRate (Pty) Ltd', 'aqrate', 0.88, 'Accreditation identifier BVA018 appeared on the document.' from certs where a=0"
    " union all select k, 'verification_agency', 'Plain Ratings CC', 'plain ratings cc', 0.7, null from certs where a=1"
    " union all select k, 'signatory', 'Nomsa van Wyk', 'nomsa van wyk', 0.6, null from certs"
    " union all select k, unnest(['measured_entity','legal_entity_name']), 'Kestrel '||c||' Builders (Pty) Ltd', 'kestrel '||c||' builders', 0.65, null from certs"
    " union all select k, 'certificate_number', 'ABC'||k, 'ABC'||k, 0.7, null from certs where k>=10"
    " union all select k, unnest(['certificate_type','document_type']), case when k%9=0 then 'Sworn affidavit' else 'B-BBEE certificate' end, case when k%9=0 then 'sworn_affidavit' else 'bee_certificate' end, 0.8, null from certs"
)


@query(
    "extract_claims",
    f"with {CERT} select doc_id, field_key, raw_value, normalized_value, confidence::double confidence, warning from ({CERT_CLAIMS})",
)
def extract_claims(t):
    """Claims of one generated certificate per order."""
    return X.extract_claims(I.certificate_texts(t)).drop("locator")


@query(
    "extract_claims_documents",
    "select doc_id, field_key, normalized_value from (select doc_id, 'bee_level' field_key, '1' normalized_value from documents where false)",
)
def extract_claims_documents(t):
    """Claims of the plain prose documents: they state none."""
    return X.extract_claims(t.raw("documents")).select("doc_id", "field_key", "normalized_value")


@query(
    "labelled_dates",
    f"""with {CERT} select k doc_id, strftime(ih,'%Y-%m-%d') issue_hit, strftime(x,'%Y-%m-%d') expiry_hit from certs""",
)
def labelled_dates(t):
    rows = X.labelled_dates(I.certificate_texts(t))
    return rows.select("doc_id", F.col("issue_hit.date.iso").alias("issue_hit"), F.col("expiry_hit.date.iso").alias("expiry_hit"))


@query(
    "pair_issue_expiry",
    f"""with {CERT} select k doc_id, strftime(d,'%Y-%m-%d') issue, strftime(d+364,'%Y-%m-%d') expiry from certs where f<>4 and e=0""",
)
def pair_issue_expiry(t):
    return X.paired_documents(I.certificate_texts(t))


@query(
    "reconcile_dates",
    f"""with {CERT} select k doc_id, strftime(issue,'%Y-%m-%d') issue, strftime(expiry,'%Y-%m-%d') expiry,
        case when issue>x then 'Labelled issue date is after the labelled expiry. The expiry was left unused instead of reversing the two dates.' end date_note from certs""",
)
def reconcile_dates(t):
    return X.reconciled_dates(I.certificate_texts(t)).select(
        "doc_id", F.col("issue.iso").alias("issue"), F.col("expiry.iso").alias("expiry"), "date_note"
    )


@query(
    "score_registrations",
    """select o_orderkey doc_id, (1990+o_custkey%30)||'/'||lpad((o_custkey%1000000)::varchar,6,'0')||'/07' best, case when o_orderkey%6=0 then 2 else 1 end numbers from orders""",
)
def score_registrations(t):
    scored = X.scored_registrations(F.col("text"))
    return I.certificate_texts(t).select("doc_id", scored.alias("s")).select(
        "doc_id", F.array_max("s")["raw"].alias("best"), F.size("s").alias("numbers")
    )


@query(
    "registration_in_text",
    "select o_orderkey doc_id, true own, o_orderkey%6=0 subsidiary, false verifier from orders",
)
def registration_in_text(t):
    text = F.col("text")
    return I.certificate_texts(t).select(
        "doc_id",
        X.registration_in_text(text, F.col("registration")).alias("own"),
        X.registration_in_text(text, F.lit("200100000107")).alias("subsidiary"),
        X.registration_in_text(text, F.lit("2002/001364/07")).alias("verifier"),
    )


# --- registers ---------------------------------------------------------------
REG = "rb as (select o_orderkey k, o_custkey c, (o_orderdate::date + interval 300 month)::date d from orders)"


@query(
    "opening_register_rows",
    f"""with {REG}, rr as (select k, 1 n, 'Kestrel '||c||' Builders (Pty) Ltd' s, 'Level '||(1+k%9) l from rb union all select k, 2, 'Heron Printers CC', (1+k%8)::varchar from rb where k%3<>0 union all select k, 3, 'Missing Papers Bidder', 'Not attached' from rb)
        select rr.k document_id, n+4 line_no, s supplier_name, l bee_level_raw, 'bidder_register' outcome, strftime(d,'%-d %B %Y') date_raw, 'T '||rb.k||'/2025' tender_number from rr join rb on rb.k=rr.k""",
)
def opening_register_rows(t):
    return G.opening_register_rows(I.opening_registers(t))


@query(
    "award_register_rows",
    f"""with {REG}, rr as (select k, 5 n, 'Kestrel '||c||' Roads (Pty) Ltd' s, 'Level '||(1+k%8) l from rb union all select k, 6, 'Heron Hardware CC', 'N/A' from rb where k%4<>0 union all select k, 7, 'Overberg '||c||' Hardware (Pty) Ltd', '2' from rb)
        select rr.k document_id, n line_no, s supplier_name, l bee_level_raw, 'awarded' outcome, strftime(d,'%-d %B %Y') date_raw, 'SC '||rb.k tender_number from rr join rb on rb.k=rr.k""",
)
def award_register_rows(t):
    return G.award_register_rows(I.award_registers(t))


@query(
    "scm_block_rows",
    f"""with {REG} select k document_id, 1 line_no, 'Kestrel '||c||' Plant Hire (Pty) Ltd' supplier_name, 'Level '||(1+k%8) bee_level_raw, 'awarded' outcome, strftime(d,'%-d %B %Y') date_raw, null tender_number from rb
        union all select k, 3, 'Heron Cleaning CC', '', 'awarded', strftime(d,'%B %Y'), 'Q'||k from rb""",
)
def scm_block_rows(t):
    return G.scm_block_rows(I.scm_reports(t))


TABLE_ROWS = """select k document_id, 0 table_no, 0 line_no, 'Kestrel '||c||' & Sons (Pty) Ltd' supplier_name, 'Level '||(1+k%9) bee_level_raw, {outcome} outcome, {date} date_raw, 'T'||k tender_number, null::varchar tender_description from rb
        union all select k, 0, 1, 'Heron Works CC', '4', {outcome}, strftime(d,'%-d %B %Y'), '', null from rb"""


@query(
    "html_table_rows",
    f"with {REG} " + TABLE_ROWS.format(outcome="case k%3 when 0 then 'bidder_register' when 1 then 'awarded' end", date="'5'"),
)
def html_table_rows(t):
    return G.html_table_rows(I.register_pages(t))


@query(
    "award_table_rows",
    f"with {REG} " + TABLE_ROWS.format(outcome="case k%3 when 0 then 'bidder_register' else 'awarded' end", date="strftime(d,'%d-%b-%y')"),
)
def award_table_rows(t):
    """Award tables of a site with hidden extra cells: the date is found by its shape."""
    return G.award_table_rows(I.register_pages(t), dates_by_shape=True)


@query(
    "site_table_rows",
    f"""with {REG} select k document_id, 1 line_no, 'Q'||k bulletin, 'Kestrel '||c||' Plant Hire (Pty) Ltd' supplier_name, 'Level '||(1+k%8) bee_level_raw, strftime(d,'%-d %B %Y') date_raw, 'awarded' outcome from rb
        union all select k, 3, 'Q'||k, 'Heron Cleaning CC', null, null, 'awarded' from rb""",
)
def site_table_rows(t):
    """A block layout given only by patterns."""
    return G.site_rows(
        I.scm_reports(t),
        r"(?im)^\s*(?=(?:awarded\s+to|successful\s+bidder)\s*:)",
        {
            "supplier_name": r"(?i)^(?:awarded\s+to|successful\s+bidder)\s*:\s*([^\n]+)",
            "bee_level_raw": r"(?i)B-?BBEE level\s*:\s*([^\n]+)",
            "date_raw": r"(?i)award date\s*:\s*([^\n]+)",
        },
        "awarded",
        heading={"bulletin": r"(?i)tender number\s*:\s*([^\n]+)"},
    )


# Reasons of every candidate, from the rotating flaws it was built with.
CANDIDATES = """
vb as (select o_orderkey k, o_custkey c, (o_orderdate::date + interval 300 month)::date d, ['Level 1','2','85 points','L 4','Level 12','Level 3'][o_orderkey%6+1] lv, ['1','2',null,'4',null,'3'][o_orderkey%6+1] lvl,
   ['awarded','bidder_register','responded','maybe'][(o_orderkey//3)%4+1] st, o_orderkey%5=0 mode_bidder from orders),
vd as (select *, case k%5 when 0 then 'Kestrel Plant Hire (Pty) Ltd' when 1 then 'Heron Works '||(c%7)||' Limited' when 2 then 'Kestrel Roads JV Heron Works' when 3 then 'Ltd' else case when true then 'Supply of Kestrel Catering (Pty) Ltd' end end nm,
   case when k%13=0 then null when k%7=0 then '2019' else strftime(d,'%Y-%m-%d') end dt, case when mode_bidder then 'bidder_register' else st end oc from vb),
vr as (select *, list_filter([case when lvl is null then 'invalid_level' end, case when dt is null then 'missing_date' when dt[:4]<'2024' then 'pre_boundary' end, case when k%11=0 or k%17=0 then 'missing_source' end,
   case when st='maybe' or (oc='awarded' and k%8=0) then 'ambiguous_semantics' end, case k%5 when 2 then 'joint_venture' when 3 then 'parser_fragment' when 4 then 'malformed_name' end], lambda x: x is not null) reasons from vd)"""


@query(
    "validate_candidates",
    f"with {CANDIDATES} select k document_id, nm as name, lvl bee_level, dt award_date, oc outcome, array_to_string(reasons,'|') reasons from vr",
)
def validate_candidates(t):
    return G.validate_candidates(I.candidates(t)).select("document_id", "name", "bee_level", "award_date", "outcome", "reasons")


@query(
    "rejection_summary",
    f"with {CANDIDATES} select k%100 document_id, count(*) candidates, count(*) filter (where len(reasons)=0) valid, count(*) filter (where len(reasons)>0) rejected from vr group by 1",
)
def rejection_summary(t):
    rows = G.validate_candidates(I.candidates(t))
    return RP.rejection_summary(rows.withColumn("document_id", F.col("document_id") % 100))


@query("rejection_reasons", f"with {CANDIDATES} select unnest(reasons) reason, count(*) n from vr group by 1")
def rejection_reasons(t):
    return RP.rejection_reasons(G.validate_candidates(I.candidates(t)))


def loose_rows(t):
    """Candidates whose date only is missing or old, to give large supplier groups."""
    rows = I.candidates(t).withColumn("date_raw", F.concat(F.lit("2025-0"), (1 + F.col("document_id") % 9).cast("string"), F.lit("-1"), (F.col("document_id") % 3).cast("string")))
    return G.validate_candidates(rows).filter(F.size("reasons") == 0)


LOOSE = """
lv as (select k, 0 line_no, replace(nm,'Kestrel Plant Hire (Pty) Ltd','Kestrel Plant Hire (Pty) Ltd') nm, lvl, '2025-0'||(1+k%9)||'-1'||(k%3) dt, oc, 'https://tenders.example.org/'||(k%400) url, case when k%2=0 then 'T'||(k%50) else '' end tn
   from vr where lvl is not null and k%11<>0 and k%17<>0 and st<>'maybe' and not (oc='awarded' and k%8=0) and k%5 in (0,1)),
lu as (select lower(nm) supplier_key, url, tn, lvl, dt, min(k) k from lv group by all),
lk as (select lu.*, lv.nm, lv.oc, row_number() over (partition by supplier_key order by lu.k) rn, count(*) over (partition by supplier_key) cnt from lu join lv on lv.k=lu.k)"""


@query(
    "group_corpus",
    f"""with {CANDIDATES}, {LOOSE} select supplier_key, max(nm) filter (where rn=1) canonical_name, max(cnt) disclosure_count,
        string_agg(url||' '||tn||' '||lvl||' '||dt||' '||oc, '|' order by rn) procurement from lk where rn<=8 group by 1""",
)
def group_corpus(t):
    corpus = G.group_corpus(loose_rows(t))
    text = F.transform("procurement", lambda p: F.concat_ws(" ", p["source_url"], p["tender_number"], p["bee_level"], p["award_date"], p["outcome"]))
    return corpus.withColumn("procurement", F.array_join(text, "|"))


@query(
    "new_vs_existing",
    f"""with {CANDIDATES}, {LOOSE} select supplier_key, max(nm) filter (where rn=1) canonical_name, supplier_key in (select 'heron works '||(c_custkey%3)||' limited' from customer) is_known from lk group by 1""",
)
def new_vs_existing(t):
    known = t.raw("customer").select(F.concat(F.lit("heron works "), (F.col("c_custkey") % 3).cast("string"), F.lit(" limited")).alias("name_key"))
    return G.new_vs_existing(G.group_corpus(loose_rows(t)), known).select("supplier_key", "canonical_name", "is_known")


@query(
    "cap_disclosures",
    """with b as (select o_custkey%40 c, o_orderkey k, 'u'||(o_orderkey%30) source_url, case when o_orderkey%2=0 then 'T'||(o_orderkey%9) end tender_number, (1+o_orderkey%4)::varchar bee_level,
           case when o_orderkey%3<>0 then strftime(o_orderdate,'%Y-%m') end award_date, case when o_orderkey%30<15 then 'awarded' else 'responded' end outcome from orders),
        u as (select distinct 'firm '||c supplier_key, source_url, tender_number, bee_level, award_date, outcome from b)
        select supplier_key, source_url, tender_number, bee_level, award_date, outcome, rn rank from (select *, row_number() over (partition by supplier_key order by award_date is null, outcome<>'awarded', award_date, tender_number nulls last, source_url, bee_level) rn from u) where rn<=8""",
)
def cap_disclosures(t):
    k = F.col("o_orderkey")
    rows = t.raw("orders").select(
        F.concat(F.lit(" Firm  "), (F.col("o_custkey") % 40).cast("string")).alias("supplier_name"),
        F.concat(F.lit("u"), (k % 30).cast("string")).alias("source_url"),
        F.when(k % 2 == 0, F.concat(F.lit("T"), (k % 9).cast("string"))).alias("tender_number"),
        (1 + k % 4).cast("string").alias("bee_level"),
        F.when(k % 3 != 0, F.date_format("o_orderdate", "yyyy-MM")).alias("award_date"),
        F.when(k % 30 < 15, "awarded").otherwise("responded").alias("outcome"),
    )
    return R.cap_disclosures(rows).drop("supplier_name").withColumnRenamed("_rank", "rank")
