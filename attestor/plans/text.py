"""Runnable queries: text, date and name columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from attestor.functions import dates as D
from attestor.functions import documents as DOC
from attestor.functions import names as N
from attestor.functions import quality as Q
from attestor.functions import suppliers as S
from attestor.operators import documents as OD
from attestor.operators import evidence_dates as ED
from attestor.operators import ranking as R
from attestor.plans import inputs as I
from attestor.plans.registry import query
from attestor.schemas import DEFAULT_CLOCK as CLOCK


def lst(values) -> str:
    """A DuckDB list literal; None becomes null, numbers stay numbers."""
    return "[" + ",".join("null" if v is None else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'" for v in values) + "]"


def at(values, index: str) -> str:
    return f"{lst(values)}[(({index})%{len(values)})::int+1]"


def exprs(values, index: str) -> str:
    return f"[{','.join(values)}][(({index})%{len(values)})::int+1]"


# --- names -------------------------------------------------------------------
ACCENTS = "[ 'Société '||k||' & Söhne (Pty) Ltd', 'THE  Ñandú-Group '||k, 'O’Brien '||k||', Inc.', 'Ševčík Holdings '||k, '(Pty) Ltd'][k%5+1]"


@query(
    "normalize_names",
    f"""select id, trim(regexp_replace(regexp_replace(regexp_replace(replace(lower(strip_accents(raw)),'&',' and '),'[^\\p{{L}}\\p{{N}}]+',' ','g'),'\\b(pty|ltd|limited|inc|incorporated|proprietary|co|company|holdings|group|the)\\b',' ','g'),'\\s+',' ','g')) as name
       from (select c_custkey id, {ACCENTS.replace('k', 'c_custkey').replace('Ševčíc_custkey', 'Ševčík')} raw from customer)""",
)
def normalize_names(t):
    return I.accent_names(t).select("id", N.normalize_name(F.col("raw")).alias("name"))


@query(
    "normalize_aliases",
    f"""select id, trim(regexp_replace(lower(strip_accents(raw)),'[^\\p{{L}}\\p{{N}}]+',' ','g')) alias
       from (select c_custkey id, {ACCENTS.replace('k', 'c_custkey').replace('Ševčíc_custkey', 'Ševčík')} raw from customer)""",
)
def normalize_aliases(t):
    return I.accent_names(t).select("id", N.normalize_alias(F.col("raw")).alias("alias"))


@query(
    "normalize_names_documents",
    """select doc_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(replace(lower(strip_accents(text)),'&',' and '),'[^\\p{L}\\p{N}]+',' ','g'),'\\b(pty|ltd|limited|inc|incorporated|proprietary|co|company|holdings|group|the)\\b',' ','g'),'\\s+',' ','g'))) folded_md5 from documents""",
)
def normalize_names_documents(t):
    """The name fold over whole multilingual texts."""
    return t.raw("documents").select("doc_id", F.md5(N.normalize_name(F.col("text"))).alias("folded_md5"))


REGS = """['1998/'||d||'/07', ' 2004 / '||d||' / 23', '1890/'||d||'/07', '2011/'||d||'/99', '2002/001364/07', 'CK'||d, null]"""


@query(
    "normalize_registrations",
    f"""select k id, case k%7 when 0 then '1998'||d||'07' when 1 then '2004'||d||'23' when 2 then '1890'||d||'07' when 3 then '2011'||d||'99' when 4 then '200200136407' when 5 then 'ck'||d end normalized,
        k%7 in (0,1,4) valid, case k%7 when 0 then '1998/'||d||'/07' when 1 then '2004/'||d||'/23' when 4 then '2002/001364/07' end formatted, k%7=4 verifier
       from (select c_custkey k, lpad((c_custkey%1000000)::varchar,6,'0') d from customer)""",
)
def normalize_registrations(t):
    raw = F.col("raw")
    return I.registration_texts(t).select(
        "id",
        N.normalize_registration(raw).alias("normalized"),
        N.is_company_registration(raw).alias("valid"),
        N.format_registration(raw).alias("formatted"),
        N.is_verifier_registration(raw).alias("verifier"),
    )


@query(
    "slugify_names",
    """with b as (select id, left(replace(trim(regexp_replace(lower(canonical_name),'[^a-z0-9]+',' ','g')),' ','-'),80) base from entities)
       select id, case when id=min(id) over (partition by base) then base else left(base,60)||'-'||id end slug from b""",
)
def slugify_names(t):
    """Unique slugs: the first entity keeps the bare slug, others add their id."""
    rows = t["entities"].select("id", N.slugify(F.col("canonical_name")).alias("base"))
    first = rows.groupBy("base").agg(F.min("id").alias("first"))
    own = F.concat_ws("-", F.substring("base", 1, 60), "id")
    return rows.join(first, "base").select("id", F.when(F.col("id") == F.col("first"), F.col("base")).otherwise(own).alias("slug"))


@query(
    "url_parts",
    """select page_id, regexp_replace(lower(regexp_extract(url,'^[a-z]+://([^/?#]+)',1)),'^www\\.','') host,
        regexp_extract(url,'^([a-z]+://)',1)||lower(regexp_extract(url,'^[a-z]+://([^/?#]+)',1))||coalesce(nullif(regexp_replace(regexp_extract(url,'^[a-z]+://[^/?#]*([^?#]*)',1),'(.)/$','\\1'),''),'/')||regexp_extract(url,'^[^?#]*(\\?[^#]*)',1) canonical,
        (regexp_replace(lower(regexp_extract(url,'^[a-z]+://([^/?#]+)',1)),'^www\\.','') = 'example.com') or regexp_replace(lower(regexp_extract(url,'^[a-z]+://([^/?#]+)',1)),'^www\\.','') like '%.example.com' official
       from pages""",
)
def url_parts(t):
    url = F.col("url")
    return t.raw("pages").select(
        "page_id",
        N.url_host(url).alias("host"),
        N.canonical_url(url).alias("canonical"),
        N.is_official_domain(N.url_host(url), F.lit("www.example.com/about")).alias("official"),
    )


@query("normalize_levels", f"select o_orderkey id, {at(I.LEVELS, 'o_orderkey')} as level from orders")
def normalize_levels(t):
    return I.level_texts(t).select("id", N.normalize_level(F.col("raw")).alias("level"))


@query("strict_levels", f"select o_orderkey id, {at(I.STRICT_LEVELS, 'o_orderkey')} as level from orders")
def strict_levels(t):
    return I.level_texts(t).select("id", S.strict_level(F.col("raw")).alias("level"))


# --- dates -------------------------------------------------------------------
PARSED = """
with b as (select o_orderkey id, o_orderkey%10 f, o_orderdate::date d from orders),
 c as (select *, case when f in (0,1,2,3,5) then strftime(d,'%Y-%m-%d')
     when f in (4,9) then case when day(d)>12 {dmy} then strftime(d,'%Y-%m-%d') end
     when f=6 and day(last_day(d))=31 then strftime(d,'%Y-%m')||'-31' end iso,
   case f when 4 then strftime(d,'%d/%m/%Y') when 9 then strftime(d,'%d.%m.%Y') end sl from b)
select id, iso, (f=7 or (f in (4,9) and iso is null)) ambiguous,
  case when f=8 then null when f=7 then 'Unrecognised date "sometime soon" — left unknown.'
    when f=6 and iso is null then 'Impossible date "'||strftime(d,'%Y-%m')||'-31".'
    when f in (4,9) and iso is null then 'Ambiguous date "'||sl||'" — not guessed.'
    {note} end warning from c"""


@query("parse_dates", PARSED.format(dmy="", note=""))
def parse_dates(t):
    return I.date_texts(t).select("id", D.parse_date(F.col("raw")).alias("p")).select("id", "p.*")


@query(
    "parse_dates_day_first",
    PARSED.format(dmy="or true", note="when f in (4,9) and day(d)<=12 then 'Interpreted \"'||sl||'\" as DD/MM/YYYY (South African certificate convention).'"),
)
def parse_dates_day_first(t):
    return I.date_texts(t).select("id", D.parse_date(F.col("raw"), assume_dmy=True).alias("p")).select("id", "p.*")


@query(
    "source_date",
    """select o_orderkey id, case o_orderkey%7 when 0 then strftime(d,'%Y-%m-%d') when 1 then strftime(d,'%Y-%m-%d') when 2 then strftime(d,'%Y-%m-%d') when 3 then strftime(d,'%Y-%m') when 4 then strftime(d,'%Y') end stated
       from (select *, (o_orderdate::date + interval 120 month)::date d from orders)""",
)
def source_date(t):
    return I.stated_date_texts(t).select("id", D.source_date(F.col("raw")).alias("stated"))


# Dates inferred from title or file name (y, m, d), then the stored date rules.
RESOLVED = """
b as (select o_orderkey id, o_orderkey%7 f, o_orderkey%5 g, (o_orderdate::date + interval 120 month)::date d0, o_orderkey from orders),
st as (select *, case g when 0 then d0 when 1 then date_trunc('month',d0)::date when 2 then d0+400 end stored, case when g=2 then 'year' when g<>1 then 'day' end prec from b),
inf as (select *, case when f<=4 or f=6 then year(d0) end iy, case when f in (0,1,3,4,6) then month(d0) end im, case when f in (0,3) then day(d0) end id_,
   coalesce(stored = case when o_orderkey%10=0 then d0 else d0+900 end or stored=d0+901 or stored=d0+902, false) import_day from st),
kp as (select *, case when stored is not null and not import_day then year(stored) end ky, case when stored is not null and not import_day and g<>2 then month(stored) end km,
   case when stored is not null and not import_day and g<>2 then day(stored) end kd from inf),
rk as (select *, case when iy is null then 0 when id_ is not null then 3 when im is not null then 2 else 1 end ir, case when ky is null then 0 when kd is not null then 3 when km is not null then 2 else 1 end kr from kp),
ch as (select *, kr=3 and ((ir=2 and kd in (1,15) and iy=ky and im=km) or (ir=1 and kd in (1,15,30) and iy=ky)) inv from rk),
res as (select *, case when inv then 1 when kr=3 then 2 when ir>0 and ir<kr then 2 when ir>0 then 1 when kr>0 then 2 else 0 end pick from ch),
rp as (select *, case pick when 1 then iy when 2 then ky end y, case pick when 1 then im when 2 then km end m, case pick when 1 then id_ when 2 then kd end dd from res),
resolved as (select *, case when y is not null then lpad(y::varchar,4,'0')||'-'||lpad(coalesce(m,1)::varchar,2,'0')||'-'||lpad(coalesce(dd,1)::varchar,2,'0') end iso,
   case when dd is not null then 'day' when m is not null then 'month' when y is not null then 'year' end prec2,
   case when y is null then 'Not stated in source' else trim(coalesce(dd::varchar||' ','')||coalesce(strftime(make_date(2000,m::int,1),'%B')||' ','')||y) end lab from rp)"""


@query(
    "resolve_evidence_dates",
    f"with {RESOLVED} select id, iso, prec2 as precision, lab as label, y as year, m as month, y is not null stated, import_day from resolved",
)
def resolve_evidence_dates(t):
    return ED.resolve_evidence_dates(I.dated_documents(t)).select("id", "resolved.*", "import_day")


@query(
    "date_eligibility",
    f"with {RESOLVED} select id, case when y is null then 'unknown' when iso>='2008-07-01' or y>=2008 then 'modern' else 'past' end eligibility from resolved",
)
def date_eligibility(t):
    rows = ED.resolve_evidence_dates(I.dated_documents(t))
    return rows.select("id", D.eligibility(F.col("resolved"), F.lit("2008-07-01").cast("date")).alias("eligibility"))


POLISHED = """case when f=1 then 'Road Awards — '||strftime(d0,'%B')||' '||year(d0) when f=0 then 'Award of '||strftime(d0,'%-d %B %Y') when f=2 then 'Annual report '||year(d0)
   when f=3 then 'Register' when f=4 then 'Bid results' when f=6 then 'Tender results '||year(d0)||' '||strftime(d0,'%B') end"""


@query("polish_titles", f"with {RESOLVED} select id, {POLISHED} title from resolved")
def polish_titles(t):
    return I.dated_documents(t).select("id", D.polish_title(F.col("title")).alias("title"))


@query(
    "evidence_date_audit",
    f"""with {RESOLVED}, a as (select *, case when stored is null or import_day then 'import_timestamp' when y is null then 'unknown' when prec2='day' then 'exact' else prec2 end bucket,
         coalesce(strftime(stored,'%Y-%m-%d'),'')<>coalesce(iso,'') or coalesce(prec,'')<>coalesce(prec2,'') changed, f=1 and id%2=0 polished from resolved)
       select bucket, count(*) n, count(*) filter (where changed) corrected, count(*) filter (where polished) titles_polished from a group by 1""",
)
def evidence_date_audit(t):
    return ED.evidence_date_audit(I.dated_documents(t))


KIND = """case when evidence_type in ('bee_certificate','sworn_affidavit') then case lifecycle_state when 'current' then 'current_certificate' when 'expiring_soon' then 'expiring_soon' when 'unknown_validity' then 'validity_unconfirmed' when 'expired' then 'expired_certificate' else 'historical_certificate' end
  when rdate is null then 'official_undated' when evidence_type='government_procurement_disclosure' then case when rdate>='1999-01-01' then 'official_procurement_disclosure' else 'historical_procurement_disclosure' end
  else case when rdate>='1999-01-01' then 'official_company_disclosure' else 'historical_disclosure' end end"""
# Titles and paths of the evidence view state a year only from 2000 on.
EVIDENCE_DATED = """ed as (select *, case when dt is null or (invented and sy is not null) then sy||'-01-01' else dt end rdate, case when dt is null or (invented and sy is not null) then sy else year(idt) end ryear from (
   select *, coalesce(evidence_type in ('bee_certificate','sworn_affidavit')=false and day(issue_date) in (1,15,30) and year(issue_date)=sy, false) invented, issue_date idt,
     case when issue_date is null then null else strftime(issue_date,'%Y-%m-%d') end dt from (
     select *, case when year(discovered_at-3)>=2000 and evidence_type in ('annual_report','government_procurement_disclosure') then year(discovered_at-3) end sy from vis)))"""


@query("evidence_kind", f"with {EVIDENCE_DATED} select entity_id, id, {KIND} kind from ed")
def evidence_kind(t):
    return ED.eligible_evidence(t, CLOCK).select("entity_id", "id", "kind")


@query(
    "timeline_by_resolved_date",
    f"with {EVIDENCE_DATED} select entity_id, id evidence_id, rdate is null undated, rdate sort_date from ed",
)
def timeline_by_resolved_date(t):
    return ED.timeline_by_resolved_date(t).drop("label")


ELIGIBLE = f"""{EVIDENCE_DATED},
 el as (select *, case when rdate>='1999-01-01' or ryear>=1999 then 'modern' when rdate is not null then 'past' else 'unknown' end elig,
   evidence_type in ('bee_certificate','sworn_affidavit') and lifecycle_state in ('current','expiring_soon') cur, {KIND} kind from ed),
 er as (select *, case kind when 'current_certificate' then 100 when 'expiring_soon' then 90 when 'official_company_disclosure' then 80 when 'official_procurement_disclosure' then 70 when 'validity_unconfirmed' then 60
   when 'expired_certificate' then 50 when 'historical_certificate' then 50 when 'official_undated' then 35 else 40 end krank,
   case when evidence_type='company_webpage' and issue_date>=date '1999-01-01' then 80 else (select rank from ranked r where r.id=el.id) end drank from el),
 ew as (select *, row_number() over (partition by entity_id order by krank desc, coalesce(rdate,'') desc, id desc) kn, row_number() over (partition by entity_id order by drank desc, issue_date desc nulls last, id desc) dn from er),
 ea as (select entity_id, min(id) fe, count(*) filter (where elig='modern') mc, count(*) filter (where elig='past') pc, count(*) filter (where elig='unknown') uc, count(*) filter (where elig='modern' or cur) qc, bool_or(cur) cc,
   max(kind) filter (where kn=1) lk, bool_or(evidence_type not in ('bee_certificate','sworn_affidavit') and elig<>'modern') filter (where dn=1) dh from ew group by 1),
 ec as (select e.id entity_id, fe, coalesce(mc,0) mc, coalesce(pc,0) pc, coalesce(uc,0) uc, coalesce(qc,0) qc, coalesce(cc,false) cc, lk, coalesce(dh,false) dh from live e left join ea on ea.entity_id=e.id),
 eb as (select *, case when qc>0 and (dh or coalesce(lk in ('historical_procurement_disclosure','historical_disclosure','historical_certificate','expired_certificate'),false)) then 'keep_has_newer' when qc>0 then 'keep_qualifying_latest'
   when mc+pc+uc=0 or (uc>0 and pc=0) then 'unpublish_unknown' else 'unpublish_past' end bucket, qc=0 and (mc+pc+uc=0 or uc>0) review from ec)"""


@query(
    "classify_eligibility",
    f"""with {ELIGIBLE} select entity_id, fe first_evidence_id, mc modern_count, pc past_count, uc unknown_count, qc qualifying_count, cc current_certificate, lk latest_kind, dh directory_historical, bucket, review needs_review,
        case when bucket='keep_has_newer' then 'A historical record is the latest shown, but recent or current-certificate evidence also exists.' when qc>0 and cc then 'Current or expiring-soon certificate.' when qc>0 then 'Has stated recent qualifying evidence.'
          when mc+pc+uc=0 then 'No published evidence.' when uc>0 and pc=0 then 'Only evidence with dates not stated in the source.' when uc>0 then 'No recent qualifying evidence; the rest is old or undated.' else 'Only evidence from before the boundary.' end reason from eb""",
)
def classify_eligibility(t):
    return ED.classify_eligibility(t, CLOCK)


@query(
    "corpus_state",
    f"with {ELIGIBLE} select entity_id, case when cc then 'current_certificate' when mc>0 then 'recent_public_evidence' when pc>0 then 'historical_evidence_only' else 'official_undated' end state from eb",
)
def corpus_state(t):
    return ED.corpus_state(t, CLOCK)


@query(
    "recency_audit",
    f"""with {ELIGIBLE} select bucket, count(*) n, count(*) filter (where review) needs_review, string_agg(entity_id, ',' order by entity_id) filter (where rn<=5) samples
        from (select *, row_number() over (partition by bucket order by entity_id) rn from eb) group by 1""",
)
def recency_audit(t):
    return ED.recency_audit(ED.classify_eligibility(t, CLOCK))


@query(
    "withdraw_ineligible",
    f"""with {ELIGIBLE} select entity_id, 'hidden' visibility, case when mc+pc+uc=0 then 'No published evidence.' when uc>0 and pc=0 then 'Only evidence with dates not stated in the source.' when uc>0 then 'No recent qualifying evidence; the rest is old or undated.' else 'Only evidence from before the boundary.' end reason,
        case when review then 'invalid_dates' end review_type from eb where bucket like 'unpublish%'""",
)
def withdraw_ineligible(t):
    return ED.withdraw_ineligible(t, ED.classify_eligibility(t, CLOCK))


@query(
    "withdrawal_audit",
    f"""with {ELIGIBLE} select 'entity.unpublished' as action, 'entity' target_type, entity_id target_id, 'public' before_visibility, 'hidden' after_visibility, bucket,
        case when mc+pc+uc=0 or (uc>0 and pc=0) then 'Public page withdrawn: all evidence is undated. An unknown date does not count as recent. Entity, evidence and provenance were kept.'
        else 'Public page withdrawn: no qualifying evidence dated 1 January 1999 or later. Historical records were kept.' end reason from eb where qc=0""",
)
def withdrawal_audit(t):
    return ED.withdrawal_audit(ED.classify_eligibility(t, CLOCK), CLOCK)


@query(
    "withdrawal_reviews",
    f"""with {ELIGIBLE} select 'invalid_dates' as type, 'normal' severity, 'Unpublished after the recency audit: '||case when mc+pc+uc=0 then 'No published evidence.' when pc=0 then 'Only evidence with dates not stated in the source.' else 'No recent qualifying evidence; the rest is old or undated.' end
        ||' Publish again only if recent qualifying evidence is found.' reason, entity_id, fe evidence_id, bucket, uc unknown_count, pc past_count from eb where qc=0 and (mc+pc+uc=0 or uc>0)""",
)
def withdrawal_reviews(t):
    return ED.withdrawal_reviews(ED.classify_eligibility(t, CLOCK))


@query(
    "latest_summary",
    f"""with {EVIDENCE_DATED}, l as (select l.*, e.rdate, e.ryear, e.dt, e.invented from latest l join ed e on e.id=l.evidence_id),
        k as (select *, {KIND} kind, case when reported_level in ('1','2','3','4','5','6','7','8') then 'Level '||reported_level else reported_level end lev,
          coalesce(agency_name, case when document_issuer like 'Department%' then document_issuer end, case when evidence_type in ('annual_report','company_webpage') then 'Official company disclosure' end, document_issuer, source_domain) src,
          case when rdate is null then null when dt is null or invented then ryear::varchar when issue_date_precision='month' then strftime(rdate::date,'%B %Y') else strftime(rdate::date,'%-d %B %Y') end whn from l)
        select entity_id, evidence_id, kind, src as source,
          concat_ws(' · ', lev, case kind when 'current_certificate' then 'Current certificate' when 'expiring_soon' then 'Expiring soon' when 'official_company_disclosure' then 'Official company disclosure' when 'official_procurement_disclosure' then 'Official procurement disclosure'
             when 'validity_unconfirmed' then 'Validity unconfirmed' when 'expired_certificate' then 'Expired certificate' when 'historical_certificate' then 'Historical certificate' when 'historical_procurement_disclosure' then 'Historical procurement disclosure'
             when 'historical_disclosure' then 'Historical disclosure' else 'Official evidence — source date not stated' end, src,
            case when kind in ('current_certificate','expiring_soon') then coalesce('expires '||strftime(expiry_date,'%-d %B %Y'), whn) else whn end) summary from k""",
)
def latest_summary(t):
    return ED.latest_summary(t, CLOCK, R.latest_evidence_per_entity(t, CLOCK))


# --- supplier names ----------------------------------------------------------
@query(
    "clean_suppliers",
    """select k id, case k%10 when 0 then 'Kestrel '||k||' Builders (Pty) Ltd' when 1 then 'Kestrel '||k when 2 then 'Kestrel '||k||' (Pty) Ltd' when 3 then '''Quoted'' Works '||k||' Ltd' when 4 then 'Kestrel '||k||' JV Heron '||k
         when 5 then 'tion Services' when 6 then 'Thandi Mokoena' when 7 then 'Various' when 8 then 'Kestrel Engineering Services '||k||' Incorporated' else 'GWK Limited' end canonical_name,
        case k%10 when 1 then 'Heron '||k when 2 then 'Heron Print '||k end trading_name, case k%10 when 2 then 'Kestrel '||k||' (Pty) Ltd' end parent_name, case k%10 when 1 then 'Heron '||k when 2 then 'Heron Print '||k else '' end aliases
       from (select c_custkey k from customer)""",
)
def clean_suppliers(t):
    return I.supplier_texts(t).select("id", S.clean_supplier(F.col("raw")).alias("c")).select("id", "c.*")


SALVAGE = ["Supply of goods Kestrel Roads Pty Ltd", "Plumbing of kestrel Works Heron Traders CC", "Infrastructure Roads-12 Kestrel Civils (Pty) Ltd", "Kestrel Pty (Ltd) (reg", "Heron Mining Provinces", "Kestrel of the North"]
SALVAGED = ["Kestrel Roads Pty Ltd", "Works Heron Traders CC", "Kestrel Civils (Pty) Ltd", "Kestrel (Pty) Ltd", "Heron Mining", "Kestrel of the North"]


@query("salvage_names", f"select c_custkey id, {at(SALVAGED, 'c_custkey')} as name from customer")
def salvage_names(t):
    k = F.col("c_custkey")
    return t.raw("customer").select(k.alias("id"), S.salvage_name(I.pick(SALVAGE, k)).alias("name"))


MUNICIPAL = [
    "N/A Kestrel {k} Works (Pty) Ltd",
    "Financial Services & Risk Management  Heron {k} CC",
    "MLM/SCM/12/2024 R 1 200,50 Kestrel {k}",
    "K2021123456 (SA) Pty) Ltd t/a Heron Tiles {k}",
    "K2021123456 t/a Plover {k} Glass",
    "Wagtail {k} Works, a division of Heron",
    "Kestrel {k} Civils (Pty) Ltd",
    "Heron (Pty) Ltd Plover (Pty) Ltd {k}",
    "Noisy Brand {k}",
]


@query(
    "municipal_names",
    """select c_custkey id, ['Kestrel '||c_custkey||' Works (Pty) Ltd','Heron '||c_custkey||' CC','Kestrel '||c_custkey,'Heron Tiles '||c_custkey,'Plover '||c_custkey||' Glass','Wagtail '||c_custkey||' Works, a division of Heron',
          'Kestrel '||c_custkey||' Civils (Pty) Ltd','Heron (Pty) Ltd Plover (Pty) Ltd '||c_custkey,'Noisy Brand '||c_custkey][c_custkey%9+1] as name, c_custkey%9 not in (1,6) noise, c_custkey%9 in (5,7,8) still_noise from customer""",
)
def municipal_names(t):
    raw = I.pick([I.with_key(m, F.col("c_custkey")) for m in MUNICIPAL], F.col("c_custkey"))
    rows = t.raw("customer").select(F.col("c_custkey").alias("id"), raw.alias("raw"), S.municipal_name(raw).alias("name"))
    return rows.select("id", "name", S.is_municipal_noise(F.col("raw"), ["noisy brand"]).alias("noise"), S.is_municipal_noise(F.col("name"), ["noisy brand"]).alias("still_noise"))


@query(
    "name_quality",
    """select k id, k%10=4 joint_venture, k%10 in (5,7,9) malformed, k%20=9 short_legal, k%10=6 person,
        case when k%10=4 then 'joint venture or consortium' when k%10 in (5,7) or k%20=19 then 'malformed name' when k%10=6 then 'looks like a person, not a company' end reason
       from (select c_custkey k from customer)""",
)
def name_quality(t):
    raw, reg = F.col("raw"), F.col("registration")
    return I.supplier_texts(t).select(
        "id",
        S.is_joint_venture(raw).alias("joint_venture"),
        S.is_malformed(raw).alias("malformed"),
        S.is_short_legal_name(raw, reg).alias("short_legal"),
        S.looks_like_person(raw).alias("person"),
        S.reject_reason(raw, reg).alias("reason"),
    )


SECTORS = ["", "sec_construction", "sec_engineering", "sec_security", "sec_banking", "sec_logistics", "sec_food", "sec_healthcare", "", "sec_legal", "sec_professional", "sec_energy"]


@query("infer_sectors", f"select id, {at(SECTORS, 'base')} sectors from entities e join (select k, base from named_customers) n on n.k=e.id")
def infer_sectors(t):
    return t["entities"].select("id", S.infer_sectors(F.col("canonical_name")).alias("sectors"))


@query("infer_evidence_type", f"select o_orderkey id, {at(I.URL_TYPES, 'o_orderkey')} evidence_type from orders")
def infer_evidence_type(t):
    return I.url_texts(t).select("id", DOC.infer_evidence_type(F.col("url"), F.lit(None).cast("string")).alias("evidence_type"))


@query(
    "evidence_likeness",
    "select o_orderkey id, "
    + exprs(
        [
            " + ".join(f"(case when contains('{u.replace('{k}', '')}','{h}') then 1 else 0 end)" for h in DOC.EVIDENCE_HINTS)
            + (" + 2" if ".pdf" in u else " + 0")
            for u in I.URLS
        ],
        "o_orderkey",
    )
    + " score from orders",
)
def evidence_likeness(t):
    none = F.lit(None).cast("string")
    return I.url_texts(t).select("id", DOC.evidence_likeness(F.col("url"), none, none).alias("score"))


@query(
    "canonical_agencies",
    "select o_orderkey id, case o_orderkey%9 when 0 then 'EmpowerLogic (Pty) Ltd' when 2 then 'Verifier '||(o_orderkey%50) when 4 then 'Honeycomb BEE Ratings' when 8 then 'Mosela Rating Agency (Pty) Ltd' end agency from orders",
)
def canonical_agencies(t):
    return I.agency_texts(t).select("id", Q.canonical_agency(F.col("raw")).alias("agency"))


FIELD_KEYS = ["legal_entity_name", "signatory", "certificate_number", "verification_agency", "measured_entity", "b-bbee-level", "trading_name", "odd_field"]
FIELD_KEYS[5] = "bee_level"


@query("canonical_fields", f"select o_orderkey id, {at(FIELD_KEYS, 'o_orderkey')} field from orders")
def canonical_fields(t):
    return I.claim_texts(t).select("id", Q.canonical_field(F.col("field_key")).alias("field"))


# Row = field, column = value of inputs.claim_texts; 1 when the value may be shown.
PLAUSIBLE = {
    "legal_entity_name": [1, 1, 1, 1, 0, 0, 0, 0, 1, 1, 0],
    "signatory": [0, 1, 0, 0, 0, 0, 0, 0, 0, 1, 0],
    "certificate_number": [1, 0, 1, 0, 0, 0, 0, 0, 0, 0, 0],
    "verification_agency": [1, 1, 1, 0, 0, 0, 1, 0, 1, 1, 0],
    "measured_entity": [1, 1, 1, 1, 0, 0, 0, 0, 1, 1, 0],
    "bee_level": [1, 1, 1, 1, 1, 1, 1, 1, 1, 1, 0],
    "trading_name": [1, 1, 1, 1, 0, 0, 0, 0, 1, 1, 0],
    "odd_field": [1, 1, 1, 1, 1, 1, 1, 1, 1, 1, 0],
}


@query(
    "claim_plausibility",
    "select o_orderkey id, "
    + exprs([lst(PLAUSIBLE[f]) for f in FIELD_KEYS], "o_orderkey")
    + "[((o_orderkey//8)%11)::int+1]=1 plausible from orders",
)
def claim_plausibility(t):
    return I.claim_texts(t).select("id", Q.plausible_claim(Q.canonical_field(F.col("field_key")), F.col("value")).alias("plausible"))


@query(
    "linked_name_overlap",
    """select k id, case k%4 when 0 then true when 1 then false when 2 then true else true end matches from (select c_custkey k from customer)""",
)
def linked_name_overlap(t):
    """Does a printed name fit the entity it was linked to?"""
    k = F.col("c_custkey")
    printed = I.pick(["heron builders", "osprey catering", "Osprey Catering", "merlin works"], k)
    return t.raw("customer").select(
        k.alias("id"),
        Q.matches_linked(printed, F.concat(F.lit("Heron Group "), k.cast("string"), F.lit(" builders")), F.array(F.lit("Merlin Works Ltd"))).alias("matches"),
    )


@query(
    "state_labels",
    """select evidence_type, lifecycle_state, case evidence_type when 'bee_certificate' then 'B-BBEE certificate' when 'sworn_affidavit' then 'Sworn affidavit' when 'annual_report' then 'Annual report' when 'company_webpage' then 'Company webpage' else 'Official procurement disclosure' end type_label,
         case lifecycle_state when 'expiring_soon' then 'Expiring soon' when 'unknown_validity' then 'Validity unconfirmed' else upper(lifecycle_state[1])||lifecycle_state[2:] end state_label,
         case match_method when 'canonical_name' then 'Canonical Name' else 'Registration Number' end method_label, count(*) n
       from evidence e join links l on l.evidence_id=e.id group by 1,2,3,4,5""",
)
def state_labels(t):
    links = t["evidence_entity_links"].select(F.col("evidence_id").alias("id"), "match_method")
    return (
        t["evidence"]
        .join(links, "id")
        .groupBy("evidence_type", "lifecycle_state", "match_method")
        .agg(F.count("*").alias("n"))
        .select(
            "evidence_type",
            "lifecycle_state",
            DOC.state_label(F.col("evidence_type")).alias("type_label"),
            DOC.state_label(F.col("lifecycle_state")).alias("state_label"),
            DOC.state_label(F.col("match_method")).alias("method_label"),
            "n",
        )
    )


INTERPRETED = f"""with {EVIDENCE_DATED} select entity_id, id, case when evidence_type='government_procurement_disclosure' then case when rdate is null then 'official_undated' when rdate>='1999-01-01' or ryear>=1999 then 'official_dated_disclosure' else 'historical_procurement_disclosure' end
   else case lifecycle_state when 'current' then 'current_certificate' when 'expiring_soon' then 'expiring_soon' when 'unknown_validity' then 'validity_unconfirmed' when 'expired' then 'expired_certificate' when 'historical' then 'historical_certificate' when 'superseded' then 'historical_certificate' else lifecycle_state end end code from ed"""


@query("interpretation", INTERPRETED)
def interpretation(t):
    return ED.eligible_evidence(t, CLOCK).select(
        "entity_id", "id", DOC.interpretation(F.col("evidence_type"), F.col("lifecycle_state"), F.col("eligibility")).alias("code")
    )


@query(
    "company_interpretation",
    """select e.id, case when s.lifecycle_state='current' then 'current_certificate' when s.lifecycle_state='expiring_soon' then 'expiring_soon' when s.lifecycle_state='unknown_validity' then 'validity_unconfirmed' when s.lifecycle_state='expired' then 'expired_certificate'
        when s.lifecycle_state='disputed' then 'disputed' when c.has_disclosure then case when c.recent_procurement then 'official_dated_disclosure' else 'historical_procurement_disclosure' end when c.recent_company then 'official_company_disclosure'
        when s.lifecycle_state in ('historical','superseded') then 'historical_certificate' else 'no_current_certificate' end code
       from live e left join state s on s.entity_id=e.id left join cat c on c.entity_id=e.id""",
)
def company_interpretation(t):
    from attestor.operators.common import live_entity
    from attestor.operators.flags import category_flags

    state = t["entity_current_state"].select(F.col("entity_id").alias("id"), "lifecycle_state")
    rows = t["entities"].filter(live_entity()).select("id").join(state, "id", "left").join(category_flags(t, CLOCK), "id", "left")
    code = DOC.company_interpretation(
        F.col("lifecycle_state"), F.lit(None).cast("string"), F.coalesce("has_disclosure", F.lit(False)), F.col("recent_procurement"), F.coalesce("recent_company", F.lit(False))
    )
    return rows.select("id", code.alias("code"))


# --- documents and pages -----------------------------------------------------
@query("html_to_text", """select page_id, md5(trim(regexp_replace(replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html,'(?is)<script.*?</script>',' ','g'),'(?is)<style.*?</style>',' ','g'),'<[^>]+>',' ','g'),'(?i)&nbsp;',' ','g'),'&#39;',''''),'\\s+',' ','g'))) text_md5 from pages""")
def html_to_text(t):
    return t.raw("pages").select("page_id", F.md5(DOC.html_to_text(F.col("html"))).alias("text_md5"))


LINKS = """
pg as (select page_id, url page_url, regexp_extract(url,'^([a-z]+://[^/?#]*)',1) origin, regexp_replace(url,'[?#].*$','') bare,
   regexp_extract_all(html,'(?is)<a\\s[^>]*href=["'']([^"'']+)["''][^>]*>(.*?)</a>',1) hrefs, regexp_extract_all(html,'(?is)<a\\s[^>]*href=["'']([^"'']+)["''][^>]*>(.*?)</a>',2) texts from pages),
lk as (select page_id, page_url, origin, bare, unnest(hrefs) href, unnest(texts) body, unnest(range(len(hrefs))) "position" from pg),
lr as (select *, case when regexp_matches(href,'^[A-Za-z][A-Za-z0-9+.-]*:') then href when href like '//%' then regexp_extract(page_url,'^([a-z]+:)',1)||href when href like '/%' then origin||href when href like '#%' then regexp_replace(page_url,'#.*$','')||href
    when href like '?%' then bare||href when bare=origin then origin||'/'||href else regexp_replace(bare,'[^/]*$','')||href end raw_url from lk),
le as (select page_id, page_url, "position", array_to_string(list_transform(string_split(raw_url,''), lambda c: case when c=' ' then '%20' when ord(c)>127 then url_encode(c) else c end),'') url, trim(regexp_replace(regexp_replace(body,'<[^>]+>',' ','g'),'\\s+',' ','g')) as text from lr)"""


@query("extract_links", f'with {LINKS} select page_id, page_url, "position", url, text from le')
def extract_links(t):
    return OD.extract_links(t.raw("pages").select("page_id", "url", "html"))


@query(
    "link_candidate_filter",
    f"""with {LINKS} select page_id, page_url, "position", url, text from le where regexp_matches(url,'^https?://')
        and regexp_replace(lower(regexp_extract(url,'^[a-zA-Z]+://([^/?#:]+)',1)),'^www\\.','')=regexp_replace(lower(regexp_extract(page_url,'^[a-zA-Z]+://([^/?#:]+)',1)),'^www\\.','') and not contains(url,'/and')
        and (contains(url,'/the') or contains(lower(url),'bee') or contains(lower(url),'supplier') or contains(lower(url),'certificate') or contains(lower(url),'procurement') or regexp_matches(url,'(?i)\\.pdf($|\\?)'))""",
)
def link_candidate_filter(t):
    links = OD.extract_links(t.raw("pages").select("page_id", "url", "html"))
    return OD.link_candidate_filter(links, exclusions=["/and"], patterns=["/the"])


@query("near_text_hash", """select doc_id, sha256(lower(trim(regexp_replace(text,'\\s+',' ','g')))) normalized_hash from documents""")
def near_text_hash(t):
    return t.raw("documents").select("doc_id", DOC.near_text_hash(F.col("text")).alias("normalized_hash"))


@query(
    "near_duplicate_groups",
    """select sha256(lower(trim(regexp_replace(text,'\\s+',' ','g')))) normalized_hash, min(doc_id) doc_id, count(*) copies from documents group by 1 having count(*)>1""",
)
def near_duplicate_groups(t):
    return OD.near_duplicate_groups(t.raw("documents"))


def hashed_documents(t):
    return t.raw("documents").select(
        "doc_id", F.sha2("text", 256).alias("content_hash"), F.concat(F.lit("https://docs.example.org/"), F.col("doc_id").cast("string")).alias("url"), (F.col("doc_id") % 31).alias("seen_at")
    )


@query("dedupe_documents", "select sha256(text) content_hash, min(doc_id) doc_id, count(*) copies, max(doc_id%31) last_seen_at from documents group by 1")
def dedupe_documents(t):
    return OD.dedupe_documents(hashed_documents(t))


@query(
    "document_locations",
    "select min(doc_id) over (partition by sha256(text)) evidence_id, 'https://docs.example.org/'||doc_id url, doc_id%31 last_seen_at from documents",
)
def document_locations(t):
    return OD.document_locations(hashed_documents(t))


@query(
    "changed_documents",
    """select doc_id::varchar document_key, sha256(text) content_hash, case doc_id%5 when 0 then 'new' when 1 then 'unchanged' when 2 then 'changed' when 3 then 'pending' else 'unchanged' end status from documents""",
)
def changed_documents(t):
    k = F.col("doc_id")
    current = t.raw("documents").select(k.cast("string").alias("document_key"), F.sha2("text", 256).alias("content_hash"), k.alias("k"))
    ledger = current.filter(F.col("k") % 5 != 0).select(
        "document_key",
        F.when(F.col("k") % 5 == 3, "FAILED").otherwise("IMPORTED").alias("import_status"),
        F.when(F.col("k") % 5 == 2, F.lit("other")).otherwise(F.col("content_hash")).alias("imported_content_hash"),
    )
    return OD.changed_documents(current, ledger)


@query(
    "disclosure_identity",
    f"""select k id, sha256('gpd:v1|'||lower('https://T.example.org/'||(k%50))||'|'||coalesce(case when k%3=0 then 't-'||(k%20) end,'')||'|'||{at(['société kestrel', 'heron works and sons'], 'k')}||'|'||(1+k%8)||'|'||coalesce(case when k%4<>0 then strftime(d,'%Y-%m') end,'')) identity_hash
        from orders_d""".replace("'société kestrel'", "'societe kestrel'"),
)
def disclosure_identity(t):
    k = F.col("o_orderkey")
    rows = t.raw("orders").select(
        k.alias("id"),
        F.concat(F.lit(" https://T.example.org/"), (k % 50).cast("string")).alias("source_url"),
        F.when(k % 3 == 0, F.concat(F.lit("T-"), (k % 20).cast("string"))).alias("tender_number"),
        I.pick(["Société Kestrel Ltd", "Heron Works & Sons (Pty) Ltd"], k).alias("canonical_name"),
        (1 + k % 8).cast("string").alias("bee_level"),
        F.when(k % 4 != 0, F.date_format("o_orderdate", "yyyy-MM")).alias("evidence_date"),
    )
    return OD.disclosure_identity(rows).select("id", "identity_hash")
