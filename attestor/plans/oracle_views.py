"""The domain tables once more, as DuckDB SQL, for checking results.

Only used to build the check queries; no operator reads this module.
"""

from __future__ import annotations

import re

VIEWS: dict[str, str] = {}


def _names(index: str) -> str:
    from attestor.views import NAME_WORDS

    return "[" + ",".join(f"'{w}'" for w in NAME_WORDS) + f"][({index})%{len(NAME_WORDS)}+1]"


VIEWS["named_customers"] = f"""
select c_custkey k, c_mktsegment seg, (select max(c_custkey) from customer) last,
  case when c_custkey%89 in (1,2) then c_custkey-c_custkey%89 when c_custkey%41=0 and c_custkey>0 then c_custkey-1 else c_custkey end base
from customer"""

NORMAL = (
    "trim(regexp_replace(regexp_replace(regexp_replace(lower({0}),'[^a-z0-9]+',' ','g'),"
    "'\\b(pty|ltd|limited|inc|incorporated|proprietary|co|company|holdings|group|the)\\b',' ','g'),'\\s+',' ','g'))"
)


def normal(expr: str) -> str:
    return NORMAL.format(expr)


VIEWS["entities0"] = f"""
select k id, 'firm-'||k slug,
  'Firm '||base||' '||{_names('base')}||[' (Pty) Ltd',' Limited','',' Holdings',' Ltd'][k%5+1] canonical_name,
  case when k%500=7 then '1995/000523/07' when k%3<>0 then (1990+k%30)||'/'||lpad((k%1000000)::varchar,6,'0')||'/07' end registration_number,
  case when k%4=0 then null when k%2=1 then 'https://www.firm'||k||'.example.com/about' else 'firm'||k||'.example.com' end website,
  case when k%10=0 then 'hidden' when k%10=1 then 'draft' else 'public' end visibility,
  case when k%97=0 and k<last then k+1 end merged_into_id,
  case when k%23=0 then 'group' else 'company' end entity_type,
  case when k%7=0 then 'automation_allowed' when k%7=1 then 'locked' else 'review_only' end automation_state,
  date '1994-01-01' + (k%700)::int created_at,
  date '1999-01-01' + (k*7%730)::int updated_at
from named_customers"""
VIEWS["entities"] = f"""
select *, case when id%5<>0 then canonical_name||' (RF)' end legal_name,
  case when id%6=0 then 'Brand '||id end trading_name,
  {normal('canonical_name')} normalized_name,
  replace(registration_number,'/','') registration_number_normalized
from entities0"""
VIEWS["live"] = "select * from entities where visibility='public' and merged_into_id is null"
VIEWS["entity_aliases"] = """
select entity_id||'-'||alias_type id, *, trim(regexp_replace(lower(alias),'[^a-z0-9]+',' ','g')) normalized_alias from (
  select c_custkey entity_id, 'Alias '||c_custkey||' Ltd' alias, 'other' alias_type, case when c_custkey%2=0 then 'reviewed' else 'unreviewed' end reviewed_status from customer where c_custkey%3=1
  union all
  select c_custkey, 'Old firm '||(c_custkey-c_custkey%4), 'former_name', 'reviewed' from customer where c_custkey%6=1)"""
VIEWS["entity_relationships"] = """
select c_custkey||'-'||(c_custkey//10) id, c_custkey source_entity_id, c_custkey//10 target_entity_id,
  ['parent','holding_company','subsidiary','division'][c_custkey%4+1] relationship_type,
  case when c_custkey%7=0 then 'hidden' else 'public' end public_status,
  case when c_custkey%5=0 then 'pending' else 'approved' end review_state
from customer where c_custkey//10<>c_custkey"""
VIEWS["sectors"] = """
select distinct 'sec_'||lower(c_mktsegment) id, lower(c_mktsegment) slug, upper(c_mktsegment[1])||lower(c_mktsegment[2:]) as name from customer
union all values ('sec_jse','jse','Listed'),('sec_government_suppliers','government-suppliers','Government suppliers')"""
VIEWS["entity_classifications"] = """
select entity_id||'-'||sector_id||'-'||classification_type id, * from (
  select c_custkey entity_id, 'sec_'||lower(c_mktsegment) sector_id, 'sector' classification_type, c_custkey%9<>0 is_public from customer where c_custkey%8<>0
  union all select c_custkey, 'sec_jse', 'listing', true from customer where c_custkey%13=0
  union all select c_custkey, 'sec_building', 'sector', true from customer where c_custkey%17=0 and c_mktsegment<>'BUILDING'
  union all select c_custkey, 'sec_government_suppliers', 'sector', true from customer where c_custkey%29=0)"""
VIEWS["verification_agencies"] = """
select s_suppkey id, 'agency-'||s_suppkey slug, case when s_suppkey%9=4 then 'the verification of '||s_suppkey else 'Verifier '||s_suppkey end as name,
  case when s_suppkey%3=0 then s_name end legal_name, case when s_suppkey%4<>0 then 'https://verifier'||s_suppkey||'.example.org' end website,
  case when s_suppkey%10=0 then 'hidden' else 'public' end visibility from supplier"""
VIEWS["agency_aliases"] = "select s_suppkey agency_id, 'VA '||s_suppkey alias from supplier where s_suppkey%3=0"
VIEWS["agency_accreditations"] = "select s_suppkey agency_id, 'BVA'||lpad(s_suppkey::varchar,3,'0') accreditation_identifier from supplier where s_suppkey%2=0"
VIEWS["signatories"] = "select s_suppkey id, s_suppkey agency_id, s_name as name from supplier where s_suppkey%5<>0"
VIEWS["orders_d"] = """
select o_orderkey k, o_custkey cust, o_orderstatus st, o_orderpriority pr, o_orderdate::date d, o_orderkey%6<3 status,
  (select count(*) from supplier) agencies from orders"""
VIEWS["evidence0"] = """
select *, case when k%11<>0 then case when status then date_trunc('quarter',d)::date else d end end issue from orders_d"""
VIEWS["evidence_raw"] = """
select k id, cust owner_id,
  ['bee_certificate','bee_certificate','sworn_affidavit','government_procurement_disclosure','annual_report','company_webpage'][k%6+1] evidence_type,
  issue issue_date,
  case when status and k%7<>0 then issue + case when k%4=0 then 395 else 365 end end expiry_date,
  case when k%11=0 then null when status then 'month' else 'day' end issue_date_precision,
  null::varchar issue_date_raw,
  case when st='P' then 'unpublished' else 'published' end publication_state,
  case when st='P' then 'pending' else 'approved' end review_state,
  d+3 discovered_at, d+3 retrieved_at, d+3 created_at, d+10 updated_at,
  case when k%13<>0 then k%agencies end verifier_agency_id,
  case when k%6=1 then k%agencies end signatory_id,
  case when status then 'Certificate '||k when k%6=3 then 'Tender award '||k when k%6=4 then 'Annual report '||year(d) else 'Transformation page '||k end title,
  case when k%6=3 then 'https://tenders.example.org/awards/'||year(d)||'/'||k else 'https://www.firm'||cust||'.example.com/docs/doc-'||k||'.pdf' end source_url,
  case when k%6=3 then 'tenders.example.org' else 'firm'||cust||'.example.com' end source_domain,
  case when k%6=3 then 'Department '||((k+cust)%17) when k%5=0 then 'firm'||cust||'.example.com' end document_issuer,
  case when k%31=0 then 'application/zip' else 'application/pdf' end mime_type,
  sha256('document '||case when k%29=28 then k-1 else k end) content_hash
from evidence0"""
VIEWS["links"] = """
select o_orderkey id, o_orderkey evidence_id, o_custkey entity_id, ['confirmed','extracted','candidate','rejected','included'][o_orderkey%5+1] link_state,
  case when o_orderkey%2=0 then 'canonical_name' else 'registration_number' end match_method, round(0.9+(o_orderkey%10)/100.0,2) confidence from orders"""
# Window form of the lifecycle rules, written apart from the aggregates it checks.
VIEWS["pairs"] = """
select l.entity_id, e.id, e.evidence_type, e.issue_date, e.expiry_date, e.discovered_at,
  e.evidence_type in ('bee_certificate','sworn_affidavit') is_status,
  e.evidence_type in ('government_procurement_disclosure','company_disclosure','company_webpage','annual_report','integrated_report','esg_report','sustainability_report','transformation_report','investor_document') is_disc
from links l join evidence_raw e on e.id=l.evidence_id
where l.link_state in ('confirmed','extracted','candidate') and e.publication_state='published'"""
VIEWS["pool0"] = """
select *, max(case when is_status and not is_disc then 1 else 0 end) over (partition by entity_id)=1 has_status from pairs"""
VIEWS["pool"] = """
select *, not is_disc and (is_status or not has_status) in_pool,
  not is_disc and (is_status or not has_status) and expiry_date is not null and expiry_date>=date '2001-01-01' is_live from pool0"""
VIEWS["ranked_pool"] = """
select *, row_number() over (partition by entity_id, is_live order by coalesce(issue_date,date '0001-01-01') desc, coalesce(expiry_date,date '0001-01-01') desc, discovered_at desc, id desc) rn,
  row_number() over (partition by entity_id, in_pool order by coalesce(issue_date,date '0001-01-01') desc, coalesce(expiry_date,date '0001-01-01') desc, discovered_at desc, id desc) prn
from pool"""
VIEWS["facts0"] = """
select entity_id, bool_or(not is_disc) has_cert,
  count(*) filter (where is_live) live_count,
  max(id) filter (where is_live and rn=1) top_id, max(issue_date) filter (where is_live and rn=1) top_issue, max(expiry_date) filter (where is_live and rn=1) top_expiry,
  max(id) filter (where is_live and rn=2) next_id, max(issue_date) filter (where is_live and rn=2) next_issue, max(expiry_date) filter (where is_live and rn=2) next_expiry,
  max(id) filter (where in_pool and prn=1) support_id
from ranked_pool group by entity_id"""
VIEWS["facts"] = """
select *, case when disputed or live_count=0 then null else top_id end current_id, coalesce(case when disputed or live_count=0 then null else top_id end, support_id) supporting_id from (
  select *, live_count>=2 and ((top_issue is null and next_issue is null) or (top_issue=next_issue and top_expiry=next_expiry)) disputed from facts0)"""
VIEWS["decisions"] = """
select p.entity_id, p.id evidence_id, case
  when is_disc then 'historical'
  when f.disputed and is_live then 'disputed'
  when p.id=f.current_id then case when p.expiry_date<=date '2001-01-01'+90 then 'expiring_soon' else 'current' end
  when p.expiry_date<date '2001-01-01' then 'expired'
  when f.current_id is not null and in_pool then 'superseded'
  when p.expiry_date is null and in_pool then 'unknown_validity'
  else 'historical' end lifecycle
from pool p join facts f on f.entity_id=p.entity_id"""
# The same decisions half a year before.
for _name in ("pool", "ranked_pool", "facts0", "facts", "decisions"):
    VIEWS[f"{_name}_then"] = re.sub(r"\b(pool|ranked_pool|facts0|facts)\b", r"\1_then", VIEWS[_name]).replace("2001-01-01", "2000-07-01")
VIEWS["evidence"] = """
select e.*, coalesce(d.lifecycle,'discovered') lifecycle_state from evidence_raw e left join decisions d on d.evidence_id=e.id"""
VIEWS["vis"] = """
select l.entity_id, e.* from links l join evidence e on e.id=l.evidence_id where l.link_state in ('confirmed','extracted') and e.publication_state='published'"""
VIEWS["anylink"] = "select l.entity_id, e.* from links l join evidence e on e.id=l.evidence_id"
VIEWS["locations"] = """
select o_orderkey evidence_id, 'https://files.example.net/'||o_orderkey url, o_orderdate::date+4 last_seen_at from orders
union all select o_orderkey, 'https://mirror.example.net/'||o_orderkey, o_orderdate::date+9 from orders where o_orderkey%8=0"""
VIEWS["runs"] = """
select l_orderkey||'-'||l_suppkey||'-'||strftime(l_shipdate,'%Y%m%d') id, l_orderkey evidence_id, l_shipdate::date started_at, bool_and(l_returnflag<>'R') success,
  case when l_suppkey%4=0 then 'repair/v1' else 'deterministic/v1' end parser
from lineitem group by l_orderkey,l_suppkey,l_shipdate"""
VIEWS["claims0"] = """
select l_orderkey, l_orderkey||'-'||l_suppkey||'-'||strftime(l_shipdate,'%Y%m%d') run_id, f, max(l_partkey) v, max(l_quantity) q, max(l_discount) dd from (
 select *, case when l_linenumber<=2 then 'bee_level' when l_linenumber=3 then 'tender_number' when l_linenumber=4 then 'government_institution' when l_linenumber=5 then 'registration_number' when l_linenumber=6 then 'enterprise_class' else 'verification_agency' end f from lineitem)
group by l_orderkey,l_suppkey,l_shipdate,f"""
VIEWS["claims1"] = """
select *, case f when 'bee_level' then (1+v%8)::varchar when 'tender_number' then 'T-'||v when 'government_institution' then 'Department '||(v%17)
  when 'registration_number' then (1990+v%30)||lpad((v%1000000)::varchar,6,'0')||'07' when 'enterprise_class' then ['EME','QSE','Generic'][v%3+1] else 'Verifier '||(v%200) end val from claims0"""
VIEWS["claims"] = """
select run_id||'-'||f id, l_orderkey evidence_id, run_id extraction_run_id, f field_key,
  case when f='bee_level' then 'Level '||val else val end raw_value, case when v%6<>0 then val end normalized_value, case when v%12=0 then val end structured_value,
  case when q>=49 then case when f='bee_level' then ' 3 ' else val||'e' end when q=1 then '  ' end edited_value,
  round(0.5+dd*5,2) confidence, case when v%5=0 then 'published' else 'unpublished' end published_state from claims1"""
VIEWS["latest_run"] = """
select evidence_id, id run_id, started_at from (select *, row_number() over (partition by evidence_id order by started_at desc, id desc) rn from runs where success) where rn=1"""
VIEWS["working"] = """
select c.*, coalesce(nullif(trim(edited_value),''), normalized_value, structured_value, raw_value) as value from claims c join latest_run r on r.run_id=c.extraction_run_id"""
VIEWS["latest_val"] = """
select evidence_id, field_key, value from (
 select c.evidence_id, c.field_key, coalesce(edited_value,normalized_value,raw_value) as value,
   row_number() over (partition by c.evidence_id,c.field_key order by r.started_at desc, r.id desc) rn
 from claims c join runs r on r.id=c.extraction_run_id where r.success) where rn=1"""
VIEWS["published_claims"] = """
select entity_id||'-'||field_key id, * from (
 select c_custkey entity_id, 'bee_level' field_key, (1+c_custkey%8)::varchar as value, c_custkey evidence_id, date '1998-01-01'+(c_custkey%900)::int published_at from customer where c_custkey%4<>3
 union all
 select c_custkey, 'registration_number', (1990+x%30)||lpad((x%1000000)::varchar,6,'0')||'07', c_custkey, date '1998-01-01'+(c_custkey%900)::int
 from (select *, case when c_custkey%15=12 then c_custkey+1 else c_custkey end x from customer) where c_custkey%5=2)"""
VIEWS["field_overrides"] = """
select c_custkey entity_id, 'bee_level' field_key, case when c_custkey%38=0 then '2' end as value, true locked from customer where c_custkey%19=0
union all select c_custkey, 'scorecard_type', 'Generic', c_custkey%2=0 from customer where c_custkey%19=1"""
VIEWS["state"] = """
select f.entity_id,
  coalesce(lk.value, case when f.supporting_id is null then null when not f.disputed and lk.entity_id is null then coalesce(w.value, p.value) else p.value end) bee_level,
  lk2.value scorecard_type,
  case when f.supporting_id is null then null
       when f.disputed then pr.value
       else coalesce(case when coalesce(wr.value, pr.value) is null or (regexp_replace(lower(coalesce(wr.value, pr.value)),'[^a-z0-9]','','g') <> en.registration_number_normalized) then en.registration_number end, wr.value, pr.value) end registration_number,
  f.supporting_id evidence_id, e.verifier_agency_id, e.signatory_id,
  case when f.disputed then 'disputed' when f.current_id is not null then d.lifecycle
       when exists (select 1 from decisions x where x.entity_id=f.entity_id and x.lifecycle='unknown_validity') then 'unknown_validity'
       else d.lifecycle end lifecycle_state,
  coalesce(ph.at_d, pa.at_d) published_at, f.disputed
from facts f
left join evidence_raw e on e.id=f.supporting_id
left join decisions d on d.entity_id=f.entity_id and d.evidence_id=f.supporting_id
left join entities en on en.id=f.entity_id
left join (select * from field_overrides where locked and field_key='bee_level') lk on lk.entity_id=f.entity_id
left join (select * from field_overrides where locked and field_key='scorecard_type') lk2 on lk2.entity_id=f.entity_id
left join (select * from working where field_key='bee_level' and value<>'') w on w.evidence_id=f.supporting_id
left join (select * from working where field_key='registration_number') wr0 on wr0.evidence_id=f.supporting_id
left join lateral (select wr0.value as value where en.registration_number_normalized is null or regexp_replace(lower(wr0.value),'[^a-z0-9]','','g')=en.registration_number_normalized) wr on true
left join (select * from published_claims where field_key='bee_level') p on p.entity_id=f.entity_id
left join (select * from published_claims where field_key='registration_number') pr on pr.entity_id=f.entity_id
left join (select entity_id, min(published_at) at_d from published_claims group by 1) pa on pa.entity_id=f.entity_id
left join (select entity_id, evidence_id, min(published_at) at_d from published_claims group by 1,2) ph on ph.entity_id=f.entity_id and ph.evidence_id=f.supporting_id"""
VIEWS["sources"] = """
select c_custkey id, c_custkey entity_id, 'https://www.'||dom||'/' url, dom as domain, c_custkey%8<>0 enabled, ['daily','weekly','monthly','manual'][c_custkey%4+1] frequency,
  chk last_checked_at, case when c_custkey%7=0 then c_custkey%6 else 0 end consecutive_error_count,
  case when c_custkey%14=0 then date '2000-12-25'+(c_custkey%20)::int end backoff_until, chk+(c_custkey%40)::int next_check_at, date '2000-01-01'+(c_custkey%300)::int updated_at
from (select *, case when c_custkey%6=0 then 'other'||c_custkey||'.example.org' else 'firm'||c_custkey||'.example.com' end dom,
  case when c_custkey%11<>0 then date '2000-10-01'+(c_custkey%92)::int end chk from customer where c_custkey%5<>0)"""
VIEWS["review_items"] = """
select k id, kind as type, case when kind='conflicting_evidence' then 'Repair extracted a different '||case when k%5=0 then 'bee_level' else 'expiry_date' end||'. Stored value was kept.'
   when kind='invalid_extracted_claim' then case when k%3=0 then 'Value was suppressed and not shown.' else 'Value looks wrong.' end else 'Check '||kind end reason,
  case k%3 when 0 then 'pending' when 1 then 'approved' else 'deferred' end status, case when k%10=0 then 'high' else 'normal' end severity,
  cust entity_id, k evidence_id, d+5 generated_at
from (select *, case pr when '1-URGENT' then 'conflicting_evidence' when '2-HIGH' then 'registration_number_conflict' when '3-MEDIUM' then 'new_evidence' when '5-LOW' then 'uncertain_entity_match'
  else case when k%2=0 then 'extraction_failed' else 'invalid_extracted_claim' end end kind from orders_d) where k%4<>3"""
VIEWS["publication_events"] = """
select event_id id, user_id entity_id, event_id evidence_id, case when event_type='purchase' then 'auto_published' else 'published' end event_type, 'Published evidence '||event_id summary, ts published_at from events"""
VIEWS["submissions"] = "select event_id id, user_id::varchar ip_hash, case when event_type='view' then 'pending' else 'closed' end status, ts created_at from events"
VIEWS["source_checks"] = "select event_id id, user_id source_id, ts started_at, md5((floor(value/20)::bigint)::varchar) content_hash from events"
VIEWS["crawler_jobs"] = "select event_id id, case when event_type='error' then 'failed' else 'done' end state, ts created_at from events"
VIEWS["audit_logs"] = """
select event_id id, 'evidence.'||event_type "action", case when event_type='signup' then 'entity' else 'evidence' end target_type, user_id::varchar target_id, ts "at" from events"""
VIEWS["condition"] = """
select entity_id, count(*) filter (where pub) evidence_count, count(*) filter (where pub and pr) procurement_count, count(*) filter (where pub and st) certificate_count,
  coalesce(bool_or(pub and st and lifecycle_state in ('current','expiring_soon')),false) valid_certificate,
  coalesce(bool_or(pub and st and lifecycle_state='expired'),false) expired_certificate,
  coalesce(bool_or(pub and st and lifecycle_state='unknown_validity'),false) unknown_certificate,
  coalesce(bool_or(lifecycle_state='unknown_validity'),false) unknown_evidence,
  coalesce(bool_or(pub and evidence_type in ('company_disclosure','company_webpage','annual_report','integrated_report','transformation_report')),false) has_disclosure_type,
  coalesce(bool_or(pub and st and (lifecycle_state='expired' or (lifecycle_state='expiring_soon' and expiry_date<=date '2001-01-01'+60))),false) needs_replacement,
  coalesce(bool_or(verifier_agency_id is not null),false) has_verifier,
  count(distinct case when pub then evidence_type end) type_count,
  max(case when pr then year(issue_date) end) latest_year,
  count(distinct case when pub then document_issuer end) institution_count,
  coalesce(bool_or(pub and pr and issue_date>=date '2000-01-01'),false) recent_procurement
from (select *, publication_state='published' pub, evidence_type in ('bee_certificate','sworn_affidavit') st, evidence_type='government_procurement_disclosure' pr from anylink) group by entity_id"""
VIEWS["flags"] = """
select e.*, coalesce(c.evidence_count,0) evidence_count, coalesce(c.procurement_count,0) procurement_count, coalesce(c.certificate_count,0) certificate_count, coalesce(c.type_count,0) type_count,
  coalesce(c.institution_count,0) institution_count, c.latest_year,
  coalesce(c.valid_certificate,false) valid_certificate, coalesce(c.expired_certificate,false) expired_certificate, coalesce(c.unknown_certificate,false) unknown_certificate, coalesce(c.unknown_evidence,false) unknown_evidence,
  coalesce(c.has_disclosure_type,false) has_disclosure_type, coalesce(c.needs_replacement,false) needs_replacement, coalesce(c.has_verifier,false) has_verifier, coalesce(c.recent_procurement,false) recent_procurement,
  s.lifecycle_state current_state,
  exists (select 1 from entity_classifications x where x.entity_id=e.id and x.is_public and x.classification_type='sector' and x.sector_id not in ('sec_jse','sec_government_suppliers')) has_sector,
  exists (select 1 from entity_classifications x where x.entity_id=e.id and x.sector_id='sec_jse') listed,
  exists (select 1 from entity_relationships x where x.source_entity_id=e.id and x.relationship_type='parent') has_parent_edge,
  exists (select 1 from entity_relationships x where x.source_entity_id=e.id and x.relationship_type in ('parent','holding_company')) has_parent,
  exists (select 1 from sources x where x.entity_id=e.id) has_source,
  exists (select 1 from sources x where x.entity_id=e.id and x.domain=regexp_replace(lower(split_part(regexp_replace(e.website,'^https?://',''),'/',1)),'^www\\.','')) has_official_source,
  exists (select 1 from review_items x where x.entity_id=e.id and x.status='pending') has_pending_review
from entities e left join condition c on c.entity_id=e.id left join state s on s.entity_id=e.id"""
VIEWS["queues"] = """
select *, procurement_count>0 and certificate_count=0 q_procurement_only,
 registration_number is null or trim(registration_number)='' q_no_registration, not has_sector q_no_sector,
 website is null or trim(website)='' q_no_website,
 coalesce(current_state not in ('current','expiring_soon'),true) q_no_current_certificate,
 expired_certificate and not valid_certificate q_expired_certificate_only,
 unknown_evidence or coalesce(current_state='unknown_validity',false) q_validity_unconfirmed,
 has_pending_review q_review_required, not has_source q_no_monitored_source, evidence_count>=2 q_multiple_evidence,
 coalesce(current_state in ('current','expiring_soon'),false) q_current_certificate, coalesce(current_state='expiring_soon',false) q_expiring_soon,
 visibility='public' and website is not null and procurement_count>0 and certificate_count=0 q_certificate_enrichment,
 visibility='public' and registration_number is null and procurement_count>0 q_identity_enrichment,
 visibility='public' and website is not null and not has_official_source q_monitoring_setup,
 visibility='public' and needs_replacement q_expiry_replacement from flags"""
VIEWS["live_q"] = "select * from queues where visibility='public' and merged_into_id is null"
VIEWS["cat"] = """
select entity_id, bool_or(evidence_type in ('bee_certificate','sworn_affidavit') and lifecycle_state in ('current','expiring_soon')) valid,
 coalesce(bool_or(issue_date>=date '1999-01-01'),false) recent,
 coalesce(bool_or(issue_date>=date '1999-01-01' and evidence_type='government_procurement_disclosure'),false) recent_procurement,
 coalesce(bool_or(issue_date>=date '1999-01-01' and evidence_type in ('company_webpage','annual_report')),false) recent_company,
 coalesce(bool_or(issue_date<date '1999-01-01'),false) old, bool_or(issue_date is not null) dated,
 bool_or(evidence_type='government_procurement_disclosure') has_disclosure
from vis group by entity_id"""
VIEWS["ranked"] = """
select *, case when evidence_type in ('bee_certificate','sworn_affidavit') and lifecycle_state='current' then 100
  when evidence_type in ('bee_certificate','sworn_affidavit') and lifecycle_state='expiring_soon' then 90
  when evidence_type in ('company_disclosure','annual_report','integrated_report','esg_report','sustainability_report','transformation_report','investor_document') and issue_date>=date '1999-01-01' then 80
  when evidence_type='government_procurement_disclosure' and issue_date>=date '1999-01-01' then 70
  when evidence_type in ('bee_certificate','sworn_affidavit') and lifecycle_state='unknown_validity' then 60
  when evidence_type in ('bee_certificate','sworn_affidavit') then 50
  when evidence_type='government_procurement_disclosure' then 40 else 30 end as rank from vis"""
VIEWS["latest"] = """
select r.entity_id, r.id evidence_id, r.rank, r.evidence_type, r.lifecycle_state, r.issue_date, r.issue_date_precision, r.expiry_date, r.title, r.source_url, r.document_issuer, r.source_domain, r.verifier_agency_id, r.discovered_at,
  va.name agency_name, va.slug agency_slug, v.value reported_level
from (select *, row_number() over (partition by entity_id order by rank desc, issue_date desc nulls last, id desc) rn from ranked) r
left join verification_agencies va on va.id=r.verifier_agency_id
left join latest_val v on v.evidence_id=r.id and v.field_key='bee_level' where rn=1"""
VIEWS["confirmed"] = """
select l.evidence_id, l.entity_id, e.canonical_name entity_name, e.slug entity_slug from links l left join (select * from entities where visibility='public') e on e.id=l.entity_id where l.link_state='confirmed'"""

_WORD = re.compile(r"[A-Za-z_0-9]+")


def with_views(sql: str) -> str:
    """Prefix the query with the views it needs, in dependency order."""
    needed: set[str] = set()

    def need(text: str) -> None:
        for word in set(_WORD.findall(text)):
            if word in VIEWS and word not in needed:
                needed.add(word)
                need(VIEWS[word])

    need(sql)
    if not needed:
        return sql.strip()
    parts = ",\n".join(f"{name} as ({body.strip()})" for name, body in VIEWS.items() if name in needed)
    body = sql.strip()
    if body.lower().startswith("with recursive "):
        return f"with recursive {parts},\n{body[15:]}"
    if body.lower().startswith("with "):
        return f"with {parts},\n{body[5:]}"
    return f"with {parts}\n{body}"
