"""Runnable queries: resolution, publication, merging, checks."""

from __future__ import annotations

from collections import ChainMap
from functools import lru_cache

from pyspark.sql import functions as F

from attestor.operators import imports as IM
from attestor.operators import maintain as M
from attestor.operators import patches as PT
from attestor.operators import publish as P
from attestor.operators import quality as QC
from attestor.operators import resolve as RS
from attestor.operators.claims import latest_successful_run
from attestor.operators.common import shared_folder
from attestor.plans import inputs as I
from attestor.plans.oracle_views import normal
from attestor.plans.registry import query
from attestor.schemas import DEFAULT_CLOCK as CLOCK
from attestor.views import NAME_WORDS, Tables


def s(col):
    return col.cast("string")


# --- resolution --------------------------------------------------------------
def wanted(t):
    """Typed names and numbers: known, aliased, unknown."""
    k = F.col("c_custkey")
    name = I.pick([F.concat(F.lit("FIRM "), s(k), F.lit(" Trading Ltd")), F.concat(F.lit("Old firm "), s(k)), F.concat(F.lit("Unknown "), s(k)), F.concat(F.lit("Firm "), s(k), F.lit(" Bank"))], k)
    reg = F.when(k % 6 == 1, F.concat(s(1990 + k % 30), F.lit(" / "), F.lpad(s(k % 1000000), 6, "0"), F.lit("/07"))).when(k % 6 == 2, "not a number")
    return t.raw("customer").select(k.alias("ordinal"), name.alias("name"), reg.alias("registration"))


WANTED = f"""
wn as (select c_custkey o, ['firm '||c_custkey||' trading','old firm '||c_custkey,'unknown '||c_custkey,'firm '||c_custkey||' bank'][c_custkey%4+1] nk,
   case when c_custkey%6=1 then (1990+c_custkey%30)||lpad((c_custkey%1000000)::varchar,6,'0')||'07' when c_custkey%6=2 then 'notanumber' end rk,
   ['FIRM '||c_custkey||' Trading Ltd','Old firm '||c_custkey,'Unknown '||c_custkey,'Firm '||c_custkey||' Bank'][c_custkey%4+1] nm,
   case when c_custkey%6=1 then (1990+c_custkey%30)||' / '||lpad((c_custkey%1000000)::varchar,6,'0')||'/07' when c_custkey%6=2 then 'not a number' end rg from customer),
um as (select * from entities where merged_into_id is null),
rx as (select registration_number_normalized rk, min(id) rid, count(*) rn from um where registration_number_normalized is not null group by 1),
nx as (select normalized_name nk, min(id) nid from um group by 1),
ax as (select a.normalized_alias nk, min(a.entity_id) aid from entity_aliases a join um on um.id=a.entity_id group by 1),
found as (select wn.*, rx.rid, rx.rn, nx.nid, ax.aid from wn left join rx on rx.rk=wn.rk left join nx on nx.nk=wn.nk left join ax on ax.nk=wn.nk)"""


@query(
    "find_existing_entity",
    f"with {WANTED} select o ordinal, nm as name, rg registration, coalesce(rid,nid,aid) entity_id, case when rid is not null then 'registration_number' when nid is not null then 'canonical_name' when aid is not null then 'alias' end via from found",
)
def find_existing_entity(t):
    return RS.find_existing_entity(t, wanted(t))


@query(
    "resolve_entity",
    f"""with {WANTED},
      cand0 as (select normalized_name nk, id, registration_number_normalized rg2, true isn from um union all select a.normalized_alias, um.id, um.registration_number_normalized, false from entity_aliases a join um on um.id=a.entity_id),
      cand as (select nk, count(distinct id) n, min(id) cid, bool_or(isn) anyn, min(rg2) lo, max(rg2) hi from cand0 group by 1),
      jj as (select w.*, case when w.o%5=0 then w.o end sug, e.id sid0, coalesce(e.merged_into_id, e.id) sid, e.registration_number_normalized sreg, o2.normalized_name own,
          exists (select 1 from entity_aliases a where a.entity_id=w.rid and a.normalized_alias=w.nk) aok, c.n, c.cid, c.anyn, c.lo, c.hi
        from found w left join entities e on e.id=case when w.o%5=0 then w.o end left join entities o2 on o2.id=w.rid left join cand c on c.nk=w.nk),
      kk as (select *, case when sid is not null and rk is not null and sreg is not null and rk<>sreg then 'sc' when sid is not null then 's' when rn=1 and nk<>own and not aok then 'rd' when rn=1 then 'r'
          when n=1 and rk is not null and coalesce(lo<>rk,false) then 'nc' when n=1 and anyn then 'n' when n=1 then 'a' when n>1 and rk is not null and coalesce(lo<>rk or hi<>rk,false) then 'mc' when n>1 then 'm' else 'x' end k from jj)
      select o mention_id, case when k in ('sc','s') then sid when k in ('rd','r') then rid when k in ('nc','n','a') then cid end entity_id,
        case k when 'sc' then 'admin' when 's' then 'admin' when 'rd' then 'registration_number' when 'r' then 'registration_number' when 'nc' then 'name' when 'n' then 'canonical_name' when 'a' then 'alias' when 'mc' then 'ambiguous_name' when 'm' then 'ambiguous_name' end as method,
        (case k when 'sc' then 0.4 when 's' then 1.0 when 'rd' then 0.7 when 'r' then 0.99 when 'nc' then 0.4 when 'n' then 0.92 when 'a' then 0.92 when 'x' then 0 else 0.3 end)::double confidence, k in ('sc','rd','nc','mc','m','x') uncertain,
        case k when 'sc' then 'registration_number_conflict' when 'rd' then 'name_differs' when 'nc' then 'registration_number_conflict' when 'mc' then 'registration_number_conflict' when 'm' then 'ambiguous_name' end conflict from kk""",
)
def resolve_entity(t):
    k = F.col("ordinal")
    mentions = wanted(t).select(k.alias("mention_id"), "name", "registration", F.when(k % 5 == 0, k).alias("suggested_id"))
    return RS.resolve_entity(t, mentions)


@query(
    "link_evidence",
    """select l.evidence_id, l.entity_id, case when l.evidence_id%3=0 then 'candidate' else l.link_state end link_state, case when l.evidence_id%3=0 then 'alias' else l.match_method end match_method, case when l.evidence_id%3=0 then 0.92::double else l.confidence::double end confidence from links l
       union all select evidence_id, entity_id+1, 'candidate', 'canonical_name', 0.5::double from links where evidence_id%7=0""",
)
def link_evidence(t):
    links = t["evidence_entity_links"]
    again = links.filter(F.col("evidence_id") % 3 == 0).select("evidence_id", "entity_id", F.lit("alias").alias("match_method"), F.lit(0.92).alias("confidence"))
    new = links.filter(F.col("evidence_id") % 7 == 0).select("evidence_id", (F.col("entity_id") + 1).alias("entity_id"), F.lit("canonical_name").alias("match_method"), F.lit(0.5).alias("confidence"))
    return RS.link_evidence(links, again.unionByName(new))


@query(
    "link_included",
    """with nm as (select o_custkey+1 entity_id, 'https://www.firm'||o_custkey||'.example.com/docs/doc-'||o_orderkey||'.pdf' url from orders)
       select distinct e.id evidence_id, nm.entity_id, 'included' link_state from nm join evidence_raw e on e.source_url=nm.url where e.publication_state='published' and not exists (select 1 from links l where l.evidence_id=e.id and l.entity_id=nm.entity_id)""",
)
def link_included(t):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    url = F.concat(F.lit("https://www.firm"), s(c), F.lit(".example.com/docs/doc-"), s(k), F.lit(".pdf"))
    named = t.raw("orders").select((c + 1).alias("entity_id"), url.alias("url"))
    return RS.link_included(t, named)


LOOKUP = "lk as (select id agency_id, lower(replace(name,'the ','')) name_key from verification_agencies union select agency_id, lower(alias) from agency_aliases)"


@query("agency_lookup", f"with {LOOKUP} select * from lk")
def agency_lookup(t):
    return RS.agency_lookup(t)


@query(
    "ensure_agencies",
    f"""with {LOOKUP}, kn as (select name_key, min(agency_id) id from lk group by 1),
        st as (select case o_orderkey%9 when 0 then 'EmpowerLogic (Pty) Ltd' when 2 then 'Verifier '||(o_orderkey%50) when 4 then 'Honeycomb BEE Ratings' when 8 then 'Mosela Rating Agency (Pty) Ltd' end c,
                 case o_orderkey%9 when 0 then 'empowerlogic' when 2 then 'verifier '||(o_orderkey%50) when 4 then 'honeycomb bee ratings' when 8 then 'mosela rating agency' end nk, o_orderkey%9 in (0,4) al from orders)
        select nk name_key, kn.id agency_id, case when kn.id is null then 'agy_'||left(sha256(nk),16) end new_agency_id, c canonical_name, count(*) evidence_count, bool_or(al) new_alias from st left join kn on kn.name_key=nk where c is not null group by 1,2,3,4""",
)
def ensure_agencies(t):
    return RS.ensure_agencies(t, I.agency_texts(t).select(F.col("id").alias("evidence_id"), F.col("raw").alias("name")))


AGENCIES = f"""{LOOKUP}, kn as (select name_key, min(agency_id)::varchar id from lk group by 1),
st0 as (select o_orderkey k, case o_orderkey%9 when 0 then 'EmpowerLogic (Pty) Ltd' when 2 then 'Verifier '||(o_orderkey%50) when 4 then 'Honeycomb BEE Ratings' when 8 then 'Mosela Rating Agency (Pty) Ltd' end c,
   case o_orderkey%9 when 0 then 'empowerlogic' when 2 then 'verifier '||(o_orderkey%50) when 4 then 'honeycomb bee ratings' when 8 then 'mosela rating agency' end nk,
   case o_orderkey%9 when 0 then 'Empower Logic  ratings' when 4 then 'Honeycomb' end alias, case o_orderkey%9 when 0 then 'empower logic ratings' when 4 then 'honeycomb' end rk, case when o_orderkey%9=2 then 'BVA'||lpad((o_orderkey%50)::varchar,3,'0') end num from orders),
st as (select st0.*, coalesce(a.id, b.id) have, coalesce(a.id, b.id, 'agy_'||left(sha256(nk),16)) id from st0 left join kn a on a.name_key=nk left join kn b on b.name_key=coalesce(rk,nk) where c is not null)"""


def stated_agencies(t):
    k = F.col("id")
    number = F.when(k % 9 == 2, F.concat(F.lit("bva "), F.lpad(s(k % 50), 3, "0"))).when(k % 9 == 0, "number 12")
    return I.agency_texts(t).select(k.alias("evidence_id"), F.col("raw").alias("name"), number.alias("number"))


@query("agency_changes_agencies", f"with {AGENCIES} select distinct id, c as name, nk normalized_name, trim(regexp_replace(lower(c),'[^a-z0-9]+','-','g'),'-') slug, 'public' visibility from st where have is null")
def agency_changes_agencies(t):
    return RS.agency_changes(t, stated_agencies(t))["agencies"]


@query("agency_changes_aliases", f"with {AGENCIES} select distinct id agency_id, alias, rk normalized_alias from st where alias is not null and not exists (select 1 from lk where lk.agency_id::varchar=st.id and lk.name_key=st.rk)")
def agency_changes_aliases(t):
    return RS.agency_changes(t, stated_agencies(t))["aliases"]


@query(
    "agency_changes_accreditations",
    f"with {AGENCIES} select id agency_id, 'SANAS' accreditation_body, num accreditation_identifier, 'Identifier stated on certificate' status, min(k) evidence_id from st where num is not null and not exists (select 1 from agency_accreditations x where x.agency_id::varchar=st.id and x.accreditation_identifier=num) group by 1,3",
)
def agency_changes_accreditations(t):
    return RS.agency_changes(t, stated_agencies(t))["accreditations"]


REG_CANDIDATES = """
rc0 as (select s.entity_id, s.registration_number v, 'current_state' via from state s where s.registration_number is not null
  union all select entity_id, value, 'published_claim' from published_claims where field_key='registration_number'
  union all select l.entity_id, coalesce(c.normalized_value,c.raw_value), 'certificate_claim' from claims c join evidence_raw e on e.id=c.evidence_id join links l on l.evidence_id=e.id where c.field_key='registration_number' and e.publication_state='published' and e.evidence_type in ('bee_certificate','sworn_affidavit')),
rc as (select r.entity_id, r.v[:4]||'/'||r.v[5:10]||'/'||r.v[11:] registration, r.via from (select entity_id, regexp_replace(v,'[^0-9]','','g') v, via from rc0) r join live e on e.id=r.entity_id where e.registration_number is null and r.v<>'199500052307')"""


@query("registration_candidates", f"with {REG_CANDIDATES} select * from rc")
def registration_candidates(t):
    return RS.registration_candidates(t)


@query(
    "copy_registrations",
    f"""with {REG_CANDIDATES}, g as (select entity_id, min(registration) lo, max(registration) hi, max(via) filter (where via='current_state') sv, min(via) av from rc group by 1),
        h as (select registration_number_normalized k, min(id) holder from entities where merged_into_id is null and registration_number_normalized is not null group by 1)
        select entity_id, case when lo<>hi then 'conflicting_values' when holder is not null then 'belongs_to_another' else 'copied' end outcome, case when lo=hi and holder is null then lo end registration, coalesce(sv,av) via from g left join h on h.k=replace(lo,'/','')""",
)
def copy_registrations(t):
    return RS.copy_registrations(t, RS.registration_candidates(t))


@query(
    "clear_verifier_registrations",
    "select id, canonical_name, registration_number as before, null::varchar as after from entities where merged_into_id is null and registration_number_normalized='199500052307'",
)
def clear_verifier_registrations(t):
    return RS.clear_verifier_registrations(t)


@query(
    "discover_domains",
    """select entity_id, regexp_extract(source_url,'^(https?://[^/]+)',1) website from (select l.entity_id, e.source_url, row_number() over (partition by l.entity_id order by e.issue_date desc nulls last, e.id desc) rn
        from links l join evidence_raw e on e.id=l.evidence_id join live n on n.id=l.entity_id where n.website is null and e.publication_state='published' and e.evidence_type<>'government_procurement_disclosure') where rn=1""",
)
def discover_domains(t):
    return RS.discover_domains(t)


@query(
    "fill_missing_identity",
    """with it as (select c_custkey id, case c_custkey%3 when 0 then (case when c_custkey%2=0 then '2015/'||lpad((c_custkey%1000000)::varchar,6,'0')||'/07' else '2002/001364/07' end) else '1999/000001/07' end rg,
          case when c_custkey%8=0 then 'https://new'||c_custkey||'.example.com' else 'mailto:x' end st, ' Legal '||c_custkey||' ' lg, case when c_custkey%4=0 then '  ' else 'T'||c_custkey end tr from customer)
       select e.id entity_id, coalesce(e.registration_number, case when it.rg<>'2002/001364/07' and not exists (select 1 from entities x where x.merged_into_id is null and x.registration_number=it.rg and x.id<>e.id) then it.rg end) registration_number,
         coalesce(e.website, case when it.st like 'https:%' then it.st end) website, coalesce(e.legal_name, trim(it.lg)) legal_name, coalesce(e.trading_name, nullif(trim(it.tr),'')) trading_name from entities e join it on it.id=e.id""",
)
def fill_missing_identity(t):
    k = F.col("c_custkey")
    reg = F.when(k % 3 != 0, "1999/000001/07").when(k % 2 == 0, F.concat(F.lit("2015/"), F.lpad(s(k % 1000000), 6, "0"), F.lit("/07"))).otherwise("2002/001364/07")
    items = t.raw("customer").select(
        k.alias("entity_id"),
        reg.alias("registration"),
        F.when(k % 8 == 0, F.concat(F.lit("https://new"), s(k), F.lit(".example.com"))).otherwise("mailto:x").alias("website"),
        F.concat(F.lit(" Legal "), s(k), F.lit(" ")).alias("legal_name"),
        F.when(k % 4 == 0, "  ").otherwise(F.concat(F.lit("T"), s(k))).alias("trading_name"),
    )
    return RS.fill_missing_identity(t, items)


@query(
    "apply_identity_patches",
    f"""with {WANTED}, pn as (select f.*, case f.o%5 when 0 then '2015/'||lpad((f.o%1000000)::varchar,6,'0')||'/07' when 1 then '2002/001364/07' when 2 then 'bad number' when 3 then null else '1991/000001/07' end prg from found f),
        pt as (select p.o, coalesce(x.rid,nid,aid) eid, case when x.rid is not null then 'registration_number' when nid is not null then 'canonical_name' when aid is not null then 'alias' end via, prg rg, case when p.o%2=0 then ne.registration_number end rep
          from pn p left join rx x on x.rk=replace(prg,'/','') left join entities ne on ne.id=coalesce(nid,aid)),
        hs as (select registration_number_normalized k, min(id) holder, count(*) n from um where registration_number_normalized is not null group by 1),
        pj as (select pt.*, e.registration_number old, e.website, replace(rg,'/','') nk, e.registration_number is null or e.registration_number_normalized='199500052307' or coalesce(e.registration_number=rep,false) can from pt left join entities e on e.id=pt.eid),
        pk as (select pj.*, coalesce(h.holder is not null and (h.holder<>eid or h.n>1),false) clash from pj left join hs h on h.k=pj.nk),
        pr as (select *, case when eid is null then 'not_found' when rg is null then null when rg='bad number' then 'invalid_registration_format' when rg='2002/001364/07' then 'verifier_agency_registration' when can and clash then 'registration_belongs_to_another_entity'
           when not can and replace(old,'/','')<>nk then 'existing_registration_preserved' end reason from pk)
        select o ordinal, eid entity_id, via, reason, case when eid is not null and reason is null and rg is not null and can then rg end new_registration, case when eid is not null and website is null then 'https://patch'||o||'.example.com' end new_website from pr""",
)
def apply_identity_patches(t):
    o = F.col("ordinal")
    regs = [F.concat(F.lit("2015/"), F.lpad(s(o % 1000000), 6, "0"), F.lit("/07")), "2002/001364/07", "bad number", F.lit(None).cast("string"), "1991/000001/07"]
    old = t["entities"].select(F.col("id").alias("_e"), F.col("registration_number").alias("_r"))
    named = RS.find_existing_entity(t, wanted(t).withColumn("registration", F.lit(None).cast("string"))).select("ordinal", F.col("entity_id").alias("_e"))
    # Even patches name the number they may replace.
    replace = named.join(old, "_e", "left").select("ordinal", F.when(o % 2 == 0, F.col("_r")).alias("replace_if"))
    new_numbers = wanted(t).select("ordinal", "name", I.pick(regs, o).alias("registration"), F.concat(F.lit("https://patch"), s(o), F.lit(".example.com")).alias("website"))
    return RS.apply_identity_patches(t, new_numbers.join(replace, "ordinal"))


@query(
    "apply_sector_list",
    f"""with {WANTED}, sp as (select coalesce(nid,aid) eid, unnest(['sec_building','sec_jse','sec_none']) sec from found)
        select distinct eid entity_id, sec sector_id from sp where eid is not null and sec='sec_building' and not exists (select 1 from entity_classifications c where c.entity_id=eid and c.sector_id=sec and c.classification_type='sector')""",
)
def apply_sector_list(t):
    items = wanted(t).select("ordinal", "name", F.array(F.lit("sec_building"), F.lit("sec_jse"), F.lit("sec_none")).alias("sectors"))
    return RS.apply_sector_list(t, items)


# --- publication -------------------------------------------------------------
def metadata_claims(t):
    k, d = F.col("o_orderkey"), F.to_date("o_orderdate")
    o = t.raw("orders")

    def rows(where, field, value):
        return o.filter(where).select(k.alias("evidence_id"), F.lit(field).alias("field_key"), value.alias("value"), F.concat(F.lit("raw "), value).alias("raw_value"))

    issue = rows(k % 2 == 0, "issue_date", F.when(k % 4 == 0, F.date_format(d, "yyyy-MM-dd")).otherwise("March 2001"))
    expiry = rows(k % 3 == 0, "expiry_date", F.when(k % 9 == 0, F.date_format(d, "yyyy-MM-dd")).otherwise("2002-02-02"))
    kind = rows(k % 5 == 0, "document_type", F.lit("sworn_affidavit"))
    alt = rows(k % 5 == 1, "certificate_type", F.when(k % 2 == 0, "bee_certificate").otherwise("report"))
    issuer = rows(k % 7 == 0, "verification_agency", F.concat(F.lit("Verifier "), s(k % 10)))
    return issue.unionByName(expiry).unionByName(kind).unionByName(alt).unionByName(issuer)


METADATA = """select id, case when evidence_type in ('government_procurement_disclosure','annual_report','company_webpage') then evidence_type when id%5=0 then 'sworn_affidavit' when id%5=1 and id%2=0 then 'bee_certificate' else evidence_type end evidence_type,
   strftime(case when id%4=0 then discovered_at-3 else issue_date end,'%Y-%m-%d') issue_date, strftime(case when id%3=0 then case when id%9=0 then {same} else date '2002-02-02' end else expiry_date end,'%Y-%m-%d') expiry_date,
   case when id%4=0 then 'raw '||strftime(discovered_at-3,'%Y-%m-%d') when id%2=0 then 'raw March 2001' end issue_date_raw,
   case when id%3=0 then 'raw '||case when id%9=0 then strftime(discovered_at-3,'%Y-%m-%d') else '2002-02-02' end end expiry_date_raw, case when id%7=0 then 'Verifier '||(id%10) else document_issuer end document_issuer from evidence_raw"""


@query("apply_claim_metadata", METADATA.format(same="discovered_at-3"))
def apply_claim_metadata(t):
    return P.apply_claim_metadata(t["evidence_raw"], metadata_claims(t))


@query("apply_claim_metadata_repair", METADATA.format(same="case when id%4=0 then expiry_date else discovered_at-3 end"))
def apply_claim_metadata_repair(t):
    return P.apply_claim_metadata(t["evidence_raw"], metadata_claims(t), repair=True)


def checked(t):
    """Documents as the rules read them; the source of some is gone."""
    live = F.when(F.col("id") % 37 == 0, "missing").otherwise("live")
    return P.checked_evidence(ChainMap({"evidence_raw": t["evidence_raw"].withColumn("source_live_status", live)}, t))


CHECKED = """
copies as (select id, row_number() over (partition by content_hash order by id)>1 dup from evidence_raw),
best as (select evidence_id, entity_id, confidence, link_state from links l join entities e on e.id=l.entity_id where e.merged_into_id is null and link_state in ('confirmed','extracted','candidate')),
wc as (select evidence_id, max(normalized_value) filter (where field_key='bee_level') lev, coalesce(max(normalized_value) filter (where field_key='bee_level'), max(raw_value) filter (where field_key='bee_level')) lev_any,
   coalesce(max(normalized_value) filter (where field_key='registration_number'), max(raw_value) filter (where field_key='registration_number')) reg, max(raw_value) filter (where field_key='verification_agency') ag,
   min(confidence) mc, count(*) filter (where confidence<0.98) lowc from working group by 1),
ck as (select e.id, cp.dup, e.evidence_type, e.issue_date, e.expiry_date, e.mime_type, e.source_domain, w.lev, w.lev_any, w.reg, w.ag, w.mc, coalesce(w.lowc,0) lowc, b.entity_id, b.confidence, b.link_state, n.registration_number_normalized nreg, n.website, n.automation_state,
   s.bee_level slev, s.evidence_id sev, exists (select 1 from verification_agencies va where lower(replace(va.name,'the ',''))=lower(w.ag)) known, coalesce(fo.locked,false) llock
   from evidence_raw e join copies cp on cp.id=e.id left join wc w on w.evidence_id=e.id left join best b on b.evidence_id=e.id left join entities n on n.id=b.entity_id left join state s on s.entity_id=b.entity_id
   left join field_overrides fo on fo.entity_id=b.entity_id and fo.field_key='bee_level' and fo.locked),
fl as (select *, list_filter([case when expiry_date<issue_date then 'expiry_before_issue' end, case when dup then 'duplicate_hash' end, case when reg<>nreg then 'registration_mismatch' end, case when lev<>slev and sev is not null then 'conflicting_level' end, case when lowc>0 then 'low_confidence' end,
   case when ag is not null and not known then 'unknown_verifier' end, case when id%37=0 then 'source_missing' end, case when mime_type='application/zip' then 'unexpected_mime' end, case when evidence_type in ('bee_certificate','sworn_affidavit','annual_report') and lev is null then 'missing_level' end,
   case when llock and lev_any<>slev then 'manual_lock_conflict' end], lambda x: x is not null) flags from ck),
au as (select *, list_contains(flags,'registration_mismatch') or list_contains(flags,'manual_lock_conflict') or list_contains(flags,'expiry_before_issue') err, link_state='candidate' unc,
   coalesce(lower(source_domain)=regexp_replace(lower(split_part(regexp_replace(website,'^https?://',''),'/',1)),'^www\\.',''),false) official from fl)"""


@query("validate_claims", f"with {CHECKED} select id, entity_id, array_to_string(flags,'|') flags from fl")
def validate_claims(t):
    rows = P.validate_claims(checked(t))
    return rows.select("id", "entity_id", F.transform("flags", lambda f: f["code"]).alias("flags"))


RULE = P.AutomationRule(site_enabled=True, enabled=True, minimum_confidence=0.6)


def evaluated(t, rule):
    rows = P.validate_claims(checked(t))
    uncertain = F.coalesce(F.col("match_state") == "candidate", F.lit(False))
    return P.evaluate_automation(rows.withColumn("uncertain", uncertain), rule)


REASONS = """list_filter([case when coalesce(automation_state,'review_only')<>'automation_allowed' then 'Entity automation state is '||coalesce(automation_state,'review_only')||'.' end, case when not official then 'Source is not the official company domain.' end,
   case when evidence_type not in ('bee_certificate','sworn_affidavit','annual_report') then 'Document type is not a recognised primary certificate/report.' end, case when not coalesce(confidence>=0.9 and not unc,false) then 'Entity match is not exact.' end,
   case when mc is null or mc<0.6 then 'Extraction confidence is below 60%.' end, case when list_contains(flags,'expiry_before_issue') then 'Dates failed validation.' end, case when list_contains(flags,'conflicting_level') then 'Conflicts with currently published evidence.' end,
   case when list_contains(flags,'registration_mismatch') then 'Registration number is inconsistent.' end, case when list_contains(flags,'manual_lock_conflict') then 'A locked field would be overwritten.' end, case when err then 'Validation produced errors.' end], lambda x: x is not null)"""


@query("evaluate_automation", f"with {CHECKED} select id, array_to_string({REASONS},'|') reasons from au")
def evaluate_automation(t):
    return evaluated(t, RULE).select("id", "reasons")


@query(
    "route_reviews",
    f"""with {CHECKED}, ev as (select *, len({REASONS})=0 pass, id%10=3 included, id%23=0 failed from au),
      de as (select *, case when failed then 'extraction_failed' when not included and list_contains(flags,'registration_mismatch') then 'registration_number_conflict' when entity_id is null or (not included and unc) then 'uncertain_entity_match'
        when list_contains(flags,'manual_lock_conflict') then 'manual_lock_conflict' when list_contains(flags,'conflicting_level') and not pass then 'conflicting_evidence' when pass then 'auto_published' when list_contains(flags,'low_confidence') then 'low_confidence_extraction' when err then 'invalid_dates' else 'new_evidence' end dec from ev)
      select id evidence_id, entity_id, dec decision, case when dec='auto_published' then null when dec='registration_number_conflict' then 'critical' when dec='uncertain_entity_match' then 'normal' when dec in ('extraction_failed','manual_lock_conflict','conflicting_evidence') or err then 'high' else 'normal' end severity from de""",
)
def route_reviews(t):
    rows = evaluated(t, RULE).withColumns(
        {"conflict": F.lit(None).cast("string"), "included": F.col("id") % 10 == 3, "extraction_failed": F.col("id") % 23 == 0}
    )
    return P.route_reviews(rows)


@query(
    "open_review_once",
    """select 'new_evidence' as type, id evidence_id from evidence_raw e where not exists (select 1 from review_items r where r.status='pending' and r.type='new_evidence' and r.evidence_id=e.id)""",
)
def open_review_once(t):
    one = t["evidence_raw"].select(F.lit("new_evidence").alias("type"), F.col("id").alias("evidence_id"))
    return P.open_review_once(t["review_items"], one.unionByName(one))


@query(
    "lock_overrides",
    """select p.entity_id, p.field_key, coalesce(l.value, p.value) as value, l.entity_id is not null locked, coalesce(l.value<>p.value,false) conflict from published_claims p left join field_overrides l on l.locked and l.entity_id=p.entity_id and l.field_key=p.field_key""",
)
def lock_overrides(t):
    return P.lock_overrides(t["published_claims"].select("entity_id", "field_key", "value"), t["field_overrides"])


def dated(t):
    """The tables, with dates among the claims of the newest runs: days, other text, and none."""
    k, found = F.col("evidence_id"), F.col("discovered_at")
    newest = latest_successful_run(t["extraction_runs"]).select("evidence_id", "extraction_run_id")
    rows = newest.join(t["evidence_raw"].select(F.col("id").alias("evidence_id"), "discovered_at"), "evidence_id")
    issue = F.when(k % 15 == 0, "day unknown").otherwise(F.date_format(F.date_sub(found, 40), "yyyy-MM-dd"))
    expiry = F.date_format(F.date_add(found, (k % 900).cast("int")), "yyyy-MM-dd")

    def claim(where, field, value):
        return rows.filter(where).select(
            F.concat_ws("-", "extraction_run_id", F.lit(field)).alias("id"), "evidence_id", "extraction_run_id", F.lit(field).alias("field_key"), value.alias("raw_value"), value.alias("normalized_value"), F.lit("unpublished").alias("published_state")
        )

    more = claim(k % 3 == 0, "issue_date", issue).unionByName(claim(k % 5 < 2, "expiry_date", expiry))
    return ChainMap({"extracted_claims": t["extracted_claims"].unionByName(more, allowMissingColumns=True)}, t)


def approved(t):
    """Documents a reviewer approves: every fourth, for its linked company; some from a review, open or not."""
    k = F.col("evidence_id")
    item = F.when((k % 3 == 0) | (k % 21 == 1), k).when(k % 33 == 5, -k).when(k % 33 == 10, k - 1)
    return t["evidence_entity_links"].filter(k % 4 == 1).select("evidence_id", "entity_id", item.alias("review_item_id"))


@lru_cache(maxsize=16)
def publication_folder(app: str, spark, sf_dir: str) -> str:
    return shared_folder(spark, "publication")


def published(t, table, **options):
    """A table of the publication; its decisions are staged once for a session and folder."""
    tables = dated(t)
    stage = publication_folder(t.spark.sparkContext.applicationId, t.spark, t.dir)
    return P.publish_batch(tables, approved(tables), CLOCK, stage=stage, **options)[table]


CERTS = "('bee_certificate','sworn_affidavit')"
APPROVED = f"""
dc as (select r.evidence_id, r.run_id||'-issue_date' id, 'issue_date' field_key, case when r.evidence_id%15=0 then 'day unknown' else strftime(e.discovered_at-40,'%Y-%m-%d') end as value from latest_run r join evidence_raw e on e.id=r.evidence_id where r.evidence_id%3=0
   union all select r.evidence_id, r.run_id||'-expiry_date', 'expiry_date', strftime(e.discovered_at+(r.evidence_id%900)::int,'%Y-%m-%d') from latest_run r join evidence_raw e on e.id=r.evidence_id where r.evidence_id%5<2),
wk as (select evidence_id, id, field_key, value, published_state from working union all select *, 'unpublished' from dc),
rq as (select l.evidence_id, l.entity_id, case when l.evidence_id%3=0 or l.evidence_id%21=1 then l.evidence_id when l.evidence_id%33=5 then -l.evidence_id when l.evidence_id%33=10 then l.evidence_id-1 end item from links l where l.evidence_id%4=1),
er as (select q.*, case when item is not null and r.id is null then 'Review item no longer exists.' when item is not null and r.status not in ('pending','in_review') then 'Review item is no longer open.'
   when item is not null and r.evidence_id<>q.evidence_id then 'Review item is attached to different evidence.' when n.id is null then 'Entity not found.' when n.merged_into_id is not null then 'This entity was merged. Publish against the surviving record.'
   when e.id is null then 'Evidence not found.' end as error from rq q left join review_items r on r.id=q.item left join entities n on n.id=q.entity_id left join evidence_raw e on e.id=q.evidence_id),
ap as (select l.evidence_id, l.entity_id, l.item, e.evidence_type, n.visibility, n.registration_number_normalized nreg,
   case when e.evidence_type in {CERTS} then coalesce(try_cast(di.value as date), e.issue_date) else coalesce(e.issue_date, try_cast(di.value as date)) end issue_date,
   case when e.evidence_type in {CERTS} then coalesce(try_cast(dx.value as date), e.expiry_date) end expiry_date
   from er l join entities n on n.id=l.entity_id join evidence_raw e on e.id=l.evidence_id left join dc di on di.evidence_id=l.evidence_id and di.field_key='issue_date' left join dc dx on dx.evidence_id=l.evidence_id and dx.field_key='expiry_date' where l.error is null),
ac as (select a.entity_id, a.evidence_id, w.id, w.field_key, w.value, coalesce(fo.locked and coalesce(fo.value, case w.field_key when 'bee_level' then s.bee_level end)<>w.value, false) blocked from ap a join wk w on w.evidence_id=a.evidence_id
   left join state s on s.entity_id=a.entity_id left join field_overrides fo on fo.locked and fo.entity_id=a.entity_id and fo.field_key=w.field_key
   where a.evidence_type in {CERTS} and trim(w.value)<>'' and not (w.field_key='registration_number' and coalesce(regexp_replace(lower(w.value),'[^a-z0-9]','','g')<>a.nreg,false))),
sp as (select * from (select a.entity_id, s.evidence_id previous_id, p.issue_date pi, p.expiry_date pe, max(a.evidence_id) filter (where rn=1) nid, max(a.issue_date) filter (where rn=1) ni, bool_or(a.issue_date is null) und
   from (select *, row_number() over (partition by entity_id order by issue_date desc nulls last, evidence_id desc) rn from ap where evidence_type in {CERTS}) a join state s on s.entity_id=a.entity_id join evidence_raw p on p.id=s.evidence_id group by 1,2,3,4)
   where previous_id<>nid and (pi is null or und or ni>=pi))"""


@query("supersede_previous", f"with {APPROVED} select entity_id, previous_id evidence_id, nid replaced_by, case when pe<date '2001-01-01' then 'expired' else 'superseded' end lifecycle_state from sp")
def supersede_previous(t):
    return published(t, "superseded")


@query(
    "upsert_published_claims",
    f"""with {APPROVED}, u as (select entity_id, field_key, 0 p, evidence_id, value from published_claims union all select entity_id, field_key, 1, evidence_id, value from ac where not blocked)
        select entity_id, field_key, value, evidence_id, p=1 changed from (select *, row_number() over (partition by entity_id, field_key order by p desc, evidence_id desc) rn from u) where rn=1""",
)
def upsert_published_claims(t):
    return published(t, "published_claims")


@query(
    "publish_batch",
    f"""with {APPROVED} select a.evidence_id id, 'published' publication_state, 'approved' review_state, case when evidence_type in {CERTS} then case when expiry_date is null then 'unknown_validity' when expiry_date<date '2001-01-01' then 'expired' when expiry_date<=date '2001-01-01'+90 then 'expiring_soon' else 'current' end else 'historical' end lifecycle_state,
        strftime(issue_date,'%Y-%m-%d') issue_date, strftime(expiry_date,'%Y-%m-%d') expiry_date from ap a""",
)
def publish_batch(t):
    return published(t, "evidence")


@query(
    "publish_batch_events",
    f"""with {APPROVED}, kept as (select evidence_id, string_agg(field_key, ', ' order by field_key) k from ac where blocked group by 1)
        select a.entity_id, a.evidence_id, 'published' event_type, case when a.evidence_type not in {CERTS} then 'Published official procurement disclosure '||a.evidence_id||coalesce(' (reported B-BBEE level '||w.value||')','')||'. This is not a current verification certificate.'
            when c.value is not null then 'Published B-BBEE level '||c.value||' from evidence '||a.evidence_id else 'Published evidence '||a.evidence_id end || coalesce(' (locked fields preserved: '||kept.k||')','') summary, sp.previous_id previous_evidence_id, 'reviewer' published_by
        from ap a left join working w on w.evidence_id=a.evidence_id and w.field_key='bee_level' and trim(w.value)<>'' left join ac c on c.evidence_id=a.evidence_id and c.field_key='bee_level' and not c.blocked left join kept on kept.evidence_id=a.evidence_id left join sp on sp.nid=a.evidence_id""",
)
def publish_batch_events(t):
    return published(t, "events")


@query(
    "publish_batch_claim_states",
    f"""with {APPROVED}, c as (select id, evidence_id, true as fresh from ac where not blocked union all select id, evidence_id, false from claims where published_state='published' and evidence_id in (select previous_id from sp))
        select id claim_id, evidence_id, case when evidence_id in (select previous_id from sp) then 'superseded' else 'published' end published_state, case when bool_or(fresh) then 'approved' end review_state from c group by id, evidence_id""",
)
def publish_batch_claim_states(t):
    return published(t, "claim_states")


@query("publish_batch_reviews", f"with {APPROVED} select distinct item id, 'approved' status, 'reviewer' reviewer_id, 'Approved and published.' resolution from ap where item is not null")
def publish_batch_reviews(t):
    return published(t, "reviews")


@query("publish_batch_refused", f"with {APPROVED} select evidence_id, entity_id, error from er where error is not null")
def publish_batch_refused(t):
    return published(t, "refused")


@query(
    "publish_batch_audit",
    f"""with {APPROVED}, g as (select evidence_id, string_agg(field_key||'='||value, '|' order by field_key||'='||value) filter (where not blocked) f, string_agg(field_key, '|' order by field_key) filter (where blocked) b from ac group by 1)
        select 'rule' actor_id, 'evidence.auto_published' as action, 'evidence' target_type, evidence_id::varchar target_id, entity_id, coalesce(f,'') fields, coalesce(b,'') skipped_locked, 3::bigint rule_version, 'All gates passed.' reason from ap left join g using (evidence_id)""",
)
def publish_batch_audit(t):
    return published(t, "audit", rule_version=3, actor="rule", reason="All gates passed.")


def repair_inputs(t):
    k = F.col("o_orderkey")
    o = t.raw("orders")
    fields = ["bee_level", "registration_number", "issue_date", "measured_entity", "expiry_date"]
    old = [s(1 + k % 8), F.lit("199100000107"), F.lit("2020-01-01"), F.lit("This certificate has been issued"), F.lit("2020-01-01")]
    new = [s(1 + k % 4), F.when(k % 2 == 0, "199100000107").otherwise("199200000207"), F.lit("2020-05-05"), F.lit("Heron Works Ltd"), F.lit("2021-01-01")]
    previous = o.filter(k % 11 != 0).select(k.alias("evidence_id"), I.pick(fields, k).alias("field_key"), I.pick(old, k).alias("value"), (k % 13 == 0).alias("edited"))
    extracted = o.filter(k % 7 != 0).select(k.alias("evidence_id"), I.pick(fields, k).alias("field_key"), I.pick(new, k).alias("new_value"))
    context = o.select(
        k.alias("evidence_id"),
        (F.col("o_orderstatus") != "P").alias("published"),
        F.when(k % 3 == 0, "199100000107").when(k % 3 == 1, "199300000307").alias("entity_reg"),
        F.when(k % 17 == 0, F.array(F.lit("bee_level"))).alias("locked_fields"),
        F.lit("Heron Works").alias("linked_name"),
    )
    return previous, extracted, context


REPAIR = """
rp0 as (select o_orderkey k, o_orderkey%5 f, o_orderkey%11<>0 hp, o_orderkey%7<>0 hn, o_orderkey%13=0 ed, o_orderstatus<>'P' pub, case o_orderkey%3 when 0 then '199100000107' when 1 then '199300000307' end reg, o_orderkey%17=0 lk,
   case when o_orderkey%11<>0 then [(1+o_orderkey%8)::varchar,'199100000107','2020-01-01','This certificate has been issued','2020-01-01'][o_orderkey%5+1] end v,
   case when o_orderkey%7<>0 then [(1+o_orderkey%4)::varchar, case when o_orderkey%2=0 then '199100000107' else '199200000207' end,'2020-05-05','Heron Works Ltd','2021-01-01'][o_orderkey%5+1] end nv from orders where o_orderkey%11<>0 or o_orderkey%7<>0),
rp1 as (select *, case when f<>3 then v end old, nv as new from rp0),
rp as (select *, case when lk and f=0 and hp then 'locked' when hp and ed then 'edited' when f=1 and reg is not null and new=reg then 'own_number' when f=1 and reg is not null and old=reg then 'kept_number' when f=1 and reg is not null and new<>reg then 'foreign_number'
   when not pub and f in (2,4) and new is not null then 'draft_date' when old<>new then 'conflict' when new is not null and old is null then 'filled' when old is not null then 'kept' else 'dropped' end step from rp1)"""
REPAIR_FIELD = "['bee_level','registration_number','issue_date','measured_entity','expiry_date'][f+1]"


@query(
    "merge_repair_claims",
    f"""with {REPAIR} select k evidence_id, {REPAIR_FIELD} field_key, step, case when step in ('own_number','foreign_number','draft_date','filled') then nv when step<>'dropped' then v end as value,
        step in ('conflict','foreign_number') or (step='locked' and coalesce(v<>nv,false)) or (step='kept_number' and coalesce(old<>new,false)) conflict from rp""",
)
def merge_repair_claims(t):
    return P.merge_repair_claims(*repair_inputs(t))


@query("sanitize_claims", f"with {REPAIR} select k evidence_id, {REPAIR_FIELD} field_key, pub opens_review from rp where step='dropped'")
def sanitize_claims(t):
    return P.sanitize_claims(*repair_inputs(t))


SANITIZED = f"""{REPAIR},
sn as (select k, pub, {REPAIR_FIELD} field_key, case when f=3 and not ed then case when hn then nv end else v end as value from rp0 where hp)"""


def sanitized(t, table):
    return P.sanitized_runs(t, *repair_inputs(t))[table]


@query(
    "sanitize_runs",
    f"with {SANITIZED} select 'sanitize/v1-'||o_orderkey id, o_orderkey evidence_id, 'sanitize/v1' parser, true success, case when sn.k is not null and sn.value is null then 'Suppressed invalid measured_entity.' else '' end warnings from orders left join sn on sn.k=o_orderkey",
)
def sanitize_runs(t):
    return sanitized(t, "extraction_runs")


@query("sanitize_run_claims", f"with {SANITIZED} select 'sanitize/v1-'||k||'-'||field_key id, 'sanitize/v1-'||k extraction_run_id, k evidence_id, field_key, value raw_value from sn where value is not null")
def sanitize_run_claims(t):
    return sanitized(t, "extracted_claims")


@query(
    "sanitize_reviews",
    f"""with {SANITIZED} select 'invalid_extracted_claim' as type, 'Malformed extracted measured_entity was suppressed and not shown as a published fact.' reason, 'normal' severity, k evidence_id from sn
        where value is null and pub and not exists (select 1 from review_items r where r.status='pending' and r.type='invalid_extracted_claim' and r.evidence_id=k)""",
)
def sanitize_reviews(t):
    return sanitized(t, "review_items")


@query("pending_repairs", "select id, strftime(created_at,'%Y-%m-%d') created_at from evidence_raw e where not exists (select 1 from runs r where r.evidence_id=e.id and r.parser='repair/v1' and r.success)")
def pending_repairs(t):
    return P.pending_repairs(t, "repair/v1")


@query("reset_runs", "select id, field_key, extraction_run_id from claims c where not exists (select 1 from runs r where r.id=c.extraction_run_id and r.parser='repair/v1')")
def reset_runs(t):
    return P.reset_runs(t, "repair/v1")["extracted_claims"].select("id", "field_key", "extraction_run_id")


@query("cleanup_agencies", "select id, case when verifier_agency_id%9=4 then null else verifier_agency_id end verifier_agency_id from evidence_raw".replace("verifier_agency_id%9=4", "false"))
def cleanup_agencies(t):
    return P.cleanup_agencies(t)["evidence"].select("id", "verifier_agency_id")


# --- merging and maintenance -------------------------------------------------
def mapping(t):
    return M.merge_duplicates(t).filter(F.col("outcome") == "merge").select("absorbed_id", "survivor_id")


DUPLICATES = """
dr as (select e.*, (select count(*) from links l where l.entity_id=e.id) nl from entities e where merged_into_id is null),
dg as (select normalized_name, min(registration_number_normalized) lo, max(registration_number_normalized) hi from dr group by 1 having count(*)=2),
dk as (select dr.*, dg.lo, dg.hi, row_number() over (partition by dr.normalized_name order by visibility='public' desc, registration_number is not null desc, nl desc, id) rn from dr join dg on dg.normalized_name=dr.normalized_name),
dm as (select normalized_name, max(id) filter (where rn=1) survivor_id, max(id) filter (where rn=2) absorbed_id, case when coalesce(max(lo)<>max(hi),false) then 'registration_conflict' else 'merge' end outcome from dk group by 1),
mp as (select survivor_id, absorbed_id from dm where outcome='merge')"""


@query("merge_duplicates", f"with {DUPLICATES} select * from dm")
def merge_duplicates(t):
    return M.merge_duplicates(t)


def merged(name):
    return lambda t: M.merge_entities(t, mapping(t))[name]


query(
    "merge_entities",
    f"with {DUPLICATES} select e.id, case when a.absorbed_id is not null then 'hidden' else e.visibility end visibility, coalesce(a.survivor_id, e.merged_into_id) merged_into_id, coalesce(e.registration_number, g.registration_number) registration_number from entities e left join mp a on a.absorbed_id=e.id left join mp b on b.survivor_id=e.id left join entities g on g.id=b.absorbed_id",
)(merged("entities"))
query(
    "merge_entities_aliases",
    f"""with {DUPLICATES}, x as (select coalesce(m.survivor_id, a.entity_id) entity_id, normalized_alias, alias, alias_type, m.survivor_id is null own from entity_aliases a left join mp m on m.absorbed_id=a.entity_id
         union all select m.survivor_id, e.normalized_name, e.canonical_name, 'former', true from mp m join entities e on e.id=m.absorbed_id)
       select entity_id, normalized_alias, alias, alias_type from (select *, row_number() over (partition by entity_id, normalized_alias order by own desc, alias desc, alias_type desc) rn from x) where rn=1""",
)(merged("entity_aliases"))
query(
    "merge_entities_relationships",
    f"""with {DUPLICATES} select distinct coalesce(a.survivor_id, source_entity_id) source_entity_id, coalesce(b.survivor_id, target_entity_id) target_entity_id, relationship_type from entity_relationships r left join mp a on a.absorbed_id=r.source_entity_id left join mp b on b.absorbed_id=r.target_entity_id
        where coalesce(a.survivor_id, source_entity_id)<>coalesce(b.survivor_id, target_entity_id)""",
)(merged("entity_relationships"))
query(
    "merge_entities_classifications",
    f"""with {DUPLICATES}, x as (select coalesce(m.survivor_id, a.entity_id) entity_id, sector_id, classification_type, is_public, m.survivor_id is null own from entity_classifications a left join mp m on m.absorbed_id=a.entity_id)
       select entity_id, sector_id, classification_type, is_public from (select *, row_number() over (partition by entity_id, sector_id, classification_type order by own desc, is_public desc) rn from x) where rn=1""",
)(merged("entity_classifications"))
query(
    "merge_entities_links",
    f"with {DUPLICATES} select evidence_id, coalesce(m.survivor_id, l.entity_id) entity_id, link_state, match_method from links l left join mp m on m.absorbed_id=l.entity_id",
)(merged("evidence_entity_links"))
query(
    "merge_entities_claims",
    f"""with {DUPLICATES}, x as (select coalesce(m.survivor_id, a.entity_id) entity_id, field_key, value, evidence_id, m.survivor_id is null own from published_claims a left join mp m on m.absorbed_id=a.entity_id)
       select entity_id, field_key, value, evidence_id from (select *, row_number() over (partition by entity_id, field_key order by own desc) rn from x) where rn=1""",
)(merged("published_claims"))
query(
    "merge_entities_reviews",
    f"with {DUPLICATES} select r.id, coalesce(m.survivor_id, r.entity_id) entity_id, r.type, r.status from review_items r left join mp m on m.absorbed_id=r.entity_id",
)(merged("review_items"))


@query("unmerge_entities", "select id, case when merged_into_id is not null and id%2=0 then 'draft' else visibility end visibility, case when id%2=0 then null else merged_into_id end merged_into_id from entities")
def unmerge_entities(t):
    back = t["entities"].filter(F.col("merged_into_id").isNotNull() & (F.col("id") % 2 == 0)).select(F.col("id").alias("absorbed_id"))
    return M.unmerge_entities(t["entities"], back)


BASE_SECTOR = "['','sec_construction','sec_engineering','sec_security','sec_banking','sec_logistics','sec_food','sec_healthcare','','sec_legal','sec_professional','sec_energy'][(n.base%12)::int+1]"


@query(
    "assign_sectors",
    f"""select e.id entity_id, {BASE_SECTOR} sector_id from live e join named_customers n on n.k=e.id where {BASE_SECTOR}<>'' and not exists (select 1 from entity_classifications c where c.entity_id=e.id and c.is_public and c.classification_type='sector' and c.sector_id not in ('sec_jse','sec_government_suppliers'))""",
)
def assign_sectors(t):
    return M.assign_sectors(t)


@query("move_attributes", "select entity_id, sector_id, case when sector_id='sec_government_suppliers' then 'attribute' else classification_type end classification_type, is_public from entity_classifications")
def move_attributes(t):
    return M.move_attributes(t["entity_classifications"])


@query(
    "close_reviews",
    """select * from (select r.id, r.type, 'approved' status, case when r.type='new_evidence' and e.publication_state='published' then 'Evidence already published; leftover new_evidence review closed.'
        when r.type='extraction_failed' and exists (select 1 from runs x where x.evidence_id=r.evidence_id and x.success) then 'A later extraction run succeeded for this evidence.'
        when r.type='invalid_extracted_claim' and reason like '%suppressed and not shown%' then 'Malformed extracted claim was already suppressed and not published.'
        when r.type='conflicting_evidence' and r.reason not like '%bee_level%' then 'Repair already kept the stored claim; the incoming extract was not applied. Leftover conflict review closed.' end resolution
       from review_items r left join evidence_raw e on e.id=r.evidence_id where r.status='pending') where resolution is not null""",
)
def close_reviews(t):
    return M.close_reviews(t)


@query(
    "retry_candidates",
    """select e.id evidence_id, strftime(e.created_at,'%Y-%m-%d') created_at, l.entity_id from evidence_raw e join links l on l.evidence_id=e.id join entities n on n.id=l.entity_id where n.merged_into_id is null and e.publication_state='unpublished'
       and not exists (select 1 from review_items r where r.evidence_id=e.id and r.status='pending' and r.type in ('registration_number_conflict','conflicting_evidence','manual_lock_conflict')) order by e.created_at, e.id limit 8""",
)
def retry_candidates(t):
    return M.retry_candidates(t)


@query(
    "missing_sources",
    """select id entity_id, case when website like 'http%' then website else 'https://'||website end url, dom as domain, 'monthly' frequency from (select *, regexp_replace(lower(split_part(regexp_replace(website,'^https?://',''),'/',1)),'^www\\.','') dom from live where website is not null) e
       where not exists (select 1 from sources x where x.entity_id=e.id and x.domain=e.dom)""",
)
def missing_sources(t):
    return M.missing_sources(t)


@query(
    "verifier_gaps",
    """select l.entity_id, min(e.id) evidence_id, 'verifier_mismatch' as type from links l join evidence_raw e on e.id=l.evidence_id join entities n on n.id=l.entity_id where n.merged_into_id is null and e.publication_state='published'
       and e.evidence_type in ('bee_certificate','sworn_affidavit') and e.verifier_agency_id is null group by 1""",
)
def verifier_gaps(t):
    return M.verifier_gaps(t)


@query("hide_named", "select id, canonical_name, 'hidden' visibility from live where lower(canonical_name) in (select lower('Firm '||c_custkey||' Trading Ltd') from customer)")
def hide_named(t):
    names = t.raw("customer").select(F.concat(F.lit(" FIRM "), s(F.col("c_custkey")), F.lit(" Trading Ltd ")).alias("name"))
    return M.hide_named(t, names)


@query(
    "republish_eligible",
    """select id, canonical_name, case when not exists (select 1 from vis v where v.entity_id=e.id) then 'no published evidence' when regexp_matches(lower(canonical_name),'firm [0-9]+ trading') then 'malformed name' end reason,
        case when exists (select 1 from vis v where v.entity_id=e.id) and not regexp_matches(lower(canonical_name),'firm [0-9]+ trading') then 'public' else 'hidden' end visibility from entities e where visibility='hidden' and merged_into_id is null""".replace("regexp_matches(lower(canonical_name),'firm [0-9]+ trading')", "false"),
)
def republish_eligible(t):
    return M.republish_eligible(t)


def disclosures(t):
    from attestor.operators.documents import disclosure_identity

    k = F.col("o_orderkey")
    rows = t.raw("orders").select(
        k.alias("ordinal"),
        F.col("o_custkey").alias("entity_id"),
        F.concat(F.lit("https://t.example.org/"), s(k % 60)).alias("source_url"),
        F.when(k % 2 == 0, F.concat(F.lit("T"), s(k % 4))).alias("tender_number"),
        F.concat(F.lit("Kestrel "), s(k % 5)).alias("canonical_name"),
        F.lit("Level 2").alias("bee_level_raw"),
        F.lit("2").alias("bee_level"),
        F.when(k % 4 != 0, "2025-03").alias("evidence_date"),
        F.lit("Council").alias("institution"),
        F.lit("eme").alias("enterprise_class"),
        F.lit(" ").alias("tender_description"),
        F.lit(None).cast("string").alias("contract_period"),
        F.lit("R 5").alias("contract_amount"),
        F.lit("awarded").alias("outcome"),
    )
    return disclosure_identity(rows)


_NOTE = "Official government procurement disclosure. The B-BBEE level is exactly as reported in the source for this dated procurement. This is not a current verification certificate. No certificate number, expiry date or verification agency is inferred. "

DISCLOSED = """
dx as (select *, sha256('gpd:v1|https://t.example.org/'||(k%60)||'|'||coalesce(case when k%2=0 then 't'||(k%4) end,'')||'|kestrel '||(k%5)||'|2|'||coalesce(case when k%4<>0 then '2025-03' end,'')) h from orders_d),
dn as (select *, 'evd_'||left(h,24) evidence_id from (select *, row_number() over (partition by h order by k) rn from dx) where rn=1 and h not in (select h from dx where k%45=0))"""


@query(
    "disclosure_to_evidence",
    f"with {DISCLOSED} select evidence_id, h identity_hash, 'Kestrel '||(k%5)||' — Level 2 reported in Council'||coalesce(case when k%2=0 then ' T'||(k%4) end,'') title, 'https://t.example.org/'||(k%60) source_url, case when k%4<>0 then '2025-03' end issue_date, 'Council' institution, '{_NOTE}The named supplier was recorded in an official awarded-tender or bidder-result publication.' public_notes from dn",
)
def disclosure_to_evidence(t):
    rows = disclosures(t)
    stored = rows.filter(F.col("ordinal") % 45 == 0).select(F.col("identity_hash").alias("content_hash"))
    return M.disclosure_to_evidence(rows, stored)["evidence"]


@query("disclosure_to_evidence_locations", f"with {DISCLOSED} select evidence_id, 'https://t.example.org/'||(k%60) url from dn")
def disclosure_to_evidence_locations(t):
    rows = disclosures(t)
    stored = rows.filter(F.col("ordinal") % 45 == 0).select(F.col("identity_hash").alias("content_hash"))
    return M.disclosure_to_evidence(rows, stored)["locations"]


@query(
    "disclosure_to_evidence_claims",
    f"""with {DISCLOSED} select evidence_id, x.f field_key, x.r raw_value, x.n normalized_value from (select evidence_id, unnest([{{'f':'document_type','r':'government_procurement_disclosure','n':'government_procurement_disclosure'}},{{'f':'measured_entity','r':'Kestrel '||(k%5),'n':'Kestrel '||(k%5)}},{{'f':'legal_entity_name','r':'Kestrel '||(k%5),'n':'Kestrel '||(k%5)}},
         {{'f':'bee_level','r':'Level 2','n':'2'}},{{'f':'issue_date','r':case when k%4<>0 then '2025-03' end,'n':'2025-03'}},{{'f':'tender_number','r':case when k%2=0 then 'T'||(k%4) end,'n':'T'||(k%4)}},{{'f':'government_institution','r':'Council','n':'Council'}},{{'f':'enterprise_class','r':'eme','n':'EME'}},
         {{'f':'contract_amount','r':'R 5','n':'R 5'}},{{'f':'procurement_outcome','r':'awarded','n':'awarded'}}]) x from dn) where x.r is not null""",
)
def disclosure_to_evidence_claims(t):
    rows = disclosures(t)
    stored = rows.filter(F.col("ordinal") % 45 == 0).select(F.col("identity_hash").alias("content_hash"))
    return M.disclosure_to_evidence(rows, stored)["claims"]


@query(
    "import_corpus",
    """with it as (select k, case k%10 when 0 then 'Kestrel '||k||' Builders (Pty) Ltd' when 1 then 'Kestrel '||k when 2 then 'Kestrel '||k||' (Pty) Ltd' when 3 then '''Quoted'' Works '||k||' Ltd' when 4 then 'Kestrel '||k||' JV Heron '||k when 5 then 'tion Services' when 6 then 'Thandi Mokoena' when 7 then 'Various' when 8 then 'Kestrel Engineering Services '||k||' Incorporated' else 'GWK Limited' end nm from (select c_custkey k from customer))
       select k ordinal, nm as name, case when k%10 in (4,5,7) or (k%10=9 and k%20<>9) or k%4=0 and k%3<>0 and k%10<>6 or (k%4=0 and k%3<>0) then 'held' else 'created' end outcome,
         case when k%10=4 then 'joint_venture' when k%10 in (5,7) or (k%10=9 and k%20<>9) then 'malformed' when k%4=0 and k%3<>0 then 'old_procurement' end held_reason, null::bigint entity_id, null::varchar via from it""",
)
def import_corpus(t):
    k = F.col("id")
    items = I.supplier_texts(t).select(
        k.alias("ordinal"), F.col("raw").alias("canonical_name"), "registration", (k % 3 == 0).alias("has_evidence"), F.when(k % 4 == 0, 2019).when(k % 4 == 1, 2025).alias("newest_year")
    )
    return M.import_corpus(t, items)


# --- a batch of identity patches -----------------------------------------------
@lru_cache(maxsize=4)
def _patched(app: str, spark, sf_dir: str):
    return PT.apply_batch(Tables(spark, sf_dir, CLOCK), I.identity_patches(Tables(spark, sf_dir, CLOCK)))


def patched(t, table):
    """A table of the batch; the batch is worked out once for a session and folder."""
    return _patched(t.spark.sparkContext.applicationId, t.spark, t.dir)[table]


# The loop over the patches, one step per ordinal; ev holds the numbers set so far, al the aliases added.
SERIAL = """recursive um as (select * from entities where merged_into_id is null),
rx as (select registration_number_normalized rk, list(id::varchar) hl from um where registration_number_normalized is not null group by 1),
nx as (select normalized_name nk, min(id::varchar) nid from um group by 1),
ax as (select a.normalized_alias nk, min(a.entity_id::varchar) aid from entity_aliases a join um on um.id=a.entity_id group by 1),
p0 as (select row_number() over (order by id) n, id o, id//4 g, id%4 q, '2016'||lpad((700000+id//4)::varchar,6,'0')||'07' n6, '2017'||lpad((700000+id//4)::varchar,6,'0')||'07' n7, normalized_name nn from um),
p1 as (select *, case when q=2 then 'kite '||g when g%9=8 then 'nobody '||o else nn end nk, case when q=2 then n7 when q=3 and g%5=0 then 'badnumber' when q=0 and g%7=6 then '199500052307' when q=3 and g%5=1 then null else n6 end rk, case when q=2 and g%2=0 then n6 end rep from p0),
pa as (select p1.*, coalesce(hl,[]) hl, nid, aid from p1 left join rx using (rk) left join nx using (nk) left join ax using (nk)),
one as (select map(list(id::varchar), list(registration_number_normalized)) sm from um),
lp as (
  select 0::bigint n, null::bigint o, null::varchar e, null::varchar via, null::varchar reason, null::varchar new, []::struct(i varchar, r varchar)[] ev, []::struct(i varchar, a varchar)[] al
  union all
  select n, o, e, via, reason, new, case when new is null then ev else list_append(ev, {'i':e,'r':new}) end, case when q=1 and e is not null then list_append(al, {'i':e,'a':'kite '||g}) else al end
  from (select *, case when e is not null and rk is not null and reason is null and can then rk end new
  from (select *, case when e is null then 'not_found' when rk is null then null when rk='badnumber' then 'invalid_registration_format' when rk='199500052307' then 'verifier_agency_registration'
      when can and len(list_filter(h, lambda x: x<>e))>0 then 'registration_belongs_to_another_entity' when not can and old<>rk then 'existing_registration_preserved' end reason
  from (select *, old is null or old='199500052307' or coalesce(old=rep,false) can
  from (select *, coalesce(list_filter(ev, lambda x: x.i=e)[-1].r, map_extract(sm, e)[1]) old
  from (select *, coalesce(list_min(h), nid, aid, ba) e, case when len(h)>0 then 'registration_number' when nid is not null then 'canonical_name' when coalesce(aid,ba) is not null then 'alias' end via
  from (select *, list_concat(list_filter(hl, lambda i: len(list_filter(ev, lambda x: x.i=i))=0), list_transform(list_filter(ev, lambda x: x.r=rk and list_filter(ev, lambda y: y.i=x.i)[-1].r=rk), lambda x: x.i)) h, list_min(list_transform(list_filter(al, lambda x: x.a=nk), lambda x: x.i)) ba
  from (select pa.*, lp.ev, lp.al, one.sm from lp join pa on pa.n=lp.n+1 cross join one)))))))),
rs as (select lp.*, pa.g, pa.q, pa.nk from lp join pa using (n)),
fo as (select e, 'website' f, 'https://patch'||o||'.example.com' v, o from rs union all select e, 'legal_name', 'Kite '||g||' Legal '||q, o from rs where q>0 union all select e, 'trading_name', 'Trade '||o, o from rs where q=1),
ff as (select e, f, min(o) o, arg_min(v, o) v from fo join entities x on x.id::varchar=e where case f when 'website' then website when 'legal_name' then legal_name else trading_name end is null group by 1,2
  union all select e, 'registration_number', o, new[1:4]||'/'||new[5:10]||'/'||new[11:12] from rs where new is not null),
pr as (select rs.*, coalesce(nx.nid, ax.aid, (select min(b.e) from rs b where b.q=1 and b.e is not null and b.g=rs.g and b.o<rs.o)) par from rs left join nx on nx.nk='kite '||g left join ax on ax.nk='kite '||g where q<>1 and e is not null),
pe as (select e, par, min(o) o, any_value(g) g from pr where par<>e and not exists (select 1 from entity_relationships r where r.relationship_type='parent' and r.source_entity_id::varchar=e and r.target_entity_id::varchar=par) group by 1,2),
cs as (select o, e, 'sec_building' sec, 'sector' kind from rs where q<2 and e is not null union all select o, e, 'sec_jse', 'listing' from rs where q=3 and e is not null)"""


@query("apply_identity_batch", f"with {SERIAL} select o ordinal, e entity_id, via, reason, new[1:4]||'/'||new[5:10]||'/'||new[11:12] new_registration from rs")
def apply_identity_batch(t):
    return patched(t, "results")


@query("apply_identity_batch_entities", f"with {SERIAL} select e entity_id, f field, arg_max(v, o) as value from ff group by 1,2")
def apply_identity_batch_entities(t):
    return patched(t, "entities")


@query("apply_identity_batch_aliases", f"with {SERIAL} select e entity_id, 'kite '||g alias, 'kite '||g normalized_alias, 'other' alias_type from rs where q=1 and e is not null")
def apply_identity_batch_aliases(t):
    return patched(t, "aliases")


@query("apply_identity_batch_classifications", f"with {SERIAL} select distinct e entity_id, sec sector_id, kind classification_type from cs where sec in (select id from sectors) and not exists (select 1 from entity_classifications x where x.entity_id::varchar=e and x.sector_id=sec and x.classification_type=kind)")
def apply_identity_batch_classifications(t):
    return patched(t, "classifications")


@query("apply_identity_batch_relationships", f"with {SERIAL} select e source_entity_id, par target_entity_id, 'parent' relationship_type, 'public' public_status from pe")
def apply_identity_batch_relationships(t):
    return patched(t, "relationships")


@query("apply_identity_batch_sources", f"with {SERIAL} select arg_min(e, o) entity_id, 'https://kite'||(g//2)||'.example.org/x#y' url, 'https://kite'||(g//2)||'.example.org/x' canonical_url, 'other' source_type, 'weekly' frequency from rs where q>1 and e is not null group by g//2")
def apply_identity_batch_sources(t):
    return patched(t, "sources")


@query(
    "apply_identity_batch_filled",
    f"""with {SERIAL} select o ordinal, f filled from ff union all select o, 'alias:'||unnest(['kite '||g,'KITE '||g]) from rs where q=1 and e is not null
        union all select o, case when kind='listing' then 'listing:jse' else 'sector:'||sec end from cs where sec in (select id from sectors) union all select o, 'parent:Kite '||g from pe union all select o, 'source:https://kite'||(g//2)||'.example.org/x#y' from rs where q>1 and e is not null""",
)
def apply_identity_batch_filled(t):
    return patched(t, "filled")


# --- a batch of corpus items ---------------------------------------------------
@lru_cache(maxsize=4)
def _imported(app: str, spark, sf_dir: str):
    return IM.import_batch(Tables(spark, sf_dir, CLOCK), I.corpus_items(Tables(spark, sf_dir, CLOCK)))


def imported(t, table):
    """A table of the batch; the batch is worked out once for a session and folder."""
    return _imported(t.spark.sparkContext.applicationId, t.spark, t.dir)[table]


_WORDS = ",".join(f"'{w}'" for w in NAME_WORDS)
BATCH = f"""recursive it0 as (select c_custkey k, c_custkey//8 g, c_custkey%8 p from customer),
it1 as (select *, ['Kestrel '||g||' Builders (Pty) Ltd','Heron '||g||' Roads Ltd','Overberg '||g||' Plant Hire Limited','Firm '||k||' '||case when g%4=0 then 'Trading' else [{_WORDS}][k%{len(NAME_WORDS)}+1] end,
    'Nightjar '||g||' Works CC','Plover '||g||' Trust Services','tion Services','Wagtail '||g||' Timber Ltd'][p+1] nm,
  case when p<2 or p=6 and g%2=0 then (1990+g%30)||'/'||lpad((500000+g)::varchar,6,'0')||'/07' when p=4 then (1990+k%30)||'/'||lpad((k%1000000)::varchar,6,'0')||'/07' end reg,
  case when p in (1,4) then 'Heron Roads of '||g end legal0, case when p in (2,3) then 'Plant '||g when p=1 then 'Heron Tar '||g end trading,
  case p when 1 then 'https://heron'||g||'.example.com' when 3 then 'http://plant'||g||'.example.com' when 4 then 'mailto:x' end site,
  case when p in (0,3) then 'kestrel '||g||' builders' end parent,
  case when p in (1,3) then case g%3 when 0 then 2025 when 1 then greatest(2018+g%8,2020) else 2020 end when p=7 then 2019 end yr from it0),
it as (select *, coalesce(legal0, case when p=1 then nm||' t/a Heron Tar '||g else nm end) legal, {normal('nm')} nk, replace(reg,'/','') rk, case when site like 'http%' then site end web from it1),
al0 as (select k, nk, 0 pos, 'Heron '||g||' Roads' alias, p from it where p=2 union all select k, nk, 2, 'OB '||g, p from it where p=2 union all select k, nk, 0, 'Plover '||g||' trust services', p from it where p=4
  union all select k, nk, 0, 'Heron Tar '||g, p from it where p=1 union all select k, nk, 1, nm||' t/a Heron Tar '||g, p from it where p=1),
al as (select k, pos, alias, trim(regexp_replace(lower(alias),'[^a-z0-9]+',' ','g')) ak from al0),
um as (select * from entities where merged_into_id is null),
rx as (select registration_number_normalized rk, min(id) rid from um where registration_number_normalized is not null group by 1),
nx as (select normalized_name nk, min(id) nid from um group by 1),
ax as (select a.normalized_alias nk, min(a.entity_id) aid from entity_aliases a join um on um.id=a.entity_id group by 1),
ms as (select it.*, coalesce(rid,nid,aid) sid, case when rid is not null then 'registration_number' when nid is not null then 'canonical_name' when aid is not null then 'alias' end via
  from it left join rx using (rk) left join nx using (nk) left join ax using (nk)),
hs as (select ms.*, e.registration_number ereg, case when sid is null and p=6 then 'malformed' when sid is null and p in (1,3,7) and yr<2024 then 'old_procurement' end held from ms left join entities e on e.id=ms.sid),
st as (select *, held is null and sid is null alone, held is null and sid is not null anchor from hs),
kr as (select rk key, k from st where rk is not null and (alone or anchor and ereg is null)),
kn as (select nk key, k from st where alone),
ka as (select ak key, k from al join st using (k) where alone or anchor union select trim(regexp_replace(lower(trading),'[^a-z0-9]+',' ','g')), k from st where alone and trading is not null),
fr as (select key, min(k) f from kr group by 1), fn as (select key, min(k) f from kn group by 1),
eg as (select k u, f v from kr join fr using (key) union select k, f from kn join fn using (key) union select k, f from ka join fn using (key)),
es as (select u, v from eg union select v, u from eg),
rc as (select k a, k b from st where alone or anchor union select rc.a, es.v from rc join es on es.u=rc.b),
rt as (select a k, min(b) root from rc group by 1),
gp as (select root, arg_min(sid, k) filter (anchor) gsid, min(k) filter (alone) founder from st join rt using (k) group by 1),
gn as (select gp.*, 'ent_'||left(sha256('ent:v1|'||coalesce(f.rk,'')||'|'||f.nk),20) gid from gp left join it f on f.k=founder),
mb as (select st.k, coalesce(st.sid::varchar, gn.gsid::varchar, gn.gid) eid, founder, gsid from st join rt using (k) join gn using (root)),
lr as (select key, arg_min(eid, k) e from kr join mb using (k) group by 1), ln as (select key, arg_min(eid, k) e from kn join mb using (k) group by 1), la as (select key, arg_min(eid, k) e from ka join mb using (k) group by 1),
dc as (select st.*, coalesce(mb.eid, lr.e, ln.e, la.e) eid, alone and gsid is null fresh, alone and gsid is null and st.k=founder made
  from st left join mb using (k) left join lr on held is not null and lr.key=st.rk left join ln on held is not null and ln.key=st.nk left join la on held is not null and la.key=st.nk),
ds as (select dc.*, unnest([0,1,2]) pos from dc where p in (1,3) and g%11<>10 and eid is not null),
dd as (select *, 'https://tenders.example.org/awards/t'||k||case when pos=2 then '-2020-05' else '' end url, 'T'||k||case when pos=2 then '-2020-05' else '' end tender,
  case when pos<2 and g%3=1 then (2018+g%8)||'-0'||(1+g%9)||'-15' when g%3=0 then '2025-03-03' when pos=2 then '2020-01-01' end dy,
  case when pos<2 and g%3=1 or g%3=0 then 'day' when pos=2 then 'year' end prec from ds),
dh as (select *, sha256('gpd:v1|'||url||'|'||lower(tender)||'|'||nk||'|'||(1+g%8)||'|'||coalesce(dy,'')) h from dd)"""


@query("import_corpus_decisions", f"with {BATCH} select k ordinal, nm as name, case when eid is null then 'held' when made then 'created' else 'matched' end outcome, case when eid is null then held end held_reason, eid entity_id, case when anchor then via when eid is not null and not coalesce(made,false) then 'batch' end via from dc")
def import_corpus_decisions(t):
    return imported(t, "decisions")


@query(
    "import_corpus_entities",
    f"""with {BATCH}, ne as (select eid, arg_min(nm,k) filter (made) nm, arg_min(nk,k) filter (made) nk, arg_min(legal,k) legal, arg_min(trading,k) trading, arg_min(reg,k) reg, arg_min(case when made then site else web end,k) web from dc where fresh group by 1)
        select eid id, trim(regexp_replace(lower(nm),'[^a-z0-9]+','-','g'),'-') slug, nm canonical_name, nk normalized_name, legal legal_name, trading trading_name, reg registration_number, replace(reg,'/','') registration_number_normalized, web website,
          'company' entity_type, 'draft' visibility, 'review_only' automation_state from ne""",
)
def import_corpus_entities(t):
    return imported(t, "entities")


@query(
    "import_corpus_filled",
    f"""with {BATCH}, o as (select eid, arg_min(reg,k) reg, arg_min(web,k) web, arg_min(legal0,k) legal, arg_min(case when p in (2,3) then trading end,k) trading from dc where eid is not null and not coalesce(fresh,false) group by 1),
        j as (select o.*, e.registration_number, e.website, e.legal_name, e.trading_name from o join entities e on e.id::varchar=eid),
        f as (select eid, unnest([{{'f':'registration_number','v':case when registration_number is null and not exists (select 1 from um where um.registration_number=j.reg and um.id::varchar<>j.eid) then reg end}},{{'f':'website','v':case when website is null then web end}},
          {{'f':'legal_name','v':case when legal_name is null then legal end}},{{'f':'trading_name','v':case when trading_name is null then trading end}}]) x from j)
        select eid entity_id, x.f field, x.v as value from f where x.v is not null""",
)
def import_corpus_filled(t):
    return imported(t, "filled")


@query(
    "import_corpus_aliases",
    f"""with {BATCH}, a as (select eid, k, pos, alias, ak, 'other' kind from al join dc using (k) where eid is not null union all select eid, k, -1, trading, trim(regexp_replace(lower(trading),'[^a-z0-9]+',' ','g')), 'trading' from dc where made and trading is not null)
        select eid entity_id, ak normalized_alias, arg_min(alias, (k,pos)) alias, arg_min(kind, (k,pos)) alias_type from a where not exists (select 1 from entity_aliases x where x.entity_id::varchar=a.eid and x.normalized_alias=a.ak) group by 1,2""",
)
def import_corpus_aliases(t):
    return imported(t, "aliases")


@query(
    "import_corpus_classifications",
    f"""with {BATCH}, c as (select eid, 'sec_building' sec, 'sector' kind from dc where p<2 union select eid, 'sec_machinery', 'sector' from dc where p=2 union select eid, 'sec_jse', 'listing' from dc where p=2)
        select eid entity_id, sec sector_id, kind classification_type from c where eid is not null and sec in (select id from sectors) and not exists (select 1 from entity_classifications x where x.entity_id::varchar=eid and x.sector_id=sec and x.classification_type=kind)""",
)
def import_corpus_classifications(t):
    return imported(t, "classifications")


@query(
    "import_corpus_relationships",
    f"""with {BATCH}, nb as (select nk, arg_min(eid,k) e from dc where eid is not null group by 1), pr as (select distinct eid s, coalesce(nx.nid::varchar, ax.aid::varchar, nb.e) tgt from dc left join nx on nx.nk=parent left join ax on ax.nk=parent left join nb on nb.nk=parent where parent is not null and eid is not null)
        select s source_entity_id, tgt target_entity_id, 'parent' relationship_type, 'public' public_status from pr where s<>tgt and not exists (select 1 from entity_relationships r where r.relationship_type='parent' and r.source_entity_id::varchar=s and r.target_entity_id::varchar=tgt)""",
)
def import_corpus_relationships(t):
    return imported(t, "relationships")


@query(
    "import_corpus_sources",
    f"""with {BATCH}, w as (select eid, k, 0 pos, 'https://www.kestrel'||g||'.example.com/' url, 'company_website' kind, 'weekly' freq from dc where p=2 union all select eid, k, 0, 'https://www.kestrel'||g||'.example.com/cert.pdf', 'direct_evidence_url', 'monthly' from dc where p=0
          union all select eid, k, pos, 'https://tenders.example.org/awards/t'||k||case when pos=2 then '-2020-05' else '' end, 'government_source', 'manual' from ds)
        select 'src_'||left(sha256(url),20) id, arg_min(eid,k) entity_id, url, url canonical_url, split_part(replace(url,'www.',''),'/',3) as domain, any_value(kind) source_type, any_value(freq) frequency from w where eid is not null group by url""",
)
def import_corpus_sources(t):
    return imported(t, "sources")


@query(
    "import_corpus_evidence",
    f"""with {BATCH} select distinct 'evd_'||left(h,24) id, 'government_procurement_disclosure' evidence_type, case when g%3=0 then 'Award of 3 March 2025' else nm||' — Level '||(1+g%8)||' reported in Department '||(g%17)||' '||tender end title, url source_url, 'tenders.example.org' source_domain, h content_hash,
          dy issue_date, case when prec='year' then '2020' when prec='day' then strftime(dy::date,'%-d %B %Y') when pos=2 then 'not stated' end issue_date_raw, prec issue_date_precision, 'Department '||(g%17) document_issuer, 'unpublished' publication_state, 'discovered' lifecycle_state,
          '{_NOTE}'||case g%4 when 0 then 'The named bidder was recorded in an official evaluation/result table; award is not implied.' when 1 then 'The named bidder was recorded as having responded to this procurement.' else 'The named supplier was recorded in an official awarded-tender or bidder-result publication.' end public_notes from dh""",
)
def import_corpus_evidence(t):
    return imported(t, "evidence")


@query("import_corpus_locations", f"with {BATCH} select distinct 'evd_'||left(h,24) evidence_id, url from dh")
def import_corpus_locations(t):
    return imported(t, "locations")


@query("import_corpus_links", f"with {BATCH} select distinct 'evd_'||left(h,24) evidence_id, eid entity_id, 'confirmed' link_state, nm extracted_name, 'import' match_method, 1.0::double confidence, 'Official procurement disclosure from Department '||(g%17)||'.' reason from dh")
def import_corpus_links(t):
    return imported(t, "links")


@query("import_corpus_approvals", f"with {BATCH} select distinct 'evd_'||left(h,24) evidence_id, eid entity_id from dh where p=1 or g%2=0")
def import_corpus_approvals(t):
    return imported(t, "approvals")


# --- checks ------------------------------------------------------------------
@query(
    "check_unique_keys",
    """select 'live_registration' as rule, registration_number_normalized as key, count(*) n from entities where registration_number_normalized is not null and merged_into_id is null group by 2 having count(*)>1
       union all select 'evidence_hash', content_hash, count(*) from evidence_raw group by 2 having count(*)>1""",
)
def check_unique_keys(t):
    return QC.check_unique_keys(t)


@query(
    "check_references",
    """select 'publication_events.entity_id' as rule, entity_id::varchar as key, count(*) n from publication_events p where not exists (select 1 from entities e where e.id=p.entity_id) group by 2
       union all select 'evidence_raw.signatory_id', signatory_id::varchar, count(*) from evidence_raw p where signatory_id is not null and not exists (select 1 from signatories e where e.id=p.signatory_id) group by 2""",
)
def check_references(t):
    return QC.check_references(t)


@query("check_enums", "select 'review_items.status' as rule, status as key, count(*) n from review_items where status='deferred' group by 2")
def check_enums(t):
    return QC.check_enums(t)


@query("check_validity", "select 'current_without_expiry' as rule, id::varchar as key from evidence where lifecycle_state in ('current','expiring_soon') and expiry_date is null")
def check_validity(t):
    return QC.check_validity(t)


