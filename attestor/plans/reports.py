"""Runnable queries: directory, searches, joins, counts, rankings."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from attestor.operators import claims as C
from attestor.operators import flags as FL
from attestor.operators import lifecycle as L
from attestor.operators import profiles as P
from attestor.operators import ranking as R
from attestor.operators import reports as RP
from attestor.operators import search as S
from attestor.operators.common import live_entity
from attestor.plans.registry import query
from attestor.schemas import DEFAULT_CLOCK as CLOCK

D = "strftime({0}, '%Y-%m-%d') {0}"
TS = "strftime({0}, '%Y-%m-%d %H:%M:%S.%f') {0}"


# --- filters and search ------------------------------------------------------
@query(
    "company_search",
    """select id, canonical_name, registration_number from live e where canonical_name ilike '%bank%' or legal_name ilike '%bank%' or trading_name ilike '%bank%'
       or registration_number ilike '%bank%' or exists (select 1 from entity_aliases a where a.entity_id=e.id and (a.alias ilike '%bank%' or a.normalized_alias ilike '%bank%'))""",
)
def company_search(t):
    return S.company_search(t, "bank").select("id", "canonical_name", "registration_number")


@query(
    "company_search_alias",
    """select id, canonical_name from live e where canonical_name ilike '%Firm 1%' or legal_name ilike '%firm 1%' or trading_name ilike '%firm 1%'
       or exists (select 1 from entity_aliases a where a.entity_id=e.id and (a.alias ilike '%firm 1%' or a.normalized_alias ilike '%firm 1%'))""",
)
def company_search_alias(t):
    return S.company_search(t, " Firm 1 ").select("id", "canonical_name")


@query(
    "search_across",
    """(select 'company' kind, id, slug, canonical_name as name, registration_number extra from live e
         where canonical_name ilike '%er 1%' or legal_name ilike '%er 1%' or trading_name ilike '%er 1%' or registration_number ilike '%er 1%'
           or exists (select 1 from entity_aliases a where a.entity_id=e.id and a.alias ilike '%er 1%') order by name, id limit 20)
       union all
       (select 'agency', id, slug, name, null from verification_agencies v where visibility='public' and
         (name ilike '%er 1%' or exists (select 1 from agency_aliases a where a.agency_id=v.id and a.alias ilike '%er 1%')) order by name, id limit 20)""",
)
def search_across(t):
    return S.search_across(t, "er 1")


DIRECTORY = """
select e.id, e.slug, e.canonical_name, e.registration_number, s.bee_level, null::varchar state_expiry, s.lifecycle_state as state, sa.name state_agency,
  (select string_agg(x.name, ', ' order by x.name) from entity_classifications ec join sectors x on x.id=ec.sector_id where ec.entity_id=e.id and ec.is_public) sector_names,
  coalesce(c.has_disclosure,false) has_disclosure, ce.evidence_type current_evidence_type,
  l.evidence_id latest_evidence_id, l.evidence_type latest_evidence_type, l.lifecycle_state latest_lifecycle, l.reported_level latest_level,
  strftime(l.issue_date,'%Y-%m-%d') latest_date, strftime(l.expiry_date,'%Y-%m-%d') latest_expiry, l.title latest_title, l.source_url latest_url, l.agency_name latest_agency
from live e left join state s on s.entity_id=e.id left join verification_agencies sa on sa.id=s.verifier_agency_id
left join latest l on l.entity_id=e.id left join cat c on c.entity_id=e.id left join evidence_raw ce on ce.id=s.evidence_id
"""


@query("company_directory", DIRECTORY)
def company_directory(t):
    """The whole directory: entity, state, latest evidence, sectors."""
    return S.company_directory(t, CLOCK)


@query("company_directory_page", DIRECTORY + " order by e.canonical_name, e.id limit 25 offset 25")
def company_directory_page(t):
    return S.directory_page(t, CLOCK, S.DirectoryFilter(page=2))


@query(
    "company_directory_filtered",
    DIRECTORY
    + """ where coalesce(l.reported_level, s.bee_level)='3' and c.recent
          and exists (select 1 from entity_classifications ec where ec.entity_id=e.id and ec.sector_id='sec_machinery' and ec.is_public and ec.classification_type='sector')""",
)
def company_directory_filtered(t):
    return S.company_directory(t, CLOCK, S.DirectoryFilter(level="3", sector="machinery", category="recent_evidence"))


@query(
    "company_directory_agency_year",
    DIRECTORY + " where year(l.issue_date)=2000 and s.lifecycle_state='current' and (sa.slug like 'agency-1%' and sa.slug='agency-1' or l.agency_slug='agency-1')",
)
def company_directory_agency_year(t):
    return S.company_directory(t, CLOCK, S.DirectoryFilter(agency="agency-1", year=2000, lifecycle="current"))


@query(
    "evidence_category_filter",
    "select * from ("
    + " union all ".join(
        f"select '{name}' category, e.id from live e join cat c on c.entity_id=e.id where {cond}"
        for name, cond in {
            "current_certificate": "valid",
            "recent_evidence": "recent",
            "official_procurement_disclosure": "recent_procurement",
            "official_company_disclosure": "recent_company",
            "historical_evidence": "old and not recent and not valid",
            "date_not_stated": "not dated",
        }.items()
    )
    + ")",
)
def evidence_category_filter(t):
    """All six categories from one flag table, one row per (category, entity)."""
    flags = t["entities"].filter(live_entity()).select("id").join(FL.category_flags(t, CLOCK), "id")
    named = F.array_compact(F.array(*[F.when(FL.category_condition(c), F.lit(c)) for c in FL.CATEGORIES]))
    return flags.select(F.explode(named).alias("category"), "id")


@query(
    "research_queue",
    " union all ".join(f"select '{q}' queue, id from live_q where q_{q}" for q in FL.QUEUES),
)
def research_queue(t):
    """Membership of all sixteen queues."""
    flags = FL.entity_flags(t, CLOCK).filter(live_entity())
    named = F.array_compact(F.array(*[F.when(FL.queue_condition(q), F.lit(q)) for q in FL.QUEUES]))
    return flags.select(F.explode(named).alias("queue"), "id")


@query(
    "admin_company_list",
    """select id, slug, canonical_name, visibility, automation_state, registration_number, strftime(updated_at,'%Y-%m-%d') updated_at from queues
       where merged_into_id is null and (canonical_name ilike '%solar%' or registration_number ilike '%solar%') and visibility='public' and q_multiple_evidence
       order by queues.updated_at desc, id desc limit 30""",
)
def admin_company_list(t):
    return S.admin_company_list(FL.entity_flags(t, CLOCK), "solar", "public", "multiple_evidence")


@query(
    "evidence_list",
    """select id, title, evidence_type, source_url, lifecycle_state, review_state, publication_state, strftime(issue_date,'%Y-%m-%d') issue_date, strftime(expiry_date,'%Y-%m-%d') expiry_date, content_hash, strftime(created_at,'%Y-%m-%d') created_at
       from evidence where (title ilike '%award%' or source_url ilike '%award%' or id::varchar ilike '%award%') and lifecycle_state='historical' and review_state='approved'
       order by evidence.created_at desc, id desc limit 30 offset 30""",
)
def evidence_list(t):
    return S.evidence_list(t, "award", "historical", "approved", page=2)


@query(
    "review_list",
    f"""select r.id, r.type, r.reason, r.status, r.severity, r.entity_id, r.evidence_id, strftime(r.generated_at,'%Y-%m-%d') generated_at, e.title evidence_title, n.canonical_name entity_name
       from (select * from review_items where status='pending' and type='new_evidence' order by generated_at desc, id desc limit 30) r
       left join evidence_raw e on e.id=r.evidence_id left join entities n on n.id=r.entity_id""",
)
def review_list(t):
    return S.review_list(t, kind="new_evidence")


HEALTH = """(select '{0}' health, id, domain as host from sources where {1} order by updated_at desc, id desc limit 200)"""


@query(
    "source_health",
    HEALTH.format("failed", "consecutive_error_count>0")
    + " union all "
    + HEALTH.format("disabled", "not enabled")
    + " union all "
    + HEALTH.format("stale", "last_checked_at is null or last_checked_at < date '2000-12-18'"),
)
def source_health(t):
    parts = [
        S.source_health(t, h, CLOCK).select(F.lit(h).alias("health"), "id", F.col("domain").alias("host"))
        for h in ("failed", "disabled", "stale")
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(
    "audit_search",
    """select id, "action", target_type, target_id, strftime("at",'%Y-%m-%d %H:%M:%S.%f') "at" from audit_logs where "action" ilike '%purch%' or target_id ilike '%purch%' or target_type ilike '%purch%' order by audit_logs."at" desc, id desc limit 150""",
)
def audit_search(t):
    return S.audit_search(t, "purch")


@query(
    "due_sources",
    """select id, url, strftime(next_check_at,'%Y-%m-%d') next_check_at from sources where enabled and (backoff_until is null or backoff_until<=date '2001-01-01')
       and (next_check_at is null or next_check_at<=date '2001-01-01') and frequency<>'manual' order by sources.next_check_at nulls first, id limit 8""",
)
def due_sources(t):
    return S.due_sources(t, CLOCK).select("id", "url", "next_check_at")


@query(
    "source_next_check",
    """select id, strftime(date '2001-01-01' + case frequency when 'daily' then 1 when 'weekly' then 7 when 'monthly' then 30 end,'%Y-%m-%d') next_check_at,
       case when consecutive_error_count=0 then 0 when consecutive_error_count=1 then 1 when consecutive_error_count=2 then 4 when consecutive_error_count=3 then 12 else 24 end backoff_hours from sources""",
)
def source_next_check(t):
    return S.source_next_check(t["monitored_sources"], CLOCK)


# --- joins -------------------------------------------------------------------
@query(
    "published_entity_evidence",
    """select v.entity_id, v.id evidence_id, e.canonical_name, v.evidence_type, v.lifecycle_state, strftime(v.issue_date,'%Y-%m-%d') issue_date, strftime(v.expiry_date,'%Y-%m-%d') expiry_date, v.title
       from vis v join live e on e.id=v.entity_id""",
)
def published_entity_evidence(t):
    return P.published_entity_evidence(t)


@query(
    "entity_evidence_timeline",
    """select v.entity_id, v.id evidence_id, v.evidence_type, v.lifecycle_state, strftime(v.issue_date,'%Y-%m-%d') issue_date, strftime(v.expiry_date,'%Y-%m-%d') expiry_date, v.title, v.verifier_agency_id, v.signatory_id,
       a.name agency_name, s.name signatory_name, c1.value reported_bee_level, c2.value tender_number, c3.value government_institution, c4.value enterprise_class
       from vis v left join verification_agencies a on a.id=v.verifier_agency_id left join signatories s on s.id=v.signatory_id
       left join latest_val c1 on c1.evidence_id=v.id and c1.field_key='bee_level' left join latest_val c2 on c2.evidence_id=v.id and c2.field_key='tender_number'
       left join latest_val c3 on c3.evidence_id=v.id and c3.field_key='government_institution' left join latest_val c4 on c4.evidence_id=v.id and c4.field_key='enterprise_class'""",
)
def entity_evidence_timeline(t):
    return P.entity_evidence_timeline(t)


@query(
    "entity_profile",
    """select e.id entity_id, e.slug, e.canonical_name, e.registration_number, s.bee_level, s.lifecycle_state, a.name agency_name,
        coalesce((select v.id from vis v where v.entity_id=e.id and v.id=s.evidence_id), n.id) supporting_id, x.section, strftime(x.d,'%Y-%m-%d') item_date, x.k item_key, x.v item_value
       from live e left join state s on s.entity_id=e.id left join verification_agencies a on a.id=s.verifier_agency_id
       left join (select entity_id, id, row_number() over (partition by entity_id order by issue_date desc nulls last, id desc) rn from vis) n on n.entity_id=e.id and n.rn=1
       left join (
          select entity_id, 'aliases' section, null::date d, null::varchar k, alias v from entity_aliases where reviewed_status='reviewed'
          union all select c.entity_id, 'sectors', null, null, s.name from entity_classifications c join sectors s on s.id=c.sector_id where c.is_public and c.classification_type='sector' and c.sector_id not in ('sec_jse','sec_government_suppliers')
          union all select r.source_entity_id, case when r.relationship_type in ('parent','holding_company') then 'parents' else 'children' end, null, null, t.canonical_name from entity_relationships r join entities t on t.id=r.target_entity_id
              where r.public_status='public' and r.review_state='approved' and t.visibility='public'
          union all select entity_id, 'claims', null, field_key, value from published_claims
          union all select entity_id, 'events', published_at::date, id::varchar, null from publication_events
          union all select entity_id, 'documents', issue_date, id::varchar, null from vis
          union all select l.entity_id, 'included', r.issue_date, r.id::varchar, null from links l join evidence_raw r on r.id=l.evidence_id where l.link_state='included' and r.publication_state='published'
       ) x on x.entity_id=e.id""",
)
def entity_profile(t):
    return P.entity_profile(t)


@query(
    "evidence_profile",
    """select e.id, e.title, e.evidence_type, e.lifecycle_state, a.name agency_name, s.name signatory_name, x.section, strftime(x.d,'%Y-%m-%d') item_date, x.k item_key, x.v item_value
       from evidence e left join verification_agencies a on a.id=e.verifier_agency_id left join signatories s on s.id=e.signatory_id
       left join (
          select l.evidence_id, 'entities' section, null::date d, n.id::varchar k, n.canonical_name v from links l join entities n on n.id=l.entity_id where l.link_state in ('confirmed','extracted') and n.visibility='public'
          union all select evidence_id, 'claims', null, field_key, value from working
          union all select evidence_id, 'locations', last_seen_at::date, null, url from locations) x on x.evidence_id=e.id
       where e.publication_state='published'""",
)
def evidence_profile(t):
    return P.evidence_profile(t)


@query(
    "agency_profile",
    """select r.verifier_agency_id, r.agency_name, r.id, r.title, r.evidence_type, strftime(r.issue_date,'%Y-%m-%d') issue_date, r.entity_id, n.canonical_name entity_name, r.rn "position",
        (select min(accreditation_identifier) from agency_accreditations x where x.agency_id=r.verifier_agency_id) accreditation,
        (select count(*) from agency_aliases x where x.agency_id=r.verifier_agency_id) alias_count, (select count(*) from signatories x where x.agency_id=r.verifier_agency_id) signatory_count
       from (select e.*, a.name agency_name, l.entity_id, row_number() over (partition by e.verifier_agency_id order by e.issue_date desc nulls last, e.id desc) rn
             from evidence_raw e join verification_agencies a on a.id=e.verifier_agency_id and a.visibility='public' left join links l on l.evidence_id=e.id and l.link_state='confirmed' where e.publication_state='published') r
       left join entities n on n.id=r.entity_id and n.visibility='public' where r.rn<=100""",
)
def agency_profile(t):
    return P.agency_profile(t)


@query(
    "agency_sections",
    """with pa as (select * from verification_agencies where visibility='public'),
       ev as (select e.verifier_agency_id agency_id, e.title, e.issue_date, n.canonical_name, row_number() over (partition by e.verifier_agency_id order by e.issue_date desc nulls last, e.id desc, l.entity_id nulls last) rn
              from evidence_raw e join pa on pa.id=e.verifier_agency_id left join links l on l.evidence_id=e.id and l.link_state='confirmed' left join entities n on n.id=l.entity_id and n.visibility='public' where e.publication_state='published')
       select id agency_id, 'agency' section, 1 "position", name as label, legal_name detail, website extra from pa
       union all select agency_id, 'alias', row_number() over (partition by agency_id order by alias), alias, null, null from agency_aliases where agency_id in (select id from pa)
       union all select agency_id, 'accreditation', row_number() over (partition by agency_id order by accreditation_identifier), accreditation_identifier, 'SANAS', 'active' from agency_accreditations where agency_id in (select id from pa)
       union all select agency_id, 'signatory', row_number() over (partition by agency_id order by name), name, 'Technical signatory', null from signatories where agency_id in (select id from pa)
       union all select agency_id, 'evidence', rn, title, canonical_name, strftime(issue_date,'%Y-%m-%d') from ev where rn<=100""",
)
def agency_sections(t):
    return P.agency_sections(t)


@query(
    "entities_with_evidence",
    "select id, canonical_name from live e where exists (select 1 from vis v where v.entity_id=e.id and v.evidence_type='government_procurement_disclosure')",
)
def entities_with_evidence(t):
    return FL.entities_with_evidence(t, "government_procurement_disclosure").select("id", "canonical_name")


@query(
    "entities_without_current",
    """select e.id, e.canonical_name, case when old and not recent and not valid then 'historical_only' else 'undated' end reason
       from live e join cat c on c.entity_id=e.id where (old and not recent and not valid) or (not dated and not valid)""",
)
def entities_without_current(t):
    return FL.entities_without_current(t, CLOCK)


@query(
    "merge_redirect",
    "select e.id, e.slug, e.merged_into_id, s.slug redirect_to from entities e left join entities s on s.id=e.merged_into_id where e.merged_into_id is not null",
)
def merge_redirect(t):
    return P.merge_redirect(t)


@query(
    "parent_child_links",
    """select r.source_entity_id entity_id, case when r.relationship_type in ('parent','holding_company') then 'parent' else 'child' end side, r.relationship_type, r.target_entity_id, t.slug target_slug, t.canonical_name target_name
       from entity_relationships r join entities t on t.id=r.target_entity_id where r.public_status='public' and r.review_state='approved' and t.visibility='public'""",
)
def parent_child_links(t):
    return P.parent_child_links(t)


@query(
    "official_domain_sources",
    """select e.id, e.canonical_name, regexp_replace(lower(split_part(regexp_replace(e.website,'^https?://',''),'/',1)),'^www\\.','') host from live e
       where exists (select 1 from sources s where s.entity_id=e.id and s.domain=regexp_replace(lower(split_part(regexp_replace(e.website,'^https?://',''),'/',1)),'^www\\.',''))""",
)
def official_domain_sources(t):
    return P.official_domain_sources(t)


@query(
    "match_company_universe",
    """with named as (select c_custkey ordinal, case c_custkey%3 when 0 then 'Firm '||c_custkey||' Trading' when 1 then 'Old Firm '||c_custkey else 'THE FIRM '||c_custkey||' bank ltd' end nm from customer),
       inp as (select ordinal, nm, trim(regexp_replace(regexp_replace(lower(nm),'\\b(the|ltd)\\b',' ','g'),'\\s+',' ','g')) k from named),
       byname as (select i.ordinal, e.*, row_number() over (partition by i.ordinal order by visibility<>'public', canonical_name, id) rn from inp i join entities e on e.merged_into_id is null and e.normalized_name=i.k),
       byalias as (select i.ordinal, e.*, row_number() over (partition by i.ordinal order by e.visibility<>'public', e.canonical_name, e.id) rn from inp i join entity_aliases a on a.normalized_alias=i.k join entities e on e.id=a.entity_id and e.merged_into_id is null)
       select i.ordinal, i.nm as name, coalesce(n.id,a.id) entity_id, coalesce(n.canonical_name,a.canonical_name) canonical_name,
         case when coalesce(n.id,a.id) is null then 'missing' when coalesce(n.visibility,a.visibility)<>'public' then 'hidden' else 'present' end state
       from inp i left join byname n on n.ordinal=i.ordinal and n.rn=1 left join byalias a on a.ordinal=i.ordinal and a.rn=1""",
)
def match_company_universe(t):
    """Every customer key as a typed name, matched against the entities."""
    k = F.col("c_custkey")
    typed = F.when(k % 3 == 0, F.concat(F.lit("Firm "), k, F.lit(" Trading"))).when(k % 3 == 1, F.concat(F.lit("Old Firm "), k)).otherwise(
        F.concat(F.lit("THE FIRM "), k, F.lit(" bank ltd"))
    )
    return S.match_company_universe(t, t.raw("customer").select(k.alias("ordinal"), typed.alias("name")))


# --- aggregations ------------------------------------------------------------
FLAG_COLUMNS = """evidence_count, procurement_count, certificate_count, type_count, institution_count, latest_year, valid_certificate, expired_certificate, unknown_certificate,
 unknown_evidence, has_disclosure_type, needs_replacement, has_verifier, recent_procurement, current_state, has_sector, listed, has_parent_edge, has_parent, has_source, has_official_source, has_pending_review"""


@query("entity_flags", f"select id, {FLAG_COLUMNS} from flags")
def entity_flags(t):
    return FL.entity_flags(t, CLOCK).select("id", *[c.strip() for c in FLAG_COLUMNS.split(",")])


@query(
    "public_stats",
    """select (select count(*) from live) companies, (select count(*) from live e join cat c on c.entity_id=e.id where recent) recent_companies,
      (select count(*) from live e join cat c on c.entity_id=e.id where old and not recent and not valid) historical_only,
      (select count(*) from live e join cat c on c.entity_id=e.id where not dated and not valid) undated_official,
      count(*) evidence, count(*) filter (where lifecycle_state in ('historical','superseded','expired')) historical,
      count(*) filter (where lifecycle_state in ('current','expiring_soon') and evidence_type in ('bee_certificate','sworn_affidavit')) current_certificates,
      count(*) filter (where evidence_type='government_procurement_disclosure') official_disclosures,
      (select count(*) from verification_agencies where visibility='public') verifiers,
      (select count(*) from publication_events where published_at >= timestamp '2024-01-30 00:00:00' - interval 30 day) updated_30d,
      (select count(distinct e.id) from live e join vis v on v.entity_id=e.id where year(v.issue_date)=2000) with_2000,
      (select count(distinct e.id) from live e join vis v on v.entity_id=e.id where year(v.issue_date)=1999) with_1999,
      (select count(distinct e.id) from live e join vis v on v.entity_id=e.id where year(v.issue_date)=1998) with_1998
     from evidence where publication_state='published'""",
)
def public_stats(t):
    return RP.public_stats(t, CLOCK, [2000, 1999, 1998])


@query(
    "companies_by_evidence_year",
    "select year(v.issue_date) as year, count(distinct e.id) companies from live e join vis v on v.entity_id=e.id where v.issue_date is not null group by 1",
)
def companies_by_evidence_year(t):
    return RP.companies_by_evidence_year(t)


@query(
    "sector_counts",
    """select s.id, s.slug, s.name, count(ec.id) n from sectors s left join entity_classifications ec on ec.sector_id=s.id and ec.is_public and ec.classification_type='sector'
       where s.id not in ('sec_jse','sec_government_suppliers') group by 1,2,3""",
)
def sector_counts(t):
    return RP.sector_counts(t)


@query(
    "sector_coverage",
    """select count(*) published, count(*) filter (where has_sector) with_sector, count(*) filter (where not has_sector) missing, round(count(*) filter (where has_sector)*100.0/count(*),1)::double coverage
       from (select exists (select 1 from entity_classifications x where x.entity_id=e.id and x.is_public and x.classification_type='sector' and x.sector_id not in ('sec_jse','sec_government_suppliers')) has_sector from live e)""",
)
def sector_coverage(t):
    return RP.sector_coverage(t)


@query(
    "sector_distribution",
    """select s.id sector_id, s.name, count(distinct e.id) n from sectors s join entity_classifications c on c.sector_id=s.id and c.is_public and c.classification_type='sector' join live e on e.id=c.entity_id
       where s.id not in ('sec_jse','sec_government_suppliers') group by 1,2""",
)
def sector_distribution(t):
    return RP.sector_distribution(t)


@query(
    "agency_evidence_counts",
    """select id, slug, name, website, (select count(*) from evidence_raw e where e.verifier_agency_id=v.id and e.publication_state='published') evidence_count
       from verification_agencies v where visibility='public' and name ilike '%verif%'""",
)
def agency_evidence_counts(t):
    return RP.agency_evidence_counts(t, "verif")


@query(
    "dashboard_counts",
    """select (select count(*) from entities where merged_into_id is null) tracked, (select count(*) from live) visible,
      (select count(*) from live_q where q_no_registration) no_registration, (select count(*) from live_q where q_no_website) no_website, (select count(*) from live_q where q_procurement_only) procurement_only,
      (select count(*) from live_q where q_no_monitored_source) no_monitored_source, (select count(*) from live e where not exists (select 1 from entity_classifications c where c.entity_id=e.id)) no_sector,
      count(*) evidence, count(*) filter (where lifecycle_state='current') as current, count(*) filter (where lifecycle_state in ('historical','superseded')) historical, count(*) filter (where lifecycle_state='expired') expired,
      count(*) filter (where lifecycle_state='expiring_soon') expiring, count(*) filter (where lifecycle_state='unknown_validity') unknown_validity,
      (select count(*) from review_items where status='pending') review, (select count(*) from review_items where status='pending' and type='uncertain_entity_match') matches,
      (select count(*) from submissions where status='pending') submissions, (select count(*) from sources) sources, (select count(*) from verification_agencies) verifiers from evidence""",
)
def dashboard_counts(t):
    return RP.dashboard_counts(t, FL.entity_flags(t, CLOCK))


@query(
    "activity_last_days",
    """select (select count(*) from runs where started_at>=date '2000-12-25' and success) extracted, (select count(*) from runs where started_at>=date '2000-12-25' and not success) extract_failed,
      (select count(*) from source_checks where started_at>=timestamp '2024-01-23 00:00:00') sources_checked, (select count(*) from evidence_raw where created_at>=date '2000-12-25') new_evidence,
      (select count(*) from publication_events where published_at>=timestamp '2024-01-23 00:00:00' and event_type='auto_published') auto_published,
      (select count(*) from crawler_jobs where created_at>=timestamp '2024-01-23 00:00:00' and state='failed') crawler_failed""",
)
def activity_last_days(t):
    return RP.activity_last_days(t, CLOCK)


AVERAGE = "(select round(avg(n),2) from (select count(l.id)::double n from live e left join links l on l.entity_id=e.id group by e.id))"


@query(
    "enrichment_audit",
    f"""select count(*) published, count(*) filter (where q_current_certificate) with_current_certificate, count(*) filter (where q_expiring_soon) with_expiring_certificate,
      count(*) filter (where q_expired_certificate_only) expired_certificate_only, count(*) filter (where unknown_certificate) unknown_validity_certificate, count(*) filter (where certificate_count>0) certificate_backed,
      count(*) filter (where q_procurement_only) procurement_only, count(*) filter (where has_disclosure_type and certificate_count=0 and procurement_count=0) disclosure_only, count(*) filter (where type_count>=2) multiple_evidence_types,
      count(*) filter (where q_no_registration) missing_registration, count(*) filter (where q_no_sector) missing_sector, count(*) filter (where q_no_website) missing_website, count(*) filter (where not has_parent_edge) missing_parent,
      count(*) filter (where certificate_count=0) missing_certificate, count(*) filter (where not has_verifier) missing_verifier, count(*) filter (where has_source) with_monitored_source,
      count(*) filter (where has_official_source) with_official_domain_source, {AVERAGE} average_evidence from live_q""",
)
def enrichment_audit(t):
    return FL.enrichment_audit(FL.entity_flags(t, CLOCK), FL.avg_evidence_per_entity(t))


@query("avg_evidence_per_entity", f"select {AVERAGE} average_evidence")
def avg_evidence_per_entity(t):
    return FL.avg_evidence_per_entity(t)


@query(
    "review_breakdown",
    """select r.type, r.n, r.rn "position", r.id, r.reason, n.canonical_name entity_name, e.title evidence_title, e.publication_state, e.evidence_type, n.visibility
       from (select *, count(*) over (partition by type) n, row_number() over (partition by type order by generated_at desc, id desc) rn from review_items where status='pending') r
       left join evidence_raw e on e.id=r.evidence_id left join entities n on n.id=r.entity_id where r.rn<=8""",
)
def review_breakdown(t):
    return RP.review_breakdown(t)


@query(
    "duplicate_name_groups",
    """with g as (select normalized_name, count(*) n from entities where merged_into_id is null group by 1 having count(*)>1 order by n desc, normalized_name limit 40)
       select normalized_name, n, id entity_id, canonical_name from g join entities using (normalized_name) where merged_into_id is null""",
)
def duplicate_name_groups(t):
    return RP.duplicate_name_groups(t)


@query("queue_counts", " union all ".join(f"select '{q}' queue, count(*) filter (where q_{q}) n from live_q" for q in FL.QUEUES))
def queue_counts(t):
    return FL.queue_counts(FL.entity_flags(t, CLOCK))


ANY_GAP = "(" + " or ".join(
    f"q_{q}" for q in ("procurement_only", "no_registration", "no_sector", "no_website", "no_current_certificate", "expired_certificate_only", "no_monitored_source")
) + ")"


@query(
    "enrichment_eligibility",
    f"""select count(*) filter (where {ANY_GAP}) eligible, count(*) filter (where {ANY_GAP} and recent_procurement) high_priority, """
    + ", ".join(
        f"count(*) filter (where q_{q}) {q}"
        for q in ("procurement_only", "no_registration", "no_sector", "no_website", "no_current_certificate", "expired_certificate_only", "no_monitored_source")
    )
    + " from live_q",
)
def enrichment_eligibility(t):
    return FL.eligibility_counts(FL.entity_flags(t, CLOCK))


ROLLUP = "id, slug, canonical_name, registration_number, website, entity_type, evidence_count, procurement_count, institution_count, latest_year, certificate_count, q_current_certificate has_current, listed, has_parent"


@query("entity_evidence_rollup", f"select {ROLLUP} from live_q")
def entity_evidence_rollup(t):
    return FL.entity_evidence_rollup(FL.entity_flags(t, CLOCK))


@query(
    "corpus_stats",
    """select count(*) evidence, count(*) filter (where lifecycle_state='current') as current, count(*) filter (where lifecycle_state in ('historical','superseded')) historical, count(*) filter (where lifecycle_state='expired') expired,
      count(*) filter (where lifecycle_state='disputed') disputed, count(*) filter (where lifecycle_state='expiring_soon') expiring, count(*) filter (where lifecycle_state='unknown_validity') unknown_validity,
      count(verifier_agency_id) agencies_linked, count(expiry_date) expiry_set, count(*)-count(expiry_date) expiry_missing, count(*) filter (where lifecycle_state in ('current','expiring_soon') and expiry_date is null) current_without_expiry,
      count(*) filter (where publication_state='published' and evidence_type='government_procurement_disclosure') official_disclosures,
      (select count(*) from entities where merged_into_id is null) entities, (select count(*) from live) published, (select count(*) from live e left join state s on s.entity_id=e.id where coalesce(s.lifecycle_state not in ('current','expiring_soon'),true)) without_current_certificate,
      (select count(*) from field_overrides where locked) field_overrides, (select count(*) from review_items where status='pending') review from evidence""",
)
def corpus_stats(t):
    return RP.corpus_stats(t)


@query(
    "entity_evidence_array",
    """select e.id entity_id, e.canonical_name, e.visibility, x.id evidence_id, x.evidence_type, x.lifecycle_state, strftime(x.issue_date,'%Y-%m-%d') issue_date, x.title
       from entities e left join vis x on x.entity_id=e.id where e.merged_into_id is null""",
)
def entity_evidence_array(t):
    return P.entity_evidence_array(t)


@query(
    "sector_names",
    "select ec.entity_id, string_agg(s.name, ', ' order by s.name) sector_names from entity_classifications ec join sectors s on s.id=ec.sector_id where ec.is_public group by 1",
)
def sector_names(t):
    return RP.sector_names(t)


# --- ranking and top-k -------------------------------------------------------
@query("evidence_rank", "select entity_id, id, rank from ranked")
def evidence_rank(t):
    from attestor.operators.common import linked_evidence

    rows = linked_evidence(t, ["evidence_type", "lifecycle_state", "issue_date"])
    return rows.select("entity_id", "id", R.evidence_rank(CLOCK).alias("rank"))


@query(
    "latest_evidence_per_entity",
    """select entity_id, evidence_id, rank, evidence_type, lifecycle_state, strftime(issue_date,'%Y-%m-%d') issue_date, issue_date_precision, strftime(expiry_date,'%Y-%m-%d') expiry_date, title, source_url, document_issuer, source_domain,
       verifier_agency_id, strftime(discovered_at,'%Y-%m-%d') discovered_at, agency_name, agency_slug, reported_level from latest""",
)
def latest_evidence_per_entity(t):
    return R.latest_evidence_per_entity(t, CLOCK)


LATEST_DISCLOSURE = """
select d.entity_id, d.id evidence_id, strftime(d.issue_date,'%Y-%m-%d') disclosure_date, d.source_url disclosure_url, d.title disclosure_title, v.value disclosure_level
 from (select *, row_number() over (partition by entity_id order by issue_date desc nulls last, updated_at desc, id desc) rn from vis where evidence_type='government_procurement_disclosure') d
 left join (select v.entity_id, coalesce(c.edited_value,c.normalized_value,c.raw_value) as value, row_number() over (partition by v.entity_id order by v.issue_date desc nulls last, r.started_at desc, r.id desc) rn
   from vis v join claims c on c.evidence_id=v.id join runs r on r.id=c.extraction_run_id where v.evidence_type='government_procurement_disclosure' and c.field_key='bee_level' and r.success) v on v.entity_id=d.entity_id and v.rn=1
 where d.rn=1"""


@query("latest_disclosure_per_entity", LATEST_DISCLOSURE)
def latest_disclosure_per_entity(t):
    return R.latest_disclosure_per_entity(t)


@query("latest_successful_run", "select evidence_id, run_id extraction_run_id, strftime(started_at,'%Y-%m-%d') started_at from latest_run")
def latest_successful_run(t):
    return C.latest_successful_run(t["extraction_runs"])


@query(
    "recent_updates",
    """select p.id, p.entity_id, p.evidence_id, p.event_type, p.summary, strftime(p.published_at,'%Y-%m-%d %H:%M:%S.%f') published_at, e.canonical_name entity_name, e.slug entity_slug
       from publication_events p join entities e on e.id=p.entity_id where e.visibility='public' order by p.published_at desc, p.id desc limit 25 offset 25""",
)
def recent_updates(t):
    return R.recent_updates(t, page=2)


EXPIRY = """(select '{0}' as mode, e.id, e.title, e.evidence_type, strftime(e.expiry_date,'%Y-%m-%d') expiry_date, e.lifecycle_state, c.entity_id, c.entity_name, c.entity_slug from evidence e left join confirmed c on c.evidence_id=e.id
  where e.publication_state='published' and e.lifecycle_state='{1}' order by e.expiry_date {2} nulls last, e.id desc, c.entity_id limit 100)"""


@query("expiring_or_expired", EXPIRY.format("expiring", "expiring_soon", "asc") + " union all " + EXPIRY.format("expired", "expired", "desc"))
def expiring_or_expired(t):
    a = R.expiring_or_expired(t, "expiring").withColumn("mode", F.lit("expiring"))
    return a.unionByName(R.expiring_or_expired(t, "expired").withColumn("mode", F.lit("expired")))


@query(
    "upcoming_expiries",
    "select id, title, strftime(expiry_date,'%Y-%m-%d') expiry_date from evidence_raw where publication_state='published' and expiry_date>=date '2001-01-01' order by evidence_raw.expiry_date, id limit 8",
)
def upcoming_expiries(t):
    return R.upcoming_expiries(t, CLOCK)


@query(
    "recently_updated_companies",
    f"""with disc as ({LATEST_DISCLOSURE}),
       top as (select e.id, e.slug, e.canonical_name, s.bee_level, s.lifecycle_state, s.published_at, coalesce(s.published_at,e.updated_at) changed_at, s.evidence_id
         from live e left join state s on s.entity_id=e.id order by changed_at desc, e.id desc limit 8)
       select t.id, t.slug, t.canonical_name, t.bee_level, t.lifecycle_state, strftime(t.published_at,'%Y-%m-%d') published_at, strftime(t.changed_at,'%Y-%m-%d') changed_at, t.evidence_id, r.evidence_type current_evidence_type,
         d.disclosure_date, d.disclosure_url, d.disclosure_title, d.disclosure_level, d.entity_id is not null has_disclosure
       from top t left join evidence_raw r on r.id=t.evidence_id left join disc d on d.entity_id=t.id""",
)
def recently_updated_companies(t):
    return R.recently_updated_companies(t)


@query(
    "home_evidence_feed",
    """select e.id, e.title, e.evidence_type, strftime(e.issue_date,'%Y-%m-%d') issue_date, e.source_url, e.lifecycle_state, strftime(e.updated_at,'%Y-%m-%d') updated_at, c.entity_id, c.entity_name, c.entity_slug,
        case when e.issue_date>=date '1999-01-01' then 0 when regexp_matches(e.source_url,'/(1999|2000|2001)(/|$)') then 0 else 1 end feed_group
       from evidence e left join confirmed c on c.evidence_id=e.id where e.publication_state='published' order by feed_group, coalesce(e.issue_date, date '0001-01-01') desc, e.updated_at desc, e.id desc limit 8""",
)
def home_evidence_feed(t):
    return R.home_evidence_feed(t, CLOCK)


@query(
    "stale_sources",
    "select id, url, strftime(last_checked_at,'%Y-%m-%d') last_checked_at from sources where enabled order by sources.last_checked_at nulls first, id limit 8",
)
def stale_sources(t):
    return R.stale_sources(t)


ROLLUP_RUNS = """select strftime(ts,'%Y-%m-%d') run_id, count(*) attempted, count(*) filter (where event_type<>'view') enriched, count(*) filter (where event_type='purchase') certificates_found,
 count(*) filter (where event_type='click') registrations_found, count(*) filter (where event_type='signup') domains_found, count(*) filter (where event_type='error') errors, strftime(max(ts),'%Y-%m-%d %H:%M:%S.%f') created_at from events group by 1"""


@query("enrichment_rollup", ROLLUP_RUNS)
def enrichment_rollup(t):
    return RP.enrichment_rollup(t["enrichment_results"])


@query("run_history", ROLLUP_RUNS.replace("run_id", "id", 1) + " order by max(ts) desc limit 20")
def run_history(t):
    return R.run_history(RP.enrichment_rollup(t["enrichment_results"]).withColumnRenamed("run_id", "id"))


@query("priority_queue", f"select {ROLLUP} from live_q where q_certificate_enrichment order by evidence_count desc, canonical_name, id limit 40")
def priority_queue(t):
    flags = FL.entity_flags(t, CLOCK)
    return R.priority_queue(FL.entity_evidence_rollup(flags), FL.research_queue(flags, "certificate_enrichment"))


@query(
    "research_priority",
    f"""select {ROLLUP}, 2000 newest_year, (case when listed then 40 else 0 end + case when entity_type='group' then 18 else 0 end + case when q_no_website then 0 else 15 end + case when q_no_registration then 0 else 8 end
       + case latest_year when 2000 then 18 when 1999 then 12 when 1998 then 6 else 0 end + least(25, procurement_count*3) + least(16, greatest(0, institution_count-1)*4) + least(10, evidence_count)
       + case when certificate_count=0 then 20 when not q_current_certificate then 12 else 0 end + case when has_parent then 4 else 0 end) score
       from live_q where {ANY_GAP} order by score desc, canonical_name, id limit 50""",
)
def research_priority(t):
    flags = FL.entity_flags(t, CLOCK)
    eligible = flags.filter(live_entity() & FL.enrichment_eligible())
    return R.research_priority(FL.entity_evidence_rollup(flags), eligible, CLOCK.as_of.year - 1)


@query(
    "page_after_key",
    """select id, canonical_name, (select greatest(count(*)-50,0) from live where id>20) remaining from live where id>20 order by id limit 50""",
)
def page_after_key(t):
    rows = t["entities"].filter(live_entity()).select("id", "canonical_name")
    return R.page_after_key(rows, "id", 20, 50)


# --- lifecycle ---------------------------------------------------------------
@query("classify_lifecycle", "select entity_id, evidence_id, lifecycle from decisions")
def classify_lifecycle(t):
    return L.classify_lifecycle(t["evidence_raw"], t["evidence_entity_links"], CLOCK)


@query(
    "dispute_reasons",
    """select f.entity_id, f.supporting_id supporting_evidence_id, case when f.top_issue is null then 'Multiple live certificates have no issue date; current record was not guessed.'
        when a.value<>b.value then 'Multiple live certificates share issue date '||strftime(f.top_issue,'%Y-%m-%d')||' with conflicting B-BBEE levels.'
        else 'Multiple live certificates share issue date '||strftime(f.top_issue,'%Y-%m-%d')||'; current record was not guessed.' end reason
       from facts f left join latest_val a on a.evidence_id=f.top_id and a.field_key='bee_level' left join latest_val b on b.evidence_id=f.next_id and b.field_key='bee_level' where f.disputed""",
)
def dispute_reasons(t):
    return L.dispute_reasons(t["evidence_raw"], t["evidence_entity_links"], L.evidence_levels(t), CLOCK)


@query(
    "current_state",
    """select entity_id, bee_level, scorecard_type, registration_number, evidence_id, verifier_agency_id, signatory_id, lifecycle_state, strftime(published_at,'%Y-%m-%d') published_at, coalesce(disputed,false) disputed from state""",
)
def current_state(t):
    return t["entity_current_state"].select(
        "entity_id", "bee_level", "scorecard_type", "registration_number", "evidence_id", "verifier_agency_id", "signatory_id", "lifecycle_state", "published_at", "disputed"
    )


@query(
    "refresh_expiries",
    """select d.entity_id, d.evidence_id, case when d.evidence_id%3=0 then 'current' else 'historical' end as before, d.lifecycle as after from decisions d join entities e on e.id=d.entity_id
       where e.merged_into_id is null and d.lifecycle<>case when d.evidence_id%3=0 then 'current' else 'historical' end""",
)
def refresh_expiries(t):
    """Changes against a stored state that was current for every third document."""
    before = t["evidence_raw"].select(
        F.col("id").alias("evidence_id"), F.when(F.col("id") % 3 == 0, "current").otherwise("historical").alias("lifecycle")
    )
    return L.refresh_expiries(t, before, CLOCK)


def stored_states(t):
    return t["evidence_raw"].select(F.col("id").alias("evidence_id"), F.when(F.col("id") % 3 == 0, "current").otherwise("historical").alias("lifecycle"))


@query(
    "refresh_expiries_counts",
    """select case when d.evidence_id%3=0 then 'current' else 'historical' end as before, d.lifecycle as after, count(*) updated from decisions d join entities e on e.id=d.entity_id
       where e.merged_into_id is null and d.lifecycle<>case when d.evidence_id%3=0 then 'current' else 'historical' end group by 1,2""",
)
def refresh_expiries_counts(t):
    return L.refresh_counts(L.refresh_expiries(t, stored_states(t), CLOCK))


@query(
    "refresh_expiries_reviews",
    """select 'conflicting_evidence' as type, case when f.top_issue is null then 'Multiple live certificates have no issue date; current record was not guessed.'
        when a.value<>b.value then 'Multiple live certificates share issue date '||strftime(f.top_issue,'%Y-%m-%d')||' with conflicting B-BBEE levels.'
        else 'Multiple live certificates share issue date '||strftime(f.top_issue,'%Y-%m-%d')||'; current record was not guessed.' end reason, 'high' severity, f.entity_id, f.supporting_id evidence_id
       from facts f join entities e on e.id=f.entity_id left join latest_val a on a.evidence_id=f.top_id and a.field_key='bee_level' left join latest_val b on b.evidence_id=f.next_id and b.field_key='bee_level'
       where f.disputed and e.merged_into_id is null and not exists (select 1 from review_items r where r.status='pending' and r.type='conflicting_evidence' and r.evidence_id=f.supporting_id)""",
)
def refresh_expiries_reviews(t):
    return L.refresh_reviews(t, CLOCK)


@query(
    "refresh_expiries_due",
    """select n.entity_id, n.evidence_id, b.lifecycle as before, n.lifecycle as after from decisions n join decisions_then b using (entity_id, evidence_id) join entities e on e.id=n.entity_id where e.merged_into_id is null and b.lifecycle<>n.lifecycle""",
)
def refresh_expiries_due(t):
    """Half a year of changes, from the companies that the index names for it."""
    return L.refresh_due(t, L.transition_index(t, CLOCK), date(2000, 7, 1), CLOCK)


@query(
    "expiry_status",
    """select id, case when expiry_date is null then 'unknown_validity' when expiry_date<date '2001-01-01' then 'expired' when expiry_date<=date '2001-01-01'+90 then 'expiring_soon' else 'current' end status from evidence_raw""",
)
def expiry_status(t):
    return t["evidence_raw"].select(
        "id", L.expiry_status(F.col("expiry_date"), F.lit("current"), F.lit(CLOCK.as_of), CLOCK.soon_days).alias("status")
    )


# --- claims ------------------------------------------------------------------
@query("working_claims", "select evidence_id, extraction_run_id, field_key, value from working")
def working_claims(t):
    return C.working_claims(t).select("evidence_id", "extraction_run_id", "field_key", "value")


@query(
    "claims_wide",
    """select evidence_id, """
    + ", ".join(f"max(value) filter (where field_key='{f}') {f}" for f in ("bee_level", "registration_number", "verification_agency", "tender_number", "enterprise_class"))
    + " from latest_val where field_key in ('bee_level','registration_number','verification_agency','tender_number','enterprise_class') group by evidence_id",
)
def claims_wide(t):
    return C.claims_wide(t, ["bee_level", "registration_number", "verification_agency", "tender_number", "enterprise_class"])


@query(
    "apply_claim_edits",
    """with ed as (select o_orderkey evidence_id, case o_orderkey%3 when 0 then 'bee_level' when 1 then 'registration_number' else 'trading_name' end field_key,
         case o_orderkey%3 when 0 then ' Level '||(1+o_orderkey%8)||' ' when 1 then '2001/'||lpad((o_orderkey%1000000)::varchar,6,'0')||'/07' else 'The Brand '||o_orderkey||' Ltd' end edit from orders where o_orderkey%4=0),
       ok as (select ed.*, r.run_id from ed join latest_run r on r.evidence_id=ed.evidence_id)
       select coalesce(w.evidence_id, ok.evidence_id) evidence_id, coalesce(w.extraction_run_id, ok.run_id) extraction_run_id, coalesce(w.field_key, ok.field_key) field_key, coalesce(trim(ok.edit), w.value) as value,
         case when w.id is not null then w.normalized_value when ok.field_key='bee_level' then (1+ok.evidence_id%8)::varchar when ok.field_key='registration_number' then replace(ok.edit,'/','') else 'brand '||ok.evidence_id end normalized_value,
         case when w.id is null then 1.0::double else w.confidence end confidence, ok.edit is not null edited
       from working w full join ok on ok.evidence_id=w.evidence_id and ok.field_key=w.field_key""",
)
def apply_claim_edits(t):
    k = F.col("o_orderkey")
    field = F.when(k % 3 == 0, "bee_level").when(k % 3 == 1, "registration_number").otherwise("trading_name")
    edit = (
        F.when(k % 3 == 0, F.concat(F.lit(" Level "), (1 + k % 8).cast("string"), F.lit(" ")))
        .when(k % 3 == 1, F.concat(F.lit("2001/"), F.lpad((k % 1000000).cast("string"), 6, "0"), F.lit("/07")))
        .otherwise(F.concat(F.lit("The Brand "), k.cast("string"), F.lit(" Ltd")))
    )
    edits = t.raw("orders").filter(k % 4 == 0).select(k.alias("evidence_id"), field.alias("field_key"), edit.alias("edit"))
    return C.apply_claim_edits(t, edits)
