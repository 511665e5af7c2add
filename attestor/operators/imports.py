"""A batch of corpus items as one change set: every table that the import adds to or changes.

Items of a batch are taken together.  An item that a stored company answers for
(by registration, name, then alias) goes to that company.  The others are
grouped: items with one registration, items with one name, and an item whose
name another item of the batch gives as an alias are one company, over any
number of steps.  A group that meets an item of a stored company joins that
company, otherwise one company is made for it, with the values of its items in
their order.  Nothing depends on which task reads which item.

Edge cases: blank names, joint ventures and names that are no company names are
held with a reason, unless, for the latter, a company of the batch answers for
them; a null array is an empty one; an item without procurement, evidence or
sources adds none; several items for one key give one row, that of the smallest
ordinal; an empty batch gives empty tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from attestor.functions import dates as D
from attestor.functions import names as N
from attestor.functions import suppliers as S
from attestor.operators.common import computed, join_known, spread, stored
from attestor.operators.documents import disclosure_identity
from attestor.operators.graph import components, join_heavy
from attestor.operators.resolve import find_existing_entity, unmerged
from attestor.schemas import CORPUS_ITEM, NON_INDUSTRY_SECTORS, PROCUREMENT

# --- fixed values ------------------------------------------------------------
LISTED = "sec_jse"
OUTCOME_NOTES = {
    "unsuccessful": "The named bidder was recorded in an official evaluation/result table; award is not implied.",
    "responded": "The named bidder was recorded as having responded to this procurement.",
}
AWARDED_NOTE = "The named supplier was recorded in an official awarded-tender or bidder-result publication."
DISCLOSURE_NOTES = [
    "Official government procurement disclosure.",
    "The B-BBEE level is exactly as reported in the source for this dated procurement.",
    "This is not a current verification certificate.",
    "No certificate number, expiry date or verification agency is inferred.",
]
# -----------------------------------------------------------------------------


def _text(col: str) -> Column:
    return F.nullif(F.trim(col), F.lit(""))


def _first(value: Column, order: Column) -> Column:
    """The first value that is not null."""
    return F.min_by(value, F.when(value.isNotNull(), order))


def prepared(items: DataFrame) -> DataFrame:
    """Items with clean names, comparable keys and the aliases they state."""
    known = {f.name: f.dataType for f in CORPUS_ITEM.fields} | {"allowHistoricalProcurement": "boolean"}
    columns = [F.col(c) if c in items.columns else F.lit(None).cast(kind).alias(c) for c, kind in known.items()]
    # every step in columns of its own: what a step reads would be worked out again wherever it is read
    rows = computed(spread(items.select("ordinal", *columns), "ordinal"), _o=S.clean_spelling(F.col("canonicalName")), _reg=N.normalize_registration(F.col("registrationNumber")))
    rows = computed(rows, _parts=F.struct(*[c.alias(n) for n, c in S.supplier_parts(F.col("_o")).items()]))
    parts = {n: F.col(f"_parts.{n}") for n in ("unit", "whole", "legal_part", "trade_part")}
    rows = computed(rows, _n=F.struct(*[c.alias(n) for n, c in S.supplier_names(F.col("_o"), **parts).items()]))
    rows = computed(rows, name=F.coalesce("_n.canonical", F.lit("")), _key=N.normalize_name(F.col("_n.canonical")), _trade_key=N.normalize_name(F.col("_n.trade")))
    trade = F.when(F.col("_trade_key") != F.col("_key"), F.col("_n.trade"))
    rows = computed(rows, name_key=F.coalesce("_key", F.lit("")), reg_key=F.nullif("_reg", F.lit("")), _c=F.struct(trade.alias("trading_name"), F.col("_n.owner").alias("parent_name"), F.array_compact(F.array(trade)).alias("aliases")))
    rows = rows.select(
        "*",
        F.coalesce(_text("tradingName"), F.col("_c.trading_name")).alias("trading"),
        F.coalesce(_text("legalName"), "_o", "name").alias("legal"),
        F.coalesce(_text("parentName"), F.col("_c.parent_name")).alias("parent"),
    )
    stated = F.concat(F.coalesce("aliases", F.array().cast("array<string>")), F.coalesce("_c.aliases", F.array().cast("array<string>")), F.array("_o"))
    stated = F.filter(F.transform(stated, lambda a: F.trim(a)), lambda a: F.coalesce(a != "", F.lit(False)) & (N.normalize_name(a) != F.col("name_key")))
    return rows.select("*", stated.alias("stated")).drop("_c", "_o", "_reg", "_parts", "_n", "_key", "_trade_key")


def disclosed(items: DataFrame) -> DataFrame:
    """(ordinal, position, row, date): procurement rows of fetchable URLs with the date they state or their source states."""
    rows = items.select("ordinal", "name", F.posexplode("procurement").alias("position", "row")).select("*", "row.*").drop("row")
    rows = rows.withColumn("fetchable", N.fetchable_url(F.col("sourceUrl")))
    given = _text("awardDate")
    plain = F.when(given.rlike(r"^\d{4}(-\d{2}){0,2}$"), D.plain_parts(given))
    blobs = D.date_blobs(given, F.col("sourceTitle"), F.col("sourceUrl"))
    rows = computed(rows, _given=given, _plain=plain, **blobs)
    found = F.coalesce("_plain", D.explicit_date(F.col("_given")), D.inferred_parts(F.col("sourceTitle"), F.col("sourceUrl")))
    dated = computed(computed(rows, _found=found), d=D.describe_parts(F.col("_found")))
    return dated.select(
        "ordinal",
        "name",
        "position",
        F.trim("sourceUrl").alias("source_url"),
        "fetchable",
        F.col("tenderNumber").alias("tender_number"),
        F.col("beeLevel").alias("bee_level_raw"),
        F.coalesce(N.normalize_level(F.col("beeLevel")), F.col("beeLevel")).alias("bee_level"),
        F.col("governmentInstitution").alias("institution"),
        F.col("enterpriseClass").alias("enterprise_class"),
        F.col("tenderDescription").alias("tender_description"),
        F.col("contractPeriod").alias("contract_period"),
        F.col("contractAmount").alias("contract_amount"),
        F.col("sourceTitle").alias("source_title"),
        "outcome",
        F.col("d.iso").alias("evidence_date"),
        F.col("d.precision").alias("date_precision"),
        F.when(F.col("d.stated"), F.col("d.label")).otherwise(F.col("awardDate")).alias("date_raw"),
        F.col("d.year").alias("year"),
    )


def _batch_keys(rows: DataFrame, kind: str) -> DataFrame:
    """(key, ordinal) of the registrations, names or aliases that can answer for another item."""
    if kind == "registration":
        return rows.filter("answers_reg").select(F.col("reg_key").alias("key"), "ordinal")
    if kind == "name":
        return rows.filter("standalone").select(F.col("name_key").alias("key"), "ordinal")
    alias = F.explode(F.transform(F.array_compact(F.array_append("stated", F.when(F.col("standalone"), F.col("trading")))), N.normalize_alias))
    return rows.filter("standalone or anchor").select("ordinal", alias.alias("key")).filter("key <> ''").distinct()


def decided(tables, items: DataFrame, recent_year: int) -> DataFrame:
    """Prepared items with outcome, reason and company."""
    procured = disclosed(items).groupBy("ordinal").agg(F.max("year").alias("newest_year"))
    wanted = items.select("ordinal", "name", F.col("registrationNumber").alias("registration"))
    found = find_existing_entity(tables, wanted).select("ordinal", F.col("entity_id").cast("string").alias("stored_id"), "via")
    own = tables["entities"].select(F.col("id").cast("string").alias("stored_id"), F.nullif(F.trim("registration_number"), F.lit("")).alias("stored_reg"))
    rows = items.join(found, "ordinal").join(procured, "ordinal", "left").transform(join_known, own, ["stored_id"], "ordinal")
    name, missing = F.col("name"), F.col("stored_id").isNull()
    rows = computed(rows, _t=N.collapse(name), _given=N.collapse(F.col("canonicalName")))
    rows = computed(rows, _core=S.core_words(F.col("_t")))
    rows = computed(
        rows,
        joint=S.joint_venture(F.col("_t")) | S.joint_venture(F.col("_given")),
        bad=S.malformed(F.col("_t"), F.col("_core")) & ~S.short_legal_name(F.col("_t"), F.col("registrationNumber")),
        valid_reg=F.when(~N.is_verifier_registration(F.col("registrationNumber")), N.format_registration(F.col("registrationNumber"))),
    ).drop("_t", "_given", "_core")
    only_procurement = (F.coalesce(F.size("procurement"), F.lit(0)) > 0) & (F.coalesce(F.size("evidence"), F.lit(0)) <= 0)
    old = only_procurement & ~(F.coalesce("newest_year", F.lit(0)) >= recent_year) & ~F.coalesce("allowHistoricalProcurement", F.lit(False))
    held = F.when(F.length(name) < 2, "no_name").when(F.col("joint"), "joint_venture").when(missing & F.col("bad"), "malformed").when(missing & old, "old_procurement")
    rows = rows.select("*", held.alias("held"))
    rows = rows.select(
        "*",
        (F.col("held").isNull() & missing).alias("standalone"),
        (F.col("held").isNull() & ~missing).alias("anchor"),
        F.coalesce(F.col("held").isin("malformed", "old_procurement"), F.lit(False)).alias("late"),
    )
    # a stored company gains a registration only where it has none and the stated one is valid
    gains = F.col("anchor") & F.col("stored_reg").isNull() & F.col("valid_reg").isNotNull()
    rows = stored(rows.withColumn("answers_reg", F.col("reg_key").isNotNull() & (F.col("standalone") | gains)), "import-rows")

    by_reg, by_name, by_alias = (_batch_keys(rows, k) for k in ("registration", "name", "alias"))
    first_reg, first_name = (k.groupBy("key").agg(F.min("ordinal").alias("first")) for k in (by_reg, by_name))
    edges = [join_heavy(k, f, "key").select(F.col("ordinal").alias("u"), F.col("first").alias("v")) for k, f in ((by_reg, first_reg), (by_name, first_name), (by_alias, first_name))]
    groups = components(edges[0].unionByName(edges[1]).unionByName(edges[2]).filter("v is not null"))
    member = rows.filter("standalone or anchor").select("ordinal", "standalone", "stored_id", "name_key", "reg_key")
    member = member.join(groups.withColumnRenamed("node", "ordinal"), "ordinal", "left").withColumn("root", F.coalesce("root", "ordinal"))
    order = F.col("ordinal")
    first_key = F.min_by(F.concat_ws("|", F.lit("ent:v1"), F.coalesce("reg_key", F.lit("")), "name_key"), F.when(F.col("standalone"), order))
    group = member.groupBy("root").agg(
        _first(F.when(~F.col("standalone"), F.col("stored_id")), order).alias("group_stored"),
        F.min(F.when(F.col("standalone"), order)).alias("founder"),
        F.concat(F.lit("ent_"), F.substring(F.sha2(first_key, 256), 1, 20)).alias("group_new"),
    )
    member = stored(join_heavy(member, group, "root").select("ordinal", F.coalesce("stored_id", "group_stored", "group_new").alias("entity_id"), "founder", "group_stored"), "import-members")

    def answers(keys: DataFrame, name: str) -> DataFrame:
        """The company of the first item with each key."""
        return keys.join(member, "ordinal").groupBy("key").agg(F.min_by("entity_id", "ordinal").alias(name))

    late = rows.filter("late").select("ordinal", "name_key", "reg_key")
    for keys, own, name in ((by_reg, "reg_key", "_reg"), (by_name, "name_key", "_name"), (by_alias, "name_key", "_alias")):
        late = join_known(late, answers(keys, name).withColumnRenamed("key", own), [own], "ordinal")
    late = late.select("ordinal", F.coalesce("_reg", "_name", "_alias").alias("late_id"))
    out = rows.join(member, "ordinal", "left").join(late, "ordinal", "left")
    entity = F.coalesce("entity_id", "late_id")
    made = F.col("standalone") & F.col("group_stored").isNull() & (F.col("ordinal") == F.col("founder"))
    outcome = F.when(entity.isNull(), "held").when(made, "created").otherwise("matched")
    way = F.when(F.col("anchor"), F.col("via")).when(entity.isNotNull() & ~made, "batch")
    return out.select(
        *items.columns, "newest_year", "valid_reg", entity.alias("entity_id"), outcome.alias("outcome"), F.when(entity.isNull(), F.col("held")).alias("held_reason"), way.alias("via"),
        F.coalesce(F.col("standalone") & F.col("group_stored").isNull(), F.lit(False)).alias("new_company"),
    )


def new_entities(tables, rows: DataFrame) -> DataFrame:
    """One company per group of items: values of its first item, then of the others where those are blank."""
    order = F.col("ordinal")
    site = F.when(F.col("website").rlike("(?i)^https?://[^/]"), F.trim("website"))
    is_first = F.col("outcome") == "created"
    registration = F.when(is_first, _text("registrationNumber")).otherwise(F.col("valid_reg"))
    made = rows.filter("new_company").groupBy(F.col("entity_id").alias("id")).agg(
        F.min("ordinal").alias("ordinal"),
        _first(F.when(is_first, F.col("name")), order).alias("canonical_name"),
        _first(F.when(is_first, F.col("name_key")), order).alias("normalized_name"),
        _first(F.col("legal"), order).alias("legal_name"),
        _first(F.col("trading"), order).alias("trading_name"),
        _first(registration, order).alias("registration_number"),
        _first(F.when(is_first, _text("website")).otherwise(site), order).alias("website"),
        _first(F.when(is_first, F.coalesce("entityType", F.lit("company"))), order).alias("entity_type"),
    )
    base = made.withColumn("base", N.slugify(F.col("canonical_name")))
    # a number after the base is taken if a stored company has it, so numbering starts after the largest one taken
    taken = tables["entities"].select("slug").filter(F.col("slug").isNotNull()).select(
        F.explode(F.array_distinct(F.array(F.struct(F.col("slug").alias("base"), F.lit(1).alias("n")), F.struct(F.regexp_replace("slug", r"-\d{1,9}$", "").alias("base"), F.coalesce(F.regexp_extract("slug", r"-(\d{1,9})$", 1).try_cast("int"), F.lit(1)).alias("n"))))).alias("t")
    )
    taken = taken.groupBy("t.base").agg(F.max("t.n").alias("taken"), F.max(F.col("t.n") == 1).alias("plain"))
    numbered = base.join(taken, "base", "left").withColumn("rank", F.row_number().over(W.partitionBy("base").orderBy("ordinal")))
    free = ~F.coalesce("plain", F.lit(False))
    after = F.when(free, F.col("rank") - 1).otherwise(F.col("rank")) + F.greatest(F.coalesce("taken", F.lit(1)), F.lit(1))
    slug = F.when(free & (F.col("rank") == 1), F.col("base")).otherwise(F.concat_ws("-", "base", after.cast("string")))
    return numbered.select(
        "id", slug.alias("slug"), "canonical_name", "normalized_name", "legal_name", "trading_name", "registration_number",
        F.nullif(N.normalize_registration(F.col("registration_number")), F.lit("")).alias("registration_number_normalized"),
        "website", "entity_type", F.lit("draft").alias("visibility"), F.lit("review_only").alias("automation_state"),
    )


def filled_entities(tables, rows: DataFrame) -> DataFrame:
    """(entity_id, field, value): null fields of stored companies that items of the batch fill, the first item first."""
    order = F.col("ordinal")
    offers = rows.filter("entity_id is not null and not new_company").groupBy("entity_id").agg(
        _first(F.col("valid_reg"), order).alias("new_reg"),
        _first(F.when(F.col("website").rlike("(?i)^https?://[^/]"), F.col("website")), order).alias("new_site"),
        _first(_text("legalName"), order).alias("new_legal"),
        _first(_text("tradingName"), order).alias("new_trading"),
    )
    own = tables["entities"].select(F.col("id").cast("string").alias("entity_id"), "registration_number", "website", "legal_name", "trading_name")
    holders = unmerged(tables).groupBy(F.col("registration_number_normalized").alias("reg_key")).agg(F.min(F.col("id").cast("string")).alias("low"), F.max(F.col("id").cast("string")).alias("high"))
    j = offers.join(own, "entity_id").withColumn("reg_key", N.normalize_registration(F.col("new_reg"))).transform(join_known, holders, ["reg_key"], "entity_id")
    clash = F.coalesce((F.col("low") != F.col("entity_id")) | (F.col("high") != F.col("entity_id")), F.lit(False))

    def fill(field: str, offered: Column) -> Column:
        return F.when(F.col(field).isNull() & offered.isNotNull(), F.struct(F.lit(field).alias("field"), offered.alias("value")))

    fills = F.array(fill("registration_number", F.when(~clash, F.col("new_reg"))), fill("website", F.col("new_site")), fill("legal_name", F.col("new_legal")), fill("trading_name", F.col("new_trading")))
    return j.select("entity_id", F.explode(F.array_compact(fills)).alias("f")).select("entity_id", "f.*")


def new_aliases(tables, rows: DataFrame) -> DataFrame:
    """(entity_id, alias, normalized_alias, alias_type): stated aliases and trading names that a company does not have yet."""
    some = rows.filter("entity_id is not null")
    stated = some.select("ordinal", "entity_id", F.posexplode("stated").alias("position", "alias")).withColumn("alias_type", F.lit("other"))
    traded = some.filter("outcome = 'created'").select("ordinal", "entity_id", F.lit(-1).alias("position"), F.col("trading").alias("alias"), F.lit("trading").alias("alias_type"), "name")
    traded = traded.filter(F.col("alias").isNotNull() & (N.normalize_alias(F.col("alias")) != N.normalize_alias(F.col("name")))).drop("name")
    both = stated.unionByName(traded).withColumn("normalized_alias", N.normalize_alias(F.col("alias")))
    first = F.min(F.struct("ordinal", "position", "alias", "alias_type")).alias("a")
    had = tables["entity_aliases"].select(F.col("entity_id").cast("string").alias("entity_id"), "normalized_alias")
    return both.groupBy("entity_id", "normalized_alias").agg(first).select("entity_id", "a.alias", "normalized_alias", "a.alias_type").join(had, ["entity_id", "normalized_alias"], "left_anti")


def new_classifications(tables, rows: DataFrame) -> DataFrame:
    """(entity_id, sector_id, classification_type) of known sectors and listings."""
    some = rows.filter("entity_id is not null")
    sector = some.select("entity_id", F.explode("sectorIds").alias("sector_id"), F.lit("sector").alias("classification_type")).filter(~F.col("sector_id").isin(NON_INDUSTRY_SECTORS))
    listed = some.filter("jseListed").select("entity_id", F.lit(LISTED).alias("sector_id"), F.lit("listing").alias("classification_type"))
    known = tables["sectors"].select(F.col("id").alias("sector_id"))
    had = tables["entity_classifications"].select(F.col("entity_id").cast("string").alias("entity_id"), "sector_id", "classification_type")
    return sector.unionByName(listed).distinct().join(known, "sector_id", "left_semi").join(had, ["entity_id", "sector_id", "classification_type"], "left_anti").select("entity_id", "sector_id", "classification_type")


def new_parents(tables, rows: DataFrame) -> DataFrame:
    """(source_entity_id, target_entity_id): parents by name, among stored companies first and then in the batch."""
    asked = rows.filter("entity_id is not null and parent is not null").select("ordinal", "entity_id", F.col("parent").alias("name"), F.lit(None).cast("string").alias("registration"))
    known = find_existing_entity(tables, asked.select("ordinal", "name", "registration")).select("ordinal", F.col("entity_id").cast("string").alias("_stored"))
    named = rows.filter("entity_id is not null").groupBy("name_key").agg(F.min_by("entity_id", "ordinal").alias("_named"))
    aliased = new_aliases(tables, rows).groupBy(F.col("normalized_alias").alias("name_key")).agg(F.min("entity_id").alias("_aliased"))
    found = asked.withColumn("name_key", N.normalize_name(F.col("name"))).join(known, "ordinal").join(named, "name_key", "left").join(aliased, "name_key", "left")
    edges = found.select(F.col("entity_id").alias("source_entity_id"), F.coalesce("_stored", "_named", "_aliased").alias("target_entity_id")).distinct()
    had = tables["entity_relationships"].filter("relationship_type = 'parent'").select(F.col("source_entity_id").cast("string").alias("source_entity_id"), F.col("target_entity_id").cast("string").alias("target_entity_id"))
    return edges.filter("target_entity_id <> source_entity_id").join(had, ["source_entity_id", "target_entity_id"], "left_anti").withColumns({"relationship_type": F.lit("parent"), "public_status": F.lit("public")})


def wanted_sources(rows: DataFrame) -> DataFrame:
    """(ordinal, entity_id, rank, url, source_type, frequency): what each item asks to be watched."""
    some = rows.filter("entity_id is not null")
    procured = F.coalesce(F.size("procurement"), F.lit(0)) > 0

    def watch(url: Column, kind: Column, often: Column, rank: int) -> Column:
        return F.struct(url.alias("url"), kind.alias("source_type"), often.alias("frequency"), F.lit(rank).alias("rank"))

    none = F.array().cast("array<struct<url:string,source_type:string,frequency:string,rank:int>>")
    asked = F.transform(F.coalesce("sources", F.array().cast(CORPUS_ITEM["sources"].dataType)), lambda x: watch(x["url"], F.coalesce(x["sourceType"], F.lit("other")), F.coalesce(x["frequency"], F.lit("monthly")), 0))
    papers = F.transform("evidence", lambda e: watch(e["url"], F.lit("direct_evidence_url"), F.lit("monthly"), 1))
    site = F.array(watch(F.col("website"), F.lit("other"), F.lit("monthly"), 2))
    tenders = F.transform("procurement", lambda p: watch(p["sourceUrl"], F.lit("government_source"), F.lit("manual"), 1))
    others = F.when(procured, F.coalesce(tenders, none)).otherwise(F.concat(F.coalesce(papers, none), site))
    return some.select("ordinal", "entity_id", F.posexplode(F.concat(asked, others)).alias("position", "s")).select("ordinal", "entity_id", "position", "s.*")


def new_sources(tables, rows: DataFrame) -> DataFrame:
    """Sources not watched yet, one for each canonical URL; private and unreadable addresses give none."""
    offered = wanted_sources(rows).filter(N.fetchable_url(F.col("url"))).withColumn("canonical_url", N.canonical_url(F.trim("url")))
    first = F.min(F.struct("ordinal", "position", "entity_id", F.trim("url").alias("url"), "source_type", "frequency")).alias("s")
    had = tables["monitored_sources"].select(N.canonical_url(F.col("url")).alias("canonical_url")).distinct()
    new = offered.groupBy("canonical_url").agg(first).join(had, "canonical_url", "left_anti")
    return new.select(F.concat(F.lit("src_"), F.substring(F.sha2("canonical_url", 256), 1, 20)).alias("id"), "s.entity_id", "s.url", "canonical_url", N.url_host(F.col("canonical_url")).alias("domain"), "s.source_type", "s.frequency")


def notes(outcome: Column) -> Column:
    """What the public may read into a disclosure of this outcome."""
    said = F.coalesce(*[F.when(outcome == k, F.lit(v)) for k, v in OUTCOME_NOTES.items()], F.lit(AWARDED_NOTE))
    return F.concat_ws(" ", *[F.lit(x) for x in DISCLOSURE_NOTES], said)


def new_disclosures(tables, rows: DataFrame) -> dict[str, DataFrame]:
    """Evidence, locations, links and claims of procurement rows, and what is up for publication."""
    from attestor.operators.maintain import disclosure_claims

    owner = rows.filter("entity_id is not null").select("ordinal", "entity_id", F.coalesce("publishIfSafe", F.lit(True)).alias("publish"))
    stated = disclosed(rows.filter("entity_id is not null")).filter("fetchable").withColumnRenamed("name", "canonical_name").join(owner, "ordinal")
    stated = disclosure_identity(stated)
    known = tables["evidence_raw"].groupBy(F.col("content_hash").alias("identity_hash")).agg(F.min(F.col("id").cast("string")).alias("stored_evidence"), F.max(F.col("publication_state") == "published").alias("is_published"))
    stated = stored(stated.join(known.hint("merge"), "identity_hash", "left").withColumn("evidence_id", F.coalesce("stored_evidence", F.concat(F.lit("evd_"), F.substring("identity_hash", 1, 24)))), "import-disclosures")
    others = [c for c in stated.columns if c not in ("identity_hash", "ordinal", "position")]
    new = stated.filter("stored_evidence is null").groupBy("identity_hash").agg(F.min(F.struct("ordinal", "position", *others)).alias("d")).select("identity_hash", "d.*")
    level = F.coalesce(F.concat(F.lit("Level "), N.normalize_level(F.col("bee_level_raw")), F.lit(" reported")), F.lit("B-BBEE level as reported"))
    title = F.concat(F.col("canonical_name"), F.lit(" — "), level, F.lit(" in "), F.coalesce("institution", F.lit("")), F.coalesce(F.concat(F.lit(" "), F.col("tender_number")), F.lit("")))
    evidence = new.select(
        F.col("evidence_id").alias("id"), F.lit(PROCUREMENT).alias("evidence_type"), F.coalesce(D.polish_title(_text("source_title")), title).alias("title"), "source_url",
        N.url_host(F.col("source_url")).alias("source_domain"), F.col("identity_hash").alias("content_hash"), F.col("evidence_date").alias("issue_date"), F.col("date_raw").alias("issue_date_raw"),
        F.col("date_precision").alias("issue_date_precision"), F.col("institution").alias("document_issuer"), F.lit("unpublished").alias("publication_state"), F.lit("discovered").alias("lifecycle_state"), notes(F.col("outcome")).alias("public_notes"),
    )
    had = tables["evidence_entity_links"].select(F.col("evidence_id").cast("string").alias("evidence_id"), F.col("entity_id").cast("string").alias("entity_id"))
    first = F.min(F.struct("ordinal", "canonical_name", "institution", F.col("stored_evidence").isNotNull().alias("again"))).alias("l")
    links = stated.groupBy("evidence_id", "entity_id").agg(first).join(had.hint("merge"), ["evidence_id", "entity_id"], "left_anti").select(
        "evidence_id", "entity_id", F.lit("confirmed").alias("link_state"), F.when(~F.col("l.again"), F.col("l.canonical_name")).otherwise("import").alias("extracted_name"), F.lit("import").alias("match_method"), F.lit(1.0).alias("confidence"),
        F.when(F.col("l.again"), "Procurement disclosure linked on re-import.").otherwise(F.concat(F.lit("Official procurement disclosure from "), F.coalesce("l.institution", F.lit("")), F.lit("."))).alias("reason"),
    )
    claims = disclosure_claims(new.withColumn("evidence_date", F.coalesce("evidence_date", "date_raw")))
    approvals = stated.filter(F.col("publish") & ~F.coalesce("is_published", F.lit(False))).select("evidence_id", "entity_id").distinct()
    return {"evidence": evidence, "locations": evidence.select(F.col("id").alias("evidence_id"), F.col("source_url").alias("url")), "links": links, "claims": claims, "approvals": approvals}


def import_batch(tables, items: DataFrame, recent_year: int = 2024) -> dict[str, DataFrame]:
    """Every table that a batch of corpus items (ordinal and the columns of the corpus) adds to.

    decisions; entities and filled; aliases; classifications; relationships;
    sources; evidence, locations, links and claims; approvals, which
    ``publish_batch`` takes; public: companies to be shown once an approval of
    theirs has been accepted.
    """
    rows = stored(decided(tables, stored(prepared(items), "import-items"), recent_year), "import-decisions")
    shown = F.coalesce(F.size("evidence") > 0, F.lit(False)) | (F.coalesce(F.size("procurement"), F.lit(0)) <= 0) | F.coalesce(F.col("newest_year") >= recent_year, F.lit(False)) | F.coalesce("allowHistoricalProcurement", F.lit(False))
    return {
        "decisions": rows.select("ordinal", "name", "outcome", "held_reason", "entity_id", "via"),
        "entities": new_entities(tables, rows),
        "filled": filled_entities(tables, rows),
        "aliases": new_aliases(tables, rows),
        "classifications": new_classifications(tables, rows),
        "relationships": new_parents(tables, rows),
        "sources": new_sources(tables, rows),
        **new_disclosures(tables, rows),
        "public": rows.filter(F.col("entity_id").isNotNull() & shown).select("entity_id").distinct(),
    }


def applied(tables, out: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The tables after an import, with ids as text: what a second import of the same items adds nothing to."""
    def text(name: str, *ids: str) -> DataFrame:
        return tables[name].withColumns({c: F.col(c).cast("string") for c in ids})

    def with_rows(name: str, rows: DataFrame, *ids: str) -> DataFrame:
        return text(name, *ids).unionByName(rows, allowMissingColumns=True)

    fields = ["registration_number", "website", "legal_name", "trading_name"]
    fills = out["filled"].groupBy(F.col("entity_id").alias("id")).agg(*[F.max(F.when(F.col("field") == f, F.col("value"))).alias(f"_{f}") for f in fields])
    kept = text("entities", "id", "merged_into_id").join(fills, "id", "left").withColumns({f: F.coalesce(f, f"_{f}") for f in fields}).drop(*[f"_{f}" for f in fields])
    kept = kept.withColumn("registration_number_normalized", F.nullif(N.normalize_registration(F.col("registration_number")), F.lit("")))
    evidence = out["evidence"].withColumn("issue_date", F.col("issue_date").try_cast("date")) if "issue_date" in tables["evidence_raw"].columns else out["evidence"]
    return {
        **{name: tables[name] for name in tables},
        "entities": kept.unionByName(out["entities"], allowMissingColumns=True),
        "entity_aliases": with_rows("entity_aliases", out["aliases"], "entity_id"),
        "entity_classifications": with_rows("entity_classifications", out["classifications"], "entity_id"),
        "entity_relationships": with_rows("entity_relationships", out["relationships"], "source_entity_id", "target_entity_id"),
        "monitored_sources": with_rows("monitored_sources", out["sources"], "id", "entity_id"),
        "evidence_raw": with_rows("evidence_raw", evidence, "id"),
        "evidence_source_locations": with_rows("evidence_source_locations", out["locations"], "evidence_id"),
        "evidence_entity_links": with_rows("evidence_entity_links", out["links"], "evidence_id", "entity_id"),
    }
