"""A batch of identity patches, with the result of applying them one after the other.

What a patch finds may depend on those before it: a number they set, replaced
or freed, an alias they added.  Each round judges all patches at once, each
against what the round before accepted of patches with a smaller ordinal.  What
comes before a patch is found in one ordered pass over each key, never by pairs,
so a number or name that many offer and many hold costs their sum.  After a round every patch
is right whose own dependencies were, so rounds end after the longest chain of
dependent patches, with the result of the serial loop, and the state between
rounds is only the accepted numbers and aliases.

Edge cases: of several companies with one key the smallest id is found; a patch
that finds no company changes nothing; null and blank fields offer nothing; of
several patches that fill one field or add one row the first does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from attestor.functions import names as N
from attestor.operators.common import computed, join_known, spread, stored
from attestor.operators.resolve import unmerged
from attestor.schemas import NON_INDUSTRY_SECTORS

LISTED = "sec_jse"
FIRST, LAST = -(1 << 62), 1 << 62
PATCH = {
    "name": "string",
    "registration": "string",
    "replace_if": "string",
    "website": "string",
    "legal_name": "string",
    "trading_name": "string",
    "aliases": "array<string>",
    "sectors": "array<string>",
    "listed": "boolean",
    "parent": "string",
    "sources": "array<struct<url:string,source_type:string,frequency:string>>",
}
NUMBERS = "ordinal long, entity_id string, reg_key string"
ALIASES = "ordinal long, entity_id string, name_key string"


def prepared(patches: DataFrame) -> DataFrame:
    """Patches with every column of ``PATCH`` and comparable keys."""
    columns = [F.col(c) if c in patches.columns else F.lit(None).cast(kind).alias(c) for c, kind in PATCH.items()]
    some = lambda c: F.nullif(F.trim(c), F.lit(""))
    rows = spread(patches.select(F.col("ordinal").cast("long").alias("ordinal"), *columns), "ordinal")
    rows = rows.withColumns({c: some(c) for c in ("name", "registration", "legal_name", "trading_name", "parent")})
    rows = computed(
        rows,
        name_key=N.normalize_name(F.col("name")),
        parent_key=N.normalize_name(F.col("parent")),
        reg_key=F.nullif(N.normalize_registration(F.col("registration")), F.lit("")),
        formatted=N.format_registration(F.col("registration")),
        replace_key=N.normalize_registration(F.col("replace_if")),
    )
    site = F.when(F.col("website").rlike("(?i)^https?://[^/]"), F.col("website"))
    stated = F.filter(F.transform("aliases", lambda a: F.trim(a)), lambda a: F.coalesce(a != "", F.lit(False)) & F.coalesce(N.normalize_name(a) != F.col("name_key"), F.lit(True)))
    return rows.withColumns({"website": site, "aliases": F.coalesce(stated, F.array().cast("array<string>"))})


def _extremes(asked: DataFrame, facts: DataFrame, key: str, aggregates: list[Column], *, later: bool = False) -> DataFrame:
    """(ordinal, aggregates) over the facts of the same key that come before each row, or with ``later`` at or after it.

    ``asked`` has (ordinal, key), ``facts`` the key, ``at`` and what is
    aggregated.  Rows and facts of a key are passed once in their order, so a
    key that many rows ask for and many facts have costs their sum, not their
    product.
    """
    both = facts.withColumn("ordinal", F.lit(None).cast("long")).unionByName(asked.withColumn("at", F.col("ordinal")), allowMissingColumns=True)
    row = F.col("ordinal").isNotNull()
    # rows before facts of the same place going up, facts before rows going down
    order = [F.desc("at"), row] if later else ["at", ~row]
    span = W.partitionBy(key).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    names = [f"_{i}" for i in range(len(aggregates))]
    seen = both.select("ordinal", *[a.over(span).alias(n) for n, a in zip(names, aggregates, strict=True)])
    return seen.filter("ordinal is not null")


def _blocks(first: Column, last: Column) -> Column:
    """The range of places as blocks (level, block): at most two of each power of two."""
    def at(level: Column) -> Column:
        low, high = -F.call_function("shiftright", -first, level), F.call_function("shiftright", last + 1, level)
        block = lambda n, odd: F.when((low < high) & (odd % 2 != 0), F.struct(level.alias("level"), n.alias("block")))
        return F.array_compact(F.array(block(low, low), block(high - 1, high)))

    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(61)), at))


def _holders(rows: DataFrame, numbers: DataFrame, accepted: DataFrame, steps: DataFrame) -> DataFrame:
    """(ordinal, low, high): smallest and largest company that holds a patch's number when the patch comes.

    Companies whose number never changes are reduced to one row a number.  Of
    the others, those that hold it from the start on or to the end are passed
    in order; the few that take a number and give it up again are held as
    blocks of ordinals.
    """
    lowest, highest = F.min("entity_id"), F.max("entity_id")
    still = numbers.join(accepted.select("entity_id").distinct().hint("merge"), "entity_id", "left_anti").filter("reg_key is not null")
    still = still.groupBy("reg_key").agg(lowest.alias("low"), highest.alias("high"))
    spans = steps.filter("reg_key is not null")
    asked = rows.filter("reg_key is not null and ordinal is not null").select("ordinal", "reg_key")
    early = spans.filter((F.col("since") == FIRST) & (F.col("until") < LAST)).select("reg_key", "entity_id", F.col("until").alias("at"))
    late = spans.filter((F.col("since") > FIRST) & (F.col("until") == LAST)).select("reg_key", "entity_id", F.col("since").alias("at"))
    short = spans.filter((F.col("since") > FIRST) & (F.col("until") < LAST) & (F.col("since") < F.col("until")))
    held = stored(short.select("reg_key", "entity_id", F.explode(_blocks(F.col("since") + 1, F.col("until"))).alias("b")).groupBy("reg_key", "b.level", "b.block").agg(lowest.alias("low"), highest.alias("high")), "patch-blocks")
    levels = [r["level"] for r in held.select("level").distinct().collect()]  # 62 at most
    found = join_known(asked, still.hint("merge"), ["reg_key"], "ordinal").select("ordinal", "low", "high")
    for facts, later in ((early, True), (late, False)):
        found = found.unionByName(_extremes(asked, facts, "reg_key", [lowest, highest], later=later).toDF("ordinal", "low", "high"))
    if levels:
        probe = asked.withColumn("level", F.explode(F.array(*[F.lit(n) for n in sorted(levels)]))).withColumn("block", F.call_function("shiftright", "ordinal", "level"))
        found = found.unionByName(probe.join(held.hint("merge"), ["reg_key", "level", "block"]).select("ordinal", "low", "high"))
    return found.filter("low is not null").groupBy("ordinal").agg(F.min("low").alias("low"), F.max("high").alias("high"))


def _steps(numbers: DataFrame, accepted: DataFrame) -> DataFrame:
    """(entity_id, reg_key, since, until): the numbers, the stored one first, of the companies whose number changes."""
    of = accepted.select("entity_id").distinct().hint("merge")
    steps = numbers.join(of, "entity_id", "left_semi").select("entity_id", "reg_key", F.lit(FIRST).alias("since")).unionByName(accepted.select("entity_id", "reg_key", F.col("ordinal").alias("since")))
    return steps.withColumn("until", F.coalesce(F.lead("since").over(W.partitionBy("entity_id").orderBy("since")), F.lit(LAST)))


def _named(rows: DataFrame, key: str, indexes: tuple[DataFrame, DataFrame], added: DataFrame, out: str) -> DataFrame:
    """(ordinal, ``out``, ``out``_via): company by name, stored alias, or alias of an earlier patch."""
    names, aliases = (index.hint("merge") for index in indexes)
    asked = rows.select("ordinal", F.col(key).alias("name_key"))
    facts = added.select(F.col("ordinal").alias("at"), "entity_id", "name_key")
    earlier = _extremes(asked.filter("name_key is not null and ordinal is not null"), facts.filter("name_key is not null"), "name_key", [F.min("entity_id")]).toDF("ordinal", "_new")
    earlier = earlier.filter("_new is not null").groupBy("ordinal").agg(F.min("_new").alias("_new"))
    found = asked.transform(join_known, names, ["name_key"], "ordinal").transform(join_known, aliases, ["name_key"], "ordinal").join(earlier.hint("merge"), "ordinal", "left")
    via = F.when(F.col("_name").isNotNull(), "canonical_name").when(F.coalesce("_alias", "_new").isNotNull(), "alias")
    return found.select("ordinal", F.coalesce("_name", "_alias", "_new").alias(out), via.alias(f"{out}_via"))


def _round(rows: DataFrame, numbers: DataFrame, indexes: tuple[DataFrame, DataFrame], accepted: DataFrame, added: DataFrame) -> DataFrame:
    """(ordinal, entity_id, via, reason, new_key) of every patch, given what earlier patches are thought to do.

    What is read more than once is written once, so no join or pass is done twice.
    """
    steps = stored(_steps(numbers, accepted), "patch-steps")
    by_reg = _holders(rows, numbers, accepted, steps)
    found = rows.select("ordinal", "reg_key", "registration", "formatted", "replace_key").join(by_reg.hint("merge"), "ordinal", "left").join(_named(rows, "name_key", indexes, added, "named").hint("merge"), "ordinal")
    found = stored(found.withColumn("entity_id", F.coalesce("low", "named")), "patch-found")
    # of a company whose number changes: the last one before the patch
    facts = steps.select("entity_id", F.col("since").alias("at"), F.struct("since", "reg_key").alias("given"))
    at = _extremes(found.filter("entity_id is not null").select("ordinal", "entity_id"), facts, "entity_id", [F.max("given")]).toDF("ordinal", "given")
    at = at.filter("given is not null").select("ordinal", F.lit(True).alias("changed"), F.col("given.reg_key").alias("now"))
    own = numbers.select("entity_id", F.col("reg_key").alias("stored"))
    j = join_known(found, own.hint("merge"), ["entity_id"], "ordinal").join(at.hint("merge"), "ordinal", "left").withColumn("old", F.when(F.col("changed"), F.col("now")).otherwise(F.col("stored")))
    old, new, missing = F.col("old"), F.col("reg_key"), F.col("entity_id").isNull()
    offered = F.col("registration").isNotNull()
    replaceable = old.isNull() | old.isin(N.VERIFIER_REGISTRATIONS) | F.coalesce(old == F.col("replace_key"), F.lit(False))
    clash = F.coalesce((F.col("low") != F.col("entity_id")) | (F.col("high") != F.col("entity_id")), F.lit(False))
    reason = (
        F.when(missing, "not_found")
        .when(~offered, None)
        .when(F.col("formatted").isNull(), "invalid_registration_format")
        .when(new.isin(N.VERIFIER_REGISTRATIONS), "verifier_agency_registration")
        .when(replaceable & clash, "registration_belongs_to_another_entity")
        .when(~replaceable & (old != new), "existing_registration_preserved")
    )
    via = F.when(F.col("low").isNotNull(), "registration_number").otherwise(F.col("named_via"))
    judged = j.select("ordinal", "entity_id", via.alias("via"), reason.alias("reason"), "reg_key", (offered & ~missing & replaceable).alias("_may"))
    return judged.select("ordinal", "entity_id", "via", "reason", F.when(F.col("_may") & F.col("reason").isNull(), F.col("reg_key")).alias("new_key"))


def _same(a: DataFrame, b: DataFrame) -> bool:
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def judged(tables, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The last round, and the aliases that found patches add."""
    spark = rows.sparkSession
    live = unmerged(tables)
    numbers = stored(live.select(F.col("id").cast("string").alias("entity_id"), F.nullif("registration_number_normalized", F.lit("")).alias("reg_key")), "patch-numbers")
    names = live.groupBy(F.col("normalized_name").alias("name_key")).agg(F.min(F.col("id").cast("string")).alias("_name"))
    owners = tables["entity_aliases"].select(F.col("entity_id").cast("string").alias("entity_id"), F.col("normalized_alias").alias("name_key"))
    aliases = owners.join(numbers.select("entity_id").hint("merge"), "entity_id", "left_semi").groupBy("name_key").agg(F.min("entity_id").alias("_alias"))
    indexes = stored(names, "patch-names"), stored(aliases, "patch-aliases")
    accepted, added = spark.createDataFrame([], NUMBERS), spark.createDataFrame([], ALIASES)
    stated = rows.select("ordinal", F.explode(F.transform("aliases", N.normalize_alias)).alias("name_key")).distinct()
    while True:
        now = stored(_round(rows, numbers, indexes, accepted, added), "patch-round")
        numbers_now = now.filter("new_key is not null").select("ordinal", "entity_id", F.col("new_key").alias("reg_key"))
        # only aliases that some patch asks for matter to other patches
        asked = rows.select("name_key").union(rows.select("parent_key")).distinct()
        added_now = stored(stated.join(asked.hint("merge"), "name_key", "left_semi").join(now.filter("entity_id is not null").select("ordinal", "entity_id").hint("merge"), "ordinal").select("ordinal", "entity_id", "name_key"), "patch-added")
        if _same(numbers_now, accepted) and _same(added_now, added):
            parents = _named(rows.filter("parent_key is not null"), "parent_key", indexes, added_now, "parent_id")
            return now.join(parents.drop("parent_id_via").hint("merge"), "ordinal", "left"), added_now
        accepted, added = numbers_now, added_now


def apply_batch(tables, patches: DataFrame) -> dict[str, DataFrame]:
    """Every table that a batch of identity patches changes.

    results: company, how it was found, why its number was kept, and the new
    number; entities: new values of changed fields; aliases, classifications,
    relationships and sources to add; filled: what each patch filled, a row each.
    """
    rows = stored(prepared(patches), "patches")
    now, _ = judged(tables, rows)
    found = stored(rows.drop("parent_key").join(now.hint("merge"), "ordinal").withColumn("new_registration", F.when(F.col("new_key").isNotNull(), F.col("formatted"))), "patched")
    some = found.filter("entity_id is not null")
    own = tables["entities"].select(F.col("id").cast("string").alias("entity_id"), *[F.col(c).alias(f"_{c}") for c in ("website", "legal_name", "trading_name")])

    offers = some.select("ordinal", "entity_id", F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("value")) for c in ("website", "legal_name", "trading_name")])).alias("o")).select("ordinal", "entity_id", "o.*")
    first = offers.filter("value is not null").groupBy("entity_id", "field").agg(F.min(F.struct("ordinal", "value")).alias("o"))
    has = F.coalesce(*[F.when(F.col("field") == c, F.col(f"_{c}")) for c in ("website", "legal_name", "trading_name")])
    filled = first.join(own.hint("merge"), "entity_id").filter(has.isNull()).select("entity_id", "field", "o.ordinal", "o.value")
    numbers = some.filter("new_registration is not null").select("entity_id", F.lit("registration_number").alias("field"), "ordinal", F.col("new_registration").alias("value"))
    both = filled.unionByName(numbers)

    alias = some.select("ordinal", "entity_id", F.posexplode("aliases").alias("position", "alias")).withColumn("normalized_alias", N.normalize_alias(F.col("alias")))
    had = tables["entity_aliases"].select(F.col("entity_id").cast("string").alias("entity_id"), "normalized_alias")
    new_aliases = alias.groupBy("entity_id", "normalized_alias").agg(F.min(F.struct("ordinal", "position", "alias")).alias("a")).join(had.hint("merge"), ["entity_id", "normalized_alias"], "left_anti").select("entity_id", "a.alias", "normalized_alias", F.lit("other").alias("alias_type"))

    # one list for both kinds: with a fixed id beside the join, Spark would compare pairs and send the listings to all tasks
    class_of = lambda x, kind: F.struct(x.alias("sector_id"), F.lit(kind).alias("classification_type"))
    sectors = F.transform(F.array_distinct(F.filter("sectors", lambda x: ~x.isin(NON_INDUSTRY_SECTORS))), lambda x: class_of(x, "sector"))
    listing = F.when(F.col("listed"), F.array(class_of(F.lit(LISTED), "listing")))
    stated = some.select("ordinal", "entity_id", F.explode(F.flatten(F.array_compact(F.array(sectors, listing)))).alias("c")).select("ordinal", "entity_id", "c.*")
    classed = stated.join(tables["sectors"].select(F.col("id").alias("sector_id")).hint("merge"), "sector_id", "left_semi")
    keys = ["entity_id", "sector_id", "classification_type"]
    had = tables["entity_classifications"].select(F.col("entity_id").cast("string").alias("entity_id"), "sector_id", "classification_type")

    edge = some.filter("parent_id <> entity_id").groupBy(F.col("entity_id").alias("source_entity_id"), F.col("parent_id").alias("target_entity_id")).agg(F.min(F.struct("ordinal", "parent")).alias("e"))
    links = tables["entity_relationships"].filter("relationship_type = 'parent'").select(F.col("source_entity_id").cast("string").alias("source_entity_id"), F.col("target_entity_id").cast("string").alias("target_entity_id"))
    edge = edge.join(links.hint("merge"), ["source_entity_id", "target_entity_id"], "left_anti")

    watch = some.select("ordinal", "entity_id", F.posexplode("sources").alias("position", "s")).select("ordinal", "entity_id", "position", "s.*").filter(N.fetchable_url(F.col("url"))).withColumn("canonical_url", N.canonical_url(F.trim("url")))
    watched = tables["monitored_sources"].select(N.canonical_url(F.col("url")).alias("canonical_url")).distinct()
    source = watch.groupBy("canonical_url").agg(F.min(F.struct("ordinal", "position", "entity_id", "url", F.coalesce("source_type", F.lit("other")).alias("source_type"), F.coalesce("frequency", F.lit("monthly")).alias("frequency"))).alias("s")).join(watched.hint("merge"), "canonical_url", "left_anti")

    def did(rows: DataFrame, what: Column) -> DataFrame:
        return rows.select("ordinal", what.alias("filled"))

    done = did(both, F.col("field")).unionByName(did(alias, F.concat(F.lit("alias:"), F.col("alias"))))
    done = done.unionByName(did(classed, F.when(F.col("classification_type") == "listing", "listing:jse").otherwise(F.concat(F.lit("sector:"), F.col("sector_id")))))
    done = done.unionByName(did(edge.select("e.*"), F.concat(F.lit("parent:"), F.col("parent")))).unionByName(did(watch, F.concat(F.lit("source:"), F.col("url"))))
    return {
        "results": found.select("ordinal", "entity_id", "via", "reason", "new_registration"),
        "entities": both.groupBy("entity_id", "field").agg(F.max_by("value", "ordinal").alias("value")),
        "aliases": new_aliases,
        "classifications": classed.select(*keys).distinct().join(had.hint("merge"), keys, "left_anti"),
        "relationships": edge.select("source_entity_id", "target_entity_id", F.lit("parent").alias("relationship_type"), F.lit("public").alias("public_status")),
        "sources": source.select("s.entity_id", "s.url", "canonical_url", "s.source_type", "s.frequency"),
        "filled": done,
    }
