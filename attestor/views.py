"""Domain tables derived from the star-schema test tables.

Each table is one lazy DataFrame built from plain expressions, so its size
grows with the input.  ``Tables`` builds a table the first time it is asked
for; a real deployment passes its own mapping of stored tables instead.  With
``store`` the tables that most reports read several times are written once for a
session, dealt by the key they are joined by (``SNAPSHOTS``), and every later
``Tables`` of that session, folder and clock reads them from there.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attestor.functions import names as N
from attestor.operators.common import at_least_tasks, bucketed
from attestor.schemas import DEFAULT_CLOCK, Clock

# Words that make the generated company names exercise the sector rules.
NAME_WORDS = [
    "Trading",
    "Construction",
    "Engineering Consultants",
    "Security Services",
    "Bank",
    "Logistics",
    "Foods",
    "Medical Supplies",
    "Projects",
    "Attorneys",
    "Consulting",
    "Solar Energy",
]
NAME_TAILS = [" (Pty) Ltd", " Limited", "", " Holdings", " Ltd"]


TABLE_NAMES = [
    "entities",
    "entity_aliases",
    "entity_relationships",
    "sectors",
    "entity_classifications",
    "verification_agencies",
    "agency_aliases",
    "agency_accreditations",
    "signatories",
    "evidence_raw",
    "evidence_entity_links",
    "evidence",
    "decided_evidence",
    "evidence_source_locations",
    "extraction_runs",
    "extracted_claims",
    "published_claims",
    "field_overrides",
    "entity_current_state",
    "monitored_sources",
    "review_items",
    "publication_events",
    "submissions",
    "source_checks",
    "crawler_jobs",
    "audit_logs",
    "enrichment_results",
]


#: Tables worth a snapshot and their keys; each key is unique or nearly so, so that no bucket is hot.
SNAPSHOTS = {"entities": "id", "evidence": "id", "evidence_entity_links": "evidence_id", "decided_evidence": "evidence_id", "entity_current_state": "entity_id"}
_written: dict[tuple, str] = {}
#: Tables whose rows grow, and the rows of the largest that a task of a shuffle is to take.
TALL = ("customer", "orders", "lineitem", "events")
ROWS_PER_TASK = 1_000_000
_rows: dict[tuple, int] = {}


def _pick(values: list[str], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index % len(values) + 1).cast("int"))


def _s(col: Column) -> Column:
    return col.cast("string")


def _base_key(k: Column) -> Column:
    """Customers that share a company name: pairs at 41, triples at 89."""
    return (
        F.when((k % 89).isin(1, 2), k - k % 89)
        .when((k % 41 == 0) & (k > 0), k - 1)
        .otherwise(k)
    )


def _registration(k: Column, sep: str) -> Column:
    return F.concat(_s(1990 + k % 30), F.lit(sep), F.lpad(_s(k % 1000000), 6, "0"), F.lit(sep), F.lit("07"))


class Tables(Mapping):
    """Lazy mapping of table name to DataFrame."""

    def __init__(self, spark: SparkSession, sf_dir: str, clock: Clock = DEFAULT_CLOCK, *, store: bool = False):
        self.spark, self.dir, self.clock, self.store = spark, sf_dir, clock, store
        self._cache: dict[str, DataFrame] = {}
        self._raw: dict[str, DataFrame] = {}

    def raw(self, name: str) -> DataFrame:
        if name not in self._raw:
            self._raw[name] = self.spark.read.parquet(f"{self.dir}/{name}.parquet")
        return self._raw[name]

    def size_tasks(self) -> None:
        """Let the tasks of a shuffle grow in number with the tables, not in size."""
        at = (self.spark.sparkContext.applicationId, self.dir)
        if at not in _rows:
            _rows[at] = max(self.raw(name).count() for name in TALL)
        at_least_tasks(self.spark, -(-_rows[at] // ROWS_PER_TASK))

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._cache:
            builder = getattr(self, f"_{name}", None) if name in TABLE_NAMES else None
            if builder is None:
                raise KeyError(name)
            self._cache[name] = self._snapshot(name, builder) if self.store and name in SNAPSHOTS else builder()
        return self._cache[name]

    def _snapshot(self, name: str, builder: Callable[[], DataFrame]) -> DataFrame:
        at = (self.spark.sparkContext.applicationId, self.dir, self.clock, name)
        if at not in _written or not self.spark.catalog.tableExists(_written[at]):
            _written[at] = bucketed(builder(), name, SNAPSHOTS[name])
        return self.spark.table(_written[at])

    def __iter__(self) -> Iterator[str]:
        return iter(TABLE_NAMES)

    def __len__(self) -> int:
        return len(TABLE_NAMES)

    # --- entities ----------------------------------------------------------
    def _entities(self) -> DataFrame:
        c = self.raw("customer")
        k = F.col("c_custkey")
        last = F.lit(c.agg(F.max("c_custkey")).first()[0]).cast("long")
        base = _base_key(k)
        registration = F.when(k % 500 == 7, F.lit("1995/000523/07")).when(k % 3 != 0, _registration(k, "/"))
        named = c.select(
            k.alias("id"),
            F.concat(F.lit("firm-"), _s(k)).alias("slug"),
            F.concat(F.lit("Firm "), _s(base), F.lit(" "), _pick(NAME_WORDS, base), _pick(NAME_TAILS, k)).alias(
                "canonical_name"
            ),
            registration.alias("registration_number"),
            F.when(k % 4 == 0, None)
            .when(k % 2 == 1, F.concat(F.lit("https://www.firm"), _s(k), F.lit(".example.com/about")))
            .otherwise(F.concat(F.lit("firm"), _s(k), F.lit(".example.com")))
            .alias("website"),
            F.when(k % 10 == 0, "hidden").when(k % 10 == 1, "draft").otherwise("public").alias("visibility"),
            F.when((k % 97 == 0) & (k < last), k + 1).alias("merged_into_id"),
            F.when(k % 23 == 0, "group").otherwise("company").alias("entity_type"),
            F.when(k % 7 == 0, "automation_allowed")
            .when(k % 7 == 1, "locked")
            .otherwise("review_only")
            .alias("automation_state"),
            F.date_add(F.lit("1994-01-01").cast("date"), (k % 700).cast("int")).alias("created_at"),
            F.date_add(F.lit("1999-01-01").cast("date"), (k * 7 % 730).cast("int")).alias("updated_at"),
        )
        return named.select(
            "*",
            F.when(F.col("id") % 5 != 0, F.concat("canonical_name", F.lit(" (RF)"))).alias("legal_name"),
            F.when(F.col("id") % 6 == 0, F.concat(F.lit("Brand "), _s(F.col("id")))).alias("trading_name"),
            N.normalize_name(F.col("canonical_name")).alias("normalized_name"),
            N.normalize_registration(F.col("registration_number")).alias("registration_number_normalized"),
        )

    def _entity_aliases(self) -> DataFrame:
        c = self.raw("customer")
        k = F.col("c_custkey")
        first = c.filter(k % 3 == 1).select(
            k.alias("entity_id"),
            F.concat(F.lit("Alias "), _s(k), F.lit(" Ltd")).alias("alias"),
            F.lit("other").alias("alias_type"),
            F.when(k % 2 == 0, "reviewed").otherwise("unreviewed").alias("reviewed_status"),
        )
        former = c.filter(k % 6 == 1).select(
            k.alias("entity_id"),
            F.concat(F.lit("Old firm "), _s(k - k % 4)).alias("alias"),
            F.lit("former_name").alias("alias_type"),
            F.lit("reviewed").alias("reviewed_status"),
        )
        return first.unionByName(former).select(
            F.concat_ws("-", "entity_id", "alias_type").alias("id"),
            "*",
            N.normalize_alias(F.col("alias")).alias("normalized_alias"),
        )

    def _entity_relationships(self) -> DataFrame:
        k = F.col("c_custkey")
        target = F.floor(k / 10)
        return self.raw("customer").filter(target != k).select(
            F.concat_ws("-", _s(k), _s(target)).alias("id"),
            k.alias("source_entity_id"),
            target.alias("target_entity_id"),
            _pick(["parent", "holding_company", "subsidiary", "division"], k).alias("relationship_type"),
            F.when(k % 7 == 0, "hidden").otherwise("public").alias("public_status"),
            F.when(k % 5 == 0, "pending").otherwise("approved").alias("review_state"),
        )

    def _sectors(self) -> DataFrame:
        segments = self.raw("customer").select("c_mktsegment").distinct().select(
            F.concat(F.lit("sec_"), F.lower("c_mktsegment")).alias("id"),
            F.lower("c_mktsegment").alias("slug"),
            F.initcap("c_mktsegment").alias("name"),
        )
        extra = self.spark.createDataFrame(
            [
                ("sec_jse", "jse", "Listed"),
                ("sec_government_suppliers", "government-suppliers", "Government suppliers"),
            ],
            "id string, slug string, name string",
        )
        return segments.unionByName(extra)

    def _entity_classifications(self) -> DataFrame:
        c = self.raw("customer")
        k = F.col("c_custkey")

        def rows(where: Column, sector: Column, kind: str, public: Column) -> DataFrame:
            return c.filter(where).select(
                k.alias("entity_id"),
                sector.alias("sector_id"),
                F.lit(kind).alias("classification_type"),
                public.alias("is_public"),
            )

        own = rows(k % 8 != 0, F.concat(F.lit("sec_"), F.lower("c_mktsegment")), "sector", k % 9 != 0)
        listed = rows(k % 13 == 0, F.lit("sec_jse"), "listing", F.lit(True))
        second = rows(
            (k % 17 == 0) & (F.col("c_mktsegment") != "BUILDING"), F.lit("sec_building"), "sector", F.lit(True)
        )
        supplier = rows(k % 29 == 0, F.lit("sec_government_suppliers"), "sector", F.lit(True))
        both = own.unionByName(listed).unionByName(second).unionByName(supplier)
        return both.select(F.concat_ws("-", "entity_id", "sector_id", "classification_type").alias("id"), "*")

    # --- agencies ----------------------------------------------------------
    def _verification_agencies(self) -> DataFrame:
        k = F.col("s_suppkey")
        return self.raw("supplier").select(
            k.alias("id"),
            F.concat(F.lit("agency-"), _s(k)).alias("slug"),
            F.when(k % 9 == 4, F.concat(F.lit("the verification of "), _s(k)))
            .otherwise(F.concat(F.lit("Verifier "), _s(k)))
            .alias("name"),
            F.when(k % 3 == 0, F.col("s_name")).alias("legal_name"),
            F.when(k % 4 != 0, F.concat(F.lit("https://verifier"), _s(k), F.lit(".example.org"))).alias("website"),
            F.when(k % 10 == 0, "hidden").otherwise("public").alias("visibility"),
        )

    def _agency_aliases(self) -> DataFrame:
        k = F.col("s_suppkey")
        return self.raw("supplier").filter(k % 3 == 0).select(
            k.alias("agency_id"), F.concat(F.lit("VA "), _s(k)).alias("alias")
        )

    def _agency_accreditations(self) -> DataFrame:
        k = F.col("s_suppkey")
        return self.raw("supplier").filter(k % 2 == 0).select(
            k.alias("agency_id"),
            F.lit("SANAS").alias("accreditation_body"),
            F.concat(F.lit("BVA"), F.lpad(_s(k), 3, "0")).alias("accreditation_identifier"),
            F.lit("active").alias("status"),
        )

    def _signatories(self) -> DataFrame:
        k = F.col("s_suppkey")
        return self.raw("supplier").filter(k % 5 != 0).select(
            k.alias("id"), k.alias("agency_id"), F.col("s_name").alias("name"), F.lit("Technical signatory").alias("role_title")
        )

    # --- evidence ----------------------------------------------------------
    def _evidence_raw(self) -> DataFrame:
        """Evidence before any lifecycle has been decided."""
        o = self.raw("orders")
        k, cust = F.col("o_orderkey"), F.col("o_custkey")
        agencies = F.lit(self.raw("supplier").count())
        kind = _pick(
            ["bee_certificate", "bee_certificate", "sworn_affidavit", "government_procurement_disclosure", "annual_report", "company_webpage"],
            k,
        )
        day = F.to_date("o_orderdate")
        status = k % 6 < 3
        issue = F.when(k % 11 != 0, F.when(status, F.trunc(day, "quarter")).otherwise(day))
        base = o.select(
            k.alias("id"),
            cust.alias("owner_id"),
            kind.alias("evidence_type"),
            issue.alias("issue_date"),
            F.when(status & (k % 7 != 0), F.date_add(issue, F.when(k % 4 == 0, 395).otherwise(365))).alias("expiry_date"),
            F.when(k % 11 == 0, None).when(status, "month").otherwise("day").alias("issue_date_precision"),
            F.lit(None).cast("string").alias("issue_date_raw"),
            F.when(F.col("o_orderstatus") == "P", "unpublished").otherwise("published").alias("publication_state"),
            F.when(F.col("o_orderstatus") == "P", "pending").otherwise("approved").alias("review_state"),
            F.date_add(day, 3).alias("discovered_at"),
            F.date_add(day, 3).alias("retrieved_at"),
            F.date_add(day, 3).alias("created_at"),
            F.date_add(day, 10).alias("updated_at"),
            F.when(k % 13 != 0, k % agencies).alias("verifier_agency_id"),
            F.when(k % 6 == 1, k % agencies).alias("signatory_id"),
            F.when(status, F.concat(F.lit("Certificate "), _s(k)))
            .when(k % 6 == 3, F.concat(F.lit("Tender award "), _s(k)))
            .when(k % 6 == 4, F.concat(F.lit("Annual report "), F.date_format(day, "yyyy")))
            .otherwise(F.concat(F.lit("Transformation page "), _s(k)))
            .alias("title"),
            F.when(k % 6 == 3, F.concat(F.lit("https://tenders.example.org/awards/"), F.date_format(day, "yyyy"), F.lit("/"), _s(k)))
            .otherwise(
                F.concat(F.lit("https://www.firm"), _s(cust), F.lit(".example.com/docs/doc-"), _s(k), F.lit(".pdf"))
            )
            .alias("source_url"),
            F.when(k % 6 == 3, "tenders.example.org")
            .otherwise(F.concat(F.lit("firm"), _s(cust), F.lit(".example.com")))
            .alias("source_domain"),
            F.when(k % 6 == 3, F.concat(F.lit("Department "), _s((k + cust) % 17)))
            .when(k % 5 == 0, F.concat(F.lit("firm"), _s(cust), F.lit(".example.com")))
            .alias("document_issuer"),
            F.when(k % 31 == 0, "application/zip").otherwise("application/pdf").alias("mime_type"),
            F.sha2(F.concat(F.lit("document "), _s(F.when(k % 29 == 28, k - 1).otherwise(k))), 256).alias("content_hash"),
        )
        return base

    def _evidence_entity_links(self) -> DataFrame:
        k = F.col("o_orderkey")
        return self.raw("orders").select(
            k.alias("id"),
            k.alias("evidence_id"),
            F.col("o_custkey").alias("entity_id"),
            _pick(["confirmed", "extracted", "candidate", "rejected", "included"], k).alias("link_state"),
            F.when(k % 2 == 0, "canonical_name").otherwise("registration_number").alias("match_method"),
            F.round(F.lit(0.9) + (k % 10) / 100.0, 2).alias("confidence"),
            F.when(k % 5 == 4, "Named in a group document").alias("reason"),
        )

    def _evidence(self) -> DataFrame:
        """Evidence with the lifecycle state decided as of the clock."""
        from attestor.operators.lifecycle import with_lifecycle

        return with_lifecycle(self["evidence_raw"], self["decided_evidence"])

    def _decided_evidence(self) -> DataFrame:
        from attestor.operators.lifecycle import decided_evidence

        return decided_evidence(self["evidence_raw"], self["evidence_entity_links"], self.clock)

    def _evidence_source_locations(self) -> DataFrame:
        o = self.raw("orders")
        k = F.col("o_orderkey")
        first = o.select(
            k.alias("evidence_id"),
            F.concat(F.lit("https://files.example.net/"), _s(k)).alias("url"),
            F.date_add(F.to_date("o_orderdate"), 4).alias("last_seen_at"),
        )
        mirror = o.filter(k % 8 == 0).select(
            k.alias("evidence_id"),
            F.concat(F.lit("https://mirror.example.net/"), _s(k)).alias("url"),
            F.date_add(F.to_date("o_orderdate"), 9).alias("last_seen_at"),
        )
        return first.unionByName(mirror)

    # --- claims ------------------------------------------------------------
    def _run_id(self) -> Column:
        return F.concat_ws("-", _s(F.col("l_orderkey")), _s(F.col("l_suppkey")), F.date_format("l_shipdate", "yyyyMMdd"))

    def _extraction_runs(self) -> DataFrame:
        return (
            self.raw("lineitem")
            .groupBy("l_orderkey", "l_suppkey", "l_shipdate")
            .agg(F.bool_and(F.col("l_returnflag") != "R").alias("success"))
            .select(
                self._run_id().alias("id"),
                F.col("l_orderkey").alias("evidence_id"),
                F.to_date("l_shipdate").alias("started_at"),
                "success",
                F.when(F.col("l_suppkey") % 4 == 0, "repair/v1").otherwise("deterministic/v1").alias("parser"),
            )
        )

    def _extracted_claims(self) -> DataFrame:
        n = F.col("l_linenumber")
        field = (
            F.when(n <= 2, "bee_level")
            .when(n == 3, "tender_number")
            .when(n == 4, "government_institution")
            .when(n == 5, "registration_number")
            .when(n == 6, "enterprise_class")
            .otherwise("verification_agency")
        )
        rows = (
            self.raw("lineitem")
            .withColumn("field_key", field)
            .groupBy("l_orderkey", "l_suppkey", "l_shipdate", "field_key")
            .agg(
                F.max("l_partkey").alias("v"),
                F.max("l_quantity").alias("q"),
                F.max("l_discount").alias("d"),
            )
        )
        f, v = F.col("field_key"), F.col("v")
        value = (
            F.when(f == "bee_level", _s(1 + v % 8))
            .when(f == "tender_number", F.concat(F.lit("T-"), _s(v)))
            .when(f == "government_institution", F.concat(F.lit("Department "), _s(v % 17)))
            .when(f == "registration_number", _registration(v, ""))
            .when(f == "enterprise_class", _pick(["EME", "QSE", "Generic"], v))
            .otherwise(F.concat(F.lit("Verifier "), _s(v % 200)))
        )
        return rows.select(
            F.concat_ws("-", self._run_id(), f).alias("id"),
            F.col("l_orderkey").alias("evidence_id"),
            self._run_id().alias("extraction_run_id"),
            f,
            F.when(f == "bee_level", F.concat(F.lit("Level "), value)).otherwise(value).alias("raw_value"),
            F.when(v % 6 != 0, value).alias("normalized_value"),
            F.when(v % 12 == 0, value).alias("structured_value"),
            F.when(F.col("q") >= 49, F.when(f == "bee_level", " 3 ").otherwise(F.concat(value, F.lit("e"))))
            .when(F.col("q") == 1, "  ")
            .alias("edited_value"),
            F.round(F.lit(0.5) + F.col("d") * 5, 2).alias("confidence"),
            F.when(v % 5 == 0, "published").otherwise("unpublished").alias("published_state"),
            F.lit("pending").alias("review_state"),
        )

    def _published_claims(self) -> DataFrame:
        c = self.raw("customer")
        k = F.col("c_custkey")

        def rows(where: Column, field: str, value: Column) -> DataFrame:
            return c.filter(where).select(
                k.alias("entity_id"),
                F.lit(field).alias("field_key"),
                value.alias("value"),
                k.alias("evidence_id"),
                F.date_add(F.lit("1998-01-01").cast("date"), (k % 900).cast("int")).alias("published_at"),
                F.lit("reviewer").alias("published_by"),
            )

        level = rows(k % 4 != 3, "bee_level", _s(1 + k % 8))
        # Every 15th number belongs to a neighbouring firm.
        registration = rows(k % 5 == 2, "registration_number", _registration(F.when(k % 15 == 12, k + 1).otherwise(k), ""))
        return level.unionByName(registration).select(F.concat_ws("-", "entity_id", "field_key").alias("id"), "*")

    def _field_overrides(self) -> DataFrame:
        c = self.raw("customer")
        k = F.col("c_custkey")
        level = c.filter(k % 19 == 0).select(
            k.alias("entity_id"),
            F.lit("bee_level").alias("field_key"),
            F.when(k % 38 == 0, "2").alias("value"),
            F.lit(True).alias("locked"),
        )
        agency = c.filter(k % 19 == 1).select(
            k.alias("entity_id"),
            F.lit("scorecard_type").alias("field_key"),
            F.lit("Generic").alias("value"),
            (k % 2 == 0).alias("locked"),
        )
        return level.unionByName(agency)

    def _entity_current_state(self) -> DataFrame:
        from attestor.operators.lifecycle import current_state

        return current_state(self)

    # --- monitoring, review and logs ---------------------------------------
    def _monitored_sources(self) -> DataFrame:
        k = F.col("c_custkey")
        domain = F.when(k % 6 == 0, F.concat(F.lit("other"), _s(k), F.lit(".example.org"))).otherwise(
            F.concat(F.lit("firm"), _s(k), F.lit(".example.com"))
        )
        checked = F.when(k % 11 != 0, F.date_add(F.lit("2000-10-01").cast("date"), (k % 92).cast("int")))
        return self.raw("customer").filter(k % 5 != 0).select(
            k.alias("id"),
            k.alias("entity_id"),
            F.concat(F.lit("https://www."), domain, F.lit("/")).alias("url"),
            domain.alias("domain"),
            (k % 8 != 0).alias("enabled"),
            _pick(["daily", "weekly", "monthly", "manual"], k).alias("frequency"),
            checked.alias("last_checked_at"),
            F.when(k % 7 == 0, k % 6).otherwise(F.lit(0)).cast("int").alias("consecutive_error_count"),
            F.when(k % 14 == 0, F.date_add(F.lit("2000-12-25").cast("date"), (k % 20).cast("int"))).alias("backoff_until"),
            F.date_add(checked, (k % 40).cast("int")).alias("next_check_at"),
            F.date_add(F.lit("2000-01-01").cast("date"), (k % 300).cast("int")).alias("updated_at"),
        )

    def _review_items(self) -> DataFrame:
        k = F.col("o_orderkey")
        kind = (
            F.when(F.col("o_orderpriority") == "1-URGENT", "conflicting_evidence")
            .when(F.col("o_orderpriority") == "2-HIGH", "registration_number_conflict")
            .when(F.col("o_orderpriority") == "3-MEDIUM", "new_evidence")
            .when(F.col("o_orderpriority") == "5-LOW", "uncertain_entity_match")
            .when(k % 2 == 0, "extraction_failed")
            .otherwise("invalid_extracted_claim")
        )
        field = F.when(k % 5 == 0, "bee_level").otherwise("expiry_date")
        return self.raw("orders").filter(k % 4 != 3).select(
            k.alias("id"),
            kind.alias("type"),
            F.when(kind == "conflicting_evidence", F.concat(F.lit("Repair extracted a different "), field, F.lit(". Stored value was kept.")))
            .when(kind == "invalid_extracted_claim", F.when(k % 3 == 0, "Value was suppressed and not shown.").otherwise("Value looks wrong."))
            .otherwise(F.concat(F.lit("Check "), kind))
            .alias("reason"),
            F.when(k % 3 == 0, "pending").when(k % 3 == 1, "approved").otherwise("deferred").alias("status"),
            F.when(k % 10 == 0, "high").otherwise("normal").alias("severity"),
            F.col("o_custkey").alias("entity_id"),
            k.alias("evidence_id"),
            F.date_add(F.to_date("o_orderdate"), 5).alias("generated_at"),
        )

    def _publication_events(self) -> DataFrame:
        return self.raw("events").select(
            F.col("event_id").alias("id"),
            F.col("user_id").alias("entity_id"),
            F.col("event_id").alias("evidence_id"),
            F.when(F.col("event_type") == "purchase", "auto_published").otherwise("published").alias("event_type"),
            F.concat(F.lit("Published evidence "), _s(F.col("event_id"))).alias("summary"),
            F.col("ts").alias("published_at"),
        )

    def _submissions(self) -> DataFrame:
        return self.raw("events").select(
            F.col("event_id").alias("id"),
            _s(F.col("user_id")).alias("ip_hash"),
            F.when(F.col("event_type") == "view", "pending").otherwise("closed").alias("status"),
            F.col("ts").alias("created_at"),
        )

    def _source_checks(self) -> DataFrame:
        return self.raw("events").select(
            F.col("event_id").alias("id"),
            F.col("user_id").alias("source_id"),
            F.col("ts").alias("started_at"),
            F.md5(_s(F.floor(F.col("value") / 20))).alias("content_hash"),
        )

    def _crawler_jobs(self) -> DataFrame:
        return self.raw("events").select(
            F.col("event_id").alias("id"),
            F.when(F.col("event_type") == "error", "failed").otherwise("done").alias("state"),
            F.col("ts").alias("created_at"),
        )

    def _audit_logs(self) -> DataFrame:
        e = F.col("event_type")
        return self.raw("events").select(
            F.col("event_id").alias("id"),
            F.concat(F.lit("evidence."), e).alias("action"),
            F.when(e == "signup", "entity").otherwise("evidence").alias("target_type"),
            _s(F.col("user_id")).alias("target_id"),
            F.col("ts").alias("at"),
        )

    def _enrichment_results(self) -> DataFrame:
        """One row per company handled by an enrichment run (a run is a day)."""
        e = F.col("event_type")
        return self.raw("events").select(
            F.date_format("ts", "yyyy-MM-dd").alias("run_id"),
            F.col("user_id").alias("entity_id"),
            F.col("ts").alias("at"),
            F.lit(1).alias("attempted"),
            F.when(e != "view", 1).otherwise(0).alias("enriched"),
            F.when(e == "purchase", 1).otherwise(0).alias("certificates_found"),
            F.when(e == "click", 1).otherwise(0).alias("registrations_found"),
            F.when(e == "signup", 1).otherwise(0).alias("domains_found"),
            F.when(e == "error", 1).otherwise(0).alias("errors"),
        )
