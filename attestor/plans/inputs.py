"""Text inputs derived row by row from the test tables.

The tables hold no company documents, so each order or customer yields one
text in a rotating set of spellings; the number of texts grows with the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestor.operators.common import shuffle_tasks
from attestor.views import NAME_WORDS


def pick(values: list, index: Column) -> Column:
    items = [v if isinstance(v, Column) else F.lit(v) for v in values]
    return F.element_at(F.array(*items), (index % len(items) + 1).cast("int"))


def s(col: Column) -> Column:
    return col.cast("string")


K = F.col
ORDER, CUSTOMER = "o_orderkey", "c_custkey"

LEVEL_TEXTS = ["Level 3", "level one", "B-BBEE Level 4 Contributor", "Non-compliant contributor", "N/A", "85 points", "L 2", "Status: Level Eight", "7"]
LEVELS = ["3", "1", "4", "non-compliant", None, None, "2", "8", "7"]
STRICT_LEVELS = ["3", None, None, None, None, None, "2", None, "7"]

URLS = [
    "https://files.example.org/b-bbee-certificate-{k}.pdf",
    "https://files.example.org/annual_report_{k}.html",
    "https://files.example.org/sworn affidavit bbbee {k}",
    "https://files.example.org/transformation/{k}",
    "https://files.example.org/transformation-bbbee/{k}",
    "https://files.example.org/procurement/{k}",
    "https://files.example.org/suppliers/{k}.pdf?x=1",
    "https://files.example.org/investor/{k}",
    "https://files.example.org/integrated-report-{k}.pdf",
    "https://files.example.org/news/{k}",
]
URL_TYPES = [
    "bee_certificate",
    "annual_report",
    "sworn_affidavit",
    "other",
    "transformation_report",
    "procurement_page",
    "supplier_page",
    "investor_document",
    "integrated_report",
    "other",
]
URL_SCORES = [5, 0, 3, 1, 3, 1, 3, 0, 2, 0]


def spread(t, columns: list[str]) -> DataFrame:
    """Order keys over all tasks before text is made from them.

    A small table is one file and would be one task; only the narrow key
    columns are shuffled, never the texts.
    """
    n = shuffle_tasks(t.spark)
    return t.raw("orders").select(*columns).repartition(n)


def with_key(text: str, key: Column) -> Column:
    before, _, after = text.partition("{k}")
    return F.concat(F.lit(before), s(key), F.lit(after))


def level_texts(t) -> DataFrame:
    k = K(ORDER)
    return t.raw("orders").select(k.alias("id"), pick(LEVEL_TEXTS, k).alias("raw"))


def url_texts(t) -> DataFrame:
    k = K(ORDER)
    return t.raw("orders").select(k.alias("id"), pick([with_key(u, k) for u in URLS], k).alias("url"))


def date_texts(t) -> DataFrame:
    """Order dates in ten spellings."""
    k, d = K(ORDER), F.to_date("o_orderdate")
    forms = [
        F.date_format(d, "yyyy-MM-dd"),
        F.date_format(d, "d MMMM yyyy"),
        F.date_format(d, "dd-MMM-yyyy"),
        F.date_format(d, "MMMM d, yyyy"),
        F.date_format(d, "dd/MM/yyyy"),
        F.date_format(d, "d MMM yy"),
        F.concat(F.date_format(d, "yyyy-MM"), F.lit("-31")),
        F.lit("sometime soon"),
        F.lit(" "),
        F.date_format(d, "dd.MM.yyyy"),
    ]
    return t.raw("orders").select(k.alias("id"), pick(forms, k).alias("raw"))


def stated_date_texts(t) -> DataFrame:
    """Sentences that state a date with day, month or year precision."""
    k, d = K(ORDER), F.add_months(F.to_date("o_orderdate"), 120)
    forms = [
        F.concat(F.lit("Awarded "), F.date_format(d, "yyyy-MM-dd"), F.lit(" by council")),
        F.concat(F.lit("Closing date "), F.date_format(d, "d MMMM yyyy")),
        F.concat(F.lit("As at "), F.date_format(d, "dd-MMM-yy")),
        F.date_format(d, "MMMM yyyy"),
        F.concat(F.lit("Financial year "), F.date_format(d, "yyyy")),
        F.lit("not dated"),
        F.lit("Closed 2024-02-31 or 5 May 2025"),
    ]
    return t.raw("orders").select(k.alias("id"), pick(forms, k).alias("raw"))


def dated_documents(t) -> DataFrame:
    """Documents whose title, file name or stored date states when they are from."""
    k, d = K(ORDER), F.add_months(F.to_date("o_orderdate"), 120)
    path = F.concat(F.lit("https://www.site"), s(k), F.lit(".example.org/files/"))
    titles = [
        F.concat(F.lit("Award of "), F.date_format(d, "d MMMM yyyy")),
        F.concat(F.lit("Road awards — "), F.date_format(d, "MMM yyyy")),
        F.concat(F.lit("Annual report "), F.date_format(d, "yyyy")),
        F.lit("Register"),
        F.lit("Bid results"),
        F.lit(None).cast("string"),
        F.concat(F.lit("Tender results "), F.date_format(d, "yyyy MMMM")),
    ]
    urls = [
        F.concat(path, F.lit("a.pdf")),
        F.concat(path, F.lit("b.pdf")),
        F.concat(path, F.lit("c.pdf")),
        F.concat(path, F.lit("Results_"), F.date_format(d, "d_MMM_yyyy"), F.lit(".pdf")),
        F.concat(path, F.date_format(d, "MMMM%20yyyy"), F.lit("/e.pdf")),
        F.concat(path, F.lit("f.pdf")),
        F.concat(path, F.lit("g.pdf")),
    ]
    stored = F.when(k % 5 == 0, d).when(k % 5 == 1, F.trunc(d, "month")).when(k % 5 == 2, F.date_add(d, 400))
    return t.raw("orders").select(
        k.alias("id"),
        pick(titles, k).alias("title"),
        pick(urls, k).alias("source_url"),
        stored.alias("issue_date"),
        F.when(k % 5 == 2, "year").when(k % 5 != 1, "day").alias("issue_date_precision"),
        F.lit(None).cast("string").alias("issue_date_raw"),
        F.when(k % 10 == 0, d).otherwise(F.date_add(d, 900)).alias("created_at"),
        F.date_add(d, 901).alias("retrieved_at"),
        F.date_add(d, 902).alias("discovered_at"),
        F.when(k % 2 == 0, "government_procurement_disclosure").otherwise("annual_report").alias("evidence_type"),
    )


def supplier_texts(t) -> DataFrame:
    """Raw supplier names as registers print them."""
    k = K(CUSTOMER)
    forms = [
        F.concat(F.lit("  Kestrel "), s(k), F.lit("  Builders ( PTY ) LTD. ")),
        F.concat(F.lit("Kestrel "), s(k), F.lit(" t/a Heron "), s(k)),
        F.concat(F.lit("Heron Print "), s(k), F.lit(" - a division of Kestrel "), s(k), F.lit(" pty ltd")),
        F.concat(F.lit("‘Quoted’ Works "), s(k), F.lit(" ltd.")),
        F.concat(F.lit("Kestrel "), s(k), F.lit(" JV Heron "), s(k)),
        F.lit("tion Services"),
        F.lit("Thandi Mokoena"),
        F.lit("Various"),
        F.concat(F.lit("Kestrel Engineering Services "), s(k), F.lit(" incorporated")),
        F.lit("GWK Limited"),
    ]
    return t.raw("customer").select(k.alias("id"), pick(forms, k).alias("raw"), F.when(k % 20 == 9, "1998/000123/06").alias("registration"))


def accent_names(t) -> DataFrame:
    k = K(CUSTOMER)
    forms = [
        F.concat(F.lit("Société "), s(k), F.lit(" & Söhne (Pty) Ltd")),
        F.concat(F.lit("THE  Ñandú-Group "), s(k)),
        F.concat(F.lit("O’Brien "), s(k), F.lit(", Inc.")),
        F.concat(F.lit("Ševčík Holdings "), s(k)),
        F.lit("(Pty) Ltd"),
    ]
    return t.raw("customer").select(k.alias("id"), pick(forms, k).alias("raw"))


def registration_texts(t) -> DataFrame:
    k = K(CUSTOMER)
    digits = F.lpad(s(k % 1000000), 6, "0")
    forms = [
        F.concat(F.lit("1998/"), digits, F.lit("/07")),
        F.concat(F.lit(" 2004 / "), digits, F.lit(" / 23")),
        F.concat(F.lit("1890/"), digits, F.lit("/07")),
        F.concat(F.lit("2011/"), digits, F.lit("/99")),
        F.lit("2002/001364/07"),
        F.concat(F.lit("CK"), digits),
        F.lit(None).cast("string"),
    ]
    return t.raw("customer").select(k.alias("id"), pick(forms, k).alias("raw"))


def claim_texts(t) -> DataFrame:
    """(field spelling, value) pairs as extractors write them."""
    k = K(ORDER)
    fields = ["company name", "signed_by", "certificate_no", "verifier", "measured_entity", "B-BBEE-level", "trading_name", "odd field"]
    values = [
        F.concat(F.lit("Kestrel "), s(k), F.lit(" (Pty) Ltd")),
        F.lit("Nomsa van Wyk"),
        F.concat(F.lit("CERT-"), s(k)),
        F.lit("per technical annexure"),
        F.lit("This certificate has been issued to"),
        F.lit("2"),
        F.lit("Heron,"),
        F.lit("x"),
        F.lit("Date"),
        F.lit("AQRate verification"),
        F.lit("  "),
    ]
    return t.raw("orders").select(k.alias("id"), pick(fields, k).alias("field_key"), pick(values, F.floor(k / 8)).alias("value"))


def agency_texts(t) -> DataFrame:
    k = K(ORDER)
    forms = [
        F.lit("Empower Logic  ratings"),
        F.lit("SANAS"),
        F.concat(F.lit("Verifier "), s(k % 50)),
        F.lit("per certificate"),
        F.lit("Honeycomb"),
        F.lit("Technical Signatory"),
        F.lit("B-BBEE certificate incorporates following"),
        F.lit("No"),
        F.lit("Mosela Rating Agency"),
    ]
    return t.raw("orders").select(k.alias("id"), pick(forms, k).alias("raw"))


def certificate_texts(t) -> DataFrame:
    """One certificate per order, modelled on real layouts, years 2017 to 2023."""
    o = spread(t, ["o_orderkey", "o_custkey", "o_orderdate"])
    k, d = K(ORDER), F.add_months(F.to_date("o_orderdate"), 264)
    number = F.concat(s(1990 + K("o_custkey") % 30), F.lit("/"), F.lpad(s(K("o_custkey") % 1000000), 6, "0"), F.lit("/07"))
    issue_line = pick(
        [
            F.concat(F.lit("Issue date: "), F.date_format(d, "yyyy-MM-dd")),
            F.concat(F.lit("Date of issue: "), F.date_format(d, "d MMMM yyyy")),
            F.concat(F.lit("Date issued "), F.date_format(d, "dd/MM/yyyy")),
            F.concat(F.date_format(d, "d MMMM yyyy"), F.lit(" issue date")),
            F.lit("Undated copy"),
        ],
        k,
    )
    expiry_line = pick(
        [
            F.concat(F.lit("Expiry date: "), F.date_format(F.date_add(d, 364), "yyyy-MM-dd")),
            F.lit("This certificate is valid for 12 months"),
            F.concat(F.lit("Valid until "), F.date_format(F.date_sub(d, 30), "d MMM yyyy")),
        ],
        F.floor(k / 5),
    )
    text = F.concat_ws(
        "\n",
        F.when(k % 9 == 0, "Sworn affidavit").otherwise("B-BBEE Certificate"),
        F.concat(F.lit("Certificate number: ABC"), s(k)),
        F.concat(F.lit("Measured entity: Kestrel "), s(K("o_custkey")), F.lit(" Builders (Pty) Ltd")),
        F.concat(F.lit("Registration number: "), number),
        F.concat(F.lit("B-BBEE status level: Level "), s(1 + k % 8)),
        F.concat(F.lit("Recognition level: "), s(100 + k % 36), F.lit("%")),
        F.concat(F.lit("Scorecard type: "), pick(["Generic", "QSE", "EME"], k)),
        issue_line,
        expiry_line,
        pick(["Verification agency: AQRate (Pty) Ltd BVA018", "Verification agency: Plain Ratings CC", "Verified by the board"], F.floor(k / 15)),
        F.lit("Agency registration 2002/001364/07 SANAS"),
        F.lit("Technical signatory: Nomsa van Wyk"),
        F.when(k % 6 == 0, "Annexure A: subsidiary 2001/000001/07"),
    )
    return o.select(k.alias("doc_id"), text.alias("text"), number.alias("registration"))


OPENING = "opening"


def opening_registers(t) -> DataFrame:
    k, c = K(ORDER), K("o_custkey")
    d = F.add_months(F.to_date("o_orderdate"), 300)
    text = F.concat_ws(
        "\n",
        F.lit("BID OPENING REGISTER"),
        F.concat(F.lit("Tender number T "), s(k), F.lit("/2025")),
        F.concat(F.lit("Closing date "), F.date_format(d, "d MMMM yyyy")),
        F.lit("Before Header Bidder Level 1"),
        F.when(k % 3 == 0, "NAME OF BIDDER").otherwise("NAME OF BIDDER      B-BBEE LEVEL"),
        F.concat(F.lit("1  Kestrel "), s(c), F.lit(" Builders (Pty) Ltd   Level "), s(1 + k % 9)),
        F.concat(F.lit("Heron Printers CC   "), s(1 + k % 8)),
        F.lit("Missing Papers Bidder   Not attached"),
        F.lit("no level on this line"),
        F.lit("Officials responsible: two"),
        F.lit("After End Bidder   Level 2"),
    )
    return spread(t, ["o_orderkey", "o_custkey", "o_orderdate"]).select(k.alias("document_id"), text.alias("text"))


def award_registers(t) -> DataFrame:
    k, c = K(ORDER), K("o_custkey")
    d = F.add_months(F.to_date("o_orderdate"), 300)
    text = F.concat_ws(
        "\n",
        F.lit("AWARD REGISTER"),
        F.concat(F.lit("Tender number SC "), s(k)),
        F.concat(F.lit("Date awarded "), F.date_format(d, "d MMMM yyyy")),
        F.lit("Earlier Line Level 4"),
        F.lit("SUCCESSFUL BIDDER     B-BBEE LEVEL"),
        F.concat(F.lit("Kestrel "), s(c), F.lit(" Roads (Pty) Ltd   Level "), s(1 + k % 8)),
        F.when(k % 4 == 0, "Dropped Works CC cancelled 3").otherwise("Heron Hardware CC   N/A"),
        F.concat(F.lit("Awarded to Overberg "), s(c), F.lit(" Hardware (Pty) Ltd   2")),
        F.lit("Prose without any level"),
    )
    return spread(t, ["o_orderkey", "o_custkey", "o_orderdate"]).select(k.alias("document_id"), text.alias("text"))


def scm_reports(t) -> DataFrame:
    k, c = K(ORDER), K("o_custkey")
    d = F.add_months(F.to_date("o_orderdate"), 300)
    text = F.concat_ws(
        "\n",
        F.lit("SCM IMPLEMENTATION REPORT"),
        F.concat(F.lit("Awarded to: Kestrel "), s(c), F.lit(" Plant Hire (Pty) Ltd")),
        F.concat(F.lit("B-BBEE level: Level "), s(1 + k % 8)),
        F.concat(F.lit("Award date: "), F.date_format(d, "d MMMM yyyy")),
        F.lit(""),
        F.lit("Successful bidder: Heron Cleaning CC"),
        F.concat(F.lit("Tender number: Q"), s(k)),
        F.concat(F.lit("Adjudication date: "), F.date_format(d, "MMMM yyyy")),
    )
    return spread(t, ["o_orderkey", "o_custkey", "o_orderdate"]).select(k.alias("document_id"), text.alias("text"))


def register_pages(t) -> DataFrame:
    """HTML register per order: award or bidder header, sometimes below a title row."""
    k, c = K(ORDER), K("o_custkey")
    d = F.add_months(F.to_date("o_orderdate"), 300)
    head = F.when(k % 3 == 0, "<th>NAME OF BIDDER</th>").when(k % 3 == 1, "<th>Awarded&nbsp;to</th>").otherwise("<th>Supplier</th>")
    html = F.concat(
        F.lit("<html><body><p>x</p><TABLE class='t'>"),
        F.when(k % 2 == 0, "<tr><td colspan=4>Results</td></tr>").otherwise(""),
        F.lit("<tr>"),
        head,
        F.lit("<th>B-BBEE Level</th><th>Tender No</th><th>Date of award</th></tr>"),
        F.lit("<tr><td><b>Kestrel "),
        s(c),
        F.lit("</b> &amp; Sons (Pty) Ltd</td><td>Level "),
        s(1 + k % 9),
        F.lit("</td><td>T"),
        s(k),
        F.lit("</td><td>5</td><td>"),
        F.date_format(d, "dd-MMM-yy"),
        F.lit("</td></tr><tr><td>Heron<br/>Works CC</td><td>4</td><td></td><td>"),
        F.date_format(d, "d MMMM yyyy"),
        F.lit("</td></tr><tr><td>short</td></tr></TABLE><table><tr><td>a</td></tr><tr><td>b</td></tr></table></body></html>"),
    )
    return spread(t, ["o_orderkey", "o_custkey", "o_orderdate"]).select(k.alias("document_id"), html.alias("html"))


def candidates(t) -> DataFrame:
    """Register candidates with every kind of flaw."""
    k, c = K(ORDER), K("o_custkey")
    d = F.add_months(F.to_date("o_orderdate"), 300)
    names = [
        F.concat(F.lit("Kestrel Plant Hire (PTY) LTD")),
        F.concat(F.lit("Heron Works "), s(c % 7), F.lit(" Limited")),
        F.concat(F.lit("Kestrel Roads JV Heron Works")),
        F.lit("Ltd"),
        F.lit("Supply of Kestrel Catering Pty Ltd"),
    ]
    return spread(t, ["o_orderkey", "o_custkey", "o_orderdate"]).select(
        k.alias("document_id"),
        F.lit(0).alias("line_no"),
        pick(names, k).alias("supplier_name"),
        pick(["Level 1", "2", "85 points", "L 4", "Level 12", "Level 3"], k).alias("bee_level_raw"),
        F.when(k % 13 == 0, "").when(k % 7 == 0, "2019").otherwise(F.date_format(d, "d MMMM yyyy")).alias("date_raw"),
        pick(["awarded", "Bidder_Register", "responded", "maybe"], F.floor(k / 3)).alias("outcome"),
        F.when(k % 11 == 0, "ftp://x").otherwise(F.concat(F.lit("https://tenders.example.org/"), s(k % 400))).alias("source_url"),
        F.when(k % 17 == 0, " ").otherwise("Council").alias("institution"),
        F.when(k % 5 == 0, "bidder_register").otherwise("awarded").alias("evidence_mode"),
        F.when(k % 8 == 0, "Bids received register").otherwise("Awards").alias("document_title"),
        F.when(k % 2 == 0, F.concat(F.lit("T"), s(k % 50))).alias("tender_number"),
    )


def corpus_items(t) -> DataFrame:
    """One corpus item per customer; groups of eight, in which one company turns up under three names.

    Place 0 gives name A and a number, place 1 name B and that number, place 2
    name C with alias B: one company, though 0 and 2 share nothing.  Place 3 is
    a stored company, place 4 stored by number and names place 5 by an alias,
    place 6 is held unless its number is that of place 0, place 7 is old.
    """
    k = K(CUSTOMER)
    g, p = F.floor(k / 8), (k % 8).cast("int")
    number = F.concat(s(1990 + g % 30), F.lit("/"), F.lpad(s(500000 + g), 6, "0"), F.lit("/07"))
    stored_number = F.concat(s(1990 + k % 30), F.lit("/"), F.lpad(s(k % 1000000), 6, "0"), F.lit("/07"))
    name = pick(
        [
            F.concat(F.lit("Kestrel "), s(g), F.lit(" Builders (Pty) Ltd")),
            F.concat(F.lit("Heron "), s(g), F.lit(" Roads Ltd t/a Heron Tar "), s(g)),
            F.concat(F.lit("Overberg "), s(g), F.lit(" Plant Hire Limited")),
            F.concat(F.lit("Firm "), s(k), F.lit(" "), F.when(g % 4 == 0, "Trading").otherwise(pick(NAME_WORDS, k))),
            F.concat(F.lit("Nightjar "), s(g), F.lit(" Works CC")),
            F.concat(F.lit("Plover "), s(g), F.lit(" Trust Services")),
            F.lit("tion Services"),
            F.concat(F.lit("Wagtail "), s(g), F.lit(" Timber Ltd")),
        ],
        k,
    )
    none = F.lit(None).cast("string")
    day = F.concat(s(2018 + g % 8), F.lit("-0"), s(1 + g % 9), F.lit("-15"))

    def disclosure(n: Column, date: Column) -> Column:
        values = {
            "sourceUrl": F.when(g % 11 == 10, "http://10.0.0.1/x").otherwise(F.concat(F.lit("https://tenders.example.org/awards/t"), n)),
            "governmentInstitution": F.concat(F.lit("Department "), s(g % 17)),
            "tenderNumber": F.concat(F.lit("T"), n),
            "tenderDescription": F.lit("Road works"),
            "awardDate": date,
            "beeLevel": F.concat(F.lit("Level "), s(1 + g % 8)),
            "enterpriseClass": F.lit("eme"),
            "contractPeriod": none,
            "contractAmount": F.lit("R 5"),
            "sourceTitle": F.when(g % 3 == 0, "Award of 3 March 2025"),
            "outcome": F.when(g % 4 == 0, "unsuccessful").when(g % 4 == 1, "responded").otherwise("awarded"),
        }
        return F.struct(*[v.alias(f) for f, v in values.items()])

    dated = F.when(g % 3 == 1, day)
    paper = F.struct(F.concat(F.lit("https://www.kestrel"), s(g), F.lit(".example.com/cert.pdf")).alias("url"), *[none.alias(f) for f in ("title", "evidenceType", "issueDate", "expiryDate")])
    watched = F.struct(F.concat(F.lit("https://www.kestrel"), s(g), F.lit(".example.com/")).alias("url"), F.lit("company_website").alias("sourceType"), F.lit("weekly").alias("frequency"))
    return t.raw("customer").select(
        k.alias("ordinal"),
        name.alias("canonicalName"),
        F.when(p.isin(1, 4), F.concat(F.lit(" Heron Roads of "), s(g))).alias("legalName"),
        F.when(p.isin(2, 3), F.concat(F.lit("Plant "), s(g))).alias("tradingName"),
        F.when(p < 2, number).when((p == 6) & (g % 2 == 0), number).when(p == 4, stored_number).alias("registrationNumber"),
        F.when(p == 1, F.concat(F.lit("https://heron"), s(g), F.lit(".example.com"))).when(p == 4, "mailto:x").when(p == 3, F.concat(F.lit("http://plant"), s(g), F.lit(".example.com"))).alias("website"),
        F.when(p == 2, F.array(F.concat(F.lit("Heron "), s(g), F.lit(" Roads")), F.lit(" "), F.concat(F.lit("OB "), s(g)))).when(p == 4, F.array(F.concat(F.lit("Plover "), s(g), F.lit(" trust services")))).alias("aliases"),
        F.when(p.isin(0, 1), F.array(F.lit("sec_building"), F.lit("sec_jse"), F.lit("sec_none"))).when(p == 2, F.array(F.lit("sec_machinery"))).alias("sectorIds"),
        (p == 2).alias("jseListed"),
        F.when(p == 3, F.concat(F.lit("Kestrel "), s(g), F.lit(" Builders"))).when(p == 0, F.concat(F.lit("Kestrel "), s(g), F.lit(" Builders"))).alias("parentName"),
        none.alias("entityType"),
        F.when(p == 0, F.array(paper)).alias("evidence"),
        F.when(p == 2, F.array(watched)).alias("sources"),
        F.when(p.isin(1, 3), F.array(disclosure(s(k), dated), disclosure(s(k), dated), disclosure(F.concat(s(k), F.lit("-2020-05")), F.lit("not stated")))).when(p == 7, F.array(disclosure(s(k), F.lit("2019")))).alias("procurement"),
        F.when(p == 3, g % 2 == 0).alias("publishIfSafe"),
    )


def identity_patches(t) -> DataFrame:
    """Four patches per group of four companies, each depending on those before it.

    0 offers its company a number; 1 offers the same number, so it finds what 0
    made, and adds an alias; 2 is known by that alias only and replaces the
    number; 3 offers the first number again, which nobody may hold by then.
    """
    e = t["entities"].filter("merged_into_id is null").select("id", "canonical_name")
    k = K("id")
    g, q = F.floor(k / 4), (k % 4).cast("int")
    number = F.concat(F.lit("2016/"), F.lpad(s(700000 + g), 6, "0"), F.lit("/07"))
    other = F.concat(F.lit("2017/"), F.lpad(s(700000 + g), 6, "0"), F.lit("/07"))
    source = F.struct(F.concat(F.lit("https://kite"), s(F.floor(g / 2)), F.lit(".example.org/x#y")).alias("url"), F.lit(None).cast("string").alias("source_type"), F.lit("weekly").alias("frequency"))
    private = F.struct(F.lit("http://192.168.0.1/").alias("url"), F.lit(None).cast("string").alias("source_type"), F.lit(None).cast("string").alias("frequency"))
    return e.select(
        k.alias("ordinal"),
        F.when(q == 2, F.concat(F.lit("Kite "), s(g))).when(g % 9 == 8, F.concat(F.lit("Nobody "), s(k))).otherwise(F.col("canonical_name")).alias("name"),
        F.when(q == 2, other).when((q == 3) & (g % 5 == 0), "bad number").when((q == 0) & (g % 7 == 6), "1995/000523/07").when((q == 3) & (g % 5 == 1), None).otherwise(number).alias("registration"),
        F.when((q == 2) & (g % 2 == 0), number).alias("replace_if"),
        F.concat(F.lit("https://patch"), s(k), F.lit(".example.com")).alias("website"),
        F.when(q > 0, F.concat(F.lit("Kite "), s(g), F.lit(" Legal "), s(q))).alias("legal_name"),
        F.when(q == 1, F.concat(F.lit("Trade "), s(k))).alias("trading_name"),
        F.when(q == 1, F.array(F.concat(F.lit("kite "), s(g)), F.lit(" "), F.concat(F.lit("KITE "), s(g)))).alias("aliases"),
        F.when(q < 2, F.array(F.lit("sec_building"), F.lit("sec_jse"), F.lit("sec_none"))).alias("sectors"),
        (q == 3).alias("listed"),
        F.when(q != 1, F.concat(F.lit("Kite "), s(g))).alias("parent"),
        F.when(q > 1, F.array(source, private)).alias("sources"),
    )
