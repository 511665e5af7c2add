"""Dates stated in text, their precision, and the date a document carries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from attestor.functions import names as N

# --- fixed values: months ---------------------------------------------------
MONTH_NAMES = ["January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December"]
MONTH_TOKEN = "|".join(MONTH_NAMES) + "|Jan|Feb|Mar|Apr|Jun|Jul|Aug|Sept|Sep|Oct|Nov|Dec"
NOT_STATED = "Not stated in source"
SLASH = r"^(\d{1,2})[/\-.](\d{1,2})[/\-.](\d{4})$"
# Sites whose stored mid-month or year-end days are known to be invented.
MID_MONTH_SITE = r"overstrand\.gov\.za"
YEAR_END_SITE = r"twk\.gov\.za"
MID_YEAR_SITE = r"stellenbosch\.gov\.za"


def month_number(token: Column) -> Column:
    """1-12 for a full or short month name, else null."""
    pairs: list[Column] = []
    for i, name in enumerate(MONTH_NAMES, start=1):
        for form in {name.lower(), name[:3].lower()}:
            pairs += [F.lit(form), F.lit(i)]
    pairs += [F.lit("sept"), F.lit(9)]
    return F.try_element_at(F.create_map(*pairs), F.lower(token))


def month_prefix(token: Column) -> Column:
    """Month of a word by its first three letters."""
    return month_number(F.substring(token, 1, 3))


def month_label(number: Column) -> Column:
    return F.try_element_at(F.array(*[F.lit(m) for m in MONTH_NAMES]), number.cast("int"))


def _pad(col: Column, n: int = 2) -> Column:
    return F.lpad(col.cast("string"), n, "0")


def _iso(y: Column, m: Column, d: Column) -> Column:
    return F.concat_ws("-", y.cast("string"), _pad(m), _pad(d))


def _some(col: Column) -> Column:
    return F.nullif(col, F.lit(""))


def _group(text: Column, pattern: str, i: int) -> Column:
    return _some(F.regexp_extract(text, pattern, i))


def _day_first(t: Column, assume_dmy: bool) -> tuple[Column, Column]:
    """(is the first number the day?, could both be a month?) of ``a/b/yyyy``."""
    a, b = (_group(t, SLASH, i).cast("int") for i in (1, 2))
    both_small = (a <= 12) & (b <= 12)
    day_first = F.when((a > 12) & (b <= 12), True).when((b > 12) & (a <= 12), False)
    if assume_dmy:
        day_first = F.coalesce(day_first, F.when(both_small, True))
    return day_first, both_small


def date_candidate(t: Column, assume_dmy: bool = False) -> Column:
    """``yyyy-MM-dd`` spelt by a clean text; the day may still be impossible."""
    dmy = r"^(\d{1,2})[/\-\s]+([A-Za-z]{3,9})[/\-\s,]+(\d{4})$"
    mdy = r"^([A-Za-z]{3,9})\s+(\d{1,2}),?\s+(\d{4})$"
    short = r"^(\d{1,2})[/\-\s]+([A-Za-z]{3,9})[/\-\s]+(\d{2})$"
    dmy_month, mdy_month, short_month = (
        month_number(_group(t, dmy, 2)),
        month_number(_group(t, mdy, 1)),
        month_number(_group(t, short, 2)),
    )
    yy = _group(t, short, 3).cast("int")
    a, b, y = (_group(t, SLASH, i).cast("int") for i in (1, 2, 3))
    day_first, _ = _day_first(t, assume_dmy)
    return F.coalesce(
        F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}$"), t),
        F.when(dmy_month.isNotNull(), _iso(_group(t, dmy, 3), dmy_month, _group(t, dmy, 1))),
        F.when(mdy_month.isNotNull(), _iso(_group(t, mdy, 3), mdy_month, _group(t, mdy, 2))),
        F.when(short_month.isNotNull(), _iso(F.when(yy >= 80, 1900 + yy).otherwise(2000 + yy), short_month, _group(t, short, 1))),
        F.when(day_first, _iso(y, b, a)).when(~day_first, _iso(y, a, b)),
    )


def is_real_day(candidate: Column) -> Column:
    return F.coalesce(
        candidate.try_cast("date").isNotNull() & F.substring(candidate, 1, 4).cast("int").between(1990, 2100), F.lit(False)
    )


def guessed_note(t: Column) -> Column:
    """Warning of a clean ``dd/mm/yyyy`` text that could be read both ways."""
    _, both_small = _day_first(t, True)
    return F.when(
        both_small, F.concat(F.lit('Interpreted "'), t, F.lit('" as DD/MM/YYYY (South African certificate convention).'))
    )


def parse_date(raw: Column, assume_dmy: bool = False) -> Column:
    """Struct (iso, ambiguous, warning) of a text that should be one date.

    A day/month pair that could be read both ways stays null unless the caller
    says the source writes the day first.
    """
    t = N.collapse(raw)
    a = _group(t, SLASH, 1)
    candidate = date_candidate(t, assume_dmy)
    iso = F.when(is_real_day(candidate), candidate)
    quoted = F.concat(F.lit('"'), t, F.lit('"'))
    blank = t.isNull() | (t == "")
    warning = (
        F.when(blank, F.lit(None).cast("string"))
        .when(iso.isNotNull(), guessed_note(t) if assume_dmy else F.lit(None).cast("string"))
        .when(candidate.isNotNull(), F.concat(F.lit('Impossible date "'), candidate, F.lit('".')))
        .when(a.isNotNull(), F.concat(F.lit("Ambiguous date "), quoted, F.lit(" — not guessed.")))
        .otherwise(F.concat(F.lit("Unrecognised date "), quoted, F.lit(" — left unknown.")))
    )
    ambiguous = ~blank & candidate.isNull()
    return F.struct(iso.alias("iso"), F.coalesce(ambiguous, F.lit(False)).alias("ambiguous"), warning.alias("warning"))


def date_warning(col: Column) -> Column:
    """Warning of ``parse_date``; a real ISO day takes the short way."""
    plain = col.rlike(r"^\d{4}-\d{2}-\d{2}$") & is_real_day(col)
    return F.when(~F.coalesce(plain, F.lit(False)), parse_date(col)["warning"])


def source_date(text: Column) -> Column:
    """Date stated in a text as ``yyyy``, ``yyyy-MM`` or ``yyyy-MM-dd``.

    The first form found decides; an impossible day in it gives null.
    """
    iso = r"\b(20\d{2})-(\d{2})-(\d{2})\b"
    long = r"\b(\d{1,2})\s+([A-Za-z]+)\s+(20\d{2})\b"
    short = r"\b(\d{1,2})[-/]([A-Za-z]{3})[-/](20\d{2}|\d{2})\b"
    month = r"\b([A-Za-z]+)\s+(20\d{2})\b"
    long_month, short_month, name_month = (
        month_prefix(_group(text, long, 2)),
        month_prefix(_group(text, short, 2)),
        month_prefix(_group(text, month, 1)),
    )
    short_year = _group(text, short, 3)

    def real(value: Column) -> Column:
        return F.when(value.try_cast("date").isNotNull(), value)

    return (
        F.when(_group(text, iso, 0).isNotNull(), real(_group(text, iso, 0)))
        .when(long_month.isNotNull(), real(_iso(_group(text, long, 3), long_month, _group(text, long, 1))))
        .when(
            short_month.isNotNull(),
            real(_iso(F.when(F.length(short_year) == 4, short_year).otherwise(F.concat(F.lit("20"), short_year)), short_month, _group(text, short, 1))),
        )
        .when(name_month.isNotNull(), F.concat_ws("-", _group(text, month, 2), _pad(name_month)))
        .otherwise(_group(text, r"\b(20\d{2})\b", 1))
    )


def decode_blob(col: Column) -> Column:
    """URL-decoded text with ``+``, ``_`` and ``-`` as spaces."""
    plus = F.replace(col, F.lit("+"), F.lit(" "))
    fallback = F.regexp_replace(F.replace(plus, F.lit("%20"), F.lit(" ")), "(?i)%2f", "/")
    return F.regexp_replace(F.coalesce(F.try_url_decode(plus), fallback), "[_-]+", " ")


def file_of_url(url: Column) -> Column:
    """Readable file part: the ``file`` parameter, else the path."""
    is_url = url.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://")
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return decode_blob(F.when(~is_url, url).otherwise(F.coalesce(_group(url, r"[?&]file=([^&#]*)", 1), F.when(path == "", "/").otherwise(path))))


PARTS = "struct<y:int,m:int,d:int>"


def _parts(y: Column, m: Column | None = None, d: Column | None = None) -> Column:
    none = F.lit(None).cast("int")
    year = y.cast("int")
    made = F.struct(
        year.alias("y"),
        (none if m is None else m.cast("int")).alias("m"),
        (none if d is None else d.cast("int")).alias("d"),
    )
    return F.when(year.between(1994, 2100), made)


def plain_parts(text: Column) -> Column:
    """Struct (y, m, d) of ``yyyy``, ``yyyy-MM`` or ``yyyy-MM-dd``."""
    return _parts(F.substring(text, 1, 4).try_cast("int"), F.substring(text, 6, 2).try_cast("int"), F.substring(text, 9, 2).try_cast("int"))


def explicit_date(blob: Column) -> Column:
    """Struct (y, m, d) of the first explicit month date in a decoded text, else null.

    Hyphens are separators here, so an ISO day falls through to its year.
    """
    m = MONTH_TOKEN
    forms = [
        (rf"(?i)\b(\d{{1,2}})\s+({m})\s+(20\d{{2}})\b", 3, 2, 1),
        (rf"(?i)\b({m})\s+(\d{{1,2}}),?\s+(20\d{{2}})\b", 3, 1, 2),
        (rf"(?i)\b({m})(?:\s+|\s*[—–]\s*)(20\d{{2}})\b", 2, 1, None),
        (rf"(?i)\b(20\d{{2}})\s+({m})\b", 1, 2, None),
        (rf"(?i)\b({m})\s*(20\d{{2}})\b", 2, 1, None),
    ]
    found = []
    for pattern, y, mo, d in forms:
        year = _group(blob, pattern, y)
        found.append(
            F.when(
                year.isNotNull(),
                _parts(year, month_number(_group(blob, pattern, mo)), None if d is None else _group(blob, pattern, d)),
            )
        )
    return F.coalesce(*found)


def year_of_issue(text: Column, first_year: int = 2024) -> Column:
    """Year of a numbered bulletin or of a financial year such as 2024/25."""
    bulletin = F.coalesce(
        _group(text, r"(?i)/bulletins/(20\d{2})/", 1), _group(text, r"(?i)Government Tender Bulletin (20\d{2})", 1)
    ).cast("int")
    financial = _group(text, r"\b(20\d{2})[-/](\d{2})\b", 1).cast("int")
    return F.coalesce(bulletin, F.when(financial >= first_year, financial))


def stated_year(text: Column) -> Column:
    """Last year up to 2030 in a text; folder tokens such as 2024-01 do not count."""
    cleaned = F.regexp_replace(text, r"\b20\d{2}[-/]\d{1,2}\b", " ")
    years = F.filter(F.regexp_extract_all(cleaned, F.lit(r"\b(20\d{2})\b"), F.lit(1)), lambda y: y.cast("int") <= 2030)
    return F.try_element_at(years, F.lit(-1)).cast("int")


def date_blobs(raw: Column, title: Column, url: Column) -> dict[str, Column]:
    """The texts a date is looked for in: decoded raw text, title and file name."""
    t, u, r = (F.coalesce(c, F.lit("")) for c in (title, url, raw))
    return {"_raw": decode_blob(r), "_title": decode_blob(t), "_name": F.when(u == "", "").otherwise(decode_blob(file_of_url(u)))}


def inferred_parts(title: Column, url: Column) -> Column:
    """Date stated by the source itself, given the columns of ``date_blobs``."""
    t, u = F.coalesce(title, F.lit("")), F.coalesce(url, F.lit(""))
    name = F.col("_name")
    return F.coalesce(
        explicit_date(F.col("_raw")),
        explicit_date(F.col("_title")),
        explicit_date(name),
        _parts(F.coalesce(year_of_issue(t), stated_year(t))),
        _parts(F.coalesce(year_of_issue(name), stated_year(name))),
        _parts(year_of_issue(u)),
    )


def is_import_day(stored: Column, *stamps: Column) -> Column:
    """A stored date that is only the day the row was imported."""
    out = F.lit(False)
    for s in stamps:
        out = out | F.coalesce(stored == s.cast("date"), F.lit(False))
    return out


def _precision(p: Column) -> Column:
    return F.when(p.isNull(), 0).when(p["d"].isNotNull(), 3).when(p["m"].isNotNull(), 2).otherwise(1)


def resolve_parts(
    inferred: Column, stored: Column, precision: Column, import_day: Column, title: Column, url: Column
) -> Column:
    """Choose between the inferred and the stored date (both may be null)."""
    y, m, d = F.year(stored), F.month(stored), F.dayofmonth(stored)
    kept = F.when(
        stored.isNotNull() & ~import_day,
        F.when(precision == "year", _parts(y)).when(precision == "month", _parts(y, m)).otherwise(_parts(y, m, d)),
    )
    site = F.lower(F.concat_ws(" ", F.coalesce(url, F.lit("")), F.coalesce(title, F.lit(""))))
    seen, have = _precision(inferred), _precision(kept)
    month_only = (seen == 2) & kept["d"].isin(1, 15) & (inferred["y"] == kept["y"]) & (inferred["m"] == kept["m"])
    year_only = (seen == 1) & kept["d"].isin(1, 15, 30) & (inferred["y"] == kept["y"])
    year_end = site.rlike(YEAR_END_SITE)
    mid_year = site.rlike(MID_YEAR_SITE)
    known_site = (
        (site.rlike(MID_MONTH_SITE) & (kept["d"] == 15))
        | (year_end & (kept["d"] == 30) & (kept["m"] == 6))
        | (mid_year & (kept["d"] == 15) & (kept["m"] == 6))
    )
    invented = F.coalesce((have == 3) & (month_only | year_only | known_site), F.lit(False))
    demoted = F.when(year_end | mid_year, _parts(y)).otherwise(_parts(y, m))
    return (
        F.when(invented, F.coalesce(inferred, demoted))
        .when(have == 3, kept)
        .when((seen > 0) & (seen < have), kept)
        .otherwise(F.coalesce(inferred, kept))
    )


def describe_parts(p: Column) -> Column:
    """Struct (iso, precision, label, year, month, stated) of a resolved date."""
    iso = F.concat_ws(
        "-", p["y"].cast("string"), _pad(F.coalesce(p["m"], F.lit(1))), _pad(F.coalesce(p["d"], F.lit(1)))
    )
    month = month_label(p["m"])
    label = F.concat_ws(" ", p["d"].cast("string"), month, p["y"].cast("string"))
    stated = p.isNotNull()
    return F.struct(
        F.when(stated, iso).alias("iso"),
        F.when(p["d"].isNotNull(), "day").when(p["m"].isNotNull(), "month").when(stated, "year").alias("precision"),
        F.when(stated, label).otherwise(F.lit(NOT_STATED)).alias("label"),
        p["y"].alias("year"),
        p["m"].alias("month"),
        stated.alias("stated"),
    )


def eligibility(resolved: Column, recent_from: Column) -> Column:
    """modern / past / unknown; an unknown date is never modern."""
    modern = (resolved["iso"] >= F.date_format(recent_from, "yyyy-MM-dd")) | (resolved["year"] >= F.year(recent_from))
    return F.when(F.coalesce(modern, F.lit(False)), "modern").when(resolved["stated"], "past").otherwise("unknown")


def polish_title(title: Column) -> Column:
    """Full month names and spaced dashes in titles of award registers and others."""
    t = F.regexp_replace(N.collapse(title), r"\s+[—–-]\s+", " — ")
    register = r"(?i)^(.*? awards)\s*—\s*([A-Za-z]+)(?:\s+(\d{4}))?$"
    is_register = t.rlike(register)
    small = ["a", "an", "and", "as", "at", "for", "in", "of", "on", "the", "to", "vs"]

    def cased(word: Column, index: Column) -> Column:
        lower = F.lower(word)
        month = month_label(month_number(word))
        return (
            F.when(word.contains("/") | word.rlike(r"^\d"), word)
            .when(month.isNotNull(), month)
            .when((index > 0) & lower.isin(small), lower)
            .when((word == F.upper(word)) & (F.length(word) <= 5), word)
            .otherwise(F.concat(F.upper(F.substring(word, 1, 1)), F.lower(F.substring(word, 2, 1000))))
        )

    head = F.array_join(F.transform(F.split(F.regexp_extract(t, register, 1), r"\s+"), cased), " ")
    tail = F.regexp_extract(t, register, 2)
    month = F.coalesce(month_label(month_number(tail)), cased(tail, F.lit(0)))
    polished = F.concat_ws(" ", F.concat(head, F.lit(" — "), month), _group(t, register, 3))
    plain = t
    for name in MONTH_NAMES:
        forms = {name, name[:3]} | ({"Sept"} if name == "September" else set())
        plain = F.regexp_replace(plain, r"(?i)\b(" + "|".join(sorted(forms, key=len, reverse=True)) + r")\b", name)
    return F.when(F.trim(title) == "", title).when(is_register, polished).otherwise(plain)
