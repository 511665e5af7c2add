"""Column expressions for names, registrations, slugs and URLs.

Everything here is built from JVM-side functions, so it stays inside
whole-stage code generation.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------
COMPANY_WORDS = ["pty", "ltd", "limited", "inc", "incorporated", "proprietary", "co", "company", "holdings", "group", "the"]
ENTITY_TYPE_CODES = ["06", "07", "08", "09", "10", "21", "22", "23", "24", "25", "26", "30"]
VERIFIER_REGISTRATIONS = ["199500052307", "200200136407", "200101796307", "200102796307", "200501773707", "200400940507"]
CLEARED_REGISTRATIONS = ["199500052307", "200200136407", "200101796307", "200102796307"]
VERIFIER_NAMES = r"(?i)empowerlogic|aqrate|empowerdex"

#: White space beyond ASCII that the rules treat as such.
WIDE_SPACES = "\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"


def _compatible() -> tuple[str, str, dict[str, str]]:
    """Characters with a compatibility form: those with one plain character, in order, and the others."""
    marked, plain, longer = [], [], {}
    for c in map(chr, range(0xA1, 0x10000)):
        form = "".join(x for x in unicodedata.normalize("NFKD", c) if not "\u0300" <= x <= "\u036f")
        if c in WIDE_SPACES or form in ("", c) or "\u0300" <= c <= "\u036f" or "\uac00" <= c <= "\ud7a3":
            continue
        if len(form) == 1:
            marked.append(c)
            plain.append(form)
        elif "LIGATURE" in unicodedata.name(c, "") and c >= "\ufb00" and form.isascii():
            longer[c] = form
    return "".join(marked), "".join(plain), longer


_MARKED, _PLAIN, _LIGATURES = _compatible()


#: The same as a class; the look-ahead passes over printed ASCII in one test.
_SPACES = r"(?![!-~])[\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]+"


def is_ascii(col: Column) -> Column:
    """No character needs more than one byte; such texts take the short way everywhere."""
    return F.octet_length(col) == F.char_length(col)


def plain_spaces(col: Column) -> Column:
    """Wide spaces as blanks; no character moves."""
    return F.when(is_ascii(col), col).otherwise(F.translate(col, WIDE_SPACES, " " * len(WIDE_SPACES)))


def fold(col: Column) -> Column:
    """Lower case of the compatibility form, without accents and combining marks."""
    t = F.translate(col, WIDE_SPACES + _MARKED, " " * len(WIDE_SPACES) + _PLAIN)
    t = F.regexp_replace(t, r"[\u0300-\u036f]", "")
    for letter, form in _LIGATURES.items():
        t = F.replace(t, F.lit(letter), F.lit(form))
    return F.lower(F.when(is_ascii(col), col).otherwise(t))


def collapse(col: Column) -> Column:
    return F.trim(F.regexp_replace(col, _SPACES, " "))


def collapse_text(col: Column) -> Column:
    """``collapse`` for a column that holds whole texts."""
    return F.trim(F.when(is_ascii(col), F.regexp_replace(col, r"\s+", " ")).otherwise(F.regexp_replace(col, _SPACES, " ")))


def strip_punctuation(col: Column) -> Column:
    return F.regexp_replace(col, r"[^\p{L}\p{N}]+", " ")


def _squeeze(col: Column) -> Column:
    """``collapse`` behind ``strip_punctuation``, which leaves blanks only."""
    return F.trim(F.regexp_replace(col, " {2,}", " "))


def normalize_name(col: Column) -> Column:
    """Comparable company name: folded, ``&`` spelt out, company words dropped."""
    words = strip_punctuation(F.replace(fold(col), F.lit("&"), F.lit(" and ")))
    return _squeeze(F.regexp_replace(words, r"\b(" + "|".join(COMPANY_WORDS) + r")\b", " "))


def normalize_alias(col: Column) -> Column:
    """Comparable alias; company words are kept."""
    return F.trim(strip_punctuation(fold(col)))


def normalize_registration(col: Column) -> Column:
    return F.regexp_replace(fold(col), "[^a-z0-9]", "")


def is_company_registration(col: Column) -> Column:
    n = normalize_registration(col)
    year = F.substring(n, 1, 4).try_cast("int")
    return F.coalesce(
        n.rlike(r"^\d{12}$") & year.between(1900, 2030) & F.substring(n, 11, 2).isin(ENTITY_TYPE_CODES),
        F.lit(False),
    )


def is_verifier_registration(col: Column) -> Column:
    return F.coalesce(normalize_registration(col).isin(VERIFIER_REGISTRATIONS), F.lit(False))


def format_registration(col: Column) -> Column:
    """``yyyy/nnnnnn/tt`` when the number is a valid company number, else null."""
    n = normalize_registration(col)
    return F.when(
        is_company_registration(col),
        F.concat_ws("/", F.substring(n, 1, 4), F.substring(n, 5, 6), F.substring(n, 11, 2)),
    )


def slugify(col: Column) -> Column:
    base = F.replace(normalize_alias(col), F.lit(" "), F.lit("-"))
    return F.substring(F.regexp_replace(base, "^$", "entity"), 1, 80)


def blank(col: Column) -> Column:
    return col.isNull() | (F.trim(col) == "")


def website_host(col: Column) -> Column:
    """Host of a website string as the reports compare it: no scheme, path or ``www.``."""
    bare = F.regexp_replace(col, r"^https?://", "")
    return F.regexp_replace(F.lower(F.split_part(bare, F.lit("/"), F.lit(1))), r"^www\.", "")


def url_host(col: Column) -> Column:
    """Host of an absolute URL without ``www.``; null when it is not a URL."""
    host = F.lower(F.regexp_extract(col, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.when(host != "", F.regexp_replace(host, r"^www\.", ""))


#: Hosts that no job may fetch: this machine, private networks, multicast.
PRIVATE_HOST = (
    r"^(localhost\.?|.*\.(localhost|local|internal)\.?"
    r"|(0|10|127|169\.254|172\.(1[6-9]|2\d|3[01])|192\.168|22[4-9]|23\d)(\.\d{1,3})+|255\.255\.255\.255"
    r"|\[(::1?|fe80:.*|f[cd].*|::ffff:(0|10|127|169\.254|172\.(1[6-9]|2\d|3[01])|192\.168|22[4-9]|23\d)\..*)\])$"
)


def fetchable_url(col: Column) -> Column:
    """An absolute web address of a public host; false for null."""
    host = F.lower(F.regexp_extract(F.trim(col), r"(?i)^https?://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]+)", 1))
    return F.coalesce((host != "") & ~host.rlike(PRIVATE_HOST), F.lit(False))


def canonical_url(col: Column) -> Column:
    """Lower-case scheme and host, no fragment, default port or trailing path slash."""
    pattern = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?"
    scheme = F.lower(F.regexp_extract(col, pattern, 1))
    host = F.lower(F.regexp_extract(col, pattern, 2))
    port = F.when(scheme == "http", F.regexp_replace(host, ":80$", "")).otherwise(
        F.regexp_replace(host, ":443$", "")
    )
    path = F.regexp_extract(col, pattern, 3)
    # A URL parser always yields at least "/" and only one trailing slash is cut.
    path = F.when(path == "", F.lit("/")).when(F.length(path) > 1, F.regexp_replace(path, "/$", "")).otherwise(path)
    query = F.regexp_extract(col, pattern, 4)
    return F.when(scheme != "", F.concat(scheme, F.lit("://"), port, path, F.when(query == "?", "").otherwise(query)))


def is_official_domain(source_domain: Column, website: Column) -> Column:
    """Same host, or one is a sub-domain of the other."""
    a = F.lower(F.regexp_replace(source_domain, r"(?i)^www\.", ""))
    b = url_host(F.when(website.startswith("http"), website).otherwise(F.concat(F.lit("https://"), website)))
    return F.coalesce(
        (a == b) | a.endswith(F.concat(F.lit("."), b)) | b.endswith(F.concat(F.lit("."), a)),
        F.lit(False),
    )


def normalize_level(col: Column) -> Column:
    """Contribution level 1-8 or ``non-compliant`` from words or digits."""
    t = F.regexp_replace(F.lower(col), r"contributor|contributor status|b-?bbee|status", " ")
    word = F.regexp_extract(t, r"\b(one|two|three|four|five|six|seven|eight)\b", 1)
    numbers = F.create_map(
        *[
            F.lit(x)
            for pair in zip(("one", "two", "three", "four", "five", "six", "seven", "eight"), "12345678")
            for x in pair
        ]
    )
    labelled = F.regexp_extract(t, r"\blevel\s*([1-8])\b", 1)
    bare = F.regexp_extract(t, r"\b([1-8])\b", 1)
    return (
        F.when(F.nullif(word, F.lit("")).isNotNull(), F.try_element_at(numbers, word))
        .when(labelled != "", labelled)
        .when(bare != "", bare)
        .when(t.rlike(r"non[-\s]?compliant"), F.lit("non-compliant"))
    )


def display_level(col: Column) -> Column:
    return (
        F.when(col == "", F.lit(None).cast("string"))
        .when(col == "non-compliant", F.lit("Non-compliant"))
        .when(col.rlike("^[1-8]$"), F.concat(F.lit("Level "), col))
        .otherwise(col)
    )
