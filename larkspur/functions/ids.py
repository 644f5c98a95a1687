"""Identifiers, keys and hashes as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The weights of the first eight digits of a company number, and its written form.
UID_WEIGHTS = (5, 4, 3, 2, 7, 6, 5, 4)
UID_PATTERN = r"(?i)CHE[\s\-–.]?([0-9]{3})[\s.]?([0-9]{3})[\s.]?([0-9]{3})"
#: Fixed value: the letters of a personal code.
CODE_PATTERN = r"[A-HJ-NP-Z2-9]{6}"
CODE_LENGTH = 6


def digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def is_valid_uid(uid: Column) -> Column:
    """Nine digits of which the last is 11 less the weighted sum modulo 11 (11 counts as 0; 10 is never valid)."""
    d = digits(uid)
    total = sum(F.substring(d, k + 1, 1).try_cast("int") * w for k, w in enumerate(UID_WEIGHTS))
    expected = 11 - total % 11
    return F.coalesce((F.length(d) == 9) & (expected != 10) & (F.substring(d, 9, 1).try_cast("int") == F.when(expected == 11, 0).otherwise(expected)), F.lit(False))


def find_uids(text: Column) -> Column:
    """Every valid number in a text, once, in order."""
    found = F.transform(F.regexp_extract_all(text, F.lit(UID_PATTERN), F.lit(0)), lambda x: F.concat(F.lit("CHE"), digits(x)))
    return F.array_distinct(F.filter(found, is_valid_uid))


def normalised_uid(text: Column) -> Column:
    """The first thing in a text that looks like a number; null without one."""
    found = F.regexp_extract(text, UID_PATTERN, 0)
    return F.when(found != "", F.concat(F.lit("CHE"), digits(found)))


def dotted_uid(uid: Column) -> Column:
    return F.regexp_replace(uid, r"^CHE([0-9]{3})([0-9]{3})([0-9]{3})$", r"CHE-$1.$2.$3")


def uid_match(uid: Column, text: Column) -> Column:
    found = find_uids(text)
    return F.when(F.size(found) == 0, "absent").when(F.array_contains(found, uid), "match").otherwise("different")


def goal_hash(goal: Column) -> Column:
    return F.substring(F.sha2(F.lower(F.regexp_replace(F.trim(goal), r"\s+", " ")), 256), 1, 12)


def arm(uid: Column) -> Column:
    """The arm of the experiment: the parity of the company's SHA-256, which its last hex digit tells."""
    return F.when(F.conv(F.right(F.sha2(uid.cast("string"), 256), F.lit(1)), 16, 10).cast("int") % 2 == 0, "voll").otherwise("kurz")


def address_key(email: Column) -> Column:
    """How spellings of an address compare. ASCII domains; text.address_key is for others as well."""
    return F.lower(F.trim(email))


def email_host(email: Column) -> Column:
    return F.lower(F.regexp_extract(email, r"([^@]*)$", 1))


def profile_key(url: Column) -> Column:
    """A profile's link without scheme, www, query and last slash, in lower case, and without the country of its host."""
    bare = F.regexp_replace(F.lower(F.trim(url)), r"^[a-z]+://|[?#].*$", "")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(bare, r"^www\.", ""), r"^[a-z0-9-]+\.linkedin\.com", "linkedin.com"), "/+$", "")


def code_in(text: Column) -> Column:
    """The personal code in a link (its parameter c) or in a text; null if it isn't one."""
    code = F.upper(F.trim(F.coalesce(F.nullif(F.regexp_extract(text, r"[?&]c=([^&#]*)", 1), F.lit("")), text)))
    return F.when(code.rlike(f"^{CODE_PATTERN}$"), code)


def parsed_key(key: Column) -> Column:
    """kind (uid, address, profile or error) and value of what a person is to be forgotten by."""
    bare = F.trim(key)
    uid = normalised_uid(bare)
    kind = F.when(uid.isNotNull() & is_valid_uid(uid), "uid").when(bare.rlike(r"^[^@\s]+@[^@\s]+\.[^@\s]+$"), "address").when(F.lower(bare).contains("linkedin.com/"), "profile").otherwise("error")
    return F.struct(kind.alias("kind"), F.when(kind == "uid", uid).when(kind == "address", address_key(bare)).when(kind == "profile", profile_key(bare)).alias("value"))


def folded_domain_name(name: Column) -> Column:
    out = F.lower(name)
    for a, b in (("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("ß", "ss"), ("é", "e"), ("è", "e"), ("à", "a"), ("ç", "c")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.trim(F.regexp_replace(out, "[^a-z0-9]+", " "))


def guessed_domains(name: Column) -> Column:
    """A name's words joined and with hyphens, under two endings."""
    words = folded_domain_name(name)
    stems = F.array_distinct(F.array(F.replace(words, F.lit(" "), F.lit("")), F.replace(words, F.lit(" "), F.lit("-"))))
    return F.when(words == "", F.array().cast("array<string>")).otherwise(F.flatten(F.transform(stems, lambda s: F.array(F.concat(s, F.lit(".ch")), F.concat(s, F.lit(".com"))))))


def percent_encoded(x: Column) -> Column:
    """As RFC 3986 has it: a space is %20, and * and ~ are the other way round than in form data."""
    return F.replace(F.replace(F.replace(F.url_encode(x), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def mailto(to: Column, subject: Column, body: Column) -> Column:
    """A mailto link and whether it fits: under 2000 characters."""
    link = F.concat(F.lit("mailto:"), F.replace(percent_encoded(to), F.lit("%40"), F.lit("@")), F.lit("?subject="), percent_encoded(subject), F.lit("&body="), percent_encoded(F.regexp_replace(body, r"\r?\n", "\r\n")))
    return F.struct(link.alias("link"), (F.length(link) < 2000).alias("fits"))


def survey_link(base: str, uid: Column) -> Column:
    return F.concat(F.lit(base + ("&" if "?" in base else "?") + "c="), uid)


def body_sha256(body: Column) -> Column:
    return F.sha2(body, 256)


def cache_key(url: Column) -> Column:
    return F.sha1(url)


def municipality_ids(values: Column) -> Column:
    """The numbers in an array of texts with commas, each once, in order; null if a part isn't a number."""
    parts = F.flatten(F.transform(values, lambda v: F.transform(F.split(v, ","), lambda x: F.trim(x))))
    return F.when(F.forall(parts, lambda p: p.rlike("^[0-9]+$")), F.array_distinct(parts))


def outlook(base: str, to: Column, subject: Column, body: Column, most: int = 2000) -> Column:
    """A link to a web mailer's compose page and whether it fits."""
    link = F.concat(F.lit(base + ("&" if "?" in base else "?") + "to="), percent_encoded(to), F.lit("&subject="), percent_encoded(subject), F.lit("&body="), percent_encoded(body))
    return F.struct(link.alias("link"), (F.length(link) < most).alias("fits"))
