"""The parts of an invitation, each a column; a mail is those that there are, a blank line between them."""

from __future__ import annotations

import re
from collections.abc import Mapping
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .drafts import PATTERNS, has_link
from .text import FEMININE, MONTHS

#: The words of the frame.
WEEKDAYS = ("Sonntag", "Montag", "Dienstag", "Mittwoch", "Donnerstag", "Freitag", "Samstag")
FORWARD = " – besten Dank fürs Weiterleiten"
MANAGEMENT = "Zuhanden der Geschäftsleitung"
RESULTS = "Als Dank können Sie am Schluss die Ergebnisse anfordern."
UID_NOTE = "Der Link enthält die UID Ihrer Firma; veröffentlicht werden nur zusammengefasste Ergebnisse."
SOURCES = {
    "site/seen": "Ihren Namen und Ihre Adresse habe ich von Ihrer Website und nutze beides nur für diese Anfrage.",
    "site/generic": "Ihren Namen und diese Adresse habe ich von Ihrer Website und nutze beides nur für diese Anfrage.",
    "site/constructed": "Ihren Namen habe ich von Ihrer Website und nutze ihn nur für diese Anfrage.",
    "shab/seen": "Ihren Namen habe ich aus dem Handelsamtsblatt (SHAB), Ihre Adresse von Ihrer Website; ich nutze beides nur für diese Anfrage.",
    "shab/generic": "Ihren Namen habe ich aus dem Handelsamtsblatt (SHAB), diese Adresse von Ihrer Website; ich nutze beides nur für diese Anfrage.",
    "shab/constructed": "Ihren Namen habe ich aus dem Handelsamtsblatt (SHAB) und nutze ihn nur für diese Anfrage.",
}
UNNAMED = "Diese Adresse habe ich von Ihrer Website und nutze sie nur für diese Anfrage."
ONCE, REMINDED = "Ich schreibe Ihnen nur dieses eine Mal.", "Ich erinnere Sie höchstens einmal daran."
REFUSE = "Ein kurzes «Nein» genügt, dann lösche ich Ihren Namen."
SUBJECT_CHARS, BODY_CHARS = 60, 1300


class Frame(NamedTuple):
    """What a sender sets once for all mails; closes is a date as a column, or None."""

    name: str
    school: str
    affiliation: str
    topic: str
    minutes: int
    place: str = ""
    supervisor: str = ""
    offer_results: bool = True
    no_login: bool = True
    reminder: bool = False
    sign: bool = True
    closes: Column | None = None


def day(x: Column) -> Column:
    """A date with its weekday, whatever the locale."""
    return F.concat(F.element_at(F.array(*map(F.lit, WEEKDAYS)), F.dayofweek(x)), F.lit(", "), F.dayofmonth(x).cast("string"), F.lit(". "), F.element_at(F.array(*map(F.lit, MONTHS)), F.month(x)))


def is_named(name: Column) -> Column:
    """Whether somebody can be addressed: name is what text.split_name gives."""
    return F.coalesce(F.size(name["given"]) + name["surname"].isNotNull().cast("int") >= 2, F.lit(False))


def addressed(name: Column, word: Column, accusative: bool = False) -> Column:
    """Salutation, title and surname, or the names as they are where either is missing; null if nobody can be addressed."""
    said = F.when(word == "Herr", "Herrn").otherwise(word) if accusative else word
    formal = F.concat_ws(" ", said, F.nullif(name["title"], F.lit("")), name["surname"])
    plain = F.concat_ws(" ", F.array_join(name["given"], " "), name["surname"])
    return F.when(is_named(name), F.when(word.isNotNull() & name["surname"].isNotNull(), formal).otherwise(plain))


def greeting(name: Column, word: Column) -> Column:
    return F.concat_ws(" ", F.lit("Guten Tag"), addressed(name, word))


def routing_line(name: Column, word: Column, kind: Column, source: Column) -> Column:
    """For whoever opens a shared inbox; null for somebody's own address."""
    also = F.when(source == "shab", " oder der Geschäftsleitung").otherwise("")
    to = F.concat(F.lit("Zuhanden "), addressed(name, word, True), also)
    return F.when(kind != "seen", F.concat(F.coalesce(to, F.lit(MANAGEMENT)), F.lit(FORWARD)))


def subject(name: Column, word: Column, kind: Column, frame: Frame) -> Column:
    plain = F.lit(f"Masterarbeit an der {frame.school}: Bitte um {frame.minutes} Minuten")
    to = F.concat(F.lit("Für "), addressed(name, word, True), F.lit(f": Masterarbeit an der {frame.school}"))
    return F.when(kind == "seen", plain).when(~is_named(name), F.lit(f"Für die Geschäftsleitung: Masterarbeit an der {frame.school}")).when(F.length(to) <= SUBJECT_CHARS, to).otherwise(plain)


def link_block(link: Column, short: Column, frame: Frame) -> Column:
    notes = F.concat_ws(", ", F.lit("ohne Anmeldung" if frame.no_login else None), F.concat(F.lit("offen bis "), day(frame.closes)) if frame.closes is not None else F.lit(None).cast("string"))
    head = F.concat(F.lit("Zum Fragebogen"), F.when(notes != "", F.concat(F.lit(" ("), notes, F.lit(")"))).otherwise(""), F.lit(":"))
    return F.concat_ws("\n", F.when(~short & F.lit(frame.offer_results), RESULTS), head, link, F.when(~short, UID_NOTE))


def privacy(name: Column, kind: Column, source: Column, frame: Frame) -> Column:
    """Where name and address came from; null where no mail may be written: to other addresses, and to nobody at a guessed one."""
    once = F.lit(REMINDED if frame.reminder else ONCE)
    origin = F.try_element_at(F.create_map(*(F.lit(x) for pair in SOURCES.items() for x in pair)), F.concat_ws("/", source, kind))
    named = F.when(origin.isNotNull(), F.concat_ws(" ", origin, once, F.lit(REFUSE)))
    return F.when(is_named(name), named).when(kind.isin("seen", "generic"), F.concat_ws(" ", F.lit(UNNAMED), once))


def closing(frame: Frame) -> Column:
    signed = [frame.name, frame.affiliation] + ([f"Betreut von {frame.supervisor}"] if frame.supervisor else [])
    return F.lit("\n".join(["Vielen Dank und freundliche Grüsse", *(signed if frame.sign else [])]))


def body(name: Column, word: Column, kind: Column, source: Column, sentence: Column, link: Column, short: Column, frame: Frame) -> Column:
    """The whole mail around the one sentence that a model wrote, whose sharp s becomes ss."""
    where = f"an der {frame.school}" + (f" in {frame.place}" if frame.place else "")
    opening = f"Ich heisse {frame.name} und studiere {where}. Für meine Masterarbeit wäre ich froh um Ihre Hilfe: Hätten Sie {frame.minutes} Minuten für einen Fragebogen?"
    told = F.concat(F.lit(f"Es geht darum, {frame.topic.rstrip('. ')}. "), F.replace(F.trim(sentence), F.lit("ß"), F.lit("ss")))
    return F.concat_ws("\n\n", routing_line(name, word, kind, source), greeting(name, word), F.lit(opening), told, link_block(link, short, frame), privacy(name, kind, source, frame), closing(frame))


def frame_problems(written: Column, expected: Column, said: Column, sentence: Column, link: Column, subject_: Column, subject_expected: Column, fits: Column) -> Column:
    """What is wrong with the part of a mail that no model wrote, in order."""
    frame = F.replace(F.replace(written, sentence, F.lit("")), link, F.lit(""))
    urls = F.regexp_extract_all(written, F.lit(r"https?://\S+"), F.lit(0))
    rules = {
        "other_url": (F.size(urls) != 1) | (F.get(urls, F.lit(0)) != link), "frame_changed": written != expected, "subject_changed": subject_ != subject_expected, "subject_link": subject_.rlike(PATTERNS["email"]) | has_link(subject_),
        "address": frame.rlike(PATTERNS["email"]), "link": ~frame.rlike(PATTERNS["email"]) & has_link(frame), "placeholder": F.concat_ws("\n", subject_, frame).rlike(PATTERNS["placeholder"]), "eszett": said.contains("ß"),
        "too_long": F.length(written) > BODY_CHARS, "mailto": ~fits,
    }
    return F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(True)), F.lit(k)) for k, c in rules.items())))


def as_html(text: Column) -> Column:
    """A mail as paragraphs, its links as links, everything else escaped."""
    out = text
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    linked = F.regexp_replace(out, r"(https://\S+)", '<a href="$1">$1</a>')
    return F.concat(F.lit("<p>"), F.replace(F.replace(linked, F.lit("\n\n"), F.lit("</p><p>")), F.lit("\n"), F.lit("<br>")), F.lit("</p>"))


def written_salutation(given: list[str], surname: str | None, texts: Mapping[str, str], role: str | None) -> tuple[str, str] | None:
    """Frau or Herr as the pages write it before this person, and whether before the full name; None where it might be somebody else's."""
    if not surname:
        return None
    whole, last = r"\s+".join(map(re.escape, given)), re.escape(surname)
    said: dict[str, set[str]] = {"page": set(), "page-surname": set()}
    for text in texts.values():
        for m in re.finditer(rf"\b(Frau|Herrn?)\s+(?:(?:Prof|Dr)\.\s*)*({whole}\s+)?{last}\b", text):
            if not re.search(r"(?:\b(?:und|oder|et)|[/&+])\s*$", text[: m.start()]):
                said["page" if m[2] else "page-surname"].add("Frau" if m[1] == "Frau" else "Herr")
    origin = "page" if said["page"] else "page-surname"
    before = (m[1] for text in texts.values() for m in re.finditer(rf"\b([A-ZÄÖÜ][\w-]*)\s+{last}\b", text))
    if len(said[origin]) != 1 or origin == "page-surname" and any(w not in ("Frau", "Herr", "Herrn") for w in before):
        return None
    (word,) = said[origin]
    return None if word == "Herr" and re.search(FEMININE.removeprefix("(?iu)"), role or "", re.IGNORECASE) else (word, origin)


@F.pandas_udf(T.StructType([T.StructField("word", T.StringType()), T.StructField("origin", T.StringType())]))
def stated_salutation(given: pd.Series, surname: pd.Series, text: pd.Series, role: pd.Series) -> pd.DataFrame:
    """written_salutation for the text of all of a company's pages. given and surname: of text.split_name."""
    found = [written_salutation(list(g if g is not None else ()), n, {"": t or ""}, r) or (None, None) for g, n, t, r in zip(given, surname, text, role, strict=True)]
    return pd.DataFrame(found, columns=["word", "origin"])
