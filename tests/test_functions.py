import datetime

import pytest
from pyspark.sql import functions as F

from larkspur.functions import drafts, gazette, html, ids, text, urls


def one(spark, column, **values):
    names = list(values) or ["x"]
    kinds = ", ".join(f"{n} {'string' if not isinstance(values.get(n), list) else 'array<string>'}" for n in names)
    return spark.createDataFrame([tuple(values.get(n) for n in names)], kinds).select(column.alias("out")).first()["out"]


@pytest.mark.parametrize(("said", "valid"), [("CHE-109.322.551", True), ("CHE-109.322.552", False), ("CHE-109.322", False), ("", False), (None, False)])
def test_uid_check_digit(spark, said, valid):
    assert one(spark, ids.is_valid_uid(F.col("x")), x=said) is valid


def test_uids_in_text(spark):
    said = "CHE-109.322.551 MWST, che 109 322 551 und CHE-109.322.559"
    assert one(spark, ids.find_uids(F.col("x")), x=said) == ["CHE109322551"]
    assert one(spark, ids.dotted_uid(F.lit("CHE109322551"))) == "CHE-109.322.551"
    assert one(spark, ids.uid_match(F.lit("CHE109322551"), F.col("x")), x=said) == "match"
    assert one(spark, ids.uid_match(F.lit("CHE000000000"), F.col("x")), x=said) == "different"
    assert one(spark, ids.uid_match(F.lit("CHE000000000"), F.col("x")), x="nothing") == "absent"


def test_keys(spark):
    assert one(spark, text.address_key(F.col("x")), x=" Info@Müller.ch ") == "info@xn--mller-kva.ch"
    assert one(spark, ids.profile_key(F.col("x")), x="https://ch.LinkedIn.com/in/Anna-M/?trk=1") == "linkedin.com/in/anna-m"
    assert one(spark, ids.code_in(F.col("x")), x="https://s.example/?c=abc234") == "ABC234"
    assert one(spark, ids.code_in(F.col("x")), x="abc") is None
    assert one(spark, ids.parsed_key(F.col("x"))["kind"], x="anna@muster.ch") == "address"
    assert one(spark, ids.guessed_domains(F.col("x")), x="Müller Söhne") == ["muellersoehne.ch", "muellersoehne.com", "mueller-soehne.ch", "mueller-soehne.com"]


def test_mailto_encodes_as_rfc_3986(spark):
    link, fits = one(spark, ids.mailto(F.lit("a@b.ch"), F.lit("a*~ b"), F.lit("x\ny")))
    assert link == "mailto:a@b.ch?subject=a%2A~%20b&body=x%0D%0Ay" and fits


@pytest.mark.parametrize(("url", "domain"), [("https://WWW.de.Muster.ch/x", "muster.ch"), ("https://a.jimdosite.com", "a.jimdosite.com"), ("https://shop.a.co.uk/", "a.co.uk"), ("http://localhost/", "localhost"), ("no url", None)])
def test_registered_domain(spark, url, domain):
    assert one(spark, urls.registered_domain(F.col("x")), x=url) == domain


@pytest.mark.parametrize(("url", "kind"), [("https://m.ch/impressum", 0), ("https://m.ch/kontakt-anfahrt", 1), ("https://m.ch/shop/kontaktlinsen", None), ("https://m.ch/produkte/steamer-pro", None), ("https://m.ch/%C3%BCber-uns", 2), ("https://m.ch/", None)])
def test_page_kind(spark, url, kind):
    assert one(spark, urls.page_kind(F.col("x")), x=url) == kind


def test_inbox_needs_a_domain_of_its_own(spark):
    assert one(spark, urls.inbox_domain(F.col("x")), x="https://www.muster.ch/") == "muster.ch"
    assert one(spark, urls.inbox_domain(F.col("x")), x="https://de.muster.ch/") is None
    assert one(spark, urls.inbox_domain(F.col("x")), x="https://a.wordpress.com/") is None


def test_screen(spark):
    reason = text.screen_reason(F.col("n"), F.col("p"))
    assert one(spark, reason, n="Muster AG in Liquidation", p="") == "in liquidation"
    assert one(spark, reason, n="Muster AG", p="Halten von Immobilien") == "property only"
    assert one(spark, reason, n="Muster AG", p="Herstellung von Türen. Die Gesellschaft kann\nGrundstücke erwerben.") is None
    assert one(spark, text.head_clause(F.col("p")), p="Beratung. Sie kann\nalles.") == "Beratung."


@pytest.mark.parametrize(("email", "noise"), [("a@sentry.io", True), ("logo@2x.png", True), ("0123456789abcdef0123456789abcdef@x.ch", True), ("info@muster.ch", False)])
def test_noise(spark, email, noise):
    assert one(spark, text.is_noise(F.col("x")), x=email) is noise


def test_addresses_are_read_through_disguises(spark):
    assert one(spark, text.page_addresses(F.col("x")), x="Anna (at) muster [dot] ch, ANNA@muster.ch, a@example.com") == ["anna@muster.ch"]


def test_normalised_folds(spark):
    assert one(spark, text.normalised(F.col("x")), x=" Straße  ﬁN ") == "strasse fin"
    assert one(spark, text.normalised(F.col("x")), x=None) is None


@pytest.mark.parametrize(
    ("full", "parts"),
    [("Prof. Dr. Urs Probe", ("Prof.", ["Urs"], "Probe")), ("Anna von Arx", ("", ["Anna"], "von Arx")), ("Hans Peter Muster", ("", ["Hans", "Peter", "Muster"], None)), ("Anna Maria Probe-Keller", ("", ["Anna", "Maria"], "Probe-Keller")), ("Reto Muster, dipl. Ing. FH", ("", ["Reto"], "Muster")), ("Reto", ("", ["Reto"], None)), ("", ("", [], None))],
)
def test_split_name(spark, full, parts):
    assert tuple(one(spark, text.split_name(F.col("x")), x=full)) == parts


def test_salutation(spark):
    s = lambda **v: tuple(one(spark, text.salutation(*(F.col(k) for k in ("chosen", "origin", "role", "source"))), **{"chosen": None, "origin": None, "role": None, "source": None} | v))
    assert s(role="Geschäftsführerin", source="site") == ("Frau", "role")
    assert s(role="Direktor", source="shab") == ("Herr", "shab")
    assert s(role="Direktor", source="site") == (None, None)
    assert s(chosen="ohne") == (None, "reviewer")


def test_person_names(spark):
    p = lambda n, c, short=False: one(spark, text.names_a_person(F.col("n"), F.col("c"), F.lit(short)), n=n, c=c)
    assert p("anna muster", "muster ag") and not p("kontakt", "muster ag") and not p("muster holding ag", "x") and not p("hans muster", "hans muster gmbh", True) and p("hans muster", "hans muster gmbh")


def test_quotes_and_cuts(spark):
    assert one(spark, text.quote_found(F.col("q"), F.col("t")), q="one ... three", t="one two three")
    assert not one(spark, text.quote_found(F.col("q"), F.col("t")), q="...", t="one")
    assert one(spark, text.truncated(F.col("x"), 8), x="one two three") == "one two"
    assert one(spark, text.german_date(F.lit(datetime.date(2026, 3, 7)))) == "7. März 2026"


def test_sentence_rules(spark):
    rules = lambda x: one(spark, drafts.sentence_problems(F.col("x")), x=x)
    assert rules("Ich schreibe Ihnen, weil Ihre Werkstatt in St. Gallen Halbleiter prüft.") == []
    assert rules("Hallo") == ["prefix", "full_stop"]
    assert rules("Ich schreibe Ihnen, weil Sie als Firmengründerin tätig sind.") == ["role_noun"]
    assert rules("Ich schreibe Ihnen, weil a@b.ch und shop.ch 2024 besonders gut sind.") == ["banned_word", "year", "email", "link"]


PAGE = """<html><head><title>T</title><script>var x = "no";</script><script type="application/ld+json">{"@graph": [{"@type": "Organization", "legalName": "Muster AG", "taxID": "CHE-1", "address": {"postalCode": "3000"}}]}</script></head>
<body><nav><a href="/impressum">Recht</a><a href="https://else.ch/impressum">x</a><a href="/team">Wir</a></nav><p>Hallo <b>Welt</b></p><a href="mailto:anna%40muster.ch?subject=x">Mail</a><span data-cfemail="422b2c242d022f3731362730612c6a"></span><footer>Musterweg 1</footer></body></html>"""


def test_pages():
    said = html.page_text(PAGE)
    assert "Hallo Welt" in said and "Musterweg 1" in said and "anna@muster.ch" in said and "var x" not in said
    assert html.ranked_links(PAGE, "https://www.muster.ch/") == (["https://www.muster.ch/impressum"], [], ["https://www.muster.ch/team"])
    assert html.organisations(PAGE) == "Name: Muster AG | Address: 3000 | UID: CHE-1"
    assert html.unveiled("42" + bytes(b ^ 0x42 for b in b"a@b.ch").hex()) == "a@b.ch" and html.unveiled("xy") == ""


def test_page_columns_take_nulls(spark):
    rows = spark.createDataFrame([(None, None), (PAGE, "https://muster.ch/")], "h string, b string").select(html.textify("h").alias("t"), html.find_links("h", "b").alias("l"))
    assert [r.t is None for r in rows.collect()].count(True) == 1
    assert one(spark, html.decoded(F.encode(F.lit("é"), "ISO-8859-1"), F.lit("latin-1"))) == "é"


def test_links_in_sentences(spark):
    link = lambda x: one(spark, drafts.has_link(F.col("x")), x=x)
    assert all(map(link, ["siehe https://a", "www.x", "bei Muster.CH gibt es", "auf shop.muster.berlin/x", "(muster.ch)", "hxxps überall", "muster [.] ch", "muster punkt ch", "muster.ch-seite"]))
    assert not any(map(link, ["z.B. in St. Gallen", "Seit 1.5 Jahren", "Ein Satz. Noch einer", "Grüsse.Ihr", "punkt genau", "9.A"]))


def test_notices(spark):
    said = "Eingetragene Personen neu oder mutierend: Muster, Anna, von Bern, in Thun, Direktorin, mit Einzelunterschrift [bisher: ohne]; Treu AG (CHE-100.000.001), Revisionsstelle. Ausgeschiedene Personen und erloschene Unterschriften: Probe Urs, Mitglied."
    people = lambda x: [tuple(p) for p in one(spark, gazette.parse_persons(F.col("x")), x=x)]
    assert people(said) == [("Anna Muster", "Direktorin", False), ("Probe Urs", "Mitglied", True)]
    assert people("Signature individuelle est conférée à X.") == [] and one(spark, gazette.parse_persons(F.col("x")), x=None) is None
    assert people("Personnes radiées: Exemple, Léa, citoyenne de Berne, présidente. Neu eingetragene Person: Muster (früher Probe), Urs; Beispiel Jo, wohnhaft in Bern.") == [("Léa Exemple", "présidente", True), ("Beispiel Jo", "wohnhaft in Bern", False)]


def test_sitemaps(spark):
    xml = "<urlset><url><loc> https://m.ch/?a=1&amp;b=2 </loc></url><url><loc>https://m.ch/x</loc></url></urlset>"
    assert one(spark, urls.sitemap_locations(F.col("x")), x=xml) == ["https://m.ch/?a=1&b=2", "https://m.ch/x"]


def test_mail(spark):
    from larkspur.functions import mail

    frame = mail.Frame("Mia Beispiel", "HS", "HS Beispielstadt", "wie Firmen wachsen", 8, closes=F.lit(datetime.date(2026, 10, 30)))
    contacts = [("Dr. Urs Probe", "Herr", "generic", "shab"), (None, None, "generic", "site"), ("Anna Muster", None, "seen", "site"), (None, None, "constructed", "site")]
    df = spark.createDataFrame(contacts, "full string, word string, kind string, source string").withColumn("name", text.split_name("full"))
    c = F.col
    out = df.select(
        mail.body(c("name"), c("word"), c("kind"), c("source"), F.lit(" Gruß. "), F.lit("https://s.ch/?c=CHE1"), F.lit(False), frame).alias("body"), mail.subject(c("name"), c("word"), c("kind"), frame).alias("subject"), mail.privacy(c("name"), c("kind"), c("source"), frame).alias("privacy")
    ).collect()
    assert out[0].body.startswith("Zuhanden Herrn Dr. Probe oder der Geschäftsleitung – besten Dank fürs Weiterleiten\n\nGuten Tag Herr Dr. Probe\n\n")
    assert "(ohne Anmeldung, offen bis Freitag, 30. Oktober):" in out[0].body and "wachsen. Gruss.\n\n" in out[0].body and out[0].subject == "Für Herrn Dr. Probe: Masterarbeit an der HS"
    assert out[1].body.startswith("Zuhanden der Geschäftsleitung –") and "\n\nGuten Tag\n\n" in out[1].body and out[2].body.startswith("Guten Tag Anna Muster") and out[3].privacy is None
    assert one(spark, mail.as_html(F.col("x")), x="a & b\n\nhttps://s.ch/?c=1\nz") == '<p>a &amp; b</p><p><a href="https://s.ch/?c=1">https://s.ch/?c=1</a><br>z</p>'
    assert mail.written_salutation(["Anna"], "Muster", {"u": "Fragen an Frau Anna Muster."}, None) == ("Frau", "page")
    assert mail.written_salutation(["Anna"], "Muster", {"u": "1978 gründete Herr Muster die Firma. Heute führt Anna Muster sie."}, None) is None
    assert mail.written_salutation(["Urs"], "Probe", {"u": "Herr Probe hilft."}, "Inhaberin") is None
