"""Whom to write to, case by case."""

import datetime

from larkspur.operators import contact_choice


def day(k):
    return datetime.date(2026, 1, k)


def test_each_case(spark):
    site = lambda k: f"https://www.firma{k}.ch/"
    companies = [(k, site(k)) for k in range(1, 12)] + [(12, "https://firma12.jimdosite.com/"), (13, None)]
    people = [
        (1, 1, "Max Muster", "Monteur", "max@firma1.ch"), (1, 2, "Ida Chef", "Inhaberin", None), (1, 3, "Reto", "Inhaber", "reto@firma1.ch"), (1, 4, "Eva Boss", "Direktorin", "eva@firma1.ch"),
        (2, 1, "Max Muster", None, None), (3, 1, "Max Muster", None, None), (4, 1, "Max Muster", None, "max@gmx.ch"), (12, 1, "Max Muster", None, None), (5, 1, "Reto", "Inhaber", "reto@firma5.ch"),
    ]
    pages = [
        (1, 1, "u1", "Hallo"), (1, 2, "u2", "EVA@firma1.ch und Eva Boss, max@firma1.ch"), (2, 1, "u1", "post@firma2.ch, Max Muster"), (2, 2, "u2", "info@firma2.ch"), (3, 7, "u7", "Max Muster"), (4, 1, "u1", "max@gmx.ch Max Muster"),
        (6, 1, "u1", "info (at) firma6.com und a@b.ch"), (7, 1, "u1", "fremd@anders.ch zwei@anders.ch"), (8, 1, "u1", None), (10, 1, "u1", "kontakt@sub.firma10.ch " + " ".join(f"p{k}@firma10.ch" for k in range(12))),
    ]
    notices = [
        (5, 1, "Rita Register", "Präsidentin", day(3), False, "n1"), (5, 2, "Rita Register", "Präsidentin", day(2), False, "n0"), (5, 3, "Otto Weg", "Geschäftsführer", day(2), False, "n2"), (5, 4, "Otto Weg", None, day(4), True, "n3"),
        (5, 5, "Udo Leiter", "Geschäftsleiter", day(1), False, "n4"), (1, 1, "Nie Gefragt", None, day(1), False, "n5"), (10, 1, "Ann Amt", None, day(1), False, "n6"),
    ]
    leads = [(k, f"lead{k}") for k in (1, 3, 5, 8, 12)]
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    found = {
        r.uid: r
        for r in contact_choice.contact_choice(
            frame(companies, "uid long, site string"), frame(people, "uid long, pos long, name string, role string, email string"), frame(pages, "uid long, pos long, url string, text string"),
            frame(notices, "uid long, pos long, name string, role string, published date, departed boolean, url string"), frame(leads, "uid long, url string"),
        ).collect()
    }
    short = lambda k: (found[k].name, found[k].email, found[k].email_kind, found[k].source, found[k].source_url, found[k].lead)
    assert short(1) == ("Eva Boss", "eva@firma1.ch", "seen", "site", "u2", None) and found[1].alternatives == ["Max Muster, Monteur, max@firma1.ch", "Ida Chef, Inhaberin"]
    assert [tuple(a) for a in found[1].addresses] == [("eva@firma1.ch", "seen", None), ("max@firma1.ch", "seen", None)]
    assert short(2) == ("Max Muster", "post@firma2.ch", "generic", "site", "u1", None)
    assert short(3) == ("Max Muster", "info@firma3.ch", "constructed", "site", "u7", "lead3")
    assert short(4) == ("Max Muster", "max@gmx.ch", "third_party", "site", "u1", None)
    assert short(5) == ("Udo Leiter", "info@firma5.ch", "constructed", "shab", "n4", "lead5") and found[5].alternatives == ["Rita Register, Präsidentin"] and found[5].source_date == day(1)
    assert short(6) == (None, "info@firma6.com", "generic", "site", "u1", None) and found[6].addresses[0].note == "the site's name under another ending than firma6.ch" and found[6].addresses[1].kind == "third_party"
    assert short(7) == (None, "fremd@anders.ch", "third_party", "site", "u1", None) and len(found[7].addresses) == 2
    assert short(8) == (None, None, None, "site", None, "lead8")
    assert short(10)[:4] == ("Ann Amt", "kontakt@sub.firma10.ch", "generic", "shab") and len(found[10].addresses) == 8
    assert short(12) == ("Max Muster", None, None, "site", "https://firma12.jimdosite.com/", "lead12")
    assert set(found) == {1, 2, 3, 4, 5, 6, 7, 8, 10, 12}
