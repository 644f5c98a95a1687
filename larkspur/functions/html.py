"""What pages say: text, footers, addresses that scripts hide, links and organisation blocks. Arrow-batched, by the standard parser."""

from __future__ import annotations

import json
import re
from html.parser import HTMLParser
from urllib.parse import unquote, urljoin, urlsplit

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .urls import ABOUT, CONTACT, IMPRESSUM

#: Elements whose content isn't text, words that name a footer, and lengths.
SILENT = ("script", "style", "noscript", "template")
FOOTER_WORDS = ("footer", "impressum")
FOOTER_CHARS, THIN_WORDS = 3000, 80
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")
BLOCKS = ("p", "div", "li", "br", "tr", "td", "th", "h1", "h2", "h3", "h4", "h5", "h6", "section", "article", "header", "footer", "nav", "ul", "ol", "table", "address", "main", "aside", "title")
ORGANISATIONS = ("Organization", "Corporation", "LocalBusiness")
_KINDS = tuple(re.compile(x, re.IGNORECASE) for x in (IMPRESSUM, CONTACT, "datenschutz|legal|rechtlich"))
_ABOUT = re.compile(ABOUT, re.IGNORECASE)


def unveiled(code: str) -> str:
    """An address that is hidden as hex digits, of which the first byte is combined with each of the others by exclusive-or."""
    try:
        key, *rest = bytes.fromhex(code)
    except ValueError:
        return ""
    return bytes(b ^ key for b in rest).decode("utf-8", "replace")


class Reader(HTMLParser):
    """Text of a page by parts: all of it, that of main or article, and that of footers; and its links with their words."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, bool, bool]] = []
        self.all: list[str] = []
        self.main: list[str] = []
        self.footers: list[list[str]] = []
        self.links: list[tuple[str, list[str]]] = []
        self.blocks: list[str] = []
        self.mail: list[str] = []
        self.json = False

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        named = {k: v or "" for k, v in attrs}
        if hidden := unveiled(named.get("data-cfemail", "")):
            self.mail.append(hidden)
            self._say(f" {hidden} ")
        if tag == "a" and named.get("href"):
            self.links.append((named["href"].strip(), []))
            if named["href"].lower().startswith("mailto:"):
                self.mail.append(unquote(named["href"][7:].split("?")[0]))
        if tag in BLOCKS:
            self._say("\n")
        if tag in VOID:
            return
        words = {w for k in ("id", "class") for w in re.split(r"[\s_-]+", named.get(k, "").lower())}
        foot = tag in ("footer", "address") or bool(words.intersection(FOOTER_WORDS))
        if foot and not any(f for _, f, _ in self.open):
            self.footers.append([])
        self.json = tag == "script" and named.get("type", "").lower() == "application/ld+json"
        if self.json:
            self.blocks.append("")
        self.open.append((tag, foot, tag in ("main", "article")))

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS:
            self._say("\n")
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == tag:
                del self.open[k:]
                break
        self.json = False

    def handle_data(self, data: str) -> None:
        if self.json:
            self.blocks[-1] += data
        elif not any(t in SILENT for t, _, _ in self.open):
            self._say(data)

    def _say(self, data: str) -> None:
        self.all.append(data)
        if any(m for _, _, m in self.open):
            self.main.append(data)
        if any(f for _, f, _ in self.open):
            self.footers[-1].append(data)
        if self.links and any(t == "a" for t, _, _ in self.open):
            self.links[-1][1].append(data)


def _lines(parts: list[str]) -> str:
    return "\n".join(line for x in "".join(parts).split("\n") if (line := " ".join(x.split())))


def read(html: str) -> Reader:
    reader = Reader()
    reader.feed(html)
    reader.close()
    return reader


def page_text(html: str) -> str:
    """The main part of a page, or all of it where that is thin, after footers and addresses that it lacks."""
    return _text_of(read(html))


def _text_of(page: Reader) -> str:
    main = _lines(page.main)
    body = main if len(main.split()) >= THIN_WORDS else _lines(page.all)
    extra = [f for x in page.footers if (f := _lines(x)) and len(f) <= FOOTER_CHARS and f not in body]
    extra += [m for m in dict.fromkeys(page.mail) if m and m not in body and not any(m in x for x in extra)]
    return "\n".join([*extra, body]).strip()


def ranked_links(html: str, base: str) -> tuple[list[str], list[str], list[str]]:
    """Imprint links, other legal ones (contact first), and about links of the same site: at most three of each."""
    return _links_of(read(html), base)


def _links_of(page: Reader, base: str) -> tuple[list[str], list[str], list[str]]:
    site = lambda u: (urlsplit(u).hostname or "").removeprefix("www.")
    found: dict[str, int] = {}
    for href, said in page.links:
        url = urljoin(base, href)
        if urlsplit(url).scheme in ("http", "https") and "#" not in href and site(url) == site(base) and url not in found:
            label = f"{href} {' '.join(said)}"
            found[url] = next((k for k, x in enumerate(_KINDS) if x.search(label)), 3 if _ABOUT.search(label) else 4)
    of = lambda *kinds: [u for k in kinds for u, kind in found.items() if kind == k][:3]
    return of(0), of(1, 2), of(3)


def organisations(html: str) -> str:
    """A line for each organisation that a page declares: name, address and tax number, as far as it has them."""
    return _organisations_of(read(html))


def _organisations_of(page: Reader) -> str:
    out = []
    for block in page.blocks:
        try:
            top = json.loads(block)
        except ValueError:
            continue
        items = [x for item in (top if isinstance(top, list) else [top]) if isinstance(item, dict) for x in (item["@graph"] if isinstance(item.get("@graph"), list) else [item])]
        for item in (x for x in items if isinstance(x, dict)):
            kinds = item.get("@type") or []
            if not set([kinds] if isinstance(kinds, str) else kinds).intersection(ORGANISATIONS):
                continue
            place = item.get("address") or ""
            if isinstance(place, dict):
                place = " ".join(str(place[k]) for k in ("streetAddress", "postalCode", "addressLocality") if place.get(k))
            said = {"Name": item.get("legalName") or item.get("name"), "Address": place, "UID": item.get("taxID") or item.get("vatID")}
            if any(said.values()):
                out.append(" | ".join(f"{k}: {v}" for k, v in said.items() if v))
    return "\n".join(out)


@F.pandas_udf(T.StringType())
def textify(html: pd.Series) -> pd.Series:
    return html.map(page_text, na_action="ignore")


@F.pandas_udf(T.StringType())
def schema_org(html: pd.Series) -> pd.Series:
    return html.map(organisations, na_action="ignore")


_LISTS = [T.StructField(k, T.ArrayType(T.StringType())) for k in ("imprint", "legal", "about")]


@F.pandas_udf(T.StructType(_LISTS))
def find_links(html: pd.Series, base: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([ranked_links(h or "", b or "") for h, b in zip(html, base, strict=True)], columns=["imprint", "legal", "about"])


@F.pandas_udf(T.StructType([T.StructField("said", T.StringType()), *_LISTS, T.StructField("organisation", T.StringType())]))
def page_parts(html: pd.Series, base: pd.Series) -> pd.DataFrame:
    """What textify, find_links and schema_org say of a page, which is parsed once."""

    def one(h: str | None, b: str | None) -> tuple:
        page = read(h or "")
        return (None if h is None else _text_of(page), *_links_of(page, b or ""), None if h is None else _organisations_of(page))

    return pd.DataFrame([one(h, b) for h, b in zip(html, base, strict=True)], columns=["said", "imprint", "legal", "about", "organisation"])


@F.pandas_udf(T.StringType())
def decoded(content: pd.Series, charset: pd.Series) -> pd.Series:
    """Bytes as text: UTF-8 if they are that, else by the header's or the page's own charset, else Windows-1252."""

    def one(raw: bytes, said: str | None) -> str:
        own = re.search(rb"<meta[^>]+charset=[\"']?([A-Za-z0-9_-]+)", raw[:4096], re.IGNORECASE)
        for name in ("utf-8", said, own and own[1].decode("ascii"), "cp1252"):
            try:
                if name:
                    return raw.decode(name)
            except (LookupError, UnicodeDecodeError):
                pass
        return raw.decode("cp1252", "replace")

    return pd.Series([None if raw is None else one(raw, said) for raw, said in zip(content, charset, strict=True)])
