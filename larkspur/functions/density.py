"""The main text of pages by how dense the text and the links of their blocks are, in column expressions.

A page is cut at the tags that begin or end a block. A block's words, the share of them that are links, and the same of the blocks beside it tell
whether it belongs to the main text; where too few words do, all of the page is taken.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elements that are no text, and elements that begin a block.
UNSEEN = ("script", "style", "noscript", "template", "head")
BLOCK = (
    "address", "article", "aside", "blockquote", "body", "br", "button", "dd", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6",
    "header", "hr", "html", "li", "main", "nav", "ol", "option", "p", "pre", "section", "select", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
)
ENTITIES = (("nbsp", " "), ("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'"), ("#39", "'"), ("copy", "©"), ("middot", "·"), ("amp", "&"))
#: The published decision tree of text and link density, and the words under which a main text is too thin.
LINKS, LINKS_BEFORE, FEW, FEW_BEFORE, FEW_AFTER, LONG, FEW_AFTER_LINKS, THIN = 0.333333, 0.555556, 16, 4, 15, 40, 17, 80
UNSEEN_PATTERN = "(?is)" + "|".join(rf"<{t}\b.*?</{t}\s*>" for t in UNSEEN) + "|<!--.*?-->"
BLOCK_PATTERN = rf"(?i)</?(?:{'|'.join(BLOCK)})(?:\s[^>]*)?/?>"
LINK_PATTERN = r"(?is)<a\b[^>]*>(.*?)</a\s*>"
TAG_PATTERN = "<[^>]*>"


def plain(x: Column) -> Column:
    """Text without tags, with common entities resolved, and with one blank for each run of white space."""
    x = F.regexp_replace(x, TAG_PATTERN, "")
    for name, char in ENTITIES:
        x = F.replace(x, F.lit(f"&{name};"), F.lit(char))
    return F.trim(F.regexp_replace(x, r"[\s\u00A0]+", " "))


def _n_words(x: Column) -> Column:
    return F.when(x == "", 0).otherwise(F.size(F.split(x, " ")))


def blocks(html: Column) -> Column:
    """text, n (words) and links (words in links) of each block with text, in order. A link's text counts in the block where it both begins and ends."""
    parts = F.split(F.regexp_replace(html, UNSEEN_PATTERN, " "), BLOCK_PATTERN, -1)
    linked = lambda x: F.array_join(F.transform(F.regexp_extract_all(x, F.lit(LINK_PATTERN), F.lit(1)), plain), " ")
    said = F.filter(F.transform(parts, lambda x: F.struct(plain(x).alias("text"), F.trim(linked(x)).alias("linked"))), lambda b: b["text"] != "")
    return F.transform(said, lambda b: F.struct(b["text"].alias("text"), _n_words(b["text"]).alias("n"), _n_words(b["linked"]).alias("links")))


def judged(found: Column) -> Column:
    """text, n and whether it is main text, of blocks."""
    none = F.struct(F.lit("").alias("text"), F.lit(0).alias("n"), F.lit(0).alias("links"))
    dense = lambda b: F.coalesce(F.try_divide(b["links"], b["n"]), F.lit(0.0))

    def one(b: Column, i: Column) -> Column:
        before, after = (F.coalesce(F.get(found, i + k), none) for k in (-1, 1))
        beside = F.when(b["n"] > FEW, True).when(after["n"] > FEW_AFTER, True).otherwise(before["n"] > FEW_BEFORE)
        main = F.when(dense(b) > LINKS, False).when(dense(before) <= LINKS_BEFORE, beside).otherwise((b["n"] > LONG) | (after["n"] > FEW_AFTER_LINKS))
        return F.struct(b["text"].alias("text"), b["n"].alias("n"), main.alias("main"))

    return F.transform(found, one)


def with_main_text(rows, html: str = "html", name: str = "main_text"):
    """rows with the main text of html: its main blocks, a line each, or all blocks where those have fewer than THIN words and all have more. Null stays null."""
    kept = lambda x: F.filter("_judged", lambda b: b["main"] | F.lit(x))
    count = lambda x: F.aggregate(x, F.lit(0), lambda n, b: n + b["n"])
    rows = rows.withColumn("_blocks", blocks(F.col(html))).withColumn("_judged", judged(F.col("_blocks")))
    chosen = F.when((count(kept(False)) < THIN) & (count(kept(True)) > count(kept(False))), kept(True)).otherwise(kept(False))
    return rows.withColumn(name, F.array_join(F.transform(chosen, lambda b: b["text"]), "\n")).drop("_blocks", "_judged")
