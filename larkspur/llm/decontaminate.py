"""Benchmark decontamination by template windows, all in DataFrame operations.

Numbers, the units after them and names become typed placeholders; what is left, in lower case and without
punctuation, is a text's template. Windows of template words are met by hash. Where an alignment of a text with an
item has matching windows, the words are compared and the placeholders' values must correspond one to one, so a question
asked again with other numbers is found and a chance likeness of templates isn't.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged

#: Private-use characters begin a number and a unit, stand for a name, and end a value.
NUMBER, UNIT, NAME, END = "\ue000", "\ue001", "\ue002", "\ue003"
UNITS = "km|cm|mm|m|kg|mg|g|lb|oz|l|ml|h|min|s|ms|mph|kmh|hours|hour|minutes|minute|seconds|second|days|day|weeks|week|months|month|years|year|meters|metres|miles|mile|feet|foot|inches|inch|litres|liters|dollars|euros|percent|degrees|usd|eur|°c|°f|%|€|\\$|£"
_NUMBER = rf"(?<![\p{{L}}\p{{N}}])([+-]?\p{{N}}+(?:[.,:/]\p{{N}}+)*)(?:\s?((?iu:{UNITS}))(?![\p{{L}}\p{{N}}]))?"
_TOKEN = rf"[{NUMBER}{UNIT}][^{END}]+|[\p{{L}}\p{{M}}\p{{N}}]+"
#: Kinds of templates: with names as placeholders, with names as words, and with values of all kinds as they are.
NAMED, PLAIN, LITERAL = range(3)
#: More windows than this aren't broadcast but met in a shuffled join.
BROADCAST_WINDOWS = 1_000_000
_ALL = 1 << 30


def tokens() -> Column:
    """The words of text, as they stand; numbers and units begin with their private-use character. Such characters of the text itself are blanks."""
    text = F.regexp_replace(F.coalesce("text", F.lit("")), f"[{NUMBER}-{END}]", " ")
    marked = F.when(text.rlike(r"\p{N}"), F.regexp_replace(text, _NUMBER, f"{NUMBER}$1{END}{UNIT}$2{END}")).otherwise(text)
    return F.regexp_extract_all(marked, F.lit(_TOKEN), F.lit(0))


def _is_value(token: Column) -> Column:
    return (token >= NUMBER) & (token < NAME)


def _is_name(token: Column) -> Column:
    """A word with a capital letter, wherever it stands."""
    return ~_is_value(token) & (token != F.lower(token))


def template(token: Column, kind: int) -> Column:
    """What stands for a token in templates of a kind."""
    if kind == LITERAL:
        return F.lower(token)
    value = F.when(_is_value(token), F.substring(token, 1, 1))
    return (value.when(token != F.lower(token), F.lit(NAME)) if kind == NAMED else value).otherwise(F.lower(token))


def windows(table: DataFrame, kinds: list[int], sizes: list[int]) -> DataFrame:
    """The columns of table but tokens, with place (from 0) and hash of each window of sizes tokens, for templates of kinds; size and kind tell which.

    The hash of a window is that of the hashes of its parts of 1, 2, 4, ... tokens.
    """
    columns = [c for c in table.columns if c != "tokens"]
    hashes = lambda kind: F.transform("tokens", lambda t: F.xxhash64(template(t, kind), F.lit(kind)))
    joined = lambda a, b, shift: F.zip_with(a, F.slice(b, shift + 1, _ALL), lambda x, y: F.xxhash64(x, y))
    made = table.select(*columns, F.size("tokens").alias("_n"), *(hashes(k).alias(f"_{k}_1") for k in kinds))
    part = 1
    while 2 * part <= max(sizes):
        made = made.withColumns({f"_{k}_{2 * part}": joined(f"_{k}_{part}", f"_{k}_{part}", part) for k in kinds})
        part *= 2
    out = []
    for k in kinds:
        for size in sizes:
            parts = [1 << b for b in reversed(range(size.bit_length())) if size >> b & 1]
            whole = F.col(f"_{k}_{parts[0]}")
            for i, p in enumerate(parts[1:], 1):
                whole = joined(whole, F.col(f"_{k}_{p}"), sum(parts[:i]))
            out.append(F.struct(F.lit(k).alias("kind"), F.lit(size).alias("size"), F.slice(whole, 1, F.greatest(F.col("_n") - (size - 1), F.lit(0))).alias("hashes")))
    each = made.select(*columns, F.explode(F.array(*out)).alias("_x"))
    return each.select(*columns, F.col("_x.kind").alias("kind"), F.col("_x.size").alias("size"), F.posexplode("_x.hashes").alias("place", "hash"))


def item_windows(items: DataFrame, size: int) -> DataFrame:
    """item_id, item, size, n_item_windows, kind, item_place and hash of the windows by which items (item_id, item, tokens, size) are met.

    At least half of a window's words, and three of them, must be neither values nor, in templates with them, names; a window with
    fewer is met as it stands.
    """
    sizes = sorted(r[0] for r in items.select("size").distinct().collect()) or [size]
    placed = items.withColumn("n_item_windows", F.size("tokens") - F.col("size") + 1)
    every = reduce(DataFrame.unionByName, (windows(placed.where(F.col("size") == k).drop("size"), [NAMED, PLAIN, LITERAL], [k]) for k in sizes))
    flags = placed.select("item_id", "item", F.transform("tokens", lambda t: _is_value(t)).alias("values"), F.transform("tokens", lambda t: _is_value(t) | _is_name(t)).alias("slots"))
    within = lambda flags: F.size(F.filter(F.slice(flags, F.col("place") + 1, F.col("size")), lambda x: ~x)) >= least_words(F.col("size"))
    fine = F.when(F.col("kind") == NAMED, within(F.col("slots"))).when(F.col("kind") == PLAIN, within(F.col("values"))).otherwise(~within(F.col("values")))
    return every.join(flags, ["item_id", "item"]).where(fine).select("item_id", "item", "size", "n_item_windows", "kind", F.col("place").alias("item_place"), "hash")


def least_words(size: Column) -> Column:
    """How many words of a window of size must be neither values nor names for it to be a template."""
    return F.least(size, F.greatest(F.lit(3), F.ceil(size / 2))).cast("int")


def enough(n: str, share: float, run: int) -> Column:
    return F.col(n) >= F.least(share * F.col("n_item_windows"), F.lit(run))


def sound_windows(pairs: DataFrame) -> DataFrame:
    """pairs with n_windows (windows of the item that fit, with their values one to one) and changed (whether some value differs).

    pairs: item_tokens, doc_tokens (the text's tokens beside those of the item, null where it has none) and size.
    """
    slot = lambda t: F.when(_is_value(t), F.substring(t, 1, 1)).when(_is_name(t), F.lit(NAME))
    beside = F.zip_with("item_tokens", "doc_tokens", lambda a, b: F.struct(slot(a).alias("slot"), F.lower(a).alias("a"), F.lower(b).alias("b"), (slot(a) == slot(b)).alias("alike"), F.coalesce(F.lower(a) == F.lower(b), F.lit(False)).alias("same")))
    made = pairs.withColumn("_at", beside)
    met = F.filter("_at", lambda x: x["slot"].isNotNull() & (F.coalesce(x["alike"], F.lit(False)) | x["same"]))
    made = made.withColumn("_a", F.array_sort(F.array_distinct(F.transform(met, lambda x: F.struct(x["a"].alias("k"), x["b"].alias("v"))))))
    made = made.withColumn("_b", F.array_sort(F.transform("_a", lambda x: F.struct(x["v"].alias("k"), x["k"].alias("v")))))
    torn = lambda c: F.array_distinct(F.filter(F.zip_with(c, F.slice(c, 2, _ALL), lambda x, y: F.when(x["k"] == y["k"], x["k"])), lambda x: x.isNotNull()))
    made = made.withColumn("_odd", F.struct(torn("_a").alias("a"), torn("_b").alias("b")))  # one column used twice, so that it isn't worked out anew in each place
    odd = lambda x: x["slot"].isNotNull() & (F.array_contains("_odd.a", x["a"]) | F.array_contains("_odd.b", F.coalesce(x["b"], F.lit(""))))
    # a letter for each place: W the same word, V the same value, P another value, X neither or at odds
    letter = lambda x: F.when(odd(x), "X").when(x["same"] & F.coalesce(x["slot"].isin(NUMBER, UNIT), F.lit(False)), "V").when(x["same"], "W").when(F.coalesce(x["alike"], F.lit(False)), "P").otherwise("X")
    made = made.withColumn("_fit", F.array_join(F.transform("_at", letter), ""))
    part = lambda i: F.substr("_fit", i, F.col("size"))
    holds = lambda i: ~part(i).contains("X") & (~part(i).contains("P") | (F.length(F.translate(part(i), "VP", "")) >= least_words(F.col("size"))))
    places = F.sequence(F.lit(1), F.size("item_tokens") - F.col("size") + 1)
    made = made.withColumn("n_windows", F.size(F.filter(places, holds)).cast("long"))
    changed = F.exists("_at", lambda x: F.coalesce(x["alike"], F.lit(False)) & ~x["same"])
    return made.withColumn("changed", changed).drop("_at", "_a", "_b", "_odd", "_fit")


def contaminated(docs: DataFrame, items: DataFrame, size: int = 8, share: float = 0.5, run: int = 6, versions: bool = False) -> DataFrame:
    """Documents that hold benchmark items: doc_id, item_id, n_windows, n_item_windows and reparameterised, a row for each pair.

    docs: doc_id, text; items: item_id, text; other columns are left out. A pair is told if in one alignment at least share of
    the item's windows of size template words, or run of them (as 13 words in a row have), fit with values that correspond one
    to one. An item of fewer words is one window; an item without words is none. reparameterised: some value differs in
    every such alignment. Null texts count as empty and rows without an id are left out. Rows that repeat, in either table, count
    once; of texts that share an id, each is held against each item by itself, and the pair is told once, or, with versions, once for each text, whose xxhash64 is version. Empty tables give no rows.
    Windows are met with names as placeholders and with names as words in lower case, so that copies in another case are found,
    and those that have few words besides values as they stand. A window with one name in another case and
    another name exchanged is met by neither.
    """
    docs = docs.where("doc_id is not null").select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("version"))
    items = items.where("item_id is not null").select("item_id", tokens().alias("tokens")).distinct().where(F.size("tokens") > 0)
    known = staged(items.withColumn("item", F.xxhash64("tokens")).withColumn("size", F.least(F.lit(size), F.size("tokens"))), "item_tokens")
    wanted = staged(item_windows(known, size), "item_windows")
    n, combined = wanted.count(), sorted(map(tuple, wanted.select("kind", "size").distinct().collect()))
    kinds, sizes = sorted({k for k, _ in combined} & {NAMED, PLAIN}) or [PLAIN], sorted({s for _, s in combined}) or [size]
    broadcast = F.broadcast if n <= BROADCAST_WINDOWS else lambda df: df
    made = docs.select("doc_id", "version", tokens().alias("tokens"))
    each = windows(made, kinds, sizes)
    literal = sorted({s for k, s in combined if k == LITERAL})
    if literal:
        each = each.unionByName(windows(made, [LITERAL], literal))
    side = broadcast(wanted.select("item_id", "item", "n_item_windows", "item_place", "hash"))
    met = each.select("doc_id", "version", "place", "hash").join(side, "hash")
    pair = ["doc_id", "version", "item_id", "item", "shift"]
    met = met.select(*pair[:4], (F.col("place") - F.col("item_place")).alias("shift"), "n_item_windows", "item_place").distinct()
    likely = staged(met.groupBy(*pair, "n_item_windows").agg(F.count("*").alias("n")).where(enough("n", share, run)).drop("n"), "likely")
    texts = docs.join(likely.select("doc_id", "version").distinct(), ["doc_id", "version"], "left_semi").dropDuplicates(["doc_id", "version"]).select("doc_id", "version", tokens().alias("doc_tokens"))
    both = likely.join(texts, ["doc_id", "version"]).join(known.select("item_id", "item", "size", F.col("tokens").alias("item_tokens")), ["item_id", "item"])
    beside = F.transform("item_tokens", lambda t, i: F.get("doc_tokens", i + F.col("shift")))
    told = sound_windows(both.withColumn("doc_tokens", beside))
    fits = enough("n_windows", share, run)  # asked of sums, not as a filter, which Spark would work out anew below the join
    best = F.max(F.when(fits, F.struct("n_windows", F.col("n_item_windows").cast("long").alias("n_item_windows")))).alias("best")
    keys = ["doc_id", *["version"] * versions, "item_id"]
    found = told.groupBy(*keys).agg(best, F.min(F.when(fits, F.col("changed"))).alias("reparameterised"))
    return found.where("best is not null").select(*keys, "best.*", "reparameterised")
