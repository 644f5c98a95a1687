"""Exact removal of repeated byte strings, by suffixes sorted with hash comparisons.

A string of ``length`` bytes is found by its anchor: of the hashes of its ``GRAM``-byte parts the least, the first such. Equal strings have equal
anchors at equal places, so strings whose anchors have hashes of their own can't repeat; what is left meets, anchor
by anchor, with the bytes around it. There the suffixes that begin at the anchors, and those that run backwards from
them, are sorted by mergesort; two suffixes are compared by binary search for their common extension over prefix
hashes, and neighbours in the sorted order are compared byte by byte, so a collision of hashes can't
stay unnoticed. Runs of neighbours with extensions of b bytes backwards and length - b forwards hold equal strings; all but the
earliest are removed. Anchors that more runs share than a task should hold are met string by string,
each by its bytes, with the earliest place of each found before shuffling.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from os.path import commonprefix

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_staged, staged

GRAM = 20
BASE, MASK = np.uint64(0x9E3779B97F4A7C15 | 1), (1 << 64) - 1
#: Texts that are hashed together have about so many bytes, or are one text.
CHUNK = 4 << 20
#: An anchor found more often than this is met string by string.
HOT = 20_000
ANCHORS = "doc_id long, anchor long, low int, size int, offset int"
#: kind 0: a run of strings, with its bytes; 1: a run that an earlier one in the same batch equals; 2: a string of a hot anchor, with its bytes.
MEMBERS = "kind int, anchor long, doc_id long, begin int, size int, offset int, bytes binary"
_MEMBER_TYPES = (pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
SPANS = "doc_id long, begin int, end int"


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE to the power of 0 .. n and of its negatives, modulo 2 to the 64."""
    up, down = np.ones(n + 1, np.uint64), np.ones(n + 1, np.uint64)
    up[1:], down[1:] = BASE, np.uint64(pow(int(BASE), -1, 1 << 64))
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def gram_hashes(data: np.ndarray, size: int, down: np.ndarray) -> np.ndarray:
    """The mixed hash of each size bytes of data, from prefix polynomial hashes."""
    up, _ = powers(len(data))
    prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_spread(data) * up[:-1], dtype=np.uint64)])
    key = (prefix[size:] - prefix[:-size]) * down[: len(data) - size + 1]
    key ^= key >> np.uint64(29)
    key *= np.uint64(0xBF58476D1CE4E5B9)
    return key ^ key >> np.uint64(32)


_TABLE = np.array([int.from_bytes(hashlib.sha256(bytes([b])).digest()[:8], "little") | 1 for b in range(256)], np.uint64)


def _spread(data: np.ndarray) -> np.ndarray:
    """A 64-bit number for each byte, as polynomials modulo 2 to the 64 of small numbers collide easily."""
    return _TABLE[data]


def first_least(keys: np.ndarray, width: int) -> np.ndarray:
    """The place of the least, the first such, of each width neighbouring keys (n - width + 1 places)."""
    n = len(keys)
    out, span = np.arange(n), 1
    while span * 2 <= width:
        a, b = out[: len(out) - span], out[span:]
        out = np.where(keys[b] < keys[a], b, a)
        span *= 2
    if span < width:
        shift = width - span
        a, b = out[: len(out) - shift], out[shift:]
        out = np.where(keys[b] < keys[a], b, a)
    return out


def strings_by_anchor(data: np.ndarray, sizes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of neighbouring strings with one anchor: text, first and last string (places in the text), the anchor's place, and its hash. data: the texts, one after the other."""
    width = length - GRAM + 1
    if len(data) < length:
        return tuple(np.empty(0, np.int64) for _ in range(4)) + (np.empty(0, np.uint64),)
    _, down = powers(len(data))
    keys = gram_hashes(data, GRAM, down)
    at = first_least(keys, width)
    ends = np.cumsum(sizes)
    text = np.repeat(np.arange(len(sizes)), sizes)[: len(at)]
    inside = np.arange(len(at)) + length <= ends[text]
    places = np.flatnonzero(inside)
    at, text = at[places], text[places]
    new = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (text[1:] != text[:-1])]) if len(at) else np.empty(0, np.int64)
    last = np.r_[new[1:], len(at)] - 1
    begin = (ends - sizes)[text[new]]
    return text[new], places[new] - begin, places[last] - begin, at[new] - begin, keys[at[new]]


def chunks(texts: list[str | None]) -> Iterator[tuple[int, list[bytes]]]:
    """The texts as bytes, some at a time, and the number of the first."""
    first, held, n = 0, [], 0
    for k, text in enumerate(texts):
        held.append((text or "").encode("utf-8", "replace"))
        n += len(held[-1])
        if n >= CHUNK:
            yield first, held
            first, held, n = k + 1, [], 0
    if held:
        yield first, held


def extensions(suffix: np.ndarray, room: np.ndarray, prefix: np.ndarray, down: np.ndarray, a: np.ndarray, b: np.ndarray, cap: int) -> np.ndarray:
    """How many bytes the suffixes a and b (rows) have in common, up to cap, by binary search over the hashes of their prefixes."""
    i, j = suffix[a], suffix[b]
    low, high = np.zeros(len(a), np.int64), np.minimum(np.minimum(room[a], room[b]), cap)
    while (open_ := low < high).any():
        middle = (low + high + 1) >> 1
        same = (prefix[i + middle] - prefix[i]) * down[i] == (prefix[j + middle] - prefix[j]) * down[j]
        low, high = np.where(open_ & same, middle, low), np.where(open_ & ~same, middle - 1, high)
    return low


def suffix_sort(data: np.ndarray, suffix: np.ndarray, room: np.ndarray, group: np.ndarray, cap: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows in the order of their groups (sorted already) and, there, of their suffixes, and how far each extends its forerunner.

    suffix: where each row's suffix begins in data; room: how many bytes it has; only cap bytes count. Merges stay within
    groups: in each round every row finds its place in the run that its own is merged with by binary search.
    """
    n = len(suffix)
    _, down = powers(len(data))
    up, _ = powers(len(data))
    prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_spread(data) * up[:-1], dtype=np.uint64)])
    padded = np.concatenate([data, np.zeros(1, np.uint8)])

    def below(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """-1, 0 or 1 for suffixes a and b: less, equal as far as cap, greater."""
        common = extensions(suffix, room, prefix, down, a, b, cap)
        ra, rb = np.minimum(room[a], cap), np.minimum(room[b], cap)
        x = np.where(common < ra, padded[np.minimum(suffix[a] + common, len(data))].astype(np.int16), -1)
        y = np.where(common < rb, padded[np.minimum(suffix[b] + common, len(data))].astype(np.int16), -1)
        return np.sign(x - y)

    order = np.arange(n)
    begins = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if n else np.empty(0, np.int64)
    sizes = np.diff(np.r_[begins, n])
    at = np.arange(n) - np.repeat(begins, sizes)
    begin, size = np.repeat(begins, sizes), np.repeat(sizes, sizes)
    run = 1
    while n and run < sizes.max():
        rows = np.flatnonzero(size > run)
        local = at[rows]
        mine = local // run
        left = mine % 2 == 0
        other = (mine ^ 1) * run
        low, high = np.minimum(other, size[rows]), np.minimum(other + run, size[rows])
        start = low.copy()
        while (open_ := low < high).any():
            middle = (low + high) >> 1
            k = np.flatnonzero(open_)
            sign = below(order[rows[k]], order[begin[rows[k]] + middle[k]])
            past = np.where(left[k], sign > 0, sign >= 0)  # equal rows of the left run stay first
            low[k], high[k] = np.where(past, middle[k] + 1, low[k]), np.where(past, high[k], middle[k])
        target = begin[rows] + np.minimum(mine, mine ^ 1) * run + (local - mine * run) + (low - start)
        moved = order.copy()
        moved[target] = order[rows]
        order = moved
        run *= 2
    extends = np.zeros(n, np.int64)
    if n > 1:
        inner = np.flatnonzero(group[1:] == group[:-1]) + 1
        a, b = order[inner - 1], order[inner]
        limit = np.minimum(np.minimum(room[a], room[b]), cap)
        common = np.zeros(len(inner), np.int64)
        live = np.arange(len(inner))
        for k in range(cap):  # byte by byte: what the hashes said is checked
            live = live[k < limit[live]]
            live = live[padded[suffix[a[live]] + k] == padded[suffix[b[live]] + k]]
            common[live] += 1
            if not len(live):
                break
        wrong = np.unique(group[order[inner[common != extensions(suffix, room, prefix, down, a, b, cap)]]])
        if len(wrong):  # hashes collide: these groups are sorted by their bytes
            for g in wrong.tolist():
                lo, hi = np.searchsorted(group, [g, g + 1])
                own = {k: data[suffix[k] : suffix[k] + min(int(room[k]), cap)].tobytes() for k in range(lo, hi)}
                order[lo:hi] = sorted(range(lo, hi), key=lambda k: (own[k], k))
                after = order[lo:hi].tolist()
                extends[lo + 1 : hi] = [len(commonprefix([own[x], own[y]])) for x, y in zip(after, after[1:], strict=False)]
            keep = ~np.isin(group[order[inner]], wrong)
            inner, common = inner[keep], common[keep]
        extends[inner] = common
    return order, extends


def repeats(anchor: np.ndarray, doc: np.ndarray, begin: np.ndarray, offset: np.ndarray, texts: list[bytes], length: int) -> list[tuple[int, int, int]]:
    """doc, begin and end of what is covered by strings that an earlier member of their anchor has as well.

    Rows are sorted by anchor, doc, begin. texts: the bytes from the first string of a run to the end of its last, from begin
    on in their document; the anchor stands at offset in them.
    """
    n = len(texts)
    sizes = np.array([len(t) for t in texts])
    places = np.cumsum(sizes) - sizes + offset
    data = np.frombuffer(b"".join(texts), np.uint8)
    group = np.cumsum(np.r_[0, anchor[1:] != anchor[:-1]])
    ahead, ahead_by = suffix_sort(data, places, sizes - offset, group, length)
    back, back_by = suffix_sort(np.ascontiguousarray(data[::-1]), len(data) - places, offset, group, length)
    least, most, out = offset + length - sizes, offset, []
    for before in range(int(least.min()), int(most.max()) + 1):  # bytes that a string has before the anchor
        rows = np.flatnonzero((least <= before) & (before <= most))
        if len(rows) < 2:
            continue
        a, b = np.empty(n, np.int64), np.empty(n, np.int64)
        a[ahead], b[back] = np.cumsum(ahead_by < length - before), np.cumsum(back_by < before)
        late = np.ones(len(rows), bool)
        late[np.unique(a[rows] * (n + 1) + b[rows], return_index=True)[1]] = False
        out.append(np.stack([rows[late], np.full(int(late.sum()), before)]))
    if not out:
        return []
    rows, before = np.concatenate(out, axis=1)
    place = begin[rows] + offset[rows] - before
    return join_spans(doc[rows], place, place + length)


def join_spans(doc: np.ndarray, begin: np.ndarray, end: np.ndarray) -> list[tuple[int, int, int]]:
    """Spans that touch or overlap, as one."""
    order = np.lexsort((begin, doc))
    doc, begin, end = doc[order], begin[order], end[order]
    new = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
    reach = np.concatenate([np.maximum.accumulate(x) for x in np.split(end, new[1:])]) if len(end) else end
    cut = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (begin[1:] > reach[:-1])])
    return list(zip(doc[cut].tolist(), begin[cut].tolist(), reach[np.r_[cut[1:], len(doc)] - 1].tolist(), strict=True)) if len(doc) else []


def anchors(docs: DataFrame, length: int) -> DataFrame:
    """The runs of each document: their anchor, where the first string begins, how many bytes the strings cover, and the place of the anchor in them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for first, held in chunks(batch.column(1).to_pylist()):
                text, low, high, place, key = strings_by_anchor(np.frombuffer(b"".join(held), np.uint8), np.array([len(t) for t in held]), length)
                columns = [pa.array(ids[first + text]), pa.array(key.view(np.int64)), *(pa.array(x.astype(np.int32)) for x in (low, high - low + length, place - low))]
                rows = pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in ANCHORS.split(", ")])
                yield from (rows.slice(i, 100_000) for i in range(0, len(rows), 100_000))

    return docs.select("doc_id", "text").mapInArrow(run, ANCHORS)


def members(docs: DataFrame, length: int) -> DataFrame:
    """MEMBERS of docs, which has for each document the runs whose anchors are found again (found: array of low, anchor, size, offset, and whether the anchor is hot)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, 2000) for b in batches for i in range(0, len(b), 2000)):
            ids, found, rows, seen = batch.column(0).to_pylist(), batch.column(2), [], {}
            ends = np.cumsum(found.value_lengths().to_numpy()).tolist()
            fields = found.flatten()
            runs = list(zip(*(fields.field(k).to_pylist() for k in ("low", "anchor", "size", "offset", "hot")), strict=True))
            texts = batch.column(1).to_pylist()
            for k in sorted(range(len(ids)), key=ids.__getitem__):
                data, doc = texts[k].encode("utf-8", "replace"), ids[k]
                for low, anchor, size, offset, hot in sorted(runs[ends[k - 1] if k else 0 : ends[k]]):
                    own = data[low : low + size]
                    if seen.setdefault((own, offset), (k, low)) != (k, low):
                        rows.append((1, None, doc, low, size, None, None))
                    elif hot:
                        rows += [(2, None, doc, low + s, length, None, own[s : s + length]) for s in range(size - length + 1)]
                    else:
                        rows.append((0, anchor, doc, low, size, offset, own))
            for i in range(0, len(rows), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[i : i + 50_000], strict=True), _MEMBER_TYPES, strict=True)], names=[c.split()[0] for c in MEMBERS.split(", ")])

    return docs.select("doc_id", "text", "found").mapInArrow(run, MEMBERS)


def repeated_runs(runs: DataFrame, length: int) -> DataFrame:
    """SPANS of what members of kind 0 repeat; a task sorts the suffixes of some anchors at a time."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def give(rows: list) -> Iterator[pa.RecordBatch]:
            if len(rows) < 2:
                return
            anchor, doc, begin, offset = (np.array([r[k] for r in rows], np.int64) for k in range(4))
            spans = repeats(anchor, doc, begin, offset, [r[4] for r in rows], length)
            if spans:
                d, b, e = zip(*spans, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(d, pa.int64()), pa.array(b, pa.int32()), pa.array(e, pa.int32())], names=["doc_id", "begin", "end"])

        rows, size, at = [], 0, None
        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                if row[0] != at:
                    if size >= CHUNK:
                        yield from give(rows)
                        rows, size = [], 0
                    at = row[0]
                rows.append(row)
                size += len(row[4])
        yield from give(rows)

    dealt = runs.select("anchor", "doc_id", "begin", "offset", "bytes").repartition("anchor").sortWithinPartitions("anchor", "doc_id", "begin")
    return dealt.mapInArrow(work, SPANS)


def spans(docs: DataFrame, length: int, hot: int) -> DataFrame:
    """SPANS, which may overlap, of the bytes of docs (doc_id, each once; text) that strings of length bytes cover that are found earlier."""
    found = staged(anchors(docs, length), "anchors")
    again = staged(found.groupBy("anchor").agg(F.count("*").alias("all")).where(F.col("all") > 1), "anchors_counted")  # a table of its own, so that Spark may split the join at hot anchors
    per_doc = found.join(again, "anchor").groupBy("doc_id").agg(F.collect_list(F.struct("low", "anchor", "size", "offset", (F.col("all") > hot).alias("hot"))).alias("found"))
    per_doc = staged(per_doc, "anchors_again")
    drop_staged(found)
    drop_staged(again)
    met = staged(members(docs.join(per_doc, "doc_id"), length), "members")
    drop_staged(per_doc)
    strings = met.where("kind = 2").select("bytes", "doc_id", "begin")
    first = strings.groupBy("bytes").agg(F.min(F.struct("doc_id", "begin")).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    late = strings.join(first, "bytes").where(F.struct("doc_id", "begin") != F.col("first"))
    single = lambda df, size: df.select("doc_id", "begin", (F.col("begin") + size).alias("end"))
    every = repeated_runs(met.where("kind = 0"), length).unionByName(single(met.where("kind = 1"), F.col("size"))).unionByName(single(late, F.lit(length)))
    out = staged(every, "spans")
    drop_staged(met)
    return out


def numbered(docs: DataFrame) -> DataFrame:
    """id (as given), doc_id (a number that orders the rows) and text. Where a doc_id is null or there twice, rows are numbered in the order of doc_id and text."""
    docs = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    n = docs.agg(F.count("*").alias("n")).first()["n"]
    if docs.select("id").where("id is not null").distinct().count() == n:
        return docs.withColumn("doc_id", F.col("id"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return staged(docs.repartitionByRange(parts, "id", F.xxhash64("text")).sortWithinPartitions("id", F.xxhash64("text"), "text").withColumn("doc_id", F.monotonically_increasing_id()), "numbered")


def dedup(docs: DataFrame, length: int = 100, hot: int = HOT) -> DataFrame:
    """doc_id, kept (the bytes that stay), n_bytes, n_removed and n_spans (maximal removed runs) of each row of docs (doc_id, text; other columns are left out).

    A byte goes if a string of length bytes covers it that also starts earlier: in a document of smaller doc_id, or
    in the same one. Strings are judged on the input. A null text counts as empty; rows that share a doc_id, or have none, are
    documents of their own, in the order of their texts' hashes; an empty table gives no rows.
    """
    rows = numbered(docs)
    found = spans(rows, length, hot).groupBy("doc_id").agg(F.collect_list(F.struct("begin", "end")).alias("spans"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 1000) for i in range(0, len(batch), 1000)):
                out = []
                for text, cuts in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                    data, at, kept, n = text.encode("utf-8", "replace"), 0, [], 0
                    for cut in sorted((c["begin"], c["end"]) for c in cuts or ()):
                        if cut[0] > at or not n:
                            kept.append(data[at : cut[0]])
                            n += 1
                        at = max(at, cut[1])
                    kept.append(data[at:])
                    whole = b"".join(kept)
                    out.append((whole, len(data), len(data) - len(whole), n))
                columns = zip(*out, strict=True) if out else [[]] * 4
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, t) for c, t in zip(columns, (pa.binary(), *(pa.int64(),) * 3), strict=True))], names=["doc_id", "kept", "n_bytes", "n_removed", "n_spans"])

    return rows.join(found, "doc_id", "left").select("id", "text", "spans").mapInArrow(run, "doc_id long, kept binary, n_bytes long, n_removed long, n_spans long")


def oracle(length: int = 100) -> str:
    """DuckDB SQL for op3's query over documents whose doc_ids are unique, by way of every string of length bytes, in hex."""
    return f"""with d as (select doc_id, hex(encode(coalesce(text, ''))) as h from documents),
    w as (select doc_id, s, row_number() over (partition by k order by doc_id, s) as n from (select doc_id, s, substr(h, 2 * s + 1, {2 * length}) as k from (select doc_id, h, unnest(range(0, greatest(len(h) // 2 - {length - 1}, 0))) as s from d) a) b),
    i as (select doc_id, s, sum(fresh) over (partition by doc_id order by s) as island from (select doc_id, s, case when s <= lag(s) over (partition by doc_id order by s) + {length} then 0 else 1 end as fresh from w where n > 1) x),
    g as (select doc_id, min(s) as a, max(s) + {length} as b from i group by doc_id, island),
    p as (select doc_id, a, b, coalesce(lag(b) over (partition by doc_id order by a), 0) as before from g),
    k as (select p.doc_id, sum(b - a) as n_removed, count(*) as n_spans, max(b) as last, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' order by a) as kept from p join d using (doc_id) group by p.doc_id)
    select d.doc_id, len(h) // 2 as n_bytes, coalesce(n_removed, 0)::bigint as n_removed, coalesce(n_spans, 0) as n_spans, sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(last, 0) + 1))) as kept_sha256 from d left join k using (doc_id)"""
