"""SimHash near-duplicates by tiled exact comparison.

Distinct fingerprints are sorted by the population counts of their bytes and cut into blocks. The sum of the bytes'
differences in population count never exceeds the number of differing bits, so two blocks, and within a pair of blocks two
tiles, are compared only if the ranges of their counts come that close. What is left is compared in full with numpy, exclusive-or
and bit counts. A pair of blocks hands on a spanning forest of its links, not all of them; components come from star
contraction over those. Where a similarity of texts is asked for, fingerprints are of 128 bits, texts of too unlike sizes are
skipped in the same way, and the shingles of what is linked are compared.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_staged, staged, words

FINGERPRINTS = "doc_id long, fp long"
WIDE_PRINTS = "doc_id long, version long, fp long, fp2 long, size long"
BLOCKS = "low array<int>, high array<int>, least long, most long, prints binary, sizes binary, nodes binary"
LINKS = "a long, b long"
TILE = 256


def shingles(text: str | None, width: int, seed: int) -> np.ndarray:
    """The hashes of a text's word shingles, in lower case; a text of fewer words is one shingle, one without words has none."""
    found = words(text)
    if not found:
        return np.empty(0, np.uint64)
    found = b" ".join(found).lower().split(b" ")
    line, ends = b" ".join(found), np.cumsum([len(w) + 1 for w in found])
    starts, stops = (ends - [len(w) + 1 for w in found]).tolist(), (ends - 1).tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(line[a:b], seed) for a, b in zip(starts, stops[width - 1 :], strict=False)] or [digest(line, seed)], np.uint64)


def simhash(hashes: np.ndarray) -> int:
    """A bit is 1 if it is set in over half the hashes."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 14):
        ones += np.unpackbits(hashes[i : i + (1 << 14)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, width: int = 4, seed: int = 42) -> int:
    """The 64-bit SimHash of a text's word shingles, those that repeat included; a text without words has 0."""
    return simhash(shingles(text, width, seed))


def fingerprints(docs: DataFrame, width: int = 4, seed: int = 42) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed number) of each row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([fingerprint(t, width, seed) for t in batch.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints)], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, FINGERPRINTS)


def _again(hashes: np.ndarray) -> np.ndarray:
    """Other 64 bits for the same hashes."""
    x = hashes * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ x >> np.uint64(32)


def wide_prints(docs: DataFrame, width: int, seed: int = 42) -> DataFrame:
    """WIDE_PRINTS of docs (doc_id, version, text): 128 bits over the distinct shingles of a text, and how many those are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(shingles(t, width, seed)) for t in batch.column(2).to_pylist()]
            prints = [pa.array(np.array([simhash(f(x)) for x in sets], np.uint64).view(np.int64)) for f in (lambda x: x, _again)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *prints, pa.array([len(x) for x in sets], pa.int64())], names=[c.split()[0] for c in WIDE_PRINTS.split(", ")])

    return docs.select("doc_id", "version", "text").mapInArrow(run, WIDE_PRINTS)


def byte_counts(prints: np.ndarray) -> np.ndarray:
    """The population counts of the bytes of each print; prints: n x words."""
    return np.bitwise_count(np.ascontiguousarray(prints).view(np.uint8).reshape(len(prints), -1))


def apart(low: np.ndarray, high: np.ndarray, low2: np.ndarray, high2: np.ndarray) -> np.ndarray:
    """The least possible sum of differences of counts between ranges; the last axis has the bytes."""
    return np.maximum(np.maximum(low - high2, low2 - high), 0).sum(axis=-1)


class Forest:
    """Groups of places, joined link by link; links holds those that joined two groups."""

    def __init__(self, n: int):
        self.root, self.links = np.arange(n), []

    def join(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Which of the links a, b joined two groups."""
        fresh = np.flatnonzero(self.root[a] != self.root[b])
        a, b, used = a[fresh], b[fresh], []
        if not len(a):
            return fresh
        above: dict[int, int] = {}

        def top(x: int) -> int:
            while x in above:
                x = above[x]
            return x

        ends = np.stack([self.root[a], self.root[b]])
        _, first = np.unique(np.sort(ends, axis=0), axis=1, return_index=True)
        for k in first.tolist():
            x, y = top(int(ends[0, k])), top(int(ends[1, k]))
            if x != y:
                above[max(x, y)] = min(x, y)
                self.links.append((int(a[k]), int(b[k])))
                used.append(k)
        moved = np.arange(len(self.root))
        for x in above:
            moved[x] = top(x)
        self.root = moved[self.root]
        return fresh[used]


class Block:
    """Prints (n x words) in their order, the sizes of their texts, and for each tile the ranges of both."""

    def __init__(self, prints: np.ndarray, sizes: np.ndarray):
        at = np.arange(0, len(prints), TILE)
        counts = byte_counts(prints).astype(np.int16)
        self.prints, self.low, self.high = prints, np.minimum.reduceat(counts, at), np.maximum.reduceat(counts, at)
        self.sizes, self.least, self.most = sizes, np.minimum.reduceat(sizes, at), np.maximum.reduceat(sizes, at)

    def __len__(self) -> int:
        return len(self.prints)


def close(a: Block, b: Block | None, radius: int, similarity: float = 0.0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (in a, then b, in one numbering) of all pairs of at most radius bits between a and b, or within a if b is None, two tiles at a time, the closest pairs first.

    Tiles, and then pairs, whose texts can't have shingles in common to a share of similarity are skipped.
    """
    other, shift = (a, 0) if b is None else (b, len(a))
    for i in range(len(a.low)):
        mine = a.prints[i * TILE : (i + 1) * TILE, None]
        near = (apart(a.low[i], a.high[i], other.low, other.high) <= radius) & (a.most[i] >= similarity * other.least) & (other.most >= similarity * a.least[i])
        for j in np.flatnonzero(near).tolist():
            if b is None and j < i:
                continue
            theirs = other.prints[None, j * TILE : (j + 1) * TILE]
            bits = np.bitwise_count(mine[..., 0] ^ theirs[..., 0])
            x, y = np.nonzero(bits <= radius)
            for k in range(1, mine.shape[2]):
                bits = bits[x, y] if k == 1 else bits
                bits = bits + np.bitwise_count(mine[x, 0, k] ^ theirs[0, y, k])
                x, y, bits = x[bits <= radius], y[bits <= radius], bits[bits <= radius]
            if not len(x):
                continue
            if mine.shape[2] > 1:
                order = np.argsort(bits, kind="stable")
                x, y = x[order], y[order]
            x, y = x + i * TILE, y + j * TILE
            if similarity:
                one, two = a.sizes[x], other.sizes[y]
                fits = np.minimum(one, two) >= similarity * np.maximum(one, two)
                x, y = x[fits], y[fits]
            y = y + shift
            if b is None:
                x, y = x[x < y], y[x < y]
            if len(x):
                yield x, y


def forest(a: Block, b: Block | None, radius: int, similarity: float = 0.0, depth: int = 1) -> tuple[list[tuple[int, int]], int]:
    """Links that span all of close(), and how many pairs they leave out. depth: so many forests, each of links that those before it didn't need."""
    out, left = [Forest(len(a) + (0 if b is None else len(b))) for _ in range(depth)], 0
    for x, y in close(a, b, radius, similarity):
        for one in out:
            used = one.join(x, y)
            x, y = np.delete(x, used), np.delete(y, used)
        left += len(x)
    return [link for one in out for link in one.links], left


def _near(one: str, two: str, radius: int, similarity: float) -> Column:
    """Whether the ranges of two blocks come close enough for a link."""
    c = lambda side, name: F.col(f"{side}.{name}")
    gaps = F.zip_with(F.zip_with(c(one, "low"), c(two, "high"), lambda x, y: x - y), F.zip_with(c(two, "low"), c(one, "high"), lambda x, y: x - y), lambda x, y: F.greatest(x, y, F.lit(0)))
    return (F.aggregate(gaps, F.lit(0), lambda total, x: total + x) <= radius) & (c(one, "most") >= similarity * c(two, "least")) & (c(two, "most") >= similarity * c(one, "least"))


def _blocks(nodes: DataFrame, radius: int, block_rows: int, least_blocks: int, similarity: float) -> tuple[DataFrame, DataFrame, int]:
    """Blocks of nodes, the pairs of them that can have links, and how many words a print has."""
    n = nodes.count()
    many = max(least_blocks, -(-n // block_rows))
    prints = [c for c in ("fp", "fp2") if c in nodes.columns]
    nodes = nodes.select("node", *prints, (F.col("size") if "size" in nodes.columns else F.lit(0)).cast("long").alias("size"))
    counts = [F.bit_count(F.shiftrightunsigned(c, 8 * k).bitwiseAND(F.lit(0xFF))) for c in prints for k in range(8)]

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if sum(len(b) for b in held):
            table = pa.Table.from_batches(held)
            found = np.stack([table.column(c).to_numpy() for c in prints], 1).view(np.uint64)
            ids, sizes = (np.ascontiguousarray(table.column(c).to_numpy()) for c in ("node", "size"))
            block = Block(found, sizes)
            row = {"low": block.low.min(0).tolist(), "high": block.high.max(0).tolist(), "least": int(sizes.min()), "most": int(sizes.max()), "prints": found.tobytes(), "sizes": sizes.tobytes(), "nodes": ids.tobytes()}
            fields = [*((k, pa.list_(pa.int32())) for k in ("low", "high")), *((k, pa.int64()) for k in ("least", "most")), *((k, pa.binary()) for k in ("prints", "sizes", "nodes"))]
            yield pa.RecordBatch.from_pylist([row], pa.schema(fields))

    order = ["size", *counts, *prints]
    dealt = nodes.repartitionByRange(many, *order).sortWithinPartitions(*order)
    blocks = staged(dealt.mapInArrow(gather, BLOCKS).withColumn("block", F.spark_partition_id()), "simhash_blocks")
    ranges = blocks.select("block", "low", "high", "least", "most")
    later = ranges.withColumn("other", F.explode(F.sequence(F.col("block"), F.lit(many - 1)))).alias("one")
    pairs = later.join(ranges.alias("two"), F.col("one.other") == F.col("two.block")).where(_near("one", "two", radius, similarity)).select(F.col("one.block").alias("first"), F.col("two.block").alias("second"))
    return blocks, staged(pairs.withColumn("pair", F.col("first") * F.lit(many).cast("long") + F.col("second")), "block_pairs"), len(prints)


def _compared(blocks: DataFrame, pairs: DataFrame, work, schema: str) -> DataFrame:
    """What work makes of each pair of blocks (pair, and of each of the two the rows of blocks, in order), one pair after the other in a task. blocks: block and binary columns."""
    spark, columns = blocks.sparkSession, [c for c in blocks.columns if c != "block"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for batch in batches:
            for row in batch.to_pylist():
                if row["pair"] != at and held:
                    yield from work(at, held)
                    held = []
                at = row["pair"]
                held.append({c: np.frombuffer(row[c], np.int64) for c in columns})
        if held:
            yield from work(at, held)

    sides = pairs.select("pair", F.explode(F.array_distinct(F.array("first", "second"))).alias("block"))
    tasks = max(1, min(pairs.count(), 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    return blocks.join(sides, "block").repartition(tasks, "pair").sortWithinPartitions("pair", "block").select("pair", *columns).mapInArrow(run, schema)


def _block(held: dict[str, np.ndarray], width: int) -> Block:
    return Block(held["prints"].view(np.uint64).reshape(-1, width), held["sizes"])


def _first_links(blocks: DataFrame, pairs: DataFrame, width: int, radius: int, similarity: float, depth: int) -> DataFrame:
    """a and b of the links that each pair of blocks hands on; and, with a null, the numbers (b) of the pairs that left some out."""

    def work(pair: int, held: list) -> Iterator[pa.RecordBatch]:
        ends, left = forest(_block(held[0], width), _block(held[1], width) if len(held) > 1 else None, radius, similarity, depth)
        both, ends = np.concatenate([h["nodes"] for h in held]), np.array(ends, np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.array(both[ends[:, k]]) for k in (0, 1)], names=["a", "b"])
        if left:
            yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([pair], pa.int64())], names=["a", "b"])

    return _compared(blocks.select("block", "prints", "sizes", "nodes"), pairs, work, LINKS)


def links(nodes: DataFrame, radius: int, block_rows: int = 1 << 16, least_blocks: int = 12) -> DataFrame:
    """Links (a, b: nodes) that connect what links of at most radius bits connect. nodes: node and fp, each fp once.

    Each pair of blocks is at most block_rows squared comparisons and 48 bytes a fingerprint; a task takes one after the other. Pairs are planned from
    a row for each block, in Spark; the driver gets how many there are.
    """
    blocks, pairs, width = _blocks(nodes, radius, block_rows, least_blocks, 0.0)
    return _first_links(blocks, pairs, width, radius, 0.0, 1).where("a is not null")


def similar_links(nodes: DataFrame, radius: int, similarity: float, confirm, sets_of, block_rows: int = 1 << 16, least_blocks: int = 12, depth: int = 1) -> DataFrame:
    """Links (a, b: nodes) that connect what pairs of at most radius bits, of nodes whose sets are alike to a share of similarity, connect. nodes: node, fp, fp2 and size, each three once.

    First each pair of blocks hands on depth spanning forests, closest pairs first, and confirm tells which of those links hold: that joins groups of copies without all their pairs. Those that don't hold may have kept
    others out, so the pairs of blocks that left any out are compared once more. The nodes that have a close pair with a node of another group meet, with their sets (sets_of: nodes to node and shingles), in small blocks again, and there
    all their close pairs are tried, the closest first, unless they are joined already.
    """
    blocks, pairs, width = _blocks(nodes, radius, block_rows, least_blocks, similarity)
    first = staged(_first_links(blocks, pairs, width, radius, similarity, depth), "first_links")
    sound = staged(confirm(first.where("a is not null")), "sound_links")
    again = pairs.join(first.where("a is null").select(F.col("b").alias("pair")), "pair", "left_semi")
    grouped = staged(components(sound), "first_groups")

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.frombuffer(raw.as_buffer(), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), block, np.int32)), pa.array(np.arange(len(ids), dtype=np.int32)), pa.array(ids)], names=["block", "place", "node"])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            roots = [np.array(x, np.int64).tobytes() for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(roots, pa.binary())], names=["block", "roots"])

    wanted = again.select(F.explode(F.array("first", "second")).alias("block")).distinct()
    places = blocks.join(wanted, "block", "left_semi").select("block", "nodes").mapInArrow(listed, "block int, place int, node long").join(grouped, "node", "left")
    roots = places.groupBy("block").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", F.coalesce("root", "node").alias("root")))), lambda x: x["root"]).alias("roots")).mapInArrow(packed, "block int, roots binary")

    def work(pair: int, held: list) -> Iterator[pa.RecordBatch]:
        ids, root = (np.concatenate([h[c] for h in held]) for c in ("nodes", "roots"))
        there = np.zeros(len(ids), bool)
        for x, y in close(_block(held[0], width), _block(held[1], width) if len(held) > 1 else None, radius, similarity):
            other = root[x] != root[y]
            there[x[other]] = there[y[other]] = True
        yield pa.RecordBatch.from_arrays([pa.array(ids[there])], names=["node"])

    open_ = staged(_compared(blocks.select("block", "prints", "sizes", "nodes").join(roots, "block"), again, work, "node long").distinct(), "open_nodes")
    known = nodes.join(open_, "node", "left_semi").join(grouped, "node", "left").withColumn("root", F.coalesce("root", "node")).join(sets_of(open_), "node")
    return sound.unionByName(_tried(staged(known.select("node", "root", "fp", "fp2", "size", "shingles"), "open_sets"), radius, similarity))


def _tried(nodes: DataFrame, radius: int, similarity: float, most_bytes: int = 1 << 24) -> DataFrame:
    """Links between nodes (node, root, fp, fp2, size, and shingles, 8 bytes each) of different groups (root) that are close and whose shingles are alike: as many as join all that such pairs join.

    Blocks are of nodes of one size within a factor of two, and of about most_bytes of shingles, however large their texts; sets of a similarity of a half and more are at most a factor of two apart, so
    blocks meet those of their own size and the next. The driver gets a count for each size.
    """
    klass = F.floor(F.log2(F.greatest("size", F.lit(1)).cast("double"))).cast("int")
    nodes = nodes.withColumn("klass", klass)
    many = {r["klass"]: max(1, -(-r["n"] * (16 << r["klass"]) // most_bytes)) for r in nodes.groupBy("klass").agg(F.count("*").alias("n")).collect()}
    part = F.coalesce(*(F.when(F.col("klass") == k, F.pmod(F.xxhash64("node"), F.lit(n))) for k, n in many.items()), F.lit(0))
    nodes = nodes.withColumn("block", F.col("klass") * F.lit(1 << 32) + part)
    each = nodes.select("klass", "block").distinct()
    later = each.select(F.col("block").alias("first"), F.explode(F.array(F.col("klass"), F.col("klass") + 1)).alias("klass"))
    pairs = later.join(each.select("klass", F.col("block").alias("second")), "klass").where("second >= first").select("first", "second", F.xxhash64("first", "second").alias("pair"))
    sides = pairs.select("pair", F.explode(F.array_distinct(F.array("first", "second"))).alias("block"))

    def work(rows: list[dict]) -> pa.RecordBatch:
        halves = [[r for r in rows if r["block"] == k] for k in sorted({r["block"] for r in rows})]
        both = [r for half in halves for r in half]
        made = [Block(np.array([[r["fp"], r["fp2"]] for r in half], np.int64).view(np.uint64), np.array([r["size"] for r in half], np.int64)) for half in halves]
        sets = [r["shingles"] for r in both]
        numbers, root = np.unique([r["root"] for r in both], return_inverse=True)
        above, ends = list(range(len(numbers))), []

        def top(x: int) -> int:
            while above[x] != x:
                above[x] = x = above[above[x]]
            return x

        for x, y in close(made[0], made[1] if len(made) > 1 else None, radius, similarity):
            for i, j in zip(x.tolist(), y.tolist(), strict=True):
                one, two = top(int(root[i])), top(int(root[j]))
                if one != two:
                    common = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                    if common >= similarity * (len(sets[i]) + len(sets[j]) - common):
                        above[max(one, two)] = min(one, two)
                        ends.append((both[i]["node"], both[j]["node"]))
        return pa.RecordBatch.from_arrays([pa.array([e[k] for e in ends], pa.int64()) for k in (0, 1)], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for batch in batches:
            found = batch.column(batch.schema.get_field_index("shingles"))
            for k, row in enumerate(batch.drop_columns(["shingles"]).to_pylist()):
                if row["pair"] != at and held:
                    yield work(held)
                    held = []
                at = row["pair"]
                held.append(row | {"shingles": np.frombuffer(found[k].as_buffer(), np.int64).copy()})
        if held:
            yield work(held)

    dealt = nodes.drop("klass").join(sides, "block").repartition("pair").sortWithinPartitions("pair", "block")
    return dealt.mapInArrow(run, LINKS)


def components(links: DataFrame) -> DataFrame:
    """node and root (the smallest node that links reach) of each node with links; links: a, b (long).

    Star contraction: all larger neighbours of a node, then all smaller ones, are tied to the smallest; rounds go on until
    nothing changes, about as often as the logarithm of the longest chain. Minima are taken before shuffling, and every
    round is written to the shared folder.
    """
    at, before = staged(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links"), None
    while True:
        state = at.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            return at.select(F.col("a").alias("node"), F.col("b").alias("root")).union(at.select("b", "b")).groupBy("node").agg(F.min("root").alias("root"))
        before = state
        both = at.union(at.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("x")).select("x.*").where("a <> b").distinct()
        done, at = at, staged(small, "links")
        drop_staged(done)


def near_duplicates(docs: DataFrame, radius: int = 4, width: int = 4, seed: int = 42) -> DataFrame:
    """doc_id, fp and component_id of each row of docs (doc_id, text; other columns are left out).

    component_id is the smallest doc_id that links of at most radius differing bits reach, the row's own included. Texts
    without words, null ones too, have fingerprint 0 and are linked like any other. Rows without a doc_id take no part in
    links and have a null component_id unless another row has the same fingerprint. Rows that repeat stay as they are; an
    empty table gives no rows.
    """
    prints = staged(fingerprints(docs, width, seed), "fingerprints")
    nodes = staged(prints.groupBy("fp").agg(F.min("doc_id").alias("node")).where("node is not null"), "fingerprint_nodes")
    found = components(links(nodes, radius))
    roots = nodes.join(found, "node", "left").select("fp", F.coalesce("root", "node").alias("component_id"))
    return prints.join(roots, "fp", "left").select("doc_id", "fp", "component_id")


def radius_of(similarity: float, bits: int = 128, spread: float = 2.0) -> int:
    """How many of bits may differ so that nearly all pairs of sets of a similarity or more are met: the expected number, and spread times its deviation."""
    part = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return math.ceil(bits * part + spread * math.sqrt(bits * part * (1 - part)))


def similar_groups(docs: DataFrame, similarity: float = 0.8, width: int = 5, seed: int = 42, depth: int = 1) -> DataFrame:
    """doc_id, version (a hash of the text), component_id and component_version of each different pair of doc_id and text of docs (doc_id, text; other columns are left out).

    The latter two are the smallest doc_id, and of that the smallest version, reached over texts whose sets of word shingles have at least a share of similarity in common: texts
    of one doc_id that aren't alike are in different components. Pairs are met by 128-bit fingerprints at radius_of(similarity), two deviations beyond what is expected at that very similarity, and confirmed by
    their shingles (`similar_links`), however many unlike texts are as close. Null texts count as empty, and all texts without words
    are alike. Rows without a doc_id are left out; an empty table gives no rows.
    """
    known = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("version", F.xxhash64("text"))
    prints = staged(wide_prints(known, width, seed), "wide_prints")
    nodes = staged(prints.groupBy("fp", "fp2", "size").agg(F.min(F.struct("doc_id", "version")).alias("first")).select("fp", "fp2", "size", F.xxhash64("first.doc_id", "first.version").alias("node"), "first.*"), "wide_nodes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, 500) for b in batches for i in range(0, len(b), 500)):
            sets = [np.unique(shingles(t, width, seed)).view(np.int64) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["node", "shingles"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, 500) for b in batches for i in range(0, len(b), 500)):
            sets = [np.unique(shingles(t, width, seed)).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["node", "shingles"])

    def texts_of(ends: DataFrame) -> DataFrame:
        wanted = nodes.join(ends, "node", "left_semi").select("node", "doc_id", "version")
        return known.join(wanted, ["doc_id", "version"]).dropDuplicates(["node"]).select("node", "text")

    def sets_of(ends: DataFrame) -> DataFrame:
        return texts_of(ends).mapInArrow(pack, "node long, shingles binary")

    def confirm(met: DataFrame) -> DataFrame:
        ends = met.select("a").union(met.select("b")).toDF("node").distinct()
        sets = staged(texts_of(ends).mapInArrow(run, "node long, shingles array<long>"), "shingles")
        side = lambda end: sets.select(F.col("node").alias(end), F.col("shingles").alias(f"of_{end}"))
        common = F.size(F.array_intersect("of_a", "of_b"))
        return met.join(side("a"), "a").join(side("b"), "b").where(common >= similarity * (F.size("of_a") + F.size("of_b") - common)).select("a", "b")

    roots = components(similar_links(nodes, radius_of(similarity), similarity, confirm, sets_of, depth=depth))
    least = nodes.select("node", "doc_id", "version").join(roots, "node", "left").select("node", "doc_id", "version", F.coalesce("root", "node").alias("root"))
    names = least.groupBy("root").agg(F.min(F.struct("doc_id", "version")).alias("x")).select("root", F.col("x.doc_id").alias("component_id"), F.col("x.version").alias("component_version"))
    of_nodes = least.select("node", "root").join(names, "root").drop("root").join(nodes.select("node", "fp", "fp2", "size"), "node")
    return prints.join(of_nodes, ["fp", "fp2", "size"]).select("doc_id", "version", "component_id", "component_version").distinct()
