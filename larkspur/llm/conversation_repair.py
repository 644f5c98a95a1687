"""Conversation structure repair: the cheapest edits that make a conversation `(s?(ua)+)?`, by a lazily determinised weighted automaton.

Four states tell what the repaired roles so far end in: nothing, a system row, a user row, an assistant row. Read from the last row to
the first, a conversation has a vector of four costs at each place, what each state still has to pay. Less its least entry, a
vector is a state of a deterministic automaton; how rows move between such states is worked out when it is first met and kept in a
table, so that costs come from one look-up a row. The edits come from the first row on: of the arcs that are as cheap as the
vectors say, the one whose letter is first.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged

BLANKS = r"[\x20\x09-\x0D]"
#: Costs of deleting, inserting and giving another role, and of a cut-off text that stays.
DELETE, INSERT, REROLE, CUT = 4, 3, 3, 3
#: By state (0 nothing yet, 1 system, 2 user, 3 assistant): the state after the role that has to come next, user except after a user.
NEXT = (2, 2, 3, 2)
#: By state and initial (0 s, 1 u, 2 a, 3 other): the state after a row that is kept, -1 where it can't be.
KEPT = ((1, 2, -1, -1), (-1, 2, -1, -1), (-1, -1, 3, -1), (-1, 2, -1, -1))
NAMES = {2: b"user", 3: b"assistant"}
#: What each state still pays behind the last row: nothing after no row or an assistant, else for what is inserted.
END = (0, 6, 3, 0)
#: Pairs of initials (as in KEPT) that may stand side by side.
LEGAL = {(0, 1), (1, 2), (2, 1)}
FOUND = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
CHUNK = "codes binary, roles array<string>, texts array<string>, low long, high long, turns long"
PARTS = f"conv_id long, block int, chunk int, whole boolean, {CHUNK}, {FOUND}"


class Automaton:
    """The vectors met so far, numbered, and the moves between them. A code is 4 * fault (0 none, 1 cut off, 2 blank, 3 duplicate) + initial. Entries differ by at most 7, so the table stays small."""

    def __init__(self) -> None:
        self.vectors: list[tuple[int, ...]] = []
        self.numbers: dict[tuple[int, ...], int] = {}
        self.moves: list[list[tuple[int, int] | None]] = []
        self.edits: dict[tuple[int, int, int, int], tuple[str, int]] = {}

    def number(self, vector: tuple[int, ...]) -> int:
        if vector not in self.numbers:
            self.numbers[vector] = len(self.vectors)
            self.vectors.append(vector)
            self.moves.append([None] * 16)
        return self.numbers[vector]

    def move(self, after: int, code: int) -> tuple[int, int]:
        """The vector before a row, by its number, and what was taken from it, from the vector after the row."""
        v, (fault, initial) = self.vectors[after], divmod(code, 4)
        costs = [DELETE + v[q] for q in range(4)]
        if fault < 2:
            for q in range(4):
                kept = KEPT[q][initial]
                stays = min(REROLE + v[NEXT[q]], *([v[kept]] if kept >= 0 else []), 99)
                costs[q] = min(costs[q], CUT * fault + stays)
        for _ in range(3):
            costs = [min(costs[q], INSERT + costs[NEXT[q]]) for q in range(4)]
        least = min(costs)
        self.moves[after][code] = out = self.number(tuple(c - least for c in costs)), least
        return out

    def scan(self, codes: bytes, after: int) -> tuple[list[int], int]:
        """The numbers of the vectors before each row and behind the last, and the sum of what was taken."""
        numbers, taken, moves = [after], 0, self.moves
        for code in reversed(codes):
            after, least = moves[after][code] or self.move(after, code)
            taken += least
            numbers.append(after)
        numbers.reverse()
        return numbers, taken

    def edit(self, before: int, after: int, code: int, q: int) -> tuple[str, int]:
        """The edits up to and with that of a row, and the state behind it: of the tight arcs always the one whose letter is first."""
        key = before, after, code, q
        if key not in self.edits:
            (fault, initial), v, w = divmod(code, 4), self.vectors[before], self.vectors[after]
            least, said = self.moves[after][code][1], ""
            while not said or said[-1] == "I":
                owed, kept = v[q] + least, KEPT[q][initial]
                if owed == DELETE + w[q]:
                    said += "D"
                elif v[q] == INSERT + v[NEXT[q]]:
                    said, q = said + "I", NEXT[q]
                elif fault < 2 and kept >= 0 and owed == CUT * fault + w[kept]:
                    said, q = said + "K", kept
                else:
                    said, q = said + "R", NEXT[q]
            self.edits[key] = said, q
        return self.edits[key]


class Chunk(NamedTuple):
    """Rows of a conversation in a row: their codes, roles and texts of those that may stay, least and greatest turn, and how many different ones."""

    codes: bytes
    roles: list[str]
    texts: list[str]
    low: int | None
    high: int | None
    turns: int


class Repair:
    """The repair of a conversation, to which its chunks are added one after the other with the vector behind each."""

    def __init__(self, automaton: Automaton) -> None:
        self.automaton, self.q, self.audit, self.digest, self.begun = automaton, 0, [], hashlib.sha256(), False
        self.faults, self.illegal, self.cost, self.last = [0, 0, 0, 0], 0, 0, -1
        self.low, self.high, self.turns = None, None, 0

    def say(self, role: bytes, text: str = "") -> None:
        self.digest.update(b"\n" * self.begun + role + b":" + text.encode("utf-8", "replace"))
        self.begun = True

    def insert(self) -> None:
        self.q = NEXT[self.q]
        self.say(NAMES[self.q])

    def add(self, chunk: Chunk, after: int) -> None:
        numbers, taken = self.automaton.scan(chunk.codes, after)
        vectors, edit, came, k = self.automaton.vectors, self.automaton.edit, self.q, 0
        for i, code in enumerate(chunk.codes):
            said, q = edit(numbers[i], numbers[i + 1], code, self.q)
            for _ in said[:-1]:
                self.insert()
            if said[-1] != "D":
                self.say(chunk.roles[k].encode("utf-8", "replace") if said[-1] == "K" else NAMES[q], chunk.texts[k])
            k += code < 8
            self.q = q
            self.audit.append(said)
            self.faults[code >> 2] += 1
            self.illegal += self.last >= 0 and (self.last, code & 3) not in LEGAL
            self.last = code & 3
        self.cost += vectors[numbers[0]][came] + taken - vectors[numbers[-1]][self.q]
        if chunk.turns:
            self.turns += chunk.turns - (chunk.low == self.high)
            self.low, self.high = chunk.low if self.low is None else self.low, chunk.high

    def result(self) -> tuple:
        self.cost += END[self.q]
        while END[self.q]:
            self.insert()
            self.audit.append("I")
        gaps = self.high - self.low + 1 - self.turns if self.turns else 0
        _, cut, blank, duplicate = self.faults
        return gaps, blank, duplicate, cut, self.illegal, self.cost, "".join(self.audit), self.digest.hexdigest()


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and n, how many such rows there are, after crc32(`conv_id:turn`) % 20 dropped, emptied, cut, repeated or renamed them."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn")).cast("binary")) % 20
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), said("role").alias("role"), said("text").alias("text"), kind.alias("kind")).where("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    rows = rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.when(F.col("kind") == 3, 2).otherwise(1).alias("n"))
    return rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("n").alias("n"))


def _coded(rows: DataFrame) -> DataFrame:
    """Rows with their codes, and before the first of those that share conversation, role and text a mark (n is 0): all in order, in ranges."""
    rows = rows.withColumn("sha", F.sha2("text", 256))
    turn = F.struct(F.col("turn").isNotNull().alias("there"), F.coalesce("turn", F.lit(0)).alias("turn"))
    firsts = rows.groupBy("conv_id", "role", "sha").agg(F.min(turn).alias("at"), F.sum("n").alias("n"))
    marks = firsts.select("conv_id", F.when(F.col("at.there"), F.col("at.turn")).alias("turn"), "role", "sha", (F.col("n") * 0).alias("n"), F.lit(0).alias("code"), F.lit("").alias("text"))
    initial = F.instr(F.lit("sua"), F.substring("role", 1, 1))
    initial = F.when((F.col("role") == "") | (initial == 0), 3).otherwise(initial - 1)
    fault = F.when(~F.col("text").rlike(r"[^\x20\x09-\x0D]"), 2).when(~F.col("text").rlike(rf"[.!?]{BLANKS}*\z"), 1).otherwise(0)
    coded = rows.select("conv_id", "turn", "role", "sha", "n", (fault * 4 + initial).alias("code"), F.when(fault < 2, F.col("text")).otherwise("").alias("text"))
    keys = ["conv_id", "turn", "role", "sha"]
    return coded.unionByName(marks).repartitionByRange(*keys).sortWithinPartitions(*keys, "n")


def _chunks(rows: Iterator[dict], most_rows: int, most_bytes: int) -> Iterator[tuple[int | None, Chunk]]:
    """Conversation and chunk, in order, from rows in order. A chunk ends with its conversation, or at so many rows or bytes of text."""
    conv, mark, codes, roles, texts, size, low, high, turns, any_yet = None, None, bytearray(), [], [], 0, None, None, 0, False

    def full() -> Chunk:
        nonlocal codes, roles, texts, size, low, high, turns
        out = Chunk(bytes(codes), roles, texts, low, high, turns)
        codes, roles, texts, size, low, high, turns = bytearray(), [], [], 0, None, None, 0
        return out

    for row in rows:
        if any_yet and row["conv_id"] != conv and codes:
            yield conv, full()
        conv, any_yet, key = row["conv_id"], True, (row["conv_id"], row["turn"], row["role"], row["sha"])
        if not row["n"]:
            mark = key
            continue
        for k in range(row["n"]):
            code = row["code"]
            if code < 8 and (k or mark != key):
                code = 12 + code % 4
            codes.append(code)
            if code < 8:
                roles.append(row["role"])
                texts.append(row["text"])
                size += len(row["text"])
            if row["turn"] is not None and row["turn"] != high:
                low, high, turns = row["turn"] if low is None else low, row["turn"], turns + 1
            if len(codes) >= most_rows or size >= most_bytes:
                yield conv, full()
    if codes:
        yield conv, full()


def _dicts(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        yield from batch.to_pylist()


def _written(rows: Iterator[tuple], schema: pa.Schema, at_once: int = 256) -> Iterator[pa.RecordBatch]:
    waiting: list[tuple] = []
    for row in rows:
        waiting.append(row)
        if len(waiting) == at_once:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*waiting, strict=True), schema, strict=True)], schema=schema)
            waiting = []
    if waiting:
        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*waiting, strict=True), schema, strict=True)], schema=schema)


def _arrow(text: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary(), "string": pa.string(), "array<string>": pa.list_(pa.string()), "array<int>": pa.list_(pa.int32())}
    return pa.schema([(name, kinds[kind]) for name, kind in (x.split() for x in text.split(", "))])


def repair(conversations: DataFrame, most_rows: int = 1024, most_bytes: int = 1 << 18) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256 of each conv_id of conversations (conv_id, turn, role, text).

    Rows are damaged first (`damaged`), then stand in the order of their turns, nulls first; rows of one turn in the order of role
    and of the text's SHA-256, equal ones side by side. A null role or text counts as one space, and null conv_ids make a conversation. Columns
    besides the four are left out; an empty table gives no rows, a conversation without rows zeros.

    Equal rows are counted before they are shuffled, and ranges of rows, not conversations, are dealt out to tasks. A task finishes a conversation that neither begins nor ends
    its range, and fits a chunk of most_rows rows and most_bytes characters of text. What is left are chunks: one pass over their codes, a byte a row, from the
    last to the first, gives the vector behind each, another from the first to the last edits and hashes. In both a task holds a chunk at a time,
    besides the audit. The hash of a conversation is sequential by nature, so a conversation of whatever length has one task for these two passes.
    """

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, block = Automaton(), TaskContext.get().partitionId()
        none, open_ = (None,) * 8, (None,) * 6

        def out() -> Iterator[tuple]:
            found, k, begins = None, 0, False  # the chunk before, its number, whether its conversation begins with it inside the range
            for conv, chunk in _chunks(_dicts(batches), most_rows, most_bytes):
                if found:
                    if begins and conv != found[0]:
                        done = Repair(automaton)
                        done.add(found[1], automaton.number(END))
                        yield found[0], block, k, True, *open_, *done.result()
                    else:
                        yield found[0], block, k, False, *found[1], *none
                    k, begins = k + 1, conv != found[0]
                found = conv, chunk
            if found:
                yield found[0], block, k, False, *found[1], *none

        return _written(out(), _arrow(PARTS))

    def backward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton()

        def out() -> Iterator[tuple]:
            conv, after, any_yet = None, 0, False
            for row in _dicts(batches):
                if not any_yet or row["conv_id"] != conv:
                    conv, after, any_yet = row["conv_id"], automaton.number(END), True
                yield conv, row["block"], row["chunk"], automaton.vectors[after]
                after = automaton.scan(row["codes"], after)[0][0]

        return _written(out(), _arrow("conv_id long, block int, chunk int, ends array<int>"))

    def forward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton()

        def out() -> Iterator[tuple]:
            conv, now = None, None
            for row in _dicts(batches):
                if now is None or row["conv_id"] != conv:
                    if now:
                        yield conv, *now.result()
                    conv, now = row["conv_id"], Repair(automaton)
                now.add(Chunk(*(row[f] for f in Chunk._fields)), automaton.number(tuple(row["ends"])))
            if now:
                yield conv, *now.result()

        return _written(out(), _arrow(f"conv_id long, {FOUND}"), 1)

    rows = damaged(conversations)
    parts = staged(_coded(rows).mapInArrow(begin, PARTS), "conversation_parts")
    left, names = parts.where("not whole"), [x.split()[0] for x in FOUND.split(", ")]
    ends = left.select("conv_id", "block", "chunk", "codes").repartitionByRange("conv_id").sortWithinPartitions("conv_id", F.desc("block"), F.desc("chunk"))
    ends = ends.mapInArrow(backward, "conv_id long, block int, chunk int, ends array<int>").drop("conv_id")
    chunks = left.drop(*names, "whole").join(ends, ["block", "chunk"]).repartitionByRange("conv_id").sortWithinPartitions("conv_id", "block", "chunk")
    edges = chunks.mapInArrow(forward, f"conv_id long, {FOUND}")
    found = parts.where("whole").select("conv_id", *names).unionByName(edges)
    every = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    joined = every.alias("a").join(found.alias("b"), F.col("a.conv_id").eqNullSafe(F.col("b.conv_id")), "left")
    empty = {"audit": "", "repaired_sha256": hashlib.sha256().hexdigest()}
    return joined.select("a.conv_id", *(F.coalesce(f"b.{c}", F.lit(empty.get(c, 0))).alias(c) for c in names))


def oracle() -> str:
    """DuckDB SQL for the rows of repair over `conversations`: all edits of a row at a time, and for each state the least of cost and audit so far."""
    more = lambda s, n, ch: f"(lpad(cast(cast(substr({s}, 1, 6) as int) + {n} as varchar), 6, '0') || substr({s}, 7) || '{ch}')"
    step = "i2 as (select {keep}, s0, s1, s3, least(s2, {a}, {b}, {c}) as t2 from x), i3 as (select *, least(s3, {d}) as t3 from i2), i as (select {keep}, s0 as i0, s1 as i1, least(t2, {e}) as i2, t3 as i3 from i3)"
    insert = lambda keep: step.format(keep=keep, a=more("s0", INSERT, "I"), b=more("s1", INSERT, "I"), c=more("s3", INSERT, "I"), d=more("t2", INSERT, "I"), e=more("t3", INSERT, "I"))
    kept = lambda s, initial: f"case when fault < 2 and initial = '{initial}' then {more(s, f'{CUT} * fault', 'K')} end"
    other = lambda s: f"case when fault < 2 then {more(s, f'{REROLE} + {CUT} * fault', 'R')} end"
    crc = "xor(4294967295, list_reduce(list_prepend(4294967295::bigint, flatten(list_transform(string_split({0}, ''), lambda z: [ascii(z)::bigint, 0, 0, 0, 0, 0, 0, 0]))), lambda p, q: case when xor(p, q) & 1 = 1 then xor(xor(p, q) >> 1, 3988292384) else xor(p, q) >> 1 end))"
    key = "(coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' '))"
    return f"""with recursive d as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, {crc.format(key)} % 20 as kind from conversations),
    e as (select conv_id, turn, case when kind = 4 then 'user' else role end as role, case kind when 1 then '' when 2 then translate(text, '.!?', '') else text end as text from d cross join (select unnest([1, 2]) as copy) c where kind <> 0 and (copy = 1 or kind = 3)),
    o as (select *, row_number() over (partition by conv_id order by turn nulls first, role, sha256(text)) as k from e), r as (select *, row_number() over (partition by conv_id, role, text order by k) as again, substr(role, 1, 1) as initial, trim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as bare from o),
    f as (select *, case when bare = '' then 2 when again > 1 then 3 when right(bare, 1) not in ('.', '!', '?') then 1 else 0 end as fault, lag(initial) over (partition by conv_id order by k) as before from r),
    s(conv_id, k, s0, s1, s2, s3) as (select distinct conv_id, 0::bigint, '000000', null::varchar, null::varchar, null::varchar from f
        union all (with x as (select s.*, f.fault, f.initial from s join f on f.conv_id is not distinct from s.conv_id and f.k = s.k + 1), {insert("conv_id, k, fault, initial")}
        select conv_id, k + 1, {more("i0", DELETE, "D")}, least({more("i1", DELETE, "D")}, {kept("i0", "s")}), least({more("i2", DELETE, "D")}, {kept("i0", "u")}, {kept("i1", "u")}, {kept("i3", "u")}, {other("i0")}, {other("i1")}, {other("i3")}), least({more("i3", DELETE, "D")}, {kept("i2", "a")}, {other("i2")}) from i)),
    x as (select * from s qualify row_number() over (partition by conv_id order by k desc) = 1), {insert("conv_id")}, best as (select conv_id, least(i0, i3) as said from i),
    letters as (select conv_id, substr(said, 6 + j, 1) as letter, j from best, lateral (select unnest(range(1, length(said) - 5)) as j) n),
    placed as (select *, count(*) filter (where letter <> 'I') over w as k, count(*) filter (where letter <> 'D') over w as m from letters window w as (partition by conv_id order by j)),
    met as (select p.*, f.role, f.text, f.initial from placed p left join f on p.letter <> 'I' and f.conv_id is not distinct from p.conv_id and f.k = p.k),
    starts as (select conv_id, max(case when m = 1 and letter = 'K' and initial = 's' then 1 else 0 end) as system_ from met where letter <> 'D' group by conv_id),
    lines as (select met.conv_id, j, case letter when 'K' then role else case when (m - system_) % 2 = 1 then 'user' else 'assistant' end end || ':' || case letter when 'I' then '' else text end as line from met join starts on starts.conv_id is not distinct from met.conv_id where letter <> 'D'),
    told as (select conv_id, string_agg(line, chr(10) order by j) as whole from lines group by conv_id),
    counted as (select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (where fault = 2) as blank, count(*) filter (where fault = 3) as duplicate, count(*) filter (where fault = 1) as truncated, count(*) filter (where before || initial not in ('su', 'ua', 'au')) as illegal from f group by conv_id)
    select a.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal, coalesce(cast(substr(said, 1, 6) as int), 0) as cost, coalesce(substr(said, 7), '') as audit, sha256(coalesce(whole, '')) as repaired_sha256
    from (select distinct conv_id from conversations) a left join counted c on c.conv_id is not distinct from a.conv_id left join best b on b.conv_id is not distinct from a.conv_id left join told t on t.conv_id is not distinct from a.conv_id"""
