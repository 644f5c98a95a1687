"""The repair of conversations against every sequence of edits."""

import hashlib
import re
import zlib
from itertools import product

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from larkspur.llm import conversation_repair as cr

GOOD = re.compile("(s?(ua)+)?")


def damage(rows):
    """Rows (conv_id, turn, role, text) after damage, in order."""
    say = lambda v: " " if v is None else str(v)
    out = []
    for conv, turn, role, text in rows:
        kind, role, text = zlib.crc32(f"{say(conv)}:{say(turn)}".encode()) % 20, say(role), say(text)
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            out += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest()))


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        said = text.strip(" \t\n\v\f\r")
        out.append("blank" if not said else "duplicate" if (role, text) in seen else "" if said[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def cheapest(rows, wrong):
    """cost, audit and repaired lines, by a search over all edits with at most two insertions side by side."""
    best = {("", ""): (0, "", [])}  # (initials so far, shortened; kept to know what may follow) is the last two initials

    def better(to, key, value):
        if key not in to or value[:2] < to[key][:2]:
            to[key] = value

    def fits(initials, new):
        return bool(re.fullmatch("s?(ua)*u?", initials + new))

    def inserted(now):
        for _ in range(3):
            for (x, _), (cost, audit, lines) in list(now.items()):
                for name in ("user", "assistant"):
                    if fits(x, name[0]):
                        better(now, (shorter(x + name[0]), ""), (cost + 3, audit + "I", [*lines, f"{name}:"]))
        return now

    def shorter(x):
        return re.sub("(ua)+", "ua", x)

    for (_, role, text), bad in zip(rows, wrong, strict=True):
        after = {}
        for (x, _), (cost, audit, lines) in inserted(best).items():
            better(after, (x, ""), (cost + 4, audit + "D", lines))
            if bad in ("", "truncated"):
                more = 3 * (bad == "truncated")
                if role and fits(x, role[0]):
                    better(after, (shorter(x + role[0]), ""), (cost + more, audit + "K", [*lines, f"{role}:{text}"]))
                for name in ("user", "assistant"):
                    if fits(x, name[0]):
                        better(after, (shorter(x + name[0]), ""), (cost + 3 + more, audit + "R", [*lines, f"{name}:{text}"]))
        best = after
    return min((v for (x, _), v in inserted(best).items() if GOOD.fullmatch(x)), key=lambda v: v[:2])


def expected(conv, rows):
    rows = damage(rows)
    wrong, turns = faults(rows), {t for t, _, _ in rows if t is not None}
    cost, audit, lines = cheapest(rows, wrong) if rows else (0, "", [])
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    return (conv, gaps, *(wrong.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def brute(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[0], []).append(r)
    return sorted((expected(c, g) for c, g in groups.items()), key=str)


SCHEMA = "conv_id long, turn long, role string, text string, note string, n long, code int"


def found(spark, rows, **how):
    table = spark.createDataFrame([(*r, "x", 9, 9) for r in rows], SCHEMA)
    return sorted((tuple(r) for r in cr.repair(table, **how).collect()), key=str)


def mixed():
    texts = ["All is well.", "cut", "", " \n", "Really?", "été là!", None, " .", "x" * 5000, "Wow! "]
    rows, roles = [], ["user", "assistant", "system", "tool", None, "", "user", "assistant"]
    for conv in [*range(60), None]:
        for turn in range((conv or 5) % 9 + 1):
            k = (conv or 3) * 31 + turn * 7
            rows.append((conv, None if k % 17 == 0 else turn * (1 + k % 2), roles[k % 8] if conv is None or conv % 3 else ("user", "assistant")[turn % 2], texts[k * k % 10]))
    return rows + rows[5:9]


@pytest.mark.parametrize("how", [{}, {"most_rows": 2}, {"most_bytes": 6}])
def test_repair_against_all_edits(spark, how):
    rows = mixed()
    assert found(spark, rows, **how) == brute(rows)


def test_one_conversation_over_many_ranges(spark):
    rows = [(7, t, ("user", "assistant", "user")[t * t % 3], f"text {t % 40}" + ".?x"[t % 3]) for t in range(400)] + [(8, 0, "user", "Yes.")]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert found(spark, rows, most_rows=16) == brute(rows)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_dropped_rows_and_an_empty_table(spark):
    turn = next(t for t in range(1000) if zlib.crc32(f"1:{t}".encode()) % 20 == 0)
    assert found(spark, [(1, turn, "user", "Yes.")]) == [(1, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())]
    assert found(spark, []) == []


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("suax"), st.sampled_from(["", "blank", "truncated"])), max_size=7))
def test_audits_are_the_least(rows):
    names = {"s": "system", "u": "user", "a": "assistant", "x": "tool"}
    said = [(i, names[r], f"{i}.") for i, (r, _) in enumerate(rows)]
    wrong, automaton = [w for _, w in rows], cr.Automaton()
    codes = bytes(4 * {"": 0, "truncated": 1, "blank": 2}[w] + "suax".index(r) for r, w in rows)
    cost, audit, lines = cheapest(said, wrong)
    kept = [s for s, w in zip(said, wrong, strict=True) if w != "blank"]
    for cut in {0, len(codes) // 2}:
        now, parts = cr.Repair(automaton), [codes[:cut], codes[cut:]]
        middle = automaton.scan(parts[1], automaton.number(cr.END))[0][0]
        n = sum(c < 8 for c in parts[0])
        for part, after, own in ((parts[0], middle, kept[:n]), (parts[1], automaton.number(cr.END), kept[n:])):
            now.add(cr.Chunk(part, [x[1] for x in own], [x[2] for x in own], None, None, 0), after)
        *_, own_cost, own_audit, digest = now.result()
        assert (own_cost, own_audit) == (cost, audit)
        assert digest == hashlib.sha256("\n".join(lines).encode()).hexdigest()


def test_all_short_conversations():
    """Every conversation of up to four rows: audits are the least of all strings of edits that cost as little."""
    automaton = cr.Automaton()
    for n in range(5):
        for rows in product("suax", repeat=n):
            codes = bytes("suax".index(r) for r in rows)
            now = cr.Repair(automaton)
            now.add(cr.Chunk(codes, ["r"] * n, ["t"] * n, None, None, 0), automaton.number(cr.END))
            *_, cost, audit, _ = now.result()
            assert (cost, audit) == every(rows)
    assert len(automaton.vectors) < 50


def every(rows, q="", k=0, limit=3):
    """The least cost and audit, trying all edits in turn."""
    best = [(0, "")] if k == len(rows) and GOOD.fullmatch(q) else []
    if limit:
        best += [(3 + c, "I" + a) for new in "ua" if re.fullmatch("s?(ua)*u?", q + new) for c, a in [every(rows, q + new, k, limit - 1)]]
    if k < len(rows):
        best += [(4 + c, "D" + a) for c, a in [every(rows, q, k + 1)]]
        for new, cost, letter in ((rows[k], 0, "K"), ("u", 3, "R"), ("a", 3, "R")):
            if re.fullmatch("s?(ua)*u?", q + new):
                best += [(cost + c, letter + a) for c, a in [every(rows, q + new, k + 1)]]
    return min(best, default=(10**6, ""))


def test_sql_against_all_edits():
    rows = mixed()
    con = duckdb.connect()
    con.execute("create table conversations (conv_id bigint, turn bigint, role varchar, text varchar)")
    con.executemany("insert into conversations values (?, ?, ?, ?)", rows)
    assert sorted((tuple(r) for r in con.sql(cr.oracle()).fetchall()), key=str) == brute(rows)
