"""Conversation repair against brute force over all edit scripts, and against a plain dynamic program on whole tables."""

import hashlib
import random
import re
import zlib
from collections import defaultdict
from itertools import product

import pytest

from reflexgrid.llm import turns as T

SPACE = "\x20\t\n\x0b\x0c\r"
LEGAL = re.compile(r"(s?(ua)+)?")


def plain(rows):
    """(counts, cost, audit, sha256) of sorted (turn, role, text) rows, by a program over all least scripts."""
    seen, faults = set(), []
    for _, role, text in rows:
        body = text.strip(SPACE)
        faults.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    n = len(rows)
    # best[x]: (cost, script, roles and texts) of the rest, by state as the text that the pattern still asks for
    machine = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "ua"}, "ua": {"u": "u"}}
    best = {x: None for x in machine}
    for x, script in (("", ""), ("ua", ""), ("u", "I"), ("s", "II")):
        best[x] = (3 * len(script), script, [("assistant", "")] if x == "u" else [("user", ""), ("assistant", "")] if x == "s" else [])

    def inserted(options):
        for _ in range(4):
            for x, role in (("", "user"), ("s", "user"), ("u", "assistant"), ("ua", "user")):
                c, script, out = options[machine[x][role[0]]]
                if (c + 3, "I" + script) < options[x][:2]:
                    options[x] = (c + 3, "I" + script, [(role, ""), *out])
        return options

    for i in range(n - 1, -1, -1):
        _, role, text = rows[i]
        now = {}
        for x in machine:
            c, script, out = best[x]
            options = [(c + 4, "D" + script, out)]
            if faults[i] not in ("blank", "duplicate"):
                cut = 3 * (faults[i] == "truncated")
                if role[:1] in machine[x]:
                    c, script, out = best[machine[x][role[:1]]]
                    options.append((c + cut, "K" + script, [(role, text), *out]))
                for new in ("user", "assistant"):
                    if new[0] in machine[x]:
                        c, script, out = best[machine[x][new[0]]]
                        options.append((c + 3 + cut, "R" + script, [(new, text), *out]))
            now[x] = min(options, key=lambda o: o[:2])
        best = inserted(now)
    cost, script, out = best[""]
    known = [t for t, _, _ in rows if t is not None]
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    text = "\n".join(f"{r}:{t}" for r, t in out)
    assert LEGAL.fullmatch("".join(r[0] for r, _ in out))
    return (gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, script, hashlib.sha256(text.encode()).hexdigest())


def broken(rows):
    """The prescribed damage, row by row, in the order of the operator."""
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        at = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if at == 0:
            continue
        text = "" if at == 1 else re.sub("[.!?]", "", text) if at == 2 else text
        role = "user" if at == 4 else role
        out[conv] += [(turn, role, text)] * (2 if at == 3 else 1)
    for part in out.values():
        part.sort(key=lambda r: (r[0] is not None, r[0], r[1], hashlib.md5(f"{len(r[1])}:{r[1]}:{r[2]}".encode()).digest()))
    return out


def got(spark, rows, **sizes):
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    return {r["conv_id"]: tuple(r)[1:] for r in T.audit(T.damaged(df), df, **sizes).collect()}


def test_least_scripts_by_enumeration():
    """All scripts of up to three rows, each with at most three insertions a gap."""
    kinds = ["s", "u", "a", "?", "S", "U", "A", "X"]  # capitals: truncated
    tables = T.tables()

    def scripts(rows):
        best = None

        def go(i, cost, script, text, room):
            nonlocal best
            if best is not None and cost > best[0]:
                return
            if i == len(rows) and LEGAL.fullmatch(text):
                best = min(best or (cost, script), (cost, script))
            if room:
                for c in "ua":
                    go(i, cost + 3, script + "I", text + c, room - 1)
            if i == len(rows):
                return
            go(i + 1, cost + 4, script + "D", text, 2)
            if rows[i] != "-":
                cut = 3 * (rows[i].isupper())
                go(i + 1, cost + cut, script + "K", text + ("?" if rows[i] in "?X" else rows[i].lower()), 2)
                for c in "ua":
                    go(i + 1, cost + 3 + cut, script + "R", text + c, 2)

        go(0, 0, "", "", 2)
        return best

    for n in range(4):
        for rows in product(kinds + ["-"], repeat=n):
            symbols = bytes(T.MUST_GO if c == "-" else "sua?".find(c.lower() if c != "X" else "?") + 4 * (c.isupper()) for c in rows)
            letters, _, state = tables.trace(symbols, tables.end, T.FREE)
            _, cost = tables.ends(symbols, tables.end)
            first = tables.ends(symbols, tables.end)[0][0]
            script = "".join(letters) + T.tail(state)
            assert (cost + tables.vectors[first][0], script) == scripts(rows), rows


def test_maps_equal_whole_traces():
    tables, rng = T.tables(), random.Random(3)
    for _ in range(200):
        symbols = bytes(rng.randrange(9) for _ in range(rng.randrange(1, 60)))
        cut = rng.randrange(len(symbols) + 1)
        left, right = symbols[:cut], symbols[cut:]
        middle = tables.through(right)[0][tables.end] if right else tables.end
        whole = tables.trace(symbols, tables.end, T.FREE)
        one = tables.trace(left, int(middle), T.FREE)
        two = tables.trace(right, tables.end, one[2])
        assert one[0] + two[0] == whole[0] and two[2] == whole[2]
    assert len(tables.vectors) < 200


def test_given_conversations(spark):
    import duckdb

    from reflexgrid.llm.queries import QUERIES

    folder = "/root/testdata/sf0.001"
    rows = duckdb.sql(f"select conv_id, turn, role, text from '{folder}/conversations.parquet'").fetchall()
    want = {c: plain(broken(rows).get(c, [])) for c in {r[0] for r in rows}}
    assert {r["conv_id"]: tuple(r)[1:] for r in QUERIES["op11_turn_repair"](spark, folder).collect()} == want
    assert got(spark, rows, chunk=3, fan=2) == want


def test_awkward_turns(spark):
    rng = random.Random(5)
    roles = ["user", "assistant", "system", "tool", "", None, "u"]
    said = ["Yes.", "No", "", " \n", None, "What?", "x" * 70_000 + ".", "\x1c", "é!\x85"]
    rows = [(c, rng.choice([None, *range(6), 9]), rng.choice(roles), rng.choice(said)) for c in [*range(25), None] for _ in range(rng.randrange(1, 9))]
    rows += [(77, 5, "user", "Again.")] * 40 + [(78, None, None, None)] * 3
    want = {c: plain(broken(rows).get(c, [])) for c in {r[0] for r in rows}}
    assert got(spark, rows) == want
    extra = "conv string, part int, k int, i int, digest string, letters string, n int, at string"
    clash = spark.createDataFrame([(*r, "x", 1, 2, 3, "d", "K", 9, "at") for r in rows], "conv_id bigint, turn bigint, role string, text string, " + extra)
    assert {r["conv_id"]: tuple(r)[1:] for r in T.audit(T.damaged(clash), clash).collect()} == want
    assert got(spark, []) == {}


def test_one_long_conversation(spark):
    """One conversation of many chunks: each task sees a few of its chunks, the result is that of the whole."""
    rng = random.Random(8)
    rows = [(1, t, rng.choice(["user", "assistant", "system"]), f"Line {rng.randrange(1500)}" + rng.choice(["", ".", "?"])) for t in range(2000)]
    assert got(spark, rows, chunk=50, fan=4) == {1: plain(broken(rows)[1])}
