"""Conversation repair: every cheapest edit by enumeration, shared layers, and odd tables."""

import hashlib
import itertools
import random
import re
import zlib
from functools import cache

from tidewater.llm import conversation_repair as R


def symbol(role, fault):
    return chr(48 + 4 * R.ROLES.index(role) + fault)


@cache
def legal(roles):
    return re.fullmatch("(s?(ua)+)?", roles) is not None


def brute(rows):
    """rows of (role, fault): the least (cost, audit) over all edits with up to two inserts at a place."""
    inserts = [x for n in range(3) for x in itertools.product("ua", repeat=n)]
    best = None
    edits = [[("D", "", 4)] if f in (1, 2) else [("D", "", 4), ("K", "" if r == "e" else r, 3 * (f == 3)), *(("R", x, 3 + 3 * (f == 3)) for x in "ua")] for r, f in rows]
    for chosen in itertools.product(*edits):
        for put in itertools.product(inserts, repeat=len(rows) + 1):
            cost = sum(e[2] for e in chosen) + 3 * sum(map(len, put))
            if best is not None and cost > best[0]:
                continue
            roles = "".join("".join(p) + (e[1] if e else "") for p, e in itertools.zip_longest(put, chosen))
            if legal(roles):
                audit = "".join("I" * len(p) + (e[0] if e else "") for p, e in itertools.zip_longest(put, chosen))
                best = min(best or (cost, audit), (cost, audit))
    return best


def test_cheapest_edits_of_all_short_signatures():
    trie, rows = R.Trie(), list(itertools.product(R.ROLES, range(4)))
    for n in range(3):
        for found in itertools.product(rows, repeat=n):
            assert trie.answer("".join(symbol(*x) for x in found)) == brute(found), found
    rng = random.Random(1)
    for _ in range(25):
        found = tuple(rng.choice(rows) for _ in range(3))
        assert trie.answer("".join(symbol(*x) for x in found)) == brute(found), found


def test_answers_do_not_depend_on_what_is_shared():
    rng = random.Random(2)
    found = sorted({"".join(symbol(rng.choice("sua"), rng.choice((0, 0, 0, 1, 2, 3))) for _ in range(rng.randrange(12))) for _ in range(800)})
    shared = R.Trie()
    assert [shared.answer(x) for x in found] == [R.Trie().answer(x) for x in found]
    prefixes = {x[:k] for x in found for k in range(1, len(x) + 1)}
    assert shared.computed == len(prefixes)  # one layer for each node of the trie


SCHEMA = "conv_id long, turn long, role string, text string, audit string"


def damage(conv, turn, role, text):
    role, text = (" " if x is None else x for x in (role, text))
    how = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
    if how == 1:
        text = ""
    if how == 2:
        text = re.sub("[.!?]", "", text)
    if how == 4:
        role = "user"
    return [(conv, turn, role, text)] * {0: 0, 3: 2}.get(how, 1)


def expected(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        digest = lambda r: hashlib.sha256(f"{len(r[2])}:{r[2]}:{r[3]}".encode()).digest()
        mine = sorted((d for r in rows if r[0] == conv for d in damage(*r[:4])), key=lambda r: (r[1] is not None, r[1] or 0, r[2], digest(r)))
        faults, seen = [], set()
        for r in mine:
            last = re.sub(r"[\x20\x09-\x0D]+\Z", "", r[3])[-1:]
            faults.append(1 if not last else 2 if r[2:] in seen else 3 if last not in ".!?" else 0)
            seen.add(r[2:])
        initials = [r[2][:1] for r in mine]
        turns = {r[1] for r in mine} - {None}
        cost, audit = R.Trie().answer("".join(symbol("e" if not i else i if i in "sua" else "o", f) for i, f in zip(initials, faults)))
        lines, state, left = [], "", list(mine)
        for e in audit:
            r = left.pop(0) if e != "I" else None
            if e == "D":
                continue
            if e != "K":
                r = (0, 0, "assistant" if state.endswith("u") else "user", r[3] if r else "")
            state += r[2][:1]
            lines.append(f"{r[2]}:{r[3]}")
        assert legal(state)
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, faults.count(1), faults.count(2), faults.count(3), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def check(spark, rows, **how):
    df = spark.createDataFrame(rows, SCHEMA)
    got = R.repair(df.repartition(how.get("parts", 3))).collect()
    assert {r["conv_id"]: tuple(r)[1:] for r in got} == expected(rows)
    assert len(got) == len({r[0] for r in rows})


def test_odd_rows(spark):
    rng = random.Random(6)
    texts = [None, "", " \t", "A.", "A. ", "no end", "x" * 50_000 + "!", "é?", "."]
    rows = [(rng.choice([None, *range(40)]), rng.choice([None, *range(12)]), rng.choice([None, "", "system", "user", "assistant", "tool", "User"]), rng.choice(texts), "other") for _ in range(700)]
    rows += rows[:60]  # repeated rows
    rows += [(100 + i, None, "user", "Hm.", None) for i in range(20)]  # no turn at all
    rows += [(200 + i, 3, "user", "Hm.", None) for i in range(40)]  # some lose their only row
    check(spark, rows)
    assert R.repair(spark.createDataFrame([], SCHEMA)).collect() == []


def test_one_conversation_over_many_tasks(spark):
    rng = random.Random(7)
    rows = [(5, i // 3, rng.choice(["user", "assistant"]), rng.choice(["Same.", "Same.", f"Text {i}.", f"Cut {i}"]), None) for i in range(3000)]
    rows += [(i % 50, i, "user", "Same.", None) for i in range(500)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        signed = R.signed(R.damaged(spark.createDataFrame(rows, SCHEMA)))
        assert signed.repartitionByRange("cn", "c", "turn").rdd.getNumPartitions() > 1
        check(spark, rows)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_batches_of_one_row(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")
    try:
        check(spark, [(i % 4, i // 4, ("user", "assistant")[i % 2], f"T {i % 7}.", None) for i in range(60)])
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
