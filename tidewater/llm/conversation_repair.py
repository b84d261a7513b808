"""Repair of conversations: the cheapest edits that make turns alternate, by DP over a shared trie.

A row's fault is the first of blank, duplicate (role and text seen earlier in its conversation) and
truncated. Rows are kept (0), given another role (3) or deleted (4; blank and duplicate rows must be);
empty rows may be inserted anywhere (3); every truncated row that is not deleted costs 3 more. The role
initials that remain must read ``(s?(ua)+)?``; among the cheapest edits those with the ASCII-least
string of initials (D, I, K, R) win.

Edits depend on roles and faults alone. Each conversation becomes a signature, one character a row, and
distinct signatures are range-sorted, so that each task walks its range as a prefix trie: layers of the
DP stay on a stack as deep as the common prefix, each layer is computed once for all signatures that
share it, and answers come out at the terminal nodes. A layer holds, for each state of the role
pattern, cost and rank of the best edits so far; relative to its least cost there are only a few, so a
step is a lookup after its first use.

Scale. Rows travel without texts (32 bytes of digest) until the last step. Rows of one conversation are
sorted over many tasks by range, so a conversation that holds a third of all rows is no task's burden;
its signature and its audit take a byte a row, as the result itself does. Only SHA-256, which reads a
conversation's repaired text in order by its nature, streams a conversation through one task, batch by
batch, holding none of it.

Defined cases. Null conv_ids are one conversation. Null turns come first; rows of one turn follow by
role, then by digest of role and text. Null roles and texts count as one space. An empty role has no
initial: it may be kept anywhere, and a pair with it is illegal. Any other initial than s, u, a cannot
be kept. Equal rows are duplicates of one another. A conversation without rows after damage has zeros,
an empty audit and the hash of the empty string; an empty table gives no rows. Further columns, of
whatever names, are ignored.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.llm import common as C

#: Costs of edits, and what a truncated row costs if it stays.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: A symbol is chr(48 + 4 * role + fault): roles by initial, o another and e none.
ROLES, FAULTS = "suaoe", ("fine", "blank", "duplicate", "truncated")
_STEPS = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
#: What may be put at each state of the pattern besides rows as they are, and the state after it.
_NEXT = {0: ("u", 2), 1: ("u", 2), 2: ("a", 3), 3: ("u", 2)}
_LEGAL = ("su", "ua", "au")


def _text(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(" "))


def _conversation() -> list[Column]:
    """The conversation as two columns that are never null."""
    return [F.col("conv_id").isNull().alias("cn"), F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("c")]


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role and text of the rows after damage, which crc32 of ``conv_id:turn`` decides."""
    key = F.concat(_text(F.col("conv_id").cast("string")), F.lit(":"), _text(F.col("turn").cast("string")))
    how = F.crc32(key) % 20
    out = rows.select("conv_id", "turn", _text(F.col("role").cast("string")).alias("role"), _text(F.col("text").cast("string")).alias("text"), how.alias("how")).where("how <> 0")
    text = F.when(F.col("how") == 1, "").when(F.col("how") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("how") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.when(F.col("how") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return out.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("__copy")).drop("__copy")


def _digest() -> Column:
    return F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.lit(":"), F.col("text")), 256))


def signed(rows: DataFrame) -> DataFrame:
    """Rows without texts: conversation, place (turn, role, digest), how many equal rows stand there, and their symbols.

    Equal rows of one turn are one row with a count before anything is sorted. The first of a role and text
    is found by an aggregate that combines before its shuffle, so common texts gather nowhere.
    """
    rows = rows.select(*_conversation(), F.col("turn").cast("long").alias("turn"), "role", "text")
    initial = F.substring("role", 1, 1)
    kind = F.when(initial == "", 4).when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    cut = ~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
    light = rows.select("cn", "c", "turn", "role", _digest().alias("d"), kind.alias("kind"), F.when(blank, 1).when(cut, 3).otherwise(0).alias("fault"))
    runs = light.groupBy("cn", "c", "turn", "role", "d", "kind", "fault").agg(F.count("*").alias("n"))
    place = F.struct(F.col("turn").isNotNull(), "turn")
    firsts = runs.groupBy("cn", "c", F.col("d")).agg(F.min(place).alias("first"))
    met = runs.join(firsts, ["cn", "c", "d"])
    symbol = lambda fault: F.char(48 + 4 * F.col("kind") + fault)
    own = symbol(F.when((F.col("fault") != 1) & (F.col("first") < place), 2).otherwise(F.col("fault")))
    rest = symbol(F.when(F.col("fault") == 1, 1).otherwise(2))
    return met.select("cn", "c", "turn", "role", "d", "n", own.alias("own"), rest.alias("rest"))


def signatures(symbols: DataFrame) -> DataFrame:
    """(cn, c, signature) of each conversation: rows are sorted over all tasks by place, each task strings
    together its part of a conversation, and the parts, one a task at most, are joined in order."""
    part = symbols.select("cn", "c", F.col("turn").isNotNull().alias("tn"), "turn", "role", "d", F.concat("own", F.expr("repeat(rest, cast(n - 1 as int))")).alias("s"))
    keys = ["cn", "c", "tn", "turn", "role", "d"]
    ordered = part.repartitionByRange(*keys).sortWithinPartitions(*keys).select("cn", "c", "tn", "turn", "role", "d", "s")

    def run(batches):
        key, start, found = None, None, []
        for b in batches:
            done = []
            for cn, c, tn, turn, role, d, s in zip(*(x.to_pylist() for x in b.columns), strict=True):
                if (cn, c) != key:
                    if found:
                        done.append((*key, *start, "".join(found)))
                    key, start, found = (cn, c), (tn, turn, role, d), []
                found.append(s)
            yield _records(done, _PART)
        if found:
            yield _records([(*key, *start, "".join(found))], _PART)

    parts = ordered.mapInArrow(run, "cn boolean, c string, tn boolean, turn bigint, role string, d binary, s string")
    whole = F.array_sort(F.collect_list(F.struct("tn", "turn", "role", "d", "s")))
    return parts.groupBy("cn", "c").agg(F.concat_ws("", F.transform(whole, lambda x: x["s"])).alias("signature"))


_PART = pa.schema([("cn", pa.bool_()), ("c", pa.string()), ("tn", pa.bool_()), ("turn", pa.int64()), ("role", pa.string()), ("d", pa.binary()), ("s", pa.string())])
_ANSWER = pa.schema([("signature", pa.string()), *((c, pa.int64()) for c in ("blank", "duplicate", "truncated", "illegal", "cost")), ("audit", pa.string())])
_HASH = pa.schema([("cn", pa.bool_()), ("c", pa.string()), ("repaired_sha256", pa.string())])


def _records(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(columns, schema, strict=True)], schema=schema)


class Trie:
    """Layers of the DP along the current path of the trie, and the answers at its end.

    A layer is a tuple by state of (cost above the least, rank) or None. Ranks order the states' best
    edit strings; none of these is a prefix of another, since all have as many D, K and R, and end in one.
    """

    START = ((0, 0), None, None, None)

    def __init__(self) -> None:
        self.path = ""
        self.layers: list[tuple] = [self.START]
        self.costs = [0]
        self.back: list[tuple] = []
        self.steps: dict[tuple, tuple] = {}
        self.computed = 0

    def step(self, layer: tuple, symbol: str) -> tuple:
        """The layer after one more row, the least cost that it adds, and (state before, edits) by state."""
        code = ord(symbol) - 48
        role, fault = ROLES[code // 4], code % 4
        best: dict[int, tuple] = {}

        def offer(state: int, cost: int, rank: int, edits: str, came: int) -> None:
            if state not in best or (cost, rank, edits) < best[state][:3]:
                best[state] = (cost, rank, edits, came)

        for came, entry in enumerate(layer):
            if entry is None:
                continue
            cost, rank = entry
            state = came
            for k in range(3):
                spent, made = cost + k * INSERT, "I" * k
                offer(state, spent + DELETE, rank, made + "D", came)
                if fault not in (1, 2):
                    stays = spent + (TRUNCATED if fault == 3 else 0)
                    if role == "e" or (state, role) in _STEPS:
                        offer(state if role == "e" else _STEPS[state, role], stays, rank, made + "K", came)
                    offer(_NEXT[state][1], stays + REROLE, rank, made + "R", came)
                state = _NEXT[state][1]
        least = min(b[0] for b in best.values())
        order = {s: i for i, s in enumerate(sorted(best, key=lambda s: best[s][1:3]))}
        after = tuple((best[s][0] - least, order[s]) if s in best else None for s in range(4))
        return after, least, tuple((best[s][3], best[s][2]) if s in best else None for s in range(4))

    def answer(self, signature: str) -> tuple[int, str]:
        """The least cost and the audit of a signature; fast if it shares a long prefix with the one before."""
        shared, most = 0, min(len(self.path), len(signature))
        if self.path[:most] == signature[:most]:
            shared = most
        else:
            low, high = 0, most  # the longest common prefix, by halves
            while high - low > 1:
                mid = (low + high) // 2
                low, high = (mid, high) if self.path[:mid] == signature[:mid] else (low, mid)
            shared = low
        del self.layers[shared + 1 :], self.costs[shared + 1 :], self.back[shared:]
        for symbol in signature[shared:]:
            key = (self.layers[-1], symbol)
            if key not in self.steps:
                self.steps[key] = self.step(*key)
            after, least, back = self.steps[key]
            self.layers.append(after)
            self.costs.append(self.costs[-1] + least)
            self.back.append(back)
            self.computed += 1
        self.path = signature
        ends = []
        for state, entry in enumerate(self.layers[-1]):
            if entry is not None:
                k = {0: 0, 1: 2, 2: 1, 3: 0}[state]
                ends.append((entry[0] + k * INSERT, entry[1], "I" * k, state))
        cost, _, tail, state = min(ends)
        made = [tail]
        for back in reversed(self.back):
            state, edits = back[state]
            made.append(edits)
        return self.costs[-1] + cost, "".join(reversed(made))


def counts_of(signature: str) -> tuple[int, int, int, int]:
    """Rows that are blank, duplicate and truncated, and illegal pairs."""
    codes = [ord(x) - 48 for x in signature]
    faults = [c % 4 for c in codes]
    roles = [ROLES[c // 4] for c in codes]
    return faults.count(1), faults.count(2), faults.count(3), sum(a + b not in _LEGAL for a, b in zip(roles, roles[1:], strict=False))


def answers(distinct: DataFrame) -> DataFrame:
    """What each distinct signature gives, by tries over ranges of sorted signatures."""
    ordered = distinct.repartitionByRange("signature").sortWithinPartitions("signature")

    def run(batches):
        trie = Trie()
        for b in batches:
            rows = [(s, *counts_of(s), *trie.answer(s)) for s in b.column(0).to_pylist()]
            yield _records(rows, _ANSWER)

    return ordered.mapInArrow(run, "signature string, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string")


def repaired_hashes(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """(cn, c, repaired_sha256): the edits of each conversation's audit applied to its rows, streamed in order.

    A conversation's audit comes first in its rows; what is held is the audit, a place in it and the
    state of the hash.
    """
    body = rows.select(*_conversation(), F.lit(1).alias("kind"), F.col("turn").cast("long").alias("turn"), "role", _digest().alias("d"), "text")
    head = audits.select("cn", "c", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.lit(None).cast("binary").alias("d"), F.col("audit").alias("text"))
    stream = body.union(head).repartition("cn", "c").sortWithinPartitions("cn", "c", "kind", "turn", "role", "d").select("cn", "c", "kind", "role", "text")

    def run(batches):
        now = None
        for b in batches:
            done = []
            for cn, c, kind, role, text in zip(*(x.to_pylist() for x in b.columns), strict=True):
                if kind == 0:
                    if now is not None:
                        done.append(now.end())
                    now = Replay((cn, c), text)
                else:
                    now.row(role, text)
            yield _records(done, _HASH)
        if now is not None:
            yield _records([now.end()], _HASH)

    return stream.mapInArrow(run, "cn boolean, c string, repaired_sha256 string")


class Replay:
    """Applies an audit to rows as they come and hashes what stays."""

    def __init__(self, key: tuple, audit: str) -> None:
        self.key, self.audit, self.at, self.state, self.any = key, audit, 0, 0, False
        self.hash = hashlib.sha256()

    def put(self, role: str, text: str) -> None:
        self.hash.update((("\n" if self.any else "") + f"{role}:{text}").encode("utf-8", "replace"))
        self.any = True

    def insert(self) -> None:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.put(*self.next(), "")
            self.at += 1

    def next(self) -> tuple[str]:
        initial, self.state = _NEXT[self.state]
        return ("user" if initial == "u" else "assistant",)

    def row(self, role: str, text: str) -> None:
        self.insert()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            self.put(role, text)
            self.state = _STEPS[self.state, role[0]] if role else self.state
        elif edit == "R":
            self.put(*self.next(), text)

    def end(self) -> tuple:
        self.insert()
        return *self.key, self.hash.hexdigest()


def gaps(rows: DataFrame) -> DataFrame:
    """(cn, c, gaps): turns missing between a conversation's first and last; distinct turns first, so that no task counts a conversation alone."""
    turns = rows.select(*_conversation(), F.col("turn").cast("long").alias("turn")).distinct()
    return turns.groupBy("cn", "c").agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("long").alias("gaps"))


def repair(conversations: DataFrame, after: DataFrame | None = None) -> DataFrame:
    """One row for every conv_id of the input: gaps, faults, illegal pairs, cost, audit and repaired_sha256.

    ``after`` are the rows to repair; the damaged rows of the input if not given.
    """
    rows = damaged(conversations) if after is None else after
    signed_rows = C.materialize(signed(rows), "conversations")
    own = C.materialize(signatures(signed_rows), "signatures")
    found = C.materialize(answers(own.select("signature").distinct()), "audits")
    # a signature that very many conversations share is one row of the small side; AQE splits the other
    with_answer = C.materialize(own.join(found, "signature").drop("signature"), "answers")
    hashes = repaired_hashes(rows, with_answer.select("cn", "c", "audit"))
    ids = conversations.select("conv_id").distinct().select("conv_id", *_conversation())
    out = ids.join(with_answer, ["cn", "c"], "left").join(gaps(rows), ["cn", "c"], "left").join(hashes, ["cn", "c"], "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    return out.select("conv_id", *map(zero, ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))
