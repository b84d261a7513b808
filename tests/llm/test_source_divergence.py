"""Source divergence: tries against counters, the audit by brute force in whole numbers, odd tables."""

import random
import re
from collections import Counter

from tidewater.llm import source_divergence as S

SCHEMA = "doc_id long, text string, lang string, source string, n long, value string, item int"
TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def brute(rows):
    docs = [(r[2] or "", r[3] or "", TERM.findall(re.sub("[A-Z]", lambda m: m.group().lower(), r[1] or ""))) for r in rows]
    out = []
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        df = Counter(t for d in mine for t in set(d[2]))
        kept = [t for t in df if df[t] >= 10]
        sources = {d[1] for d in mine}
        n = {s: Counter(t for d in mine if d[1] == s for t in d[2]) for s in sources}
        whole = Counter(t for d in mine for t in d[2])

        def p(count, kept=kept):
            total = sum(count[t] for t in kept)
            return {t: 1 + 10**9 * (count[t] + 2) // (total + 2 * len(kept)) for t in kept}

        q, of = p(whole), {s: p(n[s]) for s in sources}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = sorted(((-sum(f(of[s][t], of[o][t]) for t in kept), o.encode()) for o in sources - {s}))
            terms = sorted((-f(of[s][t], q[t]), t.encode()) for t in kept if n[s][t] and of[s][t] > q[t])[:10]
            out += [(lang, s, part, item.decode(), -v, i + 1) for part, found in (("pair", pairs), ("term", terms)) for i, (v, item) in enumerate(found)]
    return sorted(out)


def test_tries_count_and_merge():
    rng = random.Random(3)
    words = ["".join(rng.choice("abé") for _ in range(rng.randrange(1, 7))).encode() for _ in range(4000)]
    one, two, want = S.RadixTrie(), S.RadixTrie(), Counter()
    for i, w in enumerate(words):
        (one if i % 3 else two).add(w, 1, {i % 5: 2})
        want[w, i % 5] += 1
    one.merge(two)
    got = list(one.leaves())
    assert [t for t, _ in got] == sorted({w for w, _ in want})
    assert {(t, k): n for t, (_, own) in got for k, n in own.items()} == {k: 2 * n for k, n in want.items()}
    assert {t: d for t, (d, _) in got} == Counter(words)
    assert one.size == len(want)


def test_shares_are_exact():
    rng = random.Random(5)
    for _ in range(2000):
        total = rng.randrange(1, 10 ** rng.randrange(1, 15))
        n = rng.randrange(0, total + 1)
        assert int(S.shares(S.np.array([n]), S.np.array([total + 4]))[0]) == 1 + 10**9 * (n + 2) // (total + 4)


def table(rng, n, langs, sources):
    words = [w for w in ("the The THE of é É ñandú 数据 a-b x1y o'clock \x00z _w ß İ K").split()] + [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)]
    return [(i, " ".join(rng.choice(words[: rng.randrange(3, len(words))]) for _ in range(rng.randrange(25))), rng.choice(langs), rng.choice(sources), i, "v", 1) for i in range(n)]


def got(spark, rows, block=S.SOURCES):
    return sorted(map(tuple, S.audit(spark.createDataFrame(rows, SCHEMA).repartition(4), block).collect()))


def test_audit_with_odd_rows(spark):
    rng = random.Random(8)
    rows = table(rng, 500, ["en", None, "", "fr"], ["a", None, "", "b", "é", "Z", "数"])
    rows += [(None, t, "rare", s, 0, None, None) for t, s in ((None, "a"), ("", "b"), ("alone", "c"))]
    rows += [(7, "same words again", "copies", s, 0, None, None) for s in "aab" for _ in range(6)]
    rows += [(9, "one source", "lone", "a", 0, None, None)] * 12
    rows += [(10, "long text " * 300_000, "en", "a", 0, None, None)]
    want = brute(rows)
    assert got(spark, rows) == want
    assert {"", "rare", "copies"} <= {r[0] for r in want} and "lone" not in {r[0] for r in want}
    assert S.audit(spark.createDataFrame([], SCHEMA)).collect() == []


def test_blocks_of_sources_and_small_tries_change_nothing(spark, monkeypatch):
    rng = random.Random(9)
    rows = table(rng, 400, ["en", "de"], [f"s{i}" for i in range(11)])
    want = brute(rows)
    assert got(spark, rows, 3) == want == got(spark, rows, 1)
    counts = S.Counts()
    for r in rows:
        counts.document(r[2], r[3], r[1].encode())
    assert counts.held() == 0 < counts.waiting()
    counts.into_tries()
    assert counts.waiting() == 0 < counts.held()
    assert sum(b.num_rows for b in counts.hand_on()) > 0 == counts.held()
