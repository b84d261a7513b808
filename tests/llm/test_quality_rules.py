"""The ledger of quality rules: measurements by brute force, policies and ablations, odd rows."""

import random
import re

from pyspark.sql import functions as F

from tests.conftest import SF
from tidewater.llm import quality_rules as Q


def brute(t):
    t = t or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in (i, i + 1, i + 2)}
    return {
        "n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": len(re.findall("[#*$%&|<>]", t)), "n_dup_lines": sum(x in lines[:i] for i, x in enumerate(lines)),
        "n_repeat_words": len(covered), "n_lines": len(lines), "n_marks": len(re.findall("[!?]", t)), "n_letters": len(re.findall("[A-Za-z]", t)), "n_capitals": len(re.findall("[A-Z]", t)),
    }


def test_measurements_of_random_texts():
    rng = random.Random(4)
    for _ in range(3000):
        t = "".join(rng.choice(["a", "B", "é", "😀", " ", " ", "\n", "\t", "\r", "\x1c", " ", "#", "!", "|"]) for _ in range(rng.randrange(60)))
        assert dict(zip(Q.MEASURES, Q.measure(t.encode()), strict=True)) == brute(t), repr(t)


def test_odd_rows(spark):
    texts = [None, "", " \n\t", "a", "a b c", "a a a a", "x" * 200_000, "word here now " * 40_000, "é" * 60 + " ok" * 49, "l\n" * 60, "same\n" * 3, "same\n" * 3]
    rows = spark.createDataFrame([(None if i == 3 else i, t, "s", 7, 0) for i, t in enumerate(texts)], "doc_id long, text string, source string, n_words int, failed int")
    got = Q.build_ledger(rows, keep=("doc_id", "source")).collect()
    assert len(got) == len(texts) and all(r["source"] == "s" for r in got)
    by_key = {r["doc_id"]: r for r in got}
    for i, t in enumerate(texts):
        if i not in (7,):  # brute force is quadratic
            r, want = by_key[None if i == 3 else i], brute(t)
            assert {m: r[m] for m in Q.MEASURES} == want
            assert bool(r["failed"] & 1) == (want["n_words"] < 50)
    assert by_key[7]["n_words"] == by_key[7]["n_repeat_words"] == 120_000
    assert Q.build_ledger(rows.limit(0)).count() == 0


def test_policies_and_ablations(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    ledger = Q.build_ledger(docs, keep=("doc_id", "lang")).cache()
    rows = ledger.collect()
    kept = {r["doc_id"]: r for r in Q.apply_policies(ledger).collect()}
    lenient = Q.Policy("lenient", tuple(r.name for r in Q.RULES), allowed=1)
    for p in (*Q.POLICIES, lenient):
        names = {r.name: 1 << r.bit for r in Q.RULES}
        fails = lambda r, without=None, p=p: sum(bool(r["failed"] & names[n]) for n in p.rules if n != without)
        if p is not lenient:
            assert all(kept[r["doc_id"]][f"kept_{p.version}"] == (fails(r) == 0) for r in rows)
        for a in Q.ablations(ledger, [p]).collect():
            assert a["n_kept"] == sum(fails(r) <= p.allowed for r in rows)
            assert a["n_kept_without"] == sum(fails(r, a["rule"]) <= p.allowed for r in rows)
            assert a["n_failed"] == sum(bool(r["failed"] & names[a["rule"]]) for r in rows)
    for g in Q.profile(ledger, ["lang"]).collect():
        own = [r["failed"] for r in rows if r["lang"] == g["lang"]]
        every, some = ~0, 0
        for f in own:
            every, some = every & f, some | f
        assert (g["n"], g["any_failed"], g["all_failed"]) == (len(own), some, every)
        assert g["n_few_words"] == sum(f & 1 for f in own)


def test_changed_limits_need_no_texts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    strict = [Q.Rule("few_words", 0, "n_words < 200")]
    changed = Q.reevaluated(Q.build_ledger(docs), strict)
    rules = [strict[0], *Q.RULES[1:]]
    assert sorted(map(tuple, changed.select("doc_id", "failed").collect())) == sorted(map(tuple, Q.build_ledger(docs, rules=rules).select("doc_id", "failed").collect()))


def test_good_documents_are_kept_and_bad_ones_go(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    known = Q.verdicts(Q.build_ledger(docs)).join(labels, "doc_id").where("n_words >= 50")
    n = {(r["quality"], r["kept"]): r["n"] for r in known.groupBy("quality", "kept").agg(F.count("*").alias("n")).collect()}
    assert not n.get((1, False)) and not n.get((0, True)), n
