"""Every operator: brute force on small tables, and nulls, empty and long texts, ties, repeats, odd columns."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF
from tidewater.llm import ann, decontaminate, jaccard_join, language_id, line_dedup, packing, pii, sharding, token_counts, toxicity
from tidewater.llm.components import connected_components
from tidewater.llm.queries import QUERIES

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, *texts):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}


# ---- 1 personal data ------------------------------------------------------------------------


def brute_spans(s):
    patterns = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")
    out = []
    for k, p in enumerate(patterns):
        for m in re.finditer(p, s):
            d = re.sub("[^0-9]", "", m.group())
            ok = (True, all(int(x) <= 255 for x in m.group().split(".")) if k == 1 else True, 13 <= len(d) <= 19 and pii._luhn(d), 9 <= len(d) <= 15)[k]
            if ok:
                out.append((k, *m.span()))
    return out


def test_base_spans_are_the_patterns():
    rng = np.random.default_rng(3)
    alphabet = np.array(list("ab1.@+- 9()é%_"))
    for _ in range(20_000):
        s = "".join(rng.choice(alphabet, rng.integers(0, 40)))
        assert pii.base_spans(s) == brute_spans(s), s
    assert pii.base_spans("+1 (415) 555-2671 4111 1111 1111 1111 010.2.3.255 1.2.3.256") == brute_spans("+1 (415) 555-2671 4111 1111 1111 1111 010.2.3.255 1.2.3.256")


def test_base_spans_are_linear():
    for s in ("a" * 300_000 + "@", "1" * 300_000, "1." * 150_000, "a@" * 100_000, "+1" + " (" * 100_000):
        pii.base_spans(s)


@pytest.fixture(scope="module")
def tagger():
    return pii.train()


def test_network_learns_and_adds(tagger):
    hit = wrong = missed = 0
    for text, spans in pii.training_lines(200, seed=77):
        x = np.zeros((pii.WINDOW, 1), np.int64)
        x[: len(text), 0] = pii.encode(text)
        got = set(pii.reconcile(len(text), [0], [pii.decode(tagger, x)[:, 0]]))
        hit, wrong, missed = hit + len(got & set(spans)), wrong + len(got - set(spans)), missed + len(set(spans) - got)
    assert hit / (hit + wrong) > 0.8 and hit / (hit + missed) > 0.75
    t = "filler " * 40 + "write to bob.smith at example dot com today, filler " + "filler " * 40
    (span,) = pii.added_spans(tagger, [t], [pii.base_spans(t)])[0]
    assert t[span[1] : span[2]] == "bob.smith at example dot com"


@pytest.mark.parametrize("address", ["bob at example [dot] com", "bob at example (dot) com", "bob@example dot com", "bob @ example.com", "bob [at] example.com"])
def test_every_form_of_address_is_decoded(tagger, address):
    t = "filler " * 40 + f"write to {address} today, " + "filler " * 40
    (span,) = pii.added_spans(tagger, [t], [pii.base_spans(t)])[0]
    assert span[0] == 0 and address in t[span[1] : span[2]]


def test_windows_left_out_change_nothing(tagger, monkeypatch):
    lines = pii.training_lines(400, seed=78)
    prose = " ".join(lines_of(4, 30, 9)).replace("v", "at the dotted house, ").split("0")
    texts = ["", "x" * 500, "(at)" * 90, "9 " * 200, *(" ".join([*prose[k : k + 3], lines[k][0], *prose[k + 3 : k + 5], lines[-k - 1][0]]) for k in range(100))]
    base = [pii.base_spans(t) for t in texts]
    got = pii.added_spans(tagger, texts, base)
    monkeypatch.setattr(pii, "windows_of", lambda t: set(range(-(-len(t) // pii.STRIDE))))
    assert got == pii.added_spans(tagger, texts, base) and sum(map(len, got)) > 50


def test_accuracy_of_find_pii(spark, tagger):
    lines = pii.training_lines(400, seed=79)
    docs = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(lines)], "doc_id long, text string")
    got = {(r["doc_id"], pii.KINDS.index(s["kind"]), s["start"], s["end"]) for r in pii.find_pii(docs, model=tagger).collect() for s in r["spans"]}
    want = {(k, *s) for k, (_, spans) in enumerate(lines) for s in spans}
    print(len(got & want) / len(got), len(got & want) / len(want))
    assert len(got & want) / len(got) > 0.85 and len(got & want) / len(want) > 0.85


def test_spans_in_text_that_no_template_made(spark, docs, texts, tmp_path):
    """Forms written by hand, in prose of the table: exact spans, found through find_pii."""
    model = pii.model_for(docs)
    assert pii.model_for(docs) is model  # trained once
    pii.save(spark, model, str(tmp_path / "weights"))
    kept = pii.load(spark, str(tmp_path / "weights"))
    assert all((kept[k] == a).all() for k, a in model.items())
    forms = {
        "email": ["jane_doe (at) example (dot) org", "paul.smith[at]mail[dot]net", "info at shop dot com", "anna@firma dot de", "lee99 AT corp DOT io", "sales [at] acme [dot] com", "mia.k @ post.org"],
        "phone": ["212-555-0187", "(030) 555-0123", "650.555.0199", "1-800-555-0147", "415 555 2671", "(212)555-0166", "0049 301 5550"],
        "card": ["4111/1111/1111/1111", "4465758382889437 4465758382889437"],
    }
    prose = [t for t in texts.values() if t and 300 < len(t) < 4000 and not pii.base_spans(t)]
    rng, rows, want = np.random.default_rng(5), [], set()
    for kind, own in forms.items():
        for f in own:
            for _ in range(12):
                words = prose[len(rows) % len(prose)].split()
                at = int(rng.integers(1, len(words)))
                lead = " ".join(words[:at]) + " "
                places = [(0, 16), (17, 33)] if f.count(" ") == 1 and kind == "card" else [(0, len(f))]
                want |= {(len(rows), kind, len(lead) + a, len(lead) + e) for a, e in places}
                rows.append((len(rows), lead + f + " " + " ".join(words[at:])))
    found = pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string"), model=model).collect()
    got = {(r["doc_id"], s["kind"], s["start"], s["end"]) for r in found for s in r["spans"]}
    assert len(got & want) / len(got) > 0.85 and len(got & want) / len(want) > 0.8


def test_many_spans_take_linear_time(tagger):
    import time

    took = []
    for n in (20_000, 100_000):
        t = "write a.b@c.org or 10.0.0.1, " * (n // 2)
        began = time.perf_counter()
        base = pii.base_spans(t)
        assert len(base) == n and pii.added_spans(tagger, [t], [base]) == [[]]
        took.append(time.perf_counter() - began)
    assert took[1] < 15 * took[0] + 1


def test_gradient_of_the_crf():
    rng = np.random.default_rng(1)
    p = pii.init()
    x, y = rng.integers(1, 90, (7, 3)), np.zeros((7, 3), np.int64)
    y[2, 0], y[3, 0], x[5:, 1] = 1, 2, 0
    _, g = pii._loss_grad({k: v.astype(np.float64) for k, v in p.items()}, x, y)
    for name in ("hf", "o", "t", "hb"):
        for _ in range(3):
            at = tuple(rng.integers(0, s) for s in p[name].shape)
            if name == "t" and not pii._allowed()[at]:
                continue
            e = 1e-3
            up, down = ({k: v.astype(np.float64).copy() for k, v in p.items()} for _ in range(2))
            up[name][at] += e
            down[name][at] -= e
            assert g[name][at] == pytest.approx((pii._loss_grad(up, x, y)[0] - pii._loss_grad(down, x, y)[0]) / (2 * e), rel=0.08, abs=2e-3)


def test_the_model_does_not_depend_on_order_or_copies(spark, docs, monkeypatch):
    words = pii.sample_words(docs)
    assert len(words) == len(set(words)) > 500
    d = docs.select("doc_id", "text")
    hot = spark.range(400).selectExpr("id as doc_id").crossJoin(d.limit(1).select("text"))
    assert words == pii.sample_words(d.orderBy(F.desc("doc_id")).repartition(7)) == pii.sample_words(d.union(hot).union(d))
    monkeypatch.setattr(pii, "SAMPLE_TEXTS", 5)
    long = d.limit(0).union(spark.createDataFrame([(1, "a" * 25 + " 1 b2 " + "é " * 9000 + "last"), (2, None), (3, "")], "doc_id long, text string"))
    assert sorted(pii.sample_words(long)) == ["last", "é"] and pii.sample_words(d.where("false")) == []


def test_pii_digest(spark, tagger):
    t = "é a@b.co, 10.0.0.1"
    d = documents(spark, None, "", t, t).withColumn("spans", F.lit("clash")).withColumn("base", F.lit(1))
    got = {r["doc_id"]: r for r in pii.digest(pii.find_pii(d, model=tagger)).collect()}
    assert got[0]["base_sha256"] == got[1]["base_sha256"] == "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"
    assert got[2]["spans"] == "email:2:8,ip:10:18" and (got[2]["n_email"], got[2]["n_ip"], got[2]["n_card"]) == (1, 1, 0)
    assert pii.digest(pii.find_pii(d.where("false"), model=tagger)).count() == 0


# ---- 2 token counts --------------------------------------------------------------------------


def test_edits_keep_counts_exact():
    js, rk = packing.default_paths()
    count = lambda t: len(packing.token_ids(t, js, rk))
    rng = np.random.default_rng(5)
    words = np.array(["the", "don't", "x1", "été", "\n", "  ", "...", "A", "longerword", "12.5", "'s", "漢字。", "<|endoftext|>", "'ll", "½", "\u00a0", "!'t"])
    for k in range(120):
        t = ("" if k % 3 == 0 else " ").join(rng.choice(words, rng.integers(0, 400)))
        cuts = np.sort(rng.choice(len(t) + 1, min(len(t) + 1, 6), replace=False)).tolist()
        edits = [(a, b, str(rng.choice(["", "new", " ", "a b c " * 30]))) for a, b in zip(cuts[::2], cuts[1::2], strict=False)]
        tree = token_counts.TokenTree.of(t, count)
        assert tree.tokens[1] == count(t)
        new, again = tree.edit(t, edits, count)
        want, at = "", 0
        for a, b, x in edits:
            want, at = want + t[at:a] + x, b
        want += t[at:]
        assert new == want and tree.tokens[1] == count(want) and tree.chars[1] == len(want)
        at = int(rng.integers(0, len(new) + 1))  # a further edit, of the edited tree
        last, _ = tree.edit(new, [(at, at, "<|endof"), (at, min(len(new), at + 3), "text|>")], count)
        assert last == new[:at] + "<|endoftext|>" + new[at + 3 :] and tree.tokens[1] == count(last) and tree.chars[1] == len(last)


def test_few_characters_are_encoded_again():
    js, rk = packing.default_paths()
    t = "some words here " * 2000
    tree = token_counts.TokenTree.of(t, lambda x: len(packing.token_ids(x, js, rk)))
    assert tree.edit(t, [(100, 105, "x")], lambda x: len(packing.token_ids(x, js, rk)))[1] < 1000


def test_token_count_query(spark, texts):
    js, rk = packing.default_paths()
    got = QUERIES["op2_token_counts"](spark, SF).collect()
    assert all(r["n_tokens"] == len(packing.token_ids(texts[r["doc_id"]] or "", js, rk)) for r in got) and len(got) == len(texts)
    d = documents(spark, None, "", "mail a@b.co now")
    edited = token_counts.apply_edits(token_counts.redactions(token_counts.build_index(d)))
    assert [(r["n_tokens"], r["n_edits"]) for r in token_counts.counts(edited).orderBy("doc_id").collect()][:2] == [(0, 0), (0, 0)]


def test_a_second_round_of_edits_and_odd_rows(spark):
    js, rk = packing.default_paths()
    d = spark.createDataFrame([(1, "漢字。" * 900 + "x", 5), (1, "12,ab;" * 500, 5), (None, None, None), (2, "", 0)], "doc_id long, text string, n_edits int")
    edits = lambda df, n: df.withColumn("__edits", F.when(F.coalesce(F.length("text"), F.lit(0)) > 20, F.array(F.struct(F.lit(10).alias("start"), F.lit(12).alias("end"), F.lit("new " * n).alias("new")))))
    once = token_counts.apply_edits(edits(token_counts.build_index(d), 1000))
    twice = token_counts.apply_edits(edits(once, 1))
    rows = twice.collect()
    assert twice.columns[:3] == d.columns and len(rows) == 4
    for r in rows:
        assert r["__tokens"][1] == len(packing.token_ids(r["text"] or "", js, rk)) and r["__chars"][1] == len(r["text"] or "")
        assert (r["text"] is None) == (r["doc_id"] is None) and r["__chars_reencoded"] < 1500 and r["__n_edits"] == (len(r["text"] or "") > 20)
    assert token_counts.apply_edits(edits(token_counts.build_index(d.where("false")), 1)).count() == 0
    for bad in ([(0, 5, ""), (4, 6, "")], [(3, 99, "")], [(-1, 0, "")]):
        with pytest.raises(ValueError, match="overlap"):
            token_counts.TokenTree.of("some text", len).edit("some text", bad, len)


# ---- 3 languages -----------------------------------------------------------------------------


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(2)
    s = rng.normal(size=(4, 6, 3)).astype(np.float32)
    got = language_id.viterbi(s, 0.7)
    import itertools

    for k in range(4):
        def total(p, k=k):
            return sum(s[k, t, x] for t, x in enumerate(p)) - 0.7 * sum(a != b for a, b in itertools.pairwise(p))

        assert total(got[k]) == pytest.approx(max(map(total, itertools.product(range(3), repeat=6))), abs=1e-5)


@pytest.mark.parametrize("n", [129, 150, 200])
def test_many_languages(n):
    s = np.random.default_rng(n).normal(size=(3, 40, n)).astype(np.float32)
    for k, path in enumerate(language_id.viterbi(s, 0.5)):
        best, whence = s[k, 0].astype(float), []
        for t in range(1, 40):
            step = best[:, None] - 0.5 * (1 - np.eye(n))
            whence.append(step.argmax(axis=0))
            best = step.max(axis=0) + s[k, t]
        state = [int(best.argmax())]
        for w in reversed(whence):
            state.append(int(w[state[-1]]))
        assert path.min() >= 0 and path.tolist() == state[::-1]


def test_more_labels_than_fit_a_byte(spark):
    words = lambda i: " ".join(f"{chr(97 + i % 26)}{chr(97 + i // 26)}{x}" for x in ("xa", "yo", "zu", "we"))
    d = spark.createDataFrame([(k * 200 + i, f"{words(i)} " * 6, f"l{i:03}") for i in range(200) for k in range(3)], "doc_id long, text string, lang string")
    got = language_id.identify(d).collect()
    assert len(got) == 600 and len({r["lang_pred"] for r in got}) > 150


def test_segments_give_the_same_path():
    rng = np.random.default_rng(12)
    for n in (1, 7, 8, 9, 64, 201):
        s = (rng.normal(size=(n, 4)) + 2 * np.eye(4)[rng.integers(0, 4, n // 20 + 1)].repeat(20, axis=0)[:n]).astype(np.float64)
        assert (language_id.viterbi_long(s, 3.0, 8) == language_id.viterbi(s[None], 3.0)[0]).all()


def test_language_accuracy_and_edges(spark, docs):
    got = language_id.identify(docs).join(docs.select("doc_id", F.col("lang").alias("truth")), "doc_id").where("held_out").collect()
    assert np.mean([r["lang_pred"] == r["truth"] for r in got]) > 0.95 and all(0 <= r["score"] <= 1 for r in got)
    odd = docs.select("doc_id", "text", "lang").union(spark.createDataFrame([(10**6, None, "en"), (10**6, "", None), (10**6 + 1, "12 !? ½ Ⅷ ①", "en"), (None, "Привет мир", None)], "doc_id long, text string, lang string")).withColumn("score", F.lit(1))
    rows = [r for r in language_id.identify(odd).collect() if r["doc_id"] is None or r["doc_id"] >= 10**6]
    assert sorted(str(r["lang_pred"]) for r in rows if r["doc_id"] is not None) == ["und"] * 3 and len(rows) == 4
    assert language_id.identify(docs.where("false")).count() == 0
    by = {r["lang"]: r["text"] for r in docs.where("length(text) > 600").select("lang", "text").collect()}
    mixed = " ".join(" ".join(by[k].split()[:80]) for k in ("en", "de")) * 40
    d = docs.select("doc_id", "text", "lang").union(spark.createDataFrame([(10**6, mixed, None)] * 2, "doc_id long, text string, lang string"))
    one, two = language_id.identify(d).where("doc_id = 1000000").collect()
    assert one == two and {s["lang"] for s in one["spans"]} == {"en", "de"} and 70 < len(one["spans"]) < 90
    assert all(x["end"] < y["start"] for x, y in zip(one["spans"], one["spans"][1:], strict=False)) and one["spans"][-1]["end"] <= len(mixed)


def test_dirty_language_column_stays_bounded(spark, docs, monkeypatch):
    monkeypatch.setattr(language_id, "MAX_LANGUAGES", 4)
    d = docs.select("doc_id", "text", F.when(F.col("doc_id") % 50 == 0, F.concat(F.lit("x"), F.col("doc_id").cast("string"))).otherwise(F.col("lang")).alias("lang"))
    assert language_id.learn(d)["langs"] == ["de", "en", "es", "fr"]


def test_mixed_text_gets_spans(docs):
    model = language_id.learn(docs)
    by = {r["lang"]: r["text"] for r in docs.where("length(text) > 600").select("lang", "text").collect()}
    en, de = (" ".join(by[k].split()[:60]) for k in ("en", "de"))
    _, _, spans = language_id.Labeller(model).label([f"{en} {de}"])[0]
    odd = "½ Ⅷ x½y İstanbul naïve ②"
    assert [odd[a:e].lower() for a, e in language_id.words_at(odd)] == language_id.words_of(odd) == ["x", "y", "i̇stanbul", "naïve"]
    assert [s[2] for s in spans] == ["en", "de"] and abs(spans[0][1] - len(re.findall(r"[^\W\d_]+", en))) < 6


# ---- 4 decontamination -----------------------------------------------------------------------


def test_substitutions_are_found_and_chance_is_not(spark):
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in range(300)]
    item = list(rng.choice(words, 30))
    near = [w if i % 6 else "zz" for i, w in enumerate(item)]
    noise = " ".join(rng.choice(words, 5000))
    d = documents(spark, "pre, " + " ".join(item).upper().replace(" ", ", "), noise + " " + " ".join(near) + " tail", noise, None, "", " ".join(item[:9]), " ".join(item))
    b = spark.createDataFrame([(7, " ".join(item)), (8, None), (9, "zz yy"), (7, " ".join(item))], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): (r["n_equal"], r["token"]) for r in decontaminate.contaminated(d, b).collect()}
    assert got == {(0, 7): (30, 1), (1, 7): (25, 5000), (6, 7): (30, 0)}
    assert sorted(r["doc_id"] for r in decontaminate.without_contaminated(d, b).collect()) == [2, 3, 4, 5]
    assert decontaminate.contaminated(d, b.where("false")).count() == 0 and decontaminate.contaminated(d.where("false"), b).count() == 0


def test_a_large_benchmark_is_joined_with_the_same_result(spark, docs, monkeypatch):
    b = spark.read.parquet(f"{SF}/benchmark.parquet").union(spark.createDataFrame([(900, "zq zr"), (901, "zq zr"), (902, ""), (None, "x y"), (903, None)], "item_id long, text string"))
    d = docs.union(spark.createDataFrame([(10**6, "say Zq, zr again", "en", "s", 1), (None, "zq zr " * 3000, None, None, None), (None, None, None, None, None)], SCHEMA)).withColumn("item", F.lit("clash"))
    key = lambda r: tuple((x is None, x) for x in r)
    want = sorted(map(tuple, decontaminate.contaminated(d, b).collect()), key=key)
    kept = sorted(map(str, decontaminate.without_contaminated(d, b).collect()))
    monkeypatch.setattr(decontaminate, "BLOCK_TOKENS", 10)
    assert {(10**6, 900, 2, 2, 1), (10**6, 901, 2, 2, 1), (None, 900, 2, 2, 0)} <= set(want)
    assert sorted(map(tuple, decontaminate.contaminated(d, b).collect()), key=key) == want
    assert sorted(map(str, decontaminate.without_contaminated(d, b).collect())) == kept and len(kept) < d.count()
    assert decontaminate.contaminated(d.where("false"), b).count() == 0


def test_tolerance_against_brute_force(spark):
    """Every (text, item) that the rule holds at a place where a mask fits, and no other."""
    rng = np.random.default_rng(9)
    found = Counter()
    items = [[f"i{k}q{j}" for j in range(n)] for k, n in enumerate((3, 7, 12, 24, 26, 40, 60))]
    b = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id long, text string")
    texts, truth = [], []
    for rate in (0.0, 0.1, 0.2, 0.3):
        for k, w in enumerate(items):
            for _ in range(6):
                copy = [f"s{x}" if rng.random() < rate else x for x in w]
                texts.append(" ".join(["lead", *copy, "tail"]))
                same = [x == y for x, y in zip(w, copy, strict=True)]
                n = len(w)
                held = sum(same) >= (0.6 * n if n > 4 else n) or any(sum(same[i : i + 25]) >= 20 for i in range(n - 24))
                seeded = any(all(same[i + p] for p in m) for m in (decontaminate.MASKS if n > 4 else [tuple(range(n))]) for i in range(n - m[-1]))
                truth.append((rate, k, held and seeded))
                found[rate, "held"] += held
                found[rate, "found"] += held and seeded
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(documents(spark, *texts), b).collect()}
    assert got == {(i, k) for i, (_, k, ok) in enumerate(truth) if ok}
    assert all(found[r, "found"] >= low * found[r, "held"] for r, low in ((0.0, 1), (0.1, 0.95), (0.2, 0.85), (0.3, 0.85))), found


def test_decontamination_query_against_brute_force(spark, texts):
    tokens = lambda t: re.findall(r"(?:[a-z0-9]|[^\x00-\x7f])+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
    items = {r["item_id"]: tokens(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    want = set()
    for k, t in texts.items():
        joined = " " + " ".join(tokens(t)) + " "
        want |= {(k, i) for i, w in items.items() if " " + " ".join(w) + " " in joined}
    got = {(r["doc_id"], r["item_id"]) for r in QUERIES["op4_benchmark_decontamination"](spark, SF).collect()}
    assert want and want <= got and len(got - want) <= 2


# ---- 5 toxicity ------------------------------------------------------------------------------


def test_toxicity_on_held_out_labels(spark):
    sf = SF.replace("sf0.001", "sf0.01")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = QUERIES["op5_toxicity"](spark, sf).join(labels, "doc_id").where("held_out").collect()
    hits = sum(r["predicted"] and r["toxic"] for r in got)
    assert hits / max(1, sum(r["predicted"] for r in got)) > 0.6 and hits / sum(r["toxic"] for r in got) > 0.6
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)


def test_toxicity_edges(spark, docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    none = toxicity.toxicity(documents(spark, None, "", "x"), labels.where("toxic = 0")).collect()
    assert [r["predicted"] for r in none] == [0, 0, 0]
    odd = docs.union(spark.createDataFrame([(None, None, None, None, None), (10**7, "", None, None, 0), (10**7, "word " * 50_000, None, None, 0)], SCHEMA)).withColumn("score", F.lit("clash"))
    rows = toxicity.toxicity(odd, labels).collect()
    assert len(rows) == docs.count() + 3 and all(not r["predicted"] for r in rows if r["doc_id"] in (None, 10**7))


# ---- 6 packing -------------------------------------------------------------------------------


def check_packing(rows, capacity):
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in by.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_packing_round_trip(spark, texts):
    rows = QUERIES["op6_best_fit_packing"](spark, SF).collect()
    js, rk = packing.default_paths()
    per = {}
    for r in rows:
        per.setdefault(r["doc_id"], []).append(r)
    assert set(per) == set(texts)
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(js)
    for k, pieces in per.items():
        ids = np.array([*exact.encode(texts[k] or "", add_special_tokens=False).ids, 0], dtype="<u4")
        pieces.sort(key=lambda r: r["piece"])
        assert [r["piece"] for r in pieces] == list(range(len(pieces))) and all(r["length"] == 2048 for r in pieces[1:])
        assert sum(r["length"] for r in pieces) == len(ids)
        assert all(zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"] for r in pieces)
    n = check_packing(rows, 2048)
    assert n <= 1.02 * -(-sum(r["length"] for r in rows) // 2048) + 1


def best_fit_decreasing(lengths, capacity):
    gaps = []
    for n in sorted(lengths, reverse=True):
        fits = [g for g in gaps if g >= n]
        if fits:
            gaps.remove(min(fits))
            gaps.append(min(fits) - n)
        else:
            gaps.append(capacity - n)
    return len(gaps)


def test_rounds_place_as_best_fit_decreasing_does():
    rng = np.random.default_rng(6)
    for _ in range(60):
        capacity = int(rng.integers(1, 60))
        lengths = rng.integers(1, capacity + 1, rng.integers(0, 200)).tolist()
        placed = packing.best_fit_rounds(dict(Counter(lengths)), capacity)
        assert len({s for length, r, first, each, off in placed for s in [first]}) <= len(lengths)
        counts, rows = Counter(lengths), []
        for length, n in counts.items():
            own = sorted((r, first, each, off) for le, r, first, each, off in placed if le == length)
            for k, (r, first, each, off) in enumerate(own):
                end = own[k + 1][0] if k + 1 < len(own) else n
                rows += [{"sequence_id": first + (x - r) // each, "offset": off + (x - r) % each * length, "length": length} for x in range(r, end)]
        assert len(rows) == len(lengths)
        assert check_packing(rows, capacity) == best_fit_decreasing(lengths, capacity)


def test_packing_edges(spark):
    d = documents(spark, None, "", "a", "<|endoftext|>", "漢字", "word " * 9000).union(documents(spark, "a")).withColumn("length", F.lit("clash")).withColumn("piece", F.lit(0))
    rows = packing.pack(d).collect()
    check_packing(rows, 2048)
    assert len([r for r in rows if r["doc_id"] == 5]) == -(-9001 // 2048)
    assert packing.pack(d.where("false")).count() == 0


# ---- 7 nearest neighbours --------------------------------------------------------------------


def test_recall_and_scores(spark):
    sf = SF.replace("sf0.001", "sf0.1")
    rows = QUERIES["op7_nearest_neighbours"](spark, sf).collect()
    p = spark.read.parquet(f"{sf}/embeddings.parquet").toPandas()
    x, ids = np.stack(p.embedding).astype(float), p.vec_id.to_numpy()
    place = {v: i for i, v in enumerate(ids)}
    hit = 0
    by = {}
    for r in rows:
        by.setdefault(r["query_id"], []).append(r)
    assert set(by) == {v for v in ids if v % 20 == 0}
    for q, found in by.items():
        found.sort(key=lambda r: r["rank"])
        s = x @ x[place[q]]
        s[place[q]] = -np.inf
        hit += len(set(ids[np.lexsort((ids, -s))[:20]]) & {r["vec_id"] for r in found})
        assert [r["rank"] for r in found] == list(range(1, 21))
        assert [(-r["score"], r["vec_id"]) for r in found] == sorted((-r["score"], r["vec_id"]) for r in found)
        assert all(r["score"] == pytest.approx(s[place[r["vec_id"]]], abs=1e-9) for r in found)
    assert hit / len(rows) >= 0.9


def test_shards_and_doubles(spark, monkeypatch):
    rng = np.random.default_rng(13)
    v = rng.normal(size=(3000, 8)) * 1e100  # beyond the range of 32-bit numbers
    v[7] = v[6] * (1 + 1e-12)
    e = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    monkeypatch.setattr(ann, "SHARD_ROWS", 300)
    by = {}
    for r in ann.nearest(e.union(e.where("vec_id = 20"))).collect():
        by.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    hit = 0
    for q, found in by.items():
        s = v @ v[q]
        s[q] = -np.inf
        hit += len({x[1] for x in found} & set(np.lexsort((np.arange(3000), -s))[:20].tolist()))
        assert all(sc == pytest.approx(s[i], rel=1e-12) for _, i, sc in found if i != q)
    assert hit / (20 * len(by)) > 0.95 and len(by) == 150


@pytest.mark.parametrize("spread", [0.0, 0.25, 0.5])
def test_largest_products_of_unequal_lengths(spark, monkeypatch, spread):
    """64 dimensions, noisy copies of the given vectors and random ones; bands of over 256 rows have graphs."""
    monkeypatch.setattr(ann, "MIXED_ROWS", 256)
    monkeypatch.setattr(ann, "SHARD_ROWS", 700)
    own = np.stack(spark.read.parquet(f"{SF.replace('sf0.001', 'sf0.1')}/embeddings.parquet").limit(2500).toPandas().embedding)
    for seed in range(3):
        rng = np.random.default_rng(seed)
        v = rng.normal(size=(5000, 64)) if seed == 2 else own[rng.integers(0, len(own), 5000)] + rng.normal(0, 0.05, (5000, 64))
        v = (v / np.linalg.norm(v, axis=1, keepdims=True) * np.exp(spread * rng.normal(size=(5000, 1)))).astype(np.float32)
        e = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>")
        place, mixed = ann.plan_shards(dict(zip(*np.unique(np.floor(np.log(np.linalg.norm(v, axis=1)) / np.log(ann.LENGTH_RATIO) + 0.5).astype(int), return_counts=True), strict=True)))
        assert len(mixed) >= 8 and not all(mixed)
        hit = 0
        got = ann.nearest(e).collect()
        for r in got:
            s = r["score"]
            assert s == pytest.approx(float(v[r["query_id"]].astype(float) @ v[r["vec_id"]].astype(float)), abs=1e-9)
        found = {(r["query_id"], r["vec_id"]) for r in got}
        for q in range(0, 5000, 20):
            s = v.astype(float) @ v[q].astype(float)
            s[q] = -np.inf
            hit += sum((q, int(i)) in found for i in np.argsort(-s)[:20])
        assert hit / len(got) >= 0.93 and len(got) == 5000, (seed, hit / len(got))


def test_vectors_that_take_no_part_and_copies(spark):
    bad = [(100, None), (101, [0.0, 0.0]), (120, [float("nan"), 1.0]), (103, [None, 1.0]), (104, [float("inf"), 1.0])]
    rows = [(i, [1.0, 0.0]) for i in range(60)] + [(200, [0.0, 2.0]), (201, [1.0, 1.0])] + bad
    e = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("clash"))
    got = ann.nearest(e, k=5).orderBy("query_id", "rank").collect()
    assert {r["query_id"] for r in got} == {0, 20, 40, 200}
    assert [r["vec_id"] for r in got if r["query_id"] == 0] == [1, 2, 3, 4, 5]
    assert [r["vec_id"] for r in got if r["query_id"] == 20] == [0, 1, 2, 3, 4]
    assert [r["vec_id"] for r in got if r["query_id"] == 200] == [201, 0, 1, 2, 3]
    assert ann.nearest(e.where("vec_id > 100")).where("query_id = 200").count() == 1 and ann.nearest(e.where("false")).count() == 0


# ---- 8 Jaccard join --------------------------------------------------------------------------


def word_sets(texts, width):
    out = {}
    for k, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
        out[k] = {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
    return out


def brute_components(sets, p, q):
    root = {k: k for k in sets}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    ids = [k for k in sets if sets[k]]
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if both and q * both >= p * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {k: find(k) for k in sets}


def test_jaccard_query_is_exact(spark, texts):
    sets = word_sets(texts, 4)
    got = QUERIES["op8_ngram_jaccard_join"](spark, SF).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == brute_components(sets, 85, 100)
    assert {r["doc_id"]: r["n_shingles"] for r in got} == {k: len(s) for k, s in sets.items()}


@pytest.mark.parametrize("frequent_from", [2, 64])
@pytest.mark.parametrize("tile_rows", [4, 4096])
def test_jaccard_at_any_tile_size(spark, monkeypatch, frequent_from, tile_rows):
    rng = np.random.default_rng(8)
    monkeypatch.setattr(jaccard_join, "TILE_ROWS", tile_rows)
    base = [list(rng.choice([f"w{i}" for i in range(400)], rng.integers(1, 60))) for _ in range(12)]
    passage = [f"p{i}" for i in range(25)]
    texts = {}
    for k in range(120):
        w = list(base[k % 12])
        for _ in range(rng.integers(0, 3)):
            w[rng.integers(0, len(w))] = f"x{rng.integers(0, 9)}"
        texts[k] = " ".join(w + (passage if k % 2 else []))
    texts |= {900: "", 901: None, 902: "   ", 903: texts[5].upper(), 904: "one two", 905: "ONE  two"}
    d = spark.createDataFrame([(k, t, 1) for k, t in texts.items()], "doc_id long, text string, n int")
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.jaccard_components(d, width=2, threshold=(70, 100), frequent_from=frequent_from).collect()}
    assert got == brute_components(word_sets(texts, 2), 70, 100)


def test_jaccard_edges(spark):
    d = documents(spark, None, "", "a b c d e f", "a b c d e f", "word " * 30_000)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_components(d).collect()}
    assert got == {0: (0, 0), 1: (0, 1), 2: (3, 2), 3: (3, 2), 4: (1, 4)}
    twice = d.union(d)
    assert jaccard_join.jaccard_components(twice).count() == 10 and jaccard_join.jaccard_components(d.where("false")).count() == 0


def test_unlike_words_of_one_length_stay_apart(spark):
    one = "".join("ab"[bin(i).count("1") % 2] for i in range(2048))
    d = documents(spark, one, one.translate(str.maketrans("ab", "ba")))
    assert {r["component_id"] for r in jaccard_join.jaccard_components(d).collect()} == {0, 1}


def test_rows_without_an_id_link_others(spark):
    words = [f"w{i}" for i in range(100)]
    a, b, c = words, [*words, "x"], [*words, "x", "y"]
    sets = word_sets({0: " ".join(a), 1: " ".join(b), 2: " ".join(c)}, 4)
    assert brute_components({0: sets[0], 2: sets[2]}, 985, 1000) == {0: 0, 2: 2}
    d = spark.createDataFrame([(1, " ".join(a)), (None, " ".join(b)), (2, " ".join(c)), (None, "only this one"), (None, None)], "doc_id long, text string")
    got = sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in jaccard_join.jaccard_components(d, threshold=(985, 1000)).collect())
    assert got == [("1", 97, "1"), ("2", 99, "1"), ("None", 0, "None"), ("None", 1, "None"), ("None", 98, "1")]


def test_one_row_of_each_group_stays(spark):
    a, other = " ".join(f"w{i}" for i in range(40)), "quite another text of some words"
    rows = [(1, a, "x"), (9, a, "x"), (9, other, "x"), (3, "one two three", "p"), (3, "one two three", "q"), (None, a + " end", "x"), (None, "lone", "x"), (None, "lone", "x"), (None, None, "x"), (4, "", "x"), (4, "", "x")]
    d = spark.createDataFrame(rows, "doc_id long, text string, m string")
    out = jaccard_join.one_of_each_group(d)
    assert out.columns == d.columns
    got = sorted((str(r["doc_id"]), str(r["text"])) for r in out.collect())
    assert got == sorted([("1", a), ("9", other), ("3", "one two three"), ("None", "lone"), ("None", "None"), ("4", ""), ("4", "")])
    assert jaccard_join.one_of_each_group(d.where("false")).count() == 0


def test_components_of_chains_and_nothing(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 600), (600, 600)], "a long, b long")
    got = {r["node"]: r["component"] for r in connected_components(e).collect()}
    assert all(got[i] == 0 for i in range(201)) and got[600] == 500
    assert connected_components(e.where("false")).count() == 0


# ---- 9 line dedup ----------------------------------------------------------------------------


def lines_of(seed, n, words):
    rng = np.random.default_rng(seed)
    return [" ".join(f"v{x}" for x in rng.integers(0, 10**6, words)) for _ in range(n)]


def test_repeated_passages_go_and_first_stays(spark):
    long_line, block, own = lines_of(1, 1, 60)[0], lines_of(2, 40, 9), lines_of(3, 8, 9)
    short = "All rights reserved."
    texts = ["\n".join([own[0], long_line, own[1], short]), "\n".join([own[2], long_line, own[3], short]), "\n".join([own[4], *block, own[5]]), "\n".join([own[6], own[7], *block]), None, "", short]
    out = {r["doc_id"]: r for r in line_dedup.dedup_lines(documents(spark, *texts).withColumn("h", F.lit(1)).withColumn("line", F.lit("x"))).collect()}
    assert out[0]["text"] == texts[0] and out[2]["text"] == texts[2]
    assert out[1]["text"] == "\n".join([own[2], own[3], short])
    assert out[3]["__n_removed"] >= 28 and out[3]["text"].startswith(own[6])
    assert out[4]["text"] is None and out[5]["text"] == "" and out[6]["text"] == short
    assert line_dedup.dedup_lines(documents(spark, "x").where("false")).count() == 0


def test_copies_keep_one(spark):
    t = "\n".join(lines_of(5, 20, 10))
    d = documents(spark, t, t, t)
    out = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(d.union(d.where("doc_id = 0"))).collect()}
    assert out[0] == t and len(out[1]) < 0.2 * len(t)
    assert line_dedup.dedup_lines(d.union(d.where("doc_id = 0"))).where("doc_id = 0 and __n_removed = 0").count() == 2


def test_line_dedup_query_against_brute_force(spark, texts):
    import pyarrow as pa

    from tidewater.llm import common as C

    spans = {}
    first = {}
    for k in sorted(texts):
        t = (texts[k] or "").encode()
        (_, _, data, offsets), = C.text_slices(pa.array([t.decode()]), 1 << 30)
        _, line, n, a, e, _ = line_dedup.chunks(data, offsets)
        spans[k] = [(int(x), int(y), t[p:q]) for x, y, p, q in zip(line, n, a, e, strict=True)]
        for x, _, b in spans[k]:
            first.setdefault(b, (k, x))
    for r in QUERIES["op9_line_dedup"](spark, SF).collect():
        gone = {i for x, n, b in spans[r["doc_id"]] if first[b] != (r["doc_id"], x) for i in range(x, x + n)}
        lines = (texts[r["doc_id"]] or "").split("\n")
        assert r["n_removed"] == len(gone) and r["text"] == "\n".join(s for i, s in enumerate(lines) if i not in gone)


@pytest.mark.parametrize(("n", "words"), [(3, 20), (4, 15), (5, 12), (6, 9), (6, (1, 24, 0, 3, 20, 2))])
def test_passages_of_few_short_lines_go_whole(spark, n, words):
    texts, own = [], []
    for k in range(20):
        sizes = [words] * n if isinstance(words, int) else words
        passage = [lines_of(1000 * n + 10 * k + j, 1, w)[0] for j, w in enumerate(sizes)]
        for copy in range(2):
            other = lines_of(10**6 + 100 * n + 2 * k + copy, 6, 7)
            own.append("\n".join(other))
            texts.append("\n".join([*other[:3], *passage, *other[3:]]))
    out = {r["doc_id"]: r for r in line_dedup.dedup_lines(documents(spark, *texts)).collect()}
    for k in range(0, 40, 2):
        assert out[k]["text"] == texts[k] and out[k + 1]["text"] == own[k + 1] and out[k + 1]["__n_removed"] == n


# ---- 10 sharding -----------------------------------------------------------------------------


def check_shards(rows, shards=16):
    per = {s: [] for s in range(shards)}
    for r in rows:
        per[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in per.values())
    assert max(map(len, per.values())) - min(map(len, per.values())) <= 1


def test_shards_are_even_and_keep_groups(spark, texts):
    rows = QUERIES["op10_balanced_sharding"](spark, SF).collect()
    check_shards(rows)
    assert all(r["size"] == len((texts[r["doc_id"]] or "").encode()) + 1 and r["text_crc32"] == zlib.crc32((texts[r["doc_id"]] or "").encode()) for r in rows)
    groups = {}
    for r in rows:
        groups.setdefault(texts[r["doc_id"]], set()).add(r["shard"])
    sizes = Counter(texts.values())
    cut = sum(len(groups[t]) > 1 for t, n in sizes.items() if n > 1)
    assert cut <= max(1, 0.1 * sum(n > 1 for n in sizes.values()))


def test_hot_group_is_spread_and_edges(spark):
    d = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 1000, "same").when(F.col("id") < 1400, F.concat(F.lit("g"), (F.col("id") % 100).cast("string"))).when(F.col("id") < 1410, None).otherwise(F.col("id").cast("string")).alias("text"), F.lit(1).alias("shard"))
    rows = sharding.shard_documents(d).collect()
    check_shards(rows)
    at = {r["doc_id"]: r["shard"] for r in rows}
    assert len({at[i] for i in range(1000)}) <= 10
    report = sharding.quality(sharding.shard_documents(d)).first()
    assert report["shards"] == 16 and report["most"] - report["fewest"] <= 1 and 5 <= report["edges_cut"] <= 60
    assert sum(len({at[i] for i in range(1000 + k, 1400, 100)}) == 1 for k in range(100)) >= 80
    few = sharding.shard_documents(d.where("doc_id < 5")).collect()
    check_shards(few)
    assert sharding.shard_documents(d.where("false")).count() == 0


def test_sharding_writes_few_files(spark, monkeypatch):
    """A file costs every executor a process or more, so rounds must not write one for each shuffle partition."""
    wrote, materialize, settings = [], sharding.C.materialize, {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}

    def counted(df, name):
        out = materialize(df, name)
        wrote.append((name, len(out.inputFiles())))
        return out

    monkeypatch.setattr(sharding.C, "materialize", counted)
    before = {k: spark.conf.get(k) for k in settings}
    d = spark.range(4000).select(F.col("id").alias("doc_id"), (F.col("id") % 1500).cast("string").alias("text"))
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        rows = sharding.shard_documents(d).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    check_shards(rows)
    assert sum(n for _, n in wrote) <= 200, wrote


def test_sharding_surplus_fills_the_room(spark, monkeypatch):
    """Without rounds, so that shards start with more and with fewer documents than their quota."""
    monkeypatch.setattr(sharding, "propagate", lambda hubs, quota: hubs)
    rows = sharding.shard_documents(spark.range(4000).select(F.col("id").alias("doc_id"), (F.col("id") % 1990).cast("string").alias("text"))).collect()
    check_shards(rows)
    assert sorted(r["doc_id"] for r in rows) == list(range(4000))


def test_large_group_is_ranked_in_many_tasks(spark, monkeypatch):
    most, ranked = [], sharding.ranked

    def watched(df, group, bucket):
        most.append(df.groupBy(*group, bucket).count().agg(F.max("count")).first()[0])
        return ranked(df, group, bucket)

    monkeypatch.setattr(sharding, "ranked", watched)
    d = spark.range(20_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 1100, "same").otherwise(F.col("id").cast("string")).alias("text"))
    rows = sharding.shard_documents(d).collect()
    check_shards(rows)
    assert len({r["shard"] for r in rows if r["doc_id"] < 1100}) == 1
    assert max(most) <= 45, most  # 20,000 rows in 1,024 buckets
