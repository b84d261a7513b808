"""Personal data: fixed patterns, and spans by a character-level BiLSTM with a CRF.

The patterns find what is written in full. The network, a bidirectional LSTM over characters
with a linear-chain CRF on top, trained here in numpy from labelled spans, adds what the
patterns miss (an address with "at" and "dot" in words, a telephone number without "+").
Texts are decoded in overlapping windows; where windows overlap, each character's label is
taken from the window in whose middle it lies best, and spans are then read off globally, so
a span is never cut at a window's edge. Base spans stay; a span of the network that touches
one is dropped, and so is one without what its kind needs (see ``plausible``). Decoded are the
windows whose labels count for a character that ``_TRIGGER`` matches, and then their neighbours
for as long as a span reaches the edge of what is decoded. Every plausible span holds such a
character, so that leaving out the other windows does not change the result.

The labelled spans for training are put by rule into lines of words from the table itself, taken
from SAMPLE_TEXTS of its texts (a documented bound; of random letters where it has none): addresses
with "at" and "dot" written out, numbers without "+" or with unusual marks, cards that stand next
to each other, where the pattern sees one long number. A model is trained once for a process and
sample; ``save`` and ``load`` keep it as a table.

Null texts count as empty; rows that repeat a doc_id are scanned one by one, null ids too. Offsets
are code points. Time is linear in a text's length and its spans. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
WINDOW, STRIDE = 160, 80
TRAIN_LINES, HIDDEN, EPOCHS = 2400, 24, 10
#: Texts of the table, and distinct words of them, from which training lines take their words.
SAMPLE_TEXTS, SAMPLE_WORDS = 200, 4000
#: Labels: 0 outside, then begin and inside of each kind.
LABELS = 1 + 2 * len(KINDS)
SYMBOLS = 100

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# Possessive and anchored forms of the patterns: the same matches, in linear time.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")


def _emails(text: str):
    """Leftmost matches of local@domain: a match can start anywhere in the run of local
    characters before an at sign, so the leftmost takes the whole run."""
    end = at = 0
    while (at := text.find("@", at)) >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            yield start, m.end()
            end = at = m.end()
        else:
            at += 1


def _luhn(digits: str) -> bool:
    total = sum(int(d) for d in digits[-1::-2]) + sum((0, 2, 4, 6, 8, 1, 3, 5, 7, 9)[int(d)] for d in digits[-2::-2])
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) by the patterns, by kind and then start."""
    out = [(0, a, e) for a, e in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        if "." in text:
            out += [(1, *m.span()) for m in _IP.finditer(text) if all(int(p) <= 255 for p in m.group().split(".") if len(p.lstrip("0")) < 4) and all(len(p.lstrip("0")) < 4 for p in m.group().split("."))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 13:
                digits = m.group().replace(" ", "").replace("-", "")
                if 13 <= len(digits) <= 19 and _luhn(digits):
                    out.append((2, *m.span()))
        if "+" in text:
            out += [(3, *m.span()) for m in _PHONE.finditer(text) if 9 <= sum("0" <= c <= "9" for c in m.group()) <= 15]
    return out


# ---- what the network may add -------------------------------------------------------------

_AT = re.compile(r"[(\[{<]\s*at\s*[)\]}>]|\bat\b", re.I)
_BRACKETED_AT = re.compile(r"[(\[{<]\s*at\s*[)\]}>]", re.I)
_DOT = re.compile(r"[(\[{<]\s*dot\s*[)\]}>]|\bdot\b", re.I)
#: What every plausible span holds, by the conditions of plausible(): an address an at sign, a
#: "dot" or a bracketed "at", the other kinds a digit.
_TRIGGER = re.compile(r"@|[0-9]|dot|[(\[{<]\s*at\s*[)\]}>]", re.I)


def plausible(kind: int, s: str) -> bool:
    """Whether a decoded span holds what its kind needs."""
    if kind == 0:
        return bool(_AT.search(s) and _DOT.search(s) or _BRACKETED_AT.search(s) and "." in s) or s.count("@") == 1
    digits = sum(c.isdigit() and c.isascii() for c in s)
    if kind == 1:
        return s.count(".") == 3 and digits >= 4
    if kind == 2:
        d = "".join(c for c in s if "0" <= c <= "9")
        return 13 <= digits <= 19 and _luhn(d)
    return 9 <= digits <= 15 and any(c in " ().-" for c in s) and sum(c.isalpha() for c in s) == 0


def encode(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "replace"), "<u4").astype(np.int64)
    return np.where((codes >= 32) & (codes < 127), codes - 31, np.where(codes == 10, 96, np.where(codes < 128, 97, np.where(codes < 0x250, 98, 99))))


def training_lines(n: int = TRAIN_LINES, seed: int = 3, words: list[str] | None = None) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """Texts with labelled spans, made by rule, of the given words or of random letters."""
    rng = np.random.Generator(np.random.PCG64(seed))

    def letters(a=1, e=9):
        return "".join(chr(97 + k) for k in rng.integers(0, 26, rng.integers(a, e + 1)))

    def word():
        return words[rng.integers(0, len(words))] if words and rng.random() < 0.8 else letters()

    def name_part(e):
        own = re.sub("[^a-z0-9]", "", word().lower())[:e]
        return own if len(own) > 1 else letters(2, e)

    def digits(k):
        return "".join(str(d) for d in rng.integers(0, 10, k))

    def card():
        d = digits(15)
        return next(d + str(c) for c in range(10) if _luhn(d + str(c)))

    def value(kind):
        if kind == 0:
            name = name_part(9) + (f"{rng.choice(['.', '_', '', '-'])}{rng.choice([name_part(6), digits(2)])}" if rng.random() < 0.55 else "")
            host = rng.choice(["example", "mail" + digits(1), name_part(9)])
            at = rng.choice(["@", "@", " at ", " [at] ", " (at) ", "[at]", "(at)", " AT ", " @ ", "{at}"])
            dot = rng.choice([" dot ", " [dot] ", " (dot) ", "[dot]", "(dot)", " DOT "]) if at.strip() != "@" or rng.random() < 0.4 else "."
            dot = "." if "a" in at and not at.startswith(" at") and rng.random() < 0.3 else dot
            return f"{name}{at}{host}{dot}{rng.choice(['com', 'org', 'net', 'de', 'fr', 'io'])}"
        if kind == 1:
            return ".".join(str(x) for x in rng.integers(0, 256, 4))
        if kind == 2:
            c, mark = card(), rng.choice(["", " ", "-", ".", "/"], p=[0.4, 0.2, 0.2, 0.1, 0.1])
            return mark.join(c[k : k + 4] for k in range(0, 16, 4))
        a, b, c = digits(3), digits(3), digits(4)
        return rng.choice([f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"({a}){b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"{a} {b} {c}", f"1-{a}-{b}-{c}", f"+{a[:2]} {b} {c}", f"00{a[:2]} {b} {c}"])

    def noise():
        return rng.choice([word(), word(), word(), word(), word().capitalize() + ",", word() + ".", digits(rng.integers(1, 6)), f"{digits(2)}.{digits(2)}.{digits(4)}", f"version {rng.integers(0, 9)}.{rng.integers(0, 9)}", "at", "dot", f"{digits(4)}-{digits(2)}-{digits(2)}", f"{word()} at {word()}", f"{digits(3)},{digits(3)}", letters() + digits(2)])

    out = []
    for _ in range(n):
        text, spans, again = "", [], None
        for _ in range(rng.integers(4, 14)):
            if again is not None or rng.random() < 0.22:
                kind = again if again is not None else int(rng.choice(4, p=[0.4, 0.12, 0.24, 0.24]))
                again = None
                v = value(kind)
                spans.append((kind, len(text), len(text) + len(v)))
                if kind == 2 and rng.random() < 0.4:  # cards side by side are one number to the pattern
                    again = 2
            else:
                v = noise()
            text += v + (" " if again is not None else rng.choice([" ", " ", " ", "\n", ". ", ", "]))
        out.append((text[:WINDOW], [s for s in spans if s[2] <= WINDOW]))
    return out


def sample_words(docs: DataFrame, text: str = "text") -> list[str]:
    """Up to SAMPLE_WORDS distinct words of up to SAMPLE_TEXTS different texts, each read whole; texts and words
    are those of the least hashes, so neither the order of rows nor how often they repeat matters."""
    h = F.xxhash64(text)
    rows = docs.where(F.col(text).isNotNull())
    least = [r["h"] for r in rows.select(h.alias("h")).distinct().orderBy("h").limit(SAMPLE_TEXTS).collect()]
    words = rows.where(h.isin(least)).select(F.explode(F.split(text, r"[\x20\x09-\x0D]+")).alias("w")).where(F.col("w").rlike(r"^\p{L}+$") & (F.length("w") < 20)).distinct()
    return [r["w"] for r in words.orderBy(F.xxhash64("w"), "w").limit(SAMPLE_WORDS).collect()]


_trained: dict[bytes, dict[str, np.ndarray]] = {}


def model_for(docs: DataFrame, text: str = "text") -> dict[str, np.ndarray]:
    """The model for a table, trained once a process for each sample of words."""
    words = sample_words(docs, text)
    key = hashlib.sha256("\n".join(words).encode()).digest()
    if key not in _trained:
        _trained[key] = train(training_lines(words=words))
    return _trained[key]


def save(spark, model: dict[str, np.ndarray], path: str) -> None:
    """The weights as a Parquet table of (name, shape, weights)."""
    spark.createDataFrame([(k, list(a.shape), a.ravel().astype(float).tolist()) for k, a in model.items()], "name string, shape array<int>, weights array<double>").coalesce(1).write.parquet(path)


def load(spark, path: str) -> dict[str, np.ndarray]:
    return {r["name"]: np.array(r["weights"], np.float32).reshape(r["shape"]) for r in spark.read.parquet(path).collect()}


def label_ids(n: int, spans: list[tuple[int, int, int]]) -> np.ndarray:
    y = np.zeros(n, np.int64)
    for kind, a, e in spans:
        y[a:e] = 2 + 2 * kind
        y[a] = 1 + 2 * kind
    return y


def _allowed() -> np.ndarray:
    """CRF transitions that may be: an inside label follows its own begin or inside."""
    ok = np.ones((LABELS, LABELS), bool)
    for k in range(len(KINDS)):
        ok[:, 2 + 2 * k] = False
        ok[[1 + 2 * k, 2 + 2 * k], 2 + 2 * k] = True
    return ok


def init(seed: int = 1) -> dict[str, np.ndarray]:
    rng = np.random.Generator(np.random.PCG64(seed))
    g = lambda *s: (rng.standard_normal(s) * 0.25).astype(np.float32)
    return {"xf": g(SYMBOLS, 4 * HIDDEN), "hf": g(HIDDEN, 4 * HIDDEN), "xb": g(SYMBOLS, 4 * HIDDEN), "hb": g(HIDDEN, 4 * HIDDEN), "o": g(2 * HIDDEN, LABELS), "ob": np.zeros(LABELS, np.float32), "t": np.zeros((LABELS, LABELS), np.float32)}


def _sigmoid(x):
    return 1 / (1 + np.exp(-x))


def lstm(x: np.ndarray, wx: np.ndarray, wh: np.ndarray, keep: list | None = None) -> np.ndarray:
    """Hidden states (T, b, HIDDEN) over symbols x (T, b); symbol 0 pads and holds the state."""
    steps, b = x.shape
    h = np.zeros((b, HIDDEN), np.float32)
    c = np.zeros_like(h)
    out = np.empty((steps, b, HIDDEN), np.float32)
    for t in range(steps):
        z = wx[x[t]] + h @ wh
        s = _sigmoid(z[:, : 3 * HIDDEN])
        i, f, o = s[:, :HIDDEN], s[:, HIDDEN : 2 * HIDDEN], s[:, 2 * HIDDEN :]
        u = np.tanh(z[:, 3 * HIDDEN :])
        live = (x[t] > 0)[:, None]
        c2 = np.where(live, f * c + i * u, c)
        tc = np.tanh(c2)
        h2 = np.where(live, o * tc, h)
        if keep is not None:
            keep.append((i, f, o, u, c, tc, h, live))
        h, c = h2, c2
        out[t] = h
    return out


def _lstm_grad(x, wh, keep, dout, gx, gh):
    dh = np.zeros_like(dout[0])
    dc = np.zeros_like(dh)
    for t in range(len(x) - 1, -1, -1):
        i, f, o, u, c, tc, h, live = keep[t]
        dh = dh + dout[t]
        pass_h, pass_c = np.where(live, 0, dh), np.where(live, 0, dc)
        d, e = np.where(live, dh, 0), np.where(live, dc, 0)
        e = e + d * o * (1 - tc * tc)
        dz = np.concatenate([e * u * i * (1 - i), e * c * f * (1 - f), d * tc * o * (1 - o), e * i * (1 - u * u)], axis=1)
        np.add.at(gx, x[t], dz)
        gh += h.T @ dz
        dh, dc = pass_h + dz @ wh.T, pass_c + e * f


def emissions(p: dict, x: np.ndarray, keep: tuple | None = None) -> np.ndarray:
    f = lstm(x, p["xf"], p["hf"], keep and keep[0])
    r = lstm(x[::-1], p["xb"], p["hb"], keep and keep[1])[::-1]
    both = np.concatenate([f, r], axis=2)
    if keep:
        keep[2].append(both)
    return both @ p["o"] + p["ob"]


def _lse(a: np.ndarray, axis: int) -> np.ndarray:
    m = a.max(axis=axis, keepdims=True)
    return (m + np.log(np.exp(a - m).sum(axis=axis, keepdims=True))).squeeze(axis)


def _loss_grad(p: dict, x: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
    """Mean negative log-likelihood of the CRF over a batch (T, b), and gradients."""
    keep = ([], [], [])
    e = emissions(p, x, keep)
    steps, b, _ = e.shape
    real = (x > 0).astype(np.float32)
    tr = np.where(_allowed(), p["t"], -1e4).astype(np.float32)
    alpha = np.empty_like(e)
    alpha[0] = e[0]
    for t in range(1, steps):
        step = _lse(alpha[t - 1][:, :, None] + tr[None], 1) + e[t]
        alpha[t] = np.where(real[t][:, None] > 0, step, alpha[t - 1])
    beta = np.zeros_like(e)
    for t in range(steps - 2, -1, -1):
        step = _lse(tr[None] + (e[t + 1] + beta[t + 1])[:, None, :], 2)
        beta[t] = np.where(real[t + 1][:, None] > 0, step, beta[t + 1])
    z = _lse(alpha[-1], 1)
    rows = np.arange(b)
    gold = e[0][rows, y[0]].copy()
    marg = np.exp(alpha + beta - z[None, :, None]) * real[:, :, None]
    de = marg.copy()
    de[0][rows, y[0]] -= 1
    gt = np.zeros_like(tr)
    for t in range(1, steps):
        gold += real[t] * (tr[y[t - 1], y[t]] + e[t][rows, y[t]])
        de[t][rows, y[t]] -= real[t]
        pair = np.exp(alpha[t - 1][:, :, None] + tr[None] + (e[t] + beta[t])[:, None, :] - z[:, None, None]) * real[t][:, None, None]
        gt += pair.sum(axis=0)
        np.add.at(gt, (y[t - 1], y[t]), -real[t])
    de /= b
    both = keep[2][0]
    grad = {"o": both.reshape(-1, 2 * HIDDEN).T @ de.reshape(-1, LABELS), "ob": de.sum(axis=(0, 1)), "t": np.where(_allowed(), gt / b, 0)}
    dboth = de @ p["o"].T
    for d, part in (("f", dboth[:, :, :HIDDEN]), ("b", dboth[::-1, :, HIDDEN:])):
        gx, gh = np.zeros_like(p["x" + d]), np.zeros_like(p["h" + d])
        _lstm_grad(x if d == "f" else x[::-1], p["h" + d], keep[0 if d == "f" else 1], part, gx, gh)
        grad["x" + d], grad["h" + d] = gx, gh
    return float((z - gold).mean()), grad


def train(lines: list[tuple[str, list[tuple[int, int, int]]]] | None = None, epochs: int = EPOCHS, batch: int = 48) -> dict[str, np.ndarray]:
    """Adam on labelled lines (text, spans), WINDOW characters each at most."""
    lines = training_lines() if lines is None else lines
    lines = sorted((x for x in lines if x[0]), key=lambda x: len(x[0]))
    p, rng = init(), np.random.Generator(np.random.PCG64(2))
    m, v = ({k: np.zeros_like(a) for k, a in p.items()} for _ in range(2))
    step = 0
    for epoch in range(epochs):
        for k in rng.permutation(-(-len(lines) // batch)):
            part = lines[k * batch : (k + 1) * batch]
            steps = max(len(t) for t, _ in part)
            x, y = np.zeros((steps, len(part)), np.int64), np.zeros((steps, len(part)), np.int64)
            for j, (t, s) in enumerate(part):
                x[: len(t), j], y[: len(t), j] = encode(t), label_ids(len(t), s)
            _, grad = _loss_grad(p, x, y)
            norm = np.sqrt(sum(float((g**2).sum()) for g in grad.values()))
            step += 1
            rate = 0.02 * (0.75**epoch)
            for name, g in grad.items():
                g = g * min(1, 5 / (norm + 1e-9))
                m[name] = 0.9 * m[name] + 0.1 * g
                v[name] = 0.99 * v[name] + 0.01 * g * g
                p[name] = (p[name] - rate * (m[name] / (1 - 0.9**step)) / (np.sqrt(v[name] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return p


def decode(p: dict, x: np.ndarray) -> np.ndarray:
    """Best labels (T, b) of symbols (T, b) under the CRF."""
    e = emissions(p, x)
    steps, b, _ = e.shape
    tr = np.where(_allowed(), p["t"], -1e4).astype(np.float32)
    best, back = e[0].copy(), np.zeros((steps, b, LABELS), np.int8)
    best[:, 2::2] = -1e4  # an inside label cannot come first
    for t in range(1, steps):
        all_ = best[:, :, None] + tr[None]
        back[t] = all_.argmax(axis=1)
        step = np.take_along_axis(all_, back[t][:, None, :].astype(np.int64), axis=1)[:, 0] + e[t]
        live = (x[t] > 0)[:, None]
        best = np.where(live, step, best)
        back[t] = np.where(live, back[t], np.arange(LABELS))
    path = np.zeros((steps, b), np.int8)
    state = best.argmax(axis=1)
    rows = np.arange(b)
    for t in range(steps - 1, -1, -1):
        path[t] = state
        state = back[t][rows, state].astype(np.int64)
    return path


def owner(at: int) -> int:
    """Number of the window whose middle is nearest to a character, the earlier of two."""
    return max(0, (at - (WINDOW - STRIDE) // 2 - 1) // STRIDE)


def owned(w: int, n: int) -> tuple[int, int]:
    """The characters, of n, that window w owns."""
    first = (WINDOW - STRIDE) // 2 + 1
    return min(n, w * STRIDE + first) if w else 0, min(n, (w + 1) * STRIDE + first)


def windows_of(text: str) -> set[int]:
    """Numbers of the windows that own a character which every plausible span holds one of."""
    return {w for m in _TRIGGER.finditer(text) for w in range(owner(m.start()), owner(m.end() - 1) + 1)}


def reconcile(n: int, starts: list[int], labels: list[np.ndarray]) -> list[tuple[int, int, int]]:
    """Spans from windows' labels: each character has the label of the window whose middle is nearest."""
    spans, prev_end, prev_kind = [], -1, -1
    chosen: dict[int, int] = {}
    near: dict[int, int] = {}
    for s, y in zip(starts, labels, strict=True):
        for k in range(min(WINDOW, n - s)):
            far = abs(2 * k - WINDOW)
            if s + k not in near or far < near[s + k]:
                near[s + k], chosen[s + k] = far, int(y[k])
    for at in sorted(c for c in chosen if chosen[c]):
        kind, inside = (chosen[at] - 1) // 2, chosen[at] % 2 == 0
        if inside and at == prev_end and kind == prev_kind:
            spans[-1][2] = at + 1
        else:
            spans.append([kind, at, at + 1])
        prev_end, prev_kind = at + 1, kind
    return [tuple(s) for s in spans]


def _merged(spans: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Start and end of what the spans cover, in order."""
    out: list[list[int]] = []
    for a, e in sorted((a, e) for _, a, e in spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(e, out[-1][1])
        else:
            out.append([a, e])
    return [(a, e) for a, e in out]


def added_spans(p: dict, texts: list[str], base: list[list[tuple[int, int, int]]]) -> list[list[tuple[int, int, int]]]:
    """What the network adds to the base spans of every text."""
    jobs = []
    for k, t in enumerate(texts):
        pieces, at = [], 0
        for a, e in _merged(base[k]):  # what a pattern has found triggers nothing
            pieces += [t[at:a], "\n" * (e - a)]
            at = e
        jobs += [(k, w) for w in sorted(windows_of("".join(pieces) + t[at:]))]
    by: dict[int, dict[int, np.ndarray]] = {}
    while jobs:
        further = set()
        for at in range(0, len(jobs), 512):
            part = jobs[at : at + 512]
            x = np.zeros((WINDOW, len(part)), np.int64)
            for j, (k, w) in enumerate(part):
                piece = texts[k][w * STRIDE : w * STRIDE + WINDOW]
                x[: len(piece), j] = encode(piece)
            for (k, w), y in zip(part, decode(p, x).T, strict=True):
                a, e = owned(w, len(texts[k]))
                own = by.setdefault(k, {})[w] = np.zeros(WINDOW, np.int8)
                own[a - w * STRIDE : e - w * STRIDE] = y[a - w * STRIDE : e - w * STRIDE]
                if a and own[a - w * STRIDE] and own[a - w * STRIDE] % 2 == 0:
                    further.add((k, w - 1))
                if e < len(texts[k]) and own[e - 1 - w * STRIDE]:
                    further.add((k, w + 1))
        jobs = sorted((k, w) for k, w in further if w not in by[k])
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for k, own in by.items():
        t, taken = texts[k], _merged(base[k])
        begins = [a for a, _ in taken]
        starts = sorted(own)
        for kind, a, e in reconcile(len(t), [w * STRIDE for w in starts], [own[w] for w in starts]):
            while a < e and t[e - 1] in " .,;\n":
                e -= 1
            while a < e and t[a] in " .,;\n":
                a += 1
            before = bisect_right(begins, e - 1) - 1  # the last base span that starts before the end
            if a < e and (before < 0 or taken[before][1] <= a) and plausible(kind, t[a:e]):
                out[k].append((kind, a, e))
    return out


def find_pii(docs: DataFrame, key: str = "doc_id", text: str = "text", model: dict | None = None) -> DataFrame:
    """doc_id, base and spans: arrays of (kind, start, end), by kind and start; spans holds all."""
    model = docs.sparkSession.sparkContext.broadcast(model_for(docs, text) if model is None else model)
    kind = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])

    def named(spans):
        return [{"kind": KINDS[k], "start": a, "end": e} for k, a, e in sorted(spans)]

    def scan(batches):
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                texts = [t or "" for t in part.column(1).to_pylist()]
                base = [base_spans(t) for t in texts]
                more = added_spans(model.value, texts, base)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([named(x) for x in base], pa.list_(kind)), pa.array([named(x + y) for x, y in zip(base, more, strict=True)], pa.list_(kind))], ["doc_id", "base", "spans"])

    shape = "array<struct<kind:string,start:int,end:int>>"
    return docs.select(F.col(key).cast("long"), text).mapInArrow(scan, f"doc_id long, base {shape}, spans {shape}")


def digest(found: DataFrame) -> DataFrame:
    """Counts of the base spans by kind, their hash, and all spans as one string."""
    written = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def number(kind: str):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [number(k) for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(written("base").cast("binary"), 256).alias("base_sha256"), written("spans").alias("spans"), (F.size("spans") - F.size("base")).cast("long").alias("n_added"))
