"""Personal data by rules and by a character-level bidirectional LSTM with CRF transitions.

The rules find the plain formats. The model is trained in numpy on labelled spans: windows around the rules' own matches in
at most ``MAX_DOCS`` documents, chosen by a hash of the id, with their formats varied (numbers without the plus sign, other
separators, two numbers side by side), and windows around other digits as counter-examples. It reads a text where it holds
a digit or an at sign - every kind needs one - in overlapping windows. Scores of overlapping windows are averaged by how far
a character is from the window's edge, and one Viterbi pass with the CRF transitions runs over each joined stretch, so no
window decides alone. Spans of the model are added where no rule matched, if their marginal is high and they meet the
kind's own limits (digits, checksum, parts); rule spans always stay.

Offsets are code points. Defined cases: null is the empty text and has no span; texts of any length are read whole, in
windows; repeated rows get equal results; without any labelled span the model adds nothing; extra columns do not matter.
"""

from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm import lstm

KINDS = ("email", "ip", "card", "phone")
TAGS = 1 + 2 * len(KINDS)  # outside, then begin and inside of each kind
MAX_DOCS, MAX_WINDOWS = 6_000, 1_500
REACH, SPAN, STRIDE = 24, 96, 48
HIDDEN = 24
MARGINAL = 0.9
# The plain formats.
_RULES = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(?:\.[0-9]+){3}"),
    "card": re.compile(r"[0-9](?:[\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
_EMAIL_TAIL = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_LONG = re.compile(r"[0-9](?:[\x20-]?[0-9]){13,}")
_TRIGGER = re.compile(r"[0-9@](?:[^0-9@]{0,47}[0-9@])*")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def valid(kind: str, match: str) -> bool:
    digits = re.sub(r"[^0-9]", "", match)
    if kind == "ip":
        return all(int(x[-4:]) <= 255 and len(x.lstrip("0")) <= 3 for x in match.split("."))
    if kind == "card":
        return 14 <= len(digits) <= 19 and luhn(digits)
    if kind == "phone":
        return 10 <= len(digits) <= 15
    return True


def rule_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of each kind; failing ones are dropped and not tried again."""
    out: list[Span] = []
    if "@" in text:
        out += _emails(text)
    for kind in ("ip", "phone"):
        if kind == "ip" and "." in text or kind == "phone" and "+" in text:
            out += [(kind, m.start(), m.end()) for m in _RULES[kind].finditer(text) if valid(kind, m[0])]
    # runs of fewer than 14 digits cannot be cards, so only long ones are looked for
    out += [("card", m.start(), m.end()) for m in _LONG.finditer(text) if valid("card", m[0])]
    return ordered(out)


def _emails(text: str) -> list[Span]:
    """The email rule, found from its at signs: a pattern that begins with a run of letters is tried at every letter."""
    out, done = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        tail = _EMAIL_TAIL.match(text, at + 1) if start < at else None
        if tail:
            done = tail.end()
            out.append(("email", start, done))
            at = text.find("@", done)
        else:
            at = text.find("@", at + 1)
    return out


def ordered(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def as_text(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


# characters: 0 padding or anything else, then ASCII as it is, other letters as one class
def codes(text: str) -> np.ndarray:
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    return np.where(c < 128, c, 1)


def one_hot(c: np.ndarray) -> np.ndarray:
    return np.eye(128, dtype=np.float32)[c]


def tags_of(n: int, spans: list[Span]) -> np.ndarray:
    y = np.zeros(n, np.int64)
    for k, a, b in spans:
        i = 1 + 2 * KINDS.index(k)
        y[a], y[a + 1 : b] = i, i + 1
    return y


def allowed() -> np.ndarray:
    """Penalties of impossible steps: an inside tag follows its own begin or inside tag only."""
    t = np.zeros((TAGS, TAGS), np.float32)
    for k in range(len(KINDS)):
        inside = 2 + 2 * k
        for a in range(TAGS):
            if a not in (inside, inside - 1):
                t[a, inside] = -30.0
    return t


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis, keepdims=True)
    return (m + np.log(np.exp(x - m).sum(axis, keepdims=True))).squeeze(axis)


def crf(z: np.ndarray, trans: np.ndarray, mask: np.ndarray):
    """Forward and backward messages (batch, time, tags) and log partition of a linear-chain CRF."""
    batch, time, n = z.shape
    a, b = np.empty_like(z), np.zeros_like(z)
    a[:, 0] = z[:, 0]
    for t in range(1, time):
        step = _lse(a[:, t - 1, :, None] + trans[None], 1) + z[:, t]
        m = mask[:, t, None]
        a[:, t] = m * step + (1 - m) * a[:, t - 1]
    for t in range(time - 2, -1, -1):
        step = _lse(trans[None] + (z[:, t + 1] + b[:, t + 1])[:, None, :], 2)
        m = mask[:, t + 1, None]
        b[:, t] = m * step + (1 - m) * b[:, t + 1]
    return a, b, _lse(a[:, -1], 1)


def crf_loss(z: np.ndarray, y: np.ndarray, mask: np.ndarray, p: dict):
    """Negative log-likelihood with gradients of the scores and of the transitions."""
    trans = p["trans"] + allowed()
    a, b, logz = crf(z, trans, mask)
    batch, time, n = z.shape
    rows, steps = np.arange(batch)[:, None], np.arange(time)[None]
    scale = np.float32(8.0 / mask.sum())
    marg = np.exp(a + b - logz[:, None, None]) * mask[:, :, None]
    dz = marg.copy()
    dz[rows, steps, y] -= mask
    dt = np.zeros_like(trans)
    gold = (z[rows, steps, y] * mask).sum() - logz.sum()
    for t in range(1, time):
        m = mask[:, t]
        pair = np.exp(a[:, t - 1, :, None] + trans[None] + (z[:, t] + b[:, t])[:, None, :] - logz[:, None, None])
        dt += (pair * m[:, None, None]).sum(0)
        np.add.at(dt, (y[:, t - 1], y[:, t]), -m)
        gold += (trans[y[:, t - 1], y[:, t]] * m).sum()
    return float(-gold / mask.sum()), (dz * scale).astype(np.float32), {"trans": (dt * scale).astype(np.float32)}


def viterbi(z: np.ndarray, trans: np.ndarray) -> np.ndarray:
    best, back = z[0], np.empty(z.shape, np.int64)
    for t in range(1, len(z)):
        s = best[:, None] + trans
        back[t] = s.argmax(0)
        best = s.max(0) + z[t]
    out = np.empty(len(z), np.int64)
    out[-1] = best.argmax()
    for t in range(len(z) - 1, 0, -1):
        out[t - 1] = back[t, out[t]]
    return out


def stretches(text: str) -> list[tuple[int, int]]:
    """Joined neighbourhoods of digits and at signs."""
    out: list[tuple[int, int]] = []
    for m in _TRIGGER.finditer(text):
        a, b = max(0, m.start() - REACH), min(len(text), m.end() + REACH)
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def worth_reading(piece: str, spans: list[Span]) -> bool:
    """Whether a stretch could hold a span that the rules have not found: seven digits, or an at sign, beyond theirs."""
    left = list(piece)
    for _, a, b in spans:
        left[a:b] = " " * (b - a)
    return sum(c.isdigit() for c in left) >= 7 or "@" in left


def windows(a: int, b: int) -> list[tuple[int, int]]:
    """Overlapping windows over a stretch."""
    starts = [*range(a, max(a + 1, b - SPAN + STRIDE), STRIDE)]
    return [(s, min(s + SPAN, b)) for s in starts]


def decode(text: str, pieces: list[tuple[int, int]], p: dict) -> list[tuple[Span, float]]:
    """Spans of the model with their mean marginal, over whole stretches."""
    wins = [(i, s, e) for i, (a, b) in enumerate(pieces) for s, e in windows(a, b)]
    if not wins:
        return []
    scores = [np.zeros((b - a, TAGS), np.float32) for a, b in pieces]
    weight = [np.zeros((b - a, 1), np.float32) for a, b in pieces]
    table_f, table_b = p["wx_f"] + p["b_f"], p["wx_b"] + p["b_b"]
    c = codes(text)
    for at in range(0, len(wins), 256):
        group = wins[at : at + 256]
        n = max(e - s for _, s, e in group)
        x, mask = np.zeros((len(group), n), np.int64), np.zeros((len(group), n), np.float32)
        for row, (_, s, e) in enumerate(group):
            x[row, : e - s], mask[row, : e - s] = c[s:e], 1
        z = lstm.scores(p, table_f[x], table_b[x], mask)
        for row, (i, s, e) in enumerate(group):
            k = np.arange(e - s)
            near = np.minimum(k, k[::-1])[:, None].astype(np.float32) + 1
            o = s - pieces[i][0]
            scores[i][o : o + e - s] += z[row, : e - s] * near
            weight[i][o : o + e - s] += near
    trans = p["trans"] + allowed()
    out: list[tuple[Span, float]] = []
    for (a, _), z, w in zip(pieces, scores, weight, strict=True):
        z = z / w
        y = viterbi(z, trans)
        if not y.any():
            continue
        f, b, logz = crf(z[None], trans, np.ones((1, len(z)), np.float32))
        marg = np.exp(f + b - logz)[0]
        t = 0
        while t < len(y):
            if y[t] % 2 == 1:
                e = t + 1
                while e < len(y) and y[e] == y[t] + 1:
                    e += 1
                out.append(((KINDS[(y[t] - 1) // 2], a + t, a + e), float(marg[np.arange(t, e), y[t:e]].mean())))
                t = e
            else:
                t += 1
    return out


def all_spans(text: str, p: dict | None) -> tuple[list[Span], list[Span]]:
    """(rule spans, all spans)."""
    base = rule_spans(text)
    if p is None:
        return base, base
    pieces = []
    for a, b in stretches(text):
        inside = [(k, max(s, a) - a, min(e, b) - a) for k, s, e in base if s < b and e > a]
        if worth_reading(text[a:b], inside):
            pieces.append((a, b))
    more = []
    for (k, a, b), sure in decode(text, pieces, p):
        if sure >= MARGINAL and not any(s < b and a < e for _, s, e in base) and plausible(k, text[a:b]):
            more.append((k, a, b))
    return base, ordered(base + more)


def plausible(kind: str, match: str) -> bool:
    if kind == "email":
        return "@" in match and "." in match.rpartition("@")[2] and not match.startswith("@")
    if kind == "ip":
        return match.count(".") == 3 and all(x.isdigit() for x in match.split(".")) and valid(kind, match)
    return valid(kind, match) and (kind != "phone" or not re.fullmatch(r"[0-9]+", match))


# --- training ---


def _varied(kind: str, match: str, rng: np.random.Generator) -> str:
    digits = re.sub(r"[^0-9]", "", match)
    if kind == "phone":
        d = digits[-10:]
        forms = ("({}) {}-{}", "{}-{}-{}", "{}.{}.{}", "{} {} {}", "+1 {} {} {}", "+1-{}-{}-{}", "1-{}-{}-{}", "({}){}-{}")
        return str(rng.choice(forms)).format(d[:3], d[3:6], d[6:])
    if kind == "card" and rng.random() < 0.5:
        return str(rng.choice([" ", "-"])).join(digits[i : i + 4] for i in range(0, len(digits), 4))
    return match


def training_windows(texts: list[str], seed: int = 11) -> list[tuple[str, list[Span]]]:
    """(window, spans): neighbourhoods of rule spans with varied formats, and of other digits. The draws of a text depend on
    the text alone, so neither the order of the texts nor their batches matter."""
    out: list[tuple[str, list[Span]]] = []
    other = ("2024-01-31", "12:30", "3,456,789.50", "v2.10.3", "1998-2005", "No. 12345678", "0x7f3a99b1", "1/2/1999", "000-12", "ISBN 9783161484100")
    for text in texts:
        rng = np.random.default_rng([seed, zlib.crc32(text.encode("utf-8", "surrogatepass")), len(text)])
        base = rule_spans(text)
        for k, a, b in base:
            lo, hi = max(0, a - int(rng.integers(4, 40))), min(len(text), b + int(rng.integers(4, 40)))
            if any(s < hi and e > lo and (s, e) != (a, b) for _, s, e in base):
                continue
            match = _varied(k, text[a:b], rng) if rng.random() < 0.7 else text[a:b]
            piece = text[lo:a] + match
            spans = [(k, a - lo, a - lo + len(match))]
            if rng.random() < 0.25:
                second = _varied(k, text[a:b], rng)
                spans.append((k, len(piece) + 1, len(piece) + 1 + len(second)))
                piece += " " + second
            out.append((piece + text[b:hi], spans))
            if rng.random() < 0.6:
                out.append((text[lo:a] + str(rng.choice(other)) + text[b:hi], []))
        for a, b in stretches(text):
            if not any(s < b and e > a for _, s, e in base) and rng.random() < 0.25:
                out.append((text[a : min(b, a + SPAN)], []))
    return out


def fit(data: list[tuple[str, list[Span]]], seed: int = 11, epochs: int = 10) -> dict | None:
    if not any(s for _, s in data):
        return None
    rng = np.random.default_rng(seed)
    p = lstm.init(rng, 128, HIDDEN, TAGS)
    p["trans"] = np.zeros((TAGS, TAGS), np.float32)
    adam = lstm.Adam(p)
    xs = [codes(t) for t, _ in data]
    ys = [tags_of(len(t), s) for t, s in data]
    groups = list(lstm.batches([len(x) for x in xs], 1_500))
    for epoch in range(epochs):
        adam.rate = 1.5e-2 * 0.85**epoch
        for k in rng.permutation(len(groups)):
            n = max(len(xs[i]) for i in groups[k])
            x, y, mask = (np.zeros((len(groups[k]), n), t) for t in (np.int64, np.int64, np.float32))
            for row, i in enumerate(groups[k]):
                x[row, : len(xs[i])], y[row, : len(xs[i])], mask[row, : len(xs[i])] = xs[i], ys[i], 1
            adam.step(lstm.gradients(p, one_hot(x) * mask[:, :, None], mask, lambda z, y=y, mask=mask: crf_loss(z, y, mask, p))[1])
    return p


def train(docs: DataFrame, limit: int = MAX_DOCS) -> dict | None:
    """Rule spans of at most ``limit`` documents, cut to their neighbourhoods where the texts lie: the driver gets at most
    ``MAX_WINDOWS`` windows of a few dozen characters."""

    def cut(frames):
        for f in frames:
            data = training_windows([t or "" for t in f["text"]])
            if not data:  # a column without values has no type that Arrow could take for a string
                continue
            yield pd.DataFrame({"piece": [t for t, _ in data], "spans": [as_text(s) for _, s in data]})

    chosen = docs.select("doc_id", "text").where(F.col("text").rlike("[0-9@]")).where(F.col("doc_id").isNotNull())
    keys = chosen.select("doc_id").distinct().orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(limit)
    sample = chosen.join(F.broadcast(keys), "doc_id").select("text")
    rows = sample.mapInPandas(cut, "piece string, spans string").orderBy(F.md5("piece"), "piece", "spans").limit(MAX_WINDOWS).collect()
    return fit([(r["piece"], [(k, int(a), int(b)) for k, a, b in (s.split(":") for s in r["spans"].split(",") if s)]) for r in rows])


def find(docs: DataFrame, p: dict | None) -> DataFrame:
    """All columns of ``docs`` in ``_row``, with struct ``_pii`` (base, spans): joined span lists."""

    @F.pandas_udf("base string, spans string")
    def found(text: pd.Series) -> pd.DataFrame:
        both = [all_spans(t or "", p) for t in text]
        return pd.DataFrame({"base": [as_text(a) for a, _ in both], "spans": [as_text(b) for _, b in both]})

    # found once, below the projections that read it
    return docs.select(F.struct("*").alias("_row")).select("_row", F.explode(F.array(found("_row.text"))).alias("_pii"))


def report(docs: DataFrame, p: dict | None) -> DataFrame:
    base = F.split("_pii.base", ",")
    count = lambda k: F.size(F.filter(base, lambda x: x.startswith(f"{k}:"))).cast("bigint").alias(f"n_{k}")
    return find(docs, p).select(
        F.col("_row.doc_id").alias("doc_id"), *[count(k) for k in KINDS], F.sha2("_pii.base", 256).alias("base_sha256"), F.col("_pii.spans").alias("spans"))


def mask(text: str, spans: list[Span]) -> str:
    """The text with every span replaced by its kind in brackets; of overlapping spans the first one names the stretch."""
    out, at = [], 0
    for k, a, b in spans:
        if a >= at:
            out.append(text[at:a] + f"<{k}>")
        at = max(at, b)
    return "".join(out) + text[at:]


def masked(docs: DataFrame, p: dict | None) -> DataFrame:
    """The documents with personal data replaced; null texts stay null, every other column as it came, n_chars recounted
    where the column exists."""

    @F.pandas_udf("string")
    def clean(text: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else mask(t, all_spans(t, p)[1]) for t in text])

    out = docs.withColumn("text", clean("text"))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
