"""Toxicity by a weighted lexicon.

Text is folded first: lower case, look-alike letters of other scripts and digits that stand for letters become the plain
letter, everything that is no letter becomes a space. The lexicon's stems, which begin at a word start, are then found in
one Aho-Corasick pass; hits inside an exception phrase do not count. The weighted hits, plain and per hundred words, go
through a logistic function.

Stems, weights, exception phrases and the logistic's three numbers are learned from a bounded sample of labelled rows
(``MAX_LABELLED``, chosen by a hash of the id): partial counts are made where the texts lie and summed by Spark, and the driver
gets at most ``MAX_STEMS`` stems, ``MAX_EXCEPTIONS`` phrases and one row of three numbers for each sampled document. Every
document is then scored over its whole text.

Defined cases: null and empty texts have no hit and get the base score; without usable labels no stem is learned and every
score is the prior; repeated rows get equal scores; labels of ids without a document, and null labels, are left out.
"""

from __future__ import annotations

import json
import math
import unicodedata
from collections import Counter
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.functions.lineage import materialize

MAX_LABELLED = 10_000
MAX_STEMS = 2_000
MAX_EXCEPTIONS = 1_000
MIN_TOXIC = 4
MIN_SHARE = 0.02  # of the sampled toxic documents: rarer stems are chance
MIN_Z = 4.0
STEM_LENGTHS = range(3, 13)
# Letters of other scripts that look like Latin ones, and digits and signs that stand for letters.
LOOKALIKES = dict(zip("аерсхуоіјѕԁһкмтвнαεορνικτυχ", "aepcxyoijsdhkmtbhaeopvikTux".lower(), strict=True))
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a"}


class _Fold(dict):
    """Translation table that works out a character when it first meets it."""

    def __missing__(self, code: int):
        ch = chr(code)
        plain = LOOKALIKES.get(ch) or SUBSTITUTES.get(ch)
        if plain is None:
            wide = unicodedata.normalize("NFKC", ch).lower()
            plain = LOOKALIKES.get(wide) or SUBSTITUTES.get(wide) or (wide if wide.isalpha() else "" if unicodedata.category(ch) in ("Mn", "Cf") else " ")
        self[code] = plain
        return plain


FOLD = _Fold()


def fold(text: str) -> str:
    return f" {text.lower().translate(FOLD)} "


def stems(folded: str) -> set[str]:
    """Word starts of the lengths that the lexicon may hold."""
    return {f" {w[:k]}" for w in set(folded.split()) for k in STEM_LENGTHS if k <= len(w)}


@lru_cache(maxsize=4)
def _automaton(model: str):
    import ahocorasick

    m = json.loads(model)
    found = ahocorasick.Automaton()
    for s, w in m["stems"].items():
        found.add_word(s, (len(s), w))
    for s in m["exceptions"]:
        found.add_word(s, (len(s), None))
    if len(found):
        found.make_automaton()
    return found


def hits(folded: str, model: str) -> list[tuple[int, int, float]]:
    """(start, end, weight) of stems outside exception phrases; of stems that begin at one place the longest counts."""
    found = _automaton(model)
    if not len(found):
        return []
    best: dict[int, tuple[int, float]] = {}
    safe: list[tuple[int, int]] = []
    for end, (n, w) in found.iter(folded):
        start = end - n + 1
        if w is None:
            safe.append((start, end))
        elif start not in best or best[start][0] < end:
            best[start] = (end, w)
    # a hit is safe if a phrase that begins no later ends no earlier: the furthest end up to each place tells
    safe.sort()
    furthest, out, i = 0, [], 0
    for s, (e, w) in sorted(best.items()):
        while i < len(safe) and safe[i][0] <= s:
            furthest = max(furthest, safe[i][1])
            i += 1
        if furthest < e:
            out.append((s, e, w))
    return out


def measures(text: str | None, model: str) -> tuple[float, float]:
    folded = fold(text or "")
    total = sum(w for _, _, w in hits(folded, model))
    if not total:
        return 0.0, 0.0
    return math.log1p(total), math.log1p(100 * total / max(len(folded.split()), 20))


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "UTF-8")) % 5 == 0


def _sample(docs: DataFrame, labels: DataFrame, limit: int) -> DataFrame:
    """(text, toxic) of at most ``limit`` labelled rows outside the held-out fifth. Broadcast: bounded by ``limit``."""
    chosen = (
        labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
        .orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(limit)
    )
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "toxic")


def _counted(sample: DataFrame, keys) -> DataFrame:
    """(key, tox, non): documents of each class that have a key. ``keys``: folded text -> set of strings."""

    def partial(frames):
        for f in frames:
            by = (Counter(), Counter())
            for text, toxic in zip(f["text"], f["toxic"], strict=True):
                by[int(toxic != 0)].update(keys(fold(text or "")))
            names = [*(by[0].keys() | by[1].keys())]
            if not names:  # a column without values has no type that Arrow could take for a string
                continue
            yield pd.DataFrame({"key": names, "tox": [by[1][k] for k in names], "non": [by[0][k] for k in names]})

    part = sample.mapInPandas(partial, "key string, tox bigint, non bigint")
    return part.groupBy("key").agg(F.sum("tox").alias("tox"), F.sum("non").alias("non"))


def _logistic(x: np.ndarray, y: np.ndarray, steps: int = 50, ridge: float = 1e-2) -> list[float]:
    x = np.c_[np.ones(len(x)), x]
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        w = w - np.linalg.solve(h, x.T @ (p - y) + ridge * w)
    return w.tolist()


def train(docs: DataFrame, labels: DataFrame, limit: int = MAX_LABELLED) -> str:
    """The model as JSON: stems with weights, exception phrases, logistic."""
    sample = materialize(_sample(docs, labels, limit), "labelled")  # read four times below
    totals = {r["t"]: r["n"] for r in sample.groupBy((F.col("toxic") != 0).alias("t")).agg(F.count(F.lit(1)).alias("n")).collect()}
    n_tox, n_non = totals.get(True, 0), totals.get(False, 0)
    model: dict = {"stems": {}, "exceptions": [], "logistic": [math.log((n_tox + 1) / (n_non + 10)), 0.0, 0.0]}
    if not n_tox or not n_non:
        return json.dumps(model)
    a, b = F.col("tox") + 0.5, F.col("non") + 0.5
    odds = F.log(a / (n_tox + 1 - F.col("tox"))) - F.log(b / (n_non + 1 - F.col("non")))
    spread = F.sqrt(1 / a + 1 / b)
    rows = (
        _counted(sample, stems).where(F.col("tox") >= max(MIN_TOXIC, MIN_SHARE * n_tox)).withColumn("w", odds).where(odds / spread >= MIN_Z)
        .orderBy(F.desc(F.col("w") / spread), "key").limit(MAX_STEMS).collect()
    )
    support = {r["key"]: r["tox"] for r in rows}
    # of nested stems with the same support the longest stays
    nested = {k for k in support for j in range(4, len(k)) if support.get(k[:j]) == support[k] for k in [k[:j]]}
    model["stems"] = {r["key"]: round(r["w"], 4) for r in rows if r["key"] not in nested}
    text = json.dumps(model)

    def contexts(folded: str) -> set[str]:
        out = set()
        for s, e, _ in hits(folded, text):
            end = folded.find(" ", e)
            before = folded[: s + 1].rstrip().rfind(" ") if s else 0
            out.add(folded[max(before, 0) : end + 1])
            after = folded.find(" ", len(folded[:end]) + len(folded[end:]) - len(folded[end:].lstrip()))
            out.add(folded[s : (after if after >= 0 else len(folded)) + 1])
        return {x for x in out if len(x.split()) == 2}

    safe = _counted(sample, contexts).where("non >= 3 and tox = 0").orderBy(F.desc("non"), "key").limit(MAX_EXCEPTIONS).collect()
    model["exceptions"] = [r["key"] for r in safe]
    text = json.dumps(model)

    def measured(frames):
        for f in frames:
            m = [measures(t, text) for t in f["text"]]
            yield pd.DataFrame({"a": [x[0] for x in m], "b": [x[1] for x in m], "y": f["toxic"].ne(0).astype(float)})

    xy = np.array(sample.mapInPandas(measured, "a double, b double, y double").collect(), float).reshape(-1, 3)
    model["logistic"] = _logistic(xy[:, :2], xy[:, 2])
    return json.dumps(model)


def score(docs: DataFrame, model: str) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    w0, w1, w2 = json.loads(model)["logistic"]

    @F.pandas_udf("double")
    def scored(text: pd.Series) -> pd.Series:
        m = np.array([measures(t, model) for t in text], float).reshape(-1, 2)
        return pd.Series(1 / (1 + np.exp(-np.clip(w0 + m @ np.array([w1, w2]), -30, 30))))

    out = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), scored("text").alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
