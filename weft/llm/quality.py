"""Quality rules by distribution divergence.

A document's histogram over character classes and its histogram over common words are compared with the reference
histograms of its language by Jensen-Shannon distance. The references come from the corpus itself: for each language and
bin the median over all documents of the bin's share, so that up to half of the documents may be junk. Both tests have a
minimum-length guard: a short text has no stable histogram and is judged by the base rules alone.

Everything is DataFrame functions: one scan for the features, one small aggregate for the references.

Defined cases: null or empty text has no words and fails the base rule; a language that is unknown (or null) is compared
with every reference and the nearest counts; a language without any long enough document has no reference; with no
reference at all only the base rules decide; repeated rows are judged alike; extra columns do not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.llm.text import SPACE_CHARS, let, once, words

# Common words of the languages that have a reference.
COMMON_WORDS = {
    "en": "the of and to a in is that for it was on as with be by at this from are".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als".split(),
    "fr": "de la le et les des en un du une que est pour qui dans au par sur pas avec".split(),
    "es": "de la que el en y a los se del las un por con no una su para es al".split(),
}
VOCABULARY = sorted({w for ws in COMMON_WORDS.values() for w in ws})
# Character classes beside space and letter (everything else).
CLASSES = {"upper": r"\p{Lu}", "digit": "[0-9]", "stop": r"[.,;:!?'\"()-]", "symbol": r"[#*$%&|<>@_=+~^`/\\{}\[\]]"}

MIN_WORDS = 10
REPEAT_PERCENT = 20
WINDOW = 5
GUARD_CHARS = 200
GUARD_WORDS = 50
# Beyond either of the first two a document goes; beyond both of the second two as well.
MAX_CLASS_DISTANCE, MAX_WORD_DISTANCE = 0.30, 0.48
BOTH_CLASS_DISTANCE, BOTH_WORD_DISTANCE = 0.18, 0.29


def repeated_words(w: Column, k: int = WINDOW) -> Column:
    """Words covered by k-word windows that occur twice or more, all occurrences counted. Windows are compared by a
    64-bit hash inside one text."""

    def hashes(v: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), F.size(v) - k), lambda i: F.xxhash64(*[F.get(v, i + j) for j in range(k)])
        )

    def covered(h: Column) -> Column:
        ordered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return let(ordered, lambda o: let(F.sort_array(F.transform(
            F.filter(o, lambda e, j: F.coalesce(F.get(o, j - 1)["h"] == e["h"], F.lit(False))
                     | F.coalesce(F.get(o, j + 1)["h"] == e["h"], F.lit(False))),
            lambda e: e["i"],
        )), lambda p: F.aggregate(
            F.transform(p, lambda x, j: F.coalesce(F.least(F.get(p, j + 1) - x, F.lit(k)), F.lit(k))),
            F.lit(0), lambda a, x: a + x,
        )))

    return F.when(F.size(w) <= k, F.lit(0)).otherwise(
        let(hashes(w), lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h)))
    )


def _counts(common: Column) -> Column:
    """How often each word of the vocabulary occurs in an array that holds no other word."""
    return F.array(*[F.size(common) - F.size(F.array_remove(common, w)) for w in VOCABULARY])


def features(docs: DataFrame) -> DataFrame:
    """All columns of ``docs`` in the struct ``_row``, beside base counts and the two histograms (``_classes``, ``_common``)."""
    text = F.coalesce(F.col("_row.text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACE_CHARS)) != "")
    one = (
        docs.select(F.struct("*").alias("_row"))
        .withColumn("_w", words(text))
        .withColumn("_common", F.filter(
            F.transform("_w", lambda x: F.lower(F.rtrim(x, F.lit(".,;:!?")))), lambda x: x.isin(VOCABULARY)))
        .withColumn("n_words", F.size("_w").cast("bigint"))
        .withColumn("word_chars", F.length(F.array_join("_w", "")).cast("bigint"))
        .withColumn("n_symbols", F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("bigint"))
        .withColumn("n_dup_lines", let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("bigint"))
        .withColumn("n_repeat_words", repeated_words(F.col("_w")).cast("bigint"))
        .withColumn("_chars", F.length(text))
    )
    counted = [F.regexp_count(text, F.lit(c)) for c in CLASSES.values()]
    space = F.col("_chars") - F.col("word_chars")
    classes = let(F.array(*counted, space.cast("int")), lambda c: F.concat(
        c, F.array((F.col("_chars") - F.aggregate(c, F.lit(0), lambda a, x: a + x)).cast("int"))))
    common = let(_counts(F.col("_common")), lambda c: F.concat(
        c, F.array((F.col("n_words") - F.aggregate(c, F.lit(0), lambda a, x: a + x)).cast("int"))))
    return once(
        one, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "_chars",
        classes.alias("_classes"), common.alias("_common"),
        ((F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))).alias("base_failed"),
    )


def references(feats: DataFrame) -> dict[str, dict[str, list[float]]]:
    """{"_classes" | "_common": {language: shares}}: medians, to a thousandth, over all documents that pass the length
    guards. The aggregate holds at most languages x bins x 1,001 groups and the driver gets languages x bins rows."""
    long = feats.where((F.col("_chars") >= GUARD_CHARS) & (F.col("n_words") >= GUARD_WORDS)).where(
        F.col("_row.lang").isin(list(COMMON_WORDS)))
    shares = F.concat(
        F.transform("_classes", lambda x: F.round(1000 * x / F.col("_chars"))),
        F.transform("_common", lambda x: F.round(1000 * x / F.col("n_words"))),
    )
    rows = (
        long.select(F.col("_row.lang").alias("lang"), F.posexplode(shares).alias("bin", "v"))
        .groupBy("lang", "bin", "v").agg(F.count(F.lit(1)).alias("n"))
        .groupBy("lang", "bin").agg(F.expr("percentile(v, 0.5, n)").alias("m"))
        .collect()
    )
    medians: dict[str, dict[int, float]] = {}
    for r in rows:
        medians.setdefault(r["lang"], {})[r["bin"]] = r["m"]
    n = len(CLASSES) + 2
    out: dict[str, dict[str, list[float]]] = {"_classes": {}, "_common": {}}
    for lang, m in sorted(medians.items()):
        values = [m[i] for i in range(len(m))]
        for name, part in (("_classes", values[:n]), ("_common", values[n:])):
            out[name][lang] = [x / sum(part) for x in part]
    return out


def _half(a: Column, b: Column) -> Column:
    return F.when(a > 0, a * F.log2(2 * a / (a + b))).otherwise(F.lit(0.0))


def divergence(counts: str, total: str, refs: dict[str, list[float]]) -> Column:
    """Jensen-Shannon distance (base 2) to the reference of the document's language, or else to the nearest reference."""

    def one(ref: list[float]) -> Column:
        pairs = F.zip_with(
            F.col(counts), F.array(*[F.lit(x) for x in ref]),
            lambda c, q: let(c / F.col(total), lambda p: _half(p, q) + _half(q, p)),
        )
        return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(pairs, F.lit(0.0), lambda a, x: a + x) / 2))

    if not refs:
        return F.lit(0.0)
    each = {lang: one(ref) for lang, ref in refs.items()}
    out = None
    for lang, d in each.items():
        out = F.when(F.col("_row.lang") == lang, d) if out is None else out.when(F.col("_row.lang") == lang, d)
    return out.otherwise(F.least(*each.values()) if len(each) > 1 else next(iter(each.values())))


def judge(feats: DataFrame, refs: dict[str, dict[str, list[float]]]) -> DataFrame:
    """Adds ``class_distance`` and ``word_distance`` (0 below their guards) and ``kept``."""
    return (
        feats.withColumn("class_distance", F.when(
            F.col("_chars") >= GUARD_CHARS, divergence("_classes", "_chars", refs["_classes"])).otherwise(F.lit(0.0)))
        .withColumn("word_distance", F.when(
            F.col("n_words") >= GUARD_WORDS, divergence("_common", "n_words", refs["_common"])).otherwise(F.lit(0.0)))
        .withColumn("kept", ~F.col("base_failed") & (F.col("class_distance") <= MAX_CLASS_DISTANCE)
                    & (F.col("word_distance") <= MAX_WORD_DISTANCE)
                    & ((F.col("class_distance") <= BOTH_CLASS_DISTANCE) | (F.col("word_distance") <= BOTH_WORD_DISTANCE)))
    )


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that every rule keeps, with the columns they came with."""
    feats = features(docs)
    return judge(feats, references(feats)).where("kept").select("_row.*")
