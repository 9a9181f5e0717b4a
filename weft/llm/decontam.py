"""Benchmark decontamination by a distributed positional inverted index.

The index holds postings (term, document, position) of the training texts, written once to the shared folder and sorted by
term inside each segment. It is restricted to the terms that the search starts from: for every window of a benchmark item
its rarest terms, by their counts over the whole corpus. A search takes the postings of a window's rarest term, shifts
them by the term's place in the item - which gives (document, item, shift) alignments - and intersects them with the
shifted postings of the next rarest term. What survives is compared word by word with the document, which yields exact
phrase matches; ``proximity_matches`` answers from postings alone: a window's two rarest terms in the item's order, at most
``SLOP`` words nearer or farther apart than there (so a passage with words put in, left out or changed between them is near).

DataFrame functions only. A frequent term is read only if a window has nothing rarer; alignments are one row for each
occurrence and item place, never pairs of documents; the item side is broadcast only below a counted size. A document's row
holds the words of each item aligned with it once, and one number for each alignment.

Defined cases: null or empty text has no words, so nothing matches; items without words are never found; an item of fewer
words than a window is one window; equal item ids count once; repeated document rows get equal results; extra columns do
not matter. Documents are told apart by (id, 64-bit text hash).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.functions.lineage import materialize
from weft.llm.text import lower_ascii, maybe_broadcast, once, row_key

WINDOW = 10
SLOP = 5
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def tokens(text: Column) -> Column:
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), SEPARATORS), "")


def items_table(benchmark: DataFrame) -> DataFrame:
    """(_item, item_id, words) of items with words; ``_item`` is a row number of this run, kept by writing the table."""
    rows = benchmark.select(F.col("item_id").cast("string").alias("item_id"), tokens(F.col("text")).alias("words"))
    return materialize(rows.where(F.size("words") > 0).withColumn("_item", F.monotonically_increasing_id()), "items")


def term_counts(docs: DataFrame, terms: DataFrame, n_terms: int) -> DataFrame:
    """(term, count) over the whole corpus, for the terms asked for."""
    each = docs.select(F.explode(tokens(F.col("text"))).alias("term"))
    return each.join(maybe_broadcast(terms, n_terms), "term", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("n"))


def rarest_terms(items: DataFrame, counts: DataFrame, window: int = WINDOW, rarest: int = 2) -> DataFrame:
    """(_item, first, second, first_term, second_term): for every window of an item its two rarest places, one row for each
    distinct choice. A window of one word has no second place."""
    placed = items.select("_item", F.posexplode("words").alias("pos", "term")).join(counts, "term", "left")
    ranked = placed.groupBy("_item").agg(F.array_sort(F.collect_list(
        F.struct("pos", F.coalesce("n", F.lit(0).cast("bigint")).alias("n"), "term"))).alias("places"))
    size = F.size("places")
    choices = F.array_distinct(F.transform(
        F.sequence(F.lit(0), F.greatest(F.lit(0), size - window)),
        lambda s: F.transform(
            F.slice(F.array_sort(F.transform(F.slice("places", s + 1, window), lambda x: F.struct(x["n"], x["term"], x["pos"]))), 1, rarest),
            lambda x: x["pos"]),
    ))
    term = lambda i: F.get("places", F.col(i))["term"]
    return (
        ranked.select("_item", "places", F.explode(choices).alias("c"))
        .select("_item", "places", F.get("c", F.lit(0)).alias("first"), F.get("c", F.lit(1)).alias("second"))
        .select("_item", "first", "second", term("first").alias("first_term"), F.when(F.col("second").isNotNull(), term("second")).alias("second_term"))
    )


def build_index(docs: DataFrame, terms: DataFrame | None = None, n_terms: int = 0) -> DataFrame:
    """Postings (term, _d, _h, pos), of all terms or of those given, written as segments sorted by term."""
    each = docs.select(*row_key(), F.posexplode(tokens(F.col("text"))).alias("pos", "term"))
    if terms is not None:
        each = each.join(maybe_broadcast(terms, n_terms), "term", "left_semi")
    return materialize(each.select("term", "_d", "_h", "pos").sortWithinPartitions("term", "_d", "_h", "pos"), "postings")


def alignments(index: DataFrame, anchors: DataFrame) -> DataFrame:
    """Distinct (_d, _h, _item, shift) at which some window's two rarest terms stand at their places."""
    n = anchors.count()
    first = anchors.select("_item", "first", "second", F.col("first_term").alias("term"), "second_term")
    hits = index.join(maybe_broadcast(first, n), "term").select(
        "_d", "_h", "_item", (F.col("pos") - F.col("first")).alias("shift"), "second", "second_term").distinct()
    alone = hits.where(F.col("second").isNull())
    more = hits.where(F.col("second").isNotNull()).select(
        "_d", "_h", "_item", "shift", F.col("second_term").alias("term"), (F.col("shift") + F.col("second")).alias("pos"))
    both = more.join(index, ["_d", "_h", "pos", "term"], "left_semi")
    keys = ["_d", "_h", "_item", "shift"]
    return alone.select(*keys).unionAll(both.select(*keys)).distinct()


def proximity_matches(index: DataFrame, anchors: DataFrame, slop: int = SLOP) -> DataFrame:
    """(_d, _h, _item, start, gap): places where a window's two rarest terms stand in order, at most ``slop`` words nearer
    or farther apart than in the item. Both posting lists are cut to buckets of positions, so only neighbours meet."""
    n = anchors.count()
    pairs = anchors.where("second is not null").select(
        "_item", F.col("first_term").alias("term"), "second_term", (F.col("second") - F.col("first")).alias("want")).distinct()
    wide = 2 * slop + 1
    want = F.col("start") + F.col("want")
    a = (
        index.withColumnRenamed("pos", "start").join(maybe_broadcast(pairs, n), "term")
        .select("_d", "_h", "_item", F.col("second_term").alias("term"), "start", "want", F.explode(
            F.array_distinct(F.array(F.floor((want - slop) / wide), F.floor((want + slop) / wide)))).alias("b"))
    )
    seconds = pairs.select(F.col("second_term").alias("term")).distinct()
    b = index.join(maybe_broadcast(seconds, n), "term", "left_semi").withColumn("b", F.floor(F.col("pos") / wide))
    gap = F.col("pos") - F.col("start")
    near = a.join(b, ["_d", "_h", "term", "b"]).where((F.abs(gap - F.col("want")) <= slop) & (F.signum(gap) == F.signum("want")))
    return near.select("_d", "_h", "_item", "start", gap.alias("gap")).distinct()


def near_counts(items: DataFrame, anchors: DataFrame, index: DataFrame, slop: int = SLOP) -> DataFrame:
    """(_d, _h, n_near): how many item ids have a proximity match in a document, for documents with any."""
    found = proximity_matches(index, anchors, slop).select("_d", "_h", "_item").distinct()
    names = items.select("_item", "item_id")
    named = found.join(maybe_broadcast(names, names.count()), "_item").select("_d", "_h", "item_id").distinct()
    return named.groupBy("_d", "_h").agg(F.count(F.lit(1)).alias("n_near"))


def search_tables(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(items, anchors, index) of a search, each written once."""
    items = items_table(benchmark)
    vocabulary = materialize(items.select(F.explode("words").alias("term")).distinct(), "vocabulary")
    counts = term_counts(docs, vocabulary, vocabulary.count())
    anchors = materialize(rarest_terms(items, counts, window), "anchors")
    terms = anchors.select(F.col("first_term").alias("term")).unionAll(anchors.select("second_term")).where("term is not null").distinct()
    terms = materialize(terms, "terms")
    return items, anchors, build_index(docs, terms, terms.count())


def candidates(items: DataFrame, anchors: DataFrame, index: DataFrame) -> DataFrame:
    """(_d, _h, found): for each document with alignments the list of (item_id, words, shifts), one entry for each item."""
    shifts = alignments(index, anchors).groupBy("_d", "_h", "_item").agg(F.collect_list("shift").alias("shifts"))
    return shifts.join(items, "_item").groupBy("_d", "_h").agg(F.collect_list(F.struct("item_id", "words", "shifts")).alias("found"))


def _hits(doc: Column, c: Column, window: int) -> Column:
    """Document places of the words of the item's windows that stand in the document at one of the item's shifts."""
    n = F.size(c["words"])
    length = F.least(n, F.lit(window))

    def at(shift: Column) -> Column:
        starts = F.filter(
            F.sequence(F.lit(0), n - length),
            lambda s: (shift + s >= 0) & (F.slice(doc, F.greatest(shift + s, F.lit(0)) + 1, length) == F.slice(c["words"], s + 1, length)),
        )
        return F.flatten(F.transform(starts, lambda s: F.sequence(shift + s, shift + s + length - 1)))

    return F.array_distinct(F.flatten(F.transform(c["shifts"], at)))


def exact_matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, tables: tuple[DataFrame, DataFrame, DataFrame] | None = None) -> DataFrame:
    """All columns of ``docs`` in ``_row``, with its row key, n_words, hit word positions (``hits``) and the item ids found
    (``items``). ``tables`` are those of ``search_tables``, where they exist already."""
    found = candidates(*(tables or search_tables(docs, benchmark, window)))
    rows = docs.select(F.struct("*").alias("_row")).select("_row", *row_key("_row.doc_id", "_row.text"))
    joined = rows.join(found, ["_d", "_h"], "left").withColumn("_w", tokens(F.col("_row.text")))
    matched = F.when(F.col("found").isNotNull(), F.filter(F.transform("found", lambda c: F.struct(
        c["item_id"].alias("item_id"), _hits(F.col("_w"), c, window).alias("at"))), lambda m: F.size(m["at"]) > 0))
    return once(
        joined.withColumn("_m", matched), "_d", "_h", F.size("_w").cast("bigint").alias("n_words"),
        F.coalesce(F.array_distinct(F.flatten(F.transform("_m", lambda m: m["at"]))), F.array().cast("array<int>")).alias("hits"),
        F.coalesce(F.array_sort(F.array_distinct(F.transform("_m", lambda m: m["item_id"]))), F.array().cast("array<string>")).alias("items"),
    )


def report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, slop: int | None = None) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) of every document; with ``slop`` also n_near, the number
    of item ids with a proximity match, which does not decide about ``contaminated``."""
    tables = search_tables(docs, benchmark, window)
    m = exact_matches(docs, benchmark, window, tables)
    ids = F.filter("items", lambda x: x.isNotNull())
    digest = m.select(
        "_d", "_h", F.col("_row.doc_id").alias("doc_id"), "n_words", F.size("hits").cast("bigint").alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"),
    )
    if slop is None:
        return digest.drop("_d", "_h")
    return digest.join(near_counts(*tables, slop), ["_d", "_h"], "left").drop("_d", "_h").withColumn("n_near", F.coalesce("n_near", F.lit(0).cast("bigint")))


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without any benchmark window, with the columns they came with."""
    return exact_matches(docs, benchmark).where(F.size("hits") == 0).select("_row.*")
