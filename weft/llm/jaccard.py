"""Near-duplicate join of shingle sets by parity sketches.

A sketch has m words of 64 bits; a shingle XORs its hash into the word that its hash names. Two sets' sketches differ in at
most |X symmetric-difference Y| words, and Jaccard >= t bounds that by (1-t)/(1+t) (|X|+|Y|). By the pigeonhole principle
linked sets therefore agree in many words of their sketches. Size bands fix m: a set takes part in the band of its size,
and in the next one if a partner may lie there.

1. One scan makes each document's shingle set, its class (equal sets are one class) and, for its one or two bands, the
   first ``dmax + j`` non-empty sketch words in hash order: two linked sets share at least j of them. They travel in blocks,
   one for each batch and hash bucket, with a class named once for each batch.
2. Each bucket counts the classes of its sketch words; words that only one class has are dropped there.
3. A class keeps its rarest words: with j shared ones guaranteed, all but j - 1 have to be looked at, and words of one
   class alone count among those looked at. Boilerplate that many texts share comes last and is seldom reached.
4. A star join first: in each group of classes with a common word, every class is verified against the centre only, which is
   the class with the fewest words of its own. Groups that then hold one component are done; in the others pairs across
   components follow. Groups of thousands of near copies thus cost a comparison for each member, not for each pair.
   Each class also has a parity sketch of 1,024 single bits: in how many bits two sketches differ is again a lower bound of
   the symmetric difference, and the joins let only pairs through that it does not rule out.
5. Pairs are verified on the whole sets, and links become components.

Bounds: hashes have 64 bits. Sets of up to 64 shingles have one sketch word for each shingle; for larger ones the guarantee
needs more than dmax + j non-empty words of m, which fails with a chance below 1e-12.

Defined cases: null, empty and blank texts have the empty set, link with nothing and are their own component; documents of
equal sets are linked; repeated rows are; a component without any id has a null id; extra columns do not matter.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from weft.functions.lineage import cut, materialize
from weft.llm.shingles import bucket_count, by_bucket, frame, mix, shingle_set
from weft.llm.text import maybe_broadcast, row_key
from weft.operators.cluster import component_labels

PERCENT = 75
RATIO = 4  # sizes of a band
SMALL = 64  # largest set of the first band
FLUSH = 400_000  # sketch words in a block set
LONGS = 16  # of the bit sketch
HOT_COPIES = 256  # fewest copies that are dealt over parts
HOT_CLASSES = 100_000  # most classes that are


def _bands(n: int, percent: int) -> list[tuple[int, int, int]]:
    """(low, high, largest partner) of the bands of a set of n shingles: its own, and the next if partners reach it."""
    low, high = 0, SMALL
    while n > high:
        low, high = high, high * RATIO
    most = 100 * n // percent
    out = [(low, high, min(most, high))]
    if most > high:
        out.append((high, high * RATIO, most))
    return out


def sketch(h: np.ndarray, high: int) -> np.ndarray:
    """The non-empty sketch words of a set for the band that ends at ``high``, each hashed with its place."""
    if high <= SMALL:
        return np.sort(mix(h, high))
    place = h % np.uint64(high)
    order = np.argsort(place, kind="stable")
    place = place[order]
    starts = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
    words = np.bitwise_xor.reduceat(mix(h[order], 1), starts)
    return np.sort(mix(words ^ mix(place[starts], high), high))


def bit_sketch(h: np.ndarray) -> np.ndarray:
    """Parity of the set's hashes in each of LONGS * 64 places."""
    counts = np.bincount((mix(h, 2) % np.uint64(LONGS * 64)).astype(np.int64), minlength=LONGS * 64)
    return np.packbits((counts & 1).astype(np.uint8)).view(np.int64)


def sketch_words(h: np.ndarray, percent: int = PERCENT) -> list[tuple[int, int, np.ndarray]]:
    """(band end, words to look at, emitted words) for each band of a set."""
    out = []
    for low, high, most in _bands(len(h), percent):
        dmax = (100 - percent) * (len(h) + most) // (100 + percent)
        j = max(1, low // 10)
        words = sketch(h, high)[: dmax + j]
        out.append((high, dmax + 1, words))
    return out


# Rows of both kinds travel together: kind 0 is a document, kind 1 a block of sketch words (or, on the way out, one word).
# Whole numbers are never null on the way through pandas, which would turn them into floats; ``known`` tells null ids.
_EMIT = "kind int, bucket int, _d bigint, _h bigint, known boolean, n bigint, cls bigint, bits array<bigint>, words binary, classes binary, looks binary, sizes binary"
_FOUND = "kind int, _d bigint, _h bigint, known boolean, n bigint, cls bigint, bits array<bigint>, band int, word bigint, df bigint, looks int, own int"


def _emit(frames, buckets: int, percent: int):
    def blocks(parts):
        words, cls, look, size = (np.concatenate(x) for x in zip(*parts, strict=True))
        cut_ = [(b, words[r].tobytes(), cls[r].tobytes(), look[r].tobytes(), size[r].tobytes()) for b, r in by_bucket(words, buckets)]
        b, *binary = zip(*cut_, strict=True)
        yield frame(_EMIT, len(b), kind=np.ones(len(b), int), bucket=np.array(b), **dict(zip(("words", "classes", "looks", "sizes"), binary, strict=True)))

    seen: set[int] = set()
    for f in frames:
        n, classes, bits, parts, held = [], [], [], [], 0
        for text in f["text"]:
            h = shingle_set(text)
            cls = xxhash.xxh3_64_intdigest(h.tobytes()) - (1 << 63) if len(h) else 0
            n.append(len(h))
            classes.append(cls)
            bits.append(bit_sketch(h))
            if not len(h) or cls in seen:
                continue
            if len(seen) > 100_000:
                seen.clear()
            seen.add(cls)
            for high, look, words in sketch_words(h, percent):
                k = len(words)
                parts.append((words, np.full(k, cls, np.int64), np.full(k, look, np.int32), np.full(k, high * (1 << 24) + k, np.int64)))
                held += k
            if held > FLUSH:
                yield from blocks(parts)
                parts, held = [], 0
        if parts:
            yield from blocks(parts)
        classes = np.array(classes, np.int64)
        yield frame(_EMIT, len(n), bucket=np.arange(len(n)) % buckets, _d=f["_d"], _h=f["_h"], known=f["known"], n=np.array(n, np.int64), cls=classes,
                     bits=pd.Series(bits, dtype=object))


def _shared(f: pd.DataFrame) -> pd.DataFrame:
    """Documents pass through; of the sketch words those stay that two or more classes have."""
    docs, blocks = f[f["kind"] == 0], f[f["kind"] == 1]
    out = [frame(_FOUND, len(docs), **{c: docs[c].to_numpy() for c in ("_d", "_h", "known", "n", "cls", "bits")})]
    if len(blocks):
        words, cls, look, size = (
            np.concatenate([np.frombuffer(x, t) for x in blocks[c]])
            for c, t in (("words", np.uint64), ("classes", np.int64), ("looks", np.int32), ("sizes", np.int64))
        )
        order = np.lexsort((cls, words))
        words, cls, look, size = words[order], cls[order], look[order], size[order]
        first = np.r_[True, (words[1:] != words[:-1]) | (cls[1:] != cls[:-1])]
        words, cls, look, size = words[first], cls[first], look[first], size[first]
        many = np.diff(np.r_[np.flatnonzero(np.r_[True, words[1:] != words[:-1]]), len(words)])
        df = np.repeat(many, many)
        keep = df > 1
        out.append(frame(
            _FOUND, int(keep.sum()), kind=np.ones(int(keep.sum()), int), cls=cls[keep], band=size[keep] >> 24,
            word=words[keep].view(np.int64), df=df[keep], looks=look[keep], own=size[keep] & ((1 << 24) - 1)))
    return pd.concat(out, ignore_index=True)


def sketched(docs: DataFrame, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """Documents (_d, _h, doc_id, n, cls, bits), and shared sketch words (cls, band, word, df, looks, own) of their classes."""
    rows = docs.select(*row_key(), F.col("doc_id").isNotNull().alias("known"), "text")
    buckets = bucket_count(rows)
    sent = rows.mapInPandas(lambda frames: _emit(frames, buckets, percent), _EMIT)
    found = materialize(sent.groupBy("bucket").applyInPandas(_shared, _FOUND), "sketches")
    return (
        found.where("kind = 0").select("_d", "_h", F.expr("if(known, _d, null)").alias("doc_id"), "n", F.expr("if(n > 0, cls, null)").alias("cls"), "bits"),
        found.where("kind = 1").select("cls", "band", "word", "df", "looks", "own"),
    )


def per_class(found: DataFrame) -> DataFrame:
    """(cls, n, bits, copies, least, _d, _h): each class once, with its documents' number, their least id and the key of one of
    them. Copies are combined before they are shuffled."""
    one = found.where("cls is not null").groupBy("cls").agg(
        F.first("n").alias("n"), F.first("bits").alias("bits"), F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("least"), F.min(F.struct("_d", "_h")).alias("k"))
    return materialize(one.select("cls", "n", "bits", "copies", "least", "k._d", "k._h"), "classes")


def groups(classes: DataFrame, shared: DataFrame) -> DataFrame:
    """(word, cls, alone, n, bits): the rarest words of a class that have to be looked at. ``alone`` counts its words that no
    other class has; the original of many near copies has few."""
    by = Window.partitionBy("cls", "band")
    ranked = shared.withColumn("alone", F.col("own") - F.count(F.lit(1)).over(by)).withColumn("r", F.row_number().over(by.orderBy("df", "word")))
    kept = ranked.where(F.col("r") <= F.col("looks") - F.col("alone")).select("word", "cls", "alone")
    return materialize(kept.join(classes.select("cls", "n", "bits"), "cls"), "groups")


def possible(percent: int) -> Column:
    """Whether sizes (n, m) and bit sketches (bits, other) leave room for a link."""
    apart = sum((F.bit_count(F.get("bits", F.lit(i)).bitwiseXOR(F.get("other", F.lit(i)))) for i in range(1, LONGS)),
                F.bit_count(F.get("bits", F.lit(0)).bitwiseXOR(F.get("other", F.lit(0)))))
    return (
        (100 * F.least("n", "m") >= percent * F.greatest("n", "m"))
        & ((100 + percent) * apart <= (100 - percent) * (F.col("n") + F.col("m")))
    )


def shingle_sets(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """(cls, shingles, n) of the classes asked for, from one document of each."""
    reps = materialize(classes.select("cls", "_d", "_h"), "reps")
    texts = docs.select(*row_key(), "text").join(maybe_broadcast(reps, reps.count()), ["_d", "_h"]).select("cls", "text")

    @F.pandas_udf("array<bigint>")
    def shingles(text: pd.Series) -> pd.Series:
        return pd.Series([shingle_set(t).view(np.int64) for t in text])

    return materialize(texts.select("cls", shingles("text").alias("shingles")).dropDuplicates(["cls"]), "sets")


def verified(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) whose sets reach the similarity."""
    x = sets.select(F.col("cls").alias("a"), F.col("shingles").alias("x"))
    y = sets.select(F.col("cls").alias("b"), F.col("shingles").alias("y"))
    both = pairs.join(x, "a").join(y, "b").withColumn("common", F.size(F.array_intersect("x", "y")))
    return both.where(100 * F.col("common") >= percent * (F.size("x") + F.size("y") - F.col("common"))).select("a", "b")


def links(docs: DataFrame, classes: DataFrame, shared: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(a, b): verified links between classes that connect what any links connect."""
    members = groups(classes, shared)
    sets = shingle_sets(docs, classes.join(members.select("cls").distinct(), "cls", "left_semi"))
    ordered = lambda df: materialize(df.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")

    centre = members.groupBy("word").agg(F.min(F.struct("alone", "cls", "n", "bits")).alias("c"))
    centre = centre.select("word", F.col("c.cls").alias("a"), F.col("c.n").alias("m"), F.col("c.bits").alias("other"))
    star = members.join(centre, (members["word"] == centre["word"]) & (F.col("cls") != F.col("a")) & possible(percent))
    first = cut(verified(ordered(star.select("a", F.col("cls").alias("b"))), sets, percent))

    labels = component_labels(first.select(F.col("a").alias("u"), F.col("b").alias("v")))
    labels = labels.select(F.col("user_id").alias("cls"), F.col("super_id").alias("root"))
    labelled = members.join(labels, "cls", "left").withColumn("label", F.coalesce("root", "cls")).drop("root", "alone")
    labelled = materialize(labelled, "labelled")
    mixed = labelled.groupBy("word").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("word")
    open_ = labelled.join(mixed, "word", "left_semi")
    other = open_.select(F.col("word").alias("w"), F.col("cls").alias("b"), F.col("label").alias("lb"), F.col("n").alias("m"), F.col("bits").alias("other"))
    across = open_.join(other, (F.col("word") == F.col("w")) & (F.col("label") != F.col("lb")) & (F.col("cls") < F.col("b")) & possible(percent))
    second = verified(ordered(across.select(F.col("cls").alias("a"), "b")), sets, percent)
    return cut(first.unionAll(second))


def dealt(found: DataFrame, classes: DataFrame, named: DataFrame) -> DataFrame:
    """``found`` with the columns of ``named``, one row for each class. Documents of a class of many copies are dealt over parts,
    and its row goes to each part. A class counts as such above one part in ``HOT_CLASSES`` of all documents, so at most
    that many are broadcast."""
    total = classes.agg(F.sum("copies")).first()[0] or 0
    most = max(HOT_COPIES, total // HOT_CLASSES)
    hot = F.broadcast(classes.where(F.col("copies") > most).select("cls", F.ceil(F.col("copies") / most).alias("parts")))
    rows = found.withColumn("_i", F.monotonically_increasing_id()).join(hot, "cls", "left")
    rows = rows.withColumn("part", F.coalesce(F.col("_i") % F.col("parts"), F.lit(0).cast("bigint"))).drop("_i", "parts")
    each = named.join(hot, "cls", "left").withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce("parts", F.lit(1).cast("bigint")) - 1)))
    return rows.join(each.drop("parts"), ["cls", "part"])


def components(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(_d, _h, doc_id, n_shingles, component_id) of every document."""
    found, shared = sketched(docs, percent)
    classes = per_class(found)
    joined = links(docs, classes, shared, percent)
    labels = component_labels(joined.select(F.col("a").alias("u"), F.col("b").alias("v")))
    labels = labels.select(F.col("user_id").alias("cls"), F.col("super_id").alias("root"))
    rooted = classes.select("cls", "least").join(labels, "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    rooted = materialize(rooted, "rooted")
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(least, "root").select("cls", "component_id")
    full = dealt(found.where("cls is not null").drop("bits"), classes, named)
    empty = found.where("cls is null").withColumn("component_id", F.col("doc_id"))
    cols = ["_d", "_h", "doc_id", F.col("n").alias("n_shingles"), "component_id"]
    return full.select(*cols).unionAll(empty.select(*cols))


def keep_one(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One document of each component (the least id), every document without words, with the columns they came with. Of
    repeated rows one stays."""
    kept = components(docs, percent).where("n_shingles = 0 or doc_id <=> component_id")
    first = kept.where("n_shingles > 0").groupBy("component_id").agg(F.min(F.struct("_d", "_h")).alias("k")).select("k._d", "k._h")
    keys = materialize(first.unionAll(kept.where("n_shingles = 0").select("_d", "_h")).distinct(), "kept")
    rows = docs.select(F.struct("*").alias("_row")).select("_row", *row_key("_row.doc_id", "_row.text"))
    stay = rows.join(keys, ["_d", "_h"])
    return stay.dropDuplicates(["_d", "_h"]).select("_row.*")
