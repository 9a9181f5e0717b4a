"""Operators on documents against brute force, with edge cases."""

import collections
import hashlib
import re

import pytest
from pyspark.sql import functions as F

from weft.llm import decontam, jaccard, quality, shingles, substrings

SPACE = re.compile(r"[\x20\x09-\x0D]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split(text, pattern=SPACE, lower=False):
    return [w for w in pattern.split((text or "").translate(UPPER) if lower else text or "") if w]


def rows_of(df, *cols):
    return collections.Counter(tuple(r) for r in df.select(*cols).collect())


def repeat_words(w, k=5):
    seen = collections.Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    return len({p for i in range(len(w) - k + 1) if seen[tuple(w[i : i + k])] > 1 for p in range(i, i + k)})


def test_quality_base(docs, docs_rows):
    want = collections.Counter()
    for d, t in docs_rows:
        w = split(t)
        lines = [x for x in (t or "").split("\n") if split(x)]
        n = repeat_words(w)
        want[d, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), n, len(w) < 10 or 100 * n > 20 * len(w)] += 1
    feats = quality.features(docs)
    assert rows_of(feats, "_row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed") == want


def test_quality_distance(spark):
    good = ["the cat of the house and a dog in the garden of my friend, with a bird on it. " * 4 + f"Number w{i}." for i in range(20)]
    symbols = " ".join(f"word{i}%%%" for i in range(80))
    shouting = " ".join(f"WORD{i}!!" for i in range(80))
    rows = [(i, t, "en") for i, t in enumerate(good)] + [(100, symbols, "en"), (101, shouting, None), (102, "Short and clean, ten words or a few more here.", "en"), (103, None, "xx")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    feats = quality.features(docs)
    judged = quality.judge(feats, quality.references(feats)).collect()
    by = {r["_row"]["doc_id"]: r for r in judged}
    assert by[100]["class_distance"] > quality.MAX_CLASS_DISTANCE and not by[100]["kept"] and not by[101]["kept"]
    assert by[102]["class_distance"] == 0.0 and by[102]["word_distance"] == 0.0 and not by[103]["kept"]
    assert all(by[i]["class_distance"] < 0.1 for i in range(20))


def test_quality_without_reference(spark, empty):
    docs = spark.createDataFrame([(1, "word " * 3 + "and more words that come to ten at least here", "xx")], "doc_id bigint, text string, lang string")
    feats = quality.features(docs)
    assert quality.references(feats) == {"_classes": {}, "_common": {}}
    assert quality.keep_good(docs).count() == 1
    assert quality.keep_good(empty).count() == 0 and quality.keep_good(empty).columns == empty.columns


def test_decontamination(docs, docs_rows, benchmark):
    sep = re.compile(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = collections.defaultdict(set)
    for r in benchmark.collect():
        w = split(r["text"], sep, True)
        for i in range(max(1, len(w) - 9) if w else 0):
            windows[tuple(w[i : i + 10])].add(r["item_id"])
    want = collections.Counter()
    for d, t in docs_rows:
        w, hit, items = split(t, sep, True), set(), set()
        for k in {len(x) for x in windows}:
            for i in range(len(w) - k + 1):
                if tuple(w[i : i + k]) in windows:
                    hit.update(range(i, i + k))
                    items |= windows[tuple(w[i : i + k])]
        ids = ",".join(sorted(str(x) for x in items if x is not None))
        want[d, len(w), len(hit), len(items), hashlib.sha256(ids.encode()).hexdigest(), bool(hit)] += 1
    got = decontam.report(docs, benchmark)
    assert rows_of(got, "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == want
    clean = decontam.keep_clean(docs, benchmark)
    assert clean.columns == docs.columns and clean.count() == sum(n for k, n in want.items() if not k[-1])


def test_decontamination_empty(docs, empty, benchmark):
    assert decontam.report(empty, benchmark).count() == 0
    assert decontam.report(docs, benchmark.where("false")).where("contaminated").count() == 0


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "alpha x x x beta"), (2, "alpha x x x x x beta"), (3, "beta x x x alpha"), (4, "alpha beta x x x x x x x x x x x")], "doc_id bigint, text string")
    items = decontam.items_table(spark.createDataFrame([(1, "alpha x x x beta")], "item_id bigint, text string"))
    terms = items.selectExpr("explode(words) term").distinct()
    anchors = decontam.rarest_terms(items, decontam.term_counts(docs, terms, 3))
    assert sorted(anchors.collect()[0][c] for c in ("first_term", "second_term")) == ["alpha", "beta"]
    near = decontam.proximity_matches(decontam.build_index(docs), anchors, slop=2)
    assert sorted((r["_d"], abs(r["gap"])) for r in near.collect()) == [(1, 4), (2, 6)]


def test_near_counts(docs, docs_rows, benchmark):
    sep = re.compile(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    texts = [(d, t, split(t, sep, True)) for d, t in docs_rows]
    counts = collections.Counter(x for _, _, w in texts for x in w)
    choices = set()
    for r in benchmark.collect():
        w = split(r["text"], sep, True)
        for s in range(max(1, len(w) - 9) if w else 0):
            first, *more = sorted((counts[w[p]], w[p].encode(), p) for p in range(s, min(s + 10, len(w))))[:2]
            choices |= {(r["item_id"], first[2], x[2], w[first[2]], w[x[2]]) for x in more}
    want = collections.Counter()
    for d, _, w in texts:
        at = collections.defaultdict(list)
        for p, x in enumerate(w):
            at[x].append(p)
        near = {item for item, i, j, a, b in choices for x in at[a] for y in at[b] if abs(y - x - (j - i)) <= 5 and (y > x) == (j > i) and x != y}
        want[d, len(near)] += 1
    assert rows_of(decontam.report(docs, benchmark, slop=decontam.SLOP), "doc_id", "n_near") == want and max(n for _, n in want) > 0


def test_decontamination_many_alignments(spark):
    """One text in which a long item's words recur in very many places, and a copy of it."""
    item = ["a", "b"] * 30 + ["c"]
    docs = spark.createDataFrame([(1, " ".join(item * 40)), (2, "a b a b"), (3, " ".join(item[5:]))], "doc_id bigint, text string")
    bench = spark.createDataFrame([(7, " ".join(item))], "item_id bigint, text string")
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"]) for r in decontam.report(docs, bench).collect()}
    assert got == {1: (2440, 2440, 1), 2: (4, 0, 0), 3: (56, 56, 1)}


def brute_components(docs_rows, percent):
    sets = []
    for d, t in docs_rows:
        w = split(t, lower=True)
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset())
    comp = list(range(len(sets)))
    find = lambda x: x if comp[x] == x else find(comp[x])
    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                comp[find(i)] = find(j)
    ids = collections.defaultdict(list)
    for i, (d, _) in enumerate(docs_rows):
        if d is not None:
            ids[find(i)].append(d)
    return collections.Counter((d, len(sets[i]), min(ids[find(i)]) if ids[find(i)] else None) for i, (d, _) in enumerate(docs_rows))


@pytest.mark.parametrize("percent", [75, 90])
def test_jaccard_components(docs, docs_rows, percent):
    got = jaccard.components(docs, percent)
    assert rows_of(got, "doc_id", "n_shingles", "component_id") == brute_components(docs_rows, percent)


def test_jaccard_keeps_one(docs, docs_rows):
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns
    groups = {c for _, n, c in brute_components(docs_rows, 75) if n and c is not None}
    ids = [r["doc_id"] for r in kept.where("doc_id is not null").collect()]
    assert groups <= set(ids) and len(ids) == len(set(ids)) and {900, 901, 902} <= set(ids)


def test_jaccard_hot_groups(spark):
    """Many near copies of one text and many texts that share one passage."""
    base, passage = [f"b{i}" for i in range(80)], " ".join(f"p{i}" for i in range(40))
    near = [(i, " ".join(base[:j] + [f"e{i}"] + base[j + 1 :])) for i, j in enumerate(range(0, 80, 2))]
    rest = [(100 + i, f"{passage} " + " ".join(f"q{i}x{j}" for j in range(60))) for i in range(40)]
    docs = spark.createDataFrame(near + rest + [(500, " ".join(base))], "doc_id bigint, text string")
    assert rows_of(jaccard.components(docs), "doc_id", "n_shingles", "component_id") == brute_components(near + rest + [(500, " ".join(base))], 75)


def test_jaccard_hot_class_is_dealt(spark):
    """Copies of one text beyond the limit, the same row repeated among them, lie in several parts and lose no row."""
    same = "one two three four five six seven eight"
    rows = [(i, same) for i in range(600)] + [(7, same)] * 400 + [(1000, same + " nine"), (1001, "another text of its own entirely here")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    found, _ = jaccard.sketched(docs)
    classes = jaccard.per_class(found)
    parts = jaccard.dealt(found, classes, classes.select("cls", F.lit(1).alias("one"))).groupBy("cls", "part").count()
    sizes = sorted(r["count"] for r in parts.collect())
    assert sum(sizes) == len(rows) and max(sizes) <= 300
    got = jaccard.components(docs).groupBy("component_id").count()
    assert {r["component_id"]: r["count"] for r in got.collect()} == {0: 1001, 1001: 1}


def test_buckets_grow_with_the_texts(spark, monkeypatch):
    rows = spark.createDataFrame([("x" * 1000,), (None,)], "text string")
    least = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert shingles.bucket_count(rows) == shingles.bucket_count(rows.where("false")) == least
    monkeypatch.setattr(shingles, "BUCKET_BYTES", 10)
    assert shingles.bucket_count(rows) == 100


def test_jaccard_empty(empty):
    assert jaccard.components(empty).count() == 0


def test_substrings(docs, docs_rows):
    order = sorted(docs_rows, key=lambda r: (r[0] is None, r[0] or 0))
    first = {}
    for d, t in order:
        w = split(t)
        for i in range(len(w) - 19):
            k, at = tuple(w[i : i + 20]), ((d is None, d or 0), i)
            first[k] = min(first.get(k, at), at)
    want = collections.Counter()
    for d, t in docs_rows:
        w = split(t)
        gone = {p for i in range(len(w) - 19) if first[tuple(w[i : i + 20])] < ((d is None, d or 0), i) for p in range(i, i + 20)}
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        want[d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()] += 1
    got = substrings.remove_repeats(docs)
    assert rows_of(got, "doc_id", "n_words", "n_removed", "kept_sha256") == want
    assert sum(k[2] for k in want) > 1000
    for r in got.where("n_removed > 0").collect():
        assert sum(b - a for a, b in zip(r["spans"][::2], r["spans"][1::2])) == r["n_removed"]


def test_substrings_empty(empty):
    assert substrings.remove_repeats(empty).count() == 0
