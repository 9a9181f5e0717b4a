"""Flat token files, the prefix trie of conversations and the repair of their structure."""

import collections
import functools
import hashlib
import itertools
import math
import os
import random
import re
import zlib

import numpy as np
import pytest

from weft.llm import flatfile, repair, trie

TEXTS = [
    "", " ", "a", " a", "a ", "a  b", "  a b", "a\n\nb c", "a \n b", "end <|endoftext|> next", "x\x00y z", "é 中文  ü x", "\u0085 q r s",
    "it's we'll 12 345,6 --- ...", "\t\ttabs here ", "a\x1cb \x1c c", "﻿b o m", "🙂 🙂🙂 x", "one  two   three four", "\r\n line \r\n", "w " * 3000,
]


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t


def whole(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, flatfile.END_TOKEN]


def test_encoder_equals_whole_texts(tokenizer, monkeypatch):
    rng = random.Random(2)
    mixed = ["".join(rng.choice(["a", "b ", " ", "\n", "1", "é", ".", " the", " ", "'s"]) for _ in range(rng.randrange(40))) for _ in range(400)]
    monkeypatch.setattr(flatfile, "CACHE_ENTRIES", 60)  # the table is emptied now and then, some texts do not fit
    enc = flatfile.Encoder(flatfile.encoder().vocabulary)
    monkeypatch.setattr(flatfile, "GROUP_CHARS", 200)
    for text, ids in zip(TEXTS + mixed, enc.encode(TEXTS + mixed), strict=True):
        assert np.frombuffer(ids, f"<u{enc.width}").tolist() == whole(tokenizer, text), repr(text)


def brute_stream(tokenizer, rows):
    at, out = 0, []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, zlib.crc32((r[1] or "").encode()))):
        ids = whole(tokenizer, text)
        out.append((doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


@pytest.mark.parametrize("layout", [1, 30])
def test_flat_files(spark, docs, docs_rows, tokenizer, layout, tmp_path):
    added = [*enumerate(TEXTS), (9_007_199_254_740_993, "an id beyond doubles"), (-5, "a negative one")]
    rows = docs_rows + added
    more = spark.createDataFrame(added, "doc_id bigint, text string")
    folder = str(tmp_path / "corpus")
    parts = flatfile.write(docs.select("doc_id", "text", "n_words").unionByName(more, allowMissingColumns=True).repartition(layout), folder).orderBy("part").collect()
    got = sorted(tuple(r) for r in flatfile.read(spark, folder).select("start", "doc_id", "n_tokens", "ids_crc32").collect())
    want = sorted((s, d, n, c) for d, s, n, c in brute_stream(tokenizer, rows))
    assert got == want
    # the files, joined, are the flat stream; bases are sums of what lies before
    assert [p["token_base"] for p in parts] == [sum(q["n_tokens"] for q in parts[:i]) for i in range(len(parts))]
    assert len(parts) > 1 and sum(p["n_docs"] for p in parts) == len(rows)
    flat = b"".join((tmp_path / "corpus" / f"part-{p['part']:06d}.bin").read_bytes() for p in parts)
    assert len(flat) == 2 * sum(n for _, _, n, _ in want) and not [x for x in os.listdir(folder) if x.count(".") > 1 and x.startswith("part")]


def test_flat_files_of_an_empty_table(empty):
    got = flatfile.digest(empty)
    assert got.count() == 0 and got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]


def test_a_repeated_attempt_replaces_its_part(tmp_path):
    for _ in range(2):
        assert flatfile.write_part(str(tmp_path), 3, [(None, b"\1\0"), (5, b"\2\0\3\0")], 2) == (2, 1, 3)
    assert [(k, s, ids.tolist()) for k, s, ids in flatfile.documents_of(str(tmp_path), 3, 2, 1, 100)] == [(None, 100, [1]), (5, 101, [2, 3])]
    assert isinstance(flatfile.open_part(str(tmp_path), 3, 2)[0], np.memmap) and len(os.listdir(tmp_path)) == 3


# --- prefix trie ---

CONVERSATION = "conv_id bigint, turn bigint, role string, text string, shard int, depth string"


def dialogues(seed=4):
    """Conversations with shared beginnings, equal copies, a long one, and every edge case."""
    rng = random.Random(seed)
    rows = []
    for c in [*range(-120, -90), *range(0, 260), 1203]:
        n = rng.choice([0, 1, 2, 3, 5, 8, 9])
        for t in range(n):
            rows.append((c, t, rng.choice(["user", "assistant"]), rng.choice(["a", "b", "éé", "long text. "]) if t else "hello"))
    for c in range(300, 420):  # copies of one conversation
        rows += [(c, t, "user", f"copy {t}") for t in range(37)]
    rows += [(500, t, "user", f"copy {t}") for t in range(70)]
    rows += [(600, None, None, None), (600, 3, "user", None), (600, 3, "user", None), (600, 3, "a", "b"), (600, 1, None, "x"), (None, 0, "user", "nobody"), (None, None, None, None)]
    return rows


def brute_trie(rows):
    conv = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            conv[c].append(((turn is not None, turn or 0), hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest(), (role, text)))
    turns = {c: [x[2] for x in sorted(v)] for c, v in conv.items()}
    rebuilt = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 6
        rebuilt[c] = tuple(turns.get(c - int(math.fmod(c, 100)), [])[:h] + own[h:])
    members, kids = collections.defaultdict(list), collections.defaultdict(set)
    for c, path in rebuilt.items():
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
            if d:
                kids[path[: d - 1]].add(path[:d])
    leaves, saved = {}, {}
    for path in sorted(members, key=len, reverse=True):
        leaves[path] = sum(leaves[k] for k in kids[path]) or 1
        saved[path] = sum(saved[k] for k in kids[path]) + ((len(members[path]) - 1) * len(path[-1][1]) if path else 0)
    ends = lambda p: hashlib.sha256(",".join(str(c) for c in sorted(members[p]) if rebuilt[c] == p).encode()).hexdigest()
    return collections.Counter((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids[p]), leaves[p], saved[p], ends(p)) for p, m in members.items())


@pytest.mark.parametrize("partitions, block, chunk", [(1, 16, 1000), (4, 4, 7), (23, 1, 2)])
def test_trie(spark, partitions, block, chunk):
    rows = dialogues()
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        got = trie.nodes(spark.createDataFrame([(*r, 1, "x") for r in rows], CONVERSATION), block, chunk).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert collections.Counter(tuple(r) for r in got) == brute_trie(rows)


def test_trie_of_nothing(spark):
    assert trie.nodes(spark.createDataFrame([], CONVERSATION)).count() == 0
    assert trie.nodes(spark.createDataFrame([(None, 1, "user", "x", 1, "")], CONVERSATION)).count() == 0
    # the only turn of 1203 is replaced by the beginning of a conversation that does not exist
    only = [tuple(r) for r in trie.nodes(spark.createDataFrame([(1203, 0, "user", "x", 1, "")], CONVERSATION)).collect()]
    assert collections.Counter(only) == brute_trie([(1203, 0, "user", "x")])


# --- repair of conversation structure ---


def brute_align(initials, forced, cut):
    """(cost, audit) by trying every edit at every place."""
    n = len(initials)
    step = {("start", "s"): "system", ("start", "u"): "u", ("system", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}

    @functools.cache
    def best(i, state, inserted):
        options = [(0, "")] if i == n and state in ("start", "a") else []

        def add(cost, letter, rest):
            options.append((cost + rest[0], letter + rest[1]))

        if i < n:
            add(3, "D", best(i + 1, state, 0))
            if not forced[i]:
                if (state, initials[i]) in step:
                    add(cut[i], "K", best(i + 1, step[state, initials[i]], 0))
                for x in "ua":
                    if (state, x) in step:
                        add(2 + cut[i], "R", best(i + 1, step[state, x], 0))
        if inserted < 4:
            for x in "ua":
                if (state, x) in step:
                    add(2, "I", best(i, step[state, x], inserted + 1))
        return min(options, default=(10**9, ""))

    return best(0, "start", 0)


def test_alignment_equals_brute_force():
    for n in range(5):
        for initials in itertools.product("sua ", repeat=n):
            for flags in itertools.product([(False, False), (True, False), (False, True)], repeat=n) if n < 4 else [[(False, False)] * n]:
                forced, cut = [f for f, _ in flags], [c for _, c in flags]
                assert repair.align(list(initials), forced, cut) == brute_align(initials, forced, cut), (initials, flags)
    rng = random.Random(8)
    for _ in range(400):
        n = rng.randrange(5, 40)
        initials = [rng.choice(["s", "u", "a", "u", "a", "u", "a", "t", ""]) for _ in range(n)]
        forced = [rng.random() < 0.15 for _ in range(n)]
        cut = [not f and rng.random() < 0.2 for f in forced]
        assert repair.align(initials, forced, cut) == brute_align(tuple(initials), forced, cut), (initials, forced, cut)


def test_repaired_turns_fit_the_grammar():
    turns = [("system", "Be kind."), ("assistant", "Hi."), ("user", " "), ("user", "So"), ("user", "What?"), ("assistant", "Hi."), ("tool", "x!")]
    got = repair.repaired(turns)
    assert repair.faults(turns) == ["", "", "blank", "truncated", "", "duplicate", ""]
    assert re.fullmatch("(s?(ua)+)?", "".join(role[0] for role, _ in got["turns"])) and got["illegal"] == 4
    assert (got["cost"], got["audit"]) == brute_align(tuple(r[:1] for r, _ in turns), [False, False, True, False, False, True, False], [False] * 3 + [True] + [False] * 3)
    assert repair.repaired([])["audit"] == "" and repair.repaired([("user", "")])["turns"] == []


def brute_report(rows):
    conv = {}
    for c, turn, role, text in rows:
        kept = conv.setdefault(c, [])
        role, text = " " if role is None else role, " " if text is None else text
        draw = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
        if draw:
            text = "" if draw == 1 else re.sub("[.!?]", "", text) if draw == 2 else text
            kept += [(turn, "user" if draw == 4 else role, text)] * (2 if draw == 3 else 1)
    out = collections.Counter()
    for c, kept in conv.items():
        kept.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))
        known = {t for t, _, _ in kept if t is not None}
        found, seen = [], set()
        for _, role, text in kept:
            said = re.sub(r"[\x20\x09-\x0D]+\Z", "", text)
            found.append("blank" if not said else "duplicate" if (role, text) in seen else "truncated" if said[-1] not in ".!?" else "")
            seen.add((role, text))
        first = [r[:1] for _, r, _ in kept]
        forced, cut = [x in ("blank", "duplicate") for x in found], [x == "truncated" for x in found]
        cost, audit = brute_align(tuple(first), forced, cut)
        result, i = [], 0
        for e in audit:
            expect = "user" if not result or result[-1][0][0] in "sa" else "assistant"
            if e == "I":
                result.append((expect, ""))
                continue
            _, role, text = kept[i]
            i += 1
            if e != "D":
                result.append((role if e == "K" else expect, text))
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in result).encode()).hexdigest()
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(first, first[1:]))
        out[(c, max(known) - min(known) + 1 - len(known) if known else 0, found.count("blank"), found.count("duplicate"), found.count("truncated"), illegal, cost, audit, digest)] += 1
    return out


@pytest.mark.parametrize("layout", [1, 20])
def test_repair(spark, sf, layout):
    rng = random.Random(6)
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows += dialogues() + [(9_007_199_254_740_993, 2**53 + 1, "user", "big ids."), (9_007_199_254_740_993, 2**53 + 3, "", "no role!"), (7000, 1, "user", "x" * 50_000 + ".")]
    rows += [(8000, t, rng.choice(["user", "assistant", "assistant", "system", "tool"]), rng.choice(["Yes.", "No", f"Number {t}!", " \n", "?"])) for t in range(150)]
    got = repair.report(spark.createDataFrame([(*r, 1, "x") for r in rows], CONVERSATION).repartition(layout)).collect()
    assert collections.Counter(tuple(r) for r in got) == brute_report(rows)
    assert repair.report(spark.createDataFrame([], CONVERSATION)).count() == 0
