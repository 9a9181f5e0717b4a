"""Sharding, packing, fixity, toxicity, personal data, pages and the pipeline."""

import collections
import json
import random
import re
import time
import zlib

import numpy as np
import pytest

from weft.llm import fixity, html, packing, pii, sharding, toxicity


# --- sharding ---


def test_shards(docs, docs_rows):
    base = sharding.tree(8)
    got = sharding.assign(docs, base, sharding.grown(base, 8)).collect()
    assert collections.Counter(r["doc_id"] for r in got) == collections.Counter(d for d, _ in docs_rows)
    slots = collections.defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
        assert r["grown_shard"] in (r["shard"], 8)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    raw = collections.Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in docs_rows)
    assert collections.Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == raw


def test_shard_weights(spark):
    ids = spark.range(20_000).withColumnRenamed("id", "doc_id")
    heavy = {"g0": {"k0": {0: 1.0, 1: 3.0}}, "g1": {"k0": {2: 4.0}}}
    counts = {r["s"]: r["count"] for r in ids.select(sharding.place(ids.doc_id, heavy).alias("s")).groupBy("s").count().collect()}
    assert [round(counts[s] / 20_000, 1) for s in (0, 1, 2)] == [0.1, 0.4, 0.5]
    lighter = {"g0": heavy["g0"], "g1": {"k0": {2: 2.0}}}
    moved = ids.select(sharding.place(ids.doc_id, heavy).alias("a"), sharding.place(ids.doc_id, lighter).alias("b")).where("a <> b")
    assert {r["a"] for r in moved.select("a").distinct().collect()} == {2}


def test_shards_empty(empty):
    assert sharding.assign(empty, sharding.tree(8), sharding.tree(8)).count() == 0


# --- packing ---


def test_encoder_equals_whole_text():
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    texts = ["", " ", "a", " a b", "a  b", "a \n b", "tab\tx y\nz ", "Don't stop 3.14 café 中文 x", "<|endoftext|> hi", "x" * 500, "a  b 　c", "it's I'll 's"]
    rng = random.Random(3)
    texts += ["".join(rng.choice("ab 1.'\né ") for _ in range(60)) for _ in range(300)]
    for text in texts:
        assert packing.encoder().encode(text) == np.array(t.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), text


@pytest.mark.parametrize("seed", range(4))
def test_plan(seed):
    rng = random.Random(seed)
    hist = {rng.randrange(1, 101): rng.randrange(1, 50) for _ in range(rng.randrange(1, 60))}
    runs, made = packing.plan(hist, 100)
    placed, used = collections.Counter(), collections.defaultdict(list)
    for length, lo, hi, seq, offset in runs:
        for r in range(lo, hi):
            placed[length, r] += 1
            used[seq + r - lo].append((offset, length))
    assert placed == {(n, r): 1 for n, c in hist.items() for r in range(c)}
    for places in used.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 100
    spaces = []  # best fit decreasing, piece by piece
    for length in sorted((n for n, c in hist.items() for _ in range(c)), reverse=True):
        fits = [s for s in spaces if s >= length]
        if fits:
            spaces.remove(min(fits))
        spaces.append((min(fits) if fits else 100) - length)
    assert set(used) == set(range(made)) and made == len(spaces)


def test_pack(docs, docs_rows):
    got = packing.pack(packing.tokenised(docs)).collect()
    ids = collections.Counter((r["doc_id"], r["piece"]) for r in got)
    assert ids[908, 0] == 2 and ids[None, 0] == 2 and {d for d, _ in ids} == {d for d, _ in docs_rows}
    long = sorted((r for r in got if r["doc_id"] == 906), key=lambda r: r["piece"])
    assert len(long) > 20 and all(r["length"] == 1024 for r in long[1:]) and [r["start"] for r in long] == np.cumsum([0, *(r["length"] for r in long[:-1])]).tolist()
    assert [r["length"] for r in got if r["doc_id"] == 900] == [1]
    by = collections.defaultdict(list)
    for r in got:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in by.values():
        assert [o for o, _ in sorted(places)] == np.cumsum([0, *(n for _, n in sorted(places)[:-1])]).tolist()


def test_pack_checksums(docs, docs_rows):
    """The ids of every piece, cut by hand from the ids of the whole text."""
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tok.encode_special_tokens = True
    want = collections.Counter()
    for d, text in docs_rows:
        ids = [*tok.encode(text or "", add_special_tokens=False).ids, 2]
        first = len(ids) % 1024 or 1024
        for i, (a, b) in enumerate(zip([0, *range(first, len(ids), 1024)], range(first, len(ids) + 1, 1024), strict=True)):
            want[d, i, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    got = packing.pack(packing.tokenised(docs)).select("doc_id", "piece", "start", "length", "ids_crc32").collect()
    assert collections.Counter(map(tuple, got)) == want


def test_slots_among_many_runs(spark):
    rng = np.random.default_rng(5)
    lengths = np.minimum(np.r_[rng.lognormal(4, 1.5, 4_000).astype(int) + 1, np.ones(2_000, int)], 1024)
    runs, _ = packing.plan({int(n): int(c) for n, c in zip(*np.unique(lengths, return_counts=True), strict=True)}, 1024)
    assert max(collections.Counter(r[0] for r in runs).values()) > 50
    want = {(length, r): (seq + r - lo, offset) for length, lo, hi, seq, offset in runs for r in range(lo, hi)}
    rows = spark.createDataFrame(list(want), "length bigint, r bigint").repartition(5)
    got = rows.select("length", "r", packing._slot_finder(runs)("length", "r").alias("at")).select("length", "r", "at.*").collect()
    assert len(got) == len(want) and {(a, b): (c, d) for a, b, c, d in got} == want


def test_pack_empty(empty):
    assert packing.pack(packing.tokenised(empty)).count() == 0


# --- fixity ---


def test_audit(spark):
    rows = [(i, f"http://x/{i}", "h" * (i % 300)) for i in range(1500)] + [(None, None, None), (None, "u", None), (7, "http://x/7", "twice")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    left = fixity.records(pages)
    assert fixity.audit(left, left, range_bytes=2048, fanout=4).count() == 0
    damage = left.where("not (record_id <=> 600)").selectExpr("file", "record_id", "offset", "length", "if(record_id = 33, 'bad', leaf) leaf")
    extra = damage.unionAll(spark.createDataFrame([(9, 5000, 12, 3, "new")], damage.schema))
    got = sorted((r["record_id"], r["fault"]) for r in fixity.audit(left, extra, range_bytes=2048, fanout=4).collect())
    assert got == [(33, "changed"), (600, "missing"), (5000, "extra")]
    assert fixity.audit(left.where("false"), left.where("false")).count() == 0


# --- toxicity ---


def test_fold():
    assert toxicity.fold("1D10T").strip() == "idiot" and toxicity.fold("іdіоt!").strip() == "idiot" and toxicity.fold("ｓｃｕｍ").strip() == "scum"


def test_toxicity(spark):
    rng = random.Random(2)
    words = [f"{a}{b}" for a in ("ka", "mo", "ti", "lu", "so", "ne") for b in ("ran", "del", "fis", "gor", "hap", "wet")]
    rows, labels = [], []
    for i in range(500):
        w = [rng.choice(words) for _ in range(rng.randrange(5, 60))]
        toxic = i % 4 == 0
        if toxic:
            w[len(w) // 2] = rng.choice(["vilescum", "grotbag"])
        elif i % 20 == 1:
            w[0:0] = ["harmless", "grotbag"]
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(toxic)))
    rows += [(1000, "ka v1lescum mo"), (1001, None), (1002, ""), (None, "vilescum here"), (1003, "kadel")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    lab = spark.createDataFrame(labels + [(5000, 1, 1), (None, 1, 1), (3, None, None)], "doc_id bigint, quality int, toxic int")
    got = {r["doc_id"]: r for r in toxicity.score(docs, toxicity.train(docs, lab)).collect()}
    held = [i for i in range(500) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i]["held_out"] == (i in held) for i in range(500))
    assert np.mean([got[i]["predicted"] == (i % 4 == 0) for i in held]) > 0.97
    assert got[1000]["predicted"] == 1 and got[None]["predicted"] == 1 and got[1001]["score"] == got[1002]["score"] == got[1003]["score"] < 0.5


def test_toxicity_does_not_depend_on_the_layout(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    models = [toxicity.train(docs.repartition(n), labels) for n in (1, 200)]  # 200: most batches hold no labelled text
    assert models[0] == models[1] and json.loads(models[0])["logistic"][0] < 0


def test_hits_equal_a_naive_matcher():
    rng = random.Random(3)
    model = {"stems": {" ab": 1.0, " abc": 2.0, " ba": 0.5, " c": 3.0}, "exceptions": [" abc ba ", " c ab", " ba c "]}
    for _ in range(300):
        text = " " + " ".join("".join(rng.choice("abc") for _ in range(rng.randrange(1, 5))) for _ in range(rng.randrange(12))) + " "
        safe = [(i, i + len(x) - 1) for x in model["exceptions"] for i in range(len(text)) if text.startswith(x, i)]
        want = []
        for i in range(len(text)):
            fits = [x for x in model["stems"] if text.startswith(x, i)]
            if fits:
                s = max(fits, key=len)
                if not any(a <= i and i + len(s) - 1 <= b for a, b in safe):
                    want.append((i, i + len(s) - 1, model["stems"][s]))
        assert toxicity.hits(text, json.dumps(model)) == want


def test_toxicity_without_labels(docs, empty, spark):
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert toxicity.score(docs, toxicity.train(docs, none)).where("predicted = 1").count() == 0
    assert toxicity.score(empty, toxicity.train(empty, none)).count() == 0


# --- personal data ---

FORMS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute_spans(text):
    out = []
    for order, (k, form) in enumerate(FORMS.items()):
        for m in re.finditer(form, text):
            n = len(re.sub("[^0-9]", "", m[0]))
            if k == "email" or k == "ip" and max(map(int, m[0].split("."))) <= 255 or k == "phone" and 10 <= n <= 15 or k == "card" and pii.valid(k, m[0]) and 14 <= n <= 19:
                out.append((m.start(), order, k, m.end()))
    return [(k, a, b) for a, _, k, b in sorted(out)]


def test_rules():
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")
    rng = random.Random(9)
    texts = ["", "a@b.c d@@e.f x.@y.z", "1.2.3.4.5 256.1.1.1 01.002.03.4", "+1 (555) 555-5555 4111 1111 1111 1111", "é@a.b é1.1.1.1"]
    texts += ["".join(rng.choice("ab1.@-+ (4") for _ in range(80)) for _ in range(2000)]
    for t in texts:
        assert pii.rule_spans(t) == brute_spans(t), t


@pytest.fixture(scope="module")
def person_texts():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("etaoinshr") for _ in range(rng.randrange(2, 9)))
    out = []
    for i in range(500):
        w = [word() for _ in range(30)]
        d = "".join(rng.choice("0123456789") for _ in range(10))
        w[10] = (f"{word()}.{word()}@mail{i % 9}.example.com", f"{rng.randrange(256)}.{rng.randrange(256)}.7.1", f"+1 ({d[:3]}) {d[3:6]}-{d[6:]}", f'token = "{d}ab{d}"', "v2.0")[i % 5]
        out.append(" ".join(w))
    return out


def test_model_adds_and_keeps(spark, person_texts):
    docs = spark.createDataFrame(list(enumerate(person_texts)), "doc_id bigint, text string")
    p = pii.train(docs)
    base, spans = pii.all_spans("please call (974) 555-3436 or mail some.one@mail3.example.com today", p)
    assert [k for k, _, _ in base] == ["email"] and set(base) <= set(spans) and ("phone", 12, 26) in spans
    extra = [s for t in person_texts for s in set(pii.all_spans(t, p)[1]) - set(pii.rule_spans(t))]
    assert len(extra) <= 5
    rows = [(1, person_texts[0]), (1, person_texts[0]), (2, None), (3, ""), (None, "x " * 50_000 + "some.one@mail3.example.com")]
    got = pii.report(spark.createDataFrame(rows, "doc_id bigint, text string"), p).collect()
    assert sorted((r["doc_id"] or 0, r["n_email"], r["spans"]) for r in got) == sorted((d or 0, len(brute_spans(t or "")), pii.as_text(brute_spans(t or ""))) for d, t in rows)


def test_windows_are_reconciled(person_texts):
    """A stretch of many windows gives the spans of its parts."""
    p = pii.fit(pii.training_windows(person_texts)[:1500])
    text = " and ".join(f"(97{i}) 555-343{i}" for i in range(10))
    found = [s for s, _ in pii.decode(text, pii.stretches(text), p)]
    assert len(pii.windows(0, len(text))) > 2 and sum(k == "phone" and text[a] == "(" and b - a == 14 for k, a, b in found) >= 9


def test_crf_gradient():
    rng = np.random.default_rng(0)
    z, y, mask = rng.normal(size=(2, 4, pii.TAGS)), np.array([[0, 1, 2, 0], [3, 4, 0, 0]]), np.ones((2, 4))
    p = {"trans": rng.normal(size=(pii.TAGS, pii.TAGS))}
    value, dz, grads = pii.crf_loss(z, y, mask, p)
    scale = 8 / mask.sum() * mask.sum()
    for at in ((0, 1, 1), (1, 2, 5)):
        z2 = z.copy()
        z2[at] += 1e-5
        assert abs((pii.crf_loss(z2, y, mask, p)[0] - value) / 1e-5 * scale - dz[at]) < 1e-2
    t2 = {"trans": p["trans"].copy()}
    t2["trans"][1, 2] += 1e-5
    assert abs((pii.crf_loss(z, y, mask, t2)[0] - value) / 1e-5 * scale - grads["trans"][1, 2]) < 1e-2


def test_masked(docs, empty):
    out = pii.masked(docs, None)
    assert out.columns == docs.columns and out.where("doc_id = 900 and text is not null").count() == 0
    assert pii.masked(empty, None).count() == 0 and pii.mask("a b@c.d e", [("email", 2, 7)]) == "a <email> e"


# --- pages ---

PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var t="</p>";</script></head><body><header class="site-header"><p>Site.</p></header>
<nav><ul><li><a href="/a">a</a></li></ul></nav><div class="ad">Buy now.</div><article><h1>Title &amp; more</h1><p><b>First   part<br><p>Second&nbsp;part, with
words.</p></article><div class="comments"><p>Nice article.</p></div><footer>&copy; me.</footer></body></html>"""


def test_blocks():
    got = html.blocks(PAGE)
    assert [t for _, t, _ in got] == ["Site.", "a", "Buy now.", "Title & more", "First part", "Second part, with words.", "Nice article.", "© me."]
    assert html.blocks(None) == html.blocks("") == html.blocks("<p>") == [] and html.blocks("a < b <p unclosed")[0][1].startswith("a < b")


def test_main_text(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("etaoins") for _ in range(5))
    rows, want = [], {}
    for i in range(80):
        parts = [" ".join(word() for _ in range(rng.randrange(1, 40))) + "." for _ in range(rng.randrange(1, 8))]
        menu = "".join(f'<li><a href="/{w}">{w}</a></li>' for w in (word() for _ in range(5)))
        rows.append((i, "u", f'<html><body><nav><ul>{menu}</ul></nav><div class="ad">{word()} {word()}.</div><article>' + "".join(f"<p>{p}</p>" for p in parts) + f"</article><footer>&copy; {word()}.</footer></body></html>"))
        want[i] = "\n\n".join(parts)
    rows += [(100, "u", None), (101, None, ""), (102, "u", "<nav>only menu</nav>"), (103, "u", PAGE)]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id bigint, url string, html string, text string")
    got = {r["page_id"]: r for r in html.main_text(pages, html.train(pages)).collect()}
    assert {i: got[i]["text"] for i in want} == want
    assert got[100]["text"] == got[101]["text"] == got[102]["text"] == "" and got[100]["n_chars"] == 0
    assert got[103]["text"] == "Title & more\n\nFirst part\n\nSecond part, with words."
    assert html.main_text(pages.where("false"), html.train(pages.where("false"))).count() == 0


def test_pages_without_telling_names_are_labelled_by_context(spark):
    """Names say nothing: menus, legal lines and comments go and articles stay, by words, measures and neighbours."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("etaoinsrhl") for _ in range(rng.randrange(2, 9)))
    text = lambda lo, hi: " ".join(word() for _ in range(rng.randrange(lo, hi))) + "."
    trained = []
    for i in range(150):
        menu = "".join(f'<li><a href="/{w}">{w}</a></li>' for w in (word() for _ in range(6)))
        body = "".join(f"<p>{text(3, 80)}</p>" for _ in range(rng.randrange(2, 9)))
        trained.append((i, "u", f'<html><body><nav><ul>{menu}</ul></nav><div class="ad">{text(3, 12)}</div><article><h1>{text(4, 9)}</h1>{body}</article><footer>&copy; {word()}</footer></body></html>'))
    p = html.train(spark.createDataFrame(trained, "page_id bigint, url string, html string"))
    right = {True: [], False: []}
    for i in range(60):
        a, b, c, d = (f"{word()}{i}" for _ in range(4))
        body = [text(5, 80) for _ in range(rng.randrange(3, 9))]
        comment = rng.choice(["Great article, thanks for sharing!", "I totally agree with this.", "Thanks, nice post."])
        page = f"""<html><body><div class="{a}"><ul><li><a href="/x">Home</a></li><li><a href="/y">News</a></li></ul></div><div class="{b}">{"".join(f"<p>{x}</p>" for x in body)}</div>
            <div class="{c}"><p>{comment}</p></div><div class="{d}">Copyright 2024 All rights reserved. <a href="/p">Privacy</a> <a href="/t">Terms</a></div></body></html>"""
        parsed = html.blocks(page)
        for (_, said, _), keep in zip(parsed, html.label([parsed], p, {})[0], strict=True):
            right[said in body].append(bool(keep) == (said in body))
    assert np.mean(right[True]) > 0.9 and np.mean(right[False]) > 0.8, (np.mean(right[True]), np.mean(right[False]))


def test_broken_pages_take_linear_time():
    for piece in ("<div ", '<svg a="', '<b class="', "<!-- x", "<a href='", "<object>x</p><p>", '<b ">" ', "<div class=q>", "</b>x", "<i></u>", "<svg x>a", "<a<b"):
        for end in ("", ">", '"', "'>"):
            began = time.process_time()
            html.blocks(piece * (250_000 // len(piece)) + end)
            assert time.process_time() - began < 3, (piece, end)
    html.blocks("".join(f"<div class=c{i}>" for i in range(20_000)) + "x" + "</b>" * 20_000)
    assert [b[1] for b in html.blocks("<article><p>A <object>x</p><p>B here.</p>")] == ["A", "x", "B here."]
    assert [b[1] for b in html.blocks("<p title='a > b'>One</p><p title='x>Two</p><p>Three</p>")] == ["One", "Two", "Three"]
    assert [b[1] for b in html.blocks("<p>1 < 2 <> 3</p><p>4 <")] == ["1 < 2 <> 3", "4 <"]


def test_icons_do_not_swallow_the_page():
    for icon in ("<svg-icon name=x></svg-icon>", "<title-bar>Menu</title-bar>", "<svg class=i/>", "<SVG/>", '<svg aria-label="a > b" />', "<svg viewBox='0 0 1 1'><title>no</title><path d=x/></svg>"):
        got = [b[1] for b in html.blocks(f"<nav>{icon}</nav><article><p>One two.</p><p>Three {icon} four.</p></article>")]
        assert "One two." in got and got[-1].endswith("four.") and "no" not in " ".join(got).split(), icon
    assert [b[1] for b in html.blocks("<script/>no</script><p>Yes.</p>")] == ["Yes."]


def test_every_word_of_a_block_is_read():
    path, n = frozenset({"<html", "<div"}), 40
    base = [f"w{i}" for i in range(n)]
    plain = html.features([(path, " ".join(base), 0)], {})
    for i in range(n):
        changed = html.features([(path, " ".join(base[:i] + [f"v{i}", f"u{i}"] + base[i + 2 :]), 0)], {})
        words = slice(html.PATH_DIM, html.PATH_DIM + html.WORD_DIM)
        assert not np.array_equal(plain[:, words], changed[:, words]), i
    want = np.zeros(html.WORD_DIM)
    for w in base:
        want += html._slots([w], html.WORD_DIM)
    assert np.allclose(plain[0, words], want / np.sqrt(n), atol=1e-6)
    html.read(" ".join(f"x{i}" for i in range(60_000)) + " " + "y" * 10_000)
    assert len(html._WORDS) <= 50_001 and max(map(len, html._WORDS)) <= 64


def test_labeller_learns_a_later_word():
    """Blocks that differ in a word in their middle alone are told apart."""
    rng = np.random.default_rng(3)
    path, words = frozenset({"<html", "<body", "<div"}), [f"w{i}" for i in range(200)]

    def page():
        say = lambda k: " ".join(rng.choice(words, k))
        kinds = rng.random(6) < 0.5
        return [(path, f"{say(6)} {'voucher' if k else 'chapter'} {say(6)}", 0) for k in kinds], [float(not k) for k in kinds]

    from weft.llm import lstm

    p = lstm.init(rng, html.INPUTS, html.HIDDEN, 1)
    adam = lstm.Adam(p)
    for _ in range(150):
        data = [page() for _ in range(16)]
        x, mask = lstm.pad([html.features(b, {}) for b, _ in data])
        y = np.array([t for _, t in data], np.float32)[:, :, None]
        adam.step(lstm.gradients(p, x, mask, lambda z, y=y: (0.0, ((1 / (1 + np.exp(-z)) - y) / y.size * 8).astype(np.float32), {}))[1])
    data = [page() for _ in range(100)]
    right = np.concatenate([kept == np.array(t, bool) for kept, (_, t) in zip(html.label([b for b, _ in data], p, {}), data, strict=True)])
    assert right.mean() > 0.8


def test_training_blocks_come_from_the_whole_page():
    page = "".join(f"<p>{'long ' * 100}block{i}</p>" for i in range(1_000)) + "<footer>The end.</footer>"
    chosen, spare = html.training_blocks("7", page)
    at = [int(t.split("block")[1]) for _, t, _ in chosen if "block" in t]
    assert len(page) > 400_000 and len(chosen) in range(191, 201) and min(at) < 100 and max(at) >= 900 and at == sorted(at)
    assert sum(400 <= i < 600 for i in at) > 10 and html.training_blocks("7", page) == (chosen, spare) != html.training_blocks("8", page)
    assert len(spare) == html.SPARES and max(map(len, spare)) <= html.MAX_SPARE
    ends = sum(any(t == "The end." for _, t, _ in html.training_blocks(str(k), page)[0]) for k in range(40))
    assert 1 <= ends <= 30 and html.training_blocks("1", "") == ([], [])
    short = html.blocks(page)[:150]
    assert html.training_blocks("7", "".join(f"<p>{t}</p>" for _, t, _ in short))[0] == [(frozenset({"<p"}), t, n) for _, t, n in short]
    start = html._head(short[0][1][: html.MAX_SPARE], html.read(short[0][1]))
    assert np.array_equal(html.features([(short[0][0], start, 0)], {}), html.features(short[:1], {}))


def test_pii_training_does_not_depend_on_the_layout(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    one, many = (pii.train(docs.repartition(n)) for n in (1, 200))
    assert all((one[k] == many[k]).all() for k in one)


def test_pii_training_on_texts_without_windows(spark):
    rows = [(1, "mail a@b.cd, e@f.gh now"), (2, None), (3, "1")]
    p = pii.train(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert [r["n_email"] for r in pii.report(spark.createDataFrame(rows, "doc_id bigint, text string"), p).orderBy("doc_id").collect()] == [2, 0, 0]
