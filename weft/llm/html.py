"""Main text of web pages by a recurrent block labeller.

A page becomes its sequence of leaf blocks: text between block-level tags, with the tags, classes and ids of the open
elements. A bidirectional LSTM in numpy reads for each block a hashed vector of that path, a hashed vector of its words
and a few measures, and labels every block in the light of the whole page.

The model is trained on at most ``MAX_PAGES`` pages, chosen by a hash of the id. The tasks parse them whole, and of a page with
more than ``MAX_BLOCKS`` blocks, runs of ``RUN`` neighbouring ones, ``MAX_BLOCKS`` in all, are drawn by hash over the whole page;
``SPARES`` blocks of each page, drawn likewise, give the texts of added blocks. The driver gets the path of each of these blocks,
what ``read`` finds in its whole text, and the first ``MAX_SPARE`` characters for texts that are varied. Blocks are labelled weakly:
by elements whose meaning HTML or common class names fix (``BOILERPLATE``, ``CONTENT``); the network sees names only as hashes.
Since the pages of one corpus use few of them, each training page is also varied: blocks of other kinds are put before, after and
between its own, with texts of the corpus or with what such blocks commonly say (``_SAYINGS``), the wrappers of the article are
renamed, and three in ten pages lose all telling names, so that words, measures and neighbours decide. Weights reach the tasks inside the function that Spark ships.

Defined cases: null and empty html give an empty text; a page without any block that looks like content gives an empty
text; broken markup is read as far as it goes in one forward scan, with an unclosed tag taken as text, an unclosed svg or object
read on, and other unclosed silent elements silent to the end; elements nested deeper than ``MAX_DEPTH`` have the path of the one
above, and of an element's class names the first ``MAX_NAMES`` enter its path; repeated rows get equal results; extra columns do
not matter.
"""

from __future__ import annotations

import html
import json
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm import lstm

MAX_PAGES, MAX_BLOCKS = 240, 200
RUN, SPARES, MAX_SPARE = 10, 8, 400
PATH_DIM, WORD_DIM, HIDDEN = 384, 128, 32
# Elements that do not break a block, elements without an end tag, and (_SILENT) elements whose content is no text.
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i img input ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr br".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# What elements, classes and ids commonly stand for.
BOILERPLATE = frozenset("""nav menu menubar navbar navigation breadcrumb breadcrumbs header masthead topbar footer bottom copyright aside sidebar related
    recommended widget ad ads advert adverts advertisement banner sponsor sponsored promo cookie cookies consent notice alert popup modal newsletter
    subscribe signup login form button select option comment comments comment-list reply discussion disqus social share sharing pagination pager toolbar dialog""".split())
CONTENT = frozenset("article main content post entry story body-text articlebody post-content entry-content text".split())
_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_INSIDE = re.compile(r"(?>\"[^\"]*\"|'[^']*'|[^'\">])*+")  # of a tag: closed quotes may hold ">"
_SILENT = {name: re.compile(rf"</{name}\s*>", re.I) for name in "script style template noscript title textarea svg iframe object".split()}
MAX_DEPTH, MAX_NAMES = 512, 64
_MARK = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)

Block = tuple[frozenset, str, int]  # path tokens, text, characters inside links


class _Paths(dict):
    """(open path, tag, attributes) -> path of the element, remembered up to a bound; equal paths are one object."""

    def __init__(self):
        self.one: dict[frozenset, frozenset] = {}

    def __missing__(self, key: tuple[frozenset, str, str]) -> frozenset:
        above, tag, attributes = key
        own = {f"<{tag}"}
        names = [x for groups in _MARK.findall(attributes) for x in "".join(groups).lower().split()] if "=" in attributes else []
        for name in names[:MAX_NAMES]:
            own.add(name)
            own.update(x for x in re.split(r"[^a-z]+", name) if x)
        if len(self) > 20_000:
            self.clear()
            self.one.clear()
        path = above | own
        path = self[key] = self.one.setdefault(path, path)
        return path


_PATHS = _Paths()


def _tags(page: str) -> Iterator[tuple[int, int, str, bool, str]]:
    """(start, end, name, closing, attributes) of every tag, and of comments and silent elements as wholes ("!" or their name with
    a "!"), in one forward scan.

    A search that finds nothing is never made again, so broken pages take linear time: beyond the last ">" all is text; where a
    quote is never closed, the tags up to it end at the next ">"; an end tag that is nowhere ahead is not looked for again."""
    at, last, open_quote, absent = 0, page.rfind(">"), 0, set()
    while (start := page.find("<", at)) >= 0:
        at = start + 1
        if page.startswith("<!--", start):
            end = page.find("-->", start + 4)
            at = len(page) if end < 0 else end + 3
            yield start, at, "!", False, ""
            continue
        if start > last:
            return
        if page[at] in "!?":
            at = page.index(">", at) + 1
            yield start, at, "!", False, ""
            continue
        m = _NAME.match(page, start)
        if not m:
            continue
        end = -1
        if start >= open_quote:
            end = _INSIDE.match(page, m.end()).end()
            if end == len(page) or page[end] != ">":
                open_quote, end = max(end, start + 1), -1
        if end < 0:
            end = page.find(">", m.end())
            if end < 0:  # the name took the last one's place in text such as "<a<b"
                return
        name, closing, attributes, at = m[1].lower(), page[start + 1] == "/", page[m.end() : end], end + 1
        if name in _SILENT and not closing and not (name == "svg" and attributes.endswith("/")):
            over = None if name in absent else _SILENT[name].search(page, at)
            if over:
                at = over.end()
            else:
                absent.add(name)
            if over or name not in ("svg", "object"):  # these two hold markup: unclosed, they are read on as other elements
                at = at if over else len(page)
                yield start, at, "!" + name, False, ""
                continue
        elif name == "svg" and not closing:
            yield start, at, "!svg", False, ""
            continue
        yield start, at, name, closing, attributes


def blocks(page: str | None) -> list[Block]:
    """Leaf blocks in page order, white space folded and character references decoded."""
    out: list[Block] = []
    stack: list[tuple[str, frozenset]] = [("", frozenset())]
    opened: Counter = Counter()
    parts: list[str] = []
    linked = at = 0

    def end_block():
        nonlocal linked
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            out.append((stack[-1][1], text, linked))
        parts.clear()
        linked = 0

    def text(piece: str):
        nonlocal linked
        if piece:
            parts.append(piece)
            linked += len(piece) if "<a" in stack[-1][1] else 0

    def close(depth: int):
        for name, _ in stack[depth:]:
            opened[name] -= 1
        del stack[depth:]

    page = page or ""
    for start, end, tag, closing, attributes in _tags(page):
        text(page[at:start])
        at = end
        if tag[0] == "!":
            if len(tag) > 1:
                parts.append(" ")
            continue
        if tag in ("br", "img", "input"):
            parts.append(" ")
        elif tag not in INLINE:
            end_block()
        if closing:
            if opened[tag] > 0:
                close(next(i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == tag))
        elif tag not in VOID:
            if tag not in INLINE:  # a new block ends an open paragraph; a list item or cell ends the last one
                ends = ("p", tag) if tag in ("li", "td", "th", "tr", "dt", "dd", "option") else ("p",)
                depth = next((i for i in range(len(stack) - 1, max(0, len(stack) - 6), -1) if stack[i][0] in ends), 0)
                if depth:
                    close(depth)
            if "href" in attributes and tag == "a":
                attributes = ""
            stack.append((tag, _PATHS[stack[-1][1], tag, attributes] if len(stack) <= MAX_DEPTH else stack[-1][1]))
            opened[tag] += 1
    text(page[at:])
    end_block()
    return out


def _slots(names, dim: int) -> np.ndarray:
    v = np.zeros(dim, np.float32)
    for n in names:
        h = xxhash.xxh3_64_intdigest(n.encode("utf-8", "surrogatepass"))
        v[h % dim] += 1 if h >> 63 else -1
    return v


class _Slots(dict):
    """word -> its place among 2 * WORD_DIM, the upper half for words that count down; remembered up to a bound."""

    def __missing__(self, word: str) -> int:
        if len(self) > 50_000:
            self.clear()
        h = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        slot = h % WORD_DIM + (0 if h >> 63 else WORD_DIM)
        if len(word) <= 64:
            self[word] = slot
        return slot


_WORDS = _Slots()


def read(text: str) -> tuple[list[int], int, int, int, bool]:
    """What the labeller reads of a block's text: the signed counts of all its words in hashed places, its length, its number of
    words, its stops, and whether one ends it."""
    slots = list(map(_WORDS.__getitem__, text.lower().split(" ")))
    counts = np.bincount(slots, minlength=2 * WORD_DIM)
    return (counts[:WORD_DIM] - counts[WORD_DIM:]).tolist(), len(text), len(slots), text.count(".") + text.count(","), text[-1] in ".!?"


class Head(str):
    """The start of a block's text, with what was read of the whole."""

    whole: tuple


def features(page: list[Block], paths: dict) -> np.ndarray:
    """(blocks, INPUTS): hashed path, all words hashed, measures of length, stops and links."""
    x = np.zeros((len(page), INPUTS), np.float32)
    measures = []
    for i, (path, text, linked) in enumerate(page):
        v = paths.get(path)
        if v is None:
            if len(paths) > 20_000:
                paths.clear()
            v = paths[path] = np.clip(_slots(path, PATH_DIM), -2, 2)
        row = x[i]
        row[:PATH_DIM] = v
        words, *more = text.whole if isinstance(text, Head) else read(text)
        row[PATH_DIM : PATH_DIM + WORD_DIM] = np.clip(np.array(words, np.float32) / np.sqrt(more[1]), -1.5, 1.5)  # long, short and repetitive blocks alike in size
        measures.append((*more, linked))
    m = np.array(measures, np.float32)
    x[:, PATH_DIM + WORD_DIM :] = np.c_[np.log1p(m[:, 0]) / 5, np.log1p(m[:, 1]) / 4, m[:, 2] / (m[:, 1] + 1), m[:, 3], np.ones(len(m)), m[:, 4] / (m[:, 0] + 1)]
    return x


INPUTS = PATH_DIM + WORD_DIM + 6


def weak_label(path: frozenset) -> float:
    """1 inside content and outside anything that is boilerplate; plain elements count by their tag name."""
    names = {x.removeprefix("<") for x in path}
    return float(not names & BOILERPLATE and bool(names & CONTENT or "p" in names))


# Elements in which articles hold text beside paragraphs.
_FORMS = [x.split() for x in ("<ul <li", "<ol <li", "<table <tr <td", "<table <tr <th", "<blockquote", "<blockquote <p", "<h2", "<h3", "<h4", "<pre",
                              "<figure <figcaption", "<dl <dt", "<dl <dd", "<div", "<section <p", "<section <h2", "<div <p", "<b <p", "<table <tbody <tr <td")]


# What menus, legal lines, comments, adverts, notices and forms commonly say, in the four languages of the tables.
_SAYINGS = {kind: [x.strip() for x in lines.split("|")] for kind, lines in {
    "menu": """Home | About us | Contact | Products | News | Blog | Search | Back to top | Next page | Read more | Startseite | Über uns | Kontakt | Suche | Mehr lesen
        | Accueil | À propos | Rechercher | Lire la suite | Inicio | Sobre nosotros | Contacto | Buscar | Leer más | Related articles | You may also like | Most read""",
    "legal": """© 2021 Acme Ltd. All rights reserved. | Copyright 2019 The Company. All rights reserved. | Privacy policy | Terms of use | Privacy Terms Imprint | Alle Rechte vorbehalten.
        | Impressum Datenschutz | Tous droits réservés. | Mentions légales Confidentialité | Todos los derechos reservados. | Aviso legal Privacidad | Powered by Press | Sitemap""",
    "comment": """Nice article, thanks for sharing! | Great post. | I totally agree with you. | I disagree, this is wrong. | Thank you, this helped me a lot. | Reply | Anna says: | Posted by max on 3 May
        | 12 comments | Leave a comment | Danke für den Artikel! | Toller Beitrag, ich stimme zu. | Merci pour cet article ! | Je suis d'accord. | Gracias por el artículo. | Muy buen texto.""",
    "advert": """Advertisement | Sponsored | Buy now | Buy now and save 50% today! | Limited offer: free shipping on all orders. | Click here for the best deals. | Anzeige | Jetzt kaufen
        | Publicité | Achetez maintenant | Publicidad | Compra ahora""",
    "notice": """We use cookies to improve your experience. Accept all Reject | This site uses cookies. Learn more. | Accept | Wir verwenden Cookies. Akzeptieren
        | Nous utilisons des cookies. Accepter | Usamos cookies. Aceptar | Please enable JavaScript to continue. | Allow notifications?""",
    "form": """Subscribe to our newsletter | Your email address | Sign up | Log in | Username Password | Submit | Newsletter abonnieren | Anmelden | S'abonner | Se connecter
        | Suscríbete | Iniciar sesión | Share on Facebook | Tweet | Follow us""",
}.items()}
_TAGS = "<p <p <li <h2 <h3 <span <a <div <label <section <td".split()
_NAMED = frozenset("<" + x for x in "nav header footer aside form article main button menu select option dialog section label".split())


def _unnamed(page: list[Block], rng: np.random.Generator) -> list[Block]:
    """The page with made-up names in place of its own, and mostly without the elements whose names tell what they hold."""
    bare, names, paths = rng.random() < 0.7, {}, {}
    for path in dict.fromkeys(b[0] for b in page):
        new = set()
        for t in sorted(path):
            if t[0] != "<" and t not in names:
                names[t] = "".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(1, 9)))
            new.add("<div" if bare and t in _NAMED else names.get(t, t))
        paths[path] = frozenset(new)
    return [(paths[path], text, linked) for path, text, linked in page]


def _repetitive(block: Block, rng: np.random.Generator) -> Block:
    """The block with one of its words in place of all, so that no single word decides."""
    path, text, linked = block
    said = " ".join([str(rng.choice(text[:MAX_SPARE].split() or [text]))] * int(2 ** rng.uniform(0, 10)))
    return path, said, len(said) if linked else 0


def _varied(page: list[Block], rng: np.random.Generator, spare: list[str]) -> tuple[list[Block], list[float]]:
    """A training page with renamed wrappers and blocks of other kinds put among its own; three in ten lose all telling names, so that
    words, measures and neighbours have to decide."""
    marks, kept, nameless = sorted(BOILERPLATE), sorted(CONTENT), rng.random() < 0.3

    def wrapper(name: str) -> frozenset:
        tag = f"<{name}" if f"<{name}" in _NAMED and rng.random() < 0.7 else "<div"
        own = {tag} if tag != "<div" else {"<div", name}
        return frozenset({"<html", "<body"} | own | {x for x in name.split("-") if tag == "<div"})

    home = frozenset({"<html", "<body"}) | wrapper(str(rng.choice(kept)))
    if rng.random() < 0.3:
        home |= {"<main"}

    def other(inside: bool) -> list[Block]:
        path = wrapper(marks[rng.integers(len(marks))]) | (home if inside else frozenset())
        tag = frozenset({_TAGS[rng.integers(len(_TAGS))]} if rng.random() < 0.8 else ())
        said = _SAYINGS[str(rng.choice(sorted(_SAYINGS)))] if nameless or rng.random() < 0.4 else spare
        told = [" ".join(said[j] for j in rng.integers(0, len(said), 1 if said is spare else (1, 1, 1, 2, 3)[rng.integers(5)])) for _ in range(rng.integers(1, 5))]
        return [(path | tag, t, int(len(t) * (rng.random() < 0.3))) for t in told]

    renamed = []
    for path, text, linked in page:
        if weak_label(path):
            inner = path - {"<article", "<main"} | home | ({"<section"} if rng.random() < 0.1 else frozenset())
            if rng.random() < 0.25:
                inner = inner - {"<p"} | set(_FORMS[int(rng.integers(len(_FORMS)))])
                text = text[: int(rng.integers(1, 400))].strip() or text
            renamed.append((inner, text, linked))
        else:
            renamed.append((path, text, linked))
    if rng.random() < 0.3:
        renamed = page
    out: list[tuple[Block, float]] = [(b, weak_label(b[0])) for b in renamed]
    for _ in range(rng.integers(0, 9)):
        inside = rng.random() < 0.3
        at = int(rng.integers(0, len(out) + 1)) if inside else int(rng.choice([0, len(out)]))
        out[at:at] = [(b, 0.0) for b in other(inside)]
    told = [_repetitive(b, rng) if rng.random() < 0.06 else b for b, _ in out]
    return _unnamed(told, rng) if nameless else told, [y for _, y in out]


def _head(start: str, whole: list) -> Head:
    out = Head(start)
    out.whole = tuple(whole)
    return out


def _drawn(page_id: str, n: int, limit: int) -> list[int]:
    """``limit`` of the places 0..n-1 in order, drawn over all of them by a hash of the page and the place."""
    if n <= limit:
        return list(range(n))
    return sorted(sorted(range(n), key=lambda i: (xxhash.xxh3_64_intdigest(f"{page_id}:{i}"), i))[:limit])


def training_blocks(page_id: str, source: str) -> tuple[list[Block], list[str]]:
    """Training blocks of a page, as runs of ``RUN`` neighbours drawn over the whole page, and the starts of ``SPARES`` of its
    blocks, drawn likewise, as texts of added blocks."""
    page = blocks(source)
    runs = _drawn(page_id, -(-len(page) // RUN), MAX_BLOCKS // RUN)
    chosen = [b for k in runs for b in page[k * RUN : (k + 1) * RUN]]
    return chosen, [page[i][1][:MAX_SPARE] for i in _drawn(f"{page_id}:spare", len(page), SPARES)]


def train(pages: DataFrame, limit: int = MAX_PAGES, seed: int = 7, epochs: int = 18) -> dict[str, np.ndarray]:
    def cut(frames):
        for f in frames:
            rows = []
            for page_id, source in zip(f["page_id"], f["html"], strict=True):
                chosen, spare = training_blocks(str(page_id), source)
                sent = [[sorted(path), text[:MAX_SPARE], read(text), linked] for path, text, linked in chosen]
                rows.append((page_id, json.dumps(sent), json.dumps(spare)))
            yield pd.DataFrame(rows, columns=["page_id", "blocks", "spare"])

    some = pages.where("html is not null and page_id is not null").select("page_id", "html")
    keys = some.select("page_id").distinct().orderBy(F.md5(F.col("page_id").cast("string")), "page_id").limit(limit)
    sample = some.join(F.broadcast(keys), "page_id").groupBy("page_id").agg(F.min("html").alias("html"))
    rng = np.random.default_rng(seed)
    rows = [r for r in sample.mapInPandas(cut, f"page_id {some.schema['page_id'].dataType.simpleString()}, blocks string, spare string").orderBy("page_id").collect() if r["blocks"] != "[]"]
    parsed = [[(frozenset(path), _head(start, whole), linked) for path, start, whole, linked in json.loads(r["blocks"])] for r in rows]
    p = lstm.init(rng, INPUTS, HIDDEN, 1)
    if not parsed:
        return p
    spare = [t[: int(rng.integers(8, MAX_SPARE))] for r in rows for t in json.loads(r["spare"])]
    adam, paths = lstm.Adam(p), {}
    for epoch in range(epochs):
        adam.rate = 1e-2 * (0.82**epoch)
        data = [_varied(page, rng, spare) for page in parsed]
        xs, ys = [features(b, paths) for b, _ in data], [np.array(y, np.float32)[:, None] for _, y in data]
        groups = list(lstm.batches([len(x) for x in xs], 250))
        for k in rng.permutation(len(groups)):
            x, mask = lstm.pad([xs[i] for i in groups[k]])
            y, _ = lstm.pad([ys[i] for i in groups[k]])

            def loss(z, y=y, mask=mask):
                q = 1 / (1 + np.exp(-np.clip(z, -20, 20)))
                m = mask[:, :, None]
                return float(-(m * (y * np.log(q + 1e-9) + (1 - y) * np.log(1 - q + 1e-9))).sum() / m.sum()), ((q - y) * m / m.sum() * 8).astype(np.float32), {}

            adam.step(lstm.gradients(p, x, mask, loss)[1])
    return p


def label(parsed: list[list[Block]], p: dict, paths: dict) -> list[np.ndarray]:
    """For each page, which blocks are content. ``paths`` remembers path vectors; biases are part of the gates."""
    out: list[np.ndarray] = [np.zeros(0, bool)] * len(parsed)
    some = [i for i, b in enumerate(parsed) if b]
    for group in lstm.batches([len(parsed[i]) for i in some], 20_000):
        x, mask = lstm.pad([features(parsed[some[i]], paths) for i in group])
        z = lstm.forward(p, x, mask)[:, :, 0]
        for i, row in zip(group, z, strict=True):
            out[some[i]] = row[: len(parsed[some[i]])] > 0
    return out


def main_text(pages: DataFrame, p: dict) -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""

    @F.pandas_udf("string")
    def text(source: pd.Series) -> pd.Series:
        paths: dict = {}
        out: list[str] = []
        for at in range(0, len(source), 500):
            parsed = [blocks(x) for x in source[at : at + 500]]
            out += ["\n\n".join(b[1] for b, keep in zip(page, kept, strict=True) if keep) for page, kept in zip(parsed, label(parsed, p, paths), strict=True)]
        return pd.Series(out)

    # the text is made once, below the projection that counts its characters
    return pages.select("page_id", "url", F.explode(F.array(text("html"))).alias("text")).withColumn("n_chars", F.length("text").cast("bigint"))
