"""Token ids as flat files of unsigned integers with 64-bit document offsets, for readers that map them into memory.

A corpus is a folder of numbered parts in ascending document order; part n holds
  part-n.bin   token ids of all its documents, little-endian unsigned integers without any header: 16 bits where the
               vocabulary allows it, else 32
  part-n.off   unsigned 64-bit offsets, counted in ids from the start of the part: one for each document, and the end
  part-n.key   the documents' ids, signed 64-bit; the part's first ``n_null`` documents have none
and ``parts``, a Parquet table with one row for each part: its counts, and its bases - how many ids and documents lie in all parts
before it. Bases are prefix sums over that table, so no task knows more than its own part, and a document's place in the whole
corpus is base plus offset.

Writing: rows are range-partitioned by (doc_id, text checksum, place in the input), so repeated ids and repeated rows are spread as well;
a task sorts its range, encodes some 500 texts at a time and appends. A part is written under a name of its own
and renamed when it is whole: a repeated attempt of a task gives the same bytes and replaces it. The folder has to be one that
all executors reach; plain paths and ``file:`` are mapped into memory, other stores that pyarrow knows are read whole part by part.

Token ids are those of the tokenizers library. A byte-level vocabulary encodes each pre-token alone, so a worker remembers pre-tokens
in a bounded table and hands the library those that it has not met, some thousand together. Texts with other than plain characters are
cut at single spaces between two characters that are not white space only, where a pre-token always begins. Both give the ids of whole texts (tested).

Defined cases: null text is empty and holds the end id only; null ids come first; repeated rows are documents of their own; an
empty table gives a corpus without documents; extra columns do not matter; the special token's literal in a text is ordinary text.
"""

from __future__ import annotations

import os
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weft.functions.lineage import materialize, scratch_path

END_TOKEN = 2
CACHE_ENTRIES = 600_000
GROUP_CHARS = 1 << 20
_INNER_SPACE = re.compile(r"(?<=\S) (?=\S)")
# the vocabulary's pre-token pattern for texts of ASCII and the letters of Latin-1, whose classes no library disputes
_PLAIN = re.compile(r"[\t\n\r -~À-ÖØ-öø-ÿ]*\Z")
_PRE_TOKEN = re.compile(r"'(?:[sdmt]|ll|ve|re)| ?[A-Za-zÀ-ÖØ-öø-ÿ]+| ?[0-9]+| ?[!-/:-@\[-`{-~]+|\s+(?!\S)|\s+")
PART_BYTES = 256 << 20  # of text in a part, at most about
_PART = "part int, n_docs bigint, n_null bigint, n_tokens bigint, width int"


def cut(text: str) -> list[str]:
    """The text in pieces that the library encodes the same alone: its own pre-tokens where all characters are plain, else what
    lies between inner single spaces."""
    if _PLAIN.match(text):
        return _PRE_TOKEN.findall(text)
    return [text] if "\0" in text else _INNER_SPACE.sub("\0 ", text).split("\0")


class Encoder:
    """Ids of texts as little-endian bytes of ``width`` each, the end id last."""

    def __init__(self, vocabulary: str, end: int = END_TOKEN):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs a task on each core already
        from tokenizers import Tokenizer

        self.vocabulary = vocabulary
        self._tokenizer = Tokenizer.from_file(vocabulary)
        self._tokenizer.encode_special_tokens = True
        self.width = 2 if self._tokenizer.get_vocab_size() <= 1 << 16 else 4
        numbers = np.arange(self._tokenizer.get_vocab_size(), dtype=f"<u{self.width}")
        self._word = [x.tobytes() for x in numbers]
        self._end = self._word[end]
        self._known: dict[str, bytes] = {}

    def _library(self, texts: list[str]) -> list[bytes]:
        word = self._word.__getitem__
        return [b"".join(map(word, e.ids)) for e in self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> list[bytes]:
        out = []
        for group in _groups(texts):
            pieces = [cut(t) for t in group]
            seen = set().union(*pieces)
            new = list(seen.difference(self._known))
            if len(self._known) + len(new) > CACHE_ENTRIES:
                self._known.clear()
                new = list(seen)
            if len(new) > CACHE_ENTRIES:
                out += [x + self._end for x in self._library(group)]
                continue
            self._known.update(zip(new, self._library(new), strict=True))
            out += [b"".join(map(self._known.__getitem__, x)) + self._end for x in pieces]
        return out


def _groups(texts: list[str]) -> Iterator[list[str]]:
    """The texts in runs of about ``GROUP_CHARS``, or single longer ones."""
    run, size = [], 0
    for t in texts:
        if run and size + len(t) > GROUP_CHARS:
            yield run
            run, size = [], 0
        run.append(t)
        size += len(t)
    if run:
        yield run


@lru_cache(maxsize=2)
def encoder(vocabulary: str | None = None) -> Encoder:
    """The encoder of a worker. ``vocabulary``: a tokenizer file; by default the public 50k byte-level one."""
    import public_tokenizers

    return Encoder(vocabulary or public_tokenizers.path("byte_bpe_50k.json"))


# --- files ---


def _store(folder: str):
    """(file system, path, whether it is local)"""
    from pyarrow import fs

    if folder.startswith("file:"):
        folder = re.sub("^file:/+", "/", folder)
    if folder.startswith("/"):
        return fs.LocalFileSystem(), folder, True
    store, path = fs.FileSystem.from_uri(folder)
    return store, path, False


def _name(folder: str, part: int, kind: str) -> str:
    return f"{folder}/part-{part:06d}.{kind}"


def write_part(folder: str, part: int, rows: Iterable[tuple[int | None, bytes]], width: int) -> tuple[int, int, int]:
    """Writes one part from (document id, ids) and returns (documents, documents without id, tokens)."""
    store, path, _ = _store(folder)
    store.create_dir(path, recursive=True)
    own = uuid.uuid4().hex
    offsets, keys, n_null, at = [0], [], 0, 0
    with store.open_output_stream(f"{_name(path, part, 'bin')}.{own}") as out:
        for key, ids in rows:
            out.write(ids)
            at += len(ids) // width
            offsets.append(at)
            n_null += key is None
            keys.append(key or 0)
    for kind, values in (("off", np.array(offsets, "<u8")), ("key", np.array(keys, "<i8"))):
        with store.open_output_stream(f"{_name(path, part, kind)}.{own}") as out:
            out.write(values.tobytes())
    for kind in ("bin", "off", "key"):
        store.move(f"{_name(path, part, kind)}.{own}", _name(path, part, kind))
    return len(keys), n_null, at


def open_part(folder: str, part: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, offsets, keys) of a part; arrays mapped from the files where the folder is local."""
    store, path, local = _store(folder)

    def load(kind: str, dtype: str) -> np.ndarray:
        name = _name(path, part, kind)
        if store.get_file_info(name).size == 0:
            return np.empty(0, dtype)
        if local:
            return np.memmap(name, dtype, "r")
        with store.open_input_file(name) as f:
            return np.frombuffer(f.read(), dtype)

    return load("bin", f"<u{width}"), load("off", "<u8"), load("key", "<i8")


def documents_of(folder: str, part: int, width: int, n_null: int, token_base: int) -> Iterator[tuple[int | None, int, np.ndarray]]:
    """(document id, start in the whole corpus, ids) of the documents of one part, in order."""
    ids, offsets, keys = open_part(folder, part, width)
    for i, key in enumerate(keys.tolist()):
        a, b = int(offsets[i]), int(offsets[i + 1])
        yield None if i < n_null else key, token_base + a, ids[a:b]


# --- Spark jobs ---


def write(docs: DataFrame, folder: str, vocabulary: str | None = None) -> DataFrame:
    """Writes the corpus of ``docs`` (doc_id, text) below ``folder`` and returns its table of parts with their bases:
    (part, n_docs, n_null, n_tokens, width, doc_base, token_base)."""
    spark = docs.sparkSession
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"),
        F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("_crc"), F.monotonically_increasing_id().alias("_at"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // PART_BYTES))
    order = [F.asc_nulls_first("doc_id"), F.col("_crc"), F.col("_at")]
    placed = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).select(
        F.coalesce("doc_id", F.lit(0)).alias("doc_id"), F.col("doc_id").isNull().alias("none"), "text", F.spark_partition_id().alias("part"))

    def encode(frames):
        enc = encoder(vocabulary)
        part: list[int] = []

        def pairs():
            for f in frames:
                if len(f):
                    part[:] = [int(f["part"].iloc[0])]
                for at in range(0, len(f), 500):
                    some = f.iloc[at : at + 500]
                    for key, none, ids in zip(some["doc_id"].tolist(), some["none"].tolist(), enc.encode(some["text"].tolist()), strict=True):
                        yield None if none else key, ids

        stream = pairs()
        first = next(stream, None)
        if first is not None:
            n_docs, n_null, n_tokens = write_part(folder, part[0], (x for some in ([first], stream) for x in some), enc.width)
            yield pd.DataFrame({"part": [part[0]], "n_docs": [n_docs], "n_null": [n_null], "n_tokens": [n_tokens], "width": [enc.width]})

    counts = materialize(placed.mapInPandas(encode, _PART), "counts")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each part
    table = counts.select(
        "*", F.coalesce(F.sum("n_docs").over(before), F.lit(0)).alias("doc_base"), F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("token_base"))
    table.coalesce(1).write.parquet(f"{folder}/parts")
    return spark.read.parquet(f"{folder}/parts")


def read(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files alone; each part is a task of its own."""
    parts = spark.read.parquet(f"{folder}/parts")

    def load(frames):
        for f in frames:
            for part, width, n_null, base in zip(f["part"], f["width"], f["n_null"], f["token_base"], strict=True):
                out: list[tuple] = []
                for key, start, ids in documents_of(folder, int(part), int(width), int(n_null), int(base)):
                    out.append((key, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    if len(out) == 10_000:
                        yield _rows(out)
                        out = []
                if out:
                    yield _rows(out)

    n = max(1, parts.count())
    each = parts.select("part", "width", "n_null", "token_base", (F.row_number().over(Window.orderBy("part")) - 1).alias("_to"))
    return each.repartitionById(n, F.col("_to").cast("int")).drop("_to").mapInPandas(load, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def _rows(rows: list[tuple]) -> pd.DataFrame:
    key, start, n, crc = zip(*rows, strict=True)
    return pd.DataFrame({"doc_id": pd.array(key, "Int64"), "start": start, "n_tokens": n, "ids_crc32": crc})


def digest(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Writes the corpus to the shared folder and reads it back."""
    folder = scratch_path(docs.sparkSession, "corpus")
    write(docs, folder, vocabulary)
    return read(docs.sparkSession, folder)
