"""DuckDB SQL for the registered queries that SQL can express; it states the result and not the method."""

from weft.llm.decontam import SEPARATORS
from weft.llm.quality import BOTH_CLASS_DISTANCE, BOTH_WORD_DISTANCE, CLASSES, COMMON_WORDS, GUARD_CHARS, GUARD_WORDS, MAX_CLASS_DISTANCE, MAX_WORD_DISTANCE, VOCABULARY

_WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_BLANK = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _quality() -> str:
    n = len(CLASSES) + 2
    vocabulary = "[" + ", ".join(map(_quoted, VOCABULARY)) + "]"
    classes = ", ".join(f"len(regexp_extract_all(t, {_quoted(c)}))" for c in CLASSES.values())
    langs = ", ".join(map(_quoted, COMMON_WORDS))
    part = "list_sum(list_transform(list_zip(p, q), lambda z: CASE WHEN z[{a}] > 0 THEN z[{a}] * log2(2 * z[{a}] / (z[1] + z[2])) ELSE 0.0 END))"
    distance = f"sqrt(greatest(0.0, ({part.format(a=1)} + {part.format(a=2)}) / 2))"
    return rf"""
WITH base AS (
  SELECT doc_id, lang, coalesce(text, '') AS t, {_WORDS} AS w FROM documents
), windows AS (
  SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM base)
), twice AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS n FROM windows) WHERE n > 1
), repeated AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM twice) GROUP BY doc_id
), feats AS (
  SELECT doc_id, lang, len(w) AS n_words, len(array_to_string(w, '')) AS word_chars, length(t) AS chars,
    len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols,
    list_filter(string_split(t, chr(10)), lambda x: trim(x, {_BLANK}) <> '') AS ls,
    coalesce(r.n, 0) AS n_repeat_words, [{classes}] AS cls,
    list_filter(list_transform(w, lambda x: lower(rtrim(x, '.,;:!?'))), lambda x: list_contains({vocabulary}, x)) AS norm
  FROM base LEFT JOIN repeated r USING (doc_id)
), counted AS (
  SELECT *, list_transform({vocabulary}, lambda v: len(list_filter(norm, lambda x: x = v))) AS voc, list_append(cls, chars - word_chars) AS cs FROM feats
), bins AS (
  SELECT *, list_append(cs, chars - list_sum(cs)) AS c, list_append(voc, n_words - coalesce(list_sum(voc), 0)) AS v FROM counted
), shares AS (
  SELECT lang, unnest(range(1, len(c) + len(v) + 1)) AS bin,
    unnest(list_concat(list_transform(c, lambda x: round(1000 * x / chars)), list_transform(v, lambda x: round(1000 * x / n_words)))) AS s
  FROM bins WHERE chars >= {GUARD_CHARS} AND n_words >= {GUARD_WORDS} AND lang IN ({langs})
), medians AS (
  SELECT lang, bin, quantile_cont(s, 0.5) AS m FROM shares GROUP BY lang, bin
), refs AS (
  SELECT lang, bin <= {n} AS cl, list(m / total ORDER BY bin) AS q
  FROM (SELECT *, sum(m) OVER (PARTITION BY lang, bin <= {n}) AS total FROM medians) GROUP BY lang, bin <= {n}
), pairs AS (
  SELECT b.doc_id, b.lang, r.lang AS ref, cl, q, CASE WHEN cl THEN list_transform(c, lambda x: x / chars) ELSE list_transform(v, lambda x: x / n_words) END AS p
  FROM bins b, refs r WHERE CASE WHEN cl THEN chars >= {GUARD_CHARS} ELSE n_words >= {GUARD_WORDS} END
), far AS (
  SELECT doc_id, cl, coalesce(min(d) FILTER (WHERE ref = lang), min(d)) AS d FROM (SELECT doc_id, lang, ref, cl, {distance} AS d FROM pairs) GROUP BY doc_id, cl
), judged AS (
  SELECT b.*, len(ls) - len(list_distinct(ls)) AS n_dup_lines, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
    coalesce(x.d, 0.0) AS cd, coalesce(y.d, 0.0) AS wd
  FROM bins b LEFT JOIN far x ON x.doc_id = b.doc_id AND x.cl LEFT JOIN far y ON y.doc_id = b.doc_id AND NOT y.cl
)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
  n_repeat_words::BIGINT AS n_repeat_words, base_failed,
  NOT base_failed AND cd <= {MAX_CLASS_DISTANCE} AND wd <= {MAX_WORD_DISTANCE} AND (cd <= {BOTH_CLASS_DISTANCE} OR wd <= {BOTH_WORD_DISTANCE}) AS kept,
  round(cd, 4) AS class_distance, round(wd, 4) AS word_distance
FROM judged"""


_DECONTAMINATION = rf"""
WITH docs AS (
  SELECT doc_id, list_filter(regexp_split_to_array({_LOWER}, '{SEPARATORS}'), lambda x: x <> '') AS w FROM documents
), items AS (
  SELECT item_id, list_filter(regexp_split_to_array({_LOWER}, '{SEPARATORS}'), lambda x: x <> '') AS w FROM benchmark
), item_windows AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS k
  FROM (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM items WHERE len(w) > 0)
), lengths AS (SELECT DISTINCT n FROM item_windows),
doc_windows AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS k
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM docs, lengths WHERE len(w) >= n)
), hits AS (
  SELECT doc_id, item_id, n, i FROM doc_windows JOIN item_windows USING (n, k)
), words AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id
), found AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN words USING (doc_id) LEFT JOIN found USING (doc_id)"""


_FIXITY = """
WITH recs AS (
  SELECT page_id, url, html, page_id // 500 AS file,
    strlen('WARC/1.1 response ' || url || chr(13) || chr(10) || chr(13) || chr(10) || html || chr(13) || chr(10) || chr(13) || chr(10)) AS n
  FROM pages
), placed AS (
  SELECT *, coalesce(sum(n) OVER (PARTITION BY file ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS o FROM recs
)
SELECT file, o::BIGINT AS "offset", page_id AS record_id, CASE WHEN page_id % 101 = 7 THEN 'missing' ELSE 'changed' END AS fault
FROM placed WHERE page_id % 101 = 7 OR page_id % 97 = 5 AND left(html, 1) <> '#'"""

_JACCARD = rf"""
WITH RECURSIVE docs AS (
  SELECT doc_id, list_filter(regexp_split_to_array({_LOWER}, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM docs WHERE len(w) > 0)
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM docs
  UNION
  SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, min(r.b) AS component_id
FROM docs d LEFT JOIN sizes USING (doc_id) JOIN reach r ON r.a = d.doc_id GROUP BY d.doc_id, n"""

_REPEATS = rf"""
WITH docs AS (
  SELECT doc_id, {_WORDS} AS w FROM documents
), windows AS (
  SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM docs)
), later AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS r FROM windows) WHERE r > 1
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM later
), words AS (
  SELECT doc_id, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS x FROM docs
), kept AS (
  SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS t, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM docs LEFT JOIN kept USING (doc_id)"""

ORACLE: dict[str, str] = {
    "op1_distribution_divergence": _quality(),
    "op3_positional_index": _DECONTAMINATION,
    "op7_parity_sketch_join": _JACCARD,
    "op8_merkle_audit": _FIXITY,
    "op10_block_anchors": _REPEATS,
}
