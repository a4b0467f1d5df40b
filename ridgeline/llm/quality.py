"""Quality rules: base counts, and how much of a text lies in repeated n-grams and lines."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.llm.common import read_table, ship, text_slices

#: Largest share of a text's word characters inside n-grams found twice or more, by n in words.
NGRAM_SHARES = {5: 0.35, 7: 0.3, 10: 0.25}
#: Largest share of word characters in lines equal to an earlier line.
LINE_SHARE = 0.3
#: Symbols a word.
SYMBOLS_PER_WORD = 0.1
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

_SYMBOLS = b"#*$%&|<>"
_NO_SYMBOL = bytes(x for x in range(256) if x not in _SYMBOLS)
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_MIX = np.uint64(0xBF58476D1CE4E5B9)

MEASURES = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, dup_line_share double, " + ", ".join(f"dup_{n}gram_share double" for n in NGRAM_SHARES)


def covered(starts: np.ndarray, width: int, n: int) -> np.ndarray:
    """Which of n places lie in a window of `width` at one of the starts."""
    edge = np.zeros(n + 1, np.int64)
    edge[starts] += 1
    edge[starts + width] -= 1
    return np.cumsum(edge[:-1]) > 0


def _twice(values: np.ndarray) -> np.ndarray:
    """Places whose value occurs twice or more."""
    order = np.argsort(values, kind="stable")
    ranked = values[order]
    same = ranked[1:] == ranked[:-1]
    dup = np.zeros(len(values), bool)
    dup[order[1:][same]] = True
    dup[order[:-1][same]] = True
    return np.flatnonzero(dup)


def _windows(ids: np.ndarray) -> np.ndarray:
    """A number for each 3-word window, equal for equal windows only (no hashing)."""
    width = int(ids.max()) + 1
    if width < 1 << 21:
        return (ids[:-2] * width + ids[1:-1]) * width + ids[2:]
    pairs = np.unique(ids[:-1] * width + ids[1:], return_inverse=True)[1]
    return pairs[:-1] * width + ids[2:]


def measure(text: str | None) -> tuple:
    """The columns of MEASURES after doc_id. No text or no word: zeros, which fail the base rule."""
    raw = (text or "").encode("utf-8", "replace")
    words = raw.split()
    n = len(words)
    symbols = len(raw.translate(None, _NO_SYMBOL))
    if not n:
        return (0, 0, symbols, 0, 0, True, False, 0.0, *[0.0] * len(NGRAM_SHARES))
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
    sizes = np.array([len(w) for w in number] if raw.isascii() else [len(w.decode("utf-8")) for w in number], np.int64)[ids]
    chars = int(sizes.sum())

    seen: set[bytes] = set()
    dup_lines = dup_line_chars = 0
    for line in raw.split(b"\n"):
        if line in seen:
            dup_lines += 1
            dup_line_chars += sum(len(w.decode("utf-8")) for w in line.split())
        elif line and not line.isspace():
            seen.add(line)

    repeated = 0
    if n >= 3:
        again = _twice(_windows(ids))
        repeated = int(covered(again, 3, n).sum()) if len(again) else 0
    mixed = (ids.astype(np.uint64) + np.uint64(1)) * _MIX
    mixed ^= mixed >> np.uint64(31)
    shares, rolled, length = [], mixed, 1
    for want in NGRAM_SHARES:
        if n < want:
            shares.append(0.0)
            continue
        while length < want:  # the hash of n + 1 words from that of n
            rolled = rolled[:-1] * _BASE + mixed[length:]
            length += 1
        again = _twice(rolled)
        shares.append(float(sizes[covered(again, want, n)].sum()) / chars if len(again) else 0.0)
    line_share = dup_line_chars / chars
    failed = n < MIN_WORDS or 100 * repeated > MAX_REPEAT_PERCENT * n
    kept = not failed and line_share <= LINE_SHARE and symbols <= SYMBOLS_PER_WORD * n and all(s <= m for s, m in zip(shares, NGRAM_SHARES.values(), strict=True))
    return (n, chars, symbols, dup_lines, repeated, failed, kept, line_share, *shares)


def measure_quality(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per row of docs with the base counts, the shares in repetitions and the verdict.

    Base counts compare words and lines exactly. The verdict also needs few symbols a word,
    a small share of characters in repeated lines, and in repeated n-grams of each length, which
    rolling hashes of word numbers find. Null text: no words, so it fails; null doc_id and repeated rows
    are carried; other columns are ignored; an empty table gives no row. Memory holds one slice of texts.
    """
    ship(docs.sparkSession)
    types = [t.split()[1] for t in MEASURES.split(", ")]
    names = [t.split()[0] for t in MEASURES.split(", ")]
    arrow = {"long": pa.int64(), "boolean": pa.bool_(), "double": pa.float64()}

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in text_slices(batch, "text"):
                cols = list(zip(*map(measure, texts), strict=True))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, len(texts)), *(pa.array(c, arrow[t]) for c, t in zip(cols, types[1:], strict=True))], names=names)

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(rows, MEASURES)


def keep_quality(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """The rows of docs that the rules keep, with all their columns as they are."""
    ship(docs.sparkSession)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [measure(t)[6] for _, texts in text_slices(batch, text) for t in texts]
            yield batch.filter(pa.array(kept, pa.bool_()))

    return docs.mapInArrow(rows, docs.schema)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measure_quality(read_table(spark, sf_dir, "documents"))


_WINDOWS = """
w{n} AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, array_to_string(words[i:i + {n} - 1], ' ')) AS times
  FROM (SELECT doc_id, words, unnest(range(1, n_words - {n} + 2)) AS i FROM t)),
c{n} AS (SELECT doc_id, count(*) AS covered_words, sum(length(words[i])) AS covered_chars
  FROM (SELECT DISTINCT doc_id, i + j AS i FROM w{n}, range({n}) r(j) WHERE times > 1) JOIN t USING (doc_id) GROUP BY doc_id)"""

OP9_SQL = f"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words, len(words) AS n_words FROM documents
), lines AS (
  SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id, line ORDER BY k) AS nth FROM (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM t)
  WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')
), dup_lines AS (
  SELECT doc_id, count(*) AS n_dup_lines, sum(length(regexp_replace(line, '[\\x20\\x09-\\x0D]', '', 'g'))) AS chars FROM lines WHERE nth > 1 GROUP BY doc_id
), {", ".join(_WINDOWS.format(n=n) for n in (3, *NGRAM_SHARES))},
m AS (
  SELECT t.doc_id, n_words::BIGINT AS n_words, coalesce(list_sum(list_transform(words, lambda w: length(w))), 0)::BIGINT AS word_chars,
    (length(text) - length(translate(text, '#*$%&|<>', '')))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(c3.covered_words, 0)::BIGINT AS n_repeat_words,
    coalesce(dup_lines.chars, 0)::DOUBLE AS line_chars, {", ".join(f"coalesce(c{n}.covered_chars, 0)::DOUBLE AS chars{n}" for n in NGRAM_SHARES)}
  FROM t LEFT JOIN dup_lines USING (doc_id) {" ".join(f"LEFT JOIN c{n} ON c{n}.doc_id = t.doc_id" for n in (3, *NGRAM_SHARES))}
), s AS (
  SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed,
    coalesce(line_chars / nullif(word_chars, 0), 0) AS dup_line_share, {", ".join(f"coalesce(chars{n} / nullif(word_chars, 0), 0) AS dup_{n}gram_share" for n in NGRAM_SHARES)}
  FROM m
)
SELECT *, NOT base_failed AND dup_line_share <= {LINE_SHARE} AND n_symbols <= {SYMBOLS_PER_WORD} * n_words
  AND {" AND ".join(f"dup_{n}gram_share <= {m}" for n, m in NGRAM_SHARES.items())} AS kept FROM s
"""
