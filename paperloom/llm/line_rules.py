"""Quality rules: base counts of each text, and cross-document line frequency.

Normalised lines are hashed, distinct documents are counted per host (here: source) and line, lines
above the limits are removed, and documents that lose too much are rejected. Built-in functions
only. The base counts stay inside a row, so they need no shuffle; the line counts shuffle one narrow
row per distinct line of a document, once, and are written down for the steps that follow.

Both limits on a line have to be passed: the number keeps small hosts from losing what a few of their
documents share by chance, the share keeps large hosts from losing what is common in their language.

Defined results: null text has no words and fails the base rules; a null source is a host of its
own; documents are told apart by ``doc_id``, and rows without one by their text, so repeated rows count
once in the line statistics and get the same verdict as a single one; rows of one ``doc_id`` with
different texts or sources are judged each by its own lines; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CHARS, cut, words

SYMBOLS = "#*$%&|<>"
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: A line is removed if more documents of its host have it than both limits allow.
MAX_DOCS, MAX_SHARE = 20, 0.002
#: After removal a document needs this many words, and this share of those it had.
LEFT_WORDS, LEFT_SHARE = 25, 0.3


def base_counts(docs: DataFrame) -> DataFrame:
    """doc_id, source, a hash of the text and the base counts."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.translate(x, SPACE_CHARS, "") != "")
    out = docs.select("doc_id", "source", "text", F.transform(words(F.col("text")), lambda w: F.xxhash64(w)).alias("wh"), lines.alias("lines"))
    out = out.withColumn("n_words", F.size("wh").cast("long")).withColumn("m", F.greatest(F.col("n_words") - 2, F.lit(0)).cast("int"))
    first, second, third = (F.slice("wh", k, F.col("m")) for k in (1, 2, 3))
    windows = F.zip_with(F.zip_with(first, second, lambda a, b: F.struct(a.alias("a"), b.alias("b"))), third, lambda x, c: F.xxhash64(x["a"], x["b"], c))
    out = out.withColumn("windows", windows)
    out = out.withColumn("ordered", F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("p")))))
    rest = F.greatest(F.col("m") - 1, F.lit(0))
    twice = F.zip_with(F.slice("ordered", 1, rest), F.slice("ordered", 2, rest), lambda a, b: F.when(a["h"] == b["h"], F.array(a["p"], b["p"])))
    starts = F.sort_array(F.array_distinct(F.flatten(F.filter(twice, lambda x: x.isNotNull()))))
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-1).alias("end"))
    covered = F.aggregate(starts, zero, lambda s, p: F.struct((s["n"] + p + 3 - F.greatest(s["end"], p)).alias("n"), (p + 3).alias("end")))
    return out.select(
        "doc_id",
        "source",
        F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"),
        "n_words",
        F.length(F.translate(text, SPACE_CHARS, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        covered["n"].alias("n_repeat_words"),
    ).withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))


def normal_line(line: Column) -> Column:
    """Lower case, digits as one mark, white space as one space."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(line), r"[0-9]+", "0"), r"[\x20\x09-\x0D]+", " "))


def line_losses(docs: DataFrame, max_docs: int = MAX_DOCS, max_share: float = MAX_SHARE) -> DataFrame:
    """doc_id, host, text_hash, words_lost: words on lines that more documents of the host have than the limits allow."""
    lines = F.filter(F.split("text", "\n", -1), lambda x: F.translate(x, SPACE_CHARS, "") != "")
    mark = F.array(F.lit(None).cast("string"))  # a line of nothing, once for each row, whatever its text
    line = F.explode(F.concat(mark, F.coalesce(lines, F.array().cast("array<string>")))).alias("line")
    rows = docs.select("doc_id", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("host"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), line)
    hashed = F.when(F.col("line").isNotNull(), F.xxhash64(normal_line(F.col("line")))).alias("h")
    rows = rows.select("doc_id", "host", "text_hash", hashed, F.regexp_count("line", F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("w"))
    # one row per text of a document and distinct line; `times` counts repeated rows too
    per_text = cut(rows.groupBy("doc_id", "host", "text_hash", "h").agg(F.max("w").alias("w"), F.count("*").alias("times")))
    name = F.struct("doc_id", F.when(F.col("doc_id").isNull(), F.col("text_hash")).alias("own")).alias("name")
    docs_of = per_text.select("host", "h", name).distinct().groupBy("host", "h").agg(F.count("*").alias("n_docs"))
    hosts = docs_of.where("h is null").select("host", F.col("n_docs").alias("host_docs"))
    over = docs_of.where((F.col("h").isNotNull()) & (F.col("n_docs") > max_docs)).join(hosts, "host").where(F.col("n_docs") > max_share * F.col("host_docs")).select("host", "h")
    text = ["doc_id", "host", "text_hash"]
    gone = per_text.join(over, ["host", "h"], "left_semi").groupBy(*text).agg(F.sum(F.col("w") * F.col("times")).alias("words"))
    repeats = per_text.where("h is null").select(*text, "times")
    same = F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.host") == F.col("b.host")) & (F.col("a.text_hash") == F.col("b.text_hash"))
    return gone.alias("a").join(repeats.alias("b"), same).select("a.doc_id", "a.host", "a.text_hash", (F.col("a.words") / F.col("b.times")).cast("long").alias("words_lost"))


def judge(docs: DataFrame, max_docs: int = MAX_DOCS, max_share: float = MAX_SHARE, left_words: int = LEFT_WORDS, left_share: float = LEFT_SHARE) -> DataFrame:
    """Base counts, words_lost and the verdict ``kept`` of every row."""
    base, lost = base_counts(docs).alias("a"), line_losses(docs, max_docs, max_share).alias("b")
    same = F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.coalesce(F.concat(F.lit("="), "a.source"), F.lit("")) == F.col("b.host")) & (F.col("a.text_hash") == F.col("b.text_hash"))
    both = base.join(lost, same, "left").select("a.*", F.least(F.coalesce("b.words_lost", F.lit(0)), F.col("a.n_words")).alias("words_lost")).drop("text_hash")
    left = F.col("n_words") - F.col("words_lost")
    depleted = (F.col("words_lost") > 0) & ((left < left_words) | (left < left_share * F.col("n_words")))
    return both.withColumn("kept", ~F.col("base_failed") & ~depleted)


def op4(docs: DataFrame) -> DataFrame:
    return judge(docs).drop("source")


ORACLE_SQL = r"""
WITH w AS (
  SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), win AS (
  SELECT r, i, (words[i], words[i + 1], words[i + 2]) AS x FROM w, unnest(range(1, len(words) - 1)) AS u(i)
), twice AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, x) AS n FROM win) WHERE n > 1
), repeats AS (
  SELECT r, count(DISTINCT i + k) AS n FROM twice, (SELECT unnest([0, 1, 2]) AS k) GROUP BY r
), lines AS (
  SELECT r, doc_id, source, text, l AS line FROM w, unnest(string_split(text, chr(10))) AS u(l) WHERE regexp_matches(l, '[^\x20\x09-\x0D]')
), dup AS (
  SELECT r, count(*) - count(DISTINCT line) AS n FROM lines GROUP BY r
), normal AS (
  SELECT r, coalesce(doc_id::VARCHAR, 'text ' || text) AS name, source, trim(regexp_replace(regexp_replace(lower(line), '[0-9]+', '0', 'g'), '[\x20\x09-\x0D]+', ' ', 'g')) AS line,
         len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n FROM lines
), hosts AS (
  SELECT source AS s, count(DISTINCT coalesce(doc_id::VARCHAR, 'text ' || text)) AS host_docs FROM w GROUP BY source
), over AS (
  SELECT source, line FROM (SELECT source, line, count(DISTINCT name) AS n_docs FROM normal GROUP BY source, line) a
  JOIN hosts b ON a.source IS NOT DISTINCT FROM b.s WHERE n_docs > 20 AND n_docs > 0.002 * host_docs
), lost AS (
  SELECT r, sum(n) AS n FROM normal JOIN over ON normal.source IS NOT DISTINCT FROM over.source AND normal.line = over.line GROUP BY r
), base AS (
  SELECT w.doc_id, len(words)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(dup.n, 0)::BIGINT AS n_dup_lines,
         coalesce(repeats.n, 0)::BIGINT AS n_repeat_words, least(coalesce(lost.n, 0), len(words))::BIGINT AS words_lost
  FROM w LEFT JOIN dup USING (r) LEFT JOIN repeats USING (r) LEFT JOIN lost USING (r)
), failed AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM base)
SELECT *, NOT base_failed AND NOT (words_lost > 0 AND (n_words - words_lost < 25 OR n_words - words_lost < 0.3 * n_words)) AS kept FROM failed
"""
