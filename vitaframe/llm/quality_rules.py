"""Quality rules, line by line first, then for the whole document.

Lines that break a rule are removed:

* navigation: at least three separators, or fewer than eight words that start with
  a list mark or hold a menu phrase,
* boilerplate: a phrase of cookie notices, licences and page footers,
* punctuation: two marks in a row, ten marks at least and over 30 % of the line
  marks, or fewer than eight words without a mark at the end.

A document is rejected if the lines removed hold over 30 % of its characters
without white space, or if it fails the base rules. Null and empty texts have no
words, fail the base rules and are rejected. Lines end with a line feed only.
Rows that repeat a document are judged each. Extra columns play no part.

Words and windows are array functions on one row; lines are rows for their rules,
and only the sums per document are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vitaframe.llm.common import SPACES, read_table

SYMBOLS = "#*$%&|<>"
SEPARATORS = "|>»›•·"
MARK_SET = r"!-/:-@\[-`{-~"
ENDINGS = [".", "!", "?", "…", ":", ";", '"', "”", "»", ")", "'"]
LIST_MARKS = ["- ", "* ", "• ", "» ", "> ", "· "]
MENU = ["sign in", "log in", "read more", "click here", "back to top", "next page", "previous page", "home page", "site map"]
BOILERPLATE = [
    "cookie", "privacy policy", "terms of use", "terms of service", "terms and conditions",
    "all rights reserved", "copyright", "javascript", "lorem ipsum", "spdx-license",
    "licensed under", "released under", "subscribe to", "permission is hereby granted",
]
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MAX_LOST_PERCENT = 30


SPACE_SET = r"\x20\x09-\x0D"


def _count(text: Column, char_set: str) -> Column:
    """Characters of a set, given as the inside of a pattern's brackets."""
    return F.length(F.regexp_replace(text, f"[^{char_set}]+", ""))


def _inside(chars: str) -> str:
    """Characters as the inside of a pattern's brackets."""
    return "".join("\\" + c if c in "\\]^-[&$|" else c for c in chars)


def _any_of(tests: list[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out


def line_fails(bare: Column, low: Column) -> Column:
    """Whether a line breaks a rule; ``bare`` without outer white space, ``low`` in lower case."""
    short = ~bare.rlike(f"^(?:[^{SPACE_SET}]+[{SPACE_SET}]+){{7}}")
    separated = _any_of([bare.contains(c) for c in SEPARATORS]) & (_count(bare, _inside(SEPARATORS)) >= 3)
    navigation = separated | (
        short & _any_of([bare.startswith(m) for m in LIST_MARKS] + [low.contains(m) for m in MENU])
    )
    boilerplate = _any_of([low.contains(p) for p in BOILERPLATE])
    marks, solid = _count(bare, MARK_SET), F.length(bare) - _count(bare, SPACE_SET)
    crowded = bare.rlike(f"[{MARK_SET}]{{2}}") & (marks >= 10) & (marks * 10 > solid * 3)
    unended = short & ~_any_of([bare.endswith(e) for e in ENDINGS])
    return navigation | boilerplate | crowded | unended


def clean_text(text: Column) -> Column:
    """The lines that break no rule, blank ones left out."""
    parts = F.transform(F.split(text, "\n"), lambda x: F.struct(x.alias("line"), F.btrim(x, F.lit(SPACES)).alias("bare")))
    good = F.filter(parts, lambda p: (p["bare"] != "") & ~line_fails(p["bare"], F.lower(p["bare"])))
    return F.concat_ws("\n", F.transform(good, lambda p: p["line"]))


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The base measures: ``id``, ``row`` (a number of its own), ``text`` and counts.

    Windows of three words are found again by a 64-bit hash; places of equal hash
    are sorted together and count only where the words are equal, too.
    """
    t = docs.select(
        F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("row"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    t = t.select(
        "id", "row", "text",
        F.filter(F.split("text", f"[{SPACE_SET}]+"), lambda w: w != "").alias("words"),
        F.filter(F.split("text", "\n"), lambda x: x.rlike(f"[^{SPACE_SET}]")).alias("lines"),
    )
    words, wins, placed = F.col("words"), F.col("wins"), F.col("placed")
    hashes = F.transform(words, lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)))
    t = t.withColumn("wins", F.when(F.size(words) > 2, F.slice(hashes, F.lit(1), F.size(words) - 2)))
    # Only documents with a repeated window are sorted.
    t = t.withColumn(
        "placed",
        F.when(
            F.size(F.array_distinct(wins)) < F.size(wins),
            F.sort_array(F.transform(wins, lambda w, i: F.struct(w.alias("w"), i.alias("i")))),
        ),
    )

    def same(x: Column, y: Column) -> Column:
        pairs = [F.get(words, x["i"] + k) == F.get(words, y["i"] + k) for k in range(3)]
        return F.coalesce((x["w"] == y["w"]) & pairs[0] & pairs[1] & pairs[2], F.lit(False))

    again = F.filter(placed, lambda x, k: same(x, F.get(placed, k - 1)) | same(x, F.get(placed, k + 1)))
    t = t.withColumn("places", F.when(placed.isNotNull(), F.transform(again, lambda x: x["i"])))
    covered = F.array_distinct(F.flatten(F.transform("places", lambda p: F.array(p, p + 1, p + 2))))
    return t.select(
        "id", "row", "text",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.concat_ws("", "words")).cast("long").alias("word_chars"),
        _count(F.col("text"), _inside(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(F.when(F.col("places").isNotNull(), F.size(covered)), F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
    )


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The measures and the verdict of every document.

    Each line is a row while its rules are evaluated; what is left of a document
    is summed up before anything is shuffled.
    """
    base = measure(docs, id_col, text_col)
    names = [c for c in base.columns if c != "text"]
    lines = base.select(*names, F.explode(F.split("text", "\n")).alias("line"))
    lines = lines.withColumn("bare", F.btrim("line", F.lit(SPACES)))
    lines = lines.withColumn("low", F.lower("bare"))
    counted = F.col("bare") != ""
    lines = lines.withColumn("bad", counted & line_fails(F.col("bare"), F.col("low")))
    chars = F.length("bare") - _count(F.col("bare"), SPACE_SET)
    t = lines.groupBy(*names).agg(
        F.count(F.when(counted & ~F.col("bad"), 1)).alias("n_good_lines"),
        F.coalesce(F.sum(F.when(F.col("bad"), chars)), F.lit(0)).cast("long").alias("lost_chars"),
    )
    t = t.withColumn(
        "base_failed",
        (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")),
    )
    kept = ~F.col("base_failed") & (100 * F.col("lost_chars") <= MAX_LOST_PERCENT * F.col("word_chars"))
    return t.withColumn("kept", kept).withColumnRenamed("id", id_col).drop("row")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(read_table(spark, sf_dir, "documents"))


def _sql_list(values: list[str]) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


# Same measures for DuckDB. Built from the constants above.
OP1_SQL = f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (
  SELECT doc_id, text,
    list_filter(string_split_regex(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words,
    list_filter(string_split(text, chr(10)), lambda x: regexp_replace(x, '[\\x20\\x09-\\x0D]', '', 'g') <> '') AS lines
  FROM t),
wins AS (
  SELECT doc_id, unnest(range(1, len(words) - 1)) AS i, words FROM w WHERE len(words) >= 3),
rep AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, words[i], words[i + 1], words[i + 2]) AS n FROM wins),
cov AS (
  SELECT doc_id, count(DISTINCT p) AS n_repeat_words
  FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM rep WHERE n >= 2) GROUP BY doc_id),
l AS (
  SELECT doc_id, unnest(lines) AS line FROM w),
m AS (
  SELECT doc_id, line, regexp_replace(line, '[\\x20\\x09-\\x0D]', '', 'g') AS solid,
    trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare FROM l),
f AS (
  SELECT *, lower(bare) AS low, len(string_split_regex(bare, '[\\x20\\x09-\\x0D]+')) < 8 AS short FROM m),
j AS (
  SELECT doc_id, length(solid) AS chars,
    (length(line) - length(translate(line, '{SEPARATORS}', '')) >= 3
     OR (short AND (list_any_prefix OR list_any_menu)))
    OR list_any_boiler
    OR (doubled AND marks * 10 > length(solid) * 3 AND marks >= 10)
    OR (short AND NOT list_any_end) AS fails
  FROM (SELECT *,
      length(regexp_replace(bare, '[^{MARK_SET}]+', '', 'g')) AS marks,
      regexp_matches(bare, '[{MARK_SET}]{{2}}') AS doubled,
      len(list_filter([{_sql_list(LIST_MARKS)}], lambda p: starts_with(bare, p))) > 0 AS list_any_prefix,
      len(list_filter([{_sql_list(MENU)}], lambda p: contains(low, p))) > 0 AS list_any_menu,
      len(list_filter([{_sql_list(BOILERPLATE)}], lambda p: contains(low, p))) > 0 AS list_any_boiler,
      len(list_filter([{_sql_list(ENDINGS)}], lambda p: ends_with(bare, p))) > 0 AS list_any_end
    FROM f)),
g AS (
  SELECT doc_id, count(*) FILTER (NOT fails) AS n_good_lines, sum(chars) FILTER (fails) AS lost FROM j GROUP BY doc_id),
r AS (
  SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(translate(text, '{SYMBOLS}', '')) AS BIGINT) AS n_symbols,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
    CAST(len(lines) AS BIGINT) AS n_lines,
    CAST(coalesce(n_good_lines, 0) AS BIGINT) AS n_good_lines,
    CAST(coalesce(lost, 0) AS BIGINT) AS lost_chars
  FROM w LEFT JOIN cov ON w.doc_id = cov.doc_id LEFT JOIN g ON w.doc_id = g.doc_id)
SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed,
  NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words)
    AND 100 * lost_chars <= {MAX_LOST_PERCENT} * word_chars AS kept
FROM r
"""
