"""Quality rules: a document's own figures, and how often its lines occur in other documents of its host.

Native: DataFrame functions only. A line counts once in a document and exact copies of a
document are one, so a group of copies does not make its own lines frequent. A line in
more than `most_docs` documents of a host, however large the host is, is removed
everywhere but in the document with the smallest id that has it; a document left with
fewer than `least_words` words, or less than `least_left` of them, is rejected.

The texts are read once for all figures and for the hashes of their lines, which are
written as a table; everything else works on that table.

Nulls: a null text has no words, a null source is a host of its own, a null id counts as
0. Texts of a host that share the smallest id all keep the line. Lines without a word are left alone. Very long texts take time in proportion to their
words and lines. Repeated rows are copies, and each gets its row. An empty table gives an
empty one. A column of docs that has the name of a figure is replaced by it in judged();
all others, whatever their names, stay as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.session import written

SPACES = r"[\x20\x09-\x0D]+"
MOST_DOCS, LEAST_WORDS, LEAST_LEFT = 5, 10, 0.2
FIGURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def content(docs: DataFrame) -> Column:
    return F.coalesce(docs["text"], F.lit(""))


def host(docs: DataFrame) -> Column:
    return F.coalesce(docs["source"], F.lit(""))


def key(docs: DataFrame) -> Column:
    """128 bits of a text."""
    return F.unhex(F.md5(content(docs)))


def normal(line: Column) -> Column:
    """Lower case, single blanks, no blanks at the ends."""
    return F.trim(F.lower(F.regexp_replace(line, SPACES, " ")))


def measured(docs: DataFrame, *carried: Column) -> DataFrame:
    """The carried columns, FIGURES, _host, _text (a text's key), _id and _each (hash and word count of each different line).

    The windows of five words are hashed; only a text in which two are equal has them
    sorted, so that equal windows and then neighbouring positions stand side by side.
    """
    text = content(docs)
    lines = F.filter(F.split("_content", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    split = docs.select(*carried, host(docs).alias("_host"), key(docs).alias("_text"), F.coalesce(docs["doc_id"], F.lit(0)).alias("_id"), text.alias("_content"))
    split = split.select("*", F.array_remove(F.split("_content", SPACES, -1), "").alias("_words"), lines.alias("_lines"))
    windows = split.withColumn(
        "_windows",
        F.when(F.size("_words") >= 5, F.expr("transform(sequence(0, size(_words) - 5), i -> xxhash64(_words[i], _words[i + 1], _words[i + 2], _words[i + 3], _words[i + 4]))")),
    )
    ordered = windows.withColumn("_sorted", F.when(F.size(F.array_distinct("_windows")) < F.size("_windows"), F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    twice = ordered.withColumn("_at", F.expr("sort_array(transform(filter(_sorted, (x, k) -> (k > 0 AND _sorted[greatest(k - 1, 0)].h = x.h) OR (k < size(_sorted) - 1 AND _sorted[least(k + 1, size(_sorted) - 1)].h = x.h)), x -> x.i))"))
    n_repeat = F.expr("aggregate(transform(_at, (x, k) -> if(k = 0, 5L, cast(least(5, x - _at[greatest(k - 1, 0)]) AS BIGINT))), 0L, (a, b) -> a + b)")
    without = lambda signs: F.length(F.translate("_content", signs, ""))
    each = F.transform(F.array_distinct(F.transform("_lines", normal)), lambda x: F.struct(F.xxhash64(x).alias("line"), (F.length(x) - F.length(F.replace(x, F.lit(" "))) + 1).alias("words")))
    out = twice.select(
        *split.columns[: len(carried) + 3],
        F.size("_words").cast("long").alias("n_words"),
        without(" \t\n\x0b\x0c\r").cast("long").alias("word_chars"),
        (F.length("_content") - without("#*$%&|<>")).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(n_repeat, F.lit(0)).cast("long").alias("n_repeat_words"),
        each.alias("_each"),
    )
    return out.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))


def removals(table: DataFrame, most_docs: int = MOST_DOCS) -> DataFrame:
    """For each text of a host that loses lines: _host, _text, _lost (words) and _gone (the hashes of the lines); table: of measured()."""
    texts = table.groupBy("_host", "_text").agg(F.min("_id").alias("_id"), F.first("_each").alias("_each"))
    lines = texts.select("_host", "_text", "_id", F.inline("_each"))
    counted = lines.groupBy("_host", "line").agg(F.count(F.lit(1)).alias("_docs"), F.min("_id").alias("_first"))
    frequent = written(counted.where(F.col("_docs") > most_docs).select("_host", "line", "_first"), "frequent")
    lost = lines.join(frequent, ["_host", "line"]).where(F.col("_id") != F.col("_first"))
    return lost.groupBy("_host", "_text").agg(F.sum("words").alias("_lost"), F.collect_set("line").alias("_gone"))


def verdict(table: DataFrame, lost: DataFrame, least_words: int, least_left: float) -> DataFrame:
    """measured() joined to removals(), with n_lost_words (each different line once) and kept."""
    left = F.col("n_words") - F.col("n_lost_words")
    kept = ~F.col("base_failed") & (left >= least_words) & (left >= least_left * F.col("n_words"))
    return table.drop("_each").join(lost, ["_host", "_text"], "left").withColumn("n_lost_words", F.coalesce("_lost", F.lit(0)).cast("long")).withColumn("kept", kept)


def judged(docs: DataFrame, least_words: int = LEAST_WORDS, least_left: float = LEAST_LEFT, most_docs: int = MOST_DOCS, carried: list[str] | None = None) -> DataFrame:
    """docs (or its carried columns) with FIGURES, n_lost_words and kept."""
    new = (*FIGURES, "kept", "n_lost_words")
    own = [c for c in carried or docs.columns if c not in new]
    table = written(measured(docs, F.struct(*[F.col(f"`{c}`") for c in own]).alias("_doc")), "measured")
    return verdict(table, removals(table, most_docs).drop("_gone"), least_words, least_left).select(*[F.col("_doc")[c].alias(c) for c in own], *new)


def filtered(docs: DataFrame, least_words: int = LEAST_WORDS, least_left: float = LEAST_LEFT, most_docs: int = MOST_DOCS) -> DataFrame:
    """The documents that are kept, without the lines that are removed; the columns of docs.

    n_chars, where there is one, follows the text.
    """
    table = written(measured(docs), "measured")
    # What is decided about a text of a host: rejected (null), or without some lines.
    found = verdict(table, removals(table, most_docs), least_words, least_left)
    changed = found.where(~F.col("kept") | F.col("_gone").isNotNull()).groupBy("_host", "_text").agg(F.first(F.when(F.col("kept"), F.col("_gone"))).alias("_gone"), F.lit(True).alias("_found"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), host(docs).alias("_host"), key(docs).alias("_text"))
    kept = rows.join(written(changed, "changed"), ["_host", "_text"], "left").where(F.col("_found").isNull() | F.col("_gone").isNotNull())
    text = F.col("_doc")["text"]
    stays = F.array_join(F.filter(F.split(text, "\n", -1), lambda x: ~F.array_contains("_gone", F.xxhash64(normal(x)))), "\n")
    kept = kept.withColumn("_new", F.when(F.col("_gone").isNotNull(), stays).otherwise(text))
    new = {"text": F.col("_new")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("_gone").isNotNull(), F.length("_new")).otherwise(F.col("_doc")["n_chars"]).cast(docs.schema["n_chars"].dataType)
    return kept.select(*[new.get(c, F.col("_doc")[c]).alias(c) for c in docs.columns])


def query(spark, sf_dir: str) -> DataFrame:
    """op7: one row per row of documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return judged(docs, carried=["doc_id"])


SQL = rf"""
WITH words AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
windows AS (
  SELECT r, i, w[i:i+4] AS g FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM words)),
repeated AS (
  SELECT r, i FROM windows QUALIFY count(*) OVER (PARTITION BY r, g) > 1),
covered AS (
  SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + 5)) AS p FROM repeated) GROUP BY r),
lines AS (
  SELECT r, host, text, doc_id, line, trim(lower(regexp_replace(line, '[\x20\x09-\x0D]+', ' ', 'g')), ' ') AS norm
  FROM (SELECT r, host, text, doc_id, unnest(string_split(text, chr(10))) AS line FROM words)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
dups AS (SELECT r, count(*) - count(DISTINCT line) AS n FROM lines GROUP BY r),
texts AS (SELECT host, text, min(doc_id) AS id FROM words GROUP BY host, text),
each AS (SELECT DISTINCT host, text, norm FROM lines),
counted AS (
  SELECT e.host, e.norm, count(*) AS n, min(t.id) AS first FROM each e JOIN texts t USING (host, text) GROUP BY e.host, e.norm),
frequent AS (
  SELECT host, norm, first FROM counted WHERE n > {MOST_DOCS}),
lost AS (
  SELECT e.host, e.text, sum(length(e.norm) - length(replace(e.norm, ' ', '')) + 1) AS n
  FROM each e JOIN frequent f USING (host, norm) JOIN texts t USING (host, text) WHERE t.id <> f.first GROUP BY e.host, e.text),
found AS (
  SELECT words.doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
         (length(words.text) - length(regexp_replace(words.text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         coalesce(dups.n, 0)::BIGINT AS n_dup_lines, coalesce(covered.n, 0)::BIGINT AS n_repeat_words,
         coalesce(lost.n, 0)::BIGINT AS n_lost_words
  FROM words LEFT JOIN covered USING (r) LEFT JOIN dups USING (r) LEFT JOIN lost ON lost.host = words.host AND lost.text = words.text),
failed AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM found)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND n_words - n_lost_words >= {LEAST_WORDS} AND n_words - n_lost_words >= {LEAST_LEFT} * n_words AS kept, n_lost_words
FROM failed
"""
