"""Language identification by Bayesian evidence fusion.

Four kinds of evidence meet in one posterior:
- the text, as a naive Bayes likelihood over hashed character trigrams; trigrams of one
  text depend on each other, so a text counts as at most STRONGEST of them;
- the declared language (a table's column or a page's lang attribute), right with the
  probability DECLARED;
- the address suffix (such as .fr) and the host, as priors: how the texts of a host
  divide over languages, smoothed towards its suffix and that towards all, from grouped
  sums over the whole table, less what the row itself added to them: no evidence counts twice.

The languages are the labels of all rows, the LABELS most frequent ones where there are more;
the model has a column for each, so their number is a parameter, and a rarer label is an
unknown declaration. The text model is fitted on about SAMPLE labelled rows, chosen by a
hash of their id and text, and on about EACH of every language at least (all of a rarer
one); everything else covers every row. A text whose trigrams are less likely than chance
under each language is of no known language ("und") and is rejected, as is one whose
posterior stays under LEAST.

Nulls: a null text is empty; a text without letters or words has no likelihood, so the other
evidence decides; without any it is und. A null label is left out of the fit, a null or
unknown declaration says nothing, a null host is a host of its own. Of equal posteriors the
language that is first by name wins. An empty table gives
an empty one. Repeated rows each count and each get their row. Texts are read whole, however
long. Columns besides those named play no part.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.functions.values import let
from strata.llm.bpe import slices
from strata.session import written

BITS, SAMPLE, EACH, LABELS = 15, 20_000, 1000, 400
STRONGEST, DECLARED, LEAST, PSEUDO = 60.0, 0.9, 0.5, 20.0
#: Mean log-likelihood below which a text of ENOUGH trigrams fits a language less than chance does.
CHANCE, ENOUGH = -math.log(1 << BITS), 20
LETTERS = re.compile(r"[^\W\d_]+")


def trigrams(text: str | None) -> np.ndarray:
    """Hashed trigrams of a text's letters, its words set apart by blanks."""
    words = LETTERS.findall((text or "").lower())
    if not words:
        return np.zeros(0, np.int64)
    codes = np.frombuffer(f" {' '.join(words)} ".encode("utf-32-le"), np.uint32).astype(np.uint64)
    mixed = (codes[:-2] * np.uint64(0x9E3779B97F4A7C15) + codes[1:-1]) * np.uint64(0xBF58476D1CE4E5B9) + codes[2:]
    return (mixed * np.uint64(0x94D049BB133111EB) >> np.uint64(64 - BITS)).astype(np.int64)


def fitted(docs: DataFrame, label: str = "lang", sample: int = SAMPLE) -> tuple[list[str], np.ndarray]:
    """Languages and the log-likelihood of each trigram (rows) in each (columns)."""
    known = docs.where(F.col(label).isNotNull()).select("doc_id", "text", F.col(label).cast("string").alias("label"))
    sizes = {r["label"]: r["count"] for r in known.groupBy("label").count().orderBy(F.desc("count"), "label").limit(LABELS).collect()}
    langs, n_rows = sorted(sizes), max(1, sum(sizes.values()))
    known = known.where(F.col("label").isin(langs))
    # The hash below which a row is taken, of the languages that need more than the common share.
    share = {x: math.ceil(min(1.0, max(sample / n_rows, EACH / n)) * (1 << 20)) for x, n in sizes.items()}
    common = math.ceil(min(1.0, sample / n_rows) * (1 << 20))
    more = {x: s for x, s in share.items() if s > common}
    below = F.lit(common)
    if more:
        below = F.coalesce(F.try_element_at(F.create_map(*[F.lit(v) for x in more.items() for v in x]), F.col("label")), below)
    known = known.where(F.pmod(F.xxhash64("doc_id", "text", F.lit("fit")), F.lit(1 << 20)) < below)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            at = 0
            for part in slices(batch.column(0)):
                for text, lang in zip(part, batch.column(1).slice(at, len(part)).to_pylist()):
                    sums.setdefault(lang, np.zeros(1 << BITS, np.int64))[:] += np.bincount(trigrams(text), minlength=1 << BITS)
                at += len(part)
        for lang, n in sums.items():
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(some), pa.string()), "i": pa.array(some.astype(np.int32)), "n": pa.array(n[some])})

    rows = known.select("text", "label").mapInArrow(count, "lang string, i int, n long").groupBy("lang", "i").agg(F.sum("n").alias("n"))
    found = rows.toArrow()  # at most 2 ** BITS rows for each language
    n = np.zeros((1 << BITS, len(langs)))
    n[found["i"].to_numpy(), pc.index_in(found["lang"], value_set=pa.array(langs, pa.string())).to_numpy()] = found["n"].to_numpy()
    blank = n.sum(0) == 0  # texts without letters only: just under chance, so that no text fits for that
    n += 0.5
    return langs, np.log(n / (n.sum(0) + blank)).astype(np.float32)


def likelihoods(text: str | Column, model: tuple[list[str], np.ndarray]) -> Column:
    """struct<n, ll>: a text's number of trigrams and its mean log-likelihood in each language.

    The model, at most 2 ** BITS x LABELS numbers of four bytes, is sent once to each executor.
    """
    sent = SparkSession.getActiveSession().sparkContext.broadcast(model[1])

    @F.arrow_udf("struct<n:long,ll:array<double>>")
    def score(column: pa.Array) -> pa.Array:
        table = sent.value
        counts, means = [], []
        for part in slices(column):
            for t in part:
                at = trigrams(t)
                counts.append(len(at))
                means.append(table[at].mean(0, dtype=np.float64) if len(at) else np.zeros(table.shape[1]))
        flat = np.concatenate(means) if means else np.zeros(0)
        rows = pa.ListArray.from_arrays(pa.array(np.arange(len(means) + 1, dtype=np.int32) * table.shape[1]), pa.array(flat))
        return pa.StructArray.from_arrays([pa.array(counts, pa.int64()), rows], ["n", "ll"])

    return score.asNondeterministic()(text)


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, b: a + b)


def softmax(logs: Column) -> Column:
    """Each step is computed once for an array, so it takes time linear in the languages."""
    powers = let(logs, lambda y: let(F.array_max(y), lambda top: F.transform(y, lambda x: F.exp(x - top))))
    return let(powers, lambda p: let(total(p), lambda of: F.transform(p, lambda x: x / of)))


def identified(docs: DataFrame, model: tuple[list[str], np.ndarray]) -> DataFrame:
    """docs (doc_id, text, declared, host, suffix) with lang, posterior and kept instead of the text.

    lang is "und" where nothing is known or the text fits no language.
    """
    langs = model[0]
    if not langs:
        return docs.select("doc_id", "declared", "host", F.lit("und").alias("lang"), F.lit(0.0).alias("posterior"), F.lit(False).alias("kept"))
    name = F.array(*[F.lit(x) for x in langs])
    even = F.lit(math.log((1 - DECLARED) / max(1, len(langs) - 1)))
    keys = docs.select("doc_id", "declared", F.coalesce("host", F.lit("")).alias("host"), F.coalesce("suffix", F.lit("")).alias("suffix"), likelihoods("text", model).alias("t"))
    said = F.when(F.array_contains(name, F.col("declared")), F.transform(name, lambda x: F.when(x == F.col("declared"), math.log(DECLARED)).otherwise(even)))
    weight = F.when(F.col("t.n") > 0, F.least(F.col("t.n"), F.lit(STRONGEST)) * 1.0).otherwise(0.0)
    strange = (F.col("t.n") >= ENOUGH) & (F.array_max("t.ll") < CHANCE)
    seen = keys.select("doc_id", "declared", "host", "suffix", F.col("t.n").alias("n"), F.transform("t.ll", lambda x: x * weight).alias("ll"), said.alias("said"), strange.alias("strange"))
    # What a row adds to its host: how its text and declaration alone divide over the languages; nothing if it says nothing.
    alone = softmax(F.when(F.col("said").isNull(), F.col("ll")).otherwise(F.zip_with("ll", "said", lambda a, b: a + b)))
    adds = ~F.col("strange") & ((F.col("n") > 0) | F.col("said").isNotNull())
    seen = written(seen.withColumn("own", F.when(adds, alone)), "evidence")
    # A row for each host and language, however many languages; sums of a hot host are taken before the shuffle.
    each = seen.where(F.col("own").isNotNull()).select("host", "suffix", F.posexplode("own").alias("k", "p"))
    by_host = written(each.groupBy("host", "suffix", "k").agg(F.sum("p").alias("p")), "hosts")
    whole = np.zeros(len(langs))
    for r in by_host.groupBy("k").agg(F.sum("p").alias("p")).collect():  # a row for each language
        whole[r["k"]] = r["p"]
    shares = F.transform(F.array_sort(F.collect_list(F.struct("k", "p"))), lambda x: x["p"])
    by_suffix = by_host.groupBy("suffix", "k").agg(F.sum("p").alias("p")).groupBy("suffix").agg(shares.alias("of_suffix"))
    hosts = by_host.groupBy("host", "suffix").agg(shares.alias("of_host")).join(by_suffix, "suffix")
    nothing = F.array_repeat(F.lit(0.0), len(langs))

    def smoothed(counts: Column, prior: Column, weight: float | Column) -> Column:
        """Shares of the counts less the row's own, with a prior of so much weight."""
        others = F.zip_with(counts, F.coalesce("own", nothing), lambda a, b: F.greatest(a - b, F.lit(0.0)))
        return let(others, lambda o: let(total(o) + weight, lambda size: F.zip_with(o, prior, lambda a, b: (a + weight * b) / size)))

    fused = seen.join(hosts, ["host", "suffix"], "left")
    fused = fused.withColumn("prior", smoothed(F.array(*[F.lit(float(x)) for x in whole]), F.array_repeat(F.lit(1.0 / len(langs)), len(langs)), float(len(langs))))
    for counts in ("of_suffix", "of_host"):
        fused = fused.withColumn("prior", smoothed(F.coalesce(counts, nothing), F.col("prior"), PSEUDO))
    fused = fused.withColumn("prior", F.transform("prior", lambda x: F.log(x)))
    logs = F.zip_with("ll", "prior", lambda a, b: a + b)
    post = softmax(F.when(F.col("said").isNull(), logs).otherwise(F.zip_with(logs, "said", lambda a, b: a + b)))
    out = fused.withColumn("post", post).withColumn("posterior", F.array_max("post"))
    blank = F.col("strange") | ((F.col("n") == 0) & F.col("said").isNull())
    out = out.withColumn("lang", F.when(blank, "und").otherwise(F.get(name, F.array_position("post", F.col("posterior")).cast("int") - 1)))
    return out.select("doc_id", "declared", "host", "lang", "posterior", (~blank & (F.col("posterior") >= LEAST)).alias("kept"))


def of_documents(docs: DataFrame, more: Column | None = None) -> DataFrame:
    """The evidence of documents: lang as declared, source as host; its suffix is what follows a last dot."""
    suffix = F.when(F.col("source").contains("."), F.substring_index("source", ".", -1))
    return docs.select("doc_id", "text", F.col("lang").alias("declared"), F.col("source").alias("host"), suffix.alias("suffix"))


OPEN, CLOSE = re.compile(r"<(script|style)\b", re.I), {x: re.compile(rf"</{x}\s*>", re.I) for x in ("script", "style")}


def visible(page: str) -> str:
    """A page's text: comments, scripts, styles and tags become blanks, and character references are read.

    What is never closed is a tag like any other. Takes time linear in the page.
    """
    out, here, endless = [], 0, set()

    def after(name: str, start: int) -> int | None:
        """Where what opens at start ends; nothing is looked for again where it was missing."""
        if name not in endless:
            if name == "comment":
                if (end := page.find("-->", start + 4)) >= 0:
                    return end + 3
            elif m := CLOSE[name].search(page, start):
                return m.end()
            endless.add(name)
        return None

    while (at := page.find("<", here)) >= 0:
        out.append(page[here:at])
        end = None
        if m := OPEN.match(page, at):
            end = after(m[1].lower(), m.end())
        elif page.startswith("<!--", at):
            end = after("comment", at)
        if end is None:
            end = page.find(">", at) + 1
        if not end:
            out.append(page[at:])
            here = len(page)
            break
        out.append(" ")
        here = end
    return html.unescape("".join([*out, page[here:]]))


def of_pages(pages: DataFrame) -> DataFrame:
    """The evidence of web pages: the text without markup, the lang attribute, the address's host and suffix."""

    @F.arrow_udf("string")
    def words(column: pa.Array) -> pa.Array:
        return pa.array([visible(t or "") for part in slices(column) for t in part], pa.string())

    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z]+://([^/:?#]+)", 1))
    # The attributes of the first html tag, however many, and then the one that is named.
    tag = F.regexp_extract(F.coalesce("html", F.lit("")), r"(?is)^.*?<html\b([^>]*)", 1)
    declared = F.nullif(F.lower(F.regexp_extract(tag, r"""(?i)\blang\s*=\s*["']?([A-Za-z]{2,3})""", 1)), F.lit(""))
    return pages.select(F.col("page_id").alias("doc_id"), words("html").alias("text"), declared.alias("declared"), F.substring_index(host, ".", -3).alias("host"), F.substring_index(host, ".", -1).alias("suffix"))


def query(spark, sf_dir: str) -> DataFrame:
    """op5 over documents: one row per row."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    return identified(of_documents(docs), fitted(docs)).drop("host")


def page_query(spark, sf_dir: str) -> DataFrame:
    """op5 over pages: one row per row, with the model of documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return identified(of_pages(pages), fitted(docs)).withColumnRenamed("doc_id", "page_id")
