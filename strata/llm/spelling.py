"""Spelling variants: words one edit apart, found by reduced-alphabet generation.

The letters of a word are hashed to SYMBOLS symbols. Two words one edit apart have reduced
words that are equal or one edit apart, so each word generates the one-edit neighbourhood
of its reduced word, which is joined to the reduced vocabulary; what meets is verified on
the original strings. A pair is generated from one side only: deletions from the longer
word, replacements towards the greater symbol, equal reduced words from the smaller string.
Neighbours that are surely no reduced word never move.

A reduced word that more than MOST words share would make too many candidates. The words
behind such are left out of that join; instead they generate the rest of their own
neighbourhood letter by letter, over all the letters that words have, which is joined to
the vocabulary itself. So the work grows with the vocabulary, however alike words are.

Nulls: a null text has no words; a null id is written as nothing before the colon. Texts
are read whole, a window of bytes at a time, so a very long one takes no more memory than
its batch. Repeated rows count again. Ties of counts go to the smaller word. An empty table
gives an empty one. Columns besides doc_id and text play no part.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.bpe import portions, text_buffers
from strata.llm.neardup import scattered
from strata.llm.sieve import passing
from strata.llm.words import letters, words
from strata.session import removed, written

#: One occurrence in so many loses a letter; the shortest word, its fewest occurrences, and by how much a form is more frequent.
ONE_IN, LENGTH, OCCURRENCES, TIMES = 199, 6, 5, 5
#: Symbols of the reduced alphabet, and the most words of one reduced word that are met in it.
SYMBOLS, MOST = 8, 64
#: Prefixes' checksums are carried on for runs of up to so many bytes.
CARRIED = 64
#: What a word's letters can be: a-z and U+00C0 to U+00FF.
ALPHABET = np.array([*range(97, 123), *range(0xC0, 0x100)], np.uint64)
SPREAD = np.uint64(0x9E3779B97F4A7C15)


def zero_steps() -> np.ndarray:
    """What a zero byte does to a CRC-32, by the lowest byte."""
    out = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        out = np.where(out & 1, out >> 1 ^ np.uint32(0xEDB88320), out >> 1)
    return out


ZERO = zero_steps()


def checksums(ids: list, runs: list[bytes], text: np.ndarray, run: np.ndarray) -> np.ndarray:
    """CRC-32 of "id:run" for each occurrence (text, run): a prefix's, moved on by the run's length, and the run's own."""
    before = [f"{'' if i is None else i}:".encode() for i in ids]
    moved = np.empty((CARRIED + 1, len(ids)), np.uint32)
    moved[0] = [zlib.crc32(b) for b in before]
    for k in range(CARRIED):
        moved[k + 1] = moved[k] >> 8 ^ ZERO[moved[k] & 0xFF]
    size = np.array([len(r) for r in runs])
    out = moved[np.minimum(size, CARRIED)[run], text] ^ np.array([zlib.crc32(r) for r in runs], np.uint32)[run]
    for k in np.flatnonzero(size[run] > CARRIED).tolist():
        out[k] = zlib.crc32(runs[run[k]], zlib.crc32(before[text[k]]))
    return out


def counted(docs: DataFrame, length: int = LENGTH, least: int = OCCURRENCES) -> DataFrame:
    """word and n: words of at least so many code points and occurrences."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, part in portions(batch.column(1), 4096):
                ids = batch.column(0).slice(at, len(part)).to_pylist()
                for found, text in words(part, letters):
                    coded = found.dictionary_encode()
                    runs, run = coded.dictionary.to_pylist(), coded.indices.to_numpy()
                    if not runs:
                        continue
                    h = checksums(ids, runs, text, run)
                    hit = np.flatnonzero(h % ONE_IN == 0)
                    n = np.bincount(run, minlength=len(runs)) - np.bincount(run[hit], minlength=len(runs))
                    changed = Counter()
                    for k in hit.tolist():
                        whole = runs[run[k]].decode()
                        gone = int(h[k]) % len(whole)
                        changed[whole[:gone] + whole[gone + 1 :]] += 1
                    same = coded.dictionary.cast(pa.large_string()).cast(pa.string())
                    whole = pa.concat_arrays([same, pa.array(list(changed), pa.string())])
                    n = np.append(n, np.fromiter(changed.values(), np.int64, len(changed)))
                    kept = pc.and_(pc.greater_equal(pc.utf8_length(whole), length), pa.array(n > 0))
                    yield pa.record_batch([whole, pa.array(n, pa.int64())], ["word", "n"]).filter(kept)

    return docs.select("doc_id", "text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def code_points(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The code points of ASCII and Latin-1 words, one word's after the other's, and where each begins, then where the last ends."""
    data, at = text_buffers(column)
    lead = (data & 0xC0) != 0x80
    code = data.astype(np.uint64)
    two = np.flatnonzero(data == 0xC3)
    code[two] = code[two + 1] | 0x40 | 0x80
    return code[lead], np.append(0, np.cumsum(lead))[at]


def symbols(code: np.ndarray, many: int) -> np.ndarray:
    """Letters as symbols from 1; many: of how many (0: letters stay what they are)."""
    return (code * SPREAD >> np.uint64(40)) % np.uint64(many) + np.uint64(1) if many else code


def keys_of(s: np.ndarray) -> np.ndarray:
    """Keys of rows of symbols; what is equal has one key."""
    return scattered((s * powers(s.shape[1])).sum(1, dtype=np.uint64))


def powers(n: int) -> np.ndarray:
    return np.cumprod(np.append(np.uint64(1), np.full(max(0, n - 1), np.uint64(0xD6E8FEB86659FD93))), dtype=np.uint64)[:n]


def neighbourhood(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and keys: of rows of symbols, of their deletions, and of replacements by a greater symbol."""
    m, n = s.shape
    p = powers(n)
    terms = s * p
    whole = terms.sum(1, dtype=np.uint64)
    rows, keys = [np.arange(m)], [whole]
    before = np.zeros(m, np.uint64)
    after = (s[:, 1:] * p[: n - 1]).sum(1, dtype=np.uint64)  # what follows, one place earlier
    for i in range(n):
        new = np.flatnonzero(s[:, i] != s[:, i - 1]) if i else np.arange(m)  # a repeated symbol's deletion gives the same
        rows.append(new)
        keys.append((before + after)[new])
        before = before + terms[:, i]
        if i < n - 1:
            after = after - s[:, i + 1] * p[i]
        for x in range(2, SYMBOLS + 1):
            less = np.flatnonzero(s[:, i] < x)
            rows.append(less)
            keys.append(whole[less] + (np.uint64(x) - s[less, i]) * p[i])
    return np.concatenate(rows), scattered(np.concatenate(keys))


def rest_by_letter(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and keys of what generates a row's reduced word: insertions, and replacements by a letter of the same or a smaller symbol."""
    m, n = code.shape
    p = powers(n + 1)
    reduced, of = symbols(code, SYMBOLS), symbols(ALPHABET, SYMBOLS)
    whole = (code * p[:n]).sum(1, dtype=np.uint64)
    rows, keys = [], []
    before, after = np.zeros(m, np.uint64), (code * p[1:]).sum(1, dtype=np.uint64)
    for i in range(n + 1):
        for letter, symbol in zip(ALPHABET, of):
            new = np.flatnonzero(code[:, i - 1] != letter) if i else np.arange(m)
            rows.append(new)
            keys.append((before + after)[new] + letter * p[i])
            if i < n:
                other = np.flatnonzero((code[:, i] != letter) & (reduced[:, i] >= symbol))
                rows.append(other)
                keys.append(whole[other] + (letter - code[other, i]) * p[i])
        if i < n:
            before, after = before + code[:, i] * p[i], after - code[:, i] * p[i + 1]
    return np.concatenate(rows), scattered(np.concatenate(keys))


def by_length(column: pa.Array, rows: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and code points (a row each) of the words of one length, so many at a time."""
    code, at = code_points(column)
    size = np.diff(at)
    for n in np.unique(size).tolist():
        some = np.flatnonzero(size == n)
        step = max(1, rows * LENGTH // n)
        for i in range(0, len(some), step):
            part = some[i : i + step]
            yield part, code[at[part][:, None] + np.arange(n)]


def keyed(vocabulary: DataFrame, many: int) -> DataFrame:
    """word, n and key: of the reduced word, or of the word itself (many = 0)."""

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros(batch.num_rows, np.uint64)
            for at, code in by_length(batch.column(0), 4096):
                out[at] = keys_of(symbols(code, many))
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(out.view(np.int64))], ["word", "n", "key"])

    return vocabulary.select("word", "n").mapInArrow(key, "word string, n long, key long")


def generated(vocabulary: DataFrame, near, rows: int) -> DataFrame:
    """word, n and key: a row for each neighbour that near() gives of a word."""

    def generate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, code in by_length(batch.column(0), rows):
                row, keys = near(code)
                place = pa.array(at[row])
                yield pa.record_batch([batch.column(0).take(place), batch.column(1).take(place), pa.array(keys.view(np.int64))], ["word", "n", "key"])

    return vocabulary.select("word", "n").mapInArrow(generate, "word string, n long, key long")


def near_pairs(vocabulary: DataFrame, most: int = MOST) -> DataFrame:
    """a, n_a, b and n_b: each pair of words that differ by one inserted, deleted or replaced code point, once; vocabulary: a table."""

    def met(rows: DataFrame, others: DataFrame) -> DataFrame:
        keys = others.select("key").distinct()
        may = passing(keys, "key", others.count())
        b = others.select("key", F.col("word").alias("b"), F.col("n").alias("n_b"))
        both = rows.where(may("key")).select("key", F.col("word").alias("a"), F.col("n").alias("n_a")).join(b, "key")
        return both.where(F.levenshtein("a", "b", 1) == 1).drop("key")

    reduced = written(keyed(vocabulary, SYMBOLS), "reduced")
    crowded = written(reduced.groupBy("key").count().where(F.col("count") > most).select("key"), "crowded")
    few = written(reduced.join(crowded, "key", "left_anti"), "few")
    many = written(reduced.join(crowded, "key", "left_semi"), "many")
    ordered = (F.length("a") != F.length("b")) | ~same_reduced("a", "b") | (F.col("a") < F.col("b"))
    first = met(generated(vocabulary, lambda code: neighbourhood(symbols(code, SYMBOLS)), 1024), few)
    # b is a word of a crowded reduced word here, and a the one that would have generated it.
    whole = keyed(vocabulary, 0)
    second = met(generated(many, rest_by_letter, 64), written(whole, "whole")).select(F.col("b").alias("a"), F.col("n_b").alias("n_a"), F.col("a").alias("b"), F.col("n_a").alias("n_b"))
    return first.unionByName(second).where(ordered)


def same_reduced(a: str, b: str):
    """Whether two words have one reduced word."""

    @F.arrow_udf("boolean")
    def same(x: pa.Array, y: pa.Array) -> pa.Array:
        out = np.zeros((2, len(x)), np.uint64)
        for row, column in zip(out, (x, y)):
            for at, code in by_length(column, 4096):
                row[at] = keys_of(symbols(code, SYMBOLS))
        return pa.array(out[0] == out[1])

    return same(a, b)


def variants(vocabulary: DataFrame, times: int = TIMES, most: int = MOST) -> DataFrame:
    """word, form, root, n, n_near and form_n of each word of a table of words and counts (n).

    form: the near word of largest n, if that is at least `times` the word's own. Forms lead
    to more and more frequent words, so they end at a root; each round doubles how far they lead.
    """
    pairs = written(near_pairs(vocabulary, most), "pairs")
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("other"), F.col("n_b").alias("n")).unionByName(pairs.select(F.col("b").alias("word"), F.col("a").alias("other"), F.col("n_a").alias("n")))
    best = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("n")).alias("less"), "other")).alias("best"))
    enough = -F.col("best.less") >= times * F.col("n")
    told = vocabulary.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(enough, F.col("best.other")).alias("form"), F.when(enough, -F.col("best.less")).alias("form_n"))
    told = written(told, "forms")
    removed(pairs)
    leads = written(told.where(F.col("form").isNotNull()).select("word", F.col("form").alias("to")), "leads")
    while True:
        further = leads.select(F.col("word").alias("to"), F.col("to").alias("next"))
        longer = written(leads.join(further, "to", "left").select("word", F.coalesce("next", "to").alias("to"), F.col("next").isNotNull().alias("moved")), "leads")
        removed(leads)
        leads = longer
        if not leads.where("moved").limit(1).count():
            break
    return told.join(leads.select("word", "to"), "word", "left").select("word", "form", F.coalesce("to", "word").alias("root"), "n", "n_near", "form_n")


def query(spark, sf_dir: str) -> DataFrame:
    """op11: one row per word of documents."""
    return variants(written(counted(spark.read.parquet(f"{sf_dir}/documents.parquet")), "vocabulary"))
