"""Ranked lexical search by pipelined term partitioning.

Documents are cut into blocks of DOCS rows, each with a small inverted index of the words
that some item has. Terms belong to owners by how many documents hold them, the rarest
first. Items are dealt into bundles. A bundle's accumulators, for each item the documents of
a block that have scored so far and their scores, go through the owners one after the other:
at each they meet that owner's postings of their block by cogroup, and each term adds its
integer contribution for the items that have it. At last each block selects its best, and
each item the best of all blocks. No task holds more than a block of documents for a bundle
of items, and a word that every document has is dealt out like any other.

Words are known by 64 bits of their hash; words that no item has are kept back by a bitmap
of bounded size. Documents with equal scores are ranked by id, a null id last, then by row.
Rows with one item_id are one item with the words of all; a null item_id is an item of its
own. Null and empty texts, of items too, have no words and never match. Repeated documents
each have their place. Very long texts are read a window of bytes at a time. Empty tables
give an empty one, and further columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strata.llm.bpe import portions
from strata.llm.sieve import marked, marks
from strata.llm.words import letters_and_digits, words
from strata.session import written

BEST = 50
#: Rows of documents in a block and, about, items in a bundle.
DOCS, ITEMS = 4096, 256
#: The share of documents up to which a term belongs to each owner; the last owns the rest.
OWNERS = (1 / 256, 1 / 16)


def hashed(found: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the different words of an array, and which of them each is."""
    coded = found.dictionary_encode()
    return np.array([xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.to_pylist()], np.uint64).view(np.int64), coded.indices.to_numpy()


def item_terms(items: DataFrame) -> DataFrame:
    """item_id and term: the different words (hashes) of each item."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, part in portions(batch.column(1)):
                for found, text in words(part, letters_and_digits):
                    term, place = hashed(found)
                    yield pa.record_batch([batch.column(0).take(pa.array(at + text)), pa.array(term[place])], ["item_id", "term"])

    return items.select("item_id", "text").mapInArrow(of, "item_id long, term long").distinct()


def stretched(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The bytes of values up to each end, as an Arrow array."""
    at = (np.append(0, ends) * values.itemsize).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(values))])


class Block:
    """Consecutive rows of documents, on their way to a row for the block and one for each of its terms."""

    SCHEMA = "block long, term long, rows int, ids binary, nulls binary, n binary, docs binary, tf binary"

    def __init__(self, number: int):
        self.number, self.rows, self.ids, self.n, self.found = number, 0, [], [], []

    def add(self, ids: pa.Array, texts: pa.Array, known: np.ndarray) -> None:
        n = np.zeros(len(texts), np.int64)
        for found, text in words(texts, letters_and_digits):
            n += np.bincount(text, minlength=len(texts))
            term, place = hashed(found)
            if not len(term):
                continue
            kept = marked(known, term)[place]
            key, times = np.unique(text[kept] * len(term) + place[kept], return_counts=True)
            self.found.append(np.stack([term[key % len(term)], key // len(term) + self.rows, times]))
        self.ids.append(ids)
        self.n.append(n)
        self.rows += len(texts)

    def records(self) -> pa.RecordBatch:
        ids = pa.concat_arrays(self.ids)
        term, doc, tf = np.concatenate([np.zeros((3, 0), np.int64), *self.found], axis=1)
        order = np.lexsort((doc, term))
        term, doc, tf = term[order], doc[order], tf[order]
        if len(term):  # a text of several windows has a term several times
            new = np.append(True, (term[1:] != term[:-1]) | (doc[1:] != doc[:-1]))
            term, doc, tf = term[new], doc[new], np.add.reduceat(tf, np.flatnonzero(new))
        last = np.append(np.flatnonzero(term[1:] != term[:-1]) + 1, len(term)) if len(term) else term
        k = len(last)
        whole = [ids.fill_null(0).to_numpy().tobytes(), ids.is_null().to_numpy(zero_copy_only=False).tobytes(), np.concatenate(self.n).tobytes()]
        first = lambda x, kind: pa.array([x, *[None] * k], kind)
        rest = lambda x: pa.concat_arrays([pa.nulls(1, x.type), x])
        return pa.record_batch(
            [pa.array([self.number] * (k + 1), pa.int64()), rest(pa.array(term[last - 1])), first(self.rows, pa.int32()), *(first(x, pa.binary()) for x in whole), rest(stretched(doc.astype("<u2"), last)), rest(stretched(tf, last))],
            ["block", "term", "rows", "ids", "nulls", "n", "docs", "tf"],
        )


def blocks(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """For each block a row without a term (rows, ids, their nulls, words of each) and a row for each term (docs in the block, tf)."""
    sent = docs.sparkSession.sparkContext.broadcast(marks(terms.select("term").distinct(), "term"))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        block = Block(number)
        for batch in batches:
            for at, part in portions(batch.column(1)):
                for i in range(0, len(part), DOCS):
                    some = part.slice(i, DOCS)
                    if block.rows + len(some) > DOCS:
                        yield block.records()
                        number += 1
                        block = Block(number)
                    block.add(batch.column(0).slice(at + i, len(some)), some, sent.value)
        if block.rows:
            yield block.records()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(index, Block.SCHEMA)


STATE = "block long, bundle int, item long, rows int, ids binary, nulls binary, n binary, items binary, docs binary, scores binary"
STATE_COLUMNS = [c.split()[0] for c in STATE.split(", ")]


class Accumulators:
    """Scores of a bundle's items in a block."""

    def __init__(self, state: pa.Table):
        self.head = state.filter(pc.is_null(state["item"])).combine_chunks()
        (whole,) = self.head.to_pylist()
        self.block, self.ids, self.nulls, self.n, self.items = whole["block"], *(np.frombuffer(whole[c], kind) for c, kind in (("ids", np.int64), ("nulls", bool), ("n", np.int64), ("items", np.int64)))
        self.scores = np.zeros((len(self.items), whole["rows"]), np.int64)
        for x in state.filter(pc.is_valid(state["item"])).to_pylist():
            self.scores[np.searchsorted(self.items, x["item"]), np.frombuffer(x["docs"], "<u2")] = np.frombuffer(x["scores"], np.int64)

    def add(self, postings: pa.Table, n_docs: int, n_words: int) -> None:
        m = 100 - 50 + 50 * self.n * n_docs // n_words
        for x in postings.to_batches():
            for weight, items, docs, tf in zip(*(x.column(c) for c in ("weight", "items", "docs", "tf"))):
                docs, tf = np.frombuffer(docs.as_py(), "<u2"), np.frombuffer(tf.as_py(), np.int64)
                more = weight.as_py() * (1_000_000_000 * tf // (1000 * tf + 20 * m[docs]))
                for item in np.searchsorted(self.items, items.values.to_numpy()).tolist():
                    self.scores[item, docs] += more

    def state(self) -> pa.Table:
        """The block's own row, and what has scored so far."""
        item, doc = np.nonzero(self.scores)
        last = np.append(np.flatnonzero(item[1:] != item[:-1]) + 1, len(item)) if len(item) else item
        k, head = len(last), self.head
        own = {"block": pa.array([self.block] * k, pa.int64()), "bundle": pa.array([head["bundle"][0].as_py()] * k, pa.int32()), "item": pa.array(self.items[item[last - 1]]), "docs": stretched(doc.astype("<u2"), last), "scores": stretched(self.scores[item, doc], last)}
        return pa.concat_tables([head, pa.table([own[c] if c in own else pa.nulls(k, head.schema.field(c).type) for c in head.column_names], schema=head.schema)])

    def selected(self, best: int) -> pa.Table:
        """item, doc_id, row and score of the best documents of each item here."""
        out = []
        for item, scores in zip(self.items.tolist(), self.scores):
            some = np.flatnonzero(scores)
            if len(some) > best:
                some = some[scores[some] >= np.partition(scores[some], len(some) - best)[len(some) - best]]
            some = some[np.lexsort((some, self.ids[some], self.nulls[some], -scores[some]))[:best]]
            out.append((np.full(len(some), item), some, scores[some]))
        item, doc, score = (np.concatenate(x) for x in zip(*out)) if out else [np.zeros(0, np.int64)] * 3
        return pa.table({"item": item, "doc_id": pa.array(self.ids[doc], mask=self.nulls[doc]), "row": self.block * DOCS + doc, "score": score})


def ranked(docs: DataFrame, items: DataFrame, best: int = BEST, owners: tuple[float, ...] = OWNERS, bundled: int = ITEMS) -> DataFrame:
    """item_id, rank (from 1), doc_id and score of the best documents (doc_id, text) of each item (item_id, text)."""
    pairs = written(item_terms(items), "item_terms")
    table = written(blocks(docs, pairs), "blocks")
    heads, postings = table.where("term IS NULL").select("block", "rows", "ids", "nulls", "n"), table.where("term IS NOT NULL").select("block", "term", "docs", "tf")
    sums = heads.mapInArrow(totals, "docs long, words long").agg(F.sum("docs"), F.sum("words")).first()
    n_docs, n_words = sums[0] or 0, max(1, sums[1] or 0)

    count = pairs.select("item_id").distinct().count()
    many = max(1, -(-count // bundled))
    dealt = F.pmod(F.xxhash64("item_id"), F.lit(many)).cast("int")
    numbered = written(pairs.select("item_id").distinct().select("item_id", F.monotonically_increasing_id().alias("item"), dealt.alias("bundle")), "items")
    bundles = numbered.groupBy("bundle").agg(F.sort_array(F.collect_list("item")).alias("all"))
    owned = numbered.join(pairs, numbered["item_id"].eqNullSafe(pairs["item_id"])).groupBy("bundle", "term").agg(F.collect_list("item").alias("items"))
    held = postings.groupBy("term").agg(F.sum(F.length("docs") / 2).cast("long").alias("df"))
    owner = F.lit(0)
    for share in owners:
        owner = owner + (F.col("df") > share * n_docs).cast("int")
    weight = F.floor(1000 * F.log((2 * F.lit(n_docs) + 2) / (2 * F.col("df") + 1))).cast("long")
    terms = written(owned.join(held, "term").select("bundle", "term", "items", owner.alias("owner"), weight.alias("weight")), "terms")
    routed = written(postings.join(terms, "term").drop("term"), "postings")

    @F.arrow_udf("binary")
    def numbers(lists: pa.Array) -> pa.Array:
        return pa.array([x.values.to_numpy().tobytes() for x in lists], pa.binary())

    nothing = [F.lit(None).cast(kind).alias(c) for c, kind in (("docs", "binary"), ("scores", "binary"))]
    each = bundles.select("bundle", numbers("all").alias("items"))
    state = heads.withColumn("bundle", F.explode(F.sequence(F.lit(0), F.lit(many - 1)))).join(each, "bundle")
    state = state.withColumn("item", F.lit(None).cast("long")).select(*[c for c in STATE_COLUMNS if c not in ("docs", "scores")], *nothing)

    def passed(state: pa.Table, own: pa.Table) -> pa.Table:
        scores = Accumulators(state)
        scores.add(own, n_docs, n_words)
        return scores.state()

    def finished(state: pa.Table, own: pa.Table) -> pa.Table:
        scores = Accumulators(state)
        scores.add(own, n_docs, n_words)
        return scores.selected(best)

    for k in range(len(owners) + 1):
        own = routed.where(F.col("owner") == k).select("block", "bundle", "weight", "items", "docs", "tf")
        both = state.groupBy("block", "bundle").cogroup(own.groupBy("block", "bundle"))
        state = both.applyInArrow(passed, STATE) if k < len(owners) else both.applyInArrow(finished, "item long, doc_id long, row long, score long")
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "row")
    top = state.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best)
    return top.join(numbered.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")


def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents with words, and all words, of the blocks of a task."""
    n_docs = n_words = 0
    for batch in batches:
        for n in batch.column("n"):
            n = np.frombuffer(n.as_buffer(), np.int64)
            n_docs, n_words = n_docs + int((n > 0).sum()), n_words + int(n.sum())
    yield pa.record_batch([pa.array([n_docs]), pa.array([n_words])], ["docs", "words"])


def query(spark, sf_dir: str) -> DataFrame:
    """op13: up to BEST rows per item of benchmark; the limit is the feature."""
    return ranked(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


SQL = r"""
WITH tokens AS (
  SELECT r, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t
  FROM (SELECT row_number() OVER () AS r, doc_id, text FROM documents)),
sizes AS (SELECT r, any_value(doc_id) AS doc_id, count(*) AS n FROM tokens GROUP BY r),
whole AS (SELECT count(*) AS docs, sum(n)::BIGINT AS words FROM sizes),
counts AS (SELECT r, t, count(*) AS tf FROM tokens GROUP BY r, t),
held AS (SELECT t, count(*) AS df FROM counts GROUP BY t),
asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t
  FROM benchmark),
weights AS (SELECT t, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w FROM held, whole),
lengths AS (SELECT r, doc_id, 100 - 50 + (50 * n * docs) // words AS m FROM sizes, whole),
scores AS (
  SELECT item_id, r, any_value(doc_id) AS doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score
  FROM asked JOIN weights USING (t) JOIN counts USING (t) JOIN lengths USING (r) GROUP BY item_id, r)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scores WHERE score > 0)
WHERE rank <= 50
"""
