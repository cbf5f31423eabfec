r"""Chat formatting over reply trees.

Messages know their parent. Iterative self-joins double the distance that each message can
look up, then halve what is left of each leaf's way to the root, so a tree of depth d takes
about 2 log2(d) joins and no row ever holds a whole path. A leaf's path is ranked by the
mean score of its messages, and each chosen path becomes one conversation.

The template writes <|turn|>ROLE, a line break, the text, <|end|> and a line break. Control
strings inside roles and texts get a backslash after their first character (one more, if
they have some already); a role's backslashes and line breaks are written as \\ and \n.
Reading removes both again.

Nulls: a null text or role is empty, a null score 0, a null tree or parent id is an id of
its own or a root. A message whose parent is missing is a root. Messages on a ring of
parents, or below one, have no root and so no path. Repeated rows of a conversation are
turns each. Texts stay whole, however long. Columns besides those named play no part. An
empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strata.session import written

# The template's own control strings and those of common formats.
TURN, END = "<|turn|>", "<|end|>"
CONTROL = r"(\|turn\|>|\|end\|>|/?s>|/?INST\])"

READ = re.compile(r"<\|turn\|>(.*?)\n(.*?)<\|end\|>\n", re.S)
PLAIN = re.compile(r"([<\[])\\(\\*)" + CONTROL)
ROLE = re.compile(r"\\(.)", re.S)


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])(\\*)" + CONTROL, r"$1\\$2$3")


def role_escaped(role: Column) -> Column:
    return escaped(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def read_back(formatted: str) -> list[tuple[str, str, int, int]]:
    """(role, text, start, end) of each turn; start and end are of the escaped text in the output."""
    role = lambda s: ROLE.sub(lambda m: "\n" if m[1] == "n" else m[1], PLAIN.sub(r"\1\2\3", s))
    return [(role(m[1]), PLAIN.sub(r"\1\2\3", m[2]), m.start(2), m.end(2)) for m in READ.finditer(formatted)]


def paths(nodes: DataFrame, keep: int | None = None) -> DataFrame:
    """tree, leaf, score, depth (from the root, 0) and node of every message on a chosen path.

    nodes: tree, node (unique within its tree), parent and score. keep: so many leaves of
    each tree, by score, then by node; None keeps all.
    """
    key = ["tree", "node"]
    up = nodes.select("tree", F.col("node"), F.col("parent").alias("up"))
    known = nodes.select("tree", F.col("node").alias("up"))
    # levels[k] has the ancestor 2^k steps up of each message that has one; the others' depth is settled by then.
    levels = [written(up.join(known, ["tree", "up"]).select("tree", "node", "up"), "up")]
    settled = written(nodes.select(*key).join(levels[0], key, "left_anti").withColumn("depth", F.lit(0).cast("long")), "depth")
    most = nodes.count()
    while (1 << len(levels) - 1) <= most and levels[-1].limit(1).count():
        step = 1 << len(levels) - 1
        above = settled.select("tree", F.col("node").alias("up"), "depth")
        new = written(levels[-1].join(above, ["tree", "up"]).select("tree", "node", (F.col("depth") + step).alias("depth")), "depth")
        further = levels[-1].select("tree", F.col("node").alias("up"), F.col("up").alias("next"))
        levels.append(written(levels[-1].join(further, ["tree", "up"]).select("tree", "node", F.col("next").alias("up")), "up"))
        settled = settled.unionByName(new)
    parents = levels[0].select("tree", F.col("up").alias("node")).distinct()
    leaves = written(settled.join(parents, key, "left_anti").select("tree", F.col("node").alias("leaf"), "node", "depth", (F.col("depth") + 1).alias("n")), "leaves")
    # Each way is split at the largest step below its length, until each part is one message.
    parts = None
    for k in range(len(levels) - 1, -1, -1):
        fresh = leaves.where((F.col("n") > 1 << k) & (F.lit(parts is None) | (F.col("n") <= 2 << k)))
        both = (fresh if parts is None else parts.unionByName(fresh)).join(levels[k], key, "left")
        whole = F.struct("node", "depth", "n")
        near = F.struct("node", "depth", F.lit(1 << k).cast("long").alias("n"))
        far = F.struct(F.col("up").alias("node"), (F.col("depth") - (1 << k)).alias("depth"), (F.col("n") - (1 << k)).alias("n"))
        parts = both.select("tree", "leaf", F.inline(F.when(F.col("n") > 1 << k, F.array(near, far)).otherwise(F.array(whole))))
    parts = parts.unionByName(leaves.where("n = 1").select("tree", "leaf", "node", "depth", "n"))
    found = parts.join(nodes.select(*key, F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("own")), key)
    if keep is None:
        return found.select("tree", "leaf", F.col("own").alias("score"), "depth", "node")
    found = written(found, "paths")
    ranked = found.groupBy("tree", "leaf").agg(F.avg("own").alias("score"))
    best = ranked.withColumn("r", F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("score"), "leaf"))).where(F.col("r") <= keep).drop("r")
    return found.drop("own").join(best, ["tree", "leaf"]).select("tree", "leaf", "score", "depth", "node")


def formatted(nodes: DataFrame, keep: int | None = None) -> DataFrame:
    """tree, leaf, score, formatted and loss (array<struct<start,end>> of assistant texts in it).

    nodes: tree, node, parent, score, role and text. score is the path's mean.
    """
    said = nodes.select("tree", "node", role_escaped(F.coalesce("role", F.lit(""))).alias("role"), escaped(F.coalesce("text", F.lit(""))).alias("text"), (F.coalesce("role", F.lit("")) == "assistant").alias("learnt"))
    told = paths(nodes, keep).join(said, ["tree", "node"])
    turns = told.groupBy("tree", "leaf").agg(F.avg("score").alias("score"), F.array_sort(F.collect_list(F.struct("depth", "role", "text", "learnt"))).alias("turns"))
    before = lambda t: len(TURN) + F.length(t["role"]) + 1
    whole = lambda t: before(t) + F.length(t["text"]) + len(END) + 1
    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))
    walk = F.aggregate("turns", empty, lambda a, t: F.struct((a["at"] + whole(t)).alias("at"), F.when(t["learnt"], F.array_append(a["spans"], F.struct((a["at"] + before(t)).alias("start"), (a["at"] + before(t) + F.length(t["text"])).alias("end")))).otherwise(a["spans"]).alias("spans")), lambda a: a["spans"])
    text = F.array_join(F.transform("turns", lambda t: F.concat(F.lit(TURN), t["role"], F.lit("\n"), t["text"], F.lit(END + "\n"))), "")
    return turns.select("tree", "leaf", "score", text.alias("formatted"), walk.alias("loss"))


def threads(conversations: DataFrame) -> DataFrame:
    """Conversations (conv_id, turn, role, text) as trees: each row replies to the one before it.

    Rows are in the order of turn, role and text, nulls first; so rows with one turn follow
    each other.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    numbered = conversations.select("conv_id", "role", "text", F.row_number().over(order).cast("long").alias("node"))
    return numbered.select(F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("tree"), "conv_id", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), F.lit(0.0).alias("score"), "role", "text")


def forest(conversations: DataFrame) -> DataFrame:
    """Conversations whose first messages have one role and begin with the same OPENING characters as one reply tree.

    Its root is a turn of the role topic that says these characters; each conversation is a
    branch of its own below it, whole. A message's score is the length of its text. tree holds
    the smallest conversation (conv_id as a string, null: empty), node a conversation and the
    message's number; the root is number 0 of the smallest one.
    """
    order = Window.partitionBy("conv").orderBy("turn", "role", "text")
    rows = conversations.select(F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("conv"), "turn", "role", "text")
    rows = written(rows.select("conv", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.row_number().over(order).alias("n")), "said")
    first = rows.where("n = 1").select("conv", "role", F.substring("text", 1, OPENING).alias("opening"))
    roots = written(first.groupBy("role", "opening").agg(F.min("conv").alias("tree")), "roots")
    of = first.join(roots, ["role", "opening"]).select("conv", "tree")
    node = lambda conv, n: F.struct(F.col(conv).alias("conv"), n.alias("n"))
    score = F.length("text").cast("double").alias("score")
    top = roots.select("tree", node("tree", F.lit(0)).alias("node"), F.lit(None).cast("struct<conv:string,n:int>").alias("parent"), F.lit("topic").alias("role"), F.col("opening").alias("text"))
    above = F.when(F.col("n") > 1, node("conv", F.col("n") - 1)).otherwise(node("tree", F.lit(0)))
    said = rows.join(of, "conv").select("tree", node("conv", F.col("n")).alias("node"), above.alias("parent"), "role", "text")
    return top.unionByName(said).select("tree", "node", "parent", score, "role", "text")


DIGEST = pa.struct([("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string())])


def digests(formatted: str, loss: str) -> Column:
    """Of what is read back from the output."""

    def of(text: str, spans: list[dict]) -> dict:
        turns, said = read_back(text), [PLAIN.sub(r"\1\2\3", text[s["start"] : s["end"]]) for s in spans]
        sha = lambda parts: hashlib.sha256("".join(parts).encode()).hexdigest()
        return {"n_turns": len(turns), "turns_sha256": sha(f"{r}\n{t}\n" for r, t, *_ in turns), "loss_chars": sum(map(len, said)), "loss_sha256": sha(said)}

    @F.arrow_udf("struct<n_turns:long,turns_sha256:string,loss_chars:long,loss_sha256:string>")
    def read(texts: pa.Array, spans: pa.Array) -> pa.Array:
        return pa.array([of(t.as_py(), s.as_py()) for t, s in zip(texts, spans)], DIGEST)

    return read.asNondeterministic()(formatted, loss)  # so that Spark runs it once


def query(spark, sf_dir: str) -> DataFrame:
    """op4: one row per conversation, and one for conversation -7."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    nodes = written(threads(rows.unionByName(more)), "nodes")
    out = formatted(nodes).withColumn("d", digests("formatted", "loss"))
    name = F.when(F.col("tree") != "", F.col("tree").cast("long"))
    return out.select(name.alias("conv_id"), "d.n_turns", "d.turns_sha256", "d.loss_chars", "d.loss_sha256", F.length("formatted").cast("long").alias("formatted_chars"))


#: Branches that are kept of each tree, and the characters that a tree's first messages share.
BRANCHES, OPENING = 2, 2


def tree_query(spark, sf_dir: str) -> DataFrame:
    """op4 over trees: the best branches of each tree, one row for each; the limit is the feature."""
    nodes = written(forest(spark.read.parquet(f"{sf_dir}/conversations.parquet")), "nodes")
    out = formatted(nodes, BRANCHES)
    learnt = F.aggregate("loss", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    return out.select("tree", F.col("leaf.conv").alias("conv"), (F.col("leaf.n") + 1).alias("n_turns"), F.round("score", 6).alias("score"), F.sha2("formatted", 256).alias("formatted_sha256"), learnt.alias("loss_chars"))


TREE_SQL = rf"""
WITH RECURSIVE said AS (
  SELECT coalesce(conv_id::VARCHAR, '') AS conv, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS n
  FROM conversations),
first AS (SELECT conv, role, left(text, {OPENING}) AS opening FROM said WHERE n = 1),
trees AS (SELECT conv, opening, min(conv) OVER (PARTITION BY role, opening) AS tree FROM first),
coded AS (
  SELECT *, regexp_replace(replace(replace(role, '\', '\\'), chr(10), '\n'), '([<\[])(\\*)(\|turn\|>|\|end\|>|/?s>|/?INST\])', '\1\\\2\3', 'g') AS r,
         regexp_replace(text, '([<\[])(\\*)(\|turn\|>|\|end\|>|/?s>|/?INST\])', '\1\\\2\3', 'g') AS t
  FROM (SELECT conv, role, text, n FROM said UNION ALL SELECT conv, 'topic', opening, 0 FROM trees)),
ways AS (
  SELECT tree, c.conv, n, length(text)::DOUBLE AS total, '<|turn|>' || r || chr(10) || t || '<|end|>' || chr(10) AS whole, 0 AS learnt
  FROM coded c JOIN trees USING (conv) WHERE n = 0
  UNION ALL
  SELECT w.tree, w.conv, c.n, w.total + length(c.text), w.whole || '<|turn|>' || c.r || chr(10) || c.t || '<|end|>' || chr(10), w.learnt + CASE WHEN c.role = 'assistant' THEN length(c.t) ELSE 0 END
  FROM ways w JOIN coded c ON c.conv = w.conv AND c.n = w.n + 1),
leaves AS (SELECT *, max(n) OVER (PARTITION BY conv) AS last FROM ways),
ranked AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY total / (n + 1) DESC, conv) AS rank FROM leaves WHERE n = last)
SELECT tree, conv, (n + 1)::INTEGER AS n_turns, round(total / (n + 1), 6) AS score, sha256(whole) AS formatted_sha256, learnt::BIGINT AS loss_chars FROM ranked WHERE rank <= {BRANCHES}
"""

SQL = r"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS n
  FROM (SELECT conv_id, turn, role, text FROM conversations
        UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]')),
coded AS (
  SELECT *, regexp_replace(replace(replace(role, '\', '\\'), chr(10), '\n'), '([<\[])(\\*)(\|turn\|>|\|end\|>|/?s>|/?INST\])', '\1\\\2\3', 'g') AS r,
         regexp_replace(text, '([<\[])(\\*)(\|turn\|>|\|end\|>|/?s>|/?INST\])', '\1\\\2\3', 'g') AS t
  FROM said)
SELECT conv_id::BIGINT AS conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(length(r) + length(t) + 17)::BIGINT AS formatted_chars
FROM coded GROUP BY conv_id
"""
