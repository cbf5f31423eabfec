"""The operators over whole tables: against SQL, brute force, and a fixture of odd rows."""

import hashlib
import html
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from compare import assert_same, connected
from plain import plain_pii, plain_secrets
from strata.llm import ann, chat, langid, neardup, pack, pii, quality, registry, secrets, shard, sieve

FOLDER = "/root/testdata/sf0.001"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, _row long, kept string, length int"


@pytest.fixture(scope="module")
def con():
    return connected(FOLDER)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_against_sql(spark, con, name):
    assert_same(registry.QUERIES[name](spark, FOLDER), con, registry.ORACLES[name])


def odd_rows():
    base = "The quick brown fox jumps over the lazy dog near the old river bank while seven small birds sing in tall green trees at dawn"
    long = " ".join(f"w{k % 977}x{k}" for k in range(30_000))
    texts = [None, "", " \n\t", "one", base, base, base + " today", long, long, "mail a@b.co and +1 555 010 9999", "x " * 500, "Ünïcode ß ΣΑΣ 日本", "two\nlines\ntwo\nlines", "colours " * 30 + "colour " * 6]
    rows = [(k, t, "en" if k % 3 else None, "s" if k % 4 else None, len(t or ""), 1, "x", 2) for k, t in enumerate(texts)]
    return [*rows, rows[4], rows[4], (None, "a text without an id", "en", "s", 20, 1, "x", 2), (None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("odd"))
    spark.createDataFrame(odd_rows(), COLUMNS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, 2, "user", None), (1, 1, None, "hi <|end|> </s>"), (1, 1, None, "hi <|end|> </s>"), (None, None, "assistant", "x"), (2, 0, "a\nb\\", "")], "conv_id long, turn long, role string, text string").write.parquet(f"{path}/conversations.parquet")
    nan = float("nan")
    vectors = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [nan, 1.0]), (6, [None, 1.0]), (7, [1.0]), (50, [0.0, 1.0]), (0, [1.0, 0.0]), (None, [1.0, 1.0]), (100, [1.0, 1.0])]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>").write.parquet(f"{path}/embeddings.parquet")
    spark.createDataFrame([(1, "http://a.fr/x", "<html lang='fr'><p>le chat</p>"), (2, None, None)], "page_id long, url string, html string").write.parquet(f"{path}/pages.parquet")
    spark.createDataFrame([(1, "the Quick brown fox"), (2, None), (None, "birds"), (3, "")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


@pytest.fixture(scope="module")
def empty(spark, odd, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("empty"))
    for t in ("documents", "conversations", "embeddings", "pages", "benchmark"):
        spark.read.parquet(f"{odd}/{t}.parquet").where("false").write.parquet(f"{path}/{t}.parquet")
    return path


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_empty_and_odd_tables(spark, odd, empty, name):
    none = registry.QUERIES[name](spark, empty)
    assert none.count() == (1 if name == "op4_chat_format" else 0)
    got = registry.QUERIES[name](spark, odd)
    n = got.count()
    if name.startswith("op") and name not in ("op2_nearest_vectors", "op4_chat_format", "op4_reply_trees", "op5_language_id_pages", "op6_best_fit_packing", "op11_spelling_variants", "op13_ranked_search"):
        assert n == len(odd_rows())
    assert n > 0 and got.columns == none.columns


def test_odd_near_duplicates(spark, odd):
    got = Counter((r["doc_id"], r["n_shingles"] > 0, r["component_id"], r["kept"]) for r in neardup.near_duplicates(spark.read.parquet(f"{odd}/documents.parquet")).collect())
    assert got[(4, True, 4, True)] == 3 and got[(5, True, 4, False)] == 1 and got[(6, True, 4, False)] == 1
    assert got[(0, False, 0, True)] == got[(1, False, 1, True)] == 1 and got[(8, True, 7, False)] == 1


def chains(n):
    """Texts of which only neighbours are similar, and a crowd of near copies in one bucket."""
    word = lambda k: f"w{k}"
    rows = [(k, " ".join(word(i) for i in range(12 * k, 12 * k + 160))) for k in range(n)]
    crowd = [(1000 + k, " ".join(word(90_000 + i) if i % 101 != k % 101 else f"v{k}" for i in range(160))) for k in range(150)]
    return rows + crowd + [(5000 + k, f"alone {k} " + " ".join(f"u{k}_{i}" for i in range(30))) for k in range(20)]


def brute_components(rows):
    sets = {d: set(neardup.shingles(t).tolist()) for d, t in rows}
    top = {d: d for d in sets}

    def find(d):
        while top[d] != d:
            d = top[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both) and both and find(a) != find(b):
                top[max(find(a), find(b))] = min(find(a), find(b))
    return {d: find(d) for d in ids}


def test_near_duplicates_against_brute_force(spark):
    rows = chains(25)
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_components(rows)


def test_sieve_passes_all_keys_and_few_others(spark):
    table = spark.range(20_000).select(F.when(F.col("id") > 0, F.col("id")).alias("k"))
    keys = table.where("k % 10 = 0 OR k IS NULL")
    got = [r["k"] for r in table.where(sieve.passing(keys, "k", 2000)("k")).collect()]
    assert {None, *range(10, 20_000, 10)} <= set(got) and len(got) < 4000
    assert table.where(sieve.passing(keys.where("false"), "k", 0)("k")).count() == 0


def test_packing(spark, odd):
    got = pack.query(spark, odd).toPandas()
    assert got.groupby("sequence_id")["length"].sum().max() <= 2048
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert (g["offset"] == g["length"].cumsum() - g["length"]).all()
    assert got["sequence_id"].nunique() == -(-got["length"].sum() // 2048) or got["sequence_id"].nunique() <= 1.02 * got["length"].sum() / 2048 + 1


def test_packing_of_common_lengths(spark, monkeypatch):
    monkeypatch.setattr(pack, "LEAST", 50)
    rows = [(k, 2048 if k % 2 else 1 + k % 37) for k in range(2000)]
    got = pack.packed(spark.createDataFrame(rows, "doc_id long, length long"), order=("doc_id",)).toPandas()
    assert sorted(got[["doc_id", "length"]].itertuples(index=False, name=None)) == rows
    total = got["length"].sum()
    assert got["sequence_id"].nunique() == -(-total // 2048)
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert (g["offset"] == g["length"].cumsum() - g["length"]).all() and g["length"].sum() <= 2048


@pytest.mark.parametrize("rows", [400, 3000])
def test_sharding_after_many_cuts(spark, monkeypatch, rows):
    """Sizes over many orders of magnitude, so that ranges are cut again until the last round."""
    monkeypatch.setattr(shard, "SAMPLED", 1)
    table = [(k, "x" * int(2 ** (k % 17)) + str(k)) for k in range(rows)]
    got = shard.sharded(spark.createDataFrame(table, "doc_id long, text string"), 10).toPandas()
    assert len(got) == rows
    for _, g in got.groupby("shard"):
        assert sorted(g["slot"]) == list(range(len(g)))
    sums = got.groupby("shard")["size"].sum()
    assert sums.max() - sums.min() <= 2 * got["size"].max()


def test_sharding(spark):
    rows = [(k, "hot text " * 20 if k % 3 == 0 else f"text {k} " * (k % 50)) for k in range(3000)] + [(None, None)]
    got = shard.sharded(spark.createDataFrame(rows, "doc_id long, text string"), 40).toPandas()
    assert len(got) == len(rows)
    size = {d: len((t or "").encode()) + 16 for d, t in rows}
    assert all(size[None if d != d else d] == s for d, s in zip(got["doc_id"], got["size"]))
    sums = got.groupby("shard")["size"].sum()
    assert len(sums) == 40 and sums.max() - sums.min() <= 2 * max(size.values())
    for _, g in got.groupby("shard"):
        assert sorted(g["slot"]) == list(range(len(g)))
    assert set(got["text_crc32"]) == {zlib.crc32((t or "").encode()) for _, t in rows}


def test_reply_trees(spark):
    nodes = [("t", 1, None, 0.0), ("t", 2, 1, 1.0), ("t", 3, 1, 5.0), ("t", 4, 2, 0.0), ("t", 5, 3, 5.0), ("t", 6, 3, 1.0), ("t", 8, 9, 0.0), ("t", 9, 8, 0.0), ("u", 1, 77, None)]
    df = spark.createDataFrame(nodes, "tree string, node long, parent long, score double")

    def told(keep):
        out = defaultdict(list)
        for r in chat.paths(df, keep).orderBy("depth").collect():
            out[r["tree"], r["leaf"]].append(r["node"])
        return dict(out)

    assert told(None) == {("t", 4): [1, 2, 4], ("t", 5): [1, 3, 5], ("t", 6): [1, 3, 6], ("u", 1): [1]}
    assert told(1) == {("t", 5): [1, 3, 5], ("u", 1): [1]}
    deep = spark.createDataFrame([("d", k, k - 1 if k else None, 0.0) for k in range(100)], "tree string, node long, parent long, score double")
    assert [r["node"] for r in chat.paths(deep).orderBy("depth").collect()] == list(range(100))


def test_given_trees_branch_and_lose_branches(spark):
    """At sf0.01: trees with several leaves, and with more than are kept, where the best are kept."""
    nodes = chat.forest(spark.read.parquet("/root/testdata/sf0.01/conversations.parquet"))
    score = {(r["tree"], tuple(r["node"])): (r["score"], r["parent"] and tuple(r["parent"])) for r in nodes.collect()}
    leaves = set(score) - {(t, p) for (t, _), (_, p) in score.items()}
    of = defaultdict(list)
    for t, leaf in leaves:
        way, at = [], leaf
        while at:
            way.append(score[t, at][0])
            at = score[t, at][1]
        of[t].append((-sum(way) / len(way), leaf))
    want = {(t, leaf) for t, some in of.items() for _, leaf in sorted(some)[: chat.BRANCHES]}
    assert len(leaves) == 100 and sum(len(x) > 1 for x in of.values()) > 15 and len(leaves) - len(want) > 10
    got = chat.tree_query(spark, "/root/testdata/sf0.01").collect()
    assert {(r["tree"], (r["conv"], r["n_turns"] - 1)) for r in got} == want and len(got) == len(want)


def test_ties_in_rank_and_very_long_texts(spark):
    rows = [(k, 0, "user", "Hi") for k in range(5)] + [(k, 1, "assistant", "x" * 10) for k in range(5)] + [(9, 0, "user", "a </s> b " * 200_000), (9, 1, "assistant", "y" * 3_000_000)]
    said = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["leaf"]["conv"]: r for r in chat.formatted(chat.forest(said), chat.BRANCHES).collect()}
    assert set(got) == {"0", "1", "9"}  # of equal scores the smaller conversations
    turns = chat.read_back(got["9"]["formatted"])
    assert [t[:2] for t in turns] == [("topic", "a "), ("user", rows[10][3]), ("assistant", rows[11][3])]


def test_chat_odd_conversations(spark, odd):
    got = {r["conv_id"]: r for r in chat.query(spark, odd).collect()}
    want = {1: [("", "hi <|end|> </s>")] * 2 + [("user", "")], 2: [("a\nb\\", "")], None: [("assistant", "x")]}
    for c, turns in want.items():
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
    assert got[None]["loss_chars"] == 1 and got[-7]["loss_chars"] == 21


def test_nearest_vectors_odd(spark, odd):
    rows = ann.usable(spark.read.parquet(f"{odd}/embeddings.parquet"))
    got = [(r["query_id"], r["rank"], r["vec_id"]) for r in ann.nearest(rows, rows.where("vec_id % 50 = 0"), 2).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1), (0, 2, 2), (50, 1, 100), (50, 2, 0), (100, 1, 0), (100, 2, 0)]


def test_language_accuracy_on_rows_left_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.fitted(docs.where("doc_id % 2 = 0"))
    held = docs.where("doc_id % 2 = 1").select("doc_id", "text", F.lit(None).cast("string").alias("declared"), F.lit(None).cast("string").alias("host"), F.lit(None).cast("string").alias("suffix"))
    both = langid.identified(held, model).select("doc_id", F.col("lang").alias("found"), "kept").join(docs.select("doc_id", "lang"), "doc_id")
    one = both.agg(F.avg((F.col("found") == F.col("lang")).cast("int")).alias("right"), F.avg(F.col("kept").cast("int")).alias("kept")).first()
    assert one["right"] > 0.98 and one["kept"] > 0.99


def test_language_evidence_and_rejection(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    model = langid.fitted(docs)
    rows = [(1, "", "fr", "h", None), (2, "", None, "h", None), (3, "qzxj vkqw xzjq wvkx jqzv kxqj zvwq " * 5, None, None, None), (4, "", None, None, "fr")] + [(k, "", "fr", "h", "fr") for k in range(10, 200)]
    got = {r["doc_id"]: r for r in langid.identified(spark.createDataFrame(rows, "doc_id long, text string, declared string, host string, suffix string"), model).collect()}
    assert got[1]["lang"] == "fr" and got[1]["kept"]
    assert got[2]["lang"] == got[3]["lang"] == "und" and not got[3]["kept"]


def brute_languages(rows, fit):
    """[(lang, posterior, kept)] of rows (text, declared, host, suffix) with a model of all of fit (text, lang)."""
    langs = sorted({x for _, x in fit if x is not None})
    counts = {x: Counter() for x in langs}
    for t, x in fit:
        if x is not None:
            counts[x].update(langid.trigrams(t).tolist())
    size = 1 << langid.BITS
    chance = lambda x, i: math.log((counts[x][i] + 0.5) / (sum(counts[x].values()) + size / 2))
    share = lambda logs: [math.exp(v - max(logs)) / sum(math.exp(w - max(logs)) for w in logs) for v in logs]
    seen, own = [], []
    for t, declared, host, suffix in rows:
        at = langid.trigrams(t).tolist()
        mean = [sum(chance(x, i) for i in at) / max(len(at), 1) for x in langs]
        ll = [m * min(len(at), langid.STRONGEST) for m in mean]
        said = [math.log(langid.DECLARED if x == declared else (1 - langid.DECLARED) / max(1, len(langs) - 1)) for x in langs] if declared in langs else None
        strange = len(at) >= langid.ENOUGH and max(mean) < langid.CHANCE
        both = [a + b for a, b in zip(ll, said or [0.0] * len(langs))]
        seen.append((both, strange, not at and not said, host or "", suffix or ""))
        own.append(None if strange or not (at or said) else share(both))
    out = []
    whole, hosts, suffixes = Counter(), Counter(), Counter()
    for p, (_, _, _, h, s) in zip(own, seen):
        for k, v in enumerate(p or []):
            whole[k] += v
            suffixes[s, k] += v
            hosts[h, s, k] += v
    for p, (both, strange, blank, h, s) in zip(own, seen):
        prior = [1 / len(langs)] * len(langs)
        for of, weight in ((lambda k: whole[k], len(langs)), (lambda k: suffixes[s, k], langid.PSEUDO), (lambda k: hosts[h, s, k], langid.PSEUDO)):
            n = [max(0.0, of(k) - (p[k] if p else 0)) for k in range(len(langs))]
            prior = [(a + weight * b) / (sum(n) + weight) for a, b in zip(n, prior)]
        post = share([a + math.log(b) for a, b in zip(both, prior)])
        out.append(("und" if strange or blank else langs[post.index(max(post))], max(post), not strange and not blank and max(post) >= langid.LEAST))
    return out


def test_language_queries_against_brute_force(spark, odd):
    tag = re.compile(r"<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", re.S | re.I)
    for folder in (FOLDER, odd):
        docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
        fit = [(r["text"], r["lang"]) for r in docs]
        rows = [(r["text"], r["lang"], r["source"], r["source"].rsplit(".", 1)[1] if "." in (r["source"] or "") else None) for r in docs]
        told = lambda x: sorted((str(i), lang, round(p, 6), k) for i, lang, p, k in x)
        got = langid.query(spark, folder).collect()
        assert told((r["doc_id"], r["lang"], r["posterior"], r["kept"]) for r in got) == told((r["doc_id"], *x) for r, x in zip(docs, brute_languages(rows, fit)))
        pages, rows = spark.read.parquet(f"{folder}/pages.parquet").collect(), []
        for r in pages:
            address = re.match(r"[A-Za-z]+://([^/:?#]+)", r["url"] or "")
            host = address[1].lower() if address else ""
            declared = re.search(r"""(?i)<html[^>]*?\blang\s*=\s*["']?([A-Za-z]{2,3})""", r["html"] or "")
            rows.append((html.unescape(tag.sub(" ", r["html"] or "")), declared and declared[1].lower(), ".".join(host.split(".")[-3:]), host.split(".")[-1]))
        got = langid.page_query(spark, folder).collect()
        assert told((r["page_id"], r["lang"], r["posterior"], r["kept"]) for r in got) == told((r["page_id"], *x) for r, x in zip(pages, brute_languages(rows, fit)))


def test_visible_text_is_linear_and_like_the_plain_pattern():
    tag = re.compile(r"<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", re.S | re.I)
    rng = random.Random(6)
    parts = ["<script>", "</script >", "<STYLE", "</style>", "<!--", "-->", "<", ">", "<p>", "a", "&amp;", "<!-->", "\n"]
    for _ in range(3000):
        page = "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))
        assert langid.visible(page) == html.unescape(tag.sub(" ", page)), page
    began = time.perf_counter()
    langid.visible("<script <!-- <style " * 100_000)
    assert time.perf_counter() - began < 5


def test_rare_labels_beyond_the_model_are_unknown(spark, tmp_path):
    rows = spark.range(900).select(F.col("id").alias("doc_id"), F.concat(F.lit("a text of words "), "id").alias("text"), F.concat(F.lit("l"), F.col("id") % 450).alias("lang"), F.lit("h").alias("source"), F.lit(1).alias("n_chars"))
    more = rows.withColumn("doc_id", F.col("doc_id") + 1000).where("lang = 'l449'")
    rows.unionByName(more).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "http://a.fr/x", "<html lang='l1'><p>a text")], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    langs, table = langid.fitted(spark.read.parquet(f"{tmp_path}/documents.parquet"))
    assert len(langs) == langid.LABELS == table.shape[1] and "l449" in langs
    assert langid.query(spark, str(tmp_path)).count() == 902 and langid.page_query(spark, str(tmp_path)).count() == 1
    assert corpus_pipeline.language_id(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path)).columns == rows.columns


def test_declaration_after_many_attributes(spark):
    pages = [(1, None, f"<!doctype html>\n<HTML {'a=b ' * 5000} lang=fr>"), (2, None, "<html" * 200_000), (3, None, "<html><p lang='de'>"), (4, None, None)]
    began = time.perf_counter()
    got = {r["doc_id"]: r["declared"] for r in langid.of_pages(spark.createDataFrame(pages, "page_id long, url string, html string")).select("doc_id", "declared").collect()}
    assert got == {1: "fr", 2: None, 3: None, 4: None} and time.perf_counter() - began < 20


def test_rare_languages_are_known(spark):
    word = lambda base, k: " ".join(f"{base}{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}" for _ in range(8))
    rows = [(k, word("the", k), "en") for k in range(3000)] + [(None, word("łóż", k), "pl") for k in range(4)] + [(9000, "1 2 3", "xx"), (9001, None, None)]
    langs, table = langid.fitted(spark.createDataFrame(rows, "doc_id long, text string, lang string"), sample=50)
    assert langs == ["en", "pl", "xx"] and table.shape == (1 << langid.BITS, 3)
    at = langid.trigrams(word("łóż", 1))
    assert table[at].mean(0).argmax() == 1 and table[at].mean(0)[1] > langid.CHANCE > table[at].mean(0)[2]


def test_frequent_lines(spark):
    body = lambda k: "\n".join(" ".join(f"t{k}_{j}_{i}" for i in range(9)) for j in range(3))
    rows = [(k, body(k) + "\nall  RIGHTS reserved by the owner of this site", "h") for k in range(30)]
    rows += [(100 + k, "all rights reserved by the owner of this site " + " ".join(f"u{k}" for _ in range(1)), "g") for k in range(3)]
    rows += [(200 + k, "all rights reserved by the owner of this site", "h") for k in range(2)] + [(300 + k, body(999), "h") for k in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r["doc_id"]: r for r in quality.judged(df, most_docs=5).collect()}
    assert got[0]["n_lost_words"] == 0 and got[1]["n_lost_words"] == 9 and got[1]["kept"]
    assert got[300]["n_lost_words"] == 0 and got[339]["kept"]  # copies count once
    assert not got[200]["kept"]
    text = {r["doc_id"]: r["text"] for r in quality.filtered(df, most_docs=5).collect()}
    assert "RIGHTS" in text[0] and "RIGHTS" not in text[1] and text[1] == body(1) and 200 not in text


BLANK = "[\\x20\\x09-\\x0D]+"


def plain_quality(rows, most_docs):
    """doc_id: (kept, text without its frequent lines); rows: (doc_id, text, source), ids are different."""
    normal = lambda x: re.sub(BLANK, " ", x).lower().strip(" ")
    holders = defaultdict(dict)  # host and line: texts that have it, each with its smallest id
    first = {}
    for d, t, h in rows:
        first[h, t] = min(d, first.get((h, t), d))
    for (h, t), d in first.items():
        for x in {normal(x) for x in t.split("\n")} - {""}:
            holders[h, x][t] = d
    out = {}
    for d, t, h in rows:
        words = [w for w in re.split(BLANK, t) if w]
        windows = Counter(zip(*(words[k:] for k in range(5))))
        covered = {i + k for i, w in enumerate(zip(*(words[k:] for k in range(5)))) if windows[w] > 1 for k in range(5)}
        gone = {x for x in {normal(x) for x in t.split("\n")} - {""} if len(holders[h, x]) > most_docs and min(holders[h, x].values()) != first[h, t]}
        left = len(words) - sum(len(x.split(" ")) for x in gone)
        failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
        out[d] = (not failed and left >= 10 and left >= 0.2 * len(words), "\n".join(x for x in t.split("\n") if normal(x) not in gone) if gone else t)
    return out


def test_pipeline_against_a_plain_one(spark):
    folder = "/root/testdata/sf0.01"
    out = corpus_pipeline.run(spark, folder).toPandas()
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = docs.collect()
    found = plain_quality([(r["doc_id"], r["text"] or "", r["source"] or "") for r in rows], quality.MOST_DOCS)
    kept = {d: t for d, (k, t) in found.items() if k}
    texts = {r["doc_id"]: r["text"] for r in rows}
    assert sum(t != texts[d] for d, t in kept.items()) > 20  # lines are removed here
    assert {r["doc_id"]: r["text"] for r in quality.filtered(docs).collect()} == kept
    left = spark.createDataFrame([(d, t) for d, t in kept.items()], "doc_id long, text string").join(docs.drop("text"), "doc_id")
    languages = {r["doc_id"]: r["kept"] for r in langid.identified(langid.of_documents(left), langid.fitted(left)).collect()}
    kept = {d: t for d, t in kept.items() if languages[d]}
    comp = brute_components(sorted(kept.items()))
    kept = {d: t for d, t in kept.items() if comp[d] == d}
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = set()
    for d, t in kept.items():
        for kind, start, end, _ in sorted((s for s in pii.spans_of(t) if s[3] >= pii.LEAST), key=lambda s: -s[1]):
            t = f"{t[:start]}[{kind.upper()}]{t[end:]}"
        ids = [*library.encode(t, add_special_tokens=False).ids, 0]
        for n, i in enumerate(range(0, len(ids), 2048)):
            part = ids[i : i + 2048]
            want.add((d, n, i, len(part), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in part))))
    assert set(out[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False, name=None)) == want


def test_quality_of_many_lines_and_clashing_columns(spark):
    many = "\n".join(f"line {k % 70_000} has words" for k in range(100_000))
    rows = [(1, many, "h", 5, "x", True, "y"), (2, None, None, None, "x", False, "z"), (2, "a b", None, 3, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_words int, _text string, _gone boolean, _doc string")
    got = {(r["doc_id"], r["n_words"]): r for r in quality.judged(docs).collect()}
    assert set(got) == {(1, 400_000), (2, 0), (2, 2)} and got[1, 400_000]["n_dup_lines"] == 30_000
    assert (got[1, 400_000]["_text"], got[1, 400_000]["_gone"], got[1, 400_000]["_doc"]) == ("x", True, "y")
    lines = "\n".join(" ".join(f"w{k}_{i}" for i in range(9)) for k in range(4))
    rows = [(k, f"shared by many texts of this host\n{lines.replace('w', f'v{k}')}", "h", 7, f"t{k}", k == 3, "d") for k in range(9)]
    docs = spark.createDataFrame(rows, docs.schema)
    got = sorted(map(tuple, quality.filtered(docs).collect()))
    assert got == [(r[0], r[1] if r[0] == 0 else r[1].split("\n", 1)[1], *r[2:]) for r in rows]


def test_pipeline_decides_by_row(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("text", "lang", "source").where("lang = 'en'").dropDuplicates(["text"]).orderBy("text").limit(6).collect()
    odd = "qzxj vkqw xzjq wvkx jqzv kxqj zvwq " * 5
    clean = [" ".join(f"{w}{k}" for w in r["text"].split()[:40]) for k, r in enumerate(docs)]
    rows = [(i, t, r["lang"], r["source"], len(t)) for i, t, r in zip([None, None, 7, 7, 3, 8], clean, docs)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    told = lambda df: sorted(((r["doc_id"] or 0, r["text"]) for r in df.collect()))
    want = lambda some: sorted((r[0] or 0, r[1]) for r in some)
    copies = [(7, clean[4], "en", "s", 1), (None, clean[5], "en", "s", 1), rows[0], rows[2]]  # of 3's text, of 8's, and repeated rows
    assert told(corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows + copies, schema), FOLDER)) == want(rows)
    mixed = [(None, odd, None, None, 1), (7, odd, None, None, 1)]
    texts = [(r["text"], r["lang"], r["source"]) for r in docs]
    rows = [(i, *t, 1) for i, t in zip([None, None, 7, 7, 3, 8], texts)]
    assert told(corpus_pipeline.language_id(spark, spark.createDataFrame(rows + mixed, schema), FOLDER)) == want(rows)


@pytest.mark.parametrize("name, plain, helper, kinds", [("op1_pii", plain_pii, pii, pii.BASE), ("op8_secrets", plain_secrets, secrets, secrets.BASE)])
def test_span_queries_against_plain_patterns(spark, odd, name, plain, helper, kinds):
    for folder in (FOLDER, odd):
        rows = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
        want = Counter()
        for d, t in rows:
            base = plain(t or "")
            told = lambda spans: ",".join(f"{s[0]}:{s[1]}:{s[2]}" for s in spans)
            want[(d, *(sum(s[0] == k for s in base) for k in kinds), hashlib.sha256(told(base).encode()).hexdigest(), told(helper.spans_of(t)))] += 1
        assert Counter(map(tuple, registry.QUERIES[name](spark, folder).collect())) == want


def test_towers_of_escapes_take_linear_time():
    for text in ("%" + "25" * 100_000, "%" + "5Cu00255Cu0025" * 14_000 + "41"):
        began = time.perf_counter()
        found = secrets.spans_of(text)
        assert time.perf_counter() - began < 5 and len(found) < 100 and all(len(s[0]) < 200 for s in found)
    secret = "password = hunter2hunter2hunter2"
    for k in range(30):
        secret = "".join(f"%{ord(c):02x}" if c in " %=\\" else c for c in secret) if k % 2 else secret.replace(" ", "\\u0020").replace("%", "\\u0025").replace("=", "&#61;")
    assert [s[1:] for s in secrets.spans_of(f"x {secret} y") if s[0].startswith("assign@deep")] == [(2, 2 + len(secret))]
    assert secrets.unwrapped("%25C3%25A9 %E2%82%AC %5Cu0041 &#x26;#65; %FF%41")[0] == "é € A A %FFA"


def test_words_nearby_are_whole_words():
    kinds = lambda t: [s[0] for s in pii.spans_of(t)]
    blanks = " " * 45
    for text in (f"ungrossn{blanks}123-45-6789", f"123-45-6789{blanks[1:]}ssnx", "xssn 123-45-6789", "ssn123-45-6789"):
        assert kinds(text) == [], text
    for text in (f"ssn{blanks}123-45-6789", f"123-45-6789{blanks}ssn", "my ssn: 123-45-6789"):
        assert kinds(text) == ["national_id"], text


def test_stages_leave_columns_of_any_name(spark):
    """Names that the stages themselves use, and names with dots, come out with the values that went in."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("text", "lang", "source").where("lang = 'en'").dropDuplicates(["text"]).orderBy("text").limit(12).collect()
    names = ["_key", "_id", "_lang", "_clean", "_gone", "_doc", "_text", "_host", "_new", "_found", "_one", "doc", "key", "clean", "of", "found", "gone", "h", "a.b", "cls", "n", "rows"]
    rows = [(k, f"{r['text']}\nwrite to me{k}@example.org now", r["lang"], r["source"], len(r["text"]), *[f"{c}{k}" for c in names]) for k, r in enumerate(docs)]
    rows.append((99, rows[0][1], *rows[0][2:5], *[f"{c}99" for c in names]))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in names))
    before = df
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, FOLDER)
        assert after.columns == df.columns, name
        got = after.collect()
        assert got and all(r[c] == f"{c}{r['doc_id']}" for r in got for c in names), name
        before = spark.createDataFrame(got, df.schema)
    assert all("[EMAIL]" in r["text"] for r in got) and 99 not in {r["doc_id"] for r in got}
    assert corpus_pipeline.packing(spark, before, FOLDER).count() >= len(got)


def test_redaction_and_digests(spark):
    df = spark.createDataFrame([("write to a@b.co or 1.2.3.4 now",), (None,), ("version 1.2.3.4",)], "text string")
    assert [r[0] for r in df.select(pii.redacted("text")).collect()] == ["write to [EMAIL] or [IP] now", None, "version 1.2.3.4"]
    found = df.select(pii.joined(pii.pii_spans("text")), pii.joined(secrets.secret_spans("text"))).collect()
    assert found[0][0] == "email:9:15,ip:19:26" and found[1][0] == found[0][1] == ""
