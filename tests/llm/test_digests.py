"""Whole query results of packing, BPE and sharding against the tokenizers library and plain rules."""

import hashlib
import zlib
from collections import Counter

import public_tokenizers
from tokenizers import Tokenizer

from strata.llm import bpe, pack, shard

FOLDER = "/root/testdata/sf0.001"


def rows(spark):
    return [(r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]


def library():
    out = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    out.no_truncation()
    out.no_padding()
    return out


def as_bytes(ids):
    return b"".join(i.to_bytes(4, "little") for i in ids)


def test_packing_has_the_library_s_ids(spark):
    want = Counter()
    for d, t in rows(spark):
        ids = [*library().encode(t, add_special_tokens=False).ids, 0]
        for n, i in enumerate(range(0, len(ids), 2048)):
            part = ids[i : i + 2048]
            want[d, n, i, len(part), zlib.crc32(as_bytes(part))] += 1
    got = pack.query(spark, FOLDER).collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    places = Counter()
    for r in got:
        places[r["sequence_id"]] += r["length"]
    assert max(places.values()) <= 2048 and len(places) <= -(-sum(places.values()) // 2048) + 1


def test_bpe_digests_are_the_library_s(spark):
    want, one = Counter(), library()
    for d, t in rows(spark):
        ids = one.encode(t, add_special_tokens=False).ids
        want[d, len(ids), hashlib.sha256(as_bytes(ids)).hexdigest(), hashlib.sha256(one.decode(ids, skip_special_tokens=False).encode()).hexdigest()] += 1
    assert Counter(tuple(r[c] for c in ("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")) for r in bpe.query(spark, FOLDER).collect()) == want


def test_sharding_digests_and_law(spark):
    got = shard.query(spark, FOLDER).collect()
    want = Counter((d, len(t.encode()) + 16, zlib.crc32(t.encode())) for d, t in rows(spark))
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want and {r["law"] for r in got} == {"bytes"}
    sums, slots = Counter(), {}
    for r in got:
        sums[r["shard"]] += r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert set(sums) <= set(range(40)) and max(sums.values()) - min(sums.values()) <= 2 * max(r["size"] for r in got)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
