import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from tidemill.llm import packing, segment, topk
from tidemill.llm.queries import RULES, op1_packing, op2_sharding, op4_sampled_segmentations, tokenizer
from tidemill.llm.sharding import ShardStore
from tidemill.llm.store import Scratch
from tidemill.llm.urlfilter import bloom, flagged, judge

ODD = [(1, None), (2, ""), (3, "x"), (3, "x"), (None, "null id"), (5, "words " * 40000), (6, "é한😀\x00"), (7, "<|endoftext|> is text"), (8, "q" * 30000)]


def test_hilbert_curve_visits_neighbours():
    for axes, bits in ((2, 4), (3, 3), (4, 2)):
        grid = np.array(np.meshgrid(*[range(1 << bits)] * axes, indexing="ij")).reshape(axes, -1).T
        h = packing.hilbert(grid, bits)
        assert sorted(h) == list(range(len(grid)))
        assert (np.abs(np.diff(grid[np.argsort(h)], axis=0)).sum(axis=1) == 1).all()


@pytest.mark.parametrize("length", [64, 1024])
def test_packing(spark, frame, length):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer())
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").filter("doc_id > 9")
    rows = [tuple(r) for r in docs.collect()] + ODD
    df = docs.union(frame(ODD, "doc_id long, text string")).selectExpr("*", "1 as key", "2 as row", "3 as tokens").repartition(4)
    pieces = packing.pack(df, tokenizer(), length).collect()
    at = {}
    for r in pieces:
        assert r.offset + r.length <= length
        at.setdefault(r.sequence_id, []).append((r.offset, r.length))
    short = 0
    for own in at.values():
        end = 0
        for offset, n in sorted(own):
            assert offset == end
            end += n
        short += end < length
    assert short <= 1 and sorted(at) == list(range(len(at)))
    want = Counter()
    for i, t in rows:
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        own = sorted((r.start, r.length, r.ids_crc32) for r in pieces if r.doc_id == i and r.doc_tokens == len(ids))
        assert sum(n for _, n, _ in own) == len(ids) * sum(1 for j, u in rows if j == i and u == t)
        for a, n, crc in own:
            assert zlib.crc32(ids[a : a + n].tobytes()) == crc
        want[i] += len(ids)
    assert sum(r.length for r in pieces) == sum(want.values())
    order = sorted(pieces, key=lambda r: (r.sequence_id, r.offset))
    assert [r.curve_key for r in order] == sorted(r.curve_key for r in order)
    assert packing.pack(df.limit(0), tokenizer()).collect() == []


def brute_top(rows, k, every):
    dims = max((len(v) for _, v in rows if v), default=1)
    ok = [(i, np.pad(np.floor(256 * np.array(v, float)), (0, dims - len(v)))) for i, v in rows if v is not None and None not in v and i is not None and np.isfinite(np.array(v, float)).all()]
    out = []
    for i, q in sorted({i: v for i, v in reversed(ok)}.items()):
        if i % every == 0:
            best = sorted(((-int(v @ q), j) for j, v in ok if j != i))[:k]
            out += [(i, n, j, -s) for n, (s, j) in enumerate(best, 1)]
    return out


@pytest.mark.parametrize("block", [7, 4096])
def test_top_k_against_brute_force(frame, monkeypatch, block):
    monkeypatch.setattr(topk, "BLOCK", block)
    monkeypatch.setattr(topk, "QUERIES", 5)
    monkeypatch.setattr(topk, "ROUNDS", (1, 2, 4))
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=6) * rng.choice([0.1, 1, 5])]) for i in range(150)]
    rows += [(i, rows[0][1]) for i in range(150, 180)]  # ties
    rows += [(200, None), (201, [1.0, None]), (202, [float("nan")] * 6), (203, [float("inf")] * 6), (204, []), (206, [1.0, 2.0]), (None, [1.0] * 6), (210, [0.0] * 6)]
    df = frame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<double>, rank string, score int").repartition(3)
    got = sorted(map(tuple, topk.top_k(df, df.filter("vec_id % 10 = 0"), 5).collect()))
    assert got == brute_top(rows, 5, 10)
    assert topk.top_k(df.limit(0), df.limit(0), 5).collect() == []
    one = df.filter("vec_id = 10")
    assert topk.top_k(one, one, 5).collect() == []


def plain_verdict(url, rules, listed):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host, tail = rest[:cut], rest[cut:]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
        path = tail[: min([tail.find(c) for c in "?#" if c in tail] or [len(tail)])]
    fits = [(h + p, v) for h, p, v in rules if host and (host == h or host.endswith("." + h)) and path.startswith(p)]
    if fits:
        return host, path, *max(fits, key=lambda x: len(x[0]))
    return host, path, None, "block" if host + path in listed else "allow"


@pytest.mark.parametrize("most", [1 << 16, 0])
def test_urls(frame, most):
    urls = [None, "", "no scheme", "http://", "http://COM/en/", "https://A.Example.COM/en/77?x#y", "http://example.com/en/6", "http://notexample.com/en/7", "x://b.net/de/8", "x://example.net/de/8",
            "x://a.org#/es/", "x://a.org/es", "x://a.org/es/", "y://user@h.com:80/en/", "http://bad.test/spot", "http://bad.test/spot2", "a://b://c.com/en/", "http://" + "a." * 3000 + "com/en/", "x://İ.com/en/é"]
    rows = [(i, u, "x", "y", 1) for i, u in enumerate([*urls, *urls])]
    df = frame(rows, "page_id long, url string, host string, verdict string, best int")
    listed = frame([("bad.test/spot",), ("bad.test/spot",), (None,)], "key string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in judge(df, RULES, listed, most=most).collect()}
    for i, u, *_ in rows:
        assert got[i] == plain_verdict(u, RULES, {"bad.test/spot"}), u
    assert judge(df.limit(0), RULES, listed, most=most).collect() == []
    assert {r.verdict for r in judge(df, [], listed.limit(0), most=most).collect()} == {"allow"}
    assert {r.verdict for r in judge(df, [], None).collect()} == {"allow"}


def test_bloom_has_no_false_negatives(spark):
    from pyspark.sql import functions as F

    keys = spark.range(3000).selectExpr("concat('k', id) as key")
    assert bloom(keys, 64).count() <= 64
    probes = spark.range(20000).selectExpr("concat('k', id) as name", "id")
    for most in (1 << 16, 16):  # broadcast, and dealt by blocks
        passed = flagged(probes, F.col("name"), keys, 3000, most).filter("__maybe")
        assert passed.filter("id < 3000").count() == 3000 and passed.count() < 5000
    assert flagged(probes, F.col("name"), keys, 3000, 16, deal=False).filter("__maybe").count() == 20000


def test_the_list_meets_possible_hits_in_a_hash_join(spark, frame):
    df = frame([(1, "http://bad.test/x")], "page_id long, url string")
    plan = judge(df, RULES, frame([("bad.test/x",)], "key string"))._jdf.queryExecution().toString()
    assert "strategy=shuffle_hash" in plan


def stored(df):
    return sorted((r.doc_id, r.text or "", r.shard_) for r in df.collect())


def test_shards(spark, frame):
    schema = "doc_id long, text string, shard string"
    plain = frame([], schema).schema
    store = ShardStore(spark, Scratch(spark, "shards").root, target=60_000, fanout=3, shard_rows=20)
    assert store.version() == 0 and store.read(plain, 0).collect() == [] and store.compact(plain) == 0
    rng = random.Random(0)
    rows = [(i, "".join(rng.choice("abcdefghij") for _ in range(rng.randint(0, 900))) if i % 50 else None, f"s{i % 3}") for i in range(700)]
    rows += rows[:3]
    want = sorted((i, t or "", s) for i, t, s in rows)
    sizes = [300, 200, 100, 50, 30, 20, 3]  # arrivals
    for k, n in enumerate(sizes):
        at = sum(sizes[:k])
        store.append(frame(rows[at : at + n], schema))
        if k % 2:
            store.compact(plain)
    before = store.version()
    small = sum(r["files"] for r in store.runs())
    assert stored(store.read(plain)) == want
    after = store.compact(plain)
    assert after > before and sum(r["files"] for r in store.runs()) < small and store.plan() == []
    assert stored(store.read(plain, before)) == want  # old versions stay readable
    store.vacuum()
    got = store.read(plain)
    assert stored(got) == want and got.columns == ["doc_id", "text", "shard_", "shard", "shard_rows", "shard_bytes"]
    count = Counter(r.shard for r in got.collect())
    assert all(count[r.shard] == r.shard_rows and 0 < r.shard_bytes < 2 * 60_000 for r in got.collect())
    assert store.append(frame([], schema)) == after + 1 and store.read(plain).count() == len(rows)


def test_merging_takes_no_shuffle(spark, frame):
    store = ShardStore(spark, Scratch(spark, "shards").root, target=40_000, fanout=3, shard_rows=50)
    rng = random.Random(1)
    df = frame([(i, "".join(rng.choice("abcdefghij") for _ in range(500))) for i in range(1000)], "doc_id long, text string")
    store.append(df)
    (group,) = store.plan()
    merged = store.merged(group, df.schema)
    assert "Exchange" not in merged._jdf.queryExecution().toString()
    assert 1 < merged.rdd.getNumPartitions() <= math.ceil(group[0]["bytes"] / 40_000)
    store.compact(df.schema)
    (run,) = store.runs()
    assert run["rows"] == 1000 and run["files"] < group[0]["files"] and run["bytes"] / run["files"] > 0.6 * 40_000


def test_a_taken_version_is_not_overwritten(spark, frame):
    schema = "doc_id long"
    store = ShardStore(spark, Scratch(spark, "shards").root)
    store.append(frame([(1,)], schema))
    assert store._publish(1, []) is False and store.read(frame([], schema).schema, 1).count() == 1
    real, calls = store.version, []

    def late():  # another writer commits between reading the version and publishing the next
        calls.append(1)
        return real() - 1 if len(calls) == 1 else real()

    store.version = late
    assert store.append(frame([(2,)], schema)) == 2
    store.version = real
    assert len(store.runs()) == 2


def test_a_merge_that_comes_too_late_is_given_up(spark, frame):
    schema = "doc_id long"
    path = Scratch(spark, "shards").root
    store, other = (ShardStore(spark, path, fanout=2) for _ in range(2))
    for k in range(4):
        store.append(frame([(k,)], schema))
    real = store.merged

    def slow(group, kind):  # another writer merges the same runs first
        store.merged = real
        other.compact(kind)
        return real(group, kind)

    store.merged = slow
    store.compact(frame([], schema).schema)
    assert sorted(r.doc_id for r in store.read(frame([], schema).schema).collect()) == [0, 1, 2, 3] and len(store.runs()) == 1
    store.vacuum()
    assert store.read(frame([], schema).schema).count() == 4


@pytest.fixture(scope="module")
def vocab():
    return segment.vocabulary(tokenizer("piece_bpe_32k.model"))


def every_segmentation(v, text):
    ids = {p: i for i, p in enumerate(v.pieces) if not p.startswith("<0x") and i > 2}
    logp = {}
    nodes = {0: ""}
    edges = {int(k): int(t) for keys, to in v.tables for k, t in zip(keys, to, strict=True) if k >= 0}
    back = {int(c): chr(i) for i, c in enumerate(v.cls) if c and i != 32}
    back[int(v.cls[32])] = segment.MARK
    todo = [0]
    grown: dict = {}
    for key, to in edges.items():
        grown.setdefault(key // v.width, []).append((key % v.width, to))
    while todo:
        n = todo.pop()
        for c, to in grown.get(n, []):
            nodes[to] = nodes[n] + back[c]
            todo.append(to)
    for n, p in nodes.items():
        if v.node_id[n] >= 0:
            logp[p] = v.node_lp[n]
    t = segment.MARK + text.replace(" ", segment.MARK)
    out = {}

    def go(i, got, lp):
        if i == len(t):
            out[tuple(got)] = lp
            return
        for j in range(i + 1, len(t) + 1):
            if t[i:j] in logp:
                go(j, [*got, ids[t[i:j]]], lp + logp[t[i:j]])
        if t[i] not in logp:
            raw = t[i].encode()
            go(i + 1, [*got, *map(int, v.bytes[list(raw)])], lp + len(raw) * v.byte_logp)

    go(0, [], 0.0)
    z = np.logaddexp.reduce(list(out.values()))
    return {k: x - z for k, x in out.items()}


@pytest.mark.parametrize("text", ["the cat", "re.\nab", "a", "é😀x"])
def test_segmentations_are_sampled_without_replacement(vocab, text):
    want, n = every_segmentation(vocab, text), 1500
    weight, first = Counter(), Counter()
    for got in segment.sample_texts(vocab, list(range(n)), [text] * n, 3):
        ids = [tuple(map(int, s[0])) for s in got]
        assert len(set(ids)) == len(ids) == min(3, len(want))
        assert all(abs(want[i] - s[1]) < 1e-9 for i, s in zip(ids, got, strict=True))
        g = [s[2] for s in got]
        assert g == sorted(g, reverse=True) and g[-1] >= got[0][3]
        assert all(segment.decode(vocab, i) == text for i in ids)
        first[ids[0]] += 1
        for i, s in zip(ids, got, strict=True):
            weight[i] += 1 / (1 - math.exp(-math.exp(s[1] - s[3]))) if s[3] > -math.inf else 1
    # The first sample follows the distribution; samples weighted by inclusion are unbiased.
    for i, lp in sorted(want.items(), key=lambda x: -x[1])[:2]:
        p = math.exp(lp)
        assert abs(first[i] / n - p) < 5 * math.sqrt(p * (1 - p) / n) + 1e-3
    assert abs(sum(math.exp(want[i]) * w / n for i, w in weight.items()) - 1) < 0.05


def test_encoding_round_trip(spark, frame):
    model = tokenizer("piece_bpe_32k.model")
    rows = [*ODD, (9, "▁ a mark ▁"), (10, " lead  and trail \n")]
    df = frame([(i, t, "x") for i, t in rows], "doc_id long, text string, ids string")
    enc = segment.sample_segmentations(df, model)
    back = segment.decode_rows(enc, model).collect()
    assert Counter((r.doc_id, r.text) for r in back) == Counter((i, t or "") for i, t in rows for _ in range(2 if t else 1))
    again = segment.sample_segmentations(df.repartition(5), model)
    assert sorted(map(repr, enc.collect())) == sorted(map(repr, again.collect()))
    assert segment.sample_segmentations(df.limit(0), model).collect() == []


def test_segmentation_query_decodes_to_the_documents(spark):
    sf = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = op4_sampled_segmentations(spark, sf).collect()
    assert Counter(r.doc_id for r in got) == {i: 2 if t else 1 for i, t in docs.items()}
    assert all(r.decoded_crc32 == zlib.crc32((docs[r.doc_id] or "").encode()) and r.ids_crc32 == zlib.crc32(r.ids) and len(r.ids) == 2 * r.n_pieces for r in got)
    assert len({(r.doc_id, bytes(r.ids)) for r in got}) == len(got)


def test_packing_query_on_whole_documents(spark):
    from tokenizers import Tokenizer

    sf, tok = "/root/testdata/sf0.001", Tokenizer.from_file(tokenizer())
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    pieces: dict = {}
    rows = op1_packing(spark, sf).collect()
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
    assert pieces.keys() == docs.keys()
    for i, own in pieces.items():
        ids = np.array([*tok.encode(docs[i] or "", add_special_tokens=False).ids, 0], "<u4")
        at = 0
        for r in sorted(own, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    placed = sorted((r.sequence_id * 1024 + r.offset, r.length) for r in rows)
    assert all(a + n == b for (a, n), (b, _) in zip(placed, placed[1:], strict=False)) and placed[0][0] == 0


def test_sharding_query_holds_every_row(spark):
    import hashlib

    sf = "/root/testdata/sf0.001"
    docs = {(r.doc_id, r.n_chars, r.lang, hashlib.sha256((r.text or "").encode()).hexdigest()) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = op2_sharding(spark, sf).collect()
    count = Counter(r.shard for r in got)
    assert {(r.doc_id, r.n_chars, r.lang, r.text_sha256) for r in got} == docs and len(got) == len(docs)
    assert all(r.shard_rows == count[r.shard] for r in got)
