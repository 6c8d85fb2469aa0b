"""Each operator against a brute-force version, with nulls, empty and repeated rows, clashing columns and empty tables."""

from __future__ import annotations

import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lemmaweave.llm import common, crc32c, decontaminate, jaccard, lm, packing, quality, records, sharding, simhash, substring, token_counts, tokenize, warc
from lemmaweave.llm.queries import tokenizer_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")
BYTE_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def ascii_lower(t: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), t)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    pool = [" ".join(f"v{rng.randrange(30)}" for _ in range(20)) for _ in range(5)]
    docs = [(i, " ".join(rng.choice(pool) if rng.random() < 0.3 else f"W{rng.randrange(1000)}" for _ in range(rng.randrange(25)))) for i in range(60)]
    docs += [(100, None), (101, ""), (102, " \n\x0b"), (103, docs[3][1]), (104, docs[3][1]), (104, docs[3][1]), (None, docs[3][1]), (105, "x " * 3000)]
    return docs


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, 1, "c", 2) for i, t in rows], "doc_id long, text string, block int, component_id string, n_words int").cache()


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


# ---- 1 ----


def brute_hits(texts, items, w=10):
    out = []
    split = [(n, BYTE_WORD.findall((t or "").encode().lower())) for n, t in items]
    for t in texts:
        d = BYTE_WORD.findall((t or "").encode().lower())
        hit, names = [0] * len(d), set()
        for n, i in split:
            k = min(w, len(i))
            for s in range(len(i) - k + 1 if i else 0):
                for p in range(len(d) - k + 1):
                    if d[p : p + k] == i[s : s + k]:
                        hit[p : p + k] = [1] * k
                        names.add(n)
        listed = sorted(x for x in names if x is not None)
        out.append((len(d), sum(hit), len(listed), hashlib.sha256(",".join(listed).encode()).hexdigest(), sum(hit) > 0))
    return out


@pytest.mark.parametrize("vocabulary", [2, 8, 60])
def test_decontaminate(spark, vocabulary):
    rng = random.Random(vocabulary)
    some = lambda n: " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))
    items = [(str(i), some(rng.choice([0, 1, 3, 10, 11, 25]))) for i in range(6)] + [(None, "zz yy"), ("7", None)]
    texts = [None, "", "ZZ yy"] + [f"{some(rng.randrange(60))} {items[rng.randrange(6)][1]} é" for _ in range(15)]
    b = spark.createDataFrame(items, "item_id string, text string")
    for block in (1 << 20, 20):  # one block, and many
        d = spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)], "doc_id long, text string, n_hit int")
        got = decontaminate.find_contaminated(d, b, block_bytes=block).orderBy("doc_id")
        assert [tuple(r)[2:7] for r in got.collect()] == brute_hits(texts, items)
    clean = decontaminate.remove_contaminated(d, b)
    assert clean.columns == d.columns and {r.n_hit for r in clean.collect()} <= {5}
    assert decontaminate.find_contaminated(d, b.where("false")).where("contaminated").count() == 0
    assert decontaminate.find_contaminated(d.where("false"), b).count() == 0


def test_longest_match():
    t = decontaminate.Tests([("a", " ".join("abcdefghijklmnop"))], 10)
    assert [x[3] for x in decontaminate.judge(["x " + " ".join("abcdefghijkl") + " q", " ".join("abcdefghijklmnop"), "a b c"], t)] == [[(1, 12, "a", 0)], [(0, 16, "a", 0)], []]


def test_decontaminate_rows_and_names(spark):
    item = " ".join(f"i{k}" for k in range(12))
    long = "x " * 200_000 + item + " y" * 200_000
    b = spark.createDataFrame([("7", item), ("8", item), ("9", "i3")], "item_id string, text string")
    d = spark.createDataFrame([(None, f"a {item}", 1, 2, 3), (None, f"a {item}", 1, 2, 3), (5, "clean", 4, 5, 6), (6, long, 7, 8, 9)], "doc_id long, text string, __n int, n_hit int, __own_n_hit int")
    rows = decontaminate.find_contaminated(d, b).orderBy("n_words").collect()
    assert [(r.doc_id, r["__n"], r.n_hit, r.longest_match) for r in rows] == [(5, 4, 0, 0), (None, 1, 12, 12), (None, 1, 12, 12), (6, 7, 12, 12)]
    assert [tuple(m) for m in rows[1].matches] == [(1, 12, "7", 0), (1, 12, "8", 0), (4, 1, "9", 0)]
    assert rows[3].matches[0].start == 200_000
    assert [tuple(r) for r in decontaminate.remove_contaminated(d, b).collect()] == [(5, "clean", 4, 5, 6)]


# ---- 2 ----


def test_warc(spark):
    rec = "WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:77>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    html = [None, "", "x", "x", "é\r\n\r\nü", rec, rec + rec, f"pre{rec}post", "WARC/1.0\r\n", "WARC/1.0\r\nContent-Length: 99999\r\n\r\n", "y" * 3000] + [f"p{i % 7}" for i in range(20)]
    pages = [(i, f"http://a/{i}\r\n" if i % 2 else None, h) for i, h in enumerate(html)]
    df = spark.createDataFrame([(*p, 0) for p in pages], "page_id long, url string, html string, digest int").repartition(2)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "900b")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        got = warc.archive_pages(df, common.fresh_path(spark, "w")).select(*warc.SAID).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    first: dict[str, int] = {}
    for i, _, h in pages:
        first.setdefault(h or "", i)
    want = []
    for i, _, h in pages:
        b, f = (h or "").encode(), first[h or ""]
        d = base64.b32encode(hashlib.sha1(b).digest()).decode()
        want.append((i, len(b), d, "response" if f == i else "revisit", None if f == i else f, d))
    assert sorted(map(tuple, got)) == sorted(want)
    assert warc.archive_pages(df.where("false"), common.fresh_path(spark, "w")).count() == 0


def test_warc_ids_and_heads(spark):
    pages = [("b", "x" * 50), ("a", "x" * 50), ("a", "x" * 50), (None, "x" * 50), ("c d>\r\n", "y"), ("null", ""), ("\u00e9", None), (None, "z")]
    df = spark.createDataFrame(pages, "page_id string, html string").select("page_id", F.lit("u").alias("url"), "html")
    got = warc.archive_pages(df, common.fresh_path(spark, "w")).select("page_id", "payload_bytes", "record_type", "refers_to").collect()
    want = [("b", 50, "revisit", "a"), ("a", 50, "response", None), ("a", 50, "response", None), (None, 50, "revisit", "a"), ("c d>\r\n", 1, "response", None), ("null", 0, "response", None), ("\u00e9", 0, "response", None), (None, 1, "response", None)]
    rest = [tuple(r) for r in got]
    assert {r[3] for r in rest if r[0] == "\u00e9" or r[0] == "null"} == {None, "null"}  # both are empty; the smallest id answers
    assert sorted(str(r) for r in rest if r[0] != "\u00e9") == sorted(str(w) for w in want if w[0] != "\u00e9")
    at, head, body = common.fresh_path(spark, "w"), "HTTP/1.1 200 OK\r\nX: " + "h" * 6000 + "\r\n\r\n", "payload"
    record = f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:k>\r\nContent-Length: {len(head + body)}\r\n\r\n{head}{body}"
    spark.createDataFrame([(record,)], "value string").coalesce(1).write.option("lineSep", "\r\n\r\n").text(at)
    r = warc.read_warc(spark, at).first()
    assert (r.page_id, r.payload_bytes, r.payload_digest) == ("k", 7, base64.b32encode(hashlib.sha1(b"payload").digest()).decode())
    wrong = record.replace("Content-Length: ", "WARC-Payload-Digest: sha1:AAAA\r\nContent-Length: ", 1)
    at = common.fresh_path(spark, "w")
    spark.createDataFrame([(wrong,)], "value string").coalesce(1).write.option("lineSep", "\r\n\r\n").text(at)
    with pytest.raises(Exception, match="stated digest"):
        warc.read_warc(spark, at).collect()


def test_warc_when_splits_move(spark, monkeypatch):
    """Split bounds differ between the scans, as when executors come or go."""
    rec = "WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:77>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    html = {i: f"{rec}{rec}{i}" if i % 3 == 0 else f"page {i} " * (i % 11) for i in range(120)}
    pages = spark.createDataFrame([(i, "u", h) for i, h in html.items()], "page_id long, url string, html string").repartition(2)
    sizes, plain = iter(["700b", "1100b", "2500b", "900b", "1500b", "3000b"] * 10), warc.cut

    def moving(df, what="cut"):
        out = plain(df, what)
        spark.conf.set("spark.sql.files.maxPartitionBytes", next(sizes))
        return out

    monkeypatch.setattr(warc, "cut", moving)
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        got = {r.page_id: (r.payload_bytes, r.payload_digest) for r in warc.archive_pages(pages, common.fresh_path(spark, "w")).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got == {i: (len(h), base64.b32encode(hashlib.sha1(h.encode()).digest()).decode()) for i, h in html.items()}


# ---- 3 ----


def components(fps: list[int], radius: int) -> list[int]:
    p = list(range(len(fps)))

    def root(x):
        while p[x] != x:
            x = p[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                p[root(i)] = root(j)
    return [root(i) for i in range(len(fps))]


def brute_fingerprint(t: str | None) -> int:
    w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
    parts = [b" ".join(w[i : i + 4]) for i in range(len(w) - 3)] if len(w) >= 4 else [b" ".join(w)] if w else []
    hs = [xxhash.xxh64_intdigest(s, 42) for s in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_near_duplicates(spark, rows, docs, empty):
    fps = [brute_fingerprint(t) for _, t in rows]
    of = components(fps, 4)
    least = {c: min((rows[j][0] for j in range(len(rows)) if of[j] == c and rows[j][0] is not None), default=None) for c in set(of)}
    want = sorted(str((i, f"{f:016x}", least[c])) for (i, _), f, c in zip(rows, fps, of, strict=True))
    assert sorted(str(tuple(r)) for r in simhash.near_duplicates(docs).collect()) == want
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {None} | {i for (i, _), c in zip(rows, of, strict=True) if i == least[c]}
    assert simhash.near_duplicates(empty).count() == 0


def test_rows_that_share_an_id(spark):
    text = " ".join(f"w{k}" for k in range(30))
    d = spark.createDataFrame([(1, text, 1), (2, text, 2), (2, "quite another text", 3), (None, text, 4), (4, text, 5), (4, text, 5)], "doc_id long, text string, digest int")
    for drop in (simhash.drop_near_duplicates, jaccard.drop_similar):
        assert sorted(str(tuple(r)) for r in drop(d).collect()) == sorted(str(x) for x in [(1, text, 1), (2, "quite another text", 3), (None, text, 4)])


def test_hot_keys(spark):
    rows = spark.range(20_000).selectExpr("id", "if(id % 3 = 0, 7, id) AS k", "id % 3 = 0 AS same")
    counts = rows.groupBy("k").count()
    hot = common.hot_keys(counts, "k", "count", 20_000)
    assert hot == [7]
    assert common.look_up(rows, counts, "k", hot).agg(F.count(F.lit(1)), F.sum("count")).first() == rows.join(counts, "k").agg(F.count(F.lit(1)), F.sum("count")).first()
    assert common.look_up(rows, counts.where("k <> 7"), "k", hot, "left").where("count is null").count() == 6668


def test_links_through_the_forest(spark):
    rng = np.random.default_rng(0)
    pts = []
    for b in rng.integers(0, 2**63, 60, dtype=np.uint64):
        for _ in range(8):
            x = int(b)
            for k in rng.integers(0, 64, rng.integers(0, 4)):
                x ^= 1 << int(k)
            pts.append(x)
    pts = sorted(set(pts))
    nodes = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in pts], "fp long")
    at = {p: i for i, p in enumerate(pts)}
    canon = lambda c: [c.index(x) for x in c]
    want = canon(components(pts, 4))
    for leaf in (4096, 3):  # small leaves are dealt to pairs of blocks
        p = list(range(len(pts)))

        def root(x, p=p):
            while p[x] != x:
                x = p[x]
            return x

        for r in simhash.near_links(nodes, leaf=leaf).collect():
            a, b = r.u & (1 << 64) - 1, r.v & (1 << 64) - 1
            assert (a ^ b).bit_count() <= 4
            p[root(at[a])] = root(at[b])
        assert canon([root(i) for i in range(len(pts))]) == want


# ---- 4 ----


def test_sharding(spark, docs, empty):
    def law(df):
        r = df.collect()
        n = Counter(x.shard for x in r)
        assert max(n.values(), default=0) - min(n.get(s, 0) for s in range(8)) <= 1
        assert all(sorted(x.slot for x in r if x.shard == s) == list(range(n.get(s, 0))) for s in range(8))
        return r

    r = law(sharding.shard_documents(docs))
    texts = docs.collect()
    assert Counter((x.doc_id, x.size, x.text_crc32) for x in r) == Counter((d.doc_id, len((d.text or "").encode()) + 1, zlib.crc32((d.text or "").encode())) for d in texts)
    law(sharding.shard_documents(empty))
    law(sharding.shard_documents(docs.limit(3)))
    pairs = spark.createDataFrame([(i, f"t{i // 2}") for i in range(2000)], "doc_id long, text string")
    by: dict[int, set] = {}
    for x in law(sharding.shard_documents(pairs)):
        by.setdefault(x.doc_id // 2, set()).add(x.shard)
    assert sum(len(s) > 1 for s in by.values()) <= 100  # of 1,000; 875 at the start
    hot = spark.createDataFrame([(i, "same") for i in range(80)] + [(100 + i, f"u{i}") for i in range(120)], "doc_id long, text string")
    assert len({x.shard for x in law(sharding.shard_documents(hot)) if x.doc_id < 100}) <= 5


# ---- 5, 6, 10 ----


@pytest.fixture(scope="module")
def odd_texts():
    rng = random.Random(3)
    alphabet = " a b  c\n\t\r\x0b\x0c\x1c\x85\xa0 é́ ' 's <|endoftext|> ,.!12三ßΣσİ"
    return ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(3000)] + [" ".join(rng.choice(["<|endoftext|>", "a", "'s", "  ", " ", "\n"]) for _ in range(6)) for _ in range(500)]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_pieces_are_whole_texts(odd_texts, name):
    e = tokenize.PieceEncoder(tokenizer_path(name))
    assert e.spaced or e.dropped
    for t, ids in zip(odd_texts, e.many(odd_texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == e.lib.encode(t, add_special_tokens=False).ids, repr(t)


def test_pieces_of_mixed_white_space():
    e = tokenize.PieceEncoder(tokenizer_path("byte_bpe_50k.json"))
    rng = random.Random(9)
    texts = ["Home \xa0 \xa0 About", "A \xa0 \xa0 \xa0 \xa0 B", "\xa0 \xa0", " \xa0 \xa0", "x\xa0 \xa0 \xa0"]
    texts += ["".join(rng.choice([" ", " ", "\xa0", "\xa0", "\n", "\u3000", "a", "1", "!"]) for _ in range(rng.randrange(1, 16))) for _ in range(20_000)]
    for t, ids in zip(texts, e.many(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == e.lib.encode(t, add_special_tokens=False).ids, repr(t)
    assert tokenize.joined_spaces({"\u0120a": 0, "a\u0120\u0120": 1, "a\u0120": 2}).pattern == "a\\ "
    assert tokenize.joined_spaces({"\u0120a": 0, "a": 1}) is None


def test_pieces_of_letters_and_signs():
    e = tokenize.PieceEncoder(tokenizer_path("word_bpe_49k.json"))
    rng = random.Random(4)
    some = ["a", "B", "\u00c9", "\u0301", ".", ",", "!?", "'s", "'", " ", "  ", "\n", "3", "\u03a3", "\u0130", "<|startoftext|>", "<|STARTOFTEXT|>", "-", "\u00df", "\u212b"]
    texts = ["".join(rng.choice(some) for _ in range(rng.randrange(1, 12))) for _ in range(20_000)]
    for t, ids in zip(texts, e.many(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == e.lib.encode(t, add_special_tokens=False).ids, repr(t)


def test_cache_is_trimmed(monkeypatch, odd_texts):
    monkeypatch.setattr(tokenize, "CACHE_PIECES", 200)
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        e = tokenize.PieceEncoder(tokenizer_path(name))
        for k in range(0, 3000, 100):
            some = odd_texts[k : k + 100] + odd_texts[:20]
            assert [np.frombuffer(x, "<u4").tolist() for x in e.many(some)] == [e.lib.encode(t, add_special_tokens=False).ids for t in some]
        assert len(e.place) < 3000


def test_packing(spark, docs, rows, empty):
    from tokenizers import Tokenizer

    path = tokenizer_path("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    out = packing.pack_documents(docs, path, capacity=64).collect()
    want = Counter()
    for i, t in rows:
        ids = lib.encode(t or "", add_special_tokens=False).ids + [2]
        first = (len(ids) - 1) % 64 + 1
        cuts = [0, *range(first, len(ids) + 1, 64)]
        for p, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            want[(i, p, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes()))] += 1
    assert Counter(tuple(r)[:5] for r in out) == want
    by: dict[int, list] = {}
    for r in out:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for v in by.values():
        at = 0
        for o, n in sorted(v):
            assert o == at
            at += n
        assert at <= 64
    bound = packing.bin_lower_bound(np.array([r.length for r in out]), 64)
    assert bound <= len(by) <= bound + max(2, bound // 50)
    assert packing.pack_documents(empty, path).count() == 0


def test_packing_rounds(spark):
    rng = random.Random(2)
    sizes = [rng.choice([rng.randrange(1, 65), 64]) for _ in range(600)]
    p = spark.createDataFrame(list(enumerate(sizes)), "doc_id int, length long")
    out = packing.pack_pieces(p, capacity=64, part_items=40).collect()
    assert len(out) == 600
    by = Counter()
    for r in out:
        by[r.sequence_id] += r.length
    bound = packing.bin_lower_bound(np.array(sizes), 64)
    assert max(by.values()) <= 64 and bound <= len(by) <= 1.05 * bound


@pytest.mark.parametrize("capacity", [10, 97])
def test_bounds_hold(capacity):
    rng = np.random.default_rng(capacity)
    for _ in range(30):
        x = rng.integers(1, capacity + 1, rng.integers(1, 200))
        bins, offset, room = packing.best_fit_decreasing(x, capacity)
        assert packing.bin_lower_bound(x, capacity) <= len(room)
        assert (np.bincount(bins, x, len(room)) == capacity - room).all()


def test_token_counts(spark, docs, rows, empty):
    from tokenizers import Tokenizer

    path, cache = tokenizer_path("byte_bpe_50k.json"), common.fresh_path(spark, "cache")
    lib = Tokenizer.from_file(path)
    counted = [(i, str((i, len((t or "").encode()), n := len(lib.encode(t or "", add_special_tokens=False).ids), n > 512))) for i, t in rows]
    want = sorted(w for _, w in counted)
    got = token_counts.count_tokens(docs.where("doc_id < 40"), path, cache)
    assert sorted(str(tuple(r)[:4]) for r in got.collect()) == sorted(w for i, w in counted if i is not None and i < 40)
    stored = spark.read.parquet(cache)
    assert sorted(str(tuple(r)[:4]) for r in token_counts.count_tokens(docs, path, cache).collect()) == want
    all_ = spark.read.parquet(cache)
    assert all_.groupBy("content").count().where("count > 1").count() == 0 and all_.count() == len({t or "" for _, t in rows})
    assert stored.join(all_, ["content", "tokenizer", "n_tokens"]).count() > 0
    assert token_counts.count_tokens(empty, path, common.fresh_path(spark, "cache")).count() == 0


def test_records(spark, docs, rows, empty):
    from tokenizers import Tokenizer

    path, at = tokenizer_path("word_bpe_49k.json"), common.fresh_path(spark, "records")
    lib = Tokenizer.from_file(path)
    got = sorted(records.token_records(docs, path, at, shard_bytes=600).collect(), key=lambda r: r.start)
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    start = 0
    for r, (i, t) in zip(got, order, strict=True):
        ids = lib.encode(t or "", add_special_tokens=False).ids + [1]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    index = spark.read.parquet(f"{at}/index")
    some = records.read_records(index.orderBy(F.xxhash64("byte_offset", "shard")).limit(9), at).collect()
    assert {(r.shard, r.byte_offset, r.n_tokens) for r in some} <= {(r.shard, r.byte_offset, r.n_tokens) for r in got}
    assert records.token_records(empty, path, common.fresh_path(spark, "records")).count() == 0


def test_frames():
    parts = [random.Random(k).randbytes(n) for k, n in enumerate((0, 1, 3, 4, 255, 256, 257, 3000))]

    def reference(b):
        c = 0xFFFFFFFF
        for x in b:
            c ^= x
            for _ in range(8):
                c = (c >> 1) ^ (0x82F63B78 if c & 1 else 0)
        return c ^ 0xFFFFFFFF

    assert crc32c.crc32c([b"123456789"])[0] == 0xE3069283
    assert [int(x) for x in crc32c.crc32c(parts)] == [reference(p) for p in parts]
    made = records.frames(parts)
    assert records.unframe(made) == parts
    with pytest.raises(ValueError, match="checksum"):
        records.unframe([made[5][:-1] + bytes([made[5][-1] ^ 1])])


# ---- 7 ----


def brute_base(t: str | None) -> tuple:
    t = t or ""
    w, seen, dup = WORD.findall(t), set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    c, g = Counter(zip(w, w[1:], w[2:], strict=False)), [0] * len(w)
    for i in range(len(w) - 2):
        if c[tuple(w[i : i + 3])] > 1:
            g[i : i + 3] = [1, 1, 1]
    return len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in t), dup, sum(g)


def brute_quality(rows, good) -> list[tuple]:
    def features(t):
        w = [x.encode() for x in WORD.findall(t or "")]
        u = [xxhash.xxh64_intdigest(x, 42) for x in w]
        signed = lambda h: h - (1 << 64) if h >> 63 else h
        b = [xxhash.xxh64_intdigest(y, h) for h, y in zip(u, w[1:], strict=False)]
        return [signed(h) % quality.BUCKETS for h in u] + [signed(h) % quality.BUCKETS + quality.BUCKETS for h in b]

    f = [features(t) for _, t in rows]
    raw, target = Counter(x for y in f for x in y), Counter(x for (i, _), y in zip(rows, f, strict=True) if i in good for x in y)
    out = []
    size = lambda c, k: sum(v for x, v in c.items() if x // quality.BUCKETS == k) + quality.BUCKETS
    n, m = [size(raw, k) for k in (0, 1)], [size(target, k) - quality.BUCKETS + quality.PRIOR for k in (0, 1)]
    p = lambda x: (raw[x] + 1) / n[x // quality.BUCKETS]
    ratio = lambda x: round(quality.SCALE * (math.log((target[x] + quality.PRIOR * p(x)) / m[x // quality.BUCKETS]) - math.log(p(x)))) if target else 0
    for (i, t), y in zip(rows, f, strict=True):
        base = brute_base(t)
        failed = base[0] < 50 or 100 * base[4] > 50 * base[0]
        score = sum(map(ratio, y)) / len(y) / quality.SCALE if y else 0.0
        out.append((i, *base, failed, not failed and score >= quality.THRESHOLD))
    return out


def test_quality(spark, rows, docs, empty):
    rng = random.Random(1)
    texts = ["".join(rng.choice(["a", "b ", "\n", " ", "é", "#", "c\t", "\x0b", "\xa0"]) for _ in range(rng.randrange(300))) for _ in range(150)]
    more = rows + [(1000 + k, t) for k, t in enumerate(texts)]
    d = spark.createDataFrame([(i, t, "x", 3) for i, t in more], "doc_id long, text string, w string, n_words int")
    labels = spark.createDataFrame([(i, int(i % 3 > 0), int(i % 5 == 0)) for i in range(60)], "doc_id long, quality int, toxic int")
    good = {i for i in range(60) if i % 3 > 0 and i % 5}
    want = brute_quality(more, good)
    got = [tuple(r)[:8] for r in quality.judge_quality(d, labels).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))
    clash = d.select("doc_id", "text", F.lit(7).alias("q_n_words"), F.lit(8).alias("c1"), F.lit(9).alias("llr"))
    assert {tuple(r)[2:] for r in quality.keep_quality(clash, labels).collect()} == {(7, 8, 9)}
    kept = quality.keep_quality(d, labels)
    assert kept.columns == d.columns and Counter(r.doc_id for r in kept.collect()) == Counter(w[0] for w in want if w[-1])
    assert quality.judge_quality(d, labels.where("false")).where("llr <> 0").count() == 0
    assert quality.judge_quality(empty, labels).count() == 0


def test_toxic_documents_fail(spark):
    rng = random.Random(3)
    vile = [f"vile{k}" for k in range(8)]
    rows = []
    for i in range(200):
        w = [f"n{rng.randrange(40)}" for _ in range(400)]
        if i % 5 == 0:
            for x in rng.sample(vile, 4):
                w[rng.randrange(400)] = x
        rows.append((i, " ".join(w)))
    rows.append((200, " ".join([*(f"n{rng.randrange(40)}" for k in range(400)), vile[0]])))  # one such word alone
    d = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, int(i % 5 == 0 and i < 200)) for i in range(201) if i < 100 or i % 5 > 0 or i == 200], "doc_id long, quality int, toxic int")
    kept = {r.doc_id: r.kept for r in quality.judge_quality(d, labels).collect()}
    assert kept == {i: i % 5 > 0 or i == 200 for i, _ in rows}
    assert {r.doc_id for r in quality.keep_quality(d, labels).collect()} == {i for i in kept if kept[i]}
    assert quality.toxic_words(d, labels.where("toxic = 0")) == []


# ---- near-dedup of the pipeline ----


def brute_similar(rows) -> list[int]:
    """For each row, the least id of its component by exact Jaccard similarity of 5-word shingles."""
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    of = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            if 5 * len(a & sets[j]) >= 4 * len(a | sets[j]) and of[i] != of[j]:
                of = [min(of[i], of[j]) if x in (of[i], of[j]) else x for x in of]
    return [min(rows[k][0] for k in range(len(rows)) if of[k] == c) for c in of]


def test_similar(spark, docs):
    rng = random.Random(11)
    rows = []
    for _ in range(25):
        base = [f"w{rng.randrange(10**6)}" for _ in range(rng.choice([3, 8, 60, 300]))]
        for _ in range(rng.randrange(1, 6)):
            w = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, len(w) // 50])):
                w[rng.randrange(len(w))] = "Edited"
            rows.append(" ".join(w))
    rows += [None, "", " \n", rows[0].upper()]
    rng.shuffle(rows)
    rows = list(enumerate(rows))
    want = {i for (i, _), c in zip(rows, brute_similar(rows), strict=True) if c == i}
    d = spark.createDataFrame([(i, t, "x") for i, t in [*rows, (None, rows[0][1])]], "doc_id long, text string, set string")
    out = jaccard.drop_similar(d)
    assert out.columns == d.columns and sorted(r.doc_id for r in out.collect() if r.doc_id is not None) == sorted(want)
    assert out.where("doc_id is null").count() == 1 and jaccard.drop_similar(d.where("false")).count() == 0
    by_radius = {r.doc_id for r in simhash.drop_near_duplicates(d).collect()} - {None}
    assert by_radius - want, "pairs that a radius of 4 bits leaves apart"


def test_large_clusters(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 4)
    rng = random.Random(12)
    rows = []
    for _ in range(3):  # chains: each text is near the one before it, the ends are not near
        w = [f"w{rng.randrange(10**6)}" for _ in range(200)]
        for k in range(12):
            w = list(w)
            for _ in range(3):
                w[rng.randrange(200)] = f"e{rng.randrange(10**6)}"
            rows.append(" ".join(w))
    rng.shuffle(rows)
    rows = list(enumerate(rows))
    want = {i for (i, _), c in zip(rows, brute_similar(rows), strict=True) if c == i}
    assert 3 <= len(want) < 20
    d = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in jaccard.drop_similar(d).collect()} == want


def test_similar_sets_meet_in_the_forest(spark, monkeypatch):
    """Candidates of near-dedup come from SimHash trees: sets of similarity 0.8 of any size are linked, unlike ones are not, in whole leaves and in blocks."""
    rng = np.random.default_rng(5)
    sets, pairs = [], []
    for n in [4, 8, 12, 16, 40, 100, 400] * 30:
        base = rng.integers(0, 2**63, n + n // 4, dtype=np.uint64)
        pairs.append((len(sets), len(sets) + 1))  # n of n + n / 4: the least similarity that counts
        sets += [np.sort(base[:n]), np.sort(base)]
    leaf, sketch = simhash.wide_leaves(sets, simhash.forest_shape(len(sets)))
    d = spark.createDataFrame([(k, leaf[k].tolist(), sketch[k].view(np.int64).tolist()) for k in range(len(sets))], "set long, leaves array<int>, sketch array<long>")
    for block in (8192, 16):
        monkeypatch.setattr(simhash, "WIDE_BLOCK", block)
        got = {tuple(sorted((r.u, r.v))) for r in simhash.similar_links(d).collect()}
        assert got >= set(pairs) and len(got) < 1.1 * len(pairs)
    used = []
    real = simhash.similar_links
    monkeypatch.setattr(simhash, "similar_links", lambda x: used.append(x.columns) or real(x))
    text = " ".join(f"w{k}" for k in range(100))
    rows = [(1, text), (2, text + " more"), (3, "another text")]
    assert {r.doc_id for r in jaccard.drop_similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == {1, 3}
    assert used == [["set", "leaves", "sketch"]]


def test_near_copies_cost_an_edge_each(spark, monkeypatch):
    """Near copies meet in most trees of the forest; the edges of a group follow its size, not its size by the trees or by the blocks of a leaf, and connect what the links in the leaves connect."""
    rng = np.random.default_rng(7)
    for g, block in ((300, 8192), (1200, 8192), (1200, 128)):
        sets = [rng.integers(0, 2**63, 60, dtype=np.uint64) for _ in range(100)]
        for n in (g, g // 4):  # a large group, and another that is far from it
            base = rng.integers(0, 2**63, 200, dtype=np.uint64)
            for _ in range(n):
                s = base.copy()
                s[rng.choice(200, 8, replace=False)] = rng.integers(0, 2**63, 8, dtype=np.uint64)
                sets.append(s)
        ids = rng.permutation(len(sets))
        leaf, sketch = simhash.wide_leaves([np.sort(s) for s in sets], simhash.forest_shape(len(sets)))
        d = spark.createDataFrame([(int(k), x.tolist(), w.view(np.int64).tolist()) for k, x, w in zip(ids, leaf, sketch, strict=True)], "set long, leaves array<int>, sketch array<long>")
        monkeypatch.setattr(simhash, "WIDE_BLOCK", block)
        got = {tuple(sorted((r.u, r.v))) for r in simhash.similar_links(d).collect() if r.u != r.v}
        assert len(got) < 2 * len(sets)
        near, link = simhash._far(sketch, sketch) <= simhash.WIDE_RADIUS, np.zeros((len(sets), len(sets)), bool)
        for tree in np.array(leaf).T:
            link |= near & (tree[:, None] == tree)
        want, back = np.full(len(sets), -1), np.argsort(ids)
        for seed in range(len(sets)):
            todo = [seed] if want[seed] < 0 else []
            while todo:
                x = todo.pop()
                want[x] = seed
                new = np.flatnonzero(link[x] & (want < 0))
                want[new] = seed
                todo += new.tolist()
        root = simhash.spanned(len(sets), back[np.array(sorted(got))])
        assert root.tolist() == want.tolist() and len(set(want)) == 102


# ---- 8 ----


def brute_substring(rows) -> list[tuple]:
    words, first = [(i, WORD.findall(t or "")) for i, t in rows], {}
    for i, w in words:
        for k in range(len(w) - 12 if i is not None else 0):
            key = tuple(w[k : k + 13])
            first[key] = min(i, first.get(key, i))
    out = []
    for i, w in words:
        g = [0] * len(w)
        for k in range(len(w) - 12 if i is not None else 0):
            if first[tuple(w[k : k + 13])] < i:
                g[k : k + 13] = [1] * 13
        kept = [x for x, y in zip(w, g, strict=True) if not y]
        out.append((i, len(w), len(w) - len(kept), hashlib.sha256(" ".join(kept).encode()).hexdigest(), " ".join(kept)))
    return out


def test_substring(spark, rows, docs, empty):
    want = brute_substring(rows)
    got = substring.duplicate_factors(docs).collect()
    assert sorted(str(tuple(r)[:4]) for r in got) == sorted(str(w[:4]) for w in want) and sum(w[2] for w in want) > 1000
    for r in got:
        covered = set()
        for f in r.factors:
            assert f.length >= 13 and f.ref_doc < r.doc_id
            words = [w for i, t in rows if i == r.doc_id for w in [WORD.findall(t or "")] if len(w) == r.n_words][0]
            assert any(words[f.start : f.start + f.length] == WORD.findall(t or "")[f.ref_start : f.ref_start + f.length] for i, t in rows if i == f.ref_doc)
            covered |= set(range(f.start, f.start + f.length))
        assert len(covered) == r.n_removed
    out = substring.dedup_texts(docs)
    assert out.columns == docs.columns
    texts = [(i, t if not w[2] else w[4]) for (i, t), w in zip(rows, want, strict=True)]
    assert sorted(str((r.doc_id, r.text)) for r in out.collect()) == sorted(map(str, texts))
    assert substring.duplicate_factors(empty).count() == 0


def test_substring_references_and_names(spark):
    a = " ".join(f"a{k}" for k in range(14))
    one = " ".join([*a.split()[:13], "zz", *a.split()[1:]])
    d = spark.createDataFrame([(1, one, "x", 7), (2, a, "y", 8), (None, a, "z", 9)], "doc_id long, text string, kept string, block int")
    found = {r.doc_id: r for r in substring.duplicate_factors(d).collect()}
    assert [tuple(f) for f in found[2].factors] == [(0, 13, 1, 0), (1, 13, 1, 14)]  # no stretch of document 1 holds all 14 words
    assert (found[2].n_removed, found[1].n_removed, found[None].n_removed) == (14, 0, 0)
    out = {r.doc_id: (r.text, r.kept, r.block) for r in substring.dedup_texts(d).collect()}
    assert out == {1: (one, "x", 7), 2: ("", "y", 8), None: (a, "z", 9)}
    with pytest.raises(TypeError, match="whole numbers"):
        substring.duplicate_factors(d.withColumn("doc_id", F.col("doc_id").cast("string")))


def test_word_hashes_in_chunks(monkeypatch):
    monkeypatch.setattr(common, "CHUNK_BYTES", 50)
    rng = random.Random(0)
    texts = ["".join(rng.choice("ab c\n") for _ in range(rng.randrange(400))).encode() for _ in range(30)] + [b"x" * 300 + b" y", b""]
    h, n = common.word_hashes(texts)
    words = [x for t in texts for x in t.split()]
    assert n.tolist() == [len(t.split()) for t in texts] and len(dict(zip(words, h.tolist(), strict=True))) == len(set(h.tolist()))


# ---- 9 ----


def test_lm(spark, rows, docs, empty):
    prior, train, all_ = 50.0, [], []
    for i, t in rows:
        w = [*WORD.findall(ascii_lower(t or "")), "</s>"]
        held = zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
        all_.append((i, held, w))
        if not held:
            train.append(w)
    c = Counter(x for w in train for x in w)
    c2 = Counter(p for w in train for p in zip(["</s>", *w], w, strict=False))
    n, v, n1 = sum(c.values()), len(c), sum(x == 1 for x in c.values())
    p = lambda w: (c[w] or n1) / (n + n1)
    want = {}
    for i, held, w in all_:
        base = sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w)
        score = sum(math.log10((c2[a, b] + prior * p(b)) / (c[a] + prior)) for a, b in zip(["</s>", *w], w, strict=False))
        want.setdefault(i, (held, len(w), sum(c[x] > 0 for x in w), n, round(base, 6), round(score, 6)))
    got = lm.score_documents(docs, prior=prior).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) == want[r.doc_id]
    # Each state's arcs and failure arc sum to one over the seen words and the unseen class.
    for h in ("</s>", "v1"):
        total = sum((c2[h, w] + prior * p(w)) / (c[h] + prior) for w in c) + prior * (n1 / (n + n1)) / (c[h] + prior)
        assert abs(total - 1) < 1e-9
    assert lm.score_documents(empty).count() == 0
    none = lm.score_documents(docs.where("doc_id = 100"), held_out_of=1, held_out=0).first()
    assert (none.held_out, none.n_known, none.train_tokens) == (True, 0, 0)


# ---- very long texts ----


def test_very_long_texts(spark):
    """One text of 3 MB, and one without a space, among short ones."""
    rng = random.Random(8)
    long = " ".join(f"w{rng.randrange(5000)}" for _ in range(500_000))
    rows = [(1, long), (2, "x" * 2_000_000), (3, long), (4, "short text")]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    fp = {r.doc_id: (int(r.fingerprint, 16), r.component_id) for r in simhash.near_duplicates(d).collect()}
    assert fp[1] == fp[3] == (brute_fingerprint(long), 1) and fp[2][0] == brute_fingerprint(rows[1][1])
    from tokenizers import Tokenizer

    for name, end in (("byte_bpe_50k.json", 2), ("word_bpe_49k.json", 1)):
        path = tokenizer_path(name)
        lib = Tokenizer.from_file(path)
        n = {i: len(lib.encode(t, add_special_tokens=False).ids) for i, t in rows if i != 2}
        counted = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(d, path, common.fresh_path(spark, "cache")).collect()}
        assert {i: counted[i] for i in n} == n
        packed: dict[int, int] = Counter()
        for r in packing.pack_documents(d, path, end_id=end).collect():
            packed[r.doc_id] += r.length
        assert {i: packed[i] for i in n} == {i: k + 1 for i, k in n.items()}
        kept = {r.doc_id: r.n_tokens for r in records.token_records(d, path, common.fresh_path(spark, "records"), end_id=end).collect()}
        assert {i: kept[i] for i in n} == {i: k + 1 for i, k in n.items()}
    cut_ = {r.doc_id: (r.n_words, r.n_removed) for r in substring.duplicate_factors(d).select("doc_id", "n_words", "n_removed").collect()}
    assert cut_ == {1: (500_000, 0), 2: (1, 0), 3: (500_000, 500_000), 4: (2, 0)}
    assert {r.doc_id: r.n_tokens for r in lm.score_documents(d).collect()} == {1: 500_001, 2: 2, 3: 500_001, 4: 3}
    labels = spark.createDataFrame([(4, 1, 0)], "doc_id long, quality int, toxic int")
    assert {r.doc_id: (r.n_words, r.word_chars) for r in quality.judge_quality(d, labels).collect()} == {i: (len(t.split()), sum(map(len, t.split()))) for i, t in rows}
    assert Counter(r.size for r in sharding.shard_documents(d).collect()) == Counter(len(t) + 1 for _, t in rows)


def test_components_with_a_hub(spark):
    from lemmaweave.llm.graph import connected_components

    edges = [(0, k) for k in range(1, 4000)] + [(5000 + k, 5001 + k) for k in range(40)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {k: 0 for k in range(4000)} | {5000 + k: 5000 for k in range(41)}


def thue_morse(n: int) -> tuple[str, str]:
    """n letters, and their complement: alike to any polynomial modulo 2**64 with an odd base from n = 1,024 on."""
    bits = [k.bit_count() & 1 for k in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def test_words_that_a_polynomial_confuses(spark):
    a, b = thue_morse(1024)
    same = " ".join(f"s{k}" for k in range(12))
    d = spark.createDataFrame([(1, f"{same} {a}"), (2, f"{same} {b}"), (3, f"{same} {b}")], "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in substring.duplicate_factors(d).collect()} == {1: 0, 2: 0, 3: 13}
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    train = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 != 2)
    rows = [(held, f"x {a}"), (train, f"x {b}")]
    got = {r.doc_id: r.n_known for r in lm.score_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {held: 2, train: 3}
    texts = [f"{same} {x} {same}".encode() for x in (a, b)]
    one, two = jaccard.shingle_sets(texts)
    assert len(np.intersect1d(one, two)) == 8 + 0


def test_keys_that_share_a_half():
    """Keys whose first halves are equal are ordered and found by their second."""
    h, g = np.array([5, 5, 5, 2, 5], np.uint64), np.array([9, 1, 9, 3, 4], np.uint64)
    order = common.order_of(h, g)
    assert order.tolist() == [3, 1, 4, 0, 2] and common.leads(h[order], g[order]).tolist() == [True, True, True, True, False]
    th, tg = np.array([2, 5, 5, 5], np.uint64), np.array([3, 1, 4, 9], np.uint64)
    assert common.find(th, tg, np.array([5, 5, 2, 2, 7], np.uint64), np.array([9, 2, 3, 4, 1], np.uint64)).tolist() == [3, -1, 0, -1, -1]
    values = np.arange(40, dtype=np.uint64)
    assert all(len(set(common.rolling(values, n).tolist())) == 41 - n for n in range(1, 14))
    for n in (1, 2, 5, 13):  # a run's hash is its own, wherever it stands
        assert common.rolling(values[7 : 7 + n], n)[0] == common.rolling(values, n)[7]
