"""Sharding, packing, token counts, TIFF, URL filter: exact results against plain Python."""

import hashlib
import os
import random
import zlib

import numpy as np
import pytest

from cairnline.llm import packing, queries, sharding, tiff, token_count, url_filter
from conftest import prose  # noqa: F401  (tests/llm/conftest.py)

public_tokenizers = pytest.importorskip("public_tokenizers")


def test_sharding(make, odd, empty):
    docs = make([(n, f"t{n % 7}", f"s{0 if n % 3 else n % 5}") for n in range(997)])
    rows = sharding.interleave(docs, 24, buckets=16, strips=8).collect()
    sizes = np.bincount([r["shard"] for r in rows], minlength=24)
    assert len(rows) == 997 and sizes.max() - sizes.min() <= 1
    for s in range(24):
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sizes[s]))
    for source in ("s0", "s3"):
        each = np.bincount([r["shard"] for r in rows if r["source"] == source], minlength=24)
        assert each.max() - each.min() <= 3
    assert all(r["text_crc32"] == zlib.crc32(f"t{r['doc_id'] % 7}".encode()) and r["size"] == 10 for r in rows)
    again = {(r["doc_id"], r["shard"], r["slot"]) for r in sharding.interleave(docs.repartition(5), 24, buckets=16, strips=8).collect()}
    assert again == {(r["doc_id"], r["shard"], r["slot"]) for r in rows}
    got = sharding.interleave(odd, 3).collect()
    assert len(got) == odd.count() and [r["size"] for r in got if r["doc_id"] == 2] == [8]
    assert sharding.interleave(empty, 3).count() == 0
    with pytest.raises(ValueError):
        sharding.interleave(empty, 0)


def test_sharding_of_many_small_sources(make):
    """One large source and many of one row: every shard gets its share of both."""
    docs = make([(n, f"t{n}", "large") for n in range(1200)] + [(5000 + n, "x", f"one{n}") for n in range(1200)] + [(None, f"n{n}", "nameless") for n in range(240)])
    rows = sharding.interleave(docs, 24).collect()
    count = lambda keep: np.bincount([r["shard"] for r in rows if keep(r["source"])], minlength=24)
    # a shard is 110 rows in a row of the order, so its share of a source is right within a few rows
    assert abs(count(lambda s: s == "large") - 50).max() <= 15 and abs(count(lambda s: s.startswith("one")) - 50).max() <= 15
    assert abs(count(lambda s: s == "nameless") - 10).max() <= 4
    sizes = count(lambda s: True)
    assert sizes.max() - sizes.min() <= 1

    def rank(r):  # the same ranking in plain Python
        return hashlib.md5(":".join(["interleave", *([str(r["doc_id"])] if r["doc_id"] is not None else []), str(r["text_crc32"]), str(r["size"])]).encode()).hexdigest()

    by_source = {}
    for r in rows:
        by_source.setdefault(r["source"], []).append(r)
    order = []
    for source, each in by_source.items():
        u = int(hashlib.md5(f"interleave:{source}".encode()).hexdigest()[:8], 16) / 2**32
        order += [((n + 1 - u) / len(each), source, n, r) for n, r in enumerate(sorted(each, key=rank))]
    order.sort(key=lambda o: o[:3])
    for at, (*_, r) in enumerate(order):
        shard = at * 24 // len(order)
        assert r["shard"] == shard and r["slot"] == at - -(-shard * len(order) // 24)


def test_plan_packs_well():
    rng = random.Random(3)
    counts = {}
    for _ in range(5000):
        n = min(2048, int(rng.expovariate(1 / 400)) + 1)
        counts[n] = counts.get(n, 0) + 1
    runs = packing.plan(counts, 2048)
    bins, used = {}, {}
    for n, rank, count, first, offset in zip(*(runs[k] for k in ("length", "rank", "count", "bin", "offset")), strict=True):
        used.setdefault(n, []).append((rank, count))
        for k in range(count):
            bins.setdefault(first + k, []).append((offset, n))
    for n, parts in used.items():
        assert sorted(parts)[0][0] == 0 and sum(c for _, c in parts) == counts[n]
    for items in bins.values():
        at = 0
        for offset, n in sorted(items):
            assert offset == at
            at += n
        assert at <= 2048 and sum(n * 3 > 2048 for _, n in items) <= 2
    assert len(bins) <= 1.01 * -(-sum(n * c for n, c in counts.items()) // 2048) + 1
    assert len(packing.plan({}, 2048)["length"]) == 0


def test_packing(make, odd, empty):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for docs in (odd, empty, make([(n, prose(n * 3)) for n in range(40)])):
        texts = sorted((r["doc_id"] or -1, r["text"] or "") for r in docs.select("doc_id", "text").collect())
        rows = packing.pack(docs, queries.byte_tokenizer(), buckets=4).collect()
        want = []
        for i, t in texts:
            ids = np.array([*tok.encode(t, add_special_tokens=False).ids, 0], "<u4")
            head = len(ids) % 2048 or 2048
            cuts = [0, *range(min(head, len(ids)), len(ids) + 1, 2048)]
            want += [(i, k, a, z - a, zlib.crc32(ids[a:z].tobytes())) for k, (a, z) in enumerate(zip(cuts, cuts[1:], strict=False))]
        assert sorted((r["doc_id"] or -1, r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == sorted(want)
        at = {}
        for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
            assert r["offset"] == at.get(r["sequence_id"], 0)
            at[r["sequence_id"]] = r["offset"] + r["length"]
        assert all(v <= 2048 for v in at.values())


@pytest.mark.parametrize("seed", range(3))
def test_token_counts_agree(seed):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    rng = random.Random(seed)
    parts = ["▁", " ", "  ", "a", "b", "th", "e", "\n", "\t", "é", "日", "😀", "0", "==", "//", "\x00", " the", "'s", "e" * 5, " " * 20, "-" * 9, "tion", "Inter", "national"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 80))) for _ in range(400)]
    texts += ["", "a" * 4000, " " * 999, "".join(rng.choice("abcdef0123456789") for _ in range(7000)), "日本" * 2500]
    assert token_count.count_texts(texts, path).tolist() == [len(x) for x in sp.encode(texts)]


def test_token_maps_compose():
    """Short chunks cut anywhere, without run-up: maps are evaluated at many states and composed."""
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    rng = random.Random(4)
    texts = ["".join(rng.choice(a) for _ in range(600)) for a in ("ab", "thequickbrown", "x\u00e9\u65e5\u672c ", "aaaa", "  0123") for _ in range(4)]
    want = [len(x) for x in sentencepiece.SentencePieceProcessor(model_file=path).encode(texts)]
    marked = [chr(0x2581) + t.replace(" ", chr(0x2581)) for t in texts]
    for run_up in (0, 1, 9):
        assert token_count.transducer(path).count(marked, near=3, far=7, run_up=run_up).tolist() == want


def test_token_count_query(odd, empty):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    want = sorted((r["doc_id"] or -1, len((r["text"] or "").encode()), len(sp.encode(r["text"] or ""))) for r in odd.select("doc_id", "text").collect())
    got = token_count.token_counts(odd, path).collect()
    assert sorted((r["doc_id"] or -1, r["n_bytes"], r["n_tokens"]) for r in got) == want
    assert all(r["over_limit"] == (r["n_tokens"] > 4096) for r in got) and token_count.token_counts(empty, path).count() == 0


def test_small_table_is_begun_anew():
    v = token_count.MergeVocabulary({"ab": -1.0, "abc": -2.0, "bc": -3.0, "a": -9.0, "b": -9.1, "c": -9.2, "▁": -9.3, "▁a": -4.0})
    t = token_count.Transducer(v, most=3)
    for _ in range(3):
        assert t.count(["▁abcab", "", "▁cab▁abc", "xé"]).tolist() == [len(v.encode("▁abcab")), 0, len(v.encode("▁cab")) + len(v.encode("▁abc")), 3]


@pytest.mark.parametrize("codec", [tiff.NONE, tiff.LZW, tiff.DEFLATE, tiff.PACKBITS])
@pytest.mark.parametrize("predictor, tile", [(1, 0), (2, 0), (2, 16), (1, 32)])
def test_tiff_round_trip(codec, predictor, tile):
    rng = np.random.default_rng(1)
    images = [rng.integers(0, 255, (50, 37, 3), np.uint8), np.tile(np.arange(64, dtype=np.uint8)[None, :, None], (130, 1, 1))]
    found = list(tiff.read_pages(tiff.write(images, codec, predictor, tile)))
    assert [p.pixels for p in found] == [i.tobytes() for i in images] and [p.number for p in found] == [0, 1]


def test_codecs():
    for n in (0, 1, 2, 127, 128, 129, 300, 9000, 60_000):
        for data in (os.urandom(n), b"ab" * (n // 2), b"z" * n):
            assert tiff.lzw_decode(tiff.lzw_encode(data), len(data)) == data
            assert tiff.unpack_bits(tiff.pack_bits(data), len(data)) == data


def test_big_endian_and_bad_files(spark):
    good = tiff.write([np.zeros((4, 4, 1), np.uint8)])
    files = [(1, bytearray(good)), (2, None), (3, bytearray(b"")), (4, bytearray(b"II*\0")), (5, bytearray(b"PNG...........")), (6, bytearray(good[:-30]))]
    rows = tiff.pages(spark.createDataFrame(files, "file_id long, content binary")).collect()
    assert {r["file_id"]: r["error"] is None for r in rows} == {1: True, 4: False, 5: False, 6: False}
    entry = lambda tag, v: tag.to_bytes(2, "big") + b"\0\4\0\0\0\1" + v.to_bytes(4, "big")
    bits = (258).to_bytes(2, "big") + b"\0\3\0\0\0\1\0\x08\0\0"
    big = b"MM\0*\0\0\0\x08\0\6" + entry(256, 2) + entry(257, 1) + bits + entry(273, 86) + entry(278, 1) + entry(279, 2) + b"\0\0\0\0\7\x09"
    assert next(tiff.read_pages(big)).pixels == b"\7\x09"


def test_tiff_query(odd, empty):
    rows = tiff.digests(odd).collect()
    want = {}
    for r in odd.select("doc_id", "text").collect():
        t = (r["text"] or "").encode()
        p = t.ljust(max(192, -(-len(t) // 192) * 192), b" ")
        want.setdefault(r["doc_id"], set()).add((len(t), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:])))
    for r in rows:
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) in want[r["doc_id"]]
    assert len(rows) == odd.count() and tiff.digests(empty).count() == 0


def test_urls(spark):
    urls = [
        "http://A.Example.com/en/1?x", "https://example.com/en/7x", "com/en/1", None, "http://com/en/", "http://xcom/en/2", "http://a.net?q=/de/1", "http://b.example.net/de/8/1#x",
        "http://b.net/de/8", "http://org/es/9", "http://h.org/fr/1", "", "http://u.org", "http://a.com/EN/1",
    ]
    df = spark.createDataFrame([(n, u, "p", "k") for n, u in enumerate(urls)], "page_id long, url string, html string, final string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge(df, queries.URL_RULES).collect()}
    assert [got[n][2] for n in range(14)] == ["com/en/", "example.com/en/7", None, None, "com/en/", None, None, "example.net/de/8", "net/de/", "org/es/", None, None, None, None]
    assert got[0][:2] == ("a.example.com", "/en/1") and got[6][:2] == ("a.net", "") and got[3][:2] == ("", "") == got[2][:2]
    assert {got[n][3] for n in range(14)} <= {"allow", "block"} and got[7][3] == "block" and got[8][3] == "allow"
    assert url_filter.judge(df.limit(0), queries.URL_RULES).count() == 0


def test_url_templates(spark):
    rows = [(n, f"http://h.com/bad/{n}") for n in range(40)] + [(100 + n, f"http://h.com/good/{n}") for n in range(40)]
    rules = [(f"h.com/bad/{n}", "block") for n in range(10)] + [(f"h.com/good/{n}", "allow") for n in range(10)]
    got = {r["page_id"]: r for r in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string"), rules).collect()}
    assert got[39]["verdict"] == "block" and got[139]["verdict"] == "allow" and got[39]["rule"] != got[139]["template"]
    slugs = [(n, f"http://s.com/{'abcdefghijklmnopqrst'[n]}word/x") for n in range(20)]
    assert {r["template"] for r in url_filter.judge(spark.createDataFrame(slugs, "page_id long, url string"), rules).collect()} == {"/*/x"}


def test_url_branches(spark):
    def judged(urls, rules):
        df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
        return {r["page_id"]: (r["verdict"], r["template"], r["purity"]) for r in url_filter.judge(df, rules).collect()}

    # /fr has no evidence: it takes the whole host's, here all blocked (20 of 20), so (20 + 1) / 24
    got = judged([f"http://h.com/en/{n}" for n in range(20)] + ["http://h.com/fr/1", "http://h.com/fr/a/b/c", "http://g.com/fr/1"], [("h.com/en/", "block")])
    assert got[20] == ("block", "/fr/*", 0.875) and got[21] == ("block", "/fr/a/b/c", 0.875) and got[22] == ("allow", "/fr/*", 0.25)
    # evidence two levels up: /x is blocked against the host's rest, and its branches without evidence follow it
    urls = [f"http://h.com/x/a/p{n}/end" for n in "abcdefghij"] + [f"http://h.com/y/b/q{n}/end" for n in "abcdefghijklmnopqrstuvwxyz"] + ["http://h.com/x/c/d", "http://h.com/z/c/d"]
    got = judged(urls, [("h.com/x/a/", "block"), ("h.com/y/", "allow")])
    assert got[36] == ("block", "/x/c/d", round(11 / 14, 6)) and got[37] == ("allow", "/z/c/d", round(11 / 40, 6))
    # the part of a path beyond the fourth segment counts
    deep = [f"http://d.com/a/b/c/d/{'bad' if n % 2 else 'good'}/w{'abcdefghijklmnopqrst'[n]}" for n in range(20)]
    deep += ["http://d.com/a/b/c/d/bad/new/one", "http://d.com/a/b/c/d/good/new/one"]
    got = judged(deep, [(f"d.com/a/b/c/d/{k}/w", v) for k, v in (("bad", "block"), ("good", "allow"))])
    assert got[20][0] == "block" and got[21][0] == "allow"
