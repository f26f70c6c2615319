"""Each operator against brute force, and on edge cases."""

import base64
import collections
import hashlib
import random
import re
import struct
import zlib

import numpy as np
import pytest
from helpers import normal, oracle
from pyspark.sql import functions as F

import corpus_pipeline
from blockwright.llm import _graph, _text, decontam, jaccard_join, langid, piece_codec, quality_rules, queries, sharding, suffix_dedup, toxicity, urlfilter, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


# 1 ----------------------------------------------------------------------------


def test_sharding(spark, sf):
    rows = queries.op1_sharding(spark, sf).collect()
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert len(rows) == len(docs) and {r["law"] for r in rows} == {"key"}
    slots = collections.defaultdict(list)
    for r in rows:
        data = (docs[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"]) == (len(data) + 1, zlib.crc32(data))
        assert r["grown_shard"] in (r["shard"], 8)
        slots[r["shard"]].append(r["slot"])
    assert set(slots) <= set(range(8)) and all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_sharding_weights_and_growth(spark):
    ids = spark.range(20_000).withColumnRenamed("id", "doc_id")
    heavy = [sharding.Shard(s.number, s.region, s.rack, 3.0 if s.number == 2 else 1.0) for s in sharding.topology(8)]
    count = {r["shard"]: r["count"] for r in sharding.assign(ids, "doc_id", heavy).groupBy("shard").count().collect()}
    assert 0.27 < count[2] / 20_000 < 0.33 and 0.08 < count[7] / 20_000 < 0.12
    # a weight that rises in region r0 moves rows inside r0 or into it, never between others
    moved = sharding.assign(ids, "doc_id", sharding.topology(8), heavy).where("shard <> grown_shard")
    assert moved.count() > 0 and moved.where("grown_shard >= 4").count() == 0
    for n in range(1, 13):
        odd = sharding.assign(ids, "doc_id", sharding.topology(n), sharding.topology(n + 1)).where(f"shard <> grown_shard AND grown_shard <> {n}")
        assert odd.count() == 0
    with pytest.raises(ValueError):
        sharding.topology(0)


def test_sharding_edges(edge, none):
    rows = sharding.shard_documents(edge).collect()
    assert len(rows) == edge.count() and sharding.shard_documents(none).count() == 0
    assert [r["size"] for r in rows if r["doc_id"] == 1] == [1] and [r["text_crc32"] for r in rows if r["doc_id"] == 1] == [0]


# 2 ----------------------------------------------------------------------------


def expected_records(rows):
    last = {}
    for i, h in rows:
        last[h or ""] = max(last.get(h or "", i), i)
    out = []
    for i, h in rows:
        data, m = (h or "").encode(), last[h or ""]
        out.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if m == i else "revisit", None if m == i else m))
    return sorted(out, key=repr)


INNER = "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
PAGES = [(1, "u", "x"), (2, "u", "x"), (3, None, None), (4, "a\nb", ""), (5, "u", INNER), (6, "u", "WARC/1.1\r\n" + INNER * 3 + "WARC/1.1\r\nWARC-Type: a\r\nContent-Length: 99999\r\n\r\n"), (7, "u", "é\r\n\r\n\r\n"), (8, "u", INNER)]
PAGE = "page_id long, url string, html string"


def test_warc(spark, sf):
    pages = [(r["page_id"], r["html"]) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    assert sorted(map(tuple, queries.op2_warc(spark, sf).collect()), key=repr) == expected_records(pages)


def test_warc_edges(spark):
    rows = PAGES + [(9, "u", "y" * 300_000)]
    got = warc.round_trip(spark.createDataFrame(rows, PAGE).withColumn("payload_digest", F.lit("mine")).withColumn("file", F.lit("mine")))
    assert sorted(map(tuple, got.collect()), key=repr) == expected_records([(i, h) for i, _, h in rows])
    assert warc.round_trip(spark.createDataFrame([], PAGE)).count() == 0


def test_warc_chains_over_splits(spark, tmp_path):
    """Splits of every size: borders inside headers, payloads and nested magics,
    and records that cover many splits."""
    long = "".join(f"{INNER}{i}" for i in range(40))
    rows = PAGES + [(100, "u", long), (101, "u", long), (102, "u", "z" * 5000 + INNER)] + [(i, "u", "y" * (i % 700) + str(i)) for i in range(10, 60)]
    warc.write_archives(spark.createDataFrame(rows, PAGE).coalesce(1), f"{tmp_path}/a")
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for split in ("700", "3000", "11000"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", split)
            got = warc.read_archives(spark, f"{tmp_path}/a").collect()
            assert sorted(map(tuple, got), key=repr) == expected_records([(i, h) for i, _, h in rows])
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)


def test_warc_compressed_and_truncated(spark, tmp_path):
    warc.write_archives(spark.createDataFrame(PAGES, PAGE).coalesce(1), f"{tmp_path}/a", compression="gzip")
    assert sorted(map(tuple, warc.read_archives(spark, f"{tmp_path}/a").collect()), key=repr) == expected_records([(i, h) for i, _, h in PAGES])
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "x").write_bytes(warc._record(1, "u", 9, "D", zlib.compress(b"123456789"), None)[:-3])
    with pytest.raises(Exception, match="ends inside"):
        warc.read_archives(spark, f"{tmp_path}/b").collect()


# 3 ----------------------------------------------------------------------------


def brute_repeats(rows, length=100):
    seen, out = set(), {}
    for d, t in sorted(rows, key=lambda r: r[0]):
        b = (t or "").encode()
        covered = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if b[i : i + length] in seen:
                covered[i : i + length] = b"\1" * length
            else:
                seen.add(b[i : i + length])
        kept = bytes(x for x, c in zip(b, covered, strict=True) if not c)
        out[d] = (d, len(b), sum(covered), sum(1 for i in range(len(b)) if covered[i] and (i == 0 or not covered[i - 1])), hashlib.sha256(kept).hexdigest())
    return out


def test_suffix_dedup_documents(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = brute_repeats(rows)
    assert all(tuple(r) == want[r["doc_id"]] for r in queries.op3_suffix_dedup(spark, sf).collect())
    assert sum(w[2] for w in want.values()) > 0


def test_suffix_dedup_small_alphabet(spark):
    r = random.Random(1)
    base = "".join(r.choice("abcd é") for _ in range(3000))
    rows = [(1, None), (2, ""), (3, "a" * 1000), (4, "ab" * 400), (5, "a" * 99), (6, "a" * 100)]
    for i in range(7, 60):
        s, n = r.randrange(2800), r.randrange(90, 700)
        x = base[s : s + n] + (base[: r.randrange(150)] if r.random() < 0.5 else "")
        k = r.randrange(len(x))
        rows.append((i, x[:k] + "Z" + x[k:] if r.random() < 0.3 else x))
    want = brute_repeats(rows)
    got = suffix_dedup.digests(spark.createDataFrame(rows, "doc_id long, text string").repartition(7)).collect()
    assert len(got) == len(rows) and all(tuple(g) == want[g["doc_id"]] for g in got)


def test_suffix_dedup_edges(edge, none):
    got = suffix_dedup.digests(edge).collect()
    assert len(got) == edge.count() and suffix_dedup.digests(none).count() == 0
    by = {r["doc_id"]: r for r in got}
    assert by[7]["n_removed"] == by[7]["n_bytes"] - 5 and by[8]["n_removed"] == by[8]["n_bytes"] - 1 and by[1]["n_bytes"] == 0
    kept = suffix_dedup.remove_repeats(edge)
    assert kept.dtypes == edge.dtypes and {r["doc_id"]: r["text"] for r in kept.collect()}[7] == "word "


def test_suffix_dedup_repeated_rows_in_different_batches(spark):
    r = random.Random(2)
    x, y, z = ("".join(r.choice("abcdefgh") for _ in range(n)) for n in (400, 300, 250))
    rows = [(1, x), (2, y + z), (3, z + x[:150]), (4, "short")]
    want = brute_repeats(rows)
    docs = spark.createDataFrame([*rows, (1, x), (2, y + z), (2, y + z), (3, z + x[:150])], "doc_id long, text string")
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    for batch in ("1", size):  # every row a batch of its own; all together
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        try:
            got = suffix_dedup.digests(docs.repartition(5)).collect()
        finally:
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        assert len(got) == 8 and all(tuple(g) == want[g["doc_id"]] for g in got)
    assert want[1][2] == want[2][2] == 0 and want[3][2] == 400


def test_long_texts_are_cut_into_pieces(monkeypatch):
    r = random.Random(8)
    text = "".join(r.choice("abcd") for _ in range(20_000)).encode()
    text = text + text[3000:9000] + b"z" * 500
    whole = list(suffix_dedup.anchors([text], 100))
    for piece in (900, 1000, 4096):
        monkeypatch.setattr(suffix_dedup, "PIECE", piece)
        for a, b in zip(whole, suffix_dedup.anchors([text], 100), strict=True):
            assert a[0] == b[0] and all((x == y).all() for x, y in zip(a[1:], b[1:], strict=True))


@pytest.mark.parametrize("direct", [1024, 1, 7])
@pytest.mark.parametrize("size", [21, 8, 3, 40])
def test_multikey_order(monkeypatch, direct, size):
    monkeypatch.setattr(suffix_dedup, "DIRECT", direct)
    rng = np.random.default_rng(0)
    data = rng.integers(97, 100, 400).astype(np.uint8)
    padded = np.concatenate((data, np.zeros(64, np.uint8)))
    starts = np.arange(350)
    for group in (None, rng.integers(0, 5, 350)):
        order, label = suffix_dedup.multikey_order(padded, starts, size, group)
        found = [(0 if group is None else group[k], padded[k : k + size].tobytes()) for k in order]
        assert found == sorted(found) and sorted(order) == list(range(350))
        assert all((a == b) == (x == y) for a, b, x, y in zip(found, found[1:], label, label[1:], strict=False))


# 4 ----------------------------------------------------------------------------


def test_language(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.op4_language(spark, sf).collect()
    assert len(rows) == len(truth)
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) / len(held) > 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_code_lengths_follow_the_trees():
    """The tables give what walking the context trees symbol by symbol gives."""
    texts = {"x": [b"abracadabra", b"cab"], "y": [b"xyzzy xyz"]}
    trees = langid.Trees(texts)
    a = trees.size

    def walk(own, context, symbol):
        counts = [collections.defaultdict(collections.Counter) for _ in range(4)]
        for t in own:
            s = trees.symbol[np.frombuffer(trees.pad + t, dtype=np.uint8)].tolist()
            for i in range(3, len(s)):
                for k in range(4):
                    counts[k][tuple(s[i - k : i])][s[i]] += 1

        def p(k):
            if k < 0:
                return [1 / a] * a
            low, c = p(k - 1), counts[k][tuple(context[3 - k :])]
            if not c:
                return low
            n, q = sum(c.values()), len(c)
            rest = sum(low[x] for x in range(a) if x not in c)
            if rest <= 1e-300:
                return [c[x] / n for x in range(a)]
            return [c[x] / (n + q) if x in c else q / (n + q) * low[x] / rest for x in range(a)]

        return -np.log2(p(3)[symbol])

    for t in (b"abra", b"zzz cab!", b"", b"q"):
        s = trees.symbol[np.frombuffer(trees.pad + t, dtype=np.uint8)].tolist()
        want = [sum(walk(texts[lang], s[i - 3 : i], s[i]) for i in range(3, len(s))) for lang in ("x", "y")]
        assert trees.bits([t])[0] == pytest.approx(want, rel=1e-4)


def test_rare_bytes_are_told_apart():
    """Two scripts whose bytes are rarer than 80 others cost what they should."""
    common = "".join(map(chr, [*range(32, 65), *range(91, 127), *range(0x3B1, 0x3C0)])).encode() * 20
    trees = langid.Trees({"x": [common + "\u10d0 \u10d0\u10d0".encode()], "y": [common + "\u13a0 \u13a0\u13a0".encode()]})
    x, y = trees.bits(["\u10d0\u10d0 \u10d0".encode(), "\u13a0\u13a0 \u13a0".encode()])
    assert x[0] < x[1] - 5 and y[1] < y[0] - 5


def test_rows_that_repeat_are_sampled_once(spark):
    one = next(i for i in range(9) if zlib.crc32(str(i).encode()) % 3 != 1)
    rows = [(one, f"some text {i % 3}", "x") for i in range(900)] + [(i, f"another text {i}", "y") for i in range(100, 160)]
    found = langid.sample(spark.createDataFrame(rows, "doc_id long, text string, lang string"), 900)
    assert len(found["x"]) == 3 and len(found["y"]) > 30


def test_language_edges(edge, none):
    by = {r["doc_id"]: r for r in langid.predict(edge).collect()}
    assert by[1]["lang_pred"] == by[2]["lang_pred"] == by[3]["lang_pred"] == by[9]["lang_pred"] == "und"
    assert langid.predict(none).count() == 0


# 5 ----------------------------------------------------------------------------


def test_urls(spark, sf):
    got = queries.op5_url_filters(spark, sf).toPandas()
    assert normal(got) == normal(oracle(queries.ORACLE_SQL["op5_url_filters"], sf))


def test_url_edges(spark):
    urls = [None, "", "no scheme", "http://", "http://EXAMPLE.org/es/x", "http://a.b.example.org/en/12?q#f", "http://example.org:80/es/", "http://myexample.org/es/", "x://org", "http://a.com/de/", "http://a.com/de", "http://é.com/fr/é", "http://a.org?x://b", "x://b.org/\nes"]
    pages = spark.createDataFrame(list(enumerate(urls)) + [(4, urls[4])], "page_id long, url string").withColumn("verdict", F.lit("mine")).withColumn("_key", F.lit("mine"))
    rules = spark.createDataFrame([*queries.URL_RULES, ("b.example.org", "/", "allow"), (None, "/", "block"), ("org", "/", "allow")], "host string, path string, verdict string")

    def one(url):
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = lower(host)
        fits = [(len(h + p), len(h), h + p, v) for h, p, v in [*queries.URL_RULES, ("b.example.org", "/", "allow")] if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return (host, path, *((max(fits)[2], max(fits)[3]) if fits else (None, "allow")))

    for ranges in (1, 5, 40):
        got = sorted(tuple(r) for r in urlfilter.judge(pages, rules, ranges).collect())
        assert got == sorted((i, *one(u)) for i, u in [*enumerate(urls), (4, urls[4])])
    assert urlfilter.judge(pages.where("page_id < 0"), rules).count() == 0
    assert {r["verdict"] for r in urlfilter.judge(pages, rules.where("false")).collect()} == {"allow"}


# 6 ----------------------------------------------------------------------------


@pytest.fixture(scope="session")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=queries.tokenizer_path())


def test_pieces(spark, sf, documents, library):
    text = {r["doc_id"]: r["text"] for r in documents.collect()}
    for r in queries.op6_sentencepiece(spark, sf).collect():
        ids = library.encode(text[r["doc_id"]] or "", add_bos=True, add_eos=True)
        packed = struct.pack(f"<{len(ids)}I", *ids)
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(packed).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids).encode()).hexdigest()


TEXTS = ["", " ", "  a  b ", "héllo wörld\n\n x", "日本語 ▁x ▁▁ y", "a\tb\x00c \U0001f600", "▁", "\n", " \n ", "a ▁b", "x" * 5000, "</s> <s> <0x0A>"]


@pytest.mark.parametrize("text", TEXTS)
def test_piece_spans(library, text):
    codec = piece_codec.Codec(piece_codec.read_model(queries.tokenizer_path()))
    ids = library.encode(text, add_bos=True, add_eos=True)
    assert codec.encode(text) == struct.pack(f"<{len(ids)}I", *ids)
    spans = codec.spans(text)
    assert [s[0] for s in spans] == ids[1:-1]
    data, at = text.encode(), 0
    for _, first, end in spans:  # in order, gapless
        assert first == at and end >= first
        at = end
    assert at == len(data)


@pytest.mark.parametrize("text", TEXTS)
def test_normalising_all_bytes_at_once_is_the_walk(library, text):
    codec = piece_codec.Codec(piece_codec.read_model(queries.tokenizer_path()))
    for codec.prefix in (True, False):
        for codec.escape in (True, False):
            normal, source = codec.normalise(text.encode())
            assert (normal, source.tolist()) == codec._walk(text.encode())


def test_query_and_stage_carry_spans(spark, library):
    rows = list(enumerate([*TEXTS, "a b " * 300, None]))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in corpus_pipeline.encode(spark, docs, "").collect()}
    digests = {r["doc_id"]: r["spans_sha256"] for r in piece_codec.encode_digests(docs, queries.tokenizer_path()).collect()}
    for i, text in rows:
        found = library.encode(text or "", return_type="proto").pieces  # with the library's own offsets
        spans = np.frombuffer(got[i]["spans"], dtype="<i4").reshape(-1, 2)
        assert spans.shape[0] == got[i]["n_tokens"] - 2 == len(found)
        # the library gives a character's bytes to the last of its byte pieces
        assert all(library.is_byte(p.id) or s == [p.begin, p.end] for s, p in zip(spans.tolist(), found, strict=True))
        assert got[i]["spans_sha256"] == digests[i] == hashlib.sha256(got[i]["spans"]).hexdigest()


def test_character_map():
    """Longest keys win, and every output byte knows its source."""
    # a double array for the keys "a" -> "X" and "ab" -> "YZ"
    units = [0] * 1024

    def unit(offset, label, leaf):
        return offset << 10 | leaf << 8 | label

    strings = b"X\0YZ\0"
    units[0] = unit(1, 0, 0)
    root = 1
    na = root ^ ord("a")
    units[na] = unit(na ^ 256, ord("a"), 1)
    base_a = 256
    units[base_a] = 0x80000000 | 0
    nb = base_a ^ ord("b")
    units[nb] = unit(nb ^ 512, ord("b"), 1)
    units[512] = 0x80000000 | 2
    table = struct.pack(f"<{len(units)}I", *units)
    m = piece_codec.CharacterMap(struct.pack("<I", len(table)) + table + strings)
    assert m.longest(b"abc", 0) == (2, b"YZ") and m.longest(b"ac", 0) == (1, b"X") and m.longest(b"c", 0) is None


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nmt_nfkc_cf", "nfkc", "identity"])
@pytest.mark.parametrize("trim", [True, False])
def test_models_with_a_character_map(rule, trim):
    """The walk through the compiled map gives what the library's normaliser gives."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    proto, normaliser = sentencepiece_model_pb2.ModelProto(), sentencepiece_model_pb2.ModelProto()
    proto.ParseFromString(piece_codec.read_model(queries.tokenizer_path()))
    normaliser.ParseFromString(sentencepiece.SentencePieceNormalizer(rule_name=rule).serialized_model_proto())
    proto.normalizer_spec.CopyFrom(normaliser.normalizer_spec)
    proto.normalizer_spec.add_dummy_prefix, proto.normalizer_spec.remove_extra_whitespaces, proto.normalizer_spec.escape_whitespaces = True, trim, True
    model = proto.SerializeToString()
    library, codec = sentencepiece.SentencePieceProcessor(model_proto=model), piece_codec.Codec(model)
    for text in [*TEXTS, "ﬁne ①② Ａｂｃ  x", "e\u0301 ㍿ ½", "  lead and trail  ", "ÀÉ Straße ǅ", "\u200b\ufeff\x01 z"]:
        if any(mark in text for mark in ("</s>", "▁")):
            continue  # symbols of the model itself
        ids = library.encode(text, add_bos=True, add_eos=True)
        assert codec.encode(text) == struct.pack(f"<{len(ids)}I", *ids), (rule, text)
        spans = codec.spans(text)
        assert all(0 <= first <= end <= len(text.encode()) for _, first, end in spans)
        assert all(x[1] <= y[1] for x, y in zip(spans, spans[1:], strict=False))


def test_piece_edges(spark, edge, none):
    path = queries.tokenizer_path()
    assert {r["doc_id"]: r["n_tokens"] for r in piece_codec.encode_digests(edge, path).collect()}[1] == 2
    assert piece_codec.encode_digests(none, path).count() == 0
    encoded = piece_codec.encode_documents(edge, path, ["doc_id"], spans=True)
    assert {r["doc_id"]: r["text"] for r in piece_codec.decode_documents(encoded, path, ["doc_id"]).collect()}[6] == {r["doc_id"]: r["text"] for r in edge.collect()}[6]


# 7 ----------------------------------------------------------------------------


def test_decontamination(spark, sf, documents):
    def tokens(t):
        return [w for w in (re.sub(r"[!-/:-@\[-`{-~]", "", w).lower() for w in (t or "").split()) if w]

    index = collections.defaultdict(set)
    for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect():
        w = tokens(r["text"])
        for k in range(len(w) - 7):
            index[tuple(w[k : k + 8])].add(r["item_id"])
    want = {(r["doc_id"], i) for r in documents.collect() for w in [tokens(r["text"])] for k in range(len(w) - 7) for i in index.get(tuple(w[k : k + 8]), ())}
    assert {(r["doc_id"], r["item_id"]) for r in queries.op7_decontamination(spark, sf).collect()} == want


QUESTION = "If Tom has 3 apples and buys 5 kg of pears, how many apples does Tom have today?"


@pytest.mark.parametrize("text,found", [
    (QUESTION, True), (QUESTION.replace("Tom", "Ann").replace("3", "1,200").replace("5", "2.5"), True), (QUESTION.replace("5 kg", "7 miles"), True),
    ("Something else entirely that has nothing to do with it at all.", False), ("", False), (None, False), ("buys 5 kg of pears", False),
])
def test_templates(text, found):
    index = decontam.Index([(1, QUESTION.encode()), (2, b""), (3, b"too short")], 8, 4)
    assert bool(list(index.matches([None if text is None else ("Well then. " + text).encode()]))) == found


@pytest.mark.parametrize("item,text,found", [
    ("Tom has 3 apples and 5 pears.", "Ann has 4 apples and 7 pears.", True), ("Tom has 3 apples and 5 pears.", "So it is. Mary Ann has 4 apples and 7 pears. Good.", True),
    ("Tom has 3 apples and 5 pears.", "Well then, Ann has 4 apples and 7 pears.", True), ("Tom has 3 apples and 5 pears.", "Ann has 4 plums and 7 pears.", False),
    ("Mr Tom Berg meets Ann Lund by the old bridge.", "Mr Per Ole Dahl meets Eva by the old bridge.", True), ("Tom and Ann and Tom walk home today.", "Eva and Per and Per walk home today.", False),
])
def test_names_where_sentences_open(item, text, found):
    index = decontam.Index([(1, item.encode())], 8, 4)
    assert bool(list(index.matches([text.encode()]))) == found


def test_recall_of_questions_with_new_numbers_names_and_units():
    """At least nine in ten generated questions are found again after new values
    were drawn for all slots, and none of another kind."""
    r = random.Random(13)
    names, units, words = ["Tom", "Ann", "Eva", "Per Dahl", "Ole", "Mary Lund"], ["kg", "miles", "hours", "meters"], [f"verb{i}" for i in range(400)]

    def question(k):
        own = random.Random(k)
        shape = [own.choice(["NAME", "NUMBER", "NUMBER UNIT", "w", "w", "w", "w"]) for _ in range(own.randrange(12, 25))]
        return [own.choice(words) if x == "w" else x for x in shape]

    def filled(shape):
        slots = {"NAME": lambda: r.choice(names), "NUMBER": lambda: str(r.randrange(2, 900)), "NUMBER UNIT": lambda: f"{r.randrange(2, 90)} {r.choice(units)}"}
        text = " ".join(slots[x]() if x in slots else x for x in shape) + "?"
        return text[0].upper() + text[1:]

    shapes = [question(k) for k in range(300)]
    index = decontam.Index([(k, filled(s).encode()) for k, s in enumerate(shapes)], decontam.WIDTH, decontam.LEAST_WORDS)
    hits = {(i, item) for i, item, *_ in index.matches([filled(s).encode() for s in shapes])}
    assert sum((k, k) in hits for k in range(300)) >= 270
    assert not list(index.matches([filled(question(k)).encode() for k in range(1000, 1300)]))


def test_slots_must_agree():
    item = "if Tom and Tom meet then both are glad"
    index = decontam.Index([(1, item.encode())], 9, 4)
    assert list(index.matches([b"if Ann and Ann meet then both are glad"]))
    assert not list(index.matches([b"if Ann and Bob meet then both are glad"]))


SUM = "What is 345 + 872?"
HEAVY = "In 1990 Anna Berg sold 12 345 67 89 km to Ole Lund for 5 6 7 8 9"


@pytest.mark.parametrize("item,text,found", [
    (SUM, f"He asked: {SUM} Nobody knew.", True), (SUM, "He asked: what is 345 + 873? Nobody knew.", False),
    (HEAVY, f"Well then, {HEAVY} and more.", True), (HEAVY, HEAVY.replace("Anna", "Eva").replace("12", "13").replace("345", "346").replace("Ole", "Per"), False),
    ("Which of these rivers flows north today?", "as in (a), Which of these rivers flows north today?", True),
    ("Which of these rivers flows north today?", "as in (a) Which of these rivers flows south today?", False),
    ("Yes, 7.", "so yes 7 it is", True), ("Yes, 7.", "so yes it is 7", False), ("!!! ???", "!!! ???", False),
])
def test_copies_with_few_words(item, text, found):
    index = decontam.Index([(1, item.encode())], 8, 4)
    assert bool(list(index.matches([b"7.", text.encode(), b"yes"]))) == found


def test_windows_count_once():
    index = decontam.Index([(1, QUESTION.encode())], 8, 4)
    n = len(QUESTION.split()) - 7
    assert list(index.matches([QUESTION.encode(), b"see (1), " + QUESTION.encode()])) == [(0, 1, n, n), (1, 1, n, n)]


def test_decontamination_edges(spark, edge, none, monkeypatch):
    items = spark.createDataFrame([(1, "one two three four five"), (1, "one two three four five"), (2, None), (3, ""), (4, "a null id has this text")], "item_id long, text string")
    assert [tuple(r) for r in decontam.matches(edge, items).collect()] == [(None, 4, 1, 1)]
    assert decontam.remove_contaminated(edge, items).count() == edge.count() - 1 and decontam.matches(none, items).count() == 0
    assert decontam.matches(edge, items.where("false")).count() == 0
    monkeypatch.setattr(decontam, "BLOCK", 1)  # every item a block of its own
    assert [tuple(r) for r in decontam.matches(edge, items).collect()] == [(None, 4, 1, 1)]


# 8 ----------------------------------------------------------------------------


def brute_components(rows):
    sets, parent, inverse = {}, {}, collections.defaultdict(list)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, t in rows:
        w = WORD.findall(lower(t))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
        parent[i] = i
        for x in sets[i]:
            inverse[x].append(i)
    shared = collections.Counter((a, b) for found in inverse.values() for i, a in enumerate(found) for b in found[i + 1 :])
    for (a, b), n in shared.items():
        if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {i: (i, len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize("small,hottest,bits", [(64, 11, 64), (2, 3, 64), (5, 4, 24)])
def test_jaccard_join(spark, documents, small, hottest, bits):
    rows = [(r["doc_id"], r["text"]) for r in documents.collect()]
    r = random.Random(3)
    base = [f"w{k}" for k in range(120)]
    for i in range(1000, 1080):  # a large group of near copies
        w = list(base)
        for _ in range(r.randrange(5)):
            w[r.randrange(len(w))] = f"z{r.randrange(1000)}"
        rows.append((i, " ".join(w)))
    want = brute_components(rows)
    got = jaccard_join.Join(spark.createDataFrame(rows, "doc_id long, text string"), small, hottest, bits).membership().collect()
    assert len(got) == len(rows) and all(tuple(g) == want[g["doc_id"]] for g in got)


def test_classes_that_agree_in_their_key_are_told_apart(spark):
    texts = [f"t{i} some words of text number {i} here" for i in range(40)]
    words = [_text.Words([t.encode()], lower=True).hash for t in texts]
    assert len({jaccard_join.class_key(w, 0, 9)[0] for w in words}) < 40  # keys of nine bits collide
    join = jaccard_join.Join(spark.createDataFrame(list(enumerate(texts * 2)), "doc_id long, text string"), key_bits=9)
    assert join.seed > 0 and join.classes.count() == 40
    assert all(r["component_id"] == r["doc_id"] % 40 for r in join.membership().collect())


def test_places_bound_the_intersection():
    rng = np.random.default_rng(4)
    for _ in range(200):
        a, b = (np.sort(rng.choice(60, rng.integers(20, 55), replace=False)) for _ in range(2))
        if 100 * np.intersect1d(a, b).size >= 75 * np.union1d(a, b).size:
            for x in np.intersect1d(a, b):
                assert jaccard_join.may_meet(np.array([a.size]), np.searchsorted(a, [x]), np.array([b.size]), np.searchsorted(b, [x]))[0]


def test_long_words_are_told_apart():
    a, b = b"a" * 4096 + b"b" * 4096, b"b" * 4096 + b"a" * 4096
    x, y = _text.Words([a + b" " + b], lower=True).hash
    assert x != y


def test_jaccard_rows_without_or_with_repeated_ids(spark):
    base = " ".join(f"w{i}" for i in range(60))
    rows = [(None, base + " end"), (None, "quite another text of some words here"), (3, base), (3, "one text under a repeated id is this"), (4, "one text under a repeated id is this"), (2, base + " stop")]
    got = sorted((r["doc_id"] or -1, r["n_shingles"], r["component_id"] or -1) for r in jaccard_join.components(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(-1, 3, -1), (-1, 57, 2), (2, 57, 2), (3, 4, 3), (3, 56, 2), (4, 4, 3)]


def test_bitmap_bound_never_exceeds_the_difference():
    rng = np.random.default_rng(1)
    for n, m in ((10, 10), (300, 200), (40, 4000)):
        a, b = (np.unique(rng.integers(0, 5000, k).astype(np.uint64)) for k in (n, m))
        a, b = _text.mix(a), _text.mix(b)
        zero, one = np.array([0]), np.array([1])
        assert jaccard_join.difference_bounds([jaccard_join.bitmap(a), jaccard_join.bitmap(b)], zero, one) <= np.setxor1d(a, b).size


def test_jaccard_edges(edge, none):
    got = sorted((r["doc_id"] or -1, r["n_shingles"], r["component_id"] or -1) for r in jaccard_join.components(edge).collect())
    assert len(got) == edge.count() and (5, 1, 4) in got and (1, 0, 1) in got and (-1, 2, -1) in got
    assert jaccard_join.components(none).count() == 0
    kept = jaccard_join.keep_one(edge)
    assert kept.dtypes == edge.dtypes and kept.count() == edge.count() - 2


@pytest.mark.parametrize("most", [5, 1_000_000])
def test_graph_components(spark, monkeypatch, most):
    monkeypatch.setattr(_graph, "TASK_EDGES", most)  # few: contraction in rounds
    r = random.Random(0)
    edges = [(i, i + 1) for i in range(60)] + [(100, k) for k in range(101, 160)] + [(r.randrange(200, 300), r.randrange(200, 300)) for _ in range(60)] + [(7, 7)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    got = {x["node"]: x["label"] for x in _graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in got} and len(got) >= 120


# 9 ----------------------------------------------------------------------------


def brute_statistics(text):
    t = text or ""
    w = WORD.findall(t)
    c = collections.Counter(zip(w, w[1:], w[2:], strict=False))
    covered = {j for k in range(len(w) - 2) if c[tuple(w[k : k + 3])] > 1 for j in (k, k + 1, k + 2)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)


def test_quality(spark, sf, documents):
    text = {r["doc_id"]: r["text"] for r in documents.collect()}
    for r in queries.op9_quality_rules(spark, sf).collect():
        n = brute_statistics(text[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == n
        assert r["base_failed"] == (n[0] < 50 or 100 * n[4] > 50 * n[0]) and not (r["base_failed"] and r["kept"])


def test_quality_edges(spark, edge, none):
    labels = spark.createDataFrame([(1, 1, 0), (1, None, 1), (None, 1, 1), (6, 0, 0)], "doc_id long, quality int, toxic int")
    by = {r["doc_id"]: r for r in quality_rules.judge(edge, labels).collect()}
    assert len(quality_rules.judge(edge, labels).collect()) == edge.count()
    assert by[7]["n_repeat_words"] == 30_000 and by[7]["base_failed"] and by[1]["n_words"] == 0 and by[8]["word_chars"] == 200_000
    assert quality_rules.judge(none, labels).count() == 0


def test_exact_bounds():
    assert quality_rules.rejects(0, 300, 0.01, 0.05) and not quality_rules.rejects(0, 298, 0.01, 0.05)
    assert not quality_rules.rejects(0, 0, 0.01, 0.05)
    assert quality_rules.strictest({1: 2, 2: 100}, 9, 5000, 0.02, 0.05) == 1  # the second step would lose 102 of 5000
    assert quality_rules.strictest({}, 9, 5000, 0.02, 0.05) == 9 and quality_rules.strictest({}, 9, 10, 0.02, 0.05) == 0
    steps = quality_rules.path([{90: 5, 50: 5, 0: 10}, {3: 20}], [{50: 1, 0: 99}, {3: 100}])
    assert steps == [(0, 90), (0, 50)] and quality_rules.first_steps(steps, 0)[49:52] == [3, 2, 2]
    assert quality_rules.least_evidence(0.02, 0.05) == 149
    assert set(quality_rules.levels([("a", 5000), ("b", 190), ("c", 170), ("d", 20)], 0.02, 0.05)) == {"a", "b"}


def brute_quality(rows, labels, alpha=0.02, delta=0.05):
    """(kept, chosen step by stratum) by plain loops."""
    best = {}
    for i, q in labels:
        if q is not None:
            best[i] = max(best.get(i, 0), q)
    table = []
    for i, lang, text in rows:
        n_words, chars, symbols, dup, rep = brute_statistics(text)
        lines = sum(1 for x in (text or "").split("\n") if WORD.search(x))
        rates = [min(100, symbols * 100 // max(chars, 1)), min(100, dup * 100 // max(lines, 1)), min(100, rep * 100 // max(n_words, 1)), min(100, chars * 4 // max(n_words, 1))]
        failed = n_words < 50 or 100 * rep > 50 * n_words
        table.append((i, lang, rates, failed, i is not None and zlib.crc32(str(i).encode()) % 3 != 1))
    tested = [t for t in table if not t[3] and t[4] and best.get(t[0]) == 1]
    enough = quality_rules.levels(list(collections.Counter(t[1] for t in tested).items()), alpha, delta)
    assert not enough or sum(enough.values()) == pytest.approx(delta)
    chosen, rules = {}, {}
    for lang in enough:
        own = [t for t in table if t[1] == lang and not t[3]]
        bad = [t[2] for t in own if t[4] and best.get(t[0]) == 0]
        pool = [t[2] for t in own if not (t[4] and t[0] in best)]
        steps = quality_rules.path(*([collections.Counter(x[k] for x in texts) for k in range(4)] for texts in (bad, pool)))
        good = [t[2] for t in tested if t[1] == lang]
        chosen[lang] = 0
        for n in range(1, len(steps) + 1):
            lost = sum(any(x[k] >= c for k, c in steps[:n]) for x in good)
            if not quality_rules.rejects(lost, len(good), alpha, enough[lang]):
                break
            chosen[lang] = n
        rules[lang] = steps[: chosen[lang]]
    kept = [(i, not failed and not any(rates[k] >= c for k, c in rules.get(lang, []))) for i, lang, rates, failed, _ in table]
    return kept, chosen


def test_verdicts_equal_a_plain_calibration(spark):
    r = random.Random(11)
    rows, labels = [], []
    for i in range(3200):
        lang = ("aa", "bb", "", None, "few")[i % 5 if i % 100 else 4] if i % 25 else "few"
        lang = lang if lang != "few" or i % 50 == 0 else "aa"
        words = ["".join(r.choice("abcdefghij") for _ in range(r.randrange(3, 9))) for _ in range(r.randrange(45, 80))]
        bad = r.random() < 0.08
        if bad:
            words = [w + "#$%&"[: r.randrange(2, 5)] for w in words]
        rows.append((i, lang, " ".join(words)))
        if r.random() < 0.7:
            labels.append((i, int(not bad)))
    labels += [(0, None), (1, 0), (1, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    marks = spark.createDataFrame(labels, "doc_id long, quality int")
    kept, chosen = brute_quality(rows, labels)
    got = {x["doc_id"]: x["kept"] for x in quality_rules.judge(docs, marks).collect()}
    assert got == dict(kept)
    assert sum(step > 0 for step in chosen.values()) == 4 and set(chosen) == {"aa", "bb", "", None}
    told = {x["lang"]: (x["step"], x["enough"]) for x in quality_rules.evidence(docs, marks).collect()}
    assert all(told[lang] == (step, True) for lang, step in chosen.items()) and told["few"] == (0, False)
    # a planted bad text is refused in every stratum with enough labels
    spam = " ".join(["wort#$%&"] * 2 + [f"w{i}#$%&" for i in range(60)])
    more = docs.unionByName(spark.createDataFrame([(10_000 + k, lang, spam) for k, lang in enumerate(chosen)], docs.schema))
    assert not any(x["kept"] for x in quality_rules.judge(more, marks).where("doc_id >= 10000").collect())


def test_quality_loss_is_bounded_in_the_other_third(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = queries.op9_quality_rules(spark, sf).join(labels, "doc_id").where("quality = 1 AND NOT base_failed").select("doc_id", "kept").collect()
    held = [r["kept"] for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1]
    assert sum(held) / len(held) > 0.97
    on = {r["lang"]: r["step"] for r in quality_rules.evidence(docs, labels).collect()}
    assert on and all(step > 0 for step in on.values())


# 10 ---------------------------------------------------------------------------


def test_toxicity(spark):
    sf = "/root/testdata/sf0.1"
    rows = queries.op10_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").select("toxic", "predicted", "score").collect()
    hit = [r["predicted"] for r in rows if r["toxic"] == 1]
    miss = [r["predicted"] for r in rows if r["toxic"] == 0]
    # some 350 toxic rows to learn from: rare word stems are not all among them
    assert sum(hit) / len(hit) > 0.75 and sum(miss) / len(miss) < 0.01 and all(0 <= r["score"] <= 1 for r in rows)


def test_pairs_are_learned():
    """An insult counts only together with a group: no sum of weights says that."""
    r = random.Random(5)
    texts, y = [], []
    for _ in range(1200):
        insult, group = r.random() < 0.5, r.random() < 0.5
        words = [f"w{r.randrange(300)}" for _ in range(12)] + ["insult"] * insult + ["group"] * group
        r.shuffle(words)
        texts.append(" ".join(words).encode())
        y.append(int(insult and group))
    machine = toxicity.fit(toxicity.terms(texts), np.array(y), 0.25, steps=600)
    got = machine.score([b"w1 insult", b"w2 group", b"w3 insult group w4", b"w5", b"", None])
    assert got[2] > 0.7 and max(got[0], got[1], got[3], got[4]) < 0.3 and got[4] == got[5]


def test_pairs_without_single_effects_are_learned():
    """Either of two words is toxic, both or none are not: no word tells alone."""
    r = random.Random(6)
    texts, y = [], []
    for _ in range(1500):
        a, b = r.random() < 0.5, r.random() < 0.5
        words = [f"w{r.randrange(200)}" for _ in range(12)] + ["aaa"] * a + ["bbb"] * b
        r.shuffle(words)
        texts.append(" ".join(words).encode())
        y.append(int(a != b))
    machine = toxicity.fit(toxicity.terms(texts), np.array(y), 0.5, steps=600)
    both, one, other, none = machine.score([b"w1 aaa bbb", b"w2 aaa", b"bbb w3", b"w4 w5"])
    assert min(one, other) > 0.7 and max(both, none) < 0.3


def test_score_is_the_sum_over_terms_and_pairs():
    rng = np.random.default_rng(3)
    known = np.unique(np.concatenate(toxicity.terms([b"alpha beta gamma delta epsilon"])))
    machine = toxicity.Machine(known, rng.normal(size=known.size), rng.normal(size=(known.size, 8)) / 4, -0.3)
    for text in (b"alpha unknown words", b"Beta gamma alphabet", b"", b"alpha beta gamma delta epsilon " * 5):
        hit = [k for k in range(known.size) if known[k] in toxicity.terms([text])[0]]
        total = -0.3 + sum(machine.weight[k] for k in hit) + sum(machine.factor[i] @ machine.factor[j] for i in hit for j in hit if i < j)
        assert machine.score([text])[0] == pytest.approx(1 / (1 + np.exp(-total)))


def test_labels_of_one_kind_or_repeated_ids(spark, edge):
    ones = spark.createDataFrame([(i, 1, 1) for i in (3, 4, 6, 7, 8)] + [(5, 1, None)], "doc_id long, quality int, toxic int")
    assert all(r["score"] > 0.99 for r in toxicity.predict(edge, ones).collect())
    assert all(r["score"] < 0.01 for r in toxicity.predict(edge, ones.withColumn("toxic", F.lit(0))).collect())
    many = spark.createDataFrame([(4, f"text {i}") for i in range(500)], "doc_id long, text string")
    assert toxicity.predict(many, ones).count() == 500


def test_toxicity_edges(spark, edge, none):
    labels = spark.createDataFrame([(4, 1, 1), (6, 1, 0), (9, 0, None), (None, 0, 1), (4, 1, 0)], "doc_id long, quality int, toxic int")
    assert toxicity.predict(edge, labels).count() == edge.count() and toxicity.predict(none, labels).count() == 0
    assert {r["score"] for r in toxicity.predict(edge, labels.where("false")).collect()} == {0.0}
    kept = toxicity.remove_toxic(edge, labels.where("false"))
    assert kept.dtypes == edge.dtypes and kept.count() == edge.count()


# all --------------------------------------------------------------------------

ALONE = """
import sys
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
from blockwright.llm import decontam, jaccard_join, langid, piece_codec, queries, suffix_dedup, toxicity, urlfilter, warc
def docs(): return spark.createDataFrame([(i, f"some words of a text about {{i}} things " * 9, "en") for i in range(6)], "doc_id long, text string, lang string")
pages = spark.createDataFrame([(1, "http://a.org/x", "h")], "page_id long, url string, html string")
found = {{
    "decontam": lambda: decontam.matches(docs(), docs().withColumnRenamed("doc_id", "item_id")), "jaccard": lambda: jaccard_join.components(docs()),
    "langid": lambda: langid.predict(docs()), "pieces": lambda: piece_codec.encode_digests(docs(), queries.tokenizer_path()), "suffix": lambda: suffix_dedup.digests(docs()),
    "toxicity": lambda: toxicity.predict(docs(), docs().selectExpr("doc_id", "cast(doc_id % 2 AS int) AS toxic")), "warc": lambda: warc.round_trip(pages),
    "url": lambda: urlfilter.judge(pages, spark.createDataFrame(queries.URL_RULES, "host string, path string, verdict string")),
}}
for name, make in found.items():
    assert make().collect(), name
"""


def test_operators_bring_their_code_to_the_workers(tmp_path):
    import os
    import subprocess
    import sys
    from pathlib import Path

    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    repo = str(Path(__file__).resolve().parents[2])
    done = subprocess.run([sys.executable, "-c", ALONE.format(repo=repo)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert not done.returncode, done.stderr[-2000:]
