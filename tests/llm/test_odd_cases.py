"""Repeated and null ids, clashing columns, broken files, very long texts, and brute-force versions of scores."""

import hashlib
import math
import random
import struct
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from labflow.llm import bpe, langid, linededup, mixing, sharding, simhash, tiff, topk, toxicity
from test_operators import fingerprint, reference, sentence, some_docs  # noqa: F401

KINDS = "doc_id long, text string, source string"


def by_sql(sql, rows):
    """The SQL's rows over documents."""
    con = duckdb.connect()
    columns = {n: pa.array([r[i] for r in rows], t) for i, (n, t) in enumerate((("doc_id", pa.int64()), ("text", pa.string()), ("source", pa.string())))}
    con.register("documents", pa.table(columns))
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    return Counter(repr(sorted(zip(names, (round(x, 6) if isinstance(x, float) else x for x in r), strict=True))) for r in found.fetchall())


def by_spark(df):
    return Counter(repr(sorted((k, round(v, 6) if isinstance(v, float) else v) for k, v in r.asDict().items())) for r in df.collect())


def repeated_rows():
    r = random.Random(21)
    rows = [(i % 7, f"{i % 5} " + " ".join("word" for _ in range(r.randrange(1, 30))), f"s{i % 4}") for i in range(120)]
    rows += [(None, "one two three", "nulls")] * 100 + [(None, f"{i} four", "nulls") for i in range(20)]
    rows += [(7, "equal text of five words", "equal")] * 90 + [(8, None, "empty")] * 5 + [(9, "", None)] * 3 + [(None, None, None)]
    return rows


@pytest.mark.parametrize("bits", [10, 60, 7])
def test_mix_of_repeated_ids_as_sql(spark, bits):
    rows = repeated_rows()
    df = spark.createDataFrame(rows, KINDS)
    for docs in (df, df.repartition(5)):
        got = mixing.mix(docs, bits).select("doc_id", "size", "source_size", "target", "taken")
        assert by_spark(got) == by_sql(mixing.OP4_SQL, rows)
    taken = {s: n for s, n in mixing.mix(df).groupBy("source").agg(F.sum("taken")).collect()}
    target = {s: t for s, t in mixing.mix(df).groupBy("source").agg(F.first("target")).collect()}
    assert all(abs(taken[s] - target[s]) <= 30 for s in taken)


def test_sources_are_numbered_in_pieces(spark):
    rows = spark.createDataFrame([(f"s{i:03d}" if i % 50 else None, 1) for i in range(1, 200)], "source string, x int").dropDuplicates(["source"]).cache()
    order = [F.col("source").isNull(), F.col("source")]
    want = sorted((r[0] for r in rows.collect()), key=lambda s: (s is None, s or ""))
    for piece in (10, 1000):
        got = sorted(mixing.numbered(rows, *order, piece=piece).collect(), key=lambda r: r["n"])
        assert [r["n"] for r in got] == list(range(1, len(want) + 1)) and [r["source"] for r in got] == want


def test_mix_keeps_clashing_columns(spark):
    names = ["s", "s2", "low", "budget", "plan_source", "copies", "lim", "mix_hash", "part", "h", "n", "c", "piece", "range", "weight", "own", "_own", "_ownh", "_OWNpart", "level", "start"]
    rows = [(i // 3, "some words here", f"s{i % 2}", *(f"{n} {i}" for n in names)) for i in range(40)] + [(None, "equal", "t", *("x" for _ in names))] * 20
    df = spark.createDataFrame(rows, KINDS + "".join(f", {n} string" for n in names))
    got = mixing.mix(df)
    assert got.columns == [*df.columns, "size", "source_size", "target", "times", "taken"]
    assert Counter(tuple(r)[: len(df.columns)] for r in got.collect()) == Counter(rows)


def line_rows():
    rows = [(7, "said by one\nand by all\nalone " + str(i)) for i in range(10)] + [(8, "said by one\nAND BY ALL ")]
    rows += [(i, "and by all\nalone") for i in range(20, 28)] + [(None, "nowhere\nalone"), (None, None), (30, ""), (31, " \n\t")] + [(None, "of no id\nx")] * 10
    return rows


@pytest.mark.parametrize(("most_keys", "most_twice"), [(1000, 1000), (0, 1000), (1000, 0), (0, 0)])
def test_lines_count_documents_as_sql(spark, most_keys, most_twice):
    rows = line_rows()
    names = ["doc", "hash", "lost_lines", "own_hash", "key", "digest", "line", "own", "n", "first_doc", "first_line", "_own", "_owndoc", "lost"]
    df = spark.createDataFrame([(*r, *(f"{n} {i}" for n in names)) for i, r in enumerate(rows)], "doc_id long, text string" + "".join(f", {n} string" for n in names)).repartition(4)
    got = linededup.dedup_lines(df, 10, bits=1 << 12, most_keys=most_keys, most_twice=most_twice).cache()
    assert got.columns == [*df.columns, "n_lines", "n_dropped"]
    assert Counter(tuple(r)[2:-2] for r in got.collect()) == Counter(tuple(f"{n} {i}" for n in names) for i in range(len(rows)))
    digests = got.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))
    assert by_spark(digests) == by_sql(linededup.OP5_SQL, [(*r, None) for r in rows])
    texts = {r["text"] for r in got.collect()}
    assert "said by one\nalone 3" in texts and not any(t and "and by all" in t for t in texts)


def scalar_jump(key, shards):
    shard, at = -1, 0
    while at < shards:
        shard = at
        key = (key * 2862933555777941757 + 1) % (1 << 64)
        at = int((shard + 1) * ((1 << 31) / ((key >> 33) + 1)))
    return shard


def test_shards_as_brute_force(spark):
    rows = [(i, t) for i, t, *_ in some_docs()] + [(None, "hot")] * 50 + [(5, "hot")] * 40 + [(5, "other")] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("shard", F.lit("old")).withColumn("n", F.lit(1)).withColumn("h", F.lit(2))
    keys = {r[0]: r[1] for r in df.select("doc_id", F.xxhash64("doc_id")).distinct().collect()}
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()), scalar_jump(keys[i] % (1 << 64), 16), scalar_jump(keys[i] % (1 << 64), 17)) for i, t in rows)
    for size, equal in ((4096, 1 << 16), (2, 7)):
        got = sharding.shard(df.repartition(3), 16, size, equal).collect()
        assert Counter((r["doc_id"], r["size"], r["text_crc32"], r["shard"], r["grown_shard"]) for r in got) == want
        for s in {r["shard"] for r in got}:
            assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))


def brute_find(lexicon, phrases, text):
    """The highest weight at each word's start, outside exception phrases, by trying each entry at each place."""
    word = lambda i: i < len(text) and text[i].isalpha()
    inside = set()
    for p in phrases:
        for i in range(len(text)):
            if text.startswith(p, i) and not (i and word(i - 1)) and not word(i + len(p)):
                inside |= set(range(i, i + len(p)))
    found = {}
    for i in range(len(text)):
        if i and word(i - 1) or i in inside:
            continue
        weights = [w for e, w in lexicon.items() if text.startswith(e.rstrip(), i) and not (e.endswith(" ") and word(i + len(e) - 1))]
        if weights:
            found[i] = max(weights)
    return found


def test_toxicity_as_brute_force(spark):
    r = random.Random(31)
    syllables = ["ab", "ba", "cа", "d0", "x", "é", "1d", "$a"]
    for _ in range(60):
        words = [toxicity.fold("".join(r.choice(syllables) for _ in range(r.randrange(1, 4)))) for _ in range(12)]
        words = [w for w in words if toxicity.WORD.fullmatch(w)] or ["ab"]
        lexicon = {w + r.choice(["", " "]): r.random() + 0.1 for w in words[:6]}
        phrases = {f"{r.choice(words)} {r.choice(words)}" for _ in range(3)}
        text = toxicity.fold("".join(r.choice([*words, " ", " ", "-", "7"]) for _ in range(60)))
        assert toxicity.Matcher(lexicon, phrases).find(text) == brute_find(lexicon, phrases, text)
    lexicon, phrases, curve = {"scum": 2.0, "clown ": 3.0}, {"clown fish"}, (-3.0, 1.5, 0.5)
    texts = ["you scum and clown", "a clown fish", None, "", "clownish", "scum " * 400, "so " * 300 + "SСUM"]
    got = toxicity.score_toxicity(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), lexicon, phrases, curve).collect()
    for i, text in enumerate(texts):
        total = sum(brute_find(lexicon, phrases, toxicity.fold(text or "")).values())
        features = (math.log1p(total), math.log1p(100 * total / max(1, len((text or "").split())))) if total else (0.0, 0.0)
        score = 1 / (1 + math.exp(-(curve[0] + curve[1] * features[0] + curve[2] * features[1])))
        row = next(x for x in got if x["doc_id"] == i)
        assert abs(row["score"] - score) < 1e-12 and row["predicted"] == int(score >= 0.5)


def test_lexicon_has_no_limit(spark):
    r = random.Random(32)
    words = {"".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(7000)}
    rows = [(i, " ".join(words)) for i in range(20)] + [(100 + i, "nothing of it") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    lexicon, _, curve = toxicity.fit(docs, spark.createDataFrame([(i, int(i < 100)) for i, _ in rows], "doc_id long, toxic int"))
    assert len(lexicon) > 5000
    got = {x["doc_id"]: x["predicted"] for x in toxicity.score_toxicity(docs, lexicon, set(), curve).collect()}
    assert got == {i: int(i < 100) for i, _ in rows}


def test_held_out_accuracy(spark):
    """Toxicity needs more labelled rows than languages do."""
    large, sf_dir = "/root/testdata/sf0.1", "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{large}/labels.parquet").where("toxic is not null")
    found = Counter((r["toxic"], r["predicted"]) for r in toxicity.op6_toxicity(spark, large).where("held_out").join(labels, "doc_id").collect())
    assert found[1, 1] >= 0.9 * (found[1, 0] + found[1, 1]) and found[0, 1] <= 0.01 * found[0, 0] and found[1, 1] > 50
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    langs = langid.op7_language_id(spark, sf_dir).where("held_out").join(docs.where("lang is not null").select("doc_id", "lang"), "doc_id").where("lang_pred <> 'und'").collect()
    assert len(langs) > 100 and sum(r["lang_pred"] == r["lang"] for r in langs) >= 0.99 * len(langs)


def brute_shares(text, langs, model):
    """EM and the penalised choice of a set for one text, unit by unit and language by language."""
    lower = text.lower()
    units, words = [], 0
    for i, c in enumerate(lower):
        if not c.isalpha():
            continue
        at = lambda k: ord(lower[k]) if 0 <= k < len(lower) and lower[k].isalpha() else 0
        h = (at(i - 1) * 0x9E3779B1 ^ ord(c) * 0x85EBCA77 ^ at(i + 1) * 0xC2B2AE3D) % (1 << 32)
        h ^= h >> 15
        gram = (h * 0x2C1B3C6D % (1 << 32)) >> 16
        if not at(i - 1):
            if words % langid.UNIT == 0:
                units.append([0.0] * langs)
            words += 1
        for j in range(langs):
            units[-1][j] += float(model[gram, j])
    if not units:
        return None

    def em(share, rounds):
        for _ in range(rounds):
            new = [0.0] * langs
            for u in units:
                top = max(u)
                w = [s * math.exp(x - top) for s, x in zip(share, u, strict=True)]
                for j in range(langs):
                    new[j] += w[j] / max(sum(w), 1e-300) / len(units)
            share = new
        return share, sum(max(u) + math.log(max(sum(s * math.exp(x - max(u)) for s, x in zip(share, u, strict=True)), 1e-300)) for u in units)

    order = sorted(range(langs), key=lambda j: -em([1 / langs] * langs, langid.ROUNDS)[0][j])
    best, chosen = -math.inf, None
    for k in range(1, langs + 1):
        share, value = em([1 / k if j in order[:k] else 0.0 for j in range(langs)], langid.ROUNDS if k > 1 else 0)
        value -= langid.PENALTY * k * 0.5 * math.log(len(units) + 1)
        if value > best:
            best, chosen = value, share
    return chosen


def test_language_mixture_as_brute_force(spark, monkeypatch):
    r = random.Random(33)
    letters = {"aa": "abcdefg", "bb": "efghijk", "cc": "jklmnoöß"}
    word = lambda lang: "".join(r.choice(letters[lang]) for _ in range(r.randrange(1, 7)))
    text = lambda lang, n: " ".join(word(lang) for _ in range(n))
    taught = [(i, text(lang, 60), lang) for i, lang in enumerate([*letters] * 10)]
    mixed = [" ".join(text(lang, r.randrange(1, 60)) for lang in r.sample([*letters], r.randrange(1, 4))) for _ in range(25)] + ["", "12 3", "A", "İß Σ ς", None]
    docs = spark.createDataFrame(taught + [(100 + i, t, None) for i, t in enumerate(mixed)], "doc_id long, text string, lang string")
    langs, model = langid.fit(docs)
    got = {x["doc_id"]: x for x in langid.identify(docs.withColumn("lang_pred", F.lit(1)), langs, model).collect()}
    for i, t in enumerate(mixed):
        want = brute_shares(t or "", len(langs), model)
        row = got[100 + i]
        if want is None:
            assert row["lang_pred"] == "und" and row["score"] == 0 and row["lang_shares"] == {}
        else:
            assert row["lang_pred"] == langs[int(np.argmax(want))] and abs(row["score"] - max(want)) < 1e-3
            assert all(abs(row["lang_shares"].get(lang, 0.0) - s) < 1e-3 for lang, s in zip(langs, want, strict=True))
    whole = langid._shares(mixed, model)
    counts = [sum((np.bincount(g, minlength=langid.BUCKETS) for g, _ in langid._grams(t or "")), np.zeros(langid.BUCKETS, int)) for t in mixed]
    for at_once in (1, 3, 40):
        monkeypatch.setattr(langid, "AT_ONCE", at_once)
        for a, b in zip(whole, langid._shares(mixed, model), strict=True):
            assert (a is None) == (b is None) and (a is None or np.allclose(a, b, atol=1e-3))
        assert all((sum((np.bincount(g, minlength=langid.BUCKETS) for g, _ in langid._grams(t or "")), np.zeros(langid.BUCKETS, int)) == c).all() for t, c in zip(mixed, counts, strict=True))


def patched(data, tag, value):
    """A little-endian file of one page with another first value of a tag."""
    out = bytearray(data)
    (at,) = struct.unpack_from("<I", out, 4)
    for i in range(struct.unpack_from("<H", out, at)[0]):
        own, kind, count = struct.unpack_from("<HHI", out, at + 2 + 12 * i)
        if own == tag:
            where = at + 10 + 12 * i
            if tiff.TYPES[kind][0] * count > 4:
                (where,) = struct.unpack_from("<I", out, where)
            struct.pack_into("<" + tiff.TYPES[kind][1], out, where, value)
            return bytes(out)
    raise KeyError(tag)


def test_broken_files_give_error_rows(spark):
    page = np.arange(60, dtype=np.uint8).reshape(6, 10)
    strips, tiles, packed = tiff.write([page]), tiff.write([page], tile=(16, 16)), tiff.write([page], tiff.LZW)
    bad = [patched(strips, tag, v) for tag, v in ((tiff.WIDTH, 0), (tiff.HEIGHT, 0), (tiff.HEIGHT, 1 << 31), (tiff.WIDTH, (1 << 32) - 1), (tiff.HEIGHT, 40), (tiff.ROWS_PER_STRIP, 0), (tiff.SAMPLES, 0), (tiff.SAMPLES, 3), (tiff.PREDICTOR, 3), (tiff.BITS, 16), (tiff.COMPRESSION, 7), (tiff.STRIP_OFFSETS, 10**6), (tiff.STRIP_SIZES, 3))]
    bad += [patched(tiles, tag, v) for tag, v in ((tiff.TILE_WIDTH, 0), (tiff.TILE_HEIGHT, 0), (tiff.TILE_WIDTH, 1 << 30), (tiff.TILE_HEIGHT, 2))]
    (at,) = struct.unpack_from("<I", packed, 4)
    bad += [packed[:8] + bytes([255]) * 30 + packed[38:], packed[:9], strips[: len(strips) // 2], b"", b"II", b"II*\0\xff\xff\xff\xff", b"MM\0*" + b"\0" * 3, packed[:8] + bytes(random.Random(1).randbytes(at - 8)) + packed[at:]]
    files = spark.createDataFrame([(i, bytearray(x)) for i, x in enumerate(bad)] + [(1000, bytearray(strips))], "id long, content binary").withColumn("error", F.lit("old")).withColumn("page", F.lit("old"))
    got = tiff.pages(files).collect()
    assert Counter(r["id"] for r in got) == Counter([*range(len(bad)), 1000])
    assert all((r["error"] is not None and r["data"] is None) == (r["id"] != 1000) for r in got), [r for r in got if r["error"] is None and r["id"] != 1000]
    assert bytes(next(r for r in got if r["id"] == 1000)["data"]) == page.tobytes()


@pytest.mark.parametrize("form", [{}, {"tile": (16, 16)}, {"strip_rows": 2, "predictor": 2}])
@pytest.mark.parametrize("compression", [tiff.NONE, tiff.PACKBITS, tiff.LZW, tiff.DEFLATE])
def test_planes(form, compression):
    page = np.random.default_rng(6).integers(0, 256, (21, 35, 3), np.uint8)
    (got,) = tiff.read(tiff.write([page], compression, planar=True, **form))
    assert (got.data == page).all()


def test_media_features_as_brute_force(spark):
    texts = [t for _, t, *_ in some_docs()] + ["é" * 200_000]
    got = {r["doc_id"]: r for r in tiff.media_digests(spark.createDataFrame([(i, t, "old") for i, t in enumerate(texts)], "doc_id long, text string, feature string")).collect()}
    for i, t in enumerate(texts):
        data = (t or "").encode()
        data += b"\0" * (-len(data) % 64 if data else 64)
        mean = sum(data) / len(data)
        spread = math.sqrt(sum(n * (v - mean) ** 2 for v, n in Counter(data).items()) / len(data))
        rows = len(data) // 64
        assert got[i]["feature"] == f"pages={-(-rows // 4096)};rows={rows};mean={mean:.3f};spread={spread:.3f};values={len(set(data))}"
        media, _ = tiff.store((t or "").encode())
        assert (got[i]["media_bytes"], got[i]["media_sha256"], got[i]["payload_bytes"]) == (len(media), hashlib.sha256(media).hexdigest(), len(data))


def test_texts_of_one_hash_have_names_of_their_own(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "a b"), (2, "c d"), (3, "a b"), (4, None), (5, "e f")], "doc_id long, text string")
    real = F.xxhash64
    # As if the first hash were the same for two texts.
    monkeypatch.setattr(simhash.F, "xxhash64", lambda *c: F.when(F.col("text").isin("a b", "c d"), F.lit(42).cast("long")).otherwise(real(*c)) if len(c) == 1 else real(*c))
    names = {r[0]: r[1] for r in docs.select("doc_id", simhash.text_node(docs).alias("n")).collect()}
    assert names[1] == names[3] and len(set(names.values())) == 4


def test_very_long_texts(reference):  # noqa: F811
    path, pattern, other = reference
    words = sentence(1000)
    text = (words + "\n") * 550 + "x" * 50_000 + " é日本" * 1000
    assert len(text) > 3_000_000
    own = bpe.Codec(path, pattern)
    ids = own.encode(text * 2)
    assert ids.tolist() == other.encode_ordinary(text * 2) and own.decode(ids) == (text * 2).encode()
    data = text.encode()
    assert simhash.repeats_fingerprint(data, 4) & (1 << 64) - 1 == fingerprint(text, 4)
    media, size = tiff.store(data)
    assert b"".join(p.data.tobytes() for p in tiff.read(media)) == data + b"\0" * (size - len(data))
    assert len(linededup.keys(data)) == text.count("\n") + 1
    lexicon = {"omega ": 1.0, "kappa": 2.0}
    assert sum(toxicity.Matcher(lexicon, set()).find(toxicity.fold(text)).values()) == text.split().count("omega") + 2.0 * text.split().count("kappa")


def test_a_cluster_has_to_name_its_folder(spark, monkeypatch):
    from labflow.llm import common

    class Context:
        master = "spark://somewhere:7077"

        def getCheckpointDir(self):  # noqa: N802
            return None

    class Session:
        sparkContext = Context()
        conf = type("Conf", (), {"get": staticmethod(lambda key, other=None: other)})()

    with pytest.raises(ValueError, match="checkpoint.dir"):
        common.cut(type("Frame", (), {"sparkSession": Session()})())


def test_top_k_evaluates_no_more_than_it_meets(spark):
    r = np.random.default_rng(8)
    centres = r.integers(-20, 21, (12, 3)).astype(float)
    rows = spark.createDataFrame([(i, (centres[i % 12] + r.normal(0, 0.2, 3)).tolist()) for i in range(3000)], "vec_id long, embedding array<double>")
    found = topk.top_k(rows, F.col("vec_id") % 500 == 0, 5, block=600, shares=True).collect()
    assert {x["query_id"] for x in found} == set(range(0, 3000, 500)) and all(x["met"] == 2999 for x in found)
    assert sum(x["evaluated"] for x in found) < 0.5 * sum(x["met"] for x in found)
