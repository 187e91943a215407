"""Each operator against a brute-force version, and on null, empty, long, repeated and clashing rows."""

import hashlib
import random
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from labflow.llm import bpe, langid, linededup, mixing, sharding, simhash, tiff, tokencounts, topk, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
random.seed(3)
WORDS = ["alpha", "beta", "gamma", "delta", "omega", "sigma", "theta", "kappa"]


def sentence(n):
    return " ".join(random.choice(WORDS) for _ in range(n))


def some_docs():
    random.seed(3)
    rows = [(i, sentence(random.randint(1, 40)) + "\nshared line\n" + sentence(5), "en", f"s{i % 3}", 0) for i in range(40)]
    rows += [(40, None, None, None, None), (41, "", "en", "s0", 0), (42, " \n\t ", "en", None, 0), (None, "no id here", "en", "s1", 0), (43, rows[0][1], "en", "s0", 0), (0, rows[0][1], "en", "s0", 0), (44, "x" * 5000 + " é日本 " + "ab " * 3000, "en", "s2", 0)]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(some_docs(), DOCS).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def fingerprint(text, k):
    w = (text or "").encode().lower().split()
    s = [b" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))] if w else []
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(rows, most, alike=lambda a, b: True):
    up = list(range(len(rows)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(rows):
        for j, b in enumerate(rows[:i]):
            if (a[1] ^ b[1]).bit_count() <= most and alike(a, b):
                up[top(i)] = top(j)
    names = {}
    for i, r in enumerate(rows):
        names.setdefault(top(i), []).append(r[0])
    low = {k: min((x for x in v if x is not None), default=None) for k, v in names.items()}
    return [low[top(i)] for i in range(len(rows))]


@pytest.mark.parametrize(("most", "hot"), [(4, 1 << 15), (12, 3), (24, 5)])
def test_simhash_links_as_brute_force(spark, docs, most, hot):
    rows = [(r[0], fingerprint(r[1], 4)) for r in some_docs()]
    got = sorted(map(repr, ((r[0], r[1] & (1 << 64) - 1, r[2]) for r in simhash.near_duplicates(docs, 4, most, hot=hot).collect())))
    assert got == sorted(map(repr, ((a, b, c) for (a, b), c in zip(rows, classes(rows, most), strict=True))))


def test_simhash_of_nothing(none):
    assert simhash.near_duplicates(none).count() == 0


def test_simhash_chunks(monkeypatch):
    text = sentence(500).encode()
    whole = simhash.fingerprint(text, 5)
    monkeypatch.setattr(simhash, "CHUNK", 7)
    assert simhash.fingerprint(text, 5) == whole


def test_similar_as_brute_force(spark):
    r = random.Random(5)
    rows = []
    for i in range(12):
        words = [str(r.randrange(10**6)) for _ in range(r.choice([60, 150, 300]))]
        rows.append((i * 10, " ".join(words)))
        for j in range(1, 4):
            more = list(words)
            more[r.randrange(len(more))] = "changed"
            rows.append((i * 10 + j, " ".join(more)))
        rows.append((i * 10 + 9, " ".join(words[: len(words) // 2] + [str(r.randrange(10**6)) for _ in words])))
    often = "one two three four five " * 400
    rows += [(500, None), (501, ""), (502, " \n"), (503, rows[0][1]), (0, rows[0][1].upper()), (None, rows[5][1]), (504, often + rows[0][1]), (505, often + rows[5][1])]
    sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set() for w in ((t or "").lower().split() for _, t in rows)]
    prints = [simhash.fingerprint((t or "").encode(), 5, 2) for _, t in rows]
    near = lambda x, y: any(((a ^ b) & (1 << 64) - 1).bit_count() <= 9 for a, b in zip(prints[x], prints[y], strict=True))
    alike = {(x, y) for x in range(len(rows)) for y in range(len(rows)) if near(x, y) and len(sets[x] & sets[y]) >= 0.8 * len(sets[x] | sets[y])}
    want = classes([(d, k) for k, (d, _) in enumerate(rows)], 64, lambda a, b: (a[1], b[1]) in alike)
    got = simhash.similar(spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, node int"), 5, 9, 0.8, 2).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, zip((d for d, _ in rows), want, strict=True)))


def test_similar_in_dense_groups(spark, monkeypatch):
    r = random.Random(6)
    base = [str(r.randrange(10**6)) for _ in range(600)]
    rows = []
    for i in range(40):
        words, at = list(base), r.randrange(540)
        words[at : at + 60] = [str(r.randrange(10**6)) for _ in range(60)]
        rows.append((2 * i, " ".join(words)))
        rows.append((2 * i + 1, " ".join([*words[:300], *(["other"] * r.randrange(4)), *words[300:]])))
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (t.split() for _, t in rows)]
    alike = lambda a, b: len(sets[a[1]] & sets[b[1]]) >= 0.8 * len(sets[a[1]] | sets[b[1]])
    prints = [simhash.fingerprint(t.encode(), 5)[0] for _, t in rows]
    near = lambda a, b: ((prints[a[1]] ^ prints[b[1]]) & (1 << 64) - 1).bit_count() <= 20
    want = classes([(d, k) for k, (d, _) in enumerate(rows)], 64, lambda a, b: alike(a, b) and near(a, b))
    rounds = []
    kept = simhash.links
    monkeypatch.setattr(simhash, "links", lambda *a, **b: rounds.append(a[3]) or kept(*a, **b))
    got = simhash.similar(spark.createDataFrame(rows, "doc_id long, text string"), 5, 20, 0.8, 1).collect()
    assert sorted(map(tuple, got)) == sorted(zip((d for d, _ in rows), want, strict=True))
    assert len(set(want)) > 10 and len(rounds) > 1


def test_similar_of_repeated_passages(spark):
    r = random.Random(8)
    rows = []
    for i in range(30):
        words = [str(r.randrange(10**6)) for _ in range(400)]
        line = " ".join(str(r.randrange(10**6)) for _ in range(20))
        rows += [(2 * i, " ".join([*words, line])), (2 * i + 1, " ".join([*words, *[line] * 10]))]
    got = simhash.similar(spark.createDataFrame(rows, "doc_id long, text string"), 5, 9, 0.8, 2).collect()
    assert sorted(map(tuple, got)) == [(d, d // 2 * 2) for d, _ in rows]


def test_repeats_count_in_op1():
    for n in (1, 7, 400):
        text = sentence(n) + " and once more" * n
        assert simhash.repeats_fingerprint(text.encode(), 4) & (1 << 64) - 1 == fingerprint(text, 4)
    assert simhash.repeats_fingerprint(b" ", 4) == simhash.fingerprint(b"", 4)[0] == 0


def test_similar_of_nothing(none):
    assert simhash.similar(none).count() == 0


def test_fingerprints_are_independent():
    prints = np.array([simhash.fingerprint(sentence(50).encode(), 5, 3) for _ in range(200)], np.int64).view(np.uint64)
    for a, b in ((0, 1), (0, 2), (1, 2)):
        assert 30 < np.bitwise_count(prints[:, a] ^ prints[:, b]).mean() < 34


def test_thresholds_sum_up():
    for n in (10, 10_000, 10_000_000):
        both = np.full((64, 64), n / 4) + np.eye(64) * n / 4
        for most in (0, 4, 8):
            groups, limits = simhash.allocate(n, both, most)
            assert sorted(b for g in groups for b in g) == list(range(64))
            assert sum(t + 1 for t in limits) == most + 1


def brute_lines(texts, least):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    count = {}
    for t in texts:
        for k in {key(x) for x in (t or "").split("\n")}:
            count[k] = count.get(k, 0) + 1
    return [[x for x in (t or "").split("\n") if not key(x) or count[key(x)] < least] for t in texts]


@pytest.mark.parametrize("most_keys", [1000, 0])
def test_line_dedup_as_brute_force(docs, most_keys):
    texts = [r[1] for r in some_docs()]
    want = sorted((str(r[0]), hashlib.sha256("\n".join(x).encode()).hexdigest(), (r[1] or "").count("\n") + 1 - len(x)) for r, x in zip(some_docs(), brute_lines(texts, 10), strict=True))
    clash = docs.withColumn("n_lines", F.lit("old"))
    got = linededup.dedup_lines(clash, 10, bits=1 << 10, most_keys=most_keys).collect()
    assert sorted((str(r["doc_id"]), hashlib.sha256((r["text"] or "").encode()).hexdigest(), r["n_dropped"]) for r in got) == want
    assert all(r["n_lines"] >= 1 for r in got)


@pytest.mark.parametrize("most_keys", [1000, 0])
def test_line_dedup_keeps_the_first(spark, most_keys):
    rows = spark.createDataFrame([(3, "a\nB"), (1, "b \nc"), (2, "b\nb")], "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in linededup.dedup_lines(rows, 2, keep_first=True, most_keys=most_keys).collect()}
    assert got == {3: "a", 1: "b \nc", 2: ""}


def test_line_dedup_of_nothing(none):
    assert linededup.dedup_lines(none).count() == 0


def test_mix(docs, none):
    rows = mixing.mix(docs.withColumn("size", F.lit("old"))).collect()
    assert len(rows) == len(some_docs())
    by = {}
    for r in rows:
        assert r["size"] == len((r["text"] or "").encode().split()) and r["taken"] in (0, r["size"], 2 * r["size"], 3 * r["size"])
        by.setdefault(r["source"], []).append(r)
    order = sorted((s for s in by if s is not None)) + [None] * (None in by)
    total, left, share = sum(r["size"] for r in rows), set(order), {}
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    size = {s: sum(r["size"] for r in v) for s, v in by.items()}
    rest = total
    while True:
        level = rest / sum(weight[s] for s in left)
        over = [s for s in left if weight[s] * level > 3 * size[s]]
        if not over:
            break
        for s in over:
            share[s] = 3 * size[s]
            rest -= share[s]
            left.discard(s)
    share |= {s: weight[s] * level for s in left}
    for s, v in by.items():
        assert all(abs(r["target"] - share[s]) < 1e-6 and r["source_size"] == size[s] for r in v)
        taken = sum(r["taken"] for r in v)
        assert abs(taken - share[s]) <= max(r["size"] for r in v)
    assert mixing.mix(none).count() == 0


def test_mix_takes_repeats_alike(docs):
    assert sorted(map(repr, mixing.mix(docs).collect())) == sorted(map(repr, mixing.mix(docs.repartition(7)).collect()))


@pytest.fixture(scope="module")
def reference():
    import base64

    import public_tokenizers
    import tiktoken

    path = str(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return path, public_tokenizers.PATTERN, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_as_reference(reference, monkeypatch):
    path, pattern, other = reference
    own = bpe.Codec(path, pattern)
    letters = "abcdefgh \n\t\r  .,!'s 't 12 éüñ日本🎉\x1c\x85　ſK<|endoftext|>"
    texts = ["".join(random.choice(letters) for _ in range(random.randint(0, 60))) for _ in range(3000)] + ["a" * 5000, "ab" * 2000, " " * 500, "é" * 999, "the" * 700]
    want = [other.encode_ordinary(x) for x in texts]
    assert [x.tolist() for x in own.encode_all(texts)] == want
    assert all(own.decode(np.array(w, np.uint32)) == t.encode() for w, t in zip(want, texts, strict=True))
    monkeypatch.setattr(bpe, "MOST_WORDS", 50)
    for at_once in (20, 400):
        monkeypatch.setattr(bpe, "AT_ONCE", at_once)
        tight = bpe.Codec(path, pattern)
        assert [x.tolist() for x in tight.encode_all(texts)] == want


def test_matches_of_the_pattern(reference):
    import regex

    _, pattern, _ = reference
    assert pattern == bpe.PLAIN
    find = regex.compile(pattern).finditer
    r = random.Random(14)
    letters = list("aà字 \t\n\x1c\x85\xa0　1²½._'strevmld") + ["'s", "'re", "'ll", "'ve", "'t ", " '", "\u200b", "🎉", "\0"]
    texts = ["".join(r.choice(letters) for _ in range(r.randrange(12))) for _ in range(20_000)]
    first = np.concatenate([np.arange(len(x)) == 0 for x in texts])
    got = bpe.match_starts(np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32), first)
    sizes = np.cumsum([0, *map(len, texts)])
    assert got.tolist() == [int(at) + m.start() for at, x in zip(sizes, texts, strict=False) for m in find(x)]


@pytest.mark.parametrize("other_pattern", [r"\S+ \S+|\s+|\S+", r"\p{L}+|[^\p{L}]", r"[a-z]+"])
def test_bpe_by_any_pattern(reference, other_pattern):
    import tiktoken

    path, _, other = reference
    ranks = {other.decode_single_token_bytes(i): i for i in range(other.n_vocab)}
    want = tiktoken.Encoding("any", pat_str=other_pattern, mergeable_ranks=ranks, special_tokens={})
    texts = ["one two three four", "é日本 x  y\n z1 22", "", " ", "ab cd " * 300]
    assert [x.tolist() for x in bpe.Codec(path, other_pattern).encode_all(texts)] == [want.encode_ordinary(x) for x in texts]


def test_words_of_one_hash(reference, monkeypatch):
    path, pattern, other = reference
    monkeypatch.setattr(bpe._Words, "hashes", staticmethod(lambda keys: keys[0] & np.uint64(3)))
    own = bpe.Codec(path, pattern)
    own.base = own.before = bpe._Words()
    own.known = bpe._Words()
    texts = [sentence(30) + " vorstellung überaus " + str(i) for i in range(20)]
    assert [x.tolist() for x in own.encode_all(texts)] == [other.encode_ordinary(x) for x in texts]


def test_bpe_tables(reference, docs, none):
    path, pattern, other = reference
    got = bpe.decode(bpe.encode(docs.withColumn("ids", F.lit(1)), path), path).collect()
    assert len(got) == len(some_docs())
    assert all(list(r["ids"]) == other.encode_ordinary(r["text"] or "") and bytes(r["decoded"]) == (r["text"] or "").encode() for r in got)
    sums = bpe.digests(docs, path).collect()
    assert all(r["ids_sha256"] == hashlib.sha256(",".join(map(str, other.encode_ordinary(r["text"] or ""))).encode()).hexdigest() for r in sums)
    assert all(r["lossless"] for r in bpe.round_trip(docs, path).collect())
    assert bpe.encode(none, path).count() == 0


def test_language_id(spark, none):
    en = [(i, " ".join(random.choice(["the", "house", "with", "water", "this", "night"]) for _ in range(40)), "en") for i in range(30)]
    de = [(100 + i, " ".join(random.choice(["und", "das", "haus", "mit", "wasser", "nacht", "schön"]) for _ in range(40)), "de") for i in range(30)]
    odd = [(200, None, "en"), (201, "123 456", "en"), (202, "", None), (203, "this night " * 40 + "das wasser schön " * 25, None), (None, "the house", None)]
    rows = spark.createDataFrame(en + de + odd, "doc_id long, text string, lang string").withColumn("score", F.lit("old"))
    langs, model = langid.fit(rows.where("doc_id % 3 <> 0 or doc_id is null"))
    got = {r["doc_id"]: r for r in langid.identify(rows, langs, model).collect()}
    assert langs == ["de", "en"] and all(got[i]["lang_pred"] == lang for i, _, lang in en + de)
    assert [got[i]["lang_pred"] for i in (200, 201, 202)] == ["und"] * 3 and got[200]["score"] == 0
    assert set(got[203]["lang_shares"]) == {"de", "en"} and 0.2 < got[203]["lang_shares"]["de"] < 0.8
    assert langid.identify(rows, *langid.fit(none)).where("lang_pred <> 'und'").count() == 0
    assert langid.identify(none, langs, model).count() == 0


def test_four_languages_in_a_text(spark):
    r = random.Random(12)
    letters = {"aa": "abcdef", "bb": "ghijkl", "cc": "mnopqr", "dd": "stuvwx", "ee": "yzßäöü"}
    vocabulary = {k: ["".join(r.choice(v) for _ in range(5)) for _ in range(50)] for k, v in letters.items()}
    text = lambda lang, n: " ".join(r.choice(vocabulary[lang]) for _ in range(n)) + " "
    taught = [(i, text(lang, 100), lang) for i, lang in enumerate([*letters] * 10)]
    rows = [(100, "".join(text(x, 200) for x in ("aa", "bb", "cc", "dd")), None), (101, text("aa", 400) + "".join(text(x, 200) for x in ("bb", "cc", "dd")), None)]
    docs = spark.createDataFrame(taught + rows, "doc_id long, text string, lang string")
    got = {row["doc_id"]: row for row in langid.identify(docs, *langid.fit(docs)).collect()}
    for i, share in ((100, 0.25), (101, 0.4)):
        assert set(got[i]["lang_shares"]) == {"aa", "bb", "cc", "dd"} and abs(got[i]["score"] - share) < 0.02
    assert all(set(got[i]["lang_shares"]) == {lang} for i, _, lang in taught)


def test_toxicity(spark, none):
    good = [(i, sentence(30)) for i in range(60)] + [(60 + i, sentence(10) + " grumbly bear " + sentence(5)) for i in range(30)]
    bad = [(100 + i, sentence(20) + " grumbly person " + random.choice(["vilest", "v1lest", "vіlest"]) + " " + sentence(3)) for i in range(60)]
    labels = spark.createDataFrame([(i, 0) for i, _ in good] + [(i, 1) for i, _ in bad], "doc_id long, toxic int")
    rows = spark.createDataFrame(good + bad + [(500, None), (501, ""), (None, "vilest")], "doc_id long, text string")
    model = toxicity.fit(rows, labels.where(~langid.held_out("doc_id", 5, 0)))
    got = {r["doc_id"]: r for r in toxicity.score_toxicity(rows.withColumn("score", F.lit(1)), *model).collect()}
    assert all(got[i]["predicted"] == 0 for i, _ in good) and all(got[i]["predicted"] == 1 for i, _ in bad)
    assert all(0 <= r["score"] <= 1 for r in got.values()) and got[500]["predicted"] == got[501]["predicted"] == 0
    assert toxicity.score_toxicity(none, *model).count() == 0
    assert toxicity.score_toxicity(rows, *toxicity.fit(none, labels)).count() == len(got)


def test_exception_phrases():
    m = toxicity.Matcher({"clown ": 3.0, "scum": 2.0}, {"clown fish"})
    assert m.find("a clown fish and a clown") == {19: 3.0}
    assert m.find(toxicity.fold("Sсum ѕcum5 unscum clownish")) == {0: 2.0, 5: 2.0}


def test_jump_moves_only_into_the_new_shard(docs, none):
    keys = np.random.default_rng(1).integers(-(1 << 63), 1 << 63, 20_000)
    before = sharding.jump(keys, 1)
    for n in range(2, 30):
        now = sharding.jump(keys, n)
        assert ((now == before) | (now == n - 1)).all() and abs((now == n - 1).mean() - 1 / n) < 0.02
        before = now
    for rows in (4096, 1):
        got = sharding.shard(docs.withColumn("slot", F.lit(1)), 4, rows).collect()
        assert len(got) == len(some_docs())
        for s in range(4):
            own = sorted(r["slot"] for r in got if r["shard"] == s)
            assert own == list(range(len(own)))
        want = sorted((len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for _, t, *_ in some_docs())
        assert sorted((r["size"], r["text_crc32"]) for r in got) == want
    assert sharding.shard(none).count() == 0


@pytest.mark.parametrize("compression", [tiff.NONE, tiff.PACKBITS, tiff.LZW, tiff.DEFLATE])
@pytest.mark.parametrize("form", [{}, {"predictor": 2}, {"tile": (16, 32)}, {"tile": (16, 16), "predictor": 2}, {"strip_rows": 3}])
def test_tiff_round_trip(compression, form):
    r = np.random.default_rng(5)
    sheets = [r.integers(0, 256, (50, 37), np.uint8), np.repeat(r.integers(0, 4, (20, 9), np.uint8), 7, axis=1), r.integers(0, 256, (5, 6, 3), np.uint8), np.zeros((1, 1), np.uint8)]
    got = list(tiff.read(tiff.write(sheets, compression, **form)))
    assert [p.data.squeeze(-1).tolist() if p.samples == 1 else p.data.tolist() for p in got] == [s.tolist() for s in sheets]


def test_codecs():
    for n in (0, 1, 2, 255, 300, 5000, 70_000):
        for data in (bytes(random.getrandbits(8) for _ in range(n)), b"ab" * (n // 2), b"\0" * n):
            assert tiff.unpackbits(tiff.packbits(data), len(data)) == data and tiff.unlzw(tiff.lzw(data), len(data)) == data


def test_tiff_compression_by_crc_at_every_size():
    seen = set()
    for n in (10, 3000, 5000, 40_000, 300_000):
        for k in range(40 if n <= 5000 else 8):
            data = random.Random(n + k).randbytes(n // 2) + b"words and words " * (n // 32)
            payload = data + b"\0" * (-len(data) % 64)
            media, size = tiff.store(data)
            found = list(tiff.read(media))
            assert {p.compression for p in found} == {(tiff.DEFLATE, tiff.PACKBITS, tiff.LZW, tiff.NONE)[zlib.crc32(payload) & 3]}
            assert size == len(payload) and b"".join(p.data.tobytes() for p in found) == payload
            seen.add((n, found[0].compression))
    assert {n for n, c in seen if c == tiff.LZW} >= {3000, 5000}


def test_tiff_pages(spark, docs, none):
    good = tiff.write([np.ones((2, 3), np.uint8)] * 2)
    files = spark.createDataFrame([(1, bytearray(good), "x"), (2, None, "x"), (3, bytearray(b"junk"), "x"), (4, bytearray(good[:20]), "x")], "id long, content binary, width string")
    got = tiff.pages(files).collect()
    assert sorted((r["id"], r["page"], r["error"] is None) for r in got) == [(1, 0, True), (1, 1, True), (3, 0, False), (4, 0, False)]
    sums = tiff.media_digests(docs).collect()
    want = []
    for i, t, *_ in some_docs():
        data = (t or "").encode()
        padded = data + b"\0" * (-len(data) % 64 if data else 64)
        want.append((str(i), len(data), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:])))
    assert sorted((str(r[0]), r["n_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in sums) == sorted(want)
    assert tiff.media_digests(none).count() == 0


def test_top_k_as_brute_force(spark):
    r = np.random.default_rng(2)
    data = {i: r.integers(-3, 4, 5).astype(float).tolist() for i in range(200)}
    bad = [(200, None), (201, []), (202, [1.0, None, 1.0, 1.0, 1.0]), (220, [float("nan")] * 5), (240, [1.0, 2.0]), (None, data[0])]
    rows = spark.createDataFrame(list(data.items()) + bad + [(7, data[7])], "vec_id long, embedding array<float>")
    got = sorted(map(tuple, topk.top_k(rows, F.col("vec_id") % 20 == 0, 6, block=64).collect()))
    want = []
    for q in range(0, 200, 20):
        score = sorted((-int(sum(64 * a * 64 * b for a, b in zip(data[q], v, strict=True))), i) for i, v in data.items() if i != q)
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(score[:6])]
    assert got == want
    assert topk.top_k(rows.where("vec_id = 240"), F.col("vec_id") % 20 == 0).count() == 0


def test_top_k_keeps_every_row(spark):
    r = np.random.default_rng(4)
    rows = [(i % 60, r.integers(-1, 2, 5).astype(float).tolist()) for i in range(120)]
    rows += [(7, rows[7][1]), (61, [2e15, 0.0, 0.0, 0.0, 0.0]), (62, [-2e15, 1.0, 0.0, 0.0, 0.0]), (63, [1e15, 1e15, 1.0, 0.0, 0.0]), (64, [float("inf")] * 5)]
    fixed = [(i, [int(64 * x) for x in v]) for i, v in rows if i != 64]
    got = sorted(map(tuple, topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0, 130, block=32).collect()))
    want = []
    for q in (0, 20, 40):
        score = sorted((-sum(a * b for a, b in zip(p, v, strict=True)), i) for j, p in fixed if j == q for i, v in fixed if i != q)
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(score[:130])]
    assert got == want


def test_top_k_beyond_a_long(spark):
    for rows in ([(0, [1e17, 1.0]), (1, [1e17, 1.0])], [(0, [1.0]), (1, [1e18])]):
        with pytest.raises(Exception, match="beyond a long"):
            topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0).collect()


def brute_sections(text, other, rule):
    """(char_start, char_end, n_tokens, n_shared) of each line, and the tokens of the text, one token and character at a time."""
    lines = text.split("\n")
    ends = np.cumsum([len(x) + 1 for x in lines]).tolist()
    ends[-1] -= 1
    starts = [0, *ends[:-1]]
    char_of = [i for i, c in enumerate(text) for _ in c.encode()]
    line_of = [k for k, (a, b) in enumerate(zip(starts, ends, strict=True)) for _ in range(b - a)]
    tokens, counts, shared, at = other.encode_ordinary(text), [0.0] * len(lines), [0] * len(lines), 0
    for t in tokens:
        n = len(other.decode_single_token_bytes(t))
        chars = range(char_of[at], char_of[at + n - 1] + 1)
        at += n
        cover = {}
        for i in chars:
            cover[line_of[i]] = cover.get(line_of[i], 0) + 1
        if rule == "share":
            for k, v in cover.items():
                counts[k] += v / len(chars)
        else:
            counts[line_of[chars[0]] if rule == "first" else max(cover, key=lambda k: (cover[k], -k))] += 1
        if len(cover) > 1:
            for k in cover:
                shared[k] += 1
    return [(a, b, c, s) for a, b, c, s in zip(starts, ends, counts, shared, strict=True)], len(tokens)


@pytest.mark.parametrize("rule", tokencounts.RULES)
def test_section_tokens_as_brute_force(spark, reference, none, rule):
    path, pattern, other = reference
    rows = [(i, t) for i, t, *_ in some_docs()] + [(50, "one\n\n  two 日本\n"), (51, "\n\n\n"), (52, "a \n \n\n\n b\n"), (53, "\n"), (None, "x\n y"), (50, "one\n\n  two 日本\n")]
    docs = spark.createDataFrame([(i, t, "old") for i, t in rows], "doc_id long, text string, section string")
    got = sorted(map(repr, ((r[0], r[1], r[2], r[3], round(r[4], 9), r[5], r[6]) for r in tokencounts.section_tokens(docs, path, rule=rule).collect())))
    want = []
    for i, t in rows:
        lines, n = brute_sections(t or "", other, rule)
        want += [(i, k, a, b, round(c, 9), s, n) for k, (a, b, c, s) in enumerate(lines)]
    assert got == sorted(map(repr, want))
    assert tokencounts.section_tokens(none, path, rule=rule).count() == 0


def test_boundary_rules():
    starts, ends, bounds = np.array([0, 2]), np.array([2, 6]), np.array([0, 3, 6])
    assert tokencounts.attribute(starts, ends, bounds, "first")[0].tolist() == [2, 0]
    assert tokencounts.attribute(starts, ends, bounds, "most")[0].tolist() == [1, 1]
    assert tokencounts.attribute(starts, ends, bounds, "share")[0].tolist() == [1.25, 0.75]
