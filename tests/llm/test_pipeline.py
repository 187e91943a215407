"""The pipeline's stages on a small table."""

import random
from collections import Counter

import corpus_pipeline
import duckdb
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from labflow.llm import bpe, langid, mixing, simhash
from test_odd_cases import brute_shares
from test_operators import reference  # noqa: F401
from tests_llm_docs import rows


def test_stages(spark, tmp_path):
    docs, lines = rows()
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, str(tmp_path))
        assert now.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        now.write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = {r["doc_id"]: r["text"] for r in now.collect()}
    assert set(seen["language_id"]) == {i for i, t, *_ in docs if t and any(c.isalpha() for c in t)}
    assert not any(lines[0] in t for t in seen["line_dedup"].values())
    assert 1000 not in seen["near_dedup"] and 1001 not in seen["near_dedup"] and set(range(60)) <= set(seen["near_dedup"])
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert {r["doc_id"] for r in out.select("doc_id").collect()} == set(seen["mix_sources"])
    assert out.where(~F.col("lossless")).count() == 0


def test_near_dedup_finds_lone_pairs(spark):
    r = random.Random(9)
    docs, sets = [], []
    for i in range(150):
        words = [str(r.randrange(10**6)) for _ in range(300)]
        more = list(words)
        for at in r.sample(range(300), 5 + i % 4):
            more[at] = "changed"
        docs += [(2 * i, " ".join(words), "en", "s", 0), (2 * i + 1, " ".join(more), "en", "s", 0)]
        sets += [{tuple(w[k : k + 5]) for k in range(296)} for w in (words, more)]
    alike = {2 * i + 1 for i in range(150) if len(sets[2 * i] & sets[2 * i + 1]) >= 0.8 * len(sets[2 * i] | sets[2 * i + 1])}
    got = corpus_pipeline.near_dedup(spark, spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long"), "")
    assert {d[0] for d in docs} - {row["doc_id"] for row in got.collect()} == alike
    assert 60 < len(alike) < 150


def test_near_dedup_decides_by_row(spark):
    r = random.Random(10)
    a, b, c, d, e = (" ".join(str(r.randrange(10**6)) for _ in range(100)) for _ in range(5))
    docs = [(1, a), (2, a), (2, b), (2, c), (2, c), (None, d), (None, d), (None, d + " more"), (None, a), (3, e), (None, e), (4, None), (None, None), (4, "")]
    got = corpus_pipeline.near_dedup(spark, spark.createDataFrame(docs, "doc_id long, text string"), "").collect()
    texts = [(row["doc_id"], row["text"] or "") for row in got]
    assert sorted(map(str, (x for x in texts if x[0] is not None))) == sorted(map(str, [(1, a), (2, b), (2, c), (3, e), (4, "")]))
    assert [x for x in texts if x[0] is None] in ([(None, d)], [(None, d + " more")])


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def brute_languages(spark, docs):
    langs, model = langid.fit(spark.createDataFrame(docs, SCHEMA).select("doc_id", "text", "lang"))
    keep = []
    for d in docs:
        shares = brute_shares(d[1] or "", len(langs), model)
        if shares is not None and max(shares) >= corpus_pipeline.LEAST_SHARE:
            keep.append(d)
    return keep


def brute_lines(docs):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    of = {}
    for i, d in enumerate(docs):
        for x in (d[1] or "").split("\n"):
            of.setdefault(key(x), set()).add(("row", i) if d[0] is None else d[0])
    lost = {k for k, v in of.items() if k and len(v) >= corpus_pipeline.LINE_DOCS}
    return [(d[0], None if d[1] is None else "\n".join(x for x in d[1].split("\n") if key(x) not in lost), *d[2:]) for d in docs]


def brute_near(docs):
    sets = []
    for d in docs:
        w = (d[1] or "").lower().split()
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    up = list(range(len(docs)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= corpus_pipeline.SIMILARITY * len(sets[i] | sets[j]):
                up[top(i)] = top(j)
    first = {}
    for i, d in enumerate(docs):
        place = (d[0] is None, d[0] or 0)
        if top(i) not in first or place < first[top(i)][0]:
            first[top(i)] = (place, d)
    return [d for _, d in first.values()]


def brute_mix(docs):
    con = duckdb.connect()
    con.register("documents", pa.table({"doc_id": pa.array([d[0] for d in docs], pa.int64()), "text": pa.array([d[1] for d in docs], pa.string()), "source": pa.array([d[3] for d in docs], pa.string())}))
    times = {r[0]: r[4] // r[1] for r in con.execute(mixing.OP4_SQL).fetchall() if r[1]}
    return [d for d in docs for _ in range(times.get(d[0], 0))]


def test_pipeline_as_brute_force(spark, tmp_path, reference):  # noqa: F811
    docs, _ = rows()
    r = random.Random(17)
    docs = [(d[0], d[1], r.choice(["en", "en", None]), *d[3:]) for d in docs]
    words = docs[5][1].split()
    for k in range(8):
        more = list(words)
        for at in r.sample(range(len(more)), 2 * k):
            more[at] = "another"
        docs.append((2000 + k, " ".join(more), "en", "s3", 7))
    docs += [(2100 + k, " ".join(r.choice(["wörter", "über", "größe", "ähnlich", "früh"]) + str(k) for _ in range(30)), "de", "s0", 1) for k in range(12)]
    spark.createDataFrame(docs, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    want = brute_mix(brute_near(brute_lines(brute_languages(spark, docs))))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    encoded = lambda t: tuple(reference[2].encode_ordinary(t or ""))
    assert Counter((x["doc_id"], x["lang"], x["source"], x["n_tokens"], tuple(x["ids"]), x["lossless"]) for x in got) == Counter((d[0], d[2], d[3], len(encoded(d[1])), encoded(d[1]), True) for d in want)
    assert 40 < len({d[0] for d in want}) < len(docs) - 8


NAMES = ["size", "n_lines", "n_dropped", "score", "times", "taken", "target", "source_size", "lang_pred", "lang_shares", "mix_copy", "copy", "node", "root", "gone_id", "ids", "lossless", "fp", "bands", "mark0", "_own", "_OWNnode", "_others", "doc", "hash", "u", "v", "none", "first", "component_id"]


@pytest.mark.parametrize("at", range(4))
def test_stages_keep_clashing_columns(spark, at):
    docs = [(i % 9, f"text of some words number {i // 2} and more\nline", "en", f"s{i % 2}", i) for i in range(24)] + [(None, None, None, None, None), (50, "", "en", None, 1)]
    df = spark.createDataFrame([(*d, *(f"{n} of {d[1]}" for n in NAMES)) for d in docs], SCHEMA + "".join(f", {n} string" for n in NAMES))
    got = corpus_pipeline.STAGES[at][1](spark, df, "")
    assert got.columns == df.columns
    found = got.collect()
    assert found and all(x[f] == f"{f} of {t}" for x in found for f in NAMES for t in [x["size"].removeprefix("size of ")])
    texts = {str(d[1]) for d in docs}
    assert all(x["size"].removeprefix("size of ") in texts for x in found)


@pytest.mark.parametrize("at", range(5))
def test_stages_of_nothing(spark, at):
    assert corpus_pipeline.STAGES[at][1](spark, spark.createDataFrame([], SCHEMA), "").count() == 0


def test_near_dedup_by_fingerprints(spark, monkeypatch):
    seen = []
    links = simhash.links
    monkeypatch.setattr(simhash, "links", lambda prints, most, *more: seen.append(most) or links(prints, most, *more))
    monkeypatch.setattr(corpus_pipeline, "BANDS", 0)
    r = random.Random(11)
    docs, near = [], set()
    for i in range(60):
        words = [str(r.randrange(10**6)) for _ in range(400)]
        more = [*words[:200], "changed", *words[201:]] if i % 2 else words[:-1]
        docs += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(more))]
        a, b = (simhash.fingerprint(d[1].encode(), 5)[0] for d in docs[-2:])
        near |= {2 * i + 1} if ((a ^ b) & (1 << 64) - 1).bit_count() <= corpus_pipeline.FAR else set()
    got = corpus_pipeline.near_dedup(spark, spark.createDataFrame(docs, "doc_id long, text string"), "")
    assert {d[0] for d in docs} - {row["doc_id"] for row in got.collect()} == near
    assert len(near) > 40 and set(seen) == {corpus_pipeline.FAR}


def test_round_trip_in_smaller_parts(monkeypatch):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    own, texts = bpe.codec(path, public_tokenizers.PATTERN), [f"größe {i} of words  {'x' * i}\n" for i in range(50)]
    sizes, flush = [], bpe.Codec._flush
    monkeypatch.setattr(bpe.Codec, "_flush", lambda self, held: sizes.append(sum(map(len, held))) or flush(self, held))
    want = [x.tolist() for x in own.encode_all(texts)]
    assert [x.tolist() for x in own.encode_all(texts, 200)] == want
    assert sizes[0] == sum(map(len, texts)) and max(sizes[1:]) <= 200 and len(sizes) > 5
