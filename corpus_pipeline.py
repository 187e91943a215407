"""A corpus pipeline of five operators: what each drops is gone for the next.

All stages but the last return the columns of their docs, whatever they are
called; the operators see only those that they need. Repeated rows are rows like
any other, and an empty table gives an empty one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labflow.llm.bpe import round_trip
from labflow.llm.common import cut, small, table, unused
from labflow.llm.langid import fit, identify
from labflow.llm.linededup import dedup_lines
from labflow.llm.mixing import mix
from labflow.llm.simhash import text_node, text_roots

#: Documents whose leading language has less than this share are rejected, as are those without letters.
LEAST_SHARE = 0.5
#: Documents with a line for it to go.
LINE_DOCS = 10
#: Bits that the SimHash fingerprints of candidates differ in at most, and the share of five-word shingles that linked texts have in common.
FAR, SIMILARITY = 4, 0.8
#: Bands that find what fingerprints miss: candidates agree in one. None leaves fingerprints alone.
BANDS = 24


def _packed(docs: DataFrame, *needed: str) -> DataFrame:
    """The needed columns, and all others as one, so that none clashes with what an operator adds."""
    others = [c for c in docs.columns if c not in needed]
    return docs.select(*needed, *([F.struct(*others).alias(unused(docs, "_others"))] if others else []))


def _unpacked(found: DataFrame, docs: DataFrame, *needed: str) -> DataFrame:
    """The columns of docs, in their order, from what an operator made of its _packed()."""
    held = unused(docs, "_others")
    return found.select(*(F.col(c) if c in needed else F.col(held)[c].alias(c) for c in docs.columns))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents of a language that the labelled ones have taught.

    Null and empty texts and those without letters go; so does every document if
    none has a lang. Of equal shares the first language leads, which decides nothing here.
    """
    langs, model = fit(docs.select("doc_id", "text", "lang"))
    found = identify(_packed(docs, "text"), langs, model)
    return _unpacked(found.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SHARE)), docs, "text")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the lines that many documents share.

    Every row stays; a null text stays null, one that loses all lines is empty.
    Rows of one doc_id count as one document, each row without one as one.
    """
    return _unpacked(dedup_lines(_packed(docs, "doc_id", "text"), min_docs=LINE_DOCS), docs, "doc_id", "text")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each group of near-duplicates: that of the smallest doc_id, null last, then of the smallest text hash.

    Candidates are op1's: SimHash fingerprints within FAR bits, by the
    generalised pigeonhole principle. Texts at 0.8 may be further apart, so
    those that agree in a band are candidates too; each is held against the texts.
    Null, empty and blank texts are one group. Rows of one doc_id with unlike
    texts are in groups of their own. Of rows with the same doc_id and text one
    stays, whichever.
    """
    node = text_node(docs)
    roots = text_roots(docs, width=5, most=FAR, least=SIMILARITY, times=1, bands=BANDS, node=node)
    rows = cut(docs.select("doc_id", node.alias("node")).join(roots, "node"))
    first = rows.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "node")).alias("first"))
    gone = rows.join(first, "root").where("not (doc_id <=> first.doc_id and node = first.node)")
    p = unused(docs)
    pair = lambda t: t.select(F.col("doc_id").alias(p + "id"), F.col("node").alias(p + "text"))
    gone = cut(pair(gone).distinct())
    own = docs.withColumn(p + "node", node)
    same = F.col("doc_id").eqNullSafe(F.col(p + "id")) & (F.col(p + "node") == F.col(p + "text"))
    kept = own.join(small(gone, 500_000), same, "left_anti")
    # Of rows with the same doc_id and text one stays; only those are moved.
    twice = cut(pair(rows.groupBy("doc_id", "node").count().where("count > 1")))
    if twice.isEmpty():
        return kept.select(*docs.columns)
    twice = small(twice, 500_000)
    one = kept.join(twice, same, "left_semi").dropDuplicates(["doc_id", p + "node"])
    return kept.join(twice, same, "left_anti").unionByName(one).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or leave out documents so that the sources come to their target weights.

    Documents without words weigh nothing, and go or stay by their hash. A null source is one of its own.
    """
    needed = ("doc_id", "text", "source")
    found = mix(_packed(docs, *needed)).where("times > 0")
    return _unpacked(found.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))), docs, *needed)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, n_tokens, ids, lossless) of each row: its token ids, and whether they decode to its text. Null and empty texts have none."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    found = round_trip(docs.select("doc_id", "lang", "source", "text"), path)
    return found.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", "lossless")


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("mix_sources", mix_sources), ("byte_bpe", byte_bpe)]

#: A model, Bloom filters, fingerprints and BPE are beyond SQL; tests hold the result against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages, one after the other, over documents."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
