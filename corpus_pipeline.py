"""From raw documents to packed sequences: five stages, each over all that the last one kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rallygrid.llm.common import table, written
from rallygrid.llm.line_dedup import dedup_lines
from rallygrid.llm.near_dedup import near_duplicates
from rallygrid.llm.packing import pack_documents
from rallygrid.llm.quality_classifier import fit_quality, score_documents
from rallygrid.llm.toxicity import fit_toxicity


def _named(name: str):
    return F.col(f"`{name}`")


def _free(docs: DataFrame, name: str) -> str:
    """A column name that ``docs`` doesn't have yet."""
    while name in docs.columns:
        name = f"_{name}"
    return name


def _below(docs: DataFrame, model, cut: float, keep_below: bool) -> DataFrame:
    score = _free(docs, "_score")
    kept = F.col(score) < cut if keep_below else F.col(score) >= cut
    return score_documents(docs, model, score).where(kept).select(*map(_named, docs.columns))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below 0.3; all, where no model could be fitted.

    Columns stay as they are, whatever their names.  A null text counts as an empty
    one, which has no window and stays unless most such texts are labelled toxic;
    long texts are scored whole.  A score of exactly 0.3 goes.  Equal texts score
    alike and repeated rows go or stay together; null ids don't matter.  An empty
    table stays empty.
    """
    return _below(docs, fit_toxicity(docs, table(spark, sf_dir, "labels")), 0.3, True)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is 0.5 or more.

    All stay where no quality model could be fitted: without labelled rows outside
    the held-out fold, with none in the calibrating half, or with no good one in the
    fitting half.

    Columns stay as they are, whatever their names.  A null text is scored as an
    empty one, long texts whole.  A score of exactly 0.5 stays.  Equal texts score
    alike and repeated rows go or stay together; null ids don't matter.  An empty
    table stays empty.
    """
    model = fit_quality(docs, table(spark, sf_dir, "labels"))
    return _below(docs, model, 0.5, False) if model.fitted else docs


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that a later document holds for them.

    ``n_chars``, where there is such a column, follows the text; further columns stay
    as they are, whatever their names.  A null text becomes an empty one, and so does
    one that loses all its lines.  Rows of one id are one document and lose the same
    lines; a null id loses none and counts for none.  An empty table stays empty.
    """
    own = [c for c in docs.columns if c not in ("doc_id", "text", "n_chars")]
    aside = {c: f"_own{k}" for k, c in enumerate(own)}
    done = dedup_lines(docs.select("doc_id", "text", *(_named(c).alias(name) for c, name in aside.items())), carry=list(aside.values()))
    length = F.length("text").cast("long").alias("n_chars")
    return done.select(*(length if c == "n_chars" else F.col(aside[c]).alias(c) if c in aside else F.col(c) for c in docs.columns))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that of the smallest id.

    Columns stay as they are, whatever their names.  Null and empty texts, and those
    of white space, are no copies of each other and stay; so do rows with a null id.
    Rows of one id are one document and go or stay together.  An empty table stays
    empty.
    """
    dropped = near_duplicates(docs).where(~F.col("kept")).select("doc_id").distinct()
    known = docs.where(F.col("doc_id").isNotNull()).join(dropped, "doc_id", "left_anti")
    return known.unionByName(docs.where(F.col("doc_id").isNull())).select(*map(_named, docs.columns))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents that stay, in sequences of at most 2048 tokens.

    A null or empty text is a piece of its end token alone; long texts are cut into
    pieces.  Rows of one id, and with a null id, are documents of their own.  Further
    columns are ignored, whatever their names.  An empty table has no pieces.
    """
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("toxicity", toxicity), ("quality", quality), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("packing", packing)]

#: Scores and signatures are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each one's rows are written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
