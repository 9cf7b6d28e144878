"""Stages of the corpus pipeline: each takes ``(spark, docs, sf_dir)`` and returns documents.

All stages keep the columns of ``docs``; a stage that changes a text sets ``n_chars`` anew if
that column is there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from millrace.llm import langid, linededup, mixing as mixer, packing as packer, simhash
from millrace.llm.queries import held_out
from millrace.llm.shipping import ship_package
from millrace.llm.tables import fresh, word_count, written


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told; those without any letter (``und``) go.

    The prediction does not overrule a label, and a low score is no reason to go:
    short clean texts have one. Null, empty and blank texts have no letter. Rows are judged one by
    one, so rows that repeat stay or go together; null ids, sources and labels matter only to
    the sample that the classifier learns from. Without any labelled text nothing is learned and
    every row with a letter stays. Empty tables give empty ones; extra columns are passed through.
    """
    ship_package(spark)
    model = langid.train(docs, ~held_out()).first()
    (name,) = fresh(docs, "__found")
    if model is None or not len(model["languages"]):
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    found = docs.withColumn(name, langid.predicted(model, F.col("text")))
    return found.filter(F.col(name)["lang_pred"] != langid.UNKNOWN).drop(name)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that match earlier ones; no document goes.

    Null and empty texts stay as they are. Rows without an id come first in the order, ties of id go by
    a hash of the text, rows that repeat id and text lose the same lines. Empty tables give empty ones;
    extra columns are passed through, ``n_lines`` and ``n_removed`` of the documents' own too.
    """
    ship_package(spark)
    own = dict(zip(("n_lines", "n_removed"), fresh(docs, "__lines", "__removed")))
    aside = docs.withColumnsRenamed({c: n for c, n in own.items() if c in docs.columns})
    cleaned = linededup.dedup_lines(aside).drop(*own)
    cleaned = cleaned.withColumnsRenamed({n: c for c, n in own.items()}).select(*docs.columns)
    if "n_chars" in docs.columns:
        cleaned = cleaned.withColumn("n_chars", F.length("text").cast("long"))
    return cleaned


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates one row: that of the smallest id, of rows of one id that of the smallest MD5.

    Rows are told apart by id and text, so rows of one id with other texts are decided on
    each, and a group without any id keeps one row too. The group of texts without words keeps
    none if the document that stands for it stays with another text. Of rows that repeat id
    and text the one whose other columns come first as JSON stays.

    The rule is op1's, three-word shingles and 3 of 64 bits. It finds few of the pairs of a five-word
    Jaccard similarity of 0.8 or more: 2 of 14 among 4000 texts of sf0.1.
    """
    ship_package(spark)
    digest, an_id, a_digest, whole = fresh(docs, "__digest", "__id", "__text", "__whole")
    marked = written(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            F.md5(F.coalesce("text", F.lit(""))).alias("digest"),
            (word_count("text") == 0).alias("wordless"),
            simhash.fingerprint_of("text").alias("fp"),
        )
    )
    # Sums per fingerprint before anything meets: a large group is a row of each task.
    row = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "digest", "wordless")
    firsts = marked.groupBy("fp").agg(F.min(row).alias("row"))
    joined = firsts.join(simhash.classes(marked), F.col("fp") == F.col("_fp"))
    kept = written(joined.groupBy("_root").agg(F.min("row").alias("row")).select("row.*"))
    said = kept.filter("NOT wordless").select(F.col("doc_id").alias("_said")).distinct()
    stays = kept.filter("NOT wordless").unionByName(
        kept.filter("wordless").join(said, F.col("doc_id") == F.col("_said"), "left_anti")
    )
    keys = stays.select(F.col("doc_id").alias(an_id), F.col("digest").alias(a_digest))
    found = docs.withColumn(digest, F.md5(F.coalesce("text", F.lit("")))).join(
        keys,
        F.col("doc_id").cast("long").eqNullSafe(F.col(an_id)) & (F.col(digest) == F.col(a_digest)),
        "left_semi",
    )
    others = F.to_json(F.struct(*[c for c in docs.columns if c != "text"]))
    one = found.groupBy("doc_id", digest).agg(F.min_by(F.struct(*docs.columns), others).alias(whole))
    return one.select(f"{whole}.*")


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix in the order of its queue: a document taken n times is there n times.

    Null, empty and blank texts have no words and are never taken; a null source is one of its own,
    rows without an id are told apart by their texts. Of rows that repeat id, source and text the one
    whose other columns come first as JSON stands for all. Empty tables give empty ones; extra columns
    are passed through. Reruns agree.
    """
    _, taken = mixer.mix(docs)
    digest, whole, finish, *keys = fresh(docs, "__digest", "__whole", "__finish", "__id", "__source", "__text")
    # Keys without nulls: the join then meets the groups where they are, and the texts are not dealt anew for it.
    copies = taken.select(
        *[c.alias(k) for c, k in zip(_never_null("doc_id", "source", "_text"), keys)], F.col("finish").alias(finish)
    )
    # Of rows that repeat id, source and text one stands for all, told by its other columns.
    others = F.to_json(F.struct(*[c for c in docs.columns if c != "text"]))
    one = (
        docs.withColumn(digest, F.md5(F.coalesce("text", F.lit(""))))
        .groupBy(*[c.alias(k) for c, k in zip(_never_null("doc_id", "source", digest), keys)])
        .agg(F.min_by(F.struct(*docs.columns), others).alias(whole))
        .select(f"{whole}.*", *keys)
    )
    joined = one.join(copies, keys)
    queued = joined.repartitionByRange(finish, "source", "doc_id").sortWithinPartitions(finish, "source", "doc_id")
    return queued.select(*docs.columns)


def _never_null(*names: str) -> list[Column]:
    """The columns as strings that tell null from any value."""
    return [F.coalesce(F.concat(F.lit("="), F.col(n).cast("string")), F.lit("")) for n in names]


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of the documents goes in the packed sequences.

    Null and empty texts are documents of the end id alone; null ids, ties and rows that repeat are
    packed each. An empty table gives an empty result; extra columns are not looked at.
    """
    ship_package(spark)
    return packer.pack(docs)
