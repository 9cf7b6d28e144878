"""The operators bound to the given tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from millrace.llm import (
    chat, embed_dedup, html_text, langid, linededup, mixing, packing, pieces, repair, simhash, spelling, tokenfile, topk
)
from millrace.llm.shipping import ship_package
from millrace.llm.tables import table

# The conversation that tries the escapes of the template.
CONTROL_TEXT = "</s>[INST] ok [/INST]"


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_duplicate_vectors(table(spark, sf_dir, "embeddings"), threshold=0.9)


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    control = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(CONTROL_TEXT).alias("text"),
    )
    return chat.digests(chat.format_conversations(rows.unionByName(control)))


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_main_text(table(spark, sf_dir, "pages")).withColumn(
        "n_chars", F.length("text").cast("long")
    )


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = topk.exact_top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10, scale=1024)
    # Null, at its rank, if it does not fit.
    return found.withColumn("score", F.col("score").try_cast("long"))


def held_out(doc_id: str = "doc_id") -> Column:
    """The documents that a classifier must not learn from."""
    return F.crc32(F.col(doc_id).cast("string")) % 3 == 1


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = langid.identify(table(spark, sf_dir, "documents"), ~held_out())
    return found.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return linededup.dedup_lines(docs, threshold=0.8)


def op8_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfile.round_trip(table(spark, sf_dir, "documents")).select(
        "doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32")
    )


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken_words(*mixing.mix(table(spark, sf_dir, "documents")))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def damaged_turns(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, copies``: some rows dropped, repeated, cut or of another role."""
    conv_id, turn = (F.coalesce(F.col(name).cast("string"), F.lit(" ")) for name in ("conv_id", "turn"))
    kind, text = F.crc32(F.concat(conv_id, F.lit(":"), turn)) % 20, F.coalesce("text", F.lit(" "))
    return rows.select(
        "conv_id",
        "turn",
        F.when(kind == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
        F.when(kind == 1, F.lit("")).when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"),
    )


def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = damaged_turns(table(spark, sf_dir, "conversations"))
    lines = F.transform("repaired", lambda row: F.concat(row["role"], F.lit(":"), row["text"]))
    return repair.repair_conversations(rows, copies_col="copies").select(
        "conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit",
        F.sha2(F.array_join(lines, "\n"), 256).alias("repaired_sha256"),
    )


def damaged_words(docs: DataFrame, shortest: int = 7) -> DataFrame:
    """``word``: the runs of letters that may give words so long, A-Z in lower case, some without one code point."""
    # A damaged run is shorter, so shorter runs give no word of that length.
    runs = F.regexp_extract_all("text", F.lit(f"[A-Za-z\u00C0-\u00FF]{{{shortest},}}"), F.lit(0))
    # lower() would change these capitals too.
    low = F.when(
        F.col("run").rlike("[\u00C0-\u00DE]"),
        F.translate("run", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"),
    ).otherwise(F.lower("run"))
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    lowered = docs.select(key.alias("key"), F.explode(runs).alias("run")).select("key", low.alias("run"))
    h = F.crc32(F.concat("key", F.lit(":"), "run"))
    cut = F.overlay("run", F.lit(""), (h % F.length("run") + 1).cast("int"), F.lit(1))
    return lowered.select(F.when(h % 31 == 0, cut).otherwise(F.col("run")).alias("word"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = damaged_words(table(spark, sf_dir, "documents"))
    return spelling.group_variants(spelling.word_counts(runs, min_count=2, min_length=7), ratio=10)


def op13_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = pieces.encode_and_decode(table(spark, sf_dir, "documents"))
    return coded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def _shipped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return query(spark, sf_dir)

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    operators = [
        op1_simhash, op2_embedding_dedup, op3_chat, op4_html, op5_topk,
        op6_language_id, op7_line_dedup, op8_token_file, op9_mixing, op10_packing, op11_repair, op12_spelling, op13_pieces,
    ]
    return {query.__name__: _shipped(query) for query in operators}


MIXING_SQL = r"""
WITH sized AS (
    SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
           md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))) AS ord, md5(coalesce(text, '')) AS txt
    FROM documents),
named AS (
    SELECT source, sum(size)::BIGINT AS source_size,
           CAST([1, 2, 3][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS DOUBLE) AS w
    FROM sized GROUP BY source),
rated AS (SELECT *, source_size * 3.0::DOUBLE AS lim, source_size * 3.0::DOUBLE / w AS ratio FROM named),
levels AS (
    SELECT *, (sum(source_size) OVER () - coalesce(sum(lim) OVER (ORDER BY ratio, source NULLS LAST
                   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
              / sum(w) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
    FROM rated),
targets AS (
    SELECT source, source_size,
           least(lim, (SELECT arg_min(level, ratio) FROM levels WHERE level <= ratio) * w) AS target FROM levels),
summed AS (
    SELECT *, sum(size) OVER (PARTITION BY source ORDER BY ord, doc_id NULLS FIRST, txt
                              ROWS UNBOUNDED PRECEDING) AS upto
    FROM sized WHERE size > 0),
queue AS (
    SELECT s.*, c.copy, CAST(c.copy * t.source_size + s.upto AS DOUBLE) / t.target AS finish
    FROM summed s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source, range(3) c(copy)),
spent AS (
    SELECT *, sum(size) OVER (ORDER BY finish, source NULLS LAST, copy, ord, doc_id NULLS FIRST, txt
                              ROWS UNBOUNDED PRECEDING) AS total
    FROM queue),
taken AS (
    SELECT doc_id, source, txt, sum(size) AS n FROM spent
    WHERE total <= (SELECT sum(size) FROM sized) GROUP BY ALL)
SELECT s.doc_id, s.size, t.source_size, t.target, CAST(coalesce(k.n, 0) AS BIGINT) AS taken
FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
LEFT JOIN taken k ON k.doc_id IS NOT DISTINCT FROM s.doc_id AND k.source IS NOT DISTINCT FROM s.source AND k.txt = s.txt
"""


EMBEDDING_SQL = """
WITH RECURSIVE good AS (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
      AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
    SELECT a.vec_id AS a, b.vec_id AS b FROM good a, good b
    WHERE a.vec_id <> b.vec_id AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.9),
reach(node, root) AS (
    SELECT vec_id, vec_id FROM embeddings
    UNION
    SELECT links.b, reach.root FROM reach JOIN links ON links.a = reach.node),
roots AS (SELECT node, min(root) AS component_id FROM reach GROUP BY node)
SELECT e.vec_id, CAST(count(links.b) AS BIGINT) AS n_links, any_value(roots.component_id) AS component_id,
       e.vec_id = any_value(roots.component_id) AS kept
FROM embeddings e LEFT JOIN links ON links.a = e.vec_id JOIN roots ON roots.node = e.vec_id
GROUP BY e.vec_id
"""

TOPK_SQL = """
WITH good AS (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
    FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS (SELECT vec_id, unnest(q) AS x, generate_subscripts(q, 1) AS i FROM good),
scored AS (
    SELECT a.vec_id AS query_id, b.vec_id, CAST(sum(a.x * b.x) AS BIGINT) AS score
    FROM parts a JOIN parts b ON a.i = b.i AND a.vec_id <> b.vec_id
    WHERE a.vec_id % 100 = 0 GROUP BY ALL)
SELECT query_id, rank, vec_id, score FROM (
    SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank
    FROM scored) WHERE rank <= 10
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_embedding_dedup": EMBEDDING_SQL, "op5_topk": TOPK_SQL, "op9_mixing": MIXING_SQL}
