"""Token files, packing and mixing."""

import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from millrace.llm import mixing, packing, queries, tokenfile
from millrace.llm.tables import table, written
from millrace.llm.tokens import WordMemoEncoder, tokenizer_path
from test_dedup import plain_line_dedup, plain_simhash_dedup

ODD = ["", "a", "  ", "a  b", "a \nb", "\n a", "a ", "<|endoftext|> x", "a<|endoftext|>b c", " a b", "é ß 日本 語",
       "don't I'm it's  'tis", "a\t b", "x  y", "x  y\x1c z", "1 22 333", "w.\nW w", "😀".encode("utf-16", "surrogatepass").decode("utf-16")]


@pytest.fixture(scope="module")
def encoder():
    return WordMemoEncoder(tokenizer_path())


def test_memo_gives_the_tokenizers_ids(encoder):
    pick = random.Random(1)
    texts = ODD + ["".join(pick.choices(["a", "b.", " ", " ", "\n", "é", "'s", "12", "  ", "word", "\t"], k=40)) for _ in range(300)]
    small = WordMemoEncoder(tokenizer_path(), max_units=5)
    for _ in range(2):
        assert encoder.encode(texts) == small.encode(texts) == [encoder.whole(t) for t in texts]
    assert encoder.encode([]) == [] and encoder.encode(["", ""]) == [b"", b""]
    # A memo that is full starts anew rather than keeping what it met first.
    for n in range(4):
        small.encode([f"w{n} x{n} " * 3, f"y{n} " * 4])
        assert 0 < len(small.after_blank) <= 5 and f" y{n}"[1:] in small.after_blank


def test_wavelet_queries():
    pick = np.random.default_rng(4)
    ids = np.minimum(pick.geometric(0.02, 5000), 300).astype("<u2")
    shard = tokenfile.WaveletShard(
        tokenfile.encode_shard(ids, np.array([5000]), np.array([7]), np.array([False]), 9)
    )
    assert (shard.ids() == ids).all() and shard.doc_ids == [7]
    for i in pick.integers(0, 5000, 50).tolist():
        assert shard.access(i) == ids[i]
    for token in (1, 2, 17, 300, 299, 511, 1 << 12):
        places = np.flatnonzero(ids == token)
        assert shard.count(token) == len(places)
        assert shard.count(token, 2500) == (places < 2500).sum()
        for j in {0, len(places) // 2, len(places) - 1} & set(range(len(places))):
            assert shard.occurrence(token, j) == places[j]
        with pytest.raises(IndexError):
            shard.occurrence(token, len(places))


def test_wavelet_over_blocks(monkeypatch):
    monkeypatch.setattr(tokenfile, "BLOCK", 64)
    ids = np.random.default_rng(6).integers(0, 1 << 20, 777).astype("<u4")
    shard = tokenfile.WaveletShard(tokenfile.encode_shard(ids, np.array([777]), np.array([1]), np.array([False]), 20))
    assert (shard.ids() == ids).all()
    assert all(shard.access(i) == ids[i] for i in range(0, 777, 13))
    assert all(shard.occurrence(int(ids[i]), shard.count(int(ids[i]), i)) == i for i in range(0, 777, 29))


def test_token_files_of_odd_rows(spark, odd_docs, encoder, folder):
    rows = sorted(((r.doc_id is not None, r.doc_id or 0, r.text is not None, r.text or ""), r.doc_id) for r in odd_docs.collect())
    manifest = tokenfile.write_shards(odd_docs, folder, shard_ids=50)
    found = tokenfile.read_documents(spark, manifest).orderBy("start").collect()
    start = 0
    assert len(found) == len(rows) and manifest.count() > 1
    for (key, doc_id), row in zip(rows, found):
        want = encoder.whole(key[3]) + np.array([2], dtype="<u4").tobytes()
        assert (row.doc_id, row.start, row.n_tokens, bytes(row.ids)) == (doc_id, start, len(want) // 4, want)
        start += row.n_tokens
    empty = tokenfile.round_trip(odd_docs.limit(0))
    assert empty.count() == 0


def test_rows_without_id_spread_over_tasks(spark, folder):
    docs = spark.range(4000).select(
        F.when(F.col("id") % 3 == 0, F.col("id")).alias("doc_id"), F.concat(F.md5(F.col("id").cast("string")), F.lit(" x")).alias("text")
    )
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # the rows are small
    try:
        manifest = tokenfile.write_shards(docs, folder).orderBy("shard").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(manifest) > 3 and max(r.docs for r in manifest) < 2000
    found = tokenfile.read_documents(spark, spark.createDataFrame(manifest)).orderBy("start").collect()
    rows = sorted(((r.doc_id is not None, r.doc_id or 0, r.text) for r in docs.collect()))
    assert [r.doc_id for r in found] == [i if named else None for named, i, _ in rows]
    encode = WordMemoEncoder(tokenizer_path())
    assert [bytes(r.ids)[:-4] for r in found] == encode.encode([text for _, _, text in rows])


def check_packing(rows, found, encoder, capacity=2048, same_rows=False):
    pieces, sequences = {}, {}
    for r in found:
        pieces.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
    for r in sequences.values():
        r.sort(key=lambda p: p.offset)
        assert [p.offset for p in r] == [sum(q.length for q in r[:k]) for k in range(len(r))]
        assert sum(p.length for p in r) <= capacity
    wanted = sorted(
        (str(doc_id), s, raw)
        for doc_id, text in rows
        for full in [encoder.whole(text or "") + np.array([1], dtype="<u4").tobytes()]
        for s, raw in [(s, (full[4 * s : 4 * (s + capacity)], len(full) // 4)) for s in range(0, len(full) // 4, capacity)]
    )
    assert sorted((str(r.doc_id), r.start, r.length, r.ids_crc32, r.doc_tokens) for r in found) == sorted(
        (i, s, len(raw) // 4, zlib.crc32(raw), n) for i, s, (raw, n) in wanted
    )
    return sequences


def test_packing_of_odd_rows(spark, odd_docs, encoder):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    check_packing(rows, packing.pack(odd_docs).collect(), encoder)
    assert packing.pack(odd_docs.limit(0)).count() == 0


def test_packing_pads_little(spark, encoder):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    layout = written(packing.pack(docs))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    sequences = check_packing(rows, layout.collect(), encoder)
    used = [sum(p.length for p in s) for s in sequences.values()]
    assert sorted(sequences) == list(range(len(sequences)))
    assert sum(used) / sum(map(packing.padded_length, used)) > 0.98


def test_packing_holds_few_texts_at_once(spark, monkeypatch):
    """Ids are made for a bounded run of characters, so that a worker of a long chain of stages has room."""
    encode, most = WordMemoEncoder.encode, []

    def watched(self, texts):
        most.append(sum(map(len, texts)))
        return encode(self, texts)

    monkeypatch.setattr(WordMemoEncoder, "encode", watched)
    docs = spark.createDataFrame([(k, "word " * 200_000) for k in range(6)], "doc_id LONG, text STRING").coalesce(1)
    cut = {}
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, function, schema: cut.update(f=function) or self)
    packing.document_pieces(docs, tokenizer_path(), 1, 2048, 16, "doc_id", "text")
    batch = pa.RecordBatch.from_arrays([pa.array(range(6), pa.int64()), pa.array(["word " * 200_000] * 6)], names=["doc_id", "text"])
    pieces = pa.Table.from_batches(list(cut["f"](iter([batch])))).to_pandas()
    assert max(most) <= 4_000_000 and sum(most) == 6_000_000
    assert pieces.groupby("doc_id")["length"].sum().tolist() == pieces.groupby("doc_id")["doc_tokens"].first().tolist()


def test_packed_sequences_hold_the_ids(spark, encoder):
    rows = [(i, " ".join(["word"] * n)) for i, n in enumerate([1, 5, 30, 70, 64, 0])]
    docs = spark.createDataFrame(rows, "doc_id LONG, text STRING")
    layout = written(packing.pack(docs, capacity=64, unit=4))
    packed = {r.sequence_id: r for r in packing.packed_sequences(docs, layout).collect()}
    ids = {i: np.frombuffer(encoder.whole(t), dtype="<u4").tolist() + [1] for i, t in rows}
    for p in layout.collect():
        assert packed[p.sequence_id].ids[p.offset : p.offset + p.length] == ids[p.doc_id][p.start : p.start + p.length]


def test_cutting_plan_places_every_item():
    pick = np.random.default_rng(9)
    for capacity, n in ((16, 0), (16, 1), (16, 50), (64, 3000)):
        counts = np.bincount(pick.integers(1, capacity + 1, n), minlength=capacity + 1)
        plan, load = packing.cutting_plan(counts, capacity), {}
        held = np.zeros(capacity + 1, dtype=int)
        for size, low, high, per, first in plan:
            assert low == held[size]
            held[size] = high
            for rank in range(low, high):
                load[first + (rank - low) // per] = load.get(first + (rank - low) // per, 0) + size
        assert (held == counts).all() and all(v <= capacity for v in load.values())
        assert len(load) <= 1.02 * (np.arange(capacity + 1) * counts).sum() / capacity + 3


def same(spark_rows, sql_rows):
    assert sorted(map(str, map(tuple, spark_rows))) == sorted(map(str, sql_rows))


def test_mixing_of_odd_rows_matches_sql(spark, odd_docs):
    """The rows that repeat wholly stay out: the queue may take either of them first."""
    docs = odd_docs.dropDuplicates(["doc_id", "text"]).repartition(3)
    found = mixing.taken_words(*mixing.mix(docs)).collect()
    con = duckdb.connect()
    arrow = docs.select("doc_id", "text", "source").toPandas()
    con.register("given", arrow)
    con.execute("CREATE VIEW documents AS SELECT CAST(doc_id AS BIGINT) AS doc_id, text, source FROM given")
    same(found, con.sql(queries.oracle_sql()["op9_mixing"]).fetchall())


def test_mixing_properties(spark):
    pick = random.Random(2)
    rows = [(i, " ".join(["w"] * pick.randint(0, 30)), pick.choice("aaaaaab" + "cde") if i % 50 else None) for i in range(3000)]
    rows += [(5000 + k % 3, "w " * 20, "f") for k in range(30)]
    docs = spark.createDataFrame(rows, "doc_id LONG, text STRING, source STRING")
    found = mixing.taken_words(*mixing.mix(docs.repartition(5))).collect()
    assert len(found) == len(rows)
    assert sorted(map(tuple, found)) == sorted(map(tuple, mixing.taken_words(*mixing.mix(docs)).collect()))
    total = sum(r.size for r in found)
    assert sum(r.taken for r in found) <= total and sum(r.taken for r in found) > total - 31
    assert all(r.taken % r.size == 0 and r.taken <= 3 * r.size for r in found if r.size)
    source = {}
    for r in found:
        key = r.source_size, r.target
        source[key] = source.get(key, 0) + r.taken
    assert sum(target for _, target in source) == pytest.approx(total)
    for (size, target), taken in source.items():
        assert target <= 3 * size + 1e-6 and abs(taken - target) <= 31


def test_mixing_of_nothing(spark, odd_docs):
    assert mixing.taken_words(*mixing.mix(odd_docs.limit(0))).count() == 0
    wordless = odd_docs.filter("doc_id IN (3, 4, 5)")
    assert [r.taken for r in mixing.taken_words(*mixing.mix(wordless)).collect()] == [0, 0, 0]


@pytest.mark.parametrize("name", queries.oracle_sql())
def test_queries_match_sql(spark, name):
    con = duckdb.connect()
    for source in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {source} AS SELECT * FROM '/root/testdata/sf0.01/{source}.parquet'")
    result = queries.queries()[name](spark, "/root/testdata/sf0.01")
    expected = con.sql(queries.oracle_sql()[name])
    assert sorted(result.columns) == sorted(expected.columns)
    same(result.collect(), con.sql(f"SELECT {', '.join(result.columns)} FROM expected").fetchall())


def test_mixing_runs_no_python(spark):
    plan = queries.op9_mixing(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow", "Cartesian", "NestedLoop"))


def test_pipeline_stages(spark, odd_docs, encoder):
    docs, names = odd_docs, [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "line_dedup", "simhash_dedup", "mixing", "packing"]
    after = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, written(stage(spark, docs, ""))
        after[name] = docs.collect()
        if name != "packing":
            assert docs.columns == odd_docs.columns
        if name == "language_id":
            assert {r.doc_id for r in after[name]} == {1, 2, None, 7, 8}
        if name == "line_dedup":
            assert len(after[name]) == before.count()
    texts = {(r.doc_id, r.text) for r in after["line_dedup"]}
    assert {(r.doc_id, r.text) for r in after["simhash_dedup"]} <= texts
    ids = [r.doc_id for r in after["simhash_dedup"] if r.doc_id is not None]
    assert len(ids) == len(set(ids))
    check_packing([(r.doc_id, r.text) for r in after["mixing"]], after["packing"], encoder)
    assert corpus_pipeline.STAGES[0][1](spark, odd_docs.limit(0), "").count() == 0


@pytest.mark.parametrize("given", ["odd", "table"])
def test_pipeline_stages_row_by_row(spark, odd_docs, encoder, given):
    """What each stage keeps of its own input, against plain versions."""
    docs = odd_docs if given == "odd" else table(spark, "/root/testdata/sf0.001", "documents")
    rows = lambda df: Counter((r.doc_id, r.text, r.source) for r in df.collect())
    stage = dict(corpus_pipeline.STAGES)
    told = written(stage["language_id"](spark, docs, ""))
    assert rows(told) == Counter({k: n for k, n in rows(docs).items() if any(c.isalpha() for c in k[1] or "")})
    lines = written(stage["line_dedup"](spark, told, ""))
    order = sorted({k[:2] for k in rows(told)}, key=lambda k: (k[0] is not None, k[0] or 0, k[1]))
    kept = plain_line_dedup([(k, k[1]) for k in order])
    want = Counter()
    for (doc_id, text, source), n in rows(told).items():
        want[doc_id, kept[doc_id, text], source] += n
    assert rows(lines) == want
    single = written(stage["simhash_dedup"](spark, lines, ""))
    of = Counter((i, t) for i, t, _ in rows(single).elements())
    assert of == Counter(plain_simhash_dedup([k[:2] for k in rows(lines)])) and not rows(single) - rows(lines)
    mixed = written(stage["mixing"](spark, single, ""))
    con = duckdb.connect()
    con.register("given", single.select("doc_id", "text", "source").toPandas())
    con.execute("CREATE VIEW documents AS SELECT CAST(doc_id AS BIGINT) AS doc_id, text, source FROM given")
    taken = con.sql(f"SELECT doc_id, sum(taken) FROM ({queries.oracle_sql()['op9_mixing']}) GROUP BY ALL HAVING sum(taken) > 0")
    words = Counter()
    for (doc_id, text, _), n in rows(mixed).items():
        words[doc_id] += n * len(text.encode().split())
    assert words == {i: int(n) for i, n in taken.fetchall()} and set(rows(mixed)) <= set(rows(single))
    check_packing([k[:2] for k in rows(mixed).elements()], stage["packing"](spark, mixed, "").collect(), encoder)


def test_pipeline_stages_of_empty_tables_and_without_labels(spark, odd_docs):
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd_docs.limit(0), "").count() == 0, name
    bare = odd_docs.withColumn("lang", F.lit(None).cast("string"))
    found = corpus_pipeline.STAGES[0][1](spark, bare, "")
    assert {r.doc_id for r in found.collect()} == {1, 2, None, 7, 8}
    aside = corpus_pipeline.STAGES[1][1](spark, odd_docs, "")
    assert {(r.n_lines, r.fp) for r in aside.collect()} == {("x", "x")}


def test_mixing_counts_rows_without_id_before_ranking(spark):
    """A third of the rows has no id: their order is spread by their texts, and copies are one row of it."""
    rows = [(None if i % 3 == 0 else i, f"text {i}", "a") for i in range(900)] + [(None, "copy of it", "b")] * 300
    sizes = mixing.document_sizes(spark.createDataFrame(rows, "doc_id LONG, text STRING, source STRING"))
    order = [(r["_order"], r.source) for r in sizes.filter("doc_id IS NULL").collect()]
    assert len({o[: mixing.BUCKET_DIGITS] for o, source in order if source == "a"}) > 250
    taken = mixing.schedule(sizes, mixing.source_targets(sizes))
    sums = sorted(r.finish * r.target for r in taken.filter("source = 'b'").collect())
    assert sums == pytest.approx([3.0 * k for k in range(1, 901)])


def test_mixing_stage_deals_texts_twice(spark, odd_docs, conf):
    """Once to count rows that repeat, once to order the queue, and not a third time to meet the copies taken."""
    conf("spark.sql.autoBroadcastJoinThreshold", "-1")
    plan = dict(corpus_pipeline.STAGES)["mixing"](spark, odd_docs, "")._jdf.queryExecution().executedPlan().toString()
    # The groups of documents, and the copies, which hold no text.
    assert plan.count("Exchange hashpartitioning") == 2 and plan.count("Exchange rangepartitioning") == 1


def test_mixing_stage_tells_null_from_empty(spark):
    rows = [(1, "a b c", None), (1, "a b c", ""), (1, "a b c", "="), (None, "a b c", None), (None, "a b c", "")]
    docs = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "doc_id LONG, text STRING, source STRING, k INT")
    mixed = dict(corpus_pipeline.STAGES)["mixing"](spark, docs, "").collect()
    assert {(r.doc_id, r.text, r.source) for r in mixed} <= set(rows) and all(rows[r.k] == (r.doc_id, r.text, r.source) for r in mixed)
    _, taken = mixing.mix(docs)
    want = Counter((r.doc_id, r.source) for r in taken.collect())
    assert Counter((r.doc_id, r.source) for r in mixed) == want and None in {i for i, _ in want}


def test_pipeline_runs_over_a_table(spark):
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() > 0
