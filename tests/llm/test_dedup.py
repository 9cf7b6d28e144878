"""SimHash and line dedup against brute force."""

import hashlib
import random
import re

import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

from millrace.llm import linededup, simhash, stages
from millrace.llm.tables import written


def plain_fingerprint(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(values, linked):
    root = list(range(len(values)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(values)):
        for j in range(i):
            if linked(values[i], values[j]):
                root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(values))]


def check_near_duplicates(df, rows):
    found = sorted(map(tuple, simhash.near_duplicates(df).collect()), key=str)
    fps = [plain_fingerprint(text) for _, text in rows]
    groups = components(fps, lambda a, b: (a ^ b).bit_count() <= 3)
    ids = {}
    for group, (doc_id, _) in zip(groups, rows):
        ids.setdefault(group, []).append(doc_id)
    first = {g: min((i for i in members if i is not None), default=None) for g, members in ids.items()}
    expected = [(doc_id, f"{fp:016x}", first[g]) for (doc_id, _), fp, g in zip(rows, fps, groups)]
    assert found == sorted(expected, key=str)


def test_simhash_of_odd_rows(spark, odd_docs):
    check_near_duplicates(odd_docs, [(r.doc_id, r.text) for r in odd_docs.collect()])
    assert simhash.near_duplicates(odd_docs.limit(0)).count() == 0


def test_simhash_of_copies_and_near_copies(spark):
    pick = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    base = [" ".join(pick.choices(words, k=250)) for _ in range(12)]
    rows = []
    for i in range(160):
        text = base[pick.randrange(12)].split()
        for _ in range(pick.choice([0, 0, 1, 2, 6])):
            text[pick.randrange(len(text))] = pick.choice(words).upper()
        rows.append((1000 - i, " ".join(text)))
    check_near_duplicates(spark.createDataFrame(rows, "doc_id LONG, text STRING").repartition(5), rows)


def test_links_of_a_dense_ball_and_of_all_short_runs():
    """All fingerprints near a centre, in buckets of many and of few, hang together as they should."""
    pick = np.random.default_rng(5)
    fps = {0, (1 << 64) - 1}
    for centre in pick.integers(0, 1 << 62, 6).tolist():
        for _ in range(60):
            flipped = centre
            for bit in pick.integers(0, 64, pick.integers(0, 4)).tolist():
                flipped ^= 1 << bit
            fps.add(flipped)
    fps = sorted(fps)
    keys, values = [], []
    for fp in fps:
        segments = [fp >> 16 * i & 0xFFFF for i in range(4)]
        for i in range(4):
            for flip in [0, *[1 << b for b in range(16)]]:
                keys.append(i << 32 | segments[i] << 16 | segments[(i + 1) % 4] ^ flip)
                values.append(fp)
    order = np.argsort(np.array(keys, dtype=np.uint64), kind="stable")
    a, b = simhash.bucket_links(np.array(keys, dtype=np.uint64)[order], np.array(values, dtype=np.uint64)[order])
    assert all((x ^ y).bit_count() <= 3 for x, y in zip(a.tolist(), b.tolist()))
    links = set(zip(a.tolist(), b.tolist())) | set(zip(b.tolist(), a.tolist()))
    want = components(fps, lambda x, y: (x ^ y).bit_count() <= 3)
    assert components(fps, lambda x, y: (x, y) in links) == want


def plain_simhash_dedup(rows):
    """The (doc_id, text) that stay: one row of each component; see the stage for texts without words."""
    groups = components([plain_fingerprint(t) for _, t in rows], lambda a, b: (a ^ b).bit_count() <= 3)
    firsts = {}
    for group, (doc_id, text) in zip(groups, rows):
        key = (doc_id is None, doc_id or 0, hashlib.md5((text or "").encode()).hexdigest())
        firsts[group] = min(firsts.get(group, (key, doc_id, text)), (key, doc_id, text), key=lambda x: x[0])
    kept = [(doc_id, text) for _, doc_id, text in firsts.values()]
    said = {i for i, t in kept if i is not None and (t or "").split()}
    return [(i, t) for i, t in kept if (t or "").split() or i not in said]


@pytest.mark.parametrize("deal", [1, 3])
def test_simhash_stage_keeps_one_row_of_each_component(spark, deal):
    pick = random.Random(9)
    words = [f"w{i}" for i in range(300)]
    texts = [" ".join(pick.choices(words, k=120)) for _ in range(8)]
    near = [t + " w1" for t in texts]
    rows = [
        # An id with a near copy of another id's text and a text of its own.
        (5, texts[0]), (2, texts[0]), (2, texts[1]),
        # Three times without id, once beside an id, exact copies and near ones.
        (None, texts[2]), (None, texts[2]), (None, near[2]), (None, texts[3]), (7, texts[3]), (None, texts[4]),
        # Whole rows that repeat; the wordless ones of an id that stays, and of one that does not.
        (8, texts[5]), (8, texts[5]), (9, near[5]), (2, ""), (2, None), (12, " "),
    ]
    df = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "doc_id LONG, text STRING, k INT").repartition(deal)
    found = stages.simhash_dedup(spark, df, "")
    assert found.columns == df.columns
    got = sorted(((r.doc_id, r.text) for r in found.collect()), key=str)
    assert got == sorted(plain_simhash_dedup(rows), key=str)
    assert sum(i is None for i, _ in got) == 2 and {t for i, t in got if i == 2} == {texts[0], texts[1]}
    assert all(rows[r.k] == (r.doc_id, r.text) for r in found.collect())
    assert stages.simhash_dedup(spark, df.limit(0), "").count() == 0


def test_simhash_stage_of_odd_rows(spark, odd_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    found = [(r.doc_id, r.text) for r in stages.simhash_dedup(spark, odd_docs, "").collect()]
    assert sorted(found, key=str) == sorted(plain_simhash_dedup(rows), key=str)


def plain_line_dedup(rows, threshold=0.8):
    """Lines kept of each (doc_id, text), with 64-bit text hashes told by the caller."""
    seen, kept = [], {}
    for key, text in rows:
        if key in kept:
            continue
        out = []
        for line in (text or "").split("\n"):
            words = frozenset(line.encode().lower().split())
            hit = bool(words) and any(len(words & w) >= threshold * len(words | w) - 1e-9 for w in seen)
            if words:
                seen.append(words)
            if not hit:
                out.append(line)
        kept[key] = "\n".join(out)
    return kept


def lines_of(df, threshold=0.8):
    return linededup.dedup_lines(df, threshold=threshold)


@pytest.mark.parametrize("threshold", [0.8, 0.5, 1.0])
def test_line_dedup_against_all_pairs(spark, threshold):
    pick = random.Random(11)
    words = [f"v{int(pick.paretovariate(0.6))}" for _ in range(60)]
    pool = [pick.choices(words, k=pick.randint(1, 14)) for _ in range(50)]
    rows = []
    for i in range(60):
        lines = []
        for _ in range(pick.randint(1, 8)):
            line = list(pick.choice(pool))
            if pick.random() < 0.5:
                line[pick.randrange(len(line))] = pick.choice(words)
            lines.append(" ".join(line))
        rows.append((i, "\n".join(lines)))
    want = plain_line_dedup([(i, t) for i, t in rows], threshold)
    df = spark.createDataFrame(rows, "doc_id LONG, text STRING").repartition(4)
    found = {r.doc_id: r for r in lines_of(df, threshold).collect()}
    assert {i: r.text for i, r in found.items()} == want
    for i, text in rows:
        lines = text.split("\n")
        assert found[i].n_lines == len(lines)
        gone = found[i].n_removed
        assert gone == len(lines) - (len(want[i].split("\n")) if gone < len(lines) else 0)


def test_a_frequent_word_in_many_different_lines(spark, monkeypatch):
    """More candidates at one word than are checked first: the rest is checked too."""
    rows = [(i, f"common u{i} v{i}") for i in range(40)] + [(100 + i, f"common u{i} v{i} common") for i in range(0, 40, 7)]
    rows += [(200, "common u39 v39 w x y z"), (201, "common z y x w v39 u39 extra")]
    found = {r.doc_id: r.n_removed for r in lines_of(spark.createDataFrame(rows, "doc_id LONG, text STRING")).collect()}
    want = plain_line_dedup(rows)
    assert {i for i, n in found.items() if n} == {i for i, t in want.items() if t == ""}


def test_hot_words_and_lines_are_dealt_and_merged(spark, monkeypatch):
    """No group of a word holds all its lines, a repeated line enters once, and the lines removed are the same."""
    monkeypatch.setattr(linededup, "BLOCK", 8)
    pick = random.Random(4)
    lines = [f"common u{i} v{i % 9} w{pick.randrange(5)}" for i in range(90)] + ["the line of all", "all the line of"]
    rows = [(i, f"{lines[i % len(lines)]}\nthe line of all\ncommon {pick.choice(lines)} x{i % 40}") for i in range(150)]
    df = spark.createDataFrame(rows, "doc_id LONG, text STRING").repartition(6)
    found = {r.doc_id: r.text for r in lines_of(df, 0.5).collect()}
    assert found == plain_line_dedup(rows, 0.5)
    plain = linededup._identified(df, "doc_id", "text")
    firsts = written(linededup._firsts(plain, linededup.word_ranks(plain), 0.5))
    assert firsts.count() == len({frozenset(line.split()) for _, text in rows for line in text.split("\n")})
    dealt = linededup._prefixes(firsts.withColumn("every", F.lit(False)), linededup._blocks(firsts)).toPandas()
    hot = dealt.groupby("token")[["doc", "at"]].apply(lambda g: len(g.drop_duplicates())).max()
    assert hot > 24 > dealt.groupby(["token", "left", "right"]).size().max()


def test_long_runs_give_all_pairs_when_asked():
    n = 40
    doc, at, bits = np.arange(n), np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    shape, lead = np.full(n, 10 << 32, dtype=np.int64), np.zeros(n, dtype=np.int64)
    for every in (False, True):
        marks = np.full(n, every)
        found = pd.concat(list(linededup._run_pairs(doc, at, shape, lead, bits, marks, 0.8)))
        if every:
            assert len(found) == n * (n - 1) // 2 and not found["more"].any()
        else:
            assert set(found[found["more"]]["doc"]) == set(range(linededup.FIRST + 1, n))


def test_filters_let_every_match_through():
    """Sets that match, at every word they share, with parities of either sign."""
    pick = np.random.default_rng(8)
    for _ in range(300):
        n = int(pick.integers(1, 40))
        a = pick.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2)
        b = np.unique(np.r_[a[: n - n // 10], pick.integers(0, 1 << 63, n // 12).astype(np.uint64)])
        a = np.unique(a)
        common = np.intersect1d(a, b)
        if len(common) < 0.8 * len(np.union1d(a, b)):
            continue
        bits = [np.bitwise_xor.reduce(np.uint64(1) << (x & np.uint64(63))).astype(np.int64) for x in (a, b)]
        leads = [np.array([x[0]]).view(np.int64) for x in (a, b)]
        met = []
        for word in common:
            shapes = [np.array([(len(x) << 32) | int(np.searchsorted(x, word))]) for x in (a, b)]
            met.append(bool(linededup._allowed(*shapes, *leads, *[np.array([x]) for x in bits], 0.8).all()))
        assert met[0] and (all(met) if leads[0] != leads[1] else not any(met[1:]))


def test_parities_never_understate_the_words_in_common():
    pick = random.Random(21)
    words = [f"w{i}" for i in range(400)]
    lines = [" ".join(pick.choices(words, k=pick.randint(1, 300))) for _ in range(60)]
    sets = linededup.LineSets("\n".join(lines).encode(), np.zeros(1 << linededup.BUCKET_BITS, dtype=np.uint8))
    odd, own = sets.parities().view(np.uint64), [set(line.split()) for line in lines]
    for a in range(60):
        for b in range(a):
            apart = int(np.bitwise_count(odd[a] ^ odd[b]).sum())
            assert len(own[a] & own[b]) <= (len(own[a]) + len(own[b]) - apart) / 2


def test_long_lines_without_common_words_are_no_candidates():
    """64 places tell no pair of lines of 150 words apart, 128 do; pairs that match pass."""
    pick = random.Random(5)
    lines = [" ".join(f"w{k}" for k in pick.sample(range(100_000), 150)) for _ in range(60)]
    lines += [" ".join([*line.split()[:140], "x", "y"]) for line in lines[:20]]
    sets = linededup.LineSets("\n".join(lines).encode(), np.zeros(1 << linededup.BUCKET_BITS, dtype=np.uint8))
    bits, n = sets.digests()[2].view(np.int64), len(lines)
    every, zero = np.full(n, True), np.zeros(n, dtype=np.int64)
    frame = pd.DataFrame(
        {"token": 1, "left": 0, "right": 0, "doc": np.arange(n), "at": 0, "shape": sets.size << 32, "lead": 0, "bits": bits, "every": every}
    )
    found = [linededup._bucket_pairs(frame.assign(wide=wide), 0.8, np.ones(1 << linededup.BUCKET_BITS, dtype=np.int64)) for wide in (sets.wide(), zero)]
    pairs = [set(zip(f["a_doc"], f["doc"])) for f in found]
    assert pairs[0] == {(k, 60 + k) for k in range(20)} and len(pairs[1]) > 10 * len(pairs[0])


def test_words_met_again_make_no_rows(spark, monkeypatch):
    """The filter of the second round is made where its words are, from a row for each line, whatever its words."""
    bitmap, made = linededup._bitmap, []
    monkeypatch.setattr(linededup, "_bitmap", lambda rows, keys: made.append(rows.count()) or bitmap(rows, keys))
    rows = [(10 + i, [i * 7919 * (1 << 40), i]) for i in range(50)] + [(3, [])]
    marked = spark.createDataFrame(rows, "size LONG, again ARRAY<LONG>").repartition(3)
    bits = np.unpackbits(np.frombuffer(linededup._met_filter(marked, 0.8), dtype=np.uint8)).view(bool)
    assert made == [50]
    for size, again in rows[:-1]:
        near = linededup._size_class(np.array([size]), 0.8)
        for token in again:
            assert all(bits[linededup._met(np.array([token]), near + k)].all() for k in (-1, 0, 1))
    assert bits.sum() <= 300


def test_words_are_hashed_alike_wherever_they_stand():
    data = "The cat\n\n  a CAT the\tdog\x0bthe\r\nété Cat".encode()
    hashes, lines = linededup.word_hashes(data)
    words = data.lower().split()
    assert lines.tolist() == [0, 0, 2, 2, 2, 2, 2, 3, 3] and len(set(words)) == len(set(hashes.tolist()))
    assert len({(w, h) for w, h in zip(words, hashes.tolist())}) == len(set(words))
    assert len(linededup.word_hashes(b"")[0]) == 0


def test_long_texts_are_cut_at_lines(monkeypatch):
    monkeypatch.setattr(linededup, "CHUNK_BYTES", 20)
    texts = ["a b\nc" * 9, "", "one long line without any break in it at all", "\n\n", "x"]
    batch = pd.DataFrame({"doc": range(5), "part": range(5), "text": texts})
    got = {}
    for data, docs, ats in linededup._chunks(batch):
        for line, doc, at in zip(data.split(b"\n"), docs.tolist(), ats.tolist()):
            assert at >> 32 == doc
            got.setdefault(doc, {})[at & 0xFFFFFFFF] = line.decode()
    assert {d: "\n".join(lines[k] for k in sorted(lines)) for d, lines in got.items()} == dict(enumerate(texts))


def test_texts_of_one_id_with_equal_hash_bits_are_told_apart(spark):
    """A text must not lose the lines of another one of its id whose hash has the same 31 bits."""
    made = spark.range(0, 400_000, 1, 4).select(F.concat_ws(" ", F.lit("p"), "id", F.col("id") * 7, F.lit("q")).alias("text"))
    bits = made.withColumn("part", F.xxhash64("text").bitwiseAND(F.lit(0x7FFFFFFF)))
    met = bits.groupBy("part").agg(F.collect_list("text").alias("texts")).filter("size(texts) > 1").limit(3).collect()
    assert met
    for doc_id in (None, 5):
        rows = []
        for row in met:
            for text in row.texts:
                rows += [(doc_id, text), (doc_id, " ".join(reversed(text.split())))]
        result = lines_of(spark.createDataFrame(rows, "doc_id LONG, text STRING").withColumn("__number", F.lit(1))).collect()
        assert len(result) == len(rows) and "__number" in result[0].asDict()
        # Of each text and its reversal one stays.
        kept = sorted(" ".join(sorted(r.text.split())) for r in result if r.text)
        assert kept == sorted(" ".join(sorted(text.split())) for row in met for text in row.texts)


def test_line_dedup_of_odd_rows(spark, odd_docs):
    rows = odd_docs.collect()
    order = sorted(
        {(r.doc_id, r.text) for r in rows},
        key=lambda r: (r[0] is not None, r[0] or 0, xxhash.xxh64_intdigest((r[1] or "").encode(), 42) & 0x7FFFFFFF),
    )
    want = plain_line_dedup([((i, t), t) for i, t in order])
    result = lines_of(odd_docs)
    assert set(odd_docs.columns) <= set(result.columns) and result.columns.count("n_lines") == 1
    found = result.collect()
    assert len(found) == len(rows)
    texts = sorted((str(r.doc_id), str(r.text), r.n_chars) for r in found)
    changed = {k: (t if t != (k[1] or "") else k[1]) for k, t in want.items()}
    assert texts == sorted((str(r.doc_id), str(changed[r.doc_id, r.text]), r.n_chars) for r in rows)
    assert lines_of(odd_docs.limit(0)).count() == 0


def test_equal_lines_are_told_where_sets_are_merged(spark):
    """The texts are not read once more for lines with an equal earlier one."""
    rows = [(1, "a b c\na b c\nc b a d"), (2, "A b c"), (2, "A b c"), (3, None), (4, "x y\n\nc a b")]
    df = linededup._identified(spark.createDataFrame(rows, "doc_id LONG, text STRING").repartition(3), "doc_id", "text")
    merged = linededup._merged(df, linededup.word_ranks(df), 0.8).collect()
    firsts = {(r.doc, r.at & 0xFFFFFFFF): len(r.tokens) // 8 for r in merged if r.tokens is not None}
    assert firsts == {(1, 0): 1, (1, 2): 1, (4, 0): 1}
    # The row that repeats is one line, once or twice.
    assert {(r.doc, r.at & 0xFFFFFFFF) for r in merged if r.tokens is None} == {(1, 1), (2, 0), (4, 2)}


def test_entries_travel_together(spark):
    """One row per group and task, not one per word; the pairs are those of the words that two lines share."""
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(50)) + f"\nu{i // 2} v{i // 2} {'z' * (i % 2)}") for i in range(200)]
    df = linededup._identified(spark.createDataFrame(rows, "doc_id LONG, text STRING").repartition(4), "doc_id", "text")
    firsts = written(linededup._firsts(df, linededup.word_ranks(df), 0.6)).withColumn("every", F.lit(False))
    blocks = linededup._blocks(firsts)
    dealt = written(linededup._dealt_entries(firsts, blocks, 3, 0.6))
    assert dealt.count() <= 3 * firsts.rdd.getNumPartitions() < linededup._prefixes(firsts, blocks).count() / 100
    found = {(r.a_doc, r.doc) for r in linededup._candidates(dealt, 0.6, blocks).collect()}
    assert found == {(i, i + 1) for i in range(0, 200, 2)}


def test_words_of_any_length_are_told_apart():
    """Words that differ in one byte, wherever it is, and in length, at any place in memory."""
    base = [bytes([97 + n % 26]) * n for n in range(1, 150)]
    words = base + [w[:k] + b"0" + w[k + 1 :] for w in base for k in {0, len(w) // 2, len(w) - 1}]
    hashes = [int(linededup.word_hashes(b" " * shift + w.upper() + b"\n")[0][0]) for w in words for shift in (0, 3, 8)]
    assert len(set(hashes)) == len(set(words)) and len(hashes) == 3 * len(words)
    assert all(len(set(hashes[k : k + 3])) == 1 for k in range(0, len(hashes), 3))
