"""Conversation repair, spelling variants and SentencePiece, against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from places import TESTDATA

from millrace.llm import pieces, queries, repair, spelling
from millrace.llm.tokens import tokenizer_path

GRAMMAR = re.compile(r"(s?(ua)+)?\Z")
TURNS = "conv_id LONG, turn LONG, role STRING, text STRING"


# --- conversation repair ---------------------------------------------------------


def brute_repair(rows):
    """Least cost and audit over all edit scripts with up to three inserts."""
    found, best = repair.faults(rows), None

    def go(i, roles, audit, cost, inserts):
        nonlocal best
        if best is not None and cost > best[0]:
            return
        if i == len(rows) and GRAMMAR.match(roles) and (best is None or (cost, audit) < best):
            best = (cost, audit)
        if inserts:
            for role in "ua":
                go(i, roles + role, audit + "I", cost + 2, inserts - 1)
        if i < len(rows):
            go(i + 1, roles, audit + "D", cost + 3, inserts)
            if found[i] in ("", "truncated"):
                extra, initial = found[i] == "truncated", rows[i][0][:1]
                go(i + 1, roles + (initial or "?"), audit + "K", cost + extra, inserts)
                for role in "ua":
                    go(i + 1, roles + role, audit + "R", cost + 2 + extra, inserts)

    go(0, "", "", 0, 3)
    return best


def random_rows(pick, n):
    roles = ["user", "assistant", "system", "tool", "", "user", "assistant"]
    return [(pick.choice(roles), pick.choice([" ", "", "a.", "b", "c!", "d. \n", "e", "f?"])) for _ in range(n)]


def test_repair_is_the_cheapest_with_the_least_audit():
    pick = random.Random(5)
    for _ in range(600):
        rows = random_rows(pick, pick.randint(0, 5))
        done = repair.repair(rows)
        assert (done.cost, done.audit) == brute_repair(rows), rows
        assert GRAMMAR.match("".join(role[:1] for role, _ in done.rows))


def test_wide_bands_and_blocks_of_the_matrix_give_the_same(monkeypatch):
    pick = random.Random(6)
    for _ in range(60):
        rows = [
            (pick.choice(["user", "assistant", "system", "user"]), pick.choice([" ", f"a{pick.randint(0, 99)}.", f"b{pick.randint(0, 99)}"]))
            for _ in range(pick.randint(0, 60))
        ]
        expected = repair.repair(rows)
        for narrow, entries, spare in ((0, 4_000_000, 6), (0, 50, 6), (10**9, 50, 1), (0, 4_000_000, 10**6)):
            monkeypatch.setattr(repair, "_NARROW", narrow)
            monkeypatch.setattr(repair, "_ENTRIES", entries)
            monkeypatch.setattr(repair, "_FIRST_SPARE", spare)
            assert repair.repair(rows) == expected


def test_faults_and_applied_edits():
    rows = [("system", "S."), ("user", " \t"), ("user", "hi?"), ("user", "hi?"), ("assistant", "no end"), ("user", "x.")]
    done = repair.repair(rows)
    assert done[:4] == (1, 1, 1, 2)
    assert (done.cost, done.audit) == brute_repair(rows)
    assert repair.repair([]) == (0, 0, 0, 0, 0, "", [])


def plain_op11(rows):
    """The contract, row by row."""
    groups = defaultdict(list)
    for conv_id, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv_id is None else conv_id}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        groups[conv_id] += [(turn, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
    out = set()
    for conv_id, turns in groups.items():
        turns.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        known = [t for t, _, _ in turns if t is not None]
        done = repair.repair([(role, text) for _, role, text in turns])
        text = "\n".join(f"{role}:{text}" for role, text in done.rows)
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        out.add((conv_id, gaps, *done[:6], hashlib.sha256(text.encode()).hexdigest()))
    return out


def test_op11_on_odd_rows(spark, folder):
    pick = random.Random(7)
    rows = [(c, t, *row) for c in range(40) for t, row in enumerate(random_rows(pick, pick.randint(1, 9)))]
    rows += [(None, None, None, None), (None, 2, "user", "a\nb é."), (100, None, None, "x"), (100, 9, "user", None), (100, 9, "user", None)]
    rows += [(101, t, "user" if t % 2 == 0 else "assistant", "long. " * 5000) for t in range(30)]
    df = spark.createDataFrame(rows, TURNS).selectExpr("*", "'x' AS copies", "1 AS audit", "2 AS repaired")
    df.write.parquet(f"{folder}/conversations.parquet")
    result = queries.queries()["op11_repair"](spark, folder)
    got = [tuple(row) for row in result.collect()]
    assert len(got) == len({row[0] for row in rows}) and set(got) == plain_op11(rows)
    assert result.dtypes == [("conv_id", "bigint"), *((n, "bigint") for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")),
                             ("audit", "string"), ("repaired_sha256", "string")]
    empty = repair.repair_conversations(spark.createDataFrame([], TURNS))
    assert empty.count() == 0


def test_op11_with_one_long_conversation(spark, folder):
    pick = random.Random(8)
    rows = [(1, t, "user" if (t % 2 == 0) ^ (pick.random() < 0.05) else "assistant", f"t{t}.") for t in range(1500)]
    rows += [(c, t, "user" if t % 2 == 0 else "assistant", f"t{t}.") for c in range(2, 300) for t in range(4)]
    spark.createDataFrame(rows, TURNS).write.parquet(f"{folder}/conversations.parquet")
    got = {tuple(row) for row in queries.queries()["op11_repair"](spark, folder).collect()}
    assert got == plain_op11(rows)


# --- spelling variants -----------------------------------------------------------


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    a, b = sorted((a, b), key=len, reverse=True)
    p = 0
    while p < len(b) and a[p] == b[p]:
        p += 1
    return a[p + 1 :] == (b[p + 1 :] if len(a) == len(b) else b[p:])


def plain_variants(counts, ratio=10):
    out, form, by_length = [], {}, defaultdict(list)
    for word in counts:
        by_length[len(word)].append(word)
    neighbours = {
        w: [v for k in (len(w) - 1, len(w), len(w) + 1) for v in by_length[k] if near(w, v)] for w in counts
    }
    for word, n in counts.items():
        best = min(neighbours[word], key=lambda v: (-counts[v], v.encode()), default=None)
        form[word] = best if best is not None and counts[best] >= ratio * n else None
    for word, n in counts.items():
        root = word
        while form[root] is not None:
            root = form[root]
        out.append((word, form[word], root, n, len(neighbours[word]), counts.get(form[word])))
    return sorted(out, key=str)


def test_variants_of_random_words(spark):
    pick = random.Random(3)
    words = {"".join(pick.choices("abé😀", k=pick.randint(1, 6))) for _ in range(500)}
    counts = {word: pick.choice([1, 2, 5, 50, 500, 6000]) for word in sorted(words)}
    rows = list(counts.items())
    df = spark.createDataFrame(rows + rows[:5] + [(None, 3), ("", 4)], "word STRING, n LONG").selectExpr("*", "'x' AS near", "1 AS s", "2 AS node")
    result = spelling.group_variants(df.repartition(3))
    assert sorted((tuple(row) for row in result.collect()), key=str) == plain_variants(counts)


def test_long_words_cost_few_rounds(spark):
    """Levels in which nothing branches are passed together."""
    long = "thingst" * 300
    words = [long, long[:900] + long[901:], long[:500] + "y" + long[500:], long[:30] + "x" + long[31:], "a" * 90, "a" * 91]
    counts = {word: 1 + 20 * (word == long) for word in words}
    result = spelling.group_variants(spark.createDataFrame(list(counts.items()), "word STRING, n LONG"))
    assert sorted((tuple(row) for row in result.collect()), key=str) == plain_variants(counts)


def test_variants_of_an_empty_table(spark):
    empty = spark.createDataFrame([], "word STRING, n LONG")
    assert spelling.group_variants(empty).count() == 0
    with pytest.raises(ValueError):
        spelling.group_variants(empty, ratio=1)


def plain_op12(docs):
    counts = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{doc_id}:{run}".encode())
            if h % 31 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            if len(run) >= 7:
                counts[run] += 1
    return plain_variants({word: n for word, n in counts.items() if n >= 2})


def test_op12_on_odd_documents(spark, folder):
    pick = random.Random(9)
    stems = ["Kartoffel", "kartoffel", "ÉTUDIANT", "étudiant", "übersetzt", "walking", "WALKING", "naïvetés", "mañana×x÷y", "sträßchen"]
    docs = [(d, " ".join(pick.choices(stems, k=pick.randint(0, 90))) + "1. Kartoffel2walking") for d in range(120)]
    docs += [(500, None), (501, ""), (502, "x" * 3000 + " " + "x" * 3000), (500, "kartoffel kartoffel"), (500, "kartoffel kartoffel")]
    df = spark.createDataFrame(docs, "doc_id LONG, text STRING").selectExpr("*", "'x' AS word", "1 AS run", "2 AS key")
    df.write.parquet(f"{folder}/documents.parquet")
    result = queries.queries()["op12_spelling"](spark, folder)
    got = sorted((tuple(row) for row in result.collect()), key=str)
    assert got == plain_op12(docs) and any(row[1] for row in got)
    assert result.dtypes == [("word", "string"), ("form", "string"), ("root", "string"), ("n", "bigint"), ("n_near", "bigint"), ("form_n", "bigint")]


def test_op12_on_the_given_documents(spark):
    sf_dir = f"{TESTDATA}/sf0.001"
    docs = [tuple(row) for row in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    got = [tuple(row) for row in queries.queries()["op12_spelling"](spark, sf_dir).collect()]
    assert sorted(got, key=str) == plain_op12(docs)


# --- SentencePiece ---------------------------------------------------------------

ODD_PARTS = ["a", "the", " ", "  ", "\n", "é", "日本", "😀", "▁", "\t", "<s>", "</s>", "<0x0A>", "\x00", "ﬁ", "́", "0", "ing", "\r\n", "　"]


@pytest.fixture(scope="module")
def codec():
    return pieces.PieceCodec(tokenizer_path("piece_bpe_32k.model"))


def test_agenda_gives_the_librarys_ids(codec):
    pick = random.Random(1)
    texts = ["".join(pick.choices(ODD_PARTS, k=pick.randint(0, 30))) for _ in range(1500)]
    texts += ["", "a" * 5000, " " * 999, "ab" * 900 + " " * 40 + "x"]
    small = pieces.PieceCodec(tokenizer_path("piece_bpe_32k.model"), max_units=10)
    for k in range(0, len(texts), 100):
        part = texts[k : k + 100]
        expected = codec.library.encode(part, add_bos=True, add_eos=True)
        for own in (codec, small):
            assert [np.frombuffer(ids, dtype="<u4").tolist() for ids in own.encode(part)] == expected


def test_many_agendas_at_once_give_what_one_gives(codec):
    pick = random.Random(2)
    units = ["▁" + "".join(pick.choices("thineraos", k=pick.randint(1, 25))) for _ in range(2000)]
    assert codec.merge_many(units) == [codec._unit(unit) for unit in units]
    assert codec.merge_many([]) == [] and "".join(codec.merge("▁thing")) == "▁thing"


def test_units_with_unlisted_characters_are_merged_with_the_others(codec, monkeypatch):
    """Line feeds and rare characters part a unit; its stretches need no agenda of their own."""
    own = pieces.PieceCodec(tokenizer_path("piece_bpe_32k.model"))
    monkeypatch.setattr(own, "_unit", lambda text: pytest.fail(f"one by one: {text!r}"))
    texts = ["one line.\nanother line\n\nthe 𐍈x third", "a \n\nb", "x\ny \U000F0000z"]
    expected = codec.library.encode(texts, add_bos=True, add_eos=True)
    assert [np.frombuffer(ids, dtype="<u4").tolist() for ids in own.encode(texts)] == expected


def test_a_wrong_id_is_an_error(codec, monkeypatch):
    monkeypatch.setattr(codec, "encode", lambda texts: [b"\0\0\0\0" for _ in texts])
    with pytest.raises(ValueError):
        codec.checked(["a"])


def test_op13_against_the_library(spark, folder, odd_docs, codec):
    odd_docs.selectExpr("*", "'x' AS ids", "'y' AS decoded").write.parquet(f"{folder}/documents.parquet")
    got = [tuple(row) for row in queries.queries()["op13_pieces"](spark, folder).collect()]
    expected = []
    for row in odd_docs.select("doc_id", "text").collect():
        ids = codec.library.encode(row.text or "", add_bos=True, add_eos=True)
        raw, text = np.array(ids, dtype="<u4").tobytes(), codec.library.decode(ids)
        expected.append((row.doc_id, len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert sorted(got, key=str) == sorted(expected, key=str)
    assert pieces.encode_and_decode(odd_docs.filter("false")).count() == 0


def test_codec_keeps_a_clashing_id_name(spark):
    df = spark.createDataFrame([(1, "a b")], "ids LONG, text STRING")
    row = pieces.encode_and_decode(df, id_col="ids").first()
    assert row["ids"] == 1 and row["decoded"] == "a b" and len(row["ids_"]) == 16
