"""Spelling variants: words one edit apart, found by walking a trie level by level.

The trie is a distributed edge table, made one level at a time: an edge leads from a
prefix by one code point to a longer prefix, or, where only one word goes on from
there, straight to that word. The frontier is a table of states (word, position, node,
edits). Each round joins the states of a level with its edges: a state steps along the
edge of its next code point, and one without edits may also replace that code point or
leave it out. A state with an edit that meets the end of its word in a terminal edge, or
the rest of it on a single word's edge, has found a neighbour.

Each edit is looked for where the trie is thin. If it lies in the second half of a word,
the first half leads to a node deep in the trie, where few edges leave; if in the first
half, the same holds in the trie of the reversed words. So words enter at the node of
their half and make edits from there on, in both tries. Of two words of one length the
one with the smaller code point finds the other, of two lengths the longer one does.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from millrace.llm.tables import written

# Marks a word's end among the code points that follow a node; the empty text stands in the edges themselves.
_END = "\0"


def word_counts(occurrences: DataFrame, min_count: int = 2, min_length: int = 1) -> DataFrame:
    """``word, n`` of the words that occur often enough in ``occurrences`` (``word``, a row for each).

    Nulls and words shorter than ``min_length`` code points are left out; an empty table
    gives an empty one. Counts are summed up before the shuffle, so a word in every
    row costs a row per task.
    """
    counted = occurrences.filter(F.length("word") >= min_length).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counted.filter(F.col("n") >= min_count)


def neighbour_pairs(words: DataFrame, jump_from: int = 24) -> DataFrame:
    """``word, n, near, near_n``: each pair of distinct words one edit apart, both ways round.

    ``words`` is a written table of ``word`` and ``n``, each word once; nulls and empty words are left
    out, other columns are not looked at. An edit is one code point inserted,
    deleted or replaced. An empty table gives an empty one. Every node has at most
    as many edges as the alphabet has signs, so the states grow with the words, not
    with their pairs; a node that many words share is split by adaptive execution.
    There are as many rounds as the longest prefix that two words share, but from the
    level ``jump_from`` on stretches in which no node has two edges are passed in one,
    so that two copies of a very long word cost no round for each code point.
    """
    plain = words.select("word", F.col("n").cast("long").alias("n")).filter("word <> ''")
    start = plain.agg(F.min(F.length("word"))).first()[0]
    if start is None:
        return plain.select("word", "n", F.col("word").alias("near"), F.col("n").alias("near_n"))
    depth = start // 2
    both = plain.select("n", F.explode(F.array(F.lit(False), F.lit(True))).alias("back"), "word")
    alive = both.select(
        F.when(F.col("back"), F.reverse("word")).otherwise(F.col("word")).alias("s"),
        "n",
        "back",
        # Where the edits of this walk begin; the other walk takes those before.
        F.expr("IF(back, length(word) - length(word) div 2, length(word) div 2)").cast("int").alias("half"),
    ).withColumn("node", F.concat(F.col("back").cast("int").cast("string"), _part(F.col("s"), 0, depth)))
    alive, states, found = written(alive), None, []
    while not (alive.isEmpty() and (states is None or states.isEmpty())):
        length = _unbranched(alive, depth) if depth >= jump_from else 0
        if length:
            level = written(_jump(alive, states, depth, length))
        else:
            edges = written(_edges(alive, depth))
            frontier = _frontier(alive, states, depth)
            level = written(_alive(alive, edges, depth).unionByName(_step(frontier, edges, depth), allowMissingColumns=True))
            found.append(level.filter("near IS NOT NULL"))
        depth += length or 1
        alive = level.filter("half IS NOT NULL").select("s", "n", "back", "half", "node")
        states = level.filter("half IS NULL AND near IS NULL").select("s", "n", "back", "node", "skew")
    pairs = reduce(DataFrame.unionByName, found).select(
        *(F.when(F.col("back"), F.reverse(c)).otherwise(F.col(c)).alias(name) for c, name in (("s", "word"), ("near", "near"))),
        "n",
        "near_n",
    )
    turned = pairs.select(
        F.col("near").alias("word"), F.col("word").alias("near"), F.col("near_n").alias("n"), F.col("n").alias("near_n")
    )
    # A code point left out of a run that spans both halves is found in both tries.
    return pairs.unionByName(turned).distinct().select("word", "n", "near", "near_n")


def _part(text: Column, start: int | Column, length: int | Column | None = None) -> Column:
    """Code points of a text from a position, counted from 0."""
    start = F.lit(start) if isinstance(start, int) else start
    if length is None:
        return F.substring(text, start + 1, F.length(text))
    return F.substring(text, start + 1, F.lit(length) if isinstance(length, int) else length)


def _edges(alive: DataFrame, depth: int) -> DataFrame:
    """The edges that leave the nodes of a level: ``at, ch, child, onto, onto_n, nexts``.

    ``onto`` is the word, if only one goes on along the edge. ``nexts`` are the code
    points that follow behind the edge. All of it is summed up before the shuffle.
    """
    s, ch = F.col("s"), _part(F.col("s"), depth, 1)
    after = _part(s, depth + 1, 1)
    keyed = alive.select(
        F.col("node").alias("at"), ch.alias("ch"), "s", "n", F.when(after == "", _END).otherwise(after).alias("after")
    )
    summed = keyed.groupBy("at", "ch").agg(
        F.count(F.lit(1)).alias("m"), F.min("s").alias("onto"), F.min("n").alias("onto_n"), F.collect_set("after").alias("nexts")
    )
    single = F.col("m") == 1
    return summed.select(
        "at",
        "ch",
        F.when(single, F.col("onto")).alias("onto"),
        F.when(single, F.col("onto_n")).alias("onto_n"),
        F.when(~single, F.array_join("nexts", "")).alias("nexts"),
    )


def _alive(alive: DataFrame, edges: DataFrame, depth: int) -> DataFrame:
    """The words that go on to the next level, in company."""
    shared = edges.filter("onto IS NULL").select("at", "ch")
    on = (F.col("node") == F.col("at")) & (_part(F.col("s"), depth, 1) == F.col("ch"))
    joined = alive.join(shared, on, "left_semi")
    return joined.withColumn("node", F.concat("node", _part(F.col("s"), depth, 1)))


def _unbranched(alive: DataFrame, depth: int) -> int:
    """A power of two of levels, from this one on, in which every node has one edge; 0 if there are none."""
    spans = [1 << k for k in range(16)]
    ends = alive.groupBy("node").agg(F.min("s").alias("a"), F.max("s").alias("b"))
    same = ends.agg(*(F.bool_and(_part(F.col("a"), depth, k) == _part(F.col("b"), depth, k)).alias(str(k)) for k in spans))
    return max((k for k, one in zip(spans, same.first() or ()) if one), default=0)


def _jump(alive: DataFrame, states: DataFrame | None, depth: int, length: int) -> DataFrame:
    """The rows of ``_alive`` and ``_step`` some levels on, where nodes have one edge each.

    The words that are alive lie on those edges, and an edit by one of them would need
    another edge. The states keep to them or end.
    """
    onward = alive.withColumn("node", F.concat("node", _part(F.col("s"), depth, length)))
    if states is None:
        return onward.withColumn("skew", F.lit(None).cast("int")).withColumn("near", F.lit(None).cast("string"))
    edges = onward.select("node").distinct().select(
        F.col("node").alias("child"), F.expr(f"left(node, length(node) - {length})").alias("at")
    )
    follows = F.concat("node", _part(F.col("s"), F.lit(depth) + F.col("skew"), length)) == F.col("child")
    kept = states.join(edges, (F.col("node") == F.col("at")) & follows).withColumn("node", F.col("child")).drop("child", "at")
    return onward.unionByName(kept, allowMissingColumns=True).withColumn("near", F.lit(None).cast("string"))


def _frontier(alive: DataFrame, states: DataFrame | None, depth: int) -> DataFrame:
    """States at a level. ``skew`` is how far the position is ahead of the level; it is null before the edit."""
    clean = alive.filter(F.col("half") <= depth).select("s", "n", "back", "node", F.lit(None).cast("int").alias("skew"))
    return clean if states is None else clean.unionByName(states.select(clean.columns))


def _step(states: DataFrame, edges: DataFrame, depth: int) -> DataFrame:
    """One level on: states with an edit at the next nodes, and neighbours that were met."""
    s, ch, skew = F.col("s"), F.col("ch"), F.col("skew")
    edited = skew.isNotNull()
    here, ahead = _part(s, F.lit(depth) + F.coalesce(skew, F.lit(0)), 1), _part(s, depth + 1, 1)
    # Of a run of equal code points the last one is left out.
    leaves_out = ~edited & (here != "") & (here != ahead) & (ch == ahead)
    replaces = ~edited & (here != "") & (ch > here)
    steps = edited & (ch == here)

    def onward(when: Column, by: Column) -> Column:
        """The state behind the edge, or the neighbour there; null if neither can be."""
        rest = F.lit(depth + 1) + by
        meets = _part(s, rest) == _part(F.col("onto"), depth + 1)
        following = _part(s, rest, 1)
        goes = F.col("nexts").contains(F.when(following == "", F.lit(_END)).otherwise(following))
        return F.when(
            when & F.when(F.col("onto").isNull(), goes).otherwise(meets),
            F.struct(by.alias("skew"), F.col("onto").alias("near"), F.col("onto_n").alias("near_n")),
        )

    joined = states.join(edges, (F.col("node") == F.col("at")) & (steps | leaves_out | replaces))
    ways = F.array_compact(
        F.array(
            onward(steps, F.coalesce(skew, F.lit(0))), onward(leaves_out, F.lit(1)), onward(replaces, F.lit(0))
        )
    )
    return joined.select("s", "n", "back", F.concat("node", "ch").alias("node"), F.explode(ways).alias("way")).select(
        "s", "n", "back", "node", "way.skew", "way.near", "way.near_n"
    )


def group_variants(words: DataFrame, ratio: int = 10) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every word of ``words`` (``word, n``).

    A word's form is its most frequent neighbour (ties: the smallest in code point
    order), if that one is at least ``ratio`` (2 or more) times as frequent; otherwise null. The root is where
    the forms lead in the end, the word itself if it has none. Nulls and empty words
    are left out, repeated rows count once; an empty table gives an empty result.
    """
    if ratio < 2:
        raise ValueError("a form has to be at least twice as frequent, or forms could go round in a circle")
    # Written here, as the words may be the counts of a whole corpus, which are wanted twice.
    plain = written(words.select("word", F.col("n").cast("long").alias("n")).filter("word <> ''").distinct())
    near = neighbour_pairs(plain).groupBy(F.col("word").alias("of")).agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("m"), "near")).alias("best")
    )
    joined = plain.join(near, F.col("word") == F.col("of"), "left")
    better = -F.col("best.m") >= F.col("n") * ratio
    formed = written(
        joined.select(
            "word",
            F.when(better, F.col("best.near")).alias("form"),
            "n",
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(better, -F.col("best.m")).alias("form_n"),
        )
    )
    roots = _roots(formed.filter("form IS NOT NULL").select(F.col("word").alias("of"), F.col("form").alias("to")))
    return formed.join(roots, F.col("word") == F.col("of"), "left").select(
        "word", "form", F.coalesce("to", "word").alias("root"), "n", "n_near", "form_n"
    )


def _roots(links: DataFrame) -> DataFrame:
    """Where each chain of links ends. Each round follows twice as many of them; a link at
    least doubles a frequency, so a chain has 63 at most."""
    links = written(links)
    for _ in range(6):
        further = links.select(F.col("of").alias("via"), F.col("to").alias("end"))
        joined = links.join(further, F.col("to") == F.col("via"), "left")
        moved = written(joined.select("of", F.coalesce("end", "to").alias("to"), F.col("end").isNotNull().alias("moved")))
        links = moved.select("of", "to")
        if moved.filter("moved").isEmpty():
            break
    return links
