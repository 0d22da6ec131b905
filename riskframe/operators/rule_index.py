"""Large rule packs (P5, S7): thousands of patterns against a text table.

An alternation of all patterns tests every pattern at every place of every
text.  Here each pattern is filed under one byte gram that any match of it must
contain, the rarest such gram in the texts.  The index of a pack of up to
``INDEX_BROADCAST`` patterns and grams travels to the texts, which are read
where they lie: literals are tested in the order of the verdict up to the
first match, and a text moves on only for the regular expressions before it.
Larger packs meet the texts by an equi-join on grams, and the candidate pairs
are checked exactly.
Patterns without a literal run as long as a gram have no such key and are
tested by alternations of bounded length.

The verdict of a text is its matching pattern with the smallest (priority,
pattern id), as with one alternation per priority in order.
"""
from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.session import cut_lineage

GRAM = 5
PLAIN_AT_ONCE = 200
INDEX_BROADCAST = 100_000
UNINDEXED = 5_000

_SPECIAL = set(".^$*+?{}[]\\|()")


def literal_runs(pattern: str) -> list[str]:
    """Strings that every match of a regular expression contains: runs of
    plain characters outside groups and sets, cut where a quantifier makes
    the last one optional.  An alternation at the top has none, nor has a
    pattern with flags."""
    if re.search(r"\(\?[a-zA-Z-]+[:)]", pattern):   # flags change what a literal means
        return []
    runs, run, depth, i = [], "", 0, 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\" and i + 1 < len(pattern):
            plain = not pattern[i + 1].isalnum()
            c, i = (pattern[i + 1] if plain else ""), i + 1
            special = not plain
        else:
            special = c in _SPECIAL
        if special:
            if c and c in "*?{" and run and depth == 0:
                run = run[:-1]
            if depth == 0 and c == "|":
                return []
            if depth == 0 and run:
                runs.append(run)
            run = ""
            if c == "(":
                depth += 1
            elif c == ")":
                depth -= 1
            elif c == "[":
                end = pattern.find("]", i + 2)
                i = len(pattern) if end < 0 else end
            elif c == "{":
                end = pattern.find("}", i)
                i = len(pattern) if end < 0 else end
        elif depth == 0:
            run += c
        i += 1
    return [*runs, run] if run else runs


def pattern_frame(spark, rules: list[tuple[int, int, str, bool]]) -> DataFrame:
    """``(pattern_id, priority, pattern, literal)`` rows; ``literal`` ones
    are plain strings, the others regular expressions."""
    return spark.createDataFrame(rules, "pattern_id long, priority int, pattern string, literal boolean")


def different_grams(t: str | None, size: int) -> np.ndarray:
    """The different grams of ``size`` bytes of a text, ascending."""
    x = np.frombuffer((t or "").encode(), np.uint8).astype(np.int64)
    m = len(x) - size + 1
    if m <= 0:
        return np.zeros(0, np.int64)
    g = np.zeros(m, np.int64)
    for j in range(size):
        g = (g << 8) | x[j:j + m]
    return np.unique(g)


def places(u: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Places in the ascending ``among`` of those values of ``u`` that it has."""
    if not len(among):
        return np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(among, u), len(among) - 1)
    return at[among[at] == u]


def gram_counts(texts: DataFrame, wanted: np.ndarray, size: int) -> DataFrame:
    """``gram, c``: in how many rows of ``__id, __t`` each wanted gram
    occurs; a task sends one row a gram that it met."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = np.zeros(len(wanted), np.int64)
        for b in batches:
            for t in b.column(0):
                c[places(different_grams(t.as_py(), size), wanted)] += 1
        met = np.flatnonzero(c)
        yield pa.RecordBatch.from_arrays([pa.array(wanted[met]), pa.array(c[met])], ["gram", "c"])
    return texts.where("__id is not null").select("__t").mapInArrow(run, "gram long, c long").groupBy("gram").agg(F.sum("c").alias("c"))


def first_hits(texts: DataFrame, filed: list[tuple[int, int]], ranked: list[tuple[int, str, bool]], size: int) -> DataFrame:
    """``__id, __t, pattern_id``: of every text of ``__id, __t`` its first
    literal among the patterns filed under a gram it holds (text null: it is
    a match), and each regular expression that goes before it and has yet to
    be tested on the text.  ``filed``: ascending (gram, place in ``ranked``);
    ``ranked``: (pattern id, pattern, literal) in the order of the verdict."""
    keys, place = (np.array([f[k] for f in filed], np.int64) for k in (0, 1))
    start = np.flatnonzero(np.diff(keys, prepend=-1))
    own, groups = keys[start], np.split(place, start[1:])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple[int, str | None, int]] = []
            for i, t in zip(b.column(0), b.column(1), strict=True):
                text = t.as_py()
                k = places(different_grams(text, size), own)
                for r in np.unique(np.concatenate([groups[x] for x in k])) if len(k) else ():
                    pattern_id, pattern, literal = ranked[r]
                    if not literal:
                        rows.append((i.as_py(), text, pattern_id))
                    elif pattern in text:
                        rows.append((i.as_py(), None, pattern_id))
                        break
            if rows:
                ids, again, found = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(again, pa.string()), pa.array(found, pa.int64())], ["__id", "__t", "pattern_id"])
    return texts.where("__id is not null").mapInArrow(run, "__id long, __t string, pattern_id long")


def grams(df: DataFrame, id_col: str, text_col: str, size: int = GRAM) -> DataFrame:
    """``id, gram``: the different grams of ``size`` bytes of each text, as
    numbers (exact up to 7 bytes)."""
    if not 1 <= size <= 7:
        raise ValueError("a gram has 1 to 7 bytes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start in range(0, b.num_rows, 256):
                ids, keys, n = [], [], []
                for i, t in zip(b.column(0).slice(start, 256).to_pylist(), b.column(1).slice(start, 256).to_pylist(), strict=True):
                    u = different_grams(t, size)
                    if len(u):
                        ids.append(i)
                        keys.append(u)
                        n.append(len(u))
                if ids:
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(ids, np.int64), n)), pa.array(np.concatenate(keys))], ["id", "gram"])
    return df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t")).where("id is not null").mapInArrow(run, "id long, gram long")


def match(texts: DataFrame, patterns: DataFrame, id_col: str, text_col: str, size: int = GRAM) -> DataFrame:
    """``id_col, pattern_id, priority`` of the first matching pattern of every
    text that matches one.  Matching is case-sensitive, on the text as it
    is (normalise first); ids are taken to be unique."""
    runs = F.udf(literal_runs, "array<string>", useArrow=False)
    keep = cut_lineage(patterns.select("pattern_id", "priority", "pattern", "literal", F.when(F.col("literal"), F.array("pattern")).otherwise(runs("pattern")).alias("runs"))
                       .withColumn("runs", F.filter("runs", lambda r: F.octet_length(r) >= size)))
    filed = cut_lineage(grams(keep.select("pattern_id", F.explode("runs").alias("run")), "pattern_id", "run", size)
                        .select(F.col("id").alias("pattern_id"), "gram").distinct())
    t = texts.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).alias("__t"))
    wanted = cut_lineage(filed.select("gram").distinct())
    rules = keep.select("pattern_id", "priority", "pattern", "literal")
    small = rules.count() <= INDEX_BROADCAST
    rules = F.broadcast(rules) if small else rules
    # the index travels with the tasks behind a count only; beyond it the join
    # shuffles narrow rows
    index = small and wanted.count() <= INDEX_BROADCAST
    if index:
        count = gram_counts(t, np.array(sorted(r.gram for r in wanted.collect()), np.int64), size)
    else:
        seen = cut_lineage(grams(t, "__id", "__t", size).withColumnRenamed("id", "__id").join(wanted, "gram", "left_semi"))
        count = seen.groupBy("gram").agg(F.count("*").alias("c"))
    rarest = (filed.join(count, "gram", "left").groupBy("pattern_id")
              .agg(F.min(F.struct(F.coalesce("c", F.lit(0)).alias("c"), "gram")).alias("g")).select("pattern_id", "g.gram", "g.c")).where("c > 0")
    if index:
        ranked = [(r.pattern_id, r.pattern, r.literal) for r in keep.orderBy("priority", "pattern_id").select("pattern_id", "pattern", "literal").collect()]
        at: dict[int, list[int]] = {}
        for i, r in enumerate(ranked):
            at.setdefault(r[0], []).append(i)
        checked = (first_hits(t, sorted((r.gram, i) for r in rarest.collect() for i in at[r.pattern_id]), ranked, size).join(rules, "pattern_id")
                   .where(F.col("__t").isNull() | F.expr("__t rlike pattern")))
    else:
        pairs = seen.join(rarest.select("gram", "pattern_id"), "gram").select("__id", "pattern_id").join(rules, "pattern_id").join(t, "__id")
        checked = pairs.where(F.when(F.col("literal"), F.col("__t").contains(F.col("pattern"))).otherwise(F.expr("__t rlike pattern")))
    hits = checked.select("__id", "priority", "pattern_id")
    rest = keep.where(F.size("runs") == 0).orderBy("priority", "pattern_id").limit(UNINDEXED + 1).collect()
    if len(rest) > UNINDEXED:
        raise OverflowError(f"more than {UNINDEXED} patterns without a literal run of {size} characters")
    if rest:
        hits = hits.unionByName(_by_alternation(t, rest))
    return hits.groupBy(F.col("__id").alias(id_col)).agg(F.min(F.struct("priority", "pattern_id")).alias("m")).select(id_col, "m.pattern_id", "m.priority")


def _by_alternation(t: DataFrame, rules: list) -> DataFrame:
    """First matching pattern among those that have no gram: alternations
    decide which block of patterns to test one by one."""
    out = []
    for i in range(0, len(rules), PLAIN_AT_ONCE):
        part = [(r["priority"], r["pattern_id"], re.escape(r["pattern"]) if r["literal"] else r["pattern"]) for r in rules[i:i + PLAIN_AT_ONCE]]
        first = reduce(lambda w, r: w.when(F.col("__t").rlike(r[2]), F.struct(F.lit(r[0]).alias("priority"), F.lit(r[1]).cast("long").alias("pattern_id"))),
                       part[1:], F.when(F.col("__t").rlike(part[0][2]), F.struct(F.lit(part[0][0]).alias("priority"), F.lit(part[0][1]).cast("long").alias("pattern_id"))))
        any_of = F.col("__t").rlike("|".join(f"(?:{r[2]})" for r in part))
        out.append(t.where(any_of).select("__id", first.alias("m")).select("__id", "m.priority", "m.pattern_id"))
    return reduce(lambda a, b: a.unionByName(b), out)
