"""How far the sources of a language differ in their terms, and by which terms.

Every kept term has a smoothed share p = 1 + floor(scale * (count + 2) / (N + 2V)) in
each (lang, source) group and in each language; the divergence of two shares is
f = floor((p - q)^2 / (p + q)).  All arithmetic is on integers.

* Terms of a group are ranked by count cells: terms with the same count in the group and
  in the language have the same f, so f is evaluated once for each cell, cells of
  equal value are merged, levels are ranked by the number of terms above them, and only
  the levels that reach into the wanted ranks are expanded into terms, in UTF-8 order.
* Pairs of sources sum f over all kept terms.  Terms are dealt out by a hash, and each task
  adds up a table of sources by sources; pairs of rows are never made.  Terms that neither
  source of a block pair has are counted, not listed.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliant.llm.shared import stored

#: Bytes of terms as they are, A-Z in lower case, all others as blanks.
TERM_BYTES = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if 0x61 <= c <= 0x7A or c >= 0x80 else 0x20
    for c in range(256)
)
#: Bytes of a text that are split at once; distinct terms a task holds before it emits them.
TEXT_AT_ONCE, TERMS_HELD = 1 << 20, 1 << 18
ROWS_AT_ONCE = 1 << 14
#: Sources in a block of the pair tables, term counts in one task group, shares worked on at once.
SOURCES_PER_BLOCK, COUNTS_PER_GROUP, SHARES_AT_ONCE = 256, 1 << 16, 1 << 20


@dataclass(frozen=True)
class AuditRule:
    """Terms in at least ``least_documents`` documents of a language are kept.

    ``ranks`` terms of each group are returned; ``scale`` is the whole that shares are
    parts of, at most 10^9, so that squares of differences stay within 64 bits.
    """

    least_documents: int = 10
    ranks: int = 10
    scale: int = 1_000_000_000

    def __post_init__(self) -> None:
        if not 1 <= self.scale <= 1_000_000_000:
            raise ValueError("scale must be between 1 and 10^9")


def terms(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, lower-cased, in parts of bounded size (but for huge terms)."""
    text = text.translate(TERM_BYTES)
    start = 0
    while start < len(text):
        end = text.find(b" ", start + TEXT_AT_ONCE)
        end = len(text) if end < 0 else end
        yield text[start:end].split()
        start = end


class _Held:
    """Counts of terms by group, as far as a task holds them."""

    def __init__(self) -> None:
        self.groups: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        self.size = 0

    def add(self, group: tuple[str, str], text: bytes) -> None:
        counts, docs = self.groups.setdefault(group, (Counter(), Counter()))
        before, seen = len(counts), set()
        for part in terms(text):
            counts.update(part)
            seen.update(part)
        docs.update(seen)
        self.size += len(counts) - before

    def emptied(self) -> Iterator[pa.RecordBatch]:
        for (lang, source), (counts, docs) in self.groups.items():
            # A row without a term stands for the group itself.
            found = [None, *counts]
            for at in range(0, len(found), ROWS_AT_ONCE):
                some = found[at: at + ROWS_AT_ONCE]
                yield pa.RecordBatch.from_arrays([
                    pa.array([lang] * len(some), pa.string()),
                    pa.array([source] * len(some), pa.string()),
                    pa.array(some, pa.binary()),
                    pa.array([counts[t] for t in some], pa.int64()),
                    pa.array([docs[t] for t in some], pa.int64()),
                ], names=["lang", "source", "term", "n", "docs"])
        self.groups, self.size = {}, 0


def term_counts(
    docs: DataFrame, *, text: str = "text", lang: str = "lang", source: str = "source",
) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of each term of a group.

    A row without a term stands for each group, also one without any term.  Null texts,
    languages and sources count as empty.
    """
    read = docs.select(
        F.coalesce(F.col(lang), F.lit("")).alias("lang"),
        F.coalesce(F.col(source), F.lit("")).alias("source"),
        F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"),
    )

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Held()
        for batch in batches:
            groups = zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist())
            for group, text in zip(groups, batch.column("text")):
                held.add(group, text.as_py())
                if held.size > TERMS_HELD:
                    yield from held.emptied()
        yield from held.emptied()

    parts = read.mapInArrow(
        counted, "lang string, source string, term binary, n bigint, docs bigint")
    return parts.groupBy("lang", "source", F.col("term").cast("string").alias("term")).agg(
        F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _share(count: str, total: str, rule: AuditRule) -> str:
    """SQL of a smoothed share; null where a language keeps no term."""
    return f"1 + ({rule.scale}BD * ({count} + 2)) div nullif({total} + 2 * v, 0)"


_DIVERGENCE = "(p - q) * (p - q) div (p + q)"


class Audit:
    """The counts that both parts of an audit are made of, as written tables.

    ``groups``: lang, source, slot (from 0 in a language, by source), n (kept occurrences in
    the group), n_lang, v (kept terms of the language) and ``none``, the share of a term
    that does not occur.  ``kept``: lang, source, term, c, c_lang, for the counts above zero.
    """

    def __init__(self, docs: DataFrame, rule: AuditRule = AuditRule(), **columns: str) -> None:
        self.rule = rule
        counts = stored(term_counts(docs, **columns), "term-counts")
        listed = counts.filter("term IS NOT NULL")
        totals = listed.groupBy("lang", "term").agg(
            F.sum("n").alias("c_lang"), F.sum("docs").alias("docs")
        ).filter(F.col("docs") >= rule.least_documents).drop("docs")
        self.kept = stored(
            listed.join(totals, ["lang", "term"]).select(
                "lang", "source", "term", F.col("n").alias("c"), "c_lang"), "kept-terms")
        langs = self.kept.select("lang", "term", "c_lang").distinct().groupBy("lang").agg(
            F.count(F.lit(1)).alias("v"), F.sum("c_lang").alias("n_lang"))
        own = self.kept.groupBy("lang", "source").agg(F.sum("c").alias("n"))
        slot = F.row_number().over(Window.partitionBy("lang").orderBy("source")).cast("bigint") - 1
        groups = counts.filter("term IS NULL").select("lang", "source").join(
            own, ["lang", "source"], "left").join(langs, "lang", "left")
        self.groups = stored(
            groups.na.fill(0, ["n", "n_lang", "v"]).withColumn("slot", slot).withColumn(
                "none", F.expr(_share("0", "n", rule))), "audit-groups")

    def ranked_terms(self) -> DataFrame:
        """(lang, source, item, value, rank): the first terms that a group has more than its language."""
        group, ranks = ["lang", "source"], self.rule.ranks
        cells = self.kept.groupBy(*group, "c", "c_lang").agg(F.count(F.lit(1)).alias("m")).join(
            self.groups, group
        ).withColumn("p", F.expr(_share("c", "n", self.rule))).withColumn(
            "q", F.expr(_share("c_lang", "n_lang", self.rule))).filter("p > q")
        cells = stored(
            cells.select(*group, "c", "c_lang", "m", F.expr(_DIVERGENCE).alias("value")),
            "count-cells")
        # Every level holds a term, so no more levels than ranks are needed of a group.
        best = Window.partitionBy(*group).orderBy(F.desc("value"))
        levels = cells.groupBy(*group, "value").agg(F.sum("m").alias("m")).withColumn(
            "level", F.row_number().over(best)).filter(F.col("level") <= ranks)
        levels = levels.withColumn("above", F.sum("m").over(best) - F.col("m")).filter(
            F.col("above") < ranks)
        chosen = cells.join(levels.select(*group, "value", "above"), [*group, "value"])
        in_order = Window.partitionBy(*group, "value").orderBy("term")
        expanded = self.kept.join(
            chosen.select(*group, "c", "c_lang", "value", "above"), [*group, "c", "c_lang"]
        ).withColumn("place", F.row_number().over(in_order)).filter(F.col("place") <= ranks)
        return expanded.withColumn("rank", (F.col("above") + F.col("place")).cast("int")).filter(
            F.col("rank") <= ranks).select(*group, F.col("term").alias("item"), "value", "rank")

    def _pair_sums(self) -> DataFrame:
        """(lang, a, b, total, seen), a < b slots: f summed over the terms that their blocks have."""
        block = (F.col("slot") / SOURCES_PER_BLOCK).cast("int")
        shape = self.groups.groupBy("lang").agg(
            (F.max(block) + 1).alias("blocks"),
        ).join(self.kept.groupBy("lang").agg(F.count(F.lit(1)).alias("n_counts")), "lang")
        shape = stored(shape.select("lang", "blocks", F.greatest(F.lit(1), F.ceil(
            F.col("n_counts") * F.least(F.lit(1.0), 2 / F.col("blocks")) / COUNTS_PER_GROUP
        )).cast("int").alias("parts")), "audit-shape")

        def dealt(rows: DataFrame) -> DataFrame:
            """Each row once for each block that its own block meets."""
            return rows.withColumn("own", block).withColumn(
                "other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn(
                "lo", F.least("own", "other")).withColumn("hi", F.greatest("own", "other"))

        own = self.kept.join(self.groups, ["lang", "source"]).join(shape, "lang").withColumn(
            "part", F.expr("cast(pmod(xxhash64(term), parts) as int)")
        ).withColumn("p", F.expr(_share("c", "n", self.rule)))
        rows = dealt(own).select("lang", "lo", "hi", "part", "slot", "term", "p")
        every = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
        bases = dealt(self.groups.join(shape, "lang").withColumn("part", every)).select(
            "lang", "lo", "hi", "part", "slot", "none"
        ).toDF("lang", "lo", "hi", "part", "slot", "none")  # columns of its own, for the cogroup

        def summed(key: tuple, counts: pa.Table, base: pa.Table) -> pa.Table:
            lang, lo, hi = (k.as_py() for k in key[:3])
            i, j, total, seen = pair_sums(
                counts["term"], counts["slot"].to_numpy(), counts["p"].to_numpy(),
                base["slot"].to_numpy(), base["none"].to_numpy(), lo, hi)
            return pa.table({
                "lang": pa.array([lang] * len(i), pa.string()), "a": i, "b": j, "total": total,
                "seen": np.full(len(i), seen)})

        keys = ("lang", "lo", "hi", "part")
        sums = rows.groupBy(*keys).cogroup(bases.groupBy(*keys)).applyInArrow(
            summed, "lang string, a bigint, b bigint, total bigint, seen bigint")
        return sums.groupBy("lang", "a", "b").agg(
            F.sum("total").alias("total"), F.sum("seen").alias("seen"))

    def ranked_pairs(self) -> DataFrame:
        """(lang, source, item, value, rank): all other sources of a group's language, farthest first."""
        sums = stored(self._pair_sums(), "pair-sums")
        both = sums.unionByName(sums.selectExpr("lang", "b AS a", "a AS b", "total", "seen"))
        own = self.groups.select("lang", "source", F.col("slot").alias("a"), "v",
                                 F.col("none").alias("p"))
        other = self.groups.select("lang", F.col("source").alias("item"), F.col("slot").alias("b"),
                                   F.col("none").alias("q"))
        pairs = own.join(other, "lang").filter("a != b").join(both, ["lang", "a", "b"], "left")
        value = F.expr(
            f"coalesce(total, 0) + (v - coalesce(seen, 0)) * coalesce({_DIVERGENCE}, 0)")
        farthest = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
        return pairs.withColumn("value", value).select(
            "lang", "source", "item", "value", F.row_number().over(farthest).alias("rank"))


def pair_sums(
    term: pa.ChunkedArray | pa.Array, slot: np.ndarray, p: np.ndarray, slots: np.ndarray,
    none: np.ndarray, lo: int, hi: int,
) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(a, b, sums, number of terms) of the pairs of slots of two blocks.

    One row (term, slot, share) for each count above zero; ``none`` has the share of an
    absent term for each of ``slots``.
    """
    term = term.combine_chunks() if isinstance(term, pa.ChunkedArray) else term
    codes = term.dictionary_encode().indices.to_numpy()
    order = np.argsort(slots)
    slots, none = slots[order], none[order]
    by_term = np.argsort(codes, kind="stable")
    codes, p, at = codes[by_term], p[by_term], np.searchsorted(slots, slot[by_term])
    n_terms = int(codes[-1]) + 1 if len(codes) else 0
    left = np.flatnonzero(slots // SOURCES_PER_BLOCK == lo)
    right = np.flatnonzero(slots // SOURCES_PER_BLOCK == hi)
    sums = np.zeros((len(left), len(right)), dtype=np.int64)
    step = max(1, SHARES_AT_ONCE // max(1, len(slots)))
    for first in range(0, n_terms, step):
        begin, end = np.searchsorted(codes, [first, first + step])
        shares = np.repeat(none[None, :], min(step, n_terms - first), axis=0)
        shares[codes[begin:end] - first, at[begin:end]] = p[begin:end]
        others = shares[:, right]
        for row, column in enumerate(left):
            own = shares[:, column: column + 1]
            apart = own - others
            sums[row] += (apart * apart // (own + others)).sum(axis=0)
    i, j = np.repeat(left, len(right)), np.tile(right, len(left))
    once = i < j
    return slots[i[once]], slots[j[once]], sums.ravel()[once], n_terms


def source_divergence(
    docs: DataFrame, rule: AuditRule = AuditRule(), *, text: str = "text", lang: str = "lang",
    source: str = "source",
) -> DataFrame:
    """(lang, source, part, item, value, rank), ranks from 1 in each group and part.

    Part ``pair``: each other source of the language, with f of the two groups' shares
    summed over all kept terms, zero if none is kept.  Part ``term``: the first terms
    that the group has and whose share is larger there than in the language.  Higher
    values first, ties in UTF-8 order of the item.

    Null texts, languages and sources count as empty strings, and empty ones are values
    like any other; a group whose texts hold no term still has its pairs.  Every row is a
    document of its own, also a repeated one.  Other columns are not read.  An empty
    table gives no rows.
    """
    audit = Audit(docs, rule, text=text, lang=lang, source=source)
    columns = ["lang", "source", "part", "item", "value", "rank"]
    pairs = audit.ranked_pairs().withColumn("part", F.lit("pair"))
    found = audit.ranked_terms().withColumn("part", F.lit("term"))
    return pairs.select(*columns).unionByName(found.select(*columns))
