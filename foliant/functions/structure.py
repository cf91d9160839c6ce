"""Offsets of sentences, paragraphs, pages and sections inside a text.

All offsets are 0-based code point positions.  Spark has no function that
returns match positions, so each text is cut into (text before the match,
match) segments anchored with ``\\G`` and the segment lengths are summed up.
``\\G`` keeps the scan linear: after the last match no further start is tried.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from foliant.functions.text import let

_PAGE_BREAK = r"\n\s*---\s*Page\s+\d+\s*---\s*\n"
_SECTION = r"(?:\A|(?<=[\n\r]))\s*\d+\.\s+[A-Z][^\n]{5,50}\s*(?=[\n\r]|\z)"

# Abbreviations whose dot does not end a sentence.
ABBREVIATIONS = ("Dr.", "Mr.", "Ms.", "vs.")
INTENDED_ABBREVIATIONS = ("Dr.", "Mr.", "Ms.", "vs.", "etc.", "e.g.", "i.e.", "Prof.")


def running_total(lengths: Column) -> Column:
    """Inclusive prefix sums of an integer array.

    Works block by block (about the square root of the array size each), so
    that appending to the result does not copy it once per element.
    """
    empty = F.array().cast("array<bigint>")

    def sums(values: Column) -> Column:
        return F.aggregate(
            values,
            F.struct(F.lit(0).cast("bigint").alias("total"), empty.alias("out")),
            lambda acc, v: F.struct(
                (acc["total"] + v).alias("total"),
                F.concat(acc["out"], F.array(acc["total"] + v)).alias("out"),
            ),
            lambda acc: acc["out"],
        )

    def shift(block: Column, carry: Column) -> Column:
        return F.transform(block, lambda v: v + carry)

    def shifted(blocks: Column) -> Column:
        carries = sums(F.transform(blocks, lambda b: F.element_at(b, -1)))
        return let(carries, lambda c: F.flatten(F.transform(
            blocks, lambda b, i: shift(b, F.coalesce(F.get(c, i - 1), F.lit(0)))
        )))

    def total(values: Column) -> Column:
        width = F.ceil(F.sqrt(F.size(values))).cast("int")
        starts = F.sequence(F.lit(1), F.size(values), width)
        blocks = F.transform(starts, lambda at: sums(F.slice(values, at, width)))
        return F.when(F.size(values) > 0, let(blocks, shifted)).otherwise(empty)

    return let(lengths, total)


def _segments(text: Column, pattern: str, group: int = 0) -> Column:
    """Texts running from the end of one match to the end of the next.

    With ``group`` 1 only the matches themselves.
    """
    return F.regexp_extract_all(text, F.lit(rf"\G(?s:.*?)({pattern})"), F.lit(group))


def _lengths(parts: Column) -> Column:
    return F.transform(parts, lambda s: F.length(s).cast("bigint"))


def match_ends(text: Column, pattern: str) -> Column:
    """End offset of every match."""
    return running_total(_lengths(_segments(text, pattern)))


def located_matches(text: Column, pattern: str) -> Column:
    """Every match with its start offset, ``array<struct<found, start>>``."""
    return F.zip_with(
        _segments(text, pattern, 1), match_ends(text, pattern),
        lambda found, end: F.struct(found.alias("found"), (end - F.length(found)).alias("start")),
    )


def sentence_boundaries(text: Column, fixed_abbreviations: bool = False) -> Column:
    """Offsets just after ``.``, ``!`` or ``?`` before blank, newline or tab.

    A dot after an upper-case letter or closing one of the listed
    abbreviations is none.  By default only the abbreviations that the
    three-character comparison can match count; ``fixed_abbreviations`` uses
    the intended list.
    """
    listed = INTENDED_ABBREVIATIONS if fixed_abbreviations else ABBREVIATIONS

    def is_abbreviation(part: Column, end: Column) -> Column:
        closes = F.lit(False)
        for abbreviation in listed:
            closes = closes | F.endswith(part, F.lit(abbreviation))
        upper_before = F.right(part, F.lit(2)).rlike(r"\A[A-Z]\.\z")
        return F.endswith(part, F.lit(".")) & (end >= 3) & (closes | upper_before)

    def kept(parts: Column) -> Column:
        ends = F.zip_with(parts, running_total(_lengths(parts)), lambda part, end: F.when(
            ~is_abbreviation(part, end), end
        ))
        return F.array_compact(ends)

    return let(_segments(text, r"[.!?](?=[ \n\t])"), kept)


def paragraph_boundaries(text: Column) -> Column:
    """Offsets just after each run of blank lines."""
    return match_ends(text, r"\n\n+")


def page_breaks(text: Column) -> Column:
    """Offsets at which a ``--- Page n ---`` marker begins."""
    return F.transform(located_matches(text, _PAGE_BREAK), lambda m: m["start"])


def sections(text: Column) -> Column:
    """Numbered headings as ``array<struct<title, start_position, level>>``.

    The title is the whole match with the blanks around it.
    """
    return F.transform(located_matches(text, _SECTION), lambda m: F.struct(
        m["found"].alias("title"), m["start"].alias("start_position"), F.lit(1).alias("level")
    ))


def optimal_chunk_end(
    text_length: Column, start: Column, boundaries: Column, target: int
) -> Column:
    """The boundary nearest to ``start + target`` within half to one and a half targets."""
    ideal = start + F.lit(target)
    usable = F.filter(
        boundaries,
        lambda b: (b > start)
        & (b - start >= target * 0.5)
        & (b - start <= target * 1.5)
        & (F.abs(b - ideal) < target),
    )
    nearest = F.array_min(
        F.transform(usable, lambda b: F.struct(F.abs(b - ideal).alias("gap"), b.alias("pos")))
    )
    return (
        F.when(ideal >= text_length, text_length)
        .otherwise(F.coalesce(nearest["pos"], ideal))
        .cast("bigint")
    )


def marks_before(positions: Column, marks: Column) -> Column:
    """How many marks lie at or before each position; both ``array<bigint>``, marks ascending.

    One binary search for each position, so a document takes time in proportion to
    its length, however many marks and positions it has.
    """
    @F.arrow_udf("array<int>")
    def counted(places: pa.Array, known: pa.Array) -> pa.Array:
        found, sizes = [], []
        for own, of in zip(places, known):
            own, of = (() if x.values is None else x.values.to_numpy() for x in (own, of))
            found.append(np.searchsorted(of, own, side="right").astype(np.int32))
            sizes.append(len(own))
        offsets = pa.array(np.cumsum([0, *sizes], dtype=np.int32))
        flat = np.concatenate(found) if found else np.zeros(0, np.int32)
        return pa.ListArray.from_arrays(offsets, pa.array(flat))

    return counted(positions, marks)


def optimal_chunk_ends(
    text_length: Column, starts: Column, boundaries: Column, target: int
) -> Column:
    """``optimal_chunk_end`` for an array of starts, by binary search.

    Only the last boundary up to the ideal end and the first one after it can be the nearest.
    """
    ideals = F.transform(starts, lambda s: s + F.lit(target))

    def chosen(start: Column, before: Column) -> Column:
        ideal = start + F.lit(target)
        near = F.array(*(F.get(boundaries, before - shift) for shift in (1, 0)))
        usable = F.filter(near, lambda b: (b - start >= target * 0.5) & (b - start <= target * 1.5)
                          & (b > start) & (F.abs(b - ideal) < target))
        best = F.array_min(F.transform(
            usable, lambda b: F.struct(F.abs(b - ideal).alias("gap"), b.alias("pos"))))
        return F.when(ideal >= text_length, text_length).otherwise(
            F.coalesce(best["pos"], ideal)).cast("bigint")

    return F.zip_with(starts, marks_before(ideals, boundaries), chosen)


def sections_at(section_list: Column, positions: Column) -> Column:
    """``section_at`` for an array of positions, by binary search."""
    starts = F.transform(section_list, lambda s: s["start_position"])
    return F.transform(marks_before(positions, starts), lambda n: F.coalesce(
        F.get(section_list, n - 1)["title"], F.lit("Unknown")))


def pages_at(breaks: Column, positions: Column) -> Column:
    """``page_at`` for an array of positions, by binary search."""
    return F.transform(marks_before(positions, breaks), lambda n: n + 1)


def section_at(section_list: Column, position: Column) -> Column:
    """Title of the last section starting at or before a position (J3, as-of)."""
    before = F.filter(section_list, lambda s: s["start_position"] <= position)
    return F.coalesce(F.try_element_at(before, F.lit(-1))["title"], F.lit("Unknown"))


def page_at(breaks: Column, position: Column) -> Column:
    """One plus the number of page breaks at or before a position."""
    return F.size(F.filter(breaks, lambda b: b <= position)) + 1


def locator(section: Column, page: Column) -> Column:
    """``section:<title>;page:<n>``."""
    return F.concat(F.lit("section:"), section, F.lit(";page:"), page.cast("string"))
