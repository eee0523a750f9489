"""Places of pattern matches in texts, as column expressions: no Python on the way.

A span is a struct (start, rank, end, kind, value); places count code points from zero, the end is
exclusive. Spans sort by start, then by rank (the order in which kinds are listed).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scorewell.functions.exprs import lit_text

SPAN = "struct<start:int,rank:int,end:int,kind:string,value:string>"
NONE = f"cast(array() AS array<{SPAN}>)"


def spans_sql(text: str, kind: str, rank: int, pattern: str, guard: str, keep: str = "true", group: int = 0) -> str:
    """Leftmost non-overlapping matches of ``pattern`` in the column ``text``, as an array of spans.

    Their places follow from the lengths of what stands between the matches. ``guard`` is a cheap
    test without which no text has a match; ``keep`` filters by ``v``, the value of ``group``.
    """
    p = lit_text(pattern)
    values = f"regexp_extract_all({text}, {p}, {group})"
    whole = f"regexp_extract_all({text}, {p}, 0)"
    zipped = f"arrays_zip(split({text}, {p}, -1), {whole}{', ' + values if group else ''})"
    gap, hit, v = "x.`0`", "x.`1`", "x.`2`" if group else "x.`1`"
    start = f"acc.at + length({gap})"
    one = (
        f"named_struct('start', {start}, 'rank', {rank}, 'end', {start} + length({hit}), 'kind', '{kind}', 'value', {v})"
    )
    found = (
        f"aggregate({zipped}, named_struct('at', 0, 'all', {NONE}), (acc, x) -> if({hit} IS NULL, acc, "
        f"named_struct('at', {start} + length({hit}), 'all', concat(acc.all, array({one})))), acc -> acc.all)"
    )
    checked = found if keep == "true" else f"filter({found}, s -> {keep.replace('{v}', 's.value')})"
    return f"CASE WHEN {guard} THEN {checked} ELSE {NONE} END"


def listed(spans: str) -> Column:
    """``kind:start:end`` of sorted spans, comma-joined."""
    return F.expr(f"array_join(transform({spans}, s -> concat_ws(':', s.kind, s.start, s.end)), ',')")


def count_of(spans: str, kind: str) -> Column:
    return F.expr(f"cast(size(filter({spans}, s -> s.kind = '{kind}')) AS long)")
