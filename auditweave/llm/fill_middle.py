"""Fill-in-the-middle transformation by repeated-capture matching.

A text is a run of units (lines by default). One ``regex`` fullmatch of ``(unit)*`` keeps
every repetition of its group, so ``match.ends(1)`` lists the end of each unit: its length
is the number of units, and both cut offsets are read from it. Cuts and form are drawn from
a hash of the id, so reruns, retries and other partitionings give the same rows.

Defined cases: a null text is an empty one; an empty text, a text that holds a marker, and
a text that its output would not give back (markers of one's own that overlap) stay plain.
A null id is hashed as the empty string; repeated rows are transformed alike. Other columns
of the input are not read, unless they are named in ``keep``.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from hashlib import sha256

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, functions as F

from auditweave.llm.common import batches_of, rows_of, slim

LINE = r"[^\n]*+\n|[^\n]++"
PREFIX, SUFFIX, MIDDLE = MARKERS = ("<P>", "<S>", "<M>")
RESULT = "n long, form string, prefix_chars long, middle_chars long, output string"
_FIELDS = [("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string())]


def unit_ends(text: str, units: regex.Pattern) -> list[int]:
    """The end of each unit, in code points; ``units`` is a compiled ``(unit)*``."""
    match = units.fullmatch(text)
    if match is None:
        raise ValueError("the unit pattern does not cover the text")
    return match.ends(1)


def draws(identifier, seed: int) -> list[int]:
    """Four numbers of 32 bits from the id."""
    digest = sha256(f"{seed}:{'' if identifier is None else identifier}".encode()).hexdigest()
    return [int(digest[at : at + 8], 16) for at in (0, 8, 16, 24)]


def rebuilt(output: str, form: str, markers: Sequence[str] = MARKERS) -> str | None:
    """The text that an output came from; None where a marker is missing."""
    prefix, suffix, middle = markers
    if form == "plain":
        return output
    try:
        if form == "psm":
            head, rest = output.removeprefix(prefix).split(suffix, 1)
            tail, inner = rest.split(middle, 1)
        else:
            tail, rest = output.removeprefix(suffix).split(prefix, 1)
            head, inner = rest.split(middle, 1)
    except ValueError:
        return None
    return head + inner + tail


def transform(
    identifier, text: str | None, units: regex.Pattern, *, seed: int, rate: int, spm: int, markers: Sequence[str] = MARKERS
) -> tuple:
    """(n, form, prefix_chars, middle_chars, output) of one text."""
    text = text or ""
    ends = unit_ends(text, units)
    n = len(ends)
    a, b, c, d = draws(identifier, seed)
    if not text or any(m in text for m in markers) or c % 100 >= rate:
        return n, "plain", None, None, text
    first, second = sorted((a % (n + 1), b % (n + 1)))
    cut = ends[first - 1] if first else 0
    stop = ends[second - 1] if second else 0
    prefix, suffix, middle = markers
    if d % 100 < spm:
        form, output = "spm", f"{suffix}{text[stop:]}{prefix}{text[:cut]}{middle}{text[cut:stop]}"
    else:
        form, output = "psm", f"{prefix}{text[:cut]}{suffix}{text[stop:]}{middle}{text[cut:stop]}"
    if rebuilt(output, form, markers) != text:
        return n, "plain", None, None, text
    return n, form, cut, stop - cut, output


def fill_in_middle(
    docs: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    unit: str = LINE,
    seed: int = 7,
    rate: int = 100,
    spm: int = 50,
    markers: Sequence[str] = MARKERS,
    keep: Sequence[str] = (),
) -> DataFrame:
    """One row per document: ``id``, ``n``, ``form``, ``prefix_chars``, ``middle_chars``, ``output``.

    ``rate`` of 100 documents are transformed, ``spm`` of 100 of these with the suffix first.
    ``id`` is the column named by ``doc_id``; columns in ``keep`` must not have a name of
    the result. ``unit`` must cover every text; possessive parts keep matching linear.
    A task holds one Arrow batch of texts and its outputs.
    """
    if clash := {k.lower() for k in keep} & {"id", "n", "form", "prefix_chars", "middle_chars", "output"}:
        raise ValueError(f"columns to keep have names of the result: {sorted(clash)}")
    source = slim(docs, id=doc_id, text=text, **{k: k for k in keep})
    kept = [f for f in source.schema.fields if f.name != "text"]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + [RESULT])
    names = [f.name for f in kept]
    markers = tuple(markers)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = regex.compile(f"({unit})*+")
        types: list[pa.Field] = []

        def rows():
            for batch in batches:
                types[:] = [batch.schema.field(x) for x in names]
                for *values, body in rows_of([batch], [*names, "text"]):
                    yield (*values, *transform(values[0], body, units, seed=seed, rate=rate, spm=spm, markers=markers))

        made = rows()
        first = next(made, None)
        if first is None:
            return
        out = pa.schema([*types, *[pa.field(*f) for f in _FIELDS]])
        yield from batches_of(_after(first, made), out, lambda row: 4 * len(row[-1]) + 64)

    return source.mapInArrow(run, schema)


def _after(first: tuple, rest: Iterable[tuple]) -> Iterator[tuple]:
    yield first
    yield from rest


def restored(output: Column, form: Column, markers: Sequence[str] = MARKERS) -> Column:
    """The text that an output came from, as a column.

    A transformed output starts with a marker and holds each marker once, so cutting it at
    the markers gives an empty piece and the three parts.
    """
    quoted = "|".join(regex.escape(m) for m in markers)
    parts = F.split(output, quoted)
    psm = F.concat(parts[1], parts[3], parts[2])
    spm = F.concat(parts[2], parts[3], parts[1])
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


#: Null texts are empty; the cuts are sums of the lengths of the first units.
ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce("text", '') AS body, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (SELECT *, regexp_extract_all(body, '[^\n]*\n|[^\n]+') AS units,
    CAST('0x' || substr(h, 1, 8) AS UBIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS UBIGINT) AS h2,
    CAST('0x' || substr(h, 17, 8) AS UBIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS UBIGINT) AS h4 FROM d),
c AS (SELECT *, len(units) AS n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS a,
    greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS b,
    body = '' OR contains(body, '<P>') OR contains(body, '<S>') OR contains(body, '<M>') OR h3 % 100 >= 100 AS plain FROM u),
p AS (SELECT *, coalesce(array_to_string(list_slice(units, 1, CAST(a AS BIGINT)), ''), '') AS head,
    coalesce(array_to_string(list_slice(units, CAST(a AS BIGINT) + 1, CAST(b AS BIGINT)), ''), '') AS inner_part,
    coalesce(array_to_string(list_slice(units, CAST(b AS BIGINT) + 1, n), ''), '') AS tail FROM c),
o AS (SELECT *, CASE WHEN plain THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM p)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
    CASE WHEN NOT plain THEN CAST(length(head) AS BIGINT) END AS prefix_chars,
    CASE WHEN NOT plain THEN CAST(length(inner_part) AS BIGINT) END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN body WHEN 'spm' THEN '<S>' || tail || '<P>' || head || '<M>' || inner_part
        ELSE '<P>' || head || '<S>' || tail || '<M>' || inner_part END) AS output_sha256,
    sha256(CASE form WHEN 'plain' THEN body ELSE head || inner_part || tail END) AS restored_sha256
FROM o
"""
