"""Fill-in-the-middle training texts by DuckDB inside Arrow batches.

Every text of n code points is cut at two places drawn from the SHA-256 of ``seed:doc_id`` into prefix, middle and suffix, and put together again behind
marks: psm is prefix, suffix, middle; spm is suffix, prefix, middle. A share of texts stays plain; so do empty texts and texts that hold a mark.

A task registers its Arrow batches with a DuckDB connection of one thread and gives back what one SQL statement makes of them; no row passes through Python. The
statement matches a text from left to right in runs of ``RUN`` code points, so a list has an entry for each run and not for each code point; a cut inside a run splits
that run only. Batches are sliced by ``SLICE_BYTES`` of text, so a task holds a few copies of one slice, or of one text if that is longer.
What is put together is taken apart again by its marks, and both texts' hashes are returned.

Defined cases: a null text is empty, a null doc_id is drawn as the empty string. A row is judged by itself, so rows that repeat an id are cut by the same draws, each over its own
length. An empty table gives no rows. Columns but doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of 100 texts, so many are changed, and of 100 of those, so many with the suffix first.
CHANGED, SUFFIX_FIRST = 90, 20
SEED = "1"
#: Code points of one match.
RUN = 64
#: Bytes of text that DuckDB works on at once, and rows: its own vectors have 2,048.
SLICE_BYTES, SLICE_ROWS = 8_000_000, 2048
#: What a connection may hold.
MEMORY = "2GB"

#: What stands from unit x to unit y of runs of ``run`` code points each.
_SPAN = """CREATE MACRO span(runs, run, x, y) AS CASE WHEN x // run = y // run THEN coalesce(substr(runs[x // run + 1], x % run + 1, y - x), '')
ELSE substr(runs[x // run + 1], x % run + 1) || array_to_string(list_slice(runs, x // run + 2, y // run), '') || coalesce(left(runs[y // run + 1], y % run), '') END"""

_SQL = """
WITH cut AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(t, '.{{1,{run}}}', 0, 's') AS runs, sha256('{seed}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM batch),
sized AS (SELECT *, CAST(CASE WHEN len(runs) = 0 THEN 0 ELSE (len(runs) - 1) * {run} + length(runs[-1]) END AS BIGINT) AS n,
    list_transform([1, 9, 17, 25], lambda i: CAST('0x' || substr(h, i, 8) AS BIGINT)) AS draw FROM cut),
placed AS (SELECT *, least(draw[1] % (n + 1), draw[2] % (n + 1)) AS x, greatest(draw[1] % (n + 1), draw[2] % (n + 1)) AS y,
    CASE WHEN n = 0 OR contains(t, '{p}') OR contains(t, '{s}') OR contains(t, '{m}') OR draw[3] % 100 >= {changed} THEN 'plain' WHEN draw[4] % 100 < {first} THEN 'spm' ELSE 'psm' END AS form FROM sized),
made AS (SELECT *, CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '{p}' || span(runs, {run}, 0, x) || '{s}' || span(runs, {run}, y, n) || '{m}' || span(runs, {run}, x, y)
    ELSE '{s}' || span(runs, {run}, y, n) || '{p}' || span(runs, {run}, 0, x) || '{m}' || span(runs, {run}, x, y) END AS output FROM placed),
-- no part holds a mark, and a mark cannot begin inside another or at the end of a part, so each splits its text in two
halves AS (SELECT *, string_split(output, CASE form WHEN 'psm' THEN '{s}' ELSE '{p}' END) AS two FROM made),
thirds AS (SELECT *, string_split(two[2], '{m}') AS tail FROM halves),
parts AS (SELECT *, CASE form WHEN 'plain' THEN output WHEN 'psm' THEN substr(two[1], {p_from}) || tail[2] || tail[1] ELSE tail[1] || tail[2] || substr(two[1], {s_from}) END AS restored FROM thirds)
SELECT doc_id, n, form, CASE WHEN form != 'plain' THEN x END AS prefix_chars, CASE WHEN form != 'plain' THEN y - x END AS middle_chars, output, sha256(output) AS output_sha256, sha256(restored) AS restored_sha256 FROM parts
"""


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in slices of at most SLICE_ROWS rows and SLICE_BYTES bytes of text, or of one row."""
    sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_pylist()
    first, held = 0, 0
    for k, size in enumerate(sizes):
        if k > first and (held + size > SLICE_BYTES or k - first == SLICE_ROWS):
            yield batch.slice(first, k - first)
            first, held = k, 0
        held += size
    if first < len(sizes):
        yield batch.slice(first)


def fill_in_middle(docs: DataFrame, seed: str = SEED, changed: int = CHANGED, suffix_first: int = SUFFIX_FIRST, marks: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE), run: int = RUN) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output (the text), output_sha256 and restored_sha256 of every row.

    The marks, of prefix, suffix and middle, are different strings that begin with a character which they hold only there.
    """
    if len(set(marks)) < 3 or any(not m or "'" in m or any(m[0] in other[1:] or m[0] != other[0] for other in marks) for m in marks):
        raise ValueError("marks are three different strings without quotes that begin with the same character and hold it only there")
    if not seed.isalnum():
        raise ValueError("the seed is letters and digits")
    p, s, m = marks
    sql = _SQL.format(run=int(run), seed=seed, p=p, s=s, m=m, changed=int(changed), first=int(suffix_first), p_from=len(p) + 1, s_from=len(s) + 1)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        # nothing goes to a local disk
        with duckdb.connect(config={"threads": 1, "memory_limit": MEMORY, "temp_directory": ""}) as con:
            con.execute(_SPAN)
            for b in batches:
                for part in _slices(b):
                    con.register("batch", pa.Table.from_batches([part]))
                    yield from con.execute(sql).to_arrow_reader()
                    con.unregister("batch")

    return docs.select("doc_id", "text").mapInArrow(work, f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string, output_sha256 string, restored_sha256 string")
