"""Audit of how far sources diverge in their words, by dense blocks of terms.

Terms are runs of ASCII letters and non-ASCII characters, with A-Z lower-cased. Each language keeps the terms that at least ``min_docs`` of its documents hold. Each
(language, source) group, and each language as a whole, gives each kept term p = 1 + floor(10^9 (count + 2) / (N + 2 V)), for N its occurrences of
kept terms and V their number. Two groups diverge at a term by f = floor((p - q)^2 / (p + q)), and together by the sum of f over all kept terms.

Tasks count terms as they read and hand on sums per group and term. The kept terms of a language are dealt to blocks of about ``TERMS`` by hash, its groups to blocks of about ``GROUPS``. A tile is
one block of terms with two blocks of groups, as one int64 matrix of groups by terms, in which absent terms have the group's p of a count of 0; all its pairs of groups are compared by
broadcasting and summed over the block. The partial pair matrices are summed by Spark. The terms that set a group apart from its language are ranked in
each tile, the first ``top`` of a group go on, and Spark's group limit merges these short lists, again before its shuffle.
So a tile has a fixed size, and neither a hot source nor a frequent term is a large task: after the first sums it is a row for each group and term.

All arithmetic is exact: p is computed as a decimal of 38 digits, f and its sums fit in 64 bits, as p is 10^9 + 1 at most and the p of a group sum up to 10^9 + V.

Defined cases: null texts, languages and sources are ''. A group without terms takes part; where a language keeps no term, its groups diverge by 0. A single group has no pairs. Each row is a
document, whether ids repeat or not; no id is read. An empty table gives no rows. Other columns are ignored, whatever their names. The pairs of a language's sources are the result itself and so grow with their square.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import released, staged

MIN_DOCS = 10
TOP = 10
#: Terms and groups of a block, about.
TERMS, GROUPS = 1024, 128
#: Cells that a task holds before it hands them on.
HELD = 400_000
#: Elements of a broadcast at once.
CHUNK = 1 << 21
#: What a share of 1 is, and what is added to each count.
SCALE, ADDED = 1_000_000_000, 2
#: Bytes of terms: letters in lower case, and all but ASCII; others become spaces.
_LETTERS = bytes(b if b >= 128 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def terms(text: str) -> list[bytes]:
    """The terms of a text, in UTF-8."""
    return text.encode().translate(_LETTERS).split()


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences) and docs (documents with it), and for each group a row without term."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        held = 0

        def hand_on() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, d) in counts.items():
                size = len(n) + 1
                words = pa.array([*n, None], pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays(
                    [pa.repeat(pa.scalar(lang, pa.string()), size), pa.repeat(pa.scalar(source, pa.string()), size), words, pa.array([*n.values(), 0], pa.int64()), pa.array([*(d[x] for x in n), 0], pa.int64())], ["lang", "source", "term", "n", "docs"]
                )

        for b in batches:
            for text, lang, source in zip(*(b.column(c).to_pylist() for c in ("text", "lang", "source")), strict=True):
                n, d = counts.setdefault((lang, source), (Counter(), Counter()))
                found, before = terms(text), len(n)
                n.update(found)
                d.update(set(found))
                held += len(n) - before + (not before)
                if held >= HELD:
                    yield from hand_on()
                    counts.clear()
                    held = 0
        yield from hand_on()

    slim = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")))
    parts = slim.mapInArrow(released(count), "lang string, source string, term string, n long, docs long")
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def pair_sums(p: np.ndarray, q: np.ndarray | None = None) -> np.ndarray:
    """Sums over all terms of floor((p - q)^2 / (p + q)) for each row of p and each of q (None: of p itself), by broadcasting some rows at a time."""
    other = p if q is None else q
    out = np.zeros((len(p), len(other)), np.int64)
    step = max(1, CHUNK // max(1, other.size))
    wide = max(1, CHUNK // max(1, p.shape[1]))
    for i in range(0, len(p), step):
        for j in range(i if q is None else 0, len(other), wide):
            a, b = p[i : i + step, None, :], other[None, j : j + wide, :]
            gap = a - b
            gap *= gap
            gap //= a + b
            out[i : i + step, j : j + wide] = gap.sum(axis=2)
    return out


def _tile(top: int):
    """A function from the rows of a tile to pairs (source, item, value) and, from tiles of a block of groups with itself, the first terms of each group."""

    def tile(key: tuple, rows: pa.Table) -> pa.Table:
        lang, _, one, two = (k.as_py() for k in key)
        kind = rows["kind"].to_numpy()
        group, term, p = (rows.filter(pa.array(kind == k)) for k in range(3))
        names, words = group["source"].combine_chunks(), term["term"].combine_chunks()
        dense = np.repeat(group["p"].to_numpy()[:, None], len(words), axis=1)
        row, column = (pc.index_in(p[c].combine_chunks(), value_set=v).to_numpy(zero_copy_only=False).astype(np.int64) for c, v in (("source", names), ("term", words)))
        dense[row, column] = p["p"].to_numpy()
        part = group["part"].to_numpy()
        left, right = np.flatnonzero(part == one), np.flatnonzero(part == two)
        if one == two:
            sums, (i, j) = pair_sums(dense[left]), np.triu_indices(len(left), 1)
        else:
            sums, (i, j) = pair_sums(dense[left], dense[right]), (k.ravel() for k in np.indices((len(left), len(right))))
        found = [("pair", names.take(pa.array(left[i])), names.take(pa.array(right[j])), sums[i, j])]
        if one == two:
            mine, theirs = p["p"].to_numpy(), term["p"].to_numpy()[column]
            more = np.flatnonzero(mine > theirs)
            value = (mine[more] - theirs[more]) ** 2 // (mine[more] + theirs[more])
            rank = np.empty(len(words), np.int64)  # of the terms by their bytes
            rank[np.argsort(np.array([w.encode() for w in words.to_pylist()], object), kind="stable")] = np.arange(len(words))
            order = np.lexsort((rank[column[more]], -value, row[more]))
            group_of = row[more][order]
            place = np.arange(len(order)) - np.searchsorted(group_of, group_of)
            first = order[place < top]
            found.append(("term", names.take(pa.array(row[more][first])), words.take(pa.array(column[more][first])), value[first]))
        return pa.concat_tables(pa.table({"lang": pa.repeat(pa.scalar(lang, pa.string()), len(v)), "source": s, "part": pa.repeat(pa.scalar(name, pa.string()), len(v)), "item": x, "value": v.astype(np.int64)}) for name, s, x, v in found)

    return tile


def _share(n, total):
    """1 + floor(SCALE (n + ADDED) / total), exactly, for sums of up to 27 digits."""
    return F.expr(f"CAST(1 + (CAST({SCALE} AS DECIMAL(10,0)) * CAST({n} + {ADDED} AS DECIMAL(20,0))) div CAST({total} AS DECIMAL(20,0)) AS BIGINT)")


def divergence(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP, terms_of: int = TERMS, groups_of: int = GROUPS) -> DataFrame:
    """lang, source, part ('pair' or 'term'), item (another source, or a term), value and rank, from 1 by value descending and item ascending."""
    cells = staged(term_counts(docs), "term-counts")
    kept = cells.where("term is not null").groupBy("lang", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")).where(F.col("docs") >= min_docs)
    kept = staged(kept.select("lang", "term", "n"), "kept-terms")
    of_term = kept.select(F.col("lang").alias("_lang"), F.col("term").alias("_term"))
    own = cells.join(of_term, (F.col("lang") == F.col("_lang")) & (F.col("term") == F.col("_term")), "left").select("lang", "source", "_term", "n")
    # a group's row without term has no partner, so every group has a row here
    groups = own.groupBy("lang", "source").agg(F.coalesce(F.sum(F.when(F.col("_term").isNotNull(), F.col("n"))), F.lit(0)).alias("total"))
    sizes = groups.groupBy("lang").agg(F.count("*").alias("n_groups"))
    totals = kept.groupBy(F.col("lang").alias("_lang")).agg(F.count("*").alias("v"), F.sum("n").alias("whole"))
    none = F.lit(0).cast("long")
    langs = sizes.join(totals, F.col("lang") == F.col("_lang"), "left").select("lang", F.coalesce("v", none).alias("v"), F.coalesce("whole", none).alias("whole"), "n_groups")
    blocks = lambda n, size: F.greatest(F.ceil(F.col(n) / size), F.lit(1)).cast("int")
    langs = staged(langs.select(F.col("lang").alias("_lang"), "v", "whole", blocks("v", terms_of).alias("blocks"), blocks("n_groups", groups_of).alias("parts")), "languages")
    dealt = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    same = F.col("lang") == F.col("_lang")
    groups = groups.join(langs, same).drop("_lang").withColumn("size", F.col("total") + ADDED * F.col("v")).withColumn("part", dealt("source", "parts"))
    groups = staged(groups.select("lang", "source", "size", "part", "parts", "blocks", F.when(F.col("v") > 0, _share("0L", "size")).otherwise(1).alias("p")), "groups")
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    tile = ["lang", "block", F.least("part", "other").alias("one"), F.greatest("part", "other").alias("two"), "source", "term", "p", "part"]
    no = F.lit(None).cast("string")
    of_groups = groups.withColumn("block", upto("blocks")).withColumn("other", upto("parts")).withColumn("term", no).select(F.lit(0).alias("kind"), *tile)
    of_terms = kept.join(langs, same).withColumn("size", F.col("whole") + ADDED * F.col("v")).withColumn("p", _share("n", "size")).withColumn("block", dealt("term", "blocks"))
    of_terms = of_terms.withColumn("part", upto("parts")).withColumn("other", F.explode(F.sequence(F.col("part"), F.col("parts") - 1))).withColumn("source", no).select(F.lit(1).alias("kind"), *tile)
    of_cells = own.where("_term is not null").join(groups.select(F.col("lang").alias("_l"), F.col("source").alias("_s"), "size", "part", "parts", "blocks"), (F.col("lang") == F.col("_l")) & (F.col("source") == F.col("_s")))
    of_cells = of_cells.withColumn("term", F.col("_term")).withColumn("p", _share("n", "size")).withColumn("block", dealt("term", "blocks")).withColumn("other", upto("parts")).select(F.lit(2).alias("kind"), *tile)
    rows = of_groups.unionByName(of_terms).unionByName(of_cells)
    found = rows.groupBy("lang", "block", "one", "two").applyInArrow(_tile(top), "lang string, source string, part string, item string, value long")
    found = staged(found, "tiles")
    pairs = found.where("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    both = F.explode(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item")))).alias("s")
    pairs = pairs.select("lang", "value", both).select("lang", "s.source", F.lit("pair").alias("part"), "s.item", "value")
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")).alias("rank")
    first = found.where("part = 'term'").select("lang", "source", "part", "item", "value", rank).where(F.col("rank") <= top)
    return pairs.select("lang", "source", "part", "item", "value", rank).unionByName(first)
