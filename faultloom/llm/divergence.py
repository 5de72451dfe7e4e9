"""How the sources of a language differ in their terms: packed term counts, then exact divergences."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultloom.llm.common import ascii_lower, partitions, ship, staged, text_slices, words_of
from faultloom.operators.joins import attach

#: Bytes of text whose terms are counted at a time in a task.
SLICE = 1 << 23
#: Terms in thousand millionths.
UNIT = 1_000_000_000
#: Terms of up to this many bytes are one or two 64-bit numbers.
PACKED = 16
#: Groups (language, source) up to which their table is broadcast; beyond it, it is spread over salts.
BROADCAST_GROUPS = 20_000
SALTS = 32
#: Pairs of sources whose sums a task adds up at a time.
PAIR_CELLS = 2_000_000

_BETWEEN = np.ones(256, dtype=bool)  # all but small letters and bytes outside ASCII
_BETWEEN[ord("a") : ord("z") + 1] = False
_BETWEEN[128:] = False


def _radix(words: np.ndarray, order: np.ndarray, size: int) -> np.ndarray:
    """order, sorted by 64-bit numbers of which only the lowest `size` bytes are used: stable passes over
    digits of 16 bits, from the lowest."""
    for digit in range(-(-size // 2)):
        digits = ((words >> np.uint64(16 * digit)) & np.uint64(0xFFFF)).astype(np.uint16)
        order = order[np.argsort(digits[order], kind="stable")]
    return order


def _packed(data: np.ndarray, start: np.ndarray, size: int) -> np.ndarray:
    """The `size` (at most 8) bytes from each start as one number."""
    out = np.zeros(len(start), np.uint64)
    for k in range(size):
        out = (out << np.uint64(8)) | data[start + k]
    return out


def term_runs(data: np.ndarray, start: np.ndarray, end: np.ndarray, group: np.ndarray, row: np.ndarray):
    """(a place, group, occurrences, rows) of every term data[start:end] of every group, each term by its length.

    Terms of equal length are sorted at once, stably and after their groups, and their runs are counted:
    up to 8 bytes as one 64-bit number, up to 16 as two, both in radix passes; longer ones as byte strings.
    """
    length = end - start
    by_group = np.argsort(group, kind="stable")
    by_length = by_group[np.argsort(np.minimum(length, 65_535).astype(np.uint16)[by_group], kind="stable")]
    sizes = length[by_length]
    if len(sizes) and sizes[-1] >= 65_535:
        by_length = by_group[np.argsort(length[by_group], kind="stable")]
        sizes = length[by_length]
    cuts = np.flatnonzero(np.concatenate(([True], sizes[1:] != sizes[:-1]))) if len(sizes) else []
    for a, b in zip(cuts, [*cuts[1:], len(sizes)]):
        size, at = int(sizes[a]), by_length[a:b]
        order = np.arange(b - a)
        if size <= PACKED:
            low = _packed(data, start[at] + max(size - 8, 0), min(size, 8))
            order = _radix(low, order, min(size, 8))
            differ = low[order][1:] != low[order][:-1]
            if size > 8:
                high = _packed(data, start[at], size - 8)
                order = _radix(high, order, size - 8)
                differ = (low[order][1:] != low[order][:-1]) | (high[order][1:] != high[order][:-1])
        else:
            terms = data[start[at][:, None] + np.arange(size)].view(f"S{size}").ravel()
            order = np.argsort(terms, kind="stable")
            differ = terms[order][1:] != terms[order][:-1]
        at = at[order]
        new = np.concatenate(([True], differ | (group[at][1:] != group[at][:-1])))
        new_row = new.copy()
        new_row[1:] |= row[at][1:] != row[at][:-1]
        first = np.flatnonzero(new)
        yield at[first], group[at[first]], np.diff(np.append(first, len(at))), np.add.reduceat(new_row.astype(np.int64), first)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n, docs) of rows (lang, source, text), one part for every slice of the texts."""
    for batch in batches:
        langs, sources = (batch.column(k).dictionary_encode() for k in (0, 1))
        names = [c.dictionary.to_pylist() for c in (langs, sources)]
        code = langs.indices.to_numpy().astype(np.int64) * max(len(names[1]), 1) + sources.indices.to_numpy()
        for a, b, data, bounds in text_slices(batch.column(2), SLICE):
            data = ascii_lower(data)
            start, end, row = words_of(data, bounds, _BETWEEN)
            if not len(start):
                continue
            known, group = np.unique(code[a:b], return_inverse=True)
            parts = list(term_runs(data, start, end, group[row], row))
            at, of, n, docs = (np.concatenate(x) for x in zip(*parts))
            size = (end - start)[at]
            to = np.concatenate(([0], np.cumsum(size)))
            taken = data[np.arange(to[-1]) + np.repeat(start[at] - to[:-1], size)]
            terms = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(to.astype(np.int64)), pa.py_buffer(taken)])
            lang, source = np.divmod(known[of], max(len(names[1]), 1))
            yield pa.RecordBatch.from_arrays(
                [pa.array(names[0], pa.string()).take(pa.array(lang)), pa.array(names[1], pa.string()).take(pa.array(source)),
                 terms.cast(pa.binary()), pa.array(n), pa.array(docs)], names=["lang", "source", "term", "n", "docs"])


def share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(UNIT * (n + 1) / (total + terms)), in whole numbers of up to 38 digits."""
    wide = F.lit(UNIT).cast("decimal(10,0)") * (n + 1).cast("decimal(19,0)")
    return (F.call_function("div", wide, (total + terms).cast("decimal(19,0)")) + 1).cast("long")


def excess(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q); shares are at most UNIT + 1, so squares fit 64 bits."""
    return F.call_function("div", (p - q) * (p - q), q)


def _squares(new: np.ndarray, code: np.ndarray, p: np.ndarray, p0: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Sums by pair of codes over terms, each of which is a run of rows; squares of equal size are worked on together."""
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(new)))
    for k in np.unique(size[size > 1]).tolist():
        where = first[size == k]
        step, rows = max(PAIR_CELLS // (k * k), 1), max(PAIR_CELLS // k, 1)
        for lo in range(0, len(where), step):
            at = where[lo : lo + step, None] + np.arange(k)
            for r in range(0, k, rows):  # of a very large square some rows at a time
                mine = at[:, r : r + rows]
                a, a0, q, q0 = p[mine][:, :, None], p0[mine][:, :, None], p[at][:, None, :], p0[at][:, None, :]
                f = _over(a, q) - _over(a, q0) - _over(a0, q) + _over(a0, q0)
                one = np.broadcast_to(code[mine][:, :, None], f.shape).ravel()
                two = np.broadcast_to(code[at][:, None, :], f.shape).ravel()
                order = np.lexsort((two, one))
                one, two, f = one[order], two[order], f.ravel()[order]
                ends = np.flatnonzero(np.concatenate(([True], (one[1:] != one[:-1]) | (two[1:] != two[:-1]))))
                sums = np.add.reduceat(f, ends)
                apart = one[ends] != two[ends]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(one[ends][apart]), pa.array(two[ends][apart]), pa.array(sums[apart])], names=["a", "b", "f"])


def _pair_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (lang, term, code, p, p0) sorted by language and term: what two sources that both have a term
    differ by, beyond what each differs by from a source without it, summed by pair of codes.

    The sources of one term are a square of pairs; only sums leave it.
    """
    held = None
    for batch in batches:
        rows = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
        if not rows.num_rows:
            continue
        rows = rows.combine_chunks()
        lang, term = rows.column(0).chunk(0), rows.column(1).chunk(0)
        change = pc.or_(pc.not_equal(lang[1:], lang[:-1]), pc.not_equal(term[1:], term[:-1]))
        new = np.concatenate(([True], change.to_numpy(zero_copy_only=False)))
        last = int(np.flatnonzero(new)[-1])  # the last term may go on in the next batch
        numbers = [rows.column(k).to_numpy()[:last] for k in (2, 3, 4)]
        yield from _squares(new[:last], *numbers)
        held = rows.slice(last)
    if held is not None:
        numbers = [held.column(k).to_numpy() for k in (2, 3, 4)]
        yield from _squares(np.arange(held.num_rows) == 0, *numbers)


def _over(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def term_counts(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(lang, source, term, n, docs): occurrences, and rows that hold it, of every term of every source of a language."""
    ship(docs.sparkSession)
    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (lang_col, source_col, text_col)])
    found = rows.mapInArrow(_counts, "lang string, source string, term binary, n long, docs long")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")).withColumn(
        "term", F.col("term").cast("string"))


def source_divergence(docs: DataFrame, least_docs: int = 3, top: int = 200, lang_col: str = "lang", source_col: str = "source",
                      text_col: str = "text") -> DataFrame:
    """lang, source, part, item, value, rank: what sets each source of a language apart.

    Terms are runs of letters and bytes outside ASCII, A-Z in lower case. A language keeps the V terms that
    at least `least_docs` of its rows hold. A source gives a kept term the share
    p = 1 + floor(10^9 * (n + 1) / (N + V)), n its occurrences there and N those of all kept terms; a language
    does likewise with the occurrences of all its sources. What p differs from q by is floor((p - q)^2 / q).

    * part 'pair': for every other source of the language, the sum over all kept terms, q its share.
    * part 'term': the `top` terms that the source has more of than its language, q the language's share.

    rank counts from 1 by falling value, then by item. Terms are counted in slices inside the tasks (see
    term_runs), so Spark shuffles one row for each term of a source and slice. A pair's sum needs no dense
    table: as if neither had any term, plus what the terms of each change (by how often they occur, few
    different numbers), plus, for terms that both have, a correction. The squares of sources of one term are
    summed where the term's rows lie; only sums by pair travel.

    NULL and empty texts have no terms, NULL languages and sources are ''. A source without terms takes part, with
    equal shares for all; without kept terms the sums are 0. Texts are read whole, very long ones in a slice
    of their own. Repeated rows count as often as they occur; ties in value go by item. Other columns are
    ignored, whatever their names; an empty table gives no rows.
    """
    spark = docs.sparkSession
    names = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("lang"),
                        F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source")).distinct()
    counts = staged(term_counts(docs, lang_col, source_col, text_col))
    kept = staged(counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("lang_n")).where(
        F.col("docs") >= least_docs).drop("docs"))
    langs = kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("lang_n").alias("lang_total"))
    used = staged(counts.drop("docs").join(kept, ["lang", "term"]))
    totals = used.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    nothing = F.lit(0).cast("long")
    groups = names.join(totals, ["lang", "source"], "left").join(langs, "lang", "left").select(
        "lang", "source", *[F.coalesce(c, nothing).alias(c) for c in ("total", "terms", "lang_total")])
    groups = staged(groups.withColumn("code", F.monotonically_increasing_id()).withColumn(
        "p0", F.when(F.col("terms") > 0, share(nothing, F.col("total"), F.col("terms")))))
    few = groups.count() <= BROADCAST_GROUPS
    own = groups.select("lang", "source", "code", "total", "terms", "lang_total", "p0")
    # Every term of a source with both shares.
    shares = used.join(F.broadcast(own), ["lang", "source"]) if few else attach(used, own, ["lang", "source"], ["term"], count_keys=False)
    shares = staged(shares.select(
        "lang", "source", "term", "code", "p0", share(F.col("n"), F.col("total"), F.col("terms")).alias("p"),
        share(F.col("lang_n"), F.col("lang_total"), F.col("terms")).alias("q")))

    value = excess(F.col("p"), F.col("q"))
    terms = shares.where(F.col("p") > F.col("q")).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), value.alias("value"))
    falling = Window.partitionBy("lang", "source", "part").orderBy(F.col("value").desc(), "item")
    # Spark keeps the first rows of each group before the shuffle as well, so a hot source is cut there.
    terms = terms.withColumn("rank", F.row_number().over(falling)).where(F.col("rank") <= top)

    # How many terms of a source have which share, beside the share of a term it does not have.
    spectrum = staged(shares.groupBy("lang", "code", "p", "p0").agg(F.count("*").alias("m")))
    others = groups.select("lang", F.col("code").alias("other"), F.col("p0").alias("o0"))

    def meet(rows: DataFrame) -> DataFrame:
        """Every row of a source with every other source of its language."""
        if few:
            found = rows.join(F.broadcast(others), "lang")
        else:
            salted = rows.withColumn("salt", F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS)).cast("int"))
            copies = others.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
            found = salted.join(copies, ["lang", "salt"])
        return found.where(F.col("code") != F.col("other"))

    p, p0, o0 = F.col("p"), F.col("p0"), F.col("o0")
    bare = meet(groups.select("lang", "code", "terms", "p0")).select(
        F.col("code").alias("a"), F.col("other").alias("b"), F.coalesce(F.col("terms") * excess(p0, o0), nothing).alias("f"))
    met = meet(spectrum).select("code", "other", (F.col("m") * (excess(p, o0) - excess(p0, o0))).alias("one"),
                                (F.col("m") * (excess(o0, p) - excess(o0, p0))).alias("two"))
    alone = met.select(F.inline(F.array(
        F.struct(F.col("code").alias("a"), F.col("other").alias("b"), F.col("one").alias("f")),
        F.struct(F.col("other").alias("a"), F.col("code").alias("b"), F.col("two").alias("f")))))
    dealt = shares.select("lang", "term", "code", "p", "p0").repartition(max(partitions(spark), 8), "lang", "term")
    both = dealt.sortWithinPartitions("lang", "term").mapInArrow(_pair_sums, "a long, b long, f long")
    sums = bare.union(alone).union(both).groupBy("a", "b").agg(F.sum("f").alias("value"))
    one = groups.select(F.col("code").alias("a"), "lang", "source")
    two = groups.select(F.col("code").alias("b"), F.col("source").alias("item"))
    pairs = sums.join(one, "a").join(two, "b").select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    pairs = pairs.withColumn("rank", F.row_number().over(falling))
    return pairs.unionByName(terms)
