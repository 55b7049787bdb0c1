"""Running values over tracks of any length, in two passes over parts of them.

A part is ``SPAN`` consecutive values of ``ord`` of a track, so a row's part
depends on the row alone and holds at most so many cues. The first pass sums
each part up; the sums of a track, one row a part, are folded in order; the
second pass starts every part from what its track brings along. That comes as
one more row before the part's first one, so a plain window over the part goes
on from it and no row is joined to anything.

No window or task holds a track. A track of one part has nothing to bring
along and takes part in the second pass alone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Keys = Sequence[str]

#: Bits of ``ord`` within a part.
BITS = 16
PART, BROUGHT, FIRST = "_part", "_brought", "_first"


def parted(df: DataFrame) -> DataFrame:
    return df.withColumn(PART, F.shiftright(F.col("ord").cast("long") - 1, BITS))


def within(keys: Keys):
    """The window of a row's part; what is brought along stands first."""
    return Window.partitionBy(*keys, PART).orderBy(F.col("ord").asc_nulls_first())


def brought(sums: DataFrame, keys: Keys, start: dict[str, Column], step: Callable[[Column, Column], dict[str, Column]]) -> DataFrame:
    """One row ``keys, _part, ...`` for each part but a track's first: the fold of ``sums`` (``keys``, ``_part`` and more) over the parts before it.

    ``start``: the fields before any part. ``step``: the fields after a part,
    from those before it and the part's sums.
    """
    rest = [c for c in sums.columns if c not in keys and c != PART]
    parts = sums.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(PART, *rest))).alias("s")).where(F.size("s") > 1)
    begin = F.struct(*(v.alias(c) for c, v in start.items()))
    fields = lambda c: [c[f].alias(f) for f in start]
    one = lambda acc, x: F.struct(x[PART].alias(PART), *fields(acc["now"]))
    after = lambda acc, x: F.struct(*(v.alias(c) for c, v in step(acc["now"], x).items()))
    first = F.get("s", F.lit(0))
    empty = F.slice(F.array(F.struct(first[PART].alias(PART), *fields(begin))), 1, 0)
    fold = F.reduce("s", F.struct(empty.alias("out"), begin.alias("now")), lambda acc, x: F.struct(F.array_append(acc["out"], one(acc, x)).alias("out"), after(acc, x).alias("now")))
    out = parts.select(*keys, F.explode(F.slice(fold["out"], 2, F.size("s"))).alias("x"))
    return out.select(*keys, f"x.{PART}", *(f"x.{f}" for f in start))


def carried(tall: DataFrame, carry: DataFrame) -> DataFrame:
    """The rows of ``tall`` and, marked ``_brought``, what ``carry`` brings to their parts."""
    return tall.withColumn(BROUGHT, F.lit(False)).unionByName(carry.withColumn(BROUGHT, F.lit(True)), allowMissingColumns=True)


def running(df: DataFrame, keys: Keys, **values: tuple[str, Column]) -> DataFrame:
    """``df`` with a column for each of ``values`` (kind and expression) over the rows of the track before this one.

    Kinds: ``sum`` (0 before any), ``max`` (null before any) and ``last``, the
    value of the row before as a struct ``v``, null if there is none.
    """
    name = {c: f"_v_{c}" for c in values}
    wrap = lambda kind, x: F.struct(x.alias("v")) if kind == "last" else x
    tall = parted(df).withColumns({name[c]: wrap(kind, x) for c, (kind, x) in values.items()})
    total = {"sum": lambda c: F.sum(c), "max": lambda c: F.max(c), "last": lambda c: F.max_by(c, "ord")}
    sums = tall.groupBy(*keys, PART).agg(*(total[kind](F.col(name[c])).alias(name[c]) for c, (kind, _) in values.items()))
    types = dict(sums.dtypes)
    start = {name[c]: F.lit(0 if kind == "sum" else None).cast(types[name[c]]) for c, (kind, _) in values.items()}
    add = {"sum": lambda a, x: a + F.coalesce(x, F.lit(0)), "max": lambda a, x: F.greatest(a, x), "last": lambda a, x: x}
    carry = brought(sums, keys, start, lambda now, x: {name[c]: add[kind](now[name[c]], x[name[c]]) for c, (kind, _) in values.items()})
    both = carried(tall, carry)
    w = within(keys)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    over = {"sum": lambda c: F.coalesce(F.sum(c).over(before), F.lit(0)), "max": lambda c: F.max(c).over(before), "last": lambda c: F.lag(c).over(w)}
    out = both.withColumns({f"_o_{c}": over[kind](F.col(name[c])) for c, (kind, _) in values.items()}).where(~F.col(BROUGHT))
    return out.select(*df.columns, *(F.col(f"_o_{c}").alias(c) for c in values))


def numbered(df: DataFrame, keys: Keys, name: str) -> DataFrame:
    """``df`` with each row's place in its track, from 1."""
    return running(df, keys, **{name: ("sum", F.lit(1).cast("long"))}).withColumn(name, F.col(name) + 1)


def runs(df: DataFrame, keys: Keys, value: Column, name: str = "run") -> DataFrame:
    """``df`` with the number of the row's run of equal ``value`` (nulls are equal) within its track, from 1."""
    w = within(keys)
    tall = parted(df).withColumn("_v", F.struct(value.alias("v")))
    differs = (~F.col("_v").eqNullSafe(F.lag("_v").over(w))).cast("long")
    inner = tall.withColumn("_n", differs).withColumn("_k", F.row_number().over(w))
    # A part's runs are counted without its first row, whose value is held against the last one of the part before.
    sums = inner.groupBy(*keys, PART).agg(F.sum(F.when(F.col("_k") > 1, F.col("_n")).otherwise(0)).alias("_n"), F.min_by("_v", "ord").alias("_a"), F.max_by("_v", "ord").alias("_v"))
    start = {"_n": F.lit(0).cast("long"), "_v": F.lit(None).cast(dict(sums.dtypes)["_v"])}
    carry = brought(sums, keys, start, lambda now, x: {"_n": now["_n"] + x["_n"] + (~x["_a"].eqNullSafe(now["_v"])).cast("long"), "_v": x["_v"]})
    both = carried(tall, carry)
    step = F.when(F.col(BROUGHT), F.col("_n")).otherwise(differs)
    # The window's own columns first: a window cannot be an argument of another.
    both = both.withColumn("_s", step).withColumn(name, F.sum("_s").over(w)).where(~F.col(BROUGHT))
    return both.select(*df.columns, name)


# ---- the end of the cue before, where cues must not overlap

#: Ends stay below this; a function with this threshold ignores what comes in.
FAR = 1 << 62


def _after(f: tuple, g: tuple, k: int) -> tuple:
    """First ``f``, then ``g``. A function ``(c, t, j)`` turns an end E into max(c, E + j * k) where E > t, else into c."""
    (c1, t1, j1), (c2, t2, j2) = f, g
    past = c1 > t2
    return np.where(past, np.maximum(c2, c1 + j2 * k), c2), np.where(past, t1, np.maximum(t1, t2 - j1 * k)), j1 + j2


def _cues(start: np.ndarray, end: np.ndarray, known: np.ndarray) -> tuple:
    """What each cue does to the end before it; one without times leaves it as it is."""
    return np.where(known, end, -FAR), np.where(known, start, -FAR), known.astype(np.int64)


def _folded(f: tuple, opens: np.ndarray, k: int) -> tuple:
    """For each row the functions from the start of its group (``opens``) on, in log2(n) steps over whole columns."""
    n = len(opens)
    at = np.arange(n)
    begin = np.maximum.accumulate(np.where(opens, at, 0))
    d = 1
    while d < n:
        rows = np.flatnonzero(at - d >= begin)
        if not len(rows):
            break
        joined = _after(tuple(x[rows - d] for x in f), tuple(x[rows] for x in f), k)
        f = tuple(x.copy() for x in f)
        for x, y in zip(f, joined, strict=True):
            x[rows] = y
        d *= 2
    return f


def _times(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    s, e = batch.column("start_ms"), batch.column("end_ms")
    known = s.is_valid().to_numpy(zero_copy_only=False) & e.is_valid().to_numpy(zero_copy_only=False)
    return s.fill_null(0).to_numpy().astype(np.int64), e.fill_null(0).to_numpy().astype(np.int64), known


def _cuts(opens: np.ndarray, s: np.ndarray, e: np.ndarray, known: np.ndarray, merge: bool) -> tuple[np.ndarray, np.ndarray]:
    """Cues that end before they start and may join another, which are no function of the kind above, and where stretches without them begin."""
    odd = known & (e < s) if merge else np.zeros(len(s), bool)
    begins = opens | odd
    begins[1:] |= odd[:-1]
    begins[:1] = True
    return odd, begins


#: In place of j: a cue by itself, which turns an end E into E + k where E > t, else into the later of E and c.
ODD = -1


def _summed(k: int, names: list[str], merge: bool):
    """Each part's functions: one, but for cues that end before they start, which stand between those of their neighbours."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, so_far, was_odd = None, None, False

        def out(rows: pa.RecordBatch, f: tuple) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*(rows.column(c) for c in (*names, "ord")), *(pa.array(x, pa.int64()) for x in f)], names=[*names, "_i", "_c", "_t", "_j"])

        for batch in it:
            if not batch.num_rows:
                continue
            opens, (s, e, known) = batch.column(FIRST).to_numpy(zero_copy_only=False), _times(batch)
            odd, begins = _cuts(opens, s, e, known, merge)
            f = _folded(_cues(s, e, known), begins, k)
            f[2][odd] = ODD
            if held is not None and (opens[0] or odd[0] or was_odd):
                yield out(held, so_far)
            elif held is not None:
                goes_on = np.flatnonzero(np.cumsum(begins) == 1)
                joined = _after(so_far, tuple(x[goes_on] for x in f), k)
                for x, y in zip(f, joined, strict=True):
                    x[goes_on] = y
            ends = np.flatnonzero(begins[1:])
            if len(ends):
                yield out(batch.take(pa.array(ends)), tuple(x[ends] for x in f))
            held, so_far, was_odd = batch.slice(batch.num_rows - 1), tuple(x[-1:] for x in f), bool(odd[-1])
        if held is not None:
            yield out(held, so_far)

    return run


def _applied(k: int, min_ms: int, merge: bool):
    """Starts and ends with overlaps taken out, which cues stay cues (``_head``), and how many have in the part so far (``_k``)."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, heads = -FAR, 0  # the end before the batch, and the cues of its first part
        for batch in it:
            if not batch.num_rows:
                continue
            opens, own = (batch.column(c).to_numpy(zero_copy_only=False) for c in (FIRST, BROUGHT))
            s, e, known = _times(batch)
            # What is brought along, and a track's first cue, count whatever came before.
            alone = opens & ~own
            odd, begins = _cuts(np.zeros(len(s), bool), s, e, known & ~opens, merge)
            c, t, j = _cues(s, e, known)
            c, t, j = _folded((np.where(own, e, c), np.where(opens, FAR, t), j), begins, k)
            ends, first = np.empty_like(s), last
            starts = np.flatnonzero(begins)
            for lo, hi in zip(starts, [*starts[1:], len(s)], strict=True):
                if odd[lo]:
                    ends[lo] = last + k if last > s[lo] else max(last, e[lo])
                else:
                    ends[lo:hi] = np.where(last > t[lo:hi], np.maximum(c[lo:hi], last + j[lo:hi] * k), c[lo:hi])
                last = int(ends[hi - 1])
            before = np.concatenate([[first], ends[:-1]])
            before[alone] = -FAR
            over = known & ~own & (s < before)
            start = np.where(over, before + 1, s)
            end = np.where(over, np.maximum(e, before + 1 + min_ms), e)
            head = ~(known & ~alone & (end - start < min_ms)) if merge else np.ones(len(s), bool)
            said = np.cumsum(head & ~own)
            begin = np.maximum.accumulate(np.where(opens, np.arange(len(s)), -1))
            count = said - np.where(begin >= 0, said[begin] - (head & ~own)[begin], -heads)
            heads = int(count[-1])
            for name, x in (("start_ms", start), ("end_ms", end)):
                i = batch.schema.get_field_index(name)
                new = pa.array(x, pa.int64()).cast(batch.schema.field(i).type)
                batch = batch.set_column(i, batch.schema.field(i), new if known.all() else pc.if_else(pa.array(known), new, batch.column(i)))
            yield batch.append_column("_head", pa.array(head)).append_column("_k", pa.array(count, pa.int64())).filter(pa.array(~own))

    return run


def deoverlapped(cues: DataFrame, keys: Keys, min_ms: int, merge: bool) -> DataFrame:
    """``cues`` with no start before the end of the cue before, ``_head``: false where, with ``merge``, a cue too short joins the one before,
    and ``_k``, how many cues of the part (``_part``) have not, up to this one.

    What a cue does to the end before it is a function of three numbers, and so
    is one after another, so a part's cues are put together without knowing
    the end that comes in.
    """
    k, names, columns = min_ms + 1, [*keys, PART], cues.columns
    types = dict(parted(cues).dtypes)
    listed = lambda cs: ", ".join(f"`{c}` {types[c]}" for c in cs)
    opened = lambda df: df.withColumn(FIRST, F.row_number().over(within(keys)) == 1)
    tall = parted(cues)
    # Only tracks of several parts have anything to bring along.
    long = tall.groupBy(*keys).agg(F.min(PART).alias("_lo"), F.max(PART).alias("_hi")).where("_lo < _hi").select(*(F.col(c).alias(f"_l_{c}") for c in keys))
    same = F.lit(True)
    for c in keys:
        same = same & F.col(c).eqNullSafe(F.col(f"_l_{c}"))
    bare = tall.join(long, same, "left_semi").select(*names, "ord", F.col("start_ms").cast("long").alias("start_ms"), F.col("end_ms").cast("long").alias("end_ms"))
    found = opened(bare).mapInArrow(_summed(k, names, merge), f"{listed(names)}, _i {types['ord']}, _c long, _t long, _j long")
    sums = found.groupBy(*names).agg(F.sort_array(F.collect_list(F.struct("_i", "_c", "_t", "_j"))).alias("_f"))

    def one(end: Column, f: Column) -> Column:
        over = end > f["_t"]
        return F.when(f["_j"] == ODD, F.when(over, end + k).otherwise(F.greatest(end, f["_c"]))).when(over, F.greatest(f["_c"], end + f["_j"] * k)).otherwise(f["_c"])

    def step(now: Column, x: Column) -> dict[str, Column]:
        # The first part starts from an end before all time.
        return {"end_ms": F.reduce(x["_f"], now["end_ms"], one)}

    carry = brought(sums, keys, {"end_ms": F.lit(-FAR).cast("long")}, step)
    both = opened(carried(tall, carry.withColumn("end_ms", F.col("end_ms").cast(types["end_ms"]))))
    every = [*columns, PART, BROUGHT, FIRST]
    types |= {BROUGHT: "boolean", FIRST: "boolean"}
    out = both.select(*every).mapInArrow(_applied(k, min_ms, merge), f"{listed(every)}, _head boolean, _k long")
    return out.select(*columns, PART, "_head", "_k")


def counted(parts: DataFrame, keys: Keys, within: str, name: str) -> DataFrame:
    """``parts`` (``_part`` and counts up to each row of its part) with the count of the whole track up to each row."""
    sums = parts.groupBy(*keys, PART).agg(F.max(within).alias(name))
    carry = brought(sums, keys, {name: F.lit(0).cast("long")}, lambda now, x: {name: now[name] + x[name]})
    named = carry.select(*(F.col(c).alias(f"_c_{c}") for c in (*keys, PART)), F.col(name).alias("_c"))
    same = F.lit(True)
    for c in (*keys, PART):
        same = same & F.col(c).eqNullSafe(F.col(f"_c_{c}"))
    return parts.join(named, same, "left").withColumn(name, F.col(within) + F.coalesce("_c", F.lit(0))).drop("_c", *(f"_c_{c}" for c in (*keys, PART)))
