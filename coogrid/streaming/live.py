"""Section figures while the samples still arrive."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState

from ..functions.timecols import micros
from ..operators.intervals import CELL_SAMPLES, FAN, cells_above, covering
from ..operators.order import int_div
from ..plans.skew import BROADCAST_KEYS, spread_join

# Kernels travel with their code, so executors need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Finest cells that a short section touches, about, and parts that samples are dealt to where sections are many.
SECTION_CELLS, PARTS = 8, 16
#: The same for samples that are all there: as many as leave CELL_SAMPLES instants to a cell, within two bounds.
LEAST_CELLS, MOST_CELLS = 2, 16
#: Level of the two end cells of a section, where its samples are told apart by their time.
ENDS = -1


class _Placed:
    """Sections on the cells of a tower over time: a bounded number of cells a level, however long a section is.

    The finest cells are sized from a short section (the tenth part is shorter); a
    sample is copied only to levels that some section uses.  A table of few cells
    goes to every task; otherwise samples are dealt to ``parts`` parts by hash and every
    part has a copy of the sections, so that what arrives at one moment is spread.

    With ``ends`` the two end cells of a section are on a level of their own, and
    the table has every section once.
    """

    def __init__(self, experiments: DataFrame, cells: int | None, parts: int, each: int = SECTION_CELLS, ends: bool = False):
        spans = experiments.select("section_id", micros("t_begin").alias("__b"), micros("t_end").alias("__e"))
        spans = spans.where("__b <= __e")
        length = F.percentile_approx(F.col("__e") - F.col("__b"), 0.1)
        row = spans.agg(F.min("__b").alias("lo"), F.max("__e").alias("hi"), length.alias("length")).first()
        self.lo, self.hi = row["lo"] or 0, row["hi"] or 0
        span = self.hi - self.lo + 1
        self.width = max(1, -(-span // cells) if cells else (row["length"] or 0) // each)
        levels = 1
        while FAN**levels * self.width < span:
            levels += 1
        first, last = self._cell(F.col("__b")), self._cell(F.col("__e"))
        whole = covering(first + 1, last, levels) if ends else covering(first, last + 1, levels)
        if ends:
            outer = F.array_distinct(F.array(first, last))
            outer = F.transform(outer, lambda c: F.struct(F.lit(ENDS).alias("level"), c.alias("cell")))
            whole = F.concat(outer, whole)
        placed = spans.withColumn("__c", F.explode(whole)).select(
            "section_id", "__b", "__e", F.col("__c.level").alias("__level"), F.col("__c.cell").alias("__cell")
        )
        counted = placed.groupBy("__level").count().collect()  # one row a level
        self.levels = sorted(r[0] for r in counted)
        self.few = few = sum(r[1] for r in counted) <= BROADCAST_KEYS
        if ends:
            self.table = F.broadcast(placed) if few else placed
            return
        self.parts = 1 if few else parts
        copies = placed.withColumn("__part", F.explode(F.sequence(F.lit(0), F.lit(self.parts - 1))))
        self.table = F.broadcast(copies) if few else copies

    def _cell(self, us: Column) -> Column:
        return int_div(us - F.lit(self.lo), self.width)

    def met(self, stream: DataFrame, *columns: Column, how: str = "inner") -> DataFrame:
        """``section_id, __e, __t`` and ``columns`` for every sample inside a section, both ends included.

        With ``how="left"`` samples outside all sections stay too, under no section.
        """
        t = F.col("__t")
        samples = stream.select(micros("ts").alias("__t"), *columns).where("__t IS NOT NULL")
        names = samples.columns
        samples = samples.withColumn("__c", F.explode(cells_above(self._cell(t), self.levels)))
        part = F.pmod(F.xxhash64(*names), F.lit(self.parts)).cast("int").alias("__part")
        samples = samples.select(*names, F.col("__c.level").alias("__level"), F.col("__c.cell").alias("__cell"), part)
        table = self.table.withColumnsRenamed({c: c + "_" for c in ("__level", "__cell", "__part")})
        same = [F.col(c) == F.col(c + "_") for c in ("__level", "__cell", "__part")]
        met = samples.join(table, [*same, t >= F.col("__b"), t <= F.col("__e")], how)
        return met.select("section_id", "__e", *names)

    def figures(self, instants: DataFrame) -> DataFrame:
        """``section_id`` and ``__n, __lo, __hi`` of instants ``__t, __n, __lo, __hi``, for a table with ``ends``.

        A section meets the instants of its two end cells and one row for each whole cell
        between them.  A cell that many instants and sections share is split by the join.
        """
        t = F.col("__t")
        merged = [F.sum("__n").alias("__n"), F.min("__lo").alias("__lo"), F.max("__hi").alias("__hi")]
        at = [F.col("__c.level").alias("__level"), F.col("__c.cell").alias("__cell")]
        inside = instants.where((t >= F.lit(self.lo)) & (t <= F.lit(self.hi))).withColumn("__cell", self._cell(t))
        single = inside.select("__t", F.lit(ENDS).alias("__level"), "__cell", "__n", "__lo", "__hi")
        per_cell = inside.groupBy("__cell").agg(*merged)
        up = cells_above(F.col("__cell"), [i for i in self.levels if i != ENDS])
        tower = per_cell.select(F.explode(up).alias("__c"), "__n", "__lo", "__hi").select(*at, "__n", "__lo", "__hi")
        tower = tower.groupBy("__level", "__cell").agg(*merged).withColumn("__t", F.lit(None).cast("long"))
        rows, keys = single.unionByName(tower), ["__level", "__cell"]
        if self.few:
            met = rows.join(self.table, keys)
        else:
            sizing = rows.select(*keys), self.table.select(*keys)
            met = spread_join(rows, self.table, keys, left_by=["__t"], right_by=["section_id"], sizing=sizing)
        whole = F.col("__level") != ENDS
        return met.where(whole | ((t >= F.col("__b")) & (t <= F.col("__e")))).select("section_id", "__n", "__lo", "__hi")


def _at_once(samples: DataFrame, experiments: DataFrame, used: str, cells: int | None) -> DataFrame:
    """``section_id`` and partial figures ``__n, __lo, __hi`` of samples that are all there."""
    single = samples.select(micros("ts").alias("__t"), F.col(used).alias("__u")).where("__t IS NOT NULL")
    figures = [F.count(F.lit(1)).alias("__n"), F.min("__u").alias("__lo"), F.max("__u").alias("__hi")]
    instants = single.groupBy("__t").agg(*figures)
    length = F.percentile_approx(micros("t_end") - micros("t_begin"), 0.1)
    seen = single.agg(F.approx_count_distinct("__t").alias("n"), (F.max("__t") - F.min("__t") + 1).alias("span")).first()
    short = experiments.where("t_begin <= t_end").agg(length.alias("length")).first()["length"]
    held = seen["n"] * (short or 0) // (seen["span"] or 1)  # instants of a short section
    each = max(LEAST_CELLS, min(MOST_CELLS, held // CELL_SAMPLES))
    return _Placed(experiments, cells, 1, each, ends=True).figures(instants)


def live_section_memory(
    stream: DataFrame, experiments: DataFrame, used: str = "used_mib", cells: int | None = None, parts: int = PARTS
) -> DataFrame:
    """``section_id, samples, min_mib, max_mib, used_mib`` of a stream of samples ``ts, used_mib``.

    The sections are a static table and meet the stream on the cells of a tower over
    time.  State is one row per section, combined map-side before it shuffles; write
    it in update or complete mode.  While a section is open its newest sample counts
    too: see :func:`closed_section_memory` for final figures.

    Samples that are not a stream are reduced to instants and cells before they meet
    the sections, which are shuffled once instead of once per part.
    """
    if not stream.isStreaming:
        return _at_once(stream, experiments, used, cells).groupBy("section_id").agg(
            F.sum("__n").alias("samples"),
            F.min("__lo").alias("min_mib"),
            F.max("__hi").alias("max_mib"),
            (F.max("__hi") - F.min("__lo")).alias("used_mib"),
        )
    met = _Placed(experiments, cells, parts).met(stream, F.col(used).alias("__u"))
    return met.groupBy("section_id").agg(
        F.count(F.lit(1)).alias("samples"),
        F.min("__u").alias("min_mib"),
        F.max("__u").alias("max_mib"),
        (F.max("__u") - F.min("__u")).alias("used_mib"),
    )


# Figures of some samples: their number, how many have a value, the least and the greatest value (0 without any).
Figures = tuple[int, int, float, float]
_NAMES = ("n", "v", "lo", "hi")


def _plus(a: Figures, b: Figures) -> Figures:
    if not a[1] or not b[1]:
        return (a[0] + b[0], *(a if a[1] else b)[1:])
    return a[0] + b[0], a[1] + b[1], min(a[2], b[2]), max(a[3], b[3])


def _merge(a: tuple, b: tuple) -> tuple:
    """Two parts of a section as one: time and number of its last sample, figures of the others, figures of the last.

    The last sample of a section is left out, and which one it is shows only when all
    have arrived; so it is held apart, and joins the others when a later one comes.
    """
    if a[:2] < b[:2]:
        a, b = b, a
    if a[:2] == b[:2]:
        return (*a[:2], _plus(a[2], b[2]), _plus(a[3], b[3]))
    return (*a[:2], _plus(_plus(a[2], b[2]), b[3]), a[3])


def _reduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per section and batch: the part of :func:`_merge`, in columns."""
    for batch in batches:
        if not batch.num_rows:
            continue
        coded = batch.column(0).dictionary_encode(null_encoding="encode")
        at, k = coded.indices.to_numpy(), len(coded.dictionary)
        end, t, seq = (batch.column(i).fill_null(0).to_numpy() for i in (1, 2, 3))
        valid = batch.column(4).is_valid().to_numpy(zero_copy_only=False)
        u = batch.column(4).fill_null(0).to_numpy()
        bounds = np.iinfo(u.dtype) if u.dtype.kind == "i" else np.finfo(u.dtype)

        def extreme(over, where, values, start):
            out = np.full(k, start, values.dtype)
            over.at(out, at[where], values[where])
            return out

        every = np.ones(len(at), bool)
        last = extreme(np.maximum, every, t, np.iinfo(np.int64).min)
        at_last = t == last[at]
        number = extreme(np.maximum, at_last, seq, np.iinfo(np.int64).min)
        held = at_last & (seq == number[at])
        columns = [coded.dictionary, extreme(np.maximum, every, end, np.iinfo(np.int64).min), last, number]
        for part in (~held, held):
            ok = part & valid
            v = np.bincount(at[ok], minlength=k)
            lo, hi = extreme(np.minimum, ok, u, bounds.max), extreme(np.maximum, ok, u, bounds.min)
            columns += [np.bincount(at[part], minlength=k), v, np.where(v > 0, lo, 0), np.where(v > 0, hi, 0)]
        columns.append(pa.array(last, pa.timestamp("us", tz="UTC")))
        names = ["section_id", "end", "t", "seq", *_NAMES, *("h" + n for n in _NAMES), "event"]
        arrays = [c if isinstance(c, pa.Array) else pa.array(c) for c in columns]
        yield pa.RecordBatch.from_arrays(arrays, names=names)


def closed_section_memory(
    stream: DataFrame,
    experiments: DataFrame,
    delay: str = "10 seconds",
    used: str = "used_mib",
    cells: int | None = None,
    parts: int = PARTS,
) -> DataFrame:
    """``section_id, samples, min_mib, max_mib, used_mib``, once for every section that is over; append mode.

    A section is over when the event-time watermark (the newest ``ts`` less ``delay``) has
    passed its end.  Its figures are then those of the batch operator: the last sample
    up to the end is left out (with ``seq``, of one instant the one numbered highest;
    without, the whole last instant), and values are NULL where no sample is left.
    The state of a section is one row, and it is freed when the section is over.

    Samples that come after a section was emitted are ignored for it.  A section that
    no sample met is not emitted.  Tasks combine their samples per section before the
    shuffle, so a long section with most of the samples is no hot key.
    """
    kind = "double" if dict(stream.dtypes)[used] in ("double", "float") else "long"
    number = (F.col("seq").cast("long") if "seq" in stream.columns else F.lit(0).cast("long")).alias("__seq")
    # Samples outside all sections move the watermark as well: they stay, under no section.
    met = _Placed(experiments, cells, parts).met(stream, number, F.col(used).cast(kind).alias("__u"), how="left")
    met = met.select("section_id", "__e", "__t", "__seq", "__u")
    id_type = dict(experiments.dtypes)["section_id"]
    figures = f"n long, v long, lo {kind}, hi {kind}, hn long, hv long, hlo {kind}, hhi {kind}"
    reduced = met.mapInArrow(_reduced, f"section_id {id_type}, `end` long, t long, seq long, {figures}, event timestamp")
    reduced = reduced.withWatermark("event", delay)

    def result(key: tuple, part: tuple) -> pd.DataFrame:
        n, v, lo, hi = part[2]
        none = pd.Series([None], dtype=object)
        row = {"section_id": [key[0]], "samples": [n], "min_mib": [lo] if v else none, "max_mib": [hi] if v else none}
        return pd.DataFrame(row | {"used_mib": [hi - lo] if v else none})

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = None
        if pd.isna(key[0]):
            return
        if state.exists:
            t, seq, *f = state.get
            held = (t, seq, tuple(f[:4]), tuple(f[4:8]))
        if state.hasTimedOut:
            state.remove()
            yield result(key, held)
            return
        close = None
        for frame in frames:
            for end, t, seq, *f in frame.drop(columns=["section_id", "event"]).itertuples(index=False, name=None):
                close = -(-int(end) // 1000)
                part = (int(t), int(seq), tuple(x.item() if hasattr(x, "item") else x for x in f[:4]), tuple(f[4:]))
                held = part if held is None else _merge(held, part)
        if close is not None and state.getCurrentWatermarkMs() <= close:
            state.update((held[0], held[1], *held[2], *held[3]))
            state.setTimeoutTimestamp(close)

    value = f"section_id {id_type}, samples long, min_mib {kind}, max_mib {kind}, used_mib {kind}"
    grouped = reduced.groupBy("section_id")
    return grouped.applyInPandasWithState(update, value, f"t long, seq long, {figures}", "append", "EventTimeTimeout")
