"""Row numbers, ntiles and running sums over a whole table.

An unpartitioned window would sort everything in one task. Instead rows are range-partitioned by
the full order and numbered inside their block; each block then adds what the blocks before it
hold. The order must be total: it also spreads a hot value over many blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from quitanda.session import materialize

_BLOCK, _SLOT = "_block", "_slot"


def _blocks(df: DataFrame, order: list[Column], label: str) -> DataFrame:
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    slot = F.monotonically_increasing_id()  # block in the high bits, row inside it in the low 33
    placed = df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_id", slot)
    kept = placed.withColumns({
        _BLOCK: F.shiftright("_id", 33).cast("int"),
        _SLOT: F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)),
    }).drop("_id")
    # Range bounds are sampled, so the layout is written once instead of being computed twice.
    return materialize(kept, label)


def _before(kept: DataFrame, sums: dict[str, Column]) -> DataFrame:
    """Totals of the preceding blocks: one row per block, at most shuffle.partitions rows."""
    per_block = kept.groupBy(_BLOCK).agg(*[e.alias(n) for n, e in sums.items()])
    earlier = Window.orderBy(_BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    return F.broadcast(per_block.select(
        _BLOCK,
        *[F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(f"_before_{n}") for n in sums],
        *[F.sum(n).over(everything).alias(f"_all_{n}") for n in sums],
    ))


def number_rows(df: DataFrame, order: list[Column], position: str, total: str | None = None,
                label: str = "numbered", start: int | Column = 0) -> DataFrame:
    """``row_number() over (order by ...)`` for a table of any size."""
    kept = _blocks(df, order, label)
    out = kept.join(_before(kept, {"n": F.count("*")}), _BLOCK)
    cols = {position: F.col("_before_n") + F.col(_SLOT) + 1 + start}
    if total:
        cols[total] = F.col("_all_n")
    return out.withColumns(cols).select(*df.columns, *cols)


def ntile_of(position: Column, total: Column, tiles: int) -> Column:
    """SQL ``ntile`` from a 1-based position: the first ``total % tiles`` tiles get one row more."""
    small, bigger = F.floor(total / tiles), total % tiles
    row = position - 1
    edge = bigger * (small + 1)
    in_big = F.floor(row / (small + 1))
    in_small = bigger + F.floor(F.try_divide(row - edge, small))
    return (F.when(row < edge, in_big).otherwise(in_small) + 1).cast("int")


def with_ntile(df: DataFrame, order: list[Column], tiles: int, name: str) -> DataFrame:
    numbered = number_rows(df, order, "_pos", "_total", f"ntile-{name}")
    return numbered.withColumn(name, ntile_of(F.col("_pos"), F.col("_total"), tiles)).drop("_pos", "_total")


def _first_rows(n: int, tiles: int) -> list[int]:
    """1-based position of the first row of every tile but the first; tiles without rows are left out."""
    small, bigger = divmod(n, tiles)
    return [p for p in (t * small + min(t, bigger) + 1 for t in range(1, tiles)) if p <= n]


def with_ntiles(df: DataFrame, tiles: int, key: str, **by: Column) -> DataFrame:
    """SQL ``ntile`` over each of several orders; every name in ``by`` is given to a tile, its value orders the rows,
    rows of one value follow ``key``, which is unique. Nulls come first; negate a value to turn its order.

    Nothing but the values is sorted: they are counted, for all orders in one pass, and the counts tell in which
    value each tile begins. Only the keys of those values (``tiles - 1`` an order) are numbered. The first rows of
    the tiles are literals, so the rows themselves are written once and not shuffled.
    """
    if not by:
        return df
    names, fresh = list(by), {f"_by_{i}": v for i, v in enumerate(by.values())}
    kept = materialize(df.withColumns(fresh), "ntiles")
    n = kept.count()
    sides = F.array(*[F.struct(F.lit(i).alias("side"), F.col(c).alias("v")) for i, c in enumerate(fresh)])
    values = kept.select(key, F.explode(sides).alias("s")).select(key, "s.*")
    run = running_sum(values.groupBy("side", "v").agg(F.count("*").alias("n")), [F.asc("side"), F.asc_nulls_first("v")], "n", "upto", "_all", "_pos")
    starts = [(i, i * n + p) for i in range(len(names)) for p in _first_rows(n, tiles)]
    if starts:
        within = F.array(*[F.lit(p).cast("long") for _, p in starts])
        cut = run.select("side", "v", "n", (F.col("upto") - F.col("n")).alias("before"),
                         F.filter(within, lambda p: (p > F.col("upto") - F.col("n")) & (p <= F.col("upto"))).alias("starts"))
        cut = cut.where(F.size("starts") > 0).orderBy("side", F.asc_nulls_first("v")).collect()  # at most one row a start
    else:
        cut = []
    bounds: list[list[Column]] = [[] for _ in names]
    if cut:
        kind = values.schema["v"].dataType
        which = F.lit(None).cast("int")
        wanted, total = {}, 0
        for c, r in enumerate(cut):
            which = F.when((F.col("side") == r.side) & F.col("v").eqNullSafe(F.lit(r.v).cast(kind)), c).otherwise(which)
            wanted |= {total + p - r.before: c for p in r.starts}
            total += r.n
        tied = number_rows(values.select(which.alias("cut"), key).where("cut IS NOT NULL"), [F.asc("cut"), F.asc_nulls_first(key)], "_place", label="ntiles-cut")
        for r in tied.where(F.col("_place").isin(list(wanted))).orderBy("_place").collect():
            at = cut[r.cut]
            bounds[at.side].append(F.struct(F.lit(at.v).cast(kind).alias("v"), F.lit(r[key]).cast(kept.schema[key].dataType).alias("k")))
    tile = {}
    for i, name in enumerate(names):
        row = F.struct(F.col(f"_by_{i}").cast(values.schema["v"].dataType).alias("v"), F.col(key).alias("k"))
        tile[name] = sum(((row >= b).cast("int") for b in bounds[i]), F.lit(1))
    return kept.withColumns(tile).drop(*fresh)


def running_sum(df: DataFrame, order: list[Column], value: str, running: str, total: str,
                position: str, rows: str | None = None) -> DataFrame:
    """Running and grand total of ``value`` in the given order, the row position and, if named,
    the number of rows."""
    kind = df.select(F.sum(value).alias("s")).schema["s"].dataType
    kept = _blocks(df, order, "running")
    inside = Window.partitionBy(_BLOCK).orderBy(_SLOT).rowsBetween(Window.unboundedPreceding, 0)
    out = (kept.withColumn("_inside", F.sum(value).over(inside))
           .join(_before(kept, {"n": F.count("*"), "v": F.sum(value)}), _BLOCK))
    cols = {
        running: (F.col("_before_v") + F.col("_inside")).cast(kind),
        total: F.col("_all_v").cast(kind),
        position: F.col("_before_n") + F.col(_SLOT) + 1,
    }
    if rows:
        cols[rows] = F.col("_all_n")
    return out.withColumns(cols).select(*df.columns, *cols)
