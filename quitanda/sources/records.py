"""Records of delimited text whose quoted values may run over several lines, read block by block.

Whether a line begins inside a quoted value depends on all quotes of the file before it. Every block of
a file is summed up on its own: the number of its lines with an odd count of quotes, and its lines up to
the first of them. A running sum over the blocks of a file then says which blocks begin inside a value,
and with that each block puts its records together by itself. Only a record that runs past the end of
its block takes the first lines of the next ones from the summary.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.csv as pcsv
from pyspark.sql import DataFrame, Window, functions as F

MAX_RECORD = 1 << 20  # characters; a longer record cannot be read
MOST_BLOCKS = 500_000  # with quotes over several lines, or in ``csv_cells`` any; their state is broadcast
FEWEST = 64  # records; fewer at a time are left to from_csv

# Cells without quotes, or quoted as a whole with inner quotes doubled: on these every CSV reader agrees.
_CELL = r'(?:"(?:[^"\x00]|"")*"|[^",\x00]*)'
PLAIN = f"^{_CELL}(?:,{_CELL})*$"

SUMMARY = "_source_file string, block long, lines long, odd long, first string, head string"


def _runs(batch: pa.RecordBatch):
    """(file, block, slice) of the lines of one block that stand together."""
    if not batch.num_rows:
        return
    blocks, paths = batch.column(2).to_numpy(), batch.column(1).dictionary_encode().indices.to_numpy()
    cut = np.flatnonzero(np.r_[True, (blocks[1:] != blocks[:-1]) | (paths[1:] != paths[:-1])]).tolist()
    for a, b in zip(cut, [*cut[1:], batch.num_rows]):
        yield batch.column(1)[a].as_py(), int(blocks[a]), a, b - a


def _odd(values: pa.Array) -> np.ndarray:
    """Which lines have an odd number of quotes."""
    return pc.count_substring(values, '"').to_numpy(zero_copy_only=False) % 2 == 1


class _Summary:
    def __init__(self, file: str, block: int):
        self.file, self.block, self.lines, self.odd, self.first = file, block, 0, 0, None
        self.head, self.size, self.seeking = [], 0, True

    def take(self, values: pa.Array):
        odd = np.flatnonzero(_odd(values))
        blank = pc.equal(pc.utf8_trim_whitespace(values), "").to_numpy(zero_copy_only=False)
        self.lines += int((~blank).sum())
        if self.first is None and not blank.all():
            self.first = values[int(np.argmin(blank))].as_py()
        if self.seeking:
            some = values[:int(odd[0]) + 1] if len(odd) else values
            self.size += (pc.sum(pc.utf8_length(some)).as_py() or 0) + len(some)
            self.seeking = not len(odd) and self.size <= MAX_RECORD
            self.head = self.head + some.to_pylist() if self.size <= MAX_RECORD else None
        self.odd += len(odd)

    def row(self) -> tuple:
        return self.file, self.block, self.lines, self.odd, self.first, None if self.head is None else "\n".join(self.head)


def block_summaries(lines: DataFrame) -> DataFrame:
    """One row per block of ``lines(value, _source_file, block)``: its lines, those with an odd number of
    quotes, the first line with text and the lines up to the first odd one (null if they are too long)."""
    def run(batches):
        current = None
        for batch in batches:
            done = []
            for file, block, a, n in _runs(batch):
                if current is None or (current.file, current.block) != (file, block):
                    if current is not None:
                        done.append(current.row())
                    current = _Summary(file, block)
                current.take(batch.column(0)[a:a + n])
            if done:
                yield _rows(done)
        if current is not None:
            yield _rows([current.row()])

    def _rows(rows):
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], [c.split()[0] for c in SUMMARY.split(", ")])

    return lines.select("value", "_source_file", "block").mapInArrow(run, SUMMARY)


def block_states(blocks: DataFrame) -> DataFrame:
    """``blocks`` with ``paired`` (the quotes of the file pair up), ``opens`` (the block begins inside a
    value) and ``chain`` (the block in which that value's record began)."""
    order = Window.partitionBy("_source_file").orderBy("block")  # a file has as many rows as blocks
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("odd").over(earlier), F.lit(0))
    marked = blocks.select("*", (F.sum("odd").over(Window.partitionBy("_source_file")) % 2 == 0).alias("paired"),
                           (before % 2 == 1).alias("inside"), ((before + F.col("odd")) % 2 == 1).alias("left"))
    started = F.last(F.when((F.col("odd") > 0) & F.col("left"), F.col("block")), ignorenulls=True).over(earlier)
    return marked.select("*", (F.col("paired") & F.col("inside")).alias("opens"), started.alias("chain")).drop("inside", "left")


class _Assembler:
    """Puts the records of one block together; ``opens`` and ``paired`` as in ``block_states``."""

    def __init__(self, file: str, block: int, opens: bool, paired: bool):
        self.file, self.block, self.paired = file, block, paired
        self.skipping, self.inside, self.held, self.size = opens, False, [], 0

    def _keep(self, values: pa.Array):
        self.size += (pc.sum(pc.utf8_length(values)).as_py() or 0) + len(values)
        if self.size <= MAX_RECORD:
            self.held += values.to_pylist()

    def take(self, values: pa.Array):
        """(lines, unreadable) of the finished records."""
        odd = _odd(values)
        if not self.paired:
            yield values, odd
            return
        at = 0
        for stop in np.flatnonzero(odd).tolist() + [len(values)]:
            last = stop == len(values)
            end = stop if last or not (self.skipping or self.inside) else stop + 1
            some = values[at:end]
            if self.skipping:
                self.skipping = last
            elif self.inside:
                self._keep(some)
                if not last:
                    yield self.finish()
            else:
                if len(some):
                    yield some, np.zeros(len(some), bool)
                if not last:
                    self.inside, self.held, self.size = True, [], 0
                    self._keep(values[stop:stop + 1])
                    end = stop + 1
            at = end

    def finish(self):
        self.inside = False
        whole = self.size <= MAX_RECORD
        return pa.array(["\n".join(self.held) if whole else self.held[0] if self.held else ""], pa.string()), np.array([not whole])


def _with_states(lines: DataFrame, states: DataFrame, how: str) -> DataFrame:
    """``lines`` with the columns ``states`` has for their block; the lines of a block stay together and in order."""
    if states.count() <= MOST_BLOCKS:
        return lines.join(F.broadcast(states), ["_source_file", "block"], how)
    return (lines.withColumn("line", F.monotonically_increasing_id()).join(states, ["_source_file", "block"], how)
            .repartition("_source_file", "block").sortWithinPartitions("_source_file", "block", "line"))


def _assembled(batches):
    """(assembler, records, which are unreadable, tail) as they are finished; ``tail`` is the block if the last runs on."""
    current = None
    for batch in batches:
        for file, block, a, n in _runs(batch):
            if current is None or (current.file, current.block) != (file, block):
                if current is not None and current.inside:
                    yield current, *current.finish(), current.block
                opens, paired = (batch.column(i)[a].as_py() for i in (3, 4))
                current = _Assembler(file, block, bool(opens), paired is not False)
                current.layout = [batch.column(i)[a].as_py() for i in range(5, batch.num_columns)]
            for values, bad in current.take(batch.column(0)[a:a + n]):
                yield current, values, bad, None
    if current is not None and current.inside:
        yield current, *current.finish(), current.block


def _finished(found: DataFrame, states: DataFrame, *also: str) -> DataFrame:
    """Records with what the next blocks hold of them, without blank ones; a null ``value`` stands for one parsed already."""
    rest = (states.where("opens").groupBy("_source_file", F.col("chain").alias("tail"))
            .agg(F.sort_array(F.collect_list(F.struct("block", "head"))).alias("heads"))
            .select("_source_file", "tail", F.array_join(F.transform("heads", lambda h: h["head"]), "\n").alias("rest"),
                    F.exists("heads", lambda h: h["head"].isNull()).alias("long")))
    whole = F.when(F.col("rest").isNotNull(), F.concat_ws("\n", "value", "rest")).otherwise(F.col("value"))
    bad = F.col("unreadable") | F.coalesce("long", F.lit(False)) | F.coalesce(F.length(whole) > MAX_RECORD, F.lit(False))
    return (found.join(rest, ["_source_file", "tail"], "left").where(whole.isNull() | (F.trim(whole) != ""))
            .select("_source_file", whole.alias("value"), bad.alias("unreadable"), *also))


def csv_records(lines: DataFrame, states: DataFrame) -> DataFrame:
    """(_source_file, value, unreadable): the records of ``lines(value, _source_file, block)``.

    ``states`` comes from ``block_states``. A line outside quotes is a record; blank ones are dropped.
    Where the quotes of a file do not pair up, its lines stand for themselves and those with an odd number
    are unreadable; so are records of more than MAX_RECORD characters.
    """
    quoted = states.where("odd > 0 OR opens").select("_source_file", "block", "opens", "paired")

    def run(batches):
        for at, values, bad, tail in _assembled(batches):
            yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(at.file, pa.string()), len(values)), values.cast(pa.string()), pa.array(bad, pa.bool_()),
                                              pa.array([tail] * len(values), pa.int64())], ["_source_file", "value", "unreadable", "tail"])

    found = _with_states(lines, quoted, "left").select("value", "_source_file", "block", "opens", "paired").mapInArrow(
        run, "_source_file string, value string, unreadable boolean, tail long")
    return _finished(found, states)


def _plain(values: pa.Array) -> np.ndarray:
    """Which records are plain CSV, neither empty nor long; a mark at the start would be taken for the file's."""
    size = pc.binary_length(values)
    fits = pc.and_(pc.and_(pc.greater(size, 0), pc.less_equal(size, MAX_RECORD)), pc.match_substring_regex(values, PLAIN))
    return pc.and_(fits, pc.invert(pc.starts_with(values, "\ufeff"))).to_numpy(zero_copy_only=False)


def _plain_cells(values: pa.Array, plain: np.ndarray, width: int, places: list[int]):
    """(cells at ``places`` as one array each, which records they are of) of the plain records with ``width`` cells."""
    some, odd = values.filter(pa.array(plain)), []

    def other_width(row):
        odd.append(row.number - 1)
        return "skip"

    text = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(some)], pa.int32()), some), "\n")[0].as_buffer()
    wanted = [str(p) for p in places if p >= 0]
    read = pcsv.read_csv(
        pa.BufferReader(text), pcsv.ReadOptions(use_threads=False, block_size=text.size + 1, column_names=[str(i) for i in range(width)]),
        pcsv.ParseOptions(ignore_empty_lines=False, invalid_row_handler=other_width),
        pcsv.ConvertOptions(check_utf8=False, column_types=dict.fromkeys(wanted, pa.string()), include_columns=sorted(set(wanted)) or ["0"],
                            null_values=[""], strings_can_be_null=True))
    done = np.delete(np.flatnonzero(plain), np.array(odd, int))
    if len(done) != len(read):
        raise ValueError(f"{len(read)} of {len(done)} records of {width} cells parsed")
    cells = [read.column(str(p)).combine_chunks() if p >= 0 else pa.nulls(len(read), pa.string()) for p in places]
    return cells, done


def csv_cells(lines: DataFrame, states: DataFrame, layouts: DataFrame, n: int, parse) -> DataFrame:
    """(_source_file, c0..): ``n`` cells of every readable record but headers, those at ``places`` of its file.

    ``layouts(_source_file, header, width, places)`` has the files to read; a place of -1 gives null. Records
    that are plain CSV are parsed here, many at a time; ``parse`` (text to an array of cells) takes the others.
    """
    state = states.join(layouts, "_source_file").select(
        "_source_file", "block", "opens", "paired", "header", "width", F.array_join("places", ",").alias("places"))
    names = [f"c{i}" for i in range(n)]
    kinds = [("_source_file", pa.string()), ("value", pa.string()), ("unreadable", pa.bool_()), ("tail", pa.int64()), ("places", pa.string()),
             *[(c, pa.string()) for c in names]]

    def run(batches):
        def rows(count, **cols):
            return pa.RecordBatch.from_arrays([cols[c] if c in cols else pa.nulls(count, k) for c, k in kinds], [c for c, _ in kinds])

        def same(value, count):
            return pa.repeat(pa.scalar(value, pa.string()), count)

        for at, values, bad, tail in _assembled(batches):
            header, width, text = at.layout
            values, left = values.cast(pa.string()), ~pc.equal(values, header).to_numpy(zero_copy_only=False)
            if len(values) >= FEWEST and width > 1 and tail is None:
                plain = left & ~bad & _plain(values)
                if plain.any():
                    cells, done = _plain_cells(values, plain, width, [int(p) for p in text.split(",")])
                    left[done] = False
                    yield rows(len(done), _source_file=same(at.file, len(done)), unreadable=pa.array(np.zeros(len(done), bool)), **dict(zip(names, cells)))
            if left.any():
                count, keep = int(left.sum()), pa.array(left)
                yield rows(count, _source_file=same(at.file, count), value=values.filter(keep), unreadable=pa.array(np.asarray(bad)[left]),
                           tail=pa.array([tail] * count, pa.int64()), places=same(text, count))

    found = _with_states(lines, state, "inner").select(
        "value", "_source_file", "block", "opens", "paired", "header", "width", "places").mapInArrow(
        run, "_source_file string, value string, unreadable boolean, tail long, places string, " + ", ".join(f"{c} string" for c in names))
    whole = _finished(found, states, "places", *names).where("NOT unreadable")
    places = F.split("places", ",").cast("array<int>")
    other = F.transform(F.array(parse("value")), lambda cells: F.transform(places, lambda p: F.when(p >= 0, F.get(cells, p))))[0]
    # Exploded, as a filter on a cell would be pushed below it and parse the record again.
    cells = F.explode(F.array(F.when(F.col("value").isNull(), F.array(*names)).otherwise(other))).alias("cells")
    return whole.select("_source_file", cells).select("_source_file", *[F.get("cells", F.lit(i)).alias(c) for i, c in enumerate(names)])
