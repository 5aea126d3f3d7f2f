"""Records of delimited text that may hold line breaks, cut by as many tasks as the files have splits.

A split does not know whether it begins inside quotes.  Each split first gives its transition: for either state at its
beginning, the state at its end.  A prefix scan over the transitions of a file, a row for each split, gives every split the state it
begins in.  Then the splits cut their records, and only the pieces at their borders, two a split at most, are put together by a
shuffle.  Spark's own text reader makes the splits, so compressed files are one split each.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from roadloom.session import materialize

_PIECE = "file long, start long, kind string, first boolean, record string, fields int"
_ARROW = pa.schema([("file", pa.int64()), ("start", pa.int64()), ("kind", pa.string()), ("first", pa.bool_()), ("record", pa.string()), ("fields", pa.int32())])


class Quotes:
    """The automaton of quoted fields: a quote opens where a field begins, two in a row are one of its characters, and after
    the closing one the rest goes up to the next separator."""

    def __init__(self, separator: str):
        s, inside = re.escape(separator), '(?:[^"]++|"")*+'
        field = f'(?:"{inside}"[^{s}]*+|[^"{s}][^{s}]*+|)'
        opened = f'(?:{field}{s})*+"{inside}'
        self._from_start, self._from_inside = re.compile(opened), re.compile(f'{inside}(?:"[^{s}]*+{s}{opened})?')
        self._field, self._end = re.compile(f'{field}{s}|"{inside}\\Z'), separator

    def open_after(self, line: str, is_open: bool) -> bool:
        """Whether a record goes on after the line."""
        return (self._from_inside if is_open else self._from_start).fullmatch(line) is not None

    def fields(self, record: str) -> int:
        return len(self._field.findall(record + self._end))


@lru_cache(maxsize=8)
def quotes(separator: str) -> Quotes:
    return Quotes(separator)


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines with the place of their split, and their order in it."""
    meta = F.col("_metadata")
    return spark.read.text(path, lineSep="\n").select(
        F.xxhash64(meta["file_path"]).alias("file"), meta["file_block_start"].alias("start"), F.monotonically_increasing_id().alias("at"), "value")


def _transitions(separator: str):
    """(file, start, from_closed, from_open) of every split; lines without a quote change nothing, and come as null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rule, place, ends = quotes(separator), None, [False, True]

        def row():
            return pa.RecordBatch.from_arrays([pa.array([place[0]], pa.int64()), pa.array([place[1]], pa.int64()), pa.array([ends[0]]), pa.array([ends[1]])],
                                              ["file", "start", "from_closed", "from_open"])

        for batch in batches:
            for some in _by_split(batch):
                here = some.column(0)[0].as_py(), some.column(1)[0].as_py()
                if here != place:
                    if place:
                        yield row()
                    place, ends = here, [False, True]
                for line in some.column(2).drop_null().to_pylist():
                    ends = [rule.open_after(line, state) for state in ends]
        if place:
            yield row()

    return run


def _by_split(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Stretches of rows of one split."""
    file, start = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
    cuts = ((file[1:] != file[:-1]) | (start[1:] != start[:-1])).nonzero()[0] + 1 if len(file) else []
    for lo, hi in zip([0, *cuts], [*cuts, len(file)], strict=True):
        if hi > lo:
            yield batch.slice(lo, hi - lo)


def _pieces(separator: str):
    """Records that begin and end in a split, and what reaches over its borders: ``head`` up to the end of a record that began
    before, ``through`` where that end is not in the split, ``tail`` from the beginning of a record that ends later."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rule, place, kind, held, first, rows = quotes(separator), None, "record", [], False, []

        def close(kind: str) -> None:
            text = "\n".join(held)
            if kind in ("record", "head"):
                text = text.removesuffix("\r")
            rows.append((*place, kind, first, text, rule.fields(text) if kind == "record" else None))

        def flushed() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True))
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW, strict=True)], schema=_ARROW)

        for batch in batches:
            for some in _by_split(batch):
                here = some.column(0)[0].as_py(), some.column(1)[0].as_py()
                if here != place:
                    if held:
                        close({"record": "tail", "head": "through"}[kind])
                    place, held, first = here, [], here[1] == 0
                    kind = "head" if some.column(3)[0].as_py() else "record"
                values = some.column(2)
                if kind == "record" and not held and not first and not pc.any(pc.match_substring(values, '"')).as_py():
                    # no quote far and wide: every line is a record
                    values = pc.replace_substring_regex(values, pattern="\r\\z", replacement="")
                    fields, n = pc.add(pc.count_substring(values, separator), 1).cast(pa.int32()), len(values)
                    yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array(["record"] * n), pa.array([False] * n), values, fields], schema=_ARROW)
                    continue
                for line in values.to_pylist():
                    is_open = bool(held) or kind == "head"
                    if '"' in line:
                        is_open = rule.open_after(line, is_open)
                    held.append(line)
                    if not is_open:
                        close(kind)
                        kind, held, first = "record", [], False
            if rows:
                yield flushed()
        if held:
            close({"record": "tail", "head": "through"}[kind])
        if rows:
            yield flushed()

    return run


def records(spark: SparkSession, path: str, separator: str) -> DataFrame:
    """(record, fields, first): every record of the files at ``path`` as text without its line end, the number of its fields, and
    whether it is the first of its file.

    The pieces are written to the shared folder once.  Quoted fields may hold line breaks.  A record that is still open where its file ends goes up to there.  Empty lines are
    records with an empty text; a folder without lines gives no row.
    """
    lines = _lines(spark, path)
    steps = lines.select("file", "start", F.when(F.contains("value", F.lit('"')), F.col("value")).alias("value")).mapInArrow(
        _transitions(separator), "file long, start long, from_closed boolean, from_open boolean")
    # The state at the beginning of a split: the last earlier split that ends alike from both states sets it, and every one after
    # that hands it on or turns it round.
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    sets = F.col("from_closed") == F.col("from_open")
    turns = F.sum((F.col("from_closed") & ~F.col("from_open")).cast("long")).over(Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, 0))
    steps = steps.withColumn("turns", turns)
    last = F.last(F.when(sets, F.struct(F.col("from_closed").alias("state"), F.col("turns").alias("turns"))), ignorenulls=True).over(before)
    turned = F.coalesce(F.last("turns").over(before), F.lit(0)) - F.coalesce(last["turns"], F.lit(0))
    state = F.coalesce(last["state"], F.lit(False)).cast("int")
    begins = steps.select("file", "start", ((state + turned) % 2 == 1).alias("is_open"))
    # The join leaves the rows of a split together; the sort restores their order whichever way Spark joins.
    cut = lines.join(begins, ["file", "start"]).sortWithinPartitions("file", "start", "at").select("file", "start", "value", "is_open")
    pieces = materialize(cut.mapInArrow(_pieces(separator), _PIECE), "records")
    whole = pieces.where("kind = 'record'").select("record", "fields", "first")
    return whole.unionByName(_joined(pieces, separator))


def _joined(pieces: DataFrame, separator: str) -> DataFrame:
    """The pieces at the borders, put together: a record begins at every tail."""
    upto = Window.partitionBy("file").orderBy("start", F.when(F.col("kind") == "tail", 1).otherwise(0)).rowsBetween(Window.unboundedPreceding, 0)
    parts = pieces.where("kind <> 'record'").withColumn("no", F.sum((F.col("kind") == "tail").cast("long")).over(upto))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("start", "kind", "record"))), lambda p: p["record"]), "\n")
    whole = parts.groupBy("file", "no").agg(F.max("first").alias("first"), text.alias("record"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rule = quotes(separator)
        for batch in batches:
            n = [rule.fields(r) for r in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int32()), batch.column(1)], ["record", "fields", "first"])

    return whole.select("record", "first").mapInArrow(run, "record string, fields int, first boolean")
