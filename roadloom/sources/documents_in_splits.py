"""Feature collections of any layout, cut into their features by as many tasks as the files have splits.

Spark's text reader cuts at opening braces instead of line ends, so that a document without line breaks has splits as well.  What a
split needs to know is whether it begins inside a string, and how many brackets are open there.  Each split gives, for either answer to the
first question, the answer at its end and the brackets it leaves open; a prefix scan over a file's splits, a row for each, settles both.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from roadloom.session import materialize

_PIECE = "file long, start long, seq long, kind string, text string"
_ARROW = pa.schema([("file", pa.int64()), ("start", pa.int64()), ("seq", pa.int64()), ("kind", pa.string()), ("text", pa.string())])
#: A whole string, or one that is open at the end; and what is left of a string that began before.
_STRING = re.compile(r'"(?:[^"\\]++|\\.)*+("?)', re.DOTALL)
_REST = re.compile(r'(?:[^"\\]++|\\.)*+("?)', re.DOTALL)
#: A feature is an object in an array of the document's object.
_MEMBER = 2
_OPENS, _CLOSES, _QUOTE, _ESCAPE = b"{}\"\\"
#: The least a task is to read.
_TASK_BYTES = 2 << 20
#: Of files of features: a task reads whole row groups, and a feature is much work.
SMALL_GROUPS = {"parquet.block.size": 8 << 20}
#: What a byte does to the number of open brackets.
_SIGN = np.zeros(256, np.int8)
_SIGN[list(b"{[")], _SIGN[list(b"}]")] = 1, -1


def without_strings(text: str, in_string: bool) -> tuple[str, bool]:
    """The text with its strings blanked out, as long as before, and whether it ends inside one."""
    out, at = [], 0
    if in_string:
        rest = _REST.match(text)
        if not rest[1]:
            return " " * len(text), True
        at = rest.end()
        out.append(" " * at)
    for found in _STRING.finditer(text, at):
        out += [text[at : found.start()], " " * (found.end() - found.start())]
        at = found.end()
        if not found[1]:
            return "".join(out), True
    out.append(text[at:])
    return "".join(out), False


def brackets(raw: bytes, in_string: bool) -> tuple[np.ndarray, np.ndarray, bool]:
    """Places of the brackets outside of strings, 1 or -1 for each, and whether the text ends inside a string."""
    text = np.frombuffer(raw, np.uint8)
    quotes, escapes = np.flatnonzero(text == _QUOTE), np.flatnonzero(text == _ESCAPE)
    if len(escapes):
        first = np.flatnonzero(np.diff(escapes, prepend=-2) > 1)
        runs = np.diff(np.append(first, len(escapes)))
        quotes = np.setdiff1d(quotes, (escapes[first] + runs)[runs % 2 == 1], assume_unique=True)
        if ((np.searchsorted(quotes, escapes) + in_string) % 2 == 0).any():      # outside of strings it escapes nothing
            plain, after = without_strings(raw.decode("latin-1"), in_string)
            text = np.frombuffer(plain.encode("latin-1"), np.uint8)
            at = np.flatnonzero(_SIGN[text])
            return at, _SIGN[text[at]], after
    at = np.flatnonzero(_SIGN[text])
    at = at[(np.searchsorted(quotes, at) + in_string) % 2 == 0]
    return at, _SIGN[text[at]], (len(quotes) + in_string) % 2 == 1


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int], pa.Array, list]]:
    """((file, start), texts, values of the other columns) of rows that belong to one split and follow each other."""
    for batch in batches:
        if not batch.num_rows:
            continue
        files, starts = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        cuts = (np.flatnonzero((np.diff(files) != 0) | (np.diff(starts) != 0)) + 1).tolist()
        for lo, hi in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
            yield (int(files[lo]), int(starts[lo])), batch.column(2).slice(lo, hi - lo), [c[lo].as_py() for c in batch.columns[3:]]


def _braced(texts: pa.Array, braced: bool) -> bytes:
    """The text of rows that the reader has cut at opening braces; ``braced``: with the one before the first."""
    texts = pa.ListArray.from_arrays(pa.array([0, len(texts)], pa.int32()), texts.cast(pa.binary()))
    return b"{" * braced + pc.binary_join(texts, b"{")[0].as_py()


def _transitions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, start, string_0, string_1, depth_0, depth_1) of every split: what it makes of beginning outside and inside a string."""
    place, ends = None, None

    def row():
        (s0, d0), (s1, d1) = ends
        return pa.RecordBatch.from_pylist([{"file": place[0], "start": place[1], "string_0": s0, "string_1": s1, "depth_0": d0, "depth_1": d1}],
                                          schema=pa.schema([("file", pa.int64()), ("start", pa.int64()), ("string_0", pa.bool_()), ("string_1", pa.bool_()), ("depth_0", pa.int64()), ("depth_1", pa.int64())]))

    for here, texts, _ in _stretches(batches):
        braced = True
        if here != place:
            if place:
                yield row()
            place, ends, braced = here, [(False, 0), (True, 0)], here[1] > 0     # a file does not begin with the brace before it
        raw = _braced(texts, braced)
        done = {inside: brackets(raw, inside) for inside in {inside for inside, _ in ends}}
        ends = [(done[inside][2], depth + int(done[inside][1].sum(dtype=np.int64))) for inside, depth in ends]
    if place:
        yield row()


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What each split holds of the features, and of the text around them.

    ``member``: a whole object; ``tail``: one from its beginning to the end of the split; ``head``: the end of one that began before;
    ``through``: a split within one object; ``around``: text outside, but for commas and white space.
    """
    place, seq, held, inside, depth, open_kind, rows = None, 0, [], False, 0, None, []

    def close(kind: str) -> None:
        nonlocal held, seq
        text = b"".join(held).decode()
        held = []
        if kind != "around" or text.strip(" ,\t\r\n"):
            rows.append((*place, seq, kind, text))
            seq += 1

    def end_of_split() -> None:
        if place:
            close({"member": "tail", "head": "through"}.get(open_kind, "around"))

    def flushed() -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True))
        rows.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW, strict=True)], schema=_ARROW)

    for here, texts, begins in _stretches(batches):
        braced = True
        if here != place:
            end_of_split()
            place, seq, held, (inside, depth), braced = here, 0, [], begins, here[1] > 0
            open_kind = "head" if depth > _MEMBER else None
        raw = _braced(texts, braced)
        places, signs, inside = brackets(raw, inside)
        depths_after = depth + np.cumsum(signs, dtype=np.int64)
        depth, at = int(depths_after[-1]) if len(signs) else depth, 0
        kinds = np.frombuffer(raw, np.uint8)[places]
        ends = ((kinds == _OPENS) & (depths_after == _MEMBER + 1)) | ((kinds == _CLOSES) & (depths_after == _MEMBER))
        for p, opens in zip(places[ends].tolist(), (kinds[ends] == _OPENS).tolist(), strict=True):
            if opens:
                held.append(raw[at:p])
                close("around")
                open_kind, at = "member", p
            elif open_kind:
                held.append(raw[at : p + 1])
                close(open_kind)
                open_kind, at = None, p + 1
        held.append(raw[at:])
        if rows:
            yield flushed()
    end_of_split()
    if rows:
        yield flushed()


def in_larger_tasks(rows: DataFrame) -> DataFrame:
    """Small splits of a scan, some to a task: to begin a task, with Python above all, costs more than a small split itself."""
    spark = rows.sparkSession
    number, unit = re.fullmatch(r"(\d+)([kmgtp]?)b?", spark.conf.get("spark.sql.files.maxPartitionBytes").strip().lower()).groups()
    size, splits = int(number) << 10 * " kmgtp".index(unit or " "), rows.rdd.getNumPartitions()
    tasks = max(-(-splits * size // _TASK_BYTES), 4 * spark.sparkContext.defaultParallelism)
    return rows.coalesce(tasks) if tasks < splits else rows


def _braces(spark: SparkSession, path: str) -> DataFrame:
    """What stands between opening braces, with the place of its split and the order in it."""
    meta = F.col("_metadata")
    return in_larger_tasks(spark.read.text(path, lineSep="{").select(
        F.xxhash64(meta["file_path"]).alias("file"), meta["file_block_start"].alias("start"), F.monotonically_increasing_id().alias("at"), "value"))


def members(spark: SparkSession, path: str, files: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(file, text) of every object in an array of a document's object, and (file, text) of what is around them, an object without
    those members.

    ``file`` is a hash of the path; ``files`` (file) chooses some.  The pieces are written to the shared folder once.
    """
    chunks = _braces(spark, path)
    if files is not None:
        chunks = chunks.join(files, "file", "left_semi")
    steps = chunks.sortWithinPartitions("file", "start", "at").select("file", "start", "value").mapInArrow(
        _transitions, "file long, start long, string_0 boolean, string_1 boolean, depth_0 long, depth_1 long")
    steps = materialize(steps.hint("rebalance"), "transitions")     # a split gives one row, which need not be a file
    by_place = Window.partitionBy("file").orderBy("start")
    before, upto = by_place.rowsBetween(Window.unboundedPreceding, -1), by_place.rowsBetween(Window.unboundedPreceding, 0)
    # The last split that ends alike from both states settles the state after it; later ones hand it on or turn it round.
    steps = steps.withColumn("turns", F.sum((F.col("string_0") & ~F.col("string_1")).cast("long")).over(upto))
    last = F.last(F.when(F.col("string_0") == F.col("string_1"), F.struct(F.col("string_0").alias("state"), "turns")), ignorenulls=True).over(before)
    turned = F.coalesce(F.last("turns").over(before), F.lit(0)) - F.coalesce(last["turns"], F.lit(0))
    steps = steps.withColumn("in_string", (F.coalesce(last["state"], F.lit(False)).cast("int") + turned) % 2 == 1)
    opened = F.when(F.col("in_string"), F.col("depth_1")).otherwise(F.col("depth_0"))
    begins = steps.withColumn("opened", opened).select("file", "start", "in_string", F.coalesce(F.sum("opened").over(before), F.lit(0)).alias("depth"))
    cut = chunks.join(begins, ["file", "start"]).sortWithinPartitions("file", "start", "at").select("file", "start", "value", "in_string", "depth")
    pieces = in_larger_tasks(materialize(cut.mapInArrow(_pieces, _PIECE).hint("rebalance"), "members", **SMALL_GROUPS))
    return _joined(pieces), _around(pieces)


def _joined(pieces: DataFrame) -> DataFrame:
    """Members within a split, and those that reach over its borders put together: one begins at every tail."""
    upto = Window.partitionBy("file").orderBy("start", "seq").rowsBetween(Window.unboundedPreceding, 0)
    parts = pieces.where("kind IN ('head', 'through', 'tail')").withColumn("no", F.sum((F.col("kind") == "tail").cast("long")).over(upto))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("start", "seq", "text"))), lambda p: p["text"]), "")
    return pieces.where("kind = 'member'").select("file", "text").unionByName(parts.groupBy("file", "no").agg(text.alias("text")).select("file", "text"))


def _around(pieces: DataFrame) -> DataFrame:
    rows = pieces.where("kind = 'around'").groupBy("file").agg(F.sort_array(F.collect_list(F.struct("start", "seq", "text"))).alias("p"))
    return rows.select("file", F.array_join(F.transform("p", lambda p: p["text"]), "").alias("text"))
