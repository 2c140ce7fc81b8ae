"""Large CSV files with quoted newlines, read by many tasks.

A file is read line by line in the scan's own splits, which are fixed when the
frame is made.  Splits far smaller than a task is worth are read several to a
task; those that follow one another in a file and in a task are one stretch.
Whether a line begins inside a quoted field hangs on all lines before it, so:

1.  each stretch is summed up by two answers: is it inside quotes at its end if
    it began outside, and if it began inside;
2.  chaining these answers over the stretches of a file, in order, tells how
    each really begins, and where the record began that is open there;
3.  every stretch then cuts its lines into records.  What it holds of a record
    that began in an earlier one, or that goes on in a later one, was stored in
    the first scan, for either way to begin, and is stitched together, in
    order; a further scan cuts out what was too long for that.

Lines are looked at in whole Arrow batches, not one by one.  Records are parsed
by Spark's own CSV parser.  The rules by which a quote
opens or closes a field are those of that parser: a quote opens one only as
the first character of a field, a doubled one stays inside, and after a closing
one anything but blanks makes the rest of the field plain text.  In a file
whose lines end in a carriage return and a newline, a lone newline in a field
that never had a quote ends the record here; the one-task read takes it as text.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from watchpost.session import scratch_dir, ship_package

#: A field that begins with a quote, and what ends it; without its closing quote it leaves the line open.
_FIELD = re.compile(r'"(?:[^"]|"")*"(?!")[^,]*(?:,|\Z)', re.S)
#: From inside a quoted field to the end of the field.
_CLOSE = re.compile(r'(?:[^"]|"")*"(?!")[^,]*(?:,|\Z)', re.S)
#: The same for Arrow, which knows no lookahead: a line all of whose fields are closed, if it begins outside or inside of one.
_ANY = r'(?:[^",][^,]*|"(?:[^"]|"")*"(?:[^",][^,]*)?)?'
_CLOSED = rf'\A{_ANY}(?:,{_ANY})*\z'
_CLOSED_INSIDE = rf'\A(?:[^"]|"")*"(?:[^",][^,]*)?(?:,{_ANY})*\z'
#: Bytes that are worth a task, and tasks for each core before smaller splits share one.
_TASK_BYTES = 16 << 20
_TASKS_PER_CORE = 4
#: What may lie across the borders of a stretch: the end of a record that an earlier one began, and the
#: beginning of one that a later one ends, if the stretch begins outside of quotes or inside.
_HEAD, _TAIL, _TAIL_INSIDE = 1, 2, 3
_FOUND = "at long, kind int, outside boolean, inside boolean, closes boolean, text binary"
_FOUND_NAMES = ["at", "kind", "outside", "inside", "closes", "text"]
_FOUND_TYPES = (pa.int64(), pa.int32(), pa.bool_(), pa.bool_(), pa.bool_(), pa.binary())
_PIECE = "file long, origin long, at long, last boolean, value binary"
_PIECE_NAMES = ["file", "origin", "at", "last", "value"]
#: Longer texts at borders are not stored but cut out of the file in a further scan.
_PIECE_BYTES = 1 << 20
_BAD = "_bad_record"
#: A record is parsed alone, so nothing in it ends a line; this character stands in no text.
_NO_LINE_END = "\uffff"
#: A file's name is far longer than most lines, so files have numbers that lie further apart than they are
#: long; to such a number a place in the file is added, which makes an address.
_FILE_ID = "shiftrightunsigned(xxhash64(_metadata.file_path, {seed}), 2)"


def stays_open(line: str, inside: bool) -> bool:
    """Whether a quoted field is open at the end of a line that begins outside or inside of one."""
    if '"' not in line:
        return inside
    at, end = 0, len(line)
    if inside:
        close = _CLOSE.match(line)
        if close is None:
            return True
        at = close.end()
    while at < end:
        if line[at] != '"':
            # Plain fields up to the next that begins with a quote.
            at = line.find(',"', at) + 1
            if at == 0:
                return False
        field = _FIELD.match(line, at)
        if field is None:
            return True
        at = field.end()
    return False


def _files(spark: SparkSession, files: list[str]) -> tuple[str, dict[int, str]]:
    """What gives a file's number, and the files by it; what they hold is not read."""
    listed = spark.read.format("binaryFile").load(files)
    for seed in range(42, 52):
        number = _FILE_ID.format(seed=seed)
        rows = listed.selectExpr(f"{number} AS id", "_metadata.file_path AS file", "_metadata.file_size AS size").collect()
        found = sorted((r["id"], r["size"], r["file"]) for r in rows)
        if all(a[0] + a[1] < b[0] for a, b in zip(found, found[1:])):
            return number, {id: file for id, _, file in found}
    raise RuntimeError("the files' numbers lie too close together")


def _lines(spark: SparkSession, files: list[str], separator: str, number: str) -> tuple[DataFrame, int]:
    """(number of the file, address of the split, line), and how far the next split of a file lies, 0 where not known.

    A plain newline ends a line also where others end in a carriage return.
    Splits, and which of them share a task, stay as they are now: what is found
    of a stretch holds in later scans, whatever the session's settings are then.
    """
    value = F.col("value")
    if separator == "\r\n":
        value = F.when(F.endswith(value, F.lit("\r")), F.left(value, F.length(value) - 1)).otherwise(value)
    text = spark.read.option("lineSep", "\n").text(files).select(
        F.expr(number).alias("file"), F.expr(f"{number} + _metadata.file_block_start").alias("at"), value.alias("value")
    )
    jvm, plan = spark.sparkContext._jvm, text._jdf.queryExecution()
    size, cost = (
        jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(f"spark.sql.files.{key}"))
        for key in ("maxPartitionBytes", "openCostInBytes")
    )
    rows = plan.toRdd().toJavaRDD()
    splits = rows.getNumPartitions()
    tasks = max(_TASKS_PER_CORE * spark.sparkContext.defaultParallelism, -(-splits * size // _TASK_BYTES))
    if tasks < splits:
        rows = rows.coalesce(tasks)
    frame = spark._jsparkSession.internalCreateDataFrame(rows.rdd(), plan.analyzed().schema(), False)
    # Spark takes less than the most a split may have only down to the cost of opening a file.
    return DataFrame(frame, spark), size if cost >= size else 0


def _stretches(batches: Iterator[pa.RecordBatch], step: int) -> Iterator[tuple[int, bool, pa.Array]]:
    """(address of a stretch, whether it begins here, lines), in order; a stretch may come in several parts."""
    now = stretch = None
    for batch in batches:
        if not batch.num_rows:
            continue
        at, value = batch.column(0).to_numpy(), batch.column(1)
        # Bytes, as a line need not be valid text.
        value = value.view(pa.large_binary() if pa.types.is_large_string(value.type) else pa.binary())
        cuts = np.flatnonzero(at[1:] != at[:-1]) + 1
        begin, new = 0, False
        for cut in [0, *cuts.tolist()]:
            split = int(at[cut])
            if split == now:
                continue
            if now is None or not step or split != now + step:
                if cut > begin:
                    yield stretch, new, value.slice(begin, cut - begin)
                begin, new, stretch = cut, True, split
            now = split
        yield stretch, new, value.slice(begin)


def _open_after(lines: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Of each line, ``stays_open`` if it begins outside, and inside, of a quoted field."""
    quoted = pc.match_substring(lines, '"').to_numpy(zero_copy_only=False)
    some = lines if quoted.all() else lines.filter(pa.array(quoted))
    outside, inside = np.zeros(len(lines), bool), np.ones(len(lines), bool)
    for answer, closed in ((outside, _CLOSED), (inside, _CLOSED_INSIDE)):
        answer[quoted] = ~pc.match_substring_regex(some, closed).to_numpy(zero_copy_only=False)
    return outside, inside


def _along(outside: np.ndarray, inside: np.ndarray, begins: bool) -> np.ndarray:
    """Whether each line ends inside quotes, one after the other, if the first begins so."""
    # A line whose two answers agree forgets what was before it; else it keeps or turns the state.
    turned = np.cumsum(outside & ~inside)
    last = np.maximum.accumulate(np.where(outside == inside, np.arange(len(outside)), -1))
    settled = last >= 0
    state = np.where(settled, outside[last], begins)
    return state ^ ((turned - np.where(settled, turned[last], 0)) % 2 == 1)


def _summed_up(batches: Iterator[pa.RecordBatch], step: int, first: frozenset[int]) -> Iterator[pa.RecordBatch]:
    """Of each stretch a row (address, 0, outside, inside, closes): is it open at its end if it
    began outside, or inside, of quotes, and does a line of it end outside if it began inside.

    Then a row each with the text of what may lie across its borders, by kind
    (_HEAD, _TAIL, _TAIL_INSIDE); a longer text than a piece may have is null.
    ``first`` are the stretches with which files begin.
    """
    key, now, closes, named, head, tails = None, [False, True], False, False, [], [[], []]

    def longer(held: list[pa.Array] | None, lines: pa.Array) -> list[pa.Array] | None:
        if held is None or sum(x.nbytes for x in held) + lines.nbytes > _PIECE_BYTES:
            return None
        return [*held, lines]

    def rows() -> Iterator[pa.RecordBatch]:
        if key is None:
            return
        later = key not in first  # the first of a file begins outside
        out = [(0, None)]
        if later:
            out.append((_HEAD, head))
        if now[0] and (later or named):
            out.append((_TAIL, tails[0]))
        if later and now[1] and closes:
            out.append((_TAIL_INSIDE, tails[1]))
        texts = [None if held is None else _text(held) for _, held in out]
        n = len(out)
        columns = [[key] * n, [kind for kind, _ in out], [now[0]] * n, [now[1]] * n, [closes] * n, texts]
        yield pa.RecordBatch.from_arrays(
            [pa.array(x, kind) for x, kind in zip(columns, _FOUND_TYPES, strict=True)], _FOUND_NAMES
        )

    for stretch, new, lines in _stretches(batches, step):
        if new:
            yield from rows()
            key, now, closes, named, head, tails = stretch, [False, True], False, False, [], [[], []]
        answers, states, before = _open_after(lines), None, tuple(now)
        for began in ((False,) if key in first else (False, True)):
            if states is None or before[0] != before[1]:
                states = _along(*answers, before[began])
                ends = np.flatnonzero(~states) + 1
            now[began] = bool(states[-1])
            if began and not closes:
                head = longer(head, lines.slice(0, ends[0]) if len(ends) else lines)
                closes = len(ends) > 0
            if not len(ends):
                tails[began] = longer(tails[began], lines)
                continue
            tails[began] = longer([], lines.slice(ends[-1]))
            # The first record that is not blank holds the names.
            named = named or began or bool(pc.any(pc.greater(pc.binary_length(lines.slice(0, ends[-1])), 0)).as_py())
    yield from rows()


class _Borders:
    """How stretches begin: outside of quotes but where the one before in the file ends inside."""

    def __init__(self, first: list[int], found: list[tuple[int, bool, bool, bool]]) -> None:
        #: Addresses with which files begin, in order.
        self.first = first
        #: Addresses of stretches in order, whether each ends inside quotes, and of that in which the open record began.
        self.starts: list[int] = []
        self.ends: list[bool] = []
        self.origins: list[int] = []
        #: Records, by their first stretch, whose last field is never closed and holds the last line end of the file.
        self.unclosed: set[int] = set()
        #: Files with texts across borders that are too long to be stored.
        self.long: set[int] = set()
        files = set(first)
        for at, outside, inside, closes in sorted(found):
            begins = at not in files and self.ends[-1]
            self.origins.append(self.origins[-1] if begins and not closes else at)
            self.ends.append(inside if begins else outside)
            self.starts.append(at)

    def file(self, at: int) -> int:
        return self.first[bisect_right(self.first, at) - 1]

    def before(self, at: int) -> tuple[bool, int]:
        """Whether a stretch begins inside quotes, and in which the record open there began, itself if none is."""
        i = bisect_left(self.starts, at) - 1
        inside = i >= 0 and self.ends[i] and self.starts[i] >= self.file(at)
        return inside, self.origins[i] if inside else at

    def left_open(self) -> dict[int, int]:
        """The files that end inside quotes, and where the record open there began."""
        ends = dict(zip(map(self.file, self.starts), zip(self.ends, self.origins)))
        return {file: origin for file, (inside, origin) in ends.items() if inside}


def _needed(borders: _Borders, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the texts at the borders of stretches, those that are there as the stretches really begin, as pieces."""
    for batch in batches:
        out: list[list] = [[], [], [], [], []]
        for at, kind, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            inside, origin = borders.before(at)
            if inside != (kind != _TAIL):
                continue
            origin = origin if kind == _HEAD else at
            for column, x in zip(out, (borders.file(at), origin, at, origin in borders.unclosed, text), strict=True):
                column.append(x)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(out, kinds, strict=True)], _PIECE_NAMES)


def _borders(spark: SparkSession, names: dict[int, str], lines: DataFrame, step: int) -> tuple[_Borders, DataFrame]:
    """How stretches begin, and the texts at their borders, which are stored."""
    path, first = scratch_dir(spark, "watchpost-io/borders"), frozenset(names)
    lines.mapInArrow(lambda batches: _summed_up(batches, step, first), _FOUND).write.parquet(path)
    found = spark.read.schema(_FOUND).parquet(path)
    rows = found.where("text IS NULL").drop("text").collect()
    out = _Borders(sorted(names), [(r["at"], r["outside"], r["inside"], r["closes"]) for r in rows if r["kind"] == 0])
    out.unclosed = {origin for file, origin in out.left_open().items() if _ends_line(spark, names[file])}
    out.long = {out.file(r["at"]) for r in rows if r["kind"] and out.before(r["at"])[0] == (r["kind"] != _TAIL)}
    return out, found.where("kind > 0").select("at", "kind", "text")


def _ends_line(spark: SparkSession, file: str) -> bool:
    """Whether the last byte of a file ends a line."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(file))
    fs = at.getFileSystem(conf)
    stream = fs.open(at)
    try:
        stream.seek(max(0, fs.getFileStatus(at).getLen() - 1))
        return bytes(stream.readNBytes(1)) == b"\n"
    finally:
        stream.close()


def _joined(lines: pa.Array, offsets: np.ndarray) -> pa.Array:
    """Lines from each offset to the next, joined to one text."""
    if len(offsets) == len(lines) + 1:
        return lines
    lists = pa.LargeListArray if pa.types.is_large_binary(lines.type) else pa.ListArray
    kind = pa.int64() if lists is pa.LargeListArray else pa.int32()
    return pc.binary_join(lists.from_arrays(pa.array(offsets, kind), lines), b"\n")


def _text(parts: list[pa.Array]) -> bytes:
    lines = pa.concat_arrays(parts)
    return _joined(lines, np.array([0, len(lines)]))[0].as_py()


def _texts(values: pa.Array) -> pa.Array:
    return values.view(pa.large_string() if pa.types.is_large_binary(values.type) else pa.string())


def _records(borders, step: int, whole: bool):
    """Cuts lines into records: the whole ones, or else what lies across the borders of stretches.

    Whole records have one column; pieces are (file, origin, address, last, value),
    ``origin`` the address of the stretch in which the record began.  ``borders``
    is a broadcast of how stretches begin.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, head, header, inside, origin = None, [], False, False, False, 0

        def piece(parts: list[pa.Array]) -> pa.RecordBatch:
            row = (borders.value.file(key), origin, key, origin in borders.value.unclosed, _text(parts))
            return pa.RecordBatch.from_arrays([pa.array([x]) for x in row], _PIECE_NAMES)

        for stretch, new, lines in _stretches(batches, step):
            if new:
                if held and not whole and not header:
                    yield piece(held)
                key, held = stretch, []
                inside, origin = borders.value.before(key)
                head = inside  # still in a record of an earlier stretch
                header = key == borders.value.file(key)  # the first record of a file holds the names
            states = _along(*_open_after(lines), inside)
            inside = bool(states[-1])
            ends = np.flatnonzero(~states) + 1
            if not len(ends):
                held.append(lines)
                continue
            if not (whole or head or header):
                held = [lines.slice(ends[-1])] if inside else []
                continue
            before, rest = sum(map(len, held)), lines.slice(ends[-1])
            lines = pa.concat_arrays([*held, lines.slice(0, ends[-1])]) if held else lines.slice(0, ends[-1])
            held = [rest] if inside else []
            offsets = np.concatenate([[0], ends + before])
            if head:
                if not whole:
                    yield piece([lines.slice(0, offsets[1])])
                lines, offsets = lines.slice(offsets[1]), offsets[1:] - offsets[1]
                head, origin = False, key
            found = _joined(lines, offsets) if whole or header else None
            if header:
                filled = np.flatnonzero(pc.binary_length(found).to_numpy(zero_copy_only=False))
                header = not len(filled)  # blank lines before the header are none
                found = found.slice(len(found) if header else filled[0] + 1)
            if whole and len(found):
                yield pa.RecordBatch.from_arrays([_texts(found)], ["value"])
        if held and not whole and not header:
            yield piece(held)

    return run


def read(spark: SparkSession, files: list[str], schema: StructType, separator: str, options: dict[str, str]) -> DataFrame:
    """Rows of CSV files with one header, as text columns; malformed rows are dropped.

    ``separator`` ends lines (the parser takes the first one it meets for all);
    inside quotes it becomes a plain newline, as in that parser.  ``options``
    are those of the CSV parser.
    """
    ship_package(spark)
    number, names = _files(spark, files)
    every, step = _lines(spark, files, separator, number)
    lines = every.select("at", "value")
    borders, found = _borders(spark, names, lines, step)
    known = spark.sparkContext.broadcast(borders)
    records = lines.mapInArrow(_records(known, step, True), "value string")
    if any(borders.ends):
        pieces = found.mapInArrow(lambda batches: _needed(known.value, batches), _PIECE)
        if borders.long:
            again = F.col("file").isin(sorted(borders.long))
            lines = every.where(again).select("at", "value")
            pieces = pieces.where(~again).union(lines.mapInArrow(_records(known, step, False), _PIECE))
        pieces = pieces.withColumn("value", F.col("value").cast("string"))
        joined = pieces.groupBy("origin").agg(
            F.array_sort(F.collect_list(F.struct("at", "value"))).alias("parts"), F.bool_or("last").alias("last")
        )
        # What ends a header that goes over a border has no beginning here.
        joined = joined.where(F.col("parts")[0]["at"] == F.col("origin"))
        text = F.array_join(F.transform("parts", lambda p: p["value"]), "\n")
        # Only a field that is never closed reaches the end of a file; its last line end is part of it.
        records = records.union(joined.select(F.concat(text, F.when(F.col("last"), "\n").otherwise("")).alias("value")))
    bad = _BAD
    while bad in schema.names:
        bad += "_"
    wide = StructType([*schema.fields, StructField(bad, StringType())])
    row = F.from_csv("value", _ddl(wide), {
        **options, "lineSep": _NO_LINE_END, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": bad,
    })
    # As a generator each record is parsed once, not for every column and the filter.
    parsed = records.where("value <> ''").select(F.inline(F.array(row)))
    good = parsed.where(F.col(f"`{bad}`").isNull())
    return good.select(*[F.col(f"`{name.replace('`', '``')}`") for name in schema.names])


def _ddl(schema: StructType) -> str:
    return ", ".join(f"`{f.name.replace('`', '``')}` string" for f in schema.fields)
