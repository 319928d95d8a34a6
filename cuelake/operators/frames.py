"""Picture subtitles: packets of .sup files, frames merged into events, reading order of detections."""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cuelake.operators import scan

ROW_HEIGHT, LAST_SECONDS = 12, 3.0


def packets(files: DataFrame) -> DataFrame:
    """(path, seq, pts, kind, payload) from (path, content). A wrong magic raises ValueError; a packet that
    the file cuts short ends it. Framing is sequential in a file, so files are what runs in parallel."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                raw, at, seq, rows = memoryview(content.as_buffer()) if content.is_valid else b"", 0, 0, []
                while at + 2 <= len(raw):
                    if bytes(raw[at : at + 2]) != b"PG":
                        raise ValueError(f"no packet at byte {at} of {path}")
                    if at + 13 > len(raw):
                        break
                    pts, _, kind, size = struct.unpack_from(">IIBH", raw, at + 2)
                    rows.append({"path": path, "seq": seq, "pts": pts / 90_000.0, "kind": kind, "payload": bytes(raw[at + 13 : at + 13 + size])})
                    at, seq = at + 13 + size, seq + 1
                yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("path", pa.string()), ("seq", pa.int64()), ("pts", pa.float64()), ("kind", pa.int32()), ("payload", pa.binary())]))

    return files.select("path", "content").mapInArrow(read, "path string, seq long, pts double, kind int, payload binary")


def _number(at: str, size: int):
    return F.conv(F.hex(F.expr(f"substring(payload, {at}, {size})")), 16, 10).cast("long")


def compositions(rows: DataFrame) -> DataFrame:
    """(path, seq, pts, width, height, palette_id, objects) of the composition packets (kind 0x16).

    Entries stand one after another, eight bytes each and eight more if bit 0x40 of their flag says that they
    are cropped; a payload that ends early ends the list. Packets of under 11 bytes have no row.
    """
    some = rows.where((F.col("kind") == 0x16) & (F.length("payload") >= 11)).withColumn("n", _number("11", 1).cast("int"))
    part = lambda at, size: F.conv(F.hex(F.substring(F.col("payload"), at, F.lit(size))), 16, 10).cast("long")
    none = F.array().cast("array<struct<object_id:bigint,x:bigint,y:bigint>>")

    def entry(state, _):
        at = state["at"]
        one = F.struct(part(at, 2).alias("object_id"), part(at + 4, 2).alias("x"), part(at + 6, 2).alias("y"))
        cropped = (part(at + 3, 1).bitwiseAND(0x40) != 0) & (at + 15 <= F.length("payload"))
        more = F.struct((at + F.when(cropped, 16).otherwise(8)).alias("at"), F.concat(state["objects"], F.array(one)).alias("objects"))
        return F.when(at + 7 <= F.length("payload"), more).otherwise(state)

    steps = F.when(F.col("n") > 0, F.sequence(F.lit(1), F.col("n"))).otherwise(F.array().cast("array<int>"))
    objects = F.aggregate(steps, F.struct(F.lit(12).alias("at"), none.alias("objects")), entry, lambda s: s["objects"])
    return some.select("path", "seq", "pts", _number("1", 2).alias("width"), _number("3", 2).alias("height"), _number("10", 1).alias("palette_id"), objects.alias("objects"))


def palettes(rows: DataFrame) -> DataFrame:
    """(path, seq, palette_id, entries) of the palette packets (kind 0x14) that hold any entry: a map from the
    entry's number to (y, cr, cb, alpha); a repeated number keeps its last entry."""
    some = rows.where((F.col("kind") == 0x14) & (F.length("payload") >= 7))
    part = lambda k, at: F.conv(F.hex(F.substring(F.col("payload"), F.lit(3) + k * 5 + at, F.lit(1))), 16, 10).cast("int")
    steps = F.sequence(F.lit(0), F.floor((F.length("payload") - 2) / 5).cast("int") - 1)
    last = F.filter(steps, lambda k: ~F.exists(steps, lambda later: (later > k) & (part(later, 0) == part(k, 0))))
    one = lambda k: F.struct(part(k, 0).alias("key"), F.struct(*[part(k, i + 1).alias(n) for i, n in enumerate(("y", "cr", "cb", "alpha"))]).alias("value"))
    return some.select("path", "seq", _number("1", 1).alias("palette_id"), F.map_from_entries(F.transform(last, one)).alias("entries"))


def object_parts(rows: DataFrame) -> DataFrame:
    """(path, object_id, version, seq, width, height, data): objects (kind 0x15) put together from their fragments.

    A fragment whose flag has bit 0x80 begins (object, version) anew with a head of length and size; others
    continue their version, or if it is not open the open version of that object that was opened last. Bit 0x40
    completes an object; seq is that of the fragment that does. What is never completed is no object. The
    fragments of one object id in one file are folded in order, the files and ids in parallel.
    """
    parts = rows.where((F.col("kind") == 0x15) & (F.length("payload") >= 4)).select("path", "seq", _number("1", 2).alias("object_id"), "payload")

    def fold(frame: pd.DataFrame) -> pd.DataFrame:
        pending: dict[int, tuple[int, int, list[bytes]]] = {}
        out = []
        for path, seq, number, payload in frame.sort_values("seq").itertuples(index=False):
            version, flag = payload[2], payload[3]
            if flag & 0x80:
                if len(payload) < 11:
                    continue
                # a version that is open stays in its place, as in any ordered table
                pending[version] = (int.from_bytes(payload[7:9], "big"), int.from_bytes(payload[9:11], "big"), [payload[11:]])
            elif version in pending:
                pending[version][2].append(payload[4:])
            elif pending:
                version = next(reversed(pending))
                pending[version][2].append(payload[4:])
            else:
                continue
            if flag & 0x40:
                width, height, data = pending.pop(version)
                out.append((path, number, version, seq, width, height, b"".join(data)))
        return pd.DataFrame(out, columns=["path", "object_id", "version", "seq", "width", "height", "data"])

    return parts.groupBy("path", "object_id").applyInPandas(fold, "path string, object_id long, version int, seq long, width int, height int, data binary")


def _as_of(asked: DataFrame, known: DataFrame, key: list[str], value: str) -> DataFrame:
    """asked (key, seq, ...) with ``value`` of the last row of known (key, seq, value) that stands before it."""
    both = asked.withColumn(value, F.lit(None).cast(known.schema[value].dataType)).unionByName(known.select(*key, "seq", value).withColumn("_known", F.lit(True)), allowMissingColumns=True)
    order = Window.partitionBy(*key).orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return both.withColumn(value, F.last(value, ignorenulls=True).over(order)).where("_known is null").drop("_known")


def display_sets(rows: DataFrame) -> DataFrame:
    """(path, seq, pts, width, height, palette_seq, objects) of packets: what each END (kind 0x80) shows.

    The composition is the last one since the END before (an END without one has no row; a composition too short
    to read is none); its palette is the last with its number, else the last of any number; each of its objects
    is the last complete one of its number, in order. palette_seq and an object's seq are null if there is none
    yet, so that (path, seq) joins ``palettes`` and ``object_parts``. pts is the composition's.
    """
    ends = rows.where(F.col("kind") == 0x80).select("path", "seq")
    told = compositions(rows).select("path", "seq", F.struct(F.col("seq").alias("comp_seq"), "pts", "width", "height", "palette_id", "objects").alias("comp"))
    short = rows.where((F.col("kind") == 0x16) & (F.length("payload") < 11)).select("path", "seq", F.lit(None).cast(told.schema["comp"].dataType).alias("comp"))
    marks = told.unionByName(short).withColumn("ended", F.lit(False)).unionByName(ends.withColumn("ended", F.lit(True)), allowMissingColumns=True)
    # what the packet before an END of these kinds says stands: an END behind an END has nothing to show
    order = Window.partitionBy("path").orderBy("seq")
    sets = marks.withColumn("comp", F.lag("comp").over(order)).where("ended and comp is not null").select("path", "seq", "comp.*")
    colours = palettes(rows).select("path", "seq", "palette_id", F.col("seq").alias("palette_seq"))
    sets = _as_of(sets, colours, ["path", "palette_id"], "palette_seq")
    sets = _as_of(sets, colours.withColumnRenamed("palette_seq", "any_seq"), ["path"], "any_seq").withColumn("palette_seq", F.coalesce("palette_seq", "any_seq")).drop("any_seq")
    shown = sets.select("path", "seq", F.posexplode("objects").alias("nth", "o")).select("path", "seq", "nth", "o.object_id", "o.x", "o.y")
    shown = _as_of(shown, object_parts(rows).select("path", "object_id", "seq", F.col("seq").alias("object_seq")), ["path", "object_id"], "object_seq")
    held = shown.groupBy("path", "seq").agg(F.array_sort(F.collect_list(F.struct("nth", "object_id", "x", "y", "object_seq"))).alias("o"))
    held = held.select("path", "seq", F.transform("o", lambda o: F.struct(o["object_id"].alias("object_id"), o["x"].alias("x"), o["y"].alias("y"), o["object_seq"].alias("seq"))).alias("objects"))
    none = F.array().cast(held.schema["objects"].dataType)
    return sets.drop("objects").join(held, ["path", "seq"], "left").select("path", "seq", "pts", "width", "height", "palette_seq", F.coalesce("objects", none).alias("objects"))


def _merge_in_blocks(rows: DataFrame, limit: int, store: Callable[[DataFrame, str], DataFrame], block: int) -> DataFrame:
    """The events of frames (track_id, seq, pts, image_hash), each step by blocks of ``block`` frames."""
    key, rows = ["track_id"], store(rows, "frames")
    told = scan.before(rows, key, "seq", {"_hash": ("last", F.col("image_hash")), "_some": ("max", F.lit(1))}, block)
    runs = store(told.where(F.col("_some").isNull() | ~F.col("image_hash").eqNullSafe(F.col("_hash"))).drop("_hash", "_some"), "frame-runs")
    runs = scan.before(runs, key, "seq", {"end": ("last", F.col("pts"))}, block, backwards=True).where("image_hash is not null")
    if limit:
        runs = scan.number(store(runs, "frame-events"), key, "seq", block).where(F.col("number") < limit)
        runs = runs.withColumn("end", F.when(F.col("number") < limit - 1, F.col("end"))).drop("number")
    runs = runs.withColumn("end", F.coalesce("end", F.col("pts") + LAST_SECONDS)).where("end > pts")
    return scan.number(store(runs, "frame-ends"), key, "seq", block).select("track_id", F.col("number").alias("event_no"), F.col("pts").alias("start"), "end", "image_hash")


def merge_frames(frames: DataFrame, limit: int = 0, store: Callable[[DataFrame, str], DataFrame] | None = None, block: int = scan.BLOCK) -> DataFrame:
    """(track_id, event_no, start, end, image_hash) from frames (track_id, seq, pts, is_empty, image_hash).

    Equal pictures in a row are one event, which the next picture or an empty frame ends; the last lasts
    LAST_SECONDS. Events without length are dropped. ``limit`` (0: none) stops a track when that many events
    have begun: the one that stops it is its last, and so lasts LAST_SECONDS. With ``store`` (which writes rows
    under a name and gives them back) long tracks are cut into blocks of ``block`` frames.
    """
    order = Window.partitionBy("track_id").orderBy("seq")
    shown = F.when(~F.col("is_empty"), F.col("image_hash"))
    rows = frames.select("track_id", "seq", "pts", shown.alias("image_hash"))
    if store is not None:
        return _merge_in_blocks(rows, limit, store, block)
    fresh = F.row_number().over(order) == 1
    rows = rows.withColumn("_new", fresh | ~F.col("image_hash").eqNullSafe(F.lag("image_hash").over(order)))
    runs = rows.where("_new").withColumn("end", F.lead("pts").over(order)).where("image_hash is not null")
    last = F.col("end").isNull()
    if limit:
        runs = runs.withColumn("_begun", F.row_number().over(order)).where(F.col("_begun") <= limit)
        last = last | (F.col("_begun") == limit)
    runs = runs.withColumn("end", F.when(last, F.col("pts") + LAST_SECONDS).otherwise(F.col("end"))).where("end > pts")
    runs = runs.withColumn("event_no", (F.row_number().over(order) - 1).cast("long"))
    return runs.select("track_id", "event_no", F.col("pts").alias("start"), "end", "image_hash")


def reading_order(lines: DataFrame, language: str = "en") -> DataFrame:
    """(frame_id, text): a frame's detections by rows of ROW_HEIGHT, then x; no space between in Chinese."""
    rows = F.array_sort(F.collect_list(F.struct(F.rint(F.col("y") / ROW_HEIGHT).alias("row"), "x", "seq", "text")))
    glue = "" if language in ("ch", "chinese_cht") else " "
    return lines.groupBy("frame_id").agg(F.trim(F.array_join(F.transform(rows, lambda r: r["text"]), glue)).alias("text"))


def ocr_cues(events: DataFrame, texts: DataFrame) -> DataFrame:
    """(title_id, pos, start, end, text) of events (track_id, event_no, start, end) and their texts
    (frame_id = track_id/event_no); events without text are dropped."""
    frame = F.concat_ws("/", "track_id", F.col("event_no").cast("string"))
    rows = events.withColumn("frame_id", frame).join(texts, "frame_id").where("text <> ''")
    order = Window.partitionBy("track_id").orderBy("event_no")
    return rows.select(F.col("track_id").alias("title_id"), (F.row_number().over(order) - 1).cast("long").alias("pos"), "start", "end", "text")
