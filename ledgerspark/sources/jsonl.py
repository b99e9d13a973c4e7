"""Append-only JSONL logs as a Spark data source, in batches and as a tail that follows appends.

Spark's own text reader knows no byte positions and its file stream sees new files only, so a Python
data source yields ``path, generation, byte_start, byte_end, ordinal, digest, raw, error, span``.  Files
are cut at multiples of ``rangeBytes``, and a range is a task: a line belongs to the range in which it ends, so
every task finds its first line by itself.  ``ordinal`` numbers the records of a range, which begins at ``span``; ``load``
makes them numbers of the file.  The stream's offset holds, for each file, how far it was read and
hashes of what was read; a file that was replaced, cut or rewritten starts a new generation.
"""

from __future__ import annotations

import glob
import hashlib
import json
import math
import os
import time
from collections.abc import Iterator
from contextlib import suppress
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from ledgerspark.operators.storage import materialize

from . import inventory

SCHEMA = "path string, generation int, byte_start bigint, byte_end bigint, ordinal bigint, digest string, raw string, error string, span bigint"
#: Longer records are recorded but not parsed; bytes hashed at either end of what was read.
MAX_RECORD, EDGE = 32 << 20, 4096
BLOCK = 1 << 20
#: Bytes that one task reads of a file.
RANGE = 128 << 20


@dataclass
class Span(InputPartition):
    """Bytes of one file that one task reads; lines that end in them are its own, wherever they begin."""

    path: str
    begin: int
    end: int
    ordinal: int
    generation: int
    take_tail: bool = False


def cut(span: Span, step: int) -> Iterator[Span]:
    """A span in parts that end at multiples of ``step``; only the last may take an unfinished line."""
    at = span.begin
    while at < span.end:
        stop = min(span.end, (at // step + 1) * step)
        yield Span(span.path, at, stop, span.ordinal, span.generation, span.take_tail and stop == span.end)
        at = stop


def frames(stream, begin: int, end: int, largest: int) -> Iterator[tuple[int, int, bytes | None, str, bool]]:
    """(start, stop, bytes or None if too long, sha256, ended by a line feed) of each line.

    Memory is bounded by the longest allowed record; longer ones are only hashed.
    """
    stream.seek(begin)
    at, held, size, hasher, kept = begin, [], 0, hashlib.sha256(), True
    left = end - begin
    while left > 0:
        line = stream.readline(min(BLOCK, left))
        if not line:
            break
        left -= len(line)
        size += len(line)
        hasher.update(line)
        if kept:
            held.append(line)
            if size > largest:
                held, kept = [], False
        if line.endswith(b"\n"):
            yield at, at + size, b"".join(held) if kept else None, hasher.hexdigest(), True
            at, held, size, hasher, kept = at + size, [], 0, hashlib.sha256(), True
    if size:
        yield at, at + size, b"".join(held) if kept else None, hasher.hexdigest(), False


def first_start(path: str, begin: int, end: int, take_tail: bool = False) -> int | None:
    """Where the first line that ends between ``begin`` and ``end`` starts; None if no line ends there.

    The bytes before ``begin`` are looked at only if one does, so a line over many ranges is sought once.
    """
    if begin == 0:
        return 0
    if not take_tail and last_line_end(path, begin, end) == begin:
        return None
    return last_line_end(path, 0, begin)


def records_in(path: str, begin: int, end: int) -> int:
    """How many records end in a range, as ``read_span`` has them."""
    start = first_start(path, begin, end)
    if start is None:
        return 0
    with open(path, "rb") as f:
        return sum(bool(whole and (raw is None or raw.strip())) for _, _, raw, _, whole in frames(f, start, end, MAX_RECORD))


def read_span(span: Span, largest: int = MAX_RECORD) -> Iterator[tuple]:
    begin = first_start(span.path, span.begin, span.end, span.take_tail)
    if begin is None:
        return
    with open(span.path, "rb") as f:
        ordinal = span.ordinal
        for start, stop, raw, digest, whole in frames(f, begin, span.end, largest):
            if not whole and not (span.take_tail and raw is not None and is_object(raw)):
                return
            if not (raw is None or raw.strip()):
                continue
            ordinal += 1
            text, error = None, "oversized_record" if raw is None else None
            if raw is not None:
                try:
                    text = raw.decode("utf-8")
                    error = None if isinstance(json.loads(text), dict) else "malformed_record"
                except ValueError:
                    text, error = None, "malformed_record"
            yield span.path, span.generation, start, stop, ordinal, digest, text, error, span.begin


def is_object(raw: bytes) -> bool:
    try:
        return isinstance(json.loads(raw), dict)
    except ValueError:
        return False


def sha(path: str, begin: int, length: int) -> str:
    """SHA-256 of a byte range, read in blocks."""
    h = hashlib.sha256()
    with open(path, "rb") as f:
        f.seek(begin)
        while length > 0 and (b := f.read(min(BLOCK, length))):
            h.update(b)
            length -= len(b)
    return h.hexdigest()


def last_line_end(path: str, begin: int, end: int) -> int:
    """Where the last complete line before ``end`` stops; ``begin`` if there is none."""
    with open(path, "rb") as f:
        at = end
        while at > begin:
            low = max(begin, at - BLOCK)
            f.seek(low)
            if (k := f.read(at - low).rfind(b"\n")) >= 0:
                return low + k + 1
            at = low
    return begin


def first_line_end(path: str, begin: int, end: int) -> int:
    """Where the first line after ``begin`` stops; ``end`` if none does before."""
    with open(path, "rb") as f:
        f.seek(begin)
        while begin < end and (b := f.read(min(BLOCK, end - begin))):
            if (k := b.find(b"\n")) >= 0:
                return begin + k + 1
            begin += len(b)
    return end


def file_id(stat: os.stat_result) -> str:
    return f"{stat.st_dev}:{stat.st_ino}"


def chained(path: str, begin: int, end: int, before: str) -> tuple[str, int]:
    """The content hash at ``end``, from the one at ``begin``, and how many records lie between.

    A link is made for each line from the hash before it and the line's own, so the hash goes on where an
    earlier pass stopped, whatever the passes were.
    """
    records = 0
    with open(path, "rb") as f:
        for _, _, raw, digest, whole in frames(f, begin, end, MAX_RECORD):
            before = hashlib.sha256((before + digest).encode()).hexdigest()
            records += bool(whole and (raw is None or raw.strip()))
    return before, records


def change(path: str, mark: dict, full: bool = False) -> str | None:
    """Why what was read of a file no longer counts, or None.  The first reason that holds is given."""
    stat = os.stat(path)
    if mark["file_id"] != file_id(stat):
        return "replacement"
    if stat.st_size < mark["offset"]:
        return "truncation"
    n = min(EDGE, mark["offset"])
    if sha(path, 0, n) != mark["head"]:
        return "prefix_rewrite"
    if sha(path, mark["offset"] - n, n) != mark["tail"]:
        return "checkpoint_rewrite"
    if full and chained(path, 0, mark["offset"], "")[0] != mark["content"]:
        return "content_rewrite"
    return None


def advance(path: str, mark: dict | None, full: bool = False, most: int = 0, counted: bool = True, rewritten: int = 0) -> dict:
    """The mark of a file as it is now, after the one before; at most about ``most`` bytes further (0: all).

    A file whose identity, size and time are those of its mark was not touched, so it isn't opened.  Of one that was,
    the ends and the last line feed are read; ``counted`` reads all that is new, to number and hash it.
    ``rewritten`` is a generation whose content is known to have changed.
    """
    stat = os.stat(path)
    same = mark is not None and (mark["file_id"], mark["size"], mark["mtime_ns"]) == (file_id(stat), stat.st_size, stat.st_mtime_ns)
    stale = bool(mark and rewritten and mark["generation"] <= rewritten)
    if same and not full and not stale and not mark.get("more"):
        return mark
    why = ("content_rewrite" if stale else change(path, mark, full)) if mark else None
    start = {"offset": 0, "ordinal": 0, "generation": (mark["generation"] + 1) if why else 1, "content": ""} if why or not mark else mark
    last = last_line_end(path, start["offset"], stat.st_size)
    end = last_line_end(path, start["offset"], min(stat.st_size, start["offset"] + most)) if most else last
    if end < last and end == start["offset"]:  # a line longer than the limit is taken whole
        end = first_line_end(path, end, last)
    n = min(EDGE, end)
    content, count = chained(path, start["offset"], end, start["content"]) if counted else ("", 0)
    return {"file_id": file_id(stat), "size": stat.st_size, "mtime_ns": stat.st_mtime_ns, "offset": end, "ordinal": start["ordinal"] + count, "generation": start["generation"], "head": sha(path, 0, n),
            "tail": sha(path, end - n, n), "content": content, "pending": stat.st_size - end, "more": end < last, "why": why}


class JsonlReader(DataSourceReader):
    """Whole files, up to their size (or the one that ``sizes``, a JSON object, has).  ``finalizedPaths`` are files whose last record may lack its line feed; with
    ``finalizedMarks`` (a JSON object of sizes and times at an earlier import) only if they didn't change."""

    def __init__(self, options: dict):
        self.paths = listed(options["path"])
        self.largest = int(options.get("maxRecordBytes", MAX_RECORD))
        self.final = set(filter(None, options.get("finalizedPaths", "").split(os.pathsep)))
        self.marks = json.loads(options["finalizedMarks"]) if options.get("finalizedMarks") else None
        self.step = int(options.get("rangeBytes", RANGE))
        self.sizes = json.loads(options.get("sizes", "{}"))

    def settled(self, path: str) -> bool:
        if path not in self.final or self.marks is None:
            return path in self.final
        stat = os.stat(path)
        return self.marks.get(path) == [stat.st_size, stat.st_mtime_ns]

    def partitions(self) -> list[Span]:
        found = []
        for p in self.paths:
            with suppress(OSError):  # a file may go between listing and reading
                found += cut(Span(p, 0, self.sizes.get(p, os.path.getsize(p)), 0, 1, self.settled(p)), self.step)
        return found

    def read(self, partition: Span) -> Iterator[tuple]:
        return read_span(partition, self.largest)


class JsonlStream(DataSourceStreamReader):
    """Follows files: an offset maps each path to its mark.

    Known files are looked at on every trigger, by identity, size and time; new ones are looked for every
    ``discoverySeconds``, and contents verified every ``verifySeconds`` (on every trigger with ``verify=full``,
    never with 0).  A file that can't be read keeps its mark and is left alone for ``errorSeconds``.  A trigger takes about
    ``maxBytesPerTrigger`` bytes (0: all).

    With ``counted=false`` the driver reads no more than ends of files: records are numbered by range (``content.numbered``
    makes them numbers of the file) and contents aren't verified here.  ``rewritten`` then is a folder of notes on
    files whose content others found changed, and a batch comes every ``verifySeconds`` in which they may look.
    """

    def __init__(self, options: dict):
        self.where, self.largest = options["path"], int(options.get("maxRecordBytes", MAX_RECORD))
        self.always = options.get("verify", "quick") == "full"
        get = lambda name, default: float(options.get(name, default))
        self.verify_seconds, self.discovery_seconds, self.error_seconds = get("verifySeconds", 300), get("discoverySeconds", 0), get("errorSeconds", 30)
        self.most, self.step = int(options.get("maxBytesPerTrigger", 0)), int(options.get("rangeBytes", RANGE))
        self.counted, self.notes, self.ticks = options.get("counted", "true") == "true", options.get("rewritten"), 0
        self.known: dict = {}
        self.paths: list[str] = []
        self.listed_at = self.verified_at = -math.inf
        self.failed: dict[str, float] = {}

    def initialOffset(self) -> dict:
        return {"files": "{}"}

    def latestOffset(self) -> dict:
        now = time.monotonic()
        if now - self.listed_at >= self.discovery_seconds:
            self.paths, self.listed_at = listed(self.where), now
        full = self.always or bool(self.verify_seconds and self.known and now - self.verified_at >= self.verify_seconds)
        if full or self.verified_at == -math.inf:
            self.verified_at = now
        if not self.counted:
            self.ticks, full = self.ticks + full, False
        rewritten = read_notes(self.notes) if self.notes else {}
        left = self.most
        for p in self.paths:
            if now - self.failed.get(p, -math.inf) < self.error_seconds or self.most and left <= 0:
                continue
            before = self.known.get(p)
            try:
                self.known[p] = mark = advance(p, before, full, left if self.most else 0, self.counted, rewritten.get(p, 0))
            except OSError:  # a file that is gone keeps its mark, so that what was read of it stays
                self.failed[p] = now
                continue
            self.failed.pop(p, None)
            left -= mark["offset"] - (before["offset"] if before and before["generation"] == mark["generation"] else 0)
        return {"files": json.dumps(self.known, sort_keys=True)} | ({} if self.counted else {"ticks": str(self.ticks)})

    def partitions(self, start: dict, end: dict) -> list[Span]:
        old, new = json.loads(start["files"]), json.loads(end["files"])
        self.known = new | self.known
        self.ticks = max(self.ticks, int(end.get("ticks", 0)))
        spans = []
        for p, m in sorted(new.items()):
            o = old.get(p)
            same = o is not None and o["generation"] == m["generation"]
            begin, ordinal = (o["offset"], o["ordinal"]) if same else (0, 0)
            if m["offset"] > begin:
                whole = Span(p, begin, m["offset"], ordinal, m["generation"])
                spans += [whole] if self.counted else cut(whole, self.step)
        return spans

    def read(self, partition: Span) -> Iterator[tuple]:
        return read_span(partition, self.largest)


def note_rewritten(folder: str, path: str, generation: int) -> None:
    """Say that what was read of a file's generation isn't its content any more."""
    os.makedirs(folder, exist_ok=True)
    at = os.path.join(folder, hashlib.sha256(path.encode()).hexdigest())
    with open(f"{at}.new", "w") as f:
        json.dump({"path": path, "generation": generation}, f)
    os.replace(f"{at}.new", f"{at}.json")


def read_notes(folder: str) -> dict[str, int]:
    """The newest generation that is known to have changed, for each file with a note."""
    found = {}
    for at in glob.glob(os.path.join(glob.escape(folder), "*.json")):
        with suppress(OSError, ValueError), open(at) as f:
            note = json.load(f)
            found[note["path"]] = note["generation"]
    return found


def listed(where: str) -> list[str]:
    """Files of a path, a folder (recursively), a pattern or all that are discovered."""
    if where.startswith(inventory.DISCOVER):
        return inventory.rollouts(where)
    if os.path.isdir(where):
        where = os.path.join(where, "**", "*.jsonl")
    return sorted(p for p in glob.glob(where, recursive=True) if os.path.isfile(p))


class AgentLogs(DataSource):
    @classmethod
    def name(cls) -> str:
        return "agent_jsonl"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> JsonlReader:
        return JsonlReader(self.options)

    def streamReader(self, schema) -> JsonlStream:
        return JsonlStream(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(AgentLogs)


def load(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """Records of whole files, numbered through each file, however many tasks read it.

    Files of more than one range have the records of their ranges counted first, by tasks.
    """
    from . import content

    register(spark)
    step, sizes = int(options.get("rangeBytes", RANGE)), {}
    for p in listed(path):
        with suppress(OSError):
            if (size := os.path.getsize(p)) > step:
                sizes[p] = size
    raw = spark.read.format("agent_jsonl").options(path=path, **options)
    if not sizes:
        return raw.load().drop("span")
    files = spark.createDataFrame([(p, 1, 0, n) for p, n in sizes.items()], "path string, generation int, begin bigint, size bigint")
    counts = materialize(content.measured(content.ranges(files, step), digest=False), "counts")
    return content.numbered(raw.option("sizes", json.dumps(sizes)).load(), counts)
