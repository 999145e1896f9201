"""A data source of JSON event files, for batches and streams.

`spark.dataSource.register(EventSource)`, then `spark.read.format("json_events").load(folder)` or `spark.readStream...`. A file holds an
event a line. Files are read in the order of their names, which a writer that rotates its files lets rise; `suffix` (default .json) picks
files, `files_per_task` (default 8) deals them out. A stream's offset is the name of the last file it has read, so a query that
goes on from its checkpoint, or repeats a batch after a failure, reads just the files of that batch. A line that is no JSON object
is a row with its error; blank lines are none. Folders are listed and files opened through Arrow's file systems, so they need
not be local. A file must be whole when its name appears (write elsewhere, then rename).
"""

from __future__ import annotations

import base64
import binascii
import json
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

SCHEMA = "file string, line int, event string, stream string, text string, payload binary, raw string, error string"
_TYPES = pa.schema([("file", pa.string()), ("line", pa.int32()), ("event", pa.string()), ("stream", pa.string()), ("text", pa.string()), ("payload", pa.binary()), ("raw", pa.string()), ("error", pa.string())])
#: Lines of one Arrow batch.
BATCH = 2000


class Files(InputPartition):
    def __init__(self, names: list[str]):
        self.names = names


def _string(x) -> str | None:
    return x if isinstance(x, str) else None if x is None else json.dumps(x)


def parsed(line: str) -> tuple[str | None, str | None, str | None, bytes | None, str | None]:
    """event, stream, text, payload and error of a line. An event names itself by `event` or `type`, its stream by `streamSid` or
    `start.streamSid`; its text is `transcript` or `text`, its payload `media.payload` or `delta`, in base 64."""
    try:
        data = json.loads(line)
    except ValueError as e:
        return None, None, None, None, f"no JSON: {e}"
    if not isinstance(data, dict):
        return None, None, None, None, "no object"
    inner = lambda k: data[k] if isinstance(data.get(k), dict) else {}
    event, stream, text = data.get("event", data.get("type")), data.get("streamSid", inner("start").get("streamSid")), data.get("transcript", data.get("text"))
    payload = inner("media").get("payload", data.get("delta"))
    try:
        held, error = (base64.b64decode(payload, validate=True), None) if isinstance(payload, str) else (None, None)
    except (binascii.Error, ValueError) as e:
        held, error = None, f"no base 64: {e}"
    return _string(event), _string(stream), _string(text), held, error


class _Folder:
    """What batch and stream have in common."""

    def __init__(self, options: dict[str, str]):
        if not options.get("path"):
            raise ValueError("json_events needs the path of a folder")
        self.path, self.suffix = options["path"], options.get("suffix", ".json")
        self.per_task = max(1, int(options.get("files_per_task", "8")))

    def names(self, after: str = "") -> list[str]:
        held, base = fs.FileSystem.from_uri(self.path)
        found = held.get_file_info(fs.FileSelector(base, allow_not_found=True))
        return sorted(f.base_name for f in found if f.type == fs.FileType.File and f.base_name.endswith(self.suffix) and f.base_name[0] not in "._" and f.base_name > after)

    def dealt(self, names: list[str]) -> list[InputPartition]:
        return [Files(names[k : k + self.per_task]) for k in range(0, len(names), self.per_task)]

    def rows(self, part: Files) -> Iterator[pa.RecordBatch]:
        held, base = fs.FileSystem.from_uri(self.path)
        out: list[tuple] = []
        for name in part.names:
            with held.open_input_stream(f"{base.rstrip('/')}/{name}") as f:
                for n, line in enumerate(_lines(f), 1):
                    if line.strip():
                        *fields, error = parsed(line)
                        out.append((name, n, *fields, line, error))
                    if len(out) >= BATCH:
                        yield _batch(out)
                        out = []
        if out:
            yield _batch(out)


def _lines(f, size: int = 1 << 20) -> Iterator[str]:
    """The lines of a file that is read in pieces."""
    rest = b""
    while piece := f.read(size):
        *whole, rest = (rest + piece).split(b"\n")
        yield from (x.decode("utf-8", "replace").rstrip("\r") for x in whole)
    if rest:
        yield rest.decode("utf-8", "replace").rstrip("\r")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], schema=_TYPES)


class EventReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.folder = _Folder(options)

    def partitions(self) -> Sequence[InputPartition]:
        return self.folder.dealt(self.folder.names()) or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        return self.folder.rows(partition)


class EventStream(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.folder = _Folder(options)

    def initialOffset(self) -> dict:
        return {"after": ""}

    def latestOffset(self) -> dict:
        names = self.folder.names()
        return {"after": names[-1] if names else ""}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        return self.folder.dealt([n for n in self.folder.names(start["after"]) if n <= end["after"]])

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        return self.folder.rows(partition)

    def commit(self, end: dict) -> None:
        pass


class EventSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "json_events"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return EventReader(self.options)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return EventStream(self.options)
