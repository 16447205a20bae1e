"""The binary record format `.mex`: codec, and a Spark data source that reads and writes folders of such files."""

from __future__ import annotations

import glob
import os
import struct
import uuid
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

MARK = b"MEX0"
#: ids are UUIDs in text form; ts is in seconds since 1970.
SCHEMA = "id string, content string, node_type string, version int, ts double, activation double, decay_rate double, version_of string, links array<struct<to_id:string,weight:double,link_type:string>>, tags array<string>"


def _id(value: str) -> bytes:
    raw = str(value).encode("ascii")
    if len(raw) != 36:
        raise ValueError(f"an id has 36 characters, not {len(raw)}")
    return raw


def _short(value: str) -> bytes:
    raw = value.encode()
    if len(raw) > 255:
        raise ValueError("types and tags have 255 bytes at most")
    return bytes([len(raw)]) + raw


def encode(row) -> bytes:
    """One record of a memory (a mapping or row with the fields of SCHEMA)."""
    r = row.asDict(True) if hasattr(row, "asDict") else row
    content, links, tags = r["content"].encode(), r["links"] or [], r["tags"] or []
    out = [MARK, _id(r["id"]), struct.pack("<Hd", r["version"], r["ts"]), _short(r["node_type"]), struct.pack("<I", len(content)), content, struct.pack("<H", len(links))]
    for x in links:
        out += [_id(x["to_id"]), struct.pack("<f", x["weight"]), _short(x["link_type"])]
    out.append(struct.pack("<ff", r["activation"], r["decay_rate"]))
    out.append(b"\1" + _id(r["version_of"]) if r["version_of"] else b"\0")
    out.append(bytes([len(tags)]))
    out += [_short(t) for t in tags]
    return b"".join(out)


def size(row) -> int:
    """Bytes of a record, without making it."""
    r = row.asDict(True) if hasattr(row, "asDict") else row
    n = 67 + len(r["node_type"].encode()) + len(r["content"].encode()) + (36 if r["version_of"] else 0)
    return n + sum(41 + len(x["link_type"].encode()) for x in r["links"] or []) + sum(1 + len(t.encode()) for t in r["tags"] or [])


def decode(data: bytes) -> Iterator[tuple]:
    """The records of a file in the order of SCHEMA. A wrong mark or a record that breaks off is an error; the end of the file isn't."""
    at = 0

    def take(n: int) -> bytes:
        nonlocal at
        if at + n > len(data):
            raise ValueError(f"a record breaks off at byte {at}")
        at += n
        return data[at - n : at]

    def short() -> str:
        return take(take(1)[0]).decode()

    while at < len(data):
        if take(4) != MARK:
            raise ValueError(f"no record begins at byte {at - 4}")
        ident = take(36).decode("ascii")
        version, ts = struct.unpack("<Hd", take(10))
        kind = short()
        content = take(struct.unpack("<I", take(4))[0]).decode()
        links = []
        for _ in range(struct.unpack("<H", take(2))[0]):
            to = take(36).decode("ascii")
            links.append((to, struct.unpack("<f", take(4))[0], short()))
        activation, decay = struct.unpack("<ff", take(8))
        parent = take(36).decode("ascii") if take(1) == b"\1" else None
        tags = [short() for _ in range(take(1)[0])]
        yield ident, content, kind, version, ts, activation, decay, parent, links, tags


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.files = sorted(glob.glob(os.path.join(path, "*.mex"))) if os.path.isdir(path) else [path]

    def partitions(self):
        return [_File(f) for f in self.files]

    def read(self, partition):
        if partition is None:
            return
        with open(partition.path, "rb") as f:
            yield from decode(f.read())


class _Written(WriterCommitMessage):
    def __init__(self, temporary: str | None):
        self.temporary = temporary


class _Writer(DataSourceWriter):
    """Tasks write under hidden names; only the commit on the driver gives those of successful tasks their names."""

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path, overwrite
        os.makedirs(path, exist_ok=True)

    def write(self, iterator):
        name, some = os.path.join(self.path, f".{uuid.uuid4().hex}.part"), False
        with open(name, "wb") as f:
            for row in iterator:
                f.write(encode(row))
                some = True
        if not some:
            os.remove(name)
        return _Written(name if some else None)

    def commit(self, messages):
        old = glob.glob(os.path.join(self.path, "*.mex")) if self.overwrite else []
        for m in messages:
            if m and m.temporary:
                os.replace(m.temporary, os.path.join(self.path, os.path.basename(m.temporary)[1:-5] + ".mex"))
        for f in old:
            os.remove(f)

    def abort(self, messages):
        for m in messages:
            if m and m.temporary and os.path.exists(m.temporary):
                os.remove(m.temporary)


class MexSource(DataSource):
    """spark.dataSource.register(MexSource); then format("mex") reads and writes a folder that all executors share."""

    @classmethod
    def name(cls):
        return "mex"

    def schema(self):
        return SCHEMA

    def _path(self) -> str:
        path = self.options["path"]
        return "/" + path[5:].lstrip("/") if path.startswith("file:") else path

    def reader(self, schema):
        return _Reader(self._path())

    def writer(self, schema, overwrite):
        return _Writer(self._path(), overwrite)
