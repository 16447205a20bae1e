"""Memories as bytes: the binary record format and compressed sizes, over Arrow batches."""

from __future__ import annotations

import zlib
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollect.functions import text
from recollect.plans.shared import ship
from recollect.sources import mex

#: Bytes of a batch that are Python objects at once; a larger row goes alone.
PIECE = 1 << 20
#: Records of a piece that are decoded at once.
ROWS = 1024


def _pieces(batches):
    """The batches in slices of at most PIECE bytes, found by halving; only these become Python objects."""
    for b in batches:
        waiting = [b]
        while waiting:
            x = waiting.pop()
            if x.num_rows > 1 and x.nbytes > PIECE:
                n = x.num_rows // 2
                waiting += [x.slice(n), x.slice(0, n)]
            elif x.num_rows:
                yield x


def _map(df: DataFrame, function, schema: str) -> DataFrame:
    ship(df.sparkSession)
    return df.mapInArrow(lambda batches: function(_pieces(batches)), schema)


_FIELDS = [f.split(" ", 1)[0] for f in mex.SCHEMA.replace("struct<to_id:string,weight:double,link_type:string>", "s").split(", ")]


def as_records(memories: DataFrame, links: DataFrame) -> DataFrame:
    """Memories with their links in the shape of the record format; numeric ids become text of 36 digits."""
    ident = lambda c: F.lpad(F.col(c).cast("string"), 36, "0")
    own = links.groupBy("from_id").agg(F.array_sort(F.collect_list(F.struct("pos", ident("to_id").alias("to_id"), "weight", "link_type"))).alias("links"))
    out = F.transform("links", lambda x: F.struct(x["to_id"].alias("to_id"), x["weight"].alias("weight"), x["link_type"].alias("link_type")))
    m = memories.join(own, memories["id"] == own["from_id"], "left")
    return m.select(ident("id").alias("id"), "content", "node_type", "version", F.col("ts").cast("double").alias("ts"), "activation", "decay_rate", ident("version_of").alias("version_of"), out.alias("links"), "tags")


def encoded(records: DataFrame) -> DataFrame:
    """(id, record): each memory as the bytes of its record."""

    def encode(batches):
        for b in batches:
            rows = b.to_pylist()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([mex.encode(r) for r in rows], pa.binary())], ["id", "record"])

    return _map(records.select(*_FIELDS), encode, "id string, record binary")


def decoded(records: DataFrame) -> DataFrame:
    """Memories from a column `record` of bytes, each of one record or several."""

    def decode(batches):
        schema = pa.schema([
            ("id", pa.string()), ("content", pa.string()), ("node_type", pa.string()), ("version", pa.int32()), ("ts", pa.float64()), ("activation", pa.float64()), ("decay_rate", pa.float64()),
            ("version_of", pa.string()), ("links", pa.list_(pa.struct([("to_id", pa.string()), ("weight", pa.float64()), ("link_type", pa.string())]))), ("tags", pa.list_(pa.string())),
        ])
        names = [f.name for f in schema.field("links").type.value_type]
        for b in batches:
            found = (r for x in b.column(0).to_pylist() if x is not None for r in mex.decode(x))
            while rows := list(islice(found, ROWS)):
                rows = [dict(zip(_FIELDS, (*r[:8], [dict(zip(names, x)) for x in r[8]], r[9]))) for r in rows]
                yield pa.RecordBatch.from_pylist(rows, schema)

    return _map(records.select("record"), decode, mex.SCHEMA)


def packed(df: DataFrame, key: str, content: str) -> DataFrame:
    """(key, codec, bytes, data): each content compressed by the codec that its size asks for; see functions.text.codec_for. zstd stands for blosc, which Arrow hasn't."""

    def pack(batches):
        for b in batches:
            raw, codec = [(x or "").encode() for x in b.column(1).to_pylist()], b.column(2).to_pylist()
            data = [_pack(x, c) for x, c in zip(raw, codec)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([len(x) for x in raw], pa.int64()), pa.array(data, pa.binary())], ["key", "codec", "bytes", "data"])

    return _map(df.select(F.col(key).cast("long").alias("key"), content, text.codec_for(F.octet_length(F.coalesce(content, F.lit("")))).alias("codec")), pack, "key long, codec string, bytes long, data binary")


def unpacked(df: DataFrame) -> DataFrame:
    """(key, content) of what packed made."""

    def unpack(batches):
        for b in batches:
            codec, size, data = (b.column(c).to_pylist() for c in ("codec", "bytes", "data"))
            yield pa.RecordBatch.from_arrays([b.column("key"), pa.array([_unpack(d, c, n).decode() for c, n, d in zip(codec, size, data)], pa.string())], ["key", "content"])

    return _map(df.select("key", "codec", "bytes", "data"), unpack, "key long, content string")


def _pack(raw: bytes, codec: str) -> bytes:
    kind, level = codec.split("/")
    return zlib.compress(raw, int(level)) if kind == "zlib" else pa.compress(raw, codec="lz4" if kind == "lz4" else "zstd", asbytes=True)


def _unpack(data: bytes, codec: str, size: int) -> bytes:
    kind = codec.split("/")[0]
    return zlib.decompress(data) if kind == "zlib" else pa.decompress(data, size, codec="lz4" if kind == "lz4" else "zstd", asbytes=True)


def compressed(df: DataFrame, key: str, content: str, levels: tuple[int, ...] = (1, 5, 9)) -> DataFrame:
    """(key, bytes, level, packed): the size of each content and what zlib makes of it at each level."""

    def pack(batches):
        for b in batches:
            raw = [(x or "").encode() for x in b.column(1).to_pylist()]
            for level in levels:
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), pa.array([len(x) for x in raw], pa.int64()), pa.array([level] * len(raw), pa.int32()), pa.array([len(zlib.compress(x, level)) for x in raw], pa.int64())], ["key", "bytes", "level", "packed"]
                )

    return _map(df.select(F.col(key).cast("long").alias("key"), content), pack, "key long, bytes long, level int, packed long")
