"""Files from tables of bytes: single files, and archives of them."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

# Fixed value: the time of all members, so that equal input gives equal bytes.
MEMBER_TIME = (2023, 1, 1, 0, 0, 0)


def member(name: str) -> zipfile.ZipInfo:
    info = zipfile.ZipInfo(name, MEMBER_TIME)
    info.compress_type = zipfile.ZIP_DEFLATED
    info.external_attr = 0o644 << 16
    return info


def archives(df: DataFrame, group: str, name: str = "file", data: str = "content") -> DataFrame:
    """One ZIP file for each ``group``, of its files by name: ``archive, content, members``. Of equal names the first one is kept."""
    parsed = _parse_datatype_string("archive string, content binary, members int")
    arrow = to_arrow_schema(parsed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, out, z, names = None, io.BytesIO(), None, set()

        def finish() -> pa.RecordBatch:
            z.close()
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((now, out.getvalue(), len(names)), arrow.types)], schema=arrow)

        for batch in batches:
            for r in batch.to_pylist():
                if r["g"] != now or z is None:
                    if z is not None:
                        yield finish()
                    now, out, names = r["g"], io.BytesIO(), set()
                    z = zipfile.ZipFile(out, "w")
                if r["n"] not in names and r["d"] is not None:
                    names.add(r["n"])
                    z.writestr(member(r["n"]), r["d"])
        if z is not None:
            yield finish()

    shown = df.select(F.col(group).cast("string").alias("g"), F.col(name).alias("n"), F.col(data).alias("d"))
    return shown.repartition("g").sortWithinPartitions("g", "n").mapInArrow(run, parsed)


def write_files(df: DataFrame, folder: str, name: str = "file", data: str = "content") -> int:
    """Write each row as a file of a folder that all executors share; returns how many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        where, base = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)
        where.create_dir(base, recursive=True)
        n = 0
        for batch in batches:
            for file, content in zip(*(c.to_pylist() for c in batch.columns)):
                with where.open_output_stream(f"{base}/{file}") as out:
                    out.write(content or b"")
                n += 1
        yield pa.RecordBatch.from_pydict({"n": [n]})

    return df.select(name, data).mapInArrow(run, "n bigint").agg(F.sum("n")).first()[0] or 0
