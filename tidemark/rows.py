"""Rows taken out of a large table where they are read, without moving the others."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import scratch, ship

#: Rows of a side that are sent to all tasks; narrow ones, of some 60 bytes.
FEW = 1_000_000


def _name(path: str) -> str:
    return hashlib.sha256(path.encode()).hexdigest()


def _mark(folder: str):
    """For ``applyInArrow``: the places of one file's rows, sorted, into a file of our own under its name; a rerun writes the same."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        fs, base = pafs.FileSystem.from_uri(folder)
        path = key[0].as_py()
        temp = f"{base}/.{uuid.uuid4().hex}"
        with fs.open_output_stream(temp) as f:
            f.write(np.unique(table.column("row").to_numpy()).astype("<i8").tobytes())
        try:
            fs.move(temp, f"{base}/{_name(path)}")
        except OSError:  # another attempt was first
            fs.delete_file(temp)
        return pa.table({"file": [path], "n": pa.array([table.num_rows], pa.int64())})

    return run


def _unmarked(folder: str, width: int):
    """For ``mapInArrow``: rows whose place (the last column) isn't marked for their file (the one before)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(folder)
        last, marked = None, np.zeros(0, np.int64)
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            files = batch.column(width).dictionary_encode()
            rows = batch.column(width + 1).to_numpy()
            of = files.indices.to_numpy()
            for k, path in enumerate(files.dictionary.to_pylist()):
                if path != last:
                    name = f"{base}/{_name(path)}"
                    there = fs.get_file_info(name).type != pafs.FileType.NotFound
                    last, marked = path, np.frombuffer(fs.open_input_stream(name).read(), "<i8") if there else np.zeros(0, np.int64)
                own = np.flatnonzero(of == k)
                if len(marked):
                    at = np.minimum(np.searchsorted(marked, rows[own]), len(marked) - 1)
                    keep[own] = marked[at] != rows[own]
            kept = batch.filter(pa.array(keep))
            yield pa.RecordBatch.from_arrays(kept.columns[:width], names=batch.schema.names[:width])

    return run


def drop_rows(df: DataFrame, gone: DataFrame, match: Callable[[DataFrame], Column], narrow: list[str], few: int = FEW) -> DataFrame:
    """``df`` without the rows that ``match`` one of ``gone``; ``match`` gives the join's condition and reads only columns in ``narrow``.

    While ``gone`` is small it is sent to all. Beyond that, of a table read from Parquet, what is joined is the matching
    columns and each row's place in its file; the places to leave out are written by file into the shared folder, and the
    rows are filtered where they are read, each task looking up the files it reads. No wide row is moved, and nothing
    that grows with the table is broadcast. Any other table is joined.
    """
    if gone.count() <= few:
        return df.join(F.broadcast(gone), match(df), "left_anti")
    try:
        placed = df.select("*", F.col("_metadata.file_path").alias("_tidemark_file"), F.col("_metadata.row_index").alias("_tidemark_row"))
    except AnalysisException:  # no scan of files is under it
        return df.join(gone, match(df), "left_anti")
    spark = df.sparkSession
    ship(spark)
    folder = scratch(spark, "rows")
    fs, base = pafs.FileSystem.from_uri(folder)
    fs.create_dir(base, recursive=True)
    slim = df.select(*narrow, F.col("_metadata.file_path").alias("_tidemark_file"), F.col("_metadata.row_index").alias("_tidemark_row"))
    found = slim.join(gone, match(slim), "left_semi").select(F.col("_tidemark_file").alias("file"), F.col("_tidemark_row").alias("row"))
    # a row a file comes back; the write of all marks is done before any row is read again
    found.groupBy("file").applyInArrow(_mark(folder), "file string, n long").agg(F.sum("n")).collect()
    return placed.mapInArrow(_unmarked(folder, len(df.columns)), df.schema)
