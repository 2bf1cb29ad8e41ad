"""A data source of CSV files compressed with Zstandard, one or more for each day, named by eight digits.

Reading makes a partition of each file whose day is asked for; a file is decompressed as a stream and parsed
batch by batch, and files of other days are not opened. Writing puts the rows of each task into a file for each
day. Paths are what pyarrow's file systems know: plain paths, file://, hdfs:// and object stores.
"""

from __future__ import annotations

import datetime as dt
import re
import uuid
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.csv as csv
import pyarrow.fs as fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema

NAME = "dated_csv_zst"
DAY = re.compile(r"(\d{8})\D[^/]*\.csv\.zst$")


def _files(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path else fs.FileSystem.from_uri(f"file://{path}")


@dataclass
class DayFile(InputPartition):
    path: str
    day: str


@dataclass
class Written(WriterCommitMessage):
    paths: list


class DatedCsv(DataSource):
    """Options: path; for reading also first and last (yyyy-MM-dd, both included). The schema's column ``day``,
    if there is one, is the file's day as a date; the others are read by their names in the header."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        raise ValueError("give a schema")

    def reader(self, schema) -> DatedReader:
        return DatedReader(self.options, to_arrow_schema(schema))

    def writer(self, schema, overwrite: bool) -> DatedWriter:
        return DatedWriter(self.options, overwrite)


class DatedReader(DataSourceReader):
    def __init__(self, options, schema: pa.Schema):
        self.path, self.schema = options["path"], schema
        self.first, self.last = (options.get(k, end).replace("-", "") for k, end in (("first", "00000000"), ("last", "99999999")))

    def partitions(self) -> list[DayFile]:
        files, root = _files(self.path)
        names = [f.path for f in files.get_file_info(fs.FileSelector(root, recursive=True)) if f.type == fs.FileType.File]
        dated = [DayFile(n, m[1]) for n in sorted(names) if (m := DAY.search(n)) and self.first <= m[1] <= self.last]
        return dated or [DayFile("", "")]

    def read(self, partition: DayFile):
        if not partition.path:
            return
        files, _ = _files(self.path)
        read = [f for f in self.schema if f.name != "day"]
        how = csv.ConvertOptions(column_types={f.name: f.type for f in read}, include_columns=[f.name for f in read], strings_can_be_null=True)
        day = dt.datetime.strptime(partition.day, "%Y%m%d").date()
        with files.open_input_stream(partition.path, compression="zstd") as stream, csv.open_csv(stream, convert_options=how) as batches:
            for batch in batches:
                columns = [pa.array([day] * batch.num_rows, pa.date32()) if f.name == "day" else batch.column(f.name) for f in self.schema]
                yield pa.RecordBatch.from_arrays(columns, schema=self.schema)


class DatedWriter(DataSourceArrowWriter):
    """Each task's files are named by themselves; those of a failed task or job are deleted."""

    def __init__(self, options, overwrite: bool):
        if overwrite:
            raise ValueError("files are only added")
        self.path = options["path"]

    def write(self, iterator) -> Written:
        files, root = _files(self.path)
        files.create_dir(root, recursive=True)
        open_, paths, end = {}, [], uuid.uuid4().hex
        try:
            for batch in iterator:
                days = batch.column("day")
                rest = batch.drop_columns(["day"])
                for day in pc.unique(days).to_pylist():
                    if day not in open_:
                        paths.append(f"{root}/tape-{day:%Y%m%d}.{end}.csv.zst")
                        stream = files.open_output_stream(paths[-1], compression="zstd")
                        open_[day] = stream, csv.CSVWriter(stream, rest.schema)
                    open_[day][1].write_batch(rest.filter(pc.equal(days, day)))
        finally:
            for stream, writer in open_.values():
                writer.close()
                stream.close()
        return Written(paths)

    def commit(self, messages) -> None:
        pass

    def abort(self, messages) -> None:
        files, _ = _files(self.path)
        for message in messages:
            for path in message.paths if message else []:
                files.delete_file(path)


def read_days(spark: SparkSession, path: str, schema: str, first: str, last: str) -> DataFrame:
    """Rows of the files of the days from first to last, a partition for each file."""
    spark.dataSource.register(DatedCsv)
    return spark.read.format(NAME).schema(schema).option("first", first).option("last", last).load(path)


def write_days(rows: DataFrame, path: str) -> None:
    """Adds rows to the files of their days (column ``day``, a date). Rows of a day should stand together."""
    rows.sparkSession.dataSource.register(DatedCsv)
    rows.repartition("day").sortWithinPartitions("day").write.format(NAME).mode("append").save(path)
