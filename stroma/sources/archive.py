"""Tar archives of Parquet members as a data source of Spark: a partition a member, conditions on row-group statistics.

``spark.dataSource.register(TarSource)``, then
``spark.read.format("tar_parquet").schema(...).option("path", ...).load()``. An archive's
headers are read by seeking from one to the next; a task reads of its member only the
footer, and then one row group after the other: those whose statistics allow a row, and of
these the columns of the schema. So a member may be larger than a task's memory.

Conditions are an option and not pushed by Spark: Spark 4.1 keeps what was pushed once for
every later use of the same DataFrame, which would then lack rows.
"""

from __future__ import annotations

import json
import tarfile
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import DateType, StructType, TimestampNTZType

from stroma.sources.tables import ship_package


def _system(path: str):
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))
    return system, inner


class Part:
    """A seekable file that is a range of another one."""

    def __init__(self, file, start: int, size: int):
        self.file, self.start, self.length, self.at, self.closed = file, start, size, 0, False

    def read(self, size: int = -1) -> bytes:
        left = self.length - self.at
        self.file.seek(self.start + self.at)
        found = self.file.read(left if size is None or size < 0 else min(size, left))
        self.at += len(found)
        return found

    def seek(self, to: int, whence: int = 0) -> int:
        self.at = to + (0, self.at, self.length)[whence]
        return self.at

    def tell(self) -> int:
        return self.at

    def size(self) -> int:
        return self.length

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def writable(self) -> bool:
        return False

    def flush(self) -> None:
        pass

    def close(self) -> None:
        self.closed = True


class Member(InputPartition):
    def __init__(self, path: str, name: str, start: int, size: int):
        super().__init__((path, name))
        self.path, self.name, self.start, self.size = path, name, start, size


#: Whether rows of a group with least and greatest value a, b may fulfil a condition on v.
_MAY = {
    "=": lambda a, b, v: a <= v <= b,
    ">": lambda a, b, v: b > v,
    ">=": lambda a, b, v: b >= v,
    "<": lambda a, b, v: a < v,
    "<=": lambda a, b, v: a <= v,
    "in": lambda a, b, v: any(a <= x <= b for x in v),
}
Condition = tuple[str, str, object]


class TarReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.options, self.schema = options, schema
        self.conditions = [(c, op, self._typed(c, v)) for c, op, v in json.loads(options.get("conditions", "[]"))]

    def _typed(self, column: str, value):
        from datetime import date, datetime

        kind = {f.name: f.dataType for f in self.schema.fields}.get(column)
        parse = date.fromisoformat if isinstance(kind, DateType) else datetime.fromisoformat if isinstance(kind, TimestampNTZType) else lambda v: v
        return [parse(v) for v in value] if isinstance(value, list) else parse(value)

    def archives(self) -> list[str]:
        from pyarrow import fs

        out = []
        for path in self.options["path"].split(","):
            system, inner = _system(path)
            info = system.get_file_info(inner)
            found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(inner, recursive=True))
            scheme = path.split("://", 1)[0] + "://" if "://" in path else "file://"
            out += sorted(scheme + i.path for i in found if i.type == fs.FileType.File and i.path.endswith(".tar"))
        return out

    def partitions(self) -> list[Member]:
        suffix, out = self.options.get("suffix", ".parquet"), []
        for path in self.archives():
            system, inner = _system(path)
            with system.open_input_file(inner) as file, tarfile.open(fileobj=file, mode="r:") as tar:
                out += [Member(path, m.name, m.offset_data, m.size) for m in tar if m.isfile() and m.name.endswith(suffix)]
        return out or [Member("", "", 0, 0)]

    def allowed(self, group) -> bool:
        """Whether a row group's statistics leave any row that fulfils all conditions; a null fulfils none."""
        columns = {group.column(k).path_in_schema: group.column(k).statistics for k in range(group.num_columns)}
        for name, op, value in self.conditions:
            s = columns.get(name)
            if s is None:
                continue
            if s.has_null_count and s.null_count == group.num_rows:
                return False
            try:
                if s.has_min_max and not _MAY[op](s.min, s.max, value):
                    return False
            except TypeError:  # a value of a kind that the file doesn't hold
                continue
        return True

    def read(self, member: Member) -> Iterator[pa.RecordBatch]:
        if not member.path:
            return
        system, inner = _system(member.path)
        with system.open_input_file(inner) as file:
            parquet = pq.ParquetFile(pa.PythonFile(Part(file, member.start, member.size), mode="r"))
            there = set(parquet.schema_arrow.names)
            names = [f.name for f in self.schema.fields]
            groups = [g for g in range(parquet.num_row_groups) if self.allowed(parquet.metadata.row_group(g))]
            target = _arrow(self.schema)
            for g in groups:
                for batch in parquet.iter_batches(int(self.options.get("batch_rows", "10000")), row_groups=[g], columns=[n for n in names if n in there]):
                    columns = [batch.column(batch.schema.names.index(n)).cast(target.field(n).type) if n in there else pa.nulls(batch.num_rows, target.field(n).type) for n in names]
                    yield pa.RecordBatch.from_arrays(columns, schema=target)


def _arrow(schema: StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


class TarSource(DataSource):
    """Options: ``path`` (files or folders, by commas), ``suffix`` of the members, ``batch_rows``, ``conditions`` (JSON).

    The schema is declared, with the columns that are wanted; those that a member lacks are null.
    """

    @classmethod
    def name(cls) -> str:
        return "tar_parquet"

    def reader(self, schema: StructType) -> TarReader:
        return TarReader(dict(self.options), schema)


def read_tars(spark: SparkSession, path: str, schema: str, where: list[Condition] | None = None, **options: str) -> DataFrame:
    """Rows of all Parquet members of the tar archives under ``path`` that fulfil all conditions (column, one of = > >= < <= in, value).

    Conditions choose row groups by their statistics, and then rows. Times are given as ISO texts.
    """
    ship_package(spark)
    spark.dataSource.register(TarSource)
    df = spark.read.format(TarSource.name()).schema(schema).options(path=path, conditions=json.dumps(where or []), **options).load()
    kinds = dict(df.dtypes)
    for column, op, value in where or []:
        typed = [F.lit(v).cast(kinds[column]) for v in (value if op == "in" else [value])]
        c = F.col(f"`{column}`")
        df = df.where(c.isin(typed) if op == "in" else {"=": c == typed[0], ">": c > typed[0], ">=": c >= typed[0], "<": c < typed[0], "<=": c <= typed[0]}[op])
    return df
