"""Half-precision vectors in files whose rows are aligned with lists of ids, as a data source of Spark.

A folder holds blocks. Block b has the rows from b * stride on: `block-b.npy` (a NumPy file of float16, row by row) beside
`block-b.jsonl` (a line {"id": ...} for each of its rows). One pair of files is a folder of one block.

Reads are split by rows, whatever the blocks: a task seeks to its rows. Writes go to files of their own, which the driver
moves in place when all tasks have ended, ids last: a block without ids is not there. A write that comes again starts at
the first row that is not there.
"""

from __future__ import annotations

import itertools
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

SCHEMA = "row long, id string, embedding array<float>"
#: Rows of a block, of one task's read, and of a batch.
STRIDE, READ, BATCH = 65_536, 16_384, 2_048


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system that a path or URI names, and the path there."""
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def blocks(path: str) -> list[int]:
    """Numbers of the blocks that are whole: with vectors and ids."""
    files, at = opened(path)
    if files.get_file_info(at).type == fs.FileType.NotFound:
        return []
    names = {f.base_name for f in files.get_file_info(fs.FileSelector(at))}
    return sorted(int(n[6:-4]) for n in names if n.startswith("block-") and n.endswith(".npy") and f"{n[:-4]}.jsonl" in names)


def name(block: int) -> str:
    return f"block-{block:010d}"


def header(files: fs.FileSystem, path: str) -> tuple[int, int, int]:
    """(offset of the first row, rows, components) of a NumPy file of float16."""
    with files.open_input_file(path) as f:
        np.lib.format.read_magic(f)
        shape, by_column, kind = np.lib.format.read_array_header_1_0(f)
        at = f.tell()
    if kind != np.dtype("<f2") or by_column or len(shape) != 2:
        raise ValueError(f"{path} does not hold rows of float16")
    return at, *shape


@dataclass
class Rows(InputPartition):
    """Rows `begin` to `end` of a block."""

    block: int
    first: int
    begin: int
    end: int
    last: bool


class VectorReader(DataSourceReader):
    def __init__(self, path: str, size: int) -> None:
        self.path, self.size = path, size

    def partitions(self) -> list[Rows]:
        """Cuts by the headers alone; the ids are counted by the tasks that read them."""
        files, at = opened(self.path)
        out, first = [], 0
        for b in blocks(self.path):
            _, n, _ = header(files, f"{at}/{name(b)}.npy")
            cuts = [*range(0, n, self.size), n] if n else [0, 0]
            out += [Rows(b, first, i, j, j == n) for i, j in zip(cuts, cuts[1:], strict=False)]
            first += n
        return out or [Rows(-1, 0, 0, 0, False)]

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        if partition.block < 0:
            return
        files, at = opened(self.path)
        where = f"{at}/{name(partition.block)}"
        offset, n, dim = header(files, f"{where}.npy")
        with files.open_input_file(f"{where}.npy") as vectors, files.open_input_stream(f"{where}.jsonl") as stream:
            lines = itertools.islice(iter_lines(stream), partition.begin, None)
            vectors.seek(offset + 2 * dim * partition.begin)
            for i in range(partition.begin, partition.end, BATCH):
                many = min(BATCH, partition.end - i)
                ids = [json.loads(x)["id"] for x in itertools.islice(lines, many)]
                data = vectors.read(2 * dim * many)
                if len(ids) != many or len(data) != 2 * dim * many:
                    raise ValueError(f"{where}: {n} vectors, but ids or rows end before row {i + many}; put a matching pair of files there, or delete both")
                x = np.frombuffer(data, "<f2").astype(np.float32)
                rows = pa.array(np.arange(partition.first + i, partition.first + i + many))
                lists = pa.ListArray.from_arrays(pa.array(dim * np.arange(many + 1), pa.int32()), pa.array(x))
                yield pa.RecordBatch.from_arrays([rows, pa.array([str(v) for v in ids], pa.string()), lists], ["row", "id", "embedding"])
            if partition.last and next(lines, None) is not None:
                raise ValueError(f"{where}: more ids than its {n} vectors; put a matching pair of files there, or delete both")


def iter_lines(stream: pa.NativeFile, size: int = 1 << 20) -> Iterator[bytes]:
    """Lines of a stream that are not empty, a piece at a time."""
    rest = b""
    while piece := stream.read(size):
        *whole, rest = (rest + piece).split(b"\n")
        yield from (x for x in whole if x.strip())
    if rest.strip():
        yield rest


@dataclass
class Written(WriterCommitMessage):
    """(temporary name, block) of what a task wrote."""

    parts: list[tuple[str, int]]


class VectorWriter(DataSourceWriter):
    """Takes rows in order, whole blocks a task; `rows` is how many the table has in the end."""

    def __init__(self, path: str, stride: int, rows: int) -> None:
        self.path, self.stride, self.rows, self.run = path, stride, rows, uuid.uuid4().hex

    def write(self, iterator: Iterator) -> Written:
        files, at = opened(self.path)
        parts, held, ids, block = [], [], [], None

        def close() -> None:
            if block is None:
                return
            want = min(self.stride, self.rows - block * self.stride)
            if len(ids) != want:
                raise ValueError(f"block {block} of {self.path} needs {want} rows and got {len(ids)}")
            temp = f"{at}/_temporary-{self.run}/{name(block)}-{uuid.uuid4().hex}"
            files.create_dir(f"{at}/_temporary-{self.run}", recursive=True)
            x = np.asarray(held, "<f2").reshape(len(ids), -1)
            with files.open_output_stream(f"{temp}.npy") as out:
                np.lib.format.write_array_header_1_0(out, {"descr": "<f2", "fortran_order": False, "shape": x.shape})
                out.write(x.tobytes())
            with files.open_output_stream(f"{temp}.jsonl") as out:
                out.write("".join(json.dumps({"id": i}, ensure_ascii=False) + "\n" for i in ids).encode())
            parts.append((temp, block))

        for row in iterator:
            if row["row"] // self.stride != block:
                close()
                held, ids, block = [], [], row["row"] // self.stride
            if row["row"] != block * self.stride + len(ids):
                raise ValueError(f"row {row['row']} of {self.path} is out of place: {block * self.stride + len(ids)} comes next")
            held.append(row["embedding"])
            ids.append(row["id"])
        close()
        return Written(parts)

    def commit(self, messages: list[Written | None]) -> None:
        files, at = opened(self.path)
        for kind in ("npy", "jsonl"):
            for temp, block in (p for m in messages if m for p in m.parts):
                files.move(f"{temp}.{kind}", f"{at}/{name(block)}.{kind}")
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        files, at = opened(self.path)
        if files.get_file_info(f"{at}/_temporary-{self.run}").type != fs.FileType.NotFound:
            files.delete_dir(f"{at}/_temporary-{self.run}")


class HalfVectors(DataSource):
    """spark.read.format("half_vectors").load(folder): row, id and embedding of every whole block."""

    @classmethod
    def name(cls) -> str:
        return "half_vectors"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> VectorReader:
        return VectorReader(self.options["path"], int(self.options.get("read", READ)))

    def writer(self, schema: StructType, overwrite: bool) -> VectorWriter:
        if overwrite:
            raise ValueError("half_vectors are appended to; delete the folder to start anew")
        return VectorWriter(self.options["path"], int(self.options.get("stride", STRIDE)), int(self.options["rows"]))


def next_row(path: str, stride: int = STRIDE) -> int:
    """The first row that is not there: blocks beyond a gap do not count."""
    held = set(blocks(path))
    block = 0
    while block in held:
        block += 1
    return block * stride


def write_vectors(rows: DataFrame, path: str, total: int, stride: int = STRIDE) -> int:
    """Write `rows` (row, id, embedding), rows 0 to total - 1, from the first row on that is not there; gives that row.

    Rows that are there already are not read from their vectors: their filter comes before what makes embeddings, if it
    can be pushed there. A null or ragged embedding fails the write, and nothing of it stays.
    """
    spark, begin = rows.sparkSession, next_row(path, stride)
    spark.dataSource.register(HalfVectors)
    left = rows.filter(F.col("row") >= begin)
    if begin < total:
        parts = -(-total // stride) - begin // stride
        block = F.floor(F.col("row") / stride)
        dealt = left.repartitionByRange(max(1, min(parts, 10_000)), block).sortWithinPartitions("row")
        dealt.select("row", F.col("id").cast("string").alias("id"), F.col("embedding").cast("array<float>").alias("embedding")).write.format("half_vectors").mode("append").option("stride", stride).option("rows", total).save(path)
    return begin


def read_vectors(spark: SparkSession, path: str, size: int = READ) -> DataFrame:
    """(row, id, embedding) of a folder; no rows where there is no folder."""
    spark.dataSource.register(HalfVectors)
    return spark.read.format("half_vectors").option("read", size).load(path)
