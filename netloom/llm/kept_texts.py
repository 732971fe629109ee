"""Documents kept in a table of the shared folder, read by tasks that need their texts again."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

from netloom.llm.shared import fresh_path


_PART = re.compile(r"(.*/part-)([0-9]+)(-[^/]*)", re.S)


class Texts:
    """A document is known by its file and its row there, which stay the same whatever runs again.

    Tasks get the numbers in the files' names, 4 bytes a file, and what is the same in all of them.
    """

    def __init__(self, path: str):
        self.path = path
        store, root = fs.FileSystem.from_uri(path)
        found = sorted((x.path, x.size) for x in store.get_file_info(fs.FileSelector(root)) if x.path.endswith(".parquet"))
        self.size = sum(size for _, size in found)
        names = [_PART.fullmatch(name).groups() for name, _ in found]
        self.alike = sorted({(head, len(number), tail) for head, number, tail in names})
        order = {x: k for k, x in enumerate(self.alike)}
        self.numbers = np.array([int(n) for _, n, _ in names], np.int32)
        self.kinds = np.array([order[h, len(n), t] for h, n, t in names] if len(order) > 1 else [], np.int32)

    @classmethod
    def of(cls, docs: DataFrame, name: str) -> Texts:
        path = fresh_path(docs.sparkSession, name)
        docs.write.option("compression", "zstd").parquet(path)
        return cls(path)

    def __len__(self) -> int:
        """How many files there are."""
        return len(self.numbers)

    def file(self, k: int) -> str:
        head, digits, tail = self.alike[self.kinds[k] if len(self.kinds) else 0]
        return f"{head}{self.numbers[k]:0{digits}d}{tail}"

    def every_file(self, spark: SparkSession) -> DataFrame:
        """The numbers of the files, each in a partition of its own."""
        return spark.range(0, len(self), 1, max(1, len(self)))

    def batches(self, file: int, columns: list[str] | None = None, size: int = 1000) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(self.path)
        with store.open_input_file(self.file(file)) as f:
            yield from pq.ParquetFile(f).iter_batches(size, columns=columns)

    def rows(self, file: int, column: str) -> Iterator[tuple[int, bytes]]:
        """Row and UTF-8 text of every document of a file; a null text is empty."""
        row = 0
        for batch in self.batches(file, [column]):
            for text in batch.column(0):
                yield row, (text.as_py() or "").encode()
                row += 1
