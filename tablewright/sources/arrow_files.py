"""Feather / Arrow IPC files as a Spark data source: one input partition per file, batches pass through as Arrow."""

from __future__ import annotations

import glob
import os
import uuid

import pyarrow as pa
import pyarrow.ipc as ipc
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import from_arrow_schema


def _files(path: str) -> list[str]:
    if os.path.isdir(path):
        found = [f for ext in ("feather", "arrow", "ipc") for f in glob.glob(os.path.join(path, f"*.{ext}"))]
    else:
        found = glob.glob(path)
    if not found:
        raise FileNotFoundError(path)
    return sorted(found)


def _plain(schema: pa.Schema) -> pa.Schema:
    """Metadata-free schema with plain string types."""
    fields = []
    for f in schema:
        kind = pa.string() if pa.types.is_large_string(f.type) or pa.types.is_dictionary(f.type) else f.type
        fields.append(pa.field(f.name, kind))
    return pa.schema(fields)


class FilePartition(InputPartition):
    def __init__(self, path: str):
        self.path = path


class ArrowReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self):
        return [FilePartition(f) for f in _files(self.path)]

    def read(self, partition):
        with pa.memory_map(partition.path) as source:
            reader = ipc.open_file(source)
            target = _plain(reader.schema)
            for i in range(reader.num_record_batches):
                batch = pa.Table.from_batches([reader.get_batch(i)]).cast(target)
                yield from batch.to_batches()


class Written(WriterCommitMessage):
    def __init__(self, path: str):
        self.path = path


class ArrowFileWriter(DataSourceArrowWriter):
    """Each task writes its own file under a temporary name; commit renames them into place."""

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.job = path, overwrite, uuid.uuid4().hex

    def write(self, iterator):
        from pyspark import TaskContext

        context = TaskContext.get()
        os.makedirs(self.path, exist_ok=True)
        target = os.path.join(self.path, f".{self.job}-{context.partitionId()}-{context.taskAttemptId()}")
        writer = None
        for batch in iterator:
            if writer is None:
                writer = ipc.new_file(target, batch.schema)
            writer.write_batch(batch)
        if writer is None:
            return Written("")
        writer.close()
        return Written(target)

    def commit(self, messages):
        old = [f for f in glob.glob(os.path.join(self.path, "part-*.feather"))] if self.overwrite else []
        for message in messages:
            if message is not None and message.path:
                name = os.path.basename(message.path).split("-")[1]
                os.rename(message.path, os.path.join(self.path, f"part-{self.job[:8]}-{name}.feather"))
        for f in old:
            os.remove(f)

    def abort(self, messages):
        for message in messages:
            if message is not None and message.path and os.path.exists(message.path):
                os.remove(message.path)


class FeatherSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "feather"

    def schema(self):
        with pa.memory_map(_files(self.options["path"])[0]) as source:
            return from_arrow_schema(_plain(ipc.open_file(source).schema))

    def reader(self, schema):
        return ArrowReader(self.options["path"])

    def writer(self, schema, overwrite):
        return ArrowFileWriter(self.options["path"], overwrite)
