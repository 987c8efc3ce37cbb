"""CoNLL-U as a Spark data source: ``spark.dataSource.register(ConlluSource)``, then
``spark.read.format("conllu").load(path)`` and ``df.write.format("conllu").save(path)``.

Reading: one partition a file, rows stream out sentence by sentence. Writing takes rows of
(doc_id, value) as ``write_conllu`` makes them; each task writes one file, named for its
partition, and the files of failed attempts are removed.
"""
from __future__ import annotations

import glob
import os
import uuid
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

COLUMNS = ("id", "form", "lemma", "upos", "xpos", "feats", "head", "deprel", "deps", "misc")


class ConlluSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "conllu"

    def schema(self) -> str:
        return "file string, doc_id string, sent_ord int, " + ", ".join(f"{c} string" for c in COLUMNS)

    def reader(self, schema) -> DataSourceReader:
        return ConlluReader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return ConlluWriter(self.options["path"], schema.names.index("value"), overwrite)


class ConlluReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self):
        files = sorted(glob.glob(os.path.join(self.path, "**", "*.conllu"), recursive=True)) if os.path.isdir(self.path) else sorted(glob.glob(self.path))
        return [InputPartition(f) for f in files]

    def read(self, partition):
        if partition is None or partition.value is None:
            return
        name = os.path.splitext(os.path.basename(partition.value))[0]
        doc, sent, inside = name, -1, False
        with open(partition.value, encoding="utf-8", errors="replace") as lines:
            for line in lines:
                line = line.rstrip("\r\n")
                if line.startswith("# newdoc"):
                    doc = line.partition("id =")[2].strip() or name
                    sent = -1
                elif line and not line.startswith("#"):
                    cells = line.split("\t")
                    if len(cells) == 10:
                        if not inside:
                            sent, inside = sent + 1, True
                        yield (partition.value, doc, sent, *(None if c == "_" and i not in (0, 1) else c for i, c in enumerate(cells)))
                elif not line:
                    inside = False


@dataclass
class Written(WriterCommitMessage):
    path: str


class ConlluWriter(DataSourceWriter):
    def __init__(self, path: str, at: int, overwrite: bool):
        self.path, self.at, self.overwrite, self.run = path, at, overwrite, uuid.uuid4().hex[:8]

    def write(self, iterator):
        from pyspark import TaskContext

        context = TaskContext.get()
        os.makedirs(self.path, exist_ok=True)
        target = os.path.join(self.path, f"part-{context.partitionId():05d}-{self.run}-{context.taskAttemptId()}.conllu")
        with open(target, "w", encoding="utf-8") as out:
            for row in iterator:
                if row[self.at] is not None:
                    out.write(row[self.at])
        return Written(target)

    def commit(self, messages) -> None:
        kept = {m.path for m in messages if m}
        for f in glob.glob(os.path.join(self.path, "part-*.conllu")):
            if f not in kept and (self.overwrite or f"-{self.run}-" in f):
                os.remove(f)

    def abort(self, messages) -> None:
        for f in glob.glob(os.path.join(self.path, f"part-*-{self.run}-*.conllu")):
            os.remove(f)
