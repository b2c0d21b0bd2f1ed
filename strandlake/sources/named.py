"""Text files of given names, as a Python data source: df.write.format("named_text").option("folder", ...).mode("append").save().

Rows have a name and a value, a line or several. Each task writes the names it has to files of its own attempt, under a temporary folder
beside the results; the driver only renames them once all tasks are done, so a failed or repeated task leaves nothing half written.
Rows of one name have to be in one task: see sinks.write_named().
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from strandlake.sources.bam import _store


@dataclass
class Written(WriterCommitMessage):
    """Names and the files that hold them."""

    files: list[tuple[str, str]] = field(default_factory=list)


class NamedWriter(DataSourceWriter):
    def __init__(self, options):
        self.folder = options["folder"].rstrip("/")
        self.header = options.get("header")
        self.temporary = f"{self.folder}/_named-{uuid.uuid4().hex}"

    def _place(self, path: str):
        return _store(path)

    def write(self, iterator):
        out, name, stream = Written(), None, None
        attempt = f"{self.temporary}/{uuid.uuid4().hex}"
        try:
            for row in iterator:
                if row[0] != name:
                    if stream is not None:
                        stream.close()
                    name = row[0]
                    if not name or "/" in name:
                        raise ValueError(f"no file name: {name!r}")
                    store, place = self._place(attempt)
                    store.create_dir(place, recursive=True)
                    stream = store.open_output_stream(f"{place}/{len(out.files)}")
                    out.files.append((name, f"{attempt}/{len(out.files)}"))
                    if self.header is not None:
                        stream.write(self.header.encode() + b"\n")
                if row[1] is not None:
                    stream.write(row[1].encode() + b"\n")
        finally:
            if stream is not None:
                stream.close()
        return out

    def commit(self, messages):
        found = [f for m in messages if m is not None for f in m.files]
        names = [n for n, _ in found]
        if len(set(names)) < len(names):
            self.abort(messages)
            raise ValueError("a name was written by more than one task")
        for name, path in found:
            store, place = self._place(path)
            target = self._place(f"{self.folder}/{name}")[1]
            if store.get_file_info(target).is_file:
                store.delete_file(target)
            store.move(place, target)
        self.abort(messages)

    def abort(self, messages):
        store, place = self._place(self.temporary)
        if store.get_file_info(place).type.name == "Directory":
            store.delete_dir(place)


class NamedText(DataSource):
    """Options: folder, and header, a first line of every file. Files of the same names are replaced."""

    @classmethod
    def name(cls):
        return "named_text"

    def schema(self):
        return "name string, value string"

    def writer(self, schema, overwrite):
        return NamedWriter(self.options)
