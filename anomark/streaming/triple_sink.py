"""Stream sink of anomalies as N-Triples text, seven lines an anomaly, in order and exactly once.

A task sorts its anomalies by their number and writes each run of consecutive numbers as a file of its own under ``_staged``;
its commit message names them. The commit of a micro-batch records the names first and then moves the files to names that
begin with the run's first number, so that files read in the order of their names give the output order. A micro-batch that
is committed again (a retry after a crash) first takes back what its record names; an aborted one leaves nothing.

Rows: (anomaly_no, lines array<string>). Option: ``path``.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, WriterCommitMessage

from anomark.streaming.files import located

SCHEMA = "anomaly_no bigint, lines array<string>"


@dataclass
class Staged(WriterCommitMessage):
    """(staged name, final name) of each run of a task."""

    runs: list[tuple[str, str]] = field(default_factory=list)


class TripleWriter(DataSourceStreamWriter):
    def __init__(self, options: dict):
        self.path = options["path"]

    def write(self, iterator: Iterator) -> Staged:
        rows = sorted((int(r["anomaly_no"]), list(r["lines"])) for r in iterator)
        store, folder = located(self.path)
        out, at = Staged(), 0
        if rows:
            store.create_dir(f"{folder}/_staged", recursive=True)
        while at < len(rows):
            stop = at + 1
            while stop < len(rows) and rows[stop][0] == rows[stop - 1][0] + 1:
                stop += 1
            staged = f"_staged/{uuid.uuid4().hex}.txt"
            with store.open_output_stream(f"{folder}/{staged}") as f:
                f.write("".join(f"{line}\n" for _, lines in rows[at:stop] for line in lines).encode())
            out.runs.append((staged, f"anomalies-{rows[at][0]:020d}.txt"))
            at = stop
        return out

    def _record(self, batch: int) -> str:
        return f"{located(self.path)[1]}/_batches/{batch:010d}.json"

    def commit(self, messages: list[Staged | None], batchId: int) -> None:
        store, folder = located(self.path)
        runs = [run for m in messages if m is not None for run in m.runs]
        store.create_dir(f"{folder}/_batches", recursive=True)
        try:
            with store.open_input_stream(self._record(batchId)) as f:
                earlier = json.loads(f.read())
        except FileNotFoundError:
            earlier = []
        for name in earlier:
            self._drop(f"{folder}/{name}")
        with store.open_output_stream(f"{self._record(batchId)}.next") as f:
            f.write(json.dumps([final for _, final in runs]).encode())
        store.move(f"{self._record(batchId)}.next", self._record(batchId))
        for staged, final in runs:
            store.move(f"{folder}/{staged}", f"{folder}/{final}")

    def abort(self, messages: list[Staged | None], batchId: int) -> None:
        for m in messages:
            for staged, _ in m.runs if m is not None else []:
                self._drop(f"{located(self.path)[1]}/{staged}")

    def _drop(self, path: str) -> None:
        store, _ = located(self.path)
        try:
            store.delete_file(path)
        except FileNotFoundError:
            pass


class AnomalyTriples(DataSource):
    @classmethod
    def name(cls) -> str:
        return "anomaly_triples"

    def schema(self) -> str:
        return SCHEMA

    def streamWriter(self, schema, overwrite: bool) -> TripleWriter:
        return TripleWriter(dict(self.options))
