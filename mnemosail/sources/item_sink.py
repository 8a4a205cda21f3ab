"""A sink that sends items by id to a service, with retries.

Each row is one request that replaces the item of its id, so a task that runs twice leaves each item once.
A request is tried ``attempts`` times, with waits that double from ``wait`` seconds. What fails for good does not stop the
rest: it is listed, with the reason, in one file for each task below ``report``, and counted in ``report``/summary.json, which is
written when all tasks are done.

Options: ``endpoint`` (items go to ``<endpoint>/<id>`` by PUT, as JSON), ``report`` (URI of a folder that driver and executors
share), ``id`` (name of the id column, ``id``), ``attempts`` (3), ``wait`` (1.0), ``timeout`` (30), ``token``. Rows without an id are not sent and listed as failed.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from .changed_files import file_system


@dataclass
class Sent(WriterCommitMessage):
    ok: int
    failed: int


def put(endpoint: str, item_id: str, body: bytes, timeout: float, token: str | None) -> None:
    """One request; raises if the service does not accept it."""
    request = urllib.request.Request(f"{endpoint.rstrip('/')}/{urllib.parse.quote(item_id, safe='')}", body, {"Content-Type": "application/json"}, method="PUT")
    if token:
        request.add_header("Authorization", f"Bearer {token}")
    with urllib.request.urlopen(request, timeout=timeout) as answer:
        answer.read()


def hopeless(error: Exception) -> bool:
    """Requests that the service will refuse again."""
    return isinstance(error, urllib.error.HTTPError) and 400 <= error.code < 500 and error.code not in (408, 429)


def tried(send: Callable[[], None], attempts: int, wait: float, sleep: Callable[[float], None] = time.sleep) -> str | None:
    """Null once ``send`` has worked, else the last reason."""
    for k in range(attempts):
        try:
            send()
            return None
        except OSError as error:  # of urllib too
            reason = f"{type(error).__name__}: {error}"
            if hopeless(error):
                return reason
            if k + 1 < attempts:
                sleep(wait * 2**k)
    return reason


class ItemWriter(DataSourceWriter):
    def __init__(self, options: dict):
        self.endpoint, self.report, self.id = options["endpoint"], options["report"], options.get("id", "id")
        self.attempts, self.wait = int(options.get("attempts", "3")), float(options.get("wait", "1.0"))
        self.timeout, self.token = float(options.get("timeout", "30")), options.get("token")

    def _write(self, name: str, text: str) -> None:
        fs, root = file_system(self.report)
        fs.create_dir(root, recursive=True)
        with fs.open_output_stream(f"{root.rstrip('/')}/{name}") as f:
            f.write(text.encode())

    def write(self, rows: Iterator) -> Sent:
        ok, lines = 0, []
        for row in rows:
            item = row.asDict(recursive=True)
            key = item[self.id]
            body = json.dumps(item, default=str).encode()
            reason = "no id" if key is None else tried(lambda key=key, body=body: put(self.endpoint, str(key), body, self.timeout, self.token), self.attempts, self.wait)
            if reason is None:
                ok += 1
            else:
                lines.append(json.dumps({"id": key, "reason": reason}, default=str))
        # by partition, so a task that runs again replaces its list
        self._write(f"failed-{TaskContext.get().partitionId():05}.json", "".join(f"{x}\n" for x in lines))
        return Sent(ok, len(lines))

    def commit(self, messages: list[Sent | None]) -> None:
        done = [m for m in messages if m is not None]
        self._write("summary.json", json.dumps({"sent": sum(m.ok for m in done), "failed": sum(m.failed for m in done)}))

    def abort(self, messages: list[Sent | None]) -> None:
        """What was sent stays; sending it again changes nothing."""


class ItemSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "items"

    def schema(self) -> str:
        return "id string"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return ItemWriter(self.options)


def send_items(df: DataFrame, endpoint: str, report: str, **options) -> dict:
    """Sends all rows; what was sent and what failed, in numbers."""
    df.sparkSession.dataSource.register(ItemSink)
    df.write.format("items").mode("append").options(endpoint=endpoint, report=report, **{k: str(v) for k, v in options.items()}).save()
    fs, root = file_system(report)
    with fs.open_input_stream(f"{root.rstrip('/')}/summary.json") as f:
        return json.loads(f.read())
