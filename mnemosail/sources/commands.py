"""A source over commands that print JSON: one input partition for each, and a failing one does not stop the others.

Every item that a command prints is a row with its kind. A command that cannot be started, ends with an error, takes too
long or prints what is no JSON gives one row with the reason instead, beside the items that came before it.
Output is read line by line where items come one to a line, so it is never whole in memory; a single JSON array is read whole.
What a task that runs again delivers replaces what it had delivered.
"""

from __future__ import annotations

import json
import subprocess
import tempfile
import threading
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

SCHEMA = "kind string, item string, error string"


@dataclass
class Command(InputPartition):
    kind: str
    words: list[str]
    timeout: float

    def __post_init__(self):
        super().__init__(self.kind)


def items(command: Command, most: int = 300) -> Iterator[tuple[str, str | None, str | None]]:
    """(kind, item as JSON, null) of each item; (kind, null, reason) of a failure, whose message is cut at ``most`` characters."""
    kind, late = command.kind, threading.Event()
    with tempfile.TemporaryFile() as said:
        try:
            run = subprocess.Popen(command.words, stdin=subprocess.DEVNULL, stdout=subprocess.PIPE, stderr=said)
        except OSError as error:
            yield kind, None, f"{type(error).__name__}: {error}"[:most]
            return

        def stop() -> None:
            late.set()
            run.kill()

        clock = threading.Timer(command.timeout, stop)
        clock.start()
        reason = None
        try:
            for line in run.stdout:
                text = line.strip()
                if not text or reason:
                    continue
                try:
                    value = json.loads(text + run.stdout.read() if text == b"[" else text)
                except ValueError as error:
                    reason = f"no JSON: {error}"
                    continue
                for item in value if isinstance(value, list) else [value]:
                    yield kind, json.dumps(item, ensure_ascii=False), None
            code = run.wait()
        finally:
            clock.cancel()
            run.kill()
            run.wait()
            run.stdout.close()
        if late.is_set():
            reason = f"no end after {command.timeout:g} s"
        elif code:
            said.seek(0)
            reason = f"exit {code}: {said.read(4 * most).decode('utf-8', 'replace').strip()}"
        if reason:
            yield kind, None, reason[:most]


class CommandReader(DataSourceReader):
    def __init__(self, options: dict):
        self.commands = [Command(kind, words, float(options.get("timeout", "300"))) for kind, words in json.loads(options["commands"])]

    def partitions(self) -> list[Command]:
        return self.commands

    def read(self, part: Command) -> Iterator[tuple]:
        return items(part)


class Commands(DataSource):
    @classmethod
    def name(cls) -> str:
        return "commands"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return CommandReader(self.options)


def command_items(spark: SparkSession, commands: dict[str, list[str]], timeout: float = 300) -> DataFrame:
    """kind, item, error of the commands, by kind. They run on executors, which need what they call."""
    spark.dataSource.register(Commands)
    return spark.read.format("commands").options(commands=json.dumps(list(commands.items())), timeout=str(timeout)).load()
