"""External calls of a run: one budget, pause and provider for all tasks, and a log that lets no answered prompt be asked again."""

from __future__ import annotations

import json
import secrets
import socket
import socketserver
import threading
import time
import uuid
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

#: Parts of a log; a part is written by one task at a time.
SHARDS = 64
#: Records after which a log file that is a second old is closed and another begun, for stores where a file appears only when it is closed.
CLOSE = 50
#: Calls that a task may take at once, and the seconds for which it may: only calls that are quicker than that are taken together.
AHEAD, SPELL = 256, 0.05


class Gate:
    """What the tasks of a run share: calls left, the pause that the service asked for, the provider in use, and usage.

    A server in the driver answers the tasks over sockets; it starts with the gate and ends with close(). A
    connection holds the shards that it has leased until it ends, so of two attempts of a task (a
    speculative one, or one whose executor is taken for lost) only one asks at a time.
    """

    def __init__(self, spark: SparkSession, budget: int, pause: tuple[float, float] = (5.0, 120.0)) -> None:
        self.run = uuid.uuid4().hex
        self._secret, self._changed = secrets.token_hex(16), threading.Condition()
        self._left, self._pause, self._wait, self._until, self._provider = budget, pause, pause[0], 0.0, 0
        self._used: Counter[str] = Counter()
        self._leases: dict[str, object] = {}
        self._ahead: dict[object, int] = {}
        host = spark.conf.get("spark.driver.host", "127.0.0.1")
        gate = self

        class Handler(socketserver.StreamRequestHandler):
            def handle(self) -> None:
                try:
                    if self.rfile.readline().decode().strip() != gate._secret:
                        return
                    for line in self.rfile:
                        name, *given = json.loads(line)
                        own = {"lease": gate._lease, "turn": gate._turn}.get(name)
                        if name == "used":  # of the calls taken ahead; not answered
                            gate._used_one(self, *given)
                            continue
                        answer = own(self, *given) if own else gate._do(name, *given)
                        self.wfile.write(json.dumps(answer).encode() + b"\n")
                except OSError:  # the task is gone
                    pass
                finally:
                    gate._release(self)

        class Server(socketserver.ThreadingTCPServer):
            daemon_threads = True
            request_queue_size = 1024

        self._server = Server((spark.conf.get("spark.driver.bindAddress", host), 0), Handler)
        self.address = (host, self._server.server_address[1])
        threading.Thread(target=self._server.serve_forever, daemon=True).start()

    def client(self) -> Client:
        """The tasks' side; it can be shipped."""
        return Client(self.address, self._secret, self.run)

    @property
    def left(self) -> int:
        with self._changed:
            return self._left

    def usage(self) -> dict[str, int]:
        """Calls, answers, failures, throttles and tokens so far, also while tasks run; a call that a lost task made counts."""
        with self._changed:
            return dict(self._used)

    def close(self) -> None:
        self._server.shutdown()
        self._server.server_close()

    def __enter__(self) -> Gate:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()

    def _lease(self, holder: object, shard: str) -> bool:
        with self._changed:
            while self._leases.get(shard, holder) is not holder:
                self._changed.wait(1.0)
            self._leases[shard] = holder
        return True

    def _release(self, holder: object) -> None:
        with self._changed:
            self._leases = {s: h for s, h in self._leases.items() if h is not holder}
            self._left += self._ahead.pop(holder, 0)
            self._changed.notify_all()

    def _answers(self, answered: int, tokens_in: int, tokens_out: int) -> None:
        if answered:
            self._wait = self._pause[0]
            self._used.update({"answered": answered, "tokens_in": tokens_in, "tokens_out": tokens_out})

    def _used_one(self, holder: object, *answers: int) -> None:
        with self._changed:
            self._ahead[holder] -= 1
            self._used["calls"] += 1
            self._answers(*answers)

    def _turn(self, holder: object, answered: int, tokens_in: int, tokens_out: int, wanted: int) -> tuple[float, int, int]:
        """Takes back what a task has left of the calls it took ahead; gives it the pause to keep, or the provider and up to `wanted` calls.

        When the budget is spent it waits for what others have taken ahead, so nothing of it is left unused.
        """
        with self._changed:
            self._answers(answered, tokens_in, tokens_out)
            self._left += self._ahead.pop(holder, 0)
            self._changed.notify_all()
            while wanted and self._left <= 0 and any(self._ahead.values()):
                self._changed.wait(1.0)
            if wanted and (pause := max(0.0, self._until - time.monotonic())):
                return pause, self._provider, 0
            n = min(wanted, max(1, self._left // (2 * SHARDS)), max(0, self._left))
            self._left -= n
            if n:  # the first is made at once
                self._ahead[holder] = n - 1
                self._used["calls"] += 1
            return 0.0, self._provider, n

    def _do(self, name: str, *given: int) -> object:
        with self._changed:
            if name == "throttled":
                self._until = max(self._until, time.monotonic() + self._wait)
                self._wait = min(2 * self._wait, self._pause[1])
                self._used["throttled"] += 1
            if name == "failed":
                self._used["failed"] += 1
            if name == "switch":  # only the first task that saw the provider fail moves on
                if given[0] == self._provider and self._provider + 1 < given[1]:
                    self._provider += 1
                    self._used["switched"] += 1
                return self._provider
        return True


class Client:
    """A task's connection to the gate."""

    def __init__(self, address: tuple[str, int], secret: str, run: str) -> None:
        self.address, self.secret, self.run = address, secret, run

    def open(self) -> Client:
        self.file = socket.create_connection(self.address).makefile("rw", encoding="utf-8", newline="\n")
        self.file.write(self.secret + "\n")
        self._mine, self._size, self._until, self._provider, self._done = 0, 1, 0.0, 0, [0, 0, 0]
        return self

    def take(self, sleep: Callable[[float], None]) -> int | None:
        """The provider to call, once any pause is over; none when the budget is spent.

        Calls that follow each other within SPELL seconds are taken several at once; a slower one is
        taken by itself, so a pause or another provider holds from the next call on.
        """
        now = time.monotonic()
        if not self._mine or now >= self._until:
            self._size = min(AHEAD, 2 * self._size) if now < self._until else 1
            while (turn := self._turn(self._size))[0]:
                sleep(turn[0])
            _, self._provider, self._mine = turn
            self._until = time.monotonic() + SPELL
            if not self._mine:
                return None
        else:
            self.file.write(json.dumps(("used", *self._done)) + "\n")
            self.file.flush()
            self._done = [0, 0, 0]
        self._mine -= 1
        return self._provider

    def answered(self, tokens_in: int = 0, tokens_out: int = 0) -> None:
        self._done = [a + b for a, b in zip(self._done, (1, tokens_in, tokens_out), strict=True)]

    def _turn(self, wanted: int) -> tuple[float, int, int]:
        done, self._mine, self._done = self._done, 0, [0, 0, 0]
        return tuple(self("turn", *done, wanted))

    def __call__(self, *what: object) -> object:
        if what[0] in ("throttled", "switch"):  # what was taken ahead goes back before the next call
            self._until = 0.0
        self.file.write(json.dumps(what) + "\n")
        self.file.flush()
        line = self.file.readline()
        if not line:
            raise ConnectionError("the gate of this run is closed")
        return json.loads(line)

    def close(self) -> None:
        try:
            if self._mine or any(self._done):
                self._turn(0)
        except OSError:  # the gate is closed
            pass
        finally:
            self.file.close()


class Log:
    """Records by key in a folder that driver and executors share, as lines of JSON in a subfolder per shard.

    Each attempt of a task writes files of its own and flushes every record, so that a task that is
    killed leaves all that it got; a torn last line is passed over.
    """

    def __init__(self, path: str) -> None:
        self.path = path

    def _open(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.path)

    def read(self, shard: str) -> dict[str, dict]:
        """The last record of each key of a shard."""
        files, root = self._open()
        found = files.get_file_info(fs.FileSelector(f"{root}/{shard}", allow_not_found=True))
        out: dict[str, dict] = {}
        for info in sorted((x for x in found if x.is_file), key=lambda x: x.path):
            with files.open_input_stream(info.path) as stream:
                for line in stream.read().split(b"\n"):
                    try:
                        record = json.loads(line)
                    except ValueError:
                        continue
                    out[record["key"]] = record
        return out

    def writer(self, shard: str) -> Writer:
        return Writer(self, shard)

    def table(self, spark: SparkSession, value: str) -> DataFrame:
        """All records, of every run: key, run and the fields of the schema `value`."""
        files, root = self._open()
        schema = f"key string, run string, {value}"
        if files.get_file_info(root).type == fs.FileType.NotFound:
            return spark.createDataFrame([], schema)
        return spark.read.schema(schema).option("recursiveFileLookup", "true").option("mode", "DROPMALFORMED").json(self.path)


class Writer:
    """Appends records of a shard."""

    def __init__(self, log: Log, shard: str) -> None:
        self.files, root = log._open()
        self.folder, self.stream, self.n = f"{root}/{shard}", None, 0
        self.files.create_dir(self.folder, recursive=True)

    def add(self, records: Iterable[dict]) -> None:
        if self.stream is None:
            # Names go up with time, so a later record of a key is read last.
            self.stream, self.since = self.files.open_output_stream(f"{self.folder}/{time.time_ns():020d}-{uuid.uuid4().hex}.jsonl"), time.monotonic()
        for record in records:
            self.stream.write(json.dumps(record).encode() + b"\n")
            self.n += 1
        self.stream.flush()
        if self.n >= CLOSE and time.monotonic() - self.since >= 1.0:
            self.close()

    def close(self) -> None:
        if self.stream is not None:
            self.stream.close()
        self.stream, self.n = None, 0


def by_shard(rows: Iterator[tuple[str, str, object]], log: Log, client: Client | None) -> Iterator[tuple[str, object, dict, Writer]]:
    """key, row, the shard's records and its writer, for rows of (shard, key, row) in order of shard."""
    now, known, writer = None, {}, None
    try:
        for shard, key, row in rows:
            if shard != now:
                if writer:
                    writer.close()
                if client:
                    client("lease", shard)
                now, known, writer = shard, log.read(shard), log.writer(shard)
            yield key, row, known, writer
    finally:
        if writer:
            writer.close()
