"""A stream source of volume change records: binary version 2 and 3 records, read by offset.

``spark.readStream.format("change_journal").option("path", folder)`` reads files ``<first offset>.bin`` of a journal dump, a
task a file. ``journal.json`` beside them, where there is one, names the journal (``journal_id``), the first offset that still
counts (``lowest_valid_usn``) and the offset behind the last record (``next_usn``). An offset of the stream is
the journal's id and an update sequence number, so a restarted query goes on where its checkpoint ends.

A cursor may be unusable: the journal was reset, records before its first one are lost, the cursor is ahead of the journal, or the journal
changed while it was read. By default the query fails with that reason; with ``onInvalid=reconcile`` the batch is one row whose
``reconcile`` is the reason (a full scan is needed), and the stream goes on from the journal's present end.

Options: ``path`` (a folder that the executors see, or an address that pyarrow opens), ``maxBytes`` a file (256 MiB), ``onInvalid``,
``startAt`` (``first`` kept record, or ``end``: only what comes later, after a baseline scan), ``maxFiles`` a batch (all that are there).
``maxFiles`` needs ``progress``, a folder of this query's own: Spark asks for a batch's end before it says where the query stands, so the reader notes
where each batch began and bounds the first batch of every start and restart by that.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

HEAD = struct.Struct("<IHH")
V2 = struct.Struct("<QQqqIIIIHH")
V3 = struct.Struct("<16s16sqqIIIIHH")
DIRECTORY = 0x10
SCHEMA = "usn long, at_us long, reason long, is_directory boolean, file_id string, parent_id string, name string, reconcile string"
EPOCH_1601_US = 11_644_473_600_000_000


@dataclass
class Record:
    usn: int
    at_us: int
    reason: int
    is_directory: bool
    file_id: str
    parent_id: str
    name: str


def decode(data: bytes) -> Iterator[Record]:
    """The records of a buffer; a damaged one raises ValueError."""
    at = 0
    while at + HEAD.size <= len(data):
        size, major, _ = HEAD.unpack_from(data, at)
        form = {2: V2, 3: V3}.get(major)
        if size < HEAD.size or at + size > len(data) or size % 8:
            raise ValueError("damaged journal record")
        if form is None:
            at += size
            continue
        if HEAD.size + form.size > size:
            raise ValueError("damaged journal record")
        file, parent, usn, stamp, reason, _, _, attributes, length, offset = form.unpack_from(data, at + HEAD.size)
        if offset + length > size or length % 2:
            raise ValueError("damaged journal record")
        name = data[at + offset : at + offset + length].decode("utf-16-le", "replace")
        ids = [f"{x:016x}" if isinstance(x, int) else x[::-1].hex() for x in (file, parent)]
        yield Record(usn, stamp // 10 - EPOCH_1601_US, reason, bool(attributes & DIRECTORY), *ids, name)
        at += size
    if at != len(data):
        raise ValueError("damaged journal record")


def encode(r: Record, major: int = 2) -> bytes:
    name = r.name.encode("utf-16-le")
    form = V2 if major == 2 else V3
    ids = [int(x, 16) if major == 2 else bytes.fromhex(x.rjust(32, "0"))[::-1] for x in (r.file_id, r.parent_id)]
    offset = HEAD.size + form.size
    size = -(-(offset + len(name)) // 8) * 8
    body = form.pack(*ids, r.usn, (r.at_us + EPOCH_1601_US) * 10, r.reason, 0, 0, DIRECTORY if r.is_directory else 0, len(name), offset)
    return (HEAD.pack(size, major, 0) + body + name).ljust(size, b"\0")


class JournalInvalid(RuntimeError):
    """The cursor cannot be used; the message is the reason."""


@dataclass
class _Part(InputPartition):
    """Records of a file from ``first`` up to ``last``, or the reason for a full scan."""

    name: str
    first: int
    last: int
    journal: str
    reason: str | None = None


class Folder:
    """A journal dump: its files and its present state."""

    def __init__(self, path: str):
        from pyarrow import fs

        self.files, self.path = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)

    def read(self, name: str, most: int | None = None) -> bytes:
        at = f"{self.path.rstrip('/')}/{name}"
        if most is not None and self.files.get_file_info(at).size > most:
            raise JournalInvalid("read_budget_exceeded")
        with self.files.open_input_stream(at) as f:
            return f.read()

    def write(self, name: str, data: bytes) -> None:
        self.files.create_dir(self.path, recursive=True)
        at = f"{self.path.rstrip('/')}/{name}"
        with self.files.open_output_stream(f"{at}.new") as f:
            f.write(data)
        self.files.move(f"{at}.new", at)

    def journal(self) -> str:
        """The journal's id, without a look at its files."""
        try:
            return str(json.loads(self.read("journal.json")).get("journal_id", "0"))
        except FileNotFoundError:
            return "0"

    def state(self) -> tuple[str, int, int, list[int]]:
        """Journal id, first valid offset, offset behind the last record, and the files' first offsets."""
        from pyarrow import fs

        names = [f.base_name for f in self.files.get_file_info(fs.FileSelector(self.path))]
        firsts = sorted(int(n[:-4]) for n in names if n.endswith(".bin"))
        known = json.loads(self.read("journal.json")) if "journal.json" in names else {}
        first = firsts[0] if firsts else 0
        end = known.get("next_usn")
        if end is None:  # from the last file alone
            end = max((r.usn + 1 for r in decode(self.read(f"{firsts[-1]}.bin"))), default=first) if firsts else 0
        return str(known.get("journal_id", "0")), max(first, known.get("lowest_valid_usn", first)), end, firsts


def validity(cursor: dict | None, journal: str, lowest: int, end: int) -> str | None:
    """Why a cursor cannot be read on from, or None."""
    if cursor is None:
        return "initial_baseline_required"
    usn = cursor.get("usn") if isinstance(cursor, dict) else None
    if not isinstance(usn, int) or isinstance(usn, bool) or not isinstance(cursor.get("journal"), str):
        return "invalid_cursor"
    if cursor["journal"] != journal:
        return "journal_reset"
    if usn < lowest:
        return "journal_entries_lost"
    return "cursor_ahead_of_journal" if usn > end else None


class _Reader(DataSourceStreamReader):
    def __init__(self, options):
        self.path, self.most = options["path"], int(options.get("maxFiles", 1 << 62))
        self.bytes, self.reconcile = int(options.get("maxBytes", 256 << 20)), options.get("onInvalid", "fail") == "reconcile"
        self.at_end = options.get("startAt", "first") == "end"
        if self.most < 1 or self.bytes < 4096 or options.get("onInvalid", "fail") not in ("fail", "reconcile"):
            raise ValueError("maxFiles from 1, maxBytes from 4096, onInvalid fail or reconcile")
        self.progress = options.get("progress")
        if "maxFiles" in options and not self.progress:
            raise ValueError("maxFiles needs progress, a folder of this query's own")
        self.done: dict | None = None  # what is behind us, as far as it is known
        self.told: dict | None = None

    def initialOffset(self) -> dict:
        journal, lowest, end, _ = Folder(self.path).state()
        return {"journal": journal, "usn": end if self.at_end else lowest}

    def latestOffset(self) -> dict:
        """The journal's end, or that of ``maxFiles`` files further on.

        What was told last is either planned by now or where the query already was, so it is behind us. At first ``progress`` says
        where the last batch began; without a note there was none.
        """
        self.done = self.told or self.done or (self._noted() if self.progress else None)
        journal, _, end, firsts = Folder(self.path).state()
        if self.done and self.done["journal"] == journal and self.done["usn"] <= end:
            ahead = [f for f, e in zip(firsts, [*firsts[1:], end], strict=True) if e > self.done["usn"]]
            if len(ahead) > self.most:
                end = min(end, ahead[self.most])
        self.told = {"journal": journal, "usn": end}
        return self.told

    def _noted(self) -> dict:
        try:
            return json.loads(Folder(self.progress).read("progress.json"))
        except FileNotFoundError:
            return self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[_Part]:
        if self.progress:
            Folder(self.progress).write("progress.json", json.dumps(start).encode())
        self.done = self.told = end
        journal, lowest, present, firsts = Folder(self.path).state()
        # a batch that is planned again after a failure ends where it ended before
        reason = validity(start, end["journal"], lowest if journal == end["journal"] else 0, end["usn"]) or ("journal_reset_during_read" if journal != end["journal"] else None)
        if reason:
            return [_Part("", start.get("usn", 0), end["usn"], end["journal"], self._refused(reason))]
        ends = [*firsts[1:], present]
        return [_Part(f"{f}.bin", max(f, start["usn"]), min(e, end["usn"]), journal) for f, e in zip(firsts, ends, strict=True) if e > start["usn"] and f < end["usn"]]

    def _refused(self, reason: str) -> str:
        if not self.reconcile:
            raise JournalInvalid(f"{reason}: a full scan is needed")
        return reason

    def read(self, part: _Part):
        if part.reason:
            yield (None,) * 7 + (part.reason,)
            return
        folder = Folder(self.path)
        try:
            data = folder.read(part.name, self.bytes)
            records = [r for r in decode(data) if part.first <= r.usn < part.last]
            if folder.journal() != part.journal:
                raise JournalInvalid("journal_reset_during_read")
        except (FileNotFoundError, JournalInvalid) as e:
            reason = str(e) if isinstance(e, JournalInvalid) else "journal_entries_lost"
            yield (None,) * 7 + (self._refused(reason),)
            return
        for r in records:
            yield r.usn, r.at_us, r.reason, r.is_directory, r.file_id, r.parent_id, r.name, None

    def commit(self, end: dict) -> None:
        """Records stay where they are; the query's checkpoint holds the offset."""

    def stop(self) -> None:
        """Nothing is held open."""


class ChangeJournal(DataSource):
    @classmethod
    def name(cls) -> str:
        return "change_journal"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema):
        return _Reader(self.options)
