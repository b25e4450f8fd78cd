"""Members of ZIP archives that are cut into parts, as a Python data source: partitions of members, not of archives.

The transport is a callable, `read(part, start, end) -> bytes`, so that parts may lie behind HTTP ranges,
in an object store or in a folder. Planning reads central directories alone, from the archives' ends. Members that are
wanted (by suffix, and by filters on archive, member and crc that Spark pushes down) are put together into partitions of
so many bytes, in the order in which they lie, so one archive is read by many tasks and nobody fetches what isn't wanted.
A task fetches the range of each of its members, inflates it and checks its CRC; a lost task costs its own members.
"""

from __future__ import annotations

import io
import time
import zipfile
import zlib
from collections.abc import Callable, Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, StringEndsWith, StringStartsWith

Transport = Callable[[str, int, int], bytes]


class Parts(io.RawIOBase):
    """Parts laid end to end as one seekable file; only what is asked for is fetched.

    Failed and short fetches are tried again, each time after twice the wait.
    """

    def __init__(self, parts: list[tuple[str, int]], read: Transport, tries: int = 3, wait: float = 0.5):
        self.parts, self.fetch, self.tries, self.wait, self.at = parts, read, tries, wait, 0
        self.size = sum(n for _, n in parts)

    def seekable(self) -> bool:
        return True

    def readable(self) -> bool:
        return True

    def tell(self) -> int:
        return self.at

    def seek(self, offset: int, whence: int = io.SEEK_SET) -> int:
        self.at = offset + {io.SEEK_SET: 0, io.SEEK_CUR: self.at, io.SEEK_END: self.size}[whence]
        return self.at

    def _range(self, name: str, start: int, end: int) -> bytes:
        for k in range(self.tries):
            if k:
                time.sleep(self.wait * 2 ** (k - 1))
            try:
                raw = self.fetch(name, start, end)
                if len(raw) == end - start:
                    return raw
            except OSError:
                if k + 1 == self.tries:
                    raise
        raise OSError(f"{name}: a range came short")

    def readinto(self, buffer) -> int:
        raw = self.read(len(buffer))
        buffer[: len(raw)] = raw
        return len(raw)

    def read(self, size: int = -1) -> bytes:
        end = self.size if size is None or size < 0 else min(self.size, self.at + size)
        out, base = [], 0
        for name, n in self.parts:
            a, b = max(self.at, base), min(end, base + n)
            if a < b:
                out.append(self._range(name, a - base, b - base))
            base += n
        self.at = max(self.at, end)
        return b"".join(out)


def members(parts: list[tuple[str, int]], read: Transport, wanted: Callable[[str], bool] = lambda name: True) -> Iterator[tuple[str, int, bytes]]:
    """(name, CRC, content) of the wanted members."""
    with zipfile.ZipFile(io.BufferedReader(Parts(parts, read), 1 << 16)) as archive:
        for info in archive.infolist():
            if not info.is_dir() and wanted(info.filename):
                content = archive.read(info)
                if zlib.crc32(content) != info.CRC:
                    raise OSError(f"{info.filename}: wrong CRC")
                yield info.filename, info.CRC, content


class Members(InputPartition):
    """Members of one archive: (name, CRC, method, place, bytes, content's bytes) each."""

    def __init__(self, archive: str, parts: list[tuple[str, int]], wanted: list[tuple]):
        super().__init__(f"{archive}:{wanted[0][3]}")
        self.archive, self.parts, self.wanted = archive, parts, wanted


def directory(parts: list[tuple[str, int]], read: Transport) -> list[tuple]:
    """An archive's members in the order in which they lie, from its central directory."""
    with zipfile.ZipFile(io.BufferedReader(Parts(parts, read), 1 << 16)) as archive:
        found = [(i.filename, i.CRC, i.compress_type, i.header_offset, i.compress_size, i.file_size) for i in archive.infolist() if not i.is_dir()]
    return sorted(found, key=lambda m: m[3])


def grouped(members_: list[tuple], most: int) -> Iterator[list[tuple]]:
    """Neighbours of `most` bytes together; a larger member is a group of its own."""
    group, size = [], 0
    for m in members_:
        if group and size + m[4] > most:
            yield group
            group, size = [], 0
        group.append(m)
        size += m[4]
    if group:
        yield group


#: A member's local header: fixed bytes, and where the lengths of its name and extra field stand.
HEADER, LENGTHS = 30, slice(26, 30)


def content(parts: Parts, member: tuple) -> bytes:
    """A member's content, fetched by its range and checked."""
    name, crc, method, place, size, whole = member
    parts.seek(place)
    head = parts.read(HEADER)
    parts.seek(place + HEADER + int.from_bytes(head[LENGTHS][:2], "little") + int.from_bytes(head[LENGTHS][2:], "little"))
    raw = parts.read(size)
    if method == zipfile.ZIP_DEFLATED:
        raw = zlib.decompress(raw, -zlib.MAX_WBITS)
    elif method != zipfile.ZIP_STORED:
        raise OSError(f"{name}: compression method {method}")
    if len(raw) != whole or zlib.crc32(raw) != crc:
        raise OSError(f"{name}: wrong CRC")
    return raw


class ArchiveSource(DataSource):
    """Subclass with `archives()` and `transport()`; register with spark.dataSource.register.

    Options: suffix (of wanted members), bytes (of a partition). Filters are pushed where the session allows it for Python
    sources (spark.sql.python.filterPushdown.enabled) and the option "pushdown" is "true".
    """

    @classmethod
    def name(cls) -> str:
        return "split_archive"

    def schema(self) -> str:
        return "archive string, member string, crc long, content binary"

    def archives(self) -> dict[str, list[tuple[str, int]]]:
        raise NotImplementedError

    def transport(self) -> Transport:
        raise NotImplementedError

    def reader(self, schema) -> DataSourceReader:
        kind = _PushingReader if self.options.get("pushdown", "false") == "true" else _Reader
        return kind(self.archives(), self.transport(), self.options.get("suffix", ""), int(self.options.get("bytes", 32 << 20)))


class _Reader(DataSourceReader):
    def __init__(self, archives: dict, read: Transport, suffix: str, most: int):
        self.archives, self.fetch, self.suffix, self.most, self.tests = archives, read, suffix, most, []

    def _wanted(self, archive: str, member: tuple) -> bool:
        row = {"archive": archive, "member": member[0], "crc": member[1]}
        return member[0].endswith(self.suffix) and all(test(row) for test in self.tests)

    def partitions(self) -> list[InputPartition]:
        out = []
        for archive, parts in sorted(self.archives.items()):
            wanted = [m for m in directory(parts, self.fetch) if self._wanted(archive, m)]
            out += [Members(archive, parts, g) for g in grouped(wanted, self.most)]
        return out

    def read(self, partition: Members) -> Iterator[tuple]:
        parts = Parts(partition.parts, self.fetch)
        for member in partition.wanted:
            yield partition.archive, member[0], member[1], content(parts, member)


class _PushingReader(_Reader):
    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes what the central directory can answer; Spark filters by the rest."""
        for f in filters:
            test = _test(f)
            if test:
                self.tests.append(test)
            else:
                yield f


def _test(f: Filter) -> Callable[[dict], bool] | None:
    column = getattr(f, "attribute", ())
    if len(column) != 1 or column[0] not in ("archive", "member", "crc"):
        return None
    name, value = column[0], getattr(f, "value", None)
    if isinstance(f, EqualTo):
        return lambda row: row[name] == value
    if isinstance(f, In):
        return lambda row: row[name] in value
    if isinstance(f, StringStartsWith):
        return lambda row: row[name].startswith(value)
    if isinstance(f, StringEndsWith):
        return lambda row: row[name].endswith(value)
    return (lambda row: True) if isinstance(f, IsNotNull) else None
