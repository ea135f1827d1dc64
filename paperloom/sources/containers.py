"""Archives: zip and compound files as tables of entries; paths; virtual filesystems."""

from __future__ import annotations

import hashlib
import io
import posixpath
import struct
import zipfile

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..dims import file_type_rows, type_by_extension
from ..functions.text import human_size

ENTRIES = "file_id long, entry_ix int, entry_path string, is_file boolean, size long, method string, mimetype string, content binary, error string"
#: Inflated bytes of one entry beyond which it is reported, not read.
MAX_ENTRY_BYTES = 1 << 30


class BadContainer(ValueError):
    """The bytes promise a container and are none."""


_END, _FREE = 0xFFFFFFFE, 0xFFFFFFFF


class CompoundFile:
    """An OLE2 compound file: sectors, chains, directory."""

    def __init__(self, data: bytes):
        if data[:8] != bytes.fromhex("D0CF11E0A1B11AE1") or len(data) < 512:
            raise BadContainer("no compound file header")
        self.data = data
        shift, mini_shift = struct.unpack_from("<HH", data, 30)
        if shift not in (9, 12) or mini_shift != 6:
            raise BadContainer("sector sizes")
        self.sector, self.mini = 1 << shift, 1 << mini_shift
        n_fat, first_dir = struct.unpack_from("<I", data, 44)[0], struct.unpack_from("<I", data, 48)[0]
        self.cutoff, first_minifat, _, first_difat, n_difat = struct.unpack_from("<IIIII", data, 56)
        difat = list(struct.unpack_from("<109I", data, 76))
        at, seen = first_difat, set()
        while at < _END and at not in seen and len(seen) <= n_difat:
            seen.add(at)
            block = self._sector(at)
            numbers = struct.unpack(f"<{len(block) // 4}I", block)
            difat += numbers[:-1]
            at = numbers[-1]
        self.fat: list[int] = []
        for s in [d for d in difat if d < _END][: n_fat or None]:
            block = self._sector(s)
            self.fat += struct.unpack(f"<{len(block) // 4}I", block)
        self.directory = self._entries(self._chain(first_dir))
        if not self.directory or self.directory[0]["type"] != 5:
            raise BadContainer("no root entry")
        block = self._chain(first_minifat) if first_minifat < _END else b""
        self.minifat = struct.unpack(f"<{len(block) // 4}I", block)
        root = self.directory[0]
        self.ministream = self._chain(root["start"])[: root["size"]] if root["start"] < _END else b""

    def _sector(self, number: int) -> bytes:
        at = (number + 1) * self.sector
        if at >= len(self.data):
            raise BadContainer("sector beyond the end")
        return self.data[at : at + self.sector]

    def _chain(self, number: int) -> bytes:
        out, seen = [], set()
        while number < _END:
            if number in seen or number >= len(self.fat):
                raise BadContainer("broken chain")
            seen.add(number)
            out.append(self._sector(number))
            number = self.fat[number]
        return b"".join(out)

    def _mini_chain(self, number: int) -> bytes:
        out, seen = [], set()
        while number < _END:
            if number in seen or number >= len(self.minifat):
                raise BadContainer("broken short chain")
            seen.add(number)
            out.append(self.ministream[number * self.mini : (number + 1) * self.mini])
            number = self.minifat[number]
        return b"".join(out)

    @staticmethod
    def _entries(block: bytes) -> list[dict]:
        out = []
        for at in range(0, len(block) - 127, 128):
            length = struct.unpack_from("<H", block, at + 64)[0]
            kind = block[at + 66]
            left, right, child = struct.unpack_from("<III", block, at + 68)
            start, size = struct.unpack_from("<IQ", block, at + 116)
            out.append({"name": block[at : at + max(0, min(length, 64) - 2)].decode("utf-16-le", "replace"), "type": kind, "left": left, "right": right, "child": child, "start": start, "size": size & 0xFFFFFFFF if size >> 48 else size})
        return out

    def walk(self):
        """(path, is_file, size, reader) of all entries, siblings in tree order, a folder before its children."""
        seen: set[int] = set()
        stack: list[tuple[str, int, bool]] = [("", self.directory[0]["child"], False)]
        while stack:
            base, number, visit = stack.pop()
            if number >= len(self.directory):
                continue
            entry = self.directory[number]
            if visit:
                path = f"{base}/{entry['name']}"
                yield path, entry["type"] == 2, entry["size"], entry
                if entry["type"] != 2:
                    stack.append((path, entry["child"], False))
                continue
            if number in seen:
                continue
            seen.add(number)
            stack += [(base, entry["right"], False), (base, number, True), (base, entry["left"], False)]

    def read(self, entry: dict) -> bytes:
        chain = self._mini_chain if entry["size"] < self.cutoff else self._chain
        return chain(entry["start"])[: entry["size"]] if entry["size"] else b""

    def stream(self, path: str) -> bytes | None:
        return next((self.read(e) for p, is_file, _, e in self.walk() if is_file and p == path), None)


def cfb_entries(data: bytes) -> list[tuple[str, bool, int]]:
    return [(path, is_file, size) for path, is_file, size, _ in CompoundFile(data).walk()]


def zip_entries(data: bytes, bodies: bool = True):
    """(path, is_file, size, method, content, error) in the order of the central directory."""
    try:
        archive = zipfile.ZipFile(io.BytesIO(data))
    except (zipfile.BadZipFile, ValueError, OSError) as error:
        raise BadContainer(str(error)) from error
    for info in archive.infolist():
        is_file = not info.is_dir()
        method = {zipfile.ZIP_STORED: "stored", zipfile.ZIP_DEFLATED: "deflated"}.get(info.compress_type, "unsupported")
        content = error = None
        if is_file and bodies:
            if info.file_size > MAX_ENTRY_BYTES:
                error = "entry too large"
            else:
                try:
                    content = archive.read(info)
                except Exception as e:  # a broken entry leaves the others readable
                    error = f"{type(e).__name__}: {e}"
        yield "/" + info.filename.strip("/"), is_file, info.file_size, method, content, error


def entries(files: DataFrame, bodies: bool = True) -> DataFrame:
    """Entries of all zip and compound files; other files have none. Without `bodies` nothing is inflated."""
    schema = pa.schema([("file_id", pa.int64()), ("entry_ix", pa.int32()), ("entry_path", pa.string()), ("is_file", pa.bool_()), ("size", pa.int64()), ("method", pa.string()), ("mimetype", pa.string()), ("content", pa.binary()), ("error", pa.string())])

    def listed(data: bytes):
        if data[:4] == b"PK\x03\x04":
            yield from zip_entries(data, bodies)
        elif data[:8] == bytes.fromhex("D0CF11E0A1B11AE1"):
            file = CompoundFile(data)
            for path, is_file, size, entry in file.walk():
                yield path, is_file, size, "stored", file.read(entry) if is_file and bodies else None, None

    def run(batches):
        types = file_type_rows()
        for batch in batches:
            rows, size = [], 0
            for file_id, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = content.as_py()
                try:
                    for ix, (path, is_file, n, method, body, error) in enumerate(listed(data or b"")):
                        kind = type_by_extension(posixpath.splitext(path)[1]) if is_file else None
                        rows.append({"file_id": file_id, "entry_ix": ix, "entry_path": path, "is_file": is_file, "size": n, "method": method, "mimetype": types[kind]["mimetype"] if kind else None, "content": body, "error": error})
                        size += len(body or b"")
                        if size > 16 << 20 or len(rows) >= 2000:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, size = [], 0
                except BadContainer as error:
                    rows.append({"file_id": file_id, "entry_ix": -1, "error": str(error)})
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema)

    return files.select("file_id", "content").mapInArrow(run, ENTRIES)


def digests(files: DataFrame, hashed: tuple[str, ...] | None = None) -> DataFrame:
    """file_id, entry_path, mimetype, length, sha256, error of the files in archives: every body is read whole and its checksum tried, piece by piece.

    No body is held or leaves its worker, so entries of any size need a worker
    the same memory.  `hashed` limits the media types that are hashed; the
    others are read all the same.
    """
    schema = pa.schema([("file_id", pa.int64()), ("entry_path", pa.string()), ("mimetype", pa.string()), ("length", pa.int64()), ("sha256", pa.string()), ("error", pa.string())])

    def zipped(data: bytes):
        try:
            archive = zipfile.ZipFile(io.BytesIO(data))
        except (zipfile.BadZipFile, ValueError, OSError) as error:
            raise BadContainer(str(error)) from error
        for info in archive.infolist():
            if not info.is_dir():
                yield "/" + info.filename.strip("/"), lambda info=info: archive.open(info)

    def stored(data: bytes):
        file = CompoundFile(data)
        for path, is_file, _, entry in file.walk():
            if is_file:
                yield path, lambda entry=entry: io.BytesIO(file.read(entry))

    def one(data: bytes):
        types = file_type_rows()
        for path, opened in zipped(data) if data[:4] == b"PK\x03\x04" else stored(data) if data[:8] == bytes.fromhex("D0CF11E0A1B11AE1") else ():
            kind = type_by_extension(posixpath.splitext(path)[1])
            row = {"entry_path": path, "mimetype": types[kind]["mimetype"] if kind else None, "error": None}
            digest, length = hashlib.sha256() if hashed is None or row["mimetype"] in hashed else None, 0
            try:
                with opened() as body:
                    while piece := body.read(1 << 18):
                        length += len(piece)
                        if digest is not None:
                            digest.update(piece)
                row |= {"length": length, "sha256": digest.hexdigest() if digest is not None else None}
            except Exception as e:  # a broken entry leaves the others readable
                row["error"] = f"{type(e).__name__}: {e}"
            yield row

    def run(batches):
        for batch in batches:
            rows = []
            for file_id, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                try:
                    for row in one(content.as_py() or b""):
                        rows.append({"file_id": file_id, **row})
                        if len(rows) >= 2000:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows = []
                except BadContainer as error:
                    rows.append({"file_id": file_id, "error": str(error)})
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema)

    return files.select("file_id", "content").mapInArrow(run, "file_id long, entry_path string, mimetype string, length long, sha256 string, error string")


def listing(entries: DataFrame) -> DataFrame:
    """Files of archives in path order by component, with a readable size."""
    return entries.where("is_file").select("file_id", "entry_path", human_size(F.col("size")).alias("human_size"), "mimetype").orderBy("file_id", F.split("entry_path", "/"))


def walk(entries: DataFrame, root: str = "/") -> DataFrame:
    """Entries below `root` in depth-first order with their depth (0 directly below it)."""
    base = normal_path(root).rstrip("/")
    depth = F.char_length(F.regexp_replace(F.substring("entry_path", len(base) + 1, 1 << 20), "[^/]", "")) - 1
    return entries.where(F.col("entry_path").startswith(base + "/")).withColumn("depth", depth).orderBy("file_id", F.split("entry_path", "/"))


def directories(entries: DataFrame) -> DataFrame:
    """All directories, entered or implied by a file below them; the root always."""
    parts = F.split(F.substring("entry_path", 2, 1 << 20), "/")
    upto = F.when(F.col("is_file"), F.size(parts) - 1).otherwise(F.size(parts))
    prefixes = F.transform(F.sequence(F.lit(0), upto), lambda n: F.concat(F.lit("/"), F.array_join(F.slice(parts, 1, n), "/")))
    return entries.select("file_id", F.explode(prefixes).alias("path")).distinct()


def write_zip(entries: list[tuple[str, bytes | None, int | None]]) -> bytes:
    """Bytes of an archive: (path, content or None for a directory, compression level or None for stored)."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as archive:
        for path, content, level in entries:
            name = path.lstrip("/") + ("/" if content is None else "")
            info = zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0))
            info.compress_type = zipfile.ZIP_STORED if level is None or content is None else zipfile.ZIP_DEFLATED
            archive.writestr(info, content or b"", compresslevel=level)
    return out.getvalue()


def zip_files(rows: DataFrame, key: str, path: str, content: str, level: int = 6) -> DataFrame:
    """One archive per key of rows (path, content): file_id, content. A key's rows must fit a task."""
    schema = pa.schema([("file_id", pa.int64()), ("content", pa.binary())])

    def pack(table: pa.Table) -> pa.Table:
        held = sorted(zip(table.column(1).to_pylist(), table.column(2).to_pylist()))
        return pa.table([pa.array([table.column(0)[0].as_py()], pa.int64()), pa.array([write_zip([(p, c or b"", level) for p, c in held])], pa.binary())], schema=schema)

    return rows.select(F.col(key).cast("long").alias("file_id"), path, content).groupBy("file_id").applyInArrow(pack, "file_id long, content binary")


# Paths: absolute ones begin with a slash; `..` above the root of a relative path is kept.


def normal_path(path: str) -> str:
    out = posixpath.normpath(path) if path else ""
    return "/" + out.lstrip("/") if path.startswith("/") else ("" if out == "." else out)


def is_absolute(path: str) -> bool:
    return path.startswith("/")


def is_escaping(path: str) -> bool:
    """A relative path that leaves its base."""
    path = normal_path(path)
    return path == ".." or path.startswith("../")


def join_path(base: str, path: str) -> str:
    return normal_path(path if is_absolute(path) else f"{base}/{path}")


def parent_path(path: str) -> str:
    path = normal_path(path)
    if path == "/":
        raise ValueError("the root has no parent")
    return normal_path(f"{path}/..")


def basename(path: str) -> str:
    return posixpath.basename(normal_path(path))


def extension(path: str) -> str:
    return posixpath.splitext(basename(path))[1].lstrip(".")


def common_root(a: str, b: str) -> str:
    if is_absolute(a) != is_absolute(b):
        raise ValueError("paths of two kinds")
    shared = []
    for x, y in zip(normal_path(a).split("/"), normal_path(b).split("/")):
        if x != y:
            break
        shared.append(x)
    return "/".join(shared) or ("/" if is_absolute(a) else "")


def rebase_path(path: str, base: str) -> str:
    """`path` as seen from `base`."""
    if is_absolute(path) != is_absolute(base):
        raise ValueError("paths of two kinds")
    rel = posixpath.relpath(normal_path(path) or ".", normal_path(base) or ".")
    return "" if rel == "." else rel
