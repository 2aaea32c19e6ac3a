"""Record files: a header, directory pages of 256 entries and records of keys and payload, in big-endian 32-bit words.

`RecordSource` is a data source: `spark.read.format("records").load(folder or file)` has a partition for each directory page, and
`df.write.format("records").save(folder)` makes a file of each partition.  Files are opened by path, so the folder must be one that
driver and executors share.  A file holds at most 256 pages' worth of what its 32-bit addresses reach; more rows want more
partitions.
"""

from __future__ import annotations

import glob
import os
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

# Fixed values of the layout, lengths in words of 64 bits.
VERSION, SIGNATURE = b"XDF0", b"STDR"
ENTRIES, KEY_LENGTH, INFO_LENGTH, PAGE_HEAD, MOST_PAGES = 256, 9, 1, 4, 1024
KEYS = [(f"SF{i:02d}", 32 * i - 1) for i in range(1, 17)] + [("AXI1", 31), ("AXI2", 63)]
HEADER_LENGTH = 8 + len(KEYS)
PAGE_LENGTH = PAGE_HEAD + ENTRIES * KEY_LENGTH
VALID, ERASED = 1, 255
#: Payload types.
BINARY, UNSIGNED, TEXT, SIGNED, IEEE = 0, 2, 3, 4, 5

DESCRIPTORS = ["nomvar", "typvar", "etiket", "grtyp", "ni", "nj", "nk", "ip1", "ip2", "ip3", "ig1", "ig2", "ig3", "ig4", "date_stamp", "deet", "npas", "datyp", "nbits"]
SCHEMA = (
    "file string, handle long, nomvar string, typvar string, etiket string, grtyp string, ni int, nj int, nk int, ip1 int, ip2 int, ip3 int, ig1 int, ig2 int, ig3 int, ig4 int, "
    "date_stamp long, deet int, npas int, datyp int, nbits int, length long, address long, erased boolean, field array<double>"
)


def _letters(text: str | None, count: int) -> int:
    """Letters of six bits each: capitals, digits and signs from the space on."""
    number = 0
    for c in (text or "").upper().ljust(count)[:count]:
        number = number << 6 | (ord(c) - 32 & 63)
    return number


def _text(number: int, count: int) -> str:
    return "".join(chr((number >> 6 * (count - 1 - k) & 63) + 32) for k in range(count)).rstrip()


def entry(record: dict, length: int, address: int, state: int = VALID) -> list[int]:
    """The 18 words of a record's keys."""
    get = lambda k: int(record.get(k) or 0)
    label = _letters(record.get("etiket"), 12)
    stamp = get("date_stamp") & 0xFFFFFFFF
    for name, bits in (("ni", 24), ("nj", 24), ("nk", 20), ("deet", 24), ("npas", 26), *((f"ig{i}", 24) for i in (1, 2, 3, 4)), *((f"ip{i}", 28) for i in (1, 2, 3))):
        if not 0 <= get(name) < 1 << bits:
            raise ValueError(f"{name} does not fit in {bits} bits")
    return [
        state << 24 | length, address, get("deet") << 8 | get("nbits"), get("ni") << 8 | ord((record.get("grtyp") or " ")[0]), get("nj") << 8 | get("datyp"), get("nk") << 12, get("npas") << 6,
        get("ig4") << 8 | get("ig2") >> 16, get("ig1") << 8 | get("ig2") >> 8 & 255, get("ig3") << 8 | get("ig2") & 255, (label >> 42) << 2, (label >> 12 & (1 << 30) - 1) << 2,
        (label & 0xFFF) << 20 | _letters(record.get("typvar"), 2) << 8, _letters(record.get("nomvar"), 4) << 8, get("ip1") << 4, get("ip2") << 4, get("ip3") << 4, stamp // 10 * 8 + stamp % 10 & 0xFFFFFFFF,
    ]


def described(w: list[int]) -> dict:
    """The descriptors of an entry's words."""
    label = (w[10] >> 2) << 42 | (w[11] >> 2) << 12 | w[12] >> 20
    stamp = (w[17] >> 3) * 10 + (w[17] & 7)
    return {
        "nomvar": _text(w[13] >> 8, 4), "typvar": _text(w[12] >> 8 & 0xFFF, 2), "etiket": _text(label, 12), "grtyp": chr(w[3] & 255), "ni": w[3] >> 8, "nj": w[4] >> 8, "nk": w[5] >> 12,
        "ip1": w[14] >> 4, "ip2": w[15] >> 4, "ip3": w[16] >> 4, "ig1": w[8] >> 8, "ig2": (w[7] & 255) << 16 | (w[8] & 255) << 8 | w[9] & 255, "ig3": w[9] >> 8, "ig4": w[7] >> 8,
        "date_stamp": stamp if stamp < 1 << 31 else stamp - (1 << 32), "deet": w[2] >> 8, "npas": w[6] >> 6, "datyp": w[4] & 255, "nbits": w[2] & 255, "length": w[0] & 0xFFFFFF, "address": w[1], "erased": w[0] >> 31 == 1,
    }


def payload(values, datyp: int, bits: int) -> bytes:
    """A field's bytes: IEEE reals of 32 or 64 bits, whole numbers of so many bits side by side (signed ones from the least on),
    letters of eight bits."""
    x = np.asarray(values, np.float64)
    if datyp == IEEE:
        body = x.astype(">f4" if bits <= 32 else ">f8").tobytes()
    elif datyp in (BINARY, UNSIGNED, SIGNED, TEXT):
        width = 8 if datyp == TEXT else bits
        whole = np.rint(x).astype(np.int64) + (1 << width - 1 if datyp == SIGNED else 0)
        if len(whole) and (whole.min() < 0 or whole.max() >> width):
            raise ValueError(f"a value does not fit in {width} bits")
        spread = whole[:, None] >> np.arange(width - 1, -1, -1) & 1
        body = np.packbits(spread.astype(np.uint8).ravel()).tobytes()
    else:
        raise ValueError(f"no payload of type {datyp}")
    return body


def values(body: bytes, count: int, datyp: int, bits: int) -> list[float]:
    if datyp == IEEE:
        return np.frombuffer(body, ">f4" if bits <= 32 else ">f8", count).astype(np.float64).tolist()
    if datyp not in (BINARY, UNSIGNED, SIGNED, TEXT):
        raise ValueError(f"no payload of type {datyp}")
    width = 8 if datyp == TEXT else bits
    flat = np.unpackbits(np.frombuffer(body, np.uint8), count=count * width).reshape(count, width).astype(np.int64)
    whole = (flat << np.arange(width - 1, -1, -1)).sum(axis=1)
    return (whole - (1 << width - 1 if datyp == SIGNED else 0)).astype(np.float64).tolist()


def handle(page: int, place: int, file: int = 0) -> int:
    return file & 0x3FF | (place & 0x1FF) << 10 | (page & 0xFFF) << 19


class Writer:
    """A record file as it grows: records follow one another, and a page is made for every 256 of them."""

    def __init__(self, path: str):
        self.file, self.size = open(path, "wb"), HEADER_LENGTH  # noqa: SIM115 - closed by close()
        self.pages: list[tuple[int, list[list[int]]]] = []
        self.largest = 0
        self._page()

    def _page(self) -> None:
        if len(self.pages) == MOST_PAGES:
            raise ValueError("a record file has no more pages")
        self.pages.append((self.size + 1, []))
        self.size += PAGE_LENGTH

    def put(self, record: dict, body: bytes) -> int:
        if len(self.pages[-1][1]) == ENTRIES:
            self._page()
        count = int(record["ni"]) * int(record["nj"]) * int(record["nk"])
        length = KEY_LENGTH + INFO_LENGTH + (count * (8 if record["datyp"] == TEXT else int(record["nbits"])) + 120 + 63) // 64
        address = self.size + 1
        words = entry(record, length, address)
        self.file.seek(self.size * 8)
        self.file.write(struct.pack(">18I", *words) + bytes(8 * INFO_LENGTH) + body.ljust(8 * (length - KEY_LENGTH - INFO_LENGTH), b"\0"))
        self.size, self.largest = self.size + length, max(self.largest, length)
        self.pages[-1][1].append(words)
        return handle(len(self.pages) - 1, len(self.pages[-1][1]) - 1)

    def close(self) -> None:
        total = sum(len(p) for _, p in self.pages)
        for k, (address, entries) in enumerate(self.pages):
            following = self.pages[k + 1][0] if k + 1 < len(self.pages) else 0
            self.file.seek((address - 1) * 8)
            self.file.write(page_bytes(address, following, entries))
        keys = b"".join(name.encode() + struct.pack(">I", bit << 19 | 31 << 14) for name, bit in KEYS)
        head = struct.pack(">II4s4s6I4H4I", HEADER_LENGTH, 0, VERSION, SIGNATURE, self.size, 0, total, len(self.pages), self.pages[-1][0], self.largest, 16, KEY_LENGTH, 2, INFO_LENGTH, 0, total, 0, 0)
        self.file.seek(0)
        self.file.write(head + keys)
        self.file.truncate(self.size * 8)
        self.file.close()


def page_bytes(address: int, following: int, entries: list[list[int]]) -> bytes:
    """A directory page.  The words from its fourth on, the checksum among them, have no odd bit together."""
    words = np.zeros(PAGE_LENGTH * 2, np.uint32)
    words[:8] = [PAGE_LENGTH, address, 0, 0, following, len(entries), 0, 0]
    if entries:
        words[8 : 8 + 18 * len(entries)] = np.array(entries, np.uint64).astype(np.uint32).ravel()
    words[6] = np.bitwise_xor.reduce(words[4:])
    return words.astype(">u4").tobytes()


def file_header(path: str) -> dict:
    """The header's numbers; a file that is no record file, or whose size is another one, is an error."""
    with open(path, "rb") as f:
        data = f.read(64)
    if len(data) < 64 or data[8:12].upper() != VERSION:
        raise ValueError(f"{path} is no record file")
    w = struct.unpack(">II4s4s6I4H4I", data)
    if w[0] >> 24 or w[4] * 8 != os.path.getsize(path):
        raise ValueError(f"{path} is damaged")
    names = ("size", "rewrites", "extensions", "pages", "last_page", "largest", "primary", "primary_length", "auxiliary", "auxiliary_length", "erasures", "records")
    return {"version": w[2].decode(), "signature": w[3].decode()} | dict(zip(names, w[4:16], strict=True))


def read_page(path: str, address: int) -> tuple[int, list[list[int]], bool]:
    """A page's follower, its entries and whether its checksum is right."""
    with open(path, "rb") as f:
        f.seek((address - 1) * 8)
        words = np.frombuffer(f.read(PAGE_LENGTH * 8), ">u4").astype(np.uint32)
    count = int(words[5])
    found = words[8 : 8 + 18 * count].reshape(count, 18).tolist()
    return int(words[4]), found, int(np.bitwise_xor.reduce(words[4:])) == 0


def page_addresses(path: str) -> list[int]:
    out, address = [], HEADER_LENGTH + 1
    for _ in range(file_header(path)["pages"]):
        out.append(address)
        with open(path, "rb") as f:
            f.seek((address - 1) * 8 + 16)
            address = struct.unpack(">I", f.read(4))[0]
    return out


def files(path: str) -> list[str]:
    path = path.removeprefix("file://")
    return [path] if os.path.isfile(path) else sorted(glob.glob(f"{glob.escape(path)}/*.rec"))


def erase(path: str, handles: list[int]) -> int:
    """Mark records of one file as erased, in its directory and in themselves; how many were valid until then."""
    addresses, done = page_addresses(path), 0
    by_page: dict[int, list[int]] = {}
    for h in handles:
        by_page.setdefault(h >> 19 & 0xFFF, []).append(h >> 10 & 0x1FF)
    with open(path, "r+b") as f:
        for page, places in by_page.items():
            following, entries, _ = read_page(path, addresses[page])
            for place in places:
                w = entries[place]
                if w[0] >> 31:
                    continue
                w[0] = ERASED << 24 | w[0] & 0xFFFFFF
                f.seek((w[1] - 1) * 8)
                f.write(struct.pack(">I", w[0]))
                done += 1
            f.seek((addresses[page] - 1) * 8)
            f.write(page_bytes(addresses[page], following, entries))
        f.seek(48)
        erased, left = struct.unpack(">II", f.read(8))
        f.seek(48)
        f.write(struct.pack(">II", erased + done, left - done))
    return done


def restore(path: str, handles: list[int]) -> int:
    """Records of one file that were erased are valid again; how many."""
    addresses, done = page_addresses(path), 0
    with open(path, "r+b") as f:
        for h in handles:
            page, place = h >> 19 & 0xFFF, h >> 10 & 0x1FF
            following, entries, _ = read_page(path, addresses[page])
            w = entries[place]
            if not w[0] >> 31:
                continue
            w[0] = VALID << 24 | w[0] & 0xFFFFFF
            f.seek((w[1] - 1) * 8)
            f.write(struct.pack(">I", w[0]))
            f.seek((addresses[page] - 1) * 8)
            f.write(page_bytes(addresses[page], following, entries))
            f.flush()
            done += 1
        f.seek(48)
        erased, left = struct.unpack(">II", f.read(8))
        f.seek(48)
        f.write(struct.pack(">II", erased - done, left + done))
    return done


def sign(path: str, signature: str) -> None:
    """Give a file another four letters of signature."""
    file_header(path)
    with open(path, "r+b") as f:
        f.seek(12)
        f.write(signature.encode("ascii").ljust(4)[:4])


def truncate(path: str, size: int) -> None:
    """Cut a file off after so many bytes."""
    os.truncate(path, size)


def headers(spark: SparkSession, path: str) -> DataFrame:
    """A row for each file of a folder with its header's numbers."""
    names = ["version", "signature", "size", "rewrites", "extensions", "pages", "largest", "primary", "primary_length", "auxiliary", "auxiliary_length", "erasures", "records"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            heads = [file_header(name) for name in batch["file"]]
            yield pd.DataFrame({"file": [os.path.basename(n) for n in batch["file"]]} | {c: [h[c] for h in heads] for c in names})

    paths = files(path)
    named = spark.createDataFrame([(p,) for p in paths], "file string").repartition(max(1, min(len(paths), 1000)), "file")
    return named.mapInPandas(run, "file string, " + ", ".join(f"{c} {'string' if c in ('version', 'signature') else 'long'}" for c in names))


def erase_rows(rows: DataFrame, path: str) -> DataFrame:
    """(file, n): the records (file, handle) of a folder's files, erased where a task holds a file's handles; how many were valid.
    What was erased by a task that is repeated counts for the first time only."""
    folder = path.removeprefix("file://")

    def run(group: pd.DataFrame) -> pd.DataFrame:
        name = group["file"].iloc[0]
        return pd.DataFrame({"file": [name], "n": [erase(f"{folder}/{name}", group["handle"].tolist())]})

    return rows.select("file", "handle").groupBy("file").applyInPandas(run, "file string, n long")


def check(spark: SparkSession, path: str) -> DataFrame:
    """(file, size, pages, records, erasures, sound): headers of the files of a folder, and whether all their checksums are right."""
    paths = files(path)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            heads = [file_header(name) for name in batch["file"]]
            sound = [all(read_page(name, a)[2] for a in page_addresses(name)) for name in batch["file"]]
            yield pd.DataFrame({"file": batch["file"]} | {c: [h[c] for h in heads] for c in ("size", "pages", "records", "erasures")} | {"sound": sound})

    named = spark.createDataFrame([(p,) for p in paths], "file string").repartition(max(1, min(len(paths), 1000)), "file")
    return named.mapInPandas(run, "file string, size long, pages long, records long, erasures long, sound boolean")


class Page(InputPartition):
    def __init__(self, path: str, number: int, address: int):
        super().__init__((path, number, address))
        self.path, self.number, self.address = path, number, address


class RecordReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.fields = options["path"], str(options.get("fields", "true")).lower() != "false"

    def partitions(self) -> list[Page]:
        return [Page(p, k, a) for p in files(self.path) for k, a in enumerate(page_addresses(p))]

    def read(self, partition: Page | None) -> Iterator[tuple]:
        if partition is None:  # a folder without files
            return
        _, entries, sound = read_page(partition.path, partition.address)
        if not sound:
            raise ValueError(f"a directory page of {partition.path} is damaged")
        with open(partition.path, "rb") as f:
            for place, words in enumerate(entries):
                d = described(words)
                field = None
                if self.fields and not d["erased"]:
                    f.seek((d["address"] - 1 + KEY_LENGTH + INFO_LENGTH) * 8)
                    body = f.read((d["length"] - KEY_LENGTH - INFO_LENGTH) * 8)
                    field = values(body, d["ni"] * d["nj"] * d["nk"], d["datyp"], d["nbits"])
                yield (os.path.basename(partition.path), handle(partition.number, place), *[d[c] for c in DESCRIPTORS], d["length"], d["address"], d["erased"], field)


class Written(WriterCommitMessage):
    def __init__(self, path: str | None):
        self.path = path


class RecordWriter(DataSourceWriter):
    def __init__(self, options: dict, columns: list[str], overwrite: bool):
        self.path, self.columns, self.overwrite = options["path"].removeprefix("file://"), columns, overwrite

    def write(self, iterator: Iterator) -> Written:
        """A task's rows go to a file that only its commit gives the final name, so a lost or repeated task leaves none behind."""
        path, out = f"{self.path}/{uuid.uuid4().hex}.part", None
        os.makedirs(self.path, exist_ok=True)
        for row in iterator:
            r = dict(zip(self.columns, row, strict=True))
            if out is None:
                out = Writer(path)
            r = {"nk": 1, "datyp": IEEE, "nbits": 32} | {k: v for k, v in r.items() if v is not None}
            field = r.get("field", [])
            if len(field) != r["ni"] * r["nj"] * r["nk"]:
                raise ValueError("a field has as many values as its record says")
            out.put(r, payload(field, r["datyp"], r["nbits"]))
        if out is not None:
            out.close()
        return Written(path if out is not None else None)

    def commit(self, messages: list[Written | None]) -> None:
        os.makedirs(self.path, exist_ok=True)
        if self.overwrite:
            for old in files(self.path):
                os.remove(old)
        for m in messages:
            if m is not None and m.path:
                os.replace(m.path, m.path.removesuffix(".part") + ".rec")

    def abort(self, messages: list[Written | None]) -> None:
        for m in messages:
            if m is not None and m.path and os.path.exists(m.path):
                os.remove(m.path)


class RecordSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "records"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> RecordReader:
        return RecordReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> RecordWriter:
        return RecordWriter(dict(self.options), schema.names, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(RecordSource)
