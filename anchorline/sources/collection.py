"""Binary collections of alignment blocks, versions 4 and 5, as a data source: read in ranges, written in parts that a commit joins.

Little-endian: version u8, magic u16 0xAFFE, species count u8; for each species its
name (NUL-ended), genome size u64 and number of partners u8; for each partner its name and number of
chromosomes u32; for each chromosome its id u32, number of blocks u32 and the blocks (ref_start
u32, qry_start u32, qry_chrom u32, length and strand u16); at the end the number of chromosomes u32 and their names.
Version 5 is the same with ref_start and qry_start i64, for coordinates that 32 bits don't hold (negative ones too).

Reading: the planner seeks from header to header without touching a block, and emits ranges of at most RANGE_ROWS blocks;
filters on the species reach it.  A task reads its range and the names of the chromosomes.  Genome sizes come from the headers alone.

Writing: blocks in order of pair, chromosome and position; each task writes its rows as one part and reports how many it has of each
chromosome; the commit numbers these groups, writes the headers, and copies the parts between them in order.  Parts of failed tasks
are never named in a commit.

Files are opened through Arrow's file systems (a plain path, or a URI that Arrow knows), on executors too.
"""

from __future__ import annotations

import contextlib
import io
import struct
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from pathlib import PurePosixPath

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, WriterCommitMessage

from anchorline.operators.blocks import PAIR, chromosome_dictionary
from anchorline.storage import shared_dir

VERSION, WIDE_VERSION, MAGIC = 4, 5, 0xAFFE
ROW, WIDE_ROW = (np.dtype([("ref_start", at), ("qry_start", at), ("qry_chrom", "<u4"), ("word", "<u2")]) for at in ("<u4", "<i8"))
#: A block's form by version, and the version by the bits of a coordinate.
ROWS, VERSIONS = {VERSION: ROW, WIDE_VERSION: WIDE_ROW}, {32: VERSION, 64: WIDE_VERSION}
SCHEMA = "ref_sp string, qry_sp string, ref_chrom string, ref_start long, qry_chrom string, qry_start long, length int, qry_rev boolean"
#: Blocks of a range (14 or 22 bytes each), and chromosomes whose ids are broadcast to a writer.
RANGE_ROWS, BROADCAST_CHROMOSOMES = 1 << 20, 1_000_000
LENGTH, REVERSE = 0x7FFF, 0x8000
_COPY = 1 << 23


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _files(path: str) -> list[tuple[str, int]]:
    """The file, or the files of a folder that aren't hidden, with their sizes."""
    where, inner = _opened(path)
    info = where.get_file_info(inner)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.type == fs.FileType.File else [x for x in where.get_file_info(fs.FileSelector(inner)) if x.type == fs.FileType.File and not PurePosixPath(x.path).name.startswith(("_", "."))]
    return sorted((x.path, x.size) for x in found)


class _Headers:
    """Numbers and names at an offset of a file, without the blocks between them."""

    def __init__(self, file: pa.NativeFile, size: int):
        self.file, self.size, self.at = file, size, 0
        self.held, self.begin = b"", 0
        self.version = 0

    @property
    def row(self) -> np.dtype:
        return ROWS[self.version]

    def take(self, n: int) -> bytes:
        if self.at + n > self.size:
            raise ValueError("the collection ends too early")
        low = self.at - self.begin
        if low < 0 or low + n > len(self.held):
            self.file.seek(self.at)
            self.begin, self.held = self.at, self.file.read(max(n, min(1 << 16, self.size - self.at)))
            low = 0
        self.at += n
        return self.held[low : low + n]

    def number(self, kind: str) -> int:
        return struct.unpack("<" + kind, self.take(struct.calcsize("<" + kind)))[0]

    def name(self) -> str:
        out = bytearray()
        while (c := self.take(1)) != b"\0":
            out += c
        return out.decode()

    def skip(self, n: int) -> None:
        if self.at + n > self.size:
            raise ValueError("the collection ends too early")
        self.at += n

    def walk(self) -> Iterator[tuple[str, int, str | None, int, int, int]]:
        """Reference, its genome size, partner, chromosome id, offset and number of blocks of each group; once with partner None for each reference."""
        self.version = self.number("B")
        if self.version not in ROWS:
            raise ValueError(f"version {self.version} of the collection isn't supported")
        if self.number("H") != MAGIC:
            raise ValueError("the collection has another byte order")
        for _ in range(self.number("B")):
            ref, size = self.name(), self.number("Q")
            yield ref, size, None, 0, self.at, 0
            for _ in range(self.number("B")):
                qry = self.name()
                for _ in range(self.number("I")):
                    chrom, n = self.number("I"), self.number("I")
                    yield ref, size, qry, chrom, self.at, n
                    self.skip(n * self.row.itemsize)

    def names(self) -> list[str]:
        return [self.name() for _ in range(self.number("I"))]

    def finish(self) -> int:
        """The offset of the chromosome names; an error if they aren't the end."""
        begin = self.at
        self.names()
        if self.at != self.size:
            raise ValueError("bytes follow the end of the collection")
        return begin


@dataclass
class _Range(InputPartition):
    """Groups of blocks that stand together in a file: (ref, qry, chromosome id, offset, blocks)."""

    path: str
    size: int
    names_at: int
    version: int
    groups: list[tuple[str, str, int, int, int]]

    def __post_init__(self) -> None:
        super().__init__(None)


class _BlockReader(DataSourceReader):
    def __init__(self, path: str, rows: int):
        self.path, self.rows = path, rows
        self.wanted: dict[str, set[str]] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            column = f.attribute[0] if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 else None
            if column in ("ref_sp", "qry_sp"):
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.wanted[column] = self.wanted.get(column, values) & values
            else:
                yield f

    def partitions(self) -> Sequence[InputPartition]:
        out: list[_Range] = []
        where, _ = _opened(self.path)
        for path, size in _files(self.path):
            mine: list[_Range] = []
            with where.open_input_file(path) as file:
                headers = _Headers(file, size)
                have = self.rows
                for ref, _, qry, chrom, offset, n in headers.walk():
                    if qry is None or not all(v in self.wanted.get(c, {v}) for c, v in (("ref_sp", ref), ("qry_sp", qry))):
                        continue
                    while n:
                        if have >= self.rows:
                            mine.append(_Range(path, size, 0, headers.version, []))
                            have = 0
                        part = min(n, self.rows - have)
                        mine[-1].groups.append((ref, qry, chrom, offset, part))
                        have, n, offset = have + part, n - part, offset + part * headers.row.itemsize
                end = headers.finish()
            for x in mine:
                x.names_at = end
            out.extend(mine)
        return out or [_Range("", 0, 0, VERSION, [])]

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        if not partition.groups:
            return
        where, _ = _opened(self.path)
        with where.open_input_file(partition.path) as file:
            headers = _Headers(file, partition.size)
            headers.at = partition.names_at
            names = pa.array(headers.names(), pa.string())
            for ref, qry, chrom, offset, n in partition.groups:
                file.seek(offset)
                row = ROWS[partition.version]
                b = np.frombuffer(file.read(n * row.itemsize), row)
                same = lambda v, n=n: pa.DictionaryArray.from_arrays(np.zeros(n, np.int32), [v]).cast(pa.string())
                columns = [same(ref), same(qry), same(names[chrom].as_py()), b["ref_start"].astype(np.int64), names.take(pa.array(b["qry_chrom"])), b["qry_start"].astype(np.int64), (b["word"] & LENGTH).astype(np.int32), (b["word"] & REVERSE) != 0]
                yield pa.record_batch([pa.array(c) if isinstance(c, np.ndarray) else c for c in columns], names=[x.split()[0] for x in SCHEMA.split(", ")])


class _SizeReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> Sequence[InputPartition]:
        return [InputPartition(x) for x in _files(self.path)]

    def read(self, partition: InputPartition) -> Iterator[tuple[str, int]]:
        path, size = partition.value
        with _opened(self.path)[0].open_input_file(path) as file:
            yield from [(ref, genome) for ref, genome, qry, *_ in _Headers(file, size).walk() if qry is None]


@dataclass
class _Part(WriterCommitMessage):
    """A part's file and its groups in order: (ref, qry, chromosome id, blocks)."""

    task: int
    path: str
    groups: list[tuple[str, str, int, int]]


class _CollectionWriter(DataSourceArrowWriter):
    def __init__(self, path: str, species: str, chromosomes: str, bits: int):
        self.path, self.species, self.chromosomes = path, species, chromosomes
        self.bits, self.version = bits, VERSIONS[bits]
        self.parts = f"{path}.parts-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        from pyspark import TaskContext

        where, parts = _opened(self.parts)
        where.create_dir(parts, recursive=True)
        path = f"{parts}/{uuid.uuid4().hex}"
        groups: list[tuple[str, str, int, int]] = []
        with where.open_output_stream(path) as out:
            for batch in iterator:
                rows = np.zeros(batch.num_rows, ROWS[self.version])
                numbers = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in ("ref_id", "ref_start", "qry_id", "qry_start", "length", "qry_rev")}
                for c in ("ref_start", "qry_start"):
                    if self.bits == 32 and len(rows) and (numbers[c].min() < 0 or numbers[c].max() >= 1 << 32):
                        raise ValueError(f"{c} doesn't fit into 32 bits")
                if len(rows) and (numbers["length"].min() < 1 or numbers["length"].max() > LENGTH):
                    raise ValueError("the length of a block doesn't fit into 15 bits")
                rows["ref_start"], rows["qry_start"], rows["qry_chrom"] = numbers["ref_start"], numbers["qry_start"], numbers["qry_id"]
                rows["word"] = numbers["length"] | np.where(numbers["qry_rev"], REVERSE, 0)
                out.write(rows.tobytes())
                ref, qry = batch.column("ref_sp").dictionary_encode(), batch.column("qry_sp").dictionary_encode()
                a, b, c = ref.indices.to_numpy(), qry.indices.to_numpy(), numbers["ref_id"]
                first = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (c[1:] != c[:-1])]) if len(rows) else []
                for i, n in zip(first, np.diff(np.r_[first, len(rows)]) if len(rows) else [], strict=True):
                    key = (ref.dictionary[int(a[i])].as_py(), qry.dictionary[int(b[i])].as_py(), int(c[i]))
                    if groups and groups[-1][:3] == key:
                        groups[-1] = (*key, groups[-1][3] + int(n))
                    else:
                        groups.append((*key, int(n)))
        return _Part(TaskContext.get().partitionId(), path, groups)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        where, final = _opened(self.path)
        species = pq.read_table(_opened(self.species)[1], filesystem=where).sort_by("species").to_pylist()
        names = pq.read_table(_opened(self.chromosomes)[1], filesystem=where).sort_by("chrom_id")["chrom"].to_pylist()
        if len(species) > 255:
            raise ValueError("more than 255 species")
        parts = sorted((m for m in messages if m is not None and m.groups), key=lambda m: m.task)
        total: dict[str, dict[str, dict[int, int]]] = {}
        for m in parts:
            for ref, qry, chrom, n in m.groups:
                of = total.setdefault(ref, {}).setdefault(qry, {})
                of[chrom] = of.get(chrom, 0) + n
        if unknown := set(total) - {s["species"] for s in species}:
            raise ValueError(f"species without a genome size: {sorted(unknown)}")
        text = lambda s: s.encode() + b"\0"
        staged = f"{final}.{uuid.uuid4().hex}.tmp"
        with contextlib.ExitStack() as stack, where.open_output_stream(staged) as out:
            left: list[tuple[str, int]] = [(m.path, sum(n for *_, n in m.groups) * ROWS[self.version].itemsize) for m in parts]
            source: io.IOBase | None = None

            def copy(size: int) -> None:
                """The next bytes of all parts in turn."""
                nonlocal source
                while size:
                    if source is None:
                        source = stack.enter_context(where.open_input_stream(left[0][0]))
                    piece = source.read(min(size, left[0][1], _COPY))
                    out.write(piece)
                    size -= len(piece)
                    left[0] = (left[0][0], left[0][1] - len(piece))
                    if not left[0][1]:
                        source.close()
                        source = None
                        left.pop(0)

            out.write(struct.pack("<BHB", self.version, MAGIC, len(species)))
            for s in species:
                partners = total.get(s["species"], {})
                out.write(text(s["species"]) + struct.pack("<QB", s["genome_size"], len(partners)))
                for qry, chroms in partners.items():
                    out.write(text(qry) + struct.pack("<I", len(chroms)))
                    for chrom, n in chroms.items():
                        out.write(struct.pack("<II", chrom, n))
                        copy(n * ROWS[self.version].itemsize)
            out.write(struct.pack("<I", len(names)) + b"".join(map(text, names)))
        where.move(staged, final)
        self.abort(messages)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        where, parts = _opened(self.parts)
        if where.get_file_info(parts).type == fs.FileType.Directory:
            where.delete_dir(parts)


class CollectionSource(DataSource):
    """spark.read.format("block_collection").load(path); option("table", "genomes") gives the genome sizes instead of the blocks."""

    @classmethod
    def name(cls) -> str:
        return "block_collection"

    def schema(self) -> str:
        return "species string, genome_size long" if self.options.get("table") == "genomes" else SCHEMA

    def reader(self, schema) -> DataSourceReader:
        if self.options.get("table") == "genomes":
            return _SizeReader(self.options["path"])
        return _BlockReader(self.options["path"], int(self.options.get("range_rows", RANGE_ROWS)))

    def writer(self, schema, overwrite: bool) -> _CollectionWriter:
        return _CollectionWriter(self.options["path"], self.options["species"], self.options["chromosomes"], int(self.options.get("bits", 32)))


def _registered(spark: SparkSession) -> SparkSession:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(CollectionSource)
    return spark


def read_collection(spark: SparkSession, path: str, range_rows: int = RANGE_ROWS) -> DataFrame:
    """The blocks of a collection, or of all collections in a folder; filters on ref_sp and qry_sp keep other ranges from being read."""
    return _registered(spark).read.format("block_collection").option("range_rows", range_rows).load(path)


def read_collection_sizes(spark: SparkSession, path: str) -> DataFrame:
    return _registered(spark).read.format("block_collection").option("table", "genomes").load(path)


def coordinate_bits(blocks: DataFrame) -> int:
    """32, or 64 if some coordinate needs them."""
    seen = blocks.agg(F.min(F.least("ref_start", "qry_start")).alias("low"), F.max(F.greatest("ref_start", "qry_start")).alias("high")).first()
    return 32 if seen.low is None or (seen.low >= 0 and seen.high < 1 << 32) else 64


def write_collection(blocks: DataFrame, genomes: DataFrame, path: str, bits: int = 32) -> None:
    """One file, which takes the place of an earlier one. Chromosomes are numbered as they appear: each group's own before those that it aligns to.

    ``bits`` of a coordinate: of 32, what doesn't fit is an error; see ``coordinate_bits``.
    """
    spark = _registered(blocks.sparkSession)
    order = ["ref_sp", "qry_sp", "ref_chrom", "ref_start", "qry_chrom", "qry_start", "length", "qry_rev"]
    place = lambda kind: F.struct(*PAIR, F.lit(kind).alias("kind"), *[F.col(c) if kind else F.lit(None).cast(t).alias(c) for c, t in (("ref_start", "long"), ("qry_chrom", "string"))])
    seen = blocks.select(F.col("ref_chrom").alias("chrom"), place(0).alias("ord")).unionByName(blocks.select(F.col("qry_chrom").alias("chrom"), place(1).alias("ord")))
    side = f"{shared_dir(spark)}/anchorline/collection-{uuid.uuid4().hex}"
    chromosome_dictionary(seen).write.parquet(f"{side}/chromosomes")
    genomes.select("species", F.col("genome_size").cast("long").alias("genome_size")).write.parquet(f"{side}/species")
    ids = spark.read.parquet(f"{side}/chromosomes")
    if ids.count() <= BROADCAST_CHROMOSOMES:
        ids = F.broadcast(ids)
    for c in ("ref", "qry"):
        blocks = blocks.join(ids.select(F.col("chrom").alias(f"{c}_chrom"), F.col("chrom_id").alias(f"{c}_id")), f"{c}_chrom")
    rows = blocks.repartitionByRange(*order).sortWithinPartitions(*order).select("ref_sp", "qry_sp", "ref_id", "ref_start", "qry_id", "qry_start", "length", "qry_rev")
    rows.write.format("block_collection").mode("append").option("species", f"{side}/species").option("chromosomes", f"{side}/chromosomes").option("bits", bits).save(path)
