"""Landed payloads as a Spark source: ``spark.read.format("landed")`` and ``readStream``.

A folder has one folder per store (``store=<name>``), and in it files as a fetcher left them.  There is a partition
per store, so stores are read side by side, and a filter on the store keeps the folders of others closed.
On a stream each file comes once: a store's offset is the name of its last file, so names have
to grow (a time stamp in front does).  Folders are reached by URI through Arrow's file systems.

``scraped`` reads the payloads of a platform into parser rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from urllib.parse import unquote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition
from pyspark.sql.types import StructType

from pricetide.sources import payloads

SCHEMA = "store string, file string, payload string"
_MARK = "store="

#: How the landed payloads of each platform are read; columns of ``SCHEMA`` are kept.
PLATFORMS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "shopify": lambda df: payloads.shopify(df, base="store"),
    "woocommerce": payloads.woocommerce,
    "prestashop": lambda df: payloads.html_cards(df, "prestashop", "payload"),
    "opencart": lambda df: payloads.html_cards(df, "opencart", "payload"),
    "odoo": lambda df: payloads.json_ld(df, "payload", strict=True),
    "jsonld": lambda df: payloads.json_ld(df, "payload"),
    "catalog": payloads.official_catalog,
}


@dataclass
class StoreFiles(InputPartition):
    """Files of a store after ``begin`` up to ``end`` (None: no bound)."""

    store: str
    folder: str
    begin: str | None = None
    end: str | None = None


class _Folders:
    def __init__(self, options: dict):
        self.path, self.lines = options["path"], options.get("lines", "false").lower() == "true"

    def _at(self) -> tuple[pafs.FileSystem, str]:
        return pafs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (pafs.LocalFileSystem(), self.path)

    def stores(self) -> dict[str, str]:
        """Folder by store; signs that folders cannot have are escaped in their names."""
        fs, root = self._at()
        found = fs.get_file_info(pafs.FileSelector(root, allow_not_found=True))
        return {unquote(f.base_name.removeprefix(_MARK)): f.base_name for f in found if f.type == pafs.FileType.Directory and f.base_name.startswith(_MARK)}

    def files(self, folder: str) -> list[str]:
        """Names in order; hidden and unfinished ones are left out."""
        fs, root = self._at()
        found = fs.get_file_info(pafs.FileSelector(f"{root}/{folder}"))
        return sorted(f.base_name for f in found if f.type == pafs.FileType.File and not f.base_name.startswith(("_", ".")))

    def read(self, part: StoreFiles) -> Iterator[pa.RecordBatch]:
        """A batch per file; with the option ``lines`` each line is a payload, else the file is."""
        fs, root = self._at()
        for name in self.files(part.folder):
            if (part.begin is None or name > part.begin) and (part.end is None or name <= part.end):
                with fs.open_input_stream(f"{root}/{part.folder}/{name}") as stream:
                    text = stream.read().decode("utf-8", "replace")
                rows = [x for x in text.split("\n") if x] if self.lines else [text]
                yield pa.RecordBatch.from_pydict({"store": [part.store] * len(rows), "file": [name] * len(rows), "payload": rows}, schema=pa.schema([("store", pa.string()), ("file", pa.string()), ("payload", pa.string())]))


class LandedReader(DataSourceReader):
    def __init__(self, options: dict):
        self.folders, self.wanted = _Folders(options), None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes equality and lists on the store; everything else is left to Spark."""
        for f in filters:
            if isinstance(f, EqualTo | In) and f.attribute == ("store",):
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.wanted = values if self.wanted is None else self.wanted & values
            else:
                yield f

    def partitions(self) -> list[StoreFiles]:
        return [StoreFiles(s, f) for s, f in sorted(self.folders.stores().items()) if self.wanted is None or s in self.wanted]

    def read(self, partition: StoreFiles | None) -> Iterator[pa.RecordBatch]:
        return iter(()) if partition is None else self.folders.read(partition)  # none: there are no stores


class LandedStreamReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.folders = _Folders(options)

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return {s: names[-1] for s, f in self.folders.stores().items() if (names := self.folders.files(f))}

    def partitions(self, start: dict, end: dict) -> list[StoreFiles]:
        folders = self.folders.stores()
        return [StoreFiles(s, folders[s], start.get(s), last) for s, last in sorted(end.items()) if start.get(s) != last]

    def read(self, partition: StoreFiles) -> Iterator[pa.RecordBatch]:
        return self.folders.read(partition)


class LandedPayloads(DataSource):
    """Options: ``path``, and ``lines`` if each line of a file is a payload."""

    @classmethod
    def name(cls) -> str:
        return "landed"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> LandedReader:
        return LandedReader(self.options)

    def streamReader(self, schema: StructType) -> LandedStreamReader:
        return LandedStreamReader(self.options)


def _prepared(spark: SparkSession) -> None:
    spark.dataSource.register(LandedPayloads)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def scraped(spark: SparkSession, path: str, platform: str, stores: list[str] | None = None, lines: bool = False) -> DataFrame:
    """Parser rows of everything landed for a platform, of some stores only if these are given."""
    _prepared(spark)
    df = spark.read.format("landed").option("path", path).option("lines", str(lines).lower()).load()
    return PLATFORMS[platform](df if stores is None else df.filter(F.col("store").isin(stores)))


def scraped_stream(spark: SparkSession, path: str, platform: str, lines: bool = False) -> DataFrame:
    """The same as a stream: each file once."""
    _prepared(spark)
    return PLATFORMS[platform](spark.readStream.format("landed").option("path", path).option("lines", str(lines).lower()).load())
