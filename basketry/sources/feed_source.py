"""Feed files as a data source: spark.read.format("retail_feed").load(folder).

A file's name says its kind, chain, store and stamp (for a folder of parts, the folder's name). Filters on these leave files unread. Files are packed into partitions up to PACKED bytes of text;
each is decoded and parsed as it is read, once, header and elements together, so no file is held whole.
"""

from __future__ import annotations

import codecs
import gzip
import io
import re
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from xml.etree.ElementTree import Element, XMLPullParser

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from basketry.sources import feeds

SCHEMA = "file string, kind string, chain_code string, store_code string, stamp string, tag string, fields map<string,string>, item_codes array<string>"
TAGS = {"Item": "price", "Product": "price", "Store": "store", "Promotion": "promotion"}
PACKED = 32 << 20
#: Bytes of text in a byte of a compressed feed, about.
EXPANDED = 10
CHUNK = 1 << 16


def facts(path: str) -> dict[str, str | None]:
    """kind, chain_code, store_code and stamp of a feed's file name."""
    parts = path.rstrip("/").rsplit("/", 2)
    name = parts[-2] if parts[-1].startswith("part-") and len(parts) > 1 else parts[-1]
    low = name.lower()
    kind = next((k for k in ("pricefull", "promofull", "stores", "price", "promo") if k in low), None)
    m = re.search(feeds.FILE_NAME, name)
    if m is None:
        return {"kind": kind, "chain_code": None, "store_code": None, "stamp": None}
    return {"kind": kind, "chain_code": m[2], "store_code": (m[3].lstrip("0") or "0").zfill(3), "stamp": f"{m[4]}{m[5] or ''}"}


def opened(stream: io.BufferedIOBase) -> io.BufferedIOBase:
    """The bytes of a feed: gzip, the first file of a zip, or plain."""
    mark = stream.read(2)
    stream.seek(0)
    if mark == b"\x1f\x8b":
        return gzip.GzipFile(fileobj=stream)
    if mark == b"PK":
        z = zipfile.ZipFile(stream)
        return z.open(z.namelist()[0])
    return stream


def encoding_of(stream: io.BufferedIOBase) -> str:
    """UTF-16 with a mark, UTF-8 if all of it is, else Windows Hebrew."""
    head = stream.read(3)
    if head[:2] in (b"\xff\xfe", b"\xfe\xff"):
        return "utf-16"
    decoder = codecs.getincrementaldecoder("utf-8")()
    try:
        decoder.decode(head)
        while chunk := stream.read(CHUNK):
            decoder.decode(chunk)
        decoder.decode(b"", True)
    except UnicodeDecodeError:
        return "windows-1255"
    return "utf-8-sig"


def elements(text: Iterator[str]) -> Iterator[tuple[str | None, str | None, str, dict[str, str], list[str]]]:
    """(chain, store, tag, fields, item codes) of each item, store or promotion of an XML text that comes in pieces."""
    parser, header, depth, held = XMLPullParser(("start", "end")), {}, [], None

    def told(x: Element) -> tuple[dict[str, str], list[str]]:
        fields = {c.tag: c.text or "" for c in x if not len(c)}
        return fields, [(c.text or "").strip() for c in x.iter() if c.tag == "ItemCode"]

    def ready() -> Iterator:
        nonlocal held
        for event, x in parser.read_events():
            if event == "start":
                depth.append(x)
                if held is None and x.tag in TAGS:
                    held = x
                continue
            depth.pop()
            if x is held:
                yield (header.get("ChainId"), header.get("StoreId"), x.tag, *told(x))
                held = None
                if depth:
                    depth[-1].remove(x)  # what has been given away isn't kept
            elif held is None and x.tag in ("ChainId", "StoreId", "ChainID", "StoreID") and len(depth) <= 2:
                header[x.tag[:-1] + "d"] = (x.text or "").strip()

    for piece in text:
        parser.feed(piece)
        yield from ready()
    parser.close()
    yield from ready()


@dataclass
class Files(InputPartition):
    paths: list[str]


class FeedReader(DataSourceReader):
    def __init__(self, path: str):
        self.path, self.kept = path, []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Equality and lists of values on what the name says choose files; Spark tests all filters again on the rows, as a header may say otherwise than the name."""
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("kind",):
                self.kept.append(("kind", {f.value}))
            elif isinstance(f, In) and f.attribute == ("kind",):
                self.kept.append(("kind", set(f.value)))
            elif isinstance(f, EqualTo) and f.attribute in (("chain_code",), ("store_code",), ("stamp",)):
                self.kept.append((f.attribute[0], {f.value, None}))
            yield f

    def _listed(self) -> list[tuple[str, int]]:
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(self.path)
        infos = system.get_file_info(fs.FileSelector(root, recursive=True))
        return sorted((x.path, x.size) for x in infos if x.is_file and not x.base_name.startswith(("_", ".")))

    def partitions(self) -> list[Files]:
        packs, size = [Files([])], 0
        for path, n in self._listed():
            own = facts(path)
            n *= EXPANDED if path.endswith((".gz", ".zip")) else 1
            if all(own.get(k) in values for k, values in self.kept):
                if packs[-1].paths and size + n > PACKED:
                    packs.append(Files([]))
                    size = 0
                packs[-1].paths.append(path)
                size += n
        return packs

    def read(self, partition: Files) -> Iterator[tuple]:
        from pyarrow import fs

        system, _ = fs.FileSystem.from_uri(self.path)
        for path in partition.paths:
            own = facts(path)
            with system.open_input_file(path) as f, opened(f) as stream:
                encoding = encoding_of(stream)
            with system.open_input_file(path) as f, opened(f) as stream:
                text = io.TextIOWrapper(stream, encoding, "replace" if encoding == "windows-1255" else "strict")
                for chain, store, tag, fields, codes in elements(iter(lambda t=text: t.read(CHUNK), "")):
                    yield (path, own.get("kind"), chain or own.get("chain_code"), (store.lstrip("0") or "0").zfill(3) if store else own.get("store_code"), own.get("stamp"), TAGS[tag], fields, codes)


class FeedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "retail_feed"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FeedReader:
        path = self.options["path"]
        return FeedReader(path if "://" in path or path.startswith("file:") else f"file://{path}")


def read(spark: SparkSession, path: str) -> DataFrame:
    """The raw records of a folder of feeds; filters on kind, chain_code, store_code and stamp reach the files."""
    spark.dataSource.register(FeedSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("retail_feed").load(path)


def prices(records: DataFrame) -> DataFrame:
    """Price records as feeds.read_prices gives them."""
    fields = [F.col("fields")[x].alias(x) for x in feeds.ITEM]
    return feeds.priced(records.where("tag = 'price'").select("file", "chain_code", "store_code", *fields))


def stores(records: DataFrame) -> DataFrame:
    return feeds.placed(records.where("tag = 'store'").select("file", "chain_code", *(F.col("fields")[x].alias(x) for x in feeds.STORE)))


def promotions(records: DataFrame) -> DataFrame:
    fields = [F.col("fields")[x].alias(x) for x in feeds.PROMOTION]
    return feeds.promoted(records.where("tag = 'promotion'").select("file", "chain_code", "store_code", *fields, F.col("item_codes").alias("codes")))
