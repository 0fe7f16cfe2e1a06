"""Readers and writers beside plain tables: JSON stores, CSV, versioned parquet, pages."""

from __future__ import annotations

import json
import os
import re
import time
import uuid
from collections.abc import Iterator
from functools import reduce
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON file or folder under a fixed schema; a missing path gives an empty table."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_envelopes(spark: SparkSession, glob: str, item_schema: str) -> DataFrame:
    """The ``items`` of all files of a pattern; of an id the first in file name order and
    then in file order is kept, items without id are dropped."""
    files = spark.read.schema(f"version int, source string, items array<struct<{item_schema}>>").option("multiLine", True).json(glob)
    rows = files.select(F.col("_metadata.file_path").alias("_f"), F.posexplode("items").alias("_i", "x")).where("x.candidate_id is not null")
    return rows.groupBy("x.candidate_id").agg(F.min_by("x", F.struct("_f", "_i")).alias("r")).select("r.*")


def read_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """All columns as text, empty cells as null; a fixed schema, so nothing is sampled."""
    return spark.read.schema(", ".join(f"`{c}` string" for c in columns)).csv(path, header=True, nullValue="", multiLine=True, escape='"')


def write_csv(df: DataFrame, path: str, columns: list[str]) -> None:
    df.select(*columns).write.mode("overwrite").csv(path, header=True, nullValue="", emptyValue="", escape='"')


def drop_malformed(raw: DataFrame, column: str, record_schema: str, valid) -> DataFrame:
    """Rows (key, record) of a JSON map per row: malformed records go, the rest stays."""
    rows = raw.select("*", F.explode(F.from_json(column, "map<string, string>")).alias("key", "json")).drop(column)
    return rows.withColumn("r", F.from_json("json", record_schema)).drop("json").select("*", "r.*").drop("r").where(valid)


def write_json(df: DataFrame, path: str) -> None:
    """One record a line with its keys in order. The folder is replaced as a whole: the
    write is committed before readers see it, or not at all."""
    df.select(*sorted(df.columns)).write.mode("overwrite").json(path)


def read_folder(spark: SparkSession, folder: str, schema: str, apart: tuple[str, ...] = ("schema.json",)) -> DataFrame:
    """The records of a folder's JSON files with the file's name in ``file``, but for the
    files named ``apart``."""
    name = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]*)$", 1)
    df = spark.read.schema(schema).option("multiLine", True).option("pathGlobFilter", "*.json").json(folder)
    return df.select("*", name.alias("file")).where(~F.col("file").isin(*apart))


def copy_changed(spark: SparkSession, source: str, target: str, known: DataFrame) -> DataFrame:
    """Copies the files of ``source`` that are new or newer than ``known`` (path, modified)
    says to ``target``, a folder on a file system that all workers mount, each under its
    place in ``source``; gives (path, modified, length) of those copied. A file appears
    whole or not: it is written beside its place and then moved there."""
    wanted = changed_files(spark, source, known)
    contents = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(source).select("path", "content")
    root = re.sub(r"^file:/*", "/", source).rstrip("/") + "/"
    out = re.sub(r"^file:/*", "/", target).rstrip("/") + "/"

    def run(batches):
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"]):
                at = out + re.sub(r"^file:/*", "/", path)[len(root) :]
                os.makedirs(os.path.dirname(at), exist_ok=True)
                half = f"{at}.{uuid.uuid4().hex}.part"
                with open(half, "wb") as f:
                    f.write(content)
                os.replace(half, at)
            yield pdf[["path", "modified", "length"]]

    return wanted.join(contents, "path").mapInPandas(run, "path string, modified timestamp, length long")


class VersionedStore:
    """A parquet table replaced as a whole, on any file system Spark can write to: a
    version is written beside the last, and the newest one whose job has committed (it
    has a ``_SUCCESS``) is the table; readers never see half of one."""

    def __init__(self, folder: str):
        self.folder = folder.rstrip("/")

    def version(self, spark: SparkSession) -> str | None:
        """The path of the current version, None without any."""
        pattern = spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/v*/_SUCCESS")
        found = pattern.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(pattern)
        return max((f.getPath().getParent().toString() for f in found or ()), default=None)

    def read(self, spark: SparkSession) -> DataFrame | None:
        v = self.version(spark)
        return None if v is None else spark.read.parquet(v)

    def write(self, df: DataFrame, number: int) -> None:
        df.write.parquet(f"{self.folder}/v{time.time_ns():020d}-{number}")


def stamped_files(spark: SparkSession, path: str) -> list[str]:
    """The data files below ``path`` as "path|length|time of change", in order."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(hadoop, True)
    out = []
    while found.hasNext():
        f = found.next()
        if not f.getPath().getName().startswith(("_", ".")):
            out.append(f"{f.getPath()}|{f.getLen()}|{f.getModificationTime()}")
    return sorted(out)


class CommitLog:
    """Parquet parts that only ever are added, in a line of commits: commit ``n`` is a
    small JSON file that names its part and carries a note. It is created only if there
    is none yet, so of two writers that saw the same state one is told to start over
    (on a file system where creation is exclusive). A part without a commit is not
    there."""

    def __init__(self, folder: str):
        self.folder = folder.rstrip("/")

    def _fs(self, spark: SparkSession, path: str):
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(spark._jsc.hadoopConfiguration())

    def commits(self, spark: SparkSession) -> list[tuple[str, dict]]:
        """(path of the part, note) of each commit, in order."""
        p, fs = self._fs(spark, f"{self.folder}/commits")
        if not fs.exists(p):
            return []
        names = sorted(f.getPath().toString() for f in fs.listStatus(p) if f.getPath().getName().endswith(".json"))
        out = []
        for n in names:
            at, _ = self._fs(spark, n)
            stream = fs.open(at)
            try:
                body = json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
            finally:
                stream.close()
            out.append((f"{self.folder}/{body['part']}", body["note"]))
        return out

    def commit(self, part: DataFrame, note: dict, after: int, partition_by: str | None = None) -> bool:
        """Writes ``part`` as commit number ``after``; False if that commit exists."""
        spark = part.sparkSession
        name = f"part-{after:08d}-{uuid.uuid4().hex}"
        w = part.write.partitionBy(partition_by) if partition_by else part.write
        w.parquet(f"{self.folder}/{name}")
        at, fs = self._fs(spark, f"{self.folder}/commits/{after:08d}.json")
        try:
            stream = fs.create(at, False)
        except Exception as e:
            if fs.exists(at):
                return False
            raise e
        stream.write(bytearray(json.dumps({"part": name, "note": note}).encode()))
        stream.close()
        return True


class LatestStore:
    """The latest row per key, from batches. A batch adds only its own latest rows; they
    are merged on reading, and every ``merge_after`` commits into one part from which
    reading starts. A batch that is run again changes nothing."""

    def __init__(self, folder: str, keys: list[str], order: list[str], merge_after: int = 32):
        self.log, self.keys, self.order, self.merge_after = CommitLog(folder), keys, order, merge_after

    def _latest(self, df: DataFrame) -> DataFrame:
        body = [c for c in df.columns if c not in self.keys]
        return df.groupBy(*self.keys).agg(F.max_by(F.struct(*body), F.struct(*self.order)).alias("r")).select(*self.keys, "r.*")

    def _current(self, spark: SparkSession) -> list[tuple[str, dict]]:
        commits = self.log.commits(spark)
        whole = [i for i, (_, note) in enumerate(commits) if note["whole"]]
        return commits[whole[-1] :] if whole else commits

    def write(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        while True:
            commits = self.log.commits(spark)
            if any(batch_id in note["batches"] for _, note in commits):
                return
            if self.log.commit(self._latest(batch), {"batches": [batch_id], "whole": False}, len(commits)):
                break
        if len(self._current(spark)) > self.merge_after:
            # if another writer was faster, the next batch merges
            self.log.commit(self.read(spark), {"batches": [], "whole": True}, len(commits) + 1)

    def read(self, spark: SparkSession) -> DataFrame | None:
        parts = [spark.read.parquet(at) for at, _ in self._current(spark)]
        return self._latest(reduce(DataFrame.unionByName, parts)) if parts else None


class _Anchors(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.found: list[list] = []
        self.text: list[str] = []
        self.open: list | None = None

    def handle_starttag(self, tag, attrs):
        href = dict(attrs).get("href")
        if tag == "a" and href:
            self.open = [href, "", len(self.text)]

    def handle_data(self, data):
        self.text.append(data)
        if self.open is not None:
            self.open[1] += data

    def handle_endtag(self, tag):
        if tag == "a" and self.open is not None:
            self.found.append(self.open)
            self.open = None


def anchors(html: str | None, suffixes: tuple[str, ...], around: int = 4) -> list[tuple[str, str, str]]:
    """(href, text, context) of links to files of the given suffixes, the first of each
    href; context is the text around. Broken markup is read as far as it goes."""
    if not html:
        return []
    p = _Anchors()
    p.feed(html)
    p.close()
    seen, out = set(), []
    for href, text, at in p.found:
        if href.lower().split("?")[0].endswith(suffixes) and href not in seen:
            seen.add(href)
            context = " ".join(" ".join(p.text[max(0, at - around) : at + around + 1]).split())
            out.append((href, " ".join(text.split()), context))
    return out


def absolute(base: str, href: str) -> str:
    from urllib.parse import urljoin

    return urljoin(base, href)


def extract_links(pages: DataFrame, suffixes: tuple[str, ...]) -> DataFrame:
    """(url, href, text, context) for every link of pages (url, html)."""

    def run(batches):
        for pdf in batches:
            rows = [(u, absolute(u or "", h), t, c) for u, html in zip(pdf["url"], pdf["html"]) for h, t, c in anchors(html, suffixes)]
            yield pd.DataFrame(rows, columns=["url", "href", "text", "context"])

    return pages.select("url", "html").mapInPandas(run, "url string, href string, text string, context string")


class PagedSource(DataSource):
    """A cursor- or offset-paged listing, one file of JSON a page, as a table. Options:
    ``path`` (folder of page-NNNN.json with {"items": [...], "next": n|null}), ``limit``
    (rows), ``stale`` (stop after so many pages without a new id), ``pause`` (seconds
    between pages). Pages depend on one another, so there is one partition; a page that
    can't be read is skipped, as one that failed to load would be."""

    @classmethod
    def name(cls) -> str:
        return "scorepages"

    def schema(self) -> str:
        return "page int, candidate_id string, item string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return PagedReader(self.options)


class PagedReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.limit = int(options.get("limit", 1 << 62))
        self.stale = int(options.get("stale", 2))
        self.pause = float(options.get("pause", 0))

    def partitions(self):
        return [InputPartition(0)]

    def read(self, partition) -> Iterator[tuple]:
        page, seen, stale, given = 0, set(), 0, 0
        while page is not None and stale < self.stale:
            try:
                with open(os.path.join(self.path, f"page-{page:04d}.json")) as f:
                    body = json.load(f)
            except FileNotFoundError:
                return
            except ValueError:
                page += 1
                continue
            fresh = [x for x in body.get("items", []) if x.get("candidate_id") and x["candidate_id"] not in seen]
            stale = 0 if fresh else stale + 1
            for x in fresh:
                if given >= self.limit:
                    return
                seen.add(x["candidate_id"])
                given += 1
                yield (page, x["candidate_id"], json.dumps(x, sort_keys=True))
            page = body.get("next")
            if self.pause:
                time.sleep(self.pause)


def read_members(spark: SparkSession, archives: str, wanted: DataFrame) -> DataFrame:
    """(archive, path, content) of the members of tar archives that ``wanted`` (path)
    names: each archive is read once, front to back, and joined to the short list."""
    import io
    import tarfile

    def run(batches):
        for pdf in batches:
            rows = []
            for path, blob in zip(pdf["path"], pdf["content"]):
                with tarfile.open(fileobj=io.BytesIO(bytes(blob)), mode="r:*") as tar:
                    for m in tar:
                        if m.isfile():
                            rows.append((path, re.sub(r"^\./", "", m.name), tar.extractfile(m).read()))
            yield pd.DataFrame(rows, columns=["archive", "path", "content"])

    files = spark.read.format("binaryFile").load(archives).select("path", "content")
    return files.mapInPandas(run, "archive string, path string, content binary").join(wanted.select("path"), "path", "left_semi")


def changed_files(spark: SparkSession, source: str, known: DataFrame) -> DataFrame:
    """Files newer than what is known of them, or unknown: (path, modified, length)."""
    now = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(source).select("path", F.col("modificationTime").alias("modified"), "length")
    return now.join(known.select("path", F.col("modified").alias("had")), "path", "left").where("had is null or modified > had").drop("had")
