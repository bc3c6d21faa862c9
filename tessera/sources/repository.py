"""A repository of Markdown files as a table.

scan() lists folders in tasks, level by level, orders and limits files by metadata alone, and reads them in tasks. The data source of the same rows, for a tree that
is small enough for it, lists on the driver. With more than one machine the folder must be on a file system that all of them mount.
"""

from __future__ import annotations

import functools
import json
import os
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from tessera import schemas
from tessera.config import DiscoveryConfig
from tessera.errors import DiscoveryError
from tessera.operators.order import numbered
from tessera.sources.ignore import Rules, custom_rules

FILE_LIMIT, TOO_LARGE, INVALID_UTF8 = "file_limit", "too_large", "invalid_utf8"
FORMAT = "markdown_repository"


@dataclass(frozen=True)
class Candidate:
    path: str  # relative, with slashes
    ord: int
    bytes: int
    reason: str | None
    max_bytes: int | None


def is_markdown(name: str) -> bool:
    stem, dot, extension = name.rpartition(".")
    return bool(stem and dot) and extension.lower() == "md" and extension.isascii()


def _read_lines(path: str) -> list[str]:
    try:
        with open(path, encoding="utf-8", errors="replace") as f:
            return f.read().splitlines()
    except OSError:
        return []


@dataclass(frozen=True)
class Ignored:
    """What is ignored in a whole repository, besides the .gitignore files that lie in its folders: names, lines of extra ignore files, lines of .git/info/exclude."""

    names: tuple[str, ...]
    gitignore: bool
    extra: tuple[str, ...]
    exclude: tuple[str, ...]


def ignored(root: str, config: DiscoveryConfig) -> Ignored:
    try:
        extra = tuple(open(p, encoding="utf-8").read() for p in config.ignore_files)
    except OSError as e:
        raise DiscoveryError(f"cannot read an ignore file: {e}") from e
    return Ignored(config.excluded_names, config.respect_gitignore, extra, tuple(_read_lines(os.path.join(root, ".git", "info", "exclude"))) if config.respect_gitignore else ())


@functools.lru_cache(1024)
def _rules(lines: tuple[str, ...]) -> Rules:
    return Rules(list(lines))


@functools.lru_cache(16)
def _extra_rules(texts: tuple[str, ...]) -> list[Rules]:
    return custom_rules(list(texts))


#: The .gitignore files above and in a folder: the folder of each, and its lines.
Chain = tuple[tuple[str, tuple[str, ...]], ...]


def list_folder(root: str, folder: str, chain: Chain, rules: Ignored) -> tuple[Chain, list[tuple[str, bool]]]:
    """The chain of a folder's own entries, and its folders (true) and Markdown files that no rule excludes, by name. Symbolic links are not followed."""
    if rules.gitignore:
        own = tuple(_read_lines(os.path.join(root, folder, ".gitignore")))
        chain = (*chain, (folder, own)) if _rules(own).rules else chain
    try:
        entries = sorted(os.scandir(os.path.join(root, folder)), key=lambda e: e.name)
    except OSError as e:
        raise DiscoveryError(f"cannot list {folder or root}: {e}") from e
    found = []
    for entry in entries:
        path = f"{folder}/{entry.name}" if folder else entry.name
        is_dir = entry.is_dir(follow_symlinks=False)
        if entry.name in rules.names or any(r.ignores_or_a_parent(path, is_dir) for r in _extra_rules(rules.extra)):
            continue
        said = None
        for base, lines in reversed(chain):
            said = _rules(lines).verdict(path[len(base) + 1 :] if base else path, is_dir)
            if said is not None:
                break
        if said is None and rules.exclude:
            said = _rules(rules.exclude).verdict(path, is_dir)
        if not said and (is_dir or entry.is_file(follow_symlinks=False) and is_markdown(entry.name)):
            found.append((path, is_dir))
    return chain, found


def walk(root: str, config: DiscoveryConfig) -> Iterator[str]:
    """Relative paths of the Markdown files that no rule excludes."""
    rules = ignored(root, config)

    def below(folder: str, chain: Chain) -> Iterator[str]:
        chain, found = list_folder(root, folder, chain, rules)
        for path, is_dir in found:
            if is_dir:
                yield from below(path, chain)
            else:
                yield path

    yield from below("", ())


def plan(root: str, config: DiscoveryConfig, excluded_paths: tuple[str, ...] = ()) -> list[Candidate]:
    """Candidates by path components; those beyond max_files and those over the size limit have a reason and are not read."""
    if not os.path.isdir(root):
        raise DiscoveryError(f"{root} is not a directory")
    hidden = {os.path.realpath(p) for p in excluded_paths}
    paths = sorted((p for p in walk(root, config) if not hidden or os.path.realpath(os.path.join(root, p)) not in hidden), key=lambda p: [c.encode("utf-8", "surrogateescape") for c in p.split("/")])
    out = []
    for k, path in enumerate(paths):
        if config.max_files is not None and k >= config.max_files:
            out.append(Candidate(path, k, 0, FILE_LIMIT, None))
            continue
        size = os.stat(os.path.join(root, path)).st_size
        out.append(Candidate(path, k, size, TOO_LARGE if size > config.max_bytes_per_file else None, config.max_bytes_per_file))
    return out


@dataclass
class _Files(InputPartition):
    files: list[Candidate]


class RepositorySource(DataSource):
    """spark.read.format("markdown_repository").option("path", ...).load(); options: config (JSON of DiscoveryConfig), excluded (JSON list), group_bytes."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> StructType:
        return schemas.SCANNED

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options)


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.root = options["path"]
        raw = json.loads(options.get("config", "{}"))
        self.config = DiscoveryConfig(**{k: tuple(v) if isinstance(v, list) else v for k, v in raw.items()})
        self.excluded = tuple(json.loads(options.get("excluded", "[]")))
        self.group_bytes = int(options.get("group_bytes", str(8 << 20)))

    def partitions(self) -> list[InputPartition]:
        groups: list[list[Candidate]] = [[]]
        size = 0
        for c in plan(self.root, self.config, self.excluded):
            read = 0 if c.reason else c.bytes
            if groups[-1] and size + read > self.group_bytes:
                groups.append([])
                size = 0
            groups[-1].append(c)
            size += read
        return [_Files(g) for g in groups]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for c in partition.files:
            if c.reason:
                large = c.reason == TOO_LARGE
                yield c.path, c.ord, None, c.reason, c.bytes if large else None, c.max_bytes if large else None
                continue
            with open(os.path.join(self.root, c.path), "rb") as f:
                raw = f.read()
            try:
                text = raw.decode("utf-8")
            except UnicodeDecodeError:
                yield c.path, c.ord, None, INVALID_UTF8, None, None
                continue
            yield c.path, c.ord, text.replace("\r\n", "\n").replace("\r", "\n"), None, None, None


LISTED = "path string, chain string, folder boolean, bytes long"


def list_files(spark: SparkSession, root: str, config: DiscoveryConfig, keep: Callable[[DataFrame], DataFrame], excluded_paths: tuple[str, ...] = ()) -> DataFrame:
    """(path, bytes) of the Markdown files that no rule excludes. Folders are rows, which tasks list, level by level, each with the ignore rules above it;
    what one level finds is kept, and its folders are the next. The driver learns only whether there are any."""
    rules, hidden = ignored(root, config), {os.path.realpath(p) for p in excluded_paths}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for folder, above in zip(batch["path"], batch["chain"]):
                chain, found = list_folder(root, folder, tuple((base, tuple(lines)) for base, lines in json.loads(above)), rules)
                told = json.dumps(chain)
                for path, is_dir in found:
                    full = os.path.join(root, path)
                    if is_dir:
                        rows.append((path, told, True, None))
                    elif not hidden or os.path.realpath(full) not in hidden:
                        rows.append((path, None, False, os.stat(full).st_size))
            yield pd.DataFrame(rows, columns=["path", "chain", "folder", "bytes"]).astype({"bytes": "Int64"})

    level, found = spark.createDataFrame([("", "[]")], "path string, chain string"), []
    while True:
        listed = keep(level.repartition("path").mapInPandas(run, LISTED))
        found.append(listed.where("NOT folder").select("path", "bytes"))
        level = listed.where("folder").select("path", "chain")
        if level.isEmpty():
            return functools.reduce(DataFrame.unionByName, found)


def scan(spark: SparkSession, root: str, config: DiscoveryConfig = DiscoveryConfig(), excluded_paths: tuple[str, ...] = (), keep: Callable[[DataFrame], DataFrame] | None = None, group_bytes: int = 8 << 20) -> DataFrame:
    """SCANNED: every candidate, with its text or the reason why it has none. Listing, order and limits are of rows, and tasks read about group_bytes of files each.
    keep writes a table and reads it again; without one, tables live as long as the driver."""
    if not os.path.isdir(root):
        raise DiscoveryError(f"{root} is not a directory")
    if keep is None:
        from tessera.plans.files import Written

        keep = Written(spark)
    root = os.path.abspath(root)
    listed = numbered(list_files(spark, root, config, keep, excluded_paths), [F.split("path", "/")], "file_ord", keep)
    over = F.lit(False) if config.max_files is None else F.col("file_ord") >= config.max_files
    large = F.col("bytes") > config.max_bytes_per_file
    judged = listed.withColumn("reason", F.when(over, FILE_LIMIT).when(large, TOO_LARGE))
    size = judged.where("reason IS NULL").agg(F.sum("bytes")).first()[0] or 0

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, held = [], 0
            for row in batch.to_pylist():
                text, reason, sized = None, row["reason"], row["reason"] == TOO_LARGE
                if reason is None:
                    with open(os.path.join(root, row["path"]), "rb") as f:
                        raw = f.read()
                    held += len(raw)
                    try:
                        text = raw.decode("utf-8").replace("\r\n", "\n").replace("\r", "\n")
                    except UnicodeDecodeError:
                        reason = INVALID_UTF8
                rows.append({"path": row["path"], "file_ord": row["file_ord"], "text": text, "reason": reason, "bytes": row["bytes"] if sized else None, "max_bytes": config.max_bytes_per_file if sized else None})
                if held > 4 << 20:
                    yield pa.RecordBatch.from_pylist(rows, _ARROW)
                    rows, held = [], 0
            yield pa.RecordBatch.from_pylist(rows, _ARROW)

    return judged.repartition(max(1, -(-size // group_bytes)), "file_ord").mapInArrow(read, schemas.SCANNED)


_ARROW = pa.schema([("path", pa.string()), ("file_ord", pa.int64()), ("text", pa.string()), ("reason", pa.string()), ("bytes", pa.int64()), ("max_bytes", pa.int64())])


def documents(scanned: DataFrame) -> DataFrame:
    return scanned.where("reason IS NULL").select("path", "file_ord", "text")


def skipped(scanned: DataFrame) -> DataFrame:
    return scanned.where("reason IS NOT NULL").select("path", "reason", "bytes", "max_bytes")


# the same rules for a corpus that is a table already: (path, text)

def select_files(files: DataFrame, config: DiscoveryConfig = DiscoveryConfig(), size: str = "bytes", keep: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """files (path, bytes) that are Markdown, with file_ord by path components and the reason for which a file is skipped.

    With a limit, files are numbered range by range, which needs keep (it writes a table and reads it again). Rows of one path count one by one, in any
    order. Without a limit no order is made.
    """
    named = files.where(F.col("path").rlike(r"(^|/)[^/]+\.[mM][dD]$"))
    if config.max_files is None:
        ordered, over = named.withColumn("file_ord", F.lit(None).cast("long")), F.lit(False)
    else:
        if keep is None:
            raise DiscoveryError("a limit on the number of files needs somewhere to keep their order")
        ordered, over = numbered(named, [F.split("path", "/")], "file_ord", keep), F.col("file_ord") >= config.max_files
    large = F.col(size) > config.max_bytes_per_file
    reason = F.when(over, FILE_LIMIT).when(large, TOO_LARGE)
    return ordered.withColumns({"reason": reason, "max_bytes": F.when(reason == TOO_LARGE, F.lit(config.max_bytes_per_file).cast("long"))})
