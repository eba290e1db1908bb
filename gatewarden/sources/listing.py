"""Names and sizes of files, empty and nested ones too, as a Spark data source: folders are listed in tasks.

Spark's own file readers leave out files without a byte, so their names cannot come from these readers.
"""

from __future__ import annotations

import codecs
import json
import os
import re
import sys
from urllib.parse import unquote

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "file_path string, file_size long, encoding string"
BATCH = 10_000
#: Bytes at the start of a file by which its encoding is decided.
HEAD = 8192

# the reader goes to the workers as it is, so they need not have this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def hidden(name: str) -> bool:
    """Names that Spark's readers pass over."""
    return name.startswith(".") or (name.startswith("_") and "=" not in name) or name.endswith("._COPYING_")


def _encoding(system, path: str) -> str:
    """utf-8 where the head of a file is valid (a character that its end cuts is), else latin-1."""
    with system.open_input_stream(path) as f:
        head = f.read(HEAD)
    try:
        codecs.getincrementaldecoder("utf-8")().decode(head, final=len(head) < HEAD)
    except UnicodeDecodeError:
        return "latin-1"
    return "utf-8"


def _opened(uri: str):
    """The file system of a path, the path in it, and what makes names in it full again."""
    from pyarrow import fs

    if re.match("[A-Za-z][A-Za-z0-9+.-]*:", uri) is None:
        uri = "file://" + os.path.abspath(uri)
    scheme, rest = uri.split(":", 1)
    if scheme == "file":
        return fs.LocalFileSystem(), "/" + rest.lstrip("/"), "file:"
    system, path = fs.FileSystem.from_uri(uri)
    return system, path, uri[: len(uri) - len(path)] if uri.endswith(path) else scheme + "://"


def _globbed(path: str):
    """The folder before the first part with a wildcard, and a pattern for names in it (null: all)."""
    parts = path.split("/")
    wild = [k for k, p in enumerate(parts) if re.search(r"[*?\[{]", p)]
    if not wild:
        return path, None
    out, inside = "", False
    for c in path:
        if c == "{":
            out, inside = out + "(?:", True
        elif c == "}":
            out, inside = out + ")", False
        elif c == "," and inside:
            out += "|"
        else:
            out += {"*": "[^/]*", "?": "[^/]"}.get(c, c if c in "[]" else re.escape(c))
    return "/".join(parts[: wild[0]]) or "/", out + "(?:/.*)?"


class Listing(DataSourceReader):
    def __init__(self, options):
        self.paths, self.heads = json.loads(options["paths"]), options.get("encoding") == "true"

    def partitions(self):
        """One task for the files of each given folder, and one for each folder in it, which it lists whole (deep)."""
        from pyarrow import fs

        out = []
        for uri in self.paths:
            system, path, _ = _opened(uri)
            base, pattern = _globbed(path)
            out.append(InputPartition((uri, base, False, pattern)))
            if system.get_file_info(base).type == fs.FileType.Directory:
                out += [InputPartition((uri, i.path, True, pattern)) for i in system.get_file_info(fs.FileSelector(base)) if i.type == fs.FileType.Directory and not hidden(i.base_name)]
        return out

    def read(self, part):
        from pyarrow import RecordBatch, array, fs

        uri, top, deep, pattern = part.value
        system, _, prefix = _opened(uri)
        names, sizes, kinds, left = [], [], [], [top]

        def batch():
            return RecordBatch.from_arrays([array(names, "string"), array(sizes, "int64"), array(kinds, "string")], names=["file_path", "file_size", "encoding"])

        while left:
            info = system.get_file_info(left.pop())
            if info.type == fs.FileType.NotFound:
                raise FileNotFoundError(info.path)
            found = system.get_file_info(fs.FileSelector(info.path)) if info.type == fs.FileType.Directory else [info]
            for i in found:
                if hidden(i.base_name):
                    continue
                if i.type == fs.FileType.Directory:
                    left += [i.path] if deep else []
                elif pattern is None or re.fullmatch(pattern, i.path):
                    names.append(prefix + i.path)
                    sizes.append(i.size)
                    kinds.append(_encoding(system, i.path) if self.heads and i.size else None)
                if len(names) == BATCH:
                    yield batch()
                    names, sizes, kinds = [], [], []
        if names:
            yield batch()


class FileListing(DataSource):
    @classmethod
    def name(cls):
        return "gatewarden_files"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return Listing(self.options)


def list_files(spark: SparkSession, paths, encoding: bool = False) -> DataFrame:
    """file_path, file_size and (asked for, else null) encoding of every file under the paths (files, folders or globs),
    hidden ones left out; an empty file has no encoding.

    A path that is named twice, or lies in another, gives its files once. Paths of a scheme that only Spark's readers can
    open are listed by the index of those readers: names pass through the driver and encodings are null.
    """
    own, other = [], []
    for p in [paths] if isinstance(paths, str) else paths:
        try:
            _opened(p)
            own.append(p)
        except (ValueError, OSError):  # pyarrow does not know this scheme, or lacks its library
            other.append(p)
    out = spark.createDataFrame([], SCHEMA)
    if own:
        spark.dataSource.register(FileListing)
        out = spark.read.format("gatewarden_files").options(paths=json.dumps(own), encoding=encoding).load()
    if other:
        read = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(other)
        names = spark.createDataFrame([(unquote(x),) for x in read.inputFiles()], "file_path string")
        sizes = read.selectExpr("path AS file_path", "length AS n")
        out = out.unionByName(names.join(sizes, "file_path", "left").selectExpr("file_path", "coalesce(n, 0) AS file_size", "CAST(null AS string) AS encoding"))
    return out.distinct()
