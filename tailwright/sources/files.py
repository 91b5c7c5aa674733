"""Listing files and reading ranges of them on the workers, by the paths and settings that Spark has for their stores."""

from __future__ import annotations

from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from urllib.parse import urlsplit

from pyarrow import fs
from pyspark.sql import SparkSession

BLOCK = 1 << 20
#: Settings of stores that workers need, by their beginnings.
SETTINGS = ("fs.s3a.", "fs.azure.account.key.", "fs.azure.sas.")
_OPEN: dict[tuple, fs.FileSystem] = {}
_LOCAL = fs.LocalFileSystem()


def store_settings(spark: SparkSession) -> dict[str, str]:
    """What Spark's Hadoop configuration says on access to object stores."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    found = {}
    for prefix in SETTINGS:
        matching = conf.getPropsWithPrefix(prefix)
        found |= {prefix + k: matching.get(k) for k in matching}
    return found


def _s3(bucket: str, settings: dict[str, str]) -> fs.FileSystem:
    own = lambda k: settings.get(f"fs.s3a.bucket.{bucket}.{k}") or settings.get(f"fs.s3a.{k}")
    given = {
        "access_key": own("access.key"), "secret_key": own("secret.key"), "session_token": own("session.token"),
        "endpoint_override": own("endpoint"), "region": own("endpoint.region"),
        "anonymous": True if "Anonymous" in (own("aws.credentials.provider") or "") else None,
        "force_virtual_addressing": True if own("path.style.access") == "false" else None,
        "scheme": "http" if own("connection.ssl.enabled") == "false" else None,
    }
    return fs.S3FileSystem(**{k: v for k, v in given.items() if v is not None})


def _azure(account: str, settings: dict[str, str]) -> fs.FileSystem:
    return fs.AzureFileSystem(account_name=account.split(".")[0], account_key=settings.get(f"fs.azure.account.key.{account}"))


def place(uri: str, settings: dict[str, str] | None = None) -> tuple[fs.FileSystem, str]:
    """The file system of a URI or local path, and the path in it.

    file:, s3:, s3a:, s3n:, abfs:, abfss:, wasb: and wasbs: with Spark's settings; gs: and hdfs: with those of the machine. Other schemes are a ValueError:
    only Spark's own readers know them.
    """
    if ":" not in uri.split("/")[0]:
        return _LOCAL, uri
    at = urlsplit(uri)
    if at.scheme == "file":
        return _LOCAL, uri.removeprefix("file:").replace("//", "", 1) if uri.startswith("file://") else uri.removeprefix("file:")
    key = (at.scheme, at.netloc)
    if at.scheme in ("s3", "s3a", "s3n"):
        if key not in _OPEN:
            _OPEN[key] = _s3(at.netloc, settings or {})
        return _OPEN[key], at.netloc + uri.split(at.netloc, 1)[1]
    if at.scheme in ("abfs", "abfss", "wasb", "wasbs"):
        container, _, account = at.netloc.rpartition("@")
        if key not in _OPEN:
            _OPEN[key] = _azure(account, settings or {})
        return _OPEN[key], f"{container}{uri.split(at.netloc, 1)[1]}"
    try:
        return fs.FileSystem.from_uri(uri)
    except (ValueError, OSError, ImportError) as e:
        raise ValueError(f"only Spark reads {at.scheme}: {e}") from e


def reachable(uri: str, settings: dict[str, str] | None = None) -> bool:
    """Whether workers can open files of this store themselves."""
    try:
        place(uri, settings)
    except ValueError:
        return False
    return True


def _before(root: str, path: str) -> str:
    """What a path in the store lacks of its URI; nothing for local ones."""
    return root[: len(root) - len(path)] if ":" in root.split("/")[0] and not root.startswith("file:") else ""


def top_of(root: str, settings: dict[str, str] | None = None) -> tuple[list[str], list[tuple[str, int]]]:
    """The folders that lie in a folder, and its files with their sizes; none if it is missing."""
    store, path = place(root, settings)
    before, top = _before(root, path), store.get_file_info(fs.FileSelector(path, allow_not_found=True))
    return [before + x.path for x in top if x.type == fs.FileType.Directory], [(before + x.path, x.size) for x in top if x.is_file]


def walk(root: str, ending: str, settings: dict[str, str] | None = None) -> Iterator[tuple[str, int]]:
    """Path and size of every file under a folder whose name ends so; none if the folder is missing. Folders are listed side by side."""
    store, path = place(root, settings)
    before = _before(root, path)
    top = store.get_file_info(fs.FileSelector(path, allow_not_found=True))
    with ThreadPoolExecutor(16) as pool:
        below = pool.map(lambda d: store.get_file_info(fs.FileSelector(d.path, recursive=True, allow_not_found=True)), [x for x in top if x.type == fs.FileType.Directory])
        for infos in ([x for x in top if x.is_file], *below):
            yield from ((before + x.path, x.size) for x in infos if x.is_file and x.path.endswith(ending))


def read_range(uri: str, start: int, end: int, settings: dict[str, str] | None = None) -> Iterator[bytes]:
    """The bytes [start, end) in blocks; less where the file is shorter."""
    store, path = place(uri, settings)
    with store.open_input_file(path) as f:
        while start < end:
            block = f.read_at(min(BLOCK, end - start), start)
            if not block:
                return
            yield block
            start += len(block)


def behind_last_newline(uri: str, at: int, settings: dict[str, str] | None = None) -> int:
    """The position behind the last newline ahead of ``at``, 0 if there is none; reads backwards."""
    store, path = place(uri, settings)
    with store.open_input_file(path) as f:
        while at > 0:
            low = max(0, at - (1 << 16))
            k = f.read_at(at - low, low).rfind(b"\n")
            if k >= 0:
                return low + k + 1
            at = low
    return 0


def write_once(uri: str, data: bytes, attempt: str) -> None:
    """Write under a name of this attempt, then move: a repeated task leaves one whole file. A folder is made when one is missing."""
    store, path = place(uri)
    try:
        out = store.open_output_stream(f"{path}.{attempt}", buffer_size=0)
    except FileNotFoundError:
        store.create_dir(path.rsplit("/", 1)[0], recursive=True)
        out = store.open_output_stream(f"{path}.{attempt}", buffer_size=0)
    with out:
        out.write(data)
    store.move(f"{path}.{attempt}", path)
