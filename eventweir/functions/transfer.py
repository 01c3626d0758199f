"""File access from inside tasks.

Tasks open files by URI where they run; nothing passes through the driver.
"""

from __future__ import annotations

import hashlib
import os
import uuid

from pyarrow import fs

BLOCK = 4 * 1024 * 1024

#: What Spark escapes in folder names, besides control characters.
ESCAPED = "\"#%'*/:=?\\\x7f{[]^"


def open_location(location: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a location (plain path, ``file:``, ``hdfs:``,
    ``s3:``, ``s3a:``, ``gs:``).  The path is taken as it is: a percent sign
    belongs to the name."""
    scheme, separator, rest = location.partition("://")
    if not separator or scheme == "file":
        return fs.LocalFileSystem(), rest if separator else location.removeprefix("file:")
    authority, _, path = rest.partition("/")
    system, base = fs.FileSystem.from_uri(f"{'s3' if scheme == 's3a' else scheme}://{authority}/")
    return system, f"{base.rstrip('/')}/{path}"


def replace_file(system: fs.FileSystem, source: str, target: str) -> None:
    """Move a file over one that may be there.  HDFS does not move onto an
    existing file; should the job die in between, the target counts as missing."""
    if system.type_name == "hdfs" and system.get_file_info(target).type == fs.FileType.File:
        system.delete_file(target)
    system.move(source, target)


def subfolders(root: str) -> list[str]:
    """Names of the folders directly below ``root``; none when it is not there."""
    system, path = open_location(root)
    if system.get_file_info(path).type != fs.FileType.Directory:
        return []
    return sorted(f.base_name for f in system.get_file_info(fs.FileSelector(path)) if f.type == fs.FileType.Directory)


def file_names(root: str) -> list[str]:
    """Names of the files directly in ``root`` but those that start with an underscore or a dot."""
    system, path = open_location(root)
    found = system.get_file_info(fs.FileSelector(path, allow_not_found=True))
    return sorted(f.base_name for f in found if f.type == fs.FileType.File and not f.base_name.startswith(("_", ".")))


def list_folder(root: str, deep: bool, content_etag: bool = False) -> list[tuple]:
    """What lies in a folder (``deep``: all files at any depth below it):
    ``(location, is_folder, size, last_modified, etag)``.

    Names that start with an underscore or a dot are not data and left out.
    The etag is made of size and time, or from the content.
    """
    system, path = open_location(root)
    found = system.get_file_info(fs.FileSelector(path, recursive=deep, allow_not_found=True))
    base, out = path.rstrip("/"), []
    for info in found:
        below = info.path[len(base) :]
        if any(part.startswith(("_", ".")) for part in below.strip("/").split("/")):
            continue
        is_folder = info.type == fs.FileType.Directory
        if is_folder and deep:
            continue
        modified = (info.mtime_ns or 0) // 1_000_000
        etag = None
        if not is_folder:
            etag = _content_digest(system, info.path) if content_etag else f"{modified:x}-{info.size:x}"
        out.append((root.rstrip("/") + below, is_folder, info.size or 0, modified, etag))
    return out


def _content_digest(system: fs.FileSystem, path: str) -> str:
    digest = hashlib.md5()
    with system.open_input_stream(path, compression=None) as data:
        while block := data.read(BLOCK):
            digest.update(block)
    return digest.hexdigest()


def is_committed(folder: str) -> bool:
    """Did the Spark job that wrote this folder finish."""
    system, path = open_location(folder)
    return system.get_file_info(f"{path}/_SUCCESS").type == fs.FileType.File


def create_exclusive(location: str, content: bytes) -> bool:
    """Create a small file unless it is there; of several who try, one succeeds.

    The content is written beside it first, so that nobody sees half of it, and
    then linked (local files) or renamed (HDFS, where that does not replace).
    An object store offers neither here: what is there is seen, two who try at
    the same moment may both succeed."""
    system, path = open_location(location)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    if system.get_file_info(path).type != fs.FileType.NotFound:
        return False
    folder, _, name = path.rpartition("/")
    draft = f"{folder}/_{name}.{uuid.uuid4().hex}"
    with system.open_output_stream(draft) as out:
        out.write(content)
    try:
        if isinstance(system, fs.LocalFileSystem):
            os.link(draft, path)
        else:
            system.move(draft, path)
            return True
    except FileExistsError:
        return False
    except OSError:
        if system.get_file_info(path).type == fs.FileType.NotFound:
            raise
        return False
    finally:
        if system.get_file_info(draft).type == fs.FileType.File:
            system.delete_file(draft)
    return True


def read_small(location: str) -> bytes:
    """All of a small file."""
    system, path = open_location(location)
    with system.open_input_stream(path) as source:
        return source.read()


def concatenate(sources: list[str], target: str) -> int:
    """Write the bytes of ``sources``, in order, as ``target``; returns its size.

    The bytes go to a temporary name that is moved when complete, so readers
    never see half a file and a repeated attempt does no harm.
    """
    system, path = open_location(target)
    parent = path.rsplit("/", 1)[0]
    system.create_dir(parent, recursive=True)
    # Spark's readers skip names that start with an underscore.
    partial = f"{parent}/_{uuid.uuid4().hex}.partial"
    size = 0
    try:
        with system.open_output_stream(partial, compression=None) as out:
            for source in sources:
                origin, origin_path = open_location(source)
                with origin.open_input_stream(origin_path, compression=None) as data:
                    while block := data.read(BLOCK):
                        out.write(block)
                        size += len(block)
        replace_file(system, partial, path)
    except BaseException:
        if system.get_file_info(partial).type != fs.FileType.NotFound:
            system.delete_file(partial)
        raise
    written = system.get_file_info(path).size
    if written is not None and written != size:
        raise OSError(f"{target} has {written} bytes instead of {size}")
    return size


def unique_name(source: str) -> str:
    """A file's name after a digest of where it lies, as files of several folders may share one."""
    return f"{hashlib.md5(source.encode()).hexdigest()[:12]}-{source.rsplit('/', 1)[-1]}"


def object_name(root: str, event_type: str, date: str, hour: str, source: str) -> str:
    """Where a staged file belongs below ``root``, in folders as Spark names those of a bucket."""
    kind = "".join(f"%{ord(c):02X}" if c < " " or c in ESCAPED else c for c in event_type)
    return f"{root}/event_type={kind or '__HIVE_DEFAULT_PARTITION__'}/date={date}/hour={hour}/{unique_name(source)}"


def put_file(source: str, target: str) -> None:
    """Copy a file over one that may be there."""
    concatenate([source], target)


def is_file(location: str) -> bool:
    system, path = open_location(location)
    return system.get_file_info(path).type == fs.FileType.File


def remove_file(location: str) -> None:
    system, path = open_location(location)
    system.delete_file(path)


def move_into(source: str, folder: str) -> str:
    """Move a file into ``folder`` under a name that is unique to its old location."""
    system, path = open_location(source)
    target_system, target_dir = open_location(folder)
    target_system.create_dir(target_dir, recursive=True)
    target = f"{target_dir.rstrip('/')}/{unique_name(source)}"
    if system.get_file_info(path).type == fs.FileType.NotFound:
        # A repeated attempt finds the move already done.
        if target_system.get_file_info(target).type != fs.FileType.NotFound:
            return target
    system.move(path, target)
    return target
