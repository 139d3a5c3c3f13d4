"""Files on any file system that pyarrow knows: mounted paths, file:, hdfs:, s3: (s3a: as well), gs:.

Paths stay the URIs that Spark uses; every function finds the file system from the path, so nothing but paths goes to tasks.
hdfs: needs the client library of Hadoop on the workers.
"""

from __future__ import annotations

from fnmatch import fnmatchcase

from pyarrow import fs

from ..functions.text import natural_key

#: Schemes of Spark that pyarrow has under another name.
SCHEMES = {"s3a": "s3", "s3n": "s3"}


def located(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path, and the path in it."""
    scheme, colon, rest = path.partition(":")
    if not colon or "/" in scheme:
        return fs.LocalFileSystem(), path
    if scheme == "file":
        return fs.LocalFileSystem(), "/" + rest.lstrip("/")
    return fs.FileSystem.from_uri(f"{SCHEMES.get(scheme, scheme)}:{rest}")


def expand(path: str) -> list[str]:
    """The files that a pattern names, in natural order; a path without wildcards is itself, whether it exists or not. As in a shell,
    wildcards do not match a leading dot; names with a leading underscore are passed over as well."""
    if not any(c in path for c in "*?["):
        return [path]
    system, inner = located(path)
    prefix, parts = path[: len(path) - len(inner)] if path.endswith(inner) else "", inner.split("/")
    at = next(i for i, p in enumerate(parts) if any(c in p for c in "*?["))
    root, wanted = "/".join(parts[:at]) or ("/" if inner.startswith("/") else "."), parts[at:]

    def matches(info: fs.FileInfo) -> bool:
        names = info.path.split("/")[-len(wanted) :]
        hidden = any(n[:1] in "._" and w[:1] not in "._" for n, w in zip(names, wanted, strict=False))
        deep = len(info.path.strip("/").split("/")) - len([p for p in root.strip("/").split("/") if p]) if root != "." else len(info.path.split("/"))
        return deep == len(wanted) and not hidden and all(fnmatchcase(n, w) for n, w in zip(names, wanted, strict=True))

    found = system.get_file_info(fs.FileSelector(root, recursive=len(wanted) > 1, allow_not_found=True))
    return sorted((prefix + i.path for i in found if matches(i)), key=natural_key)


def kind(path: str) -> str:
    """file, folder or none."""
    system, inner = located(path)
    return {fs.FileType.File: "file", fs.FileType.Directory: "folder"}.get(system.get_file_info(inner).type, "none")


def size(path: str) -> int:
    system, inner = located(path)
    return system.get_file_info(inner).size


def names(folder: str) -> list[str]:
    """Names of what lies in a folder."""
    system, inner = located(folder)
    return [i.base_name for i in system.get_file_info(fs.FileSelector(inner, allow_not_found=True))]


def reading(path: str):
    system, inner = located(path)
    return system.open_input_file(inner)


def writing(path: str):
    """A stream to a new file, whose folder is made; what is written appears when it is closed on object stores."""
    system, inner = located(path)
    if "/" in inner:
        system.create_dir(inner.rsplit("/", 1)[0], recursive=True)
    return system.open_output_stream(inner)


def move(source: str, target: str) -> None:
    system, inner = located(source)
    system.move(inner, located(target)[1])


def remove(path: str) -> None:
    system, inner = located(path)
    if system.get_file_info(inner).type == fs.FileType.File:
        system.delete_file(inner)
