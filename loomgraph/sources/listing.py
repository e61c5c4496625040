"""Names below a folder, and what ignore files say about them."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

from pyarrow import fs

#: Folders that are never walked.
SKIPPED = (".git", "node_modules", "target", "dist", "build", "__pycache__", ".venv")


def glob_pattern(glob: str) -> str:
    """A pattern in which * and ? stop at slashes and ** doesn't."""
    out, i = [], 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out.append("(?:.*/)?")
            i += 3
        elif glob.startswith("**", i):
            out.append(".*")
            i += 2
        else:
            out.append({"*": "[^/]*", "?": "[^/]"}.get(glob[i], re.escape(glob[i])))
            i += 1
    return "".join(out)


def ignore_rules(files: list[tuple[str, str]]) -> list[tuple[str, bool]]:
    """(pattern over paths, whether it brings a path back) of ignore files (folder, text), outer ones first, in the order of their lines.

    A pattern with a slash before its end counts from its own folder, others at any depth; one that ends with a slash means a folder.
    """
    out = []
    for folder, text in sorted(files):
        base = re.escape(folder + "/") if folder else ""
        for line in text.splitlines():
            line = line.rstrip()
            if not line or line.startswith("#"):
                continue
            back, glob = line.startswith("!"), line.lstrip("!")
            only_folder, glob = glob.endswith("/"), glob.rstrip("/")
            anchored, glob = "/" in glob, glob.lstrip("/")
            out.append((f"^{base}{'' if anchored else '(?:.*/)?'}{glob_pattern(glob)}(?:{'/.*' if only_folder else '/.*|'})$", back))
    return out


def is_ignored(path: str, rules: list[tuple[str, bool]]) -> bool:
    """The last rule that matches decides."""
    return next((not back for p, back in reversed(rules) if re.match(p, path)), False)


def entries(files: fs.FileSystem, folder: str) -> Iterator[tuple]:
    """(path, whether it is a folder, size, time in ms) in a folder; of a local one it is never all in memory."""
    if isinstance(files, fs.LocalFileSystem):
        with os.scandir(folder) as found:
            for x in found:
                if x.is_dir():
                    yield f"{folder}/{x.name}", True, 0, 0
                else:
                    try:
                        at = x.stat()
                    except FileNotFoundError:
                        continue  # gone meanwhile, or a link to nowhere
                    yield f"{folder}/{x.name}", False, at.st_size, at.st_mtime_ns // 1_000_000
    else:
        for info in files.get_file_info(fs.FileSelector(folder)):
            yield info.path, info.type == fs.FileType.Directory, info.size, (info.mtime_ns or 0) // 1_000_000


def walk_names(files: fs.FileSystem, folder: str, root: str, skipped: tuple = SKIPPED, deep: bool = True) -> Iterator[tuple]:
    """Files (path below the root, size, time in ms, text of an ignore file or None) in a folder and, if deep, in all below it."""
    open_ = [folder]
    while open_:
        for path, is_folder, size, when in entries(files, open_.pop()):
            name = path.rpartition("/")[2]
            if not is_folder:
                text = None
                if name == ".gitignore":
                    with files.open_input_stream(path) as f:
                        text = f.read().decode("utf-8", "replace")
                yield path[len(root) + 1 :], size, when, text
            elif deep and name not in skipped:
                open_.append(path)


def walk_kept(files: fs.FileSystem, root: str, skipped: tuple = SKIPPED) -> Iterator[tuple[str, int, int]]:
    """(path below the root, size, time in ms) of all files that no ignore file names, without skipped folders and ignore files.

    A path is ignored by the files in the folders that it lies in only, and those are read before what is in them is listed. So
    nothing is held but the folders that are still to be walked, with their rules.
    """
    open_ = [(root, [])]
    while open_:
        folder, rules = open_.pop()
        own = f"{folder}/.gitignore"
        if files.get_file_info(own).type == fs.FileType.File:
            with files.open_input_stream(own) as f:
                rules = rules + ignore_rules([(folder[len(root) + 1 :], f.read().decode("utf-8", "replace"))])
        for path, is_folder, size, when in entries(files, folder):
            name = path.rpartition("/")[2]
            if is_folder:
                if name not in skipped:
                    open_.append((path, rules))
            elif name != ".gitignore" and not is_ignored(path[len(root) + 1 :], rules):
                yield path[len(root) + 1 :], size, when
