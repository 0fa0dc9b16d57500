"""Walking and reading a source repository."""

from __future__ import annotations

import os
import re
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _pattern(glob: str) -> str:
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        elif glob[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif glob[i] == "?":
            out, i = out + "[^/]", i + 1
        elif glob[i] == "[" and "]" in glob[i + 1 :]:
            j = glob.index("]", i + 1)
            out, i = out + "[" + glob[i + 1 : j].replace("!", "^", 1) + "]", j + 1
        elif glob[i] == "\\" and i + 1 < len(glob):
            out, i = out + re.escape(glob[i + 1]), i + 2
        else:
            out, i = out + re.escape(glob[i]), i + 1
    return out


class Ignore:
    """Rules of one ignore file: later rules win, ! takes back, a trailing slash means folders only, and a
    slash elsewhere ties the rule to the file's own folder."""

    def __init__(self, text: str) -> None:
        self.rules = []
        for raw in text.splitlines():
            line = raw.rstrip() if not raw.endswith("\\ ") else raw
            if not line or line.startswith("#"):
                continue
            keep = line.startswith("!")
            line = line[1:] if keep else line
            folder = line.endswith("/")
            line = line.rstrip("/")
            tied = "/" in line
            line = line.lstrip("/")
            self.rules.append((re.compile(("" if tied else "(?:.*/)?") + _pattern(line) + r"\Z", re.S), folder, not keep))

    def says(self, rel: str, is_dir: bool) -> bool | None:
        for rule, folder, ignored in reversed(self.rules):
            if (is_dir or not folder) and rule.match(rel):
                return ignored
        return None


def walk(root: str) -> list[tuple[str, bool]]:
    """(path below root, is a folder) of what isn't ignored or hidden, folders before what they hold,
    siblings by name. Symbolic links aren't followed and count as files. Unreadable folders are an error."""
    top = Path(root)
    out: list[tuple[str, bool]] = []

    def rules(folder: Path) -> Ignore | None:
        text = "".join(p.read_text("utf-8", "replace") + "\n" for name in (".gitignore", ".ignore") if (p := folder / name).is_file())
        return Ignore(text) if text else None

    def visit(folder: Path, rel: str, above: list[tuple[str, Ignore]]) -> None:
        own = rules(folder)
        here = [*above, (rel, own)] if own else above
        for entry in sorted(os.scandir(folder), key=lambda e: os.fsencode(e.name)):
            if entry.name.startswith("."):
                continue
            path = f"{rel}/{entry.name}" if rel else entry.name
            is_dir = entry.is_dir(follow_symlinks=False)
            verdict = None
            for base, ignore in reversed(here):
                verdict = ignore.says(path[len(base) + 1 :] if base else path, is_dir)
                if verdict is not None:
                    break
            if verdict:
                continue
            out.append((path, is_dir))
            if is_dir:
                visit(top / path, path, here)

    visit(top, "", [])
    return out


def files(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """(paths, contents): paths (path, is_dir) from a walk on the driver, which sees the folder, and
    contents (path, content) of UTF-8 files, read by the executors. What can't be read as UTF-8 has no
    row in contents."""
    found = walk(root)
    paths = spark.createDataFrame(found, "path string, is_dir boolean")
    base = "file://" + str(Path(root).resolve())
    if not any(not d for _, d in found):
        return paths, spark.createDataFrame([], "path string, content string")
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(base)
    rel = F.replace(F.expr(f"url_decode(replace(substring_index(path, '{base[7:]}/', -1), '+', '%2B'))"), F.lit("\\"), F.lit("/"))
    text = raw.select(rel.alias("path"), F.col("content").cast("string").alias("s"))
    wanted = F.broadcast(paths.filter("not is_dir").select("path")) if len(found) <= 200_000 else paths.filter("not is_dir").select("path")
    return paths, text.filter(F.is_valid_utf8("s")).select("path", F.col("s").alias("content")).join(wanted, "path", "left_semi")
