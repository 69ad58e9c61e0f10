"""Reading a repository from disk, and the landing steps before it."""

from __future__ import annotations

import io
import os
import re
import zipfile
from collections.abc import Callable
from urllib.parse import urlparse

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Extensions of text files that are indexed, names that are not.
TEXT_EXTENSIONS = tuple("xml yml yaml properties toml ini conf cfg sql md txt json html css js ts vue proto sh bat".split())
SKIPPED_NAMES = ("package-lock.json", "yarn.lock", "pnpm-lock.yaml", "composer.lock", "poetry.lock")
EXCLUDED = ("**/target/**", "**/build/**", "**/node_modules/**", "**/dist/**", "**/.git/**")
MAX_KB = 2048
MAX_LINES = 20_000
ARCHIVE_BYTES = 200 << 20
INFLATED_BYTES = 2 << 30


def glob_pattern(glob: str) -> str:
    """A glob as a regular expression; **/x/** also matches x/ at the root."""
    out, i = "", 0
    if glob.startswith("**/"):
        out, i = "(?:.*/)?", 3
    while i < len(glob):
        if glob[i : i + 2] == "**":
            out, i = out + ".*", i + 2
        elif glob[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif glob[i] == "?":
            out, i = out + "[^/]", i + 1
        else:
            out, i = out + re.escape(glob[i]), i + 1
    return f"^{out}$"


def excluded(path: Column, globs: tuple[str, ...] = EXCLUDED) -> Column:
    hit = F.lit(False)
    for g in globs:
        hit = hit | path.rlike(glob_pattern(g))
    return hit


def scanned(spark: SparkSession, root: str, globs: tuple[str, ...] = EXCLUDED) -> DataFrame:
    """All files under root that are not excluded: path (relative), length, content.

    The filter uses the path alone, so excluded files are listed but never read.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = os.path.abspath(root) if "://" not in root else root
    relative = F.regexp_replace("path", "^.*?" + re.escape(base.rstrip("/")) + "/", "")
    return files.select(relative.alias("path"), "length", "content").where(~excluded(F.col("path"), globs))


def is_text_path(path: Column) -> Column:
    name = F.lower(F.substring_index(path, "/", -1))
    return F.substring_index(name, ".", -1).isin(*TEXT_EXTENSIONS) & name.contains(".") & ~name.isin(*SKIPPED_NAMES)


def source_roots(paths: DataFrame) -> DataFrame:
    """Distinct folders ending in src/main/java; the empty path (the root) if there are none."""
    root = F.regexp_extract("path", r"^((?:.*/)?src/main/java)/", 1)
    found = paths.select(root.alias("root")).where((F.col("root") != "") & ~F.col("root").contains("/target/")).distinct()
    none = found.agg(F.count("*").alias("n")).where("n = 0").select(F.lit("").alias("root"))
    return found.unionByName(none)


def java_files(files: DataFrame) -> DataFrame:
    """Java files under a source root, each once, in path order."""
    roots = F.broadcast(source_roots(files))  # one row a module of the repository
    own = files.where(F.col("path").endswith(".java"))
    under = (F.col("root") == "") | F.col("path").startswith(F.concat(F.col("root"), F.lit("/")))
    return own.join(roots, under, "left_semi").orderBy("path")


def text_files(files: DataFrame, max_kb: int = MAX_KB, max_lines: int = MAX_LINES) -> DataFrame:
    """Text files with loc, parsed_ok and parse_error; what is too large stays as a failed row."""
    own = files.where(is_text_path(F.col("path")))
    big = F.floor(F.col("length") / 1024) > max_kb
    good = F.is_valid_utf8("content")
    text = F.when(~big & good, F.col("content").cast("string"))
    own = own.withColumn("text", text)
    loc = F.when(F.length("text") > 0, F.size(F.split(F.regexp_replace("text", "\n$", ""), "\n"))).otherwise(0)
    error = F.when(big, f"over {max_kb} KB").when(~good, "not UTF-8").when(loc > max_lines, f"over {max_lines} lines")
    return own.select("path", loc.cast("long").alias("loc"), error.isNull().alias("parsed_ok"), error.alias("parse_error"), F.when(error.isNull(), F.col("text")).alias("content"), F.when(error.isNull(), F.sha2("text", 256)).alias("content_hash")).orderBy("path")


# ---- landing steps, on the driver


def archive_url(url: str, hosts: tuple[str, ...] = ("github.com",)) -> str:
    """The download address of a hosted repository; https and known hosts only."""
    u = urlparse(url.strip())
    parts = [p for p in u.path.removesuffix(".git").split("/") if p]
    if u.scheme != "https":
        raise ValueError("only https")
    if u.hostname not in hosts:
        raise ValueError(f"unknown host {u.hostname}")
    if len(parts) < 2:
        raise ValueError("owner and repository are needed")
    return f"https://codeload.{u.hostname}/{parts[0]}/{parts[1]}/zip/HEAD"


def fetched(url: str, target: str, download: Callable[[str], bytes], limit: int = ARCHIVE_BYTES) -> list[str]:
    data = download(archive_url(url))
    if len(data) > limit:
        raise ValueError(f"the archive is over {limit} bytes")
    return extracted(data, target)


def extracted(data: bytes, target: str, limit: int = INFLATED_BYTES) -> list[str]:
    """Unpack a zip: no entry may leave the target; a single top folder is stripped."""
    root = os.path.realpath(target)
    out, total = [], 0
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = [i for i in z.infolist() if not i.is_dir()]
        tops = {i.filename.split("/")[0] for i in names}
        strip = len(tops) == 1 and all("/" in i.filename for i in names)
        for i in names:
            rel = i.filename.split("/", 1)[1] if strip else i.filename
            to = os.path.realpath(os.path.join(root, rel))
            if not to.startswith(root + os.sep):
                raise ValueError(f"entry leaves the target: {i.filename}")
            os.makedirs(os.path.dirname(to), exist_ok=True)
            with z.open(i) as src, open(to, "wb") as dst:
                while block := src.read(1 << 16):
                    total += len(block)
                    if total > limit:
                        raise ValueError(f"over {limit} bytes unpacked")
                    dst.write(block)
            out.append(rel)
    return sorted(out)


def commit_hash(root: str) -> str | None:
    """The commit of a checkout by its HEAD; None where that cannot be told."""
    try:
        with open(os.path.join(root, ".git", "HEAD"), encoding="utf-8") as f:
            head = f.read().strip()
        if not head.startswith("ref:"):
            return head or None
        with open(os.path.join(root, ".git", *head[4:].strip().split("/")), encoding="utf-8") as f:
            return f.read().strip() or None
    except OSError:
        return None
