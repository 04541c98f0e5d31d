"""Which files of a tree count, and which of those may be read: rules as column expressions over a listing."""

from __future__ import annotations

import fnmatch
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.operators.ingest import below

#: Names of directories and files that are skipped unless told otherwise.
DIRECTORIES = (".git", ".hg", ".svn", "node_modules", "__pycache__", ".venv", "venv", ".mypy_cache", ".pytest_cache", ".cache", ".gradle", "AppData", "$RECYCLE.BIN", "System Volume Information")
FILES = ("*.tmp", "*.bak", "~$*", "Thumbs.db", "desktop.ini")
#: Attribute bits of a file whose content is elsewhere, and bytes of a megabyte in download limits.
OFFLINE, RECALL_ON_OPEN, RECALL_ON_ACCESS, MEGABYTE = 0x1000, 0x40000, 0x400000, 1_000_000


def any_of(tests: list[Column]) -> Column:
    return reduce(Column.__or__, tests, F.lit(False))


@dataclass(frozen=True)
class Ignore:
    """Directories by name, in any case, and files by glob."""

    directories: tuple[str, ...] = DIRECTORIES
    files: tuple[str, ...] = FILES

    def more(self, directories: tuple[str, ...] = (), files: tuple[str, ...] = ()) -> Ignore:
        return Ignore((*self.directories, *directories), (*self.files, *files))

    def column(self, path: str = "path", root: str = "") -> Column:
        """Whether the path is skipped: by a directory between the root and the file, or by the file's name."""
        inner = F.substring(F.col(path), len(root.rstrip("/")) + 1, 1 << 30) if root else F.col(path)
        parts = F.split(inner, "/")
        folders, name = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), F.element_at(parts, -1)
        by_folder = F.arrays_overlap(F.transform(folders, F.lower), F.array(*(F.lit(d.lower()) for d in self.directories)).cast("array<string>"))
        return by_folder | any_of([name.rlike(fnmatch.translate(p)) for p in self.files])


def availability(attributes: Column) -> Column:
    """available, or cloud_only where an attribute bit says that reading would download the file; null attributes: available."""
    return F.when(F.coalesce(attributes, F.lit(0)).bitwiseAND(F.lit(OFFLINE | RECALL_ON_OPEN | RECALL_ON_ACCESS)) != 0, "cloud_only").otherwise("available")


def readable(state: Column, size: Column, most_megabytes: float = 0) -> Column:
    """Whether content may be read: what is available always, cloud-only files up to a limit that is set, others never."""
    small = F.lit(most_megabytes > 0) & (size <= F.lit(most_megabytes * MEGABYTE))
    return F.coalesce((state == "available") | ((state == "cloud_only") & small), F.lit(False))


def allowed(path: Column, roots: tuple[str, ...]) -> Column:
    """Whether a path is a configured root or lies below one."""
    return any_of([below(path, F.lit(r)) for r in roots])


def reachable(spark: SparkSession, roots: tuple[str, ...], every: bool) -> bool:
    """Whether the mounted roots are there: any of them for network sources, every one for removable sources. No roots: not there."""
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs

    def there(root: str) -> bool:
        path = fs.Path(root)
        try:
            return bool(path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path))
        except Exception:  # a store that can't be asked is not reachable
            return False

    found = [there(r) for r in roots]
    return bool(found) and (all(found) if every else any(found))


def tagged(listing: DataFrame, ignore: Ignore, roots: tuple[str, ...], root: str = "") -> DataFrame:
    """listing with kind: error where a path is outside the roots or has no size or time, ignored by the rules, else file."""
    broken = ~allowed(F.col("path"), roots) | F.col("size").isNull() | F.col("modified_at").isNull()
    return listing.withColumn("kind", F.when(F.coalesce(broken, F.lit(True)), "error").when(ignore.column("path", root), "ignored").otherwise("file"))


def split(rows: DataFrame, most_errors: int = 100) -> tuple[DataFrame, DataFrame]:
    """The files of a tagged listing, and a report of its first errors by path."""
    return rows.where("kind = 'file'").drop("kind"), rows.where("kind = 'error'").orderBy("path").limit(most_errors).drop("kind")
