"""Path rules as Column expressions. Paths are join keys, so one spelling each."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SUFFIX = ".dvc"


def normalize(path: Column) -> Column:
    """Collapse ``.`` and ``..`` segments; leading ``..`` stay."""
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    none = F.array().cast("array<string>")
    folded = F.aggregate(
        parts,
        none,
        lambda acc, p: F.when(
            (p == "..") & (F.size(acc) > 0) & (F.coalesce(F.get(acc, F.size(acc) - 1), F.lit("")) != ".."),
            F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))),
        ).otherwise(F.concat(acc, F.array(p))),
    )
    joined = F.array_join(folded, "/")
    return F.when(path.startswith("/"), F.concat(F.lit("/"), joined)).when(joined == "", F.lit(".")).otherwise(joined)


def _at_root(folder: Column) -> Column:
    return (folder == ".") | (folder == "") | folder.startswith("/")


def resolve(folder: Column, dep: Column) -> Column:
    """A recorded dependency as a path from the repository root."""
    return (
        F.when(_at_root(folder), dep)
        .when(dep.startswith("/"), F.substring(dep, 2, 1 << 30))
        .when(dep.startswith(F.concat(folder, F.lit("/"))), dep)
        .otherwise(normalize(F.concat(folder, F.lit("/"), dep)))
    )


def relativize(folder: Column, dep: Column) -> Column:
    """The inverse: inside the folder relative to it, outside from the root with a slash."""
    inside = F.concat(folder, F.lit("/"))
    return (
        F.when(_at_root(folder), dep)
        .when(dep.startswith(inside), F.substring(dep, F.length(inside) + 1, F.lit(1 << 30)))
        .otherwise(F.concat(F.lit("/"), dep))
    )


def metadata_path(path: Column) -> Column:
    return F.when(path.endswith(SUFFIX), path).otherwise(F.concat(path, F.lit(SUFFIX)))


def output_path(path: Column) -> Column:
    return F.regexp_replace(path, r"\.dvc$", "")


def parent(path: Column) -> Column:
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit("."))


def ancestors(path: Column) -> Column:
    """Proper ancestor folders of a relative path, nearest last."""
    parts = F.split(path, "/")
    count = F.size(parts) - 1
    return F.when(
        count > 0,
        F.transform(F.sequence(F.lit(1), count), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/")),
    ).otherwise(F.array().cast("array<string>"))


def blob_path(root: str, md5: Column, is_dir: Column | None = None) -> Column:
    tail = F.substring(md5, 3, 1 << 30)
    suffix = F.lit("") if is_dir is None else F.when(is_dir, F.lit(".dir")).otherwise(F.lit(""))
    return F.concat(F.lit(f"{root}/files/md5/"), F.substring(md5, 1, 2), F.lit("/"), tail, suffix)


def default_out(url: Column) -> Column:
    """File name from a URL's path, percent-decoded; null where the path names none."""
    name = F.element_at(F.split(F.parse_url(url, F.lit("PATH")), "/"), -1)
    return F.when(name != "", F.url_decode(name))
