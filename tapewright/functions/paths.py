"""Parts of file paths, and the name that derived files have in common. ``/`` separates, as on the catalogs' systems."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapewright.functions.bind import bind

# Texts for parts that do not exist, and marks of copies.
NO_NAME, NO_STEM, NO_EXTENSION, NO_PARENT = "Invalid Filename", "Invalid Filestem", "Invalid Extension", "Invalid Path"
COPIES = (" copy.", " Copy.", " COPY.", ".copy.", ".Copy.", ".COPY.")
ENDINGS = r"\A([^\n]+?)(?:\.(?:\p{Nd}+|M))*\z"


def trimmed_name(c: Column) -> Column:
    """Without white space (as Unicode defines it) at both ends."""
    space = r"[\t-\r\x{85}\p{Z}]"
    at_end = F.substring(c, 1, 1).rlike(space) | F.substring(c, -1, 1).rlike(space)  # most names have none: no search through the text
    return F.when(at_end, F.regexp_replace(c, rf"\A{space}+|{space}+\z", "")).otherwise(c)


def _cut(path: Column) -> Column:
    """Without closing slashes."""
    return F.when(path.endswith("/") | path.endswith("/."), F.regexp_replace(path, r"(?:/+\.?)+\z", "")).otherwise(path)


def _name(cut: Column) -> Column:
    """Last component of a path without closing slashes; null where it has none."""
    return F.nullif(F.nullif(F.nullif(F.substring_index(cut, "/", -1), F.lit("")), F.lit(".")), F.lit(".."))


def _after_dot(name: Column) -> Column:
    """What follows the last dot, if something stands before that dot; else null."""
    last = F.substring_index(name, ".", -1)
    return F.when(F.length(last) < F.length(name) - 1, last)


def parent(path: Column) -> Column:
    """The path without its last component; a bare name has the empty parent, the root and the empty path none."""
    cut = _cut(path)
    up = F.substring(cut, F.lit(1), F.length(cut) - F.length(F.substring_index(cut, "/", -1)))
    bare = F.rtrim(up, F.lit("/"))
    return F.when((cut == "") | path.isNull(), F.lit(NO_PARENT)).when((bare == "") & (up != ""), F.lit("/")).otherwise(bare)


def contains_any(text: Column, parts: tuple[str, ...]) -> Column:
    """Some part occurs, in the same case. False for null."""
    out = F.lit(False)
    for p in dict.fromkeys(parts):
        out = out | text.contains(p)
    return F.coalesce(out, F.lit(False))


def _before_first(text: Column, parts: tuple[str, ...]) -> Column:
    """Text before the first occurrence of the first of ``parts``, in their order, that occurs."""
    out = text
    for p in reversed(list(dict.fromkeys(parts))):
        out = F.when(text.contains(p), F.substring_index(text, p, 1)).otherwise(out)
    return out


def with_names(df: DataFrame, path: str, tags: tuple[str, ...] = (), ignore_filetype: bool = False) -> DataFrame:
    """Adds file_name, stem, ext and root for the path column.

    root is the name that a file shares with those derived from it: the trimmed stem up to a tag, up to a mark of a copy,
    and without counters at its end; then the extension, unless file types are ignored.
    """
    own = df.columns
    d = bind(df, _nm=_name(_cut(F.col(path))))
    name = F.col("_nm")
    d = bind(d, _x=_after_dot(name))
    stem = F.when(F.col("_x").isNull(), name).otherwise(F.substring(name, F.lit(1), F.length(name) - F.length("_x") - 1))
    d = bind(d, file_name=F.coalesce(name, F.lit(NO_NAME)), stem=F.coalesce(stem, F.lit(NO_STEM)), ext=F.coalesce("_x", F.lit(NO_EXTENSION)))
    d = bind(d, _t=trimmed_name(F.col("stem")))
    d = bind(d, _u=_before_first(F.col("_t"), tags))
    d = bind(d, _v=_before_first(F.col("_u"), COPIES))
    d = bind(d, _b=F.regexp_extract(F.col("_v"), ENDINGS, 1))
    base = F.when(F.col("_b") != "", F.col("_b")).otherwise(F.col("_v"))
    d = bind(d, root=base if ignore_filetype else F.concat(base, F.lit("."), F.col("ext")))
    return d.select(*own, "file_name", "stem", "ext", "root")
