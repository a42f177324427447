"""Relative paths, class folders, provenance of names, and addresses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names that some systems reserve, and extensions of images.
RESERVED = "CON PRN AUX NUL COM1 COM2 COM3 COM4 COM5 COM6 COM7 COM8 COM9 LPT1 LPT2 LPT3 LPT4 LPT5 LPT6 LPT7 LPT8 LPT9".split()
EXTENSIONS = {"jpg": "JPEG", "jpeg": "JPEG", "png": "PNG", "webp": "WEBP"}


def portable(path: Column) -> Column:
    """The path with slashes only."""
    return F.replace(path, F.lit("\\"), F.lit("/"))


def _parts_fail(path: Column, bad) -> Column:
    return F.exists(F.split(path, "/"), bad)


def safe_path(path: Column) -> Column:
    """The portable form of a relative path that is safe on all systems, else null.

    Not safe: empty or absolute paths; parts that are empty, ``.`` or ``..``, end in a blank or dot, hold control
    characters or one of ``:*?"<>|``, or are reserved names before their first dot.
    """

    def bad(part: Column) -> Column:
        name = F.upper(F.substring_index(part, ".", 1))
        return (part == "") | part.isin(".", "..") | part.rlike(r"[ .]\z") | part.rlike(r'[\x00-\x1f:*?"<>|]') | name.isin(RESERVED)

    p = portable(path)
    wrong = (path == "") | p.startswith("/") | _parts_fail(p, bad)
    return F.when(path.isNotNull() & ~wrong, p)


def inner_path(path: Column) -> Column:
    """The portable form of a path without a colon and without empty, ``.`` or ``..`` parts, else null."""
    p = portable(path)
    return F.when(path.isNotNull() & ~p.contains(":") & ~_parts_fail(p, lambda x: x.isin("", ".", "..")), p)


def archive_path(path: Column) -> Column:
    """A path that an archive may hold, else null: no backslash, no colon, no empty, ``.`` or ``..`` part."""
    return F.when(path.isNotNull() & ~path.contains("\\") & ~path.contains(":") & ~_parts_fail(path, lambda x: x.isin("", ".", "..")), path)


def class_folder(path: Column) -> Column:
    """The class that the first folder of a path proposes: lower case, blanks and underscores as hyphens."""
    return F.translate(F.lower(F.split(portable(path), "/")[0]), " _", "--")


def provenance(path: Column, prefixes: list[str], classes: Column, with_parents: list[str]) -> Column:
    """``id, parent_key``: the source that a file's former path tells of.

    The first of ``prefixes`` that the file name begins with (and an underscore) names the source; the folder
    ``uploads`` overrides it, and so does ``original`` for a class folder within one of the same name that holds
    IMG_ and digits. Otherwise the source is unknown. ``parent_key`` is the file name before ``.rf.``, for the
    sources ``with_parents``.
    """
    parts = F.split(portable(path), "/")
    name = F.element_at(parts, -1)
    by_prefix = F.lit("unknown")
    for p in reversed(prefixes):
        by_prefix = F.when(name.startswith(f"{p}_"), p).otherwise(by_prefix)
    original = (F.size(parts) == 3) & (parts[0] == parts[1]) & F.array_contains(classes, class_folder(path)) & name.rlike(r"^IMG_\d+\.[A-Za-z]+\z")
    source = F.when(parts[0] == "uploads", "uploads").when(original, "original").otherwise(by_prefix)
    parent = F.when(source.isin(with_parents) & name.contains(".rf."), F.substring_index(name, ".rf.", 1))
    return F.when(path.isNotNull(), F.struct(source.alias("id"), parent.alias("parent_key")))


def extension_format(path: Column) -> Column:
    """The image format that an extension names, else null."""
    ext = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    found = F.lit(None).cast("string")
    for e, f in EXTENSIONS.items():
        found = F.when(ext == e, f).otherwise(found)
    return found


def magic_format(content: Column) -> Column:
    """The image format that the first bytes of a file tell, else null."""
    head = F.hex(F.substring(content, 1, 12))
    webp = head.startswith("52494646") & (F.substring(head, 17, 8) == "57454250")
    return F.when(head.startswith("FFD8FF"), "JPEG").when(head.startswith("89504E470D0A1A0A"), "PNG").when(webp, "WEBP")


def quoted_path(path: Column) -> Column:
    """A path for a URL: percent-encoded as UTF-8 but for its slashes and ``-._~``."""
    enc = F.url_encode(path)
    for a, b in (("+", "%20"), ("%2F", "/"), ("%7E", "~"), ("*", "%2A")):
        enc = F.replace(enc, F.lit(a), F.lit(b))
    return enc


def identifier(c: Column) -> Column:
    return F.coalesce(c.rlike(r"^[A-Za-z0-9][A-Za-z0-9._-]{0,127}\z"), F.lit(False))
