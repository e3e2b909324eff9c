"""Sizes, digests and path patterns as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

UNITS = "bkmgtpe"


def parse_size(text: Column) -> Column:
    """Bytes of "128K" and the like; null where anything else stands in the text, and where the bytes don't fit into 64 bits."""
    form = r"^([0-9]+)([bkmgtpeBKMGTPE]?)$"
    number, unit = F.regexp_extract(text, form, 1), F.lower(F.regexp_extract(text, form, 2))
    factor = F.lit(1).cast("long")
    for i, u in enumerate(UNITS):
        factor = F.when(unit == u, F.lit(1 << (10 * i)).cast("long")).otherwise(factor)
    return F.when(number != "", F.try_multiply(number.try_cast("long"), factor))


def pretty_size(size: Column) -> Column:
    """A plain number under 1024, else with one decimal (halves to even) and a unit; all but the last division are whole."""
    out = None
    names = ["KB", "MB", "GB", "TB", "PB", "EB"]
    for i in reversed(range(len(names))):
        part = F.format_string(f"%.1f{names[i]}", F.bround(F.shiftright(size.cast("long"), 10 * i).cast("double") / 1024.0, 1))
        bound = size >= (1 << (10 * (i + 1)))
        out = F.when(bound, part) if out is None else out.when(bound, part)
    return out.otherwise(size.cast("string"))


# The named classes of a bracket expression, over ASCII.
NAMED = {"alpha": "a-zA-Z", "digit": "0-9", "alnum": "a-zA-Z0-9", "upper": "A-Z", "lower": "a-z", "space": r"\x09-\x0D\x20", "blank": r"\x09\x20", "punct": r"\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E", "xdigit": "0-9A-Fa-f", "cntrl": r"\x00-\x1F\x7F", "print": r"\x20-\x7E", "graph": r"\x21-\x7E"}


def _literal(c: str) -> str:
    """A character as a regular expression, inside brackets and outside."""
    return c if c.isascii() and c.isalnum() or not c.isascii() else f"\\x{ord(c):02X}"


def _bracket(glob: str, i: int) -> tuple[str, int] | None:
    """The class that begins at glob[i] == "[" and the place behind it; None if it never ends, so that the bracket stands for itself."""
    j = i + 1
    negated = glob[j : j + 1] in ("!", "^")
    j += negated
    body, first = "", True
    while j < len(glob):
        if glob[j] == "]" and not first:
            return f"[{'^' if negated else ''}{body}]" if body else ("." if negated else "(?!)"), j + 1
        first = False
        named = re.match(r"\[:([a-z]+):\]", glob[j:])
        if named and named[1] in NAMED:
            body += NAMED[named[1]]
            j += named.end()
            continue

        def one(at: int) -> tuple[str, int]:
            at += glob[at] == "\\" and at + 1 < len(glob)
            return glob[at], at + 1

        lo, j = one(j)
        if glob[j : j + 1] == "-" and j + 1 < len(glob) and glob[j + 1] != "]":
            hi, j = one(j + 1)
            body += f"{_literal(lo)}-{_literal(hi)}" if lo <= hi else ""
        else:
            body += _literal(lo)
    return None


def glob_pattern(glob: str) -> str:
    """The regular expression of a shell pattern whose `*` also matches `/`; a backslash takes the next character as it is."""
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        bracket = _bracket(glob, i) if c == "[" else None
        if bracket:
            out += bracket[0]
            i = bracket[1]
            continue
        if c == "\\" and i + 1 < len(glob):
            i += 1
            out += _literal(glob[i])
        else:
            out += {"*": ".*", "?": "."}.get(c) or _literal(c)
        i += 1
    return f"(?s)^{out}$"


def quoted(path: str) -> str:
    """A pattern that matches just this path."""
    return re.sub(r"([\\*?\[])", r"\\\1", path)


def excluded(path: Column, globs: list[str], cwd: str = "/", state: str | None = None) -> Column:
    """Whether any pattern matches the path; relative patterns are taken from cwd. The file that holds the state, and the two next to it, are always left out."""
    out = F.lit(False)
    own = [quoted(state) + tail for tail in ("", "-wal", "-shm")] if state else []
    for g in [*globs, *own]:
        out = out | path.rlike(glob_pattern(g if g.startswith("/") else cwd.rstrip("/") + "/" + g))
    return out


def is_zero(data: Column) -> Column:
    """Whether a binary block is not empty and all zeros; null is not zero."""
    return F.coalesce((F.length(data) > 0) & (F.regexp_replace(F.hex(data), "0", "") == ""), F.lit(False))


def short_id(digest: Column) -> Column:
    return F.substring(F.lower(digest), 1, 8)


def first_device(source: Column) -> Column:
    return F.substring_index(source, ":", 1)


def rounded_down(length: Column, blocksize: int) -> Column:
    """A length down to whole filesystem blocks, if it is longer than one."""
    return F.when(length > blocksize, length - length % blocksize).otherwise(length)


def num_digits(number: Column) -> Column:
    """Decimal digits of a whole number; 0 has none."""
    return F.when(number == 0, 0).otherwise(F.length(F.abs(number).cast("string")))


def ignored(flags: Column, mask: int) -> Column:
    """Whether any bit of the mask is set; unknown flags are not ignored."""
    return F.coalesce(flags.bitwiseAND(mask) != 0, F.lit(False))


def uuid_text(data: Column) -> Column:
    """The usual 36 characters of 16 bytes; null for any other number of bytes."""
    h = F.lower(F.hex(data))
    return F.when(F.length(data) == 16, F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]))


def uuid_bytes(text: Column) -> Column:
    """16 bytes of a UUID of either case; null if it is none."""
    return F.when(text.rlike(r"^[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}$"), F.unhex(F.replace(text, F.lit("-"), F.lit(""))))


def is_null_uuid(data: Column) -> Column:
    """Whether a UUID is missing or all zeros."""
    return data.isNull() | is_zero(data)


#: The file systems that can share extents.
SHARING = ("btrfs", "xfs")


def shares_extents(fs_type: Column) -> Column:
    """Whether a file system is known to share extents; others are worth a warning, no more."""
    return F.coalesce(fs_type.isin(*SHARING), F.lit(False))


def block_number(loff: Column, blocksize: int) -> Column:
    """Logical number of the block at an offset."""
    return F.floor(loff / F.lit(blocksize)).cast("long") if blocksize & (blocksize - 1) else F.shiftright(loff, blocksize.bit_length() - 1)


def parse_options(text: str, known: dict[str, bool]) -> dict[str, bool]:
    """Comma-separated switches over their defaults; a `no` before a name turns it off, an unknown name is an error."""
    chosen = dict(known)
    for word in filter(None, text.split(",")):
        on = word in known
        name = word if on else word.removeprefix("no")
        if name not in known:
            raise ValueError(f"unknown option {word}")
        chosen[name] = on
    return chosen
