"""Scalar functions on names, paths, urls and texts, all built from JVM-side expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNSAFE = r"[\x00-\x1f\"#$%&*+,:;<=>?\[\]^`{|}\x7f]"


def clean_url(c: Column) -> Column:
    """Up to the first ? or #."""
    return F.regexp_extract(c, r"^([^?#]*)", 1)


def get_query(c: Column) -> Column:
    """Between the first ? and the next #."""
    return F.regexp_extract(c, r"^[^?]*\?([^#]*)", 1)


def query_value(c: Column, key: str) -> Column:
    """The last value of a key of the query, null if it isn't there."""
    pairs = F.filter(F.split(get_query(c), "&"), lambda p: F.substring_index(p, "=", 1) == key)
    last = F.try_element_at(pairs, F.lit(-1))
    return F.when(F.contains(last, F.lit("=")), F.substring(last, len(key) + 2, 1 << 30)).otherwise(F.when(last.isNotNull(), F.lit("")))


def stabilize_id(c: Column, cwd: str) -> Column:
    """Relative to ``cwd`` if below it; a leading NUL is written out."""
    return F.when(c.startswith("\0"), F.concat(F.lit("\\0"), F.substring(c, 2, 1 << 30))).when(c.startswith(cwd + "/"), F.substring(c, len(cwd) + 2, 1 << 30)).otherwise(c)


def dirname(c: Column) -> Column:
    return F.regexp_replace(c, r"/[^/]*$", "")


def basename(c: Column) -> Column:
    return F.substring_index(c, "/", -1)


def extension(c: Column) -> Column:
    return F.regexp_extract(basename(c), r"\.([^.]*)$", 1)


def suffixes(c: Column) -> Column:
    """What follows each dot of the whole id, the longest first."""
    parts = F.split(c, r"\.")
    return F.transform(F.sequence(F.lit(2), F.greatest(F.size(parts), F.lit(2))), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


def loader_of(c: Column, loaders: dict[str, str], default: str = "js") -> Column:
    """The loader of the longest suffix that has one."""
    table = F.create_map(*[F.lit(x) for kv in loaders.items() for x in kv])
    return F.coalesce(F.try_element_at(F.filter(F.transform(suffixes(c), lambda s: F.try_element_at(table, s)), lambda v: v.isNotNull()), F.lit(1)), F.lit(default))


def relative_path(c: Column, base: Column) -> Column:
    """From directory ``base`` to ``c``, both absolute."""
    a, b = F.split(base, "/"), F.split(c, "/")
    same = F.size(F.filter(F.sequence(F.lit(1), F.least(F.size(a), F.size(b))), lambda i: F.slice(a, 1, i) == F.slice(b, 1, i)))
    return F.array_join(F.concat(F.array_repeat(F.lit(".."), F.size(a) - same), F.slice(b, same + 1, F.size(b))), "/")


def sanitize_file_name(c: Column) -> Column:
    """Unsafe characters become _, but not the colon of a leading drive letter."""
    drive = F.regexp_extract(c, r"^([A-Za-z]:)", 1)
    return F.concat(drive, F.regexp_replace(F.substr(c, F.length(drive) + 1), UNSAFE, "_"))


def identifier(c: Column) -> Column:
    """A valid name: other characters become _, and a leading digit gets one before it."""
    name = F.regexp_replace(c, r"[^A-Za-z0-9_$]", "_")
    return F.when(name == "", "_").when(name.rlike(r"^[0-9]"), F.concat(F.lit("_"), name)).otherwise(name)


def is_identifier(c: Column) -> Column:
    return c.rlike(r"^[A-Za-z_$][A-Za-z0-9_$]*$")


def property_access(c: Column) -> Column:
    return F.when(is_identifier(c), F.concat(F.lit("."), c)).otherwise(F.concat(F.lit('["'), c, F.lit('"]')))


def is_path_like(c: Column) -> Column:
    return c.rlike(r"^(\.{1,2}(/|$)|/)")


def base64_url(c: Column) -> Column:
    return F.regexp_replace(F.translate(F.base64(c.cast("binary")), "+/\r\n", "-_"), "=+$", "")


def percent_encode(c: Column) -> Column:
    """Every byte but letters, digits and -_.~ as %XX."""
    return F.replace(F.replace(F.replace(F.url_encode(c), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def data_url(c: Column, mime: str) -> Column:
    """The shorter of both writings; percent only if strictly shorter."""
    p, b = F.concat(F.lit(f"data:{mime},"), percent_encode(c)), F.concat(F.lit(f"data:{mime};base64,"), F.translate(F.base64(c.cast("binary")), "\r\n", ""))
    return F.when(F.length(p) < F.length(b), p).otherwise(b)


def parse_data_url(c: Column) -> dict[str, Column]:
    """mime, is_base64, payload; null unless it is a data url."""
    shape = r"^data:([^,;]*)((?:;[^,;]*)*?)(;base64)?,(?s:(.*))$"
    ok = c.rlike(shape)
    raw = F.regexp_extract(c, shape, 4)
    b64 = F.regexp_extract(c, shape, 3) != ""
    text = F.when(b64, F.try_to_binary(raw, F.lit("base64")).cast("string")).otherwise(F.try_url_decode(F.replace(raw, F.lit("+"), F.lit("%2B"))))
    return {"mime": F.when(ok, F.regexp_extract(c, shape, 1)), "is_base64": F.when(ok, b64), "payload": F.when(ok, text)}


def format_size(c: Column) -> Column:
    """B, kB and MB at 1024, one decimal; halves go to the even digit, as in C and Rust (Java's formats round them up)."""
    c = c.cast("long")

    def scaled(unit: int) -> Column:
        whole, rest = F.floor(c / unit), c % unit * 10
        low, twice = F.floor(rest / unit), rest % unit * 2
        tenths = whole * 10 + low + F.when((twice > unit) | ((twice == unit) & (low % 2 == 1)), 1).otherwise(0)
        return F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"))

    return F.when(c < 1024, F.concat(c.cast("string"), F.lit(" B"))).when(c < 1024 * 1024, F.concat(scaled(1024), F.lit(" kB"))).otherwise(F.concat(scaled(1024 * 1024), F.lit(" MB")))


def display_size(c: Column) -> Column:
    """kB at 1000 with two truncated decimals and grouped thousands."""
    return F.concat(F.format_number(F.floor(c / 1000), 0), F.lit("."), F.lpad(F.floor(c % 1000 / 10).cast("string"), 2, "0"), F.lit(" kB"))


def level(c: Column) -> Column:
    return F.when(c > 50, "HIGH").when(c >= 30, "MEDIUM").otherwise("LOW")


def strip_bom(c: Column) -> Column:
    return F.regexp_replace(c, "^﻿", "")


def string_literal(c: Column) -> Column:
    """Double-quoted, with backslashes, quotes and line ends escaped."""
    out = c
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.concat(F.lit('"'), out, F.lit('"'))


def glob_regex(glob: str, cwd: str | None = None) -> str:
    """A full-match regular expression; a relative glob without a leading ** is taken below ``cwd``."""
    if cwd and not glob.startswith(("/", "**")):
        glob = f"{cwd}/{glob}"
    out, i = "^", 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        elif c == "*":
            out, i = out + "[^/]*", i + 1
        elif c == "?":
            out, i = out + "[^/]", i + 1
        elif c == "{" and "}" in glob[i:]:
            end = glob.index("}", i)
            out, i = out + "(?:" + "|".join(glob_regex(x)[1:-1] for x in glob[i + 1 : end].split(",")) + ")", end + 1
        else:
            out, i = out + ("\\" + c if c in r"\.+^$()|[]{}" else c), i + 1
    return out + "$"


def minified_name(n: Column) -> Column:
    """A letter of 54 first, then digits of base 64, the least first."""
    first, rest = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ$_", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ$_0123456789"
    at = lambda s, k: F.substr(F.lit(s), (k + 1).cast("int"), F.lit(1))
    q = F.floor(n / 54)
    out = at(first, n % 54)
    for _ in range(4):
        out = F.concat(out, F.when(q > 0, at(rest, (q - 1) % 64)).otherwise(""))
        q = F.when(q > 0, F.floor((q - 1) / 64)).otherwise(0)
    return out


def common_directory(paths: Column) -> Column:
    """The deepest directory above all paths of an array: what the smallest and the largest share."""
    a, b = F.split(F.array_min(paths), "/"), F.split(F.array_max(paths), "/")
    n = F.size(F.filter(F.sequence(F.lit(1), F.least(F.size(a), F.size(b)) - 1), lambda i: F.slice(a, 1, i) == F.slice(b, 1, i)))
    return F.array_join(F.slice(a, 1, n), "/")
