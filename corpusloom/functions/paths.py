"""Path expressions: everything here is a Column to Column function that stays inside the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def parts(path: Column) -> Column:
    """The names of a path, without empty ones."""
    return F.filter(F.split(path, "/"), lambda x: x != "")


def normalize(path: Column) -> Column:
    """Without '.', '..', doubled and trailing slashes; '..' above the root is dropped, above a relative start it stays."""
    root = path.startswith("/")
    keep = F.filter(parts(path), lambda x: x != ".")

    def step(done: Column, x: Column) -> Column:
        up = (x == "..") & (F.size(done) > 0) & (F.coalesce(F.try_element_at(done, F.lit(-1)), F.lit("")) != "..")
        lost = (x == "..") & (F.size(done) == 0) & root
        return F.when(up, F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).when(lost, done).otherwise(F.concat(done, F.array(x)))

    names = F.aggregate(keep, F.array().cast("array<string>"), step)
    joined = F.concat_ws("/", names)
    return F.when(root, F.concat(F.lit("/"), joined)).when(joined == "", F.lit(".")).otherwise(joined)


def basename(path: Column) -> Column:
    return F.coalesce(F.try_element_at(parts(path), F.lit(-1)), F.lit(""))


def dirname(path: Column) -> Column:
    """The parent of a normalized path; that of a top entry is '/'."""
    return F.when(F.regexp_extract(path, "^(.*)/[^/]+$", 1) == "", F.lit("/")).otherwise(F.regexp_extract(path, "^(.*)/[^/]+$", 1))


def above(path: Column) -> Column:
    """The last of the ancestors of an absolute path; null if it has none."""
    plain = path.startswith("/") & ~path.contains("//") & ~path.endswith("/")
    p = parts(path)
    long = F.when(F.size(p) > 1, F.concat(F.lit("/"), F.concat_ws("/", F.slice(p, F.lit(1), F.greatest(F.size(p) - 1, F.lit(0))))))
    return F.when(plain, F.nullif(F.regexp_extract(path, "(?s)^(.*)/", 1), F.lit(""))).otherwise(long)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(basename(path), r"[^.]\.([^.]+)$", 1))


def depth(path: Column) -> Column:
    return F.size(parts(path))


def ancestors(path: Column, proper: bool = True) -> Column:
    """All directories above an absolute path, from the top; with the path itself if not proper. The root is left out."""
    p = parts(path)
    n = F.size(p) - (1 if proper else 0)
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.concat(F.lit("/"), F.concat_ws("/", F.slice(p, F.lit(1), i))))).otherwise(F.array().cast("array<string>"))


def relative(path: Column, root: Column) -> Column:
    """path below root, or null if it isn't below it; the boundary is a slash."""
    base = F.when(root == "/", F.lit("")).otherwise(root)
    return F.when(path.startswith(F.concat(base, F.lit("/"))), F.substr(path, F.length(base) + 2))


def is_glob(path: Column) -> Column:
    """Has a meta character and is well formed (no class is left open); anything else is a literal path."""
    bare = F.regexp_replace(F.regexp_replace(path, r"\\.", ""), r"\[[!^]?\]?[^\]]*\]", "")
    # most paths have none of these, and a search for fixed text is much cheaper than a regular expression
    meta = reduce(Column.__or__, (path.contains(c) for c in ("*", "?", "[", "{", "@(", "+(", "!(")))
    return meta & (~path.contains("[") | ~bare.contains("["))


def literal_prefix(pattern: Column) -> Column:
    """The directory below which everything lies that a glob can match; the pattern itself if it has no meta character."""
    return F.when(is_glob(pattern), F.regexp_extract(pattern, r"^((?:[^*?\[{@+!]|[@+!](?!\())*)/", 1)).otherwise(pattern)


def hex64(x: Column) -> Column:
    return F.lower(F.lpad(F.hex(x), 16, "0"))


def octal_mode(mode: Column) -> Column:
    return F.lpad(F.conv(mode.bitwiseAND(F.lit(0o7777)).cast("string"), 10, 8), 4, "0")


def permissions(kind: Column, mode: Column) -> Column:
    """As ls shows them: type, three times rwx, with s, S, t, T for the special bits."""
    bit = lambda m: mode.bitwiseAND(F.lit(m)) != 0

    def execute(x: int, special: int, letter: str) -> Column:
        return F.when(bit(special), F.when(bit(x), F.lit(letter)).otherwise(F.lit(letter.upper()))).otherwise(F.when(bit(x), F.lit("x")).otherwise(F.lit("-")))

    flag = lambda m, c: F.when(bit(m), F.lit(c)).otherwise(F.lit("-"))
    first = F.when(kind == "directory", F.lit("d")).when(kind == "symlink", F.lit("l")).otherwise(F.lit("-"))
    return F.concat(first, flag(0o400, "r"), flag(0o200, "w"), execute(0o100, 0o4000, "s"), flag(0o040, "r"), flag(0o020, "w"), execute(0o010, 0o2000, "s"), flag(0o004, "r"), flag(0o002, "w"), execute(0o001, 0o1000, "t"))


def file_uri(path: Column) -> Column:
    e = F.url_encode(path)
    for a, b in (("+", "%20"), ("%2F", "/"), ("*", "%2A"), ("%7E", "~")):
        e = F.replace(e, F.lit(a), F.lit(b))
    return F.concat(F.lit("file://"), e)


def iso_utc(ns: Column) -> Column:
    """Nanoseconds since 1970 (long, or decimal beyond the year 2262) as ISO 8601 in UTC, to the second; the session's time zone must
    be UTC. Whole numbers all through: a double no longer tells the seconds of late times apart."""
    second = F.lit(1_000_000_000)
    whole = F.call_function("div", ns, second)
    return F.date_format(F.timestamp_seconds(F.when(ns % second < 0, whole - 1).otherwise(whole)), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def expand(text: Column, env: dict[str, str], strict: bool = True) -> Column:
    """${NAME} replaced from env. Strict: a missing name or an unclosed brace gives null, and ${} stays. Otherwise missing
    names are empty and $(NAME) counts too."""
    pattern = r"\$\{([^}]+)\}" if strict else r"\$\{([^}]+)\}|\$\(([^)]+)\)"
    pieces = F.split(text, pattern)
    names = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    if not strict:
        second = F.regexp_extract_all(text, F.lit(pattern), F.lit(2))
        names = F.zip_with(names, second, lambda a, b: F.when(F.coalesce(a, F.lit("")) != "", a).otherwise(b))
    table = F.create_map(*(F.lit(x) for kv in (env or {"": ""}).items() for x in kv))
    values = F.transform(names, lambda k: F.try_element_at(table, k))
    if not strict:
        values = F.transform(values, lambda v: F.coalesce(v, F.lit("")))
    out = F.aggregate(F.zip_with(pieces, values, lambda p, v: F.struct(p.alias("p"), v.alias("v"))), F.lit(""), lambda a, x: F.concat(a, F.coalesce(x["p"], F.lit("")), F.coalesce(x["v"], F.lit(""))))
    plain = ~text.contains("${") if strict else ~(text.contains("${") | text.contains("$("))  # most texts, which cost nothing then
    if not strict:
        return F.when(plain, text).otherwise(out)
    unclosed = F.regexp_replace(text, r"\$\{[^}]*\}", "").contains("${")
    return F.when(plain, text).when(F.exists(values, lambda v: v.isNull()) | unclosed, F.lit(None).cast("string")).otherwise(out)


def local_ns(ns: Column) -> Column:
    """Nanoseconds since 1970 as local time with nine digits of a second, in the session's time zone."""
    second = F.floor(ns / F.lit(1_000_000_000)).cast("long")
    digits = F.lpad((ns - second * 1_000_000_000).cast("string"), 9, "0")
    return F.concat(F.date_format(F.timestamp_seconds(second), "yyyy-MM-dd HH:mm:ss."), digits)


def run_stamp(at: Column) -> Column:
    """A timestamp as the name of a run, to the microsecond."""
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")


def command(arguments: Column) -> Column:
    """The text of a command from its arguments."""
    return F.array_join(arguments, " ")
