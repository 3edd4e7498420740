"""Search in lines with context, and ordered text edits."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import paths as P
from corpusloom.operators import access, select
from corpusloom.sources.corpus import written


def lines(files: DataFrame) -> DataFrame:
    """(path, line, text): lines from 1, without a trailing carriage return; a last empty line does not count."""
    each = F.split("text", "\n")
    each = F.when(F.try_element_at(each, F.lit(-1)) == "", F.slice(each, F.lit(1), F.greatest(F.size(each) - 1, F.lit(0)))).otherwise(each)
    return files.select("path", F.posexplode(each).alias("line", "text")).select("path", (F.col("line") + 1).cast("long").alias("line"), F.regexp_replace("text", "\r$", "").alias("text"))


def matcher(text: Column, pattern: str, regex: bool = True, ignore_case: bool = False) -> Column:
    if regex:
        return text.rlike(("(?i)" if ignore_case else "") + pattern)
    return F.lower(text).contains(pattern.lower()) if ignore_case else text.contains(pattern)


def is_binary(content: Column) -> Column:
    """A NUL among the first 4096 bytes."""
    return F.decode(F.substring(content, 1, 4096), "ISO-8859-1").contains("\x00")


#: Patterns for which a line that matches need not make its text match: ends of the input, what looks around, and repetitions that
#: give nothing back, so that they may run beyond a line's end.
LINE_ONLY = re.compile(r"\\[AzZG]|\(\?|[*+?}]\+")


def grep(files: DataFrame, pattern: str, regex: bool = True, ignore_case: bool = False, context: int = 0, binary: bool = False) -> DataFrame:
    """(path, line, text, is_match, separator): matching lines, those within context of one, and whether a gap comes before.

    Files with a NUL among their first 4096 characters are skipped, unless binary.
    """
    if not binary:
        files = files.filter(~F.substring("text", 1, 4096).contains("\x00"))
    if not regex or not LINE_ONLY.search(pattern):  # texts without a match are left out before they are cut into lines
        files = files.filter(matcher(F.col("text"), "(?m)" + pattern if regex else pattern, regex, ignore_case))
    rows = lines(files).withColumn("is_match", matcher(F.col("text"), pattern, regex, ignore_case))
    by_line = Window.partitionBy("path").orderBy("line")
    if context:
        rows = rows.withColumn("near", F.max("is_match").over(by_line.rowsBetween(-context, context))).filter("near").drop("near")
    else:
        rows = rows.filter("is_match")
    return rows.withColumn("separator", F.coalesce(F.col("line") - F.lag("line").over(by_line) > 1, F.lit(False)))


def selections(directory: str | None, globs: list[str], excludes: list[str] = ()) -> list[dict]:
    """The selections of a search in a directory: its relative globs (none at all: everything below it), and absolute globs as they
    are, wherever the directory is."""
    relative, absolute = [g for g in globs if not g.startswith("/")], [g[1:] for g in globs if g.startswith("/")]
    if relative and directory is None:
        raise ValueError("relative globs need a directory")
    out = []
    if directory is not None and (relative or not globs):
        out.append({"root": directory, "globs": relative or ["**/*"], "excludes": list(excludes)})
    if absolute:
        out.append({"root": "/", "globs": absolute, "excludes": list(excludes)})
    return out


#: Files that a capped search looks at first; how many times as many each time after; and beyond how many it takes all the rest.
FIRST_FILES, GROWTH, ALL_FILES = 256, 8, 1 << 18


def first_matches(files: DataFrame, chosen: DataFrame, pattern: str, most: int, first: int = FIRST_FILES, **options) -> DataFrame:
    """(path, line) of the first `most` matches, by path and line, in those of files (path, text) that are chosen (path: distinct).

    Ranges of paths are searched in order, each larger than the last, until there are enough, so that work falls with the cap.
    """
    found: list[DataFrame] = []
    after, size, left = None, first, most
    while left > 0:
        beyond = chosen if after is None else chosen.filter(F.col("path") > after)
        if size < ALL_FILES:
            last, n = beyond.orderBy("path").limit(size).agg(F.max("path"), F.count(F.lit(1))).first()
        else:
            last, n = None, size
        if not n:
            break
        inside = [F.col("path") > after] * (after is not None) + [F.col("path") <= last] * (last is not None)
        part, names = files, beyond
        for condition in inside:
            part, names = part.filter(condition), names.filter(condition)
        here = grep(part.join(names, "path", "left_semi"), pattern, **options).select("path", "line")
        found.append(written(here.orderBy("path", "line").limit(left)))
        left -= found[-1].count()
        if n < size or last is None:
            break
        after, size = last, size * GROWTH
    return reduce(DataFrame.unionByName, found) if found else chosen.limit(0).withColumn("line", F.lit(0).cast("long"))


def search_files(files: DataFrame, selections: list[dict], pattern: str, most: int, grants: DataFrame | None = None, **options) -> tuple[DataFrame, DataFrame]:
    """Matches of a pattern in the files (path, text) that any selection takes, and one row (files, matches, skipped, truncated).

    A selection: root and, optionally, globs (relative to the root; none takes everything below), regexes and excludes. A file that
    several take counts once. Files outside the grants (path, writable) are skipped and counted. The first `most` matches in the
    order of path and line are returned, with the lines around them.
    """
    chosen = None
    for s in selections:
        part = select.select_files(files, s["root"], s.get("globs", ()), s.get("regexes", ()), s.get("excludes", ())).select("path")
        chosen = part if chosen is None else chosen.union(part)
    chosen = chosen.distinct()
    skipped = F.lit(0).cast("long")
    if grants is not None:
        judged = access.allowed(chosen.withColumn("need_writable", F.lit(False)), grants)
        chosen = judged.filter("allowed").select("path")
        skipped = judged.agg(F.count_if(~F.col("allowed")).alias("skipped"))
    chosen = written(chosen)
    top = first_matches(files, chosen, pattern, most, **{k: v for k, v in options.items() if k != "context"})
    # lines around matches come from the files that these are in, which are `most` at most
    hits = grep(files.join(F.broadcast(top.select("path").distinct()), "path", "left_semi"), pattern, **options)
    context = options.get("context", 0)
    near = top.select("path", F.explode(F.sequence(F.col("line") - context, F.col("line") + context)).alias("line")).distinct()
    own = top.withColumn("__own", F.lit(True))
    kept = hits.join(near, ["path", "line"], "left_semi").join(own, ["path", "line"], "left")
    kept = kept.withColumn("is_match", F.coalesce("__own", F.lit(False))).drop("__own")
    summary = summarize(kept, most)
    if grants is not None:
        summary = summary.drop("skipped").crossJoin(skipped)  # one row each
    return kept, summary


def template_parts(new: str, groups: int) -> list[str | int]:
    r"""A replacement with \1, $1, $&, $$, \n, \t, \r, \\ as texts and group numbers; a group that the pattern lacks raises."""
    out, i = [], 0
    while i < len(new):
        two = new[i : i + 2]
        if re.fullmatch(r"[\\$]\d", two):
            if int(two[1]) > groups:
                raise ValueError(f"replacement {new!r} names group {two[1]} of {groups}")
            out.append(int(two[1]))
        elif two == "$&":
            out.append(0)
        elif two == "$$":
            out.append("$")
        elif two[:1] == "\\" and len(two) == 2:
            out.append({"n": "\n", "t": "\t", "r": "\r"}.get(two[1], two[1]))
        else:
            out.append(new[i])
            two = new[i]
        i += len(two)
    return out


def template(new: str, groups: int) -> str:
    """The same in the notation of Java's regular expressions."""
    return "".join(f"${x}" if isinstance(x, int) else re.sub(r"([\\$])", r"\\\1", x) for x in template_parts(new, groups))


#: What can make a match depend on text behind it.
LOOKS_ON = re.compile(r"\(\?[=!<]|\\[bBzZAG]|[$^]")


def replace_first(rows: DataFrame, pattern: str, parts: list[str | int], limit: int) -> tuple[DataFrame, Column, Column]:
    """rows with columns `__*` of their own, their text with the first matches replaced, and whether a match is empty (which this
    form can't place).

    split() stops after the last match that counts; groups are read from the text up to there, or from the whole text if the
    pattern looks beyond a match. Both are columns, since what stands inside a lambda is evaluated for each element.
    """
    text, pieces, head = F.col("text"), F.col("__pieces"), F.col("__head")
    body = re.sub(r"^\(\?[a-z]+\)", "", pattern)
    up_to = text if LOOKS_ON.search(body) else F.when(F.size(pieces) > 1, F.left(text, F.length(text) - F.length(F.element_at(pieces, -1)))).otherwise(F.lit(""))
    groups = {0, *(x for x in parts if isinstance(x, int))}
    rows = rows.withColumn("__pieces", F.split(text, pattern, limit + 1)).withColumn("__head", up_to)
    rows = rows.withColumns({f"__group{g}": F.regexp_extract_all(head, F.lit(pattern), F.lit(g)) for g in groups})
    put = lambda i: [F.get(f"__group{x}", i) if isinstance(x, int) else F.lit(x) for x in parts]
    each = F.transform(pieces, lambda p, i: F.when(i < F.size(pieces) - 1, F.concat(p, *put(i))).otherwise(p))
    return rows, F.array_join(each, ""), F.exists("__group0", lambda x: x == "")


def _block(text: str) -> list[str]:
    """Lines without their common indentation."""
    each = text.split("\n")
    least = min((len(x) - len(x.lstrip(" \t")) for x in each if x), default=0)
    return [x[least:] for x in each]


def _indent(each: Column) -> Column:
    """The common indentation of an array of lines, in characters; empty lines don't count."""
    return F.coalesce(F.array_min(F.transform(F.filter(each, lambda x: x != ""), lambda x: F.length(x) - F.length(F.ltrim(x, F.lit(" \t"))))), F.lit(0))


def block_places(each: Column, old: str) -> Column:
    """The line numbers, from 0, where the lines of old stand among a text's lines if the common indentation of either is set aside.

    Only places where the longest line of old stands, white space aside, are looked at, so that a text's lines are gone through once.
    """
    wanted = _block(old.removesuffix("\n"))
    n = F.size(each) - (F.element_at(each, -1) == "").cast("int")
    longest = max(range(len(wanted)), key=lambda k: len(wanted[k].strip(" \t")))
    bare = lambda x: F.transform(x, lambda y: F.substr(y, _indent(x) + 1))
    anchors = F.transform(each, lambda x, i: F.when(F.trim(x, F.lit(" \t")) == wanted[longest].strip(" \t"), i - longest))
    starts = F.filter(anchors, lambda i: i.isNotNull() & (i >= 0) & (i <= n - len(wanted)))
    return F.filter(starts, lambda i: bare(F.slice(each, i + 1, len(wanted))) == F.array(*map(F.lit, wanted)))


def replace_block(each: Column, places: Column, old: str, new: str) -> Column:
    """The text of lines with the first of the blocks at places (block_places()) replaced by the lines of new, indented as the block
    was. The block is whole lines: a newline at its end goes with it, and what new ends with stands there instead, with one more
    newline if it ends with one."""
    m = len(_block(old.removesuffix("\n")))
    at = F.get(places, F.lit(0))
    part = F.slice(each, at + 1, m)
    lead = F.coalesce(F.substr(F.get(F.filter(part, lambda x: x != ""), F.lit(0)), F.lit(1), _indent(part)), F.lit(""))
    fresh = [F.concat(lead, F.lit(x)) if x else F.lit("") for x in _block(new)]
    body = F.concat_ws("\n", *fresh, *([F.lit("")] if new.endswith("\n") else []))
    before = F.concat(F.array_join(F.slice(each, F.lit(1), at), "\n"), F.when(at > 0, "\n").otherwise(""))
    return F.concat(before, body, F.array_join(F.slice(each, at + m + 1, F.greatest(F.size(each) - at - m, F.lit(0))), "\n"))


def apply_edits(files: DataFrame, edits: list[dict]) -> DataFrame:
    """files with text edited and error: each edit works on the last one's result, and the first that fails stops that file.

    An edit: old, new, limit (1: exactly one occurrence must exist; 0: all; n: the first n), regex, ignore_case. No occurrence
    is always an error. A literal edit with limit 1 that occurs nowhere is looked for as a block of lines with another
    indentation. A regular expression with a limit above 1 that matches an empty text is an error.
    """
    out = files.withColumn("error", F.lit(None).cast("string"))
    columns = out.columns
    for k, e in enumerate(edits):
        old, new, limit = e["old"], e["new"], e.get("limit", 1)
        flags = ("i" if e.get("ignore_case") else "") + ("m" if e.get("regex") else "")
        body = old if e.get("regex") else re.escape(old).replace("\\ ", " ")
        pattern = (f"(?{flags})" if flags else "") + body
        groups = re.compile(body).groups if e.get("regex") else 0
        text = F.col("text")
        # only the uniqueness guard has to count; otherwise the first match settles it
        n = F.regexp_count(text, F.lit(pattern)) if limit == 1 else text.rlike(pattern).cast("int")
        java_new = template(new, groups) if e.get("regex") else re.sub(r"([\\$])", r"\\\1", new)
        if limit in (0, 1):
            done = F.regexp_replace(text, pattern, java_new) if e.get("regex") or e.get("ignore_case") else F.replace(text, F.lit(old), F.lit(new))
        elif e.get("regex") or e.get("ignore_case"):
            out, done, empty = replace_first(out, pattern, template_parts(new, groups) if e.get("regex") else [new], limit)
        else:
            done = F.concat_ws(new, F.split(text, pattern, limit + 1))
        if limit == 1 and not flags and re.search(r"\n|^[ \t]", old):
            # columns of their own, since what stands inside a lambda is evaluated for each element
            out = out.withColumn("__each", F.when(n == 0, F.split(text, "\n"))).withColumn("__at", block_places(F.col("__each"), old))
            done = F.when(n == 0, replace_block(F.col("__each"), F.col("__at"), old, new)).otherwise(done)
            n = F.when(n == 0, F.size("__at")).otherwise(n)
        problem = F.when(n == 0, F.lit(f"edit {k}: no match"))
        if limit > 1 and flags:
            problem = problem.when(empty, F.lit(f"edit {k}: empty match"))
        if limit == 1:
            problem = problem.when(n > 1, F.concat(F.lit(f"edit {k}: "), n.cast("string"), F.lit(" matches")))
        fresh = F.col("error").isNull()
        out = out.withColumn("__p", F.when(fresh, problem)).withColumn("text", F.when(fresh & F.col("__p").isNull(), done).otherwise(text)).withColumn("error", F.coalesce("error", "__p"))
        out = out.select(*(f"`{c}`" for c in columns))
    return out


#: Media types by file name extension.
MEDIA_TYPES = {
    "txt": "text/plain", "text": "text/plain", "md": "text/markdown", "markdown": "text/markdown", "json": "application/json", "xml": "application/xml",
    "html": "text/html", "htm": "text/html", "css": "text/css", "js": "text/javascript", "mjs": "text/javascript", "py": "text/x-python", "swift": "text/x-swift",
    "c": "text/x-c", "h": "text/x-c", "cpp": "text/x-c++", "cc": "text/x-c++", "cxx": "text/x-c++", "hpp": "text/x-c++", "hh": "text/x-c++", "mm": "text/x-c++",
    "m": "text/x-objcsrc", "rs": "text/x-rust", "go": "text/x-go", "sh": "application/x-sh", "bash": "application/x-sh", "zsh": "application/x-sh",
    "yml": "application/yaml", "yaml": "application/yaml", "toml": "application/toml", "pdf": "application/pdf", "png": "image/png", "jpg": "image/jpeg",
    "jpeg": "image/jpeg", "gif": "image/gif", "svg": "image/svg+xml",
}


def resources(files: DataFrame) -> DataFrame:
    """(path, name, uri, mime) of each file; what no extension names has no mime."""
    kinds = files.sparkSession.createDataFrame(list(MEDIA_TYPES.items()), "ext string, mime string")
    rows = files.select("path", P.basename(F.col("path")).alias("name"), P.file_uri(F.col("path")).alias("uri"), P.extension(F.col("path")).alias("ext"))
    return rows.join(F.broadcast(kinds), "ext", "left").select("path", "name", "uri", "mime")


def summarize(matches: DataFrame, most: int, skipped: int = 0) -> DataFrame:
    """One row: files and lines that matched, those skipped, and whether the cap was reached."""
    found = matches.agg(F.count_distinct(F.when(F.col("is_match"), F.col("path"))).alias("files"), F.count_if("is_match").alias("matches"))
    return found.withColumns({"skipped": F.lit(skipped).cast("long"), "truncated": F.col("matches") >= most})


def unified_diff(before: DataFrame, after: DataFrame, context: int = 3) -> DataFrame:
    """(path, start, old_lines, new_lines, hunk) of each file that changed: one hunk, from the first line that differs to the
    last, with context. Texts are split into arrays of lines; their common ends are found by higher-order functions."""
    a, b = F.col("a"), F.col("b")
    rows = before.select("path", F.split("text", "\n").alias("a")).join(after.select("path", F.split("text", "\n").alias("b")), "path").filter(~(a == b))
    shorter = F.least(F.size(a), F.size(b))
    same = lambda flags, x: F.when(flags["on"] & x, F.struct((flags["n"] + 1).alias("n"), F.lit(True).alias("on"))).otherwise(F.struct(flags["n"].alias("n"), F.lit(False).alias("on")))
    zero = F.struct(F.lit(0).alias("n"), F.lit(True).alias("on"))
    rows = rows.withColumn("head", F.aggregate(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), zero, same)["n"])
    rows = rows.withColumn("tail", F.least(F.aggregate(F.zip_with(F.reverse(a), F.reverse(b), lambda x, y: x.eqNullSafe(y)), zero, same)["n"], shorter - F.col("head")))
    first = F.greatest(F.col("head") - context, F.lit(0))
    cut = lambda c, at, n: F.slice(c, (at + 1).cast("int"), F.greatest(n, F.lit(0)).cast("int"))
    mark = lambda c, sign: F.transform(c, lambda x: F.concat(F.lit(sign), x))
    after_n = F.least(F.col("tail"), F.lit(context))
    hunk = F.concat(mark(cut(a, first, F.col("head") - first), " "), mark(cut(a, F.col("head"), F.size(a) - F.col("head") - F.col("tail")), "-"), mark(cut(b, F.col("head"), F.size(b) - F.col("head") - F.col("tail")), "+"), mark(cut(a, F.size(a) - F.col("tail"), after_n), " "))
    return rows.select("path", (first + 1).alias("start"), (F.size(a) - F.col("tail") + after_n - first).alias("old_lines"), (F.size(b) - F.col("tail") + after_n - first).alias("new_lines"), F.array_join(hunk, "\n").alias("hunk"))
