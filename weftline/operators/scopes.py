"""Declarations of source files, the scopes that they open, and the innermost scope around any line.

Python blocks are told by indents, the others by the depth of braces. A declaration at a level encloses the lines up to the
next one at its level or a lower one. Where a text is one row, :func:`scanned` reads each file once with a stack of the open
scopes and shuffles nothing. Where lines lie in rows of their own, both questions - where a scope ends, what encloses a line -
are windows by file and level over the lines in order, so a file's lines never meet each other in pairs.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A head with a word that tells its kind: async, kind, name, parameters.
HEAD = r"^\s*(?:export\s+)?(?:public\s+)?(async\s+)?(def|class|function)\s+([A-Za-z_]\w*)\s*(?:\(([^)]*))?"
#: A method of a brace language: async, name, parameters.
METHOD = r"^\s+(?:public\s+|private\s+|protected\s+)?(async\s+)?(?:[A-Za-z_][\w<>]*\s+)?([A-Za-z_]\w*)\(([^)]*)\)\s*\{\s*$"
#: A table or view: kind, name.
STORED = r"(?i)^\s*create\s+(table|view)\s+(?:if\s+not\s+exists\s+)?([a-z_]\w*)"

BRACES = ("typescript", "javascript", "java")
DECLARED = "array<struct<line_no:int,end_line:int,word:string,kind:string,name:string,qualified:string,parent:string,params:string,is_async:boolean,is_exported:boolean,decorator:string>>"
#: What a line calls, and the relations of a table's name in a statement by the word before it; without one of the words a line accesses nothing.
CALL = r"\b([A-Za-z_]\w*)\("
ACCESS = {"QUERIES_TABLE": r"(?i)\b(?:from|join)\s+([a-z_]\w*)", "WRITES_TABLE": r"(?i)\b(?:into|update)\s+([a-z_]\w*)", "CREATES_TABLE": r"(?i)\bcreate\s+(?:table|view)\s+(?:if\s+not\s+exists\s+)?([a-z_]\w*)"}
ACCESS_WORDS = ["from", "join", "into", "update", "create"]
CALLED = "array<struct<caller:string,name:string,here:string>>"
USED = "array<struct<user:string,t:string,relation:string>>"
_HEAD, _METHOD, _STORED, _SKIPPED, _MARK, _EXPORTED, _CALL = (re.compile(p, re.ASCII) for p in (HEAD, METHOD, STORED, r"\s*(#|//|$)", r"\s*@\w", r"\s*(?:export|public)\s", CALL))
_ACCESS = {r: re.compile(p, re.ASCII) for r, p in ACCESS.items()}


def _declares(line: str, language: str) -> tuple[str, str, str, bool] | None:
    """word, name, params, is_async of a line that declares something; most lines are told by a word or sign that they lack."""
    if ("def" in line or "class" in line or "function" in line) and (m := _HEAD.match(line)):
        return m[2], m[3], m[4] or "", bool(m[1])
    if language in BRACES and "{" in line and "(" in line and (m := _METHOD.match(line)):
        return "def", m[2], m[3], bool(m[1])
    if language == "sql" and (m := _STORED.match(line)):
        return m[1].lower(), m[2], "", False
    return None


def _scan(text: str, language: str) -> tuple[list[dict], list[int | None], list[bool], list[tuple], list[tuple]]:
    """A file's declarations, and for each line the place of the innermost one around it (-1: none, None: no level) and whether it declares something, by a stack of open scopes; then what its lines call and access."""
    found, owner_at, head, open_, depth, mark = [], [], [], [], 0, None
    calls, uses = {}, {}
    rows = text.split("\n")
    for no, line in enumerate(rows, 1):
        skipped = _SKIPPED.match(line)
        level = len(line) - len(line.lstrip(" \t\r\f\v")) if language == "python" else depth
        depth += line.count("{") - line.count("}")
        head.append(False)
        if skipped:
            owner_at.append(None)
            mark = mark if skipped[1] else None
            continue
        while open_ and open_[-1][0] >= level:
            found[open_.pop()[1]]["end_line"] = no - 1
        around = found[open_[-1][1]] if open_ else None
        owner_at.append(open_[-1][1] if open_ else -1)
        owner = around["qualified"] if around and around["word"] not in ("table", "view") else None
        if d := _declares(line, language):
            word, name, params, is_async = d
            kind = f"SQL_{word.upper()}" if word in ("table", "view") else "CLASS" if word == "class" else "METHOD" if around and around["word"] == "class" else "FUNCTION"
            head[-1] = True
            open_.append((level, len(found)))
            found.append({
                "line_no": no, "end_line": len(rows), "word": word, "kind": kind, "name": name, "qualified": f"{around['qualified']}.{name}" if around else name, "parent": around and around["name"],
                "params": params.strip(" "), "is_async": is_async, "is_exported": bool(_EXPORTED.match(line)), "decorator": mark,
            })
        elif owner and "(" in line:
            calls.update(((owner, n), None) for n in _CALL.findall(line))
        low = line.lower()
        if any(w in low for w in ACCESS_WORDS):
            uses.update(((owner, n.lower(), r), None) for r, p in _ACCESS.items() for n in p.findall(line))
        mark = line.strip(" ") if "@" in line and _MARK.match(line) else None
    here = {}
    for d in found:
        if d["kind"] in ("FUNCTION", "METHOD"):
            here[d["name"]] = min(d["qualified"], here.get(d["name"], d["qualified"]))
    return found, owner_at, head, [{"caller": c, "name": n, "here": here.get(n)} for c, n in calls], [{"user": u, "t": t, "relation": r} for u, t, r in uses]


def scanned(files: DataFrame) -> DataFrame:
    """path, language, text of files with declared (their declarations in order), and for each line owner_at (the place in declared of the innermost one around it; -1: none, null: a line without a level) and head (whether it declares something).

    calls holds what lines inside a declaration (caller, qualified; no table or view) that declare nothing call: a name, and here, the least qualified
    function or method of that name in the file; uses the tables (t) that lines access and how, user as caller, null elsewhere. Both hold equal
    ones once, so that later steps don't read texts again.
    """
    f = files.select("path", "language", "text").where("text is not null")
    schema = f"path string, language string, text string, declared {DECLARED}, owner_at array<int>, head array<boolean>, calls {CALLED}, uses {USED}"
    simple = {"int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}
    fields = {i: [(n, simple[t]) for n, t in (x.split(":") for x in ddl[len("array<struct<") : -2].split(","))] for i, ddl in ((0, DECLARED), (3, CALLED), (4, USED))}

    def lists(rows: list[list], own) -> pa.Array:
        """Lists of values (own: their type) or of dicts (own: their fields), put together by columns."""
        flat = [x for r in rows for x in r]
        values = pa.StructArray.from_arrays([pa.array([x[n] for x in flat], t) for n, t in own], [n for n, _ in own]) if isinstance(own, list) else pa.array(flat, own)
        return pa.ListArray.from_arrays(pa.array([0, *accumulate(map(len, rows))], pa.int32()), values)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [_scan(t, la) for t, la in zip(b["text"].to_pylist(), b["language"].to_pylist(), strict=True)]
            new = [lists([g[i] for g in got], t) for i, t in ((0, fields[0]), (1, pa.int32()), (2, pa.bool_()), (3, fields[3]), (4, fields[4]))]
            yield pa.RecordBatch.from_arrays([b["path"], b["language"], b["text"], *new], ["path", "language", "text", "declared", "owner_at", "head", "calls", "uses"])

    return f.mapInArrow(scan, schema)


def owned_lines() -> Column:
    """The lines with a level of a row of :func:`scanned`: line_no, line, at (the owner's place in declared) and head (whether it declares something)."""
    all_ = F.transform(F.split("text", "\n"), lambda x, i: F.struct((i + 1).alias("line_no"), x.alias("line"), F.get("owner_at", i).alias("at"), F.get("head", i).alias("head")))
    return F.filter(all_, lambda x: x["at"].isNotNull())


def lines(files: DataFrame) -> DataFrame:
    """path, language, line_no, line and level; blank lines and whole-line comments have no level."""
    x = files.select("path", "language", F.posexplode(F.split("text", "\n")).alias("at", "line")).withColumn("line_no", F.col("at") + 1).drop("at")
    step = F.regexp_count("line", F.lit(r"\{")) - F.regexp_count("line", F.lit(r"\}"))
    before = Window.partitionBy("path").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    depth = F.coalesce(F.sum(step).over(before), F.lit(0))
    indent = F.length(F.regexp_extract("line", r"^(\s*)", 1))
    level = F.when(F.col("language") == "python", indent).otherwise(depth).cast("long")
    return x.withColumn("level", F.when(~F.col("line").rlike(r"^\s*(?:#|//|$)"), level))


def declarations(ln: DataFrame) -> DataFrame:
    """path, language, line_no, level, word, name, params, is_async, is_exported of lines that declare something."""
    get = lambda p, i: F.regexp_extract("line", p, i)
    brace = F.col("language").isin("typescript", "javascript", "java")
    kinds = [(F.col("line").rlike(HEAD), get(HEAD, 2), get(HEAD, 3), get(HEAD, 4), get(HEAD, 1)), (brace & F.col("line").rlike(METHOD), F.lit("def"), get(METHOD, 2), get(METHOD, 3), get(METHOD, 1)), ((F.col("language") == "sql") & F.col("line").rlike(STORED), F.lower(get(STORED, 1)), get(STORED, 2), F.lit(""), F.lit(""))]
    d = F.coalesce(*(F.when(hit, F.struct(w.alias("word"), n.alias("name"), p.alias("params"), (a != "").alias("is_async"))) for hit, w, n, p, a in kinds))
    found = ln.withColumn("d", d).where("level is not null and d is not null")
    return found.select("path", "language", "line_no", "level", "d.word", "d.name", "d.params", "d.is_async", F.col("line").rlike(r"^\s*(?:export|public)\s").alias("is_exported"))


def with_ends(ln: DataFrame, decl: DataFrame) -> DataFrame:
    """Declarations with end_line: the line before the next one that isn't deeper, or the file's last one."""
    levels = decl.groupBy("path").agg(F.collect_set("level").alias("levels"))
    last = ln.groupBy("path").agg(F.max("line_no").alias("last"))
    own = ln.where("level is not null").join(levels, "path").withColumn("at", F.explode(F.filter("levels", lambda x: x >= F.col("level"))))
    follow = own.select("path", "at", "line_no", "level", F.lead("line_no").over(Window.partitionBy("path", "at").orderBy("line_no")).alias("next"))
    ends = follow.where("at = level").select("path", "line_no", "next")
    return decl.join(ends, ["path", "line_no"]).join(last, "path").withColumn("end_line", F.coalesce(F.col("next") - 1, "last")).drop("next", "last")


def enclosing(asked: DataFrame, decl: DataFrame) -> DataFrame:
    """path, line_no and scopes, from the outermost: level, word, name, line of each declaration around the lines ``asked`` (path, line_no, level)."""
    levels = decl.groupBy("path").agg(F.collect_set("level").alias("levels"))
    q = asked.select("path", "line_no", "level").distinct().join(levels, "path").select("path", "line_no", F.explode(F.filter("levels", lambda x: x < F.col("level"))).alias("at"), F.lit(None).alias("d"))
    d = decl.select("path", "line_no", F.col("level").alias("at"), F.struct("level", "word", "name", "line_no", "end_line").alias("d"))
    w = Window.partitionBy("path", "at").orderBy("line_no", F.col("d").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    met = d.unionByName(q.withColumn("d", F.col("d").cast(d.schema["d"].dataType))).withColumn("open", F.last("d", ignorenulls=True).over(w))
    inside = met.where("d is null and open.line_no < line_no and open.end_line >= line_no")
    return inside.groupBy("path", "line_no").agg(F.array_sort(F.collect_list("open")).alias("scopes"))


def symbols(ln: DataFrame, decl: DataFrame) -> DataFrame:
    """path, language, line_no, end_line, kind, name, qualified, parent, params, is_async, is_exported, decorator of every declaration.

    ``ln`` and ``decl`` are those of :func:`lines` and :func:`with_ends`; both are read several times and best written before.
    """
    around = enclosing(decl, decl)
    x = decl.join(around, ["path", "line_no"], "left")
    outer = F.try_element_at("scopes", F.lit(-1))
    kind = F.when(F.col("word").isin("table", "view"), F.concat(F.lit("SQL_"), F.upper("word"))).when(F.col("word") == "class", "CLASS").when(outer["word"] == "class", "METHOD").otherwise("FUNCTION")
    names = F.concat(F.coalesce(F.transform("scopes", lambda s: s["name"]), F.array().cast("array<string>")), F.array("name"))
    # the decorator is the nearest line before, with only other decorators and comments between
    at = Window.partitionBy("path").orderBy("line_no")
    told = ln.withColumn("mark", F.when(F.col("line").rlike(r"^\s*@\w"), F.trim("line"))).withColumn("skip", F.col("mark").isNotNull() | F.col("line").rlike(r"^\s*(?:#|//)"))
    told = told.withColumn("run", F.sum((~F.col("skip")).cast("long")).over(at.rowsBetween(Window.unboundedPreceding, -1)))
    near = told.withColumn("decorator", F.last("mark", ignorenulls=True).over(Window.partitionBy("path", "run").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)))
    x = x.join(near.select("path", "line_no", "decorator"), ["path", "line_no"])
    return x.select("path", "language", "line_no", "end_line", kind.alias("kind"), "name", F.array_join(names, ".").alias("qualified"), outer["name"].alias("parent"), F.trim("params").alias("params"), "is_async", "is_exported", "decorator")


def owners(ln: DataFrame, decl: DataFrame) -> DataFrame:
    """path, language, line_no, line of every line with a level, and the innermost declaration around it: owner, owner_line, owner_word (null outside any).

    A head belongs to what encloses the head.
    """
    real = ln.where("level is not null")
    o = F.try_element_at("scopes", F.lit(-1))
    return real.join(enclosing(real, decl), ["path", "line_no"], "left").select("path", "language", "line_no", "line", o["name"].alias("owner"), o["line_no"].alias("owner_line"), o["word"].alias("owner_word"))


def matches(owned: DataFrame, pattern: str, name: str, group: int = 1) -> DataFrame:
    """path, line_no, owner, owner_line and each match of a pattern in lines of :func:`owners`."""
    return owned.select("path", "language", "line_no", "owner", "owner_line", F.explode(F.regexp_extract_all("line", F.lit(pattern), group)).alias(name))
