"""Symbols: definitions by language, references, the innermost enclosing definition, architectural kinds."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Names that calls look like but are not.
_KEYWORDS = frozenset("if for foreach while switch catch using lock return new throw nameof typeof sizeof default await function else do fixed when in is as".split())
_MODIFIERS = r"(?:(?:public|private|protected|internal|static|sealed|abstract|partial|virtual|override|async|readonly|extern|unsafe|new|export|default|declare)\s+)*"
#: Definition patterns of each extension: kind and expression whose group 1 is the name.
DEFINITIONS = {
    "go": [("func", r"^func\s+(?:\([^)]*\)\s*)?([A-Za-z_]\w*)\s*[\[(]"), ("type", r"^type\s+([A-Za-z_]\w*)\s"), ("const", r"^const\s+([A-Za-z_]\w*)\b"), ("var", r"^var\s+([A-Za-z_]\w*)\b")],
    "cs": [("type", rf"^\s*{_MODIFIERS}(?:class|interface|struct|enum|record)\s+([A-Za-z_]\w*)"), ("func", rf"^\s*{_MODIFIERS}(?!return\b|await\b|else\b|throw\b|using\b|new\b)[\w<>\[\],.?]+\s+([A-Za-z_]\w*)\s*(?:<[^<>()]*>)?\s*\([^;{{]*?\)\s*(?:where\b[^{{]*)?(?:\{{|=>|$)")],
    "ts": [("type", rf"^\s*{_MODIFIERS}(?:class|interface|enum|type)\s+([A-Za-z_]\w*)"), ("func", rf"^\s*{_MODIFIERS}function\s*\*?\s*([A-Za-z_]\w*)"), ("func", rf"^\s+{_MODIFIERS}([A-Za-z_]\w*)\s*\([^()]*\)\s*[:{{]")],
    "sql": [("func", r"^CREATE\s+(?:OR\s+(?:REPLACE|ALTER)\s+)?(?:PROCEDURE|PROC|FUNCTION|TRIGGER)\s+(?:\[?\w+\]?\.)?\[?(\w+)\]?"), ("type", r"^CREATE\s+(?:OR\s+(?:REPLACE|ALTER)\s+)?(?:TABLE|VIEW|TYPE|INDEX|SEQUENCE)\s+(?:IF\s+NOT\s+EXISTS\s+)?(?:\[?\w+\]?\.)?\[?(\w+)\]?")],
    "cfm": [("func", r"<cffunction\b[^>]*\bname\s*=\s*[\"'](\w+)"), ("func", r"^\s*(?:public|private|remote)?\s*function\s+(\w+)\s*\("), ("type", r"<cfcomponent\b[^>]*\bname\s*=\s*[\"'](\w+)")],
}
_SAME = {"tsx": "ts", "js": "ts", "jsx": "ts", "cfc": "cfm"}
CALL = re.compile(r"\b([A-Za-z_]\w*)\s*(?:<[^<>()]*>)?\s*\(")


def mask(text: str) -> str:
    """Comments and string contents as spaces; every offset stays."""
    pattern = r"//[^\n]*|/\*.*?\*/|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`[^`]*`"
    return re.sub(pattern, lambda m: re.sub(r"[^\n]", " ", m[0]), text, flags=re.S)


def extract(path: str, text: str) -> list[tuple[str, str, int, int, str]]:
    """(name, kind, start, body_end, role) of a file's definitions and call references; offsets in bytes."""
    ext = path.rpartition(".")[2].lower()
    ext = _SAME.get(ext, ext)
    if ext not in DEFINITIONS:
        return []
    code = mask(text) if ext not in ("sql", "cfm") else text
    flags = re.M | (re.I if ext in ("sql", "cfm") else 0)
    found, taken = [], set()
    for kind, pattern in DEFINITIONS[ext]:
        for m in re.finditer(pattern, code, flags):
            if m[1] not in _KEYWORDS and m.start(1) not in taken:
                taken.add(m.start(1))
                found.append((m.start(1), m[1], kind, _body_end(code, m.end(), ext)))
    found.sort()
    if ext == "sql":  # a routine reaches to the next CREATE
        found = [(s, n, k, found[i + 1][0] if i + 1 < len(found) else len(code)) for i, (s, n, k, _) in enumerate(found)]
    at = lambda i: len(text[:i].encode())
    out = [(n, k, at(s), at(e), "definition") for s, n, k, e in found]
    if ext not in ("sql", "cfm"):
        out += [(m[1], "call", at(m.start(1)), at(m.end(1)), "reference") for m in CALL.finditer(code) if m[1] not in _KEYWORDS and m.start(1) not in taken]
    return out


def _body_end(code: str, start: int, ext: str) -> int:
    """One past the brace that closes the first one after a declaration; the line's end without any."""
    line = code.find("\n", start)
    line = len(code) if line < 0 else line
    opened = code.find("{", start)
    if opened < 0 or ";" in code[start:opened] or ext in ("sql", "cfm"):
        return line
    depth = 0
    for m in re.finditer(r"[{}]", code[opened:]):
        depth += 1 if m[0] == "{" else -1
        if not depth:
            return opened + m.end()
    return len(code)


def symbols(files: DataFrame) -> DataFrame:
    """blob_sha, rel_path, name, kind, start, body_end, role; the least path of a blob decides on its language."""
    blobs = files.groupBy("blob_sha").agg(F.min("rel_path").alias("rel_path"), F.first("content").alias("content"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(s, p, *x) for s, p, c in zip(pdf["blob_sha"], pdf["rel_path"], pdf["content"], strict=True) for x in extract(p, c or "")]
            yield pd.DataFrame(rows, columns=["blob_sha", "rel_path", "name", "kind", "start", "body_end", "role"])

    return blobs.mapInPandas(run, "blob_sha string, rel_path string, name string, kind string, start long, body_end long, role string")


def enclosing(offsets: DataFrame, definitions: DataFrame, bin_size: int = 4096) -> DataFrame:
    """Each offset (key, at) with the innermost definition (key, start, body_end) around it, if any: an equi-join on
    offset bins, so a range never meets the offsets outside its bins."""
    defs = definitions.withColumn("bin", F.explode(F.sequence(F.floor(F.col("start") / bin_size), F.floor((F.col("body_end") - 1) / bin_size))))
    met = offsets.join(defs.withColumnRenamed("key", "dkey"), (F.col("key") == F.col("dkey")) & (F.floor(F.col("at") / bin_size) == F.col("bin")) & (F.col("start") <= F.col("at")) & (F.col("at") < F.col("body_end")), "left")
    w = Window.partitionBy("key", "at").orderBy(F.col("body_end") - F.col("start"), F.desc("start"))
    return met.withColumn("rn", F.row_number().over(w)).filter("rn = 1").select("key", "at", "name", "start", "body_end")


def name_index(found: DataFrame, files: DataFrame) -> DataFrame:
    """name, role, sites, repos of every symbol name."""
    return found.join(files.select("blob_sha", "repo").distinct(), "blob_sha").groupBy("name", "role").agg(F.count_distinct("blob_sha", "start").alias("sites"), F.sort_array(F.collect_set("repo")).alias("repos"))


def exported(name):
    """Names that begin with a capital and have three bytes or more."""
    return F.rlike(name, F.lit(r"^\p{Lu}")) & (F.octet_length(name) >= 3)


def sweep(found: DataFrame) -> DataFrame:
    """One row: names of a corpus (name), those for which candidates are generated, and those left out."""
    names = found.select("name").distinct()
    return names.agg(F.count(F.lit(1)).alias("names"), F.count_if(exported(F.col("name"))).alias("generated")).select("names", "generated", (F.col("names") - F.col("generated")).alias("excluded"))


def cross_shard(definitions: DataFrame, occurrences: DataFrame) -> DataFrame:
    """Names with an occurrence (name, shard) that may lead to another shard: definitions in several, or none in its own."""
    held = definitions.groupBy(F.col("name").alias("n")).agg(F.min("shard").alias("least"), F.max("shard").alias("most"))
    met = occurrences.select("name", "shard").distinct().join(held, F.col("name") == F.col("n"), "left")
    return met.filter("least IS NULL OR least <> most OR least <> shard").select("name").distinct()


#: Architectural kinds in the order in which they win, the marker a file must hold, and an expression whose group 1 names the symbol.
KINDS = (
    ("route", "[Http", r"\[Http(?:Get|Post|Put|Delete|Patch)[^\]]*\]\s*(?:\[[^\]]*\]\s*)*(?:public|private|protected|internal)[\w\s<>\[\],.?]*?\b(\w+)\s*\("),
    ("event", "Consumer", r"class\s+\w*Consumer\b[^{]*IConsumer<\s*(\w+)\s*>|class\s+(\w+Consumer)\b"),
    ("table", "DbSet<", r"DbSet<\s*(\w+)\s*>"),
    ("queue", "IPublishEndpoint", r"class\s+(\w+)\b[^{]*\{[^}]*IPublishEndpoint"),
    ("service", "services.Add", r"services\.Add(?:Scoped|Transient|Singleton)<(?:[^<>]*,)?\s*(\w+)\s*>"),
)


def classify(files: DataFrame) -> DataFrame:
    """name, kind: the first kind in order that marks a name."""
    found = None
    for order, (kind, marker, pattern) in enumerate(KINDS):
        groups = re.compile(pattern).groups
        hits = files.filter(F.contains("content", F.lit(marker)))
        rows = None
        for g in range(1, groups + 1):
            own = hits.select(F.explode(F.regexp_extract_all("content", F.lit("(?s)" + pattern), g)).alias("name"))
            rows = own if rows is None else rows.unionByName(own)
        rows = rows.filter("name <> ''").select("name", F.lit(kind).alias("kind"), F.lit(order).alias("o"))
        found = rows if found is None else found.unionByName(rows)
    return found.groupBy("name").agg(F.min_by("kind", "o").alias("kind"))
