"""Relations read from source text: inheritance, injection, data access, templates, messages, verified uses.

Sites are found file by file in Arrow workers, comments and strings masked; what they lead to is settled by joins on
names. Tiers: Pattern (2) for the sole type of a name in the source's own repository, else Candidate (1).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .symbols import mask

SITES = "blob_sha string, repo string, at long, source string, relation string, target string, keyword string"
_CS_TYPE = re.compile(r"\b(class|interface|struct|record)\s+(\w+)\s*(?:<[^<>{]*>)?\s*(?:\([^()]*\)\s*)?(?::\s*([^{;]+?))?\s*(?:\bwhere\b[^{]*)?[{;]")
_TS_TYPE = re.compile(r"\b(class|interface)\s+(\w+)\s*(?:<[^{]*?>)?\s*(?:extends\s+([\w.,\s<>]+?))?\s*(?:implements\s+([\w.,\s<>]+?))?\s*\{")
_DI = re.compile(r"\.Add(?:Scoped|Transient|Singleton)\s*<\s*([\w.]+)\s*(?:,\s*([\w.]+)\s*)?>")
_DBSET = re.compile(r"\bDbSet<\s*(\w+)\s*>\s+(\w+)")
_SELECTOR = re.compile(r"selector\s*:\s*['\"`]([\w-]+)['\"`]")
_TAG = re.compile(r"<([a-z][a-z0-9]*-[a-z0-9-]*)[\s/>]")
_MESSAGE = re.compile(r"\.(Publish|Send)(?:Async)?\s*(?:<\s*(\w+)\s*>|\(\s*new\s+(\w+))|\bIConsumer<\s*(\w+)\s*>")


def _names(text: str | None) -> list[str]:
    """Types of a comma list, without arguments of generics and without qualifiers."""
    flat = re.sub(r"<[^<>]*>", "", re.sub(r"<[^<>]*<[^<>]*>[^<>]*>", "", text or ""))
    return [n.strip().rpartition(".")[2] for n in flat.split(",") if re.fullmatch(r"[\w.]+", n.strip())]


def sites(path: str, text: str) -> list[tuple[int, str, str, str, str]]:
    """(at, source, relation, target, keyword) of one file."""
    ext, out = path.rpartition(".")[2].lower(), []
    if ext == "html":
        return [(m.start(), path, "renders", m[1], "tag") for m in _TAG.finditer(text)]
    if ext not in ("cs", "ts", "tsx"):
        return []
    code = mask(text)
    types = []
    for m in (_CS_TYPE if ext == "cs" else _TS_TYPE).finditer(code):
        types.append((m.start(), m[2]))
        if ext == "cs":
            for n in _names(m[3]):
                kind = "implements" if re.match(r"I[A-Z]", n) else "extends"
                out.append((m.start(), m[2], kind, n, m[1]))
        else:
            out += [(m.start(), m[2], "extends", n, m[1]) for n in _names(m[3])]
            out += [(m.start(), m[2], "implements", n, m[1]) for n in _names(m[4])]
    owner = lambda at: next((n for s, n in reversed(types) if s <= at), path)
    if ext == "cs":
        for m in _DI.finditer(code):
            if m[2]:
                out.append((m.start(), m[2].rpartition(".")[2], "implements", m[1].rpartition(".")[2], "registration"))
        for s, n in types:
            for m in re.finditer(rf"\b{re.escape(n)}\s*\(([^()]*)\)\s*(?::[^{{]*)?\{{", code[s:]):
                out += [(s + m.start(), n, "injects", x.split()[0].rpartition(".")[2], "constructor") for x in re.sub(r"<[^<>]*>", "", m[1]).split(",") if re.fullmatch(r"\s*[A-Z][\w.]*\s+\w+\s*", x)]
        out += [(m.start(), m[2], "set", m[1], "DbSet") for m in _DBSET.finditer(code)]
        out += [(m.start(), owner(m.start()), "access", m[1], "property") for m in re.finditer(r"\.([A-Z]\w*)\b(?!\s*\()", code)]
        for m in _MESSAGE.finditer(code):
            if m[4]:
                out.append((m.start(), owner(m.start()), "consumes", m[4], "consumer"))
            elif m[2] or m[3]:
                out.append((m.start(), owner(m.start()), "publishes", m[2] or m[3], m[1]))
    else:
        for m in _SELECTOR.finditer(text):
            own = next((n for s, n in types if s > m.start()), None)
            if own:
                out.append((m.start(), own, "selector", m[1], "component"))
        for t in re.finditer(r"\btemplate\s*:\s*`([^`]*)`", text):
            own = next((n for s, n in types if s > t.start()), path)
            out += [(t.start(1) + m.start(), own, "renders", m[1], "inline") for m in _TAG.finditer(t[1])]
    return out


def relation_sites(files: DataFrame) -> DataFrame:
    """Sites of every file (repo, rel_path, blob_sha, content)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(s, r, *x) for s, r, p, c in zip(pdf["blob_sha"], pdf["repo"], pdf["rel_path"], pdf["content"], strict=True) for x in sites(p, c or "")]
            yield pd.DataFrame(rows, columns=[f.split()[0] for f in SITES.split(", ")])

    return files.select("blob_sha", "repo", "rel_path", "content").mapInPandas(run, SITES)


def type_definitions(files: DataFrame) -> DataFrame:
    """repo, blob_sha, name, keyword of every type."""
    pattern = r"\b(class|interface|struct|record|enum)\s+(\w+)"
    hits = files.filter(F.rlike("rel_path", F.lit(r"\.(cs|tsx?)$")))
    zipped = F.arrays_zip(F.regexp_extract_all("content", F.lit(pattern), 1).alias("keyword"), F.regexp_extract_all("content", F.lit(pattern), 2).alias("name"))
    return hits.select("repo", "blob_sha", F.explode(zipped).alias("t")).select("repo", "blob_sha", F.col("t.name").alias("name"), F.col("t.keyword").alias("keyword")).distinct()


def _tiered(found: DataFrame, types: DataFrame) -> DataFrame:
    """src, dst, type, tier, evidence of sites whose target is a type's name."""
    defs = types.select(F.col("name").alias("target"), F.col("repo").alias("target_repo"), F.col("blob_sha").alias("target_blob"), F.col("keyword").alias("declared"))
    own = F.sum(F.when(F.col("repo") == F.col("target_repo"), 1).otherwise(0)).over(Window.partitionBy("repo", "blob_sha", "at", "source", "relation", "target"))
    met = found.join(defs, "target").withColumn("own", own)
    # what a type was declared as overrides the guess from its name
    kind = F.when(F.col("relation").isin("extends", "implements"), F.when((F.col("declared") == "interface") & (F.col("keyword") != "interface"), "implements").otherwise("extends")).otherwise(F.col("relation"))
    kind = F.when(F.col("keyword") == "registration", F.lit("implements")).otherwise(kind)
    tier = F.when((F.col("own") == 1) & (F.col("repo") == F.col("target_repo")), 2).otherwise(1)
    return met.select(F.col("source").alias("src"), F.col("target").alias("dst"), kind.alias("type"), tier.alias("tier"), F.concat_ws(":", "blob_sha", F.col("at").cast("string")).alias("evidence"))


def relation_edges(files: DataFrame) -> DataFrame:
    """Edges (src, dst, type, tier, evidence) of all passes over files."""
    found, types = relation_sites(files), type_definitions(files)
    plain = _tiered(found.filter(F.col("relation").isin("extends", "implements", "injects", "publishes", "consumes")), types)
    sets = found.filter("relation = 'set'").select("repo", F.col("source").alias("property"), F.col("target").alias("entity")).distinct()
    alone = sets.groupBy("repo", "property").agg(F.count(F.lit(1)).alias("n"), F.first("entity").alias("entity")).filter("n = 1")  # an ambiguous property leads nowhere
    access = found.filter("relation = 'access'").join(alone.select(F.col("repo").alias("r2"), "property", "entity"), (F.col("repo") == F.col("r2")) & (F.col("target") == F.col("property")))
    queries = access.select(F.col("source").alias("src"), F.col("entity").alias("dst"), F.lit("queries").alias("type"), F.lit(2).alias("tier"), F.concat_ws(":", "blob_sha", F.col("at").cast("string")).alias("evidence"))
    owners = found.filter("relation = 'selector'").select(F.col("repo").alias("r2"), F.col("source").alias("component"), F.col("target").alias("selector")).distinct()
    many = F.count(F.lit(1)).over(Window.partitionBy("repo", "blob_sha", "at"))
    tags = found.filter("relation = 'renders'").join(owners, F.col("target") == F.col("selector")).withColumn("many", many)
    renders = tags.select(F.col("source").alias("src"), F.col("component").alias("dst"), F.lit("renders").alias("type"), F.when((F.col("many") == 1) & (F.col("repo") == F.col("r2")), 2).otherwise(1).alias("tier"), F.concat_ws(":", "blob_sha", F.col("at").cast("string")).alias("evidence"))
    return plain.unionByName(queries).unionByName(renders)


def containment(found: DataFrame) -> DataFrame:
    """contains_method edges: each function in the innermost type around it. found: symbols (blob_sha, name, kind, start, body_end, role)."""
    defs = found.filter("role = 'definition'")
    types = defs.filter("kind = 'type'").select(F.col("blob_sha").alias("b2"), F.col("name").alias("owner"), F.col("start").alias("s2"), F.col("body_end").alias("e2"))
    met = defs.filter("kind = 'func'").join(types, (F.col("blob_sha") == F.col("b2")) & (F.col("s2") <= F.col("start")) & (F.col("start") < F.col("e2")))
    inner = F.row_number().over(Window.partitionBy("blob_sha", "start").orderBy(F.col("e2") - F.col("s2")))
    return met.withColumn("rn", inner).filter("rn = 1").select(F.col("owner").alias("src"), F.col("name").alias("dst"), F.lit("contains_method").alias("type"), F.lit(4).alias("tier"), F.concat_ws(":", "blob_sha", F.col("start").cast("string")).alias("evidence"))


_CLOSING = {"(": ")", "[": "]", "<": ">"}


def _blanks(code: str, at: int) -> int:
    """The first place from `at` on that is no blank."""
    while at < len(code) and code[at] in " \t":
        at += 1
    return at


def _past_list(code: str, at: int, brackets: str) -> int:
    """What follows the bracketed list that begins at `at`; `at` itself where none of these brackets opens, or closes on its line."""
    opening, depth = code[at : at + 1], 0
    if not opening or opening not in brackets:
        return at
    for i in range(at, len(code)):
        c = code[i]
        if c in "\n;{}" or (opening == "<" and c in "()"):
            return at
        depth += (c == opening) - (c == _CLOSING[opening])
        if not depth:
            return i + 1
    return at


def _token_before(code: str, at: int) -> str:
    """The word, or else the mark, that ends before `at`, with any white space between."""
    end = at
    while end and code[end - 1].isspace():
        end -= 1
    begin = end
    while begin and (code[begin - 1].isalnum() or code[begin - 1] == "_"):
        begin -= 1
    return code[begin:end] if begin < end else code[end - 1 : end]


def _imports(line: str) -> bool:
    words = line.split()
    if not words:
        return False
    if words[0].rstrip("(\"'") == "import" or words[0] == "from" and "import" in words[2:]:
        return True
    return words[0] == "using" and line.rstrip().endswith(";") and not set(line) & set("(={")


def verify_use(path: str, text: str, name: str, at: int, code: str | None = None) -> str:
    """What the occurrence of a name at a character offset is: import, call, type, identifier, or masked (in a comment or string).

    Decided by the tokens that stand around the name. code: the masked text, if it is at hand.
    """
    code, ext = mask(text) if code is None else code, path.rpartition(".")[2].lower()
    begin, end = text.rfind("\n", 0, at) + 1, text.find("\n", at)
    if _imports(text[begin : end if end >= 0 else len(text)]):
        return "import"
    stop = at + len(name)
    if code[at:stop] != name:
        return "masked"
    before, mark = _token_before(code, at), code[_blanks(code, stop) : _blanks(code, stop) + 1]
    arguments = _blanks(code, _past_list(code, _blanks(code, stop), "[<"))
    if code[arguments : arguments + 1] == "(" and before not in ("new", "func", "class"):
        return "call"
    if ext in ("cs", "ts", "tsx"):
        if before in ("new", "is", "as", ":", "<", ","):
            return "type"
        # a declaration: the type, its arguments, an array, a mark of null, then the declared name
        i = _past_list(code, stop, "<")
        if code[i : i + 2] == "[]":
            i += 2
        i += code[i : i + 1] == "?"
        declared = _blanks(code, i)
        if declared > i and (code[declared : declared + 1].isalpha() or code[declared : declared + 1] == "_"):
            return "type"
    if ext == "go" and (mark == "{" or before in ("*", "]", "chan", ".")):
        return "type"
    return "identifier"


def verified_uses(files: DataFrame, names: DataFrame) -> DataFrame:
    """blob_sha, name, at, use, tier of every occurrence of the names (name): Pattern where a language's pattern confirms it.

    Names are exploded from the text's identifiers and joined, so only wanted ones meet; texts stay where they are read.
    """
    from pyspark.sql.types import LongType, StringType, StructField, StructType

    out = StructType([StructField("blob_sha", StringType()), StructField("name", StringType()), StructField("at", LongType()), StructField("use", StringType()), StructField("tier", LongType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for sha, path, text, wanted in zip(pdf["blob_sha"], pdf["rel_path"], pdf["content"], pdf["names"], strict=True):
                code, wanted = mask(text), set(wanted)
                for m in re.finditer(r"[^\W\d]\w*", text):
                    if m[0] in wanted:
                        use = verify_use(path, text, m[0], m.start(), code)
                        if use != "masked":
                            rows.append((sha, m[0], m.start(), use, 1 if use == "identifier" else 2))
            yield pd.DataFrame(rows, columns=["blob_sha", "name", "at", "use", "tier"])

    words = files.select("blob_sha", F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(r"([\p{L}_][\p{L}\p{Nd}_]*)"), 1))).alias("name"))
    met = words.join(names.select("name").distinct(), "name").groupBy("blob_sha").agg(F.collect_list("name").alias("names"))
    return files.dropDuplicates(["blob_sha"]).join(met, "blob_sha").select("blob_sha", "rel_path", "content", "names").mapInPandas(run, out)
