"""Dependency manifests: kinds, names, parsers, and resolving requirements to providers."""

from __future__ import annotations

import re
import tomllib
from xml.etree import ElementTree

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

VENDORED = r"(^|/)(vendor|node_modules|third_party|packages|bower_components)/"
#: Fixed: file names of manifests and their ecosystem.
KINDS = (("go", r"(^|/)go\.mod$"), ("npm", r"(^|/)package\.json$"), ("pypi", r"(^|/)(requirements[\w.-]*\.txt|pyproject\.toml)$"), ("nuget", r"\.csproj$"))


def kind_of(path: Column) -> Column:
    out = F.when(F.rlike(path, F.lit(VENDORED)), F.lit(None).cast("string"))
    for kind, pattern in KINDS:
        out = out.when(F.rlike(path, F.lit(pattern)), kind)
    return out


def normalised_name(ecosystem: Column, name: Column) -> Column:
    """NuGet and npm names in lower case; PyPI names with runs of -, _ and . as one hyphen too; Go paths as they are."""
    return F.when(ecosystem == "pypi", F.lower(F.regexp_replace(F.trim(name), "[-_.]+", "-"))).when(ecosystem.isin("nuget", "npm"), F.lower(F.trim(name))).otherwise(F.trim(name))


def parse(kind: str, text: str) -> list[dict]:
    """name, version, dev, indirect of each requirement, and provides of the manifest itself."""
    out: list[dict] = []
    need = lambda name, version="", dev=False, indirect=False: out.append({"name": name, "version": version, "dev": dev, "indirect": indirect, "provides": False})
    give = lambda name: out.append({"name": name, "version": "", "dev": False, "indirect": False, "provides": True})
    if kind == "go":
        block = False
        for line in text.splitlines():
            code, _, note = line.partition("//")
            words = code.split()
            if words[:1] == ["module"] and len(words) > 1:
                give(words[1])
            elif words[:2] == ["require", "("]:
                block = True
            elif words == [")"]:
                block = False
            elif words[:1] == ["require"] and len(words) >= 3:
                need(words[1], words[2], indirect="indirect" in note)
            elif block and len(words) >= 2:
                need(words[0], words[1], indirect="indirect" in note)
    elif kind == "npm":
        import json

        data = json.loads(text)
        if data.get("name"):
            give(data["name"])
        for part in ("dependencies", "devDependencies", "peerDependencies", "optionalDependencies"):
            for name, version in (data.get(part) or {}).items():
                need(name, str(version), dev=part == "devDependencies")
    elif kind == "nuget":
        root = ElementTree.fromstring(text)
        for e in root.iter():
            tag = e.tag.rpartition("}")[2]
            if tag in ("PackageReference", "ProjectReference") and e.get("Include"):
                need(e.get("Include"), e.get("Version") or next((c.text or "" for c in e if c.tag.endswith("Version")), ""))
            elif tag in ("PackageId", "AssemblyName") and e.text:
                give(e.text)
    elif text.lstrip().startswith("[") or "[project]" in text or "[tool." in text:
        data = tomllib.loads(text)
        project = data.get("project", {})
        if project.get("name"):
            give(project["name"])
        for spec in project.get("dependencies", []):
            need(*_requirement(spec))
        for extra in (project.get("optional-dependencies") or {}).values():
            for spec in extra:
                need(*_requirement(spec), dev=True)
    else:
        for line in text.splitlines():
            if (line := line.split("#")[0].strip()) and not line.startswith("-"):
                need(*_requirement(line))
    return out


def _requirement(spec: str) -> tuple[str, str]:
    m = re.match(r"\s*([A-Za-z0-9][\w.-]*)\s*(?:\[[^\]]*\])?\s*([^;]*)", spec)
    return (m[1], m[2].strip()) if m else (spec.strip(), "")


def resolve(declares: DataFrame, provides: DataFrame) -> DataFrame:
    """repo, name, provider_repo, confidence of requirements (repo, ecosystem, name) met by another repository.

    Names are equal when normalised; a Go path is met by its longest prefix at a slash. A provider in the repository
    itself takes the edge away. One provider is sure (1.0), several are contested (0.9).
    """
    parts = F.split("name", "/")
    prefixes = F.when(F.col("ecosystem") == "go", F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).otherwise(F.array(normalised_name(F.col("ecosystem"), F.col("name"))))
    need = declares.select("repo", "ecosystem", "name").distinct().withColumn("key", F.explode(prefixes))
    have = provides.select(F.col("repo").alias("provider_repo"), "ecosystem", normalised_name(F.col("ecosystem"), F.col("name")).alias("key")).distinct()
    met = need.join(have, ["ecosystem", "key"])
    longest = F.max(F.length("key")).over(Window.partitionBy("repo", "ecosystem", "name"))
    met = met.withColumn("longest", longest).filter(F.length("key") == F.col("longest"))
    own = F.max(F.when(F.col("provider_repo") == F.col("repo"), 1).otherwise(0)).over(Window.partitionBy("repo", "ecosystem", "name"))
    many = F.count(F.lit(1)).over(Window.partitionBy("repo", "ecosystem", "name"))
    return met.withColumn("own", own).withColumn("many", many).filter("own = 0").select("repo", "ecosystem", "name", "provider_repo", F.when(F.col("many") == 1, 1.0).otherwise(0.9).alias("confidence"))
