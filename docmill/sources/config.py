"""Source configurations from YAML."""

from __future__ import annotations

from dataclasses import dataclass, field

import yaml
from pyspark.sql import DataFrame, SparkSession

from docmill.sources.files import exists, read_text


@dataclass
class Adapter:
    type: str
    config: dict = field(default_factory=dict)


@dataclass
class Source:
    id: str
    root: str
    name: str = ""
    description: str = ""
    include_globs: list[str] = field(default_factory=lambda: ["**/*.md"])
    exclude_globs: list[str] = field(default_factory=list)
    entrypoints: list[str] = field(default_factory=list)
    tags: list[str] = field(default_factory=list)
    adapters: list[Adapter] = field(default_factory=lambda: [Adapter("markdown")])
    type: str = "documentation"

    def problems(self, spark: SparkSession) -> list[str]:
        """What is wrong with this source; nothing if it can be indexed."""
        return [say for bad, say in (
            (not self.id, "Source 'id' is required"),
            (not exists(spark, self.root), f"Source root does not exist: {self.root}"),
            (not self.include_globs, "At least one 'include_globs' pattern is required"),
        ) if bad]


def adapters_of(entry: dict) -> list[Adapter]:
    """Adapters of a source's YAML entry: names or mappings; else the older single ``adapter``; else markdown."""
    given = [Adapter(a) if isinstance(a, str) else Adapter(a.get("type", "markdown"), dict(a.get("config") or {})) for a in entry.get("adapters") or [] if isinstance(a, str | dict)]
    old = entry.get("adapter")
    if not given and old:
        given = [Adapter(old, {"default_category": entry.get("default_category", "")} if old == "component" else {})]
    return given or [Adapter("markdown")]


def load_sources(spark: SparkSession, path: str) -> list[Source]:
    """The sources of a YAML file, in order. Raises for a missing file and at the first source with a problem."""
    if not exists(spark, path):
        raise FileNotFoundError(f"no source configuration at {path}")
    out = []
    for entry in (yaml.safe_load(read_text(spark, path)) or {}).get("sources") or []:
        plain = {k: entry[k] for k in ("description", "include_globs", "exclude_globs", "entrypoints", "tags", "type") if entry.get(k) is not None}
        source = Source(id=entry["id"], root=str(entry["root"]), name=entry.get("name", entry["id"]), adapters=adapters_of(entry), **plain)
        if found := source.problems(spark):
            raise ValueError(f"Invalid source '{source.id}': {found}")
        out.append(source)
    return out


def sources_table(spark: SparkSession, sources: list[Source]) -> DataFrame:
    rows = [(s.id, s.name, s.description, s.root, [a.type for a in s.adapters], s.tags, s.type) for s in sources]
    return spark.createDataFrame(rows, "id string, name string, description string, root string, adapters array<string>, tags array<string>, type string")
