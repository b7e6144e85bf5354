"""The dataset registry: base addresses, graph roles, identity minting."""

from __future__ import annotations

import json
import os
import re
from dataclasses import dataclass, field
from pathlib import Path

ROLES = {
    "tbox": "tbox/ontology", "rules_forward": "tbox/rules/forward", "rules_backward": "tbox/rules/backward", "bindings": "tbox/bindings",
    "asserted": "abox/asserted", "inferred": "abox/inferred", "normalization": "normalization", "provenance": "provenance", "health": "health",
}


@dataclass
class Dataset:
    """ontology, forward, backward, bindings: Turtle files; mappings: a mapping file; base: overrides the registry's."""

    id: str
    base: str = ""
    ontology: list[str] = field(default_factory=list)
    forward: list[str] = field(default_factory=list)
    backward: list[str] = field(default_factory=list)
    bindings: list[str] = field(default_factory=list)
    mappings: str = ""
    unique: tuple[str, ...] = ()
    dialect: str = "spark"  # of the database that holds the mapped tables
    tables: dict[str, str] = field(default_factory=dict)  # names in the mappings to names in that database
    tables_file: str = ""  # descriptions of external tables


@dataclass
class Manifest:
    base: str
    namespace: str
    datasets: dict[str, Dataset]
    segments: dict[str, str] = field(default_factory=lambda: {"entity": "entity", "document": "document", "graph": "graph"})

    @classmethod
    def load(cls, path: str) -> Manifest:
        """From JSON, with ${NAME} and ${NAME:default} taken from the environment."""
        text = re.sub(r"\$\{(\w+)(?::([^}]*))?\}", lambda m: os.environ.get(m[1], m[2] or ""), Path(path).read_text())
        raw = json.loads(text)
        sets = {d["id"]: Dataset(**{k: tuple(v) if k == "unique" else v for k, v in d.items()}) for d in raw["datasets"]}
        return cls(raw["base"].rstrip("/"), raw["namespace"], sets, raw.get("segments") or cls.__dataclass_fields__["segments"].default_factory())

    def base_of(self, dataset: str) -> str:
        return (self.datasets[dataset].base or self.base).rstrip("/")

    def mint(self, dataset: str, segment: str, name: str) -> str:
        return f"{self.base_of(dataset)}/{self.segments[segment]}/{name}"

    def graph(self, dataset: str, role: str) -> str:
        return f"{self.base_of(dataset)}/{self.segments['graph']}/{dataset}/{ROLES[role]}"
