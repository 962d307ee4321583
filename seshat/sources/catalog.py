"""Vaults and the scopes that queries ask for. Small, and kept on the driver."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field
from pathlib import Path


@dataclass(frozen=True)
class Vault:
    vault_id: str
    root_path: str
    display_name: str = ""
    enabled: bool = True
    content_scopes: tuple[str, ...] = field(default=("wiki", "raw", "docs", "scratch"))

    def __post_init__(self) -> None:
        if not self.vault_id.strip() or not self.root_path.strip():
            raise ValueError("a vault has an id and a root")


class Catalog:
    """Vaults by id, in a JSON file."""

    def __init__(self, vaults: tuple[Vault, ...] = ()):
        if len({v.vault_id for v in vaults}) < len(vaults):
            raise ValueError("two vaults have one id")
        self.vaults = vaults

    @classmethod
    def load(cls, path: str) -> Catalog:
        rows = json.loads(Path(path).read_text())
        return cls(tuple(Vault(**r | {"content_scopes": tuple(r["content_scopes"])}) for r in rows))

    def save(self, path: str) -> None:
        Path(path).write_text(json.dumps([asdict(v) for v in self.vaults], indent=1, sort_keys=True))

    def resolve(self, vault_ids: tuple[str, ...] = (), scopes: tuple[str, ...] = ()) -> dict[str, tuple[str, ...]]:
        """For each enabled vault asked for, its scopes: of a wanted and a registered one that contain each other,
        the narrower. No ids or no scopes ask for all."""
        inside = lambda a, b: a == b or a.startswith(f"{b}/")
        out = {}
        for v in self.vaults:
            if v.enabled and (not vault_ids or v.vault_id in vault_ids):
                own = v.content_scopes
                pairs = [a if inside(a, b) else b for a in scopes for b in own if inside(a, b) or inside(b, a)] if scopes else own
                if pairs:
                    out[v.vault_id] = tuple(dict.fromkeys(pairs))
        unknown = set(vault_ids) - {v.vault_id for v in self.vaults}
        if unknown:
            raise ValueError(f"unknown vaults: {sorted(unknown)}")
        return out


@dataclass(frozen=True)
class Repository:
    repository_id: str
    root_path: str
    include: tuple[str, ...] = ("**/*.py",)
    exclude: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        if not self.repository_id.strip() or not self.root_path.strip():
            raise ValueError("a repository has an id and a root")


@dataclass(frozen=True)
class Binding:
    """Ties a repository to vaults, and evidence of code to evidence of the vaults."""

    project_id: str
    repository_id: str
    vault_ids: tuple[str, ...]
    mappings: tuple[tuple[str, str], ...] = ()


class Projects:
    """Repositories and bindings, in a JSON file. Changes give a new catalog; ``save`` writes it."""

    def __init__(self, repositories: tuple[Repository, ...] = (), bindings: tuple[Binding, ...] = ()):
        ids = {r.repository_id for r in repositories}
        if len(ids) < len(repositories) or len({b.project_id for b in bindings}) < len(bindings):
            raise ValueError("two repositories, or two bindings, have one id")
        if unknown := {b.repository_id for b in bindings} - ids:
            raise ValueError(f"bindings of unknown repositories: {sorted(unknown)}")
        self.repositories, self.bindings = repositories, bindings

    @classmethod
    def load(cls, path: str) -> Projects:
        data = json.loads(Path(path).read_text())
        repositories = (Repository(r["repository_id"], r["root_path"], tuple(r["include"]), tuple(r["exclude"])) for r in data["repositories"])
        return cls(tuple(repositories), tuple(Binding(b["project_id"], b["repository_id"], tuple(b["vault_ids"]), tuple(map(tuple, b["mappings"]))) for b in data["bindings"]))

    def save(self, path: str) -> None:
        Path(path).write_text(json.dumps({"repositories": [asdict(r) for r in self.repositories], "bindings": [asdict(b) for b in self.bindings]}, indent=1, sort_keys=True))

    def add(self, repository: Repository) -> Projects:
        return Projects((*self.repositories, repository), self.bindings)

    def remove(self, repository_id: str) -> Projects:
        """Without the repository; an unknown one, or one that a binding names, is an error."""
        if repository_id not in {r.repository_id for r in self.repositories}:
            raise ValueError(f"unknown repository: {repository_id}")
        return Projects(tuple(r for r in self.repositories if r.repository_id != repository_id), self.bindings)

    def bind(self, binding: Binding) -> Projects:
        return Projects(self.repositories, (*(b for b in self.bindings if b.project_id != binding.project_id), binding))

    def resolve(self, project_id: str) -> tuple[Repository, Binding]:
        binding = next((b for b in self.bindings if b.project_id == project_id), None)
        if binding is None:
            raise ValueError(f"unknown project: {project_id}")
        return next(r for r in self.repositories if r.repository_id == binding.repository_id), binding
