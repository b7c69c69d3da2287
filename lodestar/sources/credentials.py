"""Credentials for sources: kinds, a store, and matching by address. Driver-side only."""

from __future__ import annotations

from dataclasses import dataclass, field
from pathlib import Path


@dataclass(frozen=True)
class Credential:
    iri: str
    kind: str
    values: tuple[tuple[str, str], ...] = field(repr=False)  # logs and plans don't show them


#: Kinds and the fields that tell them, the most specific first; others are of the base kind.
KINDS = {"oauth1": ("consumer_token", "consumer_secret", "access_token", "access_secret"), "oauth2": ("access_token",), "certificate": ("cert_path",), "user_pwd": ("username", "password"), "token": ("token",)}
BASE = "base"


def infer(iri: str, values: dict[str, str]) -> Credential:
    kind = next((k for k, need in KINDS.items() if all(f in values for f in need)), BASE)
    return Credential(iri, kind, tuple(sorted(values.items())))


def load(path: str) -> list[Credential]:
    import yaml

    with open(path, encoding="utf-8") as f:
        return [infer(k, v) for k, v in (yaml.safe_load(f) or {}).items() if isinstance(v, dict)]


def dump(credentials: list[Credential], path: str) -> None:
    import yaml

    Path(path).parent.mkdir(parents=True, exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        yaml.safe_dump({c.iri: dict(c.values) for c in credentials}, f, allow_unicode=True)


def find(iri: str, stored: list[str], exact: bool = False) -> str:
    """Equal, else the longest inside iri, else the shortest around it."""
    if iri in stored:
        return iri
    if not exact:
        if inside := [k for k in stored if k in iri]:
            return max(inside, key=len)
        if around := [k for k in stored if iri in k]:
            return min(around, key=len)
    raise KeyError(f"no credential for {iri!r}")


class Vault:
    """Credentials of YAML files (a later file's replace an earlier one's) and those added in memory, which replace both."""

    def __init__(self, *files: str):
        self.files, self.added = files, {}

    def add(self, credential: Credential) -> Vault:
        self.added[credential.iri] = credential
        return self

    def in_files(self) -> dict[str, Credential]:
        """Files that aren't there count as empty; a broken one raises its error."""
        return {c.iri: c for f in self.files if Path(f).exists() for c in load(f)}

    def get(self, iri: str, exact: bool = False) -> Credential:
        known = self.in_files() | self.added
        return known[find(iri, list(known), exact)]

    def save(self, path: str | None = None) -> None:
        """Merge what was added into the file, or into each of the vault's own."""
        for f in [path] if path else self.files:
            before = {c.iri: c for c in load(f)} if Path(f).exists() else {}
            dump(list((before | self.added).values()), f)
