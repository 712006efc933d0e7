"""Options of the engine, from the environment or given, and the paths that follow."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Settings:
    data_dir: str = "./data"
    default_recipe: str = "vector_only"
    embedding_dims: int = 1536
    api_url: str = ""
    user_agent: str = "quarry"
    categories: str = "Characters,Story,Factions,Locations,Lore"
    category_depth: int = 2
    batch_size: int = 50

    @classmethod
    def from_env(cls, prefix: str = "QUARRY_", env: dict | None = None) -> Settings:
        """Fields that the environment names, cast to their kinds; others keep their defaults."""
        env = os.environ if env is None else env
        given = {f.name: env[prefix + f.name.upper()] for f in fields(cls) if prefix + f.name.upper() in env}
        return cls(**{k: int(v) if isinstance(getattr(cls, k), int) else v for k, v in given.items()})

    @property
    def store(self) -> str:
        return f"{self.data_dir.rstrip('/')}/store"

    @property
    def fixtures(self) -> str:
        return f"{self.data_dir.rstrip('/')}/fixtures"

    @property
    def recipes(self) -> str:
        return f"{self.data_dir.rstrip('/')}/recipes"

    @property
    def reports(self) -> str:
        return f"{self.data_dir.rstrip('/')}/reports"

    def gold(self, name: str) -> str:
        """The file of a gold set: a bare name or one that ends in .jsonl, no path."""
        stem = name.removesuffix(".jsonl")
        if not stem or "." in stem or "/" in stem or "\\" in stem:
            raise ValueError("a gold set is given by its name alone")
        return f"{self.data_dir.rstrip('/')}/gold/{stem}.jsonl"

    def category_list(self) -> list[str]:
        return [c.strip() for c in self.categories.split(",") if c.strip()]
