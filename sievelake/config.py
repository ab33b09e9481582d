"""Settings from the environment."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, fields

from sievelake.operators.ingest import IngestRules


def parse_list(value: "str | list[str] | None") -> list[str]:
    """A list as it is, a JSON array, or items between commas; blanks dropped."""
    if value is None:
        return []
    if isinstance(value, str):
        text = value.strip()
        value = json.loads(text) if text.startswith("[") else text.split(",")
    return [str(x).strip() for x in value if str(x).strip()]


@dataclass(frozen=True)
class Settings:
    """Each field is read from SIEVELAKE_ and its name in capitals; what is not set keeps its default."""

    store: str = "postings"
    sources: tuple[str, ...] = ()
    max_experience_years: int = 3
    max_age_days: int = 45
    min_description_chars: int = 60
    include_internships: bool = True
    stale_days: int = 21
    age_out_days: int = 60
    purge_days: int = 60
    purge_expired_days: int = 3

    @property
    def rules(self) -> IngestRules:
        return IngestRules(self.max_experience_years, self.max_age_days, self.min_description_chars, self.include_internships)


def load(env: "dict[str, str] | None" = None) -> Settings:
    env = os.environ if env is None else env
    found: dict = {}
    for f in fields(Settings):
        value = env.get(f"SIEVELAKE_{f.name.upper()}")
        if value is None:
            continue
        if f.name == "sources":
            found[f.name] = tuple(parse_list(value))
        elif f.type == "bool":
            found[f.name] = value.strip().lower() in ("1", "true", "yes", "on")
        else:
            found[f.name] = int(value) if f.type == "int" else value
    return Settings(**found)
