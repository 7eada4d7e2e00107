"""Settings of ingest and search: a JSON document with overrides from QUARRY_* environment variables."""

from __future__ import annotations

import dataclasses
import json
import os
from dataclasses import dataclass, field

# The extensions that are indexed by default, and those of the presets that these lack.
EXTENSIONS = "pdf docx doc xlsx xls pptx ppt odt rtf jpeg jpg png tiff heic heif zip 7z rar tar gz eml msg pst epub mobi azw3 md json xml txt csv tsv rs py js ts go java c cpp h hpp cs html css".split() + ["log", "svg"]
EXCLUDE_PATTERNS = [".git/", "node_modules/", "target/", "AppData/", "*.tmp", "*.temp", "Thumbs.db", ".DS_Store"]
EXCLUDE_FOLDERS = ["$RECYCLE.BIN", "System Volume Information"]


@dataclass
class Settings:
    roots: list[str] = field(default_factory=list)
    exclude_patterns: list[str] = field(default_factory=lambda: list(EXCLUDE_PATTERNS))
    exclude_folders: list[str] = field(default_factory=lambda: list(EXCLUDE_FOLDERS))
    custom_extensions: str = ""
    size_limit_mb: int = 100
    max_depth: int = 20
    use_gitignore: bool = True
    include_hidden: bool = False
    max_results: int = 50
    case_sensitive: bool = False
    whole_word: bool = False
    fuzzy: bool = True

    def allowed_extensions(self) -> list[str]:
        own = (x.strip().lstrip(".").lower() for x in self.custom_extensions.split(","))
        return sorted({*EXTENSIONS, *(x for x in own if x)})

    def excludes(self) -> list[str]:
        return list(dict.fromkeys([*self.exclude_patterns, *self.exclude_folders]))


def load(path: str) -> Settings:
    """Reads settings; unknown keys are ignored, a missing or broken file means defaults; QUARRY_<NAME> overrides."""
    try:
        with open(path) as f:
            raw = json.load(f)
    except (OSError, ValueError):
        raw = {}
    known = {f.name: f for f in dataclasses.fields(Settings)}
    out = Settings(**{k: v for k, v in raw.items() if k in known}) if isinstance(raw, dict) else Settings()
    for name in known:
        if (v := os.environ.get(f"QUARRY_{name.upper()}")) is not None:
            now = getattr(out, name)
            setattr(out, name, v.lower() in ("1", "true", "yes") if isinstance(now, bool) else int(v) if isinstance(now, int) else [x for x in v.split(os.pathsep) if x] if isinstance(now, list) else v)
    return out


def save(settings: Settings, path: str) -> None:
    """Writes beside and renames, so that readers never see half a file."""
    tmp = f"{path}.tmp"
    with open(tmp, "w") as f:
        json.dump(dataclasses.asdict(settings), f, indent=2)
    os.replace(tmp, path)
