"""Project configuration: checked on construction, kept as TOML."""

from __future__ import annotations

import json
import os
import re
import tomllib
import uuid
from dataclasses import asdict, dataclass, field, fields

from lodestone.errors import NavigationError

DTYPES = ("fp32", "fp16", "q8", "int8", "uint8", "q4")
SOURCE_KINDS = ("markdown-directory",)
FOLDER = ".lodestone"
CONFIG_VERSION = 1


def _check(ok: bool, message: str) -> None:
    if not ok:
        raise NavigationError("INVALID_CONFIG", message)


def _number(owner: object, name: str, low: float, high: float, whole: bool = False) -> None:
    value = getattr(owner, name)
    kinds = (int,) if whole else (int, float)
    ok = isinstance(value, kinds) and not isinstance(value, bool) and low <= value <= high
    _check(ok, f"{name} must be between {low} and {high}")


def _words(owner: object, name: str) -> None:
    values = tuple(str(value).strip() for value in getattr(owner, name))
    _check(all(values), f"{name} must not contain blank entries")
    object.__setattr__(owner, name, values)


@dataclass(frozen=True)
class EmbeddingConfig:
    provider: str = "transformers"
    model: str = "Xenova/multilingual-e5-small"
    dtype: str = "q8"
    query_prefix: str = "query: "
    document_prefix: str = "passage: "
    batch_size: int = 8
    max_tokens: int = 288

    def __post_init__(self):
        _check(bool(self.model.strip()), "model must not be blank")
        _check(self.dtype in DTYPES, f"dtype must be one of {', '.join(DTYPES)}")
        _number(self, "batch_size", 1, 128, whole=True)
        _number(self, "max_tokens", 32, 8192, whole=True)


@dataclass(frozen=True)
class ChunkingConfig:
    max_chars: int = 1800

    def __post_init__(self):
        _number(self, "max_chars", 256, 32_000, whole=True)


@dataclass(frozen=True)
class SearchConfig:
    vector_weight: float = 0.45
    keyword_weight: float = 0.55
    semantic_best_distance: float = 0.09
    semantic_weak_distance: float = 0.15
    minimum_confidence: float = 0.5
    candidate_pool: int = 100

    def __post_init__(self):
        for name in ("vector_weight", "keyword_weight", "minimum_confidence"):
            _number(self, name, 0, 1)
        for name in ("semantic_best_distance", "semantic_weak_distance"):
            _number(self, name, 0, 2)
        _number(self, "candidate_pool", 10, 500, whole=True)
        _check(self.vector_weight + self.keyword_weight > 0, "one search weight must be positive")
        _check(
            self.semantic_best_distance < self.semantic_weak_distance,
            "semantic_best_distance must be smaller than semantic_weak_distance",
        )


@dataclass(frozen=True)
class SourceConfig:
    id: str
    path: str
    include: tuple[str, ...]
    kind: str = "markdown-directory"
    exclude: tuple[str, ...] = ()
    tags: tuple[str, ...] = ()

    def __post_init__(self):
        _check(re.fullmatch(r"[a-zA-Z0-9_-]+", self.id.strip()) is not None, "invalid source id")
        _check(self.kind in SOURCE_KINDS, f"unknown source kind {self.kind}")
        _check(bool(self.path.strip()), "source path must not be blank")
        for name in ("include", "exclude", "tags"):
            _words(self, name)
        _check(len(self.include) > 0, "a source needs an include pattern")


@dataclass(frozen=True)
class ProjectConfig:
    project_id: str
    sources: tuple[SourceConfig, ...]
    version: int = CONFIG_VERSION
    embedding: EmbeddingConfig = field(default_factory=EmbeddingConfig)
    chunking: ChunkingConfig = field(default_factory=ChunkingConfig)
    search: SearchConfig = field(default_factory=SearchConfig)

    def __post_init__(self):
        _check(self.version == CONFIG_VERSION, f"version must be {CONFIG_VERSION}")
        try:
            uuid.UUID(self.project_id)
        except ValueError:
            _check(False, "project_id must be a UUID")
        _check(len(self.sources) > 0, "at least one source is required")
        ids = [source.id for source in self.sources]
        for source_id in ids:
            _check(ids.count(source_id) == 1, f"duplicate source id: {source_id}")


def default_config() -> ProjectConfig:
    whole_project = SourceConfig(
        id="project",
        path=".",
        include=("**/*.md",),
        exclude=("**/.git/**", f"**/{FOLDER}/**", "**/node_modules/**"),
    )
    return ProjectConfig(project_id=str(uuid.uuid4()), sources=(whole_project,))


def _build(kind: type, raw: dict, where: str):
    """Make a config record, refusing unknown and missing keys."""
    _check(isinstance(raw, dict), f"{where} must be a table")
    known = {entry.name for entry in fields(kind)}
    unknown = sorted(set(raw) - known)
    _check(not unknown, f"unknown keys in {where}: {', '.join(unknown)}")
    try:
        return kind(**{k: tuple(v) if isinstance(v, list) else v for k, v in raw.items()})
    except TypeError as problem:
        raise NavigationError("INVALID_CONFIG", f"{where}: {problem}") from problem


def config_from_mapping(raw: dict) -> ProjectConfig:
    raw = dict(raw)
    sections = {
        "embedding": EmbeddingConfig,
        "chunking": ChunkingConfig,
        "search": SearchConfig,
    }
    for name, kind in sections.items():
        if name in raw:
            raw[name] = _build(kind, raw[name], name)
    sources = raw.get("sources", ())
    raw["sources"] = tuple(_build(SourceConfig, entry, "sources") for entry in sources)
    return _build(ProjectConfig, raw, "config")


def _toml_value(value: object) -> str:
    if isinstance(value, (list, tuple)):
        return "[" + ", ".join(_toml_value(entry) for entry in value) + "]"
    # JSON strings, numbers and booleans are valid TOML values.
    return json.dumps(value, ensure_ascii=False)


def config_to_toml(config: ProjectConfig) -> str:
    raw = asdict(config)
    lines = [f"{name} = {_toml_value(raw[name])}" for name in ("version", "project_id")]
    for section in ("embedding", "chunking", "search"):
        lines += ["", f"[{section}]"]
        lines += [f"{name} = {_toml_value(value)}" for name, value in raw[section].items()]
    for source in raw["sources"]:
        lines += ["", "[[sources]]"]
        lines += [f"{name} = {_toml_value(value)}" for name, value in source.items()]
    return "\n".join(lines) + "\n"


def config_path(root: str) -> str:
    return os.path.join(root, FOLDER, "config.toml")


def index_path(root: str) -> str:
    return os.path.join(root, FOLDER, "index")


def read_config(root: str) -> ProjectConfig:
    try:
        with open(config_path(root), "rb") as handle:
            raw = tomllib.load(handle)
    except (OSError, tomllib.TOMLDecodeError) as problem:
        raise NavigationError("CONFIG_READ_FAILED", f"Could not read config: {problem}") from problem
    return config_from_mapping(raw)


def write_config(root: str, config: ProjectConfig) -> None:
    path = config_path(root)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path + ".tmp", "w", encoding="utf-8") as handle:
        handle.write(config_to_toml(config))
    os.replace(path + ".tmp", path)


def find_project(start: str) -> str | None:
    """Nearest folder at or above ``start`` holding a configuration."""
    here = os.path.abspath(start)
    while True:
        if os.path.exists(config_path(here)):
            return here
        parent = os.path.dirname(here)
        if parent == here:
            return None
        here = parent


def locate_project(start: str) -> str:
    found = find_project(start)
    if found is None:
        raise NavigationError("PROJECT_NOT_INITIALIZED", f"No project at or above {start}.")
    return found


def locate_for_init(start: str) -> str:
    """Configured folder, else the version-control root, else ``start`` itself."""
    found = find_project(start)
    if found is not None:
        return found
    here = os.path.abspath(start)
    while not os.path.exists(os.path.join(here, ".git")):
        parent = os.path.dirname(here)
        if parent == here:
            return os.path.abspath(start)
        here = parent
    return here


def ensure_ignored(root: str) -> bool:
    """Add the index folder to the ignore file once; tells whether it was added."""
    path = os.path.join(root, ".gitignore")
    entry = f"/{FOLDER}/"
    text = ""
    if os.path.exists(path):
        with open(path, encoding="utf-8") as handle:
            text = handle.read()
    known = {entry, entry[1:], entry[:-1], entry[1:-1]}
    if any(line.strip() in known for line in text.splitlines()):
        return False
    gap = "" if not text or text.endswith("\n") else "\n"
    with open(path, "a", encoding="utf-8") as handle:
        handle.write(f"{gap}{entry}\n")
    return True
