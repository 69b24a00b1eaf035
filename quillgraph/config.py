"""Workspace configuration: defaults, then the user's file, then the workspace's.

Scalars override if they are set, excludes add up, contexts and namespaces merge by key.
"""

from __future__ import annotations

import os
import tomllib
from dataclasses import dataclass, field, replace

FOLDER, NAME = ".quillgraph", "config.toml"

#: What indexing skips by default.
DEFAULT_EXCLUDE = [".git", FOLDER, "node_modules", "vendor", "*.pdf", "*.csv", "*.png", "*.jpg", "*.jpeg", "*.gif", "*.svg"]

TEMPLATE = """# Results of a query when the caller names no number
top_n = 5

# "table", "json" or "paths"
format = "table"

# Globs that indexing skips, added to the built-in ones
exclude = [".git", "node_modules", "vendor", "*.pdf", "*.csv"]

# Named folders for --ctx
# [contexts.work]
# root = "projects/work"

# Namespaces by path prefix
# [namespaces]
# team = ["projects/team"]

# Embeddings for hybrid search; QUILLGRAPH_EMBED_KEY overrides api_key
# [embed]
# provider = "openai"
# api_key = ""
# base_url = ""
"""


class ConfigError(ValueError):
    pass


@dataclass(frozen=True)
class Embed:
    provider: str = ""
    api_key: str = ""
    base_url: str = ""


@dataclass(frozen=True)
class Config:
    top_n: int = 5
    format: str = "table"
    exclude: tuple[str, ...] = tuple(DEFAULT_EXCLUDE)
    contexts: dict[str, str] = field(default_factory=dict)
    namespaces: dict[str, list[str]] = field(default_factory=dict)
    embed: Embed = Embed()


@dataclass(frozen=True)
class Workspace:
    root: str
    config: Config


def merged(config: Config, path: str) -> Config:
    """`config` overridden by a TOML file; a missing file changes nothing, a bad one raises."""
    if not os.path.exists(path):
        return config
    try:
        with open(path, "rb") as f:
            said = tomllib.load(f)
    except (tomllib.TOMLDecodeError, OSError) as e:
        raise ConfigError(f"{path}: {e}") from e
    embed = said.get("embed", {})
    return Config(
        top_n=said.get("top_n") or config.top_n,
        format=said.get("format") or config.format,
        exclude=tuple(dict.fromkeys([*config.exclude, *said.get("exclude", [])])),
        contexts=config.contexts | {k: v.get("root", "") for k, v in said.get("contexts", {}).items()},
        namespaces=config.namespaces | said.get("namespaces", {}),
        embed=replace(config.embed, **{k: embed[k] for k in ("provider", "api_key", "base_url") if embed.get(k)}),
    )


def find_root(start: str) -> str:
    """The nearest folder at or above `start` that holds the workspace folder."""
    at = os.path.abspath(start)
    while not os.path.isdir(os.path.join(at, FOLDER)):
        up = os.path.dirname(at)
        if up == at:
            raise ConfigError("no workspace here or above")
        at = up
    return at


def load(start: str) -> Workspace:
    root = find_root(start)
    home = os.environ.get("XDG_CONFIG_HOME") or os.path.join(os.path.expanduser("~"), ".config")
    config = merged(Config(), os.path.join(home, "quillgraph", NAME))
    return Workspace(root, merged(config, os.path.join(root, FOLDER, NAME)))


def load_or_default(start: str) -> Workspace:
    """Any error, a bad file too, gives the defaults at `start`."""
    try:
        return load(start)
    except ConfigError:
        return Workspace(os.path.abspath(start), Config())


def scaffold(folder: str) -> str:
    """Writes the template; raises FileExistsError if there is a configuration."""
    path = os.path.join(folder, FOLDER, NAME)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "x", encoding="utf-8") as f:
        f.write(TEMPLATE)
    return path


def context_prefix(workspace: Workspace, name: str) -> str:
    """A context's folder relative to the root; `.` means everywhere."""
    if name not in workspace.config.contexts:
        raise ConfigError(f"unknown context: {name}")
    root = workspace.config.contexts[name].strip("/")
    return "" if root in ("", ".") else root
