"""Workspace detection from manifests. All of it runs on the driver: manifests are small."""

from __future__ import annotations

import glob
import json
import os
import re
from dataclasses import dataclass, field


@dataclass
class Package:
    name: str
    path: str
    version: str = ""


@dataclass
class Workspace:
    workspace_type: str = "standalone"
    package_manager: str = ""
    packages: list[Package] = field(default_factory=list)
    aliases: dict[str, str] = field(default_factory=dict)
    tsconfig_paths: dict[str, str] = field(default_factory=dict)


def _read(*parts: str) -> str | None:
    try:
        with open(os.path.join(*parts), encoding="utf-8") as f:
            return f.read()
    except OSError:
        return None


def _json(text: str | None) -> dict:
    try:
        got = json.loads(text) if text else {}
        return got if isinstance(got, dict) else {}
    except ValueError:
        return {}


def strip_comments(text: str) -> str:
    """JSON without // and /* */ comments and trailing commas; strings stay as they are."""
    text = re.sub(r'("(?:\\.|[^"\\])*")|//[^\n]*|/\*.*?\*/', lambda m: m[1] or "", text, flags=re.S)
    return re.sub(r'("(?:\\.|[^"\\])*")|,(?=\s*[}\]])', lambda m: m[1] or "", text)


def package_manager(root: str) -> str:
    found = [("pnpm-lock.yaml", "pnpm"), ("pnpm-workspace.yaml", "pnpm"), ("yarn.lock", "yarn"), ("package-lock.json", "npm")]
    return next((name for file, name in found if os.path.exists(os.path.join(root, file))), "")


def pnpm_globs(text: str) -> list[str]:
    """The items of `packages:` of a pnpm-workspace.yaml."""
    out, on = [], False
    for line in text.splitlines():
        if re.match(r"packages\s*:", line):
            on = True
        elif on and (m := re.match(r"\s*-\s*['\"]?([^'\"#]+?)['\"]?\s*(?:#.*)?$", line)):
            out.append(m[1])
        elif on and line.strip() and not line.lstrip().startswith("#"):
            on = False
    return out


def workspace_globs(root: str) -> list[str]:
    pnpm = _read(root, "pnpm-workspace.yaml")
    if pnpm is not None and (found := pnpm_globs(pnpm)):
        return found
    w = _json(_read(root, "package.json")).get("workspaces")
    if isinstance(w, dict):
        w = w.get("packages")
    if isinstance(w, list) and w:
        return [x for x in w if isinstance(x, str)]
    lerna = _read(root, "lerna.json")
    return [x for x in _json(lerna).get("packages", ["packages/*"]) if isinstance(x, str)] if lerna is not None else []


def expand_globs(root: str, globs: list[str]) -> list[str]:
    """The directories that the globs name; those after ! do not count."""
    def dirs(pattern: str) -> set[str]:
        hits = glob.glob(os.path.join(glob.escape(root), pattern.rstrip("/")), recursive=True)
        return {os.path.relpath(h, root) for h in hits if os.path.isdir(h) and "node_modules" not in h.split(os.sep)}

    yes = set().union(*(dirs(g) for g in globs if not g.startswith("!"))) if globs else set()
    return sorted(yes - set().union(*(dirs(g[1:]) for g in globs if g.startswith("!"))) if yes else yes)


def tsconfig_paths(root: str, directory: str = ".", file: str = "tsconfig.json", depth: int = 0) -> dict[str, str]:
    """Path aliases of a tsconfig and of those it extends (ten at most; its own win): first targets, relative to the root, without stars."""
    text = _read(root, directory, file)
    if text is None or depth > 10:
        return {}
    cfg = _json(strip_comments(text))
    out: dict[str, str] = {}
    parents = cfg.get("extends") or []
    for parent in [parents] if isinstance(parents, str) else parents:
        p = parent if parent.endswith(".json") else parent + ".json"
        if parent.startswith("."):
            full = os.path.normpath(os.path.join(directory, p))
            out |= tsconfig_paths(root, os.path.dirname(full) or ".", os.path.basename(full), depth + 1)
    options = cfg.get("compilerOptions") or {}
    base = options.get("baseUrl") or "."
    for alias, targets in (options.get("paths") or {}).items():
        if targets:
            out[alias.removesuffix("*").rstrip("/")] = os.path.normpath(os.path.join(directory, base, targets[0].removesuffix("*")))
    return out


def detect_node(root: str) -> Workspace | None:
    text = _read(root, "package.json")
    if text is None:
        return None
    out = Workspace(package_manager=package_manager(root), tsconfig_paths=tsconfig_paths(root))
    found = expand_globs(root, workspace_globs(root))
    out.workspace_type = "monorepo" if workspace_globs(root) else "standalone"
    for d in found or ["."]:
        m = _json(_read(root, d, "package.json"))
        if not m and d != ".":
            continue
        name = m.get("name") or os.path.basename(os.path.abspath(os.path.join(root, d)))
        out.packages.append(Package(name, d, m.get("version") or ""))
        out.aliases[name] = os.path.normpath(os.path.join(d, m.get("main") or "")) if m.get("main") else d
        if d != ".":
            out.tsconfig_paths = tsconfig_paths(root, d) | out.tsconfig_paths  # the root's win
    return out


def go_module(text: str) -> str:
    m = re.search(r"^\s*module\s+(?:\"([^\"]+)\"|(\S+))", text, re.M)
    return (m[1] or m[2]) if m else ""


def go_uses(text: str) -> list[str]:
    """The directories of a go.work's use directives."""
    text = re.sub(r"//[^\n]*", "", text)
    out = []
    for m in re.finditer(r"^\s*use\s*(?:\(([^)]*)\)|(\S+))", text, re.M):
        out += m[1].split() if m[1] is not None else [m[2]]
    return [os.path.normpath(x.strip('"')) for x in out]


def detect_go(root: str) -> Workspace | None:
    work, mod = _read(root, "go.work"), _read(root, "go.mod")
    if work is not None:
        out = Workspace("monorepo", "go")
        for d in go_uses(work):
            name = go_module(_read(root, d, "go.mod") or "")
            if name:
                out.packages.append(Package(name, d))
                out.aliases[name] = d
        return out
    if mod is None:
        return None
    name = go_module(mod)
    return Workspace("standalone", "go", [Package(name, ".")], {name: "."})


#: Tried in order; the first that answers decides. Others may be put in.
DETECTORS = [detect_node, detect_go]


def detect_workspace(root: str) -> Workspace:
    for f in DETECTORS:
        if (found := f(root)) is not None:
            return found
    return Workspace(packages=[Package(os.path.basename(os.path.abspath(root)), ".")])
