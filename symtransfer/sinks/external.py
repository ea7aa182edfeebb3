"""External decompilers: a registry of command lines, run with a time limit."""

from __future__ import annotations

import os
import shutil
import subprocess
import tempfile
from collections.abc import Callable
from dataclasses import dataclass
from pathlib import Path


@dataclass(frozen=True)
class Tool:
    """arguments: (input, output folder, options) -> what follows the program."""

    name: str
    jar: str
    main: str
    arguments: Callable[[str, str, dict[str, str]], list[str]]


def _options(prefix: str, joint: str):
    return lambda options: [x for k, v in options.items() for x in ([f"{prefix}{k}{joint}{v}"] if joint != " " else [f"{prefix}{k}", v])]


_REGISTRY: dict[str, Tool] = {}


def register(tool: Tool) -> None:
    _REGISTRY[tool.name.lower()] = tool


def available() -> list[str]:
    return sorted(_REGISTRY)


def get(name: str | None = None) -> Tool:
    """A tool by name; the default for none. ValueError for an unknown one."""
    found = _REGISTRY.get((name or "cfr").lower())
    if found is None:
        raise ValueError(f"unknown tool {name}; there are {', '.join(available())}")
    return found


register(Tool("cfr", "cfr.jar", "org.benf.cfr.reader.Main", lambda i, o, x: [i, "--outputdir", o, *_options("--", " ")(x)]))
register(Tool("fernflower", "fernflower.jar", "org.jetbrains.java.decompiler.main.decompiler.ConsoleDecompiler", lambda i, o, x: [*_options("-", "=")(x), i, o]))
register(Tool("vineflower", "vineflower.jar", "org.jetbrains.java.decompiler.main.decompiler.ConsoleDecompiler", lambda i, o, x: [*_options("--", "=")(x), i, o]))


def locate(jar: str, folders: list[str], class_path: str | None = None) -> str | None:
    """The tool's archive: by exact name in the folders and in ./lib, then by a name that has the tool's name in it there, then on the class path.

    class_path: entries as Java takes them; the environment's CLASSPATH by default.
    """
    places = [Path(f) for f in [*folders, "lib"]]
    part = Path(jar).stem.lower()
    for p in places:
        if (p / jar).is_file():
            return str(p / jar)
    for p in places:
        if p.is_dir():
            for x in sorted(p.iterdir()):
                if x.is_file() and x.suffix.lower() == ".jar" and part in x.name.lower():
                    return str(x)
    for x in (os.environ.get("CLASSPATH", "") if class_path is None else class_path).split(os.pathsep):
        if x.lower().endswith(".jar") and part in Path(x).name.lower() and Path(x).is_file():
            return x
    return None


def clean(folder: str) -> None:
    """Empties a folder, only if it lies strictly below the working or the temporary folder."""
    path = Path(folder).resolve()
    if not any(root != path and root in path.parents for root in (Path.cwd().resolve(), Path(tempfile.gettempdir()).resolve())):
        raise ValueError(f"refusing to empty {path}")
    shutil.rmtree(path, ignore_errors=True)
    path.mkdir(parents=True)


def run_tool(command: list[str], source: str, output: str, arguments: Callable[[str, str, dict], list[str]], options: dict[str, str] | None = None, timeout_s: float = 900) -> list[str]:
    """Runs a tool over a file and returns the files it wrote. TimeoutError past the limit, RuntimeError for an exit code."""
    if not Path(source).is_file():
        raise OSError(f"not a regular file: {source}")
    clean(output)
    try:
        done = subprocess.run([*command, *arguments(source, output, options or {})], stdout=subprocess.PIPE, stderr=subprocess.STDOUT, timeout=timeout_s, check=False)
    except subprocess.TimeoutExpired as e:
        raise TimeoutError(f"{command[0]} took more than {timeout_s} s") from e
    if done.returncode:
        raise RuntimeError(f"{command[0]} ended with {done.returncode}: {done.stdout.decode(errors='replace')[-500:]}")
    return sorted(str(p) for p in Path(output).rglob("*") if p.is_file())


def decompile(tool: Tool, jar_folders: list[str], source: str, output: str, options: dict[str, str] | None = None, timeout_s: float = 900, heap: str = "1g") -> list[str]:
    """In a process of its own with its own heap and nothing but the tool on its class path."""
    jar = locate(tool.jar, jar_folders)
    if jar is None:
        raise FileNotFoundError(f"{tool.jar} is in none of {jar_folders}")
    return run_tool(["java", f"-Xmx{heap}", "-cp", jar, tool.main], source, output, tool.arguments, options, timeout_s)


def review_source(command: list[str], source: str, arguments: Callable[[str, str, dict], list[str]], timeout_s: float = 300) -> str:
    """The first source file that a tool makes of one class; empty if it fails."""
    with tempfile.TemporaryDirectory() as folder:
        try:
            files = run_tool(command, source, f"{folder}/out", arguments, timeout_s=timeout_s)
        except (OSError, RuntimeError):
            return ""
        first = next((f for f in files if f.endswith(".java")), None)
        return Path(first).read_text(errors="replace") if first else ""
