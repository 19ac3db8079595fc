"""Settings by section and key: defaults, then a JSON file, then the command line."""

from __future__ import annotations

import argparse
import json

DEFAULTS: dict[str, dict[str, object]] = {
    "transcriber": {"model": "large-v2", "beam-size": 5, "compute-type": "int8"},
    "diarizer": {"segment-length": 300},
    "speaker": {"gold-folder": None, "threshold": 0.3},
    "book": {"chapter-names": []},
    "splitter": {"model": None},
    "entities": {"labels": ["EMAIL", "NUMBER", "URL", "PHONE"]},
    "summary": {"chunk-size": 15000, "overlap": 200, "max-tokens": 4096, "temperature": None},
}


def merged(*layers: dict, defaults: dict | None = None) -> dict[str, dict[str, object]]:
    """Defaults overlaid by each layer in turn. A layer may add keys to a known section; an unknown section is ignored."""
    out = {s: dict(v) for s, v in (defaults or DEFAULTS).items()}
    for layer in layers:
        for section, values in layer.items():
            if section in out:
                out[section] |= values
    return out


def registered(defaults: dict) -> dict:
    """Check a set of sections: names hold no underscore, since flags join section and key by one."""
    for section, keys in defaults.items():
        for name in (section, *keys):
            if "_" in name:
                raise ValueError(f"underscore in {name}")
    return defaults


def parser(defaults: dict | None = None) -> argparse.ArgumentParser:
    """Flags --section_key for every setting."""
    p = argparse.ArgumentParser(prog="tessera")
    p.add_argument("-i", "--input", nargs="+", default=[])
    p.add_argument("-o", "--output", default="out")
    p.add_argument("-c", "--config")
    p.add_argument("--input-recursive", action="store_true")
    p.add_argument("--output-zip", action="store_true")
    p.add_argument("--keep-uncompressed", action="store_true")
    p.add_argument("--export-config", action="store_true")
    for section, keys in registered(defaults or DEFAULTS).items():
        for key, value in keys.items():
            kind = type(value) if isinstance(value, (int, float, str)) else str
            many = {"nargs": "*"} if isinstance(value, list) else {}
            p.add_argument(f"--{section}_{key}", type=kind, default=None, **many)
    return p


def parsed(argv: list[str]) -> tuple[argparse.Namespace, dict]:
    """(arguments, settings): the command line counts over the file, the file over the defaults."""
    args = parser().parse_args(argv)
    flags: dict[str, dict] = {}
    for section, keys in DEFAULTS.items():
        for key in keys:
            value = getattr(args, f"{section}_{key}".replace("-", "_"))
            if value is not None:
                flags.setdefault(section, {})[key] = value
    stored = {}
    if args.config:
        with open(args.config) as f:
            stored = json.load(f)
    return args, merged(stored, flags)
