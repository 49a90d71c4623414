"""Reaction schemes and parameter files, read on the driver."""

from __future__ import annotations

import json
import os
import re
import tomllib


def _json(text_or_path: str) -> dict:
    try:
        return json.loads(text_or_path)
    except json.JSONDecodeError:
        with open(text_or_path) as f:
            return json.load(f)


def load_named(text_or_path: str) -> dict:
    """The named reactions of a scheme file."""
    return _json(text_or_path).get("Named_Reactions", {})


def save_scheme(text_or_path: str, name: str, scheme: dict, path: str) -> None:
    """Writes a scheme file again with one scheme put in or replaced; all others stay as they are. The file appears whole or not at all."""
    schemes = _json(text_or_path) | {name: scheme}
    _checked(schemes[name])
    with open(f"{path}.new", "w") as f:
        json.dump(schemes, f, indent=4)
    os.replace(f"{path}.new", path)


def _checked(scheme: dict) -> None:
    for step in scheme["steps"]:
        if not isinstance(step["Rxns"], dict) or not 1 <= len(step["Reactants"]) <= 2:
            raise ValueError(f"no step: {step}")


def load_scheme(text_or_path: str, name: str) -> tuple[list, list | None]:
    """(steps, reactants) of a named scheme in JSON text or a JSON file; an unknown name raises KeyError."""
    scheme = _json(text_or_path)[name]
    return [(s["Reactants"], {c: [r] if isinstance(r, str) else r for c, r in s["Rxns"].items()}) for s in scheme["steps"]], scheme.get("reactants")


def named_reactions(*sources: dict) -> dict[str, list[str]]:
    """Name to reactions; later sources win."""
    out: dict[str, list[str]] = {}
    for s in sources:
        out |= {k: [v] if isinstance(v, str) else list(v) for k, v in s.items()}
    return out


def load_reaction_table(toml_text: str) -> list[tuple[str, str, str]]:
    """(type, subtype, smarts) rows of a reaction database in TOML."""
    return [(kind, sub, x["smarts"]) for kind, subs in tomllib.loads(toml_text).items() for sub, x in subs.items()]


def parameters(given: dict, file: dict | None, defaults: dict) -> dict:
    """Given values win over the file's, and these over the defaults, which count only beside a file."""
    return ((defaults | file) if file is not None else {}) | {k: v for k, v in given.items() if v is not None}


def parameter_file(text: str) -> dict:
    """`key: value` lines of a parameter file, without nesting: numbers, true and false, quoted or plain text; # starts a note at
    the line's start or behind white space, and stands for itself within quotes."""
    out: dict = {}
    for line in text.splitlines():
        if line.lstrip().startswith("#"):
            continue
        key, colon, value = line.partition(":")
        if colon and key.strip():
            quoted = re.match(r"""\s*(["'])(.*?)\1\s*(#.*)?$""", value)
            value = quoted[2] if quoted else re.split(r"(?:^|\s)#", value)[0].strip()
            try:
                out[key.strip()] = json.loads(value.lower() if value.lower() in ("true", "false", "null") else value)
            except json.JSONDecodeError:
                out[key.strip()] = value or None
    return out


def import_scheme(name: str, toml_text: str) -> dict:
    """A scheme of the TOML dialect in the JSON form: {Named_Reactions, name: {steps}}.

    Reactant bbN becomes r(N - 1); others become CN in the first step and p later; a step has two reactants, None if one
    is missing. What a step defines besides reactants and reactions is a named reaction; a name that is taken gets a number.
    """
    named, steps = {}, []
    for step in tomllib.loads(toml_text)["reactions"].values():
        reactions = list(step["reactions"])
        for key, value in step.items():
            if key in ("reactants", "reactions"):
                continue
            free = next(k for k in [key, *(f"{key}_{i}" for i in range(1, len(named) + 2))] if k not in named)
            named[free] = value
            reactions = [free if r == key else r for r in reactions]
        other = "p" if steps else "CN"
        reactants = [f"r{int(r[2:]) - 1}" if r[:2] == "bb" and r[2:].isdigit() else other for r in step["reactants"]]
        steps.append({"Reactants": reactants + ["None"] * (2 - len(reactants)), "Rxns": {"default": reactions}})
    return {"Named_Reactions": named, name: {"steps": steps}}
