"""Parameterised query scripts: a comment preamble declares inputs, arguments bind them."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

TYPES = {"str": str, "string": str, "float": float, "f64": float, "int": int, "i64": int, "bool": bool}
_LINE = re.compile(r"^\s*--\s*@([\w-]+)\s*:?\s*(.*)$")


@dataclass
class Input:
    name: str
    required: bool = True
    type: str = "str"
    default: str | None = None
    about: str = ""


@dataclass
class Script:
    text: str
    about: dict = field(default_factory=dict)
    inputs: list[Input] = field(default_factory=list)
    outputs: list[str] = field(default_factory=list)


def parse_input(rest: str) -> Input:
    """``name [required|optional] [type] [default] ["description"]``."""
    quoted = re.search(r'"([^"]*)"\s*$', rest)
    about = quoted[1] if quoted else ""
    words = (rest[: quoted.start()] if quoted else rest).split()
    out = Input(words[0].lstrip("$"), about=about)
    words = words[1:]
    if words and words[0] in ("required", "optional"):
        out.required = words.pop(0) == "required"
    if words and words[0] in TYPES:
        out.type = words.pop(0)
    if words:
        out.default = words[0]
        out.required = False
    return out


def parse_script(text: str) -> Script:
    """Split off the preamble; a shebang line goes, the query stays as it is."""
    if text.startswith("#!"):
        text = "--" + text[2:]
    out = Script(text)
    for line in text.splitlines():
        if line.strip() and not line.lstrip().startswith("--"):
            break
        m = _LINE.match(line)
        if not m:
            continue
        key, rest = m[1], m[2].strip()
        if key == "input" and rest:
            out.inputs.append(parse_input(rest))
        elif key == "output":
            out.outputs.append(rest)
        else:
            out.about[key] = rest
    return out


def coerce(value: str, kind: str):
    if kind in ("bool",):
        if value.lower() not in ("true", "false", "1", "0", "yes", "no"):
            raise ValueError(f"not a bool: {value!r}")
        return value.lower() in ("true", "1", "yes")
    return TYPES[kind](value)


def guess(value: str):
    """A value for an undeclared variable: a number or bool if it reads as one."""
    for kind in (int, float):
        try:
            return kind(value)
        except ValueError:
            pass
    return {"true": True, "false": False}.get(value, value)


def bind(script: Script, given: dict[str, str]) -> dict:
    """Values of all variables: an argument, else the default, else an error if required."""
    out: dict = {}
    declared = {i.name: i for i in script.inputs}
    for i in script.inputs:
        value = given.get(i.name, i.default)
        if value is None:
            if i.required:
                raise ValueError(f"missing --{i.name}" + (f" ({i.about})" if i.about else ""))
            continue
        out[i.name] = coerce(value, i.type)
    body = "\n".join(x for x in script.text.splitlines() if not x.lstrip().startswith("--"))
    for name in dict.fromkeys(re.findall(r"\$([A-Za-z_]\w*)", body)):
        if name not in declared and name in given:
            out[name] = guess(given[name])
        elif name not in declared:
            raise ValueError(f"missing --{name}")
    return out
