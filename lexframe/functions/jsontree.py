"""Reading and canonicalising JSON of any depth, without recursion where it is too deep for it."""

from __future__ import annotations

import json
import re
import sys
from json.decoder import scanstring

if hasattr(sys, "set_int_max_str_digits"):
    sys.set_int_max_str_digits(0)  # long numbers are data here, not an attack on int()

_SPACE = re.compile(r"[ \t\n\r]*")
_NUMBER = re.compile(r"-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][-+]?\d+)?", re.ASCII)
_WORDS = {"true": True, "false": False, "null": None}


def _strict(word: str) -> None:
    raise ValueError(f"{word} is no JSON")


def _number(text: str) -> int | float:
    return float(text) if any(c in text for c in ".eE") else int(text)


_decoder = json.JSONDecoder(parse_constant=_strict)


def _iterative(s: str) -> object:
    """The value of JSON text nested too deeply for the recursive decoder."""
    i, n = _SPACE.match(s, 0).end(), len(s)
    top: list = []
    stack: list[tuple] = [(top, None)]  # container and, within an object, the key that waits for its value
    while True:
        holder, key = stack[-1]
        c = s[i : i + 1]
        if c in ("{", "["):
            new: dict | list = {} if c == "{" else []
            i = _SPACE.match(s, i + 1).end()
            if s[i : i + 1] == ("}" if c == "{" else "]"):
                value, i = new, i + 1
            else:
                if c == "{":
                    key2, i = _key(s, i)
                    stack.append((new, key2))
                else:
                    stack.append((new, None))
                continue
        elif c == '"':
            value, i = scanstring(s, i + 1, True)
        elif m := _NUMBER.match(s, i):
            value, i = _number(m[0]), m.end()
        else:
            word = next((w for w in _WORDS if s.startswith(w, i)), None)
            if word is None:
                raise ValueError(f"no value at {i}")
            value, i = _WORDS[word], i + len(word)
        while True:  # store the value; close what ends after it
            if isinstance(holder, dict):
                holder[key] = value
            else:
                holder.append(value)
            i = _SPACE.match(s, i).end()
            if holder is top:
                if i != n:
                    raise ValueError(f"more text at {i}")
                return value
            c = s[i : i + 1]
            if c == ",":
                i = _SPACE.match(s, i + 1).end()
                if isinstance(holder, dict):
                    key, i = _key(s, i)
                    stack[-1] = (holder, key)
                break
            if c != ("}" if isinstance(holder, dict) else "]"):
                raise ValueError(f"no end at {i}")
            value, i = holder, i + 1
            stack.pop()
            holder, key = stack[-1]


def _key(s: str, i: int) -> tuple[str, int]:
    if s[i : i + 1] != '"':
        raise ValueError(f"no key at {i}")
    key, i = scanstring(s, i + 1, True)
    i = _SPACE.match(s, i).end()
    if s[i : i + 1] != ":":
        raise ValueError(f"no colon at {i}")
    return key, _SPACE.match(s, i + 1).end()


def loads(text: str | None) -> object:
    """The value of strict JSON text (of equal keys the last counts); None if it can't be read."""
    if text is None:
        return None
    try:
        return _decoder.decode(text)
    except RecursionError:
        try:
            return _iterative(text)
        except ValueError:
            return None
    except ValueError:
        return None


_encoder = json.JSONEncoder(sort_keys=True, separators=(",", ":"), ensure_ascii=True)


def canonical(value: object) -> str:
    """JSON text that is equal for equal values: sorted keys, no spaces, ASCII."""
    try:
        return _encoder.encode(value)
    except RecursionError:
        out: list[str] = []
        stack: list = [(value,)]
        while stack:
            x = stack.pop()
            if isinstance(x, str):
                out.append(x)
                continue
            v = x[0]
            if isinstance(v, dict):
                parts: list = ["{"]
                for n, k in enumerate(sorted(v)):
                    parts += ["," * (n > 0) + json.dumps(k) + ":", (v[k],)]
                stack += reversed([*parts, "}"])
            elif isinstance(v, list):
                parts = ["["]
                for n, e in enumerate(v):
                    parts += ["," * (n > 0), (e,)]
                stack += reversed([*parts, "]"])
            else:
                out.append(json.dumps(v))
        return "".join(out)
