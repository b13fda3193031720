"""Canonical JSON and redaction of credentials: text rules that SQL functions cannot tell."""

from __future__ import annotations

import json
import re
from urllib.parse import unquote_to_bytes

#: What replaces a credential, names whose values are credentials, vendors' prefixes, rounds of percent-decoding.
REDACTED, UNSETTLED = "[redacted]", "[redacted: encoding did not settle]"
SECRET_NAMES = "token key keyid sig signature password passwd secret credential auth authorization session".split()
SECRET_PREFIXES = "sk- sk_ ghp_ gho_ github_pat_ xoxb- xoxp- AKIA".split()
PREFIX_RUN, ROUNDS = 16, 5
SAFE_INT = (1 << 53) - 1

_NAME = rf"(?i:(?<![\w.-])[\w.-]*(?:{'|'.join(SECRET_NAMES)}))"
RULES = [
    (re.compile(r"\bBearer (?!\[redacted\])[\w\-.~+/=]+"), f"Bearer {REDACTED}"),
    (re.compile(rf"({_NAME}=)([\"']?)(?!\[redacted\])[^\s&\"'<>#;]+"), rf"\1\2{REDACTED}"),
    (re.compile(rf"({_NAME}[\"']?\s*:\s*)([\"']?)(?!\[redacted\]|Bearer\b|//)[^\s\"'<>,;}}]+"), rf"\1\2{REDACTED}"),
    (re.compile(rf"(?:{'|'.join(map(re.escape, SECRET_PREFIXES))})[\w-]{{{PREFIX_RUN},}}"), REDACTED),
    (re.compile(r"\beyJ[\w-]+\.[\w-]+\.[\w-]+"), REDACTED),
]
_SECRET = re.compile(rf"(?i)(?:{'|'.join(SECRET_NAMES)})\Z")
_URL = re.compile(r"(?i)://|%(?:25)?3A%(?:25)?2F%(?:25)?2F")


class OutOfDomain(ValueError):
    """Not one of the six kinds of value, or a name that occurs twice."""


def _members(pairs: list) -> dict:
    if len({k for k, _ in pairs}) < len(pairs):
        raise OutOfDomain("a name occurs twice")
    return dict(sorted(pairs, key=lambda kv: kv[0].encode("utf-16-be")))


def _number(text: str) -> int:
    n = int(text)
    if abs(n) > SAFE_INT:
        raise OutOfDomain(text)
    return n


def _no_float(text: str):
    raise OutOfDomain(text)


def canonical_json(text: str) -> str | None:
    """The canonical form: names in order of their UTF-16 units, no spaces, integers only; None for other text."""
    try:
        value = json.loads(text, object_pairs_hook=_members, parse_int=_number, parse_float=_no_float, parse_constant=_no_float)
        out = json.dumps(value, ensure_ascii=False, separators=(",", ":"))
        out.encode()  # lone surrogates have no bytes
        return out
    except (ValueError, RecursionError):
        return None


def _plain(text: str) -> str:
    for pattern, by in RULES:
        text = pattern.sub(by, text)
    return text


def _value(text: str) -> str:
    """A decoded string; one shaped like a URL is judged percent-decoded too, until that settles."""
    if not _URL.search(text):
        return _plain(text)
    settled = text
    for _ in range(ROUNDS + 1):
        after = unquote_to_bytes(settled).decode(errors="replace")
        if after == settled:
            cut = _plain(settled)
            return cut if cut != settled else _plain(text)
        settled = after
    return UNSETTLED


def _walk(value):
    if isinstance(value, str):
        return _value(value)
    if isinstance(value, list):
        return [_walk(x) for x in value]
    if isinstance(value, dict):
        return {_value(k): REDACTED if isinstance(v, str) and _SECRET.search(k) else _walk(v) for k, v in value.items()}
    return value


def redact(text: str) -> str:
    """The text without what its surroundings show to be a credential; JSON is judged by its decoded strings."""
    try:
        value = json.loads(text)
    except (ValueError, RecursionError):
        return _plain(text)
    return json.dumps(_walk(value), ensure_ascii=False, separators=(",", ":"))
