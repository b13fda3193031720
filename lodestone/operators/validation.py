"""What a payload has to look like, limits of a message, the intent of a command, and small grammars."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions.encoding import OutOfDomain, canonical_json
from lodestone.functions.shapes import DIGEST, INSTANT, Shape, anything, array, chosen, closed, digest, dotted_name, first_fault, identifier, instant, integer, integer_of, member, named_texts, one_of, string_of, text
from lodestone.plans.packet import carries_credentials

COMPLETENESS = one_of("complete", "partial", "unknown")
SUBJECT = closed({"kind": dotted_name, "id": identifier})
EVIDENCE = closed({"provider": identifier, "artifact": SUBJECT, "digest": digest})
CLAIM = closed({"provider": identifier, "claim": SUBJECT, "revision": integer(1), "digest": digest})


def _after(*names: str, at: str) -> Shape:
    """The first instant lies before the second, where both are there."""
    return lambda x, path: F.when(string_of(member(x, names[0])) >= string_of(member(x, names[1])), F.concat(path, F.lit(at)))


# evidence


def _descriptor_rule(x: Column, path: Column) -> Column:
    terminal = (string_of(member(x, "source", "kind")) == "terminal_output") & (string_of(member(x, "coverage", "completeness")) == "complete")
    return F.coalesce(
        F.when(terminal, F.concat(path, F.lit("/coverage/completeness"))),
        F.when(carries_credentials(F.coalesce(string_of(member(x, "locator")), F.lit(""))), F.concat(path, F.lit("/locator"))),
    )


SOME = text(1, 1 << 20)
UNCERTAINTY = closed({"not_before": instant, "not_after": instant}, rule=lambda x, path: F.when(string_of(member(x, "not_before")) > string_of(member(x, "not_after")), path))
DESCRIPTOR = closed(
    {
        "digest": digest, "size": integer(0), "media_type": SOME, "producer": closed({}, {"principal": SOME, "producer_id": anything}), "source": closed({"kind": SOME, "id": SOME}), "scope": SOME,
        "capture": closed({"captured_at": instant}, {"uncertainty": UNCERTAINTY, "anchors": anything}), "coverage": closed({"completeness": COMPLETENESS}, {"covered": anything, "gaps": anything}), "retention_class": SOME,
    },
    {"work": closed({"kind": SOME, "id": SOME}), "locator": SOME}, _descriptor_rule,
)


def descriptor_fault(payload: Column, principal: Column) -> Column:
    """The first path at fault of an upload's descriptor. The producer is always who sends it; output of a terminal never covers all;
    a locator carries no credentials."""
    named = string_of(member(F.try_parse_json(payload), "producer", "principal"))
    return F.coalesce(first_fault(payload, DESCRIPTOR), F.when(named != principal, "/payload/producer/principal"))


# claims


def _roots_rule(x: Column, path: Column) -> Column:
    """Unknown ancestry has no roots, any other has one at least."""
    n = F.size(F.try_variant_get(member(x, "roots"), "$", "array<variant>"))
    return F.when((string_of(member(x, "completeness")) == "unknown") != (n == 0), F.concat(path, F.lit("/roots")))


REPOSITORY = closed({"id": identifier, "tree": SOME}, {"dirty": closed({"snapshot_digest": digest}), "commit": SOME})
BASIS = closed({"repositories": array(REPOSITORY, 32), "completeness": COMPLETENESS}, {"environment": digest, "build": digest, "workspace": anything, "configuration": anything})
SUPPORT = closed({"support_id": identifier, "evidence": EVIDENCE, "ancestry": closed({"completeness": COMPLETENESS, "roots": array(anything, 32)}, rule=_roots_rule)})
CONDITION = closed({"condition_id": identifier, "kind": SOME, "expected": anything}, {"repository": identifier})
CLAIM_MEMBERS = (
    {
        "plane": one_of("normative", "observed", "interpretive"),
        "statement": closed({"subject": SUBJECT, "predicate": text(1, 128), "value": anything, "cardinality": one_of("single", "multiple", "unknown")}),
        "scope": closed({"id": identifier, "qualifiers": named_texts(32, 64, 256)}), "support": array(SUPPORT, 64, unique="support_id"),
        "derivation": closed({"kind": one_of("deterministic", "model_assisted", "human"), "inputs": array(EVIDENCE, 32)}, {"record": EVIDENCE}),
    },
    {
        "validity": closed({}, {"from": instant, "until": instant}, _after("from", "until", at="")), "basis": BASIS, "dependencies": array(CLAIM, 32), "conditions": array(CONDITION, 32, unique="condition_id"),
        "health": one_of("passing", "failing", "unknown"),
    },
)


def _health_rule(x: Column, path: Column) -> Column:
    """Only what is observed has health."""
    return F.when(member(x, "health").isNotNull() & (string_of(member(x, "plane")) != "observed"), F.concat(path, F.lit("/health")))


PROPOSE = closed(*CLAIM_MEMBERS, _health_rule)
REVISE = closed(CLAIM_MEMBERS[0] | {"supersedes": CLAIM}, CLAIM_MEMBERS[1], _health_rule)


def claim_fault(payload: Column, revise: bool = False) -> Column:
    return first_fault(payload, REVISE if revise else PROPOSE)


def revision_refusals(current: Column, current_digest: Column, supersedes: Column, supersedes_digest: Column) -> Column:
    """Why a revision cannot follow: it names the current revision by number and digest, or it is stale."""
    return F.when(current.isNull(), "unknown_claim").when((supersedes != current) | (supersedes_digest != current_digest), "stale_revision")


# requests


def _item_rule(x: Column, path: Column) -> Column:
    """Only what is required before a transition names one."""
    before = string_of(member(x, "obligation")) == "required_before_transition"
    return F.when(before != member(x, "transition").isNotNull(), F.concat(path, F.lit("/transition")))


CHECK = chosen("kind", {
    "source_included": closed({"kind": anything, "repository": text(1, 128), "path": text(1, 1024)}), "evidence_included": closed({"kind": anything, "evidence": EVIDENCE}),
    "authority_content_included": closed({"kind": anything}), "claim_included": closed({"kind": anything, "claim": CLAIM}),
})
ITEM = closed(
    {
        "item_id": identifier, "selector": closed({"kind": text(1, 64), "value": text(1, 512)}), "obligation": one_of("required", "required_before_transition", "advisory"),
        "reliance": one_of("binding", "evidence", "hypothesis", "reference"), "selected_by": identifier, "check": CHECK,
    },
    {"transition": text(1, 128)}, _item_rule,
)
LIMITS = closed({"deadline": instant, "output_capacity": closed({"unit": one_of("bytes"), "amount": integer(1)})}, {"max_requests": integer(0), "spend": anything})
SUBMIT = closed(
    {"consumer": closed({"task": text(1, 256), "principal": identifier}, {"executor": identifier}), "basis": BASIS, "items": array(ITEM, 256, least=1, unique="item_id"), "limits": LIMITS},
    {
        "fallback": one_of("proceed_with_gap", "wait_until_deadline"), "authority_content": array(closed({"item_id": identifier, "evidence": EVIDENCE, "authority_revision": integer(0)}), 256),
        "origin": closed({"initiator": SUBJECT, "depth": integer(0), "call_budget": integer(0)}),
    },
)


def submit_fault(payload: Column) -> Column:
    return first_fault(payload, SUBMIT)


# facts, grammars, sizes

FACTS = closed({"format": SOME, "facts": array(closed({"name": SOME, "class": one_of("environment", "build"), "value": SOME}), 1 << 16)})


def facts(payload: Column) -> Column:
    """(name, class, value) of each environment fact; null where the text is not shaped so."""
    return F.when(first_fault(payload, FACTS, "").isNull(), F.from_json(payload, "facts array<struct<name: string, class: string, value: string>>")["facts"])


def is_instant(value: Column) -> Column:
    return value.rlike(INSTANT)


def is_digest(value: Column) -> Column:
    return value.rlike(DIGEST)


def ids_outside_grammar(ids: Column) -> Column:
    """Of an array of identifiers those that keep a packet from being published: outside the grammar or there twice; sorted, each once."""
    odd = F.filter(ids, lambda i: ~i.rlike(r"^[A-Za-z0-9][A-Za-z0-9._:~-]{0,127}$"))
    twice = F.filter(ids, lambda i: F.size(F.filter(ids, lambda j: j == i)) > 1)
    return F.array_sort(F.array_distinct(F.concat(odd, twice)))


OVERHEAD = 2048


def chunk_limit(max_payload: Column, max_frame: Column, max_string: Column) -> Column:
    """Most bytes of a chunk whose base64 fits the payload and the frame, less what stands around it, and the string limit: a multiple of three."""
    room = F.greatest(F.least(max_payload - OVERHEAD, max_frame - OVERHEAD, max_string), F.lit(0))
    return F.floor(room / 4) * 3


LIMIT_NAMES = ("max_depth", "max_array_items", "max_string_bytes", "max_payload_bytes")


def _limit_broken(body: str, limits: tuple[int, ...]) -> str | None:
    try:
        value = json.loads(body)
    except ValueError:
        return None
    depth, items, strings = 0, 0, 0
    stack = [(value, 1)]
    while stack:
        x, level = stack.pop()
        if isinstance(x, dict):
            depth = max(depth, level)
            strings = max([strings, *(len(k.encode()) for k in x)])
            stack += [(v, level + 1) for v in x.values()]
        elif isinstance(x, list):
            depth, items = max(depth, level), max(items, len(x))
            stack += [(v, level + 1) for v in x]
        elif isinstance(x, str):
            strings = max(strings, len(x.encode()))
    payload = value.get("payload") if isinstance(value, dict) else None
    size = 0 if payload is None else len((canonical_json(json.dumps(payload)) or "").encode())
    return next((n for n, have, most in zip(LIMIT_NAMES, (depth, items, strings, size), limits) if have > most), None)


def limit_broken(body: Column, max_depth: int = 32, max_array_items: int = 4096, max_string_bytes: int = 1 << 16, max_payload_bytes: int = 1 << 18) -> Column:
    """Which limit a JSON message exceeds: of several the first in the order depth, items, string, payload. SQL cannot walk JSON of any depth."""
    limits = (max_depth, max_array_items, max_string_bytes, max_payload_bytes)

    def each(s: pd.Series) -> pd.Series:
        return s.map(lambda x: _limit_broken(x, limits), na_action="ignore")

    return F.pandas_udf(each, "string")(body)


INTENT = ("operation", "subject", "preconditions", "requires", "payload")


def _intent(body: str) -> str | None:
    try:
        envelope = json.loads(body)
        needs, extensions = envelope["requires"], envelope.get("extensions", {})
        if len(set(needs)) < len(needs) or not isinstance(extensions, dict):
            return None
        kept = {k: envelope[k] for k in INTENT} | {"extensions": {k: extensions[k] for k in needs if "/" in k}}
    except (ValueError, KeyError, TypeError, AttributeError, OutOfDomain):
        return None
    return canonical_json(json.dumps(kept))


def command_intent(body: Column) -> Column:
    """What makes a command the same command, in canonical form: five members and the extensions it requires; null for a malformed one."""
    return F.pandas_udf(lambda s: s.map(_intent, na_action="ignore"), "string")(body)


def admissible(value: Column) -> Column:
    """Whether an integer stands for itself in JSON everywhere."""
    return F.abs(integer_of(value)) < (1 << 53)
