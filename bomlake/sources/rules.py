"""Rules that operators write as YAML: small documents, read on the driver and turned into expressions.

A document that breaks a rule of its form is refused as a whole.
"""

from __future__ import annotations

from bomlake.functions.identifiers import SEVERITIES

try:
    import yaml
except ImportError:  # an optional package; without it JSON, which is YAML too, is read
    yaml = None

#: The form that is understood, and what a path rule may do (fixed values).
VERSION = 1
ACTIONS = ("skip", "redundant_under_archive", "mark_as_noise", "mark_as_redundant")


def parsed(text: str) -> dict:
    if yaml:
        found = yaml.safe_load(text)
    else:
        import json

        found = json.loads(text)
    if not isinstance(found, dict):
        raise ValueError("the document is empty or no mapping")
    return found


def path_rules(text: str, actions: tuple[str, ...] = ACTIONS) -> list[tuple]:
    """(name, action, kind, value) for every value of every rule, in order, as images.classified() takes them."""
    document = parsed(text)
    if document.get("version") != VERSION:
        raise ValueError(f"version {document.get('version')!r} is not {VERSION}")
    out, names = [], set()
    for i, rule in enumerate(document.get("rules") or []):
        name, action, pattern = rule.get("name"), rule.get("action"), rule.get("pattern") or {}
        if not name or name in names:
            raise ValueError(f"rule {i} has no name of its own: {name!r}")
        if action not in actions:
            raise ValueError(f"rule {name!r} has an unknown action: {action!r}")
        names.add(name)
        out += [(name, action, pattern.get("type"), value) for value in pattern.get("values") or []]
    return out


def overridden(rules: list[tuple], own: list[tuple]) -> list[tuple]:
    """Rules of a known name take the place of those, others follow."""
    new: dict[str, list[tuple]] = {}
    for rule in own:
        new.setdefault(rule[0], []).append(rule)
    out, done = [], set()
    for rule in rules:
        if rule[0] not in new:
            out.append(rule)
        elif rule[0] not in done:
            done.add(rule[0])
            out += new[rule[0]]
    return out + [r for r in own if r[0] not in done]


def severity_overrides(text: str) -> list[tuple]:
    """(rule, type or '', ecosystem or '', rank), in order, as inventory.with_policy() takes them after its own."""
    out = []
    for i, o in enumerate((parsed(text).get("compliance") or {}).get("severity_overrides") or []):
        severity = o.get("severity") or "info"
        if not o.get("rule_id") or severity not in SEVERITIES:
            raise ValueError(f"override {i} has no rule or an unknown severity: {o!r}")
        out.append((o["rule_id"], o.get("component_type") or "", o.get("ecosystem") or "", SEVERITIES[severity]))
    return out
