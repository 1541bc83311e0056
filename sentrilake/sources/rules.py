"""Detection rules: built-in ones and YAML files."""

from __future__ import annotations

from dataclasses import dataclass, field
from pathlib import Path

from sentrilake.schema import SEVERITY_SCORES

try:
    import yaml
except ImportError:  # rules can still be built in code
    yaml = None


@dataclass(frozen=True)
class Criterion:
    """All conditions that are set must hold for an event to match."""

    event_type: str | None = None
    process_name_contains: str | None = None
    target_resource_contains: str | None = None
    is_external_network: bool | None = None
    # Accepted in rule files; the scan does not test it.
    crypto_algorithm: str | None = None
    min_event_count: int | None = None

    @property
    def minimum(self) -> int:
        return 1 if self.min_event_count is None else self.min_event_count


@dataclass(frozen=True)
class Mitre:
    tactic: str
    technique_id: str
    technique_name: str


@dataclass(frozen=True)
class Rule:
    id: str
    title: str
    severity: str
    remediation: str
    criteria: tuple[Criterion, ...]
    mitre: Mitre | None = None
    description: str = ""
    author: str = ""

    @property
    def score(self) -> int:
        return SEVERITY_SCORES[self.severity]


@dataclass
class LoadedRules:
    rules: list[Rule] = field(default_factory=list)
    loaded_from_files: int = 0


def builtin_rules() -> list[Rule]:
    """The five rules that are always active."""
    return [
        Rule(
            id="SEC-001",
            title="Files rewritten while encryption is in use",
            severity="CRITICAL",
            remediation="Take the host off the network and keep a memory image.",
            criteria=(Criterion("FileWrite", min_event_count=1),
                      Criterion("CryptoOperation", min_event_count=1)),
            mitre=Mitre("Impact", "T1486", "Data Encrypted for Impact"),
        ),
        Rule(
            id="SEC-002",
            title="Outbound connection to an external address",
            severity="HIGH",
            remediation="Check the remote address and the command line of the process.",
            criteria=(Criterion("NetworkConnect", is_external_network=True, min_event_count=1),),
            mitre=Mitre("Command and Control", "T1059", "Command and Scripting Interpreter"),
        ),
        Rule(
            id="SEC-003",
            title="Credential database opened",
            severity="HIGH",
            remediation="Stop the process and rotate the credentials it could read.",
            criteria=(Criterion("FileOpen", target_resource_contains="sam", min_event_count=1),),
            mitre=Mitre("Credential Access", "T1003", "OS Credential Dumping"),
        ),
        Rule(
            id="SEC-004",
            title="Child process started",
            severity="MEDIUM",
            remediation="Confirm that the parent program is meant to start this child.",
            criteria=(Criterion("ProcessSpawn", min_event_count=1),),
            mitre=Mitre("Defense Evasion", "T1218", "System Binary Proxy Execution"),
        ),
        Rule(
            id="SEC-005",
            title="Socket created",
            severity="LOW",
            remediation="Look for scanning and limit which endpoints are reachable.",
            criteria=(Criterion("SocketCreate", min_event_count=1),),
            mitre=Mitre("Discovery", "T1046", "Network Service Discovery"),
        ),
    ]


def _require(value: object, kind: type) -> object:
    if not isinstance(value, kind) or (kind is int and isinstance(value, bool)):
        raise ValueError(f"expected {kind.__name__}")
    return value


def _optional(value: object, kind: type) -> object:
    return None if value is None else _require(value, kind)


def parse_rule(text: str) -> Rule:
    """One rule from YAML text; raises if a field is missing or has a wrong type."""
    if yaml is None:
        raise RuntimeError("reading rule files needs the yaml package")
    raw = _require(yaml.safe_load(text), dict)
    mitre = raw.get("mitre")
    if raw["severity"] not in SEVERITY_SCORES:
        raise ValueError("unknown severity")
    criteria = []
    for item in _require(raw["criteria"], list):
        item = _require(item, dict)
        count = _optional(item.get("min_event_count"), int)
        if count is not None and count < 0:
            raise ValueError("min_event_count is negative")
        criteria.append(
            Criterion(
                event_type=_optional(item.get("event_type"), str),
                process_name_contains=_optional(item.get("process_name_contains"), str),
                target_resource_contains=_optional(item.get("target_resource_contains"), str),
                is_external_network=_optional(item.get("is_external_network"), bool),
                crypto_algorithm=_optional(item.get("crypto_algorithm"), str),
                min_event_count=count,
            )
        )
    return Rule(
        id=_require(raw["id"], str),
        title=_require(raw["title"], str),
        severity=raw["severity"],
        remediation=_require(raw["remediation"], str),
        criteria=tuple(criteria),
        mitre=None if mitre is None else Mitre(
            *[_require(mitre[k], str) for k in ("tactic", "technique_id", "technique_name")]
        ),
        description=_require(raw["description"], str),
        author=_require(raw["author"], str),
    )


def load_rules(folder: str | None = None) -> LoadedRules:
    """Built-in rules plus every readable ``.yml`` / ``.yaml`` file of a folder."""
    out = LoadedRules(builtin_rules())
    if folder is None or not Path(folder).is_dir():
        return out
    for path in sorted(Path(folder).iterdir()):
        if path.suffix not in (".yml", ".yaml"):
            continue
        try:
            rule = parse_rule(path.read_text(encoding="utf-8"))
        except (ValueError, KeyError, TypeError) as _:
            continue
        except Exception as error:
            if yaml is not None and isinstance(error, yaml.YAMLError):
                continue
            raise
        out.rules.append(rule)
        out.loaded_from_files += 1
    return out
