"""Rule sets: the built-in one, or one read from YAML files."""

from __future__ import annotations

from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from lurewatch.rules import fixed


@dataclass(frozen=True)
class Brand:
    domain: str
    name: str
    aliases: tuple[str, ...] = ()

    @property
    def label(self) -> str:
        return self.domain.split(".")[0]


@dataclass(frozen=True)
class SignalGroup:
    key: str
    severity: str
    phrases: tuple[str, ...]


@dataclass(frozen=True)
class RuleSet:
    """Configuration small enough to travel inside the query plan."""

    brands: tuple[Brand, ...] = ()
    shorteners: tuple[str, ...] = ()
    extensions: dict[str, str] = field(default_factory=dict)
    signals: tuple[SignalGroup, ...] = ()

    @property
    def exempt_domains(self) -> list[str]:
        """Brand domains and their aliases, each once, in rule order."""
        names = [n for b in self.brands for n in (b.domain, *b.aliases)]
        return list(dict.fromkeys(names))

    @classmethod
    def builtin(cls) -> RuleSet:
        return cls(
            brands=tuple(Brand(d, n, tuple(a)) for d, n, a in fixed.BRANDS),
            shorteners=tuple(fixed.SHORTENERS),
            extensions={
                e: sev for _, sev, exts in fixed.EXTENSION_GROUPS for e in exts
            },
            signals=tuple(
                SignalGroup(k, s, tuple(p)) for k, s, p in fixed.SIGNAL_GROUPS
            ),
        )

    @classmethod
    def from_directory(cls, directory: str | Path) -> RuleSet:
        """Read brands, link_shorteners, suspicious_extensions and
        content_patterns (`.yml`). A file that is missing leaves its set empty;
        a severity that does not exist raises ValueError."""
        import yaml

        def load(name: str):
            path = Path(directory) / f"{name}.yml"
            if not path.exists():
                return {}
            return yaml.safe_load(path.read_text(encoding="utf-8")) or {}

        return cls(
            brands=tuple(
                Brand(b["domain"], b["name"], tuple(b.get("aliases") or ()))
                for b in load("brands").get("brands", [])
            ),
            shorteners=tuple(load("link_shorteners").get("shorteners", [])),
            extensions={
                str(e).lower(): _severity(group["severity"], "suspicious_extensions.yml", name)
                for name, group in load("suspicious_extensions").items()
                for e in group["extensions"]
            },
            signals=tuple(
                SignalGroup(
                    k, _severity(g.get("severity", "medium"), "content_patterns.yml", k), tuple(g.get("patterns", []))
                )
                for k, g in load("content_patterns").items()
            ),
        )


def _severity(value, file: str, group: str) -> str:
    if value not in fixed.SEVERITY_POINTS:
        raise ValueError(f"{file}, {group}: unknown severity {value!r}; one of {', '.join(fixed.SEVERITY_POINTS)}")
    return value


def rule_table(spark: SparkSession, rules: RuleSet) -> DataFrame:
    """All rules as rows `(rule_set, idx, rule_key, rule_value)`; `idx` is the order."""
    rows: list[tuple[str, int, str, str]] = []
    for i, b in enumerate(rules.brands):
        rows.append(("brand", i, b.domain, b.name))
    for i, d in enumerate(rules.exempt_domains):
        rows.append(("exempt_domain", i, d, "exempt"))
    for i, s in enumerate(rules.shorteners):
        rows.append(("shortener", i, s, "shortener"))
    for i, (e, sev) in enumerate(rules.extensions.items()):
        rows.append(("extension", i, e, sev))
    phrases = [(g.key, p) for g in rules.signals for p in g.phrases]
    for i, (key, phrase) in enumerate(phrases):
        rows.append(("phrase", i, phrase, key))
    return spark.createDataFrame(
        rows, "rule_set string, idx int, rule_key string, rule_value string"
    )
