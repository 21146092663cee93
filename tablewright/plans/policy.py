"""Governance of cleaning actions: blocks, risks, warnings and the confidence score."""

from __future__ import annotations

from dataclasses import dataclass, field

# Protected name parts, restricted actions, and score weights.
PROTECTED = ["id", "uuid", "guid", "tx_", "transaction", "hash", "secret", "iban", "account", "token", "key"]
RESTRICTED = {
    "drop": ["id", "uuid", "guid", "email", "phone", "name"],
    "remove_outliers": ["id", "uuid", "guid", "email", "phone", "name"],
    "fuzzy_fix": ["id", "uuid", "guid", "email", "phone"],
}
HIGH_RISK = ["drop", "remove_duplicates"]
MEDIUM_RISK = ["smart_impute", "fuzzy_fix"]


@dataclass
class Policy:
    protected: list[str] = field(default_factory=lambda: list(PROTECTED))
    restricted: dict[str, list[str]] = field(default_factory=lambda: dict(RESTRICTED))
    approved: set[tuple[str, str]] = field(default_factory=set)
    max_deletion_pct: float = 5.0
    blocked: list[str] = field(default_factory=list)
    risks: list[str] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)

    def is_protected(self, column: str) -> bool:
        return any(part in column.lower() for part in self.protected)

    def allows(self, action: str, column: str) -> bool:
        """Record the decision and say whether the action may run."""
        if (column, action) in self.approved:
            self.warnings.append(f"{action} on {column}: approved by the caller")
            return True
        shielded = self.is_protected(column)
        if shielded and (action == "drop" or any(p in column.lower() for p in self.restricted.get(action, []))):
            self.blocked.append(f"{action} on protected column {column}")
            return False
        if action in HIGH_RISK or shielded:
            self.risks.append(f"{action} on {column}: high risk")
            self.warnings.append(f"high-risk {action} on {column}")
        elif action in MEDIUM_RISK:
            self.warnings.append(f"medium-risk {action} on {column}")
        return True

    def check_deletion(self, removed: int, total: int) -> None:
        """Warn when more rows went than the limit allows."""
        if total and removed / total * 100 > self.max_deletion_pct:
            self.risks.append(f"removed {removed / total * 100:.2f} % of rows")
            self.warnings.append(f"row removal above {self.max_deletion_pct} %")

    def confidence(self) -> float:
        return max(10.0, min(100.0, 100.0 - 25 * len(self.blocked) - 15 * len(self.risks) - 5 * len(self.warnings)))
