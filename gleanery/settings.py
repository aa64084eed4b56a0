"""Run parameters and preferences: small driver-side values that become literals."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from datetime import UTC, date, datetime
from typing import Any


@dataclass(frozen=True)
class Run:
    """One instant for the whole run, so a repeated run gives the same rows."""

    at: datetime

    @classmethod
    def now(cls) -> Run:
        return cls(datetime.now(UTC).replace(tzinfo=None))

    @property
    def day(self) -> date:
        return self.at.date()


def _words(values: Any) -> tuple[str, ...]:
    return tuple(str(v) for v in values or ())


@dataclass(frozen=True)
class Feedback:
    title_keywords: tuple[str, ...] = ()
    companies: tuple[str, ...] = ()
    title_keyword_penalty: int = 12
    company_penalty: int = 25

    @classmethod
    def from_mapping(cls, data: Mapping[str, Any] | None) -> Feedback:
        data = data or {}
        return cls(
            _words(data.get("suppress_title_keywords")),
            _words(data.get("suppress_companies")),
            int(data.get("title_keyword_penalty", 12)),
            int(data.get("company_penalty", 25)),
        )


@dataclass(frozen=True)
class Preferences:
    strong: tuple[str, ...] = ()
    good: tuple[str, ...] = ()
    avoid: tuple[str, ...] = ()
    priority_places: tuple[str, ...] = ()
    acceptable_places: tuple[str, ...] = ()
    preferred_modes: tuple[str, ...] = ()
    contract_types: tuple[str, ...] = ()
    max_age_days: int = 14
    report_threshold: int = 15
    report_rows: int = 20
    sources: tuple[str, ...] = ()
    feedback: Feedback = Feedback()

    @classmethod
    def from_mapping(cls, data: Mapping[str, Any]) -> Preferences:
        roles = data.get("roles") or {}
        places = data.get("locations") or {}
        return cls(
            strong=_words(roles.get("strong")),
            good=_words(roles.get("good")),
            avoid=_words(roles.get("avoid")),
            priority_places=_words(places.get("priority")),
            acceptable_places=_words(places.get("acceptable")),
            preferred_modes=_words((data.get("work_modes") or {}).get("prefer")),
            contract_types=_words(data.get("contract_types")),
            max_age_days=int(data.get("max_age_days", 14)),
            report_threshold=int(data.get("digest_score_threshold", 15)),
            report_rows=int(data.get("digest_max_jobs", 20)),
            sources=_words(data.get("adapters")),
            feedback=Feedback.from_mapping(data.get("feedback")),
        )

    @property
    def search_terms(self) -> tuple[str, ...]:
        return self.strong + self.good
