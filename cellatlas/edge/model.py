"""Calls of a language model, behind a budget: none ships here, and none is on a query's path."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable
from dataclasses import dataclass, field

#: system and user text to the answer, tokens read, tokens written.
Client = Callable[[str, str], tuple[str, int, int]]


class OverBudget(RuntimeError):
    pass


class RateLimited(RuntimeError):
    """What a client raises to be called again later."""


@dataclass
class Budget:
    """Adds up what calls cost; refuses once the cap is passed by five percent."""

    cap: float = 1.0
    per_token_in: float = 0.0
    per_token_out: float = 0.0
    spent: float = 0.0
    _lock: threading.Lock = field(default_factory=threading.Lock)

    def check(self) -> None:
        with self._lock:
            if self.spent >= self.cap * 1.05:
                raise OverBudget(f"{self.spent:.4f} of {self.cap:.4f} spent")

    def add(self, read: int, written: int) -> None:
        with self._lock:
            self.spent += read * self.per_token_in + written * self.per_token_out


def ask(client: Client, system: str, user: str, budget: Budget, chars: int = 18000, tries: int = 5, wait: float = 2.0, sleep: Callable[[float], None] = time.sleep) -> str:
    """Cuts the user text at `chars`; only rate limits are tried again, each time after twice the wait, two minutes at most."""
    budget.check()
    for i in range(tries):
        try:
            answer, read, written = client(system, user[:chars])
        except RateLimited:
            if i == tries - 1:
                raise
            sleep(min(wait * 2**i, 120.0))
            continue
        budget.add(read, written)
        return answer
    raise AssertionError("unreachable")


def offline(system: str, user: str) -> tuple[str, int, int]:
    """A client for tests and for work without a network: says how long the question was."""
    return f"[no model: {len(user)} characters]", len(system) + len(user), 0


def prompt(task: str, question: str, evidence: str) -> tuple[str, str]:
    """System and user text for one of the tasks."""
    tasks = {
        "retrieval": "Say which cell clusters fit the question, from the ranked evidence alone.",
        "discovery": "Say what the evidence adds to what is commonly known, and mark what it cannot show.",
        "comparison": "Compare the two groups. The gene statistics are of clusters, so they only stand in for differences between groups.",
        "interactions": "Describe the ligand-receptor pairs between the clusters, the strongest first.",
        "proportions": "Describe how the clusters' shares differ, and where numbers are small.",
        "pathways": "Describe which pathways are active in which clusters.",
    }
    return tasks[task], f"Question: {question}\n\nEvidence:\n{evidence}"
