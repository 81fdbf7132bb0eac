"""The request guard as a state machine over requests in time order, with state of its own for each identity: an address and a
visitor. Batch and streaming operators share it."""

from __future__ import annotations

import hashlib
import math
import re
from collections import deque
from dataclasses import dataclass, field

# ---- fixed values: policies (limit, window s, penalty s), paths, clients ---------------------------------------------
POLICIES = {"general": (240, 60, 60), "search": (40, 60, 120), "resonance": (24, 60, 180), "context": (36, 60, 180), "export": (6, 600, 900), "audio": (30, 60, 300), "login": (10, 900, 900)}
HONEYPOTS = frozenset({"/api/internal/corpus-dump", "/corpus-export-all"})
FETCH_ONLY = frozenset({"/api/search/count", "/api/resonance", "/resonance/data"})
EXPORTS = frozenset({"/api/diagraph/export_csv", "/api/diagraph/export_excel"})
SEARCHES = frozenset({"/search", "/browse"})
AUDIO = ("/audio/", "/corpus/audio/")
CONTEXTS = ("/api/diagraph/", "/resonance/context/")
DATA_PREFIXES = ("/api/diagraph/", "/api/resonance", "/resonance/context/", "/resonance/data", *AUDIO)
#: Policy of a path: by name, else by prefix, else general.
BY_NAME = dict.fromkeys(EXPORTS, "export") | dict.fromkeys(FETCH_ONLY, "resonance") | {"/api/search/count": "search"} | dict.fromkeys(SEARCHES, "search")
BY_PREFIX = (("audio", AUDIO), ("context", CONTEXTS))
BOTS = re.compile("python-requests|python-urllib|curl/|wget/|scrapy|go-http-client|apache-httpclient|libwww-perl|httpx/|aiohttp/|headlesschrome", re.IGNORECASE)
HONEYPOT_SECONDS, CROSS_SITE_SECONDS, NO_SIGNAL_SECONDS, BOT_SECONDS, LAST_PAGE = 86_400, 600, 300, 1800, 50


def policy_of(path: str, method: str = "GET") -> str:
    if path == "/admin/login" and method == "POST":
        return "login"
    return BY_NAME.get(path) or next((name for name, starts in BY_PREFIX if path.startswith(starts)), "general")


def holds_data(path: str) -> bool:
    return path in SEARCHES or path in FETCH_ONLY or path.startswith(DATA_PREFIXES)


def needs_fetch(path: str) -> bool:
    return path in FETCH_ONLY or path.startswith(CONTEXTS) and path not in EXPORTS


def identities(ip: str, visitor: str) -> list[str]:
    found = [f"ip:{ip}"] * bool(ip) + [f"visitor:{hashlib.sha256(visitor.encode()).hexdigest()[:24]}"] * bool(visitor)
    return found or ["anonymous"]


def exempt(path: str, method: str) -> bool:
    return method == "OPTIONS" or path.startswith("/static/") or path == "/api/visitor-stats"


@dataclass(frozen=True)
class Limits:
    """Policies (limit, window, penalty), the last page that searches may ask for, and seconds of a honeypot's block."""

    policies: dict[str, tuple[int, int, int]] = field(default_factory=lambda: dict(POLICIES))
    last_page: int = LAST_PAGE
    honeypot: int = HONEYPOT_SECONDS
    trusted: tuple[str, ...] = ()


@dataclass
class Decision:
    allowed: bool
    policy: str = ""
    reason: str = ""
    status: int = 200
    retry_after: int = 0
    remaining: int = 0


@dataclass
class Guard:
    """State: until when an identity is blocked, and the times of its recent requests under each policy."""

    limits: Limits = field(default_factory=Limits)
    blocked: dict[str, float] = field(default_factory=dict)
    recent: dict[tuple[str, str], deque] = field(default_factory=dict)

    def _block(self, who: list[str], until: float) -> None:
        for w in who:
            self.blocked[w] = max(self.blocked.get(w, 0), until)

    def refusal(self, path: str, name: str, agent: str, fetch_site: str, requested_with: str, page: int) -> tuple[str, str, int] | None:
        """(policy, reason, seconds of block) of a request that is refused for what it is; a page too deep blocks nothing."""
        data = holds_data(path)
        found = (
            (path in HONEYPOTS, "honeypot", "honeypot", self.limits.honeypot),
            (data and fetch_site.lower() == "cross-site", name, "cross_site", CROSS_SITE_SECONDS),
            (needs_fetch(path) and requested_with.lower() != "fetch", name, "missing_fetch_signal", NO_SIGNAL_SECONDS),
            (data and (not agent.strip() or bool(BOTS.search(agent))), name, "automation_client", BOT_SECONDS),
            (self.limits.last_page and path in SEARCHES and page > self.limits.last_page, "search", "deep_pagination", 0),
        )
        return next((x[1:] for x in found if x[0]), None)

    def settle(self, now: float, who: list[str], name: str, refusal: tuple[str, str, int] | None) -> Decision:
        """The decision on a request that is not exempt, and what it does to the state of its identities."""
        whole = lambda s: max(1, math.floor(s + 0.999))
        if (until := max(self.blocked.get(w, 0) for w in who)) > now:
            return Decision(False, name, "temporary_block", 429, whole(until - now))
        if refusal:
            policy, reason, seconds = refusal
            if seconds:
                self._block(who, now + seconds)
            return Decision(False, policy, reason, 403, seconds)
        limit, window, penalty = self.limits.policies[name]
        used = 0
        for w in who:
            log = self.recent.setdefault((w, name), deque())
            while log and log[0] <= now - window:
                log.popleft()
            if len(log) >= limit:
                wait = max(penalty, whole(log[0] + window - now))
                self._block(who, now + wait)
                return Decision(False, name, "rate_limit", 429, wait)
            log.append(now)
            used = max(used, len(log))
        return Decision(True, name, remaining=max(0, limit - used))

    def decide(self, now: float, path: str, method: str = "GET", ip: str = "", visitor: str = "", agent: str = "", fetch_site: str = "", requested_with: str = "", page: int = 1, admin: bool = False) -> Decision:
        if admin or ip in self.limits.trusted or exempt(path, method):
            return Decision(True)
        name = policy_of(path, method)
        return self.settle(now, identities(ip, visitor), name, self.refusal(path, name, agent, fetch_site, requested_with, page))

    def forget(self, now: float) -> None:
        """Drop expired blocks, and logs that no window reaches."""
        self.blocked = {w: t for w, t in self.blocked.items() if t > now}
        self.recent = {k: v for k, v in self.recent.items() if v and v[-1] > now - self.limits.policies[k[1]][1]}
