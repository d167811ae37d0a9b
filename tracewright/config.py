"""Settings: the defaults of every threshold, lexicon, price and tier, and TOML files merged over them."""

from __future__ import annotations

import copy
import tomllib
from pathlib import Path

#: Thresholds, word lists, secret patterns and tiers of the rules.
DEFAULTS: dict = {
    "context_window": 200_000,
    "idle_minutes": 5.0,
    "lexicons": {
        "correction": ["no", "nope", "wrong", "still broken", "still failing", "that's not", "thats not", "undo", "revert", "not what"],
        "completion": ["done", "fixed", "should work", "all set", "that works now", "complete"],
        "positive": ["thanks", "thank you", "perfect", "works", "great", "ship", "shipit", "lgtm", "nice", "awesome"],
        "task_intro": ["implement", "add", "now let's", "now lets", "now do", "switch to", "unrelated", "different", "next", "also", "can you also"],
        "interrogative": ["why", "what", "how", "did", "is", "are", "does", "should", "which", "where", "when", "who"],
        "secret": ["AKIA[0-9A-Z]{16}", "sk-[A-Za-z0-9]{20,}", "ghp_[A-Za-z0-9]{36}", "xox[baprs]-[A-Za-z0-9-]{10,}", "-----BEGIN [A-Z ]*PRIVATE KEY-----"],
    },
    "detectors": {"enabled": [], "disabled": [], "severity": {}, "knobs": {}},
    "tails": {
        "tool_latency": 120, "parent_wait": 300, "delegation_lifetime": 900, "delegation_open": 900, "retry_attempts": 10, "failure_chain": 10,
        "output_volume": 50_000, "poll_amplification": 20, "model_input": 100_000, "model_output": 8_000, "delegation_fanout": 20, "context_replay": 1_000_000,
        "cache_creation": 100_000, "status_probes": 10, "inspection_rounds": 20, "output_repetition": 10_000, "delegation_repetition": 2,
        "verification_repetition": 2, "cache_rebuilds": 2, "retained_per_cohort": 10, "cache_rebuild_tokens": 10_000,
    },
    "wait_bands": [300, 3600],
    "prices": {},
    "tiers": {},
    "hooks": {},
}


def _merge(base: dict, over: dict, path: str = "") -> dict:
    for key, value in over.items():
        if key in base and isinstance(base[key], dict) != isinstance(value, dict):
            raise ValueError(f"{path}{key}: a table and a value do not mix")
        if isinstance(value, dict) and isinstance(base.get(key), dict):
            _merge(base[key], value, f"{path}{key}.")
        else:
            base[key] = copy.deepcopy(value)
    return base


def load(path: str | None = None, text: str | None = None) -> dict:
    """The defaults with a TOML file, or text, merged over them key by key; unknown top-level tables are refused."""
    settings = copy.deepcopy(DEFAULTS)
    given = tomllib.loads(text if text is not None else Path(path).read_text()) if path or text is not None else {}
    unknown = set(given) - set(DEFAULTS)
    if unknown:
        raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
    return _merge(settings, given)


def knobs_of(settings: dict) -> dict[str, dict]:
    """Knobs by detector id; ids are matched in any case."""
    from tracewright.operators import detectors

    known = {d.lower(): d for d in detectors.REGISTRY}
    return {known[k.lower()]: v for k, v in settings["detectors"]["knobs"].items() if k.lower() in known}
