"""Engine configuration: immutable, read when a plan is built."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, fields, replace

from palisade.model import LOCATION_WEIGHTS

Selector = int | str

# The names of a configuration document, by section, and the fields they set.
DOCUMENT = {
    "": {
        "paranoia_level": "paranoia", "sqli_enabled": "sqli", "xss_enabled": "xss", "path_traversal_enabled": "path_traversal", "command_injection_enabled": "command_injection",
        "protocol_enabled": "protocol", "body_inspection_enabled": "body_inspection", "max_body_size": "max_body", "response_inspection_enabled": "response_inspection",
    },
    "scoring": {"enabled": "scoring", "block_threshold": "block_threshold", "log_threshold": "log_threshold", "category_weights": "category_weights", "location_weights": "location_weights"},
    "rules": {"enabled": "enabled", "disabled": "disabled", "exclusions": "exclusions"},
    "streaming": {"enabled": "streaming", "window_overlap": "overlap", "early_termination_threshold": "early_threshold"},
    "ml": {
        "classifier_enabled": "ml_classifier", "similarity_enabled": "ml_similarity", "min_confidence": "ml_min_confidence", "score_weight": "ml_score_weight",
        "fingerprinting_enabled": "fingerprinting", "anomaly_threshold": "anomaly_threshold",
    },
    "websocket": {
        "enabled": "websocket", "inspect_text_frames": "websocket_text", "inspect_binary_frames": "websocket_binary", "max_frame_size": "max_frame", "block_mode": "websocket_block_mode",
        "max_message_size": "max_message", "block_close_code": "websocket_close_code",
    },
}


@dataclass(frozen=True)
class Exclusion:
    """Rules that are skipped for paths with one of these prefixes."""

    rules: tuple[Selector, ...]
    paths: tuple[str, ...] = ()


@dataclass(frozen=True)
class Config:
    paranoia: int = 1
    sqli: bool = True
    xss: bool = True
    path_traversal: bool = True
    command_injection: bool = True
    protocol: bool = True
    block_mode: bool = True
    scoring: bool = True
    block_threshold: int = 25
    log_threshold: int = 10
    exclude_paths: tuple[str, ...] = ()
    enabled: tuple[Selector, ...] | None = None
    disabled: tuple[Selector, ...] = ()
    exclusions: tuple[Exclusion, ...] = ()
    category_weights: dict[str, float] = field(default_factory=dict)
    location_weights: dict[str, float] = field(default_factory=lambda: dict(LOCATION_WEIGHTS))
    body_inspection: bool = True
    max_body: int = 1 << 20
    overlap: int = 256
    early_threshold: int = 50
    websocket_block_mode: bool = True
    max_frame: int = 64 << 10
    max_message: int = 1 << 20
    response_inspection: bool = False
    streaming: bool = False
    websocket: bool = True
    websocket_text: bool = True
    websocket_binary: bool = False
    websocket_close_code: int = 1008
    ml_classifier: bool = False
    ml_similarity: bool = False
    ml_min_confidence: float = 0.4
    ml_score_weight: float = 1.0
    fingerprinting: bool = False
    anomaly_threshold: float = 0.5

    @classmethod
    def from_json(cls, text: str) -> "Config":
        """Unknown keys are ignored, missing ones have their defaults, dashes count as underscores.

        Sections set their fields (DOCUMENT); the fields themselves may be given as well."""
        plain = lambda section: {k.replace("-", "_"): v for k, v in section.items()}
        document, known = plain(json.loads(text)), {f.name for f in fields(cls)}
        given = {k: v for k, v in document.items() if not (k in DOCUMENT and isinstance(v, dict))}
        for section, names in DOCUMENT.items():
            part = document if not section else document.get(section)
            if isinstance(part, dict):
                given |= {names[k]: v for k, v in plain(part).items() if k in names}
        kept = {k: tuple(v) if isinstance(v, list) else v for k, v in given.items() if k in known}
        if "location_weights" in kept:
            kept["location_weights"] = LOCATION_WEIGHTS | kept["location_weights"]
        kept["exclusions"] = tuple(
            Exclusion(tuple(x["rules"]), tuple((x.get("conditions") or {}).get("paths") or ())) for x in given.get("exclusions", ())
        )
        return cls(**kept)

    def clamped(self) -> "Config":
        """With the paranoia level between 1 and 4, as on the command line."""
        return replace(self, paranoia=min(4, max(1, self.paranoia)))
