"""Settings of the engine, frozen; functions take them as arguments and never read the environment."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class EngineConfig:
    """Declared limits and defaults (fixed values)."""

    max_file_size_mb: int = 35
    max_files: int = 30
    min_text: int = 100
    structure_max_input_chars: int = 2_500_000
    chars_per_token: int = 3
    context_share: float = 0.85
    rules_per_request: int = 12
    packet_attempts: int = 2
    provider_attempts: int = 4
    request_timeout_ms: int = 240_000
    requests_per_minute: int = 18
    input_tokens_per_minute: int = 0
    max_concurrent: int = 1

    @property
    def min_request_interval_ms(self) -> int:
        return -(-60_000 // self.requests_per_minute)
