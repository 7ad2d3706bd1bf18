"""Models loaded by this Python worker, by path."""

from typing import Any

MODELS: dict[str, Any] = {}
