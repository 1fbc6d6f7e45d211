"""Run settings: defaults, bounds, lenient reading, presets."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, fields, replace

# Bounds and presets.
BOUNDS = {"chunk_size": (1000, 12000), "max_concurrent": (1, 8), "timeout_seconds": (30, 300), "max_retries": (1, 6), "retry_delay_seconds": (1, 15)}
TUNING = {
    "stable": {"chunk_size": 2500, "max_concurrent": 2, "timeout_seconds": 180, "max_retries": 4, "retry_delay_seconds": 6},
    "balanced": {"chunk_size": 5000, "max_concurrent": 4, "timeout_seconds": 150, "max_retries": 3, "retry_delay_seconds": 5},
    "fast": {"chunk_size": 8000, "max_concurrent": 8, "timeout_seconds": 120, "max_retries": 2, "retry_delay_seconds": 3},
}
PROVIDERS = {"deepseek": ("https://api.deepseek.com", "deepseek-chat"), "openAiCompatible": ("https://api.openai.com", "gpt-4o-mini")}
THEMES = ("system", "light", "dark")


@dataclass(frozen=True)
class Config:
    api_base_url: str = ""
    api_key: str = ""
    model: str = ""
    target_language: str = "Chinese"
    output_suffix: str = "_translated"
    locked_glossary: str = ""
    theme: str = "dark"
    text_scale: float = 1.0
    bilingual: bool = False
    residual_quality_check: bool = True
    chunk_size: int = 3000
    max_concurrent: int = 3
    timeout_seconds: int = 120
    max_retries: int = 3
    retry_delay_seconds: int = 5

    @classmethod
    def from_json(cls, text: str | None) -> Config:
        """Settings of a JSON object; anything unreadable gives all defaults."""
        try:
            data = json.loads(text or "")
            if not isinstance(data, dict):
                return cls()
            return cls(**{f.name: _read(f.name, f.default, data[f.name]) for f in fields(cls) if f.name in data and f.name != "api_key"})
        except (ValueError, TypeError):
            return cls()

    def to_json(self) -> str:
        """All settings but the key, which is never stored."""
        return json.dumps({k: v for k, v in asdict(self).items() if k != "api_key"}, indent=2, ensure_ascii=False)

    def tuned(self, preset: str) -> Config:
        return replace(self, **TUNING[preset])

    def matching_preset(self) -> str | None:
        return next((name for name, values in TUNING.items() if all(getattr(self, k) == v for k, v in values.items())), None)

    def for_provider(self, name: str) -> Config:
        """With a provider's address and model; `custom` keeps both."""
        if name == "custom":
            return self
        url, model = PROVIDERS[name]
        return replace(self, api_base_url=url, model=model)

    def matching_provider(self) -> str:
        """The provider whose address this is, or one below it; else `custom`."""
        url = self.api_base_url.strip().lower()
        return next((name for name, (base, _) in PROVIDERS.items() if url == base or url.startswith(f"{base}/")), "custom")

    def with_value(self, name: str, value: object) -> Config:
        return replace(self, **{name: _read(name, getattr(type(self)(), name), value)})

    def fewer_at_once(self) -> Config:
        return self.with_value("max_concurrent", self.max_concurrent - 1)

    def require_runnable(self, chapters: int, blocks: int) -> None:
        if not chapters:
            raise ValueError("no chapter is selected")
        if not blocks:
            raise ValueError("no readable block is selected")
        if not all(v.strip() for v in (self.api_base_url, self.api_key, self.model)):
            raise ValueError("base URL, API key and model are required before translation")


def _read(name: str, default: object, value: object) -> object:
    if name in BOUNDS:
        low, high = BOUNDS[name]
        return min(high, max(low, _integer(value, default)))
    if name == "text_scale":
        return min(1.3, max(0.9, float(value)))
    if isinstance(default, bool):
        if not isinstance(value, bool):
            raise TypeError(name)
        return value
    if name == "theme":
        return value if value in THEMES else default
    return value.strip() if isinstance(value, str) else default


def _integer(value: object, default: int) -> int:
    """Whole numbers, other numbers rounded half away from zero, and numbers in text."""
    try:
        if isinstance(value, bool):
            return default
        x = float(value.strip() if isinstance(value, str) else value)
        return int(abs(x) + 0.5) * (1 if x >= 0 else -1)
    except (TypeError, ValueError, OverflowError):
        return default
