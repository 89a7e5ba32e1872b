"""Settings of the corpus stages and of the token data, with their checks."""

from __future__ import annotations

import dataclasses
import json
from dataclasses import dataclass, field
from pathlib import Path

#: Stage folders by number.
STAGES = ("0_raw", "1_cleaned", "2_deduplicated", "3_split", "4_tokenized", "5_merged", "6_binarize")


@dataclass
class CorpusConfig:
    base_dir: str
    chinese_ratio: float = 0.6
    english_ratio: float = 0.4
    split_ratio: tuple[float, float, float] = (0.8, 0.1, 0.1)
    boundary: str = "cumulative"
    context_size: int = 512
    min_text_length: int = 10
    max_text_length: int = 100_000
    quality_filter: bool = False
    near_threshold: float | None = None
    vocab_size: int = 6400
    eos_token_id: int = 2
    budgets: dict[str, int] = field(default_factory=lambda: {"chinese": 9_000_000, "english": 6_000_000})
    random_seed: int = 42

    def __post_init__(self):
        if abs(self.chinese_ratio + self.english_ratio - 1) > 1e-6:
            raise ValueError("language ratios must sum to 1")
        if abs(sum(self.split_ratio) - 1) > 1e-6:
            raise ValueError("split ratios must sum to 1")
        self.split_ratio = tuple(self.split_ratio)

    def stage_dir(self, stage: int) -> str:
        return f"{self.base_dir.rstrip('/')}/{STAGES[stage]}"

    @property
    def token_width(self) -> int:
        """Bytes of a token on disk: 2 up to a vocabulary of 65535, else 4."""
        return 2 if self.vocab_size <= 65_535 else 4

    def save(self, path: str) -> None:
        """YAML where the library is installed and the name says so, else JSON."""
        data = dataclasses.asdict(self) | {"split_ratio": list(self.split_ratio)}
        Path(path).write_text(_yaml().safe_dump(data, allow_unicode=True) if path.endswith((".yaml", ".yml")) else json.dumps(data, ensure_ascii=False, indent=2), encoding="utf-8")

    @classmethod
    def load(cls, path: str) -> "CorpusConfig":
        text = Path(path).read_text(encoding="utf-8")
        return cls(**(_yaml().safe_load(text) if path.endswith((".yaml", ".yml")) else json.loads(text)))


def _yaml():
    try:
        import yaml
    except ImportError as e:
        raise RuntimeError("YAML settings need the yaml library; use JSON") from e
    return yaml
