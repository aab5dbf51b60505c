"""Settings objects. Defaults are the shipped workload sizes."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class ColumnMap:
    """Which column of the file plays which role; None means the role is absent."""

    instruction: str | None = "instruction"
    input: str | None = "input"
    output: str | None = "output"
    chosen: str | None = None
    rejected: str | None = None

    @classmethod
    def preference(cls) -> "ColumnMap":
        return cls("prompt", None, None, "chosen", "rejected")

    def bounded(self) -> list[str]:
        """Columns the length filter looks at; the optional input never counts."""
        roles = (self.instruction, self.output, self.chosen, self.rejected)
        return [name for name in roles if name]

    def required(self) -> list[str]:
        """Columns that must exist: an output, or else a chosen/rejected pair."""
        names = [self.instruction] if self.instruction else []
        if self.output:
            return names + [self.output]
        if self.chosen and self.rejected:
            return names + [self.chosen, self.rejected]
        return names

    def validate(self, columns: list[str]) -> None:
        """Plan-time check against ``df.columns``; runs no job."""
        missing = sorted(set(self.required()) - set(columns), key=self.required().index)
        if missing:
            raise ValueError(f"columns {missing} are missing; the table has {list(columns)}")


@dataclass(frozen=True)
class PrepConfig:
    strip: bool = True
    lowercase: bool = False
    drop_duplicates: bool = True
    min_length: int = 10
    max_length: int = 10_000
    # True reproduces the text "nan" that a string cast gives to missing values.
    stringify_nulls: bool = False


@dataclass(frozen=True)
class SplitConfig:
    train: float = 0.8
    val: float = 0.1
    test: float = 0.1
    shuffle: bool = True
    seed: int = 42
    stratify: str | None = None


@dataclass(frozen=True)
class ChunkConfig:
    size: int = 1000
    overlap: int = 200
    separators: tuple[str, ...] = ("\n\n", "\n", " ", "")

    def __post_init__(self):
        if not 0 <= self.overlap < self.size:
            raise ValueError("overlap must be at least 0 and smaller than the chunk size")


@dataclass(frozen=True)
class RetrievalConfig:
    search_type: str = "similarity"
    k: int = 4
    max_distance: float | None = None
    fetch_k: int = 20
    lambda_mult: float = 0.5


@dataclass(frozen=True)
class ReadConfig:
    fmt: str = "csv"
    delimiter: str = ","
    encoding: str = "utf-8"
    header: bool = True
    names: tuple[str, ...] | None = None
    na_values: tuple[str, ...] = ()
    multiline: bool = True


@dataclass(frozen=True)
class DatasetConfig:
    """One fine-tuning dataset: files, column roles, cleaning and split."""

    train_file: str | None = None
    val_file: str | None = None
    test_file: str | None = None
    read: ReadConfig = field(default_factory=ReadConfig)
    columns: ColumnMap = field(default_factory=ColumnMap)
    prep: PrepConfig = field(default_factory=PrepConfig)
    split: SplitConfig = field(default_factory=SplitConfig)
