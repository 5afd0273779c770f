"""Document formats by file extension."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Format:
    document_type: str
    extensions: tuple[str, ...]
    display_name: str


def normal_extensions(extensions: tuple[str, ...]) -> tuple[str, ...]:
    """Trimmed, lower-case, with a leading dot, each once."""
    found = dict.fromkeys(e if e[:1] == "." else f".{e}" for e in (x.strip().lower() for x in extensions) if e)
    if not found:
        raise ValueError("a format needs an extension")
    return tuple(found)


class Registry:
    def __init__(self) -> None:
        self._formats: dict[str, Format] = {}

    def register(self, document_type: str, extensions: tuple[str, ...], display_name: str, *, replace: bool = False) -> Format:
        made = Format(document_type, normal_extensions(extensions), display_name)
        clash = [f for f in self._formats.values() if f.document_type == document_type or set(f.extensions) & set(made.extensions)]
        if clash and not replace:
            raise ValueError(f"already registered: {', '.join(f.document_type for f in clash)}")
        for f in clash:
            del self._formats[f.document_type]
        self._formats[document_type] = made
        return made

    def unregister(self, document_type: str) -> Format:
        return self._formats.pop(document_type)

    def formats(self) -> list[Format]:
        return sorted(self._formats.values(), key=lambda f: f.document_type)

    def extensions(self) -> list[str]:
        return sorted(e for f in self._formats.values() for e in f.extensions)

    def file_filter(self) -> str:
        return ";;".join(f"{f.display_name} ({' '.join('*' + e for e in f.extensions)})" for f in self.formats())

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [(e, f.document_type, f.display_name) for f in self.formats() for e in f.extensions]
        return spark.createDataFrame(rows, "extension string, document_type string, display_name string")

    def document_type(self, path: Column) -> Column:
        """The type of a path's extension, null if none is known."""
        suffix = extension(path)
        out = F.lit(None).cast("string")
        for f in self.formats():
            out = F.when(suffix.isin(*f.extensions), f.document_type).otherwise(out)
        return out


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"[^/\\](\.[^./\\]+)$", 1))


def default_registry() -> Registry:
    registry = Registry()
    registry.register("markdown", (".md",), "Markdown")
    registry.register("dita", (".dita",), "DITA")
    return registry
