"""The languages that ingest knows. Tags and file extensions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Language:
    tag: str
    extensions: tuple[str, ...]
    imports: str
    suffix: str = ""
    keyword: str = ""
    terminator: str = ""


LANGUAGES = (
    Language("rust", ("rs",), "rust"),
    Language("javascript", ("js", "jsx", "mjs", "cjs"), "js"),
    Language("typescript", ("ts", "mts", "cts"), "js"),
    Language("tsx", ("tsx",), "js"),
    Language("python", ("py", "pyi"), "python"),
    Language("c", ("c",), "c"),
    Language("cpp", ("cpp", "cc", "cxx", "c++", "hpp", "hh", "hxx", "h"), "c"),
    Language("java", ("java",), "dotted", "java", "import ", ";"),
    Language("kotlin", ("kt", "kts"), "dotted", "kt", "import ", ""),
    Language("csharp", ("cs",), "dotted", "cs", "using ", ";"),
)
DOC_EXTENSIONS = ("md", "markdown")


def language(extension: Column) -> Column:
    """The tag for an extension, letter case as it stands; null for others."""
    out = F
    for lang in LANGUAGES:
        out = out.when(extension.isin(*lang.extensions), lang.tag)
    return out.otherwise(F.lit(None).cast("string"))
