"""Generated, minified, vendored files and data blobs saved as code.

Each content is measured once: longest and mean line, shares of white space, of letters and digits, of
numeric literals and of long encoded runs. Thresholds per language turn the measures into kinds; names and
folders, a header at the top and five-word shingles of known third-party files decide the rest.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Folders and names of third-party code, build output, generators and lock files: fixed values.
VENDORED_DIRS = (
    "vendor", "vendors", "third_party", "third-party", "thirdparty", "3rdparty", "node_modules", "bower_components", "jspm_packages",
    "site-packages", "dist-packages", "Godeps", "external", "externals", "deps", "Pods", "Carthage", "_vendor", "vendored",
)
OUTPUT_DIRS = ("dist", "_build", "priv/static", "build/generated", "build/lib", "build/out", "build/classes", "target/debug", "target/release", "target/classes", "web/out", ".next", "__generated__", "generated", "autogen")
GENERATED_NAMES = (
    r"\.(?:pb|generated|gen|g|designer|tab|yy)\.[a-z]+$|(?:_pb|_pb2|_pb2_grpc|_grpc_pb|_generated|_bindings|_string|_gen)\.[a-z]+$|[a-z0-9]Generated\.[a-z]+$|\.map$"
    r"|(?:^|/)(?:package-lock\.json|npm-shrinkwrap\.json|yarn\.lock|pnpm-lock\.yaml|Cargo\.lock|mix\.lock|poetry\.lock|uv\.lock|Pipfile\.lock|composer\.lock|Gemfile\.lock|go\.sum|flake\.lock|gradle\.lockfile|[^/]+\.lock)$"
)
MINIFIED_NAMES = r"[.\-](?:min|bundle|pack)\.(?:js|css|mjs)$"
CODE = ("py", "rs", "ex", "exs", "ts", "tsx", "js", "jsx", "mjs", "go", "java", "c", "h", "cc", "cpp", "css", "sql")
#: Begins of the header of a generated file, after the comment sign.
HEADER = re.compile(
    r"@generated\b|<auto-?generated\b|auto-?generated\b|code generated by\b|generated by\b|generated from\b|automatically generated\b|machine.generated\b"
    r"|this (?:file|code|source) (?:was|is|has been) (?:automatically |auto-?)?(?:produced|generated|created|written|emitted) (?:by|from|with|automatically)\b"
    r"|(?:this file is )?autogenerated\b|do not edit\b|fichier (?:généré|produit)\b|ce fichier (?:est|a été) (?:généré|produit)\b|généré (?:automatiquement )?par\b|ne pas modifier\b"
    r"|(?:diese datei wurde |datei )?(?:automatisch|maschinell) (?:erzeugt|generiert|erstellt)\b|generiert von\b|erzeugt von\b|(?:este )?(?:archivo|fichero) (?:fue |ha sido )?generado\b|generado (?:automáticamente )?por\b",
    re.IGNORECASE,
)
COMMENT = re.compile(r"\s*(?://+!?|/\*+!?|\*+(?!/)|#+!?|--+|;+|<!--|%+)\s*(.*)")
NUMBER = re.compile(r"(?<![\w.])(?:0[xX][0-9a-fA-F_]+|[-+]?\d[\d_]*\.?\d*(?:[eE][-+]?\d+)?)(?![\w.])")
RUN = re.compile(r"[A-Za-z0-9+/=_\-]{48,}|(?:\\x[0-9a-fA-F]{2}){12,}")
WORDS, SIMILAR, LEAST_SHINGLES = 5, 0.8, 12


@dataclass(frozen=True)
class Limits:
    """Thresholds of a language: a minified file has long lines and little space, a blob many literals or runs, or long lines of hardly anything but letters and digits."""

    mean_line: float = 160
    longest: int = 250
    space: float = 0.10
    numeric: float = 0.29
    runs: float = 0.50
    alnum: float = 0.88


LIMITS = {
    "js": Limits(mean_line=140, space=0.11), "mjs": Limits(mean_line=140, space=0.11), "css": Limits(mean_line=140, space=0.12),
    "java": Limits(mean_line=200), "sql": Limits(mean_line=400, longest=1000), "c": Limits(numeric=0.32), "h": Limits(numeric=0.32),
}


def measure(text: str) -> tuple[float, float, float, float, float, float]:
    """Longest line, mean length of the lines that are not blank, shares of white space, letters and digits, numeric literals, encoded runs."""
    n = len(text)
    if not n:
        return (0.0, 0.0, 0.0, 0.0, 0.0, 0.0)
    lengths = [len(x) for x in text.splitlines() if x and not x.isspace()]
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    kinds = _KIND[raw]
    space, alnum = int((kinds == 1).sum()), int((kinds == 2).sum())
    numeric = 0
    if int(((raw >= 48) & (raw <= 57)).sum()) * 8 > n:  # few digits make no numeric file
        numeric = sum(len(x) for x in NUMBER.findall(text))
    runs = sum(len(x) for x in RUN.findall(text)) if max(lengths, default=0) >= 48 else 0
    return (float(max(lengths, default=0)), sum(lengths) / max(1, len(lengths)), space / len(raw), alnum / len(raw), numeric / n, runs / n)


_KIND = np.zeros(256, dtype=np.uint8)
_KIND[[9, 10, 11, 12, 13, 32]] = 1
_KIND[[*range(48, 58), *range(65, 91), *range(97, 123)]] = 2


def has_header(text: str) -> bool:
    """A generator's note in the comments at the very top, however long they are; blank lines do not end them."""
    at, block = 0, False
    while at < len(text):
        end = text.find("\n", at)
        end = len(text) if end < 0 else end
        line, at = text[at:end], end + 1
        if not line.strip():
            continue
        m = COMMENT.match(line)
        if not m and not block:
            return False
        if HEADER.match(m[1] if m else line.strip()):
            return True
        opened = line.rfind("/*")
        block = line.find("*/", max(0, opened)) < 0 if block or opened >= 0 else False
    return False


def kind_by_layout(extension: str, text: str) -> str | None:
    """minified, blob, generated or none, by the content alone; only for languages of code."""
    if extension not in CODE or not text:
        return None
    limit = LIMITS.get(extension, Limits())
    longest, mean, space, alnum, numeric, runs = measure(text)
    if numeric >= limit.numeric or runs >= limit.runs or (alnum >= limit.alnum and space <= limit.space and longest >= limit.longest):
        return "blob"
    if longest >= limit.longest and mean >= limit.mean_line and space <= limit.space:
        return "minified"
    return "generated" if has_header(text) else None


def shingles(text: str) -> set[tuple[str, ...]]:
    w = re.findall(r"\w+", text)
    return set(zip(*(w[i:] for i in range(WORDS)), strict=False))


def kind_by_path(path: Column) -> Column:
    """vendored, generated or minified by folder and name, or null."""
    vendored = r"(?:^|/)(?:" + "|".join(re.escape(x) for x in VENDORED_DIRS) + ")/"
    output = r"(?:^|/)(?:" + "|".join(re.escape(x) for x in OUTPUT_DIRS) + ")/"
    return (
        F.when(path.rlike(vendored), "vendored").when(path.rlike(MINIFIED_NAMES), "minified").when(path.rlike(GENERATED_NAMES) | path.rlike(output), "generated")
    )


def content_kinds(contents: DataFrame, upstream: DataFrame, max_upstream_chars: int = 32_000_000) -> DataFrame:
    """path, content_kind: the kind of the newest content of each path, without moving any content.

    contents: path, content_hash, read_at_ms, content. upstream: content of known third-party files, reference
    items whose total length is checked against max_upstream_chars before they go to every task. The newest row
    has the greatest read_at_ms, then the greatest content_hash; null content is none.
    """
    spark = contents.sparkSession
    chars = upstream.agg(F.coalesce(F.sum(F.length("content")), F.lit(0))).first()[0]
    if chars > max_upstream_chars:
        raise ValueError(f"the reference files have {chars} characters; raise max_upstream_chars or split them")
    known = spark.sparkContext.broadcast([r["content"] for r in upstream.select("content").where("content is not null").collect()])
    index: dict = {}

    def near_copy(text: str) -> bool:
        if not index:
            sizes = []
            for k, t in enumerate(known.value):
                own = shingles(t)
                sizes.append(len(own))
                for s in own:
                    index.setdefault(s, []).append(k)
            index[None] = sizes
        own = shingles(text)
        if len(own) < LEAST_SHINGLES:
            return False
        shared = own & index.keys()
        if len(shared) < LEAST_SHINGLES * SIMILAR:
            return False
        count: dict[int, int] = {}
        for s in shared:
            for k in index[s]:
                count[k] = count.get(k, 0) + 1
        sizes = index[None]
        # the share of the shorter one that both have: copies with parts added or cut off count
        return any(c >= SIMILAR * max(LEAST_SHINGLES, min(len(own), sizes[k])) for k, c in count.items())

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds = []
            for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ext = path.rpartition(".")[2] if path else ""
                kind = kind_by_layout(ext, text or "")
                if text and ext in CODE and near_copy(text):
                    kind = "vendored"
                kinds.append(kind)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), pa.array(kinds, type=pa.string())], names=["path", "at", "hash", "kind"])

    src = contents.where(F.col("path").isNotNull()).select("path", "content", F.coalesce("read_at_ms", F.lit(-1)).cast("long").alias("at"), F.coalesce("content_hash", F.lit("")).alias("hash"))
    judged = src.mapInArrow(judge, "path string, at long, hash string, kind string")
    newest = judged.groupBy("path").agg(F.max(F.struct("at", "hash", F.coalesce("kind", F.lit("")).alias("kind"))).alias("m"))
    return newest.select("path", F.nullif(F.col("m.kind"), F.lit("")).alias("content_kind"))


def classify(files: DataFrame, contents: DataFrame, upstream: DataFrame) -> DataFrame:
    """path, project_code, kind: one row for each path of files; kind is null where the file was written by hand.

    files: path, project_code, last_seen_ms; of a repeated path the row seen last counts. Paths without any content
    are judged by path only, null paths are left out.
    """
    paths = files.where(F.col("path").isNotNull()).groupBy("path").agg(
        F.max_by("project_code", F.struct(F.coalesce("last_seen_ms", F.lit(-1)), F.coalesce("project_code", F.lit("")))).alias("project_code")
    )
    both = paths.join(content_kinds(contents, upstream), "path", "left")
    return both.select("path", "project_code", F.coalesce(F.col("content_kind"), kind_by_path(F.col("path"))).alias("kind"))
