"""Source operators: path rules, fact extraction from files, document sections, comments, similarity of feature hashes."""

from __future__ import annotations

import ast
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SYMBOL = "file string, kind string, name string, line long, end_line long, container string"
CALL = "file string, caller string, name string, line long"
#: Secret-bearing paths. Fixed values.
SECRET_PATH = r"(?i)(^|/)(\.ssh|\.gnupg|id_rsa[^/]*|id_ed25519[^/]*|\.env(\.[^/]*)?|[^/]*\.(pem|key|p12|pfx)|[^/]*(token|secret|credential)s?[^/]*\.(json|ya?ml|txt))(/|$)"
#: Declarations that plain patterns can find, by suffix. Fixed values.
DECLARATIONS = {"sql": r"(?im)^\s*create\s+(?:or\s+replace\s+)?(?:table|view|procedure)\s+(?:if\s+not\s+exists\s+)?([\w.]+)", "tf": r'(?m)^\s*(?:resource|module|variable)\s+"([^"]+)"', "": r"(?m)^\s*(?:public\s+|private\s+|static\s+|export\s+)*(?:class|interface|function|def|func)\s+(\w+)"}


def rule_pattern(rule: str) -> tuple[str, bool]:
    """A regular expression and whether it re-includes, for one ignore rule (*, **, ?, !, anchored, directory only)."""
    negated, rule = rule.startswith("!"), rule.lstrip("!")
    only_dir, rule = rule.endswith("/"), rule.rstrip("/")
    anchored, rule = "/" in rule, rule.lstrip("/")
    out = re.escape(rule).replace(r"\*\*/", "(.*/)?").replace(r"\*\*", ".*").replace(r"\*", "[^/]*").replace(r"\?", "[^/]")
    return f"^{'' if anchored else '(.*/)?'}{out}{'/.*' if only_dir else '(/.*)?'}$", negated


def ignored(paths: DataFrame, rules: list[str]) -> DataFrame:
    """paths (path) with whether the last matching rule ignores them; the rules are an expression, not a join."""
    out: Column = F.lit(False)
    for rule in rules:
        pattern, negated = rule_pattern(rule)
        out = F.when(F.col("path").rlike(pattern), F.lit(not negated)).otherwise(out)
    return paths.withColumn("ignored", out)


def eligible(paths: DataFrame, rules: list[str]) -> DataFrame:
    """Paths to be indexed: not ignored, not hidden, no build folders, no secrets."""
    kept = ignored(paths, rules).where("not ignored").drop("ignored")
    return kept.where(~F.col("path").rlike(r"(^|/)(\.[^/]+|node_modules|dist|build|target|__pycache__)(/|$)") & ~F.col("path").rlike(SECRET_PATH))


def python_symbols(files: DataFrame) -> DataFrame:
    """Classes and functions of Python files (file, text) by the standard parser; a file that fails gives no rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows: list[tuple] = []
            for file, text in zip(batch["file"], batch["text"], strict=True):
                try:
                    tree = ast.parse(text or "")
                except (SyntaxError, ValueError, RecursionError):
                    continue
                todo: list[tuple[ast.AST, str]] = [(tree, "")]
                while todo:
                    node, inside = todo.pop()
                    for child in ast.iter_child_nodes(node):
                        if isinstance(child, (ast.ClassDef, ast.FunctionDef, ast.AsyncFunctionDef)):
                            rows.append((file, "class" if isinstance(child, ast.ClassDef) else "function", child.name, child.lineno, child.end_lineno or child.lineno, inside))
                            todo.append((child, child.name))
                        else:
                            todo.append((child, inside))
            yield pd.DataFrame(sorted(rows), columns=["file", "kind", "name", "line", "end_line", "container"])

    return files.select("file", "text").mapInPandas(run, SYMBOL)


def python_calls(files: DataFrame) -> DataFrame:
    """Call sites of Python files (file, text): the called simple name, its line, and the innermost function around it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows: list[tuple] = []
            for file, text in zip(batch["file"], batch["text"], strict=True):
                try:
                    todo: list[tuple[ast.AST, str]] = [(ast.parse(text or ""), "")]
                except (SyntaxError, ValueError, RecursionError):
                    continue
                while todo:
                    node, inside = todo.pop()
                    if isinstance(node, ast.Call):
                        name = node.func.attr if isinstance(node.func, ast.Attribute) else getattr(node.func, "id", "")
                        if name:
                            rows.append((file, inside, name, node.lineno))
                    inside = node.name if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)) else inside
                    todo += [(c, inside) for c in ast.iter_child_nodes(node)]
            yield pd.DataFrame(sorted(rows), columns=["file", "caller", "name", "line"])

    return files.select("file", "text").mapInPandas(run, CALL)


def declared(files: DataFrame) -> DataFrame:
    """Names that the suffix's declaration pattern finds in files (file, text), in order: file, position, name."""
    pattern = F.lit(DECLARATIONS[""])
    for suffix, p in DECLARATIONS.items():
        if suffix:
            pattern = F.when(F.lower("file").endswith(f".{suffix}"), F.lit(p)).otherwise(pattern)
    return files.select("file", F.posexplode(F.regexp_extract_all("text", pattern, 1)).alias("position", "name"))


def sections(docs: DataFrame, most_chars: int = 1800) -> DataFrame:
    """Sections of documents (doc, text) under # headings, in chunks of about most_chars: doc, section, chunk, heading, first_line, last_line, chars."""
    lines = docs.select("doc", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    w = Window.partitionBy("doc").orderBy("i")
    is_head = F.col("line").rlike("^#{1,6} ")
    marked = lines.withColumn("section", F.sum(F.when(is_head, 1).otherwise(0)).over(w)).withColumn("heading", F.last(F.when(is_head, F.regexp_replace("line", "^#+ +", "")), ignorenulls=True).over(w))
    run = F.sum(F.length("line") + 1).over(Window.partitionBy("doc", "section").orderBy("i"))
    cut = marked.withColumn("chunk", F.floor((run - 1) / most_chars))
    return cut.groupBy("doc", "section", "chunk").agg(F.first("heading").alias("heading"), (F.min("i") + 1).alias("first_line"), (F.max("i") + 1).alias("last_line"), F.sum(F.length("line") + 1).alias("chars"))


def rationale(lines: DataFrame) -> DataFrame:
    """Comments that give reasons (file, line, text): kind, the text with up to three continuation lines, and ADR or RFC citations."""
    mark = r"^\s*(?:#|//|--|\*)?\s*(WHY|NOTE|HACK|TODO|FIXME|DECISION)\s*:\s*(.*)$"
    w = Window.partitionBy("file").orderBy("line")
    more = F.array(*[F.when(F.lead("text", k).over(w).rlike(r"^\s*(#|//|--|\*)\s"), F.regexp_replace(F.lead("text", k).over(w), r"^\s*(#|//|--|\*)\s*", "")) for k in (1, 2, 3)])
    run = F.slice(more, 1, F.coalesce(F.nullif(F.array_position(F.transform(more, lambda m: m.isNull()), True), F.lit(0)) - 1, F.lit(3)).cast("int"))
    told = lines.withColumn("more", run).where(F.col("text").rlike(mark))
    return told.select("file", "line", F.regexp_extract("text", mark, 1).alias("kind"), F.trim(F.concat_ws(" ", F.regexp_extract("text", mark, 2), F.array_join("more", " "))).alias("reason"), F.regexp_extract_all("text", F.lit(r"((?:ADR-|RFC )[0-9]+)"), 1).alias("cites"))


#: Tokens of documents whose features are counted together: bounds a task's memory, not the result.
MOST_TOKENS = 1 << 20


def _vectors(tokens: pa.ListArray, slots: int) -> np.ndarray:
    """The vectors of token lists: a feature is hashed once, its places are counted by arrays."""
    lengths = np.asarray(pc.fill_null(pc.list_value_length(tokens), 0))
    words = tokens.flatten().dictionary_encode()
    names, codes = words.dictionary.to_pylist(), np.asarray(words.indices).astype(np.int64)
    of = np.repeat(np.arange(len(lengths)), lengths)
    inside = np.flatnonzero(of[1:] == of[:-1])
    pairs, place = np.unique(codes[inside] * len(names) + codes[inside + 1], return_inverse=True)
    features = [*names, *(f"{names[p // len(names)]} {names[p % len(names)]}" for p in pairs.tolist())]
    hashed = np.fromiter((int.from_bytes(hashlib.blake2b(f.encode(), digest_size=8).digest(), "big") for f in features), np.uint64, len(features))
    met = np.concatenate([codes, place + len(names)])
    at = np.concatenate([of, of[inside]]) * slots + (hashed % np.uint64(slots)).astype(np.int64)[met]
    v = np.bincount(at, np.where(hashed & np.uint64(1), 1.0, -1.0)[met], len(lengths) * slots).reshape(len(lengths), slots)
    n = np.array([x**0.5 for x in (v * v).sum(axis=1).tolist()])
    v /= np.where(n == 0, 1.0, n)[:, None]
    scaled = v * 1e6
    out = np.rint(scaled) / 1e6
    for i, j in np.argwhere(np.abs(scaled - np.floor(scaled) - 0.5) < 1e-4):  # near a half the scaled value may tell the wrong side
        out[i, j] = round(float(v[i, j]), 6)
    return out


def feature_vector(text: Column, slots: int = 384) -> Column:
    """Unigrams and bigrams hashed by BLAKE2b-64 into slots, signed by the low bit, of length 1, rounded to 6 digits."""

    @F.arrow_udf("array<double>")
    def run(tokens: pa.Array) -> pa.Array:
        ends, parts, start = np.cumsum(np.asarray(pc.fill_null(pc.list_value_length(tokens), 0))), [], 0
        while start < len(tokens):
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + MOST_TOKENS, "right")))
            parts.append(_vectors(tokens.slice(start, stop - start), slots))
            start = stop
        flat = np.concatenate(parts).ravel() if parts else np.empty(0)
        return pa.ListArray.from_arrays(np.arange(0, len(flat) + 1, slots, dtype=np.int32), pa.array(flat))

    return run(text)
