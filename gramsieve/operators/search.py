"""Scans: every match of a pattern in a corpus (path, text), and the same over the files that an index names.

A match is (path, line, col, text): non-overlapping, leftmost first, the line from 1 and the column as byte offset from 1.
The scan defines the answer; the literals that a pattern needs go beside it as plain conditions, which reach the reader.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gramsieve.functions.dialect import PatternError, to_java, to_linear
from gramsieve.plans import literals as L

#: Pairs of marks; a text takes the first pair that it doesn't hold.
MARKS = (("\x01", "\x02"), ("﷐", "﷑"), ("﷒", "﷓"), ("﷔", "﷕"))


def valid_text(content: Column) -> Column:
    """Bytes as text, with U+FFFD for what isn't UTF-8."""
    return F.make_valid_utf8(content.cast("string"))


def _per_text(pattern: str, kind: str, count: Callable[[pa.Array], pa.Array]) -> Callable[[Column], Column]:
    """A function of texts by the linear-time engine, over Arrow batches."""

    @F.pandas_udf(kind)
    def run(text: pd.Series) -> pd.Series:
        return count(pa.array(text, pa.string())).to_pandas()

    return run


def _need(text: Column, pattern: str) -> Column | None:
    """The literals that any match needs, as conditions that reach the reader."""
    return L.holds(L.longer(L.required(pattern), 1), text.contains)


def matches_pattern(text: Column, pattern: str) -> Column:
    """Whether the text holds a match; with the literals that any match needs in front."""
    linear, need = to_linear(pattern), _need(text, pattern)
    hit = text.rlike(to_java(pattern)) if linear is None else _per_text(pattern, "boolean", lambda x: pc.match_substring_regex(x, linear))(text)
    return hit if need is None else need & hit


def count_matches(text: Column, pattern: str) -> Column:
    """How many matches the text holds."""
    linear, need = to_linear(pattern), _need(text, pattern)

    def marks(x: pa.Array) -> pa.Array:
        marked = pc.replace_substring_regex(x, f"({linear})", "\x01\\1")
        return pc.subtract(pc.count_substring(marked, "\x01"), pc.count_substring(x, "\x01"))

    if linear is None:
        n = F.regexp_count(text, F.lit(to_java(pattern)))
    else:
        n = _per_text(pattern, "int", marks)(text)
    return F.when(matches_pattern(text, pattern) if linear is None else F.lit(True) if need is None else need, F.coalesce(n, F.lit(0))).otherwise(0)


def matching_files(corpus: DataFrame, pattern: str, path: str = "path", text: str = "text") -> DataFrame:
    return corpus.filter(matches_pattern(F.col(text), pattern)).select(path)


def verify(candidates: DataFrame, pattern: str, file_id: str = "file_id", text: str = "text") -> DataFrame:
    """The ids of the candidate files that match; none if the pattern isn't valid."""
    try:
        return candidates.filter(matches_pattern(F.col(text), pattern)).select(file_id)
    except PatternError:
        return candidates.select(file_id).limit(0)


def _marks(text: Column) -> Column:
    """The first pair of marks that the text doesn't hold; if it holds all, marks with the text's own digest in them."""
    digest = F.sha2(text.cast("binary"), 256)
    chosen = F.array(F.concat(F.lit("<"), digest, F.lit("<")), F.concat(F.lit(">"), digest, F.lit(">")))
    for a, b in reversed(MARKS):
        chosen = F.when(~text.contains(a) & ~text.contains(b), F.array(F.lit(a), F.lit(b))).otherwise(chosen)
    return chosen


def _places(marked: bytes, begin: bytes, end: bytes) -> Iterator[tuple[int, int, bytes]]:
    """(line, column, match) of a text with its matches between marks, in one pass; an empty match that touches the match before
    it is none."""
    pieces = marked.split(begin)
    line, col, apart = 1 + pieces[0].count(b"\n"), len(pieces[0]) - pieces[0].rfind(b"\n"), True
    for piece in pieces[1:]:
        hit, _, rest = piece.partition(end)
        if hit or apart:
            yield line, col, hit
        whole = hit + rest
        new = whole.count(b"\n")
        line, col = line + new, len(whole) - whole.rfind(b"\n") if new else col + len(whole)
        apart = bool(rest) or not hit


def find_matches(corpus: DataFrame, pattern: str, path: str = "path", text: str = "text") -> DataFrame:
    """All matches as (path, line, col, text).

    Spark's expressions find the texts and put each match between marks; Arrow batches turn marks into lines and columns in one
    pass over a text, so the work grows with the text and not with its square. A null text has no match.
    """
    t, linear = F.col("__t"), to_linear(pattern)
    need = _need(F.col(text), pattern)
    hit = matches_pattern(F.col(text), pattern) if linear is None else F.lit(True) if need is None else need
    x = corpus.filter(hit & F.col(text).isNotNull()).select(F.col(path).alias("path"), F.col(text).cast("string").alias("__t"))
    x = x.withColumn("__m", _marks(t))
    if linear is None:
        t = F.regexp_replace(t, F.lit(f"({to_java(pattern)})"), F.concat(F.col("__m")[0], F.lit("$1"), F.col("__m")[1]))
    x = x.select("path", t.alias("__t"), F.col("__m")[0].alias("__a"), F.col("__m")[1].alias("__b"))
    kind = T.StructType([x.schema["path"], T.StructField("line", T.LongType()), T.StructField("col", T.LongType()), T.StructField("text", T.StringType())])

    def batch_of(paths: pa.Array, rows: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
        of, line, col, found = zip(*rows, strict=True) if rows else ((), (), (), ())
        return pa.RecordBatch.from_arrays([paths.take(pa.array(of, pa.int64())), pa.array(line, pa.int64()), pa.array(col, pa.int64()), pa.array(found, pa.binary()).cast(pa.string())], names=["path", "line", "col", "text"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple[int, int, int, bytes]] = []
            for i in range(batch.num_rows):
                value, a, b = (batch.column(k)[i].as_py() for k in (1, 2, 3))
                if linear is not None:
                    value = pc.replace_substring_regex(pa.array([value]), f"({linear})", f"{a}\\1{b}")[0].as_py()
                for place in _places(value.encode(), a.encode(), b.encode()):
                    rows.append((i, *place))
                    if len(rows) >= 1 << 16:
                        yield batch_of(batch.column(0), rows)
                        rows = []
            if rows:
                yield batch_of(batch.column(0), rows)

    return x.mapInArrow(run, kind)


def ordered(matches: DataFrame) -> DataFrame:
    return matches.orderBy("path", "line", "col", "text")


def scan_stats(corpus: DataFrame, pattern: str, path: str = "path", text: str = "text") -> DataFrame:
    """One row: files and bytes scanned, files that match and matches, in one pass."""
    n = count_matches(F.col(text), pattern)
    return corpus.select(F.octet_length(text).alias("b"), n.alias("n")).agg(
        F.count("*").alias("files_scanned"),
        F.sum("b").cast("long").alias("bytes_scanned"),
        F.count_if(F.col("n") > 0).alias("files_matched"),
        F.sum("n").cast("long").alias("matches"),
    )


def format_matches(matches: DataFrame) -> DataFrame:
    """Printed lines: path:line:column: text."""
    return matches.select(F.concat_ws(":", "path", "line", "col", F.concat(F.lit(" "), "text")).alias("line_out"))


def scan_many(corpus: DataFrame, patterns: dict[str, str], path: str = "path", text: str = "text") -> DataFrame:
    """(pattern, files, matches) of several patterns in one pass over the corpus."""
    parts = [count_matches(F.col(text), p) for p in patterns.values()]
    counts = corpus.agg(*[c for i, n in enumerate(parts) for c in (F.count_if(n > 0).alias(f"f{i}"), F.sum(n).cast("long").alias(f"m{i}"))])
    rows = F.array(*[F.struct(F.lit(k).alias("pattern"), F.col(f"f{i}").alias("files"), F.col(f"m{i}").alias("matches")) for i, k in enumerate(patterns)])
    return counts.select(F.inline(rows))
