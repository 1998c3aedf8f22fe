"""Licence scan: sparse TF-IDF cosine of headers and licence files to templates, then inheritance by directory.

Every window of one line and of ``WINDOW`` lines of a text is a candidate header; the whole text is one too, and a file named
as a licence file speaks for its directory. Tokens are runs of ASCII letters and
digits or bytes of other scripts, lower-cased. Inverse document frequencies of the templates' terms come from all documents;
terms that no template holds count with the frequency of none. Frequencies of more than ``SCALE`` documents count as the same
shares of so many, so that a word without a template doesn't outgrow the notice around it as the corpus grows. Only windows whose terms can reach the threshold are scored.

A window speaks for the template that it is closest to, of which it holds two terms or all, and says nothing if that is a wording without a licence's name. Of
the windows that speak, those naming a licence come before those naming a family without its version, and both before a
reservation of all rights.

A file without a licence of its own takes that of the nearest directory above it that has one. Directories and not files are
joined with their ancestors; files then look up their directory with salted keys, as one may hold a third of all files.

Defined results: null and empty texts have no licence of their own; a null path lies in no directory and inherits nothing;
ties of a window go to the first template in order of name, ties of windows likewise, then to the first line, and in a directory to the best score, then the least
path; repeated rows are scanned alike; empty tables give empty tables. Columns named as the output are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gramsieve.llm import shingles
from gramsieve.llm.common import cut, salted_lookup, without
from gramsieve.llm.licence_texts import FAMILIES, NAMELESS, RESERVED, TEMPLATES, VARIANTS
from gramsieve.shipping import ship

WINDOW, LEAST = 3, 0.7
#: Documents to which the frequencies of a larger corpus are scaled.
SCALE = 1000
#: Names of licence files, without endings.
NAMES = "license|licence|copying|unlicense|notice"
_OTHER = np.ones(256, bool)
_OTHER[list(b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")] = False
_OTHER[128:] = False


def tokens(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and line numbers (from 0) of a text's tokens."""
    b = np.frombuffer(data, np.uint8)
    solid = ~_OTHER[b]
    if not solid.any():
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    start = np.flatnonzero(solid & ~np.append(False, solid[:-1]))
    spaced = np.where(solid, b, np.uint8(32)).tobytes()
    return shingles.word_hashes(spaced), np.searchsorted(np.flatnonzero(b == 10), start)


def present(terms: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Places of the terms that occur among the hashes."""
    at = np.minimum(np.searchsorted(terms, h), len(terms) - 1)
    return np.unique(at[terms[at] == h])


#: All templates in order of name, reservations and nameless wordings after them.
_ALL = (*sorted((*TEMPLATES, *VARIANTS)), *RESERVED, *((None, t) for t in NAMELESS))


class Model:
    """Template vectors over their own terms, by inverse document frequency."""

    def __init__(self, df: dict[int, int], n_docs: int):
        self.names = [n for n, _ in _ALL]
        reserved = {n for n, _ in RESERVED}
        self.tier = np.array([3 if n is None else 2 if n in reserved else int(n in FAMILIES) for n in self.names])
        found = [tokens(t.encode())[0] for _, t in _ALL]
        self.terms = np.unique(np.concatenate(found))
        n = min(n_docs, SCALE)
        held = np.array([df.get(int(t.astype(np.int64)), 0) for t in self.terms]) * (n / max(n_docs, 1))
        self.idf = np.log((1 + n) / (1 + held)) + 1
        self.none = np.log(1 + n) + 1
        self.counts = np.zeros((len(self.terms), len(found)), np.uint8)
        for j, f in enumerate(found):
            np.add.at(self.counts[:, j], np.searchsorted(self.terms, f), 1)
        self._weigh()

    def _weigh(self) -> None:
        self.fewest = np.minimum((self.counts > 0).sum(axis=0), 2)
        self.vectors = self.counts * self.idf[:, None]
        self.vectors /= np.sqrt((self.vectors**2).sum(axis=0))

    def __getstate__(self) -> dict:
        """Travels with the counts alone, an eighth of the weights' size."""
        return {k: v for k, v in self.__dict__.items() if k != "vectors"}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._weigh()

    def closest(self, unit: np.ndarray, h: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The units that reach ``least``, with their closest templates and cosines.

        A unit's cosine is at most the norm of its known terms over its own, so other units aren't scored.
        """
        at = np.minimum(np.searchsorted(self.terms, h), len(self.terms) - 1)
        known = self.terms[at] == h
        some = np.unique(unit[known])
        keep = np.isin(unit, some)
        unit, h, at, known = np.searchsorted(some, unit[keep]), h[keep], at[keep], known[keep]
        by = np.lexsort((h, unit))
        unit, h, at, known = unit[by], h[by], at[by], known[by]
        first = np.flatnonzero(np.append(True, (np.diff(unit) != 0) | (h[1:] != h[:-1]))[: len(h)])
        tf = np.diff(np.append(first, len(h)))
        unit, at, known = unit[first], at[first], known[first]
        value = tf * np.where(known, self.idf[at], self.none)
        norm = np.sqrt(np.bincount(unit, value**2, minlength=len(some)))
        held = np.sqrt(np.bincount(unit[known], value[known] ** 2, minlength=len(some)))
        units, best, cosine = [], [], []
        unit, at, value = unit[known], at[known], value[known]
        for u in np.flatnonzero(held >= (least - 1e-9) * norm):
            part = slice(*np.searchsorted(unit, [u, u + 1]))
            held_in = self.vectors[at[part]]
            # one shared word, like a German 'Mit.', names no licence of several words
            cos = np.where((held_in > 0).sum(axis=0) >= self.fewest, value[part] @ held_in / norm[u], 0.0)
            j = int(cos.argmax())
            # equal sums may differ in their last bits
            j = int(np.flatnonzero(cos >= cos[j] - 1e-12)[0])
            if cos[j] >= least:
                units.append(some[u])
                best.append(j)
                cosine.append(cos[j])
        return np.array(units, np.int64), np.array(best, np.int64), np.array(cosine)

    def scan(self, data: bytes, least: float = LEAST) -> tuple[str | None, float, int]:
        """The best licence, its score and line (from 1), if a window reaches ``least``.

        A window's cosine to a template is at most the norm of the template over the terms that the window holds, so a text
        whose terms together hold less of every template has no window to score.
        """
        h, line = tokens(data)
        best, rank = (None, 0.0, 0), 3
        if np.sqrt((self.vectors[present(self.terms, h)] ** 2).sum(axis=0)).max() < least - 1e-9:
            return best
        for width in (1, WINDOW, 0):
            unit = np.concatenate([line - o for o in range(width)]) if width else np.zeros(len(h), np.int64)
            some, at, cos = self.closest(unit, np.tile(h, width or 1), least)
            if not len(some):
                continue
            i = np.lexsort((some, at, -cos, self.tier[at]))[0]
            tier = int(self.tier[at[i]])
            if tier < rank or (tier == rank < 3 and cos[i] > best[1] + 1e-12):
                best, rank = (self.names[at[i]], float(cos[i]), max(int(some[i]), 0) + 1), tier
        return best


def frequencies(df: DataFrame, text: str) -> tuple[dict[int, int], int]:
    """In how many documents each template term occurs, over all of them, and how many there are; as many sums as terms."""
    terms = np.unique(np.concatenate([tokens(t.encode())[0] for _, t in _ALL]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, n = np.zeros(len(terms), np.int64), 0
        for batch in batches:
            for x in batch.column(0).to_pylist():
                n += 1
                if x:
                    count[present(terms, tokens(x.encode())[0])] += 1
        yield pa.RecordBatch.from_arrays([pa.array(np.append(terms.view(np.int64), 0)), pa.array(np.append(count, n)), pa.array([False] * len(terms) + [True])], names=["term", "n", "total"])

    rows = df.select(F.col(text).cast("string")).mapInArrow(run, "term long, n long, total boolean").groupBy("term", "total").agg(F.sum("n").alias("n")).collect()
    return {r.term: r.n for r in rows if not r.total}, sum(r.n for r in rows if r.total)


def scan(df: DataFrame, path: str = "path", text: str = "text", least: float = LEAST) -> DataFrame:
    """Adds ``licence``, ``score``, ``line``, ``origin`` (own, inherited or null) and ``origin_dir``."""
    ship(df.sparkSession)
    added = ["licence", "score", "line", "origin", "origin_dir", "__dir", "__up"]
    df = without(df, added)
    model = Model(*frequencies(df, text))
    names = df.columns
    kind = T.StructType([*df.schema.fields, *(T.StructField(n, t) for n, t in (("licence", T.StringType()), ("score", T.DoubleType()), ("line", T.IntegerType())))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                found = [model.scan((x or "").encode(), least) for x in batch.column(names.index(text)).to_pylist()]
                hit = [f[1] >= least for f in found]
                columns = [[f[0] if ok else None for f, ok in zip(found, hit)], [f[1] if ok else None for f, ok in zip(found, hit)], [f[2] if ok else None for f, ok in zip(found, hit)]]
                arrays = [pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.float64(), pa.int32()))]
                yield pa.RecordBatch.from_arrays([*batch.columns, *arrays], names=[*names, "licence", "score", "line"])

    p = F.col(path).cast("string")
    folder = F.when(p.contains("/"), F.regexp_replace(p, "/[^/]*$", "")).otherwise(F.when(p.isNotNull(), F.lit("")))
    own = df.mapInArrow(run, kind).withColumn("__dir", folder)
    # licence files are told by their names, so only their texts are scanned for this side
    files = df.filter(p.rlike(f"(?i)(^|/)({NAMES})(\\.[^/]*)?$")).mapInArrow(run, kind).filter("licence IS NOT NULL")
    bests = cut(files.groupBy(folder.alias("up")).agg(F.max(F.struct("score", "licence")).alias("best")))
    dirs = df.select(folder.alias("__dir")).filter("__dir IS NOT NULL").distinct()
    # each directory with all that lie above it, itself included; the root is the empty name and above all, so it is dealt out
    parts = F.split("__dir", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.struct(i.alias("depth"), F.array_join(F.slice(parts, 1, i), "/").alias("up")))
    met = dirs.select("__dir", F.explode(above).alias("a")).select("__dir", "a.depth", F.col("a.up").alias("up"))
    met = salted_lookup(met, bests, ["up"], F.col("__dir")).filter("best IS NOT NULL")
    near = met.groupBy("__dir").agg(F.max_by(F.struct(F.col("up"), F.col("best.licence").alias("l"), F.col("best.score").alias("s")), "depth").alias("__up"))
    out = salted_lookup(own, near, ["__dir"], F.coalesce(p, F.lit("")))
    mine = F.col("licence").isNotNull()
    out = out.withColumns(
        {
            "origin": F.when(mine, "own").when(F.col("__up").isNotNull(), "inherited"),
            "origin_dir": F.when(mine, F.col("__dir")).otherwise(F.col("__up.up")),
            "licence": F.coalesce("licence", "__up.l"),
            "score": F.coalesce("score", "__up.s"),
        }
    )
    return out.drop("__dir", "__up")
