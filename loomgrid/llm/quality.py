"""Quality rules: counts per document, then robust multivariate outliers per language and source.

The counts come from one vectorised scan of the whole texts. Transformed rates of the documents that
pass the base rule form a vector. Minimum-covariance-determinant (MCD) estimates of its centre and scatter
are found for every (language, source), every language and all documents; a document is rejected where its
Mahalanobis distance under the estimate of its own (language, source) is beyond ``CUTOFF``.

The estimates are concentration steps written as aggregations: distances fall into narrow fixed classes, the
sums and products of each (group, class) are added up exactly in integers, and the closest classes that
hold the kept share of the rows give the next centre and scatter. Every step covers all rows, no group is
ever gathered, and the result does not depend on the order of rows. Four starts are run (full scatter,
diagonal scatter, medians with median deviations, and these with the correlations of spatial signs) for two
steps on half of the rows and one on ``SHARE`` of them; the two with the smallest determinants go on until
no group's determinant changes, and the one with the smallest is kept. Estimates of few rows are shrunk: a (language, source) of n rows has weight n / (n + ``PRIOR_ROWS``)
against its language, and a language against all documents, so every group has one and none is skipped.

Defined cases: null or empty text has no words and fails the base rule; null languages and sources form
groups of their own; repeated rows count as often as they occur and get equal verdicts; a distance that
ties with the cutoff is kept; distances that tie at the edge of the kept share are all kept; an empty table
gives an empty result; other columns are ignored. A long text is scanned in pieces; what is held of it is
about 25 bytes for each of its words.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textbatch as tb
from .store import cut, drop

MIN_WORDS = 50
#: Share of the rows that the concentration steps keep, and those of the first steps.
SHARE = 0.75
FIRST_SHARES = (0.5, 0.5)
#: Steps at most; an estimate that has not settled by then is taken as it is.
STEPS = 12
#: Starts that go on after the first steps, and the change of a log determinant below which an estimate has settled.
BEST, SETTLED = 2, 0.02
#: Rows by which an estimate is drawn towards the next wider one.
PRIOR_ROWS = 100
#: Share of normal documents beyond the cutoff.
TAIL = 1e-8


def cutoff(tail: float = TAIL, parts: int = 6) -> float:
    """The distance that so small a share of normal vectors exceeds: the root of a chi-square quantile (even ``parts``)."""
    lo, hi = 0.0, 1000.0
    for _ in range(80):
        x = (lo + hi) / 2
        beyond = math.exp(-x / 2) * sum((x / 2) ** k / math.factorial(k) for k in range(parts // 2))
        lo, hi = (x, hi) if beyond > tail else (lo, x)
    return math.sqrt(hi)


#: Vectors are integers in units of 1 / GRID, so that sums are exact.
GRID = 512
VECTOR = ("mean_length", "symbols", "dup_lines", "repeats", "capitals", "marks")
#: Least standard deviation of each part: most texts have none of some of these, whose own spread is nil.
#: A part alone moves a text by at most its range over this, which must be able to exceed CUTOFF after the base rule.
FLOORS = (0.1, 0.08, 0.1, 0.1, 0.1, 0.08)
CUTOFF = cutoff(parts=len(VECTOR))
#: Products of signs are added up in units of 1 / SIGN_GRID.
SIGN_GRID = 1 << 20
#: Classes of squared distances for each doubling.
CLASSES = 32
_SYMBOLS = tb.table_of(lambda b: chr(b) in "#*$%&|<>")
_UPPER = tb.table_of(lambda b: 65 <= b <= 90)
_LETTER = tb.table_of(lambda b: 65 <= b <= 90 or 97 <= b <= 122)
_MARK = tb.table_of(lambda b: 33 <= b <= 126 and not chr(b).isalnum() and chr(b) not in ".,")
#: The first byte of every character that may stand in a word.
_WORD_CHAR = tb.NON_SPACE & tb.table_of(lambda b: b & 0xC0 != 0x80)
_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_marks")


def count_slice(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """The columns of ``_COUNTS`` for the texts of a buffer."""
    n = len(offsets) - 1
    n_words, hashes = tb.word_hashes(data, offsets, tb.NON_SPACE)
    rows = np.repeat(np.arange(n, dtype=np.int32), n_words)

    def per_row(member: np.ndarray) -> np.ndarray:
        """Bytes of each text that a table of 256 entries picks."""
        if n == 1:
            return np.array([sum(int(np.count_nonzero(member[data[k : k + (1 << 20)]])) for k in range(0, len(data), 1 << 20))])
        total = np.concatenate(([0], np.cumsum(member[data], dtype=np.int64)))
        return total[offsets[1:]] - total[offsets[:-1]]

    def repeated(keys: np.ndarray) -> np.ndarray:
        """Sorted keys that occur twice or more."""
        keys = np.sort(keys)
        return np.unique(keys[1:][keys[1:] == keys[:-1]])

    def keyed(values: np.ndarray, own: np.ndarray) -> np.ndarray:
        return values if n == 1 else tb.mix(values + own.astype(np.uint64) * np.uint64(0xA24BAED4963EE407))

    repeat = np.zeros(n, np.int64)
    if len(hashes) >= 3:
        grams = tb.window_hashes(hashes, 3)
        own = np.flatnonzero(rows[2:] == rows[:-2]) if n > 1 else slice(None)
        keys = keyed(grams, rows[: len(grams)])[own]
        twice = repeated(keys)
        if len(twice):
            hit = twice[np.minimum(np.searchsorted(twice, keys), len(twice) - 1)] == keys
            hit = np.flatnonzero(hit) if n == 1 else own[hit]
            cover = np.zeros(len(hashes), bool)
            for k in range(3):
                cover[hit + k] = True
            repeat = np.bincount(rows[cover], minlength=n)
    breaks = np.flatnonzero(data == 10)
    starts = np.sort(np.concatenate((offsets[:-1], breaks + 1)))
    # A line ends at the next line break of its text or at the text's end.
    ends = np.sort(np.concatenate((offsets[1:], breaks)))
    starts, ends = starts[ends > starts], ends[ends > starts]
    if len(starts):
        real = np.logical_or.reduceat(tb.NON_SPACE[data], starts)  # what stands between two lines is a line break
        starts, ends = starts[real], ends[real]
    line_rows = np.searchsorted(offsets, starts, side="right") - 1
    keys = keyed(tb.span_hashes(data, starts, ends), line_rows)
    later = np.ones(len(keys), bool)
    later[np.unique(keys, return_index=True)[1]] = False
    return [
        n_words, per_row(_WORD_CHAR), per_row(_SYMBOLS), np.bincount(line_rows[later], minlength=n), repeat,
        np.bincount(line_rows, minlength=n), per_row(_UPPER), per_row(_LETTER), per_row(_MARK),
    ]


def counts(docs: DataFrame, columns: list[str]) -> DataFrame:
    """``columns`` of the documents with the counts of their column ``text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in tb.slices(batches, "text"):
            made = count_slice(*tb.text_buffer(part.column("text")))
            yield pa.RecordBatch.from_arrays(
                [*(part.column(c) for c in columns), *(pa.array(m, pa.int64()) for m in made)], names=[*columns, *_COUNTS]
            )

    fields = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in columns)
    return docs.mapInArrow(run, fields + ", " + ", ".join(f"{c} long" for c in _COUNTS))


def _vector() -> list:
    """Parts of the vector, as integers on the grid."""
    words, root = F.greatest(F.col("n_words"), F.lit(1)), lambda c: F.asin(F.sqrt(F.least(c, F.lit(1.0))))
    parts = {
        "mean_length": F.log(F.greatest(F.col("word_chars"), F.lit(1)) / words),
        "symbols": F.sqrt(F.col("n_symbols") / words),
        "dup_lines": root(F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))),
        "repeats": root(F.col("n_repeat_words") / words),
        "capitals": root(F.col("n_upper") / F.greatest(F.col("n_letters"), F.lit(1))),
        "marks": F.sqrt(F.col("n_marks") / words),
    }
    return [F.round(parts[name] * GRID).cast("long").alias(name) for name in VECTOR]


_PAIRS = [(i, j) for i in range(len(VECTOR)) for j in range(i, len(VECTOR))]
_KEYS = ["level", "lang_key", "source_key"]
_RAW = "level int, lang_key string, source_key string, start int, n long, kept long, centre array<double>, scatter array<double>, det double, scale double, settled boolean"


def _sums() -> list:
    return [
        F.count("*").alias("n"),
        *(F.sum(v).alias(f"s{i}") for i, v in enumerate(VECTOR)),
        *(F.sum(F.col(VECTOR[i]) * F.col(VECTOR[j])).alias(f"p{i}_{j}") for i, j in _PAIRS),
    ]


def moments(n: int, sums, products) -> tuple[np.ndarray, np.ndarray]:
    """Centre and scatter from exact sums on the grid."""
    p = len(VECTOR)
    centre, scatter = np.array([float(s) for s in sums]) / n, np.zeros((p, p))
    for (i, j), s in zip(_PAIRS, products):
        scatter[i, j] = scatter[j, i] = float(s) / n - centre[i] * centre[j]
    return centre, scatter


def _row(key, start: int, n: int, kept: int, centre, scatter, scale: float, settled: bool) -> tuple:
    det = float(np.linalg.slogdet(scatter + np.diag((np.array(FLOORS) * GRID) ** 2))[1])
    return (*key, start, n, kept, np.asarray(centre).tolist(), np.asarray(scatter).ravel().tolist(), det, scale, settled)


def _frame(rows):
    import pandas as pd

    return pd.DataFrame(rows, columns=[x.split()[0] for x in _RAW.split(", ")])


def _starts(parts):
    """Classical, diagonal, median and spatial-sign estimates of each group."""
    for pdf in parts:
        out = []
        for r in pdf.itertuples(index=False):
            key = (r.level, r.lang_key, r.source_key)
            centre, scatter = moments(r.n, [getattr(r, f"s{i}") for i in range(len(VECTOR))], [getattr(r, f"p{i}_{j}") for i, j in _PAIRS])
            out.append(_row(key, 0, r.n, 0, centre, scatter, 1.0, False))
            out.append(_row(key, 1, r.n, 0, centre, np.diag(np.diag(scatter)), 1.0, False))
            width = 1.4826 * np.asarray(r.deviation, float) + np.array(FLOORS) * GRID
            out.append(_row(key, 2, r.n, 0, r.median, np.diag(width**2), 1.0, False))
            signs = np.zeros((len(VECTOR), len(VECTOR)))
            for (i, j), s in zip(_PAIRS, r.signs):
                signs[i, j] = signs[j, i] = s / SIGN_GRID / r.n * len(VECTOR)
            out.append(_row(key, 3, r.n, 0, r.median, signs * np.outer(width, width), 1.0, False))
        yield _frame(out)


def _concentrate(rows: DataFrame, used: DataFrame, share: float, first: bool) -> DataFrame:
    """One step: from distance classes to the estimates over the closest ``share`` of each group's rows."""
    group, klass = [*_KEYS, "start"], F.floor(F.log2(1 + _squared_distance()) * CLASSES).cast("int").alias("klass")
    classes = rows.join(used, _KEYS).groupBy(*group, klass).agg(*_sums(), F.first("before").alias("before"))
    # A group's classes are a bounded few, so windows over them are too.
    upto, total = F.sum("n").over(Window.partitionBy(*group).orderBy("klass")), F.sum("n").over(Window.partitionBy(*group))
    classes = classes.withColumns({"upto": upto, "total": total})
    inside = F.col("upto") - F.col("n") < F.ceil(F.lit(share) * F.col("total"))
    added = [c for c in classes.columns if c[0] in "sp" and c[1:2].isdigit()]
    sums = classes.groupBy(*group).agg(
        F.max("total").alias("n"), F.sum(F.when(inside, F.col("n"))).alias("kept"), F.first("before").alias("before"),
        F.min(F.when(F.col("upto") >= F.ceil(F.col("total") / 2), F.col("klass"))).alias("middle"), *(F.sum(F.when(inside, F.col(c))).alias(c) for c in added),
    )
    return sums.mapInPandas(lambda parts: _settled(parts, first), _RAW)


def _settled(parts, first: bool):
    """Raw estimates from the sums of the rows kept, and whether they have settled."""
    p = len(VECTOR)
    for pdf in parts:
        out = []
        for r in pdf.itertuples(index=False):
            centre, scatter = moments(r.kept, [getattr(r, f"s{i}") for i in range(p)], [getattr(r, f"p{i}_{j}") for i, j in _PAIRS])
            # How far the median squared distance is above that of a chi-square variable.
            squared = 2.0 ** ((r.middle + 0.5) / CLASSES) - 1
            scale = max(1.0, squared / (p * (1 - 2 / (9 * p)) ** 3))
            row = _row((r.level, r.lang_key, r.source_key), r.start, r.n, r.kept, centre, scatter, scale, False)
            out.append((*row[:-1], not first and abs(row[-3] - r.before) < SETTLED))
        yield _frame(out)


def shrink(centre, scatter, scale: float, n: int, above: tuple | None, prior_rows: float = PRIOR_ROWS) -> tuple[np.ndarray, np.ndarray, float]:
    """An estimate drawn towards the next wider one by its number of rows."""
    if above is None:
        return centre, scatter, scale
    w, (c, s, k) = n / (n + prior_rows), above
    return w * centre + (1 - w) * c, w * scatter + (1 - w) * s, w * scale + (1 - w) * k


_USED = "level int, lang_key string, source_key string, start int, before double, centre array<double>, inverse array<double>, log_det double, scale double"


def _shrunk(parts, prior_rows: float):
    """Rows with the raw estimates of a group and of the wider ones: what distances are measured by."""
    import pandas as pd

    p, names = len(VECTOR), [x.split()[0] for x in _USED.split(", ")]
    for pdf in parts:
        out = []
        for r in pdf.itertuples(index=False):
            used = None
            for k in range(2, r.level - 1, -1):
                centre, scatter = np.array(getattr(r, f"centre{k}")), np.array(getattr(r, f"scatter{k}")).reshape(p, p)
                used = shrink(centre, scatter, getattr(r, f"scale{k}"), getattr(r, f"n{k}"), used, prior_rows)
            scatter = used[1] + np.diag((np.array(FLOORS) * GRID) ** 2)
            inverse, det = np.linalg.inv(scatter), float(np.linalg.slogdet(scatter)[1])
            out.append((r.level, r.lang_key, r.source_key, r.start, r.det, used[0].tolist(), inverse.ravel().tolist(), det, used[2]))
        yield pd.DataFrame(out, columns=names)


def _used(raw: DataFrame, prior_rows: float) -> DataFrame:
    """The estimates in use, from raw ones of all levels."""
    fields = ("centre", "scatter", "scale", "n")
    wider = lambda k, on: raw.where(F.col("level") == k).select(*on, "start", *(F.col(f).alias(f"{f}{k}") for f in fields))
    rows = raw.join(wider(2, []), "start").join(wider(1, ["lang_key"]), ["lang_key", "start"], "left")
    own = [F.when(F.col("level") == 0, F.col(f)).alias(f"{f}0") for f in fields]
    names = [f"{f}{k}" for k in (1, 2) for f in fields]
    return rows.select(*_KEYS, "start", "det", *own, *names).mapInPandas(lambda parts: _shrunk(parts, prior_rows), _USED)


def _squared_distance():
    """Squared Mahalanobis distance of the row's vector under the joined estimate."""
    p = len(VECTOR)
    d = [F.col(v) - F.col("centre")[i] for i, v in enumerate(VECTOR)]
    terms = [d[i] * d[j] * F.col("inverse")[i * p + j] * (1 if i == j else 2) for i, j in _PAIRS]
    return F.greatest(sum(terms[1:], terms[0]), F.lit(0.0))


def estimates(vectors: DataFrame, prior_rows: float = PRIOR_ROWS) -> DataFrame:
    """(level, lang_key, source_key, centre, inverse, scale): level 0 is a (language, source), 1 a language, 2 all rows."""
    none = F.lit("")
    level = F.explode(
        F.array(
            F.struct(F.lit(0).alias("level"), F.col("lang_key"), F.col("source_key")),
            F.struct(F.lit(1).alias("level"), F.col("lang_key"), none.alias("source_key")),
            F.struct(F.lit(2).alias("level"), none.alias("lang_key"), none.alias("source_key")),
        )
    ).alias("g")
    rows = vectors.select(level, *VECTOR).select("g.*", *VECTOR)
    # Medians of grid values are exact and bounded: a group holds each distinct value once.
    medians = rows.groupBy(*_KEYS).agg(*_sums(), F.array(*(F.percentile(v, 0.5) for v in VECTOR)).alias("median"))
    medians = cut(medians, "quality-medians")
    gaps = rows.join(medians.select(*_KEYS, "median"), _KEYS)
    gaps = gaps.groupBy(*_KEYS).agg(F.array(*(F.percentile(F.abs(F.col(v) - F.col("median")[i]), 0.5) for i, v in enumerate(VECTOR))).alias("deviation"))
    robust = cut(medians.join(gaps, _KEYS), "quality-deviations")
    rows_ = rows.join(robust.select(*_KEYS, "median", "deviation"), _KEYS)
    z = [(F.col(v) - F.col("median")[i]) / (1.4826 * F.col("deviation")[i] + FLOORS[i] * GRID) for i, v in enumerate(VECTOR)]
    square = sum((x * x for x in z[1:]), z[0] * z[0])
    signs = [F.sum(F.round(F.coalesce(F.try_divide(z[i] * z[j], square), F.lit(0.0)) * SIGN_GRID).cast("long")) for i, j in _PAIRS]
    robust = robust.join(rows_.groupBy(*_KEYS).agg(F.array(*signs).alias("signs")), _KEYS)
    raw = cut(robust.mapInPandas(_starts, _RAW), "quality-step")
    drop(medians)
    for k in range(STEPS):
        share = FIRST_SHARES[k] if k < len(FIRST_SHARES) else SHARE
        used = _used(raw, prior_rows).select(*_KEYS, "start", "before", "centre", "inverse")
        step = _concentrate(rows, used, share, k <= len(FIRST_SHARES))
        if k == len(FIRST_SHARES):  # the best starts get the numbers 0 and on, in every group alike
            place = F.row_number().over(Window.partitionBy(*_KEYS).orderBy("det", "start")) - 1
            step = step.withColumn("start", place).where(F.col("start") < BEST)
        step = cut(step, "quality-step")
        drop(raw)
        raw = step
        if raw.where(~F.col("settled")).isEmpty():
            break
    best = F.min_by(F.struct("centre", "inverse", "scale"), F.struct("log_det", "start")).alias("e")
    out = cut(_used(raw, prior_rows).groupBy(*_KEYS).agg(best), "quality-best")
    drop(raw)
    return out


def judge(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """Per document: id, the base counts, base_failed, kept and the distance (null where the base rule fails)."""
    key = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("null"))
    base = docs.select(
        F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"),
        key(lang_col).alias("lang_key"), key(source_col).alias("source_key"),
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    rows = counts(base, ["doc_id", "lang_key", "source_key"]).select("*", failed.alias("base_failed"), *_vector())
    rows = cut(rows, "quality")
    params = estimates(rows.where(~F.col("base_failed"))).where("level = 0").select("lang_key", "source_key", "e.*")
    out = rows.join(params, ["lang_key", "source_key"], "left")
    out = out.withColumn("distance", F.when(~F.col("base_failed"), F.sqrt(_squared_distance() / F.col("scale"))))
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & (F.col("distance") <= CUTOFF)).alias("kept"), "distance",
    )
