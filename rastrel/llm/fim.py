"""Fill-in-middle: texts as codepoint arrays, cut where neighbouring classes make a boundary, pieces moved behind markers."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship_package

# The markers before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
MARKERS = (PREFIX, SUFFIX, MIDDLE)
#: Codepoints of the text's gaps: the space and the five ASCII controls 9 to 13.
GAPS = np.array([32, 9, 10, 11, 12, 13], np.uint32)
#: Rows that are worked on together, so that what a task holds follows the longest texts and not the batch.
STEP = 64


def _line_ends(x: np.ndarray) -> np.ndarray:
    return x[:-1] == 10


def _word_starts(x: np.ndarray) -> np.ndarray:
    gap = np.isin(x, GAPS)
    return gap[:-1] & ~gap[1:]


#: Kinds of unit: whether a boundary lies between each two neighbouring codepoints.
UNITS: dict[str, Callable[[np.ndarray], np.ndarray]] = {"line": _line_ends, "word": _word_starts, "char": lambda x: np.ones(max(0, len(x) - 1), bool)}


@dataclass(frozen=True)
class Settings:
    """seed: of the draws. fim_percent: texts that are rearranged; spm_percent of these put the suffix first. unit: a key of UNITS."""

    seed: int = 7
    fim_percent: int = 100
    spm_percent: int = 50
    unit: str = "line"


def codepoints(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def chars(points: np.ndarray) -> str:
    return points.tobytes().decode("utf-32-le", "surrogatepass")


def boundaries(points: np.ndarray, unit: str) -> np.ndarray:
    """Places where units start or end: 0, every boundary between two neighbours, the end. An empty text: 0 alone."""
    if not len(points):
        return np.zeros(1, np.int64)
    return np.concatenate([[0], np.flatnonzero(UNITS[unit](points)) + 1, [len(points)]])


def rearrange(text: str, draws: tuple[int, int, int, int], s: Settings) -> tuple[int, str, int | None, int | None, str]:
    """n units, form, prefix and middle lengths (None: plain), output."""
    points = codepoints(text)
    cuts = boundaries(points, s.unit)
    n = len(cuts) - 1
    if not text or any(m in text for m in MARKERS) or draws[2] % 100 >= s.fim_percent:
        return n, "plain", None, None, text
    a, b = cuts[np.sort(np.array([draws[0] % (n + 1), draws[1] % (n + 1)]))]
    prefix, middle, suffix = chars(points[:a]), chars(points[a:b]), chars(points[b:])
    if draws[3] % 100 < s.spm_percent:
        return n, "spm", int(a), int(b - a), f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", int(a), int(b - a), f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def draws(doc_id: Column, seed: int) -> list[Column]:
    """Four numbers below 2**32 from the SHA-256 of `seed:doc_id`; a null doc_id is empty there."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substr(digest, F.lit(8 * i + 1), F.lit(8)), 16, 10).cast("long") for i in range(4)]


def _work(s: Settings):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, STEP):
                part = batch.slice(lo, STEP)
                *kept, text, h1, h2, h3, h4 = part.columns
                made = [rearrange(t or "", h, s) for t, h in zip(text.to_pylist(), zip(*(h.to_pylist() for h in (h1, h2, h3, h4)), strict=True), strict=True)]
                n, form, prefix, middle, output = (list(c) for c in zip(*made, strict=True))
                long, string = pa.int64(), pa.string()
                cols = [pa.array(n, long), pa.array(form, string), pa.array(prefix, long), pa.array(middle, long), pa.array(output, string)]
                yield pa.RecordBatch.from_arrays([*kept, *cols], [*part.schema.names[: len(kept)], "n", "form", "prefix_chars", "middle_chars", "output"])

    return run


def fill_in_middle(docs: DataFrame, settings: Settings = Settings(), keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep`, n, form (plain, psm, spm), prefix_chars, middle_chars, output of every whole text.

    Prefix ends after the smaller, middle after the larger of two drawn numbers of units. Empty texts, texts that
    contain a marker and those left out by `fim_percent` are plain: the output is the text. Null text: empty.
    Draws depend on doc_id alone: repeated rows give equal rows, each of which stays; rows of one doc_id with unlike
    texts are cut by the same draws. An empty table gives no rows; other columns are ignored.
    """
    ship_package(docs.sparkSession)
    rows = docs.select(*keep, "text", *[h.alias(f"_h{i}") for i, h in enumerate(draws(F.col("doc_id"), settings.seed))])
    kinds = ", ".join(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keep)
    return rows.mapInArrow(_work(settings), f"{kinds}, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column) -> Column:
    """The text, from output and form alone: the markers are nowhere else in a rearranged output."""
    p = F.split(output, "<[PSM]>", -1)
    psm = F.concat(F.get(p, F.lit(1)), F.get(p, F.lit(3)), F.get(p, F.lit(2)))
    spm = F.concat(F.get(p, F.lit(2)), F.get(p, F.lit(3)), F.get(p, F.lit(1)))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def digest(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """What the outputs hold, as digests: output_sha256, and restored_sha256 of the text read back from the output."""
    d = fill_in_middle(docs, settings)
    return d.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))
