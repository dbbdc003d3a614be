"""Functions whose result depends on one element after the other, over Arrow batches; image search by tiles; templates in built-ins."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.functions.columns import bilinear


def height(values: Sequence) -> int:
    """Height of the search tree that grows by inserting the values in order, equal ones to the right; -1 if empty.

    A new leaf hangs below the deeper one of its two neighbours in sort order.
    """
    n = len(values)
    order = sorted(range(n), key=values.__getitem__)
    # taken out again from the last to the first, each value has its neighbours of the time of its insertion beside it
    before, after = [n] * (n + 1), [n] * (n + 1)
    for a, b in zip(order, order[1:]):
        after[a], before[b] = b, a
    for i in range(n - 1, -1, -1):
        a, b = before[i], after[i]
        after[a], before[b] = b, a
    depth = [-1] * (n + 1)
    for i in range(n):
        a, b = depth[before[i]], depth[after[i]]
        depth[i] = (a if a > b else b) + 1
    return max(depth)


def tree_height(values: Column) -> Column:
    """As `height` for arrays; nulls within are left out, a null array has height -1."""

    @F.pandas_udf("int")
    def each(arrays: pd.Series) -> pd.Series:
        return arrays.map(lambda a: -1 if a is None else height([x for x in a if x is not None and x == x])).astype("int32")

    return each(values)


def chunks(sentences: Sequence[str], most: int = 500) -> list[str]:
    """Sentences joined while a chunk has room; one that begins with @ is a title and stands alone.

    A first sentence without room leaves an empty chunk before it. Then whole chunks are joined while
    their lengths, spaces not counted, add up to `most`. Titles keep their @.
    """
    first: list[str] = []
    line = ""
    for s in (x.strip() for x in sentences if x):
        if s[:1] == "@":
            first += [line, s] if line else [s]
            line = ""
        elif len(line) + 1 + len(s) <= most:
            line = f"{line} {s}" if line else s
        else:
            first.append(line)
            line = s
    if line:
        first.append(line)
    out: list[list[str]] = []
    size = most + 1
    for c in first:
        if c[:1] == "@":
            out.append([c])
            size = most + 1
        elif size + len(c) <= most:
            out[-1].append(c)
            size += len(c)
        else:
            out.append([c])
            size = len(c)
    return [" ".join(x) for x in out]


def chunked(sentences: Column, most: int = 500) -> Column:
    """As `chunks` for arrays of sentences; null stays null."""

    @F.pandas_udf("array<string>")
    def each(lists: pd.Series) -> pd.Series:
        return lists.map(lambda a: None if a is None else chunks([x for x in a if x is not None], most))

    return each(sentences)


def render(template: str, values: Mapping[str, Column]) -> Column:
    """The template with each {{ name }} or {{name}} replaced by a column; nulls are empty, unknown names stay."""
    out = F.lit(template)
    for name, value in values.items():
        text = F.coalesce(value.cast("string"), F.lit(""))
        for tag in (f"{{{{ {name} }}}}", f"{{{{{name}}}}}"):
            out = F.replace(out, F.lit(tag), text)
    return out


def write_documents(df: DataFrame, path: str, name: Column, text: Column) -> None:
    """One folder name=... with a text file for each row; rows of equal names share a folder."""
    df.select(name.alias("name"), text.alias("value")).write.mode("overwrite").partitionBy("name").text(path)


def resize(image: Column, height: int, width: int) -> Column:
    """Bilinear, aligned at the top left corner."""
    h, w = F.size(image), F.size(F.get(image, F.lit(0)))
    grid = lambda n: F.sequence(F.lit(0), F.lit(n - 1))
    return F.transform(grid(height), lambda i: F.transform(grid(width), lambda j: bilinear(image, i * h / height, j * w / width)))


def match(image: np.ndarray, patch: np.ndarray, tile: int = 512) -> tuple[float, int, int]:
    """(distance, y, x) of the patch's least mean squared difference, the first in reading order; infinite if it doesn't fit.

    The squares of each place come from a summed-area table, the products from Fourier transforms of overlapping tiles. Where all
    pixels are whole and sums are below 2**50, sums of squares are rounded and so exact; otherwise all places within the rounding error of the least are computed anew.
    """
    (h, w), (ph, pw) = image.shape, patch.shape
    if ph > h or pw > w or not patch.size:
        return float("inf"), 0, 0
    area = np.zeros((h + 1, w + 1))
    area[1:, 1:] = (image**2).cumsum(0).cumsum(1)
    squares = area[ph:, pw:] - area[:-ph, pw:] - area[ph:, :-pw] + area[:-ph, :-pw]
    products = np.empty_like(squares)
    size = [min(1 << (x - 1).bit_length(), max(tile, 1 << (2 * p - 1).bit_length())) for x, p in ((h, ph), (w, pw))]
    turned = np.conj(np.fft.rfft2(patch, size))
    step = [n - p + 1 for n, p in zip(size, (ph, pw))]
    for y in range(0, h - ph + 1, step[0]):
        for x in range(0, w - pw + 1, step[1]):
            part = np.fft.irfft2(np.fft.rfft2(image[y : y + size[0], x : x + size[1]], size) * turned, size)
            to = products[y : y + step[0], x : x + step[1]]
            to[:] = part[: to.shape[0], : to.shape[1]]
    own = (patch**2).sum()
    sums = squares - 2 * products + own
    scale = float(area[-1, -1]) + float(own)
    whole = scale < 1 << 50 and bool((image == np.rint(image)).all() and (patch == np.rint(patch)).all())
    if whole and 64 * np.finfo(float).eps * np.sqrt(float((image**2).max(initial=0)) * size[0] * size[1] * own) * 40 < 0.2:
        sums = np.rint(sums)
        y, x = np.unravel_index(np.argmin(sums), sums.shape)
        return float(sums[y, x]) / patch.size, int(y), int(x)
    near = np.argwhere(sums <= sums.min() + 1e-9 * scale)
    exact = [float(((image[y : y + ph, x : x + pw] - patch) ** 2).sum()) for y, x in near]
    k = int(np.argmin(exact))
    return exact[k] / patch.size, int(near[k][0]), int(near[k][1])


def best_match(image: Column, patch: Column) -> Column:
    """As `match` for arrays of rows: (distance, y, x); null if one of the images, or a pixel, is null."""

    def grid(rows) -> np.ndarray | None:
        if rows is None or any(r is None for r in rows):
            return None
        out = np.array([np.asarray(r, dtype=np.float64) for r in rows])
        return None if np.isnan(out).any() else out.reshape(len(rows), -1)

    @F.pandas_udf("distance double, y int, x int")
    def each(images: pd.Series, patches: pd.Series) -> pd.DataFrame:
        both = ((grid(a), grid(b)) for a, b in zip(images, patches))
        return pd.DataFrame([(None, None, None) if a is None or b is None else match(a, b) for a, b in both], columns=["distance", "y", "x"]).astype({"y": "Int32", "x": "Int32"})

    return each(image, patch)
