"""Plots as tables of pixels, and PNG bytes of them.

Points are aggregated to distinct pixels before anything leaves the executors,
so that an image of w x h costs w x h rows at most, however many points it has.
"""

from __future__ import annotations

import math
import struct
import tomllib
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusframe.functions import genomics as g
from locusframe.operators import burden

CELL = 20


def pixels(points: DataFrame, x: str = "x_px", y: str = "y_px") -> DataFrame:
    """Points and least p of every pixel; associative, so that parts can be combined."""
    return points.groupBy(F.floor(x).cast("int").alias("px"), F.floor(y).cast("int").alias("py")).agg(
        F.count("*").alias("n"), F.min("pvalue").alias("best_p")
    )


def nearest(points: DataFrame, asked: DataFrame, keys: list[str], radius: float = 10.0, cell: int = CELL) -> DataFrame:
    """Of every place asked for the nearest point within the radius, by a grid of cells."""
    step = math.ceil(radius / cell)
    around = F.array(*[F.lit(k) for k in range(-step, step + 1)])
    cells = asked.withColumn("_dx", F.explode(around)).withColumn("_dy", F.explode(around))
    cells = cells.withColumn("_cx", (F.floor(F.col("qx") / cell) + F.col("_dx"))).withColumn("_cy", (F.floor(F.col("qy") / cell) + F.col("_dy")))
    placed = points.withColumn("_cx", F.floor(F.col("x_px") / cell)).withColumn("_cy", F.floor(F.col("y_px") / cell))
    far = (F.col("x_px") - F.col("qx")) * (F.col("x_px") - F.col("qx")) + (F.col("y_px") - F.col("qy")) * (F.col("y_px") - F.col("qy"))
    met = cells.join(placed, ["_cx", "_cy"]).withColumn("_d", far).where(F.col("_d") <= radius * radius)
    return met.groupBy(*asked.columns).agg(F.min(F.struct("_d", *keys)).alias("_m")).select(*asked.columns, "_m.*")


def png(rgb: np.ndarray) -> bytes:
    """An image (height, width, 3) of bytes as PNG."""
    h, w, _ = rgb.shape
    raw = np.concatenate([np.zeros((h, 1), np.uint8), rgb.reshape(h, w * 3)], axis=1).tobytes()

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    head = struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def locus_points(variants: DataFrame, start: int, end: int, width: int = 800, height: int = 400) -> DataFrame:
    """Places of a region's variants; y is linear up to 1.1 times the greatest -log10 p, 10 at least.

    ``shape`` tells the source: exomes are diamonds, in front; genomes are circles.
    """
    usable = variants.where((F.col("pvalue") > 0) & (F.col("pvalue") < math.inf) & F.col("position").between(start, end))
    y = -F.log10("pvalue")
    top = usable.agg(F.greatest(F.lit(10.0), F.max(y)) * 1.1).scalar()
    return usable.select(
        "*",
        g.locus_x(F.col("position"), F.lit(start), F.lit(end), width).alias("x_px"),
        (height - y / top * height).alias("y_px"),
        F.when(F.col("sequencing_type") == "exome", "diamond").otherwise("circle").alias("shape"),
    )


def gene_points(tests: DataFrame, width: int = 3000, height: int = 800) -> DataFrame:
    """Places of genes by their best p, in a panel of all tests and in one of each annotation and frequency.

    The top of a panel is its greatest -log10 p, but 10 at least and 50 at most.
    """
    place = ["gene_id", "contig", "position"]
    best = burden.best_by(tests, [*place, "annotation", "max_maf"])
    overall = best.groupBy(*place).agg(F.min("p").alias("p")).withColumn("panel", F.lit("all"))
    by_test = best.select(*place, "p", F.concat_ws(":", "annotation", burden.maf_text(F.col("max_maf"))).alias("panel"))
    every = overall.unionByName(by_test).withColumn("y", -F.log10("p"))
    # One row a panel.
    tops = every.groupBy("panel").agg(F.greatest(F.lit(10.0), F.least(F.lit(50.0), F.max("y"))).alias("top"))
    return every.join(tops, "panel").select(
        "panel",
        *place,
        F.col("p").alias("pvalue"),
        g.plot_x(F.col("contig"), F.col("position"), width).alias("x_px"),
        g.plot_y(F.col("y"), height, F.col("top")).alias("y_px"),
    )


def rgb(text: str) -> tuple[int, int, int]:
    """A colour of the form #rrggbb."""
    return tuple(int(text[i : i + 2], 16) for i in (1, 3, 5))


def stamp(shape: str, radius: float) -> np.ndarray:
    """Which pixels around a point a shape covers."""
    r = max(0, math.ceil(radius))
    y, x = np.mgrid[-r : r + 1, -r : r + 1]
    return np.abs(x) + np.abs(y) <= radius if shape == "diamond" else x * x + y * y <= radius * radius


def draw(points: DataFrame, width: int = 3000, height: int = 800, threshold_y: float | None = None, look: dict | None = None) -> bytes:
    """A scatter of pixels, with a threshold line; diamonds stand in front of circles."""
    look = look or resolve()
    image = np.full((height, width, 3), 255, np.float64)
    if look["background"] not in ("white", "transparent"):
        image[:] = rgb(look["background"])
    # An image without an alpha channel: transparent is white here.
    shaped = points if "shape" in points.columns else points.withColumn("shape", F.lit("circle"))
    spots = shaped.groupBy("shape", F.floor("x_px").cast("int").alias("px"), F.floor("y_px").cast("int").alias("py")).count()
    masks = {s: stamp(s, look["point_radius"]) for s in ("circle", "diamond")}
    r = masks["circle"].shape[0] // 2
    # At most two shapes times width * height rows by construction.
    for s in spots.orderBy("shape", "px", "py").toLocalIterator():
        x, y = min(max(s.px, 0), width - 1), min(max(s.py, 0), height - 1)
        colour = np.array(rgb(look["colours"][s.shape == "diamond"]))
        top, left = max(0, y - r), max(0, x - r)
        part = image[top : y + r + 1, left : x + r + 1]
        mask = masks[s.shape][top - y + r :, left - x + r :][: part.shape[0], : part.shape[1]]
        part[mask] += look["point_alpha"] * (colour - part[mask])
    if threshold_y is not None and 0 <= threshold_y < height:
        line = image[int(threshold_y)]
        line += look["threshold_alpha"] * (np.array(rgb(look["threshold_colour"])) - line)
    return png(image.round().astype(np.uint8))


# How plots look unless told.
LOOK = {
    "point_radius": 2.5,
    "point_alpha": 0.6,
    "colours": ("#5E81AC", "#BF616A"),
    "background": "white",
    "threshold_colour": "#B71C1C",
    "threshold_alpha": 0.5,
}
KINDS = {"exome": ("variant", "exome"), "genome": ("variant", "genome"), "gene_burden": ("gene_burden",), "locus": ("locus",)}
OWN = {"gene_burden": {"point_radius": 5.0, "point_alpha": 0.9}, "locus": {"point_radius": 3.0}}


def resolve(settings: dict | None = None, kind: str = "exome") -> dict:
    """How a kind of plot looks: the defaults, then those of its group, then its own.

    ``settings`` has tables ``defaults``, ``variant`` (with ``exome`` and
    ``genome`` within), ``gene_burden`` and ``locus``; unknown settings are an error.
    """
    given = settings or {}
    layers, at = [given.get("defaults", {}), OWN.get(KINDS[kind][0], {})], given
    for name in KINDS[kind]:
        at = at.get(name, {})
        layers.append({k: x for k, x in at.items() if not isinstance(x, dict)})
    out = dict(LOOK)
    for layer in layers:
        if unknown := layer.keys() - LOOK.keys():
            raise ValueError(f"no such settings: {sorted(unknown)}")
        out |= {k: x for k, x in layer.items() if x is not None}
    return out


def load_style(text: str) -> dict:
    """Settings from TOML."""
    return tomllib.loads(text)
