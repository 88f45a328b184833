"""Sizes of figures and zooming."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import half_up

PIXELS, SMALLEST, ZOOM, WHEEL = 12_000_000, 0.25, (25, 600), 400


def figure_size(width: Column, height: Column, target: Column) -> Column:
    """(scale, width, height) of a figure drawn to a target width, at no less than SMALLEST and no more than PIXELS in all."""
    scale = F.least(F.greatest(F.lit(SMALLEST), target / width), F.sqrt(F.lit(PIXELS) / (width * height)))
    return F.struct(scale.alias("scale"), F.ceil(width * scale).alias("width"), F.ceil(height * scale).alias("height"))


def zoomed(current: Column, target: Column, left: Column, top: Column, x: Column, y: Column) -> Column:
    """(zoom, left, top) such that the point under (x, y) stays; zoom is a percentage of one decimal within ZOOM."""
    zoom = half_up(F.greatest(F.lit(ZOOM[0]), F.least(F.lit(ZOOM[1]), target)) * 10) / 10
    ratio = zoom / current
    return F.struct(zoom.alias("zoom"), ((left + x) * ratio - x).alias("left"), ((top + y) * ratio - y).alias("top"))


def wheel_zoom(current: Column, delta: Column, mode: Column, page: Column) -> Column:
    """The zoom after a turn of the wheel by delta pixels (mode 0), lines of 16 pixels (1) or pages (2)."""
    pixels = delta * F.when(mode == 1, F.lit(16)).when(mode == 2, page).otherwise(F.lit(1))
    return current * F.exp(-F.greatest(F.lit(-WHEEL), F.least(F.lit(WHEEL), pixels)) * 0.002)
