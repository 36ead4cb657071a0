"""Column expressions for measures: safe mathematics, densities of cell counts, carbon, transforms."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Factor and power of a cell's carbon (picograms) by its volume (cubic micrometres), for small cells of all
# classes, large diatoms and other large cells; the volume from which cells are large; classes that are diatoms;
# micrograms of biomass for each cubic micrometre.
SMALL_CELLS, LARGE_DIATOMS, LARGE_OTHERS, LARGE_FROM = (0.26, 0.86), (0.288, 0.811), (0.216, 0.939), 3000.0
DIATOMS = ("bacillariophyceae", "mediophyceae", "coscinodiscophyceae", "fragilariophyceae", "araphidophyceae", "rhizosoleniophyceae")
BIOMASS_FACTOR = 1.03 / 1000.0
# Upper bound of the settled volume in ml and coefficient of its class.
VOLUME_CLASSES = ((5, 0.001979), (10, 0.00365), (25, 0.010555), (50, 0.021703), (None, 0.041598))


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is zero."""
    return F.try_divide(a, b)


def safe_log(x: Column, base: float | None = None) -> Column:
    """Logarithm, null for x <= 0."""
    return F.when(x > 0, F.ln(x) if base is None else F.ln(x) / math.log(base))


def shifted_log(x: Column, least: Column, eps: float = 1e-6) -> Column:
    """Natural logarithm after a shift that makes the least value ``eps`` if it isn't positive."""
    return F.ln(x + F.when(least <= 0, F.abs(least) + eps).otherwise(F.lit(0.0)))


def safe_sqrt(x: Column) -> Column:
    """Square root, null below zero."""
    return F.when(x >= 0, F.sqrt(x))


def box_cox(x: Column, lam: Column | float) -> Column:
    """Box-Cox transform of a positive value; the logarithm at lambda 0."""
    lam = lam if isinstance(lam, Column) else F.lit(float(lam))
    return F.when(x > 0, F.when(F.abs(lam) < 1e-12, F.ln(x)).otherwise((F.pow(x, lam) - 1) / lam))


def yeo_johnson(x: Column, lam: float) -> Column:
    """Yeo-Johnson transform."""
    up = F.log1p(x) if abs(lam) < 1e-12 else (F.pow(x + 1, F.lit(lam)) - 1) / lam
    down = -F.log1p(-x) if abs(lam - 2) < 1e-12 else -(F.pow(1 - x, F.lit(2 - lam)) - 1) / (2 - lam)
    return F.when(x >= 0, up).otherwise(down)


def size_class(x: Column, base: float = math.e) -> Column:
    """The nearest whole logarithm, halves to even."""
    return F.bround(safe_log(x, base), 0).cast("long")


def disc_area(diameter: Column) -> Column:
    return math.pi * F.pow(diameter / 2, F.lit(2))


def density_by_fields(cells: Column, chamber: Column, field: Column, fields: Column, volume: Column) -> Column:
    """Cells per volume from counts in random fields; ``chamber`` and ``field`` are diameters. Two digits, halves to even."""
    return F.bround(ratio(cells * 1000.0 * disc_area(chamber), fields * disc_area(field) * volume), 2)


def density_by_transects(cells: Column, chamber: Column, field: Column, transects: Column, volume: Column) -> Column:
    """Cells per volume from counts in transects along a diameter."""
    part = ratio(cells, transects) * (math.pi / 4) * ratio(chamber, field)
    return F.bround(ratio(part * 1000.0, volume), 2)


def density_by_chamber(cells: Column, volume: Column) -> Column:
    """Cells per volume from a count of the whole chamber."""
    return F.bround(ratio(cells * 1000.0, volume), 2)


def counting_method(cells: Column, chamber: Column, field: Column, fields: Column, transects: Column, volume: Column) -> Column:
    """Which of the three counts a row holds: transects before random fields before the whole chamber."""
    whole = cells.isNotNull() & chamber.isNotNull() & field.isNotNull() & volume.isNotNull()
    return F.when(transects > 0, "transects").when((fields > 0) & whole, "random_fields").otherwise("whole_chamber")


def density(cells: Column, chamber: Column, field: Column, fields: Column, transects: Column, volume: Column, factor: Column) -> Column:
    """Density by the row's counting method, divided by its dilution factor (1 if null)."""
    method = counting_method(cells, chamber, field, fields, transects, volume)
    raw = (
        F.when(method == "transects", density_by_transects(cells, chamber, field, transects, volume))
        .when(method == "random_fields", density_by_fields(cells, chamber, field, fields, volume))
        .otherwise(density_by_chamber(cells, volume))
    )
    return F.bround(ratio(raw, F.coalesce(factor, F.lit(1.0))), 2)


def volume_coefficient(volume: Column) -> Column:
    """Coefficient of the class of a settled volume."""
    out = F.lit(VOLUME_CLASSES[-1][1])
    for most, value in reversed(VOLUME_CLASSES[:-1]):
        out = F.when(volume <= most, value).otherwise(out)
    return F.when(volume.isNotNull(), out)


def density_by_volume_class(cells: Column, fields: Column, volume: Column) -> Column:
    """Cells per volume where only the settled volume and the number of fields are known."""
    return F.bround(ratio(ratio(cells, fields) * 1000.0, volume_coefficient(volume)), 2)


def carbon_content(biovolume: Column, is_diatom: Column) -> Column:
    """Carbon of a cell by three regimes: small cells, large diatoms, other large cells."""
    power = lambda k: k[0] * F.pow(biovolume, F.lit(k[1]))
    return F.when(biovolume < LARGE_FROM, power(SMALL_CELLS)).when((biovolume >= LARGE_FROM) & is_diatom, power(LARGE_DIATOMS)).when((biovolume >= LARGE_FROM) & ~is_diatom, power(LARGE_OTHERS))


def biomass(biovolume: Column) -> Column:
    return biovolume * BIOMASS_FACTOR
