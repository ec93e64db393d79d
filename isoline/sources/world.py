"""The public Natural Earth data sets: a catalogue built from themes and scales, and readers through a local cache.

A vector file's address follows from its theme and scale; a raster file's from its style, size and layers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from isoline.sources.cache import FileCache
from isoline.sources.files import read_vector
from isoline.sources.rasters import read_raster

#: Fixed value: where the files are published.
SERVER = "https://naciscdn.org/naturalearth"
#: Themes by the scales (millions) they are published at.
CULTURAL = {
    (10, 50, 110): ("admin_0_countries", "admin_0_countries_lakes", "admin_0_map_units", "admin_0_pacific_groupings", "admin_0_scale_rank", "admin_0_sovereignty", "admin_0_boundary_lines_land", "admin_1_states_provinces", "admin_1_states_provinces_lakes", "admin_1_states_provinces_lines", "populated_places", "populated_places_simple"),
    (10, 50): ("admin_0_boundary_lines_disputed_areas", "admin_0_boundary_lines_maritime_indicator", "admin_0_boundary_lines_maritime_indicator_chn", "admin_0_map_subunits", "urban_areas"),
    (50, 110): ("admin_0_tiny_countries",),
    (50,): ("admin_0_tiny_countries_scale_rank",),
    (10,): (
        "admin_0_antarctic_claim_limit_lines", "admin_0_antarctic_claims", "admin_0_boundary_lines_map_units", "admin_0_disputed_areas", "admin_0_disputed_areas_scale_rank_minor_islands", "admin_0_label_points", "admin_0_scale_rank_minor_islands", "admin_0_seams",
        "admin_1_label_points", "admin_1_label_points_details", "admin_1_seams", "admin_1_states_provinces_scale_rank", "admin_2_counties", "admin_2_counties_lakes", "admin_2_counties_scale_rank", "admin_2_counties_scale_rank_minor_islands", "admin_2_label_points", "admin_2_label_points_details",
        "airports", "ports", "railroads", "railroads_north_america", "roads", "roads_north_america", "time_zones",
    ),
}
PHYSICAL = {
    (10, 50, 110): ("coastline", "land", "ocean", "rivers_lake_centerlines", "lakes", "geography_regions_polys", "geography_regions_points", "geography_regions_elevation_points", "geography_marine_polys", "glaciated_areas", "geographic_lines"),
    (10, 50): ("rivers_lake_centerlines_scale_rank", "lakes_historic", "playas", "antarctic_ice_shelves_polys", "antarctic_ice_shelves_lines"),
    (10,): ("land_scale_rank", "minor_islands", "minor_islands_coastline", "reefs", "ocean_scale_rank", "rivers_australia", "rivers_europe", "rivers_north_america", "lakes_pluvial", "lakes_australia", "lakes_europe", "lakes_north_america", "land_ocean_label_points", "minor_islands_label_points", "land_ocean_seams"),
}
#: Raster layers by style, in large (HR), medium (LR) and small (50M) sizes.
RASTERS = {
    ("HR", "LR"): ("HYP", "HYP_SR_W_DR", "HYP_SR_OB_DR", "NE1_LC", "NE1_LC_SR", "NE1_LC_SR_W", "NE1_LC_SR_W_DR", "NE2_LC", "NE2_LC_SR", "NE2_LC_SR_W", "NE2_LC_SR_W_DR", "GRAY_SR_OB_DR"),
    ("HR", "LR", "50M"): ("HYP_SR", "HYP_SR_W", "SR", "GRAY_SR", "GRAY_SR_W", "GRAY_SR_OB"),
    ("LR", "50M"): ("OB",),
    ("50M",): ("NE2_SR", "NE2_SR_W", "MSR", "PRISMA_SR"),
}


def _themes(kind: str) -> dict[str, tuple[int, ...]]:
    return {t: scales for scales, themes in {"cultural": CULTURAL, "physical": PHYSICAL}[kind].items() for t in themes}


def vector_path(theme: str, scale: int) -> str:
    """The path of a theme's file at a scale, below SERVER."""
    kind = next((k for k in ("cultural", "physical") if scale in _themes(k).get(theme, ())), None)
    if kind is None:
        raise ValueError(f"{theme} is not published at 1:{scale},000,000")
    return f"{scale}m/{kind}/ne_{scale}m_{theme}.zip"


def raster_path(layers: str, size: str) -> str:
    """layers: style and layers, as SR or NE2_LC_SR; size: HR, LR or 50M, which stands after the style."""
    if not any(size in sizes and layers in names for sizes, names in RASTERS.items()):
        raise ValueError(f"{layers} is not published in size {size}")
    style, _, rest = layers.partition("_")
    if layers == "PRISMA_SR":
        style, rest = layers, ""
    return f"{'50m' if size == '50M' else '10m'}/raster/{style}_{size}{'_' + rest if rest else ''}.zip"


def catalogue(spark: SparkSession) -> DataFrame:
    """(kind, name, detail, url): all known files; detail is the scale or the size."""
    rows = [(kind, t, f"{s}m", f"{SERVER}/{vector_path(t, s)}") for kind in ("cultural", "physical") for t, scales in _themes(kind).items() for s in scales]
    rows += [("raster", n, size, f"{SERVER}/{raster_path(n, size)}") for sizes, names in RASTERS.items() for n in names for size in sizes]
    return spark.createDataFrame(rows, "kind string, name string, detail string, url string")


def _cached(spark: SparkSession, path: str, folder: str, fetch) -> str:
    name = path.rpartition("/")[2]
    got = FileCache(spark, folder).get(spark.createDataFrame([(name, f"{SERVER}/{path}")], "name string, url string"), fetch).first()
    if got["path"] is None:
        raise FileNotFoundError(f"{SERVER}/{path}")
    return f"{got['path']}/{name.removesuffix('.zip')}"


def read_world_vector(spark: SparkSession, theme: str, scale: int, folder: str, fetch) -> DataFrame:
    """A theme's features. folder: the cache, on the shared store; fetch(url) -> bytes gets a file that it lacks."""
    return read_vector(spark, f"{_cached(spark, vector_path(theme, scale), folder, fetch)}.shp")


def read_world_raster(spark: SparkSession, layers: str, size: str, folder: str, fetch) -> DataFrame:
    """A raster's cells, through the cache as above."""
    return read_raster(spark, f"{_cached(spark, raster_path(layers, size), folder, fetch)}.tif")


def scale_for(width: float | Column) -> Column:
    """The scale (millions) whose files suit a map of so many degrees."""
    w = width if isinstance(width, Column) else F.lit(float(width))
    return F.when(w > 30, 110).when(w > 8, 50).otherwise(10)
