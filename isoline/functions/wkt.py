"""Reference systems as well-known text and .prj files."""

from __future__ import annotations

import re

from pyspark.sql import SparkSession

from isoline.functions import crs

_SPHERE = 'GEOGCS["WGS 84",DATUM["WGS_1984",SPHEROID["WGS 84",6378137,298.257223563]],PRIMEM["Greenwich",0],UNIT["degree",0.0174532925199433],AUTHORITY["EPSG","4326"]]'
_BRITISH = 'GEOGCS["OSGB36",DATUM["Ordnance_Survey_of_Great_Britain_1936",SPHEROID["Airy 1830",6377563.396,299.3249646]],PRIMEM["Greenwich",0],UNIT["degree",0.0174532925199433],AUTHORITY["EPSG","4277"]]'
#: The text of each known system.
TEXTS = {
    4326: _SPHERE,
    4269: 'GEOGCS["NAD83",DATUM["North_American_Datum_1983",SPHEROID["GRS 1980",6378137,298.257222101]],PRIMEM["Greenwich",0],UNIT["degree",0.0174532925199433],AUTHORITY["EPSG","4269"]]',
    3857: f'PROJCS["WGS 84 / Pseudo-Mercator",{_SPHERE},PROJECTION["Mercator_1SP"],UNIT["metre",1],AUTHORITY["EPSG","3857"]]',
    crs.VAN_DER_GRINTEN: f'PROJCS["World Van der Grinten I",{_SPHERE},PROJECTION["VanDerGrinten"],UNIT["metre",1],AUTHORITY["ESRI","54029"]]',
    crs.ROBINSON: f'PROJCS["World Robinson",{_SPHERE},PROJECTION["Robinson"],UNIT["metre",1],AUTHORITY["ESRI","54030"]]',
}
#: Names that other programs write for the known systems.
_NAMES = {"wgs_1984": 4326, "wgs 84": 4326, "nad83": 4269, "north_american_1983": 4269, "pseudo-mercator": 3857, "web_mercator": 3857, "van_der_grinten": crs.VAN_DER_GRINTEN, "van der grinten": crs.VAN_DER_GRINTEN, "robinson": crs.ROBINSON}


def to_wkt(srid: int) -> str:
    if srid not in TEXTS and crs.is_known(srid):
        base = _BRITISH if srid == crs.BRITISH else _SPHERE
        return f'PROJCS["{crs.KNOWN[srid][0]}",{base},PROJECTION["Transverse_Mercator"],UNIT["metre",1],AUTHORITY["EPSG","{srid}"]]'
    return TEXTS[srid]


def from_wkt(text: str) -> int:
    """The known system of a text: by the authority that closes it, else by the name that opens it."""
    last = re.search(r'(?:AUTHORITY|ID)\[\s*"(?:EPSG|ESRI)"\s*,\s*"?(\d+)"?\s*\]\s*\]\s*$', text.strip(), re.I)
    if last and crs.is_known(int(last[1])):
        return int(last[1])
    zone = re.search(r'^\s*\w+\[\s*"[^"]*UTM[ _]zone[ _](\d{1,2})([NS])', text, re.I)
    if zone and 1 <= int(zone[1]) <= 60 and "WGS" in text.upper():
        return (32600 if zone[2].upper() == "N" else 32700) + int(zone[1])
    if re.search(r'^\s*\w+\[\s*"[^"]*British[ _]National[ _]Grid', text, re.I):
        return crs.BRITISH
    name = re.search(r'^\s*\w+\[\s*"([^"]*)"', text)
    found = [n for k, n in _NAMES.items() if name and k in name[1].lower()]
    projected = text.lstrip().upper().startswith(("PROJ", "PROJCRS"))
    found = [n for n in found if (n not in (4326, 4269)) == projected]
    if not found:
        raise ValueError("unknown reference system")
    return found[0]


def srid_of(text: str) -> int:
    """EPSG:n, ESRI:n, a known name, or well-known text."""
    return from_wkt(text) if "[" in text else crs.srid(text)


def read_prj(spark: SparkSession, path: str) -> int:
    """The system that a .prj file names."""
    return from_wkt("".join(r["value"] for r in spark.read.text(path, wholetext=True).take(1)))
