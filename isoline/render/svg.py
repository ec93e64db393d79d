"""Layers over named sources, drawn as SVG: every feature becomes one row of text in the JVM, ordered by layer and feature; files are written by Spark or, for one document, by the driver."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isoline.functions.geometry import affine, svg_path
from isoline.operators.features import spread
from isoline.render import canvas, labels
from isoline.render.placement import _small
from isoline.render.png import TILE, image_tiles
from isoline.sources.features import finish, get_data
from isoline.sources.steps import Steps


@dataclass(frozen=True)
class Style:
    fill: str | None = None
    stroke: str | None = None
    stroke_width: float = 1.0
    opacity: float = 1.0
    cap: str = "butt"
    join: str = "miter"
    dashes: tuple[float, ...] = ()
    symbol_radius: float | None = None
    label_tag: str | None = None
    label_size: float | None = None
    label_color: str = "#000000"


@dataclass(frozen=True)
class Layer:
    name: str
    source: str
    style: Style
    where: Column | None = None
    mask: str | None = None


@dataclass
class Map:
    box: tuple[float, float, float, float]
    width: float
    height: float
    srid: int = 4326
    strategy: str = "extend"
    decimals: int = 3
    layers: list[Layer] = field(default_factory=list)


def attributes(s: Style, kind: str) -> str:
    """kind: area, line or symbol."""
    out = [f'fill="{s.fill}" fill-rule="evenodd"' if s.fill and kind != "line" else 'fill="none"']
    if s.stroke:
        out.append(f'stroke="{s.stroke}" stroke-width="{s.stroke_width:g}" stroke-linecap="{s.cap}" stroke-linejoin="{s.join}"')
        if s.dashes:
            out.append('stroke-dasharray="{}"'.format(" ".join(f"{d:g}" for d in s.dashes)))
    return " ".join([*out, f'opacity="{s.opacity:g}"'] if s.opacity != 1 else out)


def _escaped(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def _drawn(m: Map, layer: Layer, sources: dict, no: int) -> DataFrame:
    """(layer_no, feature_id, geom_type, parts, tags, box) in canvas units, y upwards as labels are placed, of the features that reach into the map."""
    if layer.source not in sources:
        raise KeyError(f"no source {layer.source}")
    df, srid = sources[layer.source]
    f = canvas.fit(m.box, m.width, m.height, m.strategy)
    df = get_data(df, srid, target=m.srid)
    df = df.where(F.lit(True) if layer.where is None else layer.where)
    x0, x1, y0, y1 = f.box
    df = df.where((F.col("xmax") >= x0) & (F.col("xmin") <= x1) & (F.col("ymax") >= y0) & (F.col("ymin") <= y1))
    moved = F.transform("parts", lambda c: affine(c, f.scale_x, f.scale_y, f.offset_x, f.offset_y))
    return finish(df.select("feature_id", "geom_type", moved.alias("parts"), "tags"), m.srid).withColumn("layer_no", F.lit(no))


def raster_layer(m: Map, cells: DataFrame, box: tuple, width: int, height: int, no: int, tile: int = TILE) -> DataFrame:
    """(layer_no, part, feature_id, svg): a raster of channels r, g, b, a (already in the map's system and within box) as image tiles at their place on the canvas. Tiles outside the map are left out."""
    f = canvas.fit(m.box, m.width, m.height, m.strategy)
    sx, sy = (box[1] - box[0]) / width * f.scale_x, (box[3] - box[2]) / height * f.scale_y
    x = F.lit(box[0] * f.scale_x + f.offset_x) + F.col("x") * sx
    y = F.lit(m.height - (box[3] * f.scale_y + f.offset_y)) + F.col("y") * sy
    w, h = F.col("width") * sx, F.col("height") * sy
    t = image_tiles(cells, tile).where((x < m.width) & (x + w > 0) & (y < m.height) & (y + h > 0))
    d = m.decimals
    svg = F.concat(F.lit("<image "), F.format_string(f'x="%.{d}f" y="%.{d}f" width="%.{d}f" height="%.{d}f"', x, y, w, h), F.lit(' preserveAspectRatio="none" href="'), F.col("href"), F.lit('"/>'))
    return t.select(F.lit(no).alias("layer_no"), F.lit(0).alias("part"), (F.col("y").cast("bigint") * width + F.col("x")).alias("feature_id"), svg.alias("svg"))


def draw(m: Map, sources: dict[str, tuple[DataFrame, int]]) -> DataFrame:
    """(layer_no, part, feature_id, svg): part 0 is geometry, 1 symbols, 2 labels. sources: name to (features, srid). Symbols and labels of all layers share one placement, layer by layer."""
    out, offers, steps = [], [], None
    d = m.decimals
    for no, layer in enumerate(m.layers):
        s, df = layer.style, _drawn(m, layer, sources, no)
        path = F.array_join(F.transform("parts", lambda c: svg_path(affine(c, 1.0, -1.0, 0.0, m.height), d)), " ")
        area = F.col("geom_type").isin("polygon", "multipolygon")
        shape = F.when(area, F.concat(F.lit('<path d="'), path, F.lit(f'" {attributes(s, "area")}/>'))).when(F.col("geom_type").isin("line", "multiline") & F.lit(bool(s.stroke)), F.concat(F.lit('<path d="'), path, F.lit(f'" {attributes(s, "line")}/>')))
        out.append(df.where(F.lit(bool(s.fill or s.stroke))).select("layer_no", F.lit(0).alias("part"), "feature_id", shape.alias("svg")).where("svg is not null"))
        if s.symbol_radius is None and s.label_tag is None:
            continue
        steps = steps or Steps(df.sparkSession)
        at = steps.keep(labels.anchors(spread(df, "parts")).select("layer_no", "feature_id", "anchor", "tags"))  # poles are costly and read three times
        x, y = F.col("anchor.x"), F.col("anchor.y")
        if s.symbol_radius is not None:
            r = float(s.symbol_radius)
            box = F.array(F.struct((x - r).alias("x0"), (x + r).alias("x1"), (y - r).alias("y0"), (y + r).alias("y1")))
            text = F.concat(F.lit("<circle "), F.format_string(f'cx="%.{d}f" cy="%.{d}f"', x, m.height - y), F.lit(f' r="{r:g}" {attributes(s, "symbol")}/>'))
            offers.append(at.select("layer_no", F.lit(1).alias("part"), "feature_id", box.alias("boxes"), F.array(text).alias("texts")))
        if s.label_tag is not None:
            size = m.width * 0.003 if s.label_size is None else s.label_size
            name = F.get(F.filter("tags", lambda t: t["key"] == s.label_tag), F.lit(0))["value"]
            w, h = labels.text_size(name, size)
            boxes = labels.candidates(x, y, w, h, F.lit(0.3 * size), s.symbol_radius is not None)
            head = F.concat(F.lit(f'" dominant-baseline="central" font-size="{size:g}" text-anchor="middle" fill="{s.label_color}">'), _escaped(name), F.lit("</text>"))
            texts = F.transform(boxes, lambda b: F.concat(F.lit("<text "), F.format_string(f'x="%.{d}f" y="%.{d}f', (b["x0"] + b["x1"]) / 2, m.height - (b["y0"] + h / 2)), head))
            offers.append(at.where(name.isNotNull() & (name != "")).select("layer_no", F.lit(2).alias("part"), "feature_id", boxes.alias("boxes"), texts.alias("texts")))
    if offers:
        every = offers[0]
        for o in offers[1:]:
            every = every.unionByName(o)
        every = every.withColumns({"map_id": F.lit(0), "seq": F.format_string("%06d.%d.%020d", "layer_no", "part", "feature_id")})
        chosen = _small(labels.place(every).where("choice >= 0").select("seq", "choice"))
        out.append(every.join(chosen, "seq").select("layer_no", "part", "feature_id", F.get("texts", F.col("choice")).alias("svg")))
    if not out:
        raise ValueError("a map needs a layer")
    drawn = out[0]
    for o in out[1:]:
        drawn = drawn.unionByName(o)
    return drawn


def write_layers(commands: DataFrame, path: str) -> None:
    """One folder a layer, in drawing order: for maps that no driver should hold."""
    commands.repartition("layer_no").sortWithinPartitions("layer_no", "part", "feature_id").select("layer_no", F.col("svg").alias("value")).write.partitionBy("layer_no").text(path)


def document(m: Map, commands: DataFrame) -> str:
    """The whole SVG as text; for maps of a size that a viewer can open. Layers with a mask are cut by the layer that the mask names."""
    rows: dict[int, list[str]] = {}
    for r in commands.orderBy("layer_no", "part", "feature_id").toLocalIterator():
        rows.setdefault(r["layer_no"], []).append(r["svg"])
    names = {la.name: no for no, la in enumerate(m.layers)}
    masks = "".join('<mask id="mask-{}">{}</mask>'.format(n, "".join(rows.get(names[n], []))) for n in sorted({la.mask for la in m.layers if la.mask}))
    used = {la.mask for la in m.layers if la.mask}
    groups = "".join('<g id="{}"{}>{}</g>'.format(la.name, f' mask="url(#mask-{la.mask})"' if la.mask else "", "".join(rows.get(no, []))) for no, la in enumerate(m.layers) if la.name not in used)
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="{m.width:g}" height="{m.height:g}" viewBox="0 0 {m.width:g} {m.height:g}">{groups}{masks}</svg>'
