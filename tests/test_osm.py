"""The one-pass OSM source: ranges, odd markup, pushed filters."""

import pytest

from isoline.sources import osm_elements as oe

NODES = "".join(f'<node id="{k}" lat="{k % 90}" lon=\'{k % 180}\' user="a &lt;node b &gt; c"><tag k="n" v="&#233;&amp;{k}"/></node>\n' for k in range(500))
WAYS = "".join(f'<way id="{k}"\n version="1" ><nd ref="{k}"/><nd ref="{k + 1}"/></way>' for k in range(100))
RELATION = '<relation id="7"><member type="way" ref="3" role="outer"><nd lat="1" lon="2"/></member><member type="node" ref="5" role=""/><tag k="type" v="a>b"/></relation>'
BARE = '<node id="900" lat="1.5" lon="-2.5"/><node id="901"/><way id="902"/>'
DOC = f'<?xml version="1.0" encoding="UTF-8"?>\n<osm version="0.6"><note>nodes of noday</note><bounds minlat="0"/>{NODES}{BARE}{WAYS}{RELATION}</osm>\n'


def texts(data: bytes, step: int) -> list[bytes]:
    read = lambda at, n: data[at : at + n]
    return [t for a in range(0, len(data), step) for t in oe.elements_of(read, len(data), a, min(a + step, len(data)))]


@pytest.mark.parametrize("step", [1, 7, 64, 1000, 1 << 20])
def test_every_element_is_in_one_range(monkeypatch, step):
    monkeypatch.setattr(oe, "AHEAD", 50)
    data = DOC.encode()
    if step == 1:
        data = data[:3000] + RELATION.encode() + b"</osm>"
        data = data[: data.rindex(b"<node", 0, 3000)] + RELATION.encode() + b"</osm>"
    found = texts(data, step)
    assert b"".join(found).count(b"<tag ") == data.count(b"<tag ") and found == texts(data, 1 << 30)
    if step > 1:
        assert len(found) == 500 + 3 + 100 + 1


def test_damaged():
    with pytest.raises(ValueError, match="without end"):
        texts(b'<osm><node id="1"><tag k="a" v="b"/>', 100)
    with pytest.raises(ValueError, match="damaged"):
        texts(b'<osm><node id="1', 100)


@pytest.mark.parametrize("range_bytes", [300, 1 << 25])
def test_source(spark, tmp_path, range_bytes):
    (tmp_path / "a.osm").write_text(DOC, encoding="utf-8")
    oe.register(spark)
    df = spark.read.format("isoline_osm").option("range_bytes", range_bytes).load(f"file://{tmp_path}/a.osm")
    rows = df.collect()
    assert len(rows) == 604
    by = {(r.kind, r.id): r for r in rows}
    assert by["node", 8].tags[0].value == "é&8" and (by["node", 8].x, by["node", 8].y) == (8.0, 8.0)
    assert (by["node", 900].x, by["node", 900].tags, by["node", 901].x) == (-2.5, [], None)
    assert by["way", 5].refs == [5, 6] and by["way", 902].refs == [] and by["way", 5].members is None
    r = by["relation", 7]
    assert r.tags[0].value == "a>b" and [(m.type, m.ref, m.role, [tuple(p) for p in m.nd]) for m in r.members] == [("way", 3, "outer", [(2.0, 1.0)]), ("node", 5, "", [])]
    assert df.where("kind = 'node' and x > 170 and y <= 85").count() == sum(1 for k in range(500) if k % 180 > 170 and k % 90 <= 85)
    assert df.where("kind = 'way' and id >= 90").count() == 11


def test_other_encodings_are_refused(spark, tmp_path):
    (tmp_path / "b.osm").write_text('<?xml version="1.0" encoding="ISO-8859-1"?><osm><node id="1" lat="0" lon="0"/></osm>')
    oe.register(spark)
    with pytest.raises(Exception, match="not supported"):
        spark.read.format("isoline_osm").load(f"file://{tmp_path}/b.osm").count()
