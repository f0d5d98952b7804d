"""Elements that cannot be read are counted and listed, and cost no element after them; a large file is split."""

from dictaudit.sources import dictionary as DS

SCHEMA = "id string, preferred_name string, definition string, segment int"
CLASS = 'xsi:type="ontoml:CATEGORIZATION_CLASS_Type"'
PROPERTY = 'xsi:type="ontoml:NON_DEPENDENT_P_DET_Type"'


def element(i, name, text, kind=CLASS):
    return (f'<ontoml:class {kind} id="{i}"><preferred_name><label language_code="en"> {name} </label><label>other</label></preferred_name>'
            f"<definition><text>{text}</text></definition></ontoml:class>")


def test_malformed_file_is_skipped(spark, tmp_path):
    good = spark.createDataFrame([("1", "Bell", "A device", 13)], SCHEMA)
    path = tmp_path / "xml"
    DS.write_dictionary_xml(good, str(path), files_per_segment=1)
    bad_dir = path / "dir=SG_14_0"
    bad_dir.mkdir()
    (bad_dir / "broken.txt").write_text(f'<ontoml:class {CLASS} id="2"><preferred_name><label>no end')
    got = DS.read_dictionary_xml(spark, str(path))
    assert [(r.id, r.preferred_name, r.segment) for r in got.collect()] == [("1", "Bell", 13)]
    lost = DS.xml_losses(spark, str(path)).collect()
    assert len(lost) == 1 and lost[0].segment == 14 and lost[0].error == "malformed" and "no end" in lost[0].beginning


def test_elements_after_a_bad_one_are_kept(spark, tmp_path):
    body = [element(1, "Bell", "a &amp; b"), f'<ontoml:class {CLASS} id="2"><preferred_name><label>cut',
            element(3, "Nut", "line one\nline two"), f'<ontoml:class {CLASS} id="4"><preferred_name></label></ontoml:class>',
            f'<ontoml:class {CLASS} id="5"/>', element(6, "ß漢", "x &lt;y&gt;"), element(7, "Prop", "p", PROPERTY),
            "<ontoml:classes><other/></ontoml:classes>", element(8, "", " "), f"<ontoml:class {CLASS}></ontoml:class>"]
    (tmp_path / "SG_21.xml").write_text('<?xml version="1.0"?><ontoml:ontoml><dictionary>' + "\n ".join(body) + "</dictionary></ontoml:ontoml>")
    got = {r.id: (r.preferred_name, r.definition, r.segment) for r in DS.read_dictionary_xml(spark, str(tmp_path)).collect()}
    assert got == {"1": ("Bell", "a & b", 21), "3": ("Nut", "line one\nline two", 21), "5": (None, None, 21),
                   "6": ("ß漢", "x <y>", 21), "8": (None, None, 21)}
    lost = sorted((r.error, r.beginning[:90]) for r in DS.xml_losses(spark, str(tmp_path)).collect())
    assert [e for e, _ in lost] == ["malformed", "no end tag"] and 'id="4"' in lost[0][1] and 'id="2"' in lost[1][1]
    both = {r.id: r.kind for r in DS.read_dictionary_xml(spark, str(tmp_path), mode=None).collect()}
    assert both["7"] == "properties" and both["1"] == "classes" and len(both) == 6
    assert DS.read_dictionary_xml(spark, str(tmp_path), exclude_segments=[21]).count() == 0


def test_a_large_file_takes_several_tasks(spark, tmp_path):
    n = 3000
    (tmp_path / "SG_1.xml").write_text("<d>" + "\n".join(element(i, f"name {i}", "text " * 40) for i in range(n)) + "</d>")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100000")
    try:
        got = DS.read_dictionary_xml(spark, str(tmp_path))
        assert got.rdd.getNumPartitions() > 4
        rows = got.orderBy("seq").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [r.id for r in rows] == [str(i) for i in range(n)]
