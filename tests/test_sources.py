"""Files of every encoding and layout, read back exactly."""

import json

import pytest

from loomspark.sources import load, records
from loomspark.sources.encodings import decode

HAN = "患者有高血压和糖尿病，需要长期服药。医生建议检查血常规。"
LATIN = "Élève très déçu à l'hôtel; señor, mañana. Größe über Öl."


@pytest.mark.parametrize(("text", "codec", "name"), [
    (HAN, "utf-8", "utf-8"), (HAN, "utf-8-sig", "utf-8-sig"), (HAN, "gb18030", "gb18030"), (HAN, "gbk", "gb18030"), (HAN, "utf-16-le", "utf-16-le"), (HAN, "utf-16-be", "utf-16-be"), (HAN, "utf-16", "utf-16"), (HAN, "utf-32", "utf-32"),
    (LATIN, "latin-1", "latin-1"), (LATIN + " “so”", "cp1252", "cp1252"), (LATIN, "utf-16-le", "utf-16-le"), (LATIN, "utf-8", "utf-8"), ("plain", "ascii", "utf-8"), ("", "utf-8", "utf-8"), ("A", "utf-16-be", "utf-16-be")])
def test_decode(text, codec, name):
    assert decode(text.encode(codec)) == (name, text)


@pytest.mark.parametrize("text", ["Te keitä engeß stäzu üzuver der.", "Un ieñ cióncojami.", "Ñóasar llie lles lo se osmentees.", "Éé de.", "Èeuxè " * 9])
def test_short_latin_texts_are_no_han(text):
    assert decode(text.encode("latin-1")) == ("latin-1", text)
    assert decode(text.encode("utf-16-le")) == ("utf-16-le", text)


@pytest.mark.parametrize("text", ["Éç.", "Ñí.", "Çê | |.", "Èê.***", "ÉÇ!!.###", "Êê 5472476151044309.", "Éètion ÉÇÊMENT!!.", "Éééon | la. | Éêpation."])
def test_words_of_accents_are_no_han(text):
    """two accented letters can be a frequent Han character, but in words of usual case beside plain marks they are Latin."""
    assert decode(text.encode("latin-1")) == ("latin-1", text)


@pytest.mark.parametrize("text", ["社", "社会.", "5年.", "血压 120/80, 心率 75.", "社，如。"])
def test_short_han_texts_stay(text):
    assert decode(text.encode("gb18030")) == ("gb18030", text)


def test_no_bytes_are_lost():
    assert decode(bytes([0xFF, 0x41, 0x81]))[0] == "latin-1"
    assert decode(b"\xe9")[1] == "é"


def test_load_reads_any_encoding(spark, tmp_path):
    for codec in ("utf-8", "gb18030", "utf-16"):
        (tmp_path / f"{codec}.txt").write_bytes(HAN.encode(codec))
    assert [r.content for r in load.load_documents(spark, str(tmp_path)).collect()] == [HAN] * 3


XML = """<?xml version="1.0" encoding="UTF-8"?>
<root><drugs>
<drug><drugbank-id>D1</drugbank-id><name>Asp</name><cas_number>50</cas_number><weight>180.5</weight><indications><item>pain</item><item></item><item>fever</item></indications>
<side_effects><item>bleeding</item></side_effects><interactions><interaction><drug-name>Warf</drug-name><severity>high</severity></interaction><interaction><drug_name>Other</drug_name><drugbank-id>D9</drugbank-id></interaction></interactions></drug>
<drug><drugbank_id>D2</drugbank_id><name>Warf</name><weight>heavy</weight></drug>
<drug><drugbank_id>D3</drugbank_id><name>warf</name><side-effects><item>x</item></side-effects></drug>
<drug><name>No id</name></drug>
</drugs></root>"""


def test_drugs_from_xml_and_json_are_the_same(spark, tmp_path):
    (tmp_path / "d.xml").write_text(XML)
    got = records.read_drugs(spark, str(tmp_path / "d.xml"), "xml").collect()
    by = {r.drugbank_id: r for r in got}
    assert {k: r.error for k, r in by.items()} == {"D1": None, "D2": "weight", "D3": None, None: "no id"}
    a = by["D1"]
    assert (a.cas_number, a.weight, a.indications, a.side_effects, a.synonyms) == ("50", 180.5, ["pain", "fever"], ["bleeding"], [])
    assert [tuple(i) for i in a.interactions] == [("Warf", None, None, "high"), ("Other", "D9", None, None)]
    assert by["D3"].side_effects == ["x"]
    plain = [{k: v for k, v in r.asDict(True).items() if k != "error"} for r in got]
    for r in plain:
        r["weight"] = "heavy" if r["drugbank_id"] == "D2" else r["weight"] and str(r["weight"])
    (tmp_path / "d.json").write_text(json.dumps({"drugs": plain}, indent=1))
    again = records.read_drugs(spark, str(tmp_path / "d.json"), "json")
    assert sorted(again.collect(), key=repr) == sorted(got, key=repr)
    assert {tuple(r) for r in records.drug_links(again).collect()} == {("D1", "D3", None, "high", True), ("D1", "D9", None, None, False)}


def test_items_are_saved_and_read(spark, tmp_path):
    rows = [("Was?", "a", "x", ["e"], ["k", "l"], "c", "easy"), ("Wie?", None, None, [], None, None, None)]
    names = [c.split()[0] for c in records.ITEMS.split(", ")]
    (tmp_path / "one.json").write_text(json.dumps({"name": "n", "items": [dict(zip(names, r)) for r in rows]}, indent=2))
    items = records.read_items(spark, str(tmp_path / "one.json"))
    assert sorted(map(tuple, items.collect()), key=repr) == sorted(rows, key=repr)
    records.save_items(items, str(tmp_path / "saved"))
    assert sorted(map(tuple, records.read_items(spark, str(tmp_path / "saved")).collect()), key=repr) == sorted(rows, key=repr)


def test_reports(spark, tmp_path):
    df = spark.createDataFrame([(k, f"a|{k}\nb" if k else None) for k in range(20)], "k int, v string").repartition(5)
    records.save_report(df, str(tmp_path / "md"), "markdown", ["k"])
    lines = [line for p in sorted((tmp_path / "md").glob("part-*")) for line in p.read_text().splitlines()]
    assert lines == ["| k | v |", "|---|---|", "| 0 |  |"] + [f"| {k} | a\\|{k}<br>b |" for k in range(1, 20)]
    records.save_report(df, str(tmp_path / "js"), "json", ["k"])
    assert [json.loads(x)["k"] for p in sorted((tmp_path / "js").glob("part-*")) for x in p.read_text().splitlines()] == list(range(20))
    with pytest.raises(ValueError):
        records.save_report(df, str(tmp_path / "x"), "pdf", ["k"])
