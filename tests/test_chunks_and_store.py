"""Passages, index storage, office files, vectors."""

import io
import json
import struct
import zipfile

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from brevia.operators import chunking, dense
from brevia.sources import index_store

MAGIC = b"TESTIDX\x01"


def test_passages():
    title = "Danışman Değişikliği Formu"
    assert len(chunking.passages(title, "satır\n" * 600)) == 6
    assert chunking.passages(title, "ADI SOYADI\nİMZA") == [title, f"{title}\nADI SOYADI\nİMZA"]
    assert chunking.passages("Staj", "   \n  ") == ["Staj"]
    assert len(chunking.passages("Başlık", "şğüöçİĞÜÖÇı" * 400)) == 7
    assert len(chunking.passages("T", "x" * 180000)) == 40


@settings(max_examples=50, deadline=None)
@given(st.text(alphabet="ab \n", max_size=4000))
def test_windows_cover_the_body(body):
    own = chunking.passages("T", body)
    assert own[0] == "T" and all(len(p) <= 902 for p in own)
    text = body.strip()
    assert all(p[2:] in text for p in own[1:])
    assert "".join(text.split()) == "" or len(own) > 1


def test_chunk_rows_and_nulls(spark):
    rows = chunking.chunk(spark.createDataFrame([(1, "T", None), (2, None, "x")], "doc long, title string, text string")).orderBy("doc", "ord").collect()
    assert [(r.doc, r.ord, r.text) for r in rows] == [(1, 0, "T"), (2, 0, ""), (2, 1, "\nx")]


def index(spark):
    docs = spark.createDataFrame([(0, "a")], "doc long, id string")
    chunks = spark.createDataFrame([(0, 0, 0, "x", [1.0, 0.0]), (1, 0, 1, "y", [0.0, 1.0])], "chunk long, doc long, ord int, text string, vec array<float>")
    return docs, chunks


def test_index_round_trip_and_refusals(spark, tmp_path):
    docs, chunks = index(spark)
    folder = str(tmp_path / "index")
    index_store.write_index(docs, chunks, folder, "m", 2, "2024-01-01", "s")
    d, c, meta = index_store.read_index(spark, folder, "m")
    assert d.count() == 1 and c.count() == 2 and meta.first().built == "2024-01-01"
    with pytest.raises(index_store.BrokenIndex, match="built with"):
        index_store.read_index(spark, folder, "other")
    with pytest.raises(index_store.BrokenIndex, match="numbers"):
        index_store.check_index(docs, chunks, "m", 3, "m")
    with pytest.raises(index_store.BrokenIndex, match="no document"):
        index_store.check_index(docs.where("doc = 9"), chunks, "m", 2, "m")
    assert index_store.load_first(spark, [str(tmp_path / "none"), folder], "m") is not None
    # written over, and found again after a stop between the two moves
    index_store.write_index(docs, chunks.where("chunk = 0"), folder, "m", 2, "2024-01-02", "s")
    assert index_store.read_index(spark, folder, "m")[1].count() == 1 and not (tmp_path / "index.old").exists()
    (tmp_path / "index").rename(tmp_path / "index.old")
    assert index_store.read_index(spark, folder, "m")[2].first().built == "2024-01-02"
    (tmp_path / "index.old").rename(tmp_path / "index")
    (tmp_path / "bad" / "docs").mkdir(parents=True)
    assert index_store.load_first(spark, [str(tmp_path / "bad"), folder], "m", quarantine=True) is not None
    assert (tmp_path / "bad.broken").exists() and not (tmp_path / "bad").exists()


def test_binary_index(spark, tmp_path):
    header = json.dumps({"dim": 2, "docs": [{}], "chunks": [{"doc": 0, "ord": 0, "text": "x"}]}).encode()
    blob = MAGIC + struct.pack("<I", len(header)) + header + struct.pack("<2f", 1, 0)
    assert index_store.parse_binary(blob, MAGIC)[1].tolist() == [[1.0, 0.0]]
    (tmp_path / "one.idx").write_bytes(blob)
    assert index_store.import_binary(spark, str(tmp_path / "one.idx"), MAGIC).collect()[0].text == "x"
    row = index_store.import_documents(spark, str(tmp_path / "one.idx"), MAGIC).collect()[0]
    assert (row.doc, row.document, row.meta) == (0, "{}", '{"dim": 2}')
    for bad in (b"nothing", blob[:20], blob[:-4]):
        with pytest.raises(index_store.BrokenIndex):
            index_store.parse_binary(bad, MAGIC)


def test_forms(spark, tmp_path):
    form = {"id": "b.tr", "code": None, "rev": 1, "lang": "tr", "title": "t", "name": "n", "ext": "pdf", "url": "u", "text": "gövde", "extra": 1}
    (tmp_path / "b.json").write_text(json.dumps(form, indent=1))
    (tmp_path / "a.json").write_text(json.dumps(form | {"id": "a.tr"}, indent=1))
    forms = index_store.read_forms(spark, str(tmp_path))
    assert [(r.doc, r.id) for r in forms.orderBy("doc").collect()] == [(0, "a.tr"), (1, "b.tr")]
    assert index_store.form_text(forms, "a.tr!") == "gövde"
    with pytest.raises(ValueError):
        index_store.form_text(forms, "..")
    with pytest.raises(LookupError):
        index_store.form_text(forms, "c.tr")
    index_store.write_forms(forms, str(tmp_path / "out"))
    back = index_store.read_forms(spark, str(tmp_path / "out"), lines=True)
    assert sorted(map(str, back.select(sorted(forms.columns)).collect())) == sorted(map(str, forms.select(sorted(forms.columns)).collect()))
    line = next(x for f in (tmp_path / "out").glob("*.json") for x in f.read_text().splitlines())
    assert list(json.loads(line)) == sorted(f.name for f in index_store.FORM)
    (tmp_path / "out" / "broken.json").write_text("{")
    with pytest.raises(Exception):
        index_store.read_forms(spark, str(tmp_path / "out"), lines=True).collect()


def test_office_files(spark):
    def zipped(parts):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for n, t in parts.items():
                z.writestr(n, t)
        return out.getvalue()

    word = '<w:document xmlns:w="urn:w">'
    docx = zipped({
        "word/document.xml": f"{word}<w:p><w:r><w:t>Bir</w:t></w:r><w:r><w:t>a &amp; b</w:t></w:r></w:p><w:p><w:t>İki</w:t><w:br/><w:t>c</w:t></w:p></w:document>",
        "word/parts/header1.xml": f"{word}<w:p><w:t>Baş</w:t></w:p></w:document>",
        "word/styles.xml": f"{word}<w:t>no</w:t></w:document>",
    })
    sheet = '<worksheet xmlns="urn:s"><sheetData><row r="1"><c t="s"><v>0</v></c><c/><c><v>5</v></c></row><row r="2"/><row r="3"><c t="inlineStr"><is><r><t>x</t></r><r><t> &lt;y</t></r></is></c><c t="s"><v>9</v></c></row></sheetData></worksheet>'
    xlsx = zipped({"xl/sharedStrings.xml": '<sst xmlns="urn:s"><si><r><t>A</t></r><r><t>B</t></r></si></sst>', "xl/worksheets/sheet1.xml": sheet, "xl/worksheets/_rels/sheet1.xml.rels": "<x/>"})
    rows = spark.createDataFrame([("a.docx", docx), ("b.xlsx", xlsx), ("c.docx", b"broken"), ("d.pdf", b"x")], "path string, content binary")
    got = {r.path: r.text for r in index_store.extract_texts(rows).collect()}
    assert [x.strip() for x in got["a.docx"].split("\n") if x.strip()] == ["Bir  a &amp; b", "İki", "c", "Baş"] or got["a.docx"].split() == "Bir a &amp; b İki c Baş".split()
    assert got["b.xlsx"] == "AB | 5\nx &lt;y" and got["c.docx"] == got["d.pdf"] == ""


def test_vectors(spark):
    one = spark.range(1)
    v = lambda *x: F.array(*map(F.lit, x))
    assert one.select(dense.dot(v(1.0, 0.0), v(1.0, 0.0)), dense.dot(v(1.0, 0.0), v(-1.0, 0.0)), dense.dot(v(1.0, 2.0), v(1.0))).first()[:] == (1.0, -1.0, 1.0)
    hidden = F.array(v(1.0, 0.0), v(3.0, 0.0), v(99.0, 99.0))
    assert one.select(dense.mean_pool(hidden, v(1.0, 1.0, 0.0))).first()[0] == [2.0, 0.0]
    assert one.select(dense.mean_pool(hidden, v(0.0, 0.0, 0.0))).first()[0] == [0.0, 0.0]
    rows = spark.createDataFrame([(1, "bir iki"), (2, None)], "id long, text string")
    got = {r.id: r.vec for r in dense.embed(rows, dense.HashingEmbedder(8), "id", "text").collect()}
    assert abs(sum(x * x for x in got[1]) - 1) < 1e-6 and len(got[2]) == 8
