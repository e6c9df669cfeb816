"""The binary form, images and drawings, without and with Spark."""

import json
import random
import zlib

import pytest
from pyspark.sql import functions as F

from quire.functions import drawing
from quire.operators import attachments
from quire.sources import binary, images
from quire.sources.binary import File, Name, Reference, assembled

OBJECTS = [
    (1, {"/Type": Name("/Catalog"), "/Pages": Reference((2, 0))}, None), (2, {"/Type": Name("/Pages"), "/Count": 1, "/Kids": [Reference((3, 0))], "/MediaBox": [0, 0, 100, 200.5]}, None),
    (3, {"/Type": Name("/Page"), "/Contents": [Reference((4, 0)), Reference((5, 0))], "/T": b"a(b)\\\x00\xff", "/N": Name("/A b#(")}, None), (4, {}, b"BT (x) Tj ET" * 50), (5, {"/Filter": Name("/Unknown")}, b"\x01\x02"),
]
ROOT = {"/Root": Reference((1, 0))}


@pytest.mark.parametrize(("user", "passwords"), [(None, [""]), ("", ["", "keeper"]), ("reader", ["reader", "keeper"])])
def test_what_is_written_is_read(user, passwords):
    data = assembled(OBJECTS, ROOT, True, user, "keeper")
    for password in passwords:
        file = File(data, password)
        ((number, page),) = file.pages()
        assert (number, page["/MediaBox"], page["/T"], page["/N"]) == (3, [0, 0, 100, 200.5], OBJECTS[2][1]["/T"], OBJECTS[2][1]["/N"])
        assert file.content(page) == OBJECTS[3][2] + b"\n\x01\x02"
    assert (b"(x) Tj" in assembled(OBJECTS, ROOT, False, user, "keeper")) == (user is None)


def test_wrong_passwords_and_damage():
    with pytest.raises(PermissionError):
        File(assembled(OBJECTS, ROOT, True, "reader", "keeper"), "wrong")
    whole = assembled(OBJECTS, ROOT)
    for bad in (whole.replace(b"startxref", b"startxxxx"), whole[: whole.rindex(b"xref\n0")], b"junk\n" * 3 + whole, whole.replace(b"/Length", b"/Longth")):
        assert len(list(File(bad).pages())) == 1
    for nothing in (b"", b"%PDF-1.4", bytes(range(256)) * 4):
        assert list(File(nothing).pages()) == []
    random.seed(2)
    for _ in range(200):  # whatever is broken, reading ends
        cut = bytearray(whole)
        for _ in range(random.randint(1, 12)):
            cut[random.randrange(len(cut))] = random.randrange(256)
        list(File(bytes(cut)).pages())


def test_object_streams_and_cross_reference_streams():
    inner = [(1, b"<</Type/Catalog/Pages 2 0 R>>"), (2, b"<</Type/Pages/Kids[3 0 R 2 0 R]/Count 1>>"), (3, b"<</Type/Page/MediaBox[0 0 10 10]/Contents 5 0 R>>")]
    head = body = b""
    for n, v in inner:
        head += b"%d %d " % (n, len(body))
        body += v + b" "
    packed = zlib.compress(head + body)
    out = b"%PDF-1.5\n"
    at4 = len(out)
    out += b"4 0 obj<</Type/ObjStm/N 3/First %d/Filter/FlateDecode/Length %d>>\nstream\n" % (len(head), len(packed)) + packed + b"\nendstream endobj\n"
    at5 = len(out)
    out += b"5 0 obj<</Length 6 0 R>>stream\r\n(hi) Tj\r\nendstream endobj\n6 0 obj 7 endobj\n"
    at6, at7 = out.rindex(b"6 0 obj"), len(out)
    rows = b"".join(bytes([a]) + x.to_bytes(2, "big") + bytes([c]) for a, x, c in [(0, 0, 0), (2, 4, 0), (2, 4, 1), (2, 4, 2), (1, at4, 0), (1, at5, 0), (1, at6, 0), (1, at7, 0)])
    filtered, before = b"", bytes(4)
    for k in range(0, len(rows), 4):
        filtered += b"\x02" + bytes((x - y) & 255 for x, y in zip(rows[k : k + 4], before))
        before = rows[k : k + 4]
    packed = zlib.compress(filtered)
    out += b"7 0 obj<</Type/XRef/Size 8/W[1 2 1]/Root 1 0 R/Filter/FlateDecode/DecodeParms<</Predictor 12/Columns 4>>/Length %d>>stream\n" % len(packed) + packed + b"\nendstream endobj\nstartxref\n%d\n%%%%EOF" % at7
    for data in (out, out.replace(b"startxref", b"xxxxxxxxx")):
        file = File(data)
        ((number, page),) = file.pages()  # a tree that holds itself is walked once
        assert number == 3 and file.content(page) == b"(hi) Tj"


def test_files_in_a_folder(spark, tmp_path):
    (tmp_path / "b").mkdir()
    (tmp_path / "a.pdf").write_bytes(assembled(OBJECTS, ROOT))
    (tmp_path / "b" / "c.bin").write_bytes(assembled(OBJECTS, ROOT, True, "", "k"))
    (tmp_path / "d.txt").write_text("no document")
    found = binary.files(spark, str(tmp_path))
    assert found.count() == 3 and found.where(binary.is_document()).count() == 2
    rows = binary.objects_of(found.where(binary.is_document())).where("objnum = 4").collect()
    assert [bytes(r.stream) for r in rows] == [OBJECTS[3][2]] * 2
    errors = binary.objects_of(found.where(binary.is_document()), password="wrong").where("error is not null").collect()
    assert [r.path.endswith("c.bin") for r in errors] == [True]
    trailer = binary.objects_of(found).where("objnum = 0 and path like '%a.pdf'").first()
    assert json.loads(trailer.object)["/Root"] == 1


def test_pngs_of_every_filter():
    random.seed(1)
    width, height, samples = 7, 10, 3
    pixels = bytes(random.randrange(256) for _ in range(width * height * samples))
    assert images.png_pixels(images.png_bytes(width, height, samples, pixels)) == (width, height, samples, pixels)
    row, raw, before = width * samples, b"", bytes(width * samples)
    for k in range(height):
        line, how = pixels[k * row : (k + 1) * row], k % 5
        left = bytes(samples) + line[:-samples]
        corner = bytes(samples) + before[:-samples]
        paeth = [min((a, b, c), key=lambda v: abs(a + b - c - v)) for a, b, c in zip(left, before, corner)]
        add = [bytes(row), left, before, [(a + b) // 2 for a, b in zip(left, before)], paeth][how]
        raw += bytes([how]) + bytes((x - y) & 255 for x, y in zip(line, add))
        before = line
    plain = images.png_bytes(width, height, samples, pixels)
    start = plain.index(b"IDAT") - 4
    packed = zlib.compress(raw)
    made = plain[:start] + len(packed).to_bytes(4, "big") + b"IDAT" + packed + bytes(4) + plain[plain.index(b"IEND") - 4 :]
    assert images.png_pixels(made) == (width, height, samples, pixels)
    with pytest.raises(ValueError):
        images.png_pixels(b"GIF89a")


def test_probes():
    jpeg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc4\x00\x03x\xff\xc2\x00\x0b\x08\x00\x20\x00\x30\x03" + bytes(9)
    boxed = b"\0\0\0\x0cjP  \r\n\x87\n" + b"\0\0\0\x16ihdr" + (32).to_bytes(4, "big") + (48).to_bytes(4, "big") + b"\0\x03" + bytes(4)
    code = b"\xff\x4f\xff\x51\0\x29\0\0" + b"".join(v.to_bytes(4, "big") for v in (50, 34, 2, 2)) + bytes(16) + b"\0\x03" + bytes(9)
    jbig2 = b"\x97JB2\r\n\x1a\n\x01\0\0\0\x01" + b"\0\0\0\0\x30\x00\x01\0\0\0\x13" + (48).to_bytes(4, "big") + (32).to_bytes(4, "big") + bytes(11)
    assert [images.probed(d) for d in (jpeg, boxed, code, jbig2, b"", None, b"\xff\xd8\xff")] == [("jpeg", 48, 32, 3), ("jpeg2000", 48, 32, 3), ("jpeg2000", 48, 32, 3), ("jbig2", 48, 32, 1), None, None, None]


def test_resampling_takes_means():
    assert images.resampled(4, 2, 1, bytes([0, 2, 10, 20, 4, 2, 30, 20]), 50) == (2, 1, bytes([2, 20]))
    assert images.resampled(1, 1, 3, b"abc", 10) == (1, 1, b"abc")


def test_drawing_programs():
    program = "push\nmtrans 5 6\nstrokecol 0.5\nfillcol 0 0 0 1\ncap round\njoin bevel\ndash 3 1\nmrot 1 1 90\n# note\nnewpage\ntext a(b)\nmscale 0 0 2 3\nuse Im1\nartifact\nendartifact"
    first, second = drawing.compiled(program)
    assert first == "q\n1 0 0 1 5 6 cm\n0.5 G\n0 0 0 1 k\n1 J\n2 j\n[3 1] 0 d\n0 1 -1 0 2 0 cm\nQ"
    assert second == "(a\\(b\\)) Tj\n2 0 0 3 0 0 cm\n/Im1 Do\n/Artifact BMC\nEMC"
    for wrong in ("rect 1 2 3", "nonsense", "fillcol 1 2", "line a b"):
        with pytest.raises(ValueError):
            drawing.compiled(wrong)
    assert drawing.colour("tomato") == pytest.approx((1, 99 / 255, 71 / 255))


def test_files_are_saved(spark, tmp_path):
    rows = [(1, 0, "a/b", b"x"), (1, 2, "ab", b"yy"), (2, 0, "", None)]
    dump = attachments.dumped(spark.createDataFrame(rows, "doc_id long, page int, name string, data binary"))
    sizes = {r.path: r.size for r in attachments.saved(dump, f"file://{tmp_path}").collect()}
    assert sizes == {"1/ab": 1, "1/2-ab": 2, "2/unnamed": 0}
    assert (tmp_path / "1" / "2-ab").read_bytes() == b"yy"


def test_nulls_stay_null(spark):
    table = spark.createDataFrame([(1, None, None)], "doc_id long, content string, data binary")
    from quire.operators import content

    made = table.select(content.moved(F.col("content"), tuple(F.lit(1.0) for _ in range(6))).alias("a"), content.drawn(F.col("content")).alias("b"), images.probe("data").alias("c"))
    assert made.first().a is None and made.first().b is None and made.first().c.format is None
    assert binary.pages_of(table, "doc_id").count() == 0
    assert content.without_noops(table).first().content is None
