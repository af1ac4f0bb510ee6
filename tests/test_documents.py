"""Composition on pages drawn by hand."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.functions import text as T
from palimpsest.operators import compose as C
from palimpsest.operators import jobs as J
from palimpsest.operators import raster as R
from palimpsest.operators import refine as P
from palimpsest.operators.engine import stub_engine
from palimpsest.plans.pipeline import Pipeline
from palimpsest.schema import BLOCKS, JOBS
from palimpsest.sources import files


def page(blocks, doc=1, number=1, size=(1200, 1800), image=False, conf=0.98):
    return [(doc, number, k, kind, x, y, w, h, words, conf, 0.91, k, *size, image, None) for k, (kind, x, y, w, h, words) in enumerate(blocks)]


TWO = [("Title", 120, 80, 960, 120, "Capitulo 1"), ("Text", 120, 280, 420, 180, "izquierda superior"), ("Text", 120, 520, 420, 180, "izquierda inferior"),
       ("Text", 660, 300, 420, 180, "derecha superior"), ("Text", 660, 540, 420, 180, "derecha inferior"), ("Image", 150, 800, 380, 260, "")]
LISTING = [("Image", 60, 220, 620, 680, ""), ("Text", 760, 250, 420, 70, "Vintage camera listing"), ("Text", 760, 370, 500, 90, "$129.99 Buy it now"), ("Text", 760, 520, 420, 120, "Ships from Panama")]


def test_two_columns(spark):
    rows = C.compose(spark.createDataFrame(page(TWO), BLOCKS)).orderBy("reading_order").collect()
    assert [r.text for r in rows if r.role == "Paragraph"] == ["izquierda superior", "izquierda inferior", "derecha superior", "derecha inferior"]
    assert [(r.column_index, r.total_columns) for r in rows if r.role == "Paragraph"] == [(0, 2), (0, 2), (1, 2), (1, 2)]
    assert rows[0].role == "Title" and rows[0].total_columns == 1 and rows[0].keep_with_next
    assert abs(next(r for r in rows if r.text == "izquierda inferior").spacing_before_pt - 28.8) < 1e-4


def test_running_heads(spark):
    first = [("Text", 110, 55, 980, 55, "Historia Universal"), ("Text", 110, 210, 900, 180, "contenido pagina uno"), ("Text", 110, 1650, 980, 45, "Pagina 1")]
    second = [("Text", 112, 58, 978, 55, "Historia Universal"), ("Text", 110, 195, 900, 180, "contenido pagina dos distinto"), ("Text", 108, 1652, 982, 45, "Pagina 2")]
    rows = C.compose(spark.createDataFrame(page(first) + page(second, number=2), BLOCKS)).orderBy("page_no", "reading_order").collect()
    assert [(r.suspected_header, r.suspected_footer) for r in rows] == [(True, False), (False, False), (False, True)] * 2


def test_modes(spark):
    blocks = spark.createDataFrame(page(LISTING, size=(1440, 1800)), BLOCKS)
    assert C.page_modes(blocks).first().mode == C.VISUAL
    assert all(r.total_columns == 1 and r.preserve_positioning for r in C.compose(blocks).collect())
    documents = spark.createDataFrame([(1, {"processing_mode_preference": "document"})], "doc_id bigint, metadata map<string,string>")
    assert C.with_modes(C.page_modes(blocks), documents).first().mode == C.DOCUMENT
    kept = C.persist_modes(documents, C.page_modes(blocks)).first().metadata
    assert kept["page_processing_modes"] == "visual"


def test_zero_page_is_refused(spark):
    with pytest.raises(Exception, match="without width or height"):
        C.elements(spark.createDataFrame(page(TWO, size=(0, 10)), BLOCKS)).collect()


def test_text_functions(spark):
    row = spark.createDataFrame([("ﬁle ﬂoor", "  hola   mundo   ", "tbe quick brown fox", "barn internal arrange")], "a string, b string, c string, d string")
    got = row.select(T.corrected(F.col("a"), "spa"), T.cleaned(F.col("b")), T.corrected(F.col("c"), "eng"), T.corrected(F.col("d"), "eng")).first()
    assert tuple(got) == ("file floor", "hola mundo", "the quick brown fox", "barn internal arrange")


@pytest.mark.parametrize("weak_page", [1, 2])
def test_retry_meets_pages_by_number(spark, weak_page):
    blocks = [p for n in (1, 2) for p in page([("Text", 100, 120, 500, 140, f"old {n}")], number=n, conf=0.42 if n == weak_page else 0.95)]
    blocks = spark.createDataFrame(blocks, BLOCKS)
    engine = lambda b, profile: b.withColumns({"content": F.lit("texto corregido"), "confidence": F.lit(0.89)})
    out, used = P.run_passes("AfterOcr", blocks, [P.confidence_boost(engine)], 0, P.Budget(1))
    got = {r.page_no: (r.content, r.confidence) for r in out.collect()}
    assert got[weak_page] == ("texto corregido", 0.89) and got[3 - weak_page] == (f"old {3 - weak_page}", 0.95) and used == 1
    assert P.run_passes("AfterOcr", blocks, [P.confidence_boost(engine)], 1, P.Budget(1))[1] == 1


def test_pipeline_and_cancellation(spark):
    blocks = files.stub_document(spark)
    run = Pipeline()
    rows = run.run(blocks).collect()
    assert [r.role for r in sorted(rows, key=lambda r: r.reading_order)] == ["Title", "Paragraph"] and abs(rows[0].ocr_confidence - 0.9) < 1e-6
    assert run.events[-1]["kind"] == "Completed"
    with pytest.raises(P.Cancelled):
        Pipeline(stub_engine).run(blocks, cancelled=lambda: True)


def test_job_store(spark, tmp_path):
    store = J.JobStore(spark, str(tmp_path), lock_seconds=0.05)
    assert store.load().count() == 0
    job = lambda k, status: (str(k), str(k), f"/{k}", status, None, None, "Fast", None, "Txt", "auto")
    store.save(spark.createDataFrame([job(1, "Completed"), job(2, "Processing"), job(3, "Failed")], JOBS))
    jobs, interrupted = store.start()
    assert interrupted == 1 and {r.job_id: r.status for r in jobs.collect()} == {"1": "Completed", "2": "Failed", "3": "Failed"}
    store.delete("1")
    with pytest.raises(J.JobNotFound):
        store.get("1")
    with store.locked(), pytest.raises(J.LockTimeout):
        store.delete("2")
    (tmp_path / "jobs.json").write_text("{ json invalido")
    with pytest.raises(J.BadStore, match="parseando jobs.json"):
        store.load()


def test_event_stream(spark, tmp_path):
    from palimpsest.streaming import events as E

    store = J.JobStore(spark, str(tmp_path / "jobs"))
    store.save(spark.createDataFrame([("7", "7", "/7", "Processing", None, None, "Fast", None, "Txt", "auto")], JOBS))
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text(json.dumps({"job_id": "7", "seq": 1, "ts": "2024-01-01T00:00:00Z", "kind": "Completed"}) + "\n")
    E.monitor(E.event_stream(spark, str(tmp_path / "in")), store, str(tmp_path / "ck")).awaitTermination(120)
    got = store.get("7").first()
    assert got.status == "Completed" and got.completed_at is not None


def test_raster():
    rng = np.random.default_rng(0)
    for shape in ((5, 7), (4, 6, 3)):
        pixels = rng.integers(0, 256, shape, dtype=np.uint8)
        assert (R.decode_png(R.encode_png(pixels)) == pixels).all()
    lined = np.full((200, 200), 255, dtype=np.uint8)
    lined[20::20] = 0
    lined[21::20] = 0
    tilted = R.rotated(lined, np.deg2rad(3))
    assert abs(abs(R.skew_angle(tilted)) - 3) < 0.5 and set(np.unique(R.binarized(tilted))) <= {0, 255}
    assert R.denoised(lined).shape == lined.shape and R.cropped(lined, 190, 190, 50, 50).shape == (10, 10)
    tensor, back_x, back_y = R.layout_tensor(np.zeros((480, 640), np.uint8))
    assert tensor.shape == (1, 3, 1024, 1024) and abs(back_x - 0.625) < 1e-3
    assert R.recognition_tensor(np.zeros((30, 200), np.uint8)).shape == (1, 3, 48, 320) and R.detection_tensor(np.zeros((100, 100), np.uint8)).shape == (1, 3, 128, 128)
    for shape, value in (((100, 100), 200), ((150, 100), 128), ((700, 900), 255)):  # nothing to straighten: nothing changes
        even = np.full(shape, value, dtype=np.uint8)
        assert R.skew_angle(even) == 0 and (R.deskewed(even) == even).all()
    grid = np.zeros((20, 30))
    grid[2:6, 3:9] = 1
    grid[10:18, 20:29] = 1
    assert R.regions(grid, 0.5, 3) == [(3, 2, 6, 4), (20, 10, 9, 8)]


def test_sources(spark, tmp_path):
    import struct

    def tiff(pages):
        body, place = bytearray(b"II*\0" + struct.pack("<I", 8)), 8
        for k, p in enumerate(pages):
            high, wide = p.shape[:2]
            channels = 1 if p.ndim == 2 else 3
            data = place + 2 + 12 * 8 + 4
            bits = data + p.nbytes
            tags = [(256, 4, 1, wide), (257, 4, 1, high), (258, 3, 1 if channels == 1 else 3, 8 if channels == 1 else bits), (259, 3, 1, 1), (262, 3, 1, 1 if channels == 1 else 2), (273, 4, 1, data), (277, 3, 1, channels), (279, 4, 1, p.nbytes)]
            follow = bits + 6 if k + 1 < len(pages) else 0
            body += struct.pack("<H", len(tags)) + b"".join(struct.pack("<HHII", *t) for t in tags) + struct.pack("<I", follow) + p.tobytes() + struct.pack("<3H", 8, 8, 8)
            place = bits + 6
        return bytes(body)

    (tmp_path / "a.tif").write_bytes(tiff([np.full((80, 120, 3), 9, np.uint8), np.full((150, 200, 3), 7, np.uint8)]))
    (tmp_path / "b.tiff").write_bytes(b"II*\0broken")
    (tmp_path / "c.png").write_bytes(R.encode_png(np.full((100, 200), 255, np.uint8)))
    (tmp_path / "d.xyz").write_bytes(b"x")
    found = files.files(spark, str(tmp_path))
    assert {r.filename: (r.source_format, r.error) for r in found.collect()} == {"a.tif": ("tiff", None), "b.tiff": ("tiff", None), "c.png": ("image", None), "d.xyz": (None, "UnsupportedFormat: xyz")}
    pages = files.tiff_pages(found.filter("source_format = 'tiff'")).collect()
    assert sorted((r.page_no, r.width, r.height) for r in pages if r.error is None) == [(1, 120, 80), (2, 200, 150)] and sum(r.error is not None for r in pages) == 1
    assert [(r.page_no, r.width, r.height) for r in files.raster_pages(spark, str(tmp_path / "c.png")).collect()] == [(1, 200, 100)]
    cleaned = R.clean_pages(spark.createDataFrame([(1, 1, bytearray(R.encode_png(np.full((50, 50), 128, np.uint8)))), (1, 2, None)], "doc_id long, page_no int, png binary")).collect()
    assert [r.png is None for r in sorted(cleaned, key=lambda r: r.page_no)] == [False, True]


def test_pdf_files(spark):
    from palimpsest.sinks import pdf

    png = bytearray(R.encode_png(np.arange(200 * 300, dtype=np.uint32).astype(np.uint8).reshape(200, 300)))
    blocks = page([("Title", 20, 10, 260, 30, "Canción año"), ("Image", 40, 100, 80, 35, "")], size=(300, 200), image=True) + page([("Text", 20, 10, 260, 30, "texto claro")], doc=2)
    rows = C.elements(spark.createDataFrame(blocks, BLOCKS))
    got = {r.doc_id: bytes(r.pdf) for r in pdf.files(rows, spark.createDataFrame([(1, 1, png)], "doc_id bigint, page_no int, png binary")).collect()}
    assert got[1].count(b"/Subtype /Image") == 1 and got[2].count(b"/Subtype /Image") == 0
    for raw in got.values():
        assert raw.startswith(b"%PDF-1.5") and raw.endswith(b"%%EOF\n")
        start = int(raw.rsplit(b"startxref\n", 1)[1].split()[0])
        assert raw[start:].startswith(b"xref")
    line = pdf.text_lines(rows.filter("doc_id = 1")).first()
    assert bytes.fromhex(line.hex).decode("cp1252") == line.value == "Canción año"
