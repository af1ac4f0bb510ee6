"""From paths to pages, blocks and files; models, artefacts, jobs in the background."""

import hashlib
import io
import struct
import time
import zlib
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.operators import compose as C
from palimpsest.operators import page_ocr as O
from palimpsest.operators import raster as R
from palimpsest.operators import refine as P
from palimpsest.operators import sessions as S
from palimpsest.operators.engine import stub_engine
from palimpsest.plans import export as X
from palimpsest.plans import runtime as J
from palimpsest.plans.pipeline import Pipeline
from palimpsest.schema import BLOCKS, JOBS
from palimpsest.sinks import files as W
from palimpsest.sinks import latex, pdf
from palimpsest.sources import artefacts as A
from palimpsest.sources import files

from .test_documents import LISTING, TWO, page


def packed_lzw(data: bytes) -> bytes:
    """TIFF's LZW, the plain way."""
    table, out, bits, n, wide, word = {bytes([k]): k for k in range(256)}, bytearray(), 0, 0, 9, b""

    def put(code):
        nonlocal bits, n
        bits, n = bits << wide | code, n + wide
        while n >= 8:
            n -= 8
            out.append(bits >> n & 255)

    put(256)
    size = 258
    for c in data:
        c = bytes([c])
        if word + c in table:
            word += c
            continue
        put(table[word])
        table[word + c] = size
        size += 1
        wide = 9 if size < 512 else 10 if size < 1024 else 11 if size < 2048 else 12
        if size == 4094:
            put(256)
            table, size, wide = {bytes([k]): k for k in range(256)}, 258, 9
        word = c
    if word:
        put(table[word])
    size += 1
    wide = 9 if size < 512 else 10 if size < 1024 else 11 if size < 2048 else 12
    put(257)
    if n:
        out.append(bits << 8 - n & 255)
    return bytes(out)


def tiff(parts: list[bytes], tags: dict[int, tuple[int, ...]], offsets: int, counts: int) -> bytes:
    """One page; ``parts`` are its strips or tiles."""
    head = b"II*\0" + struct.pack("<I", 8)
    tags = {**tags, offsets: tuple(0 for _ in parts), counts: tuple(map(len, parts))}
    after = 8 + 2 + 12 * len(tags) + 4
    long = {t: v for t, v in tags.items() if 4 * len(v) > 4}
    data = after + sum(4 * len(v) for v in long.values())
    tags[offsets] = tuple(data + sum(map(len, parts[:k])) for k in range(len(parts)))
    body, extra = struct.pack("<H", len(tags)), b""
    for t in sorted(tags):
        v = tags[t]
        raw = struct.pack(f"<{len(v)}I", *v)
        body += struct.pack("<HHI", t, 4, len(v)) + (raw if len(raw) <= 4 else struct.pack("<I", after + len(extra)))
        extra += raw if len(raw) > 4 else b""
    return head + body + b"\0\0\0\0" + extra + b"".join(parts)


@pytest.mark.parametrize("size", [1, 300, 20_000])
def test_lzw(size):
    rng = np.random.default_rng(size)
    for data in (rng.integers(0, 256, size, dtype=np.uint8).tobytes(), rng.integers(0, 3, size, dtype=np.uint8).tobytes(), b"a" * size):
        assert files.lzw(packed_lzw(data)) == data


def test_tiff_parts():
    rng = np.random.default_rng(3)
    pixels = rng.integers(0, 256, (50, 70, 3), dtype=np.uint8)
    base = {256: (70,), 257: (50,), 258: (8, 8, 8), 277: (3,)}
    strips = [pixels[k : k + 16].tobytes() for k in range(0, 50, 16)]
    assert (files.tiff_images(tiff([packed_lzw(s) for s in strips], {**base, 259: (5,), 278: (16,)}, 273, 279))[0] == pixels).all()
    steps = pixels.copy()
    steps[:, 1:] -= pixels[:, :-1]
    assert (files.tiff_images(tiff([zlib.compress(steps.tobytes())], {**base, 259: (8,), 317: (2,)}, 273, 279))[0] == pixels).all()
    wide = np.zeros((64, 96, 3), dtype=np.uint8)
    wide[:50, :70] = pixels
    tiles = [wide[y : y + 32, x : x + 32].tobytes() for y in (0, 32) for x in (0, 32, 64)]
    assert (files.tiff_images(tiff(tiles, {**base, 259: (1,), 322: (32,), 323: (32,)}, 324, 325))[0] == pixels).all()
    with pytest.raises(ValueError, match="compression 7"):
        files.tiff_images(tiff([b"x"], {**base, 259: (7,)}, 273, 279))


def test_scan(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(R.encode_png(np.dstack([np.full((20, 30), v, np.uint8) for v in (10, 20, 30)])))
    (tmp_path / "b.webp").write_bytes(b"RIFF....WEBP")
    (tmp_path / "c.xyz").write_bytes(b"x")
    (tmp_path / "d.tif").write_bytes(tiff([bytes(64 * 32)], {256: (64,), 257: (32,), 258: (8,), 277: (1,), 259: (1,)}, 273, 279))
    two = spark.createDataFrame(page(TWO) + page(TWO, number=2), BLOCKS)
    (tmp_path / "e.pdf").write_bytes(bytes(pdf.files(C.elements(two)).first().pdf))
    (tmp_path / "f.pdf").write_bytes(b"no")
    got = files.scan(spark, str(tmp_path), files.BlankRenderer).collect()
    pages = {(r.filename, r.page_no): (r.width, r.height, r.source_format) for r in got if r.error is None}
    assert pages == {("a.png", 1): (30, 20, "image"), ("d.tif", 1): (64, 32, "tiff"), ("e.pdf", 1): (2000, 3000, "pdf"), ("e.pdf", 2): (2000, 3000, "pdf")}
    assert {r.filename: r.error.split(":")[0] for r in got if r.error} == {"b.webp": "ImageError", "c.xyz": "UnsupportedFormat", "f.pdf": "PdfError"}
    assert tuple(R.decode_png(bytes(next(r for r in got if r.filename == "a.png").png))[0, 0]) == (10, 20, 30)
    assert {r.error for r in files.scan(spark, str(tmp_path / "e.pdf")).collect()} == {"PdfError: no renderer"}
    with pytest.raises(files.DocumentNotFound):
        files.scan(spark, str(tmp_path / "none.png"))
    why = lambda name: files.refusal(spark, str(tmp_path / name) if name else "")
    assert why("a.png") is None and why("") == "Ruta de archivo vacia" and why("none.png").startswith("Archivo no encontrado: ") and why("b.webp") == "Formato no soportado: .webp (soportados: PNG, JPEG, TIFF, PDF)"
    assert files.refusal(spark, str(tmp_path)).startswith("La ruta no es un archivo: ")
    told = files.admitted(spark.createDataFrame([("",), ("x.PDF",), ("y",)], "path string")).collect()
    assert [r.refusal for r in told] == ["Ruta de archivo vacia", None, "Formato no soportado: . (soportados: PNG, JPEG, TIFF, PDF)"]


LETTERS = ["h", "o", "l", "a"]


def word(letters, steps=6):
    out = np.full((steps, 5), -4.0, np.float32)
    for k in range(steps):
        out[k, LETTERS.index(letters[k]) + 1 if k < len(letters) else 0] = 4.0
    return out


def fake_models():
    """A title, a table of two by two and a picture on every page; lines say hola, cells say la."""

    def layout(tensor):
        found = np.zeros((1, 14, 4), np.float32)
        for k, (cls, x, y, w, h, score) in enumerate([(0, 20, 10, 100, 20, 0.9), (5, 10, 60, 120, 80, 0.8), (3, 150, 60, 40, 40, 0.7), (1, 150, 60, 40, 40, 0.2)]):
            found[0, :4, k], found[0, 4 + cls, k] = (x + w / 2, y + h / 2, w, h), score
        return np.concatenate([found[:, :4] * 1024 / 200, found[:, 4:]], axis=1)

    def detect(tensor):
        out = np.zeros((1, 1, *tensor.shape[2:]), np.float32)
        out[..., 4:12, 4:60] = 0.9
        return out

    def recognise(batch):
        return np.stack([word("hola" if batch.shape[3] > 200 else "la") for _ in batch])

    def table(tensor):
        logits = np.full((1, 5, 4), -5.0, np.float32)
        boxes = np.zeros((1, 5, 4), np.float32)
        for k, (cls, box) in enumerate([(2, (0.5, 0.25, 1, 0.5)), (2, (0.5, 0.75, 1, 0.5)), (1, (0.25, 0.5, 0.5, 1)), (1, (0.75, 0.5, 0.5, 1))]):
            logits[0, k, cls], boxes[0, k] = 5.0, box
        return logits, boxes

    return SimpleNamespace(orientation=lambda t: np.array([[0.9, 0, 0, 0.1]]), layout=layout, detect=detect, recognise=recognise, table=table)


def test_page_ocr(spark):
    png = bytearray(R.encode_png(np.full((160, 200), 255, np.uint8)))
    pages = spark.createDataFrame([(1, 1, png), (1, 2, None)], "doc_id long, page_no int, png binary")
    got = {r.block_type: r for r in O.page_ocr(pages, fake_models, LETTERS, "Balanced").collect()}
    assert sorted(got) == ["Image", "Table", "Title"] and all((r.page_no, r.page_w, r.page_h, r.has_image) == (1, 200, 160, True) for r in got.values())
    title, grid = got["Title"], got["Table"]
    assert np.abs(np.array([title.x, title.y, title.w, title.h]) - (20, 10, 100, 20)).max() <= 1 and title.block_idx == 0 and title.content == "hola" and title.confidence > 0.99
    assert [[c.content for c in row] for row in grid.table.rows] == [["la", "la"], ["la", "la"]] and grid.content.startswith("| la | la |\n| --- | --- |") and abs(grid.confidence - 0.8) < 1e-6
    fast = {r.block_type: r for r in O.page_ocr(pages, fake_models, LETTERS, "Fast").collect()}
    assert fast["Table"].table is None and fast["Table"].content == ""
    blocks = O.page_ocr(pages, fake_models, LETTERS)
    cut = O.embedded(blocks, pages).collect()
    assert len(cut) == 1 and np.abs(np.array(R.decode_png(bytes(cut[0].png)).shape) - 40).max() <= 1
    old = spark.createDataFrame(page([("Text", 0, 0, 10, 10, "old")]) + page([("Text", 0, 0, 10, 10, "kept")], number=2), BLOCKS)
    mixed = O.over_document(old, pages, fake_models, LETTERS).collect()
    assert {r.content for r in mixed if r.page_no == 2} == {"kept"} and "old" not in {r.content for r in mixed}


def test_from_a_path_to_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.png").write_bytes(R.encode_png(np.full((160, 200), 255, np.uint8)))
    (tmp_path / "in" / "b.pdf").write_bytes(b"no")
    engine = lambda pages, profile: O.page_ocr(pages, fake_models, LETTERS, profile)
    rows, errors = Pipeline(engine, tables=lambda b: b).run_path(spark, str(tmp_path / "in"))
    assert [r.text for r in rows.orderBy("reading_order").collect() if r.role == "Title"] == ["hola"]
    assert [r.error for r in errors.collect()] == ["PdfError: no renderer"]
    with pytest.raises(P.StageError, match="parseo: NotFound"):
        Pipeline(engine).run_path(spark, str(tmp_path / "none"))
    broken = Pipeline(lambda b, profile: b.withColumn("content", F.raise_error(F.lit("no model"))), store=lambda rows: (rows.collect(), rows)[1])
    with pytest.raises(P.StageError, match="ocr: "):  # where rows are made stage by stage, a failure names its stage
        broken.run(spark.createDataFrame(page(TWO), BLOCKS))


def test_export(spark, tmp_path):
    png = bytearray(R.encode_png(np.full((1800, 1200), 200, np.uint8)))
    blocks = spark.createDataFrame(page(TWO, image=True) + page(LISTING, doc=2, size=(1440, 1800), image=True) + page(TWO, doc=3) + page(TWO, doc=4), BLOCKS)
    images = spark.createDataFrame([(1, 1, png), (2, 1, png)], "doc_id long, page_no int, png binary")
    job = lambda k, kind: (f"j{k}", str(k), f"/in/{k}.pdf", "Completed", None, None, "Fast", None, kind, "auto")
    jobs = spark.createDataFrame([job(1, "Latex"), job(2, "Latex"), job(3, "Txt"), job(4, "Json")], JOBS)
    out = str(tmp_path / "out" / "deep")
    written = {r.path: r.bytes for r in X.export(jobs, blocks, out, images).collect()}
    names = {p[len(out) + 1 :] for p in written}
    assert names == {"1.tex", "1_assets/page1_element4.png", "2.tex", "2_assets/page1_full.png", "3.txt", "4.json"}
    read = lambda name: (tmp_path / "out" / "deep" / name).read_bytes()
    assert all(len(read(n)) == written[f"{out}/{n}"] for n in names) and not [p for p in (tmp_path / "out").rglob("*.tmp")]
    assert b"{1_assets/page1_element4.png}" in read("1.tex") and R.decode_png(read("1_assets/page1_element4.png")).shape == (260, 380)
    assert read("2_assets/page1_full.png") == bytes(png) and read("2.tex").count(b"includegraphics") == 1
    text = read("3.txt").decode()
    assert text.startswith("Documento: 3\nArchivo fuente: /in/3.pdf\nPerfil: Fast\nEstado: Completed\n\n===== PAGINA 1 =====") and "CAPITULO 1" in text and b"izquierda superior" in read("4.json")
    pdfs = X.export(jobs, blocks, out, kind="Pdf").collect()
    assert sorted(r.path[len(out) + 1 :] for r in pdfs) == ["1.pdf", "2.pdf", "3.pdf", "4.pdf"] and read("1.pdf").startswith(b"%PDF")
    with pytest.raises(X.ExportError):
        X.export(jobs, blocks, out, kind="Docx")
    elements = X.blueprint(blocks)
    assert {(r.doc_id, r.page_w) for r in X.page_size(elements, 1).collect()} == {(1, 1200), (2, 1440), (3, 1200), (4, 1200)}
    with pytest.raises(Exception, match="No existe la pagina 7"):
        X.page_size(elements, 7).collect()
    assert W.asset_folder("/a/b.tex") == "/a/b_assets" and W.asset_folder("b") == "b_assets" and W.asset_folder("") == "documento_assets"
    modes = C.document_modes(elements.select("doc_id", "page_no", "mode").distinct())
    facsimile = latex.pictures(elements, modes, images, positions=True)
    assert {(r.doc_id, r.name) for r in facsimile.collect()} == {(1, "page1_element4.png"), (2, "page1_full.png")}


def test_reading_order_is_written_back(spark):
    blocks = spark.createDataFrame(page(list(reversed(TWO))) + page([("Text", 5, 5, 10, 10, "alone")], number=2), BLOCKS)
    got = C.reordered(blocks).orderBy("page_no", "reading_order").collect()
    assert [r.content for r in got if r.page_no == 1] == ["Capitulo 1", "izquierda superior", "izquierda inferior", "", "derecha superior", "derecha inferior"] and [r.reading_order for r in got if r.page_no == 1] == list(range(6))
    assert [r.reading_order for r in got if r.page_no == 2] == [0]


def test_artefacts(tmp_path):
    body = bytes(range(256)) * 4000
    good = A.Artefact("ocr", "m.onnx", "u", hashlib.sha256(body).hexdigest())
    opener = lambda url: (io.BytesIO(body), len(body))
    told, seen = [], []
    folder = str(tmp_path)
    assert A.missing(folder, [good]) == ["ocr/m.onnx"]
    A.ensure(folder, [good], opener, lambda *x: told.append(x), lambda *x: seen.append(x))
    assert A.missing(folder, [good]) == [] and told == [("m.onnx", 1, 1)] and seen[-1] == (len(body), len(body)) and len(seen) == 3
    A.ensure(folder, [good], lambda url: pytest.fail("it is there"))
    (tmp_path / "ocr" / "m.onnx").write_bytes(b"broken")
    A.ensure(folder, [good], opener)
    tries = []

    def flaky(url):
        tries.append(url)
        if len(tries) < 3:
            raise OSError("no line")
        return opener(url)

    (tmp_path / "ocr" / "m.onnx").unlink()
    A.fetch(good, folder, flaky, wait=0)
    assert len(tries) == 3
    with pytest.raises(A.FetchError, match="Fallaron 3 intentos"):
        A.fetch(good, folder, lambda url: (_ for _ in ()).throw(OSError("no line")), wait=0)
    with pytest.raises(A.IntegrityError):
        A.fetch(A.Artefact("ocr", "n", "u", "0" * 64), folder, opener, wait=0)
    assert [p.name for p in (tmp_path / "ocr").iterdir()] == ["m.onnx"]


def test_sessions():
    every = list(S.BACKENDS.values())
    assert S.backend(every) == "TensorRT" and S.backend(["CPUExecutionProvider"]) == "CPU" and S.backend([]) == "CPU"
    assert S.providers("CUDA", 1) == [("CUDAExecutionProvider", {"device_id": "1"}), "CPUExecutionProvider"] and S.providers("CPU") == ["CPUExecutionProvider"]
    assert S.threads("CUDA", 64) == 2 and S.threads("CPU", 9) == 4 and S.threads("CPU", 1) == 1
    assert S.acceleration("CPU", False) == "CPU (sin aceleracion GPU)" and S.acceleration("CUDA", True) == "GPU: CUDA (activa)"
    with pytest.raises(FileNotFoundError, match="doclayout"):
        S.open_sessions("/nowhere")

    def provision(on_gpu, on_file, on_bytes):
        on_gpu("CUDA", False)
        on_file("m", 1, 2)
        on_bytes(5, 10)
        return "/models"

    start = S.Bootstrap(provision, lambda folder: folder + "!")
    start.start().join(10)
    steps = [start.step() for _ in range(5)]
    assert [s.log for s in steps[:2]] == ["Aceleracion: GPU: CUDA (no disponible, usando CPU)", "Descargando modelo 1/2: m"] and start.bytes == (5, 10)
    assert steps[3].engine == "/models!" and steps[3].done and steps[4] is None and start.loaded and not start.failed
    failing = S.Bootstrap(lambda *a: (_ for _ in ()).throw(OSError("no disk")), lambda folder: None)
    failing.start().join(10)
    assert failing.step().status == "Error motor ONNX: no disk" and failing.failed


def test_jobs_in_the_background(spark):
    blocks = files.stub_document(spark)
    runtime = J.JobRuntime(spark)
    assert not runtime.active() and not runtime.cancel("x") and runtime.events_of("x") == []
    runtime.start("a", lambda: blocks)
    assert runtime.active() and runtime.phase("a") == J.STARTING
    runtime.jobs["a"].thread.join(60)
    events = runtime.events()["a"]
    assert [e["kind"] for e in events][-1] == "Completed" and events[-1]["result"] == 2 and runtime.progress("a") > 0.9 and runtime.events() == {}
    runtime.page("a", 1, 3)
    assert runtime.phase("a").endswith(" (pagina 1/3)")
    slow = lambda rows: spark.range(0, 10**11, 1, 400).filter(F.xxhash64("id") == 5).count()
    runtime.start("b", lambda: blocks, finish=slow)
    time.sleep(1.5)
    jobs = spark.createDataFrame([("b" * 1, "1", "/1", "Processing", None, None, "Fast", None, "Txt", "auto"), ("a", "1", "/1", "Completed", None, None, "Fast", None, "Txt", "auto")], JOBS)
    messages = J.Messages()
    assert not J.cancel_job(runtime, jobs, "a", messages) and J.cancel_job(runtime, jobs, "b", messages)
    runtime.jobs["b"].thread.join(60)
    got = []
    J.poll(runtime, lambda job, e: got.append((job, e["kind"], e.get("error"))), ticks=1, wait=0)
    assert got[-1] == ("b", "Error", "cancelled") and messages.status() == "Cancelando job b..." and "Cancelacion solicitada: b" in messages.recent()[0]
    runtime.start("c", lambda: (_ for _ in ()).throw(OSError("no file")))
    runtime.jobs["c"].thread.join(60)
    assert runtime.events_of("c")[-1]["error"] == "no file"
    runtime.retain(["a"])
    assert list(runtime.jobs) == ["a"]
    runtime.forget("a")
    assert not runtime.active()


def test_messages_and_counts(spark):
    now = [0.0]
    messages = J.Messages(lambda: now[0])
    for k in range(150):
        messages.log(str(k))
    assert len(messages.lines) == 100 and [m.split("] ")[1] for m in messages.recent()] == ["149", "148", "147", "146", "145"]
    messages.show("ready")
    now[0] = 2.9
    assert messages.status() == "ready"
    now[0] = 3.0
    assert messages.status() is None
    blocks = spark.createDataFrame(page(TWO) + page(LISTING, number=2), BLOCKS)
    r = J.page_counts(blocks, ["CAPITULO", "panama", "nowhere", "camera"]).first()
    assert (r.pages, r.blocks, r.blocks_per_page, r.keyword_rate) == (2, 10, 5.0, 0.75)
    assert [x.block_idx for x in J.scrolled(blocks.filter("page_no = 1"), ["block_idx"], 4).collect()] == [4, 5]
    events = spark.createDataFrame([("j", k, k) for k in range(9)], "job_id string, seq long, n int").withColumn("ts", F.timestamp_seconds("n"))
    assert [e.seq for e in J.recent_events(events).collect()] == [8, 7, 6, 5, 4]


def test_engine_runs_once(spark, tmp_path):
    """With a folder for checkpoints an engine that never says the same twice still agrees with itself."""
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    blocks = spark.createDataFrame(page([("Text", 100, 120, 500, 140, "old"), ("Text", 100, 420, 500, 140, "fine")], conf=0.42), BLOCKS)
    engine = lambda b, profile: b.withColumns({"content": F.expr("uuid()"), "confidence": F.lit(0.9)})
    out, _ = P.run_passes("AfterOcr", engine(blocks, "Fast").withColumn("confidence", F.lit(0.4)), [P.confidence_boost(engine)], 0, P.Budget(1))
    first = out.collect()
    assert first == out.collect() and len({r.content for r in first}) == 2
    assert stub_engine(blocks).count() == 2
