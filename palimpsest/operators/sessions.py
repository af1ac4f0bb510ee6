"""Where models run: backends, threads, the models' files, and bringing an engine up while others wait."""

from __future__ import annotations

import os
import queue
import threading
from collections.abc import Callable
from dataclasses import dataclass

# Backends from the fastest, as they are shown, and by the names the runtime gives them.
BACKENDS = {"TensorRT": "TensorrtExecutionProvider", "CUDA": "CUDAExecutionProvider", "ROCm": "ROCMExecutionProvider", "CoreML": "CoreMLExecutionProvider", "CPU": "CPUExecutionProvider"}
# The models' files under their folder.
MODEL_FILES = {
    "orientation": "orientation/PP-LCNet_x1_0_doc_ori.onnx", "layout": "layout/doclayout_yolo_docstructbench_imgsz1024.onnx",
    "detect": "ocr/det.onnx", "recognise": "ocr/rec.onnx", "dictionary": "ocr/dict.txt", "table": "table/model_uint8.onnx",
}
# Threads a model's session takes.
SESSION_THREADS = {"layout": 4, "detect": 4, "recognise": 2, "table": 2, "orientation": 2}


def available() -> list[str]:
    """The runtime's providers; none without the runtime."""
    try:
        import onnxruntime
    except ImportError:
        return []
    return list(onnxruntime.get_available_providers())


def backend(names: list[str] | None = None) -> str:
    """The fastest backend among provider ``names`` (by default those of the runtime)."""
    names = available() if names is None else names
    return next((label for label, provider in BACKENDS.items() if provider in names), "CPU")


def is_gpu(label: str) -> bool:
    return label != "CPU"


def providers(label: str, device: int = 0) -> list:
    """What a session is given: the accelerator, if any, and the CPU last."""
    cpu = BACKENDS["CPU"]
    if not is_gpu(label):
        return [cpu]
    own = BACKENDS[label]
    return [own if label == "CoreML" else (own, {"device_id": str(device)}), cpu]


def threads(label: str, cores: int | None = None) -> int:
    """Two beside an accelerator; else half the cores, one at least."""
    return 2 if is_gpu(label) else max(1, (cores or os.cpu_count() or 4) // 2)


def acceleration(label: str, active: bool) -> str:
    """How a backend is told to users."""
    if active and is_gpu(label):
        return f"GPU: {label} (activa)"
    return f"GPU: {label} (no disponible, usando CPU)" if is_gpu(label) else "CPU (sin aceleracion GPU)"


def open_sessions(folder: str, label: str = "CPU", device: int = 0) -> dict[str, Callable]:
    """One callable a model of ``folder``, from a tensor to its outputs. A missing file is named."""
    import onnxruntime

    out = {}
    for name, n in SESSION_THREADS.items():
        path = os.path.join(folder, MODEL_FILES[name])
        if not os.path.exists(path):
            raise FileNotFoundError(path)
        options = onnxruntime.SessionOptions()
        options.intra_op_num_threads = n
        session = onnxruntime.InferenceSession(path, options, providers=providers(label, device))
        first = session.get_inputs()[0].name
        out[name] = lambda tensor, s=session, i=first: s.run(None, {i: tensor})
    return out


@dataclass(frozen=True)
class Step:
    """What one event of a start changes: the engine, a line for the log, a line for the status."""

    engine: object = None
    log: str | None = None
    status: str | None = None
    done: bool = False


class Bootstrap:
    """Brings an engine up in a thread: ``provision(on_gpu, on_file, on_bytes)`` returns the models' folder, ``load(folder)`` the engine.
    ``step`` takes one event at a time; after a failure the stub engine serves."""

    def __init__(self, provision: Callable, load: Callable):
        self.provision, self.load = provision, load
        self.events: queue.SimpleQueue | None = None
        self.loaded = self.failed = False
        self.progress, self.phase, self.bytes, self.acceleration = 0.0, "", (0, 0), ""

    def start(self) -> threading.Thread:
        self.events = events = queue.SimpleQueue()
        self.loaded = self.failed = False
        self.progress, self.phase, self.bytes, self.acceleration = 0.0, "Verificando modelos...", (0, 0), ""

        def work():
            try:
                folder = self.provision(lambda *x: events.put(("gpu", x)), lambda *x: events.put(("file", x)), lambda *x: events.put(("bytes", x)))
                events.put(("ready", (self.load(folder),)))
            except Exception as e:  # whatever goes wrong is told, not thrown away with the thread
                events.put(("error", (str(e),)))

        thread = threading.Thread(target=work, daemon=True)
        thread.start()
        return thread

    def step(self) -> Step | None:
        """The next event, if there is one."""
        try:
            kind, x = self.events.get_nowait() if self.events else (None, ())
        except queue.Empty:
            return None
        if kind == "gpu":
            self.acceleration = acceleration(*x)
            return Step(log=f"Aceleracion: {self.acceleration}")
        if kind == "file":
            name, now, total = x
            self.progress, self.phase, self.bytes = now / total, f"Descargando {name} ({now}/{total})", (0, 0)
            return Step(log=f"Descargando modelo {now}/{total}: {name}")
        if kind == "bytes":
            self.bytes = x
            return Step()
        if kind is None:
            return None
        self.loaded, self.events = True, None
        if kind == "ready":
            self.progress = 1.0
            return Step(engine=x[0], log="Motor OCR ONNX cargado exitosamente", status="Motor OCR listo", done=True)
        self.failed = True
        return Step(log=f"Error motor ONNX: {x[0]}. Usando Stub (resultados ficticios).", status=f"Error motor ONNX: {x[0]}", done=True)
