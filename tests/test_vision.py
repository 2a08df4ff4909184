import numpy as np
import pytest

from folioframe.operators import boxes, images, vision
from folioframe.sources import models


@pytest.fixture(scope="module")
def page(spark):
    a = np.full((40, 60, 3), 255, np.uint8)
    a[10:20, 5:35] = 0
    rows = [(1, 60, 40, "rgb", a.tobytes()), (2, 60, 40, "rgb", b"torn"), (3, 2, 2, "gray", b"abcd")]
    return spark.createDataFrame(rows, "image_id long, width int, height int, format string, pixels binary")


class Boxes:
    def run(self, tensors):
        assert tensors["images"].shape == (1, 3, 64, 64)
        return {"out": np.array([[[20.0, 21.0, 8.0, 4.0, 0.9, 0.1], [20.5, 21.0, 8.0, 4.0, 0.8, 0.1], [50.0, 40.0, 6.0, 6.0, 0.2, 0.7]] + [[0.0] * 6] * 5])}


class Large:
    def run(self, tensors):
        return {"out": np.array([[[30.0, 32.0, 30.0, 10.0, 0.9, 0.1]] + [[0.0] * 6] * 7])}


class Map:
    def run(self, tensors):
        x = tensors["x"][0, 0]
        return {"out": np.where(x < 0, 0.95, 0.01)[None, None]}


class Letters:
    def run(self, tensors):
        out = np.zeros((1, 5, 3))
        out[0, [0, 1, 2, 3, 4], [1, 1, 0, 1, 2]] = 0.8
        return {"out": out}


class Next:
    def run(self, tensors):
        ids = tensors["input_ids"]
        out = np.zeros((1, ids.shape[1], 6))
        out[0, -1, [3, 4, 2][min(ids.shape[1] - 1, 2)]] = 1
        return {"out": out}


def test_stub_finds_nothing(page):
    assert vision.detect_formulas(page, side=64).count() == 0 == vision.detect_text(page).count()
    assert {r.text for r in vision.recognize_text(page, {1: "a"}).collect()} == {""}
    assert {(r.image_id, r.confidence) for r in vision.recognize_formulas(page, {}).collect()} == {(1, 0.9), (3, 0.9)}


def test_models_over_images(page):
    one = page.where("image_id = 1")
    found = sorted(vision.detect_formulas(one, Boxes, 64).collect(), key=lambda r: r.confidence)
    assert [(round(r.x), round(r.y), round(r.w), round(r.h)) for r in found] == [(45, 25, 6, 6), (14, 7, 8, 4)]  # 2 pixels of padding at the left, 12 above
    text = vision.detect_text(one, Map).collect()
    assert len(text) == 1 and text[0].x < 5 < 35 < text[0].x + text[0].w and text[0].y < 10 < 20 < text[0].y + text[0].h and text[0].confidence > 0.9
    cut = vision.crops(page.where("image_id <> 2"), boxes.back_project(vision.detect_text(one, Map), 1.0, 1.0, 60, 40))
    assert cut.count() == 1 and cut.first().width > 30
    read = vision.recognize_text(one, {1: "a", 2: "b"}, Letters).first()
    assert read.text == "aab" and abs(read.confidence - 0.8) < 1e-9
    assert vision.recognize_formulas(one, {3: "Ġx", 4: "^2"}, decoder=Next).first().latex == "x^2"
    assert vision.text_size(2000, 30) == (960, 32) and vision.text_size(60, 40) == (64, 32)


def test_pixels(page):
    from pyspark.sql import functions as F

    assert page.where("image_id = 3").select(images.pixel_at("pixels", 1, 1, 2).alias("p"), images.row_bytes(F.col("width"), F.col("format")).alias("n")).first() == (ord("d"), 2)
    assert len(images.normalized(page.where("image_id = 3"), [0.5], [0.5]).first()["values"]) == 4


def test_parameters(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"name": "det", "preprocess": {"resize": {"width": 640, "height": 640}, "normalization": {"mean": [0, 0, 0], "std": [255, 255, 255]}}, "postprocess": {"confidence_threshold": 0.4}}')
    configs = models.read_configs(spark, str(tmp_path))
    d = models.detection_parameters(configs).first()
    assert (d.side, d.confidence, d.overlap, d["std"]) == (640, 0.4, 0.45, [1.0] * 3)
    r = models.recognition_parameters(configs).first()
    assert (r.height, r.width, r.blank) == (640, 640, 0)
    listing = spark.createDataFrame([("m/b", "inference.yml"), ("m/b", "inference.onnx"), ("m/a", "config.json"), ("m/a", "keys.txt"), ("m/a", "model.onnx"), ("n/x", "model.onnx")], "dir string, file string")
    assert models.exported_recognizers(listing).first().asDict() == {"dir": "m/b", "height": 48, "width": 3200, "color_format": "bgr", "mean": [0.5] * 3, "std": [0.5] * 3}
    assert [tuple(x) for x in models.text_model(listing, ["m/", "n/"]).collect()] == [("m/", "m/a", "model.onnx")]
    models.save_settings(str(tmp_path / "s.json"), {"threads": 2})
    assert models.load_settings(str(tmp_path / "s.json"))["threads"] == 2 and models.load_settings(str(tmp_path / "s.json"))["device"] == "cpu"


def test_document_of_images(page, spark, tmp_path, capsys):
    from folioframe.__main__ import main
    from folioframe.plans import image_nodes
    from folioframe.plans.graph import Context
    from folioframe.sdk import Folio

    models = {"side": 64, "formula_detector": lambda: Large(), "formula_decoder": lambda: Next(), "vocabulary": {3: "Ġx", 4: "^2"}, "text_detector": lambda: Map(), "text_recognizer": lambda: Letters(), "keys": {1: "a", 2: "b"}}
    one = page.where("image_id = 1")
    blocks = Folio.from_images(one, **models).blocks.orderBy("ord").collect()
    assert [b.kind for b in blocks].count("paragraph") == 1 and {b.text for b in blocks} == {"x^2", "aab"}
    assert [b.y for b in blocks] == sorted(b.y for b in blocks) and [b.ord for b in blocks] == list(range(1, len(blocks) + 1))
    assert "$$x^2$$" in Folio.from_images(one, "formula", **models).to("markdown").first().body
    assert Folio.from_images(page).blocks.count() == 0  # the stub finds nothing
    assert image_nodes.document_graph().run(Context()).frames == {}
    context = image_nodes.document_graph("text").add(image_nodes.ResizeNode(8, 4)).add(image_nodes.NormalizeNode((0.5,), (0.5,))).run(Context({"images": one}, models))
    assert context.frames["resize"].first().width == 8 and context.metadata["normalize_std"] == [0.5] and context.frames["normalize"].count() == 1
    (tmp_path / "p.png").write_bytes(images.encode_png(np.zeros((6, 6, 4), np.uint8)))
    (tmp_path / "q.png").write_bytes(b"no image")
    assert Folio.from_files(spark, str(tmp_path)).blocks.count() == 0
    assert main(["recognize", "x", "--format", "nothing"]) == 1


def test_margins(spark):
    boxes_ = spark.createDataFrame([(1, 1, 5.0, 2.0, 10.0, 10.0), (1, 2, 5.0, 50.0, 10.0, 40.0)], "image_id long, box_id int, x double, y double, w double, h double")
    assert [(r.y, r.h) for r in vision.padded(boxes_).orderBy("box_id").collect()] == [(0.0, 18.0), (42.0, 56.0)]


def test_line_bands_agree_with_pixels(spark):
    from folioframe.operators import signals

    rng = np.random.default_rng(5)
    cells, want = [], []
    for i in range(6):
        h, w = 60 + 10 * i, 30 + i
        a = np.full((h, w), 250, np.uint8)
        for top in range(5, h - 12, 18):
            a[top : top + int(rng.integers(3, 9)), 3 : w - 3] = rng.integers(0, 120)
        a[rng.random((h, w)) < 0.02] = 10
        cells += [(i, r, c, int(a[r, c])) for r in range(h) for c in range(w)]
        want += [(i, t, b) for t, b in images.row_bands(images.ink_mask(a[:, :, None]))]
    gray = spark.createDataFrame(cells, "image_id long, r long, c long, gray long")
    got = signals.line_bands(gray).select("image_id", "top", "bottom")
    assert want and sorted(tuple(r) for r in got.collect()) == sorted(want)
