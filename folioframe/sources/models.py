"""Model configurations, manifests, dictionaries and vocabularies as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TENSOR = T.StructType([T.StructField("name", T.StringType()), T.StructField("shape", T.ArrayType(T.IntegerType())), T.StructField("dtype", T.StringType())])
CONFIG = T.StructType(
    [
        T.StructField("name", T.StringType()),
        T.StructField("model_type", T.StringType()),
        T.StructField("input", T.StructType([T.StructField("tensors", T.ArrayType(_TENSOR)), T.StructField("color_format", T.StringType())])),
        T.StructField("output", T.StructType([T.StructField("tensors", T.ArrayType(_TENSOR))])),
        T.StructField("preprocess", T.StructType([T.StructField("resize", T.StructType([T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType())])), T.StructField("normalization", T.StructType([T.StructField("mean", T.ArrayType(T.DoubleType())), T.StructField("std", T.ArrayType(T.DoubleType()))]))])),
        T.StructField("postprocess", T.StructType([T.StructField("confidence_threshold", T.DoubleType()), T.StructField("iou_threshold", T.DoubleType())])),
    ]
)
#: What a text recogniser exported with an inference.yml takes.
CTC_DEFAULTS = {"height": 48, "width": 3200, "color_format": "bgr", "mean": [0.5] * 3, "std": [0.5] * 3}
#: Names that model files go by, best first.
MODEL_FILES = ("model.onnx", "inference.onnx", "model_quantized.onnx")
SETTINGS = {"models_dir": "models", "threads": 4, "device": "cpu", "max_regions": 100, "min_confidence": 0.25}
ENCODER_FILES = ("encoder_model.onnx", "encoder.onnx")
DECODER_FILES = ("decoder_model.onnx", "decoder.onnx", "decoder_model_merged.onnx")
TOKENIZER_FILES = ("tokenizer.json", "vocab.json")


def read_configs(spark: SparkSession, path: str) -> DataFrame:
    """Model configurations; unknown fields are ignored, missing ones are null or take defaults, broken files have an error."""
    schema = T.StructType([*CONFIG.fields, T.StructField("_corrupt_record", T.StringType())])
    raw = spark.read.schema(schema).option("multiLine", "true").option("mode", "PERMISSIVE").json(path)
    return raw.select("*", F.coalesce("postprocess.confidence_threshold", F.lit(0.25)).alias("threshold"), F.coalesce("input.color_format", F.lit("rgb")).alias("color")).withColumnRenamed("_corrupt_record", "error")


def exported_recognizers(listing: DataFrame) -> DataFrame:
    """(dir, height, width, color_format, mean, std): directories of a listing (dir, file) that hold an inference.yml, with what they take."""
    found = listing.where("file = 'inference.yml'").select("dir").distinct()
    numbers = [F.array(*[F.lit(x) for x in CTC_DEFAULTS[k]]).alias(k) for k in ("mean", "std")]
    return found.select("dir", *[F.lit(CTC_DEFAULTS[k]).alias(k) for k in ("height", "width", "color_format")], *numbers)


def recognition_parameters(configs: DataFrame) -> DataFrame:
    """(name, height, width, blank, mean, std) of read_configs' rows, with the defaults of text recognisers."""
    of = lambda column, key: F.coalesce(F.col(column), F.array(*[F.lit(x) for x in CTC_DEFAULTS[key]])).alias(key)
    size = [F.coalesce(f"preprocess.resize.{k}", F.lit(CTC_DEFAULTS[k])).alias(k) for k in ("height", "width")]
    return configs.select("name", *size, F.lit(0).alias("blank"), of("preprocess.normalization.mean", "mean"), of("preprocess.normalization.std", "std"))


def detection_parameters(configs: DataFrame, side: int = 768) -> DataFrame:
    """(name, side, confidence, overlap, mean, std) of read_configs' rows; a std above 1 is for pixels up to 255, and is brought to 1."""
    numbers = lambda key, default: F.coalesce(f"preprocess.normalization.{key}", F.array(*[F.lit(default)] * 3))
    whole = F.array_max(numbers("std", 1.0)) > 1
    scaled = lambda key, default: F.when(whole, F.transform(numbers(key, default), lambda x: x / 255)).otherwise(numbers(key, default)).alias(key)
    limits = [F.coalesce("postprocess.confidence_threshold", F.lit(0.25)).alias("confidence"), F.coalesce("postprocess.iou_threshold", F.lit(0.45)).alias("overlap")]
    return configs.select("name", F.coalesce("preprocess.resize.width", F.lit(side)).alias("side"), *limits, scaled("mean", 0.0), scaled("std", 1.0))


def text_model(listing: DataFrame, roots: list[str]) -> DataFrame:
    """(root, dir, model): of each root (in their order) the first directory that has a configuration, a model and keys."""
    has = lambda c: F.max(c.cast("int")) == 1
    file = F.col("file")
    usable = listing.groupBy("dir").agg(has(file.isin("config.json", "inference.yml")).alias("configured"), has(file.endswith(".txt") | file.endswith(".yml")).alias("keyed")).where("configured and keyed")
    models = first_candidate(listing, MODEL_FILES).withColumnRenamed("file", "model").join(usable, "dir")
    order = F.create_map(*[x for i, r in enumerate(roots) for x in (F.lit(r), F.lit(i))])
    rooted = models.withColumn("root", F.element_at(F.filter(F.array(*[F.lit(r) for r in roots]), lambda r: models["dir"].startswith(r)), 1)).where("root IS NOT NULL")
    return rooted.groupBy("root").agg(F.min_by(F.struct("dir", "model"), F.struct(F.try_element_at(order, F.col("root")), "dir")).alias("m")).select("root", "m.dir", "m.model")


def load_settings(path: str) -> dict:
    """An engine's settings, a JSON file; what it lacks has the value of SETTINGS."""
    import json

    with open(path, encoding="utf-8") as f:
        return SETTINGS | json.load(f)


def save_settings(path: str, settings: dict) -> None:
    import json

    with open(path, "w", encoding="utf-8") as f:
        json.dump(SETTINGS | settings, f, indent=2, ensure_ascii=False)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(source, category, variant, url, sha256) of a manifest whose names are in camel or snake case."""
    raw = spark.read.text(path, wholetext=True).select(F.parse_json("value").alias("v"))
    variants = F.coalesce(F.try_variant_get("v", "$.models", "variant"), F.try_variant_get("v", "$.categories", "variant"))
    source = F.coalesce(F.try_variant_get("v", "$.source", "string"), F.try_variant_get("v", "$.sourceUrl", "string"), F.try_variant_get("v", "$.source_url", "string"))
    rows = raw.select(source.alias("source"), F.explode(F.from_json(F.to_json(variants), "map<string,struct<variants:array<struct<id:string,url:string,sha256:string,checkSum:string>>>>")).alias("category", "c"))
    return rows.select("source", "category", F.explode("c.variants").alias("x")).select("source", "category", F.col("x.id").alias("variant"), "x.url", F.coalesce("x.sha256", "x.checkSum").alias("sha256"))


def manifest_violations(manifest: DataFrame) -> DataFrame:
    """Rows that lack a source, category or variant id."""
    empty = lambda c: F.coalesce(F.trim(F.col(c)), F.lit("")) == ""
    return manifest.withColumn("violation", F.when(empty("source"), "source").when(empty("category"), "category").when(empty("variant"), "variant")).where("violation IS NOT NULL")


def verify_checksums(files: DataFrame, sums: DataFrame) -> DataFrame:
    """(path, ok): whether content has the listed SHA-256; true where none is listed."""
    listed = sums.select("path", F.lower("sha256").alias("listed"))
    return files.join(listed, "path", "left").select("path", F.coalesce(F.sha2("content", 256) == F.col("listed"), F.lit(True)).alias("ok"))


def first_candidate(listing: DataFrame, candidates: tuple[str, ...], suffix: str = ".onnx") -> DataFrame:
    """(dir, file): the best candidate that a directory has, else its first file with the suffix."""
    rank = F.array_position(F.array(*[F.lit(c) for c in candidates]), F.col("file"))
    ranked = listing.withColumn("rank", F.when(rank > 0, rank).otherwise(F.lit(len(candidates) + 1)))
    return ranked.where((rank > 0) | F.col("file").endswith(suffix)).groupBy("dir").agg(F.min_by("file", F.struct("rank", "file")).alias("file"))


def safe_name(name: Column) -> Column:
    """No separators and no way up."""
    return name.isNotNull() & (F.length(name) > 0) & ~name.rlike(r"[/\\]|\.\.")


def read_keys(spark: SparkSession, path: str) -> DataFrame:
    """(id, token) of a dictionary: a .yml lists characters, a blank is appended, ids begin at 1; else a line a key from 2."""
    lines = spark.read.text(path, lineSep="\n").select(F.regexp_replace("value", "\r$", "").alias("line"), F.monotonically_increasing_id().alias("n"))
    if path.endswith((".yml", ".yaml")):
        items = lines.where(F.col("line").rlike(r"^\s*-\s")).select("n", F.regexp_replace(F.regexp_replace("line", r"^\s*-\s", ""), "^(['\"])(.*)\\1$", "$2").alias("token"))
        items = items.unionByName(spark.createDataFrame([(1 << 62, " ")], "n long, token string"))
        offset = 1
    else:
        items, offset = lines.select("n", F.col("line").alias("token")), 2
    from pyspark.sql import Window

    return items.select((F.row_number().over(Window.orderBy("n")) - 1 + offset).cast("long").alias("id"), "token")  # a dictionary is small


def read_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """(id, token) of a tokenizer file's model.vocab."""
    text = spark.read.text(path, wholetext=True)
    vocabulary = F.from_json(F.get_json_object("value", "$.model.vocab"), "map<string,bigint>")
    return text.select(F.explode(vocabulary).alias("token", "id")).select("id", "token")


def valid_request(width: Column, height: Column, size: Column, most_bytes: int = 100 << 20, most_side: int = 10_000) -> Column:
    """What the bindings accept: positive sides within limits, and enough bytes for three channels."""
    return (width > 0) & (height > 0) & (width <= most_side) & (height <= most_side) & (size <= most_bytes) & (size >= width * height * 3)


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """(path, width, height, format, pixels, error) of image files, decoded to RGBA."""
    import pyarrow as pa

    from folioframe.operators.images import decode

    def run(batches):
        for batch in batches:
            rows = []
            for p, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    a = decode(content)
                    rows.append((p, a.shape[1], a.shape[0], "rgba", a.tobytes(), None))
                except Exception as e:  # a file that is no image is a row
                    rows.append((p, None, None, None, None, str(e)))
            kinds = [pa.string(), pa.int32(), pa.int32(), pa.string(), pa.binary(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["path", "width", "height", "format", "pixels", "error"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, width int, height int, format string, pixels binary, error string")
