"""Scans: every source as a DataFrame with an explicit schema."""

from __future__ import annotations

import io
import os
import warnings

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas
from .spreadsheets import read_excel

SPLITS = ("train", "validation", "test")
IMAGE_EXTENSIONS = ("jpg", "jpeg", "png", "bmp", "gif", "webp")


def image_stem(path: Column) -> Column:
    """File name without folders and without its last extension."""
    return F.regexp_extract(path, r"([^/]+?)(\.[^./]*)?$", 1)


def read_split(spark: SparkSession, root: str, split: str) -> DataFrame:
    """One labelled split (``<root>/<split>.tsv``) as typed samples.

    A missing label column or field counts as 0, a missing text as ''.  An
    unknown split is a ``ValueError``; a missing file fails in Spark's reader.
    """
    if split not in SPLITS:
        raise ValueError(f"unknown split {split!r}; one of {', '.join(SPLITS)}")
    raw = spark.read.csv(f"{root}/{split}.tsv", sep="\t", header=True, quote='"', escape='"', multiLine=True)
    return typed_samples(schemas.require(raw, ["file_name"])).withColumn("split", F.lit(split))


class Splits:
    """Splits by name, each read and typed once and kept in Spark's cache until ``close``."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.held = spark, root, {}

    def __getitem__(self, split: str) -> DataFrame:
        if split not in self.held:
            self.held[split] = read_split(self.spark, self.root, split).cache()
        return self.held[split]

    def close(self) -> None:
        while self.held:
            self.held.popitem()[1].unpersist()


def typed_samples(raw: DataFrame) -> DataFrame:
    """Rows of strings as ``image_id, text`` and five integer labels."""

    def integer(name: str) -> Column:
        value = F.col(name).cast("int") if name in raw.columns else F.lit(None).cast("int")
        return F.coalesce(value, F.lit(0)).alias(name)

    text = F.coalesce(F.col("text"), F.lit("")) if "text" in raw.columns else F.lit("")
    return raw.select(image_stem(F.col("file_name")).alias("image_id"), text.alias("text"), *map(integer, (schemas.LABEL, *schemas.SUBTYPES)))


def read_splits(spark: SparkSession, root: str, splits: str, limit: int | None = None) -> DataFrame:
    """Comma-separated splits one after another; ``limit`` counts over all of them, in the order of the files' rows.

    A quoted split file is read in one piece, so the row numbers Spark deals
    out within it rise in file order.
    """
    names = [s.strip() for s in splits.split(",") if s.strip()]
    parts = [read_split(spark, root, s).withColumns({"split_no": F.lit(i), "row_no": F.monotonically_increasing_id()}) for i, s in enumerate(names)]
    if not parts:
        raise ValueError("no split named")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return (out.orderBy("split_no", "row_no").limit(limit) if limit else out).drop("split_no", "row_no")


def read_table(spark: SparkSession, path: str, n_rows: int | None = None, columns: list[str] | None = None) -> DataFrame:
    """A CSV, TSV, JSON-lines, Parquet or Excel table by its extension; another one is a ``ValueError``."""
    kind = os.path.splitext(path)[1].lower()
    readers = {
        ".csv": lambda: spark.read.csv(path, header=True, inferSchema=True),
        ".tsv": lambda: spark.read.csv(path, header=True, inferSchema=True, sep="\t"),
        ".jsonl": lambda: spark.read.json(path),
        ".json": lambda: spark.read.json(path, multiLine=True),
        ".parquet": lambda: spark.read.parquet(path),
        ".xlsx": lambda: read_excel(spark, path),
    }
    if kind not in readers:
        raise ValueError(f"no reader for {kind or path!r}")
    df = readers[kind]()
    df = schemas.require(df, columns).select(*columns) if columns else df
    return df.limit(n_rows) if n_rows else df


def resolve_path(path: str, base: str = ".", data_folder: str = "data", exists=os.path.exists) -> str:
    """First existing of: as given if absolute, under base, in base's data folder by name, as given, in the data folder by name."""
    if os.path.isabs(path):
        return path
    name = os.path.basename(path)
    tried = [os.path.join(base, path), os.path.join(base, data_folder, name), path, os.path.join(data_folder, name)]
    return next((p for p in tried if exists(p)), path)


def read_embedding_archives(spark: SparkSession, pattern: str) -> DataFrame:
    """NumPy archives of parallel arrays as one row an item; archives are decoded in tasks.

    Arrays of an archive must be of one length; a shorter one is a ``ValueError``.
    Where no archive lies under the pattern a warning tells so, and no row comes.
    """
    names = ["image_ids", "image_embeddings", "text_embeddings", "labels", "subtask_labels", "raw_texts"]

    def decode(batches):
        import pandas as pd

        for batch in batches:
            for content in batch["content"]:
                with np.load(io.BytesIO(content), allow_pickle=False) as held:
                    arrays = [held[n] for n in names]
                if len({len(a) for a in arrays}) != 1:
                    raise ValueError("arrays of an archive differ in length")
                yield pd.DataFrame(dict(zip([f.name for f in schemas.EMBEDDINGS.fields], [a.astype(str) if a.dtype.kind in "US" else list(a) if a.ndim > 1 else a for a in arrays])))

    try:
        files = spark.read.format("binaryFile").load(pattern)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        warnings.warn(f"no embedding archive at {pattern}", stacklevel=2)
        return spark.createDataFrame([], schemas.EMBEDDINGS)
    return files.select("content").mapInPandas(decode, schemas.EMBEDDINGS)


def prepared_split(train: DataFrame, validation: DataFrame, target: str = "label") -> DataFrame:
    """Two embedding tables as one: ``image_id, vector, target, split``; vectors are image and text side by side."""

    def part(df: DataFrame, name: str) -> DataFrame:
        df = schemas.require(df, ["image_id", "img_emb", "txt_emb", target])
        return df.select("image_id", F.concat("img_emb", "txt_emb").alias("vector"), F.col(target).alias("target"), F.lit(name).alias("split"))

    return part(train, "train").unionByName(part(validation, "test"))


def read_transcripts(spark: SparkSession, samples: DataFrame, source: str, ocr: DataFrame | None) -> DataFrame:
    """``image_id, text`` of a text source: provided, ocr or combined; no transcript gives no row for ocr."""
    from ..functions import text as tx

    if source == "provided":
        return samples.select("image_id", "text")
    if ocr is None:
        return samples.select("image_id", "text").limit(0)
    if source == "ocr":
        return ocr.select("image_id", "text")
    if source != "combined":
        raise ValueError(f"unknown text source {source!r}")
    both = samples.select("image_id", "text").join(ocr.select("image_id", F.col("text").alias("ocr")), "image_id", "left")
    return both.select("image_id", tx.combine_texts(F.col("text"), F.col("ocr")).alias("text"))


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """Result rows, one or a list a file; of each file the row without a filter, else its first."""
    raw = spark.read.schema(schemas.RESULT).json(path, multiLine=True).withColumn("file", F.input_file_name())
    raw = raw.withColumn("nth", F.monotonically_increasing_id())
    order = Window.partitionBy("file").orderBy((~F.col("filter").eqNullSafe("none")).cast("int"), "nth")
    return raw.withColumn("rank", F.row_number().over(order)).where("rank = 1").drop("rank", "nth")


def read_result_lines(spark: SparkSession, path: str) -> DataFrame:
    """Result rows as the sink writes them, by model, split and task; of each the row without a filter, else the first."""
    raw = spark.read.json(path)
    order = Window.partitionBy("model", "split", "task").orderBy((~F.col("filter").eqNullSafe("none")).cast("int"), "filter")
    return raw.withColumn("rank", F.row_number().over(order)).where("rank = 1").drop("rank")


def read_embeddings(spark: SparkSession, path: str) -> DataFrame:
    """An embedding table as the sink writes it."""
    return schemas.require(spark.read.parquet(path), ["image_id", "img_emb", "txt_emb", "label"])


def read_predictions(spark: SparkSession, path: str, multilabel: bool = False) -> DataFrame:
    """A wide prediction table (``Actual`` and one column a model) in long form: ``model, row_id, actual, pred``."""
    wide = schemas.require(spark.read.csv(path, header=True), ["Actual"])
    if "row_id" not in wide.columns:  # a row's own number where the table has one, else its place in the file
        wide = wide.withColumn("row_id", F.monotonically_increasing_id())
    return long_predictions(wide.withColumn("row_id", F.col("row_id").cast("long")), multilabel)


def long_predictions(wide: DataFrame, multilabel: bool = False) -> DataFrame:
    """Blank rows are skipped; cells are ``int(float(x))``, or lists of such for multi-label tables."""
    from ..functions import text as tx

    models = [c for c in wide.columns if c not in ("Actual", "row_id")]
    wide = wide.where(F.trim(F.coalesce("Actual", F.lit(""))) != "")
    long = wide.unpivot(["row_id", "Actual"], models, "model", "cell").where(F.trim(F.coalesce("cell", F.lit(""))) != "")
    convert = tx.parse_vector if multilabel else lambda c: F.trim(c).cast("double").cast("int")
    return long.select("model", "row_id", convert(F.col("Actual")).alias("actual"), convert(F.col("cell")).alias("pred"))


def read_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """A YAML symbol catalogue (key ``symbols``) as a small DataFrame with its order."""
    import yaml

    with open(path, encoding="utf-8") as f:
        entries = (yaml.safe_load(f) or {}).get("symbols") or []
    names = [f.name for f in schemas.CATALOGUE.fields]
    rows = [tuple(e.get(n) for n in names) + (i,) for i, e in enumerate(entries)]
    return spark.createDataFrame(rows, schema=T.StructType([*schemas.CATALOGUE.fields, T.StructField("ordinal", T.IntegerType())]))


def read_class_folders(spark: SparkSession, root: str) -> DataFrame:
    """``path, label, modified`` of images in one folder a class, extension-filtered."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    kept = files.where(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*IMAGE_EXTENSIONS))
    return kept.select("path", F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("label"), F.col("modificationTime").alias("modified"))


def read_image_folder(spark: SparkSession, root: str, subset: str) -> DataFrame:
    """``image_id, path`` of a flat folder's images in path order, ids ``<subset>_<place>``; none is a ``ValueError``."""
    files = spark.read.format("binaryFile").load(root).select("path")
    kept = files.where(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*IMAGE_EXTENSIONS))
    if kept.isEmpty():
        raise ValueError(f"no images in {root}")
    place = F.row_number().over(Window.orderBy("path")) - 1  # paths alone, no content
    return kept.select(F.concat_ws("_", F.lit(subset), place).alias("image_id"), "path")


def same_manifest(a: DataFrame, b: DataFrame) -> bool:
    """Whether two ``path, label, modified`` tables list the same files in the same state."""
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def evaluation_row(table: DataFrame, model: str, ordinal: str) -> DataFrame:
    """The first row of an evaluation table for a model's name, blanks around it aside."""
    return table.where(F.trim("Model") == model).orderBy(ordinal).limit(1)


def read_annotations(df: DataFrame, image_col: str, label_col: str) -> tuple[DataFrame, DataFrame]:
    """Annotations, and their sorted distinct non-null classes as a DataFrame."""
    df = schemas.require(df, [image_col, label_col]).select(F.col(image_col).alias("image"), F.col(label_col).cast("string").alias("label"))
    return df, df.where("label is not null").select("label").distinct().orderBy("label")
