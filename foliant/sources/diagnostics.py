"""Files of a run: page images, Markdown, results and diagnostics as JSON, pairing by file name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

ELEMENT = "struct<label:string,box:array<double>,text:string,from_band:boolean,hybrid:string>"
TRACE = "struct<i:int,label:string,raw:string,raw_chars:int,n_new:int,budget:int,stop:string,ends_nl:boolean,raw_md5:string,html:string,html_md5:string>"
#: Diagnostics of a page.
DIAGNOSTICS = f"struct<layout_raw:string,elements:array<{ELEMENT}>,trace:array<{TRACE}>,page_md:string>"


def images(spark: SparkSession, folder: str, glob: str = "*.png") -> DataFrame:
    """``(path, modificationTime, length, content)`` of the images of a folder."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder)


def stem(path: Column) -> Column:
    """The name of a file without its folders and last ending."""
    return F.regexp_extract(path, r"([^/]+?)(?:\.[^./]*)?$", 1)


def paired(images_: DataFrame, layouts: DataFrame, texts: DataFrame) -> DataFrame:
    """Images ``(path)`` with the layout of their name, which they need, and the text of their name, if there is one.

    ``layouts (stem, layout)``, ``texts (stem, md)``.
    """
    return images_.withColumn("stem", stem(F.col("path"))).join(layouts, "stem").join(texts, "stem", "left")


def element_structs(elements: DataFrame) -> DataFrame:
    """``(page_id, elements)``: the elements of a page in order as an array of :data:`ELEMENT`."""
    box = F.when(F.col("x0").isNotNull(), F.array("x0", "y0", "x1", "y1"))
    one = F.struct("elem_idx", F.struct("label", box.alias("box"), "text", "from_band", F.lit(None).cast("string").alias("hybrid")).alias("e"))
    return elements.groupBy("page_id").agg(F.transform(F.array_sort(F.collect_list(one)), lambda x: x.e).alias("elements"))


def diagnostics(elements: DataFrame, traces: DataFrame) -> DataFrame:
    """``(page_id, value)``: the diagnostics of each page with elements as JSON."""
    fields = [f.split(":")[0] for f in TRACE[7:-1].split(",")]
    t = traces.withColumn("i", F.col("elem_idx")).groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("trace"))
    j = element_structs(elements).join(t, "page_id", "left")
    return j.select("page_id", F.to_json(F.struct("elements", "trace")).alias("value"))


def read_diagnostics(values: DataFrame) -> DataFrame:
    """``(page_id, elem_idx, label, text, raw)``: the elements of diagnostics ``(page_id, value)`` with their traces."""
    d = values.select("page_id", F.from_json("value", DIAGNOSTICS).alias("d"))
    raw = lambda i: F.try_element_at(F.filter("d.trace", lambda t: t.i == i), F.lit(1)).raw
    e = d.select("page_id", F.posexplode("d.elements").alias("elem_idx", "e"), "d")
    return e.select("page_id", "elem_idx", "e.label", "e.text", raw(F.col("elem_idx")).alias("raw"))


def results(elements: DataFrame, pages: DataFrame) -> DataFrame:
    """``(path, value)``: the result of each page as JSON: its image, size and elements."""
    j = pages.join(element_structs(elements), "page_id")
    return j.select("path", F.to_json(F.struct(F.col("path").alias("image"), F.array("width", "height").alias("size"), "elements")).alias("value"))


def write_files(rows: DataFrame, name: str, value: str, folder: str) -> None:
    """One text file in a folder of its own, ``name=...``, for each row; for Markdown, results and diagnostics."""
    rows.select(F.col(name).alias("name"), F.col(value).alias("value")).write.mode("overwrite").partitionBy("name").text(folder)


def read_files(spark: SparkSession, folder: str) -> DataFrame:
    """``(name, value)`` of the files of :func:`write_files`."""
    return spark.read.option("basePath", folder).text(folder, wholetext=True).select(F.col("name").cast("string").alias("name"), F.regexp_replace("value", r"\n\z", "").alias("value"))
