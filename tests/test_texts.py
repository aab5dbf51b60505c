import os
import re

from pyspark.sql import functions as F

from lexweave.plans import files
from lexweave.sources import readers, writers


def test_one_text_per_value(spark, tmp_path):
    rows = [(1, "a\nb"), (2, None), (3, "é"), (3, "é"), (None, "none")]
    path = str(tmp_path / "my texts%20")
    writers.write_texts(spark.createDataFrame(rows, "page_id long, html string"), path, "page_id", "html")
    docs = readers.load_documents(spark, path, "txt").collect()
    found = {re.search(r"page_id=(\w+)", r["metadata"]["source"])[1]: r["content"] for r in docs}
    assert found == {"1": "a\nb\n", "2": "\n", "3": "é\né\n", writers.NULL_NAME: "none\n"} and len(docs) == 4


def test_no_rows_no_texts(spark, tmp_path):
    path = f"file://{tmp_path}/none"
    writers.write_texts(spark.createDataFrame([], "page_id long, html string"), path, "page_id", "html")
    assert readers.load_documents(spark, path, "txt").count() == 0


def test_folders_do_not_grow_with_the_pages(spark, tmp_path):
    pages = spark.range(500).select(F.col("id").alias("page_id"), F.concat(F.lit("<p>"), "id").alias("html"))
    pages.write.parquet(f"{tmp_path}/pages.parquet")
    path = files._page_files(spark, str(tmp_path)).removeprefix("file:")
    folders = [x for x in os.listdir(path) if os.path.isdir(os.path.join(path, x))]
    assert len(folders) <= 4
    images = readers.read_images(spark, path).collect()
    assert sorted(r["length"] for r in images) == sorted(len(f"<p>{i}\n") for i in range(500))
