import glob

from pyspark.sql import functions as F

from cadenza import sinks as K
from cadenza.sources.files import read_documents


def test_many_documents_in_few_files(spark, tmp_path):
    """Files do not grow with the documents one by one; a file of one object alone is read beside them."""
    path = str(tmp_path / "d")
    pretty = F.to_json(F.struct("id", F.struct(F.when(F.col("id") % 3 != 0, F.concat(F.lit('a "],\n'), F.col("id").cast("string"))).alias("name")).alias("about")), {"pretty": "true"})
    K.write_documents(spark.range(0, 2500, 1, 3).select(pretty.alias("document")), path, bits=8)
    assert len(glob.glob(f"{path}/*.txt")) == 12
    (tmp_path / "d" / "one.json").write_text('{\n "id": 9999\n}')
    got = {r.id: r.name for r in read_documents(spark, path, "id long, about struct<name: string>").select("id", "about.name").collect()}
    assert got == {i: f'a "],\n{i}' if i % 3 else None for i in range(2500)} | {9999: None}
