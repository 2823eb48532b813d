"""Landing files of the workload: as many as the rows need, each row once."""

import collections
import glob

from pyspark.sql import functions as F

from tapewright.sources import readers
from workload import landing


def landed(path):
    """Lines below the header, by name of the file, of each file."""
    held = collections.defaultdict(list)
    for file in glob.glob(f"{path}/*/*.csv"):
        with open(file) as text:
            held[file.rsplit("/", 1)[-1]].append(text.read().split("\n")[1:-1])
    return held


def test_files_follow_the_rows_of_their_own_name(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(landing, "ROWS_PER_FILE", 50)
    many, few = 400, 60
    rows = spark.range(many + 10 * few).select(
        F.col("id").alias("code"), F.when(F.col("id") < many, "busy.csv").otherwise(F.concat(F.lit("quiet"), F.col("id") % 10, F.lit(".csv"))).alias("file"),
        F.lit("code").alias("header"),
    )
    held = landed(landing.write_files(rows, str(tmp_path / "files")))
    assert sorted(int(line) for files in held.values() for file in files for line in file) == list(range(many + 10 * few))
    assert len(held["busy.csv"]) <= 8 and all(len(files) <= 2 for name, files in held.items() if name != "busy.csv") and len(held) == 11


def test_a_copied_file_keeps_its_folder(spark, tmp_path):
    for part in (0, 1):
        (tmp_path / f"in/part-{part}").mkdir(parents=True)
        (tmp_path / f"in/part-{part}/US_A260821C1_2026-08-12.csv").write_text(f"code,ticker_direction\n{part},BUY\n")
    landing.copy_files(readers.landed_lines(spark, str(tmp_path / "in")).withColumn("name", F.lit("x")), str(tmp_path / "out"))
    held = landed(tmp_path / "out")
    assert sorted(held["US_A260821C1_2026-08-12.csv"]) == [["0,BUY"], ["1,BUY"]]
